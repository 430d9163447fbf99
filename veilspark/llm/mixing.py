"""Mix sources to target weights.

Sources get shares of a token budget by weight.  A source that would need more
than ``epochs`` passes over its text gets exactly that, and the excess goes to
the others by weight until none is above.  Within a source every complete epoch
takes all documents; the remaining fraction is an Efraimidis-Spirakis sample:
keys ``-ln(u) / weight`` in ascending order, taken until the budget is used.

Everything is DataFrame operations.  Running sums are kept per narrow range of
keys, so a source that holds most rows is spread like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import stage

#: Ranges of keys per doubling of the key.
RANGES = 256
WORD = r"[^\x20\x09-\x0D]+"


def uniform(identity: Column, salt: str) -> Column:
    """A number in (0, 1) that depends on *identity* and *salt* only."""
    digest = F.md5(F.concat(F.coalesce(identity.cast("string"), F.lit("")), F.lit("|" + salt)).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_targets(sources: DataFrame, rates: tuple[float, ...] = (1, 2, 3), epochs: int = 3) -> DataFrame:
    """``target`` for each row of ``sources(source, source_size)``.

    Sources in code point order (null last) get the weights *rates*, repeating;
    the targets add up to the sum of all sizes.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    rate = F.element_at(F.array(*(F.lit(float(r)) for r in rates)), (rank % len(rates) + 1).cast("int"))
    out = sources.withColumn("rate", rate).withColumn("cap", F.col("source_size").cast("double") * epochs)
    by_ratio = Window.orderBy(F.col("cap") / F.col("rate"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # what a unit of weight gets if exactly the sources before this one are at their cap; the largest holds
    level = (F.sum(F.col("source_size").cast("double")).over(everything)
             - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("rate").over(onward)
    out = out.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return out.withColumn("target", F.least(F.col("cap"), F.col("level") * F.col("rate"))).drop("cap", "level")


def mixture(
    docs: DataFrame, weights: DataFrame | None = None, *, rates: tuple[float, ...] = (1, 2, 3),
    epochs: int = 3, salt: str = "mix",
) -> DataFrame:
    """How often each row of ``docs(doc_id, source, text)`` is taken.

    Returns ``doc_id, source, size, source_size, target, passes, taken``:
    ``size`` is the number of words (null text: 0), ``passes`` the whole epochs
    plus 1 if the fractional draw takes the document, ``taken = size * passes``.
    ``weights(doc_id, weight)`` are quality weights; a document without one
    counts 1, weights below 1e-6 (and NaN) count 1e-6, the largest of repeated ones
    holds.  Draws depend on ``doc_id`` and *salt* only, so reruns agree; equal keys
    go by id, then size.  A null id or source is a value like any other.  Other
    columns are ignored; an empty table gives an empty result.
    """
    base = docs.select(
        "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    if weights is not None:
        best = weights.groupBy("doc_id").agg(F.max(F.col("weight").cast("double")).alias("weight"))
        base = base.join(best, "doc_id", "left")
        weight = F.coalesce("weight", F.lit(1.0))
        weight = F.when(F.isnan(weight), 1e-6).otherwise(F.greatest(weight, F.lit(1e-6)))
    else:
        weight = F.lit(1.0)
    key = -F.log(uniform(F.col("doc_id"), salt)) / weight
    base = stage(base.select(
        "doc_id", "source", "size", key.alias("key"), F.floor(F.log2(key) * RANGES).alias("range"),
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("name"),
    ), "mixing")

    totals = base.groupBy("name", "range").agg(F.sum("size").alias("here"), F.max("source").alias("source"))
    sources = totals.groupBy("name").agg(F.sum("here").alias("source_size"), F.max("source").alias("source"))
    plan = source_targets(sources, rates, epochs).select(
        "name", "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).alias("whole"),
    )
    ranges = totals.select(
        "name", "range",
        (F.sum("here").over(Window.partitionBy("name").orderBy("range")) - F.col("here")).alias("earlier"),
    ).join(plan, "name")
    order = Window.partitionBy("name", "range").orderBy("key", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, -1)
    used = F.col("earlier") + F.coalesce(F.sum("size").over(order), F.lit(0))
    left = F.col("target") - F.col("whole") * F.col("source_size")
    drawn = (used + F.col("size") / 2 <= left) & (left > 0)
    passes = (F.col("whole") + drawn.cast("long")).alias("passes")
    return base.join(ranges, ["name", "range"]).select(
        "doc_id", "source", "size", "source_size", "target", passes,
    ).withColumn("taken", F.col("size") * F.col("passes"))


def take(docs: DataFrame, weights: DataFrame | None = None, **options) -> DataFrame:
    """The rows of *docs* that the mix takes, each as often as :func:`mixture` says; all columns are kept.

    Rows that repeat an id, a source and a size share what the mix takes of them.
    """
    mixed = mixture(docs, weights, **options)
    alike = Window.partitionBy("_id", "_source", "_size")
    mixed = mixed.select(
        F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), "passes",
    ).withColumn("_n", F.row_number().over(alike.orderBy(F.desc("passes")))).where("passes > 0")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(
        F.struct("*").alias("row"), F.col("doc_id").alias("_id"), F.col("source").alias("_source"), size.alias("_size"))
    rows = rows.withColumn("_n", F.row_number().over(alike.orderBy("row.text")))
    mixed = mixed.toDF(*(f"m{c}" for c in mixed.columns))
    same = [rows[c].eqNullSafe(mixed[f"m{c}"]) for c in ("_id", "_source", "_size", "_n")]
    joined = rows.join(mixed, same).select("row", F.explode(F.array_repeat(F.lit(0), F.col("mpasses").cast("int"))))
    return joined.select("row.*")
