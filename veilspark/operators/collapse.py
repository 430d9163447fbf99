"""Repeats of one value become one finding with a count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.joins import salted_join
from ..functions.text import collapse_whitespace, finding_id, redact
from ..rules.model import SEVERITIES

GROUP = ["employee", "rule_id", "value_key"]

_FIRST = (
    "category", "subtype", "severity", "confidence", "session_id", "source", "kind",
    "location", "start", "end", "value", "snippet", "descriptive",
)


def severity_rank(severity: Column) -> Column:
    out = F.lit(9)
    for i, s in enumerate(SEVERITIES):
        out = F.when(severity == s, i).otherwise(out)
    return out


def ranking() -> list[Column]:
    """Worst first; equal findings keep the order they were seen in."""
    return [
        severity_rank(F.col("severity")).asc(), F.col("confidence").desc(), F.col("employee").asc(),
        F.col("location").asc(), F.col("rule_id").asc(), F.col("seq").asc(),
    ]


def _keyed(hits: DataFrame) -> DataFrame:
    live = hits.where(F.col("suppressed_by").isNull()) if "suppressed_by" in hits.columns else hits
    # Whitespace-normalised but not trimmed.
    return live.withColumn("value_key", collapse_whitespace(F.col("value")))


def collapse(hits: DataFrame) -> DataFrame:
    """One finding per (employee, rule, value): the first seen, and how many.

    A single shuffle after map-side aggregation, so a value that makes up much
    of the data arrives as one row per input partition.
    """
    grouped = _keyed(hits).groupBy(*GROUP).agg(
        F.min_by(F.struct(*_FIRST, "seq"), F.col("seq")).alias("first"),
        F.count("*").alias("occurrences"),
    )
    out = grouped.select(
        "rule_id", "employee", *[F.col(f"first.{c}").alias(c) for c in (*_FIRST, "seq")], "occurrences",
    )
    return out.withColumn(
        "finding_id", finding_id(F.col("employee"), F.col("rule_id"), F.col("value"))
    ).withColumn("value_redacted", redact(F.col("value")))


def ranked(findings: DataFrame) -> DataFrame:
    return findings.orderBy(*ranking())


def top(findings: DataFrame, n: int = 10) -> DataFrame:
    """The *n* worst findings."""
    return findings.orderBy(*ranking()).limit(n)


def sightings(hits: DataFrame) -> DataFrame:
    """Where else each finding was seen: ``(employee, rule_id, value_key, location, at)``.

    One row per distinct later location, ordered by ``at``.  The first sighting
    is left out, but its location appears if the value occurs there again.
    This is the whole list however long it is; it is never gathered in one place.
    """
    # Gathers only the repeats inside one location, that is one records row.
    per_place = _keyed(hits).groupBy(*GROUP, "location").agg(
        F.slice(F.array_sort(F.collect_list("seq")), 1, 2).alias("seen")
    )
    first = per_place.groupBy(*GROUP).agg(F.min(F.col("seen")[0]).alias("first_seq"))
    joined = salted_join(per_place, first, GROUP, spread_by=["location"])
    at = F.when(F.col("seen")[0] == F.col("first_seq"), F.try_element_at("seen", F.lit(2))).otherwise(
        F.col("seen")[0]
    )
    return joined.select(*GROUP, "location", at.alias("at")).where(F.col("at").isNotNull())


def with_also_at(findings: DataFrame, seen: DataFrame, *, inline_up_to: int = 1000) -> DataFrame:
    """Add ``also_at_count`` and, where it is short enough, ``also_at`` in order.

    Longer lists leave ``also_at`` NULL; :func:`sightings` holds all of them.
    """
    counts = seen.groupBy(*GROUP).agg(F.count("*").alias("also_at_count"))
    short = salted_join(
        seen, counts.where(F.col("also_at_count") <= inline_up_to), GROUP, spread_by=["location"]
    )
    lists = short.groupBy(*GROUP).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("at", "location"))), lambda s: s["location"]
        ).alias("also_at")
    )
    empty = F.array().cast("array<string>")
    return (
        findings.withColumn("value_key", collapse_whitespace(F.col("value")))
        .join(counts, GROUP, "left").join(lists, GROUP, "left").drop("value_key")
        .withColumn("also_at_count", F.coalesce("also_at_count", F.lit(0)))
        .withColumn("also_at", F.when(F.col("also_at_count") == 0, empty).otherwise(F.col("also_at")))
    )


def keep_last(findings: DataFrame) -> DataFrame:
    """One row per finding id: the last in rank order, as an overwrite would leave it.

    Two findings share an id when their values differ only in outer whitespace.
    """
    rank = F.struct(
        severity_rank(F.col("severity")), -F.col("confidence"), "employee", "location", "rule_id", "seq"
    )
    return findings.groupBy("finding_id").agg(
        F.max_by(F.struct(*findings.columns), rank).alias("last")
    ).select("last.*")
