"""Detection quality against labelled plants.

``plants(plant_id, employee, file, record_index, category, subtype, severity,
value)``; ``plant_id`` gives their order.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.joins import shuffled, split_join
from ..functions.text import collapse_whitespace, location_file, location_record, strip
from .collapse import severity_rank


_PAIRS = T.ArrayType(T.StructType().add("plant_id", T.LongType()).add("finding_key", T.BinaryType()))


@F.pandas_udf(_PAIRS)
def _assign(records: pd.Series) -> pd.Series:
    """Each plant of a record, in order, takes the first of its candidates that is still free."""

    def one(candidates) -> list[dict]:
        taken, served, pairs = set(), set(), []
        for c in candidates:
            plant, key = c["plant_id"], bytes(c["finding_key"])
            if plant not in served and key not in taken:
                served.add(plant)
                taken.add(key)
                pairs.append({"plant_id": plant, "finding_key": key})
        return pairs

    return records.map(one)


def finding_key() -> Column:
    """Tells collapsed findings apart; ``finding_id`` ignores outer whitespace."""
    return F.lower(F.hex(_digest()))


def _digest() -> Column:
    """The same in half the bytes, for what is shuffled."""
    return F.unhex(F.sha2(F.concat_ws("\x1f", "employee", "rule_id", collapse_whitespace(F.col("value"))), 256))


def assignments(plants: DataFrame, findings: DataFrame) -> DataFrame:
    """``(plant_id, finding_key)``: one finding for one plant, greedily in order.

    A match never leaves its record.  Findings are compared where they lie with the labels of
    their record.  Of those that fit a plant only the first few are kept, one more than other
    plants could take; so what is gathered grows with a record's labels, not with its findings.
    """
    placed = findings.select(
        location_file(F.col("location")).alias("file"),
        location_record(F.col("location")).cast("bigint").alias("record_index"),
        "subtype", F.lower(strip(collapse_whitespace(F.col("value")))).alias("got"),
        _digest().alias("finding_key"),
        F.concat_ws(
            "\x1f", severity_rank(F.col("severity")).cast("string"),
            F.lpad((100 - F.col("confidence")).cast("string"), 3, "0"), "employee", "location", "rule_id",
        ).alias("order"),
    )
    wanted = plants.select(
        F.col("plant_id").cast("bigint").alias("plant_id"), "file",
        F.col("record_index").cast("bigint").alias("record_index"), "subtype", "value",
    )
    place = ["file", "record_index"]
    plants_of = wanted.groupBy(*place).agg(F.array_sort(F.collect_list(F.struct(
        "plant_id", "subtype", F.lower("value").alias("value")))).alias("plants"))
    fits = F.filter("plants", lambda p: F.coalesce(
        p["subtype"].eqNullSafe(F.col("subtype")) | F.contains(F.col("got"), p["value"]) | F.contains(p["value"], F.col("got")),
        F.lit(False)))
    pairs = split_join(placed, plants_of, place).select(
        *place, F.size("plants").alias("room"), "order", "finding_key",
        F.explode(F.transform(fits, lambda p: p["plant_id"])).alias("plant_id"),
    )
    # a record's room is the same in each of its rows
    nth = F.row_number().over(Window.partitionBy(*place, "plant_id").orderBy("order", "finding_key"))
    candidates = pairs.withColumn("nth", nth).where(F.col("nth") <= F.col("room"))
    return candidates.groupBy(*place).agg(
        F.array_sort(F.collect_list(F.struct("plant_id", "nth", "finding_key"))).alias("candidates")
    ).select(F.explode(_assign("candidates")).alias("p")).select("p.plant_id", F.lower(F.hex("p.finding_key")).alias("finding_key"))


def scored(plants: DataFrame, matched: DataFrame) -> DataFrame:
    """Plants with ``hit``."""
    return plants.join(
        shuffled(matched.select("plant_id", F.lit(True).alias("hit"))), "plant_id", "left"
    ).withColumn("hit", F.coalesce("hit", F.lit(False)))


def recall(scored_plants: DataFrame) -> DataFrame:
    """Hits, plants and recall per category, and over all as ``(all)``."""
    return (
        scored_plants.select(
            F.explode(F.array("category", F.lit("(all)"))).alias("category"), F.col("hit").cast("int").alias("hit")
        )
        .groupBy("category").agg(F.sum("hit").alias("hits"), F.count("*").alias("plants"))
        .withColumn("recall", F.col("hits") / F.col("plants"))
    )


def missed(scored_plants: DataFrame) -> DataFrame:
    return scored_plants.where(~F.col("hit")).drop("hit")


def unlabelled(findings: DataFrame, matched: DataFrame) -> DataFrame:
    """Findings no plant claims.  Not false positives: not everything is labelled."""
    return findings.withColumn("_key", _digest()).join(
        shuffled(matched.select(F.unhex("finding_key").alias("_key"))), "_key", "left_anti"
    ).drop("_key")


def control_verdict(controls: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings per control person; any at all fails."""
    counts = findings.groupBy("employee").agg(F.count("*").alias("findings"))
    return (
        controls.select("employee").distinct().join(shuffled(counts), "employee", "left").fillna(0, ["findings"])
        .withColumn("verdict", F.when(F.col("findings") == 0, "PASS").otherwise("FAIL"))
    )


def category_gap(plants: DataFrame, findings: DataFrame) -> DataFrame:
    """Categories planted but never detected, or the other way round."""
    planted = plants.select("category").distinct()
    detected = findings.select("category").distinct()
    return planted.exceptAll(detected).withColumn("gap", F.lit("planted only")).unionByName(
        detected.exceptAll(planted).withColumn("gap", F.lit("detected only"))
    )
