"""Joins whose sides grow with the input are shuffled, whatever Spark guesses of their sizes."""

from pyspark.sql import functions as F

from veilspark.functions.joins import key_filter, may_hold, salted_join, split_join
from veilspark.operators.sanitise import sanitise
from veilspark.operators.score import assignments, recall, scored, unlabelled
from veilspark.operators.terms import term_matches

from support import as_records


def _plan(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


def _findings(spark):
    return spark.createDataFrame(
        [("r.v1", "e", "secret", "s", "high", 90, "f#0.0", "value-of-one", "see value-of-one", False, "id")],
        "rule_id string, employee string, category string, subtype string, severity string, confidence int, location string, "
        "value string, snippet string, descriptive boolean, finding_id string")


def test_a_salted_side_is_not_broadcast(spark):
    big = spark.range(50).select((F.col("id") % 5).alias("k"), "id")
    joined = salted_join(big, spark.range(5).select(F.col("id").alias("k"), F.lit("x").alias("v")), ["k"], spread_by=["id"])
    assert "Broadcast" not in _plan(joined) and joined.count() == 50


def test_a_split_side_is_shuffled_once_and_its_heavy_key_split(spark):
    big = spark.range(0, 60_000, 1, 6).select(F.when(F.col("id") % 10 < 8, 7).otherwise(F.col("id") % 50).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    keys = spark.range(40).select(F.col("id").alias("k"), F.lit("x").alias("w"))
    unique = keys.groupBy("k").agg(F.first("w").alias("w"))  # lies by the key of the join already
    small = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50k",
             "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        joined = split_join(big, unique, ["k"], "left")
        assert "_salt" not in _plan(joined) and "Broadcast" not in _plan(joined)
        rows = joined.groupBy("w").agg(F.count("v").alias("count"), F.max("v"))
        assert {r.w: r["count"] for r in rows.collect()} == {"x": 60_000 - 10 * 240, None: 10 * 240}
        assert "skew=true" in _plan(rows)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_a_filter_holds_its_keys_and_few_others(spark):
    keys = spark.range(2000).select(F.concat(F.lit("key"), "id").alias("k")).unionByName(spark.createDataFrame([(None,)], "k string"))
    known = key_filter(keys, "k")
    rows = spark.range(20_000).select(F.concat(F.lit("key"), "id").alias("k")).where(may_hold(known, F.col("k")))
    assert rows.where("int(substr(k, 4)) < 2000").count() == 2000 and rows.count() < 2050


def test_masking_copies_no_side_and_shuffles_few_pieces(spark):
    assert "_salt" not in _plan(sanitise(_findings(spark)))


def test_masking_sends_nothing_to_the_driver(spark):
    clean = sanitise(_findings(spark))
    assert "Broadcast" not in _plan(clean)
    assert clean.first().snippet == "see va******ne"


def test_scoring_sends_nothing_to_the_driver(spark):
    plants = spark.createDataFrame(
        [(1, "e", "f", 0, "secret", "s", "high", "value-of-one")],
        "plant_id long, employee string, file string, record_index long, category string, subtype string, severity string, value string")
    found = _findings(spark)
    matched = assignments(plants, found)
    left = unlabelled(found, matched)
    by_category = recall(scored(plants, matched))
    assert "Broadcast" not in _plan(left) and "Broadcast" not in _plan(by_category)
    assert left.count() == 0 and {r.category: r.hits for r in by_category.collect()} == {"secret": 1, "(all)": 1}


def test_terms_send_nothing_to_the_driver(spark):
    terms = spark.createDataFrame([("Lot 7",)], "term string")
    found = term_matches(as_records(spark, ["sent lot 7 off", "a lot"]), terms)
    assert "Broadcast" not in _plan(found) and [r.value for r in found.collect()] == ["lot 7"]
