from veilspark.operators import score


def findings(spark, rows):
    return spark.createDataFrame(
        rows, "employee string, rule_id string, subtype string, severity string, confidence int, category string, "
        "location string, value string")


def test_greedy_matching(spark):
    found = findings(spark, [
        ("a", "r1", "ni", "high", 90, "pii", "f#0.0", "JT1"),
        ("a", "r2", "name", "medium", 70, "pii", "f#0.900", "Mirela  Voss"),
        ("a", "r3", "ni", "high", 90, "pii", "f#0.0", "JT2"),
        ("a", "r4", "other", "low", 10, "internal", "f#1.0", "4 rows naming personal fields (x)"),
        ("a", "r5", "ni", "high", 90, "pii", "g#0.0", "JT3"),
    ])
    plants = spark.createDataFrame([
        (1, "a", "f", 0, "pii", "ni", "high", "JT9"),
        (2, "a", "f", 0, "pii", "ni", "high", "JT2"),
        (3, "a", "f", 0, "pii", "ni", "high", "third"),
        (4, "a", "f", 0, "pii", "label", "high", "mirela voss"),
        (5, "a", "f", 1, "pii", "export", "high", "rows naming"),
        (6, "a", "f", 2, "pii", "ni", "high", "JT3"),
    ], "plant_id bigint, employee string, file string, record_index bigint, category string, subtype string, "
       "severity string, value string")
    matched = score.assignments(plants, found)
    assert sorted(r.plant_id for r in matched.collect()) == [1, 2, 4, 5]
    hit = score.scored(plants, matched)
    overall = {r.category: (r.hits, r.plants) for r in score.recall(hit).collect()}
    assert overall == {"pii": (4, 6), "(all)": (4, 6)}
    assert sorted(r.plant_id for r in score.missed(hit).collect()) == [3, 6]
    assert [r.rule_id for r in score.unlabelled(found, matched).collect()] == ["r5"]
    gap = {(r.category, r.gap) for r in score.category_gap(plants, found).collect()}
    assert gap == {("internal", "detected only")}


def _plan(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


PLANT = "plant_id bigint, employee string, file string, record_index bigint, category string, subtype string, severity string, value string"


def test_labels_are_not_copied_and_candidates_are_shuffled_twice(spark):
    found = findings(spark, [("a", "r1", "ni", "high", 90, "pii", "f#0.0", "JT1")])
    plants = spark.createDataFrame([(1, "a", "f", 0, "pii", "ni", "high", "JT1")], PLANT)
    plan = _plan(score.assignments(plants, found))
    # findings, labels by record, the same for the join; then candidates by label and by record
    assert "_salt" not in plan and plan.count("Exchange hashpartitioning") == 5
    key = score.assignments(plants, found).first().finding_key
    assert key == found.select(score.finding_key()).first()[0] and len(key) == 64


def test_repeated_labels_are_matched_once(spark):
    found = findings(spark, [("a", "r1", "ni", "high", 90, "pii", "f#0.0", "JT1"), ("a", "r2", "ni", "high", 80, "pii", "f#0.1", "JT2")])
    plants = spark.createDataFrame([(n, "a", "f", 0, "pii", "ni", "high", v) for n, v in ((1, "JT1"), (2, "JT2"))] * 2 + [
        (3, "a", None, 0, "pii", "ni", "high", "JT1")], PLANT)
    matched = score.assignments(plants, found)
    keys = {r.rule_id: r.k for r in found.select("rule_id", score.finding_key().alias("k")).distinct().collect()}
    assert sorted(map(tuple, matched.collect())) == [(1, keys["r1"]), (2, keys["r2"])]
    assert score.unlabelled(found, matched).count() == 0
