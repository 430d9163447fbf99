import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from support import as_records
from veilspark.operators.detect import MARK
from veilspark.operators.terms import anchors, term_matches

PIECES = ["ab", "Ab c", "c", "c-d", "(c)", "ab c d", "é", "a.b", "x_1", "ab  c", "$c", "c+", "++"]


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.sampled_from(PIECES), max_size=6), st.lists(
    st.lists(st.sampled_from([*PIECES, " ", " ", "-", "AB", ".", "cc"]), max_size=12).map("".join), max_size=6))
def test_matches_are_those_of_one_alternation(spark, terms, texts):
    wanted = sorted({t.lower() for t in terms if re.search(r"\w", t)}, key=lambda t: (-len(t), t))
    want = []
    if wanted:
        pattern = re.compile(r"(?i)\b(?:" + "|".join(map(re.escape, wanted)) + r")\b")
        want = sorted((f"pat/log.jsonl#{i}.0", m.start(), m.group()) for i, t in enumerate(texts) for m in pattern.finditer(t))
    records = as_records(spark, texts) if texts else as_records(spark, ["x"]).limit(0)
    got = term_matches(records, spark.createDataFrame([(t,) for t in [*terms, None, " ", "++"]], "term string"))
    assert sorted((r.location, r.start, r.value) for r in got.collect()) == want


def test_terms_are_found_by_their_rarest_word(spark):
    terms = spark.createDataFrame([(f"Project Number {i}",) for i in range(50)] + [("project",)], "term string")
    assert {r.word for r in anchors(terms).collect()} == {*map(str, range(50)), "project"}


def test_only_rarest_words_are_shuffled_and_nothing_is_searched_twice(spark):
    lines = as_records(spark, ["sent lot 7 with lot-8x to them all"] * 300)
    found = term_matches(lines, spark.createDataFrame([("Lot 7",), ("lot 8x",)], "term string"))
    assert found.count() == 300
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    plan = found._jdf.queryExecution().explainString(mode).split("+- Subquery")[0]
    assert "_salt" not in plan and "Filter (size(" not in plan and "emit_seq" not in "".join(x for x in plan.splitlines() if "Exchange" in x)


def test_terms_and_texts_that_hold_the_mark(spark):
    texts = [f"a {MARK}b c{MARK} b", f"b {MARK}", "b b"]
    got = term_matches(as_records(spark, texts), spark.createDataFrame([("B",), (f"c{MARK} b",)], "term string"))
    assert sorted((r.location, r.start, r.value) for r in got.collect()) == [
        ("pat/log.jsonl#0.0", 3, "b"), ("pat/log.jsonl#0.0", 5, f"c{MARK} b"), ("pat/log.jsonl#1.0", 0, "b"),
        ("pat/log.jsonl#2.0", 0, "b"), ("pat/log.jsonl#2.0", 2, "b")]
