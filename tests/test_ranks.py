from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilspark.operators.ranks import with_rank


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 4) | st.none(), st.text("ab", max_size=2)), max_size=30))
def test_places_are_those_of_one_sort(spark, rows):
    df = spark.createDataFrame(rows, "n int, `a.b` string").repartition(5)
    got = with_rank(df, [F.col("n").desc_nulls_last(), F.col("`a.b`").asc()], "place").orderBy("place").collect()
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert [tuple(r) for r in got] == [(*r, i + 1) for i, r in enumerate(want)]


def test_many_partitions_and_one_hot_key(spark):
    df = spark.range(0, 20000, 1, 11).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"), "id")
    got = with_rank(df, [F.col("k").asc(), F.col("id").desc()])
    want = sorted(((7 if i % 3 == 0 else i % 50, i) for i in range(20000)), key=lambda r: (r[0], -r[1]))
    assert [(r.k, r.id, r["rank"]) for r in got.orderBy("rank").collect()] == [(*r, i + 1) for i, r in enumerate(want)]
