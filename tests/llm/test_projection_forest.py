"""The forest search against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.llm import projection_forest as pf

SCHEMA = "vec_id long, embedding array<float>, wanted string, ids int, qid string"


def brute(rows, k, width):
    """Every row counts for itself; a query leaves out one row of its own."""
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and len(v) == width
            and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for n, (q, v) in enumerate(good):
        if q % 20 == 0:
            near = sorted((-float(v @ w), i) for m, (i, w) in enumerate(good) if m != n)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(near)]
    return sorted(out)


def search(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(3)
    stored = [(r.vec_id, r.embedding) for r in df.collect()]
    got = pf.nearest(df, F.col("vec_id") % 20 == 0, **options)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(tuple(r) for r in got.collect()), stored


def same(got, want):
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=0, atol=1e-12)


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (0, [1.0, 0.0]), (20, [3.0, 4.0]), (20, [3.0, 4.0]), (40, [-1.0, -1.0]), (3, [1.0, 0.0]), (2, [1.0, 0.0]), (7, [100.0, -1.0]),
        (60, None), (80, []), (100, [0.0, 0.0]), (120, [1.0, None]), (140, [inf, 1.0]), (160, [nan, 1.0]), (180, [1.0, 2.0, 3.0]),
        (None, [1.0, 0.0]), (5, [0.5, 0.5]), (-20, [0.5, 0.5]), (9, [-2.0, 0.25]), (20, [1.0, 0.0]),
    ]
    for k in (3, 20):
        got, stored = search(spark, rows, k=k)
        same(got, brute(stored, k, 2))
    assert search(spark, [])[0] == []
    assert search(spark, [(0, None), (None, [1.0])])[0] == []
    assert search(spark, [(1, [1.0, 2.0])])[0] == []
    assert search(spark, [(0, [1.0, 2.0])])[0] == []


@pytest.mark.parametrize("shelf, work", [(1 << 14, 1 << 29), (24, 100)])
def test_exact_when_all_neighbours_are_wanted(spark, monkeypatch, shelf, work):
    """Queries are all probed, so the bound takes in every true neighbour; a third of all rows is one vector."""
    monkeypatch.setattr(pf, "SHELF", shelf)
    monkeypatch.setattr(pf, "WORK", work)
    rng = np.random.default_rng(7)
    hot = rng.normal(size=8).tolist()
    rows = [(i, hot) for i in range(200)] + [(1000 + i, (rng.normal(size=8) * rng.uniform(0.5, 2)).tolist()) for i in range(400)]
    got, stored = search(spark, rows, k=7, leaf_rows=32, recall=1.0)
    same(got, brute(stored, 7, 8))


def test_recall_on_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = pf.nearest(df, F.col("vec_id") % 20 == 0).collect()
    stored = [(r.vec_id, r.embedding) for r in df.collect()]
    want = {(q, i) for q, _, i, _ in brute(stored, 20, 64)}
    assert len(got) == len(want) == len({(r.query_id, r["rank"]) for r in got})
    assert len({(r.query_id, r.vec_id) for r in got} & want) >= 0.9 * len(want)


def test_shared_queue_takes_leaves_in_order():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 6))
    forest = pf.fit(x, np.sqrt((x * x).sum(axis=1)).max(), trees=3, leaf=20, seed=1)
    place = forest.leaf_of(x)
    assert place.shape == (600, 3) and len(np.unique(place)) == forest.leaves
    assert [place[:, t].min() for t in range(3)] == forest.starts
    sizes = np.bincount(place.ravel(), minlength=forest.leaves)
    assert sizes.max() <= 20
    q = rng.normal(size=(5, 6))
    near = forest.priorities(q)
    for row, margins in zip(near, forest.margins(q).tolist()):
        for bound in (-0.2, 0.0, 0.1):
            got = forest.visit(margins, bound, sizes.tolist(), 0)
            assert set(got) == set(np.flatnonzero(row >= bound)) and len(got) == len(set(got))
            assert (np.diff(row[got]) <= 0).all()
        assert sizes[forest.visit(margins, np.inf, sizes.tolist(), 30)].sum() >= 30


def test_shelves_hold_one_tree():
    sizes, visits = np.array([5, 6, 30, 2, 4, 9, 9]), np.array([1, 1, 9, 0, 1, 2, 3])
    shelves = pf.arrange(sizes, visits, [0, 4], 10, 20)
    assert shelves.over.tolist() == [1, 1, 3, 1, 1, 1, 1]
    taken = [set(range(f, f + o)) for f, o in zip(shelves.first, shelves.over)]
    assert not set.union(*taken[:4]) & set.union(*taken[4:])
    assert not taken[2] & set.union(*taken[:2], taken[3])
    assert shelves.copies[2] == 5 and shelves.copies[0] == 1
