"""Near-duplicate vectors and components against brute force."""

import numpy as np
import pytest

from veilspark.llm import near_vectors as nv
from veilspark.llm.graph import components


def brute(rows, threshold=0.98):
    """``{position: (links, component)}``."""
    def unit(v):
        if v is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        v = np.asarray(v, float)
        return v / np.linalg.norm(v)

    units, n = [unit(v) for _, v, _ in rows], len(rows)
    links = [[j for j in range(n) if j != i and units[i] is not None and units[j] is not None
              and len(units[i]) == len(units[j]) and rows[i][2] is not None and rows[i][2] == rows[j][2]
              and None not in (rows[i][0], rows[j][0]) and units[i] @ units[j] >= threshold] for i in range(n)]
    name, changed = [r[0] for r in rows], True
    while changed:
        changed = False
        for i in range(n):
            for j in links[i]:
                if name[j] < name[i]:
                    name[i], changed = name[j], True
    return [(len(links[i]), name[i]) for i in range(n)]


SCHEMA = "vec_id long, embedding array<float>, label int, links string, cid string"


def check(spark, rows, recall=1.0):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    stored = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    want = sorted(((i, *w, w[1] == i) for (i, _, _), w in zip(stored, brute(stored))), key=repr)
    got = sorted((tuple(r) for r in nv.near_vectors(df).collect()), key=repr)
    assert len(got) == len(want)
    assert sum(g[1] for g in got) >= recall * sum(w[1] for w in want)
    if recall == 1.0:
        assert got == want


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (9, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (7, [2.0, 0.01], 1), (4, [1.0, 0.0], 2), (5, [1.0, 0.0], None), (6, None, 1),
        (8, [], 1), (10, [0.0, 0.0], 1), (11, [1.0, None], 1), (12, [inf, 1.0], 1), (13, [nan, 1.0], 1), (14, [1.0, 0.0, 0.0], 1),
        (None, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (20, [0.0, 1.0], 1),
    ]
    check(spark, rows)
    assert nv.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("tile", [8, 1024])
def test_clusters(spark, monkeypatch, tile):
    monkeypatch.setattr(nv, "TILE", tile)
    rng, rows = np.random.default_rng(3), []
    for c in range(12):
        centre = rng.normal(size=32)
        for _ in range(1 + c * 4):
            rows.append((int(rng.integers(1, 1 << 40)), (centre + rng.normal(0, 0.05, 32)).tolist(), c % 2))
    check(spark, rows, 0.99)


def test_recall_on_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    want = {r[0]: w for r, w in zip(rows, brute(rows))}
    got = {r.vec_id: r for r in nv.near_vectors(df).collect()}
    assert all(got[k].n_links <= w[0] for k, w in want.items())
    assert sum(r.n_links for r in got.values()) >= 0.99 * sum(w[0] for w in want.values())


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 300), (300, 200), (7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100, 300: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
