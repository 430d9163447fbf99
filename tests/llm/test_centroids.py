"""Heap-ordered k-means against plain rounds in Python's own integers."""

import hashlib
import math

import numpy as np
import pytest

from veilspark.llm import centroids, lattice

SCHEMA = "vec_id long, embedding array<double>, cluster string, distance int, keys string"


def floors(v):
    top = lattice.largest(len(v))
    return [max(-top, min(top, math.floor(256 * x))) for x in v]


def away(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def brute(rows, k, rounds, width):
    kept = [(i, v) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: hashlib.sha256(f"2:{i}".encode()).hexdigest() if i is not None else "z"
    centres = [floors(v) for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]
    points = [floors(v) for _, v in kept]
    for turn in range(rounds + 1):
        own = [min(range(len(centres)), key=lambda c: (away(x, centres[c]), c)) for x in points]
        if turn < rounds:
            for c in range(len(centres)):
                mine = [x for x, o in zip(points, own) if o == c]
                if mine:
                    centres[c] = [sum(col) // len(mine) for col in zip(*mine)]
    d = [away(x, centres[o]) for x, o in zip(points, own)]
    per = [sum(y for y, o in zip(d, own) if o == c) for c in range(len(centres))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    short = lambda x: x if x < 1 << 63 else None
    return sorted(((i, o, y, short(per[o]), short(sum(d)), sha[o]) for (i, _), o, y in zip(kept, own, d)), key=repr)


def check(spark, rows, k=5, rounds=4, width=3):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(3)
    got = centroids.clusters(df, clusters=k, rounds=rounds, width=width)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, k, rounds, width)


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (1, [0.0, 0.0, 0.0]), (2, [0.0, 0.0, 0.0]), (2, [0.0, 0.0, 0.0]), (2, [1.0, 0.5, -0.5]), (3, None), (4, []), (5, [1.0, 2.0]),
        (6, [nan, 1.0, 1.0]), (7, [inf, 1.0, 1.0]), (8, [1.0, None, 1.0]), (None, [0.25, 0.25, 0.25]), (None, [0.5, 0.25, 0.25]),
        (9, [-0.001, 0.001, 1e-9]), (10, [1e30, -1e30, 1e30]), (11, [1.0, 1.0, 1.0]), (12, [2.0, 2.0, 2.0]),
    ]
    check(spark, rows)
    check(spark, rows, k=40)
    check(spark, rows, k=1)
    check(spark, [], k=3)
    check(spark, [(1, None)], k=3)


def test_ties_between_centroids(spark):
    """Points half way between centroids, on a grid: the smaller number wins in every round."""
    rows = [(i, [float(i % 5) / 256, float(i // 5 % 4) / 256, 0.0]) for i in range(60)]
    for k in (2, 7, 20):
        check(spark, rows, k=k)


@pytest.mark.parametrize("block", [7, 4096])
def test_many_rounds(spark, monkeypatch, block):
    monkeypatch.setattr(lattice, "BLOCK", block)
    rng = np.random.default_rng(5)
    hot = [(i, [0.5, 0.5, 0.5, 0.5]) for i in range(100)]  # a third of all rows is one vector
    rows = hot + [(1000 + i, (rng.integers(0, 3, 4) + rng.normal(0, 0.1, 4)).tolist()) for i in range(200)]
    check(spark, rows, k=9, rounds=8, width=4)


def test_only_expired_gaps_are_rescanned():
    """Vectors close to their centroids stay on their heaps while centroids barely move."""
    rng = np.random.default_rng(1)
    x = np.concatenate([c + rng.integers(-20, 20, (200, 8)) for c in (0, 4000, 9000)])
    centres = np.array([[0] * 8, [4000] * 8, [9000] * 8])
    heaps = centroids._Heaps(x, [[], [], []], np.zeros((3, 9), np.int64))
    heaps.enter(np.arange(600), centres, np.zeros(3))
    near = centres + [[3], [0], [-5]]
    spent = centroids._spent(np.zeros(3), centres, near)
    assert heaps.rescan(near, spent) == 0
    far = near + [[4100], [0], [0]]
    assert 0 < heaps.rescan(far, centroids._spent(spent, near, far)) <= 400
    cluster = np.empty(600, int)
    for c, heap in enumerate(heaps.heaps):
        cluster[[p for _, p in heap]] = c
    assert (cluster == lattice.distances(x, far).argmin(axis=1)).all()


def test_distances_are_exact():
    rng = np.random.default_rng(2)
    for top in (100, 1 << 20, lattice.largest(64)):
        x, c = rng.integers(-top, top, (9, 64)), rng.integers(-top, top, (5, 64))
        assert lattice.distances(x, c).tolist() == [[away(a, b) for b in c.tolist()] for a in x.tolist()]


def test_too_many_centroids(spark):
    with pytest.raises(ValueError, match="centroids"):
        centroids.clusters(spark.createDataFrame([], SCHEMA), clusters=1 << 20)
