"""Product codes against plain Lloyd rounds in Python's own integers."""

import hashlib

import numpy as np
import pytest

from veilspark.llm import lattice, part_codes

from .test_centroids import away, floors

SCHEMA = "vec_id long, embedding array<double>, label int, code string, error int"


def brute(rows, parts, entries, rounds, width):
    kept = [r for r in rows if r[1] is not None and len(r[1]) == width and all(x is not None and np.isfinite(x) for x in r[1])]
    cut = lambda v: [v[i:i + width // parts] for i in range(0, width, width // parts)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [list(col) for col in zip(*(cut(floors(v)) for _, v, _ in first))]
    xs = [cut(floors(v)) for _, v, _ in kept]
    for turn in range(rounds + 1):
        codes = [[min(range(len(b)), key=lambda e: (away(w, b[e]), e)) for w, b in zip(x, books)] for x in xs]
        if turn < rounds:
            for p, book in enumerate(books):
                for e in range(len(book)):
                    mine = [x[p] for x, c in zip(xs, codes) if c[p] == e]
                    if mine:
                        book[e] = [sum(col) // len(mine) for col in zip(*mine)]
    error = [sum(away(w, b[e]) for w, b, e in zip(x, books, c)) for x, c in zip(xs, codes)]
    total = {}
    for (_, _, label), e in zip(kept, error):
        total[label] = total.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{e:02x}" for e in c), y, total[label] if total[label] < 1 << 63 else None, sha)
                   for (i, _, label), c, y in zip(kept, codes, error)), key=repr)


def check(spark, rows, parts=2, entries=4, rounds=3, width=4):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    got = part_codes.part_codes(df, parts=parts, entries=entries, rounds=rounds)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, parts, entries, rounds, width)


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (5, [0.0, 0.0, 0.0, 0.0], 1), (5, [0.0, 0.0, 0.0, 0.0], 1), (5, [1.0, 0.0, 0.0, 0.0], None), (3, [0.0, 0.0, 1.0, 1.0], None),
        (1, None, 1), (0, [], 1), (2, [1.0, 2.0], 2), (6, [nan, 1.0, 1.0, 1.0], 1), (7, [inf, 1.0, 1.0, 1.0], 1),
        (8, [None, 1.0, 1.0, 1.0], 1), (None, [0.5, -0.5, 0.25, 0.0], 2), (9, [1e30, -1e30, 0.0, -1e-9], 3), (10, [0.1] * 4, 2),
    ]
    rows[6] = (2, [1.0, 2.0, 3.0], 2)  # three components have no two equal parts
    check(spark, rows)
    check(spark, rows, entries=256)
    check(spark, rows, entries=1)
    check(spark, [])
    check(spark, [(1, None, 1)])


@pytest.mark.parametrize("block", [5, 4096])
def test_ties_and_hot_rows(spark, monkeypatch, block):
    monkeypatch.setattr(lattice, "BLOCK", block)
    rng = np.random.default_rng(4)
    hot = [(i, [0.5, 0.5, 0.25, 0.25], 1) for i in range(70)]
    rows = hot + [(100 + i, (rng.integers(0, 4, 4) / 256).tolist(), int(rng.integers(0, 3))) for i in range(140)]
    check(spark, rows, entries=8, rounds=6)


def test_active_entries_give_full_scans():
    rng = np.random.default_rng(6)
    x, book = rng.integers(-8, 8, (500, 3)), rng.integers(-8, 8, (20, 3))
    code, away_ = np.zeros(500, np.int64), np.zeros(500, np.int64)
    part_codes.rescan(x, book, np.ones(20, bool), code, away_)
    for moves in (3, 1, 0, 20):
        new = book.copy()
        new[rng.choice(20, moves, replace=False)] += rng.integers(-2, 3, (moves, 3))
        moved = (new != book).any(axis=1)
        took = part_codes.rescan(x, new, moved, code, away_)
        d = lattice.distances(x, new)
        assert (code == d.argmin(axis=1)).all() and (away_ == d.min(axis=1)).all()
        assert took < 500 * 20 or moved.all()
        book = new


def test_unequal_parts(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0], 1, "x", 1)], SCHEMA)
    with pytest.raises(ValueError, match="equal parts"):
        part_codes.part_codes(df, parts=2, width=3)
