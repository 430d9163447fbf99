"""Shingle groups against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.llm import jaccard


def shingles(text):
    found = re.findall("[^ \t-\r]+", re.sub("[A-Z]+", lambda m: m.group().lower(), text or ""))
    if len(found) < 5:
        return {tuple(found)} if found else set()
    return {tuple(found[i:i + 5]) for i in range(len(found) - 4)}


def brute(rows):
    sets = [shingles(t) if i is not None else set() for i, t in rows]
    name = [i for i, _ in rows]
    where = {}
    for k, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(k)
    links = {(a, b) for k in where.values() for a in k for b in k if a < b}
    links = [(a, b) for a, b in links if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    same = {}
    for k, i in enumerate(name):
        if i is not None:
            links.append((same.setdefault(i, k), k))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(name[a], name[b])
            if name[a] != low or name[b] != low:
                name[a] = name[b] = low
                changed = True
    return [(i, len(shingles(t)), name[k]) for k, (i, t) in enumerate(rows)]


def corpus(seed, groups=25):
    rng, rows = random.Random(seed), []
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    for g in range(groups):
        base = rng.choices(vocabulary, k=rng.choice([3, 6, 20, 80, 300]))
        for _ in range(rng.choice([1, 2, 5, 30])):
            text = list(base)
            for _ in range(rng.randrange(0, 1 + len(text) // 30)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            if rng.random() < 0.2:
                text.append(passage)
            rows.append(" ".join(text).upper() if rng.random() < 0.1 else " ".join(text))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,square", [(1, 512), (2, 4), (3, 16)])
def test_groups(spark, monkeypatch, seed, square):
    monkeypatch.setattr(jaccard, "SQUARE", square)
    texts = corpus(seed) + [None, "", " \n", "one", "one", "a b c d e", "A b\tc d e"]
    rows = [(k * 13 % 4001, t) for k, t in enumerate(texts)]
    rows += [(None, texts[0]), (None, None), (9000, "x " * 30_000 + "tail"), (9001, "x " * 30_000 + "tail end")]
    df = spark.createDataFrame([(i, t, "z", 0) for i, t in rows], "doc_id long, text string, items string, n int").repartition(5)
    got = sorted((tuple(r) for r in jaccard.shingle_groups(df).collect()), key=repr)
    assert got == sorted(brute(rows), key=repr)


def test_repeated_ids(spark):
    a, b, c = "one two three four five six seven", "eight nine ten eleven twelve thirteen", "words of nobody else at all"
    rows = [(5, a), (5, b), (3, b), (5, None), (5, c), (None, a), (None, None), (8, c), (9, a), (9, a), (7, "alone"), (7, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in jaccard.shingle_groups(df).collect()), key=repr)
    assert got == sorted(brute(rows), key=repr)
    assert {c for i, _, c in got if i in (3, 5, 8, 9)} == {3}


@pytest.mark.parametrize("percent", [50, 80, 100])
def test_bands(spark, percent):
    """Sets that may link are never two bands apart."""
    for at in range(1, 2000, 400):
        df = spark.range(at, at + 400).select("id", jaccard.band(F.col("id"), percent).alias("b"),
                                              jaccard.band(F.floor(F.col("id") * 100 / percent), percent).alias("far"))
        assert df.where("far - b > 1 or far < b").count() == 0


def test_tiles_of_many_sizes(spark, monkeypatch):
    """Texts that share a passage fall into one tile; copies of each size meet in its bands."""
    monkeypatch.setattr(jaccard, "SQUARE", 3)
    rng, rows = random.Random(8), []
    passage = [f"p{i}" for i in range(12)]
    for size in (4, 6, 9, 14, 22, 35, 60, 100):
        for _ in range(4):
            own = [f"v{rng.randrange(10**6)}" for _ in range(size)]
            for _ in range(rng.randrange(1, 4)):
                rows.append((len(rows), " ".join(passage + own + [f"end{rng.randrange(10**6)}"] * rng.randrange(0, 3))))
    got = sorted(tuple(r) for r in jaccard.shingle_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted(brute(rows))


def test_empty_table(spark):
    assert jaccard.shingle_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_packing_and_bounds():
    rng = np.random.default_rng(0)
    a, b = np.sort(rng.integers(0, 1 << 48, 500).astype(np.uint64)), rng.integers(0, 300, 500).astype(np.uint64)
    x, y = jaccard.unpack(jaccard.pack(jaccard.steps(a), b))
    assert (np.cumsum(x, dtype=np.uint64) == a).all() and (y == b).all()
    assert [len(v) for v in jaccard.unpack(jaccard.pack(a[:0], b[:0]))] == [0, 0]
    for _ in range(50):
        p, q = (np.unique(rng.integers(0, 400, rng.integers(1, 300))) for _ in range(2))
        differ = int(np.bitwise_count(jaccard.bitmap(p) ^ jaccard.bitmap(q)).sum())
        true = len(np.intersect1d(p, q))
        assert jaccard.exact_overlap(p, q) == true <= (len(p) + len(q) - differ) // 2


def test_memory_of_a_range_of_hashes():
    """Many workers share an executor: one range may take some dozens of bytes for each of its hashes, no more."""
    import tracemalloc

    import pyarrow as pa

    rng, n, blocks = np.random.default_rng(3), 40_000, 25
    sets = [(np.sort(rng.integers(0, 1 << 21, n).astype(np.uint64)), rng.integers(0, 900, n).astype(np.uint64)) for _ in range(blocks)]
    table = pa.table([pa.array([0] * blocks, pa.int32()), pa.array(range(blocks), pa.int64()), pa.array([b"x", None] * 12 + [None], pa.binary()),
                      pa.array([jaccard.pack(jaccard.steps(v), r) for v, r in sets], pa.binary())], names=["shard", "block", "docs", "items"])
    tracemalloc.start()
    try:
        got = jaccard._shared(table)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 60 * n * blocks
    values, counts = np.unique(np.concatenate([v for v, _ in sets]), return_counts=True)
    assert got.column("block").to_pylist() == list(range(blocks)) and got.column("docs").to_pylist() == table.column("docs").to_pylist()
    for (value, row), items in zip(sets, got.column("items").to_pylist()):
        times = counts[np.searchsorted(values, value)]
        kept = times > 1
        found = jaccard.unpack(items)
        assert (np.cumsum(found[0]) == value[kept]).all() and (found[1] == row[kept]).all() and (found[2] == times[kept]).all()
