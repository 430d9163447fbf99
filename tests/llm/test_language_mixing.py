"""Language identification by held-out accuracy, mixing by its definition."""

import math

import pyarrow as pa
import pytest

from veilspark.llm import language, mixing
from veilspark.llm.queries import op5_language

SF = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = op5_language(spark, SF).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and len(held) > 150
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_odd_texts(spark):
    samples = [("aa", "abab baba abab"), ("xx", "xyxy yxyx xxyy")] * 30
    net = language.train(samples, epochs=30, window=64)
    texts = [None, "", "123 !!", "abab baba", "XYXY yxyx", "xyxy " * 600_000, "é"]
    rows = spark.createDataFrame([(t, "l") for t in texts], "text string, lang string")
    got = [r.f for r in rows.select(language.detect(rows.text, net).alias("f")).collect()]
    assert [g.lang for g in got][:6] == ["und", "und", "und", "aa", "xx", "xx"]
    assert got[0].score == got[2].score == 0
    assert got[6].lang in ("aa", "xx")
    assert rows.limit(0).select(language.detect(rows.text, net)).count() == 0
    none = language.train([])
    assert {r.f.lang for r in rows.select(language.detect(rows.text, none).alias("f")).collect()} == {"und"}


def test_language_windows_cover_long_texts():
    net = language.train([("a", "abc"), ("b", "xyz")] * 10, epochs=2, window=32)
    old, text = language.PIECE, "abc xyz " * 100
    want = net.predict(pa.array([text, "q", text]))
    try:
        language.PIECE = 96
        got = net.predict(pa.array([text, "q", text]))
    finally:
        language.PIECE = old
    assert want[0].tolist() == got[0].tolist() and want[1] == pytest.approx(got[1])


def test_language_sample_is_bounded(spark):
    rows = [(i, "word " * (1 + i % 50), "en" if i % 5 else None) for i in range(3000)]
    got = language.training_windows(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_label=20, crops=2)
    assert len(got) == 40 and {g[0] for g in got} == {"en"}


DOCS = "doc_id long, text string, source string, target string, key string"


def brute_targets(sizes, rates=(1, 2, 3), epochs=3):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    rate = {s: rates[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * rate[s] / sum(rate[x] for x in free) for s in free}
        over = {s: epochs * sizes[s] for s in free if share[s] > epochs * sizes[s]}
        if not over:
            return {**capped, **share}
        capped |= over


def test_mixture(spark):
    rows = [(i, "w " * (1 + i % 7), ["a", "b", "é", None, "z"][min(i % 11, 4)], "t", "k") for i in range(600)]
    rows += [(600, None, "a", "t", "k"), (601, "", "empty", "t", "k"), (None, "x y", "b", "t", "k"), (5, "dup", "a", "t", "k"),
             (5, "dup", "a", "t", "k"), (700, "q " * 3000, "q", "t", "k")]
    docs = spark.createDataFrame(rows, DOCS)
    weights = spark.createDataFrame([(1, 3.0), (1, 2.0), (2, float("nan")), (3, None), (4, -1.0)], "doc_id long, weight double")
    got = mixing.mixture(docs, weights).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, text, source, *_ in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = brute_targets(sizes)
    taken = {}
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 3 * r.size
        taken.setdefault(r.source, []).append(r)
    for source, found in taken.items():
        largest = max(r.size for r in found)
        assert abs(sum(r.taken for r in found) - want[source]) <= largest / 2 + 1e-6
        assert len({r.passes for r in found}) <= 2  # whole epochs come first
    again = sorted(map(repr, mixing.mixture(docs.repartition(3), weights).collect()))
    assert again == sorted(map(repr, got))


def test_mixture_prefers_weight(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "'w' as text", "if(id < 2000, 'a', 'b') as source")
    weights = docs.selectExpr("doc_id", "if(doc_id % 2 = 0, 4.0, 1.0) as weight")
    rows = mixing.mixture(docs, weights).where("source = 'a'").collect()
    extra = {r.doc_id: r.passes - min(x.passes for x in rows) for r in rows}
    heavy, light = (sum(v for k, v in extra.items() if k % 2 == p) for p in (0, 1))
    assert heavy > 1.5 * light > 0
    assert math.isclose(sum(r.taken for r in rows), rows[0].target, abs_tol=1)


def test_mixture_empty(spark):
    assert mixing.mixture(spark.createDataFrame([], DOCS)).count() == 0
