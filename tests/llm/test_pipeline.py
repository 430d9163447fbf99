"""The pipeline against a plain version of its stages."""

import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from veilspark.llm import mixing, queries

from .test_jaccard import brute

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    from tokenizers import Tokenizer

    documents = spark.read.parquet(f"{SF}/documents.parquet")
    items = [r.text.lower().split() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    odd = [(10**6, "123 !!", "en", "s", 6), (10**6 + 1, None, "en", "s", 0), (10**6 + 2, documents.first().text, "en", "s", 1),
           (10**6 + 3, "Le la " + " ".join(items[0]) + " et un", "fr", "s", 1)]
    docs = documents.union(spark.createDataFrame(odd, documents.schema))
    all_rows = docs.collect()

    kept = [r for r in all_rows if re.search(r"[^\W\d_]", r.text or "")]
    got = corpus_pipeline.identify_language(spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in kept)

    groups = brute([(r.doc_id, r.text) for r in kept])
    kept = [r for r, (i, _, c) in zip(kept, groups) if i == c]
    got = corpus_pipeline.drop_near_duplicates(spark, got, SF)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, kept))

    def leaked(text):
        words = [w.strip(".,") for w in text.lower().split()]
        return any(" ".join(w.strip(".,") for w in item) in " ".join(words) for item in items)

    kept = [r for r in kept if not leaked(r.text)]
    got = corpus_pipeline.drop_leaks(spark, got, SF)
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in kept)

    mixed = mixing.mixture(got, queries.quality_weights(spark, SF)).collect()
    passes = {r.doc_id: r.passes for r in mixed}
    kept = sorted((r for r in kept for _ in range(passes[r.doc_id])), key=lambda r: r.doc_id)
    got = corpus_pipeline.mix_sources(spark, got, SF)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, kept))

    coder, start, want = Tokenizer.from_file(P.path("word_bpe_49k.json")), 0, []
    for r in kept:
        ids = np.array([*coder.encode(r.text, add_special_tokens=False).ids, 2], "<u4")
        want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = corpus_pipeline.write_token_ids(spark, got, SF)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == want


A, B = "one two three four five six seven eight", "nine ten eleven twelve thirteen fourteen fifteen"
CLASHING = "doc_id long, text string, lang string, source string, n_chars long, row string, found int, key long, number int, doc string"


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, "r", 2, k, 3, "d") for k, (i, t) in enumerate(rows)], CLASHING)


def test_near_duplicates_by_row(spark):
    """Repeated and null ids: no text goes for its namesake, none stays twice."""
    rows = [(5, A), (5, B), (3, B), (None, A + " x"), (None, A + " x"), (None, None), (7, ""), (7, ""), (2, "alone here"), (2, "other text")]
    docs = rows_of(spark, rows)
    got = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert got.columns == docs.columns
    got = got.collect()
    texts = sorted((r.text or "") for r in got)
    near = [t for t in texts if t.startswith("one two")]
    assert len(near) == 1 and {r.doc_id for r in got if r.text == B} == {3}  # 4 of 5 shingles are shared: a link
    assert texts.count(B) == 1 and texts.count("") == 3 and "alone here" in texts and "other text" in texts
    assert len(got) == len({r.key for r in got})
    again = corpus_pipeline.drop_near_duplicates(spark, rows_of(spark, [(1 << 62, A), (1 << 62, B), (None, B), (-4, A)]), SF).collect()
    assert sorted(r.text for r in again) == sorted([A, B])


def test_stages_on_odd_tables(spark):
    """Every stage takes an empty table, and one with null ids, repeated rows and clashing names."""
    french = "le chat est sur la table et il mange le pain de la maison avec les enfants"
    odd = rows_of(spark, [(None, french), (4, french + " un"), (4, french + " un"), (4, None), (9, "")])
    for docs in (odd.limit(0), odd):
        for name, stage in corpus_pipeline.STAGES[1:]:
            got = stage(spark, docs, SF)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert got.columns == docs.columns
            n = got.count()
            assert n == 0 if docs is not odd else n > 0


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 50


def test_mix_takes_repeated_rows(spark):
    rows = [(1, "a b", "s", None), (1, "a b", "s", None), (None, "c", None, "x"), (2, "d e f", "t", "y"), (3, None, "t", "z")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _n string")
    want = {}
    for r in mixing.mixture(docs).collect():
        key = (r.doc_id, r.source, r.size)
        want[key] = want.get(key, 0) + r.passes
    got = {}
    for r in mixing.take(docs).collect():
        key = (r.doc_id, r.source, len((r.text or "").split()))
        got[key] = got.get(key, 0) + 1
    assert got == {k: v for k, v in want.items() if v}
