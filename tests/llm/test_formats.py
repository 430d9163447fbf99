"""Chat formatting, WARC archives and token-id shards: exact round trips."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veilspark.llm import chat, token_ids, warc

# chat


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*chat.TEMPLATE["control"], "\\", "<", "[", "s>", "/s>", "a", "INST]", "\n"])).map("".join))
def test_escape_round_trip(text):
    escaped = chat.escaper(chat.TEMPLATE["control"])(text)
    assert chat.unescape(escaped) == text
    assert not any(c in escaped for c in chat.TEMPLATE["control"])


TURNS = "conv_id long, turn long, role string, text string, seq string"


def test_chat_segments(spark):
    rows = [
        (1, 0, "system", "be <s>kind</s>", "x"), (1, 1, "user", None, "x"), (1, 2, "assistant", "a\\b", "x"),
        (2, 0, "assistant", "first", "x"), (2, 1, "user", "", "x"), (2, 1, "user", "", "x"),
        (None, None, None, "lost", "x"), (3, 0, "user", "y" * 300_000, "x"), (3, 1, "assistant", "[INST]", "x"),
    ]
    segments = chat.format_turns(spark.createDataFrame(rows, TURNS)).cache()
    errors = {(r.conv_id, r.turn, r.error) for r in segments.where("error is not null").collect()}
    assert errors == {
        (2, 0, "assistant after start"), (2, 1, "user after user"), (2, 1, "unfinished"), (None, None, "no role after start"),
        (None, None, "unfinished"),
    }
    back = sorted(((r.conv_id or -1, r.turn_no, r.role, r.text, r.loss) for r in chat.read_turns(segments).collect()))
    assert back == sorted([
        (1, 0, "system", "be <s>kind</s>", False), (1, 1, "user", "", False), (1, 2, "assistant", "a\\b", True),
        (2, 0, "assistant", "first", True), (2, 1, "user", "", False), (2, 2, "user", "", False),
        (-1, 0, "", "lost", False), (3, 0, "user", "y" * 300_000, False), (3, 1, "assistant", "[INST]", True),
    ])
    learned = segments.where("loss").collect()
    assert {(r.conv_id, r.text) for r in learned} == {(1, "a\\\\b"), (2, "first"), (3, "[\\INST]")}


def test_chat_empty(spark):
    assert chat.read_turns(chat.format_turns(spark.createDataFrame([], TURNS))).count() == 0


# WARC

PAGES = "page_id long, url string, html string, payload string, original string"


def test_warc_round_trip(spark, tmp_path):
    same, long = "é" * 600, "z" * 400_000 + "\r\n\r\nWARC/1.1\r\n"
    rows = [
        (1, "http://a/\r\nX: y", same, "p", "o"), (5, "http://b", same, "p", "o"), (3, None, same, "p", "o"),
        (7, "http://c", "small", "p", "o"), (8, "http://d", "small", "p", "o"), (9, "http://e", None, "p", "o"),
        (10, "http://f", long, "p", "o"), (11, "http://g", long, "p", "o"), (11, "http://g", long, "p", "o"),
        (None, "http://h", same, "p", "o"),
    ]
    path = str(tmp_path / "w")
    warc.write_archives(warc.resolve_revisits(spark.createDataFrame(rows, PAGES)), path, records_per_file=2)
    got = sorted(
        ((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
         for r in warc.read_archives(spark, path).collect()), key=repr)
    def row(page, html, kind, to=None):
        raw = (html or "").encode()
        return page, len(raw), hashlib.sha1(raw).hexdigest(), kind, to
    assert got == sorted([
        row(1, same, "revisit", 5), row(5, same, "response"), row(3, same, "revisit", 5), row(0, same, "revisit", 5),
        row(7, "small", "response"), row(8, "small", "response"), row(9, None, "response"),
        row(10, long, "revisit", 11), row(11, long, "response"), row(11, long, "response"),
    ], key=repr)


def test_warc_empty(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write_archives(warc.resolve_revisits(spark.createDataFrame([], PAGES)), path)
    assert warc.read_archives(spark, path).count() == 0


# token ids

P = pytest.importorskip("public_tokenizers")
VOCABULARY = P.path("word_bpe_49k.json")
TEXTS = [
    None, "", " \t ", "Hello, World. it's <|endoftext|> <|ENDOFTEXT|> don't!!", "Ünïcode straße ÉÀ é İ Σας 漢字 123,45",
    "a b c\u0085d \x1c x", "x" * 5000 + " " + "Wort " * 30_000, "token = \"24be64439e3e\" 50%%% $$$ ª º ﬁ", "zz.;:!?|)))",
]


def test_encoder_equals_tokenizer():
    from tokenizers import Tokenizer
    import pyarrow as pa

    full = Tokenizer.from_file(VOCABULARY)
    bounds, ids = token_ids.Encoder(VOCABULARY, remember=4).texts(pa.array(TEXTS), 2)
    for i, text in enumerate(TEXTS):
        assert ids[bounds[i]:bounds[i + 1]].tolist() == [*full.encode(text or "", add_special_tokens=False).ids, 2]


def test_words_in_use_are_not_forgotten(monkeypatch):
    """A word seen again and again is encoded once, however many others come between."""
    coder, pieces = token_ids.Encoder(VOCABULARY, remember=8), []
    monkeypatch.setattr(coder, "_piece", lambda piece, old=coder._piece: pieces.append(piece) or old(piece))
    for n in range(60):
        coder.word("often")
        coder.word("x" + "abcdefghij"[n // 10] + "abcdefghij"[n % 10])
    assert pieces.count("often") == 1 and len(coder.known) <= 8 >= len(coder.earlier)
    for word in ("Heated$$$", "teatime%%%", "vié&&&", "Inre***", "touth###", "a$b", "x*#|)"):
        assert coder.word(word) == np.array(coder.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()


def test_memory_of_words_is_small(monkeypatch):
    """Workers keep their encoder after its stage: a word must not cost them hundreds of bytes."""
    import tracemalloc

    import pyarrow as pa

    letters = "abcdefghijklmnopqrst"
    words = [f"{a}{b}{c}{d}{mark}" for a in letters for b in letters for c in letters[:10] for d in letters for mark in ("u", "u,")]
    coder, pieces = token_ids.Encoder(VOCABULARY), []
    monkeypatch.setattr(coder, "_piece", lambda piece, old=coder._piece: pieces.append(0) or old(piece))
    arrow, texts = pa.total_allocated_bytes(), [pa.array([" ".join(words[i::2])]) for i in range(2)]
    tracemalloc.start()
    try:
        first = [coder.texts(t, 2)[1].tolist() for t in texts]
        again, n = [coder.texts(t, 2)[1].tolist() for t in texts], len(pieces)
        assert first == again and n <= len(words) + 1
        del first, again
        held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - arrow - sum(t.nbytes for t in texts)
    finally:
        tracemalloc.stop()
    assert held < 70 * len(words)


def test_words_in_use_outlast_others(monkeypatch):
    """Whole words: those of the last texts stay, however full the memory; the result is the tokenizer's."""
    import pyarrow as pa

    coder, asked = token_ids.Encoder(VOCABULARY, remember=8), []
    monkeypatch.setattr(coder, "word", lambda word, old=coder.word: asked.append(word) or old(word))
    for n in range(20):
        text = f"Often, other{'abcdefghij'[n % 10]}x {'long' * 40} 1{n} $$ " + "y" * n
        bounds, ids = coder.texts(pa.array([text, None]), 2)
        assert ids.tolist() == [*coder.tokenizer.encode(text, add_special_tokens=False).ids, 2, 2] and bounds.tolist() == [0, len(ids) - 1, len(ids)]
    assert asked.count("Often,") == 1 and asked.count("long" * 40) == 20 and len(coder.words) <= 8
    assert coder.texts(pa.array([], pa.string()), 2)[0].tolist() == [0]


def test_index_is_minimal_and_perfect():
    for n in (0, 1, 2, 7, 1000):
        keys = [str(k * 37).encode() for k in range(n)]
        _, _, slot = token_ids.build_index(keys)
        assert sorted(slot.tolist()) == list(range(n))
    shard = token_ids.Shard(token_ids.pack_shard(list(range(0, 3000, 3)), np.arange(1001), np.arange(1000)))
    assert [shard.find(k) for k in range(0, 3000, 3)] == list(range(1000))
    assert all(shard.find(k) is None for k in range(1, 3000, 3))


def test_token_shards(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = [(i * 5 % 9, t, "s") for i, t in enumerate(TEXTS)] + [(3, "again", "s"), (3, "again", "s"), (None, "no id", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    path = str(tmp_path / "t")
    token_ids.write_shards(token_ids.encode_shards(docs, VOCABULARY, end=2, shard_tokens=50, partitions=3), path)
    assert spark.read.parquet(path).count() > 4
    full, start, want = Tokenizer.from_file(VOCABULARY), 0, []
    for doc_id, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array([*full.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = [tuple(r) for r in token_ids.read_documents(spark, path).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    empty = str(tmp_path / "e")
    token_ids.write_shards(token_ids.encode_shards(docs.limit(0), VOCABULARY, end=2), empty)
    assert token_ids.read_documents(spark, empty).count() == 0
