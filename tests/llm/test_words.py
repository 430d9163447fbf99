"""Words and shingles of slices of Arrow batches."""

import re

import numpy as np
import pyarrow as pa

from veilspark.llm import words

TEXTS = ["Ünï  École\tÉa", None, "", " a B\x0bC d ", "x" * 40, "Straße " * 9, "é è ê \x1c y", "The END."]


def expected(text):
    return re.findall("[^ \t-\r]+", re.sub("[A-Z]+", lambda m: m.group().lower(), text or ""))


def test_split_of_slices():
    whole = pa.array(TEXTS * 50)
    for start in range(0, 60, 7):
        for length in (1, 5, 60):
            part = whole.slice(start, length)
            offsets, codes, vocabulary = words.split(part)
            names = vocabulary.to_pylist()
            got = [[names[c] for c in codes[a:b]] for a, b in zip(offsets, offsets[1:])]
            assert got == [expected(t) for t in part.to_pylist()]


def test_slices_keep_every_row():
    batch = pa.RecordBatch.from_arrays([pa.array(TEXTS), pa.array(range(len(TEXTS)))], names=["text", "n"])
    for limit in (1, 10, 1000):
        assert [n for piece in words.slices([batch], "text", limit) for n in piece.column("n").to_pylist()] == list(range(8))


def test_shingles():
    rows = [[1, 2, 3, 4, 5, 6], [], [1, 2, 3], [3], [1, 2, 3, 4, 5], [1, 2]]
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    row, value = words.shingles(offsets, np.array([x for r in rows for x in r], np.uint64), 5)
    got = {}
    for r, v in zip(row.tolist(), value.tolist()):
        got.setdefault(r, []).append(v)
    assert {r: len(v) for r, v in got.items()} == {0: 2, 2: 1, 3: 1, 4: 1, 5: 1}
    assert got[0][0] == got[4][0] and len({v for x in got.values() for v in x}) == 5
