"""Token ids of documents as binary shards with a minimal perfect hash index.

A shard holds the ids of consecutive documents as one raw array, and an index
from a document's key to its place: keys fall into buckets, each bucket stores a
displacement that sends its keys to distinct slots, and each slot stores a
fingerprint of its key and the document's number.  A lookup costs two hashes and
two array reads, whatever the size of the shard.

Documents are put in order of their id by one range shuffle; encoding, sharding
and indexing happen in the sorted partitions, one shard in memory at a time.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .words import slices, split

MAGIC = b"TOKIDX1\n"
_HEAD = struct.Struct("<8sIIIIQ")  # magic, documents, keys, buckets, seed, ids
SHARD = "part int, number int, documents long, tokens long, earlier long, content binary"
#: Runs of letters and marks that an encoder keeps in each of two generations.
PARTS = 1 << 14
#: Characters, or bytes, of the longest word that is kept.
LONGEST = 64
_LETTERS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?|)%$&*#]*)")


# encoding

def _byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Encoder:
    """Ids of whole texts, word by word, with a bounded memory of words.

    The vocabulary's pre-tokenizer never joins pieces across ASCII blanks, so the
    ids of a text are those of its blank-separated words one after another.  Most
    words are one run of Latin letters and perhaps some punctuation, which the
    pre-tokenizer separates; those go straight to the BPE model.  All others take
    the whole tokenizer.

    Words seen last are kept with their ids in Arrow arrays, *remember* at most and
    some 40 bytes each; runs of letters and marks that new words are made of are
    kept as objects, of which there are fewer.
    """

    def __init__(self, path: str, remember: int = 1 << 19):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.remember, self.parts, self.known, self.earlier = remember, min(remember, PARTS), {}, {}
        self.words, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())

    def _recall(self, part: str) -> bytes | None:
        """What is known of *part*; of two generations the older one is forgotten, parts in use pass to the newer."""
        found = self.known.get(part)
        if found is None:
            found = self.earlier.get(part)
            if found is not None:
                self._keep(part, found)
        return found

    def _keep(self, part: str, ids: bytes) -> None:
        if len(self.known) >= self.parts:
            self.earlier, self.known = self.known, {}
        self.known[part] = ids

    def _piece(self, piece: str) -> bytes:
        text = piece if piece.isascii() else "".join(self.letters[b] for b in piece.encode())
        return struct.pack(f"<{len(found := self.model.tokenize(text))}I", *[t.id for t in found])

    def _part(self, part: str) -> bytes:
        found = self._recall(part)
        if found is None:
            found = self._piece(part)
            if len(part) <= LONGEST:
                self._keep(part, found)
        return found

    def word(self, word: str) -> bytes:
        simple = _LETTERS.fullmatch(word)
        if not simple:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        letters = self._part(simple[1].lower())
        return letters + self._part(simple[2]) if simple[2] else letters

    def distinct(self, vocabulary: pa.Array) -> pa.Array:
        """The ids of each of these words, which differ, as bytes."""
        at = pc.index_in(vocabulary, value_set=self.words)
        new = at.is_null()
        missing = vocabulary.filter(new)
        found = pa.array((self.word(w) for w in missing.to_pylist()), pa.large_binary(), size=len(missing))
        at = at.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        used = np.zeros(len(self.words), bool)
        new = new.to_numpy(zero_copy_only=False)
        used[at[~new]] = True
        at[new] = len(self.words) + np.arange(len(missing))
        ids = pa.concat_arrays([self.ids, found]).take(pa.array(at))
        # words in use go first, so that the others are forgotten before them
        short = pc.less_equal(pc.binary_length(vocabulary), LONGEST)
        first = [c.filter(short)[:self.remember] for c in (vocabulary, ids)]
        idle = pa.array(np.flatnonzero(~used)[:self.remember - len(first[0])])
        self.words, self.ids = (pa.concat_arrays([c, old.take(idle)]) for c, old in zip(first, (self.words, self.ids)))
        return ids

    def texts(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """``(offsets, ids)`` of all texts, each closed by *end*; a null text is empty."""
        offsets, codes, vocabulary = split(texts, lower=False)
        pieces = pa.concat_arrays([self.distinct(vocabulary), pa.array([struct.pack("<I", end)], pa.large_binary())])
        closed = np.insert(codes, offsets[1:], len(pieces) - 1)
        _, ends, flat = pieces.take(pa.array(closed)).buffers()
        n = len(offsets) - 1
        bounds = np.frombuffer(ends, np.int64)[np.concatenate(([0], offsets[1:] + np.arange(1, n + 1)))] // 4
        return bounds, np.frombuffer(flat, "<u4", bounds[-1])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process; its memory of words serves later tasks too."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


# index

def _key(key: int | None) -> bytes:
    return b"" if key is None else str(key).encode()


def _mixed(value: int) -> int:
    value = ((value ^ (value >> 33)) * 0xFF51AFD7ED558CCD) & 0xFFFFFFFFFFFFFFFF
    return value ^ (value >> 29)


def _slot(value: int, displacement: int, slots: int) -> int:
    return _mixed((value + displacement * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) % slots


def build_index(keys: list[bytes], per_bucket: int = 4) -> tuple[int, np.ndarray, np.ndarray]:
    """``(seed, displacements, slot of each key)`` for distinct *keys*; every slot is used once.

    A negative displacement ``-s - 1`` sends the bucket's only key to slot ``s``.
    """
    n = len(keys)
    for seed in range(64):
        values = [xxhash.xxh3_64_intdigest(k, seed) for k in keys]
        if len(set(values)) == n:
            break
    else:
        raise ValueError("keys are not distinct")
    buckets = max(1, -(-n // per_bucket))
    members: list[list[int]] = [[] for _ in range(buckets)]
    for i, value in enumerate(values):
        members[_mixed(value) % buckets].append(i)
    displacement, slot, used = np.zeros(buckets, np.int32), np.zeros(n, np.int64), bytearray(n)
    free = n - 1
    for b in sorted(range(buckets), key=lambda b: -len(members[b])):
        own = members[b]
        if len(own) > 1:
            d = 0
            while True:
                places = [_slot(values[i], d, n) for i in own]
                if not any(used[p] for p in places) and len(set(places)) == len(places):
                    break
                d += 1
            displacement[b] = d
        elif own:
            while used[free]:
                free -= 1
            places, displacement[b] = [free], -free - 1
        else:
            continue
        for i, p in zip(own, places):
            slot[i], used[p] = p, 1
    return seed, displacement, slot


def pack_shard(keys: list[int | None], offsets: np.ndarray, ids: np.ndarray) -> bytes:
    """A shard of documents in order; a repeated key names its first document."""
    first: dict[bytes, int] = {}
    for i, key in enumerate(keys):
        first.setdefault(_key(key), i)
    names = list(first)
    seed, displacement, slot = build_index(names)
    fingerprint, document = np.zeros(len(names), "<u4"), np.zeros(len(names), "<u4")
    fingerprint[slot] = [xxhash.xxh32_intdigest(k) for k in names]
    document[slot] = list(first.values())
    listed = np.array([0 if k is None else k for k in keys], "<i8")
    width = "<u2" if not len(ids) or ids.max() < 1 << 16 else "<u4"
    present = np.array([k is not None for k in keys], "<u1")
    return b"".join((
        _HEAD.pack(MAGIC, len(keys), len(names), len(displacement), seed, len(ids)),
        displacement.astype("<i4").tobytes(), fingerprint.tobytes(), document.tobytes(), listed.tobytes(),
        present.tobytes(), np.asarray(offsets, "<u4").tobytes(), width.encode(), np.asarray(ids, width).tobytes(),
    ))


class Shard:
    """A shard's arrays, read in place."""

    def __init__(self, content):
        magic, self.documents, self.keys, buckets, self.seed, total = _HEAD.unpack_from(content)
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        at = _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(content, kind, n, at)
            at += out.nbytes
            return out

        self.displacement, self.fingerprint = take("<i4", buckets), take("<u4", self.keys)
        self.document, self.listed, self.present = take("<u4", self.keys), take("<i8", self.documents), take("<u1", self.documents)
        self.offsets = take("<u4", self.documents + 1)
        width = bytes(take("S3", 1)[0]).decode()
        self.ids = take(width, total)

    def find(self, key: int | None) -> int | None:
        """The number of the first document of *key*, in constant time; None if it isn't here."""
        if not self.keys:
            return None
        name = _key(key)
        value = xxhash.xxh3_64_intdigest(name, self.seed)
        d = int(self.displacement[_mixed(value) % len(self.displacement)])
        slot = -d - 1 if d < 0 else _slot(value, d, self.keys)
        return int(self.document[slot]) if self.fingerprint[slot] == xxhash.xxh32_intdigest(name) else None

    def tokens(self, document: int) -> np.ndarray:
        return self.ids[self.offsets[document]:self.offsets[document + 1]]

    def key(self, document: int) -> int | None:
        return int(self.listed[document]) if self.present[document] else None


# jobs

def encode_shards(
    docs: DataFrame, tokenizer: str, *, end: int, shard_tokens: int = 1 << 20, partitions: int | None = None,
) -> DataFrame:
    """Shards of ``docs(doc_id, text)`` in ascending ``doc_id``, null first; rows that repeat an id go by text.

    *tokenizer* is a path that every executor can open.  A shard holds about
    *shard_tokens* ids; a longer document has a shard of its own.  A null text is
    empty.  Other columns are dropped; an empty table gives no shard.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(SHARD))
    partitions = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        coder, part = encoder(tokenizer), TaskContext.get().partitionId()
        keys, ids, sizes, number, earlier = [], [], [], 0, 0

        def shard():
            nonlocal keys, ids, sizes, number, earlier
            flat = np.concatenate(ids)
            content = pack_shard(keys, np.concatenate(([0], np.cumsum(np.concatenate(sizes)))), flat)
            row = pa.RecordBatch.from_arrays(
                [pa.array([v], f.type) for v, f in zip((part, number, len(keys), len(flat), earlier, content), schema)],
                schema=schema)
            number, earlier = number + 1, earlier + len(flat)
            keys, ids, sizes = [], [], []
            return row

        held = 0
        for piece in slices(batches, "text", 8 << 20):
            bounds, flat = coder.texts(piece.column("text"), end)
            names, i = piece.column("doc_id").to_pylist(), 0
            while i < len(names):
                room = max(0, shard_tokens - held)
                j = int(np.searchsorted(bounds, bounds[i] + room, side="right")) - 1
                if j <= i:
                    if held:
                        yield shard()
                        held = 0
                        continue
                    j = i + 1
                keys += names[i:j]
                ids.append(flat[bounds[i]:bounds[j]])
                sizes.append(np.diff(bounds[i:j + 1]))
                held += int(bounds[j] - bounds[i])
                i = j
        if keys:
            yield shard()

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(partitions, "doc_id")
    return ordered.sortWithinPartitions("doc_id", "text").mapInArrow(run, SHARD)


def write_shards(shards: DataFrame, path: str) -> None:
    """Write shards to *path*, a row each, uncompressed so that arrays can be read in place."""
    shards.write.option("compression", "uncompressed").parquet(path)


def shard_starts(shards: DataFrame) -> DataFrame:
    """``part, before``: ids in all earlier partitions; one row for each partition of the writer."""
    totals = shards.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    earlier = F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return totals.select("part", F.coalesce(earlier, F.lit(0)).cast("long").alias("before"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the shards under *path*.

    Each id is looked up in its shard's index; rows that repeat an id follow the first.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ddl = "doc_id long, part int, inside long, n_tokens long, ids_crc32 long"
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, before, contents = (batch.column(c) for c in ("part", "earlier", "content"))
            for part, earlier, content in zip(parts.to_pylist(), before.to_pylist(), contents):
                shard, rows, last, again = Shard(content.as_buffer()), [], object(), 0
                for i in range(shard.documents):
                    key = shard.key(i)
                    again = again + 1 if key == last else 0
                    document, last = shard.find(key), key
                    if document is None or document + again != i:
                        raise ValueError(f"index of shard misses document {key}")
                    ids = shard.tokens(i)
                    rows.append((key, part, earlier + int(shard.offsets[i]), len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    shards = spark.read.parquet(path)
    rows = shards.select("part", "earlier", "content").mapInArrow(run, ddl)
    return rows.join(shard_starts(shards.select("part", "tokens")), "part").select(
        "doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
