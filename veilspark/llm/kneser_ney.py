"""Score texts with an interpolated modified Kneser-Ney bigram model.

Counting and scoring are spread by context.  The vocabulary is a sorted array of
word hashes with training counts; executors fetch it through Spark and their
workers map it into memory to turn words into numbers.  Bigrams travel as packed
arrays to the shard of their context, where sorted arrays of bigrams give counts,
discounts and probabilities; a frequent context is spread over all shards by its
next word and its totals are added up.  Shards answer with sums per document.

The unigram level uses continuation counts, also mapped, interpolated with the
uniform distribution over the vocabulary and one unknown word.
"""

from __future__ import annotations

import fcntl
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.staging import stage
from . import words
from .jaccard import pack, steps, unpack

#: A blank is never part of a word, so no word has this hash.
END = np.uint64(xxhash.xxh3_64_intdigest("\n"))
UNKNOWN = 0
#: Shards for each shuffle partition: a shard's arrays take some tens of megabytes while it is scored.
SHARDS = 2
#: A context that would fill more than one in so many parts of a shard is spread by its next word.
FREQUENT = 2
#: Words in a range of continuation counts, at least.
RANGE_WORDS = 1 << 18


# arrays that workers map into memory

def publish(df: DataFrame) -> list[str]:
    """Hand the files of a written table to all executors; returns their names in order."""
    files = sorted(df.inputFiles())
    for file in files:
        df.sparkSession.sparkContext.addFile(file)
    return [f.rsplit("/", 1)[-1] for f in files]


def mapped(tag: str, names: list[str], build) -> list[np.ndarray]:
    """The arrays that *build* makes of the published files *names*, read through memory maps.

    One worker of an executor writes them as raw arrays next to the files, which it then removes.
    """
    root = SparkFiles.getRootDirectory()
    done = os.path.join(root, f"{tag}.done")
    with open(os.path.join(root, f"{tag}.lock"), "w") as lock:
        fcntl.flock(lock, fcntl.LOCK_EX)
        if not os.path.exists(done):
            paths = [os.path.join(root, n) for n in names]
            made = build([pq.ParquetFile(p) for p in paths])
            for k, array in enumerate(made):
                np.save(os.path.join(root, f"{tag}-{k}.npy"), array)
            with open(done, "w") as f:
                f.write(str(len(made)))
            for path in paths:
                os.remove(path)
        with open(done) as f:
            count = int(f.read())
    return [np.load(os.path.join(root, f"{tag}-{k}.npy"), mmap_mode="r") for k in range(count)]


def _vocabulary_arrays(files) -> list[np.ndarray]:
    tables = [f.read(columns=["word", "n"]) for f in files]
    word = np.concatenate([np.asarray(t.column("word")) for t in tables] or [np.zeros(0, np.int64)])
    count = np.concatenate([np.asarray(t.column("n")) for t in tables] or [np.zeros(0, np.int64)])
    order = np.argsort(word, kind="stable")
    small = not len(count) or count.max() < 1 << 32
    return [word[order], count[order].astype(np.uint32 if small else np.int64)]


def _continuation_arrays(size: int, width: int):
    def build(files) -> list[np.ndarray]:
        out = np.zeros(size, np.uint32)
        for file in files:
            for r, counts in zip(*(c.to_pylist() for c in file.read(columns=["range", "counts"]).columns)):
                part = np.frombuffer(counts, "<u4")[:size - r * width]
                out[r * width:r * width + len(part)] = part
        return [out]

    return build


# counting words

def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(offsets, hashes)`` of words, each text closed by the end token."""
    offsets, codes, vocabulary = words.split(texts)
    hashed = np.append(words.hashes(vocabulary), END)
    closed = np.insert(codes, offsets[1:], len(hashed) - 1)
    return offsets + np.arange(len(offsets)), hashed[closed]


def count_words(docs: DataFrame) -> DataFrame:
    """``word, n``: how often each token occurs in the rows of ``docs(text, train)`` marked for training."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged():
            word = np.concatenate([h[0] for h in held])
            order = np.argsort(word, kind="stable")
            word, n = word[order], np.concatenate([h[1] for h in held])[order]
            first = np.flatnonzero(np.diff(word, prepend=~word[:1]))
            return word[first], np.add.reduceat(n, first) if len(first) else n

        def batch_of(word, n):
            return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])

        for piece in words.slices(batches, "text"):
            _, tokens = _tokens(piece.filter(piece.column("train")).column("text"))
            if not len(tokens):
                continue
            held.append(np.unique(tokens, return_counts=True))
            size += len(held[-1][0])
            if size > 1 << 21:
                held = [merged()]
                size = len(held[0][0])
                if size > 1 << 20:
                    yield batch_of(*held[0])
                    held, size = [], 0
        if held:
            yield batch_of(*merged())

    return docs.select("text", "train").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


# bigrams to the shards of their contexts

MESSAGE = "shard int, block long, docs binary, items binary"


def _bigrams(docs: DataFrame, vocabulary: list[str], tag: str, shards: int, frequent: np.ndarray, start: int) -> DataFrame:
    def run(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, counts = mapped(tag, vocabulary, _vocabulary_arrays)
        part, number = TaskContext.get().partitionId(), 0
        for piece in words.slices(batches, "text"):
            offsets, codes, names = words.split(piece.column("text"))
            hashed = np.append(words.hashes(names), END).view(np.int64)
            at = np.minimum(np.searchsorted(known, hashed), max(0, len(known) - 1))
            hit = known[at] == hashed if len(known) else np.zeros(len(hashed), bool)
            number_of = np.where(hit, at + 1, UNKNOWN)
            count_of = np.where(hit, counts[at] if len(known) else 0, 0).astype(np.float64)
            closed = np.insert(codes, offsets[1:], len(hashed) - 1)
            offsets = offsets + np.arange(len(offsets))
            token = number_of[closed].astype(np.uint64)
            row = np.repeat(np.arange(piece.num_rows), np.diff(offsets))
            context = np.empty_like(token)
            context[1:] = token[:-1]
            context[offsets[:-1]] = start
            train = np.asarray(piece.column("train")).astype(np.uint64)
            base = np.bincount(row, np.log10(count_of + 1)[closed], piece.num_rows)
            n_known = np.bincount(row, hit[closed], piece.num_rows)
            spread = np.isin(number_of, frequent)
            spread_context = np.empty(len(token), bool)
            spread_context[1:] = spread[closed][:-1]
            spread_context[offsets[:-1]] = True
            shard = words.mix(np.where(spread_context, words.mix(context) ^ token, context)) % np.uint64(shards)
            order = np.argsort((context << np.uint64(32)) | token)
            order = order[np.argsort(shard[order].astype(np.uint16 if shards < 1 << 16 else np.uint32), kind="stable")]
            shard, context, token = shard[order], context[order], token[order]
            flagged = row[order].astype(np.uint64) * np.uint64(2) + train[row[order]]
            bounds = np.searchsorted(shard, np.arange(shards + 1, dtype=np.uint64))
            block = (part << 24) + number
            number += 1
            ids = piece.column("doc_id")
            about = pack(
                np.asarray(ids.fill_null(0)).astype(np.int64).view(np.uint64), np.asarray(ids.is_valid()).astype(np.uint64),
                np.asarray(piece.column("held")).astype(np.uint64), np.diff(offsets).astype(np.uint64), n_known.astype(np.uint64),
                base.view(np.uint64))
            rows = []
            for s in range(shards):
                a, b = bounds[s], bounds[s + 1]
                if a < b or s == block % shards:
                    rows.append((s, block, about if s == block % shards else None,
                                 pack(steps(context[a:b]), token[a:b], flagged[a:b])))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))],
                names=["shard", "block", "docs", "items"])

    return docs.select("doc_id", "text", "train", "held").mapInArrow(run, MESSAGE)


# shards: counts first, then probabilities

COUNTED = "kind int, shard int, a long, b long, n1 long, n2 long, n3 long, n4 long, content binary"
SHARD, RANGE, CONTEXT, DOCS = 0, 1, 2, 3


def _table(rows: list[tuple]) -> pa.Table:
    kinds = [("kind", pa.int32()), ("shard", pa.int32()), *((c, pa.int64()) for c in ("a", "b", "n1", "n2", "n3", "n4")),
             ("content", pa.binary())]
    return pa.table([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)], names=[c for c, _ in kinds])


def _levels(counts: np.ndarray) -> list[int]:
    """How many counts are 1, 2, 3 and 4."""
    return [int(np.count_nonzero(counts == k)) for k in (1, 2, 3, 4)]


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(first index, length)`` of each run of equal values."""
    first = np.flatnonzero(np.diff(sorted_values, prepend=~sorted_values[:1]))
    return first, np.diff(np.append(first, len(sorted_values)))


def _count_shard(frequent: np.ndarray, width: int):
    """One shard: its sorted bigrams with training counts, whom they belong to, and what others must know."""
    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        blocks, docs = table.column("block").to_pylist(), table.column("docs").to_pylist()
        parts = [unpack(x) for x in table.column("items").to_pylist()]
        key = np.concatenate([(np.cumsum(p[0], dtype=np.uint64) << np.uint64(32)) | p[1] for p in parts])
        flagged = np.concatenate([p[2] for p in parts])
        origin = np.repeat(np.arange(len(parts), dtype=np.uint32), [len(p[0]) for p in parts])
        del parts
        rows = [(DOCS, shard, block, None, None, None, None, None, about) for block, about in zip(blocks, docs) if about is not None]
        if len(key):
            order = np.argsort(key, kind="stable")
            key, flagged, origin = key[order], flagged[order], origin[order]
            del order
            first, length = _runs(key)
            count = np.add.reduceat((flagged & np.uint64(1)).astype(np.int64), first)
            distinct = key[first]
            del key
            index = np.repeat(np.arange(len(first), dtype=np.uint32), length)
            context = distinct >> np.uint64(32)
            seen = count > 0
            rows.append((SHARD, shard, None, None, *_levels(count), _join_blobs(
                pack(steps(context), distinct & np.uint64(0xFFFFFFFF), count.astype(np.uint64)),
                pack(steps(index.astype(np.uint64)), origin, flagged >> np.uint64(1)), pack(np.array(blocks, np.int64).view(np.uint64)))))
            # continuation counts: each distinct bigram of the training texts counts once for its second word
            word, times = np.unique((distinct & np.uint64(0xFFFFFFFF))[seen], return_counts=True)
            part = word // np.uint64(width)
            for a, n in zip(*_runs(part)):
                rows.append((RANGE, shard, int(part[a]), None, None, None, None, None,
                             pack(steps(word[a:a + n]), times[a:a + n].astype(np.uint64))))
            begin, size = _runs(context)
            for k in np.flatnonzero(np.isin(context[begin], frequent)):
                a, n = begin[k], size[k]
                c = count[a:a + n]
                rows.append((CONTEXT, shard, int(context[a]), int(c.sum()), *_levels(c)[:2], int((c > 2).sum()), None, None))
        out = _table(rows)
        del rows
        words.give_back()
        return out

    return run


def _join_blobs(*blobs: bytes) -> bytes:
    return b"".join(np.uint64(len(b)).tobytes() + b for b in blobs)


def _split_blobs(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        size = int(np.frombuffer(data, "<u8", 1, at)[0])
        out.append(data[at + 8:at + 8 + size])
        at += 8 + size
    return out


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts 1, 2, and 3 or more.

    Where a count of counts is zero, the discounts are those of a small sample: half of 1, 1 and 1.5.
    """
    if 0 in (n1, n2, n3, n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.05), k) for k, d in enumerate(found, 1))


def discounted(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    """What a count keeps."""
    counts = counts.astype(np.float64)
    return np.maximum(counts - np.array([0.0, *d])[np.minimum(counts, 3).astype(np.int64)], 0)


def _score_shard(frequent: dict[int, tuple[float, float]], lower, d2: tuple[float, float, float], start: int):
    """Log-probabilities of a shard's bigrams, summed for each document; *lower* gives unigram probabilities."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        unigram = lower()
        for batch in batches:
            for content in batch.column("content"):
                bigrams, instances, blocks = map(unpack, _split_blobs(content.as_py()))
                context, word, count = np.cumsum(bigrams[0], dtype=np.uint64).astype(np.int64), bigrams[1].astype(np.int64), bigrams[2]
                first, length = _runs(context)
                total = np.add.reduceat(count.astype(np.float64), first)
                kept = discounted(count, d2)
                rest = total - np.add.reduceat(kept, first)  # what the discounts of a context set free
                for k in np.flatnonzero(np.isin(context[first], list(frequent))):
                    total[k], rest[k] = frequent[int(context[first[k]])]
                total, rest = np.repeat(total, length), np.repeat(rest, length)
                seen = total > 0
                p = unigram(word)
                p[seen] = (kept[seen] + rest[seen] * p[seen]) / total[seen]
                logs = np.log10(p)
                del context, word, count, total, rest, kept, seen, p
                logs = logs[np.cumsum(instances[0], dtype=np.uint64).astype(np.int64)]
                where = (instances[1].astype(np.int64) << 32) | instances[2].astype(np.int64)
                del bigrams, instances
                order = np.argsort(where, kind="stable")
                where, logs = where[order], logs[order]
                begin, _ = _runs(where)
                sums, where = np.add.reduceat(logs, begin), where[begin]
                del order, logs
                bounds = np.searchsorted(where >> 32, np.arange(len(blocks[0]) + 1))
                out = []
                for k, block in enumerate(blocks[0].view(np.int64).tolist()):
                    a, b = bounds[k], bounds[k + 1]
                    if a < b:
                        rows = (where[a:b] & 0xFFFFFFFF).astype(np.uint64)
                        # sums as integers of 2^-20: exact to add, and small
                        fixed = np.round(-sums[a:b] * (1 << 20)).astype(np.uint64)
                        out.append((block, None, pack(steps(rows), fixed)))
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.binary(), pa.binary()))],
                        names=["block", "docs", "sums"])
                del out
                words.give_back()

    return run


SCORED = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
          "score double")


def _combine(tokens: int, types: int):
    def run(table: pa.Table) -> pa.Table:
        about = next(x for x in table.column("docs").to_pylist() if x is not None)
        doc, present, held, n, known, base = unpack(about)
        total = np.zeros(len(doc), np.int64)
        for part in table.column("sums").to_pylist():
            if part is not None:
                rows, fixed = unpack(part)
                total[np.cumsum(rows, dtype=np.uint64).astype(np.int64)] += fixed.astype(np.int64)
        n = n.astype(np.int64)
        base = base.view(np.float64) - n * np.log10(tokens + types + 1)
        return pa.table(
            [pa.array(doc.view(np.int64), mask=present == 0), pa.array(held.astype(bool)), pa.array(n),
             pa.array(known.astype(np.int64)), pa.array(np.full(len(n), tokens)), pa.array(base), pa.array(-total / (1 << 20))],
            names=[c.split()[0] for c in SCORED.split(", ")])

    return run


def score_texts(docs: DataFrame, held_out: Column) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for each row of ``docs(doc_id, text)``.

    Rows where *held_out* is true are scored only, all others also train.  ``n_tokens`` counts the words and the
    end of the text, ``n_known`` those that training texts hold; ``train_tokens`` is the size of these.
    ``base_score`` is the log10 probability under add-one unigrams, ``score`` under the bigram model, to 2^-20 for
    each shard.  A null or empty text is its end alone.  Null ids and rows that repeat an id are rows like
    others; a null *held_out* counts as training; other columns are dropped.  Without training texts every
    token is unknown and the model is uniform over that one.
    """
    spark, tag = docs.sparkSession, f"kn-{uuid.uuid4().hex}"
    shards = SHARDS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = F.coalesce(held_out, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (~held).alias("train"), held.alias("held"))

    vocabulary = stage(count_words(rows), "vocabulary")
    total = vocabulary.agg(F.count(F.lit(1)).alias("types"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).first()
    names = publish(vocabulary)
    # words frequent as contexts: fewer than FREQUENT for each shard
    often = [r.word for r in vocabulary.where(F.col("n") * (FREQUENT * shards) > total.tokens).select("word").collect()]
    start = total.types + 1
    frequent = np.array(sorted([UNKNOWN, start, *_numbers(vocabulary, often)]), np.uint64)
    width = max(RANGE_WORDS, -(-(total.types + 2) // shards))

    counted = stage(
        _bigrams(rows, names, tag, shards, frequent, start).groupBy("shard").applyInArrow(_count_shard(frequent, width), COUNTED),
        "bigrams")
    levels = counted.where(F.col("kind") == SHARD).agg(*(F.coalesce(F.sum(f"n{k}"), F.lit(0)) for k in (1, 2, 3, 4))).first()
    d2 = discounts(*levels)
    contexts = counted.where(F.col("kind") == CONTEXT).groupBy("a").agg(
        *(F.sum(c).alias(c) for c in ("b", "n1", "n2", "n3"))).collect()
    totals = {r.a: (float(r.b), d2[0] * r.n1 + d2[1] * r.n2 + d2[2] * r.n3) for r in contexts}
    totals = {int(v): totals.get(int(v), (0.0, 0.0)) for v in frequent}

    continued = stage(
        counted.where(F.col("kind") == RANGE).select(F.col("a").alias("range"), "content").groupBy("range").applyInArrow(
            _continuations(width, total.types + 2), "range long, counts binary, total long, n1 long, n2 long, n3 long, n4 long, more long"),
        "continuations")
    c = continued.agg(*(F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in ("total", "n1", "n2", "n3", "n4", "more"))).first()
    d1 = discounts(c.n1, c.n2, c.n3, c.n4)
    free = d1[0] * c.n1 + d1[1] * c.n2 + d1[2] * c.more
    files, size = publish(continued), total.types + 2

    def lower():
        counts, = mapped(f"{tag}-c", files, _continuation_arrays(size, width))

        def unigram(word: np.ndarray) -> np.ndarray:
            if not c.total:
                return np.full(len(word), 1 / (total.types + 1))
            return (discounted(counts[word], d1) + free / (total.types + 1)) / c.total

        return unigram

    answers = counted.where(F.col("kind") == SHARD).select("content").mapInArrow(
        _score_shard(totals, lower, d2, start), "block long, docs binary, sums binary")
    about = counted.where(F.col("kind") == DOCS).select(
        F.col("a").alias("block"), F.col("content").alias("docs"), F.lit(None).cast("binary").alias("sums"))
    return answers.union(about).groupBy("block").applyInArrow(_combine(total.tokens, total.types), SCORED)


def _numbers(vocabulary: DataFrame, chosen: list[int]) -> list[int]:
    """The numbers of a few words: their rank in hash order, from 1."""
    if not chosen:
        return []
    chosen = sorted(chosen)
    marks = F.array(*(F.lit(w) for w in chosen))
    # how many words come before each chosen one, counted between neighbours
    place = F.aggregate(marks, F.lit(0), lambda n, m: n + F.when(F.col("word") >= m, 1).otherwise(0))
    counts = {r.place: r.n for r in vocabulary.groupBy(place.alias("place")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before = np.cumsum([counts.get(k, 0) for k in range(len(chosen))])
    return [int(b) + 1 for b in before]


def _continuations(width: int, size: int):
    def run(table: pa.Table) -> pa.Table:
        first = table.column("range")[0].as_py() * width
        out = np.zeros(min(width, size - first), np.int64)
        for content in table.column("content").to_pylist():
            word, times = unpack(content)
            out[np.cumsum(word, dtype=np.uint64).astype(np.int64) - first] += times.astype(np.int64)
        row = [[first // width], [out.astype("<u4").tobytes()], [int(out.sum())], *([k] for k in _levels(out)), [int((out > 2).sum())]]
        names = ["range", "counts", "total", "n1", "n2", "n3", "n4", "more"]
        kinds = [pa.int64(), pa.binary(), *[pa.int64()] * 6]
        return pa.table([pa.array(v, k) for v, k in zip(row, kinds)], names=names)

    return run
