"""Group documents whose word shingles overlap, exactly.

1. Every text becomes a set of hashed shingles.  Sets travel as packed, sorted
   arrays by ranges of hashes, so that each range learns which shingles occur in
   more than one document.
2. Back at its block of documents, a document goes on only if enough of its
   shingles are shared for any link; overlaps depend on shared shingles alone.
3. Equal sets are one class.  Each class announces its rarest shared shingles, so
   many that two linked sets must announce a common one; the classes below such a
   shingle form a tile.
4. Each class is first compared with the smallest class of its tiles.  What these
   links join is not compared again.  A large tile that still holds several components
   is cut into bands of set sizes, so wide that sets which link are in one band or in
   two neighbouring ones; only such bands meet, in squares of a bounded side.  There
   bit counts of hashed bitmaps bound the overlap from above, and what remains is
   intersected exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.staging import stage
from . import words
from .graph import components
from .near_vectors import runs

#: Bits of a shingle's hash.
BITS = 48
#: 64-bit words of a bitmap.
BITMAP = 16
#: Classes on one side of a square.
SQUARE = 512
_CODEC = pa.Codec("zstd", compression_level=1)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of equal length as compressed byte planes."""
    out = [np.uint32(len(arrays[0])).tobytes(), np.uint8(len(arrays)).tobytes()]
    for a in arrays:
        width = 1 if not len(a) or a.max() < 1 << 8 else -(-int(a.max()).bit_length() // 8)
        planes = a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
        raw = np.ascontiguousarray(planes).tobytes()
        body = _CODEC.compress(raw, asbytes=True)
        out += [np.uint8(width).tobytes(), np.uint32(len(body)).tobytes(), body]
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    n, count, at, out = int(np.frombuffer(data, "<u4", 1)[0]), data[4], 5, []
    for _ in range(count):
        width, size = data[at], int(np.frombuffer(data, "<u4", 1, at + 1)[0])
        at += 5
        planes = np.frombuffer(_CODEC.decompress(data[at:at + size], n * width), np.uint8).reshape(width, n)
        whole = np.zeros((n, 8), np.uint8)
        whole[:, :width] = planes.T
        out.append(whole.view("<u8").ravel())
        at += size
    return out


def steps(sorted_values: np.ndarray) -> np.ndarray:
    return np.diff(sorted_values, prepend=np.uint64(0))


def least_overlap(n, percent: int):
    """The smallest overlap that a set of *n* can have with any set it links to."""
    return (percent * n + 99) // 100


MESSAGE = "shard int, block long, docs binary, items binary"
ANSWER = "block long, docs binary, items binary"
SET = "doc_id long, n long, d1 long, d2 long, items array<long>, rarity array<long>"


def _hashed(piece: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """``(row, hash)`` of the distinct shingles of each row, by hash and row."""
    offsets, codes, vocabulary = words.split(piece.column("text"))
    tokens = words.hashes(vocabulary)[codes] if len(codes) else np.zeros(0, np.uint64)
    del codes, vocabulary
    row, value = words.shingles(offsets, tokens, width)
    del tokens
    value >>= np.uint64(64 - BITS)
    order = np.lexsort((row, value))
    row, value = row[order], value[order]
    del order
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]


def _sets(docs: DataFrame, width: int, shards: int) -> DataFrame:
    """Messages of every block of documents to every range of hashes."""
    limits = np.array([(s << BITS) // shards for s in range(shards + 1)], np.uint64)

    def messages(piece: pa.RecordBatch, block: int) -> pa.RecordBatch:
        row, value = _hashed(piece, width)
        n = np.bincount(row, minlength=piece.num_rows)
        digests = []
        for salt in (1, 2):
            total = np.zeros(piece.num_rows, np.uint64)
            np.add.at(total, row, words.mix(value * np.uint64(4) + np.uint64(salt)))
            digests.append(total)
        ids = piece.column("doc_id")
        present = np.asarray(ids.is_valid())
        doc = np.asarray(ids.fill_null(0)).astype(np.int64).view(np.uint64)
        about = pack(doc, present.astype(np.uint64), n.astype(np.uint64), *digests)
        bounds = np.searchsorted(value, limits)
        keeper = block % shards
        rows = []
        for s in range(shards):
            a, b = bounds[s], bounds[s + 1]
            if a < b or s == keeper:
                rows.append((s, block, about if s == keeper else None, pack(steps(value[a:b]), row[a:b].astype(np.uint64))))
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))],
            names=["shard", "block", "docs", "items"])

    def run(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        # what a slice needs is gone before the next one is read
        for number, piece in enumerate(words.slices(batches, "text")):
            yield messages(piece, (part << 24) + number)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, MESSAGE)


def _times(value: np.ndarray) -> np.ndarray:
    """How often each value occurs."""
    order = np.argsort(value)
    ordered = value[order]
    start = np.flatnonzero(np.diff(ordered, prepend=~ordered[:1])) if len(ordered) else np.zeros(0, np.int64)
    del ordered
    count = np.diff(np.append(start, len(value))).astype(np.uint32)
    del start
    times = np.empty(len(value), np.uint32)
    times[order] = np.repeat(count, count)
    return times


def _shared(table: pa.Table) -> pa.Table:
    """Of one range of hashes, what occurs in more than one document, back to its block."""
    blocks, docs, items = (table.column(c) for c in ("block", "docs", "items"))
    ends = np.cumsum([0, *(np.frombuffer(x.as_buffer(), "<u4", 1)[0] for x in items)], dtype=np.int64)
    value, row = np.empty(ends[-1], np.uint64), np.empty(ends[-1], np.uint32)
    for a, b, x in zip(ends, ends[1:], items):
        step, row[a:b] = unpack(x.as_buffer())
        np.cumsum(step, out=value[a:b])
    times = _times(value)
    out = []
    for a, b, block, about in zip(ends, ends[1:], blocks.to_pylist(), docs.to_pylist()):
        kept = times[a:b] > 1
        if about is not None or kept.any():
            out.append((block, about, pack(steps(value[a:b][kept]), row[a:b][kept], times[a:b][kept])))
    columns = list(zip(*out)) or [[], [], []]
    del value, row, times
    words.give_back()
    return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())],
                    names=["block", "docs", "items"])


def _collect(percent: int):
    """Of one block, its documents; with their shared shingles where those can suffice."""
    def run(table: pa.Table) -> pa.Table:
        about = next(x for x in table.column("docs").to_pylist() if x is not None)
        doc, present, n, d1, d2 = unpack(about)
        parts = [unpack(x) for x in table.column("items").to_pylist()]
        value = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
        row, times = (np.concatenate([p[k] for p in parts]).astype(np.int64) for k in (1, 2))
        n = n.astype(np.int64)
        enough = (np.bincount(row, minlength=len(doc)) >= least_overlap(n, percent)) & (n > 0) & (present > 0)
        kept = enough[row]
        value, row, times = value[kept], row[kept], times[kept]
        order = np.lexsort((value, row))
        value, row, times = value[order].astype(np.int64), row[order], times[order]
        offsets = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(doc))))).astype(np.int32)
        none = pa.array(~enough)
        del order, kept, parts
        words.give_back()

        def lists(x: np.ndarray) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(x), mask=none)

        return pa.table(
            [pa.array(doc.view(np.int64), mask=present == 0), pa.array(n), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)),
             lists(value), lists(times)], names=["doc_id", "n", "d1", "d2", "items", "rarity"])

    return run


ANNOUNCED = "token long, rep long, n long"


def _announce(percent: int):
    """The rarest shared shingles of each class; two linked classes have one in common."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], []]
            for rep, n, items, rarity in zip(*(batch.column(c) for c in ("rep", "n", "items", "rarity"))):
                items, rarity = items.values.to_numpy(), rarity.values.to_numpy()
                size = len(items) - least_overlap(n.as_py(), percent) + 1
                first = items[np.lexsort((items, rarity))[:size]]
                out[0].append(first)
                out[1].append(np.full(len(first), rep.as_py()))
                out[2].append(np.full(len(first), n.as_py()))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in out], names=["token", "rep", "n"])

    return run


def bitmap(items: np.ndarray) -> np.ndarray:
    """Each item flips one bit, so that differing bits never outnumber differing items."""
    bits = words.mix(items.astype(np.uint64)) % np.uint64(64 * BITMAP)
    odd = np.bincount(bits.astype(np.int64), minlength=64 * BITMAP).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view("<u8")


def exact_overlap(a: np.ndarray, b: np.ndarray) -> int:
    """The size of the intersection of two sorted arrays."""
    if not len(a) or not len(b):
        return 0
    at = np.searchsorted(b, a)
    return int(np.count_nonzero(b[np.minimum(at, len(b) - 1)] == a))


def _links(overlap, n, m, percent: int):
    return 100 * overlap >= percent * (n + m - overlap)


def _verify(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs(a, b)`` that link, by exact intersection of their shared shingles."""
    sides = []
    for side in ("a", "b"):
        sides.append(classes.select(
            F.col("rep").alias(side), F.col("n").alias(f"n_{side}"), F.col("items").alias(f"items_{side}")))
    joined = pairs.join(sides[0], "a").join(sides[1], "b").where(
        (100 * F.col("n_a") >= percent * F.col("n_b")) & (100 * F.col("n_b") >= percent * F.col("n_a")))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, m, left, right = (batch.column(c) for c in ("a", "b", "n_a", "n_b", "items_a", "items_b"))
            keep = [
                _links(exact_overlap(x.values.to_numpy(), y.values.to_numpy()), n[i].as_py(), m[i].as_py(), percent)
                for i, (x, y) in enumerate(zip(left, right))]
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], names=["a", "b"])

    return joined.select("a", "b", "n_a", "n_b", "items_a", "items_b").mapInArrow(run, "a long, b long")


SQUARE_KEY = ["token", "low", "high", "i", "j"]


def band(n: Column, percent: int) -> Column:
    """A number for each set size; sets that link have the same or neighbouring numbers."""
    # a little wider than the largest ratio of sizes, so that rounding moves no set two bands away
    return F.floor(F.log(n) / F.lit(math.log(100 / percent) * 1.0001)) if percent < 100 else n


def _squares(tiles: DataFrame, percent: int) -> DataFrame:
    """Rows of ``tiles(token, tile_size, rep, n, root)``, once for each square of their tile they belong to.

    Tiles of one component are left out.  A tile's cells are few: one for each band.  A large tile is
    spread over as many keys as its size asks for before it meets them.
    """
    spread = F.ceil(F.col("tile_size") / SQUARE)
    rows = tiles.withColumn("band", F.when(F.col("tile_size") > SQUARE, band(F.col("n"), percent)).otherwise(F.lit(0)).cast("long"))
    cells = rows.groupBy("token", "tile_size", "band").agg(
        F.ceil(F.count(F.lit(1)) / SQUARE).alias("blocks"), F.min("root").alias("least"), F.max("root").alias("most"))
    mixed = cells.groupBy("token", "tile_size").agg(
        F.map_from_entries(F.collect_list(F.struct("band", "blocks"))).alias("cells"),
        F.min("least").alias("least"), F.max("most").alias("most")).where("least < most")
    mixed = mixed.select("token", "cells", F.explode(F.sequence(F.lit(0), spread - 1)).alias("salt"))

    def blocks(at: Column) -> Column:
        return F.coalesce(F.try_element_at("cells", at), F.lit(0)).cast("long")

    def others(count: Column, square) -> Column:
        return F.transform(F.filter(F.sequence(F.lit(-1).cast("long"), count - 1), lambda o: o >= 0), square)

    def square(low: Column, high: Column, i: Column, j: Column) -> Column:
        return F.struct(low.alias("low"), high.alias("high"), i.alias("i"), j.alias("j"))

    here, block, one = F.col("band"), F.col("block"), F.lit(1).cast("long")
    squares = F.concat(
        others(blocks(here), lambda o: square(here, here, F.least(block, o), F.greatest(block, o))),
        others(blocks(here + one), lambda o: square(here, here + one, block, o)),
        others(blocks(here - one), lambda o: square(here - one, here, o, block)))
    met = rows.withColumn("salt", F.pmod(F.xxhash64(F.lit("salt"), "rep"), spread)).join(mixed, ["token", "salt"])
    met = met.withColumn("block", F.pmod(F.xxhash64("rep"), blocks(here)))
    return met.select("token", "rep", "n", "root", "band", "block", F.explode(squares).alias("square")).select(
        "token", "square.*", "band", "block", "rep", "n", "root")


def _square(percent: int):
    """Pairs of one square that are not yet joined and whose bitmaps allow a link."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, SQUARE_KEY):
            if table.num_rows < 2:
                continue
            rep, n, size, root, band, block = (np.asarray(table.column(c)) for c in ("rep", "n", "size", "root", "band", "block"))
            bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), "<u8").reshape(-1, BITMAP)
            low, high, i, j = (table.column(c)[0].as_py() for c in SQUARE_KEY[1:])
            alone = (low, i) == (high, j)
            first = np.flatnonzero((band == low) & (block == i))
            second = first if alone else np.flatnonzero((band == high) & (block == j))
            found = []
            for at in range(0, len(first), 64):
                x = first[at:at + 64]
                near = (100 * n[x, None] >= percent * n[None, second]) & (100 * n[None, second] >= percent * n[x, None])
                near &= root[x, None] != root[None, second]
                if alone:
                    near &= x[:, None] < second[None, :]
                a, b = np.nonzero(near)
                a, b = x[a], second[b]
                differ = np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1)
                most = (size[a] + size[b] - differ) // 2
                keep = _links(most, n[a], n[b], percent)
                found.append((a[keep], b[keep]))
            a, b = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.maximum(rep[a], rep[b])), pa.array(np.minimum(rep[a], rep[b]))], names=["a", "b"])

    return run


def _bitmaps(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        items = [x.values.to_numpy() for x in batch.column("items")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("rep"), pa.array([len(x) for x in items], pa.int64()),
             pa.array([bitmap(x).tobytes() for x in items], pa.binary())], names=["rep", "size", "bits"])


def shingle_groups(docs: DataFrame, *, width: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs(doc_id, text)``.

    A set holds the distinct runs of *width* words; with fewer words, the whole
    sequence is one; a null text or one without words has none and links with nothing.
    Two rows link if the intersection is at least *percent* (above 0) of the union.
    ``component_id`` is the smallest ``doc_id`` reachable by links.  A row with a null
    id links with nothing and has no component; rows that repeat an id share one, also
    where their texts differ or have no words.
    Other columns are dropped; an empty table gives no rows.
    """
    spark = docs.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sets = stage(
        _sets(docs, width, shards).groupBy("shard").applyInArrow(_shared, ANSWER)
        .groupBy("block").applyInArrow(_collect(percent), SET), "shingles")

    members = sets.where("items is not null")
    classes = stage(
        members.groupBy("d1", "d2", "n").agg(
            F.min("doc_id").alias("rep"), F.min_by("items", "doc_id").alias("items"), F.min_by("rarity", "doc_id").alias("rarity")),
        "classes")
    announced = classes.select("rep", "n", "items", "rarity").mapInArrow(_announce(percent), ANNOUNCED)
    announced = stage(announced, "announced")
    # tokens with the same members are one tile
    tiles = announced.groupBy("token").agg(
        F.count(F.lit(1)).alias("size"), F.min("rep").alias("least"),
        F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("who")).where("size > 1")
    tiles = tiles.groupBy("size", "least", "who").agg(F.min("token").alias("token"))
    placed = stage(announced.join(tiles.select("token", "least", F.col("size").alias("tile_size")), "token"), "tiles")

    star = placed.where("rep <> least").groupBy(F.col("rep").alias("a")).agg(F.min("least").alias("b"))
    near = stage(_verify(star, classes.select("rep", "n", "items"), percent), "links")
    roots = stage(components(near), "roots")

    def rooted(df: DataFrame) -> DataFrame:
        return df.join(roots, df["rep"] == roots["node"], "left").withColumn("root", F.coalesce("component", "rep")).drop(
            "node", "component")

    signed = classes.select("rep", "items").mapInArrow(_bitmaps, "rep long, size long, bits binary")
    candidates = (
        _squares(rooted(placed), percent).join(signed, "rep").repartition(shards, *SQUARE_KEY)
        .sortWithinPartitions(*SQUARE_KEY, "n", "rep").select(*SQUARE_KEY, "band", "block", "rep", "n", "size", "root", "bits")
        .mapInArrow(_square(percent), "a long, b long").distinct())
    more = _verify(candidates, classes.select("rep", "n", "items"), percent)
    # rows that repeat an id are one document, whatever their texts
    several = stage(
        sets.where("doc_id is not null").groupBy("doc_id").agg(
            *(f(c).alias(f"{f.__name__}_{c}") for c in ("d1", "d2", "n") for f in (F.min, F.max)))
        .where("min_d1 <> max_d1 or min_d2 <> max_d2 or min_n <> max_n").select("doc_id"), "several")
    named = members.join(several, "doc_id").join(classes.select("d1", "d2", "n", "rep"), ["d1", "d2", "n"]).select(
        F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    joined = components(stage(near.union(more).union(named), "links"))

    names = classes.select("d1", "d2", "n", "rep").join(joined, F.col("rep") == F.col("node"), "left").select(
        F.col("d1"), F.col("d2"), F.col("n"), F.coalesce("component", "rep").alias("found"))
    rest = sets.select("doc_id", "n", "d1", "d2", F.col("items").isNotNull().alias("linked"))
    out = rest.where("linked").join(names, ["d1", "d2", "n"]).select("doc_id", "n", "found")
    alone = rest.where("not linked and doc_id is not null").join(
        several.join(joined, F.col("doc_id") == F.col("node")).select("doc_id", F.col("component").alias("found")), "doc_id", "left")
    out = out.union(alone.select("doc_id", "n", F.coalesce("found", "doc_id")))
    return out.union(rest.where("doc_id is null").select("doc_id", "n", "doc_id")).toDF("doc_id", "n_shingles", "component_id")
