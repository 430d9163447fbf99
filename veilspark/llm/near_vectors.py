"""Near-duplicate vectors by cross-polytope hashing.

A vector is turned by random signs and fast Hadamard transforms and hashed to the
nearest axis; several such hashes make a bucket, several tables of buckets are
searched, and the nearest other axes give further buckets to probe.  Candidates are
verified by their cosine in double precision.

Equal vectors are one class.  Buckets are cut into square tiles of bounded size; a
tile reports how many links each class has and a spanning forest, never its pairs.
A pair that meets in several buckets counts in the first of them only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import stage
from .graph import components

#: Vectors of a bucket on one side of a tile.
TILE = 1024


def hadamard(x: np.ndarray) -> np.ndarray:
    """The normalised Walsh-Hadamard transform of each row; the width is a power of two."""
    width, h = x.shape[1], 1
    while h < width:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(len(x), width)
        h *= 2
    return x / np.sqrt(width)


def probe_codes(x: np.ndarray, *, tables: int, hashes: int, probes: int, seed: int) -> np.ndarray:
    """``n x tables x (1 + probes)`` bucket numbers of unit vectors, the home bucket first."""
    width = max(4, 1 << (x.shape[1] - 1).bit_length())
    padded = np.zeros((len(x), width))
    padded[:, :x.shape[1]] = x
    rng, out = np.random.default_rng(seed), []
    for _ in range(tables):
        axes, costs = [], []
        for _ in range(hashes):
            y = padded
            for _ in range(3):
                y = hadamard(y * rng.choice((-1.0, 1.0), width))
            size = np.abs(y)
            order = np.argsort(-size, axis=1, kind="stable")[:, :3]
            axes.append(order * 2 + (np.take_along_axis(y, order, 1) < 0))
            top = np.take_along_axis(size, order, 1)
            costs.append(top[:, :1] - top)
        # a probe changes one hash to its second or third axis, or two hashes to their second
        changes = [{i: q} for i in range(hashes) for q in (1, 2)] + [
            {i: 1, j: 1} for i in range(hashes) for j in range(i + 1, hashes)]
        cost = np.stack([sum(costs[i][:, q] for i, q in c.items()) for c in changes], axis=1)
        code = np.stack([_code(axes, c, 2 * width) for c in changes], axis=1)
        best = np.argsort(cost, axis=1, kind="stable")[:, :probes]
        out.append(np.concatenate((_code(axes, {}, 2 * width)[:, None], np.take_along_axis(code, best, 1)), axis=1))
    return np.stack(out, axis=1)


def _code(axes: list[np.ndarray], change: dict[int, int], base: int) -> np.ndarray:
    code = np.zeros(len(axes[0]), np.int64)
    for i, a in enumerate(axes):
        code = code * base + a[:, change.get(i, 0)]
    return code


def _classes(rows: DataFrame) -> DataFrame:
    """Distinct usable vectors: ``cid, label, rep, copies, embedding``."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists(
        "embedding", lambda x: x != 0)
    return (
        rows.where(usable).groupBy("cid", "label")
        .agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding"))
    )


def _join_tile(left: np.ndarray, x: np.ndarray, codes: np.ndarray, home: np.ndarray, table: int, bucket: int,
               threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a tile that link and that no earlier bucket reports.  ``left`` marks the rows
    of the first block, None a tile of a block with itself."""
    if left is None:
        first = second = np.arange(len(x))
    else:
        first, second = np.flatnonzero(left), np.flatnonzero(~left)
    a, b = np.nonzero(x[first] @ x[second].T >= threshold)
    a, b = first[a], second[b]
    keep = home[a] | home[b]
    if left is None:
        keep &= a < b
    a, b = a[keep], b[keep]
    for t in range(table):
        met = (codes[a, t, :1] == codes[b, t]).any(axis=1) | (codes[b, t, :1] == codes[a, t]).any(axis=1)
        a, b = a[~met], b[~met]
    # both homes may meet in this table: the smaller bucket reports
    ha, hb = codes[a, table, 0], codes[b, table, 0]
    at_a = (codes[b, table] == ha[:, None]).any(axis=1) & (ha < bucket)
    at_b = (codes[a, table] == hb[:, None]).any(axis=1) & (hb < bucket)
    keep = ~(at_a | at_b)
    return a[keep], b[keep]


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of *n* nodes over links ``a - b``."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def near_vectors(
    vectors: DataFrame, *, threshold: float = 0.98, tables: int = 5, hashes: int = 3, probes: int = 2, seed: int = 11,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``vectors(vec_id, embedding, label)``.

    Two rows link if their labels are equal and not null, their vectors equally long
    and their cosine is at least *threshold*.  A row whose label, id or vector is null,
    or whose vector is empty, zero or holds null or non-finite components links with
    nothing; its component is its own id.  Rows that repeat an id link with each other
    like any others and share a component.  Other columns are dropped.

    Every vector is hashed; pairs are found with the probability that they share a
    bucket (99.9 % at cosine 0.98 with these defaults), and exactly when equal.  With
    more than about a thousand million vectors to a label, use four hashes and more tables.
    """
    label = F.col("label").cast("string")
    rows = vectors.select("vec_id", "embedding", label.alias("label")).withColumn(
        "label", F.concat_ws("/", F.when(label.isNotNull(), F.size("embedding").cast("string")), label)).withColumn(
        "label", F.when(label.isNotNull(), F.col("label"))).withColumn(
        "cid", F.when(F.col("vec_id").isNotNull() & label.isNotNull(), F.struct(
            F.xxhash64("label", "embedding").alias("x"), F.xxhash64(F.lit("b"), "embedding", "label").alias("y"))))
    spots = 1 + probes
    found = "cid struct<x: long, y: long>, label string, rep long, copies long, vector binary, codes binary"

    def hashed(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            embedding = batch.column("embedding")
            lengths = np.diff(embedding.offsets.to_numpy())
            flat = embedding.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            starts = np.cumsum(lengths) - lengths
            for width in np.unique(lengths):
                pick = np.flatnonzero(lengths == width)
                x = flat[starts[pick][:, None] + np.arange(width)]
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
                codes = probe_codes(x, tables=tables, hashes=hashes, probes=probes, seed=seed)
                part = batch.take(pa.array(pick))
                yield pa.RecordBatch.from_arrays(
                    [part.column("cid"), part.column("label"), part.column("rep"), part.column("copies"),
                     pa.array([v.tobytes() for v in x], pa.binary()), pa.array([c.tobytes() for c in codes], pa.binary())],
                    names=["cid", "label", "rep", "copies", "vector", "codes"])

    classes = stage(
        _classes(rows).select("cid", "label", "rep", "copies", "embedding").mapInArrow(hashed, found), "vectors")

    # places: each class in its home bucket and its probes, without the vectors
    number = "cid struct<x: long, y: long>, t int, bucket long, home boolean"

    def spread(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.stack([np.frombuffer(c, np.int64) for c in batch.column("codes").to_pylist()]) if batch.num_rows else (
                np.empty((0, tables * spots), np.int64))
            repeat = pa.array(np.repeat(np.arange(batch.num_rows), tables * spots))
            yield pa.RecordBatch.from_arrays(
                [batch.column("cid").take(repeat), pa.array(np.tile(np.repeat(np.arange(tables), spots), len(codes)).astype(np.int32)),
                 pa.array(codes.ravel()), pa.array(np.tile(np.arange(tables * spots) % spots == 0, len(codes)))],
                names=["cid", "t", "bucket", "home"])

    light = classes.select("cid", "codes").mapInArrow(spread, number).join(classes.select("cid", "label"), "cid")
    key = F.xxhash64("label", "t", "bucket").alias("tile")
    light = light.select("cid", "t", "bucket", "home", key)
    shared = light.groupBy("tile").agg(
        F.count(F.lit(1)).alias("n"), F.max("home").alias("any")).where("n > 1 and any").select("tile", "n")
    blocks = F.ceil(F.col("n") / TILE)
    members = light.join(shared, "tile").withColumn("blocks", blocks).withColumn(
        "block", F.pmod(F.xxhash64("cid", "t"), "blocks"))
    # a block meets itself and every other block of its bucket once
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select(
        "cid", "t", "bucket", "home", "tile", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        "block")
    tiled = members.join(classes, "cid").select(
        "tile", "label", "t", "bucket", "i", "j", "block", "home", "cid", "rep", "copies", "vector", "codes")
    report = "cid struct<x: long, y: long>, links long, a long, b long"

    def join(batches) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["tile", "label", "t", "bucket", "i", "j"]):
            first = {c: table.column(c)[0].as_py() for c in ("t", "bucket", "i", "j")}
            n = table.num_rows
            if n < 2:
                continue
            vectors_, codes_ = table.column("vector").to_pylist(), table.column("codes").to_pylist()
            x = np.frombuffer(b"".join(vectors_)).reshape(n, -1)
            codes = np.frombuffer(b"".join(codes_), np.int64).reshape(n, tables, spots)
            home = np.asarray(table.column("home"))
            left = None if first["i"] == first["j"] else np.asarray(table.column("block")) == first["i"]
            a, b = _join_tile(left, x, codes, home, first["t"], first["bucket"], threshold)
            if not len(a):
                continue
            rep, copies = np.asarray(table.column("rep")), np.asarray(table.column("copies"))
            links = np.bincount(a, copies[b], n) + np.bincount(b, copies[a], n)
            root = forest(n, a, b)
            linked = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays(
                [table.column("cid").combine_chunks().take(pa.array(linked)), pa.array(links[linked].astype(np.int64)),
                 pa.array(rep[linked]), pa.array(rep[root[linked]])],
                names=["cid", "links", "a", "b"])

    partitions = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    results = stage(
        tiled.repartition(partitions, "tile", "i", "j").sortWithinPartitions("tile", "label", "t", "bucket", "i", "j", "cid")
        .mapInArrow(join, report), "vector-links")
    counted = results.groupBy("cid").agg(F.sum("links").alias("links"))
    named = components(results.select("a", "b"))
    per_class = classes.select("cid", "rep", "copies").join(counted, "cid", "left").join(
        named, F.col("rep") == F.col("node"), "left").select(
        "cid", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "rep").alias("component_id"))
    component = F.coalesce("component_id", "vec_id")
    return rows.select("vec_id", "cid").join(per_class, "cid", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"))


def runs(batches, keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each run of equal *keys*, over batches that come sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        changed = np.zeros(batch.num_rows, bool)
        for k in keys:
            codes = batch.column(k).dictionary_encode().indices.to_numpy(zero_copy_only=False)
            changed[1:] |= codes[1:] != codes[:-1]
        starts = [0, *np.flatnonzero(changed).tolist(), batch.num_rows]
        if held and tuple(batch.column(k)[0] for k in keys) != last:
            yield pa.Table.from_batches(held)
            held = []
        for start, stop in zip(starts, starts[1:]):
            if start:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, stop - start))
        last = tuple(batch.column(k)[batch.num_rows - 1] for k in keys)
    if held:
        yield pa.Table.from_batches(held)
