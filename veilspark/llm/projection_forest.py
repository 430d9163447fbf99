"""Nearest vectors by inner product, from a forest of random-projection trees.

Vectors are scaled into the unit ball and lifted onto the sphere by one more
component, which makes the largest inner product the smallest angle.  Trees are
fitted on a bounded sample: a node cuts along the difference of two of its vectors,
at the median.  Every row of the table is then placed in one leaf of each tree.

A query walks all trees at once through one priority queue: what comes next is the
node, of any tree, that lies least far beyond the cuts between it and the query.
The walk ends at a distance that is measured: a few queries are compared with all
rows, and the distance is set where the wanted share of their true neighbours lies
within it.  It is a property of the data, not of the table's size, and caps nothing.

Leaves are gathered on shelves of bounded size; a shelf and the queries that visit
its leaves meet in one task, which streams the queries and compares them exactly.
Rows with equal vectors are one class, which holds as many of its smallest ids as a
result can need.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import stage
from . import lattice

#: Classes of a shelf, and comparisons that queries may ask of one shelf before they are dealt to copies of it.
SHELF, WORK = 1 << 14, 1 << 29
#: Queries compared at once.
TOGETHER = 256
#: Sampled vectors below which a node is not cut.
FEWEST = 16


@dataclass
class Forest:
    """Nodes of all trees.  A child below zero is the leaf ``-1 - child``; leaves are numbered through all trees."""

    planes: np.ndarray
    cuts: np.ndarray
    children: np.ndarray
    roots: list[int]
    leaves: int
    norm: float
    #: The first leaf of each tree.
    starts: list[int]

    def lift(self, x: np.ndarray) -> np.ndarray:
        x = x / self.norm
        return np.concatenate((x, np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(axis=1)))[:, None]), axis=1)

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """``rows x trees``: the leaves of vectors."""
        x = self.lift(x)
        out = np.empty((len(x), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            at = np.full(len(x), root)
            while (inner := np.flatnonzero(at >= 0)).size:
                node = at[inner]
                right = np.einsum("ij,ij->i", x[inner], self.planes[node]) >= self.cuts[node]
                at[inner] = self.children[node, right.astype(int)]
            out[:, t] = -1 - at
        return out

    def margins(self, queries: np.ndarray) -> np.ndarray:
        """How far each query lies on the right side of every cut."""
        unit = queries / np.sqrt((queries * queries).sum(axis=1, keepdims=True))
        return unit @ self.planes[:, :-1].T - self.cuts

    def priorities(self, queries: np.ndarray) -> np.ndarray:
        """``queries x leaves``: the least margin on the way to each leaf, infinite without a cut."""
        margins, out = self.margins(queries), np.empty((len(queries), self.leaves))
        todo = [(root, np.full(len(queries), np.inf)) for root in self.roots]
        while todo:
            node, so_far = todo.pop()
            if node < 0:
                out[:, -1 - node] = so_far
                continue
            for child, side in zip(self.children[node].tolist(), (-1, 1)):
                todo.append((child, np.minimum(so_far, side * margins[:, node])))
        return out

    def visit(self, margins: list[float], bound: float, sizes: list[int], least: int) -> list[int]:
        """Leaves in the order of the shared queue, down to *bound* and to *least* rows at any rate."""
        queue = [(-np.inf, root) for root in self.roots]
        heapify(queue)
        out, met, children = [], 0, self.children
        while queue and (-queue[0][0] >= bound or met < least):
            back, node = heappop(queue)
            if node < 0:
                out.append(-1 - node)
                met += sizes[-1 - node]
                continue
            left, right = children[node]
            heappush(queue, (max(back, margins[node]), int(left)))
            heappush(queue, (max(back, -margins[node]), int(right)))
        return out


def fit(sample: np.ndarray, norm: float, *, trees: int, leaf: int, seed: int) -> Forest:
    """Trees over *sample*, cut until a node has no more than *leaf* vectors."""
    rng = np.random.default_rng(seed)
    forest = Forest(np.empty((0, sample.shape[1] + 1)), np.empty(0), np.empty((0, 2), int), [], 0, norm, [])
    x = forest.lift(sample)
    planes, cuts, children = [], [], []
    for _ in range(trees):
        forest.starts.append(forest.leaves)
        todo = [(np.arange(len(x)), None)]
        while todo:
            rows, parent = todo.pop()
            node = -1 - forest.leaves
            if len(rows) > leaf:
                a, b = x[rng.choice(rows, 2, replace=False)]
                plane = (a - b) / max(np.sqrt(((a - b) ** 2).sum()), 1e-300)
                on = x[rows] @ plane
                right = on >= np.median(on)
                if not right.all() and right.any():
                    node = len(planes)
                    planes.append(plane)
                    cuts.append(np.median(on))
                    children.append([0, 0])
                    todo += [(rows[~right], (node, 0)), (rows[right], (node, 1))]
            if node < 0:
                forest.leaves += 1
            if parent is None:
                forest.roots.append(node)
            else:
                children[parent[0]][parent[1]] = node
    if planes:
        forest.planes, forest.cuts, forest.children = np.array(planes), np.array(cuts), np.array(children)
    return forest


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def _packed(column: pa.Array, width: int) -> list[bytes]:
    """Vectors as they came, in four or eight bytes a component."""
    return [v.tobytes() for v in column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)]


def _unpacked(column: pa.Array, width: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).astype(np.float64).reshape(-1, width)


def _best(scores: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of scores that may be among the *k* best of their row, ties included; raises *floor*."""
    if scores.shape[1] > k:
        np.maximum(floor, np.partition(scores, -k, axis=1)[:, -k], out=floor)
    return np.nonzero(scores >= floor[:, None])


def _cut(row: np.ndarray, score: np.ndarray, tie: np.ndarray, k: int) -> np.ndarray:
    """The places of the *k* best of each row, ties to the smaller *tie*."""
    order = np.lexsort((tie, -score, row))
    row = row[order]
    first = np.searchsorted(row, row)
    return order[np.arange(len(row)) - first < k]


def _probe(probes: np.ndarray, forest: Forest, k: int):
    """The *k* nearest of each probe among the task's classes, and the best priority of their leaves."""
    near = forest.priorities(probes)

    def run(batches) -> Iterator[pa.RecordBatch]:
        width = probes.shape[1]
        at, score, rows = np.empty(0, int), np.empty(0), np.empty((0, width))
        floor = np.full(len(probes), -np.inf)
        for batch in batches:
            for piece in lattice.pieces([batch]):
                x = _matrix(piece.column("embedding"), width)
                found = probes @ x.T
                found[(found >= floor[:, None]) & _equal(probes, x, found >= floor[:, None])] = -np.inf
                a, b = _best(found, k, floor)
                at, score, rows = np.concatenate((at, a)), np.concatenate((score, found[a, b])), np.concatenate((rows, x[b]))
                kept = _cut(at, score, np.arange(len(at)), k)
                at, score, rows = at[kept], score[kept], rows[kept]
        if len(at):
            there = forest.leaf_of(rows)
            best = np.take_along_axis(near[at], there, axis=1).max(axis=1)
            real = np.isfinite(score)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at[real].astype(np.int32)), pa.array(score[real]), pa.array(best[real])], names=["probe", "score", "priority"])

    return run


def _equal(a: np.ndarray, b: np.ndarray, where: np.ndarray) -> np.ndarray:
    """Marks of equal vectors, looked for only *where* marked."""
    out = np.zeros(where.shape, bool)
    i, j = np.nonzero(where)
    for start in range(0, len(i), 1 << 14):
        s = slice(start, start + (1 << 14))
        out[i[s], j[s]] = (a[i[s]] == b[j[s]]).all(axis=1)
    return out


def _counts(forest: Forest, width: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        n = np.zeros(forest.leaves, np.int64)
        for batch in batches:
            n += np.bincount(forest.leaf_of(_matrix(batch.column("embedding"), width)).ravel(), minlength=forest.leaves)
        there = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(n[there])], names=["leaf", "n"])

    return run


def _walk(forest: Forest, width: int, bound: float, sizes: np.ndarray, least: int):
    """Each query with its inner product with itself and the leaves it visits."""
    each = max(1, (1 << 22) // max(1, len(forest.cuts)))

    def run(batches) -> Iterator[pa.RecordBatch]:
        held = sizes.tolist()
        for batch in lattice.pieces(batches, min(each, TOGETHER)):
            q = _matrix(batch.column("embedding"), width)
            leaves = [forest.visit(row, bound, held, least) for row in forest.margins(q).tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("qid"), pa.array((q * q).sum(axis=1)), batch.column("embedding"), pa.array(leaves, pa.list_(pa.int32()))],
                names=["qid", "own", "embedding", "leaves"])

    return run


@dataclass
class Shelves:
    """Where leaves lie: the first of their shelves, on how many, and how many copies the queries need."""

    first: np.ndarray
    over: np.ndarray
    copies: np.ndarray


def arrange(sizes: np.ndarray, visits: np.ndarray, starts: list[int], shelf: int, work: int) -> Shelves:
    """Leaves in order on shelves of about *shelf* rows; a larger leaf takes several of its own.

    A shelf holds leaves of one tree, so no class lies on it twice.
    """
    first, over = np.zeros(len(sizes), np.int64), np.maximum(1, -(-sizes // shelf))
    at, filled = 0, 0
    for leaf, n in enumerate(sizes.tolist()):
        if filled and (filled + n > shelf or leaf in starts):
            at, filled = at + 1, 0
        first[leaf], filled = at, filled + n
        if over[leaf] > 1:
            at, filled = at + int(over[leaf]), 0
    asked = np.zeros(at + 1)
    np.add.at(asked, first, sizes.astype(float) / over * visits)
    return Shelves(first, over, np.maximum(1, np.ceil(asked[first] / work)).astype(np.int64))


_TILE = "shelf long, copy int, side int, key long, leaves array<int>, ids array<{0}>, vector binary"


def _tile_rows(shelf, copy, side, key, leaves, ids, vectors) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(shelf, pa.int64()), pa.array(copy, pa.int32()), pa.array(np.full(len(shelf), side, np.int32)), key, leaves, ids,
         pa.array(vectors, pa.binary())],
        names=["shelf", "copy", "side", "key", "leaves", "ids", "vector"])


def _scatter(key: np.ndarray) -> np.ndarray:
    """Keys mixed so that neighbours part."""
    mixed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(33)).astype(np.int64)


def _shelve(forest: Forest, shelves: Shelves, width: int):
    """Each class on its shelf of every tree, as often as the shelf has copies."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in lattice.pieces(batches, 1024):
            x = _matrix(batch.column("embedding"), width)
            key = batch.column("cid").to_numpy()
            data = _packed(batch.column("embedding"), width)
            for leaf in forest.leaf_of(x).T:
                shelf = shelves.first[leaf] + _scatter(key) % shelves.over[leaf]
                times = shelves.copies[leaf]
                row = np.repeat(np.arange(len(x)), times)
                copy = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                one = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1, dtype=np.int32)), pa.array(leaf[row].astype(np.int32)))
                take = pa.array(row)
                yield _tile_rows(shelf[row], copy, 0, batch.column("cid").take(take), one, batch.column("ids").take(take),
                                 [data[i] for i in row.tolist()])

    return run


def _send(shelves: Shelves, width: int, ids: pa.DataType):
    """Each query to the shelves it visits, with its leaves there."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in lattice.pieces(batches, 1024):
            lists = batch.column("leaves")
            leaf = lists.flatten().to_numpy().astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            # a leaf over several shelves is visited on each of them
            times = shelves.over[leaf]
            nth = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
            leaf, row = np.repeat(leaf, times), np.repeat(row, times)
            shelf = shelves.first[leaf] + nth
            order = np.lexsort((leaf, shelf, row))
            leaf, row, shelf = leaf[order], row[order], shelf[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (shelf[1:] != shelf[:-1])
            starts = np.flatnonzero(new)
            key = batch.column("qid").to_numpy()[row[starts]]
            data = _packed(batch.column("embedding"), width)
            some = pa.ListArray.from_arrays(
                pa.array(np.append(starts, len(row)).astype(np.int32)), pa.array(leaf.astype(np.int32)))
            yield _tile_rows(shelf[starts], _scatter(key) % shelves.copies[leaf[starts]], 1, pa.array(key), some,
                             pa.nulls(len(starts), ids), [data[i] for i in row[starts].tolist()])

    return run


class _Shelf:
    """The classes of one shelf, by leaf."""

    def __init__(self, rows: list[pa.RecordBatch], width: int, kind: str):
        table = pa.Table.from_batches(rows).combine_chunks()
        leaf = table.column("leaves").combine_chunks().flatten().to_numpy()
        order = np.argsort(leaf, kind="stable")
        self.x = _unpacked(table.column("vector"), width, kind)[order]
        self.ids = table.column("ids").combine_chunks().take(pa.array(order))
        self.cid = table.column("key").to_numpy()[order]
        first = self.ids.flatten().take(pa.array(np.cumsum(np.append(0, np.diff(self.ids.offsets.to_numpy())))[:-1]))
        self.tie = np.unique(first.to_numpy(zero_copy_only=False), return_inverse=True)[1]
        names, starts = np.unique(leaf[order], return_index=True)
        self.part = dict(zip(names.tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(order)])))

    def search(self, batch: pa.RecordBatch, width: int, kind: str, k: int) -> pa.RecordBatch:
        """The *k* best classes of each query in the leaves it visits."""
        q = _unpacked(batch.column("vector"), width, kind)
        lists = batch.column("leaves")
        leaf = lists.flatten().to_numpy()
        row = np.repeat(np.arange(len(q)), np.diff(lists.offsets.to_numpy()))
        order = np.argsort(leaf, kind="stable")
        leaf, row = leaf[order], row[order]
        names, starts = np.unique(leaf, return_index=True)
        floor, found = np.full(len(q), -np.inf), []
        for name, start, stop in zip(names.tolist(), starts.tolist(), [*starts[1:].tolist(), len(leaf)]):
            if name not in self.part:
                continue
            a, b = self.part[name]
            who = row[start:stop]
            scores, own = q[who] @ self.x[a:b].T, floor[who]
            i, j = _best(scores, k, own)
            floor[who] = own
            found.append((who[i], a + j, scores[i, j]))
        at, place, score = (np.concatenate(c) if found else np.empty(0, int) for c in (zip(*found) if found else ((), (), ())))
        kept = _cut(at, score, self.tie[place], k)
        at, place = at[kept], place[kept]
        # summed in one order wherever a pair meets
        exact = (q[at] * self.x[place]).sum(axis=1)
        return pa.RecordBatch.from_arrays(
            [batch.column("key").take(pa.array(at)), pa.array(exact), pa.array(self.cid[place]), self.ids.take(pa.array(place))],
            names=["qid", "score", "cid", "ids"])


def _search(width: int, kind: str, k: int):
    """Over rows that come by shelf and copy, classes before queries."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        last, rows, shelf = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            names = np.stack([batch.column(c).to_numpy() for c in ("shelf", "copy", "side")], axis=1)
            starts = np.flatnonzero(np.append(True, (names[1:] != names[:-1]).any(axis=1)))
            for start, stop in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows]):
                name, side = tuple(names[start, :2].tolist()), names[start, 2]
                if name != last:
                    last, rows, shelf = name, [], None
                piece = batch.slice(start, stop - start)
                if side == 0:
                    rows.append(piece)
                    continue
                if shelf is None and rows:
                    shelf, rows = _Shelf(rows, width, kind), []
                if shelf is not None:
                    for some in lattice.pieces([piece], TOGETHER):
                        yield shelf.search(some, width, kind, k)

    return run


def nearest(
    vectors: DataFrame, wanted: Column, *, k: int = 20, trees: int = 4, leaf_rows: int = 512, recall: float = 0.95,
    fit_numbers: int = 1 << 22, probes: int = 128, width: int | None = None, seed: int = 13,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the *k* nearest rows found for each *wanted* row of ``vectors(vec_id, embedding)``.

    Nearest is the largest inner product in double precision of the vectors as given;
    ties go to the smaller id.  A query's candidates are all rows but its own.  Every
    row counts for itself, also one that repeats an id or a vector; a repeated query
    gives its result again.  Rows without an id, and those whose vector is null, empty,
    zero, of another length than *width* (unset: the most frequent one, ties to the
    shorter) or holds null or non-finite components, take no part.  With fewer than *k*
    candidates all of them come.  An empty table gives no rows.  Other columns are
    dropped.

    Trees are fitted on about ``fit_numbers / width`` distinct vectors at most (65536 at
    64 components), drawn by hash; all rows are indexed.  *probes* queries, drawn by
    hash, are compared with all rows to place the bound at which *recall* of their
    neighbours are found.
    """
    spark = vectors.sparkSession
    id_type = vectors.schema["vec_id"].dataType.simpleString()
    result = f"query_id {id_type}, rank int, vec_id {id_type}, score double"
    usable = F.col("vec_id").isNotNull() & lattice.usable("embedding") & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select("vec_id", "embedding", wanted.alias("wanted")).where(usable)
    if width is None:
        common = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
        if common is None:
            return spark.createDataFrame([], result)
        width = common.n
    rows = rows.where(F.size("embedding") == width)

    # Equal vectors are one class.  The limit applies before the shuffle, so a hot vector sends few rows.
    order = Window.partitionBy("embedding").orderBy("vec_id")
    least = rows.select("vec_id", "embedding", F.row_number().over(order).alias("nth")).where(F.col("nth") <= k + 1)
    classes = stage(
        least.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
        .withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    asked = stage(
        rows.where("wanted").groupBy("embedding").agg(F.count(F.lit(1)).alias("n")).select("embedding")
        .withColumn("qid", F.monotonically_increasing_id()), "vector-queries")
    square = F.aggregate("embedding", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    n, norm = classes.agg(F.count(F.lit(1)), F.sqrt(F.max(square))).first()
    first = asked.orderBy(F.xxhash64("embedding", F.lit(seed)), "qid").limit(probes).select("embedding").toArrow()
    if not n or not first.num_rows:
        return spark.createDataFrame([], result)

    most = max(FEWEST, fit_numbers // width)
    share, ticks = min(1.0, most / n), 1 << 30
    drawn = classes.where(F.pmod(F.xxhash64("embedding", F.lit(seed + 1)), F.lit(ticks)) < int(share * ticks)).select("embedding")
    sample = _matrix(drawn.toArrow().column("embedding").combine_chunks(), width)
    sample = sample[np.lexsort(sample.T[::-1])]  # the same trees whatever the order of the rows
    forest = fit(sample, norm, trees=trees, leaf=max(FEWEST, int(leaf_rows * share)), seed=seed)

    look = classes.select("embedding").mapInArrow(
        _probe(_matrix(first.column("embedding").combine_chunks(), width), forest, k), "probe int, score double, priority double")
    by_probe = Window.partitionBy("probe").orderBy(F.desc("score"))
    true = look.withColumn("nth", F.row_number().over(by_probe)).where(F.col("nth") <= k).select("priority").toArrow()
    far = np.sort(true.column("priority").to_numpy())
    bound = far[int((1 - recall) * len(far))] if len(far) else np.inf

    def per_leaf(found: DataFrame) -> np.ndarray:
        out = np.zeros(forest.leaves, np.int64)
        for r in found.groupBy("leaf").agg(F.sum("n").alias("n")).collect():  # their number is bounded by the sample
            out[r.leaf] = r.n
        return out

    sizes = per_leaf(classes.select("embedding").mapInArrow(_counts(forest, width), "leaf long, n long"))
    item = asked.schema["embedding"].dataType.elementType.simpleString()
    walked = stage(asked.mapInArrow(
        _walk(forest, width, bound, sizes, k + 1), f"qid long, own double, embedding array<{item}>, leaves array<int>"), "vector-walks")
    visits = per_leaf(walked.select(F.explode("leaves").alias("leaf"), F.lit(1).alias("n")))

    shelves, tile = arrange(sizes, visits, forest.starts, SHELF, WORK), _TILE.format(id_type)
    ids_arrow = classes.select("ids").limit(0).toArrow().schema.field("ids").type
    tiles = classes.mapInArrow(_shelve(forest, shelves, width), tile).union(
        walked.select("qid", "embedding", "leaves").mapInArrow(_send(shelves, width, ids_arrow), tile))
    found = tiles.repartition("shelf", "copy").sortWithinPartitions("shelf", "copy", "side").mapInArrow(
        _search(width, "<f4" if item == "float" else "<f8", k + 1), f"qid long, score double, cid long, ids array<{id_type}>")

    near = F.struct((-F.col("score")).alias("away"), F.col("ids")[0].alias("id"), "cid", "ids")
    by_query = Window.partitionBy("qid").orderBy("near")
    # a class comes once from each tree at most
    best = found.select("qid", near.alias("near")).withColumn("nth", F.row_number().over(by_query)).where(
        F.col("nth") <= (k + 1) * trees)
    classes_near = F.slice(F.array_sort(F.array_distinct(F.collect_list("near"))), 1, k + 1)
    rows_near = F.flatten(F.transform("classes", lambda c: F.transform(c["ids"], lambda i: F.struct(c["away"].alias("away"), i.alias("id")))))
    listed = best.groupBy("qid").agg(classes_near.alias("classes")).select(
        "qid", F.slice(F.array_sort(rows_near), 1, k + 1).alias("near"))
    known = walked.select("qid", "own", "embedding").join(listed, "qid").drop("qid")
    mine = F.array_position(
        F.transform("near", lambda e: (e["id"] == F.col("query_id")) & (e["away"] == -F.col("own"))), True)
    others = F.slice(F.filter("near", lambda e, i: i + 1 != F.col("mine")), 1, k)
    return (
        rows.where("wanted").select(F.col("vec_id").alias("query_id"), "embedding").join(known, "embedding")
        .withColumn("mine", mine).select("query_id", F.posexplode(others).alias("nth", "e"))
        .select("query_id", (F.col("nth") + 1).alias("rank"), F.col("e.id").alias("vec_id"), (-F.col("e.away")).alias("score"))
    )
