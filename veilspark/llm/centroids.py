"""k-means with heap-ordered bounds.

Each block keeps one heap of vectors for each cluster, ordered by the gap between
the lower bound on the distance to any other centroid and the upper bound on that
to the own one.  Moving centroids use up gaps: a cluster accumulates how far its own
centroid and the fastest other one moved.  A gap is entered offset by what had been
accumulated, so one comparison with the top of a heap tells whether any vector of
the cluster may have come nearer to another centroid.  Only those are popped and
compared with all centroids; the others are not looked at.

All arithmetic that decides is on whole numbers.  Bounds are doubles, widened by
more than their rounding error, so that ties are always rescanned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import stage
from . import lattice

#: Centroids are sent to every task; this many numbers at most.
MOST = 1 << 22
#: Relative widening of bounds, well above the rounding of their sums.
SLACK = 1e-9


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, ties to the smaller number, and the gap to the second nearest."""
    d = lattice.distances(x, centres)
    best = d.argmin(axis=1)
    rows = np.arange(len(x))
    upper = np.sqrt(d[rows, best].astype(np.float64))
    if len(centres) == 1:
        return best, np.full(len(x), np.inf)
    d[rows, best] = np.iinfo(np.int64).max
    lower = np.sqrt(d.min(axis=1).astype(np.float64))
    return best, lower - upper - SLACK * (lower + upper + 1)


def _spent(before: np.ndarray, old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """What each cluster's gaps have lost so far: its own centroid's moves and the largest other ones."""
    moves = np.sqrt(((old - new) ** 2).sum(axis=1).astype(np.float64)) * (1 + SLACK)
    if len(moves) == 1:
        return before
    first, second = np.sort(moves)[::-1][:2]
    others = np.where(moves == first, second if (moves == first).sum() == 1 else first, first)
    return before + (moves + others) * (1 + SLACK)


class _Heaps:
    """The heaps of one block, and the change it makes to counts and sums."""

    def __init__(self, x: np.ndarray, heaps: list[list], change: np.ndarray):
        self.x, self.heaps, self.change = x, heaps, change

    def enter(self, positions: np.ndarray, centres: np.ndarray, spent: np.ndarray) -> np.ndarray:
        best, gap = _nearest(self.x[positions], centres)
        for p, c, key in zip(positions.tolist(), best.tolist(), (gap + spent[best]).tolist()):
            heappush(self.heaps[c], (key, p))
        return best

    def count(self, clusters: np.ndarray, positions: np.ndarray, sign: int) -> None:
        np.add.at(self.change[:, 0], clusters, sign)
        np.add.at(self.change[:, 1:], clusters, sign * self.x[positions].astype(np.int64))

    def rescan(self, centres: np.ndarray, spent: np.ndarray) -> int:
        """Pop the vectors whose gap has expired and compare them with all centroids."""
        popped, owner = [], []
        for c, heap in enumerate(self.heaps):
            while heap and heap[0][0] <= spent[c]:
                popped.append(heappop(heap)[1])
                owner.append(c)
        if popped:
            at, was = np.array(popped), np.array(owner)
            now = self.enter(at, centres, spent)
            moved = was != now
            self.count(was[moved], at[moved], -1)
            self.count(now[moved], at[moved], 1)
        return len(popped)


def _write(layout: lattice.Layout, ids: pa.Array, vectors: tuple[bytes, str], heaps: list[list]) -> pa.RecordBatch:
    keys = np.array([k for heap in heaps for k, _ in heap], np.float64)
    order = np.array([p for heap in heaps for _, p in heap], np.int32)
    sizes = np.array([len(heap) for heap in heaps], np.int32)
    return layout.row(ids, pa.array([vectors[0]], pa.binary()), pa.array([vectors[1]]), pa.array([keys.tobytes()], pa.binary()),
                      pa.array([order.tobytes()], pa.binary()), pa.array([sizes.tobytes()], pa.binary()))


def _read(batch: pa.RecordBatch, width: int) -> Iterator[tuple]:
    """``ids, packed vectors, vectors, heaps`` of each block."""
    for i in range(batch.num_rows):
        packed = batch.column("vectors")[i].as_py(), batch.column("item")[i].as_py()
        keys = np.frombuffer(batch.column("keys")[i].as_py(), np.float64).tolist()
        order = np.frombuffer(batch.column("places")[i].as_py(), np.int32).tolist()
        ends = np.cumsum(np.frombuffer(batch.column("sizes")[i].as_py(), np.int32)).tolist()
        heaps = [list(zip(keys[a:b], order[a:b])) for a, b in zip([0, *ends], ends)]
        yield batch.column("ids").slice(i, 1), packed, lattice.unpack(*packed, -1, width), heaps


def _first(layout: lattice.Layout, centres: np.ndarray):
    k, width = centres.shape

    def run(batches) -> Iterator[pa.RecordBatch]:
        change, row = np.zeros((k, width + 1), np.int64), None
        for batch in lattice.pieces(batches):
            x = lattice.whole_numbers(batch.column("embedding"), width)
            at = np.arange(len(x))
            best, gap = _nearest(x, centres)
            heaps: list[list] = [[] for _ in range(k)]
            for p, c, key in zip(at.tolist(), best.tolist(), gap.tolist()):
                heaps[c].append((key, p))
            for heap in heaps:
                heapify(heap)
            _Heaps(x, heaps, change).count(best, at, 1)
            row = _write(layout, lattice.listed(batch.column("vec_id")), lattice.pack(x), heaps)
            yield row
        if row is not None:
            yield layout.report(row, change)

    return run


def _again(layout: lattice.Layout, centres: np.ndarray, spent: np.ndarray):
    k, width = centres.shape

    def run(batches) -> Iterator[pa.RecordBatch]:
        change, row = np.zeros((k, width + 1), np.int64), None
        for batch in batches:
            for ids, packed, x, heaps in _read(batch, width):
                _Heaps(x, heaps, change).rescan(centres, spent)
                row = _write(layout, ids, packed, heaps)
                yield row
        if row is not None:
            yield layout.report(row, change)

    return run


def _placed(centres: np.ndarray):
    """Each vector's cluster and its exact distance."""
    width = centres.shape[1]

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, _, x, heaps in _read(batch, width):
                cluster = np.empty(len(x), np.int32)
                for c, heap in enumerate(heaps):
                    cluster[[p for _, p in heap]] = c
                away = ((x.astype(np.int64) - centres[cluster]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [ids.flatten(), pa.array(cluster), pa.array(away)], names=["vec_id", "cluster", "distance"])

    return run


def clusters(
    vectors: DataFrame, *, clusters: int = 40, rounds: int = 5, width: int = 64, salt: str = "2",
) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` for each usable row of
    ``vectors(vec_id, embedding)``.

    Rows whose vector is null, has not exactly *width* components, or holds null or
    non-finite ones are dropped.  A component x counts as ``floor(256 * x)``, held
    within :func:`lattice.largest` (2^27 at 64 components).  Centroids start as the
    *clusters* rows with the smallest hash of ``salt:vec_id``, all rows if there are
    fewer; rows without an id come last, equal ids in the order of their vectors.
    Rows that repeat an id or a vector count each for itself.  Ties go to the centroid
    with the smaller number; one that loses all vectors stays where it is.  An empty
    table gives no rows.  ``cluster_inertia`` and ``inertia`` are null beyond a long.
    Other columns are dropped.

    A round costs one pass over the blocks; the driver holds centroids and their sums.
    """
    spark = vectors.sparkSession
    if clusters * width > MOST:
        raise ValueError(f"{clusters} centroids of {width} components are more than the {MOST} numbers sent to each task")
    id_type = vectors.schema["vec_id"].dataType.simpleString()
    kept = vectors.where(lattice.usable("embedding") & (F.size("embedding") == width)).select("vec_id", "embedding")
    rank = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    chosen = kept.orderBy(rank.asc_nulls_last(), "embedding").limit(clusters).collect()
    kind = "vec_id {0}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not chosen:
        return spark.createDataFrame([], kind.format(id_type))
    start = pa.array([r.embedding for r in chosen], pa.list_(pa.float64()))
    centres = lattice.whole_numbers(start, width)
    k = len(centres)

    layout = lattice.Layout(f"ids array<{id_type}>, vectors binary, item string, keys binary, places binary, sizes binary")
    spent, totals, blocks = np.zeros(k), [0] * (k * (width + 1)), kept
    for turn in range(rounds + 1):
        run = _again(layout, centres, spent) if turn else _first(layout, centres)
        blocks, changes = lattice.step(blocks, run, layout, "centroids")
        for at, x in changes.items():
            totals[at] += x
        if turn == rounds:
            break
        new = centres.copy()
        for c in range(k):
            n, *sums = totals[c * (width + 1):(c + 1) * (width + 1)]
            if n:
                new[c] = [s // n for s in sums]
        spent, centres = _spent(spent, centres, new), new

    placed = stage(blocks.mapInArrow(_placed(centres), f"vec_id {id_type}, cluster int, distance long"), "clustered")
    # one row for each cluster; their number is bounded by MOST
    inertia = {r.cluster: r.x for r in placed.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("x")).collect()}
    total = _long(sum(inertia.values()))
    per_cluster = spark.createDataFrame([
        (c, _long(inertia.get(c, 0)), total, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest())
        for c, row in enumerate(centres.tolist())
    ], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(per_cluster), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _long(x) -> int | None:
    return int(x) if x < 1 << 63 else None
