"""Product codes of vectors: a codebook for each part, learned by active-entry Lloyd rounds.

Vectors are cut into equal parts.  Each part keeps its assigned entry and the exact
distance to it.  After an update only some entries have moved.  A part whose own
entry stayed where it was cannot have come nearer to any other entry that stayed,
so it is compared with the moved ("active") entries only; a part whose entry moved
is compared with the whole codebook.  Ties go to the lower index either way, so the
result is that of full scans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import stage
from . import lattice

#: Codebooks are sent to every task; this many numbers at most.
MOST = 1 << 22


def rescan(x: np.ndarray, book: np.ndarray, moved: np.ndarray, code: np.ndarray, away: np.ndarray) -> int:
    """Bring *code* and *away* of one part position up to date with *book*; how many distances that took.

    *moved* marks the entries that the last update changed.
    """
    stale = np.flatnonzero(moved[code])
    active = np.flatnonzero(moved)
    fresh = np.flatnonzero(~moved[code]) if len(active) else np.empty(0, int)
    if len(stale):
        d = lattice.distances(x[stale], book)
        code[stale] = best = d.argmin(axis=1)
        away[stale] = d[np.arange(len(stale)), best]
    if len(fresh):
        d = lattice.distances(x[fresh], book[active])
        best = d.argmin(axis=1)
        least, entry = d[np.arange(len(fresh)), best], active[best]
        nearer = (least < away[fresh]) | (least == away[fresh]) & (entry < code[fresh])
        at = fresh[nearer]
        code[at], away[at] = entry[nearer], least[nearer]
    return len(stale) * len(book) + len(fresh) * len(active)


def _round(layout: lattice.Layout, books: np.ndarray, moved: np.ndarray, first: bool):
    parts, entries, width = books.shape

    def blocks(batches) -> Iterator[tuple]:
        if first:
            for batch in lattice.pieces(batches):
                x = lattice.whole_numbers(batch.column("embedding"), parts * width)
                yield (lattice.listed(batch.column("vec_id")), lattice.listed(batch.column("label")), lattice.pack(x), x,
                       np.zeros((parts, len(x)), np.int64), np.zeros((parts, len(x)), np.int64))
            return
        for batch in batches:
            for i in range(batch.num_rows):
                data = {c: batch.column(c)[i].as_py() for c in ("vectors", "item", "codes", "away", "away_item")}
                code = np.frombuffer(data["codes"], np.uint8).reshape(parts, -1).astype(np.int64)
                away = lattice.unpack(data["away"], data["away_item"], parts, -1).astype(np.int64)
                yield (batch.column("ids").slice(i, 1), batch.column("labels").slice(i, 1), (data["vectors"], data["item"]),
                       lattice.unpack(data["vectors"], data["item"], -1, parts * width), code, away)

    def run(batches) -> Iterator[pa.RecordBatch]:
        change, row = np.zeros((parts, entries, width + 1), np.int64), None
        for ids, labels, packed, x, code, away in blocks(batches):
            for p in range(parts):
                part, was = x[:, p * width:(p + 1) * width], code[p].copy()
                rescan(part, books[p], moved[p], code[p], away[p])
                at = np.arange(len(x)) if first else np.flatnonzero(was != code[p])
                for entry, sign in ((code[p][at], 1), *(((was[at], -1),) if not first else ())):
                    np.add.at(change[p, :, 0], entry, sign)
                    np.add.at(change[p, :, 1:], entry, sign * part[at].astype(np.int64))
            held, item = lattice.pack(away)
            row = layout.row(ids, labels, pa.array([packed[0]], pa.binary()), pa.array([packed[1]]),
                             pa.array([code.astype(np.uint8).tobytes()], pa.binary()), pa.array([held], pa.binary()), pa.array([item]))
            yield row
        if row is not None:
            yield layout.report(row, change)

    return run


def _coded(parts: int):
    digits = np.array([f"{i:02x}" for i in range(256)])

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                code = np.frombuffer(batch.column("codes")[i].as_py(), np.uint8).reshape(parts, -1)
                away = lattice.unpack(batch.column("away")[i].as_py(), batch.column("away_item")[i].as_py(), parts, -1)
                text = ["".join(row) for row in digits[code.T].tolist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("ids").slice(i, 1).flatten(), batch.column("labels").slice(i, 1).flatten(),
                     pa.array(text, pa.string()), pa.array(away.sum(axis=0, dtype=np.int64))],
                    names=["vec_id", "label", "code", "error"])

    return run


def part_codes(
    vectors: DataFrame, *, parts: int = 16, entries: int = 64, rounds: int = 2, width: int | None = None,
) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` for each usable row of ``vectors(vec_id, embedding, label)``.

    Rows whose vector is null or holds null or non-finite components are dropped, and
    so are those of another length than *width*; unset, that is the length of the
    first usable vector by id whose length is a multiple of *parts*.  A component x
    counts as ``floor(256 * x)``, held within :func:`lattice.largest`.  Codebooks start
    as the parts of the *entries* rows with the smallest ids, all rows if there are
    fewer; rows without an id come last, equal ids in the order of their vectors.  Rows
    that repeat an id or a vector count each for itself.  Ties go to the lower index;
    an unused entry stays where it is.  ``label_error`` adds up equal labels, nulls
    together, and is null beyond a long.  An empty table gives no rows.  Other columns
    are dropped.
    """
    if entries > 256:
        raise ValueError("an index has two hexadecimal digits: at most 256 entries")
    spark = vectors.sparkSession
    id_type, label_type = (vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    kept = vectors.where(lattice.usable("embedding")).select("vec_id", "embedding", "label")
    if width is None:
        sized = kept.where((F.size("embedding") > 0) & (F.size("embedding") % parts == 0))
        width = sized.agg(F.min_by(F.size("embedding"), F.struct(
            F.col("vec_id").isNull(), F.col("vec_id"), F.col("embedding")))).first()[0]
    if width is not None and (width % parts or not width):
        raise ValueError(f"vectors of {width} components have no {parts} equal parts")
    if entries * (width or 0) > MOST:
        raise ValueError(f"{entries} entries of {width} components are more than the {MOST} numbers sent to each task")
    kept = kept.where(F.size("embedding") == (width or -1))
    chosen = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select("embedding").limit(entries).collect()
    if not chosen:
        return spark.createDataFrame(
            [], f"vec_id {id_type}, code string, error long, label_error long, codebooks_sha256 string")
    start = lattice.whole_numbers(pa.array([r.embedding for r in chosen], pa.list_(pa.float64())), width)
    each = width // parts
    books = start.reshape(len(start), parts, each).transpose(1, 0, 2).copy()

    layout = lattice.Layout(
        f"ids array<{id_type}>, labels array<{label_type}>, vectors binary, item string, codes binary, away binary, away_item string")
    totals = np.zeros(parts * len(start) * (each + 1), object)
    moved, blocks = np.ones(books.shape[:2], bool), kept
    for turn in range(rounds + 1):
        blocks, changes = lattice.step(blocks, _round(layout, books, moved, not turn), layout, "part-codes")
        if turn == rounds:
            break
        for at, x in changes.items():
            totals[at] += x
        counts, new = totals.reshape(parts, len(start), each + 1), books.copy()
        for p, e in zip(*np.nonzero(counts[:, :, 0])):
            new[p, e] = counts[p, e, 1:] // counts[p, e, 0]
        moved, books = (new != books).any(axis=2), new

    coded = stage(blocks.mapInArrow(_coded(parts), f"vec_id {id_type}, label {label_type}, code string, error long"), "coded")
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    by_label = coded.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "whose")
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("whose"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
