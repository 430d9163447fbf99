"""Plain-text files: kind and session from the path, text in overlapping chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import file_name, stem
from ..functions.text import not_blank
from ..schema import SOURCE_TEXT, records
from .ranges import assemble

# Fixed values.
CHUNK_SIZE = 8_000
CHUNK_OVERLAP = 200
SUFFIXES = (".txt", ".md", ".log", ".text")
RESULT_FOLDERS = ("tool-results", "tool_results")


# Chunks cut from one stretch; finding a place in a text costs its length, so a
# long text is cut into stretches first.
_STRETCH = 64
_STEP = CHUNK_SIZE - CHUNK_OVERLAP


def _cut(texts: DataFrame, before: Column, total: Column) -> DataFrame:
    """Explode ``text`` into ``chunk`` and ``chunk_index``; *before* characters of *total* lie ahead of it.

    ``whole`` marks chunks that lie entirely in this text.
    """
    length = F.length("text")
    last = F.greatest(F.lit(0), F.ceil((F.col("_total") - CHUNK_SIZE) / _STEP))
    first = F.greatest(F.lit(0), F.ceil((F.col("_before") - CHUNK_SIZE + 1) / _STEP))
    stretches = (
        texts.withColumn("_before", before.cast("bigint")).withColumn("_total", total.cast("bigint"))
        .withColumn("_last", F.least(last, F.floor((F.col("_before") + length - 1) / _STEP)).cast("bigint"))
        .withColumn("_low", first.cast("bigint"))
        .where((length > 0) & (F.col("_low") <= F.col("_last")))
        .withColumn("_first", F.explode(F.sequence(F.col("_low"), F.col("_last"), F.lit(_STRETCH).cast("bigint"))))
        .withColumn("_at", F.greatest(F.lit(0), F.col("_first") * _STEP - F.col("_before")))
        .withColumn("_ends", F.col("_before") + length)
        .withColumn("text", F.when(F.col("_last") - F.col("_low") < _STRETCH, F.substring(
            "text", F.col("_at") + 1, F.length("text"))).otherwise(
            F.substring("text", F.col("_at") + 1, F.lit(_STRETCH * _STEP + CHUNK_SIZE))))
        .withColumn("_start", F.col("_before") + F.col("_at"))
    )
    numbers = F.sequence(F.col("_first"), F.least(F.col("_last"), F.col("_first") + _STRETCH - 1))
    start = F.greatest(F.col("chunk_index") * _STEP, F.col("_before"))
    stop = F.least(F.col("chunk_index") * _STEP + CHUNK_SIZE, F.col("_total"))
    return (
        stretches.withColumn("chunk_index", F.explode(numbers))
        .withColumn("chunk", F.substring(
            "text", (start - F.col("_start") + 1).cast("int"), (stop - start).cast("int")))
        .withColumn("whole", (F.col("chunk_index") * _STEP >= F.col("_before")) & (stop <= F.col("_ends")))
        .drop("text", "_before", "_total", "_last", "_low", "_first", "_at", "_ends", "_start")
    )


def chunks(texts: DataFrame) -> DataFrame:
    """Explode ``text`` into ``chunk`` and ``chunk_index``.

    Chunks overlap, so a value on a boundary is whole in one of them.  A blank
    chunk is skipped but keeps its number; the last one reaches the end.
    """
    cut = _cut(texts, F.lit(0), F.length("text"))
    return cut.withColumn("chunk_index", F.col("chunk_index").cast("int")).drop("whole").where(not_blank(F.col("chunk")))


def range_chunks(parts: DataFrame, several: bool = True) -> DataFrame:
    """The chunks of files of any length, from their parts; only chunks over two parts are shuffled."""
    total = F.when(F.col("start.all_chars") < 0, F.length("text")).otherwise(F.col("start.all_chars"))
    cut = _cut(parts.select("file_id", "path", "employee", "file_key", "offset", "start", "text"), F.col("start.chars"), total)
    return assemble(cut, "chunk_index", "chunk", F.col("whole"), several).where(not_blank(F.col("chunk")))


def is_plain_text(name: Column) -> Column:
    lowered = F.lower(name)
    out = F.lit(False)
    for suffix in SUFFIXES:
        out = out | lowered.endswith(suffix)
    return out


def kind_of(path: Column) -> Column:
    p = F.lower(path)
    spilled = F.lit(False)
    for folder in RESULT_FOLDERS:
        spilled = spilled | F.contains(p, F.lit(folder + "/"))
    # Fixed values.
    instructions = (
        p.endswith("claude.md") | F.contains(p, F.lit("/memory/"))
        | F.contains(p, F.lit("instruction")) | F.contains(p, F.lit("agents.md"))
    )
    return F.when(spilled, "tool_result").when(instructions, "system_prompt").otherwise("attachment")


def session_of(path: Column) -> Column:
    """The folder above a spilled-results folder, else the file's stem."""
    parts = F.split(path, "/")
    spilled = (F.size(parts) >= 3) & F.try_element_at(parts, F.lit(-2)).isin(*RESULT_FOLDERS)
    return F.when(spilled, F.try_element_at(parts, F.lit(-3))).otherwise(stem(file_name(path)))


def parse(parts: DataFrame, several: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """Parts of texts to records; there are no problems."""
    return records(
        range_chunks(parts, several),
        employee=F.col("employee"), session_id=session_of(F.col("path")), source=F.lit(SOURCE_TEXT),
        kind=kind_of(F.col("path")), text=F.col("chunk"), file=F.col("path"), file_key=F.col("file_key"),
        block_index=F.col("chunk_index"), emit_seq=F.col("chunk_index"), title=file_name(F.col("path")),
    ), None
