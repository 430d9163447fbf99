"""The shapes of the tables everything else reads and writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.text import location_ref

# Fixed values, in the order a report lists them.
KINDS = (
    "tool_result",
    "tool_call",
    "user_message",
    "attachment",
    "assistant_message",
    "system_prompt",
)

# Fixed value: the person a file with no folder above it belongs to.
UNATTRIBUTED = "(unattributed)"

#: ``file_key`` and ``emit_seq`` order records as they are read: files by key,
#: then ``record_index``, then ``emit_seq``.  A location may repeat, this may not.
RECORDS = (
    "employee string, session_id string, source string, kind string, text string, "
    "file string, file_key array<string>, record_index bigint, block_index int, "
    "emit_seq bigint, title string, timestamp string"
)

RECORD_COLUMNS = tuple(c.strip().split(" ")[0] for c in RECORDS.split(", "))

PROBLEM_COLUMNS = ("file", "record_index", "code", "message")

SOURCE_SESSIONS, SOURCE_EXPORT, SOURCE_TEXT = "claude-code", "claude-desktop", "plain-text"


def known_kind(kind: Column) -> Column:
    """*kind*, failing the job on a value outside :data:`KINDS`."""
    return F.when(kind.isin(*KINDS), kind).otherwise(
        F.raise_error(F.concat(F.lit("unknown record kind: "), F.coalesce(kind, F.lit("NULL"))))
    )


def records(df: DataFrame, **columns: Column) -> DataFrame:
    """Select *columns* from *df* as a records table, with defaults."""
    defaults = {
        "source": F.lit(SOURCE_TEXT),
        "file_key": F.split("file", "/") if "file" not in columns else F.split(columns["file"], "/"),
        "record_index": F.lit(0),
        "block_index": F.lit(0),
        "emit_seq": F.lit(0),
        "title": F.lit(""),
        "timestamp": F.lit(""),
    }
    types = dict(c.strip().split(" ") for c in RECORDS.split(", "))
    chosen = {**defaults, **columns}
    chosen["kind"] = known_kind(chosen["kind"])
    return df.select(*[chosen[c].cast(types[c]).alias(c) for c in RECORD_COLUMNS])


def ref() -> Column:
    """The ``file#record.block`` location of a records row."""
    return location_ref(F.col("file"), F.col("record_index"), F.col("block_index"))
