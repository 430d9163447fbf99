"""Tables of texts as records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import records
from .plain_text import chunks


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: A table up to this size may be shuffled to use every core.
SMALL_TABLE = 1 << 30


def spread(df: DataFrame) -> DataFrame:
    """Use every core for a small table kept in a few files.

    A small table often is one row group, hence one task.  Anything larger than
    :data:`SMALL_TABLE` is read as it lies: its texts are not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    few = size <= SMALL_TABLE and len(df.inputFiles()) < cores
    return df.repartition(2 * cores) if few else df


def document_records(documents: DataFrame) -> DataFrame:
    """``documents(doc_id, text, source)``: one attachment per chunk."""
    named = documents.select(
        F.col("source").alias("employee"), F.col("doc_id").cast("string").alias("session_id"),
        F.format_string("%s/%d.txt", "source", "doc_id").alias("file"), "text",
    )
    return records(
        chunks(named),
        employee=F.col("employee"), session_id=F.col("session_id"), kind=F.lit("attachment"),
        text=F.col("chunk"), file=F.col("file"), block_index=F.col("chunk_index"),
        emit_seq=F.col("chunk_index"),
        title=F.concat(F.col("session_id"), F.lit(".txt")),
    )


def conversation_records(conversations: DataFrame) -> DataFrame:
    """``conversations(conv_id, turn, role, text)``: one record per turn."""
    kind = (
        F.when(F.col("role") == "user", "user_message")
        .when(F.col("role") == "system", "system_prompt")
        .otherwise("assistant_message")
    )
    person = F.concat(F.lit("c"), (F.col("conv_id") % 20).cast("string"))
    return records(
        conversations.where(F.trim("text") != ""),
        employee=person, session_id=F.col("conv_id").cast("string"), kind=kind, text=F.col("text"),
        file=F.concat(person, F.lit("/"), F.col("conv_id").cast("string"), F.lit(".jsonl")),
        record_index=F.col("turn"),
    )


def page_records(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)``: the raw markup as a tool result."""
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1)
    return records(
        pages,
        employee=host, session_id=F.col("page_id").cast("string"), kind=F.lit("tool_result"),
        text=F.col("html"), file=F.concat(host, F.lit("/"), F.col("page_id").cast("string"), F.lit(".txt")),
    )
