"""Small builders for tests.  Every planted value is invented."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilspark.schema import records


def as_records(spark, texts, kind="tool_result"):
    """Records from texts, or from ``(employee, kind, text)`` tuples."""
    rows = [
        (i, *(t if isinstance(t, tuple) else ("pat", kind, t))) for i, t in enumerate(texts)
    ]
    df = spark.createDataFrame(rows, "n int, who string, kind string, text string")
    return records(
        df, employee=F.col("who"), session_id=F.lit("s"), kind=F.col("kind"), text=F.col("text"),
        file=F.concat("who", F.lit("/log.jsonl")), record_index=F.col("n"),
    )
