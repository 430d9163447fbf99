"""Structural detectors and page references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.remote_assets import remote_assets
from ..operators.structure import signals, split_outside_quotes, table_shape, unquoted
from ..sources.tables import document_records
from .common import SPACE, chunk_sql, table

BLOCKS = (8, 30)


def _table_shapes(spark: SparkSession, d: str) -> DataFrame:
    """The strongest table in every document chunk, and its signal."""
    chunks = document_records(table(spark, d, "documents"))
    shaped = chunks.select("file", "block_index", table_shape(F.col("text")).alias("t")).where("t IS NOT NULL")
    return shaped.select("file", "block_index", "t.delimiter", "t.rows", "t.columns")


def _customer_tables(spark: SparkSession, d: str) -> DataFrame:
    """Customers pasted as CSV, a block at a time; odd blocks name no personal fields."""
    rows = table(spark, d, "customer").select(
        "c_custkey", F.explode(F.array(*[F.lit(b) for b in BLOCKS])).alias("size"),
        F.concat(
            F.col("c_name"), F.lit(",c"), F.col("c_custkey").cast("string"), F.lit("@corp.net,\"Flat 2, "),
            F.col("c_custkey").cast("string"), F.lit(" High St\",77,"), F.col("c_mktsegment"),
        ).alias("line"),
    )
    blocks = rows.groupBy("size", F.floor(F.col("c_custkey") / F.col("size")).alias("block")).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "line"))), lambda r: r["line"]), "\n"
        ).alias("body")
    )
    header = F.when(
        F.col("block") % 2 == 0, F.lit("Full Name, email ,\"Address\",account number,STATE")
    ).otherwise("sku,qty,price,bin,lane")
    found = blocks.select(
        "size", "block",
        F.explode(signals(F.concat(header, F.lit("\n"), F.col("body")), F.lit("user_message"))).alias("s"),
    )
    return found.select("size", "block", "s.rule_id", "s.category", "s.severity", "s.confidence", "s.summary")


def _cells(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat(
        F.col("p_name"), F.lit("|\""), F.col("p_brand"), F.lit("|x\"|'a|b'|"), F.col("p_type"), F.lit("|'open|"), F.col("p_name")
    )
    return table(spark, d, "part").select(
        "p_partkey", F.array_join(split_outside_quotes(line, F.lit("|")), "~").alias("cells"),
        unquoted(line).alias("bare"),
    )


CLAUSE = "1. Clause text of ordinary length here\n- bullet point line\n\n"
HEADING = "GENERAL TERMS OF USE\nScope of work:\n"


def _document_paste(spark: SparkSession, d: str) -> DataFrame:
    """Part descriptions as documents of very different lengths."""
    kind = F.when(F.col("p_brand") < "Brand#2", "user_message").when(
        F.col("p_brand") < "Brand#23", "attachment"
    ).otherwise("tool_result")
    text = F.concat(F.lit(HEADING), F.repeat(F.lit(CLAUSE), F.col("p_size") * 3), F.col("p_name"))
    found = table(spark, d, "part").select("p_partkey", F.explode(signals(text, kind)).alias("s"))
    return found.select("p_partkey", "s.rule_id", "s.severity", "s.confidence", "s.summary")


def _remote_assets(spark: SparkSession, d: str) -> DataFrame:
    """Every page with references added in each loading context."""
    host = F.concat(F.lit("//h"), F.col("page_id").cast("string"), F.lit(".net/"))
    extra = F.concat(
        F.lit("\n<img SRC = 'https:"), host, F.lit("a.png'> <a href=\"/local\">x</a>\n<style>@import url(http:"), host,
        F.lit("s.css); p{background:url( \""), host, F.lit("b.gif\")}</style>\nsee https://plain.net\n<script>fetch( f, 'https:"),
        host, F.lit("api')</script><link href=https:"), host, F.lit("a.png>"),
    )
    pages = table(spark, d, "pages").select("page_id", F.concat("html", extra).alias("html"))
    return remote_assets(pages)


QUERIES = {
    "table_shapes": _table_shapes,
    "customer_tables": _customer_tables,
    "split_cells": _cells,
    "document_paste": _document_paste,
    "remote_assets": _remote_assets,
}

_BREAK = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"

SQL = {
    "table_shapes": f"""
        WITH lines AS (
          SELECT source || '/' || CAST(doc_id AS varchar) || '.txt' AS file, chunk_index, unnest(l) AS line, unnest(range(len(l))) AS nr
          FROM (SELECT *, regexp_split_to_array(chunk, '{_BREAK}') AS l FROM ({chunk_sql()}))),
        bare AS (SELECT *, regexp_replace(line, '"[^"]*(?:"|$)|''[^'']*(?:''|$)', '', 'g') AS b FROM lines
                 WHERE regexp_matches(line, '[^' || substr('{SPACE}', 2))),
        seps AS (SELECT file, chunk_index, nr, rank, d, length(b) - length(replace(b, d, '')) AS n
                 FROM bare, (SELECT unnest(['|', ',', chr(9), ';']) AS d, unnest([1, 2, 3, 4]) AS rank)),
        counted AS (SELECT file, chunk_index, rank, d, n, count(*) AS rows, min(nr) AS first FROM seps WHERE n >= 2 GROUP BY ALL),
        modal AS (SELECT *, row_number() OVER (PARTITION BY file, chunk_index, rank ORDER BY rows DESC, first) AS k FROM counted),
        best AS (SELECT *, row_number() OVER (PARTITION BY file, chunk_index ORDER BY rows DESC, rank) AS k2
                 FROM modal WHERE k = 1 AND rows >= 4)
        SELECT file, chunk_index AS block_index, d AS delimiter, rows, n + 1 AS columns FROM best WHERE k2 = 1""",
    "customer_tables": f"""
        SELECT size, block, CASE WHEN block % 2 = 0 THEN 'structure.personal_data_export.v1' ELSE 'structure.bulk_data_export.v1' END AS rule_id,
               CASE WHEN block % 2 = 0 THEN 'pii' ELSE 'internal' END AS category,
               CASE WHEN block % 2 = 0 THEN CASE WHEN n >= 10 THEN 'critical' ELSE 'high' END
                    ELSE CASE WHEN n >= 25 THEN 'high' ELSE 'medium' END END AS severity,
               CASE WHEN block % 2 = 0 THEN 88 ELSE 75 END AS confidence,
               CAST(n AS varchar) || ' rows x 5 columns ' || CASE WHEN block % 2 = 0
                 THEN 'naming personal fields (account number, address, email, full name, state) in a user message'
                 ELSE 'of tabular data in a user message' END AS summary
        FROM (SELECT size, c_custkey // size AS block, count(*) + 1 AS n
              FROM customer, (SELECT unnest({list(BLOCKS)}) AS size) GROUP BY ALL)
        WHERE n >= 4""",
    "split_cells": """
        SELECT p_partkey, p_name || '~' || p_brand || '|x~a|b~' || p_type || '~open|' || p_name AS cells,
               p_name || '|||' || p_type || '|' AS bare FROM part""",
    "document_paste": f"""
        WITH t AS (SELECT p_partkey, p_brand, '{HEADING}' || repeat('{CLAUSE}', p_size * 3) || p_name AS text FROM part)
        SELECT p_partkey, 'structure.document_paste.v1' AS rule_id,
               CASE WHEN length(text) >= 10000 THEN 'high' ELSE 'medium' END AS severity, 70 AS confidence,
               'a structured document of roughly ' || format('{{:,}}', len(list_filter(regexp_split_to_array(text, '\\s+'), w -> w <> '')))
               || ' words was pasted into a ' || CASE WHEN p_brand < 'Brand#2' THEN 'user message' ELSE 'attachment' END AS summary
        FROM t WHERE p_brand < 'Brand#23' AND length(text) >= 3000""".replace("w -> w", "lambda w: w"),
    "remote_assets": """
        WITH p AS (SELECT page_id, 1 + length(html) - length(replace(html, chr(10), '')) AS n,
                          '//h' || CAST(page_id AS varchar) || '.net/' AS h FROM pages)
        SELECT page_id, n + 1 AS line, 'https:' || h || 'a.png' AS url, 'remote asset' AS kind FROM p
        UNION ALL SELECT page_id, n + 2, 'http:' || h || 's.css', 'remote stylesheet' FROM p
        UNION ALL SELECT page_id, n + 2, h || 'b.gif', 'remote CSS resource' FROM p
        UNION ALL SELECT page_id, n + 4, 'https:' || h || 'api', 'runtime network call' FROM p
        UNION ALL SELECT page_id, n + 4, 'https:' || h || 'a.png', 'remote asset' FROM p""",
}
