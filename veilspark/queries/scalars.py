"""Scalar functions over whole columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..plans.transcripts import keyed
from .common import SPACE, luhn_sql, redact_sql, table


def _redact(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", t.redact(F.col("text")).alias("masked"))


def _entropy(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(
        "conv_id", "turn", F.round(t.entropy(F.col("text")), 6).alias("bits")
    )


def _luhn(spark: SparkSession, d: str) -> DataFrame:
    number = F.concat(
        F.lit("4539 "), F.lpad(F.col("o_custkey").cast("string"), 5, "0"), F.lit("-"),
        F.lpad(F.col("o_orderkey").cast("string"), 7, "0"),
    )
    return table(spark, d, "orders").select("o_orderkey", t.luhn_valid(number).alias("valid"))


def _finding_id(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(
        "doc_id", t.finding_id(F.col("source"), F.lit("rule.v1"), F.col("text")).alias("finding_id")
    )


def _location(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select(
        "page_id", t.location_ref(F.col("url"), F.col("page_id"), F.lit(3)).alias("ref")
    )
    return pages.select(
        "page_id", "ref", t.location_file(F.col("ref")).alias("file"), t.location_record(F.col("ref")).alias("record")
    )


def _measures(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id", t.words(text).alias("words"), F.size(t.lines(text)).alias("lines"),
        F.length(t.collapse_whitespace(text)).alias("collapsed"), F.length(t.compact(text)).alias("compacted"),
        t.thousands(F.length(text)).alias("shown"),
    )


def _escape(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.md5(t.html_escape(F.col("html")).cast("binary")).alias("safe"))


QUERIES = {
    "redact_text": _redact,
    "entropy_bits": _entropy,
    "luhn_valid": _luhn,
    "finding_id": _finding_id,
    "location_parts": _location,
    "text_measures": _measures,
    "html_escape": _escape,
}

_SQUEEZED = f"regexp_replace(text, '{SPACE}+', ' ', 'g')"

SQL = {
    "redact_text": f"SELECT doc_id, {redact_sql('text')} AS masked FROM documents",
    "entropy_bits": """
        SELECT conv_id, turn, round(-sum(n / total * log2(n / total)), 6) AS bits
        FROM (SELECT conv_id, turn, c, CAST(count(*) AS double) AS n, any_value(total) AS total
              FROM (SELECT conv_id, turn, unnest(string_split(text, '')) AS c, CAST(length(text) AS double) AS total
                    FROM conversations)
              GROUP BY conv_id, turn, c)
        GROUP BY conv_id, turn""",
    "luhn_valid": f"""
        SELECT o_orderkey, {luhn_sql('digits')} AS valid
        FROM (SELECT o_orderkey, '4539' || lpad(CAST(o_custkey AS varchar), 5, '0')
                     || lpad(CAST(o_orderkey AS varchar), 7, '0') AS digits FROM orders)""",
    "finding_id": f"""
        SELECT doc_id, left(sha256(source || chr(31) || 'rule.v1' || chr(31) || trim({_SQUEEZED})), 16) AS finding_id
        FROM documents""",
    "location_parts": """
        SELECT page_id, ref, split_part(ref, '#', 1) AS file,
               coalesce(CASE WHEN regexp_matches(tail, '^[0-9]+(\\.|$)')
                    THEN TRY_CAST(split_part(tail, '.', 1) AS int) END, -1) AS record
        FROM (SELECT *, regexp_replace(ref, '^[^#]*#', '') AS tail
              FROM (SELECT page_id, url || '#' || CAST(page_id AS varchar) || '.3' AS ref FROM pages))""",
    "text_measures": f"""
        SELECT doc_id,
               len(list_filter(regexp_split_to_array(text, '{SPACE}+'), lambda w: w <> '')) AS words,
               len(list_filter(regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x{{0b}}\\x{{0c}}\\x{{1c}}-\\x{{1e}}\\x{{85}}\\x{{2028}}\\x{{2029}}]'),
                   lambda l: regexp_matches(l, '[^' || substr('{SPACE}', 2)))) AS lines,
               length({_SQUEEZED}) AS collapsed, length(trim({_SQUEEZED})) AS compacted,
               format('{{:,}}', length(text)) AS shown
        FROM documents""",
    "html_escape": """
        SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'),
               '"', '&quot;'), '''', '&#x27;')) AS safe FROM pages""",
}
