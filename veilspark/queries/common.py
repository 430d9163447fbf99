"""Helpers shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import read_table, spread

# What the engine means by whitespace, spelled out for RE2.
SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spread(read_table(spark, folder, name))


def quoted(value: str) -> str:
    """*value* as a standard SQL literal."""
    return "'" + value.replace("'", "''") + "'"


def chunk_sql(columns: str = "", size: int = 8000, step: int = 7800) -> str:
    """SQL for the document chunks: ``doc_id, source, chunk_index, chunk``."""
    return f"""
      SELECT doc_id, source, i AS chunk_index, substring(text, CAST(i * {step} + 1 AS bigint), {size}) AS chunk
      FROM (SELECT *, unnest(range(CAST(greatest(0, ceil((length(text) - {size}) / {step}.0)) AS bigint) + 1)) AS i
            FROM documents)
      WHERE regexp_matches(substring(text, CAST(i * {step} + 1 AS bigint), {size}), '[^' || substr('{SPACE}', 2))
    """


def redact_sql(value: str) -> str:
    """SQL masking of an expression."""
    c = f"trim(regexp_replace({value}, '{SPACE}+', ' ', 'g'))"
    return (
        f"CASE WHEN length({c}) <= 6 THEN repeat('*', length({c})) "
        f"WHEN length({c}) > 16 THEN left({c}, 4) || '******' || right({c}, 2) "
        f"ELSE left({c}, 2) || '******' || right({c}, 2) END"
    )


def luhn_sql(digits: str) -> str:
    """SQL Luhn check of an expression that yields ASCII digits."""
    d = f"CAST(substr(reverse({digits}), CAST(i AS bigint), 1) AS int)"
    doubled = f"(CASE WHEN 2 * {d} > 9 THEN 2 * {d} - 9 ELSE 2 * {d} END)"
    return (
        f"(length({digits}) >= 12 AND list_sum(list_transform(range(1, length({digits}) + 1), "
        f"lambda i: CASE WHEN i % 2 = 0 THEN {doubled} ELSE {d} END)) % 10 = 0)"
    )


def matches_sql(source: str, keys: str, pattern: str) -> str:
    """SQL for ``keys, text, i, value, s, e`` of every match of an RE2 pattern."""
    p = quoted(pattern)
    return f"""
      SELECT {keys}, text, i, m[i] AS value,
             CAST(coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0)
                  + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS bigint) AS s,
             CAST(coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0)
                  + coalesce(list_sum(list_transform(m[1:i], lambda x: length(x))), 0) AS bigint) AS e
      FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i
            FROM (SELECT {keys}, text, regexp_extract_all(text, {p}) AS m, regexp_split_to_array(text, {p}) AS g
                  FROM ({source}) WHERE regexp_matches(text, {p})))"""


def window_sql(margin: int) -> str:
    """SQL for the text around a match of :func:`matches_sql`."""
    return (
        f"substring(text, CAST(greatest(s - {margin}, 0) + 1 AS bigint), "
        f"CAST(e + {margin} - greatest(s - {margin}, 0) AS bigint))"
    )


def suppressed_sql(ruleset, category: str) -> str:
    """SQL for the first bundled suppressor that covers a match, or NULL."""
    out = "CASE"
    for s in ruleset.suppressors:
        if s.covers(category):
            subject = "value" if s.scope == "value" else window_sql(200)
            out += f" WHEN regexp_matches({subject}, {quoted(s.pattern)}) THEN {quoted(s.id)}"
    return out + " END"
