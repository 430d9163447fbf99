"""What a browser would fetch from elsewhere when it opens a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.regex import java_pattern
from ..functions.text import let

# Loading contexts in order of precedence.
_URL = r"""((?:https?:)?//[^"'\s>)]+)"""
CONTEXTS = (
    ("remote asset",
     r"""(?i)\b(?:src|href|action|formaction|poster|srcset|manifest|data)\s*=\s*["']?\s*""" + _URL),
    ("remote stylesheet", r"""(?i)@import\s+(?:url\()?\s*["']?\s*""" + _URL),
    ("remote CSS resource", r"""(?i)\burl\(\s*["']?\s*""" + _URL),
    ("runtime network call",
     r"""(?i)\b(?:fetch|XMLHttpRequest|WebSocket|EventSource|importScripts|sendBeacon)\b[^;\n]{0,120}?["']\s*"""
     + _URL),
)

# Marks around a URL: code points that stand for no character.
OPEN, CLOSE = "\ufdd0", "\ufdd1"


def _references(markup: Column, rank: int, pattern: str) -> Column:
    """One pass marks each URL at the line its context starts in; the lines are then looked through."""
    marked = F.regexp_replace(markup, F.lit(java_pattern(pattern)), F.lit(f"{OPEN}$1{CLOSE}$0"))
    lines = F.transform(F.split(marked, "\n", -1), lambda text, i: F.struct(i.alias("i"), text.alias("text")))
    return F.flatten(F.transform(
        F.filter(lines, lambda at: F.contains(at["text"], F.lit(OPEN))),
        lambda at: F.transform(
            F.regexp_extract_all(at["text"], F.lit(f"{OPEN}([^{CLOSE}]+){CLOSE}"), F.lit(1)),
            lambda url: F.struct((at["i"] + 1).alias("line"), url.alias("url"), F.lit(rank).alias("rank")),
        ),
    ))


def _first_of_each(references: Column) -> Column:
    """The lowest rank of each line and URL."""
    return let(F.array_sort(references), lambda ordered: F.filter(
        ordered, lambda r, i: (i == 0) | (F.get(ordered, i - 1)["line"] != r["line"]) | (F.get(ordered, i - 1)["url"] != r["url"])))


def remote_assets(pages: DataFrame, *, key: str = "page_id", markup: str = "html") -> DataFrame:
    """``(key, line, url, kind)``, one row per row of *pages*, line and URL.

    The contexts overlap; the first that fits names the kind.  All work stays in the page's row.
    """
    text = F.translate(F.col(markup), OPEN + CLOSE, "\ufffd\ufffd")
    listed = F.concat(*[_references(text, i, p) for i, (_, p) in enumerate(CONTEXTS)])
    kinds = F.array(*[F.lit(k) for k, _ in CONTEXTS])
    return (
        pages.where(F.contains(F.col(markup), F.lit("//")))
        .select(key, F.explode(_first_of_each(listed)).alias("r"))
        .select(key, F.col("r.line").alias("line"), F.col("r.url").alias("url"), kinds[F.col("r.rank")].alias("kind"))
    )
