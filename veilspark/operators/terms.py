"""Terms of a table, as many as there are, looked for in records as whole words.

The same matches as ``rules.model.with_terms`` gives with one alternation of all terms,
which Spark could not compile for a hundred thousand of them.  A term can only stand
where all of its words stand, so it is looked for by its rarest one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.joins import key_filter, may_hold, shuffled, split_join
from ..functions.regex import java_pattern
from ..functions.spans import match_positions
from ..functions.text import let
from ..schema import ref
from .detect import MARK

_WORD = java_pattern(r"\w+")
_HOLE = "0123456789"
_OPEN, _CLOSE = java_pattern(rf"(?i)\b(?:{_HOLE})\b").split(_HOLE)
_ROW = ["file", "record_index", "emit_seq"]


def _words(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)), F.lower))


def anchors(terms: DataFrame) -> DataFrame:
    """``(word, term)``: each term under the one of its words that fewest terms have.

    Null and blank terms, repeats in other case and terms without a single letter,
    digit or underscore are left out.
    """
    known = terms.select(F.col("term").cast("string").alias("term")).where(F.col("term").rlike(_WORD)).groupBy(
        F.lower("term").alias("lowered")).agg(F.min("term").alias("term"))
    words = known.select("term", F.explode(_words(F.col("term"))).alias("word"))
    common = words.groupBy("word").agg(F.count("*").alias("n"))
    return split_join(words, common, ["word"]).groupBy("term").agg(F.min(F.struct("n", "word")).alias("a")).select("a.word", "term")


def term_matches(records: DataFrame, terms: DataFrame) -> DataFrame:
    """``(employee, location, start, value)`` of every match of ``terms(term)`` in *records*.

    Of a record only distinct words that are some term's rarest are shuffled, beside a hash of
    its key, until the terms that it may hold are known; its text then meets these alone, so
    records that share a hash lose and gain nothing.  Of terms at one place the longest counts,
    and matches do not overlap, as with one alternation.  What is gathered for a record
    are the terms whose rarest word it has.  Null or empty texts hold nothing; a record
    that repeats is matched each time, one without a whole key is not matched.
    """
    known, row = anchors(terms), F.xxhash64(*_ROW).alias("_row")
    keyed = records.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in _ROW]))
    words = keyed.select(row, F.explode(_words(F.col("text"))).alias("word")).where(
        may_hold(key_filter(known, "word"), F.col("word")))
    near = split_join(words, known, ["word"]).groupBy("_row").agg(F.collect_set("term").alias("near"))
    met = keyed.select("employee", ref().alias("location"), row, "text").join(shuffled(near), "_row")
    # one expression and no filter below it, so that nothing is worked out twice
    low = F.lower("text")
    held = let(low, lambda t: F.filter("near", lambda n: F.contains(t, F.lower(n))))
    found = let(held, lambda n: F.when(F.size(n) > 0, let(_alternation(n), _matches)))
    return met.select("employee", "location", F.explode_outer(found).alias("m")).where(F.col("m").isNotNull()).select(
        "employee", "location", F.col("m.span.s").alias("start"), F.col("m.value").alias("value"))


def _alternation(terms: Column) -> Column:
    longest = F.array_sort(F.transform(terms, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("term"))))
    escaped = F.transform(longest, lambda t: F.regexp_replace(t["term"], r"([^\p{L}\p{N}_\s])", r"\\$1"))
    return F.concat(F.lit(_OPEN), F.array_join(escaped, "|"), F.lit(_CLOSE))


def _matches(pattern: Column) -> Column:
    """``span`` and ``value`` of each match in ``text``; null if there is none."""
    text = F.col("text")
    # One pass sets matches between marks; a text that holds the mark itself is searched, then split.
    marked = F.split(F.regexp_replace(text, pattern, F.lit(f"{MARK}$0{MARK}")), MARK, -1)
    found = F.when(F.contains(text, F.lit(MARK)), F.struct(
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("values"), F.split(text, pattern, -1).alias("gaps"))).otherwise(
        let(marked, lambda parts: F.struct(
            F.filter(parts, lambda _, i: i % 2 == 1).alias("values"), F.filter(parts, lambda _, i: i % 2 == 0).alias("gaps"))))
    return let(found, lambda f: F.when(F.size(f["values"]) > 0, F.zip_with(
        match_positions(f["values"], f["gaps"]), f["values"], lambda s, v: F.struct(s.alias("span"), v.alias("value")))))
