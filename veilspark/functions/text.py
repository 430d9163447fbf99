"""Scalar text functions, all JVM-side column expressions."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable, Iterable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import java_pattern

# What \s stands for in java_pattern, spelled out: Java looks up a listed character much faster than a Unicode property.
_BLANKS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WHITESPACE_RUN = f"[{_BLANKS}]+"
_EDGE_SPACE = java_pattern(r"^\s+|\s+$")
NON_BLANK = f"[^{_BLANKS}]"
# Every boundary that ends a line of text.
_RARE_BREAK = "[\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"

ID_SEPARATOR = "\x1f"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate *value* once and use it several times in *body*.

    Inside a lambda Spark has no common-subexpression elimination, so a value
    needed twice there has to be bound.
    """
    return F.transform(F.array(value), body)[0]


def sql_text(value: str) -> str:
    """*value* as a SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_texts(values: Iterable[str]) -> str:
    return ", ".join(map(sql_text, values))


def not_blank(value: Column) -> Column:
    return value.rlike(NON_BLANK)


def is_ascii(value: Column) -> Column:
    return F.octet_length(value) == F.length(value)


def strip(value: Column) -> Column:
    return F.regexp_replace(value, _EDGE_SPACE, "")


def collapse_whitespace(value: Column) -> Column:
    """Whitespace runs become one space; the ends are left alone."""
    return F.regexp_replace(value, WHITESPACE_RUN, " ")


def compact(value: Column) -> Column:
    """Collapsed and trimmed."""
    return F.trim(collapse_whitespace(value))


# Letters outside ASCII that match an ASCII letter when case is ignored.
_FOLDS_TO_ASCII = (("\u0130", "i"), ("\u0131", "i"), ("\u212a", "k"), ("\u017f", "s"))


def fold(value: Column) -> Column:
    """Lower case as case-insensitive matching sees it."""
    out = value
    for letter, plain in _FOLDS_TO_ASCII:
        out = F.replace(out, F.lit(letter), F.lit(plain))
    return F.when(is_ascii(value), F.lower(value)).otherwise(F.lower(out))


def redact(value: Column) -> Column:
    """Mask a value, keeping just enough to recognise it."""

    def mask(c: Column) -> Column:
        keep = F.when(F.length(c) > 16, F.lit(4)).otherwise(F.lit(2))
        return F.when(F.length(c) <= 6, F.repeat(F.lit("*"), F.length(c))).otherwise(
            F.concat(F.left(c, keep), F.lit("******"), F.right(c, F.lit(2)))
        )

    return let(compact(value), mask)


def characters(value: Column) -> Column:
    """The code points of *value* as an array of one-character strings."""
    return F.when(F.length(value) == 0, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.length(value)), lambda i: F.substring(value, i, F.lit(1)))
    )


def entropy(value: Column) -> Column:
    """Shannon entropy in bits per character; 0 for an empty value."""

    def bits(chars: Column) -> Column:
        return F.aggregate(
            F.array_distinct(chars),
            F.lit(0.0),
            lambda acc, c: let(
                F.size(F.filter(chars, lambda x: x == c)) / F.size(chars),
                lambda p: acc - p * F.log2(p),
            ),
        )

    return let(characters(value), bits)


@lru_cache(maxsize=1)
def _decimal_digits() -> tuple[str, str]:
    """Every non-ASCII decimal digit and the ASCII digit it stands for."""
    chars = [chr(c) for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"]
    return "".join(chars), "".join(str(unicodedata.decimal(c)) for c in chars)


def digits(value: Column) -> Column:
    """The decimal digits of *value*, in ASCII."""
    ascii_digits = F.when(is_ascii(value), value).otherwise(F.translate(value, *_decimal_digits()))
    return F.regexp_replace(ascii_digits, "[^0-9]", "")


def luhn_valid(value: Column) -> Column:
    """At least twelve digits, and they satisfy the Luhn checksum."""
    return let(digits(value), lambda d: (F.length(d) >= 12) & F.call_function("luhn_check", d))


def finding_id(employee: Column, rule_id: Column, value: Column) -> Column:
    """A stable identity for a finding, independent of where it was seen."""
    return F.left(
        F.sha2(F.concat_ws(ID_SEPARATOR, employee, rule_id, compact(value)), 256), F.lit(16)
    )


def location_ref(file: Column, record_index: Column, block_index: Column) -> Column:
    """``file#record.block``."""
    return F.concat(
        file, F.lit("#"), record_index.cast("string"), F.lit("."), block_index.cast("string")
    )


def location_file(ref: Column) -> Column:
    """The part of a location before its first ``#``."""
    return F.substring_index(ref, "#", 1)


def location_record(ref: Column) -> Column:
    """The record number of a location, -1 where it has none."""
    tail = F.when(F.contains(ref, F.lit("#")), F.regexp_replace(ref, "^[^#]*#", "")).otherwise("")
    number = F.substring_index(tail, ".", 1)
    return F.when(number.rlike("^[0-9]+$"), F.coalesce(number.try_cast("bigint"), F.lit(-1))).otherwise(F.lit(-1))


def words(value: Column) -> Column:
    """Number of whitespace-separated words."""
    return F.size(F.filter(F.split(value, WHITESPACE_RUN, -1), lambda w: w != ""))


def split_lines(value: Column) -> Column:
    """The lines of *value*, blank ones included."""
    # One look for the rare line ends is cheaper than splitting on all of them.
    return F.when(value.rlike(_RARE_BREAK), F.split(value, LINE_BREAK, -1)).otherwise(
        F.split(value, "\n", -1)
    )


def lines(value: Column) -> Column:
    """The non-blank lines of *value*."""
    return F.filter(split_lines(value), not_blank)


def spaced(kind: Column) -> Column:
    return F.replace(kind, F.lit("_"), F.lit(" "))


def html_escape(value: Column) -> Column:
    out = value
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def thousands(value: Column) -> Column:
    return F.format_number(value, 0)
