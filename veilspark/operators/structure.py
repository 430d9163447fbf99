"""Findings from the shape of a text, without any vocabulary.

Three detectors, each a column over one records row that yields an array of
signals: a pasted table, a table whose header names personal fields (the two
exclude each other) and a structured document.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.regex import found
from ..functions.text import let, lines, not_blank, spaced, split_lines, strip, thousands, words

# Fixed values.
MIN_TABLE_ROWS = 4
MIN_TABLE_SEPARATORS = 2
MIN_PERSONAL_FIELDS = 3
MIN_DOCUMENT_CHARS = 3_000
LONG_DOCUMENT_CHARS = 10_000
MIN_DOCUMENT_MARKERS = 3
PERSONAL_ROWS_CRITICAL = 10
TABLE_ROWS_HIGH = 25
DELIMITERS = ("|", ",", "\t", ";")

# Column names that mean a row is about a person.
PERSONAL_FIELDS = (
    "name", "first name", "firstname", "first_name", "last name", "lastname",
    "last_name", "surname", "full name", "fullname", "full_name",
    "dob", "date of birth", "date_of_birth", "birth date", "birthdate",
    "email", "e-mail", "email address", "email_address",
    "phone", "telephone", "mobile", "phone number", "phone_number",
    "address", "home address", "street", "postcode", "post code", "zip",
    "zipcode", "zip code", "city", "town", "county", "state", "country",
    "salary", "pay", "wage", "gross pay", "net pay", "annual salary",
    "national insurance", "ni number", "ni_number", "nino", "ssn",
    "social security", "nhs number", "nhs_number", "passport",
    "national id", "id number", "employee id", "employee_id", "staff id",
    "customer id", "patient id", "student id", "account number", "iban",
    "sort code", "sort_code", "bank account", "card number",
    "gender", "sex", "ethnicity", "nationality", "marital status",
    "next of kin", "emergency contact", "job title", "department",
    "start date", "end date", "manager",
)

# What makes a long text a document.
DOCUMENT_MARKERS = (
    r"(?m)^\s*\d+(?:\.\d+)*[.)]\s+\S",
    r"(?m)^\s*[-*•]\s+\S",
    r"(?m)^[A-Z][A-Z \t&/'-]{6,}$",
    r"(?m)^\s*(?:[A-Z][\w '-]{2,40}):\s*$",
    r"\n\s*\n",
)

# Rule id, category, subtype, confidence.
PERSONAL_EXPORT = ("structure.personal_data_export.v1", "pii", "personal_data_export", 88)
BULK_EXPORT = ("structure.bulk_data_export.v1", "internal", "bulk_data_export", 75)
DOCUMENT_PASTE = ("structure.document_paste.v1", "internal", "document_paste", 70)

SIGNAL = (
    "struct<rule_id:string,category:string,subtype:string,severity:string,"
    "confidence:int,summary:string>"
)

# A quote runs to its partner, or to the end of the line without one.
_QUOTED = "\"[^\"]*(?:\"|$)|'[^']*(?:'|$)"
_QUOTED_OR_PLAIN = _QUOTED + "|[^\"']+"
_CELL_END = "\uffff"


def unquoted(line: Column) -> Column:
    """*line* without its quoted parts."""
    quotes = F.contains(line, F.lit('"')) | F.contains(line, F.lit("'"))
    return F.when(quotes, F.regexp_replace(line, _QUOTED, "")).otherwise(line)


def count_outside_quotes(line: Column, delimiter: str) -> Column:
    return let(unquoted(line), lambda bare: _separators(bare, delimiter))


def split_outside_quotes(line: Column, delimiter: Column) -> Column:
    """Cells of *line*; quotes are dropped, what they hold is kept."""

    def piece(p: Column) -> Column:
        return F.when(
            p.startswith('"'), F.replace(p, F.lit('"'), F.lit(""))
        ).when(
            p.startswith("'"), F.replace(p, F.lit("'"), F.lit(""))
        ).otherwise(F.replace(p, delimiter, F.lit(_CELL_END)))

    pieces = F.regexp_extract_all(line, F.lit(_QUOTED_OR_PLAIN), F.lit(0))
    return F.split(F.array_join(F.transform(pieces, piece), ""), _CELL_END, -1)


def _most_common(counts: Column) -> Column:
    """``(n, value)`` of the most frequent count; the first seen wins a tie."""
    return F.aggregate(
        F.array_distinct(counts),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("value")),
        lambda best, v: let(
            F.size(F.filter(counts, lambda c: c == v)),
            lambda n: F.when(
                n > best["n"], F.struct(n.alias("n"), v.cast("int").alias("value"))
            ).otherwise(best),
        ),
    )


def _enough(text: Column, delimiter: str) -> Column:
    """Enough of a delimiter, which takes one byte, for the smallest table."""
    bytes_ = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(delimiter), F.lit("")))
    return bytes_ >= MIN_TABLE_ROWS * MIN_TABLE_SEPARATORS


def _separators(bare: Column, delimiter: str | Column) -> Column:
    d = F.lit(delimiter) if isinstance(delimiter, str) else delimiter
    return F.length(bare) - F.length(F.replace(bare, d, F.lit("")))


def _candidate(bare_rows: Column, text: Column, delimiter: str) -> Column:
    """The table one delimiter makes, or NULL."""
    # Only a line of tabs can be blank and still have separators.
    rows = F.filter(bare_rows, not_blank) if delimiter == "\t" else bare_rows
    counts = F.filter(
        F.transform(rows, lambda u: _separators(u, delimiter)),
        lambda n: n >= MIN_TABLE_SEPARATORS,
    )
    table = let(
        let(counts, _most_common),
        lambda m: F.when(
            m["n"] >= MIN_TABLE_ROWS,
            F.struct(
                F.lit(delimiter).alias("delimiter"),
                m["n"].alias("rows"),
                (m["value"] + 1).alias("columns"),
            ),
        ),
    )
    return F.when(_enough(text, delimiter), table)


def table_shape(text: Column) -> Column:
    """``(delimiter, rows, columns)`` of the strongest table in *text*, or NULL."""

    def shape(rows: Column) -> Column:
        bare = F.transform(rows, unquoted)

        def best_of(bare_rows: Column) -> Column:
            none = F.lit(None).cast("struct<delimiter:string,rows:int,columns:int>")
            return F.aggregate(
                F.array(*[_candidate(bare_rows, text, d) for d in DELIMITERS]),
                none,
                lambda best, c: F.when(
                    c.isNotNull() & (best.isNull() | (c["rows"] > best["rows"])), c
                ).otherwise(best),
            )

        return F.when(F.size(rows) >= MIN_TABLE_ROWS, let(bare, best_of))

    # A text that holds too few of every delimiter is not split into lines.
    delimited = reduce(lambda a, b: a | b, (_enough(text, d) for d in DELIMITERS))
    return F.when(delimited, let(split_lines(text), shape))


def personal_fields(line: Column, delimiter: Column) -> Column:
    """The distinct personal field names among the cells of *line*."""
    cells = F.transform(split_outside_quotes(line, delimiter), lambda c: F.lower(strip(c)))
    return F.array_intersect(F.array_distinct(cells), F.array(*[F.lit(f) for f in PERSONAL_FIELDS]))


def personal_header(text: Column, delimiter: Column) -> Column:
    """Sorted personal fields of the first line that names enough of them."""

    def fields(line: Column) -> Column:
        enough = let(unquoted(line), lambda bare: _separators(bare, delimiter)) \
            >= MIN_PERSONAL_FIELDS - 1
        return F.when(enough, personal_fields(line, delimiter))

    named = F.filter(
        F.transform(lines(text), fields), lambda f: F.size(f) >= MIN_PERSONAL_FIELDS
    )
    return F.array_sort(F.try_element_at(named, F.lit(1)))


def _signal(rule: tuple, severity: Column, summary: Column) -> Column:
    rule_id, category, subtype, confidence = rule
    return F.struct(
        F.lit(rule_id).alias("rule_id"),
        F.lit(category).alias("category"),
        F.lit(subtype).alias("subtype"),
        severity.alias("severity"),
        F.lit(confidence).alias("confidence"),
        summary.alias("summary"),
    )


def _nothing() -> Column:
    return F.array().cast(f"array<{SIGNAL}>")


def tabular(text: Column, kind: Column) -> Column:
    def signal(shape: Column) -> Column:
        size = F.concat(
            shape["rows"].cast("string"), F.lit(" rows x "),
            shape["columns"].cast("string"), F.lit(" columns"),
        )

        def choose(named: Column) -> Column:
            about_people = _signal(
                PERSONAL_EXPORT,
                F.when(shape["rows"] >= PERSONAL_ROWS_CRITICAL, "critical").otherwise("high"),
                F.concat(
                    size, F.lit(" naming personal fields ("),
                    F.array_join(F.slice(named, 1, 5), ", "), F.lit(") in a "), spaced(kind),
                ),
            )
            plain = _signal(
                BULK_EXPORT,
                F.when(shape["rows"] >= TABLE_ROWS_HIGH, "high").otherwise("medium"),
                F.concat(size, F.lit(" of tabular data in a "), spaced(kind)),
            )
            return F.when(F.size(named) > 0, F.array(about_people)).otherwise(F.array(plain))

        return F.when(
            shape.isNotNull(), let(personal_header(text, shape["delimiter"]), choose)
        ).otherwise(_nothing())

    return let(table_shape(text), signal)


def document(text: Column, kind: Column) -> Column:
    long_enough = kind.isin("user_message", "attachment") & (F.length(text) >= MIN_DOCUMENT_CHARS)
    markers = sum((found(text, m).cast("int") for m in DOCUMENT_MARKERS), F.lit(0))
    signal = _signal(
        DOCUMENT_PASTE,
        F.when(F.length(text) >= LONG_DOCUMENT_CHARS, "high").otherwise("medium"),
        F.concat(
            F.lit("a structured document of roughly "), thousands(words(text)),
            F.lit(" words was pasted into a "), spaced(kind),
        ),
    )
    # CASE, not AND: the markers are only looked for in long texts.
    return F.when(
        F.when(long_enough, markers >= MIN_DOCUMENT_MARKERS).otherwise(False), F.array(signal)
    ).otherwise(_nothing())


#: Add a function of ``(text, kind)`` that returns an array of signals.
DETECTORS: dict[str, Callable[[Column, Column], Column]] = {
    "tabular": tabular,
    "document": document,
}


def signals(text: Column, kind: Column) -> Column:
    """Every structural signal of one row, in registry order."""
    return F.concat(*[detector(text, kind).cast(f"array<{SIGNAL}>") for detector in DETECTORS.values()])
