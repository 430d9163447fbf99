"""Labelled transcripts as files of the three formats, with the places where values were written.

A file is one row, written by the task that holds it, and as long as its templates:
nothing is gathered over files.  Labels are made from the same positions as the text,
never read back from it, so a reader that counts differently shows up as lost recall.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import sql_text
from ..rules.model import RuleSet, load_rules
from .transcripts import CONTROL_TEXT, TRANSCRIPT, Template

FORMATS = ("session_log", "account_export", "plain_text")
_PLACES = {"session_log": "log.jsonl", "account_export": "conversations.json", "plain_text": "tool-results/notes.txt"}

#: Harmless turns before each planted one: as many as the key says, below this number.
FILLERS = 3


def _texts(templates: list[Template]) -> Column:
    """What is said in turn: the planted texts."""
    return F.array(*[F.expr(f"{sql_text(t.before)} || {t.value} || {sql_text(t.after)}") for t in templates])


def _turns(texts: Column, key: Column) -> Column:
    """Planted texts as turns, fillers before each of them."""
    fillers = F.sequence(F.lit(1), F.pmod(key, F.lit(FILLERS)).cast("int"))
    filler = F.transform(
        F.when(F.pmod(key, F.lit(FILLERS)) > 0, fillers).otherwise(F.array().cast("array<int>")),
        lambda i: F.concat(F.lit("step "), i.cast("string"), F.lit(" is \"done\"\\ok\tand \u2713")))
    return F.flatten(F.transform(texts, lambda t: F.concat(filler, F.array(t))))


def _session_log(person: Column, turns: Column) -> Column:
    """A summary, a blank line, a system line, then a line a turn: results, calls and plain messages by turns."""
    def said(role: str, block: Column) -> Column:
        return F.struct(F.lit(role).alias("type"), person.alias("sessionId"), F.lit("2026-05-01T08:00:00Z").alias("timestamp"),
                        F.struct(F.lit(role).alias("role"), F.array(block).alias("content")).alias("message"))

    def line(text: Column, i: Column) -> Column:
        result = F.to_json(said("user", F.struct(F.lit("tool_result").alias("type"), text.alias("content"))))
        listed = F.to_json(said("user", F.struct(F.lit("tool_result").alias("type"), F.array(
            F.struct(F.lit("text").alias("type"), text.alias("text"))).alias("content"))))
        return F.when(i % 2 == 0, result).otherwise(listed)

    summary = F.to_json(F.struct(F.lit("summary").alias("type"), F.lit("quiet day").alias("summary")))
    system = F.to_json(F.struct(F.lit("system").alias("type"), F.lit("be brief").alias("content")))
    return F.array_join(F.concat(F.array(summary, F.lit(""), system), F.transform(turns, line)), "\n")


def _account_export(person: Column, turns: Column) -> Column:
    """Two conversations, the first one of two harmless messages; every other turn comes as an attachment."""
    nothing = F.array().cast("array<struct<file_name:string,extracted_content:string>>")

    def message(text: Column, i: Column) -> Column:
        plain = i % 2 == 0
        return F.struct(
            F.when(plain, "human").otherwise("assistant").alias("sender"),
            F.lit("2026-05-01T08:00:00Z").alias("created_at"),
            F.when(plain, text).otherwise("see file").alias("text"),
            F.when(plain, nothing).otherwise(
                F.array(F.struct(F.lit("notes.txt").alias("file_name"), text.alias("extracted_content")))).alias("attachments"))

    def conversation(name: str, texts: Column) -> Column:
        return F.struct(F.concat(person, F.lit(f"-{name}")).alias("uuid"), F.lit(name).alias("name"),
                        F.transform(texts, message).alias("chat_messages"))

    return F.to_json(F.array(conversation("first", F.array(F.lit("hello"), F.lit("good day"))), conversation("second", turns)))


#: Records before the first turn, by format; a text is one record of its own.
_BEFORE = {"session_log": 3, "account_export": 2}


def _files(keys: DataFrame, person: Column, texts: Column) -> DataFrame:
    """``(key, tag, format, path, employee, content)``: a file a key, formats in turn."""
    form = F.element_at(F.array(*[F.lit(f) for f in FORMATS]), (F.pmod("key", F.lit(len(FORMATS))) + 1).cast("int"))
    name = F.lit(None).cast("string")
    for f, place in _PLACES.items():
        name = F.when(F.col("format") == f, place).otherwise(name)
    turns = _turns(texts, F.floor(F.col("key") / len(FORMATS)))
    return keys.select("key", "tag", form.alias("format"), person.alias("employee")).withColumn("turns", turns).select(
        "key", "tag", "format", "employee", F.concat("employee", F.lit("/"), name).alias("path"),
        F.when(F.col("format") == "session_log", _session_log(F.col("employee"), F.col("turns")))
        .when(F.col("format") == "account_export", _account_export(F.col("employee"), F.col("turns")))
        .otherwise(F.array_join("turns", "\n")).cast("binary").alias("content"))


def transcript_files(keys: DataFrame, templates: list[Template] = TRANSCRIPT) -> DataFrame:
    """Files ``(key, tag, format, path, employee, content)`` that hold every template.

    Keys say who and which format; a null key has no file, a key that repeats writes the
    same file again.
    """
    known = keys.where("key IS NOT NULL AND tag IS NOT NULL")
    return _files(known, F.concat(F.lit("p"), F.col("key").cast("string")), _texts(templates))


def control_files(keys: DataFrame) -> DataFrame:
    """Files of people who leaked nothing."""
    known = keys.where("key IS NOT NULL AND tag IS NOT NULL")
    text = F.concat(F.lit(CONTROL_TEXT), F.lit("build "), F.col("key").cast("string"))
    return _files(known, F.concat(F.lit("control"), F.col("key").cast("string")), F.array(text))


def file_plants(
    files: DataFrame, templates: list[Template] = TRANSCRIPT, ruleset: RuleSet | None = None
) -> DataFrame:
    """Labels of :func:`transcript_files`, each with the record it was written to."""
    by_id = {r.id: r for r in (ruleset or load_rules()).rules}
    labels = F.array(*[
        F.struct(
            F.lit(i).alias("nth"), F.lit(by_id[t.rule_id].category).alias("category"),
            F.lit(by_id[t.rule_id].subtype).alias("subtype"), F.lit(by_id[t.rule_id].severity).alias("severity"),
            F.expr(t.value).alias("value"))
        for i, t in enumerate(templates)])
    before = F.when(F.col("format") == "plain_text", None)
    for form, n in _BEFORE.items():
        before = F.when(F.col("format") == form, n).otherwise(before)
    fillers = F.pmod(F.floor(F.col("key") / len(FORMATS)), F.lit(FILLERS))
    turn = (F.col("p.nth") + 1) * (fillers + 1) - 1
    return files.select("key", "format", "employee", "path", F.explode(labels).alias("p")).select(
        (F.col("key") * 1000 + F.col("p.nth")).alias("plant_id"), "employee", F.col("path").alias("file"),
        F.coalesce(before + turn, F.lit(0)).cast("bigint").alias("record_index"),
        "p.category", "p.subtype", "p.severity", "p.value", "format",
    )
