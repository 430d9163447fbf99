"""Counts and tables a report shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import finding_id
from ..rules.model import SEVERITIES, RuleSet
from ..schema import KINDS
from .collapse import ranked

CAVEAT = (
    "Rules see what they were written for. An empty report says that no rule fired on the records "
    "read, no more than that; every finding needs someone to look at it."
)


def record_totals(records: DataFrame) -> DataFrame:
    """One row: records and characters scanned."""
    return records.agg(
        F.count("*").alias("records"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("characters")
    )


def counts_by(findings: DataFrame) -> DataFrame:
    """Findings by employee, category and severity in one pass: ``(dimension, label, n)``."""
    sets = findings.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(d).alias("dimension"), F.col(d).alias("label"))
                    for d in ("employee", "category", "severity")
                ]
            )
        ).alias("g")
    )
    return sets.groupBy("g.dimension", "g.label").agg(F.count("*").alias("n"))


def people(records_or_files: DataFrame) -> DataFrame:
    return records_or_files.select("employee").distinct()


def people_table(everyone: DataFrame, findings: DataFrame) -> DataFrame:
    """Every person with their findings by severity; clean people are kept."""
    by_severity = [
        F.count(F.when(F.col("severity") == s, 1)).alias(s) for s in SEVERITIES
    ]
    counts = findings.groupBy("employee").agg(F.count("*").alias("findings"), *by_severity)
    return (
        everyone.join(counts, "employee", "left").fillna(0)
        .withColumn("clean", F.col("findings") == 0)
        .orderBy(*people_order())
    )


def people_order() -> list[Column]:
    return [F.col("findings").desc(), F.col("employee").asc()]


def clean_people(everyone: DataFrame, findings: DataFrame) -> DataFrame:
    """People without a single finding."""
    return everyone.join(findings.select("employee").distinct(), "employee", "left_anti")


def report_totals(findings: DataFrame, suppressed: DataFrame, everyone: DataFrame) -> DataFrame:
    """One row: findings, suppressed matches, people scanned and people affected."""
    f = findings.agg(
        F.count("*").alias("findings"), F.count_distinct("employee").alias("employees_with_findings")
    )
    s = suppressed.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("suppressed_as_noise"))
    p = everyone.agg(F.count("*").alias("employees_scanned"))
    # One row each.
    return f.crossJoin(s).crossJoin(p)


def survey(records: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """What was read, before any detection: ``(dimension, label, records, characters)``.

    With *files*, people whose files yielded nothing are listed with zero.
    """
    size = F.length("text")
    cuts = records.select(
        size.alias("n_chars"),
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(d).alias("dimension"), F.col(d).alias("label"))
                    for d in ("kind", "employee", "source")
                ]
            )
        ).alias("g"),
    )
    out = cuts.groupBy("g.dimension", "g.label").agg(
        F.count("*").alias("records"), F.sum("n_chars").alias("characters")
    )
    if files is None:
        return out
    silent = people(files).select(
        F.lit("employee").alias("dimension"), F.col("employee").alias("label")
    ).join(out, ["dimension", "label"], "left_anti")
    return out.unionByName(
        silent.withColumn("records", F.lit(0).cast("bigint")).withColumn("characters", F.lit(0).cast("bigint"))
    )


def survey_columns() -> list[Column]:
    position = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("label"))
    return [
        F.col("dimension").asc(), F.when(F.col("dimension") == "kind", position).otherwise(F.lit(0)).asc(),
        F.col("label").asc(),
    ]


def survey_order(table: DataFrame) -> DataFrame:
    """Kinds in their own order, everything else by name."""
    return table.orderBy(*survey_columns())


def report_findings(findings: DataFrame, *, reveal: bool = False) -> DataFrame:
    """Findings as a report lists them; the raw value only on request."""
    columns = [
        "finding_id", "rule_id", "category", "subtype", "severity", "confidence", "employee", "session_id", "source",
        F.col("kind").alias("location_kind"), "location", "occurrences",
        *[c for c in ("also_at_count", "also_at") if c in findings.columns],
        "value_redacted", "snippet",
    ]
    if reveal:
        columns.append("value")
    return ranked(findings).select(*columns)


def write_report(
    path: str, *, findings: DataFrame, everyone: DataFrame, suppressed: DataFrame, totals: DataFrame,
    ruleset: RuleSet, root: str, started_at: str, finished_at: str,
    skipped: DataFrame | None = None, problems: DataFrame | None = None, seen: DataFrame | None = None,
    reveal: bool = False,
) -> None:
    """Write the report as a folder of JSON datasets under *path*.

    ``summary`` is one row; the lists that grow with the data are datasets of
    their own, written by the executors.  *seen* are the sightings of the scan:
    every later place of every finding, whatever ``also_at`` has room for.
    """
    parts = {
        "findings": report_findings(findings, reveal=reveal),
        "employees": people_table(everyone, findings),
        "suppressed": suppressed.orderBy("suppressed_by"),
        "counts": counts_by(findings),
    }
    if seen is not None:
        parts["sightings"] = seen.select(
            finding_id(F.col("employee"), F.col("rule_id"), F.col("value_key")).alias("finding_id"),
            "employee", "rule_id", "location", "at",
        )
    if skipped is not None:
        parts["skipped_files"] = skipped
    if problems is not None:
        parts["parse_problems"] = problems
    for name, part in parts.items():
        part.write.mode("overwrite").json(f"{path}/{name}")
    summary = report_totals(findings, suppressed, everyone).crossJoin(totals).select(
        "*",
        F.lit(root).alias("root"), F.lit(started_at).alias("started_at"), F.lit(finished_at).alias("finished_at"),
        F.lit("revealed" if reveal else "redacted").alias("redaction"),
        F.array(*[F.lit(p) for p in sorted(ruleset.packs)]).alias("rule_packs"),
        F.lit(len(ruleset.rules)).alias("rules"), F.lit(len(ruleset.suppressors)).alias("suppressors"),
        F.lit(CAVEAT).alias("caveat"),
    )
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")
