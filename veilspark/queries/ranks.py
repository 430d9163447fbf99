"""The order of findings, people and survey rows, as numbers that can be compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import report
from ..operators.collapse import collapse, ranking
from ..operators.ranks import with_rank
from ..plans import history as store
from . import counting, history


def _findings(spark: SparkSession, d: str) -> DataFrame:
    """Every finding of the report with its place."""
    return with_rank(collapse(counting.order_hits(spark, d)), ranking()).select("rank", "finding_id", "severity")


def _latest(spark: SparkSession, d: str) -> DataFrame:
    """The latest scan as triage lists it."""
    now = store.latest_findings(history._scans(spark, d), history._findings(spark, d))
    shown = store.with_state(now, store.latest_triage(history._log(spark, d)))
    return with_rank(shown, store.worst_order()).select("rank", "scan_id", "finding_id", "employee", "severity", "state")


def _people(spark: SparkSession, d: str) -> DataFrame:
    return with_rank(counting._people(spark, d), report.people_order()).select("rank", "employee", "findings")


def _survey(spark: SparkSession, d: str) -> DataFrame:
    return with_rank(counting._survey(spark, d), report.survey_columns()).select("rank", "dimension", "label", "records")


QUERIES = {
    "ranked_findings": _findings,
    "ranked_latest": _latest,
    "ranked_people": _people,
    "ranked_survey": _survey,
}

_KINDS = "[" + ", ".join(f"'{k}'" for k in report.KINDS) + "]"

SQL = {
    "ranked_findings": f"""
        SELECT row_number() OVER (ORDER BY {counting._RANK}, confidence DESC, employee, location, rule_id, first_seen) AS rank,
               finding_id, severity FROM ({counting._FINDINGS})""",
    "ranked_latest": f"""
        SELECT row_number() OVER (ORDER BY {history._RANK_UP}, confidence DESC, employee, finding_id) AS rank,
               scan_id, finding_id, employee, severity, state FROM ({history.SQL['latest_with_state']})""",
    "ranked_people": f"""
        SELECT row_number() OVER (ORDER BY findings DESC, employee) AS rank, employee, findings
        FROM ({counting.SQL['people_table']})""",
    "ranked_survey": f"""
        SELECT row_number() OVER (ORDER BY dimension, CASE dimension WHEN 'kind' THEN list_position({_KINDS}, label) ELSE 0 END, label) AS rank,
               dimension, label, records FROM ({counting.SQL['survey']})""",
}
