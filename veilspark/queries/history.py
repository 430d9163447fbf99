"""Stored scans, triage, trends and purge."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import finding_id
from ..operators.collapse import collapse, keep_last
from ..plans import history
from ..plans.staging import shared_folder, stage
from .common import table
from .counting import _FINDINGS, _HITS, _by_priority, _case, order_hits


def _scans(spark: SparkSession, d: str) -> DataFrame:
    """A scan per month of orders, and one per nation that found nothing."""
    orders = table(spark, d, "orders")
    month = F.year("o_orderdate") * 100 + F.month("o_orderdate")
    months = orders.select(month.cast("bigint").alias("scan_id")).distinct()
    silent = table(spark, d, "nation").select((F.col("n_nationkey") + 1000).cast("bigint").alias("scan_id"))
    return months.unionByName(silent).withColumn("finished_at", F.concat(F.lit("at "), F.col("scan_id").cast("string")))


def _findings(spark: SparkSession, d: str) -> DataFrame:
    """What each month's scan stored: one row per customer and priority."""
    orders = table(spark, d, "orders")
    month = (F.year("o_orderdate") * 100 + F.month("o_orderdate")).cast("bigint")
    person = F.concat(F.lit("e"), (F.col("o_custkey") % 30).cast("string"))
    value = F.concat(F.lit("v"), (F.col("o_custkey") % 500).cast("string"))
    return orders.groupBy(
        month.alias("scan_id"), person.alias("employee"), F.col("o_orderpriority"),
        finding_id(person, F.col("o_orderpriority"), value).alias("finding_id"),
    ).agg(F.count("*").alias("occurrences")).select(
        "scan_id", "employee", "finding_id", "occurrences", _by_priority(1).alias("severity"),
        _by_priority(3).alias("confidence"),
    )


def _log(spark: SparkSession, d: str) -> DataFrame:
    """Triage entries: several per finding, and some for findings nobody has."""
    states = F.array(*[F.lit(s) for s in history.STATES])
    person = F.concat(F.lit("e"), (F.col("c_custkey") % 30).cast("string"))
    value = F.concat(F.lit("v"), (F.col("c_custkey") % 500).cast("string"))
    priority = F.when(F.col("c_mktsegment") == "BUILDING", "1-URGENT").when(
        F.col("c_mktsegment") == "MACHINERY", "9-NONE").otherwise("3-MEDIUM")
    return table(spark, d, "customer").select(
        finding_id(person, priority, value).alias("finding_id"),
        F.element_at(states, (F.col("c_nationkey") % 4 + 1).cast("int")).alias("state"),
        F.concat(F.lit("note "), F.col("c_custkey").cast("string")).alias("note"),
        F.timestamp_seconds(F.col("c_nationkey") * 60 + 1_700_000_000).alias("updated_at"),
        F.lpad(F.col("c_custkey").cast("string"), 20, "0").alias("entry"),
    )


def _triage(spark: SparkSession, d: str) -> DataFrame:
    return history.latest_triage(_log(spark, d)).drop("updated_at")


def _latest(spark: SparkSession, d: str) -> DataFrame:
    now = history.latest_findings(_scans(spark, d), _findings(spark, d))
    return history.worst_first(history.with_state(now, history.latest_triage(_log(spark, d))))


def _states(spark: SparkSession, d: str) -> DataFrame:
    return history.state_counts(
        history.with_state(_findings(spark, d), history.latest_triage(_log(spark, d)))
    )


def _keep_last(spark: SparkSession, d: str) -> DataFrame:
    """Repeats under one id: the last in rank order is kept."""
    found = order_hits(spark, d).withColumn("finding_id", finding_id(F.col("employee"), F.lit("r"), F.col("value")))
    return keep_last(found).select("finding_id", "severity", "location", F.col("seq.emit_seq").alias("k"))


def _stored(spark: SparkSession, d: str) -> DataFrame:
    """A scan written to a store of its own and read back as the latest."""
    store = history.History(spark, f"{shared_folder(spark)}/history-{uuid.uuid4().hex}")
    store.record_scan(collapse(order_hits(spark, d)), root="orders", started_at="a", finished_at="b")
    found = store.findings()
    store.set_triage(found.where("severity = 'critical'").select(
        "finding_id", F.lit("confirmed").alias("state"), F.lit("n").alias("note")))
    return store.findings().select("scan_id", "finding_id", "severity", "occurrences", "state", "note")


def _store(spark: SparkSession, d: str) -> history.History:
    """A store that holds every scan, finding and triage entry."""
    def shaped(rows: DataFrame, schema: str) -> DataFrame:
        fields = [c.strip().split(" ") for c in schema.split(", ")]
        return rows.select(*[
            (F.col(name) if name in rows.columns else F.lit(None)).cast(kind).alias(name) for name, kind in fields])

    store = history.History(spark, f"{shared_folder(spark)}/history-{uuid.uuid4().hex}")
    store.add_scans(shaped(_scans(spark, d), history.SCANS), shaped(_findings(spark, d), history.FINDINGS))
    store.add_triage(shaped(_log(spark, d), history.TRIAGE_LOG))
    return store


def _left(store: history.History) -> DataFrame:
    """What a store holds: scans, findings and triaged ids."""
    none, empty = F.lit(0).cast("bigint").alias("scan_id"), F.lit("").alias("finding_id")
    return store.scans().select("scan_id", empty, F.lit("scan").alias("what")).unionByName(
        store.all_findings().select("scan_id", "finding_id", F.lit("finding").alias("what"))).unionByName(
        store.triage().select(none, "finding_id", F.lit("triage").alias("what")))


def _store_without_scan(spark: SparkSession, d: str) -> DataFrame:
    """A store after its latest month is purged."""
    store = _store(spark, d)
    store.purge(scan_id=store.all_findings().agg(F.max("scan_id").alias("n")).first()["n"])
    return _left(store)


def _store_without_person(spark: SparkSession, d: str) -> DataFrame:
    """A store after one person is purged."""
    store = _store(spark, d)
    store.purge(employee="e7")
    return _left(store)


def _purge_scan(spark: SparkSession, d: str) -> DataFrame:
    """What is left once the latest scan is gone."""
    store = _store(spark, d)
    store.purge(scan_id=store.latest_scan_id())
    left = store.all_findings()
    lost = history.orphans(history.latest_triage(_log(spark, d)), store.triage())
    return left.select("scan_id", "finding_id", F.lit("finding").alias("what")).unionByName(
        lost.select(F.lit(0).cast("bigint").alias("scan_id"), "finding_id", F.lit("orphan").alias("what"))
    )


def _purge_person(spark: SparkSession, d: str) -> DataFrame:
    """What is left once one person's findings are gone."""
    store = _store(spark, d)
    store.purge(employee="e7")
    return store.all_findings().groupBy("scan_id", "employee").agg(F.count("*").alias("findings"))


def _kept_trend(spark: SparkSession, d: str) -> DataFrame:
    """The trend by the counts a store keeps, before any purge and after two."""
    store = _store(spark, d)
    before = store.trend().withColumn("at", F.lit("before"))
    before = stage(before, "trend")
    store.purge(employee="e7")
    store.purge(scan_id=1003)
    return before.unionByName(store.trend().withColumn("at", F.lit("after")))


def _kept_counts(spark: SparkSession, d: str) -> DataFrame:
    """Findings of each scan by the counts a store keeps, after a person is purged."""
    store = _store(spark, d)
    store.purge(employee="e7")
    return store.scan_list().select("scan_id", "finished_at", "findings")


QUERIES = {
    "kept_trend": _kept_trend,
    "kept_counts": _kept_counts,
    "scan_counts": lambda s, d: history.scans_with_counts(_scans(s, d), _findings(s, d)),
    "severity_trend": lambda s, d: history.trend(_scans(s, d), _findings(s, d)),
    "trend_shares": lambda s, d: history.trend_shares(history.trend(_scans(s, d), _findings(s, d))).select("scan_id", "total", "share"),
    "triage_latest": _triage,
    "latest_with_state": _latest,
    "state_counts": _states,
    "orphan_triage": lambda s, d: history.orphans(history.latest_triage(_log(s, d)), _findings(s, d)).select("finding_id", "state"),
    "purge_scan": _purge_scan,
    "purge_person": _purge_person,
    "store_without_scan": _store_without_scan,
    "store_without_person": _store_without_person,
    "keep_last": _keep_last,
    "stored_scan": _stored,
}

_P = "'e' || CAST(o_custkey % 30 AS varchar)"
_SCANS = """SELECT DISTINCT CAST(year(o_orderdate) * 100 + month(o_orderdate) AS bigint) AS scan_id FROM orders
            UNION ALL SELECT CAST(n_nationkey + 1000 AS bigint) FROM nation"""
_F = f"""
    SELECT scan_id, employee, finding_id, count(*) AS occurrences, any_value(severity) AS severity, any_value(confidence) AS confidence
    FROM (SELECT CAST(year(o_orderdate) * 100 + month(o_orderdate) AS bigint) AS scan_id, {_P} AS employee, o_orderpriority,
                 left(sha256({_P} || chr(31) || o_orderpriority || chr(31) || 'v' || CAST(o_custkey % 500 AS varchar)), 16) AS finding_id,
                 {_case(1)} AS severity, {_case(3)} AS confidence FROM orders)
    GROUP BY scan_id, employee, o_orderpriority, finding_id"""
_LOG = """
    SELECT left(sha256('e' || CAST(c_custkey % 30 AS varchar) || chr(31) || CASE c_mktsegment WHEN 'BUILDING' THEN '1-URGENT'
                WHEN 'MACHINERY' THEN '9-NONE' ELSE '3-MEDIUM' END || chr(31) || 'v' || CAST(c_custkey % 500 AS varchar)), 16) AS finding_id,
           (['open', 'confirmed', 'false_positive', 'remediated'])[CAST(c_nationkey % 4 + 1 AS bigint)] AS state,
           'note ' || CAST(c_custkey AS varchar) AS note, c_nationkey AS "at", c_custkey AS entry FROM customer"""
_T = f"""SELECT finding_id, state, note FROM (SELECT *, row_number() OVER (PARTITION BY finding_id ORDER BY "at" DESC, entry DESC) AS n
         FROM ({_LOG})) WHERE n = 1"""
_RANK_UP = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END"

def _trend_sql(where: str = "true") -> str:
    return f"""
    SELECT scan_id, 'at ' || CAST(scan_id AS varchar) AS finished_at, count(severity) AS total,
           count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high,
           count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low
    FROM ({_SCANS}) LEFT JOIN (SELECT * FROM ({_F}) WHERE {where}) USING (scan_id) GROUP BY scan_id"""


_TREND = _trend_sql()
_NOT_E7 = "employee <> 'e7'"


def _left_sql(scans: str, kept: str) -> str:
    return f"""
        WITH kept AS (SELECT * FROM ({_F}) WHERE {kept})
        SELECT scan_id, '' AS finding_id, 'scan' AS what FROM ({_SCANS}) WHERE {scans}
        UNION ALL SELECT scan_id, finding_id, 'finding' FROM kept
        UNION ALL SELECT 0, finding_id, 'triage' FROM ({_T}) WHERE finding_id IN (SELECT finding_id FROM kept)"""


_LAST = f"scan_id <> (SELECT max(scan_id) FROM ({_F}))"

SQL = {
    "kept_trend": f"""
        SELECT *, 'before' AS "at" FROM ({_TREND}) UNION ALL
        SELECT *, 'after' AS "at" FROM ({_trend_sql(_NOT_E7)}) WHERE scan_id <> 1003""",
    "kept_counts": f"SELECT scan_id, finished_at, total AS findings FROM ({_trend_sql(_NOT_E7)})",
    "store_without_scan": _left_sql(_LAST, _LAST),
    "store_without_person": _left_sql("true", "employee <> 'e7'"),
    "scan_counts": f"""
        SELECT scan_id, 'at ' || CAST(scan_id AS varchar) AS finished_at, (SELECT count(*) FROM ({_F}) f WHERE f.scan_id = s.scan_id) AS findings
        FROM ({_SCANS}) s""",
    "severity_trend": _TREND,
    "trend_shares": f"""SELECT scan_id, total, CAST(round_even(total / greatest(max(total) OVER (), 1) * 100, 0) AS int) AS share FROM ({_TREND})""",
    "triage_latest": _T,
    "latest_with_state": f"""
        SELECT scan_id, employee, f.finding_id, occurrences, severity, confidence, coalesce(state, 'open') AS state, coalesce(note, '') AS note
        FROM ({_F}) f LEFT JOIN ({_T}) t ON t.finding_id = f.finding_id WHERE scan_id = (SELECT max(scan_id) FROM ({_SCANS}))""",
    "state_counts": f"""
        SELECT coalesce(state, 'open') AS state, count(*) AS n FROM ({_F}) f LEFT JOIN ({_T}) t ON t.finding_id = f.finding_id GROUP BY 1""",
    "orphan_triage": f"SELECT finding_id, state FROM ({_T}) WHERE finding_id NOT IN (SELECT finding_id FROM ({_F}))",
    "purge_scan": f"""
        WITH kept AS (SELECT * FROM ({_F}) WHERE scan_id <> (SELECT max(scan_id) FROM ({_SCANS})))
        SELECT scan_id, finding_id, 'finding' AS what FROM kept
        UNION ALL SELECT 0, finding_id, 'orphan' FROM ({_T}) WHERE finding_id NOT IN (SELECT finding_id FROM kept)""",
    "purge_person": f"SELECT scan_id, employee, count(*) AS findings FROM ({_F}) WHERE employee <> 'e7' GROUP BY ALL",
    "keep_last": f"""
        SELECT finding_id, severity, location, k FROM (
          SELECT *, row_number() OVER (PARTITION BY finding_id ORDER BY {_RANK_UP} DESC, confidence, employee DESC, location DESC,
                                       rule_id DESC, rec DESC, k DESC) AS n
          FROM (SELECT *, left(sha256(employee || chr(31) || 'r' || chr(31) || trim(value_key)), 16) AS finding_id
                FROM ({_HITS.replace("WHERE o_orderstatus <> 'P'", "")}))) WHERE n = 1""",
    "stored_scan": f"""
        SELECT 1 AS scan_id, finding_id, severity, occurrences, CASE severity WHEN 'critical' THEN 'confirmed' ELSE 'open' END AS state,
               CASE severity WHEN 'critical' THEN 'n' ELSE '' END AS note FROM ({_FINDINGS})""",
}
