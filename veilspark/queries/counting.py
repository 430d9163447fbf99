"""Collapse, ranking, counts, surveys and rule checks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import report
from ..operators.collapse import collapse, sightings, top, with_also_at
from ..plans.staging import shared_folder
from ..rules.model import load_rules, rule_violations
from ..sources.tables import conversation_records, document_records, page_records
from .common import chunk_sql, redact_sql, table

# Severity, category and confidence given to orders by priority.
PRIORITIES = (
    ("1-URGENT", "critical", "secret", 90), ("2-HIGH", "high", "pii", 80), ("3-MEDIUM", "medium", "commercial", 70),
    ("4-NOT SPECIFIED", "low", "internal", 60), ("5-LOW", "low", "internal", 50),
)


def _by_priority(i: int) -> Column:
    out = F.lit(None)
    for row in PRIORITIES:
        out = F.when(F.col("o_orderpriority") == row[0], F.lit(row[i])).otherwise(out)
    return out


def order_hits(spark: SparkSession, d: str) -> DataFrame:
    """Each order as one hit: few values, many repeats, a few sightings per place."""
    orders = table(spark, d, "orders")
    key = F.col("o_orderkey")
    person = F.concat(F.lit("e"), (F.col("o_custkey") % 30).cast("string"))
    value = F.concat(F.lit("token  "), (F.col("o_custkey") % 210).cast("string"), F.lit(" "))
    return orders.select(
        F.concat(F.lit("rule."), "o_orderpriority").alias("rule_id"), _by_priority(2).alias("category"),
        F.lit("token").alias("subtype"), _by_priority(1).alias("severity"), _by_priority(3).alias("confidence"),
        person.alias("employee"), F.lit("s").alias("session_id"), F.lit("table").alias("source"),
        F.lit("user_message").alias("kind"),
        F.concat(person, F.lit("/f#"), F.floor(key / 2000).cast("string"), F.lit(".0")).alias("location"),
        F.lit(0).alias("start"), F.lit(9).alias("end"), value.alias("value"), F.lit("shown").alias("snippet"),
        F.lit(False).alias("descriptive"),
        F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("noise."), F.lower("o_orderstatus"))).alias("suppressed_by"),
        F.struct(F.array(person).alias("file_key"), F.floor(key / 2000).alias("record_index"), key.alias("emit_seq"),
                 F.lit(0).alias("hit_ix")).alias("seq"),
    )


def _collapse(spark: SparkSession, d: str) -> DataFrame:
    return collapse(order_hits(spark, d)).select(
        "finding_id", "employee", "rule_id", "severity", "location", "occurrences", "value_redacted",
        F.col("seq.emit_seq").alias("first_seen"),
    )


def _sightings(spark: SparkSession, d: str) -> DataFrame:
    return sightings(order_hits(spark, d)).select(
        "employee", "rule_id", "value_key", "location", F.col("at.emit_seq").alias("at")
    )


def _also_at(spark: SparkSession, d: str) -> DataFrame:
    found = order_hits(spark, d)
    listed = with_also_at(collapse(found), sightings(found), inline_up_to=6)
    return listed.select(
        "finding_id", "also_at_count", F.array_join("also_at", " ").alias("also_at")
    )


def _top(spark: SparkSession, d: str) -> DataFrame:
    return top(collapse(order_hits(spark, d)), 25).select("finding_id", "severity", "confidence", "employee", "location")


def _counts_by(spark: SparkSession, d: str) -> DataFrame:
    return report.counts_by(collapse(order_hits(spark, d)))


def _everyone(spark: SparkSession, d: str) -> DataFrame:
    """People who placed orders, and one more per nation who did not."""
    customers = table(spark, d, "customer")
    orderers = customers.select(F.concat(F.lit("e"), (F.col("c_custkey") % 30).cast("string")).alias("employee"))
    others = table(spark, d, "nation").select(F.lower("n_name").alias("employee"))
    return report.people(orderers.unionByName(others))


def _people(spark: SparkSession, d: str) -> DataFrame:
    return report.people_table(_everyone(spark, d), collapse(order_hits(spark, d)))


def _clean(spark: SparkSession, d: str) -> DataFrame:
    return report.clean_people(_everyone(spark, d), collapse(order_hits(spark, d)))


def _suppressed(spark: SparkSession, d: str) -> DataFrame:
    return order_hits(spark, d).where("suppressed_by IS NOT NULL").groupBy("suppressed_by").agg(F.count("*").alias("n"))


def _totals(spark: SparkSession, d: str) -> DataFrame:
    return report.report_totals(collapse(order_hits(spark, d)), _suppressed(spark, d), _everyone(spark, d))


def _report_rows(spark: SparkSession, d: str) -> DataFrame:
    return report.report_findings(collapse(order_hits(spark, d)))


def _all_records(spark: SparkSession, d: str) -> DataFrame:
    return (
        document_records(table(spark, d, "documents"))
        .unionByName(conversation_records(table(spark, d, "conversations")))
        .unionByName(page_records(table(spark, d, "pages")))
    )


def _survey(spark: SparkSession, d: str) -> DataFrame:
    silent = table(spark, d, "supplier").select(F.col("s_name").alias("employee"))
    return report.survey_order(report.survey(_all_records(spark, d), silent))


def _record_totals(spark: SparkSession, d: str) -> DataFrame:
    return report.record_totals(_all_records(spark, d))


def _violations(spark: SparkSession, d: str) -> DataFrame:
    """A rules table made of parts, with every kind of mistake in it."""
    parts = table(spark, d, "part")
    rules = parts.select(
        F.concat(F.lit("rule."), F.floor(F.col("p_partkey") / 2 * 1.5).cast("string")).alias("rule_id"),
        F.when(F.col("p_size") > 3, F.col("p_name")).alias("name"),
        F.when(F.col("p_size") % 5 == 0, "unheard-of").otherwise("pii").alias("category"), F.col("p_type").alias("subtype"),
        F.when(F.col("p_size") % 7 == 0, "dire").otherwise("low").alias("severity"),
        F.when(F.col("p_size") == 50, "").otherwise("x+").alias("pattern"),
        F.when(F.col("p_size") % 9 == 0, F.array(F.lit("user_message"), F.lit("telepathy")))
        .otherwise(F.array(F.lit("user_message"))).alias("kinds"),
        (F.col("p_size") * 3 - 10).alias("confidence"),
        F.when(F.col("p_size") % 11 == 0, "mod97").otherwise("luhn").alias("validate"),
    )
    return rule_violations(rules).groupBy("problem").agg(F.count("*").alias("n"))


def _report_dataset(spark: SparkSession, d: str) -> DataFrame:
    """A report written with every place, and read back from its folder."""
    found = order_hits(spark, d)
    everyone = _everyone(spark, d)
    path = f"{shared_folder(spark)}/report-{uuid.uuid4().hex}"
    report.write_report(
        path, findings=collapse(found), everyone=everyone, suppressed=_suppressed(spark, d), seen=sightings(found),
        totals=table(spark, d, "orders").agg(F.count("*").alias("records")), ruleset=load_rules(), root="orders",
        started_at="a", finished_at="b")

    def rows(part: str, a: str, b: str, n: str) -> DataFrame:
        return spark.read.json(f"{path}/{part}").select(
            F.lit(part).alias("part"), F.expr(a).alias("a"), F.expr(b).alias("b"), F.expr(n).cast("bigint").alias("n"))

    return rows("findings", "finding_id", "value_redacted", "occurrences").unionByName(
        rows("sightings", "finding_id", "location", "at.emit_seq")).unionByName(
        rows("employees", "employee", "CAST(clean AS string)", "findings")).unionByName(
        rows("counts", "dimension", "label", "n")).unionByName(
        rows("suppressed", "suppressed_by", "''", "n")).unionByName(
        rows("summary", "root", "redaction", "findings"))


QUERIES = {
    "report_dataset": _report_dataset,
    "collapse_repeats": _collapse,
    "sightings": _sightings,
    "also_at": _also_at,
    "top_findings": _top,
    "counts_by": _counts_by,
    "people_table": _people,
    "clean_people": _clean,
    "suppression_totals": _suppressed,
    "report_totals": _totals,
    "report_findings": _report_rows,
    "survey": _survey,
    "record_totals": _record_totals,
    "rule_violations": _violations,
}


def _case(i: int) -> str:
    quote = (lambda v: f"'{v}'") if isinstance(PRIORITIES[0][i], str) else str
    return "CASE o_orderpriority " + " ".join(f"WHEN '{r[0]}' THEN {quote(r[i])}" for r in PRIORITIES) + " END"


_HITS = f"""
    SELECT 'rule.' || o_orderpriority AS rule_id, {_case(1)} AS severity, {_case(2)} AS category, {_case(3)} AS confidence,
           'e' || CAST(o_custkey % 30 AS varchar) AS employee, o_orderkey AS k, o_orderkey // 2000 AS rec,
           'e' || CAST(o_custkey % 30 AS varchar) || '/f#' || CAST(o_orderkey // 2000 AS varchar) || '.0' AS location,
           'token ' || CAST(o_custkey % 210 AS varchar) || ' ' AS value_key
    FROM orders WHERE o_orderstatus <> 'P'"""
_FINDINGS = f"""
    SELECT employee, rule_id, value_key, any_value(severity) AS severity, any_value(category) AS category,
           any_value(confidence) AS confidence, arg_min(location, k) AS location, min(k) AS first_seen, count(*) AS occurrences,
           left(sha256(employee || chr(31) || rule_id || chr(31) || trim(value_key)), 16) AS finding_id
    FROM ({_HITS}) GROUP BY employee, rule_id, value_key"""
_LATER = f"""
    SELECT employee, rule_id, value_key, location, min(k) AS "at"
    FROM (SELECT *, min(k) OVER (PARTITION BY employee, rule_id, value_key) AS first FROM ({_HITS}))
    WHERE k > first GROUP BY ALL"""
_RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END"
_PEOPLE = """SELECT DISTINCT 'e' || CAST(c_custkey % 30 AS varchar) AS employee FROM customer
             UNION SELECT lower(n_name) FROM nation"""
_RECORDS = f"""
    SELECT source AS employee, 'attachment' AS kind, 'plain-text' AS source, length(chunk) AS n FROM ({chunk_sql()})
    UNION ALL SELECT 'c' || CAST(conv_id % 20 AS varchar), CASE role WHEN 'user' THEN 'user_message' WHEN 'system' THEN 'system_prompt'
              ELSE 'assistant_message' END, 'plain-text', length(text) FROM conversations WHERE trim(text) <> ''
    UNION ALL SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), 'tool_result', 'plain-text', length(html) FROM pages"""

SQL = {
    "report_dataset": f"""
        SELECT 'findings' AS part, finding_id AS a, {redact_sql('value_key')} AS b, occurrences AS n FROM ({_FINDINGS})
        UNION ALL SELECT 'sightings', left(sha256(employee || chr(31) || rule_id || chr(31) || trim(value_key)), 16), location, "at" FROM ({_LATER})
        UNION ALL SELECT 'employees', employee, CASE WHEN count(finding_id) = 0 THEN 'true' ELSE 'false' END, count(finding_id)
        FROM ({_PEOPLE}) LEFT JOIN ({_FINDINGS}) USING (employee) GROUP BY employee
        UNION ALL SELECT 'counts', 'employee', employee, count(*) FROM ({_FINDINGS}) GROUP BY employee
        UNION ALL SELECT 'counts', 'category', category, count(*) FROM ({_FINDINGS}) GROUP BY category
        UNION ALL SELECT 'counts', 'severity', severity, count(*) FROM ({_FINDINGS}) GROUP BY severity
        UNION ALL SELECT 'suppressed', 'noise.p', '', count(*) FROM orders WHERE o_orderstatus = 'P' HAVING count(*) > 0
        UNION ALL SELECT 'summary', 'orders', 'redacted', count(*) FROM ({_FINDINGS})""",
    "collapse_repeats": f"""
        SELECT finding_id, employee, rule_id, severity, location, occurrences, {redact_sql('value_key')} AS value_redacted,
               first_seen FROM ({_FINDINGS})""",
    "sightings": _LATER,
    "also_at": f"""
        SELECT finding_id, coalesce(n, 0) AS also_at_count, CASE WHEN n <= 6 THEN l WHEN n IS NULL THEN '' END AS also_at
        FROM ({_FINDINGS}) LEFT JOIN (SELECT employee, rule_id, value_key, count(*) AS n, string_agg(location, ' ' ORDER BY "at") AS l
                                     FROM ({_LATER}) GROUP BY ALL) USING (employee, rule_id, value_key)""",
    "top_findings": f"""
        SELECT finding_id, severity, confidence, employee, location FROM ({_FINDINGS})
        ORDER BY {_RANK}, confidence DESC, employee, location, rule_id, first_seen LIMIT 25""",
    "counts_by": f"""
        SELECT 'employee' AS dimension, employee AS label, count(*) AS n FROM ({_FINDINGS}) GROUP BY employee
        UNION ALL SELECT 'category', category, count(*) FROM ({_FINDINGS}) GROUP BY category
        UNION ALL SELECT 'severity', severity, count(*) FROM ({_FINDINGS}) GROUP BY severity""",
    "people_table": f"""
        SELECT employee, count(finding_id) AS findings, count(*) FILTER (severity = 'critical') AS critical,
               count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium,
               count(*) FILTER (severity = 'low') AS low, count(finding_id) = 0 AS clean
        FROM ({_PEOPLE}) LEFT JOIN ({_FINDINGS}) USING (employee) GROUP BY employee""",
    "clean_people": f"SELECT employee FROM ({_PEOPLE}) EXCEPT SELECT employee FROM ({_FINDINGS})",
    "suppression_totals": "SELECT 'noise.p' AS suppressed_by, count(*) AS n FROM orders WHERE o_orderstatus = 'P' HAVING count(*) > 0",
    "report_totals": f"""
        SELECT count(*) AS findings, count(DISTINCT employee) AS employees_with_findings,
               (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS suppressed_as_noise,
               (SELECT count(*) FROM ({_PEOPLE})) AS employees_scanned FROM ({_FINDINGS})""",
    "report_findings": f"""
        SELECT finding_id, rule_id, category, 'token' AS subtype, severity, confidence, employee, 's' AS session_id, 'table' AS source,
               'user_message' AS location_kind, location, occurrences, {redact_sql('value_key')} AS value_redacted,
               'shown' AS snippet FROM ({_FINDINGS})""",
    "survey": f"""
        WITH r AS ({_RECORDS})
        SELECT 'kind' AS dimension, kind AS label, count(*) AS records, CAST(sum(n) AS bigint) AS characters FROM r GROUP BY kind
        UNION ALL SELECT 'employee', employee, count(*), CAST(sum(n) AS bigint) FROM r GROUP BY employee
        UNION ALL SELECT 'source', source, count(*), CAST(sum(n) AS bigint) FROM r GROUP BY source
        UNION ALL SELECT DISTINCT 'employee', s_name, 0, 0 FROM supplier""",
    "record_totals": f"SELECT count(*) AS records, CAST(sum(n) AS bigint) AS characters FROM ({_RECORDS})",
    "rule_violations": """
        SELECT problem, count(*) AS n FROM (
          SELECT unnest(list_filter([
            CASE WHEN p_size <= 3 THEN 'missing name' END, CASE WHEN p_size = 50 THEN 'missing pattern' END,
            CASE WHEN p_size % 5 = 0 THEN 'unknown category' END, CASE WHEN p_size % 7 = 0 THEN 'unknown severity' END,
            CASE WHEN p_size % 11 = 0 THEN 'unknown validator' END, CASE WHEN p_size % 9 = 0 THEN 'unknown kind' END,
            CASE WHEN p_size * 3 - 10 NOT BETWEEN 0 AND 100 THEN 'confidence out of range' END],
            lambda x: x IS NOT NULL)) AS problem FROM part
          UNION ALL SELECT 'duplicate id' FROM (SELECT floor(p_partkey / 2 * 1.5) AS id FROM part GROUP BY id HAVING count(*) > 1))
        GROUP BY problem""",
}
