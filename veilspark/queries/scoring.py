"""Labelled transcripts scored end to end, and the streaming scan."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import score
from ..operators.collapse import collapse
from ..operators.detect import hits
from ..plans import transcript_files, transcripts
from ..plans.staging import shared_folder, stage
from ..rules.model import load_rules
from ..sources.tables import document_records
from ..sources.transcripts import read_transcripts
from ..sources.writing import write_files
from ..streaming.incremental import current_findings, scan_stream
from .common import quoted, table
from .detection import CARD, SQL as _DETECTION_SQL

#: A label no rule can find, given to customers in debt.
LOST = ("customer_list", "a list nobody typed")


def _keys(spark: SparkSession, d: str) -> DataFrame:
    return transcripts.keyed(table(spark, d, "customer"), "c_custkey", "c_name")


def _plants(spark: SparkSession, d: str) -> DataFrame:
    planted = transcripts.plants(_keys(spark, d))
    person = F.concat(F.lit("p"), F.col("c_custkey").cast("string"))
    lost = table(spark, d, "customer").where("c_acctbal < 0").select(
        (F.col("c_custkey") * 1000 + 999).alias("plant_id"), person.alias("employee"),
        F.concat(person, F.lit("/log.jsonl")).alias("file"), F.lit(0).cast("bigint").alias("record_index"),
        F.lit("commercial").alias("category"), F.lit(LOST[0]).alias("subtype"), F.lit("high").alias("severity"),
        F.lit(LOST[1]).alias("value"),
    )
    return planted.unionByName(lost)


def _controls(spark: SparkSession, d: str) -> DataFrame:
    return transcripts.keyed(table(spark, d, "supplier"), "s_suppkey", "s_name")


def _found(spark: SparkSession, d: str) -> DataFrame:
    records = transcripts.transcript_records(_keys(spark, d)).unionByName(
        transcripts.control_records(_controls(spark, d))
    )
    return stage(collapse(hits(records)), "scored")


def _recall(spark: SparkSession, d: str) -> DataFrame:
    planted = _plants(spark, d)
    return score.recall(score.scored(planted, score.assignments(planted, _found(spark, d))))


def _missed(spark: SparkSession, d: str) -> DataFrame:
    planted = _plants(spark, d)
    gaps = score.missed(score.scored(planted, score.assignments(planted, _found(spark, d))))
    return gaps.select("employee", "subtype", "value")


def _unlabelled(spark: SparkSession, d: str) -> DataFrame:
    """Findings no plant claims: the rules that see a planted value as well."""
    found = _found(spark, d)
    left = score.unlabelled(found, score.assignments(_plants(spark, d), found))
    return left.groupBy("rule_id").agg(F.count("*").alias("n"))


def _control(spark: SparkSession, d: str) -> DataFrame:
    people = transcripts.control_records(_controls(spark, d)).select("employee").unionByName(
        _keys(spark, d).select(F.concat(F.lit("p"), F.col("key").cast("string")).alias("employee"))
    )
    return score.control_verdict(people, _found(spark, d)).groupBy(
        F.substring("employee", 1, 1).alias("who"), "verdict"
    ).agg(F.count("*").alias("people"))


def _category_gap(spark: SparkSession, d: str) -> DataFrame:
    """Everything planted, with one category labelled by a name no rule has."""
    named = F.when(F.col("category") == "internal", "inside").otherwise(F.col("category"))
    planted = _plants(spark, d).withColumn("category", named)
    return score.category_gap(planted, _found(spark, d))


def _stream(spark: SparkSession, d: str) -> DataFrame:
    """The payment-card scan, run as a stream over the documents as they arrive in several files."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    documents = table(spark, d, "documents")
    files = max(6, spark.sparkContext.defaultParallelism)
    documents.repartition(files).write.parquet(f"{folder}/drop")
    documents = spark.readStream.schema(documents.schema).option("maxFilesPerTrigger", files // 3).parquet(f"{folder}/drop")
    scan_stream(
        document_records(documents), f"{folder}/state", ruleset=load_rules().select(CARD), shapes=False
    ).awaitTermination()
    return current_findings(spark, f"{folder}/state").select(
        "finding_id", "employee", "rule_id", "severity", "confidence", "location", "session_id",
        "value_redacted", "occurrences",
    )


def _files_scored(spark: SparkSession, d: str) -> DataFrame:
    """Files written in all three formats, read back and scored by the places they were written to; people who
    leaked nothing are listed by how many of them have findings."""
    root = f"{shared_folder(spark)}/written-{uuid.uuid4().hex}"
    planted = transcript_files.transcript_files(_keys(spark, d))
    write_files(planted.unionByName(transcript_files.control_files(_controls(spark, d))), root)
    read = read_transcripts(spark, root)
    found = stage(collapse(hits(read.records)), "scored")
    plants = transcript_files.file_plants(planted.drop("content"))
    marked = score.scored(plants, score.assignments(plants, found))
    by_format = marked.groupBy("format", "category").agg(
        F.sum(F.col("hit").cast("int")).alias("hits"), F.count("*").alias("plants"))
    clean = score.control_verdict(read.files.select("employee").distinct(), found).where(
        F.col("employee").startswith("control")).select(
        F.lit("control").alias("format"), F.col("verdict").alias("category"), F.lit(0).cast("bigint").alias("hits"))
    return by_format.unionByName(clean.groupBy("format", "category").agg(
        F.sum("hits").alias("hits"), F.count("*").alias("plants")))


QUERIES = {
    "score_files": _files_scored,
    "score_recall": _recall,
    "score_missed": _missed,
    "score_unlabelled": _unlabelled,
    "control_verdict": _control,
    "category_gap": _category_gap,
    "stream_scan": _stream,
}

_RULES = {r.id: r for r in load_rules().rules}
_PER_CATEGORY: dict[str, int] = {}
for _t in transcripts.TRANSCRIPT:
    _c = _RULES[_t.rule_id].category
    _PER_CATEGORY[_c] = _PER_CATEGORY.get(_c, 0) + 1

_LABELS = " UNION ALL ".join(
    f"SELECT {quoted(c)} AS category, {n} * (SELECT count(*) FROM customer) AS hits" for c, n in sorted(_PER_CATEGORY.items())
)
_DEBTORS = "(SELECT count(*) FROM customer WHERE c_acctbal < 0)"

SQL = {
    "score_files": f"""
        WITH f AS (SELECT (['session_log', 'account_export', 'plain_text'])[CAST(c_custkey % 3 + 1 AS int)] AS format, count(*) AS files
                   FROM customer GROUP BY 1)
        SELECT format, category, CAST(files * n AS bigint) AS hits, CAST(files * n AS bigint) AS plants
        FROM f, (VALUES {", ".join(f"({quoted(c)}, {n})" for c, n in sorted(_PER_CATEGORY.items()))}) AS c (category, n)
        UNION ALL SELECT 'control', 'PASS', 0, count(*) FROM supplier""",
    "score_recall": f"""
        WITH c AS (SELECT category, hits, hits + CASE category WHEN 'commercial' THEN {_DEBTORS} ELSE 0 END AS plants FROM ({_LABELS}))
        SELECT category, hits, plants, hits / plants AS recall FROM c
        UNION ALL SELECT '(all)', CAST(sum(hits) AS bigint), CAST(sum(plants) AS bigint), CAST(sum(hits) AS bigint) / CAST(sum(plants) AS bigint) FROM c""",
    "score_missed": f"""
        SELECT 'p' || CAST(c_custkey AS varchar) AS employee, {quoted(LOST[0])} AS subtype, {quoted(LOST[1])} AS value
        FROM customer WHERE c_acctbal < 0""",
    # The pay rule also sees five digits in a row inside the payment key.
    "score_unlabelled": """
        SELECT 'pii.salary.v1' AS rule_id, count(*) AS n FROM customer
        WHERE regexp_matches(md5(c_name), '[0-9]{5}') HAVING count(*) > 0""",
    "control_verdict": """
        SELECT 'c' AS who, 'PASS' AS verdict, count(*) AS people FROM supplier
        UNION ALL SELECT 'p', 'FAIL', count(*) FROM customer""",
    "category_gap": """
        SELECT DISTINCT 'internal' AS category, 'detected only' AS gap FROM customer
        UNION ALL SELECT DISTINCT 'inside', 'planted only' FROM customer""",
    "stream_scan": _DETECTION_SQL["detect_payment_card"],
}
