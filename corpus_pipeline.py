"""Documents to token ids: language, near-duplicates, benchmark leaks, mix, shards.

Each stage takes what its predecessor kept, written as Parquet and read again, and
returns the columns of ``documents`` (the last one: where each document's ids are).
Rows with a null ``doc_id`` are kept by every stage that finds no fault in their text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import decontamination, jaccard, language, mixing, queries, token_ids
from veilspark.plans.staging import shared_folder, stage

#: A text whose best language gets less than this is rejected like one without letters.
LEAST_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a learned language; texts that are null or have no letter go."""
    found = language.detect(F.col("text"), queries.language_network(docs))
    rows = docs.select(F.struct("*").alias("row"), found.alias("found"))
    return rows.where((F.col("found.lang") != language.UNKNOWN) & (F.col("found.score") >= LEAST_SCORE)).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near copies; rows are told apart, not ids.

    The row with the smallest id stays, among ids that occur once; a group without such an id keeps one of
    its other rows.  Rows whose id is null or repeats get numbers of their own first, so that none goes for
    its namesake.  Rows without words are nobody's copy.  An empty table stays empty.
    """
    ids = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    loose_ids = stage(ids.where("doc_id is null or n > 1").select("doc_id"), "loose-ids")
    single = docs.join(loose_ids, docs["doc_id"] == loose_ids["doc_id"], "left_anti").where(docs["doc_id"].isNotNull())
    loose = docs.join(loose_ids, docs["doc_id"].eqNullSafe(loose_ids["doc_id"]), "left_semi")
    loose = stage(loose.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("number")), "loose")
    ends = docs.agg(F.min("doc_id").cast("long").alias("low"), F.max("doc_id").cast("long").alias("high")).first()
    # numbers stay below 2^62; they go where the ids leave room
    after = (ends.high or 0) < 1 << 62
    key = (F.lit((ends.high or 0) + 1) + F.col("number")) if after else (F.lit(ends.low - 1) - F.col("number"))
    loose = loose.select("row", key.alias("key"))
    keyed = single.select(F.col("doc_id").cast("long").alias("doc_id"), "text").union(loose.select("key", "row.text"))
    gone = stage(jaccard.shingle_groups(keyed).where("component_id <> doc_id").select(F.col("doc_id").alias("key")), "gone")
    kept = single.join(gone, single["doc_id"] == gone["key"], "left_anti")
    return kept.union(loose.join(gone, "key", "left_anti").select("row.*"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents without a benchmark item, copied or edited; of items of a few words only copies count.

    Rows are judged one by one: null ids and repeated rows are rows like others, a null or empty text has no leak.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = docs.select(F.struct("*").alias("row"), decontamination.leaks(docs, benchmark).alias("leaks"))
    return rows.where(F.size("leaks") == 0).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.take(docs, queries.quality_weights(spark, sf_dir))


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of the shards written."""
    return queries.token_id_shards(spark, docs)


STAGES = [
    ("language identification", identify_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("token ids", write_token_ids),
]

#: No stage but the mix can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        path = f"{shared_folder(spark)}/pipeline-{number}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
