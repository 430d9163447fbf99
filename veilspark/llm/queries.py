"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.staging import shared_folder
from . import (
    centroids, chat, decontamination, jaccard, kneser_ney, language, mixing, near_vectors, part_codes, projection_forest, secret_forest, token_ids,
    warc,
)

WORD = r"[^\x20\x09-\x0D]+"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def fold(key: Column, parts: int) -> Column:
    """The remainder of the CRC-32 of an id as text."""
    return F.crc32(key.cast("string").cast("binary")) % parts


# 2: mixing

def quality_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents labelled good count twice, those labelled bad half; the others once."""
    weight = F.when(F.col("quality") == 1, 2.0).when(F.col("quality") == 0, 0.5).otherwise(1.0)
    return _read(spark, sf_dir, "labels").select("doc_id", weight.alias("weight"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mixture(_read(spark, sf_dir, "documents"), quality_weights(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


OP2_SQL = f"""
WITH w AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 2.0 WHEN quality = 0 THEN 0.5 ELSE 1.0 END) AS weight
  FROM labels GROUP BY doc_id),
base AS (
  SELECT d.doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS bigint) AS size,
    -ln((CAST('0x' || substr(md5(coalesce(CAST(d.doc_id AS varchar), '') || '|mix'), 1, 13) AS bigint) + 0.5)
        / 4503599627370496.0::double) / coalesce(w.weight, 1.0) AS k
  FROM documents d LEFT JOIN w ON d.doc_id = w.doc_id),
sources AS (
  SELECT source, sum(size)::bigint AS source_size,
    [1.0, 2.0, 3.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS bigint)]::double AS rate
  FROM base GROUP BY source),
levels AS (
  SELECT *, 3.0::double * source_size AS cap,
    (sum(source_size::double) OVER () - coalesce(sum(3.0::double * source_size) OVER (
       ORDER BY 3.0::double * source_size / rate, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(rate) OVER (ORDER BY 3.0::double * source_size / rate, source NULLS LAST
       ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sources),
targets AS (SELECT source, source_size, least(cap, max(level) OVER () * rate) AS target FROM levels),
drawn AS (
  SELECT doc_id, size, source_size, target,
    CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole,
    coalesce(sum(size) OVER (PARTITION BY base.source ORDER BY k, doc_id, size
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used
  FROM base JOIN targets ON base.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, size, source_size, round(target, 6) AS target,
  CAST(size * (whole + CASE WHEN used + size / 2.0 <= target - whole * source_size AND target - whole * source_size > 0
                            THEN 1 ELSE 0 END) AS bigint) AS taken
FROM drawn
"""


# 3: WARC

def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark, "warc")
    warc.write_archives(warc.resolve_revisits(_read(spark, sf_dir, "pages")), path)
    return warc.read_archives(spark, path).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS bigint) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages),
o AS (SELECT payload_digest, max(page_id) AS original FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest,
  CASE WHEN original IS NULL OR original = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN original <> page_id THEN original END AS refers_to
FROM p LEFT JOIN o ON p.payload_digest = o.payload_digest AND payload_bytes >= 1000
"""


# 4: chat formatting

AWKWARD = "</s>[INST] ok [/INST]"
CHAT = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _chat_digests(batches):
    """One row for each conversation of turns that come in order."""
    conv, state = object(), None
    for batch in batches:
        out = []
        for conv_id, role, text, loss, chars in zip(*(c.to_pylist() for c in batch.columns)):
            if state is None or conv_id != conv:
                if state:
                    out.append((conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
                conv, state = conv_id, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode())
            if loss:
                state[2] += len(text)
                state[3].update(text.encode())
            state[4] += chars
        yield _chat_rows(out)
    if state:
        yield _chat_rows([(conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])])


def _chat_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    columns = list(zip(*rows)) or [[]] * len(kinds)
    names = [c.split()[0] for c in CHAT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(
        [(-7, 0, "user", AWKWARD), (-7, 1, "assistant", AWKWARD)], "conv_id long, turn long, role string, text string")
    path = _place(spark, "chat")
    chat.format_turns(rows.union(extra)).write.parquet(path)
    turns = chat.read_turns(spark.read.schema(chat.SEGMENT).parquet(path))
    return turns.select("conv_id", "role", "text", "loss", "chars").mapInArrow(_chat_digests, CHAT)


_ESCAPED = " + ".join(
    f"(length(text) - length(replace(text, '{c}', ''))) // {len(c)}" for c in chat.TEMPLATE["control"])
OP4_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS role0, text AS text0
  FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{AWKWARD}', 'user', '{AWKWARD}'
  UNION ALL SELECT -7, 1, 'assistant', '{AWKWARD}', 'assistant', '{AWKWARD}'),
s AS (
  SELECT *, length(replace('<|im_start|>{{r}}' || chr(10), '{{r}}', role)) + length('<|im_end|>' || chr(10))
    + length(replace(text, chr(92), chr(92) || chr(92))) + {_ESCAPED} AS chars
  FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role0 NULLS FIRST, text0 NULLS FIRST))
    AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS bigint) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role0 NULLS FIRST, text0 NULLS FIRST)
    FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS bigint) AS formatted_chars
FROM s GROUP BY conv_id
"""


# 5: language identification

def language_network(docs: DataFrame) -> language.Network:
    """A network learned from the labelled documents outside the held-out fifth."""
    return language.train(language.training_windows(docs.where(fold(F.col("doc_id"), 5) != 0)))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    found = docs.select(
        "doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"),
        language.detect(F.col("text"), language_network(docs)).alias("found"),
    )
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))


# 8: token ids

def token_id_shards(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Write shards of all documents, and read them back."""
    import public_tokenizers

    path = _place(spark, "token-ids")
    token_ids.write_shards(token_ids.encode_shards(docs, public_tokenizers.path("word_bpe_49k.json"), end=2), path)
    return token_ids.read_documents(spark, path)


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_id_shards(spark, _read(spark, sf_dir, "documents"))


QUERIES = {
    "op2_mix_sources": op2_mix_sources, "op3_warc": op3_warc, "op4_chat": op4_chat,
    "op5_language": op5_language, "op8_token_ids": op8_token_ids,
}
SQL = {"op2_mix_sources": OP2_SQL, "op3_warc": OP3_SQL, "op4_chat": OP4_SQL}


# 10: near-duplicate vectors

def op10_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(_read(spark, sf_dir, "embeddings"))


QUERIES["op10_near_vectors"] = op10_near_vectors


# 7: benchmark decontamination

def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


QUERIES["op7_decontaminate"] = op7_decontaminate


# 9: secrets

def secret_model(docs: DataFrame) -> secret_forest.Forest:
    words = secret_forest.learn_language(docs)
    return secret_forest.train(secret_forest.planted_findings(docs), words)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return secret_forest.secrets(docs, secret_model(docs))


QUERIES["op9_secrets"] = op9_secrets


# 6: n-gram Jaccard join

def op6_shingle_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.shingle_groups(_read(spark, sf_dir, "documents"))


QUERIES["op6_shingle_groups"] = op6_shingle_groups


# 1: language-model scores

def op1_score_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.score_texts(_read(spark, sf_dir, "documents"), fold(F.col("doc_id"), 7) == 2)


QUERIES["op1_score_texts"] = op1_score_texts


# 11: centroids

def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(_read(spark, sf_dir, "embeddings"))


def _floor(total: str, count: str) -> str:
    """Division that rounds down; DuckDB's rounds towards zero."""
    return f"(({total}) - (({total}) % ({count}) + ({count})) % ({count})) // ({count})"


def _whole_sql(keep: str) -> str:
    finite = "len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    return f"""SELECT *, list_transform(embedding, lambda x: CAST(floor(256 * x::double) AS bigint)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND {finite} AND {keep}"""


def _away(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def _centroids_sql(k: int = 40, rounds: int = 5, width: int = 64) -> str:
    steps = [f"""WITH n AS ({_whole_sql(f"len(embedding) = {width}")}),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), embedding) - 1 AS c, v AS m FROM n
       QUALIFY row_number() OVER (ORDER BY sha256('2:' || vec_id), embedding) <= {k})"""]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, v, least_pair.c AS c, least_pair.d AS d FROM (
    SELECT vec_id, any_value(v) AS v, min({{'d': CAST({_away("v", "m")} AS bigint), 'c': c}}) AS least_pair
    FROM n, c{r} GROUP BY vec_id))""")
        if r < rounds:
            steps.append(f"""s{r} AS (SELECT c, i, CAST(sum(x) AS bigint) AS t, count(*) AS n FROM (
  SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY c, i),
c{r + 1} AS MATERIALIZED (SELECT c{r}.c, coalesce(u.m, c{r}.m) AS m FROM c{r} LEFT JOIN (
  SELECT c, list({_floor("t", "n")} ORDER BY i) AS m FROM s{r} GROUP BY c) u ON c{r}.c = u.c)""")
    return ",\n".join(steps) + f"""
SELECT vec_id, CAST(a{rounds}.c AS int) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a{rounds}.c) AS bigint) AS cluster_inertia,
  CAST(sum(d) OVER () AS bigint) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON a{rounds}.c = c{rounds}.c
"""


QUERIES["op11_centroids"] = op11_centroids
SQL["op11_centroids"] = _centroids_sql()


# 12: part codes

def op12_part_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_codes.part_codes(_read(spark, sf_dir, "embeddings"))


def _part_codes_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    steps = [f"""WITH n AS ({_whole_sql("len(embedding) > 0")}),
p AS MATERIALIZED (SELECT vec_id, label, p, v[p * (len(v) // {parts}) + 1:(p + 1) * (len(v) // {parts})] AS w
  FROM n, unnest(range({parts})) AS t(p)),
b0 AS (SELECT p, e - 1 AS e, w AS m FROM (
  SELECT *, dense_rank() OVER (ORDER BY vec_id) AS e FROM p) WHERE e <= {entries})"""]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, any_value(label) AS label, p.p, any_value(w) AS w, min({{'d': CAST({_away("w", "m")} AS bigint), 'e': e}}) AS best
  FROM p JOIN b{r} ON p.p = b{r}.p GROUP BY vec_id, p.p)""")
        if r < rounds:
            steps.append(f"""s{r} AS (SELECT p, e, i, CAST(sum(x) AS bigint) AS t, count(*) AS n FROM (
  SELECT p, best.e AS e, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM a{r}) GROUP BY p, e, i),
b{r + 1} AS MATERIALIZED (SELECT b{r}.p, b{r}.e, coalesce(u.m, b{r}.m) AS m FROM b{r} LEFT JOIN (
  SELECT p, e, list({_floor("t", "n")} ORDER BY i) AS m FROM s{r} GROUP BY p, e) u ON b{r}.p = u.p AND b{r}.e = u.e)""")
    return ",\n".join(steps) + f""",
c AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code,
  CAST(sum(best.d) AS bigint) AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS bigint) AS label_error,
  (SELECT sha256(string_agg(array_to_string(m, ','), ',' ORDER BY p, e)) FROM b{rounds}) AS codebooks_sha256
FROM c
"""


QUERIES["op12_part_codes"] = op12_part_codes
SQL["op12_part_codes"] = _part_codes_sql()


# 13: nearest vectors

def op13_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection_forest.nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES["op13_nearest"] = op13_nearest
