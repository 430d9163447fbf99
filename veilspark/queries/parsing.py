"""Sources: paths, formats, chunks, logs, exports and embedded payloads."""

from __future__ import annotations

import io
import uuid
import zipfile
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import paths
from ..plans.staging import shared_folder, stage
from ..sources import account_export, embedded, plain_text, ranges, session_log
from ..sources.files import classify, from_contents, read_root
from ..sources.writing import write_files
from ..sources.tables import conversation_records, document_records
from ..sources.transcripts import with_format

from .common import chunk_sql, quoted, table

# Endings and folders given to documents by turns, to make paths of every sort.
ENDINGS = (".txt", ".JSONL", ".json", ".png", "", ".md", ".log", ".tar.gz", ".text")
FOLDERS = ("notes", ".git", "tool-results", "memory", "..", "a/tool_results", "__MACOSX", "deep/er")
NAMES = ("", "._", "Instructions-")
# Bytes of a part: small, so that texts run over several.
EXPORT_PART, FOLDER_PART = 300, 1000


def _pick(values: tuple[str, ...], by: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (by % len(values) + 1).cast("int"))


def _pick_sql(values: tuple[str, ...], by: str) -> str:
    return f"([{', '.join(quoted(v) for v in values)}])[CAST({by} % {len(values)} + 1 AS bigint)]"


def _paths(spark: SparkSession, d: str) -> DataFrame:
    doc = F.col("doc_id")
    path = F.concat(
        "source", F.lit("/"), _pick(FOLDERS, doc), F.lit("/"), _pick(NAMES, F.floor(doc / 5)),
        doc.cast("string"), _pick(ENDINGS, doc),
    )
    return table(spark, d, "documents").select("doc_id", path.alias("path"), (F.col("n_chars") % 50).alias("size"))


def _classify(spark: SparkSession, d: str) -> DataFrame:
    listed = _paths(spark, d)
    files, skipped = classify(listed.where(~paths.is_unsafe(F.col("path"))).select("path", "size"))
    unsafe = listed.where(paths.is_unsafe(F.col("path"))).select("path", F.lit("unsafe path in archive").alias("reason"))
    return (
        files.select("path", "employee", F.lit("").alias("reason"))
        .unionByName(skipped.unionByName(unsafe).select("path", F.lit("").alias("employee"), "reason"))
    )


def _kind_and_session(spark: SparkSession, d: str) -> DataFrame:
    path = F.col("path")
    return _paths(spark, d).select(
        "path", plain_text.kind_of(path).alias("kind"), plain_text.session_of(path).alias("session_id"),
        paths.suffix(path).alias("suffix"), paths.stem(paths.file_name(path)).alias("stem"),
    )


def _formats(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations")
    n = F.col("conv_id") + F.col("turn")
    name = F.concat(
        _pick(("log", "conversations", "x"), F.col("conv_id")), F.col("conv_id").cast("string"),
        _pick((".jsonl", ".json", ".TXT", ".pdf"), n),
    )
    body = _pick(('{"type": "user"}', "", '{"other": 1}', ' [{"chat_messages": []}]', "[1]", '{"message": '), F.col("turn"))
    files = turns.select(
        F.concat(F.lit("p/"), F.col("turn").cast("string"), F.lit("/"), name).alias("path"),
        F.concat(body, F.when(F.length(body) > 0, F.lit("\n")).otherwise(""), F.when(body != "", F.col("text")).otherwise(""))
        .cast("binary").alias("content"),
    )
    return with_format(files).select("path", "format")


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return document_records(table(spark, d, "documents")).select(
        "employee", "file", "block_index", F.length("text").alias("n"), F.md5(F.col("text").cast("binary")).alias("digest")
    )


# -- session logs ------------------------------------------------------------


def _log_lines(spark: SparkSession, d: str) -> DataFrame:
    """One log entry per conversation turn, shaped by its role."""
    turns = table(spark, d, "conversations")
    none, text, turn = F.lit(None).cast("string"), F.col("text"), F.col("turn")
    result = F.struct(text.alias("stdout"), F.lit(True).alias("ok"), turn.alias("n"))

    def block(kind, body=none, thinking=none, content=None, given=None):
        empty_result = F.lit(None).cast("struct<stdout:string,ok:boolean,n:bigint>")
        empty_input = F.lit(None).cast("struct<q:string>")
        return F.struct(
            F.lit(kind).alias("type"), body.alias("text"), thinking.alias("thinking"),
            (content if content is not None else empty_result).alias("content"),
            (given if given is not None else empty_input).alias("input"),
        )

    def message(*blocks):
        return F.struct(F.col("role").alias("role"), F.array(*blocks).alias("content"))

    def entry(**fields):
        return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))

    session = F.concat(F.lit("s"), F.col("conv_id").cast("string"))
    line = (
        F.when(
            F.col("role") == "user",
            entry(
                type=F.lit("user"), sessionId=session,
                message=message(block("text", text), block("image"), block("tool_result", content=result)),
                toolUseResult=F.array(F.lit("raw"), text),
            ),
        )
        .when(
            F.col("role") == "assistant",
            entry(
                type=F.lit("assistant"), timestamp=F.concat(F.lit("T"), turn.cast("string")),
                message=message(
                    block("thinking", thinking=text), block("text", text),
                    block("tool_use", given=F.struct(text.alias("q"))), block("redacted_thinking"), block("strange"),
                ),
            ),
        )
        .otherwise(entry(type=F.lit("system"), content=text))
    )
    person = F.concat(F.lit("c"), (F.col("conv_id") % 20).cast("string"))
    path = F.concat(person, F.lit("/"), F.col("conv_id").cast("string"), F.lit(".jsonl"))
    return turns.select(
        path.alias("path"), person.alias("employee"), F.split(path, "/").alias("file_key"),
        turn.alias("record_index"), line.alias("line"),
    )


def _log_records(spark: SparkSession, d: str) -> DataFrame:
    found, _ = session_log.parse_lines(_log_lines(spark, d))
    return found.select(
        "file", "record_index", "block_index", "kind", "session_id", "timestamp",
        F.md5(F.col("text").cast("binary")).alias("digest"),
    )


def _log_problems(spark: SparkSession, d: str) -> DataFrame:
    return session_log.parse_lines(_log_lines(spark, d))[1].select("file", "record_index", "code", "message")


# -- account exports ---------------------------------------------------------


def _exports(spark: SparkSession, d: str) -> DataFrame:
    """An export file per fifty turns, holding them twice and a broken conversation."""
    person = F.concat(F.lit("c"), (F.col("conv_id") % 20).cast("string"))
    message = F.struct(
        "turn", F.col("role").alias("sender"), F.concat(F.lit("T"), F.col("turn").cast("string")).alias("created_at"),
        F.lit("flat").alias("text"),
        F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))).alias("content"),
        F.array(
            F.struct(F.lit("a.txt").alias("file_name"), F.concat(F.lit("x"), F.col("text")).alias("extracted_content")),
            F.struct(F.lit("b.txt").alias("file_name"), F.lit(" ").alias("extracted_content")),
        ).alias("attachments"),
    )
    part = F.floor(F.col("turn") / 50).alias("part")
    grouped = table(spark, d, "conversations").groupBy("conv_id", part, person.alias("employee")).agg(
        F.array_sort(F.collect_list(message)).alias("chat_messages")
    )
    body = F.to_json(F.struct(
        F.concat(F.lit("u"), F.col("conv_id").cast("string")).alias("uuid"), F.lit("Name").alias("name"), "chat_messages"
    ))
    path = F.concat(
        "employee", F.lit("/conversations-"), F.col("conv_id").cast("string"), F.lit("-"),
        F.col("part").cast("string"), F.lit(".json"),
    )
    return grouped.select(
        path.alias("path"), "employee", F.split(path, "/").alias("file_key"),
        F.concat(F.lit("["), body, F.lit(', {"name": "odd"}, '), body, F.lit("]")).cast("binary").alias("content"),
    )


def _parsed_exports(spark: SparkSession, d: str) -> list[tuple[DataFrame, DataFrame]]:
    """Read in parts far smaller than a conversation, so most of them run over several."""
    found = ranges.parts(from_contents(stage(_exports(spark, d), "exports")), lambda name, text, whole: F.lit("export"), size=EXPORT_PART)
    return [account_export.parse(rows, several) for rows, several in found]


def _export_records(spark: SparkSession, d: str) -> DataFrame:
    found = reduce(DataFrame.unionByName, [rows for rows, _ in _parsed_exports(spark, d)])
    return found.select(
        "file", "record_index", "block_index", "kind", "session_id", "title", "timestamp",
        F.md5(F.col("text").cast("binary")).alias("digest"),
    )


def _export_problems(spark: SparkSession, d: str) -> DataFrame:
    met = reduce(DataFrame.unionByName, [met for _, met in _parsed_exports(spark, d)])
    return met.select("file", "code", "message")


# -- embedded payloads -------------------------------------------------------

PNG = "89504E470D0A1A0A" + "00" * 60


def _with_payloads(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations")

    def one_line(payload: Column) -> Column:
        return F.regexp_replace(F.base64(payload), "[\r\n]", "")

    encoded = one_line(F.col("text").cast("binary"))
    image = one_line(F.unhex(F.lit(PNG)))
    wrapped = turns.withColumn("text", F.concat(F.lit("see "), encoded, F.lit(" and "), image, F.lit(" end")))
    return conversation_records(wrapped)


def _payload_records(spark: SparkSession, d: str) -> DataFrame:
    expanded, _ = embedded.expand(_with_payloads(spark, d))
    return expanded.where(F.col("block_index") >= embedded.FIRST_BLOCK).select(
        "file", "record_index", "block_index", "kind", F.md5(F.col("text").cast("binary")).alias("digest")
    )


def _payload_problems(spark: SparkSession, d: str) -> DataFrame:
    return embedded.expand(_with_payloads(spark, d))[1].select("file", "record_index", "code", "message")


def _folder_scan(spark: SparkSession, d: str) -> DataFrame:
    """The documents written as a folder per person, many names hidden, then read back in small parts as a scan root."""
    root = f"{shared_folder(spark)}/tree-{uuid.uuid4().hex}"
    name = F.concat(_pick(("", ".", "_"), F.col("doc_id")), F.col("doc_id").cast("string"), F.lit(".txt"))
    documents = table(spark, d, "documents").where("text <> ''")
    write_files(documents.select(
        F.concat_ws("/", F.concat(F.lit("source="), "source"), F.concat(_pick((".lang=", "lang="), F.col("doc_id")), "lang"), name).alias("path"),
        F.col("text").cast("binary").alias("content")), root)
    text = F.col("text")
    folder = F.regexp_replace(paths.parts(F.col("path"))[1], "^[.]", "")
    return read_root(spark, root).parts(FOLDER_PART).groupBy("employee", folder.alias("folder")).agg(
        F.sum(F.length(text)).alias("characters"),
        F.sum(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).alias("lines"),
    )


@F.pandas_udf(T.BinaryType())
def _zipped(folders: pd.Series, names: pd.Series, texts: pd.Series) -> pd.Series:
    """An archive with a document, clutter, an unsafe path, an empty file, another type and a damaged member."""
    def one(folder: str, name: str, text: str) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as archive:
            for member, data in ((f"{folder}/{name}.txt", text), (f"{folder}\\notes\\{name}.md", "note"), ("__MACOSX/x.txt", "x"),
                                 ("../up.txt", "x"), (f"{folder}/none.txt", ""), (f"{folder}/x.png", "x")):
                archive.writestr(member, data)
            archive.writestr(f"{folder}/damaged.txt", "bytes as they were")
        return out.getvalue().replace(b"bytes as they were", b"bytes as they are!")

    return pd.Series([one(f, n, t) for f, n, t in zip(folders, names, texts)])


def _zip_scan(spark: SparkSession, d: str) -> DataFrame:
    """Every document in an archive of its own, some cut off in the middle: what is read, and what is left out."""
    root, name = f"{shared_folder(spark)}/zips-{uuid.uuid4().hex}", F.col("doc_id").cast("string")
    content = _zipped(F.coalesce("source", F.lit("nobody")), name, F.coalesce("text", F.lit("")))
    cut = F.when(F.col("doc_id") % 9 == 0, F.substring(content, 1, 40)).otherwise(content)
    write_files(table(spark, d, "documents").select(F.concat(name, F.lit(".zip")).alias("path"), cut.alias("content")), root)
    opened = read_root(spark, f"{root}/*.zip")
    files = opened.parts(FOLDER_PART).where("problem IS NULL").groupBy(F.col("employee").alias("who")).agg(
        F.countDistinct("file_id").alias("n"), F.sum(F.length("content")).cast("bigint").alias("bytes"))
    reasons = opened.skipped.groupBy(F.substring_index("reason", " (", 1).alias("who")).agg(
        F.count("*").alias("n"), F.lit(0).cast("bigint").alias("bytes"))
    return files.unionByName(reasons)


QUERIES = {
    "folder_scan": _folder_scan,
    "zip_scan": _zip_scan,
    "classify_paths": _classify,
    "kind_and_session": _kind_and_session,
    "file_formats": _formats,
    "document_chunks": _chunks,
    "session_log_records": _log_records,
    "session_log_problems": _log_problems,
    "account_export_records": _export_records,
    "account_export_problems": _export_problems,
    "embedded_records": _payload_records,
    "embedded_problems": _payload_problems,
}

_DOC_PATHS = f"""
    SELECT doc_id, n_chars % 50 AS size, source || '/' || {_pick_sql(FOLDERS, 'doc_id')} || '/'
           || {_pick_sql(NAMES, 'doc_id // 5')} || CAST(doc_id AS varchar) || {_pick_sql(ENDINGS, 'doc_id')} AS path
    FROM documents"""
_FILE = "split_part(path, '/', -1)"
_SUFFIX = "CASE WHEN contains(path, '.') THEN '.' || lower(split_part(path, '.', -1)) ELSE '' END"
_STEM = "regexp_replace(file, '\\.[^.]*$', '')"
_CONV_FILE = "'c' || CAST(conv_id % 20 AS varchar) || '/' || CAST(conv_id AS varchar) || '.jsonl'"
_EXPORT_FILE = "'c' || CAST(conv_id % 20 AS varchar) || '/conversations-' || CAST(conv_id AS varchar) || '-' || CAST(turn // 50 AS varchar) || '.json'"
_KIND = "CASE role WHEN 'user' THEN 'user_message' WHEN 'system' THEN 'system_prompt' ELSE 'assistant_message' END"
_BYTES = "octet_length(encode(text))"
_LONG = f"4 * ({_BYTES} // 3) + CASE {_BYTES} % 3 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 3 END >= 64"


def _log_sql(block: int, kind: str, role: str, body: str, session: str, timestamp: str) -> str:
    return (
        f"SELECT {_CONV_FILE} AS file, turn AS record_index, {block} AS block_index, '{kind}' AS kind, "
        f"{session} AS session_id, {timestamp} AS \"timestamp\", md5({body}) AS digest FROM conversations "
        f"WHERE role = '{role}'"
    )


_OWN, _STEM_SESSION = "'s' || CAST(conv_id AS varchar)", "CAST(conv_id AS varchar)"
_T = "'T' || CAST(turn AS varchar)"

SQL = {
    "zip_scan": """
        WITH whole AS (SELECT coalesce(source, 'nobody') AS source, strlen(coalesce(text, '')) AS bytes FROM documents WHERE doc_id % 9 <> 0),
        each AS (SELECT count(*) AS n FROM whole)
        SELECT source AS who, CAST(count(*) + count(*) FILTER (bytes > 0) AS bigint) AS n, CAST(sum(bytes + 4) AS bigint) AS bytes
        FROM whole GROUP BY source
        UNION ALL SELECT 'not a readable ZIP', count(*), 0 FROM documents WHERE doc_id % 9 = 0
        UNION ALL SELECT 'unreadable', n, 0 FROM each
        UNION ALL SELECT 'unsafe path in archive', n, 0 FROM each
        UNION ALL SELECT 'unsupported file type', n, 0 FROM each
        UNION ALL SELECT 'empty file', n + (SELECT count(*) FROM whole WHERE bytes = 0), 0 FROM each""",
    "folder_scan": """
        SELECT 'source=' || source AS employee, 'lang=' || lang AS folder, CAST(sum(length(text)) AS bigint) AS characters,
               CAST(sum(length(text) - length(replace(text, chr(10), ''))) AS bigint) AS lines
        FROM (SELECT source, lang, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS text FROM documents WHERE text <> '')
        GROUP BY ALL""",
    "classify_paths": f"""
        WITH p AS (SELECT *, {_FILE} AS file, string_split(path, '/') AS parts, {_SUFFIX} AS suffix FROM ({_DOC_PATHS})),
        tidy AS (
          SELECT *, CASE WHEN list_contains(parts, '..') THEN 'unsafe path in archive'
                         WHEN suffix NOT IN ('.jsonl', '.json', '.txt', '.md', '.log', '.text')
                         THEN 'unsupported file type (' || CASE suffix WHEN '' THEN 'no extension' ELSE suffix END || ')'
                         WHEN size = 0 THEN 'empty file' ELSE '' END AS reason
          FROM p WHERE list_contains(parts, '..') OR NOT (starts_with(file, '._')
                OR list_has_any(parts[1:-2], ['__MACOSX', '.git', 'node_modules', '__pycache__', '.tmp'])))
        SELECT path, CASE reason WHEN '' THEN parts[1] ELSE '' END AS employee, reason FROM tidy""",
    "kind_and_session": f"""
        SELECT path, CASE WHEN contains(lower(path), 'tool-results/') OR contains(lower(path), 'tool_results/') THEN 'tool_result'
                          WHEN contains(lower(path), '/memory/') OR contains(lower(path), 'instruction') THEN 'system_prompt'
                          ELSE 'attachment' END AS kind,
               CASE WHEN list_contains(['tool-results', 'tool_results'], parts[-2]) THEN parts[-3] ELSE {_STEM} END AS session_id,
               {_SUFFIX} AS suffix, {_STEM} AS stem
        FROM (SELECT *, {_FILE} AS file, string_split(path, '/') AS parts FROM ({_DOC_PATHS}))""",
    "file_formats": f"""
        SELECT 'p/' || CAST(turn AS varchar) || '/' || name AS path,
               CASE WHEN body = 1 THEN 'empty'
                    WHEN name LIKE '%.jsonl' AND body = 0 THEN 'session_log'
                    WHEN name LIKE '%.json' AND (name LIKE 'conversations%' OR body = 3) THEN 'account_export'
                    WHEN name LIKE '%.TXT' THEN 'plain_text' ELSE 'unrecognised' END AS format
        FROM (SELECT turn, turn % 6 AS body, {_pick_sql(('log', 'conversations', 'x'), 'conv_id')} || CAST(conv_id AS varchar)
                     || {_pick_sql(('.jsonl', '.json', '.TXT', '.pdf'), '(conv_id + turn)')} AS name
              FROM conversations)""",
    "document_chunks": f"""
        SELECT source AS employee, source || '/' || CAST(doc_id AS varchar) || '.txt' AS file, chunk_index AS block_index,
               length(chunk) AS n, md5(chunk) AS digest FROM ({chunk_sql()})""",
    "session_log_records": " UNION ALL ".join([
        _log_sql(0, "user_message", "user", "text", _OWN, "''"),
        _log_sql(2, "tool_result", "user", "'stdout: ' || text || chr(10) || 'ok: True' || chr(10) || 'n: ' || CAST(turn AS varchar)", _OWN, "''"),
        _log_sql(900, "tool_result", "user", "'raw' || chr(10) || text", _OWN, "''"),
        _log_sql(0, "assistant_message", "assistant", "text", _STEM_SESSION, _T),
        _log_sql(1, "assistant_message", "assistant", "text", _STEM_SESSION, _T),
        _log_sql(2, "tool_call", "assistant", "'q: ' || text", _STEM_SESSION, _T),
        _log_sql(0, "system_prompt", "system", "text", _STEM_SESSION, "''"),
    ]),
    "session_log_problems": f"""
        SELECT file, turn AS record_index, code, file || ':' || CAST(turn + 1 AS varchar) || ': ' || what AS message
        FROM (SELECT {_CONV_FILE} AS file, turn, 'unscanned' AS code, 'skipped image content (no OCR in v1)' AS what
              FROM conversations WHERE role = 'user'
              UNION ALL SELECT {_CONV_FILE}, turn, 'unscanned', 'skipped redacted content' FROM conversations WHERE role = 'assistant'
              UNION ALL SELECT {_CONV_FILE}, turn, 'unknown_block', 'unrecognised block type ''strange'' — not scanned'
              FROM conversations WHERE role = 'assistant')""",
    "account_export_records": f"""
        WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn // 50 ORDER BY turn) - 1 AS nth,
                          count(*) OVER (PARTITION BY conv_id, turn // 50) AS n FROM conversations),
        twice AS (SELECT *, nth AS position FROM c UNION ALL SELECT *, n + nth FROM c)
        SELECT {_EXPORT_FILE} AS file, position AS record_index, block AS block_index,
               CASE WHEN block = 1 THEN 'attachment' WHEN role = 'user' THEN 'user_message' ELSE 'assistant_message' END AS kind,
               'u' || CAST(conv_id AS varchar) AS session_id, 'Name' AS title, {_T} AS "timestamp",
               md5(CASE block WHEN 0 THEN text ELSE 'a.txt' || chr(10) || 'x' || text END) AS digest
        FROM twice, (SELECT unnest([0, 1]) AS block)""",
    "account_export_problems": f"""
        SELECT DISTINCT {_EXPORT_FILE} AS file, 'bad_conversation' AS code,
               {_EXPORT_FILE} || ': conversation ''conversation-1'' has no chat_messages' AS message FROM conversations""",
    "embedded_records": f"""
        SELECT {_CONV_FILE} AS file, turn AS record_index, 800 AS block_index, {_KIND} AS kind, md5(text) AS digest
        FROM conversations WHERE {_LONG}""",
    "embedded_problems": f"""
        SELECT {_CONV_FILE} AS file, turn AS record_index, 'signature' AS code,
               {_CONV_FILE} || '#' || CAST(turn AS varchar) || '.0: embedded PNG image not scanned (68 bytes)' AS message
        FROM conversations""",
}
