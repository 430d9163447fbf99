"""Rules, gates, suppression, snippets and masking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import redact
from ..operators.collapse import collapse, ranked
from ..operators.detect import BULK, hits, surviving, suppressions
from ..operators.sanitise import sanitise
from ..operators.terms import term_matches
from ..plans.scan import findings
from ..plans.transcripts import PERSONAL, TEMPLATES, keyed, single_finding_records
from ..rules.model import RuleSet, load_rules, with_terms
from ..schema import records
from ..sources.tables import conversation_records, document_records, page_records
from .common import chunk_sql, luhn_sql, matches_sql, quoted, redact_sql, suppressed_sql, table, window_sql

CARD, EMAIL = "pii.payment_card.v1", "pii.email_address.v1"


def _custom(*rules: dict, suppress: list[dict] | None = None) -> RuleSet:
    """A pack of test rules that share everything but their pattern and gates."""
    shared = {"name": "custom", "category": "internal", "subtype": "custom", "severity": "medium"}
    return load_rules([{"pack": "custom", "rules": [{**shared, **r} for r in rules], "suppress": suppress or []}])


# -- bundled rules on the documents ------------------------------------------


def _payment_card(spark: SparkSession, d: str) -> DataFrame:
    chunks = document_records(table(spark, d, "documents"))
    found = ranked(collapse(hits(chunks, load_rules().select(CARD), shapes=False)))
    return found.select(
        "finding_id", "employee", "rule_id", "severity", "confidence", "location", "session_id",
        "value_redacted", "occurrences",
    )


def _suppressions(spark: SparkSession, d: str) -> DataFrame:
    chunks = document_records(table(spark, d, "documents"))
    return suppressions(hits(chunks, load_rules().select(CARD, EMAIL), shapes=False))


_TAG = "substr(md5(c_name), 1, 20)"
#: For each suppressor a text it removes a match from, as SQL over ``customer``.
NOISE_TEXTS = {
    "noise.placeholder_value": f"'API_KEY=changeme' || {_TAG}",
    "noise.angle_bracket_template": f"'DB_PASSWORD=${{' || {_TAG} || '}}'",
    "noise.provider_documentation_example": f"'API_KEY=foobar' || {_TAG}",
    "noise.test_key_prefix": f"'use sk_test_' || {_TAG}",
    "noise.known_test_card": f"'card 4111 1111 1111 1111 of ' || {_TAG}",
    "noise.reserved_domain": f"'mail u' || {_TAG} || '@npmjs.com'",
    "noise.reserved_ip_range": f"'DB_PASSWORD=pw-192.0.2.7-' || {_TAG}",
    "noise.test_fixture_context": f"'test fixture API_KEY=' || {_TAG}",
    "noise.image_data_uri": f"'ICON_KEY=data:image/png;base64,' || {_TAG}",
    "noise.git_object_hash": f"'commit 9f3a61c7 API_KEY=' || {_TAG}",
}


def _each_suppressor(spark: SparkSession, d: str) -> DataFrame:
    """People from whom a suppressor removed something, by the suppressor a text is for."""
    texts = F.array(*[
        F.struct(F.lit(name).alias("planted"), F.expr(text).alias("text"), F.lit(i).alias("nth"))
        for i, (name, text) in enumerate(NOISE_TEXTS.items())])
    rows = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("who"), F.explode(texts).alias("t"))
    found = hits(records(
        rows, employee=F.col("who"), session_id=F.col("t.planted"), kind=F.lit("tool_result"), text=F.col("t.text"),
        file=F.concat(F.lit("c/"), F.col("who")), record_index=F.col("t.nth")))
    return found.select(F.col("session_id").alias("planted"), "suppressed_by", "employee").distinct().groupBy(
        "planted", "suppressed_by").agg(F.count("*").alias("people"))


def _full_scan(source, name: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return findings(source(table(spark, d, name))).drop("value", "seq")

    return run


# -- every bundled rule, one value each --------------------------------------


def _rules(pack: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        keys = keyed(table(spark, d, "customer"), "c_custkey", "c_name")
        found = surviving(hits(single_finding_records(keys, TEMPLATES[pack])))
        return found.where(F.col("rule_id") == F.col("session_id")).select(
            "rule_id", "employee", "start", "end", "value", "severity", "confidence", "category", "subtype"
        )

    return run


def _rules_sql(pack: str) -> str:
    by_id = {r.id: r for r in load_rules().rules}
    parts = []
    for t in TEMPLATES[pack]:
        r = by_id[t.rule_id]
        parts.append(
            f"SELECT '{r.id}' AS rule_id, 'p' || CAST(key AS varchar) AS employee, {len(t.before)} AS start, "
            f"{len(t.before)} + length({t.value}) AS \"end\", {t.value} AS value, '{r.severity}' AS severity, "
            f"{r.confidence} AS confidence, '{r.category}' AS category, '{r.subtype}' AS subtype FROM keys"
        )
    return "WITH keys AS (SELECT c_custkey AS key, md5(c_name) AS tag FROM customer) " + " UNION ALL ".join(parts)


# -- gates, with rules of our own --------------------------------------------

KINDS_RULE = {"id": "custom.capital.v1", "pattern": "[A-Z][a-z]{6,}", "kinds": ["user_message"]}
CONTEXT_RULE = {"id": "custom.long.v1", "pattern": "[a-z]{12}", "requires_context": ["the", "LA "], "context_window": 25}
ENTROPY_RULE = {"id": "custom.hex.v1", "pattern": "[a-f0-9]{8}", "min_entropy": 2.6}
MIDDLE_RULE = {"id": "custom.middle.v1", "pattern": "([a-f])([0-9]+)(?:[a-f])", "group": 2}
ORDER_RULE = {"id": "custom.seven.v1", "pattern": "[a-z]{7}", "ignore": ["^th", "ing$"], "category": "secret"}
ORDER_SUPPRESS = [
    {"id": "custom.window", "name": "w", "scope": "window", "pattern": "token", "categories": ["secret"]},
    {"id": "custom.value", "name": "v", "scope": "value", "pattern": "er$"},
    {"id": "custom.other", "name": "o", "scope": "value", "pattern": ".", "categories": ["pii"]},
]


def _gate_kinds(spark: SparkSession, d: str) -> DataFrame:
    turns = conversation_records(table(spark, d, "conversations"))
    return surviving(hits(turns, _custom(KINDS_RULE), shapes=False)).select("location", "kind", "start", "value")


def _gate_context(spark: SparkSession, d: str) -> DataFrame:
    chunks = document_records(table(spark, d, "documents"))
    return surviving(hits(chunks, _custom(CONTEXT_RULE), shapes=False)).select("location", "start", "value")


def _hex_records(spark: SparkSession, d: str) -> DataFrame:
    keys = keyed(table(spark, d, "orders"), "o_orderkey", "o_orderkey")
    return records(
        keys, employee=F.lit("e"), session_id=F.col("key").cast("string"), kind=F.lit("tool_result"),
        text=F.col("tag"), file=F.lit("f"), record_index=F.col("key"),
    )


def _gate_entropy(spark: SparkSession, d: str) -> DataFrame:
    found = surviving(hits(_hex_records(spark, d), _custom(ENTROPY_RULE), shapes=False))
    return found.select(F.col("session_id").cast("bigint").alias("key"), "start", "value")


def _value_group(spark: SparkSession, d: str) -> DataFrame:
    found = surviving(hits(_hex_records(spark, d), _custom(MIDDLE_RULE), shapes=False))
    return found.select(F.col("session_id").cast("bigint").alias("key"), "start", "end", "value")


def _gate_order(spark: SparkSession, d: str) -> DataFrame:
    chunks = document_records(table(spark, d, "documents"))
    found = hits(chunks, _custom(ORDER_RULE, suppress=ORDER_SUPPRESS), shapes=False)
    return found.groupBy("location", F.coalesce("suppressed_by", F.lit("(kept)")).alias("outcome")).agg(
        F.count("*").alias("n")
    )


PART_TYPES = ('ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD')


def _terms(spark: SparkSession, d: str) -> DataFrame:
    """Customer terms: the part types, looked for in lines about parts."""
    rules = with_terms(load_rules(), PART_TYPES).select("internal.custom_term.v1")
    parts = table(spark, d, "part")
    lines = records(
        parts, employee=F.col("p_brand"), session_id=F.lit("s"), kind=F.lit("user_message"),
        text=F.concat(F.lit("ship the "), F.lower("p_type"), F.lit(" lot")),
        file=F.lit("f"), record_index=F.col("p_partkey"),
    )
    return surviving(hits(lines, rules, shapes=False)).select("employee", "location", "start", "value")


def _many_terms(spark: SparkSession, d: str) -> DataFrame:
    """As many terms as there are parts, looked for in a line for each item sold."""
    terms = table(spark, d, "part").select(F.concat(F.lit("Lot "), F.col("p_partkey").cast("string")).alias("term"))
    part, supplier = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    lines = records(
        table(spark, d, "lineitem"), employee=F.lit("e"), session_id=F.lit("s"), kind=F.lit("user_message"),
        text=F.concat(F.lit("sent lot "), part, F.lit(" with LOT-"), supplier, F.lit(", lot "), part, F.lit("x or lot "), supplier),
        file=F.col("l_orderkey").cast("string"), record_index=F.col("l_linenumber"),
    )
    return term_matches(lines, terms).select("location", "start", "value")


# -- snippets ----------------------------------------------------------------

SNIPPET_RULES = (
    {"id": "custom.a.v1", "pattern": r"NEEDLE\d{4}"},
    {"id": "custom.b.v1", "pattern": r"\d{4}X"},
    {"id": "custom.c.v1", "pattern": r"far\d{4}[a-f0-9]{32}"},
)


def _snippets(spark: SparkSession, d: str) -> DataFrame:
    keys = keyed(table(spark, d, "customer"), "c_custkey", "c_name")
    number = F.lpad((F.col("key") % 10000).cast("string"), 4, "0")
    text = F.concat("tag", F.lit("  \n NEEDLE"), number, F.lit("X z"), F.substring("tag", 1, 20), F.lit(" far"), number, "tag")
    rows = records(
        keys, employee=F.lit("e"), session_id=F.col("key").cast("string"), kind=F.lit("tool_result"), text=text,
        file=F.lit("f"), record_index=F.col("key"),
    )
    return surviving(hits(rows, _custom(*SNIPPET_RULES), shapes=False)).select("location", "rule_id", "start", "snippet")


def _sanitise(spark: SparkSession, d: str) -> DataFrame:
    """Each snippet quotes the value another finding holds."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    key = F.col("o_orderkey")

    def value(k):
        return F.concat(F.lit("val-"), F.md5(k.cast("string").cast("binary")))

    made = orders.select(
        F.lit("r.v1").alias("rule_id"), F.concat(F.lit("e"), F.col("o_custkey").cast("string")).alias("employee"),
        F.lit("secret").alias("category"), F.lit("s").alias("subtype"), F.lit("high").alias("severity"),
        F.lit(90).alias("confidence"), F.concat(F.lit("f#"), key.cast("string"), F.lit(".0")).alias("location"),
        value(key).alias("value"), F.concat(F.lit("…near "), value(key + 1), F.lit(" and val-0 here…")).alias("snippet"),
        F.lit(False).alias("descriptive"), F.md5(key.cast("string").cast("binary")).alias("finding_id"),
    )
    return sanitise(made).select("location", "snippet")


# -- bulk personal data ------------------------------------------------------

BULK_LINES = [
    t for t in PERSONAL if t.rule_id in (
        "pii.uk_ni_number.v1", "pii.email_address.v1", "pii.uk_phone.v1", "pii.uk_postcode.v1",
        "pii.person_name.v1", "pii.home_address.v1", "special.criminal_record.v1",
    )
]


def _bulk(spark: SparkSession, d: str) -> DataFrame:
    """Five to seven kinds of personal data per customer; six make a bulk finding."""
    keys = keyed(table(spark, d, "customer"), "c_custkey", "c_name")
    lines = [
        F.concat(F.lit(t.before), F.expr(t.value), F.lit(t.after)) for t in BULK_LINES
    ]
    how_many = F.lit(5) + F.col("key") % 3
    rows = records(
        keys, employee=F.concat(F.lit("p"), F.col("key").cast("string")), session_id=F.lit("s"),
        kind=F.lit("tool_result"), text=F.array_join(F.slice(F.array(*lines), F.lit(1), how_many.cast("int")), "\n"),
        file=F.lit("f"), record_index=F.col("key"),
    )
    return surviving(hits(rows)).where(F.col("rule_id") == BULK[0]).select("employee", "severity", "value", "snippet")


QUERIES = {
    "detect_payment_card": _payment_card,
    "detect_suppressions": _suppressions,
    "each_suppressor": _each_suppressor,
    "scan_documents": _full_scan(document_records, "documents"),
    "scan_conversations": _full_scan(conversation_records, "conversations"),
    "scan_pages": _full_scan(page_records, "pages"),
    **{f"rules_{pack}": _rules(pack) for pack in TEMPLATES},
    "gate_kinds": _gate_kinds,
    "gate_context": _gate_context,
    "gate_entropy": _gate_entropy,
    "gate_order": _gate_order,
    "value_group": _value_group,
    "customer_terms": _terms,
    "many_terms": _many_terms,
    "masked_snippets": _snippets,
    "sanitise_snippets": _sanitise,
    "bulk_personal": _bulk,
}


def _pattern(rule_id: str) -> str:
    return next(r.pattern for r in load_rules().rules if r.id == rule_id)


_CHUNKS = f"SELECT doc_id, source, chunk_index, chunk AS text FROM ({chunk_sql()})"
_KEYS = "doc_id, source, chunk_index"
_CARD_HITS = f"""
    SELECT *, {suppressed_sql(load_rules(), 'pii')} AS why FROM ({matches_sql(_CHUNKS, _KEYS, _pattern(CARD))})
    WHERE {luhn_sql("regexp_replace(value, '[^0-9]', '', 'g')")}"""
_EMAIL_HITS = f"""
    SELECT *, {suppressed_sql(load_rules(), 'pii')} AS why FROM ({matches_sql(_CHUNKS, _KEYS, _pattern(EMAIL))})"""
_TURNS = """SELECT 'c' || CAST(conv_id % 20 AS varchar) || '/' || CAST(conv_id AS varchar) || '.jsonl#'
            || CAST(turn AS varchar) || '.0' AS location, text FROM conversations WHERE role = 'user' AND trim(text) <> ''"""
_DOC_LOCATION = "source || '/' || CAST(doc_id AS varchar) || '.txt#0.' || CAST(chunk_index AS varchar)"
_BULK_COUNT = "5 + key % 3"
_SUBTYPES = [next(r.subtype for r in load_rules().rules if r.id == t.rule_id) for t in BULK_LINES]
_N4 = "lpad(CAST(c_custkey % 10000 AS varchar), 4, '0')"

SQL = {
    "detect_payment_card": f"""
        SELECT left(sha256(source || chr(31) || '{CARD}' || chr(31) || value), 16) AS finding_id, source AS employee,
               '{CARD}' AS rule_id, 'critical' AS severity, 90 AS confidence,
               arg_min({_DOC_LOCATION}, ord) AS location, arg_min(CAST(doc_id AS varchar), ord) AS session_id,
               {redact_sql('value')} AS value_redacted, count(*) AS occurrences
        FROM (SELECT *, row_number() OVER (ORDER BY source, CAST(doc_id AS varchar) || '.txt', chunk_index, i) AS ord
              FROM ({_CARD_HITS}) WHERE why IS NULL)
        GROUP BY source, value""",
    "detect_suppressions": f"""
        SELECT why AS suppressed_by, count(*) AS n
        FROM (SELECT why FROM ({_CARD_HITS}) UNION ALL SELECT why FROM ({_EMAIL_HITS}))
        WHERE why IS NOT NULL GROUP BY why""",
    "each_suppressor": " UNION ALL ".join(
        f"SELECT '{name}' AS planted, '{name}' AS suppressed_by, count(*) AS people FROM customer" for name in NOISE_TEXTS),
    **{f"rules_{pack}": _rules_sql(pack) for pack in TEMPLATES},
    "gate_kinds": f"""
        SELECT location, 'user_message' AS kind, s AS start, value
        FROM ({matches_sql(_TURNS, 'location', KINDS_RULE['pattern'])})""",
    "gate_context": f"""
        SELECT {_DOC_LOCATION} AS location, s AS start, value
        FROM ({matches_sql(_CHUNKS, _KEYS, CONTEXT_RULE['pattern'])})
        WHERE contains(lower({window_sql(25)}), 'the') OR contains(lower({window_sql(25)}), 'la ')""",
    "gate_entropy": f"""
        SELECT key, s AS start, value FROM (
          SELECT key, i, s, value, c, CAST(count(*) AS double) / 8 AS p
          FROM (SELECT key, i, s, value, unnest(string_split(value, '')) AS c
                FROM ({matches_sql("SELECT o_orderkey AS key, md5(CAST(o_orderkey AS varchar)) AS text FROM orders", 'key', ENTROPY_RULE['pattern'])}))
          GROUP BY key, i, s, value, c)
        GROUP BY key, i, s, value HAVING -sum(p * log2(p)) >= 2.6""",
    "value_group": f"""
        SELECT key, s + 1 AS start, e - 1 AS "end", substring(value, 2, length(value) - 2) AS value
        FROM ({matches_sql("SELECT o_orderkey AS key, md5(CAST(o_orderkey AS varchar)) AS text FROM orders", 'key', '[a-f][0-9]+[a-f]')})""",
    "gate_order": f"""
        SELECT {_DOC_LOCATION} AS location,
               CASE WHEN regexp_matches(value, '^th') OR regexp_matches(value, 'ing$') THEN 'custom.seven.v1:ignore'
                    WHEN contains({window_sql(200)}, 'token') THEN 'custom.window'
                    WHEN regexp_matches(value, 'er$') THEN 'custom.value' ELSE '(kept)' END AS outcome,
               count(*) AS n
        FROM ({matches_sql(_CHUNKS, _KEYS, ORDER_RULE['pattern'])}) GROUP BY ALL""",
    "customer_terms": """
        SELECT p_brand AS employee, 'f#' || CAST(p_partkey AS varchar) || '.0' AS location, 9 AS start,
               lower(p_type) AS value FROM part""",
    "many_terms": """
        WITH l AS (SELECT CAST(l_orderkey AS varchar) || '#' || CAST(l_linenumber AS varchar) || '.0' AS location,
                          CAST(l_partkey AS varchar) AS part, CAST(l_suppkey AS varchar) AS sup, l_partkey, l_suppkey FROM lineitem)
        SELECT location, 5 AS start, 'lot ' || part AS value FROM l WHERE l_partkey IN (SELECT p_partkey FROM part)
        UNION ALL SELECT location, 5 + 2 * (4 + length(part)) + length(' with LOT-, x or ') + length(sup), 'lot ' || sup
        FROM l WHERE l_suppkey IN (SELECT p_partkey FROM part)""",
    "masked_snippets": f"""
        WITH t AS (SELECT 'f#' || CAST(c_custkey AS varchar) || '.0' AS location, md5(c_name) AS tag, {_N4} AS n FROM customer)
        SELECT location, 'custom.a.v1' AS rule_id, 36 AS start,
               tag || ' NE******' || right(n, 1) || 'X z' || left(tag, 20) || ' ***…' AS snippet FROM t
        UNION ALL SELECT location, 'custom.b.v1', 42,
               tag || ' NE******' || right(n, 1) || 'X z' || left(tag, 20) || ' ***…' FROM t
        UNION ALL SELECT location, 'custom.c.v1', 70,
               '…' || right(tag, 12) || ' NE******' || right(n, 1) || 'X z' || left(tag, 20) || ' far' || left(n, 1) || '******' || right(tag, 2) FROM t""",
    "sanitise_snippets": """
        SELECT 'f#' || CAST(o.o_orderkey AS varchar) || '.0' AS location,
               '…near ' || CASE WHEN n.o_orderkey IS NULL THEN 'val-' || md5(CAST(o.o_orderkey + 1 AS varchar))
                           ELSE 'val-******' || right(md5(CAST(o.o_orderkey + 1 AS varchar)), 2) END
               || ' and val-0 here…' AS snippet
        FROM orders o LEFT JOIN orders n ON n.o_orderkey = o.o_orderkey + 1""",
    "bulk_personal": f"""
        SELECT 'p' || CAST(key AS varchar) AS employee, 'critical' AS severity,
               CAST({_BULK_COUNT} AS varchar) || ' kinds of personal data in one record' AS value,
               'Bulk personal data: ' || CAST({_BULK_COUNT} AS varchar) || ' distinct kinds ('
               || array_to_string(list_sort([{', '.join(quoted(s) for s in _SUBTYPES)}][1:{_BULK_COUNT}]), ', ')
               || ') in a single tool result.' AS snippet
        FROM (SELECT c_custkey AS key FROM customer) WHERE {_BULK_COUNT} >= 6""",
}
