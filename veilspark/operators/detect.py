"""Records in, hits out: one narrow stage, no shuffle.

Everything about a record is computed in that record's row.  Rules become
literal expressions, matches become an array, gates are evaluated per match,
snippets mask every surviving match of the record, and only then is the row
exploded and ``text`` dropped.  ``text`` is never shuffled.
"""

from __future__ import annotations

import json
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.regex import found, group_layout, java_pattern
from ..functions.spans import cut, marked_positions, masked_spans, merge_spans, pieces, snippet, window
from ..functions.text import entropy, fold, let, not_blank, spaced, sql_text, sql_texts
from ..rules.model import DIGIT_RUN, HEAD, TAIL, TOKEN_RUN, Rule, RuleSet, Suppressor, load_rules
from ..rules.validators import VALIDATORS
from ..schema import ref
from .structure import signals

# Fixed values.
SUPPRESSOR_WINDOW = 200
BULK_SUBTYPES = 6
BULK_CATEGORIES = ("pii", "special-category")
BULK = ("pii.bulk_personal_records.v1", "pii", "bulk_personal_records", "critical", 90)

# Characters no text should hold: the mark set around matches, and what takes its
# place should a text hold it after all.
MARK, MARK_STAND_IN = "\uffff", "\ufffe"

#: A gate that fails without being counted.
DROPPED = ""

HIT_COLUMNS = (
    "rule_id", "category", "subtype", "severity", "confidence", "employee", "session_id",
    "source", "kind", "location", "start", "end", "value", "snippet", "descriptive",
    "suppressed_by", "seq",
)

_FOUND = (
    "struct<rule_id:string,category:string,subtype:string,severity:string,confidence:int,"
    "start:int,end:int,value:string,snippet:string,descriptive:boolean,suppressed_by:string>"
)


def _any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


_PROBES = "array<struct<rule_ix:int,parts:array<string>>>"


def _numbers(cases: list[tuple[Column, list[int]]]) -> Column:
    """The numbers of every case that holds.  Unlike a filter over an array, this is compiled."""
    none = F.array().cast("array<int>")
    return F.concat(*[F.when(condition, F.array(*map(F.lit, numbers))).otherwise(none) for condition, numbers in cases], none)


def _probe(rule_ix: int, rule: Rule) -> str:
    """SQL for the matches of one rule in ``text``: an array of one, or of none.

    The cheap necessary conditions come first: kind, literals the pattern needs,
    words its context gate needs.  The regex only runs where they hold; nested
    CASE keeps that order where the operands of AND may be swapped.
    """
    where, pattern = group_layout(rule.pattern, rule.group)
    before = "$1" if where == "middle" else ""
    value = "" if rule.group == 0 else f"${rule.group + (1 if where == 'middle' else 0)}"
    marked = MARK + "$0" + MARK + before + MARK + value + MARK
    cheap = []
    if rule.kinds:
        cheap.append(f"kind IN ({sql_texts(rule.kinds)})")
    if rule.digits:
        cheap.append("digit_run" if rule.digits >= DIGIT_RUN else "has_digit")
    if rule.run >= TOKEN_RUN:
        cheap.append("token_run")
    if _signs_of(rule):
        cheap.append(f"array_contains(signed, {rule_ix})")
    if rule.requires_context and all(t.isascii() for t in rule.requires_context):
        cheap.append(
            " OR ".join(f"contains(folded, {sql_text(t.lower())})" for t in rule.requires_context)
        )
    # One pass: every match is set between marks, and the text split at the marks.
    replaced = f"regexp_replace(marked, {sql_text(java_pattern(pattern))}, {sql_text(marked)})"
    out = (
        f"transform(filter(array({replaced}), r -> octet_length(r) > octet_length(marked)), "
        f"r -> named_struct('rule_ix', {rule_ix}, 'parts', split(r, {sql_text(MARK)}, -1)))"
    )
    for condition in reversed(cheap):
        out = f"CASE WHEN {condition} THEN {out} ELSE CAST(array() AS {_PROBES}) END"
    return out


def _signs_of(rule: Rule) -> list[str]:
    """The signs of which a match of *rule* has at least one."""
    return [
        *rule.needs, *(f"={w}" for w in rule.words), *(f"<{h}" for h in rule.heads),
        *(f">{t}" for t in rule.tails),
    ]


@lru_cache(maxsize=64)
def _sign_columns(rules: tuple[Rule, ...]) -> tuple[Column, ...]:
    """What the cheap conditions look at, from ``text`` and ``folded``.

    ``signed`` lists the rules of which a needed literal, word, beginning or end
    occurs.  One pass over the words replaces a search for each.
    """
    def wanted(t: Column, field: str) -> Column:
        # a set made once; array_intersect would make one for each record
        return F.array_distinct(F.filter(t, lambda x: x.isin(sorted({v for r in rules for v in getattr(r, field)}))))

    folded, text = F.col("folded"), F.col("text")
    tokens = F.array_distinct(F.split(folded, r"(?U)\W+", -1))

    def marked(mark: str, found_texts: Column) -> Column:
        return F.transform(found_texts, lambda t: F.concat(F.lit(mark), t))

    of_literal: dict[str, list[int]] = {}
    of_word: dict[str, list[int]] = {}
    for i, r in enumerate(rules):
        for nth, sign in enumerate(_signs_of(r)):
            (of_literal if nth < len(r.needs) else of_word).setdefault(sign, []).append(i)
    signed = _numbers([(F.contains(folded, F.lit(n)), of_literal[n]) for n in sorted(of_literal)])
    by_word = []
    if any(r.words for r in rules):
        by_word.append(lambda t: marked("=", wanted(t, "words")))
    if any(r.heads for r in rules):
        by_word.append(lambda t: marked("<", wanted(F.transform(t, lambda x: F.substring(x, 1, HEAD)), "heads")))
    if any(r.tails for r in rules):
        by_word.append(lambda t: marked(">", wanted(F.transform(t, lambda x: F.substring(x, -TAIL, TAIL)), "tails")))
    if by_word:
        # searched entry by entry, so it holds no literals
        known = F.from_json(F.lit(json.dumps(of_word)), "map<string,array<int>>")
        signs = let(tokens, lambda t: F.concat(*[make(t) for make in by_word]))
        signed = F.concat(signed, F.flatten(F.transform(signs, lambda s: known[s])))
    run = r"\d(?:[\s-]?\d){%d}" % (DIGIT_RUN - 1)
    has_digit = found(text, r"\d")
    return (
        F.replace(text, F.lit(MARK), F.lit(MARK_STAND_IN)).alias("marked"), signed.alias("signed"),
        has_digit.alias("has_digit"),
        F.when(has_digit, found(text, run)).otherwise(False).alias("digit_run"),
        text.rlike("(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d}" % TOKEN_RUN).alias("token_run"),
    )


def _with_signs(records: DataFrame, rules: list[Rule]) -> DataFrame:
    """*records* with their signs and the matches of each rule, worked out once per record."""
    signed = records.withColumn("folded", fold(F.col("text"))).select("*", *_sign_columns(tuple(rules)))
    return signed.withColumn("probes", F.expr("concat(%s)" % ", ".join(_probe(i, r) for i, r in enumerate(rules))))


_CONSTANTS = (
    "array<struct<id:string,category:string,subtype:string,severity:string,confidence:int,"
    "place:string,window:int,terms:array<string>,floor:double>>"
)


def _constants(rules: list[Rule]) -> Column:
    """What the expressions need to know about each rule, as one folded literal."""
    rows = [
        {
            "id": r.id, "category": r.category, "subtype": r.subtype, "severity": r.severity,
            "confidence": r.confidence, "place": group_layout(r.pattern, r.group)[0],
            "window": r.context_window, "terms": [t.lower() for t in r.requires_context],
            "floor": r.min_entropy,
        }
        for r in rules
    ]
    return F.from_json(F.lit(json.dumps(rows)), _CONSTANTS)


def _placed(probe: Column, constants: Column) -> Column:
    """Matches of one rule with their offsets; blank values are dropped."""
    where, parts = constants[probe["rule_ix"]]["place"], probe["parts"]

    def place(span: Column, i: Column) -> Column:
        whole, before, group = (parts[i * 4 + k] for k in (1, 2, 3))
        value = F.when(where == "whole", whole).otherwise(group)
        start = (
            F.when(where == "tail", span["e"] - F.length(value))
            .when(where == "middle", span["s"] + F.length(before))
            .otherwise(span["s"])
        )
        return F.struct(
            probe["rule_ix"].alias("rule_ix"),
            span["s"].alias("match_start"),
            span["e"].alias("match_end"),
            start.alias("start"),
            (start + F.length(value)).alias("end"),
            value.alias("value"),
        )

    spans = marked_positions(parts)
    found_here = F.filter(F.transform(spans, place), lambda h: not_blank(h["value"]))
    # A text that held the mark itself was searched with a stand-in for it.
    return F.when(F.col("text") == F.col("marked"), found_here).otherwise(
        F.transform(found_here, lambda h: h.withField("value", cut(F.col("text"), h["start"], h["end"])))
    )


def _lacks_context(parts: Column, hit: Column, rule: Column) -> Column:
    near = F.lower(window(parts, hit["match_start"], hit["match_end"], rule["window"]))
    return (F.size(rule["terms"]) > 0) & let(
        near, lambda n: ~F.exists(rule["terms"], lambda t: F.contains(n, t))
    )


def _active(suppressors: list[Suppressor], folded: Column) -> Column:
    """Numbers of the suppressors that could match anything in a text."""
    return _numbers([
        (_any_of([F.contains(folded, F.lit(n)) for n in s.needs]) if s.needs else F.lit(True), [i])
        for i, s in enumerate(suppressors)])


def _gate(ruleset: RuleSet, parts: Column, hit: Column, constants: Column, active: Column) -> Column:
    """Why a match does not count: a suppression id, DROPPED, or NULL.

    The order is ignore, validator, entropy, context, suppressors; it decides
    what is counted, so it is one CASE rather than filters.
    """
    rules = ruleset.rules
    ix, value = hit["rule_ix"], hit["value"]
    branches: list[tuple[Column, Column]] = []

    for i, rule in enumerate(rules):
        if rule.ignore:
            ignored = _any_of([found(value, p) for p in rule.ignore])
            branches.append(((ix == i) & ignored, F.lit(f"{rule.id}:ignore")))

    for name, check in VALIDATORS.items():
        named = [i for i, r in enumerate(rules) if r.validate == name]
        if check and named:
            branches.append((ix.isin(*named) & ~check(value), F.lit(DROPPED)))

    rule = constants[ix]
    if any(r.min_entropy for r in rules):
        branches.append(((rule["floor"] > 0) & (entropy(value) < rule["floor"]), F.lit(DROPPED)))
    if any(r.requires_context for r in rules):
        branches.append((_lacks_context(parts, hit, rule), F.lit(DROPPED)))

    near = window(parts, hit["match_start"], hit["match_end"], F.lit(SUPPRESSOR_WINDOW))
    for i, s in enumerate(ruleset.suppressors):
        matched = found(value if s.scope == "value" else near, s.pattern)
        if s.categories:
            matched = rule["category"].isin(*s.categories) & matched
        branches.append((F.when(F.array_contains(active, i), matched).otherwise(False), F.lit(s.id)))

    out = F.lit(None).cast("string")
    for condition, reason in reversed(branches):
        out = F.when(condition, reason).otherwise(out)
    return out


def _give_way(kept: Column, yielding: list[int]) -> Column:
    """Drop hits of yielding rules that overlap a hit of any other rule."""

    def decide(hits: Column) -> Column:
        solid = F.filter(hits, lambda h: ~h["rule_ix"].isin(*yielding))
        return let(
            solid,
            lambda s: F.filter(
                hits,
                lambda h: ~h["rule_ix"].isin(*yielding)
                | ~F.exists(s, lambda o: (o["start"] < h["end"]) & (o["end"] > h["start"])),
            ),
        )

    return let(kept, decide)


def _bulk(found_hits: Column, text: Column, kind: Column) -> Column:
    """A record that holds many kinds of personal data is a finding itself."""
    rule_id, category, subtype, severity, confidence = BULK
    subtypes = F.array_sort(
        F.array_distinct(
            F.transform(
                F.filter(found_hits, lambda f: f["category"].isin(*BULK_CATEGORIES)),
                lambda f: f["subtype"],
            )
        )
    )

    none = F.array().cast(f"array<{_FOUND}>")

    def finding(kinds_found: Column) -> Column:
        n = F.size(kinds_found).cast("string")
        return F.when(
            F.size(kinds_found) >= BULK_SUBTYPES,
            F.array(
                F.struct(
                    F.lit(rule_id).alias("rule_id"),
                    F.lit(category).alias("category"),
                    F.lit(subtype).alias("subtype"),
                    F.lit(severity).alias("severity"),
                    F.lit(confidence).alias("confidence"),
                    F.lit(0).alias("start"),
                    F.length(text).alias("end"),
                    F.concat(n, F.lit(" kinds of personal data in one record")).alias("value"),
                    F.concat(
                        F.lit("Bulk personal data: "), n, F.lit(" distinct kinds ("),
                        F.array_join(kinds_found, ", "), F.lit(") in a single "),
                        spaced(kind), F.lit("."),
                    ).alias("snippet"),
                    F.lit(True).alias("descriptive"),
                    F.lit(None).cast("string").alias("suppressed_by"),
                )
            ),
        ).otherwise(none)

    # fewer hits than kinds need no look at what they are
    return F.when(F.size(found_hits) >= BULK_SUBTYPES, let(subtypes, finding)).otherwise(none)


def _shapes(text: Column, kind: Column) -> Column:
    return F.transform(
        signals(text, kind),
        lambda s: F.struct(
            s["rule_id"].alias("rule_id"),
            s["category"].alias("category"),
            s["subtype"].alias("subtype"),
            s["severity"].alias("severity"),
            s["confidence"].alias("confidence"),
            F.lit(0).alias("start"),
            F.length(text).alias("end"),
            s["summary"].alias("value"),
            s["summary"].alias("snippet"),
            F.lit(True).alias("descriptive"),
            F.lit(None).cast("string").alias("suppressed_by"),
        ),
    )


def _rule_hits(ruleset: RuleSet, parts: Column, size: Column, gated: Column, constants: Column) -> Column:
    """Surviving rule hits with snippets, then the counted suppressions; *parts* are the text's pieces."""
    rules = ruleset.rules
    yielding = [i for i, r in enumerate(rules) if r.yields]

    def finding(hit: Column, reason: Column, shown: Column) -> Column:
        rule = constants[hit["rule_ix"]]
        return F.struct(
            rule["id"].alias("rule_id"),
            *[rule[c].alias(c) for c in ("category", "subtype", "severity", "confidence")],
            hit["start"].alias("start"),
            hit["end"].alias("end"),
            hit["value"].alias("value"),
            shown.alias("snippet"),
            F.lit(False).alias("descriptive"),
            reason.alias("suppressed_by"),
        )

    def with_snippets(kept: Column) -> Column:
        spans = merge_spans(
            F.transform(kept, lambda h: F.struct(h["start"].alias("s"), h["end"].alias("e")))
        )
        return let(
            let(spans, lambda merged: masked_spans(parts, merged, size)),
            lambda near: F.transform(
                kept,
                lambda h: finding(
                    h, F.lit(None).cast("string"), snippet(parts, near, size, h["start"], h["end"])
                ),
            ),
        )

    def split_up(all_hits: Column) -> Column:
        kept = F.transform(
            F.filter(all_hits, lambda g: g["reason"].isNull()), lambda g: g["hit"]
        )
        if yielding:
            kept = _give_way(kept, yielding)
        counted = F.filter(all_hits, lambda g: g["reason"] != DROPPED)
        return F.concat(
            let(kept, with_snippets),
            F.transform(counted, lambda g: finding(g["hit"], g["reason"], F.lit(""))),
        )

    return let(gated, split_up)


@lru_cache(maxsize=64)
def _found_hits(rules: tuple[Rule, ...], suppressors: tuple[Suppressor, ...], shapes: bool) -> Column:
    """The array of everything found in one row, as one expression.

    It only names columns, so one expression serves every table.
    """
    ruleset = RuleSet(list(rules), list(suppressors))
    text, kind = F.col("text"), F.col("kind")
    constants = _constants(ruleset.rules)
    placed = F.flatten(F.transform(F.col("probes"), lambda p: _placed(p, constants)))

    def judged(matches: Column) -> Column:
        # The text is taken apart once per record, and only where something matched.
        def gated(parts: Column) -> Column:
            return F.transform(
                matches,
                lambda h: F.struct(h.alias("hit"), _gate(ruleset, parts, h, constants, F.col("active")).alias("reason")),
            )

        return F.when(F.size(matches) > 0, let(F.length(text), lambda size: let(
            pieces(text, size),
            lambda parts: _rule_hits(ruleset, parts, size, gated(parts), constants),
        ).cast(f"array<{_FOUND}>"))).otherwise(F.array().cast(f"array<{_FOUND}>"))

    def everything(rule_hits: Column) -> Column:
        parts = [rule_hits]
        live = F.filter(rule_hits, lambda h: h["suppressed_by"].isNull())
        parts.append(_bulk(live, text, kind).cast(f"array<{_FOUND}>"))
        if shapes:
            parts.append(_shapes(text, kind).cast(f"array<{_FOUND}>"))
        return F.concat(*parts)

    return let(let(placed, judged), everything)


def hits(records: DataFrame, ruleset: RuleSet | None = None, *, shapes: bool = True) -> DataFrame:
    """Every hit in *records*, one row each; see :data:`HIT_COLUMNS`.

    Rows with ``suppressed_by`` set are matches a suppressor or an ignore
    pattern removed; they are kept so they can be counted.  ``value`` is raw.
    """
    ruleset = ruleset or load_rules()
    found_hits = _found_hits(tuple(ruleset.rules), tuple(ruleset.suppressors), shapes)
    # Outer, so that no emptiness filter is inferred: it would be pushed below
    # the projection and evaluate the whole expression a second time.
    probed = _with_signs(records, ruleset.rules)
    # Suppressors are looked into once per record, and only where something matched.
    active = F.when(F.size("probes") > 0, _active(ruleset.suppressors, F.col("folded"))).otherwise(F.array().cast("array<int>"))
    exploded = probed.withColumn("active", active).select(
        "employee", "session_id", "source", "kind", ref().alias("location"),
        "file_key", "record_index", "emit_seq",
        F.posexplode_outer(found_hits).alias("hit_ix", "hit"),
    ).where(F.col("hit_ix").isNotNull())
    return exploded.select(
        *[F.col(f"hit.{c}").alias(c) for c in ("rule_id", "category", "subtype", "severity", "confidence")],
        "employee", "session_id", "source", "kind", "location",
        *[F.col(f"hit.{c}").alias(c) for c in ("start", "end", "value", "snippet", "descriptive", "suppressed_by")],
        F.struct("file_key", "record_index", "emit_seq", "hit_ix").alias("seq"),
    )


def surviving(hit_rows: DataFrame) -> DataFrame:
    return hit_rows.where(F.col("suppressed_by").isNull()).drop("suppressed_by")


def suppressions(hit_rows: DataFrame) -> DataFrame:
    """``(suppressed_by, n)``: how many matches each reason removed."""
    return (
        hit_rows.where(F.col("suppressed_by").isNotNull())
        .groupBy("suppressed_by").agg(F.count("*").alias("n"))
    )
