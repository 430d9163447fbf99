"""Tell secrets from look-alikes with a random forest.

Candidates are long runs of token characters anywhere in a text, and values of any
length and characters that are assigned to the name of a credential, follow one, or
are the password of a URL.  Each is described by its length, its characters and how likely they follow one another, how much of it
dictionary words cover, whether it is part of a path, and the words around it.  The
forest is trained from labelled findings.  Everything is DataFrame operations.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let, redact
from ..plans.staging import stage
from .mixing import uniform

RUN = r"[A-Za-z0-9+/_~.-]"
LEAST = 20
LETTERS = "abcdefghijklmnopqrstuvwxyz0"
NAME = (r"(?:token|secret|passw|passphrase|passcode|pwd|api[_-]?key|credential|auth(?!or(?!i[sz]))|bearer|private[_-]?key"
        r"|access[_-]?key|[_-]key|signature)")
CREDENTIAL = f"(?i){NAME}"
SIGN = "(?:=>|:=|[=:])"
QUOTE = "[\"'`]"
#: The name of a credential at the end of a word, with a sign of assignment or without.
LEAD = rf"(?i){NAME}[\w-]{{0,64}}[\\\"'`\])]{{0,4}}{SIGN}?$"
#: A value without quotes ends before the next assignment in its word.
BARE = rf"(?:[^\s\"'`,;&]|[,;&](?!{QUOTE}?[A-Za-z_][\w.-]{{0,64}}{QUOTE}?[=:])|{QUOTE}(?=[A-Za-z0-9]))++"
HEAD = rf"(?i){NAME}[\w-]{{0,64}}[\\\"'`\])]{{0,4}}{SIGN}"
ASSIGNED = rf"""{HEAD}(?:\\?"[^"]+"?|\\?'[^']+'?|`[^`]+`?|{BARE})"""
USERINFO = r"""://[^\s/:@?#"'<>]*:([^\s/"'<>]+)@"""
#: A quoted value may go on for so many words; where its quote does not end there, it is one word.
QUOTED_WORDS = 32
DIGEST = r"(?i)(commit|sha-?\d|md5|checksum|digest|hash|etag|revision|uuid|build|blob|tree)"
#: Beginnings that issuers publish for their keys.
ISSUER = r"^(AKIA|ASIA|gh[pousr]_|glpat-|xox[abp]-|[sr]k_live_|AIza|npm_|hf_|SG\.|eyJ)"
#: Values that stand for another one: variables, calls, types, switches, numbers and masks.
REFERENCE = (r"(?i)^(\W+|[$%<{\[].*|.*\(.*|x+|(self|this|os|process|config|settings|env|args|request)\..*|\d{1,6}"
             r"|true|false|null|none|nil|undefined|string|str|int|number|bool|boolean|text|required|optional|yes|no|user|pass(word)?|secret|token)$")
SAMPLE = r"(?i)(example|your[_-]|changeme|placeholder|dummy|sample|redacted|x{6,}|0{8,}|1234567)"
FEATURES = (
    "length", "distinct", "digits", "upper", "symbols", "changes", "transition", "coverage", "hex", "slashes", "dots",
    "dashes", "path", "issuer", "credential", "digest", "assigned", "quoted", "sample", "letters_before", "letters_after",
    "reference", "userinfo",
)


@dataclass
class Language:
    """What ordinary words look like: log-probabilities of letter pairs, and frequent words."""

    pairs: list[float]
    words: list[str]


@dataclass
class Forest:
    language: Language
    model: RandomForestClassificationModel


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, word_no, run_no, value, word, before2, before1, after``: every run of token characters of at least
    20 characters in the whole text, then, in the same word, every other value that is assigned to or follows the
    name of a credential or is a URL's password; of these, ``word`` is the assignment alone.  A quoted value may
    hold blanks (each stretch counts as one).  A null or empty text has none; repeated rows repeat theirs."""
    def marked(words: Column, named: Column) -> Column:
        def about(w: Column, i: Column) -> Column:
            before2, before1 = F.get(words, i - 2), F.get(words, i - 1)
            follows = F.coalesce(
                (F.get(named, i - 1) & before1.rlike(LEAD))
                | (F.get(named, i - 2) & before1.rlike(rf"(?i)^({SIGN}|is|basic)$") & before2.rlike(LEAD)), F.lit(False))
            return F.struct(i.alias("i"), w.alias("w"), follows.alias("follows"))

        found = F.filter(F.transform(words, about), lambda s: (
            (F.length(s["w"]) >= LEAST) | s["follows"] | F.get(named, s["i"]) | s["w"].contains("://")))
        return F.transform(found, lambda s: F.struct(
            s["i"].alias("word_no"), s["w"].alias("word"), F.get(words, s["i"] - 2).alias("before2"),
            F.get(words, s["i"] - 1).alias("before1"), F.get(words, s["i"] + 1).alias("after"), s["follows"].alias("follows"),
            F.when((s["follows"] | F.get(named, s["i"])) & s["w"].rlike(QUOTE), F.slice(words, s["i"] + 2, QUOTED_WORDS)).alias("tail")))

    # neighbours are looked up inside the row: a row of the explosion carries no word list
    found = let(F.split(text, r"[\x20\x09-\x0D]+"), lambda words: let(
        F.transform(words, lambda w: w.rlike(CREDENTIAL)), lambda named: marked(words, named)))
    some = F.col(text).rlike(f"{RUN}{{{LEAST}}}") | F.col(text).rlike(CREDENTIAL) | F.col(text).rlike(USERINFO)
    near = docs.where(some).select("doc_id", F.explode(found).alias("s")).select("doc_id", "s.*")
    runs = F.regexp_extract_all("word", F.lit(f"({RUN}{{{LEAST},}}={{0,2}})"), F.lit(1))
    values = let(runs, lambda r: F.concat(
        F.transform(r, lambda v: F.struct(F.col("word").alias("word"), v.alias("value"))),
        F.array_distinct(F.filter(_named_values(), lambda x: (x["value"] != "") & ~F.exists(r, lambda v: (v == x["value"]) | (
            (F.length(x["value"]) >= LEAST) & v.contains(x["value"])))))))
    out = near.select("doc_id", "word_no", "before2", "before1", "after", F.posexplode(values).alias("run_no", "v"))
    return out.select("doc_id", "word_no", "run_no", "v.value", "v.word", "before2", "before1", "after")


def _named_values() -> Column:
    """``word, value`` of what is assigned inside ``word``, of the passwords of its URLs, and of itself where it follows a name."""
    word, tail = F.col("word"), F.coalesce("tail", F.array().cast("array<string>"))

    def value(whole: Column, raw: Column) -> Column:
        ends = [F.filter(F.transform(tail, lambda w, i: F.when(w.contains(q), i + 1)), lambda i: i.isNotNull()) for q in "\"'`"]
        open_ = [raw.rlike(rf"^\\?{q}[^{q}]*$") for q in "\"'`"]
        count = F.coalesce(*(F.when(o, F.get(e, F.lit(0))) for o, e in zip(open_, ends)), F.lit(0))

        def closed(n: Column) -> Column:
            more = F.when(n > 0, F.concat(F.lit(" "), F.array_join(F.slice(tail, 1, F.greatest(n, F.lit(1))), " "))).otherwise("")
            full = F.concat(raw, more)
            quoted = F.concat(*(F.regexp_extract(full, rf"^\\?{q}([^{q}]*)", 1) for q in "\"'`"))
            bare = F.regexp_replace(F.regexp_extract(full, rf"^[(\[]*({BARE})", 1), r"(?<=[^.,;:)\]}>])[.,;:)\]}>]+$", "")
            bare = F.when(full.rlike(r"^[<{$]"), F.regexp_extract(full, rf"^({BARE})", 1)).otherwise(bare)
            found = F.when(full.rlike(rf"^\\?{QUOTE}"), F.regexp_replace(quoted, r"\\$", "")).otherwise(bare)
            return F.struct(F.concat(whole, more).alias("word"), found.alias("value"))

        return let(count, closed)

    inside = F.transform(F.regexp_extract_all(word, F.lit(ASSIGNED), F.lit(0)), lambda m: value(m, F.regexp_replace(m, f"^{HEAD}", "")))
    urls = F.transform(F.regexp_extract_all(word, F.lit(USERINFO), F.lit(0)), lambda m: F.struct(
        m.alias("word"), F.regexp_extract(m, USERINFO, 1).alias("value")))
    none = F.array().cast("array<struct<word:string,value:string>>")
    after = F.when(F.col("follows") & ~word.rlike(ASSIGNED) & ~word.rlike("(?i)^(bearer|basic)$"),
                   F.array(value(word, F.regexp_replace(word, f"^{SIGN}+", "")))).otherwise(none)
    return F.concat(inside, urls, after)


def _share(value: Column, pattern: str) -> Column:
    return F.regexp_count(value, F.lit(pattern)) / F.length(value)


def _letter(c: Column) -> Column:
    """0 for a symbol, 1 to 26 for a letter, 27 for a digit."""
    return F.position(c, F.lit(LETTERS))


def _folded(value: Column) -> Column:
    return F.translate(F.lower(value), "123456789", "000000000")


def describe(found: DataFrame, language: Language) -> DataFrame:
    """*found* with a column for each of :data:`FEATURES`; absent neighbours count as empty words."""
    value, word = F.coalesce("value", F.lit("")), F.coalesce("word", F.lit(""))
    value = F.when(value == "", "-").otherwise(value)
    before = F.concat_ws(" ", "before2", "before1")
    # a short value may also be part of the name before it
    first = F.when(F.length(value) >= LEAST, F.position(value, word)).otherwise(
        F.length(word) - F.length(value) - F.position(F.reverse(value), F.reverse(word)) + 2)
    head = F.substr(word, F.lit(1), F.greatest(F.when(word.contains(value), first).otherwise(0) - 1, F.lit(0)))
    lead = F.concat(F.coalesce("before1", F.lit("")), head)
    table = F.array(*(F.lit(p) for p in language.pairs))

    def mean_of(ids: Column) -> Column:
        steps = F.transform(
            F.slice(ids, 2, F.greatest(F.size(ids) - 1, F.lit(0))),
            lambda b, i: F.element_at(table, (F.get(ids, i) * 28 + b + 1).cast("int")))
        return let(steps, lambda s: F.aggregate(s, F.lit(0.0), lambda a, b: a + b) / F.greatest(F.size(s), F.lit(1)))

    # bound once: looked up for every letter
    mean = let(F.transform(F.split(_folded(value), ""), _letter), mean_of)
    covered = F.lit(0.0)
    if language.words:
        pattern = "|".join(sorted(language.words, key=lambda w: (-len(w), w)))
        covered = 1 - F.length(F.regexp_replace(F.lower(value), pattern, "")) / F.length(value)
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "0")

    def flag(c: Column) -> Column:
        return F.coalesce(c.cast("double"), F.lit(0.0))

    columns = {
        "length": F.least(F.length(value), F.lit(400)), "distinct": F.size(F.array_distinct(F.split(value, ""))) / F.length(value),
        "digits": _share(value, "[0-9]"), "upper": _share(value, "[A-Z]"), "symbols": _share(value, "[^A-Za-z0-9]"),
        "changes": F.length(kinds) / F.length(value), "transition": mean, "coverage": covered,
        "hex": flag(value.rlike("^([0-9a-f]+|[0-9A-F]+)$")), "slashes": _share(value, "/"), "dots": _share(value, r"\."),
        "dashes": _share(value, "[-_]"), "path": flag(word.rlike(r"://|^\W*(\.{0,2}|~)/|\.[a-z]{2,4}\W*$")),
        "issuer": flag(value.rlike(ISSUER)),
        "credential": flag(F.concat_ws(" ", before, head).rlike(CREDENTIAL)),
        "digest": flag(F.concat_ws(" ", before, head).rlike(DIGEST)),
        "assigned": flag(lead.rlike(r"(=|:|=>)\W*$")), "quoted": flag(lead.rlike("[\"'`]$")),
        "sample": flag(F.concat_ws(" ", before, word).rlike(SAMPLE)),
        "reference": flag(value.rlike(REFERENCE)), "userinfo": flag(head.rlike("://[^/?#]*:$")),
        "letters_before": _share(F.concat(before, F.lit(" ")), "[a-z]"),
        "letters_after": _share(F.concat(F.coalesce("after", F.lit("")), F.lit(" ")), "[a-z]"),
    }
    return found.select("*", *(columns[c].cast("double").alias(f"f_{c}") for c in FEATURES))


def learn_language(docs: DataFrame, *, text: str = "text", words: int = 400) -> Language:
    """Letter pairs and the *words* most frequent words (four letters at least) of all documents.

    The driver receives at most 784 counts and *words* words.
    """
    word = docs.select(F.explode(F.split(F.lower(text), r"[^a-z]+")).alias("w")).where(F.length("w") > 1)
    counts = word.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    frequent = counts.where(F.length("w").between(4, 12)).orderBy(F.desc("n"), "w").limit(words).select("w").collect()
    pair = counts.select("n", F.explode(F.transform(
        F.sequence(F.lit(1), F.length("w") - 1), lambda i: F.substr("w", i, F.lit(2)))).alias("p"))
    seen = {r.p: r.n for r in pair.groupBy("p").agg(F.sum("n").alias("n")).collect()}
    table = []
    for a in "\0" + LETTERS:
        row = [seen.get(a + b, 0) + 1.0 for b in "\0" + LETTERS]
        table += [math.log(x / sum(row)) for x in row]
    return Language(table, [r.w for r in frequent])


def _drawn(docs: DataFrame, n: int) -> DataFrame:
    total = max(1, docs.count())
    return docs.where(uniform(F.col("doc_id"), "secrets") * total < n)


def planted_findings(docs: DataFrame, *, text: str = "text", rows: int = 4000) -> DataFrame:
    """About *rows* labelled findings of long values, and as many of short ones: known kinds between words of real documents.

    Secrets stand after names of credentials; look-alikes are digests, identifiers, paths, addresses,
    placeholders, rules, numbers and words run together.  Columns as of :func:`candidates`, and ``label``.
    """
    few = _drawn(docs.where(F.length(text) > 40), rows).select(
        "doc_id", F.slice(F.split(text, r"[\x20\x09-\x0D]+"), 1, 64).alias("w"))
    # rows that repeat an id would make the sample unbounded
    first = F.row_number().over(Window.partitionBy(F.pmod(F.xxhash64("doc_id"), F.lit(64))).orderBy("doc_id"))
    few = few.withColumn("n", first).where(F.col("n") <= rows // 32)
    number = F.pmod(F.xxhash64("doc_id", F.lit("kind")), F.lit(24))
    seed = F.concat(F.col("doc_id").cast("string"), F.lit("/s"))
    hexed = F.sha2(seed, 256)
    mixed = F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat(seed, F.lit("b")), 512))), "[+/=\n\r]", "")
    size = (24 + F.pmod(F.xxhash64("doc_id", F.lit("size")), F.lit(20))).cast("int")

    def w(i: int) -> Column:
        return F.regexp_replace(F.coalesce(F.get("w", F.lit(i)), F.lit("word")), "[^A-Za-z]", "")

    def case(label: int, before1: Column, head: str, value: Column, tail: str = "", before2: Column | None = None) -> Column:
        return F.struct(
            F.coalesce(before2 if before2 is not None else w(0), F.lit("")).alias("before2"), before1.alias("before1"),
            F.concat(F.lit(head), value, F.lit(tail)).alias("word"), value.alias("value"), F.lit(float(label)).alias("label"))

    lit = F.lit
    kinds = [
        case(1, lit("="), '"', F.sha1(seed), '"', lit("token")), case(1, lit("="), "'", F.substring(hexed, 1, 32), "'", lit("secret")),
        case(1, lit("api_key:"), "", F.substr(mixed, lit(1), size)), case(1, lit("Bearer"), "", F.substr(mixed, lit(3), size), "", lit("Authorization:")),
        case(1, w(1), "PASSWORD=", F.substr(mixed, lit(5), size)), case(1, lit("access_key"), "=", F.upper(F.substr(mixed, lit(2), size))),
        case(1, w(1), 'secret_key="', hexed, '"'), case(1, lit(":"), '"', F.concat(lit("ghp_"), F.substring(mixed, 1, 36)), '"', lit("token")),
        case(1, w(1), "", F.concat(lit("AKIA"), F.upper(F.substring(mixed, 1, 16)))),
        case(1, w(1), "key=", F.concat(lit("AKIA"), F.upper(F.substring(mixed, 9, 16)))),
        case(1, w(1), "", F.concat(F.element_at(F.array(lit("ghp_"), lit("glpat-"), lit("sk_live_"), lit("npm_")), (
            F.pmod("doc_id", lit(4)) + 1).cast("int")), F.substring(mixed, 4, 30)), "."),
        case(0, w(1), "", F.concat(lit("AKIA"), F.upper(F.substring(mixed, 1, 9)), lit("EXAMPLE"))),
        case(0, lit("commit"), "", F.sha1(seed)), case(0, lit("sha256:"), "", hexed), case(0, w(1), "id=", F.concat(
            F.substring(hexed, 1, 8), lit("-"), F.substring(hexed, 9, 4), lit("-"), F.substring(hexed, 13, 4), lit("-"), F.substring(hexed, 17, 16))),
        case(0, w(1), "", F.rpad(F.concat(w(2), w(3), w(4), w(5)), 26, "tionmenterheit")),
        case(0, w(1), "https:", F.concat(lit("//www."), w(2), lit(".com/"), w(3), lit("/page/"), w(4))),
        case(0, w(1), "", F.concat(lit("/usr/share/data/"), w(2), lit("/"), w(3), lit(".txt"))),
        case(0, lit("="), '"', F.concat(lit("your-api-key-here-"), w(2)), '"', lit("api_key")),
        case(0, lit("token"), "=", F.repeat(lit("x"), 32)), case(0, w(1), "", F.repeat(F.element_at(
            F.array(lit("-"), lit("_"), lit("."), lit("-.")), (F.pmod("doc_id", lit(4)) + 1).cast("int")), size)),
        case(0, w(1), "", F.rpad(F.concat(w(2), lit("-"), w(3), lit("_"), w(4)), 24, "-page")),
        case(0, lit("="), "", F.rpad(F.concat(lit("EXAMPLE"), F.upper(w(2))), 24, "KEYEXAMPLE"), "", lit("secret")),
        case(0, w(1), "", F.rpad(F.regexp_replace(hexed, "[a-f]", ""), 24, "0123456789")),
    ]
    chosen = F.element_at(F.array(*kinds), (number + 1).cast("int"))
    long = few.select("doc_id", chosen.alias("k"), F.get("w", F.lit(6)).alias("after")).select("doc_id", "k.*", "after").where(
        F.length("value") >= LEAST)

    def pick(*options: str, by: str = "pick") -> Column:
        at = F.pmod(F.xxhash64("doc_id", lit(by)), lit(len(options))) + 1
        return F.element_at(F.array(*map(lit, options)), at.cast("int"))

    short = (4 + F.pmod(F.xxhash64("doc_id", lit("short")), lit(13))).cast("int")
    name = pick("password", "token", "secret", "api_key", "DB_PASSWORD", "passwd", "pwd", "auth_token", "client_secret", "ACCESS_KEY")
    sign = pick("!", "&", "#", "$", "%", "@", "*", "?", "^", "+", by="sign")
    plain = F.substr(mixed, lit(1), short)
    odd = F.concat(F.substring(mixed, 7, 4), sign, F.substr(mixed, lit(12), short))
    number = F.substr(F.regexp_replace(hexed, "[a-f]", ""), lit(1), lit(2) + F.pmod("doc_id", lit(3)).cast("int"))
    spoken = F.concat(F.initcap(F.translate(F.lower(F.concat(w(2), F.substring(w(3), 1, 3))), "oea", "034")), sign, number)
    pin = F.concat(F.lower(w(2)), number)
    several = F.concat_ws(" ", F.lower(w(2)), F.lower(w(3)), F.lower(w(4)), number)
    proper = F.when(F.pmod("doc_id", lit(3)) == 0, odd).when(F.pmod("doc_id", lit(3)) == 1, plain).otherwise(
        F.substr(hexed, lit(1), short + 2))
    stands = pick(
        "${PASSWORD}", "$TOKEN", "<password>", "{token}", "%s", "********", "xxxx", "changeme", "process.env.TOKEN", "getToken()",
        "self.token", "config.password", "true", "false", "null", "None", "string", "str", "int", "required", "optional", "your-token",
        "0", "1", "16", "512", "4096", "password", "os.environ", "undefined", "<your-key>", "example", "|", "-", "(", by="stands")
    url = pick("://app:", "://root:", "://user:", "://:", "://svc:", by="url")

    def inside(label: int, value: Column, before: str = "=", after: str = "") -> Column:
        return F.struct(
            w(0).alias("before2"), w(1).alias("before1"), F.concat(name, lit(before), value, lit(after)).alias("word"),
            value.alias("value"), lit(float(label)).alias("label"))

    def sole(label: int, value: Column, before2: Column, before1: Column, head: str = "", tail: str = "") -> Column:
        return case(label, before1, head, value, tail, before2)

    def in_url(label: int, value: Column) -> Column:
        return F.struct(w(0).alias("before2"), w(1).alias("before1"), F.concat(url, value, lit("@")).alias(
            "word"), value.alias("value"), lit(float(label)).alias("label"))

    brief = [
        inside(1, odd), inside(1, plain), inside(1, F.substring(hexed, 1, 12)), inside(1, spoken, '="', '"'), inside(1, pin),
        inside(1, proper, '":"', '"'), sole(1, proper, name, lit("="), '"', '"'), sole(1, spoken, w(0), F.concat(name, lit(":"))),
        sole(1, plain, lit("Authorization:"), lit("Bearer")), sole(1, odd, w(0), F.concat(lit("--"), name)),
        sole(1, several, name, lit("="), '"', '"'), in_url(1, proper), in_url(1, spoken), sole(1, proper, name, lit("is")),
        inside(0, stands), inside(0, stands, ":"), sole(0, stands, name, lit("=")), sole(0, stands, w(0), F.concat(name, lit(":"))),
        sole(0, stands, w(0), name), sole(0, F.lower(w(2)), w(0), name), sole(0, w(2), w(0), pick("token", "tokens", "secret", "signature", "authentication")),
        sole(0, F.lower(w(2)), w(0), F.concat(name, lit(":"))), sole(0, F.lower(w(2)), name, lit("is")),
        sole(0, F.lower(w(2)), w(0), pick("bearer", "secretary", "secrets", "credentials", "authority", "password")), in_url(0, stands),
        inside(0, F.concat(lit("get_"), F.lower(w(2)), lit("()"))), inside(0, F.concat(F.lower(w(2)), lit("."), F.lower(w(3)))),
        inside(0, number, ":"),
    ]
    kind = F.pmod(F.xxhash64("doc_id", lit("brief")), lit(len(brief)))
    more = few.select("doc_id", F.element_at(F.array(*brief), (kind + 1).cast("int")).alias("k"), F.get("w", F.lit(6)).alias("after"))
    return long.unionByName(more.select("doc_id", "k.*", "after").where("value <> ''"))


def train(labelled: DataFrame, language: Language, *, trees: int = 30, depth: int = 8, seed: int = 5) -> Forest:
    """A forest from ``labelled(value, word, before2, before1, after, label)``, label 1.0 for secrets."""
    # a few thousand rows, from all over the documents: written first, so that each plan stays small
    few = stage(labelled.select("value", "word", "before2", "before1", "after", "label").repartition(8), "labelled")
    rows = VectorAssembler(inputCols=[f"f_{c}" for c in FEATURES], outputCol="features").transform(
        describe(few, language)).select("features", "label")
    rows = stage(rows, "findings")  # the forest reads its rows several times
    learner = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, subsamplingRate=0.8)
    return Forest(language, learner.fit(rows))


def classify(found: DataFrame, forest: Forest) -> DataFrame:
    """*found* with ``probability`` of being a secret (rounded to 6 places)."""
    described = describe(found, forest.language)
    rows = VectorAssembler(inputCols=[f"f_{c}" for c in FEATURES], outputCol="features").transform(described)
    scored = forest.model.setProbabilityCol("p").transform(rows)
    return scored.select(*found.columns, F.round(vector_to_array("p")[1], 6).alias("probability"))


def secrets(docs: DataFrame, forest: Forest, *, threshold: float = 0.5) -> DataFrame:
    """``doc_id, word_no, run_no, value_sha256, masked, length, probability, is_secret`` for every candidate.

    Values themselves are not returned.  Rows that repeat a document repeat its candidates; a null id is kept;
    a null or empty text has no candidates; other columns are ignored.
    """
    found = classify(candidates(docs.select("doc_id", "text")), forest)
    return found.select(
        "doc_id", "word_no", "run_no", F.sha2("value", 256).alias("value_sha256"), redact(F.col("value")).alias("masked"),
        F.length("value").alias("length"), "probability", (F.col("probability") >= threshold).alias("is_secret"))
