"""Scan history, triage and purge over Parquet tables.

``scans(scan_id, started_at, finished_at, root, files, records, characters, rules,
suppressed)`` with the findings of each counted by severity, ``findings`` by scan,
``people`` with the counts of each person in each scan, and an append-only
``triage_log``.  Lists and trends read the counts; a purge corrects them and finds
the scans of a person by ``people``.  Raw values never reach a table.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.collapse import keep_last, severity_rank
from ..rules.model import SEVERITIES

# Fixed values.
STATES = ("open", "confirmed", "false_positive", "remediated")

SCANS = (
    "scan_id bigint, started_at string, finished_at string, root string, files bigint, "
    "records bigint, characters bigint, rules bigint, suppressed bigint"
)
FINDINGS = (
    "finding_id string, employee string, rule_id string, category string, subtype string, "
    "severity string, confidence int, session_id string, source string, location string, "
    "location_kind string, occurrences bigint, value_redacted string, snippet string, scan_id bigint"
)
TRIAGE_LOG = "finding_id string, state string, note string, updated_at timestamp, entry string"
COUNTS = ("total", *SEVERITIES)
COUNTED = ", ".join([SCANS, *[f"{c} bigint" for c in COUNTS]])
PEOPLE = ", ".join(["employee string", *[f"{c} bigint" for c in COUNTS], "scan_id bigint"])


def _names(schema: str) -> list[str]:
    return [c.split(" ")[0] for c in schema.split(", ")]


def severity_counts() -> list[Column]:
    """Aggregates: all findings, and those of each severity."""
    return [F.count("*").alias("total"), *[F.count(F.when(F.col("severity") == s, 1)).alias(s) for s in SEVERITIES]]


def stored_form(findings: DataFrame) -> DataFrame:
    """Findings as the store keeps them: no raw value, one row per id."""
    kept = keep_last(findings)
    return kept.withColumn("location_kind", F.col("kind")).select(*_names(FINDINGS)[:-1])


def latest_triage(log: DataFrame) -> DataFrame:
    """The last entry per finding; entries of one moment go by ``entry``."""
    last = F.max_by(F.struct("state", "note", "updated_at"), F.struct("updated_at", "entry"))
    return log.groupBy("finding_id").agg(last.alias("t")).select("finding_id", "t.state", "t.note", "t.updated_at")


def latest_scan(scans: DataFrame) -> DataFrame:
    """One row, or a NULL for an empty history."""
    return scans.agg(F.max("scan_id").alias("scan_id"))


def latest_findings(scans: DataFrame, findings: DataFrame) -> DataFrame:
    return findings.join(F.broadcast(latest_scan(scans)), "scan_id", "left_semi")


def with_state(findings: DataFrame, triage: DataFrame) -> DataFrame:
    """Findings with triage state; anything untouched is open."""
    return (
        findings.join(triage.select("finding_id", "state", "note"), "finding_id", "left")
        .withColumn("state", F.coalesce("state", F.lit("open")))
        .withColumn("note", F.coalesce("note", F.lit("")))
    )


def worst_order() -> list[Column]:
    return [
        severity_rank(F.col("severity")).asc(), F.col("confidence").desc(), F.col("employee").asc(),
        F.col("finding_id").asc(),
    ]


def worst_first(findings: DataFrame) -> DataFrame:
    return findings.orderBy(*worst_order())


def scans_with_counts(scans: DataFrame, findings: DataFrame) -> DataFrame:
    counts = findings.groupBy("scan_id").agg(F.count("*").alias("findings"))
    return scans.join(counts, "scan_id", "left").fillna(0, ["findings"]).orderBy("scan_id")


def trend(scans: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings per scan by severity; a scan without any keeps a zero."""
    counts = findings.groupBy("scan_id").agg(
        F.count("severity").alias("total"),
        *[F.count(F.when(F.col("severity") == s, 1)).alias(s) for s in SEVERITIES],
    )
    return (
        scans.select("scan_id", "finished_at").join(counts, "scan_id", "left")
        .fillna(0, ["total", *SEVERITIES]).orderBy("scan_id")
    )


def trend_shares(trend_rows: DataFrame) -> DataFrame:
    """Each scan's total as a percentage of the largest."""
    peak = trend_rows.agg(F.greatest(F.max("total"), F.lit(1)).alias("peak"))
    return trend_rows.crossJoin(F.broadcast(peak)).withColumn(
        "share", F.bround(F.col("total") / F.col("peak") * 100).cast("int")
    ).drop("peak")


def state_counts(findings_with_state: DataFrame) -> DataFrame:
    return findings_with_state.groupBy("state").agg(F.count("*").alias("n"))


def orphans(triage: DataFrame, findings: DataFrame) -> DataFrame:
    """Triage of findings that are stored nowhere any more."""
    return triage.join(findings.select("finding_id"), "finding_id", "left_anti")


@dataclass(frozen=True)
class Purged:
    scans: int = 0
    findings: int = 0
    triage: int = 0


class Conflict(RuntimeError):
    """Another writer changed the store first."""


@dataclass(frozen=True)
class Generation:
    """What the store holds at one moment: the folder of every part, below its table's folder.

    It has an entry for each scan and each piece of the triage log, so it grows with the
    number of scans and not with what they found.
    """

    number: int = 0
    next_scan: int = 1
    scans: str | None = None
    findings: dict[str, str] = field(default_factory=dict)
    people: dict[str, str] = field(default_factory=dict)
    triage_log: list[str] = field(default_factory=list)

    def folders(self) -> set[str]:
        return {
            *([f"scans/{self.scans}"] if self.scans else []), *[f"triage_log/{v}" for v in self.triage_log],
            *[f"findings/{v}/scan_id={s}" for s, v in self.findings.items()],
            *[f"people/{v}/scan_id={s}" for s, v in self.people.items()],
        }


class History:
    """The store below one folder.

    Every change writes new folders beside the old ones and takes effect by one small
    file in ``generations``, put in place by a rename that fails where the number is
    taken.  A writer that stops half way changes nothing; of two that start from one
    generation the second fails with :class:`Conflict`, except that triage entries are
    tried again.
    """

    #: Pieces of the triage log before they are merged.
    PIECES = 32

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")

    # -- generations ---------------------------------------------------------

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _conf(self):
        return self.spark._jsparkSession.sessionState().newHadoopConf()

    def _fs(self):
        return self._path("x").getFileSystem(self._conf())

    def _names(self, folder: str) -> list[str]:
        fs, path = self._fs(), self._path(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def _numbers(self) -> list[int]:
        return sorted(int(n) for n in self._names("generations") if n.isdigit())

    def generation(self) -> Generation:
        """The newest generation; an empty one for a store that does not exist yet."""
        numbers = self._numbers()
        if not numbers:
            return Generation()
        stream = self._fs().open(self._path(f"generations/{numbers[-1]:020d}"))
        try:
            return Generation(**json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def _version(self, base: Generation) -> str:
        return f"version=g{base.number}-{uuid.uuid4().hex}"

    def _commit(self, base: Generation, **changes) -> Generation:
        """Make *changes* to *base* visible, all at once."""
        new = replace(base, number=base.number + 1, **changes)
        name, written = f"generations/{new.number:020d}", f"generations/_{uuid.uuid4().hex}"
        out = self._fs().create(self._path(written))
        out.write(bytearray(json.dumps(asdict(new)).encode()))
        out.close()
        gateway = self.spark.sparkContext._gateway
        none = gateway.new_array(getattr(gateway.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        files = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("x").toUri(), self._conf())
        try:
            files.rename(self._path(written), self._path(name), none)
        except Py4JJavaError as error:
            if "FileAlreadyExistsException" not in str(error.java_exception.getClass()):
                raise
            self._fs().delete(self._path(written), False)
            raise Conflict(f"generation {new.number} of {self.root} is taken: start again from it") from None
        return new

    def vacuum(self) -> int:
        """Delete for good what the newest generation does not name; how many folders went.

        Folders begun from the newest generation stay: their writer may still commit.
        One begun from an older generation never can.
        """
        now, gone, fs = self.generation(), 0, self._fs()
        named = now.folders()
        for table in ("scans", "triage_log", "findings", "people"):
            for version in self._names(table):
                if not version.startswith("version=g") or int(version[9:].split("-")[0]) >= now.number:
                    continue
                inside = [f"/{p}" for p in self._names(f"{table}/{version}") if p.startswith("scan_id=")]
                parts = [f"{table}/{version}{p}" for p in inside or [""]]
                drop = [p for p in parts if p not in named]
                for part in [f"{table}/{version}"] if len(drop) == len(parts) else drop:
                    fs.delete(self._path(part), True)
                gone += len(drop)
        for number in self._numbers()[:-1]:
            fs.delete(self._path(f"generations/{number:020d}"), False)
        return gone

    # -- reading -------------------------------------------------------------

    def _read(self, table: str, folders: list[str], schema: str) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{table}").parquet(
            *[f"{self.root}/{table}/{f}" for f in folders]).select(*_names(schema))

    def _counted(self, g: Generation) -> DataFrame:
        return self._read("scans", [g.scans] if g.scans else [], COUNTED)

    def _parts(self, table: str, parts: dict[str, str], schema: str, only=None) -> DataFrame:
        """The findings or people of scans; of *only* some, no other folder is listed."""
        return self._read(
            table, [f"{v}/scan_id={s}" for s, v in parts.items() if only is None or int(s) in only], schema)

    def _triage(self, g: Generation) -> DataFrame:
        return self._read("triage_log", g.triage_log, TRIAGE_LOG)

    def scans(self) -> DataFrame:
        return self._counted(self.generation()).select(*_names(SCANS))

    def all_findings(self) -> DataFrame:
        return self._parts("findings", self.generation().findings, FINDINGS)

    def triage_log(self) -> DataFrame:
        return self._triage(self.generation())

    def triage(self) -> DataFrame:
        return latest_triage(self.triage_log())

    def latest_scan_id(self) -> int | None:
        return latest_scan(self.scans()).first()["scan_id"]

    def scan_list(self) -> DataFrame:
        """Scans and how many findings each has, from the counts kept with them."""
        return self._counted(self.generation()).select(
            *_names(SCANS), F.col("total").alias("findings")).orderBy("scan_id")

    def findings(self, scan_id: int | None = None) -> DataFrame:
        """Findings of a scan, the latest by default, worst first with their state."""
        g = self.generation()
        scan_id = scan_id if scan_id is not None else latest_scan(self._counted(g)).first()["scan_id"]
        chosen = self._parts("findings", g.findings, FINDINGS, only={scan_id})
        return worst_first(with_state(chosen, latest_triage(self._triage(g))))

    def trend(self) -> DataFrame:
        """:func:`trend` from the counts kept with each scan; no finding is read."""
        return self._counted(self.generation()).select(
            "scan_id", "finished_at", "total", *SEVERITIES).orderBy("scan_id")

    # -- writing -------------------------------------------------------------

    def _write(self, table: str, rows: DataFrame, version: str) -> str:
        rows.write.parquet(f"{self.root}/{table}/{version}")
        return version

    def record_scan(
        self, findings: DataFrame, *, root: str, started_at: str, finished_at: str, files: int = 0,
        records: int = 0, characters: int = 0, rules: int = 0, suppressed: int = 0,
    ) -> int:
        """Store one scan and give its number, which no other scan ever had or gets."""
        scan_id = self.generation().next_scan
        row = (scan_id, started_at, finished_at, root, files, records, characters, rules, suppressed)
        self.add_scans(
            self.spark.createDataFrame([row], SCANS), stored_form(findings).withColumn("scan_id", F.lit(scan_id).cast("bigint")))
        return scan_id

    def add_scans(self, scans: DataFrame, findings: DataFrame) -> None:
        """Store scans that have their numbers, with :data:`FINDINGS` in their stored form.

        All become visible together.  Findings of no such scan are left out; a number
        that was given out before is an error.
        """
        base = self.generation()
        version = self._version(base)
        numbers = {r["scan_id"] for r in scans.select("scan_id").distinct().collect()}
        taken = sorted(n for n in numbers if n < base.next_scan)
        if taken:
            raise ValueError(f"scan numbers given out before: {taken[:5]}")
        kept = findings.join(F.broadcast(scans.select("scan_id").distinct()), "scan_id", "left_semi").select(*_names(FINDINGS))
        if len(numbers) > 1:
            # a scan's rows meet in few files; large scans are still cut
            kept = kept.hint("rebalance", "scan_id")
        kept.write.partitionBy("scan_id").parquet(f"{self.root}/findings/{version}")
        found = self._held("findings", version)
        by_person = self._parts("findings", found, FINDINGS).groupBy("scan_id", "employee").agg(*severity_counts())
        by_person.select(*_names(PEOPLE)).hint("rebalance", "scan_id").write.partitionBy("scan_id").parquet(f"{self.root}/people/{version}")
        people = self._held("people", version)
        sums = self._parts("people", people, PEOPLE).groupBy("scan_id").agg(*[F.sum(c).alias(c) for c in COUNTS])
        rows = scans.join(F.broadcast(sums), "scan_id", "left").fillna(0, list(COUNTS)).select(*_names(COUNTED))
        self._commit(
            base, next_scan=max([base.next_scan, *[n + 1 for n in numbers]]),
            scans=self._write("scans", self._counted(base).unionByName(rows).coalesce(1), version),
            findings={**base.findings, **found}, people={**base.people, **people})

    def _held(self, table: str, version: str) -> dict[str, str]:
        """The scans that a version of a table has folders for."""
        return {n.split("=")[1]: version for n in self._names(f"{table}/{version}") if n.startswith("scan_id=")}

    def set_triage(self, entries: DataFrame | list[tuple[str, str, str]]) -> None:
        """Append ``(finding_id, state, note)`` entries; the last one counts."""
        if not isinstance(entries, DataFrame):
            entries = self.spark.createDataFrame(entries, "finding_id string, state string, note string")
        state = F.when(F.col("state").isin(*STATES), F.col("state")).otherwise(
            F.raise_error(F.concat(F.lit("unknown triage state: "), F.coalesce("state", F.lit("NULL"))))
        )
        self.add_triage(entries.select(
            "finding_id", state.alias("state"), F.coalesce("note", F.lit("")).alias("note"),
            F.current_timestamp().alias("updated_at"),
            F.format_string("%020d", F.monotonically_increasing_id()).alias("entry"),
        ))

    def add_triage(self, log: DataFrame, attempts: int = 5) -> None:
        """Append :data:`TRIAGE_LOG` rows."""
        for left in reversed(range(attempts)):
            base = self.generation()
            new = log.select(*_names(TRIAGE_LOG))
            try:
                if len(base.triage_log) < self.PIECES:
                    pieces = [*base.triage_log, self._write("triage_log", new, self._version(base))]
                else:
                    pieces = [self._write("triage_log", self._triage(base).unionByName(new), self._version(base))]
                self._commit(base, triage_log=pieces)
                return
            except Conflict:
                if not left:
                    raise

    # -- purging -------------------------------------------------------------

    def purge(
        self, *, everything: bool = False, scan_id: int | None = None, employee: str | None = None
    ) -> Purged:
        """Delete stored findings for good and say how much went.

        Readers see all of it gone or none.  Where it stops after that, the next purge
        or :meth:`vacuum` deletes what is left of the files.
        """
        base = self.generation()
        if everything:
            counted = self._counted(base).agg(F.count("*").alias("n"), F.coalesce(F.sum("total"), F.lit(0)).alias("f")).first()
            gone = Purged(counted["n"], counted["f"], latest_triage(self._triage(base)).count())
            changes = {"scans": None, "findings": {}, "people": {}, "triage_log": []}
        elif scan_id is not None:
            gone, changes = self._without_scan(base, scan_id)
        elif employee is not None:
            gone, changes = self._without_person(base, employee)
        else:
            raise ValueError("purge needs everything=True, a scan_id or an employee")
        if not everything:
            lost, log = self._without_orphans(base, changes.get("findings", base.findings))
            gone, changes = replace(gone, triage=lost), {**changes, **log}
        if changes:
            self._commit(base, **changes)
        self.vacuum()
        return gone

    def _without_scan(self, base: Generation, scan_id: int) -> tuple[Purged, dict]:
        row = self._counted(base).where(F.col("scan_id") == scan_id).first()
        if row is None:
            return Purged(), {}
        kept = self._counted(base).where(F.col("scan_id") != scan_id).coalesce(1)
        return Purged(1, row["total"]), {
            "scans": self._write("scans", kept, self._version(base)),
            "findings": {s: v for s, v in base.findings.items() if int(s) != scan_id},
            "people": {s: v for s, v in base.people.items() if int(s) != scan_id},
        }

    def _without_person(self, base: Generation, employee: str) -> tuple[Purged, dict]:
        """Only scans that mention the person are read and written, each table by one job without a shuffle."""
        people = self._parts("people", base.people, PEOPLE)
        # one row for each scan at most
        theirs = people.where(F.col("employee") == employee).collect()
        touched = {r["scan_id"] for r in theirs}
        if not touched:
            return Purged(), {}
        version, changes = self._version(base), {}
        for table, parts, schema in (("findings", base.findings, FINDINGS), ("people", base.people, PEOPLE)):
            self._parts(table, parts, schema, only=touched).where(
                ~F.col("employee").eqNullSafe(employee)).write.partitionBy("scan_id").parquet(f"{self.root}/{table}/{version}")
            changes[table] = {
                **{s: v for s, v in parts.items() if int(s) not in touched}, **self._held(table, version)}
        less = self.spark.createDataFrame(theirs, people.schema).select("scan_id", *[F.col(c).alias(f"_{c}") for c in COUNTS])
        counted = self._counted(base).join(F.broadcast(less), "scan_id", "left").select(*[
            (F.col(c) - F.coalesce(f"_{c}", F.lit(0))).alias(c) if c in COUNTS else F.col(c) for c in _names(COUNTED)])
        changes["scans"] = self._write("scans", counted.coalesce(1), version)
        return Purged(0, sum(r["total"] for r in theirs)), changes

    def _without_orphans(self, base: Generation, left: dict[str, str]) -> tuple[int, dict]:
        """The triage log without findings that are stored nowhere any more."""
        ids = self._parts("findings", left, FINDINGS).select("finding_id")
        lost = orphans(latest_triage(self._triage(base)), ids).count()
        if not lost:
            return 0, {}
        kept = self._triage(base).join(ids, "finding_id", "left_semi").select(*_names(TRIAGE_LOG))
        return lost, {"triage_log": [self._write("triage_log", kept, self._version(base))]}
