"""The scan: records to ranked, sanitised findings with its side tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame

from ..operators.collapse import collapse, ranked, sightings, with_also_at
from ..operators.detect import hits, suppressions
from ..operators.report import record_totals
from ..operators.sanitise import sanitise
from ..rules.model import RuleSet, load_rules
from .staging import stage


def findings(records: DataFrame, ruleset: RuleSet | None = None, *, sanitised: bool = True) -> DataFrame:
    """Ranked findings of *records*.  ``value`` is raw: drop it before showing anyone."""
    found = collapse(hits(records, ruleset))
    if sanitised:
        # Used for both sides of the masking joins; the regexes must run once.
        found = sanitise(stage(found, "findings"))
    return ranked(found)


@dataclass
class Scan:
    """One scan whose hits are written once and feed every table below."""

    records: DataFrame
    ruleset: RuleSet

    @cached_property
    def hits(self) -> DataFrame:
        return stage(hits(self.records, self.ruleset), "hits")

    @cached_property
    def collapsed(self) -> DataFrame:
        return stage(collapse(self.hits), "findings")

    @property
    def findings(self) -> DataFrame:
        return ranked(sanitise(self.collapsed))

    @property
    def sightings(self) -> DataFrame:
        return sightings(self.hits)

    @property
    def findings_with_places(self) -> DataFrame:
        return ranked(with_also_at(sanitise(self.collapsed), self.sightings))

    @property
    def suppressed(self) -> DataFrame:
        return suppressions(self.hits)

    @property
    def totals(self) -> DataFrame:
        return record_totals(self.records)


def scan(records: DataFrame, ruleset: RuleSet | None = None) -> Scan:
    return Scan(records, ruleset or load_rules())
