"""Dictionaries: rules, sections, tolerated expressions and synonyms, read and validated.

They are dimension tables of a few rows to some thousands.  Files are read with Spark's
CSV reader, so they may lie wherever documents may; the validated rows are kept on the
driver and enter plans as literals, which spares every join with them.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from . import defaults

_TRUE = {"1", "true", "yes", "oui", "y"}


@dataclass(frozen=True)
class DetectionRule:
    rule_id: str
    rule_scope: str
    regulatory_family: str
    section_scope: tuple[str, ...]
    category: str
    label: str
    terms: tuple[str, ...]
    synonyms: tuple[str, ...]
    alert_level: str
    severity: str
    base_score: float
    fuzzy_threshold: float
    applies_whitelist: bool

    @property
    def all_terms(self) -> tuple[str, ...]:
        return (*self.terms, *self.synonyms)


@dataclass(frozen=True)
class Section:
    section_id: str
    label: str
    start_marker: str
    end_marker: str | None


@dataclass(frozen=True)
class Tolerated:
    """An expression in which a match is no finding."""

    expression: str
    reason: str


def session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def _rows(path: str | None, default: str) -> Iterator[dict[str, str]]:
    """Rows of a CSV file, or of the default text; cells stripped, missing ones empty.  A missing file has no rows."""
    if path is None:
        for row in csv.DictReader(io.StringIO(default)):
            yield {k: (v or "").strip() for k, v in row.items() if k}
        return
    try:
        df = session().read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8").csv(str(path))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return
        raise
    for row in df.toLocalIterator():
        yield {k: (v or "").strip() for k, v in row.asDict().items()}


def pipe_split(value: str | None) -> tuple[str, ...]:
    return tuple(x for x in (p.strip().lower() for p in (value or "").split("|")) if x)


def parse_flag(value: str | None, default: bool) -> bool:
    return value.strip().casefold() in _TRUE if value and value.strip() else default


def _share(row: dict[str, str], column: str, default: float) -> float:
    number = float(row.get(column) or default)
    if not 0 <= number <= 1:
        raise ValueError(f"rule {row['rule_id']}: {column} {number} is not between 0 and 1")
    return number


def load_rules(path: str | None = None) -> list[DetectionRule]:
    """Detection rules.  Rows without id, section, category or terms are left out; wrong levels and scores raise ValueError."""
    found = []
    for row in _rows(path, defaults.RULES_CSV):
        get = row.get
        sections, terms = pipe_split(get("section_scope")), pipe_split(get("terms"))
        if not (get("rule_id") and sections and get("category") and terms):
            continue
        scope = (get("rule_scope") or get("scope") or "general").lower()
        level = (get("alert_level") or "alerte").lower()
        if level not in defaults.ALERT_LEVELS:
            raise ValueError(f"rule {row['rule_id']}: unknown alert level {level!r}")
        found.append(
            DetectionRule(
                rule_id=row["rule_id"],
                rule_scope=scope,
                regulatory_family=get("regulatory_family") or scope,
                section_scope=sections,
                category=row["category"],
                label=get("label") or row["rule_id"],
                terms=terms,
                synonyms=pipe_split(get("synonyms")),
                alert_level=level,
                severity=(get("severity") or "medium").lower(),
                base_score=_share(row, "base_score", 0.75),
                fuzzy_threshold=_share(row, "fuzzy_threshold", 0.88),
                applies_whitelist=parse_flag(get("applies_whitelist"), scope == "article9"),
            )
        )
    return found


def load_sections(path: str | None = None) -> list[Section]:
    rows = ((r.get("section_id", "").lower(), r) for r in _rows(path, defaults.SECTIONS_CSV))
    return [Section(i, r.get("label") or i, r.get("start_marker") or "", r.get("end_marker") or None) for i, r in rows if i]


def load_whitelist(path: str | None = None) -> list[Tolerated]:
    rows = ((r.get("expression", "").lower(), r.get("reason", "")) for r in _rows(path, defaults.WHITELIST_CSV))
    return [Tolerated(e, reason) for e, reason in rows if e]


def load_synonyms(path: str | None = None) -> dict[str, tuple[str, ...]]:
    """Synonyms by term, from column ``synonyms`` or else ``proposed_synonyms``; a term's last row counts."""
    found = {}
    for row in _rows(path, defaults.SYNONYMS_CSV):
        term, synonyms = row.get("term", "").lower(), pipe_split(row.get("synonyms") or row.get("proposed_synonyms"))
        if term and synonyms:
            found[term] = synonyms
    return found


def resolve_branches(branches: Iterable[str] | None) -> tuple[str, ...]:
    """Names of the branches that run: the dictionary branch by default; unknown names raise ValueError, repeats stay."""
    if branches is None:
        return ("generic",)
    names = tuple(x for x in (b.strip().lower() for b in branches) if x)
    unknown = sorted({n for n in names if n not in defaults.BRANCHES})
    if unknown:
        raise ValueError(f"unknown branches: {', '.join(unknown)}")
    return names
