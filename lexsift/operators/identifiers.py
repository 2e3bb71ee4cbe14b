"""The identifier branch: e-mail addresses, telephone, account and social security numbers by patterns, all inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import defaults
from ..functions import text as X
from .findings import Cut, a_finding, a_section, finding_rows

Pattern = tuple[str, str, str, float]  # entity, title, pattern, score


def _hits(text: Column, entity: str, title: str, pattern: str, score: float) -> Column:
    found = F.regexp_extract_all(text, F.lit(f"(?U){pattern}"), F.lit(0))
    return F.transform(found, lambda m: F.struct(F.lit(entity).alias("entity"), F.lit(title).alias("title"), m.alias("text"), F.lit(score).alias("score")))


def identifiers_found(df: DataFrame, cut: Cut, patterns: Sequence[Pattern] = defaults.IDENTIFIER_PATTERNS) -> DataFrame:
    """Adds the findings ``regex`` of one section: one for every match."""
    if not patterns:
        return df.withColumn(cut.name("regex"), cut.none())

    def finding(h: Column, at: Column) -> Column:
        lower, score = F.lower(h["entity"]), h["score"]
        values = {
            "code": F.concat(F.lit("regex_"), lower),
            "severity": F.lit("medium"),
            "title": h["title"],
            "detail": F.concat(F.lit("Regex detected '"), h["text"], F.lit("' as '"), h["entity"], F.lit("'.")),
            "matched_term": h["text"],
            "alert_level": F.lit("alerte"),
            "category": lower,
            "score": score,
            "branch_score": score,
            "regex_score": score,
            "detection_type": F.lit("regex"),
            "detection_engine": F.lit("regex"),
            "rule_id": h["entity"],
            "rule_scope": F.lit("regex"),
            "regulatory_family": F.lit("donnees_personnelles_structurees"),
        }
        return a_finding(cut, values, 3, at)

    df = df.withColumn(cut.name("hits"), F.flatten(F.array(*(_hits(cut.text, *p) for p in patterns))))
    df = df.withColumn(cut.name("evidence"), F.when(F.size(cut.col("hits")) > 0, X.shorten(cut.text)))
    return df.withColumn(cut.name("regex"), F.transform(cut.col("hits"), finding)).drop(cut.name("hits"), cut.name("evidence"))


def searched(section: str, names: Sequence[str]) -> bool:
    """Whether identifiers are looked for in a section: in ``document`` if there is one, else in all."""
    return section == "document" or "document" not in names


def detect_identifiers(sections: DataFrame, names: Sequence[str], patterns: Sequence[Pattern] = defaults.IDENTIFIER_PATTERNS) -> DataFrame:
    """Findings of the identifier branch in rows of sections: one for every match in the section ``document`` if there is one, else in all sections."""
    base = sections.where(F.col("section") == "document") if "document" in names else sections
    return finding_rows(identifiers_found(base, a_section(), patterns), "regex")
