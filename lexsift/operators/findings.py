"""From matches of rules to findings: an array in the row that the text is in, which ``finding_rows`` unfolds."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DetectionRule, Tolerated
from ..functions import text as X
from ..schemas import FINDING_FIELDS

#: A match: where it ranks among a rule's matches (smaller is better), what it found, and this folded.
MATCH = "struct<rule:int,minus_score:double,minus_term:int,detector:int,kind:string,matched:string,folded:string>"
ORDER_COLUMNS = ["branch_ord", "section_ord", "item_ord"]
#: A finding with its place in a document's list.
FOUND = "struct<" + ",".join([*(f"{c}:int" for c in ORDER_COLUMNS), *(f"{n}:{k}" for n, k in FINDING_FIELDS)]) + ">"


@dataclass(frozen=True)
class Cut:
    """Where a section stands in a row: its name, its place and its text.

    Rows are sections, or documents with several sections; then ``prefix`` keeps the
    columns that are made for each of them apart.
    """

    section: Column
    ord: Column
    text: Column
    prefix: str = ""

    def name(self, column: str) -> str:
        return f"{self.prefix}{column}"

    def col(self, column: str) -> Column:
        return F.col(self.name(column))

    def none(self) -> Column:
        return F.array().cast(f"array<{FOUND}>")


def a_section() -> Cut:
    """The section of a row that ``with_sections`` made."""
    return Cut(F.col("section"), F.col("section_ord"), F.col("section_text"))
_RULE = "array<struct<rule_id:string,rule_scope:string,regulatory_family:string,category:string,label:string,alert_level:string,severity:string,code:string,applies_whitelist:boolean>>"


def rule_table(rules: Sequence[DetectionRule]) -> Column:
    """The rules' attributes as an array literal, by their place."""
    rows = [
        {k: getattr(r, k) for k in ("rule_id", "rule_scope", "regulatory_family", "category", "label", "alert_level", "severity", "applies_whitelist")}
        | {"code": f"article9_{r.category}" if r.rule_scope == "article9" else r.rule_id}
        for r in rules
    ]
    return F.from_json(F.lit(json.dumps(rows)), _RULE)


def best_of_each_rule(matches: Column) -> Column:
    """For each rule the match of the highest score; of equals the later term's, then the earlier way of detection."""
    # A fold, so that the array is made and sorted once: what a lambda refers to is evaluated for each element.
    none = F.array().cast(f"array<{MATCH}>")
    return F.aggregate(F.array_sort(matches), none, lambda best, m: F.when(F.try_element_at(best, F.lit(-1))["rule"].eqNullSafe(m["rule"]), best).otherwise(F.concat(best, F.array(m))))


def tolerated(matched: Column, folded: Column, whitelist: Sequence[Tolerated]) -> Column:
    """Whether an expression of the whitelist stands in the text and holds the match or is held by it (all folded)."""
    expressions = [X.fold_text(w.expression) for w in whitelist]
    if not expressions:
        return F.lit(False)
    return F.exists(F.array(*map(F.lit, expressions)), lambda e: F.contains(folded, e) & (F.contains(e, matched) | F.contains(matched, e)))


def rule_findings(matched: DataFrame, cut: Cut, rules: Sequence[DetectionRule], whitelist: Sequence[Tolerated], engine: str, branch_ord: int, note: str = "") -> DataFrame:
    """Adds the findings ``{engine}`` of rows with ``compact``, ``folded`` and ``matches``: the best match of each rule, unless it is tolerated.

    Only the best match is held against the whitelist: a tolerated one hides the rule's others.
    """
    table = rule_table(rules)
    matched = matched.withColumn(cut.name("evidence"), F.when(F.size(cut.col("matches")) > 0, X.shorten(cut.col("compact"))))
    rated = F.transform(cut.col("matches"), lambda m: F.struct(m.alias("m"), F.element_at(table, m["rule"] + 1).alias("r")))
    kept = F.filter(rated, lambda x: ~(x["r"]["applies_whitelist"] & tolerated(x["m"]["folded"], cut.col("folded"), whitelist))) if whitelist else rated

    def finding(x: Column) -> Column:
        m, r = x["m"], x["r"]
        score = -m["minus_score"]
        values = {
            "code": r["code"],
            "severity": r["severity"],
            "title": r["label"],
            "detail": F.concat(F.lit("Rule '"), r["rule_id"], F.lit("' detected '"), m["matched"], F.lit("' as "), m["kind"], F.lit(f"{note}.")),
            "matched_term": m["matched"],
            "alert_level": r["alert_level"],
            "category": r["category"],
            "score": score,
            "branch_score": score,
            f"{engine}_score": score,
            "detection_type": m["kind"],
            "detection_engine": F.lit(engine),
            "rule_id": r["rule_id"],
            "rule_scope": r["rule_scope"],
            "regulatory_family": r["regulatory_family"],
        }
        return a_finding(cut, values, branch_ord, m["rule"])

    return matched.withColumn(cut.name(engine), F.transform(kept, finding)).drop(cut.name("evidence"), cut.name("matches"), cut.name("folded"))


def a_finding(cut: Cut, values: dict[str, Column], branch_ord: int, item_ord: Column) -> Column:
    """A finding with all its fields and the order of the list that it is in; its row has ``evidence``."""
    own = {"section": cut.section, "evidence": cut.col("evidence")} | values
    fields = [own.get(n, F.lit(None)).cast(k).alias(n) for n, k in FINDING_FIELDS]
    return F.struct(F.lit(branch_ord).alias("branch_ord"), cut.ord.cast("int").alias("section_ord"), item_ord.cast("int").alias("item_ord"), *fields)


def finding_rows(rows: DataFrame, *columns: str) -> DataFrame:
    """A row for each finding of the arrays ``columns``, with what names the document."""
    found = F.col(columns[0]) if len(columns) == 1 else F.concat(*columns)
    # Not inline: for it the optimizer would test the array's size first, and make the array for that once more.
    return rows.select("document_name", "source_path", F.inline_outer(found)).where("branch_ord IS NOT NULL")
