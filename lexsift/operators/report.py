"""Tables and summaries over findings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import defaults
from ..config import DetectionRule, Section
from ..functions import text as X
from ..schemas import FINDING_FIELDS, FLAT_COLUMNS, METADATA_FIELDS
from .findings import ORDER_COLUMNS
from .sections import with_section_map

KEYS = ["document_name", "source_path"]
ENGINES = ("generic", "spacy", "gliner", "regex")


_LIST = "array<struct<" + ",".join(f"{n}:{k}" for n, k in FINDING_FIELDS) + ">>"


def _of_engine(engine: str) -> Column:
    return F.filter("found", lambda f: f["detection_engine"] == engine)


def _metadata(known: Mapping[str, object]) -> Column:
    """What is known of the run, and counts and best scores of the row's findings."""

    def value(name: str, kind: str) -> Column:
        if name == "finding_count":
            return F.size("found")
        if name == "has_findings":
            return F.size("found") > 0
        if name.endswith("_finding_count"):
            return F.size(_of_engine(name.removesuffix("_finding_count")))
        if name.endswith("_max_score"):
            engine = name.removesuffix("_max_score")
            return F.array_max(F.transform(_of_engine(engine), lambda f: f[f"{engine}_score"]))
        v = known.get(name)
        if isinstance(v, list):
            return F.array(*map(F.lit, v)).cast(kind)
        if isinstance(v, dict):
            return F.create_map(*(F.lit(x) for kv in v.items() for x in kv)).cast(kind)
        return F.lit(v)

    return F.struct(*(value(n, k).cast(k).alias(n) for n, k in METADATA_FIELDS))


def document_metadata(analyzed: DataFrame, known: Mapping[str, object]) -> DataFrame:
    """(document_name, source_path, metadata): counts and scores, and what is known of the run, for every document (.., found)."""
    return analyzed.select(*KEYS, _metadata(known).alias("metadata"))


def with_errors(metadata: DataFrame) -> DataFrame:
    """Documents for which a branch could not run."""
    return metadata.where(F.size("metadata.branch_errors") > 0)


def flat_findings(analyzed: DataFrame) -> DataFrame:
    """One row for each finding with its document's number of findings; one of nulls for a document (.., found) without any."""
    each = analyzed.select(*KEYS, F.size("found").cast("long").alias("finding_count"), F.inline_outer("found"))
    return each.select(*FLAT_COLUMNS)


def nested_analyses(analyzed: DataFrame, known: Mapping[str, object], sections: Sequence[Section]) -> DataFrame:
    """One row for each document (.., found): name, path, compact text, sections, findings in order, metadata.  Texts stay where they are."""
    found = F.transform("found", lambda f: F.struct(*(f[n].alias(n) for n, _ in FINDING_FIELDS))).cast(_LIST)
    mapped = with_section_map(analyzed, sections)
    return mapped.select(*KEYS, X.compact(F.col("extracted_text")).alias("extracted_text"), "sections", found.alias("findings"), _metadata(known).alias("metadata"))


def corpus_summary(analyzed: DataFrame) -> DataFrame:
    """The same as ``summary``, of documents (.., found): one aggregate of numbers, and one of codes."""
    n = F.size("found").cast("long")
    head = analyzed.agg(F.count("*").alias("document_count"), F.count_if(n > 0).alias("documents_with_findings"), F.coalesce(F.sum(n), F.lit(0)).alias("total_findings"))
    codes = analyzed.select(F.explode(F.transform("found", lambda f: f["code"])).alias("code")).where("code <> ''").groupBy("code").agg(F.count("*").alias("n"))
    codes = codes.agg(F.map_from_entries(F.collect_list(F.struct("code", "n"))).alias("finding_codes"))
    return head.withColumn("one", F.lit(1)).join(codes.withColumn("one", F.lit(1)), "one").drop("one")


def summary(flat: DataFrame) -> DataFrame:
    """document_count, documents_with_findings, total_findings, and finding_codes as a map.

    Both halves start from one aggregate by document and code, whose shuffle they share.
    """
    base = flat.groupBy(*KEYS, "finding_count", "code").agg(F.count("*").alias("n"))
    docs = base.groupBy(*KEYS, "finding_count").agg(F.sum("n").alias("n"))
    found = F.when(F.col("finding_count") > 0, F.col("n"))
    head = docs.agg(
        F.count("*").alias("document_count"),
        F.count(found).alias("documents_with_findings"),
        F.coalesce(F.sum(found), F.lit(0)).alias("total_findings"),
    )
    codes = base.where("code <> ''").groupBy("code").agg(F.sum("n").alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("code", "n"))).alias("finding_codes"))
    return head.withColumn("one", F.lit(1)).join(codes.withColumn("one", F.lit(1)), "one").drop("one")


def code_counts(flat: DataFrame) -> DataFrame:
    return flat.where("code <> ''").groupBy("code").count()


def with_flags(flat: DataFrame) -> DataFrame:
    """Adds is_article9 and is_generic (a rule of any other scope), and score as a number or null."""
    article9 = F.col("rule_scope").eqNullSafe("article9")
    return flat.withColumn("score", F.expr("try_cast(score AS DOUBLE)")).withColumn("is_article9", article9).withColumn("is_generic", F.col("rule_id").isNotNull() & ~article9)


def prioritized(flagged: DataFrame) -> DataFrame:
    return flagged.orderBy(F.desc("is_article9"), F.desc("is_generic"), F.desc_nulls_last("score"), F.asc_nulls_last("severity"))


def by_document_and_score(flat: DataFrame) -> DataFrame:
    return flat.orderBy("document_name", F.desc_nulls_last("score"))


def by_code_and_severity(flat: DataFrame) -> DataFrame:
    return flat.groupBy("code", "severity").count().orderBy(F.desc("count"))


def by_document(flagged: DataFrame) -> DataFrame:
    aggs = [F.count("code").alias("finding_count"), F.max("score").alias("max_score"), F.sum(F.col("is_article9").cast("long")).alias("article9_count")]
    return flagged.groupBy("document_name").agg(*aggs).orderBy(F.desc("article9_count"), F.desc_nulls_last("max_score"), F.desc("finding_count"))


def score_profile(rows: DataFrame, *keys: str, score: str = "score") -> DataFrame:
    """Count, best, mean and least score of groups."""
    return rows.groupBy(*keys).agg(F.count("*").alias("count"), F.max(score).alias("max_score"), F.avg(score).alias("avg_score"), F.min(score).alias("min_score"))


def by_section_category_type(flagged: DataFrame) -> DataFrame:
    return score_profile(flagged.where("is_generic"), "section", "category", "detection_type").drop("min_score")


def article9_profile(flagged: DataFrame) -> DataFrame:
    return score_profile(flagged.where("is_article9"), "category", "detection_type").drop("min_score")


def with_review(flat: DataFrame) -> DataFrame:
    return flat.withColumn("review_action", X.review_action(F.col("score")))


def review_counts(flat: DataFrame) -> DataFrame:
    return with_review(flat).groupBy("review_action").count()


def review_queue(flat: DataFrame) -> DataFrame:
    """What people should look at, best scores first."""
    return with_review(flat).where(F.col("review_action").isin([n for n, _ in defaults.REVIEW_LIMITS])).orderBy(F.desc_nulls_last("score"), "category")


def doubtful(flat: DataFrame) -> DataFrame:
    """Findings that may be false: those of the looser ways of detection."""
    return flat.where(F.col("detection_type").isin("fuzzy", "root", "synonym")).orderBy("detection_type", F.desc_nulls_last("score"))


def where(flat: DataFrame, code: str | None = None, matched_term: str | None = None, rule_scope: str | None = None, least_score: float | None = None) -> DataFrame:
    """Findings by code, term, scope or score."""
    for column, value in (("code", code), ("matched_term", matched_term), ("rule_scope", rule_scope)):
        if value is not None:
            flat = flat.where(F.col(column) == value)
    return flat if least_score is None else flat.where(F.col("score") >= least_score)


def entity_summary(findings: DataFrame) -> DataFrame:
    """Of each rule: number, best score, and the terms found."""
    return findings.groupBy(X.finding_key(F.col("rule_id"), F.col("code")).alias("predicted_key")).agg(F.count("*").alias("count"), F.max("score").alias("max_score"), X.joined_set(F.col("matched_term")).alias("matched_terms"))


def case_rows(cases: DataFrame, findings: DataFrame, engine: str = "none") -> DataFrame:
    """Findings of cases (case_id, ...), one row of nulls for a case without any, with ``predicted_key`` and ``detection_count``."""
    f = findings.withColumnRenamed("document_name", "f_case").drop("source_path", *ORDER_COLUMNS)
    both = cases.join(f, F.col("case_id").eqNullSafe(F.col("f_case")), "left").drop("f_case")
    key = X.finding_key(F.col("rule_id"), F.col("code"))
    return both.withColumn("predicted_key", key).withColumn("detection_count", F.col("detection_engine").isNotNull().cast("int")).withColumn("detection_engine", F.coalesce("detection_engine", F.lit(engine)))


def by_case_and_score(rows: DataFrame) -> DataFrame:
    """Rows of cases by (case_id, engine, best score first); what else tells rows apart settles ties."""
    return rows.orderBy("case_id", "detection_engine", F.desc_nulls_last("branch_score"), "predicted_key", "matched_term", "detection_type")


def placed(ordered: DataFrame) -> DataFrame:
    """Adds ``place``, from 1, in the order that the rows are in: each partition counts on from those before it."""
    rows = ordered.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return rows.join(F.broadcast(starts), "part").withColumn("place", F.col("first") + F.col("at") + 1).drop("part", "at", "first")


def branch_summary(rows: DataFrame) -> DataFrame:
    """Of each engine: cases, those with findings and without, findings, mean and best of the cases' best scores."""
    each = rows.groupBy("detection_engine", "case_id").agg(F.sum("detection_count").alias("n"), F.max("branch_score").alias("best"))
    return each.groupBy("detection_engine").agg(
        F.count("*").alias("case_count"), F.count_if(F.col("n") > 0).alias("detected_count"), F.count_if(F.col("n") == 0).alias("undetected_count"),
        F.sum("n").alias("finding_count"), F.avg("best").alias("avg_max_score"), F.max("best").alias("max_score"),
    )


def branch_profile(rows: DataFrame) -> DataFrame:
    """Of each engine, family, category and way of detection: findings and their scores."""
    return rows.groupBy("detection_engine", "control_family", "category", "detection_type").agg(
        F.count("predicted_key").alias("count"), F.avg("branch_score").alias("avg_score"), F.min("branch_score").alias("min_score"), F.max("branch_score").alias("max_score")
    )


def label_profile(rows: DataFrame) -> DataFrame:
    return rows.groupBy("detection_engine", F.col("title").alias("predicted_label"), "section").agg(F.count("predicted_key").alias("count"), F.avg("branch_score").alias("avg_score"), F.min("branch_score").alias("min_score"), F.max("branch_score").alias("max_score"))


def case_comparison(rows: DataFrame) -> DataFrame:
    """Of each case and engine: findings, best score, keys and terms."""
    return rows.groupBy("case_id", "detection_engine").agg(
        F.sum("detection_count").alias("detection_count"), F.max("branch_score").alias("max_score"), X.joined_set(F.col("predicted_key")).alias("predicted_keys"), X.joined_set(F.col("matched_term")).alias("matched_terms")
    )


def branch_pivot(comparison: DataFrame, engines: Sequence[str] = ENGINES) -> DataFrame:
    """Number of findings of each case, a column for each engine."""
    return comparison.groupBy("case_id").pivot("detection_engine", list(engines)).agg(F.sum("detection_count")).na.fill(0)


def dictionary_counts(rules: Sequence[DetectionRule], **others: int) -> dict[str, int]:
    """Sizes of the dictionaries, rules by scope."""
    article9 = sum(r.rule_scope == "article9" for r in rules)
    return {"rules": len(rules), "general_rules": len(rules) - article9, "article9_rules": article9, **others}


def rule_display(rules: Sequence[DetectionRule]) -> list[dict]:
    """Rules as rows of plain values, lists joined by bars."""
    return [{k: " | ".join(v) if isinstance(v, tuple) else v for k, v in vars(r).items()} for r in rules]
