"""Quality of detection against expectations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import defaults
from ..functions import text as X
from .findings import ORDER_COLUMNS

_BAR = " | "


def case_results(cases: DataFrame, findings: DataFrame) -> DataFrame:
    """Each case (case_id, expected_alert, expected_keys, expected_categories, expected_detection_types, ...) with what was found and how it compares.

    A case is in order if the alert is as expected, the expected keys are found and no
    other, and, where they are named, one of the categories and one of the ways of detection.
    """
    f = findings.drop("source_path", *ORDER_COLUMNS)
    sets = f.groupBy(F.col("document_name").alias("f_case")).agg(
        F.collect_set(X.finding_key(F.col("rule_id"), F.col("code"))).alias("keys"),
        F.collect_set(F.nullif("category", F.lit(""))).alias("categories"),
        F.collect_set(F.nullif("detection_type", F.lit(""))).alias("types"),
        F.count("*").alias("n"),
        F.max("score").alias("max_score"),
    )
    both = cases.join(sets, F.col("case_id").eqNullSafe(F.col("f_case")), "left").drop("f_case")
    none = F.array().cast("array<string>")
    keys, categories, types = (F.coalesce(c, none) for c in ("keys", "categories", "types"))
    want, want_categories, want_types = (X.split_expected(F.col(f"expected_{c}")) for c in ("keys", "categories", "detection_types"))
    detected = F.coalesce(F.col("n"), F.lit(0)) > 0
    expected = F.coalesce(F.col("expected_alert"), F.lit(False))
    missing = F.array_except(want, keys)
    unexpected = F.when(F.size(want) > 0, F.array_except(keys, want)).when(~expected, keys).otherwise(none)
    text = lambda a: F.array_join(F.array_sort(a), _BAR)
    rated = both.select(
        *cases.columns,
        detected.alias("detected"),
        text(keys).alias("predicted_keys"),
        text(missing).alias("missing_keys"),
        text(unexpected).alias("unexpected_keys"),
        text(categories).alias("predicted_categories"),
        text(types).alias("predicted_detection_types"),
        F.coalesce("n", F.lit(0)).alias("finding_count"),
        "max_score",
        outcome(expected, detected).alias("alert_outcome"),
        (F.size(missing) == 0).alias("expected_key_match"),
        ((F.size(want_categories) == 0) | F.coalesce(F.arrays_overlap(want_categories, categories), F.lit(False))).alias("category_match"),
        ((F.size(want_types) == 0) | F.coalesce(F.arrays_overlap(want_types, types), F.lit(False))).alias("detection_type_match"),
    )
    ok = F.col("alert_outcome").isin("TP", "TN") & F.col("expected_key_match") & F.col("category_match") & F.col("detection_type_match") & (F.col("unexpected_keys") == "")
    return rated.withColumn("case_ok", ok)


def outcome(expected, detected):
    return F.when(expected & detected, "TP").when(expected, "FN").when(detected, "FP").otherwise("TN")


def outcome_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("control_family", "alert_outcome").count()


def quality_summary(results: DataFrame) -> DataFrame:
    ok = F.col("case_ok")
    return results.agg(F.count("*").alias("case_count"), F.count_if(ok).alias("ok_count"), F.count_if(~ok).alias("ko_count"), F.avg(ok.cast("double")).alias("ok_rate"))


def _rates(counts: DataFrame) -> DataFrame:
    precision, recall = F.try_divide(F.col("TP"), F.col("TP") + F.col("FP")), F.try_divide(F.col("TP"), F.col("TP") + F.col("FN"))
    rated = counts.withColumn("precision", precision).withColumn("recall", recall)
    f1 = F.when((F.col("precision") > 0) & (F.col("recall") > 0), 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    return rated.withColumn("f1", f1)


def alert_metrics(results: DataFrame) -> DataFrame:
    """TP, FP, FN, TN, precision, recall and f1; a rate without a denominator is null, and so is f1 without both rates."""
    return _rates(results.agg(*(F.count_if(F.col("alert_outcome") == k).alias(k) for k in ("TP", "FP", "FN", "TN"))))


def threshold_sweep(results: DataFrame, thresholds: Sequence[float] = defaults.SWEEP) -> DataFrame:
    """The metrics of (expected_alert, max_score) if only scores at or over a threshold counted, for each threshold; one pass over the cases."""
    each = results.select(F.coalesce("expected_alert", F.lit(False)).alias("e"), F.coalesce("max_score", F.lit(0.0)).alias("s"), F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    found = outcome(F.col("e"), F.col("s") >= F.col("threshold"))
    return _rates(each.withColumn("o", found).groupBy("threshold").agg(*(F.count_if(F.col("o") == k).alias(k) for k in ("TP", "FP", "FN", "TN"))))


def failed(results: DataFrame) -> DataFrame:
    return results.where(~F.col("case_ok"))


def missed(results: DataFrame) -> DataFrame:
    return results.where(~F.col("detected"))


def numbered_cases(cases: DataFrame, prefix: str = "CASE_", digits: int = 3) -> DataFrame:
    """Adds case_id by the rows' place in the file (a small table in one partition)."""
    n = F.monotonically_increasing_id() + 1
    return cases.coalesce(1).withColumn("case_id", F.concat(F.lit(prefix), F.lpad(n.cast("string"), digits, "0")))
