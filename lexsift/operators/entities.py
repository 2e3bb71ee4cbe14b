"""The entity branch: zero-shot recognition of labels by a pluggable model."""

from __future__ import annotations

import functools
import os
from collections.abc import Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import defaults
from ..functions import text as X
from .findings import Cut, a_finding, a_section, finding_rows

#: An entity; its label also folded.
_ENTITY = "struct<label:string,text:string,score:double,folded:string>"


class EntityProvider(Protocol):
    """Gives entities of a text as mappings of ``label``, ``text`` and ``score``.  Instances travel to executors."""

    def predict_entities(self, text: str, labels: list[str], threshold: float) -> list[dict]: ...


@functools.lru_cache(maxsize=4)
def _model(name: str, cache: str | None, source: str | None, local_only: bool):
    try:
        from gliner import GLiNER
    except ImportError as e:
        raise RuntimeError("the entity branch needs the package gliner") from e
    try:
        path_like = any(c in name for c in "/\\") or name.startswith(".")
        if path_like and not os.path.isdir(name):
            if local_only or not source:
                raise RuntimeError(f"no model at {name}")
            model = GLiNER.from_pretrained(source, cache_dir=cache)
            os.makedirs(name, exist_ok=True)
            model.save_pretrained(name)
            return model
        return GLiNER.from_pretrained(name, cache_dir=cache, local_files_only=local_only)
    except Exception as e:
        raise RuntimeError(f"the entity model {name} can't be loaded: {e}") from e


class ModelEntities:
    """Entities from an installed model, which each process loads once; RuntimeError where it is missing."""

    def __init__(self, name: str, cache: str | None = None, source: str | None = None, local_only: bool = False):
        self.args = (name, cache, source, local_only)

    def check(self) -> None:
        _model(*self.args)

    def predict_entities(self, text: str, labels: list[str], threshold: float) -> list[dict]:
        return _model(*self.args).predict_entities(text, labels, threshold=threshold)


def clean_labels(labels: Sequence[str] | None) -> tuple[str, ...]:
    return tuple(x for x in (label.strip() for label in (labels or defaults.ENTITY_LABELS)) if x)


def entities_found(df: DataFrame, cut: Cut, provider: EntityProvider, labels: Sequence[str] | None = None, threshold: float = defaults.ENTITY_THRESHOLD) -> DataFrame:
    """Adds the findings ``gliner`` of one section: one for each entity with a label and a text."""
    wanted = list(clean_labels(labels))
    if not wanted:
        return df.withColumn(cut.name("gliner"), cut.none())

    def run(texts: pd.Series) -> pd.Series:
        found = []
        for text in texts:
            entities = provider.predict_entities(text, wanted, threshold) if text else ()
            rows = [(str(e.get("label") or "").strip(), str(e.get("text") or "").strip(), e.get("score")) for e in entities]
            found.append([{"label": a, "text": b, "score": None if s is None else round(float(s), 2), "folded": X.fold_text(a)} for a, b, s in rows if a and b])
        return pd.Series(found, dtype=object)

    def finding(e: Column, at: Column) -> Column:
        code, score = X.label_code(e["folded"]), e["score"]
        values = {
            "code": code,
            "severity": F.lit("medium"),
            "title": e["label"],
            "detail": F.concat(F.lit("GLiNER detected '"), e["text"], F.lit("' as '"), e["label"], F.lit("'.")),
            "matched_term": e["text"],
            "alert_level": F.lit("alerte"),
            "category": F.replace(e["folded"], F.lit(" "), F.lit("_")),
            "score": score,
            "branch_score": score,
            "gliner_score": score,
            "detection_type": F.lit("entity"),
            "detection_engine": F.lit("gliner"),
            "rule_id": code,
            "rule_scope": F.lit("gliner"),
            "regulatory_family": F.lit("gliner"),
        }
        return a_finding(cut, values, 2, at)

    df = df.withColumn(cut.name("compact"), X.compact(cut.text))
    df = df.withColumn(cut.name("entities"), F.pandas_udf(T.DataType.fromDDL(f"array<{_ENTITY}>"))(run)(cut.col("compact")))
    df = df.withColumn(cut.name("evidence"), F.when(F.size(cut.col("entities")) > 0, X.shorten(cut.col("compact"))))
    return df.withColumn(cut.name("gliner"), F.transform(cut.col("entities"), finding)).drop(*map(cut.name, ("compact", "entities", "evidence")))


def detect_entities(sections: DataFrame, provider: EntityProvider, labels: Sequence[str] | None = None, threshold: float = defaults.ENTITY_THRESHOLD) -> DataFrame:
    """Findings of the entity branch in rows of sections: one for each entity with a label and a text, in all sections that aren't blank."""
    return finding_rows(entities_found(sections, a_section(), provider, labels, threshold), "gliner")
