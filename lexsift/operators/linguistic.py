"""The linguistic branch: terms, lemmas, roots and fuzzy matches over the words that a language model gives."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import defaults
from ..config import DetectionRule, Tolerated
from ..functions import text as X
from .dictionary import scoped
from .findings import MATCH, Cut, a_section, best_of_each_rule, finding_rows, rule_findings
from .similarity import FuzzySearch, FuzzyTerm

Word = tuple[str, str]  # folded text and folded lemma


class LemmaProvider(Protocol):
    """Gives the words of a text that are neither blanks nor punctuation.  Instances travel to executors."""

    def words(self, text: str) -> list[Word]: ...


class TableLemmas:
    """Lemmas from a table of forms; a form that isn't in it is its own lemma."""

    def __init__(self, lemmas: Mapping[str, str] | None = None):
        self.lemmas = {X.fold_text(k): X.fold_text(v) for k, v in (lemmas or {}).items()}

    def words(self, text: str) -> list[Word]:
        return [(w, self.lemmas.get(w, w)) for w in X.tokenize(text)]


@functools.lru_cache(maxsize=4)
def _model(name: str):
    try:
        import spacy
    except ImportError as e:
        raise RuntimeError("the linguistic branch needs the package spacy") from e
    try:
        return spacy.load(name)
    except OSError as e:
        raise RuntimeError(f"the language model {name} is not installed") from e


class ModelLemmas:
    """Lemmas from an installed language model, which each process loads once; RuntimeError where it is missing."""

    def __init__(self, name: str):
        self.name = name

    def check(self) -> None:
        _model(self.name)

    def words(self, text: str) -> list[Word]:
        out = []
        for token in _model(self.name)(text):
            folded = X.fold_text(token.text)
            if token.is_space or token.is_punct or not folded:
                continue
            lemma = token.lemma_ or token.text
            out.append((folded, folded if lemma == "-PRON-" else X.fold_text(lemma)))
        return out


def rule_synonyms(rule: DetectionRule, synonyms: Mapping[str, Sequence[str]]) -> tuple[str, ...]:
    """The synonyms of a rule's terms, folded, without its terms and without repeats; keys are looked up folded."""
    own = {X.fold_text(t) for t in rule.terms}
    found = (X.fold_text(s) for t in rule.terms for s in synonyms.get(X.fold_text(t), ()))
    return tuple(s for s in dict.fromkeys(found) if s and s not in own)


def _terms(rules: Sequence[DetectionRule], section: str, provider: LemmaProvider, synonyms: Mapping[str, Sequence[str]]) -> list[dict]:
    mods, rows = defaults.LINGUISTIC_MODIFIERS, []
    for place, rule in scoped(rules, section):
        every = [(t, False) for t in rule.terms] + [(s, True) for s in rule_synonyms(rule, synonyms)]
        for order, (term, synonym) in enumerate(every):
            lower = X.score(rule.base_score, mods["synonym"]) if synonym else rule.base_score
            rows.append({
                "rule": place, "order": order, "term": term, "folded": X.fold_text(term), "words": provider.words(term), "threshold": rule.fuzzy_threshold, "kind": "synonym" if synonym else "exact",
                "exact": X.score(rule.base_score, mods["synonym" if synonym else "exact"]), "lemma": X.score(lower, mods["lemma"]), "root": X.score(lower, mods["root"]), "fuzzy": X.score(rule.base_score, mods["fuzzy"]),
            })
    return rows


class _Search:
    """All ways of detection for the terms of one section."""

    def __init__(self, rows: list[dict], fuzzy: bool = True):
        import re

        self.rows = rows
        self.patterns = [re.compile(rf"(?<!\w){re.escape(r['folded'])}(?!\w)", re.I) for r in rows]
        self.fuzzy = FuzzySearch([FuzzyTerm(r["rule"], i, r["folded"], len(r["words"]), r["threshold"], 0.0) for i, r in enumerate(rows)]) if fuzzy else None

    def __call__(self, folded: str, words: list[Word]) -> Iterator[tuple[dict, str, str, int]]:
        surfaces, lemmas = [w for w, _ in words], [m for _, m in words]
        starts: dict[str, list[int]] = {}
        for i, m in enumerate(lemmas):
            starts.setdefault(m, []).append(i)
        by_stem: dict[str, list[int]] = {}
        for m, at in starts.items():
            s = X.stem(m)
            if len(s) >= defaults.ROOT_LENGTH:
                by_stem.setdefault(s, []).extend(at)
        for r, pattern in zip(self.rows, self.patterns):
            if r["folded"] in folded and pattern.search(folded):
                yield r, "exact", r["term"], 0
            own = [m for _, m in r["words"]]
            n = len(own)
            if n:
                runs = (" ".join(surfaces[i : i + n]) for i in starts.get(own[0], ()) if lemmas[i : i + n] == own)
                if other := next((s for s in runs if s != r["folded"]), None):
                    yield r, "lemma", other, 1
            if n == 1:
                at = [i for i in by_stem.get(X.stem(own[0]), ()) if lemmas[i] != own[0]]
                if at:
                    yield r, "root", surfaces[min(at)], 2
        for term, candidate in self.fuzzy(surfaces) if self.fuzzy else ():
            yield self.rows[term.order], "fuzzy", candidate, 3


def _matched(df: DataFrame, cut: Cut, rows: dict[str, list[dict]], provider: LemmaProvider, fuzzy: bool = True) -> DataFrame:
    """Adds ``compact``, ``folded`` and ``matches``, the best of each rule."""

    def run(texts: pd.Series, folded: pd.Series, section: pd.Series) -> pd.Series:
        searches: dict[str, Callable] = {s: _Search(r, fuzzy) for s, r in rows.items()}
        return pd.Series(
            [
                [
                    {"rule": r["rule"], "minus_score": -r[kind], "minus_term": -r["order"], "detector": detector, "kind": r["kind"] if kind == "exact" else kind, "matched": matched, "folded": r["folded"] if kind == "exact" else matched}
                    for r, kind, matched, detector in (searches[s](f, provider.words(t)) if t else ())
                ]
                for t, f, s in zip(texts, folded, section)
            ],
            dtype=object,
        )

    df = df.withColumn(cut.name("compact"), X.compact(cut.text)).withColumn(cut.name("folded"), X.fold_exact(cut.col("compact")))
    udf = F.pandas_udf(T.DataType.fromDDL(f"array<{MATCH}>"))(run)
    found = df.withColumn(cut.name("found"), udf(cut.col("compact"), cut.col("folded"), cut.section))
    return found.withColumn(cut.name("matches"), best_of_each_rule(cut.col("found"))).drop(cut.name("found"))


def linguistic_found(df: DataFrame, cut: Cut, section: str, rules: Sequence[DetectionRule], provider: LemmaProvider, synonyms: Mapping[str, Sequence[str]], whitelist: Sequence[Tolerated] = (), fuzzy: bool = True) -> DataFrame:
    """Adds the findings ``spacy`` of one section in rows of documents."""
    rows = _terms(rules, section, provider, synonyms)
    if not rows:
        return df.withColumn(cut.name("spacy"), cut.none())
    return rule_findings(_matched(df, cut, {section: rows}, provider, fuzzy), cut, rules, whitelist, "spacy", 1, " with spaCy").drop(cut.name("compact"))


def detect_by_lemmas(sections: DataFrame, rules: Sequence[DetectionRule], names: Sequence[str], provider: LemmaProvider, synonyms: Mapping[str, Sequence[str]], whitelist: Sequence[Tolerated] = (), fuzzy: bool = True) -> DataFrame:
    """Findings of the linguistic branch in rows of sections: one at most for each section and rule."""
    rows = {s: found for s in names if (found := _terms(rules, s, provider, synonyms))}
    base = sections.where(F.col("section").isin(list(rows))) if rows else sections.where(F.lit(False))
    return finding_rows(rule_findings(_matched(base, a_section(), rows, provider, fuzzy), a_section(), rules, whitelist, "spacy", 1, " with spaCy"), "spacy")
