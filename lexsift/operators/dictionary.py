"""The dictionary branch: exact terms, synonyms, common roots and fuzzy matches of rules in sections.

Everything happens inside a row: the terms of a section's rules enter the plan as a
literal, so there is no join, and no shuffle up to the findings.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import defaults
from ..config import DetectionRule, Tolerated
from ..functions import text as X
from .findings import MATCH, Cut, a_section, best_of_each_rule, finding_rows, rule_findings
from .similarity import FuzzySearch, FuzzyTerm

_TERM = "struct<rule:int,order:int,synonym:boolean,term:string,folded:string,word:string,stem:string,exact:double,root:double>"


def scoped(rules: Sequence[DetectionRule], section: str) -> list[tuple[int, DetectionRule]]:
    """The rules of a section with their places in the list."""
    return [(i, r) for i, r in enumerate(rules) if section in r.section_scope or "*" in r.section_scope]


def term_rows(rules: Sequence[DetectionRule], section: str) -> list[dict]:
    """A row for each term and synonym of a section's rules, with the scores that its matches would have."""
    mods, rows = defaults.DICTIONARY_MODIFIERS, []
    for place, rule in scoped(rules, section):
        for order, term in enumerate(rule.all_terms):
            synonym = order >= len(rule.terms)
            words = X.tokenize(term)
            single = words[0] if len(words) == 1 and not synonym else None
            root = X.stem(single) if single else None
            rows.append({
                "rule": place, "order": order, "synonym": synonym, "term": term, "folded": X.fold_text(term), "word": single,
                "stem": root if root and len(root) >= defaults.ROOT_LENGTH else None, "size": len(words), "threshold": rule.fuzzy_threshold,
                "exact": X.score(rule.base_score, mods["synonym" if synonym else "exact"]), "root": X.score(rule.base_score, mods["root"]), "fuzzy": X.score(rule.base_score, mods["fuzzy"]),
            })
    return rows


def _literal(rows: dict[str, list[dict]], section: Column) -> Column:
    fields = [f.split(":")[0] for f in _TERM[7:-1].split(",")]
    cut = {s: [{k: r[k] for k in fields} for r in rs] for s, rs in rows.items()}
    every = F.from_json(F.lit(json.dumps(cut)), f"map<string,array<{_TERM}>>")
    return F.coalesce(F.element_at(every, section), F.array().cast(f"array<{_TERM}>"))


def _match(t: Column, score: str, detector: int, kind: Column, matched: Column, folded: Column) -> Column:
    return F.struct(t["rule"].alias("rule"), (-t[score]).alias("minus_score"), (-t["order"]).alias("minus_term"), F.lit(detector).alias("detector"), kind.alias("kind"), matched.alias("matched"), folded.alias("folded")).cast(MATCH)


def exact_matches(terms: Column, folded: Column) -> Column:
    hits = F.filter(terms, lambda t: X.has_word(folded, t["folded"]))
    return F.transform(hits, lambda t: _match(t, "exact", 0, F.when(t["synonym"], "synonym").otherwise("exact"), t["term"], t["folded"]))


def root_matches(terms: Column, words: Column, stems: Column, common: Column) -> Column:
    """For each term of one word the first other word with its root; ``common``: the stems that text and terms share."""
    pairs = F.arrays_zip(words.alias("w"), stems.alias("s"))
    near = F.filter(terms, lambda t: t["stem"].isNotNull() & F.array_contains(common, t["stem"]))
    first = F.transform(near, lambda t: F.struct(t.alias("t"), F.get(F.filter(pairs, lambda p: (p["s"] == t["stem"]) & (p["w"] != t["word"])), F.lit(0))["w"].alias("w")))
    return F.transform(F.filter(first, lambda x: x["w"].isNotNull()), lambda x: _match(x["t"], "root", 1, F.lit("root"), x["w"], x["w"]))


def fuzzy_function(rows: dict[str, list[dict]], split: Callable[[str], list[str]] = X.folded_words) -> Callable[[Column, Column], Column]:
    """An Arrow function (folded text, section) -> fuzzy matches."""
    terms = {s: [FuzzyTerm(r["rule"], r["order"], r["folded"], r["size"], r["threshold"], -r["fuzzy"]) for r in rs] for s, rs in rows.items()}

    def run(texts: pd.Series, sections: pd.Series) -> pd.Series:
        searches = {s: FuzzySearch(ts) for s, ts in terms.items()}
        out = []
        for text, section in zip(texts, sections):
            search = searches.get(section)
            found = search(split(text)) if search and text else []
            out.append([{"rule": t.rule, "minus_score": t.minus_score, "minus_term": -t.order, "detector": 2, "kind": "fuzzy", "matched": c, "folded": c} for t, c in found])
        return pd.Series(out, dtype=object)

    return F.pandas_udf(T.DataType.fromDDL(f"array<{MATCH}>"))(run)


def _matched(df: DataFrame, cut: Cut, rows: dict[str, list[dict]], fuzzy: bool, exact_fold: bool) -> DataFrame:
    """Adds ``compact``, ``folded`` and ``matches``, the best of each rule."""
    fold = X.fold_exact if exact_fold else X.fold
    c, n = cut.col, cut.name
    df = df.withColumn(n("compact"), X.compact(cut.text))
    df = df.withColumn(n("folded"), fold(c("compact"))).withColumn(n("words"), X.tokens(c("folded")))
    roots = sorted({r["stem"] for rs in rows.values() for r in rs if r["stem"]})
    df = df.withColumn(n("stems"), X.stems(c("words")))
    df = df.withColumn(n("common"), F.array_intersect(c("stems"), F.array(*map(F.lit, roots)).cast("array<string>"))).withColumn(n("terms"), _literal(rows, cut.section))
    parts = [exact_matches(c("terms"), c("folded")), F.when(F.size(c("common")) > 0, root_matches(c("terms"), c("words"), c("stems"), c("common"))).otherwise(F.array().cast(f"array<{MATCH}>"))]
    if fuzzy:
        parts.append(fuzzy_function(rows)(c("folded"), cut.section).cast(f"array<{MATCH}>"))
    return df.withColumn(n("all"), F.concat(*parts)).withColumn(n("matches"), best_of_each_rule(c("all"))).drop(*map(n, ("all", "terms", "stems", "common", "words")))


def _rows(rules: Sequence[DetectionRule], names: Sequence[str]) -> dict[str, list[dict]]:
    return {s: found for s in names if (found := term_rows(rules, s))}


def dictionary_matches(sections: DataFrame, rules: Sequence[DetectionRule], names: Sequence[str], fuzzy: bool = True, exact_fold: bool = True) -> DataFrame:
    """Rows (..., section, section_text) of sections with rules, with ``compact``, ``folded`` and ``matches``: the best of each rule."""
    rows = _rows(rules, names)
    base = sections.where(F.col("section").isin(list(rows))) if rows else sections.where(F.lit(False))
    return _matched(base, a_section(), rows, fuzzy, exact_fold)


def dictionary_found(df: DataFrame, cut: Cut, section: str, rules: Sequence[DetectionRule], whitelist: Sequence[Tolerated] = (), fuzzy: bool = True, exact_fold: bool = True) -> DataFrame:
    """Adds the findings ``generic`` of one section in rows of documents."""
    rows = _rows(rules, [section])
    if not rows:
        return df.withColumn(cut.name("generic"), cut.none())
    return rule_findings(_matched(df, cut, rows, fuzzy, exact_fold), cut, rules, whitelist, "generic", 0).drop(cut.name("compact"))


def detect_by_dictionary(sections: DataFrame, rules: Sequence[DetectionRule], names: Sequence[str], whitelist: Sequence[Tolerated] = (), fuzzy: bool = True, exact_fold: bool = True) -> DataFrame:
    """Findings of the dictionary branch in rows of sections: one at most for each section and rule."""
    return finding_rows(rule_findings(dictionary_matches(sections, rules, names, fuzzy, exact_fold), a_section(), rules, whitelist, "generic", 0), "generic")
