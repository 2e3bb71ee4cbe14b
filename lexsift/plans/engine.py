"""An analysis as one plan: documents, sections, branches of detection, findings."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config, defaults
from ..config import DetectionRule, Section, Tolerated
from ..functions import text as X
from ..operators import report
from ..operators.dictionary import detect_by_dictionary, dictionary_found
from ..operators.entities import EntityProvider, ModelEntities, clean_labels, entities_found
from ..operators.findings import FOUND, ORDER_COLUMNS, finding_rows
from ..operators.identifiers import Pattern, identifiers_found, searched
from ..operators.linguistic import LemmaProvider, ModelLemmas, linguistic_found
from ..operators.sections import effective, with_cuts, with_sections
from ..sources import scans, sinks


@dataclass(frozen=True)
class Options:
    """What an analysis runs with; None stands for the defaults."""

    branches: tuple[str, ...] = ("generic",)
    spacy_model: str = "fr_core_news_md"
    spacy_synonyms_path: str | None = None
    gliner_model: str = "models/gliner_multi-v2.1"
    gliner_cache_dir: str | None = "models/cache"
    gliner_source_model: str | None = "urchade/gliner_multi-v2.1"
    gliner_labels: tuple[str, ...] | None = None
    gliner_threshold: float = defaults.ENTITY_THRESHOLD
    gliner_local_files_only: bool = False
    lemma_provider: LemmaProvider | None = None
    entity_provider: EntityProvider | None = None
    identifier_patterns: tuple[Pattern, ...] = defaults.IDENTIFIER_PATTERNS
    exact_fold: bool = True
    fuzzy: bool = True


@dataclass
class Analysis:
    """Documents (document_name, source_path, extracted_text, found: their findings in order), and what led to them.  Nothing has run yet.

    Findings stay in their document's row up to the results, so no result needs a join.
    """

    analyzed: DataFrame
    rules: list[DetectionRule]
    sections: list[Section]
    whitelist: list[Tolerated]
    options: Options
    branch_errors: dict[str, str] = field(default_factory=dict)

    @property
    def documents(self) -> DataFrame:
        return self.analyzed.drop("found")

    @property
    def findings(self) -> DataFrame:
        """A row for each finding."""
        return finding_rows(self.analyzed, "found")

    def ordered(self) -> DataFrame:
        """The findings in the order of documents, branches, sections and rules."""
        return self.findings.orderBy("document_name", "source_path", *ORDER_COLUMNS)

    def _known(self) -> dict[str, object]:
        o = self.options
        return {
            "enabled_branches": list(o.branches),
            "spacy_model": o.spacy_model,
            "spacy_synonyms_path": o.spacy_synonyms_path,
            "gliner_model": o.gliner_model,
            "gliner_cache_dir": o.gliner_cache_dir,
            "gliner_source_model": o.gliner_source_model,
            "gliner_labels": list(o.gliner_labels or defaults.ENTITY_LABELS),
            "gliner_threshold": o.gliner_threshold,
            "gliner_local_files_only": o.gliner_local_files_only,
            "branch_errors": self.branch_errors,
            "central_rules_loaded": len(self.rules),
            "generic_rules_loaded": len(self.rules),
            "sections_loaded": len(self.sections),
            "whitelist_terms_loaded": len(self.whitelist),
        }

    def metadata(self) -> DataFrame:
        """(document_name, source_path, metadata) of every document."""
        return report.document_metadata(self.analyzed, self._known())

    def flat(self) -> DataFrame:
        """One row for each finding, and one of nulls for a document without any."""
        return report.flat_findings(self.analyzed)

    def nested(self) -> DataFrame:
        """One row for each document, with its sections, findings and metadata."""
        return report.nested_analyses(self.analyzed, self._known(), self.sections)

    def summary(self) -> DataFrame:
        """document_count, documents_with_findings, total_findings, and finding_codes as a map."""
        return report.corpus_summary(self.analyzed)


def _usable(provider: object) -> str | None:
    """The reason why a provider can't run, found out on the driver before planning."""
    try:
        check = getattr(provider, "check", None)
        if check:
            check()
    except RuntimeError as e:
        return str(e)
    return None


def analyze(
    documents: DataFrame,
    rules: Sequence[DetectionRule] | None = None,
    sections: Sequence[Section] | None = None,
    whitelist: Sequence[Tolerated] | None = None,
    enabled_branches: Iterable[str] | None = None,
    **options: object,
) -> Analysis:
    """Plans the analysis of documents (document_name, source_path, extracted_text).

    A branch whose model is missing is left out and named in ``branch_errors``; the others run.
    An empty list of sections stands for the defaults, an empty list of rules or tolerated
    expressions for none.
    """
    rules = list(config.load_rules() if rules is None else rules)
    sections = list(sections or config.load_sections())
    whitelist = list(config.load_whitelist() if whitelist is None else whitelist)
    o = Options(branches=config.resolve_branches(enabled_branches), **options)
    documents = documents.select("document_name", "source_path", F.coalesce("extracted_text", F.lit("")).alias("extracted_text"))
    wanted, errors = set(o.branches), {}
    lemmas, entities = o.lemma_provider or ModelLemmas(o.spacy_model), o.entity_provider or ModelEntities(o.gliner_model, o.gliner_cache_dir, o.gliner_source_model, o.gliner_local_files_only)
    for branch, provider in (("spacy", lemmas), ("gliner", entities)):
        if branch in wanted and (branch == "spacy" or clean_labels(o.gliner_labels)) and (why := _usable(provider)):
            errors[branch] = why
    synonyms = config.load_synonyms(o.spacy_synonyms_path) if "spacy" in wanted - set(errors) else {}
    names = [s.section_id for s in effective(sections)]
    rows, cuts = with_cuts(documents, sections)
    found: list[str] = []
    for branch in ("generic", "spacy", "gliner", "regex"):  # the order of a document's findings
        for section, cut in cuts if branch in wanted - set(errors) else ():
            if branch == "generic":
                rows = dictionary_found(rows, cut, section, rules, whitelist, o.fuzzy, o.exact_fold)
            elif branch == "spacy":
                rows = linguistic_found(rows, cut, section, rules, lemmas, synonyms, whitelist, o.fuzzy)
            elif branch == "gliner":
                rows = entities_found(rows, cut, entities, o.gliner_labels, o.gliner_threshold)
            elif searched(section, names):
                rows = identifiers_found(rows, cut, o.identifier_patterns)
            else:
                continue
            found.append(cut.name(branch))
    every = F.concat(*found) if found else F.array()
    return Analysis(rows.select("document_name", "source_path", "extracted_text", every.cast(f"array<{FOUND}>").alias("found")), rules, sections, whitelist, o, errors)


def _loaded(generic_rules_path: str | None, sections_path: str | None, whitelist_path: str | None) -> dict:
    return {"rules": config.load_rules(generic_rules_path), "sections": config.load_sections(sections_path), "whitelist": config.load_whitelist(whitelist_path)}


def analyze_text(document_name: str, source_path: str, extracted_text: str, generic_rules=None, section_definitions=None, whitelist_terms=None, enabled_branches=None, **options) -> Analysis:
    """Plans the analysis of one text."""
    one = config.session().createDataFrame([(document_name, source_path, extracted_text)], "document_name string, source_path string, extracted_text string")
    return analyze(one, generic_rules, section_definitions, whitelist_terms, enabled_branches, **options)


def analyze_file(path: str, generic_rules=None, section_definitions=None, whitelist_terms=None, generic_rules_path=None, sections_path=None, whitelist_path=None, enabled_branches=None, extractor: scans.Extractor | None = None, **options) -> Analysis:
    """Plans the analysis of one PDF file."""
    rules = config.load_rules(generic_rules_path) if generic_rules is None else generic_rules
    sections = config.load_sections(sections_path) if section_definitions is None else section_definitions
    whitelist = config.load_whitelist(whitelist_path) if whitelist_terms is None else whitelist_terms
    return analyze(scans.pdf_documents(path, extractor), rules, sections, whitelist, enabled_branches, **options)


def analyze_directory(input_dir: str, output_path: str | None = None, generic_rules_path=None, sections_path=None, whitelist_path=None, enabled_branches=None, extractor: scans.Extractor | None = None, **options) -> Analysis:
    """Plans the analysis of all PDF files right inside a directory; with ``output_path``, runs it and stores the results as one JSON file."""
    found = analyze(scans.pdf_documents(input_dir, extractor), enabled_branches=enabled_branches, **_loaded(generic_rules_path, sections_path, whitelist_path), **options)
    if output_path is not None:
        sinks.save_results(found, output_path)
    return found


def run_detector(cases: DataFrame, rules: Sequence[DetectionRule], sections: Sequence[Section], whitelist: Sequence[Tolerated], exact_fold: bool = True) -> DataFrame:
    """Findings of test cases (case_id, control_family, section_id, text), each family in its own way.

    ``generic``: general rules on the text as the named section, nothing tolerated;
    ``article9``: the rules of that scope, with the whitelist; ``full_text``: the whole
    analysis.  Other families raise ValueError.
    """
    known = F.coalesce(F.col("control_family").isin("generic", "article9", "full_text"), F.lit(False))
    odd = cases.where(~known).select("control_family").limit(5).collect()
    if odd:
        raise ValueError(f"unknown control families: {sorted({str(r[0]) for r in odd})}")
    docs = cases.select(F.col("case_id").alias("document_name"), F.lit("cases").alias("source_path"), F.coalesce("text", F.lit("")).alias("extracted_text"), "control_family", F.coalesce(F.nullif("section_id", F.lit("")), F.lit("document")).alias("section"))
    names = sorted({s for r in rules for s in r.section_scope} | {s.section_id for s in sections})
    names = [n for n in names if n != "*"]
    direct = docs.withColumn("section_ord", F.lit(0)).withColumn("section_text", F.col("extracted_text"))
    parts = []
    for family, article9 in (("generic", False), ("article9", True)):
        own = [r for r in rules if (r.rule_scope == "article9") == article9]
        parts.append(detect_by_dictionary(direct.where(F.col("control_family") == family), own, names, whitelist if article9 else (), exact_fold=exact_fold))
    full = docs.where("control_family = 'full_text'").drop("section")
    parts.append(detect_by_dictionary(with_sections(full, sections), rules, [s.section_id for s in effective(sections)], whitelist, exact_fold=exact_fold))
    return functools.reduce(DataFrame.unionByName, parts)
