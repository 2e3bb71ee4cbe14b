"""Spark-first compliance analytics over text documents."""

from .config import load_rules as load_generic_detection_rules
from .config import load_sections as load_section_definitions
from .config import load_synonyms as load_synonym_map
from .config import load_whitelist as load_whitelist_terms
from .operators.report import summary as summarize_results
from .plans.engine import analyze, analyze_directory, analyze_file, analyze_text
from .sources.scans import findings_of as findings_to_records
from .sources.scans import load_results
from .sources.sinks import save_results


def results_to_dataframe(analysis):
    """The flat table of an analysis as a pandas frame."""
    return analysis.flat().toPandas()


__all__ = [
    "analyze", "analyze_directory", "analyze_file", "analyze_text", "findings_to_records", "load_generic_detection_rules", "load_results",
    "load_section_definitions", "load_synonym_map", "load_whitelist_terms", "results_to_dataframe", "save_results", "summarize_results",
]
