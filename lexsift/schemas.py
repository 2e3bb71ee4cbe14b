"""Schemas of the fact and result tables."""

from pyspark.sql import types as T

#: A finding, in the order in which it is stored.
FINDING_FIELDS = [
    *((n, "string") for n in ("code", "severity", "section", "title", "detail", "evidence", "matched_term", "alert_level", "category")),
    *((n, "double") for n in ("score", "branch_score", "generic_score", "spacy_score", "gliner_score", "regex_score")),
    *((n, "string") for n in ("detection_type", "detection_engine", "rule_id", "rule_scope", "regulatory_family")),
]
FINDING = T.StructType([T.StructField(n, T.DoubleType() if k == "double" else T.StringType()) for n, k in FINDING_FIELDS])

#: Columns of the flat table of findings, one row for a document without any.
FLAT_COLUMNS = [
    "document_name", "source_path", "code", "severity", "alert_level", "section", "title", "detail", "evidence", "matched_term", "category",
    "score", "branch_score", "generic_score", "spacy_score", "gliner_score", "regex_score",
    "detection_type", "detection_engine", "rule_id", "rule_scope", "regulatory_family", "finding_count",
]

_ENGINES = ("generic", "spacy", "gliner", "regex")


#: What is kept about the analysis of a document.
METADATA_FIELDS = [
    ("finding_count", "bigint"),
    ("has_findings", "boolean"),
    ("enabled_branches", "array<string>"),
    *((n, "string") for n in ("spacy_model", "spacy_synonyms_path", "gliner_model", "gliner_cache_dir", "gliner_source_model")),
    ("gliner_labels", "array<string>"),
    ("gliner_threshold", "double"),
    ("gliner_local_files_only", "boolean"),
    ("branch_errors", "map<string,string>"),
    *((f"{e}_finding_count", "bigint") for e in _ENGINES),
    *((f"{e}_max_score", "double") for e in _ENGINES),
    *((f"{n}_loaded", "bigint") for n in ("central_rules", "generic_rules", "sections", "whitelist_terms")),
]


def analysis_ddl() -> str:
    """One document's analysis as it is stored in JSON."""
    finding, metadata = (", ".join(f"{n}: {k}" for n, k in fields) for fields in (FINDING_FIELDS, METADATA_FIELDS))
    return f"document_name string, source_path string, extracted_text string, sections map<string,string>, findings array<struct<{finding}>>, metadata struct<{metadata}>"
