"""Queries over configuration, stored results, and the branches that search by lemma and by similarity."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config, defaults
from ..operators import dictionary, evaluate, linguistic, report, sections
from ..operators.entities import detect_entities
from ..sources import scans, sinks
from .corpus_rules import RULES, SECTIONS, WHITELIST, _rule
from .queries import (
    _SQL_CASES, _SQL_COMPACT, _SQL_FLAT, _SQL_FOLD, _SQL_ROWS, _SQL_STEM, _SQL_TOKENS, _FLAT_COLUMNS, _analysis, _branch_rows, _documents, _Numbers, _results, _sql_csv, _sql_rules, _table, _turns, _values, query,
)

# Similarity ---------------------------------------------------------------------------------------------------

_TERMS = [(i, k, k >= len(r.terms), t, len(t.split()), r.fuzzy_threshold) for i, r in enumerate(RULES) for k, t in enumerate(r.all_terms)]
#: The ratio of pairs (term, candidate): twice the characters of matching blocks, found longest first and earliest of equals, over both lengths.
_SQL_RATIO = """
blocks(term, candidate, a, b, k) AS (
  SELECT term, candidate, term, candidate, 0::BIGINT FROM pairs
  UNION ALL
  SELECT term, candidate, x.a, x.b, x.k FROM (
    SELECT term, candidate, unnest([{'a': substr(a, 1, -best.i), 'b': substr(b, 1, -best.j), 'k': best.k}, {'a': substr(a, 1 - best.i + best.k), 'b': substr(b, 1 - best.j + best.k), 'k': 0::BIGINT}]) AS x FROM (
      SELECT term, candidate, a, b, list_max(flatten(list_transform(range(len(a)), lambda i: list_transform(range(len(b)), lambda j:
        {'k': coalesce(list_max(list_filter(range(1, least(len(a) - i, len(b) - j) + 1), lambda n: substr(a, i + 1, n) = substr(b, j + 1, n))), 0), 'i': -i, 'j': -j})))) AS best
      FROM blocks WHERE a <> '' AND b <> '') WHERE best.k > 0)),
ratios AS (SELECT term, candidate, 2 * sum(k) / (len(term) + len(candidate))::DOUBLE AS ratio FROM blocks GROUP BY term, candidate)"""
_SQL_SHARED = "len(list_filter(string_split({0}, ''), lambda c: contains({1}, c)))"


@query(f"""
WITH RECURSIVE w AS (SELECT DISTINCT unnest({_SQL_TOKENS.format(_SQL_FOLD.format('text'))}) AS candidate FROM documents WHERE doc_id % 50 = 7),
pairs AS (SELECT term, candidate FROM (VALUES ('thinges'), ('antionment'), ('password')) AS t(term) CROSS JOIN w WHERE len(candidate) < 12),{_SQL_RATIO}
SELECT term, candidate, round(ratio, 9) AS ratio FROM ratios""")
def similarity_ratios(spark, sf_dir):
    """The similarity of three terms to the words of a few documents (a fixture: the table has far more words than the ratio needs for a proof)."""
    from ..functions import text as X

    words = _table(spark, sf_dir, "documents").where("doc_id % 50 = 7").select(F.explode(X.tokens(X.fold(F.col("text")))).alias("candidate")).distinct().where(F.length("candidate") < 12)
    terms = F.explode(F.array(*map(F.lit, ("thinges", "antionment", "password"))))
    return words.select(terms.alias("term"), "candidate").select("term", "candidate", F.round(X.ratio(F.col("term"), F.col("candidate")), 9).alias("ratio"))


def _sql_fuzzy() -> str:
    """All CTEs of the dictionary branch with the fuzzy search among the ways of detection."""
    base = _sql_rules().replace("SELECT * FROM hits UNION ALL SELECT * FROM roots", "SELECT * FROM hits UNION ALL SELECT * FROM roots UNION ALL SELECT * FROM fuzzies")
    head, ranked = base.split("ranked AS (", 1)
    return f"""{head}
lists AS (SELECT document_name, {_SQL_TOKENS.format('folded')} AS t FROM docs),
runs AS (SELECT document_name, n, pos, array_to_string(t[pos + 1:pos + n], ' ') AS candidate FROM (SELECT document_name, t, n, unnest(range(len(t) - n + 1)) AS pos FROM lists, (VALUES (1), (2), (3), (4)) AS s(n))),
wanted AS (SELECT * FROM {_values(_TERMS, 'rule, term_ord, is_synonym, term, n, threshold')}),
pairs AS (
  SELECT DISTINCT term, candidate FROM (SELECT DISTINCT n, candidate FROM runs) JOIN wanted USING (n)
  WHERE candidate <> term AND 2 * least(len(term), len(candidate)) >= threshold * (len(term) + len(candidate))
    AND 2 * least({_SQL_SHARED.format('term', 'candidate')}, {_SQL_SHARED.format('candidate', 'term')}) >= threshold * (len(term) + len(candidate))),{_SQL_RATIO},
near AS (SELECT * FROM ratios JOIN wanted USING (term) WHERE ratio >= threshold),
fuzzies AS (
  SELECT document_name, rule, term_ord, 'fuzzy' AS kind, 2 AS detector, arg_max(candidate, (ratio, -pos)) AS matched, round(max(base) - 0.15, 2) AS score
  FROM runs JOIN near USING (n, candidate) JOIN rules USING (rule) GROUP BY document_name, rule, term_ord),
ranked AS ({ranked}"""


@query(f"WITH RECURSIVE {_sql_fuzzy()} SELECT document_name, rule_id, matched AS matched_term, score FROM kept WHERE kind = 'fuzzy'")
def fuzzy_findings(spark, sf_dir):
    cut = sections.with_sections(_documents(spark, sf_dir), SECTIONS)
    found = dictionary.detect_by_dictionary(cut, RULES, ["document"], WHITELIST, fuzzy=True, exact_fold=False)
    return found.where("detection_type = 'fuzzy'").select("document_name", "rule_id", "matched_term", "score")


# The linguistic branch ----------------------------------------------------------------------------------------

#: Rules with terms of several words that meet by their lemmas.
LEMMA_RULES = [*RULES, _rule("RELEASE", "general", "provenance", "license", "Release of a work", "release under the|apache licence|ingble", "", "alerte", "low", 0.7, 0.9)]
LEMMAS = {"released": "release", "idiots": "idiot", "license": "licence", "thanble": "ingble", "thing": "thinges", "ingbles": "ingbly"}
SYNONYMS = {"idiot": ("fool", "clown"), "ingble": ("thanthe", "stupid")}
_LEMMA_TERMS = [
    (i, k, k >= len(r.terms), t, "|".join(LEMMAS.get(w, w) for w in t.split()), r.base_score)
    for i, r in enumerate(LEMMA_RULES) for k, t in enumerate([*r.terms, *(s for x in r.terms for s in SYNONYMS.get(x, ()) if s not in r.terms)])
]


@query(f"""
WITH rules AS (SELECT * FROM {_values([(i, r.rule_id, r.applies_whitelist) for i, r in enumerate(LEMMA_RULES)], 'rule, rule_id, applies')}),
terms AS (SELECT *, string_split(lemmas, '|') AS own, round(base - CASE WHEN is_synonym THEN 0.04 ELSE 0 END, 2) AS lower FROM {_values(_LEMMA_TERMS, 'rule, term_ord, is_synonym, term, lemmas, base')}),
forms AS (SELECT MAP {{{', '.join(f"'{k}': '{v}'" for k, v in LEMMAS.items())}}} AS m),
docs AS (SELECT doc_id::VARCHAR AS document_name, {_SQL_FOLD.format('text')} AS folded FROM documents),
lists AS MATERIALIZED (SELECT document_name, folded, w, list_transform(w, lambda x: coalesce(m[x], x)) AS l FROM (SELECT document_name, folded, {_SQL_TOKENS.format('folded')} AS w, m FROM docs, forms)),
words AS MATERIALIZED (SELECT *, {_SQL_STEM.format('lemma')} AS stem FROM (SELECT document_name, unnest(w) AS word, unnest(l) AS lemma, unnest(range(1, len(w) + 1)) AS pos FROM lists)),
runs AS (SELECT document_name, rule, term_ord, term, lower, pos, array_to_string(w[pos:pos + len(own) - 1], ' ') AS run FROM words JOIN terms ON lemma = own[1] JOIN lists USING (document_name) WHERE l[pos:pos + len(own) - 1] = own),
hits AS (
  SELECT document_name, rule, term_ord, CASE WHEN is_synonym THEN 'synonym' ELSE 'exact' END AS kind, 0 AS detector, term AS matched, lower AS score FROM (SELECT * FROM docs JOIN terms ON contains(folded, term))
  WHERE regexp_matches(folded, '(^|[^\\pL\\pN_])' || term || '($|[^\\pL\\pN_])')
  UNION ALL SELECT document_name, rule, term_ord, 'lemma', 1, arg_min(run, pos), round(max(lower) - 0.07, 2) FROM runs WHERE run <> term GROUP BY document_name, rule, term_ord
  UNION ALL
  SELECT document_name, rule, term_ord, 'root', 2, arg_min(word, pos), round(max(lower) - 0.10, 2) FROM words JOIN (SELECT *, {_SQL_STEM.format('own[1]')} AS stem FROM terms WHERE len(own) = 1) USING (stem)
  WHERE lemma <> own[1] AND len(stem) >= 5 GROUP BY document_name, rule, term_ord),
best AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY document_name, rule ORDER BY score DESC, term_ord DESC, detector) = 1),
whitelist AS (SELECT * FROM {_values([(w.expression,) for w in WHITELIST], 'expression')})
SELECT b.document_name, rule_id, kind AS detection_type, matched AS matched_term, score AS spacy_score, 'Rule ''' || rule_id || ''' detected ''' || matched || ''' as ' || kind || ' with spaCy.' AS detail
FROM best b JOIN rules USING (rule) JOIN docs d USING (document_name)
WHERE NOT (applies AND EXISTS (SELECT 1 FROM whitelist WHERE contains(d.folded, expression) AND (contains(expression, b.matched) OR contains(b.matched, expression))))""")
def lemma_findings(spark, sf_dir):
    """The linguistic branch with a table of lemmas, without its fuzzy search."""
    cut = sections.with_sections(_documents(spark, sf_dir), SECTIONS)
    found = linguistic.detect_by_lemmas(cut, LEMMA_RULES, ["document"], linguistic.TableLemmas(LEMMAS), SYNONYMS, WHITELIST, fuzzy=False)
    return found.select("document_name", "rule_id", "detection_type", "matched_term", "spacy_score", "detail")


# Reports ------------------------------------------------------------------------------------------------------

@query(f"WITH {_SQL_ROWS} SELECT control_family, category, detection_type, count(*) AS count, round(avg(branch_score), 9) AS avg_score, min(branch_score) AS min_score, max(branch_score) AS max_score FROM per_engine WHERE detection_count > 0 GROUP BY ALL")
def family_profile(spark, sf_dir):
    rows = report.score_profile(_branch_rows(spark, sf_dir).where("detection_count > 0"), "control_family", "category", "detection_type", score="branch_score")
    return rows.withColumn("avg_score", F.round("avg_score", 9))


@query(r"""
WITH c AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS x FROM documents),
m AS (SELECT doc_id, unnest(regexp_extract_all(x, '[0-9]{8,}')) AS m FROM c)
SELECT 'gliner' AS detection_engine, 'long number' AS predicted_label, 'document' AS section, count(*) AS count, 0.9::DOUBLE AS avg_score, 0.9::DOUBLE AS min_score, 0.9::DOUBLE AS max_score FROM m HAVING count(*) > 0
UNION ALL SELECT 'gliner', NULL, NULL, 0, NULL, NULL, NULL WHERE EXISTS (SELECT 1 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM m))""")
def label_profile(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    found = detect_entities(sections.with_sections(docs, SECTIONS), _Numbers(), ["long number"])
    rows = report.case_rows(docs.select(F.col("document_name").alias("case_id")), found, "gliner")
    return report.label_profile(rows).withColumn("avg_score", F.round("avg_score", 9))


@query(f"""
SELECT (SELECT count(*) FROM {_sql_csv(defaults.RULES_CSV)}) AS rules, (SELECT count(*) FROM {_sql_csv(defaults.RULES_CSV)} WHERE c[2] <> 'article9') AS general_rules, (SELECT count(*) FROM {_sql_csv(defaults.RULES_CSV)} WHERE c[2] = 'article9') AS article9_rules,
       (SELECT count(*) FROM {_sql_csv(defaults.SECTIONS_CSV)}) AS sections, (SELECT count(*) FROM {_sql_csv(defaults.WHITELIST_CSV)}) AS whitelist, (SELECT count(*) FROM {_sql_csv(defaults.SYNONYMS_CSV)}) AS synonyms""")
def referential_counts(spark, sf_dir):
    counts = report.dictionary_counts(config.load_rules(), sections=len(config.load_sections()), whitelist=len(config.load_whitelist()), synonyms=len(config.load_synonyms()))
    return spark.createDataFrame([tuple(counts.values())], ", ".join(f"{k} long" for k in counts))


@query(f"""
SELECT c[1] AS rule_id, c[2] AS rule_scope, c[3] AS regulatory_family, replace(lower(c[4]), '|', ' | ') AS section_scope, c[5] AS category, c[6] AS label, replace(lower(c[7]), '|', ' | ') AS terms, replace(lower(c[8]), '|', ' | ') AS synonyms,
       c[9] AS alert_level, c[10] AS severity, c[11]::DOUBLE AS base_score, c[12]::DOUBLE AS fuzzy_threshold, c[13]::BOOLEAN AS applies_whitelist FROM {_sql_csv(defaults.RULES_CSV)}""")
def rule_display(spark, sf_dir):
    rows = report.rule_display(config.load_rules())
    return spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'double' if isinstance(v, float) else 'string'}" for k, v in rows[0].items()))


@query(f"WITH {_SQL_CASES} SELECT case_id, control_family, missing_keys FROM rated WHERE NOT detected")
def eval_missed(spark, sf_dir):
    return evaluate.missed(_results(spark, sf_dir)).select("case_id", "control_family", "missing_keys")


@query(f"WITH {_SQL_CASES} SELECT case_id, control_family, alert_outcome, missing_keys, unexpected_keys FROM rated WHERE NOT case_ok")
def eval_failed(spark, sf_dir):
    return evaluate.failed(_results(spark, sf_dir)).select("case_id", "control_family", "alert_outcome", "missing_keys", "unexpected_keys")


@query("SELECT doc_id::VARCHAR AS document_name, 'spacy' AS branch, true AS told FROM documents UNION ALL SELECT doc_id::VARCHAR, 'gliner', true FROM documents")
def branch_errors(spark, sf_dir):
    """Documents for which a branch could not run: here two branches whose providers say so."""
    from .engine import analyze

    a = analyze(_documents(spark, sf_dir), RULES, SECTIONS, WHITELIST, ("spacy", "gliner", "regex"), lemma_provider=_Missing(), entity_provider=_Missing())
    errors = report.with_errors(a.metadata()).select("document_name", F.explode("metadata.branch_errors").alias("branch", "why"))
    return errors.select("document_name", "branch", (F.col("why") == "not here").alias("told"))


class _Missing:
    """A provider without its model."""

    def check(self) -> None:
        raise RuntimeError("not here")


_SQL_PLACED = "row_number() OVER (ORDER BY case_id, detection_engine, branch_score DESC NULLS LAST, predicted_key NULLS FIRST, matched_term NULLS FIRST, detection_type NULLS FIRST)"


@query(f"WITH {_SQL_ROWS} SELECT {_SQL_PLACED} AS place, case_id, detection_engine, branch_score, predicted_key FROM per_engine")
def case_order(spark, sf_dir):
    """Rows of cases in the order of (case, engine, score), with their places in it."""
    return report.placed(report.by_case_and_score(_branch_rows(spark, sf_dir))).select("place", "case_id", "detection_engine", "branch_score", "predicted_key")


@query("""
SELECT c_custkey::VARCHAR AS document_name, TRY_CAST(CASE c_custkey % 5 WHEN 0 THEN '0.9' WHEN 1 THEN 'n/a' WHEN 2 THEN '' WHEN 3 THEN '1' END AS DOUBLE) AS score,
       c_custkey % 3 = 0 AS is_article9, c_custkey % 3 = 1 AS is_generic FROM customer""")
def coerced_scores(spark, sf_dir):
    """Scores that are stored as text: what isn't a number is null."""
    k = F.col("c_custkey")
    text = F.when(k % 5 == 0, "0.9").when(k % 5 == 1, "n/a").when(k % 5 == 2, "").when(k % 5 == 3, "1")
    rows = _table(spark, sf_dir, "customer").select(k.cast("string").alias("document_name"), text.alias("score"), F.when(k % 3 == 0, "article9").when(k % 3 == 1, "general").alias("rule_scope"), F.when(k % 3 < 2, "R").alias("rule_id"))
    return report.with_flags(rows).select("document_name", "score", "is_article9", "is_generic")


# Stored results -----------------------------------------------------------------------------------------------

def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that the driver and all executors share; a folder of our own in local mode alone."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="lexsift-")
        spark.sparkContext.setCheckpointDir(named)
    return f"{named.rstrip('/')}/{label}-{uuid.uuid4().hex}"


@query(f"WITH {_SQL_FLAT} SELECT {_FLAT_COLUMNS} FROM flat")
def stored_findings(spark, sf_dir):
    """Analyses written as JSON lines, loaded again, and flattened."""
    path = scratch(spark, "analyses") + ".jsonl"
    sinks.write_json_lines(_analysis(spark, sf_dir).nested(), path)
    return scans.findings_of(scans.load_results(path)).select(*_FLAT_COLUMNS.split(", "))


@query(f"WITH {_SQL_FLAT} SELECT {_FLAT_COLUMNS} FROM flat")
def exported_findings(spark, sf_dir):
    """Findings written as CSV files and read again."""
    path = scratch(spark, "findings")
    flat = _analysis(spark, sf_dir).flat().select(*_FLAT_COLUMNS.split(", "))
    sinks.write_findings(flat, path, "csv")
    return spark.read.schema(flat.schema).option("header", True).option("escape", '"').csv(path)


@query("SELECT conv_id || '-' || turn AS case_id, role AS control_family, text FROM conversations")
def stored_cases(spark, sf_dir):
    """Turns of conversations written as a CSV table of cases, line feeds and quotes in it, and read again."""
    path = scratch(spark, "cases")
    cases = _table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("case_id"), F.col("role").alias("control_family"), "text")
    cases.write.option("header", True).option("escape", '"').csv(path)
    return scans.read_cases(path).select("case_id", "control_family", "text")


@query("SELECT 'part ' || doc_id || '.txt' AS document_name, md5(text) AS digest FROM documents WHERE len(text) > 0 ORDER BY doc_id LIMIT 20")
def text_files(spark, sf_dir):
    """Twenty documents as text files of a folder, scanned (the feature is the scan: files of a folder, each one document)."""
    path = scratch(spark, "texts")
    docs = _table(spark, sf_dir, "documents").where("length(text) > 0").orderBy("doc_id").limit(20).select("doc_id", "text")
    system = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for row in docs.toLocalIterator():
        out = system.create(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/part {row.doc_id}.txt"))
        out.write(bytearray(row.text.encode()))
        out.close()
    return scans.text_documents(path).select("document_name", F.md5("extracted_text").alias("digest"))
