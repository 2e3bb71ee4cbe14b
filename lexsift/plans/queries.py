"""Named queries over the test tables, each with an SQL twin where SQL can express it."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config, defaults
from ..functions import text as X
from ..operators import dictionary, evaluate, linguistic, report, sections
from ..operators.entities import detect_entities
from ..operators.identifiers import detect_identifiers
from ..sources import scans
from . import bench_cases
from .corpus_rules import RULES, SECTIONS, WHITELIST
from .engine import analyze, run_detector

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return scans.spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_name"), F.coalesce("source", F.lit("")).alias("source_path"), F.col("text").alias("extracted_text"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations, each with an address in it, as sections that are named by the role."""
    t = _table(spark, sf_dir, "conversations")
    return t.select(F.concat_ws("/", "conv_id", "turn").alias("document_name"), F.lit("conversations").alias("source_path"), F.lit(0).alias("section_ord"), F.col("role").alias("section"), F.concat("text", F.lit(" write to "), "role", F.lit("."), "turn", F.lit("@mail"), "conv_id", F.lit(".example.org or not")).alias("section_text"))


def _digest(c: Column) -> list[Column]:
    return [F.md5(c).alias("digest"), F.length(c).cast("long").alias("n_chars")]


# Text functions -----------------------------------------------------------------------------------------------

_SQL_COMPACT = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
_SQL_FOLD = r"trim(regexp_replace(lower(strip_accents(replace({0}, 'ß', 'ss'))), '\s+', ' ', 'g'))"


def _sql_digest(expression: str) -> str:
    return f"SELECT doc_id, md5(x) AS digest, len(x)::BIGINT AS n_chars FROM (SELECT doc_id, {expression.format('text')} AS x FROM documents)"


@query(_sql_digest(r"trim(regexp_replace(regexp_replace(replace({0}, chr(13), chr(10)), '[ \t]+', ' ', 'g'), '\n{{2,}}', chr(10), 'g'), ' ' || chr(10))"))
def text_normalized_lines(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", *_digest(X.normalize_lines(F.col("text"))))


@query(_sql_digest(_SQL_COMPACT))
def text_compact(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", *_digest(X.compact(F.col("text"))))


@query(_sql_digest(_SQL_FOLD))
def text_fold(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", *_digest(X.fold(F.col("text"))))


@query(_sql_digest(_SQL_FOLD))
def text_fold_exact(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", X.fold_exact(F.col("text")).alias("x")).select("doc_id", *_digest(F.col("x")))


@query(_sql_digest(f"CASE WHEN len({_SQL_COMPACT}) <= 220 THEN {_SQL_COMPACT} ELSE rtrim(substr({_SQL_COMPACT}, 1, 217)) || '...' END"))
def text_shorten(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", *_digest(X.shorten(F.col("text"))))


_SQL_TOKENS = r"list_filter(list_transform(regexp_extract_all({0}, '[\pL\pN_'']+'), lambda t: trim(t, '''')), lambda t: t <> '')"
_SQL_STEM = r"regexp_replace({0}, '^(.{{5,}}?)(iques|ique|euses|euse|ments|ment|es|s|e)$', '\1')"


@query(f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct FROM (SELECT doc_id, {_SQL_TOKENS.format(_SQL_FOLD.format('text'))} AS t FROM documents)")
def token_counts(spark, sf_dir):
    words = X.tokens(X.fold(F.col("text")))
    d = _table(spark, sf_dir, "documents").select("doc_id", words.alias("t"))
    return d.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


@query(f"""
SELECT {_SQL_STEM.format('t')} AS stem, count(*) AS n, count(DISTINCT t) AS n_forms
FROM (SELECT unnest({_SQL_TOKENS.format(_SQL_FOLD.format('text'))}) AS t FROM documents) GROUP BY 1""")
def stem_counts(spark, sf_dir):
    words = _table(spark, sf_dir, "documents").select(X.tokens(X.fold(F.col("text"))).alias("t"))
    pairs = words.select(F.inline_outer(F.arrays_zip(F.col("t"), X.stems(F.col("t")).alias("stem")))).where("t IS NOT NULL")
    # Distinct forms first: map-side sums over a vocabulary instead of a distinct count over all words.
    forms = pairs.groupBy("stem", "t").agg(F.count("*").alias("n"))
    return forms.groupBy("stem").agg(F.sum("n").alias("n"), F.count("*").alias("n_forms"))


@query(f"""
SELECT g AS ngram, count(*) AS n FROM (
  SELECT unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS g
  FROM (SELECT {_SQL_TOKENS.format(_SQL_FOLD.format('text'))} AS t FROM documents)) GROUP BY 1""")
def ngram_counts(spark, sf_dir):
    words = _table(spark, sf_dir, "documents").select(X.tokens(X.fold(F.col("text"))).alias("t"))
    return words.select(F.explode_outer(X.ngrams(F.col("t"), 2)).alias("ngram")).where("ngram IS NOT NULL").groupBy("ngram").agg(F.count("*").alias("n"))


@query(r"""
SELECT page_id, len(x)::BIGINT AS n_chars, md5(x) AS digest FROM (
  SELECT page_id, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(
    regexp_replace(regexp_replace(regexp_replace(html, '(?is)<head\b.*?</head\s*>|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'g'),
      '(?i)<(?:br|/p|/div|/li|/tr|/h[1-6]|/section)[^>]*>', chr(10), 'g'), '<[^>]*>', ' ', 'g'),
    '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), chr(13), chr(10)), '[ \t]+', ' ', 'g'), '\n{2,}', chr(10), 'g'), ' ' || chr(10)) AS x FROM pages)""")
def page_plain_text(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", X.strip_markup(F.col("html")).alias("x")).select("page_id", F.length("x").cast("long").alias("n_chars"), F.md5("x").alias("digest"))


# Sections and dictionaries ------------------------------------------------------------------------------------

@query(r"""
WITH c AS (SELECT doc_id, trim(regexp_replace('7. BENEFICIAIRES : ' || text || ' - 8. Declarations 9. conseil et recommandation' || text, '\s+', ' ', 'g')) AS x FROM documents),
p AS (SELECT *, strpos(lower(x), '7. beneficiaires') + 16 AS a, strpos(lower(x), '9. conseil et recommandation') + 28 AS b FROM c)
SELECT doc_id::VARCHAR AS document_name, 'beneficiaires' AS section, md5(trim(substr(x, a, strpos(lower(substr(x, a)), '8. declarations') - 1), ' :-')) AS digest FROM p
UNION ALL SELECT doc_id::VARCHAR, 'conseil', md5(trim(substr(x, b), ' :-')) FROM p""")
def section_extract(spark, sf_dir):
    form = F.concat(F.lit("7. BENEFICIAIRES : "), "text", F.lit(" - 8. Declarations 9. conseil et recommandation"), "text")
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_name"), form.alias("extracted_text"))
    found = sections.with_sections(docs, [s for s in config.load_sections() if s.section_id != "document"])
    return found.select("document_name", "section", F.md5("section_text").alias("digest"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _values(rows: list[tuple], names: str) -> str:
    cell = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"{v}::DOUBLE" if isinstance(v, float) else str(v) if isinstance(v, int) else _quoted(v)
    return f"(VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS v({names})"


def _sql_csv(text: str) -> str:
    """The rows of a CSV text without quoted cells, as a table of lists ``c``."""
    return f"(SELECT list_transform(string_split(line, ','), lambda x: trim(x)) AS c FROM (SELECT unnest(string_split({_quoted(text.strip())}, chr(10))[2:]) AS line))"


@query(f"""
WITH r AS (SELECT c[1] AS rule_id, lower(c[4]) AS scope, lower(c[7]) AS terms, lower(c[8]) AS synonyms, c[11]::DOUBLE AS base FROM {_sql_csv(defaults.RULES_CSV)}),
t AS (SELECT rule_id, scope, base, string_split(terms, '|') AS a, CASE WHEN synonyms = '' THEN [] ELSE string_split(synonyms, '|') END AS b FROM r),
e AS (SELECT rule_id, scope, base, a, unnest(list_concat(a, b)) AS term, unnest(range(len(a) + len(b))) AS term_ord FROM t)
SELECT rule_id, unnest(string_split(scope, '|')) AS section, term, term_ord::INTEGER AS term_ord, term_ord >= len(a) AS is_synonym,
       round(base - CASE WHEN term_ord >= len(a) THEN 0.05 ELSE 0 END, 2) AS score FROM e""")
def rules_exploded(spark, sf_dir):
    rules = config.load_rules()
    rows = [(rules[t["rule"]].rule_id, s, t["term"], t["order"], t["synonym"], t["exact"]) for s in ("beneficiaires", "conseil", "document") for t in dictionary.term_rows(rules, s)]
    return spark.createDataFrame(rows, "rule_id string, section string, term string, term_ord int, is_synonym boolean, score double")


@query(f"""
WITH s AS (SELECT lower(c[1]) AS term, string_split(lower(c[2]), '|') AS syn FROM {_sql_csv(defaults.SYNONYMS_CSV)}),
r AS (SELECT c[1] AS rule_id, string_split(lower(c[7]), '|') AS terms FROM {_sql_csv(defaults.RULES_CSV)}),
t AS (SELECT rule_id, terms, unnest(terms) AS term, unnest(range(len(terms))) AS n FROM r),
j AS (SELECT rule_id, terms, n, unnest(syn) AS synonym, unnest(range(len(syn))) AS k FROM t JOIN s USING (term)),
f AS (SELECT *, row_number() OVER (PARTITION BY rule_id, synonym ORDER BY n, k) AS nth FROM j WHERE NOT list_contains(terms, synonym))
SELECT rule_id, synonym, (row_number() OVER (PARTITION BY rule_id ORDER BY n, k) - 1)::INTEGER AS synonym_ord FROM f WHERE nth = 1""")
def synonym_resolution(spark, sf_dir):
    synonyms = config.load_synonyms()
    rows = [(r.rule_id, s, i) for r in config.load_rules() for i, s in enumerate(linguistic.rule_synonyms(r, synonyms))]
    return spark.createDataFrame(rows, "rule_id string, synonym string, synonym_ord int")


# Detection ----------------------------------------------------------------------------------------------------

def _sql_rules() -> str:
    rules = [(i, r.rule_id, r.rule_scope, r.regulatory_family, r.category, r.label, r.alert_level, r.severity, r.base_score, r.applies_whitelist, f"article9_{r.category}" if r.rule_scope == "article9" else r.rule_id) for i, r in enumerate(RULES)]
    terms = [(i, k, k >= len(r.terms), t) for i, r in enumerate(RULES) for k, t in enumerate(r.all_terms)]
    # A constant pattern for each term: the engine compiles it once.
    contained = " UNION ALL ".join(f"SELECT document_name, {i} AS rule, {k} AS term_ord FROM docs WHERE regexp_matches(folded, '(^|[^\\pL\\pN_]){t}($|[^\\pL\\pN_])')" for i, k, _, t in terms)
    return f"""
rules AS (SELECT * FROM {_values(rules, 'rule, rule_id, rule_scope, regulatory_family, category, label, alert_level, severity, base, applies, code')}),
terms AS (SELECT *, {_SQL_STEM.format('term')} AS stem FROM {_values(terms, 'rule, term_ord, is_synonym, term')}),
docs AS MATERIALIZED (SELECT doc_id::VARCHAR AS document_name, coalesce(source, '') AS source_path, text, {_SQL_COMPACT.format('text')} AS compact, {_SQL_FOLD.format('text')} AS folded FROM documents),
contained AS ({contained}),
hits AS (
  SELECT document_name, rule, term_ord, CASE WHEN is_synonym THEN 'synonym' ELSE 'exact' END AS kind, 0 AS detector, term AS matched, round(base - CASE WHEN is_synonym THEN 0.05 ELSE 0 END, 2) AS score
  FROM contained JOIN terms USING (rule, term_ord) JOIN rules USING (rule)),
words AS (SELECT document_name, unnest(t) AS word, unnest(range(len(t))) AS pos FROM (SELECT document_name, {_SQL_TOKENS.format('folded')} AS t FROM docs)),
roots AS (
  SELECT document_name, rule, term_ord, 'root' AS kind, 1 AS detector, arg_min(word, pos) AS matched, round(max(base) - 0.08, 2) AS score
  FROM words JOIN terms ON {_SQL_STEM.format('word')} = stem AND word <> term AND len(stem) >= 5 AND NOT is_synonym AND NOT contains(term, ' ') JOIN rules USING (rule)
  GROUP BY document_name, rule, term_ord),
ranked AS (SELECT *, row_number() OVER (PARTITION BY document_name, rule ORDER BY score DESC, term_ord DESC, detector) AS place FROM (SELECT * FROM hits UNION ALL SELECT * FROM roots)),
whitelist AS (SELECT * FROM {_values([(w.expression,) for w in WHITELIST], 'expression')}),
best AS (SELECT * FROM ranked WHERE place = 1),
kept AS (
  SELECT b.*, r.* EXCLUDE (rule), d.compact, d.source_path FROM best b JOIN rules r USING (rule) JOIN docs d USING (document_name)
  WHERE NOT (r.applies AND EXISTS (SELECT 1 FROM whitelist WHERE contains(d.folded, expression) AND (contains(expression, b.matched) OR contains(b.matched, expression)))))"""


_SQL_SHORT = "CASE WHEN len(compact) <= 220 THEN compact ELSE rtrim(substr(compact, 1, 217)) || '...' END"
_EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"


def _matches(spark, sf_dir, fuzzy=False) -> DataFrame:
    cut = sections.with_sections(_documents(spark, sf_dir), SECTIONS)
    return dictionary.dictionary_matches(cut, RULES, ["document"], fuzzy=fuzzy, exact_fold=False)


def _of_kind(spark, sf_dir, kind: str) -> DataFrame:
    """All matches of one way of detection, before the best is picked."""
    cut = sections.with_sections(_documents(spark, sf_dir), SECTIONS).withColumn("folded", X.fold(X.compact(F.col("section_text"))))
    rows = {"document": dictionary.term_rows(RULES, "document")}
    terms = dictionary._literal(rows, F.col("section"))
    d = cut.select("document_name", "folded", terms.alias("terms"))
    if kind == "root":
        d = d.withColumn("words", X.tokens(F.col("folded"))).withColumn("stems", X.stems(F.col("words")))
        roots = [r["stem"] for r in rows["document"] if r["stem"]]
        found = dictionary.root_matches(F.col("terms"), F.col("words"), F.col("stems"), F.array_intersect("stems", F.array(*map(F.lit, roots))))
    else:
        found = F.filter(dictionary.exact_matches(F.col("terms"), F.col("folded")), lambda m: m["kind"] == kind)
    ids = F.array(*(F.lit(r.rule_id) for r in RULES))
    one = d.select("document_name", F.explode_outer(found).alias("m")).where("m IS NOT NULL")
    return one.select("document_name", F.element_at(ids, F.col("m.rule") + 1).alias("rule_id"), (-F.col("m.minus_term")).alias("term_ord"), F.col("m.matched").alias("matched_term"), (-F.col("m.minus_score")).alias("score"))


def _sql_kind(table: str, kind: str) -> str:
    return f"WITH {_sql_rules()} SELECT document_name, rule_id, term_ord::INTEGER AS term_ord, matched AS matched_term, score FROM {table} JOIN rules USING (rule) WHERE kind = '{kind}'"


@query(_sql_kind("hits", "exact"))
def rule_exact_matches(spark, sf_dir):
    return _of_kind(spark, sf_dir, "exact")


@query(_sql_kind("hits", "synonym"))
def rule_synonym_matches(spark, sf_dir):
    return _of_kind(spark, sf_dir, "synonym")


@query(_sql_kind("roots", "root"))
def rule_root_matches(spark, sf_dir):
    return _of_kind(spark, sf_dir, "root")


@query(f"WITH {_sql_rules()} SELECT document_name, rule_id, matched AS matched_term, kind AS detection_type, score FROM best JOIN rules USING (rule)")
def rule_best_match(spark, sf_dir):
    ids = F.array(*(F.lit(r.rule_id) for r in RULES))
    one = _matches(spark, sf_dir).select("document_name", F.explode_outer("matches").alias("m")).where("m IS NOT NULL")
    return one.select("document_name", F.element_at(ids, F.col("m.rule") + 1).alias("rule_id"), F.col("m.matched").alias("matched_term"), F.col("m.kind").alias("detection_type"), (-F.col("m.minus_score")).alias("score"))


@query(f"""WITH {_sql_rules()}
SELECT document_name, source_path, code, severity, 'document' AS section, label AS title, 'Rule ''' || rule_id || ''' detected ''' || matched || ''' as ' || kind || '.' AS detail,
       {_SQL_SHORT} AS evidence, matched AS matched_term, alert_level, category, score, score AS branch_score, score AS generic_score, kind AS detection_type, 'generic' AS detection_engine, rule_id, rule_scope, regulatory_family FROM kept""")
def dictionary_findings(spark, sf_dir):
    cut = sections.with_sections(_documents(spark, sf_dir), SECTIONS)
    found = dictionary.detect_by_dictionary(cut, RULES, ["document"], WHITELIST, fuzzy=False, exact_fold=False)
    return found.drop("branch_ord", "section_ord", "item_ord", "spacy_score", "gliner_score", "regex_score")


@query(f"WITH {_sql_rules()} SELECT b.document_name, rule_id, matched AS matched_term FROM best b JOIN rules USING (rule) WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.document_name = b.document_name AND k.rule = b.rule)")
def whitelist_suppressed(spark, sf_dir):
    cut = sections.with_sections(_documents(spark, sf_dir), SECTIONS)
    every = dictionary.detect_by_dictionary(cut, RULES, ["document"], (), fuzzy=False, exact_fold=False)
    left = dictionary.detect_by_dictionary(cut, RULES, ["document"], WHITELIST, fuzzy=False, exact_fold=False)
    keys = ["document_name", "rule_id"]
    return every.join(left.select(*keys), keys, "left_anti").select(*keys, "matched_term")


@query()
def default_rules_findings(spark, sf_dir):
    return analyze(_documents(spark, sf_dir), enabled_branches=("generic", "regex")).findings.drop("branch_ord", "section_ord", "item_ord")


@query()
def linguistic_findings(spark, sf_dir):
    cut = sections.with_sections(_documents(spark, sf_dir), SECTIONS)
    lemmas = linguistic.TableLemmas({"idiots": "idiot", "morons": "moron", "losers": "loser", "thinge": "thinges"})
    return linguistic.detect_by_lemmas(cut, RULES, ["document"], lemmas, {"idiot": ("fool", "clown")}, WHITELIST).drop("branch_ord", "section_ord", "item_ord")


class _Numbers:
    """An entity provider for tests: runs of eight digits or more."""

    def predict_entities(self, text: str, labels: list[str], threshold: float) -> list[dict]:
        import re

        return [{"label": labels[0], "text": m, "score": 0.9} for m in re.findall(r"[0-9]{8,}", text)]


@query(r"""
WITH c AS (SELECT doc_id::VARCHAR AS document_name, trim(regexp_replace(text, '\s+', ' ', 'g')) AS x FROM documents)
SELECT document_name, 'gliner_long_number' AS code, 'long_number' AS category, m AS matched_term, 0.9::DOUBLE AS score FROM (SELECT document_name, unnest(regexp_extract_all(x, '[0-9]{8,}')) AS m FROM c)""")
def entity_findings(spark, sf_dir):
    cut = sections.with_sections(_documents(spark, sf_dir), SECTIONS)
    return detect_entities(cut, _Numbers(), ["long number"]).select("document_name", "code", "category", "matched_term", "score")


_SQL_EMAILS = f"SELECT doc_id::VARCHAR AS document_name, coalesce(source, '') AS source_path, {_SQL_COMPACT.format('text')} AS compact, unnest(regexp_extract_all(text, '{_EMAIL}')) AS matched FROM documents"


@query(f"""SELECT document_name, source_path, 'regex_email_address' AS code, matched AS matched_term, 'Regex detected ''' || matched || ''' as ''EMAIL_ADDRESS''.' AS detail, {_SQL_SHORT} AS evidence, 0.95::DOUBLE AS score FROM ({_SQL_EMAILS})""")
def regex_email_findings(spark, sf_dir):
    cut = sections.with_sections(_documents(spark, sf_dir), SECTIONS)
    found = detect_identifiers(cut, ["document"], defaults.IDENTIFIER_PATTERNS[:1])
    return found.select("document_name", "source_path", "code", "matched_term", "detail", "evidence", "score")


_SQL_CARDS = """
WITH c AS (SELECT c_custkey AS k, lpad(c_custkey::VARCHAR, 4, '0') AS p FROM customer),
d AS (SELECT k, 'tel 06-' || lpad((k % 100)::VARCHAR, 2, '0') || '.01 0404, iban fr76 ' || p || '-' || p || ' ' || p || p || 'AB12 X' || lpad((k % 100)::VARCHAR, 2, '0') || '; nir 1 84 ' || CASE WHEN k % 3 = 0 THEN '13' ELSE '12' END || ' 76 451 089 46' AS t FROM c)"""
_CARD = (
    "concat('tel 06-', lpad(cast(c_custkey % 100 as string), 2, '0'), '.01 0404, iban fr76 ', p, '-', p, ' ', p, p, 'AB12 X', lpad(cast(c_custkey % 100 as string), 2, '0'), "
    "'; nir 1 84 ', if(c_custkey % 3 = 0, '13', '12'), ' 76 451 089 46')"
)


@query(rf"""{_SQL_CARDS},
m AS (
  SELECT k, 'PHONE_NUMBER_FR' AS e, unnest(regexp_extract_all(t, '(?:^|[^0-9])((?:\+33[\s.-]?|0)[1-9](?:[\s.-]?[0-9]{{2}}){{4}})(?:$|[^0-9])', 1)) AS x, 0.9 AS score FROM d
  UNION ALL SELECT k, 'IBAN_FR', unnest(regexp_extract_all(t, '(?i)\bFR\d{{2}}(?:[\s-]?[A-Z0-9]{{4}}){{5}}[\s-]?[A-Z0-9]{{3}}\b')), 0.95 FROM d
  UNION ALL SELECT k, 'FR_NIR', unnest(regexp_extract_all(t, '(?i)\b[12]\s?\d{{2}}\s?(?:0[1-9]|1[0-2]|20)\s?(?:\d{{2}}|2A|2B|97[1-6]|98[4678])\s?\d{{3}}\s?\d{{3}}\s?\d{{2}}\b')), 0.95 FROM d)
SELECT k::VARCHAR AS document_name, e AS rule_id, 'regex_' || lower(e) AS code, x AS matched_term, score::DOUBLE AS score FROM m""")
def regex_identifier_findings(spark, sf_dir):
    """Telephone, account and social security numbers in texts made from customer keys."""
    p = F.lpad(F.col("c_custkey").cast("string"), 4, "0")
    cards = _table(spark, sf_dir, "customer").withColumn("p", p)
    docs = scans.table_documents(cards, "c_custkey", F.expr(_CARD))
    return detect_identifiers(sections.with_sections(docs, SECTIONS), ["document"]).select("document_name", "rule_id", "code", "matched_term", "score")


@query(f"SELECT 'EMAIL_ADDRESS' AS predicted_key, count(*) AS count, max(0.95::DOUBLE) AS max_score, string_agg(DISTINCT matched, ' | ' ORDER BY matched) AS matched_terms FROM ({_SQL_EMAILS}) HAVING count(*) > 0")
def regex_entity_summary(spark, sf_dir):
    cut = sections.with_sections(_documents(spark, sf_dir), SECTIONS)
    return report.entity_summary(detect_identifiers(cut, ["document"]))


@query(f"""
SELECT conv_id || '/' || turn AS document_name, role AS section, matched AS matched_term FROM (
  SELECT conv_id, turn, role, unnest(regexp_extract_all(text || ' write to ' || role || '.' || turn || '@mail' || conv_id || '.example.org or not', '{_EMAIL}')) AS matched FROM conversations)""")
def regex_turn_findings(spark, sf_dir):
    """Without a section ``document`` every section is searched: here the turns of conversations."""
    return detect_identifiers(_turns(spark, sf_dir), ["user", "assistant", "system"]).select("document_name", "section", "matched_term")


# Reports ------------------------------------------------------------------------------------------------------

def _analysis(spark, sf_dir):
    return _report_analysis(_documents(spark, sf_dir))


def _report_analysis(docs: DataFrame):
    """Dictionary and identifier branches without the fuzzy search, which SQL has no twin for."""
    return analyze(docs, RULES, SECTIONS, WHITELIST, ("generic", "regex"), fuzzy=False, exact_fold=False)


_SQL_FLAT = f"""{_sql_rules()},
emails AS ({_SQL_EMAILS}),
f AS (
  SELECT document_name, source_path, code, severity, alert_level, 'document' AS section, label AS title, matched AS matched_term, category, score, score AS branch_score, kind AS detection_type, 'generic' AS detection_engine, rule_id, rule_scope, regulatory_family FROM kept
  UNION ALL SELECT document_name, source_path, 'regex_email_address', 'medium', 'alerte', 'document', 'Adresse email', matched, 'email_address', 0.95, 0.95, 'regex', 'regex', 'EMAIL_ADDRESS', 'regex', 'donnees_personnelles_structurees' FROM emails),
flat AS (SELECT d.document_name, d.source_path, f.* EXCLUDE (document_name, source_path), count(f.code) OVER (PARTITION BY d.document_name, d.source_path) AS finding_count FROM docs d LEFT JOIN f USING (document_name, source_path)),
flags AS (SELECT *, rule_scope IS NOT DISTINCT FROM 'article9' AS is_article9, rule_id IS NOT NULL AND rule_scope IS DISTINCT FROM 'article9' AS is_generic,
  CASE WHEN score IS NULL THEN 'hors scoring' WHEN score >= 0.85 THEN 'controle humain / correction' WHEN score >= 0.65 THEN 'controle humain' ELSE 'journalisation' END AS review_action FROM flat)"""
_FLAT_COLUMNS = "document_name, source_path, code, severity, alert_level, section, title, matched_term, category, score, branch_score, detection_type, detection_engine, rule_id, rule_scope, regulatory_family, finding_count"


def _flat(spark, sf_dir) -> DataFrame:
    return _analysis(spark, sf_dir).flat().select(*_FLAT_COLUMNS.split(", "))


@query(f"WITH {_SQL_FLAT} SELECT {_FLAT_COLUMNS} FROM flat")
def findings_flat(spark, sf_dir):
    return _flat(spark, sf_dir)


@query(f"""WITH {_SQL_FLAT}
SELECT document_name, source_path, count(code) AS finding_count, count(code) > 0 AS has_findings, count(*) FILTER (detection_engine = 'generic') AS generic_finding_count,
       count(*) FILTER (detection_engine = 'regex') AS regex_finding_count, max(score) FILTER (detection_engine = 'generic') AS generic_max_score, max(score) FILTER (detection_engine = 'regex') AS regex_max_score,
       {len(RULES)}::BIGINT AS central_rules_loaded, {len(WHITELIST)}::BIGINT AS whitelist_terms_loaded FROM flat GROUP BY document_name, source_path""")
def document_metadata(spark, sf_dir):
    names = ["finding_count", "has_findings", "generic_finding_count", "regex_finding_count", "generic_max_score", "regex_max_score", "central_rules_loaded", "whitelist_terms_loaded"]
    return _analysis(spark, sf_dir).metadata().select("document_name", "source_path", *(f"metadata.{n}" for n in names))


@query(f"""WITH {_SQL_FLAT}
SELECT document_name, len(compact)::BIGINT AS n_chars, coalesce(n, 0) AS n_findings, coalesce(codes, '') AS codes
FROM docs LEFT JOIN (SELECT document_name, count(*) AS n, string_agg(code, '|' ORDER BY detection_engine, rule) AS codes FROM (SELECT f.*, rules.rule FROM f LEFT JOIN rules USING (rule_id)) GROUP BY 1) USING (document_name)""")
def nested_analyses(spark, sf_dir):
    n = _analysis(spark, sf_dir).nested()
    return n.select("document_name", F.length("extracted_text").cast("long").alias("n_chars"), F.size("findings").cast("long").alias("n_findings"), F.array_join(F.transform("findings", lambda f: f["code"]), "|").alias("codes"))


@query(f"WITH {_SQL_FLAT} SELECT (SELECT count(*) FROM docs) AS document_count, (SELECT count(DISTINCT document_name) FROM f) AS documents_with_findings, (SELECT count(*) FROM f) AS total_findings")
def corpus_summary(spark, sf_dir):
    return _analysis(spark, sf_dir).summary().drop("finding_codes")


@query(f"WITH {_SQL_FLAT} SELECT code, count(*) AS count FROM flat WHERE code <> '' GROUP BY code")
def finding_codes(spark, sf_dir):
    return report.code_counts(_flat(spark, sf_dir))


@query(f"WITH {_SQL_FLAT} SELECT code, severity, count(*) AS count FROM flat GROUP BY code, severity")
def by_code_severity(spark, sf_dir):
    return report.by_code_and_severity(_flat(spark, sf_dir))


@query(f"WITH {_SQL_FLAT} SELECT document_name, count(code) AS finding_count, max(score) AS max_score, count(*) FILTER (is_article9) AS article9_count FROM flags GROUP BY document_name")
def by_document(spark, sf_dir):
    return report.by_document(report.with_flags(_flat(spark, sf_dir)))


@query(f"WITH {_SQL_FLAT} SELECT section, category, detection_type, count(*) AS count, max(score) AS max_score, round(avg(score), 9) AS avg_score FROM flags WHERE is_generic GROUP BY ALL")
def by_section_category_type(spark, sf_dir):
    return report.by_section_category_type(report.with_flags(_flat(spark, sf_dir))).withColumn("avg_score", F.round("avg_score", 9))


@query(f"WITH {_SQL_FLAT} SELECT category, detection_type, count(*) AS count, max(score) AS max_score, round(avg(score), 9) AS avg_score FROM flags WHERE is_article9 GROUP BY ALL")
def article9_profile(spark, sf_dir):
    return report.article9_profile(report.with_flags(_flat(spark, sf_dir))).withColumn("avg_score", F.round("avg_score", 9))


@query(f"WITH {_SQL_FLAT} SELECT review_action, count(*) AS count FROM flags GROUP BY review_action")
def review_actions(spark, sf_dir):
    return report.review_counts(_flat(spark, sf_dir))


@query(f"WITH {_SQL_FLAT} SELECT document_name, code, matched_term, score, review_action FROM flags WHERE review_action LIKE 'controle%'")
def human_review_queue(spark, sf_dir):
    return report.review_queue(_flat(spark, sf_dir)).select("document_name", "code", "matched_term", "score", "review_action")


@query(f"WITH {_SQL_FLAT} SELECT document_name, code, matched_term, detection_type, score FROM flags WHERE detection_type IN ('fuzzy', 'root', 'synonym')")
def doubtful_findings(spark, sf_dir):
    return report.doubtful(_flat(spark, sf_dir)).select("document_name", "code", "matched_term", "detection_type", "score")


@query(f"WITH {_SQL_FLAT} SELECT document_name, code, severity, score, is_article9, is_generic FROM flags WHERE rule_scope = 'general' AND score >= 0.85")
def filtered_findings(spark, sf_dir):
    found = report.prioritized(report.with_flags(report.where(_flat(spark, sf_dir), rule_scope="general", least_score=0.85)))
    return found.select("document_name", "code", "severity", "score", "is_article9", "is_generic")


_SQL_ROWS = f"""{_SQL_FLAT},
cases AS (SELECT document_name AS case_id, source_path AS control_family FROM docs),
per_engine AS (
  SELECT e AS detection_engine, case_id, control_family, f.category, f.detection_type, f.rule_id AS predicted_key, f.matched_term, f.branch_score, (f.code IS NOT NULL)::INTEGER AS detection_count
  FROM cases CROSS JOIN (VALUES ('generic'), ('regex')) AS x(e) LEFT JOIN f ON f.document_name = case_id AND f.detection_engine = e)"""


def _branch_rows(spark, sf_dir) -> DataFrame:
    """Cases with what each of two branches found, a row of nulls where it found nothing."""
    a = _analysis(spark, sf_dir)
    cases = a.documents.select(F.col("document_name").alias("case_id"), F.col("source_path").alias("control_family"))
    per = [report.case_rows(cases, a.findings.where(F.col("detection_engine") == e), e) for e in ("generic", "regex")]
    return functools.reduce(DataFrame.unionByName, per)


@query(f"""WITH {_SQL_ROWS},
c AS (SELECT detection_engine, case_id, sum(detection_count) AS n, max(branch_score) AS best FROM per_engine GROUP BY ALL)
SELECT detection_engine, count(*) AS case_count, count(*) FILTER (n > 0) AS detected_count, count(*) FILTER (n = 0) AS undetected_count, sum(n)::BIGINT AS finding_count, round(avg(best), 9) AS avg_max_score, max(best) AS max_score FROM c GROUP BY detection_engine""")
def branch_summary(spark, sf_dir):
    return report.branch_summary(_branch_rows(spark, sf_dir)).withColumn("avg_max_score", F.round("avg_max_score", 9))


@query(f"""WITH {_SQL_ROWS}
SELECT detection_engine, control_family, category, detection_type, count(predicted_key) AS count, round(avg(branch_score), 9) AS avg_score, min(branch_score) AS min_score, max(branch_score) AS max_score FROM per_engine GROUP BY ALL""")
def branch_profile(spark, sf_dir):
    return report.branch_profile(_branch_rows(spark, sf_dir)).withColumn("avg_score", F.round("avg_score", 9))


@query(f"""WITH {_SQL_ROWS}
SELECT case_id, detection_engine, sum(detection_count)::BIGINT AS detection_count, max(branch_score) AS max_score, coalesce(string_agg(DISTINCT predicted_key, ' | ' ORDER BY predicted_key), '') AS predicted_keys,
       coalesce(string_agg(DISTINCT matched_term, ' | ' ORDER BY matched_term), '') AS matched_terms FROM per_engine GROUP BY ALL""")
def branch_comparison(spark, sf_dir):
    return report.case_comparison(_branch_rows(spark, sf_dir))


@query(f"""WITH {_SQL_ROWS}
SELECT case_id, coalesce(sum(detection_count) FILTER (detection_engine = 'generic'), 0)::BIGINT AS generic, 0::BIGINT AS spacy, 0::BIGINT AS gliner, coalesce(sum(detection_count) FILTER (detection_engine = 'regex'), 0)::BIGINT AS regex FROM per_engine GROUP BY case_id""")
def branch_pivot(spark, sf_dir):
    return report.branch_pivot(report.case_comparison(_branch_rows(spark, sf_dir)))


# Evaluation ---------------------------------------------------------------------------------------------------

_SQL_CASES = f"""{_SQL_FLAT},
expected AS (
  SELECT doc_id::VARCHAR AS case_id, lang AS control_family, toxic = 1 AS expected_alert, CASE WHEN toxic = 1 THEN ['TOXIC_LANGUAGE'] ELSE [] END AS want
  FROM labels JOIN documents USING (doc_id)),
found AS (SELECT document_name AS case_id, list(DISTINCT rule_id) AS keys, count(*) AS n, max(score) AS max_score FROM f WHERE rule_id = 'TOXIC_LANGUAGE' GROUP BY document_name),
results AS (
  SELECT case_id, control_family, expected_alert, coalesce(n, 0) > 0 AS detected, coalesce(n, 0) AS finding_count, max_score,
         array_to_string(list_sort(coalesce(keys, [])), ' | ') AS predicted_keys,
         array_to_string(list_filter(want, lambda k: NOT list_contains(coalesce(keys, []), k)), ' | ') AS missing_keys,
         array_to_string(CASE WHEN expected_alert THEN list_filter(coalesce(keys, []), lambda k: NOT list_contains(want, k)) ELSE coalesce(keys, []) END, ' | ') AS unexpected_keys,
         CASE WHEN expected_alert AND coalesce(n, 0) > 0 THEN 'TP' WHEN expected_alert THEN 'FN' WHEN coalesce(n, 0) > 0 THEN 'FP' ELSE 'TN' END AS alert_outcome
  FROM expected LEFT JOIN found USING (case_id)),
rated AS MATERIALIZED (SELECT *, alert_outcome IN ('TP', 'TN') AND missing_keys = '' AND unexpected_keys = '' AS case_ok FROM results)"""
_SQL_RATES = """round(tp / nullif(tp + fp, 0)::DOUBLE, 9) AS "precision", round(tp / nullif(tp + fn, 0)::DOUBLE, 9) AS recall,
       CASE WHEN tp > 0 THEN round(2 * (tp / (tp + fp)::DOUBLE) * (tp / (tp + fn)::DOUBLE) / (tp / (tp + fp)::DOUBLE + tp / (tp + fn)::DOUBLE), 9) END AS f1"""


def _results(spark, sf_dir) -> DataFrame:
    """Labelled documents as cases: toxic ones should raise the rule on insults."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    toxic = F.col("toxic") == 1
    cases = labels.join(docs.select("doc_id", "lang"), "doc_id").select(
        F.col("doc_id").cast("string").alias("case_id"), F.col("lang").alias("control_family"), toxic.alias("expected_alert"), F.when(toxic, "TOXIC_LANGUAGE").otherwise("").alias("expected_keys"),
        F.lit("").alias("expected_categories"), F.lit("").alias("expected_detection_types"),
    )
    found = _analysis(spark, sf_dir).findings.where("rule_id = 'TOXIC_LANGUAGE'")
    return evaluate.case_results(cases, found)


@query(f"WITH {_SQL_CASES} SELECT case_id, detected, finding_count, max_score, predicted_keys, missing_keys, unexpected_keys, alert_outcome, case_ok FROM rated")
def eval_case_results(spark, sf_dir):
    return _results(spark, sf_dir).select("case_id", "detected", "finding_count", "max_score", "predicted_keys", "missing_keys", "unexpected_keys", "alert_outcome", "case_ok")


@query(f"WITH {_SQL_CASES} SELECT control_family, alert_outcome, count(*) AS count FROM rated GROUP BY ALL")
def eval_outcomes(spark, sf_dir):
    return evaluate.outcome_counts(_results(spark, sf_dir))


@query(f"WITH {_SQL_CASES} SELECT count(*) AS case_count, count(*) FILTER (case_ok) AS ok_count, count(*) FILTER (NOT case_ok) AS ko_count, round(avg(case_ok::INTEGER), 9) AS ok_rate FROM rated")
def eval_quality_summary(spark, sf_dir):
    return evaluate.quality_summary(_results(spark, sf_dir)).withColumn("ok_rate", F.round("ok_rate", 9))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query(f"""WITH {_SQL_CASES}, m AS (SELECT count(*) FILTER (alert_outcome = 'TP') AS tp, count(*) FILTER (alert_outcome = 'FP') AS fp, count(*) FILTER (alert_outcome = 'FN') AS fn, count(*) FILTER (alert_outcome = 'TN') AS tn FROM rated)
SELECT tp AS "TP", fp AS "FP", fn AS "FN", tn AS "TN", {_SQL_RATES} FROM m""")
def eval_metrics(spark, sf_dir):
    return _rounded(evaluate.alert_metrics(_results(spark, sf_dir)))


@query(f"""WITH {_SQL_CASES},
s AS (SELECT threshold, expected_alert AS e, coalesce(max_score, 0) >= threshold AS p FROM rated CROSS JOIN {_values([(t,) for t in defaults.SWEEP], 'threshold')}),
m AS (SELECT threshold, count(*) FILTER (e AND p) AS tp, count(*) FILTER (NOT e AND p) AS fp, count(*) FILTER (e AND NOT p) AS fn, count(*) FILTER (NOT e AND NOT p) AS tn FROM s GROUP BY threshold)
SELECT threshold, tp AS "TP", fp AS "FP", fn AS "FN", tn AS "TN", {_SQL_RATES} FROM m""")
def eval_threshold_sweep(spark, sf_dir):
    return _rounded(evaluate.threshold_sweep(_results(spark, sf_dir)))


_SQL_BENCH = _values([c[:3] + c[4:] for c in bench_cases.CASES], "case_id, control_family, section_id, expected_alert, expected_keys, expected_categories, expected_detection_types")


@query(f"""
SELECT case_id, CASE WHEN expected_alert THEN 'TP' ELSE 'TN' END AS alert_outcome, array_to_string(list_sort(list_filter(string_split(expected_keys, '|'), lambda k: k <> '')), ' | ') AS predicted_keys,
       '' AS missing_keys, '' AS unexpected_keys, true AS category_match, true AS detection_type_match, true AS case_ok FROM {_SQL_BENCH}""")
def bench_case_results(spark, sf_dir):
    """The inline bench of thirteen cases, with the default dictionaries: every case is to come out as its author expects."""
    return _bench(spark).select("case_id", "alert_outcome", "predicted_keys", "missing_keys", "unexpected_keys", "category_match", "detection_type_match", "case_ok")


def _bench(spark) -> DataFrame:
    cases = bench_cases.cases(spark)
    found = run_detector(cases, config.load_rules(), config.load_sections(), config.load_whitelist())
    return evaluate.case_results(cases, found)
