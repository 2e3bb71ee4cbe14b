"""Branches, dictionaries, reports and evaluation on texts with known findings."""

import json
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

import lexsift
from lexsift import config, defaults
from lexsift.functions import text as X
from lexsift.operators import entities, evaluate, linguistic, report
from lexsift.operators.dictionary import detect_by_dictionary
from lexsift.operators.similarity import FuzzySearch, FuzzyTerm
from lexsift.plans import bench_cases
from lexsift.plans.engine import analyze, run_detector
from lexsift.schemas import FLAT_COLUMNS
from lexsift.sources import scans, sinks

RULES_A = """rule_id,section_scope,category,label,terms,synonyms,alert_level,severity,base_score,fuzzy_threshold
GEN_FORBIDDEN,conseil,mot_interdit,Terme interdit,sans risque|garantie,assure|certain,interdit,high,0.90,0.86
GEN_BENEF,beneficiaires,clause_beneficiaire,Clause imprecise,mes proches,,ambigue,low,0.65,0.86
"""
RULES_B = """rule_id,rule_scope,regulatory_family,section_scope,category,label,terms,synonyms,alert_level,severity,base_score,fuzzy_threshold,applies_whitelist
SANTE_DIABETE,article9,rgpd_article_9,document,sante,Diabete,diabete|diabetique,insuline|glycemie,interdit,critical,0.90,0.86,true
SANTE,article9,rgpd_article_9,document,sante,Sante,sante,,interdit,critical,0.88,0.86,true
"""
FORM = "7. Beneficiaires\n{}\n8. Declarations\nLe client confirme.\n9. Conseil et Recommandation\n{}\n10. Signatures"


def rules_of(tmp_path, text):
    path = tmp_path / "rules.csv"
    path.write_text(text, encoding="utf-8")
    return config.load_rules(str(path))


def in_section(spark, rules, section, text, whitelist=(), **options):
    rows = spark.createDataFrame([("d", "p", 0, section, text)], "document_name string, source_path string, section_ord int, section string, section_text string")
    return detect_by_dictionary(rows, rules, [section], whitelist, **options).orderBy("item_ord").collect()


def test_rules_file(spark, tmp_path):
    a, b = rules_of(tmp_path, RULES_A)
    assert (a.rule_id, a.rule_scope, a.regulatory_family, a.section_scope) == ("GEN_FORBIDDEN", "general", "general", ("conseil",))
    assert a.terms == ("sans risque", "garantie") and a.synonyms == ("assure", "certain") and a.all_terms == (*a.terms, *a.synonyms)
    assert b.synonyms == () and not b.applies_whitelist and rules_of(tmp_path, RULES_B)[0].applies_whitelist
    assert config.load_rules(str(tmp_path / "none.csv")) == []


@pytest.mark.parametrize("change", [("interdit,high", "odd,high"), ("0.90,0.86", "1.5,0.86"), ("0.90,0.86", "0.90,-1")])
def test_wrong_rules(spark, tmp_path, change):
    with pytest.raises(ValueError):
        rules_of(tmp_path, RULES_A.replace(*change))


def test_incomplete_rules_are_left_out_before_they_are_checked(spark, tmp_path):
    text = "rule_id,section_scope,category,terms,alert_level\n,conseil,c,t,odd\nA,,c,t,odd\nB,conseil,,t,odd\nC,conseil,c,,odd\nD,Conseil | *,c, X |y ,\n"
    (d,) = rules_of(tmp_path, text)
    assert (d.rule_id, d.section_scope, d.terms, d.label, d.alert_level, d.severity, d.base_score, d.fuzzy_threshold) == ("D", ("conseil", "*"), ("x", "y"), "D", "alerte", "medium", 0.75, 0.88)


def test_defaults():
    assert len(config.load_rules()) == 20 and len(config.load_sections()) == 3 and len(config.load_whitelist()) == 4 and len(config.load_synonyms()) == 42
    assert report.dictionary_counts(config.load_rules(), sections=3) == {"rules": 20, "general_rules": 11, "article9_rules": 9, "sections": 3}
    assert report.rule_display(config.load_rules())[0]["section_scope"] == "beneficiaires"


def test_flags_and_branches():
    assert [config.parse_flag(v, True) for v in (None, " ", "Oui", "y", "no", "2")] == [True, True, True, True, False, False]
    assert config.resolve_branches(None) == ("generic",) and config.resolve_branches([]) == () and config.resolve_branches([" Regex", "regex", ""]) == ("regex", "regex")
    with pytest.raises(ValueError, match="bad, worse"):
        config.resolve_branches(["worse", "bad", "generic"])


def test_synonym_file(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text("term,proposed_synonyms\nGarantie,assure|certain\nx,\ngarantie, sur \n", encoding="utf-8")
    assert config.load_synonyms(str(path)) == {"garantie": ("sur",)}


@pytest.mark.parametrize(
    "text,kind,term",
    [("Ce placement est sans risque pour le client.", "exact", "sans risque"), ("Le conseiller presente le support comme certain.", "synonym", "certain"), ("Le capital est garentie par le contrat.", "fuzzy", "garentie")],
)
def test_ways_of_detection(spark, tmp_path, text, kind, term):
    (found,) = in_section(spark, rules_of(tmp_path, RULES_A), "conseil", text)
    assert (found.rule_id, found.detection_type, found.matched_term, found.rule_scope, found.detection_engine) == ("GEN_FORBIDDEN", kind, term, "general", "generic")


@pytest.mark.parametrize("text,kind,score", [("Il est diabetique.", "exact", 0.9), ("Un traitement par insuline.", "synonym", 0.85), ("Il dit etre diabettique.", "fuzzy", 0.75), ("Les diabétiques", "root", 0.82)])
def test_article9(spark, tmp_path, text, kind, score):
    found = in_section(spark, rules_of(tmp_path, RULES_B), "document", text)
    assert [(f.code, f.detection_type, f.score, f.severity) for f in found] == [("article9_sante", kind, score, "critical")]


def test_whitelist_hides_the_best_match_and_nothing_takes_its_place(spark, tmp_path):
    rules = rules_of(tmp_path, RULES_B)[1:]
    tolerated = [config.Tolerated("sante financiere", "")]
    assert in_section(spark, rules, "document", "La sante financiere reste correcte. Sa sante aussi.", tolerated) == []
    assert len(in_section(spark, rules, "document", "Sa sante va bien.", tolerated)) == 1


def test_later_term_wins_ties_and_blank_sections_have_none(spark):
    rules = config.load_rules()
    found = in_section(spark, rules, "conseil", "forcement le top, il faut foncer")
    assert {f.rule_id: f.matched_term for f in found}["forbidden_alerte"] == "foncer"
    assert in_section(spark, rules, "conseil", " \n\t ") == []


def brute(rules, section, text, mods=defaults.DICTIONARY_MODIFIERS):
    """All ways of detection, one after the other, in plain Python."""
    folded = X.fold_text(re.sub(r"\s+", " ", text).strip())
    words = re.findall(r"\b[\w']+\b", folded)
    out = []
    for r in rules:
        if section not in r.section_scope and "*" not in r.section_scope:
            continue
        found = []
        for k, term in enumerate(r.all_terms):
            t, own = X.fold_text(term), X.tokenize(term)
            synonym = k >= len(r.terms)
            if re.search(rf"(?<!\w){re.escape(t)}(?!\w)", folded):
                found.append((X.score(r.base_score, mods["synonym" if synonym else "exact"]), k, 0, "synonym" if synonym else "exact", term))
            if not synonym and len(own) == 1:
                hit = next((w for w in words if w != own[0] and X.stem(w) == X.stem(own[0]) and len(X.stem(w)) >= 5), None)
                if hit:
                    found.append((X.score(r.base_score, mods["root"]), k, -1, "root", hit))
            runs = [" ".join(words[i : i + len(own)]) for i in range(len(words) - len(own) + 1)]
            rated = [(SequenceMatcher(None, t, c).ratio(), -i, c) for i, c in enumerate(runs) if c != t]
            best = max(rated, default=(0.0, 0, ""))
            if best[0] >= r.fuzzy_threshold:
                found.append((X.score(r.base_score, mods["fuzzy"]), k, -2, "fuzzy", best[2]))
        if found:
            s, _, _, kind, matched = max(found)
            out.append((r.rule_id, kind, matched, s))
    return out


TEXTS = [
    "Le capital est garantis, sans risques ; les rendements sont toujours certains et garentie forcément par defaut.",
    "Il ne comprend pas bien, formule standard du cabinet pour allez plus vite, plusieurs differences detaillées.",
    "La personne qui sera la plus présente au moment venue, mes proche ou toute autre personne dont mon fils connaîtra le nom",
    "pas besoin d'entrer dans trops de details ; l'adherent a foncé, ce contrat est au top",
    "diabétiques, cancers, religieuses, syndiqués, homosexuelle, parti politique, CGT et race; empreintes digitales, génétiques",
    "neutre", "", "É' ''x'' _ 12 ß œuvre ﬁn",
]


@pytest.mark.parametrize("exact_fold", [True, False])
def test_dictionary_branch_against_plain_python(spark, exact_fold):
    rules = config.load_rules()
    rows = [(f"{i}", "p", 0, s, t) for i, t in enumerate(TEXTS) for s in ("beneficiaires", "conseil", "document")]
    df = spark.createDataFrame(rows, "document_name string, source_path string, section_ord int, section string, section_text string")
    found = detect_by_dictionary(df, rules, ["beneficiaires", "conseil", "document"], exact_fold=exact_fold).collect()
    got = {}
    for f in found:
        got.setdefault((f.document_name, f.section), []).append((f.item_ord, f.rule_id, f.detection_type, f.matched_term, f.score))
    for name, _, _, section, text in rows:
        assert [x[1:] for x in sorted(got.get((name, section), []))] == brute(rules, section, text), (name, section)


@pytest.mark.parametrize("threshold", [0.0, 0.3, 0.6, 0.86, 1.0])
def test_fuzzy_search_against_all_ratios(threshold):
    import random

    rng = random.Random(int(threshold * 100))
    for _ in range(30):
        words = ["".join(rng.choices("abcé", k=rng.randint(1, 6))) for _ in range(rng.randint(0, 12))]
        term = " ".join("".join(rng.choices("abc", k=rng.randint(1, 6))) for _ in range(rng.randint(1, 3)))
        size = len(term.split())
        runs = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)]
        best, best_text = 0.0, ""
        for c in runs:
            if c != term and (r := SequenceMatcher(None, term, c).ratio()) > best:
                best, best_text = r, c
        got = [(c) for _, c in FuzzySearch([FuzzyTerm(0, 0, term, size, threshold, 0.0)])(words)]
        assert got == ([best_text] if best >= threshold else [])


@pytest.mark.parametrize(
    "beneficiaries,advice,codes",
    [
        ("Mes proches, ou la personne qui sera la plus presente.", "Neutre.", {"beneficiary_clause_imprecise"}),
        ("Neutre.", "Il faut foncer sans trop reflechir, ce contrat est top. Les risques ne sont pas un vrai sujet.", {"advice_unprofessional_wording", "advice_risk_minimization"}),
        ("Neutre.", "La prime represente une part tres importante du revenu disponible.", {"advice_above_financial_capacity"}),
        ("Neutre.", "Il ne comprand pas bien, donc formule par defaut pour aller plus vite.", {"advice_default_formula_due_to_client_confusion", "advice_spelling_quality_issue"}),
    ],
)
def test_forms(spark, beneficiaries, advice, codes):
    a = lexsift.analyze_text("f", "p", FORM.format(beneficiaries, advice))
    assert codes <= {r.code for r in a.findings.collect()}


def test_markers_without_regard_to_case_and_forbidden_words(spark):
    a = lexsift.analyze_text("f", "p", FORM.format("Aux proches.", "Foncer, par defaut, sans risque.").upper())
    got = {(r.section, r.matched_term, r.alert_level) for r in a.findings.collect()}
    assert {("beneficiaires", "proches", "ambigue"), ("conseil", "par defaut", "ambigue"), ("conseil", "sans risque", "interdit"), ("conseil", "foncer", "alerte")} <= got


def test_sections(spark):
    cut = {r.section: r.section_text for r in lexsift.analyze_text("f", "p", FORM.format(" : A - ", "B")).nested().selectExpr("explode(sections) AS (section, section_text)").collect()}
    assert cut["beneficiaires"] == "A" and cut["conseil"] == "B" and cut["document"].startswith("7. Beneficiaires\n : A -")
    none = lexsift.analyze_text("f", "p", "9. Conseil et Recommandation rest").nested().first().sections
    assert none["beneficiaires"] == "" and none["conseil"] == "rest"
    assert lexsift.analyze_text("f", "p", None).findings.collect() == []


def test_identifiers(spark):
    a = lexsift.analyze_text("f", "p", "Contact 06-05.01 0404 et joignable test@yahoo.Fr.", enabled_branches=["regex"])
    found = a.ordered().collect()
    assert {r.rule_id for r in found} == {"EMAIL_ADDRESS", "PHONE_NUMBER_FR"} and len(found) == 2
    m = a.metadata().first().metadata
    assert (m.regex_finding_count, m.regex_max_score, m.generic_max_score, m.enabled_branches) == (2, 0.95, None, ["regex"])
    other = "FR76 3000 6000 0112 3456 7890 189 et 1 84 12 76 451 089 46, pas 1 84 13 76 451 089 46 ni 006 05 01 04 044"
    assert {r.rule_id for r in lexsift.analyze_text("f", "p", other, enabled_branches=["regex"]).findings.collect()} == {"IBAN_FR", "FR_NIR"}


def test_missing_models_leave_the_other_branches_alone(spark):
    a = lexsift.analyze_text("f", "p", FORM.format("Mes proches.", "x"), enabled_branches=["generic", "spacy", "gliner"], gliner_labels=("maladie",), gliner_local_files_only=True)
    assert {r.detection_engine for r in a.findings.collect()} == {"generic"}
    m = a.metadata().first().metadata
    assert set(m.branch_errors) == {"spacy", "gliner"} and m.gliner_labels == ["maladie"] and m.has_findings
    assert report.with_errors(a.metadata()).count() == 1 and report.with_errors(corpus(spark).metadata()).count() == 0
    assert lexsift.analyze_text("f", "p", "x", enabled_branches=[]).findings.collect() == []


def test_own_patterns(spark):
    a = lexsift.analyze_text("f", "p", "Dossier AB-1234 et ab-77.", enabled_branches=["regex"], identifier_patterns=(("CASE_NUMBER", "Numero", r"(?i)\b[a-z]{2}-\d{4}\b", 0.7),))
    assert [(r.code, r.matched_term, r.score) for r in a.findings.collect()] == [("regex_case_number", "AB-1234", 0.7)]


def test_lemmas(spark):
    rules = [r for r in config.load_rules() if "conseil" in r.section_scope]
    lemmas = linguistic.TableLemmas({"fonce": "foncer", "garanties": "garantie", "protegees": "protege"})
    a = analyze(scans.table_documents(spark.createDataFrame([("a", FORM.format("x", "Il fonce. Tout est sur et protegees."))], "n string, t string"), "n", "t"), rules, enabled_branches=["spacy"], lemma_provider=lemmas)
    got = {(r.rule_id, r.detection_type, r.matched_term, r.score) for r in a.findings.collect()}
    assert ("forbidden_alerte", "lemma", "fonce", 0.68) in got and ("forbidden_certain", "synonym", "sur", 0.84) in got
    assert ("forbidden_garanti", "lemma", "protegees", 0.79) in got
    assert linguistic.rule_synonyms(rules[0], {}) == ()


class Places:
    def predict_entities(self, text, labels, threshold):
        return [{"label": " Lieu Dit ", "text": "Paris", "score": 0.876}, {"label": "", "text": "x"}, {"label": "y", "text": None}, {"label": "été", "text": "Nice", "score": None}]


def test_entities(spark):
    a = lexsift.analyze_text("f", "p", FORM.format("x", "y"), enabled_branches=["gliner"], entity_provider=Places())
    got = {(r.section, r.code, r.category, r.matched_term, r.score) for r in a.findings.collect()}
    assert got == {(s, *x) for s in ("beneficiaires", "conseil", "document") for x in (("gliner_lieu_dit", "lieu_dit", "Paris", 0.88), ("gliner_ete", "ete", "Nice", None))}
    assert entities.clean_labels([" a ", ""]) == ("a",) and len(entities.clean_labels(None)) == 16
    assert lexsift.analyze_text("f", "p", "x", enabled_branches=["gliner"], entity_provider=Places(), gliner_labels=(" ",)).findings.collect() == []


def corpus(spark):
    docs = [("a", "p", FORM.format("Mes proches.", "sans risque, a@b.fr")), ("b", "p", "rien"), ("c", "p", "diabete")]
    return analyze(spark.createDataFrame(docs, "document_name string, source_path string, extracted_text string"), enabled_branches=["generic", "regex"])


def test_reports(spark):
    a = corpus(spark)
    flat = a.flat().cache()
    assert flat.columns == FLAT_COLUMNS
    rows = flat.collect()
    b = [r for r in rows if r.document_name == "b"]
    assert len(b) == 1 and b[0].code is None and b[0].finding_count == 0
    assert all(r.finding_count == sum(x.document_name == r.document_name for x in rows) for r in rows if r.code)
    s = lexsift.summarize_results(flat).first()
    assert (s.document_count, s.documents_with_findings, s.total_findings) == (3, 2, len(rows) - 1) and sum(s.finding_codes.values()) == len(rows) - 1
    flagged = report.with_flags(flat)
    assert {r.is_article9 for r in flagged.where("code = 'article9_sante'").collect()} == {True}
    assert report.prioritized(flagged).first().code == "article9_sante" and report.by_document_and_score(flat).first().document_name == "a"
    assert flagged.where("is_generic AND detection_engine = 'regex'").count() == 1
    assert {r.review_action: r["count"] for r in report.review_counts(flat).collect()}["hors scoring"] == 1
    assert report.where(flat, code="article9_sante", matched_term="diabete", rule_scope="article9", least_score=0.85).count() == 1
    assert len(lexsift.results_to_dataframe(a)) == len(rows)
    flat.unpersist()


def test_results_survive_storage(spark, tmp_path, capsys):
    a = corpus(spark)
    path = lexsift.save_results(a, str(tmp_path / "out" / "results.json"))
    raw = open(path, encoding="utf-8").read()
    assert raw.isascii() and raw.startswith('[\n  {\n    "document_name": "a"') and len(json.loads(raw)) == 3
    back = lexsift.load_results(path)
    flat = lexsift.findings_to_records(back)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, flat.collect())) == sorted(map(key, a.flat().collect()))
    sinks.write_json_lines(a.nested(), str(tmp_path / "r.jsonl"))
    assert lexsift.load_results(str(tmp_path / "r.jsonl")).count() == 3
    files = sinks.save_review(a.flat(), str(tmp_path / "csv"))
    assert open(files[0], "rb").read(3) == b"\xef\xbb\xbf" and len(files) == 4
    sinks.write_findings(a.flat(), str(tmp_path / "parquet"))
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == a.flat().count()
    assert sinks.print_summary(lexsift.summarize_results(a.flat()))["document_count"] == json.loads(capsys.readouterr().out)["document_count"] == 3
    (tmp_path / "odd.json").write_text('[{"document_name": "x", "source_path": "p", "findings": [{"code": "c", "odd": 1}]}]')
    with pytest.raises(ValueError, match="odd"):
        lexsift.load_results(str(tmp_path / "odd.json"))
    (tmp_path / "few.json").write_text('[{"document_name": "x", "source_path": "p"}]')
    (few,) = lexsift.load_results(str(tmp_path / "few.json")).collect()
    assert (few.extracted_text, few.sections, few.findings) == ("", {}, [])


def test_scans(spark, tmp_path):
    for name, data in (("b.pdf", b"two"), ("a.pdf", b"mes proches"), ("x.txt", b"texte"), ("y.html", "<p>été &amp; co</p>".encode())):
        (tmp_path / name).write_bytes(data)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.pdf").write_bytes(b"no")
    a = lexsift.analyze_directory(str(tmp_path), str(tmp_path / "res" / "r.json"), extractor=bytes.decode)
    assert [r.document_name for r in a.documents.orderBy("source_path").collect()] == ["a.pdf", "b.pdf"]
    assert [d["document_name"] for d in json.load(open(tmp_path / "res" / "r.json"))] == ["a.pdf", "b.pdf"]
    assert lexsift.analyze_file(str(tmp_path / "a.pdf"), extractor=bytes.decode).documents.first().extracted_text == "mes proches"
    assert [tuple(r) for r in scans.file_inventory(str(tmp_path)).collect()] == [("a.pdf", 11), ("b.pdf", 3)]
    assert scans.text_documents(str(tmp_path)).first().extracted_text == "texte"
    assert scans.html_documents(str(tmp_path)).first().extracted_text == "été & co"
    with pytest.raises(RuntimeError, match="pypdf"):
        scans.pdf_text(b"")


def test_case_file(spark, tmp_path):
    path = tmp_path / "cases.csv"
    path.write_text('text,control_family,comment\n"7. Beneficiaires\nune ""ligne""\n8.",generic,\nune,article9,c\n', encoding="utf-8")
    cases = evaluate.numbered_cases(scans.read_cases(str(path)))
    assert [tuple(r) for r in cases.select("case_id", "text", "comment").collect()] == [("CASE_001", '7. Beneficiaires\nune "ligne"\n8.', ""), ("CASE_002", "une", "c")]
    with pytest.raises(ValueError, match="control_family"):
        path.write_text("text\nx\n")
        scans.read_cases(str(path))


#: By hand from the rules: the ways of detection, and the best score as (base score, modifier) of the rule and way that give it.
BENCH = {
    "GEN_EXACT_BENEF_PROCHES": ("exact", (0.90, 0)), "GEN_EXACT_COMPOUND_SANS_RISQUE": ("exact | synonym", (0.90, 0)), "GEN_SYNONYM_FONCER": ("exact | synonym", (0.88, -0.05)), "GEN_ROOT_GARANTIS": ("fuzzy | root", (0.90, -0.08)),
    "GEN_FUZZY_GARENTIE": ("fuzzy", (0.90, -0.15)), "GEN_WRONG_SECTION_NO_ALERT": ("", None), "A9_EXACT_DIABETIQUE": ("exact", (0.90, 0)), "A9_SYNONYM_INSULINE": ("synonym", (0.90, -0.05)), "A9_ROOT_DIABETIQUES": ("exact", (0.90, 0)),
    "A9_FUZZY_DIABETTIQUE": ("fuzzy", (0.90, -0.15)), "A9_WHITELIST_NEGATIVE": ("", None), "FULL_TEXT_GENERIC_AND_A9": ("exact | synonym", (0.90, 0)), "NEGATIVE_NEUTRAL": ("", None),
}


def test_bench(spark):
    cases = bench_cases.cases(spark)
    found = run_detector(cases, config.load_rules(), config.load_sections(), config.load_whitelist())
    results = evaluate.case_results(cases, found).cache()
    got = {r.case_id: (r.predicted_detection_types, r.max_score) for r in results.collect()}
    best = {k: None if v is None else round(sum(v), 2) for k, (_, v) in BENCH.items()}
    assert got == {k: (kinds, best[k]) for k, (kinds, _) in BENCH.items()}
    outcomes = {r.case_id: r.alert_outcome for r in results.collect()}
    assert outcomes == {c[0]: "TP" if c[4] else "TN" for c in bench_cases.CASES} and all(r.case_ok for r in results.collect())
    m = evaluate.alert_metrics(results).first()
    assert (m.TP, m.FP, m.FN, m.TN, m.precision, m.recall, m.f1) == (10, 0, 0, 3, 1.0, 1.0, 1.0)
    q = evaluate.quality_summary(results).first()
    assert (q.case_count, q.ok_count, q.ko_count, q.ok_rate) == (13, 13, 0, 1.0)
    sweep = {r.threshold: r.TP for r in evaluate.threshold_sweep(results).collect()}
    assert sweep == {t: sum(s is not None and s >= t for s in best.values()) for t in defaults.SWEEP}
    assert evaluate.failed(results).count() == 0 and evaluate.missed(results).count() == 3
    results.unpersist()
    with pytest.raises(ValueError, match="odd"):
        run_detector(cases.withColumn("control_family", F.lit("odd")), [], [], [])


def test_rates_without_denominator(spark):
    none = spark.createDataFrame([("TN",)], "alert_outcome string")
    m = evaluate.alert_metrics(none).first()
    assert (m.precision, m.recall, m.f1) == (None, None, None)
    m = evaluate.alert_metrics(spark.createDataFrame([("FN",), ("FP",)], "alert_outcome string")).first()
    assert (m.precision, m.recall, m.f1) == (0.0, 0.0, None)


def test_watched_folder(spark, tmp_path):
    from lexsift.streaming.watch import watch_folder

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Il est diabetique.")
    for text in ("Ecrire a x@y.fr", None):
        query = watch_folder(str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), enabled_branches=["generic", "regex"])
        query.awaitTermination(120)
        if text:
            (tmp_path / "in" / "b.txt").write_text(text)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.document_name, r.code) for r in rows) == [("a.txt", "article9_sante"), ("b.txt", "regex_email_address")]


def test_plans_have_no_shuffle_before_the_findings(spark):
    a = corpus(spark)
    plan = a.findings._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_branch_reports(spark):
    a = corpus(spark)
    cases = a.documents.select(F.col("document_name").alias("case_id"), F.lit("full_text").alias("control_family"))
    rows = report.case_rows(cases, a.findings)
    summary = {r.detection_engine: r for r in report.branch_summary(rows).collect()}
    assert summary["none"].case_count == 1 and summary["none"].undetected_count == 1 and summary["regex"].detected_count == 1
    profile = report.branch_profile(rows).where("detection_engine = 'generic'").collect()
    assert sum(r["count"] for r in profile) == a.findings.where("detection_engine = 'generic'").count()
    pivot = {r.case_id: r.asDict() for r in report.branch_pivot(report.case_comparison(rows)).collect()}
    assert pivot["b"] == {"case_id": "b", "generic": 0, "spacy": 0, "gliner": 0, "regex": 0} and pivot["a"]["regex"] == 1
    assert {r.predicted_label for r in report.label_profile(rows).where("detection_engine = 'regex'").collect()} == {"Adresse email"}
    (entity,) = report.entity_summary(a.findings.where("detection_engine = 'regex'")).collect()
    assert (entity.predicted_key, entity["count"], entity.matched_terms) == ("EMAIL_ADDRESS", 1, "a@b.fr")
    profiles = report.score_profile(report.with_flags(a.flat()).where("is_article9"), "category").first()
    assert (profiles["count"], profiles.max_score) == (1, 0.9)


def test_results_need_no_exchange(spark):
    docs = spark.createDataFrame([("a", "p", "7. Beneficiaires : mes proches 8. Declarations x@y.fr"), ("a", "p", "mes proches"), ("b", None, None)], "document_name string, source_path string, extracted_text string")
    a = lexsift.analyze(docs, enabled_branches=["generic", "regex"])
    for df in (a.nested(), a.flat(), a.metadata(), a.findings):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    nested = {(r.document_name, r.extracted_text): [(f.section, f.rule_id) for f in r.findings] for r in a.nested().collect()}
    # Documents of one name and path keep their own findings.
    assert nested["a", "mes proches"] == [] and ("document", "EMAIL_ADDRESS") in nested["a", "7. Beneficiaires : mes proches 8. Declarations x@y.fr"]
    counts = sorted(r.metadata.finding_count for r in a.metadata().collect())
    assert counts[:2] == [0, 0] and counts[2] == a.findings.count() == a.summary().first().total_findings
    assert a.summary().first().document_count == 3 and a.summary().first().documents_with_findings == 1
    assert report.summary(a.flat()).first().finding_codes == a.summary().first().finding_codes


def test_orders(spark):
    rows = [("b", 0.5, "x", "general", "low", "c2", "regex"), ("a", None, "y", "article9", "high", "c1", "generic"), ("a", 0.9, "x", None, "high", "c1", "generic"), ("b", 0.7, "z", "article9", "low", "c1", "regex"), ("a", 0.9, "w", "general", "high", "c2", "generic")]
    df = spark.createDataFrame(rows, "document_name string, score double, category string, rule_scope string, severity string, case_id string, detection_engine string")
    flagged = report.with_flags(df.withColumn("rule_id", F.when(F.col("rule_scope").isNotNull(), "R")))
    assert [(r.document_name, r.score) for r in report.by_document_and_score(df).collect()] == [("a", 0.9), ("a", 0.9), ("a", None), ("b", 0.7), ("b", 0.5)]
    assert [(r.is_article9, r.score) for r in report.prioritized(flagged).collect()] == [(True, 0.7), (True, None), (False, 0.9), (False, 0.5), (False, 0.9)]
    assert [r.category for r in report.review_queue(df).collect()] == ["w", "x", "z"]
    kinds = df.withColumn("detection_type", F.when(F.col("category") == "x", "root").otherwise("fuzzy"))
    assert [(r.detection_type, r.score) for r in report.doubtful(kinds).collect()] == [("fuzzy", 0.9), ("fuzzy", 0.7), ("fuzzy", None), ("root", 0.9), ("root", 0.5)]
    cases = df.select("case_id", "detection_engine", F.col("score").alias("branch_score"), F.col("category").alias("predicted_key"), F.lit("m").alias("matched_term"), F.lit("t").alias("detection_type")).repartition(3)
    got = report.placed(report.by_case_and_score(cases)).orderBy("place").collect()
    assert [(r.place, r.case_id, r.detection_engine, r.branch_score) for r in got] == [(1, "c1", "generic", 0.9), (2, "c1", "generic", None), (3, "c1", "regex", 0.7), (4, "c2", "generic", 0.9), (5, "c2", "regex", 0.5)]


def test_file_names_with_odd_characters(spark, tmp_path):
    for name in ("a b.txt", "c+d%20.txt", "é.txt"):
        (tmp_path / name).write_text("text")
    assert sorted(r.document_name for r in scans.text_documents(str(tmp_path)).collect()) == ["a b.txt", "c+d%20.txt", "é.txt"]


def test_jvm_fold_is_exact_where_it_is_used(spark):
    import re

    chars = [chr(c) for c in range(0x3000) if not re.match(X._OTHER, chr(c))]
    df = spark.createDataFrame([(f"A{c}b {c}{c}Z e{c}",) for c in chars], "t string").select("t", X.fold(F.col("t")).alias("f"))
    assert [r.t for r in df.collect() if r.f != X.fold_text(r.t)] == [] and len(chars) > 900
