"""A second dictionary, for the mixed corpus of the test tables: insults, notices, secrets, and words for their roots."""

from ..config import DetectionRule, Section, Tolerated


def _rule(rule_id: str, scope: str, family: str, category: str, label: str, terms: str, synonyms: str, level: str, severity: str, base: float, threshold: float) -> DetectionRule:
    split = lambda x: tuple(x.split("|")) if x else ()
    return DetectionRule(rule_id, scope, family, ("document",), category, label, split(terms), split(synonyms), level, severity, base, threshold, scope == "article9")


RULES = [
    _rule("TOXIC_LANGUAGE", "general", "moderation", "insult", "Insulting language", "idiot|stupid|moron|worthless|pathetic", "loser|scum|clown|trash|disgusting", "interdit", "high", 0.90, 0.88),
    _rule("LICENSE_NOTICE", "general", "provenance", "license", "Licence notice", "apache license|gnu general public license|all rights reserved", "licensed under|creative commons", "alerte", "medium", 0.75, 0.90),
    _rule("SECRET_TOKEN", "article9", "secrets", "secret", "Possible secret", "token|password|api key", "secret|credential", "interdit", "critical", 0.92, 0.88),
    _rule("COMMON_ROOTS", "general", "style", "root", "Words of a common root", "ontiones|antionment|verungen|thinges", "", "ambigue", "low", 0.65, 0.95),
]
SECTIONS = [Section("document", "Whole document", "", None)]
WHITELIST = [Tolerated("of token", "ordinary words"), Tolerated("gnu general", "a public licence")]
