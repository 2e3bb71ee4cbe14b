"""Default dictionaries and thresholds."""

# Detection rules, sections, tolerated expressions and synonyms, as CSV text.
RULES_CSV = """\
rule_id,rule_scope,regulatory_family,section_scope,category,label,terms,synonyms,alert_level,severity,base_score,fuzzy_threshold,applies_whitelist
beneficiary_clause_imprecise,general,conformite_metier,beneficiaires,clause_beneficiaire,Clause beneficiaire imprecise,la personne qui sera la plus presente|si notre situation est toujours stable|mes proches|toute autre personne dont mon fils connaitra le nom|au moment venu,,interdit,high,0.90,0.88,false
advice_unprofessional_wording,general,conformite_metier,conseil,conseil,Conseil formule de maniere non professionnelle,foncer sans trop reflechir|ce contrat est top|pas besoin d'entrer dans trop de details,foncer|top,interdit,high,0.88,0.86,false
advice_risk_minimization,general,conformite_metier,conseil,conseil,Risques minimises ou performance suggeree,rapporte forcement sur la duree|les risques ne sont pas un vrai sujet|ca finit toujours par remonter,sans risque|garanti|garantie|certain|forcement|toujours,interdit,high,0.90,0.86,false
advice_above_financial_capacity,general,conformite_metier,conseil,conseil,Formule proposee au-dessus des capacites de l'adherent,represente une part tres importante du revenu disponible|depasse ses capacites actuelles|reduire fortement ses autres depenses,,interdit,high,0.90,0.88,false
advice_default_formula_due_to_client_confusion,general,conformite_metier,conseil,conseil,Formule par defaut retenue faute d'accompagnement adapte,ne comprand pas bien|ne saisi pas bien|formule par defaut|formule standart du cabinet|pour aller plus vite,par defaut|formule par defaut,interdit,high,0.88,0.86,false
advice_spelling_quality_issue,general,qualite_redactionnelle,conseil,qualite_redactionnelle,Qualite redactionnelle faible dans la zone conseil,comprand|diferences|plusieur|disponnibilite|detaille|preferer|standart,,alerte,medium,0.75,0.90,false
forbidden_garanti,general,conformite_metier,beneficiaires|conseil,mot_interdit,Terme interdit detecte,garanti|garantie,,interdit,high,0.90,0.88,false
forbidden_sans_risque,general,conformite_metier,beneficiaires|conseil,mot_interdit,Terme interdit detecte,sans risque,,interdit,high,0.90,0.88,false
forbidden_certain,general,conformite_metier,beneficiaires|conseil,mot_interdit,Terme interdit detecte,certain,,interdit,high,0.88,0.88,false
forbidden_alerte,general,conformite_metier,beneficiaires|conseil,mot_interdit,Terme surveille detecte,forcement|toujours|top|foncer,,alerte,medium,0.75,0.86,false
forbidden_ambigue,general,conformite_metier,beneficiaires|conseil,mot_interdit,Terme ambigu detecte,proches|par defaut,,ambigue,low,0.65,0.86,false
SANTE_DIABETE,article9,rgpd_article_9,document,sante,Diabete,diabete|diabetique|diabetiques,insuline|glycemie|glycemique|traitement insulinique,interdit,critical,0.90,0.86,true
SANTE_PATHOLOGIE,article9,rgpd_article_9,document,sante,Pathologie grave,cancer|tumeur|handicap|depression|vih|sida,chimiotherapie|maladie chronique|affection longue duree,interdit,critical,0.92,0.88,true
OPINION_POLITIQUE,article9,rgpd_article_9,document,opinions_politiques,Engagement politique,parti politique|militant politique|engagement politique|elu local,syndicat politique|campagne electorale|tract politique,interdit,critical,0.88,0.86,true
CONVICTION_RELIGIEUSE,article9,rgpd_article_9,document,convictions_religieuses,Convictions religieuses,religion|religieux|musulman|chretien|juif|bouddhiste,pratique religieuse|lieu de culte,interdit,critical,0.88,0.87,true
APPARTENANCE_SYNDICALE,article9,rgpd_article_9,document,appartenance_syndicale,Appartenance syndicale,syndique|syndicat|delegue syndical,cgt|cfdt|fo|unsa|cfe cgc,interdit,critical,0.90,0.88,true
ORIENTATION_SEXUELLE,article9,rgpd_article_9,document,orientation_sexuelle,Orientation sexuelle,homosexuel|bisexuel|heterosexuel|orientation sexuelle,vie sexuelle|pacs avec mon compagnon|pacs avec ma compagne,interdit,critical,0.92,0.88,true
ORIGINE_ETHNIQUE,article9,rgpd_article_9,document,origine_raciale_ethnique,Origine raciale ou ethnique,origine ethnique|origine raciale|race|ethnie,communaute ethnique|minorite ethnique,interdit,critical,0.92,0.88,true
DONNEES_BIOMETRIQUES,article9,rgpd_article_9,document,donnees_biometriques,Biometrie,empreinte digitale|reconnaissance faciale|biometrie,donnee biometrique|scan iris,interdit,critical,0.92,0.88,true
DONNEES_GENETIQUES,article9,rgpd_article_9,document,donnees_genetiques,Genetique,adn|genetique|test genetique,mutation genetique|predisposition genetique,interdit,critical,0.92,0.88,true
"""

SECTIONS_CSV = """\
section_id,label,start_marker,end_marker
beneficiaires,Beneficiaires,7. Beneficiaires,8. Declarations
conseil,Conseil et Recommandation,9. Conseil et Recommandation,10. Signatures
document,Document complet,,
"""

WHITELIST_CSV = """\
expression,reason
sante financiere,about money
bilan de sante du contrat,about a contract
parti du contrat,a side of a contract
garantie sante financiere,about money
"""

SYNONYMS_CSV = """\
term,synonyms
sans risque,sans danger|risque nul|aucun risque|securise
garanti,assure|certain|securise|protege
garantie,assure|certain|securise|protection
certain,sur|assure|incontestable
forcement,necessairement|obligatoirement|inevitablement
toujours,constamment|systematiquement|invariablement
top,excellent|parfait|ideal
foncer,agir vite|se lancer|y aller|ne pas hesiter
proches,famille|parents|entourage
par defaut,standard|automatique|formule standard
diabete,insuline|glycemie|traitement insulinique
diabetique,insuline|glycemie|traitement insulinique
diabetiques,insuline|glycemie|traitement insulinique
cancer,chimiotherapie|tumeur|oncologie
tumeur,cancer|chimiotherapie|oncologie
handicap,invalidite|incapacite
depression,trouble depressif|antidepresseur
vih,sida|seropositif
sida,vih|seropositif
engagement politique,parti politique|militant politique|campagne electorale|tract politique
militant politique,parti politique|engagement politique|campagne electorale
parti politique,engagement politique|militant politique|campagne electorale
syndique,delegue syndical|syndicat
syndicat,delegue syndical|cgt|cfdt|fo|unsa|cfe cgc
delegue syndical,syndicat|cgt|cfdt|fo|unsa|cfe cgc
religion,pratique religieuse|lieu de culte|conviction religieuse
religieux,religion|pratique religieuse|lieu de culte
musulman,islam|religion musulmane
chretien,christianisme|religion chretienne
juif,judaisme|religion juive
bouddhiste,bouddhisme|religion bouddhiste
homosexuel,vie sexuelle|orientation sexuelle
bisexuel,vie sexuelle|orientation sexuelle
heterosexuel,vie sexuelle|orientation sexuelle
orientation sexuelle,vie sexuelle|pacs avec mon compagnon|pacs avec ma compagne
origine ethnique,communaute ethnique|minorite ethnique
origine raciale,communaute ethnique|minorite ethnique
race,origine raciale|origine ethnique
ethnie,origine ethnique|communaute ethnique
empreinte digitale,biometrie|donnee biometrique
reconnaissance faciale,biometrie|donnee biometrique
biometrie,donnee biometrique|scan iris
"""

# What a way of detection takes off a rule's base score.
DICTIONARY_MODIFIERS = {"exact": 0.0, "synonym": -0.05, "root": -0.08, "fuzzy": -0.15}
LINGUISTIC_MODIFIERS = {"exact": 0.0, "synonym": -0.04, "lemma": -0.07, "root": -0.10, "fuzzy": -0.16}

# Structured identifiers as (entity, title, pattern, score).
IDENTIFIER_PATTERNS = (
    ("EMAIL_ADDRESS", "Adresse email", r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", 0.95),
    ("PHONE_NUMBER_FR", "Numero de telephone francais", r"(?<!\d)(?:\+33[\s.-]?|0)[1-9](?:[\s.-]?\d{2}){4}(?!\d)", 0.90),
    ("IBAN_FR", "IBAN francais", r"(?i)\bFR\d{2}(?:[\s-]?[A-Z0-9]{4}){5}[\s-]?[A-Z0-9]{3}\b", 0.95),
    ("FR_NIR", "NIR francais", r"(?i)\b[12]\s?\d{2}\s?(?:0[1-9]|1[0-2]|20)\s?(?:\d{2}|2A|2B|97[1-6]|98[4678])\s?\d{3}\s?\d{3}\s?\d{2}\b", 0.95),
)

# Labels and threshold of entity recognition.
ENTITY_LABELS = (
    "donnee de sante",
    "maladie",
    "pathologie",
    "etat de sante",
    "condition medicale",
    "probleme de sante",
    "opinion politique",
    "conviction religieuse",
    "appartenance syndicale",
    "orientation sexuelle",
    "origine ethnique",
    "donnee genetique",
    "donnee biometrique",
    "clause beneficiaire imprecise",
    "conseil non professionnel",
    "promesse de performance",
)
ENTITY_THRESHOLD = 0.50

# Branches, alert levels, review limits and the thresholds of a sweep.
BRANCHES = ("generic", "spacy", "gliner", "regex")
ALERT_LEVELS = ("interdit", "alerte", "ambigue")
REVIEW_LIMITS = (("controle humain / correction", 0.85), ("controle humain", 0.65))
REVIEW_REST, REVIEW_NONE = "journalisation", "hors scoring"
SWEEP = (0.50, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90)

# Suffixes taken off a word, and how many characters more than the suffix a word needs.
SUFFIXES, SUFFIX_REST = ("iques", "ique", "euses", "euse", "ments", "ment", "es", "s", "e"), 4
ROOT_LENGTH = 5
EVIDENCE_LENGTH = 220
