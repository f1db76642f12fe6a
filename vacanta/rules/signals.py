"""Fixed values of the signals read in postings (contract, remote, experience, pay). Kept as they are."""

# A title that says so beats any generic field, permanent contracts excepted.
CONTRACT_WORDS = [
    (r"\b(stage|stagiaire|internship|intern)\b", "stage"),
    (r"\b(alternance|alternant|apprenti|apprentissage|apprenticeship|work[- ]study|contrat pro)\b", "alternance"),
    (r"\b(freelance|independant|contractor|portage)\b", "freelance"),
    (r"\b(cdd|fixed[- ]term|temporary contract|contrat a duree determinee|interim)\b", "cdd"),
    (r"\b(cdi|permanent|contrat a duree indeterminee|full[- ]time)\b", "cdi"),
]
# In prose only explicit statements count.
CONTRACT_PROSE = [
    (r"\b(ton|ce|votre|du|ton futur) stage\b|\bstage de fin d'etudes\b", "stage"),
    (r"\b(cdi|contrat a duree indeterminee)\b", "cdi"),
    (r"\b(cdd|contrat a duree determinee|fixed[- ]term contract)\b", "cdd"),
    (r"\b(offre de stage|stage de \d+ ?mois|stage d'une duree|stage de fin d'etudes de \d+|\d+[- ]month internship|internship of \d+)\b", "stage"),
    (r"\b(contrat d'alternance|alternance (de|sur) \d+|contrat d'apprentissage|contrat de professionnalisation)\b", "alternance"),
    (r"\b(mission freelance|contrat freelance|freelance mission)\b", "freelance"),
]
CONTRACT_STATED = [
    r"(?:type de )?contrat(?: de travail)?\s*(?:propose)?\s*:?\s*(?:en\s+)?(cdi|cdd|stage|alternance|apprentissage|freelance|interim)\b",
    r"\b(?:poste|offre|position|recrute\w*|cherche\w*|recherche\w*)\b[^.\n]{0,80}\ben (cdi|cdd|stage|alternance)\b",
    r"employment type\s*:?\s*(full[- ]?time|permanent|internship|fixed[- ]?term|temporary|contract)\b",
]
CONTRACT_STATED_WORDS = {
    "cdi": "cdi", "cdd": "cdd", "stage": "stage", "alternance": "alternance", "apprentissage": "alternance",
    "freelance": "freelance", "interim": "cdd", "fulltime": "cdi", "permanent": "cdi", "internship": "stage",
    "fixedterm": "cdd", "temporary": "cdd", "contract": "freelance",
}
CONTRACT_LABELS = {
    "cdi": "CDI", "cdd": "CDD", "stage": "Stage", "alternance": "Alternance", "freelance": "Freelance",
    "unknown": "Contrat non précisé",
}

REMOTE_FULL = r"\b(full[- ]?remote|fully remote|100 ?% (remote|teletravail|en teletravail)|teletravail (complet|total|integral)|remote[- ]first)\b"
REMOTE_DENIED = r"\b(pas de|sans|aucun|no) (teletravail|remote|home office)\b|\bteletravail (non|impossible)\b|\bfully on[- ]?site\b|\b100 ?% (presentiel|sur site)\b"
REMOTE_SOME = (
    r"\bteletravail\b|\b(work|working) remotely\b|\bremote (work|working|days?|policy)\b|\bhome office\b"
    r"|\b(\d|un|une|deux|trois|quatre)\s*(jours?|days?)\s*(de |of |en )?(teletravail|remote|tt|home office)\b"
    r"|\b(teletravail|remote)\s*(jusqu'?a|up to|de)?\s*\d\s*(jours?|days?)"
    r"|\bhybrid work|travail hybride|mode hybride|organisation hybride|modele hybride|politique de teletravail"
    r"|teletravail (flexible|partiel|possible|occasionnel|autorise)|hybrid (model|working|policy|set ?up|schedule)"
    r"|remote[- ]friendly|flexible remote"
)

# A duration in years: prefix, low bound, "and more", high bound.
_YEARS = r"(\d{1,2}(?:[.,]5)?)"
DURATION = (
    r"(jusqu'? ?a|up to|moins de|less than|max(?:imum)?\.?|plus de|more than|over|au moins|at least|minimum|minimun|minium|min\.?|>=?|≥|entre|between|de|from|d|sur|of)?\s*"
    + _YEARS
    + r"\s*(\+|ou plus|or more|et plus|and more|or above)?\s*(?:(?:a|-|to|/|et|and|ou|or)\s*"
    + _YEARS
    + r"\s*\+?\s*)?(?:ans?|annees?|years?|yrs?)\b"
)
EXPERIENCE_NEAR = (
    r"experien|\bexp\b|years of|years in|years as|background|track record|seniorit|poste similaire|similar role|role similaire"
    r"|in product|en product|en gestion|in management|au sein d|minimum|au moins|at least|profil"
)
NOT_EXPERIENCE = (
    r"\b(depuis|since|founded|fondee?s?|creee?s?|il y a|ago|over the (past|last)|for the (past|last)|pendant|during|age|old|aged"
    r"|garantie|guarantee|anniversaire|nos|our|fort de|forte de|pres de|nearly|almost|contrat|cdd|duree|duration|programme|program"
    r"|mission|alternance|apprentissage|engagement|tous les|every|prime|anciennete|a partir de|bac|degree|diplome|etudes|cursus|formation)"
    r"\b[ ,'+-]*(\w+[ ,'+-]+){0,2}$"
)
CEILING = r"^(jusqu'? ?a|up to|moins de|less than|max(?:imum)?\.?)$"
YEARS_MAX = 15
YEARS_HIGH_MAX = 20
# Years a posting asking for an "experienced" person implies, used for the gap only.
EXPERIENCED_YEARS = 4

JUNIOR_TEXT = (
    r"\b(profils? junior|junior accepte|postes? junior|peu experimente|premiere experience|1ere experience|jeune diplome|debutant"
    r"|sortie? d['’ ]ecole|fraichement diplome|entry[- ]level|new grad|graduate program|recent graduate"
    r"|no (prior )?experience (is )?required|early[- ]career)"
)
EXPERIENCED_TEXT = (
    r"\b(experience (professionnelle )?(significative|solide|confirmee|averee|reussie|consequente|importante|approfondie|probante)"
    r"|(solide|forte|riche|longue|vraie) experience|profils? (confirme|experimente|senior)|vous etes experimente|tu es experimente"
    r"|plusieurs annees d['’ ]experience|significant experience|extensive experience|proven (track record|experience)"
    r"|strong (track record|experience)|seasoned|several years of experience|experienced (product|professional|pm))"
)

TITLE_YEARS = [
    (r"\b(vp|vice[- ]president|chief|cpo|cto|director|directeur|directrice|head of|head)\b", 8),
    (r"\b(principal|staff|group product manager)\b", 7),
    (r"\b(engineering manager|manager, engineering|manager i+, engineering|people manager|team lead|tech lead)\b", 5),
    (r"\b(senior|sr\.?|lead|expert)\b", 5),
    (r"\b(iii|iv|v)\b|\s[3-5]\s*$|\s[3-5]\s*[-–(]", 5),
    (r"\b(confirme|confirmee|confirmed|experimente|experimentee|experienced|ii)\b|\s2\s*$|\s2\s*[-–(,]", 3),
]

# Amounts of money and the words around a pay.
_MONEY = r"(?:\d{1,3}(?:[ .,]\d{3})+|\d+)(?:[.,]\d{1,2})?(?![\d])"
_AMOUNT = rf"({_MONEY})\s*(k|K|000)?\s*(?:€|eur(?:os?)?|k€)?"
SALARY = (
    rf"(?<![\d.,])(?:€\s*)?{_AMOUNT}\s*(?:-|a|à|to|et|and)\s*(?:€\s*)?{_AMOUNT}"
    rf"|(?<![\d.,])(?:€\s*)?({_MONEY})\s*(k€|k|K€|000\s*€|\s?€)"
)
PAY_NEAR = r"salaire|remuneration|package|salary|compensation|pay range|brut|gross|fixe|base|annuel|annual|par an|per year|/an|k€"
NOT_PAY = (
    r"levee|leve|raised|funding|financement|chiffre d.affaires|revenue|ca de|turnover|budget|capital|valoris|ticket|panier"
    r"|jour travaille|par jour|/jour|cheques?|projets?|inferieur|superieur|montant|achats?|economies|commandes?|marches?"
    r"|portefeuille|encours|actifs"
)
PAY_MONTHLY = r"par mois|mensuel|/mois|per month|monthly"
PAY_YEARLY = r"annuel|par an|/an|per year|annual"
MONTHLY_RANGE = (1.2, 15.0)
YEARLY_RANGE = (18.0, 250.0)
MIDPOINT_RANGE = (15, 300)

# What titles show by themselves.
JUNIOR_TITLE = r"\b(junior|jr|debutant|debutante|jeune diplome|graduate|entry[- ]level)\b"
STUDENT_TITLE = r"\b(stage|stagiaire|intern|internship|alternance|alternant|alternante|apprenti|apprentie|apprentice|apprentissage|work[- ]study)\b"
JUNIOR_VIEW = r"(?iu)\b(junior|jr|associate|graduate|entry[- ]level|d[ée]butant|premi[eè]re exp[ée]rience|jeune dipl[oô]m)"
TRAINING_TITLE = r"(?iu)^\s*(formation|bootcamp|programme de formation|cursus)\b|\bformation (certifiante|qualifiante|diplomante|diplômante)\b"

CLOSED_POSTING = (
    r"(?iu)no longer available|is no longer accepting|has expired|position (has been )?filled|job (is )?closed|n['’]est plus disponible"
    r"|n['’]est plus en ligne|offre (a )?expir|offre (a été )?pourvue|annonce (a été )?(supprim|retir|expir)"
)
# Search engines: they keep postings long after they close.
ENGINES = ["adzuna", "jooble", "careerjet", "france-travail"]
DIRECT_SOURCES = r"greenhouse|lever|ashby|smartrecruiters|workable|recruitee|teamtailor|personio|digitalrecruiters|welcomekit"
EXCERPT_LENGTH = 1200
STALE_DAYS = 60
NEW_HOURS = 48
RETENTION_DAYS = 60
ENGINE_SILENCE_DAYS = 21
INTERMEDIARY = (
    r"collective\.?work|free-?work|malt\b|creme de la creme|freelance|jobs?\b|interim|staffing|talents?\b|recrutement|hays"
    r"|michael page|robert half|nexton"
)
ANONYMOUS = r"(?iu)non communiqu|confidenti|anonyme"

# Words without which a long pattern over whole texts cannot match: one of them is needed, of a pair its word and its pattern.
NEEDS = {
    CONTRACT_STATED[0]: ("contrat",),
    CONTRACT_STATED[1]: ("en cdi", "en cdd", "en stage", "en alternance"),
    CONTRACT_STATED[2]: ("employment type",),
    CONTRACT_PROSE[0][0]: (" stage", "stage de fin d'etudes"),
    CONTRACT_PROSE[1][0]: ("cdi", "contrat a duree indeterminee"),
    CONTRACT_PROSE[2][0]: ("cdd", "contrat a duree determinee", "fixed"),
    CONTRACT_PROSE[3][0]: ("stage", "internship"),
    CONTRACT_PROSE[4][0]: ("contrat d", "alternance "),
    CONTRACT_PROSE[5][0]: ("freelance",),
    REMOTE_FULL: ("remote", "teletravail"),
    REMOTE_DENIED: ("remote", "teletravail", "home office", "fully on", "presentiel", "sur site"),
    REMOTE_SOME: ("remote", "teletravail", "home office", "hybrid", ("tt", r"(?:jours?|days?)\s*(?:de |of |en )?tt\b")),
    JUNIOR_TEXT: ("junior", "experi", "diplome", "debutant", "ecole", "entry", "grad", "early"),
    EXPERIENCED_TEXT: ("experi", "profil", "track record", "seasoned"),
}
