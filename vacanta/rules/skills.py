"""Fixed values of the skill rules: aliases, qualifiers, words that are not skills."""

ALIASES = {
    "ai": "ia", "intelligence artificielle": "ia", "artificial intelligence": "ia", "kpi": "kpi", "okrs": "okr",
    "adobe premiere pro": "premiere pro", "adobe premiere": "premiere pro", "adobe after effect": "after effect",
    "adobe photoshop": "photoshop", "adobe illustrator": "illustrator", "adobe indesign": "indesign",
}
# Spellings searched in texts beside the aliases.
EXTRA_SPELLINGS = {"english": "anglai"}
LANGUAGES = [
    (r"\b(anglais|english)\b", "Anglais"), (r"\b(francais|french)\b", "Français"), (r"\b(espagnol|spanish)\b", "Espagnol"),
    (r"\b(allemand|german)\b", "Allemand"), (r"\b(italien|italian)\b", "Italien"),
]
QUALIFIERS = [
    "produit", "product", "digital", "digitale", "professionnel", "professionnelle", "courant", "avance", "avancee", "solide",
    "efficace", "agile", "client", "utilisateur", "user", "management", "skill",
]
NEUTRAL = ["produit", "product", "digital", "digitale", "professionnel", "professionnelle", "courant", "avance", "avancee", "solide", "efficace"]
TOO_GENERAL = [
    "data", "analyse", "produit", "product", "digital", "projet", "project", "client", "gestion", "business", "management", "equipe",
    "outil", "process", "strategie", "it", "web", "tech", "technique", "service", "operation", "vision", "impact", "qualite", "suivi",
    "conseil", "performance", "informatique", "workflow", "impact direct", "outils digitaux", "digitalisation", "standard",
]
SHORT_SKILLS = ["ia", "ux", "ui", "qa", "bi", "ml", "r", "c"]
NOT_SKILLS = r"^(product (manager|owner|designer)|chef de (projet|produit)|swile|ticket|mutuelle|teletravail|remote|cdi|cdd|stage|alternance|salaire|bspce|rtt)\b"
KINDS = ["outil", "methode", "savoir_etre", "langue"]
MIN_COUNT = 2
COMMON_WORD_SHARE = 0.06
COMMON_WORD_EXTRACTIONS = 15
# Thresholds of the advice drawn from a market.
ADVICE_TOP = 12
ADVICE_MIN_COUNT = 3
ADVICE_HARD_SHARE = 5
ADVICE_LANGUAGE_SHARE = 15
ADVICE_PLUS_COUNT = 10
ADVICE_PLUS_SHARE = 40
ADVICE_PLUS_KEPT = 3
