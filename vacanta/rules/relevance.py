"""Fixed values of the title rules: stop words, abbreviations, set phrases, generic words."""

STOP = ["de", "du", "des", "la", "le", "les", "et", "en", "a", "the", "of", "and", "for", "h", "f", "x", "m", "w"]
SYNONYMS = [
    (r"\bquality assurance\b", "qa"), (r"\bproduct owner\b", "product owner po"), (r"\bproduct manager\b", "product manager pm"),
    (r"\buser experience\b", "ux"), (r"\buser interface\b", "ui"),
]
SET_PHRASES = [(r"\b(business develop(?:er|ment)|developpeur (?:commercial|d.affaires))\b", "bizdev")]
GENERIC = [
    "manager", "junior", "senior", "associate", "lead", "chef", "responsable", "head", "officer", "specialist", "specialiste",
    "charge", "chargee", "consultant", "assistant", "assistante", "director", "directeur", "directrice", "intern", "stagiaire",
    "alternant", "alternante", "confirme", "confirmee", "jr", "sr", "ii", "iii", "i",
]
NEUTRAL = [
    "stage", "stagiaire", "alternance", "alternant", "alternante", "apprenti", "apprentie", "apprentissage", "internship",
    "cdi", "cdd", "freelance", "interim", "mois", "months", "hf", "fh", "nb", "remote", "hybride", "hybrid", "teletravail",
]
QUALIFIER = r"(?iu)\s+(?:orient[ée]e?s?|avec|en|pour|vers|dans|with|towards)\s"
TITLE_PARTS = r"\s[-–—|:]\s|[(,|]"
CLOCK_TIME = r"(?i)\b\d{1,2}\s?h\s?\d{0,2}\s+(AM|PM)\b"
# Weights of a title match and of a text match: roles, bridges, sectors.
ROLE_WEIGHTS = (10.0, 3.0)
BRIDGE_WEIGHTS = (6.0, 2.0)
SECTOR_WEIGHTS = (0.0, 1.5)
MIN_TITLE_RELEVANCE = 5.0
FULL_NAME_RELEVANCE = 7.5
FAVORITE_RELEVANCE = 1.0
WANTED_RELEVANCE = 3.0
