"""Fixed values of the verdict checks."""

MATCHES = ["metier_vise", "passerelle", "autre"]
SECTORS = ["prioritaire", "accepte", "a_eviter", "autre"]
SENIORITIES = ["junior", "confirme", "senior"]
SKILL_KINDS = ["outil", "methode", "savoir_etre", "langue"]
NO_TEXT = r"(?i)^(null|aucun|non|none)$"
CONTRACT_WORDS = {
    "cdi": r"\b(cdi|permanent|indetermin)", "cdd": r"\b(cdd|fixed[- ]term|determin)", "stage": r"\b(stage|stagiaire|intern(ship)?)\b",
    "alternance": r"\b(alternan|apprenti|work[- ]study)", "freelance": r"\b(freelance|independant|contractor)",
}
BEGINNER = r"debutant|premiere experience|jeune diplome|junior|graduate|entry[- ]level|no experience|sans experience"
JUNIOR_TITLE = r"\b(junior|jr|associate|graduate|entry[- ]level|debutant|jeune diplome)\b"
GENERIC_WORDS = [
    "produit", "produits", "digital", "digitaux", "numerique", "secteur", "secteurs", "poste", "postes", "non", "sans", "pas", "orientation",
    "et", "de", "des", "du", "la", "le", "les", "en", "ou", "paris", "equipe", "equipes", "structure", "structurees",
]
NEGATIVE = r"\b(sans|pas de|non|aucun)\b"
CONSULTING = r"(?iu)cabinet|conseil|consulting|\besn\b|ssii|agence|recrutement|staffing|freelances?\b"
CONSULTING_SOUGHT = r"(?iu)conseil|consulting|agence"
SECTOR_OPINION = r"(?iu)\b(secteurs?|prioritaires?|sant[eé]|sport)\b"
ALL_WELL = r"(?iu)align|correspond|coherent|adapte|ok\b|exp[ée]rience|\bans?\b|years?"
EXPERIENCE_NOTE = r"(?iu)exp[ée]rience|\d+\s*(ans?|years?)\b|seniorit|niveau"
QUOTE_LENGTH = 8
SENIORITY_YEARS = {"senior": 5, "confirme": 3}
EXCLUDE_GAP = 4
ANSWER = (
    "resultats array<struct<id:string,correspondance:string,secteur:string,piege:string,deal_breaker:string,deal_breaker_concerne:string,"
    "citation_deal_breaker:string,secteur_evite_concerne:string,citation_secteur:string,score_interet:string,score_chances:string,"
    "score_tremplin:string,pourquoi:string,reserve:string,missions:array<string>,salaire:string,experience_demandee:string,"
    "citation_experience:string,contrat:string,citation_contrat:string,en_bref:string,activite_entreprise:string,"
    "competences:array<struct<nom:string,type:string>>,points_d_attention:array<string>,secteur_prioritaire_concerne:string,niveau_missions:string>>"
)
TEXT_FIELDS = [
    "piege", "deal_breaker", "deal_breaker_concerne", "citation_deal_breaker", "secteur_evite_concerne", "citation_secteur", "pourquoi", "reserve",
    "salaire", "experience_demandee", "citation_experience", "contrat", "citation_contrat", "en_bref", "activite_entreprise",
    "secteur_prioritaire_concerne", "niveau_missions",
]
