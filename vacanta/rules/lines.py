"""Fixed values of the line rules: headings, wishes, known sections, introductions."""

BONUS = (
    r"\b(un plus|en plus|serait (un )?(plus|apprecie|appreciee|bienvenu)|est un plus|appreci|bonus|nice[- ]to[- ]have|ideal(ement)?"
    r"|atouts?|optionnel|souhaite|souhaitable|preferred|is a plus|would be a plus|a plus\b|pluses|ce qui ferait la difference|points? forts?)"
)
SECTION_WORDS = (
    r"\b(profil|missions?|responsabilit|pourquoi|avantages|process|qui sommes|a propos|about|benefits|ce que|tu es|vous etes|requirements"
    r"|qualifications|competences|stack|environnement|conditions|infos|plus|nice|bonus|ideal)"
)
HEADING_WORDS = 9
HEADING_COLON = r"[:：]\s*$"
SECTIONS = [
    "tes futures missions", "vos futures missions", "ce que tu feras", "ton futur rôle", "tes missions", "vos missions",
    "missions principales", "les missions", "missions", "ton rôle", "votre rôle", "le poste", "descriptif du poste",
    "description du poste", "profil recherché", "le profil que nous recherchons", "ce que nous recherchons", "ton profil",
    "votre profil", "le profil", "compétences requises", "compétences", "qualifications", "prérequis", "qui sommes-nous",
    "qui sommes nous", "l'entreprise", "à propos", "pourquoi nous rejoindre", "pourquoi rejoindre", "avantages", "les avantages",
    "les plus", "rémunération", "salaire", "processus de recrutement", "déroulement des entretiens", "informations complémentaires",
    "conditions", "about us", "about the company", "about the role", "the role", "your role", "your mission", "what you'll do",
    "what you will do", "responsibilities", "key responsibilities", "requirements", "your profile", "who you are",
    "what we're looking for", "what we are looking for", "must-haves", "must haves", "nice to have", "nice-to-have",
    "preferred experience", "benefits", "perks", "why join us", "why join", "what we offer", "hiring process", "recruitment process",
]
INTRODUCTION = (
    r"(?i)^(qui sommes[- ]nous|qui est [^:]{2,40}|a propos( de [^:]{2,40})?|about( us| the company| [^:]{2,30})?|l['’ ]entreprise"
    r"|la soci[eé]t[eé]|notre (entreprise|soci[eé]t[eé]|histoire)|pr[eé]sentation( de [^:]{2,40})?|who we are|our (company|story|mission)"
    r"|the company|company description|description de l['’ ]entreprise)\s*:?\s*$"
)
REQUIREMENTS_START = (
    r"(?im)^(.{0,40})(profil recherch|ce que nous recherchons|qualifications?|requirements|what we('re| are) looking for|about you"
    r"|your profile|who you are|you (have|are)|must[- ]have|tu es|vous [eê]tes|comp[ée]tences requises)"
)
