"""Fixed values of the redaction and of the CV grid."""

EMAIL = r"[\w.+-]+@[\w-]+(\.[\w-]+)+"
PHONE = r"(?:\+\d{1,3}[\s.-]?)?(?:\(?\d{1,4}\)?[\s.-]?){2,5}\d{2,4}"
LINK = r"(?i)\b(?:https?://|www\.)\S+|\b(?:linkedin|github|behance|dribbble)\.com/\S+|\b[\w-]+\.(?:vercel\.app|netlify\.app|github\.io)\S*"
STREET = r"(?iu)\b\d{1,4}\s*(?:bis|ter)?,?\s+(?:rue|avenue|av\.|boulevard|bd|all[ée]e|chemin|place|impasse|quai|route|cours|square|street|st\.|road|rd\.)\b[^\n]*"
POSTCODE_TOWN = r"\b\d{5}\s+[A-ZÀ-Ü][\w' -]{1,40}"
NAME_LINE = r"^\s*([A-ZÀ-Ü][a-zà-ÿ'-]+|[A-ZÀ-Ü'-]{2,})(\s+([A-ZÀ-Ü][a-zà-ÿ'-]+|[A-ZÀ-Ü'-]{2,})){1,2}\s*$"
PLACEHOLDERS = {"email": "[email]", "phone": "[téléphone]", "link": "[lien]", "address": "[adresse]", "name": "[nom]"}
PHONE_DIGITS = 9

CV_SECTIONS = [
    ("experience", r"\b(experiences?( professionnelles?)?|parcours professionnel|work experience|experience|employment)\b"),
    ("formation", r"\b(formations?|education|diplomes?|etudes|academic)\b"),
    ("competences", r"\b(competences|skills|savoir[- ]faire|outils|hard skills|soft skills)\b"),
]
CV_LANGUAGES = r"\b(langues?|languages?)\b"
CV_LANGUAGE_LEVEL = (
    r"\b(a1|a2|b1|b2|c1|c2|courant|bilingue|natif|native|maternelle|fluent|professionnel|intermediaire|intermediate|notions|scolaire"
    r"|toeic|toefl|ielts|cambridge)\b"
)
ACTION_VERBS = (
    r"^(pilot|lanc|concu|developp|cre|optimis|ameliore|augment|redui|gere|dirig|coordonn|mis en place|deploy|analys|automatis|negoci"
    r"|conduit|realis|organis|livr|anim|defini|construi|led|launched|built|designed|developed|improved|increased|reduced|managed"
    r"|delivered|created|drove|owned|shipped|implemented|analy[sz]ed)\w*"
)
QUANTIFIED = (
    r"(?i)(?:[+−-]\s?)?\d+(?:[.,]\d+)?\s?(?:%|k€|m€|€|k\b|m\b|x\b|×|pts?\b|points?\b)|(?:\bx|×)\s?\d+\b"
    r"|\b\d{1,3}(?:[ .,]?\d{3})*\+?\s(?:\w+\s)?(?:utilisateurs?|clients?|users?|personnes|people|entreprises|equipes?|developpeurs|devs"
    r"|projets?|pays|ventes|leads|telechargements|downloads|membres|participants|collaborateurs|magasins|sites|produits"
    r"|fonctionnalites|features|commandes|orders|transactions|abonnes|followers|visites|sessions|entretiens|interviews|tickets"
    r"|candidats|partenaires|marches|langues|stakeholders|squads|sprints|releases|apps?)\b"
)
CV_GOOD_NAME = r"(?i)cv|resume|curriculum"
CV_BAD_NAME = r"(?i)document|scan|untitled|sans titre|\(\d+\)"
CV_LINE_CUTS = r"\n|•|·|▪|◦|‣"
CV_YEARS = r"\b(19[89]\d|20[0-4]\d)\b"
