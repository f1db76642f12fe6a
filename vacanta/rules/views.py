"""Fixed values of the feed, the board and the admin views."""

LEVEL_ORDER = {"coeur": 0, "solide": 1, "tremplin": 2, "ecartee": 3}
FOLLOW_UP_DAYS = 7
OWN_CHOICE = "Ton choix"
ASIDE_KINDS = [
    (r"(?iu)annonce incompl", "Annonce illisible"),
    (r"(?iu)type de contrat|stage ou alternance", "Contrat"),
    (r"(?iu)exp[ée]rience|trop senior", "Expérience"),
    (r"(?iu)zone|lieu", "Lieu"),
    (r"(?iu)intitul[ée] ne correspond|ressemble à ton métier", "Métier éloigné"),
    (r"(?iu)une formation, pas une offre", "Formation"),
    (r"(?iu)secteur|entreprises que tu [ée]vites", "Secteur"),
]
ONE_MARKET = (
    r"\b(cambodge|turquie|thailande|indonesie|japon|chine|coree|inde|bresil|mexique|argentine|portugal|espagne|italie|allemagne|pays-bas"
    r"|belgique|suisse|royaume-uni|angleterre|irlande|suede|norvege|danemark|finlande|pologne|grece|roumanie|ukraine|russie|maroc"
    r"|algerie|tunisie|egypte|nigeria|kenya|afrique du sud|australie|canada|etats-unis|usa|vietnam|philippines|malaisie|singapour"
    r"|emirats|arabie|qatar|israel|balkans|scandinavie|pays nordiques|nordics|golfe|amerique latine|asie|europe de l'est)\b"
    r"|\bmarches? (?:de |du |des |d')?[a-z]+ (?:local|locaux)\b"
    r"|\bmarche (?:turc|cambodgien|japonais|bresilien|indonesien|thai|allemand|espagnol|italien|britannique|americain|asiatique)\b"
)
SHOWCASE_JOBS = [
    ("communication", r"(?iu)\b(charg[ée]e? de communication|communication|marketing)\b"),
    ("data", r"(?iu)\b(data (analyst|scientist|engineer)|analyste)\b"),
    ("design", r"(?iu)\b(ux|ui|product|graphic)? ?designer\b"),
    ("commercial", r"(?iu)\b(business developer|account executive|commercial)\b"),
]
TITLE_NOISE = ["cdi", "cdd", "stage", "alternance", "paris", "france", "remote", "hybride"]
TITLE_MARKERS = r"\((?:h|f|x|m|n|w|d)(?:/(?:h|f|x|m|n|w|d))+\)|\b(?:h|f|x|m|n|w|d)(?:/(?:h|f|x|m|n|w|d))+\b"
EXPERIENCE_BUCKETS = ["0 à 1 an", "2 ans", "3 à 4 ans", "5 ans et plus", "Expérimenté, sans durée", "Non précisée"]
# Gates: from this gap on (years asked less years of the person) an offer is set aside.
EXPERIENCE_GAP_EXCLUDE = 4
REASON_ZONE = "Hors de ta zone de recherche."
NOTE_PLACE = "Lieu à vérifier sur l'annonce."
REASON_TITLE = "L'intitulé ne correspond à aucun de tes métiers ni de tes passerelles."
REASON_EXCERPT = "Annonce incomplète : seul un extrait a pu être lu, et une offre n'est jamais jugée sans avoir été lue en entier."
REASON_TRAINING = "Une formation, pas une offre d'emploi."
REASON_INVENTED = "L'intitulé ressemble à ton métier, mais l'offre décrit un autre métier."
REASON_SECTOR_AVOIDED = "Secteur que tu as choisi d'éviter."
REASON_SECTOR_CLOSED = "Hors des secteurs que tu vises."
REASON_NO_MATCH = "Ne correspond pas à ta recherche."
