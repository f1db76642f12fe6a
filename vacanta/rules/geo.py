"""Fixed values of the gazetteer: places as sources write them. Order matters, the first name found wins."""

# Country names and short forms, by ISO code, in reading order.
# Fixed values.
COUNTRY_NAMES = [
    ("FR", ["france", "fr"]),
    ("US", ["united states", "usa", "us", "u.s.", "u.s.a.", "etats-unis", "america"]),
    ("GB", ["united kingdom", "uk", "u.k.", "england", "great britain", "royaume-uni"]),
    ("DE", ["germany", "deutschland", "allemagne"]),
    ("ES", ["spain", "espana", "espagne"]),
    ("PT", ["portugal"]),
    ("NL", ["netherlands", "pays-bas"]),
    ("BE", ["belgium", "belgique"]),
    ("CH", ["switzerland", "suisse"]),
    ("IT", ["italy", "italie"]),
    ("IE", ["ireland", "irlande"]),
    ("CA", ["canada"]),
    ("LU", ["luxembourg"]),
    ("PL", ["poland", "pologne"]),
    ("SE", ["sweden"]),
    ("DK", ["denmark"]),
    ("AT", ["austria"]),
    ("CZ", ["czechia", "czech republic"]),
    ("RO", ["romania"]),
    ("GR", ["greece"]),
    ("MA", ["morocco", "maroc"]),
    ("TN", ["tunisia", "tunisie"]),
    ("IN", ["india"]),
    ("IL", ["israel"]),
    ("SG", ["singapore"]),
    ("AU", ["australia"]),
    ("JP", ["japan"]),
    ("BR", ["brazil"]),
    ("MX", ["mexico"]),
    ("AR", ["argentina"]),
    ("TR", ["turkey", "turkiye"]),
    ("KR", ["south korea", "korea"]),
    ("UA", ["ukraine"]),
    ("EE", ["estonia"]),
    ("LV", ["latvia"]),
    ("LT", ["lithuania"]),
    ("FI", ["finland"]),
    ("NO", ["norway"]),
    ("GE", ["georgia"]),
    ("MT", ["malta"]),
    ("HU", ["hungary"]),
    ("BG", ["bulgaria"]),
    ("HR", ["croatia"]),
    ("RS", ["serbia"]),
    ("EG", ["egypt"]),
    ("NG", ["nigeria"]),
    ("KE", ["kenya"]),
    ("ZA", ["south africa"]),
    ("AE", ["united arab emirates", "uae"]),
    ("SA", ["saudi arabia"]),
    ("CN", ["china"]),
    ("HK", ["hong kong"]),
    ("TW", ["taiwan"]),
    ("TH", ["thailand"]),
    ("VN", ["vietnam"]),
    ("PH", ["philippines"]),
    ("ID", ["indonesia"]),
    ("MY", ["malaysia"]),
    ("NZ", ["new zealand"]),
    ("CO", ["colombia"]),
    ("CL", ["chile"]),
    ("PE", ["peru"]),
    ("UY", ["uruguay"]),
    ("DZ", ["algeria", "algerie"]),
    ("SN", ["senegal"]),
]

# Cities by country and French region, dashes read as spaces, in reading order.
# Fixed values.
CITIES = [
    ("FR", "IDF", ["paris", "la defense", "boulogne billancourt", "issy les moulineaux", "levallois perret", "neuilly sur seine", "saint ouen", "montrouge", "puteaux", "courbevoie", "velizy villacoublay", "clichy", "nanterre", "saint denis", "massy", "rueil malmaison"]),
    ("FR", "ARA", ["lyon", "grenoble", "annecy", "clermont ferrand", "saint etienne"]),
    ("FR", "PAC", ["marseille", "nice", "aix en provence", "sophia antipolis", "toulon"]),
    ("FR", "OCC", ["toulouse", "montpellier", "perpignan"]),
    ("FR", "NAQ", ["bordeaux", "pau", "limoges", "poitiers", "la rochelle"]),
    ("FR", "HDF", ["lille", "amiens"]),
    ("FR", "PDL", ["nantes", "angers", "le mans"]),
    ("FR", "BRE", ["rennes", "brest"]),
    ("FR", "GES", ["strasbourg", "metz", "nancy", "reims", "mulhouse"]),
    ("FR", "NOR", ["rouen", "caen", "le havre"]),
    ("FR", "CVL", ["tours", "orleans"]),
    ("FR", "BFC", ["dijon", "besancon"]),
    ("FR", "COR", ["ajaccio"]),
    ("US", None, ["new york", "nyc", "boston", "san francisco", "seattle", "austin", "chicago", "los angeles", "denver", "atlanta", "miami", "washington"]),
    ("GB", None, ["london", "londres", "manchester", "edinburgh"]),
    ("DE", None, ["berlin", "munich", "munchen", "hamburg", "frankfurt", "cologne", "koln", "darmstadt", "mainz", "marburg", "stuttgart"]),
    ("ES", None, ["madrid", "barcelona", "barcelone", "valencia"]),
    ("PT", None, ["lisbon", "lisboa", "lisbonne", "porto"]),
    ("NL", None, ["amsterdam", "rotterdam"]),
    ("BE", None, ["brussels", "bruxelles"]),
    ("CH", None, ["zurich", "geneva", "geneve", "lausanne"]),
    ("IT", None, ["milan", "milano", "rome"]),
    ("IE", None, ["dublin"]),
    ("CA", None, ["toronto", "montreal", "vancouver"]),
    ("PL", None, ["warsaw"]),
    ("SE", None, ["stockholm"]),
    ("DK", None, ["copenhagen"]),
    ("AT", None, ["vienna"]),
    ("CZ", None, ["prague"]),
    ("MA", None, ["casablanca"]),
    ("TN", None, ["tunis"]),
    ("IN", None, ["bangalore", "bengaluru"]),
    ("IL", None, ["tel aviv"]),
    ("SG", None, ["singapore"]),
    ("AU", None, ["sydney"]),
    ("JP", None, ["tokyo"]),
    ("BR", None, ["sao paulo"]),
    ("TR", None, ["istanbul", "ankara"]),
    ("KR", None, ["seoul"]),
    ("UA", None, ["kyiv", "kiev", "lviv", "kharkiv", "karkiv"]),
    ("EE", None, ["tallinn"]),
    ("LV", None, ["riga"]),
    ("LT", None, ["vilnius"]),
    ("FI", None, ["helsinki"]),
    ("NO", None, ["oslo"]),
    ("GE", None, ["tbilisi"]),
    ("PL", None, ["krakow", "wroclaw"]),
    ("RO", None, ["bucharest"]),
    ("BG", None, ["sofia"]),
    ("HU", None, ["budapest"]),
    ("GR", None, ["athens"]),
    ("RS", None, ["belgrade"]),
    ("HR", None, ["zagreb"]),
    ("EG", None, ["cairo"]),
    ("NG", None, ["lagos"]),
    ("KE", None, ["nairobi"]),
    ("ZA", None, ["johannesburg", "cape town"]),
    ("AE", None, ["dubai", "abu dhabi"]),
    ("SA", None, ["riyadh"]),
    ("CN", None, ["shanghai", "beijing", "shenzhen"]),
    ("TW", None, ["taipei"]),
    ("TH", None, ["bangkok"]),
    ("VN", None, ["ho chi minh", "hanoi"]),
    ("PH", None, ["manila"]),
    ("ID", None, ["jakarta"]),
    ("MY", None, ["kuala lumpur"]),
    ("AU", None, ["melbourne"]),
    ("NZ", None, ["auckland"]),
    ("IN", None, ["mumbai", "new delhi", "delhi", "hyderabad", "pune", "chennai"]),
    ("MX", None, ["mexico city"]),
    ("CO", None, ["bogota"]),
    ("CL", None, ["santiago"]),
    ("PE", None, ["lima"]),
    ("AR", None, ["buenos aires"]),
    ("UY", None, ["montevideo"]),
    ("US", None, ["san diego", "salt lake city"]),
    ("CA", None, ["ottawa"]),
    ("ES", None, ["tarragona", "seville", "malaga", "bilbao"]),
    ("MT", None, ["valletta"]),
    ("SN", None, ["dakar"]),
    ("DZ", None, ["algiers", "alger"]),
    ("LU", None, ["luxembourg"]),
    ("MC", None, ["monaco"]),
    ("BE", None, ["antwerp", "gand", "ghent", "liege"]),
    ("CH", None, ["basel", "bern"]),
]

REGION_LABELS = {
    "IDF": "Île-de-France", "ARA": "Auvergne-Rhône-Alpes", "PAC": "Provence-Alpes-Côte d'Azur", "OCC": "Occitanie",
    "NAQ": "Nouvelle-Aquitaine", "HDF": "Hauts-de-France", "PDL": "Pays de la Loire", "BRE": "Bretagne", "GES": "Grand Est",
    "NOR": "Normandie", "CVL": "Centre-Val de Loire", "BFC": "Bourgogne-Franche-Comté", "COR": "Corse",
}
REGION_PATTERNS = [
    (r"\b(ile de france|idf|region parisienne)\b", "IDF"),
    (r"\bauvergne( rhone alpes)?\b|\brhone alpes\b", "ARA"),
    (r"\bprovence( alpes cote d ?azur)?\b|\bpaca\b|\bcote d ?azur\b", "PAC"),
    (r"\boccitanie\b|\boccitania\b", "OCC"),
    (r"\bnouvelle aquitaine\b|\baquitaine\b", "NAQ"),
    (r"\bhauts de france\b|\bnord pas de calais\b", "HDF"),
    (r"\bpays de (la )?loire\b", "PDL"),
    (r"\bbretagne\b|\bbrittany\b", "BRE"),
    (r"\bgrand est\b|\balsace\b|\blorraine\b", "GES"),
    (r"\bnormandie\b|\bnormandy\b", "NOR"),
    (r"\bcentre val de loire\b|(^|, ?)centre(,|$)", "CVL"),
    (r"\bbourgogne( franche comte)?\b|\bburgundy\b|\bfranche comte\b", "BFC"),
    (r"\bcorse\b|\bcorsica\b", "COR"),
]
# Fixed values.
DEPARTMENTS = {
    "IDF": ["75", "77", "78", "91", "92", "93", "94", "95"],
    "ARA": ["01", "03", "07", "15", "26", "38", "42", "43", "63", "69", "73", "74"],
    "PAC": ["04", "05", "06", "13", "83", "84"],
    "OCC": ["09", "11", "12", "30", "31", "32", "34", "46", "48", "65", "66", "81", "82"],
    "NAQ": ["16", "17", "19", "23", "24", "33", "40", "47", "64", "79", "86", "87"],
    "HDF": ["02", "59", "60", "62", "80"],
    "PDL": ["44", "49", "53", "72", "85"],
    "BRE": ["22", "29", "35", "56"],
    "GES": ["08", "10", "51", "52", "54", "55", "57", "67", "68", "88"],
    "NOR": ["14", "27", "50", "61", "76"],
    "CVL": ["18", "28", "36", "37", "41", "45"],
    "BFC": ["21", "25", "39", "58", "70", "71", "89", "90"],
    "COR": ["20"],
}
EU = ["FR", "DE", "ES", "PT", "NL", "BE", "IT", "IE", "LU", "PL", "SE", "DK", "AT", "CZ", "RO", "GR", "FI"]
US_STATES_ALONE = r"\b(NY|MA|CA|WA|TX|IL|CO|GA|FL|DC|NJ|PA|OR|VA|NC|MN|AZ|UT)\b"
US_STATE_CODES = "AL|AK|AZ|AR|CA|CO|CT|DE|FL|GA|HI|ID|IL|IN|IA|KS|KY|LA|ME|MD|MA|MI|MN|MS|MO|MT|NE|NV|NH|NJ|NM|NY|NC|ND|OH|OK|OR|PA|RI|SC|SD|TN|TX|UT|VT|VA|WA|WV|WI|WY|DC"
US_STATE_NAMES = (
    "alabama|alaska|arizona|arkansas|california|colorado|connecticut|delaware|florida|georgia|hawaii|idaho|illinois|indiana|iowa"
    "|kansas|kentucky|louisiana|maine|maryland|massachusetts|michigan|minnesota|mississippi|missouri|montana|nebraska|nevada"
    "|new hampshire|new jersey|new mexico|new york state|north carolina|north dakota|ohio|oklahoma|oregon|pennsylvania"
    "|rhode island|south carolina|south dakota|tennessee|texas|utah|vermont|virginia|washington state|west virginia|wisconsin|wyoming"
)
CA_PROVINCES = "ON|QC|BC|AB|MB|SK|NS|NB|NL|PE"

SEGMENT_LIMITS = r"[;|/]| - | · |\n"
REMOTE = r"\b(full[- ]?remote|fully remote|remote|teletravail (complet|total|integral|100 ?%)|100 ?% (teletravail|remote)|anywhere)\b"
HYBRID = r"\b(hybrid|hybride|teletravail|home office|jours? (de|en) remote)\b"
SCOPE_EU = r"\b(emea|europe|eu)\b"
SCOPE_WORLD = r"\b(worldwide|anywhere|global)\b"
