"""Fixed values of the language rules: names shown, words that name them, level and wish words."""

NAMES = [
    ("allemand", "allemand|german|deutsch"), ("espagnol", "espagnol|spanish|castellano"), ("italien", "italien|italian"),
    ("portugais", "portugais|portuguese"), ("néerlandais", "neerlandais|dutch|flamand|flemish"), ("turc", "turc|turkish"),
    ("japonais", "japonais|japanese"), ("chinois", "chinois|chinese|mandarin|cantonese|cantonais"), ("arabe", "arabe|arabic"),
    ("russe", "russe|russian"), ("polonais", "polonais|polish"), ("coréen", "coreen|korean"),
    ("indonésien", "indonesien|indonesian|bahasa"), ("thaï", "thai|thaï"), ("vietnamien", "vietnamien|vietnamese"),
    ("suédois", "suedois|swedish"), ("norvégien", "norvegien|norwegian"), ("danois", "danois|danish"), ("finnois", "finnois|finnish"),
    ("grec", "grec|greek"), ("roumain", "roumain|romanian"), ("tchèque", "tcheque|czech"), ("hongrois", "hongrois|hungarian"),
    ("hébreu", "hebreu|hebrew"), ("hindi", "hindi"), ("khmer", "khmer"), ("ukrainien", "ukrainien|ukrainian"),
]
LEVEL = "fluent|fluency|fluently|native|natif|native speaker|proficient|proficiency|bilingue|bilingual|courant|couramment|c1|c2|maitrise|parfaite maitrise|mother tongue|langue maternelle"
MUST = "required|mandatory|a must|must|essential|exige|exigee|indispensable|obligatoire|requis|requise"
WISH = r"\b(a plus|is a plus|nice to have|bonus|souhait|apprecie|serait un plus|est un plus|idealement|ideally|preferred|preferably|un atout|an asset|advantage|avantage)\b"
FRENCH_OR_ENGLISH = r"\b(francais|french|anglais|english)\b"
CHOICE = r"\b(or|ou)\b"
SENTENCE_END = r"(?<=[.!?;])\s+|\n+"
QUOTE_LENGTH = 160
