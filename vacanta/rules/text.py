"""Fixed values of the text keys. They must stay as they are for results to match."""

# Gender markers of titles: (H/F), h/f, m/f/x…
GENDER_MARKERS = r"\((?:[hfmx]\s*/\s*){1,3}[hfmx]\)|\b[hf]\s*/\s*[hf]\b|\b(?:[mfwx]\s*/\s*){1,3}[mfwx]\b"
# Legal forms and group words left out of a company key.
LEGAL_FORMS = r"\b(sas|sa|sarl|inc|ltd|gmbh|group|groupe)\b"
# Entities of HTML texts.
NUMERIC_ENTITY = r"&#(?:[xX][0-9a-fA-F]{1,6}|\d{1,7});"
NAMED_ENTITIES = [
    ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;|&#160;", " "), ("&#39;|&rsquo;|&apos;|&#8217;", "'"),
    ("&quot;|&ldquo;|&rdquo;", '"'), ("&eacute;|&#233;", "é"), ("&egrave;|&#232;", "è"), ("&ecirc;|&#234;", "ê"),
    ("&agrave;|&#224;", "à"), ("&ccedil;|&#231;", "ç"), ("&ocirc;|&#244;", "ô"), ("&amp;", "&"),
]
# Order matters: list items, block ends, breaks, inline tags, every other tag, runs of blanks.
TAG_STEPS = [
    ("(?i)<li[^>]*>", "\n• "),
    ("(?i)</(p|div|h[1-6]|ul|ol|li|tr)>", "\n"),
    (r"(?i)<br\s*/?>", "\n"),
    (r"(?i)</?(strong|b|em|i|u|span|a|code|small|sup|sub|font|mark)\b[^>]*>", ""),
    ("<[^>]+>", " "),
    ("[ \\t\\u00a0]+", " "),
]
# Posting ids of an address.
URL_IDS = r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|\d{5,}"
