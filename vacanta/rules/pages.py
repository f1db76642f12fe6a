"""Fixed values of the page rules: postings in HTML, job links, site maps."""

LD_JSON = r"(?is)<script[^>]+application/ld\+json[^>]*>(.*?)</script>"
TITLE_TAIL = r"\s*[|·–-]\s*[^|·–-]{2,40}$"
NOT_A_JOB = r"(?i)candidature spontan|spontaneous application|open application|newsletter|toutes nos offres|all jobs"
SKIPPED_BLOCKS = ["script", "style", "noscript", "svg", "header", "footer", "nav"]
LINK = r'(?is)<a\b[^>]*href="([^"#]+)"[^>]*>(.*?)</a>'
JOB_PATH = r"(?i)/(jobs?|offres?(-d-emploi)?|annonces?|emplois?|postes?|careers?|carrieres?|job-offers?|positions?|vacanc(y|ies)|opportunit(y|ies)|recrutement)/[^?#]*[a-z0-9-]{6,}"
SITE_MAP_LOC = r"<loc>\s*([^<\s]+)\s*</loc>"
SITE_MAP_FILE = r"(?i)\.xml(\.gz)?$"
SITE_MAP_FOLLOWED = r"(?i)job|offre|emploi|career|carriere|poste|vacanc|sitemap\d|sitemap_index"
MIN_CHARS = 400
TITLE_CHARS = 140
HEAD_LINES = 30
UNKNOWN_EMPLOYER = "Entreprise non communiquée"
