"""Fixed values of the board rules: where career pages live and how their names are written."""

ATS = ["greenhouse", "lever", "ashby", "smartrecruiters", "workable", "recruitee", "teamtailor", "personio", "digitalrecruiters", "welcomekit", "site", "workday", "polymer"]
# Boards named by a domain, a reference or an address are never guessed from a company name.
NOT_GUESSED = ["digitalrecruiters", "welcomekit", "site", "workday", "polymer"]
IN_TEXT = [
    ("digitalrecruiters", r"(?i)api\.digitalrecruiters\.com/careers/v1/careers-sites/([a-z0-9.-]+\.[a-z]{2,})"),
    ("greenhouse", r"(?i)greenhouse\.io/embed/job_board(?:/js)?\?for=([a-z0-9_-]+)"),
    ("greenhouse", r"(?i)(?:job-)?boards(?:-api)?\.greenhouse\.io/(?:v1/boards/)?([a-z0-9_-]+)"),
    ("lever", r"(?i)jobs\.(?:eu\.)?lever\.co/([a-z0-9_.-]+)"),
    ("ashby", r"(?i)jobs\.ashbyhq\.com/([a-z0-9_.%-]+)"),
    ("smartrecruiters", r"(?i)(?:jobs|careers)\.smartrecruiters\.com/([a-z0-9_-]+)"),
    ("workable", r"(?i)apply\.workable\.com/([a-z0-9_-]+)"),
    ("recruitee", r"(?i)([a-z0-9-]+)\.recruitee\.com"),
    ("teamtailor", r"(?i)([a-z0-9-]+)\.teamtailor\.com"),
    ("personio", r"(?i)([a-z0-9-]+)\.jobs\.personio\.(?:de|com)"),
    ("workday", r"(?i)([a-z0-9-]+\.wd\d+\.myworkdayjobs\.com)/(?:[a-z]{2}-[A-Z]{2}/)?([A-Za-z0-9_-]+)"),
    ("polymer", r"(?i)jobs\.polymer\.co/([a-z0-9-]{8,})"),
    ("welcomekit", r"(?i)data-organization-reference=\"([A-Za-z0-9]+)\""),
    ("welcomekit", r"(?i)WelcomeKitEmbed\(\s*['\"]([A-Za-z0-9]+)['\"]"),
]
CASE_KEPT = ["welcomekit", "workday"]
NOT_A_COMPANY = ["www", "api", "embed", "v1", "app", "careers", "jobs", "j", "widget", "boards", "job_board"]
IN_CRAWL = [
    ("greenhouse", r"(?i)^https?://boards\.greenhouse\.io/([^/?#]+)"),
    ("greenhouse", r"(?i)^https?://job-boards\.greenhouse\.io/([^/?#]+)"),
    ("lever", r"(?i)^https?://jobs\.lever\.co/([^/?#]+)"),
    ("ashby", r"(?i)^https?://jobs\.ashbyhq\.com/([^/?#]+)"),
    ("smartrecruiters", r"(?i)^https?://jobs\.smartrecruiters\.com/([^/?#]+)"),
    ("workable", r"(?i)^https?://apply\.workable\.com/([^/?#]+)"),
    ("recruitee", r"(?i)^https?://([a-z0-9-]+)\.recruitee\.com"),
    ("teamtailor", r"(?i)^https?://([a-z0-9-]+)\.teamtailor\.com"),
    ("personio", r"(?i)^https?://([a-z0-9-]+)\.jobs\.personio\.de"),
]
NOT_A_COMPANY_IN_CRAWL = ["www", "api", "embed", "v1", "app", "career", "careers", "jobs", "oauth", "static", "assets", "j", "widget", "login"]
PLATFORMS = [
    ("Welcome to the Jungle", r"(?i)welcometothejungle\.com/[a-z]{2}/companies/[a-z0-9-]+|welcomekit\.co"),
    ("SuccessFactors", r"(?i)successfactors\.(com|eu)|jobs\.sap\.com"),
    ("Taleo", r"(?i)taleo\.net"),
    ("Talentsoft", r"(?i)talent-soft\.com|talentsoft"),
    ("Jobaffinity", r"(?i)jobaffinity\.fr"),
    ("Flatchr", r"(?i)flatchr\.io"),
    ("Taleez", r"(?i)taleez\.com"),
    ("iCIMS", r"(?i)icims\.com"),
]
