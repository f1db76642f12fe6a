"""Text jobs over whole tables: keys, HTML, contacts, redaction, addresses, signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacanta.columns import swap
from vacanta.functions import cv as C
from vacanta.functions import lines as N
from vacanta.functions import privacy as P
from vacanta.functions import relevance as V
from vacanta.functions import signals as S
from vacanta.functions import skills as K
from vacanta.functions import text as T
from vacanta.operators import market as M
from vacanta.rules import boards as BR
from vacanta.rules import privacy as PR
from vacanta.rules import relevance as VR
from vacanta.rules import signals as SR
from vacanta.rules import skills as KR
from vacanta.sources import boards as B
from vacanta.workloads import sqltext as Q
from vacanta.workloads.binding import NOW, OFFERS, ntz, offers, table
from vacanta.workloads.registry import query


@query("fold_texts", f"SELECT doc_id, md5({Q.fold('text')}) AS print FROM documents")
def fold_texts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.fold(F.col("text"))).alias("print"))


@query("slug_texts", f"SELECT doc_id, md5({Q.slug('text')}) AS print, length({Q.slug('text')}) AS n FROM documents")
def slug_texts(spark, sf):
    s = T.slug(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.md5(s).alias("print"), F.length(s).alias("n"))


@query(
    "company_keys",
    f"""SELECT name, {Q.company_key('name')} AS name_key FROM (
          SELECT s_name || ' Groupe SAS' AS name FROM supplier UNION ALL SELECT 'SARL ' || c_name || ' ' || c_mktsegment FROM customer)""",
)
def company_keys(spark, sf):
    s = table(spark, sf, "supplier").select(F.concat("s_name", F.lit(" Groupe SAS")).alias("name"))
    c = table(spark, sf, "customer").select(F.concat(F.lit("SARL "), "c_name", F.lit(" "), "c_mktsegment").alias("name"))
    return s.union(c).withColumn("name_key", T.company_key(F.col("name")))


@query(
    "dedup_keys",
    f"""SELECT concat_ws('|', {Q.company_key('s_name')}, {Q.slug("p_name || ' (H/F)'")}, {Q.slug('n_name')}) AS dedup_key, count(*) AS n
        FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY 1""",
)
def dedup_keys(spark, sf):
    li = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey")
    s = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    # Keys are built once per (part, supplier) pair, then counted.
    pairs = li.groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("c"))
    j = pairs.join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    key = T.dedup_key(F.col("s_name"), F.concat("p_name", F.lit(" (H/F)")), F.col("n_name"))
    return j.groupBy(key.alias("dedup_key")).agg(F.sum("c").alias("n"))


@query("html_to_text", f"SELECT page_id, md5({Q.html_to_text('html')}) AS print, length({Q.html_to_text('html')}) AS n FROM pages")
def html_texts(spark, sf):
    t = table(spark, sf, "pages").withColumn("t", T.html_to_text(F.col("html")))
    return t.select("page_id", F.md5("t").alias("print"), F.length("t").alias("n"))


@query("skill_keys", f"SELECT doc_id, md5({Q.skill_key('text')}) AS print FROM documents")
def skill_keys(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.skill_key(F.col("text"))).alias("print"))


_ALIAS = "CASE " + " ".join(f"WHEN k = {Q.lit(a)} THEN {Q.lit(b)}" for a, b in KR.ALIASES.items()) + " ELSE k END"


@query(
    "skill_labels",
    f"""WITH words AS (SELECT DISTINCT unnest(string_split({Q.skill_key('text')}, ' ')) AS k FROM documents)
        SELECT k, {_ALIAS} AS key, CASE WHEN regexp_matches(k, '^[a-zà-ÿ]') THEN upper(substr(k, 1, 1)) || substr(k, 2) ELSE k END AS label FROM words WHERE k <> ''""",
)
def skill_labels(spark, sf):
    words = table(spark, sf, "documents").select(F.explode(F.split(T.skill_key(F.col("text")), " ", -1)).alias("k")).filter("k <> ''").distinct()
    return words.select("k", K.skill_alias(F.col("k")).alias("key"), K.skill_label(F.col("k")).alias("label"))


_LOUD = [(p, c) for p, c in SR.CONTRACT_WORDS if c != "cdi"]
_STATED = "coalesce(" + ", ".join(f"nullif(regexp_extract(t, {Q.lit(p)}, 1), '')" for p in SR.CONTRACT_STATED) + ")"
_STATED_MAP = "CASE " + " ".join(f"WHEN regexp_replace({_STATED}, '[- ]', '', 'g') = {Q.lit(a)} THEN {Q.lit(b)}" for a, b in SR.CONTRACT_STATED_WORDS.items()) + " ELSE 'unknown' END"


@query(
    "contracts",
    f"""WITH t AS (SELECT conv_id, turn, {Q.fold("role || ' ' || turn || ' CDI'")} AS h, {Q.fold('text')} AS t FROM conversations
                   UNION ALL SELECT doc_id, -1, {Q.fold('string_split(text, chr(10))[1]')}, {Q.fold('text')} FROM documents)
        SELECT conv_id AS id, turn, coalesce({Q.first_rule('h', _LOUD)}, {Q.first_rule('h', SR.CONTRACT_WORDS)},
               CASE WHEN {_STATED} IS NOT NULL THEN {_STATED_MAP} END, {Q.first_rule('t', SR.CONTRACT_PROSE)}, 'unknown') AS contract FROM t""",
)
def contracts(spark, sf):
    cv = table(spark, sf, "conversations").select(F.col("conv_id").alias("id"), "turn", F.concat("role", F.lit(" "), F.col("turn").cast("string"), F.lit(" CDI")).alias("title"), "text")
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lit(-1).cast("bigint").alias("turn"), T.first_line(F.col("text")).alias("title"), "text")
    return cv.unionByName(d).select("id", "turn", S.detect_contract(F.col("title"), None, F.col("text")).alias("contract"))


@query(
    "remote_modes",
    f"""WITH t AS (SELECT doc_id, {Q.fold('text')} AS t FROM documents)
        SELECT CASE WHEN {Q.matches('t', SR.REMOTE_FULL)} THEN 'remote' WHEN {Q.matches('t', SR.REMOTE_DENIED)} THEN NULL
               WHEN {Q.matches('t', SR.REMOTE_SOME)} THEN 'hybrid' END AS remote, count(*) AS n FROM t GROUP BY 1""",
)
def remote_modes(spark, sf):
    return table(spark, sf, "documents").groupBy(S.detect_remote(F.col("text")).alias("remote")).agg(F.count("*").alias("n"))


@query(
    "experience_levels",
    f"""WITH t AS (SELECT {Q.fold('text')} AS t FROM documents UNION ALL SELECT {Q.fold('text')} FROM conversations)
        SELECT CASE WHEN {Q.matches('t', SR.JUNIOR_TEXT)} THEN 'junior' WHEN {Q.matches('t', SR.EXPERIENCED_TEXT)} THEN 'experienced' END AS level, count(*) AS n FROM t GROUP BY 1""",
)
def experience_levels(spark, sf):
    both = table(spark, sf, "documents").select("text").union(table(spark, sf, "conversations").select("text"))
    return both.groupBy(S.detect_experience_level(F.col("text")).alias("level")).agg(F.count("*").alias("n"))


_TITLE = "p_name || CASE WHEN p_size >= 40 THEN ' Head' WHEN p_size >= 30 THEN ' Principal' WHEN p_size >= 20 THEN ' Senior' WHEN p_size >= 10 THEN ' II' ELSE '' END || CASE WHEN p_type = 'SMALL' THEN ' Stage' WHEN p_type = 'ECONOMY' THEN ' Junior' ELSE '' END"


def part_titles(spark, sf):
    size, kind = F.col("p_size"), F.col("p_type")
    grade = F.when(size >= 40, " Head").when(size >= 30, " Principal").when(size >= 20, " Senior").when(size >= 10, " II").otherwise("")
    level = F.when(kind == "SMALL", " Stage").when(kind == "ECONOMY", " Junior").otherwise("")
    return table(spark, sf, "part").withColumn("title", F.concat("p_name", grade, level))


@query(
    "title_seniority",
    f"""WITH t AS (SELECT {Q.fold(_TITLE)} AS h FROM part)
        SELECT {Q.first_rule('h', SR.TITLE_YEARS, '0')} AS years, {Q.matches('h', SR.JUNIOR_TITLE)} AS junior, {Q.matches('h', SR.STUDENT_TITLE)} AS student, count(*) AS n FROM t GROUP BY ALL""",
)
def title_seniority(spark, sf):
    t = part_titles(spark, sf).withColumn("h", T.rule_text(F.col("title")))
    return t.groupBy(S.seniority_in(F.col("h")).alias("years"), S.has_junior_title(F.col("h")).alias("junior"), S.is_student(F.col("h"), F.lit("cdi")).alias("student")).agg(F.count("*").alias("n"))


@query(
    "experience_labels",
    """WITH t AS (SELECT CAST(floor(l_quantity / 10) AS INTEGER) AS lo, CASE WHEN l_tax > 0.04 THEN CAST(floor(l_quantity / 8) AS INTEGER) END AS hi,
                 CASE l_returnflag WHEN 'A' THEN 'junior' WHEN 'R' THEN 'experienced' END AS level, l_linestatus FROM lineitem),
       u AS (SELECT CASE WHEN l_linestatus = 'O' THEN lo END AS lo, hi, level FROM t)
       SELECT coalesce(CASE WHEN lo IS NULL THEN NULL WHEN hi > lo THEN lo || ' à ' || hi || ' ans' WHEN lo = 0 THEN 'Débutant accepté'
                WHEN lo > 1 THEN lo || ' ans et plus' ELSE lo || ' an et plus' END,
              CASE level WHEN 'junior' THEN 'Profil junior accepté' WHEN 'experienced' THEN 'Expérience significative demandée' END) AS label, count(*) AS n FROM u GROUP BY 1""",
)
def experience_labels(spark, sf):
    li = table(spark, sf, "lineitem")
    level = F.when(F.col("l_returnflag") == "A", "junior").when(F.col("l_returnflag") == "R", "experienced")
    low = F.when(F.col("l_linestatus") == "O", F.floor(F.col("l_quantity") / 10).cast("int"))
    high = F.when(F.col("l_tax") > 0.04, F.floor(F.col("l_quantity") / 8).cast("int"))
    return li.groupBy(S.experience_text(low, high, level).alias("label")).agg(F.count("*").alias("n"))


@query(
    "salary_midpoints",
    """WITH t AS (SELECT p_partkey, CAST(floor(p_retailprice) AS BIGINT) AS a, p_type FROM part),
       y AS (SELECT p_partkey, CASE WHEN p_type = 'SMALL' THEN NULL ELSE a * 12 / 1000.0 END AS v FROM t)
       SELECT p_partkey, CASE WHEN v BETWEEN 15 AND 300 THEN CAST(floor(v + 0.5) AS BIGINT) END AS k FROM y""",
)
def salary_midpoints(spark, sf):
    pay = F.concat(F.floor("p_retailprice").cast("string"), F.lit(" € "), F.when(F.col("p_type") == "SMALL", "net ").otherwise(""), F.lit("par mois"))
    return table(spark, sf, "part").select("p_partkey", S.salary_midpoint(pay).alias("k"))


@query("posting_signals")
def posting_signals(spark, sf):
    """Every signal of every document in one pass (context rules have no SQL form; golden cases check them)."""
    d = offers(spark, sf).select("offer_id", "title", "text")
    s = S.with_signals(d)
    return s.select("offer_id", "contract", "remote_text", "experience_min_years", "experience_max_years", "experience_level", "salary_text", "title_years")


@query("redact_email", f"SELECT doc_id, md5(regexp_replace(text, {Q.lit(PR.EMAIL)}, '[email]', 'g')) AS print FROM documents")
def redact_email(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(swap(F.col("text"), PR.EMAIL, "[email]")).alias("print"))


_ADDRESSES = "text"
for _pattern, _mark in [(PR.EMAIL, "[email]"), (PR.LINK, "[lien]"), (PR.STREET, "[adresse]"), (PR.POSTCODE_TOWN, "[adresse]")]:
    _ADDRESSES = f"regexp_replace({_ADDRESSES}, {Q.lit(Q.re2(_pattern))}, '{_mark}', 'g')"


@query("redact_addresses", f"SELECT conv_id, turn, md5({_ADDRESSES}) AS print FROM conversations")
def redact_addresses(spark, sf):
    out = F.col("text")
    for pattern, mark in [(PR.EMAIL, "email"), (PR.LINK, "link"), (PR.STREET, "address"), (PR.POSTCODE_TOWN, "address")]:
        out = swap(out, pattern, PR.PLACEHOLDERS[mark])
    return table(spark, sf, "conversations").select("conv_id", "turn", F.md5(out).alias("print"))


@query("redact_texts")
def redact_texts(spark, sf):
    """All redaction rules on whole texts; phones need the digits counted inside each match."""
    d = table(spark, sf, "documents").withColumn("clean", P.redact(F.col("text")))
    return d.select("doc_id", F.length("clean").alias("n"), (F.col("clean") != F.col("text")).alias("changed"))


_PHONE = f"len(list_filter(regexp_extract_all(text, {Q.lit(PR.PHONE)}), lambda m: length(regexp_replace(m, '[^0-9]', '', 'g')) >= {PR.PHONE_DIGITS})) > 0"


@query(
    "contacts",
    f"""SELECT 'document' AS kind, doc_id AS id, regexp_matches(text, {Q.lit(PR.EMAIL)}) AS email, {_PHONE} AS phone FROM documents
        UNION ALL SELECT 'turn', conv_id * 1000 + turn, regexp_matches(text, {Q.lit(PR.EMAIL)}), {_PHONE} FROM conversations""",
)
def contacts(spark, sf):
    d = table(spark, sf, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    c = table(spark, sf, "conversations").select(F.lit("turn").alias("kind"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return d.union(c).select("kind", "id", P.has_email(F.col("text")).alias("email"), P.has_phone(F.col("text")).alias("phone"))


@query(
    "clean_domains",
    r"""WITH t AS (SELECT page_id, regexp_replace(regexp_replace(lower(trim(url)), '^https?://', ''), '^www\.', '') AS u FROM pages)
        SELECT regexp_replace(u, '/.*$', '') AS domain, count(*) AS n FROM t GROUP BY 1""",
)
def clean_domains(spark, sf):
    return table(spark, sf, "pages").groupBy(T.clean_domain(F.col("url")).alias("domain")).agg(F.count("*").alias("n"))


@query(
    "url_ids",
    r"""SELECT page_id, array_to_string(regexp_extract_all(url || '/' || CAST(page_id * 7919 + 10000 AS VARCHAR), '(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|\d{5,}'), ',') AS ids FROM pages""",
)
def url_ids(spark, sf):
    url = F.concat("url", F.lit("/"), (F.col("page_id") * 7919 + 10000).cast("string"))
    return table(spark, sf, "pages").select("page_id", F.array_join(T.url_ids(url), ",").alias("ids"))


@query(
    "slug_guesses",
    f"""WITH k AS (SELECT s_suppkey, {Q.slug(Q.company_key("replace(s_name, '#', ' ') || ' SAS'"))} AS k FROM supplier)
        SELECT s_suppkey, unnest(list_distinct([replace(k, ' ', ''), replace(k, ' ', '-')])) AS token FROM k WHERE length(replace(k, ' ', '')) >= 2""",
)
def slug_guesses(spark, sf):
    name = F.concat(F.translate("s_name", "#", " "), F.lit(" SAS"))
    return table(spark, sf, "supplier").select("s_suppkey", F.explode(T.slug_guesses(name)).alias("token"))


_START = r"(?im)^(.{0,40})\b(the|les|der|los|que|of)\b"


@query(
    "focused_excerpts",
    f"""WITH t AS (SELECT doc_id, text, regexp_extract(text, {Q.lit(_START)}, 0) AS f FROM documents),
        u AS (SELECT doc_id, text, CASE WHEN f <> '' THEN strpos(text, f) ELSE 0 END AS a FROM t),
        v AS (SELECT doc_id, text, a, substr(text, a, 1900) AS s FROM u)
        SELECT doc_id, md5(CASE WHEN length(text) <= 3200 THEN text WHEN a = 0 THEN substr(text, 1, 3200)
               ELSE substr(text, 1, 3200 - length(s) - 20) || chr(10) || '[…]' || chr(10) || s END) AS print FROM v""",
)
def focused_excerpts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(N.focused_excerpt(F.col("text"), start=_START.replace(r"\b", r"(?<![A-Za-z0-9_])", 1).replace(r"\b", r"(?![A-Za-z0-9_])"))).alias("print"))


@query("structured_texts")
def structured_texts(spark, sf):
    """Texts given headings, bullets and paragraphs back, and the introduction found in them."""
    d = table(spark, sf, "documents").withColumn("t", N.structure_text(F.col("text")))
    return d.select("doc_id", F.length("t").alias("n"), F.size(F.split("t", "\n")).alias("lines"), N.intro_from(F.col("t"), introduction=r"(?i)^[a-z]+.{0,40}$").isNotNull().alias("introduced"))


@query(
    "judge_keys",
    """SELECT c_custkey, substr(sha1('{"rules":"10","segment":"' || c_mktsegment || '","nation":"' || c_nationkey || '","name":"' || c_name || '"}'), 1, 16) AS judge_key FROM customer""",
)
def judge_keys(spark, sf):
    from vacanta.operators.gates import judge_key

    parts = [F.lit("10").alias("rules"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("string").alias("nation"), F.col("c_name").alias("name")]
    return table(spark, sf, "customer").select("c_custkey", judge_key(parts).alias("judge_key"))


@query(
    "posting_ages",
    f"""WITH {OFFERS}, t AS (SELECT offer_id, posted_at, posted_at + INTERVAL 2 DAY AS reposted_at, lang, floor(epoch(TIMESTAMP '{NOW}' - posted_at) / 86400) AS age FROM offers)
        SELECT offer_id, lang = 'fr' AS reposted, CASE WHEN age >= 90 THEN 'over_90_days' WHEN age >= 30 THEN 'over_30_days' END AS age FROM t""",
)
def posting_ages(spark, sf):
    o = offers(spark, sf)
    age = M.posting_age(F.col("posted_at"), F.col("posted_at") + F.expr("INTERVAL 2 DAYS"), (F.col("lang") == "fr").cast("int"), F.col("posted_at"), ntz(NOW))
    return o.withColumn("a", age).select("offer_id", "a.reposted", "a.age")


_TOKENS = Q.fold(_TITLE)
for _p, _one in VR.SET_PHRASES:
    _TOKENS = f"regexp_replace({_TOKENS}, {Q.lit(_p)}, '{_one}', 'g')"
_TOKENS = f"list_filter(string_split_regex({_TOKENS}, '[^a-z0-9+#]+'), lambda t: length(t) >= 2 AND t NOT IN {Q.one_of(VR.STOP)})"


@query("title_tokens", f"SELECT p_partkey, array_to_string({_TOKENS}, ' ') AS words FROM part")
def title_tokens(spark, sf):
    return part_titles(spark, sf).select("p_partkey", F.array_join(V.tokens(F.col("title")), " ").alias("words"))


@query(
    "training_titles",
    f"""WITH t AS (SELECT CASE WHEN p_type = 'LARGE' THEN 'Formation ' ELSE '' END || {_TITLE} AS h FROM part)
        SELECT {Q.matches('h', SR.TRAINING_TITLE)} AS training, {Q.matches('h', SR.JUNIOR_VIEW)} AS junior, count(*) AS n FROM t GROUP BY ALL""",
)
def training_titles(spark, sf):
    t = part_titles(spark, sf).withColumn("title", F.concat(F.when(F.col("p_type") == "LARGE", "Formation ").otherwise(""), "title"))
    none = F.lit(None)
    return t.groupBy(S.is_training(F.col("title")).alias("training"), S.is_junior(F.col("title"), none.cast("int"), none.cast("string"), none.cast("string")).alias("junior")).agg(F.count("*").alias("n"))


@query(
    "closed_pages",
    f"SELECT page_id, {Q.matches(Q.html_to_text('html') + ' || CASE WHEN length(html) > 4000 THEN chr(10) || {} ELSE {} END'.format(Q.lit('This position has been filled.'), Q.lit('')), SR.CLOSED_POSTING)} AS closed FROM pages",
)
def closed_pages(spark, sf):
    note = F.when(F.length("html") > 4000, "\nThis position has been filled.").otherwise("")
    return table(spark, sf, "pages").select("page_id", S.is_closed(F.concat(T.html_to_text(F.col("html")), note)).alias("closed"))


_GRID = f"""WITH t AS (SELECT conv_id, turn, text, {Q.fold('text')} AS n FROM conversations),
u AS (SELECT conv_id, turn,
  CASE WHEN length(regexp_replace(text, '\\s', '', 'g')) >= 800 THEN 12 WHEN length(regexp_replace(text, '\\s', '', 'g')) >= 300 THEN 6 ELSE 0 END AS readable_text,
  CASE WHEN regexp_matches(text, {Q.lit(PR.EMAIL)}) THEN 3 ELSE 0 END AS email, CASE WHEN {_PHONE} THEN 3 ELSE 0 END AS phone,
  CASE WHEN len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) BETWEEN 250 AND 900 THEN 3 ELSE 0 END AS length,
  CASE WHEN len(list_distinct(regexp_extract_all(text, {Q.lit(PR.CV_YEARS)}, 1))) >= 2 THEN 3 ELSE 0 END AS dates FROM t)
SELECT * FROM u"""


@query("cv_grid", _GRID)
def cv_grid(spark, sf):
    c = table(spark, sf, "conversations")
    cvs = c.select("conv_id", "turn", "text", F.lit(1).alias("pages"), F.lit(0.0).alias("column_ratio"), F.lit(0).alias("spaced_titles"), F.lit("cv.pdf").alias("filename"), F.lit(1000).alias("size_bytes"), F.array().cast("array<string>").alias("expected"))
    g = C.score_cvs(cvs)
    return g.select("conv_id", "turn", *[F.col(f"points_{n}").alias(n) for n in ("readable_text", "email", "phone", "length", "dates")])


# The reading pages live on invented hosts, so their patterns are given as parameters.
TEST_BOARDS = [("net", r"(?i)https?://(?:www\.|m\.|blog\.)?([a-z0-9-]+)\.example\.net"), ("org", r"(?i)https?://(?:www\.|m\.|blog\.)?([a-z0-9-]+)\.example\.org"), ("com", r"(?i)https?://(?:www\.|m\.|blog\.)?([a-z0-9-]+)\.example\.com")]
TEST_PLATFORMS = [("mobile", r"(?i)//m\."), ("blog", r"(?i)//blog\.")]
_HITS = ", ".join(f"lower(nullif(regexp_extract(url, {Q.lit(p)}, 1), '')) AS t_{a}" for a, p in TEST_BOARDS)
_KEPT = {a: f"(t_{a} IS NOT NULL AND t_{a} NOT IN {Q.one_of(BR.NOT_A_COMPANY)})" for a, _ in TEST_BOARDS}
BOARD_SQL = f"""WITH t AS (SELECT page_id, {_HITS} FROM pages)
SELECT page_id, CASE {' '.join(f"WHEN {_KEPT[a]} THEN '{a}'" for a, _ in TEST_BOARDS)} END AS ats, CASE {' '.join(f"WHEN {_KEPT[a]} THEN t_{a}" for a, _ in TEST_BOARDS)} END AS token FROM t"""
CRAWL_SQL = f"""WITH t AS (SELECT {_HITS} FROM pages), u AS ({' UNION '.join(f"SELECT '{a}' AS ats, t_{a} AS token FROM t" for a, _ in TEST_BOARDS)})
SELECT ats, token, 'crawl' AS via FROM u WHERE token IS NOT NULL AND token NOT IN {Q.one_of(BR.NOT_A_COMPANY_IN_CRAWL)}"""
PLATFORM_SQL = f"SELECT {Q.first_rule('url', [(p, n) for n, p in TEST_PLATFORMS])} AS platform, count(*) AS n FROM pages GROUP BY 1"


@query("board_of_pages", BOARD_SQL)
def board_of_pages(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", B.board_from(F.col("url"), TEST_BOARDS).alias("b")).select("page_id", "b.ats", "b.token")


@query("crawl_boards", CRAWL_SQL)
def crawl_boards(spark, sf):
    return B.crawl_candidates(table(spark, sf, "pages").select(F.concat(F.lit('{"url": "'), "url", F.lit('"}')).alias("line")), TEST_BOARDS)


@query("platforms", PLATFORM_SQL)
def platforms(spark, sf):
    return table(spark, sf, "pages").groupBy(B.platform_of(F.col("url"), TEST_PLATFORMS).alias("platform")).agg(F.count("*").alias("n"))
