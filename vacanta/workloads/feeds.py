"""Documents written as the payloads of every feed family, and read back by its reader.

Document d goes to family d % 14; its kind (0, 1, 2) and the years it asks follow from its number. Payloads hold a page of
documents each. The oracle states what each family's codes mean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vacanta.plans import collection as C
from vacanta.session import settle
from vacanta.sources import feeds as S
from vacanta.workloads.binding import table
from vacanta.workloads.registry import query

FAMILIES = ["greenhouse", "lever", "ashby", "smartrecruiters", "workable", "recruitee", "teamtailor", "personio", "digitalrecruiters", "welcomekit", "workday", "polymer", "adzuna", "jooble"]
PAGE = 280
DETAILED = {"smartrecruiters", "digitalrecruiters", "workday", "polymer"}
# What the kinds 0, 1, 2 of each family say, and what they mean.
CONTRACTS = {
    "greenhouse": ["Full-time", "Internship", None], "ashby": ["Intern", "Contract", "FullTime"], "smartrecruiters": ["permanent", "intern", "temporary"], "workable": ["Full-time", "Contract", "Temporary"],
    "recruitee": ["permanent_fulltime", "fixed_term_parttime", "internship"], "personio": ["permanent", "temporary", "trainee"], "digitalrecruiters": ["CDI", "CDD", "Stage"], "welcomekit": ["CDI", "Stage", "CDD"],
    "adzuna": ["permanent", "contract", None], "jooble": ["CDI", "Stage", None], "lever": ["Full-time"] * 3, "workday": ["Full time"] * 3, "polymer": [None, "Internship", None],
}
MEANT = {
    "greenhouse": ["cdi", "stage", "unknown"], "ashby": ["stage", "freelance", "cdi"], "smartrecruiters": ["cdi", "stage", "cdd"], "workable": ["cdi", "freelance", "cdd"], "recruitee": ["cdi", "cdd", "stage"],
    "personio": ["cdi", "cdd", "alternance"], "digitalrecruiters": ["cdi", "cdd", "stage"], "welcomekit": ["cdi", "stage", "cdd"], "adzuna": ["cdi", "freelance", "unknown"], "jooble": ["cdi", "stage", "unknown"],
    "lever": ["cdi"] * 3, "workday": ["cdi"] * 3, "polymer": ["unknown", "stage", "unknown"], "teamtailor": ["unknown"] * 3,
}
REMOTE = {"lever": ["remote", "hybrid", "onsite"], "smartrecruiters": ["remote", "unknown", "unknown"], "workable": ["unknown", "remote", "unknown"], "recruitee": ["unknown", "unknown", "hybrid"], "teamtailor": ["remote", "hybrid", "unknown"], "polymer": ["onsite", "hybrid", "remote"]}
CITIES = {"en": "Lyon", "fr": "Paris", "de": "Nantes", "es": "Lille"}


def _of(kind: Column, values: list) -> Column:
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), kind)


def documents(spark, sf, families: list[str]) -> DataFrame:
    """Documents as job offers, dealt over the families in turn."""
    d = table(spark, sf, "documents").filter("doc_id IS NOT NULL")
    city = F.lit(None).cast("string")
    for lang, name in CITIES.items():
        city = F.when(F.col("lang") == lang, name).otherwise(city)
    n = F.col("doc_id")
    said = F.concat(F.lit("Il faut "), (F.floor(n / 42) % 5 + 1).cast("string"), F.lit(" ans d'expérience."))
    return d.select(
        n.alias("n"), _of((n % len(families)).cast("int"), families).alias("family"), (F.floor(n / 14) % 3).cast("int").alias("kind"), F.floor(n / PAGE).alias("page"), F.coalesce("source", F.lit("none")).alias("token"),
        F.coalesce(city, F.lit("Lyon")).alias("city"), said.alias("said"), F.concat(F.lit("Poste "), n.cast("string")).alias("title"), F.concat(F.lit("https://example.org/"), n.cast("string")).alias("url"),
        F.date_format(F.timestamp_add("DAY", (n % 28).cast("int"), F.lit("2026-01-01 08:00:00").cast("timestamp")), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"),
    )


def jobs(d: DataFrame, family: str) -> tuple[DataFrame, DataFrame]:
    """(list entry, detail) of every document of a family, as JSON or XML text."""
    rows = d.filter(F.col("family") == family)
    c, s, kind = F.col, F.struct, F.col("kind")
    deal = _of(kind, CONTRACTS.get(family, [None] * 3))
    html = F.concat(F.lit("<p>"), c("said"), F.lit("</p>"))
    key, detail = c("n").cast("string"), s(c("said"))
    if family == "greenhouse":
        job = s(c("n").alias("id"), F.concat(F.lit(" "), "title", F.lit(" ")).alias("title"), c("url").alias("absolute_url"), F.concat(F.lit("&lt;p&gt;"), "said", F.lit("&lt;/p&gt;")).alias("content"), c("at").alias("updated_at"), s(c("city").alias("name")).alias("location"), F.array(s(F.lit("Employment Type").alias("name"), deal.alias("value"))).alias("metadata"))
    elif family == "lever":
        job = s(key.alias("id"), c("title").alias("text"), c("url").alias("hostedUrl"), F.unix_millis(c("at").cast("timestamp")).alias("createdAt"), _of(kind, ["remote", "hybrid", "onsite"]).alias("workplaceType"), s(c("city").alias("location"), deal.alias("commitment")).alias("categories"), c("said").alias("descriptionPlain"))
    elif family == "ashby":
        job = s(key.alias("id"), "title", c("city").alias("location"), deal.alias("employmentType"), c("url").alias("jobUrl"), c("at").alias("publishedAt"), c("said").alias("descriptionPlain"))
    elif family == "smartrecruiters":
        job = s(key.alias("id"), c("title").alias("name"), c("at").alias("releasedDate"), s("city", F.lit("fr").alias("country"), (kind == 0).alias("remote")).alias("location"), s(deal.alias("id")).alias("typeOfEmployment"))
        detail = s(c("url").alias("postingUrl"), s(s(s(F.lit("Poste").alias("title"), html.alias("text")).alias("jobDescription")).alias("sections")).alias("jobAd"))
    elif family == "workable":
        job = s("title", key.alias("shortcode"), deal.alias("employment_type"), (kind == 1).alias("telecommuting"), "url", c("at").alias("published_on"), F.array(s(F.lit("France").alias("country"), "city")).alias("locations"), html.alias("description"))
    elif family == "recruitee":
        job = s("title", html.alias("description"), "city", F.lit("France").alias("country"), (kind == 2).alias("hybrid"), deal.alias("employment_type_code"), c("url").alias("careers_url"), c("at").alias("published_at"))
    elif family == "digitalrecruiters":
        job = s(c("n").alias("job_ad_id"), "title", deal.alias("contract"), c("city").alias("location"), key.alias("url"))
        detail = s(html.alias("description"), F.translate(F.substring("at", 1, 19), "T", " ").alias("republished_at"))
    elif family == "welcomekit":
        job = s(key.alias("reference"), c("title").alias("name"), html.alias("description"), c("at").alias("published_at"), s("city", s(F.lit("France").alias("en")).alias("country")).alias("office"), s(deal.alias("fr")).alias("contract_type"), F.array(s(F.lit("own").alias("website_reference"), "url")).alias("websites_urls"))
    elif family == "workday":
        job = s("title", key.alias("externalPath"))
        detail = s(s("title", html.alias("jobDescription"), c("city").alias("location"), s(F.lit("France").alias("descriptor")).alias("country"), deal.alias("timeType"), F.substring("at", 1, 10).alias("startDate"), c("url").alias("externalUrl")).alias("jobPostingInfo"))
    elif family == "polymer":
        job = s(c("n").alias("id"), "title", "city", F.lit("France").alias("country"), deal.alias("kind_pretty"), _of(kind, ["No remote", "Hybrid", "Remote"]).alias("remoteness_pretty"), c("at").alias("published_at"), c("url").alias("job_post_url"))
        detail = s(html.alias("description"))
    elif family == "adzuna":
        job = s(key.alias("id"), "title", s(F.lit("Maison").alias("display_name")).alias("company"), s(c("city").alias("display_name")).alias("location"), c("said").alias("description"), c("url").alias("redirect_url"), deal.alias("contract_type"), c("at").alias("created"))
    elif family == "jooble":
        job = s(key.alias("id"), "title", c("city").alias("location"), c("said").alias("snippet"), deal.alias("type"), c("url").alias("link"), c("at").alias("updated"))
    else:
        return rows.select("token", "page", _xml(family, deal).alias("job")), rows.limit(0)
    return rows.select("token", "page", F.to_json(job).alias("job")), rows.select("token", key.alias("key"), F.to_json(detail).alias("payload"))


def _xml(family: str, deal: Column) -> Column:
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))
    if family == "teamtailor":
        place = tag("tt:locations", tag("tt:location", F.concat(tag("tt:city", F.col("city")), tag("tt:country", F.lit("France")))))
        published = F.date_format(F.col("at").cast("timestamp"), "'Day,' d MMM yyyy HH:mm:ss '+0000'")
        return tag("item", F.concat(tag("title", F.col("title")), tag("description", F.concat(F.lit("&lt;p&gt;"), "said", F.lit("&lt;/p&gt;"))), tag("pubDate", published), tag("link", F.col("url")), tag("remoteStatus", _of(F.col("kind"), ["fully", "hybrid", "none"])), place))
    text = tag("jobDescriptions", tag("jobDescription", F.concat(tag("name", F.lit("Poste")), tag("value", F.concat(F.lit("<![CDATA[<p>"), "said", F.lit("</p>]]>"))))))
    return tag("position", F.concat(tag("id", F.col("n").cast("string")), tag("office", F.col("city")), tag("name", F.col("title")), tag("employmentType", deal), tag("createdAt", F.col("at")), text))


WRAPS = {"lever": "[%s]", "smartrecruiters": '{"content":[%s]}', "recruitee": '{"offers":[%s]}', "digitalrecruiters": '{"items":[%s]}', "polymer": '{"items":[%s]}', "workday": '{"jobPostings":[%s]}', "adzuna": '{"results":[%s]}',
         "teamtailor": "<rss><channel><title>Maison</title>%s</channel></rss>", "personio": "<workzag-jobs>%s</workzag-jobs>"}


def landing(d: DataFrame, family: str) -> tuple[DataFrame, DataFrame]:
    """(payloads, details) of a family; a payload holds a page of one board, `PAGE` documents at most."""
    listed, details = jobs(d, family)
    before, after = WRAPS.get(family, '{"jobs":[%s]}').split("%s")
    by = "" if family in ("teamtailor", "personio") else ","
    paged = listed.groupBy("token", "page").agg(F.concat(F.lit(before), F.array_join(F.sort_array(F.collect_list("job")), by), F.lit(after)).alias("payload"))
    none = F.lit(None).cast("string")
    return paged.select("token", F.lit("Maison").alias("board_name"), none.alias("domain"), "payload", F.col("page").cast("int").alias("page"), none.alias("searched")), details


def feeds(spark, sf, only: str = "true", families: list[str] | None = None) -> list[DataFrame]:
    """The families read back, all of them unless some are named; `only` picks documents by n."""
    families = families or FAMILIES
    d = documents(spark, sf, families).filter(only)
    out = []
    for family in families:
        payloads, details = landing(d, family)
        out.append(S.read_feed(payloads, family, **({"details": details} if family in DETAILED else {})))
    return out


def _choice(table_of: dict[str, list], missing: str) -> str:
    lists = ", ".join("[" + ", ".join(f"'{v}'" for v in table_of.get(f, [missing] * 3)) + "]" for f in FAMILIES)
    return f"list_extract(list_extract([{lists}], CAST(f + 1 AS INTEGER)), CAST(k + 1 AS INTEGER))"


_NAMES = "[" + ", ".join(f"'{f}'" for f in FAMILIES) + "]"


@query("feed_readers", f"""WITH d AS (SELECT doc_id, doc_id % 14 AS f, (doc_id // 14) % 3 AS k, (doc_id // 42) % 5 + 1 AS years, coalesce(source, 'none') AS token, lang FROM documents WHERE doc_id IS NOT NULL)
    SELECT 'Poste ' || doc_id AS title, list_extract({_NAMES}, CAST(f + 1 AS INTEGER)) || CASE WHEN f < 12 THEN ':' || token ELSE '' END AS source_key, {_choice(MEANT, 'unknown')} AS contract, {_choice(REMOTE, 'unknown')} AS remote,
      years, CASE lang WHEN 'fr' THEN 'Paris' WHEN 'de' THEN 'Nantes' WHEN 'es' THEN 'Lille' ELSE 'Lyon' END AS city, strftime(DATE '2026-01-01' + CAST(doc_id % 28 AS INTEGER), '%Y-%m-%d') AS published,
      'Il faut ' || years || ' ans d''expérience.' AS said, CASE WHEN f IN (3, 7) THEN 'Poste' ELSE '' END AS heading FROM d""")
def feed_readers(spark, sf):
    """Fourteen feed families united: place, contract, remote work, years, date and text of every offer."""
    o = S.union_feeds(*feeds(spark, sf))
    lines = F.split("text", "\n")
    return o.select(
        "title", "source_key", "contract", "remote", F.col("experience_min_years").alias("years"), F.get("places", F.lit(0))["city"].alias("city"), F.date_format("published_at", "yyyy-MM-dd").alias("published"),
        F.element_at(lines, -1).alias("said"), F.when(F.size(lines) > 1, F.get(lines, F.lit(0))).otherwise("").alias("heading"),
    )


COLLECTED = "2026-03-01 12:00:00"
# Two boards and two engines for the collection.
COLLECTED_FAMILIES = ["greenhouse", "lever", "adzuna", "jooble"]


def collection_tables(spark, sf):
    """Two thirds of the documents as known offers, two thirds as what feeds show now; some engine offers with a page of their own."""
    now = F.lit(COLLECTED).cast("timestamp")
    read = settle(C.normalise(S.union_feeds(*feeds(spark, sf, "n % 3 < 2", COLLECTED_FAMILIES)))).withColumn("n", F.regexp_extract("title", "[0-9]+", 0).cast("bigint"))
    engine = F.col("ats").isNull()
    paged = engine & (F.col("n") % 3 == 1) & (F.col("n") % 5 == 0)
    long = F.concat("text", F.repeat(F.lit(" Un quai, une grue, des caisses."), 50))
    none = F.lit(None).cast("timestamp")
    known = read.select(
        "dedup_key", "title", F.when(paged, long).otherwise(F.col("text")).alias("text"), F.array(F.struct(F.col("source_key").alias("source"), F.col("source_url").alias("url"))).alias("urls"), F.array("source_key").alias("sources"), "apply_url", "published_at",
        F.lit("2026-01-01").cast("timestamp").alias("first_seen_at"), F.timestamp_add("DAY", (-(F.col("n") % 40)).cast("int"), now).alias("last_seen_at"), none.alias("archived_at"), F.lit(0).alias("repost_count"), none.alias("reposted_at"), "company", paged.alias("paged"), "n",
    )
    own = known.filter("paged").withColumns({"dedup_key": F.concat(F.lit("own-"), "title"), "sources": F.array(F.lit("lever:elsewhere")), "urls": F.array(F.struct(F.lit("lever:elsewhere").alias("source"), F.col("apply_url").alias("url"))), "company": F.concat(F.lit("Atelier "), F.char(F.col("n") % 7 + 97))})
    followed = known.filter("n % 10 = 0").select("dedup_key")
    return feeds(spark, sf, "n % 3 > 0", COLLECTED_FAMILIES), settle(known.unionByName(own).drop("paged", "n")), followed, now


_COLLECTED = """d AS (SELECT doc_id AS n, doc_id % 4 AS f, coalesce(source, 'none') AS source, doc_id % 3 AS part FROM documents WHERE doc_id IS NOT NULL),
    boards AS (SELECT DISTINCT f, source FROM d WHERE part > 0 AND f < 2)"""


@query("collection_pass", f"""WITH {_COLLECTED}
    SELECT 'Poste ' || d.n AS title, false AS own, CASE WHEN part = 2 THEN false WHEN f < 2 THEN part = 0 AND b.f IS NOT NULL WHEN part = 0 THEN d.n % 40 > 21 ELSE d.n % 5 = 0 AND d.n % 10 <> 0 END AS archived, part = 2 AS new
    FROM d LEFT JOIN boards b USING (f, source) UNION ALL SELECT 'Poste ' || n, true, false, false FROM d WHERE f >= 2 AND part = 1 AND n % 5 = 0""")
def collection_pass(spark, sf):
    """A whole collection: new offers, those seen again, those gone from their boards, engine copies and silent engine offers."""
    shown, state, followed, now = collection_tables(spark, sf)
    out = C.collection_pass(shown, state, spark.createDataFrame([("maison",)], "name_key string"), followed, ["FR"], now)["offers"]
    return out.select("title", F.array_contains("sources", "lever:elsewhere").alias("own"), F.col("archived_at").isNotNull().alias("archived"), (F.col("first_seen_at") == now).alias("new"))


@query("collection_companies", f"WITH {_COLLECTED} SELECT DISTINCT 'Atelier ' || chr(CAST(97 + n % 7 AS INTEGER)) AS name FROM d WHERE f >= 2 AND part = 1 AND n % 5 = 0 UNION SELECT 'Entreprise non communiquée' FROM d WHERE f = 3")
def collection_companies(spark, sf):
    """Companies that the offers of a collection name and nobody knew."""
    shown, state, followed, now = collection_tables(spark, sf)
    return C.collection_pass(shown, state, spark.createDataFrame([("maison",)], "name_key string"), followed, ["FR"], now)["companies"].select("name")
