"""Feed snapshots read as normalised offers.

`landing` holds one payload per board and run: token, board_name, domain, payload (and, for search engines,
the name searched). Feeds with a list and details take the details apart: token, key, payload. Every
reader ends in the same columns, so feeds are united by name.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from vacanta.columns import fixed_map, strings, strip
from vacanta.functions.geo import parse_locations
from vacanta.functions.signals import detect_contract, detect_experience
from vacanta.functions.text import company_key, html_to_text
from vacanta.rules import feeds as R

OFFER = [
    "source_key", "source_url", "company", "domain", "ats", "token", "title", "location_raw", "places", "remote", "remote_scope", "contract",
    "experience_min_years", "text", "apply_url", "published_at", "image_url",
]
BOARD = ["token", "board_name", "domain"]


def union_feeds(*feeds: DataFrame) -> DataFrame:
    """All feeds as one table, columns matched by name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), feeds)


def _joined(*parts: Column, by: str = ", ") -> Column:
    """Parts that say something, side by side."""
    return F.array_join(F.filter(F.array(*[F.coalesce(p, F.lit("")) for p in parts]), lambda x: x != ""), by)


def _html(c: Column) -> Column:
    return html_to_text(F.coalesce(c, F.lit("")))


def _code(family: str, c: Column) -> Column:
    return F.try_element_at(fixed_map(R.EMPLOYMENT[family]), c)


def _or_blank(c: Column, other: Column) -> Column:
    return F.coalesce(F.nullif(strip(c), F.lit("")), other)


def finish(df: DataFrame, family: str, engine: bool = False) -> DataFrame:
    """Places, contract and experience from the columns every reader gives: title, raw, context, said_remote,
    weak_remote, employment, text, url, company, published, and optionally default_country, image, experience_text."""
    have = set(df.columns)
    located = parse_locations(df, "raw", "context")
    none = F.lit(None).cast("string")
    if "default_country" in have:
        there = F.array(F.struct(none.alias("city"), none.alias("region"), F.col("default_country").alias("country")))
        located = located.withColumn("places", F.when(F.size("places") > 0, F.col("places")).otherwise(there))
    # A field of the feed wins; one that only says "on site" fills a silence.
    weak = F.col("weak_remote") if "weak_remote" in have else none
    remote = F.coalesce(F.col("said_remote"), F.when((F.col("remote") == "unknown") & weak.isNotNull(), weak), F.col("remote"))
    years = F.col("experience_text") if "experience_text" in have else F.col("text")
    key = F.lit(family) if engine else F.concat(F.lit(f"{family}:"), F.col("token"))
    return located.withColumns({
        "remote": remote, "source_key": key, "source_url": F.col("url"), "apply_url": F.col("url"), "ats": F.lit(None if engine else family).cast("string"),
        "title": strip(F.col("title")), "location_raw": F.nullif(F.col("shown_place") if "shown_place" in have else F.col("raw"), F.lit("")),
        "contract": detect_contract(F.col("title"), F.col("employment"), F.col("text")), "experience_min_years": detect_experience(years)["min"],
        "published_at": F.col("published").try_cast("timestamp"), "image_url": F.col("image") if "image" in have else none,
        **({"token": none, "domain": none} if engine else {}),
    }).select(*OFFER)


def _each(landing: DataFrame, schema: str, field: str | None, extra: list[str] | None = None) -> DataFrame:
    parsed = landing.withColumn("_p", F.from_json("payload", schema))
    items = F.col(f"_p.{field}") if field else F.col("_p")
    return parsed.select(*BOARD, *(extra or []), F.col("_p"), F.posexplode(items).alias("at", "j"))


def greenhouse(landing: DataFrame, context: int | None = None) -> DataFrame:
    """Place and remote work are read in the title and the text: the whole of it, or its first `context` characters."""
    j = _each(landing, R.GREENHOUSE, "jobs").withColumn("text", _html(F.col("j.content")))
    kind = F.get(F.filter("j.metadata", lambda m: m["name"].rlike(R.EMPLOYMENT_FIELD)), F.lit(0))["value"]
    return finish(j.select(*BOARD, "text", F.col("j.title").alias("title"), F.col("j.location.name").alias("raw"), F.concat_ws("\n", "j.title", F.substring("text", 1, context) if context else F.col("text")).alias("context"), F.lit(None).cast("string").alias("said_remote"), kind.alias("employment"), F.col("j.absolute_url").alias("url"), F.col("board_name").alias("company"), F.coalesce("j.first_published", "j.updated_at").alias("published")), "greenhouse")


def lever(landing: DataFrame) -> DataFrame:
    j = _each(landing, R.LEVER, None)
    lists = F.transform(F.coalesce("j.lists", F.array().cast("array<struct<text:string,content:string>>")), lambda l: F.concat(l["text"], F.lit("\n"), _html(l["content"])))
    text = F.array_join(F.filter(F.concat(F.array(F.coalesce(strip(F.col("j.descriptionPlain")), F.lit(""))), lists, F.array(F.coalesce(strip(F.col("j.additionalPlain")), F.lit("")))), lambda x: x != ""), "\n\n")
    kind = F.col("j.workplaceType")
    raw = _or_blank(F.array_join("j.categories.allLocations", "; "), F.col("j.categories.location"))
    return finish(j.select(*BOARD, text.alias("text"), F.col("j.text").alias("title"), raw.alias("raw"), F.concat(F.coalesce(kind, F.lit("")), F.lit("\n"), F.col("j.text")).alias("context"), F.when(kind.isin("remote", "hybrid"), kind).alias("said_remote"), F.when(kind == "onsite", "onsite").alias("weak_remote"), F.col("j.categories.commitment").alias("employment"), F.col("j.hostedUrl").alias("url"), F.col("board_name").alias("company"), F.timestamp_millis("j.createdAt").cast("string").alias("published")), "lever")


def ashby(landing: DataFrame) -> DataFrame:
    j = _each(landing, R.ASHBY, "jobs").filter(F.coalesce(F.col("j.isListed"), F.lit(True)))
    kind = F.lower("j.workplaceType")
    others = F.transform(F.coalesce("j.secondaryLocations", F.array().cast("array<struct<location:string>>")), lambda l: l["location"])
    raw = F.array_join(F.filter(F.concat(F.array("j.location"), others), lambda x: F.coalesce(x != "", F.lit(False))), "; ")
    text = F.when(F.length("j.descriptionHtml") > 0, _html(F.col("j.descriptionHtml"))).otherwise(F.coalesce("j.descriptionPlain", F.lit("")))
    url = F.coalesce("j.jobUrl", "j.applyUrl", F.concat(F.lit("https://jobs.ashbyhq.com/"), "token"))
    return finish(j.select(*BOARD, text.alias("text"), F.col("j.title").alias("title"), raw.alias("raw"), F.concat(F.coalesce("j.workplaceType", F.lit("")), F.lit("\n"), F.col("j.title")).alias("context"), F.when(kind.isin("remote", "hybrid"), kind).alias("said_remote"), F.when(kind == "onsite", "onsite").alias("weak_remote"), _code("ashby", F.col("j.employmentType")).alias("employment"), url.alias("url"), F.col("board_name").alias("company"), F.col("j.publishedAt").alias("published")), "ashby")


def _flags(remote: str, hybrid: str) -> Column:
    return F.when(F.col(remote), "remote").when(F.col(hybrid), "hybrid")


def smartrecruiters(landing: DataFrame, details: DataFrame) -> DataFrame:
    j = _each(landing, R.SMARTRECRUITERS, "content").withColumn("key", F.col("j.id"))
    d = details.select("token", "key", F.from_json("payload", R.SMARTRECRUITERS_DETAIL).alias("d"))
    both = j.join(d, ["token", "key"])
    part = lambda s: F.try_element_at("d.jobAd.sections", F.lit(s))
    text = _joined(*[F.when(F.length(part(s)["text"]) > 0, F.concat(F.coalesce(part(s)["title"], F.lit("")), F.lit("\n"), _html(part(s)["text"]))) for s in R.SMARTRECRUITERS_SECTIONS], by="\n\n")
    raw = F.coalesce("j.location.fullLocation", _joined(F.col("j.location.city"), F.upper("j.location.country")))
    url = F.coalesce("d.postingUrl", F.concat(F.lit("https://jobs.smartrecruiters.com/"), "token", F.lit("/"), "key"))
    return finish(both.select(*BOARD, text.alias("text"), F.col("j.name").alias("title"), raw.alias("raw"), F.col("j.name").alias("context"), _flags("j.location.remote", "j.location.hybrid").alias("said_remote"), _code("smartrecruiters", F.col("j.typeOfEmployment.id")).alias("employment"), url.alias("url"), _or_blank(F.col("j.company.name"), F.col("board_name")).alias("company"), F.col("j.releasedDate").alias("published")), "smartrecruiters")


def workable(landing: DataFrame) -> DataFrame:
    j = _each(landing, R.WORKABLE, "jobs")
    own = F.array(F.struct(F.col("j.country").alias("country"), F.col("j.city").alias("city"), F.lit(None).cast("string").alias("region")))
    raw = F.array_join(F.transform(F.when(F.size("j.locations") > 0, F.col("j.locations")).otherwise(own), lambda l: _joined(l["city"], l["region"], l["country"])), "; ")
    url = F.coalesce("j.url", "j.application_url", F.concat(F.lit("https://apply.workable.com/"), "token", F.lit("/j/"), "j.shortcode"))
    return finish(j.select(*BOARD, _html(F.col("j.description")).alias("text"), F.col("j.title").alias("title"), raw.alias("raw"), F.col("j.title").alias("context"), F.when(F.col("j.telecommuting"), "remote").alias("said_remote"), _code("workable", F.col("j.employment_type")).alias("employment"), url.alias("url"), _or_blank(F.col("_p.name"), F.col("board_name")).alias("company"), F.coalesce("j.published_on", "j.created_at").alias("published")), "workable")


def recruitee(landing: DataFrame) -> DataFrame:
    j = _each(landing, R.RECRUITEE, "offers")
    code = F.coalesce("j.employment_type_code", F.lit(""))
    kind = F.when(code.contains("permanent"), "permanent").when(code.contains("fixed_term"), "fixed-term").when(code.rlike("intern|trainee"), "internship").when(code.contains("apprentice"), "alternance").when(code.contains("freelance"), "contractor")
    raw = _or_blank(F.col("j.location"), _joined(F.col("j.city"), F.col("j.country")))
    url = F.coalesce("j.careers_url", F.concat(F.lit("https://"), "token", F.lit(".recruitee.com/")))
    return finish(j.select(*BOARD, _joined(_html(F.col("j.description")), _html(F.col("j.requirements")), by="\n\n").alias("text"), F.col("j.title").alias("title"), raw.alias("raw"), F.col("j.title").alias("context"), _flags("j.remote", "j.hybrid").alias("said_remote"), kind.alias("employment"), url.alias("url"), _or_blank(F.col("j.company_name"), F.col("board_name")).alias("company"), F.col("j.published_at").alias("published")), "recruitee")


def teamtailor(landing: DataFrame) -> DataFrame:
    x = landing.withColumn("_p", F.from_xml("payload", R.TEAMTAILOR)).select(*BOARD, F.col("_p"), F.explode("_p.channel.item").alias("j"))
    raw = F.array_join(F.transform(F.col("j.`tt:locations`.`tt:location`"), lambda l: _joined(l["tt:city"], l["tt:country"])), "; ")
    status = F.col("j.remoteStatus")
    # "Tue, 30 Sep 2026 10:00:00 +0200": the day name is left out, feeds write it wrong at times.
    published = F.try_to_timestamp(F.regexp_replace("j.pubDate", r"^\w+,\s*", ""), F.lit("d MMM yyyy HH:mm:ss Z")).cast("string")
    company = _or_blank(F.regexp_replace("_p.channel.title", r"\s*[-–|].*$", ""), F.col("board_name"))
    return finish(x.select(*BOARD, _html(F.col("j.description")).alias("text"), F.col("j.title").alias("title"), raw.alias("raw"), F.col("j.title").alias("context"), F.when(status == "fully", "remote").when(status == "hybrid", "hybrid").alias("said_remote"), F.lit(None).cast("string").alias("employment"), F.col("j.link").alias("url"), company.alias("company"), published.alias("published")), "teamtailor")


def personio(landing: DataFrame) -> DataFrame:
    x = landing.withColumn("_p", F.from_xml("payload", R.PERSONIO)).select(*BOARD, F.explode("_p.position").alias("j"))
    more = F.coalesce("j.additionalOffices.office", "j.additionalOffice", strings([]))
    raw = F.array_join(F.filter(F.concat(F.array("j.office"), more), lambda o: F.coalesce(o != "", F.lit(False))), "; ")
    text = F.array_join(F.transform("j.jobDescriptions.jobDescription", lambda d: F.concat(F.coalesce(d["name"], F.lit("")), F.lit("\n"), _html(d["value"]))), "\n\n")
    url = F.concat(F.lit("https://"), "token", F.lit(".jobs.personio.de/job/"), "j.id")
    return finish(x.select(*BOARD, text.alias("text"), F.col("j.name").alias("title"), raw.alias("raw"), F.col("j.name").alias("context"), F.lit(None).cast("string").alias("said_remote"), _code("personio", F.col("j.employmentType")).alias("employment"), url.alias("url"), _or_blank(F.col("j.subcompany"), F.col("board_name")).alias("company"), F.col("j.createdAt").alias("published")), "personio")


def digitalrecruiters(landing: DataFrame, details: DataFrame) -> DataFrame:
    """Details are landed for wanted titles only; an offer without one keeps its list columns."""
    j = _each(landing, R.DIGITALRECRUITERS, "items").withColumn("key", F.col("j.job_ad_id").cast("string"))
    d = details.select("token", "key", F.from_json("payload", R.DIGITALRECRUITERS_DETAIL).alias("d"))
    both = j.join(d, ["token", "key"], "left")
    body = _joined(_html(F.col("d.catch_phrase")), _html(F.col("d.description")), _html(F.col("d.profile")), by="\n\n")
    asked = F.when(F.col("d.job_experience").isNotNull() & ~F.col("d.job_experience").rlike(R.NO_PREFERENCE), F.concat("d.job_experience", F.lit("\n"))).otherwise("")
    url = F.concat(F.lit("https://"), "token", F.lit("/fr/annonce/"), "j.url")
    published = F.concat(F.replace("d.republished_at", F.lit(" "), F.lit("T")), F.lit("Z"))
    return finish(both.select(*BOARD, F.concat(asked, body).alias("text"), F.col("j.title").alias("title"), F.coalesce("j.location", F.lit("")).alias("raw"), F.coalesce("d.formatted_address", "j.location").alias("shown_place"), F.col("j.title").alias("context"), F.lit(None).cast("string").alias("said_remote"), F.coalesce("j.contract", "d.contract").alias("employment"), url.alias("url"), _or_blank(F.col("d.brand_name"), F.col("board_name")).alias("company"), published.alias("published"), F.lit("FR").alias("default_country"), F.when(F.col("j.image_wide.src").isNotNull(), F.concat(F.lit("https://"), "token", "j.image_wide.src")).alias("image")), "digitalrecruiters")


def welcomekit(landing: DataFrame) -> DataFrame:
    """Own career site first, then the platform's page, then the first address; open applications dropped."""
    j = _each(landing, R.WELCOMEKIT, "jobs").filter(~F.col("j.name").rlike(r"(?i)candidature[s]? spontan"))
    urls = F.coalesce("j.websites_urls", F.array().cast("array<struct<website_reference:string,url:string>>"))
    platform = lambda u: u["website_reference"].startswith("wttj")
    own = F.get(F.filter(urls, lambda u: ~platform(u) & ~u["url"].contains("/companies/")), F.lit(0))["url"]
    url = F.coalesce(own, F.get(F.filter(urls, platform), F.lit(0))["url"], F.get(urls, F.lit(0))["url"])
    raw = _joined(F.col("j.office.city"), F.col("j.office.country.en"))
    named = j.withColumn("url", url).filter("url IS NOT NULL")
    return finish(named.select(*BOARD, _joined(_html(F.col("j.description")), _html(F.col("j.profile")), by="\n\n").alias("text"), F.col("j.name").alias("title"), raw.alias("raw"), F.col("j.name").alias("context"), F.lit(None).cast("string").alias("said_remote"), F.col("j.contract_type.fr").alias("employment"), "url", _or_blank(F.col("_p.name"), F.col("board_name")).alias("company"), F.col("j.published_at").alias("published")), "welcomekit")


def workday(landing: DataFrame, details: DataFrame, wanted: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """List and details; titles nobody looks for are dropped before the join, the country is added to each place."""
    j = _each(landing, R.WORKDAY, "jobPostings").withColumns({"key": F.col("j.externalPath"), "title": F.col("j.title")}).filter((F.length("title") > 0) & (F.length("key") > 0))
    j = wanted(j) if wanted else j
    d = details.select("token", "key", F.from_json("payload", R.WORKDAY_DETAIL)["jobPostingInfo"].alias("d")).filter("d.title IS NOT NULL")
    both = j.drop("title").join(d, ["token", "key"])
    country = F.coalesce("d.country.descriptor", F.lit(""))
    spots = F.filter(F.concat(F.array("d.location"), F.coalesce("d.additionalLocations", strings([]))), lambda l: F.coalesce(l != "", F.lit(False)))
    raw = F.array_join(F.transform(spots, lambda l: F.when(country != "", F.concat(l, F.lit(", "), country)).otherwise(l)), "; ")
    url = F.coalesce("d.externalUrl", F.concat(F.lit("https://"), "token", "key"))
    return finish(both.select(*BOARD, _html(F.col("d.jobDescription")).alias("text"), F.col("d.title").alias("title"), raw.alias("raw"), F.col("d.title").alias("context"), F.lit(None).cast("string").alias("said_remote"), F.col("d.timeType").alias("employment"), url.alias("url"), F.col("board_name").alias("company"), F.col("d.startDate").alias("published")), "workday")


def polymer(landing: DataFrame, details: DataFrame, wanted: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    j = _each(landing, R.POLYMER, "items").withColumns({"key": F.col("j.id").cast("string"), "title": F.col("j.title")}).filter(~F.col("title").rlike(R.OPEN_APPLICATION))
    j = wanted(j) if wanted else j
    d = details.select("token", "key", F.from_json("payload", R.POLYMER_DETAIL).alias("d"))
    both = j.join(d, ["token", "key"])
    mode = F.lower(F.coalesce("j.remoteness_pretty", F.lit("")))
    said = F.when(mode.contains("no remote"), "onsite").when(mode.contains("hybrid"), "hybrid").when(mode.contains("remote"), "remote")
    kind = F.when(F.col("j.kind_pretty").rlike("(?i)intern"), "internship")
    return finish(both.select(*BOARD, _html(F.coalesce("d.description", "d.data.description")).alias("text"), "title", _joined(F.col("j.city"), F.col("j.country")).alias("raw"), F.col("title").alias("context"), said.alias("said_remote"), kind.alias("employment"), F.col("j.job_post_url").alias("url"), F.col("board_name").alias("company"), F.col("j.published_at").alias("published")), "polymer")


def _last_page(df: DataFrame, id: str) -> DataFrame:
    """One row per offer id across searches: the last page read wins."""
    order = F.struct("page", "at")
    rest = [c for c in df.columns if c != id]
    return df.groupBy(id).agg(F.max_by(F.struct(*rest), order).alias("r")).select(id, "r.*")


def adzuna(landing: DataFrame) -> DataFrame:
    """Search results; a search by company keeps that employer only. `landing` adds page and searched (or null)."""
    j = _each(landing, R.ADZUNA, "results", ["page", "searched"])
    name = F.col("j.company.display_name")
    mine = F.col("searched").isNull() | (company_key(F.coalesce(name, F.lit(""))) == company_key(F.col("searched")))
    one = _last_page(j.filter(mine).withColumn("id", F.col("j.id")), "id")
    return finish(one.select(*BOARD, _html(F.col("j.description")).alias("text"), html_to_text(F.col("j.title")).alias("title"), F.col("j.location.display_name").alias("raw"), F.col("j.title").alias("context"), F.lit(None).cast("string").alias("said_remote"), _code("adzuna", F.col("j.contract_type")).alias("employment"), F.col("j.redirect_url").alias("url"), _or_blank(F.col("j.company.display_name"), F.lit(R.UNKNOWN_EMPLOYER)).alias("company"), F.col("j.created").alias("published"), F.lit("FR").alias("default_country")), "adzuna", engine=True)


def jooble(landing: DataFrame) -> DataFrame:
    one = _last_page(_each(landing, R.JOOBLE, "jobs", ["page"]).withColumn("id", F.col("j.id")), "id")
    title = html_to_text(F.col("j.title"))
    return finish(one.select(*BOARD, _html(F.col("j.snippet")).alias("text"), title.alias("title"), F.col("j.location").alias("raw"), title.alias("context"), F.lit(None).cast("string").alias("said_remote"), F.col("j.type").alias("employment"), F.col("j.link").alias("url"), _or_blank(F.col("j.company"), F.lit(R.UNKNOWN_EMPLOYER)).alias("company"), F.col("j.updated").alias("published"), F.lit("FR").alias("default_country")), "jooble", engine=True)


READERS: dict[str, Callable[..., DataFrame]] = {f.__name__: f for f in (greenhouse, lever, ashby, smartrecruiters, workable, recruitee, teamtailor, personio, digitalrecruiters, welcomekit, workday, polymer, adzuna, jooble)}


def read_feed(landing: DataFrame, family: str, **options) -> DataFrame:
    """Payloads of one feed family as normalised offers."""
    return READERS[family](landing, **options)
