"""Postings and links read in landed web pages and site maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vacanta.columns import let, once, strip
from vacanta.functions.geo import places_of, remote_of, scope_of
from vacanta.functions.signals import detect_contract, detect_experience
from vacanta.functions.text import decode_entities, html_to_text
from vacanta.rules import pages as R


def _inside(html: Column, tag: str) -> Column:
    """Content of the first element of a tag, null when the page has none."""
    found = F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), F.lit(1))
    return F.get(found, F.lit(0))


def page_title(html: Column) -> Column:
    og = F.nullif(F.regexp_extract(html, r'(?i)<meta[^>]+property="og:title"[^>]+content="([^"]+)"', 1), F.lit(""))
    raw = F.coalesce(_inside(html, "h1"), og, F.nullif(F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1), F.lit("")), F.lit(""))
    flat = strip(F.regexp_replace(html_to_text(raw), r"\s+", " "))
    return F.substring(F.regexp_replace(flat, R.TITLE_TAIL, ""), 1, R.TITLE_CHARS)


def page_text(html: Column) -> Column:
    skipped = "|".join(R.SKIPPED_BLOCKS)
    clean = F.regexp_replace(html, rf"(?is)<({skipped})\b.*?</\1>", " ")
    body = let(clean, lambda c: F.coalesce(_inside(c, "main"), _inside(c, "article"), _inside(c, "body"), c))
    return let(body, html_to_text)


def read_html_posting(pages: DataFrame, html: str = "html", url: str = "url", min_chars: int = R.MIN_CHARS) -> DataFrame:
    """Ordinary pages read as postings: a title and enough text, no list and no open application."""
    read = once(pages, title=page_title(F.col(html)), description=page_text(F.col(html)))
    fit = (F.length("title") >= 4) & ~F.col("title").rlike(R.NOT_A_JOB) & (F.length("description") >= min_chars) & ~F.substring("description", 1, 200).rlike(R.NOT_A_JOB)
    kept = read.filter(fit)
    head = F.array_join(F.slice(F.split("description", "\n"), 1, R.HEAD_LINES), " ")
    placed = kept.withColumn("_head", head).withColumn("_p", places_of(F.col("_head"))).withColumn("remote", remote_of(F.col("_head"), F.col("title")))
    placed = placed.withColumn("remote_scope", scope_of(F.col("_head"), F.col("remote"), F.col("_p")))
    none = F.lit(None).cast("string")
    france = F.array(F.struct(none.alias("city"), none.alias("region"), F.lit("FR").alias("country")))
    placed = placed.withColumn("places", F.when(F.size("_p") > 0, F.col("_p")).otherwise(france))
    return placed.withColumns({
        "source_key": F.lit("manual"), "source_url": F.col(url), "apply_url": F.col(url), "company": F.lit(R.UNKNOWN_EMPLOYER),
        "location_raw": F.nullif(F.array_join(F.transform("places", lambda p: p["city"]), ", "), F.lit("")),
        "contract": detect_contract(F.col("title"), None, F.col("description")),
        "experience_min_years": detect_experience(F.col("description"))["min"],
        "published_at": F.lit(None).cast("timestamp"),
    }).drop("_head", "_p")


def _text_of(v: Column) -> Column:
    """A JSON value that is a text, or the `name` of an object."""
    return F.coalesce(F.try_variant_get(v, "$.name", "string"), F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")), F.lit(""))


def _objects(v: Column) -> Column:
    """A JSON value as an array of values: itself, or its elements."""
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.when(v.isNotNull(), F.array(v)))


def read_jobposting(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """The structured JobPosting of a page: first one found in its scripts, through arrays and @graph."""
    blocks = F.regexp_extract_all(F.col(html), F.lit(R.LD_JSON), F.lit(1))
    scripts = pages.select("*", F.posexplode(blocks).alias("_block", "_raw"))
    parsed = scripts.withColumn("_json", F.try_parse_json(F.regexp_replace(strip(F.col("_raw")), "[\\x00-\\x1f]+", " "))).filter("_json IS NOT NULL")
    level = parsed.select("*", F.posexplode(_objects(F.col("_json"))).alias("_i", "_o"))
    inner = F.concat(F.array(F.col("_o")), F.coalesce(_objects(F.try_variant_get("_o", "$['@graph']", "variant")), F.array().cast("array<variant>")))
    nodes = level.select("*", F.posexplode(inner).alias("_j", "_n"))
    kind = F.try_variant_get("_n", "$['@type']", "string")
    kinds = F.try_variant_get("_n", "$['@type']", "array<string>")
    jobs = nodes.filter((kind == "JobPosting") | F.coalesce(F.array_contains(kinds, "JobPosting"), F.lit(False)))
    v = lambda path: F.try_variant_get("_n", path, "variant")
    titled = jobs.withColumn("title", strip(_text_of(v("$.title")))).filter("title <> ''")

    def place(x: Column) -> Column:
        parts = [_text_of(F.try_variant_get(x, f"$.address.{p}", "variant")) for p in ("addressLocality", "addressRegion", "addressCountry")]
        return F.array_join(F.filter(F.array(*parts), lambda p: p != ""), ", ")

    raw = F.array_join(F.filter(F.transform(F.coalesce(_objects(v("$.jobLocation")), F.array().cast("array<variant>")), place), lambda p: p != ""), "; ")
    employment = F.coalesce(F.array_join(F.try_variant_get("_n", "$.employmentType", "array<string>"), " "), _text_of(v("$.employmentType")))
    read = titled.withColumns({
        "location_raw": F.nullif(raw, F.lit("")), "description": html_to_text(_text_of(v("$.description"))), "_kind": _text_of(v("$.jobLocationType")),
        "_employment": F.lower(F.translate(employment, "_", "-")), "company": F.coalesce(F.nullif(strip(_text_of(v("$.hiringOrganization"))), F.lit("")), F.lit(R.UNKNOWN_EMPLOYER)),
        "published_text": F.nullif(_text_of(v("$.datePosted")), F.lit("")),
    })
    one = read.withColumn("_at", F.struct("_block", "_i", "_j"))
    firsts = one.groupBy(F.col(url).alias("_u")).agg(F.min("_at").alias("_first"))
    first = one.join(firsts, (F.col(url) == F.col("_u")) & (F.col("_at") == F.col("_first")))
    placed = first.withColumn("places", places_of(F.col("location_raw")))
    remote = F.when(F.col("_kind").rlike("(?i)telecommute"), "remote").otherwise(remote_of(F.col("location_raw"), F.concat("title", F.lit("\n"), "_kind")))
    placed = placed.withColumn("remote", remote)
    done = placed.withColumns({
        "remote_scope": scope_of(F.col("location_raw"), F.col("remote"), F.col("places")), "contract": detect_contract(F.col("title"), F.col("_employment"), F.col("description")),
        "experience_min_years": detect_experience(F.col("description"))["min"], "source_key": F.lit("manual"), "source_url": F.col(url), "apply_url": F.col(url),
    })
    return done.drop(*[c for c in done.columns if c.startswith("_")])


def _host(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, r"^https?://([^/?#:]+)", 1))


def _path(u: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(u, r"^https?://[^/?#]+([^?#]*)", 1), F.lit("")), F.lit("/"))


def _origin(u: Column) -> Column:
    return F.regexp_extract(u, r"^(https?://[^/?#]+)", 1)


def _absolute(href: Column, base: Column) -> Column:
    """Address of a link: absolute, from the root, or beside the page."""
    folder = F.concat(_origin(base), F.regexp_replace(_path(base), "[^/]*$", ""))
    return (
        F.when(href.rlike("(?i)^https?://"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, "^(https?:)", 1), href))
        .when(href.startswith("/"), F.concat(_origin(base), href))
        .when(~href.rlike("(?i)^[a-z][a-z0-9+.-]*:"), F.concat(folder, href))
    )


def extract_links(pages: DataFrame, path_pattern: str = R.JOB_PATH, html: str = "html", url: str = "url", keep: list[str] | None = None) -> DataFrame:
    """Job links of listing pages: same host, path of one job, query dropped, longest label per address."""
    keep = keep or [url]
    anchors = F.arrays_zip(F.regexp_extract_all(F.col(html), F.lit(R.LINK), F.lit(1)).alias("h"), F.regexp_extract_all(F.col(html), F.lit(R.LINK), F.lit(2)).alias("t"))
    links = pages.select(*keep, F.col(url).alias("_base"), F.posexplode(anchors).alias("_at", "a"))
    absolute = links.withColumn("_u", _absolute(F.regexp_replace("a.h", "&amp;", "&"), F.col("_base"))).filter("_u IS NOT NULL")
    path, own = _path(F.col("_u")), _path(F.col("_base"))
    company = F.nullif(F.regexp_extract(own, r"^(/companies/[^/]+)", 1), F.lit(""))
    kept = absolute.filter(
        (_host(F.col("_u")) == _host(F.col("_base"))) & path.rlike(path_pattern) & (F.regexp_replace(path, "/$", "") != F.regexp_replace(own, "/$", "")) & (company.isNull() | path.startswith(company))
    )
    label = strip(F.regexp_replace(decode_entities(F.regexp_replace("a.t", "<[^>]+>", " ")), r"\s+", " "))
    named = kept.select(*keep, F.concat(_origin(F.col("_u")), path).alias("link"), label.alias("label"), "_at")
    best = F.struct(F.length("label").alias("n"), (-F.col("_at")).alias("o"))
    return named.groupBy(*keep, "link").agg(F.max_by("label", best).alias("label"))


def read_sitemap(maps: DataFrame, origin: str = "origin", prefix: str = "prefix", xml: str = "xml", path_pattern: str = R.JOB_PATH) -> DataFrame:
    """Job addresses of landed site maps; those under the listing's own path are preferred when there are any.

    `maps` holds one row per landed map file of a site. The title is read in the last part of the address.
    """
    locs = maps.select(origin, prefix, F.explode(F.regexp_extract_all(F.col(xml), F.lit(R.SITE_MAP_LOC), F.lit(1))).alias("link"))
    jobs = locs.filter(~F.col("link").rlike(R.SITE_MAP_FILE)).withColumn("_path", _path(F.col("link"))).filter(F.col("_path").rlike(path_pattern)).distinct()
    near = jobs.withColumn("_local", F.startswith("_path", F.col(prefix)))
    sites = near.groupBy(origin).agg(F.max("_local").alias("_any"))
    kept = near.join(sites, origin).filter(~F.col("_any") | F.col("_local"))
    last = F.element_at(F.filter(F.split("_path", "/"), lambda p: p != ""), -1)
    return kept.select(origin, "link", F.regexp_replace(F.try_url_decode(last), "[-_]+", " ").alias("label"))


def nested_maps(maps: DataFrame, xml: str = "xml") -> DataFrame:
    """Map files a map points to, those about jobs only: what a next landing has to fetch."""
    locs = maps.select(F.explode(F.regexp_extract_all(F.col(xml), F.lit(R.SITE_MAP_LOC), F.lit(1))).alias("link"))
    return locs.filter(F.col("link").rlike(R.SITE_MAP_FILE) & F.col("link").rlike(R.SITE_MAP_FOLLOWED)).distinct()


def narrowed_listings(maps: DataFrame, listings: DataFrame, origin: str = "origin", xml: str = "xml", url: str = "url") -> DataFrame:
    """Pages of the site map that carry the longest number (six digits or more) of a listing's address."""
    numbers = F.filter(F.split(_path(F.col(url)), "/"), lambda p: p.rlike(r"^\d{6,}$"))
    longest = F.array_max(F.transform(numbers, lambda p: F.struct(F.length(p).alias("n"), p.alias("id"))))["id"]
    root = F.array_join(F.slice(F.split(_path(F.col(url)), "/"), 1, 2), "/")
    wanted = listings.select(_origin(F.col(url)).alias(origin), F.col(url), longest.alias("id"), root.alias("_root")).filter("id IS NOT NULL")
    locs = maps.select(origin, F.explode(F.regexp_extract_all(F.col(xml), F.lit(R.SITE_MAP_LOC), F.lit(1))).alias("link")).distinct()
    numbered = locs.withColumn("id", F.explode(F.array_distinct(F.regexp_extract_all(_path(F.col("link")), F.lit(r"(?:/|-)(\d{6,})(?=[-/]|$)"), F.lit(1)))))
    j = numbered.join(wanted, [origin, "id"])
    first = F.regexp_extract(_path(F.col("link")), r"/(\d{6,})(?=[-/]|$)", 1)
    return j.filter((F.col("link") != F.col(url)) & F.startswith(_path(F.col("link")), F.col("_root")) & (first == F.col("id")) & ~_path(F.col("link")).rlike(R.JOB_PATH)).select(url, "link").distinct()
