"""Boards read in texts and addresses, candidates of a crawl index, guessed boards, company lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vacanta.columns import first_rule, strip
from vacanta.functions.text import slug_guesses
from vacanta.operators.filters import named_company
from vacanta.rules import boards as R

BOARD = "struct<ats:string,token:string>"


def board_from(text: Column, boards: list[tuple[str, str]] = R.IN_TEXT, refused: list[str] = R.NOT_A_COMPANY) -> Column:
    """First board of an ordered list of patterns a text names: struct(ats, token)."""
    found = []
    for ats, pattern in boards:
        tokens = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        if ats == "workday":
            sites = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
            tokens = F.transform(F.arrays_zip(tokens.alias("h"), sites.alias("s")), lambda z: F.concat(F.lower(z["h"]), F.lit("/"), z["s"]))
        elif ats not in R.CASE_KEPT:
            tokens = F.transform(tokens, lambda t: F.lower(F.try_url_decode(t)))
        first = F.get(F.filter(tokens, lambda t: ~t.isin(refused)), F.lit(0))
        found.append(F.when(first.isNotNull(), F.struct(F.lit(ats).alias("ats"), first.alias("token"))))
    return F.coalesce(*found)


def platform_of(text: Column, platforms: list[tuple[str, str]] = R.PLATFORMS) -> Column:
    return first_rule(text, [(p, name) for name, p in platforms])


def crawl_candidates(lines: DataFrame, boards: list[tuple[str, str]] = R.IN_CRAWL, refused: list[str] = R.NOT_A_COMPANY_IN_CRAWL, line: str = "line") -> DataFrame:
    """(ats, token) once each, from the lines of a public crawl index."""
    url = F.nullif(F.regexp_extract(F.col(line), r'"url":\s*"([^"]+)"', 1), F.lit(""))
    hits = F.filter(
        F.array(*[F.struct(F.lit(ats).alias("ats"), F.lower(F.nullif(F.regexp_extract(url, p, 1), F.lit(""))).alias("token")) for ats, p in boards]),
        lambda b: b["token"].isNotNull() & ~b["token"].isin(refused),
    )
    return lines.select(F.explode(hits).alias("b")).select("b.ats", "b.token").distinct().withColumn("via", F.lit("crawl"))


def name_candidates(companies: DataFrame, boards: list[str] | None = None, name: str = "name") -> DataFrame:
    """Boards a company could have, guessed from its name; anonymous employers left out."""
    guessed = boards or [a for a in R.ATS if a not in R.NOT_GUESSED]
    named = companies.filter(named_company(F.col(name)))
    tokens = named.select("company_id", F.explode(slug_guesses(F.col(name))).alias("token"))
    return tokens.select("company_id", F.explode(F.array(*[F.lit(a) for a in guessed])).alias("ats"), "token").withColumn("via", F.lit("name"))


def union_candidates(crawl: DataFrame, names: DataFrame) -> DataFrame:
    """Crawl and name candidates, each board once; a crawl hit wins over a guess."""
    both = crawl.select("ats", "token", "via").unionByName(names.select("ats", "token", "via"))
    return both.groupBy("ats", "token").agg(F.min("via").alias("via"))


SITE = r"^(?i:https?://)|^[\w-]+(\.[\w-]+)+(/|$)"


def parse_company_list(lines: DataFrame, line: str = "line") -> DataFrame:
    """Names and sites of a pasted list: one per line, commas, addresses, or rows `company,site`."""
    parts = F.transform(F.split(F.col(line), "[,;\t]", -1), strip)
    second = F.get(parts, F.lit(1))
    row = (F.size(parts) == 2) & ((second == "") | second.rlike(SITE))
    none = F.lit(None).cast("string")
    entry = lambda n, s: F.struct(F.nullif(n, F.lit("")).alias("name"), F.nullif(s, F.lit("")).alias("site"))
    apart = F.transform(parts, lambda p: F.when(p.rlike(SITE), entry(none, p)).otherwise(entry(p, none)))
    entries = F.when(row, F.array(entry(F.get(parts, F.lit(0)), second))).otherwise(apart)
    flat = lines.select(F.explode(entries).alias("e")).select("e.name", "e.site")
    header = F.coalesce(F.col("name"), F.lit("")).rlike("^(?i:entreprise|company|nom|name|site)$")
    return flat.filter((F.col("name").isNotNull() | F.col("site").isNotNull()) & ~header)
