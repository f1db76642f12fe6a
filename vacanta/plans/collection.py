"""Collection over landed snapshots, directory discovery and the admin page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vacanta.columns import once
from vacanta.functions.geo import keep_in_scope
from vacanta.functions.signals import contract_in, experience_in, level_in, remote_in, salary_in, years_text
from vacanta.functions.text import dedup_key, rule_text
from vacanta.operators import dedup as D
from vacanta.operators import feed as FD
from vacanta.operators import market as M
from vacanta.operators.filters import DAY, seconds_between
from vacanta.rules import signals as R
from vacanta.session import settle
from vacanta.sources import boards as B
from vacanta.sources.feeds import union_feeds
from vacanta.sources.sinks import purge_texts

# Arrival order within a run: between texts of equal length the first of these wins.
ARRIVAL = ["source_key", "source_url", "title"]


def normalise(offers: DataFrame) -> DataFrame:
    """Signals a feed left out are read in the text: remote work, experience, pay, contract."""
    folded = offers.withColumn("_t", F.coalesce(rule_text(F.col("text")), F.lit("")))
    read = once(folded, years=experience_in(years_text(F.col("_t"))), level=level_in(F.col("_t")), pay=salary_in(F.col("_t")), mode=remote_in(F.col("_t")), deal=contract_in(rule_text(F.col("title")), F.lit(None).cast("string"), F.col("_t")))
    full = read.withColumns({
        "remote": F.when(F.col("remote") == "unknown", F.coalesce("mode", F.lit("unknown"))).otherwise(F.col("remote")),
        "experience_min_years": F.coalesce("experience_min_years", F.col("years.min")), "experience_max_years": F.col("years.max"),
        "experience_level": F.col("level"), "salary_text": F.col("pay"), "contract": F.when(F.col("contract") == "unknown", F.col("deal")).otherwise(F.col("contract")),
        "dedup_key": dedup_key(F.col("company"), F.col("title"), F.get(F.col("places"), F.lit(0))["city"], F.col("location_raw")),
    })
    return full.drop("_t", "years", "level", "pay", "mode", "deal")


def with_board_names(offers: DataFrame, boards: DataFrame) -> DataFrame:
    """A board's offers belong to the company that owns the board, whatever name its feed shows."""
    names = boards.select(F.col("source").alias("source_key"), F.col("name").alias("_name"))
    named = offers.join(names, "source_key", "left").withColumn("company", F.coalesce("_name", "company")).drop("_name")
    return named.withColumn("dedup_key", dedup_key(F.col("company"), F.col("title"), F.get(F.col("places"), F.lit(0))["city"], F.col("location_raw"))).select(*offers.columns)


def archive_unlisted(offers: DataFrame, read: DataFrame, seen: DataFrame, now: Column) -> DataFrame:
    """Active offers of a board read in this run (`read`: source) that no source of the run shows any more (`seen`: dedup_key)."""
    gone = offers.filter("archived_at IS NULL").select("dedup_key", F.explode("sources").alias("source")).join(read, "source", "left_semi").select("dedup_key").distinct().join(seen, "dedup_key", "left_anti")
    marked = offers.join(gone.withColumn("_gone", F.lit(True)), "dedup_key", "left")
    return marked.withColumn("archived_at", F.when(F.col("_gone"), now).otherwise(F.col("archived_at"))).select(*offers.columns)


def collect(feeds: list[DataFrame], state: DataFrame, countries: list[str], now: Column, boards: DataFrame | None = None) -> DataFrame:
    """Next version of the offers: feeds united, kept in scope, longest text per key, merged, absences archived, old texts purged.

    `boards` (source, name) are the boards read in full in this run, those without any offer included; without it, the
    boards that sent an offer.
    """
    read = settle(normalise(keep_in_scope(union_feeds(*feeds), countries)))
    named = read if boards is None else with_board_names(read, boards)
    batch = D.dedup_batch(named, ordinal=ARRIVAL)
    merged = D.merge_offers(state, batch, now)
    listing = read.filter(F.col("ats").isNotNull()).select(F.col("source_key").alias("source"), "dedup_key")
    whole = listing.select("source") if boards is None else listing.select("source").union(boards.select("source"))
    return purge_texts(archive_unlisted(merged, whole.distinct(), batch.select("dedup_key"), now), now)


def archive_engine_offers(offers: DataFrame, followed: DataFrame, now: Column, days: int = R.ENGINE_SILENCE_DAYS) -> DataFrame:
    """Active offers known from engines alone: archived if they copy an employer's own page (same title, same whole text,
    followed ones kept: `followed` holds dedup_key) or were not seen for `days`."""
    marked = offers.withColumn("engine_only", F.forall("sources", lambda s: s.isin(R.ENGINES)) & (F.size("sources") > 0))
    active = marked.filter("archived_at IS NULL")
    copies = D.merge_engine_copies(active, followed, id="dedup_key").withColumn("_copy", F.lit(True))
    silent = F.col("engine_only") & F.coalesce(seconds_between(now, F.col("last_seen_at")) > days * DAY, F.lit(False))
    joined = marked.join(copies, "dedup_key", "left")
    gone = F.col("archived_at").isNull() & (silent | F.col("_copy").isNotNull())
    return joined.withColumn("archived_at", F.when(gone, now).otherwise(F.col("archived_at"))).select(*offers.columns)


def collection_pass(feeds: list[DataFrame], state: DataFrame, companies: DataFrame, followed: DataFrame, countries: list[str], now: Column, boards: DataFrame | None = None) -> dict[str, DataFrame]:
    """One whole collection: `offers`, the next version of the table, and `companies`, those to insert (name_key, name).

    Feeds are read, merged and archived by absence (`collect`), offers of engines by copy and by silence; companies
    of offers that are not known yet are inserted once each.
    """
    offers = settle(archive_engine_offers(collect(feeds, state, countries, now, boards), followed, now))
    missing, _ = D.ensure_companies(offers.filter("company IS NOT NULL").select("company"), companies)
    return {"offers": offers, "companies": missing}


def discover(index: DataFrame, companies: DataFrame) -> DataFrame:
    """Boards of the crawl index and guessed from names, known ones removed."""
    return FD.new_candidates(B.union_candidates(B.crawl_candidates(index), B.name_candidates(companies.filter("ats IS NULL"))), companies)


def admin_page(offers: DataFrame, companies: DataFrame, scores: DataFrame, runs: DataFrame, checks: DataFrame, last: str, days: int = 14) -> dict[str, DataFrame]:
    return {
        "sources": M.offers_by_source(offers), "per_day": M.per_day(offers, "first_seen_at", last, days), "origins": M.directory_origins(companies),
        "levels": M.levels(scores), "health": M.health_state(M.source_health(runs)), "checks": M.check_stats(checks),
    }
