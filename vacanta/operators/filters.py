"""Filters of offers, scores and applications. `now` is always given, never the clock of the machine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vacanta.columns import says, strings
from vacanta.functions.signals import is_closed, is_junior, is_student, is_training
from vacanta.functions.text import fold
from vacanta.rules import signals as R
from vacanta.rules import views as V

DAY = 86_400


def seconds_between(later: Column, earlier: Column) -> Column:
    """Seconds between two times of one type (with or without zone)."""
    return F.timestamp_diff("MICROSECOND", earlier, later) / 1_000_000.0


def posted_at(df_published: Column, first_seen: Column) -> Column:
    return F.coalesce(df_published, first_seen)


def active_at(df: DataFrame, at: Column, first_seen: str = "first_seen_at", archived: str = "archived_at") -> DataFrame:
    return df.filter((F.col(first_seen) <= at) & (F.col(archived).isNull() | (F.col(archived) > at)))


def from_engines(sources: Column, engines: list[str] = R.ENGINES) -> Column:
    """All sources are search engines; true when there is no source at all."""
    return F.forall(F.coalesce(sources, strings([])), lambda s: s.isin(engines))


def engine_only(df: DataFrame, engines: list[str] = R.ENGINES, sources: str = "sources") -> DataFrame:
    return df.filter(from_engines(F.col(sources), engines))


def is_excerpt(text: Column, engine: Column, length: int = R.EXCERPT_LENGTH) -> Column:
    return (F.length(F.coalesce(text, F.lit(""))) < length) & engine


def excerpt_only(df: DataFrame, length: int = R.EXCERPT_LENGTH, text: str = "text", engine: str = "engine_only") -> DataFrame:
    return df.filter(is_excerpt(F.col(text), F.col(engine), length))


def is_stale(posted: Column, engine: Column, now: Column, days: int = R.STALE_DAYS) -> Column:
    return engine & (seconds_between(now, posted) > days * DAY)


def is_new(posted: Column, now: Column, hours: int = R.NEW_HOURS) -> Column:
    return seconds_between(now, posted) < hours * 3600


def follow_up_due(stage: Column, applied: Column, followed: Column, now: Column, days: int = V.FOLLOW_UP_DAYS, applied_stage: str = "postule") -> Column:
    since = F.coalesce(followed, applied)
    return (stage == applied_stage) & since.isNotNull() & (seconds_between(now, since) >= days * DAY)


def upcoming(at: Column, now: Column) -> Column:
    return F.coalesce(at > now, F.lit(False))


def is_company_wide(activity: Column) -> Column:
    """A sentence about the whole company: it names no country and no single market."""
    return ~says(fold(activity), V.ONE_MARKET)


def is_intermediary(name: Column, pattern: str = R.INTERMEDIARY) -> Column:
    return says(fold(name), pattern)


def named_company(name: Column) -> Column:
    return ~name.rlike(R.ANONYMOUS)


def is_exceptional(level: Column, interest: Column, chances: Column, top: str = "coeur", interest_min: int = 85, chances_min: int = 70) -> Column:
    return (level == top) & (F.coalesce(interest, F.lit(0)) >= interest_min) & (F.coalesce(chances, F.lit(0)) >= chances_min)


def aside_kind(dismissed: Column, level: Column, reason: Column) -> Column:
    """Short label of why an offer is out of the selection."""
    said = F.coalesce(reason, F.lit("Ne correspond pas à ta recherche."))
    label = F.when(dismissed, V.OWN_CHOICE).when(level != "ecartee", "Lieu")
    for pattern, name in V.ASIDE_KINDS:
        label = label.when(said.rlike(pattern), name)
    return label.otherwise("Contenu du poste")


def search(df: DataFrame, words: str, *columns: str) -> DataFrame:
    """Rows whose columns, put side by side, hold the words: case and accents ignored."""
    whole = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in columns])
    return df.filter(F.contains(fold(whole), fold(F.trim(F.lit(words)))))


def search_terms(term: str) -> str:
    return "".join(" " if c in "%_,()*\\" else c for c in term).strip()


def search_excluded(scores: DataFrame, offers: DataFrame, companies: DataFrame, term: str) -> DataFrame:
    """Set-aside scores of active offers whose title or company holds the term."""
    pattern = f"%{search_terms(term)}%"
    active = offers.filter(F.col("archived_at").isNull())
    by_title = active.filter(F.col("title").ilike(pattern)).select("offer_id")
    by_company = active.join(companies.filter(F.col("name").ilike(pattern)).select("company_id"), "company_id", "left_semi").select("offer_id")
    return scores.filter(F.col("level") == "ecartee").join(by_title.union(by_company).distinct(), "offer_id", "left_semi")


def is_shouting(title: Column) -> Column:
    letters = F.length(F.regexp_replace(title, "[^A-Za-zÀ-ÿ]", ""))
    capitals = F.length(F.regexp_replace(title, "[^A-ZÀ-Þ]", ""))
    return (letters > 0) & (capitals / F.nullif(letters, F.lit(0)) > 0.6)


def showcase(df: DataFrame, now: Column, days: int = 14, longest: int = 60, title: str = "title", posted: str = "posted_at", engine: str = "engine_only") -> DataFrame:
    """Offers fit for the public page: own career page, recent, short title not written in capitals."""
    recent = seconds_between(now, F.col(posted)) < days * DAY
    shouting = F.coalesce(is_shouting(F.col(title)), F.lit(False))
    return df.filter(~F.col(engine) & recent & (F.length(title) < longest) & ~shouting)


__all__ = [
    "active_at", "aside_kind", "engine_only", "excerpt_only", "follow_up_due", "from_engines", "is_closed", "is_company_wide",
    "is_excerpt", "is_exceptional", "is_intermediary", "is_junior", "is_new", "is_shouting", "is_stale", "is_student", "is_training",
    "named_company", "posted_at", "search", "search_excluded", "seconds_between", "showcase", "upcoming",
]
