"""Duplicates and merges: one row per text, per key, across sources, and the upsert of a batch.

Groups of copies may be huge, so every rule keeps one row per group by a partial aggregate (min_by,
max_by) instead of sorting the group in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vacanta.columns import once, says, strings, swap
from vacanta.functions.text import company_key, fold, slug
from vacanta.rules import signals as R
from vacanta.rules import views as V
from vacanta.session import skew_join


def text_print(text: Column) -> Column:
    """Fingerprint of a whole text in its slug form."""
    return F.sha2(slug(text), 256)


def dedup_texts(df: DataFrame, text: str = "text", engine: str = "engine_only", id: str = "offer_id", within: list[str] | None = None) -> DataFrame:
    """One row per text: the employer's own page first, then the smallest id."""
    by = [F.col(c) for c in (within or [])] + [text_print(F.col(text)).alias("_print")]
    # Two plain minima: a hash aggregate, where the minimum of a struct would sort.
    winners = df.groupBy(*by).agg(F.coalesce(F.min(F.when(~F.col(engine), F.col(id))), F.min(id)).alias(id))
    keys = winners.select(*(within or []), id)
    return df.join(keys, [*(within or []), id], "left_semi")


def copies(df: DataFrame, kept: DataFrame, id: list[str] | str = "offer_id") -> DataFrame:
    """Rows of `df` that were not kept, by one key or several."""
    ids = [id] if isinstance(id, str) else id
    return df.join(kept.select(*ids), ids, "left_anti")


def dedup_batch(df: DataFrame, key: str = "dedup_key", text: str = "text", ordinal: list[str] | str = "ordinal") -> DataFrame:
    """The row of the longest text per key, exactly one; between equal lengths, the first by `ordinal`."""
    first = [ordinal] if isinstance(ordinal, str) else ordinal
    order = F.struct((-F.length(F.coalesce(F.col(text), F.lit("")))).alias("_l"), *first)
    return df.groupBy(key).agg(F.min_by(F.struct(*df.columns), order).alias("_row")).select("_row.*")


def merge_arrays(old: Column, new: Column) -> Column:
    return F.array_union(F.coalesce(old, F.array().cast("array<string>")), new)


def is_repost(archived: Column, was_published: Column, published: Column, now: Column, days: int = 2) -> Column:
    """Gone for more than two days, then back with a later publication date."""
    span = days * 86_400 * 1_000_000
    gone = F.timestamp_diff("MICROSECOND", archived, now) > span
    later = F.timestamp_diff("MICROSECOND", was_published, published) > span
    return F.coalesce(gone & later, F.lit(False))


# Columns a batch may bring beside those every offer has; a sighting replaces them, an image only by another.
OFFER_DETAILS = ["company", "location_raw", "places", "remote", "remote_scope", "contract", "experience_min_years", "experience_max_years", "experience_level", "salary_text", "image_url"]
OFFER_STATE = ["dedup_key", "title", "text", "urls", "sources", "apply_url", "published_at", "first_seen_at", "last_seen_at", "archived_at", "repost_count", "reposted_at"]


def merge_offers(state: DataFrame, batch: DataFrame, now: Column, direct: str = R.DIRECT_SOURCES) -> DataFrame:
    """New version of the offers table: batch rows merged into the known ones by `dedup_key`.

    `state` holds OFFER_STATE; `batch` one row per key with title, text, source_key, source_url, apply_url,
    published_at. Both sides are unique on the key, so one full outer join on it is the only shuffle.
    """
    details = [c for c in OFFER_DETAILS if c in batch.columns or c in state.columns]
    s = state.select(*[F.col(c).alias(f"s_{c}") for c in [*OFFER_STATE, *details] if c in state.columns])
    b = batch.select(*[F.col(c).alias(f"b_{c}") for c in ["dedup_key", "title", "text", "source_key", "source_url", "apply_url", "published_at", *details] if c in batch.columns])
    j = s.join(b, F.col("s_dedup_key") == F.col("b_dedup_key"), "full_outer")
    seen = F.col("b_dedup_key").isNotNull()
    urls = F.coalesce(F.col("s_urls"), F.array().cast("array<struct<source:string,url:string>>"))
    new_url = F.struct(F.col("b_source_key").alias("source"), F.col("b_source_url").alias("url"))
    known_url = F.exists(urls, lambda u: u["url"] == F.col("b_source_url"))
    merged = F.when(seen & ~known_url, F.concat(urls, F.array(new_url))).otherwise(urls)
    own = F.get(F.filter(merged, lambda u: says(u["source"], direct)), F.lit(0))["url"]
    old_text = F.coalesce(F.col("s_text"), F.lit(""))
    again = seen & is_repost(F.col("s_archived_at"), F.col("s_published_at"), F.col("b_published_at"), now)

    def pick(fresh: Column, old: str) -> Column:
        return F.when(seen, fresh).otherwise(F.col(old))

    def detail(c: str) -> Column:
        if c not in batch.columns:
            return F.col(f"s_{c}").alias(c)
        if c not in state.columns:
            return F.col(f"b_{c}").alias(c)
        fresh = F.coalesce(f"b_{c}", f"s_{c}") if c == "image_url" else F.col(f"b_{c}")
        return pick(fresh, f"s_{c}").alias(c)

    return j.select(
        F.coalesce("b_dedup_key", "s_dedup_key").alias("dedup_key"),
        pick(F.col("b_title"), "s_title").alias("title"),
        pick(F.when(F.length("b_text") >= F.length(old_text), F.col("b_text")).otherwise(old_text), "s_text").alias("text"),
        merged.alias("urls"),
        F.when(seen, merge_arrays(F.col("s_sources"), F.array("b_source_key"))).otherwise(F.col("s_sources")).alias("sources"),
        pick(F.coalesce(own, F.col("b_apply_url")), "s_apply_url").alias("apply_url"),
        pick(F.col("b_published_at"), "s_published_at").alias("published_at"),
        F.coalesce("s_first_seen_at", F.when(seen, now)).alias("first_seen_at"),
        pick(now, "s_last_seen_at").alias("last_seen_at"),
        pick(F.lit(None).cast(state.schema["archived_at"].dataType), "s_archived_at").alias("archived_at"),
        (F.coalesce("s_repost_count", F.lit(0)) + again.cast("int")).alias("repost_count"),
        F.when(again, now).otherwise(F.col("s_reposted_at")).alias("reposted_at"),
        *[detail(c) for c in details],
    )


def ensure_companies(batch: DataFrame, companies: DataFrame, name: str = "company") -> tuple[DataFrame, DataFrame]:
    """(companies to insert, batch with name_key): missing keys once each, known ones reused."""
    keyed = batch.withColumn("name_key", company_key(F.col(name)))
    missing = keyed.groupBy("name_key").agg(F.min(name).alias("name")).join(companies.select("name_key"), "name_key", "left_anti")
    return missing, keyed


def merge_engine_copies(offers: DataFrame, followed: DataFrame, shortest: int = R.EXCERPT_LENGTH, id: str = "offer_id") -> DataFrame:
    """Engine offers that copy an employer's own page (same title, same text); followed ones are kept.

    Own pages are reduced to their distinct fingerprints before the semi join, so no pair of offers is
    ever formed, however many copies a posting has.
    """
    def keyed(df: DataFrame) -> DataFrame:
        return once(df.select(id, "title", "text"), _title=slug(F.col("title")), _print=text_print(F.col("text"))).select(id, "_title", "_print")

    long = F.length(F.coalesce(F.col("text"), F.lit(""))) >= shortest
    own = keyed(offers.filter(~F.col("engine_only"))).select("_title", "_print").distinct()
    engine = keyed(offers.filter(F.col("engine_only") & long))
    same = skew_join(engine, own, ["_title", "_print"], "left_semi").select(id)
    return same.join(followed.select(id).distinct(), id, "left_anti")


def title_words(title: Column, company: Column, noise: list[str] = V.TITLE_NOISE) -> Column:
    """Words of a title that tell offers of one company apart."""
    drop = F.array_union(strings(noise), F.split(fold(company), "[^a-z0-9]+", -1))
    words = F.split(swap(fold(title), V.TITLE_MARKERS, " "), "[^a-z0-9]+", -1)
    return F.array_sort(F.array_except(F.filter(words, lambda w: F.length(w) > 2), drop))


def _by_rarity(words: Column) -> Column:
    """Longest words first: long words are rare, so they make small groups."""
    ranked = F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("l"), w.alias("w"))))
    return F.transform(ranked, lambda x: x["w"])


def _pair_key(a: Column, b: Column) -> Column:
    return F.concat_ws(" ", F.least(a, b), F.greatest(a, b))


def near_copies(items: DataFrame, id: str = "offer_id", company: str = "company_id", words: str = "words") -> DataFrame:
    """Engine offers whose title words hold, or are held by, those of an own-page offer of the same company.

    Set containment as an equi join: the smaller set is keyed by its two rarest words, the larger one by
    every pair of its words, and the pair is then verified. Distinct word sets only are compared.
    """
    big_enough = items.filter(F.size(words) >= 2)
    engine = big_enough.filter("engine_only").select(company, F.col(words).alias("mine")).distinct()
    own = big_enough.filter(~F.col("engine_only")).select(company, F.col(words).alias("theirs")).distinct()

    def small(df: DataFrame, c: str) -> DataFrame:
        rare = _by_rarity(F.col(c))
        return df.withColumn("_k", _pair_key(F.get(rare, F.lit(0)), F.get(rare, F.lit(1))))

    def large(df: DataFrame, c: str) -> DataFrame:
        w = F.col(c)
        pairs = F.flatten(F.transform(w, lambda a: F.transform(F.filter(w, lambda b: b > a), lambda b: _pair_key(a, b))))
        return df.withColumn("_k", F.explode(pairs))

    inside = small(engine, "mine").join(large(own, "theirs"), [company, "_k"]).filter(F.size(F.array_except("mine", "theirs")) == 0)
    around = large(engine, "mine").join(small(own, "theirs"), [company, "_k"]).filter(F.size(F.array_except("theirs", "mine")) == 0)
    hit = inside.select(company, "mine").union(around.select(company, "mine")).distinct()
    return big_enough.filter("engine_only").join(hit.withColumnRenamed("mine", words), [company, words], "left_semi").select(id)


def without_engine_copies(items: DataFrame, id: str = "offer_id", title: str = "title", company: str = "company_id", name: str = "company_name") -> DataFrame:
    worded = items.withColumn("words", title_words(F.col(title), F.col(name)))
    return items.join(near_copies(worded, id, company), id, "left_anti")
