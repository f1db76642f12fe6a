"""Market of every profile in one job: base of offers, counts, daily pictures, page and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vacanta.columns import once
from vacanta.functions import relevance as V
from vacanta.functions.lines import split_requirements
from vacanta.functions.signals import has_junior_title, is_student, salary_midpoint
from vacanta.functions.text import rule_text
from vacanta.operators import market as M
from vacanta.operators.dedup import copies, dedup_texts, text_print
from vacanta.operators.filters import active_at, is_excerpt
from vacanta.operators.relevance import role_phrases, title_counts, title_matrix
from vacanta.operators.skills import cited_counts, market_insights, skill_demand, skill_groups, top_by_kind, weighed
from vacanta.rules import relevance as RR
from vacanta.rules import skills as KR
from vacanta.session import broadcast_if_small, settle

METHOD = 2
TEXT_MIN = 300


def named_offers(offers: DataFrame, profiles: DataFrame, at: Column) -> DataFrame:
    """(profile, offer) of offers active at a time whose title names the role (`naming_offers`)."""
    return naming_offers(active_at(offers, at), profiles)


def naming_offers(online: DataFrame, profiles: DataFrame) -> DataFrame:
    """(profile, offer) of offers read in full whose title names the role, in full or with the text's help.

    Titles meet roles by equality on words; texts are cut into words only for the offers that are left.
    """
    phrases = role_phrases(profiles, bridges=None)
    near = title_matrix(online, phrases).filter(F.col("score") * F.col("weight") >= RR.MIN_TITLE_RELEVANCE)
    # Used for the texts to read and for the pairs: kept once, a line per title and role that meet.
    near = settle(near.select("title", "profile_id", "core", "words", "title_words"))
    full = online.filter(~is_excerpt(F.col("text"), F.col("engine_only"))).join(near.select("title").distinct(), "title", "left_semi")
    read = once(full.select("offer_id", "title", "text"), text_words=F.array_distinct(V.tokens(F.concat_ws(" ", "title", "text"))), parts=V.title_parts(F.col("title")))
    named = V.names_role(F.col("title"), F.col("title_words"), F.col("parts"), F.col("text_words"), F.col("core"), F.col("words"))
    return read.drop("text").join(near, "title").filter(named).select("profile_id", "offer_id").distinct()


def market_base(offers: DataFrame, profiles: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """(base, copies): one row per profile and text, and the copies left out."""
    pairs = settle(named_offers(offers, profiles, at))
    rows = active_at(offers, at).join(pairs, "offer_id")
    base = dedup_texts(rows, within=["profile_id"])
    return base, copies(pairs, base, ["profile_id", "offer_id"])


def market_counts(base: DataFrame, at: Column) -> dict[str, DataFrame]:
    """Figures of each profile: totals, experience, juniors, pay, remote and contract mixes."""
    by = ["profile_id"]
    marked = once(base.withColumn("_t", rule_text(F.col("title"))), junior_title=has_junior_title(F.col("_t")), student=is_student(F.col("_t"), F.col("contract")), k=salary_midpoint(F.col("salary_text")))
    junior = marked.filter(F.col("junior_title") & ~F.col("student"))
    years = F.col("experience_min_years")
    starts = F.when(years.isNotNull(), years <= 1).otherwise((F.col("junior_title") & ~F.col("student")) | F.coalesce(F.col("experience_level") == "junior", F.lit(False)))
    pay = marked.filter(~F.col("student") & F.col("k").isNotNull())
    known = F.when(F.col("remote").isin("remote", "hybrid", "onsite"), F.col("remote")).otherwise("unknown")
    return {
        "totals": M.new_this_week(base, at, by=by),
        "experience": M.experience_buckets(base, by),
        "juniors": junior.groupBy(*by).agg(F.count("*").alias("junior_labeled"), F.count_if(F.coalesce(years, F.lit(0)) >= 2).alias("junior_asking_2")),
        "junior_pay": M.salary_range(pay.filter(starts), "k", by),
        "experienced_pay": M.salary_range(pay.filter(F.coalesce(years, F.lit(0)) >= 3), "k", by),
        "remote": M.mix(base.withColumn("remote", known), "remote", by),
        "contracts": M.mix(base, "contract", by, unknown="unknown"),
    }


def market_skills(base: DataFrame, vocabulary: DataFrame, k: int | None = 12, guard: bool = True, parts=split_requirements) -> DataFrame:
    """Skills asked per profile, wishes apart, the k first of each kind."""
    long = base.filter(F.length("text") > TEXT_MIN)
    # No generated row here: readers of the ids alone leave the parts out.
    read = long.select("profile_id", "offer_id", "text", parts(F.col("text")).alias("p")).select("profile_id", "offer_id", "text", F.col("p.required").alias("required"), F.col("p.bonus").alias("bonus"))
    asked = skill_demand(read, skill_groups(vocabulary), required="required", bonus="bonus", market="profile_id", guard=guard)
    return top_by_kind(asked, k, ["profile_id"]) if k else asked


def market_employers(offers: DataFrame, profiles: DataFrame, base: DataFrame, left_out: DataFrame, companies: DataFrame, at: Column) -> DataFrame:
    """Who hires for each role: the base, and own-page offers of any age whose title names the role in full."""
    near = title_matrix(offers, role_phrases(profiles, bridges=None)).filter(F.col("score") * F.col("weight") >= RR.FULL_NAME_RELEVANCE).select("title", "profile_id").distinct()
    older = offers.filter(~F.col("engine_only")).join(near, "title").select("profile_id", "offer_id", "company_id", "posted_at")
    both = base.select("profile_id", "offer_id", "company_id", "posted_at").unionByName(older).dropDuplicates(["profile_id", "offer_id"])
    counted = both.join(left_out.select("profile_id", "offer_id"), ["profile_id", "offer_id"], "left_anti")
    return M.top_employers(M.who_hires(counted, at, by=["profile_id"]), companies, by=["profile_id"])


def market_picture(offers: DataFrame, profiles: DataFrame, vocabulary: DataFrame, companies: DataFrame, at: Column) -> dict[str, DataFrame]:
    """The whole picture of every profile at one time."""
    base, left_out = market_base(offers, profiles, at)
    kept = settle(base)
    roles = profiles.select("profile_id", F.explode(F.array_distinct(F.concat("target_roles", "title_variants"))).alias("role"))
    return {
        **market_counts(kept, at),
        "skills": market_skills(kept, vocabulary),
        "titles": title_counts(kept, roles, by="profile_id"),
        "employers": market_employers(offers, profiles, kept, left_out, companies, at),
    }


def market_page(skills: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(today, insights): the latest skills per profile marked by the CV's own list, and the advice drawn from them.

    `skills` holds profile_id, day, key, name, kind, count, bonus, share; `known` profile_id, key.
    """
    latest = skills.groupBy("profile_id").agg(F.max("day").alias("day"))
    now = skills.join(latest, ["profile_id", "day"], "left_semi")
    marked = now.join(known.select("profile_id", "key").distinct().withColumn("in_cv", F.lit(True)), ["profile_id", "key"], "left").withColumn("in_cv", F.coalesce("in_cv", F.lit(False)))
    return marked, market_insights(marked, ["profile_id"])


def market_trend(skills: DataFrame, history_from: str | None = None) -> DataFrame:
    """Change of each skill against the picture of about a week before, counted the same way."""
    days = skills.select("profile_id", "role", "method", "day").distinct()
    latest = days.groupBy("profile_id").agg(F.max("day").alias("day"))
    refs = M.trend_reference(days, ["profile_id", "role", "method"], history_from=history_from).filter(F.col("method") == METHOD)
    wanted = refs.join(latest, ["profile_id", "day"], "left_semi").filter("reference IS NOT NULL")
    today = skills.join(wanted.select("profile_id", "day", "reference"), ["profile_id", "day"])
    before = skills.select("profile_id", F.col("day").alias("reference"), "key", "count", "share")
    return M.trend(today, before, ["profile_id", "reference", "key"])


def days_online(offers: DataFrame, days: list[str]) -> Column:
    """Whether an offer is active at noon of each day, as an array of booleans."""
    kind = offers.schema["posted_at"].dataType
    posted, gone = F.col("posted_at"), F.col("archived_at")
    return F.array(*[F.coalesce((posted <= at) & (gone.isNull() | (gone > at)), F.lit(False)) for at in (F.lit(f"{d} 12:00:00").cast(kind) for d in days)])


def rebuild_history(offers: DataFrame, profiles: DataFrame, vocabulary: DataFrame, days: list[str], guard: bool = True, parts=split_requirements) -> DataFrame:
    """Skills of past days, `(profile_id, day, key, name, kind, count, bonus, share)`, all days in one job.

    Each text is read once. Of the copies of a text, each day counts the one that day's base would keep. Its stay becomes
    +1 where it begins and -1 where it ends, added up per profile and skill; running sums give every day. `days` are in order.
    """
    by = ["profile_id"]
    online = settle(offers.withColumn("online", days_online(offers, days)).filter(F.exists("online", lambda x: x)))
    pairs = settle(naming_offers(online, profiles))
    prints = online.join(pairs.select("offer_id").distinct(), "offer_id", "left_semi").select("offer_id", "engine_only", "online", text_print(F.col("text")).alias("print"))
    rows = pairs.join(prints, "offer_id")
    # Per day the employer's own page first, then the smallest id: plain minima, a few per text.
    own = [F.min(F.when(F.col("online")[k] & ~F.col("engine_only"), F.col("offer_id"))).alias(f"o{k}") for k in range(len(days))]
    any_ = [F.min(F.when(F.col("online")[k], F.col("offer_id"))).alias(f"a{k}") for k in range(len(days))]
    winners = rows.groupBy(*by, "print").agg(*own, *any_)
    kept = F.array(*[F.coalesce(f"o{k}", f"a{k}") for k in range(len(days))])
    # Runs of days that one copy holds: it comes where the day before had another, and goes where the next one has.
    each = winners.select(*by, kept.alias("kept"))
    steps = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(len(days) - 1)), lambda k: F.array(
        F.struct(F.get("kept", k).alias("offer_id"), k.alias("k"), (~F.get("kept", k).eqNullSafe(F.get("kept", k - 1))).cast("int").alias("step")),
        F.struct(F.get("kept", k - 1).alias("offer_id"), k.alias("k"), (-(~F.get("kept", k).eqNullSafe(F.get("kept", k - 1))).cast("int")).alias("step")),
    )))
    events = settle(each.select(*by, F.explode(steps).alias("e")).select(*by, "e.*").filter("offer_id IS NOT NULL AND step <> 0"))
    long = online.filter(F.length("text") > TEXT_MIN).join(events.select("offer_id").distinct(), "offer_id", "left_semi")
    groups = settle(skill_groups(vocabulary))
    # Texts that come and go alike are counted together: the ways to do so are few.
    ways = settle(events.groupBy("offer_id").agg(F.array_sort(F.collect_list(F.struct(*by, "k", "step"))).alias("stays")))
    way = settle(ways.select("stays").distinct().withColumn("way", F.monotonically_increasing_id()))
    there = ways.join(broadcast_if_small(way)[0], "stays").select("offer_id", "way")
    read = long.select("offer_id", "text").join(there, "offer_id").select("offer_id", "way", "text", parts(F.col("text")).alias("p")).select("offer_id", "way", "text", F.col("p.required").alias("required"), F.col("p.bonus").alias("bonus"))
    cited = cited_counts(read, groups, ["way"], "offer_id", required="required", bonus="bonus", known=online.join(there, "offer_id").select("way", "offer_id"))
    stays = events.join(long.select("offer_id"), "offer_id", "left_semi")
    moved = cited.join(broadcast_if_small(way)[0], "way").select("key", "count", "bonus", F.explode("stays").alias("e"))
    changes = moved.groupBy(*[F.col(f"e.{c}").alias(c) for c in by], "key", F.col("e.k").alias("k")).agg(F.sum(F.col("e.step") * F.col("count")).alias("count"), F.sum(F.col("e.step") * F.col("bonus")).alias("bonus"))
    counted = running(changes, [*by, "key"], ["count", "bonus"], days)
    sizes = running(stays.groupBy(*by, "k").agg(F.sum("step").alias("read")), by, ["read"], days)
    return weighed(counted, sizes, groups, [*by, "day"], guard)


def running(changes: DataFrame, by: list[str], values: list[str], days: list[str]) -> DataFrame:
    """Value of every day from changes `(by, k, values)` at the days they happen: one short row per group."""
    at = F.map_from_entries(F.collect_list(F.struct("k", F.struct(*[F.col(v).cast("bigint").alias(v) for v in values]))))
    held = changes.groupBy(*by).agg(at.alias("at"))
    zero = F.struct(*[F.lit(0).cast("bigint").alias(v) for v in values])
    add = lambda a, b: F.struct(*[(a[v] + F.coalesce(b[v], F.lit(0))).alias(v) for v in values])
    until = lambda k: F.aggregate(F.sequence(F.lit(0), k), zero, lambda acc, j: add(acc, F.try_element_at("at", j)))
    every = F.transform(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(d).cast("date").alias("day")) for k, d in enumerate(days)]), lambda x: F.struct(x["day"].alias("day"), until(x["k"]).alias("v")))
    return held.select(*by, F.explode(every).alias("e")).select(*by, F.col("e.day").alias("day"), *[F.col(f"e.v.{v}").alias(v) for v in values])


KINDS = KR.KINDS
