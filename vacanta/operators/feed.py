"""Feed, board, digest and audit: joins of scores, offers, actions and applications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vacanta.functions.text import company_key, prettify
from vacanta.operators.filters import seconds_between
from vacanta.rules import views as V


def feed_rows(scores: DataFrame, offers: DataFrame, companies: DataFrame) -> DataFrame:
    """Scores with their offer and its company."""
    return scores.join(offers, "offer_id").join(companies, "company_id")


def with_actions(feed: DataFrame, actions: DataFrame, on: list[str]) -> DataFrame:
    """What the person did with each offer; nothing means neither kept nor dismissed."""
    no = F.lit(False)
    return feed.join(actions.select(*on, "saved", "dismissed"), on, "left").withColumns({"saved": F.coalesce("saved", no), "dismissed": F.coalesce("dismissed", no)})


def rank_score(interest: Column, chances: Column, bridge: Column, openness: Column) -> Column:
    """Weighted score; the weights move with the openness of the person (0 to 100)."""
    t = openness / 100.0
    zero = F.lit(0)
    return (0.7 - 0.4 * t) * F.coalesce(interest, zero) + (0.2 + 0.25 * t) * F.coalesce(chances, zero) + (0.1 + 0.15 * t) * F.coalesce(bridge, zero)


def level_rank(level: Column) -> Column:
    out = F.lit(len(V.LEVEL_ORDER))
    for name, order in V.LEVEL_ORDER.items():
        out = F.when(level == name, order).otherwise(out)
    return out


def feed_order(items: DataFrame, within: list[str] | None = None, posted: str = "posted_at", id: str = "offer_id") -> DataFrame:
    """Place of each offer: level, newest day, weighted rank, id. Ranked per person when `within` is given."""
    keys = [level_rank(F.col("level")), F.desc(F.to_date(F.col(posted))), F.desc("rank_score"), F.col(id)]
    if not within:
        return items.orderBy(*keys)
    return items.withColumn("place", F.row_number().over(Window.partitionBy(*within).orderBy(*keys)))


def feed_counts(offers: DataFrame, scores: DataFrame, version: Column | None = None) -> DataFrame:
    """total, scored, selected, pending and excluded over active offers, in one pass."""
    kept = scores if version is None else scores.filter(F.col("criteria_version") == version)
    s = kept.select("offer_id", "level").withColumn("scored", F.lit(True))
    j = offers.filter(F.col("archived_at").isNull()).select("offer_id").join(s, "offer_id", "left")
    counted = j.agg(F.count("*").alias("total"), F.count_if("scored").alias("scored_active"), F.count_if(F.col("scored") & (F.col("level") != "ecartee")).alias("selected"))
    return counted.withColumns({
        "pending": F.greatest(F.lit(0), F.col("total") - F.col("scored_active")),
        "excluded": F.greatest(F.lit(0), F.col("scored_active") - F.col("selected")),
    })


def current_scores(scores: DataFrame, profiles: DataFrame) -> DataFrame:
    """Scores of the current version of each person's search, the demonstration profile left out."""
    p = profiles.filter(~F.col("is_demo")).select(F.col("profile_id").alias("user_id"), "criteria_version")
    return scores.join(p, ["user_id", "criteria_version"], "left_semi")


def feedback(actions: DataFrame, applications: DataFrame, liked: int = 10, disliked: int = 12) -> DataFrame:
    """Newest signals per person: applied to or kept (liked), dismissed with a reason (disliked).

    Applications come before kept offers. `row_number <= k` lets every task keep k rows per person before
    the shuffle, so a very active person is no hot group.
    """
    applied = applications.select("user_id", F.lit("liked").alias("side"), F.lit(0).alias("tier"), F.col("updated_at").alias("at"), F.col("label"), F.col("id"))
    saved = actions.filter("saved").select("user_id", F.lit("liked"), F.lit(1), "updated_at", "label", "id")
    gone = actions.filter("dismissed").select("user_id", F.lit("disliked"), F.lit(0), "updated_at", F.concat("label", F.lit(" : "), F.coalesce("dismiss_reason", F.lit("sans raison"))), "id")
    ranked = applied.union(saved).union(gone).withColumn("rank", F.row_number().over(Window.partitionBy("user_id", "side").orderBy("tier", F.desc("at"), "id")))
    return ranked.filter(F.col("rank") <= F.greatest(F.lit(liked), F.lit(disliked))).filter(F.when(F.col("side") == "liked", F.col("rank") <= liked).otherwise(F.col("rank") <= disliked))


def board(applications: DataFrame, offers: DataFrame, companies: DataFrame) -> DataFrame:
    """Applications with what is known of the company, newest change first within a person."""
    o = offers.select("offer_id", "company_id")
    c = companies.select("company_id", "domain", "brand")
    return applications.join(o, "offer_id", "left").join(c, "company_id", "left")


def digest(scores: DataFrame, offers: DataFrame, dismissed: DataFrame, profiles: DataFrame, now: Column, every_hours: int = 20, top: str = "coeur") -> DataFrame:
    """New top-level matches per person since the last message (one day back for a first one)."""
    due = profiles.filter(F.col("sent_at").isNull() | (seconds_between(now, F.col("sent_at")) >= every_hours * 3600))
    due = due.withColumn("since", F.coalesce("sent_at", now - F.expr("INTERVAL 1 DAY"))).select(F.col("profile_id").alias("user_id"), "since", "criteria_version")
    fresh = scores.filter(F.col("level") == top).join(due, ["user_id", "criteria_version"]).filter(F.col("created_at") > F.col("since"))
    online = fresh.join(offers.filter(F.col("archived_at").isNull()).select("offer_id"), "offer_id", "left_semi")
    return online.join(dismissed.select("user_id", "offer_id").distinct(), ["user_id", "offer_id"], "left_anti")


def digest_top(rows: DataFrame, k: int = 10) -> DataFrame:
    """Ten rows shown per person, the rest counted."""
    w = Window.partitionBy("user_id").orderBy(F.desc("created_at"), "offer_id")
    totals = rows.groupBy("user_id").agg(F.count("*").alias("total"))
    shown = rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return shown.join(totals, "user_id").withColumn("others", F.greatest(F.lit(0), F.col("total") - k))


def new_candidates(found: DataFrame, companies: DataFrame) -> DataFrame:
    return found.join(companies.filter("ats IS NOT NULL").select("ats", F.col("ats_token").alias("token")).distinct(), ["ats", "token"], "left_anti")


def resolve_company(entries: DataFrame, companies: DataFrame) -> DataFrame:
    """A known board wins, else the same name key; neither means a new company named from its address."""
    named = entries.withColumn("shown", F.coalesce("name", prettify(F.col("token")))).withColumn("name_key", company_key(F.col("shown")))
    boards = companies.filter("ats IS NOT NULL").select("ats", F.col("ats_token").alias("token"), F.col("company_id").alias("by_board"))
    keys = companies.select("name_key", F.col("company_id").alias("by_name"))
    joined = named.join(boards, ["ats", "token"], "left").join(keys, "name_key", "left")
    found = F.coalesce("by_board", "by_name")
    return joined.select(*entries.columns, "shown", "name_key", found.alias("company_id"), F.when(F.col("by_board").isNotNull(), "board").when(F.col("by_name").isNotNull(), "name").otherwise("new").alias("via"))


def coverage_audit(listed: DataFrame, offers: DataFrame, scores: DataFrame) -> DataFrame:
    """An outside list of offers against the catalogue: new, excluded with its reason, or known since a day.

    Looked for by apply address, then by any listed address, then by key; three equality joins.
    `offers` holds offer_id, apply_url, urls, dedup_key, first_seen_at; `scores` offer_id, level, excluded_reason.
    """
    first = lambda df, key: df.groupBy(key).agg(F.min(F.struct("first_seen_at", "offer_id")).alias("hit"))
    by_apply = first(offers.select(F.col("apply_url").alias("url"), "offer_id", "first_seen_at"), "url").withColumnRenamed("hit", "a")
    by_url = first(offers.select(F.explode("urls").alias("u"), "offer_id", "first_seen_at").select(F.col("u.url").alias("url"), "offer_id", "first_seen_at"), "url").withColumnRenamed("hit", "b")
    by_key = first(offers.select("dedup_key", "offer_id", "first_seen_at"), "dedup_key").withColumnRenamed("hit", "c")
    j = listed.join(by_apply, "url", "left").join(by_url, "url", "left").join(by_key, "dedup_key", "left")
    found = j.withColumn("hit", F.coalesce("a", "b", "c")).select(*listed.columns, F.col("hit.offer_id").alias("offer_id"), F.col("hit.first_seen_at").alias("known_since"))
    judged = found.join(scores.select("offer_id", "level", "excluded_reason"), "offer_id", "left")
    kind = F.when(F.col("offer_id").isNull(), "new").when(F.col("level") == "ecartee", "excluded").otherwise("known")
    return judged.select(*listed.columns, "offer_id", kind.alias("kind"), "known_since", F.when(kind == "excluded", F.col("excluded_reason")).alias("reason"))


def verified_brand(proposals: DataFrame, offers: DataFrame) -> DataFrame:
    """Brands the employer's own postings name and that are not the employer's name again."""
    only = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    brand = F.trim(F.regexp_replace("brand", r"\s*\(.*?\)\s*", " "))
    p = proposals.withColumn("brand", brand).filter((F.col("brand") != "") & (only(F.col("brand")) != only(F.col("name"))))
    said = offers.select("company_id", F.lower(F.concat_ws("\n", "title", "text")).alias("said"))
    return said.join(p, "company_id").filter(F.contains(F.col("said"), F.lower("brand"))).select("company_id", "name", "brand").distinct()


def cv_targets(scores: DataFrame, applications: DataFrame) -> DataFrame:
    """The offers of a person that are not set aside, those already followed first, then by interest."""
    best = scores.filter(F.col("level") != "ecartee").withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc_nulls_last("score_interet"), "offer_id")))
    tracked = applications.select("user_id", "offer_id").distinct().withColumn("tracked", F.lit(True))
    j = best.join(tracked, ["user_id", "offer_id"], "left").withColumn("tracked", F.coalesce("tracked", F.lit(False)))
    return j.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("tracked"), "rank")))


def erase_user(tables: dict[str, DataFrame], users: DataFrame, key: str = "user_id") -> dict[str, DataFrame]:
    """Every table without the rows of the given people."""
    return {name: df.join(users.select(key).distinct(), key, "left_anti") for name, df in tables.items()}


def sample_checks(scores: DataFrame, checks: DataFrame, seed: int, k: int = 1) -> DataFrame:
    """Verdicts of a person not checked yet, in an order that a seed fixes."""
    todo = scores.join(checks.select("user_id", "offer_id").distinct(), ["user_id", "offer_id"], "left_anti")
    return todo.orderBy(F.xxhash64(F.col("offer_id"), F.lit(seed)), "offer_id").limit(k)


def open_reports(reports: DataFrame, offers: DataFrame, k: int = 40) -> DataFrame:
    newest = reports.filter("resolved_at IS NULL").orderBy(F.desc("created_at"), "report_id").limit(k)
    return newest.join(offers.select("offer_id", "title"), "offer_id", "left").withColumn("title", F.coalesce("title", F.lit("Offre supprimée")))


def invitees(accounts: DataFrame, invited: DataFrame) -> DataFrame:
    """Accounts, then the invitations not used yet."""
    people = accounts.select(F.lower("email").alias("email"), F.lit(True).alias("account"))
    waiting = invited.select(F.lower("email").alias("email")).distinct().join(people.select("email"), "email", "left_anti").withColumn("account", F.lit(False))
    return people.unionByName(waiting)
