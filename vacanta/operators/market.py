"""Counts of a market and of the admin views: mixes, buckets, ranges, trends, employers, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vacanta.columns import half_up
from vacanta.operators.filters import DAY, is_intermediary, seconds_between
from vacanta.rules import views as V
from vacanta.session import broadcast_if_small, settle, skew_join


def _over(by: list[str]) -> list:
    return by or [F.lit(0)]


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, half_up(100 * part / whole)).otherwise(0).cast("int")


def offers_by_source(offers: DataFrame, sources: str = "sources") -> DataFrame:
    """Active offers per source family (what stands before the colon of the first source)."""
    family = F.substring_index(F.get(F.col(sources), F.lit(0)), ":", 1)
    return offers.filter("archived_at IS NULL").groupBy(family.alias("source")).agg(F.count("*").alias("n"))


def per_day(df: DataFrame, at: str, last: str, days: int, zone: str = "Europe/Paris") -> DataFrame:
    """Rows per local day over `days` days up to `last` (a date), missing days as 0."""
    local = F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col(at).cast("timestamp_ntz")))
    end = F.lit(last).cast("date")
    counted = df.filter(local.between(F.date_sub(end, days - 1), end)).groupBy(local.alias("day")).agg(F.count("*").alias("n"))
    spine = df.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(end, days - 1), end)).alias("day"))
    return spine.join(counted, "day", "left").fillna(0, ["n"])


def directory_origins(companies: DataFrame) -> DataFrame:
    return companies.filter("ats IS NOT NULL").groupBy(F.coalesce("discovered_via", F.lit("crawl")).alias("origin")).agg(F.count("*").alias("n"))


def levels(scores: DataFrame) -> DataFrame:
    return scores.groupBy("level").agg(F.count("*").alias("n"))


def experience_bucket(years: Column, level: Column) -> Column:
    L = V.EXPERIENCE_BUCKETS
    return (
        F.when(years.isNull(), F.when(level == "experienced", L[4]).otherwise(L[5]))
        .when(years <= 1, L[0]).when(years < 3, L[1]).when(years < 5, L[2]).otherwise(L[3])
    )


def experience_buckets(base: DataFrame, by: list[str] | None = None, years: str = "experience_min_years", level: str = "experience_level") -> DataFrame:
    return base.groupBy(*(by or []), experience_bucket(F.col(years), F.col(level)).alias("label")).agg(F.count("*").alias("count"))


def three_plus_share(buckets: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Share asking three years or more among those that state years."""
    L = V.EXPERIENCE_BUCKETS
    stated = buckets.filter(F.col("label").isin(L[:4]))
    summed = stated.groupBy(*(by or [])).agg(F.sum("count").alias("stated"), F.coalesce(F.sum(F.when(F.col("label").isin(L[2:4]), F.col("count"))), F.lit(0)).alias("three_plus"))
    return summed.withColumn("share", percent(F.col("three_plus"), F.col("stated")))


def ordered_bits(value: Column) -> Column:
    """A long that orders as the double does; -0 equals 0, NaN comes last."""
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value + F.lit(0.0)).cast("bigint")
    return F.when(bits < 0, bits.bitwiseXOR(F.lit(2**63 - 1))).otherwise(bits)


def values_at(df: DataFrame, value: str, shares: dict[str, float], by: list[str] | None = None, least: int = 5, digit: int = 16) -> DataFrame:
    """Element at floor(p·(n−1)) of the sorted values, per group; groups under `least` values give nulls.

    Radix selection: equal values are counted first, then each pass counts the rows by the next `digit` bits of the
    value's ordered form and keeps the digit that holds the rank. Nothing is sorted and no task sees more than
    2^`digit` counts of a group, however the values are spread.
    """
    by = by or []
    hist = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
    hist = settle(hist.withColumn("bits", ordered_bits(F.col("v"))))
    size = hist.groupBy(*by).agg(F.sum("c").alias("n"))
    ranks = F.array(*[F.struct(F.lit(name).alias("rank"), F.floor(F.lit(p) * (F.col("n") - 1)).cast("bigint").alias("at")) for name, p in shares.items()])
    state = size.withColumn("r", F.explode(ranks)).select(*by, "r.rank", "r.at")
    shift, known = 64, None
    while shift > 0:
        shift = max(0, shift - digit)
        head = F.shiftright("bits", shift)
        if known is None:
            counted = hist.groupBy(*by, head.alias("head")).agg(F.sum("c").alias("c"), F.max("v").alias("v"))
            counted = counted.join(state, by) if by else counted.join(F.broadcast(state), F.lit(True))
        else:
            side, small = broadcast_if_small(state.withColumnRenamed("head", "known"))
            headed = hist.withColumn("known", F.shiftright("bits", known))
            met = headed.join(side, [*by, "known"]) if small else skew_join(headed, side, [*by, "known"], "inner")
            counted = met.groupBy(*by, "rank", "at", head.alias("head")).agg(F.sum("c").alias("c"), F.max("v").alias("v"))
        upto = F.sum("c").over(Window.partitionBy(*by, "rank").orderBy("head").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        held = counted.withColumn("upto", upto).filter((F.col("upto") - F.col("c") <= F.col("at")) & (F.col("at") < F.col("upto")))
        # A few rows per group: the digit of each rank, and how many values of it come before.
        state = held.select(*by, "rank", (F.col("at") - (F.col("upto") - F.col("c"))).alias("at"), "head", *([] if shift else ["v"]))
        state, known = (settle(state) if shift else state), shift
    picks = [F.max(F.when(F.col("rank") == name, F.col("v"))).alias(name) for name in shares]
    found = state.groupBy(*by).agg(*picks)
    out = found.join(size, by) if by else found.join(F.broadcast(size), F.lit(True))
    return out.select(*by, *[F.when(F.col("n") >= least, F.col(name)).alias(name) for name in shares], "n")


def salary_range(pay: DataFrame, value: str = "k", by: list[str] | None = None, least: int = 5) -> DataFrame:
    return values_at(pay, value, {"low": 0.25, "median": 0.5, "high": 0.75}, by, least)


def mix(base: DataFrame, column: str, by: list[str] | None = None, unknown: str | None = None) -> DataFrame:
    """Count of each value and its share of the rows that state one."""
    rows = base.filter(F.col(column) != unknown) if unknown else base
    counted = rows.groupBy(*(by or []), column).agg(F.count("*").alias("count"))
    total = F.sum("count").over(Window.partitionBy(*_over(by or [])))
    return counted.withColumn("share", percent(F.col("count"), total))


def shares(df: DataFrame, count: str = "n", by: list[str] | None = None) -> DataFrame:
    return df.withColumn("share", percent(F.col(count), F.sum(count).over(Window.partitionBy(*_over(by or [])))))


def who_hires(offers: DataFrame, now: Column, company: str = "company_id", posted: str = "posted_at", by: list[str] | None = None) -> DataFrame:
    """Offers per employer over the last 30 days and the 30 before, employers without a recent one left out."""
    age = seconds_between(now, F.col(posted))
    recent = F.count_if((age >= 0) & (age < 30 * DAY))
    earlier = F.count_if((age >= 30 * DAY) & (age < 60 * DAY))
    seen = offers.filter((age >= 0) & (age < 60 * DAY))
    return seen.groupBy(*(by or []), company).agg(recent.alias("recent"), earlier.alias("before")).filter("recent > 0")


def top_employers(hiring: DataFrame, companies: DataFrame, ranked: int = 20, kept: int = 8, company: str = "company_id", by: list[str] | None = None) -> DataFrame:
    """The 20 that hire most, intermediaries removed after the ranking, 8 kept."""
    by = by or []
    order = [F.desc("recent"), F.col(company)]
    first = hiring.withColumn("_r", F.row_number().over(Window.partitionBy(*_over(by)).orderBy(*order))).filter(F.col("_r") <= ranked)
    named = first.join(companies.select(company, "name"), company).filter(~is_intermediary(F.col("name")))
    return named.withColumn("rank", F.row_number().over(Window.partitionBy(*_over(by)).orderBy("_r"))).filter(F.col("rank") <= kept).drop("_r")


def new_this_week(base: DataFrame, now: Column, posted: str = "posted_at", by: list[str] | None = None) -> DataFrame:
    age = seconds_between(now, F.col(posted))
    fresh = F.count_if((age >= 0) & (age < 7 * DAY)).alias("new_this_week")
    return base.groupBy(*(by or [])).agg(F.count("*").alias("total"), fresh)


def run_reports(results: DataFrame, family: str = "ats") -> DataFrame:
    """Board reports summed per family, with the first error met."""
    failed = F.when(F.col("error").isNotNull(), F.concat_ws(": ", "token", "error"))
    first = F.min_by(failed, F.when(F.col("error").isNotNull(), F.col("started_at")))
    return results.groupBy(family).agg(F.sum("seen").alias("seen"), F.sum("created").alias("created"), F.sum("archived").alias("archived"), first.alias("error"))


def source_health(runs: DataFrame, silent_hours: int = 6) -> DataFrame:
    """Latest run of each source beside the previous one; sources silent before the newest run left out.

    Only the two newest runs per source leave each task, whatever the number of runs.
    """
    order = Window.partitionBy("source").orderBy(F.desc("started_at"), F.desc("run_id"))
    two = runs.withColumn("r", F.row_number().over(order)).filter("r <= 2")
    last = lambda c: F.max(F.when(F.col("r") == 1, F.col(c)))
    rows = two.groupBy("source").agg(
        last("started_at").alias("started_at"), last("offers_seen").alias("offers_seen"), last("errors").alias("errors"),
        last("error_sample").alias("error_sample"), F.max(F.when(F.col("r") == 2, F.col("offers_seen"))).alias("previous_seen"),
    )
    newest = F.max("started_at").over(Window.partitionBy(F.lit(0)))
    return rows.withColumn("newest", newest).filter(seconds_between(F.col("newest"), F.col("started_at")) < silent_hours * 3600).drop("newest")


def whole(c: Column) -> Column:
    return F.when(c == F.floor(c), F.floor(c).cast("bigint").cast("string")).otherwise(c.cast("string"))


def health_state(rows: DataFrame) -> DataFrame:
    dropped = (F.col("previous_seen") > 10) & (F.col("offers_seen") < F.col("previous_seen") * 0.5)
    sample = F.coalesce("error_sample", F.lit("inconnue"))
    state = (
        F.when((F.col("errors") > 0) & (F.col("offers_seen") > 0), F.concat(F.lit("OK, "), F.col("errors").cast("string"), F.lit(" page"), F.when(F.col("errors") > 1, "s").otherwise(""), F.lit(" en erreur ("), sample, F.lit(")")))
        .when(F.col("errors") > 0, F.concat(F.lit("Erreur : "), sample))
        .when(F.col("offers_seen") == 0, "Aucune offre")
        .when(dropped, F.concat(F.lit("Chute ("), whole(F.col("previous_seen")), F.lit(" → "), whole(F.col("offers_seen")), F.lit(")")))
        .otherwise("OK")
    )
    return rows.withColumn("state", state)


def trend_reference(snapshots: DataFrame, same: list[str], day: str = "day", history_from: str | None = None) -> DataFrame:
    """For each snapshot, the earlier one nearest to seven days before, at least five days old, counted alike.

    Two range frames over the days of one profile: the last at seven days or more, the first between six
    and five. No pair of snapshots is formed. On equal distance the newer one wins, as in a newest-first list.
    """
    n = F.datediff(F.col(day), F.lit("1970-01-01").cast("date"))
    rows = snapshots.withColumn("_n", n)
    w = Window.partitionBy(*same).orderBy("_n")
    usable = F.when(F.col(day) >= F.lit(history_from).cast("date"), F.col("_n")) if history_from else F.col("_n")
    older = F.max(usable).over(w.rangeBetween(Window.unboundedPreceding, -7))
    nearer = F.min(usable).over(w.rangeBetween(-6, -5))
    back, ahead = F.abs(older - (F.col("_n") - 7)), F.abs(nearer - (F.col("_n") - 7))
    pick = F.when(older.isNull(), nearer).when(nearer.isNull(), older).when(ahead <= back, nearer).otherwise(older)
    return rows.withColumn("reference", F.date_add(F.lit("1970-01-01").cast("date"), pick)).drop("_n")


def trend(today: DataFrame, reference: DataFrame, on: list[str], least: int = 3) -> DataFrame:
    """Change of share per skill; a move of one or two offers is no trend."""
    b = reference.select(*on, F.col("count").alias("_c"), F.col("share").alias("_s"))
    return today.join(b, on).filter(F.abs(F.col("count") - F.col("_c")) >= least).withColumn("change", F.col("share") - F.col("_s")).drop("_c", "_s")


def progress_counts(apps: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Applications sent, interviews reached and response rate. Sent = any stage after the first."""
    sent = apps.filter(F.col("stage") != "a_postuler")
    answered = F.count_if(F.col("stage").isin("entretien", "offre", "refuse"))
    interviews = F.count_if(F.col("stage").isin("entretien", "offre") | F.col("interview_at").isNotNull())
    out = sent.groupBy(*(by or [])).agg(F.count("*").alias("sent"), interviews.alias("interviews"), answered.alias("answered"))
    return out.withColumn("response_rate", percent(F.col("answered"), F.col("sent"))).drop("answered")


def progress_weeks(apps: DataFrame, now: str, weeks: int = 8) -> DataFrame:
    """Applications sent per Monday week, the last `weeks` weeks, empty ones as 0."""
    end = F.to_date(F.date_trunc("week", F.lit(now).cast("timestamp_ntz")))
    sent = apps.filter(F.col("stage") != "a_postuler").withColumn("week", F.to_date(F.date_trunc("week", F.coalesce("applied_at", "created_at"))))
    counted = sent.filter(F.col("week").between(F.date_sub(end, 7 * (weeks - 1)), end)).groupBy("week").agg(F.count("*").alias("n"))
    spine = apps.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(end, 7 * (weeks - 1)), end, F.expr("INTERVAL 7 DAYS"))).alias("week"))
    return spine.join(counted, "week", "left").fillna(0, ["n"])


def check_stats(checks: DataFrame, now: Column | None = None, days: int = 90) -> DataFrame:
    """Agreement of spot checks, overall (null level) and per level; with `now`, of those of the last `days` (`checked_at`)."""
    recent = checks if now is None else checks.filter(seconds_between(now, F.col("checked_at")) <= days * DAY)
    return recent.rollup("level").agg(F.count("*").alias("n"), F.count_if("right_call").alias("right"))


def choices(actions: DataFrame, applications: DataFrame) -> DataFrame:
    """What choices say: offers kept (applications included) and dismissals per reason."""
    kept = actions.filter("saved").select(F.lit("kept").alias("choice")).union(applications.select(F.lit("kept")))
    gone = actions.filter("dismissed").select(F.coalesce("dismiss_reason", F.lit("Sans raison")).alias("choice"))
    return kept.union(gone).groupBy("choice").agg(F.count("*").alias("n"))


def search_scope(profiles: DataFrame, k: int = 8) -> DataFrame:
    """Searches made for people: role and place counted over profiles, the most shared first."""
    roles = profiles.select(F.explode("roles").alias("role"), "place", "country", "profile_id")
    keyed = roles.withColumn("what", F.lower(F.trim("role")))
    counted = keyed.groupBy("what", "place").agg(F.count("*").alias("n"), F.max("country").alias("country"))
    return counted.orderBy(F.desc("n"), "what", "place").limit(k)


def company_searches(favorites: DataFrame, companies: DataFrame, kept: int | None = None) -> DataFrame:
    """Favourite companies without a board that can be read: searched by name, once each.

    `favorites` holds company_id, `companies` company_id, name and ats.
    """
    unread = companies.filter(F.col("ats").isNull()).join(favorites.select("company_id").distinct(), "company_id", "left_semi")
    names = unread.select(F.col("name").alias("company")).distinct().orderBy("company")
    return names if kept is None else names.limit(kept)


def dashboard(offers: DataFrame, companies: DataFrame, profiles: DataFrame, applications: DataFrame, favorites: DataFrame) -> DataFrame:
    """Counters of the admin page in one row: a pass per table.

    `offers` holds archived_at, `companies` ats, `profiles` onboarded_at, `applications` status, `favorites` user_id.
    """
    n = lambda df, name, *when: df.agg((F.count_if(when[0]) if when else F.count("*")).alias(name))
    parts = [
        n(offers, "active_offers", F.col("archived_at").isNull()), n(companies, "directory", F.col("ats").isNotNull()), n(profiles, "onboarded", F.col("onboarded_at").isNotNull()),
        applications.agg(F.count("*").alias("applications"), F.count_if(F.col("status") == "added").alias("added")), n(favorites, "favorites"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(F.broadcast(part), F.lit(True))
    return out


def companies_view(feed: DataFrame, favorites: DataFrame, others: int = 40, company: str = "company_id") -> DataFrame:
    """Employers of a selection: favourites first, then the 40 with most offers."""
    counted = feed.groupBy(company).agg(F.count("*").alias("total"), F.count_if(F.col("level") == "coeur").alias("coeur"))
    fav = favorites.select(company).distinct().withColumn("favorite", F.lit(True))
    j = counted.join(fav, company, "left").withColumn("favorite", F.coalesce("favorite", F.lit(False)))
    ranked = j.withColumn("rank", F.row_number().over(Window.partitionBy("favorite").orderBy(F.desc("total"), company)))
    return ranked.filter(F.col("favorite") | (F.col("rank") <= others))


def pick_showcase(rows: DataFrame, jobs: list[tuple[str, str]], picked: int = 3, title: str = "title", company: str = "company_id", id: str = "offer_id") -> DataFrame:
    """First offer of each category, companies all different, in category order."""
    matched = rows.withColumn("category", F.explode(F.filter(F.array(*[F.when(F.col(title).rlike(p), F.struct(F.lit(i).alias("order"), F.lit(n).alias("name"))) for i, (n, p) in enumerate(jobs)]), lambda x: x.isNotNull())))
    # A category can lose at most one company to each category before it, so its best offers of that many
    # different companies are enough for an exact pick.
    best = matched.groupBy("category", company).agg(F.min_by(F.struct(id, title, company), F.struct((-F.unix_micros(F.col("posted_at").cast("timestamp"))).alias("t"), F.col(id))).alias("o"), F.min(F.struct((-F.unix_micros(F.col("posted_at").cast("timestamp"))).alias("t"), F.col(id))).alias("at"))
    short = best.withColumn("r", F.row_number().over(Window.partitionBy("category").orderBy("at"))).filter(F.col("r") <= len(jobs))
    listed = short.groupBy().agg(F.array_sort(F.collect_list(F.struct("category", "at", "o"))).alias("all"))
    empty = F.array().cast(f"array<struct<name:string,{id}:bigint,{title}:string,{company}:string>>")
    chosen = F.aggregate(
        "all", empty,
        lambda acc, x: F.when(
            (F.size(acc) < picked)
            & ~F.exists(acc, lambda a: a["name"] == x["category"]["name"])
            & ~F.exists(acc, lambda a: a[company] == x["o"][company].cast("string")),
            F.concat(acc, F.array(F.struct(x["category"]["name"].alias("name"), x["o"][id].cast("bigint").alias(id), x["o"][title].alias(title), x["o"][company].cast("string").alias(company)))),
        ).otherwise(acc),
    )
    return listed.select(F.posexplode(chosen).alias("place", "c")).select("place", "c.*")


def rotation(companies: DataFrame, at: str = "last_collected_at", id: str = "company_id", n: int | None = None) -> DataFrame:
    """Boards in reading order: never read first, then the least recent."""
    ordered = companies.orderBy(F.asc_nulls_first(at), id)
    return ordered.limit(n) if n else ordered


def backfill_days(profiles: DataFrame, known: DataFrame, now: str, start: str = "history_from") -> DataFrame:
    """Snapshot days to rebuild: weekly steps back to the start, plus the start when no step is near it."""
    today = F.lit(now).cast("date")
    first = F.col(start).cast("date")
    weekly = F.when(F.date_sub(today, 7) >= first, F.transform(F.sequence(F.lit(1), F.greatest(F.floor(F.datediff(today, first) / 7).cast("int"), F.lit(1))), lambda k: F.date_sub(today, k * 7))).otherwise(F.array().cast("array<date>"))
    near = F.exists(weekly, lambda d: F.abs(F.datediff(d, first)) < 3)
    with_start = F.when((F.datediff(today, first) >= 5) & ~near, F.concat(weekly, F.array(first))).otherwise(weekly)
    steps = profiles.select("profile_id", F.explode(with_start).alias("day"))
    return steps.join(known.select("profile_id", "day").distinct(), ["profile_id", "day"], "left_anti")


def recheck_queue(offers: DataFrame, now: Column, days: int = 3, id: str = "offer_id") -> DataFrame:
    """Engine-only active offers to check again, in their order: never checked first, then the oldest check. The reader takes as many as it can."""
    due = F.col("completed_at").isNull() | (seconds_between(now, F.col("completed_at")) > days * DAY)
    return offers.filter(F.col("engine_only") & F.col("archived_at").isNull() & due).orderBy(F.asc_nulls_first("completed_at"), id)


def history(snapshots: DataFrame, k: int = 60, profile: str = "profile_id", day: str = "day") -> DataFrame:
    return snapshots.withColumn("rank", F.row_number().over(Window.partitionBy(profile).orderBy(F.desc(day)))).filter(F.col("rank") <= k)


def posting_age(posted: Column, reposted: Column, repost_count: Column, published: Column, now: Column) -> Column:
    """What a posting's dates say: published again, open for over 90 days, for over 30."""
    age = F.floor(seconds_between(now, posted) / DAY)
    again = (F.coalesce(repost_count, F.lit(0)) > 0) & (F.abs(seconds_between(published, reposted)) <= 3 * DAY)
    aged = F.when(age >= 90, "over_90_days").when(age >= 30, "over_30_days")
    return F.struct(F.coalesce(again, F.lit(False)).alias("reposted"), aged.alias("age"))
