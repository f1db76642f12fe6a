"""Sort of offers for every profile: gates, relevance, reuse, full-text checks, verdict rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vacanta.functions.geo import zone_keys
from vacanta.functions.languages import missing_language, required_languages, spoken_languages
from vacanta.functions.signals import is_training
from vacanta.operators.filters import is_excerpt
from vacanta.operators.gates import add_counts, gate, gate_counts, reuse_verdicts
from vacanta.operators.relevance import role_phrases, title_relevance
from vacanta.operators.verdicts import check_verdicts, parse_verdicts, score_row
from vacanta.rules import relevance as RR
from vacanta.rules import views as V
from vacanta.session import settle, skew_join


# What a completed posting brings anew for the second gate.
COMPLETED = ["text", "experience_min_years", "experience_level", "contract", "archived_at"]


def _row(df: DataFrame, reason) -> DataFrame:
    return df.select("profile_id", "offer_id", "criteria_version", F.lit("ecartee").alias("level"), reason.alias("excluded_reason"), F.lit("prefilter").alias("scored_by"))


def _counted(rows: DataFrame, reason, sign: int = 1) -> DataFrame:
    return rows.groupBy("profile_id", reason.alias("reason")).agg((F.count("*") * sign).alias("n"))


def to_read(offers: DataFrame, profiles: DataFrame, favorites: DataFrame) -> DataFrame:
    """Gated pairs of offers that someone reads: close titles, and favourite companies whose text is known.

    Titles meet roles by equality on words, offers their titles and companies; nothing else is paired.
    """
    close = title_relevance(offers, role_phrases(profiles)).filter(F.col("relevance") >= RR.MIN_TITLE_RELEVANCE)
    by_title = skew_join(offers.select("offer_id", "title"), close, ["title"], "inner").select("offer_id", "profile_id", "relevance", F.lit(False).alias("favorite"))
    liked = favorites.select("profile_id", "company_id").distinct()
    by_company = skew_join(offers.filter("has_description").select("offer_id", "company_id"), liked, ["company_id"], "inner").select("offer_id", "profile_id", F.lit(0.0).alias("relevance"), F.lit(True).alias("favorite"))
    met = by_title.unionByName(by_company).groupBy("offer_id", "profile_id").agg(F.max("relevance").alias("relevance"), F.max("favorite").alias("favorite"))
    pairs = met.join(offers.drop("text"), "offer_id")
    people = profiles.withColumn("zone_keys", zone_keys(F.col("zone_places")))
    return gate(skew_join(pairs, people, ["profile_id"], "inner"))


def before_model(offers: DataFrame, profiles: DataFrame, favorites: DataFrame, scores: DataFrame, completed: DataFrame | None = None) -> dict[str, DataFrame]:
    """Outcome of every pair of offer and profile: `counts` of set-aside ones by reason, `excluded` rows of those that
    were read, `reused` verdicts and `candidates`.

    Counts, rows, reused, candidates, pairs scored before under the same version (`done`) and those whose offer is
    gone meanwhile (`gone`) add up to offers times profiles; only pairs that somebody reads are formed. `completed`
    (offer_id and any of COMPLETED) holds what was read since the first gate: the gates are applied again to it.
    """
    active = offers.filter(F.col("archived_at").isNull())
    described = active if "has_description" in active.columns else active.withColumn("has_description", F.length("text") > 200)
    light = described.drop("text")
    people = profiles.withColumn("zone_keys", zone_keys(F.col("zone_places")))
    done = scores.join(profiles.select("profile_id", "criteria_version"), ["profile_id", "criteria_version"], "left_semi").select("profile_id", "offer_id").distinct()
    known = settle(gate(skew_join(done.join(light, "offer_id"), people, ["profile_id"], "inner")).select("profile_id", "offer_id", F.col("gate.reason").alias("reason")))
    seen = settle(to_read(light, profiles, favorites))
    passed = seen.filter("gate.pass")
    # Pairs that pass, are not read and were not scored before: their titles match nothing.
    gates = gate_counts(light, profiles)
    scored = known.join(seen.select("profile_id", "offer_id", F.lit(True).alias("read")), ["profile_id", "offer_id"], "left")
    unread = add_counts(gates, _counted(scored.filter("reason IS NOT NULL OR read IS NULL"), F.col("reason"), -1), _counted(passed, F.lit(None).cast("string"), -1))
    counts = unread.withColumn("reason", F.coalesce("reason", F.lit(V.REASON_TITLE)))

    fresh = passed.join(known.select("profile_id", "offer_id"), ["profile_id", "offer_id"], "left_anti")
    read = fresh.withColumns({"title_match": F.col("relevance") >= RR.MIN_TITLE_RELEVANCE, "rel": F.greatest(F.col("relevance"), F.lit(RR.FAVORITE_RELEVANCE))})
    reused, left = reuse_verdicts(read, scores, ["profile_id", "offer_id", "judge_key"])
    # Full texts are fetched for what is left only.
    texts = left.join(active.select("offer_id", "text"), "offer_id")
    if completed is not None:
        brought = [c for c in COMPLETED if c in completed.columns]
        new = completed.select("offer_id", F.lit(True).alias("_known"), *[F.col(c).alias(f"_{c}") for c in brought])
        texts = texts.join(new, "offer_id", "left").withColumns({c: F.when(F.col("_known"), F.col(f"_{c}")).otherwise(F.col(c)) for c in brought}).drop("_known", *[f"_{c}" for c in brought])
    texts = settle(gate(texts.drop("gate", "zone_verdict")))
    gone = texts.filter(F.col("archived_at").isNotNull())
    there = texts.filter(F.col("archived_at").isNull())
    again = _row(there.filter(~F.col("gate.pass")), F.col("gate.reason"))
    held = there.filter("gate.pass")
    excerpt = is_excerpt(F.col("text"), F.col("engine_only"))
    thin = _row(held.filter(excerpt), F.lit(V.REASON_EXCERPT))
    whole = held.filter(~excerpt)
    courses = _row(whole.filter(is_training(F.col("title"))), F.lit(V.REASON_TRAINING))
    jobs = whole.filter(~is_training(F.col("title")))
    asked = required_languages(jobs.select("offer_id", F.concat_ws("\n", "title", "text").alias("text")).dropDuplicates(["offer_id"]), "offer_id")
    spoken = jobs.select("offer_id", "profile_id", spoken_languages(F.col("languages")).alias("spoken"))
    lacking = settle(missing_language(spoken, asked, "offer_id", "profile_id", "spoken"))
    why = F.concat(F.lit("L'offre demande de parler "), F.col("language"), F.lit(" : « "), F.col("quote"), F.lit(" ». Si tu le parles, ajoute-le à ta recherche."))
    unspoken = _row(jobs.join(lacking, ["offer_id", "profile_id"]), why)
    ready = jobs.join(lacking.select("offer_id", "profile_id"), ["offer_id", "profile_id"], "left_anti")
    return {
        "counts": counts, "excluded": again.unionByName(thin).unionByName(courses).unionByName(unspoken), "reused": reused, "candidates": ready,
        "done": known.select("profile_id", "offer_id"), "gone": gone.select("profile_id", "offer_id"),
    }


def after_model(answers: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scores, refused): landed answers checked against the pairs they were asked for."""
    verdicts, refused = parse_verdicts(answers)
    return score_row(check_verdicts(verdicts.join(pairs, ["profile_id", "offer_id"]))), refused
