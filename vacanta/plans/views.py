"""Feed, tracking board and CV analysis for all people at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vacanta.functions.cv import score_cvs
from vacanta.functions.privacy import redact
from vacanta.operators import dedup as D
from vacanta.operators import feed as FD
from vacanta.operators import filters as X
from vacanta.operators import market as M
from vacanta.operators import skills as SK


def feed(scores: DataFrame, offers: DataFrame, companies: DataFrame, actions: DataFrame, profiles: DataFrame, now: Column) -> DataFrame:
    """Selection of each person in its order: current version, copies of engines out, flags set, place given."""
    current = FD.current_scores(scores, profiles).filter(F.col("level") != "ecartee")
    rows = FD.feed_rows(current, offers.filter(F.col("archived_at").isNull()), companies)
    # Copies depend on the offers only, so they are found once for everyone.
    own = D.without_engine_copies(rows.select("offer_id", "title", "company_id", "company_name", "engine_only").distinct())
    mine = FD.with_actions(rows.join(own.select("offer_id"), "offer_id", "left_semi"), actions, ["user_id", "offer_id"]).filter(~F.col("dismissed"))
    open_ = profiles.select(F.col("profile_id").alias("user_id"), "openness")
    ranked = mine.join(open_, "user_id").withColumns({
        "rank_score": FD.rank_score(F.col("score_interet"), F.col("score_chances"), F.col("score_tremplin"), F.col("openness")),
        "is_stale": X.is_stale(F.col("posted_at"), F.col("engine_only"), now), "is_new": X.is_new(F.col("posted_at"), now),
        "is_exceptional": X.is_exceptional(F.col("level"), F.col("score_interet"), F.col("score_chances")),
    })
    shown = ranked.filter(~F.col("out_of_zone") | F.col("is_exceptional"))
    return FD.feed_order(shown, ["user_id", "out_of_zone"])


def tracking(applications: DataFrame, offers: DataFrame, companies: DataFrame, now: str) -> dict[str, DataFrame]:
    at = F.lit(now).cast(applications.schema["applied_at"].dataType)
    board = FD.board(applications, offers, companies).withColumns({
        "follow_up_due": X.follow_up_due(F.col("stage"), F.col("applied_at"), F.col("followed_up_at"), at), "upcoming": X.upcoming(F.col("interview_at"), at),
    })
    todo = board.groupBy("user_id").agg(F.count_if(F.col("follow_up_due") | F.col("upcoming")).alias("todo"))
    return {"board": board, "todo": todo, "progress": M.progress_counts(applications, ["user_id"]), "weeks": M.progress_weeks(applications, now)}


def analyse_cvs(cvs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """CVs redacted, scored and matched with the vocabulary; the text itself is not kept."""
    scored = score_cvs(cvs).withColumn("redacted", redact(F.col("text"), F.col("known_names")))
    return scored.drop("text").join(SK.cv_skills(cvs.select("cv_id", "text"), vocabulary), "cv_id", "left")
