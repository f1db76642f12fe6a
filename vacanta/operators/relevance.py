"""Title relevance for many titles and many role phrases at once, by equality on their words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vacanta.functions import relevance as V
from vacanta.rules import relevance as R
from vacanta.session import BROADCAST_ROWS, broadcast_if_small


def role_phrases(profiles: DataFrame, roles: str = "target_roles", variants: str = "title_variants", bridges: str | None = "bridge_roles", id: str = "profile_id") -> DataFrame:
    """One row per profile and phrase: weight, core, words, key words."""
    def rows(names: Column, kind: str, weight: float) -> Column:
        return F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda n: F.struct(n.alias("phrase"), F.lit(kind).alias("kind"), F.lit(weight).alias("weight")))

    parts = [rows(F.col(roles), "role", R.ROLE_WEIGHTS[0]), rows(F.col(variants), "role", R.ROLE_WEIGHTS[0])]
    if bridges:
        parts.append(rows(F.col(bridges), "bridge", R.BRIDGE_WEIGHTS[0]))
    flat = profiles.select(id, F.explode(F.array_distinct(F.concat(*parts))).alias("p")).select(id, "p.*")
    return with_words(flat)


def with_words(phrases: DataFrame) -> DataFrame:
    cored = phrases.withColumn("core", V.core(F.col("phrase"))).withColumn("words", V.tokens(F.col("core")))
    return cored.withColumn("key_words", V.distinctive(F.col("words"))).filter(F.size("words") > 0)


def title_matrix(titles: DataFrame, phrases: DataFrame, title: str = "title", max_rows: int = BROADCAST_ROWS, salts: int = 16) -> DataFrame:
    """(title, phrase) pairs that share a distinctive word, scored. Each title is read once.

    The pair is formed at the first word both share, so it needs no later distinct. Phrases of proven
    size are broadcast; beyond it, both sides meet on salted words, because some words are in most titles.
    """
    read = titles.select(title).distinct().withColumn("title_words", V.tokens(F.col(title)))
    words = read.withColumn("word", F.explode(F.array_distinct("title_words")))
    keyed = phrases.withColumn("word", F.explode(F.array_distinct("key_words")))
    side, small = broadcast_if_small(keyed, max_rows)
    if small:
        met = words.join(side, "word")
    else:
        spread = words.withColumn("_salt", F.pmod(F.xxhash64(title), F.lit(salts)).cast("int"))
        met = spread.join(side.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["word", "_salt"]).drop("_salt")
    first = F.get(F.filter("key_words", lambda w: F.array_contains(F.col("title_words"), w)), F.lit(0))
    scored = met.filter(F.col("word") == first).withColumn("score", V.phrase_score(F.col("words"), F.col("key_words"), F.col("title_words")))
    return scored.filter("score > 0").drop("word")


def title_relevance(titles: DataFrame, phrases: DataFrame, title: str = "title", id: str = "profile_id") -> DataFrame:
    """Best score per title and profile: title, profile, relevance. Titles that match nothing are absent (0)."""
    return title_matrix(titles, phrases, title).groupBy(title, id).agg(F.max(F.col("score") * F.col("weight")).alias("relevance"))


def wanted_titles(titles: DataFrame, phrases: DataFrame, title: str = "title", least: float = R.WANTED_RELEVANCE) -> DataFrame:
    """Titles close to a role someone looks for."""
    near = title_matrix(titles, phrases, title).filter(F.col("score") * F.col("weight") >= least).select(title).distinct()
    return titles.join(near, title, "left_semi")


def by_relevance(candidates: DataFrame, id: str = "offer_id") -> DataFrame:
    return candidates.orderBy(F.desc("rel"), id)


def full_relevance(offers: DataFrame, phrases: DataFrame, title: str = "title", text: str = "text", id: str = "offer_id", person: str = "profile_id") -> DataFrame:
    """Title and text relevance: per kind, the best of title weight and text weight, summed over kinds.

    `phrases` holds person, phrase, kind (role, bridge, sector). A phrase of the text is found by
    equality of word runs, a phrase of the title by its words.
    """
    from vacanta.functions.skills import phrases as runs
    from vacanta.operators.skills import longest_phrase

    weights = {"role": R.ROLE_WEIGHTS, "bridge": R.BRIDGE_WEIGHTS, "sector": R.SECTOR_WEIGHTS}
    worded = phrases.withColumn("words", V.tokens(F.col("phrase"))).filter(F.size("words") > 0)
    worded = worded.withColumn("key_words", V.distinctive(F.col("words"))).withColumn("form", F.array_join("words", " "))
    in_title = title_matrix(offers, worded.withColumn("core", F.col("phrase")), title).select(title, person, "phrase", "kind", "score")
    titles = offers.select(id, title).join(in_title, title).select(id, person, "phrase", "kind", F.col("score").alias("t"), F.lit(0.0).alias("b"))
    whole = F.array_join(V.tokens(F.concat_ws(" ", title, text)), " ")
    grams = offers.select(id, F.explode(runs(whole, longest_phrase(worded))).alias("form"))
    side, _ = broadcast_if_small(worded.select(person, "phrase", "kind", "form"))
    bodies = grams.join(side, "form").select(id, person, "phrase", "kind", F.lit(0.0).alias("t"), F.lit(1.0).alias("b"))
    both = titles.union(bodies).groupBy(id, person, "phrase", "kind").agg(F.max("t").alias("t"), F.max("b").alias("b"))
    weight = F.lit(0.0)
    for kind, (tw, bw) in weights.items():
        weight = F.when(F.col("kind") == kind, F.col("t") * tw + F.col("b") * bw).otherwise(weight)
    best = both.groupBy(id, person, "kind").agg(F.max(weight).alias("best"))
    return best.groupBy(id, person).agg(F.sum("best").alias("relevance"))


def title_counts(base: DataFrame, roles: DataFrame, id: str = "offer_id", title: str = "title", k: int = 5, by: str | None = None) -> DataFrame:
    """How many titles write each role title as it is, most frequent first. `roles` holds title (and `by`)."""
    from vacanta.operators.skills import citing

    keep = [by] if by else []
    forms = roles.filter(F.length(F.trim("role")) > 4).select("role", F.trim(V.shown_words(F.col("role"))).alias("form")).distinct()
    found = citing(base.select(*keep, id, F.trim(V.shown_words(F.col(title))).alias("_w")), forms.withColumnRenamed("role", "key"), [*keep, id], "_w", keyed=True)
    if by:
        found = found.join(roles.select(by, F.col("role").alias("key")).distinct(), [by, "key"])
    counted = found.groupBy(*keep, F.col("key").alias("role")).agg(F.count("*").alias("count"))
    from pyspark.sql import Window

    order = Window.partitionBy(*(keep or [F.lit(0)])).orderBy(F.desc("count"), "role")
    return counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
