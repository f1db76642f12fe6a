"""Languages a posting requires, each with the sentence that says it, and those a person lacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vacanta.columns import says, strip, strings
from vacanta.functions.text import fold
from vacanta.rules import languages as R


def _required(name: str) -> str:
    n = f"(?:{name})"
    return "|".join([
        rf"\b(?:{R.LEVEL})\b[^.]{{0,30}}\b{n}\b",
        rf"\b{n}\b[^.]{{0,25}}\b(?:{R.LEVEL}|{R.MUST})\b",
        rf"\b{n}[- ]speak(?:ing|er)\b",
        rf"\bspeak\b[^.]{{0,15}}\b{n}\b",
        rf"\bparler\b[^.]{{0,15}}\b{n}\b",
    ])


_NAMES = "|".join(n for _, n in R.NAMES)
ANY_NAME = rf"\b(?:{_NAMES})\b"


def _present(values: list[Column]) -> Column:
    return F.filter(F.array(*values), lambda v: v.isNotNull())


def named_languages(folded: Column) -> Column:
    return _present([F.when(says(folded, rf"\b(?:{names})\b"), F.lit(language)) for language, names in R.NAMES])


def spoken_languages(said: Column) -> Column:
    """Languages named by what a person lists in their search or CV (array of texts)."""
    return named_languages(fold(F.array_join(said, " ")))


def required_languages(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One row per posting and required language: key, language, quote, alternatives, rank.

    Only sentences that name a listed language and wish for nothing leave the row, so little is regrouped.
    """
    sentences = texts.select(key, F.posexplode(F.split(F.col(text), R.SENTENCE_END, -1)).alias("at", "raw"))
    # Plain letters fold to their lower case: most sentences are told apart before they are folded.
    sentences = sentences.filter((F.octet_length("raw") != F.length("raw")) | F.lower("raw").rlike(f"(?<![a-z0-9_])(?:{_NAMES})"))
    spoken = (
        sentences.withColumn("sentence", strip(F.col("raw")))
        .filter(F.col("sentence") != "")
        .withColumn("s", fold(F.col("sentence")))
        .filter(says(F.col("s"), ANY_NAME))
        .filter(~says(F.col("s"), R.WISH))
    )
    demands = _present([
        F.when(says(F.col("s"), _required(names)), F.struct(F.lit(i).alias("order"), F.lit(language).alias("language")))
        for i, (language, names) in enumerate(R.NAMES)
    ])
    read = spoken.select(key, "at", "sentence", "s", named_languages(F.col("s")).alias("named"), F.explode(demands).alias("d"))
    foreign = says(F.col("s"), R.FRENCH_OR_ENGLISH)
    choice = says(F.col("s"), R.CHOICE) & ((F.size("named") > 1) | foreign)
    rows = read.filter(~(choice & foreign)).select(
        key,
        F.col("d.language").alias("language"),
        F.struct(
            F.col("at"),
            F.col("d.order").alias("order"),
            F.substring("sentence", 1, R.QUOTE_LENGTH).alias("quote"),
            F.when(choice, F.col("named")).otherwise(F.array(F.col("d.language"))).alias("alternatives"),
        ).alias("proof"),
    )
    first = rows.groupBy(key, "language").agg(F.min("proof").alias("proof"))
    return first.select(key, "language", F.col("proof.quote").alias("quote"), F.col("proof.alternatives").alias("alternatives"), F.struct("proof.at", "proof.order").alias("rank"))


def missing_language(pairs: DataFrame, required: DataFrame, key: str, person: str, spoken: str) -> DataFrame:
    """First required language a person does not speak, per (posting, person) pair; pairs without one are absent."""
    lacking = pairs.join(required, key).filter(~F.arrays_overlap(F.coalesce(F.col(spoken), strings([])), F.col("alternatives")))
    first = lacking.groupBy(key, person).agg(F.min(F.struct("rank", "language", "quote")).alias("m"))
    return first.select(key, person, F.col("m.language").alias("language"), F.col("m.quote").alias("quote"))
