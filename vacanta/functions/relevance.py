"""Title relevance: tokens, phrase scores, role names, invented words."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from vacanta.columns import strings, swap
from vacanta.functions.text import fold, padded
from vacanta.rules import relevance as R


def tokens(c: Column) -> Column:
    """Words of a title: set phrases as one word, abbreviations beside their long form, stop words out."""
    text = fold(c)
    for pattern, one in R.SET_PHRASES:
        text = swap(text, pattern, one)
    for pattern, add in R.SYNONYMS:
        text = swap(text, pattern, f"$0 {add}")
    return F.filter(F.split(text, "[^a-z0-9+#]+", -1), lambda t: (F.length(t) >= 2) & ~t.isin(R.STOP))


def core(phrase: Column) -> Column:
    """A role phrase without its qualifiers ("QA avec évolution vers…" is searched as "QA")."""
    return F.regexp_replace(F.get(F.split(phrase, R.QUALIFIER, 2), F.lit(0)), r"\s*\(.*$", "")


def distinctive(words: Column) -> Column:
    own = F.filter(words, lambda t: ~t.isin(R.GENERIC))
    return F.when(F.size(own) > 0, own).otherwise(words)


def phrase_score(words: Column, key_words: Column, title: Column) -> Column:
    """Share of the distinctive words of a phrase in a title, as 1, 0.75, 0.5 or 0."""
    share = F.size(F.filter(key_words, lambda t: F.array_contains(title, t))) / F.size(key_words)
    generic_missing = F.exists(words, lambda t: t.isin(R.GENERIC) & ~F.array_contains(title, t))
    return (
        F.when(F.size(words) == 0, 0.0)
        .when(share >= 0.99, F.when(generic_missing, 0.75).otherwise(1.0))
        .when(share >= 0.5, 0.5)
        .otherwise(0.0)
    )


def body_score(words: Column, text_words: Column) -> Column:
    """Whether a text holds the phrase, its words side by side."""
    return F.when((F.size(words) > 0) & F.contains(F.array_join(text_words, " "), F.array_join(words, " ")), 1.0).otherwise(0.0)


def names_target_role(title_words: Column, role_words: Column) -> Column:
    """The title names the role word for word (two words or more)."""
    return (F.size(role_words) >= 2) & F.contains(padded(F.array_join(title_words, " ")), padded(F.array_join(role_words, " ")))


def plain_words(c: Column) -> Column:
    return F.filter(F.split(fold(c), "[^a-z0-9+#]+", -1), lambda t: (F.length(t) >= 4) & ~t.isin(R.STOP))


def invented_words(why: Column, title: Column, text: Column, role_core: Column) -> Column:
    """Words of a role a reason uses while the offer never writes them."""
    words = plain_words(role_core)
    own = F.filter(words, lambda t: ~t.isin(R.GENERIC))
    in_title = plain_words(title)
    offer = plain_words(F.concat_ws(" ", title, text))
    named = (F.size(words) >= 2) & F.contains(padded(F.array_join(plain_words(why), " ")), padded(F.array_join(words, " ")))
    part = F.exists(own, lambda t: F.array_contains(in_title, t))
    return F.when(named & part, F.array_distinct(F.array_except(own, offer))).otherwise(strings([]))


def title_parts(title: Column) -> Column:
    return F.transform(F.split(title, R.TITLE_PARTS, -1), tokens)


def names_role(title: Column, title_words: Column, parts: Column, text_words: Column, role_core: Column, role_words: Column) -> Column:
    """The role is named in full by the title, or in part with the rest written in the text.

    A part counts only when that part of the title says nothing else. Abbreviations count in capitals.
    """
    short = F.trim(role_core)
    spelled = F.array_contains(title_words, F.lower(short)) & ~F.rlike(title, F.concat(F.lit("(?i)(?<![A-Za-z0-9_])"), short, F.lit("(?![A-Za-z0-9_])")))
    timeless = swap(title, R.CLOCK_TIME, " ")
    capitals = F.rlike(timeless, F.concat(F.lit("(?<![A-Za-z0-9_])"), F.upper(short), F.lit("(?![A-Za-z0-9_])")))
    own = F.filter(role_words, lambda t: ~t.isin(R.GENERIC))
    words = F.when(F.size(own) > 0, own).otherwise(role_words)
    share = F.size(F.filter(words, lambda t: F.array_contains(title_words, t))) / F.size(words)
    full = (share >= 0.99) & ((F.size(words) >= 2) | F.forall(role_words, lambda t: F.array_contains(title_words, t)))
    neutral = R.GENERIC + R.NEUTRAL
    alone = F.exists(
        parts,
        lambda part: F.exists(part, lambda t: F.array_contains(role_words, t))
        & F.forall(part, lambda t: F.array_contains(role_words, t) | t.isin(neutral) | t.rlike(r"^\d+$")),
    )
    partly = (share >= 0.5) & (share < 0.99) & (F.size(F.array_except(words, text_words)) == 0) & alone
    return F.when(short.rlike("^[A-Z]{2,4}$"), spelled | capitals).when(F.size(words) == 0, F.lit(False)).otherwise(full | partly)


def shown_words(c: Column) -> Column:
    """Title between spaces, for whole-word containment of a role title."""
    return padded(F.trim(F.regexp_replace(fold(c), "[^a-z0-9+#]+", " ")))

