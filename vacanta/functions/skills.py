"""Skill names: language names, aliases, spellings and labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from vacanta.columns import first_rule, fixed_map, let, says, strings
from vacanta.functions.text import fold, skill_key, words_key
from vacanta.rules import skills as R


def _aliases(extra: dict[str, str] | None = None) -> Column:
    table = {**R.ALIASES, **(extra or {})}
    return fixed_map(table)


def skill_alias(key: Column) -> Column:
    return F.coalesce(F.try_element_at(_aliases(), key), key)


def skill_name(name: Column, kind: Column) -> Column:
    """A language is its name, whatever the level written."""
    return F.when(kind == "langue", F.coalesce(first_rule(words_key(name), R.LANGUAGES), name)).otherwise(name)


def canonical_skill(name: Column, kind: Column | None = None) -> Column:
    shown = skill_name(name, kind) if kind is not None else name
    return skill_alias(skill_key(shown))


def spellings(key: Column) -> Column:
    """The key and its other spellings searched in texts."""
    pairs = [*R.ALIASES.items(), *R.EXTRA_SPELLINGS.items()]
    others = F.filter(F.array(*[F.when(key == k, F.lit(a)) for a, k in pairs]), lambda x: x.isNotNull())
    return F.array_distinct(F.concat(F.array(key), others))


def is_countable_skill(key: Column) -> Column:
    """Whether a key may be counted alone: not too general, not a job title, long enough."""
    short = (F.length(key) <= 2) & ~key.isin(R.SHORT_SKILLS)
    return (key != "") & ~key.isin(R.TOO_GENERAL) & ~says(key, R.NOT_SKILLS) & ~short


def skill_label(name: Column) -> Column:
    rest = F.substring(name, F.lit(2), F.length(name))
    plain = name.rlike("^[a-zà-ÿ]") & ~rest.rlike("[A-Z]")
    return F.when(plain, F.concat(F.upper(F.substring(name, 1, 1)), rest)).otherwise(name)


def phrases(key_text: Column, max_words: int) -> Column:
    """Every different run of 1 to `max_words` words of a text already keyed by `skill_key`."""
    def runs(words: Column, n: int) -> Column:
        if n == 1:
            return words
        last = F.greatest(F.size(words) - (n - 1), F.lit(1))
        return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))).otherwise(strings([]))

    words = F.filter(F.split(key_text, " ", -1), lambda w: w != "")
    return let(words, lambda w: F.array_distinct(F.flatten(F.array(*[runs(w, n) for n in range(1, max_words + 1)]))))


__all__ = ["skill_alias", "skill_name", "canonical_skill", "spellings", "is_countable_skill", "skill_label", "phrases", "fold"]
