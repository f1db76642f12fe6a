"""Small column helpers shared by every rule: patterns, white space, first match, marker split."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# White space as web pages mean it (no-break and thin spaces included).
SPACE = " \t\n\r\x0b\x0c\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_WORD_LIMIT = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
MARK = "\u0001"


def rx(pattern: str) -> str:
    r"""The pattern with `\b` read on ASCII letters only, whatever the Java version."""
    return pattern.replace(r"\b", _WORD_LIMIT)


def says(c: Column, pattern: str) -> Column:
    return c.rlike(rx(pattern))


def hears(c: Column, pattern: str) -> Column:
    r"""`says` for text made by `rule_text`, where Java's own (faster) `\b` reads the same limits."""
    return c.rlike(pattern)


def swap(c: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(c, rx(pattern), replacement)


def group(c: Column, pattern: str, index: int = 1) -> Column:
    """One capture of the first match, null when there is none or it is empty."""
    return F.nullif(F.regexp_extract(c, rx(pattern), index), F.lit(""))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds costly columns that are computed once per row.

    A filter on a plain column is pushed below it and computes it again; a generated row stops that.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.explode_outer(F.array(row)).alias("_once")).select(*kept, *[F.col(f"_once.{n}").alias(n) for n in columns])


def let(value: Column, use) -> Column:
    """`use(value)` with the value computed once per row, even when lambdas read it for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(SPACE))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def first_rule(c: Column, rules: list[tuple[str, object]], otherwise: Column | None = None, test=None) -> Column:
    """Value of the first pattern of an ordered list that `c` matches."""
    out = None
    for pattern, value in rules:
        hit = (test or says)(c, pattern)
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return out if otherwise is None else out.otherwise(otherwise)


def strings(values) -> Column:
    values = list(values)
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(False)


def pieces(c: Column, pattern: str) -> Column:
    """Text cut at every match: pieces 1, 3, 5… are the text between, 2, 4, 6… the matches themselves."""
    marked = F.regexp_replace(F.translate(c, MARK, " "), rx(pattern), f"{MARK}$0{MARK}")
    return F.split(marked, MARK, -1)


def contexts(parts: Column, before: int, after: int, shortest: int = 3) -> Column:
    """For each match of `pieces`: `m` the match, `before` and `after` the characters around it.

    Matches hold at least `shortest` characters, so only the neighbouring pieces that can reach into the
    window are read and the cost stays linear in the text.
    """
    back = 2 * (before // shortest) + 3
    ahead = 2 * (after // shortest) + 3

    def at(p: Column, k: Column) -> Column:
        left = F.greatest(F.lit(1), 2 * k - back)
        return F.struct(
            F.get(p, 2 * k - 1).alias("m"),
            F.array_join(F.slice(p, left, 2 * k - left), "").alias("before"),
            F.array_join(F.slice(p, 2 * k + 1, F.lit(ahead)), "").alias("after"),
        )

    def cut(x: Column) -> Column:
        return F.struct(
            x["m"].alias("m"),
            F.substring(x["before"], F.greatest(F.lit(1), F.length(x["before"]) - before + 1), F.lit(before)).alias("before"),
            F.substring(x["after"], F.lit(1), F.lit(after)).alias("after"),
        )

    def matches(p: Column) -> Column:
        count = ((F.size(p) - 1) / 2).cast("int")
        none = F.array().cast("array<struct<m:string,before:string,after:string>>")
        return F.when(count > 0, F.transform(F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda k: at(p, k)), cut)).otherwise(none)

    return let(parts, matches)


def tail(c: Column, n: int) -> Column:
    return F.substring(c, F.greatest(F.lit(1), F.length(c) - n + 1), F.lit(n))


def fixed_map(values: dict, value_type: str = "string") -> Column:
    """A fixed table as a map: one literal for the planner, folded before the query runs."""
    return F.from_json(F.lit(json.dumps(values, ensure_ascii=False)), f"map<string,{value_type}>")


def half_up(c: Column) -> Column:
    """Rounding that sends halves upward, negative values included."""
    return F.floor(c + F.lit(0.5))
