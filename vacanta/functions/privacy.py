"""Personal data taken out of texts, contacts found in them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from vacanta.columns import pieces, swap
from vacanta.rules import privacy as R


# The first line that is not blank, when it looks like a name.
NAME_ON_TOP = r"\A((?:[^\S\n]*\n)*)" + R.NAME_LINE.replace("^", "", 1).replace(r"\s", r"[^\S\n]").removesuffix("$") + r"(?=\n|\z)"


def _phones_out(c: Column) -> Column:
    digits = lambda x: F.length(F.regexp_replace(x, "[^0-9]", ""))
    return F.array_join(
        F.transform(pieces(c, R.PHONE), lambda x, i: F.when((i % 2 == 1) & (digits(x) >= R.PHONE_DIGITS), F.lit(R.PLACEHOLDERS["phone"])).otherwise(x)),
        "",
    )


def redact(text: Column, names: Column | None = None) -> Column:
    """E-mail, links, addresses, phones, known names and an opening name line replaced by placeholders."""
    P = R.PLACEHOLDERS
    out = swap(text, R.EMAIL, P["email"])
    out = swap(out, R.LINK, P["link"])
    out = swap(out, R.STREET, P["address"])
    out = swap(out, R.POSTCODE_TOWN, P["address"])
    out = _phones_out(out)
    if names is not None:
        words = F.filter(F.flatten(F.transform(names, lambda n: F.split(n, r"\s+", -1))), lambda w: F.length(w) >= 2)
        quoted = F.transform(words, lambda w: F.regexp_replace(w, r"([.*+?^$\{\}()|\[\]\\])", r"\\$1"))
        pattern = F.concat(F.lit("(?i)(?<![A-Za-z0-9_])(?:"), F.array_join(quoted, "|"), F.lit(")(?![A-Za-z0-9_])"))
        out = F.when(F.size(words) > 0, F.regexp_replace(out, pattern, F.lit(P["name"]))).otherwise(out)
    return F.regexp_replace(out, NAME_ON_TOP, f"$1{P['name']}")


def has_email(text: Column) -> Column:
    return text.rlike(R.EMAIL)


def has_phone(text: Column) -> Column:
    return F.exists(F.regexp_extract_all(text, F.lit(R.PHONE), F.lit(0)), lambda m: F.length(F.regexp_replace(m, "[^0-9]", "")) >= R.PHONE_DIGITS)


def contacts(text: Column) -> Column:
    return F.struct(has_email(text).alias("email"), has_phone(text).alias("phone"))
