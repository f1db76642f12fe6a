"""Text keys: fold, slug, company key, dedup key, skill key, HTML to text."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, SparkSession, functions as F

from vacanta.columns import blank_to_null, let, pieces, strip, swap
from vacanta.rules import text as R


def _accents() -> tuple[str, str]:
    """Lower-case letters whose decomposition is one plain letter and combining marks."""
    source, target = [], []
    for code in [*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)]:
        char = chr(code)
        parts = unicodedata.normalize("NFD", char)
        plain = "".join(p for p in parts if not 0x300 <= ord(p) <= 0x36F)
        if char == char.lower() and plain != char and len(plain) == 1:
            source.append(char)
            target.append(plain)
    return "".join(source), "".join(target)


ACCENTED, PLAIN = _accents()


def fold(c: Column) -> Column:
    """Lower case, accents removed."""
    return F.regexp_replace(F.translate(F.lower(c), ACCENTED, PLAIN), "[\u0300-\u036f]", "")


def rule_text(c: Column) -> Column:
    """Folded text for the word rules: letters outside ASCII that are left (œ, ß…) never belong to a word."""
    return F.regexp_replace(fold(c), r"[\p{L}\p{N}&&[^\x00-\x7F]]", "¤")


def unaccent(c: Column) -> Column:
    """Accents removed, case kept."""
    upper = "".join(ch.upper() if len(ch.upper()) == 1 else ch for ch in ACCENTED)
    plain_upper = "".join(ch.upper() for ch in PLAIN)
    return F.regexp_replace(F.translate(F.translate(c, ACCENTED, PLAIN), upper, plain_upper), "[\u0300-\u036f]", "")


def slug(c: Column) -> Column:
    """Letters and digits only, without the (H/F) markers of titles."""
    # Every marker holds a slash: texts without one skip the pattern.
    bare = let(fold(c), lambda f: F.when(F.contains(f, F.lit("/")), swap(f, R.GENDER_MARKERS, " ")).otherwise(f))
    return F.trim(F.regexp_replace(bare, "[^a-z0-9]+", " "))


def company_key(c: Column) -> Column:
    bare = F.regexp_replace(slug(c), R.LEGAL_FORMS, "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"([a-z])\s+\d$", "$1"), r"\s+", " "))


def dedup_key(company: Column, title: Column, first_city: Column, raw_place: Column | None = None) -> Column:
    place = F.coalesce(first_city, raw_place, F.lit("na")) if raw_place is not None else F.coalesce(first_city, F.lit("na"))
    return F.concat_ws("|", company_key(company), slug(title), slug(place))


def words_key(c: Column) -> Column:
    """Folded words separated by one space, `+` and `#` kept (C++, C#)."""
    return F.trim(F.regexp_replace(fold(c), "[^a-z0-9+#]+", " "))


def skill_key(c: Column) -> Column:
    """Words of a skill, the final s of words over three letters dropped."""
    return F.regexp_replace(words_key(c), "([a-z0-9+#]{3})s( |$)", "$1$2")


def padded(c: Column) -> Column:
    return F.concat(F.lit(" "), c, F.lit(" "))


def skill_text(c: Column) -> Column:
    return padded(skill_key(c))


def _code_point(hex_digits: Column) -> Column:
    return F.decode(F.unhex(F.lpad(hex_digits, 8, "0")), "UTF-32")


def decode_numeric_entities(c: Column) -> Column:
    parts = pieces(c, R.NUMERIC_ENTITY)

    def decoded(x: Column, i: Column) -> Column:
        is_hex = x.rlike("^&#[xX]")
        digits = F.regexp_extract(x, "([0-9a-fA-F]+);", 1)
        return F.when(i % 2 == 0, x).when(is_hex, _code_point(digits)).otherwise(_code_point(F.hex(digits.try_cast("bigint"))))

    return F.when(F.contains(c, F.lit("&#")), F.array_join(F.transform(parts, decoded), "")).otherwise(c)


def decode_entities(c: Column) -> Column:
    out = decode_numeric_entities(c)
    for pattern, char in R.NAMED_ENTITIES:
        out = F.regexp_replace(out, pattern, char)
    return out


def tidy_lines(c: Column) -> Column:
    lines = F.transform(F.split(c, "\n", -1), strip)
    return F.array_join(F.filter(lines, lambda x: (x != "") & (x != "•")), "\n")


def html_to_text(c: Column) -> Column:
    """Readable text: bullets for list items, one line per block, inline tags removed without a space."""
    out = decode_entities(decode_entities(c))
    for pattern, replacement in R.TAG_STEPS:
        out = F.regexp_replace(out, pattern, replacement)
    return tidy_lines(out)


def squash(c: Column) -> Column:
    """Folded text on one line, typographic apostrophes straightened: quotes are searched in it."""
    return strip(F.regexp_replace(F.translate(fold(c), "’", "'"), r"[\s\u00a0\u202f]+", " "))


def clean_domain(c: Column) -> Column:
    out = F.regexp_replace(F.lower(strip(c)), "^https?://", "")
    return F.regexp_replace(F.regexp_replace(out, r"^www\.", ""), "/.*$", "")


def slug_guesses(c: Column) -> Column:
    """Board names a company would use: words glued together, words joined by dashes."""
    key = slug(company_key(c))
    glued = F.replace(key, F.lit(" "), F.lit(""))
    return F.when(F.length(glued) >= 2, F.array_distinct(F.array(glued, F.replace(key, F.lit(" "), F.lit("-"))))).otherwise(
        F.array().cast("array<string>")
    )


def url_ids(c: Column) -> Column:
    """Posting ids of an address: UUIDs, or numbers of five digits and more."""
    return F.regexp_extract_all(c, F.lit(R.URL_IDS), F.lit(0))


def prettify(c: Column) -> Column:
    """Company name read from a board name: dashes to spaces, capitals at word starts."""
    return F.initcap(F.regexp_replace(c, "[-_]+", " "))


def first_line(c: Column) -> Column:
    return F.substring_index(c, "\n", 1)


def register_sql_functions(spark: SparkSession) -> None:
    """Make the keys usable from SQL as temporary functions: fold, slug, skill_key, company_key."""
    accents = f"translate(lower(t), '{ACCENTED}', '{PLAIN}')"
    gender = R.GENDER_MARKERS.replace("\\", "\\\\")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION fold(t STRING) RETURNS STRING RETURN regexp_replace({accents}, '[\\u0300-\\u036f]', '')")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION slug(t STRING) RETURNS STRING RETURN "
        f"trim(regexp_replace(regexp_replace(fold(t), '{gender}', ' '), '[^a-z0-9]+', ' '))"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION skill_key(t STRING) RETURNS STRING RETURN "
        "regexp_replace(trim(regexp_replace(fold(t), '[^a-z0-9+#]+', ' ')), '([a-z0-9+#]{3})s( |$)', '$1$2')"
    )
    forms = R.LEGAL_FORMS.replace("\\", "\\\\")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION company_key(t STRING) RETURNS STRING RETURN "
        f"trim(regexp_replace(regexp_replace(regexp_replace(slug(t), '{forms}', ''), '([a-z])\\\\s+\\\\d$', '$1'), '\\\\s+', ' '))"
    )


def place_or_null(c: Column) -> Column:
    return blank_to_null(strip(c))
