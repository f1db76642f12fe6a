"""SQL texts of the rules, written for DuckDB, used by the oracles."""

from __future__ import annotations

from vacanta.rules import text as T


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def one_of(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def re2(pattern: str) -> str:
    return pattern.replace("(?iu)", "(?i)")


def fold(x: str) -> str:
    return f"strip_accents(lower({x}))"


def slug(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({fold(x)}, {lit(T.GENDER_MARKERS)}, ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"


def words_key(x: str) -> str:
    return f"trim(regexp_replace({fold(x)}, '[^a-z0-9+#]+', ' ', 'g'))"


def skill_key(x: str) -> str:
    return f"regexp_replace({words_key(x)}, '([a-z0-9+#]{{3}})s( |$)', '\\1\\2', 'g')"


def company_key(x: str) -> str:
    bare = f"regexp_replace({slug(x)}, {lit(T.LEGAL_FORMS)}, '', 'g')"
    return f"trim(regexp_replace(regexp_replace({bare}, '([a-z])\\s+\\d$', '\\1'), '\\s+', ' ', 'g'))"


def matches(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {lit(re2(pattern))})"


def first_rule(x: str, rules, otherwise: str = "NULL") -> str:
    def shown(v):
        return lit(v) if isinstance(v, str) else str(v)

    return "CASE " + " ".join(f"WHEN {matches(x, p)} THEN {shown(v)}" for p, v in rules) + f" ELSE {otherwise} END"


def half_up(x: str) -> str:
    return f"CAST(floor({x} + 0.5) AS BIGINT)"


def percent(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN CAST(floor(100.0 * {part} / {whole} + 0.5) AS BIGINT) ELSE 0 END"


def html_to_text(x: str) -> str:
    out = x
    for _ in range(2):
        for pattern, char in T.NAMED_ENTITIES:
            out = f"regexp_replace({out}, {lit(pattern)}, {lit(char)}, 'g')"
    for pattern, replacement in T.TAG_STEPS:
        out = f"regexp_replace({out}, {lit(pattern.replace(chr(92) + 'u00a0', chr(0xA0)))}, {lit(replacement)}, 'g')"
    strip = r"regexp_replace(l, '^[\s\x{00a0}]+|[\s\x{00a0}]+$', '', 'g')"
    return f"array_to_string(list_filter(list_transform(string_split({out}, chr(10)), lambda l: {strip}), lambda l: l <> '' AND l <> '•'), chr(10))"
