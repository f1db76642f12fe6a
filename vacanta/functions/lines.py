"""Line rules of a posting: required or bonus, display blocks, introduction, structure, focused excerpt.

A text is cut into sections or lines inside its own row, so no shuffle is needed and the cost stays
linear in the text.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from vacanta.columns import blank_to_null, let, says, strip
from vacanta.functions.text import fold, unaccent
from vacanta.rules import lines as R

_SECTION = "\u0002"
_ITEM = "\u0003"


def trimmed_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n", -1), strip), lambda x: x != "")


def is_heading(line: Column, folded: Column, section_words: str = R.SECTION_WORDS, words: int = R.HEADING_WORDS) -> Column:
    short = F.size(F.split(line, r"\s+", -1)) <= words
    return short & ~line.rlike(r"^[•\-*·]") & (line.rlike(R.HEADING_COLON) | (~line.rlike("[.!,;]$") & says(folded, section_words)))


def split_requirements(text: Column, bonus: str = R.BONUS, section_words: str = R.SECTION_WORDS, plus: str = r"\bplus\b") -> Column:
    """struct(required, bonus): a bonus heading makes its whole section a wish, a bonus line itself."""
    shaped = F.transform(trimmed_lines(text), lambda l: F.struct(l.alias("line"), fold(l).alias("n")))
    marked = F.transform(
        shaped,
        lambda x: F.concat(F.when(is_heading(x["line"], x["n"], section_words), F.lit(_SECTION)).otherwise(F.lit("")), x["line"]),
    )
    # The text before the first heading is a section without one.
    sections = F.transform(
        F.split(F.concat(F.lit(""), F.array_join(marked, "\n")), _SECTION, -1),
        lambda s, i: F.struct(F.filter(F.split(s, "\n", -1), lambda l: l != "").alias("lines"), (i > 0).alias("headed")),
    )
    judged = F.transform(
        sections,
        lambda s: F.struct(
            s["lines"].alias("lines"),
            (s["headed"] & F.coalesce(says(fold(F.get(s["lines"], F.lit(0))), f"{bonus}|{plus}"), F.lit(False))).alias("wished"),
            s["headed"].alias("headed"),
        ),
    )
    flagged = F.flatten(
        F.transform(
            judged,
            lambda s: F.transform(
                s["lines"],
                lambda l, i: F.struct(l.alias("line"), (s["wished"] | (~(s["headed"] & (i == 0)) & says(fold(l), bonus))).alias("bonus")),
            ),
        )
    )

    def part(rows: Column, wished: bool) -> Column:
        kept = F.filter(rows, lambda x: x["bonus"] == F.lit(wished))
        return F.array_join(F.transform(kept, lambda x: x["line"]), "\n")

    # Lines are judged once for both parts.
    return let(flagged, lambda rows: F.struct(part(rows, False).alias("required"), part(rows, True).alias("bonus")))


def text_blocks(text: Column, bullet: str = "•", heading_length: int = 70) -> Column:
    """Blocks of a text: array of struct(kind, text, items). Bullets that follow each other form one list."""
    lines = trimmed_lines(text)

    def shaped(rows: Column) -> Column:
        return F.transform(
            rows,
            lambda l, i: F.struct(
                l.alias("line"),
                l.startswith(bullet).alias("item"),
                F.coalesce(F.get(rows, i - 1).startswith(bullet), F.lit(False)).alias("after_item"),
                F.coalesce(F.get(rows, i + 1), F.lit("")).alias("next"),
            ),
        )

    def marked(x: Column) -> Column:
        heading = (F.length(x["line"]) < heading_length) & ~x["line"].rlike("[.;,!?]$") & (x["line"].endswith(":") | x["next"].startswith(bullet))
        entry = F.regexp_replace(x["line"], rf"^{bullet}\s*", "")
        glue = F.when(x["after_item"], F.lit(_ITEM)).otherwise(F.lit(_SECTION + "list" + _ITEM))
        kind = F.when(heading, F.lit("heading")).otherwise(F.lit("paragraph"))
        return F.when(x["item"], F.concat(glue, entry)).otherwise(F.concat(F.lit(_SECTION), kind, F.lit(_ITEM), F.regexp_replace(x["line"], ":$", "")))

    joined = F.array_join(F.transform(let(lines, shaped), marked), "")
    blocks = F.filter(F.split(joined, _SECTION, -1), lambda b: b != "")
    cells = F.transform(blocks, lambda b: F.split(b, _ITEM, -1))
    none = F.lit(None)
    return F.transform(
        cells,
        lambda c: F.struct(
            F.get(c, F.lit(0)).alias("kind"),
            F.when(F.get(c, F.lit(0)) != "list", F.get(c, F.lit(1))).otherwise(none.cast("string")).alias("text"),
            F.when(F.get(c, F.lit(0)) == "list", F.slice(c, F.lit(2), F.size(c))).otherwise(none.cast("array<string>")).alias("items"),
        ),
    )


def _heading_pattern() -> str:
    import re

    names = "|".join(re.escape(s).replace("\\ ", " ").replace("\\-", "-").replace("\\'", "'") for s in sorted(R.SECTIONS, key=len, reverse=True))
    return rf"(?iu)(^|[.!?…»\"]\s+|\s{{2,}})({names})\s*(?::|-|–|\?)?\s+"


HEADING_PATTERN = _heading_pattern()


def _paragraphs(line: Column) -> Column:
    def grouped(sentences: Column) -> Column:
        last = F.greatest(F.ceil(F.size(sentences) / 3).cast("int") - 1, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda i: strip(F.array_join(F.slice(sentences, 3 * i + 1, F.lit(3)), "")))

    found = F.regexp_extract_all(line, F.lit(r"[^.!?]+[.!?]+(\s|$)|[^.!?]+$"), F.lit(0))
    return let(found, lambda s: F.when(F.size(s) == 0, F.array(line)).otherwise(grouped(s)))


def structure_text(text: Column) -> Column:
    """One-block texts given headings, bullets and paragraphs; texts with a structure are left alone."""
    lines = F.filter(F.split(text, "\n", -1), lambda l: strip(l) != "")
    structured = (F.size(lines) >= 4) & F.forall(lines, lambda l: F.length(l) < 700)

    def headed(l: Column) -> Column:
        marked = F.regexp_replace(l, HEADING_PATTERN, f"$1\n{_SECTION}$2 :\n")
        parts = F.split(marked, _SECTION, -1)
        capital = F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p)))))
        return F.array_join(capital, "")

    def bulleted(l: Column) -> Column:
        return F.when(F.regexp_count(l, F.lit(r"\s[-•·▪]\s")) >= 2, F.regexp_replace(l, r"\s[-•·▪]\s+", "\n• ")).otherwise(l)

    remade = F.transform(F.transform(lines, headed), bulleted)
    flat = F.transform(F.split(F.array_join(remade, "\n"), "\n", -1), strip)
    cut = F.flatten(F.transform(flat, lambda l: F.when((F.length(l) < 500) | l.startswith("•"), F.array(l)).otherwise(_paragraphs(l))))
    return F.when(structured, text).otherwise(F.array_join(F.filter(cut, lambda l: l != ""), "\n"))


def intro_from(structured: Column, introduction: str = R.INTRODUCTION, limit: int = 420, shortest: int = 60) -> Column:
    """The company's own introduction in a text that is structured already."""
    lines = trimmed_lines(structured)

    def opens(l: Column) -> Column:
        bare = strip(F.regexp_replace(unaccent(l), r"\s*[:.?!]\s*$", ""))
        return (F.length(l) < 70) & bare.rlike(introduction)

    flags = F.transform(lines, opens)
    start = F.array_position(flags, True).cast("int")
    after = F.slice(lines, start + 1, F.size(lines))
    stop = F.array_position(F.transform(after, lambda l: (F.length(l) < 70) & l.rlike(":$")), True).cast("int")
    body = F.when(stop > 0, F.slice(after, F.lit(1), stop - 1)).otherwise(after)
    joined = F.aggregate(
        F.transform(body, lambda l: F.regexp_replace(l, r"^•\s*", "")),
        F.lit(""),
        lambda acc, l: F.when(F.length(acc) > limit, acc).when(acc == "", l).otherwise(F.concat(acc, F.lit(" "), l)),
    )
    whole = strip(F.regexp_replace(joined, r"\s+", " "))
    cut = F.substring(whole, 1, limit)
    end = F.greatest(_last(cut, ". "), _last(cut, "! "))
    short = F.when(end > 121, F.substring(cut, F.lit(1), end)).otherwise(F.concat(F.substring(cut, F.lit(1), _last(cut, " ") - 1), F.lit("…")))
    return F.when((start > 0) & (F.length(whole) >= shortest), F.when(F.length(whole) <= limit, whole).otherwise(short))


def _last(c: Column, needle: str) -> Column:
    """1-based place of the last occurrence, 0 when absent."""
    at = F.instr(F.reverse(c), needle[::-1])
    return F.when(at > 0, F.length(c) - at - len(needle) + 2).otherwise(0)


def company_intro(text: Column) -> Column:
    return intro_from(structure_text(text))


def focused_excerpt(text: Column, longest: int = 3200, kept: int = 1900, start: str = R.REQUIREMENTS_START) -> Column:
    """Head of a long text plus its requirements section."""
    found = F.regexp_extract(text, start, 0)
    at = F.when(found != "", F.position(found, text)).otherwise(0)
    section = F.substring(text, at, F.lit(kept))
    head = F.substring(text, F.lit(1), longest - F.length(section) - 20)
    return F.when(F.length(text) <= longest, text).when(at == 0, F.substring(text, 1, longest)).otherwise(F.concat(head, F.lit("\n[…]\n"), section))


def meta_description(html: Column) -> Column:
    """What a company's home page says in its description tag; cookie notices and slogans refused."""
    first = blank_to_null(F.regexp_extract(html, r"(?i)<meta[^>]+(?:name|property)=[\"'](?:description|og:description)[\"'][^>]+content=[\"']([^\"']+)[\"']", 1))
    second = blank_to_null(F.regexp_extract(html, r"(?i)<meta[^>]+content=[\"']([^\"']+)[\"'][^>]+(?:name|property)=[\"'](?:description|og:description)[\"']", 1))
    raw = F.coalesce(first, second)
    for pattern, char in [("&amp;", "&"), ("&#0?39;|&apos;|&#x27;", "'"), ("&quot;", '"'), ("&nbsp;", " "), (r"[\s ]+", " ")]:
        raw = F.regexp_replace(raw, pattern, char)
    text = strip(raw)
    cut = F.substring(text, 1, 240)
    end = F.greatest(_last(cut, ". "), _last(cut, " ") - 1)
    shown = F.when(F.length(text) <= 240, text).otherwise(F.concat(strip(F.substring(cut, F.lit(1), end)), F.lit("…")))
    return F.when((F.length(text) >= 40) & ~text.rlike("(?i)cookie|javascript|captcha|access denied"), shown)
