"""Signals of a posting as column expressions: contract, remote work, experience, pay, title seniority.

Functions whose name ends in `_in` take text made by `rule_text`, so one pass serves several rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vacanta.columns import any_of, contexts, first_rule, fixed_map, group, half_up, hears, let, pieces, says, tail
from vacanta.functions.text import rule_text
from vacanta.rules import signals as R


def _may(c: Column, pattern: str) -> Column:
    """Whether `c` holds a word the pattern needs: texts without one are not searched for it."""
    held = lambda n: F.contains(c, F.lit(n)) if isinstance(n, str) else F.contains(c, F.lit(n[0])) & hears(c, n[1])
    return any_of([held(n) for n in R.NEEDS[pattern]])


def _heard(c: Column, pattern: str) -> Column:
    return _may(c, pattern) & hears(c, pattern)


def contract_in(title: Column, explicit: Column, text: Column) -> Column:
    """Contract of a posting from its folded title, its folded structured field and its folded text."""
    loud = [(p, c) for p, c in R.CONTRACT_WORDS if c != "cdi"]
    stated = F.coalesce(*[F.when(_may(text, p), group(text, p)) for p in R.CONTRACT_STATED])
    named = fixed_map(R.CONTRACT_STATED_WORDS)
    return F.coalesce(
        first_rule(title, loud, test=hears),
        first_rule(F.coalesce(explicit, F.lit("")), R.CONTRACT_WORDS, test=hears),
        first_rule(title, R.CONTRACT_WORDS, test=hears),
        F.when(stated.isNotNull(), F.coalesce(F.try_element_at(named, F.regexp_replace(stated, "[- ]", "")), F.lit("unknown"))),
        first_rule(text, R.CONTRACT_PROSE, test=_heard),
        F.lit("unknown"),
    )


def detect_contract(title: Column, explicit: Column | None = None, text: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return contract_in(rule_text(title), rule_text(explicit) if explicit is not None else none, F.coalesce(rule_text(text), F.lit("")) if text is not None else F.lit(""))


def remote_in(text: Column) -> Column:
    n = F.translate(text, "\u00a0\u202f", "  ")
    return F.when(_heard(n, R.REMOTE_FULL), "remote").when(_heard(n, R.REMOTE_DENIED), F.lit(None)).when(_heard(n, R.REMOTE_SOME), "hybrid")


def detect_remote(text: Column) -> Column:
    return remote_in(rule_text(text))


def years_text(text: Column) -> Column:
    """Folded text made ready for durations: entities, thin spaces, dashes and apostrophes straightened."""
    return F.translate(F.regexp_replace(text, "&#?[a-z0-9]+;", " "), "\u00a0\u202f–—‑−’`", "  ----''")


def _floor_years(c: Column) -> Column:
    return F.floor(F.replace(c, F.lit(","), F.lit(".")).try_cast("double"))


def experience_in(text: Column) -> Column:
    """First duration in years that is an experience asked: struct(min, max), nulls when nothing is said."""
    duration = R.DURATION.replace(r"\b", "")

    def parts(x: Column) -> Column:
        return F.struct(
            x["m"].alias("m"), x["before"].alias("before"), x["after"].alias("after"),
            F.regexp_extract(x["m"], duration, 1).alias("prefix"),
            _floor_years(F.regexp_extract(x["m"], duration, 2)).alias("low"),
            _floor_years(group(x["m"], duration, 4)).alias("high"),
        )

    def read(x: Column) -> Column:
        ceiling = F.trim(x["prefix"]).rlike(R.CEILING)
        about = hears(F.concat(x["before"], x["m"], x["after"]), R.EXPERIENCE_NEAR)
        lead = F.when(x["prefix"] != "", F.substring(x["m"], F.lit(1), F.length(x["prefix"]) + 1)).otherwise(F.lit(""))
        other = hears(F.concat(tail(x["before"], 30), lead), R.NOT_EXPERIENCE)
        low = F.when(ceiling, F.lit(0)).otherwise(x["low"])
        upper = F.when((x["high"] >= x["low"]) & (x["high"] <= R.YEARS_HIGH_MAX), x["high"])
        return F.struct(
            (F.coalesce(low <= R.YEARS_MAX, F.lit(False)) & about & ~other).alias("ok"),
            low.cast("int").alias("min"),
            F.when(ceiling, x["low"]).otherwise(upper).cast("int").alias("max"),
        )

    found = F.filter(F.transform(F.transform(contexts(pieces(text, R.DURATION), 110, 70), parts), read), lambda x: x["ok"])
    # A text without a digit holds no duration: the pattern is not tried on it.
    first = F.when(text.rlike("[0-9]"), F.get(found, F.lit(0)))
    return F.struct(first["min"].alias("min"), first["max"].alias("max"))


def detect_experience(text: Column) -> Column:
    return experience_in(years_text(rule_text(text)))


def level_in(text: Column) -> Column:
    return F.when(_heard(text, R.JUNIOR_TEXT), "junior").when(_heard(text, R.EXPERIENCED_TEXT), "experienced")


def detect_experience_level(text: Column) -> Column:
    return level_in(rule_text(text))


def experience_label(low: Column, high: Column) -> Column:
    return (
        F.when(low.isNull(), F.lit(None))
        .when(high > low, F.concat(low.cast("string"), F.lit(" à "), high.cast("string"), F.lit(" ans")))
        .when(low == 0, F.lit("Débutant accepté"))
        .otherwise(F.concat(low.cast("string"), F.when(low > 1, F.lit(" ans et plus")).otherwise(F.lit(" an et plus"))))
    )


def experience_text(low: Column, high: Column, level: Column, estimate: Column | None = None) -> Column:
    """The years when they are given, else the posting's words, else the estimated level said as such."""
    guess = (
        F.when(estimate == "junior", "Non précisée · missions de niveau junior (estimé)")
        .when(estimate == "confirme", "Non précisée · missions de niveau confirmé (estimé)")
        .when(estimate == "senior", "Non précisée · missions de niveau senior (estimé)")
        if estimate is not None
        else F.lit(None).cast("string")
    )
    words = F.when(level == "junior", "Profil junior accepté").when(level == "experienced", "Expérience significative demandée")
    return F.coalesce(experience_label(low, high), words, guess)


def seniority_in(title: Column) -> Column:
    return first_rule(title, R.TITLE_YEARS, F.lit(0), hears)


def title_seniority(title: Column) -> Column:
    """Least years of experience a title implies."""
    return seniority_in(rule_text(title))


def _plain_amount(c: Column) -> Column:
    return F.replace(F.regexp_replace(c, r"[ .,](?=\d{3}(?!\d))", ""), F.lit(","), F.lit(".")).try_cast("double")


def _thousands(raw: Column, unit: Column) -> Column:
    v = _plain_amount(raw)
    stays = unit.rlike("[kK]") | (unit == "000")
    return F.when(F.coalesce(stays, F.lit(False)), v).when(v >= 1000, v / 1000).otherwise(v)


def salary_in(text: Column) -> Column:
    """Pay as a posting writes it, from folded text: amount or range, gross or net, a month or a year."""
    n = F.translate(text, "\u00a0\u202f–—‑−", "  ----")

    def parts(x: Column) -> Column:
        return F.struct(
            *[group(x["m"], R.SALARY, k).alias(f"g{k}") for k in range(1, 7)],
            F.concat(tail(x["before"], 45), x["m"], F.substring(x["after"], 1, 30)).alias("around"),
            F.concat(x["before"], x["m"]).alias("until"),
        )

    def amounts(x: Column) -> Column:
        unit = F.coalesce(x["g2"], x["g4"], x["g6"])
        bare = unit.isNull() | F.coalesce(x["g6"].contains("€"), F.lit(False))
        euros = F.when(bare, _plain_amount(F.coalesce(x["g1"], x["g5"]))).otherwise(F.lit(0.0))
        return F.struct(
            x["around"].alias("around"),
            F.when(x["g1"].isNotNull(), _thousands(x["g1"], F.coalesce(x["g2"], x["g4"]))).otherwise(_thousands(x["g5"], x["g6"])).alias("low"),
            F.when(x["g3"].isNotNull(), _thousands(x["g3"], F.coalesce(x["g4"], x["g2"]))).alias("high"),
            (hears(x["around"], R.PAY_MONTHLY) | ((euros >= 1000) & (euros < 15000) & ~hears(x["around"], R.PAY_YEARLY))).alias("monthly"),
        )

    def sound(v: Column, monthly: Column) -> Column:
        return F.when(monthly, v.between(*R.MONTHLY_RANGE)).otherwise(v.between(*R.YEARLY_RANGE))

    def is_sound(x: Column) -> Column:
        high = F.coalesce(sound(x["high"], x["monthly"]) & (x["high"] >= x["low"]), F.lit(True))
        return F.coalesce(x["low"].isNotNull() & sound(x["low"], x["monthly"]) & high, F.lit(False))

    def shown(x: Column) -> Column:
        month = lambda v: F.concat(F.translate(F.format_number(half_up(v * 1000).cast("double"), 0), ",", " "), F.lit(" €"))
        whole = lambda v: half_up(v).cast("string")
        span = F.when(x["monthly"], F.concat(month(x["low"]), F.lit(" à "), month(x["high"]))).otherwise(F.concat(whole(x["low"]), F.lit(" à "), whole(x["high"]), F.lit(" k€")))
        single = F.when(x["monthly"], month(x["low"])).otherwise(F.concat(whole(x["low"]), F.lit(" k€")))
        gross = F.when(hears(x["around"], "brut|gross"), " brut").when(hears(x["around"], r"net\b"), " net").otherwise("")
        return F.concat(F.when(x["high"] != x["low"], span).otherwise(single), gross, F.when(x["monthly"], " par mois").otherwise(" par an"))

    near = F.transform(contexts(pieces(n, R.SALARY), 50, 30, shortest=2), parts)
    paid = F.filter(near, lambda x: hears(x["around"], R.PAY_NEAR) & ~hears(x["until"], R.NOT_PAY))
    first = F.get(F.filter(F.transform(paid, amounts), is_sound), F.lit(0))
    return F.when(n.rlike("[0-9]"), let(first, lambda x: F.when(x.isNotNull(), shown(x))))


def detect_salary(text: Column) -> Column:
    return salary_in(rule_text(text))


_GROUPED = r"(\d{1,3}(?:[ \u00a0\u202f]\d{3})*|\d+)(?:,\d+)?"


def salary_midpoint(text: Column) -> Column:
    """Middle of a pay text in thousands of euros a year, gross only."""
    values = F.transform(
        F.regexp_extract_all(text, F.lit(_GROUPED), F.lit(1)), lambda v: F.translate(v, " \u00a0\u202f", "").try_cast("double")
    )
    first, second = F.get(values, F.lit(0)), F.get(values, F.lit(1))
    middle = F.when(second.isNotNull(), (first + second) / 2).otherwise(first)
    yearly = F.when(text.contains("par mois"), middle * 12 / 1000).when(middle >= 1000, middle / 1000).otherwise(middle)
    kept = ~says(text, r"\bnet\b") & yearly.between(*R.MIDPOINT_RANGE)
    return F.when(kept, half_up(yearly).cast("int"))


def is_closed(text: Column) -> Column:
    return text.rlike(R.CLOSED_POSTING)


def is_training(title: Column) -> Column:
    return says(title, R.TRAINING_TITLE)


def is_student(title_folded: Column, contract: Column) -> Column:
    return F.coalesce(contract.isin("stage", "alternance"), F.lit(False)) | hears(title_folded, R.STUDENT_TITLE)


def has_junior_title(title_folded: Column) -> Column:
    return hears(title_folded, R.JUNIOR_TITLE)


def is_junior(title: Column, years: Column, level: Column, asked: Column) -> Column:
    """Junior offers of the selection view: two years at most, or words that say so."""
    no = F.lit(False)
    worded = years.isNull() & F.coalesce(level != "experienced", F.lit(True)) & says(F.coalesce(asked, F.lit("")), R.JUNIOR_VIEW)
    return F.coalesce(years <= 2, no) | F.coalesce(level == "junior", no) | says(title, R.JUNIOR_VIEW) | worded


def with_signals(df: DataFrame, title: str = "title", text: str = "text", explicit: str | None = None) -> DataFrame:
    """Adds contract, remote, experience and pay columns; each text is folded once."""
    folded = df.withColumns({
        "_title": rule_text(F.col(title)),
        "_text": F.coalesce(rule_text(F.col(text)), F.lit("")),
    })
    years = folded.withColumn("_years", experience_in(years_text(F.col("_text"))))
    stated = rule_text(F.col(explicit)) if explicit else F.lit(None).cast("string")
    return years.withColumns({
        "contract": contract_in(F.col("_title"), stated, F.col("_text")),
        "remote_text": remote_in(F.col("_text")),
        "experience_min_years": F.col("_years")["min"],
        "experience_max_years": F.col("_years")["max"],
        "experience_level": level_in(F.col("_text")),
        "salary_text": salary_in(F.col("_text")),
        "title_years": seniority_in(F.col("_title")),
    }).drop("_title", "_text", "_years")
