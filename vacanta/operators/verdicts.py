"""Landed answers checked against the postings: parsing, quotes, sectors, level, scores, final row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vacanta.columns import half_up, says, strings, strip
from vacanta.functions.relevance import invented_words
from vacanta.functions.signals import detect_experience
from vacanta.functions.text import fold, squash
from vacanta.operators.filters import is_company_wide
from vacanta.operators.gates import chances_cap, contract_reason, number_text
from vacanta.rules import verdicts as R
from vacanta.rules import views as V


def mark(c: Column) -> Column:
    """Folded text with underscores for spaces and dashes, as enumerated answers are compared."""
    return strip(F.regexp_replace(fold(c), r"[\s-]+", "_"))


def one_of(c: Column, values: list[str], fallback: str) -> Column:
    out = F.lit(fallback)
    for v in reversed(values):
        out = F.when(F.startswith(mark(c), F.lit(v)), v).otherwise(out)
    return out


def plain(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(c, r"\*\*|__|`", ""), r"^\s*[-*•]\s+", ""))


def answer_text(c: Column) -> Column:
    t = strip(c)
    return F.when((t != "") & ~t.rlike(R.NO_TEXT), t)


def answer_list(c: Column) -> Column:
    return F.filter(F.transform(F.coalesce(c, strings([])), plain), lambda x: x != "")


def _kind(item: str, field: str) -> Column:
    """Type of a field of a variant: null when it is absent, VOID when it is a JSON null."""
    return F.schema_of_variant(F.try_variant_get(item, f"$.{field}", "variant"))


def _coerced(item: str, field: str) -> Column:
    """A number as a lenient reader takes it: text is read, an empty one and null are 0, what cannot be read is null."""
    text = strip(F.try_variant_get(item, f"$.{field}", "string"))
    kind = _kind(item, field)
    return F.when(kind == "VOID", 0.0).when(kind == "BOOLEAN", F.try_variant_get(item, f"$.{field}", "boolean").cast("double")).when(text == "", 0.0).otherwise(text.try_cast("double"))


def parse_verdicts(answers: DataFrame, answer: str = "answer", offers: str = "offer_ids") -> tuple[DataFrame, DataFrame]:
    """(verdicts, refused): one row per element of each answer; a malformed element is set apart alone.

    Answers are read as variants, element by element and field by field, so one of a wrong type spoils its own
    element only; `refused` names the first such field. An answer that is no JSON object with a list of results is
    refused whole (field `resultats`). `offers` is the list of offers sent; "o2", "2" and "O2" mean the second, else
    the place in the answer.
    """
    keep = [c for c in answers.columns if c not in (answer, offers)]
    read = answers.withColumn("_list", F.try_variant_get(F.try_parse_json(F.col(answer)), "$.resultats", "array<variant>"))
    whole = read.filter("_list IS NULL").select(*keep, F.lit(None).cast("string").alias("offer_id"), F.lit("resultats").alias("field"), F.col(answer).alias("element"))
    items = read.filter("_list IS NOT NULL").select("*", F.size("_list").alias("_n"), F.posexplode("_list").alias("_at", "i"))
    scores = ["score_interet", "score_chances", "score_tremplin"]
    text = lambda f: F.try_variant_get("i", f"$.{f}", "string")
    values = {f"_{s}": _coerced("i", s) for s in scores}
    lists = {f"_{f}": F.try_variant_get("i", f"$.{f}", "array<string>") for f in ("missions", "points_d_attention")}
    skills = F.try_variant_get("i", "$.competences", "array<struct<nom:string,type:string>>")
    items = items.withColumns(values | lists | {"_competences": skills})

    absent = lambda f: F.coalesce(_kind("i", f) == "VOID", F.lit(True))
    broken = [F.when(~F.coalesce(_kind("i", "id").isin("STRING", "BIGINT") | _kind("i", "id").startswith("DECIMAL"), F.lit(False)), "id")]
    broken += [F.when(F.coalesce(_kind("i", f) != "STRING", F.lit(True)), f) for f in ("correspondance", "secteur")]
    broken += [F.when(~absent(f) & (_kind("i", f) != "STRING"), f) for f in R.TEXT_FIELDS]
    broken += [F.when(~F.coalesce(F.col(f"_{s}").between(0, 100), F.lit(False)), s) for s in scores]
    strings_only = lambda f: F.coalesce(_kind("i", f).isin("ARRAY<STRING>", "ARRAY<VOID>"), F.lit(False))
    broken += [F.when(~absent(f) & ~strings_only(f), f) for f in ("missions", "points_d_attention")]
    broken += [F.when(~absent("competences") & (F.col("_competences").isNull() | F.exists("_competences", lambda x: x.isNull() | x["nom"].isNull())), "competences")]

    number = F.regexp_extract(strip(text("id")), r"^[oO]?(\d+)$", 1).try_cast("int")
    by_id = F.get(F.col(offers), number - 1)
    by_place = F.when(F.col("_n") == F.size(offers), F.get(F.col(offers), F.col("_at")))
    out = items.select(
        *keep, F.coalesce(by_id, by_place).alias("offer_id"), F.coalesce(*broken).alias("_field"), F.to_json("i").alias("_raw"),
        one_of(text("correspondance"), R.MATCHES, "autre").alias("correspondance"), one_of(text("secteur"), R.SECTORS, "autre").alias("secteur"),
        *[answer_text(text(f)).alias(f) for f in R.TEXT_FIELDS], *[F.col(f"_{s}").alias(s) for s in scores],
        answer_list(F.col("_missions")).alias("missions"), answer_list(F.col("_points_d_attention")).alias("points_d_attention"),
        F.coalesce("_competences", F.array().cast("array<struct<nom:string,type:string>>")).alias("competences"),
    )
    field = F.coalesce("_field", F.when(F.col("offer_id").isNull(), "id"))
    refused = out.withColumn("field", field).filter("field IS NOT NULL").select(*keep, "offer_id", "field", F.col("_raw").alias("element"))
    types = {f.name: f.dataType for f in refused.schema.fields}
    return out.filter(field.isNull()).drop("_field", "_raw"), refused.unionByName(whole.withColumn("offer_id", F.col("offer_id").cast(types["offer_id"])))


def written(quote: Column, squashed: Column) -> Column:
    """The quote stands word for word in a text that is squashed already."""
    return F.coalesce(F.contains(squashed, squash(quote)), F.lit(False))


def years_label(years: Column) -> Column:
    return F.when(years == 0, "Débutant accepté").when(years > 1, F.concat(number_text(years), F.lit(" ans et plus"))).otherwise(F.concat(number_text(years), F.lit(" an et plus")))


def verified_experience(asked: Column, required: Column, squashed: Column, quote: Column) -> Column:
    """struct(label, years): the text's own reading wins, else a quote found in it that names the years."""
    quoted = F.when(written(quote, squashed), detect_experience(quote)["min"])
    words = F.when(~asked.rlike(r"\d") & squashed.rlike(R.BEGINNER), asked)
    years = F.coalesce(required.cast("double"), quoted.cast("double"))
    return F.struct(F.when(years.isNotNull(), years_label(years)).otherwise(words).alias("label"), years.alias("years"))


def verified_contract(contract: Column, quote: Column, squashed: Column) -> Column:
    c = F.lower(strip(contract))
    out = F.lit(None).cast("string")
    for name, pattern in R.CONTRACT_WORDS.items():
        out = F.when((c == name) & says(squash(quote), pattern), c).otherwise(out)
    return F.when(written(quote, squashed), out)


def verified_salary(salary: Column, text: Column) -> Column:
    """A salary is kept when each of its numbers is in the text."""
    bare = F.regexp_replace(text, r"[\s  ]", "")
    numbers = F.regexp_extract_all(F.regexp_replace(salary, r"[\s  ]", ""), F.lit(r"\d+"), F.lit(0))
    return F.when((F.size(numbers) > 0) & F.forall(numbers, lambda n: F.contains(bare, n)), salary)


def checked_skills(skills: Column, folded: Column, kept: int = 6) -> Column:
    """Skills each of whose words is in the text, once each, six at most."""
    named = F.transform(skills, lambda s: F.struct(strip(F.regexp_replace(plain(s["nom"]), r"\s+", " ")).alias("name"), F.coalesce(s["type"], F.lit("")).alias("type")))
    worded = F.transform(named, lambda s: F.struct(s["name"].alias("name"), s["type"].alias("type"), F.filter(F.split(fold(s["name"]), "[^a-z0-9+#]+", -1), lambda w: F.length(w) >= 2).alias("words")))
    real = F.filter(worded, lambda s: (s["name"] != "") & (F.length(s["name"]) <= 40) & (F.size(s["words"]) > 0) & F.forall(s["words"], lambda w: F.contains(folded, w)))

    def kind(t: Column) -> Column:
        out = F.lit("methode")
        for k in reversed(R.SKILL_KINDS):
            out = F.when(F.startswith(mark(t), F.lit(k[:5])), k).otherwise(out)
        return out

    typed = F.transform(real, lambda s: F.struct(s["name"].alias("name"), kind(s["type"]).alias("kind"), fold(s["name"]).alias("f")))
    once = F.aggregate(
        typed, F.array().cast("array<struct<name:string,kind:string,f:string>>"),
        lambda acc, s: F.when(F.exists(acc, lambda o: o["f"] == s["f"]), acc).otherwise(F.concat(acc, F.array(s))),
    )
    return F.transform(F.slice(once, 1, kept), lambda s: F.struct(s["name"].alias("name"), s["kind"].alias("kind")))


def names_item(cited: Column, item: Column) -> Column:
    c, f = mark(cited), mark(item)
    return F.coalesce((F.length(c) >= 3) & (F.length(f) >= 3) & (F.contains(f, c) | F.contains(c, f)), F.lit(False))


def proves(item: Column, quote: Column) -> Column:
    """The posting's sentence names what the person's item is about."""
    words = F.filter(F.split(mark(item), "[^a-z0-9]+", -1), lambda w: (F.length(w) >= 3) & ~w.isin(R.GENERIC_WORDS))
    q = F.translate(mark(quote), "_", " ")
    return F.coalesce(F.exists(words, lambda w: F.contains(q, F.regexp_replace(w, "s$", ""))), F.lit(False))


def proved_item(items: Column, cited: Column, quote: Column, squashed: Column, negatives: bool = True) -> Column:
    """The person's own item an exclusion names, when a sentence of the posting proves it."""
    item = F.get(F.filter(F.coalesce(items, strings([])), lambda i: names_item(cited, i)), F.lit(0))
    long = F.length(strip(quote)) >= R.QUOTE_LENGTH
    ok = long & written(quote, squashed) & proves(item, quote)
    if not negatives:
        ok = ok & ~says(F.translate(mark(item), "_", " "), R.NEGATIVE)
    return F.when(ok, item)


def read_sector(sector: Column, avoided: Column, activity: Column, priority: Column, cited: Column) -> Column:
    read = F.when((sector == "a_eviter") & avoided.isNull(), "autre").otherwise(sector)
    sought = F.coalesce(priority, strings([]))
    consulting = F.coalesce(says(activity, R.CONSULTING), F.lit(False)) & ~F.exists(sought, lambda p: p.rlike(R.CONSULTING_SOUGHT))
    named = F.exists(sought, lambda p: names_item(cited, p))
    return F.when((read == "prioritaire") & (consulting | ~named), "autre").otherwise(read)


def read_match(match: Column, trap: Column, names_role: Column, title_match: Column, sector: Column, excerpt: Column) -> Column:
    clear = trap.isNull() & names_role
    return (
        F.when((match == "passerelle") & clear, "metier_vise")
        .when((match == "passerelle") & (title_match == F.lit(False)) & (sector != "prioritaire"), "autre")
        .when((match == "autre") & excerpt & clear, "metier_vise")
        .otherwise(match)
    )


def within_reach(asked: Column, years: Column, level: Column, seniority: Column, title: Column, label: Column) -> Column:
    no = F.lit(False)
    silent = asked.isNull()
    return (
        F.coalesce(asked <= F.coalesce(years, F.lit(0)), no)
        | F.coalesce(level == "junior", no)
        | (silent & level.isNull() & F.coalesce(seniority == "junior", no))
        | says(fold(title), R.JUNIOR_TITLE)
        | (silent & F.coalesce(level != "experienced", F.lit(True)) & label.isNotNull() & ~F.coalesce(label.rlike(r"\d"), no))
    )


def derive_level(match: Column, sector: Column, trap: Column, breaker: Column, chances: Column, favorite: Column, reach: Column, open_sectors: Column) -> Column:
    """struct(level, reason): constraints are gates, any one of them sets the level."""
    out = lambda level, reason=None: F.struct(F.lit(level).alias("level"), (F.lit(None).cast("string") if reason is None else reason).alias("reason"))
    close = (sector == "prioritaire") | F.coalesce(favorite, F.lit(False)) | F.coalesce(reach, F.lit(False))
    return (
        F.when(breaker.isNotNull(), out("ecartee", breaker))
        .when(sector == "a_eviter", out("ecartee", F.lit(V.REASON_SECTOR_AVOIDED)))
        .when(trap.isNotNull() & (match == "passerelle"), out("tremplin"))
        .when(trap.isNotNull(), out("ecartee", trap))
        .when(match == "autre", out("ecartee"))
        .when(match == "passerelle", out("tremplin"))
        .when((sector == "autre") & ~open_sectors & ~F.coalesce(favorite, F.lit(False)), out("ecartee", F.lit(V.REASON_SECTOR_CLOSED)))
        .when((chances >= 50) & close, out("coeur"))
        .otherwise(out("solide"))
    )


def to_hundred(interest: Column, chances: Column, bridge: Column, level: Column) -> Column:
    """Scores of 0 to 10 brought to 100, interest capped by the level."""
    small = (level != "ecartee") & (interest <= 10) & (chances <= 10) & (bridge <= 10)
    scaled = lambda n: F.least(F.lit(100), half_up(n * F.when(small, 10).otherwise(1)).cast("int"))
    cap = F.when(level == "ecartee", 30).when(level == "tremplin", 55).otherwise(100)
    return F.struct(F.least(scaled(interest), cap).alias("interest"), scaled(chances).alias("chances"), scaled(bridge).alias("bridge"))


def watch_list(trap: Column, breaker_said: Column, breaker: Column, reserve: Column, notes: Column, asked: Column, years: Column, level: Column, seniority: Column, kept: int = 3) -> Column:
    """What to check first: the trap, unproved deal-breakers, the computed experience note, other notes."""
    gap = asked - years
    note = (
        F.when(gap > 0, F.concat(number_text(asked), F.lit(" an"), F.when(asked > 1, "s").otherwise(""), F.lit(" demandé"), F.when(asked > 1, "s").otherwise(""), F.lit(", "), number_text(gap), F.lit(" de plus que toi")))
        .when(asked.isNull() & (level == "experienced"), "Expérience significative demandée")
        .when(asked.isNull() & level.isNull() & (seniority == "senior"), "Expérience non précisée, missions de niveau senior")
        .when(asked.isNull() & level.isNull() & (seniority == "confirme"), "Expérience non précisée, missions de niveau confirmé")
    )
    own = F.when(~says(reserve, R.ALL_WELL), plain(reserve))
    unless_noted = lambda c: F.when(~F.array_contains(notes, c), c)
    first = F.coalesce(note, own)
    parts = [unless_noted(trap), F.when(breaker_said.isNotNull() & breaker.isNull(), F.concat(F.lit("À vérifier : "), breaker_said)), unless_noted(first), F.when(note.isNotNull(), own)]
    rest = F.filter(notes, lambda p: ~says(p, R.EXPERIENCE_NOTE))
    return F.slice(F.concat(F.array_compact(F.array(*parts)), rest), 1, kept)


def check_verdicts(v: DataFrame) -> DataFrame:
    """Answers joined with their offer and profile, turned into checked facts, a level and its scores.

    Offer columns: title, text, experience_min_years, experience_level, excerpt. Profile columns:
    sectors_avoid, sectors_priority, deal_breakers, open_sectors, experience_years. Pair columns:
    favorite, title_match, names_role.
    """
    c = F.col
    base = v.withColumns({"_squashed": squash(c("text")), "_folded": fold(c("text"))})
    seniority = F.lit(None).cast("string")
    for s in reversed(R.SENIORITIES):
        seniority = F.when(F.startswith(mark(c("niveau_missions")), F.lit(s[:5])), s).otherwise(seniority)
    facts = base.withColumns({
        "experience": verified_experience(c("experience_demandee"), c("experience_min_years"), c("_squashed"), c("citation_experience")),
        "contract_found": verified_contract(c("contrat"), c("citation_contrat"), c("_squashed")),
        "salary": verified_salary(c("salaire"), c("text")),
        "skills": F.when(~c("excerpt"), checked_skills(c("competences"), c("_folded"))),
        "seniority": seniority,
        "trap": F.when(~says(c("piege"), R.SECTOR_OPINION), c("piege")),
        "avoided": proved_item(c("sectors_avoid"), c("secteur_evite_concerne"), c("citation_secteur"), c("_squashed")),
        "breaker": F.when(c("deal_breaker").isNotNull() & proved_item(c("deal_breakers"), c("deal_breaker_concerne"), c("citation_deal_breaker"), c("_squashed"), negatives=False).isNotNull(), c("deal_breaker")),
    })
    read = facts.withColumn("sector", read_sector(c("secteur"), c("avoided"), c("activite_entreprise"), c("sectors_priority"), c("secteur_prioritaire_concerne")))
    read = read.withColumn("match", read_match(c("correspondance"), c("trap"), c("names_role"), c("title_match"), c("sector"), c("excerpt")))
    read = read.withColumn("asked", F.coalesce(c("experience_min_years").cast("double"), c("experience.years")))
    read = read.withColumn("reach", within_reach(c("asked"), c("experience_years"), c("experience_level"), c("seniority"), c("title"), c("experience.label")))
    judged = read.withColumn("verdict", derive_level(c("match"), c("sector"), c("trap"), c("breaker"), c("score_chances"), c("favorite"), c("reach"), c("open_sectors")))
    scored = judged.withColumn("scores", to_hundred(c("score_interet"), c("score_chances"), c("score_tremplin"), c("verdict.level")))
    said = F.coalesce(plain(c("en_bref")), plain(c("pourquoi")), F.lit(V.REASON_NO_MATCH))
    product = F.when(~c("excerpt") & is_company_wide(c("activite_entreprise")), F.substring(plain(c("activite_entreprise")), 1, 200))
    out = scored.withColumns({
        "level": c("verdict.level"),
        "why": F.coalesce(plain(c("pourquoi")), plain(c("en_bref")), F.lit("")),
        "watch": watch_list(c("piege"), c("deal_breaker"), c("breaker"), c("reserve"), c("points_d_attention"), c("asked"), c("experience_years"), c("experience_level"), c("seniority")),
        "excluded_reason": F.when(c("verdict.level") == "ecartee", F.coalesce("verdict.reason", said)),
        "company_product": product,
        "experience_asked": c("experience.label"), "experience_found": c("experience.years"),
        "score_interet": c("scores.interest"), "score_chances": c("scores.chances"), "score_tremplin": c("scores.bridge"),
    })
    return out.drop("_squashed", "_folded", "verdict", "scores", "experience")


def score_row(checked: DataFrame) -> DataFrame:
    """Final row: contract and years gates with what was found, gap on the level, chances capped, invented reasons out.

    Adds to `check_verdicts`: contract (known), contracts (wanted), gap (from the gates), role_cores.
    """
    c = F.col
    years, found, known = c("experience_years"), c("experience_found"), c("experience_min_years")
    wanted = F.coalesce(c("contracts"), strings([]))
    refused = (c("contract") == "unknown") & c("contract_found").isNotNull() & (F.size(wanted) > 0) & ~F.array_contains(wanted, c("contract_found"))
    learned = known.isNull() & found.isNotNull() & years.isNotNull()
    too_much = learned & (found - years >= R.EXCLUDE_GAP)
    implied = F.lit(0)
    for name, n in R.SENIORITY_YEARS.items():
        implied = F.when(c("seniority") == name, n).otherwise(implied)
    guessed = known.isNull() & found.isNull() & c("seniority").isNotNull() & years.isNotNull()
    gap = F.when(learned, F.greatest(c("gap"), found - years)).when(guessed, F.greatest(c("gap"), implied - years)).otherwise(c("gap"))
    gated = checked.withColumns({"effective_gap": gap, "_refused": F.coalesce(refused, F.lit(False)), "_too_much": F.coalesce(too_much, F.lit(False))})
    shut = c("_refused") | c("_too_much")
    level = F.when(shut, "ecartee").when((c("level") == "coeur") & (c("effective_gap") >= 2), "solide").otherwise(c("level"))
    reason = (
        F.when(c("_refused"), contract_reason(c("contract_found")))
        .when(c("_too_much"), F.concat(number_text(found), F.lit(" ans d'expérience demandés, "), number_text(years), F.lit(" de ton côté.")))
        .otherwise(c("excluded_reason"))
    )
    capped = F.when(shut, c("score_chances")).otherwise(F.least(c("score_chances"), chances_cap(c("effective_gap"))))
    made = F.exists(F.coalesce(c("role_cores"), strings([])), lambda r: F.size(invented_words(c("why"), c("title"), c("text"), r)) > 0)
    out = gated.withColumns({"level": level, "excluded_reason": reason, "score_chances": capped.cast("int")})
    out = out.withColumn("_made", (c("level") != "ecartee") & made)
    out = out.withColumns({"excluded_reason": F.when(c("_made"), V.REASON_INVENTED).otherwise(c("excluded_reason")), "level": F.when(c("_made"), "ecartee").otherwise(c("level")), "scored_by": F.lit("llm")})
    return out.drop("_refused", "_too_much", "_made")


def learn_facts(offers: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Facts read in verdicts written on offers that lack them (first person's verdict wins); nothing known changes."""
    order = F.col("user_id")
    first = lambda col, ok=None: F.min_by(F.col(col), F.when(F.col(col).isNotNull() if ok is None else ok, order)).alias(f"_{col}")
    listed = [first("skills", F.size("skills") > 0)] if "skills" in offers.columns else []
    facts = verdicts.groupBy("offer_id").agg(first("experience_found"), first("contract_found"), first("seniority"), *listed)
    j = offers.join(facts, "offer_id", "left")
    return j.withColumns({
        "experience_min_years": F.coalesce("experience_min_years", F.col("_experience_found")),
        "contract": F.when(F.col("contract") == "unknown", F.coalesce("_contract_found", "contract")).otherwise(F.col("contract")),
        "seniority_estimate": F.coalesce("seniority_estimate", "_seniority"),
        **({"skills": F.when(F.size("skills") > 0, F.col("skills")).otherwise(F.coalesce("_skills", "skills"))} if listed else {}),
    }).drop("_experience_found", "_contract_found", "_seniority", "_skills")


def learn_products(companies: DataFrame, verdicts: DataFrame) -> DataFrame:
    """What a company makes, read in verdicts on its offers, written where nothing is known (first person's verdict wins).

    `companies` holds company_id and product; `verdicts` company_id, user_id and company_product.
    """
    told = F.col("company_product").isNotNull()
    facts = verdicts.groupBy("company_id").agg(F.min_by("company_product", F.when(told, F.struct("user_id", "company_product"))).alias("_product"))
    return companies.join(facts, "company_id", "left").withColumn("product", F.coalesce("product", "_product")).drop("_product")
