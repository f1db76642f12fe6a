"""Answers about documents, some of them broken, checked against the documents' texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vacanta.functions.criteria import parse_criteria
from vacanta.operators import verdicts as V
from vacanta.plans.scoring import after_model
from vacanta.workloads.binding import table
from vacanta.workloads.registry import query

# Three documents a question: their places in it are 0, 1 and 2.
ASKED = 3


def _kinds(by: int, values: list[str | None], at=None):
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), F.pmod(F.col("n") if at is None else at, F.lit(by)).cast("int"))


def documents(spark, sf) -> DataFrame:
    """Documents with what every second one says at its end: years, contract, pay and a tool."""
    d = table(spark, sf, "documents").filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("n"), F.coalesce("text", F.lit("")).alias("text"))
    years = (F.col("n") % 7 + 1).cast("int")
    facts = F.concat(F.lit("\nIl faut "), years.cast("string"), F.lit(" ans d'expérience en vente. Contrat : CDI. Salaire : 987654 € brut. Vous utilisez Zubrowka."))
    item = F.nullif(F.regexp_extract(F.substring("text", 1, 40), "[A-Za-z]{5,}", 0), F.lit(""))
    return d.withColumns({"years": years, "item": item, "quote": F.substring("text", 1, 40), "text": F.concat("text", F.when(F.col("n") % 2 == 0, facts).otherwise(""))})


def answers(d: DataFrame) -> DataFrame:
    """One JSON answer per three documents; some elements lack a field or hold one of a wrong type, some answers are no JSON."""
    c, lit = F.col, F.lit
    text = lambda v: F.to_json(F.struct(v.alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(v.alias("v")))) - 6)
    fields = [
        ("id", F.when(F.col("n") % 13 == 7, F.lit(None).cast("string")).otherwise(F.concat(lit('"o'), (F.col("n") % ASKED + 1).cast("string"), lit('"')))),
        ("correspondance", F.concat(lit('"'), _kinds(3, ["Métier visé", "passerelle", "Autre"], F.floor(F.col("n") / 3)), lit('"'))), ("secteur", F.concat(lit('"'), _kinds(4, ["prioritaire", "accepté", "à éviter", "autre"]), lit('"'))),
        ("secteur_prioritaire_concerne", lit('"Santé"')), ("secteur_evite_concerne", F.when((F.col("n") % 4 == 2) & c("item").isNotNull(), text(c("item"))).otherwise(lit("null"))), ("citation_secteur", text(c("quote"))),
        ("piege", F.when(F.col("n") % 5 == 0, '"Une vente déguisée"').otherwise(lit('"aucun"'))), ("score_interet", F.when(F.col("n") % 13 == 3, '"n/a"').otherwise(lit("80"))), ("score_chances", F.concat(lit('"'), ((F.col("n") % 6 + 3) * 10).cast("string"), lit('"'))),
        ("score_tremplin", lit("70")), ("pourquoi", lit('"**Un** poste proche"')), ("missions", F.when(F.col("n") % 13 == 5, '"Vendre"').otherwise(lit('["- Vendre", ""]'))),
        ("experience_demandee", lit('"des années"')), ("citation_experience", F.concat(lit('"Il faut '), c("years").cast("string"), lit(" ans d'expérience en vente\""))),
        ("contrat", _kinds(3, ['"cdi"', '"stage"', "null"])), ("citation_contrat", lit('"Contrat : CDI"')), ("salaire", lit('"987 654 €"')),
        ("competences", F.when(F.col("n") % 13 == 9, '{"nom":"Zubrowka"}').otherwise(lit('[{"nom":"Zubrowka","type":"outil"},{"nom":"Wxyzzq","type":"outil"}]'))),
    ]
    element = F.concat(lit("{"), F.array_join(F.array_compact(F.array(*[F.concat(lit(f'"{k}":'), v) for k, v in fields])), ","), lit("}"))
    asked = d.select("n", F.floor(F.col("n") / ASKED).alias("q"), element.alias("element"))
    grouped = asked.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("n", "element"))).alias("e"))
    body = F.concat(lit('{"resultats":['), F.array_join(F.transform("e", lambda x: x["element"]), ","), F.when(F.col("q") % 17 == 4, "").otherwise(lit("]}")))
    places = F.transform(F.sequence(F.lit(0), F.lit(ASKED - 1)), lambda k: F.col("q") * ASKED + k)
    return grouped.select(lit("u1").alias("user_id"), lit("p1").alias("profile_id"), body.alias("answer"), places.alias("offer_ids"))


_RULES = r"""d AS (SELECT doc_id AS n, coalesce(text, '') AS text, doc_id % 7 + 1 AS years, nullif(regexp_extract(substr(coalesce(text, ''), 1, 40), '[A-Za-z]{5,}'), '') AS item FROM documents WHERE doc_id IS NOT NULL),
    full_questions AS (SELECT n // 3 AS q, count(*) AS asked FROM d GROUP BY 1),
    r AS (SELECT d.*, CASE WHEN (n // 3) % 17 = 4 THEN 'resultats' WHEN n % 13 = 7 THEN 'id' WHEN n % 13 = 3 THEN 'score_interet' WHEN n % 13 = 5 THEN 'missions' WHEN n % 13 = 9 THEN 'competences' END AS refused FROM d)"""


@query("verdicts_refused", f"WITH {_RULES} SELECT refused AS field, count(DISTINCT CASE WHEN refused = 'resultats' THEN n // 3 ELSE n END) AS n FROM r WHERE refused IS NOT NULL GROUP BY 1")
def verdicts_refused(spark, sf):
    """Elements set apart, by the field that spoils them; their neighbours in the answer are kept."""
    return V.parse_verdicts(answers(documents(spark, sf)))[1].groupBy("field").agg(F.count("*").alias("n"))


@query("verdict_rows", f"""WITH {_RULES},
    f AS (SELECT *, n % 2 = 0 AS written, CASE WHEN n % 5 <> 4 THEN n % 6 END AS known, (n % 6 + 3) * 10 AS chances, n % 5 = 0 AS trap, (n // 3) % 3 AS match,
      CASE n % 4 WHEN 0 THEN 'prioritaire' WHEN 1 THEN 'accepte' WHEN 2 THEN CASE WHEN item IS NOT NULL THEN 'a_eviter' ELSE 'autre' END ELSE 'autre' END AS sector FROM r WHERE refused IS NULL),
    g AS (SELECT *, CASE WHEN known IS NULL AND written THEN years END AS found FROM f),
    l AS (SELECT *, CASE WHEN sector = 'a_eviter' THEN 'ecartee' WHEN trap AND match = 1 THEN 'tremplin' WHEN trap THEN 'ecartee' WHEN match = 2 THEN 'ecartee' WHEN match = 1 THEN 'tremplin'
      WHEN chances >= 50 AND (sector = 'prioritaire' OR coalesce(coalesce(known, found) <= 2, false)) THEN 'coeur' ELSE 'solide' END AS level0, greatest(0, coalesce(known, 0) - 2, coalesce(found, 0) - 2) AS gap FROM g),
    s AS (SELECT *, coalesce(found - 2 >= 4, false) AS shut FROM l)
    SELECT n, CASE WHEN shut THEN 'ecartee' WHEN level0 = 'coeur' AND gap >= 2 THEN 'solide' ELSE level0 END AS level,
      CASE WHEN shut THEN found || ' ans d''expérience demandés, 2 de ton côté.' WHEN level0 <> 'ecartee' THEN NULL WHEN sector = 'a_eviter' THEN 'Secteur que tu as choisi d''éviter.' WHEN trap THEN 'Une vente déguisée' ELSE 'Un poste proche' END AS reason,
      CAST(CASE WHEN shut THEN chances ELSE least(chances, CASE WHEN gap <= 0 THEN 100 WHEN gap <= 2 THEN 100 - gap * 20 ELSE 35 END) END AS INTEGER) AS chances,
      CASE WHEN level0 = 'ecartee' THEN 30 WHEN level0 = 'tremplin' THEN 55 ELSE 80 END AS interest,
      CASE WHEN written AND n % 3 = 0 THEN 'cdi' END AS contract, CASE WHEN written THEN '987 654 €' END AS salary, CASE WHEN written THEN 'Zubrowka' ELSE '' END AS skills,
      CASE WHEN coalesce(known, found) IS NULL THEN NULL WHEN coalesce(known, found) = 0 THEN 'Débutant accepté' WHEN coalesce(known, found) = 1 THEN '1 an et plus' ELSE coalesce(known, found) || ' ans et plus' END AS experience FROM s""")
def verdict_rows(spark, sf):
    """Final rows of answers: level, reason, scores and the facts that the posting itself bears out."""
    d = documents(spark, sf)
    none, words = F.lit(None).cast("string"), F.array().cast("array<string>")
    pairs = d.select(
        F.lit("p1").alias("profile_id"), F.col("n").alias("offer_id"), "text", F.lit("Vendeur").alias("title"), F.when(F.col("n") % 5 != 4, F.col("n") % 6).cast("double").alias("experience_min_years"), none.alias("experience_level"),
        F.lit(False).alias("excerpt"), F.array_compact(F.array("item")).alias("sectors_avoid"), F.array(F.lit("Santé")).alias("sectors_priority"), words.alias("deal_breakers"), F.lit(True).alias("open_sectors"),
        F.lit(2.0).alias("experience_years"), F.lit(False).alias("favorite"), F.lit(True).alias("title_match"), F.lit(False).alias("names_role"), F.lit("unknown").alias("contract"), F.array(F.lit("cdi"), F.lit("stage")).alias("contracts"),
        F.greatest(F.lit(0.0), F.when(F.col("n") % 5 != 4, F.col("n") % 6).cast("double") - 2).alias("gap"), words.alias("role_cores"),
    )
    rows, _refused = after_model(answers(d), pairs)
    return rows.select(
        F.col("offer_id").alias("n"), "level", F.col("excluded_reason").alias("reason"), F.col("score_chances").alias("chances"), F.col("score_interet").alias("interest"), F.col("contract_found").alias("contract"), "salary",
        F.array_join(F.transform("skills", lambda s: s["name"]), ",").alias("skills"), F.col("experience_asked").alias("experience"),
    )


@query("learned_facts", f"""WITH {_RULES}, f AS (SELECT *, n % 2 = 0 AS written FROM r WHERE refused IS NULL)
    SELECT d.n, CASE WHEN d.n % 5 <> 4 THEN d.n % 6 WHEN f.written THEN d.years END AS years, CASE WHEN f.written AND d.n % 3 = 0 THEN 'cdi' ELSE 'unknown' END AS contract,
      CASE WHEN d.n % 4 = 1 THEN 'Known' WHEN f.written THEN 'Zubrowka' ELSE '' END AS skills FROM d LEFT JOIN f ON f.n = d.n""")
def learned_facts(spark, sf):
    """Years, contract and skills read in verdicts, written on offers that lack them."""
    d = documents(spark, sf)
    good, _ = V.parse_verdicts(answers(d))
    both = good.join(d.select(F.col("n").alias("offer_id"), "text", (F.col("n") % 5 == 4).alias("open"), (F.col("n") % 6).cast("double").alias("y")), "offer_id")
    words = F.array().cast("array<string>")
    checked = V.check_verdicts(both.withColumns({
        "title": F.lit("Vendeur"), "experience_min_years": F.when(~F.col("open"), F.col("y")), "experience_level": F.lit(None).cast("string"), "excerpt": F.lit(False), "sectors_avoid": words, "sectors_priority": words,
        "deal_breakers": words, "open_sectors": F.lit(True), "experience_years": F.lit(2.0), "favorite": F.lit(False), "title_match": F.lit(True), "names_role": F.lit(False),
    }))
    none = F.array().cast("array<struct<name:string,kind:string>>")
    known = F.array(F.struct(F.lit("Known").alias("name"), F.lit("outil").alias("kind")))
    offers = d.select(F.col("n").alias("offer_id"), F.when(F.col("n") % 5 != 4, F.col("n") % 6).cast("double").alias("experience_min_years"), F.lit("unknown").alias("contract"), F.lit(None).cast("string").alias("seniority_estimate"), F.when(F.col("n") % 4 == 1, known).otherwise(none).alias("skills"))
    out = V.learn_facts(offers, checked)
    return out.select(F.col("offer_id").alias("n"), F.col("experience_min_years").alias("years"), "contract", F.array_join(F.transform("skills", lambda s: s["name"]), ",").alias("skills"))


@query("criteria_read", """SELECT doc_id AS n, CASE WHEN doc_id % 7 IN (3, 5) THEN NULL ELSE coalesce(nullif(trim(source), ''), '') END AS role, CASE WHEN doc_id % 7 IN (3, 5) THEN NULL WHEN doc_id % 7 = 1 THEN 'exceptional' ELSE 'never' END AS out_of_zone,
    CASE WHEN doc_id % 7 IN (3, 5) THEN NULL WHEN doc_id % 7 = 2 THEN 0 ELSE 1 END AS zones, CASE WHEN doc_id % 7 IN (3, 5) THEN NULL ELSE 50 END AS openness FROM documents WHERE doc_id IS NOT NULL""")
def criteria_read(spark, sf):
    """Searches as JSON: defaults filled in, wrong places left out, what is out of range or no JSON refused."""
    d = table(spark, sf, "documents").filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("n"), F.coalesce("source", F.lit("")).alias("source"))
    zone = F.struct(F.array(F.struct(F.lit("Lyon").alias("label"), F.when(F.col("n") % 7 == 2, "planet").otherwise("city").alias("kind"), F.lit("fr").alias("country"))).alias("places"))
    body = F.to_json(F.struct(F.array(F.concat(F.lit(" "), "source", F.lit(" ")), F.lit("")).alias("targetRoles"), zone.alias("zone"), F.when(F.col("n") % 7 == 1, "exceptional").alias("outOfZone"), F.when(F.col("n") % 7 == 3, 400).alias("openness")))
    c = parse_criteria(F.when(F.col("n") % 7 == 5, F.lit("{not json")).otherwise(body))
    read = d.select("n", c.alias("c"))
    return read.select("n", F.when(F.col("c").isNotNull(), F.array_join("c.target_roles", ",")).alias("role"), F.col("c.out_of_zone").alias("out_of_zone"), F.when(F.col("c").isNotNull(), F.size("c.zone_places")).alias("zones"), F.col("c.openness").alias("openness"))
