"""Composed queries over the reading tables: market of several roles, full sort, feed, CV batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacanta.plans import market as MK
from vacanta.plans import scoring as SC
from vacanta.plans import views as VW
from vacanta.rules import skills as KR
from vacanta.session import settle
from vacanta.workloads import sqltext as Q
from vacanta.workloads.binding import NOW, OFFERS, grams, ntz, offers, table, vocabulary, with_skills
from vacanta.workloads.demand import GROUPS, PRINT
from vacanta.workloads.people import ORDERS_NOW, applications, scores
from vacanta.workloads.registry import query

ROLES = [("p_de", ["und"]), ("p_es", ["los", "que"]), ("p_fr", ["pour"]), ("p_en", ["with"])]


def profiles(spark):
    return spark.createDataFrame([(p, r, []) for p, r in ROLES], "profile_id string, target_roles array<string>, title_variants array<string>")


def market_offers(spark, sf):
    n = F.length("text")
    return offers(spark, sf).withColumns({
        "contract": F.when(F.col("lang") == "de", "cdd").when(F.col("lang") == "es", "unknown").otherwise("cdi"), "remote": F.when(F.col("lang") == "fr", "hybrid").otherwise("unknown"),
        "experience_min_years": F.when(F.col("lang") != "en", F.floor(n / 1000)), "experience_level": F.lit(None).cast("string"),
        "salary_text": F.concat((F.lit(20) + F.floor(n / 1000)).cast("string"), F.lit(" k€ brut par an")),
    })


_ROLE_SQL = "r AS (SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{w}')" for p, words in ROLES for w in words) + ") t(profile_id, role))"
_BASE = f"""WITH {OFFERS}, {_ROLE_SQL}, a AS (SELECT *, string_split_regex({Q.fold('title')}, '[^a-z0-9+#]+') AS w FROM offers WHERE posted_at <= TIMESTAMP '{NOW}' AND (archived_at IS NULL OR archived_at > TIMESTAMP '{NOW}') AND NOT (engine_only AND length(text) < 1200)),
n AS (SELECT DISTINCT profile_id, a.* FROM a JOIN r ON list_contains(w, role)),
base AS (SELECT *, CASE WHEN lang <> 'en' THEN floor(length(text) / 1000) END AS y, 20 + floor(length(text) / 1000) AS k, CASE lang WHEN 'de' THEN 'cdd' WHEN 'es' THEN 'unknown' ELSE 'cdi' END AS contract FROM n QUALIFY row_number() OVER (PARTITION BY profile_id, {PRINT} ORDER BY engine_only, offer_id) = 1)"""


@query("market_base", f"{_BASE} SELECT profile_id, offer_id FROM base")
def market_base(spark, sf):
    return MK.market_base(market_offers(spark, sf), profiles(spark), ntz(NOW))[0].select("profile_id", "offer_id")


@query("market_picture", f"""{_BASE} SELECT profile_id, 'total' AS section, '' AS label, count(*) AS n FROM base GROUP BY 1 UNION ALL SELECT profile_id, 'new', '', count(*) FILTER (WHERE posted_at > TIMESTAMP '{NOW}' - INTERVAL 7 DAY) FROM base GROUP BY 1
    UNION ALL SELECT profile_id, 'experience', CASE WHEN y IS NULL THEN 'Non précisée' WHEN y <= 1 THEN '0 à 1 an' WHEN y < 3 THEN '2 ans' WHEN y < 5 THEN '3 à 4 ans' ELSE '5 ans et plus' END, count(*) FROM base GROUP BY 1, 3
    UNION ALL SELECT profile_id, 'contract', contract, count(*) FROM base WHERE contract <> 'unknown' GROUP BY 1, 3
    UNION ALL SELECT profile_id, 'median', '', CASE WHEN count(*) >= 5 THEN list_sort(list(k))[CAST(floor(0.5 * (count(*) - 1)) AS INTEGER) + 1] END FROM base WHERE y >= 3 GROUP BY 1""")
def market_picture(spark, sf):
    base = settle(MK.market_base(market_offers(spark, sf), profiles(spark), ntz(NOW))[0])
    c = MK.market_counts(base, ntz(NOW))
    row = lambda df, section, label, n: df.select("profile_id", F.lit(section).alias("section"), label.alias("label"), n.cast("double").alias("n"))
    none = F.lit("")
    out = row(c["totals"], "total", none, F.col("total")).union(row(c["totals"], "new", none, F.col("new_this_week"))).union(row(c["experience"], "experience", F.col("label"), F.col("count")))
    return out.union(row(c["contracts"], "contract", F.col("contract"), F.col("count"))).union(row(c["experienced_pay"], "median", none, F.col("median")))


@query("market_skills")
def market_skills(spark, sf):
    """Skills asked per role with their wishes (the per-role form of market_skill_demand)."""
    o = market_offers(spark, sf)
    # Read for the ids, the phrases and the number of texts.
    base = settle(MK.market_base(o, profiles(spark), ntz(NOW))[0].select("profile_id", "offer_id", "text"))
    return MK.market_skills(base, vocabulary(with_skills(o)), k=12).select("profile_id", "key", "kind", "count", "bonus", "share")


HISTORY = ["2024-02-03", "2024-02-10", "2024-02-17", "2024-02-24", "2024-03-02", "2024-03-09", "2024-03-30"]
_HISTORY = f"""WITH {OFFERS}, {_ROLE_SQL}, days AS (SELECT unnest([{", ".join(f"DATE '{d}'" for d in HISTORY)}]) AS day),
a AS (SELECT days.day, o.*, string_split_regex({Q.fold('title')}, '[^a-z0-9+#]+') AS w FROM offers o, days WHERE posted_at <= day + INTERVAL 12 HOUR AND (archived_at IS NULL OR archived_at > day + INTERVAL 12 HOUR) AND NOT (engine_only AND length(text) < 1200)),
b AS (SELECT DISTINCT profile_id, day, offer_id, engine_only, {PRINT} AS print, length(text) > 300 AS long FROM a JOIN r ON list_contains(w, role)),
base AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY profile_id, day, print ORDER BY engine_only, offer_id) = 1),
texts AS (SELECT offer_id, text FROM offers WHERE offer_id IN (SELECT offer_id FROM base WHERE long)), {GROUPS}, {grams('texts')},
c AS (SELECT profile_id, day, form AS key, count(*) AS count FROM base JOIN grams USING (offer_id) JOIN vocab ON form = vocab.key WHERE long GROUP BY ALL HAVING count(*) >= 2),
s AS (SELECT profile_id, day, count(*) AS read FROM base WHERE long GROUP BY ALL)
SELECT profile_id, strftime(day, '%Y-%m-%d') AS day, key, count, {Q.half_up('100.0 * count / read')} AS share FROM c JOIN s USING (profile_id, day) JOIN vocab USING (key)
WHERE NOT (NOT contains(key, ' ') AND key NOT IN {Q.one_of(KR.SHORT_SKILLS)} AND extracted / count < 0.06 AND extracted < 15)"""


@query("market_history", _HISTORY)
def market_history(spark, sf):
    """Skills of seven past days per role: one job, equal to the market counted day by day."""
    o = market_offers(spark, sf)
    out = MK.rebuild_history(o, profiles(spark), vocabulary(with_skills(o)), HISTORY)
    return out.select("profile_id", F.col("day").cast("string").alias("day"), "key", "count", "share")


@query("tracking_todo", f"SELECT o_custkey AS user_id, count(*) FILTER (WHERE (o_orderstatus = 'P' AND CASE WHEN o_orderpriority = '5-LOW' THEN o_orderdate + INTERVAL 3 DAY ELSE o_orderdate END <= TIMESTAMP '{ORDERS_NOW}' - INTERVAL 7 DAY) OR (o_orderpriority = '1-URGENT' AND o_orderdate + INTERVAL 10 DAY > TIMESTAMP '{ORDERS_NOW}')) AS todo FROM orders GROUP BY 1")
def tracking_todo(spark, sf):
    cust = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("company_id"))
    o = scores(spark, sf).join(cust, "user_id").select("offer_id", "company_id")
    c = table(spark, sf, "nation").select(F.col("n_nationkey").alias("company_id"), F.col("n_name").alias("domain"), F.lit(None).cast("string").alias("brand"))
    return VW.tracking(applications(spark, sf), o, c, ORDERS_NOW)["todo"]


_SORT = f"""WITH {OFFERS}, {_ROLE_SQL}, o AS (SELECT *, string_split_regex({Q.fold('title')}, '[^a-z0-9+#]+') AS w, CASE WHEN lang <> 'en' THEN floor(length(text) / 1000) END AS y, offer_id % 5 = 0 AS newer FROM offers WHERE archived_at IS NULL OR archived_at > TIMESTAMP '{NOW}'),
    pairs AS (SELECT p.profile_id, o.*, EXISTS (SELECT 1 FROM r WHERE r.profile_id = p.profile_id AND list_contains(w, role)) AS named FROM o, (SELECT DISTINCT profile_id FROM r) p),
    firsts AS (SELECT *, CASE WHEN lang = 'en' THEN 'Hors de ta zone de recherche.' WHEN lang = 'de' THEN 'CDD, un type de contrat que tu n''as pas retenu.'
      WHEN y - 1 >= 4 THEN 'N ans d''expérience demandés, N de ton côté.' WHEN contains(company_id, 'src7') THEN company_id || ' fait partie des entreprises que tu évites.'
      WHEN NOT named AND NOT (profile_id = 'p_fr' AND company_id = 'src9' AND length(text) > 200) THEN 'L''intitulé ne correspond à aucun de tes métiers ni de tes passerelles.' END AS reason FROM pairs),
    seconds AS (SELECT *, CASE WHEN reason IS NOT NULL THEN reason WHEN profile_id = 'p_es' AND offer_id % 3 = 1 THEN 'done' WHEN newer AND offer_id % 2 = 0 THEN 'gone' WHEN newer THEN 'N ans d''expérience demandés, N de ton côté.'
      WHEN engine_only AND length(text) < 1200 THEN 'Annonce incomplète : seul un extrait a pu être lu, et une offre n''est jamais jugée sans avoir été lue en entier.' ELSE 'candidate' END AS outcome FROM firsts)
    SELECT profile_id, regexp_replace(CASE WHEN profile_id = 'p_es' AND offer_id % 3 = 1 THEN 'done' ELSE outcome END, '[0-9]+', 'N', 'g') AS outcome, count(*) AS n FROM seconds GROUP BY ALL"""


def sort_tables(spark, sf):
    """Documents as offers, four people, one favourite, verdicts of a third of one person's pairs, and postings read again."""
    o = market_offers(spark, sf)
    none = F.lit(None).cast("string")
    country = F.when(F.col("lang") == "en", "GB").otherwise("FR")
    placed = o.withColumns({"places": F.array(F.struct(none.alias("city"), none.alias("region"), country.alias("country"))), "remote_scope": F.array().cast("array<string>"), "experience_min_years": F.col("experience_min_years").cast("int"), "archived_at": F.when(F.col("archived_at") <= ntz(NOW), F.col("archived_at"))})
    zone = F.array(F.struct(F.lit("France").alias("label"), F.lit("country").alias("kind"), F.lit("FR").alias("country")))
    empty = F.array().cast("array<string>")
    p = profiles(spark).withColumns({
        "bridge_roles": empty, "zone_places": zone, "remote_ok": F.lit(True), "out_of_zone": F.lit("never"), "contracts": F.array(F.lit("cdi")), "experience_years": F.lit(1), "companies_avoid": F.array(F.lit("src7")),
        "languages": F.array(F.lit("Français")), "criteria_version": F.lit(2), "judge_key": F.lit("k"),
    })
    fav = spark.createDataFrame([("p_fr", "src9")], "profile_id string, company_id string")
    done = placed.filter("offer_id % 3 = 1").select(F.lit("p_es").alias("profile_id"), "offer_id", F.lit("k").alias("judge_key"), F.lit(2).alias("criteria_version"), F.lit("bonne").alias("level"))
    # Every fifth posting was read again: gone, or asking for more experience.
    again = placed.filter("offer_id % 5 = 0").select("offer_id", "text", F.lit(9).alias("experience_min_years"), F.when(F.col("offer_id") % 2 == 0, ntz(NOW)).alias("archived_at"))
    return placed, p, fav, done, again


@query("sort_offers", _SORT)
def sort_offers(spark, sf):
    """Documents sorted for four people: gates, titles, second gate, excerpts, languages; outcomes add up to all pairs."""
    out = SC.before_model(*sort_tables(spark, sf))
    masked = lambda c: F.regexp_replace(c, r"\d+", "N")
    counted = out["counts"].select("profile_id", masked(F.col("reason")).alias("outcome"), "n")
    for rows, outcome in ((out["excluded"], masked(F.col("excluded_reason"))), *((out[k], F.lit(k.removesuffix("s"))) for k in ("candidates", "done", "gone", "reused"))):
        counted = counted.unionByName(rows.groupBy("profile_id", outcome.alias("outcome")).agg(F.count("*").alias("n")))
    return counted.groupBy("profile_id", "outcome").agg(F.sum("n").cast("bigint").alias("n"))


@query("cv_batch")
def cv_batch(spark, sf):
    """Turns read as CVs: redacted, scored, matched with the skills of titles."""
    t = table(spark, sf, "conversations")
    cvs = t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("cv_id"), "text", F.lit(1).alias("pages"), F.lit(0.0).alias("column_ratio"), F.lit(0).alias("spaced_titles"), F.lit("cv.pdf").alias("filename"), F.lit(1000).alias("size_bytes"), F.array(F.lit("the"), F.lit("les")).alias("expected"), F.array(F.col("role")).alias("known_names"))
    names = with_skills(offers(spark, sf)).select(F.explode("skills").alias("s")).select("s.name").distinct()
    return VW.analyse_cvs(cvs, names).select("cv_id", "total", "readability", "content", F.size("skills").alias("skills"))


