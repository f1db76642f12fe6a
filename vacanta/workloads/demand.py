"""Skill demand, duplicates and merges over whole documents read as postings."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacanta.columns import once
from vacanta.functions import lines as N
from vacanta.functions import cv as C
from vacanta.functions.text import company_key, fold, skill_key, slug
from vacanta.operators import dedup as D
from vacanta.operators import filters as X
from vacanta.operators import market as M
from vacanta.operators import skills as SK
from vacanta.rules import skills as KR
from vacanta.session import settle
from vacanta.sources import sinks
from vacanta.workloads import sqltext as Q
from vacanta.workloads.binding import ENGINE_SOURCES, LISTED, NOW, OFFERS, grams, ntz, offers, table, vocabulary, with_skills
from vacanta.workloads.registry import query

# Required and bonus lines of the reading texts: a heading is a short line without final punctuation; a
# line (or a heading) with one of these words is a wish.
WISH = r"\b(und|les|los|and)\b"
HEAD = r"\b(the|der|que|des)\b"
PRINT = f"sha256({Q.slug('text')})"

DEDUPED = f"""active AS (SELECT * FROM offers WHERE posted_at <= TIMESTAMP '{NOW}' AND (archived_at IS NULL OR archived_at > TIMESTAMP '{NOW}')),
base AS (SELECT * FROM active QUALIFY row_number() OVER (PARTITION BY {PRINT} ORDER BY engine_only, offer_id) = 1)"""

COUNTABLE = f"""k <> '' AND k NOT IN {Q.one_of(KR.TOO_GENERAL)} AND NOT {Q.matches('k', KR.NOT_SKILLS)} AND NOT (length(k) <= 2 AND k NOT IN {Q.one_of(KR.SHORT_SKILLS)})"""

GROUPS = f"""{LISTED},
spelled AS (SELECT k, name, kind, count(*) AS n, min(ord) AS ord FROM (
    SELECT {Q.skill_key('name')} AS k, name, kind, offer_id AS ord FROM listed) WHERE {COUNTABLE} GROUP BY ALL),
vocab AS (SELECT k AS key, sum(n) AS extracted FROM spelled GROUP BY k),
kinds AS (SELECT k AS key, kind FROM (SELECT k, kind, sum(n) AS n, min(ord) AS ord FROM spelled GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC, ord, kind) = 1)"""

REQUIRED_SQL = f"""lines AS (SELECT offer_id, unnest(list_filter(list_transform(string_split(text, chr(10)), lambda l: regexp_replace(l, '^\\s+|\\s+$', '', 'g')), lambda l: l <> '')) AS line,
           generate_subscripts(list_filter(list_transform(string_split(text, chr(10)), lambda l: regexp_replace(l, '^\\s+|\\s+$', '', 'g')), lambda l: l <> ''), 1) AS pos FROM {{src}}),
read AS (SELECT *, len(string_split_regex(line, '\\s+')) <= 9 AND NOT regexp_matches(line, '^[•*·-]') AND (regexp_matches(line, '[:：]\\s*$')
           OR (NOT regexp_matches(line, '[.!,;]$') AND {Q.matches(Q.fold('line'), HEAD)})) AS heading, {Q.matches(Q.fold('line'), WISH)} AS wish FROM lines),
held AS (SELECT *, last_value(CASE WHEN heading THEN wish END IGNORE NULLS) OVER (PARTITION BY offer_id ORDER BY pos) AS inside FROM read),
flagged AS (SELECT offer_id, pos, line, CASE WHEN heading THEN wish ELSE coalesce(inside, false) OR wish END AS bonus FROM held),
parts AS (SELECT offer_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT bonus), '') AS required,
                 coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE bonus), '') AS bonus FROM flagged GROUP BY offer_id)"""


def parts(df):
    return df.withColumn("r", N.split_requirements(F.col("text"), bonus=WISH, section_words=HEAD, plus=WISH)).withColumns({"required": F.col("r.required"), "bonus_text": F.col("r.bonus")}).drop("r")


@query("active_offers", f"WITH {OFFERS}, {DEDUPED} SELECT offer_id, source FROM active")
def active_offers(spark, sf):
    return X.active_at(offers(spark, sf), ntz(NOW)).select("offer_id", "source")


@query("dedup_exact_text", f"WITH {OFFERS}, {DEDUPED} SELECT offer_id, engine_only FROM base")
def dedup_exact_text(spark, sf):
    return D.dedup_texts(X.active_at(offers(spark, sf), ntz(NOW))).select("offer_id", "engine_only")


@query(
    "dedup_batch",
    f"""WITH {OFFERS} SELECT offer_id, dedup_key FROM (SELECT offer_id, company_id || '|' || {Q.slug('title')} AS dedup_key, text FROM offers)
        QUALIFY row_number() OVER (PARTITION BY dedup_key ORDER BY length(text) DESC, offer_id) = 1""",
)
def dedup_batch(spark, sf):
    o = offers(spark, sf).withColumn("dedup_key", F.concat("company_id", F.lit("|"), slug(F.col("title")))).withColumn("ordinal", F.col("offer_id"))
    return D.dedup_batch(o).select("offer_id", "dedup_key")


@query(
    "merge_engine_copies",
    f"""WITH {OFFERS}, keyed AS (SELECT offer_id, engine_only, length(text) AS n, {Q.slug('title')} AS t, {PRINT} AS p FROM offers)
        SELECT offer_id FROM keyed c WHERE engine_only AND n >= 1200 AND EXISTS (SELECT 1 FROM keyed o WHERE NOT o.engine_only AND o.t = c.t AND o.p = c.p)
          AND offer_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')""",
)
def merge_engine_copies(spark, sf):
    followed = table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("offer_id"))
    return D.merge_engine_copies(offers(spark, sf), followed)


def state_and_batch(spark, sf):
    """Engine documents as the known table, the others as the new batch; one key per slugged title."""
    o = offers(spark, sf).withColumn("dedup_key", slug(F.col("title"))).withColumn("ordinal", F.col("offer_id"))
    # One offer in three shows an image; the place is written as the language.
    details = {"company": F.col("source"), "location_raw": F.col("lang"), "image_url": F.when(F.col("offer_id") % 3 == 0, F.concat(F.lit("https://"), "source", F.lit("/image")))}
    o = o.withColumns(details)
    none = F.lit(None).cast("timestamp_ntz")
    url = F.concat(F.lit("https://"), "source", F.lit("/"), F.col("offer_id").cast("string"))
    state = D.dedup_batch(o.filter("engine_only")).select(
        "dedup_key", "title", "text", F.array(F.struct("source", url.alias("url"))).alias("urls"), F.array("source").alias("sources"), url.alias("apply_url"),
        F.col("posted_at").alias("published_at"), "first_seen_at", F.col("posted_at").alias("last_seen_at"), "archived_at", F.lit(0).alias("repost_count"), none.alias("reposted_at"), *details,
    )
    batch = D.dedup_batch(o.filter(~F.col("engine_only"))).select("dedup_key", "title", "text", F.col("source").alias("source_key"), url.alias("source_url"), url.alias("apply_url"), F.col("posted_at").alias("published_at"), *details)
    return state, batch


MERGED = f"""WITH {OFFERS}, keyed AS (SELECT *, {Q.slug('title')} AS dedup_key FROM offers),
s AS (SELECT * FROM keyed WHERE engine_only QUALIFY row_number() OVER (PARTITION BY dedup_key ORDER BY length(text) DESC, offer_id) = 1),
b AS (SELECT * FROM keyed WHERE NOT engine_only QUALIFY row_number() OVER (PARTITION BY dedup_key ORDER BY length(text) DESC, offer_id) = 1)
SELECT coalesce(b.dedup_key, s.dedup_key) AS dedup_key,
  md5(CASE WHEN b.dedup_key IS NULL THEN s.text WHEN s.dedup_key IS NULL OR length(b.text) >= length(s.text) THEN b.text ELSE s.text END) AS print,
  concat_ws(',', s.source, b.source) AS sources,
  CASE WHEN s.dedup_key IS NULL THEN 0 ELSE 1 END + CASE WHEN b.dedup_key IS NULL THEN 0 ELSE 1 END AS urls,
  CASE WHEN b.dedup_key IS NULL THEN 'https://' || s.source || '/' || s.offer_id ELSE 'https://' || b.source || '/' || b.offer_id END AS apply_url,
  CASE WHEN b.dedup_key IS NULL THEN strftime(s.archived_at, '%Y-%m-%d') END AS archived,
  CASE WHEN b.dedup_key IS NOT NULL AND TIMESTAMP '{NOW}' - s.archived_at > INTERVAL 2 DAY AND b.posted_at - s.posted_at > INTERVAL 2 DAY THEN 1 ELSE 0 END AS reposts,
  coalesce(b.source, s.source) AS company, CASE WHEN b.dedup_key IS NOT NULL THEN b.lang ELSE s.lang END AS place,
  coalesce(CASE WHEN b.offer_id % 3 = 0 THEN 'https://' || b.source || '/image' END, CASE WHEN s.offer_id % 3 = 0 THEN 'https://' || s.source || '/image' END) AS image
FROM s FULL OUTER JOIN b ON s.dedup_key = b.dedup_key"""


def merged_rows(offers):
    return offers.select(
        "dedup_key", F.md5("text").alias("print"), F.array_join("sources", ",").alias("sources"), F.size("urls").alias("urls"), "apply_url", F.date_format("archived_at", "yyyy-MM-dd").alias("archived"), F.col("repost_count").alias("reposts"),
        "company", F.col("location_raw").alias("place"), F.col("image_url").alias("image"),
    )


@query("merge_offers", MERGED)
def merge_offers(spark, sf):
    state, batch = state_and_batch(spark, sf)
    return merged_rows(D.merge_offers(state, batch, ntz(NOW)))


@query(
    "near_copy_titles",
    f"""WITH t AS (SELECT DISTINCT l_suppkey AS company_id, p_partkey AS offer_id, p_partkey % 2 = 0 AS engine_only, p_name || CASE WHEN p_size < 25 THEN ' bolt H/F - CDI Paris' ELSE '' END AS title
                   FROM lineitem JOIN part ON p_partkey = l_partkey),
        w AS (SELECT *, list_sort(list_distinct(list_filter(string_split_regex(regexp_replace({Q.fold('title')}, '{r"""\((?:h|f|x|m|n|w|d)(?:/(?:h|f|x|m|n|w|d))+\)|\b(?:h|f|x|m|n|w|d)(?:/(?:h|f|x|m|n|w|d))+\b"""}', ' ', 'g'), '[^a-z0-9]+'),
              lambda x: length(x) > 2 AND x NOT IN ('cdi', 'cdd', 'stage', 'alternance', 'paris', 'france', 'remote', 'hybride', 'supplier')))) AS words FROM t),
        e AS (SELECT DISTINCT company_id, words FROM w WHERE engine_only AND len(words) >= 2), o AS (SELECT DISTINCT company_id, words FROM w WHERE NOT engine_only AND len(words) >= 2),
        hit AS (SELECT DISTINCT e.company_id, e.words FROM e JOIN o ON e.company_id = o.company_id AND (list_has_all(o.words, e.words) OR list_has_all(e.words, o.words)))
        SELECT w.company_id, w.offer_id FROM w JOIN hit ON hit.company_id = w.company_id AND hit.words = w.words WHERE w.engine_only""",
)
def near_copy_titles(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("company_id"), F.col("l_partkey").alias("p_partkey")).distinct()
    j = li.join(table(spark, sf, "part"), "p_partkey")
    title = F.concat("p_name", F.when(F.col("p_size") < 25, " bolt H/F - CDI Paris").otherwise(""))
    items = j.select("company_id", F.struct("company_id", "p_partkey").alias("offer_id"), (F.col("p_partkey") % 2 == 0).alias("engine_only"), D.title_words(title, F.lit("Supplier")).alias("words"))
    return D.near_copies(items).select("offer_id.company_id", F.col("offer_id.p_partkey").alias("offer_id"))


@query(
    "ensure_companies",
    f"""WITH b AS (SELECT {Q.company_key("c_name || ' SAS'")} AS k, c_name || ' SAS' AS name FROM customer), s AS (SELECT {Q.company_key("replace(s_name, 'Supplier', 'Customer')")} AS k FROM supplier)
        SELECT k AS name_key, min(name) AS name FROM b WHERE k NOT IN (SELECT k FROM s) GROUP BY 1""",
)
def ensure_companies(spark, sf):
    known = table(spark, sf, "supplier").select(company_key(F.regexp_replace("s_name", "Supplier", "Customer")).alias("name_key"))
    batch = table(spark, sf, "customer").select(F.concat("c_name", F.lit(" SAS")).alias("company"))
    return D.ensure_companies(batch, known)[0]


@query("union_feeds", f"WITH {OFFERS}, {DEDUPED} SELECT 'engine' AS feed, count(*) AS n, sum(length(text)) AS chars FROM offers WHERE engine_only UNION ALL SELECT 'own', count(*), sum(length(text)) FROM offers WHERE NOT engine_only")
def union_feeds(spark, sf):
    from vacanta.sources.feeds import union_feeds as union

    o = offers(spark, sf)
    both = union(o.filter("engine_only").withColumn("feed", F.lit("engine")), o.filter(~F.col("engine_only")).drop("sources").withColumn("feed", F.lit("own")))
    return both.groupBy("feed").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("excerpt_only", f"WITH {OFFERS} SELECT offer_id FROM offers WHERE engine_only AND length(text) < 1200")
def excerpt_only(spark, sf):
    return X.excerpt_only(offers(spark, sf)).select("offer_id")


@query("stale_offers", f"WITH {OFFERS} SELECT source, count(*) AS n FROM offers WHERE engine_only AND posted_at < TIMESTAMP '{NOW}' - INTERVAL 60 DAY GROUP BY 1")
def stale_offers(spark, sf):
    o = X.engine_only(offers(spark, sf), ENGINE_SOURCES)
    return o.filter(X.is_stale(F.col("posted_at"), F.lit(True), ntz(NOW))).groupBy("source").agg(F.count("*").alias("n"))


@query("offers_by_source", f"WITH {OFFERS} SELECT source, count(*) AS n FROM offers WHERE archived_at IS NULL GROUP BY 1")
def offers_by_source(spark, sf):
    return M.offers_by_source(offers(spark, sf).withColumn("sources", F.array(F.concat("source", F.lit(":board")))))


@query("recheck_queue", f"WITH {OFFERS} SELECT offer_id FROM (SELECT offer_id, CASE WHEN lang = 'fr' THEN NULL ELSE posted_at END AS c FROM offers WHERE engine_only AND archived_at IS NULL) WHERE c IS NULL OR c < TIMESTAMP '{NOW}' - INTERVAL 3 DAY")
def recheck_queue(spark, sf):
    o = offers(spark, sf).withColumn("completed_at", F.when(F.col("lang") != "fr", F.col("posted_at")))
    return M.recheck_queue(o, ntz(NOW)).select("offer_id")


@query("purge_texts", f"WITH {OFFERS} SELECT source, count(*) AS n, count(*) FILTER (WHERE archived_at IS NULL OR archived_at >= TIMESTAMP '{NOW}' - INTERVAL 60 DAY) AS texts FROM offers GROUP BY 1")
def purge_texts(spark, sf):
    p = sinks.purge_texts(offers(spark, sf), ntz(NOW))
    return p.groupBy("source").agg(F.count("*").alias("n"), F.count("text").alias("texts"))


@query("showcase_offers", f"WITH {OFFERS} SELECT offer_id FROM offers WHERE NOT engine_only AND posted_at > TIMESTAMP '{NOW}' - INTERVAL 14 DAY AND length(title) < 60 AND NOT coalesce(length(regexp_replace(title, '[^A-ZÀ-Þ]', '', 'g')) / nullif(length(regexp_replace(title, '[^A-Za-zÀ-ÿ]', '', 'g')), 0) > 0.6, false)")
def showcase_offers(spark, sf):
    return X.showcase(offers(spark, sf), ntz(NOW)).select("offer_id")


@query("search_titles", f"WITH {OFFERS} SELECT offer_id FROM offers WHERE contains({Q.fold('title')}, 'reau')")
def search_titles(spark, sf):
    return X.search(offers(spark, sf), " RÉAU ", "title").select("offer_id")


@query("skill_vocabulary", f"WITH {OFFERS}, {LISTED} SELECT DISTINCT name FROM listed")
def skill_vocabulary(spark, sf):
    return SK.skill_vocabulary(with_skills(offers(spark, sf)))


@query("skill_groups", f"WITH {OFFERS}, {GROUPS} SELECT v.key, kind, extracted FROM vocab v JOIN kinds USING (key)")
def skill_groups(spark, sf):
    return SK.skill_groups(vocabulary(with_skills(offers(spark, sf)))).select("key", "kind", "extracted")


@query(
    "top_skills",
    f"""WITH {OFFERS}, {LISTED}, k AS (SELECT DISTINCT offer_id, {Q.skill_key('name')} AS key FROM listed WHERE {Q.skill_key('name')} <> ''),
        f AS (SELECT {Q.skill_key('name')} AS key, arg_min(kind, offer_id * 10 + CASE WHEN kind = 'outil' THEN 0 ELSE 1 END) AS kind FROM listed GROUP BY 1),
        c AS (SELECT key, count(*) AS count FROM k GROUP BY 1 HAVING count(*) >= 2), r AS (SELECT count(DISTINCT offer_id) AS read FROM listed)
        SELECT key, kind, count, {Q.half_up('100.0 * count / read')} AS share FROM c JOIN f USING (key), r QUALIFY row_number() OVER (PARTITION BY kind ORDER BY count DESC, key) <= 8""",
)
def top_skills(spark, sf):
    return SK.top_skills(with_skills(offers(spark, sf))).select("key", "kind", "count", "share")


_DEMAND = f"""WITH {OFFERS}, {DEDUPED}, {GROUPS}, {grams('base')},
hits AS (SELECT offer_id, form AS key FROM grams JOIN vocab ON form = key),
counted AS (SELECT key, count(*) AS count FROM hits GROUP BY 1 HAVING count(*) >= 2),
kept AS (SELECT * FROM counted JOIN vocab USING (key) JOIN kinds USING (key), (SELECT count(*) AS read FROM base)
         WHERE NOT (NOT contains(key, ' ') AND key NOT IN {Q.one_of(KR.SHORT_SKILLS)} AND extracted / count < 0.06 AND extracted < 15))"""


def _demand(spark, sf):
    o = with_skills(offers(spark, sf))
    # Read twice below, for the phrases and for the number of texts.
    base = settle(D.dedup_texts(X.active_at(offers(spark, sf), ntz(NOW))).select("offer_id", "text"))
    return base, SK.skill_demand(base, SK.skill_groups(vocabulary(o)))


@query("market_skill_demand", f"{_DEMAND} SELECT key, kind, count, {Q.half_up('100.0 * count / read')} AS share, rank FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY count DESC, key) AS rank FROM kept) WHERE rank <= 12")
def market_skill_demand(spark, sf):
    return SK.top_by_kind(_demand(spark, sf)[1], 12).select("key", "kind", "count", "share", "rank")


@query("skill_demand_counts", f"{_DEMAND} SELECT key, kind, count, {Q.half_up('100.0 * count / read')} AS share FROM kept")
def skill_demand_counts(spark, sf):
    return _demand(spark, sf)[1].select("key", "kind", "count", "share")


@query("requirements_split", f"WITH {OFFERS}, {REQUIRED_SQL.format(src='offers')} SELECT offer_id, md5(required) AS required, md5(bonus) AS bonus FROM parts")
def requirements_split(spark, sf):
    p = parts(offers(spark, sf))
    return p.filter((F.col("required") != "") | (F.col("bonus_text") != "")).select("offer_id", F.md5("required").alias("required"), F.md5("bonus_text").alias("bonus"))


_BONUS = f"""WITH {OFFERS}, {DEDUPED}, {GROUPS}, {REQUIRED_SQL.format(src='base')}, {grams('base')}, {grams('parts', text='required', name='gr')}, {grams('parts', text='bonus', name='gb')},
hits AS (SELECT g.offer_id, g.form AS key, b.form IS NOT NULL AND r.form IS NULL AS wished FROM grams g JOIN vocab ON g.form = key
         LEFT JOIN gr r ON r.offer_id = g.offer_id AND r.form = g.form LEFT JOIN gb b ON b.offer_id = g.offer_id AND b.form = g.form)
SELECT key, count(*) AS count, count(*) FILTER (WHERE wished) AS bonus FROM hits GROUP BY 1 HAVING count(*) >= 2"""


@query("skill_demand_bonus", _BONUS)
def skill_demand_bonus(spark, sf):
    o = with_skills(offers(spark, sf))
    # Read for the ids, the phrases and the number of texts.
    base = parts(settle(D.dedup_texts(X.active_at(offers(spark, sf), ntz(NOW))).select("offer_id", "text")))
    return SK.skill_demand(base, SK.skill_groups(vocabulary(o)), required="required", bonus="bonus_text", guard=False).select("key", "count", "bonus")


@query(
    "wishes",
    f"""WITH {OFFERS}, {LISTED}, {REQUIRED_SQL.format(src='offers')},
        n AS (SELECT DISTINCT offer_id, name FROM listed), t AS (SELECT offer_id, ' ' || {Q.skill_key('required')} || ' ' AS r, ' ' || {Q.skill_key('bonus')} || ' ' AS b FROM parts)
        SELECT offer_id, count(*) AS n FROM n JOIN t USING (offer_id) WHERE contains(b, ' ' || {Q.skill_key('name')} || ' ') AND NOT contains(r, ' ' || {Q.skill_key('name')} || ' ') GROUP BY 1""",
)
def wishes(spark, sf):
    """Skills an offer lists that only its bonus lines name."""
    # Offers without bonus lines wish for nothing: they leave before their names become rows.
    split = N.split_requirements(F.col("text"), bonus=WISH, section_words=HEAD, plus=WISH)
    p = once(offers(spark, sf).select("offer_id", "title", "text"), s=split).filter("s.bonus <> ''").select("offer_id", "title", F.col("s.required").alias("required"), F.col("s.bonus").alias("bonus_text"))
    keyed = lambda c: F.concat(F.lit(" "), skill_key(F.col(c)), F.lit(" "))
    p = once(with_skills(p), r=keyed("required"), b=keyed("bonus_text"))
    names = p.select("offer_id", "r", "b", F.explode(F.array_distinct(F.transform("skills", lambda s: s["name"]))).alias("name"))
    word = F.concat(F.lit(" "), skill_key(F.col("name")), F.lit(" "))
    return names.filter(F.contains("b", word) & ~F.contains("r", word)).groupBy("offer_id").agg(F.count("*").alias("n"))


_LINES = "list_filter(list_transform(string_split(text, chr(10)), lambda l: regexp_replace(l, '^\\s+|\\s+$', '', 'g')), lambda l: l <> '')"


@query(
    "text_blocks",
    f"""WITH {OFFERS}, l AS (SELECT offer_id, unnest({_LINES}) AS line, generate_subscripts({_LINES}, 1) AS pos FROM offers),
        a AS (SELECT *, starts_with(line, 'E') AS item, lead(line, 1, '') OVER (PARTITION BY offer_id ORDER BY pos) AS nxt, lag(starts_with(line, 'E'), 1, false) OVER (PARTITION BY offer_id ORDER BY pos) AS prev FROM l),
        b AS (SELECT *, CASE WHEN item THEN 'list' WHEN length(line) < 70 AND NOT regexp_matches(line, '[.;,!?]$') AND (ends_with(line, ':') OR starts_with(nxt, 'E')) THEN 'heading' ELSE 'paragraph' END AS kind,
                     sum(CASE WHEN item AND prev THEN 0 ELSE 1 END) OVER (PARTITION BY offer_id ORDER BY pos) AS block FROM a)
        SELECT offer_id, block - 1 AS block, min(kind) AS kind, count(*) AS lines FROM b GROUP BY offer_id, block""",
)
def text_blocks(spark, sf):
    """Blocks of every text; in these texts a line that starts with E stands for a bullet."""
    b = offers(spark, sf).select("offer_id", F.posexplode(N.text_blocks(F.col("text"), bullet="E")).alias("block", "b"))
    return b.select("offer_id", "block", "b.kind", F.coalesce(F.size("b.items"), F.lit(1)).alias("lines"))


_CV = f"turns AS (SELECT conv_id * 1000 + turn AS cv_id, text FROM conversations)"


def cvs(spark, sf):
    return table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("cv_id"), "text")


@query("cv_skills", f"WITH {OFFERS}, {GROUPS}, {_CV}, {grams('turns', 'cv_id', name='gc')}, s AS (SELECT DISTINCT {Q.skill_key('name')} AS k FROM listed) SELECT cv_id, count(*) AS n FROM gc JOIN s ON form = k WHERE k <> '' GROUP BY 1")
def cv_skills(spark, sf):
    names = SK.skill_vocabulary(with_skills(offers(spark, sf)))
    return SK.cv_skills(cvs(spark, sf), names).select("cv_id", F.size("skills").alias("n"))


# Keywords that test every branch of the rule: plurals, two words, alternatives, signs, a word that is in no text.
KEYWORDS = ["the", "Les", "und/and", "los que", "a / b", "the+", "zzz", "user/assistant/que", "con", "email/mail", "de la"]
_K_SQL = "k AS (SELECT unnest([" + ", ".join(f"'{k}'" for k in KEYWORDS) + "]) AS key)"
_AB = "regexp_replace({}, '(^|[^a-z0-9_])a\\s*/\\s*b($|[^a-z0-9_])', '\\1a/b\\2', 'g')"


@query(
    "present_missing",
    f"""WITH {_K_SQL}, {_CV}, n AS (SELECT cv_id, {_AB.format(Q.fold('text'))} AS n FROM turns),
        o AS (SELECT key, unnest(CASE WHEN contains({_AB.format('lower(key)')}, 'a/b') THEN [{_AB.format('lower(key)')}] ELSE string_split_regex({_AB.format('lower(key)')}, '\\s*/\\s*') END) AS alt FROM k),
        w AS (SELECT key, alt, unnest(list_filter(string_split_regex(alt, '[^a-z0-9+#/]+'), lambda x: length(x) >= 2)) AS word FROM o),
        s AS (SELECT key, alt, replace(CASE WHEN length(word) > 3 THEN regexp_replace(word, 's$', '') ELSE word END, '+', '\\+') AS stem FROM w),
        f AS (SELECT cv_id, key, alt, bool_and(regexp_matches(n, '(?:^|[^a-z0-9])' || stem || '(?:s|x|es|ing)?(?:$|[^a-z0-9])')) AS ok FROM n, s GROUP BY ALL),
        p AS (SELECT cv_id, key, bool_or(ok) AS ok FROM f GROUP BY ALL)
        SELECT cv_id, count(*) FILTER (ok) AS present, {len(KEYWORDS)} - count(*) FILTER (ok) AS missing, {Q.half_up(f'100.0 * count(*) FILTER (ok) / {len(KEYWORDS)}')} AS score FROM p GROUP BY cv_id""",
)
def present_missing(spark, sf):
    """Keywords present in each CV or missing from it, by equality of words with the keywords' forms."""
    words = spark.createDataFrame([(k,) for k in KEYWORDS], "key string")
    found = C.keywords_found(cvs(spark, sf), words).groupBy("cv_id").agg(F.count("*").alias("present"))
    j = cvs(spark, sf).select("cv_id").distinct().join(found, "cv_id", "left").fillna(0, ["present"]).withColumn("missing", len(KEYWORDS) - F.col("present"))
    return j.withColumn("score", F.floor(100 * F.col("present") / len(KEYWORDS) + 0.5).cast("int"))


@query(
    "top_skills_present",
    f"""{_DEMAND}, {_CV}, {grams('turns', 'cv_id', name='gc')}, top AS (SELECT key FROM kept ORDER BY count DESC, key LIMIT 12), p AS (SELECT turns.cv_id, top.key FROM turns, top)
        SELECT p.cv_id, count(gc.form) AS present, count(*) - count(gc.form) AS missing, {Q.half_up('100.0 * count(gc.form) / count(*)')} AS score
        FROM p LEFT JOIN gc ON gc.cv_id = p.cv_id AND gc.form = p.key GROUP BY p.cv_id""",
)
def top_skills_present(spark, sf):
    """The twelve skills asked most, present in each CV or missing from it."""
    # Read for the keys and for their forms: the market is counted once.
    top = settle(_demand(spark, sf)[1].orderBy(F.desc("count"), "key").limit(12).select("key"))
    listed = top.agg(F.array_sort(F.collect_list("key")).alias("keys"))
    found = SK.citing(cvs(spark, sf), settle(SK.forms_of(top)), "cv_id").groupBy("cv_id").agg(F.count("*").alias("present"))
    size = F.size(listed.select("keys").scalar())
    j = cvs(spark, sf).select("cv_id").join(found, "cv_id", "left").fillna(0, ["present"]).withColumn("missing", size - F.col("present"))
    return j.withColumn("score", F.floor(100 * F.col("present") / (F.col("present") + F.col("missing")) + 0.5).cast("int"))


@query("keyword_turns", f"SELECT conv_id, turn, {Q.matches(Q.fold('text'), '(?:^|[^a-z0-9])the(?:s|x|es|ing)?([^a-z0-9]|$)')} AND {Q.matches(Q.fold('text'), '(?:^|[^a-z0-9])and(?:s|x|es|ing)?([^a-z0-9]|$)')} OR {Q.matches(Q.fold('text'), '(?:^|[^a-z0-9])les(?:s|x|es|ing)?([^a-z0-9]|$)')} AS found FROM conversations")
def keyword_turns(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", C.has_keyword(fold(F.col("text")), F.lit("the and/les")).alias("found"))


@query(
    "mine",
    f"""{_DEMAND}, sel AS (SELECT offer_id FROM offers JOIN labels ON doc_id = offer_id WHERE quality = 1), {grams('offers', name='ga')},
        long AS (SELECT offer_id FROM offers WHERE length({Q.skill_key('text')}) + 2 > 300)
        SELECT key, count, count(s.offer_id) AS mine FROM kept LEFT JOIN (SELECT form, offer_id FROM ga JOIN sel USING (offer_id) JOIN long USING (offer_id)) s ON s.form = key GROUP BY key, count""",
)
def mine(spark, sf):
    selected = table(spark, sf, "labels").filter("quality = 1").select(F.col("doc_id").alias("offer_id"))
    selection = offers(spark, sf).join(selected, "offer_id", "left_semi")
    return SK.mine(_demand(spark, sf)[1].select("key", "count"), selection)


@query(
    "market_insights",
    f"""{_DEMAND}, shares AS (SELECT key, kind, count, {Q.half_up('100.0 * count / read')} AS share FROM kept),
        hard AS (SELECT *, row_number() OVER (ORDER BY share DESC, key) AS rank FROM shares WHERE count >= 3 AND kind IN ('outil', 'methode') AND share >= 5)
        SELECT key, share, rank, CASE WHEN length(key) > 6 THEN 'show' ELSE 'add' END AS list FROM hard WHERE rank <= 12""",
)
def market_insights(spark, sf):
    skills = _demand(spark, sf)[1].withColumn("in_cv", F.length("key") > 6).withColumn("bonus", F.lit(0))
    return SK.market_insights(skills).select("key", "share", "rank", "list")


@query("frozen_card", f"{_DEMAND} SELECT key, count, 0 AS mine, false AS in_cv FROM kept")
def frozen_card(spark, sf):
    skills = _demand(spark, sf)[1].withColumns({"mine": F.lit(3), "in_cv": F.lit(True)})
    return sinks.freeze_card(skills).select("key", "count", "mine", "in_cv")


@query("skill_trend", f"""{_DEMAND}, before AS (SELECT key, count(*) AS count FROM grams JOIN vocab ON form = key JOIN base USING (offer_id) WHERE posted_at <= TIMESTAMP '2024-03-01' GROUP BY 1)
    SELECT key, kept.count - before.count AS change FROM kept JOIN before USING (key) WHERE kept.count - before.count >= 3""")
def skill_trend(spark, sf):
    """Skills that moved by three offers or more since the first of the month."""
    o = offers(spark, sf)
    groups = settle(SK.skill_groups(vocabulary(with_skills(o))))
    base = settle(D.dedup_texts(X.active_at(o, ntz(NOW))).select("offer_id", "text", "posted_at"))
    now_ = SK.skill_demand(base, groups)
    hits = SK.cited_counts(base.filter(F.col("posted_at") <= ntz("2024-03-01")), groups, [], "offer_id").select("key", "count")
    moved = M.trend(now_.select("key", "count", F.col("count").alias("share")), hits.withColumn("share", F.col("count")), ["key"])
    return moved.filter("change > 0").select("key", "change")


