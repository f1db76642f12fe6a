"""Skill vocabulary and demand: grouping of spellings, phrases found in texts, counts, advice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vacanta.columns import half_up, once
from vacanta.functions import skills as K
from vacanta.functions.text import skill_key
from vacanta.operators.phrases import counted_runs, runs_in
from vacanta.rules import skills as R
from vacanta.session import BROADCAST_ROWS, broadcast_if_small, settle


def skill_vocabulary(offers: DataFrame, skills: str = "skills") -> DataFrame:
    return offers.select(F.explode(skills).alias("s")).select("s.name").distinct()


def skill_groups(vocab: DataFrame) -> DataFrame:
    """Spellings grouped under one key: key, name, kind, extracted.

    `vocab` holds name, kind and an `ord` that gives the reading order (ties keep the first). A key whose
    last word is neutral joins the key without it when that one exists.
    """
    # Names repeat from offer to offer: each is keyed once, after a first count.
    raw = vocab.groupBy("name", "kind").agg(F.count("*").alias("n"), F.min("ord").alias("ord"))
    shown = K.skill_name(F.col("name"), F.col("kind"))
    keyed = once(raw, shown=shown, own=K.canonical_skill(shown)).filter(K.is_countable_skill(F.col("own")))
    # Read several times below: kept once, as large as the vocabulary and no larger.
    spelled = settle(keyed.groupBy("own", F.col("shown").alias("name"), "kind").agg(F.sum("n").alias("n"), F.min("ord").alias("ord")))
    keys = spelled.groupBy("own").agg(F.min("ord").alias("ord"))
    target = folded_keys(keys)
    grouped = spelled.join(target, "own", "left").withColumn("key", F.coalesce("key", "own"))
    kinds = grouped.groupBy("key", "kind").agg(F.sum("n").alias("n"), F.min("ord").alias("ord"))
    kinds = kinds.groupBy("key").agg(F.max_by("kind", F.struct("n", -F.col("ord"))).alias("kind"), F.sum("n").alias("extracted"))
    names = grouped.groupBy("key", "own", "name").agg(F.sum("n").alias("n"), F.min("ord").alias("ord"))
    names = names.groupBy("key").agg(F.max_by("name", F.struct((F.col("own") == F.col("key")).alias("a"), F.col("n"), -F.col("ord"))).alias("name"))
    return kinds.join(names, "key").select("key", "name", "kind", "extracted")


def folded_keys(keys: DataFrame) -> DataFrame:
    """(own, key) of the keys that end in neutral words: the key each is read as, whatever the number of such words.

    `keys` holds own and ord. In reading order, a key joins the one without its last word if that one is still
    there; folded later, that one carries both further. The chain of a key is its own prefixes, so it is looked
    up in one join and followed from its end.
    """
    words = F.split("own", " ")
    # Neutral words at the end, the first word never being one of them.
    tail = F.aggregate(F.slice(words, F.lit(2), F.size(words)), F.lit(0), lambda n, w: F.when(w.isin(R.NEUTRAL), n + 1).otherwise(0))
    chains = keys.withColumn("w", words).withColumn("tail", tail).filter("tail > 0").select("own", "ord", "w", F.explode(F.sequence(F.lit(1), F.col("tail"))).alias("i"))
    prefixes = chains.select("own", "ord", "i", F.array_join(F.slice("w", F.lit(1), F.size("w") - F.col("i")), " ").alias("prefix"))
    there = prefixes.join(keys.select(F.col("own").alias("prefix"), F.col("ord").alias("at")), "prefix")
    step = F.struct("i", F.col("prefix").alias("key"), F.col("at").alias("ord"))
    chain = there.groupBy("own").agg(F.min("ord").alias("ord"), F.array_sort(F.collect_list(step)).alias("chain"))
    whole = F.concat(F.array(F.struct(F.lit(0).alias("i"), F.col("own").alias("key"), "ord")), "chain")
    unbroken = F.filter(F.transform(whole, lambda x, n: F.struct(x["i"].alias("i"), x["key"].alias("key"), x["ord"].alias("ord"), n.alias("n"))), lambda x: x["i"] == x["n"])
    start = F.struct(F.lit(None).cast("string").alias("root"), F.lit(False).alias("folded"), F.lit(None).cast("bigint").alias("ord"))

    def follow(last: Column, x: Column) -> Column:
        joins = last["root"].isNotNull() & ~(last["folded"] & (last["ord"] < x["ord"]))
        return F.struct(F.when(joins, last["root"]).otherwise(x["key"]).alias("root"), joins.alias("folded"), x["ord"].cast("bigint").alias("ord"))

    return chain.select("own", F.aggregate(F.reverse(unbroken), start, follow)["root"].alias("key"))


def longest_phrase(forms: DataFrame, form: str = "form") -> int:
    """Words of the longest phrase searched: one number, read once."""
    row = forms.agg(F.max(F.size(F.split(form, " "))).alias("n")).first()
    return int(row["n"] or 1)


def citing(texts: DataFrame, forms: DataFrame, id: str, text: str = "text", keyed: bool = False, max_words: int | None = None, max_rows: int = BROADCAST_ROWS, distinct: bool = True) -> DataFrame:
    """(id, key) once for every skill a text holds as whole words; with `distinct` off, once per spelling found.

    Runs of words are tested by their hashes first (`runs_in`); what is left is matched by equality of strings. A
    vocabulary of proven size is sent to the executors and the phrases never move; beyond that size both sides are
    shuffled. A text gives a phrase once, so the most common phrase has a row per text and no more: one of the many
    phrases of each, split by Spark if its share is large.
    """
    longest = max_words or longest_phrase(forms)
    words = F.col(text) if keyed else skill_key(F.col(text))
    ids = [id] if isinstance(id, str) else list(id)
    grams = runs_in(texts.select(*ids, words.alias("_words")), ids, "_words", forms, longest)
    found = grams.join(broadcast_if_small(forms.select("form", "key"), max_rows)[0], "form").select(*ids, "key")
    return found.distinct() if distinct else found


def cited_counts(texts: DataFrame, groups: DataFrame, by: list[str], id: str, text: str = "text", required: str | None = None, bonus: str | None = None, keyed: bool = False, known: DataFrame | None = None) -> DataFrame:
    """(by, key, count, bonus): texts that hold each skill, and those that wish for it, without a row per text and skill.

    Texts are counted per phrase where they are read and again per task, so what is shuffled are different phrases. Only
    phrases of skills with several spellings, and texts whose id comes more than once, are brought together by id:
    a text counts once per skill. Counts meet the vocabulary with one row per phrase on that side, so no key is hot.
    `known` holds at least the ids of the texts, where these cost less to read.
    """
    forms = settle(forms_of(groups))
    longest = longest_phrase(forms)
    spelled = forms.filter("form <> key").select("key").distinct()
    several = settle(forms.join(spelled, "key", "left_semi").select("form"))
    ids = [*by, id]
    repeated = settle((known or texts).groupBy(*ids).agg(F.count("*").alias("n")).filter("n > 1").select(*ids, F.lit(True).alias("_again")))
    # Null ids are one id, and meet nothing in a join.
    unknown = F.lit(False)
    for c in ids:
        unknown = unknown | F.col(c).isNull()
    shown = lambda c: F.col(c) if keyed else skill_key(F.col(c))
    parts = {"_full": shown(text), **({"_required": shown(required), "_bonus": shown(bonus)} if required and bonus else {})}
    marked = texts.join(broadcast_if_small(repeated)[0], ids, "left").withColumn("_again", F.coalesce("_again", F.lit(False)) | unknown)
    runs = counted_runs(marked.select(*ids, "_again", *[c.alias(n) for n, c in parts.items()]), by, id, "_again", list(parts), forms, several, longest)
    flags = ["full", "required", "bonus"]
    summed = runs.groupBy(*ids, "form", *flags).agg(F.sum("n").alias("n"), F.sum("wished").alias("wished"))
    # A text on its own has flags, a count has none.
    per_text = summed.join(forms, "form").groupBy(*ids, "key", F.col("n").isNull().alias("alone")).agg(*[F.max(F.col(c).cast("int")).alias(c) for c in flags], F.sum("n").alias("n"), F.sum("wished").alias("wished"))
    held, wish = F.when(F.col("alone"), F.col("full")).otherwise(F.col("n")), F.when(F.col("alone"), F.col("full") * F.col("bonus") * (1 - F.col("required"))).otherwise(F.col("wished"))
    return per_text.groupBy(*by, "key").agg(F.sum(held).cast("bigint").alias("count"), F.sum(wish).cast("bigint").alias("bonus")).filter("count > 0")


def forms_of(groups: DataFrame) -> DataFrame:
    return groups.select("key", F.explode(K.spellings(F.col("key"))).alias("form"))


def in_cv(groups: DataFrame, cv_text: str = "", cv_skills: list[str] | None = None) -> Column:
    """Whether a person's CV says the skill of column `key`: listed, or written word for word."""
    known = F.array_distinct(F.transform(F.array(*[F.lit(s) for s in cv_skills]), K.canonical_skill)) if cv_skills else F.array().cast("array<string>")
    text = F.concat(F.lit(" "), skill_key(F.lit(cv_text)), F.lit(" "))
    return F.array_contains(known, F.col("key")) | F.exists(K.spellings(F.col("key")), lambda f: F.contains(text, F.concat(F.lit(" "), f, F.lit(" "))))


def weighed(counted: DataFrame, sizes: DataFrame, groups: DataFrame, by: list[str], guard: bool = True) -> DataFrame:
    """Counts (by, key, count, bonus) with names, kinds and shares of the texts read (`sizes`: by, read); rare and common words left out."""
    joined = counted.filter(F.col("count") >= R.MIN_COUNT).join(groups, "key")
    joined = joined.join(sizes, by) if by else joined.withColumn("read", sizes.scalar())
    if guard:
        single = ~F.contains(F.col("key"), F.lit(" ")) & ~F.col("key").isin(R.SHORT_SKILLS)
        common = single & (F.col("extracted") / F.col("count") < R.COMMON_WORD_SHARE) & (F.col("extracted") < R.COMMON_WORD_EXTRACTIONS)
        joined = joined.filter(~common)
    share = half_up(100 * F.col("count") / F.greatest(F.lit(1), F.col("read"))).cast("int")
    return joined.select(*by, "key", "name", "kind", "count", "bonus", share.alias("share"))


def skill_demand(texts: DataFrame, groups: DataFrame, id: str = "offer_id", text: str = "text", required: str | None = None, bonus: str | None = None, market: str | None = None, guard: bool = True) -> DataFrame:
    """How many texts ask for each skill: key, name, kind, count, bonus, share, per market when given.

    `required` and `bonus` are the two parts of the text; a skill found only in the second is a wish.
    """
    by = [] if market is None else [market]
    groups = settle(groups)
    counted = cited_counts(texts, groups, by, id, text, required, bonus)
    sizes = texts.groupBy(*by).agg(F.count("*").alias("read"))
    return weighed(counted, sizes, groups, by, guard)


def top_by_kind(skills: DataFrame, k: int, within: list[str] | None = None) -> DataFrame:
    order = Window.partitionBy(*(within or []), "kind").orderBy(F.desc("count"), "key")
    return skills.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_skills(offers: DataFrame, k: int = 8, id: str = "offer_id", skills: str = "skills") -> DataFrame:
    """Skills listed by offers: one count per offer, spellings and qualified forms merged, at least two offers."""
    listed = offers.filter(F.size(skills) > 0).select(id, F.posexplode(skills).alias("at", "s"))
    named = listed.select(id, "at", F.col("s.kind").alias("kind"), K.skill_name(F.col("s.name"), F.col("s.kind")).alias("name"))
    keyed = named.withColumn("key", K.canonical_skill(F.col("name"))).filter("key <> ''")
    # One line per spelling, as large as the vocabulary: kept once for the three uses below.
    spelled = settle(keyed.groupBy("key", "name", "kind").agg(F.count("*").alias("n"), F.min(F.struct(id, "at")).alias("o")))
    first = spelled.groupBy("key").agg(F.min_by("kind", "o").alias("kind"))
    names = spelled.groupBy("key", "name").agg(F.sum("n").alias("n"), F.min("o").alias("o"))
    top = names.groupBy("key").agg(F.max("n").alias("top"))
    shown = names.join(top, "key").filter("n = top").groupBy("key").agg(F.min_by("name", "o").alias("name"))
    # "roadmap produit" joins "roadmap": every start of the key whose rest is qualifiers only.
    words = F.split("key", " ")
    starts = F.filter(
        F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), lambda i: F.struct(F.array_join(F.slice(words, F.lit(1), i), " ").alias("base"), F.slice(words, i + 1, F.size(words)).alias("rest"))),
        lambda x: (F.size(x["rest"]) > 0) & F.forall(x["rest"], lambda w: w.isin(R.QUALIFIERS)),
    )
    bases = first.select("key", "kind", F.explode(starts).alias("b")).select("key", "kind", F.col("b.base").alias("base"))
    target = bases.join(first.select(F.col("key").alias("base"), "kind"), ["base", "kind"]).groupBy("key").agg(F.min_by("base", F.length("base")).alias("target"))
    moved = keyed.select(id, "key").join(target, "key", "left").select(id, F.coalesce("target", "key").alias("key")).distinct()
    read = offers.filter(F.size(skills) > 0).agg(F.count("*").alias("read"))
    counted = moved.groupBy("key").agg(F.count("*").alias("count")).filter(F.col("count") >= R.MIN_COUNT).join(first, "key").join(shown, "key")
    share = half_up(100 * F.col("count") / F.greatest(F.lit(1), F.col("read"))).cast("int").alias("share")
    return top_by_kind(counted.withColumn("read", read.scalar()).select("key", "name", "kind", "count", share), k)


def cv_skills(cvs: DataFrame, vocab: DataFrame, id: str = "cv_id", text: str = "text") -> DataFrame:
    """Vocabulary names a CV holds word for word, one name per key."""
    # Read several times: kept once, a row per key. A key has one name, so the texts meet the names themselves.
    named = settle(vocab.withColumn("key", K.canonical_skill(F.col("name"))).filter("key <> ''").groupBy("key").agg(F.min("name").alias("name")))
    forms = settle(named.select(F.col("name").alias("key"), F.explode(K.spellings(F.col("key"))).alias("form")))
    return citing(cvs, forms, id, text, distinct=False).groupBy(id).agg(F.array_sort(F.collect_set("key")).alias("skills"))


def mine(skills: DataFrame, selection: DataFrame, id: str = "offer_id", text: str = "text") -> DataFrame:
    """For each skill, the offers of a person's own selection that cite it (texts over 300 characters)."""
    # Skills are the outcome of a whole market: computed once, read for the phrases and for the rows.
    skills = settle(skills)
    long = once(selection.select(id, text), _w=skill_key(F.col(text))).filter(F.length("_w") + 2 > 300)
    cited = cited_counts(long, skills.select("key"), [], id, "_w", keyed=True, known=selection).select("key", F.col("count").alias("mine"))
    return skills.join(cited, "key", "left").fillna(0, ["mine"])


def market_insights(skills: DataFrame, within: list[str] | None = None) -> DataFrame:
    """The skills that weigh, against the CV: list add, show or plus, in order.

    `skills` holds key, name, kind, count, share, bonus, in_cv.
    """
    by = within or []
    plus_share = F.when(F.col("count") > 0, half_up(100 * F.coalesce("bonus", F.lit(0)) / F.col("count"))).otherwise(0).cast("int")
    tools = F.col("kind").isin("outil", "methode") & (F.col("share") >= R.ADVICE_HARD_SHARE)
    spoken = (F.col("kind") == "langue") & (F.col("share") >= R.ADVICE_LANGUAGE_SHARE)
    hard = skills.filter((F.col("count") >= R.ADVICE_MIN_COUNT) & (tools | spoken)).withColumn("plus_share", plus_share)
    order = Window.partitionBy(*by).orderBy(F.desc("share"), "key") if by else Window.partitionBy(F.lit(0)).orderBy(F.desc("share"), "key")
    ranked = hard.withColumn("rank", F.row_number().over(order))
    mostly = (F.col("count") >= R.ADVICE_PLUS_COUNT) & (F.col("plus_share") >= R.ADVICE_PLUS_SHARE)
    listed = F.when((F.col("rank") <= R.ADVICE_TOP) & F.col("in_cv"), "show").when(F.col("rank") <= R.ADVICE_TOP, "add").when(~F.col("in_cv") & mostly, "plus")
    kept = ranked.withColumn("list", listed).filter("list IS NOT NULL")
    place = Window.partitionBy(*by, "list").orderBy("rank")
    placed = kept.withColumn("place", F.row_number().over(place))
    return placed.filter((F.col("list") != "plus") | (F.col("place") <= R.ADVICE_PLUS_KEPT)).withColumn("label", K.skill_label(F.col("name")))
