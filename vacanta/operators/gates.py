"""Gates: hard constraints of a person on an offer, evaluated on (offer, profile) pairs.

Decisions are counted on classes: offers that no gate tells apart meet, class by class, the people whose
constraints are alike (`gate_counts`). Pairs are formed where someone reads them, for close titles and favourites.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vacanta.columns import fixed_map, strings
from vacanta.functions.geo import norm, zone_keys, zone_verdict
from vacanta.functions.signals import title_seniority
from vacanta.rules import signals as S
from vacanta.rules import views as V
from vacanta.session import broadcast_if_small, settle

RESULT = "struct<pass:boolean,reason:string,out_of_zone:boolean,experience_gap:double,notes:array<string>>"


def number_text(c: Column) -> Column:
    """A number as people write it: no decimals when there are none."""
    return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))


def _s(c: Column) -> Column:
    return F.when(c > 1, "s").otherwise("")


def chances_cap(gap: Column) -> Column:
    return F.when(gap <= 0, F.lit(100.0)).when(gap <= 2, 100 - gap * 20).otherwise(35.0)


def contract_label(contract: Column) -> Column:
    labels = fixed_map(S.CONTRACT_LABELS)
    return F.coalesce(F.try_element_at(labels, contract), contract)


def contract_reason(contract: Column) -> Column:
    return F.concat(contract_label(contract), F.lit(", un type de contrat que tu n'as pas retenu."))


def experience_gap(implied: Column, required: Column, level: Column, years: Column) -> Column:
    worded = F.when(required.isNull() & (level == "experienced"), F.lit(S.EXPERIENCED_YEARS)).otherwise(0)
    gap = F.greatest(F.lit(0.0), implied - years, F.coalesce(required, F.lit(0)) - years, worded - years)
    return F.when(years.isNull(), F.lit(0.0)).otherwise(gap.cast("double"))


def gate_from(zone: Column, out_of_zone: Column, contract: Column, contracts: Column, implied: Column, required: Column, level: Column, years: Column, company: Column, avoided: Column) -> Column:
    """First gate that fails gives the reason: zone, contract, title seniority, years asked, avoided company."""
    limit = V.EXPERIENCE_GAP_EXCLUDE
    contracts = F.coalesce(contracts, strings([]))
    unwanted = (F.size(contracts) > 0) & (contract != "unknown") & ~F.array_contains(contracts, contract)
    senior = F.coalesce(implied - years >= limit, F.lit(False))
    asked = F.coalesce(required - years >= limit, F.lit(False))
    shunned = F.exists(F.coalesce(avoided, strings([])), lambda c: (norm(c) != "") & F.contains(norm(company), norm(c)))
    reason = (
        F.when((zone == "out") & (out_of_zone == "never"), V.REASON_ZONE)
        .when(unwanted, contract_reason(contract))
        .when(senior, F.concat(F.lit("Intitulé trop senior pour ton expérience ("), number_text(years), F.lit(" an"), _s(years), F.lit(").")))
        .when(asked, F.concat(number_text(required), F.lit(" an"), _s(required), F.lit(" d'expérience demandé"), _s(required), F.lit(", "), number_text(years), F.lit(" de ton côté.")))
        .when(shunned, F.concat(company, F.lit(" fait partie des entreprises que tu évites.")))
    )
    return F.struct(
        reason.isNull().alias("pass"),
        reason.alias("reason"),
        ((zone == "out") & (out_of_zone == "exceptional")).alias("out_of_zone"),
        experience_gap(implied, required, level, years).alias("experience_gap"),
        F.when(zone == "unknown", F.array(F.lit(V.NOTE_PLACE))).otherwise(strings([])).alias("notes"),
    )


def gate(pairs: DataFrame) -> DataFrame:
    """Adds the `gate` struct to pairs that hold the offer and the profile columns."""
    have = set(pairs.columns)
    keyed = pairs if "zone_keys" in have else pairs.withColumn("zone_keys", zone_keys(F.col("zone_places")))
    keyed = keyed if "title_years" in have else keyed.withColumn("title_years", title_seniority(F.col("title")))
    verdict = keyed.withColumn("zone_verdict", zone_verdict(F.col("places"), F.col("remote"), F.col("remote_scope"), F.col("zone_keys"), F.col("remote_ok")))
    return verdict.withColumn(
        "gate",
        gate_from(
            F.col("zone_verdict"), F.col("out_of_zone"), F.col("contract"), F.col("contracts"), F.col("title_years"),
            F.col("experience_min_years"), F.col("experience_level"), F.col("experience_years"), F.col("company_name"), F.col("companies_avoid"),
        ),
    )


def pairs_in_scope(offers: DataFrame, profiles: DataFrame, salts: int = 16) -> DataFrame:
    """Offers × profiles that a zone can let through, by equality on the country.

    A pair that is absent is out of the zone of a person who never wants to see it. A country may hold
    most offers: profiles of proven size are broadcast, otherwise the country is salted.
    """
    places = F.filter(F.transform(F.col("places"), lambda p: p["country"]), lambda c: c.isNotNull())
    open_place = (F.size(places) == 0) | (F.col("remote") == "remote")
    o = offers.withColumn("_country", F.explode(F.array_distinct(F.concat(places, F.array(F.lit("*")), F.when(open_place, F.array(F.lit("?"))).otherwise(strings([]))))))
    sees_all = (F.size("zone_places") == 0) | (F.col("out_of_zone") != "never")
    sought = F.array_distinct(F.concat(F.transform(F.col("zone_places"), lambda z: z["country"]), F.array(F.lit("?"))))
    p = profiles.withColumn("_countries", sought).withColumn("_country", F.explode(F.when(sees_all, F.array(F.lit("*"))).otherwise(sought)))
    side, small = broadcast_if_small(p)
    if not small:
        o = o.withColumn("_salt", F.pmod(F.xxhash64("offer_id"), F.lit(salts)).cast("int"))
        side = side.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    keys = ["_country"] if small else ["_country", "_salt"]
    met = o.join(side, keys)
    # An offer that shares two keys with a profile meets it once: at the first key they share.
    shared = F.when(F.col("_country") == "*", F.lit("*")).otherwise(
        F.get(F.filter(F.array_distinct(F.concat(places, F.when(open_place, F.array(F.lit("?"))).otherwise(strings([])))), lambda c: F.array_contains(F.col("_countries"), c)), F.lit(0))
    )
    return met.filter(shared == F.col("_country")).drop("_country", "_countries", "_salt")


def gate_matrix(offers: DataFrame, profiles: DataFrame) -> DataFrame:
    return gate(pairs_in_scope(offers, profiles.withColumn("zone_keys", zone_keys(F.col("zone_places")))))


# What the gates look at in an offer and in a person; an avoided company is looked at apart, so that companies do not split classes.
OFFER_CLASS = ["places", "remote", "remote_scope", "contract", "title_years", "experience_min_years", "experience_level"]
PERSON_CLASS = ["zone_places", "remote_ok", "out_of_zone", "contracts", "experience_years"]


def offer_classes(offers: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Offers counted by what the gates see of them (and by `extra` columns)."""
    return offers.withColumn("title_years", title_seniority(F.col("title"))).groupBy(*(extra or []), *OFFER_CLASS).agg(F.count("*").alias("offers"))


def person_classes(profiles: DataFrame) -> DataFrame:
    """`(profile_id, person_class)` and what the gates see of each person."""
    return profiles.select("profile_id", F.md5(F.to_json(F.struct(*PERSON_CLASS))).alias("person_class"), *PERSON_CLASS)


def shunned_companies(companies: DataFrame, profiles: DataFrame, seed: int = 4) -> DataFrame:
    """`(profile_id, company_name)`: companies whose name holds one that a person avoids.

    Names meet on equal runs of `seed` letters (shorter avoided names on the whole name), then the rest is compared.
    """
    names = companies.select("company_name").distinct().withColumn("_n", norm(F.col("company_name")))
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(seed)), lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.length("_n") - k + 1, F.lit(1))), lambda i: F.substring(F.col("_n"), i, k))))
    seeded = names.filter(F.col("_n") != "").withColumn("_seed", F.explode(F.array_distinct(runs)))
    avoided = profiles.select("profile_id", F.explode("companies_avoid").alias("_c")).select("profile_id", norm(F.col("_c")).alias("_a")).filter(F.col("_a") != "").distinct()
    met = seeded.join(avoided.select("_a").distinct().withColumn("_seed", F.substring("_a", 1, seed)), "_seed").filter(F.contains("_n", "_a")).select("company_name", "_a").distinct()
    return met.join(avoided, "_a").select("profile_id", "company_name").distinct()


def _gate_classes(offers: DataFrame, persons: DataFrame) -> DataFrame:
    """Gate of each class of offers with each class of people it meets; companies are left out."""
    known = offers.withColumns({"offer_id": F.monotonically_increasing_id(), "company_name": F.lit("")})
    return gate(pairs_in_scope(known, persons.withColumns({"companies_avoid": strings([]), "zone_keys": zone_keys(F.col("zone_places"))})))


def gate_counts(offers: DataFrame, profiles: DataFrame) -> DataFrame:
    """`(profile_id, reason, n)`: the decisions on all offers for every profile, a null reason for those that pass.

    The counts of a profile add up to the number of offers. Offers are grouped before they meet anyone; those that
    meet nobody are out of the zone of a person who never wants to see it.
    """
    people = settle(person_classes(profiles))
    persons = people.drop("profile_id").dropDuplicates(["person_class"])
    classes = settle(offer_classes(offers))
    decided = settle(_gate_classes(classes, persons).groupBy("person_class", F.col("gate.reason").alias("reason")).agg(F.sum("offers").alias("n")))
    whole = classes.agg(F.coalesce(F.sum("offers"), F.lit(0)).alias("whole"))
    met = decided.groupBy("person_class").agg(F.sum("n").alias("met"))
    rest = persons.select("person_class").join(met, "person_class", "left").join(F.broadcast(whole), F.lit(True)).select("person_class", F.lit(V.REASON_ZONE).alias("reason"), (F.col("whole") - F.coalesce("met", F.lit(0))).alias("n"))
    by_class = decided.unionByName(rest)
    counts = people.select("profile_id", "person_class").join(by_class, "person_class").select("profile_id", "reason", "n")

    # Offers of avoided companies that passed the other gates change their reason.
    shunned = settle(shunned_companies(offers, profiles.select("profile_id", "companies_avoid")).join(people.select("profile_id", "person_class"), "profile_id"))
    theirs = offer_classes(offers.join(shunned.select("company_name").distinct(), "company_name", "left_semi"), ["company_name"]).withColumnRenamed("company_name", "_company")
    passed = _gate_classes(theirs, persons).filter("gate.pass").groupBy(F.col("_company").alias("company_name"), "person_class").agg(F.sum("offers").alias("n"))
    moved = shunned.join(passed, ["company_name", "person_class"])
    avoided = moved.select("profile_id", F.concat("company_name", F.lit(" fait partie des entreprises que tu évites.")).alias("reason"), "n")
    back = moved.select("profile_id", F.lit(None).cast("string").alias("reason"), (-F.col("n")).alias("n"))
    return add_counts(counts, avoided, back)


def add_counts(*parts: DataFrame) -> DataFrame:
    """Counts `(profile_id, reason, n)` of several tables added up; what comes to zero is gone."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("profile_id", "reason").agg(F.sum("n").cast("bigint").alias("n")).filter("n <> 0")


def gate_histogram(gated: DataFrame) -> DataFrame:
    """Gate decisions counted, digits masked; passes whose title or place looks wrong are counted apart."""
    reason = F.when(F.col("gate.pass"), "pass").otherwise(F.regexp_replace("gate.reason", r"\d+", "N"))
    odd = F.col("gate.pass") & F.col("title").rlike("(?i)senior|lead|head|staff|principal|director")
    return gated.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"), F.count_if(odd).alias("suspicious"))


def unscored(offers: DataFrame, scores: DataFrame, version: Column | None = None) -> DataFrame:
    done = scores if version is None else scores.filter(F.col("criteria_version") == version)
    return offers.join(done.select("offer_id").distinct(), "offer_id", "left_anti")


def candidates(gated: DataFrame, favorites: DataFrame, relevance: str = "relevance", least: float = 5.0, floor: float = 1.0) -> DataFrame:
    """Pairs read further: a close title, or a favourite company whose text is known."""
    fav = favorites.select("profile_id", "company_id").distinct().withColumn("favorite", F.lit(True))
    j = gated.join(fav, ["profile_id", "company_id"], "left").withColumn("favorite", F.coalesce("favorite", F.lit(False)))
    close = F.col(relevance) >= least
    return j.withColumn("title_match", close).filter(close | (F.col("favorite") & F.col("has_description"))).withColumn("rel", F.greatest(F.col(relevance), F.lit(floor)))


def reuse_verdicts(wanted: DataFrame, scores: DataFrame, by: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(reused, left): the latest earlier verdict under the same judge key, and the pairs without one.

    A reused row is written for the version asked for and with the zone flag of the pair asked for.
    """
    by = by or ["user_id", "offer_id", "judge_key"]
    asked = [F.col("criteria_version").alias("_v"), *([F.col("out_of_zone").alias("_z")] if "out_of_zone" in wanted.columns else [])]
    earlier = scores.join(wanted.select(*by, *asked), by).filter(F.col("criteria_version") < F.col("_v"))
    new = {"criteria_version": F.col("_v"), "out_of_zone": F.col("_z")} if "_z" in earlier.columns else {"criteria_version": F.col("_v")}
    payload = [new[c].alias(c) if c in new else F.col(c) for c in scores.columns if c not in by]
    extra = [new[c].alias(c) for c in new if c not in scores.columns]
    latest = earlier.groupBy(*by).agg(F.max_by(F.struct(*payload, *extra), "criteria_version").alias("r")).select(*by, "r.*")
    return latest, wanted.join(latest.select(*by), by, "left_anti")


def judge_key(columns: list[Column]) -> Column:
    """16 hexadecimal digits over everything a verdict depends on."""
    return F.substring(F.sha1(F.to_json(F.struct(*columns))), 1, 16)


