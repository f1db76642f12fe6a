"""Places: gazetteer lookup, location parsing, zone verdict. Column expressions only, no join needed:
the gazetteer is a fixed list, so every name found is ranked by its place in that list."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from vacanta.columns import first_rule, fixed_map, group, says, strip
from vacanta.functions.text import fold
from vacanta.rules import geo as R

PLACE = "struct<city:string,region:string,country:string>"


def norm(c: Column) -> Column:
    return strip(F.regexp_replace(fold(c), r"[\s  ]+", " "))


def flat(c: Column) -> Column:
    """Dashes, apostrophes and spaces alike."""
    return F.regexp_replace(F.translate(norm(c), "-'’", "   "), r"\s+", " ")


def _city_rows() -> list[tuple[str, str | None, str]]:
    rows, seen = [], set()
    for country, region, names in R.CITIES:
        for name in names:
            if name not in seen:
                seen.add(name)
                rows.append((country, region, name))
    return rows


def _country_rows() -> list[tuple[str, str]]:
    return [(code, name) for code, names in R.COUNTRY_NAMES for name in names]


def _alternatives(names: list[str]) -> str:
    return "|".join(re.escape(n).replace("\\ ", " ").replace("\\-", "-") for n in sorted(names, key=len, reverse=True))


CITY_ROWS = _city_rows()
COUNTRY_ROWS = _country_rows()
CITY_PATTERN = f"(?<![a-z])({_alternatives([n for _, _, n in CITY_ROWS])})(?![a-z])"
_SHORT = [n for _, n in COUNTRY_ROWS if len(n) <= 3]
_LONG = [n for _, n in COUNTRY_ROWS if len(n) > 3]
SHORT_COUNTRY = f"(?<![a-z.])({_alternatives(_SHORT)})(?![a-z])"
LONG_COUNTRY = f"({_alternatives(_LONG)})"


def _city_map() -> Column:
    title = lambda name: " ".join(w[:1].upper() + w[1:] for w in name.split(" "))
    rows = {name: {"rank": i, "city": title(name), "region": region, "country": country} for i, (country, region, name) in enumerate(CITY_ROWS)}
    return fixed_map(rows, "struct<rank:int,city:string,region:string,country:string>")


def _country_map() -> Column:
    return fixed_map({name: {"rank": i, "code": code} for i, (code, name) in enumerate(COUNTRY_ROWS)}, "struct<rank:int,code:string>")


def gazetteer(spark) -> DataFrame:
    """The city list as a table: name, country, region, rank."""
    return spark.createDataFrame([(n, c, r, i) for i, (c, r, n) in enumerate(CITY_ROWS)], "name string, country string, region string, rank int")


def country_in(normed: Column, raw: Column) -> Column:
    """Country code of a text from its normalised form; US state codes are read in the raw text."""
    names = F.concat(F.regexp_extract_all(normed, F.lit(SHORT_COUNTRY), F.lit(1)), F.regexp_extract_all(normed, F.lit(LONG_COUNTRY), F.lit(1)))
    found = F.array_min(F.transform(names, lambda n: F.try_element_at(_country_map(), n)))
    return F.coalesce(found["code"], F.when(says(raw, R.US_STATES_ALONE), "US"))


def find_country(c: Column) -> Column:
    return country_in(norm(c), c)


def _stated_country(segment: Column, flat_text: Column, normed: Column) -> Column:
    return (
        F.when(segment.rlike(rf",\s*({R.US_STATE_CODES})(?![A-Za-z0-9_])") | flat_text.rlike(f"(?<![a-z])({R.US_STATE_NAMES})(?![a-z])"), "US")
        .when(segment.rlike(rf",\s*({R.CA_PROVINCES})(?![A-Za-z0-9_])"), "CA")
        .otherwise(country_in(normed, segment))
    )


def _department(segment: Column) -> Column:
    codes = {n: region for region, numbers in R.DEPARTMENTS.items() for n in numbers}
    return F.try_element_at(fixed_map(codes), F.substring(group(segment, r"\b(\d{5})\b"), 1, 2))


def place_of(segment: Column, flat_text: Column, normed: Column) -> Column:
    """Place of one segment: first city of the list, then country, postcode, region."""
    city = F.array_min(F.transform(F.regexp_extract_all(flat_text, F.lit(CITY_PATTERN), F.lit(1)), lambda n: F.try_element_at(_city_map(), n)))
    stated = _stated_country(segment, flat_text, normed)
    country = country_in(normed, segment)
    none = F.lit(None).cast("string")

    def place(c: Column, r: Column, k: Column) -> Column:
        return F.struct(c.alias("city"), r.alias("region"), k.alias("country"))

    french = country.isNull() | (country == "FR")
    region = F.coalesce(_department(segment), first_rule(flat_text, R.REGION_PATTERNS))
    return (
        F.when(flat_text == "", F.lit(None).cast(PLACE))
        .when(
            city.isNotNull(),
            F.when(stated != city["country"], place(city["city"], none, stated)).otherwise(place(city["city"], city["region"], city["country"])),
        )
        .when(french & region.isNotNull(), place(none, region, F.lit("FR")))
        .when(country.isNotNull(), place(none, none, country))
    )


def places_of(raw: Column) -> Column:
    """Places of a location field, one per segment, repeats dropped."""
    text = F.coalesce(raw, F.lit(""))
    parts = F.filter(F.transform(F.split(text, R.SEGMENT_LIMITS, -1), strip), lambda s: s != "")
    segments = F.when(F.size(parts) > 0, parts).otherwise(F.array(text))
    shaped = F.transform(segments, lambda s: F.struct(s.alias("s"), norm(s).alias("n")))
    shaped = F.transform(shaped, lambda x: F.struct(x["s"].alias("s"), x["n"].alias("n"), F.regexp_replace(F.translate(x["n"], "-'’", "   "), r"\s+", " ").alias("f")))
    return F.array_distinct(F.filter(F.transform(shaped, lambda x: place_of(x["s"], x["f"], x["n"])), lambda p: p.isNotNull()))


def remote_of(raw: Column, context: Column) -> Column:
    loc, ctx = norm(F.coalesce(raw, F.lit(""))), norm(F.coalesce(context, F.lit("")))
    return (
        F.when(says(loc, R.REMOTE), "remote")
        .when(says(loc, R.HYBRID) | says(ctx, R.HYBRID), "hybrid")
        .when(says(ctx, R.REMOTE), "remote")
        .otherwise("unknown")
    )


def scope_of(raw: Column, remote: Column, places: Column) -> Column:
    """Where a remote offer may be done from: EU, WORLD, or the countries it names."""
    loc = norm(F.coalesce(raw, F.lit("")))
    countries = F.array_distinct(F.filter(F.transform(places, lambda p: p["country"]), lambda c: c.isNotNull()))
    return (
        F.when(remote != "remote", F.array().cast("array<string>"))
        .when(says(loc, R.SCOPE_EU), F.array(F.lit("EU")))
        .when(says(loc, R.SCOPE_WORLD), F.array(F.lit("WORLD")))
        .otherwise(countries)
    )


def parse_locations(df: DataFrame, raw: str, context: str | None = None, distinct_first: bool = False) -> DataFrame:
    """Adds places, remote and remote_scope. `distinct_first` reads each different location text once."""
    if distinct_first:
        texts = df.select(raw).distinct()
        read = texts.withColumn("places", places_of(F.col(raw)))
        df = df.join(read, df[raw].eqNullSafe(read[raw]), "left").drop(read[raw])
    else:
        df = df.withColumn("places", places_of(F.col(raw)))
    with_remote = df.withColumn("remote", remote_of(F.col(raw), F.col(context) if context else F.lit("")))
    return with_remote.withColumn("remote_scope", scope_of(F.col(raw), F.col("remote"), F.col("places")))


def region_code(label: Column) -> Column:
    import unicodedata

    def plain(s: str) -> str:
        return "".join(c for c in unicodedata.normalize("NFD", s.lower()) if not 0x300 <= ord(c) <= 0x36F)

    pairs = [(plain(name), code) for code, name in R.REGION_LABELS.items()] + [(code.lower(), code) for code in R.REGION_LABELS]
    return F.try_element_at(fixed_map(dict(pairs)), norm(label))


def zone_keys(zone_places: Column) -> Column:
    """Zone places made ready for matching: kind, country, city key, region code, region name."""
    return F.transform(
        zone_places,
        lambda z: F.struct(z["kind"].alias("kind"), z["country"].alias("country"), flat(z["label"]).alias("city"), region_code(z["label"]).alias("region"), norm(z["label"]).alias("name")),
    )


def _matches(p: Column, z: Column) -> Column:
    region = (p["region"] == z["region"]) | (norm(F.coalesce(p["region"], F.lit(""))) == z["name"])
    city = F.coalesce(flat(p["city"]) == z["city"], F.lit(False))
    return F.coalesce(
        (p["country"] == z["country"])
        & F.when(z["kind"] == "country", F.lit(True)).when(z["kind"] == "region", F.coalesce(region, F.lit(False))).otherwise(city),
        F.lit(False),
    )


def zone_verdict(places: Column, remote: Column, scope: Column, zones: Column, remote_ok: Column) -> Column:
    """in, out or unknown; `zones` comes from `zone_keys`. An unread place never excludes."""
    countries = F.transform(zones, lambda z: z["country"])
    known = F.filter(places, lambda p: p["country"].isNotNull())
    bare = F.forall(known, lambda p: p["city"].isNull() & p["region"].isNull())
    in_country = F.exists(known, lambda p: F.array_contains(countries, p["country"]))
    eu = F.arrays_overlap(countries, F.array(*[F.lit(c) for c in R.EU]))
    by_remote = (
        F.when(F.array_contains(scope, "WORLD"), "in")
        .when(F.array_contains(scope, "EU") & eu, "in")
        .when(F.arrays_overlap(scope, countries), "in")
        .when(F.size(scope) == 0, "unknown")
        .otherwise("out")
    )
    return (
        F.when(F.size(zones) == 0, "in")
        .when(F.exists(places, lambda p: F.exists(zones, lambda z: _matches(p, z))), "in")
        .when((remote == "remote") & remote_ok, by_remote)
        .when(F.size(known) == 0, "unknown")
        .when(bare & in_country, "unknown")
        .otherwise("out")
    )


def keep_in_scope(df: DataFrame, countries: list[str], places: str = "places") -> DataFrame:
    """Offers with at least one place in a sought country; everything when no country is sought."""
    if not countries:
        return df
    wanted = F.array(*[F.lit(c) for c in countries])
    return df.filter(F.exists(F.col(places), lambda p: F.coalesce(F.array_contains(wanted, p["country"]), F.lit(False))))


