"""Search criteria and CV summaries read from JSON, defaults filled in."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from vacanta.columns import strings, strip

LISTS = {
    "targetRoles": "target_roles", "titleVariants": "title_variants", "bridgeRoles": "bridge_roles", "sectorsPriority": "sectors_priority", "sectorsOk": "sectors_ok",
    "sectorsAvoid": "sectors_avoid", "languages": "languages", "companiesAvoid": "companies_avoid", "companiesFollow": "companies_follow", "dealBreakers": "deal_breakers",
}
CONTRACTS = ["cdi", "cdd", "stage", "alternance", "freelance"]
SCHEMA = ",".join(f"{k} array<string>" for k in LISTS) + (
    ",otherSectors struct<open:boolean,condition:string>,zone struct<places:array<struct<label:string,kind:string,country:string>>,remoteOk:boolean>"
    ",outOfZone string,contracts array<string>,experienceYears double,availability string,openness double"
)
CV_LISTS = ["roles", "skills", "languages", "education", "highlights"]
CV_SCHEMA = "experienceYears double," + ",".join(f"{k} array<string>" for k in CV_LISTS)


def _items(c: Column) -> Column:
    return F.filter(F.transform(F.coalesce(c, strings([])), strip), lambda x: x != "")


def parse_criteria(json: Column) -> Column:
    """struct of a person's search; what is missing takes its default, what is out of range is refused (null)."""
    c = F.from_json(json, SCHEMA)
    places = F.filter(F.coalesce(c["zone"]["places"], F.array().cast("array<struct<label:string,kind:string,country:string>>")), lambda p: (p["label"] != "") & p["kind"].isin("city", "region", "country") & (F.length(p["country"]) == 2))
    zones = F.transform(places, lambda p: F.struct(p["label"].alias("label"), p["kind"].alias("kind"), F.upper(p["country"]).alias("country")))
    out = F.coalesce(c["outOfZone"], F.lit("never"))
    openness = F.coalesce(c["openness"], F.lit(50.0))
    years = c["experienceYears"]
    sound = F.try_parse_json(json).isNotNull() & c.isNotNull() & out.isin("never", "exceptional", "yes") & openness.between(0, 100) & (years.isNull() | years.between(0, 45))
    value = F.struct(
        *[_items(c[k]).alias(v) for k, v in LISTS.items()],
        F.coalesce(c["otherSectors"]["open"], F.lit(True)).alias("open_sectors"), F.nullif(strip(c["otherSectors"]["condition"]), F.lit("")).alias("sector_condition"),
        zones.alias("zone_places"), F.coalesce(c["zone"]["remoteOk"], F.lit(True)).alias("remote_ok"), out.alias("out_of_zone"),
        F.filter(F.coalesce(c["contracts"], strings([])), lambda x: x.isin(CONTRACTS)).alias("contracts"), years.alias("experience_years"), openness.alias("openness"),
    )
    return F.when(sound, value)


def parse_cv_summary(json: Column) -> Column:
    c = F.from_json(json, CV_SCHEMA)
    return F.when(F.try_parse_json(json).isNotNull() & c.isNotNull(), F.struct(c["experienceYears"].alias("experience_years"), *[_items(c[k]).alias(k) for k in CV_LISTS]))
