"""Sentences that follow from a row's number, in front of the row's own text: each rule meets its triggers, its exclusions
and its limits, and the oracle states what it must read."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from vacanta.functions import languages as L
from vacanta.functions import privacy as P
from vacanta.functions import relevance as V
from vacanta.functions import signals as G
from vacanta.workloads.binding import table
from vacanta.workloads.registry import query


def numbered(spark, sf) -> DataFrame:
    """Documents with their number n and two counts of years, a and b = a + 2."""
    d = table(spark, sf, "documents").filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("n"), F.coalesce("text", F.lit("")).alias("text"))
    a = (F.floor(F.col("n") / 16) % 7 + 2).cast("int")
    return d.withColumns({"a": a, "b": a + 2})


def frame(frames: list[str]) -> Column:
    """The frame of a row, its counts filled in: row n has frame n % len(frames)."""
    texts = [F.concat(F.lit(""), *[F.col(p[1:-1]).cast("string") if p in ("{a}", "{b}") else F.lit(p) for p in re.split(r"(\{[ab]\})", f)]) for f in frames]
    return F.get(F.array(*texts), F.pmod(F.col("n"), F.lit(len(frames))).cast("int"))


def said(df: DataFrame, frames: list[str]) -> DataFrame:
    return df.withColumn("said", frame(frames)).withColumn("text", F.concat("said", F.lit("\n"), "text"))


YEARS = [
    ("Vous comptez au moins {a} ans d'expérience en atelier.", "a", "NULL"),
    ("Expérience : {a} à {b} ans dans un métier voisin.", "a", "b"),
    ("Between {a} and {b} years of experience with customers.", "a", "b"),
    ("Moins de {a} ans d'expérience suffisent.", "0", "a"),
    ("Fondée il y a {a} ans, la maison emploie cent personnes.", "NULL", "NULL"),
    ("You bring {a}+ years of experience in a plant.", "a", "NULL"),
    ("Depuis {a} ans, la maison vend des outils.", "NULL", "NULL"),
    ("Expérience de {a}-{b} ans souhaitée.", "a", "b"),
    ("", "NULL", "NULL"),
]
_N = "n AS (SELECT doc_id AS n, (doc_id // 16) % 7 + 2 AS a, (doc_id // 16) % 7 + 4 AS b FROM documents WHERE doc_id IS NOT NULL)"


def _case(values: list[str], by: int | None = None) -> str:
    return "CASE n % " + str(by or len(values)) + " " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


@query("years_said", f"WITH {_N} SELECT n, {_case([y[1] for y in YEARS])} AS low, {_case([y[2] for y in YEARS])} AS high FROM n")
def years_said(spark, sf):
    """Years of experience asked, whatever else the whole text says."""
    d = said(numbered(spark, sf), [y[0] for y in YEARS])
    return d.select("n", G.detect_experience(F.col("text")).alias("e")).select("n", F.col("e.min").alias("low"), F.col("e.max").alias("high"))


LEVELS = [("Une expérience significative de la vente est attendue.", "'experienced'"), ("Profil junior bienvenu.", "'junior'"), ("Vous encadrez les juniors de l'équipe.", "NULL"), ("", "NULL")]


@query("levels_said", f"WITH {_N} SELECT n, {_case([x[1] for x in LEVELS])} AS level FROM n")
def levels_said(spark, sf):
    return said(numbered(spark, sf), [x[0] for x in LEVELS]).select("n", G.detect_experience_level(F.col("text")).alias("level"))


REMOTES = [("Deux jours de télétravail par semaine.", "'hybrid'"), ("Un poste en full remote.", "'remote'"), ("Pas de télétravail sur ce site.", "NULL"), ("You may be working remotely on Fridays.", "'hybrid'"), ("", "NULL")]


@query("remote_said", f"WITH {_N} SELECT n, {_case([x[1] for x in REMOTES])} AS remote FROM n")
def remote_said(spark, sf):
    return said(numbered(spark, sf), [x[0] for x in REMOTES]).select("n", G.detect_remote(F.col("text")).alias("remote"))


PAY = [
    ("Rémunération : de 3{a} 000 € à 4{a} 000 € brut par an.", "'3' || a || ' à 4' || a || ' k€ brut par an'"),
    ("Salaire : 3{a}-4{a} k€ brut annuel.", "'3' || a || ' à 4' || a || ' k€ brut par an'"),
    ("Salaire : 3{a} k€ brut annuel.", "'3' || a || ' k€ brut par an'"),
    ("La maison a levé {a} M€ l'an dernier.", "NULL"),
    ("Salaire : 1 9{a}0 € à 2 1{a}0 € par mois.", "'1 9' || a || '0 € à 2 1' || a || '0 € par mois'"),
    ("", "NULL"),
]


@query("pay_said", f"WITH {_N} SELECT n, {_case([x[1] for x in PAY])} AS pay FROM n")
def pay_said(spark, sf):
    return said(numbered(spark, sf), [x[0] for x in PAY]).select("n", F.translate(G.detect_salary(F.col("text")), "  ", "  ").alias("pay"))


TONGUES = [
    ("Allemand courant indispensable.", "'allemand'", "'Allemand courant indispensable.'"), ("You speak Portuguese fluently.", "'portugais'", "'You speak Portuguese fluently.'"), ("Parler espagnol serait un plus.", "NULL", "NULL"),
    ("Fluent in English and French.", "NULL", "NULL"), ("Nos clients sont en Allemagne.", "NULL", "NULL"), ("", "NULL", "NULL"),
]


@query("languages_said", f"WITH {_N}, r AS (SELECT n, {_case([x[1] for x in TONGUES])} AS language, {_case([x[2] for x in TONGUES])} AS quote FROM n) SELECT n, language, rtrim(quote, '.') AS quote FROM r WHERE language IS NOT NULL")
def languages_said(spark, sf):
    """Languages that texts require, each with the sentence that says so."""
    asked = L.required_languages(said(numbered(spark, sf), [x[0] for x in TONGUES]), "n")
    return asked.select("n", "language", F.regexp_replace("quote", r"\.$", "").alias("quote"))


@query("languages_missing", f"WITH {_N}, r AS (SELECT n, {_case([x[1] for x in TONGUES])} AS language FROM n), p AS (SELECT * FROM (VALUES ('de', 'allemand'), ('none', ''), ('pt', 'portugais')) t(person, speaks)) SELECT n, person, language FROM r, p WHERE language IS NOT NULL AND language <> speaks")
def languages_missing(spark, sf):
    """The language each of three people lacks for each text."""
    d = said(numbered(spark, sf), [x[0] for x in TONGUES])
    people = F.explode(F.array(*[F.struct(F.lit(p).alias("person"), F.array(F.lit(s)).alias("said")) for p, s in (("de", "Allemand (C1)"), ("none", "Français"), ("pt", "Portugais courant"))]))
    pairs = d.select("n", people.alias("p")).select("n", "p.person", L.spoken_languages(F.col("p.said")).alias("spoken"))
    return L.missing_language(pairs, L.required_languages(d, "n"), "n", "person", "spoken").select("n", "person", "language")


@query("invented_said", f"WITH {_N} SELECT n, CASE n % 3 WHEN 0 THEN '' WHEN 1 THEN 'turbine' ELSE '' END AS invented FROM n")
def invented_said(spark, sf):
    """Role words that a reason uses and the posting never writes: one row in three."""
    d = numbered(spark, sf)
    role = F.lit("Monteur turbine")
    title = F.lit("Monteur (H/F)")
    body = F.when(F.col("n") % 3 == 0, "Vous montez chaque turbine de la centrale.").otherwise("Vous montez des meubles chez les clients.")
    reason = F.when(F.col("n") % 3 == 2, "Un poste de monteur près de chez toi.").otherwise("Monteur de turbine en atelier.")
    return d.select("n", F.array_join(V.invented_words(reason, title, F.concat(body, F.lit("\n"), "text"), role), ",").alias("invented"))


@query("redacted_said", f"WITH {_N} SELECT n, false AS named, false AS called, false AS mailed, true AS kept FROM n")
def redacted_said(spark, sf):
    """Names, phones and addresses in front of a text: none is left, figures of the work are."""
    d = numbered(spark, sf)
    two = F.lpad((F.col("n") % 90 + 10).cast("string"), 2, "0")
    head = F.concat(F.lit("Odile Vasseur\nAcheteuse\nodile.v"), two, F.lit("@exemple.fr - 06 "), two, F.lit(" 21 43 65\n\nMissions\nAcheteuse, 2019 - 2023 : -12 % sur les achats\n"))
    out = d.select("n", P.redact(F.concat(head, "text"), F.array(F.lit("Odile Vasseur"))).alias("t"))
    return out.select("n", F.col("t").rlike("Odile|Vasseur").alias("named"), F.contains("t", F.lit(" 21 43 65")).alias("called"), F.contains("t", F.lit("@exemple")).alias("mailed"), (F.contains("t", F.lit("2019 - 2023")) & F.contains("t", F.lit("-12 %"))).alias("kept"))
