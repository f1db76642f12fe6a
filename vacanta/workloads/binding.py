"""How the reading tables stand for postings, companies, people and runs.

offer = a document (title = its first line, company = its source, five sources are search engines);
page = a web page; company = supplier or customer; application and score = order; run, action and
stream = event; spot check = label; CV = a conversation turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vacanta.columns import let, once
from vacanta.functions.text import first_line, skill_key
from vacanta.workloads import sqltext as Q

ENGINE_SOURCES = ["src0", "src1", "src2", "src3", "src4"]
TEXT_TABLES = {"documents", "pages", "conversations"}
NOW = "2024-03-31"
EVENTS_NOW = "2024-01-31 00:00:00"
ORDERS_NOW = "2001-08-01 00:00:00"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table to read. The test texts come in one row group; they are dealt over the cores, as a larger table's files are."""
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in TEXT_TABLES and df.rdd.getNumPartitions() < cores else df


def ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def offers(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    posted = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 120).cast("int"))
    # Texts in English stay online; the others are archived after a time that grows with their length.
    archived = F.when(F.col("lang") != "en", F.date_add(posted, F.floor(F.length("text") / 50).cast("int")))
    return d.select(
        F.col("doc_id").alias("offer_id"), "text", "lang", "source", F.array("source").alias("sources"),
        F.col("source").isin(ENGINE_SOURCES).alias("engine_only"), first_line(F.col("text")).alias("title"),
        F.col("source").alias("company_id"), F.col("source").alias("company_name"),
        posted.cast("timestamp_ntz").alias("posted_at"), posted.cast("timestamp_ntz").alias("first_seen_at"), archived.cast("timestamp_ntz").alias("archived_at"),
    )


OFFERS = f"""offers AS (
  SELECT doc_id AS offer_id, text, lang, source, source IN {Q.one_of(ENGINE_SOURCES)} AS engine_only,
         string_split(text, chr(10))[1] AS title, source AS company_id,
         CAST(DATE '2024-01-01' + CAST(doc_id % 120 AS INTEGER) AS TIMESTAMP) AS posted_at,
         CASE WHEN lang <> 'en' THEN CAST(DATE '2024-01-01' + CAST(doc_id % 120 AS INTEGER) + CAST(length(text) // 50 AS INTEGER) AS TIMESTAMP) END AS archived_at
  FROM documents)"""


def with_skills(df: DataFrame) -> DataFrame:
    """Skills an offer lists: the longer words of its title (tools) and its pairs of words (methods)."""
    def listed(words: Column) -> Column:
        singles = F.transform(F.filter(words, lambda w: F.length(w) >= 5), lambda w: F.struct(w.alias("name"), F.lit("outil").alias("kind")))
        at = F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1)))
        pairs = F.transform(at, lambda i: F.struct(F.concat_ws(" ", F.get(words, i - 1), F.get(words, i)).alias("name"), F.lit("methode").alias("kind")))
        return F.when(F.size(words) >= 2, F.concat(singles, pairs)).otherwise(singles)

    words = F.filter(F.split(skill_key(F.col("title")), " ", -1), lambda w: w != "")
    return once(df, skills=let(words, listed))


# Words of titles and texts, and the skills drawn from titles, for the oracles.
LISTED = f"""title_words AS (
  SELECT offer_id, list_filter(string_split({Q.skill_key('title')}, ' '), lambda w: w <> '') AS w FROM offers),
listed AS (
  SELECT offer_id, unnest(list_filter(w, lambda x: length(x) >= 5)) AS name, 'outil' AS kind FROM title_words
  UNION ALL
  SELECT offer_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS name, 'methode' AS kind FROM title_words WHERE len(w) >= 2)"""


def grams(source: str, id: str = "offer_id", text: str = "text", name: str = "grams") -> str:
    """Distinct runs of one and two words of a text."""
    return f"""{name}_w AS (SELECT {id}, list_filter(string_split({Q.skill_key(text)}, ' '), lambda w: w <> '') AS w FROM {source}),
{name} AS (
  SELECT DISTINCT {id}, unnest(w) AS form FROM {name}_w
  UNION SELECT DISTINCT {id}, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS form FROM {name}_w WHERE len(w) >= 2)"""


def vocabulary(df: DataFrame) -> DataFrame:
    """Every listed skill, in reading order."""
    listed = df.select("offer_id", F.posexplode("skills").alias("at", "s"))
    return listed.select("s.name", "s.kind", (F.col("offer_id") * 100_000 + F.col("at")).alias("ord"))


def companies(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier")
    return s.select(F.col("s_suppkey").alias("company_id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
