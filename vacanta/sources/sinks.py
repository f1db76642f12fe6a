"""Writes: upserted offers, run reports, daily snapshots, frozen cards, purges, erasures.

Offers are kept in buckets of their key: a batch rewrites the buckets it touches and adds a manifest. Small results
go whole into a new version's folder and readers take the latest one that was written in full; a failed job
leaves the one before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vacanta.operators.filters import DAY, seconds_between
from vacanta.rules import signals as R
from vacanta.sources.buckets import BUCKETS, BucketTable


def current_version(spark: SparkSession, root: str) -> int | None:
    """Latest complete version of a table: the greatest folder that holds a success mark."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    done = [s.getPath() for s in fs.listStatus(path) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    numbers = [int(p.getName().split("=")[1]) for p in done if p.getName().startswith("version=")]
    return max(numbers) if numbers else None


def read_table(spark: SparkSession, root: str) -> DataFrame | None:
    """The latest state of a table of either kind; None if nothing was written."""
    version = current_version(spark, root)
    return BucketTable(spark, root, "dedup_key").read() if version is None else spark.read.parquet(f"{root}/version={version}")


def write_version(df: DataFrame, root: str, partition_by: list[str] | None = None) -> int:
    version = (current_version(df.sparkSession, root) or 0) + 1
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{root}/version={version}")
    return version


def upsert_offers(batch: DataFrame, root: str, now: Column, stream: str = "batch", number: int | None = None, buckets: int = BUCKETS) -> int:
    """Merge a batch into the offers table; only the buckets of its keys are read and written.

    With a `number`, a batch of this `stream` that was merged before changes nothing. Returns the version.
    """
    from vacanta.operators.dedup import dedup_batch, merge_offers

    def step(known: DataFrame | None, rows: DataFrame) -> DataFrame:
        return merge_offers(first_state(rows, now).limit(0) if known is None else known, rows, now)

    return BucketTable(batch.sparkSession, root, "dedup_key", buckets).merge(dedup_batch(batch), step, stream, number)


def archive_keys(keys: DataFrame, root: str) -> int:
    """Sets `archived_at` of the offers in `keys(dedup_key, archived_at)`; others of their buckets stay as they are."""

    def step(known: DataFrame | None, rows: DataFrame) -> DataFrame:
        gone = rows.select("dedup_key", F.col("archived_at").alias("_at"))
        return known.join(gone, "dedup_key", "left").withColumn("archived_at", F.coalesce("_at", "archived_at")).select(*known.columns)

    return BucketTable(keys.sparkSession, root, "dedup_key").merge(keys, step)


def first_state(batch: DataFrame, now: Column) -> DataFrame:
    """The empty offers table, typed like the batch."""
    none = now.isNull()
    from vacanta.operators.dedup import OFFER_DETAILS

    return batch.select(
        "dedup_key", "title", "text", F.array(F.struct(F.col("source_key").alias("source"), F.col("source_url").alias("url"))).alias("urls"),
        F.array("source_key").alias("sources"), "apply_url", "published_at", now.alias("first_seen_at"), now.alias("last_seen_at"),
        F.when(none, now).alias("archived_at"), F.lit(0).alias("repost_count"), F.when(none, now).alias("reposted_at"),
        *[c for c in OFFER_DETAILS if c in batch.columns],
    )


def append_runs(reports: DataFrame, path: str) -> None:
    reports.write.mode("append").parquet(path)


def write_snapshots(snapshots: DataFrame, path: str) -> None:
    """Snapshots of the days given replace those kept for the same days."""
    snapshots.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def freeze_card(skills: DataFrame) -> DataFrame:
    """Public copy of a picture: nothing of the person's CV nor selection."""
    return skills.withColumns({"mine": F.lit(0), "in_cv": F.lit(False)})


def purge_texts(offers: DataFrame, now: Column, days: int = R.RETENTION_DAYS) -> DataFrame:
    old = F.coalesce(seconds_between(now, F.col("archived_at")) > days * DAY, F.lit(False))
    return offers.withColumn("text", F.when(~old, F.col("text")))
