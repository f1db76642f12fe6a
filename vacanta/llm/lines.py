r"""Line dedup over levelled sorted runs, with DataFrame operations only.

A run is a table bucketed and sorted by the 128-bit hash of a line's key; a row holds the number of documents
and the largest doc_id seen with the key. A batch of documents is reduced to such rows and merge-anti-joined
with the runs, bucket by bucket: keys that no run holds become its own run of `fresh` keys, the others a run
of later sightings. When a level holds `FANOUT` runs of a kind they are compacted into one of the next level,
so a key is rewritten once per level. Batches are even parts of the documents by a hash of the doc_id, whatever
the ids: all rows of one doc_id are in one batch, so counts of documents add up. The runs are dropped at the end.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vacanta.llm.files import shared_folder
from vacanta.session import settle

STRIPPED = " \t\n\x0b\x0c\r"
# Code points of the shortest key that counts, and documents it must be found in for its lines to go.
SHORTEST, DOCUMENTS = 40, 5
# Runs of a level that are compacted into one, and documents of a batch: four batches at least, so that a level fills before the last one.
FANOUT = 3
BATCH_ROWS, LEAST_BATCHES, MOST_BATCHES = 4_000_000, 4, 64
# Rows of one bucket of a run, about.
BUCKET_ROWS = 1_000_000
_ASCII = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(lines: Column) -> Column:
    """Keys of an array of lines: white space stripped at both ends, A-Z lower-cased."""
    edges = [F.lit(c) for c in STRIPPED]

    def strip(x: Column) -> Column:
        return F.when(F.substring(x, 1, 1).isin(*edges) | F.substring(x, -1, 1).isin(*edges), F.trim(x, F.lit(STRIPPED))).otherwise(x)

    def lower(x: Column) -> Column:
        # The general lower() equals the ASCII one where every character is one byte, and is much faster.
        return F.when(F.octet_length(x) == F.length(x), F.lower(x)).otherwise(F.translate(x, *_ASCII))

    return F.transform(F.transform(lines, strip), lower)


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("holder").alias("holder"))


class LineRuns:
    """The runs of one corpus; `add` takes its batches in any order, each document in one of them."""

    def __init__(self, spark: SparkSession, buckets: int):
        self.spark, self.buckets, self.folder = spark, buckets, shared_folder(spark, "runs")
        self.levels: dict[str, list[list[str]]] = {"fresh": [[]], "later": [[]]}

    def runs(self, kind: str) -> list[str]:
        return [name for level in self.levels[kind] for name in level]

    def add(self, sightings: DataFrame) -> None:
        """Adds the sightings `(h1, h2, doc_id)` of a batch."""
        rows = settle(sightings.groupBy("h1", "h2").agg(F.countDistinct("doc_id").alias("n_docs"), F.max("doc_id").alias("holder")))
        known = [self.spark.table(name).select("h1", "h2").hint("merge") for name in self.runs("fresh")]
        fresh = self._write(reduce(lambda left, run: left.join(run, ["h1", "h2"], "left_anti"), known, rows))
        if known:
            own = self.spark.table(fresh).select("h1", "h2").hint("merge")
            self._place("later", self._write(rows.join(own, ["h1", "h2"], "left_anti")))
        self._place("fresh", fresh)

    def frequent(self, documents: int) -> DataFrame:
        """Keys found in at least `documents` documents, with their last holder."""
        return _summed(self._union([*self.runs("fresh"), *self.runs("later")])).where(F.col("n_docs") >= documents).select("h1", "h2", "holder")

    def close(self) -> None:
        """Drops all runs."""
        for name in [*self.runs("fresh"), *self.runs("later")]:
            self._remove(name)
        self.levels = {"fresh": [[]], "later": [[]]}

    def _union(self, names: list[str]) -> DataFrame:
        # Read as plain files: this Spark version loses rows of equal keys when it unites bucketed scans without an exchange.
        return self.spark.read.schema("h1 long, h2 long, n_docs long, holder long").parquet(*[f"{self.folder}/{name}" for name in names])

    def _write(self, rows: DataFrame) -> str:
        name = f"vacanta_run_{uuid.uuid4().hex}"
        dealt = rows.select("h1", "h2", "n_docs", "holder").repartition(self.buckets, "h1", "h2")
        dealt.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def _place(self, kind: str, run: str) -> None:
        levels, level = self.levels[kind], 0
        levels[0].append(run)
        while len(levels[level]) >= FANOUT:
            full, levels[level] = levels[level], []
            if level + 1 == len(levels):
                levels.append([])
            levels[level + 1].append(self._write(_summed(self._union(full))))
            for name in full:
                self._remove(name)
            level += 1

    def _remove(self, name: str) -> None:
        context = self.spark.sparkContext
        self.spark.sql(f"DROP TABLE {name}")
        path = context._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def dedup_lines(docs: DataFrame, shortest: int = SHORTEST, documents: int = DOCUMENTS, batches: int | None = None) -> DataFrame:
    """`(doc_id, n_lines, n_dropped, kept_sha256, kept_text)` per row of `docs(doc_id, text, ...)`.

    Keys of at least `shortest` code points found in at least `documents` documents lose all their lines but
    those of the largest doc_id that holds them. A null or empty text is one empty line. Rows that share a
    doc_id are one document when documents are counted, and each keeps or loses its own lines. A row without
    a doc_id is neither counted nor changed. Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    body = F.xxhash64("text")
    exploded = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", body.alias("body"), F.posexplode(line_key(split_lines(F.col("text")))).alias("pos", "key")).where(F.length("key") >= shortest)
    rows = docs.agg(F.count("doc_id")).first()[0] or 0
    batches = batches or max(LEAST_BATCHES, min(MOST_BATCHES, -(-rows // BATCH_ROWS)))
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")
    hashed = exploded.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "body", "pos", batch.alias("batch"))
    # Written once, a folder for each batch, so that a batch reads its own rows only.
    folder = shared_folder(spark, "lines")
    hashed.write.partitionBy("batch").parquet(folder)
    lines = spark.read.schema(hashed.schema).parquet(folder)

    runs = LineRuns(spark, max(8, min(8_192, -(-8 * rows // BUCKET_ROWS))))
    for b in range(batches):
        runs.add(lines.where(F.col("batch") == b).select("h1", "h2", "doc_id"))
    frequent = settle(runs.frequent(documents))
    runs.close()
    gone = lines.join(frequent, ["h1", "h2"]).where("doc_id <> holder").groupBy("doc_id", "body").agg(F.collect_set("pos").alias("gone"))

    joined = docs.withColumn("body", body).join(gone.hint("shuffle_hash"), ["doc_id", "body"], "left")
    parts = split_lines(F.col("text"))
    numbers = F.sequence(F.lit(0), F.size("lines") - 1)
    kept = F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(F.array_except(numbers, "gone"), lambda i: F.get("lines", i)), "\n"))
    out = joined.withColumn("lines", parts).select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept_text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"), "kept_text")
