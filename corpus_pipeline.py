"""Corpus pipeline: toxic documents go, one of each group of near-duplicates stays, documents that hold benchmark
passages go, sources are mixed to target weights, and the token ids are written in training order.

Every stage takes `(spark, docs, sf_dir)` and works on all that the stage before kept; what comes between two
stages is a table in the shared folder. A document is a doc_id with its text: rows that share a doc_id are judged each
by its own text, rows without one as well, and rows equal in both are one document. Empty tables give empty tables; further columns
stay as they are, whatever their names. A null text is an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from vacanta.llm import minhash, mixing, queries, tiling, token_shards, toxicity
from vacanta.session import begin_step, end_steps, settle

# A document's key beside its own columns.
ROW = "corpus_pipeline_key"


def stage(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A stage takes away what the stage before had written for itself: its result is a table by now."""

    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        begin_step(spark)
        try:
            return function(spark, docs, sf_dir)
        finally:
            if function is token_output:
                end_steps(spark)

    return begun


def with_key(docs: DataFrame) -> DataFrame:
    return docs.withColumn(ROW, F.xxhash64("doc_id", "text"))


def keyed(docs: DataFrame) -> DataFrame:
    """`docs` with the hash of doc_id and text in place of the doc_id, and the columns the operators read."""
    return docs.select(F.xxhash64("doc_id", "text").alias("doc_id"), *[c for c in ("text", "lang", "source") if c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches the threshold go. The classifier learns from the labelled documents."""
    model = toxicity.learn(docs, queries.table(spark, sf_dir, "labels"))
    rejected = toxicity.toxicity_scores(keyed(docs), model).where("predicted = 1").select(F.col("doc_id").alias(ROW)).distinct()
    return with_key(docs).join(rejected, ROW, "left_anti").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document with the smallest doc_id stays (one without a doc_id if there is no other)."""
    groups = minhash.near_duplicates(keyed(docs)).select(F.col("doc_id").alias(ROW), "component_id").distinct()
    own = with_key(docs.select("doc_id", "text")).select("doc_id", ROW).distinct()
    first = own.join(groups, ROW).groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", ROW)).alias("first"))
    kept = first.select(F.col(f"first.{ROW}").alias(ROW))
    return with_key(docs).join(kept, ROW, "left_semi").dropDuplicates([ROW]).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover at least half of a benchmark item's words with shared passages go."""
    found = tiling.contaminated(docs, queries.table(spark, sf_dir, "benchmark")).select("doc_id", "body").distinct()
    here = docs.withColumn("body", F.xxhash64("text"))
    held = here.alias("d").join(found.alias("f"), F.expr("d.doc_id <=> f.doc_id AND d.body = f.body"), "left_anti")
    return held.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document is repeated as often as the mixture reads it: once at least, small sources up to twice."""
    read = mixing.copies(mixing.mix(keyed(docs), repetition=2.0)).select(F.col("doc_id").alias(ROW), F.col("copies").alias(f"{ROW}_copies"))
    times = with_key(docs).join(read, ROW, "left").withColumn(ROW, F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce(f"{ROW}_copies", F.lit(1)))))
    return times.select(*docs.columns)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards in training order, read back: slot, shard, byte_offset, doc_id, part, n_tokens, ids_sha256."""
    return token_shards.read_shards(*token_shards.write_shards(docs, queries.tokenizer()))


STAGES = [
    ("toxicity", stage(drop_toxic)),
    ("MinHash near-dedup", stage(drop_near_duplicates)),
    ("benchmark decontamination", stage(drop_contaminated)),
    ("mixing sources", stage(mix_sources)),
    ("token-ID output", stage(token_output)),
]
# No SQL: compression distances, MinHash and tokenizers have no form in it. See tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for _, step in STAGES[:-1]:
        docs = settle(step(spark, docs, sf_dir), keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
