"""Token counts of whole texts: a broadcast tier of frequent piece lengths, misses through worker caches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vacanta.llm.pretokens import Library, PieceCoder, frequent_pieces
from vacanta.llm.sampling import bounded_sample
from vacanta.llm.worker import held

# The frequent tier is learnt from about this many documents of at most this many bytes; it decides speed, never a count.
SAMPLE_DOCS, SAMPLE_BYTES = 1_000, 65_536
# Entries of the broadcast tier (about 1 MB).
FREQUENT = 16_384

def counter(path: str, frequent: dict[str, int] | None = None):
    """A function text -> number of tokens, as the library for `path` gives them."""
    library = Library(path)
    whole = lambda text: len(library.ids(text))
    if not library.plain:
        return lambda text: whole(text or "")
    return PieceCoder(lambda parts: [len(library.part(p)) for p in parts], whole, sum, frequent, library.specials).of


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """`(doc_id, n_bytes, n_tokens, over_limit)` per row of `docs(doc_id, text, ...)`.

    A null text counts as empty: 0 bytes, 0 tokens. Rows are independent: repeated rows and null ids are
    counted as they stand, other columns are ignored, an empty table gives an empty result. `path` is a
    tokenizer file every executor can open (`.json` or `.model`).
    """
    spark = docs.sparkSession
    sample = bounded_sample(docs, F.col("doc_id").cast("string"), SAMPLE_DOCS).where(F.octet_length("text") <= SAMPLE_BYTES).select("text")
    pieces = frequent_pieces((r.text for r in sample.collect()), FREQUENT)
    count = counter(path)
    tier = spark.sparkContext.broadcast({p: count(" " + p) for p in pieces})

    mark = uuid.uuid4().hex

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = held(("lengths", path, mark), lambda: counter(path, tier.value))
        for batch in batches:
            counts = pa.array([of(t) for t in _texts(batch.column(1))], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), counts], names=["doc_id", "n_bytes", "n_tokens"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = narrow.mapInArrow(lengths, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def _texts(column: pa.Array, step: int = 256) -> Iterator[str | None]:
    """Texts one by one, made in small groups so that a batch is never held twice."""
    for start in range(0, len(column), step):
        yield from column.slice(start, step).to_pylist()
