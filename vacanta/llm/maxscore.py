"""Exact top-k by inner product with MaxScore, in a grid of document shards and query blocks.

A term is a dimension with the sign of the query's component; its posting list in a shard holds the documents
whose component has that sign, and its bound is the largest contribution found there. For a query, the terms
of the smallest bounds whose sum stays below the k-th best score so far are non-essential: a document found in
their lists alone cannot enter. The essential postings are traversed and summed for a block of documents at a
time; documents whose sum plus the non-essential bounds still competes are probed term by term, the largest
bound first, and dropped as soon as they cannot reach the threshold (negative contributions only lower it).
Each cell returns at most k rows a query; a window over them merges the shards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from vacanta.session import settle

# Documents of a shard and queries of a block: what one task holds.
SHARD, QUERIES = 16_384, 1_024
# Documents scored at once.
BLOCK = 2_048


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors as rows; shorter ones are filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), sizes.max(initial=0)), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def search(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best `(query_id, id, score)` of one cell, ties to the smaller id."""
    width = max(vectors.shape[1], queries.shape[1])
    vectors = np.pad(vectors, ((0, 0), (0, width - vectors.shape[1])))
    queries = np.pad(queries, ((0, 0), (0, width - queries.shape[1])))
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    largest = float(np.abs(vectors).max(initial=0)) * float(np.abs(queries).max(initial=0)) * width
    kind = np.float32 if largest < 2**23 else np.float64 if largest < 2**52 else np.int64
    best_score = np.full((len(queries), k), -np.inf if kind != np.int64 else np.iinfo(np.int64).min, kind)
    best_id = np.full((len(queries), k), -1, np.int64)
    held = np.zeros(len(queries), np.int64)
    v, q = vectors.astype(kind), queries.astype(kind)
    # Bounds of the terms over the shard; a dimension that only lowers the score has none.
    bound = np.maximum(np.where(q > 0, q * v.max(axis=0, initial=0), q * v.min(axis=0, initial=0)), 0)
    ranked = np.argsort(bound, axis=1, kind="stable")
    through = np.take_along_axis(bound, ranked, 1).cumsum(axis=1)
    for start in range(0, len(ids), BLOCK):
        block, names = v[start : start + BLOCK], ids[start : start + BLOCK]
        full = held >= k
        threshold = np.where(full, best_score[:, -1], best_score.dtype.type(0))
        # Non-essential: the smallest bounds, as long as their sum is below the threshold.
        spare = np.where(full, (through < threshold[:, None]).sum(axis=1), 0)
        essential = np.ones_like(q, dtype=bool)
        np.put_along_axis(essential, ranked, np.arange(width) >= spare[:, None], 1)
        rest = np.where(spare > 0, np.take_along_axis(through, np.maximum(spare - 1, 0)[:, None], 1)[:, 0], 0)
        sums = (q * essential) @ block.T
        # An equal score loses to the ids held already, which are smaller.
        rows, cols = np.nonzero((sums + rest[:, None] > threshold[:, None]) | ~full[:, None])
        scores = sums[rows, cols]
        # Probes, the largest remaining bound first.
        left = spare[rows].copy()
        remaining = rest[rows].copy()
        active = np.flatnonzero((left > 0) & (names[cols] != query_ids[rows]))
        alive = names[cols] != query_ids[rows]
        while len(active):
            r = rows[active]
            dim = ranked[r, left[active] - 1]
            scores[active] += q[r, dim] * block[cols[active], dim]
            remaining[active] -= bound[r, dim]
            left[active] -= 1
            out = full[r] & (scores[active] + remaining[active] <= threshold[r])
            alive[active[out]] = False
            active = active[~out & (left[active] > 0)]
        rows, cols, scores = rows[alive], cols[alive], scores[alive]
        # Merge the survivors of each query into its list.
        touched, first = np.unique(rows, return_index=True)
        for i, (r, lo) in enumerate(zip(touched, first, strict=True)):
            hi = first[i + 1] if i + 1 < len(first) else len(rows)
            s = np.concatenate([best_score[r, : held[r]], scores[lo:hi]])
            n = np.concatenate([best_id[r, : held[r]], names[cols[lo:hi]]])
            keep = np.lexsort((n, -s))[:k]
            held[r] = len(keep)
            best_score[r, : len(keep)], best_id[r, : len(keep)] = s[keep], n[keep]
    there = np.arange(k) < held[:, None]
    return np.repeat(query_ids, held), best_id[there], best_score[there].astype(np.int64)


def quantised(vectors: DataFrame, scale: int) -> DataFrame:
    """`(vec_id, v)`: floor(scale * x) of every component; vectors that are null or hold null or non-finite components go."""
    finite = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def top_k(vectors: DataFrame, queries_where: str, k: int = 20, scale: int = 64) -> DataFrame:
    """`(query_id, rank, vec_id, score)`: the k best of `vectors(vec_id, embedding, ...)` for every row that meets `queries_where`.

    Candidates are all rows but the query's own. Vectors without an id, null, or with null or non-finite
    components take no part; a shorter vector counts as filled with zeros. Of rows that share a vec_id, the
    smallest vector takes part. Other columns are ignored; an empty table gives an empty result.
    """
    base = settle(quantised(vectors, scale))
    queries = base.where(queries_where)
    shards = max(1, -(-base.count() // SHARD))
    blocks = max(1, -(-queries.count() // QUERIES))
    mixed = F.xxhash64("vec_id")
    whole = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    docs = base.select("vec_id", "v", F.pmod(mixed, F.lit(shards)).cast("int").alias("shard"), F.explode(whole(blocks)).alias("block"))
    asked = queries.select("vec_id", "v", F.pmod(mixed, F.lit(blocks)).cast("int").alias("block"), F.explode(whole(shards)).alias("shard"))

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        columns = [np.zeros(0, np.int64)] * 3
        if left.num_rows and right.num_rows:
            columns = search(left["vec_id"].to_numpy(), _matrix(left["v"]), right["vec_id"].to_numpy(), _matrix(right["v"]), k)
        return pa.table({name: pa.array(c, pa.int64()) for name, c in zip(("query_id", "vec_id", "score"), columns, strict=True)})

    found = docs.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(cell, "query_id long, vec_id long, score long")
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
