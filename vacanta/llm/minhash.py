r"""Near-duplicates by b-bit MinHash, links confirmed on full shingle sets.

1. One pass over the texts gives each row its number of distinct shingles, a 128-bit print of the set, the low
   `BITS` bits of `MINIMA` minima packed in longs, and the keys of `BANDS` bands of `ROWS` whole minima.
2. Rows with one print are copies; the smallest doc_id of a print stands for all of them.
3. Band candidates: members of a band bucket meet the bucket's first id only (never each other). Pairs whose
   collision-corrected estimate (bit counts of packed signatures) is far below the threshold go; the rest is
   confirmed by intersecting the full sets.
4. Buckets that still hold several components compare their members across components by the bit counts of
   longer signatures (texts of `SMALL` shingles or fewer by size alone), inside an equality join; large buckets are cut into blocks of bounded size, so no task
   holds a bucket. Pairs that may be similar are confirmed on full sets, too.

A link at the threshold itself is missed with a probability below 1 in 10,000 (no common band: 3.4e-5; an estimate
too low: 3e-5); with higher similarity it falls fast.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from vacanta.llm.components import components
from vacanta.llm.marks import bit_map, marked, rows_of
from vacanta.llm.words import Words, mix, windows, words_of
from vacanta.llm.worker import release
from vacanta.session import settle

SHINGLE = 5
MINIMA = 192
BANDS, ROWS = 38, 5
BITS = 4
LONGS = MINIMA * BITS // 64
SIMILAR = 75
# A second, longer signature for the members of mixed buckets.
FINE_MINIMA, FINE_BITS = 1024, 2
# Standard deviations below the threshold at which an estimate gives a pair up: 3 links in 100,000 at the threshold itself.
SURE = 4
# Pairs of sets of at most so many shingles are not estimated: they go to the full sets at once.
SMALL = 10
# Members of a bucket that are compared in one block.
BLOCK = 256

_RANDOM = np.random.RandomState(75_005)
_FINE = _RANDOM.randint(0, 2**62, FINE_MINIMA, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = _RANDOM.randint(0, 2**62, MINIMA, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _RANDOM.randint(0, 2**62, (BANDS, ROWS), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_PRINT = "n_shingles long, print_a long, print_b long"


def shingle_sets(words: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted, and the index of each row's first one (one more at the end)."""
    count = words.counts
    per_row = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(per_row)])
    out = np.empty(first[-1], np.uint64)
    whole = windows(words.hashes, k)
    long_rows = count >= k
    rows = np.flatnonzero(long_rows)
    for r in rows:
        piece = whole[words.first[r] : words.first[r + 1] - k + 1]
        out[first[r] : first[r + 1]] = piece
        out[first[r] : first[r + 1]].sort()
    for r in np.flatnonzero((count > 0) & ~long_rows):
        n = count[r]
        out[first[r]] = windows(words.hashes[words.first[r] : words.first[r + 1]], n)[0] ^ np.uint64(n)
    if not len(out):
        return out, first
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[first[:-1][first[:-1] < len(out)]] = True
    kept = np.concatenate([[0], np.cumsum(new)])
    return out[new], kept[first]


def signatures(sets: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
    """Prints, packed low bits and band keys of the non-empty rows (`rows` holds their indices)."""
    rows = np.flatnonzero(np.diff(first))
    at = first[rows]
    a = np.add.reduceat(mix(sets + np.uint64(0x5851F42D4C957F2D)), at) if len(rows) else np.zeros(0, np.uint64)
    b = np.add.reduceat(mix(sets ^ np.uint64(0x14057B7EF767814F)), at) if len(rows) else np.zeros(0, np.uint64)
    minima = np.empty((MINIMA, len(rows)), np.uint64)
    if len(rows):
        for j, factor in enumerate(_FACTORS):
            minima[j] = np.minimum.reduceat(sets * factor, at)
    packed = _packed(minima, BITS)
    bands = np.stack([mix((minima[k * ROWS : (k + 1) * ROWS] * _BAND[k][:, None]).sum(axis=0, dtype=np.uint64) + np.uint64(k)) for k in range(BANDS)]) if len(rows) else np.zeros((BANDS, 0), np.uint64)
    return {"rows": rows, "a": a, "b": b, "packed": packed, "bands": bands.T}


def _packed(minima: np.ndarray, bits: int) -> np.ndarray:
    """Low bits of mixed minima (one row per hash function), packed in longs (one row per text).

    Unmixed, the low bits of x * factor depend on the low bits of x alone: two shingles would collide under all functions or none.
    """
    per_long = 64 // bits
    low = (mix(minima) & np.uint64(2**bits - 1)).reshape(len(minima) // per_long, per_long, minima.shape[1])
    return reduce(np.bitwise_or, [low[:, i] << np.uint64(bits * i) for i in range(per_long)]).T


def _fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for words in words_of(batch.column(1)):
            sets, first = shingle_sets(words)
            rows = np.flatnonzero(np.diff(first))
            minima = np.empty((FINE_MINIMA, len(rows)), np.uint64)
            if len(rows):
                for j, factor in enumerate(_FINE):
                    minima[j] = np.minimum.reduceat(sets * factor, first[rows])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(words.row, words.rows), pa.array(np.diff(first)), _lists(_packed(minima, FINE_BITS), rows, words.rows)], names=["id", "n", "fine"])


def _lists(values: np.ndarray, filled: np.ndarray, n: int) -> pa.Array:
    """One list of longs per row, empty for rows that have no set."""
    width = np.zeros(n, np.int32)
    width[filled] = values.shape[1]
    flat = np.ascontiguousarray(values).view(np.int64).reshape(-1)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(width)]).astype(np.int32)), pa.array(flat))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        for words in words_of(batch.column(1)):
            sets, first = shingle_sets(words)
            s = signatures(sets, first)
            prints = np.zeros((2, words.rows), np.uint64)
            prints[0, s["rows"]], prints[1, s["rows"]] = s["a"], s["b"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(words.row, words.rows), pa.array(np.diff(first)), pa.array(prints[0].view(np.int64)), pa.array(prints[1].view(np.int64)),
                 _lists(s["packed"], s["rows"], words.rows), _lists(s["bands"], s["rows"], words.rows)],
                names=["doc_id", "n_shingles", "print_a", "print_b", "packed", "bands"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for words in words_of(batch.column(1)):
            sets, first = shingle_sets(words)
            lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(sets.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(words.row, words.rows), lists], names=["id", "shingles"])


def estimated(a: Column, b: Column, minima: int = MINIMA, bits: int = BITS) -> Column:
    """Similarity from packed signatures: equal groups of bits counted, chance collisions taken out."""
    unequal = F.lit(0)
    low = F.lit(sum(1 << i for i in range(0, 64, bits)))
    for i in range(minima * bits // 64):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        folded = reduce(lambda y, j: y.bitwiseOR(F.shiftrightunsigned(x, j)), range(1, bits), x)
        unequal = unequal + F.bit_count(folded.bitwiseAND(low))
    chance = 2.0**-bits
    return (1 - unequal / F.lit(float(minima)) - chance) / (1 - chance)


def least_estimate(minima: int, bits: int) -> float:
    """The estimate below which a pair is given up."""
    chance = 2.0**-bits
    equal = chance + (1 - chance) * SIMILAR / 100
    return SIMILAR / 100 - SURE * (equal * (1 - equal) / minima) ** 0.5 / (1 - chance)


def _confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs `(a, b)` whose full sets reach the threshold. Texts are read again for the ids in question, and no text is shuffled."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b"))
    sets = settle(rows_of(docs, ids, _sets, "id long, shingles array<long>").where(F.size("shingles") > 0))
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    shared = F.size(F.array_intersect("sa", "sb"))
    return settle(
        pairs.join(left, "a").join(right, "b").select("a", "b", shared.alias("shared"), (F.size("sa") + F.size("sb") - shared).alias("all")).where(F.expr(f"100 * shared >= {SIMILAR} * all")).select("a", "b")
    )


def _repeated(heads: DataFrame, buckets: DataFrame) -> DataFrame:
    """`(id, band, k)`: the bands of each text that another text may share."""
    shared = heads.sparkSession.sparkContext.broadcast(bit_map(buckets, F.col("band")))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bands = batch.column(1).flatten().to_numpy()
            there = np.flatnonzero(marked(shared.value, bands))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(there // BANDS)), pa.array(bands[there]), pa.array((there % BANDS).astype(np.int32))], names=["id", "band", "k"])

    return heads.select("id", "bands").mapInArrow(keep, "id long, band long, k int")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """`(doc_id, n_shingles, component_id, kept)` per row of `docs(doc_id, text, ...)`.

    Null or empty texts have an empty set, are linked with nothing and kept. A null doc_id is linked with
    nothing, gets a null component and is kept. Rows that share a doc_id are one document: links of any of
    them count for all. Other columns are ignored. An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    signed = settle(docs.mapInArrow(_sign, f"doc_id long, {_PRINT}, packed array<long>, bands array<long>"))
    usable = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    key = ["print_a", "print_b", "n_shingles"]
    # One row per print: the smallest doc_id and its own signature.
    heads = settle(usable.groupBy(*key).agg(F.min("doc_id").alias("id"), F.min_by(F.struct("packed", "bands"), "doc_id").alias("s")).select(*key, "id", F.col("n_shingles").alias("n"), "s.*"))
    firsts = heads.select(*key, "id")
    every_band = heads.select("id", F.explode("bands").alias("band"))
    buckets = settle(every_band.groupBy("band").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("size")).where("size > 1"))
    # Most buckets hold one text; what follows reads the others only.
    members = settle(_repeated(heads, buckets).join(buckets.select("band", "head"), "band"))
    packed = heads.select("id", "n", "packed")
    star = members.where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()
    small = F.greatest("na", "nb") <= SMALL
    similar = small | (estimated(F.col("pa"), F.col("pb")) >= least_estimate(MINIMA, BITS))
    star = settle(
        star.join(packed.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("packed").alias("pa")), "a").join(packed.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("packed").alias("pb")), "b").where(similar).select("a", "b").distinct()
    )
    links = _confirmed(star, docs)
    labels = components(links)

    # Buckets that hold more than one component: members of different components meet, block by block.
    placed = members.join(labels, "id", "left").select("id", "band", "k", F.coalesce("label", "id").alias("label"))
    mixed = placed.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("size")).where("low < high")
    open_members = settle(placed.join(mixed.select("band", "size"), "band"))
    fine = settle(rows_of(docs, open_members.select("id"), _fine, "id long, n long, fine array<long>").where("n > 0").distinct())
    # Sets of too different a size cannot be similar enough.
    alike = (100 * F.least("na", "nb") >= SIMILAR * F.greatest("na", "nb")) & (small | (estimated(F.col("pa"), F.col("pb"), FINE_MINIMA, FINE_BITS) >= least_estimate(FINE_MINIMA, FINE_BITS)))
    # A pair is taken in the first band it shares, once.
    alike = alike & ~F.arrays_overlap(F.slice("ba", F.lit(1), F.col("k")), F.slice("bb", F.lit(1), F.col("k")))
    blocks = F.ceil(F.col("size") / BLOCK).cast("long")
    dealt = open_members.join(fine, "id").join(heads.select("id", "bands"), "id").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")))
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    left = dealt.select("band", "k", F.col("bands").alias("ba"), F.col("own").alias("i"), F.explode(every).alias("j"), F.col("id").alias("a"), F.col("label").alias("la"), F.col("n").alias("na"), F.col("fine").alias("pa"))
    right = dealt.select("band", F.col("bands").alias("bb"), F.col("own").alias("j"), F.explode(every).alias("i"), F.col("id").alias("b"), F.col("label").alias("lb"), F.col("n").alias("nb"), F.col("fine").alias("pb"))
    across = left.join(right, ["band", "i", "j"]).where((F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & alike).select("a", "b").distinct()
    # Every link between representatives stays in one table; both kinds of link meet in the final components.
    more = _confirmed(settle(settle(across).join(star.select("a", "b"), ["a", "b"], "left_anti")), docs)
    # Labels of the first round stand for its links.
    final = settle(components(labels.select(F.col("id").alias("a"), F.col("label").alias("b")).union(more)))

    resolved = firsts.join(final, "id", "left").select(*key, F.coalesce("label", "id").alias("component_id"))
    out = signed.join(resolved, key, "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
