r"""Exact Jaccard join of word n-gram sets: size-banded tiles, hashed bitmaps, sorted-array intersection.

1. Sizes are cut into bands so that sets similar enough are in one band or in two that follow each other. A set of `n`
   n-grams shares one of its `n - ceil(t * n) + 1` first ones with every partner, in any order common to all sets. The order
   puts n-grams that many texts hold last; a bit map and a list of them, both of bounded size, come from one pass, and only
   the work depends on them.
2. A tile is one of those n-grams and one band: sets of the band, and sets of the band below beside them. First n-grams are
   shuffled once, as `(n-gram, doc_id, band)`; those that only one set holds end there.
3. Sets with one 128-bit print are copies; the smallest doc_id of a print stands for all.
4. Bitmaps of hashed n-grams, as wide as the band needs, bound the overlap from above:
   `|a and b| <= |a| - bits(a and not b)`. Pairs that the bound leaves are intersected on their full sorted arrays.
5. A tile's sets meet its smallest doc_id first. What is linked is contracted; only tiles that still hold several
   components compare sets across components, in blocks of bounded size. A pair inside a component
   would add nothing, so groups of near copies are never expanded.

Nothing is estimated: every pair at the threshold is found. The lists of the full sets are read again only for the
texts that the bound leaves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from vacanta.llm.components import components
from vacanta.llm.marks import bit_map, marked
from vacanta.llm.minhash import shingle_sets
from vacanta.llm.words import mix, words_of
from vacanta.llm.worker import release
from vacanta.session import settle

SIMILAR = 80
NGRAM = 5
# N-grams that come last: at most COMMON in a bit map of 2^COMMON_BITS bits (16 MB), at most LISTED of them in the order of their counts (3 MB).
COMMON, COMMON_BITS, LISTED = 2**23, 27, 2**18
# Counts above this one are alike when the shortest count that fits the list is looked for.
_TALL = 10_000
# First n-grams dealt to one task.
TASK_ROWS = 1_000_000
# Sets of one tile that are compared in one block.
BLOCK = 256
# Tiles of a set that its pairs look up to count once.
EARLIER = 32
# A key with more than one in HOT of the rows is dealt over SALTS tasks.
HOT, SALTS = 10_000, 32


def size_bands(similar: int = SIMILAR) -> np.ndarray:
    """Smallest size of each band: a set's partners of its own size or more are in its band or the next."""
    starts = [1]
    while starts[-1] < 2**40:
        starts.append(100 * starts[-1] // similar + 1)
    return np.array(starts)


def width(start: int) -> int:
    """Longs of a bitmap in a tile whose band begins at `start`: four to eight bits an n-gram, a power of two."""
    return max(4, 1 << (-(-start // 16) - 1).bit_length())


def _sets(column: pa.Array, ngram: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, number of rows, sorted distinct n-grams and their limits, chunk by chunk."""
    for words in words_of(column):
        yield words.row, words.rows, *shingle_sets(words, ngram)


@dataclass
class Order:
    """Which n-grams come late: those in the bit map after all others, those listed after these, by their place."""

    table: np.ndarray
    listed: np.ndarray
    place: np.ndarray

    def late(self, sets: np.ndarray) -> np.ndarray:
        late = marked(self.table, sets).astype(np.int64)
        if len(self.listed):
            there = np.flatnonzero(late)
            at = np.minimum(np.searchsorted(self.listed, sets[there]), len(self.listed) - 1)
            late[there] += np.where(self.listed[at] == sets[there], self.place[at] + 1, 0)
        return late


def common_ngrams(docs: DataFrame, ngram: int) -> Order:
    """N-grams that many texts hold, found in one pass.

    N-grams seen once in a batch of rows are not counted, so the order is about right; it has to be the same everywhere, no more.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            sets = [s for _, _, s, _ in _sets(batch.column(0), ngram)]
            grams, times = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_counts=True)
            often = times > 1
            shown = pa.array(np.append(grams[often].view(np.int64), 0)), pa.array(np.append(times[often], 0)), pa.array(np.append(np.zeros(int(often.sum()), np.int64), times.sum()))
            yield pa.RecordBatch.from_arrays(list(shown), names=["gram", "times", "all"])

    seen = settle(docs.select("text").mapInArrow(count, "gram long, times long, all long").groupBy("gram").agg(F.sum("times").alias("times"), F.sum("all").alias("all")))
    whole = seen.agg(F.sum("all")).first()[0] or 0
    heights = [(r["t"], r["count"]) for r in seen.where("times > 1").groupBy(F.least("times", F.lit(_TALL)).alias("t")).count().collect()]

    def least(room: int) -> int:
        """The smallest count, two at least, that no more than `room` n-grams reach."""
        # From this one on they cannot be more; a smaller one serves if the histogram shows that it fits.
        found, above = max(2, -(-whole // room)), 0
        for times, grams in sorted(heights, reverse=True):
            above += grams
            if above > room:
                break
            found = min(found, times)
        return found

    table = bit_map(seen.where(F.col("times") >= least(COMMON)).select("gram"), F.col("gram"), COMMON_BITS)
    rows = seen.where(F.col("times") >= least(LISTED)).select("gram", "times").toArrow()
    grams, times = rows.column("gram").to_numpy().view(np.uint64), rows.column("times").to_numpy()
    place = np.empty(len(grams), np.int32)
    place[np.lexsort((grams, times))] = np.arange(len(grams))
    order = np.argsort(grams)
    return Order(table, grams[order], place[order])


def first_ngrams(sets: np.ndarray, limits: np.ndarray, common: Order, similar: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams every partner of a row must share one of, and their limits."""
    n = np.diff(limits)
    wanted = np.where(n > 0, n - -(-n * similar // 100) + 1, 0)
    row = np.repeat(np.arange(len(n)), n)
    late = common.late(sets)
    early = late == 0
    before = np.concatenate([[0], np.cumsum(early)])
    taken = early & (before[:-1] - before[limits[:-1]][row] < wanted[row])
    lacking = np.flatnonzero(before[limits[1:]] - before[limits[:-1]] < wanted)
    for r in lacking:
        piece = slice(limits[r], limits[r + 1])
        taken[piece][np.argsort(late[piece], kind="stable")[: wanted[r]]] = True
    return sets[taken], np.concatenate([[0], np.cumsum(wanted)])


def bitmaps(sets: np.ndarray, limits: np.ndarray, longs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of `longs` longs for each row, one after the other, and their limits."""
    n = np.diff(limits)
    ends = np.concatenate([[0], np.cumsum(np.where(n > 0, longs, 0))])
    flags = np.zeros(64 * ends[-1], np.uint8)
    row = np.repeat(np.arange(len(n)), n)
    flags[64 * ends[:-1][row] + (mix(sets) & (64 * longs[row] - 1).astype(np.uint64)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").view(np.int64), ends


def _list(values: np.ndarray, limits: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(limits.astype(np.int32)), pa.array(values.view(np.int64)))


def _prints(docs: DataFrame, ngram: int) -> DataFrame:
    """Size and 128-bit print of every row's set."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for row, rows, sets, limits in _sets(batch.column(1), ngram):
                n = np.diff(limits)
                filled = np.flatnonzero(n)
                prints = np.zeros((2, rows), np.uint64)
                if len(filled):
                    for k, salt in enumerate((0x6A09E667F3BCC909, 0xBB67AE8584CAA73B)):
                        prints[k, filled] = np.add.reduceat(mix(sets ^ np.uint64(salt)), limits[filled])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, rows), pa.array(n), pa.array(prints[0].view(np.int64)), pa.array(prints[1].view(np.int64))], names=["doc_id", "n", "print_a", "print_b"])

    return docs.select("doc_id", "text").mapInArrow(sign, "doc_id long, n long, print_a long, print_b long")


class _Chosen:
    """Rows of `docs(doc_id, text, h)` whose id is in a table of ids (and few others), by a bit map of fixed size."""

    def __init__(self, docs: DataFrame, ids: DataFrame, ngram: int):
        self.docs, self.ngram = docs, ngram
        self.shared = docs.sparkSession.sparkContext.broadcast(bit_map(ids, F.xxhash64("id")))

    def read(self, make, schema: str) -> DataFrame:
        """What `make(ids, sets, limits)` gives for the chosen rows of each chunk, a column per field of the schema."""
        shared, ngram, names = self.shared, self.ngram, [f.split(" ")[0] for f in schema.split(", ")]

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            release()
            for batch in batches:
                batch = batch.filter(pa.array(marked(shared.value, batch.column(2).to_numpy())))
                for row, rows, sets, limits in _sets(batch.column(1), ngram):
                    yield pa.RecordBatch.from_arrays(make(batch.column(0).slice(row, rows), sets, limits), names=names)

        return self.docs.mapInArrow(step, schema)


def _entries(docs: DataFrame, heads: DataFrame, ngram: int, similar: int) -> DataFrame:
    """`(gram, id, band)`: the first n-grams of the heads, without those that one text alone holds."""
    shared = docs.sparkSession.sparkContext.broadcast(common_ngrams(docs, ngram))
    starts = size_bands(similar)

    def firsts(ids: pa.Array, sets: np.ndarray, limits: np.ndarray) -> list[pa.Array]:
        grams, ends = first_ngrams(sets, limits, shared.value, similar)
        owner = np.repeat(np.arange(len(ids)), np.diff(ends))
        band = np.searchsorted(starts, np.maximum(np.diff(limits), 1), side="right") - 1
        return [pa.array(grams.view(np.int64)), ids.take(pa.array(owner)), pa.array(band.astype(np.int32)[owner])]

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by n-gram; the last one of a batch waits for the next.
        held, last_grouped = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            grams = batch.column(0).to_numpy()
            before = np.concatenate([[held is not None and held.column(0)[0].as_py() == grams[0]], grams[1:] == grams[:-1]])
            if held is not None and (last_grouped or before[0]):
                yield held
            grouped = before.copy()
            grouped[:-1] |= before[1:]
            yield batch.slice(0, batch.num_rows - 1).filter(pa.array(grouped[:-1]))
            held, last_grouped = batch.slice(batch.num_rows - 1), bool(before[-1])
        if held is not None and last_grouped:
            yield held

    schema = "gram long, id long, band int"
    rows = heads.agg(F.sum("n")).first()[0] or 0
    tasks = max(8, -(-rows * (100 - similar) // 100 // TASK_ROWS))
    dealt = _Chosen(docs, heads.select("id"), ngram).read(firsts, schema).repartition(tasks, "gram").sortWithinPartitions("gram", "id")
    return dealt.mapInArrow(repeated, schema)


def _bitmaps(docs: DataFrame, ids: DataFrame, ngram: int, similar: int) -> DataFrame:
    """`(id, n, bits)` of the texts with these ids (and a few others); the bitmap is as wide as the tiles above the text's band need."""
    starts = size_bands(similar)
    widths = np.array([width(int(s)) for s in starts])

    def make(names: pa.Array, sets: np.ndarray, limits: np.ndarray) -> list[pa.Array]:
        band = np.searchsorted(starts, np.maximum(np.diff(limits), 1), side="right") - 1
        return [names, pa.array(np.diff(limits)), _list(*bitmaps(sets, limits, widths[band + 1]))]

    return settle(_Chosen(docs, ids, ngram).read(make, "id long, n long, bits array<long>").where("n > 0"))


def _narrowed(bits: Column, longs: Column) -> Column:
    """A bitmap of `longs` or of twice as many longs, in `longs`."""
    halves = F.zip_with(F.slice(bits, F.lit(1), longs), F.slice(bits, longs + 1, longs), lambda x, y: x.bitwiseOR(y))
    return F.when(F.size(bits) <= longs, bits).otherwise(halves)


def _only(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y)))), F.lit(0), lambda s, x: s + x)


def may_link(na: Column, a: Column, nb: Column, b: Column, similar: int) -> Column:
    """Whether sets of `na` and `nb` n-grams with these bitmaps, equally wide, can be similar enough."""
    sized = 100 * F.least(na, nb) >= similar * F.greatest(na, nb)
    return sized & ((100 + similar) * F.least(na - _only(a, b), nb - _only(b, a)) >= similar * (na + nb))


def _hot(rows: DataFrame, key: list[str], counted: DataFrame | None = None) -> DataFrame:
    """Keys that hold more than 1 in `HOT` of the rows: fewer than `HOT` keys, whatever the table."""
    counted = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("rows")) if counted is None else counted
    whole = counted.agg(F.sum("rows")).first()[0] or 0
    return counted.where(F.col("rows") > max(BLOCK, whole // HOT)).select(*key)


def _spread_join(big: DataFrame, small: DataFrame, key: list[str], hot: DataFrame) -> DataFrame:
    """Inner join with a side that is unique or nearly so on `key`; rows of hot keys are dealt over `SALTS` copies of it."""
    marks = F.broadcast(hot.withColumn("hot", F.lit(1)))
    big = big.join(marks, key, "left").withColumn("salt", F.when(F.col("hot") == 1, F.pmod(F.xxhash64("id"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")).drop("hot")
    last = F.when(F.col("hot") == 1, SALTS - 1).otherwise(0)
    small = small.join(marks, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), last))).drop("hot")
    return big.join(small, [*key, "salt"]).drop("salt")


def _both_ends(pairs: DataFrame, texts: DataFrame, names: list[str]) -> DataFrame:
    """Pairs `(a, b)` with the columns `names` of both texts, as `na`, `nb` and so on. An `a` may be in many pairs."""

    def side(letter: str, key: str) -> list[Column]:
        return [F.col("id").alias(key), *[F.col(c).alias(f"{c}_{letter}") for c in names]]

    one = pairs.join(texts.select(*side("b", "b")), "b").withColumnRenamed("b", "id")
    hubs = texts.join(pairs.select(F.col("a").alias("id")).distinct(), "id", "left_semi").select(*side("a", "a"))
    return _spread_join(one, hubs, ["a"], settle(_hot(pairs, ["a"]))).withColumnRenamed("id", "b")


def _linked(pairs: DataFrame, docs: DataFrame, ngram: int, similar: int) -> DataFrame:
    """The pairs `(a, b)` that are similar enough: sorted arrays of both texts, intersected."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = np.zeros(batch.num_rows, bool)
            for k in range(batch.num_rows):
                x, y = (batch.column(c)[k].values.to_numpy().view(np.uint64) for c in (2, 3))
                x, y = (x, y) if len(x) <= len(y) else (y, x)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                kept[k] = 100 * both >= similar * (len(x) + len(y) - both)
            yield batch.select([0, 1]).filter(pa.array(kept))

    read = _Chosen(docs, ids, ngram).read(lambda names, sets, limits: [names, _list(sets, limits)], "id long, grams array<long>")
    sets = settle(read.where(F.size("grams") > 0))
    met = _both_ends(pairs, sets, ["grams"]).select("a", "b", "grams_a", "grams_b")
    return settle(met.mapInArrow(meet, "a long, b long").distinct())


def ngram_join(docs: DataFrame, ngram: int = NGRAM, similar: int = SIMILAR) -> DataFrame:
    """`(doc_id, n_shingles, component_id)` per row of `docs(doc_id, text, ...)`.

    Texts are linked if 100 * intersection >= `similar` * union of their sets of `ngram` words in a row; a text of fewer words
    is one n-gram. Null or empty texts have an empty set and are linked with nothing. A null doc_id is linked with nothing and
    gets a null component. Rows that share a doc_id are one document: links of any of them count for all. Other
    columns are ignored. An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("doc_id").cast("long")).alias("h"))
    signed = settle(_prints(docs, ngram))
    key = ["print_a", "print_b", "n"]
    usable = signed.where("doc_id IS NOT NULL AND n > 0")
    heads = settle(usable.groupBy(*key).agg(F.min("doc_id").alias("id")))
    named = docs.where("doc_id IS NOT NULL")

    # Tiles: every set is in that of its own band and, for larger partners, in that of the next.
    entries = settle(_entries(named, heads, ngram, similar))
    placed = entries.withColumn("up", F.explode(F.array(F.lit(0), F.lit(1)))).select("gram", (F.col("band") + F.col("up")).alias("tile"), "id", "up")
    # Copies share many n-grams: of tiles that hold the same sets, one stays (two sums of 40-bit hashes tell them apart).
    held = [F.sum(F.shiftrightunsigned(F.xxhash64("id", "up", F.lit(k)), 24)).alias(f"held_{k}") for k in (0, 1)]
    tiles = placed.groupBy("gram", "tile").agg(F.min(F.when(F.col("up") == 0, F.col("id"))).alias("head"), F.count(F.lit(1)).alias("rows"), *held).where("rows > 1 AND head IS NOT NULL")
    tiles = settle(tiles.groupBy("tile", "head", "rows", "held_0", "held_1").agg(F.min("gram").alias("gram")).select("gram", "tile", "head", "rows"))
    hot = settle(_hot(placed, ["gram", "tile"], tiles))
    members = settle(_spread_join(placed, tiles, ["gram", "tile"], hot))
    star = settle(members.where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct())
    sized = _bitmaps(named, star.select(F.col("a").alias("id")).union(star.select("b")), ngram, similar)
    longs = F.least(F.size("bits_a"), F.size("bits_b"))
    possible = _both_ends(star, sized, ["n", "bits"]).where(may_link(F.col("n_a"), _narrowed(F.col("bits_a"), longs), F.col("n_b"), _narrowed(F.col("bits_b"), longs), similar))
    labels = components(_linked(settle(possible.select("a", "b").distinct()), named, ngram, similar))

    # Tiles that hold several components: sets outside the head's component meet all sets of other components, block by block.
    labelled = settle(members.select("gram", "tile", "id", "up", "head").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id")))
    mixed = labelled.groupBy("gram", "tile").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max(F.when(F.col("id") == F.col("head"), F.col("label"))).alias("major"), F.count(F.lit(1)).alias("rows"))
    # Two sets have met already: one of them is the head.
    mixed = settle(mixed.where("low < high AND rows > 2").drop("low", "high"))
    dealt = settle(_spread_join(labelled.drop("head"), mixed, ["gram", "tile"], hot))
    apart = dealt.where("label <> major").groupBy("gram", "tile").agg(F.count(F.lit(1)).alias("apart"))
    dealt = _spread_join(dealt, apart, ["gram", "tile"], hot).join(sized, "id")
    widths = F.array(*[F.lit(width(int(s))) for s in size_bands(similar)])
    dealt = settle(dealt.withColumn("bits", _narrowed(F.col("bits"), F.get(widths, F.col("tile")))).withColumn("tid", F.xxhash64("gram", "tile")))
    # A pair counts in the first tile it meets in, as far as both sets list their first tiles. Two sets of the band below do not meet.
    first_tiles = lambda c: F.slice(F.sort_array(F.collect_set(c)), 1, EARLIER)
    lists = dealt.groupBy("id").agg(first_tiles(F.col("tid")).alias("all"), first_tiles(F.when(F.col("up") == 0, F.col("tid"))).alias("own"))
    before = {c: F.filter(c, lambda t: t < F.col("tid")) for c in ("all", "own")}
    dealt = settle(dealt.join(lists, "id").withColumns(before))

    def side(rows: DataFrame, letter: str, own: str, own_blocks: str, other: str, other_blocks: str) -> DataFrame:
        each = F.sequence(F.lit(0).cast("long"), F.ceil(F.col(other_blocks) / BLOCK).cast("long") - 1)
        block = F.pmod(F.xxhash64("id"), F.ceil(F.col(own_blocks) / BLOCK).cast("long"))
        return rows.select("gram", "tile", block.alias(own), F.explode(each).alias(other), F.col("id").alias(letter), *[F.col(c).alias(f"{c}_{letter}") for c in ("up", "label", "n", "bits", "all", "own")], (F.col("label") != F.col("major")).alias(f"apart_{letter}"))

    left, right = side(dealt.where("label <> major"), "a", "i", "apart", "j", "rows"), side(dealt, "b", "j", "rows", "i", "apart")
    # Two sets of the band below meet in its own tile; two that are both apart meet twice here and count once.
    once = ((F.col("up_a") == 0) | (F.col("up_b") == 0)) & (~F.col("apart_b") | (F.col("a") < F.col("b")))
    earlier = F.arrays_overlap("all_a", "own_b") | F.arrays_overlap("own_a", "all_b")
    meeting = (F.col("label_a") != F.col("label_b")) & once & ~earlier & may_link(F.col("n_a"), F.col("bits_a"), F.col("n_b"), F.col("bits_b"), similar)
    across = left.join(right, ["gram", "tile", "i", "j"]).where(meeting).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    tried = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = _linked(settle(settle(across).join(tried, ["a", "b"], "left_anti")), named, ngram, similar)
    # Texts of one doc_id belong together.
    several = usable.groupBy("doc_id").agg(F.min(F.struct(*key)).alias("low"), F.max(F.struct(*key)).alias("high")).where("low < high").select("doc_id")
    together = usable.join(several, "doc_id", "left_semi").join(heads.select(*key, "id"), key).select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    final = components(labels.select(F.col("id").alias("a"), F.col("label").alias("b")).union(more).union(together))

    resolved = heads.join(final, "id", "left").select(*key, F.coalesce("label", "id").alias("component_id"))
    out = signed.join(resolved, key, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
