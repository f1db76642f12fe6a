"""Benchmark decontamination by greedy string tiling.

1. Fingerprints (Karp-Rabin) of every window of `MATCH` words of the benchmark, and a bit map of them whose
   size is fixed, so that it can be broadcast whatever the benchmark.
2. One pass over the texts keeps the windows whose bit is set; an equality join with the distinct fingerprints of each item
   leaves the windows that a text shares with it. No text is shuffled, and a window travels once, however often the item repeats it.
3. For each text and item, tiles: a run of equal windows on one diagonal is a match, and the longest match
   whose words are not marked yet is marked, again and again, down to `MATCH` words. Order does not matter,
   so passages moved around are covered all the same. Matches are found by their first windows only, so words said
   over and over make few of them.
4. A text is contaminated by an item if its tiles cover at least `COVERAGE` of the item's words.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased: punctuation does not hide a match.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vacanta.llm.words import PUNCTUATION, windows, words_of
from vacanta.llm.worker import release
from vacanta.session import settle

MATCH = 4
COVERAGE = 0.5
# Bits of the map (2 MB); a benchmark of very many windows only lets more of them through to the join.
MAP_BITS = 24


def seeds_of(column: pa.Array, match: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Row of the first text of a chunk, and for each of its windows: row, position, fingerprint; last the word counts."""
    for words in words_of(column, apart=PUNCTUATION):
        prints = windows(words.hashes, match)
        count = np.maximum(words.counts - match + 1, 0)
        row = np.repeat(np.arange(words.rows), count)
        position = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        yield words.row, row, position, prints[words.first[:-1][row] + position] if len(row) else prints[:0], words.counts


def matches(text_at: np.ndarray, text_seed: np.ndarray, item_at: np.ndarray, item_seed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text window, item window and number of windows of every longest run of equal windows.

    A run begins where two windows are equal and those before them are not, so only such pairs are formed: windows
    are grouped by their own fingerprint and the one before.
    """
    # Numbers in place of fingerprints: 0 where nothing is known, the same for equal windows.
    seeds, both = np.unique(np.concatenate([text_seed, item_seed]), return_inverse=True)
    text, item = np.zeros(int(text_at.max()) + 3, np.int64), np.full(int(item_at.max()) + 3, -1, np.int64)
    text[text_at + 1], item[item_at + 1] = both[: len(text_at)] + 1, both[len(text_at) :] + 1

    def grouped(line: np.ndarray) -> dict[int, dict[int, np.ndarray]]:
        at = np.flatnonzero(line > 0)
        order = at[np.lexsort((at, line[at - 1], line[at]))]
        cuts = np.flatnonzero((np.diff(line[order]) != 0) | (np.diff(line[order - 1]) != 0)) + 1
        groups: dict[int, dict[int, np.ndarray]] = {}
        for piece in np.split(order, cuts):
            groups.setdefault(int(line[piece[0]]), {})[int(line[piece[0] - 1])] = piece
        return groups

    of_text, of_item = grouped(text), grouped(item)
    starts_t, starts_i = [], []
    for seed, befores in of_text.items():
        for before, at in befores.items():
            for other, there in of_item.get(seed, {}).items():
                if before != other:
                    starts_t.append(np.repeat(at, len(there)))
                    starts_i.append(np.tile(there, len(at)))
    t, i = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts_t, starts_i))
    length, alive, n = np.ones(len(t), np.int64), np.arange(len(t)), 1
    while len(alive):
        alive = alive[(t[alive] + n < len(text)) & (i[alive] + n < len(item))]
        alive = alive[text[t[alive] + n] == item[i[alive] + n]]
        length[alive] += 1
        n += 1
    return t - 1, i - 1, length


def tiles(text_at: np.ndarray, text_seed: np.ndarray, item_at: np.ndarray, item_seed: np.ndarray, match: int = MATCH) -> list[tuple[int, int, int]]:
    """Tiles `(text word, item word, words)` from the windows of a text and an item (place and fingerprint), longest first."""
    if not len(text_at) or not len(item_at):
        return []
    t, i, windows_ = matches(text_at, text_seed, item_at, item_seed)
    n = windows_ + match - 1
    order = np.lexsort((t, i, -n))
    waiting = iter(zip((-n[order]).tolist(), i[order].tolist(), t[order].tolist()))
    heap: list[tuple[int, int, int]] = []  # what is left of matches that were cut
    in_text, in_item = np.zeros(int(text_at.max()) + match, bool), np.zeros(int(item_at.max()) + match, bool)
    out, following = [], next(waiting, None)
    while heap or following:
        if following and (not heap or following < heap[0]):
            (n, i, t), following = following, next(waiting, None)
        else:
            n, i, t = heapq.heappop(heap)
        n = -n
        marked = in_text[t : t + n] | in_item[i : i + n]
        if not marked.any():
            in_text[t : t + n], in_item[i : i + n] = True, True
            out.append((t, i, n))
            free = np.flatnonzero(np.diff(np.concatenate([[True], in_item, [True]])))
            if not len(free) or np.diff(free)[::2].max() < match:
                break  # no run of free item words is long enough
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[True], marked, [True]])))
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if end - start >= match:
                heapq.heappush(heap, (-(end - start), i + start, t + start))
    return out


def benchmark_seeds(benchmark: DataFrame, match: int) -> DataFrame:
    """`(item_id, variant, item_words, item_at, seed)` for every window of `benchmark(item_id, text, ...)`; `variant` is the text's hash."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, row, position, prints, counts in seeds_of(batch.column(2), match):
                keys = [batch.column(k).slice(first, len(counts)).take(pa.array(row)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(counts[row]), pa.array(position), pa.array(prints.view(np.int64))], names=["item_id", "variant", "item_words", "item_at", "seed"])

    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64("text").alias("variant"), "text").mapInArrow(cut, "item_id long, variant long, item_words long, item_at long, seed long")


def contaminated(docs: DataFrame, benchmark: DataFrame, match: int = MATCH, coverage: float = COVERAGE) -> DataFrame:
    """`(doc_id, body, item_id, item_words, covered, coverage, tiles)`: one row per contaminated text and item.

    `body` is the xxhash64 of the text, which tells rows of one doc_id apart; rows that are alike throughout
    give one row, and a text without a doc_id is found like others. `tiles` are structs of word positions in the text and the
    item and a length. Null and empty texts, and items of fewer than `match` words, match nothing. Items that
    share an item_id are several texts, each compared by itself. Other columns are ignored; empty tables give an empty result.
    """
    spark = docs.sparkSession
    seeds = settle(benchmark_seeds(benchmark, match).where("item_id IS NOT NULL").distinct())
    bit = F.shiftrightunsigned("seed", 64 - MAP_BITS)
    # At most 2^(MAP_BITS - 6) rows.
    bits = seeds.groupBy(F.shiftrightunsigned(bit, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(seed, {64 - MAP_BITS}) & 63 as int))")).alias("bits")).collect()
    table = np.zeros(2 ** (MAP_BITS - 6), np.int64)
    for r in bits:
        table[r["at"]] = r["bits"]
    shared = spark.sparkContext.broadcast(table.view(np.uint64))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        known = shared.value
        for batch in batches:
            for first, row, position, prints, _ in seeds_of(batch.column(2), match):
                short = prints >> np.uint64(64 - MAP_BITS)
                there = np.flatnonzero((known[short >> np.uint64(6)] >> (short & np.uint64(63))) & np.uint64(1))
                rows = pa.array(first + row[there])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(position[there]), pa.array(prints[there].view(np.int64))], names=["doc_id", "body", "text_at", "seed"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("body"), "text")
    item = ["item_id", "variant", "item_words"]
    found = texts.mapInArrow(hits, "doc_id long, body long, text_at long, seed long").join(seeds.select(*item, "seed").distinct(), "seed")
    grouped = found.groupBy("doc_id", "body", *item).agg(F.collect_set(F.struct("text_at", "seed")).alias("here"))
    # A window covers `match` words at most, so fewer windows than this cannot reach the threshold.
    enough = grouped.where(F.size("here") * match >= F.ceil(F.col("item_words") * coverage))
    items = seeds.groupBy(*item).agg(F.collect_list(F.struct("item_at", "seed")).alias("there"))
    enough = enough.join(items, item)

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def columns(cell: pa.ListScalar, place: str) -> tuple[np.ndarray, np.ndarray]:
            return cell.values.field(place).to_numpy(), cell.values.field("seed").to_numpy()

        for batch in batches:
            here, there = batch.column("here"), batch.column("there")
            laid = [tiles(*columns(here[k], "text_at"), *columns(there[k], "item_at"), match) for k in range(batch.num_rows)]
            lists = pa.array([[{"text_at": t, "item_at": i, "words": n} for t, i, n in x] for x in laid], pa.list_(pa.struct([("text_at", pa.int64()), ("item_at", pa.int64()), ("words", pa.int64())])))
            keys = [batch.column(c) for c in ("doc_id", "body", "item_id", "item_words")]
            yield pa.RecordBatch.from_arrays([*keys, pa.array([sum(n for _, _, n in x) for x in laid], pa.int64()), lists], names=["doc_id", "body", "item_id", "item_words", "covered", "tiles"])

    laid = enough.mapInArrow(tile, "doc_id long, body long, item_id long, item_words long, covered long, tiles array<struct<text_at: long, item_at: long, words: long>>")
    return laid.where(F.col("covered") >= F.col("item_words") * coverage).select("doc_id", "body", "item_id", "item_words", "covered", (F.col("covered") / F.col("item_words")).alias("coverage"), "tiles")
