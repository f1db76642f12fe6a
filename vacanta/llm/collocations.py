r"""Phrase collocations by prefix-free parsing: n-grams are counted inside distinct chunks, weighted by the chunk's frequency.

1. Texts are cut into pieces at punctuation and line ends, pieces into words. A word whose hash says so opens a chunk, whatever
   stands around it, so equal passages are cut alike wherever they occur. A chunk also holds the `longest - 1` words
   that follow it in its piece: chunks overlap, and an n-gram belongs to the one chunk that owns its first word.
2. The dictionary holds each distinct chunk of a language once, with its frequency in the parse. One shuffle; passages
   that many documents share are counted once from here on.
3. One pass over the dictionary adds up words and pairs of words as 64-bit hashes, a second one longer n-grams
   whose pairs are all frequent (a phrase is never more frequent than a part of it). A bit map of fixed size holds
   the frequent pairs; one n-gram too many in it costs a row, never a result.
4. A last pass spells the frequent phrases out. Every chunk has one of 256 places, set by its words, and counts carry the
   smallest place an n-gram is found at: a phrase is spelled from chunks of that place only. Cuts, scores and the test against longer phrases are equality joins.

Texts are never shuffled as rows of words, and only chunks and counts travel.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from vacanta.llm.marks import bit_map, marked
from vacanta.llm.words import hashed, located, lowered, mix, weights, windows
from vacanta.llm.worker import release
from vacanta.session import settle, skew_join

LEAST, LONGEST, TOP = 30, 4, 2000
# Share of a phrase's occurrences that a longer one must have to take its place, in percent.
COVERED = 80
FACTOR = 2_000_000
UNKNOWN = "und"
# One word in so many opens a chunk.
TRIGGER = 16
# Occurrences of n-grams one reading task adds up, about.
TASK_ROWS = 1_000_000
_APART = np.zeros(256, bool)
_APART[[0x20, 0x09, *range(0x0A, 0x0E), *b".,;:!?"]] = True
_CUTS = np.zeros(256, bool)
_CUTS[[*range(0x0A, 0x0E), *b".,;:!?"]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09]] = True
# Chunks are dealt to so many places, as a power of two.
PLACES = 8
# N-grams added up in a worker before they are handed on.
_HELD = 2_000_000
_ORDER = 0x9FB21C651E98DF25
_SEEN = 1_000_000


def parsed(docs: DataFrame, longest: int, trigger: int = TRIGGER) -> DataFrame:
    """The dictionary `(lang, own, chunk, times)` of `docs(lang, text)`: `own` words of the chunk are its own, the others follow."""
    values = weights(_APART)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for row, limits, text in lowered(batch.column(1)):
                if not len(text):
                    continue
                starts, first = located(text, limits, _APART)
                if not len(starts):
                    continue
                closes = ~_APART[text]
                closes[:-1] &= _APART[text[1:]]
                closes[limits[1:][limits[1:] > 0] - 1] = ~_APART[text[limits[1:][limits[1:] > 0] - 1]]
                ends = np.flatnonzero(closes) + 1
                cuts = np.cumsum(_CUTS[text])[starts]
                fresh = np.ones(len(starts), bool)
                fresh[1:] = cuts[1:] != cuts[:-1]
                fresh[first[:-1][first[:-1] < len(starts)]] = True
                opens = np.flatnonzero(fresh | (hashed(text, starts, values) % np.uint64(trigger) == 0))
                after = np.append(opens[1:], len(starts))
                pieces = np.append(np.flatnonzero(fresh), len(starts))
                last = np.minimum(after + longest - 1, pieces[np.searchsorted(pieces, opens, side="right")])
                begin, length = starts[opens], ends[last - 1] - starts[opens]
                offsets = np.concatenate([[0], np.cumsum(length)])
                inside = text[np.arange(offsets[-1]) + np.repeat(begin - offsets[:-1], length)]
                chunks = pa.StringArray.from_buffers(len(opens), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(inside)))
                owner = pa.array(row + np.searchsorted(first, opens, side="right") - 1)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), pa.array((after - opens).astype(np.int32)), chunks], names=["lang", "own", "chunk"])

    rows = docs.mapInArrow(cut, "lang string, own int, chunk string")
    return rows.groupBy("lang", "own", "chunk").agg(F.count(F.lit(1)).alias("times"))


class _Chunks:
    """Words of a batch of chunks `(lang, own, chunk, times)`, and the keys of their n-grams."""

    def __init__(self, batch: pa.RecordBatch, row: int, limits: np.ndarray, text: np.ndarray):
        self.text, part = text, batch.slice(row, len(limits) - 1)
        self.starts, self.first = located(text, limits, _BLANK)
        self.hashes = hashed(text, self.starts, weights(_BLANK))
        counts = np.diff(self.first)
        owner = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(len(owner)) - self.first[:-1][owner]
        self.left = counts[owner] - place
        self.own = place < part.column(1).to_numpy()[owner]
        self.times = part.column(3).to_numpy()[owner]
        names = part.column(0).dictionary_encode()
        salts = np.array([int.from_bytes(blake2b((n or "").encode(), digest_size=8).digest()) for n in names.dictionary.to_pylist()] or [0], np.uint64)
        self.lang, self.names = names.indices.to_numpy()[owner], names.dictionary.to_pylist()
        self.salt = salts[self.lang] if len(owner) else np.zeros(0, np.uint64)
        self.ends = limits[1:][owner]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.hashes, dtype=np.uint64)])
        self.at = (mix(sums[self.first[1:]] - sums[self.first[:-1]]) >> np.uint64(64 - PLACES))[owner]

    def keys(self, k: int, at: np.ndarray) -> np.ndarray:
        """Keys of the n-grams of `k` words that begin at the words `at`."""
        return mix(windows(self.hashes, k)[at] ^ (self.salt[at] + np.uint64(k * _ORDER % 2**64))) if len(at) else np.zeros(0, np.uint64)

    def starting(self, k: int) -> np.ndarray:
        """Words owned by their chunk that begin an n-gram of `k` words."""
        return np.flatnonzero(self.own & (self.left >= k))

    def phrase(self, at: int, k: int) -> str:
        end = self.starts[at + k] if self.left[at] > k else self.ends[at]
        return " ".join(w for w in bytes(self.text[self.starts[at] : end]).decode().replace("\t", " ").split(" ") if w)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[_Chunks]:
    for batch in batches:
        for row, limits, text in lowered(batch.column(2)):
            if len(text):
                yield _Chunks(batch, row, limits, text)


def _sums(parts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Keys with their summed weights and smallest places, `_HELD` occurrences at a time.

    The place is in the lowest bits of `seen`, the weight above: one number takes less of a shuffle file than two.
    """

    def added(keys: list, times: list, places: list) -> pa.RecordBatch:
        key, weight, place = np.concatenate(keys), np.concatenate(times), np.concatenate(places)
        order = np.argsort(key)
        key, weight, place = key[order], weight[order], place[order]
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        seen = (np.add.reduceat(weight, new) << PLACES) | np.minimum.reduceat(place, new).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(key[new].view(np.int64)), pa.array(seen)], names=["key", "seen"])

    keys, times, places, held = [], [], [], 0
    for key, weight, place in parts:
        if len(key):
            keys.append(key)
            times.append(weight)
            places.append(place)
            held += len(key)
        if held >= _HELD:
            yield added(keys, times, places)
            keys, times, places, held = [], [], [], 0
    if held:
        yield added(keys, times, places)


def _frequent(rows: DataFrame, words: int, least: int) -> DataFrame:
    """`(key, a, at)` of keys counted `least` times or more. Most keys are rare, so rows are dealt by key before they are added up."""
    tasks = max(8, -(-words // TASK_ROWS))
    times, place = F.shiftright("seen", PLACES), F.col("seen").bitwiseAND(F.lit(2**PLACES - 1))
    return settle(rows.repartition(tasks, "key").groupBy("key").agg(F.sum(times).alias("a"), F.min(place).alias("at")).where(F.col("a") >= least))


def counted(book: DataFrame, words: int, longest: int, least: int) -> DataFrame:
    """`(key, a, at)` of every n-gram of up to `longest` words that occurs `least` times or more, `at` its smallest place; `words` is their number."""

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _sums((c.keys(k, at), c.times[at], c.at[at]) for c in _read(batches) for k in (1, 2) for at in [c.starting(k)])

    few = _frequent(book.mapInArrow(short, "key long, seen long"), words, least)
    if longest < 3:
        return few
    pairs = book.sparkSession.sparkContext.broadcast(bit_map(few, F.col("key")))

    def longer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for c in _read(batches):
                whole = np.zeros(len(c.starts) + longest, bool)
                at = np.flatnonzero(c.left >= 2)
                whole[at] = marked(pairs.value, c.keys(2, at))
                going = whole[: len(c.starts)]
                for k in range(3, longest + 1):
                    going = going & whole[k - 2 : k - 2 + len(c.starts)]
                    at = np.flatnonzero(going & c.own & (c.left >= k))
                    yield c.keys(k, at), c.times[at], c.at[at]

        yield from _sums(parts())

    return few.union(_frequent(book.mapInArrow(longer, "key long, seen long"), words // 4, least))


def spellings(book: DataFrame, frequent: DataFrame, longest: int) -> DataFrame:
    """`(key, lang, phrase, lefts, rights, insides)` of the frequent phrases of 2 words or more, and a few others.

    A phrase is spelled where a chunk of its smallest place holds it: once in most cases, however many tasks meet it.
    """
    spark = book.sparkSession.sparkContext
    shared = spark.broadcast(bit_map(frequent, F.col("key")))
    placed = spark.broadcast(bit_map(frequent, F.col("key").bitwiseXOR(F.shiftleft("at", 64 - PLACES))))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for c in _read(batches):
            for k in range(2, longest + 1):
                at = c.starting(k)
                keys = c.keys(k, at)
                there = np.flatnonzero(marked(shared.value, keys))
                there = there[marked(placed.value, keys[there] ^ (c.at[at[there]] << np.uint64(64 - PLACES)))]
                keys, which = np.unique(keys[there], return_index=True)
                new = np.array([x not in seen for x in keys.tolist()], bool)
                keys, at = keys[new], at[there][which[new]]
                if not len(keys):
                    continue
                if len(seen) > _SEEN:
                    seen.clear()
                seen.update(keys.tolist())

                def lists(columns: list[np.ndarray]) -> pa.Array:
                    flat = np.stack(columns, axis=1).ravel() if columns else np.zeros(0, np.uint64)
                    return pa.ListArray.from_arrays(pa.array((np.arange(len(keys) + 1) * len(columns)).astype(np.int32)), pa.array(flat.view(np.int64)))

                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), pa.array([c.names[x] for x in c.lang[at]], pa.string()), pa.array([c.phrase(x, k) for x in at.tolist()], pa.string()),
                     lists([c.keys(m, at) for m in range(1, k)]), lists([c.keys(k - m, at + m) for m in range(1, k)]),
                     lists([c.keys(m, at + x) for m in range(2, k) for x in range(k - m + 1)])],
                    names=["key", "lang", "phrase", "lefts", "rights", "insides"],
                )

    return book.mapInArrow(spell, "key long, lang string, phrase string, lefts array<long>, rights array<long>, insides array<long>")


def spelled(book: DataFrame, frequent: DataFrame, longest: int) -> DataFrame:
    """`(key, lang, phrase, lefts, rights, insides, a)` of the frequent phrases of 2 words or more.

    `lefts` and `rights` are the keys of both sides of every cut, `insides` those of the phrases of 2 words or more inside.
    """
    found = spellings(book, frequent, longest)
    one = found.groupBy("key").agg(F.min(F.struct("lang", "phrase", "lefts", "rights", "insides")).alias("p")).select("key", "p.*")
    return settle(one.join(frequent.select("key", "a"), "key"))


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, covered: int = COVERED, top: int = TOP) -> DataFrame:
    """`(lang, rank, phrase, a, l, r, n, score)`: the `top` phrases of each language of `docs(lang, text, ...)`.

    A phrase is 2 to `longest` words in a row inside a piece, found `least` times or more. `l` and `r` are the
    counts of both sides of its lowest-scoring cut, `n` the words of the language, `score` is `2000000 * a / (l + r)`
    rounded down. Phrases inside a longer one with `covered` percent of their count or more are left out.
    A null lang is `und`, a null text is empty; repeated rows count again. Other columns are ignored. An empty table, or one
    without phrases as frequent, gives an empty result.
    """
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("string").alias("text"))
    book = settle(parsed(docs, longest))
    totals = settle(book.groupBy("lang").agg(F.sum(F.col("own") * F.col("times")).alias("n")))
    words = book.agg(F.sum("own")).first()[0] or 0
    frequent = counted(book, words, longest, least)
    phrases = spelled(book, frequent, longest)

    longer = phrases.select(F.explode("insides").alias("key"), F.col("a").alias("f")).groupBy("key").agg(F.max("f").alias("f"))
    wide = "decimal(38,0)"
    kept = phrases.join(longer, "key", "left").where(F.col("f").isNull() | (F.col("f").cast(wide) * 100 < F.col("a").cast(wide) * covered))
    cuts = settle(kept.select("key", "a", F.posexplode(F.arrays_zip("lefts", "rights")).alias("k", "cut")).select("key", "a", "k", "cut.lefts", "cut.rights"))
    sides = cuts.select(F.col("lefts").alias("key")).union(cuts.select("rights")).distinct()
    counts = settle(frequent.join(sides, "key", "left_semi"))
    both = skew_join(cuts, counts.select(F.col("key").alias("lefts"), F.col("a").alias("l")), ["lefts"], "inner")
    both = skew_join(both, counts.select(F.col("key").alias("rights"), F.col("a").alias("r")), ["rights"], "inner")
    score = F.expr(f"cast(a as decimal(20,0)) * {FACTOR} div (cast(l as decimal(20,0)) + r)")
    best = both.groupBy("key").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c")).select("key", "c.score", "c.l", "c.r")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase")))
    ranked = kept.select("key", "lang", "phrase", "a").join(best, "key").withColumn("rank", rank).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
