"""A bit map of keys with a fixed largest size: it can be broadcast whatever the table, and misses no key.

A key that is not in the table may be taken for one that is, the more so the more keys there are; readers join
or count exactly afterwards. The map only keeps rows that cannot matter away from a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from vacanta.llm.worker import release

# The map's largest size as a power of two: 2^26 bits are 8 MB. It serves up to some ten million keys well; more only let more rows through.
BITS = 26
# A map of few keys is folded to so many bits a key: workers keep the maps they were sent.
PER_KEY, LEAST, FEW = 32, 16, 2**17


def bit_map(keys: DataFrame, hashed: Column, bits: int = BITS) -> np.ndarray:
    """The map of a column of well mixed 64-bit hashes, of 2^`bits` bits at most. The driver receives one long per 64 bits at most."""
    at = F.shiftrightunsigned("h", 64 - bits)
    words = keys.select(hashed.alias("h")).groupBy(F.shiftrightunsigned(at, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - bits}) & 63 as int))")).alias("bits")).toArrow()
    place, word = words.column("at").to_numpy(), words.column("bits").to_numpy().view(np.uint64)
    if len(place) <= FEW:
        row, bit = np.nonzero((word[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1))
        fewer = min(bits, max(LEAST, (PER_KEY * len(row)).bit_length()))
        at = (place[row].astype(np.uint64) * np.uint64(64) + bit.astype(np.uint64)) >> np.uint64(bits - fewer)
        table = np.zeros(2 ** (fewer - 6), np.uint64)
        np.bitwise_or.at(table, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        return table
    table = np.zeros(2 ** (bits - 6), np.uint64)
    table[place] = word
    return table


def marked(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes (64 bits each) are in the map, and a few that are not."""
    at = hashes.view(np.uint64) >> np.uint64(64 - 6 - (len(table) - 1).bit_length())
    return ((table[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)


def rows_of(rows: DataFrame, ids: DataFrame, then: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, key: str = "doc_id") -> DataFrame:
    """What `then` gives for the rows whose `key` is in `ids(id)`, and for a few others, without a shuffle of the rows."""
    shared = rows.sparkSession.sparkContext.broadcast(bit_map(ids, F.xxhash64("id")))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        yield from then(batch.filter(pa.array(marked(shared.value, batch.column(0).to_numpy()))).select(list(range(1, batch.num_columns))) for batch in batches)

    return rows.select(F.xxhash64(key).alias("_hash"), *rows.columns).mapInArrow(keep, schema)
