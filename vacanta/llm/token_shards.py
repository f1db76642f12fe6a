"""Token ids in training order: a keyed permutation gives every sequence its slot, shards have a fixed stride.

1. Texts become token ids plus one end token, cut into sequences of `length` ids, and are written once to the
   shared folder with the position of each sequence in its input partition.
2. Sequence number = sequences of the partitions before + position. A keyed Feistel network over the next
   even power of two, walked until it falls below the number of sequences, gives the slot: a bijection.
3. Shard s holds the slots `s * per_shard` on. One task receives exactly these, sorts by slot and writes records of one
   stride, so slot k is at byte `(k % per_shard) * stride`: a reader resumes anywhere with one seek. Shards
   are moved in `waves`, so a fraction of the tokens is in shuffle files at any time.

Record, little endian: doc_id int64 (smallest value: null), part int32, number of ids int32, `length` ids
(uint16, or uint32 for a vocabulary above 65,536), unused ids filled with the end token.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from vacanta.llm.files import open_file, shared_folder
from vacanta.llm.piece_stream import PieceStream
from vacanta.llm.pretokens import Library
from vacanta.llm.worker import held
from vacanta.session import settle

NO_ID = -(2**63)
HEADER = 16
ROUNDS = 6
# Tasks that read shards back, at most.
READERS = 4_096
# Bytes of text whose pieces are looked up together, about.
TOGETHER_BYTES = 8_000_000


def _coder(path: str, width: str) -> tuple:
    """A function texts -> their ids as bytes, and the type of an id."""
    library, kind = Library(path), np.dtype(width)
    if not library.plain:
        return lambda texts: [np.array(library.ids(text or ""), kind).tobytes() for text in texts], kind
    return PieceStream(library, kind).all, kind


def _mixed(x: np.ndarray, key: np.uint64) -> np.ndarray:
    x = (x + key) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def slots(numbers: np.ndarray, n: int, key: int) -> np.ndarray:
    """Slot of each sequence number: a permutation of `range(n)` set by `key`, computed number by number."""
    half = max(1, -(-max(n - 1, 1).bit_length() // 2))
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64(int.from_bytes(hashlib.sha256(f"{key}:{r}".encode()).digest()[:8], "little")) for r in range(ROUNDS)]
    out = numbers.astype(np.uint64)
    walking = np.arange(len(out))
    while len(walking):
        x = out[walking]
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            left, right = right, left ^ (_mixed(right, k) & mask)
        x = (left << np.uint64(half)) | right
        out[walking] = x
        walking = walking[x >= np.uint64(n)]
    return out.astype(np.int64)


def token_sequences(docs: DataFrame, path: str, length: int, end: int, width: str) -> DataFrame:
    """`(doc_id, part, n, ids)`: sequences of at most `length` ids; the last one of a text ends with `end`."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, kind = held(("ids", path, width), lambda: _coder(path, width))
        stop, stride = np.array([end], kind).tobytes(), length * kind.itemsize
        for rows in _by_bytes(batches):
            docs, tokens_of = rows.column(0).to_pylist(), of(rows.column(1).to_pylist())
            for start in range(0, len(docs), 256):
                ids, parts, counts, pieces = [], [], [], []
                for doc, tokens in zip(docs[start : start + 256], tokens_of[start : start + 256], strict=True):
                    tokens += stop
                    for part, at in enumerate(range(0, len(tokens), stride)):
                        piece = tokens[at : at + stride]
                        ids.append(doc)
                        parts.append(part)
                        counts.append(len(piece) // kind.itemsize)
                        pieces.append(piece)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(parts, pa.int32()), pa.array(counts, pa.int32()), pa.array(pieces, pa.binary())], names=["doc_id", "part", "n", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, "doc_id long, part int, n int, ids binary")


def _by_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in stretches of about `TOGETHER_BYTES` of text, one row at least."""
    for batch in batches:
        through = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(), dtype=np.int64) // TOGETHER_BYTES
        bounds = [*np.flatnonzero(np.diff(through, prepend=-1)).tolist(), batch.num_rows]
        for start, end in zip(bounds[:-1], bounds[1:], strict=True):
            yield batch.slice(start, end - start)


def write_shards(docs: DataFrame, path: str, length: int = 256, end: int | None = None, key: int = 20_260, per_shard: int = 16_384, waves: int = 4) -> tuple[DataFrame, dict]:
    """Writes the shards of `docs(doc_id, text, ...)`; returns the manifest `(shard, file, records)` and the format.

    A null text counts as empty and gives one sequence, the end token alone. A null doc_id is stored as the
    smallest long. Repeated rows are sequences of their own; other columns are ignored; an empty table writes
    no shard. A task that is repeated writes a new file, and the manifest names the files of finished tasks. Sequences are
    numbered in the order of the input's partitions, so the training order belongs to the key and to the layout of the table.
    """
    spark = docs.sparkSession
    size = Library(path).size
    end = size - 1 if end is None else end
    width = "<u2" if max(size, end + 1) <= 65_536 else "<u4"
    kind = np.dtype(width)
    stride = HEADER + length * kind.itemsize
    placed = token_sequences(docs, path, length, end, width)
    # The id is the partition in the upper bits and the position in it in the lower 33.
    stored = settle(placed.withColumn("at", F.monotonically_increasing_id()), compression="zstd")
    partition = F.shiftright("at", 33)
    counts = stored.groupBy(partition.alias("p")).agg(F.count(F.lit(1)).alias("c"))
    # One row per input partition: a fixed few bytes per task of the first step, so it can be broadcast.
    before = settle(counts.select("p", F.sum("c").over(_all_before()).alias("through"), "c").select("p", (F.col("through") - F.col("c")).alias("base")))
    n = stored.count()
    form = {"length": length, "stride": stride, "width": width, "end": end, "per_shard": per_shard, "records": n, "key": key}

    @F.pandas_udf("long")
    def slot_of(number):
        import pandas as pd

        return pd.Series(slots(number.to_numpy(np.int64), n, key))

    # Slots are fixed; marked so that a filter on them does not compute them a second time.
    slot_of = slot_of.asNondeterministic()
    numbered = stored.withColumn("p", partition).join(F.broadcast(before), "p").withColumn("slot", slot_of(F.col("base") + F.col("at").bitwiseAND(F.lit(2**33 - 1))))
    folder = shared_folder(spark, "shards")
    shards = -(-n // per_shard)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, shard, name, records, done = None, -1, "", 0, []
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True)
            for slot, doc, part, count, ids in rows:
                if slot // per_shard != shard:
                    if out:
                        out.close()
                        done.append((shard, name, records))
                    shard, records = slot // per_shard, 0
                    name = f"{folder}/shard-{shard:07d}-{uuid.uuid4().hex[:12]}.bin"
                    out = open_file(name, "wb")
                out.write((NO_ID if doc is None else doc).to_bytes(8, "little", signed=True) + part.to_bytes(4, "little") + count.to_bytes(4, "little"))
                out.write(ids + np.full(length - count, end, kind).tobytes() if count < length else ids)
                records += 1
        if out:
            out.close()
            done.append((shard, name, records))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string()), pa.array([d[2] for d in done], pa.int64())], names=["shard", "file", "records"])

    manifest = None
    waves = min(waves, shards)
    for wave in range(waves):
        low, high = shards * wave // waves, shards * (wave + 1) // waves
        shard = F.floor(F.col("slot") / per_shard).cast("long")
        moved = numbered.where(F.col("slot").between(low * per_shard, high * per_shard - 1)).select("slot", "doc_id", "part", "n", "ids", shard.alias("shard"))
        # The shard's own number is its task: no two meet in one, none stays empty.
        ranged = moved.repartitionById(high - low, (F.col("shard") - low).cast("int")).sortWithinPartitions("slot").drop("shard")
        done = settle(ranged.mapInArrow(write, "shard long, file string, records long"))
        manifest = done if manifest is None else manifest.union(done)
        del moved, ranged
        spark.sparkContext._jvm.System.gc()  # lets the driver release the shuffle files of the wave
    if manifest is None:
        manifest = spark.createDataFrame([], "shard long, file string, records long")
    return manifest, form


def _all_before():
    from pyspark.sql import Window

    return Window.orderBy("p").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def read_shards(manifest: DataFrame, form: dict, with_ids: bool = False) -> DataFrame:
    """Every record of the shards: `(slot, shard, byte_offset, doc_id, part, n_tokens, ids_sha256[, ids])`."""
    per_shard, stride, itemsize = form["per_shard"], form["stride"], np.dtype(form["width"]).itemsize

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, name, records in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                with open_file(name, "rb") as file:
                    for start in range(0, records, 1024):
                        count = min(1024, records - start)
                        block = file.read(count * stride)
                        if len(block) != count * stride:
                            raise OSError(f"{name} ends inside a record")
                        heads = [block[i * stride : i * stride + HEADER] for i in range(count)]
                        n = [int.from_bytes(h[12:], "little") for h in heads]
                        ids = [block[i * stride + HEADER : i * stride + HEADER + n[i] * itemsize] for i in range(count)]
                        docs = [int.from_bytes(h[:8], "little", signed=True) for h in heads]
                        at = np.arange(start, start + count)
                        columns = [pa.array(shard * per_shard + at), pa.array(np.full(count, shard)), pa.array(at * stride), pa.array([None if d == NO_ID else d for d in docs], pa.int64()),
                                   pa.array([int.from_bytes(h[8:12], "little") for h in heads], pa.int32()), pa.array(n, pa.int32()), pa.array([hashlib.sha256(i).hexdigest() for i in ids])]
                        yield pa.RecordBatch.from_arrays([*columns, *([pa.array(ids, pa.binary())] if with_ids else [])], names=NAMES + ["ids"] * with_ids)

    kinds = "slot long, shard long, byte_offset long, doc_id long, part int, n_tokens int, ids_sha256 string" + ", ids binary" * with_ids
    files = -(-form["records"] // per_shard)
    return manifest.repartition(max(1, min(files, READERS))).mapInArrow(read, kinds)


NAMES = ["slot", "shard", "byte_offset", "doc_id", "part", "n_tokens", "ids_sha256"]
