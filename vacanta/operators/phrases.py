"""Runs of words found by rolling hashes before any row is made.

Each different word of a batch is hashed once; a run of n words costs one multiply and one add per word more. A run
leaves the worker only if its hash is set in a bit map of the phrases sought, whose size is bounded; readers compare
the strings of what is left, so a chance hit costs a row and nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

_BASE = np.uint64(0x9E3779B97F4A7C15)
# Bits per phrase, and limits of the map as powers of two (1 KB to 16 MB).
PER_PHRASE, LEAST, MOST = 32, 13, 27
# Bytes of text a worker looks at in one go: its arrays hold some thirty times as much.
AT_ONCE = 4 << 20


def _slices(batch: pa.RecordBatch, texts: list[int], most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of `most` bytes of text or less; a longer text comes alone."""
    sizes = sum(pc.fill_null(pc.binary_length(batch.column(k)), 0).to_numpy().astype(np.int64) for k in texts)
    upto = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + most, side="right")))
        yield batch.slice(start, end - start)
        start = end


def _words(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Different words, and of every word in order: its number, its text's row, its hash. Words stand between single spaces."""
    lists = pc.split_pattern(column.cast(pa.large_string()).fill_null(""), " ")
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    flat = lists.flatten().dictionary_encode()
    code, names = flat.indices.to_numpy(), flat.dictionary
    filled = pc.not_equal(names, "").to_numpy(zero_copy_only=False)[code] if len(names) else np.zeros(0, bool)
    code, row = code[filled], row[filled]
    hashes = pd.util.hash_array(names.to_numpy(zero_copy_only=False), categorize=False) if len(names) else np.zeros(0, np.uint64)
    return names, code, row, hashes[code]


def _runs(hashes: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """Hashes of the runs of 1 to `longest` words from every word on, limits of texts not regarded."""
    run = hashes
    for n in range(1, longest + 1):
        if n > 1:
            run = run[:-1] * _BASE + hashes[n - 1 :]
        if not len(run):
            return
        yield n, run


def _place(hashes: np.ndarray, bits: int) -> np.ndarray:
    mixed = hashes ^ (hashes >> np.uint64(29))
    mixed = mixed * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed ^ (mixed >> np.uint64(32))) & np.uint64(2**bits - 1)


def _set(table: np.ndarray, places: np.ndarray) -> np.ndarray:
    return ((table[places >> np.uint64(6)] >> (places & np.uint64(63))) & np.uint64(1)).astype(bool)


def _spelled(names: pa.Array, code: np.ndarray, at: np.ndarray, n: int) -> pa.Array:
    """The runs of n words that begin at `at`, as strings."""
    parts = [names.take(pa.array(code[at + j])) for j in range(n)]
    return (parts[0] if n == 1 else pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string()))).cast(pa.string())


def _phrase_map(forms: DataFrame, form: str, longest: int) -> tuple[np.ndarray, int]:
    """The bit map of all phrases: one byte per eight places reaches the driver, whatever their number."""
    count = forms.count()
    bits = min(MOST, max(LEAST, (PER_PHRASE * count).bit_length()))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, row, hashes = _words(batch.column(0))
            sizes = np.bincount(row, minlength=batch.num_rows)
            first = np.cumsum(sizes) - sizes
            for n, run in _runs(hashes, longest):
                places = _place(run[first[sizes == n]], bits)
                yield pa.RecordBatch.from_arrays([pa.array((places >> np.uint64(6)).astype(np.int64)), pa.array((places & np.uint64(63)).astype(np.int32))], names=["at", "bit"])

    words = forms.select(form).mapInArrow(hashed, "at long, bit int").groupBy("at").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow()
    table = np.zeros(2 ** (bits - 6), np.int64)
    table[words.column("at").to_numpy()] = words.column("bits").to_numpy()
    return table.view(np.uint64), bits


def runs_in(texts: DataFrame, ids: list[str], text: str, forms: DataFrame, longest: int, form: str = "form") -> DataFrame:
    """(ids, form): the runs of 1 to `longest` words of each text that may be phrases of `forms`, each once per text."""
    shared = texts.sparkSession.sparkContext.broadcast(_phrase_map(forms, form, longest))
    rows = texts.select(*ids, text)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bits = shared.value
        for batch in (part for whole in batches for part in _slices(whole, [len(ids)], AT_ONCE)):
            names, code, row, hashes = _words(batch.column(len(ids)))
            for n, run in _runs(hashes, longest):
                inside = row[: len(run)] == row[n - 1 :] if n > 1 else np.ones(len(run), bool)
                there = np.flatnonzero(inside & _set(table, _place(run, bits)))
                once = ~pd.DataFrame({"r": row[there], "h": run[there]}).duplicated().to_numpy()
                there = there[once]
                found = _spelled(names, code, there, n)
                owner = pa.array(row[there])
                yield pa.RecordBatch.from_arrays([*[batch.column(k).take(owner) for k in range(len(ids))], found], names=[*ids, form])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + f", `{form}` string"
    return rows.mapInArrow(find, schema)


def counted_runs(texts: DataFrame, by: list[str], id: str, apart: str, parts: list[str], forms: DataFrame, several: DataFrame, longest: int, form: str = "form") -> DataFrame:
    """(by, id, form, full, required, bonus, n, wished): runs that may be phrases, counted in the worker where a row stands for a text.

    `parts` are the text and, when given, its required and its bonus part. A run of the text that only its bonus part
    repeats is wished. Rows with n count the texts of a slice that hold the run. Rows without n belong to one text:
    those of a text marked `apart`, whose id comes again elsewhere, and those of the phrases `several`, whose key has
    other spellings; readers bring them together by id.
    """
    shared = texts.sparkSession.sparkContext.broadcast((_phrase_map(forms, form, longest), _phrase_map(several, form, longest)))
    rows = texts.select(*by, id, apart, *parts)
    first_text = len(by) + 2

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (table, bits), (rare, rare_bits) = shared.value
        columns = list(range(first_text, first_text + len(parts)))
        for batch in (part for whole in batches for part in _slices(whole, columns, AT_ONCE)):
            size = batch.num_rows
            names, code, row, hashes = _words(pa.concat_arrays([batch.column(k).cast(pa.large_string()) for k in columns]))
            again = batch.column(len(by) + 1).to_numpy(zero_copy_only=False).astype(bool)
            group = np.zeros(size, np.int64)
            for k in range(len(by)):
                values = batch.column(k).dictionary_encode(null_encoding="encode")
                group = pd.factorize(group * max(1, len(values.dictionary)) + values.indices.to_numpy())[0]
            member = np.zeros(size, np.int64)
            member[group] = np.arange(size)
            for n, run in _runs(hashes, longest):
                inside = row[: len(run)] == row[n - 1 :] if n > 1 else np.ones(len(run), bool)
                there = np.flatnonzero(inside & _set(table, _place(run, bits)))
                if not len(there):
                    continue
                # Numbers of the different runs by their words, never by their hashes; then cells of a text and a run.
                phrase = pd.factorize(code[there].astype(np.int64))[0]
                for j in range(1, n):
                    phrase = pd.factorize(phrase * len(names) + code[there + j])[0]
                count = int(phrase.max()) + 1
                at = np.zeros(count, np.int64)
                at[phrase] = there
                cell, cells = pd.factorize(row[there] % size * count + phrase)
                text, phrase_of = cells // count, cells % count
                held = np.zeros((3, len(cells)), bool)
                held[row[there] // size, cell] = True
                full, required, bonus = held
                alone = again[text] | _set(rare, _place(run[at], rare_bits))[phrase_of]
                wished = bonus & ~required
                one = np.flatnonzero(alone)
                many, counts = pd.factorize((group[text] * count + phrase_of)[full & ~alone])
                total = np.bincount(many, minlength=len(counts)).astype(np.int64)
                wishes = np.bincount(many[wished[full & ~alone]], minlength=len(counts)).astype(np.int64)
                for owner, said, own, flags, number in (
                    (text[one], phrase_of[one], True, held[:, one], None), (member[counts // count], counts % count, False, None, (total, wishes)),
                ):
                    if not len(owner):
                        continue
                    take, none = pa.array(owner), lambda t: pa.nulls(len(owner), t)  # noqa: B023
                    yield pa.RecordBatch.from_arrays(
                        [
                            *[batch.column(k).take(take) for k in range(len(by))], batch.column(len(by)).take(take) if own else none(batch.column(len(by)).type), _spelled(names, code, at[said], n),
                            *([pa.array(f) for f in flags] if own else [none(pa.bool_())] * 3), *([none(pa.int64())] * 2 if own else [pa.array(c) for c in number]),
                        ],
                        names=[*by, id, form, "full", "required", "bonus", "n", "wished"],
                    )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(by) + 1])
    return rows.mapInArrow(find, f"{schema}, `{form}` string, full boolean, required boolean, bonus boolean, n long, wished long")
