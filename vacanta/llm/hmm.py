r"""Hidden Markov language model over words, trained by Baum-Welch counts that Spark adds up.

1. Word counts of the training texts: one shuffle of distinct words per batch.
2. Every text becomes classes of words: the `WORDS` most frequent words are a class each, the end of a text is
   one, all other words are the class `rest`, inside which a word has its own add-one share. The `LOOKUP` most
   frequent words have their counts broadcast (a fixed size); the others meet the count table in a join.
3. Baum-Welch: each task runs scaled forward-backward over the segments of its texts and adds up expected
   counts of states, transitions and emissions; Spark sums the tasks' counts by class, and the driver only ever
   sees one row per class. All training texts take part in every round, cut into segments of `SEGMENT` tokens.
   The first parameters are fixed random ones, so they depend neither on a sample nor on the layout of the
   table; rounds go on until the summed likelihood settles.
4. The score of a text is the exact likelihood of its whole sequence by the scaled forward recursion, plus the
   shares of its words inside `rest`. Summed over all sequences up to an end, the model is a distribution.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vacanta.llm.words import words_of
from vacanta.session import settle

STATES, WORDS, LOOKUP = 8, 8_192, 131_072
SEGMENT = 64
# The likelihood has settled when a round adds less than this share of it.
SETTLED = 1e-4
# Weight, in tokens, of the overall distribution in each state's emissions.
PRIOR = 100.0
END_HASH = 0x7E57_0E4D
_CHUNK_SEGMENTS = 4_096
# Row numbers of counts that are not emissions: transitions from state i are -1 - i.
_FIRST, _LIKELIHOOD = -100, -200


def word_counts(docs: DataFrame) -> DataFrame:
    """`(h, c)`: hash and count of every word of `docs(text)`; the ends are counted under `END_HASH`."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [w.hashes for w in words_of(batch.column(0))]
            h, c = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.uint64), return_counts=True)
            h, c = np.append(h.view(np.int64), END_HASH), np.append(c, batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(c, pa.int64())], names=["h", "c"])

    return docs.select("text").mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def _segments(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of every segment of the sequences, and whether it opens one."""
    lengths = np.diff(first)
    each = -(-lengths // SEGMENT)
    number = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    starts = np.repeat(first[:-1], each) + number * SEGMENT
    return starts, np.minimum(SEGMENT, np.repeat(first[1:], each) - starts), number == 0


def expected_counts(ids: np.ndarray, first: np.ndarray, model: dict) -> dict[str, np.ndarray]:
    """Expected emissions (class by state), transitions, first states and the log likelihood of the segments."""
    move, emit, states = model["move"], model["emit"], len(model["first"])
    kinds = len(emit)
    total = {"emit": np.zeros_like(emit), "move": np.zeros((states, states)), "first": np.zeros(states), "likelihood": 0.0}
    # Places behind a segment's end are of a kind of their own, which every state emits.
    known = np.vstack([emit, np.ones(states)])
    starts, lengths, opens = _segments(ids, first)
    for at in range(0, len(starts), _CHUNK_SEGMENTS):
        s, n, o = starts[at : at + _CHUNK_SEGMENTS], lengths[at : at + _CHUNK_SEGMENTS], opens[at : at + _CHUNK_SEGMENTS]
        width = int(n.max())
        inside = np.arange(width)[:, None] < n
        classes = np.where(inside, ids[np.minimum(s + np.arange(width)[:, None], len(ids) - 1)], kinds).astype(np.int64)
        seen = known[classes]
        ahead = np.empty((width, len(s), states))
        # Both recursions are scaled at the same steps: every eighth and the last.
        scale: dict[int, np.ndarray] = {}
        alpha = np.where(o[:, None], model["first"], model["usual"]) * seen[0]
        for t in range(width):
            if t:
                alpha = np.multiply(alpha @ move, seen[t], out=ahead[t])
            else:
                ahead[0] = alpha
                alpha = ahead[0]
            if t % 8 == 7 or t == width - 1:
                scale[t] = alpha.sum(axis=1)
                alpha /= scale[t][:, None]
        total["likelihood"] += float(sum(np.log(c).sum() for c in scale.values()))
        beta = np.ones((len(s), states))
        for t in range(width - 1, -1, -1):
            if t < width - 1:
                back = seen[t + 1] * beta
                if t + 1 in scale:
                    back /= scale[t + 1][:, None]
                total["move"] += move * (ahead[t][inside[t + 1]].T @ back[inside[t + 1]] if not inside[t + 1].all() else ahead[t].T @ back)
                beta = back @ move.T
            ahead[t] *= beta
        total["first"] += ahead[0][o].sum(axis=0)
        cells = classes.reshape(-1, 1) * states + np.arange(states)
        total["emit"] += np.bincount(cells.ravel(), ahead.ravel(), (kinds + 1) * states)[: kinds * states].reshape(kinds, states)
    return total


def updated(counts: dict[str, np.ndarray], overall: np.ndarray) -> dict:
    """Parameters from expected counts; each state's emissions lean on the overall distribution."""
    emit = counts["emit"] + PRIOR * overall[:, None]
    move = counts["move"] + 0.1
    usual = counts["emit"].sum(axis=0) + 1e-3
    start = counts["first"] + 0.1
    return {"emit": emit / emit.sum(axis=0), "move": move / move.sum(axis=1, keepdims=True), "first": start / start.sum(), "usual": usual / usual.sum()}


def starting_model(overall: np.ndarray, states: int, seed: int = 8) -> dict:
    """Fixed random parameters: every state has the overall emissions, each class stretched at random, and tends to stay."""
    emit = overall[:, None] * np.random.RandomState(seed).exponential(size=(len(overall), states))
    move = np.eye(states) * 50.0 + 1
    even = np.full(states, 1.0 / states)
    return {"emit": emit / emit.sum(axis=0), "move": move / move.sum(axis=1, keepdims=True), "first": even, "usual": even}


def forward(ids: np.ndarray, first: np.ndarray, model: dict) -> np.ndarray:
    """log10 likelihood of each whole sequence of classes by the scaled forward recursion."""
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    starts, sizes = first[:-1][order], lengths[order]
    out = np.zeros(len(order))
    alpha = np.tile(model["first"], (len(order), 1))
    live = len(order)
    for t in range(int(sizes[0]) if len(sizes) else 0):
        if sizes[live - 1] <= t:
            gone = int(np.searchsorted(-sizes, -t, side="left"))
            out[gone:live] += np.log10(alpha[gone:live].sum(axis=1))
            live, alpha = gone, alpha[:gone]
        alpha = (alpha @ model["move"] if t else alpha) * model["emit"][ids[starts[:live] + t]]
        if t % 8 == 7:  # eight factors stay far above the smallest double
            scale = alpha.sum(axis=1)
            out[:live] += np.log10(scale)
            alpha = alpha / scale[:, None]
    out[:live] += np.log10(alpha.sum(axis=1))
    result = np.empty(len(order))
    result[order] = out
    return result


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Classes of a binary column in a row, and the index of each text's first one (one more at the end)."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, np.uint8)
    return data.view(np.uint16), (offsets - offsets[0]) // 2


def language_model_scores(docs: DataFrame, held_out, states: int = STATES, settled: float = SETTLED) -> DataFrame:
    """`(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)` per row of `docs(doc_id, text, ...)`.

    `held_out` is a boolean column; rows where it is null or false train the model. A null or empty text is the
    end token alone. Rows are scored one by one, repeated ones and those without a doc_id as well; other columns are
    ignored; an empty table gives an empty result. With no training row, every word is unknown.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    counts = settle(word_counts(rows.where("NOT held_out")))
    tokens, types = (x or 0 for x in counts.agg(F.sum("c"), F.count(F.lit(1))).first())
    top = counts.where(F.col("h") != END_HASH).orderBy(F.desc("c"), "h").limit(LOOKUP).toArrow()
    ends = counts.where(F.col("h") == END_HASH).agg(F.sum("c")).first()[0] or 0
    hashes, seen = top["h"].to_numpy().astype(np.int64), top["c"].to_numpy().astype(np.int64)
    words = min(WORDS, len(hashes))
    end, rest = words, words + 1
    order = np.argsort(hashes)
    # Words outside the frequent classes share `rest`; one more share stands for unknown words.
    outside = tokens - ends - int(seen[:words].sum()) + (types - (ends > 0) - words) + 1
    overall = np.concatenate([seen[:words] + 1.0, [ends + 1.0], [float(outside)]])
    overall /= overall.sum()
    lookup = spark.sparkContext.broadcast({"hashes": hashes[order], "counts": seen[order], "classes": np.minimum(order, rest).astype(np.uint16) if len(order) else order})

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lookup.value
        classes = np.where(known["classes"] < words, known["classes"], rest).astype(np.uint16)
        logs = np.log10(known["counts"] + 1.0)
        for batch in batches:
            for w in words_of(batch.column(2)):
                h = w.hashes.view(np.int64)
                at = np.minimum(np.searchsorted(known["hashes"], h), max(len(classes) - 1, 0))
                hit = known["hashes"][at] == h if len(classes) else np.zeros(len(h), bool)
                kind = np.where(hit, classes[at], rest).astype(np.uint16) if len(classes) else np.full(len(h), rest, np.uint16)
                log = np.where(hit, logs[at], 0.0) if len(classes) else np.zeros(len(h))
                ids = np.insert(kind, w.first[1:], end)
                sizes = w.counts + 1
                sums = lambda x: np.add.reduceat(np.append(x, 0), w.first[:-1]) * (w.counts > 0)
                rare = np.concatenate([[0], np.cumsum(~hit)])[w.first].astype(np.int32)
                binary = pa.Array.from_buffers(pa.binary(), w.rows, [None, pa.py_buffer((2 * np.concatenate([[0], np.cumsum(sizes)])).astype(np.int32).tobytes()), pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(w.row, w.rows) for c in range(2)), pa.array(sizes), pa.array(sums(hit.astype(np.int64))), pa.array(sums(log)), pa.array(sums(((kind == rest) & hit).astype(np.int64))), pa.array(sums(np.where(kind == rest, log, 0.0))),
                     binary, pa.ListArray.from_arrays(pa.array(rare), pa.array(h[~hit]))],
                    names=["doc_id", "held_out", "n_tokens", "found", "found_log", "in_rest", "in_rest_log", "classes", "rare"],
                )

    schema = "doc_id long, held_out boolean, n_tokens long, found long, found_log double, in_rest long, in_rest_log double, classes binary, rare array<long>"
    coded = settle(rows.select("doc_id", "held_out", "text").mapInArrow(encode, schema).withColumn("row", F.monotonically_increasing_id()), compression="zstd")
    training = coded.where("NOT held_out").select("classes")

    model = trained(training, starting_model(overall, states), overall, states, settled)

    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, first = _flat(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(forward(ids, first, shared.value))], names=["row", *batch.schema.names[2:], "path_log"])

    kept = "doc_id long, held_out boolean, n_tokens long, found long, found_log double, in_rest long, in_rest_log double"
    scored = coded.select("row", "classes", "doc_id", "held_out", "n_tokens", "found", "found_log", "in_rest", "in_rest_log").mapInArrow(score, f"row long, {kept}, path_log double")
    met = coded.select("row", F.explode("rare").alias("h")).join(counts, "h", "left")
    rare = met.groupBy("row").agg(F.count(F.lit(1)).alias("n_rare"), F.count("c").alias("rare_found"), F.sum(F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("rare_log"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    end_log = float(np.log10(ends + 1.0))
    joined = scored.join(rare, "row", "left")
    base = F.col("found_log") + zero("rare_log") + F.lit(end_log) - F.col("n_tokens") * F.lit(float(np.log10(tokens + types + 1.0)))
    full = F.col("path_log") + F.col("in_rest_log") + zero("rare_log") - (F.col("in_rest") + zero("n_rare")) * F.lit(float(np.log10(outside)))
    return joined.select("doc_id", "held_out", "n_tokens", (F.col("found") + zero("rare_found") + (1 if ends else 0)).cast("long").alias("n_known"), F.lit(int(tokens)).cast("long").alias("train_tokens"), base.alias("base_score"), full.alias("score"))


def trained(training: DataFrame, model: dict, overall: np.ndarray, states: int, settled: float) -> dict:
    """Baum-Welch rounds over all of `training(classes)` until a round adds less than the share `settled` to the likelihood."""
    names, before = [f"s{j}" for j in range(states)], -np.inf
    while True:
        counts = _round(training, model, names)
        model = updated(counts, overall)
        # An empty table adds nothing.
        if counts["likelihood"] - before <= settled * abs(counts["likelihood"]):
            return model
        before = counts["likelihood"]


def _round(training: DataFrame, model: dict, names: list[str]) -> dict[str, np.ndarray]:
    """Expected counts of all training texts, added up by Spark."""
    spark, states, kinds = training.sparkSession, len(names), len(model["emit"])
    shared = spark.sparkContext.broadcast(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            part = expected_counts(*_flat(batch.column(0)), shared.value)
            total = part if total is None else {k: total[k] + part[k] for k in total}
        if total is not None:
            values = np.vstack([total["emit"], total["move"], total["first"], np.full(states, total["likelihood"])])
            rows = np.concatenate([np.arange(kinds), -1 - np.arange(states), [_FIRST, _LIKELIHOOD]])
            yield pa.RecordBatch.from_arrays([pa.array(rows), *(pa.array(np.ascontiguousarray(values[:, j])) for j in range(states))], names=["k", *names])

    schema = "k long, " + ", ".join(f"{n} double" for n in names)
    summed = training.mapInArrow(count, schema).groupBy("k").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    k, values = summed["k"].to_numpy(), np.stack([summed[n].to_numpy() for n in names], axis=1)
    out = {"emit": np.zeros((kinds, states)), "move": np.zeros((states, states)), "first": np.zeros(states), "likelihood": 0.0}
    out["emit"][k[k >= 0]] = values[k >= 0]
    moves = (k < 0) & (k > _FIRST)
    out["move"][-1 - k[moves]] = values[moves]
    if (k == _FIRST).any():
        out["first"], out["likelihood"] = values[k == _FIRST][0], float(values[k == _LIKELIHOOD][0][0])
    return out
