"""Toxicity by compression distance: which of two Zstandard dictionaries makes the windows of a text shorter.

Toxic terms are words, and phrases of up to `PHRASE` words, that come in several toxic texts and contexts and whose smoothed
document frequency in toxic texts is `RATIO` times that in ordinary ones or more: a mislabelled text or two do
not bar a term. The ordinary dictionary is trained by the library on a bounded sample of ordinary labelled
texts without those terms; the toxic one is the same content followed by the terms, the highest ratio last,
where matches are cheapest. (The library's trainer alone fills the toxic dictionary with the ordinary language
that toxic texts consist of, and the two lengths then differ by chance.)

A window is one word, or a toxic phrase the text holds, between two fixed strings that both dictionaries hold:
the compressor does not look for matches in the last bytes of its input, so without them a short word would
never be found. Other runs of words are not windows: what sets the two dictionaries apart is the terms alone.
A window's distance is the length with the ordinary dictionary less that with the toxic one. The score of a text is the share of
toxic texts, in a sample kept for calibration, at the largest distance of its windows (pooled so that it never falls).
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from vacanta.llm.sampling import bounded_sample
from vacanta.llm.worker import held

# Labelled texts (about so many, of at most so many bytes) that the model is fitted on.
TOXIC_TEXTS, ORDINARY_TEXTS, TEXT_BYTES = 1_800, 9_000, 65_536
# Of every three sampled texts, two are for the dictionaries.
ORDINARY_BYTES = 400_000
LEVEL = 13
PREDICTED = 0.3
# Words of the longest term, toxic texts and contexts it must come in, and its least smoothed ratio.
PHRASE, LEAST, RATIO = 3, 3, 20.0
# Bytes of the longest window; longer words are cut, with an overlap.
WINDOW, OVERLAP = 48, 12
_FRAME = bytes(range(0x80, 0x98))
_EDGES = b".,;:!?'\"()[]"
_CACHE = 300_000
_LEVELS = 24

@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    shares: list[float]
    phrases: frozenset[bytes] = frozenset()


def windows(text: str | None) -> list[bytes]:
    """Windows of a whole text: its words without punctuation at the ends, A-Z lower-cased (an empty text has one empty window)."""
    words = [w.strip(_EDGES) for w in (text or "").encode("utf-8", "surrogatepass").lower().split()]
    if any(len(w) > WINDOW for w in words):
        words = [w[i : i + WINDOW] for w in words for i in range(0, max(1, len(w) - OVERLAP), WINDOW - OVERLAP)]
    return words or [b""]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    dictionary = zstandard.ZstdCompressionDict(content + _FRAME, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=False, write_dict_id=False)


class Distances(dict):
    """window -> distance, kept for windows that come again."""

    def __init__(self, model: Model):
        super().__init__()
        self.phrases, self.opening = model.phrases, {p.split(b" ")[0] for p in model.phrases}
        self.compressors = [_compressor(model.ordinary), _compressor(model.toxic)]

    def windows(self, text: str | None) -> list[bytes]:
        """The words of a text and the toxic phrases it holds."""
        words = windows(text)
        if not self.opening.isdisjoint(words):
            words += [p for n in range(2, PHRASE + 1) for p in self.phrases.intersection(terms(words, n))]
        return words

    def meet(self, words: set[bytes]) -> None:
        """Makes sure that the windows of a group of texts are there."""
        new = words - self.keys()
        if len(self) + len(new) > _CACHE:
            self.clear()
            new = words
        new = list(new)
        for start in range(0, len(new), 20_000):
            part = new[start : start + 20_000]
            framed = [_FRAME + b" " + w + b" " + _FRAME for w in part]
            ordinary, toxic = ([len(x) for x in c.multi_compress_to_buffer(framed, threads=1)] for c in self.compressors)
            self.update(zip(part, (a - b for a, b in zip(ordinary, toxic, strict=True)), strict=True))


def largest_distances(texts: list[str | None], distances: Distances) -> list[int]:
    """Largest window distance of each text, in groups that bound what is held."""
    out, group, size = [], [], 0
    for text in [*texts, None]:
        group.append(distances.windows(text))
        size += len(group[-1])
        if size > 100_000 or len(out) + len(group) > len(texts):
            distances.meet(set().union(*group))
            out += [max(map(distances.__getitem__, words)) for words in group]
            group, size = [], 0
    return out[: len(texts)]


def terms(words: list[bytes], n: int) -> list[bytes]:
    """Runs of `n` words."""
    return words if n == 1 else [b" ".join(x) for x in zip(*(words[k:] for k in range(n)), strict=False)]


def toxic_terms(toxic: list[str | None], ordinary: list[str | None]) -> dict[bytes, float]:
    """Terms of toxic texts and their smoothed ratios of toxic to ordinary document frequency; a phrase that holds a shorter term is left to it."""
    found: dict[bytes, float] = {}
    often: set[bytes] = set()
    for n in range(1, PHRASE + 1):
        # A phrase can only be frequent if its shorter ones are.
        open_terms = lambda words: [x for x, a, b in zip(terms(words, n), *[terms(words, n - 1)[k:] for k in (0, 1)], strict=False) if a in often and b in often] if n > 1 else words  # noqa: B023, E731
        counts = Counter(x for text in toxic for x in set(open_terms(windows(text))))
        often = {x for x, c in counts.items() if c >= LEAST and x}
        contexts, known = defaultdict(set), Counter()
        for text in toxic:
            words = windows(text)
            for before, x in zip([b"", *words], terms(words, n), strict=False):
                if x in often:
                    contexts[x].add(before)
        for text in ordinary:
            known.update(often.intersection(terms(windows(text), n)))
        for x in often:
            ratio = (counts[x] + 0.5) / (len(toxic) + 1) / ((known[x] + 0.5) / (len(ordinary) + 1))
            parts = x.split(b" ")
            if ratio >= RATIO and len(contexts[x]) >= LEAST and not any(y in found for k in range(1, n) for y in terms(parts, k)):
                found[x] = ratio
    return found


def without(piece: list[bytes], found: dict[bytes, float]) -> bytes:
    """A piece of an ordinary text without toxic terms."""
    kept: list[bytes] = []
    for word in piece:
        kept.append(word)
        for n in range(1, PHRASE + 1):
            if b" ".join(kept[-n:]) in found:
                del kept[-n:]
                break
    return b" ".join(kept)


def pooled(levels: np.ndarray, toxic: np.ndarray) -> list[float]:
    """Share of toxic texts at each level, smoothed by the overall share and pooled so that it never falls."""
    overall = (toxic.sum() + 0.5) / (len(toxic) + 1.0)
    blocks: list[list[float]] = []
    for level in range(_LEVELS):
        there = levels == level
        blocks.append([float(toxic[there].sum() + 0.5 * overall), float(there.sum() + 0.5), 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return [min(1.0, max(0.0, p / n)) for p, n, k in blocks for _ in range(int(k))]


def fit(texts: list[str | None], toxic: list[int]) -> Model:
    """A model from labelled texts in a random order: two of three for the dictionaries, the third for calibration."""
    labels = np.array(toxic, dtype=np.int64)
    place = np.zeros(len(labels), np.int64)
    for label in (0, 1):
        at = np.flatnonzero(labels == label)
        place[at] = np.arange(len(at))
    fitted = place % 3 != 2
    pick = lambda label: [texts[i] for i in np.flatnonzero(fitted & (labels == label))]
    found = toxic_terms(pick(1), pick(0))
    samples = []
    for text in pick(0):
        words = windows(text)
        samples += [without(words[k : k + 100], found) for k in range(0, len(words), 100)]
    try:
        ordinary = zstandard.train_dictionary(ORDINARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too little to learn from
        ordinary = b" ".join(samples)[-ORDINARY_BYTES:]
    ranked = sorted(found, key=lambda x: (found[x], x))
    model = Model(ordinary, ordinary + b" " + b" ".join(ranked) + b" ", [0.0] * _LEVELS, frozenset(x for x in ranked if b" " in x))
    del samples
    kept = np.flatnonzero(~fitted)
    levels = np.clip(largest_distances([texts[i] for i in kept], Distances(model)), 0, _LEVELS - 1) if len(kept) else np.zeros(0, np.int64)
    model.shares = pooled(np.asarray(levels), labels[kept])
    return model


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits on a bounded sample of `labels(doc_id, toxic)`, drawn for each label by a hash of the ids.

    Labels of one doc_id that differ count as toxic; rows without a doc_id or a label teach nothing.
    """
    marks = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    key = F.col("doc_id").cast("string")
    chosen = bounded_sample(marks.where("toxic = 1"), key, TOXIC_TEXTS).union(bounded_sample(marks.where("toxic = 0"), key, ORDINARY_TEXTS))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.octet_length("text") <= TEXT_BYTES)
    # The chosen ids are a bounded table of two numbers a row.
    rows = texts.join(F.broadcast(chosen), "doc_id").toArrow().to_pylist()
    rows.sort(key=lambda r: (hash_order(r["doc_id"]), r["text"]))
    return fit([r["text"] for r in rows], [r["toxic"] for r in rows])


def hash_order(doc_id: int) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(str(doc_id))


def toxicity_scores(docs: DataFrame, model: Model) -> DataFrame:
    """`(doc_id, distance, score, predicted)` per row of `docs(doc_id, text, ...)`.

    A null text counts as empty; it is scored like any other. Rows are independent, so repeated rows and null
    ids are scored as they stand; other columns are ignored; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        distances = held(("distances", hash((model.toxic, *model.shares))), lambda: Distances(model))
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                rows = batch.slice(start, 256)
                found = largest_distances(rows.column(1).to_pylist(), distances)
                scores = [model.shares[min(max(d, 0), _LEVELS - 1)] for d in found]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(found, pa.int32()), pa.array(scores, pa.float64())], names=["doc_id", "distance", "score"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = narrow.mapInArrow(score, "doc_id long, distance int, score double")
    return scored.withColumn("predicted", (F.col("score") >= PREDICTED).cast("int"))
