"""Token ids of many whole texts at a time, by lookup of their different pieces.

Pieces are those of `pretokens`. Every different piece of a group of texts is looked up once, and Arrow takes the ids of
all places. Pieces that are not stored are cut by the pre-tokeniser's pattern; the ids of new parts come from the
tokenizer's own list of merges, one merge per part and round for all parts of like length together, or from the library
where a part is long or more than merges of bytes decides.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from vacanta.llm.pretokens import SPACES, Library, PieceCoder

# Pieces and parts a worker stores before it starts anew (about 40 MB).
STORED_PIECES, STORED_PARTS = 1_000_000, 700_000
# Parts of at most so many bytes are merged together; longer ones go to the library.
WIDTHS = (4, 8, 12, 16, 24, 32)
# Rank of a pair that does not merge. Ranks times the largest width fit 32 bits.
NEVER = 2**25


class Store:
    """Ids of different keys, end to end in one array; keys are numbered as they come."""

    def __init__(self, kind: np.dtype, learn: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]):
        """`learn(keys)` gives the ids of new, different keys end to end and where those of each one end."""
        self.kind, self.learn = kind, learn
        self.clear()

    def __len__(self) -> int:
        return len(self.keys)

    def clear(self) -> None:
        self.keys = pa.array([], pa.large_string())
        self.ids, self.bounds = np.empty(0, self.kind), np.zeros(1, np.int64)

    def numbers(self, values: pa.Array) -> np.ndarray:
        """The number of each value; ids of new ones are learnt and stored."""
        coded = values.dictionary_encode()
        found = pc.fill_null(pc.index_in(coded.dictionary, value_set=self.keys), -1).to_numpy().astype(np.int64)
        new = found < 0
        if new.any():
            keys = coded.dictionary.filter(pa.array(new))
            ids, ends = self.learn(keys)
            found[new] = np.arange(len(self.keys), len(self.keys) + len(keys))
            self.keys = pa.concat_arrays([self.keys, keys])
            self.bounds = np.concatenate([self.bounds, (ends + len(self.ids)) * self.kind.itemsize])
            self.ids = np.concatenate([self.ids, ids])
        return found[coded.indices.to_numpy()]

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of numbered keys end to end, and where those of each begin; the last number is the end."""
        data, bounds = _taken(self.ids, self.bounds, numbers)
        return data, bounds // self.kind.itemsize


def _taken(ids: np.ndarray, bounds: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of `ids`, given by their bounds in bytes, end to end in the order of `places`, and their bounds in bytes."""
    stretches = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(ids)])
    _, ends, data = stretches.take(pa.array(places)).buffers()
    out = np.frombuffer(ends, np.int64)[: len(places) + 1]
    return np.frombuffer(data, ids.dtype)[: out[-1] // ids.itemsize] if out[-1] else ids[:0], out


class Merger:
    """Ids of parts of a few bytes by a list of merges: always the first pair of the lowest rank, as the library does."""

    def __init__(self, library: Library):
        size = np.int64(library.size)
        ranked = {(a, b): (rank, both) for rank, (a, b, both) in enumerate(library.merges)}
        pairs = sorted((a * size + b, rank, both) for (a, b), (rank, both) in ranked.items())
        self.size, self.keys = size, np.array([p[0] for p in pairs], np.int64)
        self.ranks = np.array([p[1] for p in pairs], np.int32)
        self.merged = np.zeros(len(library.merges), np.int32)
        self.merged[self.ranks] = [p[2] for p in pairs]
        self.byte_ids = np.array(library.byte_ids, np.int32)
        self.first = self.rank(np.repeat(self.byte_ids, 256), np.tile(self.byte_ids, 256)).reshape(256, 256)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; `right` is -1 where there is none."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (right >= 0), self.ranks[at], NEVER)

    def ids(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids, end to end, of the parts of 1 to `width` bytes of `data`, and how many each has."""
        lines = np.arange(width, dtype=np.int32)[:, None]
        inside = lines < sizes
        letters = data[np.where(inside, starts + lines, 0)]
        ids = np.where(inside, self.byte_ids[letters], -1)
        ranks = np.full(ids.shape, NEVER, np.int32)
        ranks[:-1] = np.where(inside[1:], self.first[letters[:-1], letters[1:]], NEVER)
        out, counts, of = ids.copy(), sizes.copy(), np.arange(len(sizes))
        while len(of):
            best = (ranks * width + lines[: len(ranks)]).min(0)
            going = best < NEVER * width
            if not going.all():
                out[: len(ids), of[~going]] = ids[:, ~going]
                ids, ranks, best, of = ids[:, going], ranks[:, going], best[going], of[going]
                if not len(of):
                    break
            at, every = best % width, np.arange(len(of))
            # The merged pair takes one line less: what follows moves up.
            later = lines[: len(ids) - 1] > at
            ids = np.where(later, ids[1:], ids[:-1])
            ranks = np.where(later, ranks[1:], ranks[:-1])
            new = self.merged[best // width]
            ids[at, every] = new
            after = np.minimum(at + 1, len(ids) - 1)
            ranks[at, every] = self.rank(new, np.where(at + 1 < len(ids), ids[after, every], -1))
            before = every[at > 0]
            ranks[at[before] - 1, before] = self.rank(ids[at[before] - 1, before], new[before])
            counts[of] -= 1
        return out.T[(lines < counts).T], counts


class PieceStream:
    """Ids of whole texts as bytes. A piece has a space before it; the first piece of a text has none and is stored
    under a space and its letters, which no other piece holds."""

    def __init__(self, library: Library, kind: np.dtype):
        self.library, self.kind = library, kind
        self.coder = PieceCoder(lambda parts: [self.packed(self.spelt(p)) for p in parts], lambda text: self.packed(library.ids(text)), b"".join, None, library.specials)
        self.find = self.coder.find
        self.pieces, self.parts = Store(kind, self.learn), Store(kind, self.learn_parts)
        self.merger = Merger(library) if library.merges else None

    def packed(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def spelt(self, part: str) -> list[int]:
        return [t.id for t in self.library.part(part)]

    def learn_parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        bounds, data = (np.frombuffer(b, t) for b, t in zip(parts.buffers()[1:], (np.int64, np.uint8), strict=True))
        sizes, least = np.diff(bounds[: len(parts) + 1]).astype(np.int32), 0
        # Parts in the order they are done, their ids and numbers of ids.
        done, ids, counts = [], [], []
        for width in WIDTHS if self.merger else ():
            some = np.flatnonzero((sizes > least) & (sizes <= width))
            least = width
            if len(some):
                done.append(some)
                merged, n = self.merger.ids(data, bounds[some], sizes[some], width)
                ids.append(merged.astype(self.kind))
                counts.append(n)
        rest = np.flatnonzero(sizes > least)
        if len(rest):
            spelt = [self.spelt(p) for p in parts.take(pa.array(rest)).to_pylist()]
            done.append(rest)
            ids.append(np.array([i for s in spelt for i in s], self.kind))
            counts.append([len(s) for s in spelt])
        ends = np.append(0, np.concatenate(counts).cumsum(dtype=np.int64))
        back = np.empty(len(parts), np.int64)
        back[np.concatenate(done)] = np.arange(len(parts))
        ordered, starts = _taken(np.concatenate(ids), ends * self.kind.itemsize, back)
        return ordered, starts[1:] // self.kind.itemsize

    def learn(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.parts) > STORED_PARTS:
            self.parts.clear()
        found, ends = [], []
        for own, run in groupby(keys.to_numpy(zero_copy_only=False).tolist(), lambda k: not k or k[0] == " "):
            if own:
                for key in run:
                    found += self.find(key[1:] if key else " ")
                    ends.append(len(found))
            else:
                # No piece begins with white space, so they are cut as one text: a part that begins with a space begins a piece.
                cut = self.find(" " + " ".join(run))
                ends += [i for i, part in enumerate(cut, len(found)) if part[0] == " "][1:]
                found += cut
                ends.append(len(found))
        ids, starts = self.parts.take(self.parts.numbers(pa.array(found, pa.large_string())))
        return ids, starts[ends]

    def put_together(self, texts: list[str]) -> list[bytes]:
        """The ids of texts without white space after a space, by their pieces."""
        if len(self.pieces) > STORED_PIECES:
            self.pieces.clear()
        firsts = [t.partition(" ")[0] for t in texts]
        # The rest of a text begins with a space or is empty: its first piece is empty and gives way to the text's first.
        cut = pc.split_pattern(pa.array([t[len(f) :] for t, f in zip(texts, firsts, strict=True)], pa.large_string()), " ")
        numbers = self.pieces.numbers(pa.concat_arrays([cut.values, pa.array([" " + f for f in firsts], pa.large_string())]))
        bounds = cut.offsets.to_numpy()
        places = numbers[: bounds[-1]]
        places[bounds[:-1]] = numbers[bounds[-1] :]
        ids, starts = self.pieces.take(places)
        cuts = starts[bounds].tolist()
        return [ids[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of `texts` in their order."""
        out = [b""] * len(texts)
        plain = []
        for i, text in enumerate(texts):
            if not text:
                continue
            if self.coder.unfit(text):
                out[i] = self.coder.whole(text)
            elif SPACES(text):
                out[i] = self.coder.spelled(text)
            else:
                plain.append(i)
        if plain:
            for i, ids in zip(plain, self.put_together([texts[i] for i in plain]), strict=True):
                out[i] = ids
        return out
