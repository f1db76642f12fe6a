r"""Byte-level BPE over whole texts by lookup: a broadcast tier of frequent pieces, then worker caches.

A text is cut before every space; where no space is followed by white space, the pre-tokeniser always cuts
there, so the tokens of a text are those of its pieces in a row. A piece that no tier holds is cut
by the pre-tokeniser's own pattern and its parts are looked up or encoded by the library. Texts where the
shortcut could differ go to the library whole: those that hold an added token's string, or a code point whose
class differs between the Unicode tables of the two pattern libraries. Pieces that many texts miss are cut in one call.
Nothing is shuffled.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Callable, Iterable

import regex

# Fixed value: the pattern of the byte-level pre-tokeniser.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Code points that the Unicode tables in use may class differently.
UNSETTLED = re.compile("[՘֋֌࢏౜೜₏₝-₟꟎-꟱꭬꭭\U00010000-\U0001efff\U00020000-\U0010ffff]")
SPACES = re.compile(r" \s").search
# Pieces and parts a worker keeps beside the broadcast tier before it starts anew (about 120 MB).
CACHE_PIECES, CACHE_PARTS = 600_000, 400_000
# Pieces no tier holds that are cut and encoded together, about.
TOGETHER = 20_000


class Tier(dict):
    """key -> value; computes what is missing, many keys at a time, and forgets all but the frequent tier when full."""

    def __init__(self, compute: Callable[[list[str]], list], frequent: dict | None = None, limit: int = CACHE_PARTS):
        super().__init__(frequent or {})
        self.compute, self.frequent, self.limit = compute, frequent or {}, limit + len(frequent or {})

    def learnt(self, keys: Iterable[str]) -> dict:
        """The values of `keys`, none of which is held."""
        keys = list(dict.fromkeys(keys))
        new = dict(zip(keys, self.compute(keys), strict=True))
        if len(self) + len(new) > self.limit:
            self.clear()
            self.update(self.frequent)
        self.update(new)
        return new

    def all(self, keys: list[str]) -> list:
        """The values of `keys` in their order."""
        values = [*map(self.get, keys)]
        if None in values:
            gaps = [i for i, v in enumerate(values) if v is None]
            new = self.learnt(keys[i] for i in gaps)
            for i in gaps:
                values[i] = new[keys[i]]
        return values


class PieceCoder:
    """Values of whole texts, put together from the values of their pieces.

    `encode(parts)` gives the values of pre-tokens, `whole(text)` that of a text the shortcut does not fit,
    `join(values)` that of pieces in a row. `specials` are strings the library treats as added tokens.
    """

    def __init__(self, encode: Callable, whole: Callable, join: Callable, frequent: dict | None = None, specials: Iterable[str] = ()):
        self.find = regex.compile(PATTERN).findall
        self.join, self.whole, self.specials = join, whole, tuple(specials)
        self.parts = Tier(encode, limit=CACHE_PARTS)
        self.pieces = Tier(self.several, frequent, CACHE_PIECES)

    def unfit(self, text: str) -> bool:
        """Whether the shortcut could differ from the library."""
        return bool(not text.isascii() and UNSETTLED.search(text)) or any(s in text for s in self.specials)

    def spelled(self, text: str):
        return self.join(self.parts.all(self.find(text)))

    def several(self, pieces: list[str]) -> list:
        """Values of different pieces, a space before each. No piece begins with white space, so they are cut as one text."""
        full = [p for p in pieces if p]
        found = self.find(" " + " ".join(full)) if full else []
        values = self.parts.all(found)
        # Pieces hold no space: a part that begins with one begins a piece.
        bounds = [*[i for i, part in enumerate(found) if part[0] == " "], len(found)]
        new = {p: self.join(values[a:b]) for p, a, b in zip(full, bounds[:-1], bounds[1:], strict=True)}
        return [new[p] if p else self.spelled(" ") for p in pieces]

    def all(self, texts: list[str | None]) -> list:
        """The values of `texts` in their order."""
        out: list = [None] * len(texts)
        waiting, missing = [], 0

        def fill() -> None:
            new = self.pieces.learnt(p for *_, lacks in waiting for p in lacks)
            for i, values, gaps, lacks in waiting:
                for gap, piece in zip(gaps, lacks, strict=True):
                    values[gap] = new[piece]
                out[i] = self.join(values)
            waiting.clear()

        for i, text in enumerate(texts):
            if not text:
                out[i] = self.join(())
            elif self.unfit(text):
                out[i] = self.whole(text)
            elif SPACES(text):
                out[i] = self.spelled(text)
            else:
                pieces = text.split(" ")
                values = [*map(self.pieces.get, pieces)]
                values[0] = self.spelled(pieces[0])
                if None not in values:
                    out[i] = self.join(values)
                    continue
                gaps = [k for k, v in enumerate(values) if v is None]
                waiting.append((i, values, gaps, [pieces[k] for k in gaps]))
                missing += len(gaps)
                if missing >= TOGETHER:
                    fill()
                    missing = 0
        fill()
        return out

    def of(self, text: str | None):
        return self.all([text])[0]


def frequent_pieces(texts: Iterable[str | None], size: int) -> list[str]:
    """The most frequent pieces of sample texts, ties by spelling."""
    seen: Counter[str] = Counter()
    for text in texts:
        if text and not UNSETTLED.search(text):
            seen.update(p for p in text.split(" ")[1:] if p)
    return [p for p, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:size]]


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = (b for b in range(256) if b not in shown)
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


BYTE_LETTERS = _byte_letters()


class Library:
    """A tokenizer file as its own library reads it: ids of whole texts, and of pre-tokens if it is plain byte-level BPE.

    No begin, end or other tokens are added, nothing is cut or padded; added tokens inside a text are found
    as the library finds them by default.
    """

    def __init__(self, path: str):
        self.plain, self.specials, self.size, self.merges = False, (), 0, []
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.size = model.get_piece_size()
            self.ids = lambda text: model.encode(text, num_threads=1) if text else []
            return
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self.size = tokenizer.get_vocab_size()
        self.ids = lambda text: tokenizer.encode(text, add_special_tokens=False).ids if text else []
        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        pre, kind = config.get("pre_tokenizer") or {}, config["model"]
        self.specials = tuple(t["content"] for t in config.get("added_tokens") or [])
        self.plain = config.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and bool(pre.get("use_regex", True)) and kind.get("type") == "BPE" and not kind.get("dropout")
        self.byte_ids = [kind["vocab"].get(BYTE_LETTERS[b], -1) for b in range(256)] if self.plain else []
        self.model = tokenizer.model
        self.merges = self._merges(kind) if self.plain else []

    @staticmethod
    def _merges(kind: dict) -> list[tuple[int, int, int]]:
        """`(left, right, both)` ids in the order of the merges; empty, if more than merges of bytes decides."""
        vocab = kind["vocab"]
        if kind.get("continuing_subword_prefix") or kind.get("end_of_word_suffix") or kind.get("ignore_merges") or not all(x in vocab for x in BYTE_LETTERS.values()):
            return []
        pairs = (m.split(" ") if isinstance(m, str) else m for m in kind["merges"])
        return [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]

    def part(self, part: str) -> list:
        """Tokens of one pre-token."""
        plain = part.isascii() and part.isprintable()
        return self.model.tokenize(part.replace(" ", BYTE_LETTERS[0x20]) if plain else part.encode().decode("latin-1").translate(BYTE_LETTERS))
