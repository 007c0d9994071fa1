"""BPE encoding and decoding with forced boundaries.

A pair of neighbouring bytes that stands inside no vocabulary token is a cut that every encoding must have, so a
piece falls apart there into fragments that are merged on their own and whose ids are simply joined. Fragments and
blank-free chunks repeat endlessly in text; both are remembered in each task, up to a bound.
"""

from __future__ import annotations

import heapq
import json
import re

import numpy as np
import regex
from pyspark.sql import DataFrame

from kinetable.llm.common import annotated, worker_state

#: Remembered entries of each kind in one task, and the longest entry in bytes.
CACHE_ENTRIES, CACHE_BYTES = 400_000, 48


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary: the byte's own where it is
    printable in Latin-1, else the next free one from 256."""
    own = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Tables of one tokenizer file: ids, merge ranks, and the byte pairs that occur inside a token."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = model["vocab"]
        self.merges = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(model["merges"])}
        self.tokens = {i: t for t, i in self.ids.items()} | {a["id"]: a["content"] for a in spec["added_tokens"]}
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.split_special = re.compile("|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        tok = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = tok.normalizer, tok.pre_tokenizer
        first = spec["pre_tokenizer"]["pretokenizers"][0] if spec["pre_tokenizer"].get("pretokenizers") else {}
        self.simple = spec["normalizer"].get("normalizers") == _NORMAL and first.get("pattern") == {"Regex": _PATTERN}
        value = {c: b for b, c in enumerate(byte_symbols())}
        self.value = value
        self.inside = np.zeros((256, 256), bool)
        for token in self.ids:
            body = token[: -len(self.suffix)] if self.suffix and token.endswith(self.suffix) else token
            if all(c in value for c in body):
                for x, y in zip(body, body[1:]):
                    self.inside[value[x], value[y]] = True
        # The same as sets of symbols, for pieces in their printable form.
        chars = byte_symbols()
        self.joins = {chars[x] + chars[y] for x, y in zip(*np.nonzero(self.inside))}

    def fragments(self, piece: str) -> list[str]:
        """The piece cut wherever two neighbours occur inside no token."""
        cuts = [i for i in range(1, len(piece)) if piece[i - 1: i + 1] not in self.joins]
        return [piece[i:j] for i, j in zip([0, *cuts], [*cuts, len(piece)])]

    def merged(self, symbols: list[str]) -> list[int]:
        """Merge by rank, leftmost first, with a heap over a linked list: n log n for fragments of any length."""
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.merges.get
        heap = [(r, i) for i in range(n - 1) if (r := rank((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            r, i = heapq.heappop(heap)
            if not alive[i] or (j := after[i]) >= n or rank((symbols[i], symbols[j])) != r:
                continue
            symbols[i] += symbols[j]
            alive[j] = False
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := rank((symbols[h], symbols[i]))) is not None:
                heapq.heappush(heap, (r, h))
        return [self.ids[s] for s, ok in zip(symbols, alive) if ok]


class _Remembered(dict):
    """Results of ``make`` by key, for short keys, up to a bound."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        made = self.make(key)
        if len(key) <= CACHE_BYTES:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[key] = made
        return made


#: Printable characters below U+0250: composed, with one-to-one lower case but for U+0130, and of settled classes. In text of
#: these, pieces are found by pattern; the tokenizer file's own normaliser and splitter take all other text.
_PLAIN = re.compile(r"[\x21-\x7e\u00a1-\u024f]+")
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: What a tokenizer file must say for that.
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Encoder:
    """Ids and tokens of texts: blank-free chunks, their pieces and the pieces' fragments are each remembered."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.symbols = dict(enumerate(byte_symbols()))
        self.inner = _Remembered(lambda part: tuple(vocabulary.merged(list(part))))
        self.last = _Remembered(lambda part: tuple(vocabulary.merged([*part[:-1], part[-1] + vocabulary.suffix])))
        self.pieces = _Remembered(self._piece)
        self.chunks = _Remembered(self._chunk)

    def _made(self, ids: list[int]) -> tuple[bytes, str]:
        return np.array(ids, "<u4").tobytes(), " ".join([self.v.tokens[i] for i in ids])

    def _piece(self, piece: str) -> tuple[bytes, str]:
        """A piece in byte symbols: cut into fragments, each encoded independently; the last one ends the word."""
        *parts, end = self.v.fragments(piece)
        return self._made([i for part in parts for i in self.inner[part]] + list(self.last[end]))

    def _stretch(self, text: str) -> list[tuple[bytes, str]]:
        """Text without special tokens."""
        if self.v.simple and _PLAIN.fullmatch(text):
            low = text.lower()
            found = _PIECES.findall(low)
            if not low.isascii():
                found = [p.encode().decode("latin-1").translate(self.symbols) for p in found]
        else:
            found = [p for p, _ in self.v.pre_tokenizer.pre_tokenize_str(self.v.normalizer.normalize_str(text))]
        return [self.pieces[p] for p in found]

    def _chunk(self, chunk: bytes) -> tuple[bytes, str]:
        text = chunk.decode()
        if not self.v.split_special.search(text):
            made = self._stretch(text)
        else:
            made, at = [], 0
            for m in self.v.split_special.finditer(text):
                if m.start() > at:
                    made += self._stretch(text[at: m.start()])
                made.append(self._made([self.v.special[m[0]]]))
                at = m.end()
            if at < len(text):
                made += self._stretch(text[at:])
        return b"".join([m[0] for m in made]), " ".join([m[1] for m in made])

    def both(self, text: str | None) -> tuple[bytes, str]:
        """Ids of a whole text, and what they decode to. ASCII blanks never join two tokens, so chunks between them stand alone."""
        if not text:
            return b"", ""
        made = list(map(self.chunks.__getitem__, text.encode().split()))
        return b"".join([m[0] for m in made]), " ".join([m[1] for m in made if m[0]])

    def encode(self, text: str | None) -> bytes:
        return self.both(text)[0]

    def decode(self, raw: bytes) -> str:
        """Tokens joined by spaces, special ones included: this vocabulary has no decoder of its own."""
        tokens = self.v.tokens
        return " ".join([tokens[i] for i in np.frombuffer(raw, "<u4").tolist() if i in tokens])


def encoded(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Columns ``row`` (all of ``df``), ``ids`` (little-endian unsigned 32-bit integers) and ``decoded``.

    One row for each row of ``df``; null, empty and blank texts have no ids and decode to an empty text. Each row is
    encoded by itself, so ties and repeated rows come out alike. An empty table gives an empty result, and columns of ``df``
    stay inside ``row``, where names cannot clash. ``path``: a tokenizer file that every executor has.
    """

    def make():
        encoder = worker_state(("bpe", path), lambda: Encoder(Vocabulary(path)))

        def run(texts: list) -> list[list]:
            made = [encoder.both(t) for t in texts]
            return [[m[0] for m in made], [m[1] for m in made]]

        return run

    return annotated(df, make, text, "ids binary, decoded string")
