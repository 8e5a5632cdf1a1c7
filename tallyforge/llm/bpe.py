"""Encoding of a corpus with a public byte-level BPE vocabulary, as a lazily determinised transducer.

The encoding of a prefix is known by its last token: a token t ending at byte i is the last one exactly if t and
the last token of what stands before it are a valid pair, that is, if merging their bytes gives the two again. So a
state holds the bytes not yet emitted, the last token at each of them, and the token emitted before; a transition
reads one byte and emits the tokens that every continuation shares. No token is longer than the longest entry, so
the lookahead is bounded. States and transitions are made when first needed and kept, up to a bound, beyond
which the machine starts afresh. Decoding is a stream through a UTF-8 state machine.

Defined results: a null and an empty text give an empty list; blank texts are encoded as they are; strings that
look like special tokens are ordinary text; lone surrogates become U+FFFD; repeated rows are kept, as many as there are.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.session import spread

#: How text is cut before merging; fixed by the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MAX_STATES, MAX_PIECES, LONG_PIECE = 400_000, 400_000, 64


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """TOKENIZER_DIR, else /opt/tokenizers."""
    return os.path.join(os.environ.get("TOKENIZER_DIR", "/opt/tokenizers"), name)


class Transducer:
    """Bytes of one piece to token ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.bytes_of = ranks, {v: k for k, v in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.prefixes = {k[:i] for k in ranks for i in range(1, len(k))}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        # state: (token before, pending bytes, last token at each pending byte)
        self.states: list[tuple[int, bytes, tuple[int, ...]]] = [(-1, b"", ())]
        self.ids = {self.states[0]: 0}
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Plain merging by rank; defines what a valid pair is."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            found = min(((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))))
            if found[0] == 1 << 60:
                break
            i = found[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def valid(self, a: int, b: int) -> bool:
        if (v := self.pairs.get((a, b))) is None:
            if len(self.pairs) > 4 * MAX_STATES:
                self.pairs.clear()
            v = self.pairs[a, b] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return v

    def _chain(self, lasts: tuple[int, ...] | list[int], end: int) -> list[int]:
        out = []
        while end > 0:
            out.append(t := lasts[end - 1])
            end -= len(self.bytes_of[t])
        return out[::-1]

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        before, pending, lasts = self.states[state]
        pending += bytes([byte])
        n = len(pending)
        for size in range(min(n, self.longest), 0, -1):
            t = self.ranks.get(pending[n - size :])
            if t is None:
                continue
            left = lasts[n - size - 1] if n > size else before
            if left < 0 or self.valid(left, t):
                break
        else:
            raise ValueError("the vocabulary lacks a byte")
        lasts = (*lasts, t)
        # tokens may still begin at a place from which the pending bytes begin an entry, or at the end
        heads = [j for j in range(n) if pending[j:] in self.prefixes] + [n]
        chains = [self._chain(lasts, j) for j in heads]
        sure = []
        for column in zip(*chains):
            if any(x != column[0] for x in column):
                break
            sure.append(column[0])
        cut = sum(len(self.bytes_of[t]) for t in sure)
        if sure:
            before, pending, lasts = sure[-1], pending[cut:], lasts[cut:]
        key = (before, pending, lasts)
        if (to := self.ids.get(key)) is None:
            to = self.ids[key] = len(self.states)
            self.states.append(key)
        return to, tuple(sure)

    def encode(self, piece: bytes) -> list[int]:
        if len(self.states) > MAX_STATES:
            self.reset()
        at, out, moves = 0, [], self.moves
        for byte in piece:
            k = at << 8 | byte
            if (m := moves.get(k)) is None:
                m = moves[k] = self._move(at, byte)
            at, emitted = m
            if emitted:
                out += emitted
        _, pending, lasts = self.states[at]
        return out + self._chain(lasts, len(pending))


class Encoder:
    """Texts to token ids; pieces met before are remembered, up to a bound."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.machine, self.cut, self.seen = Transducer(ranks), regex.compile(pattern), {}

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        seen = self.seen
        for piece in self.cut.findall(text):
            ids = seen.get(piece)
            if ids is None:
                ids = self.machine.encode(piece.encode("utf-8", "replace") if piece.isascii() else piece.encode("utf-8", "surrogatepass").decode("utf-8", "replace").encode())
                if len(piece) <= LONG_PIECE:
                    if len(seen) >= MAX_PIECES:
                        seen.clear()
                    seen[piece] = ids
            out += ids
        return out


class Utf8Machine:
    """Bytes in, characters out, keeping at most three bytes; a broken sequence gives U+FFFD."""

    def __init__(self):
        self.code, self.left, self.low, self.high = 0, 0, 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        out = []
        for b in data:
            if self.left:
                if self.low <= b <= self.high:
                    self.code, self.left, self.low, self.high = self.code << 6 | b & 0x3F, self.left - 1, 0x80, 0xBF
                    if not self.left:
                        out.append(chr(self.code))
                    continue
                out.append("�")
                self.left, self.low, self.high = 0, 0x80, 0xBF
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xDF:
                self.code, self.left = b & 0x1F, 1
            elif 0xE0 <= b <= 0xEF:
                self.code, self.left = b & 0x0F, 2
                self.low, self.high = 0xA0 if b == 0xE0 else 0x80, 0x9F if b == 0xED else 0xBF
            elif 0xF0 <= b <= 0xF4:
                self.code, self.left = b & 0x07, 3
                self.low, self.high = 0x90 if b == 0xF0 else 0x80, 0x8F if b == 0xF4 else 0xBF
            else:
                out.append("�")
        return "".join(out)

    def close(self) -> str:
        out, self.left = "�" if self.left else "", 0
        return out


def decode(ids: Iterable[int], bytes_of: dict[int, bytes]) -> Iterator[str]:
    """Text of a stream of ids, piece by piece; every character comes out as soon as its last byte is there."""
    machine = Utf8Machine()
    for i in ids:
        if s := machine.feed(bytes_of[i]):
            yield s
    if s := machine.close():
        yield s


@lru_cache(maxsize=2)
def load(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(load(path))


def encode_corpus(documents: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) of every row; no shuffle."""
    path = path or vocabulary_path()

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(path)
        for b in batches:
            yield pd.Series([e.encode(x if isinstance(x, str) else None) for x in b])

    return spread(documents.select(key, text)).select(F.col(key), ids(F.col(text)).alias("ids"))
