"""Encoding of whole texts with a public byte-level BPE vocabulary (problem 7).

The merges are compiled into a finite-state transducer, one state at a time as texts need them. A state is the last
settled token plus the bytes that are read but not settled yet; for every pending position the machine knows the only
token that can end there. Reading a byte moves to the next state and emits the tokens that no continuation can change
any more, so the look-ahead is bounded by the longest vocabulary entry and memory does not grow with the text.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import table

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pending bytes from which on settled tokens are looked for.
SETTLE = 24
#: States of the lazy machine and remembered pieces before both are started afresh, and the length of those that are remembered.
#: Results do not depend on them.
MAX_STATES, MAX_PIECES, MAX_PIECE = 100_000, 400_000, 64


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class Pieces(dict):
    """Ids (32 bits each) of what stands between two single spaces, the first of them included; a new piece runs through the machine.

    No word of the pre-tokeniser reaches over a space between two characters that are none. Pieces that are empty or
    begin or end with white space have no ids of their own (null): they are read together with their neighbours.
    """

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, piece: str) -> bytes | None:
        ids = None if not piece or piece[0].isspace() or piece[-1].isspace() else self.encode(" " + piece)
        if len(piece) <= MAX_PIECE:
            if len(self) >= MAX_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class State:
    __slots__ = ("anchor", "pending", "ends", "next", "tail")

    def __init__(self, anchor: int, pending: bytes, ends: tuple[int, ...]):
        self.anchor, self.pending, self.ends = anchor, pending, ends
        self.next: dict[int, tuple[State, tuple[int, ...]]] = {}
        self.tail: tuple[int, ...] | None = None


class Transducer:
    """Greedy pair merging by rank, as a machine over bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.beginnings = {b[:k] for b in ranks for k in range(1, len(b))}
        self.words = regex.compile(pattern)
        self.fits: dict[tuple[int, int], bool] = {}
        self.split: dict[int, tuple[int, int] | None] = {}
        # the longest token that ends with these two bytes
        self.reach: dict[bytes, int] = {}
        for b in ranks:
            if len(b) > self.reach.get(b[-2:], 0):
                self.reach[b[-2:]] = len(b)
        self._reset()

    @classmethod
    def load(cls, path: str | None = None, pattern: str | None = None) -> "Transducer":
        if pattern is None:
            import public_tokenizers

            pattern = public_tokenizers.PATTERN
        with open(path or vocabulary_path(), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return cls(ranks, pattern)

    def _reset(self) -> None:
        self.states: dict[tuple[int, bytes], State] = {}
        self.pieces = Pieces(self._plain)
        self.start = self._state(-1, b"", ())

    def _state(self, anchor: int, pending: bytes, ends: tuple[int, ...]) -> State:
        s = self.states.get((anchor, pending))
        if s is None:
            s = self.states[anchor, pending] = State(anchor, pending, ends)
        return s

    def merge(self, word: bytes, last: int = 1) -> list[int]:
        """Plain merging until no pair is left, or ``last`` parts; used for single tokens only."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > last:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; null for a single byte."""
        h = self.split.get(token, 0)
        if h == 0:
            word = self.bytes_of[token]
            parts = self.merge(word, 2) if len(word) > 1 else []
            h = self.split[token] = tuple(parts) if len(parts) == 2 else None
        return h

    def adjacent(self, a: int, b: int) -> bool:
        """Can b directly follow a? An encoding is right exactly if all its neighbours can.

        The merges that make a and b are undone from the last one on. Two parts that meet at the seam would have been
        merged if their pair comes before the merge that took one of them away.
        """
        if a < 0:
            return True if len(self.bytes_of[b]) == 1 else self.halves(b) is not None
        ok = self.fits.get((a, b))
        if ok is None:
            left, right, ok = a, b, True
            until = float("inf")  # the rank at which one of the two is gone
            while True:
                joined = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
                if joined is not None and joined < until:
                    ok = False
                    break
                x, y = self.halves(left), self.halves(right)
                if x is None and y is None:
                    break
                # the later of both merges is undone; of equal ones the right one, as merging goes from the left
                if y is None or (x is not None and left > right):
                    until, left = left, x[1]
                else:
                    until, right = right + 1, y[0]
            self.fits[a, b] = ok
        return ok

    def _path(self, s_pending: bytes, ends: tuple[int, ...], at: int) -> list[int]:
        """Positions at which tokens end, from the start of the pending bytes to ``at``."""
        out = []
        while at:
            out.append(at)
            at -= len(self.bytes_of[ends[at - 1]])
        return out[::-1]

    def step(self, s: State, byte: int) -> tuple[State, tuple[int, ...]]:
        pending = s.pending + bytes((byte,))
        n, ranks = len(pending), self.ranks
        last = -1
        for size in range(min(n, self.reach.get(pending[-2:], 1)), 0, -1):
            t = ranks.get(pending[n - size :])
            if t is None:
                continue
            before = s.anchor if size == n else s.ends[n - size - 1]
            if self.adjacent(before, t):
                last = t
                break
        if last < 0:
            raise ValueError("vocabulary lacks a byte")
        ends = (*s.ends, last)
        common = 0
        if n >= SETTLE and pending not in self.beginnings:
            # a token ends for good where the paths to all positions from which a later token may start agree
            shared = set(self._path(pending, ends, n))
            for j in range(max(1, n - self.longest + 1), n):
                if pending[j:] in self.beginnings:
                    shared.intersection_update(self._path(pending, ends, j))
            common = max(shared, default=0)
        if common:
            settled, at = [], common
            for p in self._path(pending, ends, common):
                settled.append(ends[p - 1])
            new = self._state(settled[-1], pending[at:], ends[at:])
            out = tuple(settled)
        else:
            new, out = self._state(s.anchor, pending, ends), ()
        s.next[byte] = (new, out)
        return new, out

    def finish(self, s: State) -> tuple[int, ...]:
        if s.tail is None:
            s.tail = tuple(s.ends[p - 1] for p in self._path(s.pending, s.ends, len(s.pending)))
        return s.tail

    def word(self, data: bytes) -> tuple[int, ...]:
        s, out = self.start, array("i")
        for b in data:
            hit = s.next.get(b)
            if hit is None:
                if len(self.states) > MAX_STATES:
                    self.states = {(self.start.anchor, self.start.pending): self.start, (s.anchor, s.pending): s}
                    self.start.next, s.next = {}, {}
                hit = self.step(s, b)
            s = hit[0]
            if hit[1]:
                out.extend(hit[1])
        out.extend(self.finish(s))
        return tuple(out)

    def _plain(self, text: str) -> bytes:
        """Ids of a text, word by word of the pre-tokeniser."""
        return array("i", chain.from_iterable(self.word(w.encode("utf-8", "replace")) for w in self.words.findall(text))).tobytes()

    def raw(self, text: str | None) -> bytes:
        """Ids of a text, 32 bits each; null and empty texts have none. Special-token strings are ordinary text.

        Texts are cut at spaces where that changes nothing, and what is between them is remembered.
        """
        if not text:
            return b""
        first, *rest = text.split(" ")
        parts = [*map(self.pieces.__getitem__, rest)]
        fine = bool(first) and not first[-1].isspace()
        if fine and None not in parts:
            return self._plain(first) + b"".join(parts)
        out, stretch, ready = [], first, None
        for piece, ids in zip(rest, parts):
            if fine and ids is not None:
                out.append(self._plain(stretch) if ready is None else ready)
                stretch, ready = " " + piece, ids
            else:
                stretch, ready = stretch + " " + piece, None
            fine = ids is not None
        return b"".join([*out, self._plain(stretch) if ready is None else ready])

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.raw(text), np.int32)

    def size(self, text: str | None) -> int:
        """Number of ids of a text."""
        return len(self.raw(text)) // 4


class Utf8Stream:
    """Incremental UTF-8 decoding: bytes may be cut anywhere, a bad byte gives one U+FFFD for each maximal broken part."""

    def __init__(self):
        self.need, self.low, self.high, self.code, self.size = 0, 0x80, 0xBF, 0, 0

    def feed(self, data: bytes) -> str:
        out = []
        i = 0
        while i < len(data):
            b = data[i]
            if self.need == 0:
                i += 1
                if b < 0x80:
                    out.append(chr(b))
                elif 0xC2 <= b <= 0xDF:
                    self.need, self.code = 1, b & 0x1F
                elif 0xE0 <= b <= 0xEF:
                    self.need, self.code = 2, b & 0x0F
                    self.low, self.high = (0xA0 if b == 0xE0 else 0x80), (0x9F if b == 0xED else 0xBF)
                elif 0xF0 <= b <= 0xF4:
                    self.need, self.code = 3, b & 0x07
                    self.low, self.high = (0x90 if b == 0xF0 else 0x80), (0x8F if b == 0xF4 else 0xBF)
                else:
                    out.append("�")
            elif self.low <= b <= self.high:
                i += 1
                self.code = self.code << 6 | b & 0x3F
                self.need -= 1
                self.low, self.high = 0x80, 0xBF
                if self.need == 0:
                    out.append(chr(self.code))
            else:  # the byte is read again from the first state
                out.append("�")
                self.need, self.low, self.high = 0, 0x80, 0xBF
        return "".join(out)

    def end(self) -> str:
        rest = "�" if self.need else ""
        self.__init__()
        return rest


@lru_cache(maxsize=4)
def machine(path: str | None) -> Transducer:
    """One machine per worker process and vocabulary."""
    return Transducer.load(path)


def decode(t: Transducer, ids) -> str:
    s = Utf8Stream()
    return "".join(s.feed(t.bytes_of[int(i)]) for i in ids) + s.end()


def ids_of(text: Column, path: str | None = None) -> Column:
    """array<int> of token ids; empty for null and empty texts."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        t = machine(path)
        for texts in batches:
            found = [t.raw(x) for x in texts.to_pylist()]
            ends = np.cumsum([0, *map(len, found)]) // 4
            yield pa.LargeListArray.from_arrays(ends, np.frombuffer(b"".join(found), np.int32)).cast(pa.list_(pa.int32()))

    return encode(text)


def sizes_of(text: Column, path: str | None = None) -> Column:
    """struct<tokens, first_line>: tokens of the text, and of its first line where there are more."""

    @F.pandas_udf("tokens int, first_line int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        t = machine(path)
        for texts in batches:
            rows = []
            for x in texts:
                first, more, rest = (x or "").partition("\n")
                one = t.size(first)
                # no word reaches over a break, but white space before it may join it
                apart = more and not first[-1:].isspace()
                rows.append(((one + t.size(more + rest) if apart else t.size(x)) if more else one, one if more else 0))
            yield pd.DataFrame(rows, columns=["tokens", "first_line"])

    return count(text)


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids of every document, in one pass and without a shuffle."""
    return docs.select("doc_id", ids_of(F.col("text"), path).alias("ids"))


def p7_ids(spark, d):
    return encode_documents(table(spark, d, "documents"))


def p7_roundtrip(spark, d):
    """doc_id, same: whether decoding the ids gives the text again (null counts as empty)."""

    @F.pandas_udf("boolean")
    def same(texts: pd.Series, ids: pd.Series) -> pd.Series:
        t = machine(None)
        return pd.Series([decode(t, i) == (x or "") for x, i in zip(texts, ids)])

    docs = table(spark, d, "documents").select("doc_id", "text", ids_of(F.col("text")).alias("ids"))
    return docs.select("doc_id", same("text", "ids").alias("same"))


QUERIES = {"p7_ids": p7_ids, "p7_roundtrip": p7_roundtrip}
ORACLE = {"p7_roundtrip": "SELECT doc_id, true AS same FROM documents"}
