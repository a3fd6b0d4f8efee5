"""Dictionaries of byte tokens: sorted, with all single bytes, at most 16 bytes a token."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame, SparkSession

from stringloom.operators.config import MAX_BITS, MAX_TOKEN


@dataclass(frozen=True)
class TokenRange:
    """Closed range of ids; ``TokenRange(1, 0)`` is empty."""

    begin: int
    last: int

    @property
    def empty(self) -> bool:
        return self.begin > self.last

    def __len__(self) -> int:
        return max(0, self.last - self.begin + 1)

    def __contains__(self, token: int) -> bool:
        return self.begin <= token <= self.last


EMPTY = TokenRange(1, 0)


class Matcher:
    """Longest token at a position: two leading bytes choose the lengths worth a lookup."""

    def __init__(self, ids: dict[bytes, int]):
        self.ids: dict[bytes, int] = {}
        self.lengths: dict[bytes, tuple[int, ...]] = {}
        for token in ids:
            self.add(token, ids[token])

    def add(self, token: bytes, number: int) -> None:
        self.ids[token] = number
        if len(token) > 1:
            known = self.lengths.get(token[:2], ())
            if len(token) not in known:
                self.lengths[token[:2]] = tuple(sorted((*known, len(token)), reverse=True))

    def longest(self, data: bytes, at: int = 0) -> tuple[int, int]:
        """(token, length) of the longest token that begins at ``at``."""
        ids = self.ids
        for n in self.lengths.get(data[at : at + 2], ()):
            if (t := ids.get(data[at : at + n])) is not None and at + n <= len(data):
                return t, n
        return ids[data[at : at + 1]], 1

    def encode(self, data: bytes) -> list[int]:
        """Greedy longest-match parse of ``data``."""
        out, at, size, ids, lengths = [], 0, len(data), self.ids, self.lengths
        while at < size:
            for n in lengths.get(data[at : at + 2], ()):
                if at + n <= size and (t := ids.get(data[at : at + n])) is not None:
                    out.append(t)
                    at += n
                    break
            else:
                out.append(ids[data[at : at + 1]])
                at += 1
        return out


class Dictionary:
    """An immutable token dictionary; a token's id is its place in byte order."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tuple(tokens)
        if any(a >= b for a, b in zip(self.tokens, self.tokens[1:], strict=False)):
            raise ValueError("tokens must be sorted and distinct")
        if any(not 1 <= len(t) <= MAX_TOKEN for t in self.tokens):
            raise ValueError(f"tokens have 1 ... {MAX_TOKEN} bytes")
        if len(self.tokens) > 1 << MAX_BITS:
            raise ValueError(f"at most {1 << MAX_BITS} tokens")
        if sum(len(t) == 1 for t in self.tokens) != 256:
            raise ValueError("all 256 single bytes must be tokens")

    def __len__(self) -> int:
        return len(self.tokens)

    def __eq__(self, other) -> bool:
        return isinstance(other, Dictionary) and self.tokens == other.tokens

    def __hash__(self) -> int:
        return hash(self.tokens)

    def __getstate__(self):
        return self.tokens

    def __setstate__(self, tokens):
        self.tokens = tokens

    @cached_property
    def matcher(self) -> Matcher:
        return Matcher({t: i for i, t in enumerate(self.tokens)})

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        """Leftmost longest matches over Latin-1 text, one character a byte; ids as values."""
        out = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, t in enumerate(self.tokens):
            out.add_word(t.decode("latin-1"), i)
        out.make_automaton()
        return out

    @cached_property
    def lengths(self) -> np.ndarray:
        return np.array([len(t) for t in self.tokens], dtype=np.int64)

    @cached_property
    def offsets(self) -> np.ndarray:
        """n + 1 positions of the tokens in their concatenated bytes."""
        return np.r_[0, np.cumsum(self.lengths)]

    @cached_property
    def matrix(self) -> np.ndarray:
        """(tokens, 16) bytes, zero after a token's end."""
        flat = b"".join(t.ljust(MAX_TOKEN, b"\0") for t in self.tokens)
        return np.frombuffer(flat, dtype=np.uint8).reshape(-1, MAX_TOKEN)

    def data(self, token: int) -> bytes:
        return self.tokens[token]

    def token_size(self, token: int) -> int:
        return len(self.tokens[token])

    def span(self, token: int) -> tuple[int, int]:
        return int(self.offsets[token]), int(self.offsets[token + 1])

    @property
    def bytes_used(self) -> int:
        return int(self.lengths.sum()) + 4 * (len(self) + 1)

    def prefix_range(self, prefix: bytes) -> TokenRange:
        """The tokens that begin with ``prefix``."""
        if len(prefix) > MAX_TOKEN:
            return EMPTY
        low = bisect_left(self.tokens, prefix)
        bound = prefix.rstrip(b"\xff")  # the next byte string after all that begin with the prefix
        high = bisect_left(self.tokens, bound[:-1] + bytes([bound[-1] + 1]), low) if bound else len(self.tokens)
        return TokenRange(low, high - 1) if low < high else EMPTY

    def tokenize(self, text: bytes | str) -> list[int]:
        """The tokens that encoding gives ``text``."""
        return self.matcher.encode(text.encode() if isinstance(text, str) else bytes(text))

    def parsed(self, data: bytes) -> Iterator[int]:
        """The same tokens one by one, for bulk encoding: every byte is a token, so leftmost longest matches leave no gap."""
        return (t for _, t in self.automaton.iter_long(data.decode("latin-1")))

    def parse(self, data: bytes) -> list[int]:
        return list(self.parsed(data))

    def decode(self, tokens) -> bytes:
        return b"".join(map(self.tokens.__getitem__, tokens))

    def frame(self, spark: SparkSession, dict_id: int = 0) -> DataFrame:
        """dict_id, token_id, bytes, len: one row a token."""
        rows = [(dict_id, i, bytearray(t), len(t)) for i, t in enumerate(self.tokens)]
        return spark.createDataFrame(rows, "dict_id int, token_id int, bytes binary, len int")

    @classmethod
    def from_frame(cls, df: DataFrame) -> Dictionary:
        """From rows with ``bytes``; a dictionary has at most 65,536 of them."""
        return cls(sorted(bytes(r["bytes"]) for r in df.select("bytes").collect()))
