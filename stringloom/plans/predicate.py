"""Literal predicates over a string column, written once and run on raw or encoded data.

Patterns are literal bytes; ``%`` and ``_`` mean themselves.  On raw columns a
tree becomes a Catalyst expression, so conjuncts reach the Parquet scan.  On
encoded columns equality and prefix become array expressions and anything with a
substring becomes one fused Arrow UDF that walks each row once.  Nulls follow
SQL's three-valued logic in both.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DataType

from stringloom.operators.automata import ByteAutomaton, Lifted, LiteralAutomaton, TokenAutomaton, drive, scan_batch
from stringloom.operators.dictionary import Dictionary

#: Patterns from which an any-of on raw data is one expression over an array, not a chain of tests.
MANY = 64


def as_bytes(pattern: str | bytes) -> bytes:
    return pattern.encode() if isinstance(pattern, str) else bytes(pattern)


def _literal(pattern: bytes, kind: DataType) -> Column:
    return F.lit(bytearray(pattern)) if isinstance(kind, BinaryType) else F.lit(pattern.decode())


class Predicate:
    """A node of the tree; combine with ``&``, ``|`` and ``~``."""

    #: Whether arrays express it on encoded data without a UDF.
    native = False

    def __and__(self, other: Predicate) -> Predicate:
        return self if self == other else And(self, other)

    def __or__(self, other: Predicate) -> Predicate:
        return self if self == other else Or(self, other)

    def __invert__(self) -> Predicate:
        return self.part if isinstance(self, Not) else Not(self)

    def column(self, col: Column, kind: DataType) -> Column:
        """The predicate on a raw column of type STRING or BINARY."""
        raise NotImplementedError

    def matches(self, value: bytes) -> bool:
        """The verdict on one value."""
        raise NotImplementedError

    def arrays(self, tokens: Column, dictionary: Dictionary) -> Column:
        """The predicate on a token array, for native trees."""
        raise NotImplementedError

    def leaves(self) -> list[Predicate]:
        return [self]

    def combine(self, verdicts: dict[Predicate, np.ndarray]) -> np.ndarray:
        """The verdicts of the tree from those of its leaves."""
        return verdicts[self]

    def automaton(self, dictionary: Dictionary, mode: str = "lazy") -> TokenAutomaton:
        """A stepping automaton, to combine with one's own."""
        raise NotImplementedError

    def tokens(self, tokens: Column, dictionary: Dictionary, mode: str = "lazy", *, native: bool = True) -> Column:
        """The predicate on a column of token arrays encoded with ``dictionary``."""
        if native and self.native:
            return self.arrays(tokens, dictionary)
        return _fused(self, dictionary, mode)(tokens)

    def describe(self, dictionary: Dictionary | None = None) -> dict:
        """Sizes of the compiled form, for inspection."""
        leaves = list(dict.fromkeys(self.leaves()))
        return {"leaves": len(leaves), "native": self.native, "parts": [p.sizes(dictionary) for p in leaves]}

    def sizes(self, dictionary: Dictionary | None) -> dict:
        return {}


@dataclass(frozen=True)
class _Leaf(Predicate):
    pattern: bytes

    def __init__(self, pattern: str | bytes):
        object.__setattr__(self, "pattern", as_bytes(pattern))

    def bytes_automaton(self) -> ByteAutomaton:
        raise NotImplementedError

    def automaton(self, dictionary, mode="lazy"):
        return LiteralAutomaton(Lifted(self.bytes_automaton(), dictionary, mode))


@dataclass(frozen=True, init=False)
class Contains(_Leaf):
    """The value contains the pattern; the empty pattern is in every value."""

    def column(self, col, kind):
        return F.contains(col, _literal(self.pattern, kind))

    def matches(self, value):
        return self.pattern in value

    def bytes_automaton(self):
        return ByteAutomaton.substring(self.pattern)

    def sizes(self, dictionary):
        return {"kind": "contains", "pattern_length": len(self.pattern), "num_states": len(self.pattern) + 1}


@dataclass(frozen=True, init=False)
class StartsWith(_Leaf):
    """The value begins with the pattern."""

    native = True

    def column(self, col, kind):
        return F.startswith(col, _literal(self.pattern, kind))

    def matches(self, value):
        return value.startswith(self.pattern)

    def bytes_automaton(self):
        return ByteAutomaton.prefix(self.pattern)

    def ranges(self, dictionary: Dictionary) -> list[tuple[int, list[int], int, int]]:
        """(i, first i tokens, lo, hi): a row matches if it begins with these tokens and its next is in lo ... hi.

        Greedy parses of row and query part where the row's token reaches past the
        rest of the query; that token then begins with the rest.
        """
        query, out, at = dictionary.tokenize(self.pattern), [], 0
        for i, token in enumerate(query):
            span = dictionary.prefix_range(self.pattern[at:])
            if not span.empty:
                out.append((i, query[:i], span.begin, span.last))
            at += dictionary.token_size(token)
        return out

    def arrays(self, tokens, dictionary):
        if not self.pattern:
            return F.when(tokens.isNotNull(), F.lit(True))
        tests = []
        for i, head, lo, hi in self.ranges(dictionary):
            test = F.get(tokens, F.lit(i)).between(lo, hi)
            if head:
                test = (F.slice(tokens, 1, i) == F.array(*map(F.lit, head))) & test
            tests.append(F.coalesce(test, F.lit(False)))
        return F.when(tokens.isNotNull(), reduce(lambda a, b: a | b, tests, F.lit(False)))

    def sizes(self, dictionary):
        out = {"kind": "starts_with", "pattern_length": len(self.pattern)}
        return out | ({"query_length": len(dictionary.tokenize(self.pattern)), "sparse_range_count": len(self.ranges(dictionary))} if dictionary else {})


@dataclass(frozen=True, init=False)
class Equals(_Leaf):
    """The value is the pattern; equal values have equal tokens."""

    native = True

    def column(self, col, kind):
        return col == _literal(self.pattern, kind)

    def matches(self, value):
        return value == self.pattern

    def bytes_automaton(self):
        return ByteAutomaton.equal(self.pattern)

    def arrays(self, tokens, dictionary):
        query = dictionary.tokenize(self.pattern)
        return tokens == (F.array(*map(F.lit, query)) if query else F.array().cast("array<int>"))

    def sizes(self, dictionary):
        return {"kind": "equals", "pattern_length": len(self.pattern)} | ({"query_length": len(dictionary.tokenize(self.pattern))} if dictionary else {})


@dataclass(frozen=True)
class ContainsAny(Predicate):
    """The value contains one of the patterns; of none it contains none."""

    patterns: tuple[bytes, ...]

    def __init__(self, patterns: Iterable[str | bytes]):
        object.__setattr__(self, "patterns", tuple(dict.fromkeys(map(as_bytes, patterns))))

    def column(self, col, kind):
        if len(self.patterns) > MANY:
            return F.when(col.isNotNull(), F.exists(F.array(*(_literal(p, kind) for p in self.patterns)), lambda p: F.contains(col, p)))
        if not self.patterns:
            return F.when(col.isNotNull(), F.lit(False))
        return reduce(lambda a, b: a | b, (F.contains(col, _literal(p, kind)) for p in self.patterns))

    def matches(self, value):
        return any(p in value for p in self.patterns)

    def bytes_automaton(self):
        return ByteAutomaton.any_of(self.patterns)

    def automaton(self, dictionary, mode="lazy"):
        return LiteralAutomaton(Lifted(self.bytes_automaton(), dictionary, mode))

    def sizes(self, dictionary):
        return {"kind": "contains_any", "num_patterns": len(self.patterns), "num_states": len(self.bytes_automaton().delta)}


@dataclass(frozen=True)
class Not(Predicate):
    part: Predicate

    @property
    def native(self):
        return self.part.native

    def column(self, col, kind):
        return ~self.part.column(col, kind)

    def matches(self, value):
        return not self.part.matches(value)

    def arrays(self, tokens, dictionary):
        return ~self.part.arrays(tokens, dictionary)

    def leaves(self):
        return self.part.leaves()

    def combine(self, verdicts):
        return ~self.part.combine(verdicts)

    def automaton(self, dictionary, mode="lazy"):
        return ~self.part.automaton(dictionary, mode)


@dataclass(frozen=True)
class _Two(Predicate):
    left: Predicate
    right: Predicate

    @property
    def native(self):
        return self.left.native and self.right.native

    def leaves(self):
        return self.left.leaves() + self.right.leaves()


@dataclass(frozen=True)
class And(_Two):
    def column(self, col, kind):
        return self.left.column(col, kind) & self.right.column(col, kind)

    def matches(self, value):
        return self.left.matches(value) and self.right.matches(value)

    def arrays(self, tokens, dictionary):
        return self.left.arrays(tokens, dictionary) & self.right.arrays(tokens, dictionary)

    def combine(self, verdicts):
        return self.left.combine(verdicts) & self.right.combine(verdicts)

    def automaton(self, dictionary, mode="lazy"):
        return self.left.automaton(dictionary, mode) & self.right.automaton(dictionary, mode)


@dataclass(frozen=True)
class Or(_Two):
    def column(self, col, kind):
        return self.left.column(col, kind) | self.right.column(col, kind)

    def matches(self, value):
        return self.left.matches(value) or self.right.matches(value)

    def arrays(self, tokens, dictionary):
        return self.left.arrays(tokens, dictionary) | self.right.arrays(tokens, dictionary)

    def combine(self, verdicts):
        return self.left.combine(verdicts) | self.right.combine(verdicts)

    def automaton(self, dictionary, mode="lazy"):
        return self.left.automaton(dictionary, mode) | self.right.automaton(dictionary, mode)


_COMPILED: dict = {}


def _compiled(predicate: Predicate, dictionary: Dictionary, mode: str) -> tuple[list[Predicate], list[Lifted]]:
    """Leaves and their lifted automata, kept by the worker for the predicate it last ran on a dictionary."""
    key = (predicate, mode)
    if _COMPILED.get("dictionary") is not dictionary and _COMPILED.get("dictionary") != dictionary:
        _COMPILED.clear()
        _COMPILED["dictionary"] = dictionary
    if key not in _COMPILED:
        leaves = list(dict.fromkeys(predicate.leaves()))
        _COMPILED[key] = leaves, [Lifted(p.bytes_automaton(), _COMPILED["dictionary"], mode) for p in leaves]
    return _COMPILED[key]


def _fused(predicate: Predicate, dictionary: Dictionary, mode: str):
    """One Arrow UDF from token arrays to the verdict of the whole tree; null for null."""
    @F.arrow_udf(BooleanType())
    def run(tokens: pa.Array) -> pa.Array:
        leaves, automata = _compiled(predicate, dictionary, mode)
        offsets = tokens.offsets.to_numpy()
        verdicts = scan_batch(automata, tokens.values.to_numpy(zero_copy_only=False), offsets)
        out = predicate.combine(dict(zip(leaves, verdicts, strict=True)))
        return pa.array(out, mask=tokens.is_null().to_numpy(zero_copy_only=False))

    return run


def custom(automaton: TokenAutomaton):
    """A UDF that drives an automaton of one's own over a token array column; it combines with other columns."""
    @F.arrow_udf(BooleanType())
    def run(tokens: pa.Array) -> pa.Array:
        return pa.array([None if row is None else drive(automaton, row) for row in tokens.to_pylist()], pa.bool_())

    return run
