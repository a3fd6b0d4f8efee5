"""Token automata: byte automata lifted to tokens, and the protocol for one's own.

Every literal predicate is a byte automaton with a table ``delta[state, byte]``.
Lifted to a dictionary, a token moves a state by all its bytes at once.  The
``eager`` lift fills the table (state, token) on compilation, ``lazy`` fills a
state's row when that state is first met, ``online`` keeps no table and steps
through the bytes.  All three give the same results.

``scan_batch`` runs automata over many rows at a time.  Substring automata start
wherever a token leaves their start state, all such places of all rows together,
so a long row costs what its bytes do.  The others, which settle within the length
of their pattern, advance row by row, token position by token position.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable
from typing import Protocol, runtime_checkable

import numpy as np

from stringloom.operators.config import MAX_TOKEN
from stringloom.operators.dictionary import Dictionary

MODES = ("eager", "lazy", "online")


class PatternTrie:
    """Byte-level trie of many patterns with failure links; no limit on nodes or lengths."""

    def __init__(self, patterns: Iterable[bytes | str]):
        self.patterns = tuple(p.encode() if isinstance(p, str) else bytes(p) for p in patterns)
        self.edges: list[dict[int, int]] = [{}]
        self.accepting = [False]
        for p in self.patterns:
            node = 0
            for b in p:
                if b not in self.edges[node]:
                    self.edges[node][b] = len(self.edges)
                    self.edges.append({})
                    self.accepting.append(False)
                node = self.edges[node][b]
            self.accepting[node] = True
        self.fail = [0] * len(self.edges)
        self.order = []  # breadth first
        queue = deque(self.edges[0].values())
        while queue:
            node = queue.popleft()
            self.order.append(node)
            for b, child in self.edges[node].items():
                self.fail[child] = self.advance(self.fail[node], b)
                self.accepting[child] |= self.accepting[self.fail[child]]
                queue.append(child)

    num_states = property(lambda self: len(self.edges))
    num_patterns = property(lambda self: len(self.patterns))

    def advance(self, node: int, byte: int) -> int:
        while node and byte not in self.edges[node]:
            node = self.fail[node]
        return self.edges[node].get(byte, 0)

    def is_accepting(self, node: int) -> bool:
        return self.accepting[node]

    def fail_link(self, node: int) -> int:
        return self.fail[node]

    def edge_labels(self, node: int) -> list[int]:
        return sorted(self.edges[node])


class ByteAutomaton:
    """delta (states x 256), accepting states, and the states that cannot be left.

    ``depth``, where given, says that the automaton looks for patterns anywhere:
    a state stands for the longest end of the input that begins a pattern, and
    this is its length.
    """

    def __init__(self, delta: np.ndarray, accept: np.ndarray, start: int = 0, depth: np.ndarray | None = None):
        self.delta, self.accept, self.start, self.depth = delta, accept, start, depth
        self.final = (delta == np.arange(len(delta))[:, None]).all(axis=1)

    @classmethod
    def any_of(cls, patterns: PatternTrie | Iterable[bytes | str]) -> ByteAutomaton:
        """Accepts what contains one of the patterns; it stays accepting from then on."""
        trie = patterns if isinstance(patterns, PatternTrie) else PatternTrie(patterns)
        delta = np.zeros((trie.num_states, 256), dtype=np.int32)
        depth = np.zeros(trie.num_states, dtype=np.int64)
        for b, child in trie.edges[0].items():
            delta[0, b], depth[child] = child, 1
        for node in trie.order:
            delta[node] = delta[trie.fail[node]]
            for b, child in trie.edges[node].items():
                delta[node, b], depth[child] = child, depth[node] + 1
        accept = np.array(trie.accepting)
        hit = np.flatnonzero(accept)
        delta[hit] = hit[:, None]
        return cls(delta, accept, depth=depth)

    @classmethod
    def substring(cls, pattern: bytes) -> ByteAutomaton:
        return cls.any_of([pattern])

    @classmethod
    def prefix(cls, pattern: bytes) -> ByteAutomaton:
        n = len(pattern)
        delta = np.full((n + 2, 256), n + 1, dtype=np.int32)  # n accepts, n + 1 is dead
        for i, b in enumerate(pattern):
            delta[i, b] = i + 1
        delta[n] = n
        return cls(delta, np.arange(n + 2) == n)

    @classmethod
    def equal(cls, value: bytes) -> ByteAutomaton:
        n = len(value)
        delta = np.full((n + 2, 256), n + 1, dtype=np.int32)
        for i, b in enumerate(value):
            delta[i, b] = i + 1
        return cls(delta, np.arange(n + 2) == n)


class Lifted:
    """A byte automaton over the tokens of one dictionary."""

    def __init__(self, bytes_: ByteAutomaton, dictionary: Dictionary, mode: str = "lazy"):
        if mode not in MODES:
            raise ValueError(f"mode is one of {MODES}")
        self.bytes, self.dictionary, self.mode = bytes_, dictionary, mode
        self.rows: list[np.ndarray | None] = [None] * len(bytes_.delta)
        self.table: np.ndarray | None = None
        if mode == "eager":
            self.table = np.stack([self._row(s) for s in range(len(bytes_.delta))])

    def _row(self, state: int) -> np.ndarray:
        """Exit state of every token entered in ``state``."""
        tokens, size = self.dictionary.matrix, self.dictionary.lengths
        out = np.full(len(tokens), state, dtype=np.int32)
        if not self.bytes.final[state]:
            for p in range(MAX_TOKEN):
                live = size > p
                if not live.any():
                    break
                out[live] = self.bytes.delta[out[live], tokens[live, p]]
        return out

    def step(self, states: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Next states of rows in ``states`` that read ``tokens``."""
        if self.table is not None:
            return self.table[states, tokens]
        if self.mode == "online":
            out, matrix, size = states.copy(), self.dictionary.matrix, self.dictionary.lengths[tokens]
            for p in range(int(size.max(initial=0))):
                live = size > p
                out[live] = self.bytes.delta[out[live], matrix[tokens[live], p]]
            return out
        out = np.empty_like(states)
        for s in np.unique(states).tolist():
            if self.rows[s] is None:
                self.rows[s] = self._row(s)
            own = states == s
            out[own] = self.rows[s][tokens[own]]
        return out

    @property
    def accept(self) -> np.ndarray:
        return self.bytes.accept

    @property
    def final(self) -> np.ndarray:
        return self.bytes.final


def scan_batch(automata: list[Lifted], values: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """For each automaton the verdicts of the rows values[offsets[i] : offsets[i + 1]]."""
    walked = [a for a in automata if a.bytes.depth is None or a.final[a.bytes.start]]
    verdicts = iter(_walk(walked, values, offsets))
    return [next(verdicts) if a in walked else _search(a, values, offsets) for a in automata]


def _search(a: Lifted, values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The rows that hold a pattern.

    A match begins in a token that leaves the start state.  From each such token
    a run goes on while its state still reaches back into that token; what begins
    later is left to the run of its own token.
    """
    low, high, start = offsets[0], offsets[-1], a.bytes.start
    found, size = np.zeros(len(offsets) - 1, dtype=bool), a.dictionary.lengths
    seen = np.flatnonzero(np.bincount(values[low:high], minlength=len(size)))
    after = np.full(len(size), start, dtype=np.int32)
    after[seen] = a.step(np.full(len(seen), start, dtype=np.int32), seen)
    at = np.flatnonzero((after != start)[values[low:high]]) + low
    row, state, read = np.searchsorted(offsets, at, "right") - 1, after[values[at]], np.zeros(len(at), dtype=np.int64)
    while len(at):
        found[row[a.accept[state]]] = True
        live = (a.bytes.depth[state] > read) & (at + 1 < offsets[row + 1]) & ~found[row]
        at, row, state, read = at[live] + 1, row[live], state[live], read[live]
        read += size[values[at]]
        state = a.step(state, values[at])
    return found


def _walk(automata: list[Lifted], values: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Verdicts of automata that step through the rows together, in one pass over the tokens."""
    if not automata:
        return []
    size = np.diff(offsets)
    order = np.argsort(-size, kind="stable")  # rows still running are a prefix
    states = [np.full(len(size), a.bytes.start, dtype=np.int32) for a in automata]
    begin, size = offsets[:-1][order], size[order]
    live = np.arange(len(size))
    for j in range(int(size[0]) if len(size) else 0):
        live = live[: int(np.searchsorted(-size[live], -j, "left"))]
        if j % 8 == 0:  # rows on which every automaton has settled need no more tokens
            settled = np.ones(len(live), dtype=bool)
            for a, s in zip(automata, states, strict=True):
                settled &= a.final[s[live]]
            live = live[~settled]
        if not len(live):
            break
        tokens = values[begin[live] + j]
        for a, s in zip(automata, states, strict=True):
            s[live] = a.step(s[live], tokens)
    out = []
    for a, s in zip(automata, states, strict=True):
        verdict = np.empty(len(s), dtype=bool)
        verdict[order] = a.accept[s]
        out.append(verdict)
    return out


@runtime_checkable
class TokenPredicate(Protocol):
    """What an automaton of one's own provides; ``is_dead`` may be left out."""

    def step(self, token: int) -> None: ...

    def is_accepted(self) -> bool: ...

    def reset(self) -> None: ...


class TokenAutomaton:
    """Base of automata that step token by token; combines by ``~``, ``&`` and ``|``."""

    def is_dead(self) -> bool:
        return False

    def __invert__(self):
        return Negated(self)

    def __and__(self, other):
        return Both(self, other)

    def __or__(self, other):
        return Either(self, other)


class LiteralAutomaton(TokenAutomaton):
    """Steps one row through a lifted byte automaton."""

    def __init__(self, lifted: Lifted):
        self.lifted = lifted
        self.reset()

    def reset(self) -> None:
        self.state = self.lifted.bytes.start

    def step(self, token: int) -> None:
        if self.lifted.mode == "online":
            for b in self.lifted.dictionary.tokens[token]:
                self.state = int(self.lifted.bytes.delta[self.state, b])
        else:
            self.state = int(self.lifted.step(np.array([self.state], dtype=np.int32), np.array([token]))[0])

    def is_accepted(self) -> bool:
        return bool(self.lifted.accept[self.state])

    def is_dead(self) -> bool:
        return bool(self.lifted.final[self.state])


def _dead(x) -> bool:
    return getattr(x, "is_dead", lambda: False)()


class Negated(TokenAutomaton):
    def __init__(self, part):
        self.part = part

    def step(self, token):
        self.part.step(token)

    def reset(self):
        self.part.reset()

    def is_accepted(self):
        return not self.part.is_accepted()

    def is_dead(self):
        return _dead(self.part)


class _Pair(TokenAutomaton):
    #: The verdict of one part that decides the pair.
    decides: bool

    def __init__(self, left, right):
        # One object on both sides is stepped once.
        self.parts = (left,) if left is right else (left, right)

    def step(self, token):
        for p in self.parts:
            p.step(token)

    def reset(self):
        for p in self.parts:
            p.reset()

    def is_dead(self):
        dead = [_dead(p) for p in self.parts]
        return all(dead) or any(d and p.is_accepted() == self.decides for d, p in zip(dead, self.parts, strict=True))


class Both(_Pair):
    decides = False

    def is_accepted(self):
        return all(p.is_accepted() for p in self.parts)


class Either(_Pair):
    decides = True

    def is_accepted(self):
        return any(p.is_accepted() for p in self.parts)


def drive(automaton: TokenPredicate, stream: Iterable[int]) -> bool:
    """The verdict on one row; reading ends once the automaton is dead."""
    automaton.reset()
    for token in stream:
        if _dead(automaton):
            break
        automaton.step(token)
    return automaton.is_accepted()
