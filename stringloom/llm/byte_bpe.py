"""Byte-level BPE encoding and decoding through a serialised sentencepiece model.

A rank file becomes a sentencepiece BPE model without any training: each token's
bytes map one to one to printable characters, its piece scores minus its rank,
and the normaliser is the identity.  Merging the best-scoring neighbours is then
merging the lowest rank first.  Texts are cut into pre-tokens by the vocabulary's
pattern; a pre-token that is itself a token is taken whole, any other goes to the
model.  Decoding maps ids back to token bytes.

Each worker memoises pre-tokens in a table of bounded size.

Defined results: a null text counts as empty and has no tokens.  Texts are
encoded whole, whatever their length; of equally good merges the leftmost is
taken, as the vocabulary's library does.  Repeated rows are encoded each; an empty
table gives no rows.  Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from array import array
from functools import lru_cache

import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stringloom.llm.common import as_bytes, map_batches

#: Pre-tokens that a worker remembers before it starts afresh.
MEMO = 1 << 19
#: The pattern whose words may be remembered with their leading space, and the texts where that doesn't hold.
SPACE_LED = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
AWKWARD = re.compile(r" (?:\s|\Z)").search
_LITTLE = struct.pack("=I", 1) == struct.pack("<I", 1)


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank from a file of ``base64 rank`` lines."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def byte_chars() -> list[str]:
    """A printable, non-space character for each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protobuf field: bytes are length-delimited, floats fixed, ints varints."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """The vocabulary as a sentencepiece ModelProto; piece ids equal ranks, the unknown piece comes last."""
    chars = byte_chars()
    by_rank = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("the vocabulary lacks single bytes")
    out = bytearray()
    for rank, token in enumerate(by_rank):
        piece = "".join(chars[b] for b in token).encode()
        out += _field(1, _field(1, piece) + _field(2, float(-rank)))
    out += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    none = b"".join(_field(k, -1) for k in (41, 42, 43))
    out += _field(2, _field(3, 2) + _field(4, len(by_rank) + 1) + _field(40, len(by_rank)) + none)
    out += _field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))
    return bytes(out)


class Memo(dict):
    """A table filled on demand by ``make``, started afresh at ``limit`` keys; long keys are not kept."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key: str) -> bytes | int:
        out = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[key] = out
        return out


class Codec:
    """Encoder and decoder of one vocabulary; ids travel as little-endian 32-bit words."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo: int = MEMO):
        self.ranks = ranks
        self.vocab = sorted(ranks, key=ranks.__getitem__)
        self.split = regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(ranks))
        self.chars = dict(enumerate(byte_chars()))
        self.token = Memo(self._token, memo)
        self.word = Memo(lambda w: self._plain(" " + w), memo)
        self.by_word = pattern == SPACE_LED
        self.size = Memo(lambda t: len(self._token(t)) // 4, memo)
        self.word_size = Memo(lambda w: self._count(" " + w), memo)

    def _token(self, token: str) -> bytes:
        raw = token.encode()
        rank = self.ranks.get(raw)
        ids = [rank] if rank is not None else self.model.encode(raw.decode("latin-1").translate(self.chars))
        return struct.pack(f"<{len(ids)}I", *ids)

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.token.__getitem__, self.split(text)))

    def encode(self, text: str) -> bytes:
        # A pre-token of the known pattern begins at each space before a visible
        # character, so space-led words can be remembered whole.
        if not self.by_word or AWKWARD(text):
            return self._plain(text)
        first, *rest = text.split(" ")
        return self._plain(first) + b"".join(map(self.word.__getitem__, rest))

    def _count(self, text: str) -> int:
        return sum(map(self.size.__getitem__, self.split(text)))

    def count(self, text: str) -> int:
        """The number of tokens of ``encode``, without making them."""
        if not self.by_word or AWKWARD(text):
            return self._count(text)
        first, *rest = text.split(" ")
        return self._count(first) + sum(map(self.word_size.__getitem__, rest))

    def decode(self, ids: bytes) -> bytes:
        words = array("I", ids)
        if not _LITTLE:
            words.byteswap()
        return b"".join(map(self.vocab.__getitem__, words))


@lru_cache(maxsize=2)
def _codec(digest: str, blob, pattern: str) -> Codec:
    return Codec({t: i for i, t in enumerate(blob.value)}, pattern)


def _shipped(df: DataFrame, ranks_path: str):
    """The vocabulary's digest and broadcast; a bad vocabulary fails here, on the driver."""
    ranks = read_ranks(ranks_path)
    vocab = sorted(ranks, key=ranks.__getitem__)
    model_bytes(ranks)
    return hashlib.sha256(b"\n".join(map(base64.b64encode, vocab))).hexdigest(), df.sparkSession.sparkContext.broadcast(vocab)


def count_frame(df: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens."""
    digest, blob = _shipped(df, ranks_path)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = _codec(digest, _Shared(blob), pattern)
        n = [codec.count(raw.as_py().decode("utf-8", "replace")) for raw in batch.column("__text")]
        return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_tokens": pa.array(n, pa.int64())})

    kind = df.schema[doc_id].dataType.simpleString()
    return map_batches(df.select(F.col(doc_id).alias("doc_id"), as_bytes(text).alias("__text")), run, f"doc_id {kind}, n_tokens long")


def encode_frame(df: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", *, ids: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256; with ``ids`` also the id array."""
    digest, blob = _shipped(df, ranks_path)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = _codec(digest, _Shared(blob), pattern)
        rows = []
        for raw in batch.column("__text"):
            packed = codec.encode(raw.as_py().decode("utf-8", "replace"))
            rows.append((len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(codec.decode(packed)).hexdigest(), array("I", packed).tolist() if ids else None))
        n, a, b, full = zip(*rows, strict=True)
        out = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(a), "decoded_sha256": pa.array(b)}
        return pa.RecordBatch.from_pydict(out | ({"ids": pa.array(full, pa.list_(pa.int32()))} if ids else {}))

    kind = df.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return map_batches(df.select(F.col(doc_id).alias("doc_id"), as_bytes(text).alias("__text")), run, schema)


class _Shared:
    """A broadcast that equals any other in a cache key; the digest beside it tells vocabularies apart."""

    def __init__(self, blob):
        self.blob = blob

    value = property(lambda self: self.blob.value)

    def __eq__(self, other):
        return isinstance(other, _Shared)

    def __hash__(self):
        return 0


def decode_frame(df: DataFrame, ranks_path: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id and the decoded bytes of an id array column; null arrays give null, ids outside the vocabulary fail."""
    ranks = read_ranks(ranks_path)
    blob = df.sparkSession.sparkContext.broadcast(sorted(ranks, key=ranks.__getitem__))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        vocab = blob.value
        out = [None if x is None else b"".join(vocab[i] for i in x) for x in batch.column("ids").to_pylist()]
        return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "decoded": pa.array(out, pa.binary())})

    kind = df.schema[doc_id].dataType.simpleString()
    return map_batches(df.select(F.col(doc_id).alias("doc_id"), F.col(ids).alias("ids")), run, f"doc_id {kind}, decoded binary")
