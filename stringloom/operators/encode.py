"""Encoding and decoding of columns as DataFrame expressions over Arrow batches.

A batch's tokens are held as 32-bit numbers; as Python objects, ten times as large,
there is one at a time in encoding and ``PART`` in decoding.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType

from stringloom.operators.dictionary import Dictionary

#: Dictionaries up to this size decode by array functions inside the JVM.
SMALL = 1024
#: Distinct values of a batch whose tokens are remembered.
MEMO = 1 << 16
#: Tokens that are decoded at a time.
PART = 1 << 16


def encode_array(values: pa.Array, dictionary: Dictionary) -> pa.ListArray:
    """Greedy parses of an Arrow array of binary or string values; null for null."""
    parsed, memo, flat, ends = dictionary.parsed, {}, array("i"), array("i", [0])
    for x in values.cast(pa.binary()):
        raw = x.as_py()
        if raw is not None and (own := memo.get(raw)) is not None:
            flat.extend(own)
        elif raw is not None:
            flat.extend(parsed(raw))
            if len(raw) <= 256 and len(memo) < MEMO:
                memo[raw] = flat[ends[-1] :]
        ends.append(len(flat))
    return pa.ListArray.from_arrays(pa.array(np.asarray(ends)), pa.array(np.asarray(flat)), mask=values.is_null() if values.null_count else None)


def decode_array(tokens: pa.ListArray, dictionary: Dictionary) -> pa.BinaryArray:
    """The values of token lists: one concatenation, made in parts, and its offsets; null for null."""
    offsets = tokens.offsets.to_numpy()
    flat, bounds = tokens.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0]
    data, ends = bytearray(), np.zeros(len(bounds), dtype=np.int64)
    for at in range(0, len(flat), PART):
        own = flat[at : at + PART]
        low, high = np.searchsorted(bounds, (at, at + len(own)), "right")  # the rows that end in this part
        ends[low:high] = len(data) + np.cumsum(dictionary.lengths[own])[bounds[low:high] - at - 1]
        data += b"".join(map(dictionary.tokens.__getitem__, own.tolist()))
    out = pa.Array.from_buffers(pa.large_binary(), len(tokens), [None, pa.py_buffer(ends), pa.py_buffer(data)]).cast(pa.binary())
    return pc.if_else(tokens.is_null(), pa.scalar(None, pa.binary()), out) if tokens.null_count else out


def tokens_of(values: Column, dictionary: Dictionary) -> Column:
    """BINARY -> ARRAY<INT>, the greedy parse of each value; null for null."""

    @F.arrow_udf(ArrayType(IntegerType()))
    def encode(batch: pa.Array) -> pa.Array:
        return encode_array(batch, dictionary)

    return encode(values)


def bytes_of(tokens: Column, dictionary: Dictionary, *, native: bool | None = None) -> Column:
    """ARRAY<INT> -> BINARY; null for null."""
    if native if native is not None else len(dictionary) <= SMALL:
        table = F.array(*(F.lit(bytearray(t)) for t in dictionary.tokens))
        return F.aggregate(F.transform(tokens, lambda t: F.element_at(table, t + 1)), F.lit(bytearray()), lambda a, b: F.concat(a, b))

    @F.arrow_udf(BinaryType())
    def decode(batch: pa.Array) -> pa.Array:
        return decode_array(batch, dictionary)

    return decode(tokens)
