"""Dictionary, trainer, codec and blob: invariants, limits and exact layouts."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stringloom.operators.config import DynamicThreshold, FixedThreshold, TrainingConfig, is_valid_bits, max_dict_size, merge_count
from stringloom.operators.dictionary import Dictionary
from stringloom.operators.trainer import train
from stringloom.sources.blob import pack_bits, read_blob, unpack_bits, write_blob

BASE = [bytes([b]) for b in range(256)]


def corpus(n, longest, seed, low=32, high=126):
    rng = random.Random(seed)
    return [bytes(rng.randint(low, high) for _ in range(rng.randint(1, longest))) for _ in range(n)]


def users(n):
    return [f"user_{i:06d}".encode() for i in range(n)]


MIXED = users(60) + [b"", b"", b"x" * 16, b"x" * 40] + corpus(40, 30, 5, 0, 255)
D = train(MIXED * 3, TrainingConfig(bits=10, threshold=FixedThreshold(2)))


def with_base(*tokens):
    return Dictionary(sorted({*BASE, *tokens}))


@pytest.mark.parametrize("bits", range(9, 17))
@pytest.mark.parametrize("threshold", [FixedThreshold(2), DynamicThreshold(0.15), DynamicThreshold(1.0)])
def test_training_invariants(bits, threshold):
    d = train(MIXED * 3, TrainingConfig(bits=bits, threshold=threshold))
    assert len(d) <= max_dict_size(bits)
    assert set(BASE) <= set(d.tokens)
    assert list(d.tokens) == sorted(set(d.tokens))
    assert max(map(len, d.tokens)) <= 16
    assert all(d.matcher.ids[t] == i for i, t in enumerate(d.tokens))
    for row in MIXED:
        assert d.decode(d.tokenize(row)) == row and len(d.tokenize(row)) <= len(row)
    assert d == train(MIXED * 3, TrainingConfig(bits=bits, threshold=threshold))


def test_training_gate_and_empty_input():
    rows = [b"ab"] * 100
    assert b"ab" in train(rows, TrainingConfig(threshold=FixedThreshold(2))).tokens
    assert len(train(rows, TrainingConfig(threshold=FixedThreshold(101)))) == 256
    assert len(train([], TrainingConfig())) == len(train([b"", b""], TrainingConfig())) == 256
    assert len(train(users(50), TrainingConfig(threshold=DynamicThreshold(1e-9)))) == 256


def test_dictionary_fills_to_capacity():
    d = train(corpus(3000, 40, 1, 0, 255), TrainingConfig(bits=9, threshold=FixedThreshold(2)))
    assert len(d) == 512


@pytest.mark.parametrize("bad", [dict(bits=8), dict(bits=17), dict(sample_bytes=0)])
def test_bad_settings(bad):
    with pytest.raises(ValueError):
        TrainingConfig(**bad)


def test_bad_thresholds():
    for v in (0, 1, 256):
        with pytest.raises(ValueError):
            FixedThreshold(v)
    for v in (0, -1, 1.5):
        with pytest.raises(ValueError):
            DynamicThreshold(v)
    assert not is_valid_bits(8) and is_valid_bits(9) and is_valid_bits(16) and not is_valid_bits(17)


def test_merge_count_follows_the_sample():
    """It is the largest count that gives the merges asked for, grows with the text and falls with the room."""
    text = b"".join(corpus(400, 60, 3, 97, 103))
    pairs = {}
    for i in range(len(text) - 1):
        pairs[text[i : i + 2]] = pairs.get(text[i : i + 2], 0) + 1
    merges = lambda k: sum(c // k for c in pairs.values() if c > 1)
    for room in (5, 40, 300):
        k = merge_count(text, room)
        assert k >= 2 and (k == 2 or merges(k) >= 4 * room) and merges(k + 1) < 4 * room
    assert merge_count(text * 10, 40) > merge_count(text, 40) > merge_count(text, 300)
    assert merge_count(b"", 9) == merge_count(b"a", 9) == merge_count(b"abcdef", 9) == 2


def test_training_reads_no_more_than_its_share():
    head, tail = corpus(300, 60, 4, 97, 100), corpus(2000, 60, 5, 110, 120)
    share = sum(map(len, head)) / sum(map(len, head + tail))
    d = train(head + tail, TrainingConfig(bits=12, threshold=DynamicThreshold(share)))
    assert len(d) > 300 and not any(len(t) > 1 and t[0] >= 110 for t in d.tokens)


def test_greedy_longest_match():
    d = with_base(b"aa", b"aaa", b"abcdefghijklmnop")
    assert [d.tokens[t] for t in d.tokenize(b"aaaaab")] == [b"aaa", b"aa", b"b"]
    assert d.tokenize("abcdefghijklmnopq") == [d.tokens.index(b"abcdefghijklmnop"), ord("q") + sum(t < b"q" for t in (b"aa", b"aaa", b"abcdefghijklmnop"))]
    assert d.tokenize("") == []


def test_prefix_range():
    d = with_base(b"aa", b"aaa", b"\xff\xff")
    at = d.tokens.index
    span = lambda p: (lambda r: (r.begin, r.last))(d.prefix_range(p))
    assert span(b"a") == (at(b"a"), at(b"aaa")) and span(b"aa") == (at(b"aa"), at(b"aaa")) and span(b"aaa") == (at(b"aaa"),) * 2
    assert span(b"\xff") == (at(b"\xff"), at(b"\xff\xff")) and span(b"\xff\xff") == (at(b"\xff\xff"),) * 2
    assert span(b"") == (0, len(d) - 1)
    assert d.prefix_range(b"zz").empty and d.prefix_range(b"a" * 17).empty and len(d.prefix_range(b"zz")) == 0
    assert at(b"aa") in d.prefix_range(b"a")
    assert d.span(at(b"b")) == (int(d.offsets[at(b"b")]), int(d.offsets[at(b"b")]) + 1)
    assert d.bytes_used == sum(map(len, d.tokens)) + 4 * (len(d) + 1)


@given(st.binary(max_size=6))
@settings(deadline=None, max_examples=200)
def test_prefix_range_property(p):
    want = [i for i, t in enumerate(D.tokens) if t.startswith(p)]
    r = D.prefix_range(p)
    assert [*range(r.begin, r.last + 1)] == want


@pytest.mark.parametrize("tokens", [BASE[:-1], BASE + [b"\x00"], [*BASE, b"x" * 17], list(reversed(BASE))])
def test_bad_dictionaries(tokens):
    with pytest.raises(ValueError):
        Dictionary(tokens)


def test_bit_layout():
    words = pack_bits(np.array([0xABC, 0, 0, 0, 0, 0x123]), 12)
    assert [hex(w) for w in words.tolist()] == ["0x3000000000000abc", "0x12"]


@pytest.mark.parametrize("bits", range(9, 17))
def test_pack_round_trip_at_word_boundaries(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 2, 3, 4, 7, 8, 15, 16, 31, 32, 33, 63, 64, 65):
        t = rng.integers(0, 1 << bits, n)
        w = pack_bits(t, bits)
        assert len(w) == -(-n * bits // 64) and unpack_bits(w, bits, n).tolist() == t.tolist()


def test_blob_round_trip_is_stable():
    rows = [D.tokenize(x) for x in MIXED]
    blob = write_blob(rows, D, 10)
    again, d, bits = read_blob(blob)
    assert again == rows and d == D and bits == 10 and write_blob(again, d, bits) == blob
    empty = write_blob([], D, 10)
    assert read_blob(empty)[0] == [] and write_blob([], read_blob(empty)[1], 10) == empty


def test_bad_blobs():
    good = write_blob([D.tokenize(b"user_1")], D, 10)
    bounds = good[:-4] + (99).to_bytes(4, "little")
    for bad in (b"", b"nonsense" + good[8:], good[:8] + bytes([8]) + good[9:], good[:8] + bytes([17]) + good[9:], good[:20], good[:-1], bounds):
        with pytest.raises(ValueError):
            read_blob(bad)
    with pytest.raises(ValueError):
        write_blob([], Dictionary(sorted({*BASE, *(bytes([a, b]) for a in range(16) for b in range(256))})), 10)


def test_arrow_arrays():
    import pyarrow as pa

    from stringloom.operators.encode import decode_array, encode_array

    for values in (pa.array([b"user_1", None, b"", b"\xff\x00"], pa.binary()), pa.array(["é", "", None, "user_000001"]), pa.array([], pa.string())):
        for part in (values, values[1:]):  # slices have offsets of their own
            tokens = encode_array(part, D)
            assert decode_array(tokens, D).to_pylist() == part.cast(pa.binary()).to_pylist()
    tokens = encode_array(pa.array([b"user_1", None, b"", b"\xff\x00"]), D)
    assert decode_array(tokens[2:], D).to_pylist() == [b"", b"\xff\x00"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([0, 97, 98, 255]), min_size=2, max_size=16).map(bytes), max_size=25), st.lists(st.sampled_from([0, 97, 98, 99, 255]), max_size=120).map(bytes))
def test_bulk_parse_is_the_greedy_parse(tokens, data):
    d = with_base(*tokens)
    assert d.parse(data) == d.tokenize(data) and d.decode(d.parse(data)) == data


def test_bulk_parse_under_a_full_dictionary():
    rng = random.Random(8)
    more = {rng.randbytes(rng.randint(2, 16)) for _ in range(40_000)}
    more |= {bytes([a, b]) for a in range(256) for b in range(0, 256, 2)}
    d = with_base(*sorted(more)[: (1 << 16) - 256])
    for row in corpus(50, 400, 9, 0, 255) + [b"".join(rng.sample(d.tokens, 60)) for _ in range(20)]:
        assert d.parse(row) == d.tokenize(row)


def test_decoding_in_parts(monkeypatch):
    import pyarrow as pa

    from stringloom.operators import encode

    values = pa.array([b"", b"user_000001", None, b"", b"x" * 99, b"\xff\x00", *MIXED, b"", None], pa.binary())
    tokens = encode.encode_array(values, D)
    for part in (1, 2, 3, 7, 64):
        monkeypatch.setattr(encode, "PART", part)
        for start in range(len(values)):
            assert encode.decode_array(tokens[start:], D).to_pylist() == values[start:].to_pylist()


def test_a_batch_is_not_held_as_python_objects():
    import tracemalloc

    import pyarrow as pa

    from stringloom.operators.encode import decode_array, encode_array

    rng = random.Random(3)
    values = pa.array([b"".join(rng.choices(D.tokens, k=2000)) for _ in range(200)], pa.binary())
    small = encode_array(values[:1], D)  # the automaton and the arrays are made before
    assert decode_array(small, D)[0] == values[0]
    tracemalloc.start()
    try:
        tokens = encode_array(values, D)
        encoding = tracemalloc.get_traced_memory()[1]
        tracemalloc.reset_peak()
        assert decode_array(tokens, D).equals(values)
        decoding = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    n = len(tokens.values)
    assert n > 250_000
    assert encoding < 12 * n  # 4 bytes a token and room to grow
    assert decoding < 12 * n + (8 << 20)  # the tokens, the values, one part


def test_workers_are_given_small_batches(spark):
    import pyarrow as pa
    from pyspark.sql import functions as F

    from stringloom.operators.column import encode_column
    from stringloom.streaming.scan import encode_stream

    @F.arrow_udf("long")
    def size(batch: pa.Array) -> pa.Array:
        return pa.array([batch.nbytes] * len(batch), pa.int64())

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    found = spark.conf.get(name)
    df = spark.range(0, 400, 1, 1).select("id", F.repeat(F.lit("user_"), 20_000).alias("v"))
    makers = (lambda: encode_column(df, "id", "v", TrainingConfig(bits=10), D).df, lambda: encode_stream(df, "v", D))
    try:
        for make in makers:
            spark.conf.set(name, "67108864b")  # Spark's default
            make()
            assert df.select(size("v").alias("n")).agg(F.max("n")).first()[0] <= (4 << 20) + 200_000
            spark.conf.set(name, "1000000")  # the user's own
            make()
            assert spark.conf.get(name) == "1000000"
    finally:
        spark.conf.set(name, found)
