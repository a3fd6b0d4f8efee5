"""Weak parts longer than the scope."""

import hashlib
import random
import re

import pytest

from stringloom.llm import secret_scan
from tests.llm.test_simple_ops import base_spans


@pytest.mark.parametrize("far", [0, 150, 201])
def test_long_endpoint_before_and_after_its_complements(spark, far):
    url, pair = "https://h.example/" + "q" * 442, "login: alice password: short"
    rows = [(0, url + " " + pair), (1, pair + " " + url), (2, url + " " + "." * far + " " + pair)]
    got = {r.doc_id: r.spans for r in secret_scan.secret_scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert f"endpoint:0:{len(url)}" in got[0] and f"endpoint:{len(pair) + 1}:{len(pair) + 1 + len(url)}" in got[1]
    assert ("endpoint" in got[2]) == (far < 190)
    assert got[0].count("endpoint") == 1


def test_positions_in_texts_of_many_matches(spark):
    """More matches than a block, and the same text through other block sizes."""
    rng = random.Random(7)
    texts = [" ".join(rng.choice(["token=é" + "a" * 5, "secret: " + "b" * 14, "AKIA" + "C" * 16, "0123456789abcdef", "x" * rng.randint(1, 9)]) for _ in range(n)) for n in (1, 2, 511, 512, 513, 1025, 4000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in secret_scan.secret_scan(df).collect():
        digest = ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in base_spans(texts[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(digest.encode()).hexdigest()


def linked_brute(t, scope=200):
    """Weak parts with their complements in scope, from every pair of parts."""
    parts = []
    for kind in ("weak_id", "endpoint", "access", "hex"):
        parts += [(m.start(), m.end(), kind) for m in re.finditer(secret_scan.PATTERNS[kind].replace("(?:(?i)", "(?i:"), t)]
    for m in re.finditer(secret_scan.ASSIGN, t):
        parts.append((m.start(), m.end(), "assign" if len(m[2]) >= 12 else "weak_secret"))
    out = set()
    for s, e, kind in parts:
        near = {secret_scan.ROLE[k] for a, b, k in parts if e >= a - scope and s <= b + scope}
        if kind == "weak_id" and "secret" in near or kind == "weak_secret" and "id" in near or kind == "endpoint" and {"id", "secret"} <= near:
            out.add(f"{kind}:{s}:{e}")
    return out


def test_linked_spans_against_brute_force(spark):
    rng = random.Random(9)
    some = ["login = bob", "client_id: abcd", "password=short", "token = " + "k" * 15, "https://h.example/p", "10.0.0.1:80", "AKIA" + "Q" * 16, "deadbeefdeadbeef"]
    texts = [" ".join(rng.choice(some) if rng.random() < 0.1 else "é" * rng.randint(1, 30) for _ in range(60)) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in secret_scan.secret_scan(df).collect():
        assert {x for x in r.spans.split(",") if x.split(":")[0] in ("weak_id", "weak_secret", "endpoint")} == linked_brute(texts[r.doc_id])


def test_masks_keep_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "token=abcdefghijklmnop x AKIA" + "Z" * 20, "a", 2, "b"), (2, "plain", "c", 3, "d")], "doc_id bigint, text string, __id string, __sig int, __spans string")
    got = secret_scan.redact(df)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect())) == [(1, "[secret] x [secret]", "a", 2, "b"), (2, "plain", "c", 3, "d")]
