"""The pipeline's near copies against brute force."""

import random

import numpy as np
import pytest

import corpus_pipeline
from stringloom.llm import simhash
from stringloom.llm.near_copies import apart, near_copies


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """Smallest id of each component of Jaccard 0.8 or more."""
    sets, root = [shingles(t or "") for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if (rows[i][1] or "") == (rows[j][1] or "") or (both and 5 * both >= 4 * len(a | sets[j])):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {rows[i][0]: rows[find(i)][0] for i in range(len(rows))}


def edited(rng, words, n):
    """Copies of a text with ever more words replaced."""
    for k in range(n):
        w = list(words)
        for _ in range(k % 12):
            w[rng.randrange(len(w))] = f"new{rng.random()}"
        yield " ".join(w)


@pytest.mark.parametrize("limit", [8, 2048])
def test_near_copies_equal_brute_force(spark, limit):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(3000)}"
    line = " ".join(word() for _ in range(30))
    texts = [None, "", " \t", "one", "One", "one two three", "a b c d e"]
    for n in (20, 60, 150, 400):
        for _ in range(6):
            texts += edited(rng, [word() for _ in range(n)], 14)
    texts += [line + " " + " ".join(word() for _ in range(20)) for _ in range(60)]
    texts += [" ".join(x) for x in (["same"] * 40, ["same"] * 90)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = near_copies(spark.createDataFrame(rows, "doc_id bigint, text string"), limit=limit)
    got, want = dict(map(tuple, got.collect())), brute(rows)
    # Links that are neither a first, a predecessor nor a nearest may be missed; none is made up.
    assert sum(got[i] == want[i] for i in want) >= 0.98 * len(want) and all(want[got[i]] == want[i] for i in want)


@pytest.mark.parametrize("radius", [4, 13, 22, 31])
def test_bit_sliced_comparison_of_any_radius(radius):
    rng = np.random.default_rng(radius)
    f = rng.integers(0, 2**64, 150, dtype=np.uint64)
    flips = np.packbits(rng.random((150, 64)) < rng.random((150, 1)) * 0.5, axis=1).view(np.uint64).ravel()
    f = np.r_[f, f ^ flips]
    end = np.where(np.arange(300) < 220, 220, 300)
    every = rng.random(300) < 0.02
    want = {(i, j) for i in range(300) for j in range(i + 1, end[i]) if every[i] or every[j] or bin(int(f[i]) ^ int(f[j])).count("1") <= radius}
    got = list(zip(*(x.tolist() for x in simhash.near_lanes(f, end, radius, every)), strict=True))
    assert set(got) == want and len(got) == len(want)


def test_lists_are_compared_across_classes_and_slices(spark):
    rng = np.random.default_rng(1)
    fp = rng.integers(0, 2**64, 1, dtype=np.uint64).view(np.int64)[0]
    rows = [(k % 2, node, 100, int(fp) ^ (1 << node % 60) - 1, node % 3) for k, node in enumerate(range(60))]
    lists = spark.createDataFrame(rows, "key bigint, node bigint, n int, fp bigint, root bigint")
    want = set()
    for ka, a, _, fa, ra in rows:
        near = [(bin((fa ^ fb) & 2**64 - 1).count("1"), b) for kb, b, _, fb, rb in rows if ka == kb and ra != rb]
        far, b = min(near)
        want |= {(max(a, b), min(a, b))} if far <= 22 else set()
    for limit in (4, 100):
        assert {tuple(r) for r in apart(lists, 0.8, limit).collect()} == want


def test_pipeline_drops_copies_beyond_three_bits(spark):
    rng = random.Random(5)
    texts = [t for _ in range(20) for t in edited(rng, [f"w{rng.randrange(9**6)}" for _ in range(120)], 5)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    want = brute([r[:2] for r in rows])
    kept = corpus_pipeline.near_duplicate_groups(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, c in want.items() if i == c)
