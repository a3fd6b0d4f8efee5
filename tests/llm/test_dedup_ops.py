"""Grouping operators against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from stringloom.llm import common, exact_dedup, graph, passages, simhash
from stringloom.llm.exact_dedup import compose, fingerprint
from tests.llm.test_simple_ops import AWKWARD


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, lang, s, len(t or ""), "k", -1, "f", 0) for i, t, lang, s in AWKWARD]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, fp int, node string, h0 int")


def dedup_brute(rows):
    """As the contract says: of each group of equal texts one row stays, the one with most code points, then the smallest id."""
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows]
    groups = {}
    for k, n in enumerate(norm):
        groups.setdefault(n, []).append(k)
    out = []
    for n, own in groups.items():
        own.sort(key=lambda k: (-len(rows[k][1] or ""), rows[k][0] is None, rows[k][0] or 0))
        out += [(rows[k][0], rows[own[0]][0], len(own), k == own[0], hashlib.sha256(n.encode()).hexdigest()) for k in own]
    return out


def test_fingerprints_compose():
    rng = random.Random(1)
    for n in (0, 1, 5, 65535, 65536, 65537, 200_000):
        data = rng.randbytes(n)
        for cut in (0, n // 3, n):
            assert compose(fingerprint(data[:cut]), fingerprint(data[cut:]), n - cut) == fingerprint(data)
    assert fingerprint(b"\0") != fingerprint(b"\0\0") and fingerprint(b"ab") != fingerprint(b"ba")


ROWS = [(i, t) for i, t, *_ in AWKWARD] + [(20, "wo rd"), (21, "w o\trd\x0b"), (22, " "), (23, "Word"), (24, "wo rd"), (25, "x" * 150_000 + " "), (26, "x" * 149_999 + "y")]


@pytest.mark.parametrize("huge", [exact_dedup.HUGE, 1000])
def test_exact_dedup(spark, huge):
    df = spark.createDataFrame([(i, t, 1, 2, "a") for i, t in ROWS], "doc_id bigint, text string, keep_id int, n int, part string")
    got = exact_dedup.exact_dedup(df, huge=huge)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, dedup_brute(ROWS)))
    assert exact_dedup.exact_dedup(df.filter("false"), huge=huge).count() == 0


def test_exact_dedup_keeps_one_row_of_a_repeated_id(spark):
    rows = [(1, "a b"), (1, "ab"), (2, "ab"), (3, "c"), (3, "c"), (None, "c"), (None, "d"), (None, "d ")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = list(map(tuple, exact_dedup.exact_dedup(df).collect()))
    assert sorted(map(repr, got)) == sorted(map(repr, dedup_brute(rows)))
    assert sum(r[3] for r in got) == 3


def test_exact_dedup_survives_collisions(spark):
    """Tiny moduli make different texts of one length collide; comparison tells them apart."""
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("ab") for _ in range(8))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = exact_dedup.exact_dedup(df, primes=(3, 5, 2))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, dedup_brute(rows)))


def simhash_brute(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(ids, linked):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if linked(i, j):
                parent[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[find(i)] = min(x, least.get(find(i), x))
    return [least.get(find(i)) for i in range(len(ids))]


def test_near_duplicates(spark, docs):
    rng = random.Random(6)
    base = [" ".join(rng.choice(["red", "blue", "green", "one", "two", "six", "Ten"]) + str(rng.randint(0, 99)) for _ in range(200)) for _ in range(12)]
    rows = [(i, t) for i, t, *_ in AWKWARD]
    for k, t in enumerate(base):
        for v in range(6):
            w = t.split()
            for _ in range(v):
                w[rng.randrange(200)] = f"edit{rng.randint(0, 9)}"
            rows.append((100 + 10 * k + v, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    fps = [simhash_brute(t) for _, t in rows]
    want = classes([i for i, _ in rows], lambda i, j: bin(fps[i] ^ fps[j]).count("1") <= 3)
    for limit in (simhash.LIMIT, 2):  # lists cut into slices give the same
        got = simhash.near_duplicates(df, limit=limit).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(repr((i, f"{f:016x}", c)) for (i, _), f, c in zip(rows, fps, want, strict=True))
    assert simhash.near_duplicates(df.filter("false")).count() == 0
    assert simhash.near_duplicates(docs).count() == len(AWKWARD)


@pytest.mark.parametrize("distinct", [1, 1 << 23, 1 << 29])
def test_links_are_complete_for_every_choice_of_blocks(spark, distinct):
    rng = np.random.default_rng(2)
    f = rng.integers(0, 2**64, 60, dtype=np.uint64)
    for bits in (1, 2, 3, 4):
        f = np.r_[f, f[:60] ^ sum(np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64) for _ in range(bits))]
    f = np.unique(np.r_[f, np.uint64(0), np.uint64(7)])
    df = spark.createDataFrame([(int(x),) for x in f.view(np.int64)], "fp bigint")
    want = classes([int(x) for x in f.view(np.int64)], lambda i, j: bin(int(f[i]) ^ int(f[j])).count("1") <= 3)
    edges = [(r.a, r.b) for r in simhash.links(df, distinct=distinct, limit=50).collect()]
    at = {int(x): i for i, x in enumerate(f.view(np.int64))}
    near = {frozenset((at[a], at[b])) for a, b in edges}
    assert classes([int(x) for x in f.view(np.int64)], lambda i, j: frozenset((i, j)) in near) == want


@pytest.mark.parametrize("radius", range(4))
def test_bit_sliced_comparison(radius):
    rng = np.random.default_rng(radius)
    f = rng.integers(0, 2**64, 200, dtype=np.uint64)
    f = np.unique(np.r_[f, f[:80] ^ np.uint64(1 << 40), f[:40] ^ np.uint64(0b101), f[40:80] ^ np.uint64(0x7000)])
    group = np.sort(rng.integers(0, 4, len(f)))
    i, j = simhash.forest(f, group, radius)
    label = np.arange(len(f))
    label[i] = j
    want = classes(list(range(len(f))), lambda a, b: group[a] == group[b] and bin(int(f[a]) ^ int(f[b])).count("1") <= radius)
    assert label.tolist() == want


def by_root(root):
    out = {}
    for n, r in root.items():
        out.setdefault(r, set()).add(n)
    return out


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + k) for k in range(1, 80)] + [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(60)] + [(7, 7), (5, None), (61, 60)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    real = [(a, b) for a, b in edges if b is not None and a != b]
    nodes = sorted({x for e in real for x in e})
    pairs = {frozenset(e) for e in real}
    want = classes(nodes, lambda i, j: frozenset((nodes[i], nodes[j])) in pairs)
    assert set(got) == set(nodes)
    by = {}
    for n, c in zip(nodes, want, strict=True):
        by.setdefault(c, set()).add(got[n])
    assert all(len(r) == 1 for r in by.values()) and len(set().union(*by.values())) == len(by)
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
    half = common.checkpoint(graph.components(spark.createDataFrame(edges[:90], "a bigint, b bigint")))
    grown = {r.node: r.root for r in graph.extended(half, spark.createDataFrame(edges[90:], "a bigint, b bigint").filter("b is not null")).collect()}
    assert {frozenset(n for n in grown if grown[n] == r) for r in set(grown.values())} - {frozenset([7])} == set(map(frozenset, by_root(got).values()))


@pytest.mark.parametrize("block", [16, 200, 1 << 20])
def test_components_in_blocks_of_any_size(spark, block):
    rng = random.Random(block)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + k) for k in range(1, 200)] + [(rng.randint(-700, -300), rng.randint(-700, -300)) for _ in range(170)]
    rng.shuffle(edges)
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            root[find(a)] = find(b)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint"), block=block).collect()}
    assert set(got) == set(root)
    pairs = {(find(x), got[x]) for x in got}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def windows_brute(h, t):
    out = set()

    def split(lo, hi):
        if hi - lo + 1 < t:
            return
        c = min(range(lo, hi + 1), key=lambda i: h[i])
        out.add((lo, c, hi))
        split(lo, c - 1)
        split(c + 1, hi)

    split(0, len(h) - 1)
    return out


def test_compact_windows():
    rng = np.random.default_rng(1)
    runs = [rng.permutation(5000)[:n].astype(np.uint64) for n in (46, 50, 300, 47, 1000)]
    bounds = np.r_[0, np.cumsum([len(r) for r in runs])]
    l, c, r = passages.compact_windows(np.concatenate(runs), bounds, 46)
    got = Counter((int(np.searchsorted(bounds, x, "right") - 1), int(a), int(x), int(b)) for a, x, b in zip(l, c, r, strict=True))
    want = Counter((k, a + bounds[k], x + bounds[k], b + bounds[k]) for k, h in enumerate(runs) for a, x, b in windows_brute(h.tolist(), 46))
    assert got == want
    same = np.full(500, 7, dtype=np.uint64)  # a place for each tie, but two rows for each key
    assert len(passages.compact_windows(same, np.array([0, 500]), 46)[0]) == 500
    key, _, c = passages.keyed_windows([same], t=46, hashes=1)
    assert len(set(key.tolist())) == 2 and sum(b.num_rows for b in passages._within(key, np.zeros(len(key), np.int64), c, True)) == 4


def test_passages(spark, docs):
    rng = random.Random(11)
    fresh = lambda n: [f"w{rng.randint(0, 10**9)}" for _ in range(n)]
    p, q, short, line = fresh(60), fresh(51), fresh(40), fresh(9)
    near = list(fresh(120))
    edited = list(near)
    edited[60] = "other"
    rows = {
        1: fresh(100) + p + fresh(30), 2: p + fresh(500), 3: fresh(20) + [w.upper() for w in p], 4: fresh(300) + q, 5: q + fresh(10), 6: short + fresh(100), 7: fresh(100) + short,
        8: fresh(80) + line + fresh(80), 9: fresh(80) + line + fresh(80), 10: near, 11: edited, 12: fresh(200), 13: ["spam"] * 900, 14: ["spam"] * 700, 15: fresh(70), 17: fresh(49), 18: q[:49],
    }
    rows[16] = rows[15]
    rows[19] = rows[17]
    df = spark.createDataFrame([(i, " ".join(w), i) for i, w in rows.items()], "doc_id bigint, text string, node int")
    every = {r.doc_id: r for r in passages.near_passages(df).collect()}
    assert set(every) == set(rows) and all(r.class_id == i and not r.n_links and r.spans == [] for i, r in every.items() if i in (6, 7, 8, 9, 12, 17, 18, 19))
    got = {i: r for i, r in every.items() if r.n_links}
    assert {i: r.class_id for i, r in got.items()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 10: 10, 11: 10, 13: 13, 14: 13, 15: 15, 16: 15}
    span = lambda i: [(s.s, s.e) for s in got[i].spans]
    assert span(1) == [(100, 160)] and span(2) == [(0, 60)] and span(3) == [(20, 80)] and span(4) == [(300, 351)] and span(5) == [(0, 51)]
    assert span(10) == span(11) == [(0, 120)] and span(15) == [(0, 70)]
    assert all(r.n_links >= 1 for r in got.values())
    assert passages.near_passages(df.filter("false")).count() == 0
    quiet = [tuple(r) for r in passages.near_passages(docs).collect()]
    assert sorted(map(repr, quiet)) == sorted(repr((i, i, 0, [])) for i, *_ in AWKWARD)


def test_verbatim_passages_are_never_missed(spark):
    rng = random.Random(12)
    vocab = [f"v{i}" for i in range(60)]
    made = lambda n: [rng.choice(vocab) for _ in range(n)]
    shared = [made(rng.randint(50, 120)) for _ in range(12)]
    rows = []
    for i in range(120):
        w = made(rng.randint(0, 150))
        if i % 2:
            w = w + shared[i % 12] + made(rng.randint(0, 150))
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r.class_id for r in passages.near_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for k in range(1, 12, 2):
        assert len({got[i] for i in range(120) if i % 12 == k}) == 1


def test_variants_of_one_text_are_linked_through_any_of_them(spark):
    """Variants that share 50 words with some of their family only nearly all end in one class with these."""
    rng = random.Random(13)
    rows = []
    for family in range(12):
        base = [f"f{family}w{rng.randint(0, 10**6)}" for _ in range(160)]
        for _ in range(14):
            own, at = list(base), rng.randint(0, 20)
            while at < len(own):
                own[at] = f"e{rng.randint(0, 10**9)}"
                at += rng.randint(10, 70)
            rows.append(own)
    holders, root = {}, list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, w in enumerate(rows):
        for k in range(len(w) - 49):
            a, b = sorted((find(i), find(holders.setdefault(tuple(w[k : k + 50]), i))))
            root[b] = a
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id bigint, text string")
    got = {r.doc_id: r.class_id for r in passages.near_passages(df).collect()}
    assert len({find(i) for i in range(len(rows))}) < len(rows) / 2
    assert sum(got[i] == got[find(i)] for i in range(len(rows))) >= 0.98 * len(rows)
    assert all(got[i] // 14 == i // 14 for i in got)


def text_frame(spark, rows):
    return spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id bigint, text string")


@pytest.mark.parametrize(("passage", "notice"), [(55, 45), (60, 30)])
def test_passages_around_a_common_notice(spark, passage, notice):
    """Every text has the notice, which is no passage by itself; pairs share the words around it."""
    rng = random.Random(passage)
    fresh = lambda n: [f"w{rng.randint(0, 10**9)}" for _ in range(n)]
    common, rows = fresh(notice), []
    for k in range(150):
        left = rng.randint(0, passage - notice)
        shared = [*fresh(left), *common, *fresh(passage - notice - left)]
        rows += [(2 * k + v, fresh(rng.randint(20, 60)) + shared + fresh(rng.randint(20, 60))) for v in (0, 1)]
    rows += [(1000 + k, fresh(60) + common + fresh(60)) for k in range(100)]
    got = {r.doc_id: r for r in passages.near_passages(text_frame(spark, rows)).collect()}
    assert all(got[2 * k].class_id == got[2 * k + 1].class_id and got[2 * k].n_links for k in range(150))


def test_edited_passages_against_brute_force(spark):
    """Isolated pairs of passages with edits; at least nine in ten of those with Jaccard 0.8 are found, for each number of edits."""
    rng = random.Random(21)
    fresh = lambda n: [f"w{rng.randint(0, 10**9)}" for _ in range(n)]
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    rows, wanted, n = [], {}, 0
    for size, edits in ((52, 1), (80, 1), (80, 2), (120, 3), (200, 4), (200, 5)):
        for _ in range(150):
            a = fresh(size)
            b = list(a)
            for at in rng.sample(range(size), edits):
                b[at] = f"e{rng.randint(0, 10**9)}"
            x, y = grams(a), grams(b)
            rows += [(2 * n, fresh(30) + a + fresh(30)), (2 * n + 1, fresh(30) + b + fresh(30))]
            wanted.setdefault((size, edits), []).append((n, len(x & y) / len(x | y) >= 0.8))
            n += 1
    got = {r.doc_id: r.class_id for r in passages.near_passages(text_frame(spark, rows)).collect()}
    assert all(got[i] // 2 == i // 2 for i in got)
    for own in wanted.values():
        real = [k for k, near in own if near]
        found = sum(got[2 * k] == got[2 * k + 1] for k in real)
        assert real and found >= 0.95 * len(real)


def test_repeated_rows_cost_no_more_than_others(spark):
    rng = random.Random(22)
    a = [f"w{rng.randint(0, 10**9)}" for _ in range(300)]
    b = a[:200] + ["other"] + a[200:]
    df = text_frame(spark, [(1, a)] * 2000 + [(2, b)] * 2000)
    got = passages.near_passages(df).groupBy("doc_id", "class_id", "n_links", "spans").count().collect()
    assert sorted((r.doc_id, r.class_id, r.n_links, r["count"]) for r in got) == [(1, 1, 2000, 2000), (2, 1, 2000, 2000)]


def test_all_places_of_a_passage_are_reported(spark):
    rng = random.Random(23)
    fresh = lambda n: [f"w{rng.randint(0, 10**9)}" for _ in range(n)]
    p = fresh(60)
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in passages.near_passages(text_frame(spark, [(1, fresh(40) + p), (2, p + fresh(100) + p + fresh(9))])).collect()}
    assert got == {1: [(40, 100)], 2: [(0, 60), (160, 220)]}


def test_long_texts_are_read_in_stretches(spark, monkeypatch):
    rng = random.Random(24)
    fresh = lambda n: [f"w{rng.randint(0, 10**9)}" for _ in range(n)]
    w = fresh(4000)
    full = passages.word_hashes(" ".join(w).encode())
    for start, own in passages.stretches(" ".join(w).encode(), 50, 700):
        assert (full[start : start + len(own)] == own).all()
    parts = [(s, x) for s, x in passages.stretches(" ".join(w).encode(), 50, 700)]
    for i in range(len(w) - 49):  # every passage lies whole in a stretch
        assert any(s <= i and i + 50 <= s + len(x) for s, x in parts)


def test_window_hashes():
    rng = np.random.default_rng(4)
    for t in (1, 2, 3, 45, 46, 64):
        s = rng.integers(0, 4, 300, dtype=np.uint32)
        w = passages.window_hashes(s, t)
        key = [s[i : i + t].tobytes() for i in range(len(s) - t + 1)]
        assert len(w) == len(key) and len(set(zip(w.tolist(), key, strict=True))) == len(set(key)) == len(set(w.tolist()))
        assert len(passages.window_hashes(s[: t - 1], t)) == 0


def test_texts_that_share_a_name_get_others(spark):
    df = spark.createDataFrame([(i, f"text {i // 2}") for i in range(40)] + [(None, "text 1"), (3, "text 1")], "doc_id bigint, text string")
    for mask in (-1, 3):
        docs, member, nodes = common.named_texts(df, mask=mask)
        by = {}
        for r in docs.collect():
            by.setdefault(r.node, set()).add(bytes(r["__text"]))
        assert len(by) == 20 and all(len(x) == 1 for x in by.values())
        assert {r.node for r in member.collect()} == set(by) and nodes.count() == 20
        assert {(r.first, r.repeats, r.copies) for r in nodes.collect()} == {(2 * k, False, 2) for k in range(20) if k != 1} | {(2, False, 4)}
