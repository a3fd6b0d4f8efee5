"""Near copies whose similar texts are not the nearest: none may be left apart."""

import random

from stringloom.llm.near_copies import near_copies
from tests.llm.test_near_copies import brute


def test_families_at_the_threshold_equal_brute_force(spark):
    """Every text has two edits; most pairs of a family are a little too unlike, few are similar."""
    rng, texts = random.Random(41), []
    for _ in range(3):
        base = [f"w{rng.randrange(10**9)}" for _ in range(120)]
        for _ in range(40):
            w = list(base)
            for at in rng.sample(range(120), 2):
                w[at] = f"e{rng.randrange(10**9)}"
            texts.append(" ".join(w))
    rows = list(enumerate(texts))
    want = brute(rows)
    got = dict(map(tuple, near_copies(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()))
    assert 3 < len(set(want.values())) < 110 and [i for i in want if got[i] != want[i]] == []
