"""The pipeline's stages on awkward tables, and the whole against a plain version of what it promises."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stringloom.llm import common
from tests.llm.test_near_copies import brute

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, sig int, kept string, component_id int, __spans string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", None, None if t is None else len(t), "k", 1, "x", 2, "y") for i, t in rows], COLUMNS)


def words(rng, n):
    return " ".join(f"w{rng.randrange(9**6)}" for _ in range(n))


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(1, 1, 0), (1, 1, 0), (None, 1, 0), (2, None, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def awkward():
    rng = random.Random(1)
    a, b, long = words(rng, 80), words(rng, 90), words(rng, 30_000)
    near = a.replace(a.split()[40], "other")
    return [
        (1, None), (2, ""), (3, " \n"), (4, "few words"), (5, a), (5, a), (6, a + "  "), (7, a.replace(" ", "\n")), (None, b), (None, b), (8, b), (9, near), (9, words(rng, 70)), (10, long), (11, long + " end"),
        (12, words(rng, 60) + " password = abcdefghijkl0"), (13, words(rng, 60)),
    ]


def test_every_stage_on_awkward_rows_and_empty_tables(spark, sf_dir):
    docs = frame(spark, awkward())
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert stage(spark, docs.filter("false"), sf_dir).count() == 0, name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns and out.count() <= docs.count(), name
    rules, exact, near, masks, packed = (f for _, f in corpus_pipeline.STAGES)
    ids = lambda df: sorted((r.doc_id is None, r.doc_id or 0) for r in df.select("doc_id").collect())
    assert ids(rules(spark, docs, sf_dir)) == sorted((i is None, i or 0) for i, t in awkward() if len((t or "").split()) >= 50)
    kept = exact(spark, docs, sf_dir)
    assert ids(kept) == [(False, i) for i in (3, 4, 6, 8, 9, 9, 10, 11, 12, 13)]
    left = near(spark, kept, sf_dir)
    assert ids(left) == [(False, i) for i in (3, 4, 6, 8, 9, 10, 12, 13)]
    masked = {r.doc_id: r for r in masks(spark, left, sf_dir).collect()}
    assert masked[12].text.endswith(" [secret]") and masked[12].n_chars == len(masked[12].text) and masked[13].text == dict(awkward())[13]
    one = {r.doc_id for r in packed(spark, left, sf_dir).collect()}
    assert one == {i for _, i in ids(left)}


def test_whole_pipeline_keeps_what_it_promises(spark, sf_dir, tmp_path):
    rng = random.Random(2)
    rows = []
    for k in range(30):
        base = words(rng, rng.randint(60, 200)).split()
        for v in range(rng.randint(1, 4)):
            own = list(base)
            for at in rng.sample(range(len(own)), v):
                own[at] = f"e{rng.randrange(9**6)}"
            rows += [(len(rows), " ".join(own))] * rng.randint(1, 2)
            rows.append((len(rows) + 500, "\n".join(own)))
    rows += [(9000 + k, words(rng, rng.randint(0, 49))) for k in range(10)]
    docs = frame(spark, rows).drop("key", "sig", "kept", "component_id", "__spans")
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(f"{tmp_path}/t/labels.parquet")
    docs.write.parquet(f"{tmp_path}/t/documents.parquet")
    good = [(i, t) for i, t in rows if len(t.split()) >= 50]
    by = {}
    for i, t in good:
        by.setdefault("".join(t.split()), []).append((-len(t), i, t))
    single = [(i, t) for _, i, t in map(min, by.values())]
    root = brute(single)
    want = sorted({root[i] for i, _ in single})
    out = corpus_pipeline.run(spark, f"{tmp_path}/t")
    assert sorted(r.doc_id for r in out.select("doc_id").distinct().collect()) == want
    assert out.filter(F.col("n_tokens") == 0).count() == 0


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Unset:
        def __getattr__(self, name):
            return self

        def __call__(self, *args):
            return self

        def isDefined(self):
            return False

    class Context(Unset):
        master, _jsc = "spark://host:7077", Unset()

    class Session:
        sparkContext, conf = Context(), type("C", (), {"get": staticmethod(lambda *a: None)})

    with pytest.raises(RuntimeError):
        common.shared_dir(Session())
