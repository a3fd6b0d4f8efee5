"""Languages whose labelled texts all lie outside the preferred lengths."""

from stringloom.llm import language_id


def test_languages_of_short_or_long_texts_alone_are_learned(spark):
    rows = [(i, f"the house and the garden number {i} are open today", "en") for i in range(40)]
    rows += [(100 + i, "кот дом", "ru") for i in range(40)] + [(200 + i, "το σπίτι και ο κήπος " * 1000, "el") for i in range(8)]
    got = language_id.identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()
    want = {i: x for i, _, x in rows}
    assert all(r.lang_pred == want[r.doc_id] for r in got)
