"""The pipeline stage by stage on a small table, each against a plain rule."""

import random

import corpus_pipeline
from lemmata.llm import mixing, packing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _docs(spark):
    rng = random.Random(2)
    words = {"en": "the and of to in with ing tion".split(), "fr": "le la des et une dans pour que".split()}
    rows = []
    for i in range(120):
        lang = "en" if i % 2 else "fr"
        rows.append((i, " ".join(rng.choice(words[lang]) + rng.choice("abcdefgh") for _ in range(40)), lang, f"s{i % 3}", 0))
    rows += [(200, rows[0][1], "fr", "s0", 0), (201, "1234 5678", "en", "s1", 0), (202, None, None, None, 0), (203, rows[5][1] + ' token = "abcdef0123456789abcdef0123456789"', "en", "s2", 0), (204, "my password: hunter2222 " + rows[7][1][::-1], "en", "s2", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_stages(spark):
    docs, seen = _docs(spark), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, "").cache()
        seen[name] = docs.collect()
        if name != "pack":
            assert docs.columns == COLUMNS
        if name == "mix":
            taken = {r["doc_id"]: r["taken"] for r in mixing.mix(before).collect()}
            assert {r["doc_id"] for r in seen[name]} == {k for k, v in taken.items() if v}
    ids = {k: {r["doc_id"] for r in v} for k, v in seen.items()}
    assert {201, 202}.isdisjoint(ids["language"]) and set(range(120)) <= ids["language"]
    assert 200 not in ids["near_duplicates"] and 0 in ids["near_duplicates"]
    texts = " ".join(r["text"] for r in seen["secrets"])
    assert "hunter2222" not in texts and "abcdef0123456789" not in texts and ids["secrets"] == ids["near_duplicates"]
    assert ids["pack"] == ids["mix"]


def test_stages_of_odd_rows(spark):
    """Nulls in every column, empty and very long texts, repeated rows and columns whose names the stages use themselves."""
    long = " ".join(f"the{i} and{i % 7}" for i in range(40_000))
    odd = [(None, None, None, None, None), (None, "the and of to in with", None, None, None), (903, "", "en", "s", 0), (903, "", "en", "s", 0), (905, long, "en", "s0", None), (905, long, "en", "s0", None), (906, " \n ", "fr", None, 3)]
    docs = _docs(spark).unionByName(spark.createDataFrame(odd, _docs(spark).schema)).repartition(3)
    from pyspark.sql import functions as F

    for name in ("class", "own", "k", "r", "label", "lang_pred", "score", "known", "size", "taken", "copy", "key", "row", "part", "length"):
        docs = docs.withColumn(name, F.lit(7))
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "").cache()
        kept[name] = [(r["doc_id"], r["length"]) for r in docs.collect()]
        if name != "pack":
            assert docs.columns == columns and {n for _, n in kept[name]} == {7}
    count = lambda name, i: sum(k == i for k, _ in kept[name])
    assert count("language", 905) == 2 and count("near_duplicates", 905) == 1 and count("language", 903) == count("language", 906) == 0
    assert count("near_duplicates", None) == count("secrets", None) == 1
    assert sum(n for i, n in kept["pack"] if i == 905) > 40_000


def test_stages_of_an_empty_table(spark):
    docs = _docs(spark).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0 and (name == "pack" or docs.columns == COLUMNS)


def test_stage_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "secrets", "mix", "pack"]
    assert packing.ROOM == 2048
