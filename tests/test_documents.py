import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lemmata import catalogue
from lemmata.operators import models
from lemmata.operators import outline as H
from lemmata.operators import prompting as P
from lemmata.plans import answering
from lemmata.sources import records

SWIM = [
    "<p>Opening hours are on the door.</p>", "<h2>Lanes</h2>", "<tr>Lane | Speed | Depth</tr>", "<tr>1 | slow</tr>", "<tr>2 | fast | 3 m</tr>",
    "<h3>Bookings</h3>", "<p>All of the following apply to bookings:</p>", "<li>one lane each</li>", "<li>no refunds except for illness</li>",
    "<h2>Lost things</h2>", "<p>You cannot collect things if one of the following is true:</p>", "<li>a month has passed</li>",
]


def test_semantic_tree(spark):
    df = spark.createDataFrame([(1, SWIM)], "doc long, contents array<string>")
    nodes = H.semantic_tree(df).orderBy("pos").collect()
    assert [(n["type"], n["depth"]) for n in nodes] == [("text", 0), ("section", 0), ("table", 1), ("section", 1), ("text", 2), ("list", 2), ("section", 0), ("rule", 1)]
    table, bookings, rule = nodes[2], nodes[5], nodes[7]
    assert table["columns"] == ["Lane", "Speed", "Depth"] and table["rows"] == [{"Lane": "1", "Speed": "slow", "Depth": ""}, {"Lane": "2", "Speed": "fast", "Depth": "3 m"}]
    assert (bookings["operator"], bookings["outcome"], bookings["items"], bookings["exceptions"]) == ("ALL", None, ["one lane each"], ["no refunds except for illness"])
    assert (rule["outcome"], rule["items"], rule["exceptions"]) == ("NOT_ELIGIBLE", ["a month has passed"], [])
    text = H.rendered(H.semantic_tree(df)).first()["text"].split("\n")
    assert text[:3] == ["Opening hours are on the door.", "# Lanes", "Lane | Speed | Depth"] and "2 | fast | 3 m" in text and any(x.strip() == "Exception: no refunds except for illness" for x in text)


def test_sections_follow_levels(spark):
    lines = ["<h2>a</h2>", "<h4>b</h4>", "<h3>c</h3>", "<p>x</p>", "<h1>d</h1>", "<p></p>", "<li>i</li>", "<p> </p>", "<li>j</li>"]
    nodes = H.semantic_tree(spark.createDataFrame([(1, lines)], "doc long, contents array<string>")).orderBy("pos").collect()
    by = {n["title"] or n["text"] or "|".join(n["items"]): n for n in nodes}
    assert by["b"]["parent"] == by["a"]["pos"] and by["c"]["parent"] == by["a"]["pos"] and by["x"]["parent"] == by["c"]["pos"]
    assert by["d"]["parent"] is None and by["i|j"]["parent"] == by["d"]["pos"]


def test_headerless_table(spark):
    cells = F.array(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("c")))
    r = spark.range(1).select(H.table_columns(F.lit(False), cells).alias("c"), H.table_rows(F.lit(False), cells).alias("r")).first()
    assert r["c"] == ["col_0", "col_1"] and r["r"] == [{"col_0": "a", "col_1": "b"}, {"col_0": "c", "col_1": ""}]


def test_record_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "é\n\n[x]"), (2, None)], "i long, s string")
    for n in (1, 2):
        p = f"file://{tmp_path}/pretty{n}"
        records.write(df.filter(F.col("i") <= n).coalesce(1), p)
        assert [tuple(r) for r in records.read(spark, p, "i long, s string").orderBy("i").collect()] == [(1, "é\n\n[x]"), (2, None)][:n]
    records.write(df.coalesce(1), f"file://{tmp_path}/lines", pretty=False)
    assert records.layout(spark, f"file://{tmp_path}/lines") == "lines"
    (tmp_path / "array.json").write_text('[{"i": 1}, {"i": 2}]')
    assert records.read(spark, f"file://{tmp_path}/array.json", "i long").count() == 2
    (tmp_path / "broken.json").write_text('{"i": 1}\n\n[2]\n\n{"i": 3}\n\n{"i": \n\n{"i": 5}\n\n')
    assert [r["i"] for r in records.read_valid(spark, f"file://{tmp_path}/broken.json", "i long").orderBy("ordinal").collect()] == [1, 3]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_of_three_layouts(spark, tmp_path, end):
    rows = [(i, f"é {i}\r\n\r\n" + "x" * (i % 7)) for i in range(60)]
    texts = {
        "array": json.dumps([{"i": i, "s": t} for i, t in rows], indent=1),
        "blocks": "".join(json.dumps({"i": i, "s": t}, indent=2, ensure_ascii=False) + "\n\n" for i, t in rows),
        "lines": "\n".join(json.dumps({"i": i, "s": t}) for i, t in rows) + "\n\n",
    }
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        for kind, text in texts.items():
            (tmp_path / kind).write_bytes(text.replace("\n", end).encode())
            path = f"file://{tmp_path}/{kind}"
            assert records.layout(spark, path) == kind
            assert sorted(map(tuple, records.read(spark, path, "i long, s string").collect())) == rows
            if kind != "array":
                got = records.read_valid(spark, path, "i long, s string")
                assert got.rdd.getNumPartitions() > 3  # one file, several tasks
                assert [tuple(r)[1:] for r in got.orderBy("ordinal").collect()] == rows
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_broken_records(spark, tmp_path):
    cases = [
        ('{"i": 1}\n\n\n{"i": 2}\n{"i": 3}\n', None, [1]),  # two records in one block
        ('{\n"i": 1\n}\n \n{\n"i": 3\n}\n', None, []),  # the line between is not empty
        ('{"i": 1}\r\n\r\n{"i": 2}\n\n{"i": 3}\r\n\n{"i": 4}\n\r\n{"i": 5}', [1, 2, 3, 4, 5], [1, 2, 3, 4, 5]),
        ('{"i": 1} x\n{"i": 2}\n', None, []),
        ('{"i": 1}} \n{"i": 2}\n', None, []),
        ('{"i": 1}\n{"i": 2}, "end": 0\n', None, [1]),
        ('{"i": 1}\n{"i": 2', None, [1]),
        ('{"i": 1}\n7\n{"i": 2}\n', None, [1, 2]),
        ('[{"i": 1}]\n', [1], []),
        ("[1", None, []),
        ("\n \n", [], []),
    ]
    for k, (text, want, valid) in enumerate(cases):
        (tmp_path / f"c{k}").write_bytes(text.encode())
        path = f"file://{tmp_path}/c{k}"
        assert [r["i"] for r in records.read_valid(spark, path, "i long").orderBy("ordinal").collect()] == valid, text
        if want is None:
            with pytest.raises(Exception, match="no record|MALFORMED|FAILFAST|parse"):
                records.read(spark, path, "i long").collect()
        else:
            assert sorted(r["i"] for r in records.read(spark, path, "i long").collect()) == want, text


def test_last_of_each_key(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", None, "z"), (None, 3, "n"), ("", 4, "e"), ("c", None, None), ("c", 0, "w")], "k string, _rn int, v string")
    assert sorted(map(tuple, records.last_of_each(df, "k", "_rn").collect())) == [("a", 2, "y"), ("b", None, "z"), ("c", 0, "w")]


def test_enriched_rows_that_repeat_a_document(spark):
    df = spark.createDataFrame([(1, ["<h1>A</h1>"], "x"), (1, ["<h2>B</h2>"], "y"), (2, [], "z"), (None, None, "n")], "doc long, contents array<string>, row string")
    got = H.enriched(df)
    assert got.columns == ["doc", "contents", "row", "semantic_tree"]
    found = {r["row"]: r["semantic_tree"] for r in got.collect()}
    assert [x["title"] for x in json.loads(found["x"])] == ["A"] and [x["title"] for x in json.loads(found["y"])] == ["B"]
    assert found["z"] is None and found["n"] is None


def test_pages_are_parsed_once(spark):
    df = spark.createDataFrame([(1, ["<h1>A</h1>"])], "doc long, contents array<string>")
    assert H.semantic_tree(df)._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_extraction_falls_back_to_single_items(spark):
    def call(items):
        if any(x["id"] == "bad" for x in items):
            raise RuntimeError("no")
        return [{"t": x["input_text"]} for x in items]

    jobs = spark.createDataFrame([(i, k, k) for i, k in enumerate(["a", "bad", "c"])], "index int, id string, input_text string").coalesce(1)
    got = {r["id"]: (r["logic_kb"], r["error"]) for r in models.extracted(jobs, call, batch=2).collect()}
    assert got == {"a": ('{"t": "a"}', None), "bad": (None, "RuntimeError: no"), "c": ('{"t": "c"}', None)}


def test_layout_reads_the_whole_file(spark, tmp_path):
    lines = [f'{{"i": {i}}}' for i in range(500)]
    (tmp_path / "far.json").write_text("\n".join(lines) + "\n\n" + "\n".join(lines))
    (tmp_path / "lines.json").write_text("\n\n" + "\n".join(lines))
    (tmp_path / "empty.json").write_text("\n")
    assert [records.layout(spark, f"file://{tmp_path}/{n}.json") for n in ("far", "lines", "empty")] == ["blocks", "lines", "blocks"]


def test_chunks_hold_every_row(spark):
    df = spark.range(20000).select("id", F.repeat(F.sha2(F.col("id").cast("string"), 256), 20).alias("wide")).repartition(7)
    got = records.chunked(df, 64, "id").select("chunk", F.size("rows").alias("n"), F.col("rows")[0]["id"].alias("first")).orderBy("chunk").collect()
    assert [(r["chunk"], r["n"], r["first"]) for r in got] == [(i, min(64, 20000 - 64 * i), 64 * i) for i in range(-(-20000 // 64))]
    ties = spark.createDataFrame([(None,)] * 5 + [(1,)] * 6 + [(2,)], "k int")
    assert sorted(r["index"] for r in records.numbered(ties, "k").collect()) == list(range(12))
    assert records.chunked(spark.range(0), 4, "id").count() == 0


def test_jobs_report_blank_samples(spark):
    s = spark.createDataFrame([(3, "c", "u", ["x"]), (1, "a", "u", [" "]), (2, "b", "v", ["y", "z"]), (9, "d", "u", ["w"])], "n int, id string, url string, contents array<string>")
    text = P.extractor("context", "contents")
    got = P.jobs(s, text, "n", spark.createDataFrame([("u", "k")], "url string, known string"), where=F.col("n") < 9).orderBy("index").collect()
    assert [(r["index"], r["id"], r["input_text"], r["known"]) for r in got] == [(0, "b", "y\nz", ""), (1, "c", "x", "k")]
    assert [r["id"] for r in P.blank_samples(s, text).collect()] == ["a"]
    try:
        P.extractor("context", "nothing")
    except ValueError as e:
        assert "context/contents" in str(e)
    else:
        raise AssertionError
    one = spark.range(1).select(P.batch_prompt(F.array(F.lit("A"), F.lit("B"))).alias("b"), P.user_prompt(F.lit("T"), F.lit("- p"), F.lit("")).alias("u")).first()
    assert one["b"].endswith("\n\nA\n\nB") and one["u"].endswith("Known predicates:\n- p\n\nText:\nT")


def test_chunks_and_remaining(spark):
    df = spark.range(10)
    got = {r["chunk"]: [x["id"] for x in r["rows"]] for r in records.chunked(df, 4, "id").collect()}
    assert got == {0: [0, 1, 2, 3], 1: [4, 5, 6, 7], 2: [8, 9]}
    assert records.remaining(df, spark.range(8), "id").count() == 2


def test_prompts_hold_whole_texts(spark, tmp_path):
    texts = [" ".join(f"w{i}" for i in range(n)) for n in (1, 100, 3000)]
    spark.createDataFrame([(i, "fr" if i else "en", f"<p>{t}</p>") for i, t in enumerate(texts)], "doc_id long, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["prompt"] for r in catalogue.queries()["prompt_blocks"](spark, str(tmp_path)).collect()}
    known = "Known predicates:\n- written_in/2 — fr\n\n"
    assert got == {i: f"### Item {i}\n\n{known if i else ''}Text:\n{t}" for i, t in enumerate(texts)}


def test_a_run_of_extraction_is_taken_up_again(spark, tmp_path):
    jobs = spark.createDataFrame([(i, f"d{i}", f"text {i}") for i in range(23)], "index int, id string, input_text string").repartition(3)
    path, broken = f"file://{tmp_path}/out", tmp_path / "broken"
    broken.write_text("x")

    def call(items, flag=str(broken)):
        import os

        if os.path.exists(flag) and any(x["index"] >= 12 for x in items):
            os._exit(1)  # the worker is lost in the middle of the run
        return [{"t": x["input_text"]} for x in items]

    try:
        answering.run_extraction(jobs, call, path, batch=3, flush=2)
    except Exception:
        pass
    first = {r["id"] for r in spark.read.json(path).collect()}
    assert first == {f"d{i}" for i in range(12)}
    broken.unlink()
    got = answering.run_extraction(jobs, call, path, batch=3, flush=2).collect()
    assert sorted(r["index"] for r in got) == list(range(23)) and not any(r["error"] for r in got)
    assert answering.run_extraction(jobs, call, path).count() == 23


def test_results_are_judged(spark):
    good = '{"predicates": [{"name": "pays", "arity": 2}], "fol": {"facts": []}, "prolog": {"facts": [], "rules": []}}'
    rows = [good, good.replace("2", "9"), good.replace("pays", "Pays"), "[]", "{", '{"fol": {"facts": []}}', None]
    got = [r[0] for r in spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, r string").orderBy("i").select(answering.valid_result(F.col("r"))).collect()]
    assert got == [None, "predicate pays/9", "predicate Pays/2", "no record", "no record", "no Prolog block", "no record"]


def test_events_of_a_batch_come_in_parts(monkeypatch):
    pages = ["<p>a</p>" * 40, None, "", "<table><tr><th>x</th></tr></table>"] * 30
    monkeypatch.setattr(H, "AT_ONCE", 1000)
    parts = list(H.read_batches(iter([pa.array(pages)])))
    assert len(parts) > 5 and max(len(x) for x in parts) <= 16
    assert [e for x in parts for e in x.to_pylist()] == [H.read_events(x) for x in pages]


def test_pages_of_one_file_are_parsed_by_many_tasks(spark):
    df = spark.range(0, 400, 1, 1).select(F.col("id").alias("doc"), F.format_string("<p>%d</p>", "id").alias("html"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few pages are one task again
    try:
        got = H.events(df, "html").select("doc", F.col("events")[0]["text"].alias("text"), F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r["doc"]: r["text"] for r in got} == {i: str(i) for i in range(400)}
    assert len({r["task"] for r in got}) == 4
    plan = H.semantic_tree(df.select("doc", F.array("html").alias("contents")))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.rindex("Exchange hashpartitioning(doc")  # the parser reads what is dealt out
