import itertools
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lemmata.operators import scoring as S


def brute(pred, ref):
    if not ref:
        return (float(not pred),) * 4
    pred = pred + [("", [])] * (len(ref) - len(pred))
    best = [0.0] * 4
    for order in itertools.permutations(pred, len(ref)):
        total = [0.0] * 4
        for (a, c), (b, d) in zip(order, ref, strict=True):
            one = S.list_metrics([(a, c)], [(b, d)])
            total = [x + y for x, y in zip(total, one, strict=True)]
        best = [max(x, y / len(ref)) for x, y in zip(best, total, strict=True)]
    return tuple(x * math.exp(1 - len(pred) / len(ref)) for x in best)


answers = st.lists(st.tuples(st.sampled_from(["yes", "no", "the", "a cat", "cat dog", ""]), st.lists(st.sampled_from(["c", "d"]), max_size=2)), max_size=4)


@settings(max_examples=200, deadline=None)
@given(answers, answers)
def test_assignment_is_the_best_permutation(pred, ref):
    assert S.list_metrics(pred, ref) == pytest.approx(brute(pred, ref))


def test_list_metrics_examples():
    yes, no = ("yes", []), ("no", [])
    assert S.list_metrics([], []) == (1, 1, 1, 1)
    assert S.list_metrics([yes], []) == (0, 0, 0, 0)
    assert S.list_metrics([yes, no], [yes]) == pytest.approx((math.exp(-1),) * 4)
    assert S.list_metrics([yes], [yes, no]) == pytest.approx((0.5,) * 4)
    assert S.list_metrics([], [("the", [])])[0] == 1  # what is filled up matches a text that normalises to nothing


def test_native_metrics_agree_with_python(spark):
    rows = [(["the cat", "b b"], "cat b b", ["c"]), (["x"], "x", []), ([], "x", []), (["", "a"], "", [])]
    df = spark.createDataFrame(rows, "p array<string>, r string, c array<string>").withColumn("p", F.transform("p", lambda x: F.struct(x.alias("answer"), F.array(F.lit("c")).alias("conditions"))))
    df = df.withColumn("m", S.best_for_one_reference(F.col("p"), F.struct(F.col("r").alias("answer"), F.col("c").alias("conditions"))))
    for row, got in zip(rows, df.collect(), strict=True):
        assert tuple(got["m"]) == pytest.approx(S.list_metrics([(p, ["c"]) for p in row[0]], [(row[1], row[2])]))


def test_condition_f1(spark):
    df = spark.createDataFrame([([], []), (["c"], []), ([], ["c"]), (["c", "d"], ["c"])], "p array<string>, g array<string>")
    assert [r[0] for r in df.select(S.condition_f1(F.col("p"), F.col("g"))).collect()] == pytest.approx([1, 0, 0, 2 / 3])


def test_prediction(spark):
    df = spark.createDataFrame([(None, [], "yesno"), (True, [], "value"), (True, ["x"], "value"), (False, [], "yesno"), (False, [], "not_answerable")], "e boolean, v array<string>, k string")
    assert [r[0] for r in df.select(S.prediction(F.col("e"), F.col("v"), F.col("k"))).collect()] == [None, ["yes"], ["x"], ["no"], ["not answerable"]]


def test_buckets_without_rows(spark):
    x = spark.createDataFrame([("yesno", True, 1.0, 1.0, 0.5, 0.5)], "question_type string, conditional boolean, em double, em_cond double, f1 double, f1_cond double")
    got = {r["bucket"]: (r["n"], r["f1"]) for r in S.metric_buckets(x).collect()}
    assert got == {"total": (1, 0.5), "yesno": (1, 0.5), "conditional": (1, 0.5), "value": (0, 0.0), "not_answerable": (0, 0.0)}


def test_confusion_by_hand(spark):
    x = spark.createDataFrame([("yesno", True, True), ("yesno", True, False), ("value", None, True)], "question_type string, p boolean, c boolean")
    got = {r["bucket"]: (r["tp"], r["fp"], r["fn"], r["tn"]) for r in S.confusion(x, F.col("p"), F.col("c")).collect()}
    assert got == {"total": (1, 1, 1, 0), "yesno": (1, 1, 0, 0), "value": (0, 0, 1, 0)}
