"""Scores of predicted answers, question types, verdicts and their summaries.

An answer list is an array of (answer, conditions). Pairs are scored with built-in expressions. Where there are several
references, the best assignment of predictions to them is found per row by a polynomial algorithm in an Arrow function.
"""

from __future__ import annotations

import math
import re
import string
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType

from lemmata.functions.text import answer_tokens, normalized_answer, percent
from lemmata.shipping import ship

ANSWERS = "array<struct<answer:string,conditions:array<string>>>"
METRICS = ("em", "em_cond", "f1", "f1_cond")


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often it is used."""
    return F.transform(F.array(value), use)[0]


# pairs


def multiset_f1(gold: Column, pred: Column) -> Column:
    """F1 of two token arrays as multisets; if either is empty, 1 where both are."""
    times = lambda a, t: F.size(F.filter(a, lambda x: x == t))
    near = F.filter(pred, lambda x: F.array_contains(gold, x))  # few, however long the prediction
    common = let(near, lambda p: F.aggregate(F.transform(F.array_distinct(p), lambda t: F.least(times(gold, t), times(p, t))), F.lit(0), lambda a, x: a + x))
    empty = (F.size(gold) == 0) | (F.size(pred) == 0)
    both = ((F.size(gold) == 0) & (F.size(pred) == 0)).cast("double")
    return F.when(empty, both).otherwise(2.0 * common / (F.size(gold) + F.size(pred)))


def answer_f1(gold: Column, pred: Column) -> Column:
    return let(F.struct(answer_tokens(gold).alias("g"), answer_tokens(pred).alias("p")), lambda t: multiset_f1(t["g"], t["p"]))


def condition_f1(pred: Column, gold: Column) -> Column:
    """F1 of two sets of conditions, compared as they are written."""
    p, g = F.array_distinct(pred), F.array_distinct(gold)
    common = F.size(F.array_intersect(p, g))
    empty = (F.size(p) == 0) | (F.size(g) == 0)
    return F.when(empty, ((F.size(p) == 0) & (F.size(g) == 0)).cast("double")).when(common == 0, F.lit(0.0)).otherwise(2.0 * common / (F.size(p) + F.size(g)))


def pair_metrics(pred: Column, ref: Column) -> Column:
    """em, em_cond, f1, f1_cond of one prediction and one reference, both (answer, conditions)."""
    words = lambda x: F.filter(F.split(F.coalesce(x, F.lit("")), " "), lambda t: t != "")
    plain = F.struct(normalized_answer(pred["answer"]).alias("p"), normalized_answer(ref["answer"]).alias("g"))
    both = let(plain, lambda t: F.struct((t["p"] == t["g"]).cast("double").alias("em"), words(t["g"]).alias("g"), words(t["p"]).alias("p")))
    same = let(both, lambda t: F.struct(t["em"].alias("em"), multiset_f1(t["g"], t["p"]).alias("f1")))
    parts = F.struct(same.alias("m"), condition_f1(pred["conditions"], ref["conditions"]).alias("c"))
    return let(parts, lambda x: F.struct(x["m"]["em"].alias("em"), (x["m"]["em"] * x["c"]).alias("em_cond"), x["m"]["f1"].alias("f1"), (x["m"]["f1"] * x["c"]).alias("f1_cond")))


# lists


def best_for_one_reference(pred: Column, ref: Column) -> Column:
    """The metrics of a prediction list against a single reference; each is the best of any prediction, times the penalty."""
    penalty = F.exp(1.0 - F.greatest(F.size(pred), F.lit(1)))
    best = lambda pairs, m: F.coalesce(F.array_max(F.transform(pairs, lambda x: x[m])), F.lit(0.0)) * penalty
    return let(F.transform(pred, lambda p: pair_metrics(p, ref)), lambda pairs: F.struct(*[best(pairs, m).alias(m) for m in METRICS]))


_PUNCTUATION = str.maketrans("", "", string.punctuation)
_ARTICLES = re.compile(r"\b(a|an|the)\b")


def _normal(s: str | None) -> str:
    return " ".join(_ARTICLES.sub(" ", (s or "").lower().translate(_PUNCTUATION)).split())


def _f1(a: Counter, b: Counter) -> float:
    if not a or not b:
        return float(not a and not b)
    common = sum((a & b).values())
    return 2.0 * common / (sum(a.values()) + sum(b.values())) if common else 0.0


def best_assignment(gain: list[list[float]]) -> float:
    """The largest total gain of giving each row a column of its own; shortest augmenting paths, cubic time."""
    n = len(gain)
    m = len(gain[0]) if n else 0
    if n > m:
        return best_assignment([list(c) for c in zip(*gain, strict=True)]) if m else 0.0
    inf = math.inf
    u, v, owner = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        owner[0], j, least, way, used = i, 0, [inf] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while owner[j]:
            used[j], row, delta, to = True, owner[j], inf, 0
            for k in range(1, m + 1):
                if not used[k]:
                    cost = -gain[row - 1][k - 1] - u[row] - v[k]
                    if cost < least[k]:
                        least[k], way[k] = cost, j
                    if least[k] < delta:
                        delta, to = least[k], k
            for k in range(m + 1):
                if used[k]:
                    u[owner[k]] += delta
                    v[k] -= delta
                else:
                    least[k] -= delta
            j = to
        while j:
            owner[j], j = owner[way[j]], way[j]
    return math.fsum(gain[owner[j] - 1][j - 1] for j in range(1, m + 1) if owner[j])


def list_metrics(pred: list[tuple], ref: list[tuple]) -> tuple[float, float, float, float]:
    """The four metrics of a prediction list; each is maximised by itself over assignments to the references.

    With no reference all are 1 where there is no prediction either, else 0. Fewer predictions than references count as
    filled up with empty ones; more are penalised by exp(1 - predictions / references).
    """
    if not ref:
        return (float(not pred),) * 4
    pred = list(pred) + [("", [])] * (len(ref) - len(pred))
    p = [(_normal(a), Counter(_normal(a).split()), Counter(set(c or ()))) for a, c in pred]
    r = [(_normal(a), Counter(_normal(a).split()), Counter(set(c or ()))) for a, c in ref]
    em = [[float(x[0] == y[0]) for y in r] for x in p]
    f1 = [[_f1(y[1], x[1]) for y in r] for x in p]
    cond = [[_f1(x[2], y[2]) for y in r] for x in p]
    times = lambda a, b: [[x * y for x, y in zip(i, j, strict=True)] for i, j in zip(a, b, strict=True)]
    penalty = math.exp(1.0 - len(pred) / len(r)) / len(r)
    return tuple(best_assignment(g) * penalty for g in (em, times(em, cond), f1, times(f1, cond)))


def answers_metrics(df: DataFrame, pred: str, ref: str) -> DataFrame:
    """``df`` with em, em_cond, f1, f1_cond of its answer lists ``pred`` and ``ref``; null lists count as empty."""
    ship(df.sparkSession)

    @pandas_udf("em double, em_cond double, f1 double, f1_cond double")
    def score(p: pd.Series, r: pd.Series) -> pd.DataFrame:
        pairs = lambda x: [] if x is None else [(a["answer"], [] if a["conditions"] is None else list(a["conditions"])) for a in x]
        return pd.DataFrame([list_metrics(pairs(a), pairs(b)) for a, b in zip(p, r, strict=True)], columns=list(METRICS))

    return df.withColumn("_m", score(pred, ref)).select(*df.columns, "_m.*")


# classifiers

_is_yes_no = lambda x: F.lower(F.trim(x)).isin("yes", "no")


def first_is_yes_no(answers: Column) -> Column:
    """Whether the first answer is yes or no in any case."""
    return F.coalesce(F.lower(F.get(answers, F.lit(0))["answer"]).isin("yes", "no"), F.lit(False))


def question_type(answers: Column, not_answerable: Column) -> Column:
    every = (F.size(answers) > 0) & F.forall(answers, lambda a: _is_yes_no(a["answer"]))
    return F.when(F.coalesce(not_answerable, F.lit(False)), "not_answerable").when(F.coalesce(every, F.lit(False)), "yesno").otherwise("value")


def official_types(answers: Column) -> Column:
    """yesno if any answer is exactly yes or no, else extractive; neither without answers; conditional if any condition."""
    some = F.size(answers) > 0
    yes_no = F.exists(answers, lambda a: a["answer"].isin("yes", "no"))
    conditional = F.exists(answers, lambda a: F.size(a["conditions"]) > 0)
    return F.struct((some & yes_no).alias("yesno"), (some & ~yes_no).alias("extractive"), conditional.alias("conditional"))


def gold_any_yes(answers: Column) -> Column:
    return F.when(F.exists(answers, lambda a: F.lower(F.trim(a["answer"])) == "yes"), "yes").otherwise("no")


def gold_first_yes_no(answers: Column) -> Column:
    return F.get(F.filter(F.transform(answers, lambda a: F.lower(a["answer"])), lambda x: x.isin("yes", "no")), F.lit(0))


def prediction(entails: Column, values: Column, kind: Column) -> Column:
    """A verdict as an array of answers; null where nothing was decided.

    A goal that is not provable is called not answerable only where the gold type says so: the type is known to the
    prediction, as in the published procedure.
    """
    found = F.coalesce(F.size(values) > 0, F.lit(False))
    rejected = F.when(kind == "not_answerable", F.array(F.lit("not answerable"))).otherwise(F.array(F.lit("no")))
    return F.when(entails & found, values).when(entails, F.array(F.lit("yes"))).when(~entails, rejected)


def as_answers(predicted: Column) -> Column:
    """A prediction as an answer list without conditions; nothing and ``not answerable`` are the empty list."""
    none = predicted.isNull() | (F.array_join(predicted, "\0") == "not answerable")
    empty = F.from_json(F.lit("[]"), ANSWERS)
    return F.when(none, empty).otherwise(F.transform(predicted, lambda v: F.struct(v.alias("answer"), F.array().cast("array<string>").alias("conditions"))))


# aggregates


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def metric_buckets(scored: DataFrame) -> DataFrame:
    """bucket, n and the mean of each metric in total, by ``question_type`` and over ``conditional`` rows.

    Buckets without rows have n = 0 and 0.0.
    """
    named = F.explode(F.array_compact(F.array(F.lit("total"), F.col("question_type"), F.when(F.col("conditional"), F.lit("conditional")))))
    sums = scored.select(named.alias("bucket"), *METRICS).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(m) for m in METRICS])
    every = scored.sparkSession.createDataFrame([(b, i) for i, b in enumerate(("total", "yesno", "value", "not_answerable", "conditional"))], "bucket string, place int")
    return every.join(sums, "bucket", "left").select("bucket", "place", F.coalesce("n", F.lit(0)).alias("n"), *[F.coalesce(m, F.lit(0.0)).alias(m) for m in METRICS])


def official_averages(scored: DataFrame) -> DataFrame:
    """One row a bucket (total, yesno, extractive, conditional) with the mean of each metric, null where it has no row."""
    named = F.explode(F.array_compact(F.array(F.lit("total"), F.when(F.col("yesno"), F.lit("yesno")), F.when(F.col("extractive"), F.lit("extractive")), F.when(F.col("conditional"), F.lit("conditional")))))
    return scored.select(named.alias("bucket"), *METRICS).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(m) for m in METRICS])


def confusion(rows: DataFrame, positive: Column, correct: Column, by: str = "question_type") -> DataFrame:
    """bucket, tp, fp, fn, tn, precision, recall, f1 in total and for each value of ``by``."""
    x = rows.select(F.explode(F.array(F.lit("total"), F.col(by))).alias("bucket"), F.coalesce(positive, F.lit(False)).alias("p"), F.coalesce(correct, F.lit(False)).alias("c"))
    counts = x.groupBy("bucket").agg(F.count_if(F.expr("p and c")).alias("tp"), F.count_if(F.expr("p and not c")).alias("fp"), F.count_if(F.expr("not p and c")).alias("fn"), F.count_if(F.expr("not p and not c")).alias("tn"))
    return with_prf(counts)


def yes_no_confusion(rows: DataFrame, predicted: Column, gold: Column) -> DataFrame:
    """One row: the confusion of yes against anything else, over the rows given."""
    x = rows.select(F.coalesce(predicted == "yes", F.lit(False)).alias("p"), F.coalesce(gold == "yes", F.lit(False)).alias("g"))
    return with_prf(x.agg(F.count_if(F.expr("p and g")).alias("tp"), F.count_if(F.expr("p and not g")).alias("fp"), F.count_if(F.expr("not p and g")).alias("fn"), F.count_if(F.expr("not p and not g")).alias("tn")))


def with_prf(counts: DataFrame) -> DataFrame:
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    x = counts.withColumn("precision", p).withColumn("recall", r)
    return x.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def outcome_breakdown(rows: DataFrame) -> DataFrame:
    """question_type, total, entailed, not_entailed, error."""
    return rows.groupBy("question_type").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("entails")).alias("entailed"), F.count_if(~F.col("entails")).alias("not_entailed"), F.count_if(F.col("entails").isNull()).alias("error"))


def prediction_breakdown(rows: DataFrame) -> DataFrame:
    """question_type, total, yes, no, not_answerable; whatever is neither yes nor no is the last."""
    p = F.coalesce(F.lower("predicted"), F.lit(""))
    return rows.groupBy("question_type").agg(F.count(F.lit(1)).alias("total"), F.count_if(p == "yes").alias("yes"), F.count_if(p == "no").alias("no"), F.count_if(~p.isin("yes", "no")).alias("not_answerable"))


def answer_summary(rows: DataFrame) -> DataFrame:
    """One row of counts over answered questions: context_found, entails, error, question_type, predicted, gold."""
    yes_no = F.col("question_type") == "yesno"
    right, asked = F.count_if(yes_no & (F.col("predicted") == F.col("gold"))), F.count_if(yes_no)
    return rows.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("context_found").alias("context_found"), F.count_if(F.col("entails")).alias("entailed"),
        F.count_if(~F.col("entails")).alias("not_entailed"), F.count_if(F.col("entails").isNull()).alias("undecided"), asked.alias("yesno"), right.alias("yesno_right"),
        F.coalesce(F.floor(F.try_divide(100 * right, asked)), F.lit(0)).cast("long").alias("yesno_percent"),
        F.count_if((F.col("question_type") == "value") & F.col("entails")).alias("value_entailed"),
        F.count_if((F.col("question_type") == "not_answerable") & ~F.coalesce("entails", F.lit(False))).alias("rejected"),
    )


def check_summary(rows: DataFrame) -> DataFrame:
    """One row of counts over checked goals: context_found, entails, error."""
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if("context_found").alias("context_found"), F.count_if(F.col("entails")).alias("entailed"), F.count_if(~F.col("entails")).alias("not_entailed"), F.count_if(F.col("error").isNotNull()).alias("errors"))


def model_summary(rows: DataFrame) -> DataFrame:
    """One row over a model's answers: errors, predictions of each kind, and how many yes/no questions it got right."""
    said = lambda v: F.count_if(F.col("error").isNull() & F.coalesce(F.col("predicted") == v, F.lit(False)))
    asked = (F.col("question_type") == "yesno") & F.col("error").isNull()
    right = F.count_if(asked & F.coalesce(F.col("predicted") == gold_any_yes(F.col("gold_answers")), F.lit(False)))
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("error").isNotNull()).alias("errors"), said("yes").alias("yes"), said("no").alias("no"), said("not answerable").alias("not_answerable"), F.count_if(asked).alias("yesno"), right.alias("yesno_right"), ratio(right, F.count_if(asked)).alias("accuracy"))


def metric_table(buckets: DataFrame, keep_empty: bool = False) -> DataFrame:
    """bucket, n and metrics as percent, in the fixed order of the buckets; those without rows go unless they are kept."""
    return buckets.filter(F.lit(keep_empty) | (F.col("n") > 0)).orderBy("place").select("bucket", "n", *[percent(F.col(m)).alias(m) for m in METRICS])


def coverage(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: how many ids are in both, only in ``a`` and only in ``b``."""
    x = a.select(F.col(key).cast("string").alias("k"), F.lit(1).alias("in_a"), F.lit(0).alias("in_b")).unionByName(b.select(F.col(key).cast("string").alias("k"), F.lit(0).alias("in_a"), F.lit(1).alias("in_b")))
    g = x.groupBy("k").agg(F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"))
    return g.agg(F.count_if(F.expr("in_a = 1 and in_b = 1")).alias("both"), F.count_if(F.expr("in_a = 1 and in_b = 0")).alias("only_a"), F.count_if(F.expr("in_a = 0 and in_b = 1")).alias("only_b"))


def wrong_yes_no(rows: DataFrame, n: int = 10, order: str = "id") -> DataFrame:
    """The first ``n`` yes/no questions whose prediction (a string, or an array of one) is not the gold answer."""
    gold = gold_first_yes_no(F.col("gold_answers"))
    if isinstance(rows.schema["predicted"].dataType, ArrayType):
        rows = rows.withColumn("predicted", F.when(F.size("predicted") == 1, F.col("predicted")[0]))
    return rows.filter(F.col("question_type") == "yesno").withColumn("gold", gold).filter(F.col("gold").isNotNull() & ~F.col("gold").eqNullSafe(F.col("predicted"))).orderBy(order).limit(n)


def per_question(scored: DataFrame) -> DataFrame:
    """id, question_type, metrics, correct, and precision: 1 or 0 for an entailed question, null for any other."""
    correct = F.col("em") == 1.0
    return scored.select("id", "question_type", *METRICS, correct.alias("correct"), F.when(F.col("entails"), correct.cast("double")).alias("precision"))
