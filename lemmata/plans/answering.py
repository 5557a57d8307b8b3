"""Whole runs: questions answered by proof or by a model, programs checked, logic extracted, answers scored."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmata.operators import bridging, clauses, models, programs, prompting, prover, scoring
from lemmata.scratch import forget, keep
from lemmata.sources.records import last_of_each, numbered, remaining, write

LISTS = "array<struct<answer:string,conditions:array<string>>>"


def context_index(contexts: DataFrame, url: str = "url", order: str = "ordinal") -> DataFrame:
    """The last context of each url; those without a url are left out."""
    return last_of_each(contexts, url, order)


def with_context(questions: DataFrame, contexts: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``questions`` with the context of their url: columns under new names, null where there is none, and context_found."""
    names = {x.lower() for x in [*questions.columns, *columns.values()]}
    url, found = (next(x for i in range(len(names) + 1) if (x := f"{n}{'_' * i}") not in names) for n in ("context_url", "found"))
    c = context_index(contexts).select(F.col("url").alias(url), *[F.col(k).alias(v) for k, v in columns.items()], F.lit(True).alias(found))
    return questions.join(c, F.col("url") == F.col(url), "left").withColumn("context_found", F.coalesce(found, F.lit(False))).drop(url, found)


def record_id(*ways: Column) -> Column:
    """The first id that is neither null nor empty."""
    return F.coalesce(*[F.nullif(w.cast("string"), F.lit("")) for w in ways])


def answered_by_proof(questions: DataFrame, contexts: DataFrame, how: bridging.Alignment | None = None, *, lemma_synset: DataFrame | None = None, edges: DataFrame | None = None, steps: int = prover.STEPS, fol_fallback: bool = False) -> DataFrame:
    """One row a question: goal, verdict, values, prediction.

    ``questions``: id, url, question, scenario, answers, not_answerable, prolog, fol, constants; ``contexts``: url, ordinal,
    prolog, constants. Where a question has no goal of its own, the first-order one may stand in. Flat programs are proved
    together by relations, others by the bounded prover in ``steps``.
    """
    q = with_context(questions, contexts, {"prolog": "context", "constants": "context_constants"})
    q = q.withColumn("kb", F.col("id").cast("string")).withColumn("program", clauses.program(F.col("context"), F.col("prolog"))).withColumn("goal", clauses.goal_of(F.col("prolog"), F.col("fol") if fol_fallback else None))
    if how is not None:
        q = bridging.align(q.withColumn("scenario_block", F.col("prolog")).withColumn("scenario_constants", F.col("constants")), how, lemma_synset, edges)
    v = programs.answered(q, steps=steps)
    kind = scoring.question_type(F.col("answers"), F.col("not_answerable"))
    return v.withColumn("question_type", kind).select("id", "url", "question", "scenario", "question_type", F.col("goal").alias("prolog_goal"), "context_found", "entails", F.col("values").alias("predicted_values"), scoring.prediction(F.col("entails"), F.col("values"), F.col("question_type")).alias("predicted"), F.col("answers").alias("gold_answers"), "not_answerable", "error")


def checked(questions: DataFrame, contexts: DataFrame, steps: int = prover.STEPS) -> DataFrame:
    """id, url, context_found, hypothesis_fol, prolog_goal, entails, error of each question; no goal falls back to logic."""
    q = with_context(questions, contexts, {"prolog": "context"})
    q = q.withColumn("program", clauses.program(F.col("context"), F.col("prolog"))).withColumn("goal", clauses.goal_of(F.col("prolog"), F.col("fol")))
    v = programs.answered(q, steps=steps)
    return v.select("id", "url", "context_found", F.col("fol.hypothesis").alias("hypothesis_fol"), F.col("goal").alias("prolog_goal"), "entails", "not_answerable", F.col("answers").alias("gold_answers"), "error")


def answered_by_model(questions: DataFrame, documents: DataFrame, generate: Callable[[list[dict]], str], *, max_context_chars: int = 3000, few_shot: bool = False) -> DataFrame:
    """One row a question: raw output and prediction of a model that is given the document's text."""
    q = with_context(questions, documents, {"contents": "contents"})
    text = prompting.answer_input(F.coalesce("contents", F.array().cast("array<string>")), max_context_chars)
    q = q.withColumn("messages", prompting.chat_messages(text, F.col("scenario"), F.col("question"), few_shot)).withColumn("question_type", scoring.question_type(F.col("answers"), F.col("not_answerable")))
    return models.generated(q.select("id", "url", "question", "scenario", "question_type", "context_found", "messages", F.col("answers").alias("gold_answers"), "not_answerable"), generate).drop("messages")


def extracted(jobs: DataFrame, call: Callable[[list[dict]], list[dict]], *, batch: int = 5, batches: int | None = None, done: DataFrame | None = None) -> DataFrame:
    """Logic of the jobs that are not done yet."""
    if batches is not None:
        jobs = models.first_batches(jobs, batches, batch)
    if done is not None:
        jobs = remaining(jobs, done, "id")
    return models.extracted(jobs, call, batch)


def run_extraction(jobs: DataFrame, call: Callable[[list[dict]], list[dict]], path: str, *, batch: int = 5, flush: int = 200) -> DataFrame:
    """Extract the logic of all jobs into JSON lines under ``path``, ``flush`` batches at a time, and read them back.

    What is there already counts as done, by id, whatever became of a run in between: a write is whole or is not there. The
    results are index, id, logic_kb, error; failed items are results too.
    """
    spark = jobs.sparkSession
    schema = "index long, id string, logic_kb string, error string"
    left = jobs.withColumn("id", F.col("id").cast("string"))
    if _exists(spark, path):
        left = remaining(left, spark.read.schema(schema).json(path), "id")
    left = keep(numbered(left, "index", "_n"), "jobs")
    most = left.agg(F.max("_n")).first()[0]
    for start in range(0, (-1 if most is None else most) + 1, batch * flush):
        part = left.filter((F.col("_n") >= start) & (F.col("_n") < start + batch * flush)).drop("_n")
        models.extracted(part, call, batch).write.mode("append").option("ignoreNullFields", False).json(path)
    forget(left)
    return spark.read.schema(schema).json(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether anything has been written whole under a path."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def write_questions(scored_: DataFrame, path: str) -> None:
    """The per-question rows of a run as records."""
    write(scoring.per_question(scored_), path)


def write_checks(checks: DataFrame, path: str) -> DataFrame:
    """The rows of a check as records, and its summary."""
    write(checks, path)
    return scoring.check_summary(checks)


def valid_result(result: Column) -> Column:
    """What is wrong with a model's record (JSON), or null: both blocks are there, names are small, arities are 1 to 8."""
    v = F.from_json(result, "predicates array<struct<name:string,arity:int>>, fol struct<facts:array<string>>, prolog struct<facts:array<string>,rules:array<string>>")
    bad = F.filter(v["predicates"], lambda p: ~F.coalesce(p["name"].rlike("^[a-z][a-z0-9_]*$") & p["arity"].between(1, 8), F.lit(False)))
    return (
        F.when(v.isNull() | (v["fol"].isNull() & v["prolog"].isNull() & v["predicates"].isNull()), "no record")
        .when(v["fol"].isNull(), "no first-order block").when(v["prolog"].isNull(), "no Prolog block")
        .when(F.size(bad) > 0, F.concat(F.lit("predicate "), F.coalesce(bad[0]["name"], F.lit("?")), F.lit("/"), F.coalesce(bad[0]["arity"].cast("string"), F.lit("?"))))
    )


def is_model_run(results: DataFrame) -> bool:
    """Whether results are of a model, from their columns."""
    return "raw_output" in results.columns


def scored(results: DataFrame, gold: DataFrame, keep_unmatched: bool = False) -> DataFrame:
    """Results (id, question_type, predicted as an array) with metrics against gold (id, answers).

    Results without gold are left out, or scored against no answers. Of gold rows with one id the last counts, in order of
    ``ordinal`` if there is one, else in the order in which they are read.
    """
    ids = gold.withColumn("_key", F.col("id").cast("string")).withColumn("_at", F.col("ordinal") if "ordinal" in gold.columns else F.monotonically_increasing_id())
    g = last_of_each(ids, "_key", "_at").select(F.col("id").cast("string").alias("_id"), F.col("answers").alias("reference"))
    x = results.join(g, F.col("id").cast("string") == F.col("_id"), "left" if keep_unmatched else "inner").drop("_id")
    x = x.withColumn("reference", F.coalesce("reference", F.from_json(F.lit("[]"), LISTS))).withColumn("answer_list", scoring.as_answers(F.col("predicted")))
    x = x.withColumn("conditional", F.exists("reference", lambda a: F.coalesce(F.size(a["conditions"]), F.lit(0)) > 0))
    return scoring.answers_metrics(x, "answer_list", "reference")


def official(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """The official averages: gold (id, answers) drives, questions without a prediction (id, predicted) are skipped.

    Of rows with one id the last counts on both sides.
    """
    ids = predictions.withColumn("_key", F.col("id").cast("string")).withColumn("_at", F.col("ordinal") if "ordinal" in predictions.columns else F.monotonically_increasing_id())
    x = scored(last_of_each(ids, "_key", "_at").select("id", "predicted"), gold)
    types = scoring.official_types(F.col("reference"))
    return scoring.official_averages(x.withColumn("t", types).select(*scoring.METRICS, "t.yesno", "t.extractive", "t.conditional"))


def evaluated(results: DataFrame, gold: DataFrame) -> dict[str, DataFrame]:
    """The tables of a run's score: buckets, confusion, yes/no confusion, outcomes, questions."""
    model = is_model_run(results)
    inner, every = scored(results, gold), scored(results, gold, keep_unmatched=True)
    one = F.when(F.size("predicted") == 1, F.col("predicted")[0])
    positive = (F.col("predicted").isNotNull() & ~one.eqNullSafe(F.lit("not answerable"))) if model else F.col("entails")
    yes_no = every.filter("question_type = 'yesno'")
    flat = results.withColumn("predicted", F.when(F.size("predicted") == 1, F.col("predicted")[0]))
    return {
        "buckets": scoring.metric_buckets(inner),
        "confusion": scoring.confusion(every, positive, F.col("em") == 1.0),
        "yes_no": scoring.yes_no_confusion(yes_no, one, scoring.gold_any_yes(F.col("reference"))),
        "outcomes": scoring.prediction_breakdown(flat) if model else scoring.outcome_breakdown(results),
        "coverage": scoring.coverage(results, gold, "id"),
    }
