"""Calls of models: extraction in batches and answers one by one. The model is a function that the caller gives."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lemmata.functions.text import parsed_answer
from lemmata.shipping import map_arrow


def extracted(jobs: DataFrame, call: Callable[[list[dict]], list[dict]], batch: int = 5) -> DataFrame:
    """index, id, logic_kb (JSON), error: ``call`` turns a list of job rows into as many results.

    A batch that fails or has another number of results is tried again item by item; an item that fails by itself has a
    null result and an error.
    """

    def one(items: list[dict]) -> list[tuple[str | None, str | None]]:
        try:
            got = call(items)
            if len(got) == len(items):
                return [(json.dumps(x, sort_keys=True, ensure_ascii=False), None) for x in got]
            error = f"{len(got)} results for {len(items)} items"
        except Exception as e:  # noqa: BLE001  whatever the model's client raises
            error = f"{type(e).__name__}: {e}"
        return [(None, error)] if len(items) == 1 else [r for x in items for r in one([x])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            out = [r for at in range(0, len(rows), batch) for r in one(rows[at : at + batch])]
            yield pa.RecordBatch.from_arrays([pa.array([r["index"] for r in rows], pa.int64()), pa.array([str(r["id"]) for r in rows]), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.string())], names=["index", "id", "logic_kb", "error"])

    return map_arrow(jobs.withColumn("index", F.col("index").cast("long")), run, "index long, id string, logic_kb string, error string")


def first_batches(jobs: DataFrame, batches: int, size: int) -> DataFrame:
    return jobs.orderBy("index").limit(batches * size)


def without_hypothesis(kb: DataFrame, column: str = "logic_kb") -> DataFrame:
    """Context knowledge bases carry no hypothesis in either language."""
    return kb.withColumn(column, F.col(column).withField("fol", F.col(f"{column}.fol").dropFields("hypothesis")).withField("prolog", F.col(f"{column}.prolog").dropFields("hypothesis")))


def generated(questions: DataFrame, generate: Callable[[list[dict]], str]) -> DataFrame:
    """``questions`` (messages, context_found, ..) with raw_output, predicted, error.

    ``generate`` turns one list of messages into text. Without a context, or where it fails, the answer is ``not
    answerable`` and the error says why.
    """
    names = questions.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in questions.schema.fields) + ", raw_output string, failure string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, failure = [], []
            for m, found in zip(b.column("messages").to_pylist(), b.column("context_found").to_pylist(), strict=True):
                try:
                    out.append(generate(m) if found else None)
                    failure.append(None if found else "context not found")
                except Exception as e:  # noqa: BLE001  whatever the model raises
                    out.append(None)
                    failure.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string()), pa.array(failure, pa.string())], names=[*b.schema.names, "raw_output", "failure"])

    done = map_arrow(questions, run, schema)
    return done.select(*names, "raw_output", F.when(F.col("failure").isNull(), parsed_answer(F.col("raw_output"))).otherwise("not answerable").alias("predicted"), F.col("failure").alias("error"))
