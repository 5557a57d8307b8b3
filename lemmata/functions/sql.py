"""Answer functions for SQL text: temporary functions of a session, inlined by the optimizer like any expression."""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = (
    r"""normalized_answer(s STRING) RETURNS STRING RETURN
    trim(regexp_replace(regexp_replace(regexp_replace(lower(s), r'[!-/:-@\[-`{-~]', ''), r'(?<![\p{L}\p{N}_])(a|an|the)(?![\p{L}\p{N}_])', ' '), r'(?U)\s+', ' '))""",
    r"""answer_tokens(s STRING) RETURNS ARRAY<STRING> RETURN filter(split(normalized_answer(coalesce(s, '')), ' '), t -> t <> '')""",
    r"""token_f1(g ARRAY<STRING>, p ARRAY<STRING>) RETURNS DOUBLE RETURN
    CASE WHEN size(g) = 0 OR size(p) = 0 THEN CAST(size(g) = 0 AND size(p) = 0 AS DOUBLE)
    ELSE 2.0D * aggregate(transform(array_distinct(array_intersect(p, g)), t -> least(size(filter(g, x -> x = t)), size(filter(p, x -> x = t)))), 0, (a, x) -> a + x) / (size(g) + size(p)) END""",
    r"""answer_f1(gold STRING, pred STRING) RETURNS DOUBLE RETURN token_f1(answer_tokens(gold), answer_tokens(pred))""",
    r"""answer_em(gold STRING, pred STRING) RETURNS DOUBLE RETURN CAST(normalized_answer(coalesce(gold, '')) = normalized_answer(coalesce(pred, '')) AS DOUBLE)""",
)


def register(spark: SparkSession) -> None:
    """Create, or replace, the functions in a session: normalized_answer, answer_tokens, token_f1, answer_f1, answer_em.

    A null text has a null normal form and no tokens, and is scored like an empty one.
    """
    for f in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {f}")
