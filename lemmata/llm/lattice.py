"""Filter interaction audit: what each filter does at each place of each order, by lattice-edge aggregation.

An edge of the lattice is (the set of filters already applied, the filter that comes next): k filters have k * 2**(k - 1),
five have 80. A document's outcome on an edge depends on the set of filters that it fails alone, so documents are counted
by that set first and each set then contributes to all edges. An order of the filters is a path of k edges, and its figures
are those of the edges that it passes: k! orders are joined to the edges, not to documents.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lemmata.llm.common import WORD, forget, keep

#: Orders are k * k! rows, which are broadcast: 35280 for so many filters.
MOST_FILTERS = 7


def paths(spark, filters: Sequence[str]) -> DataFrame:
    """filter_order, step, applied, bit: every order of the filters as its edges; sets are bit masks."""
    bit = {f: 1 << i for i, f in enumerate(filters)}
    rows = [("".join(order), k + 1, sum(bit[f] for f in order[:k]), bit[order[k]]) for order in permutations(filters) for k in range(len(order))]
    return spark.createDataFrame(rows, "filter_order string, step int, applied int, bit int")


def edges(judged: DataFrame, filters: Sequence[str], lost: Sequence[str] = ()) -> DataFrame:
    """part, applied, bit and counts of documents for every edge of every part.

    ``judged`` has ``part``, a boolean column for each filter (true: the document fails it) and one for each name in
    ``lost``. ``kept`` and ``removed`` count what reaches the edge and passes or fails its filter, ``redundant`` what fails
    it and is gone already, ``unique_fails`` what fails it alone; a column of ``lost`` counts its own among the removed.
    """
    mask = sum((F.when(F.col(f), 1 << i).otherwise(0) for i, f in enumerate(filters)), F.lit(0))
    sets = judged.groupBy("part", mask.alias("mask")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(x).cast("long")).alias(x) for x in lost])
    bits = F.array(*[F.lit(1 << i) for i in range(len(filters))])
    x = sets.withColumn("applied", F.explode(F.sequence(F.lit(0), F.lit((1 << len(filters)) - 1)))).withColumn("bit", F.explode(bits))
    x = x.filter(F.col("applied").bitwiseAND(F.col("bit")) == 0)
    there, fails = F.col("mask").bitwiseAND(F.col("applied")) == 0, F.col("mask").bitwiseAND(F.col("bit")) != 0
    total = lambda n, where: F.sum(F.when(where, F.col(n)).otherwise(F.lit(0))).cast("long")
    return x.groupBy("part", "applied", "bit").agg(
        total("n", there & ~fails).alias("kept"), total("n", there & fails).alias("removed"), total("n", ~there & fails).alias("redundant"),
        total("n", F.col("mask") == F.col("bit")).alias("unique_fails"), *[total(c, there & fails).alias(c) for c in lost],
    )


def audit(judged: DataFrame, filters: Sequence[str], lost: Sequence[str] = ()) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, ``lost``, shapley: a row for every part, order and step.

    ``judged`` is as in ``edges``; a null judgement is a pass. ``shapley`` is what the step's filter removes, summed over all
    orders. The figures of an edge stand for all orders that pass it, so zeros are there too. An empty table gives an empty
    one. Parts are bounded by nothing: each has k * 2**(k - 1) edges whatever it holds.
    """
    k = len(filters)
    if not 0 < k <= MOST_FILTERS:
        raise ValueError(f"{k} filters; 1 to {MOST_FILTERS} are possible")
    through = F.element_at(F.array(*[F.lit(factorial(s) * factorial(k - 1 - s)) for s in range(k)]), F.bit_count("applied") + 1)  # orders that pass an edge
    whole = edges(judged, filters, lost).withColumn("shapley", F.sum(F.col("removed") * through).over(Window.partitionBy("part", "bit")))
    steps = whole.join(F.broadcast(paths(judged.sparkSession, filters)), ["applied", "bit"])
    return steps.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", *lost, "shapley")


def _text_failures(text: Column) -> dict[str, Column]:
    words = F.col("words")
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 5 * F.char_length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def document_flags(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest of the text, A to D of every row of ``docs`` (doc_id, text, source)."""
    text = F.coalesce("text", F.lit(""))
    x = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"))
    return x.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), *[c.alias(k) for k, c in _text_failures(F.col("text")).items()])


def judged(flags: DataFrame, labels: DataFrame) -> DataFrame:
    """part, A to E, good_lost, toxic_lost: flags with what needs other rows and the labels.

    Copies meet only in the minimum of their ids, which is made before the shuffle; whether a row has that minimum is then
    looked up by digest and id together, so a hot group of copies is dealt out by its ids.
    """
    first = flags.filter("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    told = labels.filter("doc_id is not null").groupBy("doc_id").agg(one("quality").alias("good_lost"), one("toxic").alias("toxic_lost"))
    x = flags.join(first, ["digest", "doc_id"], "left").join(told, "doc_id", "left")
    some = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    return x.select("part", "A", "B", "C", "D", (F.col("doc_id").isNotNull() & F.col("is_first").isNull()).alias("E"), some("good_lost"), some("toxic_lost"))


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``audit`` of ``docs`` (doc_id, text, source) by five filters.

    A: under 50 words; B: 100 * distinct words < 65 * words; C: 100 * capitals > 5 * code points; D: holds one of #$%&*|;
    E: a smaller id has the same text. ``part`` is the source. Null texts are empty and null sources the empty string, so
    they count with those. A null id has no smaller id and no label; rows that repeat an id and its text do not fail E by
    each other. Of several labels of an id each counts: quality or toxic is 1 if one of them is. Texts are equal if their
    SHA-256 digests are. Extra columns are ignored; without documents there are no rows, without labels no losses.
    """
    flags = keep(document_flags(docs), "audit-flags")
    out = keep(audit(judged(flags, labels), "ABCDE", ("good_lost", "toxic_lost")), "audit")
    forget(flags)
    return out
