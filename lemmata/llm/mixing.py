"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key. The sizes are summed per source and key range, where a range is a number of leading
hexadecimal digits of the key. Prefix sums are made in three steps: over groups of ranges (the first half of the digits),
over the ranges of a group, and over the documents of a range. With n documents in a source a window of the first two
steps sees about sqrt(n / RANGE_ROWS) rows and one of the last about RANGE_ROWS, so the sums of a source that holds a third
of all rows are made by many tasks. The cut at ``target - epochs * source size`` is exact to one word. One row for each
source, and no more, is ordered by a single task to find the targets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lemmata.llm.common import WORD, fresh, keep

#: Rows that one range of keys should hold.
RANGE_ROWS = 512


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """Sorts by code point with null last, and is never null."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """From one row a source (skey, source_size) the target of each.

    ``share`` of all sizes is dealt by weight, the weights repeating over the sources in order. A target stops at
    ``most`` times the source's size; what is above is dealt again among the others. In order of size per weight the
    stopped sources are a prefix, so one window finds them.
    """
    order, every = Window.orderBy("skey"), Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    by_room = Window.orderBy(F.col("source_size") / F.col("weight"), "skey").rowsBetween(Window.unboundedPreceding, -1)
    x = sizes.withColumn("weight", weight)
    x = x.select(
        "skey", "source_size", "weight",
        (F.lit(share) * F.sum("source_size").over(every)).alias("all"),
        (F.lit(most) * F.coalesce(F.sum("source_size").over(by_room), F.lit(0))).alias("stopped"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(by_room), F.lit(0.0))).alias("open"),
    )
    dealt = (F.col("all") - F.col("stopped")) * F.col("weight") / F.col("open")
    full = F.lit(most) * F.col("source_size")
    # the first source that its share does not fill ends the stopped ones
    ends = F.min(F.when(dealt <= full, F.struct(F.col("source_size") / F.col("weight"), "skey", "all", "stopped", "open"))).over(every)
    x = x.withColumn("end", ends)
    here = F.struct(F.col("source_size") / F.col("weight"), F.col("skey"))
    last = F.struct(F.col("end.col1"), F.col("end.skey"))
    share_of_rest = (F.col("end.all") - F.col("end.stopped")) * F.col("weight") / F.col("end.open")
    return x.select("skey", "source_size", F.when(F.col("end").isNull() | (here < last), full).otherwise(share_of_rest).alias("target"))


def mix(docs: DataFrame, *, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of ``docs`` (doc_id, text, source).

    A null text has size 0 and is taken 0 times; a null source is one source, the last; a null id has the key of the
    empty text. Rows with one id and size are interchangeable: the result holds a row for each. Extra columns are
    ignored. An empty table gives an empty table.
    """
    sized = keep(
        docs.select("doc_id", source_key(F.col("source")).alias("skey"), words(F.col("text")).alias("size"))
        .withColumn("key", F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))),
        "mix-sizes",
    )
    digits = max(1, math.ceil(math.log(max(1, sized.count()) / RANGE_ROWS, 16)))
    ranged = sized.withColumn("range", F.substring("key", 1, digits))
    ranges = ranged.groupBy("skey", "range").agg(F.sum("size").alias("range_size")).withColumn("group", F.substring("range", 1, digits // 2))
    before = lambda by, order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    groups = ranges.groupBy("skey", "group").agg(F.sum("range_size").alias("group_size"))
    aims = targets(groups.groupBy("skey").agg(F.sum("group_size").alias("source_size")), weights, share, most)
    groups = groups.withColumn("group_start", F.coalesce(F.sum("group_size").over(before(["skey"], "group")), F.lit(0))).join(aims, "skey")
    starts = ranges.withColumn("start", F.coalesce(F.sum("range_size").over(before(["skey", "group"], "range")), F.lit(0))).join(groups, ["skey", "group"])
    starts = starts.select("skey", "range", (F.col("start") + F.col("group_start")).alias("start"), "source_size", "target")
    inside = Window.partitionBy("skey", "range").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    x = ranged.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, ["skey", "range"])
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start") - F.col("inside")))
    return x.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: the columns of ``docs``, a row for each time a document is taken.

    The document at a source's cut is taken up to the cut. Documents that the mix takes no word of are left out, and so
    are null texts. Rows that share an id get the largest number of words taken of any of them, twice their own size at
    most. A null id is an id like others. Other columns are as they were, whatever their names. An empty table gives an
    empty table.
    """
    taken, size, copy, key = (fresh(docs.columns, x) for x in ("taken", "size", "copy", "key"))
    mixed = mix(docs, **how).groupBy("doc_id").agg(F.max("taken").alias(taken)).withColumnRenamed("doc_id", key)
    x = docs.join(mixed, F.col("doc_id").eqNullSafe(F.col(key))).withColumn(size, words(F.col("text"))).filter((F.col(taken) > 0) & (F.col(size) > 0))
    x = x.withColumn(taken, F.least(F.col(taken), 2 * F.col(size)))
    x = x.withColumn(copy, F.explode(F.sequence(F.lit(1), F.ceil(F.col(taken) / F.col(size)).cast("int"))))
    left = (F.col(taken) - (F.col(copy) - 1) * F.col(size)).cast("int")
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), 1, left), "")
    x = x.withColumn("text", F.when(left < F.col(size), cut).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        x = x.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return x.select(*docs.columns)
