"""Record files: JSON arrays, JSON lines, and indented objects with blank lines between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lemmata.scratch import keep


_BLANK = " \n\r\t"


def _pieces(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """ordinal, value: a file's text between separators, dealt out by byte ranges. ``ordinal`` sorts as the file does: file,
    start of the byte range, number within the task, and a place for what is cut further."""
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"), F.lit(0).alias("part"))
    return spark.read.option("lineSep", sep).text(path).select(at.alias("ordinal"), "value")


def _shape(spark: SparkSession, path: str) -> tuple[str, bool, bool]:
    """(the first line that is not blank, whether an empty line lies between two such lines, whether lines end in CR LF)."""
    x = _pieces(spark, path, "\n").select("ordinal", F.rtrim("value", F.lit("\r")).alias("line"), F.col("value").endswith("\r").alias("cr"))
    x = x.withColumn("some", F.trim("line", F.lit(_BLANK)) != "")
    ends = x.agg(F.min(F.when(F.col("some"), F.struct("ordinal", "line"))).alias("first"), F.max(F.when(F.col("some"), F.col("ordinal"))).alias("last"), F.max("cr").alias("cr")).first()
    if ends["first"] is None:
        return "", False, False
    place = lambda r: F.struct(*[F.lit(v).cast(t).alias(n) for n, t, v in zip(("file", "start", "row", "part"), ("string", "long", "long", "int"), r, strict=True)])
    inner = x.filter((F.col("line") == "") & (F.col("ordinal") > place(ends["first"]["ordinal"])) & (F.col("ordinal") < place(ends["last"])))
    return ends["first"]["line"].strip(), not inner.isEmpty(), bool(ends["cr"])


def layout(spark: SparkSession, path: str) -> str:
    """``array``, ``lines`` or ``blocks``, from the whole file: an empty line between two records, however far, makes blocks.

    A line that holds white space is not empty. A single indented record counts as a block too.
    """
    first, blank, _ = _shape(spark, path)
    if first.startswith("["):
        return "array"
    return "blocks" if blank or first in ("", "{") or not first.endswith("}") else "lines"


def _blocks(spark: SparkSession, path: str, crlf: bool) -> DataFrame:
    """ordinal, value of each block: what lies between empty lines, whichever way lines end and also where files mix them."""
    raw = _pieces(spark, path, "\r\n\r\n" if crlf else "\n\n")
    cut = raw.select("ordinal", F.posexplode(F.split("value", r"(?:\r\n|\n|\r(?!\n)){2}")).alias("part", "value"))
    return cut.select(F.col("ordinal").withField("part", F.col("part")).alias("ordinal"), F.trim("value", F.lit(_BLANK)).alias("value")).filter("value <> ''")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return _pieces(spark, path, "\n").withColumn("value", F.trim("value", F.lit(_BLANK))).filter("value <> ''")


def _parsed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``v``, the JSON value of the whole text, or null: a value that something follows is none.

    The text is read as a member of an object with one more behind it; only then is nothing cut off. Two members of one
    name make a value broken.
    """
    around = F.try_parse_json(F.concat(F.lit('{"v":'), F.col("value"), F.lit(',"end":0}')))
    members = F.try_variant_get(around, "$", "map<string,variant>")
    return rows.withColumn("v", F.when((F.size(members) == 2) & F.map_contains_key(members, "end"), F.try_variant_get(around, "$.v", "variant")))


def _schema(rows: DataFrame, schema: StructType | str | None):
    if schema is not None:
        return schema
    first = rows.orderBy("ordinal").select("value").first()
    return F.schema_of_json(F.lit(first["value"] if first else "{}"))


def read(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """The records of a file in any of the three layouts; a broken one, or one that is no object, is an error that shows it."""
    kind = layout(spark, path)
    if kind == "array":
        reader = spark.read.schema(schema) if schema is not None else spark.read
        return reader.option("multiLine", True).option("mode", "FAILFAST").json(path)
    rows = _blocks(spark, path, _shape(spark, path)[2]) if kind == "blocks" else _lines(spark, path)
    good = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    told = F.raise_error(F.concat(F.lit("no record: "), F.left("value", F.lit(200)))).cast("boolean")
    return _parsed(rows).filter(F.when(good, True).otherwise(told)).select(F.from_json("value", _schema(rows, schema)).alias("r")).select("r.*")


def read_valid(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """ordinal and the records before the first text that is broken; values that are no objects are left out."""
    _, blank, crlf = _shape(spark, path)
    rows = _blocks(spark, path, crlf) if blank or layout(spark, path) == "blocks" else _lines(spark, path)
    parsed = _parsed(rows)
    bad = parsed.agg(F.min(F.when(F.col("v").isNull(), F.col("ordinal"))).alias("bad"))
    good = parsed.join(F.broadcast(bad)).filter(F.col("bad").isNull() | (F.col("ordinal") < F.col("bad"))).filter(F.schema_of_variant("v").startswith("OBJECT"))
    return good.select("ordinal", F.from_json("value", _schema(good, schema)).alias("r")).select("ordinal", "r.*")


def write(df: DataFrame, path: str, pretty: bool = True, mode: str = "error") -> None:
    """Indented records, each followed by a blank line, or JSON lines."""
    if pretty:
        df.select(F.to_json(F.struct("*"), {"pretty": "true", "ignoreNullFields": "false"}).alias("value")).write.mode(mode).option("lineSep", "\n\n").text(path)
    else:
        df.write.mode(mode).option("ignoreNullFields", False).json(path)


def as_array(df: DataFrame, order: str) -> DataFrame:
    """One row: a small table as one indented JSON array, in order of a column."""
    return df.agg(F.to_json(F.sort_array(F.collect_list(F.struct(order, *[c for c in df.columns if c != order]))), {"pretty": "true"}).alias("json"))


def last_of_each(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key in order of a column; rows whose key is null or empty go."""
    some = df.filter(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    return some.groupBy(F.col(key).alias("key")).agg(F.max_by(F.struct("*"), F.struct(order)).alias("row")).select("row.*")


def numbered(df: DataFrame, order: str, name: str = "index") -> DataFrame:
    """``df`` with the number of each row in order of a column, from 0.

    Rows are dealt by ranges and sorted, and written down with their place in their range: whoever reads them finds the
    same ranges. The ranges are then counted, so no task numbers all rows. Nulls come first; ties are in any order.
    """
    place = F.monotonically_increasing_id()  # the range in the upper bits, the place in it in the lower 33
    dealt = df.withColumn("_order", F.col(order)).repartitionByRange(F.col("_order")).sortWithinPartitions("_order").withColumn("_place", place)
    ranged = keep(dealt.drop("_order"), "numbered").withColumn("_part", F.shiftright("_place", 33))
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row for each range
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    at = F.col("_start") + F.col("_place").bitwiseAND((1 << 33) - 1)
    return ranged.join(F.broadcast(starts), "_part").select(*df.columns, at.alias(name))


def chunked(df: DataFrame, size: int, order: str) -> DataFrame:
    """chunk, rows: consecutive rows in groups of ``size``; all but the last are full."""
    x = numbered(df, order, "_i")
    return x.groupBy(F.floor(F.col("_i") / size).cast("long").alias("chunk")).agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", *df.columns))), lambda x: F.struct(*[x[c].alias(c) for c in df.columns])).alias("rows"))


def remaining(jobs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Jobs that have no result yet, by key: a run may be taken up again whatever was filtered in between."""
    return jobs.join(done.select(key).distinct(), key, "left_anti")
