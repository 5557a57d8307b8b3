"""Policy pages as typed document trees.

Only reading markup is Python (events of headings, paragraphs, items and tables, in one Arrow pass over the documents, which
are dealt out by document before it).
Sections, lists, rules and rendering are window and array expressions over a flat node table
(doc, pos, parent, depth, type, level, title, text, intro, operator, outcome, items, exceptions, columns, rows).
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from lemmata.functions import text as T
from lemmata.scratch import keep
from lemmata.shipping import lean, ship

EVENTS = "array<struct<tag:string,text:string,header:boolean,cells:array<array<string>>>>"
_EVENTS = pa.list_(pa.struct([("tag", pa.string()), ("text", pa.string()), ("header", pa.bool_()), ("cells", pa.list_(pa.list_(pa.string())))]))
#: Characters of markup whose events are Python objects at a time; a longer page is by itself.
AT_ONCE = 1 << 20
_HEADINGS = {"h1", "h2", "h3", "h4"}
_KEPT = _HEADINGS | {"p", "li", "table"}
_BLOCKS = _KEPT | {"div", "ul", "ol", "section", "article", "footer", "header", "nav", "main", "tr", "td", "th", "h5", "h6", "blockquote", "pre"}


def table_markup(rows: Column) -> Column:
    """Bare ``<tr>a | b</tr>`` lines as a table; the first row is its header."""
    inner = lambda r: F.regexp_replace(F.regexp_replace(r, r"(?i)^\s*<tr[^>]*>", ""), r"(?i)</tr>\s*$", "")
    cells = lambda r, tag: F.array_join(F.transform(F.split(inner(r), r"\|"), lambda c: F.concat(F.lit(f"<{tag}>"), F.trim(c), F.lit(f"</{tag}>"))), "")
    return F.concat(F.lit("<table>"), F.array_join(F.transform(rows, lambda r, i: F.concat(F.lit("<tr>"), F.when(i == 0, cells(r, "th")).otherwise(cells(r, "td")), F.lit("</tr>"))), ""), F.lit("</table>"))


def joined_rows(lines: Column) -> Column:
    """Lines in which every run of bare table rows is one table; all others as they are, in order."""
    none = F.array().cast("array<string>")
    close = lambda a: F.when(F.size(a["open"]) > 0, F.concat(a["out"], F.array(table_markup(a["open"])))).otherwise(a["out"])
    step = lambda a, x: F.when(T.is_row_line(x), F.struct(a["out"].alias("out"), F.concat(a["open"], F.array(x)).alias("open"))).otherwise(F.struct(F.concat(close(a), F.array(x)).alias("out"), none.alias("open")))
    return F.aggregate(lines, F.struct(none.alias("out"), none.alias("open")), step, close)


class _Reader(HTMLParser):
    """Events of kept elements in order of their start; text belongs to every kept element that is open."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.events: list[dict] = []
        self.open: list[tuple[str, dict | None]] = []
        self.silent = 0

    def _close(self, tag: str, stop: frozenset = frozenset()) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return
            if self.open[i][0] in stop:
                return

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.silent += 1
        if tag in _BLOCKS:
            self._close("p", frozenset({"li", "td", "th", "table", "div"}))
        if tag == "li":
            self._close("li", frozenset({"ul", "ol"}))
        event = None
        if tag in _KEPT:
            event = {"tag": tag, "text": [], "header": False, "cells": [] if tag == "table" else None}
            self.events.append(event)
        if tag in ("tr", "td", "th"):
            if table := next((e for t, e in reversed(self.open) if t == "table"), None):
                if tag == "tr":
                    self._close("tr", frozenset({"table"}))
                    table["cells"].append([])
                else:
                    self._close("td", frozenset({"tr", "table"}))
                    self._close("th", frozenset({"tr", "table"}))
                    if not table["cells"]:
                        table["cells"].append([])
                    table["cells"][-1].append([])
                    table["header"] |= tag == "th" and len(table["cells"]) == 1
        if tag not in ("br", "img", "meta", "link", "input", "hr"):
            self.open.append((tag, event))

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.silent = max(0, self.silent - 1)
        self._close(tag)

    def handle_data(self, data):
        if self.silent:
            return
        in_cell = False
        for tag, event in reversed(self.open):
            in_cell |= tag in ("td", "th")
            if event is None:
                continue
            if event["tag"] == "table":
                if in_cell and event["cells"] and event["cells"][-1]:
                    event["cells"][-1][-1].append(data)
            else:
                event["text"].append(data)


def _clean(parts: list[str]) -> str:
    return " ".join(" ".join(parts).split())


def read_events(html: str | None) -> list[dict]:
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    return [{"tag": e["tag"], "text": _clean(e["text"]), "header": e["header"], "cells": None if e["cells"] is None else [[_clean(c) for c in row] for row in e["cells"]]} for e in reader.events]


def read_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The events of each page, in arrays of no more than about AT_ONCE characters of markup."""
    for batch in batches:
        found, size = [], 0
        for page in batch:
            html = page.as_py()
            found.append(read_events(html))
            size += len(html or "")
            if size >= AT_ONCE:
                yield pa.array(found, _EVENTS)
                found, size = [], 0
        if found or not len(batch):
            yield pa.array(found, _EVENTS)


def events(df: DataFrame, html: str | Column, doc: str = "doc") -> DataFrame:
    """``df`` with ``events`` of a markup column.

    Rows are dealt out by ``doc`` first, or few files would be parsed by as few tasks. Equal pages stay apart.
    """
    ship(df.sparkSession)

    @arrow_udf(EVENTS)
    def read(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from lean(read_batches)(pages)

    return df.repartition(F.col(doc)).withColumn("events", read(F.col(html) if isinstance(html, str) else html))


def table_columns(header: Column, cells: Column) -> Column:
    """The first row where it is a header, else col_0, col_1, ..."""
    wide = F.greatest(F.array_max(F.transform(cells, F.size)), F.lit(1))
    return F.when(header, cells[0]).otherwise(F.transform(F.sequence(F.lit(0), wide - 1), lambda i: F.concat(F.lit("col_"), i.cast("string"))))


def table_rows(header: Column, cells: Column) -> Column:
    """Rows as maps by column; short rows are filled with empty cells, long ones cut; of equal columns the last wins."""
    names = table_columns(header, cells)
    body = F.when(header, F.slice(cells, 2, F.size(cells))).otherwise(cells)
    last = lambda i: F.array_position(F.transform(F.reverse(names), lambda n: n == names[i]), True) == F.size(names) - i
    kept = F.filter(F.sequence(F.lit(0), F.size(names) - 1), last)
    return F.transform(body, lambda r: F.map_from_arrays(F.transform(kept, lambda i: names[i]), F.transform(kept, lambda i: F.coalesce(F.get(r, i), F.lit("")))))


def outline(df: DataFrame, doc: str = "doc") -> DataFrame:
    """The node table of documents with ``events``: sections, texts, lists of consecutive items, tables; empty ones skipped."""
    e = df.select(F.col(doc).alias("doc"), F.posexplode_outer("events").alias("pos", "e")).select("doc", "pos", "e.*")  # outer: else the size of events is asked first, and pages are parsed for that too
    e = e.filter((F.col("text") != "") | ((F.col("tag") == "table") & (F.size("cells") > 0)))
    level = F.when(F.col("tag").rlike("^h[1-4]$"), F.substring("tag", 2, 1).cast("int"))
    before = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("level", level)
    for k in range(1, 5):
        e = e.withColumn(f"l{k}", F.max(F.when(F.col("level") == k, F.col("pos"))).over(before))
    rank = F.coalesce("level", F.lit(5))
    seen = [F.when(F.lit(k) < rank, F.col(f"l{k}")) for k in range(1, 5)]
    # a heading is open if none of a smaller level follows it
    open_ = [(seen[k].isNotNull() & (seen[k] > F.greatest(F.lit(-1), *[F.coalesce(seen[j], F.lit(-1)) for j in range(k)], F.lit(-1)))).cast("int") for k in range(4)]
    e = e.withColumn("parent", F.greatest(*seen)).withColumn("depth", sum(open_[1:], open_[0]))
    order = Window.partitionBy("doc").orderBy("pos")
    starts = (F.col("tag") != "li") | (F.lag("tag").over(order).isNull()) | (F.lag("tag").over(order) != "li")
    e = e.withColumn("run", F.sum(starts.cast("int")).over(order))
    kind = F.when(F.col("level").isNotNull(), "section").when(F.col("tag") == "li", "list").when(F.col("tag") == "table", "table").otherwise("text")
    nodes = e.groupBy("doc", "run").agg(F.min("pos").alias("pos"), F.min_by("parent", "pos").alias("parent"), F.min_by("depth", "pos").alias("depth"), F.min_by(kind, "pos").alias("type"), F.min_by("level", "pos").alias("level"), F.min_by("header", "pos").alias("header"), F.min_by("cells", "pos").alias("cells"), F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("t"))
    texts = F.transform("t", lambda x: x["text"])
    is_ = lambda k: F.col("type") == k
    return nodes.select(
        "doc", "pos", "parent", "depth", "type", "level",
        F.when(is_("section"), texts[0]).alias("title"), F.when(is_("text"), texts[0]).alias("text"), F.when(is_("list"), texts).alias("items"),
        F.when(is_("table"), table_columns(F.col("header"), F.col("cells"))).alias("columns"), F.when(is_("table"), table_rows(F.col("header"), F.col("cells"))).alias("rows"),
    )


def semantic(nodes: DataFrame) -> DataFrame:
    """An outline whose texts are bound to the lists after them.

    A list with an introduction gets its operator and its exceptions; one whose introduction states a rule becomes a
    ``rule`` with an outcome and its text node goes, others keep the text before them. A list by itself is left as it is.
    """
    among = Window.partitionBy("doc", "parent").orderBy("pos")
    x = nodes.withColumn("after", F.lead("type").over(among)).withColumn("intro", F.when((F.col("type") == "list") & (F.lag("type").over(among) == "text"), F.lag("text").over(among)))
    bound = F.col("intro").isNotNull()
    rule = bound & T.is_rule_intro(F.col("intro"))
    gone = (F.col("type") == "text") & (F.col("after") == "list") & T.is_rule_intro(F.col("text"))
    x = x.withColumn("rule", F.coalesce(rule, F.lit(False))).filter(~F.coalesce(gone, F.lit(False)))
    return x.select(
        "doc", "pos", "parent", "depth", F.when(F.col("rule"), "rule").otherwise(F.col("type")).alias("type"), "level", "title", "text", "intro",
        F.when(bound, T.list_operator(F.col("intro"))).alias("operator"), F.when(F.col("rule"), T.outcome(F.col("intro"))).alias("outcome"),
        F.when(bound, F.filter("items", lambda i: ~T.is_exception(i))).otherwise(F.col("items")).alias("items"),
        F.when(bound, F.filter("items", T.is_exception)).alias("exceptions"), "columns", "rows",
    )


def semantic_tree(df: DataFrame, contents: str = "contents", doc: str = "doc") -> DataFrame:
    """The semantic node table of documents (``doc``, ``contents`` array of lines)."""
    markup = F.concat(F.lit("<div>"), F.array_join(joined_rows(F.col("contents")), "\n"), F.lit("</div>"))
    return semantic(outline(events(df.select(F.col(doc).alias("doc"), F.col(contents).alias("contents")), markup)))


def rendered(nodes: DataFrame) -> DataFrame:
    """doc, text: the tree as plain text; an introduction of a rule is printed with the rule and again with its list."""
    line = lambda c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.trim(c))
    indent = F.repeat(F.lit("  "), F.col("depth"))
    items = lambda c, mark: F.transform(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda i: F.trim(i) != ""), lambda i: F.concat(indent, F.lit(mark), F.trim(i)))
    title = F.array(F.concat(F.repeat(F.lit("#"), F.least(F.col("depth") + 1, F.lit(4))), F.lit(" "), F.col("title")))
    body = F.concat(F.array(line(F.col("intro")), F.when(F.col("operator").isNotNull(), F.concat(F.lit("["), F.col("operator"), F.lit(" of the following apply]")))), items(F.col("items"), "- "), items(F.col("exceptions"), "  Exception: "))
    rule = F.concat(F.array(line(F.col("intro")), F.concat(F.lit("[Outcome: "), F.col("outcome"), F.lit("]"))), body)
    head = F.array_join("columns", " | ")
    table = F.concat(F.array(head, F.repeat(F.lit("-"), F.length(head))), F.transform("rows", lambda r: F.array_join(F.transform("columns", lambda c: F.trim(F.coalesce(r[c], F.lit("")))), " | ")))
    lines = F.when(F.col("type") == "section", title).when(F.col("type") == "list", body).when(F.col("type") == "rule", rule).when(F.col("type") == "table", table).otherwise(F.array(line(F.col("text"))))
    joined = F.array_join(F.array_compact(lines), "\n")
    return nodes.groupBy("doc").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", joined.alias("l")))), lambda x: x["l"]), "\n").alias("text"))


def enriched(docs: DataFrame, contents: str = "contents", key: str = "semantic_tree") -> DataFrame:
    """``docs`` with the semantic nodes of each row's document as one JSON column; all other columns are kept."""
    row = next(x for i in range(len(docs.columns) + 1) if (x := "row" + "_" * i) not in {c.lower() for c in docs.columns})
    numbered = keep(docs.withColumn(row, F.monotonically_increasing_id()), "documents")
    nodes = semantic_tree(numbered, contents, row)
    packed = nodes.groupBy(F.col("doc").alias(row)).agg(F.to_json(F.sort_array(F.collect_list(F.struct("pos", *[c for c in nodes.columns if c not in ("doc", "pos", "rows")], F.to_json("rows").alias("rows"))))).alias(key))
    return numbered.join(packed, row, "left").drop(row)
