"""The catalogue of registered queries and of the SQL each is held against.

The engine's own data are questions and policies; here its operators run on the test tables, each over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmata.functions import sql
from lemmata.functions import text as T
from lemmata.operators import bridging as B
from lemmata.operators import clauses as C
from lemmata.operators import fixpoint as X
from lemmata.operators import outline as H
from lemmata.operators import prompting as P
from lemmata.operators import programs, prover
from lemmata.operators import scoring as S
from lemmata.plans import answering
from lemmata.scratch import scratch_path
from lemmata.sources import records

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _norm(x: str) -> str:
    """The SQL of a normalised answer; the boundaries are written out, and applied twice, as neighbours share one."""
    article = r"'(^|[^\p{L}\p{N}_])(a|an|the)($|[^\p{L}\p{N}_])', '\1 \3', 'g'"
    plain = rf"regexp_replace(lower({x}), '[!-/:-@\[-`{{-~]', '', 'g')"
    return rf"trim(regexp_replace(regexp_replace(regexp_replace({plain}, {article}), {article}), '\s+', ' ', 'g'))"


def _tokens(x: str) -> str:
    return f"list_filter(string_split({_norm(x)}, ' '), lambda t: t <> '')"


def _no_conditions():
    return F.array().cast("array<string>").alias("conditions")


# scores


@query(f"SELECT item_id, {_norm('text')} AS norm FROM benchmark")
def norm_answer(spark, d):
    return _t(spark, d, "benchmark").select("item_id", T.normalized_answer(F.col("text")).alias("norm"))


@query(f"SELECT item_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_distinct FROM (SELECT item_id, {_tokens('text')} AS t FROM benchmark)")
def answer_tokens(spark, d):
    t = T.answer_tokens(F.col("text"))
    return _t(spark, d, "benchmark").select("item_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


@query(f"""
WITH b AS MATERIALIZED (SELECT row_number() OVER (ORDER BY item_id) - 1 AS k, count(*) OVER () AS n, {_norm('text')} AS gold FROM benchmark),
p AS MATERIALIZED (SELECT doc_id, {_norm("coalesce(text, '')")} AS pred FROM documents),
j AS MATERIALIZED (SELECT doc_id, pred, gold, list_filter(string_split(pred, ' '), lambda t: t <> '') AS p, list_filter(string_split(gold, ' '), lambda t: t <> '') AS g FROM p JOIN b ON doc_id % n = k),
tp AS (SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, unnest(list_filter(p, lambda w: list_contains(g, w))) AS w FROM j) GROUP BY ALL),
tg AS (SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, unnest(g) AS w FROM j) GROUP BY ALL),
shared AS (SELECT doc_id, sum(least(tp.c, tg.c)) AS n_shared FROM tp JOIN tg USING (doc_id, w) GROUP BY doc_id)
SELECT doc_id, (pred = gold)::DOUBLE AS em,
  round(CASE WHEN len(p) = 0 OR len(g) = 0 THEN (len(p) = 0 AND len(g) = 0)::DOUBLE ELSE 2.0 * coalesce(n_shared, 0) / (len(p) + len(g)) END, 6)::DOUBLE AS f1
FROM j LEFT JOIN shared USING (doc_id)""")
def pair_em_f1(spark, d):
    b = _t(spark, d, "benchmark")
    n = b.count()
    b = records.chunked(b, 1, "item_id").select(F.col("chunk").alias("k"), F.col("rows")[0]["text"].alias("gold"))
    docs = _t(spark, d, "documents").select("doc_id", "text", (F.col("doc_id") % n).alias("k"))
    m = S.pair_metrics(F.struct(F.col("text").alias("answer"), _no_conditions()), F.struct(F.col("gold").alias("answer"), _no_conditions()))
    return docs.join(b, "k").withColumn("m", m).select("doc_id", "m.em", F.round("m.f1", 6).alias("f1"))


@query(SQL["pair_em_f1"])
def pair_em_f1_sql(spark, d):
    """The pair metrics as SQL text over the session's functions."""
    sql.register(spark)
    b = _t(spark, d, "benchmark")
    gold = records.chunked(b, 1, "item_id").select(F.col("chunk").alias("k"), F.col("rows")[0]["text"].alias("gold"))
    text = "SELECT doc_id, answer_em(gold, text) AS em, round(answer_f1(gold, text), 6) AS f1 FROM {docs} JOIN {gold} ON doc_id % {n} = k"
    return spark.sql(text, docs=_t(spark, d, "documents"), gold=gold, n=b.count())


@query(SQL["norm_answer"])
def norm_answer_sql(spark, d):
    sql.register(spark)
    return spark.sql("SELECT item_id, normalized_answer(text) AS norm FROM {items}", items=_t(spark, d, "benchmark"))


@query("""
WITH p AS (SELECT p_partkey, string_split(p_name, ' ') AS c FROM part),
j AS (SELECT a.p_partkey, list_distinct(a.c) AS x, list_distinct(b.c) AS y FROM p a JOIN p b ON b.p_partkey = a.p_partkey + 1)
SELECT p_partkey, round(2.0 * len(list_intersect(x, y)) / (len(x) + len(y)), 6)::DOUBLE AS f1 FROM j""")
def condition_f1(spark, d):
    p = _t(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("x"))
    nxt = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("x").alias("y"))
    return p.join(nxt, "p_partkey").select("p_partkey", F.round(S.condition_f1(F.col("x"), F.col("y")), 6).alias("f1"))


def _turns(spark, d):
    """conv_id and the assistant's turns in order as answers."""
    c = _t(spark, d, "conversations").filter("role = 'assistant'")
    return c.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: F.struct(x["text"].alias("answer"), _no_conditions())).alias("a"))


@query(f"""
WITH a AS (SELECT conv_id, turn, {_norm('text')} AS n, {_tokens('text')} AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, count(*) OVER (PARTITION BY conv_id) - 1 AS preds FROM conversations WHERE role = 'assistant'),
j AS (SELECT p.conv_id, p.turn, p.n = r.n AS same, len(p.t) AS lp, len(r.t) AS lr, p.preds FROM a p JOIN a r ON p.conv_id = r.conv_id AND p.k > 1 AND r.k = 1),
w AS (SELECT conv_id, turn, k, w, count(*) AS c FROM (SELECT conv_id, turn, k, unnest(t) AS w FROM a) GROUP BY ALL),
shared AS (SELECT p.conv_id, p.turn, sum(least(p.c, r.c)) AS n_shared FROM w p JOIN w r ON p.conv_id = r.conv_id AND p.w = r.w AND p.k > 1 AND r.k = 1 GROUP BY ALL),
m AS (SELECT j.*, CASE WHEN lp = 0 OR lr = 0 THEN (lp = 0 AND lr = 0)::DOUBLE ELSE 2.0 * coalesce(n_shared, 0) / (lp + lr) END AS f1 FROM j LEFT JOIN shared USING (conv_id, turn))
SELECT conv_id, round(max(same::INT) * exp(1.0 - max(preds)), 6)::DOUBLE AS em, round(max(f1) * exp(1.0 - max(preds)), 6)::DOUBLE AS f1 FROM m GROUP BY conv_id""")
def best_match_single_ref(spark, d):
    t = _turns(spark, d).filter(F.size("a") > 1).select("conv_id", F.slice("a", 2, F.size("a") - 1).alias("p"), F.col("a")[0].alias("r"))
    return t.withColumn("m", S.best_for_one_reference(F.col("p"), F.col("r"))).select("conv_id", F.round("m.em", 6).alias("em"), F.round("m.f1", 6).alias("f1"))


@query(f"""
WITH a AS (SELECT conv_id, turn, {_norm('text')} AS n, {_tokens('text')} AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, count(*) OVER (PARTITION BY conv_id) - 2 AS preds FROM conversations WHERE role = 'assistant'),
x AS (SELECT conv_id, k, n, t, preds FROM a WHERE preds > 0 UNION ALL SELECT conv_id, 4, '', [], 1 FROM a WHERE preds = 1 AND k = 1),
w AS (SELECT conv_id, k, w, count(*) AS c FROM (SELECT conv_id, k, unnest(t) AS w FROM x) GROUP BY ALL),
shared AS (SELECT p.conv_id, p.k, r.k AS ref, sum(least(p.c, r.c)) AS n_shared FROM w p JOIN w r ON p.conv_id = r.conv_id AND p.w = r.w AND p.k > 2 AND r.k < 3 GROUP BY ALL),
m AS (SELECT p.conv_id, p.k, r.k AS ref, p.preds, (p.n = r.n)::INT AS em, CASE WHEN len(p.t) = 0 OR len(r.t) = 0 THEN (len(p.t) = 0 AND len(r.t) = 0)::DOUBLE ELSE 2.0 * coalesce(s.n_shared, 0) / (len(p.t) + len(r.t)) END AS f1
 FROM x p JOIN x r ON p.conv_id = r.conv_id AND p.k > 2 AND r.k < 3 LEFT JOIN shared s ON s.conv_id = p.conv_id AND s.k = p.k AND s.ref = r.k),
best AS (SELECT m.conv_id, max(m.em + o.em) / 2.0 * exp(1.0 - max(greatest(m.preds, 2)) / 2.0) AS em, max(m.f1 + o.f1) / 2.0 * exp(1.0 - max(greatest(m.preds, 2)) / 2.0) AS f1
 FROM m JOIN m o ON m.conv_id = o.conv_id AND m.k <> o.k AND m.ref = 1 AND o.ref = 2 GROUP BY m.conv_id)
SELECT conv_id, round(em, 6)::DOUBLE AS em, round(em, 6)::DOUBLE AS em_cond, round(f1, 6)::DOUBLE AS f1, round(f1, 6)::DOUBLE AS f1_cond FROM best""")
def assignment_multi_ref(spark, d):
    t = _turns(spark, d).filter(F.size("a") > 2).select("conv_id", F.slice("a", 3, F.size("a") - 2).alias("p"), F.slice("a", 1, 2).alias("r"))
    return S.answers_metrics(t, "p", "r").select("conv_id", *[F.round(m, 6).alias(m) for m in S.METRICS])


@query("""
WITH s AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'not_answerable' WHEN quality = 1 THEN 'yesno' ELSE 'value' END AS question_type, toxic = 1 AS conditional, (quality = 1 - toxic)::DOUBLE AS em, quality / 2.0::DOUBLE AS f1 FROM labels),
b AS (SELECT 'total' AS bucket, em, f1 FROM s UNION ALL SELECT question_type, em, f1 FROM s UNION ALL SELECT 'conditional', em, f1 FROM s WHERE conditional),
e AS (SELECT unnest(['total', 'yesno', 'value', 'not_answerable', 'conditional']) AS bucket)
SELECT bucket, count(em) AS n, round(coalesce(avg(em), 0), 6)::DOUBLE AS em, round(coalesce(avg(f1), 0), 6)::DOUBLE AS f1 FROM e LEFT JOIN b USING (bucket) GROUP BY bucket""")
def metric_buckets(spark, d):
    kind = F.when(F.col("doc_id") % 3 == 0, "not_answerable").when(F.col("quality") == 1, "yesno").otherwise("value")
    em, f1 = (F.col("quality") == 1 - F.col("toxic")).cast("double"), F.col("quality") / 2.0
    x = _t(spark, d, "labels").select(kind.alias("question_type"), (F.col("toxic") == 1).alias("conditional"), em.alias("em"), em.alias("em_cond"), f1.alias("f1"), f1.alias("f1_cond"))
    return S.metric_buckets(x).select("bucket", "n", F.round("em", 6).alias("em"), F.round("f1", 6).alias("f1"))


@query("""
WITH s AS (SELECT 'type' || doc_id % 3 AS question_type, toxic = 0 AS p, quality = 1 AS c FROM labels),
g AS (SELECT coalesce(question_type, 'total') AS bucket, count(*) FILTER (p AND c) AS tp, count(*) FILTER (p AND NOT c) AS fp, count(*) FILTER (NOT p AND c) AS fn, count(*) FILTER (NOT p AND NOT c) AS tn FROM s GROUP BY GROUPING SETS ((), (question_type))),
r AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp)::DOUBLE END AS p, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn)::DOUBLE END AS r FROM g)
SELECT bucket, tp, fp, fn, tn, round(p, 6)::DOUBLE AS precision, round(r, 6)::DOUBLE AS recall, round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 6)::DOUBLE AS f1 FROM r""")
def confusion_prf(spark, d):
    x = _t(spark, d, "labels").withColumn("question_type", F.concat(F.lit("type"), (F.col("doc_id") % 3).cast("string")))
    c = S.confusion(x, F.col("toxic") == 0, F.col("quality") == 1)
    return c.select("bucket", "tp", "fp", "fn", "tn", *[F.round(k, 6).alias(k) for k in ("precision", "recall", "f1")])


@query("""SELECT event_type AS question_type, count(*) AS total, count(*) FILTER (value < 40) AS entailed, count(*) FILTER (value >= 40 AND value < 80) AS not_entailed, count(*) FILTER (value >= 80 OR value IS NULL) AS error FROM events GROUP BY event_type""")
def outcome_breakdown(spark, d):
    v = F.when(F.col("value") < 40, True).when(F.col("value") < 80, False)
    return S.outcome_breakdown(_t(spark, d, "events").select(F.col("event_type").alias("question_type"), v.alias("entails")))


def _verdicts(spark, d):
    o = _t(spark, d, "orders")
    entails = F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False)
    kind = F.element_at(F.array(F.lit("yesno"), F.lit("value"), F.lit("not_answerable")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return o.select("o_orderkey", "o_custkey", entails.alias("entails"), kind.alias("question_type"))


_VERDICT_SQL = "v AS (SELECT o_orderkey, o_custkey, CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS entails, ['yesno', 'value', 'not_answerable'][o_orderkey % 3 + 1] AS question_type FROM orders)"


@query(f"""
WITH {_VERDICT_SQL}, x AS (SELECT *, o_custkey % 2 = 0 AS context_found, CASE WHEN entails THEN 'yes' WHEN NOT entails THEN 'no' END AS predicted, CASE WHEN o_custkey % 3 = 0 THEN 'yes' ELSE 'no' END AS gold FROM v)
SELECT count(*) AS total, count(*) FILTER (context_found) AS context_found, count(*) FILTER (entails) AS entailed, count(*) FILTER (NOT entails) AS not_entailed, count(*) FILTER (entails IS NULL) AS undecided,
 count(*) FILTER (question_type = 'yesno') AS yesno, count(*) FILTER (question_type = 'yesno' AND predicted = gold) AS yesno_right,
 floor(100 * count(*) FILTER (question_type = 'yesno' AND predicted = gold) / count(*) FILTER (question_type = 'yesno'))::BIGINT AS yesno_percent,
 count(*) FILTER (question_type = 'value' AND entails) AS value_entailed, count(*) FILTER (question_type = 'not_answerable' AND NOT coalesce(entails, false)) AS rejected FROM x""")
def answer_summary(spark, d):
    x = _verdicts(spark, d).withColumn("context_found", F.col("o_custkey") % 2 == 0).withColumn("predicted", F.when(F.col("entails"), "yes").when(~F.col("entails"), "no")).withColumn("gold", F.when(F.col("o_custkey") % 3 == 0, "yes").otherwise("no"))
    return S.answer_summary(x)


@query(f"""WITH {_VERDICT_SQL}, x AS (SELECT *, CASE WHEN o_custkey % 4 = 0 THEN ['v' || o_custkey] ELSE [] END AS vals FROM v)
SELECT o_orderkey, question_type, array_to_string(CASE WHEN entails AND len(vals) > 0 THEN vals WHEN entails THEN ['yes'] WHEN NOT entails AND question_type = 'not_answerable' THEN ['not answerable'] WHEN NOT entails THEN ['no'] END, '|') AS predicted,
 CASE WHEN entails AND len(vals) > 0 THEN 1 WHEN entails THEN 1 WHEN NOT entails AND question_type <> 'not_answerable' THEN 1 ELSE 0 END::BIGINT AS n_answers FROM x""")
def verdict_to_prediction(spark, d):
    values = F.when(F.col("o_custkey") % 4 == 0, F.array(F.concat(F.lit("v"), F.col("o_custkey").cast("string")))).otherwise(F.array().cast("array<string>"))
    x = _verdicts(spark, d).withColumn("p", S.prediction(F.col("entails"), values, F.col("question_type")))
    return x.select("o_orderkey", "question_type", F.array_join("p", "|").alias("predicted"), F.size(S.as_answers(F.col("p"))).cast("long").alias("n_answers"))


def _gold(spark, d):
    """Labels as questions: answers from their flags, some of them words."""
    yes = lambda c, v: F.struct(F.when(F.col(c) == v, F.lit("Yes")).otherwise(F.lit(" no")).alias("answer"), F.when(F.col("toxic") == 1, F.array(F.lit("if"))).otherwise(F.array().cast("array<string>")).alias("conditions"))
    plain = lambda t: F.struct(F.lit(t).alias("answer"), _no_conditions())
    k = F.col("doc_id") % 5
    answers = F.when(k == 0, F.array(yes("quality", 1))).when(k == 1, F.array(yes("quality", 1), plain("yes"))).when(k == 2, F.array(plain("ten days"), yes("toxic", 1))).when(k == 3, F.array(plain("a form"))).otherwise(F.from_json(F.lit("[]"), S.ANSWERS))
    return _t(spark, d, "labels").select("doc_id", answers.alias("answers"), (k == 4).alias("not_answerable"))


_GOLD_SQL = """g AS (SELECT doc_id, doc_id % 5 AS k, toxic, CASE WHEN quality = 1 THEN 'Yes' ELSE ' no' END AS q, CASE WHEN toxic = 1 THEN 'Yes' ELSE ' no' END AS x FROM labels),
a AS (SELECT doc_id, k = 4 AS na, toxic, k, CASE k WHEN 0 THEN [q] WHEN 1 THEN [q, 'yes'] WHEN 2 THEN ['ten days', x] WHEN 3 THEN ['a form'] ELSE []::VARCHAR[] END AS l FROM g)"""


@query(f"""WITH {_GOLD_SQL}
SELECT doc_id, CASE WHEN na THEN 'not_answerable' WHEN len(l) > 0 AND len(list_filter(l, lambda v: lower(trim(v)) NOT IN ('yes', 'no'))) = 0 THEN 'yesno' ELSE 'value' END AS question_type,
 len(l) > 0 AND len(list_filter(l, lambda v: v IN ('yes', 'no'))) > 0 AS official_yesno, toxic = 1 AND k IN (0, 1, 2) AS conditional, coalesce(lower(l[1]) IN ('yes', 'no'), false) AS first_yesno FROM a""")
def question_type(spark, d):
    g, a = _gold(spark, d), F.col("answers")
    o = S.official_types(a)
    return g.select("doc_id", S.question_type(a, F.col("not_answerable")).alias("question_type"), o["yesno"].alias("official_yesno"), o["conditional"].alias("conditional"), S.first_is_yes_no(a).alias("first_yesno"))


@query(f"""WITH {_GOLD_SQL}
SELECT doc_id, CASE WHEN len(list_filter(l, lambda v: lower(trim(v)) = 'yes')) > 0 THEN 'yes' ELSE 'no' END AS any_yes, list_filter(list_transform(l, lambda v: lower(v)), lambda v: v IN ('yes', 'no'))[1] AS first_yes_no FROM a""")
def gold_yesno_variants(spark, d):
    return _gold(spark, d).select("doc_id", S.gold_any_yes(F.col("answers")).alias("any_yes"), S.gold_first_yes_no(F.col("answers")).alias("first_yes_no"))


@query(r"""WITH c AS (SELECT conv_id, turn, trim(lower(text)) AS t FROM conversations), w AS (SELECT *, left(t, 60) AS s, regexp_extract(t, '^\s*(\S*)', 1) AS f FROM c)
SELECT conv_id, turn, CASE WHEN regexp_matches(t, '(^|[^\p{L}\p{N}_])not[_\s]answerable($|[^\p{L}\p{N}_])') THEN 'not answerable'
 WHEN starts_with(t, 'yes') OR regexp_matches(s, '(^|[^\p{L}\p{N}_])yes($|[^\p{L}\p{N}_])') THEN 'yes' WHEN starts_with(t, 'no') OR regexp_matches(s, '(^|[^\p{L}\p{N}_])no($|[^\p{L}\p{N}_])') THEN 'no'
 WHEN contains(f, 'yes') THEN 'yes' WHEN contains(f, 'no') THEN 'no' ELSE 'not answerable' END AS parsed FROM w""")
def llm_parse(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", T.parsed_answer(F.col("text")).alias("parsed"))


# lookups and records


@query("SELECT source, max(doc_id) AS doc_id, max_by(lang, doc_id) AS lang FROM documents WHERE source <> '' GROUP BY source")
def context_last_wins(spark, d):
    return records.last_of_each(_t(spark, d, "documents").select("source", "doc_id", "lang"), "source", "doc_id")


@query("SELECT l.doc_id, d.lang, d.doc_id IS NOT NULL AS context_found, coalesce(d.source, '') AS source FROM labels l LEFT JOIN (SELECT * FROM documents WHERE lang = 'en') d USING (doc_id)")
def question_context_left_join(spark, d):
    url = F.col("doc_id").cast("string").alias("url")
    c = _t(spark, d, "documents").filter("lang = 'en'").select(url, F.lit(0).alias("ordinal"), "lang", "source")
    q = answering.with_context(_t(spark, d, "labels").select("doc_id", url), c, {"lang": "lang", "source": "source"})
    return q.select("doc_id", "lang", "context_found", F.coalesce("source", F.lit("")).alias("source"))


@query("""SELECT count(*) FILTER (l.doc_id IS NOT NULL AND d.doc_id IS NOT NULL) AS both, count(*) FILTER (d.doc_id IS NULL) AS only_a, count(*) FILTER (l.doc_id IS NULL) AS only_b
FROM (SELECT DISTINCT doc_id FROM labels) l FULL JOIN (SELECT DISTINCT doc_id FROM documents WHERE lang <> 'fr') d USING (doc_id)""")
def coverage_sets(spark, d):
    return S.coverage(_t(spark, d, "labels"), _t(spark, d, "documents").filter("lang <> 'fr'"), "doc_id")


@query("WITH r AS (SELECT item_id, (row_number() OVER (ORDER BY item_id) - 1) // 7 AS chunk FROM benchmark) SELECT chunk, count(*) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS ids FROM r GROUP BY chunk")
def chunk_batches(spark, d):
    c = records.chunked(_t(spark, d, "benchmark"), 7, "item_id")
    return c.select("chunk", F.size("rows").cast("long").alias("n"), F.array_join(F.transform("rows", lambda r: r["item_id"].cast("string")), ",").alias("ids"))


@query("WITH r AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 64 AS chunk FROM documents) SELECT chunk, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last, sum(doc_id)::BIGINT AS total FROM r GROUP BY chunk")
def chunk_batches_documents(spark, d):
    """Chunks of whole documents: every row is in one, and all but the last are full."""
    ids = lambda r: r["doc_id"]
    c = records.chunked(_t(spark, d, "documents"), 64, "doc_id").withColumn("ids", F.transform("rows", ids))
    return c.select("chunk", F.size("rows").cast("long").alias("n"), F.array_min("ids").alias("first"), F.array_max("ids").alias("last"), F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_remaining(spark, d):
    return records.remaining(_t(spark, d, "documents").select("doc_id", "lang"), _t(spark, d, "labels"), "doc_id")


@query("SELECT item_id, text FROM benchmark")
def kb_roundtrip(spark, d):
    """Records written indented with blank lines, and read back."""
    path = scratch_path(spark, "records")
    b = _t(spark, d, "benchmark").select("item_id", "text")
    records.write(b, path)
    return records.read(spark, path, "item_id long, text string")


@query("SELECT doc_id, text, lang FROM documents")
def crlf_records(spark, d):
    """Indented records in a file whose lines end in CR LF, written as such and read back."""
    path = scratch_path(spark, "records")
    x = _t(spark, d, "documents").select("doc_id", "text", "lang")
    lines = F.to_json(F.struct("*"), {"pretty": "true", "ignoreNullFields": "false"})
    x.select(F.replace(lines, F.lit("\n"), F.lit("\r\n")).alias("value")).write.option("lineSep", "\r\n\r\n").text(path)
    return records.read(spark, path, "doc_id long, text string, lang string")


# markup


@query(r"SELECT page_id, left(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), 3000) AS text FROM pages")
def strip_html_truncate(spark, d):
    return _t(spark, d, "pages").select("page_id", T.context_text(F.array("html")).alias("text"))


def _pages(spark, d):
    return _t(spark, d, "pages").select(F.col("page_id").alias("doc"), F.array("html").alias("contents"))


def _nodes(spark, d):
    """The outline of every page."""
    return H.outline(H.events(_t(spark, d, "pages").select(F.col("page_id").alias("doc"), "html"), "html"))


# what stands between the tags of kept elements, comments, scripts and styles left out
_ELEMENTS = r"""WITH clean AS (SELECT page_id, regexp_replace(html, '(?is)<!--.*?-->|<script.*?</script>|<style.*?</style>', ' ', 'g') AS html FROM pages),
e AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<(h[1-4]|p|li|table)[\s>]', 1)) AS tag, unnest(string_split_regex(html, '(?is)<(?:h[1-4]|p|li|table)[\s>]')[2:]) AS body, generate_subscripts(regexp_extract_all(html, '(?is)<(h[1-4]|p|li|table)[\s>]', 1), 1) AS k FROM clean)"""


@query(_ELEMENTS + """
SELECT page_id, count(*) FILTER (lower(tag) LIKE 'h%') AS n_sections, count(*) FILTER (lower(tag) = 'p') AS n_texts, count(*) FILTER (lower(tag) = 'table') AS n_tables FROM e GROUP BY page_id""")
def heading_outline(spark, d):
    of = lambda k: F.count_if(F.col("type") == k)
    return _nodes(spark, d).groupBy(F.col("doc").alias("page_id")).agg(of("section").alias("n_sections"), of("text").alias("n_texts"), of("table").alias("n_tables"))


@query(_ELEMENTS + """,
r AS (SELECT *, tag = 'li' AND coalesce(lag(tag) OVER (PARTITION BY page_id ORDER BY k), '') <> 'li' AS begins FROM e)
SELECT page_id, count(*) FILTER (tag = 'li') AS n_items, count(*) FILTER (begins) AS n_runs FROM r GROUP BY page_id""")
def list_runs(spark, d):
    lists = F.col("type") == "list"
    return _nodes(spark, d).groupBy(F.col("doc").alias("page_id")).agg(F.coalesce(F.sum(F.when(lists, F.size("items"))), F.lit(0)).cast("long").alias("n_items"), F.count_if(lists).alias("n_runs"))


@query("""SELECT n_regionkey AS region, '<p>' || n_regionkey || '</p><table><tr><th>Nation</th><th>Key</th></tr>' || string_agg('<tr><td>' || n_name || '</td><td>' || n_nationkey || '</td></tr>', '' ORDER BY n_nationkey) || '</table><p>end</p>' AS markup FROM nation GROUP BY n_regionkey""")
def bare_rows(spark, d):
    """Runs of bare rows between other lines as one table for each region."""
    n = _t(spark, d, "nation").groupBy("n_regionkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.concat(F.lit("<tr>"), x["n_name"], F.lit(" | "), x["n_nationkey"].cast("string"), F.lit("</tr>"))).alias("rows"))
    lines = F.concat(F.array(F.concat(F.lit("<p>"), F.col("n_regionkey").cast("string"), F.lit("</p>")), F.lit("<tr>Nation | Key</tr>")), F.col("rows"), F.array(F.lit("<p>end</p>")))
    return n.select(F.col("n_regionkey").alias("region"), F.array_join(H.joined_rows(lines), "").alias("markup"))


@query("""SELECT o_orderkey, o_orderkey % 3 = 0 AS row_line FROM orders""")
def row_lines(spark, d):
    line = F.when(F.col("o_orderkey") % 3 == 0, "  <TR class=x>a | b</TR>").when(F.col("o_orderkey") % 3 == 1, "<track>").otherwise("a <tr> b")
    return _t(spark, d, "orders").select("o_orderkey", T.is_row_line(line).alias("row_line"))


@query("""WITH s AS (SELECT s_suppkey, s_suppkey % 3 AS k FROM supplier)
SELECT s_suppkey, CASE k WHEN 0 THEN 'rule' ELSE 'list' END AS type, CASE k WHEN 0 THEN 'ANY' WHEN 1 THEN 'ALL' END AS operator, CASE k WHEN 0 THEN 'ELIGIBLE' END AS outcome,
 's' || s_suppkey AS items, CASE WHEN k < 2 THEN 'unless s' || s_suppkey || ' leaves' END AS exceptions FROM s""")
def bound_lists(spark, d):
    """A policy for each supplier: a list behind a rule, behind a plain sentence, or by itself."""
    k, name = F.col("s_suppkey") % 3, F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))
    intro = F.when(k == 0, "<p>You can apply if any of the following apply:</p>").when(k == 1, "<p>All of the following apply to shops:</p>")
    items = F.array(F.concat(F.lit("<li>"), name, F.lit("</li>")), F.when(k < 2, F.concat(F.lit("<li>unless "), name, F.lit(" leaves</li>"))))
    lines = F.array_compact(F.concat(F.array(F.lit("<h1>Shops</h1>"), intro), items))
    nodes = H.semantic_tree(_t(spark, d, "supplier").select(F.col("s_suppkey").alias("doc"), lines.alias("contents")))
    return nodes.filter(F.col("items").isNotNull()).select(F.col("doc").alias("s_suppkey"), "type", "operator", "outcome", F.array_join("items", "|").alias("items"), F.array_join("exceptions", "|").alias("exceptions"))


@query("""SELECT c_custkey, '# Customer ' || c_custkey || E'\nLives here.\n## Nation\n- n' || c_nationkey || E'\n- key ' || c_custkey AS text FROM customer""")
def rendered_pages(spark, d):
    """A page for each customer: title, text, a section with a list."""
    s = lambda c: F.col(c).cast("string")
    lines = F.array(F.concat(F.lit("<h1>Customer "), s("c_custkey"), F.lit("</h1>")), F.lit("<p>Lives here.</p>"), F.lit("<h2>Nation</h2>"), F.concat(F.lit("<li>n"), s("c_nationkey"), F.lit("</li>")), F.concat(F.lit("<li>key "), s("c_custkey"), F.lit("</li>")))
    t = H.rendered(H.semantic_tree(_t(spark, d, "customer").select(F.col("c_custkey").alias("doc"), lines.alias("contents"))))
    return t.select(F.col("doc").alias("c_custkey"), F.regexp_replace("text", "(?m)^ +", "").alias("text"))


@query(r"""WITH s AS (SELECT doc_id, lower(text) AS t FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(t, '(?s)\b(either of the following apply|any of the following apply|one of the following)\b') THEN 'ANY' WHEN regexp_matches(t, '(?s)\b(all of the following apply|both of the following apply)\b') THEN 'ALL' END AS operator,
 regexp_matches(t, '\b(you can (only )?make a new claim|you can claim|you can apply)\b') OR regexp_matches(t, '(usually,\s*)?you will not|get .* if|cannot\b') AS rule, CASE WHEN regexp_matches(t, '(usually,\s*)?you will not|get .* if|cannot\b') THEN 'NOT_ELIGIBLE' ELSE 'ELIGIBLE' END AS outcome, regexp_matches(t, '\b(unless|except)\b') AS exception FROM s""")
def semantic_rules(spark, d):
    t = F.col("text")
    return _t(spark, d, "documents").select("doc_id", T.list_operator(t).alias("operator"), T.is_rule_intro(t).alias("rule"), T.outcome(t).alias("outcome"), T.is_exception(t).alias("exception"))


@query()
def page_tree(spark, d):
    return H.semantic_tree(_pages(spark, d)).withColumn("rows", F.to_json("rows"))


@query()
def render_tree(spark, d):
    """Every page as text."""
    return H.rendered(H.semantic_tree(_pages(spark, d)))


# names and bridges


def _phrases(spark, d):
    """Distinct part names as predicates, in order of name."""
    names = _t(spark, d, "part").select(F.regexp_replace("p_name", " ", "_").alias("name")).distinct()
    return names.select(F.lit("parts").alias("kb"), "name", F.lit(2).alias("arity"), F.lit(0).alias("place"))


_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP_TOKENS) + "]"


@query(f"""WITH n AS (SELECT DISTINCT 'CanGet' || upper(p_name[1]) || replace(substr(p_name, 2), ' ', 'For') AS camel FROM part),
s AS (SELECT camel, lower(regexp_replace(regexp_replace(camel, '(.)([A-Z][a-z]+)', '\\1_\\2', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')) AS snake FROM n)
SELECT camel, snake, CASE WHEN len(list_filter(string_split(snake, '_'), lambda t: t <> '' AND NOT list_contains({_STOP}, t))) = 0 THEN snake ELSE array_to_string(list_filter(string_split(snake, '_'), lambda t: t <> '' AND NOT list_contains({_STOP}, t)), '_') END AS norm FROM s""")
def pred_from_phrase(spark, d):
    camel = F.concat(F.lit("CanGet"), F.upper(F.substring("p_name", 1, 1)), F.regexp_replace(F.expr("substring(p_name, 2)"), " ", "For"))
    n = _t(spark, d, "part").select(camel.alias("camel")).distinct().withColumn("snake", T.snake_case(F.col("camel")))
    return n.select("camel", "snake", T.normalized_name(F.col("snake")).alias("norm"))


@query("""WITH n AS (SELECT DISTINCT replace(p_name, ' ', '_') AS c FROM part) SELECT 'can_get_' || c AS name, c AS ctx_name FROM n""")
def normalized_bridge(spark, d):
    ctx = _phrases(spark, d)
    hyp = ctx.withColumn("name", F.concat(F.lit("can_get_"), F.col("name")))
    return B.normalized_matches(hyp, ctx).select("name", "ctx_name")


def _jaccard_sql(k: int, columns: str) -> str:
    return f"""WITH n AS (SELECT DISTINCT replace(p_name, ' ', '_') AS name FROM part), t AS (SELECT name, string_split(name, '_') AS t FROM n),
p AS (SELECT 'new_' || a.name AS name, b.name AS ctx_name, len(list_intersect(list_distinct('new' || a.t), list_distinct(b.t))) AS i, len(list_distinct(list_concat(['new'], a.t))) AS x, len(list_distinct(b.t)) AS y FROM (SELECT name, list_concat(['new'], t) AS t0, t FROM t) a, t b),
s AS (SELECT name, ctx_name, round(i / (x + y - i)::DOUBLE, 6)::DOUBLE AS score, i / (x + y - i)::DOUBLE AS s FROM p WHERE i / (x + y - i)::DOUBLE >= 0.2),
r AS (SELECT name, ctx_name, score, row_number() OVER (PARTITION BY name ORDER BY s DESC, ctx_name)::INT AS rank FROM s) SELECT {columns} FROM r WHERE rank <= {k}""".replace("list_intersect(list_distinct('new' || a.t), list_distinct(b.t))", "list_intersect(list_distinct(a.t0), list_distinct(b.t))")


def _jaccard(spark, d, k):
    ctx = _phrases(spark, d)
    return B.jaccard_matches(ctx.withColumn("name", F.concat(F.lit("new_"), F.col("name"))), ctx, 0.2, k)


@query(_jaccard_sql(1, "name, ctx_name, score"))
def jaccard_top1(spark, d):
    return _jaccard(spark, d, 1).select("name", "ctx_name", F.round("score", 6).alias("score"))


@query(_jaccard_sql(3, "name, ctx_name, score, rank"))
def jaccard_topk(spark, d):
    return _jaccard(spark, d, 3).select("name", "ctx_name", F.round("score", 6).alias("score"), "rank")


@query(_jaccard_sql(1, "name || '(_A0, _A1) :- ' || ctx_name || '(_A0, _A1).' AS rule"))
def bridge_rules(spark, d):
    return _jaccard(spark, d, 1).select(C.bridge_rule(F.col("name"), F.col("arity"), F.col("ctx_name"), F.col("ctx_arity")).alias("rule"))


@query("""WITH n AS (SELECT DISTINCT replace(p_name, ' ', '_') AS name FROM part)
SELECT name, E':- x.\\n' || name || E'(a).\\nheld_by(b).\\n\\n% --- aliases ---\\nholds(_A0, _A1) :- held_by(_A0).' AS program FROM n""")
def alias_bridges(spark, d):
    p = _phrases(spark, d).select("name", F.col("name").alias("kb"), F.concat(F.lit(":- x.\n"), F.col("name"), F.lit("(a).\nheld_by(b).")).alias("program"), F.lit("holds(me, X)").alias("goal"))
    block = F.struct(F.array(F.lit("held_by(b).")).alias("facts"), F.array().cast("array<string>").alias("rules"))
    none = F.lit(None).cast("array<struct<id:string,type:string,gloss:string>>")
    p = p.withColumn("context", block).withColumn("context_constants", none).withColumn("scenario_constants", none)
    return B.align(p, B.Alignment(aliases={"holds": "held_by"})).select("name", "program")


@query("""SELECT c_custkey, 'lives_in(' || CASE WHEN c_custkey % 2 = 0 THEN '_' ELSE 'c' || c_custkey END || ', n' || c_nationkey || ').' AS fact FROM customer""")
def typed_constants(spark, d):
    name = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    kinds = F.array(F.struct(name.alias("id"), F.when(F.col("c_custkey") % 2 == 0, "person").otherwise("object").alias("type"), F.lit("").alias("gloss")))
    fact = F.concat(F.lit("lives_in("), name, F.lit(", n"), F.col("c_nationkey").cast("string"), F.lit(")."))
    return _t(spark, d, "customer").select("c_custkey", C.fact_with_wildcards(fact, C.typed_constants(kinds)).alias("fact"))


@query("SELECT DISTINCT replace(p_name, ' ', '_') AS name FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_size < 2)")
def undefined_predicates(spark, d):
    small = _t(spark, d, "part").filter("p_size < 2").select(F.lit("parts").alias("kb"), F.regexp_replace("p_name", " ", "_").alias("name"))
    return B.undefined(_phrases(spark, d), small).select("name")


# proofs


def _geography(spark, d) -> DataFrame:
    """Who lives in which nation and which nation is part of which region, as facts."""
    s = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    fact = lambda df, pred, a, b: df.select(F.lit("world").alias("kb"), F.lit(pred).alias("pred"), F.lit(2).alias("arity"), F.array(a, b).alias("args"))
    people = fact(_t(spark, d, "customer"), "lives_in", s("c", "c_custkey"), s("n", "c_nationkey"))
    firms = fact(_t(spark, d, "supplier"), "sells_in", s("s", "s_suppkey"), s("n", "s_nationkey"))
    nations = fact(_t(spark, d, "nation"), "part_of", s("n", "n_nationkey"), s("r", "n_regionkey"))
    return people.unionByName(firms).unionByName(nations)


_L = X.Literal
_IN_REGION = X.Rule(_L("in_region", ("C", "R")), (_L("lives_in", ("C", "N")), _L("part_of", ("N", "R"))))
_SELLS = X.Rule(_L("sells_in_region", ("S", "R")), (_L("sells_in", ("S", "N")), _L("part_of", ("N", "R"))))


def _region_goals(spark, d) -> DataFrame:
    c = _t(spark, d, "customer")
    return c.select("c_custkey", F.lit("world").alias("kb"), F.lit("in_region").alias("pred"), F.lit(2).alias("arity"), F.array(F.concat(F.lit("c"), F.col("c_custkey").cast("string")), F.concat(F.lit("r"), (F.col("c_custkey") % 5).cast("string"))).alias("args"))


@query("SELECT c_custkey, c_custkey % 5 AS region, n_regionkey = c_custkey % 5 AS entails FROM customer JOIN nation ON c_nationkey = n_nationkey")
def entail_ground(spark, d):
    facts = X.closure(_geography(spark, d), [_IN_REGION]).filter("pred = 'in_region'")
    return X.entailed(_region_goals(spark, d), facts).select("c_custkey", (F.col("c_custkey") % 5).alias("region"), "entails")


@query("""WITH s AS (SELECT c_custkey, n_regionkey = c_custkey % 5 AS right_ FROM customer JOIN nation ON c_nationkey = n_nationkey),
x AS (SELECT CASE WHEN right_ = (c_custkey % 2 = 0) THEN 1.0 ELSE 0.0 END AS em FROM s), b AS (SELECT unnest(['total', 'yesno', 'value', 'not_answerable', 'conditional']) AS bucket)
SELECT bucket, CASE WHEN bucket IN ('total', 'yesno') THEN count(em) ELSE 0 END AS n, CASE WHEN bucket IN ('total', 'yesno') THEN round(avg(em), 6) ELSE 0 END::DOUBLE AS em FROM b, x GROUP BY bucket""")
def entail_scored(spark, d):
    """Is each customer in a region? Answered by a rule, and scored against yes for every other customer."""
    facts = X.closure(_geography(spark, d), [_IN_REGION]).filter("pred = 'in_region'")
    v = X.entailed(_region_goals(spark, d), facts)
    predicted = S.as_answers(S.prediction(F.col("entails"), F.array().cast("array<string>"), F.lit("yesno")))
    gold = F.struct(F.when(F.col("c_custkey") % 2 == 0, "yes").otherwise("no").alias("answer"), _no_conditions())
    m = v.withColumn("m", S.best_for_one_reference(predicted, gold)).select(F.lit("yesno").alias("question_type"), F.lit(False).alias("conditional"), "m.*")
    return S.metric_buckets(m).select("bucket", "n", F.round("em", 6).alias("em"))


@query("""WITH big AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity >= 45), open AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O')
SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM open JOIN big ON o_orderkey = l_orderkey) AS entails FROM customer""")
def entail_rules(spark, d):
    s = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    fact = lambda df, pred, *a: df.select(F.lit("shop").alias("kb"), F.lit(pred).alias("pred"), F.lit(len(a)).alias("arity"), F.array(*a).alias("args"))
    o = _t(spark, d, "orders")
    facts = fact(o, "placed", s("c", "o_custkey"), s("o", "o_orderkey")).unionByName(fact(o.filter("o_orderstatus = 'O'"), "open", s("o", "o_orderkey"))).unionByName(fact(_t(spark, d, "lineitem").filter("l_quantity >= 45").select("l_orderkey").distinct(), "big", s("o", "l_orderkey")))
    rule = X.Rule(_L("eligible", ("C",)), (_L("placed", ("C", "O")), _L("open", ("O",)), _L("big", ("O",))))
    goals = _t(spark, d, "customer").select("c_custkey", F.lit("shop").alias("kb"), F.lit("eligible").alias("pred"), F.lit(1).alias("arity"), F.array(s("c", "c_custkey")).alias("args"))
    return X.entailed(goals, X.closure(facts, [rule]).filter("pred = 'eligible'")).select("c_custkey", "entails")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 200000)")
def entail_negation(spark, d):
    s = lambda c: F.array(F.col(c).cast("string"))
    fact = lambda df, pred, a: df.select(F.lit("shop").alias("kb"), F.lit(pred).alias("pred"), F.lit(1).alias("arity"), a.alias("args"))
    facts = fact(_t(spark, d, "customer"), "customer", s("c_custkey")).unionByName(fact(_t(spark, d, "orders").filter("o_orderstatus = 'P' and o_totalprice > 200000").select("o_custkey").distinct(), "buyer", s("o_custkey")))
    rule = X.Rule(_L("idle", ("C",)), (_L("customer", ("C",)), _L("buyer", ("C",), negated=True)))
    return X.closure(facts, [rule]).filter("pred = 'idle'").select(F.col("args")[0].cast("long").alias("c_custkey"))


@query("""WITH RECURSIVE e AS (SELECT conv_id, turn AS a, turn - 1 AS b FROM conversations WHERE turn > 0), r AS (SELECT * FROM e UNION SELECT e.conv_id, e.a, r.b FROM e JOIN r ON e.conv_id = r.conv_id AND e.b = r.a) SELECT conv_id, a, b FROM r""")
def entail_recursive(spark, d):
    """Which turn of a conversation answers, directly or not, which."""
    t = _t(spark, d, "conversations").filter("turn > 0")
    facts = t.select(F.col("conv_id").cast("string").alias("kb"), F.lit("replies").alias("pred"), F.lit(2).alias("arity"), F.array(F.col("turn").cast("string"), (F.col("turn") - 1).cast("string")).alias("args"))
    rules = [X.Rule(_L("follows", ("A", "B")), (_L("replies", ("A", "B")),)), X.Rule(_L("follows", ("A", "C")), (_L("replies", ("A", "B")), _L("follows", ("B", "C"))))]
    out = X.closure(facts, rules).filter("pred = 'follows'")
    return out.select(F.col("kb").cast("long").alias("conv_id"), F.col("args")[0].cast("long").alias("a"), F.col("args")[1].cast("long").alias("b"))


@query("""SELECT r_regionkey AS region, string_agg(DISTINCT 's' || s_suppkey, ',' ORDER BY 's' || s_suppkey) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey""")
def goal_bindings(spark, d):
    facts = X.closure(_geography(spark, d), [_SELLS]).filter("pred = 'sells_in_region'")
    by_region = facts.select(F.col("args")[1].alias("kb"), "pred", "arity", "args")
    b = X.bindings(by_region, _L("sells_in_region", ("S", "_")))
    return b.select(F.substring("kb", 2, 9).cast("int").alias("region"), F.array_join("values", ",").alias("suppliers"))


@query("""SELECT n_nationkey, 'lives_in_nation(X, ' || lower(r_name) || ', ' || lower(n_name) || ')' AS goal FROM nation JOIN region ON n_regionkey = r_regionkey""")
def fol_to_goal(spark, d):
    n = _t(spark, d, "nation").join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    h = F.concat(F.lit("Exists(x) LivesInNation(x, "), F.lower("r_name"), F.lit(", "), F.lower("n_name"), F.lit(")"))
    return n.select("n_nationkey", T.fol_goal(h).alias("goal"))


_LEMMAS = [("die", "verb", "die.v", 1), ("drown", "verb", "drown.v", 1), ("kill", "verb", "kill.v", 1), ("murder", "verb", "murder.v", 1), ("sleep", "verb", "sleep.v", 1), ("snore", "verb", "snore.v", 1), ("change", "verb", "change.v", 1)]
_EDGES = [("drown.v", "die.v", "hypernym"), ("die.v", "change.v", "hypernym"), ("murder.v", "kill.v", "hypernym"), ("kill.v", "die.v", "cause"), ("snore.v", "sleep.v", "entailment")]


@query("""WITH s(general, specific, score) AS (VALUES ('die', 'die', 1.0), ('die', 'drown', 0.8), ('change', 'drown', 0.6), ('change', 'die', 0.8), ('die', 'kill', 0.9), ('die', 'murder', 0.72), ('kill', 'murder', 0.8), ('sleep', 'snore', 0.9)),
w AS (SELECT unnest(['die', 'drown', 'kill', 'murder', 'sleep', 'snore', 'change']) AS w)
SELECT a.w AS general, b.w AS specific, CASE WHEN a.w = b.w THEN 1.0 ELSE coalesce(s.score, 0.0) END::DOUBLE AS score FROM w a CROSS JOIN w b LEFT JOIN s ON s.general = a.w AND s.specific = b.w""")
def hypernym_score(spark, d):
    lemmas = spark.createDataFrame(_LEMMAS, "lemma string, pos string, synset string, rank int")
    edges = spark.createDataFrame(_EDGES, "src string, dst string, kind string")
    words = [x[0] for x in _LEMMAS]
    pairs = spark.createDataFrame([(a, b) for a in words for b in words], "general string, specific string")
    return B.entailment_scores(pairs, lemmas, edges).select("general", "specific", F.round("score", 6).alias("score"))


@query("""WITH near AS (SELECT s_suppkey, i, n.n_name AS ctx, n.n_regionkey AS r, h.n_regionkey AS want FROM supplier, range(3) t(i) JOIN nation n ON n.n_nationkey = (s_nationkey + i) % 25 JOIN nation h ON h.n_nationkey = (s_nationkey + 1) % 25)
SELECT s_suppkey, min_by(regexp_replace(lower(ctx), '[ _]', '', 'g'), i) AS nation, regexp_replace(lower(any_value(r_name)), '[ _]', '', 'g') AS region, 0.8::DOUBLE AS score FROM near JOIN region ON r_regionkey = want WHERE r = want GROUP BY s_suppkey""")
def semantic_bridges(spark, d):
    """Which of three nations stands for a region, for each supplier a vocabulary of its own, by a hierarchy of places."""
    word = lambda c: F.regexp_replace(F.lower(c), "[ _]", "")
    n, r = _t(spark, d, "nation"), _t(spark, d, "region")
    names = n.select(word("n_name").alias("lemma"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("synset")).unionByName(r.select(word("r_name").alias("lemma"), F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("synset")))
    lemmas = names.select("lemma", F.lit("noun").alias("pos"), "synset", F.lit(1).alias("rank"))
    edges = n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("src"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("dst"), F.lit("hypernym").alias("kind"))
    s = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("kb"), "s_nationkey")
    near = s.select("kb", "s_nationkey", F.explode(F.array(*map(F.lit, range(3)))).alias("place"))
    ctx = near.join(n, F.col("n_nationkey") == (F.col("s_nationkey") + F.col("place")) % 25).select("kb", word("n_name").alias("name"), F.lit(1).alias("arity"), "place")
    home = s.join(n, F.col("n_nationkey") == (F.col("s_nationkey") + 1) % 25).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    hyp = home.select("kb", F.concat(F.lit("can_be_"), word("r_name")).alias("name"), F.lit(1).alias("arity"), F.lit(0).alias("place"))
    m = B.semantic_matches(hyp, ctx, lemmas, edges)
    return m.select(F.col("kb").alias("s_suppkey"), F.col("ctx_name").alias("nation"), F.substring("name", 8, 99).alias("region"), F.round("score", 6).alias("score"))


@query("""SELECT n_nationkey, n_regionkey <> 1 AS entails, CASE WHEN n_regionkey <> 1 THEN 'r' || n_regionkey ELSE '' END AS found, NULL::VARCHAR AS error FROM nation""")
def prover_answers(spark, d):
    """One small program for each nation, with compound terms and negation, proved by search."""
    n = _t(spark, d, "nation")
    name = F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))
    facts = F.array(F.concat(F.lit("home(at("), name, F.lit(", r"), F.col("n_regionkey").cast("string"), F.lit("))")))
    scenario = F.struct(F.array(F.lit("adult(Person)")).alias("facts"), F.array(F.lit("abroad(X) :- adult(me), home(at(_, X)), \\+ X = r1")).alias("rules"), F.array().cast("array<string>").alias("optional_rules"))
    context = F.struct(facts.alias("facts"), F.array().cast("array<string>").alias("rules"), F.array().cast("array<string>").alias("optional_rules"))
    return prover.answered(n.select("n_nationkey", C.program(context, scenario).alias("program"), F.lit("?- abroad(X).").alias("goal"))).select("n_nationkey", "entails", F.array_join("values", ",").alias("found"), "error")


@query("""WITH c AS (SELECT c_custkey, c_nationkey, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey), p AS (SELECT * FROM c, (SELECT unnest([0, 1, 2, 3]) AS k))
SELECT c_custkey, CASE k WHEN 0 THEN 'c' || c_custkey WHEN 1 THEN 'n' || c_nationkey WHEN 2 THEN 'r' || c_custkey % 5 ELSE 'world' END AS general, CASE k WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN CASE WHEN n_regionkey = c_custkey % 5 THEN 2 END ELSE NULL END AS depth FROM p""")
def hyponym_depths(spark, d):
    """How far below itself, its nation, some region and the world a customer is, looking two steps down."""
    s = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edge = lambda df, a, b: df.select(a.alias("src"), b.alias("dst"), F.lit("hypernym").alias("kind"))
    c, n = _t(spark, d, "customer"), _t(spark, d, "nation")
    edges = edge(c, s("c", "c_custkey"), s("n", "c_nationkey")).unionByName(edge(n, s("n", "n_nationkey"), s("r", "n_regionkey"))).unionByName(edge(n, s("r", "n_regionkey"), F.lit("world"))).distinct()
    generals = F.explode(F.array(s("c", "c_custkey"), s("n", "c_nationkey"), F.concat(F.lit("r"), (F.col("c_custkey") % 5).cast("string")), F.lit("world")))
    pairs = c.select("c_custkey", generals.alias("general"), s("c", "c_custkey").alias("specific"))
    return B.hyponym_depths(pairs, edges, 2).select("c_custkey", "general", "depth")


# prompts


@query(r"""SELECT doc_id, '### Item ' || doc_id || E'\n\n' || CASE WHEN lang <> 'en' THEN E'Known predicates:\n- written_in/2 — ' || lang || E'\n\n' ELSE '' END || E'Text:\n' || trim(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS prompt FROM documents""")
def prompt_blocks(spark, d):
    known = F.when(F.col("lang") != "en", P.predicate_lines(F.array(F.struct(F.lit("written_in").alias("name"), F.lit(2).alias("arity"), F.col("lang").alias("gloss"))))).otherwise("")
    return _t(spark, d, "documents").select("doc_id", P.prompt_block(F.col("doc_id"), T.without_tags(F.col("text")), predicates=known).alias("prompt"))


@query(f"""SELECT conv_id, turn, '{P.SYSTEM_ANSWER}' AS system, E'Policy:\\n' || role || E'\\n\\nQuestion:\\n' || conv_id || E'\\n' || text AS question, 2::BIGINT AS n FROM conversations""")
def chat_messages(spark, d):
    m = P.chat_messages(F.col("role"), F.col("conv_id").cast("string"), F.col("text"))
    return _t(spark, d, "conversations").withColumn("m", m).select("conv_id", "turn", F.col("m")[0]["content"].alias("system"), F.col("m")[1]["content"].alias("question"), F.size("m").cast("long").alias("n"))


# runs and their parts


_SOURCES_SQL = "s AS (SELECT source, max(doc_id) AS doc_id, max_by(lang, doc_id) AS lang FROM documents WHERE source <> '' GROUP BY source)"


@query(f"""WITH {_SOURCES_SQL}, t AS (SELECT * FROM documents WHERE doc_id % 2 = 0 AND trim(text, ' ') <> '')
SELECT t.doc_id::VARCHAR AS id, (row_number() OVER (ORDER BY t.doc_id) - 1)::BIGINT AS index, length(trim(text, ' '))::BIGINT AS chars, CASE WHEN s.source IS NULL THEN '' ELSE '- last/1 — ' || s.lang END AS predicates, CASE WHEN s.source IS NULL THEN '' ELSE 'last(' || s.doc_id || E').\\nused(' || s.lang || ').' END AS rules, CASE WHEN s.source IS NULL THEN '' ELSE '- d' || s.doc_id || ' — ' || s.lang || ' (type: unknown)' END AS constants
FROM t LEFT JOIN s ON t.source = s.source""")
def job_rows(spark, d):
    """A job for every second document, with what is known of its source from the source's last document."""
    docs = _t(spark, d, "documents")
    kbs = docs.select(F.col("source").alias("url"), F.col("doc_id").alias("ordinal"), F.col("doc_id").cast("string").alias("k"), F.col("lang"))
    predicates = P.predicate_lines(F.array(F.struct(F.lit("last").alias("name"), F.lit(1).alias("arity"), F.col("lang").alias("gloss"))))
    constants = P.constant_lines(F.array(F.struct(F.concat(F.lit("d"), F.col("k")).alias("id"), F.lit(None).cast("string").alias("type"), F.col("lang").alias("gloss"))))
    rules = F.array_join(F.array(F.concat(F.lit("last("), F.col("k"), F.lit(").")), F.concat(F.lit("used("), F.col("lang"), F.lit(")."))), "\n")
    contexts = [P.context_strings(kbs, v, n) for n, v in (("predicates", predicates), ("constants", constants), ("rules", rules))]
    samples = docs.select("doc_id", F.col("doc_id").cast("string").alias("id"), F.col("source").alias("url"), F.array("text").alias("contents"))
    jobs = P.jobs(samples, P.extractor("context", "contents"), "doc_id", *contexts, where=F.col("doc_id") % 2 == 0)
    return jobs.select("id", "index", F.length("input_text").cast("long").alias("chars"), "predicates", "rules", "constants")


@query(r"""SELECT conv_id, turn, CASE WHEN trim(text, ' ') <> '' AND turn % 2 = 0 THEN role || E'\n\n' || trim(text, ' ') END AS asked, CASE turn % 3 WHEN 0 THEN role || E'\n- ' || turn ELSE nullif(trim(text, ' '), '') END AS tree FROM conversations""")
def sample_texts(spark, d):
    """Texts of samples: scenario and question, and a tree with the contents behind it."""
    c = _t(spark, d, "conversations")
    tree = F.when(F.col("turn") % 3 == 0, F.concat(F.col("role"), F.lit("\n  \n- "), F.col("turn").cast("string"), F.lit("\n"))).otherwise(F.lit(" \n"))
    return c.select("conv_id", "turn", P.question_text(F.when(F.col("turn") % 2 == 0, F.col("role")).otherwise(F.lit(" ")), F.col("text")).alias("asked"), P.tree_text(tree, F.array("text")).alias("tree"))


_FEW = " || '|' || ".join(["''", *["'" + f"Policy:\n{c}\n\nQuestion:\n{q}|{a}".replace("'", "''") + "'" for c, q, a in P.EXAMPLES]])


@query(f"""SELECT DISTINCT role, {_FEW.replace(chr(10), chr(10))}::VARCHAR AS shown, {2 + 2 * len(P.EXAMPLES)}::BIGINT AS n FROM conversations""")
def few_shot_turns(spark, d):
    m = P.chat_messages(F.col("role"), F.lit(""), F.col("role"), few_shot=True)
    shown = F.array_join(F.transform(F.slice("m", 2, F.size("m") - 2), lambda x: x["content"]), "|")
    return _t(spark, d, "conversations").select("role").distinct().withColumn("m", m).select("role", F.concat(F.lit("|"), shown).alias("shown"), F.size("m").cast("long").alias("n"))


@query("SELECT l_returnflag, round(100.0 * avg(l_discount), 1) AS value, format('{:.1f}%', round(100.0 * avg(l_discount), 6)) AS shown FROM lineitem GROUP BY l_returnflag")
def percentages(spark, d):
    x = _t(spark, d, "lineitem").groupBy("l_returnflag").agg(F.avg("l_discount").alias("v"))
    return x.select("l_returnflag", F.round(100 * F.col("v"), 1).alias("value"), T.percent(F.round("v", 8)).alias("shown"))


@query("""SELECT p_partkey, (p_size % 4)::BIGINT AS commas, CASE WHEN p_size % 4 = 0 THEN 1 ELSE 1 + p_size % 4 END::BIGINT AS arity FROM part""")
def top_level_commas(spark, d):
    k = (F.col("p_size") % 4).cast("int")
    args = F.concat(F.lit("f(a, g(b, c))"), F.repeat(F.concat(F.lit(", h("), F.col("p_partkey").cast("string"), F.lit(", x)")), k))
    return _t(spark, d, "part").select("p_partkey", C.top_level_commas(args).cast("long").alias("commas"), C.arity(args).cast("long").alias("arity"))


@query("""SELECT c_custkey, 'lives_in/2,owes/1' || CASE WHEN c_custkey % 2 = 0 THEN ',rich/0' ELSE '' END || ',knows/' || (1 + c_custkey % 2) AS heads FROM customer""")
def block_heads(spark, d):
    """Heads of a block's facts and rules; of one name with two arities the last counts, at the place of the first."""
    key = F.col("c_custkey").cast("string")
    rich = F.when(F.col("c_custkey") % 2 == 0, F.lit("rich :- owes(x)."))
    block = F.struct(F.array_compact(F.array(F.concat(F.lit("lives_in(c"), key, F.lit(", n).")), F.lit("owes(x)."), rich)).alias("facts"), F.array(F.lit("knows(X, Y, Z) :- owes(X)."), F.when(F.col("c_custkey") % 2 == 1, "knows(X, f(Y, Z)) :- owes(X).").otherwise("knows(X) :- owes(X).")).alias("rules"))
    heads = F.array_join(F.transform(C.block_predicates(block), lambda p: F.concat(p["name"], F.lit("/"), p["arity"].cast("string"))), ",")
    return _t(spark, d, "customer").select("c_custkey", heads.alias("heads"))


@query("""SELECT c_custkey, 'lives_in(' || CASE WHEN c_custkey % 2 = 0 THEN '_' ELSE 'c' || c_custkey END || ', n' || c_nationkey || '), owes(c' || c_custkey || ', X)' AS goal FROM customer""")
def goal_wildcards(spark, d):
    name = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    goal = F.concat(F.lit("lives_in("), name, F.lit(", n"), F.col("c_nationkey").cast("string"), F.lit("), owes("), name, F.lit(", X)"))
    only = F.array(F.struct(F.lit("lives_in").alias("name"), F.lit(2).alias("arity")))
    return _t(spark, d, "customer").select("c_custkey", C.goal_with_wildcards(goal, F.when(F.col("c_custkey") % 2 == 0, F.array(name)).otherwise(F.array(F.lit("other"))), only).alias("goal"))


@query("""SELECT s_suppkey, E':- set_prolog_flag(unknown, fail).\\n:- use_module(library(lists)).\\n' || CASE WHEN s_suppkey % 2 = 0 THEN E'\\n% --- context KB ---\\nsells(s' || s_suppkey || E').\\n% optional: maybe.\\n' ELSE '' END || E'\\n% --- scenario KB ---\\nhome(n' || s_nationkey || E').\\nok(X) :- sells(X).' AS program, 'ok(X), home(Y, X)' AS goal, 'X,Y' AS variables FROM supplier""")
def merged_programs(spark, d):
    """Programs of two blocks, cleaned goals and their variables."""
    none = F.array().cast("array<string>")
    s = lambda c: F.col(c).cast("string")
    context = F.when(F.col("s_suppkey") % 2 == 0, F.struct(F.array(F.concat(F.lit("sells(s"), s("s_suppkey"), F.lit(")"))).alias("facts"), F.array(F.lit("  ")).alias("rules"), F.array(F.lit("maybe")).alias("optional_rules")))
    scenario = F.struct(F.array(F.concat(F.lit("home(n"), s("s_nationkey"), F.lit(")."))).alias("facts"), F.array(F.lit("ok(X) :- sells(X)")).alias("rules"), none.alias("optional_rules"))
    goal = T.clean_goal(F.concat(F.lit("?- ok(X), home(Y, X).. % of s"), s("s_suppkey")))
    return _t(spark, d, "supplier").select("s_suppkey", C.program(context, scenario).alias("program"), goal.alias("goal"), F.array_join(T.goal_variables(goal), ",").alias("variables"))


@query("""WITH q AS (SELECT s_suppkey, s_nationkey, n_regionkey, s_suppkey % 3 AS k FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_nationkey % 2 = 0)
SELECT s_suppkey AS id, n_regionkey IS NOT NULL AS context_found, CASE k WHEN 0 THEN 'yesno' WHEN 1 THEN 'value' ELSE 'not_answerable' END AS question_type,
 CASE k WHEN 0 THEN coalesce(n_regionkey, -1) = 2 WHEN 1 THEN n_regionkey IS NOT NULL ELSE false END AS entails,
 CASE WHEN k = 0 THEN CASE WHEN n_regionkey = 2 THEN 'yes' ELSE 'no' END WHEN k = 1 THEN coalesce('r' || n_regionkey, 'no') ELSE 'not answerable' END AS predicted FROM q""")
def proof_answers(spark, d):
    """Questions of suppliers answered from what their nation's page says; every second nation has a page, in two versions."""
    block = "struct<facts:array<string>,rules:array<string>,optional_rules:array<string>,hypothesis:string>"
    s = lambda c: F.col(c).cast("string")
    none, null = F.array().cast("array<string>"), F.lit(None).cast("string")
    make = lambda facts, rules, goal: F.struct(facts.alias("facts"), rules.alias("rules"), none.alias("optional_rules"), goal.alias("hypothesis")).cast(block)
    no_constants = F.lit(None).cast("array<struct<id:string,type:string,gloss:string>>")
    n = _t(spark, d, "nation").filter("n_nationkey % 2 = 0")
    page = lambda ordinal, fact: n.select(s("n_nationkey").alias("url"), F.lit(ordinal).alias("ordinal"), make(F.array(fact), none, null).alias("prolog"), no_constants.alias("constants"))
    pages = page(1, F.lit("lies_in(r9)")).unionByName(page(2, F.concat(F.lit("lies_in(r"), s("n_regionkey"), F.lit(")"))))
    k = F.col("s_suppkey") % 3
    goal = F.when(k == 0, "sells_in(r2)").when(k == 1, "sells_in(X)").otherwise("sells_in(r9)")
    answers = F.when(k == 0, F.array(F.struct(F.lit("yes").alias("answer"), none.alias("conditions")))).otherwise(F.array(F.struct(F.lit("r1").alias("answer"), none.alias("conditions"))))
    q = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), s("s_nationkey").alias("url"), F.lit("q").alias("question"), F.lit("s").alias("scenario"), answers.alias("answers"), (k == 2).alias("not_answerable"), make(none, F.array(F.lit("sells_in(X) :- lies_in(X)")), goal).alias("prolog"), F.struct(F.lit("").alias("hypothesis")).alias("fol"), no_constants.alias("constants"))
    return answering.answered_by_proof(q, pages).select("id", "context_found", "question_type", "entails", F.array_join("predicted", "|").alias("predicted"))


@query("""WITH v AS (SELECT s_suppkey, s_nationkey % 2 = 0 AS found, s_suppkey % 5 = 0 AS broken, s_nationkey % 4 = 0 AS right_ FROM supplier)
SELECT count(*) AS total, count(*) FILTER (found) AS context_found, count(*) FILTER (NOT broken AND found AND right_) AS entailed, count(*) FILTER (NOT broken AND NOT (found AND right_)) AS not_entailed, count(*) FILTER (broken) AS errors FROM v""")
def check_counts(spark, d):
    """Goals checked against pages, some of them broken, and the counts of the run."""
    block = "struct<facts:array<string>,rules:array<string>,optional_rules:array<string>,hypothesis:string>"
    none, null = F.array().cast("array<string>"), F.lit(None).cast("string")
    make = lambda facts, goal: F.struct(facts.alias("facts"), none.alias("rules"), none.alias("optional_rules"), goal.alias("hypothesis")).cast(block)
    pages = _t(spark, d, "nation").filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").cast("string").alias("url"), F.lit(1).alias("ordinal"), make(F.array(F.when(F.col("n_nationkey") % 4 == 0, "even(me)").otherwise("odd(me)")), null).alias("prolog"))
    goal = F.when(F.col("s_suppkey") % 5 == 0, "even(me").otherwise("")
    q = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("string").alias("url"), F.lit(False).alias("not_answerable"), F.from_json(F.lit("[]"), S.ANSWERS).alias("answers"), make(none, goal).alias("prolog"), F.struct(F.lit("Even(me)").alias("hypothesis")).alias("fol"))
    return S.check_summary(answering.checked(q, pages))


# programs as data: every customer is a knowledge base with rules of its own


def _customer_programs(spark, d, rules, goal):
    """kb columns, program and goal of each customer: its nation, that nation's region, its orders, and what ``rules`` adds."""
    s = lambda c: F.col(c).cast("string")
    orders = _t(spark, d, "orders").groupBy("o_custkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", F.lower("o_orderstatus").alias("status")))), lambda o: F.concat(F.lit("order(o"), o["o_orderkey"].cast("string"), F.lit(", "), o["status"], F.lit(")."))).alias("orders"))
    place = F.array(F.concat(F.lit("home(n"), s("c_nationkey"), F.lit(").")), F.concat(F.lit("part_of(n"), s("c_nationkey"), F.lit(", r"), s("n_regionkey"), F.lit(").")))
    x = _t(spark, d, "customer").join(_t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    lines = F.concat(place, F.coalesce("orders", F.array().cast("array<string>")), rules)
    return x.select("c_custkey", F.array_join(lines, "\n").alias("program"), goal.alias("goal"))


_PLACED_SQL = "c AS (SELECT c_custkey, c_nationkey, n_regionkey, c_custkey % 3 AS k FROM customer JOIN nation ON c_nationkey = n_nationkey), o AS (SELECT o_custkey AS c_custkey, o_orderkey, 'o' || o_orderkey AS name, lower(o_orderstatus) AS st FROM orders)"


@query(f"""WITH {_PLACED_SQL}
SELECT c_custkey, count(o_orderkey) > 0 AS entails, coalesce(string_agg(name, ',' ORDER BY o_orderkey), '') AS found
FROM c LEFT JOIN o ON o.c_custkey = c.c_custkey AND CASE k WHEN 0 THEN st = 'f' WHEN 1 THEN st = 'o' AND n_regionkey = 1 ELSE st <> 'f' END GROUP BY ALL""".replace("SELECT c_custkey, count", "SELECT c.c_custkey, count"))
def program_rules(spark, d):
    """Orders that each customer's own rules, under names of its own, call good."""
    key = F.col("c_custkey").cast("string")
    good = F.concat(F.lit("good_"), key)
    line = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    rules = F.when(F.col("c_custkey") % 3 == 0, F.array(line(good, "(X) :- order(X, f).")))
    rules = rules.when(F.col("c_custkey") % 3 == 1, F.array(line(good, "(X) :- order(X, o), open_", key, "."), line("open_", key, " :- home(N), part_of(N, r1).")))
    rules = rules.otherwise(F.array(line(good, "(X) :- order(X, S), \\+ bad_", key, "(S)."), line("bad_", key, "(f).")))
    x = programs.answered(_customer_programs(spark, d, rules, line("?- ", good, "(X).")))
    return x.select("c_custkey", "entails", F.array_join("values", ",").alias("found"))


@query(f"""WITH {_PLACED_SQL}, s AS (SELECT c.c_custkey, count(*) FILTER (st = 'o') > 0 AS late, count(*) FILTER (st = 'f') > 0 AS done FROM c LEFT JOIN o ON o.c_custkey = c.c_custkey GROUP BY ALL)
SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN NOT late END AS entails, CASE WHEN c_custkey % 4 = 0 THEN 'a predicate depends on its own negation' END AS error FROM s""")
def program_strata(spark, d):
    """Rules that negate each other, each customer in its own strata; every fourth in a circle, which ends nobody else's."""
    lines = lambda *x: F.array(*map(F.lit, x))
    straight = lines("late :- order(_, o).", "settled :- \\+ late.", "praised :- settled, \\+ blamed.", "blamed :- \\+ settled, order(_, f).")
    rules = F.when(F.col("c_custkey") % 4 == 0, lines("praised :- \\+ blamed.", "blamed :- order(_, _), \\+ praised.")).otherwise(straight)
    return programs.answered(_customer_programs(spark, d, rules, F.lit("praised"))).select("c_custkey", "entails", "error")


@query(f"""WITH {_PLACED_SQL}, found AS (SELECT c_custkey, 0 AS way, o_orderkey, name FROM o WHERE st = 'f' UNION ALL SELECT c_custkey, 1, o_orderkey, name FROM o)
SELECT c.c_custkey, count(found.name)::INT AS n, coalesce(string_agg(name, ',' ORDER BY way, o_orderkey), '') AS found FROM c LEFT JOIN found ON found.c_custkey = c.c_custkey GROUP BY ALL""")
def goal_bindings_ordered(spark, d):
    """Solutions in the order and number of their proofs: what two rules say is found twice, the first rule's first."""
    rules = F.array(F.lit("near(X) :- seen(X, f)."), F.lit("near(X) :- seen(X, _)."), F.lit("seen(X, S) :- order(X, S)."))
    x = programs.answered(_customer_programs(spark, d, rules, F.lit("near(X)")))
    return x.select("c_custkey", F.size("values").alias("n"), F.array_join("values", ",").alias("found"))


@query(f"""WITH {_PLACED_SQL}, w AS (SELECT *, (c_custkey % 2 = 0)::INT + (n_regionkey = 1)::INT + (c_custkey % 5 = 0)::INT AS n FROM c)
SELECT c_custkey, n > 0 AS entails, rtrim(repeat('[n' || c_nationkey || ',r' || n_regionkey || '] ', n)) AS found FROM w""")
def program_wildcards(spark, d):
    """Facts that hold for anything: a place or both may be open, and each that fits is a proof."""
    s = lambda c: F.col(c).cast("string")
    some = lambda when, *x: F.when(when, F.array(F.concat(*x))).otherwise(F.array().cast("array<string>"))
    rules = F.concat(
        some(F.col("c_custkey") % 2 == 0, F.lit("ships(n"), s("c_nationkey"), F.lit(", _).")), F.array(F.lit("ships(_, r1).")), some(F.col("c_custkey") % 5 == 0, F.lit("ships(_, _).")),
        F.array(F.lit("can(X, Y) :- ships(X, Y)."), F.lit("ok(N, R) :- can(N, R), home(N), part_of(N, R).")),
    )
    x = programs.answered(_customer_programs(spark, d, rules, F.lit("ok(X, Y)")))
    return x.select("c_custkey", "entails", F.array_join("values", " ").alias("found"))


@query(f"""WITH {_GOLD_SQL}, m AS (SELECT doc_id, k, toxic, len(l) > 0 AND len(list_filter(l, lambda v: v IN ('yes', 'no'))) > 0 AS yesno, len(l) > 0 AND len(list_filter(l, lambda v: v IN ('yes', 'no'))) = 0 AS extractive, toxic = 1 AND k IN (0, 1, 2) AS conditional,
 CASE k WHEN 0 THEN (q = 'Yes')::INT::DOUBLE WHEN 1 THEN 0.5 WHEN 2 THEN (x = 'Yes')::INT / 2.0 ELSE 0.0 END AS em, CASE k WHEN 0 THEN (q = 'Yes' AND toxic = 0)::INT::DOUBLE WHEN 1 THEN 0.5 ELSE 0.0 END AS em_cond FROM g JOIN a USING (doc_id, k, toxic)),
b AS (SELECT 'total' AS bucket, * FROM m UNION ALL SELECT 'yesno', * FROM m WHERE yesno UNION ALL SELECT 'extractive', * FROM m WHERE extractive UNION ALL SELECT 'conditional', * FROM m WHERE conditional)
SELECT bucket, count(*) AS n, round(avg(em), 6)::DOUBLE AS em, round(avg(em_cond), 6)::DOUBLE AS em_cond, round(avg(em), 6)::DOUBLE AS f1, round(avg(em_cond), 6)::DOUBLE AS f1_cond FROM b GROUP BY bucket""")
def official_run(spark, d):
    """Every label as a question that is answered by yes: gold drives, and of two versions of gold and prediction the last counts."""
    g = _gold(spark, d).select(F.col("doc_id").alias("id"), "answers")
    old = g.withColumn("answers", F.from_json(F.lit("[]"), S.ANSWERS)).withColumn("ordinal", F.lit(1))
    gold = old.unionByName(g.withColumn("ordinal", F.lit(2)))
    p = g.select("id", F.array(F.lit("yes")).alias("predicted"), F.lit(2).alias("ordinal")).unionByName(g.select("id", F.array(F.lit("no")).alias("predicted"), F.lit(1).alias("ordinal")))
    extra = g.select((F.col("id") + 10**9).alias("id"), F.array(F.lit("yes")).alias("predicted"), F.lit(3).alias("ordinal"))  # without gold
    return answering.official(p.unionByName(extra), gold).select("bucket", "n", *[F.round(m, 6).alias(m) for m in S.METRICS])


_SAID_SQL = f"""{_GOLD_SQL}, r AS (SELECT doc_id, CASE WHEN na THEN 'not_answerable' WHEN len(l) > 0 AND len(list_filter(l, lambda v: lower(trim(v)) NOT IN ('yes', 'no'))) = 0 THEN 'yesno' ELSE 'value' END AS kind,
 CASE WHEN len(list_filter(l, lambda v: lower(trim(v)) = 'yes')) > 0 THEN 'yes' ELSE 'no' END AS gold, list_filter(list_transform(l, lambda v: lower(v)), lambda v: v IN ('yes', 'no'))[1] AS first, CASE WHEN doc_id % 11 = 0 THEN 'not answerable' WHEN doc_id % 3 = 0 THEN 'yes' WHEN doc_id % 3 = 1 THEN 'no' ELSE 'not answerable' END AS said, doc_id % 11 = 0 AS broken FROM a)"""


def _said(spark, d):
    """Labels as answered questions of a model; every eleventh fails."""
    g = _gold(spark, d)
    broken = F.col("doc_id") % 11 == 0
    said = F.when(~broken & (F.col("doc_id") % 3 == 0), "yes").when(~broken & (F.col("doc_id") % 3 == 1), "no").otherwise("not answerable")
    return g.select(F.col("doc_id").alias("id"), S.question_type(F.col("answers"), F.col("not_answerable")).alias("question_type"), F.col("answers").alias("gold_answers"), said.alias("predicted"), F.when(broken, "failed").alias("error"))


@query(f"""WITH {_SAID_SQL} SELECT count(*) AS total, count(*) FILTER (broken) AS errors, count(*) FILTER (NOT broken AND said = 'yes') AS yes, count(*) FILTER (NOT broken AND said = 'no') AS no, count(*) FILTER (NOT broken AND said = 'not answerable') AS not_answerable,
 count(*) FILTER (NOT broken AND kind = 'yesno') AS yesno, count(*) FILTER (NOT broken AND kind = 'yesno' AND said = gold) AS yesno_right, round(count(*) FILTER (NOT broken AND kind = 'yesno' AND said = gold) / count(*) FILTER (NOT broken AND kind = 'yesno')::DOUBLE, 6)::DOUBLE AS accuracy FROM r""")
def model_counts(spark, d):
    return S.model_summary(_said(spark, d)).withColumn("accuracy", F.round("accuracy", 6))


@query(f"""WITH {_SAID_SQL}, c AS (SELECT count(*) FILTER (said = 'yes' AND gold = 'yes') AS tp, count(*) FILTER (said = 'yes' AND gold <> 'yes') AS fp, count(*) FILTER (said <> 'yes' AND gold = 'yes') AS fn, count(*) FILTER (said <> 'yes' AND gold <> 'yes') AS tn FROM r WHERE kind = 'yesno')
SELECT tp, fp, fn, tn, round(tp / (tp + fp)::DOUBLE, 6)::DOUBLE AS precision, round(tp / (tp + fn)::DOUBLE, 6)::DOUBLE AS recall, round(2.0 * tp / (2 * tp + fp + fn), 6)::DOUBLE AS f1 FROM c""")
def yes_no_confusion(spark, d):
    x = _said(spark, d).filter("question_type = 'yesno'")
    return S.yes_no_confusion(x, F.col("predicted"), S.gold_any_yes(F.col("gold_answers"))).select("tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(f"""WITH {_SAID_SQL} SELECT doc_id AS id, said AS predicted, first AS gold FROM r WHERE kind = 'yesno' AND first IS NOT NULL AND said <> first ORDER BY doc_id LIMIT 10""")
def wrong_yes_no(spark, d):
    """The first ten questions that were answered wrongly: a report of ten is the feature."""
    return S.wrong_yes_no(_said(spark, d).withColumn("predicted", F.array("predicted"))).select("id", "predicted", "gold")


@query(f"""WITH {_SAID_SQL} SELECT kind AS question_type, count(*) AS total, count(*) FILTER (said = 'yes') AS yes, count(*) FILTER (said = 'no') AS no, count(*) FILTER (said = 'not answerable') AS not_answerable FROM r GROUP BY kind""")
def prediction_kinds(spark, d):
    return S.prediction_breakdown(_said(spark, d))


@query("""WITH s AS (SELECT quality = 1 AS hit FROM labels), b(bucket, n, v) AS (SELECT 'total', count(*), avg(hit::INT) FROM s UNION ALL SELECT 'yesno', count(*), avg(hit::INT) FROM s)
SELECT bucket, n, format('{:.1f}%', round(100 * v, 6)) AS em, format('{:.1f}%', 0.0) AS f1 FROM b""")
def metric_tables(spark, d):
    zero = F.lit(0.0)
    x = _t(spark, d, "labels").select(F.lit("yesno").alias("question_type"), F.lit(False).alias("conditional"), F.col("quality").cast("double").alias("em"), zero.alias("em_cond"), zero.alias("f1"), zero.alias("f1_cond"))
    return S.metric_table(S.metric_buckets(x)).select("bucket", "n", "em", "f1")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS em, o_orderkey % 2 = 0 AS correct, CASE WHEN o_orderstatus = 'F' THEN (o_orderkey % 2 = 0)::INT::DOUBLE END AS precision FROM orders""")
def question_rows(spark, d):
    x = _verdicts(spark, d).withColumn("id", F.col("o_orderkey")).withColumn("em", F.when(F.col("o_orderkey") % 2 == 0, 1.0).otherwise(0.5))
    for m in S.METRICS[1:]:
        x = x.withColumn(m, F.lit(0.0))
    return S.per_question(x).select("id", "em", "correct", "precision")


_RULE_SQL = "E'\\n\\n% --- {label} ---\\n{head}(_A0, _A1) :- ' || {body} || '(_A0, _A1).'"


@query("""WITH n AS (SELECT DISTINCT replace(p_name, ' ', '_') AS name FROM part)
SELECT name, name || '(c, x).' || """ + _RULE_SQL.format(label="normalize", head="can_get_' || name || '", body="name") + " || " + _RULE_SQL.format(label="manual", head="a", body="'b'") + """ AS program, 'can_get_' || name || '(me, X)' AS goal FROM n""")
def aligned_programs(spark, d):
    """Typed constants, normal forms and given rules in one go, for each name a program of its own."""
    kinds = "array<struct<id:string,type:string,gloss:string>>"
    me = F.array(F.struct(F.lit("me").alias("id"), F.lit("person").alias("type"), F.lit("").alias("gloss"))).cast(kinds)
    p = _phrases(spark, d).select("name", F.col("name").alias("kb"), F.concat(F.col("name"), F.lit("(c, x).")).alias("program"), F.concat(F.lit("can_get_"), F.col("name"), F.lit("(me, X)")).alias("goal"))
    block = F.struct(F.array(F.concat(F.col("name"), F.lit("(c, x).")), F.lit("other(c)."), F.lit("z(a).")).alias("facts"), F.array().cast("array<string>").alias("rules"))
    p = p.withColumn("context", block).withColumn("context_constants", F.lit(None).cast(kinds)).withColumn("scenario_constants", me)
    out = B.align(p, B.Alignment(normalize=True, constant_align=True, bridge_rules=("a(_A0, _A1) :- b(_A0, _A1).",)))
    return out.select("name", "program", "goal")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
