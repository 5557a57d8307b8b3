"""The registered queries of this subpackage and the SQL that some of them are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmata.llm import ann, langid, lattice, linkgraph, mixing, neardup, ogg, packing, periodic, secrets, suffix, toxicity, warc
from lemmata.llm.common import table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH sized AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents),
src AS (SELECT skey, sum(size)::BIGINT AS source_size FROM sized GROUP BY skey),
weighed AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY skey) - 1) % 3 + 1)::INT] AS weight FROM src),
tried AS (
  SELECT *, source_size / weight AS room, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS everything,
         2.0::DOUBLE * coalesce(sum(source_size) OVER before, 0)::DOUBLE AS stopped,
         sum(weight) OVER () - coalesce(sum(weight) OVER before, 0.0::DOUBLE) AS open
  FROM weighed WINDOW before AS (ORDER BY source_size / weight, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
edge AS (
  SELECT room, skey, everything, stopped, open FROM tried
  WHERE (everything - stopped) * weight / open <= 2.0::DOUBLE * source_size ORDER BY room, skey LIMIT 1),
aims AS (
  SELECT t.skey, t.source_size,
         CASE WHEN e.skey IS NULL OR (t.room, t.skey) < (e.room, e.skey) THEN 2.0::DOUBLE * t.source_size
              ELSE (e.everything - e.stopped) * t.weight / e.open END AS target
  FROM tried t LEFT JOIN edge e ON true),
placed AS (
  SELECT s.doc_id, s.size, a.source_size, a.target,
         coalesce(sum(s.size) OVER (PARTITION BY s.skey ORDER BY s.key, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
         floor(a.target)::BIGINT AS budget,
         CASE WHEN a.source_size > 0 THEN floor(a.target)::BIGINT // a.source_size ELSE 0 END AS epochs
  FROM sized s JOIN aims a USING (skey))
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::BIGINT AS taken
FROM placed
"""


def op4_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.digests(table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def secret_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op5_secret_scan reports by its base patterns, which SQL can express."""
    return secrets.scan(table(spark, sf_dir, "documents")).drop("spans")


_ANY_CASE = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)  # noqa: E731
_ASSIGN = "(" + "|".join(map(_ANY_CASE, ("password", "passwd", "secret", "token"))) + "|" + _ANY_CASE("api") + "_?" + _ANY_CASE("key") + r""")["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""

SECRET_BASE_SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS t FROM documents),
found AS (
  SELECT row, 0 AS k, 'assign' AS kind, regexp_extract_all(t, '{_ASSIGN}') AS hit, string_split_regex(t, '{_ASSIGN}') AS gap,
         regexp_extract_all(t, '{_ASSIGN}', 2) AS value, 6 AS least FROM d
  UNION ALL
  SELECT row, 1, 'access', regexp_extract_all(t, 'AKIA[A-Z0-9]+'), string_split_regex(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+'), 20 FROM d
  UNION ALL
  SELECT row, 2, 'hex', regexp_extract_all(t, '[0-9a-f]{{24,}}'), string_split_regex(t, '[0-9a-f]{{24,}}'), regexp_extract_all(t, '[0-9a-f]{{24,}}'), 24 FROM d),
spans AS (
  SELECT row, k, kind, value[i] AS value, least, len(hit[i]) AS n,
         list_sum(list_transform(gap[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(hit[1:i - 1], lambda x: len(x))), 0) AS start
  FROM found, unnest(range(1, len(hit) + 1)) AS u(i)),
told AS (
  SELECT row, sum((k = 0)::INT)::BIGINT AS n_assign, sum((k = 1)::INT)::BIGINT AS n_access, sum((k = 2)::INT)::BIGINT AS n_hex,
         string_agg(kind || ':' || start::BIGINT || ':' || (start + n)::BIGINT, ',' ORDER BY start, k) AS spans
  FROM spans WHERE len(value) >= least GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256
FROM d LEFT JOIN told USING (row)
"""


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=2, similarity=80)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


OP9_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, html, max(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes,
       (SELECT string_agg('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(bits[(i * 5 + 1):(i * 5 + 5)]::BIT::INT) + 1], '' ORDER BY i)
        FROM range(32) t(i)) AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM (SELECT *, (unhex(sha1(html))::BIT)::VARCHAR AS bits FROM d)
"""


def op10_one_bit_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.filter(F.col("vec_id") % 50 == 0), k=5)


OP10_SQL = r"""
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = periodic.collapse_repeats(periodic.planted(table(spark, sf_dir, "documents")))
    higher = lambda a, r: F.when(a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"]), r).otherwise(a)  # noqa: E731
    best = F.aggregate("runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), higher)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    digest = lambda c: F.sha2(c.cast("binary"), 256)  # noqa: E731
    x = x.withColumn("best", best)
    return x.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        digest(lines).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"),
    )  # fmt: skip


def op12_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkgraph.judge(table(spark, sf_dir, "pages"))


_FITS = " ".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'"
    for h, p in (("example.com", "/de/"), ("example.net", "/en/"), ("org", "/fr/"), ("net", "/"))
)

OP12_SQL = rf"""
WITH RECURSIVE p AS (SELECT page_id, coalesce(url, '') AS url, html FROM pages),
parsed AS (
  SELECT page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, html FROM p),
judged AS (SELECT page_id, host, path, CASE {_FITS} END AS rule FROM parsed),
found AS (
  SELECT host AS src, CASE WHEN starts_with(link, '//') THEN 'http:' || link ELSE link END AS link
  FROM (SELECT host, unnest(regexp_extract_all(html, '(?i)href[ 	-]*=[ 	-]*["'']?[ 	-]*((?:[a-z][a-z0-9+.-]*:)?//[^"''<> 	-]+)', 1)) AS link FROM parsed)),
links AS (
  SELECT src, translate(regexp_extract(link, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(link, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM found),
urls AS (SELECT host, rule FROM judged UNION ALL SELECT host, CASE {_FITS} END FROM links),
own AS (
  SELECT host, count(*) AS n, count(*) FILTER (rule IN ('example.net/en/', 'org/fr/')) AS good, count(*) FILTER (rule IN ('net/', 'example.com/de/')) AS bad
  FROM urls WHERE host <> '' GROUP BY host),
ends AS (SELECT DISTINCT src, host AS dst FROM links WHERE src <> '' AND host <> '' AND src <> host),
ways AS (
  SELECT kind, src, dst, count(*) OVER (PARTITION BY kind, src) AS degree
  FROM (SELECT 'trust' AS kind, src, dst FROM ends UNION ALL SELECT 'distrust', dst, src FROM ends)),
mass AS (
  SELECT 0 AS round, 'trust' AS kind, host, (good::HUGEINT * 1000000000 // n)::BIGINT AS mass FROM own WHERE good > 0
  UNION ALL SELECT 0, 'distrust', host, (bad::HUGEINT * 1000000000 // n)::BIGINT FROM own WHERE bad > 0
  UNION ALL
  SELECT m.round + 1, m.kind, w.dst, sum(m.mass // (20 * w.degree) * 17)::BIGINT
  FROM mass m JOIN ways w ON w.kind = m.kind AND w.src = m.host WHERE m.round < 20 AND m.mass >= 20 * w.degree GROUP BY ALL),
scores AS (SELECT host, coalesce(sum(mass) FILTER (kind = 'trust'), 0) AS trust, coalesce(sum(mass) FILTER (kind = 'distrust'), 0) AS distrust FROM mass GROUP BY host)
SELECT page_id, j.host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN distrust > trust AND 2 * distrust >= 1000000000 THEN 'block' ELSE 'allow' END AS verdict
FROM judged j LEFT JOIN scores s ON s.host = j.host AND j.host <> ''
"""


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part, regexp_extract_all(coalesce(text, ''), '[^ 	-]+') AS words FROM documents),
told AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
judged AS (
  SELECT part,
         list_filter([CASE WHEN len(words) < 50 THEN 'A' END, CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' END,
                      CASE WHEN 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * len(t) THEN 'C' END,
                      CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END,
                      CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' END], lambda x: x IS NOT NULL) AS fails,
         coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM d LEFT JOIN told USING (doc_id)),
sets AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM judged GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.x NOT IN (b.x, c.x, d.x, e.x) AND b.x NOT IN (c.x, d.x, e.x) AND c.x NOT IN (d.x, e.x) AND d.x <> e.x),
steps AS (SELECT filter_order, step::INT AS step, filter_order[step] AS own, string_split(filter_order[1:step - 1], '') AS before FROM orders, range(1, 6) AS r(step)),
told_steps AS (
  SELECT part, filter_order, step, own,
         sum(CASE WHEN NOT list_has_any(fails, before) AND NOT list_contains(fails, own) THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN NOT list_has_any(fails, before) AND list_contains(fails, own) THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN list_has_any(fails, before) AND list_contains(fails, own) THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN fails = [own] THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN NOT list_has_any(fails, before) AND list_contains(fails, own) THEN good ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN NOT list_has_any(fails, before) AND list_contains(fails, own) THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM sets, steps GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM told_steps
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_suffix_dedup": op1_suffix_dedup, "op2_toxicity": op2_toxicity, "op3_mix_sources": op3_mix_sources, "op4_ogg_media": op4_ogg_media, "op5_secret_scan": op5_secret_scan, "secret_base": secret_base, "op6_best_fit_packing": op6_best_fit_packing, "op7_minhash_near_dedup": op7_minhash_near_dedup, "op8_language_id": op8_language_id, "op9_warc_segments": op9_warc_segments, "op10_one_bit_neighbours": op10_one_bit_neighbours, "op11_periodic_runs": op11_periodic_runs, "op12_link_graph": op12_link_graph, "op13_filter_audit": op13_filter_audit}


def oracle_sql() -> dict[str, str]:
    return {"op3_mix_sources": OP3_SQL, "secret_base": SECRET_BASE_SQL, "op9_warc_segments": OP9_SQL, "op10_one_bit_neighbours": OP10_SQL, "op12_link_graph": OP12_SQL, "op13_filter_audit": OP13_SQL}
