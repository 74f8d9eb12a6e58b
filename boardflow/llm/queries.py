"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardflow.llm import bitsliced, decontaminate, html_text, jaccard_join, langid, line_dedup, linkgraph, mixing, quality, sharding


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("pattern")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(_table(spark, sf_dir, "documents"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"))


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitsliced.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkgraph.judge(_table(spark, sf_dir, "pages"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(_table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mix_sources, op2_line_dedup, op3_html_text, op4_quality, op5_top_k, op6_url_filter, op7_language, op8_jaccard_join, op9_decontaminate, op10_shard, pipeline)}


_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _op5() -> str:
    return """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: coalesce(p[1] * p[2], 0))) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


def _op6() -> str:
    low = _LOW.format
    rules = sorted(linkgraph.RULES, key=lambda r: -len(r[1] + r[2]))

    def chosen(what: Callable[[tuple], str]) -> str:
        return "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{what((v, h, p))}'" for v, h, p in rules) + " END"

    link = linkgraph.LINK.replace("'", "''")
    d, n = linkgraph.DAMPING, linkgraph.ROUNDS
    steps = ["r0 AS (SELECT kind, host, seed AS score FROM seeds)"]
    for i in range(1, n + 1):
        steps.append(f"""r{i} AS (SELECT kind, host, sum(a) AS score FROM (SELECT kind, host, seed * (1 - {d}) AS a FROM seeds UNION ALL
  SELECT e.kind, e.dst, r.score * e.share * {d} FROM edges e JOIN r{i - 1} r ON e.kind = r.kind AND e.src = r.host) GROUP BY kind, host)""")
    return f"""
WITH p AS (SELECT page_id, html, {low("coalesce(regexp_extract(url, '://([^/?#]*)', 1), '')")} AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
plain AS (SELECT *, {chosen(lambda r: r[1] + r[2])} AS rule, {chosen(lambda r: r[0])} AS given FROM p),
links AS (SELECT src, dst, count(*) AS n FROM (SELECT host AS src, {low(f"unnest(regexp_extract_all(html, '{link}', 1))")} AS dst FROM p) WHERE src <> dst AND src <> '' GROUP BY src, dst),
ways AS (SELECT 'allow' AS kind, src, dst, n FROM links UNION ALL SELECT 'block', dst, src, n FROM links),
edges AS (SELECT kind, src, dst, n / sum(n) OVER (PARTITION BY kind, src) AS share FROM ways),
seeds AS (SELECT given AS kind, host, CAST(count(*) AS DOUBLE) AS seed FROM plain WHERE given IS NOT NULL AND host <> '' GROUP BY given, host),
{", ".join(steps)},
bad AS (SELECT host FROM r{n} GROUP BY host HAVING coalesce(sum(score) FILTER (kind = 'block'), 0) > {linkgraph.FACTOR} * coalesce(sum(score) FILTER (kind = 'allow'), 0))
SELECT page_id, host, path, rule, coalesce(given, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' END, 'allow') AS verdict FROM plain
"""


def _op8() -> str:
    low = _LOW.format("coalesce(text, '')")
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({low}, '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w),
s AS (SELECT DISTINCT doc_id, s FROM t),
n AS (SELECT w.doc_id, count(s.s) AS n FROM w LEFT JOIN s ON w.doc_id = s.doc_id GROUP BY w.doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, min(r.b) AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n.n
"""


def _op9() -> str:
    w = r"regexp_extract_all(" + _LOW.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    near, far = decontaminate.RAREST, decontaminate.SPAN
    return f"""
WITH d AS (SELECT doc_id, {w} AS w FROM documents),
b AS (SELECT item_id, {w} AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 11))) AS i FROM b WHERE len(w) > 0)),
k AS (SELECT DISTINCT k FROM g),
o AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, k WHERE len(w) >= k)),
m AS (SELECT o.doc_id, o.i, o.k, g.item_id FROM o JOIN g ON o.k = g.k AND o.s = g.s),
h AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM m GROUP BY doc_id),
bt AS (SELECT DISTINCT item_id, unnest(w) AS term FROM b),
post AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS p FROM d),
df AS (SELECT term, count(*) AS c FROM post GROUP BY term),
rare AS (SELECT item_id, bt.term, row_number() OVER (PARTITION BY item_id ORDER BY coalesce(c, 0), bt.term) AS r FROM bt LEFT JOIN df ON df.term = bt.term QUALIFY r <= {near}),
many AS (SELECT item_id, count(*) AS terms FROM rare GROUP BY item_id),
hits AS (SELECT post.doc_id, post.p, rare.item_id, rare.r FROM post JOIN rare ON post.term = rare.term),
close AS (SELECT a.doc_id, a.item_id, a.p FROM hits a JOIN hits o ON o.doc_id = a.doc_id AND o.item_id = a.item_id AND abs(o.p - a.p) <= {far} JOIN many ON many.item_id = a.item_id
  WHERE a.r = 1 GROUP BY a.doc_id, a.item_id, a.p, many.terms HAVING count(DISTINCT o.r) = many.terms),
n AS (SELECT doc_id, count(DISTINCT item_id) AS n FROM close GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n, 0) AS BIGINT) AS n_items, sha256(coalesce(t.s, '')) AS items_sha256,
  coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(w) AS contaminated, CAST(coalesce(n.n, 0) AS BIGINT) AS n_near FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN n USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that have one on whole tables; the others are tested against brute force."""
    import corpus_pipeline

    out = {"op5_top_k": _op5(), "op6_url_filter": _op6(), "op8_jaccard_join": _op8(), "op9_decontaminate": _op9()}
    return out | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
