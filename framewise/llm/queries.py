"""The queries of the operators in this folder, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.llm import (
    html_extract,
    interpolated_lm,
    line_templates,
    link_trust,
    mixing,
    nbsvm,
    quality_rules,
    simhash_anchors,
    sp_tokens,
    token_alignment,
    topk_threshold,
    toxicity,
    whitening,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


OP1_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d
), win AS (
  SELECT r, i, array_to_string(list_slice(words, i, i + 7), ' ') AS g
  FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM w)
), dup AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1
), gap AS (
  SELECT r, least(8, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 8)) AS s FROM dup
), rep AS (SELECT r, sum(s)::BIGINT AS n FROM gap GROUP BY r),
m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines,
    len(regexp_extract_all(text, '\p{Lu}'))::BIGINT AS n_upper,
    len(list_filter(list_zip(words[:-2], words[2:]), lambda p: p[1] = p[2]))::BIGINT AS n_stutter
  FROM w LEFT JOIN rep USING (r)
), b AS (
  SELECT *, ((n_words < 20)::BIGINT | ((100 * n_repeat_words > 30 * n_words)::BIGINT << 1)
    | ((4 * n_symbols > n_words)::BIGINT << 2)
    | ((word_chars < 2 * n_words OR word_chars > 15 * n_words)::BIGINT << 3)
    | ((2 * n_dup_lines > n_lines)::BIGINT << 4) | ((2 * n_upper > word_chars)::BIGINT << 5)
    | ((5 * n_stutter > n_words)::BIGINT << 6))::BIGINT AS fail_bits FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, n_lines, n_upper, n_stutter, fail_bits
FROM b
"""


@_query("op1_quality_rules", OP1_SQL)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.verdicts(_table(spark, folder, "documents"))


OP2_SQL = """
WITH e AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), q AS (SELECT vec_id AS query_id, min(v) AS v FROM e WHERE vec_id % 100 = 0 GROUP BY vec_id),
s AS (
  SELECT query_id, vec_id, list_sum(list_transform(list_zip(q.v, e.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM q JOIN e ON vec_id <> query_id
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
WHERE rank <= 10
"""


@_query("op2_topk_threshold", OP2_SQL)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return topk_threshold.top_k(_table(spark, folder, "embeddings"))


@_query("op3_crf_html")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return html_extract.main_text(_table(spark, folder, "pages"))


@_query("op4_sentencepiece")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    out = sp_tokens.encode_decode(docs)
    return out.withColumn("n_tokens", F.size("ids").cast("long"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS place FROM documents
), s AS (
  SELECT *, CASE k WHEN 0 THEN 3e0 WHEN 1 THEN 1e0 ELSE 2e0 END AS w FROM (
    SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS k
    FROM d GROUP BY source)
), l AS (
  SELECT *, row_number() OVER o AS i, (1.5e0 * sum(source_size) OVER () - 2e0 * coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING
    AND 1 PRECEDING), 0)) / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s WINDOW o AS (ORDER BY 2e0 * source_size / w, source NULLS LAST)
), t AS (
  SELECT source, source_size, k, w, least(2e0 * source_size,
    w * coalesce((SELECT arg_min(level, i) FROM l WHERE level * w <= 2e0 * source_size), 1e300)) AS target FROM s
), p AS (
  SELECT doc_id, size, source_size, target, k, floor(target)::BIGINT AS want,
    (sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), u AS (
  SELECT *, greatest(0, least(want - start, size)) AS a, greatest(0, least(want - start - source_size, size)) AS b
  FROM p
), x AS (
  SELECT *, (CASE WHEN a > 0 THEN start ELSE start + source_size END)::DOUBLE / greatest(want, 1)
    * CASE k WHEN 0 THEN 3e0 WHEN 1 THEN 1e0 ELSE 2e0 END AS need FROM u
)
SELECT doc_id, size, source_size, target, (a + b)::BIGINT AS taken,
  CASE WHEN a + b > 0 THEN round(CASE
    WHEN need <= 0 THEN 0e0
    WHEN k = 0 THEN 2 * need / (4.5e0 + sqrt(4.5e0 * 4.5e0 - 6e0 * need))
    WHEN k = 1 THEN need
    WHEN need < 0.75e0 THEN 2 * need / (1e0 + sqrt(1e0 + 4e0 * need))
    ELSE 0.5e0 + 2 * (need - 0.75e0) / (2e0 + sqrt(4e0 + 4e0 * (need - 0.75e0))) END, 9) END AS position
FROM x
"""


@_query("op5_mixing", OP5_SQL)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, folder, "documents")).drop("uses")
    return mixed.withColumn("position", F.round("position", 9)).orderBy("position", "doc_id")


@_query("op6_line_templates")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return line_templates.deduplicated(_table(spark, folder, "documents"), min_tokens=1)


@_query("op7_simhash_anchors")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_anchors.near_duplicates(_table(spark, folder, "documents"))


@_query("op8_toxicity")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.scored(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


OP9_SQL = r"""
WITH RECURSIVE p AS (
  SELECT row_number() OVER () AS r, page_id, html,
    CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN contains(url, '://') THEN regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 2) ELSE '' END AS path
  FROM pages
), rules AS (
  SELECT * FROM (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
    ('com', '/fr/', 'allow'), ('com', '/de/', 'block')) AS t(h, q, v)
), ruled AS (
  SELECT p.r, page_id, host, path, arg_max(h || q, (length(h || q), h || q)) FILTER (h IS NOT NULL) AS rule,
    arg_max(v, (length(h || q), h || q)) FILTER (h IS NOT NULL) AS v
  FROM p LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q)
  GROUP BY p.r, page_id, host, path
), hrefs AS (
  SELECT host AS src, unnest(regexp_extract_all(html,
    '(?i)<a\s[^>]*?href\s*=\s*["'']?((?:[a-z][a-z0-9+.-]*:)?//[^"''\s>]+)', 1)) AS u FROM p
), edges AS (
  SELECT DISTINCT src, dst FROM (SELECT src, translate(regexp_extract(u, '^(?s:.*?)//([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM hrefs)
  WHERE src <> dst AND src <> '' AND dst <> ''
), seeds AS (
  SELECT k, host, n::DOUBLE / sum(n) OVER (PARTITION BY k) AS base, count(*) OVER (PARTITION BY k) AS seeds FROM (
    SELECT 'trust' AS k, host, count(*) AS n FROM ruled WHERE v = 'allow' GROUP BY host
    UNION ALL SELECT 'distrust', host, count(*) FROM ruled WHERE v = 'block' GROUP BY host)
), hosts AS (SELECT DISTINCT host FROM (SELECT host FROM p UNION ALL SELECT src FROM edges UNION ALL SELECT dst FROM edges)),
directed AS (
  SELECT 'trust' AS k, src, dst, count(*) OVER (PARTITION BY src) AS n_out FROM edges
  UNION ALL SELECT 'distrust', dst, src, count(*) OVER (PARTITION BY dst) FROM edges
), start AS (
  SELECT k, host, coalesce(base, 0e0) AS base FROM hosts CROSS JOIN (VALUES ('trust'), ('distrust')) AS t(k)
  LEFT JOIN seeds USING (k, host)
), walk AS (
  SELECT 0 AS i, k, host, base, base AS score FROM start
  UNION ALL
  SELECT i + 1, k, host, base, got + base * (1 - sum(got) OVER (PARTITION BY k)) FROM (
    SELECT w.i, w.k, w.host, w.base, coalesce((SELECT sum(0.85 * s.score / e.n_out) FROM directed e JOIN walk s
      ON e.k = s.k AND e.src = s.host WHERE e.k = w.k AND e.dst = w.host), 0e0) AS got
    FROM walk w WHERE w.i < 20)
), last AS (
  SELECT host, coalesce(max(score * seeds) FILTER (k = 'trust'), 0e0) AS trust,
    coalesce(max(score * seeds) FILTER (k = 'distrust'), 0e0) AS distrust
  FROM walk LEFT JOIN (SELECT DISTINCT k, seeds FROM seeds) USING (k) WHERE i = 20 GROUP BY host
)
SELECT page_id, host, path, rule,
  coalesce(v, CASE WHEN distrust > 0 AND distrust > trust THEN 'block' ELSE 'allow' END) AS verdict,
  round(trust, 6) + 0e0 AS trust, round(distrust, 6) + 0e0 AS distrust
FROM ruled JOIN last USING (host)
"""


@_query("op9_link_trust", OP9_SQL)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    out = link_trust.judge(_table(spark, folder, "pages"))
    return out.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in ("trust", "distrust")})


@_query("op10_nbsvm")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return nbsvm.scored(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


@_query("op11_interpolated_lm")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return interpolated_lm.scored(_table(spark, folder, "documents"))


@_query("op12_whitening")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened(_table(spark, folder, "embeddings"))


@_query("op13_token_alignment")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return token_alignment.aligned(_table(spark, folder, "documents"))


@_query("pipeline")
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)
