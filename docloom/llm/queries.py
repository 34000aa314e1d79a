"""The subpackage's queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bitslice_topk import top_k
from .common import table
from .exact_dedup import exact_duplicates
from .license_scan import scan_licenses
from .mixing import placed
from .near_dup import near_duplicates
from .packing import pack_documents
from .quality import score_quality
from .sharding import shard_documents
from .substring_dedup import remove_repeats
from .url_filter import filter_urls, rules_frame

#: Verdict, host, path.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), width=20, texts=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), k=5, every=50, scale=256)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), shards=40)


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = placed(table(spark, sf_dir, "documents"), weights=(5, 2, 1), max_repeat=3)
    first = F.when(F.size("copies") > 0, F.col("copies")[0]["position"])
    return mixed.select("doc_id", "size", "source_size", "target", "taken", first.alias("first_position")).orderBy("first_position", "doc_id")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_duplicates(table(spark, sf_dir, "documents"), keep="max")
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(table(spark, sf_dir, "documents"), most=1024, with_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), rules_frame(spark, URL_RULES), default="allow").select("page_id", "host", "path", "rule", "verdict")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_quality": op2_quality,
    "op3_license_scan": op3_license_scan,
    "op4_exact_topk": op4_exact_topk,
    "op5_sharding": op5_sharding,
    "op6_near_dedup": op6_near_dedup,
    "op7_mixing": op7_mixing,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_packing": op9_packing,
    "op10_url_filter": op10_url_filter,
    "pipeline": pipeline,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SQL: dict[str, str] = {
    "op1_substring_dedup": rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (
  SELECT doc_id, s, sha256(array_to_string(w[s + 1 : s + 20], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(0, greatest(0, len(w) - 19))) AS s FROM d)),
later AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, s + o AS p FROM later, range(0, 20) t(o)),
words AS (SELECT doc_id, w[i + 1] AS word, i FROM (SELECT doc_id, w, unnest(range(0, len(w))) AS i FROM d)),
kept AS (
  SELECT words.doc_id, count(*) AS n_words, count(gone.p) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone.p IS NULL) AS kept
  FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.p = words.i GROUP BY words.doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
    "op4_exact_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s) WHERE n <= 5""",
    "op6_near_dedup": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[s + 1 : s + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(0, greatest(1, len(w) - 3))) AS s FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
links AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM sh x JOIN sh y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * i >= 80 * (na.n + nb.n - i)),
reach AS (SELECT doc_id AS id, doc_id AS r FROM d UNION SELECT links.b, reach.r FROM reach JOIN links ON links.a = reach.id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(r) AS component_id FROM reach GROUP BY id) c ON c.id = d.doc_id""",
    "op7_mixing": r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS s, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY source),
w AS (SELECT *, CASE r % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS w, CAST(3 * s AS DOUBLE) AS cap FROM per),
lv AS (
  SELECT *, (sum(s::DOUBLE) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
  FROM w WINDOW b AS (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT level AS final FROM lv WHERE cap / w > level ORDER BY cap / w, r LIMIT 1),
t AS (SELECT source, s, r, CASE WHEN final IS NULL THEN cap ELSE least(cap, final * w) END AS target FROM lv LEFT JOIN f ON true),
p AS (
  SELECT d.*, t.s, t.r, t.target,
    CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (
  SELECT *, CAST(floor(target) AS BIGINT) AS goal, CASE WHEN target > 0 THEN start / target ELSE 0 END AS x FROM p),
n AS (
  SELECT *, greatest(0, least(size, goal - start)) + greatest(0, least(size, goal - start - s)) + greatest(0, least(size, goal - start - 2 * s)) AS taken FROM k)
SELECT doc_id, size, s AS source_size, target, CAST(taken AS BIGINT) AS taken,
  CASE WHEN taken > 0 THEN least(1.0::DOUBLE, CASE r % 3
    WHEN 0 THEN sqrt(0.25::DOUBLE + x * 2) - 0.5
    WHEN 1 THEN x
    ELSE CASE WHEN x <= 0.625 THEN (sqrt(greatest(0::DOUBLE, 2.25 - 2 * x)) - 1.5) / -1 ELSE 0.5 + (sqrt(greatest(0::DOUBLE, 1 - 2 * (x - 0.625))) - 1) / -1 END END) END AS first_position
FROM n""",
    "op8_exact_dedup": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)""",
    "op10_url_filter": r"""
WITH p AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS bare FROM pages),
q AS (SELECT page_id, translate(regexp_extract(bare, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(bare, '/.*$', 0, 's') AS path FROM p),
r(verdict, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
m AS (
  SELECT page_id, rhost || rpath AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC) AS n
  FROM q JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT q.page_id, host, path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM q LEFT JOIN m ON m.page_id = q.page_id AND m.n = 1""",
}
