"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import extraction, fingerprints, jaccard, langid, licenses, mixing, packing, topk, urlfilter, warc

#: the rules of op7: verdict, host, path
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> dict[str, str]:
    """Places of the public byte-level vocabulary, as arguments of ``pack_documents``."""
    import public_tokenizers as public

    return {"vocabulary": public.path("byte_bpe_50k.json"), "ranks": public.path("byte_bpe_50k.tiktoken"), "pattern": public.PATTERN}


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), **vocabulary())


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree: source, language, groups of 32 ids."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.expr("cast(doc_id div 32 as string)"), F.col("doc_id").cast("string"))
    return licenses.scan_licenses(docs.select("doc_id", path.alias("path"), "text"))


def op5_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract_pages(table(spark, sf_dir, "pages"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").where(topk.usable(F.col("embedding"))).select("vec_id", topk.quantized(F.col("embedding")).alias("v"))
    return topk.exact_top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(table(spark, sf_dir, "pages"), RULES)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_languages(table(spark, sf_dir, "documents"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), k=3, percent=90)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {
        "op1_packing": op1_packing,
        "op2_warc": op2_warc,
        "op3_fingerprints": op3_fingerprints,
        "op4_licenses": op4_licenses,
        "op5_extraction": op5_extraction,
        "op6_topk": op6_topk,
        "op7_urls": op7_urls,
        "op8_mixing": op8_mixing,
        "op9_langid": op9_langid,
        "op10_jaccard": op10_jaccard,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    from corpus_pipeline import ORACLE_SQL

    found = {"op2_warc": WARC_SQL, "op6_topk": TOPK_SQL, "op7_urls": URLS_SQL, "op10_jaccard": JACCARD_SQL}
    return found | ({"pipeline": ORACLE_SQL} if ORACLE_SQL else {})


WARC_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, url, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
g AS (SELECT payload_digest, max(page_id) AS origin FROM h WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, h.payload_digest,
       CASE WHEN origin IS NOT NULL AND origin <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN origin <> page_id THEN origin END AS refers_to, url
FROM h LEFT JOIN g ON h.payload_digest = g.payload_digest AND payload_bytes >= 1000
"""

TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id IS DISTINCT FROM c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""


def _attribute(name: str) -> str:
    pattern = rf"""'(?is)[\s"''/]{name}\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)'"""
    value = f"regexp_extract(tag, {pattern}, 1)"
    return f"""nullif(CASE WHEN {value}[1] IN ('"', '''') THEN {value}[2:-2] ELSE {value} END, '')"""


#: components by a recursive closure, for few links only
URLS_SQL = r"""
WITH RECURSIVE rules AS (SELECT * FROM (VALUES %s) AS t(verdict, h, p)),
pg AS (SELECT row_number() OVER () AS rid, page_id, url, html, instr(url, '://') AS sep FROM pages),
seen AS (SELECT url, regexp_replace(regexp_replace(html, '(?s)<!--.*?(-->|\z)', '', 'g'), '(?is)<script\b.*?(</script\s*>|\z)', '', 'g') AS h FROM pg WHERE url IS NOT NULL AND html IS NOT NULL),
tags AS (SELECT url, unnest(regexp_extract_all(h, '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM seen),
attributes AS (
  SELECT url, lower(tag[2:5]) AS name, lower(trim(%s)) AS rel, %s AS href, lower(trim(%s)) AS equiv, %s AS content FROM tags
),
targets AS (
  SELECT url, href AS t FROM attributes WHERE name = 'link' AND list_contains(string_split_regex(rel, '\s+'), 'canonical')
  UNION ALL SELECT url, regexp_extract(content, '(?is)^\s*[0-9.]*\s*[;,]?\s*(?:url\s*=\s*)?[''"]?([^''"]*)', 1) FROM attributes WHERE name = 'meta' AND equiv = 'refresh'
),
clean AS (SELECT url, replace(regexp_replace(t, '^\s+|\s+$', '', 'g'), '&amp;', '&') AS t, regexp_extract(url, '(?s)^[A-Za-z][\w+.-]*://[^/?#]*') AS site FROM targets),
split_targets AS (SELECT *, regexp_extract(substring(url, length(site) + 1), '(?s)^[^?#]*') AS base, regexp_extract(t, '(?s)^[^?#]*') AS tp FROM clean),
merged AS (SELECT *, CASE WHEN starts_with(tp, '/') THEN tp ELSE coalesce(nullif(regexp_extract(base, '(?s)^.*/'), ''), '/') || tp END AS m FROM split_targets),
flat AS (
  SELECT *, list_reduce(list_prepend('', string_split(m[2:], '/')), lambda x, y: CASE y WHEN '..' THEN regexp_replace(x, '/[^/]*$', '') WHEN '.' THEN x ELSE x || '/' || y END)
    || CASE WHEN regexp_matches(m, '/[.][.]?$') THEN '/' ELSE '' END AS resolved FROM merged
),
whole AS (
  SELECT url AS a, CASE WHEN regexp_matches(t, '^[A-Za-z][\w+.-]*://') THEN t
    WHEN t = '' OR site = '' OR starts_with(t, '#') OR regexp_matches(t, '^[A-Za-z][\w+.-]*:') THEN NULL
    WHEN starts_with(t, '//') THEN regexp_extract(url, '^([A-Za-z][\w+.-]*):', 1) || ':' || t
    WHEN starts_with(t, '?') THEN site || base || t
    ELSE site || resolved || substring(t, length(tp) + 1) END AS b FROM flat
),
bare AS (SELECT regexp_replace(a, '(?s)#.*$', '') AS a, regexp_replace(b, '(?s)#.*$', '') AS b FROM whole WHERE b IS NOT NULL),
fronts AS (SELECT a, b, regexp_extract(a, '(?s)^[^:]*://[^/?]*') AS fa, regexp_extract(b, '(?s)^[^:]*://[^/?]*') AS fb FROM bare),
edges AS (SELECT DISTINCT lower(fa) || substring(a, length(fa) + 1) AS a, lower(fb) || substring(b, length(fb) + 1) AS b FROM fronts),
both_ways AS (SELECT a, b FROM edges WHERE a <> b UNION SELECT b, a FROM edges WHERE a <> b),
reach(a, b) AS (SELECT a, a FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
split AS (
  SELECT 'page' AS kind, CAST(rid AS VARCHAR) AS id, url, sep FROM pg
  UNION ALL SELECT DISTINCT 'node', a, a, instr(a, '://') FROM both_ways
),
parts AS (
  SELECT kind, id, CASE WHEN url IS NULL OR sep = 0 THEN '' ELSE translate(regexp_extract(substring(url, sep + 3), '(?s)^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS host,
         CASE WHEN url IS NULL OR sep = 0 THEN '' ELSE regexp_extract(substring(url, sep + 3), '(?s)^[^/?#]*([^?#]*)', 1) END AS path
  FROM split
),
judged AS (
  SELECT kind, id, host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS own
  FROM parts LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL
),
blocked AS (
  SELECT r.a AS node FROM reach r JOIN judged j ON j.kind = 'node' AND j.id = r.b
  GROUP BY r.a HAVING bool_or(j.own = 'block') AND NOT coalesce(bool_or(j.own = 'allow'), false)
),
named AS (SELECT rid, page_id, regexp_replace(url, '(?s)#.*$', '') AS bare, regexp_extract(regexp_replace(url, '(?s)#.*$', ''), '(?s)^[^:]*://[^/?]*') AS front FROM pg)
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN node IS NOT NULL THEN 'block' END, 'allow') AS verdict, node IS NOT NULL AS alias_blocked
FROM named JOIN judged ON kind = 'page' AND id = CAST(rid AS VARCHAR)
LEFT JOIN blocked ON node = lower(front) || substring(bare, length(front) + 1)
""" % (
    ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES),
    *map(_attribute, ("rel", "href", "http-equiv", "content")),
)

#: all pairs of distinct sets that share a shingle: for small tables
JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
s AS (
  SELECT rid, doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END AS s FROM w
),
sized AS (SELECT rid, doc_id, s, CAST(len(s) AS BIGINT) AS n, md5(array_to_string(s, chr(10))) AS digest FROM s),
classes AS (SELECT digest, any_value(s) AS s, any_value(n) AS n, min(doc_id) AS least FROM sized WHERE n > 0 GROUP BY digest),
tokens AS (SELECT digest, n, unnest(s) AS shingle FROM classes),
pairs AS (
  SELECT a.digest AS a, b.digest AS b FROM tokens a JOIN tokens b ON a.shingle = b.shingle AND a.digest < b.digest AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.digest, b.digest HAVING 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))
),
both_ways AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach(a, b) AS (SELECT digest, digest FROM classes UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
named AS (SELECT r.a AS digest, min(c.least) AS component FROM reach r JOIN classes c ON c.digest = r.b GROUP BY r.a)
SELECT doc_id, n AS n_shingles, coalesce(component, doc_id) AS component_id FROM sized LEFT JOIN named ON named.digest = sized.digest AND n > 0
"""
