"""SQL of an independent engine for the registered queries."""

from __future__ import annotations

from .relational import RELATIONAL

TOKENS = r"regexp_extract_all(lower({0}), '[a-z0-9_\-\.]+')"
LEXICAL = "flatten(list_transform(" + TOKENS + r", lambda t: CASE WHEN len(list_filter(regexp_split_to_array(t, '[_\-\.]'), lambda p: p <> '')) > 1 THEN list_prepend(t, list_filter(regexp_split_to_array(t, '[_\-\.]'), lambda p: p <> '')) ELSE [t] END))"
PLAIN = "regexp_extract_all(lower({0}), '[a-z0-9_]+')"

POSTINGS = f"SELECT doc_id, unnest(list_distinct({LEXICAL.format('text')})) AS token FROM docs"
IDF = "SELECT token, count(*) AS df, ln(((SELECT count(DISTINCT doc_id) FROM docs_all) + 1) / (count(*) + 0.5)) AS idf FROM posted GROUP BY token"

LEX_CTES = f"""
posted AS ({POSTINGS}), weights AS ({IDF}),
asked AS (SELECT item_id AS qid, unnest(list_distinct({LEXICAL.format('text')})) AS asked FROM benchmark),
total AS (SELECT qid, sum(coalesce(idf, (SELECT max(idf) FROM weights))) AS total FROM asked LEFT JOIN weights ON asked = token GROUP BY qid),
words AS (SELECT DISTINCT asked FROM asked),
matches AS (
  SELECT asked, token, idf AS weight, true AS exact FROM words JOIN weights ON asked = token
  UNION ALL
  SELECT asked, token, 0.8 * idf, false FROM words JOIN weights ON substr(asked, 1, 3) = substr(token, 1, 3) AND asked <> token AND length(asked) >= 3 AND length(token) >= 3 AND (starts_with(asked, token) OR starts_with(token, asked))
),
per_token AS (SELECT qid, doc_id, a.asked, max(weight) FILTER (WHERE exact) AS same, max(weight) AS best FROM asked a JOIN matches m ON a.asked = m.asked JOIN posted p ON p.token = m.token GROUP BY qid, doc_id, a.asked),
lexical AS (SELECT p.qid, doc_id, sum(coalesce(same, greatest(best, 0))) / any_value(total) AS lexical FROM per_token p JOIN total t ON p.qid = t.qid GROUP BY p.qid, doc_id)
"""

INDEX_OF = "CAST(CAST('0x' || substr(md5({0}), 7, 2) || substr(md5({0}), 5, 2) || substr(md5({0}), 3, 2) || substr(md5({0}), 1, 2) AS BIGINT) % 512 AS INTEGER)"


def _hash(name: str, key: str, text: str, source: str) -> str:
    return f"""{name}_t AS (SELECT {key}, unnest({TOKENS.format(text)}) AS token FROM {source}),
{name}_c AS (SELECT {key}, {INDEX_OF.format('token')} AS idx, count(*) AS n FROM {name}_t GROUP BY ALL),
{name} AS (SELECT {key}, idx, n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS w FROM {name}_c)"""


def _top(inner: str, score: str, out: str, k: int = 3) -> str:
    return f"SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY {score} DESC, doc_id) AS INTEGER) AS rank, doc_id, {score} AS {out} FROM ({inner}) QUALIFY rank <= {k}"


DENSE = {
    "cosine": "list_inner_product(q.v, d.v) / (sqrt(list_inner_product(q.v, q.v)) * sqrt(list_inner_product(d.v, d.v)))",
    "dot": "list_inner_product(q.v, d.v)",
    "euclidean": "1 / (1 + list_distance(q.v, d.v))",
}
VECTORS = "v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


def _dense(metric: str) -> str:
    return f"""WITH {VECTORS}, s AS (SELECT q.vec_id AS qid, d.vec_id AS doc_id, {DENSE[metric]} AS exact FROM v q JOIN v d ON true WHERE q.vec_id % 100 = 0)
SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY exact DESC, doc_id) AS INTEGER) AS rank, doc_id, round(exact, 6) AS score FROM s QUALIFY rank <= 5"""


def _parsed(kind: str) -> str:
    return f"SELECT 'NATIONS - ' || r_name AS section, '{kind}' AS source_format, 'Note on ' || r_name || '.' AS context_notes, n_nationkey, n_name, n_regionkey FROM nation JOIN region ON n_regionkey = r_regionkey"


NUMBER = r"(?i)-?\d[\d,]*(?:\.\d+)?\s*(?:[kmb])?"
NUMBERS = f"list_transform(regexp_extract_all(text, '{NUMBER}'), lambda x: CAST(regexp_replace(lower(x), '[kmb\\s,]', '', 'g') AS DOUBLE) * CASE WHEN lower(x) LIKE '%k' THEN 1e3 WHEN lower(x) LIKE '%m' THEN 1e6 WHEN lower(x) LIKE '%b' THEN 1e9 ELSE 1 END)"

_SUMMARY = "CASE WHEN contains(substr(text, 1, 1200), lang) THEN substr(text, 1, 1200) ELSE 'Section: ' || lang || '.' || chr(10) || substr(text, 1, 1200) END"


def oracle_sql() -> dict[str, str]:
    found = {f"rel_{name}": other for name, (_, other) in RELATIONAL.items()}
    found["rel_pivot"] = "SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'F') AS n_f, count(*) FILTER (WHERE l_linestatus = 'O') AS n_o FROM lineitem GROUP BY l_returnflag"
    found["rel_asof"] = """WITH b AS (SELECT user_id AS key, ts AS t, event_id, CAST(NULL AS BIGINT) AS o_orderkey, 1 AS side FROM events UNION ALL SELECT o_custkey, o_orderdate, NULL, o_orderkey, 0 FROM orders),
    w AS (SELECT *, last_value(o_orderkey IGNORE NULLS) OVER (PARTITION BY key ORDER BY t, side, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_order FROM b)
    SELECT event_id, key AS user_id, last_order FROM w WHERE side = 1"""
    docs = "docs_all AS (SELECT doc_id FROM documents), docs AS (SELECT doc_id, text FROM documents)"
    found["tok_counts"] = f"SELECT doc_id, CAST(len({LEXICAL.format('text')}) AS BIGINT) AS n_tokens, CAST(len(list_distinct({LEXICAL.format('text')})) AS BIGINT) AS n_distinct, CAST(len({PLAIN.format('text')}) AS BIGINT) AS n_plain FROM documents"
    found["lex_idf"] = f"WITH {docs}, posted AS ({POSTINGS}), weights AS ({IDF}) SELECT token, df, round(idf, 9) AS idf FROM weights"
    found["lex_topk"] = f"WITH {docs}, {LEX_CTES} " + _top("SELECT qid, doc_id, round(lexical, 6) AS lexical FROM lexical", "lexical", "lexical")
    found["embed_hash"] = f"WITH {_hash('d', 'doc_id', 'text', 'documents')} SELECT doc_id, idx, round(w, 9) AS w FROM d"
    hashes = f"{_hash('d', 'doc_id', 'text', 'documents')}, {_hash('q', 'item_id', 'text', 'benchmark')}"
    found["embed_topk"] = f"WITH {hashes} " + "SELECT qid, rank, doc_id, round(s, 6) AS semantic FROM (" + _top("SELECT item_id AS qid, doc_id, round(sum(q.w * d.w), 9) AS s FROM q JOIN d ON q.idx = d.idx GROUP BY ALL", "s", "s") + ")"
    summed = f"docs_all AS (SELECT doc_id FROM documents), docs AS (SELECT doc_id, {_SUMMARY} AS text FROM documents)"
    found["hybrid_topk"] = f"""WITH {summed}, {LEX_CTES}, {_hash('d', 'doc_id', 'text', 'docs')}, {_hash('q', 'item_id', 'text', 'benchmark')},
    dots AS (SELECT item_id AS qid, doc_id, sum(q.w * d.w) AS semantic FROM q JOIN d ON q.idx = d.idx GROUP BY ALL),
    pool AS (SELECT * FROM dots QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(semantic, 9) DESC, doc_id) <= 50),
    blend AS (SELECT p.qid, p.doc_id, semantic, 0.5 * semantic + 0.5 * coalesce(lexical, 0) AS score FROM pool p LEFT JOIN lexical l ON p.qid = l.qid AND p.doc_id = l.doc_id)
    SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, round(semantic, 9) DESC, doc_id) AS INTEGER) AS rank, doc_id, round(score, 5) AS score FROM blend QUALIFY rank <= 3"""
    found["tfidf_topk"] = f"""WITH dc AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest({PLAIN.format('text')}) AS term FROM documents) GROUP BY ALL),
    idf AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM dc GROUP BY term),
    dv AS (SELECT doc_id, dc.term, n * idf / sqrt(sum(n * idf * n * idf) OVER (PARTITION BY doc_id)) AS w FROM dc JOIN idf ON dc.term = idf.term),
    qc AS (SELECT item_id AS qid, term, count(*) AS n FROM (SELECT item_id, unnest({PLAIN.format('text')}) AS term FROM benchmark) GROUP BY ALL),
    qv AS (SELECT qid, qc.term, n * idf / sqrt(sum(n * idf * n * idf) OVER (PARTITION BY qid)) AS w FROM qc JOIN idf ON qc.term = idf.term),
    s AS (SELECT qid, doc_id, sum(qv.w * dv.w) AS score FROM qv JOIN dv ON qv.term = dv.term GROUP BY ALL)
    SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS INTEGER) AS rank, doc_id, round(score, 6) AS score FROM s QUALIFY rank <= 3"""
    found["metric_values"] = f"WITH {VECTORS} SELECT d.vec_id, " + ", ".join(f"round({sql}, 6) AS {name}" for name, sql in DENSE.items()) + " FROM v q JOIN v d ON true WHERE q.vec_id = 0"
    found |= {f"dense_{m}": _dense(m) for m in DENSE}
    found |= {f"parse_{kind}": _parsed(kind) for kind in ("tsv", "csv", "pipe")} | {"parse_markdown": _parsed("pipe")}
    found["parse_rules"] = """SELECT r_name, CAST(row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) - 1 AS INTEGER) AS i, n_name AS title, CASE WHEN n_nationkey % 2 = 0 THEN '## ' ELSE '' END || n_name || chr(10) || 'Number ' || n_nationkey AS body
    FROM nation JOIN region ON n_regionkey = r_regionkey"""
    found["ingest_repeated"] = "SELECT 'NATIONS - ' || r_name AS section, kind, 2 AS n, 2 AS n_ids FROM region CROSS JOIN (VALUES ('text'), ('table')) AS t(kind)"
    found["evalset_t2"] = """SELECT CAST(o_custkey AS VARCHAR) AS source, arg_min(o_orderpriority, o_orderkey) AS text, CAST(sum(CASE WHEN o_orderkey % 3 = 1 THEN 2 ELSE 1 END) AS BIGINT) AS n_answers FROM orders GROUP BY o_custkey"""
    found["store_round_trip"] = "SELECT 'NATIONS - ' || r_name AS section, count(*) AS n_rows, 'n_name' AS second FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"
    found["sandbox_names"] = """SELECT 'nations' || CASE WHEN n_regionkey = 0 THEN '' ELSE '_' || (n_regionkey + 1) END AS view, count(*) AS n, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation GROUP BY n_regionkey"""
    found["parse_plain"] = r"SELECT doc_id, '(document)' AS title, CAST(length(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS BIGINT) AS n_chars, CAST(len(string_split(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10))) AS BIGINT) AS n_lines FROM documents"
    found["chunk_tables"] = """WITH r AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part),
    s AS (SELECT DISTINCT p_brand, n, unnest(range(0, n, CASE WHEN n <= 20 THEN n ELSE 15 END)) AS start FROM r),
    k AS (SELECT * FROM s WHERE start = 0 OR start - 15 + 20 < n)
    SELECT CASE WHEN k.n <= 20 THEN k.p_brand ELSE k.p_brand || ' (rows ' || (start + 1) || '-' || (start + count(*)) || ')' END AS section, count(*) AS n_rows, min(p_partkey) AS first_key, max(p_partkey) AS last_key
    FROM k JOIN r ON k.p_brand = r.p_brand AND i >= start AND i < start + 20 GROUP BY k.p_brand, k.n, start"""
    found["chunk_text"] = r"SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS BIGINT) AS n_words, true AS within FROM documents"
    found["sentence_counts"] = r"SELECT doc_id, CAST(len(list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> '')) AS BIGINT) AS n_sentences FROM documents"
    found["summary_text"] = f"SELECT doc_id, md5({_SUMMARY}) AS digest FROM documents"
    found["summary_table"] = """WITH f AS (SELECT p_brand, p_type, min(p_partkey) AS first_key FROM part GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY first_key) AS i FROM f)
    SELECT p_brand, string_agg(p_type, ', ' ORDER BY first_key) FILTER (WHERE i <= 24) AS types, 3 + (SELECT CAST(count(p_partkey) > 0 AS BIGINT) + CAST(count(p_type) > 0 AS BIGINT) + CAST(count(p_size) > 0 AS BIGINT) FROM part p WHERE p.p_brand = t.p_brand) AS n_lines FROM t GROUP BY p_brand"""
    found["infer_types"] = r"""WITH c AS (SELECT 's_suppkey' AS col, CAST(s_suppkey AS VARCHAR) AS value FROM supplier UNION ALL SELECT 's_acctbal', printf('%.2f', s_acctbal) FROM supplier UNION ALL SELECT 's_name', s_name FROM supplier
    UNION ALL SELECT 'o_orderdate', strftime(o_orderdate, '%Y-%m-%d') FROM orders UNION ALL SELECT 'blank', ' ' FROM orders),
    t AS (SELECT col, nullif(trim(value), '') AS v FROM c)
    SELECT col, CASE WHEN count(v) = 0 THEN 'STRING' WHEN count(v) = count(TRY_CAST(CASE WHEN NOT contains(v, '.') AND NOT contains(v[2:], '-') THEN v END AS BIGINT)) THEN 'BIGINT'
      WHEN count(v) = count(TRY_CAST(v AS DOUBLE)) THEN 'DOUBLE' WHEN count(v) = count(TRY_CAST(v AS DATE)) THEN 'DATE' ELSE 'STRING' END AS type FROM t GROUP BY col"""
    name = "substr(CASE WHEN {0} = '' THEN 'col' WHEN regexp_matches({0}, '^[0-9]') THEN 'col_' || {0} ELSE {0} END, 1, 60)"
    clean = "trim(regexp_replace(lower(trim({0})), '[^a-z0-9_]+', '_', 'g'), '_')"
    found["sanitize"] = f"SELECT p_partkey, {name.format(clean.format('p_name'))} AS name, {name.format(clean.format(chr(40) + 'p_size || ' + repr(' ') + ' || p_type' + chr(41)))} AS sized FROM part"
    found["sandbox_sql"] = "SELECT CAST(n_regionkey AS BIGINT) AS n_regionkey, count(*) AS n, CAST(sum(n_nationkey) AS BIGINT) AS total, min(n_name) AS first_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_regionkey"
    asked = "['What is the total of ', 'Who wrote ', 'How many in ', 'Per item: ', 'The rated '][turn % 5 + 1] || text"
    phrases = "total|sum|average|avg|mean of|median|count|how many|number of|rate|percentage|percent|ratio|across all|combined|standard deviation|variance|highest|lowest|maximum|minimum|max|min|most|least|below|above|more than|less than"
    computes = lambda text, more: f"CASE WHEN regexp_matches(lower({text}), '(^|[^a-z0-9_])({phrases}{more})($|[^a-z0-9_])')"
    found["route_turns"] = f"""SELECT conv_id, turn, {computes('text', '')} OR regexp_matches(lower(text), '(^|[^a-z0-9_])per[[:space:]]') THEN 'compute' ELSE 'lookup' END AS route,
    {computes(asked, '|wrote')} THEN 'compute' ELSE 'lookup' END AS asked_route FROM conversations"""
    found["numbers"] = f"SELECT conv_id, turn, CAST(len({NUMBERS}) AS BIGINT) AS n, coalesce(list_max({NUMBERS}), 0.0) AS largest FROM (SELECT conv_id, turn, text FROM conversations UNION ALL SELECT doc_id, -1, text FROM documents)"
    found["answers"] = "SELECT o_orderkey, o_orderkey % 4 IN (0, 1, 3) OR o_orderkey % 5 = 0 AS any_match, o_orderkey % 4 IN (0, 1, 3) AND o_orderkey % 5 = 0 AS all_match FROM orders"
    found["rank_metrics"] = f"""WITH {VECTORS}, s AS (SELECT q.vec_id AS qid, q.label AS ql, d.vec_id AS doc_id, d.label AS dl, {DENSE['cosine']} AS exact FROM v q JOIN v d ON true WHERE q.vec_id % 100 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY exact DESC, doc_id) AS rank FROM s QUALIFY rank <= 5),
    h AS (SELECT qid, min(rank) FILTER (WHERE doc_id <> qid AND (dl = ql OR dl = (ql + 1) % 10)) AS hit FROM r GROUP BY qid)
    SELECT 'labels' AS dataset, count(*) AS num_samples, round(avg(CASE WHEN hit <= 3 THEN 1.0 ELSE 0 END), 6) AS recall_at_k, round(avg(CASE WHEN hit <= 3 THEN 1.0 / hit ELSE 0 END), 6) AS mrr_at_k, CAST(NULL AS DOUBLE) AS exact_match FROM h"""
    found["store_upsert"] = """SELECT doc_id, md5(CASE WHEN doc_id % 7 = 0 THEN 'new' ELSE text END) AS digest FROM documents
    UNION ALL SELECT doc_id + 1000000000, md5(text) FROM documents WHERE doc_id % 11 = 0"""
    found["resume_remaining"] = "SELECT item_id AS qid, length(text) AS n FROM benchmark WHERE item_id % 3 <> 0"
    found["evalset_contexts"] = """WITH r AS (SELECT CASE WHEN n_nationkey < 20 THEN r_name ELSE 'table-' || n_nationkey END AS source, n_nationkey, n_name FROM nation JOIN region ON n_regionkey = r_regionkey)
    SELECT source, '| key | nation |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || min(n_nationkey) || ' | ' || arg_min(n_name, n_nationkey) || ' |' AS text, count(*) AS n_samples FROM r GROUP BY source"""
    found["baseline_chunks"] = """SELECT r_name AS source, i, CASE i WHEN 0 THEN '====' || chr(10) || 'NATIONS - ' || r_name ELSE 'n_nationkey,n_name,n_regionkey' || chr(10) || (SELECT min(n_nationkey) || ',' || arg_min(n_name, n_nationkey) || ',' || min(n_regionkey) FROM nation WHERE n_regionkey = r_regionkey) END AS preview
    FROM region CROSS JOIN (VALUES (0), (1)) AS t(i)"""
    found["render_blocks"] = """SELECT p_brand AS section, md5('### ' || p_brand || chr(10) || '| p_partkey | p_type | p_size |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || p_partkey || ' | ' || p_type || ' | ' || p_size || ' |', chr(10) ORDER BY p_partkey) || chr(10) || 'Notes: checked') AS digest FROM part GROUP BY p_brand"""
    return found
