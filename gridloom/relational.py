"""Relational SELECTs that a generated query can use, with the SQL of an independent engine."""

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

_SAME = {
    "filter_agg": """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
        round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus""",
    "global_agg": "SELECT count(*) AS n, count(DISTINCT o_custkey) AS customers, round(sum(o_totalprice), 1) AS total, min(o_orderdate) AS first_day, max(o_totalprice) AS most FROM orders",
    "projection": "SELECT p_partkey, p_size * 2 + 1 AS twice, round(p_retailprice / 3, 4) AS third, -p_size AS negative, p_size % 7 AS rest FROM part WHERE p_size BETWEEN 10 AND 20 AND NOT p_brand LIKE '%3' OR p_partkey IN (1, 2, 3)",
    "ratio_of_sums": "SELECT o_orderpriority, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END) / sum(o_totalprice), 8) AS share FROM orders GROUP BY o_orderpriority",
    "join_topk": """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
        JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name ORDER BY revenue DESC, n_name LIMIT 10""",
    "left_join": "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey",
    "full_join": "SELECT coalesce(a.k, b.k) AS k, a.n AS customers, b.n AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY c_nationkey) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY s_nationkey) b ON a.k = b.k",
    "cross_join": "SELECT r_name, n_name FROM region CROSS JOIN nation WHERE r_regionkey <= 1",
    "semi_join": "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)",
    "anti_join": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)",
    "in_subquery": "SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')",
    "scalar_subquery": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1.8 * (SELECT avg(o_totalprice) FROM orders)",
    "correlated": "SELECT p_partkey, p_brand, p_retailprice FROM part p WHERE p_retailprice = (SELECT max(p_retailprice) FROM part q WHERE q.p_brand = p.p_brand)",
    "range_join": "SELECT a.n_nationkey AS a_key, b.n_nationkey AS b_key FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND b.n_nationkey <= a.n_nationkey + 3",
    "distinct": "SELECT DISTINCT p_brand, p_size FROM part",
    "having": "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 5",
    "grouping_sets": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    "rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "cube": "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer WHERE c_nationkey < 5 GROUP BY CUBE (c_mktsegment, c_nationkey)",
    "filter_clause": "SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) AS n FROM events GROUP BY user_id",
    "group_by_all": "SELECT c_mktsegment, c_nationkey, max(c_acctbal) AS most FROM customer GROUP BY ALL",
    "window_rank": "SELECT * FROM (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS rk, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS dr FROM orders) WHERE rn <= 2",
    "window_frame": "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS moving, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before, lead(o_orderkey, 1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS after, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS first_one FROM orders",
    "window_share": "SELECT s_suppkey, ntile(4) OVER (ORDER BY s_acctbal, s_suppkey) AS quarter, round(percent_rank() OVER (ORDER BY s_suppkey), 6) AS pr FROM supplier",
    "union_all": "SELECT n_nationkey AS k, 'n' AS kind FROM nation UNION ALL SELECT r_regionkey, 'r' FROM region",
    "union_distinct": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0",
    "except": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_suppkey <= 40",
    "intersect_all": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier",
    "sort_offset": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 15",
    "cte": "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey), ranked AS (SELECT *, row_number() OVER (ORDER BY total DESC, o_custkey) AS rn FROM big) SELECT c_name, round(total, 2) AS total FROM ranked JOIN customer ON c_custkey = o_custkey WHERE rn <= 15",
    "cast_case": "SELECT p_partkey, CAST(floor(p_retailprice) AS BIGINT) AS price, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS class, TRY_CAST(p_name AS INTEGER) AS no_number, nullif(p_size, 10) AS not_ten, CAST(p_size AS VARCHAR(10)) AS text FROM part",
    "strings": "SELECT s_suppkey, upper(s_name) AS up, lower(s_name) AS low, length(s_name) AS n, substring(s_name, 2, 4) AS part, instr(s_name, '0') AS zero, replace(s_name, 'Supplier', 'S') AS short, s_name || '!' AS shout, trim('  x ') AS x, lpad(CAST(s_suppkey AS VARCHAR(9)), 6, '0') AS padded FROM supplier",
    "dates": "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)) AS day_of, quarter(o_orderdate) AS q FROM orders WHERE o_orderdate >= DATE '1996-06-14' AND o_orderdate < DATE '1996-09-01'",
    "monthly": "SELECT CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR(10)) AS month_of, count(*) AS n FROM orders GROUP BY 1",
    "statistics": "SELECT p_brand, round(stddev_samp(p_retailprice), 4) AS sd, round(var_pop(p_retailprice), 2) AS v, round(corr(p_size, p_retailprice), 6) AS c, median(p_size) AS mid FROM part GROUP BY p_brand",
    "quantifiers": "SELECT event_type, bool_and(value >= 0) AS all_positive, bool_or(value > 50) AS some_large, count(DISTINCT user_id) AS users FROM events GROUP BY event_type",
    "ilike": "SELECT p_partkey, p_type FROM part WHERE p_type ILIKE 'promo%' OR p_name ILIKE '%WIDGET'",
    "values_join": "SELECT v.k, n_name FROM (VALUES (1, 'x'), (2, 'y'), (30, 'z')) AS v(k, label) LEFT JOIN nation ON n_nationkey = v.k",
}

_DIALECT = {
    "regexp": (
        r"SELECT s_suppkey, regexp_extract(s_name, r'(\d+)', 1) AS digits, regexp_replace(s_name, r'[^0-9]+', '-') AS dashed FROM supplier WHERE s_name RLIKE r'[0-4]$'",
        r"SELECT s_suppkey, regexp_extract(s_name, '(\d+)', 1) AS digits, regexp_replace(s_name, '[^0-9]+', '-', 'g') AS dashed FROM supplier WHERE regexp_matches(s_name, '[0-4]$')",
    ),
    "arrays": (
        "SELECT c_nationkey, size(collect_set(c_mktsegment)) AS n_segments, concat_ws(',', array_sort(collect_set(c_mktsegment))) AS segments, max_by(c_custkey, c_acctbal) AS richest FROM customer GROUP BY c_nationkey",
        "SELECT c_nationkey, CAST(count(DISTINCT c_mktsegment) AS INTEGER) AS n_segments, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS segments, arg_max(c_custkey, c_acctbal) AS richest FROM customer GROUP BY c_nationkey",
    ),
    "json": (
        "SELECT event_id, get_json_object(props, '$.page') AS page, length(props) AS n FROM events",
        "SELECT event_id, json_extract_string(props, '$.page') AS page, length(props) AS n FROM events",
    ),
    "explode": (
        "SELECT vec_id, count(*) AS n, round(sum(x), 4) AS total FROM (SELECT vec_id, explode(embedding) AS x FROM embeddings) GROUP BY vec_id",
        "SELECT vec_id, count(*) AS n, round(sum(CAST(x AS DOUBLE)), 4) AS total FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) GROUP BY vec_id",
    ),
    "percentile": (
        "SELECT o_orderpriority, percentile_cont(0.25) WITHIN GROUP (ORDER BY o_custkey) AS q1, try_divide(count(*), 0) AS none FROM orders GROUP BY o_orderpriority",
        "SELECT o_orderpriority, quantile_cont(o_custkey, 0.25) AS q1, CAST(NULL AS DOUBLE) AS none FROM orders GROUP BY o_orderpriority",
    ),
    "sample": (
        "SELECT s.n > 0.05 * l.n AND s.n < 0.15 * l.n AS near_a_tenth FROM (SELECT count(*) AS n FROM lineitem TABLESAMPLE (10 PERCENT) REPEATABLE (7)) s CROSS JOIN (SELECT count(*) AS n FROM lineitem) l",
        "SELECT s.n > 0.05 * l.n AND s.n < 0.15 * l.n AS near_a_tenth FROM (SELECT count(*) AS n FROM lineitem USING SAMPLE 10 PERCENT (bernoulli, 7)) s CROSS JOIN (SELECT count(*) AS n FROM lineitem) l",
    ),
    "qualify": (
        "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1",
        "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1",
    ),
}

#: name: (Spark SQL, the other engine's SQL)
RELATIONAL: dict[str, tuple[str, str]] = {name: (sql, sql) for name, sql in _SAME.items()} | _DIALECT
