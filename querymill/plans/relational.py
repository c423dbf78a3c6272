"""The SQL surface: statements that Spark and DuckDB both run over the star schema and events."""

from __future__ import annotations

import re

from querymill.session import TABLES, register_views

#: Statements that read the same in both engines.
SHARED = {
    "pricing_summary": """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
        FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
    "inner_join": "SELECT r_name, n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name",
    "left_join": "SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY c_custkey",
    "full_join": "SELECT coalesce(a.k, b.k) AS k, a.n AS n_customers, b.n AS n_suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 0 GROUP BY 1) b ON a.k = b.k",
    "semi_join": "SELECT p_partkey, p_brand FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49)",
    "anti_join": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)",
    "in_subquery": "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 200)",
    "correlated": "SELECT s_suppkey FROM supplier s WHERE s_acctbal > (SELECT avg(s_acctbal) FROM supplier t WHERE t.s_nationkey = s.s_nationkey)",
    "having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12",
    "distinct_aggregates": "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_returnflag",
    "rollup": "SELECT n_regionkey, c_mktsegment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, c_mktsegment)",
    "cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "grouping_sets": "SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand), (p_size), ())",
    "ranking": "SELECT * FROM (SELECT o_custkey, o_orderkey, rank() OVER w AS r, dense_rank() OVER w AS dr, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC)) q WHERE rn <= 3",
    "frames": "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS s3, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events",
    "union_all": "SELECT n_nationkey AS k FROM nation UNION ALL SELECT s_nationkey FROM supplier",
    "union_distinct": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "except": "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45",
    "recursive": "WITH RECURSIVE t(i, k) AS (SELECT 1, 1 UNION ALL SELECT i + 1, k * 2 FROM t WHERE i < 10) SELECT i, k FROM t",
    "case_expression": "SELECT o_orderpriority, sum(CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END) AS high, sum(CASE WHEN o_totalprice <= 200000 THEN 1 ELSE 0 END) AS low FROM orders GROUP BY o_orderpriority",
    "range_join": "SELECT a.event_id, count(*) AS n FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL '1' DAY GROUP BY a.event_id",
    "top_k": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    "date_trunc": "SELECT date_trunc('month', o_orderdate) AS month, count(*) AS n FROM orders GROUP BY 1",
    "sessions": """SELECT user_id, session, count(*) AS n, min(ts) AS began FROM (SELECT user_id, ts, sum(CASE WHEN before IS NULL OR ts > before + INTERVAL '30' MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM
        (SELECT user_id, event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) p) q GROUP BY user_id, session""",
}

#: Statements that the two dialects spell differently: (Spark, DuckDB).
SPELLED = {
    "json_value": ("SELECT get_json_object(props, '$.k') AS k, count(*) AS n FROM events GROUP BY 1", "SELECT json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY 1"),
    "tumbling": ("SELECT w.start AS began, event_type, count(*) AS n FROM (SELECT window(ts, '1 hour') AS w, event_type FROM events) GROUP BY ALL", "SELECT time_bucket(INTERVAL '1 hour', ts) AS began, event_type, count(*) AS n FROM events GROUP BY ALL"),
    "sliding": ("SELECT w.start AS began, count(*) AS n FROM (SELECT explode(array(window_time, window_time - INTERVAL 1 HOUR)) AS s FROM (SELECT date_trunc('hour', ts) AS window_time FROM events)) LATERAL VIEW inline(array(struct(s AS start))) w GROUP BY 1", "SELECT s AS began, count(*) AS n FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS s FROM events) GROUP BY 1"),
    "as_of": ("SELECT a.event_id, max_by(b.event_id, struct(b.ts, b.event_id)) AS last_purchase FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts < a.ts AND b.event_type = 'purchase' WHERE a.event_type = 'click' GROUP BY a.event_id", "SELECT a.event_id, (list(b.event_id ORDER BY b.ts DESC, b.event_id DESC))[1] AS last_purchase FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts < a.ts AND b.event_type = 'purchase' WHERE a.event_type = 'click' GROUP BY a.event_id"),
    "listed": ("SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
    "lateral": ("SELECT c_custkey, o_orderkey FROM customer, LATERAL (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders WHERE o_custkey = c_custkey) q WHERE r <= 2", "SELECT o_custkey AS c_custkey, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2"),
    "pivot": ("SELECT * FROM (SELECT o_orderstatus, o_orderpriority FROM orders) PIVOT (count(*) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))", "SELECT o_orderpriority, nullif(count(*) FILTER (o_orderstatus = 'F'), 0) AS f, nullif(count(*) FILTER (o_orderstatus = 'O'), 0) AS o, nullif(count(*) FILTER (o_orderstatus = 'P'), 0) AS p FROM orders GROUP BY 1"),
}


def _query(sql):
    names = [t for t in TABLES if re.search(rf"\b{t}\b", sql)]

    def run(spark, d):
        register_views(spark, d, names)
        return spark.sql(sql)

    return run


QUERIES = {f"sql_{n}": _query(s) for n, s in SHARED.items()} | {f"sql_{n}": _query(s) for n, (s, _) in SPELLED.items()}
ORACLE = {f"sql_{n}": s for n, s in SHARED.items()} | {f"sql_{n}": s for n, (_, s) in SPELLED.items()}
