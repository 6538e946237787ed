"""Queries for scans, filters, joins, aggregates, subqueries and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.operators.lookup import TableProvider, enrich
from rivulet.plans.tables import frame, load, sql

sql("scan_parquet", "SELECT r_regionkey, r_name FROM region")
sql("project_expr", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_linenumber + 1 AS nextno FROM lineitem")
sql("filter_and_or", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity > 45 OR l_discount > 0.09) AND NOT l_returnflag = 'A'")
sql("filter_between_like_in", "SELECT p_partkey, p_name FROM part WHERE p_size BETWEEN 10 AND 20 AND p_type LIKE '%E%' AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#21', 'Brand#31', 'Brand#2', 'Brand#3')")
sql("filter_null_safe", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NOT DISTINCT FROM NULL")
sql("filter_null_safe_equal", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality <=> 1", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NOT DISTINCT FROM 1")
sql("case_when", "SELECT o_orderkey, CASE WHEN o_totalprice < 50000 THEN 'low' WHEN o_totalprice < 150000 THEN 'mid' ELSE 'high' END AS band FROM orders")
sql("cast_types", "SELECT l_orderkey, l_linenumber, l_linenumber::BIGINT AS a, CAST(l_linenumber AS VARCHAR) AS b, CAST(l_orderkey AS DOUBLE) AS c, '12'::INT AS d FROM lineitem")
sql("exclude_columns", "SELECT * EXCLUDE (c_acctbal, c_mktsegment) FROM customer")
sql("limit_offset_ordered", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10")
sql("topk_revenue", "SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY l_orderkey ORDER BY revenue DESC, l_orderkey LIMIT 10")
sql("topk_nulls_first", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY l.quality DESC, d.doc_id LIMIT 50", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY l.quality DESC NULLS FIRST, d.doc_id LIMIT 50")
sql("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
sql("values_rows", "SELECT a, b FROM (VALUES (1, 'x'), (2, 'y')) AS t(a, b)")

sql("join_inner_multi", "SELECT o.o_orderkey, c.c_name, l.l_linenumber FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE c.c_acctbal > 9000")
sql("join_left", "SELECT c.c_custkey, count(o.o_orderkey) AS n FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey")
sql("join_right", "SELECT l.doc_id, d.lang FROM labels l RIGHT JOIN documents d ON d.doc_id = l.doc_id")
sql("join_full", "SELECT s.s_nationkey AS a, c.c_nationkey AS b, count(*) AS n FROM (SELECT DISTINCT s_nationkey FROM supplier WHERE s_nationkey < 15) s FULL OUTER JOIN (SELECT DISTINCT c_nationkey FROM customer WHERE c_nationkey > 10) c ON s.s_nationkey = c.c_nationkey GROUP BY s.s_nationkey, c.c_nationkey")
sql("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
sql("join_natural", "SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM nation) x NATURAL JOIN (SELECT s_nationkey AS k, s_name AS b FROM supplier) y")
sql("join_natural_without_common", "SELECT r_name, x FROM region NATURAL JOIN (SELECT n_nationkey AS x FROM nation WHERE n_nationkey < 3) y", "SELECT r_name, x FROM region CROSS JOIN (SELECT n_nationkey AS x FROM nation WHERE n_nationkey < 3) y")
sql("join_theta_range", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey")
sql("join_semi_exists", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)")
sql("join_anti_not_exists", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 150000)")
sql("join_not_in", "SELECT d.doc_id FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels)")


@frame("join_broadcast_lookup", "SELECT c.c_custkey, n.n_name FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey")
def join_broadcast_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich(load(spark, sf_dir, "customer"), TableProvider(load(spark, sf_dir, "nation"), "n_nationkey"), "c_nationkey", "n_nationkey").select("c_custkey", "n_name")


Q1 = """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
  round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_quantity), 6) AS avg_qty, count(*) AS count_order
  FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus"""
sql("agg_basic", Q1)


@frame("agg_pricing_summary", Q1)
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    rows = load(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base_price"), F.round(F.sum(net), 2).alias("sum_disc_price"), F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.count(F.lit(1)).alias("count_order")
    )


EVENTS = "SELECT event_type, count(*) AS cnt, round(sum(value), 4) AS total FROM {t} WHERE value >= 10 GROUP BY event_type"


@frame("flow_events", EVENTS.format(t="events"))
def flow_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: a file input whose query runs over it as the table `flow`."""
    from rivulet.sources import inputs

    return inputs.build(spark, {"type": "file", "format": "parquet", "path": f"{sf_dir}/events.parquet", "query": {"query": EVENTS.format(t="flow"), "table": "flow"}})


sql("agg_distinct", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, count(o_custkey) AS n FROM orders GROUP BY o_orderstatus")
sql("agg_filter", "SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS big, round(sum(l_tax) FILTER (WHERE l_discount > 0.05), 4) AS tax FROM lineitem GROUP BY l_returnflag")
sql("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
sql("agg_having_subquery", "SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING sum(o_totalprice) > (SELECT 12 * avg(o_totalprice) FROM orders)")
sql("agg_group_by_alias", "SELECT substr(p_type, 1, 4) AS kind, count(*) AS n FROM part GROUP BY kind")
sql("agg_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_linestatus) AS g FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_linestatus) AS INT) AS g FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
sql("agg_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
sql("agg_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
sql(
    "agg_statistical",
    """SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS c, round(covar_pop(l_quantity, l_discount), 6) AS cp, round(covar_samp(l_quantity, l_discount), 6) AS cs, round(stddev(l_quantity), 6) AS sd,
    round(stddev_pop(l_quantity), 6) AS sp, round(var(l_quantity), 5) AS v, round(var_pop(l_quantity), 5) AS vp FROM lineitem GROUP BY l_returnflag""",
    """SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS c, round(covar_pop(l_quantity, l_discount), 6) AS cp, round(covar_samp(l_quantity, l_discount), 6) AS cs, round(stddev(l_quantity), 6) AS sd,
    round(stddev_pop(l_quantity), 6) AS sp, round(var_samp(l_quantity), 5) AS v, round(var_pop(l_quantity), 5) AS vp FROM lineitem GROUP BY l_returnflag""",
)
sql(
    "agg_regression",
    """SELECT l_linestatus, round(regr_avgx(l_extendedprice, l_quantity), 4) AS ax, round(regr_avgy(l_extendedprice, l_quantity), 4) AS ay, regr_count(l_extendedprice, l_quantity) AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS s,
    round(regr_intercept(l_extendedprice, l_quantity), 3) AS i, round(regr_r2(l_extendedprice, l_quantity), 6) AS r, round(regr_sxx(l_extendedprice, l_quantity), 2) AS xx, round(regr_sxy(l_tax, l_discount), 4) AS xy, round(regr_syy(l_tax, l_discount), 4) AS yy FROM lineitem GROUP BY l_linestatus""",
    """SELECT l_linestatus, round(regr_avgx(l_extendedprice, l_quantity), 4) AS ax, round(regr_avgy(l_extendedprice, l_quantity), 4) AS ay, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS s,
    round(regr_intercept(l_extendedprice, l_quantity), 3) AS i, round(regr_r2(l_extendedprice, l_quantity), 6) AS r, round(regr_sxx(l_extendedprice, l_quantity), 2) AS xx, round(regr_sxy(l_tax, l_discount), 4) AS xy, round(regr_syy(l_tax, l_discount), 4) AS yy FROM lineitem GROUP BY l_linestatus""",
)
sql("agg_bool_bit", "SELECT l_returnflag, bool_and(l_quantity > 0) AS ba, bool_or(l_tax > 0.07) AS bo, bit_and(l_linenumber) AS a, bit_or(l_linenumber) AS o, bit_xor(l_linenumber) AS x FROM lineitem GROUP BY l_returnflag")
sql("agg_string_agg", "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
sql("agg_array_agg_ordered", "SELECT n_regionkey, array_to_string(array_agg(n_nationkey ORDER BY n_name DESC), ',') AS ids FROM nation GROUP BY n_regionkey")
sql("agg_array_agg_nulls", "SELECT d.lang, array_length(array_agg(l.quality)) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.lang", "SELECT d.lang, CAST(len(array_agg(l.quality)) AS INT) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.lang")
sql("agg_array_agg_distinct", "SELECT d.lang, array_length(array_agg(DISTINCT l.quality)) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.lang", "SELECT d.lang, CAST(count(DISTINCT l.quality) + max(CASE WHEN l.quality IS NULL THEN 1 ELSE 0 END) AS INT) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.lang")
sql(
    "agg_first_last_nth",
    "SELECT n_regionkey, first_value(n_name ORDER BY n_name) AS f, last_value(n_name ORDER BY n_name) AS l, nth_value(n_name, 2 ORDER BY n_name) AS s FROM nation GROUP BY n_regionkey",
    "SELECT n_regionkey, first(n_name ORDER BY n_name) AS f, last(n_name ORDER BY n_name) AS l, list(n_name ORDER BY n_name)[2] AS s FROM nation GROUP BY n_regionkey",
)
sql("agg_median", "SELECT o_orderstatus, round(median(o_totalprice), 4) AS m FROM orders GROUP BY o_orderstatus")
sql("agg_min_max_avg", "SELECT o_orderpriority, min(o_totalprice) AS a, max(o_totalprice) AS b, round(mean(o_totalprice), 4) AS c FROM orders GROUP BY o_orderpriority")
sql("agg_approx_distinct", "SELECT approx_distinct(o_custkey) AS n FROM orders", None)
sql("agg_approx_median", "SELECT approx_median(l_quantity) AS m, approx_percentile_cont(l_extendedprice, 0.9) AS p FROM lineitem", None)
sql("agg_approx_weighted", "SELECT approx_percentile_cont_with_weight(l_quantity, l_linenumber, 0.5) AS p FROM lineitem", "SELECT quantile_cont(l_quantity, 0.5) AS p FROM (SELECT l_quantity, unnest(range(l_linenumber)) FROM lineitem) t")

sql("sub_scalar_select", "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders o WHERE o.o_custkey = c.c_custkey) AS most FROM customer c")
sql("sub_from", "SELECT t.s, count(*) AS n FROM (SELECT o_orderstatus AS s FROM orders WHERE o_totalprice > 100000) t GROUP BY t.s")
sql("sub_correlated_where", "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT 1.8 * avg(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
sql("sub_in", "SELECT n_name FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
sql("cte", "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY o_custkey), top AS (SELECT o_custkey FROM big WHERE t > 1500000) SELECT c_name FROM customer JOIN top ON c_custkey = o_custkey")
sql("cte_recursive", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 20) SELECT n FROM t")
sql("union_all", "SELECT n_nationkey AS k FROM nation UNION ALL SELECT s_nationkey FROM supplier")
sql("union_distinct", "SELECT n_nationkey AS k FROM nation UNION SELECT s_nationkey FROM supplier")
sql("intersect", "SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal > 9500")
sql("except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal > 9900")

WINDOWED = "SELECT o_orderkey, {f} FROM orders"
BY = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"
sql("win_ranking", WINDOWED.format(f=f"row_number() OVER ({BY}) AS rn, rank() OVER ({BY}) AS r, dense_rank() OVER ({BY}) AS d, ntile(3) OVER ({BY}) AS t, round(percent_rank() OVER ({BY}), 6) AS p, round(cume_dist() OVER ({BY}), 6) AS c"),
    WINDOWED.format(f=f"CAST(row_number() OVER ({BY}) AS INT) AS rn, CAST(rank() OVER ({BY}) AS INT) AS r, CAST(dense_rank() OVER ({BY}) AS INT) AS d, CAST(ntile(3) OVER ({BY}) AS INT) AS t, round(percent_rank() OVER ({BY}), 6) AS p, round(cume_dist() OVER ({BY}), 6) AS c"))
sql("win_lag_lead", WINDOWED.format(f=f"lag(o_totalprice) OVER ({BY}) AS a, lead(o_totalprice, 2, 0.0) OVER ({BY}) AS b"))
sql("win_first_last_nth", WINDOWED.format(f=f"first_value(o_orderkey) OVER ({BY}) AS a, last_value(o_orderkey) OVER ({BY}) AS b, nth_value(o_orderkey, 2) OVER ({BY}) AS c"))
sql("win_rows_frame", WINDOWED.format(f=f"round(sum(o_totalprice) OVER ({BY} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 2) AS s"))
sql("win_range_frame", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS n FROM part")
sql("win_named", "SELECT o_orderkey, max(o_totalprice) OVER w AS m, min(o_totalprice) OVER w AS l FROM orders WINDOW w AS (PARTITION BY o_custkey)")
sql("win_running_total", WINDOWED.format(f=f"round(sum(o_totalprice) OVER ({BY}), 2) AS running"))
sql("win_filter_over", WINDOWED.format(f="round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F') OVER (PARTITION BY o_custkey), 2) AS s, count(*) FILTER (WHERE o_totalprice > 100000) OVER w AS n") + " WINDOW w AS (PARTITION BY o_custkey)")
sql("win_groups_sql", "SELECT p.p_partkey, count(*) OVER (PARTITION BY p.p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n, sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size DESC GROUPS 2 PRECEDING) AS s FROM part p WHERE p_size < 40",
    "SELECT p.p_partkey, count(*) OVER (PARTITION BY p.p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n, CAST(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size DESC GROUPS 2 PRECEDING) AS BIGINT) AS s FROM part p WHERE p_size < 40")
sql("win_order_nulls", "SELECT d.doc_id, row_number() OVER (PARTITION BY d.lang ORDER BY l.quality DESC, d.doc_id) AS n, row_number() OVER (PARTITION BY d.lang ORDER BY l.quality NULLS FIRST, d.doc_id) AS m FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "SELECT d.doc_id, CAST(row_number() OVER (PARTITION BY d.lang ORDER BY l.quality DESC NULLS FIRST, d.doc_id) AS INT) AS n, CAST(row_number() OVER (PARTITION BY d.lang ORDER BY l.quality NULLS FIRST, d.doc_id) AS INT) AS m FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")


@frame("win_groups_frame", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n FROM part")
def win_groups_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rivulet.operators.windows import over_groups

    return over_groups(load(spark, sf_dir, "part"), "count(*)", "n", ["p_brand"], "p_size", 1, 1).select("p_partkey", "n")
