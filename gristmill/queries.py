"""Registered queries of the metrics engine and of the SQL and function families, with equivalent SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill import function_queries, model_queries
from gristmill.functions.dialect import bind_logical_time, to_spark
from gristmill.models.retail import engine
from gristmill.operators import relational
from gristmill.sources.tables import period_filter, write
from gristmill.streaming.incremental import windowed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def rounded(df: DataFrame, places: int = 4) -> DataFrame:
    return df.select(*[F.round(F.col(f"`{c}`"), places).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def _add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, folder: rounded(query(spark, folder))
    if sql:
        ORACLE[name] = sql


def _metrics(name: str, sql: str | None, *args, **options) -> None:
    _add(name, lambda spark, folder: engine(spark, folder).query(*args, **options), sql)


def _spark_sql(name: str, text: str, sql: str | None = None) -> None:
    """Spark SQL over the tables; ``sql`` where DuckDB needs another text, '' for none."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        own = f"q{uuid.uuid4().hex[:8]}_"
        used = [t for t in TABLES if "{" + t + "}" in text]
        for t in used:
            spark.read.parquet(f"{folder}/{t}.parquet").createOrReplaceTempView(own + t)
        return spark.sql(to_spark(text.format(**{t: own + t for t in used})))

    _add(name, run, (text if sql is None else sql).format(**{t: t for t in TABLES}) or None)


REV = "CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 4))"
ITEMS = "lineitem LEFT JOIN orders ON l_orderkey = o_orderkey"
#: What the model says, as SQL: dimensions that both facts reach, and what is made of the orders.
COMMON = """
SELECT * FROM (VALUES ('order_dim.o_orderkey'), ('supplier.s_suppkey[supplier]'), ('part.p_partkey'), ('day.d[ship]'), ('day.d[order]'),
  ('customer.c_custkey[customer]'), ('nation.n_nationkey[supplier]'), ('nation.n_nationkey[customer]'),
  ('region.r_regionkey[supplier]'), ('region.r_regionkey[customer]')) AS t(attribute)
"""
DOWNSTREAM = """
SELECT * FROM (VALUES ('day'), ('order_facts'), ('order_dim'), ('order_value'), ('order_count'), ('buyers'), ('average_order'), ('value_share'),
  ('value_rank'), ('month_change'), ('trailing_quarter'), ('revenue_per_order'), ('order_index'), ('cross_change')) AS t(name)
"""
OM = "CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INTEGER)"

# The metrics engine -------------------------------------------------------------------------------------------------

_metrics(
    "metric_revenue_by_nation_priority",
    f"""
SELECT coalesce(n_name, 'unknown') AS n_name_customer, o_orderpriority, round(CAST(sum({REV}) AS DOUBLE), 4) AS revenue,
  round(avg(l_extendedprice), 4) AS average_price
FROM {ITEMS}
LEFT JOIN customer ON o_custkey = c_custkey
LEFT JOIN nation ON c_nationkey = n_nationkey
GROUP BY 1, 2
""",
    ["revenue", "average_price"],
    ["nation.n_name[customer]", "order_dim.o_orderpriority"],
)
_metrics("metric_scalar", f"SELECT round(CAST(sum({REV}) AS DOUBLE), 4) AS revenue, count(*) AS items FROM lineitem", ["revenue", "items"])
_metrics(
    "metric_single_sum_local",
    "SELECT l_returnflag, round(sum(l_quantity), 4) AS quantity FROM lineitem GROUP BY 1",
    ["quantity"],
    ["item_facts.l_returnflag"],
)
_metrics(
    "metric_decomposed_statistics",
    "SELECT l_linestatus, round(stddev_samp(l_extendedprice), 4) AS price_stddev, round(var_pop(l_extendedprice), 4) AS price_variance, round(corr(l_quantity, l_extendedprice), 4) AS quantity_price_corr, round(covar_samp(l_quantity, l_extendedprice), 4) AS quantity_price_covar, max(l_extendedprice) - min(l_extendedprice) AS price_spread FROM lineitem GROUP BY 1".replace("max(l_extendedprice) - min(l_extendedprice)", "round(max(l_extendedprice) - min(l_extendedprice), 4)"),
    ["price_stddev", "price_variance", "quantity_price_corr", "quantity_price_covar", "price_spread"],
    ["item_facts.l_linestatus"],
)
_metrics(
    "metric_count_if_min_max",
    """
SELECT l_returnflag, count(*) FILTER (WHERE l_returnflag = 'R') AS returned_items, round(max(l_extendedprice), 4) AS highest_price,
  round(min(l_extendedprice), 4) AS lowest_price
FROM lineitem
GROUP BY 1
""",
    ["returned_items", "highest_price", "lowest_price"],
    ["item_facts.l_returnflag"],
)
_metrics(
    "metric_distinct_limited",
    """
SELECT p_brand, count(DISTINCT l_orderkey) AS shipped_orders, round(sum(l_quantity), 4) AS quantity
FROM lineitem
LEFT JOIN part ON l_partkey = p_partkey
GROUP BY 1
""",
    ["shipped_orders", "quantity"],
    ["part.p_brand"],
)
_metrics(
    "metric_distinct_expression_level",
    """
SELECT l_linestatus, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_orderkey END) AS orders_returned
FROM lineitem
GROUP BY 1
""",
    ["orders_returned"],
    ["item_facts.l_linestatus"],
)
_metrics(
    "metric_not_decomposable",
    """
SELECT l_returnflag, arg_max(l_partkey, (l_extendedprice, l_partkey)) AS dearest_part, round(median(l_quantity), 4) AS median_quantity
FROM lineitem
GROUP BY 1
""",
    ["dearest_part", "median_quantity"],
    ["item_facts.l_returnflag"],
)
_metrics("metric_approximate_distinct", None, ["approximate_parts"], ["item_facts.l_returnflag"])
_metrics(
    "metric_ratio_safe_division",
    """
SELECT l_linestatus, round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) / nullif(sum(l_quantity), 0), 4) AS return_rate
FROM lineitem
GROUP BY 1
""",
    ["return_rate"],
    ["item_facts.l_linestatus"],
)
_metrics(
    "metric_multi_hop_role",
    f"""
SELECT r_name AS r_name_supplier, round(CAST(sum({REV}) AS DOUBLE), 4) AS revenue
FROM lineitem
LEFT JOIN supplier ON l_suppkey = s_suppkey
LEFT JOIN nation ON s_nationkey = n_nationkey
LEFT JOIN region ON n_regionkey = r_regionkey
GROUP BY 1
""",
    ["revenue"],
    ["region.r_name[supplier]"],
)
_metrics(
    "metric_two_roles",
    f"""
SELECT coalesce(c.n_name, 'unknown') AS n_name_customer, s.n_name AS n_name_supplier, round(CAST(sum({REV}) AS DOUBLE), 4) AS revenue
FROM {ITEMS}
LEFT JOIN customer ON o_custkey = c_custkey
LEFT JOIN nation c ON c_nationkey = c.n_nationkey
LEFT JOIN supplier ON l_suppkey = s_suppkey
LEFT JOIN nation s ON s_nationkey = s.n_nationkey
GROUP BY 1, 2
""",
    ["revenue"],
    ["nation.n_name[customer]", "nation.n_name[supplier]"],
)
_metrics(
    "metric_join_elision_full",
    "SELECT l_partkey AS p_partkey, round(sum(l_quantity), 4) AS quantity FROM lineitem GROUP BY 1",
    ["quantity"],
    ["part.p_partkey"],
)
_metrics(
    "metric_join_elision_partial",
    "SELECT c_nationkey AS n_nationkey_customer, count(o_orderkey) AS order_count FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1".replace("c_nationkey AS", "coalesce(c_nationkey, NULL) AS"),
    ["order_count"],
    ["nation.n_nationkey[customer]"],
)
_metrics(
    "metric_reference_dimension",
    "SELECT o_orderpriority, count(o_orderkey) AS order_count FROM orders GROUP BY 1",
    ["order_count"],
    ["order_dim.o_orderpriority"],
)
_metrics(
    "metric_theta_link",
    """
WITH b AS (SELECT * FROM (VALUES (0, 50000.0, 'low'), (1, 150000.0, 'middle'), (2, 1e12, 'high')) AS t(band, upto, label))
SELECT label, count(o_orderkey) AS order_count
FROM orders
JOIN b ON o_totalprice >= upto / 3 AND o_totalprice < upto
GROUP BY 1
""",
    ["order_count"],
    ["price_band.label"],
)
_metrics(
    "metric_filters_and_having",
    """
SELECT c_mktsegment AS c_mktsegment_customer, round(sum(o_totalprice), 4) AS order_value
FROM orders
LEFT JOIN customer ON o_custkey = c_custkey
WHERE o_orderstatus = 'F' AND c_acctbal > 0
GROUP BY 1
HAVING sum(o_totalprice) > 1000 AND count(o_orderkey) > 2
""",
    ["order_value"],
    ["customer.c_mktsegment[customer]"],
    filters=["order_facts.o_orderstatus = 'F'", "customer.c_acctbal[customer] > :least", "order_value > 1000", "order_count > 2"],
    parameters={"least": 0},
)
_metrics(
    "metric_order_limit",
    """
SELECT o_custkey AS c_custkey_customer, round(sum(o_totalprice), 4) AS order_value
FROM orders
GROUP BY 1
ORDER BY sum(o_totalprice) DESC, 1
LIMIT 10
""",
    ["order_value"],
    ["customer.c_custkey[customer]"],
    orderby=["order_value DESC", "customer.c_custkey[customer]"],
    limit=10,
)
_metrics(
    "metric_cross_fact",
    f"""
WITH a AS (SELECT o_orderpriority, CAST(sum({REV}) AS DOUBLE) AS revenue FROM {ITEMS} GROUP BY 1),
  b AS (SELECT o_orderpriority, sum(o_totalprice) AS order_value, count(DISTINCT o_custkey) AS buyers FROM orders GROUP BY 1)
SELECT o_orderpriority, round(revenue, 4) AS revenue, round(order_value, 4) AS order_value, buyers
FROM a
FULL JOIN b USING (o_orderpriority)
""",
    ["revenue", "order_value", "buyers"],
    ["order_dim.o_orderpriority"],
)
_metrics(
    "metric_derived_cross_fact",
    f"""
WITH a AS (SELECT o_orderpriority, CAST(sum({REV}) AS DOUBLE) AS r FROM {ITEMS} GROUP BY 1),
  b AS (SELECT o_orderpriority, count(o_orderkey) AS n FROM orders GROUP BY 1)
SELECT o_orderpriority, round(r / n, 4) AS revenue_per_order
FROM a
FULL JOIN b USING (o_orderpriority)
""",
    ["revenue_per_order"],
    ["order_dim.o_orderpriority"],
)
_metrics(
    "metric_derived_nested",
    "WITH a AS (SELECT o_orderpriority, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) / sum(l_quantity) AS r FROM " + ITEMS + " GROUP BY 1), b AS (SELECT o_orderpriority, avg(o_totalprice) AS v FROM orders GROUP BY 1) SELECT o_orderpriority, round(v / 1000 * r, 4) AS order_index FROM a FULL JOIN b USING (o_orderpriority)",
    ["order_index"],
    ["order_dim.o_orderpriority"],
)
_metrics(
    "metric_three_facts_by_day",
    """
WITH a AS (SELECT CAST(l_shipdate AS DATE) AS d, sum(l_quantity) AS q FROM lineitem GROUP BY 1),
  b AS (SELECT CAST(o_orderdate AS DATE) AS d, sum(o_totalprice) AS v FROM orders GROUP BY 1),
  c AS (SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1)
SELECT d, round(q, 4) AS quantity, round(v, 4) AS order_value, n AS event_count
FROM a
FULL JOIN b USING (d)
FULL JOIN c USING (d)
""",
    ["quantity", "order_value", "event_count"],
    ["day.d"],
)
_metrics(
    "metric_on_dimension",
    "SELECT c_mktsegment, count(c_custkey) AS customers_known FROM customer GROUP BY 1",
    ["customers_known"],
    ["customer.c_mktsegment"],
)
_metrics(
    "metric_window_share",
    """
SELECT o_orderpriority, round(sum(o_totalprice), 4) AS order_value, round(sum(o_totalprice) / sum(sum(o_totalprice)) OVER (), 4) AS value_share
FROM orders
GROUP BY 1
""",
    ["order_value", "value_share"],
    ["order_dim.o_orderpriority"],
)
_metrics(
    "metric_window_rank",
    """
SELECT o_orderpriority, CAST(rank() OVER (PARTITION BY o_orderpriority ORDER BY sum(o_totalprice) DESC) AS INTEGER) AS value_rank
FROM orders
GROUP BY 1
""",
    ["value_rank"],
    ["order_dim.o_orderpriority"],
)
_metrics(
    "metric_window_lag",
    f"""
WITH m AS (SELECT {OM} AS month_order, sum(o_totalprice) AS v FROM orders GROUP BY 1)
SELECT month_order, round((v - lag(v) OVER (ORDER BY month_order)) / lag(v) OVER (ORDER BY month_order), 4) AS month_change
FROM m
""",
    ["month_change"],
    ["day.month[order]"],
)
_metrics(
    "metric_window_lag_partitioned",
    f"""
WITH m AS (SELECT o_orderpriority, {OM} AS month_order, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2),
  w AS (SELECT *, lag(v) OVER (PARTITION BY o_orderpriority ORDER BY month_order) AS p FROM m)
SELECT o_orderpriority, month_order, round((v - p) / p, 4) AS month_change
FROM w
""",
    ["month_change"],
    ["order_dim.o_orderpriority", "day.month[order]"],
)
_metrics(
    "metric_window_lag_coarser_grain",
    f"""
WITH d AS (SELECT CAST(o_orderdate AS DATE) AS d_order, {OM} AS month_order, sum(o_totalprice) AS order_value FROM orders GROUP BY 1, 2),
  m AS (SELECT {OM} AS month_order, sum(o_totalprice) AS v FROM orders GROUP BY 1), w AS (SELECT *, lag(v) OVER (ORDER BY month_order) AS p FROM m)
SELECT d_order, month_order, round(order_value, 4) AS order_value, round((v - p) / p, 4) AS month_change
FROM d
JOIN w USING (month_order)
""",
    ["order_value", "month_change"],
    ["day.d[order]", "day.month[order]"],
)
_metrics(
    "metric_window_trailing",
    f"""
WITH m AS (SELECT {OM} AS month_order, sum(o_totalprice) AS v FROM orders GROUP BY 1)
SELECT month_order, round(sum(v) OVER (ORDER BY month_order ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS trailing_quarter
FROM m
""",
    ["trailing_quarter"],
    ["day.month[order]"],
)
_metrics(
    "metric_window_look_back",
    f"""
WITH m AS (SELECT {OM} AS month_order, sum(o_totalprice) AS v FROM orders GROUP BY 1),
  w AS (SELECT month_order, sum(v) OVER (ORDER BY month_order ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS t FROM m)
SELECT month_order, round(t, 4) AS trailing_quarter
FROM w
WHERE month_order BETWEEN 199706 AND 199802
""",
    ["trailing_quarter"],
    ["day.month[order]"],
    filters=["day.month[order] BETWEEN 199706 AND 199802"],
)
_metrics(
    "metric_window_cross_fact",
    f"""
WITH a AS (SELECT {OM} AS month_order, CAST(sum({REV}) AS DOUBLE) AS r FROM {ITEMS} GROUP BY 1),
  b AS (SELECT {OM} AS month_order, count(*) AS n FROM orders GROUP BY 1),
  c AS (SELECT month_order, r / n AS x FROM a FULL JOIN b USING (month_order))
SELECT month_order, round(x - lag(x) OVER (ORDER BY month_order), 4) AS cross_change
FROM c
""",
    ["cross_change"],
    ["day.month[order]"],
)
_metrics(
    "metric_densified",
    """
WITH s AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1996-02-15'
  UNION SELECT DISTINCT CAST(l_shipdate AS DATE) FROM lineitem WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1996-02-15')
SELECT d, 0::BIGINT AS event_count
FROM s
""",
    ["event_count", "trailing_events"],
    ["day.d"],
    filters=["day.d BETWEEN DATE '1996-01-01' AND DATE '1996-02-15'"],
    densify=True,
)
ORACLE["metric_densified"] = """
WITH s AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1996-02-15'
  UNION SELECT DISTINCT CAST(l_shipdate AS DATE) FROM lineitem WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1996-02-15'),
  e AS (SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1), j AS (SELECT s.d, coalesce(n, 0) AS n FROM s LEFT JOIN e USING (d))
SELECT d, n AS event_count, CAST(sum(n) OVER (ORDER BY d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS BIGINT) AS trailing_events
FROM j
"""
_add(
    "metric_cube",
    lambda s, d: engine(s, d).cube("sales"),
    """
SELECT c_mktsegment AS c_mktsegment_customer, CAST(year(o_orderdate) AS INTEGER) AS year_order, round(sum(o_totalprice), 4) AS order_value,
  count(o_orderkey) AS order_count
FROM orders
LEFT JOIN customer ON o_custkey = c_custkey
WHERE year(o_orderdate) >= 1996
GROUP BY 1, 2
""",
)
_add(
    "metric_cube_dimension_values",
    lambda s, d: engine(s, d).dimension_values("sales", counts=True),
    """
SELECT c_mktsegment AS c_mktsegment_customer, CAST(year(o_orderdate) AS INTEGER) AS year_order, count(*) AS count
FROM orders
LEFT JOIN customer ON o_custkey = c_custkey
WHERE year(o_orderdate) >= 1996
GROUP BY 1, 2
""",
)
_add(
    "metric_node_query",
    lambda s, d: engine(s, d).node("order_facts", ["customer.c_mktsegment[customer]"], ["nation.n_name[customer] <> 'FRANCE'"]).select("o_orderkey", "o_totalprice", "c_mktsegment_customer"),
    """
SELECT o_orderkey, round(o_totalprice, 4) AS o_totalprice, c_mktsegment AS c_mktsegment_customer
FROM orders
LEFT JOIN customer ON o_custkey = c_custkey
LEFT JOIN nation ON c_nationkey = n_nationkey
WHERE coalesce(n_name, 'unknown') <> 'FRANCE'
""",
)
_add(
    "metric_sql_front_end",
    lambda s, d: engine(s, d).sql("SELECT customer.c_mktsegment[customer], order_value, order_count FROM metrics WHERE order_facts.o_orderstatus = 'O' GROUP BY customer.c_mktsegment[customer] ORDER BY order_value DESC LIMIT 3"),
    """
SELECT c_mktsegment AS c_mktsegment_customer, round(sum(o_totalprice), 4) AS order_value, count(o_orderkey) AS order_count
FROM orders
LEFT JOIN customer ON o_custkey = c_custkey
WHERE o_orderstatus = 'O'
GROUP BY 1
ORDER BY sum(o_totalprice) DESC
LIMIT 3
""",
)
_add(
    "metric_combined_measures",
    lambda s, d: (lambda df: df.select("o_orderpriority", *[F.col(c).alias("value_sum" if c.startswith("o_totalprice") else "quantity_sum") for c in df.columns[1:]]))(engine(s, d).combined_measures(["order_value", "quantity"], ["order_dim.o_orderpriority"])),
    "WITH a AS (SELECT o_orderpriority, sum(l_quantity) AS q FROM " + ITEMS + " GROUP BY 1), b AS (SELECT o_orderpriority, sum(o_totalprice) AS v FROM orders GROUP BY 1) SELECT o_orderpriority, round(v, 4) AS value_sum, round(q, 4) AS quantity_sum FROM a FULL JOIN b USING (o_orderpriority)",
)


def _folder(spark: SparkSession) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="gristmill-")
    return f"{shared.rstrip('/')}/rollup-{uuid.uuid4().hex}"


def _rollup(spark: SparkSession, folder: str) -> DataFrame:
    e, at = engine(spark, folder), _folder(spark)
    e.materialize("daily", ["order_value", "order_count", "average_order"], ["customer.c_custkey[customer]", "day.month[order]"], lambda df, n: write(df, f"{at}/{n}"))
    out = e.query(["order_value", "order_count"], ["customer.c_mktsegment[customer]"], ["day.month[order] >= 199701"])
    if not e.used:
        raise AssertionError("the rollup was not used")
    return out


_add(
    "metric_rollup_substitution",
    _rollup,
    """
SELECT c_mktsegment AS c_mktsegment_customer, round(sum(o_totalprice), 4) AS order_value, count(o_orderkey) AS order_count
FROM orders
LEFT JOIN customer ON o_custkey = c_custkey
WHERE year(o_orderdate) * 100 + month(o_orderdate) >= 199701
GROUP BY 1
""",
)


def _filtered_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Three requests beside a rollup of orders from 1996 on: all rows, tighter rows, the same rows."""
    e, at = engine(spark, folder), _folder(spark)
    e.materialize("late", ["order_value", "order_count"], ["order_facts.o_orderstatus", "day.year[order]"], lambda df, n: write(df, f"{at}/{n}"), ["day.year[order] >= 1996"])
    out, used = [], []
    for kind, filters in (("all", []), ("tighter", ["day.year[order] > 1996 AND order_facts.o_orderstatus <> 'P'"]), ("same", ["day.year[order] >= 1996"])):
        out.append(e.query(["order_count"], ["order_facts.o_orderstatus"], filters).select(F.lit(kind).alias("kind"), "*"))
        used.append(bool(e.used))
    if used != [False, True, True]:
        raise AssertionError(f"the rollup was used for {used}")
    return out[0].union(out[1]).union(out[2])


_add(
    "metric_rollup_filtered",
    _filtered_rollup,
    """
SELECT 'all' AS kind, o_orderstatus, count(o_orderkey) AS order_count FROM orders GROUP BY 2
UNION ALL SELECT 'tighter', o_orderstatus, count(o_orderkey) FROM orders WHERE year(o_orderdate) > 1996 AND o_orderstatus <> 'P' GROUP BY 2
UNION ALL SELECT 'same', o_orderstatus, count(o_orderkey) FROM orders WHERE year(o_orderdate) >= 1996 GROUP BY 2
""",
)
_metrics(
    "metric_filter_functions",
    """
SELECT o_orderstatus, count(o_orderkey) AS order_count FROM orders
WHERE CAST(o_totalprice AS FLOAT) > 1000 AND CAST(o_orderdate AS DATE) < CURRENT_DATE AND EXTRACT(YEAR FROM o_orderdate) IN (1995, 1996, 1997)
  AND upper(substr(o_orderpriority, 1, 1)) BETWEEN '1' AND '3'
GROUP BY 1
""",
    ["order_count"],
    ["order_facts.o_orderstatus"],
    filters=[
        "CAST(order_facts.o_totalprice AS FLOAT) > 1000 AND order_facts.o_day < CURRENT_DATE",
        "EXTRACT(YEAR FROM order_facts.o_day) IN (1995, 1996, 1997)",
        "upper(substr(order_facts.o_orderpriority, 1, 1)) BETWEEN '1' AND '3' AND exists(array(1, 2), x -> x > 1)",
    ],
)
_metrics(
    "metric_more_aggregates",
    """
SELECT l_returnflag, any_value(l_returnflag) AS some_flag, round(stddev_pop(l_quantity), 4) AS quantity_stddev_pop, round(var_samp(l_quantity), 4) AS quantity_var_samp,
  round(covar_pop(l_quantity, l_tax), 4) AS quantity_tax_covar_pop, min_by(l_linenumber, l_orderkey * 10 + l_linenumber) AS first_line,
  round(variance(l_tax), 4) AS tax_variance, round(stddev(l_tax), 4) AS tax_stddev
FROM lineitem GROUP BY 1
""",
    ["some_flag", "quantity_stddev_pop", "quantity_var_samp", "quantity_tax_covar_pop", "first_line", "tax_variance", "tax_stddev"],
    ["item_facts.l_returnflag"],
)
_metrics(
    "metric_mixed_kinds",
    """
SELECT l_returnflag, round(sum(l_quantity) / median(l_quantity), 4) AS quantity_per_median, count(DISTINCT l_orderkey) AS shipped_orders, count(*) AS items
FROM lineitem GROUP BY 1
""",
    ["quantity_per_median", "shipped_orders", "items"],
    ["item_facts.l_returnflag"],
)


def _incremental(spark: SparkSession, folder: str) -> DataFrame:
    e, at = engine(spark, folder), _folder(spark)
    build = lambda t: e.query(["order_value"], ["day.month[order]"], []).where(period_filter(F.col("month_order"), t, "2 months", "yyyyMM"))
    for t in ("1996-03-01 00:00:00", "1996-05-01 00:00:00"):
        out = write(build(t), at, "incremental_time", ["month_order"])
    return out.select(F.col("month_order").cast("int").alias("month_order"), "order_value")


_add(
    "sink_incremental_backfill",
    _incremental,
    f"""
SELECT {OM} AS month_order, round(sum(o_totalprice), 4) AS order_value
FROM orders
WHERE {OM} BETWEEN 199601 AND 199605
GROUP BY 1
""",
)
_add(
    "model_common_dimensions",
    lambda s, d: s.createDataFrame([(str(a),) for a in engine(s, d).registry.common_dimensions(["revenue", "order_count"])], "attribute string"),
    COMMON,
)
_add(
    "model_lineage",
    lambda s, d: s.createDataFrame([(c, x) for c, own in engine(s, d).lineage("order_facts").items() for x in own], "column string, source string"),
    """
SELECT *
FROM (VALUES ('o_orderkey', 'orders.o_orderkey'), ('o_custkey', 'orders.o_custkey'), ('o_orderstatus', 'orders.o_orderstatus'), ('o_totalprice',
  'orders.o_totalprice'), ('o_orderpriority', 'orders.o_orderpriority'), ('o_day', 'orders.o_orderdate')) AS t(\"column\", source)
""",
)
_add("model_downstream", lambda s, d: s.createDataFrame([(x,) for x in engine(s, d).registry.downstream("orders")], "name string"), DOWNSTREAM)

# Relational operators of node SQL -----------------------------------------------------------------------------------

_spark_sql("sql_distinct_union", "SELECT n_nationkey AS k FROM {nation} WHERE n_regionkey = 1 UNION SELECT n_nationkey FROM {nation} WHERE n_nationkey < 5")
_spark_sql(
    "sql_intersect_except",
    """
(SELECT n_nationkey AS k FROM {nation} INTERSECT SELECT n_nationkey FROM {nation} WHERE n_nationkey < 15)
EXCEPT
SELECT n_nationkey
FROM {nation}
WHERE n_regionkey = 2
""",
)
_spark_sql(
    "sql_semi_anti",
    """
SELECT c_custkey
FROM {customer}
WHERE c_custkey IN (SELECT o_custkey FROM {orders} WHERE o_totalprice > 100000) AND NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND
  o_orderstatus = 'P')
""",
)
_spark_sql("sql_scalar_subquery", "SELECT o_orderkey FROM {orders} WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM {orders})")
_spark_sql(
    "sql_rollup",
    """
SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) AS INT) AS g, count(*) AS n
FROM {lineitem}
GROUP BY ROLLUP (l_returnflag, l_linestatus)
""",
)
_spark_sql("sql_cube", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 3) AS q FROM {lineitem} GROUP BY CUBE (l_returnflag, l_linestatus)")
_spark_sql("sql_grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
_spark_sql(
    "sql_predicates",
    """
SELECT p_partkey, p_brand LIKE 'Brand#1%' AS a, p_size BETWEEN 5 AND 10 AS b, (p_type IS NULL) AS c, p_name IS NOT DISTINCT FROM p_type AS d,
  (p_size > 10) IS TRUE AS e, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS f
FROM {part}
WHERE p_size IN (1, 2, 3, 7, 30) AND NOT p_retailprice < 0
""",
)
_spark_sql(
    "sql_window_functions",
    """
SELECT o_orderkey, row_number() OVER w AS rn, dense_rank() OVER w AS dr, round(percent_rank() OVER w, 3) AS pr, round(cume_dist() OVER w, 3) AS cd,
  ntile(4) OVER w AS nt, round(lead(o_totalprice) OVER w, 3) AS nx, round(first_value(o_totalprice) OVER w, 3) AS fv
FROM {orders}
WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey)
""",
    """
SELECT o_orderkey, CAST(row_number() OVER w AS INTEGER) AS rn, CAST(dense_rank() OVER w AS INTEGER) AS dr, round(percent_rank() OVER w, 3) AS pr,
  round(cume_dist() OVER w, 3) AS cd, CAST(ntile(4) OVER w AS INTEGER) AS nt, round(lead(o_totalprice) OVER w, 3) AS nx,
  round(first_value(o_totalprice) OVER w, 3) AS fv
FROM orders
WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey)
""",
)
_spark_sql(
    "sql_lateral_view",
    "SELECT n_nationkey, w FROM {nation} LATERAL VIEW explode(split(n_name, '[ _]')) t AS w",
    "SELECT n_nationkey, unnest(string_split_regex(n_name, '[ _]')) AS w FROM nation",
)
_spark_sql("sql_values_cross_join", "SELECT r_name, v.x AS x FROM {region} CROSS JOIN (VALUES (1), (2)) AS v(x)")
_spark_sql(
    "sql_using_full_join",
    """
SELECT k, a, b
FROM (SELECT n_nationkey AS k, n_name AS a FROM {nation} WHERE n_nationkey < 10)
FULL JOIN (SELECT s_nationkey AS k, count(*) AS b FROM {supplier} GROUP BY s_nationkey) USING (k)
""",
)
_spark_sql(
    "sql_tpch_q1",
    """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base,
  round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 3) AS avg_disc, count(*) AS n
FROM {lineitem}
WHERE l_shipdate <= TIMESTAMP '2000-09-02 00:00:00'
GROUP BY l_returnflag, l_linestatus
""",
)
_spark_sql(
    "sql_tpch_q3",
    """
SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM {customer}
JOIN {orders} ON c_custkey = o_custkey
JOIN {lineitem} ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15 00:00:00'
GROUP BY l_orderkey
ORDER BY sum(l_extendedprice * (1 - l_discount)) DESC, l_orderkey
LIMIT 10
""",
)
_spark_sql(
    "sql_tpch_q5",
    """
SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM {customer}
JOIN {orders} ON c_custkey = o_custkey
JOIN {lineitem} ON l_orderkey = o_orderkey
JOIN {supplier} ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
JOIN {nation} ON s_nationkey = n_nationkey
GROUP BY n_name
""",
)


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


_add(
    "op_asof_join",
    lambda s, d: relational.asof(_read(s, d, "events").where("event_type = 'purchase'").select("event_id", "user_id", "ts"), _read(s, d, "events").where("event_type <> 'purchase'").selectExpr("user_id", "ts AS seen", "event_id AS before_id"), ["user_id"], "ts", "seen", ["before_id"]).select("event_id", "before_id"),
    """
SELECT a.event_id, b.event_id AS before_id
FROM (SELECT * FROM events WHERE event_type = 'purchase') a ASOF
LEFT JOIN (SELECT * FROM events WHERE event_type <> 'purchase') b ON a.user_id = b.user_id AND a.ts >= b.ts
""",
)
_add(
    "op_range_join",
    lambda s, d: relational.range_join(_read(s, d, "part").select("p_partkey", "p_retailprice"), s.sql("SELECT id AS band, CAST(id * 150 AS DOUBLE) AS lo, CAST(id * 150 + 200 AS DOUBLE) AS hi FROM range(20)"), "p_retailprice", "lo", "hi", 200.0).groupBy("band").agg(F.count("*").alias("n")),
    """
SELECT id AS band, count(*) AS n
FROM part
JOIN (SELECT range AS id, range * 150.0 AS lo, range * 150.0 + 200 AS hi FROM range(20)) ON p_retailprice >= lo AND p_retailprice < hi
GROUP BY 1
""",
)
_add(
    "op_salted_join",
    lambda s, d: relational.skewed_join(_read(s, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("k")), _read(s, d, "orders").groupBy(F.col("o_orderpriority").alias("k")).agg(F.count("*").alias("n")), ["k"], 8).groupBy("k").agg(F.count("*").alias("rows"), F.max("n").alias("n")),
    "SELECT o_orderpriority AS k, count(*) AS rows, count(*) AS n FROM orders GROUP BY 1",
)
_add(
    "op_top_per_group",
    lambda s, d: relational.top_per_group(_read(s, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 2).select("o_custkey", "o_orderkey"),
    """
SELECT o_custkey, o_orderkey
FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2
""",
)
_add(
    "op_tumbling_windows",
    lambda s, d: windowed(_read(s, d, "events").withColumn("at", F.col("ts").cast("timestamp")), "at", "1 day", "1 hour", ["event_type"], [F.count("*").alias("n")]).select(F.to_date("window_start").alias("day"), "event_type", "n"),
    "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
)

# Function families --------------------------------------------------------------------------------------------------

_spark_sql(
    "fn_aggregates",
    """
SELECT l_returnflag AS k, count(*) AS a, count(DISTINCT l_partkey) AS b, round(avg(l_quantity), 3) AS c, round(stddev_pop(l_quantity), 3) AS d,
  round(var_samp(l_quantity), 3) AS e, round(covar_pop(l_quantity, l_tax), 3) AS f, max_by(l_orderkey, l_orderkey) AS g,
  min_by(l_orderkey, l_orderkey) AS h, bool_and(l_quantity > 0) AS i, round(median(l_tax), 3) AS j
FROM {lineitem}
GROUP BY l_returnflag
""",
    """
SELECT l_returnflag AS k, count(*) AS a, count(DISTINCT l_partkey) AS b, round(avg(l_quantity), 3) AS c, round(stddev_pop(l_quantity), 3) AS d,
  round(var_samp(l_quantity), 3) AS e, round(covar_pop(l_quantity, l_tax), 3) AS f, max(l_orderkey) AS g, min(l_orderkey) AS h,
  bool_and(l_quantity > 0) AS i, round(median(l_tax), 3) AS j
FROM lineitem
GROUP BY 1
""",
)
_spark_sql(
    "fn_collections_of_aggregates",
    """
SELECT n_regionkey AS k, array_join(array_sort(collect_list(n_name)), ',') AS a, array_join(array_sort(collect_set(n_name)), ',') AS b,
  array_join(array_sort(array_agg(n_name)), ',') AS c
FROM {nation}
GROUP BY n_regionkey
""",
    """
SELECT n_regionkey AS k, string_agg(n_name, ',' ORDER BY n_name) AS a, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS b,
  string_agg(n_name, ',' ORDER BY n_name) AS c
FROM nation
GROUP BY 1
""",
)
_spark_sql(
    "fn_strings",
    """
SELECT n_nationkey AS k, upper(n_name) AS a, lower(n_name) AS b, length(n_name) AS c, substring(n_name, 2, 3) AS d, replace(n_name, 'A', 'b') AS e,
  lpad(n_name, 12, '*') AS f, concat(n_name, '-', 'x') AS g, concat_ws('/', n_name, 'y') AS h, left(n_name, 2) AS i, instr(n_name, 'A') AS j,
  trim(concat('  ', n_name)) AS l, regexp_replace(n_name, '[AEIOU]', '') AS m, levenshtein(n_name, 'INDIA') AS o, contains(n_name, 'IN') AS p,
  ltrim(concat(' ', n_name)) AS q, strpos(n_name, 'I') AS r, contains_string(n_name, 'AN') AS s
FROM {nation}
""",
    """
SELECT n_nationkey AS k, upper(n_name) AS a, lower(n_name) AS b, CAST(length(n_name) AS INTEGER) AS c, substring(n_name, 2, 3) AS d,
  replace(n_name, 'A', 'b') AS e, lpad(n_name, 12, '*') AS f, concat(n_name, '-', 'x') AS g, concat_ws('/', n_name, 'y') AS h, left(n_name, 2) AS i,
  CAST(instr(n_name, 'A') AS INTEGER) AS j, trim(concat('  ', n_name)) AS l, regexp_replace(n_name, '[AEIOU]', '', 'g') AS m,
  CAST(levenshtein(n_name, 'INDIA') AS INTEGER) AS o, contains(n_name, 'IN') AS p, ltrim(concat(' ', n_name)) AS q,
  CAST(instr(n_name, 'I') AS INTEGER) AS r, contains(n_name, 'AN') AS s
FROM nation
""",
)
_spark_sql(
    "fn_math",
    """
SELECT p_partkey AS k, round(sqrt(p_size), 3) AS a, round(ln(p_size), 3) AS b, abs(-p_size) AS c, round(power(p_size, 2), 3) AS d,
  round(exp(p_size / 50.0D), 3) AS e, p_size % 7 AS f, round(cos(p_size), 3) AS g, greatest(p_size, 10) AS h, least(p_size, 10) AS i,
  round(degrees(p_size), 3) AS j, round(log10(p_size), 3) AS l, round(cbrt(p_size), 3) AS m, round(safe_divide(p_size, p_size - 1), 3) AS n,
  CAST(floor(p_retailprice) AS BIGINT) AS o, CAST(ceil(p_retailprice) AS BIGINT) AS q
FROM {part}
""",
    """
SELECT p_partkey AS k, round(sqrt(p_size), 3) AS a, round(ln(p_size), 3) AS b, abs(-p_size) AS c, round(power(p_size, 2), 3) AS d,
  round(exp(p_size / 50.0::DOUBLE), 3) AS e, p_size % 7 AS f, round(cos(p_size), 3) AS g, greatest(p_size, 10) AS h, least(p_size, 10) AS i,
  round(degrees(p_size), 3) AS j, round(log10(p_size), 3) AS l, round(cbrt(p_size), 3) AS m, round(p_size / nullif(p_size - 1, 0), 3) AS n,
  CAST(floor(p_retailprice) AS BIGINT) AS o, CAST(ceil(p_retailprice) AS BIGINT) AS q
FROM part
""",
)
_spark_sql(
    "fn_dates",
    """
SELECT o_orderkey AS k, year(o_orderdate) AS a, month(o_orderdate) AS b, day(o_orderdate) AS c, dayofyear(o_orderdate) AS d, week(o_orderdate) AS e,
  CAST(date_trunc('MONTH', o_orderdate) AS DATE) AS f, last_day(CAST(o_orderdate AS DATE)) AS g, date_add(CAST(o_orderdate AS DATE), 10) AS h,
  datediff(CAST(o_orderdate AS DATE), DATE '1995-01-01') AS i, date_format(o_orderdate, 'yyyyMMdd') AS j, unix_date(CAST(o_orderdate AS DATE)) AS l,
  hour(o_orderdate) AS m
FROM {orders}
""",
    """
SELECT o_orderkey AS k, CAST(year(o_orderdate) AS INTEGER) AS a, CAST(month(o_orderdate) AS INTEGER) AS b, CAST(day(o_orderdate) AS INTEGER) AS c,
  CAST(dayofyear(o_orderdate) AS INTEGER) AS d, CAST(weekofyear(o_orderdate) AS INTEGER) AS e, CAST(date_trunc('month', o_orderdate) AS DATE) AS f,
  last_day(o_orderdate) AS g, CAST(CAST(o_orderdate AS DATE) + 10 AS DATE) AS h,
  CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS i, strftime(o_orderdate, '%Y%m%d') AS j,
  CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS l, CAST(hour(o_orderdate) AS INTEGER) AS m
FROM orders
""",
)
_spark_sql(
    "fn_arrays",
    """
SELECT n_nationkey AS k, size(sequence(0, n_regionkey)) AS a, array_contains(array(1, 2, n_regionkey), 3) AS b,
  array_join(transform(sequence(1, 3), x -> CAST(x * n_nationkey AS STRING)), ',') AS c, aggregate(sequence(1, 4), 0, (acc, x) -> acc + x) AS d,
  array_max(array(n_nationkey, 7)) AS e, size(array_distinct(array(1, n_regionkey, 1))) AS f, array_length(array_concat(array(1), array(2, 3))) AS g,
  array_offset(array(5, 6), 1) AS h, array_ordinal(array(5, 6), 1) AS i, exists(array(1, n_regionkey), x -> x > 3) AS j
FROM {nation}
""",
    """
SELECT n_nationkey AS k, CAST(n_regionkey + 1 AS INTEGER) AS a, (n_regionkey = 3) AS b,
  concat_ws(',', CAST(n_nationkey AS VARCHAR), CAST(2 * n_nationkey AS VARCHAR), CAST(3 * n_nationkey AS VARCHAR)) AS c, 10 AS d,
  greatest(n_nationkey, 7) AS e, CASE WHEN n_regionkey = 1 THEN 1 ELSE 2 END AS f, 3 AS g, 6 AS h, 5 AS i, n_regionkey > 3 AS j
FROM nation
""",
)
_spark_sql(
    "fn_maps_structs",
    "SELECT n_nationkey AS k, element_at(map('a', n_regionkey), 'a') AS a, map_contains_key(map('x', 1), 'y') AS b, size(map_keys(map('p', 1, 'q', 2))) AS c, named_struct('u', n_name).u AS d, array_join(map_values(transform_values(map('p', n_regionkey), (q, v) -> v + 1)), ',') AS e FROM {nation}".replace("array_join(map_values(transform_values(map('p', n_regionkey), (q, v) -> v + 1)), ',')", "element_at(map_values(transform_values(map('p', n_regionkey), (q, v) -> v + 1)), 1)"),
    """
SELECT n_nationkey AS k, n_regionkey AS a, false AS b, 2 AS c, n_name AS d, n_regionkey + 1 AS e
FROM nation
""",
)
_spark_sql(
    "fn_json",
    """
SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS v, from_json(props, 'k INT').k AS w, json_array_length('[1,2,3]') AS n
FROM {events}
""",
    """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS v, CAST(json_extract_string(props, '$.k') AS INTEGER) AS w, 3 AS n
FROM events
""",
)
_spark_sql(
    "fn_conditional",
    """
SELECT s_suppkey AS k, coalesce(NULL, s_nationkey) AS a, nullif(s_nationkey, 3) AS b, nvl2(nullif(s_nationkey, 3), 1, 0) AS c,
  if(s_acctbal > 0, 'p', 'n') AS d, ifnull(nullif(s_nationkey, 4), -1) AS e, equal_null(s_nationkey, NULL) AS f, isnull(s_name) AS g
FROM {supplier}
""",
    """
SELECT s_suppkey AS k, s_nationkey AS a, nullif(s_nationkey, 3) AS b, CASE WHEN s_nationkey = 3 THEN 0 ELSE 1 END AS c,
  CASE WHEN s_acctbal > 0 THEN 'p' ELSE 'n' END AS d, CASE WHEN s_nationkey = 4 THEN -1 ELSE s_nationkey END AS e, false AS f, false AS g
FROM supplier
""",
)
_spark_sql(
    "fn_hashes",
    """
SELECT n_nationkey AS k, md5(n_name) AS a, sha2(n_name, 256) AS b, crc32(n_name) > 0 AS c, hex(n_name) AS d,
  from_big_endian_64(unhex('00000000000000FF')) AS e, decode(to_utf8(n_name), 'UTF-8') AS f
FROM {nation}
""",
    """
SELECT n_nationkey AS k, md5(n_name) AS a, sha256(n_name) AS b, true AS c, hex(n_name) AS d, 255::BIGINT AS e, n_name AS f
FROM nation
""",
)
_spark_sql(
    "fn_sketches",
    """
SELECT l_returnflag AS k, approx_count_distinct_ds_hll(l_partkey) AS a, approx_count_distinct_ds_theta(l_partkey) AS b,
  approx_percentile(l_quantity, 0.5D) AS c
FROM {lineitem}
GROUP BY l_returnflag
""",
    "",
)
_spark_sql(
    "fn_generators",
    """
SELECT n_nationkey AS k, u
FROM {nation}
LATERAL VIEW OUTER explode(if(n_regionkey > 2, array(1, n_regionkey), array())) t AS u
""",
    """
SELECT n_nationkey AS k, unnest(CASE WHEN n_regionkey > 2 THEN [1, n_regionkey] ELSE [NULL] END) AS u
FROM nation
""",
)
_add(
    "fn_logical_time",
    lambda s, d: s.sql(bind_logical_time("SELECT logical_timestamp('yyyyMMdd') AS day, logical_timestamp() AS at", "2024-05-06 07:00:00")),
    "SELECT '20240506' AS day, '2024-05-06 07:00:00' AS at",
)
function_queries.register(_spark_sql)
model_queries.register(_add, _folder)
