"""A semantic model of the order tables: two facts, shared dimensions with roles, and metrics of every kind."""

from __future__ import annotations

from pyspark.sql import SparkSession

from gristmill.plans.engine import Engine
from gristmill.plans.model import Registry
from gristmill.sources.tables import parquet_folder

#: Exact in decimals, so that the sum doesn't depend on the order of rows.
REVENUE = "CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 4))"


def registry() -> Registry:
    r = Registry()
    for name, key in (("lineitem", ("l_orderkey", "l_linenumber")), ("orders", ("o_orderkey",)), ("events", ("event_id",)), ("customers", ("c_custkey",)), ("suppliers", ("s_suppkey",)), ("parts", ("p_partkey",)), ("nations", ("n_nationkey",)), ("regions", ("r_regionkey",))):
        r.source(name, {"customers": "customer", "suppliers": "supplier", "parts": "part", "nations": "nation", "regions": "region"}.get(name, name), key)
    r.dimension("customer", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customers", ["c_custkey"])
    r.dimension("supplier", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM suppliers", ["s_suppkey"])
    r.dimension("part", "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM parts", ["p_partkey"])
    r.dimension("nation", "SELECT n_nationkey, n_name, n_regionkey FROM nations", ["n_nationkey"])
    r.dimension("region", "SELECT r_regionkey, r_name FROM regions", ["r_regionkey"])
    r.dimension("day", "SELECT DISTINCT d, year(d) AS year, year(d) * 100 + month(d) AS month, quarter(d) AS quarter FROM (SELECT CAST(o_orderdate AS DATE) AS d FROM orders UNION ALL SELECT CAST(l_shipdate AS DATE) AS d FROM lineitem)", ["d"], derived={"year": "year(d)", "month": "year(d) * 100 + month(d)", "quarter": "quarter(d)"})
    r.dimension("price_band", "SELECT * FROM VALUES (0, 50000.0, 'low'), (1, 150000.0, 'middle'), (2, 1e12, 'high') AS t(band, upto, label)", ["band"])
    r.transform("order_facts", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, CAST(o_orderdate AS DATE) AS o_day FROM orders", ["o_orderkey"])
    r.transform("item_facts", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, CAST(l_shipdate AS DATE) AS l_day FROM lineitem", ["l_orderkey", "l_linenumber"])
    r.dimension("order_dim", "SELECT o_orderkey, o_custkey, o_orderpriority, CAST(o_orderdate AS DATE) AS o_day FROM orders", ["o_orderkey"])
    r.transform("event_facts", "SELECT event_id, user_id, event_type, value, CAST(ts AS DATE) AS e_day FROM events", ["event_id"])
    r.link("item_facts", "order_dim", "item_facts.l_orderkey = order_dim.o_orderkey")
    r.link("item_facts", "supplier", "item_facts.l_suppkey = supplier.s_suppkey", role="supplier")
    r.link("item_facts", "part", "item_facts.l_partkey = part.p_partkey")
    r.link("item_facts", "day", "item_facts.l_day = day.d", role="ship", total=True)
    r.link("order_dim", "customer", "order_dim.o_custkey = customer.c_custkey", role="customer")
    r.link("order_dim", "day", "order_dim.o_day = day.d", role="order", total=True)
    r.link("order_facts", "customer", "order_facts.o_custkey = customer.c_custkey", role="customer")
    r.link("order_facts", "day", "order_facts.o_day = day.d", role="order", total=True)
    r.link("order_facts", "item_facts", "order_facts.o_orderkey = item_facts.l_orderkey", role="items", cardinality="one_to_many")
    r.link("order_facts", "price_band", "order_facts.o_totalprice >= price_band.upto / 3 AND order_facts.o_totalprice < price_band.upto", how="inner", cardinality="many_to_many")
    r.link("customer", "nation", "customer.c_nationkey = nation.n_nationkey", default="unknown")
    r.link("supplier", "nation", "supplier.s_nationkey = nation.n_nationkey")
    r.link("nation", "region", "nation.n_regionkey = region.r_regionkey", hint="broadcast")
    r.link("event_facts", "day", "event_facts.e_day = day.d", role="event")
    r.reference("order_facts", "o_orderpriority", "order_dim.o_orderpriority")
    m = r.metric
    m("revenue", f"CAST(SUM({REVENUE}) AS DOUBLE)", "item_facts")
    m("quantity", "SUM(l_quantity)", "item_facts")
    m("items", "COUNT(*)", "item_facts")
    m("average_price", "AVG(l_extendedprice)", "item_facts")
    m("highest_price", "MAX(l_extendedprice)", "item_facts")
    m("lowest_price", "MIN(l_extendedprice)", "item_facts")
    m("price_spread", "MAX(l_extendedprice) - MIN(l_extendedprice)", "item_facts")
    m("price_stddev", "STDDEV_SAMP(l_extendedprice)", "item_facts")
    m("price_variance", "VAR_POP(l_extendedprice)", "item_facts")
    m("quantity_price_corr", "CORR(l_quantity, l_extendedprice)", "item_facts")
    m("quantity_price_covar", "COVAR_SAMP(l_quantity, l_extendedprice)", "item_facts")
    m("returned_items", "COUNT_IF(l_returnflag = 'R')", "item_facts")
    m("shipped_orders", "COUNT(DISTINCT l_orderkey)", "item_facts")
    m("orders_returned", "COUNT(DISTINCT IF(l_returnflag = 'R', l_orderkey, NULL))", "item_facts")
    m("dearest_part", "MAX_BY(l_partkey, struct(l_extendedprice, l_partkey))", "item_facts")
    m("median_quantity", "MEDIAN(l_quantity)", "item_facts")
    m("approximate_parts", "APPROX_COUNT_DISTINCT(l_partkey)", "item_facts")
    m("some_flag", "ANY_VALUE(l_returnflag)", "item_facts")
    m("quantity_stddev_pop", "STDDEV_POP(l_quantity)", "item_facts")
    m("quantity_var_samp", "VAR_SAMP(l_quantity)", "item_facts")
    m("quantity_tax_covar_pop", "COVAR_POP(l_quantity, l_tax)", "item_facts")
    m("first_line", "MIN_BY(l_linenumber, l_orderkey * 10 + l_linenumber)", "item_facts")
    m("tax_variance", "VARIANCE(l_tax)", "item_facts")
    m("tax_stddev", "STDDEV(l_tax)", "item_facts")
    m("quantity_per_median", "SUM(l_quantity) / MEDIAN(l_quantity)", "item_facts")
    m("return_rate", "SUM(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) / SUM(l_quantity)", "item_facts")
    m("order_value", "SUM(o_totalprice)", "order_facts")
    m("order_count", "COUNT(o_orderkey)", "order_facts")
    m("buyers", "COUNT(DISTINCT o_custkey)", "order_facts")
    m("customers_known", "COUNT(c_custkey)", "customer")
    m("event_value", "SUM(value)", "event_facts")
    m("event_count", "COUNT(*)", "event_facts")
    m("event_users", "COUNT(DISTINCT user_id)", "event_facts")
    m("average_order", "order_value / order_count")
    m("revenue_per_order", "revenue / order_count")
    m("order_index", "average_order / 1000 * return_rate")
    m("value_share", "order_value / SUM(order_value) OVER ()")
    m("value_rank", "RANK() OVER (ORDER BY order_value DESC)")
    m("month_change", "(order_value - LAG(order_value, 1) OVER (ORDER BY day.month)) / LAG(order_value, 1) OVER (ORDER BY day.month)")
    m("trailing_quarter", "SUM(order_value) OVER (ORDER BY day.month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
    m("cross_change", "revenue_per_order - LAG(revenue_per_order, 1) OVER (ORDER BY day.month)")
    m("trailing_events", "SUM(event_count) OVER (ORDER BY day.d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)")
    r.hierarchy("place", ["region", "nation", "customer"])
    r.cube("sales", ["order_value", "order_count"], ["customer.c_mktsegment[customer]", "day.year[order]"], filters=["day.year[order] >= 1996"])
    return r


#: Analysed frames by session and folder; engines of one folder share them, but not their rollups.
_FRAMES: dict[tuple[str, str], dict] = {}


def engine(spark: SparkSession, folder: str) -> Engine:
    shared = _FRAMES.setdefault((f"{spark.sparkContext.applicationId}/{spark._jsparkSession.sessionUUID()}", folder), {})
    return Engine(spark, registry(), parquet_folder(spark, folder), frames=shared)
