"""Registered queries of the engine's rarer paths: stored cubes, measures, filters above facts, odd links, sinks, the model's own facts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.models.retail import engine
from gristmill.sources.tables import Availability, backfill, period_filter, publish, reflect, scan_bytes, write

Stored = Callable[[SparkSession], str]


def _used(e, name: str) -> None:
    if name not in e.used:
        raise AssertionError(f"{name} was not used, but {e.used}")


def cube_table(folder_of: Stored) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        e, at = engine(spark, folder), folder_of(spark)
        e.registry.cube("wide", ["order_value", "quantity"], ["order_dim.o_orderpriority", "day.year[order]"])
        e.materialize_cube("wide", lambda df, n: write(df, f"{at}/{n}"))
        out = e.query(["order_value", "quantity"], ["order_dim.o_orderpriority"], ["day.year[order] >= 1994"])
        _used(e, "cube:wide")
        return out

    return run


def measures_from_rollups(folder_of: Stored) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        e, at = engine(spark, folder), folder_of(spark)
        e.materialize("parts", ["order_value", "quantity"], ["order_dim.o_orderpriority", "day.year[order]"], lambda df, n: write(df, f"{at}/{n}"))
        df = e.combined_measures(["order_value", "quantity"], ["order_dim.o_orderpriority"], stored=True)
        _used(e, "parts_order_facts")
        return df.select("o_orderpriority", *[F.col(c).alias("value_sum" if c.startswith("o_totalprice") else "quantity_sum") for c in df.columns[1:]])

    return run


def filter_above(spark: SparkSession, folder: str) -> DataFrame:
    e = engine(spark, folder)
    e.registry.transform("status_totals", "SELECT o_orderstatus, sum(o_totalprice) AS value FROM order_facts GROUP BY 1")
    e.registry.metric("status_value", "SUM(value)", "status_totals")
    return e.query(["status_value"], ["status_totals.o_orderstatus"], ["customer.c_custkey[customer] <= 500"])


def materialised_node(folder_of: Stored) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        e = engine(spark, folder)
        e.use_table("order_facts", write(e.frame("order_facts"), f"{folder_of(spark)}/order_facts"))
        return e.query(["order_value"], ["order_facts.o_orderstatus"])

    return run


def cross_link(spark: SparkSession, folder: str) -> DataFrame:
    e = engine(spark, folder)
    e.registry.link("order_facts", "region", how="cross", role="each", cardinality="many_to_many")
    e.registry.metric("highest_order", "MAX(o_totalprice)", "order_facts")
    return e.query(["highest_order"], ["region.r_name[each]", "order_facts.o_orderstatus"])


def outer_link(how: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        e = engine(spark, folder)
        e.registry.transform("rich", "SELECT s_suppkey, s_nationkey FROM suppliers WHERE s_acctbal > 5000", ["s_suppkey"])
        e.registry.link("rich", "nation", "rich.s_nationkey = nation.n_nationkey", how=how)
        e.registry.metric("rich_suppliers", "COUNT(s_suppkey)", "rich")
        return e.query(["rich_suppliers"], ["nation.n_name"])

    return run


def self_link(spark: SparkSession, folder: str) -> DataFrame:
    e = engine(spark, folder)
    e.registry.dimension("step", "SELECT n_nationkey AS id, n_name AS name, n_regionkey AS above FROM nations", ["id"])
    e.registry.link("step", "step", "step.above = step.id", role="parent")
    e.registry.metric("steps", "COUNT(*)", "step")
    return e.query(["steps"], ["step.name[parent]"])


def native_grain(spark: SparkSession, folder: str) -> DataFrame:
    group = next(g for g in engine(spark, folder).measures(["median_quantity"], ["item_facts.l_returnflag"]) if g.whole)
    return group.frame.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.median("l_quantity").alias("median_quantity"))


def strategies(folder_of: Stored) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        at, df = folder_of(spark), spark.read.parquet(f"{folder}/nation.parquet")
        write(df.limit(3), f"{at}/full")
        write(df.where("n_regionkey = 1"), f"{at}/parts", "snapshot_partition", run="1")
        write(df.where("n_regionkey = 2"), f"{at}/parts", "snapshot_partition", run="2")
        versioned, name = publish(df.where("n_regionkey = 0"), "gristmill_published", "7")
        each = {
            "full": write(df, f"{at}/full"),
            "snapshot": write(df.where("n_regionkey = 0"), f"{at}/snap", "snapshot", run="a"),
            "snapshot_partition": write(df.where("n_regionkey = 3"), f"{at}/parts", "snapshot_partition", run="2").where("snapshot = '2'"),
            "view": write(df.where("n_regionkey <> 0"), "gristmill_view", "view"),
            "external": write(df, f"{at}/full", "external"),
            "published": spark.table(name),
            "versioned": spark.table(versioned),
        }
        out = [d.groupBy().agg(F.count("*").alias("n"), F.sum("n_nationkey").alias("keys")).select(F.lit(k).alias("kind"), "*") for k, d in each.items()]
        whole = out[0]
        for d in out[1:]:
            whole = whole.union(d)
        return whole

    return run


def backfilled(folder_of: Stored) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        e = engine(spark, folder)
        build = lambda t: e.query(["order_count"], ["day.month[order]"]).where(period_filter(F.col("month_order"), t, fmt="yyyyMM"))
        out = backfill(build, ["1996-03-01 00:00:00", "1996-01-01 00:00:00", "1996-02-01 00:00:00"], f"{folder_of(spark)}/months", ["month_order"])
        return out.select(F.col("month_order").cast("int").alias("month_order"), "order_count")

    return run


def model_facts(spark: SparkSession, folder: str) -> DataFrame:
    """One row per thing that the model, or what is known of a table, says."""
    r = engine(spark, folder).registry
    lost = r.impact("orders", ["o_totalprice"])
    have = Availability("t", (20240101,), (20240131,)).merge(Availability("t", (20240115,), (20240229,)))
    seen = reflect(r, lambda t: spark.read.parquet(f"{folder}/{t}.parquet"), ["region"])
    rows = [
        ("impact of a lost column on order_facts", lost["order_facts"]),
        ("impact of a lost column on order_dim", lost["order_dim"]),
        ("impact of a lost column on average_order", lost["average_order"]),
        ("below region", ",".join(r.drill("region"))),
        ("above customer", ",".join(r.drill("customer", down=False))),
        ("links to nation", str(r.in_degree()["nation"])),
        ("order of average_order", ",".join(sorted(r.metric_order(["average_order"])))),
        ("metrics by event day", ",".join(sorted(m for m in r.metrics_with(["day.d"]) if m.startswith("event")))),
        ("like order_facts", max(("order_dim", "nation", "item_facts"), key=lambda x: r.similarity("order_facts", x))),
        ("availability", f"{have.low[0]}-{have.high[0]}"),
        ("covers February", str(have.covers((20240201,), (20240210,))).lower()),
        ("columns of region", ",".join(seen["region"])),
        ("bytes to scan", "some" if scan_bytes(spark.read.parquet(f"{folder}/orders.parquet")) > 0 else "none"),
    ]
    return spark.createDataFrame(rows, "said string, value string")


FACTS = """
SELECT * FROM (VALUES
  ('impact of a lost column on order_facts', 'broken'), ('impact of a lost column on order_dim', 'touched'),
  ('impact of a lost column on average_order', 'broken'), ('below region', 'nation'), ('above customer', 'nation'),
  ('links to nation', '2'), ('order of average_order', 'average_order,order_count,order_value'),
  ('metrics by event day', 'event_count,event_users,event_value'), ('like order_facts', 'order_dim'),
  ('availability', '20240101-20240229'), ('covers February', 'true'), ('columns of region', 'r_regionkey,r_name'),
  ('bytes to scan', 'some')
) AS t(said, value)
"""
BOTH_SUMS = """
WITH a AS (SELECT o_orderpriority, sum(l_quantity) AS q FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey {where} GROUP BY 1),
b AS (SELECT o_orderpriority, sum(o_totalprice) AS v FROM orders {where} GROUP BY 1)
SELECT o_orderpriority, round(v, 4) AS {v}, round(q, 4) AS {q} FROM a FULL JOIN b USING (o_orderpriority)
"""


def register(add: Callable[..., None], folder_of: Stored) -> None:
    add("metric_cube_table", cube_table(folder_of), BOTH_SUMS.format(where="WHERE year(o_orderdate) >= 1994", v="order_value", q="quantity"))
    add("metric_measures_from_rollups", measures_from_rollups(folder_of), BOTH_SUMS.format(where="", v="value_sum", q="quantity_sum"))
    add("metric_filter_above_fact", filter_above, "SELECT o_orderstatus, round(sum(o_totalprice), 4) AS status_value FROM orders WHERE o_custkey <= 500 GROUP BY 1")
    add("metric_materialised_node", materialised_node(folder_of), "SELECT o_orderstatus, round(sum(o_totalprice), 4) AS order_value FROM orders GROUP BY 1")
    add("metric_cross_join_link", cross_link, "SELECT r_name AS r_name_each, o_orderstatus, round(max(o_totalprice), 4) AS highest_order FROM orders CROSS JOIN region GROUP BY 1, 2")
    rich = "(SELECT * FROM supplier WHERE s_acctbal > 5000)"
    add("metric_right_link", outer_link("right"), f"SELECT n_name, count(s_suppkey) AS rich_suppliers FROM {rich} s RIGHT JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
    add("metric_full_link", outer_link("full"), f"SELECT n_name, count(s_suppkey) AS rich_suppliers FROM {rich} s FULL JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
    add("metric_self_link", self_link, "SELECT b.n_name AS name_parent, count(*) AS steps FROM nation a LEFT JOIN nation b ON a.n_regionkey = b.n_nationkey GROUP BY 1")
    add("metric_native_grain", native_grain, "SELECT l_returnflag, count(*) AS n, round(median(l_quantity), 4) AS median_quantity FROM lineitem GROUP BY 1")
    add(
        "metric_filter_on_derived",
        lambda s, d: engine(s, d).query(["order_count"], ["order_facts.o_custkey"], ["average_order > 150000 AND order_count > 2"]),
        "SELECT o_custkey, count(o_orderkey) AS order_count FROM orders GROUP BY 1 HAVING sum(o_totalprice) / count(o_orderkey) > 150000 AND count(o_orderkey) > 2",
    )
    add(
        "metric_dimension_of_window_added",
        lambda s, d: engine(s, d).query(["trailing_quarter"], [], ["order_facts.o_orderstatus = 'F'"]),
        """
WITH m AS (SELECT CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INTEGER) AS month, sum(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT month, round(sum(v) OVER (ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS trailing_quarter FROM m
""",
    )
    add("sink_strategies", strategies(folder_of), """
SELECT 'full' AS kind, count(*) AS n, CAST(sum(n_nationkey) AS BIGINT) AS keys FROM nation
UNION ALL SELECT 'external', count(*), CAST(sum(n_nationkey) AS BIGINT) FROM nation
UNION ALL SELECT 'view', count(*), CAST(sum(n_nationkey) AS BIGINT) FROM nation WHERE n_regionkey <> 0
UNION ALL SELECT 'snapshot_partition', count(*), CAST(sum(n_nationkey) AS BIGINT) FROM nation WHERE n_regionkey = 3
UNION ALL SELECT k, count(*), CAST(sum(n_nationkey) AS BIGINT) FROM nation, (VALUES ('snapshot'), ('published'), ('versioned')) t(k) WHERE n_regionkey = 0 GROUP BY 1
""")  # fmt: skip
    month = "CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INTEGER)"
    add("sink_backfill", backfilled(folder_of), f"SELECT {month} AS month_order, count(o_orderkey) AS order_count FROM orders WHERE {month} BETWEEN 199601 AND 199603 GROUP BY 1")
    add("model_facts", model_facts, FACTS)
