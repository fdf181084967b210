"""Headline queries of the metrics engine, and what its plans are compared with. Prints one JSON line.

Each query is planned anew, as registered; the flagship stands beside the same
question in hand-written SQL. Besides: a rollup against the rows, one scan for
four metrics against four scans, and planning alone, at first and again.
"""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time

from pyspark.sql import SparkSession

from gristmill.models.retail import _FRAMES, REVENUE, engine
from gristmill.queries import QUERIES
from gristmill.sources.tables import write

DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
NAMES = ("metric_revenue_by_nation_priority", "metric_cross_fact", "metric_distinct_limited", "metric_decomposed_statistics", "metric_two_roles", "metric_window_lag_coarser_grain", "metric_three_facts_by_day", "sql_tpch_q1", "sql_tpch_q3", "op_asof_join")
BY_HAND = f"""SELECT coalesce(n_name, 'unknown') AS n, o_orderpriority, CAST(sum({REVENUE}) AS DOUBLE) AS r, avg(l_extendedprice) AS a
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2"""


def best(run, times: int = 3) -> float:
    out = []
    for _ in range(times):
        t = time.perf_counter()
        run().write.format("noop").mode("overwrite").save()
        out.append(time.perf_counter() - t)
    return round(min(out), 3)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", CPUS).config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    for t in ("lineitem", "orders", "customer", "nation"):
        spark.read.parquet(f"{DIR}/{t}.parquet").createOrReplaceTempView(t)
    times = {n: best(lambda n=n: QUERIES[n](spark, DIR)) for n in NAMES}
    extra = {"hand_written_revenue_by_nation_priority": best(lambda: spark.sql(BY_HAND))}
    for name in ("planning_first", "planning_only"):
        if name == "planning_first":
            _FRAMES.clear()
        t = time.perf_counter()
        engine(spark, DIR).query(["revenue", "order_value", "revenue_per_order"], ["day.month[order]", "nation.n_name[customer]"])
        extra[name] = round(time.perf_counter() - t, 3)
    at = tempfile.mkdtemp(prefix="gristmill-bench-")
    stored = engine(spark, DIR)
    stored.materialize("by_segment", ["revenue", "quantity"], ["customer.c_mktsegment[customer]", "day.month[ship]"], lambda df, n: write(df, f"file://{at}/{n}"))
    ask = (["revenue", "quantity"], ["customer.c_mktsegment[customer]"])
    extra["rows_revenue_by_segment"] = best(lambda: engine(spark, DIR).query(*ask))
    extra["rollup_revenue_by_segment"] = best(lambda: stored.query(*ask))
    four = ["revenue", "quantity", "items", "average_price"]
    extra["four_metrics_one_scan"] = best(lambda: engine(spark, DIR).query(four, ["item_facts.l_returnflag"]))
    extra["four_metrics_four_scans"] = round(sum(best(lambda m=m: engine(spark, DIR).query([m], ["item_facts.l_returnflag"])) for m in four), 3)
    shutil.rmtree(at, ignore_errors=True)
    print(json.dumps({"metric": "headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times | extra, "sf": DIR.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
