from __future__ import annotations

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gristmill.functions.dialect import bind_logical_time, to_spark
from gristmill.models.retail import engine, registry
from gristmill.operators import relational
from gristmill.plans.decompose import Aggregability, decompose, decomposes
from gristmill.plans.engine import Engine, FanOutWarning, implied
from gristmill.plans.expressions import calls, over, safe_division
from gristmill.plans.model import Attribute, ModelError, Registry
from gristmill.sources.tables import Availability, publish, reflect, scan_bytes, write
from gristmill.streaming.incremental import refresh, upsert_stream


def test_calls_and_division():
    c = calls("SUM(DISTINCT a + f(b, c)) OVER (ORDER BY x)")
    assert (c[0].name, c[0].args, c[0].distinct, c[0].over) == ("sum", ("a + f(b, c)",), True, "ORDER BY x")
    assert safe_division("a / b") == "a / NULLIF(b, 0)"
    assert safe_division("a / 2") == "a / 2"
    assert safe_division("a / NULLIF(b, 0)") == "a / NULLIF(b, 0)"
    assert safe_division("a / SUM(b) OVER ()") == "a / NULLIF(SUM(b) OVER (), 0)"
    assert over("ORDER BY d.m DESC ROWS BETWEEN 6 PRECEDING AND CURRENT ROW").preceding == 6
    assert calls("f('a / b', x / y)")[0].args == ("'a / b'", "x / y")


def test_decompose_kinds():
    assert decompose("AVG(x)", "t").aggregability is Aggregability.FULL
    assert len(decompose("AVG(x)", "t").components) == 2
    assert decompose("COUNT(DISTINCT x)", "t").level == ("x",)
    assert decompose("MAX_BY(a, b)", "t").aggregability is Aggregability.NONE
    assert decompose("IF(MAX(a) > 0, MIN_BY(a, b), 0)", "t").aggregability is Aggregability.NONE
    a, b = decompose("SUM(x)", "t").components[0], decompose("SUM( x )", "t").components[0]
    assert a.identity == b.identity != decompose("MAX(x)", "t").components[0].identity


def test_corr_ignores_half_null_pairs(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, None), (5.0, 7.0)], "x double, y double")
    r = Registry()
    r.source("t")
    r.metric("c", "CORR(x, y)", "t")
    r.metric("v", "COVAR_POP(x, y)", "t")
    got = Engine(spark, r, lambda _: df).query(["c", "v"]).first()
    want = df.agg(F.corr("x", "y"), F.covar_pop("x", "y")).first()
    assert got["c"] == pytest.approx(want[0]) and got["v"] == pytest.approx(want[1])


def test_paths_and_roles():
    r = registry()
    assert [x.dimension for x in r.path("item_facts", "region", "supplier")[0]] == ["supplier", "nation", "region"]
    assert [x.dimension for x in r.path("order_facts", "nation", "customer")[0]] == ["customer", "nation"]
    assert r.path("event_facts", "region") is None
    assert {"day"} == {a.node for a in r.common_dimensions(["revenue", "order_value", "event_count"])}
    assert "revenue" in r.metrics_with(["part.p_brand"]) and "order_value" not in r.metrics_with(["region.r_name", "event.x"])
    assert r.drill("region") == ["nation"] and r.drill("nation", down=False) == ["region"]
    assert "order_value" in r.downstream("orders") and "orders" in r.upstream("average_order")
    assert r.in_degree()["nation"] == 2


def test_errors(spark, folder):
    e, r = engine(spark, folder), registry()
    with pytest.raises(ModelError, match="revenue"):
        e.query(["revenu"])
    with pytest.raises(ModelError, match="can't be reached"):
        e.query(["event_count"], ["region.r_name"])
    with pytest.raises(ModelError, match="qualified|neither"):
        e.query(["revenue"], [], ["l_quantity > 1"])
    with pytest.raises(ModelError, match="order by"):
        e.query(["revenue"], orderby=["part.p_brand", "quantity"])
    with pytest.raises(ModelError, match="made of each other"):
        r.metric("a", "b + 1") if r.metrics.update(b=r.metrics["average_order"].__class__("b", "a + 1")) is None else None
    with pytest.raises(ModelError):
        r.metric("plain", "SUM(x)")
    with pytest.raises(ModelError):
        r.hierarchy("bad", ["customer", "nation"])
    with pytest.raises(ModelError, match="isn't part"):
        e.sql("SELECT revenue FROM metrics HAVING revenue > 1")


def test_fan_out_warns(spark, folder):
    with pytest.warns(FanOutWarning):
        engine(spark, folder).query(["order_value"], ["part.p_brand[items]"])


def test_elided_join_reads_one_table(spark, folder):
    plan = engine(spark, folder).query(["quantity"], ["part.p_partkey"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_look_back_equals_filter_after(spark, folder):
    e = engine(spark, folder)
    near = e.query(["trailing_quarter"], ["day.month[order]"], ["day.month[order] >= 199801"])
    whole = e.query(["trailing_quarter"], ["day.month[order]"]).where("month_order >= 199801")
    cut = lambda df: sorted((r[0], round(r[1], 3)) for r in df.collect())
    assert cut(near) == cut(whole)


DIMENSIONS = ("customer.c_mktsegment[customer]", "day.year[order]", "order_facts.o_orderstatus", "nation.n_name[customer]")


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.sampled_from(DIMENSIONS), max_size=3))
def test_rollup_equals_rows(spark, folder, tmp_path_factory, dims):
    e, at = engine(spark, folder), tmp_path_factory.mktemp("rollup")
    metrics = ["order_value", "average_order", "order_count"]
    raw = e.query(metrics, sorted(dims)).collect()
    e.materialize("all", metrics, DIMENSIONS, lambda df, n: write(df, f"{at}/{n}"))
    stored = e.query(metrics, sorted(dims))
    assert e.used
    key = lambda r: repr([x for x in r if not isinstance(x, float)])
    for a, b in zip(sorted(raw, key=key), sorted(stored.collect(), key=key), strict=True):
        assert all(x == (pytest.approx(y, rel=1e-9) if isinstance(y, float) else y) for x, y in zip(a, b, strict=True))


def test_limited_rollup_and_freshness(spark, folder, tmp_path):
    e = engine(spark, folder)
    want = e.query(["buyers"], ["day.year[order]"]).collect()
    e.materialize("b", ["buyers"], ["day.year[order]"], lambda df, n: write(df, f"{tmp_path}/{n}"), covered={"day.year[order]": (1995, 2001)})
    assert sorted(e.query(["buyers"], ["day.year[order]"]).collect()) == sorted(want) and not e.used
    e.query(["buyers"], ["day.year[order]"], ["day.year[order] BETWEEN 1996 AND 1997"])
    assert e.used


def test_join_back(spark, folder, tmp_path):
    e = engine(spark, folder)
    want = e.query(["order_value"], ["customer.c_mktsegment[customer]"]).collect()
    e.materialize("k", ["order_value"], ["customer.c_custkey[customer]"], lambda df, n: write(df, f"{tmp_path}/{n}"))
    got = e.query(["order_value"], ["customer.c_mktsegment[customer]"]).collect()
    assert e.used
    assert {r[0]: round(r[1], 2) for r in got} == {r[0]: round(r[1], 2) for r in want}


def test_cross_fact_keeps_null_keys_together(spark):
    a = spark.createDataFrame([(None, 1), (1, 2)], "k int, a int")
    b = spark.createDataFrame([(None, 5), (2, 6)], "k int, b int")
    assert sorted(relational.combine([a, b], ["k"]).collect(), key=repr) == sorted([(None, 1, 5), (1, 2, None), (2, None, 6)], key=repr)


def test_dialect(spark):
    row = spark.sql("SELECT " + to_spark("strpos('xaxbx', 'x', 3) AS a, strpos('xa', 'q', 1) AS b, from_big_endian_64(unhex('FFFFFFFFFFFFFFFE')) AS c, array_ordinal(array(1), 5) AS d, safe_divide(1, 0) AS e")).first()
    assert tuple(row) == (5, 0, -2, None, None)
    assert bind_logical_time("d = logical_timestamp('yyyy')", "2024-01-02 00:00:00").startswith("d = date_format(TIMESTAMP '2024")


def test_strategies(spark, tmp_path):
    df = spark.createDataFrame([(1, 10), (2, 20)], "p int, v int")
    t = f"{tmp_path}/t"
    write(df, t, "incremental_time", ["p"])
    assert sorted(write(df.where("p = 2").withColumn("v", F.lit(99)), t, "incremental_time", ["p"]).select("p", "v").collect()) == [(1, 10), (2, 99)]
    write(df, f"{tmp_path}/s", "snapshot_partition", run="a")
    assert write(df, f"{tmp_path}/s", "snapshot_partition", run="b").count() == 4
    assert write(df, f"{tmp_path}/n", "snapshot", run="x").count() == 2
    assert write(df, "some_view", "view").count() == 2
    with pytest.raises(ValueError):
        write(df, t, "sometimes")
    assert scan_bytes(spark.read.parquet(t)) > 0
    a = Availability("t", (1,), (5,), {("x", None): ((1,), (5,))})
    b = Availability("t", (3,), (9,), {("x", "y"): ((2,), (4,))})
    m = a.merge(b)
    assert (m.low, m.high, set(m.partitions)) == ((1,), (9,), {("x", None)}) and m.covers((2,), (8,))


def test_refresh_and_stream(spark, tmp_path):
    rows = spark.sql("SELECT DATE '2024-01-01' AS day, 1 AS v UNION ALL SELECT DATE '2024-01-02', 2")
    out = refresh(lambda: rows, lambda df: df.groupBy("day").agg(F.sum("v").alias("v")), f"{tmp_path}/r", "day", "2024-01-02", 1)
    assert [r["v"] for r in out.collect()] == [2]
    rows.withColumn("day", F.col("day").cast("string")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("day string, v int").parquet(f"{tmp_path}/in")
    upsert_stream(stream, f"{tmp_path}/out", f"{tmp_path}/cp", ["day"]).awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


def test_asof_ties_and_nulls(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, None, 5), (3, "b", 1)], "id int, k string, t int")
    right = spark.createDataFrame([("a", 5, 7), ("a", 5, 8), ("a", 6, 9), (None, 1, 1)], "k string, at int, v int")
    assert sorted(relational.asof(left, right, ["k"], "t", "at", ["v"]).select("id", "v").collect()) == [(1, 8), (2, None), (3, None)]


def test_yaml_model(spark):
    r = Registry.from_yaml(
        """
sources: [{name: sales, primary_key: [id]}]
dimensions: [{name: shop, query: "SELECT * FROM shops", primary_key: [shop_id]}]
links: [{node: sales, dimension: shop, on: "sales.shop_id = shop.shop_id", default: none}]
metrics: [{name: twice, expression: "total * 2"}, {name: total, expression: SUM(v), parent: sales}]
cubes: [{name: c, metrics: [twice], dimensions: [shop.city]}]
""".replace("dimensions: [{name", "transforms: []\ndimensions: [{name", 1).replace("sources: [", "sources: [{name: shops}, ", 1)
    )
    data = {"sales": spark.createDataFrame([(1, 1, 2), (2, 9, 3)], "id int, shop_id int, v int"), "shops": spark.createDataFrame([(1, "x")], "shop_id int, city string")}
    assert sorted(Engine(spark, r, data.__getitem__).cube("c").collect()) == [("none", 6), ("x", 4)]


def test_self_join_role(spark):
    r = Registry()
    r.source("people", primary_key=["id"])
    r.dimension("employee", "SELECT * FROM people", ["id"])
    r.link("employee", "employee", "employee.manager = employee.id", role="manager")
    r.metric("n", "COUNT(*)", "employee")
    df = spark.createDataFrame([(1, "ann", None), (2, "bo", 1), (3, "cy", 1)], "id int, name string, manager int")
    got = Engine(spark, r, lambda _: df).query(["n"], ["employee.name[manager]"]).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([("ann", 2), (None, 1)], key=repr)
    assert str(Attribute.parse("a.b[c->d]")) == "a.b[c->d]"


def test_filtered_rollups_answer_only_what_implies_their_filters(spark, folder, tmp_path):
    e = engine(spark, folder)
    e.materialize("late", ["order_count"], ["order_facts.o_orderstatus", "day.year[order]"], lambda df, n: write(df, f"{tmp_path}/{n}"), ["day.year[order] >= 1996"])
    cases = [([], False), (["day.year[order] >= 1996"], True), (["day.year[order]  >=  1996 and order_facts.o_orderstatus = 'F'"], True), (["day.year[order] > 1995"], False)]
    cases += [(["day.year[order] = 1997"], True), (["day.year[order] >= 1996 OR order_facts.o_orderstatus = 'F'"], False), (["day.year[order] < 1996"], False)]
    for filters, used in cases:
        got = e.query(["order_count"], ["order_facts.o_orderstatus"], filters)
        assert bool(e.used) == used, filters
        want = engine(spark, folder).query(["order_count"], ["order_facts.o_orderstatus"], filters)
        assert sorted(got.collect()) == sorted(want.collect())


def test_implied():
    assert implied("a.x >= 3", ["a.x > 3"]) and not implied("a.x > 3", ["a.x >= 3"]) and implied("a.x < 3", ["a.x <= 2"]) and implied("a.x >= 1", ["a.x = 5 AND b.y = 2"])
    assert implied("A.x  = 'B'", ["a.X = 'B'"]) and not implied("a.x = 'B'", ["a.x = 'b'"]) and implied("a.x > 1 AND b.y = 2", ["b.y = 2", "a.x = 2"])
    assert not implied("a.x > '10'", ["a.x > 11"]) and not implied("a.x = 3", ["a.x >= 3"]) and not implied("a.x > 3", ["b.x > 4"])


def test_cube_table_answers_what_it_covers(spark, folder, tmp_path):
    e = engine(spark, folder)
    e.registry.cube("wide", ["order_value", "order_count", "quantity", "revenue_per_order"], ["order_dim.o_orderpriority", "day.year[order]"])
    requests = [(["order_value", "quantity"], ["order_dim.o_orderpriority"], []), (["revenue_per_order"], ["day.year[order]"], ["order_dim.o_orderpriority <> '1-URGENT'"]), (["order_count"], [], [])]
    want = [sorted(e.query(*r).collect(), key=repr) for r in requests]
    e.materialize_cube("wide", lambda df, n: write(df, f"{tmp_path}/{n}"))
    for r, w in zip(requests, want, strict=True):
        got = sorted(e.query(*r).collect(), key=repr)
        assert e.used == ["cube:wide"]
        assert [[pytest.approx(x) if isinstance(x, float) else x for x in row] for row in w] == [list(row) for row in got]
    e.query(["quantity"], ["day.year[ship]"])
    assert not e.used
    e.query(["order_value"], [], ["customer.c_mktsegment[customer] = 'BUILDING'"])
    assert not e.used
    with pytest.raises(ModelError, match="distinct"):
        e.registry.cube("distinct", ["buyers"], ["day.year[order]"])
        e.materialize_cube("distinct", lambda df, n: df)


def test_combined_measures_from_rollups(spark, folder, tmp_path):
    e = engine(spark, folder)
    ask = (["order_value", "quantity"], ["order_dim.o_orderpriority"])
    want = sorted(e.combined_measures(*ask).collect())
    e.materialize("parts", ["order_value", "quantity"], ["order_dim.o_orderpriority", "day.year[order]"], lambda df, n: write(df, f"{tmp_path}/{n}"))
    got = sorted(e.combined_measures(*ask, stored=True).collect())
    assert len(e.used) == 2 and [[pytest.approx(x) if isinstance(x, float) else x for x in r] for r in want] == [list(r) for r in got]


def test_native_grain_of_metrics_that_have_no_parts(spark, folder):
    e = engine(spark, folder)
    groups = e.measures(["median_quantity", "quantity"], ["item_facts.l_returnflag"])
    own = next(g for g in groups if g.whole)
    assert own.frame.columns == ["l_returnflag", "l_orderkey", "l_linenumber", "l_quantity"] and own.frame.count() == e.frame("item_facts").count()
    assert len(groups) == 2
    with pytest.raises(ModelError, match="merged"):
        e.registry.metric("half", "median_quantity / 2")
        e.query(["half"])


def test_filters_on_dimensions_that_only_nodes_above_reach(spark):
    r = Registry()
    r.source("raw")
    r.dimension("place", "SELECT k AS place_id, k * 10 AS code FROM places", ["place_id"])
    r.source("places")
    r.transform("kept", "SELECT id, place_id, v FROM raw", ["id"])
    r.transform("summed", "SELECT id % 2 AS odd, sum(v) AS v FROM kept GROUP BY 1")
    r.transform("passed", "SELECT id, place_id, v + 1 AS v FROM kept")
    r.link("kept", "place", "kept.place_id = place.place_id")
    r.metric("total", "SUM(v)", "summed")
    r.metric("total_passed", "SUM(v)", "passed")
    data = {"raw": spark.createDataFrame([(1, 1, 5), (2, 1, 7), (3, 2, 11)], "id int, place_id int, v int"), "places": spark.createDataFrame([(1,), (2,)], "k int")}
    e = Engine(spark, r, data.__getitem__)
    assert e.query(["total"], [], ["place.place_id = 1"]).first()[0] == 12 and e.query(["total"]).first()[0] == 23
    assert e.query(["total_passed"], [], ["place.place_id = 2"]).first()[0] == 12
    with pytest.raises(ModelError, match="reached"):
        e.query(["total"], ["place.place_id"])
    with pytest.raises(ModelError, match="reached"):
        e.query(["total"], [], ["place.code = 10"])


def test_lineage_of_unions_and_long_plans(spark):
    r = Registry()
    r.source("a")
    r.source("b")
    wide = ", ".join(f"upper(concat(x, '{k}', y)) AS c{k}" for k in range(60))
    r.transform("u", "SELECT x, y FROM a UNION ALL SELECT p, q FROM b")
    r.transform("w", f"SELECT CASE WHEN x > 'm' THEN y END AS pick, count(*) OVER (PARTITION BY y) AS n, {wide} FROM u")
    data = {"a": spark.createDataFrame([("1", "2")], "x string, y string"), "b": spark.createDataFrame([("1", "2")], "p string, q string")}
    got = Engine(spark, r, data.__getitem__).lineage("w")
    assert got["pick"] == got["c59"] == ["a.x", "a.y", "b.p", "b.q"] and got["n"] == ["a.y", "b.q"]


def test_registered_decomposition(spark):
    @decomposes("bool_or")
    def either(call, make):
        c = make("max", call.args[0])
        return [c], c.merge

    d = decompose("BOOL_OR(x > 1)", "t")
    assert [c.accumulate for c in d.components] == ["max(x > 1)"] and d.final == f"({d.components[0].merge})"


def test_asof_in_buckets_and_salts_of_equal_rows(spark):
    r = random.Random(4)
    left = spark.createDataFrame([(r.choice(["a", "b", None]), r.randrange(1000), k) for k in range(300)], "k string, t int, id int")
    right = spark.createDataFrame([(r.choice(["a", "b", None]), r.randrange(1000), k) for k in range(60)], "k string, s int, v int")
    whole = relational.asof(left, right, ["k"], "t", "s", ["v"])
    parts = relational.asof(left, right, ["k"], "t", "s", ["v"], bucket=lambda t: F.floor(t / 50))
    assert sorted(whole.collect(), key=repr) == sorted(parts.collect(), key=repr) and whole.where("v is not null").count() > 100
    equal = spark.range(4000).select(F.lit(1).alias("k"))
    joined = relational.skewed_join(equal, spark.createDataFrame([(1, "x")], "k int, v string"), ["k"], 8)
    assert joined.count() == 4000
    salted = equal.withColumn("s", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(8))).groupBy("s").count().collect()
    assert len(salted) == 8


def test_views_reflection_impact(spark):
    one, two = spark.createDataFrame([(1, "x")], "id long, name string"), spark.createDataFrame([(2, "y")], "id long, name string")
    assert publish(one, "shop_cube", "1") == ("shop_cube_v1", "shop_cube")
    publish(two, "shop_cube", "2")
    assert [spark.table(t).first()[0] for t in ("shop_cube_v1", "shop_cube_v2", "shop_cube")] == [1, 2, 2]
    r = Registry()
    assert reflect(r, spark.table, ["shop_cube"]) == {"shop_cube": {"id": "bigint", "name": "string"}} and r.node("shop_cube").columns[0] == ("id", "bigint")
    m = registry()
    lost = m.impact("orders", ["o_totalprice"])
    assert lost["order_facts"] == lost["order_value"] == "broken" and lost["order_dim"] == "touched"
    assert m.similarity("order_facts", "order_dim") > m.similarity("order_facts", "nation")


def test_suggestions_and_free_filters(spark, folder):
    e = engine(spark, folder)
    with pytest.raises(ModelError, match="is it order_count"):
        e.query(["order_value"], [], ["order_cuont > 1"])
    assert e.query(["order_count"], [], ["CAST(order_facts.o_totalprice AS FLOAT) > 0 AND order_facts.o_day < CURRENT_DATE"]).first()[0] > 0


def test_derived_attributes_need_no_join(spark, folder):
    plan = engine(spark, folder).query(["order_value"], ["day.month[order]"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Union" not in plan


def test_lag_at_a_coarser_grain_reads_the_fact_once(spark, folder):
    df = engine(spark, folder).query(["month_change"], ["day.month[order]", "day.d[order]"])
    files = [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Relation" in x]
    assert len(files) == len([x for x in files if "o_totalprice" in x]) and df.count() > 0
