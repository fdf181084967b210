"""Registered queries of single functions and clauses: each result column in Spark SQL and in DuckDB's.

A query is a table and a list of (column, Spark SQL, DuckDB SQL); with no third
text both are the same. Columns marked ~ are doubles, rounded on both sides; all
others are exact. Where an engine has no such function, the other side
states the value that it must have.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

Pair = tuple[str, ...]


def pairs(columns: Iterable[Pair], tail: str, duckdb_tail: str | None = None) -> tuple[str, str]:
    """SELECT lists of both engines before FROM and whatever follows it."""
    columns = [*columns]
    spark = ",\n  ".join(f"{c[1]} AS {c[0].lstrip('~')}" for c in columns)
    duckdb = ",\n  ".join(f"round({c[-1]}, 4) AS {c[0][1:]}" if c[0].startswith("~") else f"{c[-1]} AS {c[0]}" for c in columns)
    return f"SELECT {spark}\n{tail}", f"SELECT {duckdb}\n{tail if duckdb_tail is None else duckdb_tail}"


NATION = "FROM {nation}"
KEY = ("n_nationkey", "n_nationkey")

AGGREGATES = [
    ("n_regionkey", "n_regionkey"),
    ("any_value", "any_value(n_regionkey)"),
    ("first_one", "first(n_regionkey)"),
    ("last_one", "last(n_regionkey)"),
    ("~mean_key", "mean(n_nationkey)", "avg(n_nationkey)"),
    ("approximate", "approx_count_distinct(n_nationkey)", "count(DISTINCT n_nationkey)"),
    ("hll", "hll_sketch_estimate(hll_sketch_agg(n_nationkey))", "count(DISTINCT n_nationkey)"),
    ("hll_ds", "approx_count_distinct_ds_hll(n_nationkey)", "count(DISTINCT n_nationkey)"),
    ("theta_ds", "approx_count_distinct_ds_theta(n_nationkey)", "count(DISTINCT n_nationkey)"),
    ("approximate_median", "approx_percentile(n_nationkey, 0.5)", "quantile_disc(n_nationkey, 0.5)"),
    ("~lower_quartile", "percentile(n_nationkey, 0.25)", "quantile_cont(n_nationkey, 0.25)"),
    ("sketched", "length(hex(count_min_sketch(n_nationkey, 0.5D, 0.5D, 1))) > 0", "true"),
    ("every_one", "every(n_nationkey >= 0)", "bool_and(n_nationkey >= 0)"),
    ("bins", "size(histogram_numeric(n_nationkey, 100))", "count(DISTINCT n_nationkey)"),
    ("~kurtosis", "kurtosis(n_nationkey)", "kurtosis_pop(n_nationkey)"),
    ("~stddev", "stddev(n_nationkey)", "stddev_samp(n_nationkey)"),
    ("~variance", "variance(n_nationkey)", "var_samp(n_nationkey)"),
]
STRINGS = [
    KEY,
    ("char_of", "char(65 + n_nationkey)", "chr(CAST(65 + n_nationkey AS INTEGER))"),
    ("chr_of", "chr(65 + n_nationkey)", "chr(CAST(65 + n_nationkey AS INTEGER))"),
    ("char_length", "char_length(n_name)", "length(n_name)"),
    ("character_length", "character_length(n_name)", "length(n_name)"),
    ("len_of", "len(n_name)", "length(n_name)"),
    ("octets", "octet_length(n_name)", "strlen(n_name)"),
    ("elt_of", "elt(2, n_name, 'second')", "'second'"),
    ("encoded", "hex(encode(n_name, 'UTF-8'))", "hex(encode(n_name))"),
    ("ends", "endswith(n_name, 'A')", "ends_with(n_name, 'A')"),
    ("place_in_set", "find_in_set('b', concat('a,b,', n_name))", "2"),
    ("thousands", "format_number(n_nationkey * 1000.5, 2)", "format('{{:,.2f}}', n_nationkey * 1000.5)"),
    ("formatted", "format_string('%05d-%s', n_nationkey, n_name)", "printf('%05d-%s', n_nationkey, n_name)"),
    ("ilike_of", "ilike(n_name, 'a%')", "n_name ILIKE 'a%'"),
    ("like_of", "like(n_name, 'A%')", "n_name LIKE 'A%'"),
    ("initials", "initcap(concat(n_name, ' x'))", "upper(n_name[1]) || lower(n_name[2:]) || ' X'"),
    ("lcase_of", "lcase(n_name)", "lower(n_name)"),
    ("located", "locate('N', n_name)", "instr(n_name, 'N')"),
    ("masked", "mask(concat(n_name, ' 12'))", "regexp_replace(regexp_replace(regexp_replace(n_name, '[A-Z]', 'X', 'g'), '[a-z]', 'x', 'g'), '[0-9]', 'n', 'g') || ' nn'"),
    ("overlaid", "overlay(n_name PLACING '__' FROM 2 FOR 2)", "n_name[1] || '__' || n_name[4:]"),
    ("extracted", "regexp_extract(n_name, '([A-Z])N', 1)", "regexp_extract(n_name, '([A-Z])N', 1)"),
    ("regexp_like_of", "regexp_like(n_name, 'AN')", "regexp_matches(n_name, 'AN')"),
    ("substr_of", "substr(n_name, 2, 3)"),
]
MATH = [
    KEY,
    ("~acos_of", "acos(n_nationkey / 25.0D)", "acos(n_nationkey / 25.0)"),
    ("ceiling_of", "ceiling(n_nationkey / 2)", "CAST(ceiling(n_nationkey / 2) AS BIGINT)"),
    ("conv_of", "conv(n_nationkey, 10, 2)", "to_base(n_nationkey, 2)"),
    ("~cosh_of", "cosh(n_nationkey / 10)", "cosh(n_nationkey / 10)"),
    ("~cot_of", "cot(n_nationkey + 1)", "cot(n_nationkey + 1)"),
    ("~csc_of", "csc(n_nationkey + 1)", "1 / sin(n_nationkey + 1)"),
    ("div_of", "n_nationkey div 4", "n_nationkey // 4"),
    ("~e_of", "e()", "exp(1)"),
    ("~expm1_of", "expm1(n_nationkey / 10)", "exp(n_nationkey / 10) - 1"),
    ("factorial_of", "factorial(CAST(n_nationkey % 10 AS INT))", "CAST(factorial(CAST(n_nationkey % 10 AS INTEGER)) AS BIGINT)"),
    ("bit", "CAST(getbit(n_nationkey, 1) AS INT)", "CAST((n_nationkey >> 1) & 1 AS INTEGER)"),
    ("~hypot_of", "hypot(n_nationkey, 4)", "sqrt(n_nationkey * n_nationkey + 16)"),
    ("isnan_of", "isnan(n_nationkey / 2)", "isnan(n_nationkey / 2)"),
    ("~log_of", "log(n_nationkey + 1)", "ln(n_nationkey + 1)"),
    ("~log1p_of", "log1p(n_nationkey)", "ln(1 + n_nationkey)"),
    ("~log2_of", "log2(n_nationkey + 1)", "log2(n_nationkey + 1)"),
    ("mod_of", "mod(n_nationkey, 7)", "n_nationkey % 7"),
    ("~nanvl_of", "nanvl(n_nationkey / 2, 0D)", "n_nationkey / 2"),
    ("negative_of", "negative(n_nationkey)", "-n_nationkey"),
    ("pmod_of", "pmod(n_nationkey - 20, 7)", "((n_nationkey - 20) % 7 + 7) % 7"),
    ("~pow_of", "pow(n_nationkey, 2)", "pow(n_nationkey, 2)"),
    ("rand_in", "rand() >= 0 AND rand() < 1", "true"),
    ("random_in", "random() BETWEEN 0 AND 1", "true"),
    ("randn_there", "randn() IS NOT NULL", "true"),
    ("bits", "(n_nationkey & 5) | 2 ^ 1", "(n_nationkey & 5) | xor(2, 1)"),
    ("flipped", "~n_nationkey", "~n_nationkey"),
]
DATES = [
    ("o_orderkey", "o_orderkey"),
    ("date_of", "date(o_orderdate)", "CAST(o_orderdate AS DATE)"),
    ("date_sub_of", "date_sub(o_orderdate, 40)", "CAST(o_orderdate AS DATE) - 40"),
    ("from_unix_date", "date_from_unix_date(10000)", "DATE '1970-01-01' + 10000"),
    ("part_of", "date_part('YEAR', o_orderdate)", "CAST(date_part('year', o_orderdate) AS INTEGER)"),
    ("extract_of", "extract(MONTH FROM o_orderdate)", "CAST(extract(month FROM o_orderdate) AS INTEGER)"),
    ("dayofmonth_of", "dayofmonth(o_orderdate)", "CAST(dayofmonth(o_orderdate) AS INTEGER)"),
    ("dayofweek_of", "dayofweek(o_orderdate)", "CAST(dayofweek(o_orderdate) + 1 AS INTEGER)"),
    ("minute_of", "minute(timestamp_seconds(o_orderkey * 61))", "CAST(minute(to_timestamp(o_orderkey * 61)) AS INTEGER)"),
    ("made_date", "make_date(year(o_orderdate), 2, 3)", "make_date(year(o_orderdate), 2, 3)"),
    ("made_timestamp", "CAST(make_timestamp(2001, 2, 3, 4, 5, 6) AS STRING)", "'2001-02-03 04:05:06'"),
    ("made_ltz", "CAST(make_timestamp_ltz(2001, 2, 3, 4, 5, 6) AS STRING)", "'2001-02-03 04:05:06'"),
    ("made_ntz", "CAST(make_timestamp_ntz(2001, 2, 3, 4, 5, 6) AS STRING)", "'2001-02-03 04:05:06'"),
    ("days_added", "CAST(DATE '2001-01-01' + make_dt_interval(3, 0, 0, 0) AS DATE)", "DATE '2001-01-04'"),
    ("interval_added", "CAST(DATE '2001-01-01' + make_interval(1, 2, 0, 3) AS DATE)", "DATE '2002-03-04'"),
    ("months_added", "CAST(DATE '2001-01-01' + make_ym_interval(1, 2) AS DATE)", "DATE '2002-03-01'"),
    ("literal_interval", "CAST(CAST(o_orderdate AS DATE) + INTERVAL 2 MONTH AS DATE)", "CAST(CAST(o_orderdate AS DATE) + INTERVAL 2 MONTH AS DATE)"),
    ("months", "months_between(date_add(CAST(o_orderdate AS DATE), 0), CAST(o_orderdate AS DATE))", "CAST(0 AS DOUBLE)"),
    ("monday", "next_day(o_orderdate, 'MON')", "CAST(o_orderdate AS DATE) + CAST(CASE WHEN isodow(o_orderdate) = 1 THEN 7 ELSE 8 - isodow(o_orderdate) END AS INTEGER)"),
    ("parsed", "CAST(to_timestamp('2001-02-03 04:05:06') AS STRING)", "'2001-02-03 04:05:06'"),
    ("cast_timestamp", "CAST(timestamp('2001-02-03 04:05:06') AS STRING)", "'2001-02-03 04:05:06'"),
    ("zone", "CAST(convert_timezone('UTC', 'Asia/Tokyo', TIMESTAMP_NTZ '2001-02-03 04:05:06') AS STRING)", "'2001-02-03 13:05:06'"),
    ("from_utc", "CAST(from_utc_timestamp(TIMESTAMP '2001-02-03 04:05:06', 'Asia/Tokyo') AS STRING)", "'2001-02-03 13:05:06'"),
    ("from_unix", "unix_timestamp(from_unixtime(o_orderkey))", "o_orderkey"),
    ("seconds", "unix_seconds(timestamp_seconds(o_orderkey))", "o_orderkey"),
    ("millis", "unix_millis(timestamp_millis(o_orderkey))", "o_orderkey"),
    ("micros", "unix_micros(timestamp_micros(o_orderkey))", "o_orderkey"),
    ("today", "curdate() = current_date()", "true"),
    ("now_is", "now() = current_timestamp() AND localtimestamp() IS NOT NULL AND current_time() IS NOT NULL", "true"),
    ("session_zone", "length(current_timezone()) > 0", "true"),
]
TEN = "array(n_nationkey, 3, NULL, 7)"
COLLECTIONS = [
    KEY,
    ("appended", "array_join(array_append(array(n_nationkey), 9), ',')", "n_nationkey || ',9'"),
    ("compacted", f"size(array_compact({TEN}))", "3"),
    ("without", "array_join(array_except(array(1, 2, 3), array(2)), ',')", "'1,3'"),
    ("common", "array_join(array_intersect(array(1, 2, 3), array(3, 2)), ',')", "'2,3'"),
    ("least_of", f"array_min({TEN})", "least(n_nationkey, 3)"),
    ("position", f"array_position({TEN}, 7)", "CASE WHEN n_nationkey = 7 THEN 1 ELSE 4 END"),
    ("removed", "array_join(array_remove(array(1, 2, 1), 1), ',')", "'2'"),
    ("repeated", "array_join(array_repeat(n_nationkey, 2), ',')", "n_nationkey || ',' || n_nationkey"),
    ("array_size_of", f"array_size({TEN})", "4"),
    ("cardinality_of", f"cardinality({TEN})", "4"),
    ("together", "array_join(array_union(array(1, 2), array(2, 3)), ',')", "'1,2,3'"),
    ("overlap", "arrays_overlap(array(n_nationkey), array(1, 2))", "n_nationkey IN (1, 2)"),
    ("filtered", "array_join(filter(array(1, n_nationkey, 30), x -> x > 20), ',')", "CASE WHEN n_nationkey > 20 THEN n_nationkey || ',30' ELSE '30' END"),
    ("flat", "array_join(flatten(array(array(1), array(n_nationkey))), ',')", "'1,' || n_nationkey"),
    ("all_of", "forall(array(1, n_nationkey), x -> x < 10)", "n_nationkey < 10"),
    ("got", "get(array('a', 'b'), CAST(n_nationkey AS INT))", "CASE n_nationkey WHEN 0 THEN 'a' WHEN 1 THEN 'b' END"),
    ("subscript", "array('a', 'b')[0]", "'a'"),
    ("map_value", "map_concat(map('a', 1), map('b', n_nationkey))['b']", "n_nationkey"),
    ("entries", "map_entries(map('a', n_nationkey))[0].value", "n_nationkey"),
    ("map_filtered", "size(map_filter(map('a', n_nationkey, 'b', 100), (k, v) -> v > 10))", "CASE WHEN n_nationkey > 10 THEN 2 ELSE 1 END"),
    ("map_arrays", "map_from_arrays(array('a', 'b'), array(1, n_nationkey))['b']", "n_nationkey"),
    ("map_pairs", "map_from_entries(array(struct('a', n_nationkey)))['a']", "n_nationkey"),
    ("zipped", "map_zip_with(map('a', 1), map('a', n_nationkey), (k, x, y) -> x + y)['a']", "n_nationkey + 1"),
    ("keys_made", "transform_keys(map('a', n_nationkey), (k, v) -> upper(k))['A']", "n_nationkey"),
]
FORMATS = [
    KEY,
    ("csv_field", "from_csv(concat(n_nationkey, ',', n_name), 'a INT, b STRING').b", "n_name"),
    ("object_keys", "array_join(json_object_keys(concat('{{\"a\":', n_nationkey, ',\"b\":1}}')), ',')", "'a,b'"),
    ("decimal_of", "CAST(decimal(n_nationkey) AS STRING)", "CAST(n_nationkey AS VARCHAR)"),
    ("double_of", "double(n_nationkey)", "CAST(n_nationkey AS DOUBLE)"),
    ("float_of", "CAST(float(n_nationkey) AS DOUBLE)", "CAST(n_nationkey AS DOUBLE)"),
    ("int_of", "int(n_nationkey)", "CAST(n_nationkey AS INTEGER)"),
    ("there", "isnotnull(n_name)", "n_name IS NOT NULL"),
    ("nvl_of", "nvl(nullif(n_nationkey, 3), -1)", "coalesce(nullif(n_nationkey, 3), -1)"),
]
SESSION = [
    ("n_nations", "count(*)"),
    ("hashes", "count(DISTINCT hash(n_nationkey))", "count(*)"),
    ("long_hashes", "count(DISTINCT xxhash64(n_nationkey, n_name))", "count(*)"),
    ("row_ids", "count(DISTINCT row_id)", "count(*)"),
    ("file", "min(file) LIKE '%/nation.parquet'", "true"),
    ("block_start", "min(block_start)", "0"),
    ("block_length", "min(block_length) > 0", "true"),
    ("session_names", "min(current_catalog()) IS NOT NULL AND min(current_database()) = min(current_schema()) AND min(current_user()) IS NOT NULL", "true"),
]
PLACED = (
    "FROM (SELECT *, monotonically_increasing_id() AS row_id, input_file_name() AS file,\n"
    "  input_file_block_start() AS block_start, input_file_block_length() AS block_length FROM {nation}) x"
)

TEXTS: dict[str, tuple[str, str]] = {
    "fn_more_aggregates": pairs(AGGREGATES, f"{NATION} GROUP BY n_regionkey"),
    "fn_more_strings": pairs(STRINGS, NATION),
    "fn_more_math": pairs(MATH, NATION),
    "fn_more_dates": pairs(DATES, "FROM {orders} WHERE o_orderkey < 400"),
    "fn_more_collections": pairs(COLLECTIONS, NATION),
    "fn_formats_and_casts": pairs(FORMATS, NATION),
    "fn_session": pairs(SESSION, PLACED, NATION),
    "fn_mode": (
        "SELECT l_returnflag, mode(l_linestatus) AS most FROM {lineitem} WHERE l_returnflag <> 'N' GROUP BY 1",
        "SELECT l_returnflag, mode(l_linestatus) AS most FROM {lineitem} WHERE l_returnflag <> 'N' GROUP BY 1",
    ),
    "fn_sketch_unions": (
        "SELECT hll_sketch_estimate(hll_union(max(s) FILTER (WHERE k = 0), max(s) FILTER (WHERE k = 1))) AS two, hll_sketch_estimate(hll_union_agg(s)) AS whole, hll_sketch_estimate(hll_sketch_union(s)) AS other_name\n"
        "FROM (SELECT n_regionkey % 2 AS k, hll_sketch_agg(n_nationkey) AS s FROM {nation} GROUP BY 1) x",
        "SELECT count(DISTINCT n_nationkey) AS two, count(DISTINCT n_nationkey) AS whole, count(DISTINCT n_nationkey) AS other_name FROM {nation}",
    ),
    "fn_sketch_errors": (
        "SELECT l_returnflag, abs(approx_count_distinct(l_partkey) / count(DISTINCT l_partkey) - 1) < 0.15 AS plain, abs(approx_count_distinct_ds_hll(l_partkey) / count(DISTINCT l_partkey) - 1) < 0.1 AS hll,\n"
        "  abs(approx_count_distinct_ds_theta(l_partkey) / count(DISTINCT l_partkey) - 1) < 0.1 AS theta, abs(approx_percentile(l_quantity, 0.5D) - median(l_quantity)) <= 1 AS middle FROM {lineitem} GROUP BY 1",
        "SELECT DISTINCT l_returnflag, true AS plain, true AS hll, true AS theta, true AS middle FROM {lineitem}",
    ),
    "fn_json_tuple": (
        "SELECT n_nationkey, t.a, t.b FROM {nation} LATERAL VIEW json_tuple(concat('{{\"a\":', n_nationkey, ',\"b\":\"', n_name, '\"}}'), 'a', 'b') t AS a, b",
        "SELECT n_nationkey, CAST(n_nationkey AS VARCHAR) AS a, n_name AS b FROM {nation}",
    ),
    "fn_more_windows": (
        "SELECT n_nationkey, last_value(n_name) OVER w AS last_name, nth_value(n_name, 2) OVER w AS second_name,\n"
        "  sum(n_nationkey) OVER (ORDER BY n_nationkey RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) AS near\n"
        "FROM {nation} WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
        "SELECT n_nationkey, last_value(n_name) OVER w AS last_name, nth_value(n_name, 2) OVER w AS second_name,\n"
        "  CAST(sum(n_nationkey) OVER (ORDER BY n_nationkey RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS near\n"
        "FROM {nation} WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    ),
    "fn_grouping_id": (
        "SELECT n_regionkey, left(n_name, 1) AS letter, count(*) AS n, CAST(grouping_id(n_regionkey, left(n_name, 1)) AS BIGINT) AS g FROM {nation} GROUP BY CUBE (n_regionkey, left(n_name, 1))",
        "SELECT n_regionkey, left(n_name, 1) AS letter, count(*) AS n, CAST(grouping_id(n_regionkey, left(n_name, 1)) AS BIGINT) AS g FROM {nation} GROUP BY CUBE (n_regionkey, left(n_name, 1))",
    ),
    "fn_more_generators": (
        "SELECT n_nationkey, 'outer' AS kind, CAST(x AS STRING) AS v FROM {nation} LATERAL VIEW OUTER explode(if(n_nationkey < 2, array(n_nationkey, 9), array())) t AS x\n"
        "UNION ALL SELECT n_nationkey, 'explode_outer', CAST(x AS STRING) FROM (SELECT n_nationkey, explode_outer(if(n_nationkey < 2, array(n_nationkey), array())) AS x FROM {nation}) y\n"
        "UNION ALL SELECT n_nationkey, 'inline', a || b FROM {nation} LATERAL VIEW inline(array(struct(n_name, '1'), struct(n_name, '2'))) t AS a, b\n"
        "UNION ALL SELECT n_nationkey, 'inline_outer', a FROM (SELECT n_nationkey, inline_outer(if(n_nationkey < 2, array(struct(n_name)), array())) AS (a) FROM {nation}) z\n"
        "UNION ALL SELECT k, 'inline_table', CAST(v AS STRING) FROM inline(array(struct(1L AS k, 2 AS v), struct(3L AS k, 4 AS v)))\n"
        "UNION ALL SELECT k, 'inline_outer_table', CAST(v AS STRING) FROM inline_outer(array(struct(5L AS k, 6 AS v)))\n"
        "UNION ALL SELECT id, 'range', NULL FROM range(3)",
        "SELECT n_nationkey, 'outer' AS kind, CAST(n_nationkey AS VARCHAR) AS v FROM {nation} WHERE n_nationkey < 2\n"
        "UNION ALL SELECT n_nationkey, 'outer', CASE WHEN n_nationkey < 2 THEN '9' END FROM {nation}\n"
        "UNION ALL SELECT n_nationkey, 'explode_outer', CASE WHEN n_nationkey < 2 THEN CAST(n_nationkey AS VARCHAR) END FROM {nation}\n"
        "UNION ALL SELECT n_nationkey, 'inline', n_name || k FROM {nation}, (VALUES ('1'), ('2')) t(k)\n"
        "UNION ALL SELECT n_nationkey, 'inline_outer', CASE WHEN n_nationkey < 2 THEN n_name END FROM {nation}\n"
        "UNION ALL VALUES (1, 'inline_table', '2'), (3, 'inline_table', '4'), (5, 'inline_outer_table', '6'), (0, 'range', NULL), (1, 'range', NULL), (2, 'range', NULL)",
    ),
    "sql_cross_join_unnest": (
        "SELECT n_nationkey, u.x FROM {nation} CROSS JOIN UNNEST(array(n_nationkey, 100)) AS u(x) WHERE u.x < 50",
        "SELECT n_nationkey, n_nationkey AS x FROM {nation}",
    ),
    "sql_with": (
        "WITH big AS (SELECT n_regionkey AS k, count(*) AS n FROM {nation} GROUP BY 1 HAVING count(*) > 1), named AS (SELECT r_name, n FROM big JOIN {region} ON k = r_regionkey) SELECT * FROM named",
    )
    * 2,
    "sql_clauses": (
        "SELECT n_regionkey, count(*) FILTER (WHERE n_nationkey > 5) AS above, count(*) AS n FROM {nation} GROUP BY 1 HAVING count(*) > 2 ORDER BY above DESC NULLS LAST, 1",
    )
    * 2,
    "sql_predicates": (
        "SELECT n_nationkey, n_name RLIKE '^A' AS rlike, n_name <=> NULL AS same, n_name LIKE ANY ('A%', 'B%') AS some, n_name LIKE ALL ('%A%', '%N%') AS every,\n"
        "  n_name ILIKE 'a%' AS ilike, n_name LIKE '%!_%' ESCAPE '!' AS escaped, CASE n_regionkey WHEN 0 THEN 'zero' ELSE 'more' END AS simple, TRIM(BOTH 'A' FROM n_name) AS trimmed,\n"
        "  n_nationkey IN (1, 2, 3) AS listed, (n_nationkey > 3 AND n_nationkey < 9) OR n_nationkey = 20 AS nested\n"
        "FROM {nation} WHERE NOT (n_nationkey = 4)",
        "SELECT n_nationkey, regexp_matches(n_name, '^A') AS rlike, n_name IS NOT DISTINCT FROM NULL AS same, n_name LIKE 'A%' OR n_name LIKE 'B%' AS some, n_name LIKE '%A%' AND n_name LIKE '%N%' AS every,\n"
        "  n_name ILIKE 'a%' AS ilike, n_name LIKE '%!_%' ESCAPE '!' AS escaped, CASE n_regionkey WHEN 0 THEN 'zero' ELSE 'more' END AS simple, TRIM(BOTH 'A' FROM n_name) AS trimmed,\n"
        "  n_nationkey IN (1, 2, 3) AS listed, (n_nationkey > 3 AND n_nationkey < 9) OR n_nationkey = 20 AS nested\n"
        "FROM {nation} WHERE NOT (n_nationkey = 4)",
    ),
    "sql_more_joins": (
        "SELECT /*+ BROADCAST(r) */ n.n_nationkey, r.r_name, s.n AS suppliers, l.k FROM {region} r, {nation} n RIGHT JOIN (SELECT s_nationkey, count(*) AS n FROM {supplier} GROUP BY 1) s ON s.s_nationkey = n.n_nationkey, LATERAL (SELECT n.n_nationkey + 1 AS k) l WHERE r.r_regionkey = n.n_regionkey",
        "SELECT n.n_nationkey, r.r_name, s.n AS suppliers, n.n_nationkey + 1 AS k FROM {region} r JOIN {nation} n ON r.r_regionkey = n.n_regionkey JOIN (SELECT s_nationkey, count(*) AS n FROM {supplier} GROUP BY 1) s ON s.s_nationkey = n.n_nationkey",
    ),
    "sql_natural_join": (
        "SELECT * FROM (SELECT n_regionkey AS r_regionkey, n_name FROM {nation}) NATURAL JOIN (SELECT r_regionkey, r_name FROM {region})",
        "SELECT * FROM (SELECT n_regionkey AS r_regionkey, n_name FROM {nation}) a NATURAL JOIN (SELECT r_regionkey, r_name FROM {region}) b",
    ),
    "sql_set_precedence": (
        "SELECT k FROM VALUES (1), (2), (2), (3) AS a(k) UNION ALL SELECT k FROM VALUES (3), (4) AS b(k) INTERSECT SELECT k FROM VALUES (4) AS c(k) MINUS SELECT k FROM VALUES (1) AS d(k)",
        "SELECT k FROM (VALUES (2), (3), (4)) t(k)",
    ),
    "sql_sort_distribute": (
        "SELECT count(*) AS n, sum(k) AS s FROM (SELECT n_nationkey AS k FROM {nation} DISTRIBUTE BY n_regionkey SORT BY n_nationkey) a UNION ALL SELECT count(*), sum(k) FROM (SELECT n_nationkey AS k FROM {nation} CLUSTER BY n_regionkey) b",
        "SELECT count(*) AS n, CAST(sum(n_nationkey) AS BIGINT) AS s FROM {nation} UNION ALL SELECT count(*), CAST(sum(n_nationkey) AS BIGINT) FROM {nation}",
    ),
    "sql_pivot": (
        "SELECT * FROM (SELECT n_regionkey, left(n_name, 1) AS letter FROM {nation}) PIVOT (count(*) FOR letter IN ('A' AS a, 'I' AS i))",
        "SELECT n_regionkey, nullif(count(*) FILTER (WHERE left(n_name, 1) = 'A'), 0) AS a, nullif(count(*) FILTER (WHERE left(n_name, 1) = 'I'), 0) AS i FROM {nation} GROUP BY 1",
    ),
}


def register(add: Callable[[str, str, str], None]) -> None:
    for name, (spark, duckdb) in TEXTS.items():
        add(name, spark, duckdb)
