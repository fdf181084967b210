"""Function names of other dialects, as Spark SQL text."""

from __future__ import annotations

from collections.abc import Callable

from gristmill.plans.expressions import calls, replace_spans, tokens

#: The time that a run stands for; ``bind_logical_time`` puts it in.
LOGICAL_TIME = "logical_timestamp"


def _strpos(*a: str) -> str:
    if len(a) == 2:
        return f"locate({a[1]}, {a[0]})"
    s, sub, n = a  # the place of the nth occurrence, 0 if there are fewer
    before = f"substring_index({s}, {sub}, {n})"
    return f"(CASE WHEN size(split({s}, concat('\\\\Q', {sub}, '\\\\E'), -1)) > {n} THEN length({before}) + 1 ELSE 0 END)"


def _big_endian(b: str) -> str:
    whole = f"CAST(conv(hex({b}), 16, 10) AS DECIMAL(20, 0))"
    return f"CAST(CASE WHEN {whole} >= 9223372036854775808 THEN {whole} - 18446744073709551616 ELSE {whole} END AS BIGINT)"


#: Each name's call in Spark SQL, by its arguments' texts.
RENAMED: dict[str, Callable[..., str]] = {
    "contains_string": lambda s, sub: f"contains({s}, {sub})",
    "strpos": _strpos,
    "from_big_endian_64": _big_endian,
    "to_utf8": lambda s: f"encode({s}, 'UTF-8')",
    "safe_divide": lambda a, b: f"try_divide({a}, {b})",
    "array_concat": lambda *a: f"concat({', '.join(a)})",
    "array_length": lambda a: f"size({a})",
    "array_offset": lambda a, k: f"get({a}, {k})",
    "array_ordinal": lambda a, k: f"try_element_at({a}, {k})",
    "hll_sketch_union": lambda x: f"hll_union_agg({x})",
    "approx_count_distinct_ds_hll": lambda x: f"hll_sketch_estimate(hll_sketch_agg({x}))",
    "approx_count_distinct_ds_theta": lambda x: f"theta_sketch_estimate(theta_sketch_agg({x}))",
    "week": lambda d: f"weekofyear({d})",
    "unnest": lambda a: f"explode({a})",
}


def _in_from(sql: str, at: int) -> bool | None:
    """Whether the place belongs to a FROM clause, behind a join or a comma; None if it stands first in it, or in no FROM."""
    word, depth = None, 0
    before = [t for t in tokens(sql) if t.end <= at]
    for t in reversed(before):
        if t.kind == "other":
            depth += (t.text == ")") - (t.text == "(")
            if depth < 0:
                break
        elif t.kind == "name" and not depth and t.text.upper() in ("SELECT", "FROM", "JOIN", "WHERE", "ON", "BY", "HAVING", "LATERAL"):
            word = t.text.upper()
            break
    if word not in ("FROM", "JOIN"):
        return None
    return before[-1].text == "," or before[-1].text.upper() == "JOIN" or None


def to_spark(sql: str) -> str:
    """The text with calls of other dialects replaced, inner ones too. UNNEST behind a join or a comma becomes a lateral table."""
    sql = replace_spans(sql, [(c.start, c.start + len(c.name), "LATERAL explode") for c in calls(sql) if c.name == "unnest" and _in_from(sql, c.start)])
    found = [c for c in calls(sql) if c.name in RENAMED and c.over is None]
    outer = [c for c in found if not any(o.start < c.start < o.end for o in found)]
    return replace_spans(sql, [(c.start, c.end, RENAMED[c.name](*map(to_spark, c.args))) for c in outer]) if outer else sql


def bind_logical_time(sql: str, timestamp: str) -> str:
    """Calls of logical_timestamp() or logical_timestamp('format') as literals of the run's time."""
    spans = []
    for c in calls(sql):
        if c.name == LOGICAL_TIME:
            spans.append((c.start, c.end, f"date_format(TIMESTAMP '{timestamp}', {c.args[0]})" if c.args else f"'{timestamp}'"))
    return replace_spans(sql, spans)
