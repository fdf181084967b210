"""Aggregates as mergeable components: accumulate over rows, merge over partial results, combine to the value."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass, replace
from enum import IntEnum

from gristmill.plans.expressions import AGGREGATES, Call, calls, replace_spans, safe_division


class Aggregability(IntEnum):
    """How far a component can be rolled up: freely; only with its level in the grain; not at all."""

    FULL = 0
    LIMITED = 1
    NONE = 2


@dataclass(frozen=True)
class Component:
    name: str
    expression: str
    accumulate: str  # SQL over rows
    merge: str  # SQL over components
    kind: str  # the accumulating function

    @property
    def identity(self) -> str:
        """What makes two stored measures the same: the expression up to white space, and how it was accumulated."""
        return hashlib.md5(re.sub(r"\s+", " ", self.expression).strip().encode()).hexdigest()[:12] + self.kind.upper()


@dataclass(frozen=True)
class Decomposed:
    """components, and the final expression over merged components (or over rows, if not FULL)."""

    components: tuple[Component, ...]
    final: str
    aggregability: Aggregability
    level: tuple[str, ...] = ()  # LIMITED: what must be in the grain


def _component(kind: str, expression: str, source: str, merge: str | None = None) -> Component:
    base = "_".join(re.findall(r"[A-Za-z_]\w*", expression))[:40] or "rows"
    name = f"{base}_{kind}_{hashlib.md5(f'{expression}|{source}'.encode()).hexdigest()[:8]}"
    return Component(name, expression, f"{kind}({expression})", f"{merge or kind}({name})", kind)


#: What makes the parts of a call: (call, make a component) -> (components, the value over their merges).
Maker = Callable[[Call, Callable[..., Component]], tuple[list[Component], str]]
_MAKERS: dict[str, tuple[int, Maker]] = {}


def decomposes(*functions: str, arguments: int = 1) -> Callable[[Maker], Maker]:
    """Registers how calls of these aggregates, with so many arguments, are stored in parts; a later registration replaces an earlier one."""

    def register(maker: Maker) -> Maker:
        _MAKERS.update(dict.fromkeys(functions, (arguments, maker)))
        AGGREGATES.update(functions)
        return maker

    return register


@decomposes("sum", "max", "min", "any_value")
def _same(call: Call, make: Callable[..., Component]) -> tuple[list[Component], str]:
    return [c := make(call.name, call.args[0])], c.merge


@decomposes("count", "count_if")
def _counted(call: Call, make: Callable[..., Component]) -> tuple[list[Component], str]:
    return [c := make(call.name, call.args[0], "sum")], f"coalesce({c.merge}, 0)"


@decomposes("avg", "mean")
def _average(call: Call, make: Callable[..., Component]) -> tuple[list[Component], str]:
    s, n = make("sum", call.args[0]), make("count", call.args[0], "sum")
    return [s, n], f"CAST({s.merge} AS DOUBLE) / NULLIF({n.merge}, 0)"


@decomposes("approx_count_distinct", "approx_count_distinct_ds_hll")
def _sketched(call: Call, make: Callable[..., Component]) -> tuple[list[Component], str]:
    c = make("hll_sketch_agg", call.args[0], "hll_union_agg")
    return [c], f"coalesce(hll_sketch_estimate({c.merge}), 0)"


@decomposes("var_pop", "var_samp", "variance", "stddev_pop", "stddev_samp", "stddev")
def _spread(call: Call, make: Callable[..., Component]) -> tuple[list[Component], str]:
    d = f"CAST({call.args[0]} AS DOUBLE)"
    s, q, n = make("sum", d), make("sum", f"{d} * {d}"), make("count", call.args[0], "sum")
    spread = f"greatest({q.merge} - {s.merge} * {s.merge} / NULLIF({n.merge}, 0), 0D)"
    value = f"{spread} / NULLIF({n.merge}{'' if call.name.endswith('pop') else ' - 1'}, 0)"
    return [s, q, n], f"sqrt({value})" if call.name.startswith("stddev") else f"({value})"


@decomposes("covar_pop", "covar_samp", "corr", arguments=2)
def _together(call: Call, make: Callable[..., Component]) -> tuple[list[Component], str]:
    a, b = call.args
    both = f"({a}) IS NOT NULL AND ({b}) IS NOT NULL"
    u, v = (f"CASE WHEN {both} THEN CAST({y} AS DOUBLE) END" for y in (a, b))
    su, sv, uv, n = make("sum", u), make("sum", v), make("sum", f"({u}) * ({v})"), make("count_if", both, "sum")
    cross = f"({uv.merge} - {su.merge} * {sv.merge} / NULLIF({n.merge}, 0))"
    if call.name != "corr":
        return [su, sv, uv, n], f"{cross} / NULLIF({n.merge}{' - 1' if call.name == 'covar_samp' else ''}, 0)"
    uu, vv = make("sum", f"({u}) * ({u})"), make("sum", f"({v}) * ({v})")
    var = lambda s, q: f"greatest({q.merge} - {s.merge} * {s.merge} / NULLIF({n.merge}, 0), 0D)"
    return [su, sv, uv, uu, vv, n], f"{cross} / NULLIF(sqrt({var(su, uu)} * {var(sv, vv)}), 0)"


def _parts(call: Call, source: str) -> tuple[list[Component], str] | None:
    """Components of one aggregate and its value over their merges."""
    arguments, maker = _MAKERS.get(call.name, (0, None))
    if maker is None or max(len(call.args), 1) != arguments:
        return None
    call = call if call.args else replace(call, args=("*",))
    return maker(call, lambda kind, x, merge=None: _component(kind, x, source, merge))


def decompose(expression: str, source: str) -> Decomposed:
    """A metric's expression, with aggregates over one source."""
    outer: list[Call] = []
    for c in calls(expression):
        if c.aggregate and c.over is None and not any(o.start <= c.start < o.end for o in outer):
            outer.append(c)
    if not outer:
        raise ValueError(f"no aggregate in {expression}")
    safe = safe_division(expression)
    if any(c.distinct for c in outer):
        whole = all(c.distinct or c.name in ("min", "max") for c in outer)
        return Decomposed((), safe, Aggregability.LIMITED if whole else Aggregability.NONE, tuple(dict.fromkeys(a for c in outer for a in c.args)))
    found = [_parts(c, source) for c in outer]
    if any(f is None for f in found):
        return Decomposed((), safe, Aggregability.NONE)
    parts = {c.name: c for f in found for c in f[0]}
    final = replace_spans(expression, [(c.start, c.end, f"({f[1]})") for c, f in zip(outer, found, strict=True)])
    return Decomposed(tuple(parts.values()), safe_division(final), Aggregability.FULL)


#: Aggregates that give the same value when rows are repeated.
INVARIANT = frozenset("min max any_value approx_count_distinct bool_and bool_or every some max_by min_by collect_set".split())


def inflates(expression: str) -> bool:
    """Whether rows repeated by a join change the value."""
    return any(c.aggregate and not c.distinct and c.name not in INVARIANT for c in calls(expression))
