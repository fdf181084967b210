"""The planner: metrics by dimensions in, one lazy DataFrame out.

Rules that Catalyst can't know are applied here: join paths and roles, joins left
out where a foreign key says all, one scan per fact for all of its metrics, every
metric at one row per requested dimensions before facts are combined (so no join
can repeat rows), windows over the aggregated rows, look-back, densification and
rollups. Everything physical is left to Catalyst and adaptive execution.

Facts are combined by a union and one more aggregation instead of full outer
joins: one shuffle for any number of facts, and null keys meet.
"""

from __future__ import annotations

import difflib
import json
import re
import warnings
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions.dialect import to_spark
from gristmill.plans.decompose import Aggregability, Component, decompose, inflates
from gristmill.plans.expressions import WINDOW_ONLY, Over, calls, names, over, replace_names, replace_spans, safe_division, split, tokens
from gristmill.plans.model import Attribute, Link, ModelError, Registry


#: Names without parentheses that Spark takes for values of the session where no column has them.
LITERAL_NAMES = ("current_date", "current_timestamp", "current_time", "current_user", "user", "session_user", "localtimestamp")


class FanOutWarning(UserWarning):
    """A join on the way repeats rows that a metric adds up."""


@dataclass
class GrainGroup:
    """Components of one fact at one grain."""

    parent: str
    dimensions: dict[Attribute, str]
    components: dict[str, Component]
    frame: DataFrame
    levels: tuple[str, ...] = ()
    whole: tuple[str, ...] = ()  # metrics that are computed from these rows as they are


@dataclass
class Rollup:
    """A stored grain group: attributes and component identities by column.

    covered: inclusive bounds of attributes. filters: what its rows were filtered
    by; it answers only requests whose own filters imply them.
    """

    name: str
    parent: str
    dimensions: dict[Attribute, str]
    components: dict[str, str]
    levels: tuple[str, ...]
    frame: DataFrame
    covered: dict[Attribute, tuple] = field(default_factory=dict)
    filters: tuple[str, ...] = ()


def _same(text: str) -> str:
    """A filter up to white space and the case of all but its strings."""
    return " ".join(t.text if t.kind == "string" else t.text.lower() for t in tokens(text))


_LITERAL = r"(?:(?:DATE|TIMESTAMP)\s*)?(?:'([^']*)'|(-?\d+(?:\.\d+)?))"


def _comparison(text: str) -> tuple[str, str, str | float] | None:
    """(name, operator, value) of a comparison with a literal."""
    m = re.fullmatch(rf"\s*([\w.]+(?:\[[\w>\-]+\])?)\s*(>=|<=|=|>|<)\s*{_LITERAL}\s*", text, re.I)
    return (m[1].lower(), m[2], m[3] if m[3] is not None else float(m[4])) if m else None


def _conjuncts(text: str) -> list[str]:
    """The parts of a filter between ANDs outside parentheses; BETWEEN, OR and CASE keep a filter whole."""
    ts = tokens(text)
    if any(t.kind == "name" and t.text.upper() in ("BETWEEN", "OR", "CASE") for t in ts):
        return [text]
    out, start, depth = [], 0, 0
    for t in ts:
        depth += (t.text in "([") - (t.text in ")]") if t.kind == "other" else 0
        if t.kind == "name" and t.text.upper() == "AND" and not depth:
            out.append(text[start : t.start])
            start = t.end
    return [*out, text[start:]]


def implied(wanted: str, filters: Iterable[str]) -> bool:
    """Whether rows that meet all the filters are sure to meet the wanted one: the same text, or a tighter comparison."""
    have = [c for f in filters for c in _conjuncts(f)]
    if _same(wanted) in {_same(f) for f in [*have, *filters]}:
        return True
    parts = _conjuncts(wanted)
    if len(parts) > 1:
        return all(implied(p, have) for p in parts)
    if (w := _comparison(wanted)) is None:
        return False
    for name, op, value in filter(None, map(_comparison, have)):
        if name != w[0] or type(value) is not type(w[2]):
            continue
        if op == "=" and {"=": value == w[2], ">": value > w[2], ">=": value >= w[2], "<": value < w[2], "<=": value <= w[2]}[w[1]]:
            return True
        if op[0] == w[1][0] != "=" and (value > w[2] if op[0] == ">" else value < w[2]):
            return True
        if op[0] == w[1][0] and value == w[2] and (op == w[1] or w[1] in (">=", "<=")):
            return True
    return False


def _end(flat: list[dict], k: int) -> int:
    """Behind the subtree of the k-th node of a tree that is listed node by node, parents first."""
    at, left = k, 1
    while left:
        left += flat[at]["num-children"] - 1
        at += 1
    return at


def _trees(x: object) -> list[list[dict]]:
    """The expression trees, each as a list of nodes, among the fields of a plan's node."""
    if isinstance(x, dict):
        return [t for v in x.values() for t in _trees(v)]
    if not isinstance(x, list):
        return []
    if x and all(isinstance(y, dict) and "class" in y and "num-children" in y for y in x):
        return [x, *(t for y in x for v in y.values() for t in _trees(v))]
    return [t for y in x for t in _trees(y)]


@dataclass
class _Scan:
    """A fact with the dimensions that a request needs: the attributes' columns in frame."""

    frame: DataFrame
    columns: dict[Attribute, str]
    links: list[Link]


class Engine:
    def __init__(self, spark: SparkSession, registry: Registry, read: Callable[[str], DataFrame], check_freshness: bool = False, frames: dict[str, DataFrame] | None = None):
        """frames: analysed nodes, to be shared by engines of one registry, reader and session; files that come later aren't seen."""
        self.spark, self.registry, self._read, self.check_freshness = spark, registry, read, check_freshness
        self._frames: dict[str, DataFrame] = {} if frames is None else frames
        self.rollups: list[Rollup] = []
        #: Stored cubes: ``parent`` is the cube, components are by their names.
        self.cube_tables: list[Rollup] = []
        #: Names of rollups that the last request was answered from.
        self.used: list[str] = []

    # Nodes -------------------------------------------------------------------------------------------------------

    def frame(self, name: str) -> DataFrame:
        """A node's rows; SQL nodes are resolved over the nodes they read."""
        return self._framed(name, self._frames)

    def _framed(self, name: str, frames: dict[str, DataFrame]) -> DataFrame:
        for n in self.registry.node_order([name]):
            if n in frames:
                continue
            node = self.registry.node(n)
            if node.query is None:
                frames[n] = self._read(node.table or n)
                continue
            read = {x: frames[x] for x in self.registry._reads(n)}
            views = {x: f"gristmill_{id(self)}_{x}".replace(".", "_") for x in read}
            for x, df in read.items():
                df.createOrReplaceTempView(views[x])
            swap = lambda t, v=views: next((v[x] + t[len(x) :] for x in sorted(v, key=len, reverse=True) if t == x or t.startswith(f"{x}.")), None)
            frames[n] = self.spark.sql(replace_names(to_spark(node.query), swap))
            for v in views.values():
                self.spark.catalog.dropTempView(v)
        return frames[name]

    def use_table(self, name: str, frame: DataFrame) -> None:
        """From now on a node is read from a materialised table."""
        if missing := set(self.frame(name).columns) - set(frame.columns):
            raise ModelError(f"the table lacks {sorted(missing)}")
        # Nodes that read it are analysed anew, and other engines keep what they have.
        stale = {name, *self.registry.downstream(name)}
        self._frames = {k: v for k, v in self._frames.items() if k not in stale}
        self._frames[name] = frame

    # Dimensions --------------------------------------------------------------------------------------------------

    def _derived(self, a: Attribute, chain: tuple[Link, ...]) -> tuple[str, tuple[str, ...]] | None:
        """(SQL over columns of the node before, those columns) of an attribute that the key of its dimension tells."""
        link = chain[-1] if chain else None
        text = dict(self.registry.node(a.node).derived).get(a.column)
        if text is None or link is None or not link.total or not link.pairs or link.how not in ("left", "inner"):
            return None
        own = {d: n for n, d in link.pairs}
        return replace_names(text, own.get), tuple(own[t.text] for t in names(text))

    def _resolve(self, fact: str, a: Attribute) -> tuple[tuple[Link, ...], str]:
        """(links to join, column of the last one's dimension, or of the fact). Hops that only fetch a key are left out."""
        if a.node == fact and not a.role:
            return (), a.column
        for r in self.registry.references:
            if (r.node, r.dimension, r.attribute) == (fact, a.node, a.column) and r.role in ("", a.role):
                return (), r.column
        found = self.registry.path(fact, a.node, a.role)
        if found is None:
            near = ", ".join(map(str, self.registry.dimensions_of(fact)))
            raise ModelError(f"{a} can't be reached from {fact}; it reaches {near or 'nothing'}")
        chain, met = found
        if not met:
            warnings.warn(f"{fact} has no role {a.role!r} to {a.node}; its own link is used", stacklevel=2)
        column = a.column
        while chain and chain[-1].how == "left" and chain[-1].default is None and chain[-1].pairs:
            own = {d: n for n, d in chain[-1].pairs}
            if column not in own:
                break
            column, chain = own[column], chain[:-1]
        return chain, column

    def _upstream(self, fact: str, a: Attribute) -> tuple[str | None, list[tuple[str, str]]]:
        """For a key of a dimension that only nodes above the fact link to: (the fact's column that has it, [(node above, its column)])."""
        direct, passed, above = set(self.registry._reads(fact)), set(), []
        for node in self.registry.upstream(fact):
            for x in self.registry.links:
                own = {d: n for n, d in x.pairs or ()} if (x.node, x.dimension) == (node, a.node) and a.role in ("", x.role) else {}
                if (column := own.get(a.column)) is None:
                    continue
                if node in direct and column in self.frame(fact).columns and self.lineage(fact).get(column) == self._roots(node, column):
                    passed.add(column)
                else:
                    above.append((node, column))
        return (passed.pop() if len(passed) == 1 else None), above

    def _roots(self, node: str, column: str) -> list[str]:
        return [f"{node}.{column}"] if self.registry.node(node).query is None else self.lineage(node).get(column, [])

    def _pushed_up(self, fact: str, filters: list[str]) -> tuple[DataFrame, list[str], dict[Attribute, str]]:
        """(the fact over filtered nodes above it, filters left over, columns of the fact for attributes it has from above).

        That is for filters on dimensions that the fact doesn't reach itself.
        """
        columns: dict[Attribute, str] = {}
        pushed: dict[str, list[Column]] = {}
        left = []
        for f in filters:
            far = [a for a in self._attributes(f) if not (a.node == fact and not a.role) and not any((r.node, r.dimension, r.attribute) == (fact, a.node, a.column) for r in self.registry.references) and self.registry.path(fact, a.node, a.role) is None]
            found = {a: self._upstream(fact, a) for a in far}
            if not far or not all(own or above for own, above in found.values()):
                left.append(f)
            elif all(own for own, _ in found.values()):
                columns |= {a: own for a, (own, _) in found.items()}
                left.append(f)
            else:
                each = [dict(above) for _, above in found.values()]
                nodes = [n for n in each[0] if all(n in x for x in each)] if len(far) == len(self._attributes(f)) else []
                if not nodes:
                    raise ModelError(f"the attributes of {f!r} meet at no node above {fact}")
                for n in nodes:
                    pushed.setdefault(n, []).append(self._filter(f, {a: dict(above)[n] for a, (_, above) in found.items()}))
        if not pushed:
            return self.frame(fact), left, columns
        own: dict[str, DataFrame] = {}
        for n in self.registry.node_order([fact]):
            if n in pushed or set(self.registry._reads(n)) & set(own):
                # Anew over what is filtered already, if it reads any of that.
                df = self._framed(n, {x: own[x] if x in own else self.frame(x) for x in self.registry.upstream(n)}) if set(self.registry._reads(n)) & set(own) else self.frame(n)
                for c in pushed.get(n, ()):
                    df = df.where(c)
                own[n] = df
        return own[fact], left, columns

    def _scan(self, fact: str, wanted: Iterable[Attribute], filters: Iterable[str] = ()) -> _Scan:
        filters = [*filters]
        base, waiting, passed = self._pushed_up(fact, filters)
        met = {a for f in filters if f not in waiting for a in self._attributes(f)}
        resolved = {a: ((), passed[a]) if a in passed else self._resolve(fact, a) for a in dict.fromkeys(wanted) if a not in met}
        joins: dict[tuple[Link, ...], set[str]] = {}
        made: dict[Attribute, tuple[tuple[Link, ...], str, tuple[str, ...]]] = {}
        for a, (chain, column) in [*resolved.items()]:
            needed = (column,)
            if (derived := self._derived(a, chain)) is not None:
                chain, needed = chain[:-1], derived[1]
                made[a] = chain, *derived
                resolved[a] = (), f"e{len(made)}__{column}"
            for k in range(1, len(chain) + 1):
                joins.setdefault(chain[:k], set())
            if chain:
                joins[chain].update(needed)
        for chain in joins:
            for t in names(chain[-1].on):
                node, _, column = t.text.rpartition(".")
                if node == chain[-1].dimension:
                    joins[chain].add(column)
                if node == chain[-1].node and len(chain) > 1:
                    joins[chain[:-1]].add(column)
        alias = {c: f"d{k}" for k, c in enumerate(joins)}
        df = base

        def column_of(a: Attribute) -> str:
            chain, column = resolved[a]
            return f"{alias[chain]}__{column}" if chain else column

        def filtered(df: DataFrame) -> DataFrame:
            """Filters take effect as soon as their columns are there, so before joins that keep unmatched rows."""
            for a, (chain, text, needed) in [*made.items()]:
                own = {c: f"{alias[chain]}__{c}" if chain else c for c in needed}
                if set(own.values()) <= set(df.columns):
                    df = df.withColumn(resolved[a][1], F.expr(replace_names(text, own.get)))
                    del made[a]
            for f in [*waiting]:
                if all(column_of(a) in df.columns for a in self._attributes(f)):
                    df = df.where(self._filter(f, {a: column_of(a) for a in self._attributes(f)}))
                    waiting.remove(f)
            return df

        outer = lambda chain: any(x.how in ("right", "full") for x in chain)
        for chain in sorted(joins, key=lambda c: (outer(c), len(c))):
            link = chain[-1]
            if link.how in ("right", "full"):
                df = filtered(df)
            dim = self.frame(link.dimension).select(*[F.col(c).alias(f"{alias[chain]}__{c}") for c in sorted(joins[chain])])
            dim = dim.hint(link.hint) if link.hint else dim
            if link.how == "cross":
                df = df.crossJoin(dim)
            else:
                df = df.join(dim, F.expr(self._condition(chain, alias)), link.how)
            for own, key in (link.pairs or ()) if link.how in ("right", "full") and len(chain) == 1 else ():
                df = df.withColumn(own, F.coalesce(own, f"{alias[chain]}__{key}"))
            if link.default is not None:
                for c in joins[chain] - {d for _, d in link.pairs or ()}:
                    name = f"{alias[chain]}__{c}"
                    df = df.withColumn(name, F.coalesce(F.col(name), F.lit(link.default).cast(df.schema[name].dataType)))
        df = filtered(df)
        return _Scan(df, {a: column_of(a) for a in resolved}, [x for chain in joins for x in chain])

    @staticmethod
    def _condition(chain: tuple[Link, ...], alias: dict) -> str:
        link, seen = chain[-1], []

        def column(text: str) -> str | None:
            node, _, name = text.rpartition(".")
            if node not in (link.node, link.dimension):
                return None
            own = node == link.dimension and (link.node != link.dimension or len(seen) % 2 == 1)
            seen.append(text)
            return f"{alias[chain]}__{name}" if own else f"{alias[chain[:-1]]}__{name}" if len(chain) > 1 else name

        return replace_names(link.on, column)

    # Filters -----------------------------------------------------------------------------------------------------

    def _attributes(self, text: str) -> list[Attribute]:
        return [Attribute.parse(t.text) for t in names(text) if "." in t.text and t.text not in self.registry.metrics]

    def _filter(self, text: str, columns: dict[Attribute, str]) -> Column:
        swap = lambda t: f"`{columns[Attribute.parse(t)]}`" if "." in t and t not in self.registry.metrics else None
        return F.expr(to_spark(replace_names(text, swap)))

    def _classified(self, filters: Iterable[str]) -> tuple[list[str], list[str]]:
        """(filters on rows, filters on metrics)."""
        rows, having, wrong = [], [], []
        for f in filters:
            wrong += self._unknown(f)
            (having if any(t.text in self.registry.metrics for t in names(f)) else rows).append(f)
        if wrong:
            known = [*self.registry.metrics, *(f"{n}.{k}" for n, x in self.registry.nodes.items() for k in x.primary_key)]
            near = {w: difflib.get_close_matches(w, known, 2) for w in sorted(set(wrong))}
            raise ModelError("neither a metric nor node.column: " + ", ".join(w + (f" (is it {' or '.join(x)}?)" if x else "") for w, x in near.items()))
        return rows, having

    def _unknown(self, text: str) -> list[str]:
        """What Spark's parser takes for a column in a filter, and that is no metric and no node.column."""
        placed: dict[str, str] = {}

        def place(t: str) -> str | None:
            if t not in self.registry.metrics and "." not in t:
                return None
            return f"`{placed.setdefault(t, f'known_{len(placed)}')}`"

        parser = self.spark._jsparkSession.sessionState().sqlParser()
        leaves = parser.parseExpression(to_spark(replace_names(text, place))).collectLeaves()
        found = [leaves.apply(k) for k in range(leaves.size())]
        columns = [x.name().strip("`") for x in found if x.getClass().getSimpleName() == "UnresolvedAttribute"]
        return [c for c in columns if c not in placed.values() and c.lower() not in LITERAL_NAMES]

    # Metrics -----------------------------------------------------------------------------------------------------

    @staticmethod
    def _column(metric: str) -> str:
        return "m__" + metric.replace(".", "__")

    def _labels(self, attributes: Iterable[Attribute]) -> dict[Attribute, str]:
        """The shortest name that is taken by none before: column, then with role's last hop, node, and a number."""
        out: dict[Attribute, str] = {}
        for a in attributes:
            base = f"{a.column}_{a.role.split('->')[-1]}" if a.role else a.column
            options = [base, f"{a.node.replace('.', '_')}_{base}"]
            taken = set(out.values())
            out[a] = next((x for x in options if x not in taken), None) or next(f"{options[-1]}_{k}" for k in range(1, len(taken) + 2) if f"{options[-1]}_{k}" not in taken)
        return out

    def _overs(self, metric: str) -> list[Over]:
        return [over(c.over) for c in calls(self.registry.metrics[metric].expression) if c.over is not None]

    def _windowed(self, metric: str) -> bool:
        return bool(self._overs(metric))

    def _needs_window(self, metric: str) -> bool:
        return any(self._windowed(m) for m in self.registry.metric_order([metric]))

    def query(self, metrics: Iterable[str], dimensions: Iterable[str] = (), filters: Iterable[str] = (), orderby: Iterable[str] = (), limit: int | None = None, parameters: dict | None = None, densify: bool = False) -> DataFrame:
        """Requested dimensions, then metrics by the last part of their name.

        Filters that name a metric act on the result's rows, all others on the
        facts' rows; dimensions that only filters name are not in the result.
        """
        metrics, self.used = [*metrics], []
        filters = [self._bound(f, parameters or {}) for f in filters]
        rows, having = self._classified(filters)
        order = self.registry.metric_order([*metrics, *(t.text for f in having for t in names(f) if t.text in self.registry.metrics)])
        for m in order:
            if wrong := [p for p in self.registry.metric_parts(m) if (own := self.registry.metrics[p]).parent and decompose(to_spark(own.expression), own.parent).aggregability is Aggregability.NONE]:
                raise ModelError(f"{m} can't be made of {wrong}, which can't be merged from parts")
        shown = [Attribute.parse(d) for d in dict.fromkeys(dimensions)]
        for m in order:
            more = [*self.registry.metrics[m].required, *(e for o in self._overs(m) for e, _ in o.order)]
            for a in (Attribute.parse(x) for x in more if "." in x and x not in self.registry.metrics):
                if not any((b.node, b.column) == (a.node, a.column) for b in shown):
                    shown.append(a)
        labels = self._labels(shown)
        base_rows, again = self._looked_back(order, shown, rows)
        df = self._values(order, shown, labels, base_rows, densify)
        for f in again:
            df = df.where(self._filter(f, labels))
        for f in having:
            df = df.where(F.expr(to_spark(replace_names(f, lambda t: self._column(t) if t in self.registry.metrics else f"`{labels[Attribute.parse(t)]}`" if "." in t else None))))
        keys = self._ordering(orderby, metrics, labels)
        df = df.orderBy(*keys) if keys else df
        df = df.limit(limit) if limit is not None else df
        return df.select(*[F.col(f"`{labels[a]}`") for a in shown], *[F.col(self._column(m)).alias(m.rpartition(".")[2]) for m in metrics])

    @staticmethod
    def _bound(text: str, parameters: dict) -> str:
        """The text with :name parameters as literals."""
        ts, spans = tokens(text), []
        for a, b in zip(ts, ts[1:], strict=False):
            if a.text == ":" and b.kind == "name" and a.end == b.start:
                if b.text not in parameters:
                    raise ModelError(f"no value for the parameter {b.text}")
                v = parameters[b.text]
                spans.append((a.start, b.end, "NULL" if v is None else str(v) if isinstance(v, int | float) and not isinstance(v, bool) else str(v).upper() if isinstance(v, bool) else "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"))
        return replace_spans(text, spans)

    def _ordering(self, orderby: Iterable[str], metrics: list[str], labels: dict[Attribute, str]) -> list[Column]:
        out, wrong = [], []
        for text in orderby:
            m = re.fullmatch(r"\s*(.+?)(?:\s+(asc|desc))?(?:\s+nulls\s+(first|last))?\s*", text, re.I)
            if m[1] in metrics:
                c = F.col(self._column(m[1]))
            elif "." in m[1] and (a := Attribute.parse(m[1])) in labels:
                c = F.col(f"`{labels[a]}`")
            else:
                wrong.append(m[1])
                continue
            down, nulls = (m[2] or "asc").lower() == "desc", (m[3] or ("last" if (m[2] or "").lower() == "desc" else "first")).lower()
            out.append(getattr(c, f"{'desc' if down else 'asc'}_nulls_{nulls}")())
        if wrong:
            raise ModelError(f"can't order by {wrong}: not among the requested metrics and dimensions")
        return out

    def _values(self, order: list[str], shown: list[Attribute], labels: dict[Attribute, str], filters: list[str], densify: bool = False) -> DataFrame:
        """All metrics of ``order`` at one row per shown attributes, in columns by ``_column``."""
        by_fact: dict[str, list[str]] = {}
        for m in order:
            if (p := self.registry.metrics[m].parent) is not None:
                by_fact.setdefault(p, []).append(m)
        if not by_fact:
            raise ModelError("no metric is asked for")
        if len(by_fact) > 1 and shown:
            for fact in by_fact:  # raises where they share no dimension
                for a in shown:
                    self._resolve(fact, a)
        keys = [labels[a] for a in shown]
        if (cube := self.find_cube([m for own in by_fact.values() for m in own], shown, filters)) is not None:
            self.used.append(cube.name)
            facts = [self._from_cube(cube, by_fact, shown, labels, filters)]
        else:
            facts = [self._fact(fact, own, shown, labels, filters) for fact, own in by_fact.items()]
        df = facts[0]
        if len(facts) > 1:
            for other in facts[1:]:
                df = df.unionByName(other, allowMissingColumns=True)
            df = df.groupBy(*keys).agg(*[F.first(c, ignorenulls=True).alias(c) for c in df.columns if c not in keys])
        if densify:
            df = self._dense(df, order, shown, labels, filters)
        return self._derived_metrics(df, order, shown, labels, filters)

    def _derived_metrics(self, df: DataFrame, order: list[str], shown: list[Attribute], labels: dict[Attribute, str], filters: list[str]) -> DataFrame:
        """Adds the metrics of ``order`` that are made of others."""
        for m in order:
            own = self.registry.metrics[m]
            if own.parent is not None:
                continue
            if self._windowed(m):
                df = self._window(df, m, order, shown, labels, filters)
            else:
                df = df.withColumn(self._column(m), F.expr(safe_division(to_spark(replace_names(own.expression, lambda t: self._column(t) if t in self.registry.metrics else None)))))
        return df

    def _fact(self, fact: str, metrics: list[str], shown: list[Attribute], labels: dict[Attribute, str], filters: list[str]) -> DataFrame:
        """The metrics of one fact: one scan, one aggregation; from a rollup if one will do."""
        if (stored := self._stored(fact, metrics, shown, filters)) is not None:
            rollup, scan = stored
            self.used.append(rollup.name)
            for f in self._left_over(rollup, filters):
                scan = _Scan(scan.frame.where(self._filter(f, scan.columns)), scan.columns, [])
        else:
            rollup, scan = None, self._scan(fact, [*shown, *(a for f in filters for a in self._attributes(f))], filters)
        for a in shown:
            if a not in scan.columns:  # met above the fact by a filter, but not there to be shown
                self._resolve(fact, a)
        if many := [x for x in scan.links if x.cardinality in ("one_to_many", "many_to_many")]:
            if wrong := [m for m in metrics if inflates(self.registry.metrics[m].expression)]:
                warnings.warn(f"the links to {[x.dimension for x in many]} repeat rows of {fact} that {wrong} add up", FanOutWarning, stacklevel=2)
        parts = {m: decompose(to_spark(self.registry.metrics[m].expression), fact) for m in metrics}
        keys = [F.col(f"`{scan.columns[a]}`").alias(labels[a]) for a in shown]
        if rollup is not None:
            swap = {c.name: rollup.components[c.identity] for d in parts.values() for c in d.components}
            agg = [F.expr(replace_names(parts[m].final, swap.get)).alias(self._column(m)) for m in metrics]
            return scan.frame.groupBy(*keys).agg(*agg)
        components = {c.name: c for d in parts.values() for c in d.components}
        agg = [F.expr(c.accumulate).alias(c.name) for c in components.values()]
        agg += [F.expr(d.final).alias(self._column(m)) for m, d in parts.items() if d.aggregability > Aggregability.FULL]
        df = scan.frame.groupBy(*keys).agg(*agg)
        out = []
        for m, d in parts.items():
            final = d.final
            for c in d.components:  # one row a group: what is merged is the component itself
                final = final.replace(c.merge, c.name)
            out.append(F.col(self._column(m)) if d.aggregability > Aggregability.FULL else F.expr(final).alias(self._column(m)))
        return df.select(*[F.col(f"`{labels[a]}`") for a in shown], *out)

    def find_cube(self, metrics: Iterable[str], shown: Iterable[Attribute], filters: Iterable[str] = ()) -> Rollup | None:
        """The stored cube of fewest dimensions that has all metrics, and all dimensions shown or filtered by, with the same roles."""
        filters, metrics = [*filters], [*metrics]
        best = None
        for c in self.cube_tables:
            own = self.registry.cubes[c.parent]
            parts = [x for m in metrics for x in decompose(to_spark(self.registry.metrics[m].expression), self.registry.metrics[m].parent).components]
            asked = {*shown, *(a for f in self._left_over(c, filters) for a in self._attributes(f))}
            if not all(m in self.registry.metric_order(own.metrics) for m in metrics) or not asked <= set(c.dimensions):
                continue
            if not all(x.name in c.components for x in parts) or not all(implied(f, filters) for f in c.filters):
                continue
            if best is None or len(c.dimensions) < len(best.dimensions):
                best = c
        return best

    def _from_cube(self, cube: Rollup, by_fact: dict[str, list[str]], shown: list[Attribute], labels: dict[Attribute, str], filters: list[str]) -> DataFrame:
        """The metrics of all facts from one table: one aggregation."""
        df = cube.frame
        for f in self._left_over(cube, filters):
            df = df.where(self._filter(f, cube.dimensions))
        several = len({p for m in self.registry.cubes[cube.parent].metrics for p in self.registry.parents(m)}) > 1
        agg = []
        for fact, metrics in by_fact.items():
            for m in metrics:
                d = decompose(to_spark(self.registry.metrics[m].expression), fact)
                there = " + ".join(f"count({c.name})" for c in d.components)
                # A group that this fact has no rows of has no value, as when it is read from rows.
                agg.append((F.when(F.expr(f"{there} > 0"), F.expr(d.final)) if several else F.expr(d.final)).alias(self._column(m)))
        return df.groupBy(*[F.col(f"`{cube.dimensions[a]}`").alias(labels[a]) for a in shown]).agg(*agg)

    def materialize_cube(self, name: str, write: Callable[[DataFrame, str], DataFrame]) -> Rollup:
        """Stores a cube's components by its dimensions in one table; requests that it covers are answered from it.

        Only cubes whose metrics all merge freely can be stored.
        """
        own = self.registry._found(self.registry.cubes, name, "cube")
        filters = [*own.filters]
        groups = self.measures(own.metrics, own.dimensions, filters)
        if any(g.levels for g in groups):
            raise ModelError(f"cube {name} has counts of distinct values, which a table of merged parts can't hold")
        stored = write(self._combined(groups), f"cube_{name}".replace(".", "_"))
        table = Rollup(f"cube:{name}", name, dict(groups[0].dimensions), {n: n for g in groups for n in g.components}, (), stored, {}, tuple(filters))
        self.cube_tables.append(table)
        return table

    # Windows -----------------------------------------------------------------------------------------------------

    def _window(self, df: DataFrame, metric: str, order: list[str], shown: list[Attribute], labels: dict[Attribute, str], filters: list[str]) -> DataFrame:
        """Adds a metric with OVER.

        Without PARTITION BY, ranking and offset functions, and aggregates with an
        order, are partitioned by all shown attributes but those of the dimension
        they are ordered by. LAG and LEAD over a coarser level than is shown are
        computed on rows of that level and joined back.
        """
        expression = self.registry.metrics[metric].expression
        column, steps = self._column(metric), [c for c in calls(expression) if c.over is not None]
        by = [Attribute.parse(e) for c in steps for e, _ in over(c.over).order if "." in e and e not in self.registry.metrics]
        by = [next(b for b in shown if (b.node, b.column) == (a.node, a.column)) for a in by]
        finer = [a for a in shown if a not in by and any((a.node, a.role) == (b.node, b.role) for b in by)]
        if finer and any(c.name in ("lag", "lead") for c in steps):
            coarse = [a for a in shown if a not in finer]
            parts = self.registry.metric_order([metric])
            again = {m: self._merged_again(m) for m in parts if self.registry.metrics[m].parent}
            if all(again.values()):  # from the rows at hand
                own = df.groupBy(*[F.col(f"`{labels[a]}`") for a in coarse]).agg(*[F.expr(x).alias(self._column(m)) for m, x in again.items()])
                own = self._derived_metrics(own, parts, coarse, labels, filters)
            else:
                own = self._values(parts, coarse, labels, filters)
            own = own.select(*[F.col(f"`{labels[a]}`").alias(f"k{k}") for k, a in enumerate(coarse)], column)
            on = [F.col(f"`{labels[a]}`").eqNullSafe(F.col(f"k{k}")) for k, a in enumerate(coarse)]
            return df.join(own, on, "left").drop(*[f"k{k}" for k in range(len(coarse))])

        def name(t: str) -> str | None:
            if t in self.registry.metrics:
                return self._column(t)
            if "." in t:
                a = Attribute.parse(t)
                return f"`{labels[next(b for b in shown if (b.node, b.column) == (a.node, a.column))]}`"
            return None

        spans = []
        for c in steps:
            o = over(c.over)
            partition = o.partition
            if not partition and (o.order or c.name in WINDOW_ONLY) and c.over.strip():
                partition = tuple(str(a) for a in shown if a not in by and a not in finer)
            call = replace_names(expression[c.start : c.end], name)
            spans.append((c.start, c.over_end, f"{call} OVER ({replace_names(Over(partition, o.order, o.frame).sql(), name)})"))
        inside = [(a, b) for a, b, _ in spans]
        rest = [(t.start, t.end, x) for t in names(expression) if not any(a <= t.start < b for a, b in inside) and (x := name(t.text)) is not None]
        return df.withColumn(column, F.expr(safe_division(to_spark(replace_spans(expression, spans + rest)))))

    def _merged_again(self, metric: str) -> str | None:
        """SQL that merges a metric's own values to a coarser grain; None if it takes more than its value."""
        own = self.registry.metrics[metric]
        d = decompose(to_spark(own.expression), own.parent)
        if d.aggregability is not Aggregability.FULL or len(d.components) != 1 or d.final not in (f"({(c := d.components[0]).merge})", f"(coalesce({c.merge}, 0))"):
            return None
        return d.final.replace(c.name, self._column(metric))

    def _looked_back(self, order: list[str], shown: list[Attribute], filters: list[str]) -> tuple[list[str], list[str]]:
        """Filters for the scan, and those to apply again above windows.

        A lower bound on the attribute that a window is ordered by is moved down by
        as many values as the window looks back. Bounds that aren't literals stay.
        """
        need: dict[Attribute, int] = {}
        for m in order:
            for c in (c for c in calls(self.registry.metrics[m].expression) if c.over is not None):
                o = over(c.over)
                back = o.preceding or (int(c.args[1]) if c.name == "lag" and len(c.args) > 1 and c.args[1].isdigit() else 1 if c.name == "lag" else 0)
                for e, _ in o.order[:1]:
                    if "." in e and e not in self.registry.metrics and back:
                        a = Attribute.parse(e)
                        a = next(b for b in shown if (b.node, b.column) == (a.node, a.column))
                        need[a] = max(need.get(a, 0), back)
        out, again = [], []
        for f in filters:
            low = self._lower(f)
            if low is None or low[0] not in need:
                out.append(f)
                continue
            a, bound, rest = low
            fact = next(self.registry.metrics[m].parent for m in order if self.registry.metrics[m].parent)
            scan = self._scan(fact, [a])
            value = F.col(f"`{scan.columns[a]}`")
            below = scan.frame.where(value < F.expr(bound)).select(value.alias("v")).distinct().orderBy(F.desc("v")).limit(need[a]).agg(F.min("v")).first()[0]
            start = bound if below is None else f"'{below}'" if not isinstance(below, int | float) else str(below)
            out.append(f"{a} >= {start}")
            out += [rest] if rest else []
            again.append(f)
        return out, again

    @staticmethod
    def _lower(text: str) -> tuple[Attribute, str, str | None] | None:
        """(attribute, literal lower bound, upper bound's filter) of a simple comparison."""
        literal = r"(?:(?:DATE|TIMESTAMP)\s*)?'[^']*'|-?\d+(?:\.\d+)?"
        name = r"[\w.]+(?:\[[\w>\- ]+\])?"
        if m := re.fullmatch(rf"\s*({name})\s*(>=|>|=)\s*({literal})\s*", text, re.I):
            return Attribute.parse(m[1]), m[3], f"{m[1]} <= {m[3]}" if m[2] == "=" else None
        if m := re.fullmatch(rf"\s*({name})\s+BETWEEN\s+({literal})\s+AND\s+({literal})\s*", text, re.I):
            return Attribute.parse(m[1]), m[2], f"{m[1]} <= {m[3]}"
        return None

    def _dense(self, df: DataFrame, order: list[str], shown: list[Attribute], labels: dict[Attribute, str], filters: list[str]) -> DataFrame:
        """A row for each value of the window's order attribute and each cohort; additive metrics are 0 where there was none."""
        by = [Attribute.parse(e) for m in order for o in self._overs(m) for e, _ in o.order[:1] if "." in e]
        by = list(dict.fromkeys(next(b for b in shown if (b.node, b.column) == (a.node, a.column)) for a in by))
        if len(by) != 1 or self.registry.node(by[0].node).kind != "dimension":
            raise ModelError("densifying needs windows ordered by one dimension's attribute")
        day = labels[by[0]]
        others = [labels[a] for a in shown if a is not by[0] and a != by[0]]
        spine = self.frame(by[0].node).select(F.col(by[0].column).alias(day)).where(F.col(f"`{day}`").isNotNull()).distinct()
        for f in filters:
            if set(self._attributes(f)) == {by[0]}:
                spine = spine.where(self._filter(f, {by[0]: day}))
        if others:
            spine = spine.crossJoin(df.select(*[F.col(f"`{c}`") for c in others]).distinct())
        spine = spine.toDF(*[f"k{k}" for k in range(len(spine.columns))])
        keys = [day, *others]
        on = [F.col(f"k{k}").eqNullSafe(F.col(f"`{c}`")) for k, c in enumerate(keys)]
        out = spine.join(df, on, "left").drop(*keys)
        out = out.select(*[F.col(f"k{k}").alias(c) for k, c in enumerate(keys)], *[c for c in df.columns if c not in keys])
        additive = [self._column(m) for m in order if (p := self.registry.metrics[m]).parent and re.match(r"\s*(sum|count|count_if)\s*\(", p.expression, re.I)]
        return out.fillna(0, [c for c in additive if c in out.columns])

    # Measures and rollups ----------------------------------------------------------------------------------------

    def measures(self, metrics: Iterable[str], dimensions: Iterable[str] = (), filters: Iterable[str] = (), stored: bool = False) -> list[GrainGroup]:
        """One grain group per fact: components at the finest grain that all of the fact's metrics need.

        Metrics that no parts can be merged to have a group of their own, at the
        fact's native grain: its key, the dimensions, and the columns they read.
        stored: from rollups where they hold the answer.
        """
        self.used = [] if stored else self.used
        shown = [Attribute.parse(d) for d in dict.fromkeys(dimensions)]
        labels = self._labels(shown)
        rows, having = self._classified(filters)
        if having:
            raise ModelError("measures take no filters on metrics")
        by_fact: dict[str, dict] = {}
        for m in self.registry.metric_order(metrics):
            own = self.registry.metrics[m]
            if own.parent:
                by_fact.setdefault(own.parent, {})[m] = decompose(to_spark(own.expression), own.parent)
        out = []
        for fact, parts in by_fact.items():
            asked = [*shown, *(a for f in rows for a in self._attributes(f))]
            if whole := [m for m, d in parts.items() if d.aggregability is Aggregability.NONE]:
                scan = self._scan(fact, asked, rows)
                read = [t.text for m in whole for t in names(parts[m].final) if t.text in scan.frame.columns]
                columns = [c for c in dict.fromkeys([*self.registry.node(fact).primary_key, *read]) if c not in labels.values()]
                own = scan.frame.select(*[F.col(f"`{scan.columns[a]}`").alias(labels[a]) for a in shown], *columns)
                out.append(GrainGroup(fact, {a: labels[a] for a in shown}, {}, own, self.registry.node(fact).primary_key, tuple(whole)))
                parts = {m: d for m, d in parts.items() if m not in whole}
                if not parts:
                    continue
            if stored and (found := self._stored(fact, [*parts], shown, rows)) is not None:
                rollup, scan = found
                self.used.append(rollup.name)
                df = scan.frame
                for f in self._left_over(rollup, rows):
                    df = df.where(self._filter(f, scan.columns))
                components = {c.name: c for d in parts.values() for c in d.components}
                levels = tuple(dict.fromkeys(x for d in parts.values() for x in d.level))
                keys = [F.col(f"`{scan.columns[a]}`").alias(labels[a]) for a in shown] + [F.col(self._level(x)) for x in levels]
                merged = [F.expr(replace_names(c.merge, {c.name: rollup.components[c.identity]}.get)).alias(c.name) for c in components.values()]
                df = df.groupBy(*keys).agg(*merged) if merged else df.select(*keys).distinct()
                out.append(GrainGroup(fact, {a: labels[a] for a in shown}, components, df, levels))
                continue
            scan = self._scan(fact, asked, rows)
            components = {c.name: c for d in parts.values() for c in d.components}
            levels = tuple(dict.fromkeys(x for d in parts.values() for x in d.level))
            keys = [F.col(f"`{scan.columns[a]}`").alias(labels[a]) for a in shown] + [F.expr(x).alias(self._level(x)) for x in levels]
            agg = [F.expr(c.accumulate).alias(c.name) for c in components.values()]
            df = scan.frame.groupBy(*keys).agg(*agg) if agg else scan.frame.select(*keys).distinct()
            out.append(GrainGroup(fact, {a: labels[a] for a in shown}, components, df, levels))
        return out

    @staticmethod
    def _level(expression: str) -> str:
        return expression if re.fullmatch(r"\w+", expression) else "level_" + re.sub(r"\W+", "_", expression).strip("_")

    def combined_measures(self, metrics: Iterable[str], dimensions: Iterable[str] = (), filters: Iterable[str] = (), stored: bool = False) -> DataFrame:
        """Components of all facts in one table, one row per dimensions; only freely mergeable ones can be combined.

        stored: from rollups where they hold the answer.
        """
        groups = self.measures(metrics, dimensions, filters, stored)
        if len(groups) > 1 and any(g.levels for g in groups):
            raise ModelError("counts of distinct values of several facts have no common grain")
        return self._combined(groups)

    @staticmethod
    def _combined(groups: list[GrainGroup]) -> DataFrame:
        df, keys = groups[0].frame, [*groups[0].dimensions.values()]
        for g in groups[1:]:
            df = df.unionByName(g.frame, allowMissingColumns=True)
        merges = {c.name: c for g in groups for c in g.components.values()}
        return df if len(groups) == 1 else df.groupBy(*keys).agg(*[F.expr(c.merge).alias(n) for n, c in merges.items()])

    def materialize(self, name: str, metrics: Iterable[str], dimensions: Iterable[str], write: Callable[[DataFrame, str], DataFrame], filters: Iterable[str] = (), covered: dict[str, tuple] | None = None) -> list[Rollup]:
        """Stores the grain groups of some metrics, and answers later requests from them.

        write(frame, name) stores a table and returns it. A rollup of filtered rows
        is only used where the request's filters imply its own, or where
        ``covered`` says which bounds it holds.
        """
        filters = [*filters]
        out, groups = [], self.measures(metrics, dimensions, filters)
        if wrong := [m for g in groups for m in g.whole]:
            raise ModelError(f"{wrong} can't be stored in parts")
        for g in groups:
            stored = write(g.frame, f"{name}_{g.parent}".replace(".", "_"))
            out.append(self.register_rollup(f"{name}_{g.parent}", g.parent, {str(a): c for a, c in g.dimensions.items()}, {c.identity: n for n, c in g.components.items()}, stored, g.levels, covered, filters))
        return out

    def register_rollup(self, name: str, parent: str, dimensions: dict[str, str], components: dict[str, str], frame: DataFrame, levels: tuple[str, ...] = (), covered: dict[str, tuple] | None = None, filters: Iterable[str] = ()) -> Rollup:
        own = Rollup(name, parent, {Attribute.parse(a): c for a, c in dimensions.items()}, components, levels, frame, {Attribute.parse(a): x for a, x in (covered or {}).items()}, tuple(filters))
        self.rollups.append(own)
        return own

    @staticmethod
    def _left_over(r: Rollup, filters: list[str]) -> list[str]:
        """Filters that a rollup's rows don't meet already."""
        met = {_same(f) for f in r.filters}
        return [f for f in filters if _same(f) not in met]

    def _stored(self, fact: str, metrics: list[str], shown: list[Attribute], filters: list[str]) -> tuple[Rollup, _Scan] | None:
        """The rollup with the fewest joins, then the fewest dimensions, that answers the request, and a scan of it."""
        parts = [decompose(to_spark(self.registry.metrics[m].expression), fact) for m in metrics]
        if any(d.aggregability is Aggregability.NONE for d in parts):
            return None
        best = None
        for r in self.rollups:
            limited = [d for d in parts if d.aggregability is Aggregability.LIMITED]
            if r.parent != fact or not all(c.identity in r.components for d in parts for c in d.components):
                continue
            if limited and (not {x for d in limited for x in d.level} <= set(r.levels)):
                continue
            if not all(self._within(f, a, r.covered[a]) for a in r.covered for f in [filters]) and (self.check_freshness or r.covered):
                continue
            if not all(implied(f, filters) or (r.covered and set(self._attributes(f)) <= set(r.covered)) for f in r.filters):
                continue
            asked = [*shown, *(a for f in self._left_over(r, filters) for a in self._attributes(f))]
            joins = self._joined_back(fact, r, [a for a in dict.fromkeys(asked) if a not in r.dimensions])
            if joins is None:
                continue
            if best is None or (len(joins), len(r.dimensions)) < best[0]:
                best = (len(joins), len(r.dimensions)), r, joins
        if best is None:
            return None
        _, r, joins = best
        df, columns = r.frame, dict(r.dimensions)
        for k, (link, attributes) in enumerate(joins.items()):
            keys = [Attribute(link.dimension, d, link.role) for _, d in link.pairs]
            dim = self.frame(link.dimension).select(*[F.col(x.column).alias(f"j{k}__{x.column}") for x in dict.fromkeys([*keys, *attributes])])
            on = [F.col(f"`{r.dimensions[x]}`") == F.col(f"j{k}__{x.column}") for x in keys]
            df = df.join(dim.hint(link.hint) if link.hint else dim, on, link.how)
            columns |= {x: f"j{k}__{x.column}" for x in attributes}
        return r, _Scan(df, columns, [])

    def _within(self, filters: list[str], a: Attribute, bounds: tuple) -> bool:
        """Whether the filters ask for no value of the attribute outside the bounds."""
        low, high = self.bounds(filters).get(a, (None, None))
        return low is not None and high is not None and str(low) >= str(bounds[0]) and str(high) <= str(bounds[1]) if isinstance(bounds[0], str) else low is not None and high is not None and float(low) >= bounds[0] and float(high) <= bounds[1]

    @staticmethod
    def bounds(filters: Iterable[str]) -> dict[Attribute, tuple]:
        """The tightest inclusive literal bounds per attribute, of simple comparisons. Strict bounds count as inclusive."""
        out: dict[Attribute, list] = {}
        value = r"(?:(?:DATE|TIMESTAMP)\s*)?(?:'([^']*)'|(-?\d+(?:\.\d+)?))"
        for f in filters:
            for part in re.split(r"\s+AND\s+(?!'|-?\d|DATE|TIMESTAMP)", f, flags=re.I):
                if m := re.fullmatch(rf"\s*([\w.]+(?:\[[\w>\-]+\])?)\s*(>=|<=|=|>|<)\s*{value}\s*", part, re.I):
                    v, a = m[3] if m[3] is not None else float(m[4]), Attribute.parse(m[1])
                    lows, highs = out.setdefault(a, [[], []])
                    if m[2] in (">=", ">", "="):
                        lows.append(v)
                    if m[2] in ("<=", "<", "="):
                        highs.append(v)
                elif m := re.fullmatch(rf"\s*([\w.]+(?:\[[\w>\-]+\])?)\s+BETWEEN\s+{value}\s+AND\s+{value}\s*", part, re.I):
                    lows, highs = out.setdefault(Attribute.parse(m[1]), [[], []])
                    lows.append(m[2] if m[2] is not None else float(m[3]))
                    highs.append(m[4] if m[4] is not None else float(m[5]))
        return {a: (max(x, default=None), min(y, default=None)) for a, (x, y) in out.items()}

    def _joined_back(self, fact: str, r: Rollup, missing: list[Attribute]) -> dict[Link, list[Attribute]] | None:
        """Links by which missing attributes can be joined to the rollup on a key it keeps; None if some can't."""
        out: dict[Link, list[Attribute]] = {}
        for a in missing:
            found = self.registry.path(fact, a.node, a.role)
            link = found[0][0] if found and len(found[0]) == 1 else None
            if link is None or not link.pairs or link.how not in ("left", "inner") or link.default is not None:
                return None
            if {d for _, d in link.pairs} != set(self.registry.node(a.node).primary_key) or not all(Attribute(a.node, d, link.role) in r.dimensions for _, d in link.pairs):
                return None
            out.setdefault(link, []).append(a)
        return out

    # Other entries -----------------------------------------------------------------------------------------------

    def cube(self, name: str, dimensions: Iterable[str] = (), filters: Iterable[str] = (), **options) -> DataFrame:
        """A stored request; the caller's dimensions and filters are added to its own."""
        own = self.registry._found(self.registry.cubes, name, "cube")
        options = {"orderby": own.orderby, "limit": own.limit} | options
        return self.query(own.metrics, [*dict.fromkeys([*own.dimensions, *dimensions])], [*own.filters, *filters], **options)

    def dimension_values(self, cube: str, dimensions: Iterable[str] = (), counts: bool = False, filters: Iterable[str] = ()) -> DataFrame:
        """Distinct values of a cube's dimensions in its first fact, with the number of rows if asked for."""
        own = self.registry._found(self.registry.cubes, cube, "cube")
        fact, shown = self.registry.parents(own.metrics[0])[0], [Attribute.parse(d) for d in (dimensions or own.dimensions)]
        rows = [*own.filters, *filters]
        scan, labels = self._scan(fact, [*shown, *(a for f in rows for a in self._attributes(f))], rows), self._labels(shown)
        keys = [F.col(f"`{scan.columns[a]}`").alias(labels[a]) for a in shown]
        return scan.frame.groupBy(*keys).agg(F.count("*").alias("count")) if counts else scan.frame.select(*keys).distinct()

    def node(self, name: str, dimensions: Iterable[str] = (), filters: Iterable[str] = (), orderby: Iterable[str] = (), limit: int | None = None) -> DataFrame:
        """A node's rows with attributes joined to them; no aggregation. Metrics and cubes go to their own entries."""
        if name in self.registry.metrics:
            return self.query([name], dimensions, filters, orderby, limit)
        if name in self.registry.cubes:
            return self.cube(name, dimensions, filters, orderby=orderby, limit=limit)
        shown = [Attribute.parse(d) for d in dict.fromkeys(dimensions)]
        rows, _ = self._classified(filters)
        scan, labels = self._scan(name, [*shown, *(a for f in rows for a in self._attributes(f))], rows), self._labels(shown)
        own = [c for c in self.frame(name).columns if c not in labels.values()]
        df = scan.frame.select(*[F.col(f"`{c}`") for c in own], *[F.col(f"`{scan.columns[a]}`").alias(labels[a]) for a in shown])
        keys = self._ordering(orderby, [], labels)
        df = df.orderBy(*keys) if keys else df
        return df.limit(limit) if limit is not None else df

    def sql(self, text: str, parameters: dict | None = None) -> DataFrame:
        """SELECT metrics and dimensions FROM metrics [WHERE ...] [GROUP BY ...] [ORDER BY ...] [LIMIT n]."""
        clause = {}
        at = [(m.start(), m.end(), re.sub(r"\s+", " ", m[0].upper())) for m in re.finditer(r"\b(?:SELECT|FROM|WHERE|GROUP\s+BY|HAVING|ORDER\s+BY|LIMIT|UNION|INTERSECT|EXCEPT|LATERAL|JOIN)\b", text, re.I)]
        for (_, start, word), (end, _, _) in zip(at, [*at[1:], (len(text), 0, "")], strict=True):
            if word in clause or word in ("HAVING", "UNION", "INTERSECT", "EXCEPT", "LATERAL", "JOIN"):
                raise ModelError(f"{word} isn't part of SQL over metrics")
            clause[word] = text[start:end].strip().rstrip(";")
        if clause.get("FROM", "").lower() != "metrics" or "SELECT" not in clause:
            raise ModelError("SQL over metrics reads SELECT ... FROM metrics")
        chosen, groups = split(clause["SELECT"]), split(clause.get("GROUP BY", ""))
        if wrong := [x for x in chosen if x not in self.registry.metrics and x not in groups]:
            raise ModelError(f"neither a metric nor in GROUP BY: {wrong}")
        out = self.query([x for x in chosen if x in self.registry.metrics], groups, [clause["WHERE"]] if "WHERE" in clause else [], split(clause.get("ORDER BY", "")), int(clause["LIMIT"]) if "LIMIT" in clause else None, parameters)
        labels = self._labels([Attribute.parse(g) for g in groups])
        return out.select(*[F.col("`" + (x.rpartition(".")[2] if x in self.registry.metrics else labels[Attribute.parse(x)]) + "`") for x in chosen])

    def lineage(self, node: str) -> dict[str, list[str]]:
        """For each column of an SQL node: the columns it is computed from, as node.column, by the analysed plan's expressions."""
        plan = self.frame(node)._jdf.queryExecution().analyzed()
        from_ids: dict[int, set[int]] = {}
        for x in json.loads(plan.toJSON()):
            for expressions in _trees(x):
                for k, e in enumerate(expressions):
                    if e["class"].endswith(".Alias"):
                        own = expressions[k + 1 : _end(expressions, k)]
                        from_ids.setdefault(e["exprId"]["id"], set()).update(y["exprId"]["id"] for y in own if y["class"].endswith(".AttributeReference"))
        for union in self._unions(plan):
            for made, others in union:
                from_ids.setdefault(made, set()).update(others)

        def roots(k: int, seen: frozenset = frozenset()) -> set[int]:
            own = from_ids.get(k, set())
            found = set().union(*(roots(x, seen | {k}) for x in own - seen - {k}))
            return found | {k} if k in own or not own else found  # a union's column has the id of its first branch's

        sources = {a.exprId().id(): f"{n}.{a.name()}" for n in self.registry.upstream(node) if self.registry.node(n).query is None for a in self._outputs(n)}
        return {a.name(): sorted({sources.get(x, "?") for x in roots(a.exprId().id())} - {"?"}) for a in self._outputs(node)}

    @staticmethod
    def _unions(plan) -> list[list[tuple[int, set[int]]]]:
        """Of each union: the id of each column of its result, and the ids of what its branches put there."""
        out, todo = [], [plan]
        while todo:
            p = todo.pop()
            below = [p.children().apply(k) for k in range(p.children().size())]
            todo += below
            if p.getClass().getSimpleName() in ("Union", "Intersect", "Except"):
                each = [[b.output().apply(k).exprId().id() for k in range(b.output().size())] for b in below]
                own = [p.output().apply(k).exprId().id() for k in range(p.output().size())]
                out.append([(o, {ids[k] for ids in each}) for k, o in enumerate(own)])
        return out

    def _outputs(self, node: str) -> list:
        seq = self.frame(node)._jdf.queryExecution().analyzed().output()
        return [seq.apply(k) for k in range(seq.size())]
