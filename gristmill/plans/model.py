"""The semantic model: nodes, links between them, metrics, cubes, hierarchies."""

from __future__ import annotations

import difflib
import graphlib
from collections import Counter, deque
from collections.abc import Iterable
from dataclasses import dataclass, field

from gristmill.plans.expressions import calls, names, tokens

HINTS = ("broadcast", "merge", "shuffle_hash", "shuffle_replicate_nl")
JOINS = ("left", "right", "inner", "full", "cross")
CARDINALITIES = ("one_to_one", "one_to_many", "many_to_one", "many_to_many")


class ModelError(ValueError):
    """The model or a request about it makes no sense; the text says what and, where it can, what was meant."""


@dataclass(frozen=True)
class Node:
    """A table: ``table`` names one that the session or the engine's reader knows, ``query`` is SQL over other nodes."""

    name: str
    table: str | None = None
    query: str | None = None
    primary_key: tuple[str, ...] = ()
    kind: str = "transform"  # source, transform or dimension
    derived: tuple[tuple[str, str], ...] = ()  # (column, SQL over the primary key) of columns that the key tells
    columns: tuple[tuple[str, str], ...] = ()  # (column, type) of a source, where they were read off the table


@dataclass(frozen=True)
class Link:
    """A join edge. ``on`` names columns as node.column; ``default`` stands in for a dimension's values on a miss.

    ``total``: declares that the dimension has every key of the node, so that
    columns derived from the key need no join.
    """

    node: str
    dimension: str
    on: str = ""
    role: str = ""
    how: str = "left"
    cardinality: str = "many_to_one"
    hint: str | None = None
    default: str | None = None
    total: bool = False

    @property
    def pairs(self) -> tuple[tuple[str, str], ...] | None:
        """(node's column, dimension's column) of a plain equality join; None for any other."""
        out = []
        for part in self.on.split(" AND "):
            a, eq, b = part.partition("=")
            a, b = a.strip(), b.strip()
            if not eq or any(x.count(".") != 1 for x in (a, b)) or any(c in a + b for c in "<>()! "):
                return None
            sides = {x.split(".")[0]: x.split(".")[1] for x in (a, b)}
            if set(sides) != {self.node, self.dimension}:
                return None
            out.append((sides[self.node], sides[self.dimension]))
        return tuple(out)


@dataclass(frozen=True)
class Reference:
    """A column that is a dimension's attribute already, without a join."""

    node: str
    column: str
    dimension: str
    attribute: str
    role: str = ""


@dataclass(frozen=True)
class Metric:
    """With ``parent``: an aggregate over its rows. Without: an expression over other metrics."""

    name: str
    expression: str
    parent: str | None = None
    required: tuple[str, ...] = ()
    direction: str | None = None
    unit: str | None = None


@dataclass(frozen=True)
class Cube:
    name: str
    metrics: tuple[str, ...]
    dimensions: tuple[str, ...]
    filters: tuple[str, ...] = ()
    orderby: tuple[str, ...] = ()
    limit: int | None = None


@dataclass(frozen=True)
class Hierarchy:
    """Dimensions from coarse to fine."""

    name: str
    levels: tuple[str, ...]


@dataclass(frozen=True)
class Attribute:
    """A dimension's column: node.column or node.column[role] or node.column[a->b]."""

    node: str
    column: str
    role: str = ""

    @classmethod
    def parse(cls, text: str) -> Attribute:
        name, _, role = text.strip().partition("[")
        node, dot, column = name.rpartition(".")
        if not dot:
            raise ModelError(f"{text!r} must be qualified, as node.column")
        return cls(node, column, role.rstrip("]").replace(" ", ""))

    def __str__(self) -> str:
        return f"{self.node}.{self.column}" + (f"[{self.role}]" if self.role else "")


@dataclass
class Registry:
    nodes: dict[str, Node] = field(default_factory=dict)
    links: list[Link] = field(default_factory=list)
    references: list[Reference] = field(default_factory=list)
    metrics: dict[str, Metric] = field(default_factory=dict)
    cubes: dict[str, Cube] = field(default_factory=dict)
    hierarchies: dict[str, Hierarchy] = field(default_factory=dict)

    def source(self, name: str, table: str | None = None, primary_key: Iterable[str] = (), columns: Iterable[tuple[str, str]] = ()) -> Node:
        return self._put(Node(name, table or name, None, tuple(primary_key), "source", columns=tuple(columns)))

    def transform(self, name: str, query: str, primary_key: Iterable[str] = ()) -> Node:
        return self._put(Node(name, None, query, tuple(primary_key), "transform"))

    def dimension(self, name: str, query: str | None = None, primary_key: Iterable[str] = (), table: str | None = None, derived: dict[str, str] | None = None) -> Node:
        if not (key := tuple(primary_key)):
            raise ModelError(f"dimension {name} needs a primary key")
        for column, text in (derived or {}).items():
            if wrong := {t.text for t in names(text)} - set(key):
                raise ModelError(f"{name}.{column} is derived from {sorted(wrong)}, not from the key alone")
        return self._put(Node(name, table, query, key, "dimension", tuple((derived or {}).items())))

    def _put(self, node: Node) -> Node:
        self.nodes[node.name] = node
        return node

    def link(self, node: str, dimension: str, on: str = "", **options) -> Link:
        own = Link(self.node(node).name, self.node(dimension).name, on, **options)
        if own.how not in JOINS or own.cardinality not in CARDINALITIES or own.hint not in (None, *HINTS):
            raise ModelError(f"unknown join, cardinality or hint in the link {node} -> {dimension}")
        if bool(on) == (own.how == "cross"):
            raise ModelError("a cross join has no condition; all others have one")
        self.links.append(own)
        return own

    def reference(self, node: str, column: str, attribute: str) -> None:
        a = Attribute.parse(attribute)
        self.references.append(Reference(self.node(node).name, column, a.node, a.column, a.role))

    def metric(self, name: str, expression: str, parent: str | None = None, **options) -> Metric:
        found = [c for c in calls(expression) if c.aggregate]
        if parent is not None:
            self.node(parent)
            if not found or any(c.over is not None for c in found):
                raise ModelError(f"metric {name} needs an aggregate without OVER")
        elif any(c.over is None for c in found):
            raise ModelError(f"metric {name} aggregates, so it needs a parent")
        if any(t.text.upper() in ("SELECT", "WHERE", "HAVING", "UNION", "LATERAL") for t in names(expression)):
            raise ModelError(f"metric {name} must be one expression")
        self.metrics[name] = m = Metric(name, expression, parent, **options)
        self.metric_order([name])  # raises for cycles
        return m

    def cube(self, name: str, metrics: Iterable[str], dimensions: Iterable[str], **options) -> Cube:
        own = Cube(name, tuple(metrics), tuple(dimensions), **{k: tuple(v) if isinstance(v, list) else v for k, v in options.items()})
        shared = self.common_dimensions(own.metrics)
        if missing := [d for d in own.dimensions if (a := Attribute.parse(d)).node not in {x.node for x in shared}]:
            raise ModelError(f"not shared by all metrics of cube {name}: {missing}")
        self.cubes[name] = own
        return own

    def hierarchy(self, name: str, levels: Iterable[str]) -> Hierarchy:
        """Each finer level must link many-to-one to the coarser one above it."""
        own = Hierarchy(name, tuple(levels))
        if len(own.levels) < 2 or len(set(own.levels)) < len(own.levels):
            raise ModelError(f"hierarchy {name} needs two different levels at least")
        for coarse, fine in zip(own.levels, own.levels[1:], strict=False):
            edges = [x for x in self.links if x.node == fine and x.dimension == coarse]
            if not any(x.cardinality in ("many_to_one", "one_to_one") for x in edges):
                raise ModelError(f"{fine} doesn't link many-to-one to {coarse}")
        self.hierarchies[name] = own
        return own

    def drill(self, dimension: str, down: bool = True) -> list[str]:
        """The next finer (or coarser) level in each hierarchy that has the dimension."""
        out = []
        for h in self.hierarchies.values():
            if dimension in h.levels:
                k = h.levels.index(dimension) + (1 if down else -1)
                out += [h.levels[k]] if 0 <= k < len(h.levels) else []
        return out

    def node(self, name: str) -> Node:
        return self._found(self.nodes, name, "node")

    def metric_of(self, name: str) -> Metric:
        return self._found(self.metrics, name, "metric")

    @staticmethod
    def _found(known: dict, name: str, what: str):
        if name not in known:
            near = difflib.get_close_matches(name, known, 3)
            raise ModelError(f"no {what} {name!r}" + (f"; is it {' or '.join(near)}?" if near else ""))
        return known[name]

    # Graphs ------------------------------------------------------------------------------------------------------

    def metric_parts(self, name: str) -> list[str]:
        """Metrics that a derived metric's expression names."""
        m = self.metric_of(name)
        return [] if m.parent is not None else [t for t in dict.fromkeys(x.text for x in names(m.expression)) if t in self.metrics]

    def metric_order(self, wanted: Iterable[str]) -> list[str]:
        """The wanted metrics and all they are made of, parts first."""
        graph, todo = {}, [*wanted]
        while todo:
            if (m := todo.pop()) not in graph:
                graph[m] = self.metric_parts(m)
                todo += graph[m]
        try:
            return [*graphlib.TopologicalSorter(graph).static_order()]
        except graphlib.CycleError as e:
            raise ModelError(f"metrics are made of each other: {' -> '.join(e.args[1])}") from None

    def upstream(self, name: str) -> list[str]:
        """Nodes that a node's SQL, or a metric, reads; nearest first."""
        return self._walk(name, lambda x: [*self._reads(x), *self.metric_parts(x)] if x in self.metrics else self._reads(x))

    def downstream(self, name: str) -> list[str]:
        """Nodes and metrics that read a node."""
        return self._walk(name, lambda x: [y for y in [*self.nodes, *self.metrics] if x in self._reads(y) or (y in self.metrics and x in self.metric_parts(y))])

    def _reads(self, name: str) -> list[str]:
        if name in self.metrics:
            return [p] if (p := self.metrics[name].parent) else []
        q = self.nodes[name].query
        return [t for t in dict.fromkeys(x.text for x in names(q)) if t in self.nodes and t != name] if q else []

    @staticmethod
    def _walk(start: str, next_of) -> list[str]:
        seen, todo = [], deque([start])
        while todo:
            for y in next_of(todo.popleft()):
                if y not in seen and y != start:
                    seen.append(y)
                    todo.append(y)
        return seen

    def node_order(self, wanted: Iterable[str]) -> list[str]:
        try:
            return [*graphlib.TopologicalSorter({x: self._reads(x) for w in wanted for x in [w, *self.upstream(w)]}).static_order()]
        except graphlib.CycleError as e:
            raise ModelError(f"nodes read each other: {' -> '.join(e.args[1])}") from None

    def paths(self, start: str, most: int = 30) -> dict[tuple[str, str], tuple[Link, ...]]:
        """(dimension, role path) -> links, by breadth: the first, and so shortest, path of a key wins."""
        out: dict[tuple[str, str], tuple[Link, ...]] = {}
        todo: deque[tuple[str, tuple[Link, ...]]] = deque([(start, ())])
        while todo:
            at, chain = todo.popleft()
            on_path = {start, *(x.dimension for x in chain)}
            for x in self.links:
                if x.node != at or len(chain) >= most or (x.dimension in on_path and not (x.dimension == start and x.role)):
                    continue
                own = (*chain, x)
                key = (x.dimension, "->".join(y.role for y in own if y.role))
                if key not in out:
                    out[key] = own
                    todo.append((x.dimension, own))
        return out

    def path(self, start: str, dimension: str, role: str = "") -> tuple[tuple[Link, ...], bool] | None:
        """The links to a dimension, and whether the role was met; by exact role, else hops, then no role, then role."""
        found = {r: p for (d, r), p in self.paths(start).items() if d == dimension}
        if role in found:
            return found[role], True
        if not found:
            return None
        best = min(found, key=lambda r: (len(found[r]), bool(r), r))
        return found[best], not role

    def dimensions_of(self, node: str) -> list[Attribute]:
        """Dimension nodes that a node reaches, as attributes of their keys, with role."""
        own = [Attribute(node, k) for k in self.node(node).primary_key] if self.node(node).kind == "dimension" else []
        own += [Attribute(r.dimension, r.attribute, r.role) for r in self.references if r.node == node]
        return [*dict.fromkeys([*own, *(Attribute(d, k, r) for d, r in self.paths(node) for k in self.node(d).primary_key)])]

    def parents(self, metric: str) -> list[str]:
        return [*dict.fromkeys(p for m in self.metric_order([metric]) if (p := self.metrics[m].parent))]

    def common_dimensions(self, metrics: Iterable[str]) -> list[Attribute]:
        """Attributes that every metric's every fact reaches."""
        each = [self.dimensions_of(p) for m in metrics for p in self.parents(m)]
        nodes = set.intersection(*({a.node for a in x} for x in each)) if each else set()
        return [a for a in (each[0] if each else []) if a.node in nodes]

    def metrics_with(self, dimensions: Iterable[str]) -> list[str]:
        """Metrics that reach all the dimensions."""
        wanted = {Attribute.parse(d).node for d in dimensions}
        return [m for m in self.metrics if wanted <= {a.node for p in self.parents(m)[:1] for a in self.dimensions_of(p)} and all(wanted <= {a.node for a in self.dimensions_of(p)} for p in self.parents(m))]

    def impact(self, name: str, gone: Iterable[str] = ()) -> dict[str, str]:
        """What a change of a node, or the loss of some of its columns, does to what is made of it: "broken" or "touched".

        Links, metrics and nodes are broken if their own text names a lost column
        of the node; what is made of something broken is broken as well.
        """
        gone, out = {*gone}, {}
        for x in self.downstream(name):
            text = self.metrics[x].expression if x in self.metrics else self.nodes[x].query or ""
            above = [*self._reads(x), *(self.metric_parts(x) if x in self.metrics else [])]
            own = name in above and any(t.text.rpartition(".")[2] in gone for t in names(text))
            out[x] = "broken" if own or any(out.get(p) == "broken" for p in above) else "touched"
        for k in self.links:
            if name in (k.node, k.dimension):
                out[f"{k.node} -> {k.dimension}"] = "broken" if any(t.text == f"{name}.{c}" for t in names(k.on) for c in gone) else "touched"
        return out

    def similarity(self, a: str, b: str) -> float:
        """How alike the texts of two nodes or metrics are: shared words over all words, each counted as often as it is there."""
        own = [Counter(t.text.lower() for t in tokens((self.metrics[x].expression if x in self.metrics else self.node(x).query) or x)) for x in (a, b)]
        return sum((own[0] & own[1]).values()) / max(1, sum((own[0] | own[1]).values()))

    def in_degree(self) -> dict[str, int]:
        """How many links reach each dimension."""
        return {n: sum(x.dimension == n for x in self.links) for n, own in self.nodes.items() if own.kind == "dimension"}

    # Deployment --------------------------------------------------------------------------------------------------

    @classmethod
    def from_dict(cls, spec: dict) -> Registry:
        """A whole model: lists of sources, transforms, dimensions, links, references, metrics, hierarchies, cubes."""
        r = cls()
        makers = (("sources", r.source), ("transforms", r.transform), ("dimensions", r.dimension), ("links", r.link), ("references", r.reference), ("hierarchies", r.hierarchy), ("cubes", r.cube))
        if unknown := set(spec) - {k for k, _ in makers} - {"metrics"}:
            raise ModelError(f"unknown parts of a model: {sorted(unknown)}")
        for kind, make in makers[:-2]:
            for x in spec.get(kind, []):
                make(**{"on" if k is True else k: v for k, v in x.items()})  # YAML reads a bare `on` as true
        waiting = [dict(x) for x in spec.get("metrics", [])]
        for x in sorted(waiting, key=lambda x: x.get("parent") is None):
            r.metric(**{k: tuple(v) if isinstance(v, list) else v for k, v in x.items()})
        for kind, make in makers[-2:]:
            for x in spec.get(kind, []):
                make(**x)
        return r

    @classmethod
    def from_yaml(cls, text: str) -> Registry:
        import yaml

        return cls.from_dict(yaml.safe_load(text))
