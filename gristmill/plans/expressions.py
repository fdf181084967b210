"""A small front end for SQL expressions: calls, references and clauses by position.

Expressions stay SQL text and are evaluated by Spark; all that the planner needs
is where the calls, their arguments and the dotted names in a text are.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

_TOKEN = re.compile(
    r"(?P<string>'(?:[^'\\]|\\.|'')*')|(?P<name>(?:[A-Za-z_]\w*|`[^`]+`)(?:\.(?:[A-Za-z_]\w*|`[^`]+`))*)(?P<role>\[[A-Za-z_][\w>\- ]*\])?"
    r"|(?P<number>\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|(?P<space>\s+)|(?P<other><=>|<=|>=|<>|!=|\|\||->|.)",
    re.S,
)
# Functions that aggregate.
AGGREGATES = set(
    "any_value approx_count_distinct approx_percentile array_agg avg collect_list collect_set corr count count_if count_min_sketch covar_pop covar_samp every first "
    "histogram_numeric hll_sketch_agg hll_union_agg kurtosis last max max_by mean median min min_by mode percentile percentile_approx stddev stddev_pop stddev_samp sum "
    "variance var_pop var_samp bool_and bool_or some skewness approx_count_distinct_ds_hll approx_count_distinct_ds_theta".split()
)
# Functions that make sense only over a window.
WINDOW_ONLY = frozenset("lag lead first_value last_value nth_value row_number rank dense_rank ntile percent_rank cume_dist".split())


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    start: int
    end: int


def tokens(sql: str) -> list[Token]:
    out = []
    for m in _TOKEN.finditer(sql):
        kind = next(k for k in ("string", "name", "number", "space", "other") if m[k])
        if kind != "space":
            out.append(Token(kind, m[0], m.start(), m.end()))
    return out


@dataclass(frozen=True)
class Call:
    name: str
    start: int
    end: int  # behind the closing parenthesis
    args: tuple[str, ...]
    distinct: bool
    over: str | None  # text between the parentheses of OVER
    over_end: int

    @property
    def aggregate(self) -> bool:
        return self.name in AGGREGATES


def _closing(ts: list[Token], k: int) -> int:
    depth = 0
    for j in range(k, len(ts)):
        depth += (ts[j].text in "([") - (ts[j].text in ")]") if ts[j].kind == "other" else 0
        if not depth:
            return j
    raise ValueError("a parenthesis is not closed")


def calls(sql: str) -> list[Call]:
    """All function calls, the outer one before those inside it."""
    ts, out = tokens(sql), []
    for k in range(len(ts) - 1):
        if ts[k].kind != "name" or ts[k + 1].text != "(" or ts[k].text.upper() in ("IN", "AND", "OR", "NOT", "OVER", "BETWEEN", "THEN", "WHEN", "ELSE", "BY", "AS"):
            continue
        end = _closing(ts, k + 1)
        inner = ts[k + 2 : end]
        distinct = bool(inner) and inner[0].text.upper() == "DISTINCT"
        inner = inner[1:] if distinct else inner
        args, depth, start = [], 0, inner[0].start if inner else 0
        for t in inner:
            if t.kind == "other":
                depth += (t.text in "([") - (t.text in ")]")
                if t.text == "," and not depth:
                    args.append(sql[start : t.start].strip())
                    start = t.end
        if inner:
            args.append(sql[start : inner[-1].end].strip())
        over, over_end = None, ts[end].end
        if end + 2 < len(ts) and ts[end + 1].text.upper() == "OVER" and ts[end + 2].text == "(":
            last = _closing(ts, end + 2)
            over, over_end = sql[ts[end + 2].end : ts[last].start].strip(), ts[last].end
        out.append(Call(ts[k].text.lower(), ts[k].start, ts[end].end, tuple(args), distinct, over, over_end))
    return out


def names(sql: str) -> list[Token]:
    """Names that are not function calls and not keywords, with their role if any."""
    ts = tokens(sql)
    return [t for k, t in enumerate(ts) if t.kind == "name" and not (k + 1 < len(ts) and ts[k + 1].text == "(")]


def replace_names(sql: str, new: Callable[[str], str | None]) -> str:
    """The text with each name for which ``new`` gives a text replaced by it."""
    out, at = [], 0
    for t in names(sql):
        if (x := new(t.text)) is not None:
            out += [sql[at : t.start], x]
            at = t.end
    return "".join([*out, sql[at:]])


def replace_spans(sql: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for start, end, text in sorted(spans):
        out += [sql[at:start], text]
        at = end
    return "".join([*out, sql[at:]])


def safe_division(sql: str) -> str:
    """Each divisor that is no number and no NULLIF becomes NULLIF(divisor, 0)."""
    ts = tokens(sql)
    for k, t in enumerate(ts):
        if t.text != "/" or k + 1 == len(ts):
            continue
        a = b = k + 1
        if ts[a].kind == "number" or ts[a].text.lower() == "nullif":
            continue
        while ts[b].text in ("-", "+"):
            b += 1
        if ts[b].text == "(":
            b = _closing(ts, b)
        elif b + 1 < len(ts) and ts[b].kind == "name" and ts[b + 1].text == "(":
            b = _closing(ts, b + 1)
            if b + 2 < len(ts) and ts[b + 1].text.upper() == "OVER":
                b = _closing(ts, b + 2)
        start, end = ts[a].start, ts[b].end
        return sql[:start] + f"NULLIF({safe_division(sql[start:end])}, 0)" + safe_division_tail(sql[end:])
    return sql


def safe_division_tail(sql: str) -> str:
    """What follows a divisor: it may divide again."""
    return safe_division("1" + sql)[1:] if sql.lstrip().startswith("/") else safe_division(sql)


@dataclass(frozen=True)
class Over:
    partition: tuple[str, ...]
    order: tuple[tuple[str, str], ...]  # (expression, "ASC ..." or "DESC ...")
    frame: str | None

    @property
    def preceding(self) -> int | None:
        """Positions that a ROWS frame looks back; None for a frame without such a number."""
        m = re.search(r"ROWS\s+(?:BETWEEN\s+)?(\d+)\s+PRECEDING", self.frame or "", re.I)
        return int(m[1]) if m else None

    def sql(self) -> str:
        out = []
        if self.partition:
            out.append("PARTITION BY " + ", ".join(self.partition))
        if self.order:
            out.append("ORDER BY " + ", ".join(f"{e} {d}".strip() for e, d in self.order))
        return " ".join([*out, self.frame or ""]).strip()


def over(text: str) -> Over:
    m = re.fullmatch(r"\s*(?:PARTITION\s+BY\s+(?P<p>.*?))?\s*(?:ORDER\s+BY\s+(?P<o>.*?))?\s*(?P<f>(?:ROWS|RANGE)\s.*)?", text, re.I | re.S)
    if not m:
        raise ValueError(f"cannot read OVER ({text})")
    order = []
    for x in split(m["o"] or ""):
        d = re.search(r"\s+((?:ASC|DESC)?(?:\s*NULLS\s+(?:FIRST|LAST))?)\s*$", x, re.I)
        order.append((x[: d.start()].strip(), d[1].strip()) if d and d[1] else (x, ""))
    return Over(tuple(split(m["p"] or "")), tuple(order), m["f"])


def split(sql: str) -> list[str]:
    """Parts of a list between commas outside parentheses."""
    out, depth, start = [], 0, 0
    for t in tokens(sql):
        if t.kind == "other":
            depth += (t.text in "([") - (t.text in ")]")
            if t.text == "," and not depth:
                out.append(sql[start : t.start].strip())
                start = t.end
    return [*out, sql[start:].strip()] if sql.strip() else []
