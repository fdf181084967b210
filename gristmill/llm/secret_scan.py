r"""Secrets in texts, found with a trigram inverted index. DataFrame functions only.

From each rule's regular expression a Boolean query over trigrams is derived:
literals that every match must contain are cut into trigrams, joined by AND;
alternatives are joined by OR. The index has a posting (trigram, document) for
each trigram of those queries; postings are intersected by document, and only
the candidates of a rule are searched with its expression. A rule without a
mandatory trigram, such as a run of hex digits, has no query and is searched in
every text.

Index and literals are lower-cased, so candidates are a superset whatever the
case a rule asks for. A document is addressed by id and hash of its text, so
repeated ids and null ids do no harm.

A text is lower-cased once and looked through for each trigram of the queries
by one lambda over them, so its lower form is never made again.

Spans are in code points, end exclusive. Positions come from ``split`` and
``regexp_extract_all``: the pieces between matches and the matches alternate.
Folds over matches go in steps, and texts are cut from blocks, so a text with very
many matches takes time in proportion.

Defined results: a null text is empty and has no spans; a null id is kept;
repeated rows have the same spans each; an empty table has no rows. All columns
of the input are kept; one named ``spans`` is replaced.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parse
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import cut, fold, in_blocks, is_small, materialize, none_of, text_or_empty


@dataclass(frozen=True)
class Rule:
    """kind; expression in the syntax that Java and Python share; the group that is measured, and its least length."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# The three base rules, then public formats of well-known credentials.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    # A run of 24 or more is the whole run, so this equals [0-9a-f]+ with matches below 24 dropped.
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
RULES = (
    *BASE,
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("maps_key", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("payment", r"[rs]k_live_[0-9A-Za-z]{16,}"),
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"),
)

#: Strings that a part of an expression may stand for before it is cut into trigrams.
MOST_STRINGS = 16
#: Candidates up to this number (about 40 bytes each) are broadcast to the texts; beyond it they are joined by shuffle.
MOST_BROADCAST = 500_000

#: A query: a trigram, ("and" | "or", queries), or None for one that all texts meet.
Query = str | tuple | None


def _all(queries: list[Query]) -> Query:
    own = [*dict.fromkeys(q for q in queries if q is not None)]
    return own[0] if len(own) == 1 else ("and", tuple(own)) if own else None


def _any(queries: list[Query]) -> Query:
    if not queries or None in queries:
        return None
    own = [*dict.fromkeys(queries)]
    return own[0] if len(own) == 1 else ("or", tuple(own))


def _cut(strings: set[str]) -> Query:
    return _any([_all([s[k : k + 3] for k in range(len(s) - 2)]) for s in sorted(strings)])


def _analyse(tree) -> tuple[set[str] | None, Query]:
    """The strings a sequence can be, if few, else None; and the query each match of it meets."""
    queries: list[Query] = []
    known: set[str] = {""}  # what the text just before here can be
    exact = True
    for op, arg in tree:
        strings, query = None, None
        if op is sre.LITERAL:
            strings = {chr(arg).lower()}
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg) and len(arg) <= MOST_STRINGS:
            strings = {chr(c).lower() for _, c in arg}
        elif op is sre.SUBPATTERN:
            strings, query = _analyse(arg[-1])
        elif op is sre.BRANCH:
            parts = [_analyse(p) for p in arg[1]]
            strings = set().union(*(s for s, _ in parts)) if all(s is not None for s, _ in parts) else None
            query = _any([_all([_cut(s) if s is not None else None, q]) for s, q in parts])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, part = arg
            inner, q = _analyse(part)
            if (low, high) == (0, 1) and inner is not None:
                strings = {"", *inner}
            elif low:
                query = _all([_cut(inner) if inner is not None else None, q])
        elif op is sre.AT:
            strings = {""}
        if strings is not None and len(strings) > MOST_STRINGS:
            strings, query = None, _all([query, _cut(strings)])
        queries.append(query)
        if strings is not None and len(known) * len(strings) <= MOST_STRINGS:
            known = {a + b for a in known for b in strings}
            continue
        queries.append(_cut(known))
        exact, known = False, strings if strings is not None else {""}
    return (known, _all(queries)) if exact else (None, _all([*queries, _cut(known)]))


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query that each text with a match of the expression meets; None if there is none."""
    strings, query = _analyse(sre_parse.parse(pattern))
    return _all([query, _cut(strings)]) if strings is not None else query


def _grams(q: Query) -> set[str]:
    return {q} if isinstance(q, str) else set().union(*map(_grams, q[1])) if q else set()


def _holds(q: Query, own: Column) -> Column:
    if isinstance(q, str):
        return F.array_contains(own, q)
    return reduce((lambda a, b: a & b) if q[0] == "and" else (lambda a, b: a | b), [_holds(x, own) for x in q[1]])


def postings(docs: DataFrame, grams: list[str], id_col: str, text_col: str) -> DataFrame:
    """The inverted index: (gram, id, h), h being the hash of the text."""
    text = text_or_empty(f"`{text_col}`")
    listed = F.array(*map(F.lit, grams))
    own = F.transform(F.array(F.lower(text)), lambda low: F.filter(listed, lambda g: F.contains(low, g)))[0]
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("h"), F.explode(own).alias("gram")).select("gram", "id", "h")


def candidates(docs: DataFrame, rules: tuple[Rule, ...], id_col: str, text_col: str) -> DataFrame:
    """(id, h, kinds) of documents that meet the query of some rule."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not None}
    own = postings(docs, sorted(set().union(*map(_grams, queries.values()))), id_col, text_col).groupBy("id", "h").agg(F.collect_set("gram").alias("own"))
    kinds = F.array_compact(F.array(*[F.when(_holds(q, F.col("own")), F.lit(k)) for k, q in queries.items()]))
    return own.select("id", "h", kinds.alias("kinds")).where("size(kinds) > 0")


_SPAN = "struct<start:int,rank:int,end:int,kind:string>"


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """All matches of the rule that are long enough, as array of (start, rank, end, kind)."""
    pattern = F.lit(rule.pattern)
    matches, between = F.regexp_extract_all(text, pattern, 0), F.split(text, rule.pattern, -1)
    measured = F.regexp_extract_all(text, pattern, rule.group) if rule.group else matches
    lengths = lambda a: F.transform(a, lambda x: F.length(x))
    each = F.arrays_zip(lengths(matches).alias("m"), lengths(between).alias("b"), lengths(measured).alias("g"))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + x["b"]
        end = start + F.coalesce(x["m"], F.lit(0))
        good = F.coalesce(x["g"] >= rule.least, F.lit(False)) & x["m"].isNotNull()
        one = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind")))
        return end, F.when(good, one).otherwise(none_of(_SPAN))

    return fold(each, F.lit(0), step, _SPAN)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with ``spans``: array of (start, rank, end, kind), by start, then in the order of the rules."""
    found = materialize(candidates(docs, rules, id_col, text_col), "candidates").select(F.col("id").alias("_id"), F.col("h").alias("_h"), F.col("kinds").alias("_kinds"))
    found = F.broadcast(found) if is_small(found, MOST_BROADCAST) else found
    text = text_or_empty(f"`{text_col}`")
    own = [c for c in docs.columns if c != "spans"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"), text.alias("_text"), F.col(f"`{id_col}`").cast("long").alias("_doc"))
    rows = rows.join(found, F.col("_doc").eqNullSafe(F.col("_id")) & (F.xxhash64("_text") == F.col("_h")), "left")
    parts = []
    for rank, rule in enumerate(rules):
        go = F.array_contains("_kinds", rule.kind) if trigram_query(rule.pattern) is not None else F.col("_text").rlike(rule.pattern)
        parts.append(F.when(go, _spans(F.col("_text"), rule, rank)).otherwise(none_of(_SPAN)))
    return rows.select("_row.*", F.sort_array(F.concat(*parts)).alias("spans"))


def of_kind(kind: str):
    return lambda s: s["kind"] == kind


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping spans, replaced by [kind] of its first one. Spans come by start."""
    kept = fold(spans, F.lit(0), lambda at, s: (F.greatest(at, s["end"]), F.array(F.struct(at.alias("at"), s["start"].alias("start"), s["kind"].alias("kind")))), "struct<at:int,start:int,kind:string>")
    # at: where the spans before end. One that starts before is part of their run.
    kept = F.filter(kept, lambda k: k["start"] >= k["at"])
    last = F.array_max(F.transform(spans, lambda s: s["end"]))

    def done(blocks: Column) -> Column:
        parts = F.transform(kept, lambda k: F.concat(cut(blocks, k["at"], k["start"]), F.lit("["), k["kind"], F.lit("]")))
        return F.concat(F.array_join(parts, ""), cut(blocks, last, F.length(text)))

    return F.when(F.size(spans) > 0, F.transform(F.array(in_blocks(text)), done)[0]).otherwise(text)
