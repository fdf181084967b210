r"""Chat records of many layouts, brought to canonical turns and one template. DataFrame functions only.

A layout is declared by the nested field paths it has and by SQL that makes turns
of them. The sorted paths are hashed; that fingerprint selects the layout:

* of a table, from its schema (``layout_of``): the paths of the schema that some
  layout knows, so other columns do no harm;
* of JSON records, for each record (``canonical_records``): the known paths that
  the record has.

A turn in the template is ``<|im_start|>role<|im_sep|>text<|im_end|>``. Inside
roles and texts a backslash is doubled, and one is put behind the first character
of each control string (``CONTROL``), so no control string is left and the text
can be had back: of two backslashes one stays, a single one goes.

The loss mask is a list of runs (characters, loss) over the formatted string:
three runs a turn, of which the middle one, the text, counts for assistants.

Defined results: null roles and texts are empty. Turns are ordered by number,
nulls first, ties by role and text; repeated rows are turns of their own. Rows of
a null conversation id are one conversation. Records of unknown layout or broken
JSON are kept, with null layout, turns and text. An empty table has no rows.

A conversation becomes one row, as its consumer needs it; its turns are gathered
in blocks of ``BLOCK`` numbers first, so that no task sorts more than a block.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.llm.common import cut, fold, in_blocks, none_of

BLOCK = 256
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
MARKS = r"<\|im_start\|>|<\|im_sep\|>|<\|im_end\|>"
# The first character of a control string of a public chat template, the rest looked ahead.
CONTROL = r"<(?=\||s>|/s>|<SYS>>|</SYS>>)|\[(?=/?INST\])"
LOSS_ROLE = "assistant"
# Names that layouts use for the canonical roles.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}


@dataclass(frozen=True)
class Layout:
    """paths: with [] behind a list. turns: SQL for array<struct<role, text>>, over columns or, for records, the variant ``v``."""

    name: str
    paths: tuple[str, ...]
    turns: str = ""
    record: str = ""


def _two(first: str, second: str) -> tuple[str, str]:
    """SQL of a user turn and an assistant turn, over columns and over a record."""
    pair = "array(named_struct('role', 'user', 'text', {}), named_struct('role', 'assistant', 'text', {}))"
    return pair.format(first, second), pair.format(*(f"variant_get(v, '$.{c}', 'string')" for c in (first, second)))


def _list(field: str, role: str, text: str) -> tuple[str, str]:
    turn = f"named_struct('role', x.{role}, 'text', x.{text})"
    cast = f"variant_get(v, '$.{field}', 'array<struct<{role}:string,{text}:string>>')"
    return f"transform({field}, x -> {turn})", f"transform({cast}, x -> {turn})"


def _instruction(more: bool) -> tuple[str, str]:
    columns = ("instruction", "input", "output")
    out = []
    for get in (lambda c: c, lambda c: f"variant_get(v, '$.{c}', 'string')"):
        a, b, c = map(get, columns)
        ask = f"if(coalesce({b}, '') = '', {a}, concat({a}, '\\n\\n', {b}))" if more else a
        out.append(f"array(named_struct('role', 'user', 'text', {ask}), named_struct('role', 'assistant', 'text', {c}))")
    return out[0], out[1]


LAYOUTS = (
    Layout("turn_rows", ("conv_id", "role", "text", "turn")),
    Layout("messages", ("messages", "messages[].content", "messages[].role"), *_list("messages", "role", "content")),
    Layout("from_value", ("conversations", "conversations[].from", "conversations[].value"), *_list("conversations", "from", "value")),
    Layout("instruction_input", ("input", "instruction", "output"), *_instruction(True)),
    Layout("instruction", ("instruction", "output"), *_instruction(False)),
    Layout("prompt_completion", ("completion", "prompt"), *_two("prompt", "completion")),
    Layout("prompt_response", ("prompt", "response"), *_two("prompt", "response")),
    Layout("question_answer", ("answer", "question"), *_two("question", "answer")),
)


def fingerprint(paths) -> str:
    """SHA-256 of the sorted nested field paths."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def schema_paths(kind: T.DataType, at: str = "") -> list[str]:
    """All nested field paths of a schema."""
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{at}[]")
    if not isinstance(kind, T.StructType):
        return []
    own = [f"{at}.{f.name}" if at else f.name for f in kind]
    return own + [p for f, name in zip(kind, own, strict=True) for p in schema_paths(f.dataType, name)]


def layout_of(df: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS, id_col: str = "conv_id") -> Layout:
    """The layout of a table: that whose fingerprint the known paths have, or else the one with most paths, all there.

    The column of ids counts as conv_id, whatever its name.
    """
    known = {p for x in layouts for p in x.paths} & {"conv_id" if p == id_col else p for p in schema_paths(df.schema)}
    by_print = {fingerprint(x.paths): x for x in layouts}
    if found := by_print.get(fingerprint(known)):
        return found
    fits = [x for x in layouts if fingerprint(known & set(x.paths)) == fingerprint(x.paths)]
    if not fits:
        raise ValueError(f"no layout has the paths {sorted(schema_paths(df.schema))}")
    return max(fits, key=lambda x: len(x.paths))


def _canonical(turns: Column, roles: dict[str, str] = ROLES) -> Column:
    def one(t: Column) -> Column:
        role = F.coalesce(t["role"].cast("string"), F.lit(""))
        for old, new in roles.items():
            role = F.when(role == old, F.lit(new)).otherwise(role)
        return F.struct(role.alias("role"), F.coalesce(t["text"].cast("string"), F.lit("")).alias("text"))

    return F.transform(turns, one)


def canonical(df: DataFrame, id_col: str = "conv_id", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(id, layout, turns) of a table of one layout."""
    layout = layout_of(df, layouts, id_col)
    if layout.name != "turn_rows":
        return df.select(F.col(f"`{id_col}`").alias("id"), F.lit(layout.name).alias("layout"), _canonical(F.expr(layout.turns)).alias("turns"))
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.floor(F.col("turn") / BLOCK).alias("block"), F.struct(F.col("turn"), role, text).alias("one"))
    blocks = rows.groupBy("id", "block").agg(F.sort_array(F.collect_list("one")).alias("own"))
    whole = blocks.groupBy("id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("block", "own"))), lambda b: b["own"])).alias("turns"))
    # Roles of rows are canonical as they are.
    return whole.select("id", F.lit(layout.name).alias("layout"), _canonical(F.col("turns"), {}).alias("turns"))


def canonical_records(df: DataFrame, id_col: str, json_col: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(id, layout, turns) of JSON records, each of its own layout."""
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.try_parse_json(F.col(f"`{json_col}`").cast("string")).alias("v"))
    layouts = tuple(x for x in layouts if x.record)
    known = sorted({p for x in layouts for p in x.paths})
    has = [F.when(F.try_variant_get("v", "$." + p.replace("[]", "[0]"), "variant").isNotNull(), F.lit(p)) for p in known]
    rows = rows.withColumn("print", F.sha2(F.array_join(F.array_compact(F.array(*has)), "\n"), 256))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role:string,text:string>>")
    for x in layouts:
        is_it = F.col("print") == fingerprint(x.paths)
        name = F.when(is_it, F.lit(x.name)).otherwise(name)
        turns = F.when(is_it, F.expr(x.record.replace("variant_get(", "try_variant_get("))).otherwise(turns)
    return rows.select("id", name.alias("layout"), _canonical(turns).alias("turns"))


def escape(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), CONTROL, r"$0\\")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"\\(\\?)", "$1")


def format_chat(turns: DataFrame) -> DataFrame:
    """Adds formatted (string) and mask (array of (chars, loss)) to rows of (id, layout, turns)."""
    marked = F.transform("turns", lambda t: F.struct(escape(t["role"]).alias("role"), escape(t["text"]).alias("text"), (t["role"] == LOSS_ROLE).alias("loss")))
    rows = turns.withColumn("_marked", marked)
    text = F.array_join(F.transform("_marked", lambda t: F.concat(F.lit(START), t["role"], F.lit(SEP), t["text"], F.lit(END))), "")
    run = lambda n, loss: F.struct(n.cast("int").alias("chars"), loss.alias("loss"))
    no = F.lit(False)
    mask = F.flatten(F.transform("_marked", lambda t: F.array(run(F.length(t["role"]) + len(START) + len(SEP), no), run(F.length(t["text"]), t["loss"]), run(F.lit(len(END)), no))))
    return rows.select("id", "layout", "turns", text.alias("formatted"), mask.alias("mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """From formatted and mask alone: (id, turns as array of (role, text), loss_text).

    The text under the loss mask is cut out where the mask's runs say.
    """
    parts = F.split("formatted", MARKS, -1)
    rows = formatted.select("id", "formatted", "mask", F.when(F.col("formatted") == "", F.array().cast("array<string>")).otherwise(parts).alias("_parts"))
    n = F.floor(F.size("_parts") / 3).cast("int")
    numbers = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    # Pieces 3k + 1 and 3k + 2 are role and text.
    turn = lambda k: F.struct(unescape(F.get("_parts", k * 3 + 1)).alias("role"), unescape(F.get("_parts", k * 3 + 2)).alias("text"))
    kind = "struct<a:int,b:int>"
    step = lambda at, m: (at + m["chars"], F.when(m["loss"], F.array(F.struct(at.alias("a"), (at + m["chars"]).alias("b")))).otherwise(none_of(kind)))
    runs = fold(F.col("mask"), F.lit(0), step, kind)
    loss = F.transform(F.array(in_blocks(F.col("formatted"))), lambda blocks: F.array_join(F.transform(runs, lambda r: unescape(cut(blocks, r["a"], r["b"]))), ""))[0]
    return rows.select("id", "formatted", F.transform(numbers, turn).alias("turns"), loss.alias("loss_text"))
