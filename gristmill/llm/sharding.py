"""Shards of nearly equal bytes by histogram sort.

The order is by hash of the text, then id: equal texts are neighbours, and a
group of copies larger than a shard is cut between ids. To find the boundaries
between shards, candidate keys ("probes") are set for each boundary at once; one
pass over a narrow table (hash, id, size) counts the exact bytes and rows between
neighbouring probes, and the least and largest key there. Each boundary's
interval then shrinks to the keys between the two probes around its target, and
new probes are set in it, until the bytes below a boundary meet the tolerance or
one key is left, which each round comes nearer to. Then the rows, with all their
columns, are exchanged once. The driver gets one row per interval between probes,
a number set by the number of shards.

Where many rows of equal text and equal id stand at a boundary, rows get a place
as third part of their key, which is written with them first, so that it is the
same whenever it is read.

A shard above ``PART_BYTES`` is exchanged as several parts, so no task holds a
whole shard: by arithmetic on the hash, which is even, and copies of one text
above that size by hash of id and place. Counts of parts, and where each begins
in its shard, stay in tables; nothing of them is held by the driver.

Law of the result: ``bytes``. A shard's bytes differ from the mean by the
tolerance or, where rows are larger than that, by the rows at its two ends.

Defined results: a null text counts as empty; a null id sorts first. Slots are
gapless from 0, in the order of the key within a part. An empty table has no
rows. All columns of the input are kept; a column named shard or slot is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.common import batch, is_small, materialize, text_or_empty

SHARDS = 40
ROW_BYTES = 16
PART_BYTES = 64_000_000
PROBES = 32
#: Allowed distance of a boundary from its target, as a share of a shard's mean bytes.
TOLERANCE = 0.0005
#: Rows (parts, or texts with very many copies) that are broadcast; more are joined by shuffle.
MOST_BROADCAST = 200_000

KEY = ("h", "i", "place")
_BIAS, _HALF = 1 << 63, 1 << 64
_COUNTED = pa.schema([("bin", pa.int64()), ("bytes", pa.int64()), ("n", pa.int64()), *((f"{c}{k}", pa.int64()) for k in (0, 1) for c in KEY)])


def _key(h: int, i: int, place: int) -> int:
    return ((h + _BIAS) * _HALF + i + _BIAS) * _HALF + place + _BIAS


def _parts(keys: list[int]) -> list[np.ndarray]:
    return [np.array([k // _HALF**n % _HALF - _BIAS for k in keys], np.int64) for n in (2, 1, 0)]


def _bins(own: list[np.ndarray], probes: list[np.ndarray]) -> np.ndarray:
    """How many of the sorted probes are at or below each key; keys and probes by their parts."""
    out = np.searchsorted(probes[0], own[0], "right")
    if len(own) > 1:
        first = np.searchsorted(probes[0], own[0], "left")
        tied = np.flatnonzero(out > first)
        for value in np.unique(own[0][tied]):
            same = tied[own[0][tied] == value]
            a, b = first[same[0]], out[same[0]]
            out[same] = a + _bins([x[same] for x in own[1:]], [x[a:b] for x in probes[1:]])
    return out


def _count(probes: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            own, size = [b.column(c).to_numpy() for c in KEY], b.column("size").to_numpy()
            order = np.lexsort(own[::-1])
            own, size = [x[order] for x in own], size[order]
            bins = _bins(own, probes)
            at = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
            last = np.r_[at[1:], len(bins)] - 1
            ends = {f"{c}{k}": x[rows] for k, rows in enumerate((at, last)) for c, x in zip(KEY, own, strict=True)}
            yield batch({"bin": bins[at], "bytes": np.add.reduceat(size, at), "n": last - at + 1, **ends}, _COUNTED)

    return run


def counts_between(sized: DataFrame, probes: list[int]) -> list[tuple]:
    """Per interval with rows, in order: (bin, bytes, rows, least key, largest key)."""
    each = sized.select(*KEY, "size").mapInArrow(_count(_parts(probes)), ", ".join(f"{f.name} long" for f in _COUNTED))
    least, most = ([f"{c}{k}" for c in KEY] for k in (0, 1))
    each = each.groupBy("bin").agg(F.sum("bytes"), F.sum("n"), F.min(F.struct(*least)), F.max(F.struct(*most))).orderBy("bin")
    return [(r[0], r[1], r[2], _key(*r[3]), _key(*r[4])) for r in each.collect()]


def splitters(sized: DataFrame, shards: int, tolerance: float, total: int, low: int, high: int) -> tuple[list[int], bool]:
    """(shards - 1 keys, whether equal rows are in the way); shard p holds the keys from splitter p - 1 on and below splitter p."""
    targets = [total * j // shards for j in range(1, shards)]
    best: list[tuple[int, int]] = [(min(t, total - t), low if t <= total - t else high + 1) for t in targets]  # (distance, key)
    inside = {j: (low, high) for j in range(len(targets))}  # the least and largest key between which the boundary lies
    tied = False
    while inside := {j: x for j, x in inside.items() if best[j][0] > tolerance}:
        probes = sorted({a + (b - a) * k // (PROBES + 1) + 1 for a, b in set(inside.values()) for k in range(PROBES + 1)} | {k for a, b in inside.values() for k in (a, b + 1)})
        found = counts_between(sized, probes)
        ends, below = [], 0
        for _, size, _, _, _ in found:
            below += size
            ends.append(below)
        for j in list(inside):
            k = int(np.searchsorted(ends, targets[j]))
            _, size, n, a, b = found[k]
            best[j] = min(best[j], (abs(ends[k] - size - targets[j]), a), (abs(ends[k] - targets[j]), b + 1))
            if a == b:
                tied |= n > 1 and best[j][0] > tolerance
                del inside[j]
            else:
                inside[j] = (a, b)
    return [k for _, k in best], tied


def _heavy(sized: DataFrame, part_bytes: int) -> DataFrame:
    """(h, pieces) of texts whose copies together are larger than a part."""
    heavy = sized.groupBy("h").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).where((F.col("bytes") > part_bytes) & (F.col("n") > 1))
    return heavy.select("h", F.ceil(F.col("bytes") / part_bytes).cast("int").alias("pieces"))


def _joined(df: DataFrame, other: DataFrame, on: list[str], how: str) -> DataFrame:
    return df.join(F.broadcast(other) if is_small(other, MOST_BROADCAST) else other, on, how)


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = PART_BYTES, tolerance: float = TOLERANCE) -> DataFrame:
    """The rows of docs with shard (int) and slot (long). See the module's text."""
    text = text_or_empty(f"`{text_col}`")
    own = [c for c in docs.columns if c not in ("shard", "slot")]
    id_ = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-_BIAS))
    size = F.octet_length(text).cast("long") + ROW_BYTES
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.xxhash64(text).alias("h"), id_.alias("i"), F.lit(0).cast("long").alias("place"), size.alias("size"))
    sized = materialize(keyed.select(*KEY, "size"), "sized")
    total, low, high = sized.agg(F.sum("size"), F.min(F.struct(*KEY)), F.max(F.struct(*KEY))).first()
    if total is None:
        return docs.withColumn("shard", F.lit(0)).withColumn("slot", F.lit(0).cast("long"))
    heavy = materialize(_heavy(sized, part_bytes), "heavy")
    cuts, tied = splitters(sized, shards, tolerance * total / shards, total, _key(*low), _key(*high))
    equal = _joined(sized, heavy, ["h"], "left_semi").groupBy("h", "i").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    if tied or equal.where(f"bytes > {part_bytes} AND n > 1").limit(1).count():
        keyed = materialize(keyed.withColumn("place", F.monotonically_increasing_id()), "keyed")
        sized = keyed.select(*KEY, "size")
        low, high = sized.agg(F.min(F.struct(*KEY)), F.max(F.struct(*KEY))).first()
        cuts, _ = splitters(sized, shards, tolerance * total / shards, total, _key(*low), _key(*high))
    cuts = sorted(cuts)
    probes, split = _parts(cuts), -(-total // (shards * part_bytes))

    @F.pandas_udf("int")
    def of_shard(h: pd.Series, i: pd.Series, place: pd.Series) -> pd.Series:
        return pd.Series(_bins([x.to_numpy() for x in (h, i, place)], probes).astype(np.int32))

    first, last = ([float(k // _HALF**2 - _BIAS) for k in keys] for keys in ([_key(*low), *cuts], [*cuts, _key(*high)]))
    at = lambda ends: F.element_at(F.lit(ends) if shards > 1 else F.array(F.lit(ends[0])), F.col("shard") + 1)

    def dealt(df: DataFrame) -> DataFrame:
        df = df.withColumn("shard", of_shard(*KEY))
        share = (F.col("h").cast("double") - at(first)) / F.greatest(at(last) - at(first), F.lit(1.0))
        df = df.withColumn("part", F.least(F.greatest(F.floor(share * split), F.lit(0)), F.lit(split - 1)).cast("int"))
        df = _joined(df, heavy, ["h"], "left")
        return df.withColumn("piece", F.coalesce(F.pmod(F.xxhash64("i", "place"), "pieces"), F.lit(0)).cast("int")).drop("pieces")

    part = ["shard", "part", "piece"]
    counted = dealt(sized.select(*KEY)).groupBy(*part).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1))
    counted = materialize(counted.select(*part, F.coalesce(before, F.lit(0)).alias("before")), "parts")
    # A task a part; pieces of a text with very many copies go to the tasks next to its part's.
    task = F.pmod(F.col("shard").cast("long") * split + F.col("part") + F.col("piece"), F.lit(shards * split)).cast("int")
    rows = dealt(keyed.drop("size")).withColumn("task", task).repartitionById(shards * split, "task")
    nth = F.row_number().over(Window.partitionBy("task", *part).orderBy(*KEY))
    rows = _joined(rows.withColumn("nth", nth), counted, part, "inner")
    return rows.select("row.*", "shard", (F.col("nth") - 1 + F.col("before")).cast("long").alias("slot"))
