"""Best-fit packing of documents into training sequences, by a configuration linear program.

A configuration is a multiset of lengths that fits into one sequence. The
program asks for the fewest configurations that cover the histogram of lengths.
It is solved by multiplicative weights: every length has a weight, which falls
as it gets covered; knapsack dynamic programming over the weights prices the
configurations; the best one that holds a given length is read off the same
table for all lengths at once. The prices also prove a lower bound of the number of
sequences. Shares of the fractional solution are rounded down, without the
configurations that hold less than the bound allows on average, what is left
over is placed by best fit, longest first, still on the histogram, and the share
with the fewest sequences is taken.

The histogram has one entry a length, so all of this has a size set by the
capacity (2,048), not by the corpus. The plan is a table of runs: "of the pieces
of length l, numbers s to e go to sequences from q on, at place o". Each worker
finds the run of its pieces by binary search. Number of runs: at most the number
of rounds times the capacity times the lengths in a configuration, whatever the
number of documents.

Pieces are numbered within their length without a sort: within the partition
that made them, plus the count of that length in partitions before it. Pieces
and numbers are written to the shared folder first, so a lost executor can't
renumber them. A length that a third of all pieces have is thus no hot key.

Defined results: null and empty texts have the end id only; repeated rows are
documents of their own; a document with a null id is packed as well. An empty
table has no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.common import batch, in_turn, materialize, picked, slices
from gristmill.llm.tokens import encoder, forget, vocabulary

CAPACITY = 2048
END_ID = 0
#: Rounds of multiplicative weights, the rate, and how far below the best price a configuration may be.
ROUNDS, RATE, NEAR = 48, 2.0, 0.01
#: Shares of the fractional amounts that rounding tries; the rest is placed by best fit.
SHARES = (1.0, 0.9, 0.7, 0.4, 0.1)

_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("nth", pa.int64())])


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, encode = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), encoder(path)
        end, width = encode.end(end_id), encode.width
        for b in slices(batches, 1000):
            rows: list[tuple] = []
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), encode.encode_all(b.column("text").to_pylist()), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), width * capacity)):
                    own = ids[at : at + width * capacity]
                    n = len(own) // width
                    rows.append((doc_id, k, at // width, n, zlib.crc32(encode.wide(own)), part, seen[n]))
                    seen[n] += 1
            yield batch(dict(zip(_PIECES.names, zip(*rows, strict=True), strict=True)), _PIECES)

    return run


def _price(profit: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack by dynamic programming: best profit within each capacity, and the item taken last (-1: none)."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        fit = np.searchsorted(lengths, c, "right")
        best[c] = best[c - 1]
        if fit:
            value = profit[:fit] + best[c - lengths[:fit]]
            k = int(value.argmax())
            if value[k] > best[c]:
                best[c], last[c] = value[k], k
    return best, last


def _holding_each(last: np.ndarray, lengths: np.ndarray, capacity: int) -> list[dict[int, int]]:
    """For each length, the best configuration that holds it, as {place in lengths: how many}."""
    out = []
    for k, n in enumerate(lengths):
        own, c = {k: 1}, capacity - int(n)
        while c > 0:
            if last[c] < 0:
                c -= 1
                continue
            own[int(last[c])] = own.get(int(last[c]), 0) + 1
            c -= int(lengths[last[c]])
        out.append(own)
    return out


def fractional(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS) -> tuple[dict[tuple, float], float]:
    """Configurations with fractional amounts, and a lower bound of the number of sequences."""
    weight = (lengths * counts).astype(float)
    amounts: dict[tuple, float] = {}
    bound = float((lengths * counts).sum() / capacity)
    covered = np.zeros(len(lengths))
    for _ in range(rounds):
        profit = weight / counts
        best, last = _price(profit, lengths, capacity)
        bound = max(bound, float((profit * counts).sum() / best[capacity]))
        made = _holding_each(last, lengths, capacity)
        value = np.array([sum(profit[k] * n for k, n in own.items()) for own in made])
        want = np.where(value >= (1 - NEAR) * best[capacity], counts * np.exp(-covered), 0)
        step = bound / rounds * want / want.sum()
        gain = np.zeros(len(lengths))
        for own, x in zip(made, step, strict=True):
            if x > 0:
                key = tuple(sorted(own.items()))
                amounts[key] = amounts.get(key, 0.0) + x
                for k, n in own.items():
                    gain[k] += n * x
        covered += gain / counts
        weight *= np.exp(-RATE * np.clip(gain / counts, 0, 3))
        weight /= weight.max()
    return amounts, bound


def plan(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> tuple[list[tuple[tuple[tuple[int, int], ...], int]], float]:
    """[(configuration as ((length, how many), ...), sequences)], covering the histogram exactly; and the lower bound."""
    out: list[tuple[tuple[tuple[int, int], ...], int]] = [(((n, capacity // n),), count // (capacity // n)) for n, count in histogram.items() if n == capacity]
    lengths = np.array(sorted(n for n in histogram if n < capacity), np.int64)
    if not len(lengths):
        return out, float(sum(x for _, x in out))
    counts = np.array([histogram[int(n)] for n in lengths], np.int64)
    amounts, bound = fractional(lengths, counts, capacity, rounds)
    full = lambda own: sum(int(lengths[k]) * n for k, n in own)
    enough = int((lengths * counts).sum() / bound)  # what a sequence holds on average if the bound is met
    amounts = {own: x for own, x in amounts.items() if full(own) >= enough}
    order = sorted(amounts.items(), key=lambda p: (-full(p[0]), -p[1], p[0]))
    rounded = []
    for part in SHARES:
        left, used = counts.copy(), []
        for own, x in order:
            times = min([int(x * part), *(int(left[k]) // n for k, n in own)])
            if times:
                used.append((tuple((int(lengths[k]), n) for k, n in own), times))
                for k, n in own:
                    left[k] -= n * times
        rounded.append(used + _best_fit(lengths, left, capacity))
    best = min(rounded, key=lambda used: sum(x for _, x in used))
    return out + best, bound + sum(x for _, x in out)


def _best_fit(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best fit, longest first, with like sequences placed as one."""
    room: dict[int, list[tuple[tuple, int]]] = {}
    for n, count in zip(lengths[::-1].tolist(), counts[::-1].tolist(), strict=True):
        while count and (fits := [r for r in room if r >= n]):
            r = min(fits)
            own, times = room[r].pop()
            if not room[r]:
                del room[r]
            each = min(r // n, count)
            use = min(times, count // each)
            if use < times:
                room.setdefault(r, []).append((own, times - use))
            room.setdefault(r - each * n, []).append(((*own, (n, each)), use))
            count -= each * use
        each = capacity // n
        for size, times in ((each, count // each), (count % each, 1)):
            if size and times:
                room.setdefault(capacity - size * n, []).append((((n, size),), times))
    return [x for own in room.values() for x in own]


def runs(planned: list[tuple[tuple[tuple[int, int], ...], int]]) -> dict[str, np.ndarray]:
    """The plan by length: pieces from number ``first`` on, ``each`` to a sequence, from ``sequence`` and ``offset`` on."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for own, times in planned:
        offset = 0
        for n, each in own:
            first = used.get(n, 0)
            rows.append((n, first, each, sequence, offset))
            used[n] = first + each * times
            offset += n * each
        sequence += times
    rows.sort()
    return dict(zip(("length", "first", "each", "sequence", "offset"), np.array(rows, np.int64).reshape(-1, 5).T, strict=True))


#: More than any number of pieces of one length: joins length and number to one sorted key.
_SPAN = 1 << 50

_PLACED = pa.schema([*list(_PIECES)[:5], ("sequence_id", pa.int64()), ("offset", pa.int64())])


def _place(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = shared.value
        keys = r["length"] * _SPAN + r["first"]
        for b in batches:
            n, nth = b.column("length").to_numpy(), b.column("nth").to_numpy()
            at = np.searchsorted(keys, n * _SPAN + nth, "right") - 1
            ahead = nth - r["first"][at]
            own = {c: b.column(c) for c in _PIECES.names[:5]}
            yield batch(own | {"sequence_id": r["sequence"][at] + ahead // r["each"][at], "offset": r["offset"][at] + ahead % r["each"][at] * n}, _PLACED)

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, rounds: int = ROUNDS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. See the module's text."""
    spark = docs.sparkSession
    docs = picked(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long"
    pieces = materialize(docs.mapInArrow(in_turn(forget, _pieces(tokenizer or vocabulary(), capacity, end_id)), f"{kinds}, part int, nth long"), "pieces")
    by_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    planned, _ = plan(histogram, capacity, rounds)
    shared = spark.sparkContext.broadcast(runs(planned))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    before = by_part.select("part", "length", F.coalesce(before, F.lit(0)).alias("before"))
    numbered = pieces.join(before, ["part", "length"]).withColumn("nth", F.col("nth") + F.col("before"))
    return numbered.mapInArrow(in_turn(forget, _place(shared)), f"{kinds}, sequence_id long, offset long")
