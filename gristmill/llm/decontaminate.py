"""Benchmark items in documents, also with other numbers, names and units in them.

Texts become templates: a number is one placeholder, a number with a unit behind
it another, and a capitalised word (but not one all in capitals) inside a sentence is a name;
neighbours of one kind are one placeholder; all other words stay, case-folded and without marks around them. Windows of ``WINDOW`` template
tokens, of which at least ``LITERALS`` are words, are hashed. As names are told by
their case, so are windows of templates without names, for copies in other case.
And so are windows of ``WINDOW`` plain words, numbers and names among them by
their value, however dense the placeholders; they meet where templates have no
window. Of an item with fewer tokens than ``WINDOW`` the whole is one window.
Windows of documents that no item has are dropped where they are made; the rest
is hash-joined with the items' windows.

Matches of a text and an item at one distance of positions are one alignment, and
so are those at distances up to ``DRIFT`` apart, for values of other lengths.
Its slots must agree: wherever the item has the same value, so has the
document. With all values equal it is ``exact``, with others ``reparameterised``;
where one value of the item meets two of the document, the alignment is no hit,
nor is a part of it that is equal, but a whole item in plain words is. A hit has
at least ``RUN`` windows, or half of the windows of a short item.

Loss: where placeholders leave no window of a template, the item is found with
its own values only.

Sizes: up to ``MOST_HASHES`` distinct item windows (8 bytes each), their sorted
hashes go to the workers; beyond that the join alone does the work. Passages that
a third of the documents share cost one row a window and document, and their join
key is spread by Spark's skew handling or a broadcast of a checked size. The
common windows of one text and one item meet in one worker.

Defined results: null texts and those without words, documents or items, have no
windows and no hits. An item of one word is in every document that has the word.
Rows of a null id count as one document or item; texts are compared one by one,
and the best hit of an id counts. Repeated rows change nothing. Empty tables give
no rows. Only id and text are read.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import batch, in_turn, is_small, materialize, picked, slices

WINDOW, LITERALS = 8, 5
RUN, SHARE = 6, 0.5
DRIFT = 4
MOST_HASHES = 2_000_000
#: Item windows (about 150 bytes each) up to which they are broadcast to those of the documents.
MOST_BROADCAST = 200_000
CACHE = 200_000

# Units that may follow a number.
UNITS = frozenset(
    "%|percent|km|m|cm|mm|mi|mile|miles|meter|meters|metre|metres|feet|foot|ft|inch|inches|yard|yards|kg|g|mg|gram|grams|pound|pounds|lb|lbs|ounce|ounces|oz|"
    "l|ml|liter|liters|litre|litres|gallon|gallons|s|sec|second|seconds|minute|minutes|min|h|hour|hours|day|days|week|weeks|month|months|year|years|"
    "dollar|dollars|cent|cents|euro|euros|usd|eur|degree|degrees|kmh|mph".split("|")
)
# Numbers in words.
NUMBERS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen".split()
)
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*([^\W\d_]+|%)?")
SKIP, WORD, NUMBER, UNIT, QUANTITY, NAME = range(6)
_SLOT_HASH = np.array([0, 0, *(xxhash.xxh3_64_intdigest(k) for k in (b"<number>", b"<unit>", b"<quantity>", b"<name>"))], np.uint64)
#: Kinds of windows; each has its own hashes.
STREAMS = TEMPLATE, CASELESS, LITERAL = range(3)
_SALT = np.array([[xxhash.xxh3_64_intdigest(bytes([s, k])) for k in range(WINDOW + 1)] for s in STREAMS], np.uint64)
_PLACES = np.array([xxhash.xxh3_64_intdigest(bytes([k])) | 1 for k in range(WINDOW)], np.uint64)


class _Tokens(dict):
    """Number of a raw token; the token's properties are in arrays by that number. Forgets all when full."""

    def __init__(self):
        self._reset()

    def _reset(self, size: int = CACHE) -> None:
        self.clear()
        self.hash, self.kind, self.capital, self.ends = np.zeros(size, np.uint64), np.zeros(size, np.int8), np.zeros(size, bool), np.zeros(size, bool)
        self._put = memoryview(self.hash), memoryview(self.kind)  # quicker to write one by one

    def __missing__(self, raw: str) -> int:
        k = len(self)
        if raw.isalpha():  # nothing to take off, and no digits
            low = raw if raw.isascii() and raw.islower() else raw.casefold()
            self._put[0][k], self._put[1][k] = xxhash.xxh3_64_intdigest(low), NUMBER if low in NUMBERS else UNIT if low in UNITS else WORD
            if low is not raw and raw[:1].isupper() and raw[1:2].islower():
                self.capital[k] = True
            self[raw] = k
            return k
        bare = raw.strip(".,;:!?\"'()[]{}<>|*_`«»“”‘’…")
        low = bare.casefold()
        kind = WORD if low else SKIP
        if m := _NUMBER.fullmatch(low):
            kind = QUANTITY if m[1] and m[1] in UNITS else WORD if m[1] else NUMBER
        elif low in NUMBERS:
            kind = NUMBER
        elif low in UNITS or raw.strip() == "%":
            kind, low = UNIT, low or raw.strip()
        self.hash[k], self.kind[k] = xxhash.xxh3_64_intdigest(low), kind
        self.capital[k], self.ends[k] = bare[:1].isupper() and bare[1:2].islower(), raw.rstrip("\"')]»”’")[-1:] in (".", "!", "?", ":")
        self[raw] = k
        return k

    def of(self, words: list[str]) -> np.ndarray:
        if len(self) + len(words) > CACHE:
            self._reset(max(CACHE, len(words)))  # a text may have more words than are remembered
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


_TOKENS = _Tokens()


def forget() -> None:
    """Drops the tokens that this worker remembers."""
    _TOKENS._reset()


def _slotted(own: np.ndarray, kind: np.ndarray, ends: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The tokens with neighbours of one kind of placeholder, within a sentence, as one."""
    slot = kind != WORD
    joins = slot[1:] & ~ends[:-1] & ((kind[1:] == kind[:-1]) | ((kind[1:] == QUANTITY) & (kind[:-1] == NUMBER)))
    if joins.any():
        first = np.flatnonzero(np.r_[True, ~joins])
        behind = np.arange(len(kind)) - np.repeat(first, np.diff(np.r_[first, len(kind)]))
        own = np.add.reduceat(own * np.power(np.uint64(31), behind.astype(np.uint64)), first)
        kind, place = kind[np.r_[first[1:], len(kind)] - 1], place[first]
        slot = kind != WORD
    return np.where(slot, _SLOT_HASH[kind], own), slot, own, place


def sequences(text: str | None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each kind of windows: (hash, whether it is a placeholder, hash of its value, number of its first word) of each token of the whole text."""
    at = _TOKENS.of((text or "").split())
    own, kind, ends = _TOKENS.hash[at], _TOKENS.kind[at].astype(np.int64), _TOKENS.ends[at]
    start = np.r_[True, ends[:-1]] if len(at) else np.zeros(0, bool)
    word = kind != SKIP
    plain = own[word]
    kind[(kind == WORD) & _TOKENS.capital[at] & ~start] = NAME
    place = np.cumsum(word) - 1
    unit = np.flatnonzero((kind[1:] == UNIT) & (kind[:-1] == NUMBER)) + 1
    own[unit - 1] = own[unit - 1] * np.uint64(31) + own[unit]
    kind[unit - 1], kind[unit] = QUANTITY, SKIP
    kind[kind == UNIT] = WORD
    keep = kind != SKIP
    ends[unit - 1] |= ends[unit]
    own, kind, ends, place = own[keep], kind[keep], ends[keep], place[keep]
    template = _slotted(own, kind, ends, place)
    caseless = _slotted(own, np.where(kind == NAME, WORD, kind), ends, place) if (kind == NAME).any() else template
    literal = caseless if len(own) == len(plain) and not caseless[1].any() else (plain, np.zeros(len(plain), bool), plain, np.arange(len(plain)))
    return [template, caseless, literal]


def _hashes(own: np.ndarray, size: int) -> np.ndarray:
    n = len(own) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    own = own ^ (own >> np.uint64(29))
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h += own[k : k + n] * _PLACES[k]
    return h ^ (h >> np.uint64(32))


def windows(text: str | None, sizes: list[set[int]] | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, tuple]]:
    """(kind, size, hash, position, sequence) of the windows of each kind and size.

    Without sizes as for an item: windows of ``WINDOW`` tokens, or the whole of a shorter one.
    """
    last = None
    for stream, sequence in enumerate(sequences(text)):
        own, slot = sequence[:2]
        n = len(own)
        if last is None or last[0] is not own:
            last = own, {}
        for size in sorted(sizes[stream] if sizes else {min(n, WINDOW)}):
            if not 0 < size <= n:
                continue
            if size not in last[1]:
                last[1][size] = _hashes(own, size)
            h = last[1][size] ^ _SALT[stream][size]
            if stream == LITERAL or not slot.any():
                at = np.arange(len(h))
                if stream != LITERAL and size < LITERALS:
                    continue
            else:
                filled = np.r_[0, np.cumsum(slot)]
                at = np.flatnonzero(filled[size:] - filled[: len(h)] <= size - LITERALS)
            yield stream, size, h[at], at, sequence


_ROWS = pa.schema([("id", pa.int64()), ("digest", pa.int64()), ("stream", pa.int32()), ("size", pa.int32()), ("n", pa.int32()), ("h", pa.int64()), ("pos", pa.int32()), ("place", pa.int32()), ("vals", pa.list_(pa.int64()))])
_SEEN_BITS = np.uint64((1 << 20) - 1)


def _emit(known, sizes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = known.value if known is not None else None
        if wanted is not None:
            maybe = np.zeros(int(_SEEN_BITS) + 1, bool)  # most windows are told from the wanted ones by 20 bits
            maybe[wanted.view(np.uint64) & _SEEN_BITS] = True
        for b in slices(batches, 500):
            out = {f.name: [] for f in _ROWS}
            for i, text in zip(b.column("id").to_pylist(), b.column("text"), strict=True):
                text = text.as_py()
                digest = None
                for stream, size, h, pos, (_, slot, value, place) in windows(text, sizes):
                    n = len(h)
                    if wanted is not None:
                        hit = np.flatnonzero(maybe[h & _SEEN_BITS])
                        own = h[hit].view(np.int64)
                        hit = hit[wanted[np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)] == own]
                        h, pos = h[hit], pos[hit]
                    if not len(h):
                        continue
                    if digest is None:
                        digest = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)
                    filled = np.r_[np.where(slot, value.view(np.int64), 0), np.zeros(WINDOW, np.int64)]
                    vals = filled[pos[:, None] + np.arange(WINDOW)]
                    vals[:, size:] = 0
                    for name, v in (("id", [i]), ("digest", [digest]), ("stream", [stream]), ("size", [size]), ("n", [n])):
                        out[name] += v * len(h)
                    for name, v in (("h", h.view(np.int64)), ("pos", pos), ("place", place[pos]), ("vals", vals.ravel())):
                        out[name].append(v)
            if out["id"]:
                vals = pa.ListArray.from_arrays(pa.array(np.arange(len(out["id"]) + 1) * WINDOW, pa.int32()), pa.array(np.concatenate(out["vals"])))
                yield batch(out | {"h": np.concatenate(out["h"]), "pos": np.concatenate(out["pos"]).astype(np.int32), "place": np.concatenate(out["place"]).astype(np.int32), "vals": vals}, _ROWS)

    return run


def _windowed(df: DataFrame, known=None, sizes: list[set[int]] | None = None) -> DataFrame:
    return df.mapInArrow(in_turn(forget, _emit(known, sizes)), "id long, digest long, stream int, size int, n int, h long, pos int, place int, vals array<long>")


_HITS = pa.schema([("id", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64()), ("stream", pa.int32()), ("n_changed", pa.int64()), ("left", pa.int32()), ("n_windows", pa.int64()), ("item_windows", pa.int64()), ("n_slots", pa.int64())])


def _agreeing(item: np.ndarray, own: np.ndarray) -> tuple[bool, int, int]:
    """(whether each value of the item meets one of the document, distinct values, how many of them differ)."""
    filled = item != 0
    pairs = np.unique(np.stack([item[filled], own[filled]], 1), axis=0)
    n = len(np.unique(pairs[:, 0]))
    return n == len(pairs), n, int((pairs[:, 0] != pairs[:, 1]).sum())


def _best(key: tuple, rows: pa.Table) -> pa.Table:
    """The best hit of one text and one item, from their common windows."""
    col = {c: rows.column(c).to_numpy() for c in ("stream", "n", "item_pos", "pos", "place")}
    vals, item_vals = (rows.column(c).combine_chunks().flatten().to_numpy().reshape(-1, WINDOW) for c in ("vals", "item_vals"))
    uneven, hits = [], []
    for stream in STREAMS:
        at = np.flatnonzero(col["stream"] == stream)
        if not len(at):
            continue
        shift = col["pos"][at] - col["item_pos"][at]
        order = np.argsort(shift, kind="stable")
        at, shift = at[order], shift[order]
        n_item = int(col["n"][at[0]])
        need = min(RUN, -int(-n_item * SHARE // 1))
        shifts, begin = np.unique(shift, return_index=True)
        end = np.r_[begin[1:], len(at)]
        last = end[np.searchsorted(shifts, shifts + DRIFT, "right") - 1]
        alone = zip(shifts, begin, end, itertools.repeat(False))
        pooled = ((left, lo, hi, True) for left, lo, hi, own in zip(shifts, begin, last, end, strict=True) if hi > own)
        for left, lo, hi, pool in itertools.chain(alone, pooled):
            if hi - lo < need:
                continue
            some = at[lo:hi]
            n_windows = len(np.unique(col["item_pos"][some]))
            if n_windows < need:
                continue
            agree, n_slots, n_changed = _agreeing(item_vals[some].ravel(), vals[some].ravel())
            covers = int(col["place"][some].min()), int(col["place"][some].max()) + WINDOW
            if agree:
                hits.append(((n_windows / n_item, -stream, -n_changed, -int(left)), n_windows, n_item, n_slots, covers))
            elif stream != LITERAL and not pool:
                uneven.append(covers)
    # A part that is equal in an alignment whose values disagree makes no hit; a whole item does.
    hits = [h for h in hits if h[0][1] == -TEMPLATE or h[0][:2] == (1, -LITERAL) or not any(a < h[4][1] and h[4][0] < b for a, b in uneven)]
    if not hits:
        return _HITS.empty_table()
    (coverage, stream, same, left), n_windows, n_item, n_slots, _ = max(hits)
    own = key[0].as_py(), key[2].as_py(), coverage, -stream, -same, -left, n_windows, n_item, n_slots
    return pa.table({f.name: pa.array([v], f.type) for f, v in zip(_HITS, own, strict=True)})


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and item that it holds: doc_id, item_id, n_windows, item_windows, coverage, n_slots, n_changed, kind."""
    spark = docs.sparkSession
    docs = picked(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    items = picked(benchmark, id=item_col, text=item_text).withColumn("id", F.col("id").cast("long"))
    items = materialize(_windowed(items).dropDuplicates(["id", "digest", "stream", "pos"]), "items")
    sizes = [set() for _ in STREAMS]
    for stream, size in items.select("stream", "size").distinct().collect():
        sizes[stream].add(size)
    items = items.select(F.col("id").alias("item_id"), F.col("digest").alias("item_digest"), "stream", "n", "h", F.col("pos").alias("item_pos"), F.col("vals").alias("item_vals"))
    hashes = items.select("h").distinct()
    known = None
    if is_small(hashes, MOST_HASHES):
        known = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in hashes.collect()], np.int64)))
        if not len(known.value):
            docs = docs.where("false")
    found = _windowed(docs, known, sizes).select("id", "digest", "h", "pos", "place", "vals")
    found = found.join(F.broadcast(items) if is_small(items, MOST_BROADCAST) else items, "h").drop("h")
    keys = ["id", "digest", "item_id", "item_digest"]
    hits = found.repartition(*keys).distinct().groupBy(*keys).applyInArrow(
        _best, "id long, item_id long, coverage double, stream int, n_changed long, left int, n_windows long, item_windows long, n_slots long"
    )
    best = hits.select("id", "item_id", F.struct("coverage", (-F.col("stream")).alias("strict"), (-F.col("n_changed")).alias("same"), (-F.col("left")).alias("near"), "n_windows", "item_windows", "n_slots", "n_changed").alias("one"))
    best = best.groupBy("id", "item_id").agg(F.max("one").alias("one"))
    return best.select(
        F.col("id").alias("doc_id"),
        "item_id",
        "one.n_windows",
        "one.item_windows",
        "one.coverage",
        "one.n_slots",
        "one.n_changed",
        F.when(F.col("one.n_changed") == 0, "exact").otherwise("reparameterised").alias("kind"),
    )
