"""Near-duplicate documents by circulant MinHash.

Two permutations make the whole signature: sigma spreads the shingles over a
universe of 2**32 places, and pi, circularly shifted by k, gives coordinate k:
``sig[k] = min(pi(sigma(s) + k mod 2**32))``. Bands of the signature find
candidates, and the full shingle sets of both documents confirm each link.

Order of work:

1. one pass over the texts: size and digest of the set, band keys, and a
   signature of one byte a coordinate;
2. equal sets collapse to one node, by digest, so a group of exact copies costs
   one row from here on. A node stands for its least (id, hash of the text);
3. band keys that several nodes share are kept. First each node of such a bucket
   is paired with the bucket's least: one row a node and bucket. Pairs whose byte
   signatures may reach the threshold are verified on their full sets, and links
   make components;
4. then the buckets that hold nodes of several components. In each, all pairs of
   different components are screened by their byte signatures, in the task that
   holds the bucket, and the nodes of pairs that may be linked are named: a row a
   node and bucket, not a row a pair. Their full sets go to the bucket, where the
   pairs are verified in the order of their likeness. A link joins two components
   there and then, and pairs within a component are passed over; so a bucket gives
   back a forest, fewer links than it has nodes, however many pairs it held. A
   pair is looked at in the first bucket that it shares only;
5. components follow by alternating large-star and small-star steps,
   distributed, with the edges written between rounds.

Buckets above ``BLOCK`` nodes are dealt in cells: blocks of nodes outside the
bucket's largest component meet each other and all blocks of that component, of
which no two need to meet. So what grows with a group of copies is a row a copy;
rows are repeated only where over ``BLOCK`` nodes of one bucket are linked to
none of its largest component.

Losses: a link of similarity 0.75 has no common band with probability
(1 - 0.75**4)**36, about 1e-6, and is screened out by the byte signature with
about 1e-6; both fall quickly above 0.75.

Defined results: null or empty texts and texts of white space have no shingles,
no links and stay. Rows with a null id stay and are linked with nothing. Rows
that repeat an id are one document: it is linked with whatever one of its texts
is linked with. Columns other than id and text are not looked at, whatever their
names. Tables of steps that are over are removed from the shared folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import batch, discard, in_turn, is_small, materialize, picked, slices

WORDS = 5
BANDS, ROWS = 36, 4
COORDINATES = BANDS * ROWS
#: Estimated similarity from which a pair is verified: 4.7 standard errors below 0.75.
SCREEN = 0.58
#: Nodes of a block, and the shingles in a block; a cell holds two blocks at most.
BLOCK, BLOCK_SHINGLES = 1024, 4_000_000
#: Cells of up to so many nodes are compared together, column by column.
FEW = 12
#: Pairs that are verified at one time.
VERIFIED = 128
#: Candidate ids up to this number (24 bytes each) are broadcast to pick their texts; beyond it they are joined by shuffle.
MOST_BROADCAST = 300_000
#: Words whose hash a worker remembers.
CACHE = 50_000

# Odd 64-bit and 32-bit mixing constants (golden ratio, and the finalizers of splitmix64 and murmur3).
GOLDEN = 0x9E3779B97F4A7C15
MIX64 = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
MIX32 = (0x85EBCA6B, 0xC2B2AE35)

_M64 = (1 << 64) - 1
_PLACES = np.array([pow(GOLDEN, 2 * i + 1, 1 << 64) | 1 for i in range(WORDS)], np.uint64)
_SHIFTS = np.arange(COORDINATES, dtype=np.uint32)[:, None]
#: Numbers that are permuted at one time.
_AT_ONCE = 150_000


class _WordHashes(dict):
    """Hash of a lower-cased word; forgets all when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _WordHashes()


def forget() -> None:
    """Drops the hashes of words that this worker remembers."""
    _HASHES.clear()


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX64[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX64[1])
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles of the whole text.

    Words are runs of anything but ASCII white space, A-Z lower-cased. Fewer
    words than five are one shingle; none are no shingle.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - WORDS + 1)
    out = np.full(n, min(len(h), WORDS), np.uint64)
    for i in range(min(WORDS, len(h))):
        out += _mix64(h[i : i + n]) * _PLACES[i]
    return np.unique(_mix64(out))


def signature(s: np.ndarray) -> np.ndarray:
    """The circulant MinHash signature of a set of 64-bit hashes."""
    sigma = (_mix64(s ^ np.uint64(GOLDEN)) >> np.uint64(32)).astype(np.uint32)
    low = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    step = _AT_ONCE // COORDINATES
    for at in range(0, len(sigma), step):
        x = sigma[at : at + step] + _SHIFTS
        x ^= x >> np.uint32(16)
        x *= np.uint32(MIX32[0])
        x ^= x >> np.uint32(13)
        x *= np.uint32(MIX32[1])
        x ^= x >> np.uint32(16)
        np.minimum(low, x.min(1), out=low)
    return low


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band, the band's number included."""
    x = np.arange(BANDS, dtype=np.uint64)
    for column in sig.reshape(BANDS, ROWS).T:
        x = _mix64(x * np.uint64(GOLDEN) + column + np.uint64(1))
    return x.view(np.int64)


_SIGNED = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("sig", pa.binary()), ("keys", pa.list_(pa.int64()))])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 1000):
        n, digests, sigs, keys, offsets = [], [], [], [], [0]
        for text in b.column("text"):
            s = shingles(text.as_py())
            n.append(len(s))
            if len(s):
                sig = signature(s)
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sigs.append(sig.astype(np.uint8).tobytes())
                keys.append(band_keys(sig))
            else:
                digests.append(None)
                sigs.append(None)
            offsets.append(len(keys) * BANDS)
        keys = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64)))
        yield batch({"doc_id": b.column("doc_id"), "h": b.column("h"), "n_shingles": n, "digest": digests, "sig": sigs, "keys": keys}, _SIGNED)


_SET = pa.schema([("node", pa.int64()), ("set", pa.binary())])


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 1000):
        yield batch({"node": b.column("node"), "set": [shingles(t.as_py()).tobytes() for t in b.column("text")]}, _SET)


def _bytes(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _alike(sizes: np.ndarray, sigs: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Estimated similarity of the pairs (i, j); 0 where their sizes or their signatures rule a link out."""
    out = np.zeros(len(i))
    for at in range(0, len(i), 20_000):
        x, y = i[at : at + 20_000], j[at : at + 20_000]
        can = np.flatnonzero(np.minimum(sizes[x], sizes[y]) * 100 >= np.maximum(sizes[x], sizes[y]) * 75)
        near = (sigs[x[can]] == sigs[y[can]]).mean(1)
        out[at + can] = np.where(near >= SCREEN, near, 0)
    return out


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _screen_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) whose byte signatures leave a link possible."""
    for b in batches:
        t, n = pa.Table.from_batches([b]), b.num_rows
        if n:
            sizes = np.r_[b.column("size_a").to_numpy(), b.column("size_b").to_numpy()]
            sigs = np.concatenate([_bytes(t.column(c), COORDINATES) for c in ("sig_a", "sig_b")])
            good = np.flatnonzero(_alike(sizes, sigs, np.arange(n), np.arange(n, 2 * n)))
            yield b.select(["a", "b"]).take(pa.array(good))


class _Cells:
    """Rows of whole cells, sorted by (key, lo, hi), as arrays."""

    def __init__(self, t: pa.Table):
        self.key, self.lo, self.hi, self.part, self.node, self.sizes, self.comp = (t.column(c).to_numpy() for c in ("key", "lo", "hi", "part", "node", "n_shingles", "comp"))
        self.sigs = _bytes(t.column("sig"), COORDINATES)
        self.keys = pc.list_flatten(t.column("keys")).to_numpy().reshape(-1, BANDS)
        starts = np.flatnonzero(np.r_[True, (self.key[1:] != self.key[:-1]) | (self.lo[1:] != self.lo[:-1]) | (self.hi[1:] != self.hi[:-1])])
        self.starts, self.counts = starts, np.diff(np.r_[starts, len(self.key)])

    def _here(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs have this bucket as the first one they share."""
        first = (self.keys[i] == self.keys[j]).argmax(1)
        return self.keys[i, first] == self.key[i]

    def few(self) -> tuple[np.ndarray, np.ndarray]:
        """Candidate pairs of all cells of up to ``FEW`` nodes."""
        cell = np.repeat(np.arange(len(self.counts)), self.counts)
        small = (self.counts <= FEW)[cell]
        cross = self.lo != self.hi
        out = []
        for d in range(1, FEW):
            i = np.flatnonzero(small[: max(0, len(cell) - d)])
            j = i + d
            can = (cell[i] == cell[j]) & (self.comp[i] != self.comp[j]) & (~cross[i] | (self.part[i] != self.part[j]))
            i, j = i[can], j[can]
            can = self._here(i, j)
            i, j = i[can], j[can]
            can = _alike(self.sizes, self.sigs, i, j) > 0
            out.append((i[can], j[can]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def of(self, at: int, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(row, rows, likeness) of one cell's candidate pairs. Nodes of the largest component are met from the other side only."""
        rows = np.arange(at, at + n)
        comp, part = self.comp[rows], self.part[rows]
        values, counts = np.unique(comp, return_counts=True)
        if len(values) < 2:
            return
        largest = comp == values[counts.argmax()]
        for i in rows[~largest]:
            j = rows[(comp != self.comp[i]) & ((rows > i) | largest)]
            if self.lo[at] != self.hi[at]:
                j = j[self.part[j] != self.part[i]]
            i_too = np.full(len(j), i)
            here = self._here(i_too, j)
            j, i_too = j[here], i_too[here]
            near = _alike(self.sizes, self.sigs, i_too, j)
            good = np.flatnonzero(near)
            if len(good):
                good = good[np.argsort(-near[good], kind="stable")]
                yield int(i), j[good], near[good]


def _whole_cells(work):
    """Runs work on tables of whole cells, from rows sorted by (key, lo, hi); a cell may span batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            key, lo, hi = (t.column(c).to_numpy() for c in ("key", "lo", "hi"))
            same = (key == key[-1]) & (lo == lo[-1]) & (hi == hi[-1])
            cut = 0 if same.all() else int(np.flatnonzero(~same)[-1]) + 1
            own = key[-1], lo[-1], hi[-1]
            if cut or (last is not None and last != own):
                yield from work(_Cells(whole := pa.concat_tables([*held, t.slice(0, cut)])), whole)
                held = []
            held.append(t.slice(cut))
            last = own
        if held:
            yield from work(_Cells(whole := pa.concat_tables(held)), whole)

    return run


_INVOLVED = pa.schema([("key", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("part", pa.int32()), ("node", pa.int64())])


def _involved(c: _Cells, t: pa.Table) -> Iterator[pa.RecordBatch]:
    """The rows that are in some candidate pair."""
    use = np.zeros(len(c.key), bool)
    for x in c.few():
        use[x] = True
    for at, n in zip(c.starts, c.counts, strict=True):
        if n > FEW:
            for i, j, _ in c.of(int(at), int(n)):
                use[i] = True
                use[j] = True
    yield from t.select(_INVOLVED.names).take(pa.array(np.flatnonzero(use))).cast(_INVOLVED).to_batches()


def linked(a: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Which of the others have 100 * intersection >= 75 * union with a. All are sorted sets."""
    sizes = np.array([len(x) for x in others])
    all_of = np.concatenate(others)
    at = np.minimum(np.searchsorted(a, all_of), len(a) - 1)
    both = np.add.reduceat((a[at] == all_of).astype(np.int64), np.r_[0, np.cumsum(sizes)[:-1]])
    return 100 * both >= 75 * (len(a) + sizes - both)


def _forest(c: _Cells, t: pa.Table) -> Iterator[pa.RecordBatch]:
    """Links (a, b), by document, that join the components of each cell as far as its linked pairs do."""
    texts, ids, out = t.column("set"), t.column("doc_id").to_numpy(), []
    for at, n in zip(c.starts, c.counts, strict=True):
        if n < 2:
            continue
        sets = [np.frombuffer(texts[k].as_py(), np.uint64) for k in range(at, at + n)]
        top = {x: x for x in np.unique(c.comp[at : at + n]).tolist()}

        def root(x: int, top: dict[int, int] = top) -> int:
            while top[x] != x:
                top[x] = x = top[top[x]]
            return x

        for i, j, _ in c.of(int(at), int(n)):
            while len(j):
                own = root(int(c.comp[i]))
                j = j[[root(x) != own for x in c.comp[j].tolist()]]
                now, j = j[:VERIFIED], j[VERIFIED:]
                if not len(now):
                    break
                for k in now[linked(sets[i - at], [sets[k - at] for k in now])]:
                    x, y = root(int(c.comp[i])), root(int(c.comp[k]))
                    if x != y:
                        top[max(x, y)] = min(x, y)
                        out.append((ids[i], ids[k]))
    a, b = np.array(out, np.int64).reshape(-1, 2).T
    yield batch({"a": np.minimum(a, b), "b": np.maximum(a, b)}, _PAIRS)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b), by document, of the pairs of nodes that reach the threshold on their full sets. Rows come sorted by a."""
    last, sa = None, None
    for b in batches:
        keep = []
        for k, (i, ta, tb) in enumerate(zip(b.column("a").to_pylist(), b.column("text_a"), b.column("text_b"), strict=True)):
            if i != last:
                last, sa = i, shingles(ta.as_py())
            if linked(sa, [shingles(tb.as_py())])[0]:
                keep.append(k)
        yield pa.RecordBatch.from_arrays([b.column("doc_a"), b.column("doc_b")], schema=_PAIRS).take(pa.array(keep, pa.int64()))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has an edge (a, b).

    Alternates large-star and small-star steps until neither changes the edges.
    Minima are pre-aggregated before each shuffle; no node's neighbours are
    gathered.
    """
    edges = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = state(edges)
    while before[0]:
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").where("v > m").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        old, large = edges, materialize(large, "edges")
        discard(old)
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b")
        small = small.select("m", "b").union(small.where("a > m").select("m", "a")).toDF("a", "b").distinct()
        edges = materialize(small, "edges")
        discard(large)
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component"))


def _texts(docs: DataFrame, nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """(node, doc_id, text) of these distinct nodes."""
    ids = F.broadcast(ids) if (small := is_small(ids, MOST_BROADCAST)) else ids
    own = nodes.select("node", "doc_id", "h").join(ids, "node", "left_semi")
    own = F.broadcast(own) if small else own
    return docs.join(own, ["doc_id", "h"]).groupBy("node", "doc_id").agg(F.min("text").alias("text"))


def _side(df: DataFrame, side: str, **columns: str) -> DataFrame:
    """node as ``side`` and other columns under names of their own."""
    return df.select(F.col("node").alias(side), *[F.col(old).alias(f"{new}_{side}") for new, old in columns.items()])


def _star_links(docs: DataFrame, nodes: DataFrame, members: DataFrame) -> DataFrame:
    """Links between each node of a bucket and the bucket's least."""
    pairs = members.where("node > least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    signs = {side: _side(nodes, side, size="n_shingles", sig="sig") for side in "ab"}
    pairs = pairs.join(signs["b"], "b").join(signs["a"], "a").select("a", "b", "size_a", "size_b", "sig_a", "sig_b")
    pairs = materialize(pairs.mapInArrow(in_turn(forget, _screen_pairs), "a long, b long"), "pairs")
    ids = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    texts = materialize(_texts(docs, nodes, ids), "texts")
    read = pairs.join(_side(texts, "b", text="text", doc="doc_id"), "b")
    read = read.join(_side(texts, "a", text="text", doc="doc_id").hint("merge"), "a")
    return read.select("a", "doc_a", "doc_b", "text_a", "text_b").mapInArrow(in_turn(forget, _verify), "a long, b long")


def _dealt(members: DataFrame, found: DataFrame) -> DataFrame:
    """(key, lo, hi, part, node, doc_id, comp): the nodes of buckets of several components, dealt to cells."""
    rows = members.join(found, "doc_id", "left").select("key", "node", "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("comp"))
    mixed = rows.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("key")
    rows = rows.join(mixed, "key", "left_semi")
    weight = F.greatest(F.lit(1 / BLOCK), F.col("n_shingles") / BLOCK_SHINGLES)
    each = rows.groupBy("key", "comp").agg(F.sum(weight).alias("w"))
    # Per bucket: its largest component, and how many blocks that and the rest make.
    cells = each.groupBy("key").agg(F.max(F.struct("w", "comp")).alias("most"), F.sum("w").alias("w"))
    cells = cells.select("key", F.col("most.comp").alias("largest"), F.ceil("most.w").cast("int").alias("inner"), F.greatest(F.ceil(F.col("w") - F.col("most.w") - 1e-6), F.lit(1)).cast("int").alias("outer"), (F.col("w") <= 1).alias("one"))
    rows = rows.join(cells, "key").withColumn("in", F.col("comp") == F.col("largest"))
    nth = F.xxhash64("node")
    rows = rows.withColumn("part", F.when(F.col("one"), 0).when(F.col("in"), F.col("outer") + F.pmod(nth, "inner")).otherwise(F.pmod(nth, "outer")).cast("int"))
    others = F.when(F.col("one"), F.array(F.lit(0))).when(F.col("in"), F.sequence(F.lit(0), F.col("outer") - 1)).otherwise(F.sequence(F.lit(0), F.col("outer") + F.col("inner") - 1))
    rows = rows.withColumn("other", F.explode(others))
    return rows.select("key", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "node", "doc_id", "comp")


_CELL = ("key", "lo", "hi")


def _with(rows: DataFrame, own: DataFrame, *columns: str) -> DataFrame:
    """The rows of cells with columns of their nodes, whole cells together and sorted."""
    each = rows.groupBy("node", "doc_id", "comp").agg(F.collect_list(F.struct(*_CELL, "part")).alias("cells"))
    dealt = each.join(own, "node").select("node", "doc_id", "comp", *columns, F.inline("cells"))
    return dealt.repartition(*_CELL).sortWithinPartitions(*_CELL, "node")


def _other_links(docs: DataFrame, nodes: DataFrame, members: DataFrame, found: DataFrame) -> DataFrame:
    """Links between the components that buckets hold parts of."""
    rows = materialize(_dealt(members, found), "cells")
    signs = ("n_shingles", "sig", "keys")
    named = _with(rows, nodes.select("node", *signs), *signs).mapInArrow(in_turn(forget, _whole_cells(_involved)), "key long, lo int, hi int, part int, node long")
    named = materialize(named, "involved")
    texts = _texts(docs, nodes, named.select("node").distinct())
    sets = materialize(texts.select("node", "text").mapInArrow(in_turn(forget, _full_sets), "node long, set binary"), "sets")
    rows = rows.join(named, [*_CELL, "part", "node"], "left_semi")
    links = _with(rows, nodes.select("node", *signs).join(sets, "node"), *signs, "set").mapInArrow(in_turn(forget, _whole_cells(_forest)), "a long, b long")
    return links.distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept. See the module's text."""
    docs = picked(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    signed = materialize(docs.mapInArrow(in_turn(forget, _sign), "doc_id long, h long, n_shingles long, digest binary, sig binary, keys array<long>"), "signed")

    sets = signed.where("doc_id is not null and n_shingles > 0")
    first = sets.groupBy("digest").agg(F.min(F.struct("doc_id", "h")).alias("first")).select("digest", "first.*")
    unique = sets.join(first, ["digest", "doc_id", "h"]).dropDuplicates(["digest", "doc_id", "h"])
    nodes = materialize(unique.withColumn("node", F.monotonically_increasing_id()), "nodes")

    keys = nodes.select("node", "doc_id", "n_shingles", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("least")).where("n > 1").drop("n")
    members = materialize(keys.join(shared, "key"), "members")

    # Texts that share an id are one document.
    ids = sets.select("digest", "doc_id").distinct()
    several = ids.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    same = ids.join(several, "doc_id").join(first.select("digest", F.col("doc_id").alias("a")), "digest").select("a", F.col("doc_id").alias("b")).where("a <> b")

    # Each step's edges are written by components() before the next one reads them.
    found = components(_star_links(docs, nodes, members).union(same)).toDF("doc_id", "component")
    links = _other_links(docs, nodes, members, found)
    found = components(links.union(found.select("component", "doc_id"))).toDF("doc_id", "component")
    discard(members)

    of = nodes.select("doc_id", "digest").join(found, "doc_id", "left").select("digest", F.coalesce("component", "doc_id").alias("component"))
    out = signed.select("doc_id", "n_shingles", "digest").join(of, "digest", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
