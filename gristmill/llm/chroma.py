"""Chroma fingerprints of recordings, and their alignment.

A recording is a column of samples. Overlapping frames become 12 pitch-class
energies each (Hann window, Fourier transform, bins summed by the nearest
semitone). Over the integral image of these, 16 box filters compare sums of
neighbouring rectangles; each gives two bits by Gray code, so every position has
one packed 32-bit integer.

Recordings of equal fingerprints are one class, addressed by its least id. The
queries' classes meet all classes in blocks. A task indexes the integers of its
block, looks up those of the queries and counts votes, equal integers, by offset:
the histogram of a pair. Each voted offset is held against the rule: at most
``BIT_ERROR`` of the bits differ over an overlap of at least ``LEAST_SHARE`` of the
shorter fingerprint. Of the offsets that do, the one with most votes is given, of
these the one with fewest differing bits. A class is a row however many copies it
has, so copies aren't joined with each other, and a task puts out matches only, so
an integer that many recordings have costs no rows.

The levels of the filters are as wide as their values usually spread, so all four
are used and recordings that have nothing in common differ in 0.28 of the bits at
the median. Vectors of cosine 0.97 or more, taken as recordings, differ in 0.04 at
the median and in 0.075 at the 99th hundredth; of unrelated pairs one in 1,000
comes below 0.14. That is what the rule is set by.

Loss: pairs that meet the rule without one equal integer at a matching offset. The
test measures recall against brute force over all offsets.

Frames of silence carry nothing: an overlap needs a position where both sound. Recordings with fewer frames
than the filters are wide have no fingerprint, no class but their own, and match
nothing; so have null ones. Rows of a null id are left out. Repeated rows are
rows of one class. Only the id and the samples are read.

Samples that a table has at hand may be no sound: the registered query takes each
vector of ``embeddings`` as a short mono recording.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import batch, materialize, picked, slices

BIT_ERROR = 0.085
LEAST_SHARE = 0.9
BLOCK = 100_000
#: Positions that are compared at one time.
AT_ONCE = 1_000_000
QUERY_STEP = 50
LOWEST, CONCERT_A = 27.5, 440.0
#: Filters: kind (which halves or thirds are compared), first pitch class, height, width, by rule.
WIDTH = 8
FILTERS = tuple((k % 4, (5 * k) % 12 % (13 - h), h, w) for k in range(16) for h, w in [((2, 3, 4, 6, 8, 12)[k % 6] if k % 4 != 1 else (2, 4, 6)[k % 3], (2, 4, 6, 8)[k // 4])])
#: Thresholds of a filter's four levels.
LEVELS = (-1.0, 0.0, 1.0)
_GRAY = np.array([0, 1, 3, 2], np.uint32)


@dataclass(frozen=True)
class Audio:
    """Sample rate, frame length and hop, in samples."""

    rate: int = 11_025
    frame: int = 4_096
    hop: int = 1_365


#: 64 numbers make 33 frames.
SHORT = Audio(8_000, 32, 1)


def chroma(samples: np.ndarray, audio: Audio) -> np.ndarray:
    """Pitch-class energies (recording, frame, class) of recordings of one length, scaled to length one; zeros for silence."""
    n = (samples.shape[1] - audio.frame) // audio.hop + 1
    if n <= 0:
        return np.zeros((len(samples), 0, 12))
    window = np.hanning(audio.frame + 2)[1:-1]
    hertz = np.fft.rfftfreq(audio.frame, 1 / audio.rate)
    use = hertz >= LOWEST
    of = np.zeros((use.sum(), 12))
    of[np.arange(len(of)), np.round(12 * np.log2(hertz[use] / CONCERT_A) + 9).astype(int) % 12] = 1
    out = np.empty((len(samples), n, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples, audio.frame, axis=1)[:, :: audio.hop]
    step = max(1, AT_ONCE // (audio.frame * len(samples)))
    for at in range(0, n, step):
        out[:, at : at + step] = (np.abs(np.fft.rfft(frames[:, at : at + step] * window, axis=2)[:, :, use]) ** 2) @ of
    norm = np.linalg.norm(out, axis=2, keepdims=True)
    return np.where(norm > 1e-9, out / np.maximum(norm, 1e-9), 0.0)


def fingerprints_of(samples: np.ndarray, audio: Audio) -> tuple[np.ndarray, np.ndarray]:
    """Packed integers (recording, position), and which of them have sound in their first frame."""
    image = chroma(np.nan_to_num(np.asarray(samples, float)), audio)
    n = image.shape[1] - WIDTH + 1
    if n <= 0:
        return np.empty((len(samples), 0), np.uint32), np.empty((len(samples), 0), bool)
    total = np.zeros((len(image), image.shape[1] + 1, 13))
    total[:, 1:, 1:] = image.cumsum(1).cumsum(2)
    t = np.arange(n)

    def box(x0: int, y0: int, x1: int, y1: int) -> np.ndarray:
        return total[:, t + x1, y1] - total[:, t + x0, y1] - total[:, t + x1, y0] + total[:, t + x0, y0]

    out = np.zeros((len(image), n), np.uint32)
    for kind, y, h, w in FILTERS:
        whole, mid, up = box(0, y, w, y + h), w // 2, y + h // 2
        if kind == 0:  # early against late
            part = box(0, y, mid, y + h)
        elif kind == 1:  # low against high
            part = box(0, y, w, up)
        elif kind == 2:  # the rectangle against all pitches
            part, whole = whole, box(0, 0, w, 12)
            part, whole = part * 12, whole * h + part * 12
        else:  # one diagonal against the other
            part = box(0, y, mid, up) + box(mid, up, w, y + h)
        # Rounded, so that the level doesn't hang on the last bits of a sum.
        value = np.round(np.log((part + 1e-3) / np.maximum(whole - part + 1e-3, 1e-4)), 6)
        out = (out << np.uint32(2)) | _GRAY[np.digitize(value, LEVELS)]
    return out, image[:, :n].any(2)


def fingerprint(samples: np.ndarray, audio: Audio) -> tuple[np.ndarray, np.ndarray]:
    """Packed integers of one recording, and which of them have sound in their first frame."""
    prints, sound = fingerprints_of(np.asarray(samples, float)[None], audio)
    return prints[0], sound[0]


_PRINTS = pa.schema([("id", pa.int64()), ("print", pa.list_(pa.int32())), ("sound", pa.list_(pa.bool_()))])


def fingerprints(recordings: DataFrame, id_col: str, samples_col: str, audio: Audio) -> DataFrame:
    """(id, print, sound)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 500):
            samples = [np.array(x or [], float) for x in b.column("samples").to_pylist()]
            prints, sound = [[]] * len(samples), [[]] * len(samples)
            by_size: dict[int, list[int]] = {}
            for k, x in enumerate(samples):
                by_size.setdefault(len(x), []).append(k)
            for size, own in by_size.items():
                step = max(1, AT_ONCE // max(size, 1))
                for at in range(0, len(own), step):
                    some = own[at : at + step]
                    for k, p, heard in zip(some, *fingerprints_of(np.stack([samples[k] for k in some]), audio), strict=True):
                        prints[k], sound[k] = p.view(np.int32), heard
            yield batch({"id": b.column("id"), "print": prints, "sound": sound}, _PRINTS)

    rows = picked(recordings, id=id_col, samples=samples_col).select(F.col("id").cast("long").alias("id"), "samples").where("id is not null")
    return rows.mapInArrow(run, "id long, print array<int>, sound array<boolean>")


_ERRORS = pa.schema([("query_class", pa.int64()), ("match_class", pa.int64()), ("offset", pa.int32()), ("votes", pa.int64()), ("bit_error", pa.float64())])


def least_overlap(a: int, b: int) -> int:
    """Positions that fingerprints of these lengths must have in common."""
    return max(1, int(np.ceil(LEAST_SHARE * min(a, b))))


def bit_error(a: np.ndarray, b: np.ndarray, offset: int) -> float:
    """Share of differing bits where a, moved right by offset, lies over b; 1 if too little does."""
    lo, hi = max(0, offset), min(len(b), len(a) + offset)
    if hi - lo < least_overlap(len(a), len(b)):
        return 1.0
    x = a[lo - offset : hi - offset].view(np.uint32) ^ b[lo:hi].view(np.uint32)
    return float(np.bitwise_count(x).sum() / (32 * (hi - lo)))


class Prints:
    """Fingerprints one behind the other, and an index of their integers."""

    def __init__(self, rows: list[dict]):
        self.ids = np.array([r["class_id"] for r in rows], np.int64)
        self.sizes = np.array([len(r["print"]) for r in rows], np.int64)
        self.starts = np.r_[0, np.cumsum(self.sizes)]
        self.ints = np.array([x for r in rows for x in r["print"]], np.int64).astype(np.int32).view(np.uint32)
        self.sound = np.array([x for r in rows for x in r["sound"]], bool)
        self.owner = np.repeat(np.arange(len(rows)), self.sizes)
        self.place = np.arange(len(self.ints)) - self.starts[self.owner]
        heard = np.flatnonzero(self.sound)
        self.order = heard[np.argsort(self.ints[heard], kind="stable")]
        self.sorted = self.ints[self.order]


def votes(q: Prints, c: Prints) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The offset histograms of all pairs with an equal integer: (number in q, number in c, offset, votes)."""
    at = q.order
    lo, hi = (np.searchsorted(c.sorted, q.ints[at], side) for side in ("left", "right"))
    each = hi - lo
    own = np.repeat(at, each)
    other = c.order[np.repeat(lo - np.r_[0, np.cumsum(each)[:-1]], each) + np.arange(each.sum())] if each.sum() else np.empty(0, np.int64)
    a, b, offset = q.owner[own], c.owner[other], c.place[other] - q.place[own]
    over = np.minimum(c.sizes[b], q.sizes[a] + offset) - np.maximum(0, offset)
    enough = np.flatnonzero((over >= np.ceil(LEAST_SHARE * np.minimum(q.sizes[a], c.sizes[b]))) & (q.ids[a] != c.ids[b]))
    found, n = np.unique(np.stack([a[enough], b[enough], offset[enough]], 1), axis=0, return_counts=True)
    return found[:, 0], found[:, 1], found[:, 2], n


def matches(q: Prints, c: Prints) -> Iterator[pa.RecordBatch]:
    """The best offset of each pair that meets the rule at one it has votes for."""
    a, b, offset, n = votes(q, c)
    lo, hi = np.maximum(0, offset), np.minimum(c.sizes[b], q.sizes[a] + offset)
    error, ends = np.empty(len(a)), np.cumsum(hi - lo)
    at = 0
    while at < len(a):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
        s = slice(at, to)
        size = hi[s] - lo[s]
        k = np.arange(size.sum()) - np.repeat(np.r_[0, np.cumsum(size)[:-1]], size)
        x = q.ints[np.repeat(q.starts[a[s]] + lo[s] - offset[s], size) + k] ^ c.ints[np.repeat(c.starts[b[s]] + lo[s], size) + k]
        error[s] = np.add.reduceat(np.bitwise_count(x).astype(np.int64), np.r_[0, np.cumsum(size)[:-1]]) / (32 * size)
        at = to
    good = np.flatnonzero(error <= BIT_ERROR)
    order = good[np.lexsort((offset[good], np.abs(offset[good]), error[good], -n[good], b[good], a[good]))]
    if len(order):
        first = order[np.r_[True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])]]
        yield batch({"query_class": q.ids[a[first]], "match_class": c.ids[b[first]], "offset": offset[first].astype(np.int32), "votes": n[first], "bit_error": error[first]}, _ERRORS)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: tuple[bytes, Prints] | None = None
    for b in batches:
        for asked, classes, name in zip(b.column("asked"), b.column("classes"), b.column("name").to_pylist(), strict=True):
            if held is None or held[0] != name:
                held = name, Prints(classes.as_py())
            yield from matches(Prints(asked.as_py()), held[1])


def _blocks(classes: DataFrame, name: str) -> DataFrame:
    """The classes dealt by id into rows of about ``BLOCK`` positions each."""
    n = max(1, (classes.agg(F.sum(F.size("print"))).first()[0] or 0) // BLOCK)
    rows = classes.groupBy(F.pmod(F.xxhash64("class_id"), F.lit(n)).alias("block")).agg(F.collect_list(F.struct("class_id", "print", "sound")).alias(name))
    return rows.select(name, F.col("block").alias("name"))


def align(recordings: DataFrame, id_col: str, samples_col: str, audio: Audio, query_step: int = QUERY_STEP) -> tuple[DataFrame, DataFrame]:
    """(members: id, class_id), (matches: query_class, match_class, offset, votes, bit_error).

    Queries are the classes that hold an id divisible by query_step; all classes are searched.
    """
    prints = materialize(fingerprints(recordings, id_col, samples_col, audio), "prints")
    some = prints.where("size(print) > 0")
    classes = some.groupBy("print").agg(F.min("id").alias("class_id"), F.max((F.col("id") % query_step == 0)).alias("asked"), F.first("sound").alias("sound"))
    classes = materialize(classes, "classes")
    members = prints.select("id", "print").join(classes.select("print", "class_id"), "print", "left").select("id", F.coalesce("class_id", "id").alias("class_id"))
    tasks = 4 * classes.sparkSession.sparkContext.defaultParallelism
    blocks = materialize(_blocks(classes, "classes"), "blocks").repartition(tasks)
    # A stated set of queries against all rows, in blocks.
    pairs = blocks.crossJoin(materialize(_blocks(classes.where("asked"), "asked").drop("name"), "asked"))
    return members, pairs.select("asked", "classes", "name").mapInArrow(_compare, "query_class long, match_class long, offset int, votes long, bit_error double")
