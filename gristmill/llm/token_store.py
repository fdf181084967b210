"""Token ids in binary files, compressed a document at a time with a shared dictionary.

File format, all numbers little-endian::

    magic "GRISTTOK" | frames, one zstandard frame a document, in ascending id order
    index: doc_id int64[n] | offset of each frame uint64[n + 1] | ids of each document uint32[n]
    trailer: position of the index uint64 | n uint64 | SHA-256 of the dictionary (32 bytes) | width uint64 | "GRISTEND"

A frame holds the document's ids in ``width`` bytes each. A short document is
read with the trailer, the index and its own frame only (``read_document``). A
reader refuses a file whose dictionary hash isn't that of the dictionary given.

The dictionary is trained on the serialized ids of ``SAMPLE`` documents, those of
least hash of id and text over the whole table; it only sets how well frames are
compressed, and every document is written whole. Texts are dealt once, by ranges
of id, hash of the text and place of the row, so no id is too large for a task.
Ids are encoded straight into the width they are stored in.
Tasks write files of unique names through Arrow's file systems, straight to the
shared folder; the manifest, itself a table, names those of the tasks that Spark
accepted, so a lost executor or a second attempt leaves at most an unread file.
Its rows, one a file, go through the driver into one part, and a task reads files
of about ``READ_TOKENS`` ids: on a local disk Hadoop may start a program for each
part that a task writes, which shares the executor's memory until it runs.

Defined results: a null or empty text has the end id only. Repeated rows are
written each, ties in id ordered by the text's hash. Null ids come first, written as the
least 64-bit number. An empty table makes no file and no row.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.common import batch, materialize, picked, shared_dir, slices
from gristmill.llm.tokens import encoder, vocabulary

MAGIC, LAST = b"GRISTTOK", b"GRISTEND"
END_ID = 1
SAMPLE = 512
DICTIONARY_BYTES = 65_536
LEVEL = 3
NO_ID = -(1 << 63)
#: Ids in the files that a task reads back, one file at least.
READ_TOKENS = 2_000_000
_TRAILER = struct.Struct("<QQ32sQ8s")
_MANIFEST = pa.schema([("file", pa.string()), ("first_id", pa.int64()), ("part", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("dictionary", pa.string())])
_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def train(samples: list[bytes]) -> bytes:
    """A zstandard dictionary; where there is too little to train on, the samples themselves."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:DICTIONARY_BYTES]


class Writer:
    def __init__(self, out, dictionary: bytes, width: int):
        import zstandard

        self._out, self._dictionary, self._width = out, dictionary, width
        self._zstd = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        self._ids, self._offsets, self._sizes = [], [len(MAGIC)], []
        out.write(MAGIC)

    def add(self, doc_id: int, ids: bytes) -> None:
        """ids: in the file's width."""
        frame = self._zstd.compress(ids)
        self._out.write(frame)
        self._ids.append(doc_id)
        self._offsets.append(self._offsets[-1] + len(frame))
        self._sizes.append(len(ids) // self._width)

    def close(self) -> int:
        """Writes index and trailer; returns the number of ids."""
        for x, kind in ((self._ids, "<i8"), (self._offsets, "<u8"), (self._sizes, "<u4")):
            self._out.write(np.array(x, kind).tobytes())
        self._out.write(_TRAILER.pack(self._offsets[-1], len(self._ids), hashlib.sha256(self._dictionary).digest(), self._width, LAST))
        return sum(self._sizes)


class Reader:
    """Random access to one file; holds its index only."""

    def __init__(self, file, dictionary: bytes):
        import zstandard

        self._file, size = file, file.size()
        file.seek(size - _TRAILER.size)
        at, n, digest, self._width, last = _TRAILER.unpack(file.read(_TRAILER.size))
        if last != LAST:
            raise ValueError("not a token file, or cut short")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError("the file was written with another dictionary")
        file.seek(at)
        index = file.read(size - _TRAILER.size - at)
        self.doc_ids = np.frombuffer(index, "<i8", n)
        self._offsets = np.frombuffer(index, "<u8", n + 1, 8 * n)
        self.sizes = np.frombuffer(index, "<u4", n, 16 * n + 8)
        self._zstd = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def ids(self, k: int) -> np.ndarray:
        """The ids of the file's k-th document."""
        self._file.seek(int(self._offsets[k]))
        raw = self._zstd.decompress(self._file.read(int(self._offsets[k + 1] - self._offsets[k])), max_output_size=max(1, int(self.sizes[k]) * self._width))
        return np.frombuffer(raw, f"<u{self._width}").astype("<u4")


def read_document(uri: str, doc_id: int, dictionary: bytes) -> np.ndarray:
    """One document's ids: the first of that id in the file."""
    system, path = fs.FileSystem.from_uri(uri)
    with system.open_input_file(path) as f:
        r = Reader(f, dictionary)
        k = int(np.searchsorted(r.doc_ids, doc_id))
        if k == len(r.doc_ids) or r.doc_ids[k] != doc_id:
            raise KeyError(doc_id)
        return r.ids(k)


def write_tokens(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID, width: int | None = None) -> tuple[DataFrame, bytes]:
    """Writes the files and the dictionary below ``folder``; returns the manifest and the dictionary.

    width: bytes an id is stored in; by itself 2 for vocabularies of up to 65,536 ids, else 4.
    """
    path = tokenizer or vocabulary()
    encode = encoder(path, width)
    width, end = encode.width, encode.end(end_id)
    docs = picked(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    least = [r[0] for r in docs.select(F.xxhash64("doc_id", "h").alias("least")).orderBy("least").limit(SAMPLE).collect()]
    sample = docs.where(F.xxhash64("doc_id", "h") <= least[-1]).select("text").limit(SAMPLE).collect() if least else []
    dictionary = train([ids + end for ids in encode.encode_all(r[0] for r in sample)])
    digest = hashlib.sha256(dictionary).hexdigest()
    system, at = fs.FileSystem.from_uri(folder)
    system.create_dir(at, recursive=True)
    with system.open_output_stream(f"{at}/{digest}.dictionary") as f:
        f.write(dictionary)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encode, writer, n = TaskContext.get().partitionId(), encoder(path, width).encode_all, None, 0
        name = f"part-{part:06d}-{uuid.uuid4().hex}.tok"
        for b in slices(batches, 1000):
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), encode(b.column("text").to_pylist()), strict=True):
                if writer is None:
                    system, at = fs.FileSystem.from_uri(folder)
                    out, first = system.open_output_stream(f"{at}/{name}"), doc_id
                    writer = Writer(out, dictionary, width)
                writer.add(doc_id, ids + end)
                n += 1
        if writer is not None:
            tokens = writer.close()
            out.close()
            yield batch({"file": [f"{folder}/{name}"], "first_id": [first], "part": [part], "n_docs": [n], "n_tokens": [tokens], "dictionary": [digest]}, _MANIFEST)

    order = ("doc_id", "h", "place")
    dealt = docs.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    manifest = dealt.select("doc_id", "text").mapInArrow(write, "file string, first_id long, part int, n_docs long, n_tokens long, dictionary string")
    # A row a file: nothing of a task is kept on an executor, so a lost one repeats only what it was running.
    rows = manifest.toArrow()
    return materialize(docs.sparkSession.createDataFrame(rows, manifest.schema).coalesce(1), "manifest"), dictionary


def read_tokens(manifest: DataFrame, dictionary: bytes) -> DataFrame:
    """Reads all files back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    # One row a file, so this window is small: it is the number of files that one task orders.
    start = F.sum("n_tokens").over(Window.orderBy("first_id", "part").rowsBetween(Window.unboundedPreceding, -1))
    files = materialize(manifest.select("file", F.coalesce(start, F.lit(0)).alias("start")), "files")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, start in zip(b.column("file").to_pylist(), b.column("start").to_pylist(), strict=True):
                system, path = fs.FileSystem.from_uri(uri)
                with system.open_input_file(path) as f:
                    r = Reader(f, dictionary)
                    starts = start + np.cumsum(r.sizes, dtype=np.int64) - r.sizes
                    for at in range(0, len(r.doc_ids), 10_000):
                        own = range(at, min(at + 10_000, len(r.doc_ids)))
                        crc = [zlib.crc32(r.ids(k)) for k in own]
                        s = slice(own.start, own.stop)
                        ids = pa.array(r.doc_ids[s], mask=r.doc_ids[s] == NO_ID)
                        yield batch({"doc_id": ids, "start": starts[s], "n_tokens": r.sizes[s].astype(np.int64), "ids_crc32": crc}, _READ)

    n, tokens = manifest.agg(F.count("*"), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    spread = files.repartition(max(1, min(n, -(-tokens // READ_TOKENS))))
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def store(docs: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Writes, then reads back."""
    return read_tokens(*write_tokens(docs, folder or f"{shared_dir(docs.sparkSession)}/token-store-{uuid.uuid4().hex}", **options))
