"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Items that a fold gathers before it goes on with an empty list.
STEP = 256
#: Code points of the blocks that texts are cut from.
BLOCK = 4096
#: Bytes of rows that go to a worker at one time. Spark's own 64 MB hold 10,000 texts, whose buffers grow by doubling.
BATCH_BYTES = 4 << 20
#: In a worker: how the operator whose tasks it runs forgets what it remembers, by the operator's module.
_AT_WORK: dict[str, Callable[[], None]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session has none (tests, a laptop) a temporary one is set.
    """
    own = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not own:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        own = "file://" + tempfile.mkdtemp(prefix="gristmill-")
        spark.sparkContext.setCheckpointDir(own)
    return own.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read the table back.

    A lost executor then costs at most the tasks it was running; what was
    written stays. While it is written, workers get rows in batches of
    ``BATCH_BYTES``, or of fewer bytes where the session says so.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with batches_of(spark, BATCH_BYTES):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


@contextlib.contextmanager
def batches_of(spark: SparkSession, most: int) -> Iterator[None]:
    """Batches for workers have at most about ``most`` bytes in what runs meanwhile."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    n = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before)
    if 0 < n <= most:
        yield
        return
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def settle(spark: SparkSession) -> None:
    """Each executor collects its garbage and gives free heap back to the system.

    Without this a heap stays as large as it ever was. A task for each executor;
    one that is busy and gets none keeps its garbage, and nothing else changes.
    """
    n = max(1, spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() - 1)  # the driver is one of them
    spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).collect()


def discard(df: DataFrame) -> None:
    """Removes a table that ``materialize`` wrote and that nothing reads any more."""
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._written)
    path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def picked(df: DataFrame, **columns: str) -> DataFrame:
    """``new=old`` columns only, so columns of other names can't clash with an operator's own."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def is_small(df: DataFrame, most: int) -> bool:
    """Whether df has at most ``most`` rows, for a broadcast that is checked."""
    return df.limit(most + 1).count() <= most


def none_of(kind: str) -> Column:
    """An empty array."""
    return F.array().cast(f"array<{kind}>")


def fold(items: Column, zero: Column, step, kind: str) -> Column:
    """What step(state, item) -> (state, array of what to put out) puts out along the items, as one array.

    An array that grows is copied at each step, so it grows to ``STEP`` items only.
    """
    last = F.greatest(F.ceil(F.size(items) / STEP) - 1, F.lit(0)).cast("int")
    steps = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(items, k * STEP + 1, F.lit(STEP)))

    def each(acc: Column, x: Column) -> Column:
        state, out = step(acc["state"], x)
        return F.struct(state.alias("state"), F.concat(acc["out"], out).alias("out"))

    def some(acc: Column, own: Column) -> Column:
        done = F.aggregate(own, F.struct(acc["state"].alias("state"), none_of(kind).alias("out")), each)
        return F.transform(F.array(done), lambda d: F.struct(d["state"].alias("state"), F.concat(acc["out"], F.array(d["out"])).alias("out")))[0]

    return F.aggregate(steps, F.struct(zero.alias("state"), none_of(f"array<{kind}>").alias("out")), some, lambda acc: F.flatten(acc["out"]))


def in_blocks(text: Column) -> Column:
    """The text in pieces of ``BLOCK`` code points, to cut from."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), 0)


def cut(blocks: Column, a: Column, b: Column) -> Column:
    """Code points a to b (exclusive) of a text in blocks; a substring of a long text would be counted off from its start."""
    some = F.when(b > a, F.sequence(F.floor(a / BLOCK).cast("int"), F.floor((b - 1) / BLOCK).cast("int"))).otherwise(none_of("int"))

    def one(k: Column) -> Column:
        start = F.greatest(a - k * BLOCK, F.lit(0))
        return F.substring(F.get(blocks, k), start + 1, F.least(b - k * BLOCK, F.lit(BLOCK)) - start)

    return F.array_join(F.transform(some, one), "")


def slices(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``rows`` rows: bounds what is built from one at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def trim() -> None:
    """Gives back to the system what is free inside this process."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def turn_to(forget: Callable[[], None]) -> None:
    """A worker remembers words for one operator at a time: what others remember goes when a task of this one begins."""
    if forget.__module__ in _AT_WORK:
        return
    for other in _AT_WORK.values():
        other()
    _AT_WORK.clear()
    _AT_WORK[forget.__module__] = forget
    trim()


def in_turn(forget: Callable[[], None], run):
    """The task ``run`` of an operator that remembers what ``forget``, a function of its module, drops."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to(forget)
        try:
            yield from run(batches)
        finally:
            trim()

    return task


def batch(columns: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c := columns[f.name], pa.Array) else pa.array(c, f.type) for f in schema], schema=schema)
