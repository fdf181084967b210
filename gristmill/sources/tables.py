"""Sources and sinks: readers, materialisation strategies, availability."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.plans.model import Registry

STRATEGIES = ("full", "snapshot", "snapshot_partition", "incremental_time", "view", "external")


def parquet_folder(spark: SparkSession, folder: str) -> Callable[[str], DataFrame]:
    """Reads table t from folder/t.parquet."""
    return lambda name: spark.read.parquet(f"{folder}/{name}.parquet")


def catalog(spark: SparkSession) -> Callable[[str], DataFrame]:
    """Reads tables and views that the session knows."""
    return spark.table


def jdbc(spark: SparkSession, url: str, **options) -> Callable[[str], DataFrame]:
    """Reads tables of a database by JDBC; predicates and columns are pushed down by Spark."""
    return lambda name: spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()


def write(df: DataFrame, target: str, strategy: str = "full", partition_by: Iterable[str] = (), run: str | None = None) -> DataFrame:
    """Refreshes a target by a strategy and returns it as it is now.

    full: replaced. snapshot: a folder of its own per run. snapshot_partition: one
    partition ``snapshot=run`` per run, replaced if it is there. incremental_time:
    only the partitions that df has rows of are replaced. view: a temporary view.
    external: the target is there already.
    """
    spark, keys = df.sparkSession, [*partition_by]
    if strategy == "view":
        df.createOrReplaceTempView(target)
        return spark.table(target)
    if strategy == "external":
        return spark.read.parquet(target)
    if strategy in ("snapshot", "snapshot_partition") and not run:
        raise ValueError("a snapshot needs the name of its run")
    if strategy == "snapshot":
        target = f"{target}/{run}"
    if strategy == "snapshot_partition":
        df, keys = df.withColumn("snapshot", F.lit(run)), ["snapshot", *keys]
    if strategy == "incremental_time" and not keys:
        raise ValueError("an incremental target needs partition columns")
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    out = df.write.mode("overwrite").partitionBy(*keys)
    if strategy in ("snapshot_partition", "incremental_time"):
        out = out.option("partitionOverwriteMode", "dynamic")
    out.parquet(target)
    return spark.read.parquet(target)


def publish(df: DataFrame, name: str, version: str) -> tuple[str, str]:
    """A table as two views: one of its version, which stays as it is, and one of its name, which moves to the newest."""
    versioned = f"{name}_v{version}".replace(".", "_")
    df.createOrReplaceTempView(versioned)
    df.sparkSession.table(versioned).createOrReplaceTempView(name)
    return versioned, name


def reflect(registry: Registry, read: Callable[[str], DataFrame], tables: Iterable[str]) -> dict[str, dict[str, str]]:
    """Registers tables or views as sources, with the columns and types that they have."""
    out = {}
    for t in tables:
        own = read(t)
        registry.source(t.replace(".", "_"), t, columns=tuple(own.dtypes))
        out[t] = dict(own.dtypes)
    return out


def period_filter(column: Column, logical_time: str, lookback: str | None = None, fmt: str = "yyyyMMdd", kind: str = "int") -> Column:
    """Rows of the run's period, or of the periods from the look-back interval up to it."""
    now = F.expr(f"TIMESTAMP '{logical_time}'")
    at = lambda t: F.date_format(t, fmt).cast(kind)
    return column == at(now) if lookback is None else column.between(at(now - F.expr(f"INTERVAL {lookback}")), at(now))


def backfill(build: Callable[[str], DataFrame], times: Iterable[str], target: str, partition_by: Iterable[str]) -> DataFrame | None:
    """Runs an incremental materialisation for each logical time, oldest first."""
    out = None
    for t in sorted(times):
        out = write(build(t), target, "incremental_time", partition_by)
    return out


@dataclass
class Availability:
    """What of a table is there: bounds of its temporal partition, and by categorical partition values (None: any)."""

    table: str
    low: tuple = ()
    high: tuple = ()
    partitions: dict[tuple, tuple[tuple, tuple]] = field(default_factory=dict)

    def merge(self, other: Availability) -> Availability:
        """Both together; a partition already covered by a wider one with None in its place is dropped."""
        if self.table != other.table:
            return other
        parts = dict(self.partitions)
        for k, (low, high) in other.partitions.items():
            have = parts.get(k, (low, high))
            parts[k] = (min(have[0], low), max(have[1], high))
        wide = lambda a, b: a != b and all(x is None or x == y for x, y in zip(a, b, strict=True)) and parts[a][0] <= parts[b][0] and parts[a][1] >= parts[b][1]
        parts = {k: v for k, v in parts.items() if not any(wide(a, k) for a in parts)}
        return Availability(self.table, min(filter(None, (self.low, other.low)), default=()), max(filter(None, (self.high, other.high)), default=()), parts)

    def covers(self, low: tuple, high: tuple) -> bool:
        return bool(self.low) and self.low <= low and high <= self.high


def scan_bytes(df: DataFrame) -> int:
    """Spark's estimate of the bytes a plan reads."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
