"""Relational operators that a bare method call doesn't give."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def combine(frames: Iterable[DataFrame], keys: list[str]) -> DataFrame:
    """Full outer combination of tables that each have one row per key: one shuffle, and null keys meet."""
    frames = [*frames]
    df = frames[0]
    for f in frames[1:]:
        df = df.unionByName(f, allowMissingColumns=True)
    return df.groupBy(*keys).agg(*[F.first(c, ignorenulls=True).alias(c) for c in df.columns if c not in keys])


def asof(left: DataFrame, right: DataFrame, on: list[str], time: str, right_time: str, columns: list[str], bucket: Callable[[Column], Column] | None = None) -> DataFrame:
    """The latest row of right at or before each row of left, by keys: a union and one window, no theta join.

    Of right rows at one time, that with the greatest columns counts. Keys that are null match nothing.

    bucket: a function of the time that never falls, such as its day. With it a
    key's rows are sorted bucket by bucket, each in a task of its own, so a hot
    key is no task's burden; what earlier buckets end with is carried over from
    one row a key and bucket.
    """
    value = F.struct(*[F.col(c) for c in columns])
    a = left.select(F.struct("*").alias("row"), *on, F.col(time).alias("t"), F.lit(1).alias("side"), F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType).alias("v"))
    b = right.select(F.lit(None).cast(left.select(F.struct("*").alias("r")).schema["r"].dataType).alias("row"), *on, F.col(right_time).alias("t"), F.lit(0).alias("side"), value.alias("v"))
    rows, within = a.unionByName(b), []
    if bucket is not None:
        rows, within = rows.withColumn("_bucket", bucket(F.col("t"))), ["_bucket"]
    w = Window.partitionBy(*on, *within).orderBy("t", "side", "v").rowsBetween(Window.unboundedPreceding, 0)
    known = rows.withColumn("v", F.last("v", ignorenulls=True).over(w)).where("side = 1")
    if bucket is not None:
        last = rows.groupBy(*on, "_bucket").agg(F.max(F.when(F.col("side") == 0, F.struct("t", "v"))).alias("_last"))
        before = Window.partitionBy(*on).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        last = last.select(*[F.col(k).alias(f"_{k}") for k in on], F.col("_bucket").alias("_of"), F.last("_last", ignorenulls=True).over(before)["v"].alias("_carried"))
        meets = [F.col(k) == F.col(f"_{k}") for k in on] + [F.col("_bucket").eqNullSafe(F.col("_of"))]
        known = known.join(last, meets, "left").withColumn("v", F.coalesce("v", "_carried"))
    there = F.lit(True)
    for k in on:
        there = there & F.col(k).isNotNull()
    return known.withColumn("v", F.when(there, F.col("v"))).select("row.*", *[F.col("v")[c].alias(c) for c in columns])


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Points within [low, high): an equality join on bins of ``width``, then the exact test.

    Ranges are put into each bin they touch, so width should be near their usual length.
    """
    bins = lambda c: F.floor(F.col(c) / width)
    b = ranges.withColumn("_bin", F.explode(F.sequence(bins(low), bins(high))))
    return points.withColumn("_bin", bins(point)).join(b, "_bin").where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("_bin")


def skewed_join(left: DataFrame, right: DataFrame, on: list[str], salts: int, how: str = "inner") -> DataFrame:
    """An equality join with hot keys of left dealt over ``salts`` tasks; right is repeated as often. For inner and left joins.

    The salt goes by the row's place, so equal rows are spread as well.
    """
    if how not in ("inner", "left"):
        raise ValueError("salting repeats the right side, so only inner and left joins are right")
    a = left.withColumn("_salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)).cast("int"))
    b = right.withColumn("_salt", F.explode(F.array(*map(F.lit, range(salts)))))
    return a.join(b, [*on, "_salt"], how).drop("_salt")


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group; ties are broken by the order given."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def pipe(df: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    for step in steps:
        df = df.transform(step)
    return df
