"""A corpus pipeline: documents in, packed sequences out. Each stage works on all rows that the one before kept.

Stages: toxic documents go; of near duplicates the first stays; documents that
hold benchmark items go; secrets are masked in the texts; what is left is packed.
Every stage is one operator of ``gristmill.llm`` and a decision taken on it.
Decisions fall on a document's id; a row of a null id is addressed by its text
instead, so it is decontaminated and deduplicated as any other.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import decontaminate, near_dedup, packing, secret_scan, toxicity
from gristmill.llm.common import discard, is_small, materialize, settle, table

REJECT_FROM = 0.5
#: Ids (8 bytes each) up to which they are broadcast to the rows.
MOST_BROADCAST = 500_000


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def settled(stage: Stage) -> Stage:
    """The stage, on executors that don't hold the garbage of those before."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        settle(spark)
        return stage(spark, docs, sf_dir)

    return run


@settled
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled ones among the documents outside the held-out fold; drops scores of 0.5 or more."""
    scored = toxicity.classify(docs.select(F.struct("*").alias("row"), "doc_id", "text"), table(spark, sf_dir, "labels"), learn_from=docs)
    return scored.where(F.col("score") < REJECT_FROM).select("row.*")


def _named(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text): rows of a null id get an id made of their text, far above those of tables."""
    by_text = F.shiftrightunsigned(F.xxhash64("text"), 2).bitwiseOR(F.lit(1 << 62))
    return docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), by_text).alias("doc_id"), "text")


def _without(named: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id isn't among these; few ids go to the rows, many meet them by shuffle."""
    ids = materialize(ids.distinct(), "ids")
    return named.join(F.broadcast(ids) if is_small(ids, MOST_BROADCAST) else ids, "doc_id", "left_anti")


@settled
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each group. Of rows that repeat id and text one stays; other texts of a kept id stay."""
    named = _named(docs)
    left = _without(named, near_dedup.near_duplicates(named).where("not kept").select("doc_id"))
    # Few ids have several rows, if any; only those are compared by text.
    several = materialize(left.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "several")
    if several.isEmpty():
        return left.select("row.*")
    own = F.broadcast(several) if is_small(several, MOST_BROADCAST) else several
    first = left.join(own, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min("row").alias("row"))
    return left.join(own, "doc_id", "left_anti").select("row").union(first.select("row")).select("row.*")


@settled
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of the benchmark."""
    named = _named(docs)
    return _without(named, decontaminate.contaminated(named, table(spark, sf_dir, "benchmark")).select("doc_id")).select("row.*")


@settled
def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces each secret by its kind; the length of the text follows."""
    found = secret_scan.scan(docs)
    text = F.when(F.size("spans") > 0, secret_scan.redact(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    masked = found.withColumn("text", text).withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return masked.select(*docs.columns)


@settled
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("packing", pack),
]
#: Training and hashing can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
