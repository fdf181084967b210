"""The corpus pipeline, stage by stage, against brute force on each stage's own input."""

from __future__ import annotations

import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gristmill.llm import packing
from gristmill.llm.common import table


def test_stages(spark, folder):
    docs = table(spark, folder, "documents")
    items = [r["text"] for r in table(spark, folder, "benchmark").collect()]
    plain = lambda t: " ".join(re.findall(r"[^\W_]+", (t or "").lower()))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = corpus_pipeline.materialize(stage(spark, docs, folder), name)
        after = {r["doc_id"]: r for r in docs.collect()}
        assert docs.columns == table(spark, folder, "documents").columns and set(after) <= set(before) and len(after) == docs.count()
        gone = set(before) - set(after)
        if name == "near_dedup":
            texts = [r["text"] for r in after.values() if r["text"]]
            assert len(texts) == len({" ".join(t.lower().split()) for t in texts})
        if name == "decontamination":
            assert gone == {i for i, r in before.items() if any(plain(x) in plain(r["text"]) for x in items)}
        if name == "secrets":
            assert not gone and not any(re.search("AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}", r["text"] or "") for r in after.values())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(after)
    assert packed.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= packing.CAPACITY


def test_empty_and_null_rows(spark, folder):
    schema = table(spark, folder, "documents").schema
    rows = spark.createDataFrame([(1, None, None, None, None), (None, "x y z", "en", "s", 5), (1, None, None, None, None)], schema)
    for df, n in ((rows.limit(0), 0), (rows, 2)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            df = corpus_pipeline.materialize(stage(spark, df, folder), "edge")
        assert df.count() == n
        assert corpus_pipeline.STAGES[-1][1](spark, df, folder).count() == n


def test_rows_that_share_an_id_or_have_none(spark, folder):
    """Distinct texts of one id stay, copies go, and rows without an id are compared and decontaminated by their text."""
    item = max((r["text"] for r in table(spark, folder, "benchmark").collect()), key=len)
    own = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abcd"}
    long = " ".join(f"long{i}" for i in range(40_000))
    filler = " ".join(f"fill{i}" for i in range(4 * len(item.split())))
    rows = [(1, own["a"]), (1, own["b"]), (1, own["a"]), (None, own["a"]), (None, own["c"]), (None, own["c"]), (2, f"{own['d']} {item}"), (None, f"{item} {filler}"), (3, long), (4, "")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], table(spark, folder, "documents").schema)
    stages = dict(corpus_pipeline.STAGES)
    once = corpus_pipeline.materialize(stages["near_dedup"](spark, df, folder), "once")
    texts = lambda d: sorted((r["doc_id"] or 0, r["text"]) for r in d.collect())
    assert texts(once) == sorted({(i or 0, t) for i, t in rows} - {(0, own["a"])})
    clean = stages["decontamination"](spark, once, folder)
    assert texts(clean) == sorted([(1, own["a"]), (1, own["b"]), (0, own["c"]), (3, long), (4, "")])
    assert clean.columns == df.columns


def test_workers_remember_for_one_stage_at_a_time(spark, folder):
    """Stages share workers; the words that one stage remembers are gone when the next one's tasks begin."""
    docs = table(spark, folder, "documents").repartition(16)

    def held(batches):
        from gristmill.llm import decontaminate, near_dedup, tokens

        for _ in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([bool(near_dedup._HASHES) + bool(decontaminate._TOKENS) + bool(tokens._ENCODERS)], pa.int64())})

    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.format("noop").mode("overwrite").save()
        n = [r["n"] for r in docs.select("doc_id").mapInArrow(held, "n long").collect()]
        assert max(n) <= 1, name


def test_encoding_takes_words_in_pieces(monkeypatch):
    """However few words the library is given at one time, ids are the same."""
    from gristmill.llm import tokens

    text = " ".join(f"Word{i} straße{i}, plain" + "abcdefghij"[i % 10] * (i % 7) + "! Éa" for i in range(300))
    whole = tokens.Encoder(tokens.vocabulary()).encode(text)
    own = tokens.Encoder(tokens.vocabulary())
    given = []
    for name in ("_plain", "_tokenizer"):
        library = getattr(own, name)

        class Seen:
            def encode_batch_fast(self, some, library=library, **options):
                given.append(max(len(some), *(len(x.split(" ")) for x in some)))
                return library.encode_batch_fast(some, **options)

        setattr(own, name, Seen())
    monkeypatch.setattr(tokens, "LEARNED", 7)
    assert own.encode(text) == whole and max(given) <= 7


def test_each_stage_begins_on_heaps_without_garbage(spark, folder):
    """A heap that has grown is given back when a stage begins; without that it stays as large as it ever was."""
    heap = spark._jvm.java.lang.Runtime.getRuntime()
    grown = 2_000_000_000
    for name, stage in corpus_pipeline.STAGES:
        spark.range(1).select(F.octet_length(F.repeat(F.lit("x"), F.col("id").cast("int") + grown))).collect()
        assert heap.totalMemory() > grown
        with pytest.raises(AttributeError):  # no documents: it ends where its own work would begin
            stage(spark, None, folder)
        assert heap.totalMemory() < grown, name


def test_texts_go_to_workers_in_small_batches(spark):
    """Every row arrives, in batches bounded in bytes; the session's own setting comes back."""

    def seen(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64()), "size": pa.array([b.nbytes], pa.int64())})

    key, most = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
    before = spark.conf.get(key)
    texts = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("x"), F.col("id").cast("int") % 7 + 10_000).alias("text"))
    found = corpus_pipeline.materialize(texts.mapInArrow(seen, "n long, size long"), "seen").collect()
    assert sum(r["n"] for r in found) == 3000 and max(r["size"] for r in found) < 1.1 * most
    assert spark.conf.get(key) == before
    spark.conf.set(key, "1m")
    try:
        found = corpus_pipeline.materialize(texts.mapInArrow(seen, "n long, size long"), "seen").collect()
        assert sum(r["n"] for r in found) == 3000 and max(r["size"] for r in found) < 1.1 * (1 << 20) and spark.conf.get(key) == "1m"
    finally:
        spark.conf.set(key, before)
