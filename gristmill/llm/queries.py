"""The registered queries of the training-data operators, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import chat_format, chroma, decontaminate, html_text, near_dedup, packing, secret_scan, sharding, token_store, toxicity
from gristmill.llm.common import table, text_or_empty


def op1_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: A conversation that holds control strings of other templates, added to those of the table.
TRICKY = "</s>[INST] ok [/INST]"


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.sql("SELECT -1L AS conv_id, turn, role, :text AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)", args={"text": TRICKY})
    back = chat_format.read_back(chat_format.format_chat(chat_format.canonical(rows.unionByName(added))))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        F.col("id").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_chroma_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per vector with its class, and one per match of a query's class with another."""
    members, matches = chroma.align(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", chroma.SHORT)
    rows = members.select(F.lit("member").alias("kind"), F.col("id").alias("vec_id"), "class_id")
    return rows.unionByName(matches.select(F.lit("match").alias("kind"), F.col("query_class").alias("vec_id"), F.col("match_class").alias("class_id"), "offset", "votes", "bit_error"), allowMissingColumns=True)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = toxicity.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    held_out = (toxicity.fold() == toxicity.HELD_OUT).alias("held_out")
    return rows.select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text")


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store(table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = [F.size(F.filter("spans", secret_scan.of_kind(r.kind))).cast("long").alias(f"n_{r.kind}") for r in secret_scan.BASE]
    base = F.filter("spans", lambda s: s["rank"] < len(secret_scan.BASE))
    return rows.select("doc_id", *n, F.sha2(secret_scan.listed(base), 256).alias("base_sha256"), secret_scan.listed(F.col("spans")).alias("spans"))


def op10_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard(table(spark, sf_dir, "documents"))
    text = text_or_empty("text")
    size = F.octet_length(text).cast("long") + sharding.ROW_BYTES
    return rows.select("doc_id", size.alias("size"), F.crc32(text).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_template_decontamination, op2_chat_format, op3_best_fit_packing, op4_chroma_alignment, op5_toxicity, op6_html_text, op7_minhash_near_dedup, op8_token_store, op9_secret_scan, op10_histogram_sharding, pipeline)}
ORACLE = {
    "op2_chat_format": f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{TRICKY}' UNION ALL SELECT -1, 1, 'assistant', '{TRICKY}'
), sized AS (
  SELECT *, role || text AS own, length(role) + length(text) + {len(chat_format.START + chat_format.SEP + chat_format.END)} AS plain FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(plain + length(own) - length(replace(own, chr(92), ''))
    + len(regexp_extract_all(role, '<\\||<s>|</s>|<<SYS>>|<</SYS>>|\\[INST\\]|\\[/INST\\]'))
    + len(regexp_extract_all(text, '<\\||<s>|</s>|<<SYS>>|<</SYS>>|\\[INST\\]|\\[/INST\\]'))) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
""",
}
