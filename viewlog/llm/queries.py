"""The registered queries of this package."""

from __future__ import annotations

from pyspark.sql import functions as F

from viewlog.llm import (
    conversations,
    decontaminate,
    hilbert_search,
    html_text,
    line_dedup,
    merkle,
    near_dedup,
    packing,
    pii,
    quality_model,
    quality_rules,
    substring_dedup,
    toxicity,
)
from viewlog.llm.registry import ORACLES, QUERIES, query, table

__all__ = ["ORACLES", "QUERIES"]


@query("op5_quality_rules", quality_rules.ORACLE_SQL)
def op5(spark, sf_dir):
    judged = quality_rules.judge_documents(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", *quality_rules.BASE, "base_failed", "kept")


@query("op7_line_dedup", line_dedup.ORACLE_SQL)
def op7(spark, sf_dir):
    marked = line_dedup.mark_lines(table(spark, sf_dir, "documents"))
    digest = F.sha2(F.coalesce("kept_text", F.lit("")), 256)
    return marked.select("doc.doc_id", "n_lines", "n_removed", digest.alias("kept_sha256"))


@query("op6_benchmark_decontamination", decontaminate.ORACLE_SQL)
def op6(spark, sf_dir):
    found = decontaminate.find_passages(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"]
    )
    return found.select(
        "doc.doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def tokenizer_path() -> str:
    """The public vocabulary file of the packing query."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op3_packing")
def op3(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path()).drop("ids")


@query("op1_minhash_near_dedup")
def op1(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=4)


@query("op9_toxicity")
def op9(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.score_documents(docs, labels).drop("sentences")


@query("op10_quality_classifier")
def op10(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality_model.score_documents(docs, labels)


@query("op2_substring_dedup")
def op2(spark, sf_dir):
    found = substring_dedup.repeats(table(spark, sf_dir, "documents"), digest=True)
    return found.withColumnRenamed("kept", "kept_sha256")


@query("op8_pii")
def op8(spark, sf_dir):
    found = pii.find_personal_data(table(spark, sf_dir, "documents"), ["doc_id"])

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc.doc_id",
        *map(count, pii.KINDS),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


@query("op4_html_extraction")
def op4(spark, sf_dir):
    found = html_text.extract_text(table(spark, sf_dir, "pages"), ["page_id", "url"])
    return found.select(
        "page.page_id",
        "page.url",
        F.col("main_text").alias("text"),
        F.length("main_text").cast("bigint").alias("n_chars"),
    )


@query("op13_merkle_manifest", merkle.ORACLE_SQL)
def op13(spark, sf_dir):
    return merkle.Manifest(table(spark, sf_dir, "documents")).verified()


@query("op11_conversation_repair", conversations.ORACLE_SQL)
def op11(spark, sf_dir):
    return conversations.repair(table(spark, sf_dir, "conversations"))


@query("op12_nearest_neighbours")
def op12(spark, sf_dir):
    return hilbert_search.Index(table(spark, sf_dir, "embeddings")).search()
