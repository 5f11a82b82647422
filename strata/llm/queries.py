"""The thin queries of the training-data operators: whole tables in, the contract's digest columns out."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import decontam, langid, lines, minhash, packing, phrases, preference, quality, spelling, suffix, topk, toxicity, warc
from strata.llm.common import stage, table
from strata.llm.oracles import ORACLE_SQL  # noqa: F401


def bucket(of: int):
    """crc32 of the doc_id as text, modulo `of`."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % of


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    langs, model = langid.train(docs.where(bucket(3) != 1))
    return langid.identify(docs, langs, model).select("doc_id", (bucket(3) == 1).alias("held_out"), "lang_pred", "score")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, manifest = warc.write_archives(table(spark, sf_dir, "pages"))
    found = warc.read_archives(spark, folder, manifest)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10, scale=1024)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = stage(quality.document_statistics(table(spark, sf_dir, "documents")), "statistics")
    labels = table(spark, sf_dir, "labels").where(bucket(5) != 0).select("doc_id", F.col("quality").alias("label"))
    found = quality.score(stats, quality.fit(stats, labels))
    return found.select("doc_id", (bucket(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(bucket(5) != 0).select("doc_id", F.col("toxic").alias("label"))
    found = toxicity.score(docs, toxicity.build_index(docs, labels))
    return found.select("doc_id", (bucket(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def tokenizer() -> str:
    """The public tokenizer's file: of the installed package, unless STRATA_TOKENIZER names another place."""
    if at := os.environ.get("STRATA_TOKENIZER"):
        return at
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer())


def op10_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = preference.format_preferences(table(spark, sf_dir, "conversations"))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")
    return found.withColumns({c: spans(c) for c in ("chosen_mask", "rejected_mask")})


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.drop_repeated_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_language_id": op2_language_id,
    "op3_warc": op3_warc,
    "op4_bit_sliced_top_k": op4_bit_sliced_top_k,
    "op5_decontaminate": op5_decontaminate,
    "op6_quality": op6_quality,
    "op7_toxicity": op7_toxicity,
    "op8_suffix_array_dedup": op8_suffix_array_dedup,
    "op9_pack": op9_pack,
    "op10_preference_format": op10_preference_format,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_line_dedup": op12_line_dedup,
    "op13_collocations": op13_collocations,
}
