"""The corpus pipeline over `documents`: each stage works on all that its predecessor kept, and its decisions hold.

Stages decide on rows, not on doc_ids: null and repeated doc_ids are rows of their own, and a row goes only for what its
own text is. Null and empty texts have no letter, so the first stage drops them where it has learned a language; texts
of any length are taken whole; an empty table passes as an empty table; columns beside those of documents pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import decontam, langid, minhash, packing, suffix
from strata.llm.common import discard, stage
from strata.llm.queries import tokenizer

#: Below this probability no language is certain enough; real prose stands far above it.
LEAST_LANGUAGE_SCORE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a letter or without a certain language go.

    The languages are those of the rows with a lang; where no row has one (or the table is empty) nothing can be told
    and all rows stay. Equal texts fare equally."""
    langs, model = langid.train(docs)
    if not langs:
        return docs
    names = [f"_c{i}" for i in range(len(docs.columns))]  # lang_pred and score can be columns of docs too
    found = langid.identify(docs.toDF(*names), langs, model, keep=tuple(names), text=names[docs.columns.index("text")])
    stays = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return stays.select(*names).toDF(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group (similarity of 0.8 or more, links reaching on) stays: that with the least
    doc_id, a null doc_id only where there is no other; of equal doc_ids one. Rows without words stay."""
    names = [f"_c{i}" for i in range(len(docs.columns))]  # docs can have columns of any name
    text, doc_id = (names[docs.columns.index(c)] for c in ("text", "doc_id"))
    rows = docs.toDF(*names).withColumn("_row", F.monotonically_increasing_id())
    found = minhash.near_duplicates(rows.select(F.col("_row").alias("doc_id"), F.col(text).alias("text")), percent=80)
    found = found.select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_group"))
    first = F.min(F.struct(F.col(doc_id).isNull(), doc_id, "_row"))
    stays = rows.select("_row", doc_id).join(found, "_row").groupBy("_group").agg(first.alias("x")).select("x._row")
    return rows.join(stays, "_row", "left_semi").select(*names).toDF(*docs.columns)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes and more that repeat leave the texts, all copies of them; the rows stay, even with nothing
    left, with n_chars brought up to date. Null texts stay null."""
    return suffix.without_repeats(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a benchmark window go; texts without words stay, and an empty benchmark drops nothing."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    names = [f"_c{i}" for i in range(len(docs.columns))]
    found = decontam.contamination(docs.toDF(*names), benchmark, keep=tuple(names), text=names[docs.columns.index("text")])
    return found.where("n_hit = 0").select(*names).toDF(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are left, as pieces of packed sequences; each row is a document of its own."""
    return packing.pack(docs, tokenizer())


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("decontaminate", decontaminate),
    ("pack", pack),
]

#: Language prediction and tokens can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents, each result written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for i, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{name}")
            if before is not None:
                discard(before)
            before = docs
    return docs
