"""A corpus pipeline: each stage works on the documents that the one before it kept.

Stages take (spark, docs, sf_dir). All but the last return the columns of ``docs``: language ID
drops texts without a language, exact dedup and near-duplicate detection keep one document of
each group, decontamination drops documents that hold benchmark passages, and the last stage
encodes what is left. Null texts count as empty and go with the first
stage. Rows that share an id or have none are told apart: of equal rows one stays. An empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import bpe, chosen_path, cross_parse, cuckoo_dedup, decontam
from panelspark.llm.common import documents, held_out
from panelspark.llm.queries import split_pattern, tokenizer_file
from panelspark.session import cut_lineage

#: No SQL: language ID and token ids cannot be stated in it.
ORACLE_SQL = None


def _packed(docs: DataFrame, *extra: str) -> DataFrame:
    """The whole row as one column beside those an operator reads, so that names cannot clash."""
    return docs.select(F.struct(*docs.columns).alias("row"), *extra)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labelled = docs.select("doc_id", "text", "lang").filter(~held_out(F.col("doc_id"), 5, 0))
    judged = cross_parse.identify(_packed(docs, "text"), labelled)
    return judged.filter(F.col("lang_pred") != cross_parse.UNDETERMINED).select("row.*")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return cuckoo_dedup.drop_copies(docs, single=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return chosen_path.drop_near_copies(docs, size=5, percent=80, single=True)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return decontam.scan(_packed(docs, "text"), benchmark).filter(~F.col("contaminated")).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = tokenizer_file("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), path, split_pattern(), offsets=False)
    kept = encoded.withColumn("n_tokens", F.size("ids").cast("bigint")).withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).drop("text")
    decoded = bpe.decode(kept, path)
    return decoded.select("doc_id", "lang", "source", "n_tokens", "ids", (F.sha2("decoded", 256) == F.col("text_sha256")).alias("exact"))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("encode", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut_lineage(docs)
    return docs
