"""A training-data pipeline over ``documents``: rejects, near copies, repeated passages, packing."""

from __future__ import annotations

import public_tokenizers as public
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm import common, near_copies as similar, packing, paragraphs, quality, simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, by SimHash and then by similarity 0.8 of five-word shingles, the document with the
    smallest id stays."""
    return similar.keep_first(common.stage(simhash.keep_first(docs), "simhash-kept")).select(*COLUMNS)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that earlier documents hold are cut out; ``n_chars`` follows the text."""
    out = paragraphs.remove_repeats(docs, within_lines=True)
    return out.withColumn("n_chars", F.when(F.size("removed_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed sequences, as pieces of documents."""
    pieces = packing.pack(docs, public.path("word_bpe_49k.json"))
    return packing.with_crc(pieces).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source")


STAGES = [("quality classifier", classify), ("SimHash near-dedup", near_copies), ("substring dedup", passages), ("packing", pack)]

#: SQL has neither the classifier nor XXH64; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.stage(docs, name.replace(" ", "-"))
    return docs
