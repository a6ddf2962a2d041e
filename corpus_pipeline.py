"""From raw documents to packed sequences: quality, lines, near copies, mixture, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which ``run`` writes as
Parquet and reads again as the next stage's documents. All but the last keep the columns
of ``documents``; the mixture adds ``mix_position``, by which the last packs.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm import lines, mixing, neardup, packing, quality
from tallyhouse.llm.common import SPACE, checkpoint_folder
from tallyhouse.llm.queries import PACK_TOKENIZER, TARGETS


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that nearly equal an earlier one go, and documents of which no word is left."""
    cleaned = lines.deduplicate_lines(docs)
    counted = cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return counted.filter(F.col("text").rlike(f"[^{SPACE}]"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return neardup.keep_one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, stored in the order of the mixture, with their places in it."""
    return mixing.in_mixture_order(docs, TARGETS, position="mix_position")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequence and place of every piece; sequences in their order follow the mixture."""
    return packing.pack_documents(docs, public_tokenizers.path(PACK_TOKENIZER), order="mix_position")


STAGES = [
    ("quality rules", keep_good),
    ("line dedup", drop_repeated_lines),
    ("minhash near-dedup", drop_near_copies),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack),
]

# The packing heuristic and the hashes of bands and tokens have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``.

    Each stage's result is a table of its own in the shared checkpoint folder, under a name
    new to each run; the folder's owner clears old runs.
    """
    folder = f"{checkpoint_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if number + 1 == len(STAGES):
            return out
        out.write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
