"""A corpus pipeline of five stages over ``documents``: each stage reads what its predecessor wrote.

Odd inputs: documents without a letter, null and empty texts among them, go with the first stage. Null ids, labels,
sources and languages stay as they are; a null id is larger than others where the least one names a class. Rows that are
alike in every column are one document to near-duplicate detection, like other copies. Very long texts are read whole. Columns
beside those of documents are carried up to packing. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trailgrid.llm import langid, mixing, neardup, packing, toxicity
from trailgrid.llm.common import drop_written, made, table
from trailgrid.llm.tokens import tokenizer_path
from trailgrid.storage import delete, fresh


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    return langid.accepted(docs)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return neardup.deduplicated(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix of sources takes it."""
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All ids in sequences of at most 2048."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), end_id=1, window=2048)


STAGES = [("language_id", language), ("toxicity", toxic), ("near_duplicates", near_duplicates), ("mixing", mixture), ("packing", packed)]

#: Trained models, order MinHash and tokenizers have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written as Parquet in the shared folder and read again."""
    docs, last = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        before, path = made(), fresh(spark, f"pipeline-{k}-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        drop_written(spark, before)  # what the stage needed on its way
        if last:
            delete(spark, last)
        last = path
    return docs
