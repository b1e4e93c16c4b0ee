"""From raw documents to sampled segmentations: five stages, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from playbill.llm.common import Workspace
from playbill.llm.exact_dedup import drop_exact_duplicates
from playbill.llm.mixing import TARGET_WEIGHTS, mix_sources
from playbill.llm.sentencepiece_ops import default_model, encode
from playbill.llm.simhash import drop_near_duplicates
from playbill.llm.toxicity import drop_toxic, held_out


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of toxicity under 0.5, by a model of the labels that op6 may learn too.

    Null and empty texts score 0 and stay; repeated rows stay or go alike; of an empty table none stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out(F.col("doc_id")))
    return drop_toxic(docs, labels)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document of smallest id, null after all others; null texts are empty ones; repeated rows of it all stay."""
    return drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that similarity 0.8 of five-word shingles links, the document of smallest id.

    Texts without words are one group; a text of fewer than five words is one shingle; repeated rows of the document
    that stays all stay.
    """
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight asks, in random order; a null source has the default weight,
    a null text counts one byte, rows of equal ids are copied equally often."""
    return mix_sources(docs, TARGET_WEIGHTS).select("row.*")


def segmentation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of each document. Copies of one are numbered, so that each is segmented anew; null and empty
    texts have one segmentation, of no pieces."""
    copy = F.row_number().over(W.partitionBy("doc_id", F.md5("text")).orderBy(F.lit(0)))
    return encode(docs.withColumn("copy_no", copy), default_model(), stream=F.col("copy_no")).withColumn("n_pieces", F.size("ids"))


STAGES = [("toxicity", toxicity), ("exact", exact), ("near", near), ("mixing", mixing), ("segmentation", segmentation)]

#: SQL expresses neither the trained model nor the sampled segmentations.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents, each written and read again."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = ws.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
