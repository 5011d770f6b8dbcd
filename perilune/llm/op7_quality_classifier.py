"""Query op7_quality_classifier: operator 7 over all documents."""

from pyspark.sql import DataFrame, SparkSession

from perilune.llm.classifier import score_quality, train
from perilune.llm.common import table


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, train(docs, table(spark, sf_dir, "labels")))


SQL = None
