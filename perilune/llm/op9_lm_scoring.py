"""Query op9_lm_scoring: operator 9 over all documents, learnt from those outside the held-out seventh."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perilune.llm.common import table
from perilune.llm.lm_scoring import is_training, learn, score_texts


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_texts(docs, *learn(docs.where(is_training(F.col("doc_id")))))


SQL = None
