"""Query op11_alignment: operator 11 over all documents."""

from pyspark.sql import DataFrame, SparkSession

from perilune.llm.alignment import align, default_vocabularies
from perilune.llm.common import table


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"), default_vocabularies())


SQL = None
