"""Query op2_quality_rules: operator 2 over all documents."""

from pyspark.sql import DataFrame, SparkSession

from perilune.llm.common import table
from perilune.llm.quality_rules import quality_rules


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


SQL = None
