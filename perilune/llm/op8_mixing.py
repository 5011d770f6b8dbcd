"""Query op8_mixing: operator 8 over all documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perilune.llm.common import table
from perilune.llm.mixing import mix_sources


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("copies")).cast("long").alias("taken"))


SQL = None
