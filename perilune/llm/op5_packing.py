"""Query op5_packing: operator 5 over all documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perilune.llm.common import table
from perilune.llm.packing import default_tokenizer, pack, tokenize


def packed_digest(docs: DataFrame) -> DataFrame:
    """The ids are digested where they are read, so only narrow rows are joined with the plan."""
    pieces = tokenize(docs, default_tokenizer()).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digest(table(spark, sf_dir, "documents"))


SQL = None
