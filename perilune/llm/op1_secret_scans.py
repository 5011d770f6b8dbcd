"""Query op1_secret_scans: the digest columns of operator 1 over all documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perilune.llm.common import table
from perilune.llm.secrets import BASE, find_secrets


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    kinds = [r.kind for r in BASE]
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in kinds),
        F.sha2(joined(F.filter("spans", lambda x: x["kind"].isin(*kinds))), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


SQL = None
