"""The corpus pipeline: five stages over documents, each on all that its predecessor kept.

1. quality classifier: documents that it rejects go;
2. n-gram Jaccard join: of each group of near duplicates the document with the smallest doc_id stays;
3. secret scans: what the rules find in a text becomes [SECRET];
4. mixing: each source's documents are taken as often as its target says (a document's copies are rows that repeat it);
5. best-fit packing: one row for each piece, with its sequence and place.

Null and empty texts are documents like any other: the classifier scores them, they link with nothing, hold no secrets, add no words
to a mix and are packed as their end alone. Very long texts go through whole and are cut by packing only. Rows that repeat a doc_id
are one document to the join, which keeps one of them; rows without a doc_id all pass it. Ties go to the smallest doc_id. Further
columns, whatever their names, are kept up to the last stage; an empty table gives an empty result.

All but the last return the columns of documents. ORACLE_SQL is None: SQL can express neither the classifier nor the tokenizer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from perilune.llm import classifier, jaccard_join, mixing, secrets
from perilune.llm.common import dropped, staged, staging, table
from perilune.llm.op5_packing import packed_digest


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return classifier.keep_good(docs, classifier.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_secrets(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed_digest(docs)


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("secret scans", redact), ("mixing sources", mix), ("best-fit packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each but the last is written as Parquet and read again. What a stage has staged, its input too, goes as soon as its output is written."""
    docs, mark = table(spark, sf_dir, "documents"), staging()
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs)
            dropped(spark, mark)
    return docs
