"""What the operators share: shared folder, staged tables, text helpers."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import re
import shutil
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space; bytes.split() cuts at exactly these characters.
WORD_GAP = r"[\x20\x09-\x0D]+"
_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_BATCH, _BATCH_BYTES, _ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch", 512
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def ready(spark: SparkSession) -> None:
    """Let Python workers import this package and keep Arrow batches small, in rows and in bytes, since texts can be long. Smaller settings of the session's own stay."""
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", ""):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, env.get("PYTHONPATH", "")) if x)
    if not 0 < int(spark.conf.get(_BATCH)) <= _ROWS:
        spark.conf.set(_BATCH, str(_ROWS))
    if spark.conf.get(_BATCH_BYTES, None) in (None, "67108864b", "64MB"):  # its default
        spark.conf.set(_BATCH_BYTES, "16m")


def shared_dir(spark: SparkSession) -> str:
    """A fresh path in the folder all machines share, spark.checkpoint.dir. Where that is unset, a local folder serves a local session; on a cluster it is an error."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        top = f"file:///tmp/checkpoints/perilune/{os.getpid()}"
        atexit.register(shutil.rmtree, top.removeprefix("file://"), ignore_errors=True)
    return f"{top.rstrip('/')}/perilune-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def cleaned(spark: SparkSession) -> None:
    """Removes what this application has staged; for the end of a session, when no result is still to be read."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(os.path.dirname(shared_dir(spark)))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_STAGED: list[str] = []


def staging() -> int:
    """How many tables have been staged so far: a mark for `dropped`."""
    return len(_STAGED)


def dropped(spark: SparkSession, since: int, but: int = 1) -> None:
    """Removes what has been staged since a mark, except the last `but` tables."""
    gone = _STAGED[since : len(_STAGED) - but]
    del _STAGED[since : len(_STAGED) - but]
    for name in gone:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame, batch: int | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and survives lost executors. batch: rows of an Arrow batch meanwhile."""
    spark = df.sparkSession
    path = shared_dir(spark)
    before = spark.conf.get(_BATCH)
    try:
        if batch:
            spark.conf.set(_BATCH, str(batch))
        df.write.option("compression", "zstd").parquet(path)
        _STAGED.append(path)
    finally:
        spark.conf.set(_BATCH, before)
    return spark.read.schema(df.schema).parquet(path)


def released(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of tables that are no longer referred to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def trim() -> None:
    """In a worker: return freed memory to the system, Arrow's too, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_words(text: str | None) -> list[bytes]:
    """Words with A-Z lowered; none for a null text."""
    return (text or "").encode("utf-8", "replace").translate(_LOWER).split()


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")


def map_texts(df: DataFrame, fn: Callable[[list, list], dict], schema: str, keys: str = "doc_id", text: str = "text") -> DataFrame:
    """fn(ids, texts) -> columns by name, called once for each Arrow batch; the output has exactly the schema's columns."""
    ready(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                out = fn(b.column(0).to_pylist(), b.column(1).to_pylist())
                yield pa.RecordBatch.from_pydict(out)
        trim()  # workers outlive their tasks, and their freed memory counts as the executor's

    return df.select(F.col(keys), F.col(text)).mapInArrow(run, schema)


def replace_text(df: DataFrame, fn: Callable[[list], list]) -> DataFrame:
    """Rewrite `text` and keep every other column as it is; `n_chars`, where there is one, follows the new text."""
    ready(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                k = b.schema.get_field_index("text")
                yield pa.RecordBatch.from_arrays([*b.columns[:k], pa.array(fn(b.column(k).to_pylist()), b.schema.field(k).type), *b.columns[k + 1 :]], schema=b.schema)
        trim()

    out = df.mapInArrow(run, df.schema)
    return out.withColumn("n_chars", F.length("text").cast(dict(df.dtypes)["n_chars"])) if "n_chars" in df.columns else out
