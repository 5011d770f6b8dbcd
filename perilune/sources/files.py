"""Files of bytes as a sink: each row (name, content) becomes one file, made visible when the whole job is done.

    spark.dataSource.register(FileSink); rows.write.format("byte_files").mode("append").save(folder)
"""

from __future__ import annotations

import os
import re
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


@dataclass
class _Written(WriterCommitMessage):
    folder: str
    names: list[str]


class Writer(DataSourceWriter):
    """A task writes below a folder of its own attempt; the driver moves the files of committed attempts into place, so retried and speculative tasks never meet. What a task that outlives a failed job leaves is below a name that begins with an underscore."""

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.work = path, overwrite, os.path.join(path, f"_temporary-{uuid.uuid4().hex}")
        os.makedirs(self.work)

    def write(self, rows: Iterator) -> WriterCommitMessage:
        folder, names = os.path.join(self.work, uuid.uuid4().hex), {}
        os.mkdir(folder)  # fails for a task that outlived its job
        for r in rows:
            name = os.path.basename(r["name"])
            if name in names:
                raise ValueError(f"two rows are called {name}")
            with open(os.path.join(folder, name), "wb") as f:
                f.write(bytes(r["content"] or b""))
            names[name] = None
        return _Written(folder, list(names))

    def commit(self, messages: list) -> None:
        done = [m for m in messages if m is not None]
        names = [n for m in done for n in m.names]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("rows of several tasks have the same name")
        if self.overwrite:
            for n in os.listdir(self.path) if os.path.isdir(self.path) else ():
                if os.path.join(self.path, n) != self.work:
                    old = os.path.join(self.path, n)
                    shutil.rmtree(old) if os.path.isdir(old) else os.remove(old)
        for m in done:
            for n in m.names:
                os.replace(os.path.join(m.folder, n), os.path.join(self.path, n))
        shutil.rmtree(self.work, ignore_errors=True)

    def abort(self, messages: list) -> None:
        shutil.rmtree(self.work, ignore_errors=True)


class FileSink(DataSource):
    """format('byte_files'): name string, content binary. The folder is on a disk that all machines see."""

    @classmethod
    def name(cls) -> str:
        return "byte_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return Writer(self.options["path"].removeprefix("file://"), overwrite)


def write_files(rows: DataFrame, path: str, mode: str = "append") -> None:
    """rows: name, content."""
    spark = rows.sparkSession
    spark.dataSource.register(FileSink)
    rows.select("name", "content").write.format("byte_files").mode(mode).save(path)


def scratch(spark: SparkSession) -> str:
    """A fresh path in spark.checkpoint.dir, which all machines share; a local one for local sessions without it."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return f"{(top or 'file:///tmp/checkpoints').rstrip('/')}/perilune-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unstaged(spark: SparkSession, path: str) -> None:
    """Removes a table that was written to `scratch`."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
