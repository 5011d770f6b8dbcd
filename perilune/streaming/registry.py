"""Tables that a stream keeps up to date, and the registry of sessions that is kept in one."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


class Upserts:
    """A table of the newest row of each key, written by one streaming query (`foreachBatch(table.write)`) and readable at any time.

    A micro-batch becomes the folder epoch=N, with its newest row for each key; after `every` of them they and the last base are merged
    into base=N. Folders appear whole, by a rename, so the path lies on a file system whose renames are atomic. An epoch that is run
    again is there already and changes nothing. The base before the last stays with its epochs until the next merge, so that a reader
    who has listed the folders can finish. Epochs are counted by the query's checkpoint: a new checkpoint needs a new path.

    `order` decides which row is newest, then the epoch does; within one epoch it must tell the rows of a key apart. Null keys are a
    key like any other, null orders come before all others, and a table without epochs is empty. Columns may have any names.
    """

    def __init__(self, path: str, schema: str, keys: list[str], order: list[str], every: int = 20) -> None:
        self.path, self.schema, self.keys, self.order, self.every = path.rstrip("/"), schema, keys, order, every

    def _path(self, spark: SparkSession, name: str = "") -> tuple:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _folders(self, spark: SparkSession) -> tuple[list[int], list[int], list[str]]:
        """The bases, the epochs, and what unfinished writes have left."""
        top, files = self._path(spark)
        names = [s.getPath().getName() for s in files.listStatus(top)] if files.exists(top) else []
        numbers = lambda kind: sorted(int(n.removeprefix(kind)) for n in names if n.startswith(kind))
        return numbers("base="), numbers("epoch="), [n for n in names if n.startswith("_work-")]

    def _put(self, rows: DataFrame, name: str) -> None:
        work = f"_work-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{work}")
        source, files = self._path(rows.sparkSession, work)
        if not files.rename(source, self._path(rows.sparkSession, name)[0]):
            raise OSError(f"{name} could not be put into place")

    def _newest(self, rows: DataFrame) -> DataFrame:
        """rows: epoch, row."""
        field = lambda c: F.col("row").getField(c)
        keys = [field(c).alias(f"k{i}") for i, c in enumerate(self.keys)]
        best = F.max_by(F.struct("epoch", "row"), F.struct(*(field(c).alias(f"o{i}") for i, c in enumerate(self.order)), F.col("epoch").alias("e")))
        return rows.groupBy(*keys).agg(best.alias("m")).select("m.epoch", "m.row")

    def _rows(self, spark: SparkSession, bases: list[int], epochs: list[int]) -> DataFrame:
        last = bases[-1] if bases else -1
        paths = [f"{self.path}/base={last}"] * bool(bases) + [f"{self.path}/epoch={e}" for e in epochs if e > last]
        kept = f"epoch long, row struct<{self.schema}>"
        return spark.read.schema(kept).parquet(*paths) if paths else spark.createDataFrame([], kept)

    def write(self, batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        bases, epochs, _ = self._folders(spark)
        if epoch in epochs or bases and epoch <= bases[-1]:
            return
        named = F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in batch.columns))
        self._put(self._newest(batch.select(F.lit(epoch).cast("long").alias("epoch"), named.alias("row"))), f"epoch={epoch}")
        if len([e for e in epochs if not bases or e > bases[-1]]) + 1 >= self.every:
            self.compact(spark)

    def compact(self, spark: SparkSession) -> None:
        """Merges the epochs so far into a base; for the writer alone."""
        bases, epochs, left = self._folders(spark)
        if not epochs or bases and epochs[-1] <= bases[-1]:
            return
        self._put(self._newest(self._rows(spark, bases, epochs)), f"base={epochs[-1]}")
        last = bases[-1] if bases else -1
        for name in [f"base={b}" for b in bases[:-1]] + [f"epoch={e}" for e in epochs if e <= last] + left:
            path, files = self._path(spark, name)
            files.delete(path, True)

    def read(self, spark: SparkSession) -> DataFrame:
        """The newest row of each key, as of the last whole epoch."""
        bases, epochs, _ = self._folders(spark)
        return self._newest(self._rows(spark, bases, epochs)).select("row.*")


def session_changes(events: DataFrame) -> DataFrame:
    """events: host, t (s), seq, kind (create, stop), name, start, period (s). Output (append mode), one row an event: host, t, seq, name, outcome, start, period.

    A session that meets one of the host's active sessions, ends included, isn't created (overlap); else it is, in the place of an active one of
    its name (created). A session without a name is called by the milliseconds of its creation. Stopping an active one ends it (stopped),
    others are not known (unknown); both tell the session's own start and period, unknown ones null. Events count by t, then seq, in each micro-batch,
    and micro-batches one after the other. State is the active sessions of a host; a host without any has none.
    """
    columns = ["host", "t", "seq", "name", "outcome", "start", "period"]

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        active = {n: (a, p) for n, a, p in zip(*state.get, strict=True)} if state.exists else {}
        # Hosts have a few events each, for which plain lists are many times cheaper than operations on frames.
        rows = [r for p in parts for r in zip(*(p[c].tolist() for c in ("t", "seq", "kind", "name", "start", "period")), strict=True)]
        done: list[tuple] = []
        for t, seq, kind, given, start, period in sorted(rows, key=lambda r: [(True, 0) if x is None or x != x else (False, x) for x in r[:2]]):
            name = str(int(t * 1000)) if given is None or given != given else given
            if kind == "create":
                span = (float(start), float(period))
                meets = any(span[0] <= a + p and a <= span[0] + span[1] for a, p in active.values())
                outcome = "overlap" if meets else "created"
                if not meets:
                    active[name] = span
            else:
                span = active.pop(name, None)
                outcome = "unknown" if span is None else "stopped"
            done.append((key[0], float(t), seq, name, outcome, *(span or (None, None))))
        if active:
            state.update((list(active), [a for a, _ in active.values()], [p for _, p in active.values()]))
        elif state.exists:
            state.remove()
        made = {c: [r[k] for r in done] for k, c in enumerate(columns)}
        yield pd.DataFrame(made | {c: np.array(made[c], dtype=float) for c in ("start", "period")})

    kinds = dict(events.dtypes)
    out = f"host {kinds['host']}, t double, seq {kinds['seq']}, name string, outcome string, start double, period double"
    return events.groupBy("host").applyInPandasWithState(step, out, "names array<string>, starts array<double>, periods array<double>", "append", GroupStateTimeout.NoTimeout)


class Sessions:
    """The registry over a table: `changes` in, then get and list what is active. Stopped sessions stay in the table, as its history's last word."""

    def __init__(self, path: str, host: str = "long", seq: str = "long", every: int = 20) -> None:
        schema = f"host {host}, t double, seq {seq}, name string, outcome string, start double, period double"
        self.table = Upserts(path, schema, ["host", "name"], ["t", "seq"], every)

    def write(self, changes: DataFrame, epoch: int) -> None:
        """A foreachBatch function for `session_changes`."""
        self.table.write(changes.where(F.col("outcome").isin("created", "stopped")), epoch)

    def all(self, spark: SparkSession) -> DataFrame:
        """Each session by host and name, and whether it is active."""
        return self.table.read(spark).select("host", "name", "t", "seq", "start", "period", (F.col("outcome") == "created").alias("active"))

    def active(self, spark: SparkSession, host: Column | None = None, name: str | None = None) -> DataFrame:
        """The active sessions; of one host, or the one of a name (no row: there is none)."""
        rows = self.all(spark).where("active")
        rows = rows if host is None else rows.where(F.col("host") == host)
        return rows if name is None else rows.where(F.col("name") == name)
