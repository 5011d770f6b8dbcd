"""Command dispatch over micro-batches: priority order, retries of single commands, hand-over once, and rate limits for each source."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from perilune.streaming.stateful import timed, wake


def with_retries(run_one: Callable[[Row], None], attempts: int = 3, workers: int = 5, inline: tuple[str, ...] = ("SHUTDOWN",), failed: Callable[[Row, Exception], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: commands by falling priority, then age, go to a pool of workers. A command that raises is tried again by itself, and after the last
    attempt goes to `failed` (or, when all others are done, its error is raised). Commands named in `inline` wait for those before them and run alone.

    Commands act on the driver, as their order is one for all; they are read a partition at a time.
    """

    def tried(row: Row) -> Exception | None:
        for _ in range(attempts):
            try:
                run_one(row)
                return None
            except Exception as e:  # noqa: BLE001  whatever a command raises is its own failure
                last = e
        if failed is not None:
            failed(row, last)
            return None
        return last

    def run(batch: DataFrame, epoch: int) -> None:
        ordered = batch.orderBy(F.desc("priority"), "created_at", "cmd_id")
        named = "name" in batch.columns
        lost: list = []
        with ThreadPoolExecutor(workers) as pool:
            waiting: list = []
            for row in ordered.toLocalIterator():
                if named and row["name"] in inline:
                    lost += [f.result() for f in waiting]
                    waiting = []
                    lost.append(tried(row))
                else:
                    waiting.append(pool.submit(tried, row))
            lost += [f.result() for f in waiting]
        if errors := [e for e in lost if e is not None]:
            raise errors[0]

    return run


def drained(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that hands each batch over once: a batch that is run again after a failure replaces what it wrote."""

    def run(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return run


def rate_limited(triggers: DataFrame, period: float, held: float = 86400.0, late: str = "10 minutes") -> DataFrame:
    """triggers: key, t (s), mode, target. The first trigger of a mode fires at once, later ones when the period is over, until the target's number of shots; a new mode begins anew.

    A key without triggers for `held` seconds (and a period) is forgotten: its next trigger is the first of its mode. Spark drops
    triggers that are more than `late` behind the newest one of any key.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fired = []
        if state.hasTimedOut:
            state.remove()
        else:
            mode, last, shots, seen = state.get if state.exists else ("", -1.0, 0, None)
            for r in pd.concat(list(parts)).sort_values("t", kind="stable").itertuples(index=False):
                away = seen is not None and r.t - seen > max(held, period)
                seen = float(r.t) if seen is None else max(seen, float(r.t))
                if away or r.mode != mode:
                    mode, last, shots = r.mode, -1.0, 0
                if shots < r.target and (shots == 0 or r.t - last >= period):
                    last, shots = float(r.t), shots + 1
                    fired.append((key[0], float(r.t), mode, shots))
            state.update((mode, last, shots, seen))
            wake(state, seen + max(held, period))
        yield pd.DataFrame(fired, columns=["key", "t", "mode", "shot"])

    kept = "mode string, last double, shots long, seen double"
    return timed(triggers, late).groupBy("key").applyInPandasWithState(step, "key string, t double, mode string, shot long", kept, "append", GroupStateTimeout.EventTimeTimeout)
