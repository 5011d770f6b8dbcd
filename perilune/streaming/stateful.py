"""Keyed state machines with timers: collection sessions, transfers, job and power states, health checks. Each keeps one small state a key.

They are grouped-map operators with state (applyInPandasWithState): the semantics are sequential for each key. Time is the
events' own (column t, seconds): what would have happened between two events is done before the second, and the watermark fires timers
of keys that have no further events. A key that has ended is held for a while, so that stragglers find it, and then evicted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: So many seconds a key that has ended is held.
HELD = 600.0
#: Watermarks begin at 0 and Spark drops what isn't after them, so event times are counted from this many seconds before 0: relative clocks are complete.
BEFORE = float(1 << 31)


def timed(rows: DataFrame, late: str) -> DataFrame:
    """The rows with a watermark on t (s)."""
    return rows.withColumn("_at", F.timestamp_seconds(F.col("t").cast("double") + BEFORE)).withWatermark("_at", late)


def wake(state: GroupState, due: float) -> None:
    """Sets the timer of a key, in seconds of t."""
    state.setTimeoutTimestamp(max(int((due + BEFORE) * 1000), state.getCurrentWatermarkMs() + 1))


def keyed(events: DataFrame, key: str, state: str, out: str, tick: Callable, apply: Callable, show: Callable, first: tuple, order: str = "t", late: str = "0 seconds") -> DataFrame:
    """events: key, t (seconds), order and further columns. Output on each batch (update mode): the key and what `show` makes of its state.

    first: the state of a new key. tick(state, now) -> (state, deadline): the state at `now` after all timers up to then, and when the next one is due (None:
    never); a state of None is evicted. apply(state, event) -> state.
    """
    kind = dict(events.dtypes)[key]
    names = [key, *(c.strip().split(" ")[0] for c in out.split(","))]

    def step(k: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now = held.get if held.exists else first
        clock, due = held.getCurrentWatermarkMs() / 1000 - BEFORE, None
        if held.hasTimedOut:
            now, due = tick(now, clock)
        else:
            rows = pd.concat(list(parts), ignore_index=True).sort_values(list(dict.fromkeys(("t", order))), kind="stable")
            for r in rows.itertuples(index=False):
                now, _ = tick(now, float(r.t))
                now = apply(first if now is None else now, r)
            now, due = tick(now, max(clock, float(rows["t"].max())))
        if now is None:
            if held.exists:
                held.remove()
            return
        held.update(tuple(now))
        if due is not None:
            wake(held, due)
        yield pd.DataFrame([(k[0], *show(now))], columns=names)

    return timed(events, late).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {out}", state, "update", GroupStateTimeout.EventTimeTimeout)


def collection_sessions(frames: DataFrame, late: str = "0 seconds") -> DataFrame:
    """frames: dataset_id, t, start (s), period (s), target. Frames count from the start until the target is met or the period is over, with or without a further frame.

    Output: dataset_id, counted, status (waiting, running, complete, expired). The count never passes the target.
    """

    def tick(s: tuple, now: float) -> tuple:
        counted, status, start, period = s
        if status in ("waiting", "running") and start >= 0 and now - start > period:
            status = "expired"
        ended = status in ("complete", "expired")
        end = start + period + (HELD if ended else 1e-3)
        return (None, None) if ended and now > end else ((counted, status, start, period), end if start >= 0 else None)

    def apply(s: tuple, r) -> tuple:
        counted, status, start, period = s
        if start < 0:
            start, period = float(r.start), float(r.period)
            if r.t - start > period:
                return counted, "expired", start, period
        if status in ("complete", "expired") or r.t < start:
            return counted, status, start, period
        counted += 1
        return counted, "complete" if counted >= r.target else "running", start, period

    return keyed(frames, "dataset_id", "counted long, status string, start double, period double", "counted long, status string", tick, apply, lambda s: s[:2], (0, "waiting", -1.0, 0.0), late=late)


def downlink(events: DataFrame, burst: int = 40, most_stalls: int = 5, ack: float = 10.0, retry: float = 3.0, confirm: float = 20.0, late: str = "0 seconds") -> DataFrame:
    """events: tid, t, seq, kind, fragments, bitmap. A transfer is created (kind start, with its fragments), acknowledged twice (ack: creation, then its size), and
    sent in bursts; confirm tells by a bitmap which of the last burst's fragments came, lowest bit first.

    A missing acknowledgement is asked for again every `retry` seconds and given up after `ack`, a missing confirmation after `confirm`, and a transfer
    after `most_stalls` confirmations in a row that bring nothing. The state is the last burst's fragments that haven't come and where the rest begins, however
    long a file is. Output: tid, status (idle, creating, sizing, sending, done, failed), reason, bursts, missing, stalls, repeated.
    """

    def tick(s: tuple, now: float) -> tuple:
        status, reason, again, rest, total, bursts, stalls, repeated, since, asked = s
        if status in ("creating", "sizing"):
            while status in ("creating", "sizing"):
                due = min(asked + retry, since + ack)
                if now < due:
                    break
                if due >= since + ack:
                    status, reason, since = "failed", "create_ack_timeout" if status == "creating" else "init_ack_timeout", due
                else:
                    repeated, asked = repeated + 1, due
        elif status == "sending" and now >= since + confirm:
            status, reason, since = "failed", "confirm_timeout", since + confirm
        if status in ("done", "failed", "idle") and now > since + HELD:
            return None, None
        due = {"creating": min(asked + retry, since + ack), "sizing": min(asked + retry, since + ack), "sending": since + confirm}.get(status, since + HELD)
        return (status, reason, again, rest, total, bursts, stalls, repeated, since, asked), due

    def apply(s: tuple, r) -> tuple:
        status, reason, again, rest, total, bursts, stalls, repeated, since, asked = s
        t = float(r.t)
        if r.kind == "start" and status == "idle":
            status, again, rest, total, since, asked = "creating", [], 0, int(r.fragments), t, t
        elif r.kind == "ack" and status == "creating":
            status, since, asked = "sizing", t, t
        elif r.kind == "ack" and status == "sizing":
            status, since, bursts = ("sending", t, 1) if total else ("done", t, 0)
        elif r.kind == "confirm" and status == "sending":
            upto = min(rest + burst - len(again), total)
            sent = [*again, *range(rest, upto)]
            again, rest, since = [f for k, f in enumerate(sent) if not int(r.bitmap) >> k & 1], upto, t
            stalls = stalls + 1 if len(again) == len(sent) else 0
            if not again and rest == total:
                status = "done"
            elif stalls >= most_stalls:
                status, reason = "failed", "stalled_progress"
            else:
                bursts += 1
        elif status == "idle":
            since = t
        return status, reason, again, rest, total, bursts, stalls, repeated, since, asked

    state = "status string, reason string, again array<long>, rest long, total long, bursts long, stalls long, repeated long, since double, asked double"
    out = "status string, reason string, bursts long, missing long, stalls long, repeated long"
    show = lambda s: (s[0], s[1], s[5], len(s[2]) + s[4] - s[3], s[6], s[7])
    return keyed(events, "tid", state, out, lambda s, now: tick((*s[:2], list(s[2]), *s[3:]), now), apply, show, ("idle", "", [], 0, 0, 0, 0, 0, 0.0, 0.0), "seq", late)


def chunk_transfer(events: DataFrame, wait: float = 10.0, late: str = "0 seconds") -> DataFrame:
    """events: tid, t, seq, kind (ack, nack), chunk, chunks. Stop and wait: a chunk is sent again at each nack; one that isn't acknowledged `wait` seconds after its first sending fails the transfer.

    Output: tid, next_chunk, resent, status (sending, done, failed).
    """

    def tick(s: tuple, now: float) -> tuple:
        nxt, again, total, since, status = s
        if status == "sending" and now > since + wait:
            status, since = "failed", since + wait
        if status != "sending" and now > since + HELD:
            return None, None
        return (nxt, again, total, since, status), since + (wait + 1e-3 if status == "sending" else HELD)

    def apply(s: tuple, r) -> tuple:
        nxt, again, total, since, status = s
        if not total:
            total, since, status = int(r.chunks), float(r.t), "sending"
        if status == "sending" and r.chunk == nxt:
            if r.kind == "nack":
                again += 1
            elif r.kind == "ack":
                nxt, since = nxt + 1, float(r.t)
                status = "done" if nxt > total else status
        return nxt, again, total, since, status

    return keyed(events, "tid", "next long, again long, total long, since double, status string", "next_chunk long, resent long, status string", tick, apply, lambda s: (s[0], s[1], s[4]), (1, 0, 0, 0.0, "idle"), "seq", late)


def missed_updates(samples: DataFrame, limit: int = 3, held: float = 86400.0, late: str = "10 minutes") -> DataFrame:
    """samples: host, seq, changed (whether the shared memory had changed) and t (s), if known. After `limit` misses in a row the sampler is restarted and the count begins anew.

    One state a host. With t, a host without samples for `held` seconds is forgotten, and Spark drops samples
    that are more than `late` behind the newest; without, hosts are kept for good.
    """
    clock = "t" in samples.columns

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        misses, restarts, seen = state.get if state.exists else (0, 0, None)
        for r in pd.concat(list(parts), ignore_index=True).sort_values("seq", kind="stable").itertuples(index=False):
            if clock:
                if seen is not None and r.t - seen > held:
                    misses, restarts = 0, 0
                seen = float(r.t) if seen is None else max(seen, float(r.t))
            misses = 0 if r.changed else misses + 1
            if misses >= limit:
                misses, restarts = 0, restarts + 1
        state.update((misses, restarts, seen))
        if clock:
            wake(state, seen + held)
        yield pd.DataFrame({"host": [key[0]], "misses": [misses], "restarts": [restarts]})

    rows, timer = (timed(samples, late), GroupStateTimeout.EventTimeTimeout) if clock else (samples, GroupStateTimeout.NoTimeout)
    return rows.groupBy("host").applyInPandasWithState(step, "host string, misses long, restarts long", "misses long, restarts long, seen double", "update", timer)


def overruns(events: DataFrame, late: str = "0 seconds") -> DataFrame:
    """events: key, t, seq, kind (update, take), value. The newest value waits until it is taken; an update that comes before replaces it and counts as an overrun."""

    def apply(s: tuple, r) -> tuple:
        value, waiting, count, _ = s
        if r.kind == "update":
            return float(r.value), True, count + int(waiting), float(r.t)
        return value, False, count, float(r.t)

    tick = lambda s, now: (None, None) if not s[1] and now > s[3] + HELD else (s, s[3] + HELD if not s[1] else None)
    return keyed(events, "key", "value double, waiting boolean, overruns long, at double", "value double, waiting boolean, overruns long", tick, apply, lambda s: s[:3], (float("nan"), False, 0, 0.0), "seq", late)


def health_checks(events: DataFrame, every: float = 500.0, late: str = "0 seconds") -> DataFrame:
    """events: camera, t, status (active, inactive or other), error. Every so many seconds a camera that is active with an error, or in no known state, is restarted, which clears both; inactive ones are left alone."""

    def tick(s: tuple, now: float) -> tuple:
        status, error, checked, restarts = s
        if checked >= 0 and now >= checked + every:
            if status != "inactive" and (error or status != "active"):
                status, error, restarts = "active", "", restarts + 1
            checked += every * ((now - checked) // every)
        return (status, error, checked, restarts), checked + every if checked >= 0 and (status != "inactive") else None

    def apply(s: tuple, r) -> tuple:
        return r.status, r.error or "", s[2] if s[2] >= 0 else float(r.t), s[3]

    return keyed(events, "camera", "status string, error string, checked double, restarts long", "status string, restarts long", tick, apply, lambda s: (s[0], s[3]), ("active", "", -1.0, 0), late=late)


#: Job and power state machines: (state, event) -> state; other events leave the state. Timers: state -> (seconds, event).
JOB = {("idle", "start"): "running", ("running", "finish"): "done", ("running", "fail"): "failed", ("done", "start"): "running", ("failed", "start"): "running", ("done", "reset"): "idle", ("failed", "reset"): "idle"}
POWER = {("off", "power_on"): "powering_on", ("powering_on", "booted"): "ready", ("powering_on", "timeout"): "off", ("ready", "shutdown"): "shutting_down", ("shutting_down", "down"): "off", ("shutting_down", "timeout"): "off"}
POWER_TIMERS = {"powering_on": (120.0, "timeout"), "shutting_down": (10.0, "timeout")}


def machine(events: DataFrame, moves: dict[tuple[str, str], str], first: str, timers: dict[str, tuple[float, str]] | None = None, late: str = "0 seconds") -> DataFrame:
    """events: key, t, seq, event. Output: key, state, rejected (events that had no move), expired (timers that fired). A key that rests in the first state is evicted in time."""
    timers = timers or {}

    def tick(s: tuple, now: float) -> tuple:
        state, rejected, expired, since = s
        while state in timers and now > since + timers[state][0]:
            seconds, event = timers[state]
            state, expired, since = moves[state, event], expired + 1, since + seconds
        if state == first and now > since + HELD:
            return None, None
        due = since + timers[state][0] + 1e-3 if state in timers else since + HELD if state == first else None
        return (state, rejected, expired, since), due

    def apply(s: tuple, r) -> tuple:
        state, rejected, expired, since = s
        if (state, r.event) in moves:
            return moves[state, r.event], rejected, expired, float(r.t)
        return state, rejected + 1, expired, since if since >= 0 else float(r.t)

    start = (first, 0, 0, -1.0)
    safe = lambda s, now: (s, None) if s[3] < 0 else tick(s, now)  # noqa: E731  a key without an event yet
    return keyed(events, "key", "state string, rejected long, expired long, since double", "state string, rejected long, expired long", safe, apply, lambda s: s[:3], start, "seq", late)
