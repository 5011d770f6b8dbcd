"""Tables that streams keep up to date: replays, merges, the registry of sessions; state that ends."""

import json
import os
import random

import pytest
from test_orbit_and_streams import TRANSFER, latest, run, transfer

from perilune.streaming import dispatch, stateful
from perilune.streaming.registry import Sessions, Upserts, session_changes


def test_a_table_keeps_the_newest_rows_whatever_is_run_again(spark, tmp_path):
    rng = random.Random(3)
    schema = "k int, t int, epoch int, `a.b` string, m map<string,int>"
    table = Upserts(str(tmp_path / "t"), schema, ["k"], ["t", "epoch"], every=3)
    assert table.read(spark).collect() == []
    best, listed = {}, None
    for epoch in range(10):
        rows = [(rng.choice([None, 1, 2, 3, 4]), rng.randrange(40), epoch * 10 + j, f"{epoch}.{j}", {"x": epoch}) for j in range(rng.randrange(4))]
        if epoch == 5:
            listed, then = table.read(spark), dict(best)  # a reader that has listed the folders before the merge of this epoch
        for r in rows:
            if r[0] not in best or r[1:3] >= best[r[0]][1:3]:
                best[r[0]] = r
        batch = spark.createDataFrame(rows, schema)
        table.write(batch, epoch)
        table.write(spark.createDataFrame([(9, 99, 99, "again", None)], schema), epoch)  # a second run of an epoch is not another epoch
        assert sorted((tuple(r) for r in table.read(spark).collect()), key=repr) == sorted(best.values(), key=repr)
        if epoch in (5, 7):
            assert sorted((tuple(r) for r in listed.collect()), key=repr) == sorted(then.values(), key=repr)
    left = sorted(os.listdir(tmp_path / "t"))
    assert left == ["base=5", "base=8", "epoch=6", "epoch=7", "epoch=8", "epoch=9"]
    (tmp_path / "t" / "_work-gone").mkdir()  # of a writer that was lost
    table.compact(spark)
    assert sorted(os.listdir(tmp_path / "t")) == ["base=8", "base=9", "epoch=9"]
    assert table.read(spark).count() == len(best)


def test_a_failed_epoch_leaves_the_table_as_it_was(spark, tmp_path):
    table = Upserts(str(tmp_path / "t"), "k int, v int", ["k"], ["v"])
    table.write(spark.createDataFrame([(1, 1)], "k int, v int"), 0)
    with pytest.raises(Exception, match="(?i)divi"):
        table.write(spark.range(3).selectExpr("cast(id as int) k", "cast(1 / (id - 1) as int) v"), 1)
    assert [tuple(r) for r in table.read(spark).collect()] == [(1, 1)]
    table.write(spark.createDataFrame([(1, 2)], "k int, v int"), 1)
    assert [tuple(r) for r in table.read(spark).collect()] == [(1, 2)]


def replayed(events):
    """Brute force: (host, name) -> (outcome, seq) of the last change, and the outcome of each event."""
    active, last, outcomes = {}, {}, {}
    for e in sorted(events, key=lambda e: (e["t"], e["seq"])):
        mine = active.setdefault(e["host"], {})
        name = str(int(e["t"] * 1000)) if e["name"] is None else e["name"]
        if e["kind"] == "create":
            end = e["start"] + e["period"]
            outcome = "overlap" if any(e["start"] <= b and a <= end for a, b in mine.values()) else "created"
            if outcome == "created":
                mine[name] = (e["start"], end)
        else:
            outcome = "unknown" if mine.pop(name, None) is None else "stopped"
        outcomes[e["seq"]] = outcome
        if outcome in ("created", "stopped"):
            last[e["host"], name] = (outcome, e["seq"])
    return last, outcomes


def test_sessions_are_created_listed_and_stopped_over_restarts(spark, tmp_path):
    rng = random.Random(7)
    events = [
        {"host": rng.randrange(3), "t": float(k // 2), "seq": k, "kind": rng.choice(["create", "create", "stop"]), "name": rng.choice(["a", "b", "c", "d", None]),
         "start": float(rng.randrange(60)), "period": float(rng.choice([0, 5, 12]))}
        for k in range(120)
    ]
    registry, folder = Sessions(str(tmp_path / "r"), every=2), tmp_path / "in"
    folder.mkdir()
    seen = []

    def write(changes, epoch):
        seen.extend((r.seq, r.outcome) for r in changes.collect())
        registry.write(changes, epoch)

    for k in range(4):  # each part by a query of its own, from the checkpoint of the last
        (folder / f"{k}.json").write_text("\n".join(json.dumps(e) for e in events[30 * k : 30 * k + 30]))
        stream = spark.readStream.schema("host long, t double, seq long, kind string, name string, start double, period double").json(str(folder))
        session_changes(stream).writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        last, outcomes = replayed(events[: 30 * k + 30])
        rows = registry.all(spark).collect()
        assert {(r.host, r.name): ("created" if r.active else "stopped", r.seq) for r in rows} == last
    assert dict(seen) == outcomes and set(outcomes.values()) == {"created", "overlap", "stopped", "unknown"}
    listed = {(r.host, r.name) for r in registry.active(spark).collect()}
    assert listed == {k for k, v in last.items() if v[0] == "created"}
    host, name = sorted(listed, key=repr)[0]
    assert [r.name for r in registry.active(spark, host, name).collect()] == [name] and registry.active(spark, host, "none").collect() == []


def test_a_rate_limited_key_is_forgotten(spark, tmp_path):
    rows = [{"key": "a", "t": t, "mode": "single", "target": 1} for t in (0.0, 1.0)] + [{"key": "b", "t": 100000.0, "mode": "single", "target": 1}]
    rows += [{"key": "b", "t": 100001.0, "mode": "single", "target": 1}] + [{"key": "a", "t": 100002.0, "mode": "single", "target": 1}, {"key": "b", "t": 100002.0, "mode": "single", "target": 1}]
    got = run(spark, tmp_path, rows, "key string, t double, mode string, target long", lambda s: dispatch.rate_limited(s, 5.0), "append", files=3)
    assert sorted((r.key, r.t, r.shot) for r in got) == [("a", 0.0, 1), ("a", 100002.0, 1), ("b", 100000.0, 1)]


def test_a_host_without_samples_is_forgotten(spark, tmp_path):
    rows = [{"host": "a", "seq": k, "t": float(k), "changed": False} for k in range(2)] + [{"host": "b", "seq": k, "t": 1e5 + k, "changed": True} for k in range(2)]
    rows += [{"host": "a", "seq": 2, "t": 1e5 + 3, "changed": False}, {"host": "b", "seq": 2, "t": 1e5 + 3, "changed": False}]
    got = latest(run(spark, tmp_path, rows, "host string, seq long, t double, changed boolean", stateful.missed_updates, "update", files=3), "host")
    assert {k: (r.misses, r.restarts) for k, r in got.items()} == {"a": (1, 0), "b": (1, 0)}


def test_a_long_transfer_in_small_state(spark, tmp_path):
    """Bursts repeat what was lost before they go on; brute force on the list of what is missing."""
    rng = random.Random(5)
    missing, events, t = list(range(130)), [(0, "start", 130), (1, "ack", 0), (2, "ack", 0)], 3
    while missing:
        bits = rng.getrandbits(40) | rng.getrandbits(40)
        missing = [f for k, f in enumerate(missing[:40]) if not bits >> k & 1] + missing[40:]
        events.append((t, "confirm", bits))
        t += 1
    got = run(spark, tmp_path, transfer(1, *events), TRANSFER, stateful.downlink, "update", files=3)
    assert (got[-1].status, got[-1].missing, got[-1].bursts) == ("done", 0, t - 3) and len(got) == 3
