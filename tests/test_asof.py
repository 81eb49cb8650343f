"""Versions in force and previous rows, against brute force; plans without a single task."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from veilstream import registry
from veilstream.functions import small
from veilstream.operators import asof
from veilstream.streaming import live

START = datetime(1969, 12, 30)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def data(seed, events=300, versions=40, hours=200):
    r = random.Random(seed)
    at = lambda: START + timedelta(minutes=r.randrange(60 * hours))
    return (
        [(i, r.choice(["a", "a", "b", None]), at() if r.random() < 0.95 else None) for i in range(events)],
        [(n, r.choice(["a", "b", None]), at() if r.random() < 0.95 else None, f"p{n}") for n in range(versions)],
    )


def brute(events, versions):
    out = {}
    for i, k, t in events:
        held = [(s, n, p) for n, kk, s, p in versions if kk == k and s is not None and t is not None and s <= t]
        out[i] = max(held)[1:] if held else None
    return out


EVENTS, VERSIONS = "event_id long, k string, ts timestamp", "version long, k string, since timestamp, name string"


@pytest.mark.parametrize(("seed", "bits", "seconds"), [(1, 22, 3600), (2, 2, 3600), (3, 1, 86400), (4, 3, 100)])
def test_as_of_equals_brute_force(spark, monkeypatch, seed, bits, seconds):
    monkeypatch.setattr(asof, "FAN_BITS", bits)
    events, versions = data(seed)
    out = asof.as_of(spark.createDataFrame(events, EVENTS), spark.createDataFrame(versions, VERSIONS), "ts", "since", "version", ["k"], seconds)
    assert out.columns == ["event_id", "k", "ts", "in_force"]
    rows = out.select("event_id", "in_force.version", "in_force.name", "in_force").collect()
    assert {r.event_id: None if r.in_force is None else (r.version, r.name) for r in rows} == brute(events, versions) and len(rows) == len(events)


@pytest.mark.parametrize("most", [1, 7, 1000])
def test_as_of_splits_crowded_slots(spark, most):
    """A day's slots hold all versions and events; many begin, or come, at the same time."""
    events, versions = data(7, 400, 300, 20)
    out = asof.as_of(spark.createDataFrame(events, EVENTS), spark.createDataFrame(versions, VERSIONS), "ts", "since", "version", ["k"], 86400, most)
    assert "filter(" not in plan(out)  # no list of versions is looked through for each event
    rows = out.select("event_id", "in_force").collect()
    assert {r.event_id: r.in_force and (r.in_force.version, r.in_force.name) for r in rows} == brute(events, versions) and len(rows) == len(events)


def test_as_of_without_rows_or_keys(spark):
    events, versions = data(5)
    none, some = spark.createDataFrame([], VERSIONS), spark.createDataFrame(events, EVENTS)
    assert asof.as_of(some, none, "ts", "since", "version", ["k"]).where("in_force IS NOT NULL").count() == 0
    assert asof.as_of(some.limit(0), spark.createDataFrame(versions, VERSIONS), "ts", "since", "version", ["k"]).count() == 0
    out = asof.as_of(some, spark.createDataFrame(versions, VERSIONS), "ts", "since", "version", [])
    want = brute([(i, 0, t) for i, _, t in events], [(n, 0, s, p) for n, _, s, p in versions])
    assert {r.event_id: r.in_force and (r.in_force.version, r.in_force.name) for r in out.collect()} == want


def test_no_single_task(spark):
    for name in ("policy_in_force", "policy_overwrites", "tenant_policy_overwrites"):
        assert "SinglePartition" not in plan(registry.queries()[name](spark, "/root/testdata/sf0.001"))


@pytest.mark.parametrize(("bits", "rows"), [(22, 20), (2, 2), (1, 5)])
def test_overwrites_over_slot_borders(spark, monkeypatch, bits, rows):
    monkeypatch.setattr(asof, "FAN_BITS", bits)
    monkeypatch.setattr(asof, "ROW_BITS", rows)
    r = random.Random(6)
    seqs = sorted(r.sample(range(5000), 200))
    changes = [(s, r.choice(["local", "central"]), s * 10) for s in seqs]
    want = {(s, v) for (_, before, _), (s, kind, v) in zip(changes, changes[1:]) if kind == "central" and before == "local"}
    r.shuffle(changes)
    out = small.overwrites(spark.createDataFrame(changes, "seq long, kind string, version long"))
    assert {tuple(x) for x in out.collect()} == want


def test_stream_meets_versions_of_its_time(spark, tmp_path):
    at = lambda h: START + timedelta(hours=h)
    path = {n: str(tmp_path / n) for n in ("events", "versions", "c")}
    add = lambda name, rows, kind: spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(path[name])
    got = {}

    def send(batch, n):
        got.update({r.event_id: r.version for r in batch.select("event_id", F.col("in_force.version").alias("version")).collect()})

    def run():
        stream = spark.readStream.schema(EVENTS).parquet(path["events"])
        q = live.with_policy_in_force(stream, lambda: spark.read.schema(VERSIONS).parquet(path["versions"]), send, path["c"], "ts", "since", "version", ["k"])
        q.trigger(availableNow=True).start().awaitTermination(120)

    add("versions", [(1, "a", at(1), "x")], VERSIONS)
    add("events", [(1, "a", at(0)), (2, "a", at(2)), (3, "b", at(2))], EVENTS)
    run()
    add("versions", [(2, "a", at(3), "y")], VERSIONS)
    add("events", [(4, "a", at(4)), (5, "a", at(2))], EVENTS)  # the second comes late
    run()
    assert got == {1: None, 2: 1, 3: None, 4: 2, 5: 1}
