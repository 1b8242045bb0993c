"""Streams against their batch twins: late rows, restarts, batches that run again."""

import os
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from wardlake.operators import cases, fleet, windows
from wardlake.operators import primitives as P
from wardlake.plans.telemetry import telemetry
from wardlake.streaming import jobs, keyed
from wardlake.streaming.store import SightingStore

SECOND = 1_000_000
START = 5_000 * SECOND  # a stream's watermark begins at 0
SCHEMA = "event_id long, host string, ts_us long, value string, technique string, severity string, score double, source string, parent_process_generation long, counter long"


@pytest.fixture
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", keyed.ROCKSDB)
    spark.conf.set("spark.sql.shuffle.partitions", 2)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.shuffle.partitions", 4)


def events(rng, n):
    for i in range(n):
        yield (i, rng.choice("ab"), START + rng.randrange(600) * SECOND // 2, rng.choice("xyz"), rng.choice(["T1", "T2"]), rng.choice(["low", "high", "critical"]), rng.choice([None, 0.2, 0.7]), rng.choice(["rule", "sigma", None]), rng.choice([None, 1, 1, 2]), 0)


def in_parts(rows, rng, late):
    """Rows in order of time, each up to `late` seconds behind its turn; and one far ahead, which closes the stream."""
    rows = sorted(rows, key=lambda r: r[2] + rng.random() * late * SECOND)
    parts = [rows[i::1][: len(rows) // 4] for i in range(0, len(rows), len(rows) // 4)]
    return [*parts, [(10**6, "end", 10**6 * SECOND, *[None] * 7)], [(10**6 + 1, "end", 10**6 * SECOND + 1, *[None] * 7)]]


def streamed(spark, folder, parts, machine, delay):
    """All that a stream tells over the parts; it is started anew for each of them."""
    for n, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/{n}")
        source = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(f"{folder}/in")
        out = keyed.keyed_stream(source, ["host"], machine, delay)
        query = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out").where("host != 'end'")


MACHINES = {
    "count": (keyed.SlidingCount(20 * SECOND), lambda df: P.sliding_count(df, ["host"], "ts_us", 20 * SECOND, "event_id").select("host", "event_id", "n")),
    "distinct": (keyed.SlidingDistinct("value", 9 * SECOND), lambda df: P.sliding_distinct(df, ["host"], "ts_us", "value", 9 * SECOND, "event_id").select("host", "event_id", "n")),
    "anchored": (keyed.Anchored(15 * SECOND), lambda df: P.suppress_within(df, ["host"], "ts_us", 15 * SECOND, "event_id").select("host", "event_id", "ts_us")),
    "fusion": (keyed.Fusion(30 * SECOND), lambda df: cases.fuse(df, ["host"], 30 * SECOND).select("host", "event_id", "max_rank", "max_score", "techniques", "sources", "evidence")),
}


@pytest.mark.parametrize("name", sorted(MACHINES))
def test_each_machine_tells_what_its_batch_twin_does(spark, rocksdb, tmp_path, name):
    rng = random.Random(7)
    machine, twin = MACHINES[name]
    rows = list(events(rng, 120))
    got = streamed(spark, tmp_path, in_parts(rows, rng, 8), machine, "200 seconds")
    want = twin(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_silence_is_told_without_a_row(spark, rocksdb, tmp_path):
    rows = [(0, "a", 0, 1), (1, "a", 10, 1), (2, "a", 50, 2), (3, "a", 55, 3), (4, "b", 5, 1), (5, "b", 20, 2), (6, "a", 200, 3)]
    rows = [(i, host, START + t * SECOND, *[None] * 6, c) for i, host, t, c in rows]
    got = streamed(spark, tmp_path, [rows[:3], rows[3:], *in_parts(rows, random.Random(1), 0)[-2:]], keyed.Silence("counter", 30 * SECOND), "100 seconds")
    want = [("a", 0, 30), ("a", 55, 85), ("b", 20, 50)]
    assert sorted(map(tuple, got.collect())) == [(h, START + s * SECOND, START + t * SECOND) for h, s, t in want]
    spans = windows.silent_spans(spark.createDataFrame(rows, SCHEMA), ["host"], "counter", 30 * SECOND, 10**6 * SECOND)
    assert sorted(map(tuple, spans.select("host", "since", "told_at").collect())) == sorted(map(tuple, got.collect()))


def test_an_entity_is_forgotten(spark):
    machine = keyed.Fusion(30, forget=100)
    state, told = machine.step(machine.first(), 0, 1, {"technique": "T1", "severity": "high"})
    assert told and machine.due(state) == 100 and machine.wake(state, 100) == (None, [])


def files(folder):
    return {str(p): os.stat(p).st_mtime_ns for p in Path(folder).rglob("*.parquet")}


def test_sightings_by_delta(spark, data, tmp_path):
    ev = telemetry(spark, data)
    want = sorted(map(tuple, fleet.fold_sightings(fleet.observations(ev)).collect()))
    store = SightingStore(spark, str(tmp_path / "t"), 8)
    parts = [fleet.fold_sightings(fleet.observations(ev.where(F.col("event_id") % 5 == i))).cache() for i in range(5)]
    for i, part in enumerate(parts):
        store.add(part, i)
        store.add(part, i)  # run again
    assert sorted(map(tuple, store.read().collect())) == want
    # what has few deltas stays untouched
    lone = parts[0].where(F.pmod(F.xxhash64(*fleet.SIGHTING), F.lit(8)) == 3)
    store.add(lone, 5)
    before = files(tmp_path / "t")
    assert store.compact(6) == [3]
    after = files(tmp_path / "t")
    assert before.items() <= after.items() and all("/bucket=3/" in p for p in after.keys() - before.keys())
    more = fleet.merge_sightings(fleet.fold_sightings(fleet.observations(ev)), lone)
    assert sorted(map(tuple, store.read().collect())) == sorted(map(tuple, more.collect()))
    store.add(lone, 5)  # run again after it was compacted
    assert store.compact(1) == [b for b in range(8) if b != 3] and store.compact(1) == []
    assert sorted(map(tuple, store.read().collect())) == sorted(map(tuple, more.collect()))
    assert store.read({3}).count() == more.where(F.pmod(F.xxhash64(*fleet.SIGHTING), F.lit(8)) == 3).count()
    assert SightingStore(spark, str(tmp_path / "none"), 8).read().count() == 0


def test_stream_of_sightings(spark, data, tmp_path):
    ev = telemetry(spark, data).orderBy("ts_us").limit(400)
    ev.repartition(4).write.parquet(str(tmp_path / "ev"))
    batch = spark.read.parquet(str(tmp_path / "ev"))
    source = lambda: spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "ev"))
    for _ in range(2):
        jobs.stream_sightings(source(), str(tmp_path / "t"), str(tmp_path / "c"), buckets=4, compact_at=2).awaitTermination()
    want = fleet.fold_sightings(fleet.observations(batch))
    got = SightingStore(spark, str(tmp_path / "t"), 4).read()
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
