"""Streams: late rows, restarts from the checkpoint, re-deliveries, and agreement with the tables' side."""

import datetime as dt
import pathlib
import random

import pandas as pd
import pytest

from cuelake import dims
from cuelake.streaming import streams as S

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def feed(spark, path, number, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in/{number}")


def run(spark, path, schema, make, mode="append"):
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    make(stream).writeStream.format("parquet").outputMode(mode).option("path", f"{path}/out").option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out")


def test_timers_drop_late_rows_and_restart(spark, tmp_path):
    schema = "ts timestamp, operation string, duration_ms double"
    path = str(tmp_path)
    feed(spark, path, 1, [(at(10), "a", 1.0), (at(20), "a", 3.0)], schema)
    run(spark, path, schema, S.stream_timers)
    feed(spark, path, 2, [(at(3600), "a", 5.0)], schema)
    run(spark, path, schema, S.stream_timers)
    feed(spark, path, 3, [(at(30), "a", 100.0), (at(7200), "a", 7.0)], schema)
    rows = run(spark, path, schema, S.stream_timers).orderBy("window_start").collect()
    assert [(r["calls"], r["total_ms"]) for r in rows] == [(2, 4.0), (1, 5.0)]


def test_call_rate(spark, tmp_path):
    schema = "ts timestamp, service string"
    path = str(tmp_path)
    feed(spark, path, 1, [(at(k), "s") for k in range(5)], schema)
    feed(spark, path, 2, [(at(4000), "s")], schema)
    quotas = dims.frame(spark, [("s", 3)], "service, quota")
    rows = run(spark, path, schema, lambda x: S.stream_call_rate(x, quotas)).collect()
    assert rows and {(r["calls"], r["over"]) for r in rows} == {(5, True)} and len(rows) == 6


def in_batches(spark, path, schema, batches, make):
    """Feeds the batches one after the other, the query restarted in between, and returns what has come out."""
    for number, rows in enumerate(batches):
        feed(spark, path, number, rows, schema)
        out = run(spark, path, schema, make)
    return sorted(map(tuple, out.collect()), key=repr)


CALLS = "service string, t_s long, ok boolean"
END = [("~", 4_000_000_000, True)]


def test_failure_streak_and_its_table_side(spark, tmp_path):
    first = [("s", 1000 + k, False) for k in range(5)] + [("t", 1000, True)]
    second = [("s", 1070, False), ("s", 1071, False), ("s", 1200, True), ("t", 1005, False)]
    got = in_batches(spark, str(tmp_path), CALLS, [first, second, END], S.stream_failure_streak)
    assert got == sorted(map(tuple, S.failure_streak(spark.createDataFrame(first + second, CALLS)).collect()), key=repr)
    by_time = sorted(r for r in got if r[0] == "s")
    assert [r[3] for r in by_time] == ["CLOSED"] * 5 + ["HALF_OPEN", "OPEN", "HALF_OPEN"] and [r[4] for r in by_time] == [1, 2, 3, 4, 5, 6, 7, 0]


def test_failure_streak_of_shuffled_batches(spark, tmp_path):
    """Calls dealt to batches in any order within the watermark give the table's rows; a later one is dropped."""
    r = random.Random(6)
    calls = [(s, 10_000 + t, r.random() < 0.3) for s in "ab" for t in sorted(r.sample(range(900), 120))]
    shuffled = r.sample(calls, len(calls))
    batches = [shuffled[k::3] for k in range(3)]
    late = [("a", 9_000, False)]
    ahead = [("b", 12_000, True)]
    got = in_batches(spark, str(tmp_path), CALLS, [*batches, ahead, late, END], lambda x: S.stream_failure_streak(x, "20 minutes"))
    assert got == sorted(map(tuple, S.failure_streak(spark.createDataFrame(calls + ahead, CALLS)).collect()), key=repr)


def test_failure_streak_over_hours(spark):
    """Streaks that go on over several hours without a success, against a walk call by call."""
    r = random.Random(4)
    calls = [(s, t, r.random() < (0.02 if s == "a" else 0.4)) for s in "ab" for t in sorted(r.sample(range(40_000), 500))]
    want = []
    for name in "ab":
        failures, last = 0, 0
        for s, t, ok in calls:
            if s == name:
                state = "CLOSED" if failures < S.OPEN_AFTER else "HALF_OPEN" if t - last >= S.RECOVERY_S else "OPEN"
                failures, last = (0 if ok else failures + 1), t
                want.append((s, t, ok, state, failures))
    got = S.failure_streak(spark.createDataFrame(calls, "service string, t_s long, ok boolean")).collect()
    assert sorted(map(tuple, got)) == sorted(want)


SAMPLES = "host string, ts timestamp, metric string, value double"


def test_health_changes(spark, tmp_path):
    rows = [("h", at(0), "rss_mb", 100.0), ("h", at(1), "disk_free_gb", 0.5), ("h", at(2), "rss_mb", 5000.0)]
    more = [("h", at(3), "disk_free_gb", 50.0), ("h", at(4), "rss_mb", 50.0)]
    got = sorted(in_batches(spark, str(tmp_path), SAMPLES, [rows, more, [("~", at(10**6), "rss_mb", 1.0)]], S.stream_health), key=lambda r: r[1])
    assert [r[2:] for r in got] == [(None, "healthy"), ("healthy", "critical"), ("critical", "warning"), ("warning", "healthy")]
    for bucket_us in (3_600_000_000, 2_000_000):
        table = S.health_changes(spark.createDataFrame(rows + more, SAMPLES), bucket_us).orderBy("t_us").collect()
        assert got == list(map(tuple, table))


def test_health_changes_of_shuffled_batches(spark, tmp_path):
    """A sample that comes late takes back no change: changes wait for it."""
    r = random.Random(8)
    rows = [(h, at(t), r.choice(["rss_mb", "disk_free_gb", "odd"]), r.choice([0.5, 3.0, 100.0, 5000.0, 9000.0])) for h in "gh" for t in sorted(r.sample(range(800), 60))]
    shuffled = r.sample(rows, len(rows))
    got = in_batches(spark, str(tmp_path), SAMPLES, [shuffled[::2], shuffled[1::2], [("~", at(10**6), "rss_mb", 1.0)]], lambda x: S.stream_health(x, "20 minutes"))
    assert got == sorted(map(tuple, S.health_changes(spark.createDataFrame(rows, SAMPLES)).collect()), key=repr)


class Merging:
    """Deliveries to a merged table below a folder."""

    def __init__(self, spark, path):
        self.spark, self.path, self.number = spark, str(path), 0

    def arrive(self, *files):
        self.number += 1
        feed(self.spark, self.path, self.number, [(1, lang, False, chunk, s, 1000 * s, 1000 * s + 500, text, at(when)) for lang, chunk, s, text, when in files], S.CHUNK_FILE)

    def run(self):
        stream = self.spark.readStream.schema(S.CHUNK_FILE).option("recursiveFileLookup", "true").parquet(f"{self.path}/in")
        S.stream_merge(stream, f"{self.path}/table", f"{self.path}/check").trigger(availableNow=True).start().awaitTermination()
        return self.rows()

    def rows(self, language="eng"):
        now = S.merged_cues(self.spark, f"{self.path}/table").where(f"language = '{language}'").orderBy("seq").collect()
        return [(r["seq"], r["start_ms"], r["text"]) for r in now]

    def folders(self):
        return {p.name for p in pathlib.Path(self.path, "table", "data").iterdir() if any(p.rglob("*.parquet"))}


def test_merge_of_arrivals(spark, tmp_path):
    m = Merging(spark, tmp_path)
    m.arrive(("eng", 1, 1, "b", 10), ("hin", 0, 1, "x", 10))
    assert m.run() == [(1, 61000, "b")] and m.rows("hin") == [(1, 1000, "x")]
    m.arrive(("eng", 0, 1, "a", 20))
    assert m.run() == [(1, 1000, "a"), (2, 61000, "b")]
    m.arrive(("eng", 0, 1, "a", 20), ("eng", 1, 1, "B", 30))
    assert m.run() == [(1, 1000, "a"), (2, 61000, "B")] and m.rows("hin") == [(1, 1000, "x")]
    for k in range(3):
        m.arrive(("eng", 2, 1, f"c{k}", 40 + k))
        assert m.run()[2] == (3, 121000, f"c{k}")
    assert len(m.folders()) <= 3  # the versions of both places, and the one that the last write has replaced


def test_merge_survives_a_lost_driver(spark, tmp_path, monkeypatch):
    """Killed after the data is written and before it becomes current, and after it has become current and before the stream knows."""
    m = Merging(spark, tmp_path)
    m.arrive(("eng", 0, 1, "a", 10))
    before = m.run()
    m.arrive(("eng", 0, 1, "A", 20), ("eng", 1, 1, "b", 20))

    def killed(self, manifest):
        raise RuntimeError("killed before")

    with monkeypatch.context() as broken:
        broken.setattr(S.VersionedTable, "commit", killed)
        with pytest.raises(Exception, match="killed before"):
            m.run()
    assert m.rows() == before and len(m.folders()) == 2  # the new version lies there and nobody reads it
    commit = S.VersionedTable.commit

    def late(self, manifest):
        commit(self, manifest)
        raise RuntimeError("killed after")

    with monkeypatch.context() as broken:
        broken.setattr(S.VersionedTable, "commit", late)
        with pytest.raises(Exception, match="killed after"):
            m.run()
    after = [(1, 1000, "A"), (2, 61000, "b")]
    assert m.rows() == after
    number = S.VersionedTable(spark, f"{m.path}/table").manifest()["number"]
    assert m.run() == after and S.VersionedTable(spark, f"{m.path}/table").manifest()["number"] == number  # the repeated batch is known
    m.arrive(("eng", 1, 1, "B", 30))
    assert m.run() == [(1, 1000, "A"), (2, 61000, "B")]


class Handle:
    """State in memory, with the number of calls to it."""

    def __init__(self):
        self.calls, self.timers = 0, []

    def state(self, *_):
        handle, held = self, {}

        class State:
            def __getattr__(self, name):
                handle.calls += 1
                return {
                    "containsKey": held.__contains__, "getValue": held.get, "removeKey": held.pop, "updateValue": held.__setitem__,
                    "exists": lambda: () in held, "get": lambda: held[()], "update": lambda v: held.__setitem__((), v),
                }[name]

        return State()

    getMapState = getValueState = state  # noqa: N815

    def registerTimer(self, until):  # noqa: N802
        self.timers.append(until)

    def getExpiryTimeInMs(self):  # noqa: N802
        return self.timers.pop(0)


def test_keys_of_a_place_share_calls(spark):
    """Keys of a place are taken together: what state is asked for goes by arrivals and stretches, not by hosts."""
    r = random.Random(9)
    rows = [(f"={h}", t, r.choice(S.NAMES), r.randrange(3)) for h in range(300) for t in r.sample(range(2_000_000_000), 5)]
    want, state = [], {}
    for k, t, metric, level in sorted(rows, key=lambda x: (x[1], x[0])):
        levels = state.setdefault(k, {})
        before = max(levels.values(), default=None)
        levels[metric] = level
        if before != max(levels.values()):
            want.append((k[1:], t, None if before is None else S.ops.SEVERITY[before], S.ops.SEVERITY[max(levels.values())]))
    handle, processor = Handle(), S.HealthProcessor(1_000_000)
    processor.init(handle)
    frame = pd.DataFrame(r.sample(rows, len(rows)), columns=["key", "t_us", "metric", "level"]).assign(t_ms=lambda x: x["t_us"] // 1000)
    for part in (frame[:700], frame[700:]):
        processor.handleInputRows((0,), iter([part]), None)
    handle.timers.sort()
    out = pd.concat([x for _ in range(len(handle.timers)) for x in processor.handleExpiredTimer((0,), None, handle)])
    assert sorted(out.itertuples(index=False, name=None)) == sorted(want) and handle.calls < 100


def test_wider_stretches_and_few_places(spark, tmp_path):
    r = random.Random(3)
    calls = [(f"s{k % 40}", 10_000 + k * 7, r.random() < 0.2) for k in range(400)]
    shuffled = r.sample(calls, len(calls))
    got = in_batches(spark, str(tmp_path), CALLS, [shuffled[::2], shuffled[1::2], END], lambda x: S.stream_failure_streak(x, "2 hours", 700, 2))
    assert got == sorted(map(tuple, S.failure_streak(spark.createDataFrame(calls, CALLS)).collect()), key=repr)


def test_rows_come_to_state_in_packs(spark, tmp_path, monkeypatch):
    """Spark hands a processor rows one by one: a task packs those of a place and stretch into one row, large ones into several."""
    r = random.Random(12)
    rows = [(f"={h}", h % 4, t, r.choice(S.NAMES), r.randrange(3)) for h in range(200) for t in r.sample(range(2_000_000_000), 10)]
    frame = pd.DataFrame(rows, columns=["key", "place", "t_us", "metric", "level"]).assign(t_ms=lambda x: x["t_us"] // 1000)
    processor = S.HealthProcessor(1_000_000)
    got = pd.concat(processor.packs(iter([frame[k : k + 300] for k in range(0, len(frame), 300)])))
    assert len(got) == len(got[["place", "until"]].drop_duplicates()) == 8
    assert all((got["t_ms"] < got["until"]) & (got["t_ms"] >= got["until"] - 1_000_000))
    monkeypatch.setattr(S, "PACK_ROWS", 100)
    monkeypatch.setattr(S, "BLOCK_BYTES", 5_000)
    assert len(list(processor.packs(iter([frame])))[0]) > 20
    out = []
    for packed in (False, True):
        handle, processor = Handle(), S.HealthProcessor(1_000_000)
        processor.init(handle)
        one = frame[frame["place"] == 1].drop(columns="place")
        processor.handleInputRows((1,), processor.packs(iter([one[:200], one[200:]])) if packed else iter([one]), None)
        handle.timers.sort()
        out.append(pd.concat([x for _ in range(len(handle.timers)) for x in processor.handleExpiredTimer((1,), None, handle)]).values.tolist())
    assert out[0] == out[1] and len(out[0]) > 100


def test_state_partitions_go_by_cores(spark):
    """The store of each shuffle partition costs every batch an opening and a commit."""
    from cuelake.plans import ops_queries

    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, "300")
    try:
        with ops_queries._rocks(spark):
            assert int(spark.conf.get(name)) == max(4, spark.sparkContext.defaultParallelism)
        assert spark.conf.get(name) == "300"
        spark.conf.unset(name)
        with ops_queries._rocks(spark):
            assert int(spark.conf.get(name)) > 0
    finally:
        spark.conf.set(name, before)


def test_times_from_1970_on(spark, tmp_path):
    calls = [("a", 0, False), ("a", 1, False), ("b", 59, True)]
    got = in_batches(spark, str(tmp_path), CALLS, [calls, END], S.stream_failure_streak)
    assert got == sorted(map(tuple, S.failure_streak(spark.createDataFrame(calls, CALLS)).collect()), key=repr)
