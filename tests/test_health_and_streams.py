from __future__ import annotations

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from updraft.operators import activity, health
from updraft.session import shared_dir
from updraft.streaming import state, streams
from updraft.streaming.state import merged_rows

T0 = dt.datetime(2026, 5, 25)
ATTEMPT = "job STRING, ts TIMESTAMP, status STRING, seq BIGINT"


def attempts(spark, rows):
    return spark.createDataFrame([(j, T0 + dt.timedelta(minutes=m), s, i) for i, (j, m, s) in enumerate(rows)], ATTEMPT)


def walked_state(rows):
    """Job states by walking the attempts in order."""
    out = {}
    for job, minute, status in sorted(rows, key=lambda r: r[1]):
        before = out.get(job)
        since = before[2] if before and before[1] == status else minute
        ok = minute if status == "ok" else (before[3] if before else None)
        out[job] = (minute, status, since, ok)
    return out


def as_minutes(state):
    minute = lambda t: None if t is None else int((t - T0).total_seconds() // 60)
    return {r.job: (minute(r.last_attempt), r.last_status, minute(r.since), minute(r.last_success)) for r in state.collect()}


def test_job_state_equals_the_walk_also_when_merged(spark):
    rng = random.Random(1)
    rows = [(f"j{rng.randint(0, 8)}", m, rng.choice(["ok", "fail", "skip", "fail"])) for m in range(300)]
    assert as_minutes(health.job_state(attempts(spark, rows))) == walked_state(rows)
    old, new = health.job_state(attempts(spark, rows[:140])), attempts(spark, rows[140:])
    assert as_minutes(health.merge_job_state(old, new)) == walked_state(rows)


def test_alert_kinds_and_text(spark):
    rows = [("fresh", 590, "ok"), ("old", 0, "ok"), ("stuck", 0, "ok"), ("stuck", 10, "fail"), ("stuck", 595, "fail"), ("extra", 1, "ok")]
    limits = spark.createDataFrame([("fresh", 3600), ("old", 3600), ("stuck", 3600), ("never", 60)], "job STRING, threshold_s INT")
    state = health.job_state(attempts(spark, rows))
    found = health.alerts(state, limits, F.lit(T0 + dt.timedelta(minutes=600)))
    assert {r.job: r.kind for r in found.collect()} == {"old": "stale", "stuck": "stuck-fail", "never": "missing"}
    text = {r.job: r.text for r in health.alert_text(found).collect()}
    assert text["old"] == "[STALE] old — last attempt 10.0 h ago, threshold 1.0 h — age=600.0 min — last_ok=2026-05-25T00:00:00Z"
    assert [r.job for r in health.unexpected_jobs(state, limits).collect()] == ["extra"]


MANIFEST = "seq BIGINT, init STRING, tier STRING, fire BOOLEAN, files_ok INT, files_attempted INT"


def test_failure_does_not_block_and_a_later_success_counts(spark):
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "init STRING")
    rows = [(1, "a", "tier1", None, 0, 833), (2, "b", "tier1", None, 0, 833), (3, "b", "tier1", None, 833, 833)]
    log = spark.createDataFrame(rows, MANIFEST)
    names = lambda df: sorted(r.init for r in df.collect())
    assert names(health.has_record(keys, log, ["init"])) == ["a", "b"]
    assert names(health.has_successful_record(keys, log, ["init"])) == ["b"]


def test_pending_targets_follow_append_order(spark):
    rows = [
        (1, "x", "tier2_decision", True, 1, 1), (2, "x", "tier2_decision", True, 2, 2), (3, "x", "tier2_decision", False, 3, 3),
        (4, "y", "tier2_decision", True, 1, 1), (5, "y", "tier2", None, 0, 9), (6, "z", "tier2_decision", False, 1, 1),
    ]
    got = health.pending_targets(spark.createDataFrame(rows, MANIFEST), ["init"]).collect()
    assert [(r.init, r.seq) for r in got] == [("x", 2)]


def test_prune_classes(spark):
    local = spark.createDataFrame([("2026/05/01/06/f", 10), ("2026/05/24/06/f", 20), ("2026/13/01/06/f", 30), ("2026/05/02/06/g", 40), ("odd", 50)], "key STRING, bytes BIGINT")
    remote = spark.createDataFrame([("2026/05/01/06/f",)], "key STRING")
    got = activity.prune_candidates(local, remote, 4, F.lit("2026-05-25").cast("date")).collect()
    assert {r["class"]: (r.n_files, r.bytes) for r in got} == {"deletable": (1, 10), "recent": (1, 20), "undatable": (2, 80), "unconfirmed": (1, 40)}


def test_shared_folder_setting_is_respected(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def line(i, sender="FLR0000AA", second=0):
    lat = f"47{10 + i % 20:02d}.00N"
    return {"ts_recv": f"2026-05-25T10:{second // 60:02d}:{second % 60:02d}.{i % 9}00Z", "raw": f"{sender}>APRS,qAS,S:/10{second // 60:02d}{second % 60:02d}h{lat}/01112.00E'000/000/A=00{3000 + i} id06AAAAAA"}


def feed(path, batches):
    path.mkdir()
    for k, rows in enumerate(batches):
        (path / f"{k:03d}.json").write_text("\n".join(json.dumps(r) for r in rows))
    import os

    for k in range(len(batches)):
        os.utime(path / f"{k:03d}.json", (1_700_000_000 + k, 1_700_000_000 + k))
    return str(path)


def drained(spark, tmp_path, name, batches, files, run, read):
    """The same lines in one file, or one file per batch in the given order."""
    rows = [r for b in batches for r in b] if files == "one" else None
    order = {"one": [rows], "given": batches, "reverse": batches[::-1]}[files]
    base = tmp_path / f"{name}-{files}"
    base.mkdir()
    stream = streams.beacon_stream(spark, feed(base / "in", order), 1)
    run(stream, str(base / "out"), str(base / "cp"))
    return sorted(tuple(r) for r in read(spark, str(base / "out")).collect())


@pytest.mark.parametrize("files", ["given", "reverse"])
def test_streams_do_not_depend_on_files(spark, tmp_path, files):
    batches = [[line(i * 7 + k, f"FLR0000{k % 3}A", second=(i * 977 + k * 61) % 3600) for k in range(9)] for i in range(5)]
    ticks = spark.createDataFrame([(T0,)], "ts_recv TIMESTAMP")
    watch = spark.createDataFrame([("FLR00001A",)], "source_id STRING")
    from updraft.sources.beacons import observations, parse_beacons

    forms = {
        "health": (streams.run_health, lambda s, p: streams.stream_health(s, p, ticks)),
        "activity": (streams.run_hourly_activity, streams.stream_hourly_activity),
        "position": (lambda s, p, c: streams.run_last_position(s, watch, p, c), streams.stream_last_position),
        "consensus": (lambda s, p, c: streams.run_consensus(observations(parse_beacons(s)), p, c), streams.stream_consensus),
    }
    for name, (run, read) in forms.items():
        got = drained(spark, tmp_path, name, batches, files, run, read)
        assert got == drained(spark, tmp_path, f"{name}-all", batches, "one", run, read) and got
    folders = [p.name.split("-")[0] for p in (tmp_path / f"health-{files}" / "out").iterdir() if not p.name.startswith(".")]
    assert sorted(folders) == ["current", "run"]


def test_a_new_checkpoint_starts_from_nothing(spark, tmp_path):
    ticks = spark.createDataFrame([], "ts_recv TIMESTAMP")
    table = str(tmp_path / "out")
    read = lambda: sum(r.packets for r in streams.stream_health(spark, table, ticks).collect())
    old = feed(tmp_path / "old", [[line(i * 5 + k) for k in range(5)] for i in range(4)])
    run = lambda path, checkpoint: streams.run_health(streams.beacon_stream(spark, path, 1), table, str(tmp_path / checkpoint))
    run(old, "cp-1")
    assert read() == 20
    run(feed(tmp_path / "new", [[line(1), line(2), line(3)]]), "cp-2")
    assert read() == 3
    (tmp_path / "old" / "later.json").write_text(json.dumps(line(77)))
    run(old, "cp-1")  # goes on from its own state
    assert read() == 21
    (tmp_path / "empty").mkdir()
    run(str(tmp_path / "empty"), "cp-3")
    assert read() == 0


def test_a_checkpoint_without_its_state_is_an_error(spark, tmp_path):
    path = feed(tmp_path / "in", [[line(1)]])
    streams.stream_land(streams.beacon_stream(spark, path), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    with pytest.raises(ValueError, match="state"):
        streams.run_health(streams.beacon_stream(spark, path), str(tmp_path / "state"), str(tmp_path / "cp"))


@pytest.mark.parametrize("fails_in", ["commit", "after commit", "compact"])
def test_a_batch_that_dies_counts_once(spark, tmp_path, monkeypatch, fails_in):
    path = feed(tmp_path / "in", [[line(i * 5 + k) for k in range(5)] for i in range(5)])
    table, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    monkeypatch.setattr(state, "COMPACT_AFTER", 2)
    calls, commit = [], state.commit

    def dying(*args):
        calls.append(1)
        dies = len(calls) == (4 if fails_in == "compact" else 3)  # the second commit of every two is a compaction's
        if dies and fails_in != "after commit":
            raise OSError("the driver is lost")
        commit(*args)
        if dies:
            raise OSError("the driver is lost")

    monkeypatch.setattr(state, "commit", dying)
    run = lambda: streams.run_hourly_activity(streams.beacon_stream(spark, path, 1), table, checkpoint)
    with pytest.raises(Exception, match="driver is lost"):
        run()
    run()
    assert sum(r.n_packets for r in streams.stream_hourly_activity(spark, table).collect()) == 25


def test_a_batch_rewrites_only_the_days_it_touches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(state, "COMPACT_AFTER", 2)
    days = [[{**line(i), "ts_recv": f"2026-05-{day:02d}T10:00:0{i}.000Z"} for i in range(3)] for day in (1, 1, 2, 2, 3, 2)]
    path = feed(tmp_path / "in", days)
    table, checkpoint = tmp_path / "out", str(tmp_path / "cp")
    streams.run_hourly_activity(streams.beacon_stream(spark, path, 1), str(table), checkpoint)
    root = next(p for p in table.iterdir() if p.name.startswith("run-"))
    now = state.manifest(spark, str(root))
    assert now.deltas == [] and {b: f.lstrip("base=0") for b, f in now.bases.items()} == {"2026-05-01": "1", "2026-05-02": "5", "2026-05-03": "5"}
    assert sorted(p.name for p in root.iterdir() if p.name.startswith("base")) == ["base=0000000001", "base=0000000003", "base=0000000005"]
    assert [(str(r.day), r.n_packets) for r in streams.stream_hourly_activity(spark, str(table)).orderBy("day").collect()] == [("2026-05-01", 6), ("2026-05-02", 9), ("2026-05-03", 3)]


def test_sketches_of_hours_unite_to_days(spark, tmp_path):
    batches = [[{**line(i), "ts_recv": f"2026-05-25T{8 + i % 5:02d}:00:00.000Z", "raw": f"FLR{i * 7 % 4000:05d}>APRS:x"} for i in range(k, 12_000, 3)] for k in range(3)]
    table = str(tmp_path / "out")
    streams.run_hourly_sketches(streams.beacon_stream(spark, feed(tmp_path / "in", batches), 1), table, str(tmp_path / "cp"))
    hours, day = streams.stream_activity_estimate(spark, table), streams.stream_activity_estimate(spark, table, "day").first()
    assert day.n_packets == 12_000 and abs(day.n_aircraft - 4000) < 4000 * 0.065
    assert hours.count() == 5 and all(abs(r.n_aircraft - 800) < 800 * 0.065 for r in hours.collect())
    rows = merged_rows(spark, table, streams.SKETCH_STATE)
    assert rows.count() == 5 and max(len(r.senders) for r in rows.collect()) < 5000


def test_every_line_lands(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text(json.dumps(line(1)) + '\n{"ts_recv": "odd", "raw": "x>y:z"}\n{"raw": "no time"}\nnot json\n')
    table = str(tmp_path / "out")
    streams.stream_land(streams.beacon_lines(spark, str(source)), table, str(tmp_path / "cp")).awaitTermination()
    rows = spark.read.parquet(table).collect()
    assert len(rows) == 4 and sum(r.day is None for r in rows) == 3
    assert [r._corrupt_record for r in rows if r._corrupt_record] == ["not json"]


def test_restart_lands_only_what_is_new(spark, tmp_path):
    source = tmp_path / "in"
    path = feed(source, [[line(1), line(2)]])
    table, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    for _ in range(2):
        streams.stream_land(streams.beacon_stream(spark, path), table, checkpoint).awaitTermination()
    assert spark.read.parquet(table).count() == 2
    (source / "later.json").write_text(json.dumps(line(3)))
    streams.stream_land(streams.beacon_stream(spark, path), table, checkpoint).awaitTermination()
    assert spark.read.parquet(table).count() == 3


def test_job_state_stream_over_batches(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"j{rng.randint(0, 3)}", m, rng.choice(["ok", "fail"])) for m in range(60)]
    source = str(tmp_path / "in")
    rng.shuffle(late := list(rows))  # attempts in any order
    for part in (late[:20], late[20:45], late[45:]):
        attempts(spark, part).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(ATTEMPT).parquet(source)
        streams.run_job_state(stream, str(tmp_path / "state"), str(tmp_path / "cp"))
    assert as_minutes(streams.current_job_state(spark, str(tmp_path / "state"))) == walked_state(rows)


def test_dense_ticks_and_totals(spark):
    stamps = [T0 + dt.timedelta(seconds=s) for s in (5, 6, 500, 86_400 + 10)]
    packets = spark.createDataFrame([(s,) for s in stamps], "ts_recv TIMESTAMP")
    got = health.job_window_status(packets).orderBy("tick_start").collect()
    assert [(r.packets, r.total_packets, r.status) for r in got[:3]] == [(2, 2, "ok"), (0, 2, "fail"), (1, 3, "ok")]
    assert len(got) == 361 and got[-1].total_packets == 4


@pytest.mark.parametrize("minutes,active", [(10, True), (15, False)])
def test_active_flag(spark, minutes, active):
    rows = spark.createDataFrame([(T0, 47.0, 11.0, 1000.4, 1.26, 99.6), (None, None, None, None, None, None)], "last_seen TIMESTAMP, lat DOUBLE, lon DOUBLE, alt_m DOUBLE, climb_ms DOUBLE, speed_kmh DOUBLE")
    got = health.active_flag(rows, F.lit(T0 + dt.timedelta(minutes=minutes))).collect()
    assert [r.is_active for r in got] == [active, False] and got[0].age_min == minutes
