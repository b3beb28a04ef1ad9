from __future__ import annotations

import gzip
import json

import pytest
from pyspark.sql import functions as F

from updraft.operators import filters
from updraft.plans import thermals
from updraft.sources import beacons, regions, tables

LINE = "FLRDDDD24>APRS,qAS,LFNF:/094213h4712.34N/01112.34E'123/045/A=003456 !W12! id06DDDD24 -197fpm +0.5rot"


def record(raw, stamp="2026-05-25T09:42:14.117Z"):
    return json.dumps({"ts_recv": stamp, "raw": raw}, separators=(",", ":"))


def parse(spark, *lines, stamp="2026-05-25T09:42:14.117Z"):
    log = spark.createDataFrame([(stamp, line) for line in lines], "ts_recv STRING, raw STRING")
    return beacons.parse_beacons(beacons.with_receive_time(log))


def test_position_line_in_full(spark):
    (r,) = parse(spark, LINE).collect()
    assert (r.source_id, r.kind, r.aircraft_type, r.packet_h, r.packet_m, r.packet_s) == ("FLRDDDD24", "position", 1, 9, 42, 13)
    assert r.lat == pytest.approx(47 + 12.341 / 60) and r.lon == pytest.approx(11 + 12.342 / 60)
    assert r.alt_m == pytest.approx(3456 * 0.3048) and r.climb_ms == pytest.approx(-197 * 0.00508)
    assert r.speed_kmh == pytest.approx(45 * 1.852) and r.course_deg == 123.0


def test_positions_are_the_doubles_next_to_their_text(spark):
    total = range(2_808_000, 2_814_000, 7)
    lines = [LINE.replace("4712.34N", f"46{t // 10 % 6000 / 100:05.2f}N").replace("!W12!", f"!W{t % 10}0!") for t in total]
    assert sorted(r.lat for r in parse(spark, *lines).collect()) == [t / 60_000 for t in total]


def test_unused_comment_fields_are_not_read_for_observations(spark):
    log = spark.createDataFrame([("2026-05-25T09:42:14.117Z", LINE)], "ts_recv STRING, raw STRING")
    seen = thermals.log_observations(beacons.with_receive_time(log))
    plan = seen.select("source_id", "t_s", "lat", "lon", "alt_m", "aircraft_type")._jdf.queryExecution().optimizedPlan().toString()
    assert "fpm" not in plan and "make_timestamp" not in plan


def test_packet_times_that_are_none_fall_back(spark):
    times = ("235960", "240000", "236000", "235961", "000000")
    rows = beacons.gps_timestamp(parse(spark, *[LINE.replace("094213", t) for t in times])).collect()
    found = {f"{r.packet_h:02d}{r.packet_m:02d}{r.packet_s:02d}": r.gps_ts.strftime("%d %H%M%S") for r in rows}
    fallback = "25 094214"
    assert found == {"235960": "26 000000", "240000": fallback, "236000": fallback, "235961": fallback, "000000": "25 000000"}


def test_southern_and_western_positions(spark):
    line = LINE.replace("4712.34N", "4712.34S").replace("01112.34E", "01112.34W")
    (r,) = parse(spark, line).collect()
    assert r.lat == -(47 * 60_000 + 12_341) / 60_000 and r.lon == -(11 * 60_000 + 12_342) / 60_000


def test_other_lines(spark):
    rows = parse(
        spark, "# server comment", "LFNF>APRS,TCPIP*,qAC,X:/094213h4712.34NI01112.34E&/A=000700",
        "LFNF>APRS,TCPIP*,qAC,X:>094213h v0.2.6", LINE.replace("/A=003456", ""), LINE.replace("id06", "id22"),
        LINE.replace("/094213h", "!"), LINE.replace("N/", "S/").replace("E'", "W'"), "nonsense",
    ).collect()
    assert [r.kind for r in rows] == ["other", "receiver", "status", "position", "position", "position", "position", "other"]
    assert rows[0].source_id is None and rows[3].alt_m is None and rows[4].aircraft_type == 8 and rows[5].packet_h is None
    assert rows[6].lat < 0 and rows[6].lon < 0


def test_gps_time_falls_back_and_near_midnight(spark):
    late = parse(spark, LINE.replace("094213", "235958"), stamp="2026-05-26T00:00:01.900Z")
    as_is = beacons.gps_timestamp(late).first().gps_ts
    moved = beacons.gps_timestamp(late, midnight_fix=True).first().gps_ts
    assert (as_is.day, moved.day) == (26, 25)
    no_time = beacons.gps_timestamp(parse(spark, LINE.replace("/094213h", "!"))).first().gps_ts
    assert (no_time.second, no_time.microsecond) == (14, 0)


def test_log_survives_bad_lines_and_a_truncated_tail(spark, tmp_path):
    lines = [record(LINE), "{broken", record("# note"), record(LINE, "2026"), record(LINE)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\n" + record(LINE)[:40])
    whole = gzip.compress("\n".join(record(LINE + f" x{i}") for i in range(20000)).encode())
    (tmp_path / "b.jsonl.gz").write_bytes(whole[: len(whole) // 2])
    assert beacons.read_beacon_log(spark, str(tmp_path / "a.jsonl")).count() == 3
    both = [str(tmp_path / "a.jsonl"), str(tmp_path / "b.jsonl.gz")]
    with pytest.raises(Exception, match="b.jsonl.gz|end of input"):
        beacons.read_beacon_log(spark, both).count()
    log, given = beacons.read_damaged_log(spark, both)
    lines = {r.path.rsplit("/", 1)[1]: r.n_lines for r in given.collect()}
    assert log.count() >= 3 and lines["a.jsonl"] == 6 and lines["b.jsonl.gz"] < 20_000


def test_receive_hours_include_both_ends(spark):
    rows = [(f"2026-05-25T{h:02d}:59:00.000Z", LINE) for h in (6, 7, 18, 19)]
    log = beacons.with_receive_time(spark.createDataFrame(rows, "ts_recv STRING, raw STRING"))
    assert [r[0] for r in filters.hour_window(log).select(F.hour("ts_recv")).collect()] == [7, 18]


def test_watched_lines_are_found_before_the_pattern(spark, tmp_path):
    from updraft.operators import activity

    path = str(tmp_path / "log")
    spark.createDataFrame([("2026-05-25T09:42:14.117Z", LINE)], "ts_recv STRING, raw STRING").write.parquet(path)
    watch = spark.createDataFrame([(LINE.split(">")[0],), ("none",)], "source_id STRING")
    positions = activity.watchlist_positions(beacons.with_receive_time(spark.read.parquet(path)), watch)
    plan = positions._jdf.queryExecution().optimizedPlan().toString()
    # Printed from the root down: the pattern stands above the semi join.
    assert 0 < plan.index("regexp_replace") < plan.index("LeftSemi")
    assert {r.source_id: r.packets for r in positions.collect()}["none"] == 0


def test_filters_reach_the_scan_before_the_pattern(spark, tmp_path):
    path = str(tmp_path / "log")
    spark.createDataFrame([("2026-05-25T09:42:14.117Z", LINE)], "ts_recv STRING, raw STRING").write.parquet(path)
    log = beacons.with_receive_time(spark.read.parquet(path))
    plan = thermals.log_observations(log)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_replace") == 1


def test_geojson_file(spark, tmp_path):
    square = [[0, 0], [1, 0], [1, 1], [0, 0]]
    one = {"type": "FeatureCollection", "features": [
        {"properties": {"name": "A", "area": 3}, "geometry": {"type": "Polygon", "coordinates": [square]}},
        {"properties": {"name": "B"}, "geometry": {"type": "MultiPolygon", "coordinates": [[square], [square, square]]}},
    ]}
    path = tmp_path / "r.geojson"
    path.write_text(json.dumps(one, indent=1))
    got = regions.read_regions(spark, str(path), columns=("area", "terrain_type")).orderBy("ord").collect()
    assert [(r.region_id, r.area, r.terrain_type, len(r.rings)) for r in got] == [("A", "3", "", 1), ("B", "", "", 3)]
    assert regions.read_regions(spark, str(path), name="B", select_one=True).count() == 1
    with pytest.raises(Exception, match="exactly one region"):
        regions.read_regions(spark, str(path), select_one=True).collect()


def test_json_states_and_watchlist_skip_what_they_cannot_read(spark, tmp_path):
    state = {"job": "b", "last_attempt_utc": "t", "last_status": "ok", "since_utc": "s", "last_extra": {"n": "3"}}
    for name, text in (("b", json.dumps(state, indent=2)), ("a", json.dumps({**state, "job": "a"})), ("x", "{"), ("y", '{"job": "y"}')):
        (tmp_path / f"{name}.json").write_text(text)
    assert [r.job for r in tables.read_heartbeats(spark, str(tmp_path / "*.json")).collect()] == ["a", "b"]
    listed = tmp_path / "watch"
    listed.mkdir()
    (listed / "w.json").write_text(json.dumps([{"name": "n", "ogn_name": "o"}, {"name": "only"}, {"name": "m", "ogn_name": "p", "note": "q"}]))
    assert sorted((r.name, r.note) for r in tables.read_watchlist(spark, str(listed)).collect()) == [("m", "q"), ("n", "")]


def test_commented_csv(spark, tmp_path):
    (tmp_path / "s.csv").write_text("# a, comment\nsource,height_m\nstation,500\n# more\nsonde,900\n")
    got = tables.read_sounding_csv(spark, str(tmp_path / "s.csv"), "source STRING, height_m DOUBLE").collect()
    assert [tuple(r) for r in got] == [("station", 500.0), ("sonde", 900.0)]


def test_ledger_counts_empty_days_and_hides_replaced_ones(spark, tmp_path):
    path, ledger = str(tmp_path / "p"), str(tmp_path / "l")
    days = spark.createDataFrame([(1,), (2,)], "day BIGINT")
    phases = spark.createDataFrame([(1, "A")], "day BIGINT, source_id STRING")
    tables.write_phases(phases, days, path, ledger, "first")
    counts = lambda: {r.day: r.n_phases for r in spark.read.parquet(ledger).collect()}
    assert counts() == {1: 1, 2: 0}
    tables.write_phases(phases.where("day = 9"), days.where("day = 1"), path, ledger, "second")
    assert counts() == {1: 0, 2: 0} and tables.read_phases(spark, path, ledger).count() == 0


def test_single_aircraft_read_is_pushed_down(spark, tmp_path):
    fixes = spark.range(100).selectExpr("id % 2 AS day", "CAST(id % 10 AS STRING) AS source_id", "id AS t_s")
    tables.write_clean_fixes(fixes, str(tmp_path / "c"))
    one = tables.read_clean_fixes(spark, str(tmp_path / "c"), 1, "3")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert one.count() == 10 and "EqualTo(source_id,3)" in plan and "PartitionFilters: [isnotnull(day" in plan


def test_upsert_twice_keeps_one_copy(spark, tmp_path):
    grid = spark.createDataFrame([(0, 1, "a", 0, 0, 1.0), (3, 1, "a", 0, 0, 2.0)], "init_h INT, lead_h INT, var STRING, lat_i INT, lon_i INT, value DOUBLE")
    for _ in range(2):
        tables.upsert_grid(grid, str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g")).count() == 2


def test_manifest_appends_and_reads_absent_keys_as_null(spark, tmp_path):
    path = str(tmp_path / "m")
    first = spark.createDataFrame([(1, "2026-05-25T06:00:00Z", "tier1", None)], "seq BIGINT, init_utc STRING, tier STRING, decision_init_utc STRING")
    tables.append_manifest(first, path)
    tables.append_manifest(first.withColumn("seq", F.lit(2).cast("long")), path)
    assert not any("decision_init_utc" in r.value for r in spark.read.text(path).collect())
    back = tables.read_manifest(spark, path).orderBy("seq").collect()
    assert [r.seq for r in back] == [1, 2] and back[0].trigger is None


def test_day_job_reuses_the_clean_layer(spark, tmp_path):
    log = spark.createDataFrame([(f"2026-05-25T09:{i // 60:02d}:{i % 60:02d}.000Z", LINE.replace("094213", f"09{i // 60:02d}{i % 60:02d}")) for i in range(30)], "ts_recv STRING, raw STRING")
    obs = thermals.log_observations(beacons.with_receive_time(log))
    ring = [[(0.0, 40.0), (20.0, 40.0), (20.0, 50.0), (0.0, 50.0), (0.0, 40.0)]]
    layer = spark.createDataFrame([("R", 0, ring)], "region_id STRING, ord INT, rings ARRAY<ARRAY<STRUCT<lon: DOUBLE, lat: DOUBLE>>>")
    where = thermals.DayTables(*(str(tmp_path / n) for n in ("clean", "phases", "ledger")))
    days = obs.select("day").distinct()
    assert thermals.pending(days, where).count() == 1
    thermals.detect_days(obs, days, layer, where, "one")
    assert spark.read.parquet(where.clean).count() == 30 and thermals.pending(days, where).count() == 0
    assert thermals.detect_days(obs.where("false"), days, layer, where, "two").count() == 0
    assert spark.read.parquet(where.clean).count() == 30


def test_reassignment_replaces_the_regions_of_every_day(spark, tmp_path):
    where = thermals.DayTables(*(str(tmp_path / n) for n in ("clean", "phases", "ledger")))
    rows = [(d, "A", 11.0, 47.0, "old") for d in (1, 2)]
    stored = spark.createDataFrame(rows, "day BIGINT, source_id STRING, lon_centroid DOUBLE, lat_centroid DOUBLE, region_id STRING")
    tables.write_phases(stored, stored.select("day"), where.phases, where.ledger, "one")
    ring = [[(0.0, 40.0), (20.0, 40.0), (20.0, 50.0), (0.0, 50.0), (0.0, 40.0)]]
    layer = spark.createDataFrame([("new", 0, ring)], "region_id STRING, ord INT, rings ARRAY<ARRAY<STRUCT<lon: DOUBLE, lat: DOUBLE>>>")
    got = thermals.reassign_days(where, layer, "two").orderBy("day").collect()
    assert [(r.day, r.region_id) for r in got] == [(1, "new"), (2, "new")]


def test_a_day_is_cleaned_by_many_tasks(spark, tmp_path):
    """The tracks of one day keep their own partitions through the join with the days."""
    rows = [(0, k, 4 * t, 46.0 + 0.001 * t, 11.0, 1000.0) for k in range(64) for t in range(30)]
    observations = spark.createDataFrame(rows, "day LONG, source_id LONG, t_s LONG, lat DOUBLE, lon DOUBLE, alt_m DOUBLE")
    days = spark.createDataFrame([(0,), (1,)], "day LONG")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    found = thermals.clean_layer(observations, days, str(tmp_path / "c"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found.count() == 64 * 30 and "SortMergeJoin" not in plan
