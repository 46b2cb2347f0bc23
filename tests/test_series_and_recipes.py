from collections import Counter
from datetime import datetime, timedelta
from math import ceil

import pytest
from pyspark.sql import functions as F

from logfathom.operators import series as ser
from logfathom.plans import recipes

T0 = datetime(2024, 1, 1)


def seconds(t):
    return (t - T0).total_seconds()


@pytest.fixture(scope="module")
def rows():
    import random

    rnd = random.Random(5)
    out = [("hot" if rnd.random() < 0.6 else f"c{rnd.randint(0, 5)}", T0 + timedelta(seconds=rnd.randint(0, 7200))) for _ in range(600)]
    return out + [("edge", T0 + timedelta(minutes=10)), ("edge", T0 + timedelta(minutes=10, microseconds=1))]


@pytest.fixture(scope="module")
def logs(spark, rows):
    shaped = [(i, t, "line", {"app": a}) for i, (a, t) in enumerate(rows)]
    return spark.createDataFrame(shaped, "id bigint, ts timestamp_ntz, line string, labels map<string,string>")


@pytest.mark.parametrize("step,range_", [(300, None), (300, 900), (300, 120), (600, 900), (60, 420)])
def test_count_over_time(logs, rows, step, range_):
    got = {(r["app"], r["ts"]): r["value"] for r in ser.count_over_time(logs, ["app"], step, range_=range_).collect()}
    want = Counter()
    for app, t in rows:
        k = ceil(seconds(t) / step)
        while k * step - (range_ or step) < seconds(t):
            want[app, T0 + timedelta(seconds=k * step)] += 1
            k += 1
    assert got == dict(want)


def test_bounds_read_back_over_the_range(logs, rows):
    start, end = T0 + timedelta(minutes=30), T0 + timedelta(minutes=60)
    points = ser.count_over_time(logs, [], "10m", range_="30m", start=start, end=end).orderBy("ts").collect()
    want = [(end - timedelta(minutes=m), sum(end - timedelta(minutes=m + 30) < t <= end - timedelta(minutes=m) for _, t in rows)) for m in (20, 10, 0)]
    assert [(r["ts"], r["value"]) for r in points] == want


def test_rate_and_sum(logs, rows):
    points = ser.count_over_time(logs, ["app"], "10m")
    assert ser.sum_by(ser.rate(points, "10m")).groupBy().agg(F.sum("value")).first()[0] * 600 == pytest.approx(len(rows))


def test_dense_grid(logs, spark, rows):
    end = T0 + timedelta(hours=3)
    points = ser.count_over_time(logs, ["app"], "10m", start=T0, end=end)
    known = spark.createDataFrame([("ghost",), ("hot",)], "app string")
    dense = ser.dense_grid(points, ["app"], "10m", T0, end, series=known).toPandas().sort_values(["app", "ts"])
    assert set(dense["app"]) == {a for a, _ in rows} | {"ghost"}
    inside = sum(t > T0 for _, t in rows)
    assert dense["value"].sum() == inside and dense[dense.app == "ghost"]["value"].sum() == 0
    for _, g in dense.groupby("app"):
        assert list(g["idx"]) == list(range(18)) and set(g["n_points"]) == {18}
        assert list(g["ts"]) == [T0 + timedelta(minutes=10 * i) for i in range(1, 19)]


def test_topk(make_points):
    points = make_points({"a": [1, 5], "b": [1, 9], "c": [0, 7]}, "bigint")
    got = ser.topk_series(points, 2, keys=["key"]).orderBy("ts", "rank").collect()
    assert [r["key"] for r in got] == ["a", "b", "b", "c"]


def test_instant(logs, rows):
    at = T0 + timedelta(minutes=10)
    got = {r["app"]: r["value"] for r in ser.instant_counts(logs, ["app"], at, "5m").collect()}
    assert got == dict(Counter(a for a, t in rows if at - timedelta(minutes=5) < t <= at)) and got["edge"] == 1


def test_bad_spans():
    for bad in ("5x", "", "0s", -1):
        with pytest.raises(ValueError):
            ser.span_micros(bad)
    assert ser.span_micros("1h30m") == ser.span_micros(5400) == ser.span_micros(timedelta(minutes=90))


# --- recipes ---------------------------------------------------------------


def test_onset(spark):
    values = [1, 1, 1, 1, 1, 9, 9, 1]
    dense = spark.createDataFrame([("k", T0 + timedelta(minutes=i), v, i, 8) for i, v in enumerate(values)], "key string, ts timestamp_ntz, value bigint, idx bigint, n_points bigint")
    row = recipes.onset(dense, ["key"], factor=3).first()
    assert (row["onset"], row["value"], row["baseline"]) == (T0 + timedelta(minutes=5), 9, 1.0)


@pytest.mark.parametrize("gap_minutes", [1, 7, 30])
def test_recurrence_is_exact(spark, rows, gap_minutes):
    shaped = [(i, t, f"boom {a}", {"app": a}) for i, (a, t) in enumerate(rows)]
    logs = spark.createDataFrame(shaped, "id bigint, ts timestamp_ntz, line string, labels map<string,string>")
    got = sorted((r["pattern"], r["started"], r["ended"], r["rows"]) for r in recipes.recurrence(logs, gap=f"{gap_minutes}m").collect())
    want = []
    for app in {a for a, _ in rows}:
        times = sorted(t for a, t in rows if a == app)
        burst = [times[0]]
        for t in times[1:]:
            if t - burst[-1] > timedelta(minutes=gap_minutes):
                want.append((f"boom {app}", burst[0], burst[-1], len(burst)))
                burst = []
            burst.append(t)
        want.append((f"boom {app}", burst[0], burst[-1], len(burst)))
    assert got == sorted(want)


def test_restart_gap(spark):
    points = spark.createDataFrame([("k", T0 + timedelta(minutes=m), v) for m, v in ((1, 4), (2, 3), (5, 2), (6, 0), (7, 1))], "key string, ts timestamp_ntz, value bigint")
    got = [(r["last_active"].minute, r["resumed_at"].minute, r["empty_steps"]) for r in recipes.restart_gaps(points, ["key"], "1m").orderBy("ts").collect()]
    assert got == [(2, 5, 2), (5, 7, 1)]


def test_health_and_verdict(spark, make_logs):
    logs = make_logs([("x", {"app": "good"})] * 9 + [("x", {"app": "bad", "level": "error"})] * 3, start=T0 + timedelta(seconds=1))
    known = spark.createDataFrame([("good",), ("bad",), ("down",)], "app string")
    error = F.col("labels")["level"] == "error"
    health = recipes.service_health(logs, known, "app", error, start=T0, end=T0 + timedelta(hours=1))
    assert {(r["app"], r["rows"], r["errors"], r["status"]) for r in health.collect()} == {
        ("good", 9, 0, "active"), ("bad", 3, 3, "active"), ("down", 0, 0, "possibly_down"),
    }
    trends = spark.createDataFrame([("bad", "stable", 50.0)], "app string, trend string, non_zero_pct double")
    verdicts = {r["app"]: r["verdict"] for r in recipes.severity(health, trends, "app").collect()}
    assert verdicts == {"good": "healthy", "bad": "critical", "down": "silent"}


def test_blast_radius(make_logs):
    logs = make_logs([("x", {"user": f"u{i % 7}"}) for i in range(50)])
    assert recipes.blast_radius(logs, "user").first().asDict() == {"affected": 7, "rows": 50}
    assert recipes.blast_radius(logs, "user", approximate=True).first()["affected"] in (6, 7, 8)


def test_around(spark, make_logs):
    lines = make_logs(["deployed v2", "unrelated", "container x started", "rolling-update"], gap=timedelta(minutes=20))
    moments = spark.createDataFrame([("svc", T0 + timedelta(minutes=30))], "key string, onset timestamp_ntz")
    got = recipes.around(moments, recipes.deploy_lines(lines)).orderBy("id").collect()
    assert [(r["id"], r["offset_seconds"]) for r in got] == [(0, -1800.0), (2, 600.0), (3, 1800.0)]


def test_compare_and_silent(make_logs):
    rows = [("x", {"app": "a"})] * 2 + [("x", {"app": "b"})] * 6 + [("x", {"app": "a"})] * 4
    logs = make_logs(rows, gap=timedelta(minutes=1))
    cut, end = T0 + timedelta(minutes=6), T0 + timedelta(minutes=12)
    got = {r["app"]: (r["count_before"], r["count_after"], r["delta"]) for r in recipes.compare_periods(logs, ["app"], (T0, cut), (cut, end)).collect()}
    assert got == {"a": (2, 4, 0.3334), "b": (4, 2, -0.3334)}
    late = recipes.silent_series(logs, ["app"], start=T0, since=T0 + timedelta(minutes=8), end=end).collect()
    assert [(r["app"], r["rows_before"]) for r in late] == [("b", 6)]


def test_timeline_and_slow(make_logs):
    logs = make_logs(["id1 id2 ok", "id2 only", "id2 then id1 failed", "duration=12345ms", "a timeout", "fast"])
    assert [r["id"] for r in recipes.timeline(logs, ["id1", "id2"]).collect()] == [0, 2]
    assert [r["id"] for r in recipes.timeline(logs, ["id1", "id2"], failures=True).collect()] == [2]
    assert recipes.slow_patterns(logs).count() == 0
    assert recipes.slow_patterns(logs.unionByName(logs)).count() == 2
