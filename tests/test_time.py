import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logfathom.functions import clock, timeexpr
from logfathom.operators import windows as win

NOW = datetime(2026, 3, 31, 15, 30, 20, 123456)
DAY = datetime(2026, 3, 31)

EXPRESSIONS = [
    ("", NOW), ("now", NOW), ("NOW ", NOW), ("2h ago", NOW - timedelta(hours=2)), ("30m", NOW - timedelta(minutes=30)),
    ("1d ago", NOW - timedelta(days=1)), ("3 weeks ago", NOW - timedelta(weeks=3)), ("45 sec", NOW - timedelta(seconds=45)),
    ("last 30 minutes", NOW - timedelta(minutes=30)), ("last 2w", NOW - timedelta(weeks=2)), ("last week", NOW - timedelta(days=7)),
    ("Last Night", NOW - timedelta(hours=12)), ("yesterday", NOW - timedelta(hours=24)), ("today", DAY), ("midnight", DAY),
    ("this morning", DAY + timedelta(hours=6)), ("last month", NOW - timedelta(days=28)), ("at noon", DAY + timedelta(hours=12)),
    ("yesterday at noon", DAY - timedelta(hours=12)), ("yesterday at midnight", DAY - timedelta(hours=24)),
    ("yesterday at 2pm", DAY - timedelta(hours=10)), ("yesterday at 2:30 am", DAY - timedelta(hours=21, minutes=30)),
    ("yesterday at 13pm", DAY - timedelta(hours=11)), ("yesterday at 12am", DAY - timedelta(hours=24)),
    ("yesterday at 25:00", None), ("yesterday at 10:75", None), ("2h30m", NOW - timedelta(hours=2, minutes=30)),
    ("1.5h", NOW - timedelta(minutes=90)), (".5s", NOW - timedelta(milliseconds=500)), ("-5m", NOW + timedelta(minutes=5)), ("0", NOW),
    ("1h1d", None), ("2h30m ago", None), ("2026-03-10t17:02:09z", datetime(2026, 3, 10, 17, 2, 9)),
    ("2026-03-10T17:02:09.25+02:30", datetime(2026, 3, 10, 14, 32, 9, 250000)), ("2026-02-30T00:00:00Z", None), ("2026-03-10", None),
    ("1609459200123456789", datetime(2021, 1, 1, 0, 0, 0, 123456)), ("-1000", datetime(1969, 12, 31, 23, 59, 59, 999999)),
    ("sometime soon", None), ("99999999999999999999h", None), ("5 fortnights", None),
]


def test_expressions(spark):
    rows = [(i, e[0], NOW) for i, e in enumerate(EXPRESSIONS)]
    df = spark.createDataFrame(rows, "i int, t string, now timestamp_ntz")
    got = df.select("i", timeexpr.resolve_time(F.col("t"), F.col("now")).alias("r")).orderBy("i").collect()
    assert [(e[0], r["r"]) for e, r in zip(EXPRESSIONS, got)] == [(e[0], e[1]) for e in EXPRESSIONS]


def test_month_runs_over(spark):
    """31 March minus a month is 31 February, that is 3 March."""
    assert dict(EXPRESSIONS)["last month"] == datetime(2026, 3, 3, 15, 30, 20, 123456)


def test_early_morning(spark):
    df = spark.createDataFrame([("this morning", datetime(2026, 3, 31, 5))], "t string, now timestamp_ntz")
    assert df.select(timeexpr.resolve_time(F.col("t"), F.col("now"))).first()[0] == datetime(2026, 3, 30, 6)


def test_steps(texts, spark):
    assert texts(["5m", "30s", "1h30m", "1d", "", "x", None], timeexpr.step_minutes) == [5.0, 0.5, 90.0, 0.0, 0.0, 0.0, 0.0]
    minutes = [15, 30, 60, 120, 180, 360, 480, 720, 1440]
    df = spark.createDataFrame([(m, NOW - timedelta(minutes=m), NOW) for m in minutes], "m int, s timestamp_ntz, e timestamp_ntz")
    got = [r["x"] for r in df.orderBy("m").select(timeexpr.auto_step(F.col("s"), F.col("e")).alias("x")).collect()]
    assert got == ["30s", "30s", "1m", "1m", "5m", "5m", "15m", "15m", "1h"]


def test_nano_times(texts):
    assert texts(["1609459200000000999", "x", "1.5"], lambda c: clock.nanos_to_ntz(c)) == [datetime(2021, 1, 1), None, None]


def windows(spark, rows):
    return spark.createDataFrame([(i, s, e, NOW) for i, (s, e) in enumerate(rows)], "i int, start_ts timestamp_ntz, end_ts timestamp_ntz, as_of timestamp_ntz")


def test_repair(spark):
    h = timedelta(hours=1)
    given = [(NOW - h, NOW - 2 * h), (NOW - h, NOW + h), (NOW - h, NOW - h), (NOW - 7120 * h, NOW), (NOW - 360 * h, NOW), (NOW + h, NOW + 2 * h)]
    rows = win.repair_window(windows(spark, given), max_hours=win.MAX_RANGE_HOURS).orderBy("i").collect()
    assert [(r["start_ts"], r["end_ts"], r["warnings"]) for r in rows] == [
        (NOW - 2 * h, NOW - h, ["swapped"]),
        (NOW - h, NOW, []),
        (NOW - 2 * h, NOW - h, ["defaulted_1h"]),
        (NOW - 720 * h, NOW, ["capped_range"]),
        (NOW - 360 * h, NOW, []),
        (NOW - h, NOW, ["defaulted_1h"]),
    ]


def test_defaults(spark):
    rows = [(0, None, None), (1, "", "6h ago"), (2, " ", ""), (3, "2h ago", "1h ago"), (4, "junk", "")]
    df = spark.createDataFrame([(*r, NOW) for r in rows], "i int, start_expr string, end_expr string, as_of timestamp_ntz")
    h = timedelta(hours=1)
    got = win.resolve_window(df).orderBy("i").collect()
    assert [(r["start_ts"], r["end_ts"], r["start_given"]) for r in got] == [
        (NOW - h, NOW, False), (NOW - h, NOW - 6 * h, False), (NOW, NOW, False), (NOW - 2 * h, NOW - h, True), (None, NOW, True),
    ]
    ended = win.resolve_window(df, anchor="end").orderBy("i").collect()
    assert ended[1]["start_ts"] == NOW - 7 * h
    with pytest.raises(ValueError):
        win.resolve_window(df, anchor="middle")


def widen(spark, ages_hours, given=False, start_hours=1, max_hours=win.MAX_RANGE_HOURS):
    """One request per entry: rows of its key lie so many hours before the end."""
    logs, asked = [], []
    for i, ages in enumerate(ages_hours):
        logs += [(f"k{i}", NOW - timedelta(hours=a)) for a in ages]
        asked.append((i, f"k{i}", NOW - timedelta(hours=start_hours), NOW, given))
    log_df = spark.createDataFrame(logs or [("none", NOW)], "key string, ts timestamp_ntz")
    req = spark.createDataFrame(asked, "request_id int, key string, start_ts timestamp_ntz, end_ts timestamp_ntz, start_given boolean")
    rows = win.result_warning(win.auto_widen(log_df, req, ["key"], max_hours=max_hours)).orderBy("request_id").collect()
    return [(round((NOW - r["used_start"]).total_seconds() / 3600, 3), r["widened"], r["has_rows"], r["warning"]) for r in rows]


def test_widening(spark):
    got = widen(spark, [[0.5], [3], [20], [100], [600], [1000], [], [0], [1], [6], [6.001, 700]])
    assert got == [
        (1, False, True, None), (6, True, True, "widened"), (24, True, True, "widened"), (168, True, True, "widened"),
        (720, True, True, "widened"), (720, True, False, "no_rows_after_widen"), (720, True, False, "no_rows_after_widen"),
        (720, True, False, "no_rows_after_widen"), (1, False, True, None), (6, True, True, "widened"), (24, True, True, "widened"),
    ]


def test_widening_limits(spark):
    assert widen(spark, [[3], []], given=True) == [(1, False, False, "no_rows_explicit")] * 2
    assert widen(spark, [[], [1000]], max_hours=None) == [(2160, True, False, "no_rows_after_widen"), (2160, True, True, "widened")]
    assert widen(spark, [[]], start_hours=89 * 24, max_hours=None) == [(2160, True, False, "no_rows_after_widen")]
    assert widen(spark, [[]], start_hours=1000) == [(1000, False, False, "no_rows_after_widen")]


def test_a_window_longer_than_every_rung_is_searched_whole(spark):
    assert widen(spark, [[56 * 24], [61 * 24]], given=True, start_hours=60 * 24) == [
        (1440, False, True, None), (1440, False, False, "no_rows_explicit"),
    ]


@pytest.mark.parametrize("bucket", ["7m", "1h", "1d"])
def test_rows_in_windows(spark, bucket):
    logs = [(i, NOW - timedelta(minutes=13 * i)) for i in range(300)]
    spans = [(j, NOW - timedelta(minutes=37 * j + 90), NOW - timedelta(minutes=37 * j)) for j in range(80)] + [(99, NOW, NOW)]
    log_df = spark.createDataFrame(logs, "id int, ts timestamp_ntz")
    win_df = spark.createDataFrame(spans, "w int, start_ts timestamp_ntz, end_ts timestamp_ntz")
    got = {(r["id"], r["w"]) for r in win.rows_in_windows(log_df, win_df, bucket=bucket).collect()}
    assert got == {(i, w) for i, t in logs for w, s, e in spans if s <= t < e}


@pytest.mark.parametrize("keyed", [True, False])
def test_last_match_equals_brute_force(spark, keyed):
    import random

    rnd = random.Random(11)
    stamp = lambda spread: NOW - timedelta(microseconds=rnd.choice([rnd.randint(0, spread), rnd.randint(0, 3_000_000)]))
    rows = [(rnd.choice("aab"), stamp(40 * 86_400_000_000)) for _ in range(150)] + [("a", NOW), ("b", NOW - timedelta(hours=720))]
    asked = [(i, rnd.choice("abc"), stamp(20 * 86_400_000_000)) for i in range(200)] + [(900, "a", NOW), (901, "b", NOW)]
    logs = spark.createDataFrame(rows, "key string, ts timestamp_ntz")
    requests = spark.createDataFrame(asked, "request_id int, key string, end_ts timestamp_ntz")
    on = ["key"] if keyed else []
    found = win.last_match(logs, requests, on, back_hours=720).where("last_ts IS NOT NULL")
    want = {}
    for i, key, end in asked:
        inside = [t for k, t in rows if (k == key or not keyed) and end - timedelta(hours=720) <= t < end]
        if inside:
            want[i] = max(inside)
    assert {r["request_id"]: r["last_ts"] for r in found.collect()} == want


def random_times(seed, rows=400, windows=150):
    import random

    rnd = random.Random(seed)
    stamp = lambda: NOW - timedelta(microseconds=rnd.choice([rnd.randint(0, 10**13), rnd.randint(0, 10**9), rnd.randint(0, 100)]))
    logs = [(i, rnd.choice(["a", "b", None]), stamp()) for i in range(rows)] + [(rows, "a", datetime(1969, 12, 31, 23, 59, 59)), (rows + 1, "a", None)]
    spans = [(j, rnd.choice(["a", "c", None]), *sorted([stamp(), stamp()])) for j in range(windows)]
    spans += [(windows, "a", datetime(1960, 1, 1), NOW + timedelta(days=1)), (windows + 1, "a", NOW, NOW), (windows + 2, "a", NOW, NOW - timedelta(1))]
    spans += [spans[0], (windows + 3, "a", None, NOW)]
    return logs, spans


@pytest.mark.parametrize("keyed, bucket", [(True, "1h"), (False, "1h"), (True, "1d"), (False, "7m")])
def test_windows_equal_brute_force(spark, keyed, bucket):
    logs, spans = random_times(5)
    log_df = spark.createDataFrame(logs, "id int, key string, ts timestamp_ntz")
    win_df = spark.createDataFrame(spans, "w int, key string, start_ts timestamp_ntz, end_ts timestamp_ntz")
    on = ["key"] if keyed else []
    same = lambda a, b: not keyed or (a is not None and a == b)
    inside = lambda t, s, e: t is not None and s is not None and s <= t < e
    pairs = win.rows_in_windows(log_df if keyed else log_df.drop("key"), win_df, on, bucket=bucket).select("id", "w").collect()
    assert sorted(map(tuple, pairs)) == sorted((i, w) for i, k, t in logs for w, q, s, e in spans if same(k, q) and inside(t, s, e))
    counted = win.count_in_windows(log_df, win_df, on, bucket=bucket).collect()
    assert sorted((r["w"], r["rows"]) for r in counted) == sorted((w, sum(same(k, q) and inside(t, s, e) for _, k, t in logs)) for w, q, s, e in spans)


def test_dyadic_pieces_tile_the_range(spark):
    import random

    rnd = random.Random(2)
    lengths = [1, 2, 3, 7, 64, 100, 4095, 4096, 10**6, 10**9, 2**32]
    ranges = [(i, a, a + rnd.choice(lengths)) for i, a in enumerate(rnd.randint(0, 10**10) for _ in range(200))] + [(900, 5, 5), (901, 7, 3)]
    got = {}
    for r in win.dyadic_pieces(spark.createDataFrame(ranges, "i int, a long, b long"), "a", "b").collect():
        got.setdefault(r["i"], []).append((r["__id"] << r["__level"], (r["__id"] + 1) << r["__level"]))
    assert set(got) == set(range(200))
    for i, a, b in ranges[:200]:
        runs = sorted(got[i])
        assert runs[0][0] == a and runs[-1][1] == b and all(x[1] == y[0] for x, y in zip(runs, runs[1:]))
        assert len(runs) <= 2 * max(1, (b - a).bit_length())


def test_a_busy_hour_of_many_short_windows_stays_linear(spark):
    """Forty thousand rows in one hour and a thousand one-second windows: the joins make little more than the pairs found."""
    logs = spark.range(40_000).select("id", (F.lit(NOW) + F.make_dt_interval(secs=F.col("id") * 3600 / 40_000)).cast("timestamp_ntz").alias("ts"))
    windows = spark.range(1000).select("id", (F.lit(NOW) + F.make_dt_interval(secs=(F.col("id") * 3.6).cast("decimal(18,6)"))).cast("timestamp_ntz").alias("start_ts"))
    windows = windows.select(F.col("id").alias("w"), "start_ts", (F.col("start_ts") + F.expr("INTERVAL '1' SECOND")).alias("end_ts"))
    assert 11_000 <= win.rows_in_windows(logs, windows).count() <= 12_500
    cells = windows.selectExpr("*", "unix_micros(cast(start_ts as timestamp)) div 14062500 AS a", "unix_micros(cast(end_ts as timestamp)) div 14062500 + 1 AS b")
    assert win.dyadic_pieces(cells, "a", "b").count() <= 3000


def test_widening_reads_the_log_once_and_only_the_days_asked_for(spark, tmp_path):
    from logfathom.sources import logs as log_source

    rows = [(i, NOW - timedelta(days=i), f"l{i}", {"app": "a"}) for i in range(400)]
    log_source.write_logs(spark.createDataFrame(rows, "id long, ts timestamp_ntz, line string, labels map<string,string>"), str(tmp_path / "logs"))
    logs = log_source.read_logs(spark, str(tmp_path / "logs")).select("ts", "day", F.col("labels")["app"].alias("app"))
    asked = [(1, "a", NOW - timedelta(hours=301), NOW - timedelta(hours=300), False), (2, "b", NOW - timedelta(hours=1), NOW, False)]
    requests = spark.createDataFrame(asked, "request_id int, app string, start_ts timestamp_ntz, end_ts timestamp_ntz, start_given boolean")
    widened = win.auto_widen(logs, requests, ["app"], max_hours=168)
    got = {r["request_id"]: (r["has_rows"], r["last_ts"]) for r in widened.collect()}
    assert got == {1: (True, NOW - timedelta(days=13)), 2: (False, None)}
    text = win.auto_widen(logs, requests, ["app"], max_hours=168)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in text.splitlines() if "Scan parquet" in line]
    assert len(scans) == 1 and re.search(r"PartitionFilters: \[isnotnull\(day.*ubquery", scans[0])
    assert "Exchange hashpartitioning(app" in text and text.count("Exchange hashpartitioning") - text.count("ReusedExchange") <= 2
