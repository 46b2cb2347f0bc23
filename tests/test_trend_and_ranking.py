import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from logfathom.operators.ranking import evidence_points, omitted_series, rank_series
from logfathom.operators.series import downsample, point_index
from logfathom.operators.trend import anomaly_class, trend_summary

SERIES = {
    "zeros": ["0"] * 4,
    "gaps": ["0", "7", "0", "0", "0", "2", "0", "4"],
    "pair": ["20", "90"],
    "pair_zero": ["0", "0"],
    "fractions": ["0.125", "4.118", "0", "0"],
    "late": ["0"] * 7 + ["4", "9", "11"],
    "nan": ["6", "NaN", "NaN", "12", "9"],
    "inf": ["-Inf", "3", "+Inf", "8"],
    "up": ["2", "3", "3", "6", "9", "14", "30", "41"],
    "down": ["44", "31", "12", "12", "7", "2"],
    "flat": ["15"] * 6,
    "none": ["NaN", "y", ""],
    "tiny_end": ["8", "6", "0.003"],
    "falls": ["70", "30", "0"],
    "minute": ["1e-12", "1e-12"],
}


@pytest.fixture(scope="module")
def summary(make_points):
    rows = trend_summary(make_points(SERIES), ["key"], step="5m").collect()
    return {r["key"]: r for r in rows}


@pytest.mark.parametrize(
    "key,field,expected",
    [
        ("zeros", "trend", "sparse"), ("gaps", "non_zero_pct", 37.5), ("pair", "trend", "stable"), ("pair", "avg", 55.0),
        ("pair_zero", "trend", "sparse"), ("fractions", "total", 4.24), ("fractions", "avg", 1.06), ("fractions", "peak", 4.12),
        ("fractions", "non_zero_pct", 50.0), ("late", "trend", "increasing"), ("nan", "total", 27.0), ("nan", "avg", 9.0),
        ("nan", "peak", 12.0), ("nan", "latest", 9.0), ("inf", "total", 11.0), ("up", "trend", "increasing"),
        ("down", "trend", "decreasing"), ("flat", "trend", "stable"), ("none", "trend", "sparse"), ("none", "total", 0.0),
        ("none", "peak_time", None), ("tiny_end", "anomaly", "went_silent"), ("falls", "anomaly", "went_silent"),
        ("late", "anomaly", "rising"), ("flat", "anomaly", None), ("zeros", "anomaly", None), ("flat", "avg_per_minute", 3.0),
        ("gaps", "peak_time", datetime(2024, 1, 1, 0, 5)), ("flat", "peak_time", datetime(2024, 1, 1)), ("minute", "trend", "stable"),
    ],
)
def test_summary(summary, key, field, expected):
    assert summary[key][field] == expected


def test_series_without_points(spark, make_points):
    known = spark.createDataFrame([("a",), ("ghost",)], "key string")
    rows = trend_summary(make_points({"a": ["1"]}), ["key"], series=known).collect()
    ghost = next(r for r in rows if r["key"] == "ghost")
    assert (ghost["trend"], ghost["total"], ghost["anomaly"], ghost["avg_per_minute"]) == ("sparse", 0.0, None, 0.0)


def test_anomaly_of_unused_series(spark):
    got = spark.range(1).select(anomaly_class(F.lit("sparse"), F.lit(0.0), F.lit(0.0)).alias("a")).first()["a"]
    assert got is None


def test_negative_first_third_flips_the_branches(make_points):
    row = trend_summary(make_points({"k": ["-10", "0", "-12"]}), ["key"]).first()
    assert row["trend"] == "increasing"  # -12 lies above -13


# --- ranking ---------------------------------------------------------------


def model(series, cap=20, rescue=5):
    """Kept keys in report order, by moving one rescued series at a time."""
    ordered = sorted(series, key=lambda s: (-s[1], s[0]))
    kept, below = ordered[:cap], ordered[cap:]
    for candidate in [s for s in below if s[2]][:rescue]:
        stable = [s for s in kept if not s[2]]
        if not stable:
            break
        kept.remove(stable[-1])
        kept.append(candidate)
    kept = sorted(kept, key=lambda s: (-s[1], s[0]))
    left = [s for s in ordered if s not in kept]
    return [s[0] for s in kept], [s[0] for s in left], [s[0] for s in left if s[2]]


def as_summaries(spark, groups):
    rows = [(g, k, float(t), "rising" if odd else None) for g, series in groups.items() for k, t, odd in series]
    return spark.createDataFrame(rows, "g string, key string, total double, anomaly string")


def random_groups(seed):
    rnd = random.Random(seed)
    groups = {}
    for i in range(40):
        size = rnd.choice([0, 1, 5, 19, 20, 21, 25, 26, 40, 90, 200])
        odds = rnd.choice([0.0, 0.05, 0.3, 0.9, 1.0])
        groups[f"g{i}"] = [(f"k{j:03d}", rnd.randint(0, 30), rnd.random() < odds) for j in range(size)]
    return groups


@pytest.mark.parametrize("salts", [1, 3, 64])
def test_rescue_equals_model(spark, salts):
    groups = random_groups(salts)
    ranked = rank_series(as_summaries(spark, groups), ["g"], ["key"], salts=salts).persist()
    kept = {}
    for r in ranked.where("kept").orderBy("g", "report_rank").collect():
        kept.setdefault(r["g"], []).append(r["key"])
    left = {r["g"]: r for r in omitted_series(ranked, ["g"], "key").collect()}
    for g, series in groups.items():
        if not series:
            assert g not in left
            continue
        want_kept, want_left, want_odd = model(series)
        assert kept[g] == want_kept
        row = left[g]
        assert (row["total_series"], row["omitted_series"], row["omitted_anomalous"]) == (len(series), len(want_left), len(want_odd))
        assert row["omitted_keys"] == want_left[:25]
        assert row["omitted_anomalous_keys"] == want_odd[:25]
    ranked.unpersist()


def test_no_scope(spark):
    flat = as_summaries(spark, {"all": [(f"p{i:02d}", i, False) for i in range(50)]}).drop("g")
    ranked = rank_series(flat, [], ["key"])
    kept = ranked.where("kept").orderBy("report_rank").collect()
    assert len(kept) == 20 and kept[0]["key"] == "p49" and omitted_series(ranked, [], "key").first()["omitted_series"] == 30


# --- points ----------------------------------------------------------------


@pytest.mark.parametrize("size", [1, 5, 24, 25, 30, 47, 48, 60, 719, 720])
def test_downsample(make_points, size):
    points = point_index(make_points({"k": [str(i) for i in range(size)]}), ["key"])
    got = [int(r["value"]) for r in downsample(points).orderBy("ts").collect()]
    stride = (size - 1) / 23
    want = list(range(size)) if size <= 24 else sorted({int(i * stride + 0.5) for i in range(24)})
    assert got == want and got[0] == 0 and got[-1] == size - 1


def test_point_index_over_many_days(spark):
    days = spark.range(0, 5000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), (F.col("id") % 50).cast("string"))).alias("key"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("id") * 17).cast("int"))).alias("ts"),
    )
    got = point_index(days, ["key"]).toPandas().sort_values(["key", "ts"])
    for _, group in got.groupby("key"):
        assert list(group["idx"]) == list(range(len(group))) and set(group["n_points"]) == {len(group)}


def test_evidence_only_for_the_first_series(make_points):
    points = point_index(make_points({f"k{i}": [str(i)] * 30 for i in range(8)}), ["key"])
    ranked = rank_series(trend_summary(points, ["key"]), [], ["key"])
    got = evidence_points(points, ranked, ["key"]).groupBy("key").count().collect()
    assert {(r["key"], r["count"]) for r in got} == {(f"k{i}", 24) for i in range(3, 8)}
