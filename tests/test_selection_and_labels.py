import pytest
from pyspark.sql import functions as F

from logfathom.operators import labels as lab
from logfathom.operators import select as sel
from logfathom.operators.patterns import top_patterns


def ids(df):
    return sorted(r["id"] for r in df.collect())


@pytest.fixture(scope="module")
def mixed(make_logs):
    return make_logs(
        [("a ok", {"app": "web", "env": "prod"}), ("b fail", {"app": "webapp"}), ("c FAIL", {"env": "prod"}),
         ('{"code": 503, "msg": "d"}', {"app": ""}), ('{"code": "x"}', {"app": None})]
    )


@pytest.mark.parametrize(
    "matcher,expected",
    [
        (("app", "=", "web"), [0]), (("app", "=", ""), [2, 3, 4]), (("app", "!=", "web"), [1, 2, 3, 4]), (("app", "!=", ""), [0, 1]),
        (("app", "=~", "web"), [0]), (("app", "=~", "web.*"), [0, 1]), (("app", "=~", ".*"), [0, 1, 2, 3, 4]),
        (("app", "!~", "web.+"), [0, 2, 3, 4]), (("app", "=~", "a|"), [2, 3, 4]),
    ],
)
def test_matchers(mixed, matcher, expected):
    assert ids(sel.select_logs(mixed, [matcher])) == expected


def test_line_filters(mixed):
    everything = [("nope", "=", "")]
    assert ids(sel.select_logs(mixed, everything, contains=["a"], excludes=["fail"])) == [0]
    assert ids(sel.select_logs(mixed, everything, regex=["(?i)fail"])) == [1, 2]
    assert ids(sel.select_logs(mixed, everything, not_regex=["(?i)fail|\\{"])) == [0]
    assert ids(sel.select_logs(mixed, everything, json=[("code", ">=", 500)])) == [3]


def test_time_bounds_are_half_open(mixed):
    assert ids(sel.between(mixed, "2024-01-01 00:00:01", "2024-01-01 00:00:03")) == [1, 2]


def test_default_selector_and_guards(mixed):
    assert ids(sel.select_logs(mixed, default_label="app")) == [0, 1]
    for bad in (".*", ".+"):
        with pytest.raises(ValueError):
            sel.select_logs(mixed, [("app", "=", "web")], regex=[bad])
    with pytest.raises(ValueError):
        sel.match_label("app", "==", "web")
    with pytest.raises(ValueError):
        lab.label_values(mixed, "")


def test_limits():
    assert [sel.check_limit(x) for x in (None, 7, 9999)] == [None, 7, 9999]
    for bad in (0, -3):
        with pytest.raises(ValueError):
            sel.check_limit(bad)


def test_limits_are_honoured(make_logs):
    logs = make_logs([(f"row {i}", {"app": f"a{i}"}) for i in range(1100)])
    assert [sel.take_logs(logs, limit=n).count() for n in (1000, None)] == [1000, 1100]
    assert [lab.label_values(logs, "app", limit=n).count() for n in (300, None)] == [300, 1100]
    row = sel.count_selected(logs, limit=None).first()
    assert (row["matched"], row["total_logs"], row["truncated"]) == (1100, 1100, False)


def test_order_and_sample(make_logs):
    logs = make_logs([f"row {i}" for i in range(9)])
    assert [r["id"] for r in sel.take_logs(logs, limit=2).collect()] == [8, 7]
    assert [r["id"] for r in sel.take_logs(logs, limit=2, direction="forward").collect()] == [0, 1]
    assert [r["id"] for r in sel.sample_logs(logs, direction="sideways").orderBy("rank").collect()] == [8, 7, 6, 5, 4]


def test_truncated_at_the_limit(make_logs):
    logs = make_logs(["x"] * 5)
    row = sel.count_selected(logs, limit=5).first()
    assert (row["matched"], row["total_logs"], row["truncated"]) == (5, 5, True)
    assert sel.count_selected(logs, limit=6).first()["truncated"] is False


def test_patterns(make_logs):
    lines = [f"connection timeout to 10.0.1.{i}:5432 after 30000ms" for i in range(3)] + ["NullPointer at Foo"] * 2 + ["disk full"]
    rows = top_patterns(make_logs(lines)).orderBy("rank").collect()
    assert [(r["count"], r["pct"]) for r in rows] == [(3, 50.0), (2, 33.3), (1, 16.7)]
    assert rows[0]["sample"].startswith("connection timeout to 10.0.1.2")
    assert top_patterns(make_logs(lines), direction="forward").orderBy("rank").first()["sample"].startswith("connection timeout to 10.0.1.0")


def test_pattern_cap_ties_and_minimum(make_logs):
    rows = top_patterns(make_logs([f"word{chr(97 + i)}" for i in range(15)]), k=5).orderBy("rank").collect()
    assert [r["pattern"] for r in rows] == [f"word{c}" for c in "abcde"] and rows[0]["total_patterns"] == 15
    assert top_patterns(make_logs(["a", "b"])).count() == 0


def test_skewed_scope_is_whole(spark, make_logs):
    rows = [(f"w{i}", {"app": "hot"}) for i in range(400)] + [("same", {"app": "hot"})] * 300 + [("x", {"app": f"c{i}"}) for i in range(90)]
    logs = make_logs(rows).withColumn("app", F.col("labels")["app"]).repartition(8)
    hot = top_patterns(logs, ["app"], k=3).where("app = 'hot'").orderBy("rank").collect()
    assert [(r["pattern"], r["count"], r["total_rows"], r["total_patterns"]) for r in hot][0] == ("same", 300, 700, 401)
    assert [r["pattern"] for r in hot] == ["same", "w0", "w1"]


def test_label_names(make_logs):
    logs = make_logs([("x", {"app": "a", "__name__": "n"}), ("y", {"env": "p", "gone": None})])
    assert [r["label"] for r in lab.label_names(logs).collect()] == ["app", "env"]
    assert "__name__" in [r["label"] for r in lab.label_names(logs, internal=True).collect()]


def test_label_values(make_logs):
    logs = make_logs([("x", {"app": v}) for v in ("payments-api", "PAYMENTS-worker", "orders", "gateway")])
    rows = lab.label_values(logs, "app", contains="payment").collect()
    assert sorted(r["value"] for r in rows) == ["PAYMENTS-worker", "payments-api"]
    assert (rows[0]["total_values"], rows[0]["total_label_values"], rows[0]["truncated"]) == (2, 4, False)
    many = make_logs([("x", {"app": f"v{i:03d}"}) for i in range(500)])
    capped = lab.label_values(many, "app").collect()
    assert len(capped) == 50 and capped[0]["total_values"] == 500 and capped[0]["truncated"]
    assert lab.label_values(many, "app", limit=10_000).count() == 500


def test_label_distribution(make_logs):
    logs = make_logs([("x", {"one": "same", "many": f"v{i:02d}"}) for i in range(20)] + [("x", {"many": "v05", "__in": "1"})])
    rows = lab.label_distribution(logs).orderBy("rank").collect()
    assert {r["label"] for r in rows} == {"many"} and len(rows) == 15
    assert (rows[0]["value"], rows[0]["count"], rows[0]["distinct_values"], rows[0]["omitted_values"]) == ("v05", 2, 20, 5)
