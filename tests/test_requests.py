"""Reports for tables of requests."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logfathom.operators import select as sel
from logfathom.plans import requests as req

NOW = datetime(2024, 5, 1, 12, 0, 30)
ASKED = "request_id int, as_of timestamp_ntz, start_expr string, end_expr string"
M = "array<struct<name:string,op:string,value:string>>"


@pytest.fixture
def logs(make_logs):
    rows = [(f"call {i} took 5ms", {"app": "a" if i % 2 else "b", "service_name": "s"}) for i in range(60)]
    rows += [("bare line", {"app": "c"}), ("mail me@example.com now", {"app": "a", "service_name": "s", "who": "x@example.com"})]
    return make_logs(rows, start=NOW - timedelta(minutes=70), gap=timedelta(minutes=1))


def ask(spark, *rows, **columns):
    """Requests of (start, end, matchers, ...)."""
    kinds = ", ".join(f"{n} {k}" for n, k in columns.items())
    data = [(i, NOW, *r) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, f"{ASKED}, matchers {M}" + (f", {kinds}" if kinds else ""))


def reports(df):
    return {r["request_id"]: json.loads(r["report"]) for r in df.collect()}


MATCHERS = [
    [("app", "=", "a")], [("app", "=~", "a|c")], [("app", "!=", "a")], [("app", "!~", "a"), ("service_name", "=", "s")],
    [("service_name", "=", "")], [("who", "!=", "")], [("app", "=", "none")], [("app", "=", "a"), ("who", "=~", "x.*")],
]


def test_selections_as_data_equal_selections_as_code(spark, logs):
    filters = dict(contains=["call"], excludes=["call 7 "], regex=["[0-9]+ took"], not_regex=["call 1[0-4]"])
    asked = ask(spark, *[(None, None, m, *filters.values()) for m in MATCHERS], *[(None, None, m, None, None, None, None) for m in MATCHERS], (None, None, None, None, None, None, None),
                **dict.fromkeys(filters, "array<string>"))
    matched = req.match_selections(logs, req.with_selection(asked)).withColumn("k", F.to_json("selection"))
    got = {}
    for r in matched.select("id", "k").collect():
        got.setdefault(r["k"], set()).add(r["id"])
    keys = {r["request_id"]: r["k"] for r in req.with_selection(asked).select("request_id", F.to_json("selection").alias("k")).collect()}
    for i, m in enumerate(MATCHERS):
        assert got.get(keys[i], set()) == {r["id"] for r in sel.select_logs(logs, m, **filters).collect()}
        assert got.get(keys[i + len(MATCHERS)], set()) == {r["id"] for r in sel.select_logs(logs, m).collect()}
    assert got[keys[2 * len(MATCHERS)]] == {r["id"] for r in sel.select_logs(logs).collect()}
    with pytest.raises(Exception, match="unknown matcher"):
        req.match_selections(logs, req.with_selection(ask(spark, (None, None, [("app", "~", "a")])))).collect()


def test_every_window_says_what_was_done(spark, logs):
    a = [("app", "=", "a")]
    asked = ask(
        spark, (None, None, a), ("now", "2h ago", a), ("2 hours ago", "2024-06-01T00:00:00Z", a), ("now", "now", a), ("last 60 days", "", a),
        (None, "5h ago", a), ("gibberish", None, a), ("2h ago", "90m ago", a), (None, None, [("app", "=", "z")]), (None, "1h ago", a),
    )
    got = reports(req.logs_reports(logs, asked, max_hours=720))
    assert {i: r.get("warnings", []) for i, r in got.items()} == {
        0: [], 1: ["swapped"], 2: [], 3: ["defaulted_1h"], 4: ["capped_range"], 5: ["swapped"], 6: ["bad_time"],
        7: ["no_rows_explicit"], 8: ["no_rows_after_widen"], 9: ["defaulted_1h"],
    }
    assert got[2]["time_range"] == "2024-05-01T10:00:30Z to 2024-05-01T12:00:30Z" and got[8]["time_range"].startswith("2024-04-01T12:00:30Z")
    assert got[1]["matched"] == 31 and got[6]["matched"] == 0
    late = ask(spark, (None, None, a)).withColumn("as_of", F.lit(NOW + timedelta(hours=20)))
    found = reports(req.logs_reports(logs, late, max_hours=720))[0]
    assert (found["warnings"], found["matched"], found["time_range"]) == (["widened"], 31, "2024-05-01T08:00:30Z to 2024-05-02T08:00:30Z")


def test_limits_directions_and_redaction_by_request(spark, logs):
    a = [("app", "=", "a")]
    asked = ask(spark, ("2h ago", None, a, 3, "forward"), ("2h ago", None, a, 0, None), ("2h ago", None, [("who", "=", "x@example.com")], 3, "sideways"), limit="int", direction="string")
    got = reports(req.logs_reports(logs, asked))
    assert [(got[i]["total_logs"], got[i]["truncated"], got[i]["direction"]) for i in range(3)] == [(3, True, "forward"), (31, False, "backward"), (1, False, "backward")]
    assert got[0]["logs"][0]["line"] == "call 1 took 5ms" and got[1]["logs"][0]["line"] == "mail [REDACTED_EMAIL] now"
    assert "example.com" not in json.dumps(got) and "[REDACTED_EMAIL]" in got[2]["query_executed"]
    assert "x@example.com" in json.dumps(reports(req.logs_reports(logs, asked, redact=False)))


def test_statistics_by_request(spark, logs):
    s = [("service_name", "=", "s")]
    asked = ask(spark, ("2h ago", None, s, ["app"], None), ("2h ago", None, s, None, "30m"), ("2h ago", None, s, ["app", "who"], "x"), (None, None, [("app", "=", "z")], ["app"], None),
                ("zzz", None, s, ["app"], None), group_by="array<string>", step="string")
    got = reports(req.stats_reports(logs, asked))
    assert {k: v["total"] for k, v in got[0]["summaries"].items()} == {"app=a": 31.0, "app=b": 30.0} and got[0]["step"] == "1m"
    assert list(got[1]["summaries"]) == ["total"] and got[1]["step"] == "30m" and got[1]["summaries"]["total"]["total"] == 61.0
    assert got[2]["warnings"] == ["bad_step"] and len(got[2]["summaries"]) == 3 and "example.com" not in json.dumps(got[2])
    assert got[3]["warnings"] == ["no_rows_after_widen"] and got[3]["total_series"] == 0 and got[3]["series"] == []
    assert got[4]["warnings"] == ["bad_time"]


def test_labels_by_request(spark, logs):
    asked = ask(spark, (None, None, None, "app", None, None), ("20m ago", None, None, "app", None, 1), (None, None, None, "app", "B", None), (None, None, None, "app", "zz", None),
                ("?", None, None, "app", None, None), (None, None, None, None, None, None), label="string", contains_text="string", limit="int")
    names = {r["request_id"]: (r["names"], r["warnings"]) for r in req.label_names_reports(logs, asked).collect()}
    assert names[0] == (["app", "service_name", "who"], []) and names[4] == ([], ["bad_time"])
    got = {r["request_id"]: (r["values"], r["total_values"], r["total_label_values"], r["truncated"], r["warnings"]) for r in req.label_values_reports(logs, asked).collect()}
    assert got[0] == (["a", "b", "c"], 3, 3, False, []) and got[1][:2] == (["a"], 3) and got[1][3:] == (True, ["values_capped"])
    assert got[2] == (["b"], 1, 3, False, []) and got[3] == ([], 0, 3, False, ["no_value_contains"])
    assert got[4][4] == ["bad_time"] and got[5] == ([], 0, 0, False, ["label_required"])


def test_label_reports_equal_brute_force(spark, make_logs):
    """Windows that share ends, lie apart, are empty or end at a row; repeated and missing request ids; texts and limits."""
    draw = random.Random(7)
    rows = [("x", {"app": f"{draw.randrange(12)}A", **({"who": f"w{draw.randrange(40)}"} if i < 150 else {}), "none": None}) for i in range(300)]
    logs = make_logs(rows, start=NOW - timedelta(hours=10), gap=timedelta(minutes=2))
    ends = [NOW - timedelta(minutes=2 * draw.randrange(320), seconds=draw.choice((0, 0, 1))) for _ in range(40)]
    text = lambda t: t.strftime("%Y-%m-%dT%H:%M:%SZ")
    asked = [
        (draw.choice((i, i, i % 5, None)), NOW, text(draw.choice(ends)), text(draw.choice(ends)), draw.choice(("app", "app", "who", "none", None)), draw.choice((None, "", "A", "1", "W2", "zz")), draw.choice((None, 0, 1, 3)))
        for i in range(80)
    ]
    table = spark.createDataFrame(asked, f"{ASKED}, label string, contains_text string, limit int")
    at = lambda s: datetime.strptime(s, "%Y-%m-%dT%H:%M:%SZ")
    held = [(NOW - timedelta(hours=10) + timedelta(minutes=2) * i, labels) for i, (_, labels) in enumerate(rows)]
    names, values = {}, {}
    for key, _, start, end, label, part, limit in asked:
        inside = [labels for t, labels in held if at(start) <= t < at(end)]
        names.setdefault(key, set()).update(n for labels in inside for n, v in labels.items() if v is not None)
        values.setdefault((key, part, limit), set()).update(labels[label] for labels in inside if labels.get(label) is not None)

    def part_of(key, part, limit):
        hits = sorted(v for v in values[key, part, limit] if (part or "").lower() in v.lower())
        return len(hits), len(values[key, part, limit]), tuple(hits[: limit or None])

    want_values = []
    for key, *_ in asked:
        found = [] if key is None else [p for k in values if k[0] == key and values[k] and (p := part_of(*k))]
        want_values += found or [(0, 0, ())]
    got = [(r["request_id"], tuple(r["names"])) for r in req.label_names_reports(logs, table).collect()]
    assert sorted(got, key=str) == sorted(((k, tuple(sorted(names[k])) if k is not None else ()) for k, *_ in asked), key=str)
    got = [(r["total_values"], r["total_label_values"], tuple(r["values"])) for r in req.label_values_reports(logs, table).collect()]
    assert sorted(got) == sorted(want_values) and len(got) > 80


def test_label_reports_pair_no_row_with_a_window(spark, make_logs, monkeypatch):
    def refuse(*_, **__):
        raise AssertionError("rows meet windows")

    monkeypatch.setattr(req, "rows_in_windows", refuse)
    logs = make_logs([("x", {"app": str(i)}) for i in range(50)], start=NOW - timedelta(minutes=5))
    asked = ask(spark, *[("2h ago", None, None, "app", 2)] * 30, label="string", limit="int")
    assert {tuple(r["names"]) for r in req.label_names_reports(logs, asked).collect()} == {("app",)}
    assert {(tuple(r["values"]), r["total_values"]) for r in req.label_values_reports(logs, asked).collect()} == {(("0", "1"), 50)}


def test_no_requests_and_no_rows(spark, logs):
    asked = ask(spark, (None, None, [("app", "=", "a")]))
    assert req.logs_reports(logs, asked.limit(0)).count() == 0 and req.stats_reports(logs, asked.limit(0)).count() == 0
    assert reports(req.logs_reports(logs.limit(0), asked))[0]["warnings"] == ["no_rows_after_widen"]


@pytest.mark.parametrize("line, hit", [('{"status":500}', True), ('{"status":500} trailing', False), ('{"status":500},"logfathom:end-of-line"', False), ("status=500", False), ("[500]", False)])
def test_json_filter_takes_whole_lines_only(spark, line, hit):
    df = spark.createDataFrame([(line,)], "line string")
    assert df.where(sel.json_compare("status", ">=", 500)).count() == int(hit)
