import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from logfathom.operators import series as ser
from logfathom.plans import reports
from logfathom.sources import logs as log_source
from logfathom.sources import payloads


def report(df):
    row = df.first()
    return row, json.loads(row["report"])


def test_logs_report(make_logs):
    rows = [(f"mail a{i}@x.com failed", {"app": "a" if i % 2 else "b", "ip": "8.8.8.8"}) for i in range(7)]
    row, body = report(reports.logs_report(make_logs(rows), limit=5, query="q", time_range="t"))
    assert (body["total_logs"], body["matched"], body["truncated"], body["direction"]) == (5, 7, True, "backward")
    assert body["top_patterns"][0]["sample"] == "mail [REDACTED_EMAIL] failed" and body["unique_labels"] == {"app": {"a": 3, "b": 4}}
    assert len(body["logs"]) == 5 and body["logs"][0] == {
        "timestamp": "2024-01-01T00:00:06.000Z", "line": "mail [REDACTED_EMAIL] failed", "labels": {"app": "b", "ip": "[REDACTED_IP]"},
    }
    assert row["form"] == "full" and row["size_bytes"] == len(row["report"].encode())


def test_logs_report_small_and_empty(make_logs):
    _, body = report(reports.logs_report(make_logs(["a", "b"])))
    assert "top_patterns" not in body and body["total_logs"] == 2
    _, body = report(reports.logs_report(make_logs(["a"]).where("false")))
    assert body["matched"] == 0 and body["warnings"] == ["no_rows"]


def test_values_made_equal_by_redaction_are_merged(make_logs):
    rows = [("x", {"who": f"u{i}@x.com"}) for i in range(20)] + [("x", {"who": "plain"})]
    _, body = report(reports.logs_report(make_logs(rows)))
    assert body["unique_labels"]["who"]["[REDACTED_EMAIL]"] in (14, 15) and body["unique_labels"]["who"]["(+6 more values)"] == 0


@pytest.mark.parametrize("budget,form", [(30_000, "full"), (2_500, "shrunk"), (200, "notice")])
def test_budget(make_logs, budget, form):
    rows = [("same start " + "y" * 900, {"k": f"v{i}"}) for i in range(30)]
    row, body = report(reports.logs_report(make_logs(rows), budget=budget))
    assert row["form"] == form and row["size_bytes"] > 2_500
    if form == "shrunk":
        assert "logs" not in body and "unique_labels" not in body and len(body["top_patterns"]) == 1
        assert body["warnings"] == ["size_budget_rows_dropped"]
    if form == "notice":
        assert body["truncated"] is True and body["original_bytes"] > 200 and body["tool"] == "logs_report"


def test_stats_report(make_points):
    points = ser.point_index(make_points({f"k{i:02d}": [str(i)] * 30 for i in range(27)}), ["key"])
    row, body = report(reports.stats_report(points, ["key"], step="5m"))
    assert (body["total_series"], body["omitted_series"], len(body["summaries"]), len(body["series"])) == (27, 7, 20, 20)
    assert body["omitted_series_keys"] == [f"key=k{i:02d}" for i in range(6, -1, -1)] and body["warnings"] == ["series_capped"]
    assert [len(s.get("values", [])) for s in body["series"]] == [24] * 5 + [0] * 15
    assert body["series"][0]["labels"] == {"key": "k26"} and body["summaries"]["key=k26"]["avg_per_minute"] == 5.2
    row, body = report(reports.stats_report(points, ["key"], step="5m", budget=6_000))
    assert row["form"] == "shrunk" and "series" not in body and len(body["summaries"]) == 20


def test_stats_report_of_nothing(make_points):
    points = ser.point_index(make_points({"k": ["1"]}), ["key"]).where("false")
    _, body = report(reports.stats_report(points, ["key"], step="5m"))
    assert body["total_series"] == 0 and body["warnings"] == ["no_rows"]


def test_label_values_report(make_logs):
    logs = make_logs([("x", {"app": f"v-{i:03d}" + "z" * 100}) for i in range(100)])
    row, body = report(reports.label_values_report(logs, "app", limit=100, budget=5_000))
    assert row["form"] == "shrunk" and len(body["values"]) == 25 and body["truncated"] and body["warnings"] == ["size_budget_values_cut"]
    _, body = report(reports.label_values_report(logs, "app", contains="nope"))
    assert body["values"] == [] and body["total_label_values"] == 100 and body["warnings"] == ["no_value_contains"]
    _, body = report(reports.label_values_report(logs, "missing"))
    assert body["total_values"] == 0 and body["values"] == []


def test_written_reports_are_json_lines(spark, make_logs, tmp_path):
    out = reports.logs_report(make_logs(["a", "b", "c"]))
    reports.write_reports(out, str(tmp_path / "r"))
    assert json.loads(spark.read.text(str(tmp_path / "r")).first()["value"])["matched"] == 3


def test_logs_round_trip_prunes_days(spark, make_logs, tmp_path):
    log_source.write_logs(make_logs(["a", "b"]), str(tmp_path / "logs"))
    back = log_source.read_logs(spark, str(tmp_path / "logs"))
    assert back.where("day = DATE'2024-01-01'").count() == 2
    assert "PartitionFilters: [isnotnull(day" in back.where("day = DATE'2024-01-01'")._jdf.queryExecution().toString()


# --- payloads --------------------------------------------------------------


def payload(kind, result):
    return json.dumps({"status": "success", "data": {"resultType": kind, "result": result, "stats": {"summary": {"execTime": 0.1}}}})


def frame(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, payload string")


def test_streams(spark):
    values = [["1704067200123456789", "hello"], ["1704067201000000000"], ["soon", "x"], ["1704067202000000000", "y" * 1600]]
    df = frame(spark, payload("streams", [{"stream": {"app": "a"}, "values": values}]), payload("matrix", []), "junk")
    rows = payloads.stream_rows(df, keep=["i"]).orderBy("ts_ns").collect()
    assert [(r["ts_ns"], r["ts"], r["labels"]) for r in rows][0] == (1704067200123456789, datetime(2024, 1, 1, 0, 0, 0, 123456), {"app": "a"})
    assert len(rows) == 2 and rows[1]["line"] == "y" * 1600


def test_matrix_and_vector(spark):
    matrix = payload("matrix", [{"metric": {"s": "x"}, "values": [[1609459200.123, "1.5"], [1609459260, "NaN"]]}])
    rows = payloads.matrix_points(frame(spark, matrix)).orderBy("pos").collect()
    assert [(r["ts"], r["value"]) for r in rows] == [(datetime(2021, 1, 1), "1.5"), (datetime(2021, 1, 1, 0, 1), "NaN")]
    vector = payload("vector", [{"metric": {}, "value": [1609459200.9, "7"]}])
    rows = payloads.vector_points(frame(spark, vector)).collect()
    assert [(r["ts"], r["value"], r["labels"]) for r in rows] == [(datetime(2021, 1, 1), "7", {})]


def test_emptiness(spark):
    full = [["1", "x"]]
    cases = [
        (payload("streams", []), True), (payload("streams", [{"stream": {}, "values": []}]), True),
        (payload("streams", [{"stream": {}, "values": []}, {"stream": {}, "values": full}]), False),
        (payload("matrix", [{"metric": {}, "values": [[1, "2"]]}]), False), (payload("vector", []), True),
        (payload("vector", [{"metric": {}, "value": [1, "2"]}]), False), (payload("other", []), True), (payload("other", [1]), False),
        (payload("streams", "oops"), True), ("not json", True), (None, True),
    ]
    got = frame(spark, *[c[0] for c in cases]).select("i", payloads.payload_empty(F.col("payload")).alias("e")).orderBy("i").collect()
    assert [r["e"] for r in got] == [c[1] for c in cases]


def test_every_record_is_a_row_or_a_reject(spark):
    good = {"stream": {"a": "1"}, "values": [["1", "x"], ["2", None]]}
    cases = [
        (payload("streams", [good]), {"good": 2}), (None, {"null_payload": 1}), ("{", {"not_json": 1}), ("", {"not_json": 1}), ("5", {"other_kind": 1}),
        (payload("vector", []), {"other_kind": 1}), (payload("streams", {}), {"no_result": 1}), (payload("streams", []), {}),
        (payload("streams", [7, good, {"stream": 3, "values": [["1", "x"]]}]), {"bad_values": 1, "good": 2, "bad_labels": 1}),
        (payload("streams", [{"values": [["1", "x"]]}, {"stream": None, "values": [["1", "x"]]}]), {"good": 2}),
        (payload("streams", [{"stream": {}, "values": [["1"], [], 5, ["x", "y"], ["1.5", "y"], [None, "y"], ["99999999999999999999", "y"]]}]), {"short_tuple": 2, "bad_tuple": 1, "bad_time": 4}),
    ]
    found = payloads.records(frame(spark, *[c[0] for c in cases]), payloads.STREAMS, keep=["i"])
    got = {}
    for r in found.collect():
        counts = got.setdefault(r["i"], {})
        counts[r["reason"] or "good"] = counts.get(r["reason"] or "good", 0) + 1
    assert [got.get(i, {}) for i in range(len(cases))] == [c[1] for c in cases]
    assert payloads.rejects(found).count() + payloads.stream_rows(frame(spark, *[c[0] for c in cases])).count() == found.count()
    points = frame(spark, payload("matrix", [{"metric": {"s": "x"}, "values": [[1, "2"], ["soon", "3"]]}]), payload("vector", [{"metric": {}, "value": [1, "2"]}, {"metric": {}}]))
    assert [r["reason"] for r in payloads.records(points, payloads.MATRIX, keep=["i"]).orderBy("i", "pos").collect()] == [None, "bad_time", "other_kind"]
    assert sorted(str(r["reason"]) for r in payloads.records(points.where("i = 1"), payloads.VECTOR).collect()) == ["None", "bad_tuple"]
