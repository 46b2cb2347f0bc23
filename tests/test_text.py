import pytest
from pyspark.sql import functions as F

from logfathom.functions import numbers, text
from logfathom.operators.patterns import count_patterns, with_pattern

MESSAGES = [
    ('{"severity":3,"message":"disk sda1 is full"}', "disk sda1 is full"),
    ('{"msg":"","severity":3}', '{"msg":"","severity":3}'),
    ('{"log":"worker 4 left\\r\\n","tty":false}', "worker 4 left"),
    ('{"severity":3,"err":{"msg":"no route","at":["f","g"]}}', "no route"),
    ('{"error":{"message":"","num":7}}', '{"error":{"message":"","num":7}}'),
    ('{"reason":"came later","msg":"came first"}', "came first"),
    ('{"error":{"message":"inside"},"detail":"outside"}', "outside"),
    ("unit=pump msg=overheated zone=3", "overheated"),
    ('errmsg="a longer name" unit=pump', 'errmsg="a longer name" unit=pump'),
    ('last_error=none error="valve stuck" unit=pump', "valve stuck"),
    ('{"msg":"a"} tail', '{"msg":"a"} tail'),
    ('{"msg":"a"},{"b":1}', '{"msg":"a"},{"b":1}'),
    ('{"msg":"a"}] x', '{"msg":"a"}] x'),
    ('{"msg":"a"}] , [{"b":1}', '{"msg":"a"}] , [{"b":1}'),
    ('{"msg":"a"}}', '{"msg":"a"}}'),
    ("{bad msg=x", "{bad msg=x"),
    ('{"msg":"a","msg":"b"}', "b"),
    ('{"msg":5}', '{"msg":5}'),
    ('{"msg":5,"err":"text"}', "text"),
    ('{"msg":"\\n"}', ""),
    ("msg= x msg=y", "msg= x msg=y"),
    ('msg="" a=b', 'msg="" a=b'),
    ('msg="" error=boom', "boom"),
    ('msg="open end', "open end"),
    ("a=1\tmsg=tabbed\tb=2", "tabbed\tb=2"),
    ("reason=why detail=more", "why"),
    (" \t padded  \n", "padded"),
    ("   ", ""),
    ("plain words", "plain words"),
]


def test_messages(spark):
    df = spark.createDataFrame([(i, m[0]) for i, m in enumerate(MESSAGES)], "id int, line string")
    got = [r["message"] for r in text.with_message(df).orderBy("id").collect()]
    assert got == [m[1] for m in MESSAGES]


SIGNATURES = [
    ("connection timeout to 10.0.1.5:5432 after 30000ms", "connection timeout to <*> after 30000ms"),
    ("user 3f2b8c1a-1234-4abc-9def-0123456789ab failed", "user <*> failed"),
    ("at 2024-01-05T10:11:12.5Z done", "at <*> done"),
    ("at 2024-01-05 10:11:12, done", "at <*>, done"),
    ("ptr 0xdeadbeef end", "ptr <*> end"),
    ("10.0.0.1:99x", "<*>:99x"),
    ("id 123456 code 1234", "id <*> code 1234"),
    ("12345:67890", "<*>"),
    ("12345:67890:12345", "<*>:<*>"),
    ("é12345 x12345 12345é", "é<*> x12345 <*>é"),
]


def test_signatures(texts):
    assert texts([c[0] for c in SIGNATURES], text.signature) == [c[1] for c in SIGNATURES]


def test_patterns_are_cut_for_display_only(texts, make_logs):
    assert texts(["b" * 198 + "é" + "more", "b" * 197 + "éé"], text.cap_short) == ["b" * 198 + "é...", "b" * 197 + "é..."]
    assert texts(["b" * 300], text.signature) == ["b" * 300]
    counted = count_patterns(make_logs(["b" * 250 + end for end in "xyyz"])).collect()
    assert sorted(r["count"] for r in counted) == [1, 1, 2]


@pytest.mark.parametrize("limit,expected", [(3, "abc"), (4, "abc"), (5, "abc"), (6, "abc€"), (9, "abc€def"), (0, "")])
def test_byte_cut(texts, limit, expected):
    assert texts(["abc€def"], lambda c: text.cut_bytes(c, limit)) == [expected]


def test_byte_cut_of_four_byte_characters(texts):
    assert [texts(["😀😀"], lambda c, n=n: text.cut_bytes(c, n))[0] for n in (3, 4, 7, 8)] == ["", "😀", "😀", "😀😀"]


def test_line_cap(texts):
    assert texts(["x" * 1500, "x" * 1501], text.cap_line) == ["x" * 1500, "x" * 1500 + text.LINE_CAP_MARK]


def test_series_key(spark):
    rows = [({"service": "payments", "level": "error"},), ({},), ({"a": None, "b": "1"},)]
    df = spark.createDataFrame(rows, "labels map<string,string>")
    assert [r[0] for r in df.select(text.series_key(F.col("labels"))).collect()] == ["level=error,service=payments", "total", "b=1"]
    flat = spark.createDataFrame([("payments", "error"), (None, None)], "service string, level string")
    assert [r[0] for r in flat.select(text.column_key(["service", "level"])).collect()] == ["level=error,service=payments", "total"]


def test_strict_double(texts):
    given = ["5", "-1.5e3", ".5", "5.", "0x1p4", " 5", "5 ", "5d", "5f", "NaN", "+Inf", "1e400", "", "1_000", "1e", None]
    assert texts(given, numbers.strict_double) == [5.0, -1500.0, 0.5, 5.0, 16.0] + [None] * 11


def test_rounding_scales_first(spark):
    df = spark.createDataFrame([(1.005,), (2.675,), (-0.125,), (0.125,)], "x double")
    assert [r[0] for r in df.select(numbers.round_scaled(F.col("x"), 2)).collect()] == [1.0, 2.68, -0.13, 0.13]


def test_pattern_of_mixed_shapes_is_one(make_logs):
    logs = make_logs(['{"log":"db down\\n","stream":"stderr"}', '{"msg":"db down"}', 'msg="db down"', "db down"])
    assert with_pattern(logs).select("pattern").distinct().count() == 1
