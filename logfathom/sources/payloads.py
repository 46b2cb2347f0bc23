"""Query-response payloads (JSON text, one per row) flattened to log rows or series points.

Each payload is parsed once, and every record gets a row: a good one with a null ``reason``, a bad one with what is wrong
with it, at the level where it is wrong. ``stream_rows``, ``matrix_points`` and ``vector_points`` are the good ones,
``rejects`` the others, so both together account for all that came in.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logfathom.functions.clock import nanos_to_ntz

# The kinds of result, where their labels and samples are.
STREAMS, MATRIX, VECTOR = "streams", "matrix", "vector"
PLACES = {STREAMS: ("stream", "values"), MATRIX: ("metric", "values"), VECTOR: ("metric", "value")}


def _items(doc: Column) -> Column:
    return F.try_variant_get(doc, "$.data.result", "array<variant>")


def _kind(doc: Column) -> Column:
    return F.try_variant_get(doc, "$.data.resultType", "string")


def _levels(reason: Column, good: Column, blank: Column) -> Column:
    """The items one level down, or a single blank one that carries the reason."""
    return F.when(reason.isNotNull(), F.array(blank)).otherwise(good)


def records(df: DataFrame, kind: str, payload: str = "payload", keep: Sequence[str] = ()) -> DataFrame:
    """One row per tuple: labels, pos (its place in the series), v (the tuple as texts), reason.

    Reasons: null_payload, not_json, other_kind, no_result (no array of results), bad_labels, bad_values (no array of
    tuples), bad_tuple (no array), short_tuple, bad_time. Results and series without any tuple give no row.
    """
    labels_at, values_at = PLACES[kind]
    docs = df.select(*keep, F.col(payload).isNull().alias("__none"), F.try_parse_json(F.col(payload)).alias("__doc"))
    doc = F.col("__doc")
    envelope = (
        F.when(F.col("__none"), "null_payload").when(doc.isNull(), "not_json")
        .when(~F.coalesce(_kind(doc) == kind, F.lit(False)), "other_kind").when(_items(doc).isNull(), "no_result")
    )
    nothing = F.lit(None).cast("variant")
    entries = docs.withColumn("__reason", envelope)
    entries = entries.select(*keep, "__reason", F.explode(_levels(F.col("__reason"), _items(doc), nothing)).alias("__entry"))

    raw = F.try_variant_get("__entry", f"$.{labels_at}", "variant")
    absent = raw.isNull() | F.is_variant_null(raw)
    found = F.when(absent, F.create_map().cast("map<string,string>")).otherwise(F.try_variant_get("__entry", f"$.{labels_at}", "map<string,string>"))
    if kind == VECTOR:
        values = F.array(F.try_variant_get("__entry", f"$.{values_at}", "variant"))
    else:
        values = F.try_variant_get("__entry", f"$.{values_at}", "array<variant>")
    series = entries.withColumn("labels", found).withColumn("__values", values)
    wrong = F.coalesce(F.col("__reason"), F.when(F.col("labels").isNull(), "bad_labels"), F.when(F.col("__values").isNull(), "bad_values"))
    series = series.withColumn("__reason", wrong)
    tuples = series.select(*keep, "__reason", "labels", F.posexplode(_levels(F.col("__reason"), F.col("__values"), nothing)).alias("pos", "__v"))

    shaped = tuples.withColumn("v", F.try_variant_get("__v", "$", "array<string>"))
    first = F.get("v", 0)
    if kind == STREAMS:
        timed = first.rlike(r"\A[+-]?[0-9]+\z") & first.try_cast("bigint").isNotNull()
    else:
        timed = first.try_cast("double").isNotNull()
    reason = F.coalesce(
        F.col("__reason"), F.when(F.col("v").isNull(), "bad_tuple"), F.when(F.size("v") < 2, "short_tuple"),
        F.when(~F.coalesce(timed, F.lit(False)), "bad_time"),
    )
    return shaped.select(*keep, "labels", "pos", "v", reason.alias("reason"))


def rejects(found: DataFrame) -> DataFrame:
    """The ``records`` that can't be used, with the reason."""
    return found.where("reason IS NOT NULL")


def stream_rows(df: DataFrame, payload: str = "payload", keep: Sequence[str] = ()) -> DataFrame:
    """Stream payloads to log rows. Tuples with under two items or a non-integer time are rejects; lines stay whole."""
    rows = records(df, STREAMS, payload, keep).where("reason IS NULL")
    nanos, line = F.get("v", 0).cast("bigint"), F.coalesce(F.get("v", 1), F.lit(""))
    return rows.select(*keep, nanos.alias("ts_ns"), nanos_to_ntz(nanos).alias("ts"), line.alias("line"), "labels")


def _points(found: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Sample pairs to points; the time is cut to whole seconds and the value stays text."""
    seconds = F.get("v", 0).try_cast("double").cast("bigint")
    ts = F.timestamp_seconds(seconds).cast("timestamp_ntz")
    return found.where("reason IS NULL").select(*keep, "labels", "pos", ts.alias("ts"), F.get("v", 1).alias("value"))


def matrix_points(df: DataFrame, payload: str = "payload", keep: Sequence[str] = ()) -> DataFrame:
    """Range results: one row per point, ``pos`` its place in the series."""
    return _points(records(df, MATRIX, payload, keep), keep)


def vector_points(df: DataFrame, payload: str = "payload", keep: Sequence[str] = ()) -> DataFrame:
    """Instant results: each sample is a series of one point."""
    return _points(records(df, VECTOR, payload, keep), keep)


def payload_empty(payload: Column) -> Column:
    """True when a payload holds no rows; unreadable results count as empty."""

    def filled(doc: Column) -> Column:
        tuples = F.exists(_items(doc), lambda e: F.size(F.try_variant_get(e, "$.values", "array<variant>")) > 0)
        return F.when(_kind(doc).isin(STREAMS, MATRIX), tuples).otherwise(F.size(_items(doc)) > 0)

    # bound once: the text is parsed a single time
    found = F.get(F.transform(F.array(F.try_parse_json(payload)), filled), 0)
    return ~F.coalesce(found, F.lit(False))
