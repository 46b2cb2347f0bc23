"""Line shaping: byte caps, message extraction, signatures, series keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Caps and markers of the reports.
LINE_CAP_BYTES = 1500
LINE_CAP_MARK = "…[truncated]"
SHORT_CAP_BYTES = 200
SHORT_CAP_MARK = "..."
PLACEHOLDER = "<*>"
NO_LABELS_KEY = "total"

# Where a message is looked for, in priority order.
JSON_MESSAGE_KEYS = ("msg", "message", "error", "err", "log", "error_message", "reason", "detail")
JSON_NESTED_KEYS = ("error", "err")
JSON_INNER_KEYS = ("message", "msg")
LOGFMT_MESSAGE_KEYS = ("msg", "message", "error", "err", "error_message", "reason", "detail")

# The volatile parts of a message. Boundaries are spelled out over
# ASCII word characters because Java's \b also counts accented letters.
_UUID = r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
_IPV4 = r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?::[0-9]+)?"
_DATE_TIME = r"[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}[^\t\n\f\r ]*"
_HEX = r"0x[0-9a-f]+"
_LONG_NUMBER = r"[0-9]{5,}"
WORD = "[0-9A-Za-z_]"
NOT_AFTER_WORD = f"(?<!{WORD})"
NOT_BEFORE_WORD = f"(?!{WORD})"
_ANY_BOUNDARY = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
VOLATILE = (
    f"{NOT_AFTER_WORD}(?:{_UUID}{NOT_BEFORE_WORD}|{_IPV4}{NOT_BEFORE_WORD}|{_DATE_TIME}{_ANY_BOUNDARY}"
    f"|{_HEX}{NOT_BEFORE_WORD}|{_LONG_NUMBER}{NOT_BEFORE_WORD})"
)

_SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

# Closes the array a JSON line is wrapped in; absent when text follows the object.
_SENTINEL = "logfathom:end-of-line"


def trim_space(text: Column) -> Column:
    """Strip Unicode white space from both ends (plain ``trim`` strips only blanks)."""
    return F.btrim(text, F.lit(_SPACES))


def cut_bytes(text: Column, limit: int) -> Column:
    """At most ``limit`` UTF-8 bytes, never splitting a code point."""
    raw = F.encode(text, "UTF-8")
    cuts = [F.try_validate_utf8(F.substring(raw, 1, limit - back).cast("string")) for back in range(min(4, limit + 1))]
    return F.when(F.octet_length(text) > limit, F.coalesce(*cuts)).otherwise(text)


def _capped(text: Column, limit: int, mark: str) -> Column:
    return F.when(F.octet_length(text) > limit, F.concat(cut_bytes(text, limit), F.lit(mark))).otherwise(text)


def cap_line(line: Column) -> Column:
    return _capped(line, LINE_CAP_BYTES, LINE_CAP_MARK)


def cap_short(text: Column) -> Column:
    return _capped(text, SHORT_CAP_BYTES, SHORT_CAP_MARK)


def signature(message: Column) -> Column:
    """The whole message with ids, addresses, times and long numbers replaced. ``cap_short`` cuts it for display."""
    masked = F.regexp_replace(message, VOLATILE, PLACEHOLDER)
    pair = f"{PLACEHOLDER}:{PLACEHOLDER}"
    return F.replace(masked, F.lit(pair), F.lit(PLACEHOLDER))


def logfmt_value(line: Column, key: str) -> Column:
    """Value of the first ``key=`` that starts the line or follows a blank or tab; '' when empty or absent."""
    found = rf'(?:\A|[ \t]){key}=(?:"([^"]*)|([^ ]*))'
    value = F.concat(F.regexp_extract(line, found, 1), F.regexp_extract(line, found, 2))
    return F.when(F.contains(line, F.lit(f"{key}=")), value).otherwise(F.lit(""))


def _filled(text: Column) -> Column:
    return F.when(text != "", text)


def _variant_text(doc: Column, path: str) -> Column:
    """A non-empty JSON string at ``path``; numbers, objects and '' give NULL."""
    is_text = F.schema_of_variant(F.try_variant_get(doc, path, "variant")) == "STRING"
    return F.when(is_text, _filled(F.try_variant_get(doc, path, "string")))


def whole_json(text: Column) -> Column:
    """A text parsed as the first of two array items; ``is_whole`` tells whether nothing but JSON stood there."""
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{_SENTINEL}"]')))


def is_whole(doc: Column) -> Column:
    second = F.try_variant_get(doc, "$[1]", "string") == _SENTINEL
    return F.coalesce(second, F.lit(False)) & F.try_variant_get(doc, "$[2]", "variant").isNull()


def with_message(df: DataFrame, line: str = "line", out: str = "message") -> DataFrame:
    """Add the human message of each line: JSON field, logfmt field, or the trimmed line itself.

    Three projections so that the trim and the JSON parse happen once per row.
    """
    trimmed, doc = f"__{out}_line", f"__{out}_doc"
    text = F.col(trimmed)
    wrapped = F.concat(F.lit("["), text, F.lit(f',"{_SENTINEL}"]'))
    json_like = text.startswith("{")
    staged = df.withColumn(trimmed, trim_space(F.col(line)))
    staged = staged.withColumn(doc, F.when(json_like & text.endswith("}"), F.try_parse_json(wrapped)))

    v = F.col(doc)
    whole = F.try_variant_get(v, "$[1]", "string") == _SENTINEL
    top = [F.rtrim(_variant_text(v, f"$[0].{k}"), F.lit("\n\r")) for k in JSON_MESSAGE_KEYS]
    nested = [_variant_text(v, f"$[0].{k}.{i}") for k in JSON_NESTED_KEYS for i in JSON_INNER_KEYS]
    from_json = F.coalesce(F.when(whole, F.coalesce(*top, *nested)), text)
    from_logfmt = F.coalesce(*[_filled(logfmt_value(text, k)) for k in LOGFMT_MESSAGE_KEYS], text)
    return staged.withColumn(out, F.when(json_like, from_json).otherwise(from_logfmt)).drop(trimmed, doc)


def series_key(labels: Column) -> Column:
    """``k=v`` pairs sorted and joined by a comma. For display: group by the labels, not by this text."""
    present = F.filter(F.map_entries(labels), lambda e: e["value"].isNotNull())
    pairs = F.sort_array(F.transform(present, lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return F.coalesce(_filled(F.array_join(pairs, ",")), F.lit(NO_LABELS_KEY))


def column_key(names: list[str]) -> Column:
    """``series_key`` for labels held in flat columns; NULL columns are absent labels."""
    if not names:
        return F.lit(NO_LABELS_KEY)
    parts = [F.when(F.col(n).isNotNull(), F.concat(F.lit(f"{n}="), F.col(n).cast("string"))) for n in names]
    pairs = F.sort_array(F.array_compact(F.array(*parts)))
    return F.coalesce(_filled(F.array_join(pairs, ",")), F.lit(NO_LABELS_KEY))
