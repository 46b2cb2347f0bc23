"""DuckDB SQL for the registered queries, written from the tables and not from the Spark code."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

# Event rows with their message, line and pattern derived from the columns.
EV = r"""
ev AS (
  SELECT *, CASE event_id % 4
    WHEN 0 THEN '{"status":' || (event_id % 600) || ',"msg":"' || msg || '\n"}'
    WHEN 1 THEN 'level=info msg="' || msg || '" user_id=' || user_id
    WHEN 2 THEN msg
    ELSE '{"error":{"message":"' || msg || '"},"status":' || (event_id % 600) || '}' END AS line,
    told || ' for item <*> on node ' || (user_id % 7) || ' from <*> after 30000ms' AS pattern
  FROM (
    SELECT event_id, ts, user_id, CAST(user_id AS VARCHAR) AS uid, event_type, value, told,
      told || ' for item ' || (event_id + 100000) || ' on node ' || (user_id % 7)
        || ' from 10.0.' || (user_id % 200) || '.' || (event_id % 250) || ':5432 after 30000ms' AS msg
    FROM (SELECT *, event_type || CASE event_type WHEN 'signup' THEN ' started' WHEN 'purchase' THEN ' slow'
                                   WHEN 'error' THEN ' timeout' ELSE '' END AS told FROM events)
  )
)"""

ORD = """
ord AS (
  SELECT o_orderkey AS id, o_orderdate AS ts, o_orderstatus AS status, o_orderpriority AS priority,
    'order ' || o_orderkey || ' moved to ' || o_orderstatus || ' at ' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || 'Z' AS line,
    'order ' || CASE WHEN o_orderkey >= 10000 THEN '<*>' ELSE CAST(o_orderkey AS VARCHAR) END
      || ' moved to ' || o_orderstatus || ' at <*>' AS pattern
  FROM orders
)"""

START, END, MIDDLE = "TIMESTAMP '2024-01-01'", "TIMESTAMP '2024-01-31'", "TIMESTAMP '2024-01-16'"


def r(x: str, digits: int = 2) -> str:
    return f"(round(({x}) * {10**digits}) / CAST({10**digits} AS DOUBLE))"


def ceil_ts(step_seconds: int, ts: str = "ts") -> str:
    s = step_seconds * 1_000_000
    return f"make_timestamp(((epoch_us({ts}) + {s - 1}) // {s}) * {s})"


# --- selection -------------------------------------------------------------

ORACLES["log_select_errors"] = f"""
WITH {EV} SELECT event_id AS id, ts, line, event_type FROM ev
WHERE event_type = 'error' AND contains(line, 'node 3') AND contains(line, '10.0.') AND NOT contains(line, '10.0.17.')
  AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20'"""

ORACLES["label_matchers"] = """
SELECT event_id AS id, event_type, CAST(user_id AS VARCHAR) AS user_id FROM events
WHERE event_type <> 'view' AND user_id BETWEEN 10 AND 99 AND user_id NOT BETWEEN 10 AND 19"""

ORACLES["default_selector"] = "SELECT o_orderpriority AS priority, count(*) AS n FROM orders WHERE o_orderpriority <> '' GROUP BY 1"

ORACLES["line_regex_select"] = f"""
WITH {EV} SELECT event_id AS id, ts, line FROM ev
WHERE event_type IN ('error', 'click') AND user_id % 7 <= 3 AND left(CAST(user_id % 200 AS VARCHAR), 1) <> '1'
  AND event_id % 4 IN (0, 3) AND event_id % 600 >= 300"""

ORACLES["count_selected"] = """
SELECT CAST(user_id AS VARCHAR) AS user_id, count(*) AS matched, least(count(*), 70) AS total_logs, count(*) >= 70 AS truncated
FROM events GROUP BY 1"""

ORACLES["take_newest"] = f"""
WITH {EV} SELECT event_id AS id, ts, line FROM ev WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 50"""

ORACLES["take_oldest_by_scope"] = """
SELECT event_type, CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS INTEGER) AS rank, event_id AS id, ts
FROM events QUALIFY rank <= 20"""

ORACLES["sample_logs"] = f"""
WITH {EV} SELECT uid AS user_id, CAST(row_number() OVER (PARTITION BY uid ORDER BY ts DESC, event_id DESC) AS INTEGER) AS rank,
  event_id AS id, ts, line FROM ev QUALIFY rank <= 5"""

# --- text ------------------------------------------------------------------

ORACLES["extract_message"] = f"WITH {EV} SELECT event_id AS id, msg AS message FROM ev"
ORACLES["message_signature"] = f"WITH {ORD} SELECT id, pattern FROM ord"

_VOLATILE = (
    r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b|\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(:\d+)?\b"
    r"|\b\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}[^\s]*\b|\b0x[0-9a-f]+\b|\b\d{5,}\b"
)


def cut(text: str, limit: int) -> str:
    """Longest prefix of at most ``limit`` bytes, found by trying prefix lengths around the byte limit."""
    tries = f"list_filter(range({limit // 4}, {limit + 1}), lambda n: strlen(left({text}, CAST(n AS INTEGER))) <= {limit})"
    return f"left({text}, CAST(list_max({tries}) AS INTEGER))"


ORACLES["document_signatures"] = rf"""
WITH lines AS (
  SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no,
    regexp_replace(parts[i], '^[\s\x{{85}}\x{{A0}}\x{{2000}}-\x{{200A}}\x{{3000}}]+|[\s\x{{85}}\x{{A0}}\x{{2000}}-\x{{200A}}\x{{3000}}]+$', '', 'g') AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents), unnest(range(1, len(parts) + 1)) AS u(i)
), masked AS (
  SELECT doc_id, line_no, replace(regexp_replace(line, '{_VOLATILE}', '<*>', 'g'), '<*>:<*>', '<*>') AS p FROM lines
)
SELECT doc_id, line_no, p AS pattern FROM masked"""

ORACLES["cap_long_lines"] = f"""
SELECT doc_id, CASE WHEN strlen(text) > 1500 THEN {cut("text", 1500)} || '…[truncated]' ELSE text END AS capped,
  CASE WHEN strlen(text) > 203 THEN {cut("text", 203)} ELSE text END AS short
FROM documents"""

ORACLES["series_keys"] = """
SELECT 'event_type=' || event_type || ',user_id=' || user_id AS series, count(*) AS n FROM events GROUP BY 1"""

ORACLES["nano_times"] = "SELECT event_id, epoch_us(ts) * 1000 AS ts_ns, ts FROM events"

# --- patterns --------------------------------------------------------------

ORACLES["top_error_patterns"] = f"""
WITH {EV}, g AS (SELECT pattern, count(*) AS count, arg_max(msg, ts) AS sample FROM ev WHERE event_type = 'error' GROUP BY 1)
SELECT CAST(row_number() OVER (ORDER BY count DESC, pattern) AS INTEGER) AS rank, pattern, count,
  round(count / CAST(sum(count) OVER () AS DOUBLE) * 1000) / 10 AS pct, sample,
  CAST(sum(count) OVER () AS BIGINT) AS total_rows, count(*) OVER () AS total_patterns
FROM g QUALIFY rank <= 10"""

ORACLES["top_patterns_by_scope"] = f"""
WITH {ORD}, g AS (
  SELECT status, pattern, count(*) AS count, arg_min(line, ts + to_microseconds(id)) AS sample FROM ord GROUP BY 1, 2)
SELECT status, CAST(row_number() OVER (PARTITION BY status ORDER BY count DESC, pattern) AS INTEGER) AS rank, pattern, count,
  round(count / CAST(sum(count) OVER (PARTITION BY status) AS DOUBLE) * 1000) / 10 AS pct, sample,
  CAST(sum(count) OVER (PARTITION BY status) AS BIGINT) AS total_rows, count(*) OVER (PARTITION BY status) AS total_patterns
FROM g QUALIFY rank <= 5"""

ORACLES["pattern_counts"] = f"WITH {EV} SELECT pattern, count(*) AS count FROM ev GROUP BY 1"

# --- labels ----------------------------------------------------------------

ORACLES["label_names"] = """
SELECT DISTINCT unnest(['event_type', 'user_id']) AS label FROM events
WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-31'"""

ORACLES["label_values"] = """
WITH v AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS value FROM events)
SELECT CAST(row_number() OVER (ORDER BY value) AS INTEGER) AS rank, value, count(*) OVER () AS total_values,
  (SELECT count(*) FROM v) AS total_label_values, count(*) OVER () > 10 AS truncated
FROM v WHERE contains(value, '1') QUALIFY rank <= 10"""

ORACLES["label_values_of_selection"] = f"""
WITH v AS (
  SELECT DISTINCT event_type, CAST(user_id AS VARCHAR) AS value FROM events
  WHERE event_type IN ('error', 'view') AND ts >= {START} AND ts < {MIDDLE})
SELECT event_type, CAST(row_number() OVER (PARTITION BY event_type ORDER BY value) AS INTEGER) AS rank, value,
  count(*) OVER (PARTITION BY event_type) AS total_values, count(*) OVER (PARTITION BY event_type) AS total_label_values,
  count(*) OVER (PARTITION BY event_type) > 50 AS truncated
FROM v QUALIFY rank <= 50"""


def distribution(scope: str, top: int) -> str:
    s = f"{scope}, " if scope else ""
    day = "strftime(ts, '%Y-%m-%d') AS day, " if scope else ""
    return f"""
WITH pairs AS (
  SELECT {day}'event_type' AS label, event_type AS value FROM events
  UNION ALL SELECT {day}'user_id', CAST(user_id AS VARCHAR) FROM events
), c AS (SELECT {s}label, value, count(*) AS count FROM pairs GROUP BY ALL)
SELECT {s}label, CAST(row_number() OVER (PARTITION BY {s}label ORDER BY count DESC, value) AS INTEGER) AS rank, value, count,
  count(*) OVER (PARTITION BY {s}label) AS distinct_values,
  greatest(count(*) OVER (PARTITION BY {s}label) - {top}, 0) AS omitted_values
FROM c QUALIFY rank <= {top} AND distinct_values > 1"""


ORACLES["label_distribution"] = distribution("", 15)
ORACLES["label_distribution_by_scope"] = distribution("day", 3)

# --- series ----------------------------------------------------------------

ORACLES["count_over_time"] = f"SELECT event_type, {ceil_ts(3600)} AS ts, count(*) AS value FROM events GROUP BY 1, 2"

ORACLES["sliding_count"] = f"""
SELECT event_type, t AS ts, count(*) AS value
FROM events e JOIN (SELECT unnest(generate_series({START} + INTERVAL 1 HOUR, {MIDDLE}, INTERVAL 1 HOUR)) AS t) g
  ON e.ts > t - INTERVAL 3 HOUR AND e.ts <= t GROUP BY 1, 2"""

ORACLES["uneven_sliding_count"] = f"""
SELECT event_type, t AS ts, count(*) AS value
FROM events e JOIN (SELECT unnest(generate_series({START}, {END} + INTERVAL 3 HOUR, INTERVAL 1 HOUR)) AS t) g
  ON e.ts > t - INTERVAL 90 MINUTE AND e.ts <= t GROUP BY 1, 2"""

ORACLES["rate_over_time"] = f"SELECT event_type, {ceil_ts(300)} AS ts, count(*) / CAST(300 AS DOUBLE) AS value FROM events GROUP BY 1, 2"

ORACLES["sum_over_series"] = f"""
SELECT coalesce(event_type, 'total') AS event_type, {ceil_ts(21600)} AS ts, count(*) AS value
FROM events GROUP BY GROUPING SETS ((event_type, {ceil_ts(21600)}), ({ceil_ts(21600)}))"""

ORACLES["instant_counts"] = """
SELECT CAST(user_id AS VARCHAR) AS user_id, TIMESTAMP '2024-01-20 12:00:00' AS ts, count(*) AS value
FROM events WHERE ts > TIMESTAMP '2024-01-20 06:00:00' AND ts <= TIMESTAMP '2024-01-20 12:00:00' GROUP BY 1"""

ORACLES["topk_series"] = f"""
WITH c AS (SELECT {ceil_ts(21600)} AS t, CAST(user_id AS VARCHAR) AS user_id, count(*) AS value FROM events GROUP BY 1, 2)
SELECT t AS ts, CAST(row_number() OVER (PARTITION BY t ORDER BY value DESC, user_id) AS INTEGER) AS rank, user_id, value
FROM c QUALIFY rank <= 3"""


def dense(keys: dict[str, str], step: str, seconds: int, where: str = "true") -> str:
    """CTE ``d``: keys, ts, value, idx, n on the full grid of each key set that has rows."""
    names, exprs = ", ".join(keys), ", ".join(f"{e} AS {n}" for n, e in keys.items())
    return f"""
k AS (SELECT DISTINCT {exprs} FROM events WHERE {where}),
g AS (SELECT unnest(generate_series({START} + INTERVAL {step}, {END}, INTERVAL {step})) AS ts),
c AS (SELECT {exprs}, {ceil_ts(seconds)} AS ts, count(*) AS value FROM events WHERE {where} GROUP BY ALL),
d AS (
  SELECT {names}, ts, coalesce(value, 0) AS value,
    row_number() OVER (PARTITION BY {names} ORDER BY ts) - 1 AS idx, count(*) OVER (PARTITION BY {names}) AS n
  FROM k CROSS JOIN g LEFT JOIN c USING ({names}, ts))"""


USER = {"user_id": "CAST(user_id AS VARCHAR)"}
TYPE = {"event_type": "event_type"}


def trend(keys: str, minutes: int, source: str = "d") -> str:
    """CTEs ``a`` and ``t``: the trend summary of the points in ``source`` (columns v, idx, n, ts)."""
    per = r(f"avg / {minutes}") if minutes else "CAST(0 AS DOUBLE)"
    return f"""
a AS (
  SELECT {keys}, count(v) AS valid, coalesce(CAST(sum(CAST(v AS DECIMAL(28, 10))) AS DOUBLE), 0) AS s,
    arg_max(v, idx) FILTER (v IS NOT NULL) AS latest, max(v) FILTER (v > 0) AS peak, arg_max(ts, v * 1e6 - idx) FILTER (v > 0) AS peak_time,
    count(*) FILTER (v > 0) AS positive,
    coalesce(sum(v) FILTER (idx < n // 3), 0) AS first, coalesce(sum(v) FILTER (idx >= n - n // 3), 0) AS last
  FROM {source} GROUP BY {keys}),
b AS (
  SELECT {keys}, {r("s")} AS total, coalesce({r("s / valid")}, 0) AS avg, coalesce({r("latest")}, 0) AS latest,
    coalesce({r("peak")}, 0) AS peak, peak_time,
    CASE WHEN valid = 0 THEN 'sparse' WHEN valid < 3 THEN CASE WHEN s = 0 THEN 'sparse' ELSE 'stable' END
      WHEN first = 0 AND last = 0 THEN 'sparse' WHEN first = 0 THEN CASE WHEN last > 0 THEN 'increasing' ELSE 'stable' END
      WHEN last > first * CAST(1.3 AS DOUBLE) THEN 'increasing' WHEN last < first * CAST(0.7 AS DOUBLE) THEN 'decreasing'
      ELSE 'stable' END AS trend,
    coalesce({r("positive / CAST(valid AS DOUBLE) * 100", 1)}, 0) AS non_zero_pct
  FROM a),
t AS (
  SELECT *, {per} AS avg_per_minute,
    CASE WHEN trend = 'increasing' THEN 'rising' WHEN total > 0 AND latest = 0 THEN 'went_silent' END AS anomaly FROM b)"""


def as_double(source: str = "d") -> str:
    return f"{source}v AS (SELECT *, CAST(value AS DOUBLE) AS v FROM {source})"


ORACLES["dense_counts"] = f"WITH {dense(USER, '24 HOUR', 86400)} SELECT user_id, ts, value, idx, n AS n_points FROM d"

ORACLES["downsample"] = f"""
WITH {dense(TYPE, '1 HOUR', 3600)},
p AS (SELECT CAST(round(i * ((720 - 1) / CAST(23 AS DOUBLE))) AS BIGINT) AS idx FROM range(0, 24) AS u(i))
SELECT event_type, ts, value, idx FROM d WHERE idx IN (SELECT idx FROM p)"""

ORACLES["trend_summaries"] = f"WITH {dense(USER, '24 HOUR', 86400)}, {as_double()}, {trend('user_id', 1440, 'dv')} SELECT * FROM t"

ORACLES["trend_of_values"] = f"""
WITH p AS (
  SELECT user_id, ts, CASE WHEN event_id % 11 <= 2 THEN NULL ELSE value END AS v,
    row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS idx, count(*) OVER (PARTITION BY user_id) AS n
  FROM events), {trend('user_id', 0, 'p')}
SELECT * FROM t"""

BOTH = {**TYPE, **USER}

RANKED = f"""
WITH {dense(BOTH, '24 HOUR', 86400)}, {as_double()}, {trend('event_type, user_id', 1440, 'dv')},
o AS (
  SELECT *, row_number() OVER w AS volume_rank, count(*) OVER s AS total_series, count(anomaly) OVER s AS anomalous_series
  FROM t WINDOW w AS (PARTITION BY event_type ORDER BY total DESC, user_id), s AS (PARTITION BY event_type)),
q AS (
  SELECT *, count(*) FILTER (volume_rank <= 20 AND anomaly IS NULL) OVER s AS stable_in,
    count(*) FILTER (volume_rank > 20 AND anomaly IS NOT NULL) OVER s AS odd_below,
    row_number() OVER (PARTITION BY event_type, anomaly IS NULL, volume_rank <= 20 ORDER BY volume_rank) AS from_top,
    row_number() OVER (PARTITION BY event_type, anomaly IS NULL, volume_rank <= 20 ORDER BY volume_rank DESC) AS from_bottom
  FROM o WINDOW s AS (PARTITION BY event_type)),
z AS (
  SELECT *, CASE WHEN volume_rank <= 20 THEN anomaly IS NOT NULL OR from_bottom > least(5, odd_below, stable_in)
                 ELSE anomaly IS NOT NULL AND from_top <= least(5, odd_below, stable_in) END AS kept
  FROM q)"""

ORACLES["series_rank_rescue"] = f"""{RANKED}
SELECT event_type, user_id, total, anomaly,
  CAST(row_number() OVER (PARTITION BY event_type ORDER BY volume_rank) AS INTEGER) AS report_rank,
  CAST(volume_rank AS INTEGER) AS volume_rank, total_series, anomalous_series FROM z WHERE kept"""

ORACLES["omitted_series_keys"] = f"""{RANKED}
SELECT event_type, max(total_series) AS total_series, count(*) FILTER (NOT kept) AS omitted_series,
  count(*) FILTER (NOT kept AND anomaly IS NOT NULL) AS omitted_anomalous,
  coalesce(array_to_string(list(user_id ORDER BY volume_rank) FILTER (NOT kept)[1:25], ','), '') AS omitted_keys,
  coalesce(array_to_string(list(user_id ORDER BY volume_rank) FILTER (NOT kept AND anomaly IS NOT NULL)[1:25], ','), '') AS omitted_anomalous_keys
FROM z GROUP BY 1"""

ONE_SCOPE = RANKED.replace(dense(BOTH, "24 HOUR", 86400), dense(USER, "24 HOUR", 86400))
ONE_SCOPE = ONE_SCOPE.replace(trend("event_type, user_id", 1440, "dv"), trend("user_id", 1440, "dv"))
ONE_SCOPE = ONE_SCOPE.replace("PARTITION BY event_type, ", "PARTITION BY ").replace("PARTITION BY event_type", "PARTITION BY 1")

ORACLES["report_points"] = f"""{ONE_SCOPE},
top AS (SELECT user_id, row_number() OVER (ORDER BY volume_rank) AS report_rank FROM z WHERE kept QUALIFY report_rank <= 5),
p AS (SELECT CAST(round(i * ((30 - 1) / CAST(23 AS DOUBLE))) AS BIGINT) AS idx FROM range(0, 24) AS u(i))
SELECT user_id, CAST(report_rank AS INTEGER) AS report_rank, ts, value FROM d JOIN top USING (user_id) WHERE idx IN (SELECT idx FROM p)"""

# --- time windows ----------------------------------------------------------

_EXPR = """
x AS (
  SELECT event_id, ts, event_id % 20 AS kind, user_id % 50 + 1 AS n, user_id % 24 AS h,
    lpad(CAST((user_id % 50 + 1) % 60 AS VARCHAR), 2, '0') AS m, date_trunc('day', ts) AS d FROM events),
y AS (
  SELECT event_id, ts AS as_of,
    CASE kind WHEN 0 THEN 'now' WHEN 1 THEN n || 'h ago' WHEN 2 THEN n || ' minutes' WHEN 3 THEN 'last ' || n || ' days'
      WHEN 4 THEN 'Yesterday' WHEN 5 THEN 'yesterday at ' || h || ':' || m WHEN 6 THEN 'yesterday at ' || (h % 12 + 1) || 'pm'
      WHEN 7 THEN 'this morning' WHEN 8 THEN 'last month' WHEN 9 THEN 'today at noon' WHEN 10 THEN n || 'h' || m || 'm'
      WHEN 11 THEN '1.5h' WHEN 12 THEN strftime(ts, '%Y-%m-%dt%H:%M:%S.%gz') WHEN 13 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S+02:00')
      WHEN 14 THEN CAST(epoch_us(ts) * 1000 AS VARCHAR) WHEN 15 THEN 'soon' WHEN 16 THEN '  ' WHEN 17 THEN 'last night'
      WHEN 18 THEN '-5m' ELSE 'midnight' END AS expr,
    CASE kind WHEN 0 THEN ts WHEN 1 THEN ts - to_hours(n) WHEN 2 THEN ts - to_minutes(n) WHEN 3 THEN ts - to_hours(24 * n)
      WHEN 4 THEN ts - INTERVAL 24 HOUR WHEN 5 THEN d - INTERVAL 1 DAY + to_minutes(h * 60 + CAST(m AS BIGINT))
      WHEN 6 THEN d - INTERVAL 1 DAY + to_hours(12 + (h % 12 + 1) % 12)
      WHEN 7 THEN CASE WHEN d + INTERVAL 6 HOUR > ts THEN d - INTERVAL 18 HOUR ELSE d + INTERVAL 6 HOUR END
      WHEN 8 THEN ts - INTERVAL 1 MONTH WHEN 9 THEN d + INTERVAL 12 HOUR WHEN 10 THEN ts - to_minutes(n * 60 + CAST(m AS BIGINT))
      WHEN 11 THEN ts - INTERVAL 90 MINUTE WHEN 12 THEN date_trunc('millisecond', ts) WHEN 13 THEN date_trunc('second', ts) - INTERVAL 2 HOUR
      WHEN 14 THEN ts WHEN 16 THEN ts WHEN 17 THEN ts - INTERVAL 12 HOUR WHEN 18 THEN ts + INTERVAL 5 MINUTE WHEN 19 THEN d END AS resolved
  FROM x)"""

ORACLES["time_expressions"] = f"WITH {_EXPR} SELECT event_id, expr, resolved FROM y"

ORACLES["times_of_day"] = """
WITH x AS (SELECT event_id, user_id % 30 AS h, event_id % 70 AS m, event_id % 3 AS half FROM events),
y AS (
  SELECT event_id, m, h || ':' || lpad(CAST(m AS VARCHAR), 2, '0') || CASE half WHEN 0 THEN ' am' WHEN 1 THEN 'pm' ELSE '' END AS clock,
    CASE WHEN half = 1 AND h < 12 THEN h + 12 WHEN half = 0 AND h = 12 THEN 0 ELSE h END AS hour FROM x)
SELECT event_id, clock, CASE WHEN hour <= 23 AND m <= 59 THEN hour * 60 + m END AS minute_of_day FROM y"""

_REPAIR = """
w1 AS (SELECT event_id, as_of, start_ts > end_ts AS swapped, least(start_ts, end_ts) AS s, least(greatest(start_ts, end_ts), as_of) AS e FROM w0),
w2 AS (SELECT *, e <= s AS empty, CASE WHEN e <= s THEN e - INTERVAL 1 HOUR ELSE s END AS s2 FROM w1),
w3 AS (SELECT *, s2 < e - INTERVAL 720 HOUR AS long, greatest(s2, e - INTERVAL 720 HOUR) AS s3 FROM w2),
w4 AS (
  SELECT event_id, s3 AS start_ts, e AS end_ts,
    concat_ws(',', CASE WHEN swapped THEN 'swapped' END, CASE WHEN empty THEN 'defaulted_1h' END, CASE WHEN long THEN 'capped_range' END) AS warnings,
    (epoch_us(e) - epoch_us(s3)) / 60000000.0 AS minutes FROM w3)"""

_STEP = "CASE WHEN minutes <= 30 THEN '30s' WHEN minutes <= 120 THEN '1m' WHEN minutes <= 360 THEN '5m' WHEN minutes <= 720 THEN '15m' ELSE '1h' END"

ORACLES["range_repair"] = f"""
WITH w0 AS (
  SELECT event_id, ts AS as_of, ts + to_hours(CASE WHEN event_id % 13 = 0 THEN -960 ELSE (event_id % 7 - 3) * 5 END) AS start_ts,
    ts + to_hours(event_id % 11 - 5) AS end_ts FROM events), {_REPAIR},
w5 AS (SELECT *, {_STEP} AS step FROM w4)
SELECT event_id, start_ts, end_ts, warnings, step,
  CAST(CASE step WHEN '30s' THEN 0.5 WHEN '1m' THEN 1 WHEN '5m' THEN 5 WHEN '15m' THEN 15 ELSE 60 END AS DOUBLE) AS step_minutes FROM w5"""

ORACLES["resolved_windows"] = f"""
WITH {_EXPR}, w0 AS (SELECT event_id, as_of, resolved AS start_ts, as_of AS end_ts FROM y WHERE resolved IS NOT NULL), {_REPAIR}
SELECT event_id, start_ts, end_ts, expr <> '  ' AS start_given, warnings FROM w4 JOIN (SELECT event_id, expr FROM y) USING (event_id)
UNION ALL SELECT event_id, NULL, as_of, true, '' FROM y WHERE resolved IS NULL"""

ORACLES["auto_widen"] = f"""
WITH q AS (
  SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events),
w AS (
  SELECT user_id || '/' || day AS request_id, user_id, CAST(day AS TIMESTAMP) + INTERVAL 750 MINUTE AS e,
    CAST(day AS TIMESTAMP) + INTERVAL 690 MINUTE AS s, day(day) % 5 = 0 AS given FROM q),
l AS (
  SELECT request_id, max(ts) AS last_ts FROM w JOIN events v ON v.user_id = w.user_id AND v.ts < e AND v.ts >= e - INTERVAL 720 HOUR GROUP BY 1),
p AS (
  SELECT request_id, e, s, given, last_ts,
    CASE WHEN given OR coalesce(last_ts >= s, false) THEN s WHEN last_ts >= e - INTERVAL 6 HOUR THEN e - INTERVAL 6 HOUR
      WHEN last_ts >= e - INTERVAL 24 HOUR THEN e - INTERVAL 24 HOUR WHEN last_ts >= e - INTERVAL 168 HOUR THEN e - INTERVAL 168 HOUR
      ELSE e - INTERVAL 720 HOUR END AS used_start
  FROM w LEFT JOIN l USING (request_id)),
z AS (SELECT *, coalesce(last_ts >= used_start, false) AS has_rows, (epoch_us(e) - epoch_us(used_start)) / 60000000.0 AS minutes FROM p)
SELECT request_id, used_start, used_start < s AS widened, has_rows, last_ts,
  CASE WHEN has_rows THEN CASE WHEN used_start < s THEN 'widened' END WHEN given THEN 'no_rows_explicit' ELSE 'no_rows_after_widen' END AS warning,
  {_STEP} AS step FROM z"""

ORACLES["rows_in_windows"] = """
SELECT a.event_id AS error_id, count(*) AS rows, max(b.ts) AS last_ts
FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts < a.ts + INTERVAL 1 HOUR
WHERE a.event_type = 'error' GROUP BY 1"""

# --- redaction -------------------------------------------------------------


def _veto(text: str, pattern: str, mark: str, keep: str) -> str:
    """Replace matches unless ``keep`` (over ``m``) holds, by zipping the gaps with the matches."""
    shown = f"list_transform(regexp_extract_all({text}, '{pattern}'), lambda m: CASE WHEN {keep} THEN m ELSE '{mark}' END)"
    gaps = f"string_split_regex({text}, '{pattern}')"
    return f"list_reduce(list_transform(list_zip({gaps}, {shown}), lambda z: z[1] || coalesce(z[2], '')), lambda a, b: a || b)"


def _luhn(m: str) -> str:
    d = f"reverse(regexp_replace({m}, '[^0-9]', '', 'g'))"
    digit = f"CAST(substring({d}, CAST(i + 1 AS INTEGER), 1) AS INTEGER)"
    weighed = f"CASE WHEN i % 2 = 0 THEN {digit} WHEN {digit} > 4 THEN {digit} * 2 - 9 ELSE {digit} * 2 END"
    return f"(length({d}) BETWEEN 13 AND 19 AND list_sum(list_transform(range(0, length({d})), lambda i: {weighed})) % 10 = 0)"


_PRIVATE = r"regexp_matches(m, '^(10\.|127\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.)')"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d{2}|[1-9]?\d)"


def redaction(keys: str, table: str, column: str = "text") -> str:
    stages = [
        r"regexp_replace(t0, '[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}', '[REDACTED_EMAIL]', 'g')",
        r"regexp_replace(t1, '\b\d{3}-\d{2}-\d{4}\b', '[REDACTED_SSN]', 'g')",
        _veto("t2", r"\b\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b", "[REDACTED_CC]", f"NOT {_luhn('m')}"),
        _veto("t3", r"\b\d{4}[- ]?\d{6}[- ]?\d{5}\b", "[REDACTED_CC]", f"NOT {_luhn('m')}"),
        _veto("t4", rf"\b(?:{_OCTET}\.){{3}}{_OCTET}\b", "[REDACTED_IP]", _PRIVATE),
        r"regexp_replace(t5, 'eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+', '[REDACTED_JWT]', 'g')",
        r"regexp_replace(t6, 'Bearer\s+[A-Za-z0-9._~+/=\-]+', 'Bearer [REDACTED]', 'g')",
    ]
    ctes = [f"r0 AS (SELECT {keys}, {column} AS t0 FROM {table})"]
    ctes += [f"r{i + 1} AS MATERIALIZED (SELECT *, {s} AS t{i + 1} FROM r{i})" for i, s in enumerate(stages)]
    hits = " + ".join(f"CAST(t{i} <> t{i + 1} AS INTEGER)" for i in range(7))
    return f"WITH {', '.join(ctes)} SELECT {keys}, t7 AS text, {hits} AS hits FROM r7"


ORACLES["redact_documents"] = redaction("doc_id", "documents")
ORACLES["redact_pages"] = redaction("page_id", "pages", "html")
ORACLES["redact_conversations"] = redaction("conv_id, turn", "conversations")

_DIGITS = "lpad(CAST(({0}) % {1} AS VARCHAR), {2}, '0')"
_CONTACT = f"""(
  SELECT o_orderkey, 'mail c' || o_custkey || '@shop.example.com ssn ' || {_DIGITS.format('o_orderkey', 1000, 3)} || '-12-'
    || {_DIGITS.format('o_custkey', 10000, 4)} || ' card 4111-' || {_DIGITS.format('o_orderkey', 10000, 4)} || '-'
    || {_DIGITS.format('o_custkey', 10000, 4)} || '-' || {_DIGITS.format('o_orderkey + o_custkey', 10000, 4)}
    || ' or 3782' || {_DIGITS.format('o_orderkey', 1000000, 6)} || {_DIGITS.format('o_custkey * 7', 100000, 5)}
    || ' at ' || (o_orderkey % 256) || '.' || (o_custkey % 256) || '.' || ((o_orderkey + 1) % 256) || '.' || ((o_custkey + 1) % 256)
    || ' Bearer tok' || o_orderkey || ' eyJh' || o_orderkey || '.eyJp' || o_custkey || '.sig' AS text
  FROM orders)"""
ORACLES["redact_orders"] = redaction("o_orderkey", _CONTACT)

ORACLES["luhn_checks"] = f"""
WITH n AS (SELECT o_orderkey, '62' || lpad(CAST(o_orderkey AS VARCHAR), 6, '0') || lpad(CAST(o_custkey AS VARCHAR), 5, '0') AS number FROM orders)
SELECT o_orderkey, number, {_luhn('number')} AS valid FROM n"""

# --- payloads --------------------------------------------------------------

ORACLES["ingest_streams"] = f"""
WITH {EV} SELECT event_id // 100 AS chunk, epoch_us(ts) * 1000 AS ts_ns, ts, line, event_type FROM ev WHERE event_id % 50 NOT IN (0, 1)"""

ORACLES["ingest_matrix"] = """
SELECT event_id // 100 AS chunk, CAST(user_id AS VARCHAR) AS user, date_trunc('second', ts) AS ts, CAST(value AS VARCHAR) AS value FROM events"""

ORACLES["ingest_vector"] = """
SELECT event_id // 100 AS chunk, CAST(event_id AS VARCHAR) AS id, date_trunc('second', ts) AS ts, CAST(value AS VARCHAR) AS value FROM events"""

ORACLES["payload_emptiness"] = """
SELECT DISTINCT event_id // 100 AS chunk, (event_id // 100) % 3 = 0 OR (event_id // 100) % 7 = 0 AS is_empty FROM events"""

ORACLES["payload_rejects"] = """
WITH e AS (SELECT event_id, event_id // 100 AS chunk, (event_id // 100) % 10 AS bad FROM events),
k AS (SELECT DISTINCT chunk, bad FROM e)
SELECT chunk, CASE event_id % 50 WHEN 0 THEN 'short_tuple' WHEN 1 THEN 'bad_time' ELSE 'good' END AS outcome, count(*) AS n
FROM e WHERE bad NOT BETWEEN 3 AND 7 GROUP BY 1, 2
UNION ALL SELECT chunk, CASE bad WHEN 3 THEN 'null_payload' WHEN 4 THEN 'not_json' WHEN 5 THEN 'other_kind' ELSE 'no_result' END, 1 FROM k WHERE bad BETWEEN 3 AND 6
UNION ALL SELECT chunk, 'bad_values', 2 FROM k WHERE bad = 7 UNION ALL SELECT chunk, 'bad_labels', 1 FROM k WHERE bad = 7"""

# --- reports ---------------------------------------------------------------

ORACLES["logs_report"] = f"""
WITH {EV},
p AS (SELECT event_type, pattern, count(*) AS c FROM ev GROUP BY ALL),
f AS (SELECT event_type, pattern, c, row_number() OVER (PARTITION BY event_type ORDER BY c DESC, pattern) AS i,
        sum(c) OVER (PARTITION BY event_type) AS rows, count(*) OVER (PARTITION BY event_type) AS groups FROM p),
s AS (SELECT event_type, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS i FROM ev),
u AS (SELECT event_type, count(DISTINCT user_id) AS users FROM ev GROUP BY 1)
SELECT f.event_type, CAST(rows AS BIGINT) AS matched, CASE WHEN groups > 10 THEN groups END AS total_patterns, 'full' AS form,
  CAST(least(CAST(rows AS BIGINT), 100) AS VARCHAR) AS total_logs, CASE WHEN rows >= 100 THEN 'true' ELSE 'false' END AS truncated, pattern AS first_pattern,
  CAST(round(c / CAST(rows AS DOUBLE) * 1000) / 10 AS VARCHAR) AS first_pct, strftime(s.ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS fifth_time,
  CAST(5 AS INTEGER) AS sample_rows, CAST(CASE WHEN users > 15 THEN 16 ELSE users END AS INTEGER) AS user_values
FROM f JOIN s ON f.event_type = s.event_type AND s.i = 5 JOIN u ON u.event_type = f.event_type WHERE f.i = 1"""

ORACLES["stats_report"] = f"""{RANKED}
SELECT event_type, max(total_series) AS total_series, count(*) FILTER (NOT kept) AS omitted_series,
  count(*) FILTER (NOT kept AND anomaly IS NOT NULL) AS omitted_anomalous, 'full' AS form,
  CAST(count(*) FILTER (kept) AS INTEGER) AS summaries, CAST(count(*) FILTER (kept) AS INTEGER) AS series, CAST(24 AS INTEGER) AS first_points,
  arg_min(user_id, volume_rank) FILTER (kept) AS first_user,
  CAST(least(count(*) FILTER (NOT kept), 25) AS INTEGER) AS omitted_listed
FROM z GROUP BY 1"""

ORACLES["label_values_report"] = """
WITH v AS (SELECT DISTINCT event_type, CAST(user_id AS VARCHAR) AS value FROM events)
SELECT event_type, count(*) FILTER (contains(value, '1')) AS total_values, count(*) AS total_label_values,
  count(*) FILTER (contains(value, '1')) > 5 AS truncated,
  '["' || array_to_string(list(value ORDER BY value) FILTER (contains(value, '1'))[1:5], '","') || '"]' AS values
FROM v GROUP BY 1"""

ORACLES["shrunk_reports"] = f"""
WITH {EV} SELECT uid AS user_id, count(*) AS matched, 'shrunk' AS form, true AS within_budget,
  CAST(least(count(DISTINCT pattern), 10) AS INTEGER) AS patterns FROM ev GROUP BY 1"""

ORACLES["oversized_notices"] = """
SELECT CAST(user_id AS VARCHAR) AS user_id, count(*) AS matched, 'notice' AS form, 'true' AS truncated, true AS larger FROM events GROUP BY 1"""

_ASKED = f"""
u AS (SELECT DISTINCT user_id AS id, user_id % 7 AS kind, TIMESTAMP '2024-01-20 12:30:00' + to_days(CAST(user_id % 5 AS INTEGER)) AS n FROM events),
w0 AS (
  SELECT id, kind, n, kind IN (1, 2, 3, 4, 6) AS given,
    CASE kind WHEN 1 THEN n - INTERVAL 48 HOUR WHEN 2 THEN n - INTERVAL 48 HOUR WHEN 4 THEN n - INTERVAL 720 HOUR WHEN 6 THEN NULL ELSE n - INTERVAL 1 HOUR END AS s,
    CASE kind WHEN 6 THEN NULL ELSE n END AS e,
    CASE kind WHEN 1 THEN 'swapped' WHEN 3 THEN 'defaulted_1h' WHEN 4 THEN 'capped_range' WHEN 6 THEN 'bad_time' END AS code FROM u),
hit AS (SELECT id, event_id, ts, event_type, pattern FROM ev JOIN w0 ON user_id = id WHERE event_type <> 'view' AND kind <> 5),
l AS (SELECT id, max(ts) AS last FROM hit JOIN w0 USING (id) WHERE ts < e AND ts >= least(s, e - INTERVAL 720 HOUR) GROUP BY 1),
w AS (
  SELECT id, e, code, given, s, last, CASE WHEN given OR coalesce(last >= s, false) THEN s WHEN last >= e - INTERVAL 6 HOUR THEN e - INTERVAL 6 HOUR
      WHEN last >= e - INTERVAL 24 HOUR THEN e - INTERVAL 24 HOUR WHEN last >= e - INTERVAL 168 HOUR THEN e - INTERVAL 168 HOUR
      ELSE e - INTERVAL 720 HOUR END AS used FROM w0 LEFT JOIN l USING (id)),
c AS (
  SELECT *, CASE WHEN s IS NULL THEN NULL WHEN coalesce(last >= used, false) THEN CASE WHEN used < s THEN 'widened' END
      WHEN given THEN 'no_rows_explicit' ELSE 'no_rows_after_widen' END AS found, (epoch_us(e) - epoch_us(used)) / 60000000.0 AS minutes,
    CASE WHEN s IS NULL THEN '' ELSE strftime(used, '%Y-%m-%dT%H:%M:%SZ') || ' to ' || strftime(e, '%Y-%m-%dT%H:%M:%SZ') END AS time_range FROM w)"""

ORACLES["request_logs_reports"] = f"""
WITH {EV}, {_ASKED},
m AS (SELECT hit.* FROM hit JOIN c USING (id) WHERE ts >= used AND ts < e),
p AS (SELECT id, pattern, count(*) AS k FROM m GROUP BY 1, 2),
q AS (SELECT id, arg_min(pattern, (-k, pattern)) AS first_pattern, count(*) AS groups FROM p GROUP BY 1),
t AS (
  SELECT id, count(*) AS rows, CASE WHEN id % 2 = 0 THEN arg_min(ts, (ts, event_id)) ELSE arg_max(ts, (ts, event_id)) END AS first FROM m GROUP BY 1)
SELECT c.id AS request_id, used AS used_start, e AS end_ts, coalesce(rows, 0) AS matched, CASE WHEN rows >= 3 AND groups > 10 THEN groups END AS total_patterns,
  concat_ws(',', code, found) AS codes, CAST(least(coalesce(rows, 0), c.id % 40 + 1) AS VARCHAR) AS total_logs,
  CASE WHEN coalesce(rows, 0) >= c.id % 40 + 1 THEN 'true' ELSE 'false' END AS truncated, CASE WHEN c.id % 2 = 0 THEN 'forward' ELSE 'backward' END AS direction,
  time_range, CASE WHEN rows >= 3 THEN first_pattern END AS first_pattern, strftime(first, '%Y-%m-%dT%H:%M:%S.%gZ') AS first_time
FROM c LEFT JOIN t ON t.id = c.id LEFT JOIN q ON q.id = c.id"""

ORACLES["request_stats_reports"] = f"""
WITH {EV}, {_ASKED},
g AS (SELECT *, CASE WHEN id % 3 = 1 THEN '6h' WHEN s IS NULL THEN '1h' ELSE {_STEP} END AS step FROM c),
h AS (SELECT *, CAST(CASE step WHEN '6h' THEN 21600 WHEN '30s' THEN 30 WHEN '1m' THEN 60 WHEN '5m' THEN 300 WHEN '15m' THEN 900 ELSE 3600 END AS BIGINT) * 1000000 AS w FROM g),
b AS (SELECT *, (epoch_us(used) // w + 1) * w AS lo, epoch_us(e) // w * w AS hi FROM h),
m AS (
  SELECT b.id, event_type, (epoch_us(ts) + w - 1) // w AS slot, count(*) AS k FROM hit JOIN b USING (id)
  WHERE epoch_us(ts) > lo - w AND epoch_us(ts) <= hi GROUP BY ALL),
t AS (SELECT id, event_type, sum(k) AS total, max(k) AS peak FROM m GROUP BY 1, 2),
a AS (SELECT id, count(*) AS series, sum(total) AS total, max(peak) AS peak, arg_min(event_type, (-total, event_type)) AS first_type FROM t GROUP BY 1)
SELECT b.id AS request_id, used AS used_start, e AS end_ts, step, coalesce(series, 0) AS total_series,
  concat_ws(',', code, found, CASE WHEN b.id % 3 = 2 THEN 'bad_step' END) AS codes, CAST(coalesce(total, 0) AS DOUBLE) AS total,
  CAST(coalesce(peak, 0) AS DOUBLE) AS peak, first_type, time_range FROM b LEFT JOIN a ON a.id = b.id"""

_LABELS_ASKED = """
u AS (SELECT DISTINCT user_id AS id, user_id % 7 AS kind, TIMESTAMP '2024-01-20 12:30:00' + to_days(CAST(user_id % 5 AS INTEGER)) AS n FROM events),
w AS (
  SELECT id, kind, CASE kind WHEN 1 THEN n WHEN 2 THEN n - INTERVAL 48 HOUR WHEN 3 THEN n WHEN 4 THEN n - INTERVAL 60 DAY WHEN 6 THEN NULL ELSE n - INTERVAL 6 HOUR END AS s,
    CASE kind WHEN 1 THEN n - INTERVAL 48 HOUR WHEN 2 THEN n + INTERVAL 3 DAY WHEN 6 THEN NULL ELSE n END AS e FROM u)"""

ORACLES["request_label_names"] = f"""
WITH {_LABELS_ASKED}
SELECT id AS request_id, CASE WHEN count(event_id) > 0 THEN 'event_type,user_id' ELSE '' END AS names, CASE WHEN any_value(kind) = 6 THEN 'bad_time' ELSE '' END AS codes
FROM w LEFT JOIN events ON ts >= s AND ts < e GROUP BY 1"""

ORACLES["request_label_values"] = f"""
WITH {_LABELS_ASKED},
v AS (SELECT DISTINCT id, CAST(user_id AS VARCHAR) AS value FROM w JOIN events ON ts >= s AND ts < e AND id % 11 <> 0),
a AS (
  SELECT id, count(*) AS total_label_values, count(*) FILTER (id % 2 = 1 OR contains(value, '1')) AS total_values,
    list(value ORDER BY value) FILTER (id % 2 = 1 OR contains(value, '1')) AS vs FROM v GROUP BY 1)
SELECT w.id AS request_id, coalesce(total_values, 0) AS total_values, coalesce(total_label_values, 0) AS total_label_values, coalesce(total_values > 3, false) AS truncated,
  coalesce(array_to_string(vs[1:3], ','), '') AS values,
  concat_ws(',', CASE WHEN kind = 6 THEN 'bad_time' END, CASE WHEN w.id % 11 = 0 THEN 'label_required' END,
    CASE WHEN total_values = 0 AND total_label_values > 0 THEN 'no_value_contains' END, CASE WHEN total_values > 3 THEN 'values_capped' END) AS codes
FROM w LEFT JOIN a ON a.id = w.id"""

# --- recipes ---------------------------------------------------------------

ERROR_ONLY = ONE_SCOPE.replace(dense(USER, "24 HOUR", 86400), dense(USER, "24 HOUR", 86400, "event_type = 'error'"))
ORACLES["error_rate"] = f"""{ERROR_ONLY}
SELECT user_id, total, trend, anomaly, CAST(row_number() OVER (ORDER BY volume_rank) AS INTEGER) AS report_rank FROM z WHERE kept"""

ORACLES["period_compare"] = f"""
WITH c AS (
  SELECT CAST(user_id AS VARCHAR) AS user_id, count(*) FILTER (ts < {MIDDLE}) AS count_before, count(*) FILTER (ts >= {MIDDLE}) AS count_after
  FROM events WHERE ts >= {START} AND ts < {END} GROUP BY 1),
p AS (SELECT *, {r("count_before / CAST(21600 AS DOUBLE)", 4)} AS per_minute_before, {r("count_after / CAST(21600 AS DOUBLE)", 4)} AS per_minute_after FROM c)
SELECT *, {r("per_minute_after - per_minute_before", 4)} AS delta FROM p"""

_ONSET = f"""{dense(TYPE, '1 HOUR', 3600)},
m AS (SELECT *, sum(value) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) / CAST(idx AS DOUBLE) AS baseline FROM d),
f AS (
  SELECT event_type, ts AS onset, value, {r("baseline")} AS baseline FROM m
  WHERE idx >= 24 AND value >= 1 AND value > baseline * 2 QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts) = 1)"""
ORACLES["onset"] = f"WITH {_ONSET} SELECT * FROM f"

ORACLES["deploy_correlation"] = f"""
WITH {_ONSET} SELECT event_type, onset, event_id AS id, events.ts, {r("(epoch_us(events.ts) - epoch_us(onset)) / CAST(1000000 AS DOUBLE)")} AS offset_seconds
FROM f JOIN (SELECT event_id, ts FROM events WHERE event_type = 'signup') events
  ON events.ts >= onset - INTERVAL 30 MINUTE AND events.ts <= onset + INTERVAL 30 MINUTE"""

_DAY = "WHERE ts > TIMESTAMP '2024-01-20' AND ts <= {0}"
_HEALTH = """
h AS (
  SELECT u AS user_id, count(event_id) AS rows, count(event_id) FILTER (event_type = 'error') AS errors
  FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS u FROM events) LEFT JOIN (SELECT * FROM events {0}) ON u = CAST(user_id AS VARCHAR) GROUP BY 1)"""

ORACLES["service_health"] = f"""
WITH {_HEALTH.format(_DAY.format("TIMESTAMP '2024-01-20 12:00:00'"))}
SELECT *, CASE WHEN rows = 0 THEN 'possibly_down' ELSE 'active' END AS status FROM h"""

ORACLES["severity"] = f"""
WITH {_HEALTH.format(_DAY.format(END))}, {dense(USER, '24 HOUR', 86400, "event_type = 'error'")}, {as_double()}, {trend('user_id', 1440, 'dv')},
j AS (SELECT h.user_id, rows, errors, CASE WHEN rows > 0 THEN errors / CAST(rows AS DOUBLE) ELSE 0 END AS share, trend, non_zero_pct FROM h LEFT JOIN t USING (user_id))
SELECT user_id, rows, errors, {r("share", 4)} AS error_share, trend, non_zero_pct,
  CASE WHEN rows = 0 THEN 'silent' WHEN errors = rows OR (coalesce(trend, '') = 'increasing' AND share >= 0.5) THEN 'critical'
    WHEN errors = 0 OR (coalesce(non_zero_pct, 0) <= 25 AND coalesce(trend, '') <> 'increasing') THEN 'healthy' ELSE 'warning' END AS verdict
FROM j"""

ORACLES["silent_services"] = f"""
SELECT CAST(user_id AS VARCHAR) AS user_id, count(*) AS rows_before, max(ts) AS last_seen FROM events
WHERE ts >= {START} AND ts < {END} GROUP BY 1 HAVING max(ts) < TIMESTAMP '2024-01-30'"""

ORACLES["restart_gaps"] = f"""
WITH c AS (SELECT event_type, {ceil_ts(1800)} AS t FROM events GROUP BY ALL),
g AS (SELECT event_type, t AS last_active, lead(t) OVER (PARTITION BY event_type ORDER BY t) AS resumed_at FROM c)
SELECT *, (epoch_us(resumed_at) - epoch_us(last_active)) // 1800000000 - 1 AS empty_steps FROM g
WHERE resumed_at > last_active + INTERVAL 30 MINUTE"""

ORACLES["blast_radius"] = "SELECT event_type, count(DISTINCT user_id) AS affected, count(*) AS rows FROM events GROUP BY 1"

ORACLES["recurrence"] = f"""
WITH {EV},
g AS (SELECT pattern, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 8 HOUR THEN 0 ELSE 1 END AS opens FROM ev WINDOW w AS (PARTITION BY pattern ORDER BY ts)),
n AS (SELECT *, sum(opens) OVER (PARTITION BY pattern ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM g),
b AS (SELECT pattern, CAST(burst AS BIGINT) AS burst, min(ts) AS started, max(ts) AS ended, count(*) AS rows FROM n GROUP BY 1, 2)
SELECT *, {r("(epoch_us(started) - epoch_us(lag(started) OVER (PARTITION BY pattern ORDER BY burst))) / CAST(3600000000 AS DOUBLE)")} AS hours_since_previous FROM b"""

ORACLES["timeline"] = f"""
WITH {EV} SELECT event_id AS id, ts, line FROM ev
WHERE contains(line, 'node 3') AND contains(line, '10.0.17.') AND (event_type = 'error' OR event_id % 4 = 3)"""

ORACLES["slow_patterns"] = f"""
WITH {EV}, g AS (SELECT pattern, count(*) AS count, arg_max(msg, ts) AS sample FROM ev WHERE event_type IN ('purchase', 'error') GROUP BY 1)
SELECT CAST(row_number() OVER (ORDER BY count DESC, pattern) AS INTEGER) AS rank, pattern, count,
  round(count / CAST(sum(count) OVER () AS DOUBLE) * 1000) / 10 AS pct, sample,
  CAST(sum(count) OVER () AS BIGINT) AS total_rows, count(*) OVER () AS total_patterns
FROM g QUALIFY rank <= 10"""

# --- streaming -------------------------------------------------------------

ORACLES["streaming_counts"] = f"""
SELECT event_type, {ceil_ts(3600)} AS ts, count(*) AS value FROM events GROUP BY 1, 2
HAVING {ceil_ts(3600)} <= (SELECT date_trunc('millisecond', max(ts) - INTERVAL 1 MICROSECOND) - INTERVAL 10 MINUTE FROM events)"""
