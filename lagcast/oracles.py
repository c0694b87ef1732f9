"""DuckDB SQL that computes the registered queries from the raw tables.

Written row by row from the definitions (plain windows, joins of every query
with every run), with none of the folding the Spark jobs use.
"""

from __future__ import annotations

import re

from lagcast.params import PRIORS

ORACLES: dict[str, str] = {}


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


# ---------------------------------------------------------------- adapters

KEYED = r"""keyed AS (
  SELECT *, CAST(regexp_extract(props, '"k": *(\d+)', 1) AS INTEGER) AS k, CAST(user_id % 10 AS INTEGER) AS num,
    CASE event_type WHEN 'view' THEN 'S' WHEN 'click' THEN 'RE' WHEN 'signup' THEN 'RB'
      WHEN 'purchase' THEN 'ICE' WHEN 'error' THEN 'IC' END AS train_type,
    CASE event_type WHEN 'view' THEN 420 WHEN 'click' THEN 540 WHEN 'signup' THEN 960
      WHEN 'purchase' THEN 1080 WHEN 'error' THEN 1425 END AS base
  FROM events)"""


def _stop_event(place: str, minute: str, name: str) -> str:
    return f"""placed0 AS (SELECT *, {place} AS place FROM keyed),
placed AS (SELECT *, CAST(CAST(ts AS DATE) AS TIMESTAMP) + to_minutes(CAST({minute} AS BIGINT)) AS pt,
    CAST(floor(value) - 10 AS BIGINT) AS dly FROM placed0),
stop_event AS (
  SELECT {name} AS station_name, '0' || (8000 + place) AS eva, train_type, CAST(num AS VARCHAR) AS train_number,
    CASE WHEN user_id % 7 <> 0 THEN train_type || (user_id % 3) END AS line_number,
    train_type || '-' || num AS train_line_ride_id, CAST(place + 1 AS BIGINT) AS train_line_station_num,
    CASE WHEN k % 25 <> 1 THEN pt END AS arrival_planned_time,
    CASE WHEN k % 25 <> 1 THEN pt + to_minutes(dly) + to_seconds(event_id % 60) END AS arrival_change_time,
    CASE WHEN k % 25 <> 2 THEN pt + INTERVAL 2 MINUTE END AS departure_planned_time,
    CASE WHEN k % 25 <> 2 THEN pt + to_minutes(2 + dly + k % 3 - 1) + to_seconds(event_id % 60) END AS departure_change_time,
    k % 20 = 0 AS is_canceled, event_id AS seq
  FROM placed JOIN nation ON n_nationkey = place)"""


MANY = _stop_event("k % 4", "base + minute(ts) % 30", "n_name")
PAD = r"regexp_replace(n_name, '_(\d)$', '_0\1')"
NETWORK = _stop_event(
    "CASE WHEN num % 2 = 0 THEN k % 2 ELSE 1 + k % 3 END", "base % 1200 + num * 7 + place * 20", PAD
)

PREPARED = """base_event AS (
  SELECT * EXCLUDE (eva), ltrim(eva, '0') AS eva, train_type || ' ' || train_number AS identity,
    CAST(date_sub('minute', arrival_planned_time, arrival_change_time) AS INTEGER) AS arr_delay,
    CAST(date_sub('minute', departure_planned_time, departure_change_time) AS INTEGER) AS dep_delay,
    coalesce(arrival_planned_time, departure_planned_time) AS planned
  FROM stop_event),
prepared AS (
  SELECT *, CAST(planned - INTERVAL 4 HOUR AS DATE) AS service_day, CAST(planned AS DATE) AS day,
    CAST(hour(planned) * 60 + minute(planned) AS INTEGER) AS tod,
    lag(coalesce(arr_delay, dep_delay)) OVER (
      PARTITION BY train_line_ride_id, CAST(planned - INTERVAL 4 HOUR AS DATE)
      ORDER BY train_line_station_num, seq) AS prev_delay
  FROM base_event WHERE planned IS NOT NULL AND train_type IS NOT NULL AND train_number IS NOT NULL)"""


def _clamp(c: str) -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN greatest(-30, least(360, {c})) END"


def _key(c: str) -> str:
    return f"upper(trim(regexp_replace({c}, '[^A-Za-z0-9]+', '_', 'g'), '_'))"


RUN = f"""run AS (
  SELECT {_key('identity')} AS train_key, identity AS train, train_type, line_number, station_name, eva, day, tod,
    {_clamp('arr_delay')} AS arr_delay, {_clamp('dep_delay')} AS dep_delay, {_clamp('prev_delay')} AS prev_delay,
    is_canceled AS cancelled
  FROM prepared)"""

RUNS = (KEYED, MANY, PREPARED, RUN)
NET_RUNS = (KEYED, NETWORK, PREPARED, RUN)

STATION = f"""station AS (
  SELECT CAST(8000 + n_nationkey AS VARCHAR) AS eva, {PAD} AS name, CAST(coalesce(w, 0) AS INTEGER) AS weight
  FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS w FROM customer GROUP BY 1) ON c_nationkey = n_nationkey)"""


def _ts(c: str, name: str | None = None) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {name or c}"


def _day(c: str, name: str | None = None) -> str:
    return f"CAST({c} AS VARCHAR) AS {name or c}"


def _r(x: str, name: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0 AS {name}"


# Month and day of Easter Sunday from 1990 to 2030, as calendars print them.
EASTER = (
    415, 331, 419, 411, 403, 416, 407, 330, 412, 404, 423, 415, 331, 420, 411, 327, 416, 408, 323, 412, 404,
    424, 408, 331, 420, 405, 327, 416, 401, 421, 412, 404, 417, 409, 331, 420, 405, 328, 416, 401, 421,
)


def _easter(y: str) -> str:
    """Date of Easter Sunday for a year expression; null outside the table."""
    found = f"list_extract({list(EASTER)}, CAST({y} AS BIGINT) - 1989)"
    return f"make_date({y}, {found} // 100, {found} % 100)"


def _holiday(d: str, bavaria: bool = False) -> str:
    fixed = "101, 501, 1003, 1225, 1226" + (", 106, 1101" if bavaria else "")
    moving = "-2, 1, 39, 50" + (", 60" if bavaria else "")
    return f"(month({d}) * 100 + day({d}) IN ({fixed}) OR ({d} - {_easter(f'year({d})')}) IN ({moving}))"


def _weight(day: str, as_of: str, half_life: float = 30, boost: float = 2) -> str:
    return (
        f"exp(-ln(2.0) / {half_life} * greatest(0, {as_of} - {day}))"
        f" * CASE WHEN isodow({day}) = isodow({as_of}) THEN {boost} ELSE 1.0 END"
    )


def _near(a: str, b: str) -> str:
    return f"least(abs({a} - {b}), 1440 - abs({a} - {b})) <= 20"


# ---------------------------------------------------------------- sources

ORACLES["stop_events"] = _with(KEYED, MANY) + f"""
SELECT station_name, eva, train_type, train_number, line_number, train_line_ride_id, train_line_station_num,
  {_ts('arrival_planned_time')}, {_ts('arrival_change_time')}, {_ts('departure_planned_time')},
  {_ts('departure_change_time')}, is_canceled, seq
FROM stop_event"""

FEED = """feed AS (
  SELECT *, k % 4 AS place, user_id || '-' || strftime(ts, '%y%m%d') || '-' || (k % 4 + 1) AS stop_id,
    CAST(CAST(ts AS DATE) AS TIMESTAMP) + to_minutes(CAST(base + minute(ts) % 30 AS BIGINT)) AS plan_time,
    date_trunc('minute', ts) + to_minutes(CAST(floor(value) AS BIGINT)) AS moved
  FROM keyed),
plan AS (
  SELECT ts, event_id, CAST(8000 + place AS VARCHAR) AS eva, n_name AS station, stop_id, k % 31 <> 0 AS labelled,
    CASE WHEN k % 31 <> 0 THEN train_type ELSE '' END AS category,
    CASE WHEN k % 31 <> 0 THEN CAST(num AS VARCHAR) ELSE '' END AS number,
    k % 25 <> 1 AS arr_present, k % 25 <> 2 AS dep_present,
    CASE WHEN k % 25 <> 1 THEN plan_time END AS arr_planned,
    CASE WHEN k % 25 <> 2 THEN plan_time + INTERVAL 2 MINUTE END AS dep_planned,
    CASE WHEN k % 25 <> 1 THEN CASE WHEN k % 6 = 0 THEN '' ELSE train_type || (k % 3) END END AS arr_line,
    CASE WHEN k % 25 <> 2 THEN 'D' || (k % 3) END AS dep_line,
    CASE WHEN k % 9 = 0 THEN '' ELSE 'NATION_' || (k % 25) || '|NATION_3' END AS route, k
  FROM feed JOIN nation ON n_nationkey = place WHERE event_type IN ('view', 'click')),
change AS (
  SELECT ts, event_id, CAST(8000 + place AS VARCHAR) AS eva, stop_id,
    CASE WHEN k % 5 <> 0 THEN moved END AS arr_changed,
    CASE WHEN k % 4 = 0 THEN '9' END AS arr_changed_platform,
    CASE k % 10 WHEN 3 THEN 'c' WHEN 4 THEN 'p' END AS arr_status,
    CASE WHEN k % 5 <> 0 AND k % 3 <> 0 THEN moved END AS dep_changed,
    CASE WHEN k % 2 = 0 THEN CASE k % 10 WHEN 3 THEN 'c' WHEN 4 THEN 'p' END END AS dep_status
  FROM feed WHERE event_type NOT IN ('view', 'click')),
first_plan AS (
  SELECT * FROM plan WHERE labelled QUALIFY row_number() OVER (PARTITION BY stop_id ORDER BY ts, event_id) = 1),
folded AS (
  SELECT stop_id,
    arg_max(arr_changed, (ts, event_id)) FILTER (WHERE arr_changed IS NOT NULL) AS arr_changed,
    arg_max(arr_status, (ts, event_id)) FILTER (WHERE arr_status IS NOT NULL) AS arr_status,
    arg_max(dep_changed, (ts, event_id)) FILTER (WHERE dep_changed IS NOT NULL) AS dep_changed,
    arg_max(dep_status, (ts, event_id)) FILTER (WHERE dep_status IS NOT NULL) AS dep_status
  FROM change GROUP BY stop_id)"""
FEEDS = (KEYED, FEED)

ORACLES["raw_log_documents"] = _with(*FEEDS) + """
SELECT 'timetables/v1/plan' AS api_name, eva, count(DISTINCT event_id // 4) AS documents, true AS filled FROM plan GROUP BY eva
UNION ALL
SELECT 'timetables/v1/fchg', eva, count(DISTINCT event_id // 4), true FROM change GROUP BY eva"""

_DOC = """min(event_id) OVER (PARTITION BY eva, event_id // 4) AS doc_id,
  CAST(row_number() OVER (PARTITION BY eva, event_id // 4 ORDER BY ts, event_id) - 1 AS INTEGER) AS pos"""
ORACLES["xml_plan_stops"] = _with(*FEEDS) + f"""
SELECT {_DOC}, eva, station, stop_id, labelled, category, number, {_ts('arr_planned')}, {_ts('dep_planned')},
  arr_line, dep_line, CASE WHEN arr_present THEN route ELSE '' END AS arr_path,
  CASE WHEN dep_present THEN route ELSE '' END AS dep_path
FROM plan"""
ORACLES["xml_change_stops"] = _with(*FEEDS) + f"""
SELECT {_DOC}, eva, stop_id, {_ts('arr_changed')}, arr_changed_platform, arr_status, {_ts('dep_changed')}, dep_status
FROM change"""

_CONDENSED = f"""
SELECT station AS station_name, eva, category AS train_type, number AS train_number,
  coalesce(nullif(arr_line, ''), nullif(dep_line, '')) AS line_number,
  regexp_extract(p.stop_id, '^(.*)-([^-]*)$', 1) AS train_line_ride_id,
  CAST(regexp_extract(p.stop_id, '^(.*)-([^-]*)$', 2) AS BIGINT) AS train_line_station_num,
  {_ts('arr_planned', 'arrival_planned_time')},
  {_ts('coalesce(arr_changed, arr_planned)', 'arrival_change_time')},
  {_ts('dep_planned', 'departure_planned_time')},
  {_ts('coalesce(dep_changed, dep_planned)', 'departure_change_time')},
  coalesce(arr_status = 'c', false) OR coalesce(dep_status = 'c', false) AS is_canceled
FROM first_plan p LEFT JOIN folded f ON f.stop_id = p.stop_id"""
ORACLES["xml_condense_day"] = _with(*FEEDS) + _CONDENSED
ORACLES["condense_station_runs"] = _with(*FEEDS) + _CONDENSED + r"""
WHERE regexp_extract(p.stop_id, '^(.*)-([^-]*)$', 1) IN (
  SELECT regexp_extract(stop_id, '^(.*)-([^-]*)$', 1) FROM first_plan WHERE eva IN ('8000', '8001'))"""
ORACLES["plan_first_wins"] = _with(*FEEDS) + f"""
SELECT stop_id, eva, station, category, number, {_ts('arr_planned')}, {_ts('dep_planned')} FROM first_plan"""
ORACLES["change_last_wins"] = _with(*FEEDS) + f"""
SELECT stop_id, {_ts('arr_changed')}, arr_status, {_ts('dep_changed')}, dep_status FROM folded"""
ORACLES["damaged_documents"] = _with(*FEEDS) + """
SELECT 'plan' AS kind, stop_id, count(*) AS rows FROM plan GROUP BY stop_id
UNION ALL SELECT 'change', stop_id, count(*) FROM change GROUP BY stop_id"""
ORACLES["stream_first_plan"] = ORACLES["plan_first_wins"]
ORACLES["stream_change_fold"] = ORACLES["change_last_wins"]
ORACLES["stream_first_plan_watermark"] = ORACLES["plan_first_wins"]
ORACLES["stream_change_states"] = ORACLES["change_last_wins"]
ORACLES["stream_condense"] = ORACLES["xml_condense_day"]

LIVE = """any_plan AS (
  SELECT * FROM plan QUALIFY row_number() OVER (PARTITION BY stop_id ORDER BY ts, event_id) = 1),
last_change AS (
  SELECT * FROM change QUALIFY row_number() OVER (PARTITION BY stop_id ORDER BY ts DESC, event_id DESC) = 1),
board AS (
  SELECT p.*, coalesce(arr_line, dep_line) AS line, arr_changed_platform, arr_status, dep_status,
    CASE WHEN arr_present THEN arr_changed END AS arr_changed,
    CASE WHEN dep_present THEN dep_changed END AS dep_changed
  FROM any_plan p LEFT JOIN last_change c ON c.stop_id = p.stop_id)"""
ORACLES["live_board_merge"] = _with(*FEEDS, LIVE) + f"""
SELECT stop_id, eva, coalesce(CASE WHEN starts_with(line, category) THEN line ELSE category || ' ' || line END,
    category || ' ' || number) AS label,
  {_ts('coalesce(arr_changed, arr_planned)', 'arr_best')}, {_ts('coalesce(dep_changed, dep_planned)', 'dep_best')},
  CASE WHEN arr_present THEN coalesce(arr_changed_platform, '5') END AS arr_best_platform,
  arr_present AND coalesce(arr_status = 'c', false) AS arr_cancelled,
  dep_present AND coalesce(dep_status = 'c', false) AS dep_cancelled,
  round((epoch(arr_changed) - epoch(arr_planned)) / 60.0, 6) + 0.0 AS arr_live,
  CASE WHEN arr_present AND route <> '' THEN split_part(route, '|', 1) END AS origin,
  CASE WHEN dep_present AND route <> '' THEN 'NATION_3' END AS destination
FROM board"""
ORACLES["stream_live_board"] = ORACLES["live_board_merge"]
ORACLES["current_board_rows"] = _with(*FEEDS, LIVE) + f"""
SELECT stop_id, {_ts('coalesce(dep_changed, dep_planned)', 'dep_best')} FROM board
WHERE coalesce(dep_changed, dep_planned) >= TIMESTAMP '2024-01-15 07:10:00' - INTERVAL 5 MINUTE"""

ORACLES["stations"] = _with(STATION) + "SELECT * FROM station"
ORACLES["station_resolve_topk"] = _with(
    STATION,
    """asked AS (SELECT DISTINCT unnest([name, substr(name, 4, 5), upper(substr(name, -2, 2)), ' ']) AS text FROM station),
hit AS (
  SELECT text, eva, name, CAST(CASE WHEN starts_with(lower(name), lower(trim(text))) AND trim(text) <> '' THEN 1000000 ELSE 0 END + weight AS INTEGER) AS score
  FROM asked JOIN station ON contains(lower(name), lower(trim(text)))),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY text ORDER BY score DESC, eva) AS INTEGER) AS rank FROM hit)""",
) + "SELECT * FROM ranked WHERE rank <= 3"
ORACLES["route_stations"] = _with(*FEEDS, STATION) + """
SELECT stop_name, eva, weight, count(*) AS n
FROM (SELECT unnest(string_split(route, '|')) AS stop_name FROM plan WHERE dep_present AND route <> '')
JOIN station ON lower(stop_name) = lower(regexp_replace(name, '_0', '_')) GROUP BY ALL"""

ORACLES["stale_partitions"] = """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS version FROM events GROUP BY 1
HAVING day >= '2024-01-29' OR day LIKE '%7'"""
ORACLES["tier_staleness"] = "SELECT false AS base_stale, max(ts) > TIMESTAMP '2024-01-03' AS recent_stale FROM events"
ORACLES["meta_in_use"] = """
SELECT CAST(CAST(max(ts) AS DATE) AS VARCHAR) AS base_generated, CAST(CAST(max(ts) AS DATE) AS VARCHAR) AS recent_through,
  CAST(count(DISTINCT user_id) AS INTEGER) AS trains, true AS updated FROM events"""

# ---------------------------------------------------------------- prepare and history

_LABEL = """coalesce(CASE WHEN starts_with(line_number, train_type) THEN line_number
  ELSE train_type || ' ' || line_number END, train_type || ' ' || train_number)"""
ORACLES["train_identity_key"] = _with(KEYED, MANY) + f"""
SELECT ltrim(eva, '0') AS eva, train_type || ' ' || train_number AS identity,
  'X_' || {_key("train_type || ' ' || train_number")} || coalesce('_' || line_number, '') AS train_key,
  {_key("train_type || ' ' || train_number")} || coalesce(',' || line_number, '') AS keys,
  {_LABEL} AS label, count(*) AS n
FROM stop_event GROUP BY ALL"""
ORACLES["semi_join_station_trains"] = _with(KEYED, NETWORK) + """
SELECT train_type || ' ' || train_number AS identity, ltrim(eva, '0') AS eva, count(*) AS n FROM stop_event
WHERE train_type || train_number IN (SELECT train_type || train_number FROM stop_event WHERE eva = '08002') GROUP BY ALL"""
ORACLES["prev_stop_delay"] = _with(KEYED, MANY, PREPARED) + f"""
SELECT seq, {_day('service_day')}, train_line_station_num, prev_delay FROM prepared"""
ORACLES["prepared_events"] = _with(KEYED, MANY, PREPARED) + f"""
SELECT seq, station_name, eva, identity, line_number, is_canceled, arr_delay, dep_delay, prev_delay, {_day('day')}, tod FROM prepared"""
ORACLES["history_runs"] = _with(*RUNS) + f"""
SELECT train_key, train, train_type, line_number, station_name, eva, {_day('day')}, tod, arr_delay, dep_delay, prev_delay, cancelled FROM run"""
ORACLES["train_lines"] = _with(*RUNS) + """
SELECT train_key, min(train) AS train, min(train_type) AS train_type,
  arg_max(line_number, (day, tod, train, line_number)) FILTER (WHERE line_number <> '') AS line FROM run GROUP BY train_key"""
ORACLES["history_index"] = _with(*RUNS) + "SELECT train_key, count(*) AS runs FROM run GROUP BY 1"
ORACLES["build_metadata"] = _with(*RUNS) + """
SELECT '8000,8001' AS stations,
  string_agg(DISTINCT strftime(day, '%Y-%m'), ',' ORDER BY strftime(day, '%Y-%m')) FILTER (WHERE day < DATE '2024-01-29') AS months,
  count(DISTINCT train_key) AS trains,
  CAST(min(day) FILTER (WHERE day >= DATE '2024-01-29') AS VARCHAR) AS recent_from,
  CAST(max(day) FILTER (WHERE day >= DATE '2024-01-29') AS VARCHAR) AS recent_through FROM run"""
ORACLES["history_nested_columnar"] = _with(
    *RUNS,
    """m AS (SELECT *, CAST(date_diff('month', DATE '1970-01-01', day) AS INTEGER) AS block FROM run),
r AS (
  SELECT *, row_number() OVER w - 1 AS i, lag(day) OVER w AS before,
    dense_rank() OVER (PARTITION BY train_key, station_name, block ORDER BY tod) - 1 AS t
  FROM m WINDOW w AS (PARTITION BY train_key, station_name, block ORDER BY day, tod, arr_delay NULLS FIRST,
    dep_delay NULLS FIRST, prev_delay NULLS FIRST, cancelled))""",
) + """
SELECT train_key, station_name, block, min(eva) AS eva,
  array_to_string(list_sort(list(DISTINCT tod)), ',') AS tod,
  string_agg(CAST(CASE WHEN before IS NULL THEN day - DATE '1970-01-01' ELSE day - before END AS VARCHAR), ',' ORDER BY i) AS days,
  CASE WHEN max(t) > 0 THEN string_agg(CAST(t AS VARCHAR), ',' ORDER BY i) END AS t,
  string_agg(coalesce(CAST(arr_delay AS VARCHAR), '-'), ',' ORDER BY i) AS a,
  CASE WHEN bool_or(dep_delay IS NOT NULL AND dep_delay IS DISTINCT FROM arr_delay) THEN
    string_agg(CASE WHEN dep_delay IS DISTINCT FROM arr_delay THEN coalesce(CAST(dep_delay AS VARCHAR), '-') ELSE '-' END, ',' ORDER BY i) END AS d,
  string_agg(coalesce(CAST(prev_delay AS VARCHAR), '-'), ',' ORDER BY i) AS p,
  string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) FILTER (WHERE cancelled) AS c
FROM r GROUP BY 1, 2, 3"""
_BAG = f"""
SELECT train_key, station_name, eva, {_day('day')}, tod, arr_delay, dep_delay, prev_delay, cancelled, count(*) AS n
FROM {{source}} GROUP BY ALL"""
_FILLED = "(SELECT * REPLACE (coalesce(dep_delay, arr_delay) AS dep_delay) FROM run)"
ORACLES["history_round_trip"] = _with(*RUNS) + _BAG.format(source=_FILLED)
ORACLES["history_json_round_trip"] = ORACLES["history_round_trip"]
ORACLES["history_legacy_rows"] = _with(*RUNS) + _BAG.format(source="run WHERE tod % 7 <> 0 AND tod % 11 <> 0")
_TIERS = """recent AS (SELECT * REPLACE (arr_delay + 1 AS arr_delay, dep_delay + 1 AS dep_delay) FROM run WHERE day >= DATE '2024-01-29'),
merged AS (
  SELECT * FROM run b WHERE NOT EXISTS (SELECT 1 FROM recent r WHERE r.train_key = b.train_key
    AND r.station_name = b.station_name AND r.day = b.day AND r.tod = b.tod)
  UNION ALL SELECT * FROM recent)"""
ORACLES["overlay_recent"] = _with(*RUNS, _TIERS) + _BAG.format(source="merged")
ORACLES["stream_overlay"] = ORACLES["overlay_recent"]

_SERVICE = "CAST(coalesce(arrival_planned_time, departure_planned_time) - INTERVAL 4 HOUR AS DATE)"
_LATER = f"""stop_event AS (
  SELECT * REPLACE (
    CASE WHEN {_SERVICE} >= DATE '2024-01-29' THEN arrival_change_time + INTERVAL 1 MINUTE ELSE arrival_change_time END AS arrival_change_time,
    CASE WHEN {_SERVICE} >= DATE '2024-01-29' THEN departure_change_time + INTERVAL 1 MINUTE ELSE departure_change_time END AS departure_change_time)
  FROM known_event)"""
ORACLES["incremental_rebuild"] = _with(KEYED, MANY.replace("stop_event AS", "known_event AS"), _LATER, PREPARED, RUN) + _BAG.format(source="run")
ORACLES["monthly_and_daily_files"] = _with(KEYED, MANY) + f"""
SELECT source_file, CASE WHEN file_day < DATE '2024-01-29' THEN substr(source_file, 6) END AS month,
  CASE WHEN file_day >= DATE '2024-01-29' THEN substr(source_file, 13) END AS recent_day, count(*) AS events,
  count(DISTINCT train_line_ride_id) AS rides, CAST(sum(CAST(is_canceled AS INTEGER)) AS BIGINT) AS cancelled
FROM (SELECT *, CASE WHEN file_day < DATE '2024-01-29' THEN strftime(file_day, 'data-%Y-%m') ELSE strftime(file_day, 'data-recent-%Y-%m-%d') END AS source_file
  FROM (SELECT *, coalesce({_SERVICE}, DATE '2024-01-01') AS file_day FROM stop_event))
GROUP BY ALL"""
ORACLES["daily_table"] = _with(KEYED, MANY) + f"""
SELECT CAST(service_day AS VARCHAR) AS service_day, count(*) AS events, count(DISTINCT train_number) AS trains
FROM (SELECT *, {_SERVICE} AS service_day FROM stop_event) WHERE service_day < DATE '2024-01-29' OR service_day IS NOT NULL AND train_type = 'S' GROUP BY 1"""
ORACLES["station_lines"] = _with(STATION) + "SELECT eva, name, CAST(CASE WHEN weight % 2 = 0 THEN weight ELSE 0 END AS INTEGER) AS weight FROM station"

# ---------------------------------------------------------------- calendar and boards

_DAYS = "(SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)"
ORACLES["calendar_holidays"] = f"""
SELECT {_day('d')}, CAST({_easter('year(d)')} AS VARCHAR) AS easter, {_holiday('d')} AS holiday, {_holiday('d', True)} AS bavarian,
  CAST(CASE WHEN {_holiday('d')} THEN 7 ELSE isodow(d) END AS INTEGER) AS weekday FROM {_DAYS}"""
ORACLES["timetable_change"] = f"""
WITH sunday AS (
  SELECT CAST(x AS DATE) AS s FROM generate_series(DATE '1990-01-01', DATE '2030-12-31', INTERVAL 1 DAY) t(x)
  WHERE isodow(x) = 7 AND month(x) IN (6, 12) AND day(x) BETWEEN 8 AND 14)
SELECT {_day('d')}, CAST(min(s) AS VARCHAR) AS change, d + 30 >= min(s) AS crosses FROM {_DAYS} JOIN sunday ON s > d GROUP BY d"""

ENTRY = """entry AS (
  SELECT ltrim(eva, '0') AS eva, station_name, train_type AS category, train_number AS number, line_number AS line,
    CAST(hour(arrival_planned_time) * 60 + minute(arrival_planned_time) AS INTEGER) AS arr_tod,
    CAST(hour(departure_planned_time) * 60 + minute(departure_planned_time) AS INTEGER) AS dep_tod,
    CAST(bit_or(1 << (isodow(coalesce(departure_planned_time, arrival_planned_time)) - 1)) AS INTEGER) AS weekday_mask,
    max(CAST(coalesce(departure_planned_time, arrival_planned_time) AS DATE)) AS last_seen, count(*) AS runs
  FROM stop_event
  WHERE CAST(coalesce(departure_planned_time, arrival_planned_time) AS DATE) >
    (SELECT max(CAST(coalesce(departure_planned_time, arrival_planned_time) AS DATE)) FROM stop_event) - 42
  GROUP BY ALL HAVING count(*) >= 3)"""
_ENTRY_COLUMNS = f"eva, station_name, category, number, line, arr_tod, dep_tod, weekday_mask, {_day('last_seen')}"
ORACLES["board_entries"] = _with(KEYED, NETWORK, ENTRY) + f"SELECT {_ENTRY_COLUMNS}, runs FROM entry"
ORACLES["board_documents"] = _with(KEYED, NETWORK, ENTRY) + f"SELECT {_ENTRY_COLUMNS} FROM entry"
ORACLES["board_station_count"] = _with(KEYED, MANY, ENTRY) + """
SELECT count(*) AS entries, count(DISTINCT eva) AS stations FROM entry"""

DAY0 = "day0 AS (SELECT max(CAST(coalesce(arrival_planned_time, departure_planned_time) AS DATE)) + 1 AS day FROM stop_event)"
# Needs req(board_id, eva, start_ts, end_ts).
SYN = f"""dated AS (SELECT q.*, CAST(start_ts AS DATE) + o AS date FROM req q, (VALUES (0), (1)) t(o)),
syn0 AS (
  SELECT board_id, date, e.*, CAST(date AS TIMESTAMP) + to_minutes(arr_tod) AS arr_planned,
    CAST(date AS TIMESTAMP) + to_minutes(dep_tod) AS dep_planned, start_ts, end_ts
  FROM dated JOIN entry e USING (eva)
  WHERE (weekday_mask & (1 << (CASE WHEN {_holiday('date')} THEN 7 ELSE isodow(date) END - 1))) <> 0
    AND last_seen >= (SELECT day FROM day0) - 60),
syn AS (
  SELECT *, 'syn-' || category || '-' || number || '-' || CAST(date AS VARCHAR) AS stop_id FROM syn0
  WHERE coalesce(dep_planned, arr_planned) >= start_ts AND coalesce(dep_planned, arr_planned) < end_ts
  QUALIFY row_number() OVER (PARTITION BY board_id, date, category, number ORDER BY coalesce(dep_tod, arr_tod, 0),
    line NULLS FIRST, arr_tod NULLS FIRST, dep_tod NULLS FIRST, station_name) = 1)"""
ORACLES["synthetic_board"] = _with(
    KEYED,
    NETWORK,
    ENTRY,
    DAY0,
    STATION,
    """req AS (SELECT eva || '|' || h AS board_id, eva, CAST(day AS TIMESTAMP) + to_hours(h) AS start_ts,
    CAST(day AS TIMESTAMP) + to_hours(h + 5) AS end_ts FROM station, day0, (VALUES (3), (7), (17), (23)) t(h))""",
    SYN,
) + f"""
SELECT board_id, stop_id, line, {_ts('arr_planned')}, {_ts('dep_planned')},
  CAST(row_number() OVER (PARTITION BY board_id ORDER BY coalesce(syn.dep_planned, syn.arr_planned), stop_id) AS INTEGER) AS position FROM syn"""

CALL = "call AS (SELECT train_key, station_name, eva, tod, max(day) AS last_day FROM run GROUP BY ALL)"
# Needs origin(train_key, origin_eva, origin_tod).
ROUTE = """ahead AS (
  SELECT o.train_key, origin_eva, origin_tod, station_name, min((tod - origin_tod + 1440) % 1440) AS ahead
  FROM origin o JOIN call c ON c.train_key = o.train_key AND c.eva <> origin_eva
  WHERE (tod - origin_tod + 1440) % 1440 BETWEEN 1 AND 599 GROUP BY ALL),
route AS (
  SELECT train_key, origin_eva, origin_tod, list(station_name ORDER BY ahead, station_name) AS path FROM ahead GROUP BY ALL)"""
ORACLES["route_after_stop"] = _with(
    *RUNS, CALL, "origin AS (SELECT DISTINCT train_key, eva AS origin_eva, tod AS origin_tod FROM call)", ROUTE
) + "SELECT train_key, origin_eva, origin_tod, array_to_string(path, '|') AS path FROM route"
ORACLES["timetable_check"] = _with(
    *RUNS,
    FEED,
    CALL,
    f"""asked AS (SELECT DISTINCT {_key("category || ' ' || number")} AS train_key, lower(station) AS station_name,
    CAST(hour(coalesce(arr_planned, dep_planned)) * 60 + minute(coalesce(arr_planned, dep_planned)) + 7 AS INTEGER) AS tod FROM plan WHERE labelled)""",
) + """
SELECT a.train_key, a.station_name, a.tod, CAST(min(abs(c.tod - a.tod)) AS INTEGER) AS gap, min(abs(c.tod - a.tod)) > 3 AS mismatch
FROM asked a JOIN call c ON c.train_key = a.train_key AND lower(c.station_name) = a.station_name GROUP BY 1, 2, 3"""

# ---------------------------------------------------------------- distributions

ASKED = """asked AS (
  SELECT eva || '|' || train AS query_id, train_type AS category, split_part(train, ' ', 2) AS number, train_key, eva, station_name,
    min(tod) AS q_tod, (SELECT max(day) + 1 FROM run) AS as_of,
    CASE WHEN CAST(split_part(train, ' ', 2) AS INTEGER) % 2 = 1 THEN CAST(split_part(train, ' ', 2) AS DOUBLE) * 3 END AS live
  FROM run GROUP BY train_type, train, train_key, eva, station_name)"""


def _points(live: str) -> str:
    """Needs asked(query_id, train_key, station_name, q_tod, as_of, live)."""
    return f"""seen AS (
  SELECT query_id, {live} AS live, coalesce(arr_delay, dep_delay) AS final, prev_delay AS prev, {_weight('r.day', 'as_of')} AS w
  FROM asked q JOIN run r ON r.train_key = q.train_key AND r.station_name = q.station_name
  WHERE {_near('r.tod', 'q_tod')} AND NOT cancelled AND coalesce(arr_delay, dep_delay) IS NOT NULL),
counted AS (
  SELECT *, count(*) OVER (PARTITION BY query_id) AS sample,
    live IS NOT NULL AND count(prev) OVER (PARTITION BY query_id) >= 8 AS on_live FROM seen),
point AS (
  SELECT query_id, sample, on_live, CASE WHEN on_live THEN live + final - prev ELSE CAST(final AS DOUBLE) END AS value,
    w * CASE WHEN on_live THEN 0.15 + exp(-0.5 * power((prev - live) / greatest(3.0, 0.3 * abs(live)), 2)) ELSE 1.0 END AS weight
  FROM counted WHERE NOT on_live OR prev IS NOT NULL),
shared AS (
  SELECT *, round(sum(weight) OVER (PARTITION BY query_id ORDER BY value) / sum(weight) OVER (PARTITION BY query_id), 9) AS share FROM point),
size AS (
  SELECT query_id, max(sample) AS sample, power(sum(weight), 2) / sum(weight * weight) AS effective_n, bool_or(on_live) AS on_live
  FROM point GROUP BY query_id)"""


BLIND, LIVED = _points("CAST(NULL AS DOUBLE)"), _points("live")
RATE = f"""rate AS (
  SELECT query_id, avg(CAST(cancelled AS INTEGER)) AS cancel_rate, count(*) AS calls
  FROM asked q JOIN run r ON r.train_key = q.train_key AND r.station_name = q.station_name WHERE {_near('r.tod', 'q_tod')} GROUP BY query_id)"""
ORACLES["cancel_rate"] = _with(*RUNS, ASKED, RATE) + f"SELECT query_id, {_r('cancel_rate', 'cancel_rate')}, calls FROM rate"
ORACLES["effective_n"] = _with(*RUNS, ASKED, LIVED) + f"SELECT query_id, sample, {_r('effective_n', 'effective_n')}, on_live FROM size"
_Q = ", ".join(f"min(value) FILTER (WHERE share >= {p}) AS {n}" for n, p in (("q10", 0.1), ("q50", 0.5), ("q90", 0.9)))
ORACLES["empirical_blind_quantiles"] = _with(*RUNS, ASKED, BLIND) + f"SELECT query_id, {_Q} FROM shared GROUP BY 1"
ORACLES["empirical_delta_quantiles"] = _with(*RUNS, ASKED, LIVED) + f"SELECT query_id, {_Q} FROM shared GROUP BY 1"
ORACLES["empirical_cdf_within5"] = _with(*RUNS, ASKED, BLIND) + """
SELECT query_id, round(coalesce(sum(weight) FILTER (WHERE value <= 5), 0) / sum(weight), 6) + 0.0 AS p_within5,
  round(coalesce(sum(weight) FILTER (WHERE value <= 0), 0) / sum(weight), 6) + 0.0 AS p_on_time FROM point GROUP BY 1"""
ORACLES["distribution_histogram"] = _with(
    *RUNS,
    ASKED,
    LIVED,
    """edge AS (
  SELECT query_id, greatest(CAST(floor(min(value) FILTER (WHERE share >= 0.005)) AS INTEGER), -20) AS lo,
    CAST(ceil(min(value) FILTER (WHERE share >= 0.995)) AS INTEGER) AS top FROM shared GROUP BY 1),
framed AS (SELECT query_id, lo, greatest(least(top, 180), lo + 6) AS hi FROM edge),
laid AS (SELECT *, CASE WHEN hi - lo <= 30 THEN 1 WHEN hi - lo <= 75 THEN 2 ELSE 5 END AS width FROM framed),
bin AS (SELECT query_id, width, unnest(generate_series(CAST(floor(lo / width) * width AS INTEGER), hi - 1, width)) AS bin FROM laid)""",
) + """
SELECT query_id, CAST(bin AS INTEGER) AS bin, width,
  round((coalesce(sum(weight) FILTER (WHERE value > bin AND value <= bin + width), 0)) / sum(weight), 6) + 0.0 AS share,
  CAST(CASE WHEN width * 31 <= 40 THEN 10 WHEN width * 31 <= 60 THEN 15 WHEN width * 31 <= 120 THEN 30 WHEN width * 31 <= 240 THEN 60 END AS INTEGER) AS tick
FROM bin JOIN point USING (query_id) GROUP BY query_id, bin, width"""

_LONG = "'ICE','IC','EC','ECE','RJ','RJX','NJ','EN','FLX','TGV','D','IR'"


def _class(c: str) -> str:
    return f"""CASE WHEN upper({c}) IN ({_LONG}, 'WB') THEN 'LONG_DISTANCE' WHEN upper({c}) = 'S' THEN 'SBAHN'
  WHEN upper({c}) IN ('RE','RB','IRE','MEX','TER','BRB','AG') THEN 'REGIONAL' WHEN regexp_matches({c}, '^\\p{{L}}') THEN 'REGIONAL' ELSE 'OTHER' END"""


def _bucket(c: str) -> str:
    return f"CASE WHEN {c} IN ({_LONG}) THEN 'long_distance' WHEN {c} = 'S' THEN 'sbahn' ELSE 'regional' END"


ORACLES["scores_file"] = _with(*RUNS) + f"""
SELECT {_bucket("split_part(train_key, '_', 1)")} AS bucket, count(*) AS n, round(avg(abs(arr_delay)), 3) AS mae FROM run
WHERE NOT cancelled AND arr_delay IS NOT NULL GROUP BY 1"""


def _band(t: str) -> str:
    return f"""CASE WHEN hour({t}) BETWEEN 6 AND 8 THEN 'MORNING_PEAK' WHEN hour({t}) BETWEEN 9 AND 15 THEN 'MIDDAY'
  WHEN hour({t}) BETWEEN 16 AND 18 THEN 'EVENING_PEAK' ELSE 'NIGHT' END"""


ORACLES["train_class_time_band"] = _with(KEYED, MANY) + f"""
SELECT category, {_class('category')} AS train_class, {_bucket('category')} AS bucket, {_band('t')} AS band,
  {_class('category')} <> 'LONG_DISTANCE' AS covered, count(*) AS n
FROM (SELECT unnest([train_type, 'WB', 'ice', 's', 'Ag', 'ALX', '4x', '']) AS category,
  coalesce(arrival_planned_time, departure_planned_time) AS t FROM stop_event) GROUP BY ALL"""
ORACLES["departure_defaults"] = _with(KEYED) + f"""
SELECT event_id, {_ts('depart')},
  CAST(greatest(0, date_sub('minute', now, depart)) AS INTEGER) AS travel, strftime(depart + to_minutes(CAST(floor(value) AS BIGINT)), '%H:%M') AS clock
FROM (
  SELECT *, CASE WHEN k % 2 = 0 THEN CAST(date AS TIMESTAMP) + to_minutes((k % 24) * 60 + CASE WHEN k % 4 = 0 THEN k % 60 ELSE 0 END)
    WHEN date <> CAST(ts AS DATE) THEN CAST(date AS TIMESTAMP) + INTERVAL 6 HOUR ELSE now END AS depart
  FROM (SELECT *, date_trunc('minute', ts) AS now, CASE WHEN k % 3 = 0 THEN CAST(ts AS DATE) + k % 5 ELSE CAST(ts AS DATE) END AS date FROM keyed))"""

# ---------------------------------------------------------------- bucket model and forecast

STATS = f"""obs AS (
  SELECT {_class('train_type')} AS train_class, {_band('planned')} AS time_band,
    greatest(-15.0, least(240.0, coalesce(arr_delay, dep_delay))) AS x
  FROM prepared WHERE NOT is_canceled AND coalesce(arr_delay, dep_delay) IS NOT NULL),
stats AS (SELECT train_class, time_band, count(*) AS n, avg(x) AS mean, var_pop(x) * count(*) AS m2 FROM obs GROUP BY ALL),
prior AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {a}, {b}, {c}, {e})" for k, (a, b, c, e) in PRIORS.items())})
  t(train_class, mu0, kappa0, alpha0, beta0))"""
# Needs wanted(..., train_class, time_band).
PREDICTIVE = """pred AS (
  SELECT * EXCLUDE (n, mean, m2), 2 * (alpha0 + n / 2) AS df, (kappa0 * mu0 + n * mean) / (kappa0 + n) AS loc,
    sqrt((beta0 + m2 / 2 + kappa0 * n * power(mean - mu0, 2) / (2 * (kappa0 + n))) * (kappa0 + n + 1)
      / ((alpha0 + n / 2) * (kappa0 + n))) AS scale
  FROM (SELECT w.*, mu0, kappa0, alpha0, beta0, CAST(coalesce(n, 0) AS DOUBLE) AS n, coalesce(mean, 0) AS mean, coalesce(m2, 0) AS m2
    FROM wanted w JOIN prior USING (train_class) LEFT JOIN stats USING (train_class, time_band)))"""
_WANTED = f"""wanted AS (SELECT DISTINCT {_class('train_type')} AS train_class,
  unnest(['MORNING_PEAK', 'MIDDAY', 'EVENING_PEAK', 'NIGHT']) AS time_band FROM prepared)"""
ORACLES["bucket_stats"] = _with(KEYED, MANY, PREPARED, STATS) + f"SELECT train_class, time_band, n, {_r('mean', 'mean')}, {_r('m2', 'm2', 3)} FROM stats"
ORACLES["stream_bucket_stats"] = _with(KEYED, MANY, PREPARED, STATS) + f"SELECT train_class, time_band, 2 * n AS n, {_r('mean', 'mean')}, {_r('2 * m2', 'm2', 3)} FROM stats"
_PARAMS = ", ".join(_r(c, c) for c in ("df", "loc", "scale"))
ORACLES["nig_posterior"] = _with(KEYED, MANY, PREPARED, STATS, _WANTED, PREDICTIVE) + f"SELECT train_class, time_band, {_PARAMS} FROM pred"
ORACLES["live_anchor"] = _with(KEYED, MANY, PREPARED, STATS, _WANTED, PREDICTIVE) + f"""
SELECT train_class, time_band, {_PARAMS} FROM (SELECT * REPLACE (
  CASE WHEN time_band <> 'MIDDAY' THEN length(time_band) * 1.5 ELSE loc END AS loc,
  CASE WHEN time_band <> 'MIDDAY' THEN greatest(scale * 0.4, 1.2) ELSE scale END AS scale) FROM pred)"""
# Student-t by sums over a grid of the angle, t = sqrt(df) * tan(angle): the density is cos(angle)**(df - 1) over its
# integral, and running sums (trapezoids and the slope's correction) are inverted by series around a grid point.
_STEP = "(pi() / 40000)"
T_GRID = f"""grid AS (SELECT df, i, i * {_STEP} AS u FROM (SELECT DISTINCT df FROM pred), range(20001) steps(i)),
density AS (SELECT *, power(greatest(cos(u), 0), df - 1) AS f, -(df - 1) * power(greatest(cos(u), 0), df - 2) * sin(u) AS g FROM grid),
areas AS (SELECT *, (sum(f) OVER (PARTITION BY df ORDER BY i) - f / 2 - 0.5) * {_STEP} - g * power({_STEP}, 2) / 12 AS area FROM density),
halves AS (SELECT df, max(area) AS half FROM areas GROUP BY df),
goals AS (SELECT df, p, half * 2 * abs(p - 0.5) AS goal FROM halves, (VALUES (0.1), (0.5), (0.9)) ps(p)),
below AS (SELECT q.df, q.p, any_value(goal) AS goal, arg_max(u, i) AS u, arg_max(f, i) AS f, arg_max(g, i) AS g, arg_max(area, i) AS area
  FROM goals q JOIN areas a ON a.df = q.df AND a.area <= goal + 1e-18 GROUP BY q.df, q.p),
quantile AS (SELECT df, CAST(p AS DOUBLE) AS p, sign(p - 0.5) * sqrt(df) * tan(u + (goal - area) / f - g * power(goal - area, 2) / (2 * power(f, 3))) AS t FROM below)"""
ORACLES["student_t_quantiles"] = _with(KEYED, MANY, PREPARED, STATS, _WANTED, PREDICTIVE, T_GRID) + f"""
SELECT train_class, time_band, p, {_r('loc + scale * t', 'x')}, {_r('p', 'back')} FROM pred JOIN quantile USING (df)"""
ORACLES["forecast_source"] = _with(
    *RUNS,
    STATS,
    ASKED,
    LIVED,
    RATE,
    f"""every AS (SELECT * FROM asked UNION ALL
  SELECT * REPLACE ('unseen|' || query_id AS query_id) FROM asked WHERE number = '3'),
wanted AS (SELECT query_id, live, {_class('category')} AS train_class,
  {_band("CAST(as_of AS TIMESTAMP) + to_minutes(q_tod)")} AS time_band FROM every)""",
    PREDICTIVE,
) + f"""
SELECT p.query_id, CASE WHEN s.query_id IS NULL THEN 'PRIOR' WHEN on_live THEN 'EMPIRICAL_LIVE' ELSE 'EMPIRICAL' END AS source,
  coalesce(sample, 0) AS run_count, {_r('coalesce(effective_n, 0)', 'effective_runs')}, {_r('cancel_rate', 'cancel_probability')},
  {_r('CASE WHEN s.query_id IS NULL THEN df END', 'df')},
  {_r('CASE WHEN s.query_id IS NULL THEN coalesce(live, loc) END', 'loc')},
  {_r('CASE WHEN s.query_id IS NULL THEN CASE WHEN live IS NULL THEN scale ELSE greatest(scale * 0.4, 1.2) END END', 'scale')}
FROM pred p LEFT JOIN (SELECT * FROM size WHERE effective_n >= 8) s USING (query_id) LEFT JOIN rate r ON r.query_id = s.query_id"""
ORACLES["forecast_cards_seen"] = _with(*RUNS, ASKED, LIVED) + f"""
SELECT query_id, CASE WHEN bool_or(s.on_live) THEN 'EMPIRICAL_LIVE' ELSE 'EMPIRICAL' END AS source,
  {_r('min(value) FILTER (WHERE share >= 0.5)', 'median')}, {_r('min(value) FILTER (WHERE share >= 0.1)', 'q10')},
  {_r('min(value) FILTER (WHERE share >= 0.9)', 'q90')},
  {_r('coalesce(sum(weight) FILTER (WHERE value <= 5), 0) / sum(weight)', 'p_within5')},
  strftime(CAST(any_value(as_of) AS TIMESTAMP) + to_minutes(any_value(q_tod)) + to_seconds(CAST(60 * min(value) FILTER (WHERE share >= 0.5) AS BIGINT)), '%H:%M') AS median_clock
FROM shared s JOIN size z USING (query_id) JOIN asked a USING (query_id) WHERE effective_n >= 8 GROUP BY query_id"""

_SEEN = ORACLES["forecast_cards_seen"].split("\nSELECT ", 1)[1]
ORACLES["forecast_cards"] = _with(
    *RUNS,
    STATS,
    ASKED,
    LIVED,
    f"""every AS (SELECT * FROM asked UNION ALL
  SELECT * REPLACE ('unseen|' || query_id AS query_id) FROM asked WHERE number = '3'),
wanted AS (SELECT query_id, live, as_of, q_tod, {_class('category')} AS train_class,
  {_band("CAST(as_of AS TIMESTAMP) + to_minutes(q_tod)")} AS time_band FROM every
  WHERE query_id NOT IN (SELECT query_id FROM size WHERE effective_n >= 8))""",
    PREDICTIVE,
    T_GRID,
    f"""unseen AS (SELECT * REPLACE (coalesce(live, loc) AS loc, CASE WHEN live IS NULL THEN scale ELSE greatest(scale * 0.4, 1.2) END AS scale) FROM pred),
five AS (SELECT *, (5 - loc) / scale AS t, atan(abs((5 - loc) / scale) / sqrt(df)) AS angle FROM unseen),
met AS (SELECT query_id, five.df, five.t, area + f * (angle - u) + g * power(angle - u, 2) / 2 AS area
  FROM five JOIN areas ON areas.df = five.df AND i = CAST(floor(angle / {_STEP}) AS BIGINT)),
within AS (SELECT query_id, 0.5 + sign(t) * area / (2 * half) AS p5 FROM met JOIN halves USING (df)),
card AS (SELECT query_id, any_value(as_of) AS as_of, any_value(q_tod) AS q_tod,
  {', '.join(f"any_value(loc + scale * t) FILTER (WHERE p = {p}) AS {n}" for p, n in ((0.5, 'median'), (0.1, 'q10'), (0.9, 'q90')))}
  FROM unseen JOIN quantile USING (df) GROUP BY query_id)""",
) + f"""
SELECT {_SEEN}
UNION ALL
SELECT query_id, 'PRIOR', {_r('median', 'median')}, {_r('q10', 'q10')}, {_r('q90', 'q90')}, {_r('p5', 'p_within5')},
  strftime(CAST(as_of AS TIMESTAMP) + to_minutes(q_tod) + to_microseconds(CAST(round(60000000 * median) AS BIGINT)), '%H:%M')
FROM card JOIN within USING (query_id)"""

# ---------------------------------------------------------------- backtest


def _folded(d: str) -> str:
    return f"CASE WHEN {_holiday(d, True)} THEN 6 ELSE isodow({d}) - 1 END"


EVAL = f"""ev AS (
  SELECT eva, train_type, train_number, day, tod, {_clamp('coalesce(arr_delay, dep_delay)')} AS delay, {_clamp('prev_delay')} AS prev
  FROM prepared WHERE eva IN ('8000', '8001', '8002', '8003') AND NOT is_canceled AND coalesce(arr_delay, dep_delay) IS NOT NULL),
gate AS (SELECT * FROM ev QUALIFY count(*) OVER (PARTITION BY eva, train_type, train_number) >= 15),
num AS (SELECT row_number() OVER (ORDER BY eva, train_type, train_number, day, tod, delay, prev) AS id, *,
  {_folded('day')} AS folded FROM gate),
pair0 AS (
  SELECT q.id, q.eva, q.train_type, q.train_number, q.day, q.tod, q.delay AS y, q.prev AS live,
    h.delay AS final, h.prev, q.day - h.day AS age, isodow(q.day) = isodow(h.day) AS same, q.folded = h.folded AS same_hol
  FROM num q JOIN num h ON h.eva = q.eva AND h.train_type = q.train_type AND h.train_number = q.train_number
    AND h.day < q.day AND abs(h.tod - q.tod) <= 20
  WHERE q.day >= (SELECT max(day) FROM ev) - 56),
pair AS (SELECT *, count(*) OVER w AS seen, count(prev) OVER w AS known FROM pair0 WINDOW w AS (PARTITION BY id)
  QUALIFY count(*) OVER w >= 10)"""

_EVAL_PARTS = (KEYED, MANY, PREPARED, EVAL)


def _decay(half_life: float) -> str:
    return f"exp(-ln(2.0) / {half_life} * age)"


# name -> (weight without live information, mode, kernel factor)
_VARIANTS = {
    "uniform": ("1.0", None, None),
    "hl60": (_decay(60), None, None),
    "hl30": (_decay(30), None, None),
    "hl14": (_decay(14), None, None),
    "hl7": (_decay(7), None, None),
    "window35": ("CASE WHEN age <= 35 THEN 1e0 ELSE 0e0 END", None, None),
    "hl14_wd2": (_decay(14) + " * CASE WHEN same THEN 2 ELSE 1 END", None, None),
    "hl14_wd2_hol": (_decay(14) + " * CASE WHEN same_hol THEN 2 ELSE 1 END", None, None),
    "hl60_wd2": (_decay(60) + " * CASE WHEN same THEN 2 ELSE 1 END", None, None),
    "hl30_wd2": (_decay(30) + " * CASE WHEN same THEN 2 ELSE 1 END", None, None),
    "hl30_wd4": (_decay(30) + " * CASE WHEN same THEN 4 ELSE 1 END", None, None),
    "hl30_wd2_hol": (_decay(30) + " * CASE WHEN same_hol THEN 2 ELSE 1 END", None, None),
    "hl30_wd2_kernel": (_decay(30) + " * CASE WHEN same THEN 2 ELSE 1 END", "kernel", 0.3),
    "hl30_wd2_delta": (_decay(30) + " * CASE WHEN same THEN 2 ELSE 1 END", "delta", 0.3),
    "hl30_wd2_delta_nok": (_decay(30) + " * CASE WHEN same THEN 2 ELSE 1 END", "delta", 0.0),
    "hl14_delta": (_decay(14), "delta", 0.3),
}


def _scored(names: list[str]) -> str:
    """Points of every evaluation row, variant and scenario, and their scores."""
    parts = []
    ident = "id, eva, train_type, train_number, day, tod, live, y"
    for name in names:
        w, mode, factor = _VARIANTS[name]
        parts.append(f"SELECT '{name}' AS variant, 'blind' AS scenario, {ident}, CAST(final AS DOUBLE) AS value, {w} AS weight FROM pair")
        lived = "FROM pair WHERE live IS NOT NULL"
        if mode is None:
            parts.append(f"SELECT '{name}', 'live', {ident}, CAST(final AS DOUBLE), {w} {lived}")
            continue
        bump = f"exp(-0.5 * power((prev - live) / greatest(3.0, {factor} * abs(live)), 2))"
        if mode == "delta":
            k = f"(0.15 + {bump})" if factor > 0 else "1.0"
            parts.append(
                f"SELECT '{name}', 'live', {ident}, CASE WHEN known >= 8 THEN CAST(live + final - prev AS DOUBLE) ELSE final END,"
                f" {w} * CASE WHEN known >= 8 THEN {k} ELSE 1.0 END {lived} AND (known < 8 OR prev IS NOT NULL)"
            )
        else:
            k = f"CASE WHEN prev IS NULL THEN 0.05 ELSE {bump} END"
            parts.append(
                f"SELECT '{name}', 'live', {ident}, CAST(final AS DOUBLE), w * CASE WHEN sum(k) OVER o >= 8"
                f" AND power(sum(w * k) OVER o, 2) / sum(w * w * k * k) OVER o >= 8 THEN k ELSE 1.0 END"
                f" FROM (SELECT *, {w} AS w, {k} AS k {lived}) WINDOW o AS (PARTITION BY id)"
            )
    return (
        "pt AS (" + "\nUNION ALL ".join(parts) + """),
per AS (
  SELECT variant, scenario, id, eva, train_type, train_number, day, tod, live, y, value, sum(weight) AS w
  FROM pt GROUP BY ALL),
cum AS (
  SELECT *, sum(w) OVER (g ORDER BY value) AS c, sum(w) OVER g AS t FROM per WINDOW g AS (PARTITION BY variant, scenario, id)),
score0 AS (
  SELECT variant, scenario, id, eva, train_type, train_number, day, tod, live, y,
    sum(w / t * abs(value - y)) - sum(w / t * value * ((c - w) / t - (1 - c / t))) AS crps,
    min(value) FILTER (WHERE round(c / t, 9) >= 0.1) AS q10, min(value) FILTER (WHERE round(c / t, 9) >= 0.5) AS q50,
    min(value) FILTER (WHERE round(c / t, 9) >= 0.9) AS q90
  FROM cum WHERE t > 0 GROUP BY ALL),
score AS (
  SELECT *, CASE WHEN y < q10 THEN 0.9 * (q10 - y) ELSE 0.1 * (y - q10) END AS pinball10,
    CASE WHEN y < q50 THEN 0.5 * (q50 - y) ELSE 0.5 * (y - q50) END AS pinball50,
    CASE WHEN y < q90 THEN 0.1 * (q90 - y) ELSE 0.9 * (y - q90) END AS pinball90,
    y BETWEEN q10 AND q90 AS covered80 FROM score0)"""
    )


_STATE = "eva, train_type, train_number, day, tod"
ORACLES["backtest_pairs"] = _with(*_EVAL_PARTS) + f"""
SELECT eva, train_type, train_number, {_day('day')}, tod, count(*) AS runs, max(known) AS known,
  {_r(f"sum({_VARIANTS['hl30_wd2'][0]})", 'w_hl30_wd2')}, {_r(f"sum({_VARIANTS['window35'][0]})", 'w_window35')},
  {_r(f"sum({_VARIANTS['hl14_wd2_hol'][0]})", 'w_hl14_wd2_hol')}
FROM pair WHERE id IN (SELECT min(id) FROM num GROUP BY {_STATE}) GROUP BY eva, train_type, train_number, day, tod"""
ORACLES["backtest_crps"] = _with(*_EVAL_PARTS, _scored(list(_VARIANTS))) + f"""
SELECT variant, scenario, eva, train_type, train_number, {_day('day')}, tod, live, y, count(*) AS c,
  {_r('min(crps)', 'crps')}, {_r('min(pinball10)', 'pinball10')}, {_r('min(pinball50)', 'pinball50')}, {_r('min(pinball90)', 'pinball90')},
  bool_and(covered80) AS covered80
FROM score GROUP BY variant, scenario, eva, train_type, train_number, score.day, tod, live, y"""
ORACLES["backtest_scores_grouping_sets"] = _with(*_EVAL_PARTS, _scored(list(_VARIANTS))) + f"""
SELECT variant, scenario, coalesce(bucket, 'all') AS bucket, count(*) AS n, round(avg(crps), 3) AS crps, round(avg(pinball10), 3) AS pinball10,
  round(avg(2 * pinball50), 3) AS pinball50_mae, round(avg(pinball90), 3) AS pinball90, round(avg(CAST(covered80 AS INTEGER)), 3) AS coverage80
FROM (SELECT *, {_bucket('train_type')} AS bucket FROM score)
GROUP BY GROUPING SETS ((variant, scenario, bucket), (variant, scenario))"""

# ---------------------------------------------------------------- transfers and journeys

INDEX = "idx AS (SELECT train_key, station_name, min(eva) AS eva FROM run GROUP BY ALL)"
_CALLS = (KEYED, NETWORK, PREPARED, RUN, ENTRY, DAY0, STATION, CALL, INDEX)

# Needs req(board_id, eva, start_ts, end_ts, hours).
BOARDS = f"""lreq AS (SELECT eva AS board_id, eva, CAST(day AS TIMESTAMP) AS start_ts, CAST(day + 1 AS TIMESTAMP) AS end_ts FROM day0, (SELECT DISTINCT eva FROM entry)),
{SYN.replace('dated AS', 'ldated AS').replace('FROM req q', 'FROM lreq q').replace('syn0', 'lsyn0').replace('FROM dated', 'FROM ldated').replace('syn AS', 'lsyn AS')},
{SYN},
origin AS (
  SELECT DISTINCT category || '_' || number AS train_key, eva AS origin_eva, dep_tod AS origin_tod
  FROM (SELECT category, number, eva, dep_tod FROM syn UNION ALL SELECT category, number, eva, dep_tod FROM lsyn) WHERE dep_tod IS NOT NULL),
{ROUTE},
lstop AS (
  SELECT 'live-' || category || '-' || number || '-' || s.eva AS stop_id, s.eva, category, number, arr_planned,
    CASE WHEN CAST(number AS INTEGER) % 2 = 1 THEN arr_planned + to_minutes(CAST(number AS BIGINT)) END AS arr_changed,
    dep_planned, CASE WHEN CAST(number AS INTEGER) % 3 = 1 THEN dep_planned + to_minutes(CAST(number AS BIGINT) % 4 * 3) END AS dep_changed,
    number = '5' AS dep_cancelled, path
  FROM lsyn s LEFT JOIN route r ON r.train_key = category || '_' || number AND origin_eva = s.eva AND origin_tod = dep_tod
  WHERE category IN ('S', 'RE')),
live_row AS (
  SELECT board_id, l.stop_id, category, number, arr_planned, arr_changed, dep_planned, dep_changed, dep_cancelled, path, false AS typical
  FROM req JOIN lstop l ON l.eva = req.eva
  WHERE date_trunc('hour', coalesce(dep_planned, arr_planned)) BETWEEN date_trunc('hour', start_ts) AND date_trunc('hour', start_ts) + to_hours(hours - 1)),
board AS (
  SELECT * FROM live_row UNION ALL
  SELECT board_id, stop_id, category, number, arr_planned, CAST(NULL AS TIMESTAMP), dep_planned, CAST(NULL AS TIMESTAMP), false, path, true
  FROM syn s LEFT JOIN route r ON r.train_key = category || '_' || number AND origin_eva = s.eva AND origin_tod = dep_tod
  WHERE board_id NOT IN (SELECT board_id FROM live_row))"""

_REQUEST = f"""request AS (
  SELECT train_key || '|' || c.eva AS query_id, split_part(train_key, '_', 1) AS f_category, split_part(train_key, '_', 2) AS f_number,
    CAST(day AS TIMESTAMP) + to_minutes(min(tod)) AS start_ts, n.eva AS t_eva, n.name AS t_name, day AS as_of, 'NATION_03' AS dest_name,
    CASE WHEN CAST(split_part(train_key, '_', 2) AS INTEGER) % 2 = 0 THEN false
      ELSE {_class("split_part(train_key, '_', 1)")} <> 'LONG_DISTANCE' END AS ticket_only
  FROM call c JOIN station n ON CAST(n.eva AS INTEGER) = CAST(c.eva AS INTEGER) + 1, day0 WHERE CAST(c.eva AS INTEGER) < 8003
  GROUP BY train_key, c.eva, n.eva, n.name, day)"""

# Needs request(query_id, f_category, f_number, start_ts, t_eva, t_name, as_of, dest_name, ticket_only).
_CHAIN = f"""req AS (SELECT query_id AS board_id, t_eva AS eva, start_ts, start_ts + INTERVAL 4 HOUR AS end_ts, 4 AS hours FROM request),
{BOARDS},
seen_stop AS (SELECT * FROM request JOIN board ON board_id = query_id),
feeder AS (
  SELECT query_id, arr_planned AS feeder_planned, date_sub('second', arr_planned, arr_changed) / 60.0 AS live
  FROM (SELECT * FROM seen_stop WHERE category = f_category AND number = f_number
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY coalesce(dep_planned, arr_planned), stop_id) = 1)
  WHERE arr_planned IS NOT NULL),
asked AS (
  SELECT query_id, f_category || '_' || f_number AS train_key, station_name, hour(feeder_planned) * 60 + minute(feeder_planned) AS q_tod, as_of, live
  FROM request JOIN feeder USING (query_id) JOIN idx ON idx.train_key = f_category || '_' || f_number AND idx.eva = t_eva),
{LIVED},
sample AS (
  SELECT s.query_id, i, min(value) AS delay FROM shared s JOIN size z USING (query_id), generate_series(0, 79) t(i)
  WHERE effective_n >= 8 AND share >= (i + 0.5) / 80 GROUP BY ALL),
near0 AS (
  SELECT s.*, feeder_planned FROM seen_stop s JOIN feeder USING (query_id)
  WHERE dep_planned IS NOT NULL AND NOT (category = f_category AND number = f_number)
    AND EXISTS (SELECT 1 FROM (SELECT unnest(path) AS x) WHERE contains(lower(x), lower(dest_name)))
    AND (NOT ticket_only OR {_class('category')} <> 'LONG_DISTANCE') AND dep_planned >= feeder_planned - INTERVAL 30 MINUTE),
near AS (SELECT *, category || '_' || number AS c_key, date_sub('second', dep_planned, dep_changed) / 60.0 AS dep_live,
  hour(dep_planned) * 60 + minute(dep_planned) AS dep_at FROM near0),
arrival AS (
  SELECT train_key, station_name, day, tod AS arr_tod, coalesce(arr_delay, dep_delay) AS arr FROM run
  WHERE NOT cancelled AND coalesce(arr_delay, dep_delay) IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY train_key, station_name, day ORDER BY tod DESC, coalesce(arr_delay, dep_delay) DESC) = 1),
newest AS (SELECT train_key, station_name, arg_max(arr_tod, day) AS arr_tod FROM arrival GROUP BY ALL),
jr AS (
  SELECT query_id, stop_id AS cand_id, coalesce(r.dep_delay, r.arr_delay) AS dep, a.arr, {_weight('r.day', 'as_of')} AS w
  FROM near n JOIN idx ti ON ti.train_key = c_key AND ti.eva = t_eva
  JOIN run r ON r.train_key = c_key AND r.station_name = ti.station_name AND {_near('r.tod', 'dep_at')}
  JOIN arrival a ON a.train_key = c_key AND a.station_name = n.dest_name AND a.day = r.day
  WHERE NOT r.cancelled AND coalesce(r.dep_delay, r.arr_delay) IS NOT NULL),
rates AS (
  SELECT query_id, stop_id AS cand_id, avg(CAST(r.cancelled AS INTEGER)) AS cancel_rate
  FROM near n JOIN idx ti ON ti.train_key = c_key AND ti.eva = t_eva
  JOIN run r ON r.train_key = c_key AND r.station_name = ti.station_name AND {_near('r.tod', 'dep_at')} GROUP BY ALL),
cand0 AS (
  SELECT n.query_id, n.stop_id AS cand_id, dep_planned, dep_live, dep_cancelled, feeder_planned, coalesce(cancel_rate, 0) AS cancel_rate,
    CAST(CAST(dep_planned AS DATE) AS TIMESTAMP) + to_minutes(arr_tod) AS same_day, coalesce(total, 0) AS total, coalesce(runs, 0) AS runs
  FROM near n JOIN newest w ON w.train_key = c_key AND w.station_name = n.dest_name
  LEFT JOIN rates r ON r.query_id = n.query_id AND r.cand_id = n.stop_id
  LEFT JOIN (SELECT query_id, cand_id, sum(w) AS total, count(*) AS runs FROM jr GROUP BY ALL) j ON j.query_id = n.query_id AND j.cand_id = n.stop_id),
cand1 AS (
  SELECT *, CASE WHEN same_day < dep_planned THEN same_day + INTERVAL 1 DAY ELSE same_day END AS arr_planned FROM cand0
  WHERE (runs >= 5 OR dep_live IS NOT NULL OR dep_cancelled) AND (dep_cancelled OR dep_live IS NOT NULL OR runs > 0)),
ref AS (SELECT query_id, arg_min(arr_planned, (dep_planned, cand_id)) AS reference_arrival FROM cand1 WHERE NOT dep_cancelled GROUP BY 1),
cand AS (SELECT *, date_sub('second', reference_arrival, arr_planned) / 60.0 AS b FROM cand1 JOIN ref USING (query_id)),
met AS (
  SELECT c.*, i, delay + 5 + date_sub('second', dep_planned, feeder_planned) / 60.0 AS threshold FROM cand c JOIN sample USING (query_id)),
stay AS (
  SELECT m.query_id, m.cand_id, m.i, sum(CASE WHEN dep >= threshold THEN w ELSE 0 END) / sum(w) AS stay
  FROM met m JOIN jr ON jr.query_id = m.query_id AND jr.cand_id = m.cand_id GROUP BY ALL),
chance AS (
  SELECT m.*, CASE WHEN dep_cancelled THEN 0.0 WHEN dep_live IS NOT NULL THEN CASE WHEN dep_live >= threshold THEN 1.0 ELSE 0.0 END
    ELSE (1 - cancel_rate) * stay END AS p FROM met m LEFT JOIN stay s USING (query_id, cand_id, i)),
reach AS (
  SELECT *, coalesce(product(1 - p) OVER (PARTITION BY query_id, i ORDER BY dep_planned, cand_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) / 80.0 AS reach FROM chance),
pnt0 AS (
  SELECT r.query_id, b + arr AS value, reach * (1 - cancel_rate) * w / total AS weight FROM reach r JOIN jr USING (query_id, cand_id)
  WHERE NOT dep_cancelled AND dep_live IS NULL AND dep >= threshold
  UNION ALL
  SELECT r.query_id, b + dep_live + coalesce(arr - dep, 0), reach * coalesce(w / total, 1) FROM reach r LEFT JOIN jr USING (query_id, cand_id)
  WHERE NOT dep_cancelled AND dep_live IS NOT NULL AND p = 1),
pnt AS (SELECT query_id, value, sum(weight) AS weight FROM pnt0 GROUP BY ALL HAVING sum(weight) > 0),
caught AS (
  SELECT query_id, cand_id, any_value(dep_planned) AS dep_planned, any_value(arr_planned) AS arr_planned, bool_and(dep_cancelled) AS dep_cancelled,
    any_value(feeder_planned) AS feeder_planned, any_value(reference_arrival) AS reference_arrival, sum(reach * p) AS board_probability
  FROM reach WHERE query_id IN (SELECT query_id FROM pnt) GROUP BY ALL),
missed AS (SELECT query_id, sum(m) / 80.0 AS miss FROM (SELECT query_id, i, product(1 - p) AS m FROM reach GROUP BY ALL) GROUP BY 1),
result AS (
  SELECT query_id, any_value(reference_arrival) AS reference_arrival,
    coalesce(arg_min(board_probability, (dep_planned, cand_id)) FILTER (WHERE NOT dep_cancelled AND dep_planned >= feeder_planned),
      arg_min(board_probability, (dep_planned, cand_id)) FILTER (WHERE NOT dep_cancelled)) AS catch
  FROM caught GROUP BY 1)"""
_CONN = _REQUEST + ",\n" + _CHAIN
ORACLES["connection_outcome"] = _with(*_CALLS, _CONN) + f"""
SELECT q.query_id, CASE WHEN feeder_planned IS NULL THEN 'FEEDER_NOT_REACHING' WHEN q.query_id NOT IN (SELECT query_id FROM near) THEN 'NO_CANDIDATES'
    WHEN catch IS NULL THEN 'NOT_ENOUGH_HISTORY' ELSE 'OK' END AS status,
  {_ts('feeder_planned')}, {_ts('reference_arrival')}, {_r('catch', 'catch_probability')},
  {_r('CASE WHEN catch IS NOT NULL THEN miss END', 'miss_probability')}
FROM request q LEFT JOIN feeder f USING (query_id) LEFT JOIN result r USING (query_id) LEFT JOIN missed m USING (query_id)"""
ORACLES["catch_and_miss"] = _with(*_CALLS, _CONN) + f"""
SELECT query_id, cand_id, {_ts('dep_planned')}, {_ts('arr_planned')}, {_r('board_probability', 'board_probability')} FROM caught"""
ORACLES["transfer_propagation"] = _with(*_CALLS, _CONN) + f"""
SELECT query_id, {_r('value', 'value')}, {_r('weight', 'weight')} FROM pnt"""

ORACLES["joint_candidate_runs"] = _with(
    *_CALLS,
    f"""spot AS (SELECT c.*, split_part(c.train_key, '_', 2) AS number, day AS as_of, CAST(day AS TIMESTAMP) + to_minutes(tod) AS dep_planned FROM call c, day0),
last_run AS (
  SELECT train_key, day, tod AS arr_tod, coalesce(arr_delay, dep_delay) AS arr FROM run
  WHERE station_name = 'NATION_03' AND NOT cancelled AND coalesce(arr_delay, dep_delay) IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY train_key, day ORDER BY tod DESC, coalesce(arr_delay, dep_delay) DESC) = 1),
newest AS (SELECT train_key, arg_max(arr_tod, day) AS arr_tod FROM last_run GROUP BY 1),
joined AS (
  SELECT a.*, r.cancelled, coalesce(r.dep_delay, r.arr_delay) AS dep, l.arr, {_weight('r.day', 'as_of')} AS w
  FROM spot a JOIN run r ON r.train_key = a.train_key AND r.station_name = a.station_name AND {_near('r.tod', 'a.tod')}
  LEFT JOIN last_run l ON l.train_key = r.train_key AND l.day = r.day),
summed AS (
  SELECT train_key, eva, tod, number, dep_planned, avg(CAST(cancelled AS INTEGER)) AS cancel_rate,
    count(*) FILTER (WHERE NOT cancelled AND dep IS NOT NULL AND arr IS NOT NULL) AS n,
    sum(w) FILTER (WHERE NOT cancelled AND dep IS NOT NULL AND arr IS NOT NULL) AS w,
    sum(w * (arr - dep)) FILTER (WHERE NOT cancelled AND dep IS NOT NULL AND arr IS NOT NULL) AS gain
  FROM joined GROUP BY ALL)""",
) + f"""
SELECT train_key || '|' || eva || '|' || tod AS cand_id,
  {_ts("CASE WHEN CAST(CAST(dep_planned AS DATE) AS TIMESTAMP) + to_minutes(arr_tod) < dep_planned THEN CAST(CAST(dep_planned AS DATE) + 1 AS TIMESTAMP) + to_minutes(arr_tod) ELSE CAST(CAST(dep_planned AS DATE) AS TIMESTAMP) + to_minutes(arr_tod) END", 'arr_planned')},
  {_r('cancel_rate', 'cancel_rate')}, n AS joint_runs, nullif(n, 0) AS n, {_r('w', 'w')}, {_r('gain / w', 'gain')}
FROM summed JOIN newest USING (train_key) WHERE n >= 5 OR number IN ('7', '9')"""

_JOURNEY = f"""jq AS (
  SELECT f.eva || '|' || t.eva || '|' || h AS query_id, f.eva AS from_eva, f.name AS from_name, t.eva AS to_eva, t.name AS to_name,
    CAST(day AS TIMESTAMP) + to_hours(h) AS depart, day AS as_of, h % 2 <> 0 AS ticket_only
  FROM station f, station t, day0, (VALUES (3), (7), (9), (16), (18), (22)) v(h)
  WHERE f.eva BETWEEN '8000' AND '8003' AND t.eva BETWEEN '8000' AND '8003'),
req AS (SELECT query_id AS board_id, from_eva AS eva, depart AS start_ts, depart + INTERVAL 3 HOUR AS end_ts, 3 AS hours FROM jq WHERE from_eva <> to_eva),
{BOARDS},
dep AS (
  SELECT j.*, stop_id, category, number, dep_planned, dep_changed, typical, coalesce(path, []) AS path,
    EXISTS (SELECT 1 FROM (SELECT unnest(path) AS x) WHERE contains(lower(x), lower(to_name)) OR contains(lower(to_name), lower(x))) AS direct
  FROM jq j JOIN board ON board_id = query_id
  WHERE dep_planned IS NOT NULL AND NOT dep_cancelled AND dep_planned >= depart AND (NOT ticket_only OR {_class('category')} <> 'LONG_DISTANCE'))"""
ORACLES["fare_filter_departures"] = _with(*_CALLS, _JOURNEY) + f"""
SELECT query_id, stop_id, {_ts('dep_planned')}, direct, typical FROM dep"""
_DIRECT = f"""newest AS (SELECT train_key, station_name, eva, arg_max(tod, (last_day, -tod)) AS arr_tod FROM call GROUP BY ALL),
ride AS (
  SELECT b.query_id, b.stop_id, b.dep_planned, as_of, n.train_key, n.station_name,
    CASE WHEN CAST(CAST(dep_planned AS DATE) AS TIMESTAMP) + to_minutes(arr_tod) < dep_planned
      THEN CAST(CAST(dep_planned AS DATE) + 1 AS TIMESTAMP) + to_minutes(arr_tod)
      ELSE CAST(CAST(dep_planned AS DATE) AS TIMESTAMP) + to_minutes(arr_tod) END AS reference_arrival,
    date_sub('second', dep_planned, dep_changed) / 60.0 AS live
  FROM dep b JOIN newest n ON b.direct AND n.train_key = category || '_' || number AND n.eva = to_eva),
asked AS (
  SELECT query_id || '|' || stop_id AS query_id, train_key, station_name, hour(reference_arrival) * 60 + minute(reference_arrival) AS q_tod, as_of, live FROM ride),
{LIVED},
direct AS (
  SELECT r.query_id, r.stop_id, CAST(NULL AS VARCHAR) AS transfer_station, r.dep_planned, reference_arrival,
    min(value) FILTER (WHERE share >= 0.5) AS median, min(value) FILTER (WHERE share >= 0.1) AS q10, min(value) FILTER (WHERE share >= 0.9) AS q90,
    CAST(NULL AS DOUBLE) AS catch_probability, CAST(NULL AS DOUBLE) AS miss_probability
  FROM ride r JOIN shared s ON s.query_id = r.query_id || '|' || r.stop_id JOIN size z ON z.query_id = s.query_id
  WHERE effective_n >= 8 GROUP BY r.query_id, r.stop_id, r.dep_planned, reference_arrival)"""
_ITINERARY = f"""query_id, stop_id, transfer_station, {_ts('dep_planned')}, {_ts('reference_arrival')}, {_r('median', 'median', 4)},
  {_r('q10', 'q10', 4)}, {_r('q90', 'q90', 4)}, {_r('catch_probability', 'catch_probability', 4)}, {_r('miss_probability', 'miss_probability', 4)}"""
# The query asks for the first three direct trains.
_FIRST_DIRECT = "first_direct AS (SELECT query_id, stop_id FROM dep WHERE direct QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY dep_planned, stop_id) <= 3)"
ORACLES["direct_itineraries"] = _with(*_CALLS, _JOURNEY, _DIRECT, _FIRST_DIRECT) + f"SELECT {_ITINERARY} FROM direct SEMI JOIN first_direct USING (query_id, stop_id)"

# The connections of the options, with every common table renamed.
_NAMES = re.findall(r"(?:^|[\s,])([a-z_0-9]+) AS \(", _CHAIN) + ["request"]
_OPTION_CHAIN = re.sub(r"\b(" + "|".join(sorted(set(_NAMES), key=len, reverse=True)) + r")\b", r"\1_t", _CHAIN)
_TRANSFERS = f"""option AS (
  SELECT f.*, s.eva AS t_eva, s.name AS t_name
  FROM (SELECT *, unnest(path) AS stop_name, generate_subscripts(path, 1) AS spot FROM dep WHERE NOT direct) f JOIN station s ON lower(s.name) = lower(stop_name)
  WHERE s.eva <> to_eva AND s.weight >= 40
  QUALIFY row_number() OVER (PARTITION BY query_id, stop_id, s.eva ORDER BY spot) = 1),
request_t AS (
  SELECT query_id || '|' || stop_id || '|' || t_eva AS query_id, category AS f_category, number AS f_number, dep_planned AS start_ts,
    t_eva, t_name, as_of, to_name AS dest_name, ticket_only FROM option),
{_OPTION_CHAIN},
shape AS (
  SELECT query_id, min(value) FILTER (WHERE share >= 0.5) AS median, min(value) FILTER (WHERE share >= 0.1) AS q10, min(value) FILTER (WHERE share >= 0.9) AS q90
  FROM (SELECT *, round(sum(weight) OVER (PARTITION BY query_id ORDER BY value) / sum(weight) OVER (PARTITION BY query_id), 9) AS share FROM pnt_t) GROUP BY 1),
changing AS (
  SELECT o.query_id, o.stop_id, o.t_name AS transfer_station, o.dep_planned, r.reference_arrival, median, q10, q90,
    r."catch" AS catch_probability, m.miss AS miss_probability
  FROM option o JOIN result_t r ON r.query_id = o.query_id || '|' || o.stop_id || '|' || t_eva
  JOIN shape h ON h.query_id = r.query_id JOIN missed_t m ON m.query_id = r.query_id),
ranked AS (
  SELECT *, reference_arrival + to_seconds(CAST(round(median * 60) AS BIGINT)) AS median_arrival FROM (SELECT * FROM direct UNION ALL SELECT * FROM changing)),
top AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY median_arrival, dep_planned, stop_id, transfer_station NULLS FIRST) AS INTEGER) AS place FROM ranked
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY median_arrival, dep_planned, stop_id, transfer_station NULLS FIRST) <= 5)"""
_ALL_JOURNEYS = _with(*_CALLS, _JOURNEY, _DIRECT, _TRANSFERS)
ORACLES["itinerary_top5"] = _ALL_JOURNEYS + f"""
SELECT {_ITINERARY}, place, CAST(greatest(0, date_sub('minute', top.dep_planned, median_arrival)) AS INTEGER) AS travel_minutes FROM top"""
ORACLES["journey_outcome"] = _ALL_JOURNEYS + """
SELECT q.query_id, from_name, to_name, coalesce(typical, false) AS typical, coalesce(found, 0) AS found,
  false AS crosses_change,
  CASE WHEN from_eva = to_eva THEN 'SAME_STATION' WHEN n IS NULL THEN 'NO_TIMETABLE' WHEN found IS NULL THEN 'NO_PLANNABLE_TRAIN' ELSE 'OK' END AS status
FROM jq q LEFT JOIN (SELECT query_id, count(*) AS n, bool_or(typical) AS typical FROM dep WHERE from_eva <> to_eva GROUP BY 1) d USING (query_id)
LEFT JOIN (SELECT query_id, count(*) AS found FROM top GROUP BY 1) t USING (query_id)"""
ORACLES["not_found_outcomes"] = _with(*_CALLS, _JOURNEY, _REQUEST) + """
SELECT 'journey' AS kind, query_id, CASE split_part(query_id, '|', 3) WHEN '3' THEN 'ORIGIN_NOT_FOUND' WHEN '7' THEN 'DESTINATION_NOT_FOUND'
  WHEN '9' THEN 'DESTINATION_NOT_FOUND' ELSE 'FOUND' END AS status FROM jq WHERE from_eva <> to_eva
UNION ALL SELECT 'connection', query_id, CASE WHEN f_number IN ('1', '4') THEN 'TRANSFER_NOT_FOUND' ELSE 'FOUND' END FROM request"""
_LOOSE = "names AS (SELECT unnest(['nation_0', 'NATION_03', 'Nation_03 (tief)', 'ation_02', 'NATION_1', 'Quay']) AS destination)"


def _meant(both_ways: bool) -> str:
    hit = "contains(lower(station_name), lower(destination))" + (" OR contains(lower(destination), lower(station_name))" if both_ways else "")
    return f"arg_min(station_name, (CASE WHEN lower(station_name) = lower(destination) THEN 1 ELSE 2 END, station_name)) FILTER (WHERE {hit})"


ORACLES["loose_destinations"] = _with(*_CALLS, _LOOSE) + f"""
SELECT train_key, destination, {_meant(False)} AS contained, {_meant(True)} AS either FROM idx, names GROUP BY train_key, destination"""
ORACLES["loose_routes"] = _with(
    *_CALLS, _LOOSE, "origin AS (SELECT DISTINCT train_key, eva AS origin_eva, tod AS origin_tod FROM call)", ROUTE
) + """
SELECT train_key, origin_eva, origin_tod, destination, bool_or(contains(lower(stop), lower(destination))) AS contained,
  bool_or(contains(lower(stop), lower(destination)) OR contains(lower(destination), lower(stop))) AS either
FROM (SELECT *, unnest(path) AS stop FROM route), names GROUP BY ALL"""
ORACLES["trains_by_line"] = _with(*RUNS) + f"""
SELECT DISTINCT train_type || '|' || line_number || '|' || upper(station_name) AS query_id, {_key('line_number')} AS train_key, station_name
FROM run WHERE line_number IS NOT NULL"""
