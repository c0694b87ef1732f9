"""Explicit schemas; nothing is inferred on read."""

STOP_EVENT = """
    station_name string, eva string, train_type string, train_number string, line_number string,
    train_line_ride_id string, train_line_station_num bigint,
    arrival_planned_time timestamp_ntz, arrival_change_time timestamp_ntz,
    departure_planned_time timestamp_ntz, departure_change_time timestamp_ntz,
    is_canceled boolean
"""

RAW_LOG = "timestamp timestamp_ntz, api_name string, url string, response_data string"

_PLAN_EVENT = "struct<_pt:string,_pp:string,_l:string,_ppth:string>"
PLAN_DOCUMENT = (
    "_station string, s array<struct<_id:string, tl:struct<_c:string,_n:string>, "
    f"ar:{_PLAN_EVENT}, dp:{_PLAN_EVENT}>>"
)
_CHANGE_EVENT = "struct<_ct:string,_cp:string,_cs:string>"
CHANGE_DOCUMENT = f"_station string, s array<struct<_id:string, ar:{_CHANGE_EVENT}, dp:{_CHANGE_EVENT}>>"

RUN = """
    train_key string, train string, train_type string, line_number string,
    station_name string, eva string, day date, tod int,
    arr_delay int, dep_delay int, prev_delay int, cancelled boolean
"""

HISTORY_DOCUMENT = """
    v int, train string, type string, line string,
    stations map<string, struct<
        eva:string, tod:array<int>, days:array<int>, t:array<int>,
        a:array<int>, d:array<int>, p:array<int>, c:array<int>,
        runs:array<array<string>>>>
"""

BOARD_DOCUMENT = "name string, trains array<array<string>>"

BUILD_META = "generated string, recent_from string, recent_through string, trains string"

BOARD_ENTRY = """
    eva string, station_name string, category string, number string, line string,
    arr_tod int, dep_tod int, weekday_mask int, last_seen date
"""

STATION = "eva string, name string, weight int"
