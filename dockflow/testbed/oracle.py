"""The registered queries as DuckDB SQL over the same tables.

Each common table expression is stated once; ``sql`` puts together those a query needs, in dependency order.
"""

from __future__ import annotations

import re

# Named subqueries. A name used inside another one's text is a dependency.
CTE: dict[str, str] = {}
# The final SELECT of every key.
FINAL: dict[str, str] = {}

CTE["c_rides"] = """
SELECT event_id, user_id, ts, event_type,
       CAST(json_extract_string(props, '$.k') AS INT) AS k,
       date_trunc('second', ts) AS start_time,
       CAST(floor(value * 60) AS INT) AS duration_s,
       (SELECT count(*) FROM supplier) - CASE WHEN ts < TIMESTAMP '2024-01-20 00:00:00' THEN 2 ELSE 5 END AS m
FROM events"""

CTE["c_ends"] = """
SELECT *, CAST(3000 + (event_id * 31 + k) % m AS INT) AS end_station_id FROM c_rides"""

CTE["c_starts"] = """
SELECT *, CAST(CASE WHEN event_id % 4 = 0 THEN 3000 + (event_id * 7 + k) % m
                    ELSE coalesce(lag(end_station_id) OVER (PARTITION BY user_id ORDER BY start_time, event_id),
                                  3000 + (event_id + k) % m) END AS INT) AS start_station_id
FROM c_ends"""

CTE["c_trips"] = """
SELECT event_id AS trip_id, concat('B', CAST(user_id AS VARCHAR)) AS bike_id, start_time,
       start_time + to_seconds(duration_s) AS end_time, duration_s, start_station_id, end_station_id,
       CASE WHEN event_id % 2 = 0 THEN 'electric' ELSE 'classic' END AS bike_type, event_type AS passholder_type
FROM c_starts"""

CTE["c_raw_once"] = """
SELECT CAST(trip_id AS VARCHAR) AS trip_id, trip_id AS n, trip_id % 3 AS archive,
       CASE WHEN trip_id % 500 = 7 THEN 'n/a'
            WHEN trip_id % 3 = 0 THEN strftime(start_time, '%-m/%-d/%Y %-H:%M')
            WHEN trip_id % 3 = 1 THEN strftime(start_time, '%Y-%m-%d %H:%M:%S')
            ELSE strftime(start_time, '%Y-%m-%dT%H:%M:%S') END AS start_time,
       CASE WHEN trip_id % 500 = 7 THEN 'n/a'
            WHEN trip_id % 3 = 0 THEN strftime(end_time, '%-m/%-d/%Y %-H:%M')
            WHEN trip_id % 3 = 1 THEN strftime(end_time, '%Y-%m-%d %H:%M:%S')
            ELSE strftime(end_time, '%Y-%m-%dT%H:%M:%S') END AS end_time,
       CASE WHEN trip_id % 3 = 1 THEN '' ELSE CAST(CAST(floor(duration_s / 60) AS INT) AS VARCHAR) END AS duration,
       CASE WHEN trip_id % 400 = 9 THEN NULL ELSE CAST(start_station_id AS VARCHAR) END AS start_station,
       CAST(end_station_id AS VARCHAR) AS end_station, bike_id,
       CASE WHEN trip_id % 3 = 2 THEN NULL ELSE bike_type END AS bike_type, passholder_type
FROM c_trips"""

CTE["c_raw"] = """
SELECT trip_id, archive, start_time, end_time, duration, start_station, end_station, bike_id, bike_type,
       passholder_type FROM c_raw_once
UNION ALL
SELECT trip_id, archive, start_time, end_time, duration, start_station, end_station, bike_id, bike_type,
       passholder_type FROM c_raw_once WHERE n % 50 = 0"""

CTE["c_stations_raw"] = """
SELECT CAST(3000 + s_suppkey AS INT) AS station_id,
       CASE WHEN s_suppkey = 0 THEN 'Virtual Station' ELSE s_name END AS station_name,
       CASE WHEN s_suppkey % 11 = 5 THEN NULL
            WHEN s_suppkey % 2 = 0
              THEN strftime(DATE '2023-12-20' + CAST(s_suppkey * 13 % 25 AS INT), '%-m/%-d/%Y')
            ELSE strftime(DATE '2023-12-20' + CAST(s_suppkey * 13 % 25 AS INT), '%Y-%m-%d') END AS go_live_raw
FROM supplier"""

CTE["c_stations_parsed"] = """
SELECT station_id, station_name,
       coalesce(try_strptime(go_live_raw, '%m/%d/%Y'), try_strptime(go_live_raw, '%Y-%m-%d')) AS go_live_date
FROM c_stations_raw"""

CTE["c_stations"] = """
SELECT * FROM c_stations_parsed WHERE lower(coalesce(station_name, '')) <> 'virtual station'"""

CTE["c_pseudo"] = """
SELECT DISTINCT station_id FROM c_stations_parsed WHERE lower(coalesce(station_name, '')) = 'virtual station'"""

CTE["c_parsed_times"] = """
SELECT CAST(trip_id AS BIGINT) AS trip_id, duration, start_station, end_station, bike_id, bike_type, passholder_type,
       coalesce(try_strptime(start_time, '%m/%d/%Y %H:%M'), try_strptime(start_time, '%Y-%m-%d %H:%M:%S'),
                try_strptime(start_time, '%Y-%m-%dT%H:%M:%S')) AS start_time,
       coalesce(try_strptime(end_time, '%m/%d/%Y %H:%M'), try_strptime(end_time, '%Y-%m-%d %H:%M:%S'),
                try_strptime(end_time, '%Y-%m-%dT%H:%M:%S')) AS end_time
FROM c_raw"""

CTE["c_parsed"] = """
SELECT trip_id,
       CASE WHEN regexp_full_match(duration, '[0-9]+') THEN CAST(duration AS BIGINT) * 60
            ELSE date_diff('second', start_time, end_time) END AS duration_s,
       start_time, end_time, TRY_CAST(start_station AS INT) AS start_station_id,
       TRY_CAST(end_station AS INT) AS end_station_id, bike_id, bike_type, passholder_type
FROM c_parsed_times"""

CTE["c_flagged"] = """
SELECT *, start_station_id IN (SELECT station_id FROM c_pseudo)
          OR end_station_id IN (SELECT station_id FROM c_pseudo) AS is_pseudo,
       start_station_id IS NOT NULL AND end_station_id IS NOT NULL AS has_stations,
       duration_s > 60 AS long_enough, duration_s <= 14400 AS short_enough,
       start_time >= TIMESTAMP '2024-01-02 00:00:00' AS in_window
FROM c_parsed"""

CTE["c_clean"] = """
SELECT DISTINCT trip_id, CAST(duration_s AS INT) AS duration_s, start_time, end_time, start_station_id,
       end_station_id, bike_id, bike_type, passholder_type
FROM c_flagged
WHERE has_stations AND long_enough AND short_enough AND in_window AND NOT coalesce(is_pseudo, false)"""

# The typed rides under the same rules, as input of everything after the conform phase.
CTE["c_rides_kept"] = """
SELECT * FROM c_trips
WHERE duration_s > 60 AND duration_s <= 14400 AND start_time >= TIMESTAMP '2024-01-02 00:00:00'
  AND start_station_id NOT IN (SELECT station_id FROM c_pseudo)
  AND end_station_id NOT IN (SELECT station_id FROM c_pseudo)"""

CTE["c_traj"] = """
SELECT *, lead(start_time) OVER w AS next_start_time, lead(start_station_id) OVER w AS next_start_station,
       CAST(row_number() OVER w AS INT) AS trip_seq, row_number() OVER w = 1 AS is_first_trip,
       lead(start_time) OVER w IS NULL AS is_last_trip
FROM c_rides_kept WINDOW w AS (PARTITION BY bike_id ORDER BY start_time, trip_id)"""

CTE["c_moved"] = """
SELECT *, date_diff('second', end_time, next_start_time) AS gap_s,
       make_timestamp(1000000 * ((CAST(epoch(end_time) AS BIGINT) + CAST(epoch(next_start_time) AS BIGINT)) >> 1))
         AS middle
FROM c_traj WHERE next_start_station IS NOT NULL AND end_station_id <> next_start_station"""

CTE["c_rebalancing"] = """
SELECT end_station_id AS station_id,
       CASE WHEN gap_s < 21600 THEN middle ELSE end_time + INTERVAL 1 HOUR END AS event_time, 'reb_out' AS event_type,
       CASE WHEN gap_s >= 129600 THEN 'maintenance_removal' ELSE 'rebalance' END AS event_kind FROM c_moved
UNION ALL
SELECT next_start_station, CASE WHEN gap_s < 21600 THEN middle ELSE next_start_time - INTERVAL 1 HOUR END, 'reb_in',
       CASE WHEN gap_s >= 129600 THEN 'maintenance_removal' ELSE 'rebalance' END FROM c_moved"""

CTE["c_fleet"] = """
SELECT start_station_id AS station_id, start_time - INTERVAL 1 HOUR AS event_time, 'reb_in' AS event_type,
       'fleet_entry' AS event_kind FROM c_traj WHERE is_first_trip
UNION ALL
SELECT end_station_id, end_time + INTERVAL 1 HOUR, 'reb_out', 'fleet_exit' FROM c_traj
WHERE is_last_trip AND end_time < (SELECT max(end_time) FROM c_rides_kept) - INTERVAL 1 DAY"""

CTE["c_events"] = """
SELECT * FROM c_rebalancing UNION ALL SELECT * FROM c_fleet"""

CTE["c_bounds"] = """
SELECT date_trunc('hour', min(start_time)) AS t0, date_trunc('hour', max(end_time)) AS t1 FROM c_rides_kept"""

CTE["c_spine"] = """
SELECT unnest(generate_series(t0, t1, INTERVAL 1 HOUR)) AS hour_ts FROM c_bounds"""

CTE["c_activity"] = """
SELECT station_id, min(seen_at) AS first_seen, max(seen_at) AS last_seen
FROM (SELECT start_station_id AS station_id, start_time AS seen_at FROM c_rides_kept
      UNION ALL SELECT end_station_id, end_time FROM c_rides_kept) GROUP BY station_id"""

CTE["c_grid"] = """
SELECT s.station_id, h.hour_ts
FROM c_stations s JOIN c_activity a USING (station_id) CROSS JOIN c_bounds b JOIN c_spine h
  ON h.hour_ts >= greatest(date_trunc('hour', s.go_live_date), date_trunc('hour', a.first_seen))
 AND h.hour_ts <= CASE WHEN a.last_seen >= b.t1 - INTERVAL 1 DAY THEN b.t1 ELSE date_trunc('hour', a.last_seen) END"""

CTE["c_arr"] = """
SELECT end_station_id AS station_id, date_trunc('hour', end_time) AS hour_ts, count(*) AS arr
FROM c_rides_kept GROUP BY 1, 2"""

CTE["c_dep"] = """
SELECT start_station_id AS station_id, date_trunc('hour', start_time) AS hour_ts, count(*) AS dep
FROM c_rides_kept GROUP BY 1, 2"""

CTE["c_reb"] = """
SELECT station_id, date_trunc('hour', event_time) AS hour_ts,
       CAST(sum(CASE WHEN event_type = 'reb_in' THEN 1 ELSE 0 END) AS BIGINT) AS reb_in,
       CAST(sum(CASE WHEN event_type = 'reb_out' THEN 1 ELSE 0 END) AS BIGINT) AS reb_out
FROM c_events GROUP BY 1, 2"""

CTE["c_flows"] = """
SELECT g.station_id, g.hour_ts, coalesce(arr, 0) AS arr, coalesce(dep, 0) AS dep, coalesce(reb_in, 0) AS reb_in,
       coalesce(reb_out, 0) AS reb_out, coalesce(arr, 0) - coalesce(dep, 0) AS net_flow
FROM c_grid g LEFT JOIN c_arr USING (station_id, hour_ts) LEFT JOIN c_dep USING (station_id, hour_ts)
LEFT JOIN c_reb USING (station_id, hour_ts)"""

CTE["c_ledger"] = """
SELECT *, arr + reb_in - dep - reb_out AS delta,
       CAST(sum(arr + reb_in - dep - reb_out) OVER (PARTITION BY station_id ORDER BY hour_ts
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum_delta
FROM c_flows"""

CTE["c_occupied"] = """
SELECT *, -min(cum_delta) OVER (PARTITION BY station_id) AS o_initial,
       cum_delta - min(cum_delta) OVER (PARTITION BY station_id) AS occupancy
FROM c_ledger"""

CTE["c_capacity"] = """
SELECT *, greatest(max(occupancy) OVER (PARTITION BY station_id ORDER BY hour_ts
             RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW), 1) AS capacity
FROM c_occupied"""

CTE["c_labels"] = """
SELECT station_id, hour_ts, CAST(arr AS INT) AS arr, CAST(dep AS INT) AS dep, CAST(reb_in AS INT) AS reb_in,
       CAST(reb_out AS INT) AS reb_out, CAST(net_flow AS INT) AS net_flow, CAST(occupancy AS DOUBLE) AS occupancy,
       CAST(capacity AS INT) AS capacity, CAST(occupancy AS DOUBLE) / capacity AS pct_full, occupancy < 1 AS is_empty,
       occupancy >= capacity AS is_full, CAST(year(hour_ts) AS INT) AS part_year,
       CAST(month(hour_ts) AS INT) AS part_month
FROM c_capacity"""


def _needs(text: str, found: list[str]) -> None:
    for name in re.findall(r"\bc_[a-z0-9_]+\b", text):
        if name in CTE and name not in found:
            _needs(CTE[name], found)
            found.append(name)


def sql(key: str) -> str:
    final = FINAL[key]
    names: list[str] = []
    _needs(final, names)
    if not names:
        return final.strip()
    return "WITH " + ",\n".join(f"{n} AS ({CTE[n].strip()})" for n in names) + "\n" + final.strip()


def oracle_sql() -> dict[str, str]:
    return {key: sql(key) for key in FINAL}


FINAL["stations_parsed"] = "SELECT station_id, station_name, go_live_date FROM c_stations_parsed"
FINAL["stations_clean"] = "SELECT station_id, station_name, go_live_date FROM c_stations"
FINAL["stations_undated"] = """
SELECT count(*) AS n_stations, CAST(count(*) FILTER (WHERE go_live_date IS NULL) AS BIGINT) AS n_undated
FROM c_stations_parsed"""
FINAL["trips_resolved"] = """
SELECT CAST(archive AS VARCHAR) AS archive, trip_id, duration, start_time, end_time, start_station, end_station,
       bike_id, bike_type, passholder_type FROM c_raw"""
FINAL["missing_columns"] = """
SELECT CAST(archive AS VARCHAR) AS archive, 'bike_type' AS column_name, count(*) AS n_rows
FROM c_raw WHERE archive = 2 GROUP BY 1"""
CTE["c_parsed_filled"] = """
SELECT * REPLACE (coalesce(duration_s, -1) AS duration_s, coalesce(start_station_id, -1) AS start_station_id)
FROM c_parsed"""
FINAL["trips_parsed"] = "SELECT * FROM c_parsed_filled"
FINAL["parse_rate"] = """
SELECT n_rows, n_unparsed, 100.0::DOUBLE * n_unparsed / n_rows AS pct_unparsed,
       CASE WHEN 100.0::DOUBLE * n_unparsed / n_rows > 1.0 THEN 'FAIL' ELSE 'OK' END AS status
FROM (SELECT count(*) AS n_rows, count(*) FILTER (WHERE start_time IS NULL OR end_time IS NULL) AS n_unparsed
      FROM c_parsed)"""
FINAL["trip_duration"] = """
SELECT CASE WHEN regexp_full_match(duration, '[0-9]+') THEN 'minutes' ELSE 'difference' END AS source,
       CASE WHEN regexp_full_match(duration, '[0-9]+') THEN CAST(duration AS BIGINT) * 60
            ELSE coalesce(date_diff('second', start_time, end_time), -1) END AS duration_s, count(*) AS n_trips
FROM c_parsed_times GROUP BY ALL"""
FINAL["trips_no_pseudo"] = """
SELECT trip_id, coalesce(duration_s, -1) AS duration_s, start_time, end_time,
       coalesce(start_station_id, -1) AS start_station_id, end_station_id, bike_id, bike_type,
       passholder_type FROM c_flagged WHERE NOT coalesce(is_pseudo, false)"""
FINAL["trips_filtered"] = """
SELECT trip_id, duration_s, start_time, end_time, start_station_id, end_station_id, bike_id, bike_type,
       passholder_type FROM c_flagged WHERE has_stations AND long_enough AND short_enough AND in_window"""
FINAL["drop_report"] = """
SELECT rule, n_before, n_before - n_dropped AS n_after, n_dropped,
       100.0::DOUBLE * n_dropped / n_before AS pct_dropped
FROM (
  SELECT unnest(['not_pseudo', 'has_stations', 'long_enough', 'short_enough', 'in_window', 'all']) AS rule,
         n_before,
         unnest([p, n_before - h, n_before - l, n_before - s, n_before - i, n_before - a]) AS n_dropped
  FROM (SELECT count(*) AS n_before, count(*) FILTER (WHERE is_pseudo) AS p, count(*) FILTER (WHERE has_stations) AS h,
               count(*) FILTER (WHERE long_enough) AS l, count(*) FILTER (WHERE short_enough) AS s,
               count(*) FILTER (WHERE in_window) AS i,
               count(*) FILTER (WHERE NOT coalesce(is_pseudo, false) AND has_stations AND long_enough
                                  AND short_enough AND in_window) AS a
        FROM c_flagged))"""
FINAL["merge_report"] = """
SELECT count(*) AS n_before, count(DISTINCT trip_id) AS n_after, count(*) - count(DISTINCT trip_id) AS n_merged,
       count(*) FILTER (WHERE trip_id IS NULL) AS n_without_key FROM c_parsed"""
FINAL["station_report"] = """
SELECT (SELECT count(*) FROM c_stations_raw) AS n_published, (SELECT count(*) FROM c_stations_parsed) AS n_usable,
       (SELECT count(*) FROM c_stations) AS n_stations"""
FINAL["trips_dedup"] = "SELECT DISTINCT * FROM c_parsed_filled"
FINAL["trips_clean"] = """
SELECT *, CAST(year(start_time) AS INT) AS year, CAST(month(start_time) AS INT) AS month FROM c_clean"""
FINAL["local_hour"] = """
SELECT timezone('UTC', timezone('America/New_York', date_trunc('hour', start_time))) AS hour_utc, count(*) AS n_trips
FROM c_parsed WHERE start_time IS NOT NULL GROUP BY 1"""
FINAL["bike_trajectories"] = """
SELECT trip_id, bike_id, start_time, end_time, start_station_id, end_station_id, next_start_time,
       coalesce(next_start_station, -1) AS next_start_station, trip_seq, is_first_trip, is_last_trip FROM c_traj"""
FINAL["bike_trajectories_sliced"] = FINAL["bike_trajectories"]
CTE["c_same_second"] = """
SELECT * REPLACE (CASE WHEN CAST(substr(bike_id, 2) AS INT) % 2 = 0 THEN date_trunc('month', start_time)
                       ELSE start_time END AS start_time) FROM c_rides_kept"""
FINAL["bike_trajectories_same_second"] = """
SELECT trip_id, bike_id, start_time, end_time, start_station_id, end_station_id,
       lead(start_time) OVER w AS next_start_time, coalesce(lead(start_station_id) OVER w, -1) AS next_start_station,
       CAST(row_number() OVER w AS INT) AS trip_seq, row_number() OVER w = 1 AS is_first_trip,
       lead(start_time) OVER w IS NULL AS is_last_trip
FROM c_same_second WINDOW w AS (PARTITION BY bike_id ORDER BY start_time, trip_id)"""
FINAL["relocations"] = """
SELECT trip_id, bike_id, end_station_id, next_start_station, gap_s / 3600.0::DOUBLE AS gap_h FROM c_moved"""
FINAL["rebalancing_events"] = "SELECT * FROM c_rebalancing"
FINAL["fleet_events"] = "SELECT * FROM c_fleet"
FINAL["movement_events"] = "SELECT * FROM c_events"
FINAL["window_bounds"] = "SELECT t0, t1 FROM c_bounds"
FINAL["hour_spine"] = "SELECT hour_ts FROM c_spine"
FINAL["station_activity"] = "SELECT station_id, first_seen, last_seen FROM c_activity"
FINAL["stations_unseen"] = """
SELECT station_id, station_name, go_live_date FROM c_stations
WHERE station_id NOT IN (SELECT station_id FROM c_activity)"""
FINAL["station_hour_grid"] = "SELECT station_id, hour_ts FROM c_grid"
CTE["c_station_bounds"] = """
SELECT s.station_id, greatest(date_trunc('hour', s.go_live_date), date_trunc('hour', a.first_seen)) AS lo,
       CASE WHEN a.last_seen >= b.t1 - INTERVAL 1 DAY THEN b.t1 ELSE date_trunc('hour', a.last_seen) END AS hi
FROM c_stations s JOIN c_activity a USING (station_id) CROSS JOIN c_bounds b"""
CTE["c_placed_events"] = """
SELECT e.*, CASE WHEN b.lo IS NULL OR b.lo > b.hi THEN 'unknown_station'
                 WHEN date_trunc('hour', event_time) < lo THEN 'before_grid'
                 WHEN date_trunc('hour', event_time) > hi THEN 'after_grid' ELSE 'on_grid' END AS place
FROM c_events e LEFT JOIN c_station_bounds b USING (station_id)"""
FINAL["off_grid_events"] = """
SELECT event_type, event_kind, count(*) AS n_events, count(*) FILTER (WHERE place = 'on_grid') AS n_on_grid,
       count(*) FILTER (WHERE place = 'unknown_station') AS n_unknown_station,
       count(*) FILTER (WHERE place = 'before_grid') AS n_before_grid,
       count(*) FILTER (WHERE place = 'after_grid') AS n_after_grid
FROM c_placed_events GROUP BY 1, 2"""
FINAL["off_grid_share"] = """
SELECT 'off_grid_' || event_type AS check,
       CASE WHEN count(*) FILTER (WHERE place <> 'on_grid') = 0 THEN 'OK' ELSE 'REVIEW' END AS status,
       CAST(count(*) FILTER (WHERE place <> 'on_grid') AS DOUBLE) AS observed, 0.0::DOUBLE AS expected,
       'warn' AS severity
FROM c_placed_events GROUP BY event_type"""
FINAL["arrivals"] = "SELECT * FROM c_arr"
FINAL["departures"] = "SELECT * FROM c_dep"
FINAL["rebalance_counts"] = "SELECT * FROM c_reb"
FINAL["station_hour_flows"] = "SELECT * FROM c_flows"
FINAL["running_ledger"] = "SELECT station_id, hour_ts, delta, cum_delta FROM c_ledger"
FINAL["occupancy"] = "SELECT station_id, hour_ts, o_initial, occupancy FROM c_occupied"
FINAL["ledger_solve_stats"] = """
SELECT count(*) AS n_stations, round(avg(-low), 6) AS mean_initial, max(high - low) AS max_swing
FROM (SELECT min(cum_delta) AS low, max(cum_delta) AS high FROM c_ledger GROUP BY station_id)"""
CTE["c_occupied_fixed"] = """
SELECT *, -low AS o_initial, cum_delta - low AS occupancy FROM (
  SELECT *, coalesce(min(cum_delta) FILTER (WHERE hour_ts <= TIMESTAMP '2024-01-18 00:00:00')
                     OVER (PARTITION BY station_id), 0) AS low FROM c_ledger)"""
FINAL["occupancy_fixed_level"] = "SELECT station_id, hour_ts, o_initial, occupancy FROM c_occupied_fixed"
FINAL["rolling_capacity"] = "SELECT station_id, hour_ts, capacity FROM c_capacity"
FINAL["station_hour_labels"] = FINAL["labels_in_runs"] = "SELECT * FROM c_labels"

# ---- weather and features ------------------------------------------------------------------------------------------

CTE["c_weather"] = """
SELECT event_type AS point_name, date_trunc('hour', ts) AS hour_ts, max(value) AS temperature_2m,
       min(value) AS wind_gusts_10m,
       CASE WHEN count(*) % 3 = 0 THEN NULL ELSE CAST(count(*) AS DOUBLE) / 4 END AS precipitation
FROM events GROUP BY 1, 2"""

CTE["c_daylight"] = """
SELECT *, CASE WHEN day(hour_ts) % 9 = 0 THEN NULL
               WHEN strftime(hour_ts, '%Y-%m-%dT%H:%M') BETWEEN strftime(hour_ts, '%Y-%m-%dT07:%d')
                                                            AND strftime(hour_ts, '%Y-%m-%dT17:%d')
               THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_daylight
FROM c_weather"""

CTE["c_lags"] = """
SELECT *, lag(occupancy, 1) OVER w AS occupancy_lag_1h, lag(net_flow, 1) OVER w AS net_flow_lag_1h,
       lag(net_flow, 168) OVER w AS net_flow_same_hour_last_week,
       avg(net_flow) OVER (PARTITION BY station_id ORDER BY hour_ts
           RANGE BETWEEN INTERVAL 168 HOUR PRECEDING AND INTERVAL 1 HOUR PRECEDING) AS net_flow_rolling_7d_mean
FROM c_labels WINDOW w AS (PARTITION BY station_id ORDER BY hour_ts)"""

# The chain from flows to lags once more, for flows that are disturbed after the train period and for a fixed level.
CHAIN = ("c_ledger", "c_occupied", "c_capacity", "c_labels", "c_lags")
for _count in ("arr", "dep"):
    CTE[f"c_flows_{_count}"] = f"""
SELECT * REPLACE ({_count} + more AS {_count}, net_flow + {"more" if _count == "arr" else "-more"} AS net_flow) FROM (
  SELECT *, CASE WHEN hour_ts > TIMESTAMP '2024-01-18 00:00:00' THEN hour(hour_ts) + 1 ELSE 0 END AS more FROM c_flows)"""


def _chain(count: str, fixed: str) -> str:
    """The lags table of disturbed flows (`arr`, `dep`) or of the plain ones (``), with a free or a `fixed` level."""
    tail = "_".join(t for t in ("", count, fixed) if t) if count or fixed else ""
    for name in CHAIN:
        text = CTE["c_occupied_fixed" if fixed and name == "c_occupied" else name]
        for used in ("c_flows", *CHAIN):
            suffix = f"_{count}" if used == "c_flows" and count else "" if used == "c_flows" else f"_of{tail}"
            text = re.sub(rf"\b{used}\b", f"{used}{suffix}", text)
        CTE[f"{name}_of{tail}"] = text
    return f"c_lags_of{tail}"


def _looks_ahead(fixed: str) -> str:
    plain, more, less = (_chain(count, fixed) for count in ("", "arr", "dep"))
    names = (
        "arr dep reb_in reb_out net_flow occupancy capacity pct_full is_empty is_full part_year part_month "
        "occupancy_lag_1h net_flow_lag_1h net_flow_same_hour_last_week net_flow_rolling_7d_mean"
    ).split()
    each = "\nUNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS n_rows, CAST(count(*) FILTER (WHERE p.{c} IS DISTINCT FROM m.{c} OR "
        f"p.{c} IS DISTINCT FROM l.{c}) AS BIGINT) AS n_moved FROM {plain} p JOIN {more} m USING (station_id, hour_ts) "
        f"JOIN {less} l USING (station_id, hour_ts) WHERE hour_ts <= TIMESTAMP '2024-01-18 00:00:00'"
        for c in names
    )
    return f"SELECT *, CASE WHEN n_moved > 0 THEN 'LOOKS AHEAD' ELSE 'OK' END AS status FROM ({each})"


FINAL["value_leakage"] = _looks_ahead("")
FINAL["value_leakage_fixed_level"] = _looks_ahead("fixed")

# Holidays from the weekday rules, by year.
CTE["c_years"] = """
SELECT CAST(unnest(generate_series(1990, 2040)) AS INT) AS y"""
CTE["c_fixed"] = """
SELECT make_date(y, m, d) AS h FROM c_years,
  (VALUES (1, 1), (6, 19), (7, 4), (11, 11), (12, 25)) AS f(m, d)"""
CTE["c_floating"] = """
SELECT max(h) AS h FROM (
  SELECT y, m, n, h, row_number() OVER (PARTITION BY y, m, n ORDER BY h) AS k, count(*) OVER (PARTITION BY y, m, n) AS c
  FROM (SELECT y, m, n, wd, CAST(unnest(generate_series(make_date(y, m, 1), last_day(make_date(y, m, 1)),
               INTERVAL 1 DAY)) AS DATE) AS h
        FROM c_years, (VALUES (1, 1, 3), (2, 1, 3), (5, 1, -1), (9, 1, 1), (10, 1, 2), (11, 4, 4)) AS r(m, wd, n))
  WHERE isodow(h) = wd) WHERE k = CASE WHEN n < 0 THEN c ELSE n END GROUP BY y, m, n"""
CTE["c_holidays"] = """
SELECT DISTINCT h FROM (
  SELECT h FROM c_fixed UNION ALL SELECT h - 1 FROM c_fixed WHERE isodow(h) = 6
  UNION ALL SELECT h + 1 FROM c_fixed WHERE isodow(h) = 7 UNION ALL SELECT h FROM c_floating)"""

CTE["c_features"] = """
SELECT l.* EXCLUDE (capacity, occupancy_lag_1h, net_flow_lag_1h, net_flow_same_hour_last_week,
                    net_flow_rolling_7d_mean),
       w.temperature_2m, w.wind_gusts_10m, w.precipitation,
       sin(2 * pi() * hour(hour_ts) / 24.0) AS hour_sin, cos(2 * pi() * hour(hour_ts) / 24.0) AS hour_cos,
       sin(2 * pi() * (isodow(hour_ts) - 1) / 7.0) AS dow_sin, cos(2 * pi() * (isodow(hour_ts) - 1) / 7.0) AS dow_cos,
       CASE WHEN isodow(hour_ts) >= 6 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_weekend,
       CASE WHEN CAST(hour_ts AS DATE) IN (SELECT h FROM c_holidays) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
         AS is_holiday,
       w.is_daylight, CAST(month(hour_ts) AS DOUBLE) AS month, CAST(l.capacity AS DOUBLE) AS capacity,
       l.occupancy_lag_1h, CAST(l.net_flow_lag_1h AS DOUBLE) AS net_flow_lag_1h,
       CAST(l.net_flow_same_hour_last_week AS DOUBLE) AS net_flow_same_hour_last_week, l.net_flow_rolling_7d_mean
FROM c_lags l LEFT JOIN (SELECT * FROM c_daylight WHERE point_name = 'click') w USING (hour_ts)"""

FEATURES = (
    "temperature_2m wind_gusts_10m precipitation hour_sin hour_cos dow_sin dow_cos is_weekend is_holiday is_daylight "
    "month capacity occupancy_lag_1h net_flow_lag_1h net_flow_same_hour_last_week net_flow_rolling_7d_mean"
).split()
GROUP_OF = {
    **dict.fromkeys(FEATURES[:3], "weather"),
    **dict.fromkeys(FEATURES[3:11], "temporal"),
    "capacity": "station_static",
    **dict.fromkeys(FEATURES[12:], "lag"),
}

FINAL["weather_hours"] = "SELECT * FROM c_weather"
FINAL["daylight"] = "SELECT point_name, hour_ts, is_daylight FROM c_daylight"
FINAL["cyclic_time"] = """
SELECT event_id AS trip_id, round(sin(2 * pi() * hour(ts) / 24.0), 6) AS hour_sin,
       round(cos(2 * pi() * hour(ts) / 24.0), 6) AS hour_cos,
       round(sin(2 * pi() * (isodow(ts) - 1) / 7.0), 6) AS dow_sin,
       round(cos(2 * pi() * (isodow(ts) - 1) / 7.0), 6) AS dow_cos FROM events"""
FINAL["calendar_features"] = """
SELECT o_orderkey, o_orderdate AS hour_ts,
       CASE WHEN isodow(o_orderdate) >= 6 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_weekend,
       CASE WHEN CAST(o_orderdate AS DATE) IN (SELECT h FROM c_holidays) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
         AS is_holiday, CAST(month(o_orderdate) AS DOUBLE) AS month FROM orders"""
CTE["c_order_years"] = """
SELECT year(min(o_orderdate)) AS lo, year(max(o_orderdate)) + 1 AS hi FROM orders"""
FINAL["federal_holidays"] = """
SELECT CAST(h AS TIMESTAMP) AS holiday,
       (SELECT count(*) FROM orders o WHERE CAST(o.o_orderdate AS DATE) = h) AS n_orders
FROM c_holidays, c_order_years
WHERE year(h) BETWEEN lo AND hi OR (h IN (make_date(CAST(lo AS INT) - 1, 12, 31)) AND isodow(h) = 5)"""
FINAL["lag_features"] = """
SELECT station_id, hour_ts, occupancy_lag_1h, CAST(net_flow_lag_1h AS DOUBLE) AS net_flow_lag_1h,
       CAST(net_flow_same_hour_last_week AS DOUBLE) AS net_flow_same_hour_last_week FROM c_lags"""
FINAL["rolling_mean_7d"] = """
SELECT station_id, hour_ts, round(net_flow_rolling_7d_mean, 6) AS net_flow_rolling_7d_mean FROM c_lags"""
FINAL["weather_features"] = """
SELECT station_id, hour_ts, temperature_2m, wind_gusts_10m, precipitation, is_daylight FROM c_features"""
FINAL["station_hour_features"] = (
    "SELECT * REPLACE (" + ", ".join(f"round({c}, 6) AS {c}" for c in FEATURES) + ") FROM c_features"
)

# ---- assembly ------------------------------------------------------------------------------------------------------

SPLIT = """CASE WHEN hour_ts <= TIMESTAMP '2024-01-18 00:00:00' THEN 'train'
            WHEN hour_ts <= TIMESTAMP '2024-01-24 00:00:00' THEN 'val'
            WHEN hour_ts <= TIMESTAMP '2024-01-29 00:00:00' THEN 'test' ELSE 'after' END AS split"""
CTE["c_split"] = f"SELECT *, {SPLIT} FROM c_labels"
CTE["c_baseline"] = """
SELECT station_id, CAST(hour(hour_ts) AS INT) AS hour, CAST(isodow(hour_ts) - 1 AS INT) AS dow,
       CAST(sum(net_flow) AS BIGINT) AS sum_net_flow, count(*) AS n_rows, avg(net_flow) AS mean_net_flow
FROM c_split WHERE split = 'train' GROUP BY 1, 2, 3"""
CTE["c_scored"] = """
SELECT t.net_flow, coalesce(b.mean_net_flow, (SELECT avg(net_flow) FROM c_split WHERE split = 'train')) AS pred_flow
FROM c_split t LEFT JOIN c_baseline b
  ON b.station_id = t.station_id AND b.hour = hour(t.hour_ts) AND b.dow = isodow(t.hour_ts) - 1
WHERE t.split = 'test'"""

FINAL["chronological_split"] = "SELECT station_id, hour_ts, net_flow, split FROM c_split WHERE split <> 'after'"
FINAL["attribution_sample"] = "SELECT station_id, hour_ts, net_flow, split FROM c_split WHERE split = 'test'"
FINAL["split_manifest"] = """
SELECT split, count(*) AS n_rows, min(hour_ts) AS from_ts, max(hour_ts) AS to_ts FROM c_split GROUP BY 1"""
FINAL["class_weight"] = """
SELECT n_pos, n_neg, round(CASE WHEN n_pos > 0 THEN n_neg::DOUBLE / n_pos ELSE 1.0 END, 6) AS class_weight
FROM (SELECT count(*) FILTER (WHERE is_empty) AS n_pos, count(*) FILTER (WHERE NOT is_empty) AS n_neg
      FROM c_split WHERE split = 'train')"""
FINAL["baseline_table"] = """
SELECT * REPLACE (round(mean_net_flow, 6) AS mean_net_flow) FROM c_baseline"""

# ---- checks and reports --------------------------------------------------------------------------------------------

CTE["c_zero"] = """
SELECT station_id, count(*) AS n_hours, count(*) FILTER (WHERE occupancy < 1) AS n_zero FROM c_labels GROUP BY 1"""

FINAL["mass_balance"] = """
SELECT 'mass_balance' AS "check", CASE WHEN o = e THEN 'OK' ELSE 'FAIL' END AS status, o AS observed, e AS expected,
       'warn' AS severity
FROM (SELECT CAST(count(*) FILTER (WHERE event_type = 'reb_in') - count(*) FILTER (WHERE event_type = 'reb_out')
                  AS DOUBLE) AS o,
             CAST(count(*) FILTER (WHERE event_kind = 'fleet_entry') - count(*) FILTER (WHERE event_kind = 'fleet_exit')
                  AS DOUBLE) AS e FROM c_events)"""
FINAL["zero_rate"] = """
SELECT 'zero_rate' AS "check", CASE WHEN r < 15 THEN 'OK' ELSE 'REVIEW' END AS status, round(r, 6) AS observed,
       15.0::DOUBLE AS expected, 'warn' AS severity
FROM (SELECT 100.0::DOUBLE * sum(n_zero) / sum(n_hours) AS r FROM c_zero)"""
FINAL["zero_concentration"] = """
SELECT n_stations, n_dead, n_zero, n_zero_worst,
       round(CASE WHEN n_zero > 0 THEN 100.0::DOUBLE * n_zero_worst / n_zero ELSE 0 END, 6) AS worst_share_pct
FROM (SELECT count(*) AS n_stations, count(*) FILTER (WHERE n_zero = n_hours) AS n_dead,
             CAST(sum(n_zero) AS BIGINT) AS n_zero FROM c_zero),
     (SELECT CAST(sum(n_zero) AS BIGINT) AS n_zero_worst
      FROM (SELECT n_zero FROM c_zero ORDER BY n_zero DESC, station_id LIMIT 20))"""
FINAL["worst_stations"] = """
SELECT station_id, n_hours, n_zero, round(100.0::DOUBLE * n_zero / n_hours, 6) AS pct_zero
FROM c_zero ORDER BY n_zero DESC, station_id LIMIT 5"""
FINAL["maintenance_by_month"] = """
SELECT date_trunc('month', event_time)::TIMESTAMP AS month, count(*) AS n_removals FROM c_events
WHERE event_kind = 'maintenance_removal' GROUP BY 1"""
FINAL["leakage_audit"] = "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, true AS declared, true AS present, 'OK' AS status, count({c}) AS n_values "
    "FROM c_features"
    for c in FEATURES
)
FINAL["leakage_audit_faults"] = "\nUNION ALL\n".join(
    [
        f"SELECT '{c}' AS column_name, true AS declared, true AS present, 'OK' AS status, count({c}) AS n_values "
        "FROM c_features"
        for c in FEATURES[1:]
    ]
    + [
        f"SELECT '{FEATURES[0]}', true, false, 'WARN', 0",
        "SELECT 'bikes_now', false, true, 'FAIL', count(net_flow) FROM c_features",
    ]
)
FINAL["ridership_by_quarter"] = """
SELECT CAST(year(start_time) AS INT) AS year, count(*) FILTER (WHERE quarter(start_time) = 1) AS q1,
       count(*) FILTER (WHERE quarter(start_time) = 2) AS q2, count(*) FILTER (WHERE quarter(start_time) = 3) AS q3,
       count(*) FILTER (WHERE quarter(start_time) = 4) AS q4
FROM c_rides_kept GROUP BY 1"""
FINAL["dataset_card"] = """
SELECT n_trips, n_bikes, n_stations, n_station_hours, n_hours, mean_occupancy, zero_hour_share, zero_flow_share
FROM (SELECT count(*) AS n_trips, count(DISTINCT bike_id) AS n_bikes FROM c_rides_kept),
     (SELECT count(DISTINCT station_id) AS n_stations, count(*) AS n_station_hours,
             count(DISTINCT hour_ts) AS n_hours, round(avg(occupancy), 6) AS mean_occupancy,
             round(avg(CASE WHEN is_empty THEN 1.0 ELSE 0.0 END), 6) AS zero_hour_share,
             round(avg(CASE WHEN net_flow = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_flow_share FROM c_labels)"""
FINAL["feature_profile"] = "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, round(min({c}), 6) AS min_value, round(max({c}), 6) AS max_value, "
    f"round(stddev_samp({c}), 6) AS stddev, round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS null_share, "
    f"round(avg(CASE WHEN {c} = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_share FROM c_features"
    for c in FEATURES
)
FINAL["recovery_gate"] = """
SELECT 'recovered' AS "check", 'OK' AS status, CAST(2 * count(*) AS DOUBLE) AS observed,
       CAST(2 * count(*) AS DOUBLE) AS expected, 'error' AS severity FROM c_rides_kept
UNION ALL SELECT 'missing', 'OK', 0.0::DOUBLE, 0.0::DOUBLE, 'error'
UNION ALL SELECT 'spurious', 'OK', 0.0::DOUBLE, 0.0::DOUBLE, 'error'"""

# Each ride's planted move has one event at its end station and one at a station 100,000 further.
CTE["c_planted"] = """
SELECT unnest([end_station_id, end_station_id + 100000]) AS station_id FROM c_rides_kept"""
CTE["c_planted_n"] = """
SELECT CAST(count(*) AS DOUBLE) AS planted, CAST(count(*) FILTER (WHERE station_id % 7 = 0) AS DOUBLE) AS missing,
  CAST(count(*) FILTER (WHERE station_id % 11 = 1 AND station_id % 7 <> 0) AS DOUBLE) AS spurious FROM c_planted"""
FINAL["recovery_gate_faults"] = """
SELECT 'recovered' AS "check", CASE WHEN missing = 0 THEN 'OK' ELSE 'FAIL' END AS status, planted - missing AS observed,
       planted AS expected, 'error' AS severity FROM c_planted_n
UNION ALL SELECT 'missing', CASE WHEN missing = 0 THEN 'OK' ELSE 'FAIL' END, missing, 0.0::DOUBLE, 'error' FROM c_planted_n
UNION ALL SELECT 'spurious', CASE WHEN spurious = 0 THEN 'OK' ELSE 'FAIL' END, spurious, 0.0::DOUBLE, 'error' FROM c_planted_n"""

# ---- metrics -------------------------------------------------------------------------------------------------------

CTE["c_p"] = """
SELECT is_empty, 1 / (1 + occupancy_lag_1h) AS s FROM c_lags WHERE occupancy_lag_1h IS NOT NULL"""
CTE["c_by_score"] = """
SELECT s, CAST(count(*) FILTER (WHERE is_empty) AS DOUBLE) AS pos,
       CAST(count(*) FILTER (WHERE NOT is_empty) AS DOUBLE) AS neg FROM c_p GROUP BY s"""
CTE["c_ranked"] = """
SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM c_by_score WINDOW w AS (ORDER BY s DESC)"""

FINAL["baseline_mae"] = """
SELECT count(*) AS n_rows, round(avg(abs(net_flow - pred_flow)), 6) AS mae FROM c_scored"""
FINAL["regression_metrics"] = """
SELECT count(*) AS n_rows, round(avg(abs(net_flow - pred_flow)), 6) AS mae,
       round(sqrt(avg((net_flow - pred_flow) * (net_flow - pred_flow))), 6) AS rmse FROM c_scored"""
# The first boosted tree: histograms of (feature, bin) with NULL as bin -1, each threshold with NULLs on both sides.
BINS = {
    "precipitation": "[0.25, 0.5, 1, 2]", "is_daylight": "[0]", "occupancy_lag_1h": "[0, 1, 2, 3, 5, 8, 13]",
    "net_flow_lag_1h": "[-2, -1, 0, 1]", "net_flow_same_hour_last_week": "[-1, 0, 1]",
}
CTE["c_train_bins"] = "SELECT station_id, hour_ts, -net_flow::DOUBLE AS g, [" + ", ".join(
    f"CASE WHEN {c} IS NULL THEN -1 ELSE len(list_filter({e}, lambda e: e < {c})) END" for c, e in BINS.items()
) + f"""] AS bins
FROM (SELECT *, {SPLIT} FROM c_features) WHERE split = 'train'"""


def _best_split(rows: str) -> str:
    """The best split of every node of rows (node, g, bins)."""
    return f"""
SELECT node, feature, bin, missing_left, gain, nl, gl, nr, gr FROM (
  SELECT *, (gl * gl / nl + gr * gr / nr) - ga * ga / na AS gain FROM (
    SELECT *, n_low + (CASE WHEN missing_left THEN n_miss ELSE 0 END) AS nl,
           g_low + (CASE WHEN missing_left THEN g_miss ELSE 0 END) AS gl, na - nl AS nr, ga - gl AS gr
    FROM (
      SELECT *, unnest([false, true]) AS missing_left FROM (
        SELECT node, feature, bin, sum(n) OVER w AS na, sum(g) OVER w AS ga,
               sum(CASE WHEN bin < 0 THEN n ELSE 0 END) OVER w AS n_miss,
               sum(CASE WHEN bin < 0 THEN g ELSE 0 END) OVER w AS g_miss,
               sum(CASE WHEN bin >= 0 THEN n ELSE 0 END) OVER (w ORDER BY bin) AS n_low,
               sum(CASE WHEN bin >= 0 THEN g ELSE 0 END) OVER (w ORDER BY bin) AS g_low
        FROM (SELECT node, feature, bins[feature + 1] AS bin, count(*) AS n, sum(g) AS g
              FROM {rows}, range(0, {len(BINS)}) t(feature) GROUP BY ALL)
        WINDOW w AS (PARTITION BY node, feature)
      ) WHERE bin >= 0
    ) WHERE NOT missing_left OR n_miss > 0
  ) WHERE nl >= 20 AND nr >= 20
) QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, feature, bin, missing_left) = 1"""


CTE["c_root_rows"] = "SELECT 0 AS node, g, bins FROM c_train_bins"
CTE["c_root_split"] = _best_split("c_root_rows")
CTE["c_child_rows"] = """
SELECT CASE WHEN CASE WHEN bins[s.feature + 1] < 0 THEN missing_left ELSE bins[s.feature + 1] <= s.bin END
            THEN 1 ELSE 2 END AS node, r.g, r.bins
FROM c_root_rows r, c_root_split s"""
CTE["c_child_split"] = _best_split("c_child_rows")
FINAL["missing_value_splits"] = """
SELECT CAST(node AS INT) AS node, [@NAMES@][feature + 1] AS feature,
       coalesce([@EDGES@][feature + 1][bin + 1], 'Infinity'::DOUBLE)::DOUBLE AS threshold, missing_left,
       round(gain, 9) AS gain, CAST(nl + nr AS BIGINT) AS n_rows, round(-0.2::DOUBLE * gl / nl, 9) AS value_left,
       round(-0.2::DOUBLE * gr / nr, 9) AS value_right
FROM (SELECT * FROM c_root_split UNION ALL SELECT * FROM c_child_split) WHERE gain > 1e-9""".replace(
    "@NAMES@", ", ".join(f"'{c}'" for c in BINS)
).replace("@EDGES@", ", ".join(f"{e}::DOUBLE[]" for e in BINS.values()))

# The leaves of the fixed trees with the tests of their paths; every coalition of the other features of a path.
CTE["c_fixed_leaves"] = """
SELECT * FROM (VALUES
  (0.2::DOUBLE, ['arr', 'occupancy'], [-1e300, -1e300], [0, 3], [0.6::DOUBLE, 0.5]),
  (-0.4, ['arr', 'occupancy'], [-1e300, 3], [0, 1e300], [0.6, 0.5]),
  (1.0, ['arr', 'dep'], [0, -1e300], [1e300, 1], [0.4, 0.7]),
  (-0.5, ['arr', 'dep', 'capacity'], [0, 1, -1e300], [1e300, 1e300, 8], [0.4, 0.3, 0.9]),
  (2.0, ['arr', 'dep', 'capacity'], [0, 1, 8], [1e300, 1e300, 1e300], [0.4, 0.3, 0.1]),
  (-1.0, ['occupancy'], [-1e300], [1], [0.3]),
  (0.5, ['occupancy', 'capacity'], [1, -1e300], [5, 4], [0.35, 0.2]),
  (0.1, ['occupancy', 'capacity'], [1, 4], [5, 1e300], [0.35, 0.8]),
  (0.9, ['occupancy'], [5], [1e300], [0.35])) t(value, f, low, high, share)"""
CTE["c_fixed_tests"] = """
SELECT station_id, hour_ts, value, f, share, unnest(range(1, len(f) + 1)) AS j, list_transform(range(1, len(f) + 1),
         lambda i: CASE WHEN x[list_position(names, f[i])] > low[i] AND x[list_position(names, f[i])] <= high[i]
                        THEN 1.0::DOUBLE ELSE 0.0 END) AS inside
FROM (SELECT station_id, hour_ts, [arr::DOUBLE, dep, occupancy, capacity] AS x,
             ['arr', 'dep', 'occupancy', 'capacity'] AS names FROM c_split WHERE split = 'test')
CROSS JOIN c_fixed_leaves"""
CTE["c_fixed_terms"] = """
SELECT station_id, hour_ts, f[j] AS feature, value * (inside[j] - share[j])
         * factorial(bit_count(mask)::INT) * factorial((len(f) - 1 - bit_count(mask))::INT) / factorial(len(f)::INT)::DOUBLE
         * coalesce(list_product(list_transform(list_filter(range(1, len(f) + 1), lambda i: i <> j), lambda i:
             CASE WHEN (mask >> (i - 1)) & 1 = 1 THEN inside[i] ELSE share[i] END)), 1) AS part
FROM (SELECT *, unnest(range(0, 1 << len(f))) AS mask FROM c_fixed_tests) WHERE (mask >> (j - 1)) & 1 = 0"""
FINAL["shapley_fixed_trees"] = """
SELECT station_id, hour_ts, round(sum(part) FILTER (WHERE feature = 'arr'), 9) AS arr,
       round(sum(part) FILTER (WHERE feature = 'dep'), 9) AS dep,
       round(sum(part) FILTER (WHERE feature = 'occupancy'), 9) AS occupancy,
       round(sum(part) FILTER (WHERE feature = 'capacity'), 9) AS capacity,
       (SELECT round(0.25 + sum(value * list_product(share)), 9) FROM c_fixed_leaves) AS base_value
FROM c_fixed_terms GROUP BY station_id, hour_ts"""
FINAL["classification_metrics"] = """
SELECT CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg,
       round(sum(pos * tp / (tp + fp)) / sum(pos), 6) AS pr_auc,
       round(sum(neg * (tp - pos + pos / 2)) / (sum(pos) * sum(neg)), 6) AS roc_auc,
       round(sum(pos * (s - 1) * (s - 1) + neg * s * s) / sum(pos + neg), 6) AS brier,
       round(-sum(pos * ln(greatest(s, 1e-15)) + neg * ln(1 - least(s, 1 - 1e-15))) / sum(pos + neg), 6) AS log_loss
FROM c_ranked"""
CTE["c_filled"] = (
    f"SELECT {', '.join(f'coalesce({c}, 0) AS {c}' for c in FEATURES)} "
    f"FROM (SELECT *, {SPLIT} FROM c_features) WHERE split <> 'after'"
)
CTE["c_means"] = f"SELECT {', '.join(f'avg({c}) AS {c}' for c in FEATURES)} FROM c_filled"
CTE["c_effects"] = "\nUNION ALL\n".join(
    f"SELECT '{GROUP_OF[c]}' AS feature_group, avg(abs({i + 1} * (f.{c} - m.{c}))) AS effect FROM c_filled f, c_means m"
    for i, c in enumerate(FEATURES)
)
FINAL["group_share"] = """
SELECT feature_group, round(sum(effect), 6) AS mean_abs_effect,
       round(sum(effect) / (SELECT sum(effect) FROM c_effects), 6) AS share FROM c_effects GROUP BY 1"""

# ---- sources and sinks ---------------------------------------------------------------------------------------------

FINAL["zip_csv_rows"] = """
SELECT trip_id, nullif(duration, '') AS duration, start_time, end_time, start_station, end_station, bike_id,
       bike_type, passholder_type FROM c_raw"""
FINAL["csv_text_scan"] = FINAL["zip_csv_rows"]
FINAL["archive_links"] = """
SELECT url, count(*) AS n_links
FROM (SELECT unnest(regexp_extract_all(html, 'href="([^"]*)"', 1, 'i')) AS url FROM pages) GROUP BY 1"""
CTE["c_plan_bounds"] = """
SELECT CAST(min(o_orderdate) AS DATE) AS lo, CAST(max(o_orderdate) AS DATE) AS hi FROM orders"""
CTE["c_plan"] = """
SELECT point_name, CAST(s AS TIMESTAMP) AS chunk_start, CAST(least(s + 182, hi) AS TIMESTAMP) AS chunk_end,
       'point=' || point_name || '/' || strftime(s, '%Y-%m-%d') || '_' || strftime(least(s + 182, hi), '%Y-%m-%d')
         || '.json.gz' AS object_name
FROM (SELECT DISTINCT event_type AS point_name FROM events),
     (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 183 DAY)) AS DATE) AS s, hi FROM c_plan_bounds)"""
FINAL["fetch_plan"] = "SELECT * FROM c_plan"
FINAL["fetch_missing"] = """
SELECT * FROM c_plan p WHERE NOT EXISTS (
  SELECT 1 FROM events e WHERE e.event_type = p.point_name AND CAST(e.ts AS DATE) BETWEEN p.chunk_start AND p.chunk_end)"""
FINAL["sink_roundtrip"] = FINAL["sink_catalog"] = FINAL["sink_published"] = FINAL["station_hour_labels"]
FINAL["sink_plain"] = FINAL["stations_clean"]

FINAL["feature_vector_sum"] = (
    "SELECT station_id, hour_ts, round(" + " + ".join(f"coalesce({c}, 0)" for c in FEATURES) + ", 6) AS vector_sum, "
    "CAST(" + " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in FEATURES) + " AS INT) AS n_filled "
    f"FROM (SELECT *, {SPLIT} FROM c_features) WHERE split <> 'after'"
)
