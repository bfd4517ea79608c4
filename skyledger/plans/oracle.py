"""Plain SQL for the registered queries, runnable by DuckDB on the same tables.

The views every query builds on are common table expressions kept by name; `with_views`
puts the ones a statement uses in front of it.
"""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {}


def view(name: str, sql: str) -> None:
    VIEWS[name] = sql


def with_views(sql: str) -> str:
    """Prefix the views mentioned in `sql`, and the ones those mention, in order of definition."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(VIEWS[name])

    visit(sql)
    parts = [f"{n} AS ({VIEWS[n]})" for n in VIEWS if n in needed]
    return (f"WITH {', '.join(parts)} " if parts else "") + sql


def rounded(sql: str, *columns: str, digits: int = 6) -> str:
    """Round the named columns, without negative zero."""
    if not columns:
        return with_views(sql)
    reps = ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in columns)
    return with_views(f"SELECT * REPLACE ({reps}) FROM ({sql})")


view("v_airports", """
  SELECT n_nationkey AS key, n_name AS airport, n_regionkey AS region,
    CAST(25 AS DOUBLE) + ((n_nationkey // 2) * 7) % 24 + (n_nationkey % 2) * CAST(0.2 AS DOUBLE) AS lat,
    CAST(-120 AS DOUBLE) + ((n_nationkey // 2) * 11) % 50 + (n_nationkey % 2) * CAST(0.1 AS DOUBLE) AS lon
  FROM nation""")
view("v_legs", """
  SELECT *, lead(o_key) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt
  FROM (SELECT event_id, user_id, value, ts, date_trunc('minute', ts) AS dep_datetime,
          (event_id * 7 + user_id * 3) % 25 AS o_key FROM events)""")
view("v_routed", """
  SELECT *, CASE WHEN nxt IS NULL OR event_id % 10 = 0 OR nxt = o_key
                 THEN (o_key + 1 + event_id % 24) % 25 ELSE nxt END AS d_key,
    CASE WHEN event_id % 50 <> 7 THEN floor(value * 2 - 60) END AS dd
  FROM v_legs""")
view("v_flights", """
  SELECT event_id AS flight_id, CAST(dep_datetime AS DATE) AS FlightDate, 'C' || (user_id % 9) AS Operating_Airline,
    'N' || user_id AS Tail_Number, o.airport AS ORIGIN, d.airport AS DEST, dd AS DepDelay, dd - 5 + event_id % 11 AS ArrDelay,
    CAST(8 + (event_id * 13) % 30 AS DOUBLE) AS TaxiOut, CAST(3 + (event_id * 5) % 12 AS DOUBLE) AS TaxiIn,
    CAST(40 + event_id % 180 AS DOUBLE) AS AirTime, CAST(200 + (event_id * 37) % 2400 AS DOUBLE) AS Distance,
    CAST(year(dep_datetime) AS INTEGER) AS "Year", CAST(month(dep_datetime) AS INTEGER) AS "Month",
    CAST(day(dep_datetime) AS INTEGER) AS DayofMonth, CAST(isodow(dep_datetime) AS INTEGER) AS DayOfWeek,
    dep_datetime, dep_datetime + to_minutes(60 + event_id % 180) AS arr_datetime,
    date_trunc('hour', dep_datetime) AS dep_hour,
    date_trunc('hour', dep_datetime + to_minutes(60 + event_id % 180)) AS arr_hour
  FROM v_routed JOIN v_airports o ON o.key = o_key JOIN v_airports d ON d.key = d_key""")
view("v_train", "SELECT * FROM v_flights WHERE dep_datetime < TIMESTAMP '2024-01-16 00:00:00'")
view("v_obs", """
  SELECT airport, date_trunc('minute', ts) + to_hours(CAST(event_id % 5 - 2 AS INTEGER)) AS datetime,
    lat + (event_id % 3 - 1) * CAST(0.001 AS DOUBLE) AS latitude, lon + (event_id % 3 - 1) * CAST(0.001 AS DOUBLE) AS longitude,
    CAST(a.key * 10 + event_id % 5 AS DOUBLE) AS elevation_m,
    (event_id * 7) % 180 / CAST(10 AS DOUBLE) AS wind_speed_ms, (event_id * 7) % 180 / CAST(10 AS DOUBLE) + event_id % 9 AS wind_gust_ms,
    CASE WHEN event_id % 17 <> 3 THEN CAST(16000 - ((event_id * 11) % 16) * 1000 AS DOUBLE) END AS visibility_m,
    CASE WHEN event_id % 3 <> 0 THEN ((event_id * 13) % 20) / CAST(4 AS DOUBLE) END AS precip_depth_mm,
    CAST(1000 + event_id % 30 AS DOUBLE) AS sea_level_pressure_hpa, CAST(300 * (event_id % 40) AS DOUBLE) AS ceiling_m,
    CAST(event_id % 9 AS DOUBLE) AS sky_cover_oktas, event_id % 35 - 5 + value / 100 AS temp_c
  FROM events JOIN v_airports a ON a.key = (event_id * 11 + user_id) % 25""")
view("v_wx", """
  SELECT airport, date_trunc('hour', datetime) AS obs_hour, avg(wind_speed_ms) AS wind_speed_ms, max(wind_gust_ms) AS wind_gust_ms,
    min(visibility_m) AS visibility_m, coalesce(sum(precip_depth_mm), 0) AS precip_depth_mm,
    avg(sea_level_pressure_hpa) AS sea_level_pressure_hpa, min(ceiling_m) AS ceiling_m, max(sky_cover_oktas) AS sky_cover_oktas,
    avg(temp_c) AS temp_c
  FROM v_obs GROUP BY 1, 2""")
view("v_enriched", """
  SELECT f.*, w.* EXCLUDE (airport, obs_hour) FROM v_flights f
  LEFT JOIN v_wx w ON w.airport = f.ORIGIN AND w.obs_hour = f.dep_hour""")
view("v_enriched_train", "SELECT * FROM v_enriched WHERE dep_datetime < TIMESTAMP '2024-01-16 00:00:00'")
view("v_next", """
  SELECT *, date_diff('second', arr_datetime, dep2) / CAST(60 AS DOUBLE) AS gap_min FROM (
    SELECT *, lead(flight_id) OVER w AS id2, lead(ORIGIN) OVER w AS o2, lead(DEST) OVER w AS d2, lead(dep_datetime) OVER w AS dep2,
      lead(arr_datetime) OVER w AS arr2, lead(DepDelay) OVER w AS dd2, lead(ArrDelay) OVER w AS ad2
    FROM v_flights WINDOW w AS (PARTITION BY Tail_Number ORDER BY dep_datetime, flight_id))""")
view("v_rotation", """
  SELECT 'rotation' AS edge_type, Tail_Number AS tail_number, flight_id AS leg1_flight_id, id2 AS leg2_flight_id,
    ORIGIN AS src_airport, DEST AS mid_airport, d2 AS dst_airport, TRUE AS airport_match, dep_datetime AS leg1_dep,
    arr_datetime AS leg1_arr, dep2 AS leg2_dep, arr2 AS leg2_arr, gap_min AS turnaround_min, ArrDelay AS leg1_arr_delay,
    DepDelay AS leg1_dep_delay, dd2 AS leg2_dep_delay, ad2 AS leg2_arr_delay,
    1 / (1 + exp(1 - greatest(coalesce(ArrDelay, 0), 0) / greatest(gap_min, 1))) AS edge_weight
  FROM v_next WHERE gap_min BETWEEN 0 AND 720 AND DEST = o2""")
view("v_tailprop", """
  SELECT *, CASE WHEN ok THEN c ELSE 0 END AS cumul_delay, CASE WHEN ok THEN k ELSE 0 END AS legs_done,
    CASE WHEN ok THEN pa ELSE 0 END AS immed_inbound
  FROM (SELECT *, coalesce(pa IS NOT NULL AND date_diff('second', parr, dep_datetime) BETWEEN 0 AND 28800, FALSE) AS ok FROM (
    SELECT *, lag(arr_datetime) OVER w AS parr, lag(ArrDelay) OVER w AS pa, row_number() OVER w - 1 AS k,
      coalesce(sum(greatest(ArrDelay, 0)) OVER (PARTITION BY Tail_Number, FlightDate ORDER BY dep_datetime, flight_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c
    FROM v_flights WINDOW w AS (PARTITION BY Tail_Number, FlightDate ORDER BY dep_datetime, flight_id)))""")
view("v_taxi", """
  SELECT ORIGIN AS airport, avg(TaxiOut) AS taxi_mean, greatest(coalesce(stddev_samp(TaxiOut), 5), 1) AS taxi_std, count(TaxiOut) AS taxi_n
  FROM v_flights GROUP BY 1""")
view("v_hot_hours", """
  SELECT h.ORIGIN, h.dep_hour, (h.avg_taxi - t.taxi_mean) / t.taxi_std AS z
  FROM (SELECT ORIGIN, dep_hour, avg(TaxiOut) AS avg_taxi FROM v_flights GROUP BY 1, 2) h
  JOIN v_taxi t ON t.airport = h.ORIGIN WHERE (h.avg_taxi - t.taxi_mean) / t.taxi_std > 1.3""")
view("v_anomaly_pairs", """
  SELECT f.ORIGIN, f.DEST, count(DISTINCT f.dep_hour) AS co_congest_hours, avg(z) AS avg_zscore
  FROM v_flights f JOIN v_hot_hours h ON h.ORIGIN = f.ORIGIN AND h.dep_hour = f.dep_hour
  GROUP BY 1, 2 HAVING count(DISTINCT f.dep_hour) >= 2""")
view("v_anomaly", """
  SELECT e.src_airport, e.dst_airport, 'congestion' AS edge_type, 'taxi_anomaly' AS sub_type,
    greatest(0, least(1, avg_zscore / 3.9)) AS edge_weight, taxi_mean, taxi_std, CAST(taxi_n AS DOUBLE) AS taxi_n, avg_zscore, co_congest_hours
  FROM (SELECT ORIGIN AS src_airport, DEST AS dst_airport, avg_zscore, co_congest_hours FROM v_anomaly_pairs
        UNION ALL SELECT DEST, ORIGIN, avg_zscore, co_congest_hours FROM v_anomaly_pairs) e
  LEFT JOIN v_taxi t ON t.airport = e.src_airport WHERE e.src_airport <> e.dst_airport""")
view("v_routes", "SELECT ORIGIN, DEST, count(*) AS flight_count FROM v_flights GROUP BY 1, 2")
view("v_volume", """
  SELECT ORIGIN AS src_airport, DEST AS dst_airport, 'congestion' AS edge_type, 'volume' AS sub_type,
    flight_count / CAST(max(flight_count) OVER () AS DOUBLE) AS edge_weight, flight_count
  FROM v_routes WHERE flight_count >= 10""")
view("v_hubs", """
  SELECT airport, CAST(departures AS BIGINT) AS departures FROM (
    SELECT ORIGIN AS airport, sum(flight_count) AS departures FROM v_routes GROUP BY 1) ORDER BY departures DESC, airport LIMIT 5""")
view("v_hubspoke", """
  SELECT ORIGIN AS src_airport, DEST AS dst_airport, 'congestion' AS edge_type, 'hub_spoke' AS sub_type, direction,
    flight_count / CAST(max(flight_count) OVER () AS DOUBLE) AS edge_weight, flight_count
  FROM (SELECT *, 'hub_to_spoke' AS direction FROM v_routes WHERE ORIGIN IN (SELECT airport FROM v_hubs)
        UNION ALL SELECT *, 'spoke_to_hub' FROM v_routes WHERE DEST IN (SELECT airport FROM v_hubs))
  WHERE ORIGIN <> DEST""")
view("v_congestion", """
  SELECT src_airport, dst_airport, edge_type, sub_type, edge_weight, taxi_mean, taxi_std, taxi_n FROM v_anomaly
  UNION ALL SELECT src_airport, dst_airport, edge_type, sub_type, edge_weight, NULL, NULL, NULL FROM v_volume
  UNION ALL SELECT src_airport, dst_airport, edge_type, sub_type, edge_weight, NULL, NULL, NULL FROM v_hubspoke""")
view("v_priors", """
  SELECT airport, CASE WHEN rank <= 5 AND n IS NOT NULL THEN CAST(1 AS DOUBLE) ELSE 0 END AS is_hub, coalesce(dep, 0) AS hist_avg_dep_delay,
    coalesce(taxi, 0) AS hist_avg_taxi_out, coalesce(arr, 0) AS hist_avg_arr_delay,
    coalesce(CAST(n AS DOUBLE) / max(n) OVER (), 0) AS total_departures_norm, coalesce(taxi, 19) AS taxi_baseline
  FROM (SELECT *, row_number() OVER (ORDER BY n DESC NULLS LAST, airport) AS rank FROM (
    SELECT coalesce(d.airport, a.airport) AS airport, dep, taxi, n, arr
    FROM (SELECT ORIGIN AS airport, avg(DepDelay) AS dep, avg(TaxiOut) AS taxi, count(DepDelay) AS n FROM v_train GROUP BY 1) d
    FULL JOIN (SELECT DEST AS airport, avg(ArrDelay) AS arr FROM v_train GROUP BY 1) a ON a.airport = d.airport))""")
view("v_climate", """
  SELECT ORIGIN AS airport, CAST(hour(dep_datetime) AS INTEGER) AS hour_of_day, CAST(month(dep_datetime) AS INTEGER) AS month,
    coalesce(avg(wind_speed_ms), 0) AS wind, coalesce(avg(precip_depth_mm), 0) AS precip, coalesce(avg(visibility_m), 0) AS vis
  FROM v_enriched_train GROUP BY 1, 2, 3""")
view("v_forecast_all", """
  SELECT k.airport, k.h AS hour_of_day, k.m AS month, a.airport IS NOT NULL OR b.airport IS NOT NULL AS present,
    coalesce(a.wind, 0) AS wind_3h, coalesce(a.precip, 0) AS precip_3h, coalesce(a.vis, 0) AS vis_3h,
    coalesce(b.wind, 0) AS wind_6h, coalesce(b.precip, 0) AS precip_6h, coalesce(b.vis, 0) AS vis_6h
  FROM (SELECT airport, CAST(h AS INTEGER) AS h, CAST(m AS INTEGER) AS m FROM (SELECT DISTINCT airport FROM v_climate),
          range(24) AS hs(h), range(1, 13) AS ms(m)) k
  LEFT JOIN v_climate a ON a.airport = k.airport AND a.hour_of_day = (k.h + 3) % 24
    AND a.month = CASE WHEN k.h + 3 < 24 THEN k.m ELSE k.m % 12 + 1 END
  LEFT JOIN v_climate b ON b.airport = k.airport AND b.hour_of_day = (k.h + 6) % 24
    AND b.month = CASE WHEN k.h + 6 < 24 THEN k.m ELSE k.m % 12 + 1 END""")
view("v_forecast", "SELECT * EXCLUDE (present) FROM v_forecast_all WHERE present")
view("v_dep_counts", "SELECT ORIGIN AS airport, dep_hour AS hour, count(*) AS n FROM v_flights GROUP BY 1, 2")
view("v_arr_counts", "SELECT DEST AS airport, arr_hour AS hour, count(*) AS n FROM v_flights GROUP BY 1, 2")
view("v_traffic_grid", """
  SELECT a.airport, h.dep_hour AS snapshot_time,
    {loads}
  FROM (SELECT DISTINCT airport FROM v_airports) a, (SELECT DISTINCT dep_hour FROM v_flights) h""".format(loads=",\n    ".join(
    f"coalesce((SELECT sum(n) FROM v_{c}_counts x WHERE x.airport = a.airport AND x.hour > h.dep_hour AND x.hour <= h.dep_hour + INTERVAL {w} HOUR), 0) AS {c}_{w}h"
    for c in ("dep", "arr") for w in (1, 3, 6))))
view("v_traffic", """
  SELECT airport, snapshot_time, CAST(dep_1h AS BIGINT) AS dep_1h, CAST(dep_3h AS BIGINT) AS dep_3h, CAST(dep_6h AS BIGINT) AS dep_6h,
    CAST(arr_1h AS BIGINT) AS arr_1h, CAST(arr_3h AS BIGINT) AS arr_3h, CAST(arr_6h AS BIGINT) AS arr_6h
  FROM v_traffic_grid WHERE dep_6h + arr_6h > 0""")
view("v_state", """
  SELECT coalesce(d.airport, a.airport) AS airport, coalesce(d.hour, a.hour) AS snapshot_time, coalesce(departures, 0) AS departures,
    avg_dep_delay, avg_taxi_out, coalesce(dep_count, 0) AS dep_count, wind_speed_ms, visibility_m, precip_depth_mm,
    avg_arr_delay, avg_taxi_in, coalesce(arr_count, 0) AS arr_count
  FROM (SELECT ORIGIN AS airport, dep_hour AS hour, count(*) AS departures, avg(DepDelay) AS avg_dep_delay, avg(TaxiOut) AS avg_taxi_out,
          count(DepDelay) AS dep_count, avg(wind_speed_ms) AS wind_speed_ms, avg(visibility_m) AS visibility_m,
          avg(precip_depth_mm) AS precip_depth_mm FROM v_enriched GROUP BY 1, 2) d
  FULL JOIN (SELECT DEST AS airport, arr_hour AS hour, avg(ArrDelay) AS avg_arr_delay, avg(TaxiIn) AS avg_taxi_in,
          count(ArrDelay) AS arr_count FROM v_enriched GROUP BY 1, 2) a ON a.airport = d.airport AND a.hour = d.hour""")
view("v_fine", """
  SELECT ORIGIN, DEST, CAST(hour(dep_datetime) AS INTEGER) AS dep_hour, CAST(isodow(dep_datetime) - 1 AS INTEGER) AS dow, count(DepDelay) AS n,
    avg(DepDelay) AS hist_avg, coalesce(stddev_samp(DepDelay), 15) AS hist_std
  FROM v_train GROUP BY 1, 2, 3, 4 HAVING count(DepDelay) >= 2""")
view("v_mid", """
  SELECT ORIGIN, DEST, CAST(hour(dep_datetime) AS INTEGER) AS dep_hour, count(DepDelay) AS n, avg(DepDelay) AS hist_avg,
    coalesce(stddev_samp(DepDelay), 15) AS hist_std
  FROM v_train GROUP BY 1, 2, 3 HAVING count(DepDelay) >= 2""")
view("v_coarse", """
  SELECT ORIGIN, DEST, count(DepDelay) AS n, avg(DepDelay) AS hist_avg, coalesce(stddev_samp(DepDelay), 20) AS hist_std
  FROM v_train GROUP BY 1, 2 HAVING count(DepDelay) >= 1""")
view("v_prior", """
  SELECT f.flight_id,
    coalesce(a.hist_avg, b.hist_avg, c.hist_avg, (SELECT avg(DepDelay) FROM v_train)) AS hist_avg,
    coalesce(a.hist_std, b.hist_std, c.hist_std, (SELECT stddev_samp(DepDelay) FROM v_train)) AS hist_std
  FROM v_flights f
  LEFT JOIN v_fine a ON a.ORIGIN = f.ORIGIN AND a.DEST = f.DEST AND a.dep_hour = hour(f.dep_datetime) AND a.dow = isodow(f.dep_datetime) - 1
  LEFT JOIN v_mid b ON b.ORIGIN = f.ORIGIN AND b.DEST = f.DEST AND b.dep_hour = hour(f.dep_datetime)
  LEFT JOIN v_coarse c ON c.ORIGIN = f.ORIGIN AND c.DEST = f.DEST""")
view("v_grid", """
  SELECT snapshot_time, CAST(row_number() OVER (ORDER BY snapshot_time) - 1 AS INTEGER) AS snap_idx FROM (
    SELECT unnest(generate_series(min(dep_hour), max(CASE WHEN dep_datetime > dep_hour THEN dep_hour + INTERVAL 1 HOUR ELSE dep_hour END),
      INTERVAL 1 HOUR)) AS snapshot_time FROM v_flights)""")
view("v_keys", """
  SELECT f.flight_id, g.snapshot_time, g.snap_idx, date_diff('second', g.snapshot_time, f.dep_datetime) / CAST(3600 AS DOUBLE) AS h2dep,
    coalesce(DepDelay, 0) AS y,
    CAST(CASE WHEN DepDelay IS NULL THEN NULL WHEN f.dep_datetime >= g.snapshot_time + INTERVAL 6 HOUR THEN 6
      WHEN f.dep_datetime >= g.snapshot_time + INTERVAL 3 HOUR THEN 3 WHEN f.dep_datetime >= g.snapshot_time + INTERVAL 1 HOUR THEN 1
      ELSE 0 END AS INTEGER) AS horizon_h
  FROM v_flights f JOIN v_grid g ON f.dep_datetime >= g.snapshot_time AND f.dep_datetime < g.snapshot_time + INTERVAL 8 HOUR""")
view("v_members", """
  SELECT flight_id, snapshot_time, FALSE AS is_support FROM v_keys
  UNION ALL
  SELECT r.leg1_flight_id, g.snapshot_time, TRUE FROM v_rotation r JOIN v_grid g ON g.snapshot_time = date_trunc('hour', r.leg2_dep)
  WHERE r.leg1_arr < g.snapshot_time
    AND NOT EXISTS (SELECT 1 FROM v_keys k WHERE k.flight_id = r.leg1_flight_id AND k.snapshot_time = g.snapshot_time)""")
view("v_flight_rows", """
  SELECT m.snapshot_time, g.snap_idx, m.flight_id, m.is_support, f.ORIGIN, f.DEST, f.Tail_Number, f.dep_datetime, f.arr_datetime,
    CAST(0 AS DOUBLE) AS f_dep_delay_now,
    sin(2 * pi() * hour(f.dep_datetime) / 24) AS f_dep_hour_sin, cos(2 * pi() * hour(f.dep_datetime) / 24) AS f_dep_hour_cos,
    CASE WHEN r.leg2_flight_id IS NULL THEN 0 ELSE least(r.turnaround_min / 90, 1) END AS f_turnaround,
    least(greatest(CASE WHEN r.leg2_flight_id IS NULL THEN t.immed_inbound ELSE coalesce(r.leg1_arr_delay, 0) END / 300, 0), 1) AS f_inbound,
    least(f.Distance / 5000, 1) AS f_distance,
    CASE WHEN r.leg2_flight_id IS NULL AND t.cumul_delay = 0 AND t.immed_inbound = 0 THEN CAST(1 AS DOUBLE) ELSE 0 END AS f_is_first,
    CAST(0 AS DOUBLE) AS f_taxi_out_now,
    sin(2 * pi() * (isodow(f.dep_datetime) - 1) / 7) AS f_dow_sin, cos(2 * pi() * (isodow(f.dep_datetime) - 1) / 7) AS f_dow_cos,
    coalesce(p.is_hub, 0) AS f_hub_origin, CAST(0 AS DOUBLE) AS f_carrier_delay_now,
    sin(2 * pi() * hour(f.arr_datetime) / 24) AS f_arr_hour_sin, cos(2 * pi() * hour(f.arr_datetime) / 24) AS f_arr_hour_cos,
    least(greatest(date_diff('second', m.snapshot_time, f.dep_datetime) / CAST(3600 AS DOUBLE), 0) / 24, 1) AS f_h2dep,
    least(greatest(t.cumul_delay / 300, 0), 1) AS f_cumul, least(t.legs_done / CAST(6 AS DOUBLE), 1) AS f_legs,
    least(greatest(q.hist_avg / 300, -1), 1) AS f_hist_avg, least(greatest(q.hist_std / 300, 0), 1) AS f_hist_std,
    CASE WHEN m.is_support THEN 0 ELSE coalesce(f.DepDelay, 0) END AS y,
    CASE WHEN m.is_support THEN NULL ELSE k.horizon_h END AS horizon_h, t.immed_inbound
  FROM v_members m JOIN v_grid g ON g.snapshot_time = m.snapshot_time JOIN v_flights f ON f.flight_id = m.flight_id
  JOIN v_tailprop t ON t.flight_id = m.flight_id JOIN v_prior q ON q.flight_id = m.flight_id
  LEFT JOIN v_keys k ON k.flight_id = m.flight_id AND k.snapshot_time = m.snapshot_time
  LEFT JOIN v_rotation r ON r.leg2_flight_id = m.flight_id AND date_trunc('hour', r.leg2_dep) = m.snapshot_time AND NOT m.is_support
  LEFT JOIN v_priors p ON p.airport = f.ORIGIN""")
view("v_airport_rows", """
  SELECT g.snapshot_time, a.airport, coalesce(p.is_hub, 0) AS is_hub, coalesce(p.hist_avg_dep_delay, 0) AS hist_avg_dep_delay,
    coalesce(p.hist_avg_taxi_out, 0) AS hist_avg_taxi_out, coalesce(p.hist_avg_arr_delay, 0) AS hist_avg_arr_delay,
    coalesce(p.total_departures_norm, 0) AS total_departures_norm,
    coalesce(s.avg_dep_delay, 0) AS avg_dep_delay, coalesce(s.avg_arr_delay, 0) AS avg_arr_delay, coalesce(s.avg_taxi_out, 0) AS avg_taxi_out,
    coalesce(s.avg_taxi_in, 0) AS avg_taxi_in, CAST(coalesce(s.dep_count, 0) AS DOUBLE) AS dep_count,
    CAST(coalesce(s.arr_count, 0) AS DOUBLE) AS arr_count, coalesce(s.wind_speed_ms, 0) AS wind, coalesce(s.visibility_m, 0) AS vis,
    coalesce(s.precip_depth_mm, 0) AS precip,
    least(coalesce(t.dep_1h, 0) / CAST(25 AS DOUBLE), 1) AS load_dep_1h, least(coalesce(t.arr_1h, 0) / CAST(25 AS DOUBLE), 1) AS load_arr_1h,
    least(coalesce(t.dep_3h, 0) / CAST(60 AS DOUBLE), 1) AS load_dep_3h, least(coalesce(t.dep_6h, 0) / CAST(120 AS DOUBLE), 1) AS load_dep_6h,
    least(coalesce(t.arr_3h, 0) / CAST(60 AS DOUBLE), 1) AS load_arr_3h, least(coalesce(t.arr_6h, 0) / CAST(120 AS DOUBLE), 1) AS load_arr_6h,
    coalesce(w.wind_3h, 0) AS forecast_wind_3h, coalesce(w.precip_3h, 0) AS forecast_precip_3h, coalesce(w.vis_3h, 0) AS forecast_vis_3h,
    coalesce(w.wind_6h, 0) AS forecast_wind_6h, coalesce(w.precip_6h, 0) AS forecast_precip_6h, coalesce(w.vis_6h, 0) AS forecast_vis_6h,
    sin(2 * pi() * hour(g.snapshot_time) / 24) AS hour_sin, cos(2 * pi() * hour(g.snapshot_time) / 24) AS hour_cos,
    sin(2 * pi() * month(g.snapshot_time) / 12) AS month_sin, cos(2 * pi() * month(g.snapshot_time) / 12) AS month_cos,
    n.avg_dep_delay AS y, n.avg_dep_delay IS NOT NULL AS y_mask
  FROM v_grid g CROSS JOIN v_airports a
  LEFT JOIN v_state s ON s.airport = a.airport AND s.snapshot_time = g.snapshot_time
  LEFT JOIN v_state n ON n.airport = a.airport AND n.snapshot_time = g.snapshot_time + INTERVAL 1 HOUR
  LEFT JOIN v_traffic t ON t.airport = a.airport AND t.snapshot_time = g.snapshot_time
  LEFT JOIN v_forecast w ON w.airport = a.airport AND w.hour_of_day = hour(g.snapshot_time) AND w.month = month(g.snapshot_time)
  LEFT JOIN v_priors p ON p.airport = a.airport""")
view("v_departs", """
  SELECT f.snapshot_time, f.flight_id, f.ORIGIN AS airport,
    CASE WHEN s.avg_dep_delay > 15 OR s.avg_taxi_out > coalesce(p.taxi_baseline, 19) * 1.3 THEN CAST(1 AS DOUBLE) ELSE 0 END AS edge_weight
  FROM v_flight_rows f LEFT JOIN v_state s ON s.airport = f.ORIGIN AND s.snapshot_time = f.snapshot_time
  LEFT JOIN v_priors p ON p.airport = f.ORIGIN""")
_P = ", ".join(f"((flight_id * {13 + k * 6} + horizon_h * 11) % 1000) / CAST(1000 AS DOUBLE) AS p_ge_{t}"
               for k, t in enumerate((0, 15, 60, 120, 240, 720)))
view("v_pred", f"""
  SELECT *, abs(pred - actual) AS abs_err, (pred - actual) * (pred - actual) AS sq_err FROM (
    SELECT flight_id, snap_idx, snapshot_time, horizon_h, y * CAST(0.6 AS DOUBLE) + (flight_id * 17 + horizon_h * 5) % 40 - 10 AS pred,
      least(greatest(y, 0), 300) / 300 * CAST(0.6 AS DOUBLE) + ((flight_id * 31 + horizon_h * 7) % 1000) / CAST(2500 AS DOUBLE) AS severe_prob,
      y AS actual, {_P}
    FROM v_keys WHERE horizon_h IS NOT NULL)""")


def tier(c: str) -> str:
    return (f"CASE WHEN {c} IS NULL THEN NULL WHEN {c} < 0 THEN 0 WHEN {c} < 15 THEN 1 WHEN {c} < 60 THEN 2 WHEN {c} < 120 THEN 3 "
            f"WHEN {c} < 240 THEN 4 WHEN {c} < 720 THEN 5 ELSE 6 END")


def tier_text(c: str) -> str:
    return ("CASE {c} WHEN 0 THEN 'Early / On Time' WHEN 1 THEN 'Minor (0-15)' WHEN 2 THEN 'Moderate (15-60)' WHEN 3 THEN 'Heavy (60-120)' "
            "WHEN 4 THEN 'Severe (120-240)' WHEN 5 THEN 'Extreme (240-720)' WHEN 6 THEN 'Ultra (720+)' END").format(c=c)


def rates(tp: str = "tp", fp: str = "fp", fn: str = "fn") -> str:
    return (f"coalesce({tp} / nullif(CAST({tp} + {fp} AS DOUBLE), 0), 0) AS precision, "
            f"coalesce({tp} / nullif(CAST({tp} + {fn} AS DOUBLE), 0), 0) AS recall, "
            f"CAST({tp} + {fp} AS BIGINT) AS pred_pos, CAST({tp} + {fn} AS BIGINT) AS actual_pos, "
            f"CAST({tp} AS BIGINT) AS tp, CAST({fp} AS BIGINT) AS fp, CAST({fn} AS BIGINT) AS fn")


view("v_replay", f"""
  SELECT *, pred_tier_order = actual_tier_order AS tier_match,
    CASE WHEN pred_tier_order = actual_tier_order THEN 'Exact Tier Match' ELSE 'Tier Miss' END AS correctness,
    {tier_text('pred_tier_order')} AS pred_tier, {tier_text('actual_tier_order')} AS actual_tier,
    CASE WHEN severe_alert AND actual_severe THEN 'TP' WHEN severe_alert THEN 'FP' WHEN actual_severe THEN 'FN' ELSE 'TN' END AS alert_result
  FROM (SELECT p.flight_id, p.snap_idx, p.snapshot_time, strftime(p.snapshot_time, '%Y-%m-%d %H:%M') AS snapshot_label, p.horizon_h,
      CASE p.horizon_h WHEN 0 THEN '<1h' WHEN 1 THEN '1-3h' WHEN 3 THEN '3-6h' WHEN 6 THEN '>6h' END AS horizon_label,
      date_diff('second', p.snapshot_time, f.dep_datetime) / CAST(3600 AS DOUBLE) AS hours_to_departure,
      f.ORIGIN, f.DEST, f.ORIGIN || ' -> ' || f.DEST AS route, f.dep_datetime, strftime(f.dep_datetime, '%H:%M') AS dep_time_label,
      f.arr_datetime, strftime(f.arr_datetime, '%H:%M') AS arr_time_label, f.Tail_Number, f.Operating_Airline, p.pred,
      CAST({tier('p.pred')} AS INTEGER) AS pred_tier_order, p.severe_prob, p.severe_prob >= CAST(0.6 AS DOUBLE) AS severe_alert,
      p.actual, CAST({tier('p.actual')} AS INTEGER) AS actual_tier_order, p.actual >= 120 AS actual_severe, p.abs_err, p.sq_err,
      o.lat AS origin_lat, o.lon AS origin_lon, d.lat AS dest_lat, d.lon AS dest_lon
    FROM v_pred p JOIN v_flights f ON f.flight_id = p.flight_id JOIN v_airports o ON o.airport = f.ORIGIN JOIN v_airports d ON d.airport = f.DEST
    WHERE CAST(f.dep_datetime AS DATE) = DATE '2024-01-10')""")
_PICK = ", ".join(
    f"max(CASE WHEN p.snapshot_time = date_trunc('hour', f.dep_datetime - INTERVAL {h} HOUR) + "
    f"CASE WHEN minute(f.dep_datetime) > 30 THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END THEN p.pred END) AS p{h}" for h in (6, 3, 1))
view("v_tracked", """
  SELECT flight_id, ORIGIN, DEST, airline, tail, sched_dep, sched_arr, pred_6h, pred_3h, pred_1h, actual_arr_delay,
    error_6h, error_3h, error_1h, (p6 >= 15) = (actual_arr_delay >= 15) AS caught_6h, (p3 >= 15) = (actual_arr_delay >= 15) AS caught_3h,
    (p1 >= 15) = (actual_arr_delay >= 15) AS caught_1h,
    CASE WHEN actual_arr_delay >= 60 THEN 'Severe' WHEN actual_arr_delay >= 30 THEN 'Moderate' WHEN actual_arr_delay >= 15 THEN 'Minor'
      WHEN actual_arr_delay >= 0 THEN 'On Time' WHEN actual_arr_delay < 0 THEN 'Early' ELSE '-' END AS status
  FROM (SELECT *, round(p6, 1) AS pred_6h, round(p3, 1) AS pred_3h, round(p1, 1) AS pred_1h, round(abs(p6 - actual_arr_delay), 1) AS error_6h,
      round(abs(p3 - actual_arr_delay), 1) AS error_3h, round(abs(p1 - actual_arr_delay), 1) AS error_1h
    FROM (SELECT f.flight_id, f.ORIGIN, f.DEST, f.Operating_Airline AS airline, f.Tail_Number AS tail, strftime(f.dep_datetime, '%H:%M') AS sched_dep,
        strftime(f.arr_datetime, '%H:%M') AS sched_arr, f.ArrDelay AS actual_arr_delay, {picks}
      FROM v_pred p JOIN v_flights f ON f.flight_id = p.flight_id WHERE CAST(f.dep_datetime AS DATE) = DATE '2024-01-10'
      GROUP BY ALL) WHERE p6 IS NOT NULL OR p3 IS NOT NULL OR p1 IS NOT NULL)""".format(picks=_PICK))
