"""DuckDB SQL for the queries, written apart from the DataFrame code: plain forms without panes, chunks or buckets."""

from __future__ import annotations

import re

from ..functions.geo import SEA_AREAS
from ..operators.regimes import ARCHETYPES, FEATURES, unit_archetypes
from .feeds import YEAR


def half_up(x: str, digits: int) -> str:
    return f"(floor(({x}) * 1e{digits} + 0.5) / 1e{digits})"


_BOX = "CASE " + " ".join(f"WHEN lat BETWEEN {a} AND {b} AND lon BETWEEN {c} AND {d} THEN '{n}'" for n, a, b, c, d in SEA_AREAS) + " END"
_AREA = "list_extract([" + ", ".join(f"'{a[0]}'" for a in SEA_AREAS) + "], CAST(user_id % 9 AS INTEGER) + 1)"
_T, _W, _C = (f"{v} IS NOT NULL AND {q} <> '9'" for v, q in (("temperature_celsius", "temperature_quality"), ("wind_speed_mps", "wind_quality"), ("sky_clarity_score", "visibility_quality")))
_Y = f"observed_at >= TIMESTAMP '{YEAR}-01-01' AND observed_at < TIMESTAMP '{YEAR + 1}-01-01'"
_DAY = "time_bucket(INTERVAL '24 hours', observed_at, TIMESTAMP '1970-01-01')"
_UNIT = [f"least(greatest((CAST({c} AS DOUBLE) - ({a})) / ({b} - ({a})), 0.0), 1.0)" for c, (a, b) in FEATURES.items()]
_FAR = ", ".join("sqrt(" + " + ".join(f"({u} - CAST({v!r} AS DOUBLE)) * ({u} - CAST({v!r} AS DOUBLE))" for u, v in zip(_UNIT, centre)) + ")" for centre in unit_archetypes())
_LABELS = "[" + ", ".join(f"'{x}'" for x in ARCHETYPES) + "]"
_KIND = "CASE risk_class WHEN 'HIGH' THEN {0} WHEN 'MODERATE' THEN {1} ELSE {2} END"
_ADVICE = _KIND.format(
    "'Reroute around ' || sea_area_id || ' or reduce speed until wave and wind conditions improve.'", "'Reduce speed through ' || sea_area_id || ' and monitor the next buoy update.'",
    "'Continue planned route through ' || sea_area_id || '.'",
)

#: Feeds and result tables, each over those before it.
CTES = {
    "obs": """SELECT printf('%06d-99999', user_id) AS station_id, CAST(ts AS DATE) AS observation_date, ts AS observed_at,
        CASE WHEN event_type <> 'signup' THEN floor((value % 60.0) * 8.0) / 8.0 - 20.0 END AS temperature_celsius, CASE WHEN event_type = 'error' THEN '9' ELSE '1' END AS temperature_quality,
        CASE WHEN event_id % 17 <> 0 THEN CAST(event_id * 37 % 350 AS DOUBLE) / 8.0 END AS wind_speed_mps, CASE WHEN event_id % 23 = 0 THEN '9' ELSE '1' END AS wind_quality,
        CASE WHEN event_id % 13 <> 0 THEN CAST(event_id * 53 % 801 AS DOUBLE) / 8.0 END AS sky_clarity_score, CASE WHEN event_id % 29 = 0 THEN '9' ELSE '1' END AS visibility_quality,
        CAST(CASE event_type WHEN 'purchase' THEN 1 + event_id % 12 WHEN 'signup' THEN 0 END AS INTEGER) AS rain_duration_hours, event_id AS arrival_seq FROM events""",
    "stations": """SELECT printf('%06d-99999', c_custkey) AS station_id, c_name AS station_location, n_name AS region_id, n_name || ' / ' || r_name AS region_name
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_custkey % 7 <> 0""",
    "station_metadata": "SELECT station_id, station_location FROM stations",
    "places": "SELECT *, 13.0::DOUBLE + CAST(event_id * 31 % 1600 AS DOUBLE) / 100.0 AS lat, -86.5::DOUBLE + CAST(event_id * 17 % 2400 AS DOUBLE) / 100.0 AS lon FROM events WHERE event_type IN ('click', 'view')",
    "ais": f"""SELECT * FROM (SELECT printf('%09d', user_id) AS mmsi, CASE WHEN event_id % 5 <> 0 THEN 'vessel ' || user_id END AS vessel_name, ts AS observed_at, lat AS latitude, lon AS longitude,
        CAST(event_id % 250 AS DOUBLE) / 10.0 AS speed_over_ground_knots, CAST(event_id * 7 % 3600 AS DOUBLE) / 10.0 AS course_over_ground_degrees,
        CASE WHEN event_id % 3 <> 0 THEN ts + INTERVAL 6 HOUR END AS reported_eta, {_BOX} AS sea_area_id FROM places) WHERE sea_area_id IS NOT NULL""",
    "buoys": f"""SELECT printf('%05d', user_id % 11 + 41000) AS buoy_id, ts AS buoy_observed_at, {_AREA} AS sea_area_id, CAST(event_id % 45 AS DOUBLE) / 10.0 AS wave_height_meters,
        CAST(event_id * 7 % 200 AS DOUBLE) / 10.0 AS wind_speed_mps FROM events WHERE event_type = 'purchase'""",
    "daily_station_average": f"SELECT station_id, observation_date AS observation_day, {half_up('avg(temperature_celsius)', 6)} AS avg_temperature_celsius, count(*) AS sample_count FROM obs WHERE {_T} GROUP BY ALL",
    "monthly_station_frost_days": f"""SELECT station_id, CAST(date_trunc('month', observation_date) AS DATE) AS observation_month, count(DISTINCT observation_date) AS frost_day_count
        FROM obs WHERE {_T} AND temperature_celsius < 0 AND {_Y} GROUP BY ALL""",
    "lagged": f"""SELECT *, lag(temperature_celsius) OVER w AS was, lag(observed_at) OVER w AS then_ FROM (SELECT *, {_DAY} AS window_start FROM obs WHERE temperature_celsius IS NOT NULL AND {_Y})
        WINDOW w AS (PARTITION BY station_id, window_start ORDER BY arrival_seq)""",
    "rated": "SELECT *, (epoch_us(observed_at) - epoch_us(then_)) // 1000 AS ms FROM lagged",
    "rapid_temperature_change": f"""SELECT station_id, window_start, window_start + INTERVAL 24 HOUR AS window_end, coalesce(min(r), 0.0) AS min_rate_of_change, coalesce(max(r), 0.0) AS max_rate_of_change,
        {half_up('coalesce(avg(r), 0.0)', 3)} AS average_rate_of_change, count(r) AS rate_of_change_count
        FROM (SELECT *, CASE WHEN ms > 0 THEN (temperature_celsius - was) / (CAST(ms AS DOUBLE) / 3600000.0::DOUBLE) END AS r FROM rated) GROUP BY station_id, window_start""",
    "comfort_means": f"""SELECT coalesce(s.region_id, 'unknown') AS region_id, coalesce(s.region_name, 'Unknown region') AS region_name, {_DAY} AS window_start, {half_up('avg(temperature_celsius)', 1)} AS avg_temperature_celsius,
        {half_up('avg(wind_speed_mps)', 1)} AS avg_wind_speed_mps, {half_up('avg(sky_clarity_score)', 1)} AS sky_clarity_score, count(*) AS observation_count
        FROM obs LEFT JOIN stations s USING (station_id) WHERE {_T} AND {_W} AND {_C} AND {_Y} GROUP BY 1, 2, 3""",
    "comfort_scores": f"""SELECT *, {half_up('greatest(0.0::DOUBLE, 100.0::DOUBLE - abs(avg_temperature_celsius - 22.0) * 6.0) * 0.55::DOUBLE + greatest(0.0::DOUBLE, 100.0::DOUBLE - avg_wind_speed_mps * 3.5::DOUBLE) * 0.25::DOUBLE + sky_clarity_score * 0.20::DOUBLE', 1)} AS quality_score FROM comfort_means""",
    "tourism_weather_quality": """SELECT region_id, region_name, window_start, window_start + INTERVAL 24 HOUR AS window_end, avg_temperature_celsius, avg_wind_speed_mps, sky_clarity_score, quality_score,
        CASE WHEN quality_score >= 80 THEN 'excellent' WHEN quality_score >= 60 THEN 'good' WHEN quality_score >= 40 THEN 'ok' ELSE 'poor' END AS quality_class, observation_count FROM comfort_scores""",
    "yearly_station_rain_duration": f"""SELECT station_id, CAST(year(observation_date) AS INTEGER) AS observation_year, {half_up('avg(rain_duration_hours)', 6)} AS avg_duration_hours, count(*) AS sample_count
        FROM obs WHERE rain_duration_hours > 0 AND {_Y} GROUP BY ALL""",
    "peaks": f"""SELECT station_id, {half_up('avg(temperature_celsius)', 6)} AS avg_temperature_celsius, count(*) AS sample_count, min(temperature_celsius) AS min_temperature_celsius, max(temperature_celsius) AS max_temperature_celsius
        FROM obs WHERE {_T} AND {_Y} GROUP BY ALL""",
    "temperature_window_ranking": f"""SELECT TIMESTAMP '{YEAR}-01-01' AS window_start, TIMESTAMP '{YEAR + 1}-01-01' AS window_end, ranking_type, CAST(n AS INTEGER) AS rank_position, station_id, peak AS peak_temperature_celsius,
        avg_temperature_celsius, sample_count, min_temperature_celsius, max_temperature_celsius FROM (
        SELECT *, 'hot' AS ranking_type, max_temperature_celsius AS peak, row_number() OVER (ORDER BY max_temperature_celsius DESC, station_id) AS n FROM peaks UNION ALL
        SELECT *, 'cold', min_temperature_celsius, row_number() OVER (ORDER BY min_temperature_celsius, station_id) FROM peaks) WHERE n <= 10""",
    "hopped": """SELECT *, unnest(generate_series(date_trunc('day', observed_at) - INTERVAL 29 DAY, date_trunc('day', observed_at), INTERVAL 1 DAY)) AS window_start FROM obs WHERE temperature_celsius IS NOT NULL""",
    "fitted": """SELECT station_id, window_start, count(*) AS n, avg(temperature_celsius) AS mean, max(epoch_us(observed_at)) AS last_us,
        CASE WHEN count(*) > 1 THEN regr_slope(temperature_celsius, (epoch_us(observed_at) - epoch_us(window_start)) / 1e6::DOUBLE) ELSE 0.0 END AS slope,
        avg((epoch_us(observed_at) - epoch_us(window_start)) / 1e6::DOUBLE) AS x FROM hopped GROUP BY ALL""",
    "temperature_forecast": f"""SELECT station_id, CAST(window_start AS TIMESTAMP) AS window_start, CAST(window_start + INTERVAL 30 DAY AS TIMESTAMP) AS window_end, {half_up('slope', 6)} AS slope_per_second, {half_up('mean', 4)} AS current_average,
        {half_up('mean + slope * ((last_us - epoch_us(window_start)) / 1e6::DOUBLE - x + 86400)', 2)} AS forecast_next_24h, n AS observation_count FROM fitted""",
    "pairs": f"SELECT * FROM ais JOIN buoys USING (sea_area_id) WHERE abs(epoch_us(observed_at) - epoch_us(buoy_observed_at)) <= 1800000000 AND {_Y}",
    "scored_pairs": "SELECT *, least(100.0::DOUBLE, wave_height_meters * 22.0::DOUBLE + wind_speed_mps * 2.5::DOUBLE) AS risk_score FROM pairs",
    "classed_pairs": "SELECT *, CASE WHEN risk_score >= 75 THEN 'HIGH' WHEN risk_score >= 45 THEN 'MODERATE' ELSE 'LOW' END AS risk_class FROM scored_pairs",
    "delayed_pairs": f"SELECT *, CAST({_KIND.format(90, 30, 0)} AS BIGINT) AS eta_delay_minutes FROM classed_pairs",
    "route_pairs": f"""SELECT mmsi || '-' || strftime(observed_at, '%Y-%m-%dT%H:%M:%SZ') AS event_key, mmsi, vessel_name, sea_area_id, observed_at - INTERVAL 30 MINUTE AS window_start, observed_at + INTERVAL 30 MINUTE AS window_end,
        observed_at, latitude, longitude, speed_over_ground_knots, course_over_ground_degrees, wave_height_meters, wind_speed_mps, risk_score, risk_class, {_ADVICE} AS recommendation, reported_eta,
        reported_eta + to_minutes(eta_delay_minutes) AS updated_eta, eta_delay_minutes, buoy_id, buoy_observed_at FROM delayed_pairs""",
    "marine_route_recommendations": """SELECT * EXCLUDE (buoy_id, buoy_observed_at, n) FROM (SELECT *, row_number() OVER (PARTITION BY event_key ORDER BY buoy_observed_at DESC, buoy_id DESC) AS n FROM route_pairs) WHERE n = 1""",
    "pieces": f"""SELECT *, coalesce(rain_duration_hours, 0) > 0 AS wet, sum(CASE WHEN coalesce(rain_duration_hours, 0) > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY station_id ORDER BY arrival_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS piece
        FROM obs WHERE {_Y}""",
    "closed": "SELECT station_id, coalesce(piece, 0) AS piece, count(*) FILTER (wet) AS n, arg_min(observed_at, arrival_seq) FILTER (wet) AS a, max(observed_at) FILTER (NOT wet) AS b FROM pieces GROUP BY 1, 2",
    "wet_period_events": """SELECT station_id || '-' || strftime(a, '%Y-%m-%dT%H:%M:%SZ') AS event_key, station_id, a AS period_start, b AS period_end, (epoch_us(b) - epoch_us(a)) // 60000000 AS duration_minutes,
        n AS precipitation_observation_count, b AS closing_observed_at FROM closed WHERE n > 0 AND b IS NOT NULL""",
    "hourly": """SELECT *, unnest(generate_series(date_trunc('hour', observed_at) - INTERVAL 23 HOUR, date_trunc('hour', observed_at), INTERVAL 1 HOUR)) AS window_start FROM obs""",
    "blizzard_events": f"""SELECT station_id, CAST(window_start AS TIMESTAMP) AS window_start, CAST(window_start + INTERVAL 24 HOUR AS TIMESTAMP) AS window_end, 'blizzard-like-conditions' AS event_type, CAST(0 AS DOUBLE) AS freezing_threshold_celsius,
        CAST(12 AS DOUBLE) AS wind_threshold_mps, count(*) AS sample_count, count(*) FILTER ({_T} AND temperature_celsius <= 0) AS freezing_observation_count,
        count(*) FILTER ({_W} AND wind_speed_mps >= 12) AS strong_wind_observation_count, count(*) FILTER (rain_duration_hours > 0) AS precipitation_observation_count,
        coalesce(min(temperature_celsius) FILTER ({_T}), 0.0) AS min_temperature_celsius, coalesce(max(wind_speed_mps) FILTER ({_W}), 0.0) AS max_wind_speed_mps
        FROM hourly WHERE {_Y} AND (({_T}) OR ({_W}) OR rain_duration_hours > 0) GROUP BY ALL HAVING freezing_observation_count > 0 AND strong_wind_observation_count > 0 AND precipitation_observation_count > 0""",
    "station_days": f"""SELECT * EXCLUDE (t, w, c) FROM (SELECT station_id, observation_date, coalesce({half_up(f'avg(temperature_celsius) FILTER ({_T})', 1)}, 0.0) AS avg_temperature_celsius,
        coalesce({half_up(f'min(temperature_celsius) FILTER ({_T})', 1)}, 0.0) AS min_temperature_celsius, coalesce({half_up(f'max(temperature_celsius) FILTER ({_T})', 1)}, 0.0) AS max_temperature_celsius,
        coalesce({half_up(f'max(temperature_celsius) FILTER ({_T}) - min(temperature_celsius) FILTER ({_T})', 1)}, 0.0) AS temperature_range_celsius,
        coalesce({half_up(f'avg(wind_speed_mps) FILTER ({_W})', 1)}, 0.0) AS avg_wind_speed_mps, coalesce({half_up(f'max(wind_speed_mps) FILTER ({_W})', 1)}, 0.0) AS max_wind_speed_mps,
        coalesce({half_up(f'avg(sky_clarity_score) FILTER ({_C})', 1)}, 0.0) AS sky_clarity_score, count(*) FILTER (rain_duration_hours > 0) AS precipitation_observation_count,
        CAST(coalesce(sum(rain_duration_hours) FILTER (rain_duration_hours > 0), 0) AS BIGINT) AS rain_duration_hours, count(*) AS observation_count,
        count(*) FILTER ({_T}) AS t, count(*) FILTER ({_W}) AS w, count(*) FILTER ({_C}) AS c
        FROM obs WHERE {_Y} AND (({_T}) OR ({_W}) OR ({_C}) OR rain_duration_hours IS NOT NULL) GROUP BY station_id, observation_date)
        WHERE t > 0 OR w > 0 OR c > 0 OR precipitation_observation_count > 0""",
    "far": f"SELECT *, [{_FAR}] AS d FROM station_days",
    "weather_regimes": f"""SELECT * EXCLUDE (d), CAST(list_position(d, list_min(d)) - 1 AS INTEGER) AS cluster_id, {half_up('list_min(d)', 3)} AS distance_to_center,
        list_extract({_LABELS}, CAST(list_position(d, list_min(d)) AS INTEGER)) AS cluster_label FROM far""",
    "stream_counts": """SELECT 'raw' AS kind, count(*) AS total FROM obs UNION ALL SELECT 'parsed', count(*) FROM obs UNION ALL SELECT 'marine_ais_records', count(*) FROM ais
        UNION ALL SELECT 'marine_buoy_records', count(*) FROM buoys UNION ALL SELECT 'marine_route_recommendations', count(*) FROM route_pairs
        UNION ALL SELECT 'wet_period_events', count(*) FROM wet_period_events UNION ALL SELECT 'weather_regime_events', count(*) FROM weather_regimes""",
}


def over(select: str, ctes: dict[str, str] = CTES) -> str:
    """`select` with those of the CTEs that it needs, one after the other."""
    needed, todo = set(), [select]
    while todo:
        text = todo.pop()
        for name in ctes:
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                needed.add(name)
                todo.append(ctes[name])
    parts = [f"{name} AS ({ctes[name]})" for name in ctes if name in needed]
    return f"WITH {', '.join(parts)} {select}" if parts else select


def late(table: str, where: str, start: str, size: str) -> str:
    """A result table over readings that arrive out of order; those that come ten minutes after their window's end don't count in it.

    Stream time is the greatest time among the readings of `where` up to each.
    """
    order = "(arrival_seq + arrival_seq * 7919 % 1009 % 400) * 16777216 + arrival_seq"
    arrived = f"SELECT *, max(observed_at) OVER (ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS stream_time FROM readings WHERE {where}"
    open_ = f"{start} + {size} + INTERVAL 10 MINUTE > stream_time"
    ctes = {"readings": CTES["obs"], "obs": f"{arrived}"} | {k: v for k, v in CTES.items() if k != "obs"}
    if start == "window_start":  # a row for each of a reading's windows
        ctes |= {k: f"SELECT * FROM ({CTES[k]}) WHERE {open_}" for k in ("hopped", "hourly")}
    else:
        ctes["obs"] = f"SELECT * FROM ({arrived}) WHERE {open_}"
    return over(f"SELECT * FROM {table}", ctes)


def corrected(table: str) -> str:
    """A result table over readings of which every seventh is corrected by a later one of its station and time."""
    both = "SELECT * FROM readings UNION ALL SELECT * REPLACE (temperature_celsius + 5.0 AS temperature_celsius, arrival_seq + 1000000000 AS arrival_seq) FROM readings WHERE arrival_seq % 7 = 0"
    last = f"SELECT * FROM ({both}) QUALIFY row_number() OVER (PARTITION BY station_id, observed_at ORDER BY arrival_seq DESC) = 1"
    return over(f"SELECT * FROM {table}", {"readings": CTES["obs"], "obs": last} | {k: v for k, v in CTES.items() if k != "obs"})


_IN = f">= TIMESTAMP '{YEAR}-01-01' AND {{0}} < TIMESTAMP '{YEAR + 1}-01-01'"
_WITHIN = f"window_start >= TIMESTAMP '{YEAR}-01-01' AND window_end <= TIMESTAMP '{YEAR + 1}-01-01'"
_ENDS = f"window_end >= TIMESTAMP '{YEAR}-01-01' AND window_end <= TIMESTAMP '{YEAR + 1}-01-01'"
_DAYS = f"BETWEEN DATE '{YEAR}-01-01' AND DATE '{YEAR}-12-31'"
_META = "LEFT JOIN station_metadata m USING (station_id)"
_CITY, _METRIC = "coalesce(station_location, station_id)", "coalesce(station_location || ' (' || station_id || ')', station_id)"
_B = f"blizzard_events {_META} WHERE window_start {_IN.format('window_start')}"
_R = f"marine_route_recommendations WHERE observed_at {_IN.format('observed_at')}"
_F = f"monthly_station_frost_days {_META} WHERE observation_month {_DAYS}"
_RAIN = f"yearly_station_rain_duration {_META} WHERE observation_year = {YEAR}"
_CHANGE = f"rapid_temperature_change {_META} WHERE {_WITHIN}"
_FORE = f"temperature_forecast {_META} WHERE {_ENDS}"
_RANK = f"temperature_window_ranking {_META} WHERE window_start = TIMESTAMP '{YEAR}-01-01'"
_COMF = f"tourism_weather_quality WHERE {_WITHIN}"
_REG = f"weather_regimes {_META} WHERE observation_date {_DAYS}"
_BUCKETS = "CASE WHEN duration_minutes <= 30 THEN '0-30 min' WHEN duration_minutes <= 60 THEN '31-60 min' WHEN duration_minutes <= 180 THEN '61-180 min' WHEN duration_minutes <= 360 THEN '181-360 min' WHEN duration_minutes <= 720 THEN '361-720 min' ELSE '>720 min' END"


def _count(kind: str, name: str) -> str:
    return f"SELECT coalesce(max(total) FILTER (kind = '{kind}'), 0) AS {name} FROM stream_counts"


PANELS = {
    "d01_raw_counter": _count("raw", "raw_requests"),
    "d02_parsed_counter": _count("parsed", "parsed_requests"),
    "d03_stations": "SELECT count(DISTINCT station_id) AS stations FROM daily_station_average",
    "d04_daily_series": f"SELECT CAST(observation_day AS TIMESTAMP) AS time, {_METRIC} AS metric, avg_temperature_celsius AS value FROM daily_station_average {_META} WHERE observation_day {_DAYS}",
    "d05_latest_day": f"SELECT {_CITY} AS city, station_id, observation_day, avg_temperature_celsius, sample_count FROM daily_station_average {_META} WHERE observation_day {_DAYS} QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY observation_day DESC) = 1 ORDER BY station_id LIMIT 100",
    "d06_route_map": f"SELECT observed_at AS time, latitude, longitude, vessel_name, mmsi, sea_area_id, risk_score, risk_class, recommendation, eta_delay_minutes FROM {_R} ORDER BY observed_at DESC, event_key LIMIT 500",
    "d07_max_risk": f"SELECT coalesce(max(risk_score), 0) AS max_risk FROM {_R}",
    "d08_mean_delay": f"SELECT coalesce(avg(eta_delay_minutes), 0) AS avg_eta_delay_minutes FROM {_R}",
    "d09_route_counter": _count("marine_route_recommendations", "processed_route_recommendations"),
    "d10_latest_routes": f"SELECT observed_at, vessel_name, mmsi, sea_area_id, risk_class, {half_up('risk_score', 1)} AS risk_score, wave_height_meters, wind_speed_mps, eta_delay_minutes, recommendation FROM {_R} ORDER BY observed_at DESC, event_key LIMIT 50",
    "d11_latest_blizzard": f"SELECT CAST(epoch_ms(max(window_end) - INTERVAL 1 SECOND) AS DOUBLE) AS latest_event_window_end FROM {_B}",
    "d12_blizzard_windows": f"SELECT count(*) AS detected_blizzard_windows FROM {_B}",
    "d13_peak_wind": f"SELECT coalesce(max(max_wind_speed_mps), 0) AS peak_blizzard_wind_mps FROM {_B}",
    "d14_coldest_blizzard": f"SELECT coalesce(min(min_temperature_celsius), 0) AS coldest_blizzard_temperature FROM {_B}",
    "d15_latest_blizzards": f"SELECT {_CITY} AS city, station_id, window_start, window_end, min_temperature_celsius, max_wind_speed_mps, precipitation_observation_count, sample_count FROM {_B} ORDER BY window_end DESC, max_wind_speed_mps DESC, min_temperature_celsius, station_id LIMIT 20",
    "d16_most_blizzards": f"SELECT {_CITY} AS city, station_id, count(*) AS detected_windows, max(max_wind_speed_mps) AS strongest_blizzard_wind, min(min_temperature_celsius) AS coldest_detected_temp FROM {_B} GROUP BY 1, 2 ORDER BY 3 DESC, 4 DESC, 5, 2 LIMIT 15",
    "d17_frost_days": f"SELECT CAST(coalesce(sum(frost_day_count), 0) AS BIGINT) AS frost_days FROM {_F}",
    "d18_frost_stations": f"SELECT count(DISTINCT station_id) AS stations_with_frost FROM {_F}",
    "d19_peak_frost": f"SELECT coalesce(max(frost_day_count), 0) AS max_monthly_frost_days FROM {_F}",
    "d20_frost_series": f"SELECT CAST(observation_month AS TIMESTAMP) AS time, {_METRIC} AS metric, frost_day_count AS value FROM {_F}",
    "d21_top_frost": f"SELECT {_METRIC} AS city, CAST(sum(frost_day_count) AS BIGINT) AS frost_days FROM {_F} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    "d22_frost_counts": f"SELECT {_CITY} AS city, station_id, observation_month, frost_day_count FROM {_F} ORDER BY frost_day_count DESC, station_id, observation_month LIMIT 100",
    "d23_mean_rain": f"SELECT {half_up('coalesce(avg(avg_duration_hours), 0)', 6)} AS average_rain_duration_hours FROM {_RAIN}",
    "d24_rain_stations": f"SELECT count(*) AS stations FROM {_RAIN}",
    "d25_rain_observations": f"SELECT CAST(coalesce(sum(sample_count), 0) AS BIGINT) AS rain_observations FROM {_RAIN}",
    "d26_top_rain": f"SELECT {_METRIC} AS city, sample_count AS rain_observations FROM {_RAIN} ORDER BY sample_count DESC, station_id LIMIT 20",
    "d27_rain_table": f"SELECT {_CITY} AS city, station_id, observation_year, avg_duration_hours, sample_count FROM {_RAIN} ORDER BY avg_duration_hours DESC, station_id LIMIT 100",
    "d28_change_windows": f"SELECT count(*) AS event_count FROM {_CHANGE}",
    "d29_peak_heating": f"SELECT coalesce(max(max_rate_of_change), 0) AS max_heating_rate FROM {_CHANGE}",
    "d30_peak_cooling": f"SELECT coalesce(min(min_rate_of_change), 0) AS max_cooling_rate FROM {_CHANGE}",
    "d31_change_series": f"SELECT window_end AS time, {_METRIC} AS metric, average_rate_of_change AS value FROM {_CHANGE}",
    "d32_strongest_changes": f"SELECT {_CITY} AS city, station_id, window_start, window_end, min_rate_of_change, max_rate_of_change, average_rate_of_change, rate_of_change_count FROM {_CHANGE} ORDER BY abs(average_rate_of_change) DESC, station_id, window_start LIMIT 100",
    "d33_forecasts": f"SELECT count(*) AS forecast_count FROM {_FORE}",
    "d34_highest_forecast": f"SELECT coalesce(max(forecast_next_24h), 0) AS max_forecast FROM {_FORE}",
    "d35_forecast_series": f"SELECT window_end AS time, {_METRIC} AS metric, forecast_next_24h AS value FROM {_FORE}",
    "d36_latest_forecasts": f"SELECT {_CITY} AS city, station_id, window_start, window_end, slope_per_second, current_average, forecast_next_24h, observation_count FROM {_FORE} ORDER BY window_end DESC, station_id LIMIT 100",
    "d37_ranking_end": f"SELECT CAST(epoch_ms(max(window_end) - INTERVAL 1 SECOND) AS DOUBLE) AS latest_window_end FROM {_RANK}",
    "d38_ranked_stations": f"SELECT count(DISTINCT station_id) AS ranked_stations FROM {_RANK}",
    "d39_hot_leader": f"SELECT coalesce(max(peak_temperature_celsius), 0) AS peak_hot_leader FROM {_RANK} AND ranking_type = 'hot' AND rank_position = 1",
    "d40_cold_leader": f"SELECT coalesce(min(peak_temperature_celsius), 0) AS peak_cold_leader FROM {_RANK} AND ranking_type = 'cold' AND rank_position = 1",
    "d41_hottest": f"SELECT rank_position, {_CITY} AS city, station_id, peak_temperature_celsius, sample_count, window_start, window_end FROM {_RANK} AND ranking_type = 'hot'",
    "d42_coldest": f"SELECT rank_position, {_CITY} AS city, station_id, peak_temperature_celsius, sample_count, window_start, window_end FROM {_RANK} AND ranking_type = 'cold'",
    "d43_mean_score": f"SELECT {half_up('coalesce(avg(quality_score), 0)', 6)} AS average_quality_score FROM {_COMF}",
    "d44_scored_windows": f"SELECT count(*) AS quality_windows FROM {_COMF}",
    "d45_best_score": f"SELECT coalesce(max(quality_score), 0) AS best_quality_score FROM {_COMF}",
    "d46_score_series": f"SELECT window_start AS time, region_name AS metric, {half_up('avg(quality_score)', 6)} AS value FROM {_COMF} GROUP BY 1, 2",
    "d47_best_windows": f"SELECT region_name, quality_score, quality_class, avg_temperature_celsius, avg_wind_speed_mps, sky_clarity_score, observation_count, window_start FROM {_COMF} ORDER BY quality_score DESC, observation_count DESC, region_id, window_start LIMIT 25",
    "d48_score_classes": f"SELECT quality_class, count(*) AS window_count, {half_up('avg(quality_score)', 1)} AS avg_score FROM {_COMF} GROUP BY 1",
    "d49_station_days": f"SELECT count(*) AS station_days FROM {_REG}",
    "d50_regime_series": f"SELECT CAST(observation_date AS TIMESTAMP) AS time, cluster_label AS metric, count(*) AS value FROM {_REG} GROUP BY 1, 2",
    "d51_regime_shares": f"SELECT cluster_label AS regime, count(*) AS station_days FROM {_REG} GROUP BY 1",
    "d52_latest_regimes": f"SELECT {_CITY} AS station, station_id, observation_date, cluster_label, distance_to_center, avg_temperature_celsius, avg_wind_speed_mps, sky_clarity_score, rain_duration_hours, observation_count FROM {_REG} ORDER BY observation_date DESC, distance_to_center DESC, station_id LIMIT 100",
    "d53_regime_points": f"SELECT {_CITY} AS station, station_id, observation_date, cluster_label, avg_temperature_celsius, " + ", ".join(f"CASE WHEN cluster_label = '{x}' THEN avg_wind_speed_mps END AS {x}" for x in ARCHETYPES) + f" FROM {_REG} ORDER BY avg_temperature_celsius, avg_wind_speed_mps, station_id, observation_date LIMIT 5000",
    "d54_wet_counter": _count("wet_period_events", "wet_period_events"),
    "d55_mean_wet": "SELECT coalesce(round(avg(duration_minutes)), 0) AS average_duration_minutes FROM wet_period_events",
    "d56_longest_wet": "SELECT coalesce(max(duration_minutes), 0) AS max_duration_minutes FROM wet_period_events",
    "d57_latest_wet": f"SELECT {_METRIC} AS station, station_id, period_start, period_end, duration_minutes, precipitation_observation_count FROM wet_period_events {_META} ORDER BY period_end DESC, station_id, period_start LIMIT 100",
    "d58_wet_histogram": f"SELECT {_BUCKETS} AS duration_bucket, count(*) AS wet_period_count FROM wet_period_events GROUP BY 1",
}
