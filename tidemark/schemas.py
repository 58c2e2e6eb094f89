"""Schemas of the feeds and of the result tables."""

from __future__ import annotations

ENVELOPE = (
    "schema_version int, source struct<type: string, host: string, path: string, file_name: string, year: string>, "
    "observed_at timestamp, ingested_at timestamp, size_bytes long, record_number long, payload_format string, payload_text string"
)
OBSERVATION = (
    "station_id string, observation_date date, observed_at timestamp, temperature_celsius double, temperature_quality string, "
    "wind_speed_mps double, wind_quality string, sky_clarity_score double, visibility_quality string, rain_duration_hours int, "
    "source_path string, record_number long, raw_payload string"
)
AIS_POSITION = (
    "mmsi string, vessel_name string, observed_at timestamp, latitude double, longitude double, speed_over_ground_knots double, "
    "course_over_ground_degrees double, destination string, reported_eta timestamp, sea_area_id string"
)
BUOY_OBSERVATION = (
    "buoy_id string, observed_at timestamp, latitude double, longitude double, sea_area_id string, wave_height_meters double, "
    "wind_speed_mps double, wind_direction_degrees double"
)

#: Result table -> primary key. Sinks keep one row for each.
KEYS = {
    "stream_counts": ["kind"],
    "station_metadata": ["station_id"],
    "daily_station_average": ["station_id", "observation_day"],
    "monthly_station_frost_days": ["station_id", "observation_month"],
    "rapid_temperature_change": ["station_id", "window_start", "window_end"],
    "tourism_weather_quality": ["region_id", "window_start", "window_end"],
    "yearly_station_rain_duration": ["station_id", "observation_year"],
    "temperature_window_ranking": ["window_start", "window_end", "ranking_type", "rank_position"],
    "temperature_forecast": ["station_id", "window_start", "window_end"],
    "marine_route_recommendations": ["event_key"],
    "wet_period_events": ["event_key"],
    "blizzard_events": ["station_id", "window_start", "window_end"],
    "weather_regimes": ["station_id", "observation_date"],
}
