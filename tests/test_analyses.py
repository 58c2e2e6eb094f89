"""Known results of each analysis, order of arrival, and what doesn't depend on order."""

from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.helpers import A, B, C, D, at, buoy_rows, dicts, readings, vessels
from tidemark.functions.numeric import round_half_up
from tidemark.functions.scores import comfort_class, comfort_score
from tidemark.operators.regimes import ARCHETYPES, MicroClusters
from tidemark.plans import marine, weather


def temp(value, **more):
    return {"temperature_celsius": value} | more


def test_round_half_up(spark):
    rows = spark.createDataFrame([(-2.25,), (2.25,), (2.24,), (-2.26,)], "x double").select(round_half_up(F.col("x"), 1).alias("y"))
    assert [r.y for r in rows.collect()] == [-2.2, 2.3, 2.2, -2.3]


def test_daily_average(spark):
    obs = readings(spark, (A, "2024-05-01 00:00", temp(2.0)), (A, "2024-05-01 12:00", temp(4.0)), (A, "2024-05-01 13:00", temp(99.0, temperature_quality="9")), (A, "2024-05-02 00:00", temp(None)), (None, "2024-05-02 00:00", temp(1.0)))
    assert [(r["avg_temperature_celsius"], r["sample_count"]) for r in dicts(weather.daily_average(obs))] == [(3.0, 2)]


def test_frost_days(spark):
    obs = readings(
        spark, (A, "2025-01-03 00:00", temp(-5.0)), (A, "2025-01-03 05:00", temp(-3.5)), (A, "2025-01-04 00:00", temp(-1.0)), (A, "2025-02-01 00:00", temp(-2.0)),
        (B, "2025-01-09 00:00", temp(-4.0)), (B, "2025-01-10 00:00", temp(0.0)), (B, "2024-01-10 00:00", temp(-9.0)),
    )
    got = {(r["station_id"], str(r["observation_month"])): r["frost_day_count"] for r in dicts(weather.frost_days(obs))}
    assert got == {(A, "2025-01-01"): 2, (A, "2025-02-01"): 1, (B, "2025-01-01"): 1}


@pytest.mark.parametrize("values, expected", [((10, 12, 15), (2, 2, 3, 2.5)), ((10, 14, 9), (2, -5, 4, -0.5)), ((10,), (0, 0, 0, 0))])
def test_rapid_change(spark, values, expected):
    obs = readings(spark, *[(A, f"2025-01-01 0{i}:00", temp(float(v))) for i, v in enumerate(values)])
    (r,) = dicts(weather.rapid_change(obs))
    assert (r["rate_of_change_count"], r["min_rate_of_change"], r["max_rate_of_change"], r["average_rate_of_change"]) == expected


def test_rapid_change_takes_the_order_of_arrival(spark):
    """A reading that isn't later gives no rate, but the next one is compared with it."""
    obs = readings(spark, (A, "2025-01-01 02:00", temp(10.0)), (A, "2025-01-01 01:00", temp(4.0)), (A, "2025-01-01 01:00", temp(5.0)), (A, "2025-01-01 03:00", temp(9.0)))
    (r,) = dicts(weather.rapid_change(obs))
    assert (r["rate_of_change_count"], r["average_rate_of_change"]) == (1, 2.0)


def test_late_readings_are_dropped_only_when_asked(spark):
    obs = readings(spark, (A, "2025-01-01 00:00", temp(1.0)), (B, "2025-01-02 00:09", temp(1.0)), (A, "2025-01-01 01:00", temp(2.0)), (B, "2025-01-02 00:10", temp(1.0)), (A, "2025-01-01 02:00", temp(9.0)))
    count = lambda df: {r["station_id"]: r["rate_of_change_count"] for r in dicts(df) if r["window_start"] == at("2025-01-01")}
    assert count(weather.rapid_change(obs)) == {A: 2}
    assert count(weather.rapid_change(obs, late=True)) == {A: 1}
    assert count(weather.rapid_change(obs, late=True, chunk=1)) == {A: 1}


def test_comfort_scores(spark):
    rows = spark.createDataFrame([(23.0, 3.0, 80.0), (2.0, 18.0, 10.0)], "t double, w double, c double").withColumn("s", comfort_score(F.col("t"), F.col("w"), F.col("c")))
    assert [(r.s, r.k) for r in rows.withColumn("k", comfort_class(F.col("s"))).collect()] == [(90.1, "excellent"), (11.3, "poor")]


def test_comfort_by_region(spark):
    reading = lambda t, w, c, **more: {"temperature_celsius": t, "wind_speed_mps": w, "sky_clarity_score": c} | more
    obs = readings(
        spark, (A, "2025-07-01 10:00", reading(22.0, 2.0, 100.0)), (B, "2025-07-01 11:00", reading(24.0, 4.0, 80.0)), (C, "2025-07-01 11:30", reading(30.0, 2.0, 100.0)),
        (D, "2025-07-01 11:30", reading(20.0, 2.0, 50.0)), (A, "2025-07-01 12:00", reading(50.0, 2.0, 100.0, temperature_quality="9")),
    )
    regions = spark.createDataFrame([(A, "NO", "Norway"), (B, "NO", "Norway"), (C, "US-CA", "United States / CA")], "station_id string, region_id string, region_name string")
    got = {r["region_id"]: r for r in dicts(weather.comfort(obs, regions))}
    no = got["NO"]
    assert (no["observation_count"], no["avg_temperature_celsius"], no["avg_wind_speed_mps"], no["sky_clarity_score"], no["quality_score"], no["quality_class"]) == (2, 23.0, 3.0, 90.0, 92.1, "excellent")
    assert got["US-CA"]["observation_count"] == 1 and got["unknown"]["region_name"] == "Unknown region"


def test_rain_duration(spark):
    rain = lambda h: {"rain_duration_hours": h}
    obs = readings(spark, (A, "2025-01-01 00:00", rain(6)), (A, "2025-05-01 00:00", rain(12)), (A, "2025-06-01 00:00", rain(0)), (A, "2025-06-02 00:00", rain(None)))
    (r,) = dicts(weather.rain_duration(obs))
    assert (r["observation_year"], r["avg_duration_hours"], r["sample_count"]) == (2025, 9.0, 2)


def test_ranking(spark):
    obs = readings(spark, (A, "2025-01-01 00:00", temp(10.0)), (A, "2025-07-01 00:00", temp(20.0)), (B, "2025-01-01 00:00", temp(-2.0)), (C, "2025-01-01 00:00", temp(18.0)), (D, "2024-01-01 00:00", temp(30.0)))
    got = dicts(weather.ranking(obs))
    first = {r["ranking_type"]: (r["station_id"], r["peak_temperature_celsius"]) for r in got if r["rank_position"] == 1}
    assert first == {"hot": (A, 20.0), "cold": (B, -2.0)} and len(got) == 6
    nested = weather.ranking_nested(weather.ranking(obs))
    (n,) = nested.collect()
    assert len(n.candidates) == 3 and n.hottest[0].station_id == A and n.window_start == at("2025-01-01")
    assert sorted((r["ranking_type"], r["rank_position"], r["station_id"]) for r in dicts(weather.ranking_rows(nested))) == sorted((r["ranking_type"], r["rank_position"], r["station_id"]) for r in got)


def test_ranking_ties_go_by_station(spark):
    obs = readings(spark, *[(f"{i:06d}-99999", "2025-01-01 00:00", temp(5.0)) for i in range(15, 0, -1)])
    hot = sorted((r["rank_position"], r["station_id"]) for r in dicts(weather.ranking(obs)) if r["ranking_type"] == "hot")
    assert hot == [(i, f"{i:06d}-99999") for i in range(1, 11)]


def test_forecast(spark):
    obs = readings(spark, *[(A, f"2025-01-01 0{i}:00", temp(10.0 + i)) for i in range(3)])
    got = dicts(weather.forecast(obs))
    assert len(got) == 30
    for r in got:
        assert r["slope_per_second"] == pytest.approx(1 / 3600, abs=1e-12) and r["current_average"] == 11.0 and r["forecast_next_24h"] == pytest.approx(36.0, abs=1e-6)


def test_wet_periods(spark):
    wet, dry = {"rain_duration_hours": 1}, {"rain_duration_hours": None}
    obs = readings(spark, (A, "2025-01-01 01:00", wet), (A, "2025-01-01 02:00", {"rain_duration_hours": 6}), (A, "2025-01-01 04:30", dry), (A, "2025-01-01 05:00", dry), (A, "2025-01-01 06:00", wet), (B, "2025-01-01 01:00", wet))
    for chunked in (weather.wet_periods(obs), weather.wet_periods(obs.withColumn("arrival_seq", F.col("arrival_seq") * (1 << 16)))):
        (r,) = dicts(chunked)
        assert (r["period_start"], r["period_end"], r["duration_minutes"], r["precipitation_observation_count"]) == (at("2025-01-01 01:00"), at("2025-01-01 04:30"), 210, 2)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from([A, B]), st.booleans()), min_size=1, max_size=40), st.integers(1, 7))
def test_spells_are_those_of_a_state_machine(spark, steps, chunk):
    from tidemark.operators.ordered import spells

    rows, open_, expected = [], {}, []
    for i, (station, on) in enumerate(steps):
        moment = datetime(2025, 1, 1) + timedelta(minutes=i)
        rows.append((station, i, moment, on))
        if on:
            start, n = open_.get(station, (moment, 0))
            open_[station] = (start, n + 1)
        elif station in open_:
            start, n = open_.pop(station)
            expected.append((station, start, moment, n))
    df = spark.createDataFrame(rows, "k string, o long, t timestamp, is_on boolean")
    got = [(r.k, r.period_start, r.period_end, r.n_on) for r in spells(df, "k", "o", "t", F.col("is_on"), chunk).collect()]
    assert sorted(got) == sorted(expected)


def test_blizzards(spark):
    obs = readings(spark, (A, "2025-01-01 01:00", temp(-4.0)), (A, "2025-01-01 05:00", {"wind_speed_mps": 13.2}), (A, "2025-01-01 06:00", {"rain_duration_hours": 3}))
    (r,) = dicts(weather.blizzards(obs, slide_hours=24))
    assert (r["window_start"], r["window_end"], r["min_temperature_celsius"], r["max_wind_speed_mps"], r["precipitation_observation_count"], r["sample_count"]) == (at("2025-01-01"), at("2025-01-02"), -4.0, 13.2, 1, 3)
    hourly = dicts(weather.blizzards(obs))
    assert len(hourly) == 24 - 5 and all(r["sample_count"] == 3 for r in hourly)


def test_station_days_and_regimes(spark):
    reading = lambda t, w, c, rain: {"temperature_celsius": t, "wind_speed_mps": w, "sky_clarity_score": c, "rain_duration_hours": rain}
    obs = readings(spark, (A, "2025-01-15 00:00", reading(-4.0, 8.0, 70.0, 2)), (A, "2025-01-15 01:00", reading(-2.0, 10.0, 80.0, None)), (B, "2024-01-15 00:00", reading(1.0, 1.0, 1.0, 1)), (C, "2025-01-16 00:00", temp(4.0)))
    got = {r["station_id"]: r for r in dicts(weather.regimes(obs))}
    a = got[A]
    assert (a["avg_temperature_celsius"], a["avg_wind_speed_mps"], a["sky_clarity_score"], a["observation_count"]) == (-3.0, 9.0, 75.0, 2)
    assert a["distance_to_center"] >= 0 and a["cluster_label"] in ARCHETYPES and set(got) == {A, C}
    assert (got[C]["avg_temperature_celsius"], got[C]["observation_count"], got[C]["avg_wind_speed_mps"]) == (4.0, 1, 0.0)


def test_micro_clusters(spark):
    obs = readings(spark, *[(f"{i:06d}-99999", f"2025-01-{1 + i % 28:02d} 00:00", {"temperature_celsius": -25.0 if i % 2 else 30.0, "wind_speed_mps": 20.0 if i % 2 else 1.0}) for i in range(60)])
    days = weather.station_days(obs).persist()
    model = MicroClusters(k=2)
    for first in (1, 15):
        model.update(days.filter(F.dayofmonth("observation_date").between(first, first + 13)))
    assert len(model.stats) <= 2 and sum(s["n"] for s in model.stats) == 60
    got = model.assign(days).collect()
    assert len({r.cluster_id for r in got if r.avg_temperature_celsius < 0}) == 1 and len({r.cluster_id for r in got}) == 2


def test_routes(spark):
    buoys = buoy_rows(spark, ("b", at("2025-01-01 10:00"), "CARIB_USVI", 3.2, 16.0), ("c", at("2025-01-01 10:40"), "CARIB_USVI", 0.0, 0.0), ("d", at("2025-01-01 10:41"), "CARIB_USVI", 9.0, 9.0), ("e", at("2025-01-01 10:10"), "CARIB_EAST", 9.0, 9.0))
    ships = vessels(spark, ("m", at("2025-01-01 10:10"), "CARIB_USVI", at("2025-01-01 16:00")))
    pairs = marine.route_pairs(ships, buoys, wave_weight=8.0)
    assert {r["buoy_id"] for r in dicts(pairs)} == {"b", "c"}  # exactly 30 minutes count
    first = [r for r in dicts(pairs) if r["buoy_id"] == "b"][0]
    assert (first["risk_score"], first["risk_class"], first["eta_delay_minutes"], first["updated_eta"]) == (pytest.approx(65.6), "MODERATE", 30, at("2025-01-01 16:30"))
    (last,) = dicts(marine.routes(pairs))
    assert (last["risk_class"], last["eta_delay_minutes"]) == ("LOW", 0)
    assert marine.route_pairs(ships, buoys, year=2024).count() == 0


@pytest.mark.parametrize("weight", [8.0, 22.0])
def test_high_risk(spark, weight):
    pairs = marine.route_pairs(vessels(spark, ("m", at("2025-01-01 00:00"), "X", None)), buoy_rows(spark, ("b", at("2025-01-01 00:10"), "X", 7.33, 16.9)), wave_weight=weight)
    (r,) = dicts(pairs)
    assert (r["risk_score"], r["risk_class"], r["eta_delay_minutes"], r["updated_eta"]) == (100.0, "HIGH", 90, None)
