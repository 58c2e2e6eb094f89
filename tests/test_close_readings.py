"""Trends of readings that are a moment apart, against exact fractions."""

from datetime import datetime, timedelta
from fractions import Fraction

from pyspark.sql import functions as F

from tests.helpers import A, B, dicts, readings
from tidemark.plans import weather
from tidemark.streaming import runners

START = datetime(2024, 1, 1)
#: Seconds and temperatures of each station: a second apart at the day's end, and far apart with a last pair.
SEEN = {A: [(86_398.123457, 1.5), (86_399.234568, 24.625)], B: [(40_000.000001, 3.0), (86_399.25, -7.125), (2 * 86_400 + 70_000.5, 8.5), (2 * 86_400 + 70_000.500009, 11.25)]}


def exact(rows):
    x, y = [Fraction(round(t * 1_000_000), 1_000_000) for t, _ in rows], [Fraction(v) for _, v in rows]
    n, mx, my = len(rows), sum(x) / len(rows), sum(y) / len(rows)
    slope = sum((a - mx) * (b - my) for a, b in zip(x, y)) / sum((a - mx) ** 2 for a in x)
    return float(slope), float(my), float(my + slope * (max(x) - mx + 86_400)), n


def near(got, want):
    return all(abs(g - w) <= 1e-11 * max(1, abs(w)) for g, w in zip(got, want))


def test_forecast_of_readings_a_moment_apart(spark):
    obs = readings(spark, *[(s, (START + timedelta(microseconds=round(t * 1_000_000))).isoformat(), {"temperature_celsius": v}) for s, rows in SEEN.items() for t, v in rows])
    held = {(r["station_id"], r["observation_count"]): r for r in dicts(weather.forecast(obs).filter(F.col("window_start") == "2023-12-10"))}
    for s, rows in SEEN.items():
        r = held[s, len(rows)]
        assert near((r["slope_per_second"], r["current_average"], r["forecast_next_24h"], r["observation_count"]), exact(rows))


def test_forecast_of_a_stream_of_readings_a_moment_apart():
    day = 86_400_000_000
    for rows in SEEN.values():
        panes = {}
        for t, v in rows:
            us = round(t * 1_000_000)
            x = us % day
            one = [1, x, v, x * v, x * x, us]
            pane = us - x
            panes[pane] = runners.joined(runners.TREND, panes[pane], one) if pane in panes else one
        assert near(runners.trend_figures(sorted(panes.items())), exact(rows))
