"""Weather analyses over observations.

Each takes a DataFrame with the columns of `schemas.OBSERVATION` (and `arrival_seq` where the order of arrival counts) and returns
a result table. Those made of filters, windows and aggregates alone run on streams as well: see `streaming.runners`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import round_half_up
from ..functions.quality import in_year, usable_clarity, usable_temperature, usable_wind, wet
from ..functions.scores import comfort_class, comfort_score
from ..operators.ordered import rates, spells, top_k
from ..operators.regimes import by_archetype
from ..operators.regression import pane_sums, trends
from ..operators.windows import drop_late, first_open_window, hopping_from_panes, tumbling
from ..sources.stations import with_region

DAY, HOUR = 86_400, 3_600


def _temperatures(obs: DataFrame, year: int | None, by: str) -> DataFrame:
    named = F.col("station_id").isNotNull() & F.col("observation_date").isNotNull()
    return obs.filter(named & usable_temperature() & in_year(by, year))


def changing(obs: DataFrame, year: int | None) -> DataFrame:
    """Readings with a temperature, of any quality."""
    return obs.filter(F.col("station_id").isNotNull() & F.col("observed_at").isNotNull() & F.col("temperature_celsius").isNotNull() & in_year("observed_at", year))


def comfortable(obs: DataFrame, year: int | None) -> DataFrame:
    """Readings whose three signals of comfort are all usable."""
    return obs.filter(F.col("station_id").isNotNull() & F.col("observed_at").isNotNull() & usable_temperature() & usable_wind() & usable_clarity() & in_year("observation_date", year))


def stormy(obs: DataFrame, year: int | None) -> DataFrame:
    """Readings with any signal that tells of a blizzard."""
    return obs.filter(F.col("station_id").isNotNull() & F.col("observed_at").isNotNull() & in_year("observed_at", year) & (usable_temperature() | usable_wind() | wet()))


def daily_average(obs: DataFrame) -> DataFrame:
    """Mean temperature of each station and day, over all years."""
    days = _temperatures(obs, None, "observation_date").groupBy("station_id", F.col("observation_date").alias("observation_day"))
    return days.agg(F.avg("temperature_celsius").alias("avg_temperature_celsius"), F.count("*").alias("sample_count"))


def frost_days(obs: DataFrame, year: int | None = 2025, freezing: float = 0.0) -> DataFrame:
    """Days with a reading below freezing, by station and month. As a set of days in the month, which streams can do as well."""
    cold = _temperatures(obs, year, "observation_date").filter(F.col("temperature_celsius") < freezing)
    days = F.size(F.collect_set(F.dayofmonth("observation_date")))
    month = F.trunc("observation_date", "month").alias("observation_month")
    return cold.groupBy("station_id", month).agg(days.cast("long").alias("frost_day_count"))


def rapid_change(obs: DataFrame, year: int | None = 2025, window_hours: int = 24, late: bool = False, grace_minutes: int = 10, chunk: int = 1 << 16) -> DataFrame:
    """Least, greatest and mean change per hour between consecutive readings of a station inside a tumbling window.

    Readings of any quality count. A window's first reading has no predecessor; a window without rates has zeros.
    With `late`, readings that came after their window had closed are dropped; `chunk` is how much of arrival_seq a task takes then.
    """
    rows = changing(obs, year)
    rows = tumbling(rows.select("station_id", "observed_at", "temperature_celsius", "arrival_seq"), "observed_at", f"{window_hours} hours")
    if late:
        rows = drop_late(rows, "observed_at", "arrival_seq", grace=f"{grace_minutes} minutes", chunk=chunk)
    keys = ["station_id", "window_start", "window_end"]
    paired = rates(rows, keys, "arrival_seq", "observed_at", "temperature_celsius")
    zero = F.lit(0.0)
    return paired.groupBy(*keys).agg(
        F.coalesce(F.min("rate_per_hour"), zero).alias("min_rate_of_change"), F.coalesce(F.max("rate_per_hour"), zero).alias("max_rate_of_change"),
        F.coalesce(F.avg("rate_per_hour"), zero).alias("average_rate_of_change"), F.count("rate_per_hour").alias("rate_of_change_count"),
    )


def comfort(obs: DataFrame, regions: DataFrame, year: int | None = 2025, window_hours: int = 24, late: bool = False, grace_minutes: int = 10, chunk: int = 1 << 16) -> DataFrame:
    """A comfort score of 0 to 100 for each region and tumbling window, from readings whose three signals are all usable.

    `late` as in `rapid_change`.
    """
    rows = comfortable(obs, year)
    if late:
        rows = drop_late(tumbling(rows, "observed_at", f"{window_hours} hours"), "observed_at", "arrival_seq", grace=f"{grace_minutes} minutes", chunk=chunk)
    rows = rows.select("station_id", "observed_at", "temperature_celsius", "wind_speed_mps", "sky_clarity_score")
    w = F.window("observed_at", f"{window_hours} hours")
    means = with_region(rows, regions).groupBy("region_id", "region_name", w.alias("w")).agg(
        round_half_up(F.avg("temperature_celsius"), 1).alias("avg_temperature_celsius"), round_half_up(F.avg("wind_speed_mps"), 1).alias("avg_wind_speed_mps"),
        round_half_up(F.avg("sky_clarity_score"), 1).alias("sky_clarity_score"), F.count("*").alias("observation_count"),
    )
    scored = means.withColumn("quality_score", comfort_score(F.col("avg_temperature_celsius"), F.col("avg_wind_speed_mps"), F.col("sky_clarity_score")))
    return scored.select(
        "region_id", "region_name", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "avg_temperature_celsius", "avg_wind_speed_mps",
        "sky_clarity_score", "quality_score", comfort_class(F.col("quality_score")).alias("quality_class"), "observation_count",
    )


def rain_duration(obs: DataFrame, year: int | None = 2025) -> DataFrame:
    """Mean duration of rain of each station and year, over readings that have some."""
    rain = obs.filter(F.col("station_id").isNotNull() & F.col("observation_date").isNotNull() & wet() & in_year("observation_date", year))
    return rain.groupBy("station_id", F.year("observation_date").alias("observation_year")).agg(
        F.avg("rain_duration_hours").alias("avg_duration_hours"), F.count("*").alias("sample_count")
    )


def ranking(obs: DataFrame, year: int = 2025, k: int = 10) -> DataFrame:
    """The k stations with the year's hottest and the k with its coldest readings, ties by station."""
    stats = _temperatures(obs.filter(F.col("observed_at").isNotNull()), year, "observed_at").groupBy("station_id").agg(
        F.avg("temperature_celsius").alias("avg_temperature_celsius"), F.count("*").alias("sample_count"),
        F.min("temperature_celsius").alias("min_temperature_celsius"), F.max("temperature_celsius").alias("max_temperature_celsius"),
    )
    hot = top_k(stats, k, [F.desc("max_temperature_celsius"), F.asc("station_id")]).withColumns({"ranking_type": F.lit("hot"), "peak_temperature_celsius": F.col("max_temperature_celsius")})
    cold = top_k(stats, k, [F.asc("min_temperature_celsius"), F.asc("station_id")]).withColumns({"ranking_type": F.lit("cold"), "peak_temperature_celsius": F.col("min_temperature_celsius")})
    start, end = (F.lit(f"{y}-01-01 00:00:00").cast("timestamp") for y in (year, year + 1))
    return hot.unionByName(cold).select(
        start.alias("window_start"), end.alias("window_end"), "ranking_type", "rank_position", "station_id", "peak_temperature_celsius",
        "avg_temperature_celsius", "sample_count", "min_temperature_celsius", "max_temperature_celsius",
    )


def ranking_nested(ranking: DataFrame) -> DataFrame:
    """One row per window with the hottest and the coldest stations as arrays of structs, and all candidates by station as a map."""
    one = F.struct("rank_position", "station_id", "peak_temperature_celsius", "avg_temperature_celsius", "sample_count", "min_temperature_celsius", "max_temperature_celsius")
    value = F.struct("avg_temperature_celsius", "sample_count", "min_temperature_celsius", "max_temperature_celsius")
    of = {kind: F.array_sort(F.collect_list(F.when(F.col("ranking_type") == kind, one))) for kind in ("hot", "cold")}
    pairs = F.array_distinct(F.collect_list(F.struct("station_id", value.alias("v"))))
    return ranking.groupBy("window_start", "window_end").agg(of["hot"].alias("hottest"), of["cold"].alias("coldest"), F.map_from_entries(pairs).alias("candidates"))


def ranking_rows(nested: DataFrame) -> DataFrame:
    """The arrays of `ranking_nested` as one row for each rank."""
    parts = []
    for kind, column in (("hot", "hottest"), ("cold", "coldest")):
        each = nested.select("window_start", "window_end", F.lit(kind).alias("ranking_type"), F.posexplode(column).alias("_i", "s"))
        parts.append(each.select("window_start", "window_end", "ranking_type", (F.col("_i") + 1).alias("rank_position"), "s.station_id", "s.peak_temperature_celsius"))
    return parts[0].unionByName(parts[1])


def forecast(obs: DataFrame, window_days: int = 30, slide_days: int = 1, ahead_s: int = DAY, late: bool = False, grace_minutes: int = 10, chunk: int = 1 << 16) -> DataFrame:
    """Linear trend of each station over hopping windows, carried on for a day after the window's last reading.

    Sums are made by pane of one slide and added up over the panes of a window. Readings of any quality count.
    With `late`, a reading counts only in those of its windows that were open when it came.
    """
    rows = changing(obs, None)
    rows = rows.withColumn("pane", F.window("observed_at", f"{slide_days} days")["start"])
    if late:
        rows = first_open_window(rows, "observed_at", "arrival_seq", "pane", window_days * DAY, slide_days * DAY, 60 * grace_minutes, chunk)
    panes = pane_sums(rows, ["station_id", *["_open"] * late], "pane", "observed_at", "temperature_celsius")
    held = trends(hopping_from_panes(panes, "pane", window_days * DAY, slide_days * DAY, "_open" if late else None), ["station_id", "window_start", "window_end"], "pane")
    return held.select(
        "station_id", "window_start", "window_end", "slope_per_second", F.col("mean").alias("current_average"),
        (F.col("at_last") + F.col("slope_per_second") * ahead_s).alias("forecast_next_24h"), F.col("n").alias("observation_count"),
    )


def wet_periods(obs: DataFrame, year: int | None = 2025) -> DataFrame:
    """Periods that open with a wet reading of a station and close with its next dry one, in order of arrival."""
    rows = obs.filter(F.col("station_id").isNotNull() & F.col("observed_at").isNotNull() & in_year("observed_at", year))
    found = spells(rows, "station_id", "arrival_seq", "observed_at", wet())
    minutes = F.floor((F.unix_micros("period_end") - F.unix_micros("period_start")) / 60e6)
    return found.select(
        F.concat_ws("-", "station_id", F.date_format("period_start", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("event_key"), "station_id", "period_start", "period_end",
        minutes.cast("long").alias("duration_minutes"), F.col("n_on").alias("precipitation_observation_count"), F.col("period_end").alias("closing_observed_at"),
    )


def blizzards(obs: DataFrame, year: int | None = 2025, window_hours: int = 24, slide_hours: int = 1, freezing: float = 0.0, strong_wind: float = 12.0, late: bool = False, grace_minutes: int = 10, chunk: int = 1 << 16) -> DataFrame:
    """Hopping windows in which a station has freezing, strong wind and precipitation. Evidence is counted by pane of one slide first.

    With `late`, a reading counts only in those of its windows that were open when it came.
    """
    temperature, wind = usable_temperature(), usable_wind()
    rows = stormy(obs, year)
    rows = rows.withColumn("pane", F.window("observed_at", f"{slide_hours} hours")["start"])
    if late:
        rows = first_open_window(rows, "observed_at", "arrival_seq", "pane", window_hours * HOUR, slide_hours * HOUR, 60 * grace_minutes, chunk)
    panes = rows.groupBy("station_id", "pane", *["_open"] * late).agg(
        F.count("*").alias("sample_count"), F.count_if(temperature & (F.col("temperature_celsius") <= freezing)).alias("freezing_observation_count"),
        F.count_if(wind & (F.col("wind_speed_mps") >= strong_wind)).alias("strong_wind_observation_count"), F.count_if(wet()).alias("precipitation_observation_count"),
        F.min(F.when(temperature, F.col("temperature_celsius"))).alias("min_temperature_celsius"), F.max(F.when(wind, F.col("wind_speed_mps"))).alias("max_wind_speed_mps"),
    )
    held = hopping_from_panes(panes, "pane", window_hours * HOUR, slide_hours * HOUR, "_open" if late else None)
    counts = ["sample_count", "freezing_observation_count", "strong_wind_observation_count", "precipitation_observation_count"]
    events = held.groupBy("station_id", "window_start", "window_end").agg(
        *[F.sum(c).alias(c) for c in counts], F.coalesce(F.min("min_temperature_celsius"), F.lit(0.0)).alias("min_temperature_celsius"),
        F.coalesce(F.max("max_wind_speed_mps"), F.lit(0.0)).alias("max_wind_speed_mps"),
    )
    seen = events.filter((F.col(counts[1]) > 0) & (F.col(counts[2]) > 0) & (F.col(counts[3]) > 0))
    return seen.select(
        "station_id", "window_start", "window_end", F.lit("blizzard-like-conditions").alias("event_type"), F.lit(float(freezing)).alias("freezing_threshold_celsius"),
        F.lit(float(strong_wind)).alias("wind_threshold_mps"), *counts, "min_temperature_celsius", "max_wind_speed_mps",
    )


def station_days(obs: DataFrame, year: int | None = 2025) -> DataFrame:
    """Features of each station and day; a signal without usable readings counts as 0, a day without any signal is left out."""
    t, w, c = usable_temperature(), usable_wind(), usable_clarity()
    told = t | w | c | F.col("rain_duration_hours").isNotNull()
    rows = obs.filter(F.col("station_id").isNotNull() & F.col("observation_date").isNotNull() & in_year("observation_date", year) & told)
    temp, wind, clarity = (F.when(ok, F.col(name)) for ok, name in ((t, "temperature_celsius"), (w, "wind_speed_mps"), (c, "sky_clarity_score")))

    def figure(x):
        return F.coalesce(round_half_up(x, 1), F.lit(0.0))

    return rows.groupBy("station_id", "observation_date").agg(
        figure(F.avg(temp)).alias("avg_temperature_celsius"), figure(F.min(temp)).alias("min_temperature_celsius"), figure(F.max(temp)).alias("max_temperature_celsius"),
        figure(F.max(temp) - F.min(temp)).alias("temperature_range_celsius"), figure(F.avg(wind)).alias("avg_wind_speed_mps"), figure(F.greatest(F.max(wind), F.lit(0.0))).alias("max_wind_speed_mps"),
        figure(F.avg(clarity)).alias("sky_clarity_score"), F.count_if(wet()).alias("precipitation_observation_count"),
        F.coalesce(F.sum(F.when(wet(), F.col("rain_duration_hours"))), F.lit(0)).cast("long").alias("rain_duration_hours"), F.count("*").alias("observation_count"),
        F.count(temp).alias("_t"), F.count(wind).alias("_w"), F.count(clarity).alias("_c"),
    ).filter("_t > 0 OR _w > 0 OR _c > 0 OR precipitation_observation_count > 0").drop("_t", "_w", "_c")


def regimes(obs: DataFrame, year: int | None = 2025, clusters: int = 6) -> DataFrame:
    """Each station-day with the archetype that is nearest to it."""
    return by_archetype(station_days(obs, year), clusters)
