"""The analyses over streams of observations, and all selected ones together.

Filters, windows and aggregates run as they are. Windowed ones get a watermark, which drops what comes later than the grace after
the stream's greatest time; Spark moves it between micro-batches, so it drops less than `operators.windows.drop_late` does. With
`grace_by_record`, lateness is told record by record by a query of its own before (`stream_time.InTime`), as in batch.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from ..config import Config
from ..functions.quality import in_year, usable_temperature, usable_wind, wet
from ..operators.regimes import MicroClusters
from ..operators.saved import files, settings
from ..operators.windows import drop_late, first_open_window, tumbling
from ..plans import marine, weather
from ..schemas import KEYS
from .nearest import latest_within_stream
from .panes import hopping_stream, joined
from .processors import rapid_change_stream, wet_periods_stream
from .ranking import ranking_stream
from .sinks import CounterTable, UpsertTable
from .stream_time import InTime, Keep

STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def graced(df: DataFrame, ts: str, minutes: int) -> DataFrame:
    return df.withWatermark(ts, f"{minutes} minutes")


def comfort_stream(obs: DataFrame, regions: DataFrame, c: Config) -> DataFrame:
    return weather.comfort(graced(obs, "observed_at", c.tourism_quality_grace_minutes), regions, c.tourism_quality_year, c.tourism_quality_window_hours)


#: What a pane of an hour keeps for blizzards, and one of a day for forecasts.
EVIDENCE = [("sample_count", "long", "sum"), ("freezing", "long", "sum"), ("strong_wind", "long", "sum"), ("precipitation", "long", "sum"), ("low", "double", "min"), ("wind", "double", "max")]
TREND = [("n", "long", "sum"), ("sx", "long", "sum"), ("sy", "double", "sum"), ("sxy", "double", "sum"), ("sxx", "decimal(38,0)", "sum"), ("last_us", "long", "max")]


def blizzard_figures(panes: pa.Table, begins: np.ndarray) -> tuple[np.ndarray, list]:
    counts = [np.add.reduceat(panes[n].to_numpy(), begins) for n, _, _ in EVIDENCE[:4]]
    which = np.flatnonzero(np.minimum.reduce(counts[1:]) > 0)
    low, wind = (how.reduceat(pc.fill_null(panes[n], none).to_numpy(), begins).take(which) for n, how, none in (("low", np.minimum, np.inf), ("wind", np.maximum, -np.inf)))
    return which, [*(c.take(which) for c in counts), np.where(low == np.inf, 0.0, low), np.where(wind == -np.inf, 0.0, wind)]


def trend_figures(panes: list[tuple[int, list]]) -> tuple:
    """As `operators.regression.trends`: microseconds from the first pane, sums about the means, so that readings a moment apart stay apart."""
    origin, n, sx, sy, cxy, cxx, last = panes[0][0], 0, 0, 0.0, 0.0, 0.0, 0
    for pane, (m, x, y, xy, xx, us) in panes:
        cxy, cxx = cxy + (m * xy - x * y) / m, cxx + (m * int(xx) - x * x) / m  # x and xx are whole numbers
        x += m * (pane - origin)
        if n:
            dx, dy, weight = (n * x - m * sx) / (n * m), y / m - sy / n, n * m / (n + m)
            cxy, cxx = cxy + dx * dy * weight, cxx + dx * dx * weight
        n, sx, sy, last = n + m, sx + x, sy + y, max(last, us)
    slope = cxy / cxx * 1e6 if n > 1 and cxx else 0.0
    return slope, sy / n, sy / n + slope * ((last - origin - sx / n) / 1e6) + slope * weather.DAY, n


def trends_figures(panes: pa.Table, begins: np.ndarray) -> tuple[np.ndarray, list]:
    rows = list(zip(panes["pane"].to_pylist(), zip(*(panes[n].to_pylist() for n, _, _ in TREND))))
    told = [trend_figures(rows[a:b]) for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(rows)])]
    return np.arange(len(told)), list(zip(*told))


def blizzards_stream(obs: DataFrame, c: Config) -> DataFrame:
    """By panes of an advance, see `panes`. Needs the RocksDB state store."""
    t, w = usable_temperature(), usable_wind()
    columns = {
        "sample_count": F.lit(1).cast("long"), "freezing": (t & (F.col("temperature_celsius") <= c.blizzard_freezing_threshold_c)).cast("long"),
        "strong_wind": (w & (F.col("wind_speed_mps") >= c.blizzard_wind_threshold_mps)).cast("long"), "precipitation": wet().cast("long"),
        "low": F.when(t, F.col("temperature_celsius")), "wind": F.when(w, F.col("wind_speed_mps")),
    }
    columns = {k: F.coalesce(v, F.lit(0).cast("long")) if k in ("freezing", "strong_wind") else v for k, v in columns.items()}
    told = "sample_count long, freezing_observation_count long, strong_wind_observation_count long, precipitation_observation_count long, min_temperature_celsius double, max_wind_speed_mps double"
    return hopping_stream(weather.stormy(obs, c.blizzard_year), "station_id", "observed_at", columns, EVIDENCE, c.blizzard_window_hours * weather.HOUR, c.blizzard_advance_hours * weather.HOUR, 60 * c.blizzard_grace_minutes, blizzard_figures, told)


def forecast_stream(obs: DataFrame, c: Config) -> DataFrame:
    """By panes of an advance, whose sums are those of `operators.regression.pane_sums`. Needs the RocksDB state store."""
    us, slide = F.unix_micros("observed_at"), c.forecast_advance_days * weather.DAY
    x, y = F.pmod(us, F.lit(slide * 1_000_000)), F.col("temperature_celsius")
    whole = x.cast("decimal(19,0)")  # squares of microseconds are more than a double or a long holds
    columns = {"n": F.lit(1).cast("long"), "sx": x, "sy": y, "sxy": x * y, "sxx": (whole * whole).cast("decimal(38,0)"), "last_us": us}
    told = "slope_per_second double, current_average double, forecast_next_24h double, observation_count long"
    return hopping_stream(weather.changing(obs, None), "station_id", "observed_at", columns, TREND, c.forecast_window_days * weather.DAY, slide, 60 * c.forecast_grace_minutes, trends_figures, told)


#: Numbers of one range, as `operators.ordered.numbered` gives them.
RANGE = 1 << 33


def lateness(c: Config) -> dict[str, tuple[Callable[[DataFrame], DataFrame], Keep]]:
    """Of each analysis with a grace, the readings that it looks at, and what is in time of them."""

    def tumbling_in_time(hours: int, minutes: int) -> Keep:
        def keep(rows: DataFrame, order: str, since: datetime | None) -> DataFrame:
            return drop_late(tumbling(rows, "observed_at", f"{hours} hours"), "observed_at", order, grace=f"{minutes} minutes", chunk=RANGE, since=since).drop("window_start", "window_end")

        return keep

    def hopping_in_time(size: int, slide: int, minutes: int) -> Keep:
        def keep(rows: DataFrame, order: str, since: datetime | None) -> DataFrame:
            rows = rows.withColumn("pane", F.window("observed_at", f"{slide} seconds")["start"])
            return first_open_window(rows, "observed_at", order, "pane", size, slide, 60 * minutes, RANGE, since).drop("pane")

        return keep

    return {
        "blizzard": (lambda obs: weather.stormy(obs, c.blizzard_year), hopping_in_time(c.blizzard_window_hours * weather.HOUR, c.blizzard_advance_hours * weather.HOUR, c.blizzard_grace_minutes)),
        "rapid-temperature-change": (lambda obs: weather.changing(obs, c.rapid_change_year), tumbling_in_time(c.rapid_change_window_hours, c.rapid_change_grace_minutes)),
        "tourism-weather-quality": (lambda obs: weather.comfortable(obs, c.tourism_quality_year), tumbling_in_time(c.tourism_quality_window_hours, c.tourism_quality_grace_minutes)),
        "temperature-forecast": (lambda obs: weather.changing(obs, None), hopping_in_time(c.forecast_window_days * weather.DAY, c.forecast_advance_days * weather.DAY, c.forecast_grace_minutes)),
    }


def routes_stream(positions: DataFrame, buoys: DataFrame, c: Config, counted: bool = False) -> DataFrame:
    """A position's recommendation by the latest reading of its interval, told again when a later one has come; `UpsertTable` keeps one
    for each vessel and time. Pairs are not made: `counted` gives their number, as n_pairs. State is held for the interval alone."""
    m = c.maritime_routing_join_window_minutes
    a = positions.filter(in_year("observed_at", c.maritime_routing_year))
    b = marine.buoy_side(buoys.filter(in_year("observed_at", c.maritime_routing_year)))
    met = latest_within_stream(a, b, "sea_area_id", "observed_at", "buoy_observed_at", 60 * m, ["buoy_id", "wave_height_meters", "wind_speed_mps"])
    return marine.recommend(marine.around(met, m), c.wave_weight, *["n_pairs"] * counted)


def result_tables(out: str, c: Config) -> dict[str, UpsertTable]:
    """The result tables of a configuration. They lie beside its progress, under its own id, so that a run with other settings
    neither reads nor adds to what this one has written."""
    order = {"marine_route_recommendations": marine.last_order()}
    return {name: UpsertTable(f"{out}/{c.progress_id()}/{name}", keys, order.get(name, [])) for name, keys in KEYS.items()}


def counters(out: str, c: Config) -> CounterTable:
    return CounterTable(f"{out}/{c.progress_id()}/stream_counts")


def clear(spark: SparkSession, out: str, c: Config) -> None:
    """Take away all that runs of these settings have left, tables and progress: the next one starts from the beginning."""
    fs, at = files(spark, f"{out}/{c.progress_id()}")
    fs.delete(at, True)


class LearnedRegimes:
    """Micro-clusters that outlive the driver: what was learned up to a micro-batch is kept under the batch's id.

    A station-day is learned once, when the first reading of a later day has come: until then its features still change. A batch
    that runs again starts from what the batch before it left, and so learns the same.
    """

    def __init__(self, path: str, days: UpsertTable, k: int, horizon: float):
        self.path, self.days, self.k, self.horizon = path, days, k, horizon

    def _before(self, spark: SparkSession, batch_id: int) -> tuple[MicroClusters, date | None]:
        model, upto = MicroClusters(self.k, self.horizon), None
        if batch_id:
            kept = spark.read.schema("batch_id long, stats string, upto date").parquet(self.path).filter(F.col("batch_id") < batch_id)
            last = kept.orderBy(F.desc("batch_id")).first()
            if last:
                model.load(last["stats"])
                upto = last["upto"]
        return model, upto

    def read(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """What a batch has written."""
        return spark.read.parquet(f"{self.days.path}/batch_id={batch_id}").drop("updated_at")

    def write(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        model, upto = self._before(spark, batch_id)
        batch = batch.persist()
        self.days.write(model.assign(batch), batch_id)
        newest = batch.agg(F.max("observation_date").alias("d")).first()["d"]
        batch.unpersist()
        if newest and (upto is None or newest > upto):
            finished = self.days.read(spark, batch_id).filter(F.col("observation_date") < F.lit(newest))
            if upto:
                finished = finished.filter(F.col("observation_date") >= F.lit(upto))
            model.update(finished)
            upto = newest
        kept = spark.createDataFrame([(model.dump(), upto)], "stats string, upto date")
        kept.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batch_id={batch_id}")


def start(obs: DataFrame | Callable[[str], DataFrame], regions: DataFrame, out: str, c: Config, positions: DataFrame | None = None, buoys: DataFrame | None = None, trigger: dict | None = None, publish: Callable[[str, DataFrame], None] | None = None) -> list[StreamingQuery]:
    """Start the selected analyses over streaming observations (with arrival_seq) and marine feeds; results go to `result_tables(out, c)`, and to `publish`, table by table and batch by batch, where that is given (`messages.publisher`).

    Checkpoints and tables lie under the configuration's own id: with other settings, analyses start from the beginning. A source that
    notes its own progress must not be shared: `obs` may be a function that makes the observations of the analysis it is given.
    """
    feed = obs if callable(obs) else lambda name: obs
    spark = regions.sparkSession
    home, tables, counts, trigger = f"{out}/{c.progress_id()}", result_tables(out, c), counters(out, c), trigger or {"availableNow": True}
    learned = LearnedRegimes(f"{home}/regime_model", tables["weather_regimes"], c.weather_regime_cluster_count, c.weather_regime_horizon)

    def run(name: str, stream: DataFrame, mode: str, sink: Callable[[DataFrame, int], None]) -> StreamingQuery:
        return stream.writeStream.outputMode(mode).option("checkpointLocation", f"{home}/progress/{name}").foreachBatch(sink).trigger(**trigger).queryName(name).start()

    def upsert(table: str, kind: str | None = None, change: Callable[[DataFrame], DataFrame] = lambda b: b, number: Column | None = None) -> Callable[[DataFrame, int], None]:
        target = tables[table]

        def write(batch: DataFrame, batch_id: int) -> None:
            if not c.dashboard_sink_enabled and not publish:
                if kind:
                    counts.write(kind, batch, batch_id, number)
                return
            with counts.observed(kind, batch, batch_id, number) as rows:
                rows = change(rows)
                both = bool(c.dashboard_sink_enabled and publish)
                rows = rows.persist() if both else rows  # a micro-batch is worked out once, stateful Python and all
                if c.dashboard_sink_enabled:
                    target.write(rows, batch_id)
                if publish:
                    publish(table, rows)
                if both:
                    rows.unpersist()

        return write

    def regimes(batch: DataFrame, batch_id: int) -> None:
        with counts.observed("weather_regime_events", batch, batch_id) as rows:
            if c.dashboard_sink_enabled or publish:
                learned.write(rows, batch_id)
            else:
                rows.write.format("noop").mode("overwrite").save()
        if publish:
            publish("weather_regimes", learned.read(batch.sparkSession, batch_id))

    timed, first = lateness(c), []

    def in_time(name: str) -> DataFrame:
        """The readings of an analysis, those that come too late left out record by record where that is asked for."""
        if not c.grace_by_record:
            return feed(name)
        seen, keep = timed[name]
        stage = InTime(f"{home}/in_time/{name}", "observed_at", "arrival_seq", keep)
        rows = seen(feed(f"{name}-in-time")).drop("raw_payload")
        query = stage.sink(rows, f"{home}/progress/{name}-in-time").trigger(**trigger).queryName(f"{name}-in-time").start()
        first.append(query)
        if "availableNow" in trigger:  # what follows takes up what is there when it starts
            query.awaitTermination()
        columns = StructType([*rows.schema.fields, *[StructField("_open", LongType())] * (name in ("blizzard", "temperature-forecast"))])
        return stage.stream(spark, columns)

    made: dict[str, Callable[[], tuple[DataFrame, str, Callable[[DataFrame, int], None]]]] = {
        "temperature": lambda: (weather.daily_average(feed("temperature")), "update", upsert("daily_station_average")),
        "rain-duration": lambda: (weather.rain_duration(feed("rain-duration"), c.rain_duration_year), "update", upsert("yearly_station_rain_duration")),
        "frost-days": lambda: (weather.frost_days(feed("frost-days"), c.frost_count_year), "update", upsert("monthly_station_frost_days")),
        "temperature-ranking": lambda: (ranking_stream(feed("temperature-ranking"), c.temperature_ranking_year), "append", upsert("temperature_window_ranking")),
        "blizzard": lambda: (blizzards_stream(in_time("blizzard"), c), "update", upsert("blizzard_events")),
        "rapid-temperature-change": lambda: (rapid_change_stream(in_time("rapid-temperature-change"), c.rapid_change_year, c.rapid_change_window_hours, c.rapid_change_grace_minutes), "update", upsert("rapid_temperature_change")),
        "tourism-weather-quality": lambda: (comfort_stream(in_time("tourism-weather-quality"), regions, c), "update", upsert("tourism_weather_quality")),
        "temperature-forecast": lambda: (forecast_stream(in_time("temperature-forecast"), c), "update", upsert("temperature_forecast")),
        "wet-dry-period": lambda: (wet_periods_stream(feed("wet-dry-period"), c.wet_dry_period_year), "append", upsert("wet_period_events", "wet_period_events")),
        "weather-regimes": lambda: (weather.station_days(feed("weather-regimes"), c.weather_regime_year), "update", regimes),
        "maritime-routing": lambda: (routes_stream(positions, buoys, c, True), "append", upsert("marine_route_recommendations", "marine_route_recommendations", lambda b: marine.latest_routes(b.drop("n_pairs")), F.coalesce(F.sum("n_pairs"), F.lit(0).cast("long")))),
    }
    chosen = [n for n in c.stream_pattern if n != "maritime-routing" or (positions is not None and buoys is not None)]
    with settings(spark, **{STATE_STORE[0].replace(".", "__"): STATE_STORE[1]}):
        return [run(name, *made[name]()) for name in chosen] + first
