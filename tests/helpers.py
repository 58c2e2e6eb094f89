from datetime import date, datetime

from pyspark.sql import DataFrame

from tidemark.schemas import AIS_POSITION, BUOY_OBSERVATION, OBSERVATION

A, B, C, D = "010010-99999", "020020-88888", "030030-77777", "040040-66666"


def at(text: str) -> datetime:
    return datetime.fromisoformat(text)


def readings(spark, *rows) -> DataFrame:
    """Observations from (station, time, fields); arrival is in the order given."""
    out = []
    for i, (station, time, fields) in enumerate(rows):
        moment = at(time)
        row = {"station_id": station, "observation_date": date(moment.year, moment.month, moment.day), "observed_at": moment, "temperature_quality": "1", "wind_quality": "1", "visibility_quality": "1", "source_path": "f", "record_number": i}
        out.append(row | fields | {"arrival_seq": i})
    return spark.createDataFrame(out, OBSERVATION + ", arrival_seq long")


def vessels(spark, *rows) -> DataFrame:
    keys = ("mmsi", "observed_at", "sea_area_id", "reported_eta")
    fixed = {"vessel_name": "v", "latitude": 18.0, "longitude": -65.0, "speed_over_ground_knots": 10.0, "course_over_ground_degrees": 90.0, "destination": None}
    return spark.createDataFrame([fixed | dict(zip(keys, r)) for r in rows], AIS_POSITION)


def buoy_rows(spark, *rows) -> DataFrame:
    keys = ("buoy_id", "observed_at", "sea_area_id", "wave_height_meters", "wind_speed_mps")
    return spark.createDataFrame([{"latitude": 18.0, "longitude": -65.0, "wind_direction_degrees": 0.0} | dict(zip(keys, r)) for r in rows], BUOY_OBSERVATION)


def dicts(df: DataFrame) -> list[dict]:
    return [r.asDict() for r in df.collect()]
