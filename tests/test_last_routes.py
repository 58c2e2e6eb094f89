"""The last recommendation of each vessel and time, made without all pairs."""

from pyspark.sql import functions as F

from tidemark.plans import marine
from tidemark.streaming.sinks import UpsertTable

POSITION = "mmsi string, vessel_name string, observed_at timestamp, latitude double, longitude double, speed_over_ground_knots double, course_over_ground_degrees double, reported_eta timestamp, sea_area_id string"
BUOY = "buoy_id string, observed_at timestamp, sea_area_id string, wave_height_meters double, wind_speed_mps double"


def feeds(spark, n=400):
    i = F.col("id")
    ships = spark.range(n).select(
        F.format_string("%d", i % 7).alias("mmsi"), F.lit("v").alias("vessel_name"), F.timestamp_seconds(i * i * 37 % 40_000 * 0.5).alias("observed_at"), (i * 1.0).alias("latitude"), F.lit(0.0).alias("longitude"),
        F.lit(1.0).alias("speed_over_ground_knots"), F.lit(1.0).alias("course_over_ground_degrees"), F.lit(None).cast("timestamp").alias("reported_eta"), F.format_string("A%d", i % 3).alias("sea_area_id"),
    )
    buoys = spark.range(60).select(F.format_string("%d", i % 5).alias("buoy_id"), F.timestamp_seconds(i % 30 * 600).alias("observed_at"), F.format_string("A%d", i % 3).alias("sea_area_id"), (i % 11 * 1.0).alias("wave_height_meters"), (i % 4 * 1.0).alias("wind_speed_mps"))
    return ships, buoys


def test_as_of_all_pairs(spark):
    ships, buoys = feeds(spark)
    want = marine.routes(marine.route_pairs(ships, buoys, None))
    got = marine.last_routes(ships, buoys, None)
    assert sorted(got.collect(), key=str) == sorted(want.select(*got.columns).collect(), key=str) and 100 < got.count() < 400


def test_readings_that_tie_are_decided_alike(spark):
    """Ends of the interval count; of readings equal in time and buoy it is always the same one that holds, whatever the order of rows."""
    ships, buoys = feeds(spark, 5)
    at = lambda s: F.timestamp_seconds(F.lit(s))
    ships = ships.withColumns({"observed_at": at(10_000), "sea_area_id": F.lit("A")})
    ties = buoys.withColumns({"observed_at": at(11_800), "sea_area_id": F.lit("A"), "buoy_id": F.lit("b")})
    late = ties.withColumns({"observed_at": at(11_801)})
    answers = {tuple(sorted((r.event_key, r.wave_height_meters, r.wind_speed_mps, r.latitude) for r in f(rows).collect())) for rows in (ties, ties.orderBy(F.desc("wave_height_meters")).repartition(3)) for f in (lambda b: marine.last_routes(ships, b.union(late), None), lambda b: marine.routes(marine.route_pairs(ships, b.union(late), None)))}
    assert len(answers) == 1 and len(next(iter(answers))) == 5


def test_the_first_position_of_a_second_holds(spark, tmp_path):
    """Of two positions of a vessel within one second that meet the same reading the first one counts, in batches and in tables of streams."""
    ships, buoys = feeds(spark, 2)
    ships = ships.withColumns({"mmsi": F.lit("m"), "observed_at": F.timestamp_micros(F.lit(10_000_100_000) + F.col("latitude").cast("long") * 500_000), "sea_area_id": F.lit("A")})
    buoys = buoys.limit(1).withColumns({"observed_at": F.timestamp_seconds(F.lit(10_060)), "sea_area_id": F.lit("A")})
    pairs = marine.route_pairs(ships, buoys, None)
    table = UpsertTable(str(tmp_path / "t"), ["event_key"], marine.last_order())
    for i, second in enumerate((1.0, 0.0)):
        table.write(marine.latest_routes(pairs.filter(F.col("latitude") == second)), i)
    assert pairs.count() == 2
    for got in (marine.last_routes(ships, buoys, None), marine.routes(pairs), table.read(spark)):
        assert [r.latitude for r in got.collect()] == [0.0]


def test_pairs_are_not_made(spark):
    plan = marine.last_routes(*feeds(spark), None)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
