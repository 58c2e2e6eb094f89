"""Run the selected analyses over a landing folder: python -m tidemark LANDING STATIONS OUT [AIS BUOYS]

LANDING holds weather files (.gz, .zst or plain) whose names fit one of FILE_GLOB's patterns, STATIONS is the station history list,
OUT gets the result tables, under the settings' id. AIS is a folder of vessel day files (.csv, .csv.zst) and BUOYS one of standard
meteorological tables; BUOY_STATIONS names the buoys, as id:area:latitude:longitude with commas between, and MARINE_DAYS
(first:last) the days that count. Without BUOY_STATIONS both are folders of Parquet files. Settings come from the environment, see
`config.Config`; with RUN_ONCE=false the streams go on and look for new files every POLL_SECONDS. With BATCH_BYTES, weather files are taken up by so much text
at a time, also in parts. PUBLISH_SERVERS and PUBLISH_TOPICS (table=topic with commas between) send result rows to a broker. GRACE_BY_RECORD
tells lateness record by record. CLEAR_TABLES starts anew, without what earlier runs of the same settings have left.
"""

from __future__ import annotations

import os
import sys
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .config import Config, boolean
from .schemas import AIS_POSITION, BUOY_OBSERVATION
from .sources import files, stations, weather
from .sources.marine import buoys_stream, positions_stream, station_places
from .sources.messages import publisher
from .streaming.runners import STATE_STORE, clear, start


def main(landing: str, station_list: str, out: str, ais: str | None = None, buoys: str | None = None) -> None:
    config = Config.from_env()
    spark = SparkSession.builder.appName(config.progress_id()).config("spark.sql.session.timeZone", "UTC").config(*STATE_STORE).getOrCreate()
    if boolean(os.environ.get("CLEAR_TABLES") or "false"):
        clear(spark, out, config)
    batch_bytes = int(os.environ.get("BATCH_BYTES") or 0)

    def obs(analysis: str) -> DataFrame:
        """Files of a micro-batch in order of their names, and a file's records in theirs."""
        if batch_bytes:
            lines = files.resumable_lines_stream(spark, landing, f"{out}/{config.progress_id()}/feeds/{analysis}", config.file_glob or None, batch_bytes)
        else:
            lines = files.lines_stream(spark, landing, config.file_glob or None, int(os.environ.get("MAX_FILES_PER_POLL") or 100))
        return weather.observations(weather.envelopes(lines)).withColumn("arrival_seq", F.struct("source_path", "record_number"))

    send = publisher(os.environ["PUBLISH_SERVERS"], dict(t.split("=") for t in os.environ["PUBLISH_TOPICS"].split(","))) if os.environ.get("PUBLISH_SERVERS") else None
    listed = files.lines(spark, station_list)
    stations.metadata(listed).write.mode("overwrite").parquet(f"{out}/{config.progress_id()}/station_metadata/batch_id=0")
    trigger = {"availableNow": True} if boolean(os.environ.get("RUN_ONCE") or "true") else {"processingTime": f"{os.environ.get('POLL_SECONDS') or 86400} seconds"}
    days = config.marine_days
    between = tuple(date.fromisoformat(d) for d in days.split(":")) if days else None
    if config.buoy_stations and ais and buoys:
        at = station_places(spark, config.buoy_stations)
        feeds = (positions_stream(spark, ais, days=between), buoys_stream(spark, buoys, at, between))
        return run(start(obs, stations.regions(listed), out, config, *feeds, trigger=trigger, publish=send))
    marine = [spark.readStream.schema(s).parquet(p) for s, p in ((AIS_POSITION, ais), (BUOY_OBSERVATION, buoys)) if p]
    run(start(obs, stations.regions(listed), out, config, *(marine if len(marine) == 2 else (None, None)), trigger=trigger, publish=send))


def run(queries: list[StreamingQuery]) -> None:
    for query in queries:
        query.awaitTermination()


if __name__ == "__main__":
    main(*sys.argv[1:])
