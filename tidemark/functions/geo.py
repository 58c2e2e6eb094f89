"""Points in named boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Name, least and greatest latitude, least and greatest longitude. Boxes overlap, the first that fits counts.
SEA_AREAS = [
    ("BAHAMAS_NORTH", 25.0, 29.0, -74.0, -69.0),
    ("BAHAMAS_EAST", 22.5, 25.5, -70.5, -66.5),
    ("CARIB_PR_SOUTH", 17.5, 18.2, -67.6, -65.7),
    ("CARIB_PR_WEST", 17.8, 19.2, -68.4, -66.7),
    ("CARIB_PR_NORTH", 18.0, 21.5, -66.9, -64.4),
    ("CARIB_USVI", 17.2, 19.0, -65.4, -64.0),
    ("CARIB_EAST", 15.5, 17.5, -64.2, -62.5),
    ("CARIB_CENTRAL", 13.0, 17.5, -77.0, -70.0),
    ("CARIB_WEST", 16.0, 21.5, -86.5, -80.0),
]


def first_box(lat: Column, lon: Column, boxes: list[tuple[str, float, float, float, float]] = SEA_AREAS) -> Column:
    """Name of the first box that holds the point, edges included; null if none does. A few boxes are one CASE, no join."""
    found = [F.when(lat.between(a, b) & lon.between(c, d), name) for name, a, b, c, d in boxes]
    return F.coalesce(*found)
