"""Weather regimes: archetypes and micro-clusters over station-days."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import distance, round_half_up, to_unit

#: Feature columns and the range that is scaled to [0, 1]. Fixed values.
FEATURES = {
    "avg_temperature_celsius": (-30.0, 45.0),
    "temperature_range_celsius": (0.0, 35.0),
    "avg_wind_speed_mps": (0.0, 25.0),
    "max_wind_speed_mps": (0.0, 40.0),
    "sky_clarity_score": (0.0, 100.0),
    "rain_duration_hours": (0.0, 24.0),
}
# Archetypes in the units of FEATURES.
ARCHETYPES = {
    "cold_windy_wet": (-8.0, 8.0, 9.0, 16.0, 35.0, 9.0),
    "cold_windy_clear": (-5.0, 6.0, 2.0, 5.0, 85.0, 0.0),
    "mild_wet": (9.0, 7.0, 4.0, 8.0, 45.0, 8.0),
    "mild_clear_breezy": (15.0, 9.0, 5.0, 11.0, 80.0, 1.0),
    "hot_dry_clear": (28.0, 12.0, 3.0, 7.0, 90.0, 0.0),
    "volatile_windy": (12.0, 20.0, 12.0, 24.0, 55.0, 3.0),
}


def unit_features() -> list[Column]:
    return [to_unit(F.col(c).cast("double"), low, high) for c, (low, high) in FEATURES.items()]


def unit_archetypes(k: int = len(ARCHETYPES)) -> list[list[float]]:
    ranges = list(FEATURES.values())
    return [[min(max((v - a) / (b - a), 0.0), 1.0) for v, (a, b) in zip(p, ranges)] for p in list(ARCHETYPES.values())[:k]]


def with_nearest(days: DataFrame, centres: list[list[float]]) -> DataFrame:
    """`days` with _i and _far, index and distance of the nearest centre, the first one of those that tie, and _u0, ...: the scaled
    features. Steps of their own, so that what is used several times is worked out once."""
    units = [f"_u{i}" for i in range(len(FEATURES))]
    rows = days.withColumns(dict(zip(units, unit_features())))
    rows = rows.withColumn("_d", F.array(*[distance([F.col(u) for u in units], c) for c in centres]))
    rows = rows.withColumn("_far", F.array_min("_d"))
    return rows.withColumn("_i", (F.array_position("_d", F.col("_far")) - 1).cast("int")).drop("_d")


def _labelled(days: DataFrame, centres: list[list[float]], labels: list[str]) -> DataFrame:
    rows = with_nearest(days, centres)
    label = F.get(F.array(*[F.lit(x) for x in labels]), F.col("_i"))
    return rows.select(*days.columns, F.col("_i").alias("cluster_id"), label.alias("cluster_label"), round_half_up(F.col("_far"), 3).alias("distance_to_center"))


def by_archetype(days: DataFrame, k: int = len(ARCHETYPES)) -> DataFrame:
    """cluster_id, cluster_label, distance_to_center by the nearest archetype: what is told while nothing has been learned."""
    return _labelled(days, unit_archetypes(k), list(ARCHETYPES)[:k])


def added(a: dict, b: dict) -> dict:
    """One cluster of two."""
    return {k: max(a[k], b[k]) if k == "last" else sorted({*a[k], *b[k]}) if k == "ids" else a[k] + b[k] for k in a}


def _sums(rows: DataFrame, at: str) -> dict[int, dict]:
    """n, sums and sums of squares by _new; rows have the scaled features _u0, ... There are twice as many groups as clusters at most."""
    d = len(FEATURES)
    day = F.unix_seconds(F.col(at).cast("timestamp")) / 86400.0
    units = [F.col(f"_u{i}") for i in range(d)]
    sums = [F.sum(u).alias(f"l{i}") for i, u in enumerate(units)] + [F.sum(u * u).alias(f"s{i}") for i, u in enumerate(units)]
    found = rows.groupBy(F.col("_new").alias("g")).agg(F.count("*").alias("n"), F.sum(day).alias("lt"), F.sum(day * day).alias("st"), F.max(day).alias("last"), *sums)
    return {r["g"]: {"n": r["n"], "lt": r["lt"], "st": r["st"], "last": r["last"], "ls": np.array([r[f"l{i}"] for i in range(d)]), "ss": np.array([r[f"s{i}"] for i in range(d)])} for r in found.collect()}


@dataclass
class MicroClusters:
    """Micro-clusters (n, sums and sums of squares of the features and of time), after Aggarwal et al., "A Framework for Clustering
    Evolving Data Streams", learned by slices of time.

    The first slice is clustered by k-means from the archetypes, a step of it one aggregation over the slice. After that, sums of a
    slice's rows by nearest cluster are one aggregation, so rows stay in their tasks and the driver holds k clusters. Rows outside a
    cluster's reach found new ones: they are summed by nearest archetype, and where that makes more than k clusters, the one goes whose
    relevance stamp is more than `horizon` time units behind, or else the nearest two become one.

    A cluster has an id, or several after it has taken up others, so that `operators.snapshots` can take an earlier state from it.
    """

    k: int = len(ARCHETYPES)
    horizon: float = 10_000.0
    reach: float = 2.0
    least_radius: float = 0.05
    last_points: int = 100
    rounds: int = 20
    stats: list[dict] = field(default_factory=list)
    next_id: int = 0

    def dump(self) -> str:
        """All that has been learned, as JSON."""
        return json.dumps([{k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in s.items()} for s in self.stats])

    def load(self, text: str) -> None:
        self.stats = [{k: np.array(v) if k in ("ls", "ss") else v for k, v in s.items()} for s in json.loads(text)]
        self.next_id = max((i + 1 for s in self.stats for i in s["ids"]), default=0)

    def centres(self) -> list[list[float]]:
        return [(s["ls"] / s["n"]).tolist() for s in self.stats]

    def _radius(self, i: int) -> float:
        s = self.stats[i]
        spread = np.maximum(s["ss"] / s["n"] - (s["ls"] / s["n"]) ** 2, 0).sum()
        return max(self.reach * float(np.sqrt(spread)), self.least_radius)

    def relevance(self, s: dict) -> float:
        """About the middle time of a cluster's last `last_points` rows, as if its times were normal: their m / 2n-th percentile from above.

        A cluster of fewer than twice as many rows has its mean time.
        """
        mean = s["lt"] / s["n"]
        if s["n"] < 2 * self.last_points:
            return mean
        spread = math.sqrt(max(s["st"] / s["n"] - mean * mean, 0.0))
        return mean + spread * NormalDist().inv_cdf(1 - self.last_points / (2 * s["n"]))

    def _found(self, s: dict) -> dict:
        self.next_id += 1
        return s | {"ids": [self.next_id - 1]}

    def start(self, days: DataFrame, at: str = "observation_date") -> None:
        """Clusters of a first slice by k-means from the archetypes, until no centre moves; ones without rows are left out."""
        centres, sums = unit_archetypes(self.k), {}
        for _ in range(self.rounds):
            sums = _sums(with_nearest(days, centres).withColumn("_new", F.col("_i")), at)
            moved = [(sums[i]["ls"] / sums[i]["n"]).tolist() if i in sums else c for i, c in enumerate(centres)]
            still = np.allclose(moved, centres, rtol=0, atol=1e-12)
            centres = moved
            if still:
                break
        self.stats = [self._found(sums[i]) for i in sorted(sums)]

    def update(self, days: DataFrame, at: str = "observation_date") -> None:
        """Learn from a slice, a DataFrame with FEATURES and a date or time."""
        if not self.stats:
            return self.start(days, at)
        known = self.centres()
        rows = with_nearest(days, unit_archetypes()).withColumn("_new", F.col("_i") + len(known))
        rows = with_nearest(rows.drop("_i", "_far"), known)
        radius = F.get(F.array(*[F.lit(self._radius(i)) for i in range(len(known))]), F.col("_i"))
        rows = rows.withColumn("_new", F.when(F.col("_far") <= radius, F.col("_i")).otherwise(F.col("_new")))
        now = None
        for g, s in sorted(_sums(rows, at).items()):
            now = s["last"] if now is None else max(now, s["last"])
            if g < len(known):
                self.stats[g] = added(self.stats[g], s | {"ids": []})
            else:
                self.stats.append(self._found(s))
        while len(self.stats) > self.k:
            self._shrink(now)

    def _shrink(self, now: float) -> None:
        stamps = [self.relevance(s) for s in self.stats]
        if min(stamps) < now - self.horizon:
            self.stats.pop(stamps.index(min(stamps)))
            return
        c = np.array(self.centres())
        far = ((c[:, None] - c[None]) ** 2).sum(2)
        far[np.tril_indices(len(c))] = np.inf
        i, j = np.unravel_index(int(far.argmin()), far.shape)
        b = self.stats.pop(int(j))
        self.stats[int(i)] = added(self.stats[int(i)], b)

    def assign(self, days: DataFrame) -> DataFrame:
        """cluster_id, cluster_label (that of the archetype nearest to the cluster's centre) and distance_to_center."""
        if not self.stats:
            return by_archetype(days, self.k)
        centres = self.centres()
        archetypes = np.array(unit_archetypes(self.k))
        names = [list(ARCHETYPES)[int(((archetypes - np.array(c)) ** 2).sum(1).argmin())] for c in centres]
        return _labelled(days, centres, names)
