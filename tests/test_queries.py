"""Each query over the driver's small tables against its SQL in DuckDB."""

import math
import os
from datetime import date, datetime
from decimal import Decimal

import pytest

from tidemark.queries.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, (int, float, Decimal)):
        return None if isinstance(v, float) and math.isnan(v) else float(v) + 0.0
    if isinstance(v, datetime):
        return v.isoformat()
    return v.isoformat() if isinstance(v, date) else v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events".split():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, duck, name):
    got, want = QUERIES[name](spark, SF), duck.sql(ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got.columns, got.collect()) == rows_of(want.columns, want.fetchall())


def test_every_panel_and_table_has_sql():
    assert set(QUERIES) - set(ORACLE) == {"regime_clusters"}


def replayed_regimes(days, k=6, reach=2.0, least=0.05, horizon=10_000):
    """The same learning by weeks, with each cluster's members at hand instead of sums."""
    import numpy as np

    from tidemark.operators.regimes import ARCHETYPES, FEATURES

    unit = lambda row: np.array([min(max((float(v) - a) / (b - a), 0.0), 1.0) for v, (a, b) in zip(row, FEATURES.values())])
    shapes = [unit(v) for v in ARCHETYPES.values()]
    nearest = lambda p, centres: min(range(len(centres)), key=lambda i: np.linalg.norm(p - centres[i]))
    points = [(r.observation_date, unit([r[c] for c in FEATURES])) for r in days]
    first, clusters = min(d for d, _ in points), []  # a cluster: its members and the last day of one
    for week in range(0, (max(d for d, _ in points) - first).days + 1, 7):
        slice_ = [(d, p) for d, p in points if week <= (d - first).days <= week + 6]
        if not clusters:  # k-means from the archetypes
            centres, before = shapes, None
            while before is None or any(np.abs(a - b).max() > 1e-12 for a, b in zip(centres, before)):
                own = [nearest(p, centres) for _, p in slice_]
                before, centres = centres, [np.mean([p for o, (_, p) in zip(own, slice_) if o == i], axis=0) if i in own else c for i, c in enumerate(centres)]
            own = [nearest(p, before) for _, p in slice_]
            clusters = [([p for o, (_, p) in zip(own, slice_) if o == i], max(d for o, (d, _) in zip(own, slice_) if o == i)) for i in sorted(set(own))]
            continue
        centres = [np.mean(m, axis=0) for m, _ in clusters]
        radius = [max(reach * math.sqrt(np.var(m, axis=0).sum()), least) for m, _ in clusters]
        fed = {}
        for d, p in points:
            if week <= (d - first).days <= week + 6:
                at = nearest(p, centres) if clusters else None
                own = at if at is not None and np.linalg.norm(p - centres[at]) <= radius[at] else len(clusters) + nearest(p, shapes)
                fed.setdefault(own, []).append((d, p))
        known = len(clusters)
        for own in sorted(fed):
            d, p = max(d for d, _ in fed[own]), [p for _, p in fed[own]]
            if own < known:
                clusters[own] = (clusters[own][0] + p, max(clusters[own][1], d))
            else:
                clusters.append((p, d))
        now = max((d for rows in fed.values() for d, _ in rows), default=None)
        while len(clusters) > k:
            stale = [i for i, (_, last) in enumerate(clusters) if (now - last).days > horizon]
            if stale:
                clusters.pop(min(stale, key=lambda i: clusters[i][1]))
                continue
            c = [np.mean(m, axis=0) for m, _ in clusters]
            i, j = min(((i, j) for i in range(len(c)) for j in range(i + 1, len(c))), key=lambda x: ((c[x[0]] - c[x[1]]) ** 2).sum())
            m, last = clusters.pop(j)
            clusters[i] = (clusters[i][0] + m, max(clusters[i][1], last))
    centres = [np.mean(m, axis=0) for m, _ in clusters]
    names = [list(ARCHETYPES)[nearest(c, shapes)] for c in centres]
    return {(r.station_id, r.observation_date): (i := nearest(unit([r[c] for c in FEATURES]), centres), names[i], np.linalg.norm(unit([r[c] for c in FEATURES]) - centres[i])) for r in days}


def test_regime_clusters(spark):
    got, want = QUERIES["regime_clusters"](spark, SF).collect(), replayed_regimes(QUERIES["station_days"](spark, SF).collect())
    assert len(got) == len(want) and len({r.cluster_id for r in got}) > 2
    for r in got:
        cluster, label, far = want[r.station_id, r.observation_date]
        assert (r.cluster_id, r.cluster_label) == (cluster, label) and r.distance_to_center == pytest.approx(far, abs=6e-4)


def test_plans_prune_and_push(spark):
    """The scan reads few columns, and panes are aggregated before they are dealt to windows."""
    from tidemark.queries.feeds import observations
    from tidemark.plans import weather

    text = weather.rain_duration(observations(spark, SF), 2024)._jdf.queryExecution().executedPlan().toString()
    assert "PythonUDF" not in text and "value" not in text.split("ReadSchema")[1]
    plan = weather.blizzards(observations(spark, SF), 2024)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.rindex("HashAggregate") and "CartesianProduct" not in plan
