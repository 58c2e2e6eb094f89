"""Micro-clusters: absorbing, founding, deleting and merging, relevance, and horizons against sums over the rows themselves."""

import json
import random
from datetime import date, timedelta

import numpy as np
import pytest

from tidemark.operators.regimes import ARCHETYPES, FEATURES, MicroClusters, added, unit_archetypes
from tidemark.operators.snapshots import SUMS, Pyramid

FIRST = date(2024, 1, 1)
NAMES = list(FEATURES)


def units(row):
    return np.array([min(max((row[c] - a) / (b - a), 0.0), 1.0) for c, (a, b) in FEATURES.items()])


def some_days(seed, n, shapes=tuple(ARCHETYPES)):
    r = random.Random(seed)
    out = []
    for i in range(n):
        base = ARCHETYPES[r.choice(shapes)]
        out.append({c: v + r.gauss(0, 0.02) * (FEATURES[c][1] - FEATURES[c][0]) for c, v in zip(NAMES, base)} | {"observation_date": FIRST + timedelta(days=i * 100 // n)})
    return out


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[c] for c in NAMES) + (r["observation_date"],) for r in rows], ", ".join(f"{c} double" for c in NAMES) + ", observation_date date")


def days_since(d):
    return (d - date(1970, 1, 1)).days


def check_totals(stats, rows):
    """All sums together are those of the rows."""
    u = np.array([units(r) for r in rows])
    t = np.array([days_since(r["observation_date"]) for r in rows], float)
    assert sum(s["n"] for s in stats) == len(rows)
    for key, want in (("ls", u.sum(0)), ("ss", (u * u).sum(0)), ("lt", t.sum()), ("st", (t * t).sum())):
        assert np.allclose(sum(s[key] for s in stats), want)


def test_the_first_slice_is_clustered_by_k_means(spark):
    rows = some_days(1, 300)
    model = MicroClusters()
    model.update(frame(spark, rows))
    check_totals(model.stats, rows)
    centres, u = np.array(model.centres()), np.array([units(r) for r in rows])
    own = ((u[:, None] - centres[None]) ** 2).sum(2).argmin(1)
    for i, s in enumerate(model.stats):  # a fixed point: each centre is the mean of the rows that are nearest to it
        assert s["n"] == (own == i).sum() and np.allclose(u[own == i].mean(0), centres[i])
    assert [s["ids"] for s in model.stats] == [[i] for i in range(6)]
    one = MicroClusters()
    one.update(frame(spark, rows[:1]))
    assert len(one.stats) == 1 and one.stats[0]["n"] == 1


def test_rows_are_absorbed_or_found_clusters(spark):
    mild = some_days(2, 200, ("mild_wet", "mild_clear_breezy"))
    model = MicroClusters()
    model.update(frame(spark, mild))
    known = len(model.stats)
    more, far = some_days(3, 60, ("mild_wet",)), some_days(4, 40, ("hot_dry_clear",))
    model.update(frame(spark, more + far))
    check_totals(model.stats, mild + more + far)
    assert len(model.stats) == known + 1 and model.stats[-1]["n"] >= 40 and model.stats[-1]["ids"] == [known]
    back = MicroClusters()
    back.load(model.dump())
    assert back.dump() == model.dump() and back.next_id == model.next_id == known + 1


def test_merging_adds_up_and_keeps_ids(spark):
    rows = some_days(5, 400)
    model = MicroClusters(k=6)
    model.update(frame(spark, rows[:200]))
    before = [dict(s) for s in model.stats]
    model.k = 3
    model.update(frame(spark, rows[200:]))
    check_totals(model.stats, rows)
    assert len(model.stats) == 3 and sorted(i for s in model.stats for i in s["ids"]) == list(range(model.next_id))
    both = added(before[0], before[1])
    assert both["n"] == before[0]["n"] + before[1]["n"] and both["ids"] == [0, 1] and np.allclose(both["ss"], before[0]["ss"] + before[1]["ss"])


def test_the_least_relevant_goes(spark):
    model = MicroClusters(k=2, horizon=30.0)
    old = [r | {"observation_date": FIRST} for r in some_days(6, 50, ("cold_windy_wet",))]
    warm = [r | {"observation_date": FIRST + timedelta(days=1)} for r in some_days(7, 50, ("hot_dry_clear",))]
    model.update(frame(spark, old + warm))
    kept = [r | {"observation_date": FIRST + timedelta(days=90)} for r in some_days(8, 300, ("hot_dry_clear",))]
    model.update(frame(spark, kept))
    assert [s["n"] for s in model.stats] == [50, 350]
    model.update(frame(spark, [r | {"observation_date": FIRST + timedelta(days=100)} for r in some_days(9, 50, ("volatile_windy",))]))
    assert [s["n"] for s in model.stats] == [350, 50] and model.stats[0]["ids"] != [0]  # the old one has gone, none were merged


def test_relevance_is_about_the_middle_time_of_the_last_points():
    rng = np.random.default_rng(2)
    model = MicroClusters(last_points=100)
    for n in (50, 199, 1000, 20_000):
        t = np.sort(rng.normal(1000, 30, n))
        s = {"n": n, "lt": t.sum(), "st": (t * t).sum()}
        want = t.mean() if n < 200 else np.median(t[-100:])
        assert model.relevance(s) == pytest.approx(want, abs=4.0)


def test_snapshots_are_few_and_close():
    p, model = Pyramid(alpha=2, l=2), MicroClusters()
    for tick in range(1, 1001):
        p.add(tick, float(tick), model)
        assert len(p.kept) <= (2**2 + 1) * (tick.bit_length())
        for h in (1, 3, 10, 60, 300):
            if h < tick:
                found = p.before(tick - h)
                start = found[0] if found else 0  # with nothing before it, all that was learned
                assert h <= tick - start <= h * 1.5 + 1, (tick, h)
    back = Pyramid()
    back.load(p.dump())
    assert json.loads(back.dump()) == json.loads(p.dump())


def test_a_horizon_is_what_its_rows_add_up_to(spark):
    """Learned by ten slices, with clusters founded and merged on the way: sums within a horizon are those of the rows since its start."""
    r = random.Random(11)
    model, pyramid, rows = MicroClusters(k=4), Pyramid(), []
    for tick in range(1, 11):
        new = [x | {"observation_date": FIRST + timedelta(days=10 * tick + r.randrange(10))} for x in some_days(20 + tick, 40, r.sample(list(ARCHETYPES), 2))]
        rows += new
        model.update(frame(spark, new))
        pyramid.add(tick, float(days_since(FIRST) + 10 * tick + 9), model)
    now = float(days_since(FIRST) + 109)
    for horizon in (10, 20, 35, 60, 99):
        start, inside = pyramid.within(horizon, now, model)
        assert start <= now - horizon
        check_totals(inside, [x for x in rows if days_since(x["observation_date"]) > start])
        assert all(np.all(s[k] >= -1e-9) for s in inside for k in SUMS)
    start, everything = pyramid.within(1000, now, model)
    assert start == -np.inf
    check_totals(everything, rows)
    assert len(unit_archetypes()) == 6
