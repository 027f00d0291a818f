"""Order-dependent operators over runs of rows, with one key that holds all of them."""

from __future__ import annotations

import math

import numpy as np
import pytest

from pointloom.operators import tracks as T


def _rows(hot):
    rng = np.random.default_rng(5)
    n = 3000
    tracks = [0] * n if hot else [int(t) if t else None for t in rng.integers(0, 4, n)]
    return [(t, float(ts), i, float(x), float(y), float(d)) for i, (t, ts, x, y, d) in enumerate(zip(tracks, rng.integers(0, 900, n), rng.normal(size=n), rng.normal(size=n), rng.choice([25, 5, -5, -40], n), strict=True))]


@pytest.fixture(autouse=True)
def small_partitions(spark):
    """Tables this small would be put into one partition."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, before)


@pytest.mark.parametrize("hot", [True, False])
def test_runs_add_up_to_their_tracks(spark, hot):
    rows = _rows(hot)
    df = spark.createDataFrame(rows, "track long, ts double, id long, x double, y double, d double").repartition(6)
    assert T.in_runs(df, ["track"], ["ts", "id"]).select("run").distinct().count() > 1
    want = {}
    for t in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == t), key=lambda r: (r[1], r[2]))
        h = 0.0
        for r in own:
            h = min(100.0, max(0.0, h + r[5]))
        want[t] = (sum(math.hypot(b[3] - a[3], b[4] - a[4]) for a, b in zip(own, own[1:], strict=False)), h, len(own))
    lengths = {r.track: (r.length, r["rows"]) for r in T.path_length(df, "track", ["ts", "id"]).collect()}
    folds = {r.track: (r.health, r["rows"]) for r in T.clamped_fold(df, "track", ["ts", "id"], df.d, 0.0, 100.0).collect()}
    assert set(lengths) == set(folds) == set(want)
    for t, (length, health, n) in want.items():
        assert lengths[t] == (pytest.approx(length), n) and folds[t] == (pytest.approx(health), n)


def test_runs_of_nothing_and_of_one(spark):
    df = spark.createDataFrame([(1, 0.0, 1, 2.0, 3.0, 5.0)], "track long, ts double, id long, x double, y double, d double")
    assert T.path_length(df, "track", ["ts", "id"]).first()[1:] == (0.0, 1)
    assert T.clamped_fold(df, "track", ["ts", "id"], df.d, 0.0, 100.0).first()[1:] == (5.0, 1)
    assert T.path_length(df.limit(0), "track", ["ts", "id"]).count() == 0
