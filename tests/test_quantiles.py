"""Exact quantiles by refinement against NumPy."""

from __future__ import annotations

import numpy as np
import pytest

from pointloom.operators.quantiles import exact_quantiles, with_quantiles

PROBS = (0.0, 0.05, 0.5, 0.95, 0.99, 1.0)


def _groups():
    rng = np.random.default_rng(7)
    return {
        "hot": rng.normal(size=4000).tolist(),
        "few": [1.0, 2.0, 4.0],
        "one": [5.0],
        "ties": [3.0] * 500 + [4.0] * 500,
        "spread": (10.0 ** rng.uniform(-8, 8, 900)).tolist(),
        "whole": [float(x) for x in rng.integers(0, 300, 700)],
        None: [2.0, 8.0],
    }


@pytest.mark.parametrize("few", [1 << 16, 3, 40])
def test_quantiles_equal_numpy(spark, few):
    rows = [(g, v) for g, values in _groups().items() for v in values] + [("few", None), ("nothing", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    got = {r.g: r.quantiles for r in exact_quantiles(df, ["g"], "v", PROBS, few).collect()}
    assert set(got) == set(_groups())
    for g, values in _groups().items():
        assert np.allclose(got[g], np.quantile(values, PROBS), rtol=1e-12, atol=1e-12), g


def test_quantiles_join_their_table(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0), ("b", None)], "g string, v double")
    out = with_quantiles(df.groupBy("g").count(), df, ["g"], "v", {"p50": 0.5, "p100": 1.0})
    assert out.columns == ["g", "count", "p50", "p100"]
    assert {r.g: (r["count"], r.p50, r.p100) for r in out.collect()} == {"a": (2, 2.0, 3.0), None: (1, 5.0, 5.0), "b": (1, None, None)}


def test_one_hot_group_spreads(spark):
    """Counts of a single group's values are dealt over partitions, and no plan holds a percentile aggregate."""
    df = spark.range(20_000).selectExpr("'a' AS g", "cast(id * 7919 % 20011 AS double) AS v")
    found = exact_quantiles(df, ["g"], "v", [0.5], 100)
    assert "percentile" not in found._jdf.queryExecution().toString() and found.first().quantiles[0] == np.quantile([i * 7919 % 20011 for i in range(20_000)], 0.5)
    assert exact_quantiles(df.limit(0), ["g"], "v", [0.5]).count() == 0
