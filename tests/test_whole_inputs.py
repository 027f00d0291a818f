"""Registered queries work on every row of their tables, not on chosen ids."""

from __future__ import annotations

import numpy as np
import pytest

from pointloom.operators import surface as U
from pointloom.plans import catalog
from pointloom.plans.model_queries import WIDE


@pytest.mark.parametrize("name", ["obb_split", "shell_merge"])
def test_every_supplier_gets_its_boxes(spark, tmp_path, name):
    rng = np.random.default_rng(3)
    rows = [(s, i, 1, float(rng.uniform(0, 10)), float(rng.uniform(0, 20000)), 0.0, float(rng.uniform(0, 0.08))) for s in (3, 11, 5000) for i in range(80)]
    names = "l_suppkey long, l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double"
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = catalog.queries()[name](spark, str(tmp_path)).collect()
    assert {r.frame_id for r in found} == {3, 11, 5000}


def _embeddings(spark, folder, n=60):
    """n points of three frames, the third far from the others; returns (frame_id, point_id, x, y, z, intensity) rows."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(n):
        x, y, z = (rng.uniform(-0.15, 0.15, 3) + (0.3 if i % 3 == 2 else 0.0)).astype(np.float32)
        rows.append((i, [float(x), float(y), float(z), 0.25], (3, 4, 7)[i % 3]))
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return [(label, i, *e) for i, e, label in rows]


def test_grids_hold_the_points_of_all_frames(spark, tmp_path):
    xyz = np.array([r[2:5] for r in _embeddings(spark, tmp_path)])
    nodes = np.array([(r.x, r.y, r.z) for r in catalog.queries()["grid_whole"](spark, str(tmp_path)).collect()])
    assert (nodes.min(axis=0) <= xyz.min(axis=0)).all() and (nodes.max(axis=0) >= xyz.max(axis=0) - 1e-6).all()
    level = np.array([(r.x, r.y, r.z) for r in catalog.queries()["surface_level"](spark, str(tmp_path)).collect()])
    assert np.abs(level @ [1, 0.5, -0.25]).max() < 1e-5 and level[:, 2].max() > 0.3  # the plane crosses the far frame's heights


def test_farthest_points_of_every_frame(spark, tmp_path):
    rows, want = _embeddings(spark, tmp_path), set()
    for frame in (3, 4, 7):
        own = sorted(r for r in rows if r[0] == frame)
        chosen = [own[0]]
        while len(chosen) < 8:
            gap = lambda r: min(sum((a - b) ** 2 for a, b in zip(r[2:5], c[2:5], strict=True)) for c in chosen)  # noqa: B023, E731
            chosen.append(max(own, key=lambda r: (gap(r), -r[1])))
        want |= {(frame, k + 1, r[1]) for k, r in enumerate(chosen)}
    assert {(r.frame_id, r["rank"], r.point_id) for r in catalog.queries()["fps_whole"](spark, str(tmp_path)).collect()} == want


def test_every_point_has_the_label_of_its_nearest_other(spark, tmp_path):
    rows, want = _embeddings(spark, tmp_path), {}
    for r in rows:
        d, other, label = min((sum((a - b) ** 2 for a, b in zip(r[2:5], o[2:5], strict=True)) ** 0.5, o[1], o[0]) for o in rows if o[1] != r[1])
        want[r[1]] = (label, d)
    got = {r.point_id: (r.label, r.d) for r in catalog.queries()["nn_label_whole"](spark, str(tmp_path)).collect()}
    assert set(got) == set(want) and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-6 for k in want)


def test_field_of_a_surface_of_all_points(spark, tmp_path):
    rows = _embeddings(spark, tmp_path, 150)
    x = np.array([r[2:5] for r in rows])
    n = x / np.linalg.norm(x, axis=1)[:, None]
    order = np.lexsort((n * 0.3).T[::-1])
    s = U.build_surface((n * 0.3)[order], n[order], config=WIDE)
    f = s.evaluate(x - s.centroid)[0]
    got = {r.point_id: r.field for r in catalog.queries()["field_value_whole"](spark, str(tmp_path)).collect()}
    assert len(got) == 150 and np.allclose([got[r[1]] for r in rows], f, atol=1e-4)
    scores = {r.frame_id: r.score for r in catalog.queries()["fit_score_whole"](spark, str(tmp_path)).collect()}
    frames = np.array([r[0] for r in rows])
    assert set(scores) == {3, 4, 7} and all(np.isclose(scores[k], (f[frames == k] ** 2).mean() / 0.25, rtol=1e-4, atol=1e-5) for k in scores)
