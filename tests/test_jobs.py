"""The runnable jobs: reruns, growing input and odd rows."""

from __future__ import annotations

import math
import subprocess
import sys
from pathlib import Path

import pytest

from jobs import background_map, diagnostics_report
from jobs.common import read_config

ROOT = Path(__file__).resolve().parents[1]
PLAIN = {"voxel": 0.5, "tile_voxels": 2, "blind_radius": 0.35, "ground_z": 0.0, "ground_thickness": 0.1, "structure_points": 3, "files_per_batch": 2}
POINTS = "frame_id long, x double, y double, z double, intensity double, label string"


def _points(frame):
    """60 points of a frame, some of them blind, not finite or without values."""
    rows = [(frame, math.sin(i * 1.7 + frame) * 3, math.cos(i * 2.3) * 2, (i % 7) / 5 - 0.1, float(i % 50) if i % 9 else None, "x") for i in range(56)]
    return [*rows, (frame, 0.1, 0.1, 1.0, 1.0, None), (frame, float("nan"), 1.0, 1.0, 1.0, None), (frame, None, 1.0, 1.0, 1.0, None), (None, 1.0, 1.0, float("inf"), 1.0, None)]


def _land(spark, folder, frames):
    """One file a frame, as a recorder would add them."""
    spark.createDataFrame([r for f in frames for r in _points(f)], POINTS).repartition(len(frames), "frame_id").write.mode("append").parquet(folder)


def _rows(df):
    return sorted(map(repr, df.collect()))


def _by_hand(frames):
    cells = {}
    for f in frames:
        for frame, x, y, z, i, _ in _points(f):
            if all(v is not None and math.isfinite(v) for v in (x, y, z)) and math.hypot(x, y) >= 0.35:
                cells.setdefault((math.floor(x / 0.5), math.floor(y / 0.5), math.floor(z / 0.5)), []).append((frame, x, y, z, 100.0 if i is None else i))
    out = {}
    for cell, rows in cells.items():
        n = len(rows)
        mean = [sum(math.floor(r[k] * 1e6 + 0.5) for r in rows) / 1e6 / n for k in range(1, 5)]
        label = 0 if abs(mean[2]) <= 1.5 * 0.1 else 1 if n >= 3 else 2
        out[cell] = (n, *mean, min(r[0] for r in rows), max(r[0] for r in rows), label, f"{cell[0] // 2}_{cell[1] // 2}")
    return out


def test_map_of_growing_input_equals_one_run(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    _land(spark, src, [0, 1, 2])
    first = background_map.run(spark, src, out, ck, PLAIN)
    assert {(r.ix, r.iy, r.iz): (r.n, r.x, r.y, r.z, r.intensity, r.first_frame, r.last_frame, r.label, r.tile) for r in first.collect()} == _by_hand([0, 1, 2])
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "out").rglob("part-*")}
    same = _rows(background_map.run(spark, src, out, ck, PLAIN))
    assert same == _rows(first)
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "out").rglob("part-*") if "tile=" in str(p)}
    assert after == {p: t for p, t in before.items() if "tile=" in str(p)}  # nothing new: no partition was written again
    _land(spark, src, [3, 4])
    grown = background_map.run(spark, src, out, ck, PLAIN)
    assert {(r.ix, r.iy, r.iz): (r.n, r.x, r.y, r.z, r.intensity, r.first_frame, r.last_frame, r.label, r.tile) for r in grown.collect()} == _by_hand([0, 1, 2, 3, 4])
    whole = background_map.run(spark, src, str(tmp_path / "out2"), str(tmp_path / "ck2"), PLAIN)
    assert _rows(whole) == _rows(grown)


def test_map_leaves_untouched_tiles_alone(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    rows = lambda x: [(0, x, 1.0, 1.0, 1.0, "a")]
    spark.createDataFrame(rows(1.0), POINTS).write.mode("append").parquet(src)
    background_map.run(spark, src, out, ck, PLAIN)
    old = {p: p.stat().st_mtime_ns for p in (tmp_path / "out" / "map").rglob("tile=1_1/*")}
    assert old
    spark.createDataFrame(rows(9.0), POINTS).write.mode("append").parquet(src)
    assert background_map.run(spark, src, out, ck, PLAIN).count() == 2
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "out" / "map").rglob("tile=1_1/*")} == old


def test_map_replays_a_batch_without_counting_it_twice(spark, tmp_path):
    """A run that dies after writing a batch, before the checkpoint knows: the batch comes again under its number."""
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    _land(spark, src, [0, 1])
    once = _rows(background_map.run(spark, src, out, ck, PLAIN))
    for p in (tmp_path / "ck" / "commits").iterdir():
        if not p.name.startswith("."):
            p.unlink()
            (p.parent / f".{p.name}.crc").unlink(missing_ok=True)
    assert _rows(background_map.run(spark, src, out, ck, PLAIN)) == once


def test_map_of_nothing(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([], POINTS).write.parquet(src)
    assert background_map.run(spark, src, str(tmp_path / "out"), str(tmp_path / "ck"), PLAIN).count() == 0


def _frames(bag, n, day=1):
    return [(bag, f"2024-01-{day:02d} 10:00:{i:02d}", i, 90.0 + i, i / 2, 1 + i % 3) for i in range(n)]


COLUMNS = {"bag": "b", "ts": "t", "frame": "f", "latency_total_ms": "l", "nis": "n", "fsm_state": "s", "x": "cast(f AS double)"}
METRICS = "b string, t string, f long, l double, n double, s int"


def test_report_of_bags_and_days(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [*_frames("a", 21), *_frames("a", 3, 2), *_frames("b", 5), (None, None, 7, 50.0, 1.0, 2), ("c", "2024-01-01 10:00:00", 0, None, None, None)]
    spark.createDataFrame(rows, METRICS).write.parquet(src)
    settings = {"columns": COLUMNS, "gap_s": 2.0}
    got = diagnostics_report.run(spark, src, out, settings)
    by, before = {(r.bag, str(r.day)): r for r in got.collect()}, _rows(got)
    assert set(by) == {("a", "2024-01-01"), ("a", "2024-01-02"), ("b", "2024-01-01"), ("c", "2024-01-01"), (None, "None")}
    a = by["a", "2024-01-01"]
    assert (a.frames, a.latency_mean, a.latency_p50, a.latency_p95, a.sessions, a.longest_session_s, a.path_m) == (21, 100.0, 100.0, 109.0, 1, 20.0, 20.0)
    assert a.real_time_pct == round(11 / 21 * 100, 6) and a.active_pct == round(7 / 21 * 100, 6)
    assert by["c", "2024-01-01"].frames == 1 and by["c", "2024-01-01"].latency_p95 is None
    again = diagnostics_report.run(spark, src, out, settings)
    assert _rows(again) == before
    counts = spark.read.parquet(f"{out}/histogram").filter("bag = 'a'").agg({"count": "sum"}).first()[0]
    assert counts == 24


def test_report_keeps_the_bags_of_earlier_input(spark, tmp_path):
    out, settings = str(tmp_path / "out"), {"columns": COLUMNS}
    for bag, n in (("a", 4), ("b", 6), ("a", 5)):
        spark.createDataFrame(_frames(bag, n), METRICS).write.mode("overwrite").parquet(str(tmp_path / bag))
        got = diagnostics_report.run(spark, str(tmp_path / bag), out, settings)
    assert {r.bag: r.frames for r in got.collect()} == {"a": 5, "b": 6}


def test_report_of_csv_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "yard_metrics.csv").write_text("frame,latency_total_ms,nis,fsm_state\n0,80,1,1\n1,120,9,2\n60,100,2,2\n")
    got = diagnostics_report.run(spark, str(tmp_path / "in"), str(tmp_path / "out")).collect()
    assert [(r.bag, r.day, r.frames, r.real_time_pct, r.sessions, r.path_m) for r in got] == [("yard", None, 3, round(200 / 3, 6), 2, 0.0)]


def test_settings_are_checked(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"voxel": 1.0}')
    assert read_config(spark, str(tmp_path / "c.json"), background_map.DEFAULTS)["voxel"] == 1.0
    with pytest.raises(ValueError, match="unknown settings"):
        diagnostics_report.run(spark, "in", "out", {"colums": {}})
    with pytest.raises(ValueError, match="not mapped"):
        diagnostics_report.run(spark, "in", "out", {"columns": {"bag": "b"}})


def test_command_line(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "yard_metrics.csv").write_text("frame,latency_total_ms,nis,fsm_state\n0,80,1,1\n")
    (tmp_path / "c.json").write_text('{"real_time_ms": 50.0}')
    command = [sys.executable, "-m", "jobs.diagnostics_report", "--config", str(tmp_path / "c.json"), "--input", str(tmp_path / "in"), "--output", str(tmp_path / "out")]
    done = subprocess.run(command, cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "wrote 1 rows" in done.stderr and list((tmp_path / "out" / "report").glob("bag=yard/*.parquet"))
