"""The tracker as batch and as stream: order, lateness, timers and numbers."""

from __future__ import annotations

import math

import numpy as np
import pytest

from pointloom.config import DEFAULT
from pointloom.streaming import tracker as K

FITS = "track long, frame long, ts double, px double, py double, yaw double, is_target boolean, z_ground double"


def _fits(tracks=(1, 2, 3), frames=60, gap_at=None):
    rng = np.random.default_rng(3)
    rows = []
    for t in tracks:
        ts = 0.0
        for k in range(frames):
            ts += 0.1 + (30.0 if k == gap_at else 0.0)
            seen = k % 11 not in (4, 5)
            pose = (math.cos(ts) + float(rng.normal(0, 0.05)), 0.1 * ts, float(rng.normal(0, 0.1))) if seen else (None, None, None)
            rows.append((t, k, round(ts, 3), *pose, seen and k % 4 == t % 4, 0.1 * t))
    return rows


def _clock(ts):
    return (-1, None, ts, None, None, None, None, None)


def _stream(spark, folder, files, **options):
    """Rows of the stream over files of rows, a micro-batch each."""
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, FITS).coalesce(1).write.mode("append").parquet(f"{folder}/in/{i:02d}")
    out = []
    for i in range(len(files)):  # a run a file, each from the checkpoint
        stream = spark.readStream.schema(FITS).parquet(*[f"{folder}/in/{{{','.join(f'{k:02d}' for k in range(i + 1))}}}"])
        with K.state_store(spark):
            q = K.track_stream(stream, **options).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start()
            q.awaitTermination()
    out = spark.read.schema(K.OUTPUT).parquet(f"{folder}/out").collect()
    return sorted((tuple(r) for r in out), key=repr)


def _batch(spark, rows, **options):
    return sorted((tuple(r) for r in K.track_batch(spark.createDataFrame(rows, FITS).repartition(3), **options).collect()), key=repr)


def test_shuffled_and_delayed_rows_equal_the_batch(spark, tmp_path):
    rows = _fits()
    rng = np.random.default_rng(1)
    late = sorted(rows, key=lambda r: r[2] + float(rng.random()) * 1.5)  # up to 1.5 s out of order
    files = [list(rng.permutation(np.array(late[k : k + 60], dtype=object)).tolist()) for k in range(0, 180, 60)]
    files = [[tuple(r) for r in f] for f in files]
    assert _stream(spark, str(tmp_path), [*files, [_clock(1e6)]], delay="2 seconds") == _batch(spark, rows)


def test_rows_behind_the_watermark_are_dropped(spark, tmp_path):
    rows = _fits((1,), 40)
    kept = [r for r in rows if r[1] != 5]
    got = _stream(spark, str(tmp_path), [kept[:30], [r for r in rows if r[1] == 5] + kept[30:], [_clock(1e6)]], delay="1 seconds")
    assert got == _batch(spark, kept)


def test_a_silent_track_ends_by_its_timer(spark, tmp_path):
    rows = _fits((1, 2), 30)
    quiet = sorted((r for r in rows if r[0] == 1 or r[1] < 10), key=lambda r: r[2])  # track 2 falls silent
    last = max(r[2] for r in quiet if r[0] == 2)
    got = _stream(spark, str(tmp_path), [quiet[:25], quiet[25:], [_clock(last + 1.9)], [_clock(last + 40.0)], [_clock(last + 80.0)]], delay="100 milliseconds", end_after_s=3.0)
    ends = [r for r in got if r[1] is None]
    assert sorted(r[0] for r in ends) == [1, 2] and [r[2] for r in ends if r[0] == 2] == [pytest.approx(last + 3.0)]
    assert all(r[11] == K.SEARCHING and r[10] == 0.0 for r in ends)
    assert [r for r in got if r[1] is not None] == _batch(spark, quiet, end_after_s=3.0)


def test_a_gap_starts_a_track_anew_in_both(spark, tmp_path):
    rows = _fits((1,), 40, gap_at=20)
    batch = _batch(spark, rows, end_after_s=10.0)
    assert batch != _batch(spark, rows) and next(r for r in batch if r[1] == 20)[10] <= 25
    got = _stream(spark, str(tmp_path), [rows[:20], rows[20:], [_clock(1e6)]], delay="1 seconds", end_after_s=10.0)
    assert [r for r in got if r[1] is not None] == batch


def test_rows_at_and_before_the_start_of_the_clock_are_taken(spark, tmp_path):
    rows = [(t, k, round(ts - 3.1, 3), *r) for t, k, ts, *r in _fits((1, 2), 60)] + [(3, 0, 0.0, 1.0, 0.0, 0.0, True, 0.0), (4, 0, 5e-7, 1.0, 0.0, 0.0, True, 0.0)]
    assert min(r[2] for r in rows) == -3.0
    assert _stream(spark, str(tmp_path), [rows[::2], rows[1::2], [_clock(1e6)]], delay="1 hour") == _batch(spark, rows)


def test_the_store_is_called_by_groups_of_tracks_and_not_by_rows(spark, tmp_path):
    """200 tracks of 6 rows: 8 entries of the list a micro-batch, where each of the 1,200 rows was one; tracks of a group stay apart."""
    rows = _fits(range(200), 6)
    spark.createDataFrame(rows, FITS).repartition(2).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(FITS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    with K.state_store(spark, 3):
        q = K.track_stream(stream, delay="1 hour", groups=8).writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/noop").trigger(availableNow=True).start()
        q.awaitTermination()
    taken = [p["stateOperators"][0] for p in q.recentProgress if p["numInputRows"]]
    assert [t["numRowsUpdated"] for t in taken] == [8, 8] and {t["numShufflePartitions"] for t in taken} == {3}
    assert _stream(spark, f"{tmp_path}/all", [rows[::2], rows[1::2], [_clock(1e6)]], delay="1 hour", groups=8) == _batch(spark, rows)


def test_tracks_of_a_group_end_one_by_one(spark, tmp_path):
    rows = _fits((1, 2, 3), 30)
    quiet = sorted((r for r in rows if r[1] < 10 * r[0]), key=lambda r: r[2])  # track 1 falls silent after 1 s, track 2 after 2 s
    got = _stream(spark, str(tmp_path), [quiet, [_clock(4.2)], [_clock(5.2)], [_clock(40.0)]], delay="100 milliseconds", end_after_s=3.0, groups=1)
    assert sorted((r[0], r[2]) for r in got if r[1] is None) == [(t, pytest.approx(t + 3.0)) for t in (1, 2, 3)]
    assert [r for r in got if r[1] is not None] == _batch(spark, quiet, end_after_s=3.0)


def test_settings_are_restored(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    with K.state_store(spark):
        assert "RocksDB" in spark.conf.get(name)
    assert spark.conf.get(name, None) == before


def test_state_partitions_are_restored(spark):
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    with K.state_store(spark, 3):
        assert spark.conf.get(name) == "3"
    assert spark.conf.get(name) == before


def test_a_track_longer_than_a_batch_is_one_track(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = _fits((1, 2), 50)
    whole = _batch(spark, rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert _batch(spark, rows) == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_filter_equals_its_matrix_form():
    """The same numbers by NumPy's matrices."""
    rng = np.random.default_rng(8)
    for _ in range(30):
        a = rng.normal(size=(6, 6))
        p, x, dt = a @ a.T + np.eye(6), rng.normal(size=6), float(rng.random())
        t = K.Track(x=x.tolist(), p=p.tolist(), started=True)
        K.predict(t, dt)
        c, s = np.cos(x[2]), np.sin(x[2])
        f = np.eye(6)
        f[0, 2:5] = (-x[3] * s - x[4] * c) * dt, c * dt, -s * dt
        f[1, 2:5] = (x[3] * c - x[4] * s) * dt, s * dt, c * dt
        f[2, 5] = dt
        p = f @ p @ f.T + np.diag(K.Q) * dt
        assert np.allclose(t.p, p)
        for at, noise in ((0, K.R), (3, K.STILL)):
            h = np.eye(6)[at : at + 3]
            inverse = np.linalg.inv(h @ p @ h.T + np.diag(noise) * 2.0)
            y = rng.normal(size=3)
            u = K.Track(x=list(t.x), p=[list(r) for r in t.p])
            assert np.allclose(K._inverse(u.p, at, noise, 2.0), inverse)
            gain = p @ h.T @ inverse
            K._correct(u, at, inverse.tolist(), y.tolist())
            assert np.allclose(u.p, (np.eye(6) - gain @ h) @ p) and np.allclose(np.delete(u.x, 2), np.delete(t.x + gain @ y, 2))
    assert DEFAULT.gate > 0
