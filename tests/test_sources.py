"""Round trips of the sources."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from pointloom.sources import tables as T
from pointloom.sources.mcap import MAGIC, McapReader, McapSource, McapStreamReader, PushingReader, decode_cloud


def _cdr(xyz, intensity=True, step=16):
    out = bytearray(b"\x00\x01\x00\x00")

    def number(kind, value, size):
        out.extend(bytes(-(len(out) - 4) % size) + struct.pack("<" + kind, value))

    def text(s):
        number("I", len(s) + 1, 4)
        out.extend(s.encode() + b"\x00")

    number("i", 1, 4), number("I", 2, 4), text("lidar"), number("I", 1, 4), number("I", len(xyz), 4)
    names = ["x", "y", "z", *(["intensity"] if intensity else [])]
    number("I", len(names), 4)
    for i, n in enumerate(names):
        text(n), number("I", 4 * i, 4), number("B", 7, 1), number("I", 1, 4)
    number("B", 0, 1), number("I", step, 4), number("I", step * len(xyz), 4), number("I", step * len(xyz), 4)
    for p in xyz:
        out.extend(struct.pack("<4f", *p, 5.0)[:step])
    number("B", 1, 1)
    return bytes(out)


def _record(op, body):
    return struct.pack("<BQ", op, len(body)) + body


def _text(s):
    return struct.pack("<I", len(s)) + s.encode()


def _mcap(messages, compression="zstd"):
    schema = _record(3, struct.pack("<H", 1) + _text("sensor_msgs/msg/PointCloud2") + _text("ros2msg") + _text(""))
    channel = _record(4, struct.pack("<HH", 1, 1) + _text("/points") + _text("cdr") + struct.pack("<I", 0))
    inner = b"".join(_record(5, struct.pack("<HIQQ", 1, i, 10**9 * (i + 1), 0) + m) for i, m in enumerate(messages))
    packed = zstandard.ZstdCompressor().compress(inner) if compression else inner
    chunk = struct.pack("<QQQI", 0, 0, len(inner), 0) + _text(compression) + struct.pack("<Q", len(packed)) + packed
    return MAGIC + _record(1, _text("") + _text("")) + schema + channel + _record(6, chunk) + MAGIC


def _bag(chunks, indexed=True, ended=True, topics=("/points",), compression="zstd", loose=()):
    """A file of several chunks; a chunk is a list of (channel, ns, message). Channels stand in the first chunk and, if indexed, in the summary."""
    schema = _record(3, struct.pack("<H", 1) + _text("sensor_msgs/msg/PointCloud2") + _text("ros2msg") + _text(""))
    declared = schema + b"".join(_record(4, struct.pack("<HH", n, 1) + _text(t) + _text("cdr") + struct.pack("<I", 0)) for n, t in enumerate(topics, 1))
    message = lambda c, ns, m: _record(5, struct.pack("<HIQQ", c, 0, ns, 0) + m)
    out, index = MAGIC + _record(1, _text("") + _text("")), []
    for k, rows in enumerate(chunks):
        inner = (b"" if k else declared) + b"".join(message(*r) for r in rows)
        packed = zstandard.ZstdCompressor().compress(inner) if compression else inner
        times = [ns for _, ns, _ in rows] or [0]
        body = struct.pack("<QQQI", min(times), max(times), len(inner), zlib.crc32(inner)) + _text(compression) + struct.pack("<Q", len(packed)) + packed
        held = b"".join(struct.pack("<HQ", c, 0) for c in sorted({c for c, _, _ in rows}))
        index.append(_record(8, struct.pack("<QQQQI", min(times), max(times), len(out), len(body) + 9, len(held)) + held + struct.pack("<Q", 0) + _text(compression) + struct.pack("<QQ", len(packed), len(inner))))
        out += _record(6, body)
    out += b"".join(message(*r) for r in loose)
    if not ended:
        return out
    out += _record(15, struct.pack("<I", 0))
    start = len(out) if indexed else 0
    return out + (declared + b"".join(index) if indexed else b"") + _record(2, struct.pack("<QQI", start, 0, 0)) + MAGIC


def _cloud_at(i):
    return _cdr([(i, 0, 0), (i, 1, 0)])


def _seconds(chunks):
    """`chunks` chunks of three frames each, a second a frame."""
    return [[(1, 10**9 * (3 * k + j), _cloud_at(3 * k + j)) for j in range(3)] for k in range(chunks)]


def _bytes(reader):
    return sum(p.bytes for p in reader.partitions())


@pytest.mark.parametrize("indexed", [True, False])
def test_mcap_is_split_by_chunks(spark, tmp_path, indexed):
    spark.dataSource.register(McapSource)
    (tmp_path / "a.mcap").write_bytes(_bag(_seconds(8), indexed))
    df = spark.read.format("mcap_points").option("split_bytes", 1).load(str(tmp_path))
    assert df.rdd.getNumPartitions() == (8 if indexed else 1)
    rows = df.orderBy("frame_id").collect()
    assert [r.ts_ns for r in rows] == [10**9 * i for i in range(24)] and [r.points[1].x for r in rows] == list(range(24))
    assert len({r.frame_id for r in rows}) == 24 and {r.topic for r in rows} == {"/points"}
    some = spark.read.format("mcap_points").option("start_ns", 10**9 * 7).option("end_ns", 10**9 * 10).load(str(tmp_path))
    assert sorted(r.ts_ns // 10**9 for r in some.collect()) == [7, 8, 9, 10]
    options = {"path": str(tmp_path)}
    assert not indexed or _bytes(McapReader(options | {"start_ns": str(10**9 * 21)})) < _bytes(McapReader(options)) / 4


def test_mcap_takes_filters(spark, tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan, LessThanOrEqual

    spark.dataSource.register(McapSource)
    chunks = [[(1, 10**9 * k, _cloud_at(k))] if k % 2 else [(2, 10**9 * k, _cloud_at(k))] for k in range(8)]
    (tmp_path / "a.mcap").write_bytes(_bag(chunks, topics=("/left", "/right")))
    reader = PushingReader({"path": str(tmp_path)})
    filters = [GreaterThan(("ts_ns",), 10**9 * 2), LessThanOrEqual(("ts_ns",), 10**9 * 6), EqualTo(("topic",), "/left")]
    assert list(reader.pushFilters(filters)) == filters and sum(len(p.pieces) for p in reader.partitions()) == 2
    conf = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "true")
    try:
        df = spark.read.format("mcap_points").option("pushdown", "true").load(str(tmp_path)).filter(f"ts_ns > {2 * 10**9} AND ts_ns <= {6 * 10**9} AND topic = '/left'")
        assert sorted(r.ts_ns // 10**9 for r in df.collect()) == [3, 5]
        other = spark.read.format("mcap_points").option("pushdown", "true").option("topic", "/right").load(str(tmp_path)).filter("topic = '/left'")
        assert other.count() == 0
    finally:
        spark.conf.set(conf, before)
    assert {r.topic for r in spark.read.format("mcap_points").option("topic", "/left").load(str(tmp_path)).collect()} == {"/left"}
    assert {r.topic for r in spark.read.format("mcap_points").option("topic", "/none").load(str(tmp_path)).collect()} == {"/left", "/right"}


def test_mcap_damage_is_reported(spark, tmp_path):
    spark.dataSource.register(McapSource)
    whole = _bag(_seconds(3), compression="", loose=[(1, 99, _cloud_at(99)), (1, 98, _cloud_at(98))], indexed=False)
    (tmp_path / "loose.mcap").write_bytes(whole)
    assert spark.read.format("mcap_points").load(str(tmp_path / "loose.mcap")).select("frame_id").distinct().count() == 11
    (tmp_path / "cut.mcap").write_bytes(whole[: len(whole) * 2 // 3])  # a recording that broke off
    assert 0 < spark.read.format("mcap_points").load(str(tmp_path / "cut.mcap")).count() < 9
    bad = bytearray(_bag(_seconds(3), compression=""))
    at = bad.index(_cloud_at(4)) + 70
    bad[at] ^= 0xFF
    (tmp_path / "bad.mcap").write_bytes(bytes(bad))
    rows = spark.read.format("mcap_points").load(str(tmp_path / "bad.mcap")).collect()
    assert len(rows) == 7 and [r.error for r in rows if r.error] == ["ValueError: a chunk does not match its checksum"]
    assert spark.read.format("mcap_points").option("mode", "DROPMALFORMED").load(str(tmp_path / "bad.mcap")).count() == 6
    with pytest.raises(Exception, match="checksum"):
        spark.read.format("mcap_points").option("mode", "FAILFAST").load(str(tmp_path / "bad.mcap")).count()
    (tmp_path / "none.mcap").write_bytes(_bag([[]], indexed=False, topics=()))
    with pytest.raises(Exception, match="no point-cloud topic"):
        spark.read.format("mcap_points").load(str(tmp_path / "none.mcap")).count()


def test_mcap_stream_neither_loses_nor_repeats(spark, tmp_path):
    """Files arrive, one grows, and the stream is started anew each time: at the end the batch scan's frames are there, once each."""
    spark.dataSource.register(McapSource)
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    (tmp_path / "in").mkdir()

    def run():
        stream = spark.readStream.format("mcap_points").load(src)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(out).count() if (tmp_path / "out").exists() else 0

    (tmp_path / "in" / "b.mcap").write_bytes(_bag(_seconds(2)))
    assert run() == 6 and run() == 6
    (tmp_path / "in" / "a.mcap").write_bytes(_bag(_seconds(3), ended=False))  # sorts before b and is still being written
    assert run() == 15
    whole = _bag(_seconds(5), loose=[(1, 7, _cloud_at(7))], indexed=False)
    (tmp_path / "in" / "a.mcap").write_bytes(whole)
    assert run() == 22 and run() == 22
    key = lambda r: (r.topic, r.ts_ns, [tuple(p) for p in r.points])
    batch = spark.read.format("mcap_points").load(src).collect()
    stream = spark.read.parquet(out).collect()
    assert sorted(map(key, batch)) == sorted(map(key, stream)) and len({r.frame_id for r in stream}) == 22


def test_mcap_stream_replays_a_batch_as_it_was(tmp_path):
    (tmp_path / "a.mcap").write_bytes(_bag(_seconds(2), ended=False))
    reader = McapStreamReader({"path": str(tmp_path)})
    start, end = reader.initialOffset(), reader.latestOffset()
    rows = [r for p in reader.partitions(start, end) for r in reader.read(p)]
    (tmp_path / "a.mcap").write_bytes(_bag(_seconds(4)))
    again = McapStreamReader({"path": str(tmp_path)})  # a restart: the file has grown since
    assert [r for p in again.partitions(start, end) for r in again.read(p)] == rows and len(rows) == 6
    rest = [r for p in again.partitions(end, again.latestOffset()) for r in again.read(p)]
    assert len(rest) == 6 and not {r[0] for r in rows} & {r[0] for r in rest}


def test_mcap_source(spark, tmp_path):
    spark.dataSource.register(McapSource)
    good, bad = _cdr([(1, 2, 3), (float("nan"), 0, 0), (4, 5, 6)]), b"\x00\x01\x00\x00short"
    (tmp_path / "b.mcap").write_bytes(_mcap([good, bad]))
    (tmp_path / "a.mcap").write_bytes(_mcap([good], ""))
    df = spark.read.format("mcap_points").option("topic", "/absent").load(str(tmp_path))
    rows = df.orderBy("frame_id").collect()
    assert [len(r.points or []) for r in rows] == [2, 2, 0] and rows[2].error and rows[0].ts_ns == 10**9
    assert rows[0].points[1].x == 4.0 and rows[0].points[1].intensity == 5.0
    dropped = spark.read.format("mcap_points").option("mode", "DROPMALFORMED").load(str(tmp_path / "b.mcap"))
    assert dropped.count() == 1
    with pytest.raises(Exception, match="no .*mcap|FileNotFound"):
        (tmp_path / "none").mkdir()
        spark.read.format("mcap_points").load(str(tmp_path / "none")).count()


def test_intensity_defaults_where_the_step_is_short():
    xyz, intensity = decode_cloud(_cdr([(1, 2, 3)], intensity=False, step=12))
    assert np.allclose(xyz, [[1, 2, 3]]) and intensity[0] == 100.0


def test_tables_round_trip(spark, tmp_path):
    points = spark.createDataFrame([(1.0, 2.0, 3.0, 0, 9.0), (4.0, 5.0, 6.0, 3, 8.0)], T.LABELLED)
    T.write_labelled(points, str(tmp_path / "labelled"))
    found = T.read_labelled(spark, str(tmp_path / "labelled"), [3])
    assert [r.x for r in found.collect()] == [4.0]
    alignment = spark.createDataFrame([([[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]], (0.1, 0.05))], "alignment array<array<double>>, ground struct<z: double, thickness: double>")
    shells = spark.createDataFrame([([0.0, 1.0, 2.0], [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]], [0.1, 0.2, 0.3], 0.5)], "center array<double>, axes array<array<double>>, extents array<double>, solidity double")
    T.write_prior(alignment, shells, str(tmp_path / "prior"))
    row = T.prior_shells(T.read_prior(spark, str(tmp_path / "prior"))).first()
    assert (row.cy, row.a0x, row.e2) == (1.0, 1.0, 0.3)
    (tmp_path / "bags").mkdir()
    (tmp_path / "bags" / "bag1_metrics.csv").write_text("frame,latency_total_ms,nis,fsm_state\n1,20.5,0.5,2\n")
    assert T.read_metrics(spark, str(tmp_path / "bags")).select("bag", "nis").first() == ("bag1", 0.5)
    walls = spark.createDataFrame([([1.0, 0.0, 0.0], -1.0, None, None, None, None, None)], T.WALLS)
    assert T.flat_walls(walls).filter(F.col("half_width").isNull()).first().nx == 1.0


def test_models_and_metadata_round_trip(spark, tmp_path):
    model = spark.createDataFrame([(i, [0.1 * i, 0.0, 0.2], [0.0, 0.0, 1.0], 0.3, 0.5, [1.0, 2.0, float(i)]) for i in range(5)], T.MODEL).repartition(3)
    head = spark.createDataFrame([([1.0, 2.0, 3.0], 0.04, 0.012, 0.05)], T.MODEL_HEAD)
    for _ in range(2):  # again over itself
        T.write_model(model, head, str(tmp_path / "model"))
    got = T.read_model(spark, str(tmp_path / "model"))
    assert sorted((r.k, r.p, r.alpha_g, r.centroid, r.robot_volume) for r in got.collect()) == sorted((r.k, r.p, r.alpha_g, [1.0, 2.0, 3.0], 0.04) for r in model.collect())
    flat = T.flat_primitives(got).orderBy("k").collect()
    assert (flat[2].px, flat[2].pz, flat[2].alpha_gz) == (pytest.approx(1.2), pytest.approx(3.2), 2.0)
    from pointloom.operators.spatial import field_value

    at = spark.createDataFrame([(1, 1.0, 2.0, 3.2)], "point_id long, x double, y double, z double")
    assert field_value(at, T.flat_primitives(got)).first().field != 0.08

    points = spark.createDataFrame([(0.0, 0.0, 0.0, 0, 1.0), (1.0, 2.0, 3.0, 3, 1.0), (3.0, 2.0, 1.0, 3, 1.0), (1.0, 1.0, 1.0, 1, 1.0)], T.LABELLED)
    alignment = spark.createDataFrame([([[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]], -0.1, [0.0, 0.0, 1.0], 0.1, 0.05)], "R_align array<array<double>>, z_ground double, ground_normal array<double>, ground_distance double, ground_thickness double")
    T.write_metadata(points, alignment, str(tmp_path / "meta"))
    row = T.read_metadata(spark, str(tmp_path / "meta")).first()
    assert (row.z_ground, row.robot_centroid, row.label_counts.asDict()) == (-0.1, [2.0, 2.0, 2.0], {"ground": 1, "structure": 1, "candidate": 0, "target": 2})


def test_a_failed_write_leaves_no_model(spark, tmp_path):
    head = spark.createDataFrame([([1.0, 2.0, 3.0], 0.04, 0.012, 0.05)], T.MODEL_HEAD)
    broken = spark.range(3).select(F.col("id").cast("int").alias("k"), F.array(F.raise_error(F.lit("broken")).cast("double")).alias("p"), F.array(F.lit(0.0)).alias("n"), F.lit(0.1).alias("h"), F.lit(0.1).alias("alpha_v"), F.array(F.lit(0.0)).alias("alpha_g"))
    with pytest.raises(Exception, match="broken"):
        T.write_model(broken, head, str(tmp_path / "model"))
    assert not (tmp_path / "model" / "head").exists() and not list((tmp_path / "model").glob("primitives/part-*"))
