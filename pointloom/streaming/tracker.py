"""Pose tracking: a constant body-velocity filter with gates, coasting and timeout, as one pure step function.

The same `step` runs in a batch fold per track and in a stateful stream, so both
give the same rows. All times are event times. Every row is one frame of a track: the pose of its
best fit and whether that is the target, or nulls where nothing was fitted. The body's middle is HALF_HEIGHT above the
ground, which a column z_ground gives (0 without it).

The batch sorts rows by track and time and folds them as they come, so no track need fit into memory. The stream holds typed
state of its tracks, by groups of them, and the rows that the watermark has not passed: rows that come out of order are put in order before they are
taken, rows behind the watermark are dropped by Spark, and a track that stays silent for `end_after_s` ends by its timer.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterable, Iterator
from dataclasses import astuple, dataclass, field
from itertools import batched, groupby
from math import atan2, ceil, cos, hypot, isnan, sin

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from pointloom.config import DEFAULT, Config

#: Lifecycle states and their numbers, fixed values.
SEARCHING, ACTIVE, COASTING = "SEARCHING", "ACTIVE", "COASTING"
STATE_NUMBER = {SEARCHING: 1, ACTIVE: 2, COASTING: 3}
#: Variances of a measured pose, of the process by second, and of a standing body's velocity.
R = (0.01, 0.01, 0.02)
Q = (0.02, 0.02, 0.03, 0.005, 0.005, 0.005)
STILL = (1e-3, 1e-3, 1e-3)
HALF_HEIGHT = 0.24
LOW_CONFIDENCE = 5.0  # factor of R for fits that are not the target
#: Milliseconds by which the stream's clock runs ahead of `ts`. A watermark starts at 1970 and takes nothing at or before it, so
#: without this the first microsecond of a clock that starts at 0 and all before it would be late from the start.
AHEAD_MS = 1 << 41  # 69 years
Matrix = list[list[float]]


def _wrapped(angle: float) -> float:
    return atan2(sin(angle), cos(angle))


def _diagonal(value: float) -> Matrix:
    return [[value if i == j else 0.0 for j in range(6)] for i in range(6)]


@dataclass
class Track:
    """State of one track; small plain lists, on which 6 x 6 arithmetic is quickest."""

    x: list[float] = field(default_factory=lambda: [0.0] * 6)
    p: Matrix = field(default_factory=lambda: _diagonal(0.1))
    started: bool = False
    health: float = 0.0
    lifecycle: str = SEARCHING
    last_target: float | None = None
    last_ts: float | None = None
    still: bool = False


def predict(t: Track, dt: float) -> None:
    """Move a started track by its body-frame velocity."""
    if not t.started:
        return
    c, s = cos(t.x[2]), sin(t.x[2])
    gx, gy = t.x[3] * c - t.x[4] * s, t.x[3] * s + t.x[4] * c
    t.x[0] += gx * dt
    t.x[1] += gy * dt
    t.x[2] = _wrapped(t.x[2] + t.x[5] * dt)
    # The Jacobian is the identity and seven entries, in the first three rows.
    a, b, e = -gy * dt, c * dt, -s * dt
    f, g, h = gx * dt, s * dt, c * dt
    p = t.p
    p0, p1, p2, p3, p4, p5 = p
    p[0] = [u + a * v + b * w + e * z for u, v, w, z in zip(p0, p2, p3, p4)]  # noqa: B905
    p[1] = [u + f * v + g * w + h * z for u, v, w, z in zip(p1, p2, p3, p4)]  # noqa: B905
    p[2] = [u + dt * v for u, v in zip(p2, p5)]  # noqa: B905
    for i, r in enumerate(p):
        r[0] += a * r[2] + b * r[3] + e * r[4]
        r[1] += f * r[2] + g * r[3] + h * r[4]
        r[2] += dt * r[5]
        r[i] += Q[i] * dt


def _inverse(p: Matrix, at: int, noise: tuple[float, ...], factor: float = 1.0) -> Matrix:
    """Inverse of the 3 x 3 part of p from `at` on plus a diagonal, by cofactors."""
    (a, b, c), (d, e, f), (g, h, k) = (p[at + i][at : at + 3] for i in range(3))
    a, e, k = a + noise[0] * factor, e + noise[1] * factor, k + noise[2] * factor
    u, v, w = e * k - f * h, f * g - d * k, d * h - e * g
    det = a * u + b * v + c * w
    return [[u / det, (c * h - b * k) / det, (b * f - c * e) / det], [v / det, (a * k - c * g) / det, (c * d - a * f) / det], [w / det, (b * g - a * h) / det, (a * e - b * d) / det]]


def _correct(t: Track, at: int, inverse: Matrix, innovation: list[float]) -> None:
    """Take a measurement of the three state variables from `at` on."""
    (a, b, c), (d, e, f), (g, h, k) = inverse
    y0, y1, y2 = innovation
    first, second, third = t.p[at : at + 3]
    p = []
    for i, r in enumerate(t.p):
        u, v, w = r[at : at + 3]
        k0, k1, k2 = u * a + v * d + w * g, u * b + v * e + w * h, u * c + v * f + w * k
        t.x[i] += k0 * y0 + k1 * y1 + k2 * y2
        p.append([q - (k0 * q0 + k1 * q1 + k2 * q2) for q, q0, q1, q2 in zip(r, first, second, third)])  # noqa: B905
    t.p = p
    t.x[2] = _wrapped(t.x[2])


def _snap(t: Track, z: tuple[float, float, float], ts: float) -> None:
    t.x = [*map(float, z), 0.0, 0.0, 0.0]
    t.started, t.lifecycle, t.last_target = True, ACTIVE, ts


def step(t: Track, ts: float, z: tuple[float, float, float] | None, target: bool, config: Config = DEFAULT) -> tuple[bool, float | None]:
    """One frame: predict, then update in place. Returns (accepted, normalised innovation squared or None)."""
    dt = 0.1 if t.last_ts is None else max(0.01, ts - t.last_ts)
    t.last_ts = ts if t.last_ts is None else max(ts, t.last_ts)
    predict(t, dt)
    if z is None:
        if t.started:
            t.health, t.lifecycle = max(0.0, t.health - 5), COASTING
            if t.last_target is not None and ts - t.last_target > config.timeout_s:
                now = t.last_ts
                t.__init__()
                t.last_ts = now
        return False, None
    nis = None
    if t.started:
        y = [z[0] - t.x[0], z[1] - t.x[1], _wrapped(z[2] - t.x[2])]
        inverse = _inverse(t.p, 0, R, 1.0 if target else LOW_CONFIDENCE)
        y0, y1, y2 = y
        nis = sum(v * (r[0] * y0 + r[1] * y1 + r[2] * y2) for v, r in zip(y, inverse, strict=True))
    if target:
        _snap(t, z, ts)
        t.health = min(100.0, t.health + 25)
        return True, nis
    if not t.started:
        t.health = min(100.0, t.health + 5)
        if t.health > config.init_health:
            _snap(t, z, ts)
        return t.started, nis
    if nis > config.gate:
        t.health = max(0.0, t.health - 5)
        return False, nis
    t.health = min(100.0, t.health + 5)
    _correct(t, 0, inverse, y)
    t.still = hypot(t.x[3], t.x[4]) < 0.03 and t.last_target is not None and ts - t.last_target < 1.0
    if t.still:
        _correct(t, 3, _inverse(t.p, 3, STILL), [-v for v in t.x[3:]])
    return True, nis


OUTPUT = "track long, frame long, ts double, x double, y double, z double, yaw double, vx double, vy double, omega double, health double, lifecycle string, fsm_state int, still boolean, accepted boolean, nis double"
_COLUMNS = [c.split()[0] for c in OUTPUT.split(", ")]
_INPUT = ["frame", "ts", "px", "py", "yaw", "is_target", "z_ground"]


def _row(track: int, t: Track, frame: int | None, ts: float, z_ground: float, accepted: bool, nis: float | None) -> tuple:
    return (track, frame, ts, t.x[0], t.x[1], z_ground + HALF_HEIGHT, *t.x[2:], t.health, t.lifecycle, STATE_NUMBER[t.lifecycle], t.still, accepted, nis)


def fold(track: int, t: Track, rows: Iterable[tuple], config: Config = DEFAULT, end_after_s: float | None = None) -> Iterator[tuple]:
    """Output of the rows (in the order of _INPUT, by time) of one track. A track that has been silent for longer than end_after_s starts anew."""
    for frame, ts, px, py, yaw, is_target, z_ground in rows:
        if end_after_s is not None and t.last_ts is not None and ts - t.last_ts > end_after_s:
            t.__init__()
        z = None if px is None or isnan(px) else (px, py, yaw)
        accepted, nis = step(t, ts, z, z is not None and bool(is_target), config)
        yield _row(track, t, frame, ts, z_ground, accepted, nis)


def _inputs(fits: DataFrame) -> DataFrame:
    ground = F.coalesce(F.col("z_ground").cast("double"), F.lit(0.0)) if "z_ground" in fits.columns else F.lit(0.0)
    pose = [F.col(c).cast("double").alias(c) for c in ("px", "py", "yaw")]
    return fits.select(F.col("track").cast("long").alias("track"), F.col("frame").cast("long").alias("frame"), F.col("ts").cast("double").alias("ts"), *pose, F.coalesce("is_target", F.lit(False)).alias("is_target"), ground.alias("z_ground"))


_ARROW = pa.schema([(c.split()[0], {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}[c.split()[1]]) for c in OUTPUT.split(", ")])


def track_batch(fits: DataFrame, config: Config = DEFAULT, end_after_s: float | None = None) -> DataFrame:
    """Fold the frames (track, frame, ts seconds, px, py, yaw, is_target, z_ground if known) of each track in event order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, t = None, Track()
        for batch in batches:
            out = []
            tracks = batch.column("track").to_pylist()
            rows = zip(*(batch.column(c).to_pylist() for c in _INPUT), strict=True)
            for track, group in groupby(zip(tracks, rows, strict=True), key=lambda r: r[0]):
                if (track,) != last:
                    last, t = (track,), Track()
                out += fold(track, t, (r for _, r in group), config, end_after_s)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ARROW, strict=True)], schema=_ARROW) if out else pa.RecordBatch.from_pylist([], _ARROW)

    return _inputs(fits).repartition("track").sortWithinPartitions("track", "ts", "frame").mapInArrow(run, OUTPUT)


_STATE = "x array<double>, p array<array<double>>, started boolean, health double, lifecycle string, last_target double, last_ts double, still boolean"
#: Rows that came together, column by column: the store is called once for all of them and not once a row.
_WAITING = "track array<long>, frame array<long>, ts array<double>, px array<double>, py array<double>, yaw array<double>, is_target array<boolean>, z_ground array<double>"
_OUT_ROWS = 10_000  # of a frame of output
#: Keys of the state, among which tracks are dealt by their hash. A key's calls of the store and its pandas frames take some
#: milliseconds for one row or thousands of them, so a key for each track would take most of the time.
GROUPS = 1 << 10


class Tracker(StatefulProcessor):
    """A group of tracks in the state store: their filters as a map of typed values, and the rows ahead of the watermark as a list of their columns."""

    def __init__(self, config: Config, end_after_s: float | None):
        self.config, self.end_after_s = config, end_after_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tracks, self.waiting = handle.getMapState("tracks", "track long", _STATE), handle.getListState("waiting", _WAITING)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = None
        for frames in rows:
            frames = frames[frames["frame"].notna()].astype({"frame": "int64"})  # rows without a frame only move the clock
            if len(frames):
                columns = {c: [None if v != v else v for v in frames[c].tolist()] for c in ("track", *_INPUT)}
                self.waiting.appendValue(tuple(columns.values()))
                first = min(columns["ts"] if first is None else [first, *columns["ts"]])
        if first is not None:
            self._wake(first)
        return iter(())

    def _wake(self, ts: float, over: int = 0) -> None:
        """A timer for when the watermark reaches a time."""
        self.handle.registerTimer(ceil(ts * 1000) + over + AHEAD_MS)

    def _folded(self, due: list[tuple]) -> Iterator[tuple]:
        for track, rows in groupby(due, key=lambda r: r[0]):
            kept = self.tracks.getValue((track,))
            t = _track(kept) if kept else Track()
            yield from fold(track, t, (r[1:] for r in rows), self.config, self.end_after_s)
            self.tracks.updateValue((track,), astuple(t))

    def _ended(self, now: float) -> list[tuple]:
        """Last rows of the tracks that are silent, whose state is removed; a timer for the next that may be."""
        last = {track: t.last_ts for (track,), t in ((k, _track(v)) for k, v in self.tracks.iterator())}
        silent = {track: ts for track, ts in last.items() if now - ts > self.end_after_s}
        for track in silent:
            self.tracks.removeKey((track,))
        if len(silent) < len(last):
            self._wake(min(ts for track, ts in last.items() if track not in silent) + self.end_after_s, 1)
        return [_row(track, Track(), None, ts + self.end_after_s, 0.0, False, None) for track, ts in silent.items()]

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = (timerValues.getCurrentWatermarkInMs() - AHEAD_MS) / 1000
        rows = [r for columns in self.waiting.get() for r in zip(*columns, strict=True)]
        due, rest = [r for r in rows if r[2] <= now], [r for r in rows if r[2] > now]
        if due:
            due.sort(key=lambda r: (r[0], r[2], r[1]))
            yield from map(_frame, batched(self._folded(due), _OUT_ROWS))
            self.waiting.clear()
            for part in batched(rest, _OUT_ROWS):
                self.waiting.appendValue(tuple(map(list, zip(*part, strict=True))))
            if rest:
                self._wake(min(r[2] for r in rest))
        ended = self._ended(now) if self.end_after_s is not None else []
        if ended:
            yield _frame(ended)


def _track(kept: tuple) -> Track:
    x, p, *rest = kept
    return Track(list(x), [list(r) for r in p], *rest)


def _frame(rows: Iterable[tuple]) -> pd.DataFrame:
    return pd.DataFrame(dict(zip(_COLUMNS, zip(*rows, strict=True), strict=True))).astype({"nis": float})


@contextlib.contextmanager
def state_store(spark: SparkSession, partitions: int | None = None) -> Iterator[None]:
    """The state store that typed state and timers need, while a stream is started.

    `partitions` of it are opened and committed in every micro-batch; a checkpoint keeps the number it began with. By default these are
    the session's shuffle partitions.
    """
    settings = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
    if partitions is not None:
        settings["spark.sql.shuffle.partitions"] = str(partitions)
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def track_stream(fits: DataFrame, config: Config = DEFAULT, delay: str = "2 seconds", end_after_s: float | None = None, groups: int = GROUPS) -> DataFrame:
    """The same over a stream; to be started inside `state_store`.

    Rows may come up to `delay` out of order, later ones are dropped. A frame's row is put out when the watermark passes it; rows whose
    frame is null only move the clock. Where end_after_s is given, a track silent for longer puts out a last row without a frame, and its state is gone.
    A task holds the waiting rows of one of the `groups` of tracks at a time; a checkpoint keeps the number it began with.
    """
    rows = _inputs(fits).withColumn("at", F.timestamp_micros(F.floor(F.col("ts") * 1_000_000) + AHEAD_MS * 1000)).withWatermark("at", delay)
    rows = rows.withColumn("share", F.pmod(F.xxhash64("track"), F.lit(groups)))
    return rows.groupBy("share").transformWithStateInPandas(Tracker(config, end_after_s), OUTPUT, "Append", "EventTime")
