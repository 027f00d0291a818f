"""Motion-compensated accumulation of a target's points over its last frames."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pointloom.config import DEFAULT, Config
from pointloom.functions.geometry import c_turns


def accumulate(frames: DataFrame, config: Config = DEFAULT, reach_s: float = 1.0) -> DataFrame:
    """Per frame (track, frame, ts seconds, vx, vy, omega, points array<struct x, y, z, intensity>) its points and, behind
    them, those of its past frames from the oldest on, moved by the frame's velocity.

    A frame of at least buffer_trigger points stays alone. Past frames are those among the last
    buffer_window non-empty ones whose age lies in (1e-4, reach_s]. Over buffer_cap points,
    one point a voxel stays, counted from the cloud's least corner: its mean place and its first intensity.
    """
    full = frames.filter(F.size("points") > 0)
    w = W.partitionBy("track").orderBy("ts", "frame").rowsBetween(1 - config.buffer_window, -1)
    past = F.collect_list(F.struct("ts", "points")).over(w)
    kept = F.filter(past, lambda p: (F.col("ts") - p["ts"] > 1e-4) & (F.col("ts") - p["ts"] <= reach_s))

    def moved(p, k):
        tau = F.col("ts") - p["ts"]
        c, s = F.get("turns", k)["c"], F.get("turns", k)["s"]
        return F.transform(p["points"], lambda q: F.struct((c * q["x"] - s * q["y"] - F.col("vx") * tau).alias("x"), (s * q["x"] + c * q["y"] - F.col("vy") * tau).alias("y"), q["z"].alias("z"), q["intensity"].alias("intensity")))

    own = F.transform("points", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"), q["z"].alias("z"), q["intensity"].alias("intensity")))
    with_past = F.when(F.size("points") >= config.buffer_trigger, own).otherwise(F.concat(own, F.flatten(F.transform("past", moved))))
    turned = full.withColumn("past", kept).withColumn("turns", c_turns(F.transform("past", lambda p: -F.col("omega") * (F.col("ts") - p["ts"]))))
    clouds = turned.withColumn("cloud", with_past)
    low = lambda c: F.array_min(F.transform("cloud", lambda q: q[c])).alias(f"l{c}")
    rows = clouds.select("track", "frame", "ts", F.size("cloud").alias("n"), *map(low, "xyz"), F.posexplode("cloud").alias("i", "q"))
    rows = rows.select("track", "frame", "ts", "n", "i", "lx", "ly", "lz", "q.x", "q.y", "q.z", "q.intensity")
    v = config.buffer_voxel
    key = [F.when(F.col("n") > config.buffer_cap, F.floor((F.col(c) - F.col(f"l{c}")) / v)).otherwise(F.col("i") if c == "x" else 0).alias(f"v{c}") for c in "xyz"]
    cells = rows.select("*", *key).groupBy("track", "frame", "ts", "vx", "vy", "vz")
    return cells.agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("z").alias("z"), F.min_by("intensity", "i").alias("intensity")).select("track", "frame", "ts", "x", "y", "z", "intensity")


_FRAME_OUT = "track long, frame long, ts double, x double, y double, z double, intensity double"


def _cloud(frame, past: list, config: Config, reach_s: float) -> list[tuple[float, float, float, float]]:
    """One frame's accumulated points, as `accumulate` gives them."""
    rows = [(p["x"], p["y"], p["z"], p["intensity"]) for p in frame.points]
    if len(rows) < config.buffer_trigger:
        for ts, points in past:
            tau = frame.ts - ts
            if 1e-4 < tau <= reach_s:
                c, s = math.cos(-frame.omega * tau), math.sin(-frame.omega * tau)
                rows += [(c * x - s * y - frame.vx * tau, s * x + c * y - frame.vy * tau, z, i) for x, y, z, i in points]
    if len(rows) <= config.buffer_cap:
        return rows
    low = [min(r[k] for r in rows) for k in range(3)]
    cells: dict[tuple[int, int, int], list] = {}
    for r in rows:
        cells.setdefault(tuple(math.floor((v - m) / config.buffer_voxel) for v, m in zip(r[:3], low, strict=True)), []).append(r)
    return [(*(sum(r[k] for r in cell) / len(cell) for k in range(3)), cell[0][3]) for cell in cells.values()]


def accumulate_stream(frames: DataFrame, config: Config = DEFAULT, reach_s: float = 1.0) -> DataFrame:
    """The same over a stream: each track's state is its last buffer_window - 1 frames, in event order within a micro-batch."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        past = [(t, [tuple(p) for p in points]) for t, points in json.loads(state.get[0])] if state.exists else []
        out = []
        for frame in pd.concat(list(batches)).sort_values(["ts", "frame"]).itertuples():
            if frame.points is None or not len(frame.points):
                continue
            out += [(int(key[0]), frame.frame, frame.ts, *q) for q in _cloud(frame, past, config, reach_s)]
            past = [*past, (frame.ts, [(p["x"], p["y"], p["z"], p["intensity"]) for p in frame.points])][1 - config.buffer_window :]
        state.update((json.dumps(past),))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _FRAME_OUT.split(", ")])

    rows = frames.select("track", "frame", "ts", "vx", "vy", "omega", "points")
    return rows.groupBy("track").applyInPandasWithState(run, _FRAME_OUT, "past string", "append", GroupStateTimeout.NoTimeout)
