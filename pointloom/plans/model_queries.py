"""Queries of the model-fitting and stateful operators, and the flagship pipeline; deterministic, without SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.config import Config
from pointloom.functions.geometry import c_turns
from pointloom.operators import cluster as C
from pointloom.operators import features as A
from pointloom.operators import points as P
from pointloom.operators import shells as H
from pointloom.operators import solids as V
from pointloom.operators import spatial as S
from pointloom.operators import surface as U
from pointloom.operators.registration import register_clusters
from pointloom.operators.stage import shared_dir
from pointloom.plans import feature_queries, point_queries  # noqa: F401  their SQL holds here too
from pointloom.plans.registry import ORACLES, query
from pointloom.plans.track_sql import FITS, track_sql
from pointloom.plans.views import PTS, SHELLS, big_pts, pts, shells, table
from pointloom.streaming.buffer import accumulate
from pointloom.streaming.tracker import OUTPUT as TRACK_OUTPUT
from pointloom.streaming.tracker import state_store, track_batch, track_stream

WIDE = Config(dbscan_eps=0.15, dbscan_min_points=6, body_extents=(0.8, 0.8, 0.8), volumetricity_min=0.1, bandwidth=0.12, buffer_cap=6, buffer_trigger=3)


def _rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier's frame of the large view, scaled to a room."""
    return big_pts(spark, sf_dir).withColumns({"x": F.col("x") / 5, "y": F.col("y") / 5, "z": F.col("z")})


def _cross(a: str, b: str) -> list[str]:
    """The cross product of (ax, ay, az) and (bx, by, bz)."""
    return [f"({a}{p} * {b}{q} - {a}{q} * {b}{p})" for p, q in ("yz", "zx", "xy")]


#: Faces of the hull are the triples with all other points of the frame on one side.
_HULL = f"""ends AS (SELECT a.frame_id, a.point_id AS i, b.point_id AS j, c.point_id AS k, a.x AS ax, a.y AS ay, a.z AS az, b.x - a.x AS ux, b.y - a.y AS uy, b.z - a.z AS uz, c.x - a.x AS vx, c.y - a.y AS vy, c.z - a.z AS vz
      FROM pts a JOIN pts b ON a.frame_id = b.frame_id AND a.point_id < b.point_id JOIN pts c ON a.frame_id = c.frame_id AND b.point_id < c.point_id),
    tri AS (SELECT frame_id, i, j, k, ax, ay, az, {', '.join(f'{v} AS n{c}' for v, c in zip(_cross('u', 'v'), 'xyz', strict=True))} FROM ends),
    faces AS (SELECT t.frame_id, i, j, k, any_value(ax) AS ax, any_value(ay) AS ay, any_value(az) AS az, any_value(nx) AS nx, any_value(ny) AS ny, any_value(nz) AS nz
      FROM tri t JOIN pts p ON p.frame_id = t.frame_id AND p.point_id NOT IN (i, j, k) GROUP BY t.frame_id, i, j, k HAVING min(nx * (x - ax) + ny * (y - ay) + nz * (z - az)) >= 0 OR max(nx * (x - ax) + ny * (y - ay) + nz * (z - az)) <= 0),
    middle AS (SELECT frame_id, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM pts GROUP BY frame_id),
    hulls AS (SELECT frame_id, sum(abs(nx * (mx - ax) + ny * (my - ay) + nz * (mz - az))) / 6 AS volume FROM faces JOIN middle USING (frame_id) GROUP BY frame_id)"""


@query(f"WITH {PTS}, {_HULL} SELECT frame_id, round(volume, 6) AS volume, true AS solid FROM hulls")
def hull_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.hull_volumes(pts(spark, sf_dir), ["frame_id"]).select("frame_id", F.round("volume", 6).alias("volume"), "solid")


def _planes_sql(name: str, source: str, threshold: float, rounds: int, seed: int) -> str:
    """`name`: each frame's plane (nx, ny, nz, d, inliers) of `source` with most inliers among hashed triples."""
    draws = ", ".join(f"{name}{k} AS (SELECT frame_id, point_id, x, y, z, row_number() OVER (PARTITION BY frame_id ORDER BY CAST('0x' || substr(md5(point_id || ',{seed},{k}'), 1, 15) AS BIGINT), point_id) AS hypothesis FROM {source})" for k in range(3))
    side = lambda k, v: ", ".join(f"s{k}.{c} - s0.{c} AS {v}{c}" for c in "xyz")
    return f"""{draws},
    {name}_v AS (SELECT frame_id, hypothesis, s0.x AS ax, s0.y AS ay, s0.z AS az, {side(1, 'u')}, {side(2, 'v')} FROM {name}0 s0 JOIN {name}1 s1 USING (frame_id, hypothesis) JOIN {name}2 s2 USING (frame_id, hypothesis)
      WHERE hypothesis <= {rounds} AND s0.point_id <> s1.point_id AND s1.point_id <> s2.point_id AND s0.point_id <> s2.point_id),
    {name}_r AS (SELECT *, {', '.join(f'{v} AS r{c}' for v, c in zip(_cross('u', 'v'), 'xyz', strict=True))} FROM {name}_v),
    {name}_k AS (SELECT *, CASE WHEN rz < 0 THEN -1.0 ELSE 1.0 END / sqrt(rx * rx + ry * ry + rz * rz) AS k FROM {name}_r WHERE rx * rx + ry * ry + rz * rz > 1e-24),
    {name}_p AS (SELECT frame_id, hypothesis, rx * k AS nx, ry * k AS ny, rz * k AS nz, -(rx * k * ax + ry * k * ay + rz * k * az) AS d FROM {name}_k),
    {name}_c AS (SELECT p.frame_id, p.hypothesis, any_value(nx) AS nx, any_value(ny) AS ny, any_value(nz) AS nz, any_value(d) AS d, count(*) FILTER (abs(nx * x + ny * y + nz * z + d) < {threshold}) AS inliers FROM {name}_p p JOIN {source} q ON q.frame_id = p.frame_id GROUP BY p.frame_id, p.hypothesis),
    {name} AS (SELECT * FROM {name}_c QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY inliers DESC, hypothesis) = 1)"""


_CORNERS = f"""sizes AS (SELECT frame_id, count(*) AS n FROM pts GROUP BY frame_id), large AS (SELECT pts.* FROM pts JOIN sizes USING (frame_id) WHERE n >= 20),
    {_planes_sql('first', 'large', 0.04, 30, 7)}, kept AS (SELECT * FROM first WHERE inliers >= 6),
    beside AS (SELECT l.* FROM large l JOIN kept f USING (frame_id) WHERE abs(nx * x + ny * y + nz * z + d) >= 0.04), rest AS (SELECT * FROM beside QUALIFY count(*) OVER (PARTITION BY frame_id) >= 6),
    {_planes_sql('second', 'rest', 0.04, 30, 8)},
    pairs AS (SELECT s.frame_id, (coalesce(f.inliers, 0) + coalesce(g.inliers, 0)) / s.n AS two_plane_share, degrees(acos(least(abs(f.nx * g.nx + f.ny * g.ny + f.nz * g.nz), 1.0))) AS angle FROM sizes s LEFT JOIN kept f ON f.frame_id = s.frame_id LEFT JOIN second g ON g.frame_id = s.frame_id),
    corners AS (SELECT frame_id, two_plane_share, coalesce(two_plane_share >= {WIDE.dihedral_share} AND angle BETWEEN {WIDE.dihedral_low_deg} AND {WIDE.dihedral_high_deg}, false) AS corner FROM pairs)"""


@query(f"WITH {PTS}, {_CORNERS} SELECT frame_id, round(two_plane_share, 6) AS two_plane_share, corner FROM corners")
def dihedral(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.corners(pts(spark, sf_dir), ["frame_id"]).select("frame_id", F.round("two_plane_share", 6).alias("two_plane_share"), "corner")


_VOLUMETRICITY = ORACLES["volumetricity"].replace("round(low / (low + mid + high), 6) AS volumetricity", "low / (low + mid + high) AS volumetricity")


@query(
    f"""WITH {PTS}, {_HULL}, {_CORNERS}, flat AS ({_VOLUMETRICITY}),
    boxes AS (SELECT frame_id, count(*) AS n, avg(x) ** 2 + avg(y) ** 2 + avg(z) ** 2 AS r2, -0.5 * (((max(x) - min(x) - 0.6) / 0.2) ** 2 + ((max(y) - min(y) - 0.6) / 0.2) ** 2 + ((max(z) - min(z) - 0.5) / 0.2) ** 2) AS likelihood FROM pts GROUP BY frame_id HAVING count(*) >= {WIDE.min_cluster}),
    judged AS (SELECT *, volume >= {WIDE.v_nominal} * (1 - exp(-{WIDE.gamma} * n / (r2 + 1e-6))) AND volume <= {WIDE.kappa_volume * math.prod(WIDE.body_extents)}
      AND n / greatest(volume, 1e-5) >= {WIDE.rho_base} / (1 + exp(-(n - {WIDE.n0}) / {WIDE.kappa_n})) + {WIDE.rho_floor} AS hull_ok FROM boxes JOIN hulls USING (frame_id) JOIN corners USING (frame_id) JOIN flat USING (frame_id))
    SELECT frame_id, n, round(volume, 6) AS volume, corner, hull_ok, hull_ok AND NOT corner AND volumetricity >= {WIDE.volumetricity_min} AND likelihood > -15.0 AS passes FROM judged"""
)
def cascade_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = V.cascade(pts(spark, sf_dir), ["frame_id"], WIDE, (0.6, 0.6, 0.5), (0.2, 0.2, 0.2))
    return found.select("frame_id", "n", F.round("volume", 6).alias("volume"), "corner", "hull_ok", "passes")


@query()
def mvi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.agglomerate_frames(pts(spark, sf_dir), radius=0.15, components=10)


@query()
def obb_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.shell_table(_rooms(spark, sf_dir).withColumn("cluster", F.lit(0)), merge=False).select("frame_id", "shell_id", "points", F.round("height", 6).alias("height"))


@query()
def shell_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.shell_table(_rooms(spark, sf_dir).withColumn("cluster", F.lit(0))).select("frame_id", "shell_id", "points", F.round("height", 6).alias("height"))


@query()
def normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = U.estimate_normals(pts(spark, sf_dir), 12, 0.15)
    return found.select("point_id", *[F.round(c, 5).alias(c) for c in ("nx", "ny", "nz")])


def _oriented(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = pts(spark, sf_dir).withColumn("object", F.lit(0).cast("long"))
    r = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    return points.withColumns({f"n{c}": F.col(c) / r for c in "xyz"}).withColumns({c: F.col(f"n{c}") * 0.3 for c in "xyz"})


@query()
def surface_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = U.surface_table(_oriented(spark, sf_dir), "object", 80, WIDE)
    return found.select("object", "k", *[F.round(c, 6).alias(c) for c in ("px", "py", "pz", "h")])


def _bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least box around the points of all frames, as one row."""
    return pts(spark, sf_dir).agg(*[f(c).alias(f"{n}{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))])


@query(ORACLES["grid_generate"])
def grid_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.regular_grid(_bounds(spark, sf_dir), 0.05, 0.05).select("ix", "iy", "iz", *[F.round(c, 6).alias(c) for c in "xyz"])


@query(ORACLES["fps_small"])
def fps_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.farthest_points(pts(spark, sf_dir), 8)


@query()
def surface_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zero-level points of a plane-like field over a regular grid."""
    grid = P.regular_grid(_bounds(spark, sf_dir), 0.05, 0.05).withColumn("field", F.col("x") + F.col("y") * 0.5 - F.col("z") * 0.25)
    return U.sign_change_cells(grid).select("along", *[F.round(c, 6).alias(c) for c in "xyz"])


@query(ORACLES["nn_label_join"])
def nn_label_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a narrow first radius, which doubles more often."""
    points = pts(spark, sf_dir)
    return S.nearest_label(points, points.withColumnRenamed("frame_id", "label"), 0.02, "label", others=True).select("point_id", "label", F.round("d", 6).alias("d"))


def _model_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The field of one surface, built from all points, at all points."""
    model = U.surface_table(_oriented(spark, sf_dir), "object", config=WIDE)
    return S.field_value(pts(spark, sf_dir), model.withColumns({f"p{c}": F.col(f"p{c}") + F.col(f"m{c}") for c in "xyz"}).select(*[f"p{c}" for c in "xyz"], "h", "alpha_v", *[f"alpha_g{c}" for c in "xyz"]), default=WIDE.field_default)


@query()
def field_value_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """field_value with the primitives of a fitted surface."""
    return _model_field(spark, sf_dir).select("point_id", F.round("field", 6).alias("field"))


@query()
def fit_score_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fit_score with the primitives of a fitted surface."""
    found = A.fit_score(_model_field(spark, sf_dir), ["frame_id"], "field", 0.5)
    return found.select("frame_id", *[F.round(c, 6).alias(c) for c in ("score", "log_likelihood")], F.round("mean_mm", 4).alias("mean_mm"))


@query()
def register_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-start registration of shifted clusters of one object to its surface."""
    rows = _oriented(spark, sf_dir).withColumn("x", F.col("x") + 1.0)
    model = U.surface_from_rows(U.surface_table(_oriented(spark, sf_dir), "object", 80, WIDE).toPandas(), WIDE.field_default)  # one object's primitives
    found = register_clusters(rows.withColumn("cluster", F.lit(0).cast("long")), model, config=WIDE)
    return found.select("frame_id", "cluster", "points", F.round("px", 3).alias("px"), F.round("py", 3).alias("py"), "is_target")


def _fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as fitted frames: a missing fit every seventh, a target every third."""
    k = F.col("event_id")
    seconds = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', cast(ts AS timestamp_ntz))") / 1e6 / 40000
    pose = lambda c: F.when(k % 7 != 0, c)
    turn = F.get(c_turns(F.array(seconds)), F.lit(0))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("track"), k.alias("frame"), seconds.alias("ts"), pose(turn["s"]).alias("px"), pose(turn["c"]).alias("py"), pose(F.col("value") / 100).alias("yaw"), (k % 3 == 0).alias("is_target"),
        (F.col("value") / 1000).alias("z_ground"),
    )


_TRACKED = ["track", "frame", "lifecycle", "fsm_state", "accepted"]


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*_TRACKED, *[(F.round(c, 6) + 0.0).alias(c) for c in ("x", "y", "z", "yaw", "health")], (F.round("nis", 4) + 0.0).alias("nis"))


@query(track_sql(), name="track_batch")
def tracked_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(track_batch(_fits(spark, sf_dir)))


@query(track_sql(), name="track_stream")
def tracked_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream over the same rows, in as many micro-batches as files, run to its end into a table."""
    folder = shared_dir(spark, "track-stream")
    fits = _fits(spark, sf_dir)
    # Every micro-batch opens and commits each partition of the state, filled or not: a few for each core are enough.
    partitions = min(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def taken(rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(fits.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{folder}/in")
        with state_store(spark, partitions):
            q = track_stream(stream, delay="100 days").writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
            q.awaitTermination()

    # The rows of an event table lie in its files in no order, so all wait until a last row without a frame moves the clock past them.
    # It comes once all rows are taken: files of one run come by their time of writing, which may be equal or of several clocks.
    taken(fits)
    clock = fits.agg(F.lit(-1).cast("long").alias("track"), (F.max("ts") + 1e9).alias("ts"))
    taken(fits.limit(0).unionByName(clock, allowMissingColumns=True))
    return _rounded(spark.read.schema(TRACK_OUTPUT).parquet(f"{folder}/out"))


def _buffer_sql() -> str:
    """The points of each frame behind its own two those of its last frames; over the cap, one point a voxel."""
    moved = "cos(-0.2 * tau) * px - sin(-0.2 * tau) * py - 0.1 * tau AS x, sin(-0.2 * tau) * px + cos(-0.2 * tau) * py AS y, z, intensity"
    corner = ", ".join(f"min({c}) OVER (PARTITION BY track, frame) AS l{c}" for c in "xyz")
    cell = ", ".join(f"CASE WHEN size > {WIDE.buffer_cap} THEN CAST(floor(({c} - l{c}) / {WIDE.buffer_voxel}) AS BIGINT) ELSE {'i' if c == 'x' else 0} END AS c{c}" for c in "xyz")
    return f"""WITH {FITS}, b AS (SELECT track, frame, ts, zx, zy, row_number() OVER (PARTITION BY track ORDER BY ts, frame) AS n FROM rows WHERE zx IS NOT NULL),
    p AS (SELECT track, frame, ts, n, k, zx + k * 0.1::DOUBLE AS px, zy AS py, 0.2::DOUBLE + k * 0.1::DOUBLE AS z, 100.0::DOUBLE + frame % 5 + k AS intensity FROM b, range(2) t(k)),
    h AS (SELECT b.track, b.frame, b.ts, (p.n - b.n + {WIDE.buffer_window}) * 2 + p.k AS i, b.ts - p.ts AS tau, px, py, z, intensity FROM b JOIN p ON p.track = b.track AND p.n BETWEEN b.n - {WIDE.buffer_window - 1} AND b.n - 1 WHERE b.ts - p.ts > 1e-4 AND b.ts - p.ts <= 1.0),
    cloud AS (SELECT track, frame, k AS i, px AS x, py AS y, z, intensity FROM p UNION ALL SELECT track, frame, i, {moved} FROM h),
    sized AS (SELECT *, count(*) OVER (PARTITION BY track, frame) AS size, {corner} FROM cloud), cells AS (SELECT *, {cell} FROM sized)
    SELECT track, frame, round(avg(x), 5) + 0.0 AS x, round(avg(y), 5) + 0.0 AS y, round(arg_min(intensity, i), 2) AS intensity FROM cells GROUP BY track, frame, cx, cy, cz"""


@query(_buffer_sql())
def motion_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _fits(spark, sf_dir).filter("px IS NOT NULL")
    point = lambda d: F.struct((F.col("px") + d).alias("x"), F.col("py").alias("y"), (F.lit(0.2) + F.lit(d)).alias("z"), (F.lit(100.0) + F.col("frame") % 5 + int(d > 0)).alias("intensity"))
    frames = rows.select("track", "frame", "ts", F.lit(0.1).alias("vx"), F.lit(0.0).alias("vy"), F.lit(0.2).alias("omega"), F.array(point(0.0), point(0.1)).alias("points"))
    return accumulate(frames, WIDE).select("track", "frame", (F.round("x", 5) + 0.0).alias("x"), (F.round("y", 5) + 0.0).alias("y"), F.round("intensity", 2).alias("intensity"))


def _ransac_sql(threshold: float, rounds: int, seed: int = 42) -> str:
    draws = ", ".join(f"s{k} AS (SELECT point_id, row_number() OVER (ORDER BY CAST('0x' || substr(md5(point_id || ',{seed},{k}'), 1, 15) AS BIGINT), point_id) AS hypothesis FROM pts)" for k in range(3))
    return f"""WITH {PTS}, {draws}, t AS (SELECT hypothesis, s0.point_id AS a, s1.point_id AS b, s2.point_id AS c FROM s0 JOIN s1 USING (hypothesis) JOIN s2 USING (hypothesis) WHERE hypothesis <= {rounds} AND s0.point_id <> s1.point_id AND s1.point_id <> s2.point_id AND s0.point_id <> s2.point_id),
    v AS (SELECT hypothesis, p.x AS ax, p.y AS ay, p.z AS az, q.x - p.x AS ux, q.y - p.y AS uy, q.z - p.z AS uz, r.x - p.x AS vx, r.y - p.y AS vy, r.z - p.z AS vz FROM t JOIN pts p ON p.point_id = a JOIN pts q ON q.point_id = b JOIN pts r ON r.point_id = c),
    m AS (SELECT *, uy * vz - uz * vy AS rx, uz * vx - ux * vz AS ry, ux * vy - uy * vx AS rz FROM v),
    k AS (SELECT *, CASE WHEN rz < 0 THEN -1.0 ELSE 1.0 END / sqrt(rx * rx + ry * ry + rz * rz) AS k FROM m WHERE rx * rx + ry * ry + rz * rz > 1e-24),
    planes AS (SELECT hypothesis, rx * k AS nx, ry * k AS ny, rz * k AS nz, -(rx * k * ax + ry * k * ay + rz * k * az) AS d FROM k),
    counted AS (SELECT *, (SELECT count(*) FROM pts WHERE abs(nx * x + ny * y + nz * z + d) < {threshold}) AS inliers FROM planes)
    SELECT round(nx, 6) + 0.0 AS nx, round(ny, 6) + 0.0 AS ny, round(nz, 6) + 0.0 AS nz, round(d, 6) + 0.0 AS d, inliers FROM counted ORDER BY inliers DESC, hypothesis LIMIT 1"""


@query(_ransac_sql(0.08, 100))
def ransac_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.ransac_plane(pts(spark, sf_dir), 0.08, 100)
    return found.select(*[(F.round(c, 6) + 0.0).alias(c) for c in ("nx", "ny", "nz", "d")], "inliers")


@query(ORACLES["dbscan"])
def dbscan_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.dbscan_per_frame(pts(spark, sf_dir), 0.15, 6)


def _flagship_sql() -> str:
    inside = " AND ".join(f"abs({' + '.join(f'a{i}{c} * ({c} - c{c})' for c in 'xyz')}) < e{i}" for i in range(3))
    steps = ORACLES["dbscan"].split("SELECT frame_id, point_id, cluster FROM pts LEFT JOIN labels")[0].replace("FROM pts a JOIN pts b", "FROM free a JOIN free b")
    head, near = steps.split(", near AS", 1)
    return f"""{head}, {SHELLS}, free AS (SELECT * FROM pts WHERE abs(z + 0.1) >= 0.03 AND NOT EXISTS (SELECT 1 FROM shells WHERE {inside})), near AS{near},
    members AS (SELECT free.*, cluster FROM free JOIN labels ON i = point_id),
    sizes AS (SELECT frame_id, cluster, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, round(0.5 * (((max(x) - min(x) - 0.4) / 0.1) ** 2 + ((max(y) - min(y) - 0.4) / 0.1) ** 2 + ((max(z) - min(z) - 0.4) / 0.1) ** 2), 6) AS score FROM members GROUP BY frame_id, cluster)
    SELECT frame_id, cluster, n, score, round(mx, 6) + 0.0 AS mx, round(my, 6) + 0.0 AS my, round(mz, 6) + 0.0 AS mz FROM sizes QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY score, cluster) = 1"""


@query(_flagship_sql())
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Align, drop ground and shells, cluster, and pick each frame's best cluster by its extents."""
    points = P.drop_nonfinite(pts(spark, sf_dir))
    free = points.filter(F.abs(F.col("z") + 0.1) >= 0.03)
    free = P.in_shells(free, shells(spark), 0.0, 0.0, "left_anti")
    clusters = C.dbscan_per_frame(free, WIDE.dbscan_eps, WIDE.dbscan_min_points)
    members = free.join(clusters.filter("cluster IS NOT NULL"), ["frame_id", "point_id"])
    sizes = A.centroid(members, ["frame_id", "cluster"]).join(A.extents(members, ["frame_id", "cluster"]), ["frame_id", "cluster"])
    likelihood = A.extent_likelihood(F.col("sx"), F.col("sy"), F.col("sz"), (0.4, 0.4, 0.4), (0.1, 0.1, 0.1))
    scored = sizes.withColumn("score", F.round(-likelihood, 6))
    best = A.best_by(scored, ["frame_id"], "score", "cluster", ["n", "mx", "my", "mz"])
    return best.select("frame_id", "cluster", "n", "score", *[(F.round(c, 6) + 0.0).alias(c) for c in ("mx", "my", "mz")])
