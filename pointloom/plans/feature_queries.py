"""Queries of the grouped, spatial and clustering operators, each with its DuckDB SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.functions import geometry as g
from pointloom.operators import cluster as C
from pointloom.operators import features as A
from pointloom.operators import spatial as S
from pointloom.plans.pipelines import prior_valid
from pointloom.plans.point_queries import r6
from pointloom.plans.registry import query
from pointloom.plans.views import BIG, PTS, SHELLS, big_pts, pts, shells

D = "sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)"


def _r(df: DataFrame, *columns: str) -> list:
    return [r6(F.col(c)).alias(c) for c in columns]


@query(f"WITH {PTS} SELECT a.frame_id, a.point_id AS i, b.point_id AS j, round({D}, 6) AS d FROM pts a JOIN pts b ON a.frame_id = b.frame_id AND a.point_id <> b.point_id AND {D} <= 0.1")
def eps_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.eps_pairs(pts(spark, sf_dir), 0.1, ["frame_id"]).select("frame_id", "i", "j", F.round("d", 6).alias("d"))


KNN = f"knn AS (SELECT * FROM (SELECT a.point_id AS i, b.point_id AS j, {D} AS d, row_number() OVER (PARTITION BY a.point_id ORDER BY {D}, b.point_id) AS rank FROM pts a JOIN pts b ON {D} <= 0.1) WHERE rank <= 6)"


@query(f"WITH {PTS}, {KNN} SELECT i, j, round(d, 6) AS d, CAST(rank AS INTEGER) AS rank FROM knn WHERE i < j")
def knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.knn_within(pts(spark, sf_dir), 6, 0.1).filter("i < j").select("i", "j", F.round("d", 6).alias("d"), "rank")


@query(f"WITH {PTS} SELECT a.point_id, arg_min(b.frame_id, struct_pack(d := {D}, j := b.point_id)) AS label, round(min({D}), 6) AS d FROM pts a JOIN pts b ON a.point_id <> b.point_id GROUP BY a.point_id")
def nn_label_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frame of each point's nearest other point."""
    points = pts(spark, sf_dir)
    return S.nearest_label(points, points.withColumnRenamed("frame_id", "label"), None, "label", others=True).select("point_id", "label", F.round("d", 6).alias("d"))


@query(f"WITH {PTS}, m AS (SELECT avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM pts WHERE frame_id = 2) SELECT point_id, CASE WHEN sqrt((x - mx) ** 2 + (y - my) ** 2 + (z - mz) ** 2) <= 0.2 THEN 3 ELSE 2 END AS label FROM pts, m")
def ball_promote(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = pts(spark, sf_dir)
    centre = A.centroid(points.filter("frame_id = 2"), []).select("mx", "my", "mz")
    return S.ball_promote(points.withColumn("label", F.lit(2)), centre, 0.2, 2, 3).select("point_id", "label")


@query(f"WITH {SHELLS} SELECT a.shell_id AS i, b.shell_id AS j FROM shells a JOIN shells b ON a.shell_id < b.shell_id AND sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2 + (a.cz - b.cz) ** 2) < greatest(a.e0, a.e1, a.e2) + greatest(b.e0, b.e1, b.e2) + 0.05")
def box_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.box_neighbours(shells(spark), 0.05).select("i", "j")


VOXEL = "l AS (SELECT frame_id, min(x) AS lx, min(y) AS ly, min(z) AS lz FROM big GROUP BY frame_id), k AS (SELECT big.*, CAST(floor((x - lx + {h}) / 0.5) AS BIGINT) AS vx, CAST(floor((y - ly + {h}) / 0.5) AS BIGINT) AS vy, CAST(floor((z - lz + {h}) / 0.5) AS BIGINT) AS vz FROM big JOIN l USING (frame_id))"


@query(f"WITH {BIG}, {VOXEL.format(h='0.0')} SELECT frame_id, vx, vy, vz, round(avg(x), 5) AS x, round(avg(z), 5) AS z, count(*) AS n FROM k GROUP BY ALL")
def voxel_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.voxel_mean(big_pts(spark, sf_dir), 0.5, ["frame_id"]).select("frame_id", "vx", "vy", "vz", F.round("x", 5).alias("x"), F.round("z", 5).alias("z"), "n")


@query(f"WITH {BIG}, {VOXEL.format(h='0.25')} SELECT frame_id, vx, vy, vz, min(point_id) AS first_id, round(arg_min(intensity, struct_pack(p := point_id, i := intensity)), 6) AS intensity FROM k GROUP BY frame_id, vx, vy, vz")
def voxel_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.voxel_first(big_pts(spark, sf_dir), 0.5, ["frame_id"]).select("frame_id", "vx", "vy", "vz", "first_id", F.round("intensity", 6).alias("intensity"))


@query(f"WITH {BIG}, {VOXEL.format(h='0.0')} SELECT frame_id, vx, vy, vz, list_sort(list(point_id)) AS members FROM k GROUP BY frame_id, vx, vy, vz")
def voxel_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.voxel_trace(big_pts(spark, sf_dir), 0.5, ["frame_id"])


@query(f"WITH {PTS} SELECT frame_id, round(avg(x), 6) + 0.0 AS mx, round(avg(y), 6) + 0.0 AS my, round(avg(z), 6) + 0.0 AS mz, count(*) AS n FROM pts GROUP BY frame_id")
def centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = A.centroid(pts(spark, sf_dir), ["frame_id"])
    return df.select("frame_id", *_r(df, "mx", "my", "mz"), "n")


@query(f"WITH {BIG} SELECT frame_id, round(max(x) - min(x), 5) AS sx, round((max(y) - min(y)) / 3, 5) AS sy, round(max(z) - min(z), 5) AS sz FROM big GROUP BY frame_id HAVING count(*) >= 12")
def extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = A.extents(A.at_least(big_pts(spark, sf_dir), ["frame_id"], 12), ["frame_id"])
    return df.select("frame_id", F.round("sx", 5).alias("sx"), F.round(F.col("sy") / 3, 5).alias("sy"), F.round("sz", 5).alias("sz"))


COV = ", ".join(f"covar_samp({a}, {b}) AS {a}{b}" for a, b in A.PAIRS)


@query(f"WITH {PTS}, c AS (SELECT frame_id, {COV} FROM pts GROUP BY frame_id) SELECT frame_id, " + ", ".join(f"round({a}{b}, 8) + 0.0 AS {a}{b}" for a, b in A.PAIRS) + " FROM c")
def covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.covariance(pts(spark, sf_dir), ["frame_id"]).select("frame_id", *[(F.round(a + b, 8) + 0.0).alias(a + b) for a, b in A.PAIRS])


@query(
    f"""WITH {PTS}, c AS (SELECT frame_id, {COV} FROM pts GROUP BY frame_id),
    q AS (SELECT *, (xx + yy + zz) / 3 AS q FROM c),
    p AS (SELECT *, sqrt(((xx - q) ** 2 + (yy - q) ** 2 + (zz - q) ** 2 + 2 * (xy ** 2 + xz ** 2 + yz ** 2)) / 6) AS p FROM q),
    e AS (SELECT *, acos(least(greatest((((xx - q) / p) * (((yy - q) / p) * ((zz - q) / p) - (yz / p) ** 2) - (xy / p) * ((xy / p) * ((zz - q) / p) - (yz / p) * (xz / p)) + (xz / p) * ((xy / p) * (yz / p) - ((yy - q) / p) * (xz / p))) / 2, -1.0), 1.0)) / 3 AS phi FROM p),
    v AS (SELECT frame_id, greatest(q + 2 * p * cos(phi + 2 * {math.pi} / 3), 1e-6) AS low, greatest(q + 2 * p * cos(phi), 1e-6) AS high, greatest(3 * q - (q + 2 * p * cos(phi)) - (q + 2 * p * cos(phi + 2 * {math.pi} / 3)), 1e-6) AS mid FROM e)
    SELECT frame_id, round(low / (low + mid + high), 6) AS volumetricity FROM v"""
)
def volumetricity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.volumetricity(pts(spark, sf_dir), ["frame_id"]).select("frame_id", F.round("volumetricity", 6).alias("volumetricity"))


def _det(n: str, s, q, start: str) -> str:
    c = {a + b: f"({q(a + b)} / {n} - {s(a)} / {n} * ({s(b)} / {n}) + {start if a == b else '0.0'})" for a, b in A.PAIRS}
    det = f"{c['xx']} * ({c['yy']} * {c['zz']} - {c['yz']} * {c['yz']}) - {c['xy']} * ({c['xy']} * {c['zz']} - {c['yz']} * {c['xz']}) + {c['xz']} * ({c['xy']} * {c['yz']} - {c['yy']} * {c['xz']})"
    return f"sqrt(greatest({det}, 1e-12))"


MOMENTS = "m AS (SELECT frame_id AS k, CAST(count(*) AS DOUBLE) AS n, " + ", ".join(f"sum({c}) AS s{c}" for c in "xyz") + ", " + ", ".join(f"sum({a} * {b}) AS q{a}{b}" for a, b in A.PAIRS) + " FROM pts GROUP BY frame_id)"


@query(
    f"WITH {PTS}, {MOMENTS} SELECT a.k AS i, b.k AS j, round("
    + _det("(a.n + b.n)", lambda c: f"(a.s{c} + b.s{c})", lambda c: f"(a.q{c} + b.q{c})", "1.01e-6") + " - " + _det("a.n", lambda c: f"a.s{c}", lambda c: f"a.q{c}", "1e-6") + " - " + _det("b.n", lambda c: f"b.s{c}", lambda c: f"b.q{c}", "1e-6")
    + ", 8) + 0.0 AS cost FROM m a JOIN m b ON a.k < b.k"
)
def moments_merge_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = A.moments(pts(spark, sf_dir), ["frame_id"])
    frames = stats.select(F.col("frame_id").alias("i"))  # the labels of the view: few
    edges = frames.join(frames.toDF("j"), F.col("i") < F.col("j"))
    return A.merge_costs(stats, "frame_id", edges).select("i", "j", (F.round("cost", 8) + 0.0).alias("cost"))


@query(
    f"""WITH {PTS}, m AS (SELECT frame_id, avg(x) AS mx, avg(y) AS my FROM pts GROUP BY frame_id),
    c AS (SELECT frame_id, x - mx AS u, y - my AS v, mx, my FROM pts JOIN m USING (frame_id)),
    s AS (SELECT frame_id, any_value(mx) AS mx, any_value(my) AS my, avg(u * u) AS suu, avg(v * v) AS svv, avg(u * v) AS suv, avg(u * (u * u + v * v)) AS bu, avg(v * (u * u + v * v)) AS bv, avg(u * u + v * v) AS s2 FROM c GROUP BY frame_id),
    f AS (SELECT *, (bu * svv - bv * suv) / (suu * svv - suv * suv) / 2 AS a, (suu * bv - suv * bu) / (suu * svv - suv * suv) / 2 AS b FROM s),
    r AS (SELECT *, sqrt(a * a + b * b + s2) AS radius FROM f)
    SELECT r.frame_id, round(any_value(a + r.mx), 6) + 0.0 AS cx, round(any_value(b + r.my), 6) + 0.0 AS cy, round(any_value(radius), 6) AS radius, round(sqrt(avg((sqrt((u - a) ** 2 + (v - b) ** 2) - radius) ** 2)), 6) AS rms FROM r JOIN c USING (frame_id) GROUP BY r.frame_id"""
)
def taubin_circle(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = A.circle_fit(pts(spark, sf_dir), ["frame_id"])
    return df.select("frame_id", *_r(df, "cx", "cy", "radius", "rms"))


@query(
    f"""WITH {PTS}, m AS (SELECT frame_id, avg(x) AS mx, avg(y) AS my, 0.5 * atan2(2 * covar_samp(x, y), covar_samp(x, x) - covar_samp(y, y)) AS yaw, count(*) AS n FROM pts GROUP BY frame_id),
    t AS (SELECT frame_id, n, yaw, cos(yaw) * (x - mx) + sin(yaw) * (y - my) AS p0, -sin(yaw) * (x - mx) + cos(yaw) * (y - my) AS p1, z AS p2 FROM pts JOIN m USING (frame_id)),
    b AS (SELECT frame_id, n, yaw, (max(p0) - min(p0)) / 2 AS e0, (max(p1) - min(p1)) / 2 AS e1, (max(p2) - min(p2)) / 2 AS e2 FROM t GROUP BY frame_id, n, yaw)
    SELECT frame_id, n, round(yaw, 6) AS yaw, round(e0, 6) AS e0, round(e1, 6) AS e1, round(e2, 6) AS e2, round(n * 0.05 ** 3 / (8 * e0 * e1 * e2 + 1e-8), 6) AS solidity,
    CASE WHEN e0 >= e1 AND e0 >= e2 THEN 0 WHEN e1 >= e2 THEN 1 ELSE 2 END AS max_axis FROM b"""
)
def upright_obb(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = A.upright_box(pts(spark, sf_dir), ["frame_id"], 0.05)
    return df.select("frame_id", "n", *_r(df, "yaw", "e0", "e1", "e2", "solidity"), "max_axis")


@query(f"WITH {PTS}, e AS (SELECT frame_id, max(x) - min(x) AS sx, max(y) - min(y) AS sy, max(z) - min(z) AS sz FROM pts GROUP BY frame_id), l AS (SELECT *, -0.5 * (((sx - 0.6) / 0.1) ** 2 + ((sy - 0.6) / 0.1) ** 2 + ((sz - 0.5) / 0.1) ** 2) AS ll FROM e) SELECT frame_id, round(ll, 6) AS log_likelihood, ll > -2.0 AS passes FROM l")
def extent_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    ll = A.extent_likelihood(F.col("sx"), F.col("sy"), F.col("sz"), (0.6, 0.6, 0.5), (0.1, 0.1, 0.1))
    return A.extents(pts(spark, sf_dir), ["frame_id"]).select("frame_id", F.round(ll, 6).alias("log_likelihood"), (ll > -2.0).alias("passes"))


@query(f"WITH {PTS}, c AS (SELECT frame_id, count(*) AS n, avg(x * x + y * y + z * z) AS r2 FROM pts GROUP BY frame_id) SELECT frame_id, round(0.005 * (1 - exp(-10 * n / (r2 * 1000 + 1e-6))), 8) AS min_volume, round(80 / (1 + exp(-(n - 30) / 5.0)) + 10, 6) AS min_solidity FROM c")
def adaptive_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    r2 = F.avg(sum((F.col(c) * F.col(c) for c in "xyz"), F.lit(0.0)))
    rows = pts(spark, sf_dir).groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"), r2.alias("r2"))
    volume, solidity = A.adaptive_bounds(F.col("n"), F.col("r2") * 1000)
    return rows.select("frame_id", F.round(volume, 8).alias("min_volume"), F.round(solidity, 6).alias("min_solidity"))


UNIT = "u AS (SELECT frame_id, point_id, x / l AS nx, y / l AS ny, z / l AS nz FROM (SELECT *, sqrt(x * x + y * y + z * z) AS l FROM pts))"


@query(f"WITH {PTS}, {UNIT} SELECT frame_id, round(0.06 * least(greatest(sqrt(avg(nx) ** 2 + avg(ny) ** 2 + avg(nz) ** 2), 0.25), 1.0), 6) AS h FROM u GROUP BY frame_id")
def resultant_bandwidth(spark: SparkSession, sf_dir: str) -> DataFrame:
    length = g.norm([F.col(c) for c in "xyz"])
    normals = pts(spark, sf_dir).select("frame_id", *[(F.col(c) / length).alias(f"n{c}") for c in "xyz"])
    return A.resultant_bandwidth(normals, ["frame_id"], 0.06, 0.015).select("frame_id", F.round("h", 6).alias("h"))


@query(f"WITH {BIG} SELECT frame_id, round(0.28209479177387814 * avg(least(greatest(intensity * least(x * x + y * y + z * z, 6.25) / 0.5, 0.0), 255.0)), 6) AS c0 FROM big GROUP BY frame_id")
def radiometric_c0(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.radiometric_c0(big_pts(spark, sf_dir), ["frame_id"]).select("frame_id", F.round("c0", 6).alias("c0"))


PRIMS = "prims AS (SELECT point_id AS k, x AS px, y AS py, z AS pz, 0.12::DOUBLE AS h, 0.5 + intensity AS alpha_v, x AS alpha_gx, y AS alpha_gy, z AS alpha_gz FROM pts)"
FIELD = f"""t AS (SELECT pts.frame_id, pts.point_id, sqrt((x - px) ** 2 + (y - py) ** 2 + (z - pz) ** 2) AS r, h, alpha_v, (x - px) * alpha_gx + (y - py) * alpha_gy + (z - pz) * alpha_gz AS pull FROM pts JOIN prims ON sqrt((x - px) ** 2 + (y - py) ** 2 + (z - pz) ** 2) < h),
    s AS (SELECT point_id, sum((1 - r / h) ** 4 * (4 * r / h + 1) * alpha_v - CASE WHEN r > 1e-9 THEN -20 * (r / h) * (1 - r / h) ** 3 / h / r ELSE 0 END * pull) AS field FROM t GROUP BY point_id),
    f AS (SELECT pts.frame_id, pts.point_id, coalesce(field, 0.08) AS field FROM pts LEFT JOIN s USING (point_id))"""


def _field(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = pts(spark, sf_dir)
    prims = points.select(*[F.col(c).alias(f"p{c}") for c in "xyz"], F.lit(0.12).alias("h"), (0.5 + F.col("intensity")).alias("alpha_v"), *[F.col(c).alias(f"alpha_g{c}") for c in "xyz"])
    return S.field_value(points, prims)


@query(f"WITH {PTS}, {PRIMS}, {FIELD} SELECT point_id, round(field, 6) + 0.0 AS field FROM f")
def field_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _field(spark, sf_dir).select("point_id", r6(F.col("field")).alias("field"))


@query(f"WITH {PTS}, {PRIMS}, {FIELD} SELECT frame_id, round(avg(field * field) / 0.25, 6) AS score, round(-0.5 * ln(2 * {math.pi} * 0.25) - avg(field * field) / 0.5, 6) + 0.0 AS log_likelihood, round(avg(abs(field)) * 1000, 4) AS mean_mm FROM f GROUP BY frame_id")
def fit_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = A.fit_score(_field(spark, sf_dir), ["frame_id"], "field", 0.5)
    return df.select("frame_id", *_r(df, "score", "log_likelihood"), F.round("mean_mm", 4).alias("mean_mm"))


@query(
    f"WITH {PTS}, w AS (SELECT *, z AS f, CASE WHEN abs(z) <= 0.03 THEN 1.0 ELSE 0.03 / abs(z) END AS w FROM pts) SELECT frame_id, "
    + ", ".join(f"round(sum(w * {a} * {b}), 6) + 0.0 AS h{i}{j}" for i, a in enumerate(("x", "y", "1.0")) for j, b in enumerate(("x", "y", "1.0")) if i <= j)
    + ", " + ", ".join(f"round(sum(w * {a} * f), 6) + 0.0 AS g{i}" for i, a in enumerate(("x", "y", "1.0"))) + " FROM w GROUP BY frame_id"
)
def normal_equations(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = A.normal_equations(pts(spark, sf_dir), ["frame_id"], [F.col("x"), F.col("y"), F.lit(1.0)], F.col("z"), 0.03)
    return df.select("frame_id", *_r(df, *df.columns[1:]))


@query(f"WITH {PTS}, c AS (SELECT frame_id % 3 AS frame_id, frame_id AS cluster_id, avg(z * z) AS score FROM pts GROUP BY ALL HAVING count(*) >= 10) SELECT frame_id, arg_min(cluster_id, struct_pack(s := score, c := cluster_id)) AS cluster_id, round(min(score), 8) AS score FROM c GROUP BY frame_id")
def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = A.at_least(pts(spark, sf_dir), ["frame_id"], 10).groupBy((F.col("frame_id") % 3).alias("frame"), F.col("frame_id").alias("cluster_id")).agg(F.avg(F.col("z") * F.col("z")).alias("score"))
    return A.best_by(scores, ["frame"], "score", "cluster_id", []).select(F.col("frame").alias("frame_id"), "cluster_id", F.round("score", 8).alias("score"))


@query(f"WITH {PTS}, e AS (SELECT frame_id, max(x) - min(x) AS sx, max(y) - min(y) AS sy, max(z) - min(z) AS sz FROM pts GROUP BY frame_id), d AS (SELECT frame_id, sqrt((sx - 0.38) ** 2 + (sy - 0.38) ** 2 + (sz - 0.42) ** 2) AS d FROM e) SELECT arg_min(frame_id, d) AS frame_id, round(min(d), 6) AS distance FROM d")
def auto_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.sqrt(F.pow(F.col("sx") - 0.38, 2) + F.pow(F.col("sy") - 0.38, 2) + F.pow(F.col("sz") - 0.42, 2))
    rows = A.extents(pts(spark, sf_dir), ["frame_id"]).withColumn("distance", d)
    return A.best_by(rows, [], "distance", "frame_id", []).select("frame_id", F.round("distance", 6).alias("distance"))


@query(f"WITH {BIG}, m AS (SELECT frame_id, quantile_cont(y, 0.5) AS median FROM big GROUP BY frame_id) SELECT frame_id, point_id, y > median AS upper FROM big JOIN m USING (frame_id)")
def median_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.median_split(big_pts(spark, sf_dir), ["frame_id"], "y").select("frame_id", "point_id", "upper")


CELL = f"cells AS (SELECT frame_id, u, v, max(point_id) AS point_id, arg_max(r, point_id) AS r FROM (SELECT *, sqrt(x * x + y * y + z * z) AS r, CAST(least(greatest(floor((atan2(y, x) + {math.pi}) / (2 * {math.pi}) * 24), 0), 23) AS INTEGER) AS u, CAST(least(greatest(floor((asin(least(greatest(z / greatest(sqrt(x * x + y * y + z * z), 1e-6), -1.0), 1.0)) + {math.pi} / 2) / {math.pi} * 12), 0), 11) AS INTEGER) AS v FROM pts) GROUP BY frame_id, u, v)"
_SU, _SV = 2 * math.pi / 24, math.pi / 12
EDGES = f"""e AS (SELECT DISTINCT a.frame_id, least(a.point_id, b.point_id) AS i, greatest(a.point_id, b.point_id) AS j FROM cells a JOIN (VALUES (0, 1), (1, -1), (1, 0), (1, 1)) o(dv, du) ON TRUE JOIN cells b ON a.frame_id = b.frame_id AND b.v = a.v + dv AND b.u = (a.u + du + 24) % 24 AND a.point_id <> b.point_id
    WHERE atan2(least(a.r, b.r) * sin(sqrt((du * {_SU}) ** 2 + (dv * {_SV}) ** 2)), greatest(a.r, b.r) - least(a.r, b.r) * cos(sqrt((du * {_SU}) ** 2 + (dv * {_SV}) ** 2))) > {math.radians(25.0)})"""


@query(f"WITH {PTS}, {CELL} SELECT frame_id, u, v, point_id, round(r, 6) AS r FROM cells")
def range_image_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.range_image(pts(spark, sf_dir), 24, 12).select("frame_id", "u", "v", "point_id", F.round("r", 6).alias("r"))


@query(f"WITH {PTS}, {CELL}, {EDGES} SELECT * FROM e")
def range_image_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.range_edges(C.range_image(pts(spark, sf_dir), 24, 12), 24, 12, 25.0)


@query(
    f"""WITH RECURSIVE {PTS}, {CELL}, {EDGES}, two AS (SELECT i, j FROM e UNION ALL SELECT j, i FROM e),
    reach(a, b) AS (SELECT point_id, point_id FROM cells UNION SELECT r.a, t.j FROM reach r JOIN two t ON r.b = t.i),
    roots AS (SELECT a AS point_id, min(b) AS segment FROM reach GROUP BY a),
    binned AS (SELECT frame_id, point_id, CAST(least(greatest(floor((atan2(y, x) + {math.pi}) / (2 * {math.pi}) * 24), 0), 23) AS INTEGER) AS u, CAST(least(greatest(floor((asin(least(greatest(z / greatest(sqrt(x * x + y * y + z * z), 1e-6), -1.0), 1.0)) + {math.pi} / 2) / {math.pi} * 12), 0), 11) AS INTEGER) AS v FROM pts),
    s AS (SELECT b.frame_id, b.point_id, segment FROM binned b JOIN cells c USING (frame_id, u, v) JOIN roots ON roots.point_id = c.point_id)
    SELECT * FROM s WHERE segment IN (SELECT segment FROM s GROUP BY segment HAVING count(*) >= 5)"""
)
def range_image_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.range_components(pts(spark, sf_dir), 24, 12, 25.0, 5)


NEAR = f"near AS (SELECT a.frame_id, a.point_id AS i, b.point_id AS j FROM pts a JOIN pts b ON a.frame_id = b.frame_id AND {D} <= 0.15)"


@query(
    f"""WITH RECURSIVE {PTS}, {NEAR}, core AS (SELECT i FROM near GROUP BY i HAVING count(*) >= 6),
    links AS (SELECT i, j FROM near WHERE i IN (SELECT i FROM core) AND j IN (SELECT i FROM core)),
    reach(a, b) AS (SELECT i, i FROM core UNION SELECT r.a, l.j FROM reach r JOIN links l ON r.b = l.i),
    roots AS (SELECT a AS i, min(b) AS cluster FROM reach GROUP BY a),
    border AS (SELECT n.j AS i, min(cluster) AS cluster FROM near n JOIN roots USING (i) WHERE n.j NOT IN (SELECT i FROM core) GROUP BY n.j),
    labels AS (SELECT * FROM roots UNION ALL SELECT * FROM border)
    SELECT frame_id, point_id, cluster FROM pts LEFT JOIN labels ON i = point_id"""
)
def dbscan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.dbscan(pts(spark, sf_dir), 0.15, 6)


@query(
    f"""WITH {PTS}, knn AS (SELECT * FROM (SELECT a.frame_id, a.point_id AS i, {D} AS d, row_number() OVER (PARTITION BY a.point_id ORDER BY {D}, b.point_id) AS rank FROM pts a JOIN pts b ON a.frame_id = b.frame_id AND {D} <= 0.5) WHERE rank <= 8),
    m AS (SELECT frame_id, i, avg(d) AS mean_d FROM knn GROUP BY ALL), s AS (SELECT frame_id, avg(mean_d) AS mu, stddev_samp(mean_d) AS sigma FROM m GROUP BY frame_id)
    SELECT frame_id, i AS point_id, round(mean_d, 6) AS mean_d FROM m JOIN s USING (frame_id) WHERE mean_d <= mu + sigma"""
)
def outlier_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.remove_outliers(pts(spark, sf_dir), 8, 0.5, 1.0, ["frame_id"]).select("frame_id", "point_id", F.round("mean_d", 6).alias("mean_d"))


TRIPLES = "triples AS (SELECT hypothesis, hypothesis * 7 % 97 AS a, 100 + hypothesis * 13 % 89 AS b, 200 + hypothesis * 29 % 83 AS c FROM range(1, 31) t(hypothesis))"


@query(
    f"""WITH {PTS}, {TRIPLES}, v AS (SELECT hypothesis, p.x AS ax, p.y AS ay, p.z AS az, q.x - p.x AS ux, q.y - p.y AS uy, q.z - p.z AS uz, r.x - p.x AS vx, r.y - p.y AS vy, r.z - p.z AS vz FROM triples JOIN pts p ON p.point_id = a JOIN pts q ON q.point_id = b JOIN pts r ON r.point_id = c),
    n AS (SELECT *, uy * vz - uz * vy AS rx, uz * vx - ux * vz AS ry, ux * vy - uy * vx AS rz FROM v),
    k AS (SELECT *, CASE WHEN rz < 0 THEN -1.0 ELSE 1.0 END / sqrt(rx * rx + ry * ry + rz * rz) AS k FROM n),
    planes AS (SELECT hypothesis, rx * k AS nx, ry * k AS ny, rz * k AS nz, -(rx * k * ax + ry * k * ay + rz * k * az) AS d FROM k)
    SELECT hypothesis, round(nx, 5) + 0.0 AS nx, round(nz, 5) + 0.0 AS nz, round(d, 5) + 0.0 AS d, (SELECT count(*) FROM pts WHERE abs(nx * x + ny * y + nz * z + d) < 0.05) AS inliers FROM planes"""
)
def ransac_fixed_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("id")
    triples = spark.range(1, 31).select(h.alias("hypothesis"), (h * 7 % 97).alias("a"), (100 + h * 13 % 89).alias("b"), (200 + h * 29 % 83).alias("c"))
    points = pts(spark, sf_dir)
    found = C.count_inliers(points, C.triple_planes(points, triples), 0.05)
    return found.select("hypothesis", *[(F.round(c, 5) + 0.0).alias(c) for c in ("nx", "nz", "d")], "inliers")


@query(
    f"""WITH RECURSIVE {PTS}, f(frame_id, rank, ids) AS (SELECT frame_id, 1::BIGINT, [min(point_id)] FROM pts GROUP BY frame_id UNION ALL
      SELECT frame_id, rank + 1, list_append(ids, arg_max(point_id, struct_pack(d := d, k := -point_id))) FROM (
        SELECT f.frame_id, f.rank, f.ids, a.point_id, min((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d
        FROM f JOIN pts a ON a.frame_id = f.frame_id AND NOT list_contains(f.ids, a.point_id) JOIN pts b ON b.frame_id = f.frame_id AND list_contains(f.ids, b.point_id)
        WHERE f.rank < 8 GROUP BY f.frame_id, f.rank, f.ids, a.point_id) GROUP BY frame_id, rank, ids)
    SELECT frame_id, rank, ids[rank] AS point_id FROM f"""
)
def fps_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.farthest_points(pts(spark, sf_dir), 8)


@query(f"WITH {PTS}, {KNN}, a AS (SELECT list_sort(list(j)) AS s FROM knn WHERE i = 3), b AS (SELECT list_sort(list(j)) AS s FROM knn WHERE i = (SELECT max(j) FROM knn WHERE i = 3)) SELECT list_sort(list_distinct(list_concat(a.s, b.s))) AS merged, list_sort(list_filter(a.s, lambda x: NOT list_contains(b.s, x))) AS only_a FROM a, b")
def neighbour_set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = S.knn_within(pts(spark, sf_dir), 6, 0.1).select("i", "j")
    other = pairs.filter("i = 3").agg(F.max("j").alias("m"))
    joined = pairs.crossJoin(F.broadcast(other))
    own = joined.filter("i = 3").agg(F.collect_set("j").alias("a"))
    its = joined.filter("i = m").agg(F.collect_set("j").alias("b"))
    return own.crossJoin(its).select(F.array_sort(F.array_union("a", "b")).alias("merged"), F.array_sort(F.array_except("a", "b")).alias("only_a"))


@query(f"WITH {PTS} SELECT frame_id, round(avg(z) + 0.01, 6) + 0.0 AS residual, abs(avg(z) + 0.01) <= 2 * 0.005 AS prior_valid FROM pts WHERE abs(x) > 0.05 GROUP BY frame_id")
def drift_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = prior_valid(pts(spark, sf_dir), "abs(x) > 0.05", -0.01, 0.005)
    return found.select("frame_id", r6(F.col("residual")).alias("residual"), "prior_valid")


@query(f"WITH {PTS}, {UNIT}, {KNN} SELECT i AS point_id, round(0.06 * least(greatest(sqrt(avg(nx) ** 2 + avg(ny) ** 2 + avg(nz) ** 2), 0.25), 1.0), 6) AS h FROM knn JOIN u ON u.point_id = j GROUP BY i")
def knn_bandwidth(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = pts(spark, sf_dir)
    length = g.norm([F.col(c) for c in "xyz"])
    normals = points.select(F.col("point_id").alias("j"), *[(F.col(c) / length).alias(f"n{c}") for c in "xyz"])
    near = S.knn_within(points, 6, 0.1).select(F.col("i").alias("point_id"), "j").join(normals, "j")
    return A.resultant_bandwidth(near, ["point_id"], 0.06, 0.015).select("point_id", F.round("h", 6).alias("h"))
