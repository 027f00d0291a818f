"""Grouped geometric features of point clusters, as two-pass aggregates."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.config import DEFAULT, Config
from pointloom.functions import geometry as g
from pointloom.operators.quantiles import exact_quantiles

P = ("x", "y", "z")
PAIRS = (("x", "x"), ("y", "y"), ("z", "z"), ("x", "y"), ("x", "z"), ("y", "z"))
SH0 = 0.28209479177387814  # fixed value: the constant spherical harmonic, 1 / (2 sqrt(pi))


def at_least(points: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    """The rows of groups with at least n rows."""
    large = points.groupBy(*by).count().filter(F.col("count") >= n)
    return points.join(large, list(by), "left_semi")


def centroid(points: DataFrame, by: Sequence[str]) -> DataFrame:
    return points.groupBy(*by).agg(*[F.avg(c).alias(f"m{c}") for c in P], F.count(F.lit(1)).alias("n"))


def extents(points: DataFrame, by: Sequence[str]) -> DataFrame:
    return points.groupBy(*by).agg(*[(F.max(c) - F.min(c)).alias(f"s{c}") for c in P])


def covariance(points: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sample covariances xx, yy, zz, xy, xz, yz."""
    return points.groupBy(*by).agg(*[F.covar_samp(a, b).alias(a + b) for a, b in PAIRS])


def volumetricity(points: DataFrame, by: Sequence[str], floor: float = 1e-6) -> DataFrame:
    """Share of the least eigenvalue of the covariance in their sum, each at least `floor`."""
    low, mid, high = (F.greatest(v, F.lit(floor)) for v in g.symmetric_eigenvalues(*[F.col(a + b) for a, b in PAIRS]))
    return covariance(points, by).select(*by, (low / (low + mid + high)).alias("volumetricity"))


def moments(points: DataFrame, by: Sequence[str]) -> DataFrame:
    """Additive moments n, sums and sums of products: merged by adding."""
    sums = [F.sum(c).alias(f"s{c}") for c in P] + [F.sum(F.col(a) * F.col(b)).alias(f"q{a}{b}") for a, b in PAIRS]
    return points.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *sums)


def moment_volume(n: Column, s: dict[str, Column], q: dict[str, Column], start: float) -> Column:
    """Root of the determinant (at least 1e-12) of the covariance plus start times the identity."""
    cov = [q[a + b] / n - s[a] / n * (s[b] / n) + (start if a == b else 0.0) for a, b in PAIRS]
    return F.sqrt(F.greatest(g.determinant(*cov), F.lit(1e-12)))


def merge_costs(stats: DataFrame, key: str, edges: DataFrame) -> DataFrame:
    """V(i and j) - V(i) - V(j) for the edges (i, j) between rows of a table of moments.

    Covariances start at 1e-6 of the identity, and a merge adds 1e-8 of it.
    """
    names = ["n", *[f"s{c}" for c in P], *[f"q{a}{b}" for a, b in PAIRS]]
    a = stats.select(F.col(key).alias("i"), *[F.col(c).alias(f"a_{c}") for c in names])
    b = stats.select(F.col(key).alias("j"), *[F.col(c).alias(f"b_{c}") for c in names])

    def volume(get, start: float = 1e-6) -> Column:
        return moment_volume(get("n"), {c: get(f"s{c}") for c in P}, {x + y: get(f"q{x}{y}") for x, y in PAIRS}, start)

    both = lambda c: F.col(f"a_{c}") + F.col(f"b_{c}")
    cost = volume(both, 1.01e-6) - volume(lambda c: F.col(f"a_{c}")) - volume(lambda c: F.col(f"b_{c}"))
    return edges.select("i", "j").join(a, "i").join(b, "j").select("i", "j", cost.alias("cost"))


def circle_fit(points: DataFrame, by: Sequence[str]) -> DataFrame:
    """Least-squares circle in the plane per group: centre, radius and rms; a singular system gives 0, 0, 0, 999."""
    means = points.groupBy(*by).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    u, v = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    centred = points.join(means, list(by)).withColumn("u", u).withColumn("v", v)
    uu, vv = F.col("u") * F.col("u"), F.col("v") * F.col("v")
    sums = centred.groupBy(*by).agg(
        F.avg(uu).alias("suu"), F.avg(vv).alias("svv"), F.avg(F.col("u") * F.col("v")).alias("suv"),
        F.avg(F.col("u") * (uu + vv)).alias("bu"), F.avg(F.col("v") * (uu + vv)).alias("bv"), F.avg(uu + vv).alias("s2"),
    )
    det = F.col("suu") * F.col("svv") - F.col("suv") * F.col("suv")
    good = F.abs(det) > 1e-12
    a = F.when(good, (F.col("bu") * F.col("svv") - F.col("bv") * F.col("suv")) / det / 2).otherwise(0.0)
    b = F.when(good, (F.col("suu") * F.col("bv") - F.col("suv") * F.col("bu")) / det / 2).otherwise(0.0)
    fit = sums.withColumn("a", a).withColumn("b", b).withColumn("good", good).withColumn("radius", F.when(good, F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b") + F.col("s2"))).otherwise(0.0))
    miss = F.sqrt(F.pow(F.col("u") - F.col("a"), 2) + F.pow(F.col("v") - F.col("b"), 2)) - F.col("radius")
    rms = centred.join(fit.select(*by, "a", "b", "radius"), list(by)).groupBy(*by).agg(F.sqrt(F.avg(miss * miss)).alias("fit_rms"))
    out = fit.join(means, list(by)).join(rms, list(by))
    return out.select(*by, F.when(F.col("good"), F.col("a") + F.col("mx")).otherwise(0.0).alias("cx"), F.when(F.col("good"), F.col("b") + F.col("my")).otherwise(0.0).alias("cy"), "radius", F.when(F.col("good"), F.col("fit_rms")).otherwise(999.0).alias("rms"))


def upright_box(points: DataFrame, by: Sequence[str], voxel: float) -> DataFrame:
    """Upright box per group: yaw of the first principal axis in the plane, centre, half-extents, solidity, height, longest axis.

    The yaw lies in (-pi/2, pi/2], which fixes the sign that eigenvectors leave open.
    """
    stats = points.groupBy(*by).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.covar_samp("x", "x").alias("cxx"), F.covar_samp("y", "y").alias("cyy"), F.covar_samp("x", "y").alias("cxy"), F.count(F.lit(1)).alias("n"))
    yaw = stats.withColumn("yaw", F.lit(0.5) * F.atan2(2 * F.col("cxy"), F.col("cxx") - F.col("cyy")))
    joined = points.join(yaw, list(by))
    u, v = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    c, s = F.cos("yaw"), F.sin("yaw")
    turned = joined.withColumn("p0", c * u + s * v).withColumn("p1", -s * u + c * v).withColumn("p2", F.col("z"))
    boxed = turned.groupBy(*by, "mx", "my", "yaw", "n").agg(*[f(f"p{i}").alias(f"{n}{i}") for i in range(3) for n, f in (("lo", F.min), ("hi", F.max))])
    e = [(F.col(f"hi{i}") - F.col(f"lo{i}")) / 2 for i in range(3)]
    m = [(F.col(f"hi{i}") + F.col(f"lo{i}")) / 2 for i in range(3)]
    volume = 8 * e[0] * e[1] * e[2]
    longest = F.when((e[0] >= e[1]) & (e[0] >= e[2]), 0).when(e[1] >= e[2], 1).otherwise(2)
    return boxed.select(
        *by, "n", "yaw", (F.col("mx") + c * m[0] - s * m[1]).alias("cx"), (F.col("my") + s * m[0] + c * m[1]).alias("cy"), m[2].alias("cz"),
        *[v.alias(f"e{i}") for i, v in enumerate(e)], (F.col("n") * voxel**3 / (volume + 1e-8)).alias("solidity"), (2 * e[2]).alias("height"), longest.alias("max_axis"),
    )


def extent_likelihood(sx: Column, sy: Column, sz: Column, mean: Sequence[float], sigma: Sequence[float]) -> Column:
    """Gaussian log-likelihood of extents, up to its constant."""
    return -0.5 * sum((F.pow((v - m) / s, 2) for v, m, s in zip((sx, sy, sz), mean, sigma, strict=True)), F.lit(0.0))


def adaptive_bounds(n: Column, r2: Column, config: Config = DEFAULT) -> tuple[Column, Column]:
    """(least volume, least solidity) that a cluster of n points at squared distance r2 must reach."""
    volume = config.v_nominal * (1 - F.exp(-config.gamma * n / (r2 + 1e-6)))
    solidity = config.rho_base / (1 + F.exp(-(n - config.n0) / config.kappa_n)) + config.rho_floor
    return volume, solidity


def resultant_bandwidth(normals: DataFrame, by: Sequence[str], base: float, least: float) -> DataFrame:
    """Bandwidth per group from the mean resultant length of its unit normals."""
    mean = normals.groupBy(*by).agg(*[F.avg(f"n{c}").alias(f"n{c}") for c in P])
    length = g.norm([F.col(f"n{c}") for c in P])
    return mean.select(*by, (base * F.least(F.greatest(length, F.lit(least / base)), F.lit(1.0))).alias("h"))


def radiometric_c0(points: DataFrame, by: Sequence[str], cos_eta: Column | None = None) -> DataFrame:
    """Mean range- and angle-corrected intensity times the constant harmonic; 0.5 stands for unknown angles."""
    r2 = sum((F.col(c) * F.col(c) for c in P), F.lit(0.0))
    angle = F.greatest(F.abs(cos_eta), F.lit(0.1)) if cos_eta is not None else F.lit(0.5)
    value = F.least(F.greatest(F.col("intensity") * F.least(r2, F.lit(6.25)) / angle, F.lit(0.0)), F.lit(255.0))
    return points.groupBy(*by).agg((SH0 * F.avg(value)).alias("c0"))


def fit_score(values: DataFrame, by: Sequence[str], column: str, sigma: float) -> DataFrame:
    """Mean squared residual over sigma^2, and the Gaussian log-likelihood per point."""
    square = F.avg(F.col(column) * F.col(column))
    return values.groupBy(*by).agg((square / sigma**2).alias("score"), (-0.5 * math.log(2 * math.pi * sigma**2) - square / (2 * sigma**2)).alias("log_likelihood"), (F.avg(F.abs(column)) * 1000).alias("mean_mm"))


def normal_equations(rows: DataFrame, by: Sequence[str], jacobian: Sequence[Column], residual: Column, huber: float) -> DataFrame:
    """Huber-weighted sums of J'J (upper triangle) and J'f per group."""
    w = F.when(F.abs(residual) <= huber, 1.0).otherwise(huber / F.abs(residual))
    n = len(jacobian)
    h = [F.sum(w * jacobian[i] * jacobian[j]).alias(f"h{i}{j}") for i in range(n) for j in range(i, n)]
    return rows.groupBy(*by).agg(*h, *[F.sum(w * jacobian[i] * residual).alias(f"g{i}") for i in range(n)])


def median_split(points: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """Rows with `upper`: whether their value exceeds the median of their group."""
    medians = exact_quantiles(points, by, column, [0.5]).select(*by, F.col("quantiles")[0].alias("median"))
    return points.join(medians, list(by)).withColumn("upper", F.col(column) > F.col("median"))


def best_by(rows: DataFrame, by: Sequence[str], score: str, key: str, keep: Sequence[str]) -> DataFrame:
    """Per group the row with the least score; ties take the least key."""
    best = F.min_by(F.struct(key, score, *keep), F.struct(score, key)).alias("best")
    return rows.groupBy(*by).agg(best).select(*by, "best.*")
