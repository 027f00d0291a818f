"""An implicit surface from oriented points: compactly supported Hermite interpolation."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.config import DEFAULT, Config
from pointloom.operators.neighbours import nearest
from pointloom.operators.solids import hull_volume
from pointloom.operators.spatial import knn_within

P = ["x", "y", "z"]
EVALUATED = 1 << 18  # pairs of points and primitives held at once


def estimate_normals(points: DataFrame, k: int, radius: float, by: tuple[str, ...] = (), key: str = "point_id") -> DataFrame:
    """Unit normal of each point from its k nearest within radius, turned towards the origin; null under 3 neighbours.

    Neighbourhood moments are grouped sums; only the last step, batches of 3x3 eigenproblems, is vectorised Python.
    """
    near = knn_within(points, k, radius, by, key).select(F.col("i").alias(key), "j")
    at = near.join(points.select(F.col(key).alias("j"), *P), "j")
    pairs = [(a, b) for i, a in enumerate(P) for b in P[i:]]
    sums = at.groupBy(key).agg(F.count(F.lit(1)).alias("m"), *[F.covar_pop(a, b).alias(a + b) for a, b in pairs])

    def solve(batches):
        for pdf in batches:
            if len(pdf):
                c = np.array([[pdf["xx"], pdf["xy"], pdf["xz"]], [pdf["xy"], pdf["yy"], pdf["yz"]], [pdf["xz"], pdf["yz"], pdf["zz"]]], float).transpose(2, 0, 1)
                n = np.linalg.eigh(c)[1][:, :, 0]
                n *= np.where((n * pdf[P].to_numpy(float)).sum(axis=1) > 0, -1, 1)[:, None]
                n[pdf["m"].to_numpy() < 3] = np.nan
                yield pdf[[key]].assign(**{f"n{c}": n[:, i] for i, c in enumerate(P)})

    found = sums.join(points.select(key, *P), key).mapInPandas(solve, f"{key} long, nx double, ny double, nz double")
    return found.select(key, *[F.nanvl(c, F.lit(None)).alias(c) for c in ("nx", "ny", "nz")])


def kernel_parts(d: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, a, b) for differences d (..., 3): the gradient is a d, the Hessian a I + b d d'."""
    r = np.sqrt((d**2).sum(axis=-1))
    u = np.minimum(r / h, 1.0)
    v = 1 - u
    return v**4 * (4 * u + 1), -20 * v**3 / h**2, np.where(r > 1e-12, 60 * v**2 / (h**3 * np.maximum(r, 1e-12)), 0.0)


@dataclass
class Surface:
    """Primitives with their weights; `evaluate` gives the field and its gradient."""

    p: np.ndarray
    n: np.ndarray
    h: np.ndarray
    alpha_v: np.ndarray
    alpha_g: np.ndarray
    centroid: np.ndarray
    volume: float
    default: float = 0.08

    def evaluate(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        step = max(1, EVALUATED // len(self.p))
        if len(x) > step:
            parts = [self.evaluate(x[i : i + step]) for i in range(0, len(x), step)]
            return np.concatenate([f for f, _ in parts]), np.concatenate([g for _, g in parts])
        d = x[:, None, :] - self.p[None]
        value, a, b = kernel_parts(d, self.h)
        pull = (d * self.alpha_g).sum(axis=2)
        f = (value * self.alpha_v - a * pull).sum(axis=1)
        g = ((a * self.alpha_v - b * pull)[:, :, None] * d - a[:, :, None] * self.alpha_g).sum(axis=1)
        near = (np.sqrt((d**2).sum(axis=2)) < self.h).any(axis=1)
        return np.where(near, f, self.default), np.where(near[:, None], g, 0.0)


def hermite_matrix(p: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Covariance of values and gradients at p (4n x 4n), with the pairs' mean bandwidths."""
    n = len(p)
    d = p[:, None] - p[None]
    value, a, b = kernel_parts(d, (h[:, None] + h[None]) / 2)
    out = np.zeros((n, 4, n, 4))
    out[:, 0, :, 0] = value
    gradient = a[:, :, None] * d
    out[:, 1:, :, 0] = gradient.transpose(0, 2, 1)
    out[:, 0, :, 1:] = -gradient
    hessian = a[:, :, None, None] * np.eye(3) + b[:, :, None, None] * d[:, :, :, None] * d[:, :, None, :]
    out[:, 1:, :, 1:] = -hessian.transpose(0, 2, 1, 3)
    return out.reshape(4 * n, 4 * n)


def farthest(points: np.ndarray, m: int) -> np.ndarray:
    """Indices of m points, each farthest from those before it."""
    chosen, best = [0], ((points - points[0]) ** 2).sum(axis=1)
    while len(chosen) < min(m, len(points)):
        chosen.append(int(best.argmax()))
        best = np.minimum(best, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return np.array(chosen)


def build_surface(points: np.ndarray, normals: np.ndarray, m: int = 200, config: Config = DEFAULT, k: int = 12) -> Surface:
    """The surface with value 0 and the normal as gradient at m well-spread points (centred)."""
    centroid = points.mean(axis=0)
    x = points - centroid
    chosen = farthest(x, m)
    p, n = x[chosen], normals[chosen]
    resultant = np.linalg.norm(normals[nearest(x, min(k, len(x)), of=chosen)[0]].mean(axis=1), axis=1)
    h = config.bandwidth * np.clip(resultant, config.bandwidth_min / config.bandwidth, 1.0)
    noise = np.tile([config.sigma_field**2, *[config.sigma_gradient**2] * 3], len(p))
    matrix = hermite_matrix(p, h) + np.diag(noise + 1e-8)
    y = np.concatenate([np.zeros((len(p), 1)), n], axis=1).ravel()
    try:
        low = np.linalg.cholesky(matrix)
        alpha = np.linalg.solve(low.T, np.linalg.solve(low, y))
    except np.linalg.LinAlgError:  # mean bandwidths do not promise a definite matrix
        alpha = np.linalg.lstsq(matrix, y, rcond=None)[0]
    alpha = alpha.reshape(-1, 4)
    return Surface(p, n, h, alpha[:, 0], alpha[:, 1:], centroid, hull_volume(x) or 0.0, config.field_default)


_PRIMITIVES = "k int, px double, py double, pz double, nx double, ny double, nz double, h double, alpha_v double, alpha_gx double, alpha_gy double, alpha_gz double, mx double, my double, mz double, volume double"


def surface_table(points: DataFrame, by: str, m: int = 200, config: Config = DEFAULT) -> DataFrame:
    """Primitives of one surface per object from points with normals; an object of under 100 points has none."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna().sort_values(P)
        if len(pdf) < 100:
            return pd.DataFrame(columns=[by, *[c.split()[0] for c in _PRIMITIVES.split(", ")]])
        s = build_surface(pdf[P].to_numpy(float), pdf[["nx", "ny", "nz"]].to_numpy(float), m, config)
        rows = np.column_stack([s.p, s.n, s.h, s.alpha_v, s.alpha_g, np.tile(s.centroid, (len(s.p), 1)), np.full(len(s.p), s.volume)])
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in _PRIMITIVES.split(", ")[1:]])
        out.insert(0, "k", range(len(out)))
        out.insert(0, by, pdf[by].iloc[0])
        return out

    return points.select(by, *P, "nx", "ny", "nz").groupBy(by).applyInPandas(run, f"{by} long, {_PRIMITIVES}")


def surface_from_rows(rows: pd.DataFrame, default: float = 0.08) -> Surface:
    """A surface from its table of primitives."""
    rows = rows.sort_values("k")
    get = lambda *c: rows[list(c)].to_numpy(float)
    return Surface(get("px", "py", "pz"), get("nx", "ny", "nz"), get("h")[:, 0], get("alpha_v")[:, 0], get("alpha_gx", "alpha_gy", "alpha_gz"), get("mx", "my", "mz")[0], float(rows["volume"].iloc[0]), default)


def sign_change_cells(grid: DataFrame, value: str = "field") -> DataFrame:
    """Grid edges along x, y or z on which the field changes sign, with the crossing point: the zero level as points."""
    out = None
    for c in P:
        other = [o for o in P if o != c]
        nxt = grid.select(*[F.col(f"i{o}") for o in other], (F.col(f"i{c}") - 1).alias(f"i{c}"), F.col(value).alias("next"), F.col(c).alias("far"))
        met = grid.join(nxt, [f"i{o}" for o in P]).filter(F.signum(value) * F.signum("next") < 0)
        t = F.col(value) / (F.col(value) - F.col("next"))
        rows = met.select(F.lit(c).alias("along"), *[(F.col(c) + t * (F.col("far") - F.col(c))).alias(c) if o == c else F.col(o) for o in P])
        out = rows if out is None else out.unionByName(rows)
    return out
