"""Registration of clusters to an implicit surface over planar poses (x, y, yaw)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from pointloom.config import DEFAULT, Config
from pointloom.operators.surface import Surface

P = ["x", "y", "z"]


def wrap(a: float) -> float:
    """The angle in (-pi, pi]."""
    return float(np.arctan2(np.sin(a), np.cos(a)))


def to_body(points: np.ndarray, pose: np.ndarray, z: float) -> np.ndarray:
    """World points in the frame of a body at (x, y, z) with a yaw."""
    c, s = np.cos(pose[2]), np.sin(pose[2])
    d = points - np.array([pose[0], pose[1], z])
    return np.column_stack([c * d[:, 0] + s * d[:, 1], -s * d[:, 0] + c * d[:, 1], d[:, 2]])


def score(surface: Surface, points: np.ndarray, pose: np.ndarray, z: float, sigma: float) -> float:
    """Mean squared field over sigma squared."""
    f, _ = surface.evaluate(to_body(points, pose, z))
    return float((f * f).mean() / sigma**2)


def gauss_newton(surface: Surface, points: np.ndarray, pose: np.ndarray, z: float, config: Config = DEFAULT, rounds: int | None = None) -> np.ndarray:
    """The pose after Huber-weighted Gauss-Newton steps with light damping; stops at steps under 1e-5."""
    pose = np.array(pose, float)
    for _ in range(rounds or config.newton_rounds):
        local = to_body(points, pose, z)
        f, g = surface.evaluate(local)
        c, s = np.cos(pose[2]), np.sin(pose[2])
        jacobian = np.column_stack([-(g[:, 0] * c - g[:, 1] * s), -(g[:, 0] * s + g[:, 1] * c), g[:, 0] * local[:, 1] - g[:, 1] * local[:, 0]])
        w = np.minimum(1.0, config.huber / np.maximum(np.abs(f), 1e-12))
        step = np.linalg.solve((jacobian * w[:, None]).T @ jacobian + 1e-4 * np.eye(3), -(jacobian * w[:, None]).T @ f)
        pose += step
        pose[2] = wrap(pose[2])
        if np.linalg.norm(step) < 1e-5:
            break
    return pose


def multistart(surface: Surface, points: np.ndarray, config: Config = DEFAULT, z: float | None = None) -> tuple[np.ndarray, float]:
    """Best (pose, score) over equally spaced yaws at the centroid, of which the best few are refined."""
    z = float(surface.centroid[2]) if z is None else z
    m = points.mean(axis=0)
    starts = [np.array([m[0], m[1], wrap(2 * np.pi * k / config.yaw_starts)]) for k in range(config.yaw_starts)]
    first = sorted(range(len(starts)), key=lambda k: (score(surface, points, starts[k], z, config.sigma_field), k))[: config.yaw_kept]
    fits = [gauss_newton(surface, points, starts[k], z, config, config.newton_rounds) for k in first]
    scores = [score(surface, points, p, z, config.sigma_field) for p in fits]
    best = int(np.argmin(scores))
    return fits[best], scores[best]


def register_clusters(points: DataFrame, surface: Surface, by: str = "frame_id", cluster: str = "cluster", config: Config = DEFAULT) -> DataFrame:
    """Pose and score of every cluster of at least ten points; `is_target` where the score is under the threshold.

    The surface (hundreds of primitives) travels with the task; clusters are dealt by frame and cluster.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < 10:
            return pd.DataFrame(columns=[by, cluster, "px", "py", "yaw", "score", "points", "is_target"])
        pose, s = multistart(surface, pdf.sort_values(P)[P].to_numpy(float), config)
        return pd.DataFrame({by: [pdf[by].iloc[0]], cluster: [pdf[cluster].iloc[0]], "px": [pose[0]], "py": [pose[1]], "yaw": [pose[2]], "score": [s], "points": [len(pdf)], "is_target": [s < config.score_threshold]})

    return points.select(by, cluster, *P).groupBy(by, cluster).applyInPandas(run, f"{by} long, {cluster} long, px double, py double, yaw double, score double, points long, is_target boolean")
