"""The three stages that chain the operators: offline candidates, static map, online tracking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.config import DEFAULT, Config
from pointloom.functions import geometry as g
from pointloom.operators import cluster as C
from pointloom.operators import features as A
from pointloom.operators import points as P
from pointloom.operators import spatial as S
from pointloom.operators.registration import register_clusters
from pointloom.operators.shells import agglomerate_frames, shell_table
from pointloom.operators.solids import cascade
from pointloom.operators.stage import staged
from pointloom.operators.surface import Surface
from pointloom.streaming.tracker import track_batch


def prior_valid(points: DataFrame, background: str, z0: float, threshold: float) -> DataFrame:
    """Per frame the mean height residual of its background points and whether the prior still fits it.

    The verdict is a column of each frame, not a state that one bad frame leaves behind.
    """
    means = points.filter(background).groupBy("frame_id").agg((F.avg("z") - z0).alias("residual"))
    return means.withColumn("prior_valid", F.abs("residual") <= 2 * threshold)


def level(points: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Points turned so that their dominant plane is horizontal, with its height z_ground."""
    plane = C.ransac_plane(points, config.ground_threshold, config.ransac_rounds)
    matrix = g.align_to_up([F.col("nx"), F.col("ny"), F.col("nz")])
    joined = points.crossJoin(F.broadcast(plane.drop("hypothesis", "inliers")))
    turned = dict(zip("xyz", g.rotate(matrix, [F.col(c) for c in "xyz"]), strict=True))
    inlier = F.abs(g.plane_offset([F.col("nx"), F.col("ny"), F.col("nz")], F.col("d"), [F.col(c) for c in "xyz"])) < config.ground_threshold
    moved = joined.withColumn("ground", inlier).withColumns(turned).drop("nx", "ny", "nz", "d")
    height = moved.filter("ground").agg(F.avg("z").alias("z_ground"))
    return moved.crossJoin(F.broadcast(height))


def offline_candidates(points: DataFrame, config: Config = DEFAULT, extent_mean=(0.38, 0.38, 0.42), reach: float = 0.5) -> DataFrame:
    """Accumulated points with labels: 0 ground, 1 structure, 2 candidate, 3 the body nearest to the expected extents.

    Blind spot and non-finite points go; the cloud is levelled, reduced by voxels, clustered and filtered; cluster
    labels reach all points through their nearest voxel point. Nothing passing leaves no label 3.
    """
    seen = P.outside_blind_spot(P.drop_nonfinite(P.fill_intensity(points, config.default_intensity)), config.blind_radius)
    cloud = staged(level(seen, config), "offline")
    free = cloud.filter("NOT ground").withColumn("frame_id", F.lit(0).cast("long"))
    reduced = staged(S.voxel_first(free, config.voxel).withColumnRenamed("first_id", "point_id").withColumn("frame_id", F.lit(0).cast("long")), "offline")
    clusters = C.dbscan(reduced, config.dbscan_eps, config.dbscan_min_points)
    members = staged(reduced.join(clusters.filter("cluster IS NOT NULL"), ["frame_id", "point_id"]), "offline")
    passing = staged(cascade(members, ["cluster"], config, extent_mean).filter("passes").select("cluster", F.lit(2).alias("label")), "offline")
    named = members.join(passing, "cluster", "left").withColumn("label", F.coalesce("label", F.lit(1)))
    nearest = S.nearest_label(free, named, 2 * config.voxel, "label").select("point_id", "label")
    labelled = free.join(nearest, "point_id", "left").withColumn("label", F.coalesce("label", F.lit(1)))
    sizes = A.extents(named.filter("label = 2"), ["cluster"]).join(A.centroid(named.filter("label = 2"), ["cluster"]), "cluster")
    far = sum((F.pow(F.col(f"s{c}") - m, 2) for c, m in zip("xyz", extent_mean, strict=True)), F.lit(0.0))
    centre = A.best_by(sizes.withColumn("far", far), [], "far", "cluster", ["mx", "my", "mz"]).select("mx", "my", "mz")
    promoted = S.ball_promote(labelled, centre, reach, 2, 3)
    columns = ["point_id", "x", "y", "z", "intensity", "label"]
    return promoted.select(*columns).unionByName(cloud.filter("ground").withColumn("label", F.lit(0)).select(*columns))


def static_map(labelled: DataFrame, config: Config = DEFAULT, voxel: float = 0.04, min_points: int = 50, solidity: float = 0.35) -> DataFrame:
    """Background shells from points labelled 1 or 2: reduced, agglomerated, split where hollow and merged again."""
    background = labelled.filter(F.col("label").isin(1, 2)).withColumn("frame_id", F.lit(0).cast("long"))
    reduced = S.voxel_first(background, voxel).withColumnRenamed("first_id", "point_id").withColumn("frame_id", F.lit(0).cast("long"))
    return shell_table(reduced.join(agglomerate_frames(reduced), ["frame_id", "point_id"]), voxel=voxel, solidity=solidity, min_points=min_points)


def online_candidates(points: DataFrame, shells: DataFrame, z_ground: float, config: Config = DEFAULT) -> DataFrame:
    """Clusters (frame_id, cluster, point_id, x, y, z) of what is neither blind, ground nor background; tall and wall-like ones go."""
    x, y, z = (F.col(c) for c in "xyz")
    seen = P.drop_nonfinite(points).filter((x * x + y * y >= config.blind_radius_online**2) & (F.abs(z - z_ground) >= config.ground_thickness + config.ground_margin))
    free = P.in_shells(seen, shells, config.shell_margin, config.shell_thin_margin, "left_anti")
    clusters = C.dbscan_per_frame(free, config.dbscan_eps, config.dbscan_min_points).filter("cluster IS NOT NULL")
    members = free.join(clusters, ["frame_id", "point_id"])
    large = staged(A.at_least(members, ["frame_id", "cluster"], config.min_cluster), "online")
    low = A.centroid(large, ["frame_id", "cluster"]).filter(F.col("mz") - z_ground <= config.max_height)
    walls = P.near_wall_share(large, shells, ["frame_id", "cluster"], config.shell_margin, config.shell_thin_margin).filter(F.col("share") > config.near_wall_share)
    return large.join(low, ["frame_id", "cluster"], "left_semi").join(walls, ["frame_id", "cluster"], "left_anti")


def online_tracking(frames: DataFrame, points: DataFrame, shells: DataFrame, surface: Surface, z_ground: float, config: Config = DEFAULT) -> DataFrame:
    """Tracks over frames (track, frame, ts seconds) from their points (frame_id = frame): register all clusters, keep the best, filter."""
    fits = register_clusters(online_candidates(points, shells, z_ground, config), surface, config=config)
    best = A.best_by(fits, ["frame_id"], "score", "cluster", ["px", "py", "yaw", "is_target"])
    rows = frames.join(best, frames["frame"] == best["frame_id"], "left")
    return track_batch(rows.select("track", "frame", "ts", "px", "py", "yaw", F.coalesce("is_target", F.lit(False)).alias("is_target"), F.lit(float(z_ground)).alias("z_ground")), config)
