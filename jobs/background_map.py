"""Incremental job: the voxel map of a room's background, from recordings that keep arriving.

    python -m jobs.background_map --config jobs/background_map.json --input points/ --output map/ --checkpoint ckpt/

Reads the point files of a folder as a stream with `availableNow`, so a run takes the files that the checkpoint does not know and
ends. Points that are not finite or lie in the sensor's blind spot go; the others are summed by voxel. A micro-batch writes its
sums to `parts` (partitioned by tile and batch) and then renews the map of the tiles it touched from all their parts:
one row a voxel with its points, mean place and intensity, first and last frame, and a label (0 ground, 1 structure: seen
often enough, 2 candidate). `map` is partitioned by tile; tiles without new points are neither read nor written.

Sums are whole micrometres, so neither the order of files nor their split over runs changes a row. A micro-batch that is run again
replaces its own partitions with the same rows. Checkpoint and output belong together: delete both or none. Null places count as not finite, null
intensities as `default_intensity`; rows without a frame count with frame null; an empty folder gives an empty map.
"""

from __future__ import annotations

import logging
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import checked, counted, main, read_config
from pointloom.operators import points as P

log = logging.getLogger("background_map")

#: `columns` are SQL expressions over the input; lengths are metres.
DEFAULTS: dict[str, Any] = {
    "columns": {"frame_id": "frame_id", "x": "x", "y": "y", "z": "z", "intensity": "intensity"},
    "voxel": 0.04,
    "tile_voxels": 64,
    "blind_radius": 0.35,
    "default_intensity": 100.0,
    "ground_z": 0.0,
    "ground_thickness": 0.05,
    "structure_points": 5,
    "files_per_batch": 64,
}
_CELL = ["ix", "iy", "iz"]
PARTS = "ix long, iy long, iz long, n long, sx long, sy long, sz long, si long, first_frame long, last_frame long, tile string, batch long"
MAP = "ix long, iy long, iz long, n long, x double, y double, z double, intensity double, first_frame long, last_frame long, label int, tile string"


def seen_points(rows: DataFrame, config: dict[str, Any]) -> DataFrame:
    """frame_id, x, y, z, intensity of the finite points outside the blind spot."""
    columns = [F.expr(config["columns"][c]).cast("long" if c == "frame_id" else "double").alias(c) for c in DEFAULTS["columns"]]
    points = P.fill_intensity(rows.select(*columns), config["default_intensity"])
    return P.outside_blind_spot(P.drop_nonfinite(points), config["blind_radius"])


def voxel_sums(points: DataFrame, config: dict[str, Any]) -> DataFrame:
    """Sums of the points by voxel, and the tile of each voxel; lengths and intensities in millionths."""
    cells = points.withColumns({f"i{c}": F.floor(F.col(c) / config["voxel"]).cast("long") for c in "xyz"})
    whole = lambda c: F.sum(F.floor(F.col(c) * 1e6 + 0.5).cast("long"))
    sums = cells.groupBy(*_CELL).agg(
        F.count(F.lit(1)).alias("n"), *[whole(c).alias(f"s{c[0]}") for c in ("x", "y", "z", "intensity")], F.min("frame_id").alias("first_frame"), F.max("frame_id").alias("last_frame")
    )
    side = config["tile_voxels"]
    return sums.withColumn("tile", F.concat_ws("_", F.floor(F.col("ix") / side).cast("string"), F.floor(F.col("iy") / side).cast("string")))


def map_rows(parts: DataFrame, config: dict[str, Any]) -> DataFrame:
    """The voxels of all parts, in the columns of MAP."""
    sums = parts.groupBy("tile", *_CELL).agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sz", "si")], F.min("first_frame").alias("first_frame"), F.max("last_frame").alias("last_frame"))
    means = sums.select(*_CELL, "n", *[(F.col(f"s{c[0]}") / 1e6 / F.col("n")).alias(c) for c in ("x", "y", "z", "intensity")], "first_frame", "last_frame", "tile")
    ground = F.abs(F.col("z") - config["ground_z"]) <= 1.5 * config["ground_thickness"]
    label = F.when(ground, P.GROUND).when(F.col("n") >= config["structure_points"], P.STRUCTURE).otherwise(P.CANDIDATE).cast("int")
    return means.withColumn("label", label).select(*[c.split()[0] for c in MAP.split(", ")])


def _write(df: DataFrame, path: str, *by: str) -> int:
    """Replace the partitions that df has; returns its rows."""
    rows, seen = counted(df.hint("rebalance", by[0]), "rows")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    return seen.get["rows"]


def run(spark: SparkSession, source: str, output: str, checkpoint: str, settings: dict[str, Any] | None = None) -> DataFrame:
    """Take the files of source that the checkpoint does not know; returns the whole map, read back."""
    config = checked(DEFAULTS, settings or {})
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(source)

    def merge(batch: DataFrame, number: int) -> None:
        written = _write(voxel_sums(batch, config).withColumn("batch", F.lit(number).cast("long")), f"{output}/parts", "tile", "batch")
        parts = batch.sparkSession.read.schema(PARTS).parquet(f"{output}/parts")
        touched = parts.filter(F.col("batch") == number).select("tile").distinct()
        renewed = _write(map_rows(parts.join(touched, "tile", "left_semi"), config), f"{output}/map", "tile")
        log.info("batch %d: wrote %d voxel sums, renewed %d voxels of the map", number, written, renewed)

    # An empty map may be read too.
    spark.createDataFrame([], MAP).write.mode("append").parquet(f"{output}/map")
    query = seen_points(stream, config).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("read %d new rows from %s", sum(p["numInputRows"] for p in query.recentProgress), source)
    return spark.read.schema(MAP).parquet(f"{output}/map")


if __name__ == "__main__":
    main(lambda spark, a: run(spark, a.input, a.output, a.checkpoint, read_config(spark, a.config, DEFAULTS)), "background-map", __doc__, "input", "output", "checkpoint")
