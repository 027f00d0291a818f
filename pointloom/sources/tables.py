"""Readers and writers of the stages' tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LABELLED = "x float, y float, z float, label int, intensity float"
METRICS = "frame int, latency_total_ms double, nis double, fsm_state int"
PRIOR = "alignment array<array<double>>, ground struct<z: double, thickness: double>, shells array<struct<center: array<double>, axes: array<array<double>>, extents: array<double>, solidity: double>>"
MODEL = "k int, p array<double>, n array<double>, h double, alpha_v double, alpha_g array<double>"
MODEL_HEAD = "centroid array<double>, robot_volume double, sigma_lidar double, sigma_grad double"
METADATA = (
    "R_align array<array<double>>, z_ground double, ground_normal array<double>, ground_distance double, ground_thickness double, robot_centroid array<double>, "
    "label_counts struct<ground: long, structure: long, candidate: long, target: long>"
)
WALLS = "normal array<double>, distance double, center array<double>, u array<double>, v array<double>, half_width double, half_height double"


def write_labelled(points: DataFrame, path: str) -> None:
    """Labelled points as Parquet, one folder a label, so that readers of a label skip the others."""
    points.write.mode("overwrite").partitionBy("label").parquet(path)


def read_labelled(spark: SparkSession, path: str, labels: list[int] | None = None) -> DataFrame:
    """Labelled points, only of the given labels."""
    df = spark.read.schema(LABELLED).parquet(path)
    return df.filter(F.col("label").isin(labels)) if labels else df


def read_prior(spark: SparkSession, path: str) -> DataFrame:
    """The static prior, one row."""
    return spark.read.schema(PRIOR).option("multiLine", True).json(path)


def prior_shells(prior: DataFrame) -> DataFrame:
    """Shells of a prior as a table: shell_id, center, axes (columns of the matrix become a0.., a1.., a2..) and half-extents."""
    rows = prior.select(F.posexplode("shells").alias("shell_id", "s"))
    axis = [F.col("s.axes")[r][i].cast("double").alias(f"a{i}{c}") for i in range(3) for r, c in enumerate("xyz")]
    return rows.select("shell_id", *[F.col("s.center")[i].alias(f"c{c}") for i, c in enumerate("xyz")], *axis, *[F.col("s.extents")[i].alias(f"e{i}") for i in range(3)])


def write_prior(alignment: DataFrame, shells: DataFrame, path: str) -> None:
    """One JSON document from a one-row table (alignment, ground) and shells (center, axes, extents, solidity)."""
    packed = shells.agg(F.collect_list(F.struct("center", "axes", "extents", "solidity")).alias("shells"))
    alignment.crossJoin(packed).coalesce(1).write.mode("overwrite").json(path)


def write_model(primitives: DataFrame, head: DataFrame, path: str) -> None:
    """A surface as two tables: its primitives (MODEL) as Parquet and one row of what holds for all of them (MODEL_HEAD) as JSON.

    The head is written last, and readers start from it: a model whose primitives were not finished has none.
    """
    primitives.select(*[c.split()[0] for c in MODEL.split(", ")]).write.mode("overwrite").parquet(f"{path}/primitives")
    head.select(*[c.split()[0] for c in MODEL_HEAD.split(", ")]).coalesce(1).write.mode("overwrite").json(f"{path}/head")


def read_model(spark: SparkSession, path: str) -> DataFrame:
    """The primitives of a written surface, each with the columns of its head."""
    head = spark.read.schema(MODEL_HEAD).option("mode", "FAILFAST").json(f"{path}/head")
    return spark.read.schema(MODEL).parquet(f"{path}/primitives").crossJoin(F.broadcast(head.limit(1)))


def flat_primitives(model: DataFrame) -> DataFrame:
    """Primitives with array columns as the scalar columns that `spatial.field_value` uses, moved to where the surface was built."""
    moved = [(F.col("p")[i] + F.col("centroid")[i]).alias(f"p{c}") for i, c in enumerate("xyz")]
    return model.select("k", *moved, *[F.col("n")[i].alias(f"n{c}") for i, c in enumerate("xyz")], "h", "alpha_v", *[F.col("alpha_g")[i].alias(f"alpha_g{c}") for i, c in enumerate("xyz")])


def write_metadata(labelled: DataFrame, alignment: DataFrame, path: str) -> None:
    """One JSON document: a one-row table of the alignment's columns of METADATA, with the counts of the labels and the centroid of label 3."""
    counts = labelled.agg(
        F.struct(*[F.count_if(F.col("label") == i).alias(n) for i, n in enumerate(("ground", "structure", "candidate", "target"))]).alias("label_counts"),
        F.array(*[F.avg(F.when(F.col("label") == 3, F.col(c).cast("double"))) for c in "xyz"]).alias("robot_centroid"),
    )
    both = alignment.drop("label_counts", "robot_centroid").crossJoin(F.broadcast(counts))
    both.select("R_align", "z_ground", "ground_normal", "ground_distance", "ground_thickness", "robot_centroid", "label_counts").coalesce(1).write.mode("overwrite").json(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """The metadata of labelled points, one row; numbers that a document lacks are null."""
    return spark.read.schema(METADATA).option("multiLine", True).json(path)


def flat_walls(walls: DataFrame) -> DataFrame:
    """Walls with array columns as the scalar columns that the joins use."""
    out = [F.col("normal")[i].alias(f"n{c}") for i, c in enumerate("xyz")] + [F.col("distance").alias("d")]
    out += [F.col(s)[i].alias(f"{n}{c}") for s, n in (("center", "c"), ("u", "u"), ("v", "v")) for i, c in enumerate("xyz")]
    return walls.select(*out, "half_width", "half_height")


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """CSV metrics of all bags under a path; the bag is the file's name before `_metrics`."""
    df = spark.read.schema(METRICS).option("header", True).csv(path, pathGlobFilter="*_metrics.csv")
    return df.withColumn("bag", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)_metrics\.csv$", 1))


def stream_frames(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """A landing folder of Parquet files as a stream, paced by files per trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
