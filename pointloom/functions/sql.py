"""SQL names for what SQL lacks: hull_volume (aggregate), box_corners (table function), field_eval, wendland, wrap_angle."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointloom.operators.solids import FLAT_VOLUME, hull_volume


#: A primitive of an implicit surface, as `field_eval` takes them in an array.
PRIMITIVE = "px DOUBLE, py DOUBLE, pz DOUBLE, h DOUBLE, alpha_v DOUBLE, alpha_gx DOUBLE, alpha_gy DOUBLE, alpha_gz DOUBLE"


class _BoxCorners:
    """The eight corners of an upright box: center, yaw and half-extents."""

    def eval(self, cx: float, cy: float, cz: float, yaw: float, e0: float, e1: float, e2: float):
        if None in (cx, cy, cz, yaw, e0, e1, e2):
            return
        c, s = np.cos(yaw), np.sin(yaw)
        for k in range(8):
            u, v, w = (e * (1 - 2 * (k >> i & 1)) for i, e in enumerate((e0, e1, e2)))
            yield k, float(cx + c * u - s * v), float(cy + s * u + c * v), float(cz + w)


def register(spark: SparkSession) -> None:
    """Register all of them in a session."""

    def volume(x: pd.Series, y: pd.Series, z: pd.Series) -> float:
        found = hull_volume(np.column_stack([x, y, z]).astype(float))
        return FLAT_VOLUME if found is None else found

    spark.udf.register("hull_volume", F.pandas_udf(volume, T.DoubleType()))
    spark.udtf.register("box_corners", F.udtf(_BoxCorners, returnType="corner int, x double, y double, z double"))
    # SQL functions are inlined into the plan, so these stay in generated code.
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION wrap_angle(a DOUBLE) RETURNS DOUBLE RETURN atan2(sin(a), cos(a))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION wendland(u DOUBLE) RETURNS DOUBLE RETURN CASE WHEN u >= 0 AND u < 1 THEN pow(1 - u, 4) * (4 * u + 1) ELSE 0 END")
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION field_eval(x DOUBLE, y DOUBLE, z DOUBLE, primitives ARRAY<STRUCT<{PRIMITIVE}>>, outside DOUBLE) RETURNS DOUBLE
        RETURN WITH near AS (SELECT transform(filter(transform(primitives, q -> named_struct('q', q, 'r', sqrt(pow(x - q.px, 2) + pow(y - q.py, 2) + pow(z - q.pz, 2)))), s -> s.r < s.q.h),
            s -> pow(1 - s.r / s.q.h, 4) * (4 * s.r / s.q.h + 1) * s.q.alpha_v + IF(s.r > 1e-9, 20 * pow(1 - s.r / s.q.h, 3) / s.q.h / s.q.h, 0D) * ((x - s.q.px) * s.q.alpha_gx + (y - s.q.py) * s.q.alpha_gy + (z - s.q.pz) * s.q.alpha_gz)) AS parts)
          SELECT IF(size(parts) > 0, aggregate(parts, 0D, (a, b) -> a + b), outside) FROM near"""
    )
