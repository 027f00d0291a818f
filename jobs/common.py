"""What the jobs share: configuration, session and log."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def read_config(spark: SparkSession, path: str | None, defaults: dict[str, Any]) -> dict[str, Any]:
    """Defaults overridden by a JSON file, which Spark reads, so it may lie in any store; unknown names raise."""
    given = json.loads(spark.read.option("wholetext", True).text(path).first()[0]) if path else {}
    return checked(defaults, given)


def checked(defaults: dict[str, Any], given: dict[str, Any]) -> dict[str, Any]:
    """defaults | given, where given has no other names."""
    unknown = set(given) - set(defaults)
    if unknown:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return defaults | given


def counted(df: DataFrame, what: str) -> tuple[DataFrame, Observation]:
    """df, and an observation of how many rows the action on it has passed on; no pass of its own."""
    seen = Observation(what)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def main(run: Callable[[SparkSession, argparse.Namespace], DataFrame], name: str, doc: str, *arguments: str) -> None:
    """Parse --config and the paths, run with a session of its own, and stop it."""
    parser = argparse.ArgumentParser(description=doc)
    parser.add_argument("--config", help="JSON file with settings")
    for a in arguments:
        parser.add_argument(f"--{a}", required=True, help=f"path of the {a}")
    given = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        run(spark, given)
    finally:
        spark.stop()
