"""Makes a session's Python workers find this package; plans without tests for overflow."""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def prepare(spark: SparkSession) -> SparkSession:
    """Adds the package's folder to the workers' path. On clusters without a common path, ship the package with --py-files."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


@contextmanager
def unchecked(spark: SparkSession, bounded: bool = True) -> Iterator[None]:
    """Columns selected inside do not test whole numbers for overflow, which takes as long as the arithmetic itself. Only for steps whose
    numbers are bounded; the session's setting is read when a plan is made, and is put back."""
    before = spark.conf.get("spark.sql.ansi.enabled")
    if not bounded or before == "false":
        yield
        return
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)
