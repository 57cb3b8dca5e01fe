"""Generated signals."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tone(spark: SparkSession, n: int, frequency: float = 0.05, amplitude: float = 1.0, noise: float = 0.05, seed: int = 1) -> DataFrame:
    """i, n, y: a sine with phase 2 pi f t 30, t = i / (n - 1), and nearly normal noise, the sum of twelve uniforms."""
    t = F.col("id") / max(1, n - 1)
    uniform = sum((F.rand(seed + k) for k in range(1, 12)), F.rand(seed)) - 6.0
    return spark.range(n).select(F.col("id").alias("i"), F.lit(n).cast("long").alias("n"), (amplitude * F.sin(2 * math.pi * frequency * t * 30) + noise * uniform).alias("y"))
