"""Rasters derived from the driver's tables: one text for the engine, one for the SQL twin."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH, SCENE_WIDTH = 120, 100
TIMES = 5


def _spark(text: str) -> str:
    return re.sub(r"IDIV\((\w+), (\w+)\)", r"(\1 div \2)", text)


def _duck(text: str) -> str:
    return re.sub(r"IDIV\((\w+), (\w+)\)", r"(\1 // \2)", text)


_AMPLITUDE = "(CAST(1 AS DOUBLE) + CAST(o_custkey % 7 AS DOUBLE) / CAST(7 AS DOUBLE))"
_PHASE = "(CAST((o_orderkey * 37 + o_custkey * (t + 1) * 11) % 628 AS DOUBLE) / CAST(100 AS DOUBLE))"
_SLC = (
    "CAST(t AS BIGINT) AS t", f"IDIV(o_orderkey, {WIDTH}) AS yi", f"o_orderkey % {WIDTH} AS xi",
    f"CASE WHEN (o_orderkey + 13 * t) % 17 <> 0 THEN {_AMPLITUDE} * cos({_PHASE}) END AS re",
    f"CASE WHEN (o_orderkey + 13 * t) % 17 <> 0 THEN {_AMPLITUDE} * sin({_PHASE}) END AS im",
)
_UNW = (
    "CAST(t AS BIGINT) AS pair", f"IDIV(o_orderkey, {WIDTH}) AS yi", f"o_orderkey % {WIDTH} AS xi",
    f"CASE WHEN (o_orderkey + 7 * t) % 11 <> 0 THEN CAST((o_custkey * 7 + t * 13) % 200 AS DOUBLE) / CAST(10 AS DOUBLE) + CAST(o_orderkey % {WIDTH} AS DOUBLE) / CAST(50 AS DOUBLE) END AS unw",
    "CAST((o_custkey * 31 + o_orderkey) % 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS coherence",
    "CAST(o_custkey % 3 AS BIGINT) AS conncomp", f"CAST(IDIV(o_orderkey, {WIDTH}) AS DOUBLE) / CAST(1000 AS DOUBLE) AS phase_screen",
    "CAST(o_custkey % 256 AS BIGINT) AS subswath_mask",
)
_SCENE = (
    f"IDIV(event_id, {SCENE_WIDTH}) AS yi", f"event_id % {SCENE_WIDTH} AS xi",
    "CASE WHEN event_id % 19 <> 0 THEN CAST((user_id * 13 + event_id * 7) % 1000 AS BIGINT) END AS v",
)

#: The same rasters as common table expressions of the twin.
SLC_SQL = f"slc AS (SELECT {', '.join(map(_duck, _SLC))} FROM orders CROSS JOIN (SELECT r_regionkey AS t FROM region))"
UNW_SQL = f"unw AS (SELECT {', '.join(map(_duck, _UNW))} FROM orders CROSS JOIN (SELECT r_regionkey AS t FROM region WHERE r_regionkey < 2))"
SCENE_SQL = f"scene AS (SELECT {', '.join(map(_duck, _SCENE))} FROM events)"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _repeated(df: DataFrame, times: int) -> DataFrame:
    """Every row once for each acquisition: the times are a literal array, so nothing is joined."""
    return df.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def slc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, yi, xi, re, im): five acquisitions of the order raster, null where invalid."""
    return _repeated(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), TIMES).selectExpr(*map(_spark, _SLC))


def unwrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair, yi, xi, unw, coherence, conncomp, phase_screen, subswath_mask): two pairs."""
    return _repeated(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), 2).selectExpr(*map(_spark, _UNW))


def scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(yi, xi, v): an integer raster from the events, null where invalid."""
    return read(spark, sf_dir, "events").select("event_id", "user_id").selectExpr(*map(_spark, _SCENE))
