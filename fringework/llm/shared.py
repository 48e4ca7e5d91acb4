"""Small helpers of the corpus operators."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fringework.functions.union import forest
from fringework.storage import dropped, fresh_path, shared_dir, written

__all__ = ["dropped", "forest", "free_names", "fresh_path", "given_back", "shared_dir", "shuffle_width", "table", "text_or_empty", "written"]


def free_names(taken: Iterable[str], *wanted: str) -> list[str]:
    """A name for each of ``wanted`` that none of ``taken`` has, whatever its case."""
    have, out = {t.lower() for t in taken}, []
    for name in wanted:
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def shuffle_width(spark: SparkSession) -> int:
    """Partitions for a repartition: the session's shuffle width, which the operator sizes with the input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def given_back() -> None:
    """Gives the memory that a finished task has freed back to the system, so that a worker that lives on is no larger than its next task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
