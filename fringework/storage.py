"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a local one is made only where it is unset and all runs in one process."""
    found = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"{_SETTING} is unset: with master {master} the executors need a folder that all of them see")
        found = f"file://{tempfile.mkdtemp(prefix='fringework-shared-')}"
        spark.conf.set(_SETTING, found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_dir(spark)}/fringework/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage and survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that a side may have to be broadcast: pairs, tracks, fits; of a hundred bytes or so.
BROADCAST_ROWS = 200_000


def small_side(df: DataFrame, name: str) -> DataFrame:
    """``df`` written, and marked for a broadcast if it has few rows; otherwise a join with it is a shuffle."""
    table = written(df, name)
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def dropped(spark: SparkSession, df: DataFrame) -> None:
    """Deletes the files of a table made by :func:`written` that is no longer read."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/fringework/" in name:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)
