"""Connected components of an edge table, without a driver-side graph.

Alternating stars: every node sends its larger neighbours, then its smaller
ones, to the least node it knows of. Each round is a grouped minimum and an
equi-join over the edges, written to the shared folder, so lineage stays short
and a lost executor costs one round. The number of rounds grows with the
logarithm of the longest path. An edge table of up to ``LOCAL_EDGES`` rows is
finished by one task, which saves the rounds; the result is the same. The joins
of a round are merges: a broadcast would bring its side to the driver each time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegerType, LongType, StructField, StructType

from fringework.functions.union import forest
from fringework.storage import dropped, written

#: Edges that one task may finish: 16 bytes each, so a few megabytes.
LOCAL_EDGES = 200_000


def _stars(edges: DataFrame) -> DataFrame:
    """One round on edges (a, b) with a > b: large star, then small star."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
    # Large star: (x, v) with v > x is an edge as it stands, with x as its smaller end.
    large = written(edges.join(least.withColumnRenamed("a", "b").hint("merge"), "b").select(F.col("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large-star")
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(low.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
    out = written(small.where("a <> b").distinct(), "small-star")
    dropped(edges.sparkSession, large)
    return out


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def _numbers(column: pa.Array) -> np.ndarray:
    """Nodes as a plain or, for structs of numbers, a structured array; both sort as Spark does."""
    if not pa.types.is_struct(column.type):
        return column.to_numpy(zero_copy_only=False)
    return np.rec.fromarrays([column.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(column.type.num_fields)]).view(np.ndarray)


def _nodes(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    if not pa.types.is_struct(kind):
        return pa.array(values, kind)
    fields = [kind.field(i) for i in range(kind.num_fields)]
    return pa.StructArray.from_arrays([pa.array(values[n], f.type) for n, f in zip(values.dtype.names, fields, strict=True)], fields=fields)


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all edges of the partition, the least nodes of components too."""
    parts, kind = [], None
    for batch in batches:
        kind = batch.column(0).type
        parts.append([_numbers(c) for c in batch.columns])
    if parts:
        a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
        names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
        node, least = forest(ends[: len(a)], ends[len(a) :])
        roots = np.unique(least)
        both = (np.concatenate([node, roots]), np.concatenate([least, roots]))
        yield pa.RecordBatch.from_arrays([_nodes(names[x], kind) for x in both], names=["node", "component"])


def _plain(kind: DataType) -> bool:
    """Whether nodes are whole numbers or structs of them that hold no null."""
    whole = (LongType, IntegerType)
    return isinstance(kind, LongType) or (isinstance(kind, StructType) and all(isinstance(f.dataType, whole) and not f.nullable for f in kind.fields))


def components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, component) for every node of the edges (a, b); the component is its least node.

    Loops and repeated edges are ignored; nodes of equal value are one node.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(now)
    kind = edges.schema["a"].dataType
    if state[0] <= local_edges and _plain(kind):
        return now.coalesce(1).mapInArrow(_finished, StructType([StructField("node", kind), StructField("component", kind)]))
    while state[0]:
        after = _stars(now)
        dropped(edges.sparkSession, now)
        now, before = after, state
        state = _state(now)
        if state == before:
            break
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
