"""A chunked granule container as a Spark data source: one input partition for each stored chunk.

A granule is a folder of ``meta.json`` (axes, spacing, epsg, direction, time,
chunk shape, fill) and ``chunk-<cy>-<cx>.bin`` files, each a byte-shuffled and
deflated block of complex samples. A chunk that was never written is fill.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "yi long, xi long, y double, x double, re float, im float"


def _opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def shuffled(block: np.ndarray) -> bytes:
    """The first bytes of all samples, then their second bytes, and so on."""
    return block.view(np.uint8).reshape(-1, block.itemsize).T.tobytes()


def unshuffled(raw: bytes, dtype: np.dtype, shape: tuple[int, int]) -> np.ndarray:
    n = shape[0] * shape[1]
    return np.frombuffer(np.frombuffer(raw, np.uint8).reshape(dtype.itemsize, n).T.tobytes(), dtype).reshape(shape)


def write(path: str, image: np.ndarray, x: np.ndarray, y: np.ndarray, epsg: int, time: str | None, direction: str = "Descending", chunks: tuple[int, int] = (64, 64), empty: frozenset = frozenset()) -> None:
    if direction not in ("Ascending", "Descending"):
        raise ValueError(f"unknown pass direction {direction!r}")
    for name, axis in (("x", x), ("y", y)):
        d = np.diff(axis)
        if not (len(axis) >= 2 and ((d > 0).all() or (d < 0).all())):
            raise ValueError(f"the {name} axis is not monotonic")
    files, base = _opened(path)
    files.create_dir(base, recursive=True)
    cy, cx = chunks
    for i in range(0, image.shape[0], cy):
        for j in range(0, image.shape[1], cx):
            if (i // cy, j // cx) in empty:
                continue
            block = np.full(chunks, np.nan, np.complex64)
            part = image[i : i + cy, j : j + cx]
            block[: part.shape[0], : part.shape[1]] = part
            with files.open_output_stream(f"{base}/chunk-{i // cy}-{j // cx}.bin") as f:
                f.write(zlib.compress(shuffled(block), 1))
    meta = {"x": x.tolist(), "y": y.tolist(), "epsg": epsg, "time": time, "direction": direction, "chunks": list(chunks)}
    with files.open_output_stream(f"{base}/meta.json") as f:
        f.write(json.dumps(meta).encode())


def write_distributed(pixels: DataFrame, path: str, x0: float, dx: float, y0: float, dy: float, ny: int, nx: int, epsg: int, time: str | None, direction: str = "Descending", chunks: tuple[int, int] = (64, 64)) -> None:
    """A granule from pixels (yi, xi, re, im): every chunk is written by the task that groups its pixels; chunks without any are not written."""
    if direction not in ("Ascending", "Descending"):
        raise ValueError(f"unknown pass direction {direction!r}")
    if not dx or not dy:
        raise ValueError("an axis is not monotonic")
    cy, cx = chunks

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        block = np.full(chunks, np.nan, np.complex64)
        block[pdf["yi"].to_numpy() % cy, pdf["xi"].to_numpy() % cx] = pdf["re"].to_numpy(float) + 1j * pdf["im"].to_numpy(float)
        files, base = _opened(path)
        files.create_dir(base, recursive=True)
        with files.open_output_stream(f"{base}/chunk-{key[0]}-{key[1]}.bin") as f:
            f.write(zlib.compress(shuffled(block), 1))
        return pd.DataFrame({"cy": [key[0]], "cx": [key[1]]})

    at = pixels.withColumn("cy", F.floor(F.col("yi") / cy)).withColumn("cx", F.floor(F.col("xi") / cx))
    at.groupBy("cy", "cx").applyInPandas(run, "cy long, cx long").write.format("noop").mode("overwrite").save()
    axis = lambda first, step, n: [first + step * i for i in range(n)]
    files, base = _opened(path)
    with files.open_output_stream(f"{base}/meta.json") as f:
        f.write(json.dumps({"x": axis(x0, dx, nx), "y": axis(y0, dy, ny), "epsg": epsg, "time": time, "direction": direction, "chunks": list(chunks)}).encode())


def metadata(path: str) -> dict:
    files, base = _opened(path)
    with files.open_input_stream(f"{base}/meta.json") as f:
        return json.loads(f.read())


class Chunk(InputPartition):
    def __init__(self, cy: int, cx: int) -> None:
        self.cy, self.cx = cy, cx


class GranuleReader(DataSourceReader):
    """Options: ``path``; ``y0, y1, x0, x1`` bound the pixels, and chunks outside are not read."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        meta = metadata(self.path)
        self.x, self.y, self.chunks = meta["x"], meta["y"], tuple(meta["chunks"])
        bound = lambda k, d: int(options.get(k, d))
        self.rows, self.columns = (bound("y0", 0), min(bound("y1", len(self.y)), len(self.y))), (bound("x0", 0), min(bound("x1", len(self.x)), len(self.x)))

    def partitions(self) -> list[Chunk]:
        cy, cx = self.chunks
        return [Chunk(i, j) for i in range(self.rows[0] // cy, -(-self.rows[1] // cy)) for j in range(self.columns[0] // cx, -(-self.columns[1] // cx))]

    def read(self, chunk: Chunk) -> Iterator[pa.RecordBatch]:
        files, base = _opened(self.path)
        cy, cx = self.chunks
        name = f"{base}/chunk-{chunk.cy}-{chunk.cx}.bin"
        if files.get_file_info(name).type == pyarrow.fs.FileType.NotFound:
            block = np.full(self.chunks, np.nan, np.complex64)
        else:
            with files.open_input_stream(name) as f:
                block = unshuffled(zlib.decompress(f.read()), np.dtype(np.complex64), self.chunks)
        y0, x0 = chunk.cy * cy, chunk.cx * cx
        rows = np.arange(max(y0, self.rows[0]), min(y0 + cy, self.rows[1]))
        columns = np.arange(max(x0, self.columns[0]), min(x0 + cx, self.columns[1]))
        part = block[np.ix_(rows - y0, columns - x0)].ravel()
        yi, xi = np.repeat(rows, len(columns)), np.tile(columns, len(rows))
        void = ~np.isfinite(part)
        x, y = np.asarray(self.x), np.asarray(self.y)
        arrays = [pa.array(yi), pa.array(xi), pa.array(y[yi]), pa.array(x[xi]), pa.array(part.real.astype(np.float32), mask=void), pa.array(part.imag.astype(np.float32), mask=void)]
        yield pa.RecordBatch.from_arrays(arrays, names=["yi", "xi", "y", "x", "re", "im"])


class Granule(DataSource):
    """``spark.dataSource.register(Granule)``, then ``spark.read.format("granule").load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "granule"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> GranuleReader:
        return GranuleReader(self.options)
