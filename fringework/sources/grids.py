"""Classic NetCDF grids: a reader and writer of the format's first version, and tables of their pixels."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from fringework.sources.hdf5 import SIGNATURE, grid_of

#: Fixed values of the format: type numbers to numpy types, and tags of the header's lists.
_TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}
_DIMENSION, _VARIABLE, _ATTRIBUTE = 10, 11, 12


class _Reader:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 4
        if data[:3] != b"CDF" or data[3] not in (1, 2):
            raise ValueError("not a classic NetCDF file")
        self.wide = data[3] == 2

    def int(self, kind: str = ">i") -> int:
        (v,) = struct.unpack_from(kind, self.data, self.at)
        self.at += struct.calcsize(kind)
        return v

    def name(self) -> str:
        n = self.int()
        out = self.data[self.at : self.at + n].decode()
        self.at += -(-n // 4) * 4
        return out

    def list(self, tag: int) -> range:
        found, n = self.int(), self.int()
        if found not in (0, tag):
            raise ValueError("a list has an unknown tag")
        return range(n)

    def attributes(self) -> dict:
        out = {}
        for _ in self.list(_ATTRIBUTE):
            name, kind, n = self.name(), _TYPES[self.int()], self.int()
            size = np.dtype(kind).itemsize * n
            raw = self.data[self.at : self.at + size]
            self.at += -(-size // 4) * 4
            out[name] = raw.decode() if kind == "S1" else np.frombuffer(raw, kind).tolist()
        return out


def parse(data: bytes) -> dict[str, tuple[tuple[str, ...], np.ndarray, dict]]:
    """Dimensions, values and attributes of every variable without a record dimension."""
    r = _Reader(data)
    r.int()
    dims = [(r.name(), r.int()) for _ in r.list(_DIMENSION)]
    r.attributes()
    out = {}
    for _ in r.list(_VARIABLE):
        name = r.name()
        over = [dims[r.int()] for _ in range(r.int())]
        attributes, kind, _ = r.attributes(), _TYPES[r.int()], r.int()
        begin = r.int(">q" if r.wide else ">i")
        shape = tuple(n for _, n in over)
        if 0 in shape:
            raise ValueError("record dimensions are not read")
        values = np.frombuffer(data, kind, int(np.prod(shape, dtype=int)), begin).reshape(shape)
        out[name] = (tuple(d for d, _ in over), values, attributes)
    return out


def compose(variables: dict[str, tuple[tuple[str, ...], np.ndarray]]) -> bytes:
    """A file of the first version from named float or integer arrays and their dimensions."""
    dims: dict[str, int] = {}
    for over, values in variables.values():
        dims |= dict(zip(over, values.shape, strict=True))
    names = list(dims)
    pad = lambda b: b + b"\0" * (-len(b) % 4)
    text = lambda s: struct.pack(">i", len(s)) + pad(s.encode())
    code = {np.dtype(k).newbyteorder("="): n for n, k in _TYPES.items() if k != "S1"}
    none = struct.pack(">ii", 0, 0)

    def head(starts: list[int]) -> bytes:
        out = b"CDF\x01" + struct.pack(">i", 0) + struct.pack(">ii", _DIMENSION, len(dims)) + b"".join(text(d) + struct.pack(">i", n) for d, n in dims.items()) + none
        out += struct.pack(">ii", _VARIABLE, len(variables))
        for (name, (over, values)), start in zip(variables.items(), starts, strict=True):
            out += text(name) + struct.pack(">i", len(over)) + b"".join(struct.pack(">i", names.index(d)) for d in over) + none
            out += struct.pack(">iii", code[values.dtype.newbyteorder("=")], -(-values.nbytes // 4) * 4, start)
        return out

    at, starts = len(head([0] * len(variables))), []
    for _, values in variables.values():
        starts.append(at)
        at += -(-values.nbytes // 4) * 4
    return head(starts) + b"".join(pad(values.astype(values.dtype.newbyteorder(">")).tobytes()) for _, values in variables.values())


def looks_geographic(x: np.ndarray, y: np.ndarray) -> bool:
    return bool(np.abs(x).max() <= 360 and np.abs(y).max() <= 90)


def read_grids(spark: SparkSession, paths: str) -> DataFrame:
    """(path, yi, xi, y, x, z): every grid under the path pattern, classic or HDF5, one file a task, read by Spark's own file source."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content")

    def rows_of(path: str, z: np.ndarray, y: np.ndarray, x: np.ndarray) -> Iterator:
        import pandas as pd

        step = max(1, 200_000 // max(1, len(x)))
        for at in range(0, len(y), step):
            part = z[at : at + step]
            yi, xi = np.indices(part.shape)
            yield pd.DataFrame({"path": path, "yi": yi.ravel() + at, "xi": xi.ravel(), "y": y[yi.ravel() + at], "x": x[xi.ravel()], "z": part.ravel()})

    def run(frames: Iterator) -> Iterator:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                if bytes(content[:8]) == SIGNATURE:
                    z, y, x = grid_of(path, bytes(content))
                    yield from rows_of(path, z, y, x)
                    continue
                found = parse(bytes(content))
                name = "z" if "z" in found else next(n for n, (over, *_) in found.items() if len([d for d in over if d]) >= 2)
                over, values, _ = found[name]
                z = np.asarray(values, float).squeeze()
                if z.ndim != 2:
                    raise ValueError(f"{path}: {name} is no grid")
                y, x = (np.asarray(found[d][1], float) if d in found else np.arange(n, dtype=float) for d, n in zip([d for d, n in zip(over, values.shape, strict=True) if n > 1], z.shape, strict=True))
                yield from rows_of(path, z, y, x)

    return files.mapInPandas(run, "path string, yi long, xi long, y double, x double, z double")


def write_grids(pixels: DataFrame, folder: str, x0: float, dx: float, y0: float, dy: float, ny: int, nx: int, value: str = "z", by: str = "layer") -> DataFrame:
    """One grid file for each layer, written by the task that holds it; (layer, path, bytes). Void pixels are NaN."""
    import pandas as pd
    import pyarrow.fs

    kind = dict(pixels.dtypes)[by]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        z = np.full((ny, nx), np.nan, np.float32)
        z[pdf["yi"].to_numpy(), pdf["xi"].to_numpy()] = pdf[value].to_numpy(float)
        data = compose({"y": (("y",), y0 + dy * np.arange(ny)), "x": (("x",), x0 + dx * np.arange(nx)), "z": (("y", "x"), z)})
        files, base = pyarrow.fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        files.create_dir(base, recursive=True)
        path = f"{base}/{value}_{by}{key[0]}.grd"
        with files.open_output_stream(path) as f:
            f.write(data)
        return pd.DataFrame({by: [key[0]], "path": [path], "bytes": [len(data)]})

    return pixels.groupBy(by).applyInPandas(run, f"{by} {kind}, path string, bytes long")
