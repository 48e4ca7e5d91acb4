"""Scene-level operators: crops, unions of lattices, units, look geometry, layered profiles, cell sizes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fringework.storage import written

UNITS = {"m": 1.0, "cm": 0.01, "mm": 0.001}


def crop(pixels: DataFrame, x: Column, y: Column, x_range: tuple[float, float], y_range: tuple[float, float]) -> DataFrame:
    """Pixels inside a box, both ends included, whichever way the axes run."""
    (x0, x1), (y0, y1) = sorted(x_range), sorted(y_range)
    return pixels.where(x.between(x0, x1) & y.between(y0, y1))


def to_metres(value: Column, units: str = "m", sign: int = 1) -> Column:
    if units not in UNITS:
        raise ValueError(f"unknown unit {units!r}")
    return value * F.lit(UNITS[units] * sign)


def east_north(dx: Column, dy: Column, x_spacing: float, y_spacing: float) -> tuple[Column, Column]:
    """Offsets in metres from offsets in pixels; the spacing is signed."""
    return dx * F.lit(x_spacing), dy * F.lit(y_spacing)


def stacked(granules: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Granules on one lattice as a stack by time; the lattices must agree pixel for pixel."""
    if not granules:
        raise ValueError("a stack needs a granule")
    parts = [df.withColumn("t", F.lit(time)) for time, df in sorted(granules, key=lambda g: g[0])]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    sizes = out.groupBy("t").agg(F.count("*").alias("n"), F.sum(F.xxhash64("yi", "xi").cast("decimal(38,0)")).alias("h")).select("n", "h").distinct()
    if sizes.count() != 1:
        raise ValueError("the granules do not share a lattice")
    return out


def filled_from(base: DataFrame, others: Sequence[DataFrame], keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """``base`` with its void values from the first of ``others`` that has them."""
    out = base
    for i, other in enumerate(others):
        names = {v: f"_{v}{i}" for v in values}
        out = out.join(other.select(*keys, *(F.col(v).alias(n) for v, n in names.items())), list(keys), "left")
        out = out.withColumns({v: F.coalesce(v, n) for v, n in names.items()}).drop(*names.values())
    return out


def geometry_consistent(geometry: DataFrame, ascending: bool, right_looking: bool, east: str = "los_east") -> DataFrame:
    """Whether the mean east look component has the sign that pass and look side imply (one row)."""
    want = 1 if ascending != right_looking else -1
    return geometry.agg(F.signum(F.avg(east)).cast("int").alias("sign")).withColumn("consistent", F.col("sign") == want)


def model_rms_min(field: DataFrame, value: str, fraction: float = 0.02) -> DataFrame:
    return field.agg((F.stddev_pop(value) * fraction).alias("rms_min"))


def on_profile(depth: Column, depths: Sequence[float], values: Sequence[float]) -> Column:
    """Piecewise linear between layers, held at both ends; of a repeated depth the later value holds below it."""
    out = F.lit(float(values[-1]))
    for (d0, v0), (d1, v1) in reversed(list(zip(zip(depths, values, strict=True), zip(depths[1:], values[1:], strict=True), strict=False))):
        if d1 > d0:
            out = F.when(depth < d1, F.lit(float(v0)) + (depth - d0) * ((v1 - v0) / (d1 - d0))).otherwise(out)
    return F.when(depth < depths[0], F.lit(float(values[0]))).otherwise(out)


def boundary_elements(params: DataFrame, side: str) -> DataFrame:
    """Elements at an end of the mesh by their (s, z) place: left, right, top or bottom."""
    column, pick = {"left": ("s", F.min), "right": ("s", F.max), "top": ("z", F.max), "bottom": ("z", F.min)}[side]
    end = params.agg(pick(column)).first()[0]
    return params.where(F.abs(F.col(column) - F.lit(end)) < 1e-6)


def box_response(n: int, size: int) -> np.ndarray:
    """What a box filter makes of ones along an axis: the share of its window inside."""
    i = np.arange(n)
    return (np.minimum(i + size - size // 2 - 1, n - 1) - np.maximum(i - size // 2, 0) + 1) / size


def cell_sizes(n: int, least: int, most: int | None = None) -> list[int]:
    """Every length that halving an axis of n pixels can give, largest first."""
    found, todo = set(), [n]
    while todo:
        m = todo.pop()
        if m not in found:
            found.add(m)
            if m >= 2 * least or (most and m > most and m >= 2):
                todo += [m // 2, m - m // 2]
    return sorted(found, reverse=True)


#: Bytes of a cube that may travel with a function.
CUBE_BYTES = 64 << 20


def trilinear(points: DataFrame, cube: dict[str, np.ndarray], heights: np.ndarray, ys: np.ndarray, xs: np.ndarray, h: str = "h", y: str = "y", x: str = "x") -> DataFrame:
    """``points`` with each layer of a (height, y, x) cube: height is held at its ends, places outside are void.

    A cube of metadata size (a few megabytes) travels with the function; a larger
    one becomes a table that the points join.
    """
    import pandas as pd

    if sum(v.nbytes for v in cube.values()) > CUBE_BYTES:
        return trilinear_joined(points, cube, heights, ys, xs, h, y, x)
    axes = []
    for a in (heights, ys, xs):
        order = np.argsort(a)
        axes.append((np.asarray(a, float)[order], order))
    layers = {k: np.asarray(v, float)[np.ix_(*(o for _, o in axes))] for k, v in cube.items()}
    schema = points.select("*", *(F.lit(None).cast("double").alias(k) for k in layers)).schema

    def run(frames):
        for f in frames:
            at = [np.clip(f[h].to_numpy(float), axes[0][0][0], axes[0][0][-1]), f[y].to_numpy(float), f[x].to_numpy(float)]
            inside = np.ones(len(f), bool)
            low, part = [], []
            for (axis, _), v in zip(axes, at, strict=True):
                inside &= (v >= axis[0]) & (v <= axis[-1])
                i = np.clip(np.searchsorted(axis, v, side="right") - 1, 0, len(axis) - 2)
                low.append(i)
                part.append((v - axis[i]) / (axis[i + 1] - axis[i]))
            out = f.copy()
            for k, values in layers.items():
                total = np.zeros(len(f))
                for corner in np.ndindex(2, 2, 2):
                    w = np.prod([p if c else 1 - p for c, p in zip(corner, part, strict=True)], axis=0)
                    total += w * values[tuple(i + c for i, c in zip(low, corner, strict=True))]
                out[k] = pd.Series(total.astype(np.float32).astype(float), index=f.index).where(inside)
            yield out

    return points.mapInPandas(run, schema)


def trilinear_joined(points: DataFrame, cube: dict[str, np.ndarray], heights: np.ndarray, ys: np.ndarray, xs: np.ndarray, h: str = "h", y: str = "y", x: str = "x") -> DataFrame:
    """As :func:`trilinear` for a cube of any size: its cells are rows, and each point joins the one that holds it.

    The axes are literals; a cell's row has the values of its eight corners.
    """
    import pandas as pd

    spark = points.sparkSession
    axes = []
    for a in (heights, ys, xs):
        order = np.argsort(a)
        axes.append((np.asarray(a, float)[order], order))
    layers = {k: np.asarray(v, float)[np.ix_(*(o for _, o in axes))] for k, v in cube.items()}
    nh, ny, nx = (len(a) for a, _ in axes)
    corners = list(np.ndindex(2, 2, 2))

    def rows() -> Iterator[DataFrame]:
        for i in range(nh - 1):  # one level at a time, so the driver never holds the table whole
            flat = {f"_{k}_{a}{b}{c}": v[i + a, b : ny - 1 + b, c : nx - 1 + c].ravel() for k, v in layers.items() for a, b, c in corners}
            at = np.indices((ny - 1, nx - 1)).reshape(2, -1)
            yield spark.createDataFrame(pd.DataFrame({"_i": np.full(at.shape[1], i), "_j": at[0], "_m": at[1], **flat}))

    cells = None
    for part in rows():
        cells = part if cells is None else cells.unionByName(part)
    cells = written(cells, "cube-cells")

    def place(v: Column, axis: np.ndarray) -> tuple[Column, Column]:
        # The number of axis values that do not exceed v, less one, held inside the axis.
        below = F.size(F.filter(F.array(*(F.lit(float(a)) for a in axis)), lambda a: a <= v)) - 1
        k = F.greatest(F.lit(0), F.least(below, F.lit(len(axis) - 2)))
        lo = F.element_at(F.array(*(F.lit(float(a)) for a in axis)), k + 1)
        hi = F.element_at(F.array(*(F.lit(float(a)) for a in axis)), k + 2)
        return k.cast("long"), (v - lo) / (hi - lo)

    held = F.greatest(F.lit(float(axes[0][0][0])), F.least(F.col(h), F.lit(float(axes[0][0][-1]))))
    told = points
    for name, v, (axis, _) in zip(("i", "j", "m"), (held, F.col(y), F.col(x)), axes, strict=True):
        k, part = place(v, axis)
        told = told.withColumn(f"_{name}", k).withColumn(f"_f{name}", part)
    inside = F.col(y).between(float(axes[1][0][0]), float(axes[1][0][-1])) & F.col(x).between(float(axes[2][0][0]), float(axes[2][0][-1]))
    both = told.join(cells, ["_i", "_j", "_m"], "left")
    weight = lambda a, b, c: (F.col("_fi") if a else 1 - F.col("_fi")) * (F.col("_fj") if b else 1 - F.col("_fj")) * (F.col("_fm") if c else 1 - F.col("_fm"))
    values = {k: F.when(inside, sum((weight(*c) * F.col(f"_{k}_{c[0]}{c[1]}{c[2]}") for c in corners), F.lit(0.0)).cast("float").cast("double")) for k in layers}
    return both.withColumns(values).select(*points.columns, *layers)
