"""Line-of-sight stacks: look geometry at each pixel, terrain heights, and lattices in lon/lat or local metres.

A displacement stack is a table (pair, yi, xi, los); its geometry is one table
(yi, xi, los_east, los_north, los_up, incidence_angle, ...) that all pairs share.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import ceil, floor

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fringework.operators import geometry as G
from fringework.operators.interferometry import phase_to_los
from fringework.operators.masks import footprint
from fringework.operators.merging import warped_layers
from fringework.operators.scenes import CUBE_BYTES, filled_from, trilinear, trilinear_joined

#: Fixed value: metres a second.
SPEED_OF_LIGHT = 299_792_458.0
LOOK = ("los_east", "los_north", "los_up")
#: Ten seconds of arc on the ground.
ARCSEC_10 = 309.0


def wavelength(center_frequency: float) -> float:
    return SPEED_OF_LIGHT / center_frequency


def decoded(value: Column) -> Column:
    """Text from bytes or text, without the zero bytes that fill a fixed width and without white space around it."""
    return F.trim(F.regexp_replace(F.decode(value.cast("binary"), "UTF-8"), "\\x00+$", ""))


def completed_look(geometry: DataFrame, sensor_to_target: bool = False) -> DataFrame:
    """Unit look vectors towards the sensor with the incidence angle in degrees.

    Raises if the vectors have no unit length to begin with, or point down: both
    are a wrong declaration, not noise. One aggregate decides.
    """
    e, n, u = (-F.col(c) if sensor_to_target else F.col(c) for c in LOOK)
    norm = F.sqrt(e * e + n * n + u * u)
    told = geometry.agg(F.percentile_approx(F.when(norm > 0, norm), 0.5, 10_000).alias("norm"), F.avg(F.when(norm > 0, u)).alias("up")).first()
    if told["norm"] is None:
        raise ValueError("no pixel has a look vector")
    if not 0.9 <= told["norm"] <= 1.1:
        raise ValueError(f"the look components are not those of a unit vector: their median length is {told['norm']:.3g}")
    if told["up"] <= 0:
        raise ValueError(f"the mean up component is {told['up']:+.3f}: the vectors point away from the sensor")
    unit = {c: F.when(norm > 0, v / norm) for c, v in zip(LOOK, (e, n, u), strict=True)}
    out = geometry.withColumns(unit)
    return out.withColumn("incidence_angle", F.when(F.col("los_up").isNotNull(), F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("los_up")))))))


def sampled_geometry(pixels: DataFrame, cube: Mapping[str, np.ndarray], heights: np.ndarray, ys: np.ndarray, xs: np.ndarray, height: str = "height", y: str = "y", x: str = "x") -> DataFrame:
    """``pixels`` (x, y in the cube's projection, height) with the cube's layers and the up component they imply.

    A cube of metadata size travels with the function; a larger one is a table that its pixels join.
    """
    if sum(np.asarray(v).nbytes for v in cube.values()) <= CUBE_BYTES:
        out = trilinear(pixels, dict(cube), heights, ys, xs, height, y, x)
    else:
        out = trilinear_joined(pixels, dict(cube), heights, ys, xs, height, y, x)
    up = F.lit(1.0) - F.col("los_east") * F.col("los_east") - F.col("los_north") * F.col("los_north")
    return out.withColumn("los_up", F.when(up.isNotNull(), F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), up)))))


def combined_geometry(parts: Sequence[DataFrame]) -> DataFrame:
    """The geometry of a merged scene: each pixel from the first frame that covers it."""
    names = [c for c in parts[0].columns if c not in ("yi", "xi")]
    return filled_from(parts[0], parts[1:], ["yi", "xi"], names)


def dem_on_lattice(pixels: DataFrame, dem: DataFrame | None, x0: float = 0.0, dx: float = 1.0, y0: float = 0.0, dy: float = -1.0, height: str = "h") -> DataFrame:
    """``pixels`` (yi, xi, x, y) with the terrain height there: bilinear from ``dem`` (yi, xi, height), 0 where it has none."""
    if dem is None:
        return pixels.withColumn("height", F.lit(0.0))
    place = pixels.select(F.col("yi").alias("ty"), F.col("xi").alias("tx"), ((F.col("y") - y0) / dy).alias("sy"), ((F.col("x") - x0) / dx).alias("sx"))
    found = warped_layers(dem, place, [height]).select(F.col("ty").alias("yi"), F.col("tx").alias("xi"), F.col(height).alias("height"))
    return pixels.join(found, ["yi", "xi"], "left").withColumn("height", F.when(F.isnan("height"), 0.0).otherwise(F.coalesce("height", F.lit(0.0))))


def los_stack(unwrapped: DataFrame, geometry: DataFrame, radar_wavelength: float, sign: int = 1, mask_geometry: bool = True) -> tuple[DataFrame, DataFrame]:
    """(pair, yi, xi, los) in metres towards the sensor, and the geometry of the pixels that any pair covers."""
    if sign not in (1, -1):
        raise ValueError("the sign is 1 or -1")
    los = unwrapped.select("pair", "yi", "xi", phase_to_los(F.col("unw"), radar_wavelength, sign).alias("los"))
    return los, footprint(geometry, los, "los") if mask_geometry else geometry


def projected(enu: DataFrame, geometry: DataFrame, east: str = "ux", north: str = "uy", up: str = "uz") -> DataFrame:
    """(yi, xi, los): ground displacement seen along each pixel's own look vector."""
    both = enu.join(geometry.select("yi", "xi", *LOOK), ["yi", "xi"])
    return both.select("yi", "xi", (F.col(east) * F.col("los_east") + F.col(north) * F.col("los_north") + F.col(up) * F.col("los_up")).alias("los"))


def grid_transform(x0: float, dx: float, y0: float, dy: float) -> tuple[float, float, float, float, float, float]:
    """The affine numbers (a, b, c, d, e, f) of a grid from its first pixel's centre and its spacing: they start at the pixel's edge."""
    return dx, 0.0, x0 - dx / 2, 0.0, dy, y0 - dy / 2


def frame_axes(boxes: Sequence[tuple[float, float, float, float]], spacing: float = ARCSEC_10, bounds: tuple[float, float, float, float] | None = None, pad: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """x ascending and y descending over all boxes (x_min, x_max, y_min, y_max): whole multiples of the spacing, so that any choice of scenes shares pixels."""
    if spacing <= 0:
        raise ValueError("the spacing must be positive")
    if bounds is None:
        if not boxes:
            raise ValueError("a lattice needs a scene")
        low, high = np.min(boxes, axis=0), np.max(boxes, axis=0)
        bounds = (low[0], high[1], low[2], high[3])
    x_min, x_max, y_min, y_max = bounds[0] - pad, bounds[1] + pad, bounds[2] - pad, bounds[3] + pad
    x = np.arange(floor(x_min / spacing), ceil(x_max / spacing) + 1) * spacing
    y = np.arange(floor(y_min / spacing), ceil(y_max / spacing) + 1)[::-1] * spacing
    return x, y


def lattice(spark: SparkSession, x: Sequence[float], y: Sequence[float]) -> DataFrame:
    """(ty, tx, x, y) of every pixel of regular axes; made where it is used, so nothing is sent."""
    nx, ny = len(x), len(y)
    dx, dy = (float(a[1] - a[0]) if len(a) > 1 else 0.0 for a in (x, y))
    ids = spark.range(nx * ny).select(F.expr(f"id div {nx}").alias("ty"), F.expr(f"id % {nx}").alias("tx"))
    return ids.select("ty", "tx", (F.lit(float(x[0])) + F.col("tx") * F.lit(dx)).alias("x"), (F.lit(float(y[0])) + F.col("ty") * F.lit(dy)).alias("y"))


def resampled_onto(pixels: DataFrame, targets: DataFrame, values: Sequence[str], x: Column, y: Column, x0: float, dx: float, y0: float, dy: float, method: str = "bilinear") -> DataFrame:
    """(ty, tx, values) at ``targets``, whose place in the source's own coordinates is (x, y)."""
    place = targets.select("ty", "tx", ((y - F.lit(y0)) / F.lit(dy)).alias("sy"), ((x - F.lit(x0)) / F.lit(dx)).alias("sx"))
    return warped_layers(pixels, place, values, method)


def to_lonlat(pixels: DataFrame, values: Sequence[str], lon0: float, lon: Sequence[float], lat: Sequence[float], x0: float, dx: float, y0: float, dy: float, false_northing: float = 0.0, method: str = "bilinear") -> DataFrame:
    """(ty, tx, lon, lat, values): a raster in transverse Mercator about ``lon0`` on a lattice in lon/lat."""
    targets = lattice(pixels.sparkSession, lon, lat)
    east, north = G.tmerc_columns(F.col("x"), F.col("y"), lon0)
    found = resampled_onto(pixels, targets, values, east, north + F.lit(false_northing), x0, dx, y0, dy, method)
    return targets.select("ty", "tx", F.col("x").alias("lon"), F.col("y").alias("lat")).join(found, ["ty", "tx"])


def footprint_box(pixels: DataFrame, x: Column, y: Column, valid: Column) -> tuple[float, float, float, float] | None:
    """(x_min, x_max, y_min, y_max) of the valid pixels."""
    r = pixels.where(valid).agg(F.min(x).alias("a"), F.max(x).alias("b"), F.min(y).alias("c"), F.max(y).alias("d")).first()
    return None if r["a"] is None else (r["a"], r["b"], r["c"], r["d"])


def resampled_scenes(scenes: Mapping[str, tuple[DataFrame, float, float, float, float]], values: Sequence[str], spacing: float = ARCSEC_10, pad: float = 0.0, method: str = "bilinear") -> tuple[dict[str, DataFrame], np.ndarray, np.ndarray]:
    """Scenes (pixels, x0, dx, y0, dy in one frame's metres) on one lattice: their tables (ty, tx, values) and its axes."""
    boxes = []
    for df, x0, dx, y0, dy in scenes.values():
        box = footprint_box(df, F.col("xi") * F.lit(dx) + F.lit(x0), F.col("yi") * F.lit(dy) + F.lit(y0), F.greatest(*(F.col(v).isNotNull().cast("int") for v in values), F.lit(0)) > 0)
        boxes += [box] if box else []
    x, y = frame_axes(boxes, spacing, pad=pad)
    spark = next(iter(scenes.values()))[0].sparkSession
    return {name: resampled_onto(df, lattice(spark, x, y), values, F.col("x"), F.col("y"), x0, dx, y0, dy, method) for name, (df, x0, dx, y0, dy) in scenes.items()}, x, y


def unwrapped_product(parts: Sequence[tuple[int, DataFrame]]) -> DataFrame:
    """Granules that come unwrapped as one stack (pair, yi, xi, unw, conncomp, coherence, and any optional layers).

    Labels that are the product's fill (65535) or missing become 0; a layer that
    some granules lack is null in them, a subswath mask 255.
    """
    if not parts:
        raise ValueError("a stack needs a granule")
    out = None
    for pair, df in parts:
        named = df.select(F.lit(pair).cast("long").alias("pair"), *df.columns)
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    sizes = out.groupBy("pair").agg(F.count("*").alias("n"), F.sum(F.xxhash64("yi", "xi").cast("decimal(38,0)")).alias("h")).select("n", "h").distinct()
    if sizes.count() != 1:
        raise ValueError("the granules do not share a lattice")
    label = F.when(F.coalesce(F.col("conncomp").cast("double"), F.lit(65535.0)) == 65535, F.lit(0)).otherwise(F.col("conncomp")).cast("long")
    out = out.withColumn("conncomp", label)
    return out.withColumn("subswath_mask", F.coalesce("subswath_mask", F.lit(255))) if "subswath_mask" in out.columns else out
