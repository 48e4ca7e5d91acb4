"""Land and water on a raster from coastline polygons, without a point-in-polygon test for each pixel.

A polygon's edges are laid over the rows they span; the crossings of a row, in
order, pair up to runs of land. A row of pixels then meets its runs.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from math import cos, radians

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fringework.operators.sampling import Grid
from fringework.plans.stages import Workspace

#: Grid nodes a pixel side, and nodes from which on a mask is called oversized.
OVERSAMPLE, OVERSIZED = 2, 5e7
#: Fixed value: metres of a degree of latitude, for the guard alone.
METRES_A_DEGREE = 111_000.0


def increment(x_spacing: float, geographic: bool, oversample: int = OVERSAMPLE) -> str:
    """The spacing of a mask as text: a part of a pixel, with an ``e`` behind metres."""
    return f"{abs(x_spacing) / oversample:.6g}" + ("" if geographic else "e")


def parsed_increment(text: str) -> tuple[float, bool]:
    """(value, whether it is in metres) of :func:`increment`, or of seconds (s) and minutes (m) of arc."""
    unit = text[-1] if text[-1:].isalpha() else ""
    value = float(text[: -len(unit)] if unit else text)
    if value <= 0 or unit not in ("", "e", "s", "m", "k"):
        raise ValueError(f"not a spacing: {text!r}")
    return {"": (value, False), "e": (value, True), "k": (value * 1000, True), "s": (value / 3600, False), "m": (value / 60, False)}[unit]


def nodes_of(region: tuple[float, float, float, float], spacing: str) -> float:
    """Nodes of a mask over (lon_min, lon_max, lat_min, lat_max); above ``OVERSIZED`` it warns."""
    value, metres = parsed_increment(spacing)
    lon, lat = region[1] - region[0], region[3] - region[2]
    if metres:
        middle = radians((region[2] + region[3]) / 2)
        lon, lat = lon * METRES_A_DEGREE * cos(middle), lat * METRES_A_DEGREE
    n = (lon / value + 1) * (lat / value + 1)
    if n > OVERSIZED:
        warnings.warn(f"the mask has {n:.2g} nodes; a coarser spacing than {spacing} will do", RuntimeWarning, stacklevel=2)
    return n


def edges_of(vertices: DataFrame) -> DataFrame:
    """(x1, y1, x2, y2) of closed rings (ring, seq, x, y)."""
    ring = Window.partitionBy("ring").orderBy("seq")
    whole = Window.partitionBy("ring").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = lambda c: F.coalesce(F.lead(c).over(ring), F.first(c).over(whole))
    return vertices.select(F.col("x").cast("double").alias("x1"), F.col("y").cast("double").alias("y1"), after("x").cast("double").alias("x2"), after("y").cast("double").alias("y2"))


def land_runs(edges: DataFrame, grid: Grid) -> DataFrame:
    """(yi, first, last): runs of pixels whose centres are inside an odd number of rings."""
    # Rows whose y lies in [min(y1, y2), max(y1, y2)): an edge counts its lower end.
    at = lambda y: (F.col(y) - F.lit(grid.y0)) / F.lit(grid.dy)
    low, high = F.least(at("y1"), at("y2")), F.greatest(at("y1"), at("y2"))
    spans = edges.where("y1 <> y2").select("*", F.greatest(F.ceil(low), F.lit(0)).alias("_a"), F.least(F.floor(high), F.lit(grid.ny - 1)).alias("_b")).where("_a <= _b")
    rows = spans.select("x1", "y1", "x2", "y2", F.explode(F.sequence("_a", "_b")).alias("yi")).withColumn("_y", F.lit(grid.y0) + F.col("yi") * F.lit(grid.dy))
    crossed = rows.where((F.col("_y") >= F.least("y1", "y2")) & (F.col("_y") < F.greatest("y1", "y2")))
    x = F.col("x1") + (F.col("_y") - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1"))
    place = crossed.select("yi", ((x - F.lit(grid.x0)) / F.lit(grid.dx)).alias("_p"))
    order = Window.partitionBy("yi").orderBy("_p")
    paired = place.withColumn("_n", F.row_number().over(order)).withColumn("_q", F.lead("_p").over(order)).where("_n % 2 = 1 AND _q IS NOT NULL")
    first, last = F.greatest(F.ceil("_p"), F.lit(0)), F.least(F.ceil("_q") - 1, F.lit(grid.nx - 1))
    return paired.select("yi", first.alias("first"), last.alias("last")).where("first <= last")


def land_mask(edges: DataFrame, grid: Grid) -> DataFrame:
    """(yi, xi) of the pixels on land."""
    return land_runs(edges, grid).select("yi", F.explode(F.sequence("first", "last")).alias("xi")).distinct()


def mask_for_grid(workspace: Workspace, name: str, edges: DataFrame, grid: Grid, overwrite: bool = False) -> DataFrame:
    """The land mask of a grid as a stage: made once for a grid and coastline, then found by their parameters."""
    coast = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("x1", "y1", "x2", "y2").cast("decimal(38,0)")).alias("h")).first()
    params = {**vars(grid), "edges": coast["n"], "coast": str(coast["h"])}
    return workspace.store(name, lambda: land_mask(edges, grid), params, overwrite)


def mask_water(pixels: DataFrame, land: DataFrame, values: Sequence[str]) -> DataFrame:
    """Voids the values of pixels that are not on land, in every slice."""
    marked = pixels.join(land.select("yi", "xi", F.lit(True).alias("_land")), ["yi", "xi"], "left")
    return marked.withColumns({v: F.when(F.col("_land"), F.col(v)) for v in values}).select(*pixels.columns)
