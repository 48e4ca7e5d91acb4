"""Masks and predicates on pixel tables; null is invalid."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from fringework.functions.union import forest
from fringework.operators.graph import components as graph_components
from fringework.storage import small_side, written


def trim_along_track(pixels: DataFrame, value: str, edge: int, keys: Sequence[str] = ()) -> DataFrame:
    """Voids the valid pixels within ``edge`` columns of each row's first and last valid one."""
    if edge <= 0:
        return pixels
    row = Window.partitionBy(*keys, "yi")
    at = F.when(F.col(value).isNotNull(), F.col("xi"))
    keep = (F.col("xi") >= F.min(at).over(row) + edge) & (F.col("xi") <= F.max(at).over(row) - edge)
    return pixels.withColumn(value, F.when(keep, F.col(value)))


def erode(pixels: DataFrame, value: str, steps: int, keys: Sequence[str] = ()) -> DataFrame:
    """Keeps a value if every pixel within an L1 distance of ``steps`` is valid and inside the raster.

    Along a row, each pixel's distance to the nearest invalid or absent one comes
    from two running windows. A pixel stays if the distance of each pixel k rows
    away exceeds ``steps`` - k, which is a least value over a frame of rows: two
    shuffles whatever the reach, and no row is copied.
    """
    if steps <= 0:
        return pixels
    row = Window.partitionBy(*keys, "yi").orderBy("xi")
    so_far, from_here = row.rowsBetween(Window.unboundedPreceding, 0), row.rowsBetween(0, Window.unboundedFollowing)
    xi, yi, ok = F.col("xi"), F.col("yi"), F.col(value).isNotNull()
    near = lambda f: f(value).over(row).isNotNull() & (F.abs(f("xi").over(row) - xi) == 1)
    stop = lambda f, step: F.when(~ok, xi).when(~F.coalesce(near(f), F.lit(False)), xi + step)
    marked = pixels.withColumn("_l", stop(F.lag, -1)).withColumn("_r", stop(F.lead, 1))
    marked = marked.withColumn("_d", F.least(xi - F.max("_l").over(so_far), F.min("_r").over(from_here) - xi)).drop("_l", "_r")
    column = Window.partitionBy(*keys, "xi").orderBy("yi")
    above, below, around = column.rangeBetween(-steps, 0), column.rangeBetween(0, steps), column.rangeBetween(-steps, steps)
    keep = (F.min(F.col("_d") - yi).over(above) + yi > steps) & (F.min(F.col("_d") + yi).over(below) - yi > steps) & (F.count(F.lit(1)).over(around) == 2 * steps + 1)
    return marked.withColumn(value, F.when(keep, F.col(value))).drop("_d")


def trim_edges(pixels: DataFrame, values: Sequence[str], edge: int, edges: str = "along_track", keys: Sequence[str] = (), inside: Column | None = None) -> DataFrame:
    """Several layers of a stage, trimmed by their common footprint: what one of them lacks none keeps.

    ``edges``: ``along_track`` cuts the ends of rows, ``all`` erodes from every
    side. ``inside`` (a product's own mask) is applied first.
    """
    if edges not in ("along_track", "all"):
        raise ValueError(f"unknown edges {edges!r}")
    valid = F.lit(True) if inside is None else F.coalesce(inside, F.lit(False))
    for v in values:
        valid = valid & F.col(v).isNotNull()
    marked = pixels.withColumn("_both", F.when(valid, F.lit(1)))
    marked = (trim_along_track if edges == "along_track" else erode)(marked, "_both", edge, keys)
    return marked.withColumns({v: F.when(F.col("_both").isNotNull(), F.col(v)) for v in values}).drop("_both")


def subswath_valid(mask: Column) -> Column:
    """Both acquisitions have a subswath number (tens and units) and the pixel is inside."""
    return (mask != 255) & (F.floor(mask / 10) % 10 > 0) & (mask % 10 > 0)


def above_coherence(coherence: Column, least: float) -> Column:
    """True where coherence reaches the threshold; null and NaN do not."""
    return F.coalesce((coherence >= F.lit(least)) & ~F.isnan(coherence), F.lit(False))


def footprint(geometry: DataFrame, pixels: DataFrame, value: str) -> DataFrame:
    """The geometry of pixels where any slice has data."""
    return geometry.join(pixels.where(F.col(value).isNotNull()).select("yi", "xi").distinct(), ["yi", "xi"], "left_semi")


def add_cycles(unw: Column, cycles: int, chosen: Column) -> Column:
    """Whole cycles on the chosen pixels."""
    from math import pi

    if int(cycles) != cycles:
        raise ValueError("cycles must be a whole number")
    return F.when(chosen, unw + F.lit(2 * pi * int(cycles))).otherwise(unw)


#: Rows and columns of a tile, whose pixels one task labels: 16 bytes each.
TILE = 1024


def _tile(column: str, tile: int) -> Column:
    return F.expr(f"({column} - pmod({column}, {tile})) div {tile}")


def _joined(left: DataFrame, right: DataFrame, keys: Sequence[str], on: Sequence[str], how: str = "inner") -> DataFrame:
    """``left`` with the other columns of ``right``, by keys that may be null and by ``on``."""
    names = {c: f"_right_{c}" for c in (*keys, *on)}
    right = right.withColumnsRenamed(names)
    if not names:
        return left.crossJoin(right)
    match = F.lit(True)
    for c, n in names.items():
        match = match & (left[c].eqNullSafe(right[n]) if c in keys else left[c] == right[n])
    return left.join(right, match, how).drop(*names.values())


def _tile_runs(y: np.ndarray, x: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first and last column, row-major index of the component's first pixel) of the runs of a tile's pixels."""
    order = np.lexsort((x, y))
    y, x = y[order], x[order]
    first = np.r_[True, (y[1:] != y[:-1]) | (x[1:] - x[:-1] > 1)]
    y, x0, x1 = y[first], x[first], x[np.r_[first[1:], True]]
    # Runs ascend by row and column, so those of the next row that touch a run are neighbours in the list.
    span = int(x1.max() - x0.min()) + 4
    place = lambda row, column: (row - y[0]) * span + column - x0.min() + 2
    low = np.searchsorted(place(y, x1), place(y + 1, x0 - reach), "left")
    high = np.searchsorted(place(y, x0), place(y + 1, x1 + reach), "right")
    many = np.maximum(high - low, 0)
    above = np.repeat(np.arange(len(y)), many)
    below = np.arange(many.sum()) - np.repeat(many.cumsum() - many, many) + np.repeat(low, many)
    label = np.arange(len(y))
    node, least = forest(above, below)
    label[node] = least
    return y, x0, x1, (y * (1 << 31) + x0)[label]


def _runs(pixels: DataFrame, value: str, connectivity: int, keys: Sequence[str], tile: int) -> DataFrame:
    """(keys, yi, x0, x1, component): runs of valid pixels, cut at the edges of tiles, with their component."""
    reach = 0 if connectivity == 1 else 1
    keys = list(keys)
    valid = pixels.where(F.col(value).isNotNull()).select(*keys, F.col("yi").cast("long"), F.col("xi").cast("long"))
    schema = StructType([*(pixels.schema[k] for k in keys), *(StructField(n, LongType()) for n in ("yi", "x0", "x1", "_root"))])

    def labelled(table: pa.Table) -> pa.Table:
        found = _tile_runs(table["yi"].to_numpy(), table["xi"].to_numpy(), reach)
        same = pa.array(np.zeros(len(found[0]), np.int64))
        return pa.table([*(table[k].take(same) for k in keys), *map(pa.array, found)], names=schema.names)

    runs = written(valid.groupBy(*keys, _tile("yi", tile).alias("_ty"), _tile("xi", tile).alias("_tx")).applyInArrow(labelled, schema), "runs")
    # Pixels at the edges of tiles link the components of tiles that touch.
    last, inside = tile - 1, F.expr(f"pmod(yi, {tile}) not in (0, {tile - 1})")
    ends = F.when(inside, F.expr(f"filter(array_distinct(array(x0, x1)), x -> pmod(x, {tile}) in (0, {last}))")).otherwise(F.sequence("x0", "x1"))
    edges = runs.where(~inside | F.expr(f"pmod(x0, {tile}) = 0 or pmod(x1, {tile}) = {last}")).select(*keys, "yi", F.explode(ends).alias("xi"), "_root")
    steps = [(1, 0), (0, 1)] + [(1, 1), (1, -1)] * reach
    ahead = F.explode(F.array(*(F.struct((F.col("yi") + dy).alias("yi"), (F.col("xi") + dx).alias("xi")) for dy, dx in steps))).alias("_to")
    sides = edges.select(*keys, _tile("yi", tile).alias("_ty"), _tile("xi", tile).alias("_tx"), F.col("_root").alias("_from"), ahead)
    sides = sides.select(*keys, "_from", F.col("_to.yi").alias("yi"), F.col("_to.xi").alias("xi"), "_ty", "_tx").where((_tile("yi", tile) != F.col("_ty")) | (_tile("xi", tile) != F.col("_tx")))
    links = written(_joined(sides, edges, keys, ["yi", "xi"]).select(*keys, "_from", "_root").distinct(), "links")
    # Components of a stack are told apart by a number for their slice, which slices have few of.
    if keys:
        numbers = written(links.select(*keys).distinct().withColumn("_slice", F.row_number().over(Window.orderBy(*keys)) - 1), "slices")
        links = _joined(links, numbers, keys, [])
    node = lambda c: F.struct(F.coalesce("_slice", F.lit(-1)).alias("_slice"), F.coalesce(c, F.lit(0)).alias("_place")) if keys else F.col(c)
    linked = graph_components(links.select(node("_from").alias("a"), node("_root").alias("b")))
    if keys:
        linked = _joined(linked.select("node._slice", F.col("node._place").alias("_root"), F.col("component._place").alias("component")), numbers, ["_slice"], []).drop("_slice")
    else:
        linked = linked.withColumnRenamed("node", "_root")
    # Row-major indices ascend, so the least component of the tiles holds the first pixel.
    labels = small_side(linked.select(*keys, "_root", "component"), "labels")
    return _joined(runs, labels, keys, ["_root"], "left").select(*keys, "yi", "x0", "x1", F.coalesce("component", "_root").alias("component"))


def components(pixels: DataFrame, value: str, connectivity: int = 1, keys: Sequence[str] = (), tile: int = TILE) -> DataFrame:
    """(keys, yi, xi, component): connected valid pixels of each slice; the component is the least row-major index of its pixels.

    A tile of ``tile`` rows and columns is labelled by one task, over its runs of
    pixels. Components of tiles that touch are linked by the pixels at the edges
    of tiles, and the components of that graph, which has a few nodes for each
    tile, are the components of the raster: the pixels move once.
    """
    spread = _runs(pixels, value, connectivity, keys, tile).withColumn("xi", F.explode(F.sequence("x0", "x1")))
    return spread.select(*keys, *(F.col(c).cast(pixels.schema[c].dataType).alias(c) for c in ("yi", "xi")), "component")


def kept_components(pixels: DataFrame, value: str, min_size: int | None = None, connectivity: int = 1, keys: Sequence[str] = (), max_drop_fraction: float | None = None, tile: int = TILE) -> DataFrame:
    """Voids small components of each slice: those under or at ``min_size``, or all but the largest (ties: the first in row-major order).

    With ``max_drop_fraction`` it raises if a dropped component has more than that
    share of its slice's valid pixels: that is a second landmass, not debris. What
    is kept meets the pixels as a row of bits for each 64 columns.
    """
    keys = list(keys)
    runs = written(_runs(pixels, value, connectivity, keys, tile), "labelled-runs")
    sizes = runs.groupBy(*keys, "component").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("_n"))
    if min_size is None:
        most = sizes.groupBy(*keys).agg(F.max(F.struct("_n", -F.col("component"))).alias("_most"))
        sizes = _joined(sizes, most, keys, []).withColumn("_stay", F.struct("_n", -F.col("component")) == F.col("_most")).drop("_most")
    else:
        sizes = sizes.withColumn("_stay", F.col("_n") > min_size)
    sizes = written(sizes, "component-sizes")
    if max_drop_fraction is not None:
        whole = sizes.groupBy(*keys).agg(F.max(F.when(~F.col("_stay"), F.col("_n"))).alias("most"), F.sum("_n").alias("n"))
        worst = whole.agg(F.max(F.col("most") / F.col("n")).alias("w")).first()["w"]
        if worst is not None and worst > max_drop_fraction:
            raise ValueError(f"a dropped component has {worst:.1%} of its slice's valid pixels, more than {max_drop_fraction:.1%}")
    kept = _joined(runs, sizes.where("_stay").select(*keys, "component", F.lit(True).alias("_stay")), keys, ["component"])
    bins = kept.select(*keys, "yi", "x0", "x1", F.explode(F.sequence(_tile("x0", 64), _tile("x1", 64))).alias("_bin"))
    bits = F.expr("shiftleft(-1L, cast(greatest(x0 - _bin * 64, 0) as int)) & shiftrightunsigned(-1L, cast(63 - least(x1 - _bin * 64, 63) as int))")
    masks = bins.groupBy(*keys, "yi", "_bin").agg(F.bit_or(bits).alias("_bits"))
    found = _joined(pixels.withColumn("_bin", _tile("xi", 64)), masks, keys, ["yi", "_bin"], "left")
    return found.withColumn(value, F.when(F.expr("shiftright(_bits, cast(pmod(xi, 64) as int)) & 1") == 1, F.col(value))).select(*pixels.columns)
