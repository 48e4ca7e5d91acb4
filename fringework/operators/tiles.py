"""Tile kernels: an explicit halo exchange around any array function.

Pixels go to every tile whose halo holds them, a tile becomes an array, the
function runs on it, and the halo is cut off again. The result does not depend on
the tiling if the halo is at least the function's reach.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fringework.functions import kernels as K
from fringework.functions import tiling
from fringework.storage import written

TILE = 256


def exchanged(pixels: DataFrame, tile: int, halo: int) -> DataFrame:
    """``pixels`` with (ty, tx), once for each of the tiles that need them."""
    low = lambda c: F.floor((F.col(c) - halo) / tile)
    high = lambda c: F.floor((F.col(c) + halo) / tile)
    out = pixels.withColumn("ty", F.explode(F.sequence(F.greatest(low("yi"), F.lit(0)), high("yi"))))
    return out.withColumn("tx", F.explode(F.sequence(F.greatest(low("xi"), F.lit(0)), high("xi"))))


def _array(pdf: pd.DataFrame, name: str, y0: int, x0: int, shape: tuple[int, int]) -> np.ndarray:
    out = np.full(shape, np.nan)
    out[pdf["yi"].to_numpy() - y0, pdf["xi"].to_numpy() - x0] = pdf[name].to_numpy(float)
    return out


def map_tiles(pixels: DataFrame, kernel: Callable[..., Sequence[np.ndarray]], inputs: Sequence[str], outputs: Sequence[str], ny: int, nx: int, halo: int, tile: int = TILE, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, yi, xi, outputs): ``kernel(*arrays)`` on every tile with its halo, clipped to the raster.

    A kernel whose reach covers the raster gets it whole (``tile`` of at least its size).
    """
    kinds = {f.name: f.dataType.simpleString() for f in pixels.schema}
    schema = ", ".join([f"{k} {kinds[k]}" for k in keys] + ["yi long", "xi long"] + [f"{o} double" for o in outputs])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        *own, ty, tx = key
        y0, x0 = max(0, ty * tile - halo), max(0, tx * tile - halo)
        y1, x1 = min(ny, (ty + 1) * tile + halo), min(nx, (tx + 1) * tile + halo)
        got = kernel(*(_array(pdf, n, y0, x0, (y1 - y0, x1 - x0)) for n in inputs))
        inside = pdf[(pdf["yi"] // tile == ty) & (pdf["xi"] // tile == tx)]
        yi, xi = inside["yi"].to_numpy(), inside["xi"].to_numpy()
        out = {k: v for k, v in zip(keys, own, strict=True)} | {"yi": yi, "xi": xi}
        return pd.DataFrame(out | {o: g[yi - y0, xi - x0] for o, g in zip(outputs, got, strict=True)})

    need = exchanged(pixels.select(*keys, "yi", "xi", *inputs), tile, halo)
    # Tiles that lie beyond the raster hold only halo.
    need = need.where((F.col("ty") * tile < ny) & (F.col("tx") * tile < nx))
    made = need.groupBy(*keys, "ty", "tx").applyInPandas(run, schema)
    return made.withColumns({o: F.when(~F.isnan(o), F.col(o)) for o in outputs})


def gaussian_smooth(pixels: DataFrame, value: str, sigma: float, ny: int, nx: int, tile: int = TILE) -> DataFrame:
    return map_tiles(pixels, lambda a: [K.smooth_surface(a, sigma)], [value], ["smooth"], ny, nx, int(4 * sigma + 0.5), tile)


def _response(column: str, n: int, values: np.ndarray, half: int) -> Column:
    """What the filter has of the raster along an axis, by the distance to the nearer end; one where neither is near."""
    table = F.array(*(F.lit(float(v)) for v in (values[:half] if n > 2 * half else values)))
    at = F.least(F.col(column), F.lit(n - 1) - F.col(column)) if n > 2 * half else F.col(column)
    return F.coalesce(F.get(table, at.cast("int")), F.lit(1.0))


def gaussian_multilook(pixels: DataFrame, value: str, looks: int, ny: int, nx: int, min_valid_fraction: float = 0.5, downsample: bool = True, tile: int = TILE, keys: Sequence[str] = ()) -> DataFrame:
    """Values smoothed by a Gaussian of ``looks`` pixels over the valid ones, at the middle of each block of whole blocks or at every pixel.

    The share of valid weight is measured against what the filter has of the
    raster at that place (it loses weight at the border), so an edge is no hole.
    """
    half = int(4 * looks + 0.5)
    along = K.border_response(ny, looks), K.border_response(nx, looks)

    def kernel(a: np.ndarray) -> list[np.ndarray]:
        valid = np.isfinite(a)
        return [K.gaussian(np.where(valid, a, 0.0), looks), K.gaussian(valid.astype(float), looks)]

    made = map_tiles(pixels, kernel, [value], ["_s", "_w"], ny, nx, half, tile, keys)
    out = made.withColumn(value, F.when(F.col("_w") >= F.lit(min_valid_fraction) * _response("yi", ny, along[0], half) * _response("xi", nx, along[1], half), F.col("_s") / F.col("_w"))).select(*keys, "yi", "xi", value)
    if not downsample:
        return out
    first = looks // 2
    whole = (F.col("yi") < ny // looks * looks) & (F.col("xi") < nx // looks * looks)
    middle = (F.col("yi") % looks == first) & (F.col("xi") % looks == first)
    return out.where(whole & middle).select(*keys, F.expr(f"yi div {looks}").alias("yi"), F.expr(f"xi div {looks}").alias("xi"), value)


def deramped_smooth(pixels: DataFrame, value: str, sigma: float, ny: int, nx: int, tile: int = TILE) -> DataFrame:
    """The value less its smooth surface; a smooth signal goes with it."""
    surface = gaussian_smooth(pixels, value, sigma, ny, nx, tile)
    return pixels.join(surface, ["yi", "xi"]).withColumn(value, F.col(value) - F.col("smooth")).drop("smooth")


def outliers_removed(pixels: DataFrame, value: str, sigma: float, threshold: float, rounds: int, ny: int, nx: int, tile: int = TILE) -> DataFrame:
    return map_tiles(pixels, lambda a: [K.without_outliers(a, sigma, threshold, rounds)], [value], [value], ny, nx, int(4 * sigma + 0.5) * rounds, tile)


def goldstein(igram: DataFrame, ny: int, nx: int, alpha: float | None = 0.5, patch: int = 32, overlap: float = 0.75, tile: int = TILE, keys: Sequence[str] = ("pair",), coherence: str = "coherence") -> DataFrame:
    """Filtered (re, im). Without ``alpha`` it adapts: a patch is filtered the harder the less coherent it is.

    Tiles are whole steps of the patch lattice and the halo is a patch, so patches
    fall alike in every tiling.
    """
    step = max(1, round(patch * (1 - overlap)))
    tile = -(-tile // step) * step
    inputs = ["re", "im"] + ([coherence] if alpha is None else [])

    def kernel(re: np.ndarray, im: np.ndarray, coh: np.ndarray | None = None) -> list[np.ndarray]:
        z = K.goldstein(re + 1j * im, alpha, patch, overlap, coherence=coh)
        return [z.real, z.imag]

    return map_tiles(igram, kernel, inputs, ["re", "im"], ny, nx, -(-patch // step) * step, tile, keys)


def pixel_offsets(ref: DataFrame, sec: DataFrame, origins_y: Sequence[int], origins_x: Sequence[int], size: int, search: int, upsample: int = 16, window: int = 16, min_valid: float = 0.5, shift: tuple[int, int] = (0, 0)) -> DataFrame:
    """(gy, gx, y_offset, x_offset, strength) on a lattice of patches of even spacing; each patch is a group of its own pixels.

    A pixel computes the patches that hold it from the lattice's step, so nothing
    is joined or sent for that. ``shift``: whole pixels by which the second image
    is known to be displaced; it is read there, and the offsets contain it.
    """
    n = size + 2 * search

    def covers(column: str, origins: Sequence[int]) -> Column:
        if not len(origins):
            return F.array().cast("array<long>")
        first, step, count = origins[0], (origins[1] - origins[0]) if len(origins) > 1 else n, len(origins)
        if any(b - a != step for a, b in zip(origins, origins[1:], strict=False)):
            raise ValueError("patches must be evenly spaced")
        low = F.greatest(F.ceil((F.col(column) - first - n + 1) / step), F.lit(0))
        high = F.least(F.floor((F.col(column) - first) / step), F.lit(count - 1))
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<long>"))

    moved = sec.select((F.col("yi") - shift[0]).alias("yi"), (F.col("xi") - shift[1]).alias("xi"), F.col("v").alias("b"))
    both = ref.select("yi", "xi", F.col("v").alias("a")).join(moved, ["yi", "xi"], "full_outer")
    placed = both.withColumn("gy", F.explode(covers("yi", origins_y))).withColumn("gx", F.explode(covers("xi", origins_x)))
    oy, ox = list(origins_y), list(origins_x)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = oy[key[0]], ox[key[1]]
        dy, dx, s = K.pixel_offset(_array(pdf, "a", y0, x0, (n, n)), _array(pdf, "b", y0, x0, (n, n)), size, search, upsample, window, min_valid)
        return pd.DataFrame({"gy": [key[0]], "gx": [key[1]], "y_offset": [dy + shift[0]], "x_offset": [dx + shift[1]], "strength": [s]})

    made = placed.groupBy("gy", "gx").applyInPandas(run, "gy long, gx long, y_offset double, x_offset double, strength double")
    return made.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("y_offset", "x_offset", "strength")})


def unwrap(phase: DataFrame, ny: int, nx: int, keys: Sequence[str] = ("pair",), most: int = tiling.TILE_PIXELS, overlap: int = tiling.OVERLAP) -> DataFrame:
    """(keys, yi, xi, unw, conncomp) of each pair.

    A raster of up to ``most`` samples is one task a pair. A larger one is cut into
    overlapping tiles that are unwrapped side by side; where a region of one tile
    meets one of the next they differ by whole cycles, the median over their common
    pixels. Regions and their meetings are a graph: every region is shifted by the
    cycles on its way to the first one of its component, a few rows a tile.
    """
    if ny * nx <= most:
        return map_tiles(phase, lambda p: K.unwrapped(p), ["phase"], ["unw", "conncomp"], ny, nx, 0, max(ny, nx), keys)
    return _unwrap_tiled(phase, ny, nx, list(keys), most, overlap)


def _unwrap_tiled(phase: DataFrame, ny: int, nx: int, keys: list[str], most: int, overlap: int) -> DataFrame:
    tiles = tiling.tile_grid(ny, nx, most, overlap)
    shared = tiling.overlap_of(ny, nx, tiles, overlap)
    spans = [tiling.tile_spans(n, t, o) for n, t, o in zip((ny, nx), tiles, shared, strict=True)]
    inside = lambda c, axis: F.filter(F.array(*(F.struct(F.lit(i).alias("t"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, (a, b) in enumerate(spans[axis]))), lambda s: (s["a"] <= F.col(c)) & (F.col(c) < s["b"]))
    placed = phase.select(*keys, "yi", "xi", "phase", F.explode(inside("yi", 0)).alias("_y"))
    placed = placed.withColumn("_x", F.explode(inside("xi", 1))).select(*keys, F.col("_y.t").alias("ty"), F.col("_x.t").alias("tx"), "yi", "xi", "phase")
    kinds = {f.name: f.dataType.simpleString() for f in phase.schema}

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        *own, ty, tx = key
        (y0, y1), (x0, x1) = spans[0][ty], spans[1][tx]
        unw, label = K.unwrapped(_array(pdf, "phase", y0, x0, (y1 - y0, x1 - x0)))
        yi, xi = pdf["yi"].to_numpy(), pdf["xi"].to_numpy()
        at = (yi - y0, xi - x0)
        return pd.DataFrame({**dict(zip(keys, own, strict=True)), "ty": ty, "tx": tx, "yi": yi, "xi": xi, "_u": unw[at], "_c": np.nan_to_num(label[at]).astype(np.int64)})

    schema = ", ".join([f"{k} {kinds[k]}" for k in keys] + ["ty int", "tx int", "yi long", "xi long", "_u double", "_c long"])
    made = placed.groupBy(*keys, "ty", "tx").applyInPandas(run, schema).where("_c > 0 AND NOT isnan(_u)")
    region = (F.col("ty") * F.lit(tiles[1]) + F.col("tx")) * F.lit(1 << 32) + F.col("_c")
    made = written(made.withColumn("_r", region), "unwrapped-tiles")
    first = made.select(*keys, "yi", "xi", F.col("_r").alias("a"), F.col("_u").alias("ua"))
    second = made.select(*keys, "yi", "xi", F.col("_r").alias("b"), F.col("_u").alias("ub"))
    meets = first.join(second, [*keys, "yi", "xi"]).where("a < b")
    cycles = meets.groupBy(*keys, "a", "b", F.rint((F.col("ua") - F.col("ub")) / (2 * np.pi)).cast("long").alias("k")).agg(F.count("*").alias("n"))
    # The commonest whole number of cycles; ties: the least.
    best = cycles.groupBy(*keys, "a", "b").agg(F.max_by("k", F.struct("n", -F.col("k"))).alias("k"), F.sum("n").alias("n"))
    shifts = _region_shifts(best, made.select(*keys, F.col("_r").alias("r")).distinct(), keys, kinds)
    told = made.join(shifts, [made["_r"] == shifts["r"], *(made[k].eqNullSafe(shifts[k]) for k in keys)]).select(*(made[k] for k in keys), "yi", "xi", (F.col("_u") + F.col("shift") * F.lit(2 * np.pi)).alias("unw"), F.col("label").alias("conncomp"), "_r")
    # A pixel of several tiles is taken from the first.
    one = told.groupBy(*keys, "yi", "xi").agg(F.min(F.struct("_r", "unw", "conncomp")).alias("_m"))
    return phase.select(*keys, "yi", "xi").join(one.select(*keys, "yi", "xi", "_m.unw", F.col("_m.conncomp").cast("double").alias("conncomp")), [*keys, "yi", "xi"], "left")


def _region_shifts(meets: DataFrame, regions: DataFrame, keys: list[str], kinds: dict[str, str]) -> DataFrame:
    """(keys, r, shift, label): cycles that bring each region to the first of its component, over the strongest meetings first.

    One task a pair: it holds regions and meetings, not pixels; of a tile there are a few.
    """
    every = meets.select(*keys, "a", "b", "k", "n").unionByName(regions.select(*keys, F.col("r").alias("a"), F.col("r").alias("b"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("n")))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        parent: dict[int, tuple[int, int]] = {}

        def find(r: int) -> tuple[int, int]:
            total = 0
            while parent[r][0] != r:
                total += parent[r][1]
                r = parent[r][0]
            return r, total

        for r in sorted(set(pdf["a"]) | set(pdf["b"])):
            parent[r] = (r, 0)
        for a, b, k in pdf[pdf["n"] > 0].sort_values(["n", "a", "b"], ascending=[False, True, True])[["a", "b", "k"]].itertuples(index=False):
            (ra, sa), (rb, sb) = find(a), find(b)
            if ra != rb:  # b's region plus k cycles is a's
                low, high, shift = (ra, rb, k + sa - sb) if ra < rb else (rb, ra, -(k + sa - sb))
                parent[high] = (low, shift)
        found = {r: find(r) for r in parent}
        roots = {root: i + 1 for i, root in enumerate(sorted({f[0] for f in found.values()}))}
        return pd.DataFrame({**dict(zip(keys, key, strict=True)), "r": list(found), "shift": [f[1] for f in found.values()], "label": [roots[f[0]] for f in found.values()]})

    schema = ", ".join([f"{k} {kinds[k]}" for k in keys] + ["r long", "shift long", "label long"])
    return every.groupBy(*keys).applyInPandas(run, schema)
