"""Observations for an inversion: adaptive cells of a displacement raster, and cells chosen by a model's own prediction."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fringework.functions.triangles import Mesh
from fringework.operators import inversion as V
from fringework.operators import looks as K
from fringework.operators import statistics as S
from fringework.operators.geometry import trace_distance
from fringework.operators.scenes import model_rms_min
from fringework.storage import dropped, written

#: Peak slip in metres below which a model says nothing about where to sample.
DEGENERATE_SLIP = 1e-3
#: Cells near the trace are refined out to so many times the distance that is excluded.
REFINE_MULTIPLE = 5.0
#: Most that any element's slip may move, in metres, for the rounds to have settled.
SETTLED = 1e-3


@dataclass(frozen=True)
class Grid:
    """Where a raster's pixels lie, in the metres of the common frame."""

    ny: int
    nx: int
    x0: float
    dx: float
    y0: float
    dy: float

    def columns(self) -> tuple:
        return F.col("xi") * F.lit(self.dx) + F.lit(self.x0), F.col("yi") * F.lit(self.dy) + F.lit(self.y0)


def observations(
    pixels: DataFrame, grid: Grid, name: str = "track", trace: Sequence[tuple[float, float]] | None = None, rms_min: float = 0.005, width_min: float = 1000.0, width_max: float = 20000.0,
    min_valid_fraction: float = 0.5, exclude_within: float = 0.0, stat: str = "mean", field: str | None = None, refine_within: float = 0.0, max_levels: int | None = None,
) -> DataFrame:
    """(x, y, los, look_e, look_n, look_u, std, cell_size, n, weight, track) of pixels (yi, xi, los, los_east, los_north, los_up).

    A pixel counts if its displacement and look vector are valid. With ``field``,
    a model's prediction at each pixel, the cells are chosen by that and filled
    from the data; cells near the trace then split whatever it says. Cells nearer
    to the trace than ``exclude_within`` go. Look vectors are averaged as decimals
    of twelve places, whose sums are exact, so a mean does not depend on the order
    of its pixels. ``max_levels`` is the quadtree's.
    """
    if stat not in ("mean", "median"):
        raise ValueError("the statistic is mean or median")
    if (exclude_within > 0 or refine_within > 0) and trace is None:
        raise ValueError("a distance needs a trace")
    look = {c: F.round(F.col(c).cast("double"), 12).try_cast("decimal(28,12)") for c in K.LOOK}
    whole = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in ("los", *([field] if field else []))] + [c.isNotNull() for c in look.values()]
    valid = whole[0]
    for w in whole[1:]:
        valid = valid & w
    x, y = grid.columns()
    held = pixels.select("yi", "xi", F.when(valid, F.col("los").cast("double")).alias("los"), *(F.when(valid, c).alias(n) for n, c in look.items()), F.when(valid, F.col(field or "los").cast("double")).alias("_split"))
    refine = None
    if refine_within > 0:
        near = trace_distance(held.withColumn("x", x).withColumn("y", y), "x", "y", trace)
        held, refine = near.withColumn("_near", F.col("distance") <= refine_within).select(*held.columns, "_near"), "_near"
    cells_of = lambda width, spacing: max(1, round(width / abs(spacing)))
    cells = S.quadtree(
        held, "_split", grid.ny, grid.nx, rms_min, cells_of(width_min, grid.dy), cells_of(width_min, grid.dx), cells_of(width_max, grid.dy), cells_of(width_max, grid.dx), min_valid_fraction, refine,
        max_levels=max_levels,
    )
    rows = S.reduced_cells(held, cells, "los", stat, grid.dx, grid.dy, grid.x0, grid.y0, dict(zip(K.LOOK, ("look_e", "look_n", "look_u"), strict=True)))
    if trace is not None and exclude_within > 0:
        rows = trace_distance(rows, "x", "y", trace).where(F.col("distance") > exclude_within)
    names = ("x", "y", "los", "look_e", "look_n", "look_u", "std", "cell_size", "n")
    return rows.select(*names, F.lit(1.0).alias("weight"), F.lit(name).alias("track"))


def predicted_los(pixels: DataFrame, grid: Grid, model: V.Model, engine: V.Engine | None = None, spacing: float = 1000.0) -> DataFrame:
    """(yi, xi, predicted): the model's displacement on a coarse lattice, interpolated by component and seen along each pixel's look vector."""
    edge = sorted((grid.x0, grid.x0 + (grid.nx - 1) * grid.dx)) + sorted((grid.y0, grid.y0 + (grid.ny - 1) * grid.dy))
    x, y = K.frame_axes([tuple(edge)], spacing, pad=2 * spacing)
    coarse = written(V.surface_displacement(K.lattice(pixels.sparkSession, x, y), model, engine).select(F.col("ty").alias("yi"), F.col("tx").alias("xi"), "ux", "uy", "uz"), "coarse-field")
    px, py = grid.columns()
    targets = pixels.select(F.col("yi").alias("ty"), F.col("xi").alias("tx"), px.alias("x"), py.alias("y"))
    fine = K.resampled_onto(coarse, targets, ["ux", "uy", "uz"], F.col("x"), F.col("y"), float(x[0]), spacing, float(y[0]), -spacing)
    return K.projected(fine.withColumnsRenamed({"ty": "yi", "tx": "xi"}), pixels).withColumnRenamed("los", "predicted")


def iterated(
    scenes: Mapping[str, tuple[DataFrame, Grid]], mesh: Mesh, trace: Sequence[tuple[float, float]], sample: Mapping[str, dict], coarse: dict | None = None, solving: dict | None = None, engine: V.Engine | None = None,
    basis: str = "element", ramp: str = "none", max_rounds: int = 5, tol: float = SETTLED, spacing: float = 1000.0, refine_within: float | None = None, rms_fraction: float = 0.02, normalize: str = "sqrt_count",
    told: Callable[[dict], None] | None = None,
) -> tuple[DataFrame, V.Model, list[dict]]:
    """Observations, model and a row for each round: sample coarsely, solve, then sample by the model's prediction until its slip settles.

    The observations of a round are written, so a round's plan is its own; the
    driver holds the model, which has a few numbers for each element.
    """
    if not scenes or set(scenes) - set(sample):
        raise ValueError("every scene needs its sampling parameters")
    if refine_within is None:
        refine_within = REFINE_MULTIPLE * max(float(sample[n].get("exclude_within", 0.0)) for n in scenes)
    chosen = V.make_basis(mesh, basis)

    def solved(parts: list[tuple[str, DataFrame, float]]) -> tuple[DataFrame, V.Model]:
        obs = written(S.concat_weights(parts, normalize), "observations")
        return obs, V.solve(V.equations(obs, mesh, engine, chosen, ramp), mesh, chosen, engine=getattr(engine, "name", "half space"), **(solving or {}))

    first = []
    for name, (pixels, grid) in scenes.items():
        how = dict(sample[name])
        how.update(coarse if coarse is not None else {"width_min": 3 * float(how.get("width_min", 1000.0))})
        first.append((name, observations(pixels, grid, name, trace, **how), 1.0))
    obs, model = solved(first)
    history = [{"round": 0, "n": obs.count(), "field": "data", "variance_reduction": model.variance_reduction, "max_change": None, "converged": model.converged}]
    for number in range(1, max_rounds + 1):
        if told:
            told(history[-1])
        if np.abs(model.slip).max(initial=0.0) < DEGENERATE_SLIP:
            warnings.warn(f"round {number} is sampled by a model without slip: lower the smoothing weight", RuntimeWarning, stacklevel=2)
        parts = []
        for name, (pixels, grid) in scenes.items():
            field = written(predicted_los(pixels, grid, model, engine, spacing), "predicted")
            how = dict(sample[name]) | {"rms_min": model_rms_min(field, "predicted", rms_fraction).first()["rms_min"] or 0.0}
            parts.append((name, observations(pixels.join(field, ["yi", "xi"]), grid, name, trace, field="predicted", refine_within=refine_within, **how), 1.0))
        last, (obs, model_) = obs, solved(parts)
        dropped(last.sparkSession, last)
        change = float(np.abs(model_.slip - model.slip).max(initial=0.0))
        model = model_
        history.append({"round": number, "n": obs.count(), "field": "model", "variance_reduction": model.variance_reduction, "max_change": change, "converged": model.converged})
        if change <= tol:
            break
    if told:
        told(history[-1])
    return obs, model, history
