"""Slip inversion on triangulated faults: engines, bases, regularisation, bounds, ramps, models.

Spark sums the normal equations over the observations; what the driver holds has
a row for each unknown (slip components and ramp columns), whatever the number
of observations. Solving the squared system doubles the digits that conditioning
takes: with double sums a condition of 1e8 in the design leaves no correct digit,
so a smoothing weight must be positive where the data alone cannot decide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fringework.functions.elastic import bounded_least_squares
from fringework.functions.triangles import Mesh, triangle_response

#: Rows of the design matrix that a task holds at a time.
ROWS_AT_ONCE = 4096
#: Sides of a mesh where slip is drawn to zero: all but the surface.
SIDES = ("bottom", "left", "right")
RIGIDITY = 30e9


class Engine(Protocol):
    """What computes surface displacement: (points, 3, 2) for unit strike slip and dip slip of one element."""

    name: str

    def response(self, x: np.ndarray, y: np.ndarray, corners: np.ndarray) -> np.ndarray: ...


@dataclass
class HalfSpace:
    """A uniform elastic half space."""

    nu: float = 0.25
    name: str = "half space"

    def response(self, x: np.ndarray, y: np.ndarray, corners: np.ndarray) -> np.ndarray:
        return triangle_response(x, y, corners, self.nu)


@dataclass
class MissingEngine:
    """Stands for the engine of a loaded model whose tables are not there; it refuses to compute."""

    name: str

    def response(self, x: np.ndarray, y: np.ndarray, corners: np.ndarray) -> np.ndarray:
        raise RuntimeError(f"the model was made with the engine {self.name!r}, which was not given")


class Basis(Protocol):
    """What the unknowns are: ``projection`` (elements, unknowns) gives each element's slip from theirs."""

    kind: str

    def projection(self) -> np.ndarray: ...


@dataclass
class ElementBasis:
    mesh: Mesh
    kind: str = "element"

    def projection(self) -> np.ndarray:
        return np.eye(len(self.mesh.triangles))


@dataclass
class NodeBasis:
    """Linear between nodes; an element slips by the mean of its three."""

    mesh: Mesh
    kind: str = "node"

    def projection(self) -> np.ndarray:
        return self.mesh.nodal_weights()


def make_basis(mesh: Mesh, kind: str | Basis = "element") -> Basis:
    if not isinstance(kind, str):
        return kind
    if kind not in ("element", "node"):
        raise ValueError(f"unknown basis {kind!r}")
    return ElementBasis(mesh) if kind == "element" else NodeBasis(mesh)


def mesh_digest(mesh: Mesh) -> str:
    """Sixteen hex digits of the nodes and triangles."""
    return hashlib.sha256(np.ascontiguousarray(mesh.nodes, float).tobytes() + np.ascontiguousarray(mesh.triangles, np.int64).tobytes()).hexdigest()[:16]


def ramp_terms(obs: DataFrame, kind: str = "none", x: str = "x", y: str = "y", track: str = "track") -> list[tuple]:
    """(track, term, centre, span) of the ramp columns: an offset a track, and with ``linear`` its two slopes."""
    if kind == "none":
        return []
    if kind not in ("offset", "linear"):
        raise ValueError(f"unknown ramp {kind!r}")
    out = []
    for r in obs.groupBy(track).agg(*(f(c).alias(f"{n}_{c}") for c in (x, y) for n, f in (("mean", F.avg), ("low", F.min), ("high", F.max)))).orderBy(track).collect():
        out.append((r[track], "offset", 0.0, 1.0))
        if kind == "linear":
            for c in (x, y):
                out.append((r[track], c, float(r[f"mean_{c}"]), max(float(r[f"high_{c}"] - r[f"low_{c}"]), 1.0)))
    return out


def _ramp_columns(frame: pd.DataFrame, terms: Sequence[tuple]) -> np.ndarray:
    columns = [np.where(frame["track"] == t, 1.0 if term == "offset" else (frame[term].to_numpy(float) - c) / s, 0.0) for t, term, c, s in terms]
    return np.column_stack(columns) if columns else np.zeros((len(frame), 0))


def design(frame: pd.DataFrame, mesh: Mesh, engine: Engine, projection: np.ndarray, terms: Sequence[tuple]) -> np.ndarray:
    """Rows (observations) by unknowns: strike slip, dip slip, ramps."""
    look = frame[["look_e", "look_n", "look_u"]].to_numpy(float)
    x, y = frame["x"].to_numpy(float), frame["y"].to_numpy(float)
    g = np.stack([np.einsum("pcs,pc->ps", engine.response(x, y, c), look) for c in mesh.corners()], axis=1)
    return np.column_stack([g[:, :, 0] @ projection, g[:, :, 1] @ projection, _ramp_columns(frame, terms)])


@dataclass
class Equations:
    """Sums over the observations: weighted G'G, G'd, d'd, and the unweighted d, d'd and count of each track."""

    gram: np.ndarray
    rhs: np.ndarray
    data: float
    count: int
    terms: list[tuple] = field(default_factory=list)


def equations(obs: DataFrame, mesh: Mesh, engine: Engine | None = None, basis: Basis | None = None, ramp: str = "none") -> Equations:
    """The normal equations of observations (x, y, los, look_e, look_n, look_u, weight, track)."""
    engine, basis = engine or HalfSpace(), basis or ElementBasis(mesh)
    terms, projection = ramp_terms(obs, ramp), basis.projection()
    m = 2 * projection.shape[1] + len(terms)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((m + 1, m + 1)), 0
        for f in frames:
            for at in range(0, len(f), ROWS_AT_ONCE):
                p = f.iloc[at : at + ROWS_AT_ONCE]
                a = np.column_stack([design(p, mesh, engine, projection, terms), p["los"].to_numpy(float)]) * p["weight"].to_numpy(float)[:, None]
                total += a.T @ a
                n += len(p)
        i, j = np.triu_indices(m + 1)
        yield pd.DataFrame({"i": np.r_[i, -1], "j": np.r_[j, -1], "v": np.r_[total[i, j], float(n)]})

    names = ["x", "y", "los", "look_e", "look_n", "look_u", "weight", "track"]
    whole, n = np.zeros((m + 1, m + 1)), 0
    for i, j, v in obs.select(*names).mapInPandas(run, "i int, j int, v double").groupBy("i", "j").sum("v").collect():
        if i < 0:
            n = int(v)
        else:
            whole[i, j] = whole[j, i] = v
    return Equations(whole[:m, :m], whole[:m, m], float(whole[m, m]), n, terms)


def graph_smoothing(mesh: Mesh, ss_ratio: float = 1.0, ds_ratio: float = 1.0) -> np.ndarray:
    """A row for each pair of neighbouring elements and slip component: their difference."""
    near, n = mesh.neighbours(), len(mesh.triangles)
    out = np.zeros((2 * len(near), 2 * n))
    for k, (i, j) in enumerate(near):
        for c, ratio in enumerate((ss_ratio, ds_ratio)):
            out[c * len(near) + k, [c * n + i, c * n + j]] = ratio, -ratio
    return out


def surface_laplacian(mesh: Mesh, ss_ratio: float = 1.0, ds_ratio: float = 1.0) -> np.ndarray:
    """The cotangent Laplacian of nodal slip over lumped areas, scaled so that its largest row has an absolute sum of 2."""
    n = len(mesh.nodes)
    w = np.zeros((n, n))
    for tri in mesh.triangles:
        for k in range(3):
            a, b, c = tri[k], tri[(k + 1) % 3], tri[(k + 2) % 3]
            u, v = mesh.nodes[b] - mesh.nodes[a], mesh.nodes[c] - mesh.nodes[a]
            cot = float(u @ v / max(np.linalg.norm(np.cross(u, v)), 1e-12))
            w[b, c] += cot / 2
            w[c, b] += cot / 2
    laplacian = (np.diag(w.sum(axis=1)) - w) / np.maximum(mesh.lumped_areas(), 1e-12)[:, None]
    laplacian *= 2 / max(np.abs(laplacian).sum(axis=1).max(), 1e-300)
    zero = np.zeros_like(laplacian)
    return np.block([[ss_ratio * laplacian, zero], [zero, ds_ratio * laplacian]])


def smoothing_rows(basis: Basis, mesh: Mesh, ss_ratio: float = 1.0, ds_ratio: float = 1.0) -> np.ndarray:
    return surface_laplacian(mesh, ss_ratio, ds_ratio) if basis.kind == "node" else graph_smoothing(mesh, ss_ratio, ds_ratio)


def boundary_rows(basis: Basis, mesh: Mesh, sides: Sequence[str] = SIDES, ratio: float = 1.0) -> np.ndarray:
    """A row for each unknown at the given sides and slip component: it wants to be zero."""
    n = basis.projection().shape[1]
    if basis.kind == "node":
        column = {"left": (0, np.min), "right": (0, np.max), "top": (1, np.max), "bottom": (1, np.min)}
        chosen = sorted({int(i) for s in sides for i in np.flatnonzero(np.isclose(mesh.params[:, column[s][0]], column[s][1](mesh.params[:, column[s][0]])))})
    else:
        chosen = sorted({int(i) for s in sides for i in mesh.boundary(s)})
    out = np.zeros((2 * len(chosen), 2 * n))
    for k, i in enumerate(chosen):
        out[2 * k, i] = out[2 * k + 1, n + i] = ratio
    return out


def slip_bounds(n: int, strike: tuple[float, float] = (-10.0, 10.0), dip: tuple[float, float] = (-10.0, 10.0), polarity: Sequence[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of strike and dip slip; a polarity of 1 or -1 forbids the other sign, 0 leaves a component free."""
    if polarity is not None and not len(polarity):
        raise ValueError("a polarity names at least the strike component")
    low, high = [], []
    for k, (a, b) in enumerate((strike, dip)):
        p = 0 if polarity is None or k >= len(polarity) else polarity[k]
        a, b = (max(a, 0.0), b) if p > 0 else (a, min(b, 0.0)) if p < 0 else (a, b)
        if a > b:
            raise ValueError("the bounds leave no slip")
        low += [a] * n
        high += [b] * n
    return np.array(low, float), np.array(high, float)


@dataclass
class Model:
    """A solution: slip of the unknowns, of the elements, ramp coefficients, and how it was found."""

    mesh: Mesh
    basis: str
    engine: str
    coefficients: np.ndarray
    slip: np.ndarray  # (elements, 2)
    ramps: list[tuple]
    smoothing: float
    misfit: float
    roughness: float
    variance_reduction: float
    max_slip: float
    moment: float
    magnitude: float | None
    iterations: int
    status: int
    converged: bool


def solve(eq: Equations, mesh: Mesh, basis: Basis | None = None, smoothing: float = 0.3, ss_ratio: float = 1.0, ds_ratio: float = 3.0, boundary_ratio: float = 1.0, sides: Sequence[str] = SIDES, polarity: Sequence[int] | None = None, strike: tuple[float, float] = (-10.0, 10.0), dip: tuple[float, float] = (-10.0, 10.0), max_iter: int = 400, tol: float = 1e-10, engine: str = "half space", rigidity: float = RIGIDITY) -> Model:
    """Bounded least squares: the data, smoothing rows (weight over their number), and zero slip at the sides; ramps are free."""
    basis = basis or ElementBasis(mesh)
    projection = basis.projection()
    n, extra = projection.shape[1], len(eq.terms)
    rows = smoothing_rows(basis, mesh, ss_ratio, ds_ratio)
    edge = boundary_rows(basis, mesh, sides, boundary_ratio) if boundary_ratio and sides else np.zeros((0, 2 * n))
    scaled = rows * (smoothing / max(1, len(rows)))
    gram = eq.gram.copy()
    gram[: 2 * n, : 2 * n] += scaled.T @ scaled + edge.T @ edge
    low, high = slip_bounds(n, strike, dip, polarity)
    free = np.full(extra, np.inf)
    x, status, its = bounded_least_squares(gram, eq.rhs, np.r_[low, -free], np.r_[high, free], max_iter, tol)
    left = max(0.0, float(x @ eq.gram @ x - 2 * eq.rhs @ x + eq.data))
    slip = np.column_stack([projection @ x[:n], projection @ x[n : 2 * n]])
    moment = float((rigidity * mesh.areas() * np.hypot(slip[:, 0], slip[:, 1])).sum())
    return Model(
        mesh, basis.kind, engine, x[: 2 * n], slip, [(*t, float(v)) for t, v in zip(eq.terms, x[2 * n :], strict=True)], float(smoothing),
        float(np.sqrt(left / max(1, eq.count))), float(np.linalg.norm(rows @ x[: 2 * n])), 100 * (eq.data - left) / eq.data if eq.data else 0.0, float(np.hypot(slip[:, 0], slip[:, 1]).max(initial=0.0)),
        moment, float((np.log10(moment) - 9.1) * 2 / 3) if moment > 0 else None, int(its), int(status), status > 0,
    )


def l_curve(eq: Equations, mesh: Mesh, weights: Sequence[float], basis: Basis | None = None, **how) -> list[dict]:
    """A row for each smoothing weight, from the largest down, over the same sums.

    ``flat``: next to no slip; ``saturated``: slip at a bound; ``capped``: the iterations ran out.
    """
    out = []
    for w in sorted(weights, reverse=True):
        m = solve(eq, mesh, basis, w, **how)
        n = len(m.coefficients) // 2
        bound = [max(abs(v) for v in how.get(k, (-10.0, 10.0))) for k in ("strike", "dip")]
        at_bound = any(np.abs(part).max(initial=0.0) >= 0.999 * b > 0 for part, b in zip((m.coefficients[:n], m.coefficients[n:]), bound, strict=True))
        out.append({
            "smoothing": m.smoothing, "misfit": m.misfit, "roughness": m.roughness, "variance_reduction": m.variance_reduction, "max_slip": m.max_slip, "magnitude": m.magnitude, "iterations": m.iterations,
            "status": m.status, "converged": m.converged, "flat": m.max_slip < 1e-3, "saturated": bool(at_bound), "capped": not m.converged,
        })
    return out


def surface_displacement(points: DataFrame, model: Model, engine: Engine | None = None) -> DataFrame:
    """``points`` (x, y) with ux, uy, uz; blocks of points at a time, so memory does not grow with their number."""
    engine = engine or (HalfSpace() if model.engine == "half space" else MissingEngine(model.engine))
    mesh, slip = model.mesh, model.slip

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), ROWS_AT_ONCE):
                p = f.iloc[at : at + ROWS_AT_ONCE]
                x, y = p["x"].to_numpy(float), p["y"].to_numpy(float)
                total = np.zeros((len(p), 3))
                for k, c in enumerate(mesh.corners()):
                    if slip[k].any():
                        total += engine.response(x, y, c) @ slip[k]
                yield p.assign(ux=total[:, 0], uy=total[:, 1], uz=total[:, 2])

    schema = points.select("*", *(F.lit(None).cast("double").alias(c) for c in ("ux", "uy", "uz"))).schema
    return points.mapInPandas(run, schema)


def predicted(obs: DataFrame, model: Model, engine: Engine | None = None) -> DataFrame:
    """``obs`` with prediction (slip and ramps) and residual."""
    ramps = F.lit(0.0)
    for track, term, centre, span, value in model.ramps:
        column = F.lit(value) if term == "offset" else (F.col(term) - F.lit(centre)) / F.lit(span) * F.lit(value)
        ramps = ramps + F.when(F.col("track") == track, column).otherwise(0.0)
    moved = surface_displacement(obs, model, engine)
    total = F.col("ux") * F.col("look_e") + F.col("uy") * F.col("look_n") + F.col("uz") * F.col("look_u") + ramps
    return moved.withColumn("prediction", total).withColumn("residual", F.col("los") - F.col("prediction")).drop("ux", "uy", "uz")


def element_table(spark: SparkSession, model: Model, rigidity: float = RIGIDITY) -> DataFrame:
    """A row for each element, counted from 1: centre, area, slip, its size and rake, rigidity."""
    c = model.mesh.corners().mean(axis=1)
    rows = [(i + 1, *map(float, c[i]), float(a), float(s), float(d), float(np.hypot(s, d)), float(np.degrees(np.arctan2(d, s))), float(rigidity)) for i, (a, (s, d)) in enumerate(zip(model.mesh.areas(), model.slip, strict=True))]
    return spark.createDataFrame(rows, "id long, x double, y double, z double, area double, strike_slip double, dip_slip double, slip double, rake double, rigidity double")


def node_table(spark: SparkSession, model: Model, rigidity: float = RIGIDITY) -> DataFrame:
    """A row for each node, counted from 1: place, slip, lumped area, rigidity."""
    mesh = model.mesh
    if model.basis == "node":
        n = len(mesh.nodes)
        slip = np.column_stack([model.coefficients[:n], model.coefficients[n:]])
    else:  # the area-weighted mean of the elements around a node
        w = mesh.nodal_weights() * mesh.areas()[:, None]
        slip = (w.T @ model.slip) / np.maximum(w.sum(axis=0), 1e-300)[:, None]
    rows = [(i + 1, *map(float, mesh.nodes[i]), float(slip[i, 0]), float(slip[i, 1]), float(np.hypot(*slip[i])), float(a), float(rigidity)) for i, a in enumerate(mesh.lumped_areas())]
    return spark.createDataFrame(rows, "id long, x double, y double, z double, strike_slip double, dip_slip double, slip double, area double, rigidity double")


def connectivity_table(spark: SparkSession, mesh: Mesh) -> DataFrame:
    return spark.createDataFrame([(i + 1, *(int(v) + 1 for v in t)) for i, t in enumerate(mesh.triangles)], "id long, n1 long, n2 long, n3 long")
