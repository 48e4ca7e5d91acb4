"""Fault traces, meshes, lattices and projections as columns, with numpy twins where a driver needs them."""

from __future__ import annotations

from collections.abc import Sequence
from math import atan, atanh, ceil, cos, cosh, degrees, floor, radians, sin, sinh, sqrt

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Vertex = tuple[float, float]


def nearest_segment(x: Column, y: Column, trace: Sequence[Vertex]) -> Column:
    """struct(d2, seg, s, cross): the nearest segment of the polyline, the first on ties.

    The trace is a literal array, so every point looks at its segments in place.
    """
    s, parts = 0.0, []
    for i, ((x0, y0), (x1, y1)) in enumerate(zip(trace, trace[1:], strict=False)):
        dx, dy = x1 - x0, y1 - y0
        length = sqrt(dx * dx + dy * dy)
        if not length:
            continue
        t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((x - x0) * dx + (y - y0) * dy) / (length * length)))
        px, py = F.lit(x0) + t * dx, F.lit(y0) + t * dy
        d2 = (x - px) * (x - px) + (y - py) * (y - py)
        cross = F.lit(dx) * (y - y0) - F.lit(dy) * (x - x0)
        parts.append(F.struct(d2.alias("d2"), F.lit(i).alias("seg"), (F.lit(s) + t * length).alias("s"), cross.alias("cross")))
        s += length
    return F.array_min(F.array(*parts))


def trace_distance(df: DataFrame, x: str, y: str, trace: Sequence[Vertex], tol: float = 0.0) -> DataFrame:
    """``df`` with distance, side (sign of the cross product with the nearest segment), s and offset along and across the trace."""
    near = df.withColumn("_n", nearest_segment(F.col(x), F.col(y), trace))
    d = F.sqrt("_n.d2")
    side = F.when(d <= tol, 0).otherwise(F.signum("_n.cross").cast("int")) if tol else F.signum("_n.cross").cast("int")
    return near.withColumns({"distance": d, "side": side, "s": F.col("_n.s"), "offset": side * d}).drop("_n")


def arc_length(x: Sequence[float], y: Sequence[float]) -> np.ndarray:
    return np.concatenate([[0.0], np.cumsum(np.hypot(np.diff(x), np.diff(y)))])


def resampled(trace: Sequence[Vertex], spacing: float) -> np.ndarray:
    """The polyline at equal steps of about ``spacing``, both ends kept."""
    xy = np.asarray(trace, float)
    s = arc_length(xy[:, 0], xy[:, 1])
    n = max(2, int(round(s[-1] / spacing)) + 1)
    at = np.linspace(0, s[-1], n)
    return np.column_stack([np.interp(at, s, xy[:, k]) for k in (0, 1)])


def tangents(trace: Sequence[Vertex]) -> np.ndarray:
    """Unit tangents by central differences, one-sided at the ends."""
    t = np.gradient(np.asarray(trace, float), axis=0) if len(trace) > 2 else np.repeat(np.diff(np.asarray(trace, float), axis=0), 2, axis=0)
    return t / np.linalg.norm(t, axis=1, keepdims=True)


def left_normals(trace: Sequence[Vertex]) -> np.ndarray:
    """Unit normals to the left of the trace at its vertices."""
    t = tangents(trace)
    return np.column_stack([-t[:, 1], t[:, 0]])


def without_repeats(trace: Sequence[Vertex]) -> np.ndarray:
    """The trace without vertices that repeat the one before; two must be left."""
    xy = np.asarray(trace, float)
    keep = np.r_[True, (np.diff(xy, axis=0) != 0).any(axis=1)]
    if keep.sum() < 2:
        raise ValueError("a trace needs two vertices")
    return xy[keep]


def at_length(trace: Sequence[Vertex], share: float) -> np.ndarray:
    """The place at a share of the trace's length; half of it is where a frame begins."""
    xy = np.asarray(trace, float)
    s = arc_length(xy[:, 0], xy[:, 1])
    return np.array([np.interp(share * s[-1], s, xy[:, k]) for k in (0, 1)])


def straight_segments(trace: Sequence[Vertex], count: int = 1) -> np.ndarray:
    """(count, 4): chords x0, y0, x1, y1 between places of equal length along the trace."""
    ends = np.array([at_length(trace, k / count) for k in range(count + 1)])
    return np.column_stack([ends[:-1], ends[1:]])


def pushed_down(segment: Sequence[float], depth: float, dip: float) -> np.ndarray:
    """(2, 3): a segment's ends on a plane that dips to its left, at a depth; beyond 90 degrees it leans the other way."""
    x0, y0, x1, y1 = segment
    run = 0.0 if abs(dip - 90) < 0.01 else depth / np.tan(np.radians(dip))
    n = np.array([y0 - y1, x1 - x0]) / np.hypot(x1 - x0, y1 - y0)
    return np.column_stack([np.array([[x0, y0], [x1, y1]]) + run * n, [-depth, -depth]])


def from_curvilinear(s: Column, across: Column, trace: Sequence[Vertex]) -> tuple[Column, Column]:
    """The place at a distance along the trace and to its left; beyond the ends the first and last segments go on."""
    xy = np.asarray(trace, float)
    length = arc_length(xy[:, 0], xy[:, 1])
    x = y = None
    for i in reversed(range(len(xy) - 1)):
        d = (xy[i + 1] - xy[i]) / (length[i + 1] - length[i])
        along = s - F.lit(float(length[i]))
        px = F.lit(float(xy[i, 0])) + along * F.lit(float(d[0])) - across * F.lit(float(d[1]))
        py = F.lit(float(xy[i, 1])) + along * F.lit(float(d[1])) + across * F.lit(float(d[0]))
        here = s < F.lit(float(length[i + 1]))
        x, y = (px, py) if x is None else (F.when(here, px).otherwise(x), F.when(here, py).otherwise(y))
    return x, y


def min_curvature_radius(trace: Sequence[Vertex]) -> float:
    """The least radius by second derivatives along the arc; infinite for a straight trace."""
    xy = np.asarray(trace, float)
    if len(xy) < 3:
        return float("inf")
    s = arc_length(xy[:, 0], xy[:, 1])
    h0, h1 = np.diff(s)[:-1], np.diff(s)[1:]
    second = 2 * ((xy[2:].T - xy[1:-1].T) / h1 - (xy[1:-1].T - xy[:-2].T) / h0) / (h0 + h1)
    k = np.hypot(*second).max()
    return float(1 / k) if k > 1e-15 else float("inf")


def dip_offset(depth: Column, dip: Column) -> Column:
    """Horizontal distance of a dipping plane at a depth; exactly zero within 0.01 degrees of vertical."""
    return F.when(F.abs(dip - 90) < 0.01, F.lit(0.0)).otherwise(depth / F.tan(F.radians(dip)))


def patch_origins(n: int, patch: int, step: int) -> list[int]:
    """0, step, ... and a last patch flush with the edge; none where the patch does not fit."""
    out = list(range(0, n - patch + 1, step))
    if out and out[-1] != n - patch:
        out.append(n - patch)
    return out


def offset_locations(n: int, window: int, count: int | None = None, step: int | None = None, shift: int = 0) -> list[int]:
    """Origins of a uniform lattice of windows, inset by an a-priori shift; give exactly one of ``count`` and ``step``. None where they do not fit."""
    if (count is None) == (step is None):
        raise ValueError("give a count or a step")
    low = max(0, -shift)
    span = min(n, n - shift) - window - low
    if span < 0:
        return []
    if step is not None:
        return list(range(low, low + span + 1, step))
    if count == 1:
        return [low + span // 2]
    gap = span // (count - 1)
    if gap < 1:
        return []
    return [low + i * gap for i in range(count)]


def union_lattice(a: tuple[float, float, float], b: tuple[float, float]) -> list[float]:
    """(first, spacing, last) extended by whole steps to cover the interval b."""
    first, d, last = a
    low, high = sorted(b) if d > 0 else sorted(b, reverse=True)
    lead, tail = max(0, ceil((first - low) / d - 1e-3)), max(0, ceil((high - last) / d - 1e-3))
    n = round((last - first) / d) + 1
    return [first + (i - lead) * d for i in range(n + lead + tail)]


def lattice_offset(first_ref: float, first: float, spacing: float) -> int:
    """Whole pixels between two lattices; an offset off by more than a thousandth of a pixel is an error."""
    off = (first - first_ref) / spacing
    if abs(off - round(off)) > 1e-3:
        raise ValueError("the lattices are offset by part of a pixel")
    return round(off)


def depth_levels(top: float, bottom: float, n: int, bias: float = 1.0) -> np.ndarray:
    """n + 1 levels whose thicknesses grow geometrically to ``bias`` times the first."""
    ratio = bias ** (1 / (n - 1)) if n > 1 else 1.0
    steps = ratio ** np.arange(n)
    return top + (bottom - top) * np.concatenate([[0.0], np.cumsum(steps) / steps.sum()])


# Meshes: nodes (node_id, x, y, z) and elements (element_id, n1, n2, n3).


def edges_of(elements: DataFrame) -> DataFrame:
    """(element_id, a, b) of every undirected edge, a < b."""
    pairs = F.explode(F.array(*(F.struct(F.least(p, q).alias("a"), F.greatest(p, q).alias("b")) for p, q in (("n1", "n2"), ("n2", "n3"), ("n3", "n1")))))
    return elements.select("element_id", pairs.alias("_e")).select("element_id", "_e.a", "_e.b")


def adjacency(elements: DataFrame) -> DataFrame:
    """(element_id, neighbour) of elements that share an edge."""
    e = edges_of(elements)
    other = e.select(F.col("element_id").alias("neighbour"), "a", "b")
    return e.join(other, ["a", "b"]).where("element_id <> neighbour").select("element_id", "neighbour")


def boundary_edges(elements: DataFrame) -> DataFrame:
    """(a, b) of edges that only one element has."""
    return edges_of(elements).groupBy("a", "b").agg(F.count("*").alias("n")).where("n = 1").select("a", "b")


def measured(elements: DataFrame, nodes: DataFrame) -> DataFrame:
    """Elements with area, centroid, unit normal (up), dip, dip direction and strike."""
    out = elements
    for k in ("1", "2", "3"):
        out = out.join(nodes.select(F.col("node_id").alias(f"n{k}"), *(F.col(c).alias(f"{c}{k}") for c in "xyz")), f"n{k}")
    u, v = [F.col(f"{c}2") - F.col(f"{c}1") for c in "xyz"], [F.col(f"{c}3") - F.col(f"{c}1") for c in "xyz"]
    nx, ny, nz = u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]
    norm = F.sqrt(nx * nx + ny * ny + nz * nz)
    up = F.when(nz < 0, -1.0).otherwise(1.0)
    out = out.withColumns({"area": norm / 2, "nx": nx / norm * up, "ny": ny / norm * up, "nz": nz / norm * up, **{f"c{c}": (F.col(f"{c}1") + F.col(f"{c}2") + F.col(f"{c}3")) / 3 for c in "xyz"}})
    azimuth = lambda a: F.when(a < 0, a + 360).otherwise(a)
    dip_direction = azimuth(F.degrees(F.atan2("nx", "ny")))
    return out.select("element_id", "area", "cx", "cy", "cz", "nx", "ny", "nz", F.degrees(F.acos(F.least(F.lit(1.0), F.col("nz")))).alias("dip"), dip_direction.alias("dip_direction"), azimuth(dip_direction - 90).alias("strike"))


def node_neighbours(elements: DataFrame) -> DataFrame:
    """(node_id, neighbour): the ring of nodes around each node."""
    e = edges_of(elements).select("a", "b")
    return e.select(F.col("a").alias("node_id"), F.col("b").alias("neighbour")).unionByName(e.select(F.col("b").alias("node_id"), F.col("a").alias("neighbour"))).distinct()


def nodal_means(elements: DataFrame, values: DataFrame, names: Sequence[str], area: str = "area") -> DataFrame:
    """(node_id, names): the area-weighted mean of what the elements around each node have (element_id, area, names)."""
    per = elements.join(values, "element_id").select(F.explode(F.array("n1", "n2", "n3")).alias("node_id"), F.col(area).alias("_a"), *names)
    return per.groupBy("node_id").agg(*((F.sum(F.col(n) * F.col("_a")) / F.sum("_a")).alias(n) for n in names))


def lumped_areas(elements: DataFrame, areas: DataFrame) -> DataFrame:
    """(node_id, area): a third of the area of the elements around each node."""
    per = elements.join(areas, "element_id").select(F.explode(F.array("n1", "n2", "n3")).alias("node_id"), (F.col("area") / 3).alias("_a"))
    return per.groupBy("node_id").agg(F.sum("_a").alias("area"))


# Transverse Mercator by Krueger's series to the sixth order, on WGS 84.

_A, _FLAT = 6_378_137.0, 1 / 298.257223563
_N = _FLAT / (2 - _FLAT)
_RADIUS = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)
_ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180 - 127 * _N**5 / 288 + 7891 * _N**6 / 37800,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440 + 281 * _N**5 / 630 - 1983433 * _N**6 / 1935360,
    61 * _N**3 / 240 - 103 * _N**4 / 140 + 15061 * _N**5 / 26880 + 167603 * _N**6 / 181440,
    49561 * _N**4 / 161280 - 179 * _N**5 / 168 + 6601661 * _N**6 / 7257600,
    34729 * _N**5 / 80640 - 3418889 * _N**6 / 1995840,
    212378941 * _N**6 / 319334400,
)
_BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360 - 81 * _N**5 / 512 + 96199 * _N**6 / 604800,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440 + 46 * _N**5 / 105 - 1118711 * _N**6 / 3870720,
    17 * _N**3 / 480 - 37 * _N**4 / 840 - 209 * _N**5 / 4480 + 5569 * _N**6 / 90720,
    4397 * _N**4 / 161280 - 11 * _N**5 / 504 - 830251 * _N**6 / 7257600,
    4583 * _N**5 / 161280 - 108847 * _N**6 / 3991680,
    20648693 * _N**6 / 638668800,
)
_ECC = 2 * sqrt(_N) / (1 + _N)
SCALE, FALSE_EASTING = 0.9996, 500_000.0


def utm_zone(lon: float, lat: float) -> int:
    """EPSG code of the UTM zone of a place."""
    return (32600 if lat >= 0 else 32700) + min(60, floor((lon + 180) / 6) + 1)


def to_tmerc(lon: float, lat: float, lon0: float) -> tuple[float, float]:
    t = sinh(atanh(sin(radians(lat))) - _ECC * atanh(_ECC * sin(radians(lat))))
    d = radians(lon - lon0)
    xi, eta = np.arctan2(t, cos(d)), atanh(sin(d) / sqrt(1 + t * t))
    e = eta + sum(a * cos(2 * k * xi) * sinh(2 * k * eta) for k, a in enumerate(_ALPHA, 1))
    n = xi + sum(a * sin(2 * k * xi) * cosh(2 * k * eta) for k, a in enumerate(_ALPHA, 1))
    return FALSE_EASTING + SCALE * _RADIUS * e, SCALE * _RADIUS * float(n)


def from_tmerc(x: float, y: float, lon0: float) -> tuple[float, float]:
    xi, eta = y / (SCALE * _RADIUS), (x - FALSE_EASTING) / (SCALE * _RADIUS)
    a = xi - sum(b * sin(2 * k * xi) * cosh(2 * k * eta) for k, b in enumerate(_BETA, 1))
    e = eta - sum(b * cos(2 * k * xi) * sinh(2 * k * eta) for k, b in enumerate(_BETA, 1))
    tau = t = sin(a) / sqrt(sinh(e) ** 2 + cos(a) ** 2)
    for _ in range(8):  # the latitude of a conformal latitude
        s = sinh(_ECC * atanh(_ECC * t / sqrt(1 + t * t)))
        now = t * sqrt(1 + s * s) - s * sqrt(1 + t * t)
        t += (tau - now) / sqrt(1 + now * now) * (1 + (1 - _ECC**2) * t * t) / ((1 - _ECC**2) * sqrt(1 + t * t))
    return lon0 + degrees(np.arctan2(sinh(e), cos(a))), degrees(atan(t))


def tmerc_columns(lon: Column, lat: Column, lon0: float) -> tuple[Column, Column]:
    """Easting and northing as expressions, the same series."""
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - F.lit(_ECC) * F.atanh(F.lit(_ECC) * s))
    d = F.radians(lon - lon0)
    xi, eta = F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(1 + t * t))
    e, n = eta, xi
    for k, a in enumerate(_ALPHA, 1):
        e = e + F.lit(a) * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
        n = n + F.lit(a) * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
    return F.lit(FALSE_EASTING) + F.lit(SCALE * _RADIUS) * e, F.lit(SCALE * _RADIUS) * n


#: The series that gives the latitude of a conformal latitude, in powers of the third flattening.
_DELTA = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45 + 26 * _N**5 / 45 - 2854 * _N**6 / 675,
    7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45 + 2704 * _N**5 / 315 + 2323 * _N**6 / 945,
    56 * _N**3 / 15 - 136 * _N**4 / 35 - 1262 * _N**5 / 105 + 73814 * _N**6 / 2835,
    4279 * _N**4 / 630 - 332 * _N**5 / 35 - 399572 * _N**6 / 14175,
    4174 * _N**5 / 315 - 144838 * _N**6 / 6237,
    601676 * _N**6 / 22275,
)


def lonlat_columns(x: Column, y: Column, lon0: float) -> tuple[Column, Column]:
    """Longitude and latitude of easting and northing as expressions: the inverse series, without iteration."""
    xi, eta = y / F.lit(SCALE * _RADIUS), (x - F.lit(FALSE_EASTING)) / F.lit(SCALE * _RADIUS)
    a, e = xi, eta
    for k, b in enumerate(_BETA, 1):
        a = a - F.lit(b) * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
        e = e - F.lit(b) * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
    chi = F.asin(F.sin(a) / F.cosh(e))
    lat = chi
    for k, d in enumerate(_DELTA, 1):
        lat = lat + F.lit(d) * F.sin(2 * k * chi)
    return F.lit(lon0) + F.degrees(F.atan2(F.sinh(e), F.cos(a))), F.degrees(lat)


class LocalFrame:
    """Metres about an origin: transverse Mercator about its own meridian, the origin taken off."""

    def __init__(self, lon: float, lat: float, lon0: float | None = None) -> None:
        self.lon, self.lat, self.lon0 = lon, lat, lon if lon0 is None else lon0
        self.x0, self.y0 = to_tmerc(lon, lat, self.lon0)

    def to_local(self, lon: float, lat: float) -> tuple[float, float]:
        x, y = to_tmerc(lon, lat, self.lon0)
        return x - self.x0, y - self.y0

    def to_lonlat(self, x: float, y: float) -> tuple[float, float]:
        return from_tmerc(x + self.x0, y + self.y0, self.lon0)

    @classmethod
    def of_trace(cls, trace: Sequence[Vertex]) -> LocalFrame:
        """About the middle of a trace in lon/lat."""
        return cls(*map(float, at_length(trace, 0.5)))

    def from_zone(self, x: Column, y: Column, epsg: int) -> tuple[Column, Column]:
        """Local metres of places in a UTM zone: by way of lon/lat where the meridians differ, else by a shift."""
        if not (32601 <= epsg <= 32660 or 32701 <= epsg <= 32760):
            raise ValueError(f"{epsg} is no UTM zone")
        lon0 = (epsg % 100) * 6 - 183.0
        y = y - F.lit(10_000_000.0) if epsg >= 32700 else y
        if lon0 == self.lon0:
            return x - F.lit(self.x0), y - F.lit(self.y0)
        return self.columns(*lonlat_columns(x, y, lon0))

    def columns(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        x, y = tmerc_columns(lon, lat, self.lon0)
        return x - F.lit(self.x0), y - F.lit(self.y0)


