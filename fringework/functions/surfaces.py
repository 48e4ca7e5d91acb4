"""Fault surfaces that bend: a smooth field of sideways offset over distance along the trace and depth, from control points."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

from fringework.functions.triangles import Mesh
from fringework.operators.geometry import min_curvature_radius, tangents

#: Weight of control points at the surface against those below, and control points a cell of the grid.
SURFACE_WEIGHT, SAMPLES_A_CELL = 1e3, 8
SMOOTHNESS = 1.0


def _cell(nodes: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    i = np.clip(np.searchsorted(nodes, v, side="right") - 1, 0, len(nodes) - 2)
    return i, (v - nodes[i]) / (nodes[i + 1] - nodes[i])


def fit_grid(x: Sequence[float], y: Sequence[float], v: Sequence[float], x_nodes: Sequence[float], y_nodes: Sequence[float], smoothness: float = SMOOTHNESS, weights: Sequence[float] | None = None, interpolation: str = "triangle") -> np.ndarray:
    """(y nodes, x nodes): the smoothest field through scattered values, in the sense of least squares.

    A value is a row over the nodes of its cell (its triangle, or all four); each
    node inside adds a row with the second difference along either axis, scaled
    like the data rows by the largest column sum.
    """
    x, y, v = (np.asarray(a, float) for a in (x, y, v))
    xn, yn = np.asarray(x_nodes, float), np.asarray(y_nodes, float)
    if len(x) < 3:
        raise ValueError("a field needs three values")
    if (np.diff(xn) <= 0).any() or (np.diff(yn) <= 0).any():
        raise ValueError("nodes must ascend")
    if x.min() < xn[0] or x.max() > xn[-1] or y.min() < yn[0] or y.max() > yn[-1]:
        raise ValueError("a value lies outside the nodes")
    nx, ny = len(xn), len(yn)
    (i, s), (j, t) = _cell(xn, x), _cell(yn, y)
    a = np.zeros((len(x), nx * ny))
    row = np.arange(len(x))
    at = lambda di, dj: (j + dj) * nx + i + di
    if interpolation == "bilinear":
        for di, dj, w in ((0, 0, (1 - s) * (1 - t)), (1, 0, s * (1 - t)), (0, 1, (1 - s) * t), (1, 1, s * t)):
            a[row, at(di, dj)] += w
    elif interpolation == "triangle":
        upper = s + t > 1
        for di, dj, w in ((0, 0, np.where(upper, 0, 1 - s - t)), (1, 0, np.where(upper, 1 - t, s)), (0, 1, np.where(upper, 1 - s, t)), (1, 1, np.where(upper, s + t - 1, 0))):
            a[row, at(di, dj)] += w
    else:
        raise ValueError(f"unknown interpolation {interpolation!r}")
    w = np.ones(len(x)) if weights is None else np.asarray(weights, float)
    rows = []
    for axis, nodes in ((0, yn), (1, xn)):
        d = np.diff(nodes) / np.diff(nodes).mean()
        for k in range(1, len(nodes) - 1):
            c = np.array([2 / (d[k - 1] * (d[k - 1] + d[k])), -2 / (d[k - 1] * d[k]), 2 / (d[k] * (d[k - 1] + d[k]))])
            for m in range(nx if axis == 0 else ny):
                r = np.zeros(nx * ny)
                for off, value in zip((-1, 0, 1), c, strict=True):
                    r[(k + off) * nx + m if axis == 0 else m * nx + k + off] = value
                rows.append(r)
    rough = np.array(rows) if rows else np.zeros((0, nx * ny))
    norm = lambda m: np.abs(m).sum(axis=0).max() if m.size else 1.0
    scale = smoothness * norm(a) / norm(rough) if len(rough) else 0.0
    whole = np.vstack([a * w[:, None], rough * scale])
    return np.linalg.lstsq(whole, np.r_[v * w, np.zeros(len(rough))], rcond=None)[0].reshape(ny, nx)


def centres(field: np.ndarray) -> np.ndarray:
    """Means of the four nodes around each cell."""
    return (field[:-1, :-1] + field[1:, :-1] + field[:-1, 1:] + field[1:, 1:]) / 4


@dataclass
class Surface:
    """The offset ``cross`` (depths, distances), to the left of the trace, at depths below and distances along."""

    s: np.ndarray
    z: np.ndarray  # positive down, ascending
    cross: np.ndarray

    @classmethod
    def vertical(cls, s: Sequence[float], z: Sequence[float]) -> Surface:
        return cls(np.asarray(s, float), np.asarray(z, float), np.zeros((len(z), len(s))))

    @classmethod
    def from_points(cls, s: Sequence[float], z: Sequence[float], cross: Sequence[float], s_nodes: Sequence[float], z_nodes: Sequence[float], smoothness: float = SMOOTHNESS, weights: Sequence[float] | None = None) -> Surface:
        return cls(np.asarray(s_nodes, float), np.asarray(z_nodes, float), fit_grid(s, z, cross, s_nodes, z_nodes, smoothness, weights))

    @classmethod
    def _through(cls, s_nodes: Sequence[float], z_nodes: Sequence[float], below: list[tuple[np.ndarray, np.ndarray, np.ndarray]], smoothness: float) -> Surface:
        """Through the trace at the surface, which weighs most, and the points below."""
        top = np.linspace(s_nodes[0], s_nodes[-1], SAMPLES_A_CELL * (len(s_nodes) - 1) + 1)
        s, z, c = (np.concatenate(part) for part in zip((top, np.full(len(top), z_nodes[0]), np.zeros(len(top))), *below, strict=True))
        weights = np.where(np.arange(len(s)) < len(top), SURFACE_WEIGHT, 1.0)
        return cls.from_points(s, z, c, s_nodes, z_nodes, smoothness, weights)

    @classmethod
    def from_dips(cls, s_nodes: Sequence[float], z_nodes: Sequence[float], spans: Sequence[tuple[float, float]], dips: Sequence[float], depth: float | None = None, smoothness: float = SMOOTHNESS) -> Surface:
        """Stretches of the trace that dip by an angle each, to the left (over 90: to the right), smooth between."""
        if len(spans) != len(dips):
            raise ValueError("every stretch has one dip")
        z_nodes = np.asarray(z_nodes, float)
        depth = float(z_nodes[-1]) if depth is None else depth
        below = []
        for (a, b), dip in zip(spans, dips, strict=True):
            s = np.linspace(a, b, max(2, SAMPLES_A_CELL * int(np.ceil((b - a) / np.diff(s_nodes).mean()))))
            z = np.linspace(z_nodes[0], depth, SAMPLES_A_CELL * (len(z_nodes) - 1) + 1)[1:]
            ss, zz = (m.ravel() for m in np.meshgrid(s, z))
            run = 0.0 if abs(dip - 90) < 1e-9 else 1 / np.tan(np.radians(dip))
            below.append((ss, zz, (zz - z_nodes[0]) * run))
        return cls._through(s_nodes, z_nodes, below, smoothness)

    @classmethod
    def from_bottom(cls, trace: np.ndarray, bottom: np.ndarray, s_nodes: Sequence[float], z_nodes: Sequence[float], depth: float | None = None, smoothness: float = SMOOTHNESS) -> Surface:
        """Between the trace and a second line at ``depth``; parts of that line beyond the trace's ends are left out, and said so."""
        z_nodes = np.asarray(z_nodes, float)
        depth = float(z_nodes[-1]) if depth is None else depth
        if not z_nodes[0] < depth <= z_nodes[-1]:
            raise ValueError("the bottom lies below the top and inside the grid")
        s, c, inside = along_and_across(trace, bottom)
        if (~inside).any():
            warnings.warn(f"{int((~inside).sum())} of {len(s)} points of the bottom lie beyond the trace", RuntimeWarning, stacklevel=2)
        if inside.sum() < 2:
            raise ValueError("the bottom does not lie beside the trace")
        if np.abs(c[inside]).max() >= min_curvature_radius([tuple(p) for p in trace]):
            raise ValueError("the offset exceeds the trace's radius of curvature: the surface would fold")
        order = np.argsort(s[inside])
        at = np.linspace(s[inside].min(), s[inside].max(), SAMPLES_A_CELL * (len(s_nodes) - 1) + 1)
        cross = np.interp(at, s[inside][order], c[inside][order])
        share = np.linspace(0, 1, SAMPLES_A_CELL * (len(z_nodes) - 1) + 1)[1:]
        below = [(at, np.full(len(at), z_nodes[0] + f * (depth - z_nodes[0])), f * cross) for f in share]
        return cls._through(s_nodes, z_nodes, below, smoothness)

    def _on(self, trace: np.ndarray, s: np.ndarray, cross: np.ndarray, z: np.ndarray) -> np.ndarray:
        length = np.r_[0, np.cumsum(np.hypot(*np.diff(trace, axis=0).T))]
        x, y = (np.interp(s, length, trace[:, k]) for k in (0, 1))
        t = tangents([tuple(p) for p in trace])
        tx, ty = (np.interp(s, length, t[:, k]) for k in (0, 1))
        n = np.maximum(np.hypot(tx, ty), 1e-12)
        return np.column_stack([x - ty / n * cross, y + tx / n * cross, -z])

    def nodes(self, trace: np.ndarray) -> np.ndarray:
        """(depths * distances, 3) places of the grid's nodes, depth by depth."""
        ss, zz = np.meshgrid(self.s, self.z)
        return self._on(trace, ss.ravel(), self.cross.ravel(), zz.ravel())

    def centre_points(self, trace: np.ndarray) -> np.ndarray:
        ss, zz = np.meshgrid((self.s[:-1] + self.s[1:]) / 2, (self.z[:-1] + self.z[1:]) / 2)
        return self._on(trace, ss.ravel(), centres(self.cross).ravel(), zz.ravel())

    def mesh(self, trace: np.ndarray) -> Mesh:
        """Two triangles to each cell of the grid."""
        n, m = len(self.s), len(self.z)
        at = lambda k, i: k * n + i
        tri = [t for k in range(m - 1) for i in range(n - 1) for t in ((at(k, i), at(k + 1, i), at(k, i + 1)), (at(k, i + 1), at(k + 1, i), at(k + 1, i + 1)))]
        return Mesh(self.nodes(trace), np.array(tri), np.column_stack([np.tile(self.s, m), np.repeat(-self.z, n)]))


def along_and_across(trace: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distance along the trace and to its left of each point's nearest place, and whether that is inside the trace."""
    a, d = trace[:-1], np.diff(trace, axis=0)
    size = np.hypot(*d.T)
    start = np.r_[0, np.cumsum(size)]
    w = points[:, None, :] - a[None]
    t = (w * d).sum(axis=2) / (size**2)
    held = np.clip(t, 0, 1)
    off = w - held[..., None] * d
    k = (off**2).sum(axis=2).argmin(axis=1)
    row = np.arange(len(points))
    cross = d[k, 0] * w[row, k, 1] - d[k, 1] * w[row, k, 0]
    inside = ~(((k == 0) & (t[row, k] < 0)) | ((k == len(d) - 1) & (t[row, k] > 1)))
    return start[k] + held[row, k] * size[k], np.sign(cross) * np.hypot(*off[row, k].T), inside
