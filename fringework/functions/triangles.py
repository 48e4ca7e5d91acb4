"""Triangulated faults: builders, and surface displacement by adaptive quadrature of point dislocations."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from fringework.operators.geometry import arc_length, depth_levels

#: A symmetric rule of degree five on the triangle, barycentric points and weights.
_R15 = 15**0.5
_INNER, _OUTER = (6 - _R15) / 21, (6 + _R15) / 21
RULE = np.array(
    [(1 / 3, 1 / 3, 9 / 40)]
    + [(a, a, (155 - _R15) / 1200) for a in (_INNER,)] + [(1 - 2 * _INNER, _INNER, (155 - _R15) / 1200), (_INNER, 1 - 2 * _INNER, (155 - _R15) / 1200)]
    + [(a, a, (155 + _R15) / 1200) for a in (_OUTER,)] + [(1 - 2 * _OUTER, _OUTER, (155 + _R15) / 1200), (_OUTER, 1 - 2 * _OUTER, (155 + _R15) / 1200)]
)


def point_dislocation(x: np.ndarray, y: np.ndarray, depth: np.ndarray, dip: float, nu: float = 0.25, opening: bool = True) -> np.ndarray:
    """(3 kinds, 3 components, ...) surface displacement of unit potency (strike slip, dip slip, opening) at a depth, x along strike.

    Without ``opening`` there are two kinds. Powers are products, which cost a
    small part of what a general power does.
    """
    sd, cd = np.sin(dip), np.cos(dip)
    a, d = 1 - 2 * nu, depth
    xx, yy, xy = x * x, y * y, x * y
    rr = xx + yy + d * d
    r = np.sqrt(rr)
    p, q = y * cd + d * sd, y * sd - d * cd
    far = r + d
    r3, far2 = rr * r, far * far
    plain = 1 / (r * far2)
    square = (2 * r + d) / (r3 * far2)
    cubic = (3 * r + d) / (r3 * far2 * far)
    i1 = a * y * (plain - xx * cubic)
    i2 = a * x * (plain - yy * cubic)
    i3, i4, i5 = a * x / r3 - i2, -a * xy * square, a * (1 / (r * far) - xx * square)
    k = 3 * q / (r3 * rr)
    kx, kp = k * x, k * p
    strike = [-(kx * x + i1 * sd), -(kx * y + i2 * sd), -(kx * d + i4 * sd)]
    slip = [i3 * (sd * cd) - kp * x, i1 * (sd * cd) - kp * y, i5 * (sd * cd) - kp * d]
    kinds = [strike, slip]
    if opening:
        kq = k * q
        kinds.append([kq * x - i3 * (sd * sd), kq * y - i1 * (sd * sd), kq * d - i5 * (sd * sd)])
    return np.array(kinds) / (2 * np.pi)


def _frame(corners: np.ndarray) -> tuple[float, float, float]:
    """Strike (radians from north), dip in (0, 90] degrees as radians, and area; the normal points up."""
    normal = np.cross(corners[1] - corners[0], corners[2] - corners[0])
    area = np.linalg.norm(normal) / 2
    n = normal / (2 * area) * (-1 if normal[2] < 0 else 1)
    dip = np.arccos(min(1.0, n[2]))
    return (np.arctan2(n[0], n[1]) - np.pi / 2 if dip > 1e-9 else 0.0), dip, area


def triangle_response(px: np.ndarray, py: np.ndarray, corners: np.ndarray, nu: float = 0.25, near: float = 3.0, deepest: int = 12) -> np.ndarray:
    """(points, 3 components, 2) east, north, up at the surface for unit strike and dip slip on a triangle (z up, below zero).

    A point takes the rule over the whole triangle if it is ``near`` sizes away;
    for the others the triangle is cut in four, again and again. ``deepest`` ends
    that for points within ``near`` sizes of 1/4096 of the triangle, so on a
    fault that breaks the surface; farther ones are exact to about 1e-7 of the slip.
    """
    strike, dip, _ = _frame(corners)
    out = np.zeros((len(px), 3, 2))
    s, c = np.sin(strike), np.cos(strike)
    todo = [(corners, np.arange(len(px)), 0)]
    while todo:
        tri, who, level = todo.pop()
        centre = tri.mean(axis=0)
        size = max(np.linalg.norm(tri[i] - tri[i - 1]) for i in range(3))
        away = np.sqrt((px[who] - centre[0]) ** 2 + (py[who] - centre[1]) ** 2 + centre[2] ** 2)
        close = (away < near * size) & (level < deepest)
        if close.any():
            m = [(tri[i] + tri[(i + 1) % 3]) / 2 for i in range(3)]
            for part in ((tri[0], m[0], m[2]), (m[0], tri[1], m[1]), (m[2], m[1], tri[2]), (m[0], m[1], m[2])):
                todo.append((np.array(part), who[close], level + 1))
        who = who[~close]
        if not len(who):
            continue
        area = np.linalg.norm(np.cross(tri[1] - tri[0], tri[2] - tri[0])) / 2
        # Along and across strike once; a point of the rule only shifts them.
        e, n = px[who] - centre[0], py[who] - centre[1]
        along, across = e * s + n * c, n * s - e * c
        u = 0.0
        for b1, b2, w in RULE:
            at = b1 * tri[0] + b2 * tri[1] + (1 - b1 - b2) * tri[2]
            de, dn = at[0] - centre[0], at[1] - centre[1]
            u = u + point_dislocation(along - (de * s + dn * c), across - (dn * s - de * c), -at[2], dip, nu, opening=False) * (w * area)
        out[who, 0] += (u[:, 0] * s - u[:, 1] * c).T
        out[who, 1] += (u[:, 0] * c + u[:, 1] * s).T
        out[who, 2] += u[:, 2].T
    return out


@dataclass
class Mesh:
    """Nodes (n, 3), triangles (m, 3), and each node's place (s along the trace, z)."""

    nodes: np.ndarray
    triangles: np.ndarray
    params: np.ndarray

    def __post_init__(self) -> None:
        if (self.nodes[:, 2] > 1e-6).any():
            raise ValueError("a mesh lies below the surface")
        if np.abs(self.nodes).max(initial=0) > 1e7:
            raise ValueError("coordinates beyond ten thousand kilometres")

    @classmethod
    def structured(cls, trace: np.ndarray, levels: np.ndarray, shift: np.ndarray | None = None) -> Mesh:
        """Two triangles to each cell of trace steps and depth levels; ``shift`` moves each level's nodes sideways (levels, n, 2)."""
        s = arc_length(trace[:, 0], trace[:, 1])
        n, rows = len(trace), []
        for k, z in enumerate(levels):
            xy = trace if shift is None else trace + shift[k]
            rows.append(np.column_stack([xy, np.full(n, -z)]))
        at = lambda k, i: k * n + i
        cells = [(k, i) for k in range(len(levels) - 1) for i in range(n - 1)]
        tri = [t for k, i in cells for t in ((at(k, i), at(k + 1, i), at(k, i + 1)), (at(k, i + 1), at(k + 1, i), at(k + 1, i + 1)))]
        return cls(np.vstack(rows), np.array(tri), np.column_stack([np.tile(s, len(levels)), np.repeat(-levels, n)]))

    @classmethod
    def dipping(cls, trace: np.ndarray, depth: float, edge: float, dip: float = 90.0, top: float = 0.0, bias: float = 1.0) -> Mesh:
        """A plane of one dip below the trace, its nodes shifted square to the trace."""
        from fringework.operators.geometry import resampled, tangents

        line = resampled(trace, edge)
        levels = depth_levels(top, depth, max(1, round((depth - top) / edge)), bias)
        t = tangents(line)
        square = np.column_stack([t[:, 1], -t[:, 0]])
        run = 0.0 if abs(dip - 90) < 0.01 else 1 / np.tan(np.radians(dip))
        return cls.structured(line, levels, np.array([square * (z * run) for z in levels]))

    def corners(self) -> np.ndarray:
        return self.nodes[self.triangles]

    def areas(self) -> np.ndarray:
        c = self.corners()
        return np.linalg.norm(np.cross(c[:, 1] - c[:, 0], c[:, 2] - c[:, 0]), axis=1) / 2

    def neighbours(self) -> list[tuple[int, int]]:
        """Pairs of triangles with a common edge."""
        seen: dict[tuple[int, int], int] = {}
        out = []
        for i, tri in enumerate(self.triangles.tolist()):
            for a, b in ((tri[0], tri[1]), (tri[1], tri[2]), (tri[2], tri[0])):
                edge = (min(a, b), max(a, b))
                if edge in seen:
                    out.append((seen[edge], i))
                else:
                    seen[edge] = i
        return out

    def boundary(self, side: str) -> np.ndarray:
        """Triangles with a node at an end of the mesh."""
        column, pick = {"left": (0, np.min), "right": (0, np.max), "top": (1, np.max), "bottom": (1, np.min)}[side]
        p = self.params[:, column]
        return np.flatnonzero(np.isclose(p[self.triangles], pick(p)).any(axis=1))

    def nodal_weights(self) -> np.ndarray:
        """(m, n) share of each node in its triangles' mean slip."""
        out = np.zeros((len(self.triangles), len(self.nodes)))
        np.put_along_axis(out, self.triangles, 1 / 3, axis=1)
        return out

    def lumped_areas(self) -> np.ndarray:
        return self.nodal_weights().T @ self.areas()

    def los_matrix(self, px: np.ndarray, py: np.ndarray, look: np.ndarray, nu: float = 0.25) -> np.ndarray:
        """(points, 2 m): all elements' strike slip, then their dip slip."""
        out = np.empty((len(px), 2 * len(self.triangles)))
        for k, c in enumerate(self.corners()):
            u = np.einsum("pcs,pc->ps", triangle_response(px, py, c, nu), look)
            out[:, k], out[:, len(self.triangles) + k] = u[:, 0], u[:, 1]
        return out
