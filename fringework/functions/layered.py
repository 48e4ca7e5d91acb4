"""Displacement over a layered crust: tables of point-source responses, and elements as sums of points.

In a medium that is layered by depth the response to any point dislocation is a
mix of three canonical ones, each a function of distance and depth times a sine
or cosine of the azimuth. In a frame with z up and azimuth t from x to y:

* M_xy = 1: vertical A_z sin 2t, radial A_r sin 2t, transverse A_t cos 2t
* M_xz = 1: vertical B_z cos t, radial B_r cos t, transverse -B_t sin t
* M_zz = 1, M_xx = M_yy = -1/2: vertical C_z, radial C_r
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np

from fringework.functions.triangles import _frame, point_dislocation

#: Relative accuracy of the sum over points, and cuts of an element's side at most.
TOLERANCE, MOST_CUTS = 3e-3, 9
#: Measured: the error of one point for an element is this times its size over the distance.
ONE_POINT_ERROR = 0.06

NAMES = ("A_z", "A_r", "A_t", "B_z", "B_r", "B_t", "C_z", "C_r")


@dataclass
class ResponseTables:
    """The eight functions on a regular lattice of distance (rows) and depth (columns)."""

    r: np.ndarray
    z: np.ndarray
    values: np.ndarray  # (8, distances, depths)

    @classmethod
    def homogeneous(cls, nu: float = 0.25, r: np.ndarray | None = None, z: np.ndarray | None = None) -> ResponseTables:
        """What a uniform half space gives: the check of everything that reads the tables."""
        r = np.linspace(0.0, 400e3, 201) if r is None else np.asarray(r, float)
        z = np.linspace(500.0, 50e3, 100) if z is None else np.asarray(z, float)
        rr, zz = np.meshgrid(r, z, indexing="ij")
        half = np.sqrt(0.5)
        up, level = np.pi / 2, np.zeros_like(rr)
        at = lambda x, y, dip: point_dislocation(x, y, zz, dip, nu)
        # Upright strike slip is M_xy = -1, upright dip slip M_yz = -1; dip slip at 45 degrees M_zz = 1, M_yy = -1.
        diagonal, along, across = at(rr * half, rr * half, up), at(rr, level, up), at(level, rr, up)
        a = [-diagonal[0, 2], -(diagonal[0, 0] + diagonal[0, 1]) * half, -along[0, 1]]
        b = [-across[1, 2], -across[1, 1], -along[1, 1]]
        x45, y45 = at(rr, level, np.pi / 4), at(level, rr, np.pi / 4)
        c = [(x45[1, 2] + y45[1, 2]) / 2, (x45[1, 0] + y45[1, 1]) / 2]
        return cls(r, z, np.array(a + b + c))

    @classmethod
    def from_files(cls, tables: Mapping[str, tuple[dict[str, float], np.ndarray]]) -> ResponseTables:
        """From parsed tables ss, ds and cl (vertical, radial and, but for cl, transverse), whose frame is north, east, down."""
        head = tables["ss"][0]
        for kind in ("ds", "cl"):
            if any(tables[kind][0][k] != head[k] for k in ("nr", "r1", "r2", "nz", "z1", "z2")):
                raise ValueError("the tables do not share a lattice")
        part = {k: np.moveaxis(v, 0, 1) for k, (_, v) in tables.items()}  # (distance, depth, column)
        ss, ds, cl = (part[k] for k in ("ss", "ds", "cl"))
        values = [-ss[..., 0], ss[..., 1], ss[..., 2], ds[..., 0], -ds[..., 1], ds[..., 2], -cl[..., 0], cl[..., 1]]
        return cls(np.linspace(head["r1"], head["r2"], int(head["nr"])), np.linspace(head["z1"], head["z2"], int(head["nz"])), np.array(values))

    def at(self, r: np.ndarray, z: np.ndarray) -> np.ndarray:
        """(8, ...) bilinear; beyond the lattice its edge holds."""
        place = lambda v, axis: np.clip((v - axis[0]) / (axis[-1] - axis[0]) * (len(axis) - 1), 0, len(axis) - 1)
        i, j = place(r, self.r), place(z, self.z)
        i0, j0 = np.minimum(i.astype(int), len(self.r) - 2), np.minimum(j.astype(int), len(self.z) - 2)
        f, g, v = i - i0, j - j0, self.values
        return (1 - f) * ((1 - g) * v[:, i0, j0] + g * v[:, i0, j0 + 1]) + f * ((1 - g) * v[:, i0 + 1, j0] + g * v[:, i0 + 1, j0 + 1])


def cut_centres(corners: np.ndarray, k: int) -> np.ndarray:
    """(k * k, 3) centres of the equal triangles that cutting each side in k makes, upright and inverted ones."""
    i, j = np.meshgrid(np.arange(k), np.arange(k), indexing="ij")
    up, down = i + j < k, i + j < k - 1
    b = np.concatenate([np.column_stack([i[up] + 1 / 3, j[up] + 1 / 3]), np.column_stack([i[down] + 2 / 3, j[down] + 2 / 3])]) / k
    return b[:, :1] * corners[0] + b[:, 1:] * corners[1] + (1 - b.sum(axis=1, keepdims=True)) * corners[2]


@dataclass
class LayeredPoints:
    """An engine (see ``operators.inversion``): each element is as many points as a receiver's distance asks for."""

    tables: ResponseTables
    tolerance: float = TOLERANCE
    name: str = "layered points"

    def cuts(self, x: np.ndarray, y: np.ndarray, corners: np.ndarray) -> np.ndarray:
        centre, (_, _, area) = corners.mean(axis=0), _frame(corners)
        size = np.sqrt(2 * area)
        away = np.maximum(np.sqrt((x - centre[0]) ** 2 + (y - centre[1]) ** 2 + centre[2] ** 2), size / 100)
        return np.clip(np.ceil(ONE_POINT_ERROR * size / (self.tolerance * away)), 1, MOST_CUTS).astype(int)

    def response(self, x: np.ndarray, y: np.ndarray, corners: np.ndarray) -> np.ndarray:
        """(points, 3, 2) east, north, up for unit strike and dip slip."""
        x, y = np.asarray(x, float), np.asarray(y, float)
        strike, dip, area = _frame(corners)
        s, c = np.sin(strike), np.cos(strike)
        # Strike slip is M_xy = -sin dip and M_xz = cos dip; dip slip M_yz = cos 2 dip, M_zz = sin 2 dip = -M_yy.
        sd, cd, s2, c2 = np.sin(dip), np.cos(dip), np.sin(2 * dip), np.cos(2 * dip)
        out, cuts = np.zeros((len(x), 3, 2)), self.cuts(x, y, corners)
        for k in np.unique(cuts):
            who = np.flatnonzero(cuts == k)
            points = cut_centres(corners, int(k))
            e, n = x[who, None] - points[None, :, 0], y[who, None] - points[None, :, 1]
            along, across = e * s + n * c, -e * c + n * s
            t = np.arctan2(across, along)
            az, ar, at, bz, br, bt, cz, cr = self.tables.at(np.hypot(e, n), np.broadcast_to(-points[None, :, 2], e.shape))
            sin1, cos1, sin2, cos2 = np.sin(t), np.cos(t), np.sin(2 * t), np.cos(2 * t)
            for m, (uz, ur, ut) in enumerate((
                (-sd * az * sin2 + cd * bz * cos1, -sd * ar * sin2 + cd * br * cos1, -sd * at * cos2 - cd * bt * sin1),
                (c2 * bz * sin1 + s2 * (cz + az * cos2 / 2), c2 * br * sin1 + s2 * (cr + ar * cos2 / 2), c2 * bt * cos1 - s2 * at * sin2 / 2),
            )):
                ux, uy = ur * cos1 - ut * sin1, ur * sin1 + ut * cos1
                whole = np.stack([ux * s - uy * c, ux * c + uy * s, uz])
                out[who, :, m] = whole.sum(axis=2).T * (area / len(points))
        return out
