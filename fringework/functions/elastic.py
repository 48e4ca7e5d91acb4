"""Elastic dislocations in a half-space and the bounded inverse problem, on numpy."""

from __future__ import annotations

import numpy as np


def okada_surface(x: np.ndarray, y: np.ndarray, length: float, width: float, depth: float, dip: float, strike_slip: float, dip_slip: float, opening: float = 0.0, nu: float = 0.25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Surface displacement of a rectangular dislocation (Okada, 1985).

    x runs along strike from the start of the lower edge, y is horizontal and
    positive up dip, ``depth`` is that of the lower edge.
    """
    d = np.radians(dip)
    sd, cd = np.sin(d), np.cos(d)
    if abs(cd) < 1e-6:
        sd, cd = np.sign(sd), 0.0
    p, q = y * cd + depth * sd, y * sd - depth * cd
    a = 1 - 2 * nu  # mu / (lambda + mu)

    def parts(xi: np.ndarray, eta: np.ndarray) -> np.ndarray:
        r = np.sqrt(xi**2 + eta**2 + q**2)
        yt, dt = eta * cd + q * sd, eta * sd - q * cd
        re, rd = r + eta, r + dt
        with np.errstate(divide="ignore", invalid="ignore"):
            inv = np.where(np.abs(re) > 1e-12, 1 / (r * re), 0.0)
            log = np.where(np.abs(re) > 1e-12, np.log(np.where(re > 0, re, 1.0)), -np.log(np.maximum(r - eta, 1e-300)))
            theta = np.where(np.abs(q) > 1e-12, np.arctan(xi * eta / np.where(q == 0, 1, q) / r), 0.0)
            rx = r + xi
            invx = np.where(np.abs(rx) > 1e-12, 1 / (r * rx), 0.0)
            if cd == 0:
                i1, i3 = -a / 2 * xi * q / rd**2, a / 2 * (eta / rd + yt * q / rd**2 - log)
                i4, i5 = -a * q / rd, -a * xi * sd / rd
            else:
                big = np.sqrt(xi**2 + q**2)
                i5 = np.where(np.abs(xi) > 1e-12, a * 2 / cd * np.arctan((eta * (big + q * cd) + big * (r + big) * sd) / np.where(xi == 0, 1, xi) / (r + big) / cd), 0.0)
                i4 = a / cd * (np.log(rd) - sd * log)
                i3 = a * (yt / (cd * rd) - log) + sd / cd * i4
                i1 = a * (-xi / (cd * rd)) - sd / cd * i5
            i2 = -a * log - i3
        ss = np.array([xi * q * inv + theta + i1 * sd, yt * q * inv + q * cd / re + i2 * sd, dt * q * inv + q * sd / re + i4 * sd])
        ds = np.array([q / r - i3 * sd * cd, yt * q * invx + cd * theta - i1 * sd * cd, dt * q * invx + sd * theta - i5 * sd * cd])
        ts = np.array([q**2 * inv - i3 * sd**2, -dt * q * invx - sd * (xi * q * inv - theta) - i1 * sd**2, yt * q * invx + cd * (xi * q * inv - theta) - i5 * sd**2])
        return (-strike_slip * ss - dip_slip * ds + opening * ts) / (2 * np.pi)

    u = parts(x, p) - parts(x, p - width) - parts(x - length, p) + parts(x - length, p - width)
    return u[0], u[1], u[2]


def patch_greens(px: np.ndarray, py: np.ndarray, look: np.ndarray, patches: np.ndarray, nu: float = 0.25) -> np.ndarray:
    """Line-of-sight response (points, 2 * patches) to unit slip along strike, then along dip.

    A patch is (x, y of the middle of its upper edge, depth of that edge, length, width, strike, dip), azimuths in degrees.
    """
    out = np.empty((len(px), 2 * len(patches)))
    for k, (cx, cy, top, length, width, strike, dip) in enumerate(patches):
        s = np.radians(strike)
        east, north = px - cx, py - cy
        along, updip = east * np.sin(s) + north * np.cos(s), -east * np.cos(s) + north * np.sin(s)
        run = width * np.cos(np.radians(dip))
        for j, slip in enumerate(((1.0, 0.0), (0.0, 1.0))):
            u, v, w = okada_surface(along + length / 2, updip + run, length, width, top + width * np.sin(np.radians(dip)), dip, *slip, nu=nu)
            e, n = u * np.sin(s) - v * np.cos(s), u * np.cos(s) + v * np.sin(s)
            out[:, j * len(patches) + k] = e * look[:, 0] + n * look[:, 1] + w * look[:, 2]
    return out


def bounded_least_squares(gram: np.ndarray, rhs: np.ndarray, low: np.ndarray, high: np.ndarray, most: int = 500, tol: float = 1e-10) -> tuple[np.ndarray, int, int]:
    """(x, status, iterations) of min x'Ax/2 - b'x within bounds, by an active set of projected Newton steps.

    Status 1: converged; 0: the iterations ran out.
    """
    x = np.clip(np.zeros(len(rhs)), low, high)
    scale = max(1.0, np.abs(rhs).max())
    for n in range(1, most + 1):
        g = gram @ x - rhs
        free = ~(((x <= low) & (g > 0)) | ((x >= high) & (g < 0)))
        if not free.any() or np.abs(g[free]).max() <= tol * scale:
            return x, 1, n
        step = np.zeros_like(x)
        step[free] = -np.linalg.lstsq(gram[np.ix_(free, free)], g[free], rcond=None)[0]
        before, t = 0.5 * x @ gram @ x - rhs @ x, 1.0
        while t > 1e-12:
            trial = np.clip(x + t * step, low, high)
            if 0.5 * trial @ gram @ trial - rhs @ trial <= before - 1e-12 * abs(before) or np.allclose(trial, x, rtol=0, atol=1e-15):
                break
            t /= 2
        if np.abs(trial - x).max() <= tol * max(1.0, np.abs(x).max()):
            return trial, 1, n
        x = trial
    return x, 0, most


def smoothing_rows(neighbours: list[tuple[int, int]], n: int) -> np.ndarray:
    """A row for each undirected pair of neighbours and slip component: the difference of the two."""
    out = np.zeros((2 * len(neighbours), 2 * n))
    for i, (a, b) in enumerate(neighbours):
        for c in (0, 1):
            out[2 * i + c, c * n + a], out[2 * i + c, c * n + b] = 1, -1
    return out
