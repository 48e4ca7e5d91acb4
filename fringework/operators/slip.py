"""Slip inversion: the normal equations are summed over the observations by Spark, the small system is solved on the driver."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from fringework.functions import elastic as E


def normal_equations(obs: DataFrame, patches: np.ndarray, nu: float = 0.25) -> tuple[np.ndarray, np.ndarray, float, int]:
    """G'WG, G'Wd, d'Wd and the count, from observations (x, y, los, look_e, look_n, look_u, weight).

    Every task sums its rows of the design matrix, which is never whole anywhere;
    sums of tasks are added by a grouped aggregate, so the driver gets one number an entry.
    """
    m = 2 * len(patches)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((m + 1, m + 1)), 0
        for f in frames:
            for at in range(0, len(f), 4096):
                p = f.iloc[at : at + 4096]
                g = E.patch_greens(p["x"].to_numpy(), p["y"].to_numpy(), p[["look_e", "look_n", "look_u"]].to_numpy(), patches, nu)
                a = np.column_stack([g, p["los"].to_numpy()]) * p["weight"].to_numpy()[:, None]
                total += a.T @ a
                n += len(p)
        i, j = np.triu_indices(m + 1)
        yield pd.DataFrame({"i": np.r_[i, -1], "j": np.r_[j, -1], "v": np.r_[total[i, j], float(n)]})

    sums = obs.select("x", "y", "los", "look_e", "look_n", "look_u", "weight").mapInPandas(run, "i int, j int, v double").groupBy("i", "j").sum("v").collect()
    whole, n = np.zeros((m + 1, m + 1)), 0
    for i, j, v in sums:
        if i < 0:
            n = int(v)
        else:
            whole[i, j] = whole[j, i] = v
    return whole[:m, :m], whole[:m, m], float(whole[m, m]), n


def solve(equations: tuple, neighbours: list[tuple[int, int]], smoothing: float, low: float = -10.0, high: float = 10.0) -> dict:
    """Slip within bounds; the smoothing weight is spread over its rows."""
    gram, rhs, dd, n = equations
    rows = E.smoothing_rows(neighbours, len(rhs) // 2) * (smoothing / max(1, 2 * len(neighbours)))
    x, status, nit = E.bounded_least_squares(gram + rows.T @ rows, rhs, np.full(len(rhs), low), np.full(len(rhs), high))
    rr = max(0.0, float(x @ gram @ x - 2 * rhs @ x + dd))
    rough = float(np.linalg.norm(E.smoothing_rows(neighbours, len(rhs) // 2) @ x))
    return {"slip": x, "misfit": float(np.sqrt(rr / max(1, n))), "roughness": rough, "variance_reduction": 100 * (dd - rr) / dd if dd else 0.0, "status": status, "nit": nit}


def l_curve(equations: tuple, neighbours: list[tuple[int, int]], weights: Sequence[float]) -> list[dict]:
    """A solution for each smoothing weight, from the largest down, over the same sums."""
    return [{"smoothing": float(w)} | {k: v for k, v in solve(equations, neighbours, w).items() if k != "slip"} for w in sorted(weights, reverse=True)]
