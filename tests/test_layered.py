import numpy as np
import pytest

from fringework.functions import layered as Y
from fringework.functions.triangles import triangle_response
from fringework.sources.texts import parse_response_table

R, Z = np.linspace(0, 60e3, 401), np.linspace(500, 20e3, 131)


@pytest.mark.parametrize("corners", [
    [[0, 0, -6_000], [2_000, 500, -6_000], [900, 300, -8_500]],
    [[0, 0, -5_000], [1_500, -2_500, -5_200], [1_700, -300, -6_800]],
    [[0, 0, -7_000], [2_000, 0, -7_000], [900, 2_000, -7_001]],
])
def test_uniform_tables_give_the_half_space(corners):
    corners = np.array(corners, float)
    rng = np.random.default_rng(1)
    x, y = rng.uniform(-20e3, 20e3, 60), rng.uniform(-20e3, 20e3, 60)
    got = Y.LayeredPoints(Y.ResponseTables.homogeneous(0.25, R, Z)).response(x, y, corners)
    want = triangle_response(x, y, corners, 0.25)
    assert np.abs(got - want).max() < 0.01 * np.abs(want).max()


def test_points_are_as_many_as_distance_asks_for():
    corners = np.array([[0, 0, -1_000.0], [3_000, 0, -1_000], [0, 100, -4_000]])
    engine = Y.LayeredPoints(Y.ResponseTables.homogeneous(0.25, R, Z))
    cuts = engine.cuts(np.array([0.0, 10e3, 50e3]), np.zeros(3), corners)
    assert cuts[0] == Y.MOST_CUTS and cuts[0] > cuts[1] >= cuts[2] >= 1
    for k in (1, 2, 5):
        points = Y.cut_centres(corners, k)
        assert len(points) == k * k and np.allclose(points.mean(axis=0), corners.mean(axis=0))


def text_of(tables, kind):
    """A table as a program that works in north, east, down writes it."""
    a = dict(zip(Y.NAMES, tables.values, strict=True))
    columns = {"ss": [-a["A_z"], a["A_r"], a["A_t"]], "ds": [a["B_z"], -a["B_r"], a["B_t"]], "cl": [-a["C_z"], a["C_r"]]}[kind]
    head = f"{len(tables.r)} {tables.r[0]} {tables.r[-1]} {len(tables.z)} {tables.z[0]} {tables.z[-1]} 0.0 3e10 3e10"
    rows = [" ".join(f"{c[i, j]:.12e}" for c in columns) for j in range(len(tables.z)) for i in range(len(tables.r))]
    return "\n".join(["# table", head, *rows])


def test_tables_from_text():
    made = Y.ResponseTables.homogeneous(0.3, np.linspace(0, 30e3, 31), np.linspace(1e3, 9e3, 9))
    read = Y.ResponseTables.from_files({k: parse_response_table(text_of(made, k)) for k in ("ss", "ds", "cl")})
    assert np.allclose(read.values, made.values, rtol=1e-9) and np.allclose(read.r, made.r)
    assert np.allclose(read.at(np.array([2_500.0]), np.array([1_000.0])), (made.values[:, 2, 0] + made.values[:, 3, 0])[:, None] / 2)
