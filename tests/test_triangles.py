import numpy as np
import pytest

from fringework.functions import elastic as E
from fringework.functions import triangles as T


def test_two_triangles_are_a_rectangle():
    """A plane that strikes north and dips east, against the closed form of the rectangle."""
    length, width, top, dip = 4.0, 3.0, 1.5, 60.0
    d = np.radians(dip)
    run, bottom = width * np.cos(d), top + width * np.sin(d)
    a, b = np.array([0, -length / 2, -top]), np.array([0, length / 2, -top])
    c, e = np.array([run, -length / 2, -bottom]), np.array([run, length / 2, -bottom])
    px, py = (v.ravel().astype(float) for v in np.meshgrid([-6.1, -1.3, 0.7, 2.9, 8.0], [-5.0, -0.4, 1.9, 6.3]))
    got = T.triangle_response(px, py, np.array([a, c, b])) + T.triangle_response(px, py, np.array([b, c, e]))
    # Strike north: along is north; up dip is west of the lower edge.
    for k, slip in enumerate(((1.0, 0.0), (0.0, 1.0))):
        u, v, w = E.okada_surface(py + length / 2, -px + run, length, width, bottom, dip, *slip)
        want = np.column_stack([-v, u, w])
        assert np.abs(got[:, :, k] - want).max() < 1e-5


def test_mesh_measures():
    mesh = T.Mesh.dipping(np.array([[0.0, 0.0], [0.0, 12_000.0]]), 6_000.0, 2_000.0, 45.0)
    assert mesh.areas().sum() == pytest.approx(12_000 * 6_000 * 2**0.5) and mesh.lumped_areas().sum() == pytest.approx(mesh.areas().sum())
    assert len(mesh.triangles) == 2 * 6 * 3 and len(mesh.neighbours()) == (3 * 36 - 18) // 2
    assert len(mesh.boundary("top")) == 11 + 1 - 0 and set(mesh.boundary("left")) != set(mesh.boundary("right"))
    with pytest.raises(ValueError):
        T.Mesh(np.array([[0, 0, 5.0]]), np.zeros((0, 3), int), np.zeros((1, 2)))


def test_slip_is_recovered():
    mesh = T.Mesh.dipping(np.array([[0.0, -6_000.0], [500.0, 6_000.0]]), 4_000.0, 2_000.0, 80.0, top=500.0)
    rnd = np.random.default_rng(0)
    px, py = rnd.uniform(-15e3, 15e3, 300), rnd.uniform(-15e3, 15e3, 300)
    look = np.tile([0.6, -0.1, 0.79], (300, 1))
    g = mesh.los_matrix(px, py, look)
    true = np.zeros(g.shape[1])
    true[: len(mesh.triangles)] = -1.0
    rows = E.smoothing_rows(mesh.neighbours(), len(mesh.triangles)) * 1e-5
    x, status, _ = E.bounded_least_squares(g.T @ g + rows.T @ rows, g.T @ (g @ true), np.full(len(true), -10.0), np.full(len(true), 10.0))
    assert status == 1 and np.linalg.norm(g @ x - g @ true) < 1e-3 * np.linalg.norm(g @ true)


def test_points_above_a_fault_that_nearly_breaks_the_surface():
    length, width, top, dip = 3_000.0, 2_000.0, 10.0, 70.0
    d = np.radians(dip)
    a, b = np.array([0, -length / 2, -top]), np.array([0, length / 2, -top])
    c, e = (np.array([width * np.cos(d), y, -top - width * np.sin(d)]) for y in (length / 2, -length / 2))
    px, py = np.array([0.0, 1, -3, 8, 20, -40, 900]), np.array([0.0, 500, -700, 100, 1000, 0, -1400])
    got = T.triangle_response(px, py, np.array([a, b, c])) + T.triangle_response(px, py, np.array([a, c, e]))
    patch = np.array([[0, 0, top, length, width, 0.0, dip]])
    want = np.stack([E.patch_greens(px, py, np.tile(look, (len(px), 1)), patch) for look in np.eye(3)], axis=1)
    assert np.abs(got - want).max() < 1e-6
