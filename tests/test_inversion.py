import numpy as np
import pandas as pd
import pytest

from fringework.functions import surfaces as U
from fringework.functions.triangles import Mesh
from fringework.operators import inversion as V
from fringework.operators import sampling as A
from fringework.plans import models as D

TRACE = np.array([[-6_000.0, 0.0], [6_000.0, 0.0]])


def fault():
    return Mesh.dipping(TRACE, 6_000.0, 3_000.0, 89.0, top=500.0)


def slip_of(mesh):
    c = mesh.corners().mean(axis=1)
    return np.column_stack([np.exp(-((c[:, 0] / 4000) ** 2)), np.zeros(len(c))])


def truth(mesh, x, y):
    look = np.array([0.6, -0.1, 0.79])
    return sum(V.HalfSpace().response(x, y, c) @ s for c, s in zip(mesh.corners(), slip_of(mesh), strict=True)) @ look


@pytest.fixture(scope="module")
def obs(spark):
    mesh = fault()
    gx, gy = (a.ravel() for a in np.meshgrid(np.linspace(-14e3, 14e3, 23) + 7, np.linspace(-12e3, 12e3, 20) + 11))
    frame = pd.DataFrame({"x": gx, "y": gy, "los": truth(mesh, gx, gy) + 0.05 + 0.02 * gx / 28e3, "look_e": 0.6, "look_n": -0.1, "look_u": 0.79, "weight": 1.0, "track": "a"})
    return spark.createDataFrame(frame).repartition(3)


def test_the_sums_are_those_of_the_design(obs):
    mesh = fault()
    eq = V.equations(obs, mesh, ramp="linear")
    frame = obs.toPandas()
    a = V.design(frame, mesh, V.HalfSpace(), np.eye(len(mesh.triangles)), eq.terms)
    assert np.allclose(eq.gram, a.T @ a) and np.allclose(eq.rhs, a.T @ frame["los"]) and eq.count == len(frame)
    assert [t[:2] for t in eq.terms] == [("a", "offset"), ("a", "x"), ("a", "y")]


@pytest.mark.parametrize("basis", ["element", "node"])
def test_slip_and_ramp_are_recovered(spark, obs, basis):
    mesh = fault()
    b = V.make_basis(mesh, basis)
    m = V.solve(V.equations(obs, mesh, None, b, "linear"), mesh, b, smoothing=1e-3, boundary_ratio=0.0)
    assert m.converged and m.variance_reduction > 99
    assert np.corrcoef(m.slip[:, 0], slip_of(mesh)[:, 0])[0, 1] > 0.9
    assert m.ramps[0][-1] == pytest.approx(0.05, abs=0.01)
    rows = V.predicted(obs, m).toPandas()
    assert rows["residual"].std() < 0.1 * rows["los"].std()


def test_polarity_bounds_and_the_l_curve(obs):
    mesh = fault()
    eq = V.equations(obs, mesh, ramp="offset")
    m = V.solve(eq, mesh, smoothing=0.01, polarity=(-1, 0))
    assert m.slip[:, 0].max() <= 0
    with pytest.raises(ValueError):
        V.slip_bounds(2, polarity=())
    rows = V.l_curve(eq, mesh, [0.01, 10.0, 1.0])
    assert [r["smoothing"] for r in rows] == [10.0, 1.0, 0.01]
    assert rows[0]["misfit"] >= rows[-1]["misfit"] - 1e-12 and rows[0]["roughness"] <= rows[-1]["roughness"] + 1e-9
    assert V.l_curve(eq, mesh, [0.01], strike=(-0.1, 0.1))[0]["saturated"]


def test_smoothing_rows_do_not_see_uniform_slip():
    mesh = fault()
    for basis in (V.ElementBasis(mesh), V.NodeBasis(mesh)):
        rows = V.smoothing_rows(basis, mesh, 1.0, 2.0)
        assert np.abs(rows @ np.ones(rows.shape[1])).max() < 1e-9
    assert np.abs(V.surface_laplacian(mesh)).sum(axis=1).max() == pytest.approx(2)


def test_a_model_is_saved_loaded_and_exported(spark, obs, tmp_path):
    mesh = fault()
    m = V.solve(V.equations(obs, mesh), mesh)
    D.save(spark, m, f"{tmp_path}/m", obs)
    back, rows = D.load(spark, f"{tmp_path}/m")
    assert np.allclose(back.slip, m.slip) and V.mesh_digest(back.mesh) == V.mesh_digest(mesh) and rows.count() == obs.count() and back.magnitude == pytest.approx(m.magnitude)
    D.write_elements(spark, m, f"{tmp_path}/elements")
    table = spark.read.csv(f"{tmp_path}/elements", sep="\t", header=True)
    assert len(table.columns) == 10 and table.count() == len(mesh.triangles) and table.selectExpr("min(cast(id AS int))").first()[0] == 1
    D.write_vertices(spark, m, f"{tmp_path}/v")
    assert len(spark.read.csv(f"{tmp_path}/v/nodes", sep="\t", header=True).columns) == 9 and len(spark.read.csv(f"{tmp_path}/v/elements", sep="\t", header=True).columns) == 4
    m.converged = False
    with pytest.raises(D.Unconverged):
        D.write_elements(spark, m, f"{tmp_path}/no")
    back.engine = "layers"
    with pytest.raises(Exception, match="layers"):
        V.surface_displacement(obs.select("x", "y"), back).collect()
    assert D.archive(f"{tmp_path}/v", f"{tmp_path}/runs", 0.3, "none", 8).endswith("run_lam0.3_none_8el")
    D.write_vertices(spark, V.solve(V.equations(obs, mesh), mesh), f"{tmp_path}/v")
    assert D.archive(f"{tmp_path}/v", f"{tmp_path}/runs", 0.3, "none", 8).endswith("_v2")
    assert D.plot_slip(spark, m).count() == 3 * len(mesh.triangles)
    assert D.plot_fit(V.predicted(obs, m)).count() == 3 * obs.count()


def scene(spark, mesh, n=40, step=700.0):
    yi, xi = (a.ravel() for a in np.indices((n, n)))
    x, y = -n / 2 * step + 33 + xi * step, n / 2 * step + 17 - yi * step
    los = truth(mesh, x, y)
    los[::37] = np.nan
    frame = pd.DataFrame({"yi": yi, "xi": xi, "los": los, "los_east": 0.6, "los_north": -0.1, "los_up": 0.79})
    return spark.createDataFrame(frame), A.Grid(n, n, -n / 2 * step + 33, step, n / 2 * step + 17, -step)


def test_observations_reduce_their_cells(spark):
    pixels, grid = scene(spark, fault())
    trace = [tuple(p) for p in TRACE]
    how = {"rms_min": 0.02, "width_min": 1400.0, "width_max": 9000.0}
    rows = A.observations(pixels, grid, "t", trace, exclude_within=1500.0, **how).toPandas()
    assert len(rows) > 20 and (np.hypot(np.maximum(np.abs(rows["x"]) - 6000, 0), rows["y"]) > 1500).all() and set(rows["track"]) == {"t"}
    assert np.allclose(rows["look_u"], 0.79) and rows["n"].sum() <= 1600
    # A flat field splits only near the trace.
    flat = pixels.selectExpr("*", "0.0D AS field")
    near = A.observations(flat, grid, "t", trace, field="field", refine_within=1000.0, **how).toPandas()
    far = near[np.abs(near["y"]) > 6000]
    assert len(near) and near["cell_size"].min() < far["cell_size"].min()
    with pytest.raises(ValueError):
        A.observations(pixels, grid, stat="mode")


def test_sampling_and_inversion_settle(spark):
    mesh = fault()
    trace = [tuple(p) for p in TRACE]
    how = {"a": {"rms_min": 0.03, "width_min": 1400.0, "width_max": 9000.0, "exclude_within": 800.0}}
    obs, model, history = A.iterated({"a": scene(spark, mesh)}, mesh, trace, how, solving={"smoothing": 0.01, "boundary_ratio": 0.0}, max_rounds=2, tol=0.05, spacing=1400.0)
    assert [h["round"] for h in history][:2] == [0, 1] and history[0]["field"] == "data" and history[-1]["field"] == "model"
    assert model.variance_reduction > 95 and obs.count() == history[-1]["n"]


def test_a_field_through_points():
    s, z = np.linspace(0, 10, 6), np.linspace(0, 5, 4)
    rng = np.random.default_rng(2)
    x, y = rng.uniform(0, 10, 60), rng.uniform(0, 5, 60)
    for kind in ("triangle", "bilinear"):
        f = U.fit_grid(x, y, 2 * x - 3 * y + 1, s, z, interpolation=kind)
        assert np.allclose(f, 2 * s[None] - 3 * z[:, None] + 1, atol=1e-6)
    with pytest.raises(ValueError):
        U.fit_grid([0, 1], [0, 1], [0, 1], s, z)
    with pytest.raises(ValueError):
        U.fit_grid(x, y, x, s[::-1], z)


def test_surfaces_follow_their_dips_and_bottoms():
    trace = np.array([[0.0, 0.0], [5_000.0, 0.0], [10_000.0, 500.0]])
    length = np.hypot(*np.diff(trace, axis=0).T).sum()
    s, z = np.linspace(0, length, 9), np.linspace(0, 4_000, 5)
    straight = U.Surface.vertical(s, z)
    assert np.allclose(straight.nodes(trace)[: len(s), 2], 0) and straight.mesh(trace).triangles.shape == (64, 3)
    dipping = U.Surface.from_dips(s, z, [(0, length)], [60.0])
    assert np.allclose(dipping.cross[-1], 4_000 / np.tan(np.radians(60)), rtol=0.02) and np.abs(dipping.cross[0]).max() < 5
    bottom = trace + np.array([0.0, 900.0])
    with pytest.warns(RuntimeWarning):
        bent = U.Surface.from_bottom(trace, np.vstack([bottom, [12_000.0, 1_500.0]]), s, z)
    assert bent.cross[-1].mean() == pytest.approx(900, rel=0.05)
    assert len(bent.centre_points(trace)) == 32
    with pytest.raises(ValueError):
        U.Surface.from_bottom(trace, bottom, s, z, depth=9_000.0)
