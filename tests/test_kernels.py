import numpy as np
import pytest

from fringework.functions import elastic as E
from fringework.functions import kernels as K
from fringework.operators import geometry as T
from fringework.operators import tiles as L


def test_okada_published_values():
    """The check list of the 1985 paper, case 2."""
    args = (np.array([2.0]), np.array([3.0]), 3.0, 2.0, 4.0, 70.0)
    for slip, want in (((1, 0, 0), (-8.689e-3, -4.298e-3, -2.747e-3)), ((0, 1, 0), (-4.682e-3, -3.527e-2, -3.564e-2)), ((0, 0, 1), (-2.660e-4, 1.056e-2, 3.214e-3))):
        got = [float(v[0]) for v in E.okada_surface(*args, *slip)]
        assert got == pytest.approx(want, rel=1e-3)


def test_bounded_solver_against_projected_gradient():
    rnd = np.random.default_rng(0)
    for _ in range(20):
        g = rnd.normal(size=(30, 8))
        gram, rhs = g.T @ g, g.T @ rnd.normal(size=30)
        low, high = np.full(8, -0.1), np.full(8, 0.15)
        x, status, _ = E.bounded_least_squares(gram, rhs, low, high)
        z = np.zeros(8)
        for _ in range(20_000):
            z = np.clip(z - (gram @ z - rhs) / np.linalg.norm(gram, 2), low, high)
        assert status == 1 and np.allclose(x, z, atol=1e-6)


def test_unwrapping_is_congruent_and_exact_without_residues():
    y, x = np.mgrid[:40, :50]
    true = 0.3 * x + 0.2 * y + 3 * np.sin(x / 9)
    phase = K.wrap(true)
    phase[10:20, 25] = np.nan
    out, labels = K.unwrapped(phase)
    ok = np.isfinite(phase)
    assert (labels[ok] > 0).all() and (labels[~ok] == 0).all() and np.isnan(out[~ok]).all()
    shift = out[ok] - true[ok]
    assert np.allclose(shift, shift[0], atol=1e-9) and np.allclose(K.wrap(out[ok] - phase[ok]), 0, atol=1e-9)
    assert np.isnan(K.unwrapped(np.full((3, 3), np.nan))[0]).all()


def test_offsets_find_a_shift():
    rnd = np.random.default_rng(1)
    big = K.gaussian(rnd.normal(size=(120, 120)), 1.5) + 5
    ref, sec = big[20:84, 20:84], big[18:82, 23:87]
    dy, dx, strength = K.pixel_offset(ref, sec, 32, 16)
    assert abs(dy - 2) <= 0.25 and abs(dx + 3) <= 0.25 and strength > 3
    assert np.isnan(K.pixel_offset(np.full((64, 64), np.nan), sec, 32, 16)[0])


def test_goldstein_keeps_a_constant_and_smooths_noise():
    z = np.full((40, 40), 2 - 1j)
    assert np.allclose(K.goldstein(z, 0.0, 16), z)
    rnd = np.random.default_rng(2)
    y, x = np.mgrid[:64, :64]
    clean = np.exp(1j * 0.2 * x)
    noisy = clean * np.exp(1j * rnd.normal(0, 0.8, x.shape))
    err = lambda a: np.abs(K.wrap(np.angle(a) - np.angle(clean))).mean()
    assert err(K.goldstein(noisy, 0.9)) < 0.6 * err(noisy)


def test_tilings_agree(spark):
    rnd = np.random.default_rng(3)
    rows = [(int(y), int(x), None if rnd.random() < 0.1 else float(rnd.normal())) for y in range(30) for x in range(37)]
    df = spark.createDataFrame(rows, "yi long, xi long, v double")
    read = lambda out: {(r.yi, r.xi): r.smooth for r in out.collect()}
    small, whole = read(L.gaussian_smooth(df, "v", 1.3, 30, 37, tile=8)), read(L.gaussian_smooth(df, "v", 1.3, 30, 37, tile=64))
    assert small.keys() == whole.keys()
    for k, v in whole.items():
        assert (v is None) == (small[k] is None) and (v is None or abs(v - small[k]) < 1e-9)


def test_projection_round_trip_and_known_point():
    e, n = T.to_tmerc(9.0, 0.0, 9.0)
    assert (e, n) == pytest.approx((500_000.0, 0.0), abs=1e-6)
    e, n = T.to_tmerc(-3.0 + 2.2945, 48.8582, 3.0 - 6.0)  # a place 2.2945 degrees east of the meridian of zone 30
    for lon, lat in ((-68.5, 10.4), (10.2, 63.1), (-70.9, -33.2)):
        lon0 = (T.utm_zone(lon, lat) % 100) * 6 - 183
        back = T.from_tmerc(*T.to_tmerc(lon, lat, lon0), lon0)
        assert back == pytest.approx((lon, lat), abs=1e-9)
    frame = T.LocalFrame(-68.0, 10.5)
    assert frame.to_local(-68.0, 10.5) == (0.0, 0.0)
    assert frame.to_lonlat(*frame.to_local(-67.7, 10.9)) == pytest.approx((-67.7, 10.9), abs=1e-9)


def test_meridian_arc():
    """The northing of 45 degrees on the meridian is the arc length 4984944.378 m times the scale."""
    assert T.to_tmerc(9.0, 45.0, 9.0)[1] == pytest.approx(4_984_944.378 * 0.9996, abs=0.01)


def test_lattices():
    assert T.patch_origins(100, 32, 8)[-1] == 68 and T.offset_locations(50, 10, count=1) == [20]
    assert T.union_lattice((0.0, 10.0, 20.0), (-15.0, 41.0)) == [-20.0, -10.0, 0.0, 10.0, 20.0, 30.0, 40.0, 50.0]
    with pytest.raises(ValueError):
        T.lattice_offset(0.0, 5.0, 10.0)
    assert T.offset_locations(10, 20, count=2) == [] and T.offset_locations(10, 4, count=30) == []
    assert np.allclose(np.diff(T.depth_levels(0, 10, 5)), 2.0)
