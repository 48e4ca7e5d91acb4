import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fringework.functions import kernels, tiling
from fringework.operators import geometry as T
from fringework.operators import looks as K
from fringework.operators import masks as M
from fringework.operators import merging as G
from fringework.operators import scenes as C
from fringework.operators import statistics as S
from fringework.operators import tiles as L
from fringework.operators import water as W
from fringework.operators.sampling import Grid
from fringework.plans.stages import StageError, Workspace


def pixels(spark, a, name="v"):
    yi, xi = (i.ravel() for i in np.indices(a.shape))
    frame = pd.DataFrame({"yi": yi, "xi": xi, name: a.ravel()})
    return spark.createDataFrame(frame).withColumn(name, F.when(~F.isnan(name), F.col(name)))


def array(df, shape, name="v"):
    out = np.full(shape, np.nan)
    p = df.toPandas()
    out[p["yi"], p["xi"]] = p[name].astype(float)
    return out


@pytest.mark.parametrize("steps", [1, 3, 6])
def test_erosion_against_every_neighbour(spark, steps):
    rng = np.random.default_rng(steps)
    a = np.where(rng.random((24, 31)) < 0.02, np.nan, 1.0)
    df = pixels(spark, a).where("NOT (yi = 9 AND xi > 20)")  # absent pixels are invalid, too
    a[9, 21:] = np.nan
    want = np.full(a.shape, np.nan)
    for y in range(a.shape[0]):
        for x in range(a.shape[1]):
            ball = [(y + dy, x + dx) for dy in range(-steps, steps + 1) for dx in range(-steps, steps + 1) if abs(dy) + abs(dx) <= steps]
            if all(0 <= i < a.shape[0] and 0 <= j < a.shape[1] and a[i, j] == 1 for i, j in ball):
                want[y, x] = 1
    assert np.array_equal(array(M.erode(df, "v", steps), a.shape), want, equal_nan=True)


def test_components_by_slice_over_wide_rows(spark):
    a = np.full((3, 900), np.nan)
    a[0, :700] = a[1, 650] = a[2, 600:] = 1
    b = np.where(np.isnan(a), 1.0, np.nan)
    df = pixels(spark, a).withColumn("pair", F.lit(0)).unionByName(pixels(spark, b).withColumn("pair", F.lit(1)))
    got = M.components(df, "v", keys=["pair"]).groupBy("pair").agg(F.countDistinct("component").alias("n")).toPandas().set_index("pair")["n"]
    assert got[0] == 1 and got[1] == 2
    kept = M.kept_components(df, "v", keys=["pair"]).where("v IS NOT NULL").groupBy("pair").count().toPandas().set_index("pair")["count"]
    assert kept[0] == np.isfinite(a).sum() and kept[1] < np.isfinite(b).sum()
    with pytest.raises(ValueError, match="dropped component"):
        M.kept_components(df, "v", keys=["pair"], max_drop_fraction=0.05)


def test_cells_are_the_same_wherever_they_are_cut(spark):
    rng = np.random.default_rng(0)
    a = np.where(rng.random((70, 53)) < 0.1, np.nan, np.cumsum(rng.normal(size=(70, 53)), axis=1).round(2))
    df = pixels(spark, a).withColumn("near", F.col("yi") < 5)
    how = {"rms_min": 1.5, "min_rows": 2, "min_cols": 3, "max_rows": 40, "max_cols": 20, "refine": "near"}
    key = ["r0", "r1", "c0", "c1"]
    whole, parts = (S.quadtree(df, "v", 70, 53, cell_pixels=n, **how).toPandas().sort_values(key).reset_index(drop=True) for n in (1 << 20, 200))
    assert len(whole) > 40
    pd.testing.assert_frame_equal(whole, parts)
    for r in whole.sample(20, random_state=1).itertuples():
        cell = a[r.r0 : r.r1, r.c0 : r.c1]
        assert r.n == np.isfinite(cell).sum() and r.mean == pytest.approx(np.nanmean(cell)) and r.std == pytest.approx(np.nanstd(cell), abs=1e-9)


def test_medians_are_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(k, float(v)) for k, n in enumerate((1, 2, 7, 500, 501)) for v in rng.normal(size=n)] + [(9, 4.0)] * 50 + [(9, None)] + [(10, 1.0)] * 3 + [(10, 2.0)] * 3
    got = {r.k: r.median for r in G.exact_medians(spark.createDataFrame(rows, "k int, v double"), "v", ["k"]).collect()}
    for k in {r[0] for r in rows}:
        assert got[k] == pytest.approx(np.median([v for i, v in rows if i == k and v is not None]), abs=1e-15)


def test_repeated_times_keep_their_rows(spark):
    others = spark.createDataFrame([(1, "2024-01-01 00:00:05"), (1, "2024-01-01 00:00:05"), (2, "2024-01-01 01:00:00")], "id int, t string").selectExpr("id", "cast(t AS timestamp) AS ts")
    refs = spark.sql("SELECT timestamp'2024-01-01 00:00:00' AS ref UNION ALL SELECT timestamp'2024-01-01 00:00:10'")
    got = G.nearest_in_time(others, refs, 10).collect()
    assert len(got) == 2 and all(r.gap_seconds == 5 and r.ref.second == 0 for r in got)


def test_tiled_unwrapping_is_that_of_the_whole(spark):
    y, x = np.indices((60, 80))
    truth = 0.25 * x + 0.004 * (y - 30) ** 2
    a = np.angle(np.exp(1j * truth))
    a[:, 60] = np.nan  # two regions, the second beyond a gap
    df = pixels(spark, a, "phase").withColumn("pair", F.lit(0).cast("long"))
    whole, parts = (L.unwrap(df, 60, 80, most=n, overlap=12) for n in (10**6, 900))
    for got in (whole, parts):
        u, c = array(got, a.shape, "unw"), array(got, a.shape, "conncomp")
        for part in (slice(0, 60), slice(61, 80)):
            off = u[:, part] - truth[:, part]
            assert np.allclose(off, off[0, 0], atol=1e-9) and off[0, 0] / (2 * np.pi) == pytest.approx(round(off[0, 0] / (2 * np.pi)), abs=1e-9)
            assert len(np.unique(c[:, part])) == 1
        assert c[0, 0] != c[0, 70] and np.isnan(u[:, 60]).all()


@pytest.mark.parametrize(("rows", "cols"), [(10, 10), (600, 332), (9_000, 14_000), (40_000, 1_500), (1, 5_000_000)])
def test_tiles_hold_what_they_may_and_cover_all(rows, cols):
    tiles = tiling.tile_grid(rows, cols)
    o = tiling.overlap_of(rows, cols, tiles)
    tiling.check_tiles(rows, cols, tiles, o)
    assert tiling.inflated(rows, tiles[0], o[0]) * tiling.inflated(cols, tiles[1], o[1]) <= tiling.TILE_PIXELS
    for n, t, over in zip((rows, cols), tiles, o, strict=True):
        spans = tiling.tile_spans(n, t, over)
        assert spans[0][0] == 0 and spans[-1][1] == n and all(b[0] <= a[1] - min(over, 1) for a, b in zip(spans, spans[1:], strict=False))
    assert (tiles == (1, 1)) == (rows * cols <= tiling.TILE_PIXELS)


def test_blocks_and_decodability():
    assert tiling.block_shape(10_000, 10_000, (512, 512), 8) == (1536, 1536) and tiling.block_shape(100, 100, (512, 512), 8) == (100, 100)
    assert tiling.directly_decodable((64, 64), ["gzip", "shuffle"]) and not tiling.directly_decodable((64, 64), ["fletcher32"]) and not tiling.directly_decodable(None, [])
    assert not tiling.directly_decodable((1, 64, 64), ["gzip"])


def test_look_vectors_are_checked_and_completed(spark):
    g = spark.createDataFrame([(0, 0, -1.2 / 2, 0.2 / 2, 1.58 / 2), (0, 1, None, None, None)], "yi int, xi int, los_east double, los_north double, los_up double")
    r = K.completed_look(g).orderBy("xi").collect()
    assert r[0].los_east**2 + r[0].los_north**2 + r[0].los_up**2 == pytest.approx(1) and r[0].incidence_angle == pytest.approx(np.degrees(np.arccos(r[0].los_up))) and r[1].los_up is None
    down = g.selectExpr("yi", "xi", "-los_east AS los_east", "-los_north AS los_north", "-los_up AS los_up")
    assert K.completed_look(down, sensor_to_target=True).orderBy("xi").first().los_up == pytest.approx(r[0].los_up)
    with pytest.raises(ValueError, match="away"):
        K.completed_look(down)
    with pytest.raises(ValueError, match="unit"):
        K.completed_look(g.withColumn("los_up", F.lit(7.0)))


def test_a_cube_as_a_table_is_a_cube_in_memory(spark):
    rng = np.random.default_rng(5)
    h, y, x = np.array([0.0, 500.0, 3_000.0]), np.array([900.0, 600.0, 0.0]), np.linspace(0, 2_000, 5)
    cube = {"los_east": rng.uniform(-0.6, 0.6, (3, 3, 5)), "los_north": rng.uniform(-0.2, 0.2, (3, 3, 5))}
    rows = [(i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(rng.uniform(-100, 4_000, 60), rng.uniform(-50, 950, 60), rng.uniform(0, 2_000, 60), strict=True))]
    points = spark.createDataFrame(rows, "id int, h double, y double, x double")
    a = C.trilinear(points, cube, h, y, x).toPandas().sort_values("id")
    b = C.trilinear_joined(points, cube, h, y, x).toPandas().sort_values("id")
    for k in cube:
        assert np.allclose(a[k], b[k], atol=1e-6, equal_nan=True) and a[k].isna().any() and a[k].notna().any()
    up = K.sampled_geometry(points.withColumnRenamed("h", "height"), cube, h, y, x).toPandas().dropna()
    assert 0 < len(up) < 60 and np.allclose(up["los_up"] ** 2 + up["los_east"] ** 2 + up["los_north"] ** 2, 1)


def test_frames_share_their_pixels():
    a = K.frame_axes([(10.0, 980.0, -300.0, 450.0)], 100.0)
    b = K.frame_axes([(10.0, 980.0, -300.0, 450.0), (-250.0, 40.0, 0.0, 1.0)], 100.0)
    assert a[0][0] == 0 and a[0][-1] == 1000 and a[1][0] == 500 and a[1][-1] == -300 and set(a[0]) <= set(b[0])
    with pytest.raises(ValueError):
        K.frame_axes([], 100.0)


def test_mask_spacings(recwarn):
    assert W.increment(30.0, False) == "15e" and W.increment(-1 / 1200, True) == "0.000416667"
    assert W.parsed_increment("15e") == (15.0, True) and W.parsed_increment("3s") == (3 / 3600, False)
    assert W.nodes_of((0, 1, 0, 1), "1000e") == pytest.approx(112 * 112, rel=0.01) and not recwarn.list
    with pytest.warns(RuntimeWarning):
        W.nodes_of((0, 10, 0, 10), "15e")
    with pytest.raises(ValueError):
        W.parsed_increment("-3e")


def test_land_has_holes(spark):
    ring = lambda r, p: [(r, i, float(x), float(y)) for i, (x, y) in enumerate(p)]
    v = spark.createDataFrame(ring(0, [(1, 1), (9, 1), (9, 9), (1, 9)]) + ring(1, [(3, 3), (6, 3), (6, 6), (3, 6)]), "ring int, seq int, x double, y double")
    land = W.land_mask(W.edges_of(v), Grid(11, 11, 0.5, 1.0, 10.5, -1.0)).toPandas()
    got = {(10.5 - r.yi, 0.5 + r.xi) for r in land.itertuples()}
    assert got == {(y + 0.5, x + 0.5) for y in range(1, 9) for x in range(1, 9) if not (3 <= y < 6 and 3 <= x < 6)}


def test_stages_by_slice(spark, tmp_path):
    ws = Workspace(spark, str(tmp_path))
    df = spark.createDataFrame([(0, 1.0), (1, 2.0)], "pair int, v double")
    ws.init("s", df, {"a": 1})
    assert ws.load("s").count() == 0
    ws.write_region("s", df.where("pair = 1"), 1)
    ws.init("s", df, {"a": 1})  # goes on
    assert [tuple(r) for r in ws.load("s").collect()] == [(1, 2.0)] and ws.pairs_done("s") == {1}
    with pytest.raises(StageError):
        ws.init("s", df, {"a": 2})
    ws.init("s", df, {"a": 2}, overwrite=True)
    assert ws.pairs_done("s") == set()
    with pytest.raises(StageError):
        ws.write_region("t", df, 0)


def test_adaptive_filter_and_known_shifts(spark):
    rng = np.random.default_rng(1)
    z = np.exp(1j * (0.2 * np.indices((32, 32))[1] + 0.5 * rng.normal(size=(32, 32))))
    frame = pd.DataFrame({"pair": 0, "yi": np.indices((32, 32))[0].ravel(), "xi": np.indices((32, 32))[1].ravel(), "re": z.real.ravel(), "im": z.imag.ravel(), "coherence": 0.3})
    got = L.goldstein(spark.createDataFrame(frame), 32, 32, alpha=None, patch=8, tile=16)
    want = kernels.goldstein(z, None, 8, 0.75, coherence=np.full((32, 32), 0.3))
    assert np.allclose(array(got, (32, 32), "re"), want.real, equal_nan=True)
    a = rng.random((60, 60))
    s = pixels(spark, a)
    moved = s.select((F.col("yi") + 9).alias("yi"), (F.col("xi") - 12).alias("xi"), "v")
    found = L.pixel_offsets(s, moved, [8, 20], [14, 26], 12, 3, shift=(9, -12)).collect()
    assert len(found) == 4 and all(r.y_offset == pytest.approx(9, abs=0.1) and r.x_offset == pytest.approx(-12, abs=0.1) for r in found)
    with pytest.raises(ValueError):
        L.pixel_offsets(s, moved, [0, 5, 20], [0], 12, 3)


def test_projection_columns_invert(spark):
    lon, lat = -67.3, 11.2
    x, y = T.to_tmerc(lon, lat, -69.0)
    assert T.from_tmerc(x, y, -69.0) == pytest.approx((lon, lat), abs=1e-9)


def test_a_mask_is_made_once(spark, tmp_path):
    v = spark.createDataFrame([(0, i, float(x), float(y)) for i, (x, y) in enumerate([(1, 1), (9, 1), (9, 9), (1, 9)])], "ring int, seq int, x double, y double")
    ws, grid = Workspace(spark, str(tmp_path)), Grid(11, 11, 0.5, 1.0, 10.5, -1.0)
    first = W.mask_for_grid(ws, "land", W.edges_of(v), grid)
    again = W.mask_for_grid(ws, "land", W.edges_of(v), grid)
    assert first.count() == again.count() == 64 and ws.exists("land")
    with pytest.raises(StageError):
        W.mask_for_grid(ws, "land", W.edges_of(v), Grid(12, 11, 0.5, 1.0, 10.5, -1.0))


def test_traces_and_segments():
    line = [(0.0, 0.0), (0.0, 0.0), (3.0, 4.0), (3.0, 14.0)]
    clean = T.without_repeats(line)
    assert len(clean) == 3 and T.at_length(clean, 0.5) == pytest.approx([3.0, 6.5])
    parts = T.straight_segments(clean, 3)
    assert parts.shape == (3, 4) and np.allclose(parts[1:, :2], parts[:-1, 2:]) and np.allclose(parts[0], [0, 0, 3, 4])
    assert np.allclose(T.pushed_down((0, 0, 10, 0), 5.0, 45.0), [[0, 5, -5], [10, 5, -5]]) and T.pushed_down((0, 0, 10, 0), 5.0, 90.0)[0, 1] == 0 and T.pushed_down((0, 0, 10, 0), 5.0, 100.0)[0, 1] < 0
    assert np.allclose(T.left_normals([(0, 0), (1, 0), (2, 0)]), [[0, 1]] * 3)
    frame = T.LocalFrame.of_trace([(-68.0, 10.0), (-67.0, 10.0)])
    assert frame.lon == pytest.approx(-67.5)
    with pytest.raises(ValueError):
        T.without_repeats([(1, 1), (1, 1)])


def test_zones_to_local_metres(spark):
    frame = T.LocalFrame(-68.0, 10.5)
    x, y = T.to_tmerc(-67.7, 10.9, -69.0)
    df = spark.createDataFrame([(x, y)], "x double, y double")
    got = df.select(*(c.alias(n) for c, n in zip(frame.from_zone(F.col("x"), F.col("y"), 32619), "ab", strict=True))).first()
    assert (got.a, got.b) == pytest.approx(frame.to_local(-67.7, 10.9), abs=1e-4)
    own = T.LocalFrame(-68.0, 10.5, -69.0)
    got = df.select(*(c.alias(n) for c, n in zip(own.from_zone(F.col("x"), F.col("y"), 32619), "ab", strict=True))).first()
    assert (got.a, got.b) == pytest.approx(own.to_local(-67.7, 10.9), abs=1e-6)
    with pytest.raises(ValueError):
        frame.from_zone(F.col("x"), F.col("y"), 4326)
