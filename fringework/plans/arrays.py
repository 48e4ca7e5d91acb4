"""Queries on tile kernels and the slip inversion."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from fringework.functions import kernels as K
from fringework.functions import triangles as M
from fringework.operators import geometry as T
from fringework.operators import interferometry as I
from fringework.operators import slip as P
from fringework.operators import tiles as L
from fringework.plans import rasters as R
from fringework.plans.pixels import LOOKS, _size, rounded
from fringework.plans.rasters import SCENE_SQL, SCENE_WIDTH

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


SIGMA = 1.0


def _smooth_sql(sigma: float = SIGMA, what: str = "SELECT yi, xi, round(CASE WHEN w > 1e-6 THEN f / w END, 6) AS smooth FROM c") -> str:
    w = [float(x) for x in K.gaussian_weights(sigma)]
    r = len(w) // 2

    def line(column: str, part: str, order: str) -> str:
        at = lambda k: f"lag({column}, {k})" if k > 0 else f"lead({column}, {-k})" if k < 0 else f"last_value({column})"
        over = lambda k: f"OVER (PARTITION BY {part} ORDER BY {order}{' ROWS BETWEEN CURRENT ROW AND CURRENT ROW' if k == 0 else ''})"
        return " + ".join(f"{w[k + r]!r}::DOUBLE * coalesce({at(k)} {over(k)}, 0)" for k in range(-r, r + 1))

    return f"""
WITH {SCENE_SQL}, a AS (SELECT yi, xi, coalesce(v, 0)::DOUBLE AS f, (v IS NOT NULL)::INTEGER::DOUBLE AS w FROM scene),
b AS (SELECT yi, xi, {line('f', 'yi', 'xi')} AS f, {line('w', 'yi', 'xi')} AS w FROM a),
c AS (SELECT yi, xi, {line('f', 'xi', 'yi')} AS f, {line('w', 'xi', 'yi')} AS w FROM b)
{what}"""


@query(_smooth_sql())
def gaussian_smooth(spark, sf_dir):
    return rounded(L.gaussian_smooth(R.scene(spark, sf_dir), "v", SIGMA, *_size(spark, sf_dir, "events", "event_id", SCENE_WIDTH), tile=64), "smooth")


@query(_smooth_sql(2.0, "SELECT scene.yi, scene.xi, round(v - f / w, 6) + 0.0::DOUBLE AS v FROM c JOIN scene USING (yi, xi)"))
def deramp_smooth(spark, sf_dir):
    return rounded(L.deramped_smooth(R.scene(spark, sf_dir), "v", 2.0, *_size(spark, sf_dir, "events", "event_id", SCENE_WIDTH), tile=64), "v")


_AXIS = "SELECT i, sum(CASE WHEN i + k BETWEEN 0 AND n - 1 THEN w ELSE 0 END) AS r FROM (SELECT unnest(range(n)) AS i, n FROM (SELECT {n} AS n FROM size)) CROSS JOIN weights GROUP BY i"


def _gaussian_sql(looks: int) -> str:
    w = [float(x) for x in K.gaussian_weights(looks)]
    rows = ", ".join(f"({k - len(w) // 2}, {v!r}::DOUBLE)" for k, v in enumerate(w))
    return _smooth_sql(float(looks), f"""SELECT c.yi // {looks} AS yi, c.xi // {looks} AS xi, round(CASE WHEN w >= 0.5 * a.r * b.r THEN f / w END, 6) AS v
FROM c JOIN down a ON a.i = c.yi JOIN across b ON b.i = c.xi, size WHERE c.yi % {looks} = {looks // 2} AND c.xi % {looks} = {looks // 2} AND c.yi < ny // {looks} * {looks} AND c.xi < nx // {looks} * {looks}""").replace(
        "a AS (SELECT yi, xi, coalesce(v, 0)", f"size AS (SELECT max(yi) + 1 AS ny, {SCENE_WIDTH} AS nx FROM scene), weights(k, w) AS (VALUES {rows}), down AS ({_AXIS.format(n='ny')}), across AS ({_AXIS.format(n='nx')}), a AS (SELECT yi, xi, coalesce(v, 0)"
    )


@query(_gaussian_sql(3))
def gaussian_multilook(spark, sf_dir):
    return rounded(L.gaussian_multilook(R.scene(spark, sf_dir), "v", 3, *_size(spark, sf_dir, "events", "event_id", SCENE_WIDTH), tile=64), "v")


def _outliers_sql(sigma: float, threshold: float, rounds: int) -> str:
    w = [float(x) for x in K.gaussian_weights(sigma)]
    r = len(w) // 2

    def line(column: str, part: str, order: str) -> str:
        at = lambda k: f"lag({column}, {k}) OVER w" if k > 0 else f"lead({column}, {-k}) OVER w" if k < 0 else column
        return " + ".join(f"{w[k + r]!r}::DOUBLE * coalesce({at(k)}, 0)" for k in range(-r, r + 1))

    steps, last = [], "scene"
    for k in range(rounds):
        steps += [
            f"a{k} AS (SELECT yi, xi, v, coalesce(v, 0)::DOUBLE AS f, (v IS NOT NULL)::INTEGER::DOUBLE AS w FROM {last})",
            f"b{k} AS (SELECT yi, xi, v, {line('f', 'yi', 'xi')} AS f, {line('w', 'yi', 'xi')} AS w FROM a{k} WINDOW w AS (PARTITION BY yi ORDER BY xi))",
            f"c{k} AS (SELECT yi, xi, v, {line('f', 'xi', 'yi')} AS f, {line('w', 'xi', 'yi')} AS w FROM b{k} WINDOW w AS (PARTITION BY xi ORDER BY yi))",
            f"d{k} AS (SELECT yi, xi, CASE WHEN abs(v - f / w) <= {threshold} THEN v END AS v FROM c{k})",
        ]
        last = f"d{k}"
    return f"WITH {SCENE_SQL}, {', '.join(steps)} SELECT yi, xi, v::DOUBLE AS v FROM {last}"


@query(_outliers_sql(2.0, 450.0, 2))
def outliers(spark, sf_dir):
    return L.outliers_removed(R.scene(spark, sf_dir), "v", 2.0, 450.0, 2, *_size(spark, sf_dir, "events", "event_id", SCENE_WIDTH), tile=64)


def _igram(spark, sf_dir):
    times = spark.range(R.TIMES).select(F.col("id").alias("t"))
    ny, nx = _size(spark, sf_dir, "orders", "o_orderkey", R.WIDTH)
    return I.interferogram(R.slc(spark, sf_dir), I.pairs(times), LOOKS, ny, nx), ny // LOOKS, nx // LOOKS


@query("")
def goldstein(spark, sf_dir):
    igram, ny, nx = _igram(spark, sf_dir)
    return rounded(L.goldstein(igram, ny, nx, patch=8, tile=16), "re", "im")


@query("")
def unwrap(spark, sf_dir):
    igram, ny, nx = _igram(spark, sf_dir)
    phase = igram.withColumn("phase", I.wrapped_phase(F.col("re"), F.col("im")))
    return L.unwrap(phase, ny, nx).withColumn("conncomp", F.coalesce(F.col("conncomp").cast("long"), F.lit(0)))


@query("")
def pixel_offsets(spark, sf_dir):
    s = R.scene(spark, sf_dir)
    ny, nx = _size(spark, sf_dir, "events", "event_id", SCENE_WIDTH)
    moved = s.select((F.col("yi") + 1).alias("yi"), (F.col("xi") - 2).alias("xi"), "v")
    size, search = 16, 4
    window = size + 2 * search
    at = lambda n: T.offset_locations(n, window, step=12) if n >= window else []
    return rounded(L.pixel_offsets(s, moved, at(ny), at(nx), size, search), "y_offset", "x_offset", "strength")


#: A vertical fault of eight patches in a row: middle of the upper edge, its depth, length, width, strike, dip.
PATCHES = np.array([[0.0, -7_000.0 + 2_000.0 * i, 100.0, 2_000.0, 5_000.0, 0.0, 89.0] for i in range(8)])
NEIGHBOURS = [(i, i + 1) for i in range(7)]


def _equations(spark, sf_dir):
    c = R.read(spark, sf_dir, "customer")
    x, y = (F.col("c_custkey") % 41 - 20) * 700.0 + 13.0, (F.col("c_custkey") % 37 - 18) * 800.0 + 7.0
    obs = c.select(x.alias("x"), y.alias("y"), (F.atan(x / 3000.0) * F.exp(-F.pow(y / 6000.0, 2)) * 0.3 + F.col("c_acctbal") * 1e-7).alias("los"), F.lit(0.6).alias("look_e"), F.lit(-0.1).alias("look_n"), F.lit(0.79).alias("look_u"), F.lit(1.0).alias("weight"))
    return P.normal_equations(obs, PATCHES)


@query("")
def slip_solve(spark, sf_dir):
    got = P.solve(_equations(spark, sf_dir), NEIGHBOURS, 3.0)
    n = len(PATCHES)
    return spark.createDataFrame([(i, round(float(got["slip"][i]), 6), round(float(got["slip"][n + i]), 6)) for i in range(n)], "element_id long, strike_slip double, dip_slip double")


@query("")
def l_curve(spark, sf_dir):
    rows = P.l_curve(_equations(spark, sf_dir), NEIGHBOURS, [0.1, 1.0, 10.0, 100.0])
    return spark.createDataFrame([(r["smoothing"], r["misfit"], r["roughness"], r["variance_reduction"], r["nit"], r["status"] == 1) for r in rows], "smoothing double, misfit double, roughness double, variance_reduction double, nit long, converged boolean")


#: Points whose displacement one task computes: seconds of work, whatever the table's size.
TASK_POINTS = 1 << 15


@query("")
def surface_displacement(spark, sf_dir):
    """East, north, up on the scene's lattice for a triangulated fault with tapered left-lateral slip."""
    mesh = M.Mesh.dipping(np.array([[300.0, -200.0], [650.0, -800.0]]), 400.0, 150.0, 70.0, top=20.0)
    m = len(mesh.triangles)
    slip = np.r_[np.linspace(0.2, 1.0, m), np.zeros(m)]

    def run(frames):
        for f in frames:
            px, py = f["x"].to_numpy(float), f["y"].to_numpy(float)
            total = np.zeros((len(f), 3))
            for k, c in enumerate(mesh.corners()):
                total += M.triangle_response(px, py, c) @ np.array([slip[k], slip[m + k]])
            yield f.assign(ux=total[:, 0], uy=total[:, 1], uz=total[:, 2])

    points = R.scene(spark, sf_dir).select("yi", "xi", (F.col("xi") * 10.0).alias("x"), (F.col("yi") * -10.0).alias("y"))
    # The work is in the points, not in the bytes that a file's parts are cut by.
    ny, nx = _size(spark, sf_dir, "events", "event_id", SCENE_WIDTH)
    points = points.repartitionByRange(-(-ny * nx // TASK_POINTS), "yi", "xi")
    return rounded(points.mapInPandas(run, "yi long, xi long, x double, y double, ux double, uy double, uz double"), "ux", "uy", "uz")
