"""Queries on look geometry, common lattices, water masks, exports, and tables written and read back."""

from __future__ import annotations

from math import cos, pi, sin

from pyspark.sql import functions as F

from fringework.operators import looks as K
from fringework.operators import merging as G
from fringework.operators import water as W
from fringework.operators.interferometry import phase_to_los
from fringework.operators.sampling import Grid
from fringework.plans import models as D
from fringework.plans import rasters as R
from fringework.plans.pixels import WAVELENGTH, _size, rounded
from fringework.plans.rasters import SCENE_SQL, SCENE_WIDTH, SLC_SQL, UNW_SQL
from fringework.plans.shapes import tmerc_sql
from fringework.plans.stages import Workspace
from fringework.sources import granule, grids
from fringework.storage import fresh_path

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# Look geometry: components of no unit length over the scene, which are completed.
_LOOK_SQL = "SELECT yi, xi, -0.6::DOUBLE - 0.0004::DOUBLE * xi AS e, 0.1::DOUBLE + 0.00002::DOUBLE * (yi % 50) AS n, 0.78::DOUBLE AS u FROM scene"


def _look(spark, sf_dir):
    s = R.scene(spark, sf_dir)
    return s.select("yi", "xi", (F.lit(-0.6) - 0.0004 * F.col("xi")).alias("los_east"), (F.lit(0.1) + 0.00002 * (F.col("yi") % 50)).alias("los_north"), F.lit(0.78).alias("los_up"))


@query(f"""
WITH {SCENE_SQL}, {UNW_SQL}, look AS ({_LOOK_SQL}), told AS (SELECT *, sqrt(e * e + n * n + u * u) AS norm FROM look)
SELECT yi, xi, round(e / norm, 6) AS los_east, round(n / norm, 6) AS los_north, round(u / norm, 6) AS los_up, round(degrees(acos(u / norm)), 6) AS incidence_angle
FROM told WHERE (yi, xi) IN (SELECT (yi, xi) FROM unw WHERE unw IS NOT NULL)""")
def los_geometry(spark, sf_dir):
    _, geometry = K.los_stack(R.unwrapped(spark, sf_dir), K.completed_look(_look(spark, sf_dir)), WAVELENGTH)
    return rounded(geometry, *K.LOOK, "incidence_angle")


@query(f"WITH {UNW_SQL} SELECT pair, yi, xi, round(unw * {WAVELENGTH / (4 * pi)!r}, 6) + 0.0::DOUBLE AS los FROM unw")
def los_displacement(spark, sf_dir):
    los, _ = K.los_stack(R.unwrapped(spark, sf_dir), K.completed_look(_look(spark, sf_dir)), WAVELENGTH, sign=-1)
    return rounded(los, "los")


@query(f"SELECT c_custkey, round({K.SPEED_OF_LIGHT!r} / (1.2e9::DOUBLE + c_nationkey * 1e6::DOUBLE), 9) AS wavelength FROM customer")
def radar_wavelength(spark, sf_dir):
    return rounded(R.read(spark, sf_dir, "customer").select("c_custkey", (F.lit(K.SPEED_OF_LIGHT) / (F.lit(1.2e9) + F.col("c_nationkey") * 1e6)).alias("wavelength")), "wavelength", digits=9)


# Terrain on a lattice of its own, forty posts to a row.
_DEM = "SELECT c_custkey // 40 AS yi, c_custkey % 40 AS xi, CASE WHEN c_custkey % 23 <> 0 THEN c_acctbal END AS h FROM customer"


def _corners(targets: str, source: str, value: str) -> str:
    """Bilinear values at targets (ty, tx, sy, sx) by their four source pixels; null where one that counts is missing."""
    return f"""
corners AS (
  SELECT ty, tx, floor(sy)::BIGINT + dy AS yi, floor(sx)::BIGINT + dx AS xi, abs(1 - dy - (sy - floor(sy))) * abs(1 - dx - (sx - floor(sx))) AS w
  FROM {targets}, (VALUES (0), (1)) AS y(dy), (VALUES (0), (1)) AS x(dx)
), warped AS (SELECT ty, tx, CASE WHEN count({value}) = count(*) THEN sum(w * {value}) END AS {value} FROM corners LEFT JOIN {source} USING (yi, xi) WHERE w > 0 GROUP BY ty, tx)"""


@query(f"""
WITH {SCENE_SQL}, dem AS ({_DEM}), targets AS (SELECT yi AS ty, xi AS tx, (yi * -10.0::DOUBLE + 5) / -80.0::DOUBLE AS sy, (xi * 10.0::DOUBLE - 20) / 25.0::DOUBLE AS sx FROM scene),
{_corners('targets', 'dem', 'h')}
SELECT ty AS yi, tx AS xi, round(coalesce(h, 0.0), 6) AS height FROM warped""")
def dem_heights(spark, sf_dir):
    c = R.read(spark, sf_dir, "customer")
    dem = c.select(F.expr("c_custkey div 40").alias("yi"), (F.col("c_custkey") % 40).alias("xi"), F.when(F.col("c_custkey") % 23 != 0, F.col("c_acctbal")).alias("h"))
    pixels = R.scene(spark, sf_dir).select("yi", "xi", (F.col("xi") * 10.0).alias("x"), (F.col("yi") * -10.0).alias("y"))
    return rounded(K.dem_on_lattice(pixels, dem, 20.0, 25.0, -5.0, -80.0).select("yi", "xi", "height"), "height")


# Two scenes of their own spacing on one lattice of whole multiples of 35 metres.
_A, _B = (130.0, 20.0, 4_010.0, -20.0), (-55.0, 25.0, 3_800.0, -25.0)


def _box_sql(name: str, grid: tuple, value: str) -> str:
    x0, dx, y0, dy = grid
    return f"SELECT min(xi * {dx}::DOUBLE + {x0}) AS a, max(xi * {dx}::DOUBLE + {x0}) AS b, min(yi * {dy}::DOUBLE + {y0}) AS c, max(yi * {dy}::DOUBLE + {y0}) AS d FROM {name} WHERE {value} IS NOT NULL"


@query(f"""
WITH {SCENE_SQL}, {UNW_SQL}, other AS (SELECT yi, xi, unw AS v FROM unw WHERE pair = 1), boxes AS ({_box_sql('scene', _A, 'v')} UNION ALL {_box_sql('other', _B, 'v')}),
ends AS (SELECT floor(min(a) / 35)::BIGINT AS a, ceil(max(b) / 35)::BIGINT AS b, floor(min(c) / 35)::BIGINT AS c, ceil(max(d) / 35)::BIGINT AS d FROM boxes),
targets AS (SELECT d - y AS ty, x - a AS tx, (y * 35.0::DOUBLE - {_B[2]}) / {_B[3]}::DOUBLE AS sy, (x * 35.0::DOUBLE - {_B[0]}) / {_B[1]}::DOUBLE AS sx FROM (SELECT *, unnest(range(a, b + 1)) AS x FROM ends) CROSS JOIN (SELECT unnest(range(c, d + 1)) AS y FROM ends)),
{_corners('targets', 'other', 'v')}
SELECT ty, tx, round(v, 6) AS v FROM warped""")
def common_lattice(spark, sf_dir):
    other = R.unwrapped(spark, sf_dir).where("pair = 1").select("yi", "xi", F.col("unw").alias("v"))
    scenes = {"a": (R.scene(spark, sf_dir), *_A), "b": (other, *_B)}
    return rounded(K.resampled_scenes(scenes, ["v"], 35.0)[0]["b"], "v")


# The scene in transverse Mercator, ten metres a pixel, on a lattice in lon/lat.
_LON, _LAT = (-68.0005, 0.0002, 60), (10.4995, -0.0002, 50)
_X0, _Y0 = 499_950.0, 1_160_500.0


@query(f"""
WITH {SCENE_SQL}, places AS (SELECT ty, tx, {_LON[0]}::DOUBLE + tx * {_LON[1]}::DOUBLE AS lon, {_LAT[0]}::DOUBLE + ty * {_LAT[1]}::DOUBLE AS lat FROM range({_LAT[2]}) AS a(ty), range({_LON[2]}) AS b(tx)),
{tmerc_sql('places', 'lon', 'lat', -68.0, 'ty, tx, lon, lat')}, targets AS (SELECT ty, tx, lon, lat, (northing - {_Y0}) / -10.0 AS sy, (easting - {_X0}) / 10.0 AS sx FROM tm),
{_corners('targets', 'scene', 'v')}
SELECT ty, tx, round(lon, 9) AS lon, round(lat, 9) AS lat, round(v, 3) AS v FROM targets JOIN warped USING (ty, tx)""")
def scene_to_lonlat(spark, sf_dir):
    lon, lat = ([first + step * i for i in range(n)] for first, step, n in (_LON, _LAT))
    out = K.to_lonlat(R.scene(spark, sf_dir), ["v"], -68.0, lon, lat, _X0, 10.0, _Y0, -10.0)
    return rounded(rounded(out, "lon", "lat", digits=9), "v", digits=3)


#: Islands of five to nine corners around the scene, one for each nation.
_RINGS = "SELECT n_nationkey AS ring, k AS seq, (n_nationkey * 37 % 100) * 10.0::DOUBLE + 3.3 + (60 + n_nationkey * 4) * {c}::DOUBLE AS x, -((n_nationkey * 53 % 90) * 10.0::DOUBLE) - 1.7 + (45 + n_nationkey * 3) * {s}::DOUBLE AS y FROM nation WHERE k < 5 + n_nationkey % 5"
_TURNS = [(round(cos(2.1 + 1.1 * k), 6), round(sin(2.1 + 1.1 * k), 6)) for k in range(9)]
_VERTICES = " UNION ALL ".join(_RINGS.format(c=c, s=s).replace("k AS seq", f"{k} AS seq").replace("k < 5", f"{k} < 5") for k, (c, s) in enumerate(_TURNS))


def _land_edges(spark, sf_dir):
    n = R.read(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    corners = F.array(*(F.struct(F.lit(i).alias("seq"), F.lit(c).alias("c"), F.lit(s).alias("s")) for i, (c, s) in enumerate(_TURNS)))
    v = n.select(k.alias("ring"), F.explode(corners).alias("v"), "n_nationkey").where(F.col("v.seq") < 5 + k % 5)
    x, y = (k * 37 % 100) * 10.0 + 3.3 + (k * 4 + 60) * F.col("v.c"), -((k * 53 % 90) * 10.0) - 1.7 + (k * 3 + 45) * F.col("v.s")
    return W.edges_of(v.select("ring", "v.seq", x.alias("x"), y.alias("y")))


@query(f"""
WITH {SCENE_SQL}, vertices AS ({_VERTICES}),
edges AS (SELECT x AS x1, y AS y1, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM vertices WINDOW w AS (PARTITION BY ring ORDER BY seq)),
crossed AS (SELECT yi, xi, count(*) AS n FROM scene JOIN edges ON yi * -10.0 >= least(y1, y2) AND yi * -10.0 < greatest(y1, y2) AND x1 + (yi * -10.0 - y1) / (y2 - y1) * (x2 - x1) > xi * 10.0 GROUP BY yi, xi)
SELECT scene.yi, scene.xi, CASE WHEN n % 2 = 1 THEN v END AS v FROM scene LEFT JOIN crossed USING (yi, xi)""")
def water_mask(spark, sf_dir):
    ny, nx = _size(spark, sf_dir, "events", "event_id", SCENE_WIDTH)
    land = W.land_mask(_land_edges(spark, sf_dir), Grid(ny, nx, 0.0, 10.0, 0.0, -10.0))
    return W.mask_water(R.scene(spark, sf_dir), land, ["v"])


@query("""
SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN printf('%.6g', (c_nationkey + 1) * 2.5) || 'e' ELSE printf('%.6g', (c_nationkey + 1) / 7200.0) END AS increment FROM customer""")
def mask_increment(spark, sf_dir):
    rows = [(n, W.increment((n + 1) * 5.0, False) if n % 2 == 0 else W.increment(-(n + 1) / 3600.0, True)) for n in range(25)]
    told = spark.createDataFrame(rows, "c_nationkey long, increment string")
    c = R.read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("c_nationkey"))
    return c.join(F.broadcast(told), "c_nationkey").select("c_custkey", "increment")


@query(f"""
WITH {UNW_SQL} SELECT pair, yi, xi, round(unw, 6) AS unw, CASE WHEN conncomp = 2 THEN 0 ELSE conncomp END AS conncomp, CASE WHEN pair = 0 THEN round(phase_screen, 6) END AS phase_screen, CASE WHEN pair = 0 THEN subswath_mask ELSE 255 END AS subswath_mask FROM unw""")
def unwrapped_product(spark, sf_dir):
    u = R.unwrapped(spark, sf_dir).withColumn("conncomp", F.when(F.col("conncomp") == 2, F.lit(65535)).otherwise(F.col("conncomp")))
    first = u.where("pair = 0").select("yi", "xi", "unw", "conncomp", "phase_screen", "subswath_mask")
    second = u.where("pair = 1").select("yi", "xi", "unw", F.when(F.col("conncomp") < 65535, F.col("conncomp")).alias("conncomp"))
    return rounded(K.unwrapped_product([(0, first), (1, second)]), "unw", "phase_screen").withColumn("subswath_mask", F.col("subswath_mask").cast("long"))


@query(f"""
WITH {UNW_SQL}
SELECT 'unw_' || pair AS layer, yi, xi, round(unw, 6) AS z FROM unw WHERE pair = 1 UNION ALL SELECT 'coherence_' || pair, yi, xi, coherence FROM unw WHERE pair = 1""")
def export_layers(spark, sf_dir):
    u = R.unwrapped(spark, sf_dir)
    return rounded(D.export_layers(u, "unwrapped", ["unw", "coherence"], slices=[1]), "z")


@query(f"""
WITH {SLC_SQL} SELECT 'phase_' || t AS layer, yi, xi, round(atan2(im, re), 6) + 0.0::DOUBLE AS z FROM slc UNION ALL SELECT 'amplitude_' || t, yi, xi, round(sqrt(re * re + im * im), 6) FROM slc""")
def export_menu(spark, sf_dir):
    return rounded(D.export_layers(R.slc(spark, sf_dir), "slc", by="t"), "z")


@query(f"WITH {UNW_SQL} SELECT pair, yi, xi, round(unw, 6) AS unw, round(-max(abs(unw)) OVER (PARTITION BY pair), 6) AS v_min, round(max(abs(unw)) OVER (PARTITION BY pair), 6) AS v_max FROM unw")
def plot_limits(spark, sf_dir):
    return rounded(D.plot_ready(R.unwrapped(spark, sf_dir).select("pair", "yi", "xi", "unw"), "unw", keys=("pair",)), "unw", "v_min", "v_max")


@query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 6) AS median FROM lineitem GROUP BY l_returnflag")
def exact_medians(spark, sf_dir):
    return rounded(G.exact_medians(R.read(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_returnflag"]), "median")


@query("SELECT c_custkey, c_name AS name, regexp_replace(c_mktsegment, '^\\s+|\\s+$', '', 'g') AS segment FROM customer")
def decoded_strings(spark, sf_dir):
    c = R.read(spark, sf_dir, "customer")
    padded = F.concat(F.col("c_name").cast("binary"), F.lit(b"\0\0"))
    return c.select("c_custkey", K.decoded(padded).alias("name"), K.decoded(F.concat(F.lit(" "), F.col("c_mktsegment"))).alias("segment"))


# Tables written and read back.


@query(f"WITH {SLC_SQL} SELECT yi, xi, 4000000.0::DOUBLE - 10.0::DOUBLE * yi AS y, 500000.0::DOUBLE + 10.0::DOUBLE * xi AS x, round(re::FLOAT::DOUBLE, 5) + 0.0::DOUBLE AS re, round(im::FLOAT::DOUBLE, 5) + 0.0::DOUBLE AS im FROM slc WHERE t = 0 AND yi < 70 AND xi >= 30")
def granule_round_trip(spark, sf_dir):
    """An acquisition as a chunked granule, read back with a crop that the reader's partitions carry out."""
    z = R.slc(spark, sf_dir).where("t = 0").select("yi", "xi", "re", "im")
    ny, nx = _size(spark, sf_dir, "orders", "o_orderkey", R.WIDTH)
    path = fresh_path(spark, "granule")
    granule.write_distributed(z, path, 500_000.0, 10.0, 4_000_000.0, -10.0, ny, nx, 32618, "2024-01-01T00:00:00", chunks=(32, 32))
    spark.dataSource.register(granule.Granule)
    back = spark.read.format("granule").option("y1", 70).option("x0", 30).load(path)
    # The lattice has pixels that the table lacks; they come back void.
    back = back.join(z.select("yi", "xi"), ["yi", "xi"], "left_semi")
    return rounded(back.withColumns({c: F.col(c).cast("double") for c in ("re", "im")}).select("yi", "xi", "y", "x", "re", "im"), "re", "im", digits=5)


@query(f"WITH {SCENE_SQL}, s AS (SELECT yi % 2 AS layer, yi // 2 AS yi, xi, v FROM scene) SELECT layer, yi, xi, yi * -20.0::DOUBLE + 0.0::DOUBLE AS y, xi * 10.0::DOUBLE AS x, v::DOUBLE AS z FROM s")
def grid_round_trip(spark, sf_dir):
    """Two layers as grid files, read back."""
    s = R.scene(spark, sf_dir).select((F.col("yi") % 2).alias("layer"), F.expr("yi div 2").alias("yi"), "xi", F.col("v").cast("double").alias("z"))
    ny, nx = _size(spark, sf_dir, "events", "event_id", SCENE_WIDTH)
    folder = fresh_path(spark, "grids")
    grids.write_grids(s, folder, 0.0, 10.0, 0.0, -20.0, -(-ny // 2), nx).collect()
    back = grids.read_grids(spark, f"{folder}/*.grd")
    told = back.select(F.regexp_extract("path", r"layer(\d+)", 1).cast("long").alias("layer"), "yi", "xi", "y", "x", F.when(~F.isnan("z"), F.col("z")).alias("z"))
    return told.join(s.select("layer", "yi", "xi"), ["layer", "yi", "xi"], "left_semi").select("layer", "yi", "xi", (F.col("y") + 0.0).alias("y"), "x", "z")


@query(f"WITH {UNW_SQL} SELECT pair, yi, xi, round(unw, 6) AS unw FROM unw")
def stage_round_trip(spark, sf_dir):
    """A stage under the hash of its parameters: made, found again, and not made twice."""
    ws = Workspace(spark, fresh_path(spark, "workspace"))
    u = R.unwrapped(spark, sf_dir).select("pair", "yi", "xi", "unw")
    ws.store("unwrapped", u, {"looks": 5}, partition_by=("pair",))
    return rounded(ws.store("unwrapped", lambda: 1 / 0, {"looks": 5}), "unw")


@query(f"WITH {UNW_SQL} SELECT pair, yi, xi, round(CASE WHEN pair = 1 THEN -unw ELSE unw END, 6) + 0.0::DOUBLE AS unw FROM unw")
def stage_region_writes(spark, sf_dir):
    """A stage that is set up empty and written pair by pair; a pair that is written again is replaced alone."""
    ws = Workspace(spark, fresh_path(spark, "workspace"))
    u = R.unwrapped(spark, sf_dir).select("pair", "yi", "xi", "unw")
    ws.init("unwrapped", u, {"looks": 5}, by="pair")
    for pair in (0, 1):
        ws.write_region("unwrapped", u.where(F.col("pair") == pair), pair)
    ws.write_region("unwrapped", u.where("pair = 1").withColumn("unw", -F.col("unw")), 1)
    if ws.pairs_done("unwrapped") != {0, 1}:
        raise ValueError("a region is missing")
    return rounded(ws.load("unwrapped"), "unw")


@query(f"WITH {UNW_SQL} SELECT pair, yi, xi, round(unw, 6) AS unw, round({-WAVELENGTH / (4 * pi)!r} * unw, 6) + 0.0::DOUBLE AS los FROM unw WHERE unw IS NOT NULL AND (yi, xi) IN (SELECT (yi, xi) FROM unw WHERE pair = 1 AND coherence >= 0.5)")
def los_where_coherent(spark, sf_dir):
    u = R.unwrapped(spark, sf_dir)
    keep = u.where("pair = 1 AND coherence >= 0.5").select("yi", "xi")
    return rounded(u.where("unw IS NOT NULL").join(keep, ["yi", "xi"], "left_semi").select("pair", "yi", "xi", "unw", phase_to_los(F.col("unw"), WAVELENGTH).alias("los")), "unw", "los")
