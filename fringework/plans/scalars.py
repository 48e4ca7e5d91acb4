"""Queries on crops, units, profiles and scene checks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from fringework.operators import interferometry as I
from fringework.operators import scenes as C
from fringework.plans import rasters as R
from fringework.plans.pixels import rounded
from fringework.plans.rasters import SCENE_SQL, SLC_SQL, UNW_SQL

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


@query(f"WITH {SCENE_SQL} SELECT yi, xi, v FROM scene WHERE xi * 10.0 + 400000 BETWEEN 400100 AND 400555 AND 4000000 - yi * 10.0 BETWEEN 3999500 AND 3999900")
def crop_box(spark, sf_dir):
    s = R.scene(spark, sf_dir)
    return C.crop(s, F.col("xi") * 10.0 + 400_000, F.lit(4_000_000) - F.col("yi") * 10.0, (400_555, 400_100), (3_999_500, 3_999_900))


@query("SELECT o_orderkey, round(o_totalprice * (0.01::DOUBLE * -1), 6) AS los FROM orders")
def units_and_sign(spark, sf_dir):
    return R.read(spark, sf_dir, "orders").select("o_orderkey", F.round(C.to_metres(F.col("o_totalprice"), "cm", -1), 6).alias("los"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(l_tax * 12.5::DOUBLE, 6) AS east, round(l_discount * -10.0::DOUBLE, 6) + 0.0::DOUBLE AS north FROM lineitem")
def offsets_in_metres(spark, sf_dir):
    e, n = C.east_north(F.col("l_tax"), F.col("l_discount"), 12.5, -10.0)
    return rounded(R.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", e.alias("east"), n.alias("north")), "east", "north")


@query(f"WITH {UNW_SQL} SELECT yi, xi, round(coalesce(a.unw, b.unw), 6) AS unw FROM (SELECT * FROM unw WHERE pair = 0) a LEFT JOIN (SELECT yi, xi, unw FROM unw WHERE pair = 1) b USING (yi, xi)")
def geometry_fill(spark, sf_dir):
    u = R.unwrapped(spark, sf_dir)
    first, second = (u.where(F.col("pair") == p).select("yi", "xi", "unw") for p in (0, 1))
    return rounded(C.filled_from(first, [second], ["yi", "xi"], ["unw"]), "unw")


@query(f"WITH {SLC_SQL} SELECT sign(avg(re))::INTEGER AS sign, sign(avg(re)) = -1 AS consistent FROM slc")
def geometry_sign(spark, sf_dir):
    return C.geometry_consistent(R.slc(spark, sf_dir), ascending=True, right_looking=True, east="re")


@query(f"WITH {UNW_SQL} SELECT round(stddev_pop(unw) * 0.02::DOUBLE, 6) AS rms_min FROM unw")
def model_rms_min(spark, sf_dir):
    return rounded(C.model_rms_min(R.unwrapped(spark, sf_dir), "unw"), "rms_min")


_DEPTHS, _MU = (0.0, 1_000.0, 1_000.0, 1_500.0), (10.0, 20.0, 30.0, 45.0)


@query("""
SELECT p_partkey, round(CASE WHEN p_retailprice < 0 THEN 10.0 WHEN p_retailprice < 1000 THEN 10.0 + p_retailprice * (10.0 / 1000.0)
  WHEN p_retailprice < 1500 THEN 30.0 + (p_retailprice - 1000) * (15.0 / 500.0) ELSE 45.0 END, 6)::DOUBLE AS mu FROM part""")
def velocity_profile(spark, sf_dir):
    return R.read(spark, sf_dir, "part").select("p_partkey", F.round(C.on_profile(F.col("p_retailprice"), _DEPTHS, _MU), 6).alias("mu"))


@query("SELECT p_partkey, round_even(abs(p_size * (p_size % 7 + 1) * (8.0::DOUBLE * 3.0 / (5.0 * 4.0))), 0)::BIGINT AS nlooks FROM part")
def independent_looks(spark, sf_dir):
    p = R.read(spark, sf_dir, "part")
    return p.select("p_partkey", I.independent_looks(F.col("p_size"), F.col("p_size") % 7 + 1, 8.0, 3.0, 5.0, 4.0).cast("long").alias("nlooks"))


@query("WITH e AS (SELECT p_partkey AS element_id, p_size::DOUBLE AS s, -p_retailprice AS z FROM part) SELECT element_id, s, z FROM e WHERE abs(s - (SELECT max(s) FROM e)) < 1e-6")
def mesh_side(spark, sf_dir):
    e = R.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("element_id"), F.col("p_size").cast("double").alias("s"), (-F.col("p_retailprice")).alias("z"))
    return C.boundary_elements(e, "right")


@query(f"WITH {SLC_SQL} SELECT t, count(*) AS n, count(re) AS valid FROM slc GROUP BY t")
def stack_concat(spark, sf_dir):
    z = R.slc(spark, sf_dir)
    parts = [(t, z.where(F.col("t") == t).select("yi", "xi", "re", "im")) for t in (3, 0, 4, 1, 2)]
    return C.stacked(parts).groupBy(F.col("t").cast("long").alias("t")).agg(F.count("*").alias("n"), F.count("re").alias("valid"))


#: A cube that is linear along each axis, which trilinear interpolation gives back exactly.
_HEIGHTS, _CUBE_Y, _CUBE_X = (0.0, 500.0, 2_000.0), (40.0, -100.0, -600.0), (-5.0, 60.0, 130.0)


@query("""
WITH p AS (SELECT event_id, user_id % 150 * 1.0::DOUBLE - 10 AS x, event_id % 700 * -1.0::DOUBLE + 50 AS y, event_id % 2600 * 1.0::DOUBLE - 100 AS h FROM events)
SELECT event_id, CASE WHEN x BETWEEN -5 AND 130 AND y BETWEEN -600 AND 40 THEN round(30 + least(2000, greatest(0, h)) * 0.01 + y * 0.05 - x * 0.1, 3) + 0.0::DOUBLE END AS angle FROM p""")
def cube_sampling(spark, sf_dir):
    """A geometry cube at places and heights: heights are held at its ends, places outside are void."""
    h, y, x = (np.array(a) for a in (_HEIGHTS, _CUBE_Y, _CUBE_X))
    cube = {"angle": 30 + h[:, None, None] * 0.01 + y[None, :, None] * 0.05 - x[None, None, :] * 0.1}
    e = R.read(spark, sf_dir, "events")
    points = e.select("event_id", (F.col("user_id") % 150 - 10.0).alias("x"), (F.col("event_id") % 700 * -1.0 + 50).alias("y"), (F.col("event_id") % 2600 - 100.0).alias("h"))
    return rounded(C.trilinear(points, cube, h, y, x).select("event_id", "angle"), "angle", digits=3)


@query("""
WITH RECURSIVE s AS (SELECT 1000::BIGINT AS n UNION SELECT unnest([n // 2, n - n // 2]) FROM s WHERE n >= 2 * 12 OR (n > 200 AND n >= 2))
SELECT n AS size FROM s""")
def cell_ladder(spark, sf_dir):
    """Every length that halving an axis gives."""
    return spark.createDataFrame([(n,) for n in C.cell_sizes(1_000, 12, 200)], "size long")
