"""Queries that write the engine's files and read them back, and that read its small text sources."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from fringework.functions.triangles import Mesh
from fringework.operators import inversion as V
from fringework.plans import models as D
from fringework.plans import rasters as R
from fringework.plans.pixels import rounded
from fringework.sources import texts
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


#: A fault of eight steps and three levels: two triangles a cell.
STEPS, LEVELS = 8, 3


def _model() -> V.Model:
    """Slip by a rule, so that what is read back is known."""
    mesh = Mesh.structured(np.column_stack([np.arange(STEPS + 1) * 1_000.0, np.zeros(STEPS + 1)]), np.arange(LEVELS + 1) * 500.0)
    i = np.arange(len(mesh.triangles))
    slip = np.column_stack([i * 0.25, (i % 3) * 0.5 - 0.5])
    return V.Model(mesh, "element", "half space", np.r_[slip[:, 0], slip[:, 1]], slip, [], 0.3, 0.0, 0.0, 0.0, float(np.hypot(*slip.T).max()), 0.0, None, 1, 1, True)


_ELEMENTS = f"WITH e AS (SELECT i, i * 0.25::DOUBLE AS s, (i % 3) * 0.5::DOUBLE - 0.5 AS d, i // 2 AS cell FROM range({2 * STEPS * LEVELS}) AS r(i)) "


@query(_ELEMENTS + "SELECT i::BIGINT AS element_id, s AS strike_slip, d AS dip_slip FROM e")
def model_round_trip(spark, sf_dir):
    """A model saved and loaded: the slip of its elements."""
    path = fresh_path(spark, "model")
    D.save(spark, _model(), path)
    back, _ = D.load(spark, path)
    return spark.createDataFrame([(i, *map(float, s)) for i, s in enumerate(back.slip)], "element_id long, strike_slip double, dip_slip double")


@query(_ELEMENTS + """SELECT i + 1 AS id, s AS strike_slip, d AS dip_slip, round(sqrt(s * s + d * d), 6) AS slip, CASE WHEN s = 0 AND d = 0 THEN 0.0 ELSE round(degrees(atan2(d, s)), 6) END AS rake, 250000.0::DOUBLE AS area, 30000000000.0::DOUBLE AS rigidity FROM e""")
def element_text(spark, sf_dir):
    """The element table as text, read back."""
    path = fresh_path(spark, "elements")
    D.write_elements(spark, _model(), path)
    rows = spark.read.csv(path, sep="\t", header=True)
    return rounded(rows.select(F.col("id").cast("long").alias("id"), *(F.col(c).cast("double").alias(c) for c in ("strike_slip", "dip_slip", "slip", "rake", "area", "rigidity"))), "slip", "rake", "area")


@query(f"""
WITH c AS (SELECT k, i, k * {STEPS + 1} + i + 1 AS a FROM range({LEVELS}) AS x(k), range({STEPS}) AS y(i))
SELECT 2 * (k * {STEPS} + i) + 1 AS id, a AS n1, a + {STEPS + 1} AS n2, a + 1 AS n3 FROM c UNION ALL SELECT 2 * (k * {STEPS} + i) + 2, a + 1, a + {STEPS + 1}, a + {STEPS + 2} FROM c""")
def vertex_text(spark, sf_dir):
    """The connectivity of a mesh as text, read back."""
    path = fresh_path(spark, "vertices")
    D.write_vertices(spark, _model(), path)
    return spark.read.csv(f"{path}/elements", sep="\t", header=True).select(*(F.col(c).cast("long").alias(c) for c in ("id", "n1", "n2", "n3")))


_OFFSETS = "l_orderkey % 1000 AS x_pixel, l_quantity - 25.5 AS x_offset, l_partkey % 500 AS y_pixel, l_tax * 10 - 0.4 AS y_offset, l_discount * 100 AS correlation"


@query("SELECT printf(' %d %6.3f %d %6.3f %6.2f ', (l_orderkey % 1000)::BIGINT, l_quantity - 25.5, (l_partkey % 500)::BIGINT, l_tax * 10 - 0.4, l_discount * 100) AS line FROM lineitem WHERE l_discount * 100 >= 3.5")
def offsets_text(spark, sf_dir):
    """Offsets as lines of text, without the weak ones, read back."""
    path = fresh_path(spark, "offsets")
    texts.write_offsets(R.read(spark, sf_dir, "lineitem").selectExpr(*_OFFSETS.split(", ")), path, 3.5)
    return spark.read.text(path).withColumnRenamed("value", "line")


def _text(spark, name: str, text: str) -> str:
    path = fresh_path(spark, name)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    return path


@query("SELECT * FROM (VALUES (0, -68.6::DOUBLE, 10.4::DOUBLE), (1, -67.5, 10.5), (2, -66.5, 10.6)) AS t(seq, lon, lat)")
def trace_text(spark, sf_dir):
    """A trace from its KML."""
    return texts.read_trace(spark, _text(spark, "trace", "<kml xmlns='k'><Placemark><coordinates>-68.6,10.4,0 -67.5,10.5,0\n-66.5,10.6</coordinates></Placemark></kml>"))


_CRUST = "# depth vp vs rho\n0 3000 1500 2300\n2000 5200 3000 2600\n2000 5600 3200 2700\n15000 6500 3700 2900\n"


@query("""
WITH l AS (SELECT * FROM (VALUES (0, 0.0::DOUBLE, 3000.0::DOUBLE, 1500.0::DOUBLE, 2300.0::DOUBLE), (1, 2000, 5200, 3000, 2600), (2, 2000, 5600, 3200, 2700), (3, 15000, 6500, 3700, 2900)) AS t(layer, depth, vp, vs, rho))
SELECT layer, depth, rho * vs * vs AS mu, rho * (vp * vp - 2 * vs * vs) AS lam, round((vp * vp - 2 * vs * vs) / (2 * (vp * vp - vs * vs)), 9) AS nu FROM l""")
def crust_layers(spark, sf_dir):
    """A crust's layers with their elastic constants."""
    return rounded(texts.layer_table(spark, texts.parse_layers(_CRUST)).select("layer", "depth", "mu", "lam", "nu"), "nu", digits=9)


@query("""
WITH p AS (SELECT p_partkey, p_retailprice * 10 AS d FROM part)
SELECT p_partkey, round(CASE WHEN d < 2000 THEN 2300 + d * (300 / 2000.0::DOUBLE) WHEN d < 15000 THEN 2700 + (d - 2000) * (200 / 13000.0::DOUBLE) ELSE 2900 END, 6)::DOUBLE AS rho FROM p""")
def crust_at_depth(spark, sf_dir):
    """Density at depths that are told as negative."""
    table = texts.layer_table(spark, texts.parse_layers(_CRUST))
    p = R.read(spark, sf_dir, "part")
    return rounded(p.select("p_partkey", texts.at_depth(F.col("p_retailprice") * -10, table, "rho").alias("rho")), "rho")


@query("SELECT z::BIGINT AS z, r::BIGINT AS r, r * 0.5::DOUBLE + z * 100 AS vertical, -(r::DOUBLE) + 0.0::DOUBLE AS radial FROM range(3) AS a(z), range(4) AS b(r)")
def response_table_text(spark, sf_dir):
    """A table of layered responses from its text, depth outside and distance inside."""
    text = "# a table\n4 0 30 3 1 5 0 3.0D+10 3e10\n" + "\n".join(f"{r * 0.5 + z * 100:.3f}D+00 {-float(r):.1f}" for z in range(3) for r in range(4))
    head, values = texts.parse_response_table(text)
    return spark.createDataFrame([(z, r, float(values[z, r, 0]), float(values[z, r, 1]) + 0.0) for z in range(int(head["nz"])) for r in range(int(head["nr"]))], "z long, r long, vertical double, radial double")
