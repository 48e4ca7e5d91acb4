"""Queries on traces, meshes and lattices."""

from __future__ import annotations

from pyspark.sql import functions as F

from fringework.operators import geometry as T
from fringework.plans import rasters as R
from fringework.plans.pixels import _size, rounded
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


TRACE = ((0.0, 0.0), (2_000.0, 500.0), (4_500.0, 250.0), (6_000.0, 2_000.0), (9_000.0, 2_500.0))


def _segments() -> str:
    s, rows = 0.0, []
    for i, ((x0, y0), (x1, y1)) in enumerate(zip(TRACE, TRACE[1:], strict=False)):
        length = ((x1 - x0) ** 2 + (y1 - y0) ** 2) ** 0.5
        rows.append(f"({i}, {x0!r}::DOUBLE, {y0!r}::DOUBLE, {x1 - x0!r}::DOUBLE, {y1 - y0!r}::DOUBLE, {length!r}::DOUBLE, {s!r}::DOUBLE)")
        s += length
    return ", ".join(rows)


_POINTS = "SELECT c_custkey, c_acctbal AS x, c_nationkey * 150.0::DOUBLE - 500.0::DOUBLE + c_custkey % 7 AS y FROM customer"
_NEAREST = f"""
WITH seg(seg, x0, y0, dx, dy, length, s0) AS (VALUES {_segments()}), points AS ({_POINTS}),
t AS (SELECT *, least(1.0, greatest(0.0, ((x - x0) * dx + (y - y0) * dy) / (length * length))) AS t FROM points CROSS JOIN seg),
d AS (SELECT *, (x - (x0 + t * dx)) * (x - (x0 + t * dx)) + (y - (y0 + t * dy)) * (y - (y0 + t * dy)) AS d2, s0 + t * length AS s, dx * (y - y0) - dy * (x - x0) AS c FROM t),
n AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY d2, seg) AS rn FROM d)"""


def _points(spark, sf_dir):
    return R.read(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("x"), (F.col("c_nationkey") * 150.0 - 500.0 + F.col("c_custkey") % 7).alias("y"))


@query(_NEAREST + " SELECT c_custkey, round(sqrt(d2), 6) AS distance, sign(c)::INTEGER AS side FROM n WHERE rn = 1")
def trace_distance_side(spark, sf_dir):
    return rounded(T.trace_distance(_points(spark, sf_dir), "x", "y", TRACE), "distance").select("c_custkey", "distance", "side")


@query(_NEAREST + " SELECT c_custkey, round(s, 6) AS s, round(sign(c) * sqrt(d2), 6) + 0.0::DOUBLE AS across FROM n WHERE rn = 1")
def curvilinear(spark, sf_dir):
    return rounded(T.trace_distance(_points(spark, sf_dir), "x", "y", TRACE).select("c_custkey", "s", F.col("offset").alias("across")), "s", "across")


# A mesh on the events' lattice: two triangles to each square of four neighbours.
_MESH = f"""
WITH {SCENE_SQL}, size AS (SELECT max(yi) AS last FROM scene), q AS (SELECT yi, xi, yi * {SCENE_WIDTH} + xi AS a FROM scene, size WHERE yi < last AND xi < {SCENE_WIDTH - 1}),
elements AS (SELECT 2 * a AS element_id, a AS n1, a + 1 AS n2, a + {SCENE_WIDTH} AS n3 FROM q UNION ALL SELECT 2 * a + 1, a + 1, a + {SCENE_WIDTH + 1}, a + {SCENE_WIDTH} FROM q),
nodes AS (SELECT yi * {SCENE_WIDTH} + xi AS node_id, xi * 10.0::DOUBLE AS x, yi * -6.0::DOUBLE AS y, -((yi * yi + 3 * xi) % 97)::DOUBLE AS z FROM scene)"""


def _mesh(spark, sf_dir):
    last = _size(spark, sf_dir, "events", "event_id", SCENE_WIDTH)[0] - 1
    s, w = R.scene(spark, sf_dir), SCENE_WIDTH
    a = F.col("yi") * w + F.col("xi")
    two = F.array(F.struct((2 * a).alias("element_id"), a.alias("n1"), (a + 1).alias("n2"), (a + w).alias("n3")), F.struct((2 * a + 1).alias("element_id"), (a + 1).alias("n1"), (a + w + 1).alias("n2"), (a + w).alias("n3")))
    elements = s.where((F.col("yi") < last) & (F.col("xi") < w - 1)).select(F.explode(two).alias("e")).select("e.*")
    nodes = s.select(a.alias("node_id"), (F.col("xi") * 10.0).alias("x"), (F.col("yi") * -6.0).alias("y"), (-((F.col("yi") * F.col("yi") + 3 * F.col("xi")) % 97)).cast("double").alias("z"))
    return elements, nodes


_EDGES = "edges AS (SELECT element_id, least(p, q) AS a, greatest(p, q) AS b FROM (SELECT element_id, n1 AS p, n2 AS q FROM elements UNION ALL SELECT element_id, n2, n3 FROM elements UNION ALL SELECT element_id, n3, n1 FROM elements))"


@query(f"{_MESH}, {_EDGES} SELECT e.element_id, f.element_id AS neighbour FROM edges e JOIN edges f USING (a, b) WHERE e.element_id <> f.element_id")
def mesh_adjacency(spark, sf_dir):
    return T.adjacency(_mesh(spark, sf_dir)[0])


@query(f"{_MESH}, {_EDGES} SELECT a, b FROM edges GROUP BY a, b HAVING count(*) = 1")
def mesh_boundary(spark, sf_dir):
    return T.boundary_edges(_mesh(spark, sf_dir)[0])


_MEASURED = f"""{_MESH}, v AS (
  SELECT element_id, n1, n2, n3, b.x - a.x AS ux, b.y - a.y AS uy, b.z - a.z AS uz, c.x - a.x AS vx, c.y - a.y AS vy, c.z - a.z AS vz, (a.z + b.z + c.z) / 3 AS cz
  FROM elements JOIN nodes a ON n1 = a.node_id JOIN nodes b ON n2 = b.node_id JOIN nodes c ON n3 = c.node_id
), n AS (SELECT *, uy * vz - uz * vy AS wx, uz * vx - ux * vz AS wy, ux * vy - uy * vx AS wz FROM v),
m AS (SELECT *, sqrt(wx * wx + wy * wy + wz * wz) AS norm, CASE WHEN wz < 0 THEN -1.0 ELSE 1.0 END AS up FROM n)"""


@query(f"""{_MEASURED} SELECT element_id, round(norm / 2, 6) AS area, round(cz, 6) + 0.0::DOUBLE AS cz, round(degrees(acos(least(1.0, wz / norm * up))), 6) AS dip FROM m""")
def mesh_measures(spark, sf_dir):
    return rounded(T.measured(*_mesh(spark, sf_dir)).select("element_id", "area", "cz", "dip"), "area", "cz", "dip")


@query(f"""{_MEASURED}, third AS (SELECT n1 AS node_id, norm / 6 AS a FROM m UNION ALL SELECT n2, norm / 6 FROM m UNION ALL SELECT n3, norm / 6 FROM m)
SELECT node_id, round(sum(a), 6) AS area FROM third GROUP BY node_id""")
def lumped_areas(spark, sf_dir):
    elements, nodes = _mesh(spark, sf_dir)
    return rounded(T.lumped_areas(elements, T.measured(elements, nodes).select("element_id", "area")), "area")


# Patches and windows along the raster's rows, which grow with the table; where they do not fit there are none.
@query(f"""
WITH {SCENE_SQL}, n AS (SELECT max(yi) + 1 AS n FROM scene), o AS (SELECT unnest(generate_series(0, n - 32, 8)) AS origin FROM n WHERE n >= 32 UNION SELECT n - 32 FROM n WHERE n >= 32)
SELECT row_number() OVER (ORDER BY origin) - 1 AS i, origin::BIGINT AS origin FROM o""")
def patch_origins(spark, sf_dir):
    n = R.scene(spark, sf_dir).agg(F.max("yi")).first()[0] + 1
    return spark.createDataFrame(list(enumerate(T.patch_origins(n, 32, 8))), "i long, origin long")


@query(f"""
WITH {SCENE_SQL}, n AS (SELECT max(yi) + 1 AS n FROM scene), s AS (SELECT (n - 24 - 3) // 6 AS gap FROM n WHERE (n - 24 - 3) // 6 >= 1)
SELECT i::BIGINT AS i, (3 + i * gap)::BIGINT AS origin, (3 + i * gap + 12)::BIGINT AS centre FROM s, range(0, 7) AS r(i)""")
def offset_lattice(spark, sf_dir):
    n = R.scene(spark, sf_dir).agg(F.max("yi")).first()[0] + 1
    return spark.createDataFrame([(i, o, o + 12) for i, o in enumerate(T.offset_locations(n, 24, count=7, shift=-3))], "i long, origin long, centre long")


_INVERSE = _NEAREST + ", back AS (SELECT c_custkey, s, sign(c) * sqrt(d2) AS across FROM n WHERE rn = 1), placed AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY seg.seg) AS k FROM back JOIN seg ON back.s < seg.s0 + seg.length OR seg.seg = (SELECT max(seg) FROM seg))"


@query(_INVERSE + """
SELECT c_custkey, round(x0 + (s - s0) * dx / length - across * dy / length, 4) + 0.0::DOUBLE AS x, round(y0 + (s - s0) * dy / length + across * dx / length, 4) + 0.0::DOUBLE AS y FROM placed WHERE k = 1""")
def curvilinear_inverse(spark, sf_dir):
    """Places from their distance along the trace and to its left."""
    at = T.trace_distance(_points(spark, sf_dir), "x", "y", TRACE).select("c_custkey", "s", F.col("offset").alias("across"))
    x, y = T.from_curvilinear(F.col("s"), F.col("across"), TRACE)
    return rounded(at.select("c_custkey", x.alias("x"), y.alias("y")), "x", "y", digits=4)


@query("SELECT p_partkey, round(CASE WHEN abs((40 + p_size % 51) - 90) < 0.01 THEN 0.0 ELSE p_retailprice / tan(radians((40 + p_size % 51)::DOUBLE)) END, 6)::DOUBLE AS shift FROM part")
def dip_offset(spark, sf_dir):
    p = R.read(spark, sf_dir, "part")
    return rounded(p.select("p_partkey", T.dip_offset(F.col("p_retailprice"), (F.lit(40) + F.col("p_size") % 51).cast("double")).alias("shift")), "shift")


def tmerc_sql(source: str, lon: str, lat: str, lon0: float, more: str) -> str:
    """Steps of the projection as common table expressions; the last, ``tm``, has easting and northing."""
    e = T._ECC
    series = lambda f, g, first: first + "".join(f" + {a!r}::DOUBLE * {f}({2 * k} * xi) * {g}({2 * k} * eta)" for k, a in enumerate(T._ALPHA, 1))
    return f"""tm0 AS (SELECT {more}, sin(radians({lat})) AS s, radians({lon} - {lon0!r}::DOUBLE) AS d FROM {source}),
tm1 AS (SELECT *, sinh(atanh(s) - {e!r}::DOUBLE * atanh({e!r}::DOUBLE * s)) AS t FROM tm0),
tm2 AS (SELECT *, atan2(t, cos(d)) AS xi, atanh(sin(d) / sqrt(1 + t * t)) AS eta FROM tm1),
tm AS (SELECT *, {T.FALSE_EASTING!r}::DOUBLE + {T.SCALE * T._RADIUS!r}::DOUBLE * ({series('cos', 'sinh', 'eta')}) AS easting, {T.SCALE * T._RADIUS!r}::DOUBLE * ({series('sin', 'cosh', 'xi')}) AS northing FROM tm2)"""


_ORIGIN = T.to_tmerc(-68.0, 10.5, -68.0)


@query("SELECT c_custkey, round(c_acctbal / 5000 - 68, 9) AS lon, round(c_nationkey / 25.0::DOUBLE + 10, 9) AS lat FROM customer")
def projected_and_back(spark, sf_dir):
    """Places to a UTM zone and back to lon/lat."""
    c = R.read(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") / 5000 - 68).alias("lon"), (F.col("c_nationkey") / 25.0 + 10).alias("lat"))
    x, y = T.tmerc_columns(F.col("lon"), F.col("lat"), -69.0)
    lon, lat = T.lonlat_columns(F.col("x"), F.col("y"), -69.0)
    return rounded(c.select("c_custkey", x.alias("x"), y.alias("y")).select("c_custkey", lon.alias("lon"), lat.alias("lat")), "lon", "lat", digits=9)


@query(f"""
WITH places AS (SELECT c_custkey, c_acctbal / 5000 - 68 AS lon, c_nationkey / 25.0::DOUBLE + 10 AS lat FROM customer), {tmerc_sql('places', 'lon', 'lat', -68.0, 'c_custkey')}
SELECT c_custkey, round(easting - {_ORIGIN[0]!r}::DOUBLE, 3) AS x, round(northing - {_ORIGIN[1]!r}::DOUBLE, 3) AS y FROM tm""")
def local_frame(spark, sf_dir):
    c = R.read(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") / 5000 - 68).alias("lon"), (F.col("c_nationkey") / 25.0 + 10).alias("lat"))
    x, y = T.LocalFrame(-68.0, 10.5).columns(F.col("lon"), F.col("lat"))
    return c.select("c_custkey", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query(f"{_MESH}, {_EDGES} SELECT DISTINCT a AS node_id, b AS neighbour FROM edges UNION SELECT DISTINCT b, a FROM edges")
def node_rings(spark, sf_dir):
    return T.node_neighbours(_mesh(spark, sf_dir)[0])


@query(f"""{_MEASURED}, third AS (SELECT n1 AS node_id, norm / 2 AS a, element_id % 7 AS s FROM m UNION ALL SELECT n2, norm / 2, element_id % 7 FROM m UNION ALL SELECT n3, norm / 2, element_id % 7 FROM m)
SELECT node_id, round(sum(a * s) / sum(a), 6) AS slip FROM third GROUP BY node_id""")
def nodal_slip(spark, sf_dir):
    elements, nodes = _mesh(spark, sf_dir)
    values = T.measured(elements, nodes).select("element_id", "area", (F.col("element_id") % 7).alias("slip"))
    return rounded(T.nodal_means(elements, values, ["slip"]), "slip")


_VERTICES = ", ".join(f"({i}, {x!r}::DOUBLE, {y!r}::DOUBLE)" for i, (x, y) in enumerate(TRACE))


@query(f"""
WITH v(seq, x, y) AS (VALUES {_VERTICES}), d AS (
  SELECT seq, x, y, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 0) AS step,
         (coalesce(lead(x) OVER w, x) - coalesce(lag(x) OVER w, x)) AS tx, (coalesce(lead(y) OVER w, y) - coalesce(lag(y) OVER w, y)) AS ty FROM v WINDOW w AS (ORDER BY seq)
)
SELECT seq, round(sum(step) OVER (ORDER BY seq), 6) AS s, round(tx / sqrt(tx * tx + ty * ty), 9) AS tangent_x, round(ty / sqrt(tx * tx + ty * ty), 9) AS tangent_y,
       round(-ty / sqrt(tx * tx + ty * ty), 9) + 0.0::DOUBLE AS normal_x, round(tx / sqrt(tx * tx + ty * ty), 9) AS normal_y FROM d""")
def trace_frame(spark, sf_dir):
    """Distance, tangent and left normal at a trace's vertices."""
    s = T.arc_length([x for x, _ in TRACE], [y for _, y in TRACE])
    rows = [(i, float(a), *map(float, t), *map(float, n)) for i, (a, t, n) in enumerate(zip(s, T.tangents(TRACE), T.left_normals(TRACE), strict=True))]
    df = spark.createDataFrame(rows, "seq int, s double, tangent_x double, tangent_y double, normal_x double, normal_y double")
    return rounded(rounded(df, "s"), "tangent_x", "tangent_y", "normal_x", "normal_y", digits=9)


@query("""
WITH r AS (SELECT pow(3.0::DOUBLE, 1 / 7.0::DOUBLE) AS q), t AS (SELECT i, pow(q, i) AS step FROM range(8) AS x(i), r), total AS (SELECT sum(step) AS whole FROM t)
SELECT 0::BIGINT AS i, 500.0::DOUBLE AS depth UNION ALL SELECT i + 1, round(500 + 19500 * sum(step) OVER (ORDER BY i) / whole, 6) FROM t, total""")
def depth_levels(spark, sf_dir):
    """Levels whose thickness grows threefold to the bottom."""
    return rounded(spark.createDataFrame([(i, float(z)) for i, z in enumerate(T.depth_levels(500.0, 20_000.0, 8, 3.0))], "i long, depth double"), "depth")


@query("SELECT row_number() OVER (ORDER BY x) - 1 AS i, x FROM (SELECT unnest(generate_series(-2, 14)) * 25.0::DOUBLE + 10 AS x)")
def lattice_union(spark, sf_dir):
    """An axis of ten samples extended by whole steps over an interval, and its offset to the first."""
    axis = T.union_lattice((10.0, 25.0, 235.0), (-31.0, 351.0))
    if T.lattice_offset(axis[0], 10.0, 25.0) != 2:
        raise ValueError("the axis was shifted")
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(axis)], "i long, x double")
