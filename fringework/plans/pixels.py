"""Queries on pixel tables: interferograms, multilooking, masks."""

from __future__ import annotations

from math import pi

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fringework.operators import interferometry as I
from fringework.operators import masks as M
from fringework.plans import rasters as R
from fringework.plans.rasters import SCENE_SQL, SLC_SQL, UNW_SQL

LOOKS = 5
WAVELENGTH = 0.242
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    # Adding zero turns a negative zero into zero.
    return df.withColumns({n: F.round(n, digits) + F.lit(0.0) for n in names})


def _size(spark: SparkSession, sf_dir: str, name: str, key: str, width: int) -> tuple[int, int]:
    """Rows and columns of a raster, from the file's own statistics."""
    last = R.read(spark, sf_dir, name).agg(F.max(key)).first()[0]
    return last // width + 1, width


def _igram(spark, sf_dir, spec, **more):
    stack = R.slc(spark, sf_dir)
    times = spark.range(R.TIMES).select(F.col("id").alias("t"))
    return rounded(I.interferogram(stack, I.pairs(times, spec), LOOKS, *_size(spark, sf_dir, "orders", "o_orderkey", R.WIDTH), **more), "re", "im", "coherence")


def _igram_sql(pair_sql: str, least: str = "0.5") -> str:
    return f"""
WITH {SLC_SQL}, size AS (SELECT max(yi) + 1 AS ny FROM slc), pairs AS ({pair_sql}),
joined AS (
  SELECT pair, a.yi // {LOOKS} AS yi, a.xi // {LOOKS} AS xi, a.re * b.re + a.im * b.im AS sr, a.im * b.re - a.re * b.im AS si,
         CASE WHEN b.re IS NOT NULL THEN a.re * a.re + a.im * a.im END AS p1, CASE WHEN a.re IS NOT NULL THEN b.re * b.re + b.im * b.im END AS p2
  FROM pairs JOIN slc a ON a.t = ref JOIN slc b ON b.t = sec AND a.yi = b.yi AND a.xi = b.xi
  WHERE a.yi < (SELECT ny // {LOOKS} * {LOOKS} FROM size) AND a.xi < {R.WIDTH // LOOKS * LOOKS}
), sums AS (
  SELECT pair, yi, xi, count(sr) AS n, sum(sr) AS sr, sum(si) AS si, sum(p1) AS p1, sum(p2) AS p2 FROM joined GROUP BY ALL
), told AS (SELECT *, n > 0 AND n / {float(LOOKS * LOOKS)} >= {least} AS keep FROM sums)
SELECT pair, yi, xi, round(CASE WHEN keep THEN sr / n END, 6) AS re, round(CASE WHEN keep THEN si / n END, 6) AS im,
       round(CASE WHEN keep THEN least(1.0, greatest(0.0, sqrt((sr / n) * (sr / n) + (si / n) * (si / n)) / (sqrt((p1 / n) * (p2 / n)) + 1e-8))) ELSE 0.0 END, 6)::DOUBLE AS coherence
FROM told
"""


_SEQ = "SELECT CAST(t AS BIGINT) AS pair, t AS ref, t + 1 AS sec FROM (SELECT DISTINCT t FROM slc) WHERE t < 4"
_ALL = "SELECT row_number() OVER (ORDER BY a.t, b.t) - 1 AS pair, a.t AS ref, b.t AS sec FROM (SELECT DISTINCT t FROM slc) a JOIN (SELECT DISTINCT t FROM slc) b ON a.t < b.t"


@query(_igram_sql(_SEQ))
def igram_multilook(spark, sf_dir):
    return _igram(spark, sf_dir, "sequential")


@query(_igram_sql(_ALL))
def igram_all_pairs(spark, sf_dir):
    return _igram(spark, sf_dir, "all")


@query(_igram_sql("SELECT * FROM (VALUES (CAST(0 AS BIGINT), 3, 1), (1, 0, 0)) AS p(pair, ref, sec)"))
def igram_listed_pairs(spark, sf_dir):
    return _igram(spark, sf_dir, [(3, 1), (0, 0)])


@query(_igram_sql(_SEQ, "1.0"))
def igram_legacy(spark, sf_dir):
    return _igram(spark, sf_dir, "sequential", nan_aware=False)


@query(f"WITH {SLC_SQL} SELECT t, yi // 4 AS yi, xi // 4 AS xi, round(avg(sqrt(re * re + im * im)), 6) AS amplitude FROM slc GROUP BY ALL")
def multilook_amplitude(spark, sf_dir):
    pixels = R.slc(spark, sf_dir).withColumn("amplitude", I.amplitude(F.col("re"), F.col("im")))
    return rounded(I.multilook(pixels, 4, ["amplitude"], ["t"]), "amplitude")


@query(f"WITH {SLC_SQL} SELECT t, yi // 3 AS yi, xi // 3 AS xi, round(CASE WHEN count(re) = 9 THEN avg(re) END, 6) AS re, round(CASE WHEN count(im) = 9 THEN avg(im) END, 6) AS im FROM slc GROUP BY ALL")
def multilook_legacy_null_poison(spark, sf_dir):
    return rounded(I.multilook(R.slc(spark, sf_dir), 3, ["re", "im"], ["t"], poison=True), "re", "im")


@query(f"""
WITH {SCENE_SQL}, r AS (SELECT *, sum(coalesce(v, 0)) OVER (PARTITION BY yi ORDER BY xi RANGE BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS s FROM scene)
SELECT yi, xi, v, round(sum(s) OVER (PARTITION BY xi ORDER BY yi RANGE BETWEEN 2 PRECEDING AND 1 FOLLOWING)::DOUBLE / 16, 6) AS box FROM r""")
def box_multilook_fullres(spark, sf_dir):
    return rounded(I.box_filter(R.scene(spark, sf_dir), 4, "v"), "box")


@query(f"WITH {SLC_SQL} SELECT t, yi, xi, round(atan2(im, re), 6) AS phase, round(sqrt(re * re + im * im), 6) AS amplitude FROM slc")
def phase_and_amplitude(spark, sf_dir):
    z = R.slc(spark, sf_dir)
    return rounded(z.select("t", "yi", "xi", I.wrapped_phase(F.col("re"), F.col("im")).alias("phase"), I.amplitude(F.col("re"), F.col("im")).alias("amplitude")), "phase", "amplitude")


@query(f"""
WITH {SCENE_SQL}, w AS (SELECT *, min(CASE WHEN v IS NOT NULL THEN xi END) OVER (PARTITION BY yi) AS f, max(CASE WHEN v IS NOT NULL THEN xi END) OVER (PARTITION BY yi) AS l FROM scene)
SELECT yi, xi, CASE WHEN xi >= f + 8 AND xi <= l - 8 THEN v END AS v FROM w""")
def along_track_trim(spark, sf_dir):
    return M.trim_along_track(R.scene(spark, sf_dir), "v", 8)


@query(f"""
WITH {SLC_SQL}, ok AS (SELECT *, re IS NOT NULL AND im IS NOT NULL AND re > -1.5 AS both_ FROM slc), w AS (
  SELECT *, min(CASE WHEN both_ THEN xi END) OVER (PARTITION BY t, yi) AS f, max(CASE WHEN both_ THEN xi END) OVER (PARTITION BY t, yi) AS l FROM ok
)
SELECT t, yi, xi, round(CASE WHEN both_ AND xi >= f + 6 AND xi <= l - 6 THEN re END, 6) + 0.0::DOUBLE AS re, round(CASE WHEN both_ AND xi >= f + 6 AND xi <= l - 6 THEN im END, 6) + 0.0::DOUBLE AS im FROM w""")
def joint_trim(spark, sf_dir):
    """Both layers of a stack by their common footprint, inside a mask."""
    return rounded(M.trim_edges(R.slc(spark, sf_dir), ["re", "im"], 6, keys=["t"], inside=F.col("re") > -1.5), "re", "im")


def _eroded_sql(n: int) -> str:
    return f"""
WITH {SCENE_SQL}, ok AS (SELECT yi, xi FROM scene WHERE v IS NOT NULL),
near AS (SELECT a.yi, a.xi, count(*) AS n FROM ok a, range(-{n}, {n + 1}) AS y(dy), range(-{n}, {n + 1}) AS x(dx), ok b
         WHERE abs(dy) + abs(dx) <= {n} AND b.yi = a.yi + dy AND b.xi = a.xi + dx GROUP BY ALL)
SELECT s.yi, s.xi, CASE WHEN near.n = {2 * n * (n + 1) + 1} THEN v END AS v FROM scene s LEFT JOIN near ON s.yi = near.yi AND s.xi = near.xi"""


@query(_eroded_sql(1))
def erode_l1(spark, sf_dir):
    return M.erode(R.scene(spark, sf_dir), "v", 1)


@query(_eroded_sql(2))
def erode_l1_twice(spark, sf_dir):
    return M.erode(R.scene(spark, sf_dir), "v", 2)


@query(f"WITH {UNW_SQL} SELECT pair, yi, xi, CASE WHEN subswath_mask <> 255 AND (subswath_mask // 10) % 10 > 0 AND subswath_mask % 10 > 0 THEN round(unw, 6) END AS unw FROM unw")
def subswath_valid(spark, sf_dir):
    u = R.unwrapped(spark, sf_dir)
    return u.select("pair", "yi", "xi", F.when(M.subswath_valid(F.col("subswath_mask")), F.round("unw", 6)).alias("unw"))


@query(f"WITH {UNW_SQL} SELECT pair, yi, xi, CASE WHEN coherence >= 0.35 THEN round(unw, 6) END AS unw FROM unw")
def coherence_mask(spark, sf_dir):
    return R.unwrapped(spark, sf_dir).select("pair", "yi", "xi", F.when(M.above_coherence(F.col("coherence"), 0.35), F.round("unw", 6)).alias("unw"))


@query(f"WITH {UNW_SQL}, {SCENE_SQL} SELECT yi, xi, v FROM scene WHERE (yi, xi) IN (SELECT (yi, xi) FROM unw WHERE unw IS NOT NULL)")
def footprint_semi(spark, sf_dir):
    return M.footprint(R.scene(spark, sf_dir), R.unwrapped(spark, sf_dir), "unw")


@query(f"WITH {UNW_SQL} SELECT pair, yi, xi, round(unw * {-WAVELENGTH / (4 * pi)!r}, 6) AS los FROM unw")
def los_from_phase(spark, sf_dir):
    return R.unwrapped(spark, sf_dir).select("pair", "yi", "xi", F.round(I.phase_to_los(F.col("unw"), WAVELENGTH), 6).alias("los"))


@query(f"WITH {UNW_SQL} SELECT pair, yi, xi, round(CASE WHEN pair = 1 AND conncomp IN (1, 2) THEN unw + {2 * pi * -3!r} ELSE unw END, 6) AS unw FROM unw")
def add_cycles(spark, sf_dir):
    chosen = (F.col("pair") == 1) & F.col("conncomp").isin(1, 2)
    return R.unwrapped(spark, sf_dir).select("pair", "yi", "xi", F.round(M.add_cycles(F.col("unw"), -3, chosen), 6).alias("unw"))


@query(f"WITH {UNW_SQL} SELECT pair, yi, xi, round(unw - phase_screen, 6) AS unw FROM unw")
def remove_screen(spark, sf_dir):
    return R.unwrapped(spark, sf_dir).select("pair", "yi", "xi", F.round(F.col("unw") - F.col("phase_screen"), 6).alias("unw"))


_LOOK = (-0.38, 0.1, 0.92)


@query(f"WITH {SLC_SQL} SELECT t, yi, xi, round(re * {_LOOK[0]}::DOUBLE + im * {_LOOK[1]}::DOUBLE + (re - im) * {_LOOK[2]}::DOUBLE, 6) AS los FROM slc")
def enu_project(spark, sf_dir):
    e, n, u = F.col("re"), F.col("im"), F.col("re") - F.col("im")
    return R.slc(spark, sf_dir).select("t", "yi", "xi", F.round(e * F.lit(_LOOK[0]) + n * F.lit(_LOOK[1]) + u * F.lit(_LOOK[2]), 6).alias("los"))


def _component_sql(reach: int, what: str) -> str:
    """Runs of valid pixels as the nodes of a graph; ``labelled`` has every valid pixel with its component."""
    return f"""
WITH RECURSIVE {SCENE_SQL}, ok AS (SELECT yi, xi, xi - row_number() OVER (PARTITION BY yi ORDER BY xi) AS g FROM scene WHERE v IS NOT NULL),
runs AS (SELECT yi, min(xi) AS x0, max(xi) AS x1, yi * 2147483648 + min(xi) AS id FROM ok GROUP BY yi, g),
touch AS (SELECT a.id AS a, b.id AS b FROM runs a JOIN runs b ON abs(a.yi - b.yi) = 1 AND b.x0 <= a.x1 + {reach} AND b.x1 >= a.x0 - {reach}),
reach AS (SELECT id AS node, id AS root FROM runs UNION SELECT b, root FROM reach JOIN touch ON a = node),
label AS (SELECT node, min(root) AS component FROM reach GROUP BY node),
labelled AS (SELECT yi, unnest(range(x0, x1 + 1)) AS xi, component FROM runs JOIN label ON id = node),
sizes AS (SELECT component, count(*) AS n FROM labelled GROUP BY component)
{what}"""


_STAY = "SELECT scene.yi, scene.xi, CASE WHEN stay.component IS NOT NULL THEN v END AS v FROM scene LEFT JOIN labelled USING (yi, xi) LEFT JOIN ({}) AS stay ON stay.component = labelled.component"


@query(_component_sql(0, "SELECT yi, xi, component FROM labelled"))
def components_4(spark, sf_dir):
    return M.components(R.scene(spark, sf_dir), "v", 1)


@query(_component_sql(1, "SELECT yi, xi, component FROM labelled"))
def components_8(spark, sf_dir):
    return M.components(R.scene(spark, sf_dir), "v", 2)


@query(_component_sql(0, _STAY.format("SELECT component FROM sizes ORDER BY n DESC, component LIMIT 1")))
def largest_component(spark, sf_dir):
    return M.kept_components(R.scene(spark, sf_dir), "v")


@query(_component_sql(0, _STAY.format("SELECT component FROM sizes WHERE n > 6")))
def components_over_size(spark, sf_dir):
    return M.kept_components(R.scene(spark, sf_dir), "v", min_size=6)


def _clean_sql() -> str:
    """As above, by pair: what coherence leaves of each pair, without its debris."""
    return f"""
WITH RECURSIVE {UNW_SQL}, ok AS (SELECT pair, yi, xi, xi - row_number() OVER (PARTITION BY pair, yi ORDER BY xi) AS g FROM unw WHERE unw IS NOT NULL AND coherence >= 0.45),
runs AS (SELECT pair, yi, min(xi) AS x0, max(xi) AS x1, row_number() OVER () AS id FROM ok GROUP BY pair, yi, g),
touch AS (SELECT a.id AS a, b.id AS b FROM runs a JOIN runs b ON a.pair = b.pair AND abs(a.yi - b.yi) = 1 AND b.x0 <= a.x1 AND b.x1 >= a.x0),
reach AS (SELECT id AS node, id AS root FROM runs UNION SELECT b, root FROM reach JOIN touch ON a = node),
label AS (SELECT node, min(root) AS component FROM reach GROUP BY node),
sizes AS (SELECT component, sum(x1 - x0 + 1) AS n FROM label JOIN runs ON node = id GROUP BY component),
held AS (SELECT pair, yi, unnest(range(x0, x1 + 1)) AS xi FROM runs JOIN label ON id = node JOIN sizes USING (component) WHERE n > 4)
SELECT unw.pair, unw.yi, unw.xi, CASE WHEN held.pair IS NOT NULL THEN round(unw, 6) END AS unw FROM unw LEFT JOIN held ON unw.pair = held.pair AND unw.yi = held.yi AND unw.xi = held.xi"""


@query(_clean_sql())
def unconnected_by_pair(spark, sf_dir):
    u = R.unwrapped(spark, sf_dir)
    u = u.select("pair", "yi", "xi", F.when(M.above_coherence(F.col("coherence"), 0.45), F.col("unw")).alias("unw"))
    return rounded(M.kept_components(u, "unw", min_size=4, keys=["pair"], max_drop_fraction=0.5), "unw")
