"""Queries of whole tables on rasters that are larger than the smallest tables."""

import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from fringework.operators import masks, statistics
from fringework.plans import arrays, registry

WIDTH = 100


@pytest.fixture(scope="module")
def scene(spark, tmp_path_factory):
    """A folder with 20,000 events (200 rows, 50 block rows), and the raster's valid pixels."""
    sf = str(tmp_path_factory.mktemp("events"))
    rows = [(i, (i * 7919) % 1_003) for i in range(20_000)]
    spark.createDataFrame(rows, "event_id long, user_id long").write.parquet(f"{sf}/events.parquet")
    return sf, {divmod(i, WIDTH): (u * 13 + i * 7) % 1000 for i, u in rows if i % 19}


def test_the_profile_covers_every_block_row(spark, scene):
    sf, valid = scene
    want = {}
    for yi, xi in valid:
        sides = want.setdefault((yi // 4) * 5 // 12, [0, 0])
        sides[xi // 4 >= 12] += 1
    # The last block row, 49, lies below the end of its bin, so no bin is closed.
    got = {r.bin: [r.left_side, r.right_side] for r in registry.queries()["coverage_profile"](spark, sf).collect()}
    assert got == want and sum(map(sum, got.values())) == len(valid)


def flooded(valid, reach):
    """Brute force: {pixel: least row-major index of its component}."""
    label = {}
    for first in sorted(valid):
        if first in label:
            continue
        label[first], todo = first, [first]
        while todo:
            y, x = todo.pop()
            for p in reach:
                near = (y + p[0], x + p[1])
                if near in valid and near not in label:
                    label[near] = first
                    todo.append(near)
    return label


@pytest.mark.parametrize("name,least", [("largest_component", None), ("components_over_size", 6)])
def test_components_of_every_valid_pixel(spark, scene, name, least):
    sf, valid = scene
    label = flooded(valid, [(0, 1), (1, 0), (0, -1), (-1, 0)])
    sizes = {}
    for first in label.values():
        sizes[first] = sizes.get(first, 0) + 1
    largest = max(sizes, key=lambda c: (sizes[c], -c[0], -c[1]))
    assert {p[0] for p, c in label.items() if c == largest} == set(range(200))  # it spans the raster
    keep = {c for c in sizes if (c == largest if least is None else sizes[c] > least)}
    got = registry.queries()[name](spark, sf).collect()
    assert len(got) == 20_000
    assert {(r.yi, r.xi): r.v for r in got if r.v is not None} == {p: valid[p] for p, c in label.items() if c in keep}


def differences(spark, sf, name):
    """Rows of a query on the events of a folder that its twin lacks, and the other way."""
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet/*.parquet'")
        want = Counter(con.execute(registry.oracle_sql()[name]).fetchall())
    got = Counter(map(tuple, registry.queries()[name](spark, sf).collect()))
    assert want
    return got - want, want - got


def test_mean_looks_at_ties_of_the_last_digit(spark, scene):
    # A mean column of a sixteenth is half a unit of the sixth digit of the look.
    assert differences(spark, scene[0], "observations") == (Counter(), Counter())


@pytest.mark.parametrize("name", ["quadtree_cells", "quadtree_samples"])
def test_cells_of_a_raster_that_twelve_levels_do_not_exhaust(spark, tmp_path, name):
    rows = [(i, (i * 7919) % 1_003) for i in [*range(2_000), 6_000_000]]
    spark.createDataFrame(rows, "event_id long, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    assert differences(spark, str(tmp_path), name) == (Counter(), Counter())


@pytest.mark.parametrize("name", ["components_4", "components_8", "largest_component", "components_over_size"])
def test_a_raster_of_one_tile_needs_no_graph(spark, scene, name, monkeypatch):
    sizes, whole = [], masks.graph_components
    monkeypatch.setattr(masks, "graph_components", lambda edges: sizes.append(edges.count()) or whole(edges))
    assert registry.queries()[name](spark, scene[0]).count() >= 18_000
    assert sizes == [0]


@pytest.mark.parametrize("connectivity,local", [(1, 200_000), (2, 200_000), (2, 0)])
def test_components_across_tiles(spark, connectivity, local, monkeypatch):
    whole = masks.graph_components
    monkeypatch.setattr(masks, "graph_components", lambda edges: whole(edges, local))
    rng, keys = random.Random(connectivity), [None, 0, 7]
    cells = {(k, y, x): rng.random() < (0.6, 0.42)[connectivity - 1] for k in keys for y in range(-9, 31) for x in range(-5, 38)}
    df = spark.createDataFrame([(*p, 1.5 if v else None) for p, v in cells.items()], "pair long, yi int, xi int, v double")
    reach = [(0, 1), (1, 0), (0, -1), (-1, 0)] + [(1, 1), (1, -1), (-1, 1), (-1, -1)] * (connectivity - 1)
    label = {k: flooded({p[1:]: 1 for p, v in cells.items() if v and p[0] == k}, reach) for k in keys}
    got = masks.components(df, "v", connectivity, ["pair"], tile=8).collect()
    assert len(got) == sum(cells.values())
    assert {(r.pair, r.yi, r.xi): r.component for r in got} == {(k, *p): (c[0] << 31) + c[1] for k in keys for p, c in label[k].items()}
    for least in (None, 5):
        want = set()
        for k in keys:
            sizes = Counter(label[k].values())
            largest = max(sizes, key=lambda c: (sizes[c], -c[0], -c[1]))
            want |= {(k, *p) for p, c in label[k].items() if (c == largest if least is None else sizes[c] > least)}
        kept = masks.kept_components(df, "v", least, connectivity, ["pair"], tile=8)
        assert kept.schema == df.schema and kept.count() == len(cells)
        assert {(r.pair, r.yi, r.xi) for r in kept.where("v IS NOT NULL").collect()} == want


def test_pairs_are_linked_at_the_edges_of_tiles(spark, tmp_path, monkeypatch):
    edges, whole = [], masks.graph_components
    monkeypatch.setattr(masks, "graph_components", lambda e: edges.append(e.count()) or whole(e))
    # 1,250 rows of 120 columns: two tiles for each pair.
    spark.range(150_000).selectExpr("id AS o_orderkey", "id * 7919 % 1003 AS o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    want, across = {}, 0
    for pair in range(2):
        valid = {divmod(i, 120): c for i in range(150_000) if (i + 7 * pair) % 11 and ((c := i * 7919 % 1003) * 31 + i) % 100 >= 45}
        label = flooded(valid, [(0, 1), (1, 0), (0, -1), (-1, 0)])
        sizes, above = Counter(label.values()), Counter(c for p, c in label.items() if p[0] < masks.TILE)
        across += sum(0 < above[c] <= 4 and n - above[c] > 0 and n > 4 for c, n in sizes.items())
        want |= {(pair, *p): round((c * 7 + pair * 13) % 200 / 10 + p[1] / 50, 6) for p, c in valid.items() if sizes[label[p]] > 4}
    assert across  # components that are kept for what they have in both tiles
    got = registry.queries()["unconnected_by_pair"](spark, str(tmp_path)).collect()
    assert len(got) == 300_000
    assert {(r.pair, r.yi, r.xi): r.unw for r in got if r.unw is not None} == want
    assert len(edges) == 1 and 0 < edges[0] <= 2 * 120


def test_rows_of_few_tracks_stay_where_they_are(spark):
    rows = spark.range(300).selectExpr("concat('t', id % 3) AS track", "cast(id * 7 % 11 AS double) AS v", "1.0D AS w", "cast(id % 17 AS double) AS x", "cast(id % 13 AS double) AS y")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = statistics.ramp_content(rows, "v", "w")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_points_are_dealt_by_their_work(spark, scene, monkeypatch):
    def made():
        return registry.queries()["surface_displacement"](spark, scene[0]).withColumn("task", F.spark_partition_id())

    whole = made().drop("task")
    monkeypatch.setattr(arrays, "TASK_POINTS", 1_000, raising=False)
    tasks = [r["count"] for r in made().groupBy("task").count().collect()]
    assert sum(tasks) == 20_000 and len(tasks) >= 18 and max(tasks) <= 2_000
    assert made().drop("task").exceptAll(whole).count() == 0
