import numpy as np
import pytest
from pyspark.sql import functions as F

from fringework.plans.stages import StageError, Workspace, hash_params
from fringework.sources import granule, grids, texts
from fringework.streaming.acquisitions import sequential_pairs


def test_grid_round_trip(spark, tmp_path):
    z = np.arange(12, dtype=np.float32).reshape(3, 4)
    data = grids.compose({"lat": (("lat",), np.array([1.0, 2.0, 3.0])), "lon": (("lon",), np.array([5.0, 6.0, 7.0, 8.0])), "z": (("lat", "lon"), z)})
    (tmp_path / "a.grd").write_bytes(data)
    assert (grids.parse(data)["z"][1] == z).all()
    rows = {(r.yi, r.xi): (r.y, r.x, r.z) for r in grids.read_grids(spark, f"{tmp_path}/*.grd").collect()}
    assert len(rows) == 12 and rows[2, 3] == (3.0, 8.0, 11.0)
    with pytest.raises(ValueError):
        grids.parse(b"\x89HDF")


def test_grids_are_written_by_layer(spark, tmp_path):
    df = spark.createDataFrame([(k, y, x, float(k + y + x)) for k in (0, 1) for y in range(3) for x in range(2) if y + x], "layer long, yi long, xi long, z double")
    made = grids.write_grids(df, str(tmp_path / "g"), 0.0, 2.0, 10.0, -1.0, 3, 2).collect()
    assert len(made) == 2
    back = grids.parse((tmp_path / "g" / "z_layer1.grd").read_bytes())
    assert np.isnan(back["z"][1][0, 0]) and back["z"][1][2, 1] == 4.0 and back["y"][1].tolist() == [10.0, 9.0, 8.0]


def test_granule_reads_by_chunk(spark, tmp_path):
    rnd = np.random.default_rng(0)
    image = (rnd.normal(size=(70, 90)) + 1j * rnd.normal(size=(70, 90))).astype(np.complex64)
    image[3, 4] = np.nan
    x, y = 400_000 + 10.0 * np.arange(90), 4_000_000 - 10.0 * np.arange(70)
    granule.write(f"{tmp_path}/g", image, x, y, 32611, "2025-11-28T02:32:50", chunks=(32, 32), empty=frozenset({(0, 2)}))
    spark.dataSource.register(granule.Granule)
    df = spark.read.format("granule").option("path", f"{tmp_path}/g").load()
    rows = {(r.yi, r.xi): (r.re, r.im) for r in df.collect()}
    assert len(rows) == 70 * 90 and rows[3, 4] == (None, None) and rows[0, 70] == (None, None)
    assert rows[69, 5] == (float(image[69, 5].real), float(image[69, 5].imag))
    crop = spark.read.format("granule").options(path=f"{tmp_path}/g", y0=40, y1=50, x0=0, x1=8).load()
    assert crop.count() == 80 and crop.rdd.getNumPartitions() == 1
    with pytest.raises(ValueError):
        granule.write(f"{tmp_path}/h", image, x, y, 1, None, direction="Sideways")


def test_text_sources(spark, tmp_path):
    kml = "<kml xmlns='k'><Placemark><coordinates>-68.6,10.4,0 -67.5,10.5,0\n-66.5,10.6</coordinates></Placemark></kml>"
    (tmp_path / "t.kml").write_text(kml)
    assert [tuple(r) for r in texts.read_trace(spark, f"{tmp_path}/t.kml").collect()][1] == (1, -67.5, 10.5)
    assert texts.parse_trace("# c\n> s\n1, 2\n3 4\n").tolist() == [[1, 2], [3, 4]]
    with pytest.raises(ValueError):
        texts.parse_segments("1 2 3")
    assert texts.fortran_floats("1.0D-03 2.5-101 3") == [1e-3, 2.5e-101, 3.0]
    table = "3 0 20 2 0 10 0 1 1\n" + "\n".join(f"{100 * r + z} 0" for z in range(2) for r in range(3))
    head, values = texts.parse_response_table(table)
    assert texts.interpolated(head, values, np.array([5.0, 99.0]), np.array([5.0, -1.0]))[:, 0].tolist() == [50.5, 200.0]


def test_layers_and_their_deck(spark):
    rows = texts.parse_layers("# n d vp vs rho\n1 0 6000 3464.1016151377544 2700\n2 -10 8000 4000 3000\n3 10 8000 4000 3300\n")
    table = texts.layer_table(spark, rows)
    first = table.orderBy("layer").first()
    assert first.nu == pytest.approx(0.25) and first.mu == pytest.approx(2700 * 12e6) and first.lam == pytest.approx(first.mu)
    depths = spark.createDataFrame([(0.0,), (-5.0,), (5.0,), (10.0,), (99.0,)], "d double")
    got = [r[0] for r in depths.select(texts.at_depth(F.col("d"), table, "rho")).collect()]
    assert got == [2700, 2850, 2850, 3300, 3300]
    deck = texts.response_deck(rows, texts.ResponseRun(folder="out/")).splitlines()
    assert deck[1] == "201 0 400000" and deck[4].startswith("'out/'") and deck[5] == "3" and deck[-1] == "3 10 8000 4000 3300"
    for bad in ("", "0 6000 3000", "5 6000 3000 2700\n1 6000 3000 2700", "0 -1 3000 2700"):
        with pytest.raises(ValueError):
            texts.parse_layers(bad)



def test_stages(spark, tmp_path):
    ws = Workspace(spark, str(tmp_path / "w"))
    df = spark.range(5).withColumn("pair", spark.range(1).select("id").first()["id"] + __import__("pyspark.sql.functions", fromlist=["lit"]).lit(0))
    assert ws.store("a", df, {"looks": 5, "p": tmp_path}).count() == 5
    assert ws.store("a", lambda: 1 / 0, {"looks": 5, "p": tmp_path}).count() == 5
    with pytest.raises(StageError):
        ws.store("a", df, {"looks": 6})
    with pytest.raises(StageError):
        ws.store("a", ws.load("a"), {"looks": 6}, overwrite=True)
    assert ws.store("a", df.limit(2), {"looks": 6}, overwrite=True).count() == 2 and ws.has("a", {"looks": 6})
    ws.mark_done("a", 3)
    assert ws.pairs_done("a") == {3} and ws.pairs_done("none") == set()
    assert hash_params({"b": 1, "a": np.float64(2)}) == hash_params({"a": 2.0, "b": 1})
    ws.clear("a")
    assert not ws.exists("a")


def test_stream_pairs_acquisitions(spark, tmp_path):
    for i, rows in enumerate([[(1, "2025-01-01"), (1, "2025-01-13"), (2, "2025-01-05")], [(1, "2025-01-25"), (1, "2025-01-13"), (2, "2025-01-17")]]):
        spark.createDataFrame(rows, "frame long, t string").selectExpr("frame", "CAST(t AS timestamp) AS time").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema("frame long, time timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = sequential_pairs(stream).writeStream.format("memory").queryName("paired").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    query.processAllAvailable()
    query.stop()
    got = sorted((r.frame, r.ref_time.day, r.sec_time.day, r.seconds / 86_400) for r in spark.sql("SELECT * FROM paired").collect())
    assert got == [(1, 1, 13, 12.0), (1, 13, 25, 12.0), (2, 5, 17, 12.0)]
