import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from fringework.operators import inversion as V
from fringework.plans import models as D
from fringework.plans import runs as R
from fringework.plans.stages import Workspace
from tests.test_inversion import TRACE, fault, scene


def study(tmp_path, **more):
    told = {"workspace": str(tmp_path / "ws"), "trace": TRACE.tolist(), "depth": 6_000.0, "edge": 3_000.0, "dip": 89.0, "top": 500.0, "spacing": 700.0, "width_min": 1_400.0, "width_max": 9_000.0, "exclude_within": 800.0, "max_rounds": 1, "smoothing": 0.01, "weights": [0.01, 1.0], "solving": {"boundary_ratio": 0.0}, "scenes": [{"name": "a", "path": f"{tmp_path}/a", "x0": -13_967.0, "dx": 700.0, "y0": 14_017.0, "dy": -700.0}]}
    return R.Study.read(json.dumps(told | more))


def test_a_study_from_scene_to_tables(spark, tmp_path):
    pixels, grid = scene(spark, fault())
    assert (grid.x0, grid.y0) == (-13_967.0, 14_017.0)
    pixels.withColumn("los", F.when(~F.isnan("los"), F.col("los"))).write.parquet(f"{tmp_path}/a")
    s = study(tmp_path)
    history = R.run_sampling(spark, s)
    assert history[-1]["field"] == "model" and Workspace(spark, s.workspace).load("observations").count() == history[-1]["n"]
    rows = R.run_lcurve(spark, s)
    assert [r["smoothing"] for r in rows] == [1.0, 0.01]
    model = R.run_inversion(spark, s)
    back, obs = D.load(spark, f"{s.workspace}/model")
    assert model.variance_reduction > 95 and np.allclose(back.slip, model.slip) and "residual" in obs.columns
    rates = R.read_write_rates(spark, obs, f"{tmp_path}/rates", ("snappy", "zstd")).collect()
    assert [r.codec for r in rates] == ["snappy", "zstd"] and all(r.rows == obs.count() and r.bytes > 0 for r in rates)


def test_settings_are_checked(tmp_path):
    with pytest.raises(ValueError, match="bottom"):
        study(tmp_path, bottom=[[0, 0], [1, 1]])
    with pytest.raises(ValueError, match="speed"):
        study(tmp_path, speed=3)
    bent = study(tmp_path, dip=None, dips=[[0, 6_000, 80], [6_000, 12_000, 100]])
    assert R.mesh_summary(bent.mesh())["deepest"] == pytest.approx(6_000) and isinstance(bent.engine(), V.HalfSpace)
    assert R.main(["nothing"]) == 2
