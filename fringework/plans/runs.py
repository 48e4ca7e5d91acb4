"""The three stages of a slip study as entry points: sampling, the L-curve, and the inversion, over one configuration.

``python -m fringework.plans.runs STAGE CONFIG.json`` runs ``sampling``, ``lcurve``
or ``inversion``; each keeps its outputs in the workspace, so a later one starts
from there. A study that did not converge says so and exits with an error.
"""

from __future__ import annotations

import json
import sys
import time
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fringework.functions.layered import LayeredPoints, ResponseTables
from fringework.functions.surfaces import Surface
from fringework.functions.triangles import Mesh
from fringework.operators import inversion as V
from fringework.operators import looks as K
from fringework.operators import sampling as A
from fringework.operators import statistics as S
from fringework.operators.geometry import depth_levels, resampled
from fringework.plans import models as D
from fringework.plans.stages import Workspace
from fringework.sources.texts import parse_response_table


@dataclass
class Scene:
    """A displacement raster (yi, xi, los, los_east, los_north, los_up) as Parquet and its lattice in the frame's metres."""

    name: str
    path: str
    x0: float
    dx: float
    y0: float
    dy: float


@dataclass
class Study:
    """What a study is made from; every field may be given in the configuration file."""

    workspace: str
    trace: list[tuple[float, float]]
    scenes: list[Scene]
    depth: float = 20_000.0
    edge: float = 3_000.0
    top: float = 0.0
    dip: float | None = None
    dips: list[tuple[float, float, float]] | None = None  # from, to along the trace, dip
    bottom: list[tuple[float, float]] | None = None
    basis: str = "element"
    ramp: str = "offset"
    nu: float = 0.25
    tables: dict[str, str] | None = None  # files of a layered response: ss, ds, cl
    spacing: float = 309.0
    width_min: float = 1_000.0
    width_max: float = 20_000.0
    exclude_within: float = 500.0
    max_rounds: int = 5
    smoothing: float = 0.3
    weights: list[float] = field(default_factory=lambda: [float(w) for w in np.geomspace(0.01, 30, 8)])
    solving: dict = field(default_factory=dict)

    @classmethod
    def read(cls, text: str) -> Study:
        told = json.loads(text)
        unknown = set(told) - set(cls.__dataclass_fields__)
        if unknown:
            raise ValueError(f"unknown settings {sorted(unknown)}")
        told["scenes"] = [Scene(**s) for s in told["scenes"]]
        return cls(**told)

    def __post_init__(self) -> None:
        if sum(x is not None for x in (self.dip, self.dips, self.bottom)) > 1:
            raise ValueError("a fault is told by a dip, by dips of its stretches, or by its bottom")

    def mesh(self) -> Mesh:
        trace = np.array(self.trace, float)
        if self.dips is None and self.bottom is None:
            return Mesh.dipping(trace, self.depth, self.edge, 90.0 if self.dip is None else self.dip, top=self.top)
        line = resampled(self.trace, self.edge)
        s = np.r_[0, np.cumsum(np.hypot(*np.diff(line, axis=0).T))]
        z = depth_levels(self.top, self.depth, max(1, round((self.depth - self.top) / self.edge)))
        if self.bottom is not None:
            return Surface.from_bottom(line, np.array(self.bottom, float), s, z).mesh(line)
        return Surface.from_dips(s, z, [(a, min(b, s[-1])) for a, b, _ in self.dips], [d for *_, d in self.dips]).mesh(line)

    def engine(self) -> V.Engine:
        if not self.tables:
            return V.HalfSpace(self.nu)
        found = {}
        for kind, path in self.tables.items():
            with open(path, encoding="utf-8") as f:
                found[kind] = parse_response_table(f.read())
        return LayeredPoints(ResponseTables.from_files(found))


def mesh_summary(mesh: Mesh) -> dict:
    area = mesh.areas()
    return {"elements": len(mesh.triangles), "nodes": len(mesh.nodes), "area": float(area.sum()), "edge": float(np.sqrt(2 * area.mean())), "deepest": float(-mesh.nodes[:, 2].min()), "digest": V.mesh_digest(mesh)}


def gridded(spark: SparkSession, study: Study) -> dict[str, tuple[DataFrame, A.Grid]]:
    """The scenes on one lattice of the frame; each is a stage of the workspace."""
    ws = Workspace(spark, study.workspace)
    values = ["los", *K.LOOK]
    scenes = {s.name: (spark.read.parquet(s.path), s.x0, s.dx, s.y0, s.dy) for s in study.scenes}
    tables, x, y = K.resampled_scenes(scenes, values, study.spacing)
    grid = A.Grid(len(y), len(x), float(x[0]), study.spacing, float(y[0]), -study.spacing)
    out = {}
    for s in study.scenes:
        df = tables[s.name].select(F.col("ty").alias("yi"), F.col("tx").alias("xi"), *values)
        out[s.name] = (ws.store(f"scene-{s.name}", df, {"scene": asdict(s), "spacing": study.spacing, "grid": asdict(grid)}), grid)
    return out


def sampling_parameters(scenes: dict[str, tuple[DataFrame, A.Grid]], study: Study) -> dict[str, dict]:
    """For each scene, the noise of its blocks as the roughness from which cells split."""
    out = {}
    for name, (df, grid) in scenes.items():
        block = max(2, round(study.width_min / grid.dx))
        floor = S.noise_floor(S.block_stats(df, "los", block, grid.ny, grid.nx)).first()["noise_floor"]
        out[name] = {"rms_min": float(floor or 0.005), "width_min": study.width_min, "width_max": study.width_max, "exclude_within": study.exclude_within}
    return out


def run_sampling(spark: SparkSession, study: Study) -> list[dict]:
    scenes, mesh = gridded(spark, study), study.mesh()
    sample = sampling_parameters(scenes, study)
    obs, model, history = A.iterated(
        scenes, mesh, study.trace, sample, solving={"smoothing": study.smoothing} | study.solving, engine=study.engine(), basis=study.basis, ramp=study.ramp, max_rounds=study.max_rounds, spacing=max(study.spacing, study.edge / 2)
    )
    ws = Workspace(spark, study.workspace)
    ws.store("observations", obs, {"sample": sample, "mesh": mesh_summary(mesh), "kind": history[-1]["field"]}, overwrite=True)
    spark.createDataFrame([tuple(h.values()) for h in history], "round int, n long, field string, variance_reduction double, max_change double, converged boolean").coalesce(1).write.mode("overwrite").csv(f"{study.workspace}/history", header=True)
    D.save(spark, model, f"{study.workspace}/bootstrap-model")
    return history


def run_lcurve(spark: SparkSession, study: Study) -> list[dict]:
    obs, mesh = Workspace(spark, study.workspace).load("observations"), study.mesh()
    basis = V.make_basis(mesh, study.basis)
    rows = V.l_curve(V.equations(obs, mesh, study.engine(), basis, study.ramp), mesh, study.weights, basis, **study.solving)
    kinds = "smoothing double, misfit double, roughness double, variance_reduction double, max_slip double, magnitude double, iterations int, status int, converged boolean, flat boolean, saturated boolean, capped boolean"
    spark.createDataFrame([tuple(r.values()) for r in rows], kinds).coalesce(1).write.mode("overwrite").csv(f"{study.workspace}/l-curve", header=True)
    if not any(r["converged"] for r in rows):
        raise D.Unconverged("no smoothing weight converged")
    return rows


def run_inversion(spark: SparkSession, study: Study) -> V.Model:
    obs, mesh = Workspace(spark, study.workspace).load("observations"), study.mesh()
    basis, engine = V.make_basis(mesh, study.basis), study.engine()
    model = V.solve(V.equations(obs, mesh, engine, basis, study.ramp), mesh, basis, study.smoothing, engine=engine.name, **study.solving)
    folder = f"{study.workspace}/model" if model.converged else f"{study.workspace}/model-unconverged"
    D.save(spark, model, folder, V.predicted(obs, model, engine))
    if not model.converged:
        raise D.Unconverged(f"the solution did not converge; it is in {folder}")
    D.write_elements(spark, model, f"{folder}/element-table")
    D.write_vertices(spark, model, f"{folder}/vertices")
    return model


def read_write_rates(spark: SparkSession, df: DataFrame, folder: str, codecs: tuple[str, ...] = ("uncompressed", "snappy", "zstd")) -> DataFrame:
    """(codec, rows, bytes, write_seconds, read_seconds) of a table written and read with each codec."""
    rows = []
    for codec in codecs:
        path, began = f"{folder}/{codec}", time.perf_counter()
        df.write.mode("overwrite").option("compression", codec).parquet(path)
        wrote, began = time.perf_counter() - began, time.perf_counter()
        back = spark.read.parquet(path)
        n = back.count()
        back.write.format("noop").mode("overwrite").save()
        size = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).agg(F.sum("length")).first()[0]
        rows.append((codec, n, int(size or 0), wrote, time.perf_counter() - began))
    return spark.createDataFrame(rows, "codec string, rows long, bytes long, write_seconds double, read_seconds double")


STAGES = {"sampling": run_sampling, "lcurve": run_lcurve, "inversion": run_inversion}


def main(args: list[str]) -> int:
    if len(args) != 2 or args[0] not in STAGES:
        print(__doc__, file=sys.stderr)
        return 2
    from fringework.session import build_session

    with open(args[1], encoding="utf-8") as f:
        study = Study.read(f.read())
    try:
        STAGES[args[0]](build_session(f"fringework-{args[0]}"), study)
    except D.Unconverged as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
