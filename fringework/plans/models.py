"""Slip models on disk: three tables and a summary, text exports, plot-ready tables, and the archive of a run."""

from __future__ import annotations

import json
import re
from dataclasses import fields

import numpy as np
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fringework.functions.triangles import Mesh
from fringework.operators import inversion as V


class Unconverged(RuntimeError):
    """An export of a solution that is none."""


def _opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


_SUMMARY = [f.name for f in fields(V.Model) if f.name not in ("mesh", "coefficients", "slip", "ramps")]


def save(spark: SparkSession, model: V.Model, path: str, obs: DataFrame | None = None) -> None:
    """``path`` gets the tables nodes, elements, basis and observations, and summary.json; the design matrix is not kept."""
    mesh = model.mesh
    nodes = [(i, *map(float, mesh.nodes[i]), *map(float, mesh.params[i])) for i in range(len(mesh.nodes))]
    spark.createDataFrame(nodes, "node_id long, x double, y double, z double, s double, depth double").write.mode("overwrite").parquet(f"{path}/nodes")
    elements = [(i, *(int(n) for n in t), *map(float, model.slip[i])) for i, t in enumerate(mesh.triangles)]
    spark.createDataFrame(elements, "element_id long, n1 long, n2 long, n3 long, strike_slip double, dip_slip double").write.mode("overwrite").parquet(f"{path}/elements")
    spark.createDataFrame([(i, float(v)) for i, v in enumerate(model.coefficients)], "unknown long, value double").write.mode("overwrite").parquet(f"{path}/basis")
    if obs is not None:
        obs.write.mode("overwrite").parquet(f"{path}/observations")
    files, base = _opened(path)
    told = {n: getattr(model, n) for n in _SUMMARY} | {"ramps": model.ramps, "digest": V.mesh_digest(mesh)}
    with files.open_output_stream(f"{base}/summary.json") as f:
        f.write(json.dumps(told, sort_keys=True, default=float).encode())


def load(spark: SparkSession, path: str) -> tuple[V.Model, DataFrame | None]:
    """The model and its observations; the mesh must be the one that was saved."""
    files, base = _opened(path)
    with files.open_input_stream(f"{base}/summary.json") as f:
        told = json.loads(f.read())
    nodes = np.array([tuple(r) for r in spark.read.parquet(f"{path}/nodes").orderBy("node_id").collect()], float)
    elements = [tuple(r) for r in spark.read.parquet(f"{path}/elements").orderBy("element_id").collect()]
    mesh = Mesh(nodes[:, 1:4], np.array([e[1:4] for e in elements], int), nodes[:, 4:6])
    if V.mesh_digest(mesh) != told["digest"]:
        raise ValueError("the mesh is not the one that was saved")
    coefficients = np.array([r["value"] for r in spark.read.parquet(f"{path}/basis").orderBy("unknown").collect()])
    model = V.Model(mesh=mesh, coefficients=coefficients, slip=np.array([e[4:6] for e in elements], float), ramps=[tuple(r) for r in told["ramps"]], **{n: told[n] for n in _SUMMARY})
    there = files.get_file_info(f"{base}/observations").type != pyarrow.fs.FileType.NotFound
    return model, spark.read.parquet(f"{path}/observations") if there else None


def _settled(model: V.Model) -> V.Model:
    if not model.converged:
        raise Unconverged("the solution has not converged")
    return model


def write_elements(spark: SparkSession, model: V.Model, path: str, rigidity: float = V.RIGIDITY) -> None:
    """Ten tab-separated columns with a header, a row for each element counted from 1."""
    V.element_table(spark, _settled(model), rigidity).orderBy("id").coalesce(1).write.mode("overwrite").csv(path, sep="\t", header=True)


def write_vertices(spark: SparkSession, model: V.Model, folder: str, rigidity: float = V.RIGIDITY) -> None:
    """Nodes (nine columns) and elements (their three nodes) as tab-separated text, counted from 1."""
    V.node_table(spark, _settled(model), rigidity).orderBy("id").coalesce(1).write.mode("overwrite").csv(f"{folder}/nodes", sep="\t", header=True)
    V.connectivity_table(spark, model.mesh).orderBy("id").coalesce(1).write.mode("overwrite").csv(f"{folder}/elements", sep="\t", header=True)


def archive(source: str, folder: str, smoothing: float, ramp: str, n_elements: int) -> str:
    """Moves a run's outputs to a name that tells its parameters; a name that is taken gets a version, nothing is replaced."""
    files, base = _opened(source)
    _, root = _opened(folder)
    files.create_dir(root, recursive=True)
    name = f"run_lam{smoothing:g}_{ramp}_{n_elements}el"
    at, version = f"{root}/{name}", 1
    while files.get_file_info(at).type != pyarrow.fs.FileType.NotFound:
        version += 1
        at = f"{root}/{name}_v{version}"
    files.move(base, at)
    return at


#: Layers of each stage that are exported: name and how it is made from the stage's columns.
EXPORTS: dict[str, dict[str, Column | str]] = {
    "slc": {"amplitude": "hypot(re, im)", "phase": "atan2(im, re)"},
    "interferogram": {"phase": "atan2(im, re)", "amplitude": "hypot(re, im)", "coherence": "coherence"},
    "unwrapped": {"unw": "unw", "conncomp": "conncomp", "coherence": "coherence", "phase_screen": "phase_screen", "subswath_mask": "subswath_mask"},
    "los": {"los": "los", "los_east": "los_east", "los_north": "los_north", "los_up": "los_up", "incidence_angle": "incidence_angle", "look_angle": "look_angle"},
    "offsets": {"x_offset": "x_offset", "y_offset": "y_offset", "correlation": "correlation", "east": "x_offset * x_spacing", "north": "y_offset * y_spacing"},
}


def export_layers(pixels: DataFrame, stage: str, chosen: list[str] | None = None, slices: list[int] | None = None, by: str = "pair") -> DataFrame:
    """(layer, yi, xi, z) of a stage's layers, of some slices if listed; layers whose columns the stage lacks are left out, unless they were asked for."""
    menu = EXPORTS[stage]
    if chosen is not None and set(chosen) - set(menu):
        raise ValueError(f"{stage} has no layer {sorted(set(chosen) - set(menu))}")
    has = {c.lower() for c in pixels.columns}
    needs = lambda text: {w for w in re.findall(r"[a-z_][a-z_0-9]*", text) if w not in ("hypot", "atan2")}
    missing = [n for n in chosen or [] if needs(menu[n]) - has]
    if missing:
        raise ValueError(f"the table lacks the columns of {missing}")
    rows = pixels if slices is None else pixels.where(F.col(by).isin(slices))
    layers = [(n, text) for n, text in menu.items() if (chosen is None or n in chosen) and not needs(text) - has]
    label = lambda n: F.concat(F.lit(f"{n}_"), F.col(by).cast("string")) if by in rows.columns else F.lit(n)
    each = F.explode(F.array(*(F.struct(label(n).alias("layer"), F.expr(text).cast("double").alias("z")) for n, text in layers)))
    return rows.select("yi", "xi", each.alias("_l")).select("_l.layer", "yi", "xi", "_l.z")


def plot_ready(pixels: DataFrame, value: str, kind: str = "symmetric", keys: tuple[str, ...] = ()) -> DataFrame:
    """``pixels`` with the limits of its colour scale: wrapped phase -pi to pi, ``symmetric`` about zero, or ``plain`` from least to most."""
    if kind == "wrapped":
        return pixels.withColumns({"v_min": F.lit(-float(np.pi)), "v_max": F.lit(float(np.pi))})
    most = pixels.groupBy(*keys).agg(F.min(value).cast("double").alias("_a"), F.max(value).cast("double").alias("_b"))
    if kind == "symmetric":
        far = F.greatest(F.abs("_a"), F.abs("_b"))
        limits = most.select(*keys, (-far + F.lit(0.0)).alias("v_min"), far.alias("v_max"))
    elif kind == "plain":
        limits = most.select(*keys, F.col("_a").alias("v_min"), F.col("_b").alias("v_max"))
    else:
        raise ValueError(f"unknown scale {kind!r}")
    return pixels.join(limits, list(keys)) if keys else pixels.crossJoin(F.broadcast(limits))


def plot_slip(spark: SparkSession, model: V.Model, component: str = "magnitude") -> DataFrame:
    """(element_id, corner, x, y, z, s, depth, value): the corners of every element in space and on the unrolled fault, with one component of slip."""
    value = {"magnitude": np.hypot(model.slip[:, 0], model.slip[:, 1]), "strike": model.slip[:, 0], "dip": model.slip[:, 1]}[component]
    mesh = model.mesh
    rows = [(i, k, *map(float, mesh.nodes[n]), *map(float, mesh.params[n]), float(value[i])) for i, t in enumerate(mesh.triangles) for k, n in enumerate(t)]
    return spark.createDataFrame(rows, "element_id long, corner int, x double, y double, z double, s double, depth double, value double")


def plot_fit(rows: DataFrame) -> DataFrame:
    """Data, prediction and residual of observations in one long table, with one scale for each track."""
    most = F.max(F.greatest(F.abs("los"), F.abs("prediction")))
    scale = rows.groupBy("track").agg(most.alias("v_max"))
    parts = F.explode(F.array(*(F.struct(F.lit(n).alias("panel"), F.col(c).alias("value")) for n, c in (("data", "los"), ("model", "prediction"), ("residual", "residual")))))
    return rows.select("track", "x", "y", parts.alias("_p")).join(scale, "track").select("track", "x", "y", "_p.panel", "_p.value", (-F.col("v_max")).alias("v_min"), "v_max")
