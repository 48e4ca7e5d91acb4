"""Small text sources: fault traces, segments, velocity models and tables of layered responses."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _lines(text: str) -> list[list[float]]:
    rows = [line for line in (raw.split("#")[0].strip() for raw in text.splitlines()) if line and not line.startswith(">")]
    return [[float(v) for v in re.split(r"[,\s]+", row)] for row in rows]


def parse_trace(text: str) -> np.ndarray:
    """(n, 2) longitudes and latitudes from KML coordinates or lines of numbers."""
    if "<coordinates" in text:
        found = re.findall(r"<(?:\w+:)?coordinates[^>]*>(.*?)</", text, re.S)
        rows = [[float(v) for v in c.split(",")[:2]] for block in found for c in block.split()]
    else:
        rows = [r[:2] for r in _lines(text)]
    if len(rows) < 2 or any(len(r) < 2 for r in rows):
        raise ValueError("a trace needs two vertices")
    return np.array(rows)


def parse_segments(text: str) -> np.ndarray:
    rows = _lines(text)
    if any(len(r) < 4 for r in rows):
        raise ValueError("a segment has four numbers")
    return np.array([r[:4] for r in rows])


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """(seq, lon, lat) of one file."""
    text = spark.read.text(path, wholetext=True).first()["value"]
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(parse_trace(text))], "seq int, lon double, lat double")


#: Columns of a crust's layers, and what follows from them.
LAYER = ("depth", "vp", "vs", "rho")
DERIVED = {"mu": "rho * vs * vs", "lam": "rho * (vp * vp - 2 * vs * vs)", "nu": "(vp * vp - 2 * vs * vs) / (2 * (vp * vp - vs * vs))"}


def parse_layers(text: str) -> list[dict[str, float]]:
    """Layers by depth (metres down, m/s, kg/m3), one a line; a number of the layer may stand in front.

    Depths may be told as negative, must not decrease, and repeat where a property
    jumps; speeds and densities are positive.
    """
    out = []
    for row in _lines(text):
        if len(row) not in (4, 5):
            raise ValueError("a layer has a depth, two speeds and a density")
        layer = dict(zip(LAYER, row[-4:], strict=True))
        layer["depth"] = abs(layer["depth"])
        if layer["vp"] <= 0 or layer["vs"] < 0 or layer["rho"] <= 0 or (out and layer["depth"] < out[-1]["depth"]):
            raise ValueError(f"not a layer below the last: {row}")
        out.append(layer)
    if not out:
        raise ValueError("a crust has a layer")
    return out


def layer_table(spark: SparkSession, layers: list[dict[str, float]]) -> DataFrame:
    """(layer, depth, vp, vs, rho, mu, lam, nu): the elastic constants are columns of the table."""
    rows = spark.createDataFrame([(i, *(float(r[c]) for c in LAYER)) for i, r in enumerate(layers)], "layer int, depth double, vp double, vs double, rho double")
    return rows.selectExpr("*", *(f"{e} AS {c}" for c, e in DERIVED.items()))


def at_depth(depth: Column, layers: DataFrame, name: str) -> Column:
    """A property of the layers at a depth of either sign; a crust has a few rows, which become literals."""
    from fringework.operators.scenes import on_profile

    rows = layers.orderBy("layer").select("depth", name).collect()
    return on_profile(F.abs(depth), [r[0] for r in rows], [r[1] for r in rows])


def fortran_floats(line: str) -> list[float]:
    """Numbers with D exponents, or with the sign of an exponent that lacks its letter."""
    fixed = re.sub(r"(?<=[0-9.])[dD](?=[-+0-9])", "e", line)
    fixed = re.sub(r"(?<=[0-9.])(?=[-+][0-9]{3}(?:\s|$))", "e", fixed)
    return [float(v) for v in fixed.split()]


def parse_response_table(text: str) -> tuple[dict[str, float], np.ndarray]:
    """Header (nr, r1, r2, nz, z1, z2, zrec, lam, mu) and values (nz, nr, columns): depth outside, distance inside."""
    rows = [fortran_floats(line) for line in text.splitlines() if line.strip() and not line.lstrip().startswith("#")]
    head = dict(zip(("nr", "r1", "r2", "nz", "z1", "z2", "zrec", "lam", "mu"), rows[0], strict=True))
    flat = np.array(rows[1:])
    nr, nz = int(head["nr"]), int(head["nz"])
    if len(flat) != nr * nz:
        raise ValueError(f"a table of {nz} x {nr} has {len(flat)} rows")
    return head, flat.reshape(nz, nr, -1)


def interpolated(head: dict[str, float], values: np.ndarray, r: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Bilinear in distance and depth; beyond the table its edge holds."""
    place = lambda v, a, b, n: np.clip((np.asarray(v, float) - a) / (b - a) * (n - 1), 0, n - 1)
    i, j = place(z, head["z1"], head["z2"], len(values)), place(r, head["r1"], head["r2"], values.shape[1])
    i0, j0 = np.minimum(i.astype(int), len(values) - 2), np.minimum(j.astype(int), values.shape[1] - 2)
    fi, fj = (i - i0)[..., None], (j - j0)[..., None]
    v = values
    return (1 - fi) * ((1 - fj) * v[i0, j0] + fj * v[i0, j0 + 1]) + fi * ((1 - fj) * v[i0 + 1, j0] + fj * v[i0 + 1, j0 + 1])


def write_offsets(offsets: DataFrame, path: str, min_correlation: float = 0.0) -> None:
    """Text of (x_pixel, x_offset, y_pixel, y_offset, correlation), without void rows and weak ones."""
    rows = offsets.where(F.col("x_offset").isNotNull() & F.col("y_offset").isNotNull() & (F.col("correlation") >= min_correlation))
    rows.select(F.format_string(" %d %6.3f %d %6.3f %6.2f ", "x_pixel", "x_offset", "y_pixel", "y_offset", "correlation").alias("value")).write.text(path)


@dataclass
class ResponseRun:
    """What a layered response is computed for: receivers at one depth, sources by distance and depth (metres)."""

    receiver_depth: float = 0.0
    distances: tuple[int, float, float] = (201, 0.0, 400e3)
    depths: tuple[int, float, float] = (100, 500.0, 50e3)
    sampling: float = 12.0
    folder: str = "responses/"
    files: tuple[str, str, str] = ("strike.txt", "dip.txt", "clvd.txt")


#: The lines of the input deck before its layers, in order, and a layer's line.
DECK = ("{receiver_depth:g}", "{distances[0]} {distances[1]:g} {distances[2]:g}", "{depths[0]} {depths[1]:g} {depths[2]:g}", "{sampling:g}", "'{folder}' '{files[0]}' '{files[1]}' '{files[2]}'", "{count}")
DECK_LAYER = "{number} {depth:g} {vp:g} {vs:g} {rho:g}"


def response_deck(layers: list[dict[str, float]], run: ResponseRun | None = None) -> str:
    """The text that asks a response program for a crust's tables."""
    told = vars(run or ResponseRun()) | {"count": len(layers)}
    lines = [line.format(**told) for line in DECK] + [DECK_LAYER.format(number=i, **row) for i, row in enumerate(layers, 1)]
    return "".join(f"{line}\n" for line in lines)
