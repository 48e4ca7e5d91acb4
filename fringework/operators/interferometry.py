"""Pairing, interferograms and multilooking on pixel tables.

A stack is a table (t, yi, xi, re, im); a pixel that is absent or null is
invalid. All operators are grouped sums, equi-joins and windows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pairs(times: DataFrame, spec: str | Sequence[tuple[int, int]] = "sequential", time: str = "t") -> DataFrame:
    """(pair, ref, sec) of the distinct times: neighbours in time, all i < j, or listed positions (order kept).

    The table of times is one row per acquisition, which is small whatever the raster.
    """
    spark = times.sparkSession
    ranked = times.select(time).distinct().withColumn("_n", F.row_number().over(Window.orderBy(time)) - 1)
    if not isinstance(spec, str):
        n = ranked.count()
        if any(not (0 <= i < n and 0 <= j < n) for i, j in spec):
            raise ValueError("a pair names an acquisition that the stack does not have")
        listed = spark.createDataFrame([(p, i, j) for p, (i, j) in enumerate(spec)], "pair long, _i int, _j int")
        a, b = ranked.select(F.col(time).alias("ref"), F.col("_n").alias("_i")), ranked.select(F.col(time).alias("sec"), F.col("_n").alias("_j"))
        return listed.join(a, "_i").join(b, "_j").select("pair", "ref", "sec")
    if spec == "sequential":
        found = ranked.select(F.col("_n").cast("long").alias("pair"), F.col(time).alias("ref"), F.lead(time).over(Window.orderBy(time)).alias("sec"))
        return found.where("sec IS NOT NULL")
    if spec != "all":
        raise ValueError(f"unknown pairing {spec!r}")
    a, b = ranked.select(F.col(time).alias("ref")), ranked.select(F.col(time).alias("sec"))
    found = a.join(b, F.col("ref") < F.col("sec"))
    return found.select((F.row_number().over(Window.orderBy("ref", "sec")) - 1).cast("long").alias("pair"), "ref", "sec")


#: Pairs formed in one plan: they stand in it as a literal.
MOST_PAIRS = 5_000


def lattice_lead(origin: float, spacing: float, looks: int) -> int:
    """Leading samples to drop so that blocks sit on the absolute lattice; halves round up."""
    from math import floor

    return floor(-origin / spacing + 0.5) % looks


def interferogram(
    slc: DataFrame, pair_table: DataFrame, looks: int = 5, ny: int | None = None, nx: int | None = None, min_valid_fraction: float = 0.5, nan_aware: bool = True, lead: tuple[int, int] = (0, 0)
) -> DataFrame:
    """(pair, yi, xi, re, im, coherence) of block means over looks x looks pixels.

    A block is kept if its share of valid pixels (of looks * looks, absent ones
    counting as invalid) reaches ``min_valid_fraction``; otherwise its phase is
    null and its coherence 0. With ``nan_aware`` off one invalid pixel voids a block.
    The raster is cut to whole blocks when its size is given.
    """
    if looks < 1:
        raise ValueError("looks must be positive")
    z = slc.select("t", "yi", "xi", "re", "im")
    if any(lead):
        z = z.where((F.col("yi") >= lead[0]) & (F.col("xi") >= lead[1])).withColumns({"yi": F.col("yi") - lead[0], "xi": F.col("xi") - lead[1]})
        ny, nx = ny and ny - lead[0], nx and nx - lead[1]
    if ny is not None and nx is not None:
        if ny < looks or nx < looks:
            raise ValueError("less than one block is left")
        z = z.where((F.col("yi") < ny // looks * looks) & (F.col("xi") < nx // looks * looks))
    # A pixel's samples come together once, whatever the number of pairs; its pairs are formed in place.
    listed = [(r["pair"], r["ref"], r["sec"]) for r in pair_table.select("pair", "ref", "sec").collect()]
    if len(listed) > MOST_PAIRS:
        raise ValueError(f"{len(listed)} pairs: form them in parts of at most {MOST_PAIRS}")
    kinds = {f.name: f.dataType for f in pair_table.schema}
    every = F.array(*(F.struct(F.lit(p).cast(kinds["pair"]).alias("pair"), F.lit(r).cast(kinds["ref"]).alias("ref"), F.lit(s).cast(kinds["sec"]).alias("sec")) for p, r, s in listed))
    pixel = z.groupBy("yi", "xi").agg(F.map_from_entries(F.collect_list(F.struct("t", F.struct("re", "im")))).alias("_z"))
    if not listed:
        every = F.array().cast("array<struct<pair:long,ref:long,sec:long>>")
    formed = pixel.select("yi", "xi", "_z", F.explode(every).alias("_p")).where(F.map_contains_key("_z", F.col("_p.ref")))
    at = lambda side: F.col("_z")[F.col(f"_p.{side}")]
    both = formed.select("yi", "xi", "_p.pair", at("ref")["re"].alias("re1"), at("ref")["im"].alias("im1"), at("sec")["re"].alias("re2"), at("sec")["im"].alias("im2"))
    valid = F.col("re1").isNotNull() & F.col("im1").isNotNull() & F.col("re2").isNotNull() & F.col("im2").isNotNull()
    real, imag = F.col("re1") * F.col("re2") + F.col("im1") * F.col("im2"), F.col("im1") * F.col("re2") - F.col("re1") * F.col("im2")
    power = lambda k: F.when(valid, F.col(f"re{k}") * F.col(f"re{k}") + F.col(f"im{k}") * F.col(f"im{k}"))
    sums = both.groupBy("pair", F.expr(f"yi div {looks}").alias("yi"), F.expr(f"xi div {looks}").alias("xi")).agg(
        F.count(F.when(valid, 1)).alias("n"), F.sum(F.when(valid, real)).alias("sr"), F.sum(F.when(valid, imag)).alias("si"), F.sum(power(1)).alias("p1"), F.sum(power(2)).alias("p2")
    )
    full = float(looks * looks)
    keep = (F.col("n") > 0) & (F.col("n") / full >= (min_valid_fraction if nan_aware else 1.0))
    mean = lambda c: F.when(keep, F.col(c) / F.col("n"))
    coherence = F.sqrt(F.pow(F.col("sr") / F.col("n"), 2) + F.pow(F.col("si") / F.col("n"), 2)) / (F.sqrt(F.col("p1") / F.col("n") * (F.col("p2") / F.col("n"))) + 1e-8)
    return sums.select("pair", "yi", "xi", mean("sr").alias("re"), mean("si").alias("im"), F.when(keep, F.least(F.lit(1.0), F.greatest(F.lit(0.0), coherence))).otherwise(0.0).alias("coherence"))


def multilook(pixels: DataFrame, looks: int, values: Sequence[str], keys: Sequence[str] = (), poison: bool = False) -> DataFrame:
    """Block means of the valid values; with ``poison`` one invalid pixel voids its block's value."""
    full = looks * looks
    mean = lambda v: F.when(F.count(v) == full, F.avg(v)) if poison else F.avg(v)
    return pixels.groupBy(*keys, F.expr(f"yi div {looks}").alias("yi"), F.expr(f"xi div {looks}").alias("xi")).agg(*(mean(v).alias(v) for v in values))


def box_filter(pixels: DataFrame, size: int, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Full-resolution box mean with a zero border: sums over [-size//2, size - size//2 - 1] on both axes, over size squared.

    The frame reaches by index, so absent pixels count as zero like the border.
    """
    low, high = -(size // 2), size - size // 2 - 1
    rows = Window.partitionBy(*keys, "yi").orderBy("xi").rangeBetween(low, high)
    columns = Window.partitionBy(*keys, "xi").orderBy("yi").rangeBetween(low, high)
    summed = pixels.withColumn("_row", F.sum(F.coalesce(F.col(value), F.lit(0))).over(rows))
    return summed.withColumn("box", F.sum("_row").over(columns).cast("double") / F.lit(float(size * size))).drop("_row")


def wrapped_phase(re: Column, im: Column) -> Column:
    return F.atan2(im, re)


def amplitude(re: Column, im: Column) -> Column:
    return F.hypot(re, im)


def phase_to_los(unwrapped: Column, wavelength: float, sign: int = 1) -> Column:
    """Metres towards the sensor: minus sign times wavelength over four pi."""
    from math import pi

    return F.lit(-sign * wavelength / (4 * pi)) * unwrapped


def independent_looks(looks_az: Column, looks_rg: Column, spacing_az: float, spacing_rg: float, res_az: float, res_rg: float) -> Column:
    """Looks that are independent, rounded half to even."""
    return F.bround(F.abs(looks_az * looks_rg * F.lit(spacing_az * spacing_rg / (res_az * res_rg))))
