"""Matching by time, merging of frames, and resampling onto lattices."""

from __future__ import annotations

from collections.abc import Sequence
from math import pi

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fringework.storage import small_side


def nearest_in_time(others: DataFrame, refs: DataFrame, tolerance: int, other_time: str = "ts", ref_time: str = "ref") -> DataFrame:
    """``others`` with the nearest reference time (ties: the earlier), where one lies within ``tolerance`` seconds, inclusive.

    Times fall into bins as wide as the tolerance; references also stand in the
    two bins beside their own, so the match is an equi-join on the bin.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    width = max(1, tolerance) * 1_000_000
    bins = refs.select(F.col(ref_time)).distinct().withColumn("_r", micros(ref_time))
    bins = bins.withColumn("_bin", F.explode(F.array(*(F.floor(F.col("_r") / width) + k for k in (-1, 0, 1)))))
    # Distinct times look for a partner; the rows, repeated ones too, then join on their own time.
    times = others.select(F.col(other_time).alias("_t")).distinct().withColumn("_o", micros("_t")).withColumn("_bin", F.floor(F.col("_o") / width))
    found = times.join(bins, "_bin").where(F.abs(F.col("_o") - F.col("_r")) <= tolerance * 1_000_000)
    best = found.groupBy("_t").agg(F.min(F.struct(F.abs(F.col("_o") - F.col("_r")).alias("_d"), F.col(ref_time))).alias("_best"))
    told = best.select(F.col("_t").alias(other_time), F.col(f"_best.{ref_time}").alias(ref_time), (F.col("_best._d") / 1_000_000).alias("gap_seconds"))
    return others.join(told, other_time).select(*others.columns, ref_time, "gap_seconds")


def matched_one_to_one(others: DataFrame, refs: DataFrame, tolerance: int, other_time: str = "ts", ref_time: str = "ref") -> DataFrame:
    """As :func:`nearest_in_time`, but every time must find a partner of its own."""
    found = nearest_in_time(others, refs, tolerance, other_time, ref_time)
    n, m, got = others.count(), refs.select(ref_time).distinct().count(), found.agg(F.count("*"), F.countDistinct(ref_time)).first()
    if n != m or got[0] != n or got[1] != m:
        raise ValueError("the times do not match one to one within the tolerance")
    return found


def nearest_pairs(others: DataFrame, refs: DataFrame, tolerance: int) -> DataFrame:
    """(pair, other): for each pair (pair, ref_time, sec_time) the other pair of least summed gap, both gaps within the tolerance."""
    width = max(1, tolerance)
    seconds = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    mine = refs.select("pair", seconds("ref_time").alias("_a"), seconds("sec_time").alias("_b"))
    mine = mine.withColumn("_bin", F.explode(F.array(*(F.floor(F.col("_a") / width) + k for k in (-1, 0, 1)))))
    theirs = others.select(F.col("pair").alias("other"), seconds("ref_time").alias("_c"), seconds("sec_time").alias("_d")).withColumn("_bin", F.floor(F.col("_c") / width))
    gaps = mine.join(theirs, "_bin").select("pair", "other", F.abs(F.col("_a") - F.col("_c")).alias("_x"), F.abs(F.col("_b") - F.col("_d")).alias("_y"))
    near = gaps.where((F.col("_x") <= tolerance) & (F.col("_y") <= tolerance))
    return near.groupBy("pair").agg(F.min(F.struct((F.col("_x") + F.col("_y")).alias("gap"), "other")).alias("_m")).select("pair", "_m.other", "_m.gap")


def merged_outer(first: DataFrame, second: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The union of two frames, value by value; the first wins where it is valid."""
    other = second.select(*keys, *(F.col(v).alias(f"_{v}") for v in values))
    return first.select(*keys, *values).join(other, list(keys), "full_outer").select(*keys, *(F.coalesce(v, f"_{v}").alias(v) for v in values))


#: Steps that a key's range is cut into when a median is looked for.
MEDIAN_BINS = 4096


def exact_medians(rows: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, median): the exact median of the values of each key, the mean of the two middle ones of an even number.

    One pass counts the values by steps of the key's range; of the step or two
    that hold the middle ranks the distinct values are counted, so no task holds a
    key's values. Null values do not count.
    """
    keys = list(keys)
    held = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    span = small_side(held.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_all")), "median-spans")
    joined = held.join(span, keys) if keys else held.crossJoin(span)
    step = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * MEDIAN_BINS), F.lit(MEDIAN_BINS - 1))).otherwise(F.lit(0))
    binned = joined.select(*keys, "_v", "_all", step.cast("int").alias("_bin"))
    low, high = F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1
    before = lambda order: F.sum("_n").over(Window.partitionBy(*keys).orderBy(order))
    counts = binned.groupBy(*keys, "_bin", "_all").agg(F.count("*").alias("_n")).withColumn("_upto", before("_bin"))
    middle = counts.where((F.col("_upto") >= low) & (F.col("_upto") - F.col("_n") < high)).select(*keys, "_bin", (F.col("_upto") - F.col("_n")).alias("_base"))
    near = binned.join(small_side(middle, "median-steps"), [*keys, "_bin"]).groupBy(*keys, "_bin", "_base", "_all", "_v").agg(F.count("*").alias("_n"))
    ranked = near.withColumn("_to", F.col("_base") + F.sum("_n").over(Window.partitionBy(*keys, "_bin").orderBy("_v"))).withColumn("_from", F.col("_to") - F.col("_n"))
    is_low, is_high = (F.col("_from") < low) & (F.col("_to") >= low), (F.col("_from") < high) & (F.col("_to") >= high)
    return ranked.groupBy(*keys).agg(((F.max(F.when(is_low, F.col("_v"))) + F.max(F.when(is_high, F.col("_v")))) / 2).alias("median"))


def relabelled(stack: DataFrame, own: DataFrame, refs: DataFrame, tolerance: int | None, pair: str = "pair") -> DataFrame:
    """``stack`` with the pair numbers of ``refs``: of the pair nearest in time, within ``tolerance`` seconds, one to one.

    ``own`` and ``refs`` are (pair, ref_time, sec_time). Without a tolerance pairs
    go by their position. A pair that finds no partner, or not one of its own, is an error.
    """
    if tolerance is None:
        numbered = lambda df, name: df.select(F.col("pair").alias(name), F.row_number().over(Window.orderBy("pair")).alias("_n"))
        match = numbered(refs, "pair").join(numbered(own, "other"), "_n").select("pair", "other")
    else:
        match = nearest_pairs(own, refs, tolerance).select("pair", "other")
    match = small_side(match, "pair-match")
    got = match.agg(F.count("*").alias("n"), F.countDistinct("other").alias("m")).first()
    if not got["n"] == got["m"] == refs.count() == own.count():
        raise ValueError("the pairs do not match one to one")
    names = [F.col("_pair").alias(pair) if c == pair else F.col(c) for c in stack.columns]
    return stack.join(match.select(F.col("other").alias(pair), F.col("pair").alias("_pair")), pair).select(*names)


def merged_unwrapped(first: DataFrame, second: DataFrame, tie: str = "auto", keys: Sequence[str] = ("pair", "yi", "xi"), same_acquisitions: bool = True) -> DataFrame:
    """Two unwrapped frames on one lattice (keys, unw, conncomp, coherence).

    The second is tied to the first by the exact median of their difference over
    common valid pixels, per pair: to whole cycles, as it is (``offset``), or not
    (``none``); without overlap it stays. ``auto`` takes whole cycles where both
    frames are of the same acquisitions, which can differ by nothing else. Its labels move behind all of the
    first's. Every layer follows the first's phase footprint.
    """
    if tie not in ("auto", "cycles", "offset", "none"):
        raise ValueError(f"unknown tie {tie!r}")
    if tie == "auto":
        tie = "cycles" if same_acquisitions else "offset"
    pair = keys[0]
    other = second.select(*keys, F.col("unw").alias("_unw"), F.col("conncomp").alias("_cc"), F.col("coherence").alias("_coh"))
    top = first.agg(F.coalesce(F.max("conncomp"), F.lit(0)).alias("m")).first()["m"]
    if tie == "none":
        shift = other.select(pair).distinct().withColumn("_shift", F.lit(0.0))
    else:
        common = first.select(*keys, "unw").join(other, list(keys)).where("unw IS NOT NULL AND _unw IS NOT NULL")
        median = exact_medians(common.select(pair, (F.col("unw") - F.col("_unw")).alias("_d")), "_d", [pair]).withColumnRenamed("median", "_m")
        shift = median.select(pair, (F.rint(F.col("_m") / (2 * pi)) * (2 * pi) if tie == "cycles" else F.col("_m")).alias("_shift"))
    both = first.select(*keys, "unw", "conncomp", "coherence").join(other, list(keys), "full_outer").join(small_side(shift, "frame-shifts"), pair, "left")
    own = F.col("unw").isNotNull()
    moved = F.when(F.col("_cc") > 0, F.col("_cc") + F.lit(top)).otherwise(F.col("_cc"))
    return both.select(
        *keys, F.when(own, F.col("unw")).otherwise(F.col("_unw") + F.coalesce("_shift", F.lit(0.0))).alias("unw"),
        F.when(own, F.col("conncomp")).otherwise(moved).alias("conncomp"), F.when(own, F.col("coherence")).otherwise(F.col("_coh")).alias("coherence"),
    )


def warped_layers(source: DataFrame, targets: DataFrame, values: Sequence[str], method: str = "bilinear") -> DataFrame:
    """``targets`` (ty, tx, sy, sx: place in source pixels) with the values there; null where a needed pixel is missing.

    Every source pixel gets its right, lower and diagonal neighbour by two
    windows, so a target needs one join; a weight of zero needs no pixel.
    """
    names = [f"_v{i}" for i in range(len(values))]
    src = source.select("yi", "xi", *(F.col(v).alias(n) for v, n in zip(values, names, strict=True)))
    if method == "nearest":
        placed = targets.select("ty", "tx", F.floor(F.col("sy") + 0.5).cast("long").alias("yi"), F.floor(F.col("sx") + 0.5).cast("long").alias("xi"))
        return placed.join(src, ["yi", "xi"], "left").select("ty", "tx", *(F.col(n).alias(v) for v, n in zip(values, names, strict=True)))
    if method != "bilinear":
        raise ValueError(f"unknown resampling {method!r}")
    y0, x0 = F.floor("sy").cast("long"), F.floor("sx").cast("long")
    across, down = Window.partitionBy("yi").orderBy("xi").rangeBetween(1, 1), Window.partitionBy("xi").orderBy("yi").rangeBetween(1, 1)
    wide = src
    for n in names:
        wide = wide.withColumn(f"{n}e", F.first(n).over(across))
    for n in names:
        wide = wide.withColumn(f"{n}s", F.first(n).over(down)).withColumn(f"{n}d", F.first(f"{n}e").over(down))
    placed = targets.select("ty", "tx", y0.alias("yi"), x0.alias("xi"), (F.col("sy") - y0).alias("_fy"), (F.col("sx") - x0).alias("_fx"))
    fy, fx = F.col("_fy"), F.col("_fx")
    part = lambda v, w: F.when(w == 0, F.lit(0.0)).otherwise(F.col(v) * w)
    total = lambda n: part(n, (1 - fy) * (1 - fx)) + part(f"{n}e", (1 - fy) * fx) + part(f"{n}s", fy * (1 - fx)) + part(f"{n}d", fy * fx)
    return placed.join(wide, ["yi", "xi"], "left").select("ty", "tx", *(total(n).alias(v) for v, n in zip(values, names, strict=True)))


def warped(source: DataFrame, targets: DataFrame, value: str, method: str = "bilinear") -> DataFrame:
    """:func:`warped_layers` of one value."""
    return warped_layers(source, targets, [value], method)
