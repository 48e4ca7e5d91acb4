"""Links between sets of five-word runs whose Jaccard likeness is at least 0.8.

Sets that share a bucket are compared with their whole members. Buckets are
MinHash bands (24 bands of 5 values: a pair at 0.8 shares one with probability
0.9999, a likelier one with more) and whatever else the caller adds.

Equal sets are one row before anything is compared. A bucket that holds much is
dealt in shards: its rows are each home in one and are sent to all, so every pair
meets and no task holds a whole bucket. Within a bucket, a row whose component
already holds all the others is not compared again. Links of a batch are cut to
a spanning forest before they leave a task.

Cases: null or empty texts, and texts of white space only, have one common set;
texts under five words have the run of all their words. Letters of ASCII are
lower-cased. Very long texts are hashed in blocks. Empty tables give no links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fringework.llm.shared import forest, given_back, shuffle_width, written

RUN_WORDS = 5
BANDS, BAND_VALUES = 24, 5
SEED = 42
#: Least likeness, as a fraction of whole numbers.
ABOVE, BELOW = 4, 5

#: Members of sets that are home in a shard (8 bytes each, a few arrays of them).
SHARD_MEMBERS = 1 << 17
#: Members hashed and rows unpacked at a time.
HASHED_AT_ONCE = 1_024
ROWS_AT_ONCE = 256

_draw = np.random.default_rng(SEED)
_FACTORS = _draw.integers(0, 2**64, (BANDS * BAND_VALUES, 1), dtype=np.uint64) | np.uint64(1)
_TERMS = _draw.integers(0, 2**64, (BANDS * BAND_VALUES, 1), dtype=np.uint64)
_PLACES = _draw.integers(0, 2**64, RUN_WORDS, dtype=np.uint64) | np.uint64(1)


def members(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of a text's five-word runs."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    digest = xxhash.xxh64_intdigest
    if len(words) < RUN_WORDS:
        return np.array([digest(b" ".join(words), SEED)], np.uint64)
    hashes = np.array([digest(w, SEED) for w in words], np.uint64)
    n = len(words) - RUN_WORDS + 1
    x = np.zeros(n, np.uint64)
    for i in range(RUN_WORDS):
        x = (x ^ hashes[i : i + n]) * _PLACES[i]
        x ^= x >> np.uint64(32)
    return np.unique(x)


def bands(x: np.ndarray) -> list[int]:
    least = np.full(BANDS * BAND_VALUES, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(x), HASHED_AT_ONCE):
        np.minimum(least, (x[start : start + HASHED_AT_ONCE] * _FACTORS + _TERMS).min(axis=1), out=least)
    rows = least.reshape(BANDS, BAND_VALUES)
    return [xxhash.xxh64_intdigest(rows[b].tobytes(), b) for b in range(BANDS)]


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([members(t.as_py()).tobytes() for t in batch.column(1)], pa.binary())], names=["same", "members"])
    given_back()


class Homes:
    """The sets that are home in a shard, by member."""

    def __init__(self, ids: list[int], sets: list[np.ndarray]) -> None:
        self.ids, self.sizes = np.array(ids, np.int64), np.array([len(s) for s in sets], np.int64)
        every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(every, kind="stable")
        self.owner = owner[order]
        self.values, self.starts = np.unique(every[order], return_index=True)
        self.ends = np.r_[self.starts[1:], len(every)]

    def near(self, x: np.ndarray) -> np.ndarray:
        """Positions of the homes that link with the set ``x``."""
        at = np.minimum(np.searchsorted(self.values, x), len(self.values) - 1)
        at = at[self.values[at] == x]
        if not len(at):
            return at
        n = self.ends[at] - self.starts[at]
        places = np.repeat(self.starts[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
        common = np.bincount(self.owner[places], minlength=len(self.ids))
        return np.flatnonzero(BELOW * common >= ABOVE * (self.sizes + len(x) - common))


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links in each shard; rows come sorted by place with its homes first."""
    place, ids, sets, homes, joined = None, [], [], None, np.zeros(0, np.int64)
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []

    def link(same: int, near: np.ndarray) -> None:
        if len(near):
            near = near[np.unique(joined[near], return_index=True)[1]]  # one of each component is enough
            a.append(np.full(len(near), same, np.int64))
            b.append(homes.ids[near])
            joined[np.isin(joined, joined[near])] = joined[near].min()

    def close() -> None:
        """The homes are complete: link them with each other."""
        nonlocal homes, joined
        if homes is None and ids:
            homes, joined = Homes(ids, sets), np.arange(len(ids))
            for i, x in enumerate(sets):
                if (joined == joined[i]).all():
                    break
                link(ids[i], homes.near(x))

    def told() -> Iterator[pa.RecordBatch]:
        if a:
            x, y = forest(np.concatenate(a), np.concatenate(b))
            a.clear()
            b.clear()
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

    for batch in batches:
        for start in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(start, ROWS_AT_ONCE)
            for where, home, same, data in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if where != place:
                    close()
                    place, ids, sets, homes = where, [], [], None
                x = np.frombuffer(data, np.uint64)
                if home:
                    ids.append(same)
                    sets.append(x)
                else:
                    close()
                    if homes is not None:
                        link(same, homes.near(x))
        yield from told()
    close()
    yield from told()
    place, ids, sets, homes = None, [], [], None
    given_back()


def links(groups: DataFrame, texts: DataFrame, shard_members: int = SHARD_MEMBERS) -> DataFrame:
    """Edges (a, b) between ``groups`` (same, size, buckets), whose texts are ``texts`` (same, text)."""
    dealt = groups.select("same", "size", F.explode("buckets").alias("bucket"))
    # Near copies share most of their bands: of buckets with the same sets, told by their number and two sums of hashes, one is enough.
    its = [F.bit_xor(F.xxhash64("same")).alias("x"), F.sum(F.xxhash64(F.lit(1), "same").cast("decimal(38,0)")).alias("s")]
    held = dealt.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("all"), *its).where("n > 1")
    full = held.groupBy("n", "x", "s").agg(F.min("bucket").alias("bucket"), F.first("all").alias("all")).select("bucket", F.ceil(F.col("all") / shard_members).cast("int").alias("shards"))
    sent = written(dealt.join(full, "bucket").select("bucket", "shards", "same"), "candidates")
    wanted = sent.select("same").distinct()
    sets = written(texts.join(wanted, "same", "left_semi").select("same", "text").mapInArrow(_sets, "same long, members binary").dropDuplicates(["same"]), "sets")
    own = F.pmod(F.xxhash64("same"), "shards").cast("int")
    every = F.transform(F.sequence(F.lit(0), F.col("shards") - 1), lambda s: F.struct(s.alias("shard"), (s == own).alias("home")))
    rows = sent.join(sets, "same").select("bucket", "same", "members", F.explode(every).alias("_in"))
    placed = rows.select(F.xxhash64("bucket", "_in.shard").alias("place"), F.col("_in.home").alias("home"), "same", "members")
    width = shuffle_width(groups.sparkSession)
    return placed.repartition(width, "place").sortWithinPartitions("place", F.desc("home")).mapInArrow(_compared, "a long, b long").distinct()
