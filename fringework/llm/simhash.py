"""SimHash near-duplicates by anchor points of a covering code.

Fingerprints have 64 bits, and two link when at most two bits differ. Anchors are
the words of a code that covers the space: two copies of the perfect Golay code
(23 bits, radius 3) beside 18 bits that have one word only. A fingerprint's home
is the anchor that its two blocks decode to. It is also sent to every anchor it
can reach when two bits change: block distances of at most the covering radius
plus the threshold, the excess over the radius summed over both blocks. If u and
v differ in two bits or fewer, v is sent to the home of u, so comparing the homes
with the rest at every anchor finds every link: 2**24 anchors, about 61 copies of
a distinct fingerprint.

Equal fingerprints are one row before anything is sent, links of a batch are cut
to a spanning forest before they leave a task, and anchors that are home to many
are dealt in shards, so no task gets a whole group.

Cases: null or empty texts, and texts of white space only, have fingerprint zero
and link like any other. Rows that repeat have equal fingerprints. A null key
never becomes a component's id unless its group has no other. Extra columns are
ignored (``kept`` carries them along, whatever their names). Very long texts are
hashed in blocks of shingles. Keys of ``near_duplicates`` are whole numbers, those
of ``kept`` of any type with an order. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fringework.operators.graph import components
from fringework.llm import jaccard
from fringework.llm.shared import forest, free_names, given_back, shuffle_width, table, text_or_empty, written

SHINGLE_WORDS = 3
SEED = 42
THRESHOLD = 2

#: Bits and covering radius of a block; the generator polynomial of its code, lowest power last.
BLOCK_BITS, RADIUS = 23, 3
GENERATOR = 0b101011100011

#: Homes per shard of an anchor: a task compares so many with what is sent there.
SHARD_HOMES = 2_048
#: Anchors that need shards may be broadcast up to this many (16 bytes each).
BROADCAST_ANCHORS = 100_000
#: Pairs compared at a time in a task (8 bytes for each of a few arrays).
PAIRS_AT_ONCE = 1 << 21
#: Shingles counted at a time.
SHINGLES_AT_ONCE = 1 << 15


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash: a bit is set if it is in over half of the shingles' XXH64."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE_WORDS:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    ones, total = np.zeros(64, np.int64), len(words) - SHINGLE_WORDS + 1
    for start in range(0, total, SHINGLES_AT_ONCE):
        part = words[start : start + SHINGLES_AT_ONCE + SHINGLE_WORDS - 1]
        runs = zip(*(part[i:] for i in range(SHINGLE_WORDS)), strict=False)
        hashes = np.array([digest(join(run), SEED) for run in runs], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += np.add.reduce(bits, axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(ones * 2 > total, bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every column but the last, and the fingerprint of the last."""
    for batch in batches:
        values = np.fromiter((fingerprint(t.as_py()) for t in batch.column(batch.num_columns - 1)), dtype=np.uint64, count=batch.num_rows)
        names = [*batch.schema.names[:-1], "fp"]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(values.view(np.int64))], names=names)


def signatures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, row, fp): ``row`` tells apart different texts that share a key."""
    rows = docs.select(F.col(key).cast("long").alias(key), F.xxhash64(text_or_empty(text)).alias("row"), text_or_empty(text).alias("_text"))
    return rows.mapInArrow(_fingerprints, f"{key} long, row long, fp long")


@cache
def code_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Syndromes of the low and high part of a block; for each excess, the error patterns by syndrome."""
    low = 12

    def syndrome(v: int) -> int:
        for bit in range(BLOCK_BITS - 1, 10, -1):
            if v >> bit & 1:
                v ^= GENERATOR << (bit - 11)
        return v

    single = [syndrome(1 << b) for b in range(BLOCK_BITS)]

    def spread(first: int, count: int) -> np.ndarray:
        out = np.zeros(1 << count, np.int64)
        for b in range(count):
            out[1 << b : 2 << b] = out[: 1 << b] ^ single[first + b]
        return out

    by_excess = []
    for excess in range(THRESHOLD + 1):
        weights = range(RADIUS + 1) if excess == 0 else (RADIUS + excess,)
        patterns = np.array([sum(1 << b for b in c) for w in weights for c in combinations(range(BLOCK_BITS), w)], dtype=np.int64)
        of = spread(0, low)[patterns & ((1 << low) - 1)] ^ spread(low, BLOCK_BITS - low)[patterns >> low]
        order = np.argsort(of, kind="stable")
        counts = np.bincount(of, minlength=2048)
        by_excess.append((patterns[order], np.cumsum(counts) - counts, counts))
    return spread(0, low), spread(low, BLOCK_BITS - low), np.array(single), by_excess


def anchors(fps: np.ndarray, homes_only: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position in ``fps``, anchor, home) for all that each fingerprint is sent to."""
    low, high, _, by_excess = code_tables()
    v = fps.astype(np.uint64)
    mask = np.uint64((1 << BLOCK_BITS) - 1)
    blocks = [(v >> np.uint64(BLOCK_BITS * i) & mask).astype(np.int64) for i in range(2)]
    syndromes = [low[b & 4095] ^ high[b >> 12] for b in blocks]
    sent = []
    for a in range(THRESHOLD + 1):
        for b in range(THRESHOLD + 1 - a):
            if homes_only and a + b:
                continue
            (pa_, start_a, count_a), (pb, start_b, count_b) = by_excess[a], by_excess[b]
            na, nb = count_a[syndromes[0]], count_b[syndromes[1]]
            each = na * nb
            at = np.repeat(np.arange(len(v)), each)
            j = np.arange(len(at)) - np.repeat(np.cumsum(each) - each, each)
            wide = nb[at]
            first = blocks[0][at] ^ pa_[start_a[syndromes[0]][at] + j // wide]
            second = blocks[1][at] ^ pb[start_b[syndromes[1]][at] + j % wide]
            sent.append((at, first << BLOCK_BITS | second, np.full(len(at), a + b == 0)))
    return tuple(np.concatenate(x) for x in zip(*sent, strict=True))


def _sent(homes_only: bool):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False)
            for start in range(0, len(every), 2048):
                fps = every[start : start + 2048]
                at, anchor, home = anchors(fps.view(np.uint64), homes_only)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fps[at]), pa.array(home)], names=["anchor", "fp", "home"])

    return send


def _near(home: np.ndarray, counts: np.ndarray, starts: np.ndarray, rest: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of each home with ``counts`` entries of ``rest`` from ``starts`` on."""
    ends = np.cumsum(counts)
    at = 0
    while at < len(home):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS_AT_ONCE, side="right")))
        n, skip = counts[at:upto], 0
        # A single home with very many partners is compared in slices.
        while upto == at + 1 and n[0] - skip > PAIRS_AT_ONCE:
            part = rest[starts[at] + skip : starts[at] + skip + PAIRS_AT_ONCE]
            yield _linked(np.full(len(part), home[at]), part)
            skip += PAIRS_AT_ONCE
        i = np.repeat(np.arange(at, upto), n - skip)
        j = np.arange(len(i)) - np.repeat(np.cumsum(n - skip) - (n - skip), n - skip) + starts[i] + skip
        yield _linked(home[i], rest[j])
        at = upto


def _linked(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    far = np.bitwise_count((a ^ b).view(np.uint64))
    near = (far <= THRESHOLD) & (far > 0)
    return forest(a[near], b[near]) if near.any() else (a[:0], b[:0])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links at each anchor; rows come sorted by place with its homes first.

    Only the homes of the last place are held from one batch to the next.
    """
    last, held = None, np.zeros(0, np.int64)
    for batch in batches:
        place, fp, home = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if not len(place):
            continue
        edges = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        lengths = np.diff(np.r_[edges, len(place)])
        run = np.repeat(np.arange(len(edges)), lengths)
        found = []
        if last is not None and place[0] == last and len(held):
            n = int(lengths[0])
            found += _near(held, np.full(len(held), n), np.zeros(len(held), np.int64), fp[:n])
        h = np.flatnonzero(home & (lengths[run] > 1))
        found += _near(fp[h], lengths[run[h]], edges[run[h]], fp)
        tail = fp[edges[-1] :][home[edges[-1] :]]
        held = np.concatenate([held, tail]) if last is not None and place[-1] == last else tail.copy()
        last = place[-1]
        if found:
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            if len(a):
                a, b = forest(a, b)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def links(fps: DataFrame, shard_homes: int = SHARD_HOMES) -> DataFrame:
    """Edges (a, b) whose components are those of all links between the distinct fingerprints ``fps`` (fp)."""
    sent_schema = "anchor long, fp long, home boolean"
    homes = fps.mapInArrow(_sent(True), sent_schema)
    hot = written(homes.groupBy("anchor").count().where(F.col("count") > shard_homes).select("anchor", F.ceil(F.col("count") / shard_homes).cast("int").alias("shards")), "hot-anchors")
    n_hot = hot.count()
    sent = fps.mapInArrow(_sent(False), sent_schema)
    shard = F.lit(0)
    if n_hot:
        sent = sent.join(F.broadcast(hot) if n_hot <= BROADCAST_ANCHORS else hot, "anchor", "left")
        own = F.pmod(F.xxhash64("fp"), F.coalesce("shards", F.lit(1))).cast("int")
        # A home stands in one shard as such, and in all as one that is sent there.
        every = F.transform(F.sequence(F.lit(0), F.coalesce("shards", F.lit(1)) - 1), lambda s: F.struct(s.alias("shard"), (F.col("home") & (s == own)).alias("home")))
        sent = sent.select("anchor", "fp", F.explode(every).alias("_in")).select("anchor", "fp", F.col("_in.home").alias("home"), F.col("_in.shard").alias("shard"))
        shard = F.col("shard")
    place = F.shiftleft("anchor", 17).bitwiseOR(shard.cast("long"))
    width = shuffle_width(fps.sparkSession)
    dealt = sent.select(place.alias("place"), "fp", "home").repartition(width, "place").sortWithinPartitions("place", F.desc("home"))
    return dealt.mapInArrow(_compared, "a long, b long").distinct()


def grouped(signed: DataFrame, key: str = "doc_id") -> DataFrame:
    """(fp, component, component_id) of every distinct fingerprint of ``signed`` (key, fp)."""
    groups = written(signed.groupBy("fp").agg(F.min(key).alias("least")), "fingerprint-groups")
    joined = written(components(links(groups.select("fp"))), "components")
    member = joined.join(groups.withColumnRenamed("fp", "node"), "node")
    ids = member.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = written(joined.join(ids, "component").select(F.col("node").alias("fp"), "component", "component_id"), "component-ids")
    alone = F.col("component").isNull()
    out = groups.join(linked, "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"), F.when(alone, F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    return written(out, "groups")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per row of ``docs``: key, row, fp, component (least fingerprint), component_id (least key)."""
    signed = written(signatures(docs, key, text), "signatures")
    return signed.join(grouped(signed, key), "fp").select(key, "row", "fp", "component", "component_id")


def fingerprint_of(hashes: np.ndarray) -> int:
    """The SimHash of a set of hashes."""
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), SHINGLES_AT_ONCE):
        bits = np.unpackbits(hashes[start : start + SHINGLES_AT_ONCE].view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += np.add.reduce(bits, axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def _signed_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In place of the text: the id and size of its set of five-word runs, its MinHash bands and its SimHash."""
    names = ["same", "size", "bands", "fp"]
    for batch in batches:
        ids, sizes, found, fps = [], [], [], []
        for text in batch.column(2):
            x = jaccard.members(text.as_py())
            ids.append(xxhash.xxh64_intdigest(x.tobytes()))
            sizes.append(len(x))
            found.append(np.array(jaccard.bands(x), np.uint64).view(np.int64))
            fps.append(fingerprint_of(x))
        columns = [*batch.columns[:2], pa.array(np.array(ids, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int64())), pa.array(np.array(fps, np.uint64).view(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:2], *names])
    given_back()


def kept(docs: DataFrame, key: str = "doc_id", text: str = "text", shard_members: int = jaccard.SHARD_MEMBERS) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the one with the least key (a null key last), then the least text hash.

    Here texts link when their sets of five-word runs have a likeness of at least
    0.8. The anchors propose the sets whose SimHash differs in two bits or fewer;
    since most pairs at 0.8 differ in more, MinHash bands propose further ones,
    and every proposed pair is compared by its whole sets.
    """
    row = F.xxhash64(text_or_empty(text))
    inputs = docs.select(F.col(key).alias("_key"), row.alias("_row"), text_or_empty(text).alias("_text"))
    kind = inputs.schema["_key"].dataType.simpleString()
    signed = written(inputs.mapInArrow(_signed_sets, f"_key {kind}, _row long, same long, size long, bands array<long>, fp long"), "set-signatures")
    first = F.min(F.struct(F.col("_key").isNull().alias("none"), "_key", "_row"))
    sets = written(signed.groupBy("same").agg(F.first("size").alias("size"), F.first("bands").alias("bands"), F.first("fp").alias("fp"), first.alias("first")), "set-groups")
    near = written(components(links(sets.select("fp").distinct())), "fingerprint-components")
    # Sets of one fingerprint component are a bucket like those of a band.
    placed = sets.join(near.withColumnRenamed("node", "fp"), "fp", "left").select("same", "size", "first", F.array_append("bands", F.xxhash64(F.lit("simhash"), F.coalesce("component", "fp"))).alias("buckets"))
    placed = written(placed, "placed-sets")
    told = placed.select("same", F.col("first._row").alias("_row"))
    # A text has one set, so its hash alone finds it.
    texts = inputs.join(told, "_row").select("same", F.col("_text").alias("text"))
    joined = written(components(jaccard.links(placed.select("same", "size", "buckets"), texts, shard_members)), "set-components")
    whole = placed.select("same", "first").join(joined, placed["same"] == joined["node"], "left").groupBy(F.coalesce("component", "same").alias("component")).agg(F.min("first").alias("first"))
    its_row, its_key = free_names(docs.columns, "row", "key")
    # Both are never null, so the join and what drops repeated rows share one exchange of the texts.
    keys = written(whole.select(F.col("first._row").alias(its_row), F.xxhash64(F.col("first._key").isNull(), F.col("first._key")).alias(its_key)), "kept-keys")
    mine = docs.withColumns({its_row: row, its_key: F.xxhash64(F.col(key).isNull(), F.col(key))})
    return mine.join(keys, [its_row, its_key], "left_semi").dropDuplicates([its_row, its_key]).select(*docs.columns)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op1_simhash": op1_simhash}
#: DuckDB has no XXH64 with a seed, so this query is tested against a brute-force version.
ORACLE_SQL: dict[str, str] = {}
