"""Canonical exact fingerprints of documents.

A text is canonicalised (Unicode NFC and full case folding by the ICU library that
Spark ships, runs of white space to one space, ends trimmed) and hashed to 128 bits:
XXH64 of the canonical text with two seeds. Documents group by the hash, and the
canonical bytes are compared inside every bucket of two or more. Only DataFrame
functions are used.

Cases: a null text counts as empty; a null key is the lowest key and is kept;
repeated rows each keep an output row, ties in the key are ordered by the text.
An empty table gives no rows. Other columns of the input are ignored, whatever
their names. Very long texts are canonicalised and hashed whole. Keys are whole
numbers where the next document is asked for, else of any type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fringework.llm.shared import table, text_or_empty, written

#: White space that folds to a space: the ASCII controls, and beyond ASCII the Unicode property White_Space.
_ASCII_SPACE = r"[\x09-\x0d]"
_WIDE_SPACE = r"[\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: A short superset of it, for a quick look.
_MAYBE_WIDE = r"[\x{85}\x{a0}\x{1680}-\x{3000}]"

#: Put before the text for the second half of the hash; it acts as another seed.
_SECOND_SEED = 0x9E3779B97F4A7C15 - (1 << 64)

#: Documents per bucket of the key order; a bucket is sorted by one task and spills if it must.
BUCKET_ROWS = 1_024

#: Keys of repeated hashes may be broadcast up to this many (16 bytes each, so 4 MB).
BROADCAST_KEYS = 250_000


def with_canonical(df: DataFrame, text: Column, name: str = "_canonical") -> DataFrame:
    """``df`` with the canonical text: NFC, case folded (and NFC again, which folding may undo), white space folded.

    The steps are columns of their own, so each is made once for a row. ASCII is
    in NFC already and has no wide space; only other texts take those steps.
    """
    narrow = F.octet_length(text) == F.length(text)
    composed = lambda t: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), t, F.lit(False))
    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), composed(text), F.lit(True))
    out = df.withColumn(name, F.when(narrow, F.lower(text)).otherwise(composed(folded)))
    out = out.withColumn(name, F.regexp_replace(name, _ASCII_SPACE, " "))
    wide = (F.octet_length(name) != F.length(name)) & F.col(name).rlike(_MAYBE_WIDE)
    out = out.withColumn(name, F.when(wide, F.regexp_replace(name, _WIDE_SPACE, " ")).otherwise(F.col(name)))
    return out.withColumn(name, F.trim(F.when(F.contains(name, F.lit("  ")), F.regexp_replace(name, " {2,}", " ")).otherwise(F.col(name))))


def hash128(text: Column) -> Column:
    """32 lower-case hex digits of two XXH64 with different seeds."""
    first, second = F.xxhash64(text), F.xxhash64(F.lit(_SECOND_SEED), text)
    return F.concat(*(F.lpad(F.lower(F.hex(h)), 16, "0") for h in (first, second)))


def with_fingerprint(df: DataFrame, text: Column, name: str = "fingerprint") -> DataFrame:
    """``df`` with the fingerprint of ``text``; the canonical text is a column of its own, so it is made once."""
    return with_canonical(df, text).withColumn(name, hash128(F.col("_canonical"))).drop("_canonical")


def _bucket(key: str, cuts: list[int]) -> Column:
    """Number of cuts below the key, by a search in two steps; 0 for a null key."""
    step = max(1, int(len(cuts) ** 0.5))
    below = lambda c: c < F.col(key)
    whole = F.array(*map(F.lit, cuts))
    coarse = F.size(F.filter(F.array(*(F.lit(c) for c in cuts[::step])), below))
    start = F.greatest(coarse - 1, F.lit(0)) * step
    return start + F.size(F.filter(F.slice(whole, start + 1, F.lit(step)), below))


def with_next(df: DataFrame, key: str, carried: list[str], bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``df`` with ``next_<c>`` of each carried column, from the row that follows by descending key (after the last: the first).

    The integer keys are cut into buckets at approximate quantiles, so every row
    moves once and no task gets them all. A cut is the highest key of the bucket
    below it; rows at a cut also go to the bucket above, where they end the
    order and lend their values. Ties in the key are ordered by the carried
    columns; a null key is the lowest.
    """
    stats = df.agg(F.count("*").alias("n"), F.max(key).alias("top")).first()
    wanted = min(10_000, -(-stats["n"] // bucket_rows))
    cuts: list[int] = []
    if wanted > 1:
        shares = [i / wanted for i in range(1, wanted)]
        cuts = sorted(set(df.agg(F.percentile_approx(key, shares, 10 * wanted)).first()[0] or []) - {stats["top"]})
    lowest = F.lit(0)
    own = _bucket(key, cuts) if cuts else lowest
    # What a row adds to its own bucket: a ghost in the bucket above if at a cut, one in the lowest if at the top.
    lends = F.array(
        F.struct(own.alias("bucket"), F.lit(0).alias("ghost")),
        F.struct((own + 1).alias("bucket"), F.when(F.col(key).isin(*cuts), 1).alias("ghost")) if cuts else F.struct(lowest.alias("bucket"), F.lit(None).cast("int").alias("ghost")),
        F.struct(lowest.alias("bucket"), F.when(F.col(key).eqNullSafe(F.lit(stats["top"])), 2).alias("ghost")),
    )
    placed = df.withColumn("_at", F.explode(F.filter(lends, lambda x: x["ghost"].isNotNull())))
    order = Window.partitionBy("_at.bucket").orderBy(F.col("_at.ghost"), F.col(key).desc_nulls_last(), *carried)
    return placed.select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in carried)).where("_at.ghost = 0").drop("_at")


def copies(df: DataFrame, prints: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each hash that two or more rows share: fingerprint, canonical, copy_of, copies.

    ``prints`` holds the fingerprint of every row of ``df``. Only rows whose hash
    repeats are read for their canonical text, and grouping by that text compares
    the bytes; equal texts collapse before they move, however many they are.
    """
    repeated = written(prints.groupBy("fingerprint").count().where("count > 1").select("fingerprint"), "repeated-hashes")
    if repeated.count() <= BROADCAST_KEYS:
        repeated = F.broadcast(repeated)
    canon = with_canonical(df.select(F.col(key).alias("_key"), text_or_empty(text).alias("_text")), F.col("_text"), "canonical").withColumn("fingerprint", hash128(F.col("canonical")))
    return canon.join(repeated, "fingerprint", "left_semi").groupBy("fingerprint", "canonical").agg(F.min("_key").alias("copy_of"), F.count("*").alias("copies"))


def fingerprinted(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per row of ``df``: key, fingerprint, copy_of (lowest key with the same canonical bytes), copies, collided."""
    rows = with_fingerprint(df.select(F.col(key).alias(key), text_or_empty(text).alias("_text")), F.col("_text")).drop("_text")
    return with_copies(df, rows, key, text)


def with_copies(df: DataFrame, rows: DataFrame, key: str, text: str) -> DataFrame:
    """``rows`` (key, fingerprint, ...) with copy_of, copies and collided."""
    groups = written(copies(df, rows.select("fingerprint"), key, text), "equal-bytes")
    by_hash = groups.groupBy("fingerprint").agg(F.count("*").alias("_texts"), F.min("copy_of").alias("copy_of"), F.sum("copies").alias("copies"))
    by_hash = written(by_hash, "hash-groups")
    plain = rows.join(by_hash, "fingerprint", "left")
    alone = F.col("copies").isNull()
    out = plain.withColumn("copy_of", F.when(alone, F.col(key)).otherwise(F.col("copy_of"))).withColumn("copies", F.coalesce("copies", F.lit(1)))
    if by_hash.where("_texts > 1").isEmpty():
        return out.drop("_texts").withColumn("collided", F.lit(False))
    # Different texts under one hash: those rows take their group from the text itself.
    single = out.where("coalesce(_texts, 1) = 1").drop("_texts").withColumn("collided", F.lit(False))
    torn = by_hash.where("_texts > 1").select("fingerprint")
    own = with_canonical(df.select(F.col(key).alias("_k"), text_or_empty(text).alias("_text")), F.col("_text"), "canonical").withColumn("fingerprint", hash128(F.col("canonical")))
    own = own.join(torn, "fingerprint", "left_semi").join(groups, ["fingerprint", "canonical"]).select(F.col("_k").alias(key), "fingerprint", "copy_of", "copies").dropDuplicates()
    split = rows.join(own, (rows[key].eqNullSafe(own[key])) & (rows["fingerprint"] == own["fingerprint"])).drop(own[key]).drop(own["fingerprint"])
    return single.unionByName(split.withColumn("collided", F.lit(True)))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    own = with_fingerprint(docs.select("doc_id", text_or_empty().alias("text")), F.col("text"))
    rows = with_next(own, "doc_id", ["text", "fingerprint"]).withColumn("n_chars", F.length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - cut), F.substring("next_text", F.lit(1), cut))
    same = lambda a: (F.col("fingerprint") == F.col(a)).cast("double")
    rows = with_fingerprint(rows.withColumn("edited", edited), F.col("edited"), "edited_fingerprint")
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "next_fingerprint")
    rows = written(rows, "fingerprints")
    rows = rows.withColumn("near_edited", same("edited_fingerprint")).withColumn("near_next", same("next_fingerprint")).drop("next_fingerprint")
    return with_copies(docs, rows, "doc_id", "text")


QUERIES = {"op10_fingerprints": op10_fingerprints}
#: DuckDB has no XXH64 with a seed, so this query is tested against a brute-force version.
ORACLE_SQL: dict[str, str] = {}
