"""The corpus pipeline: toxicity, near duplicates, mixing, tokens.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a table that is written as Parquet and read again as the next one's docs.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fringework.llm import bpe, mixing, simhash, toxicity
from fringework.llm.shared import dropped, free_names, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; the labels that train the score are those of ``sf_dir``."""
    return toxicity.kept(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word runs, likeness of at least 0.8) stays, the one with the least id."""
    return simhash.kept(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn so that sources, languages and topics meet their tempered shares."""
    return mixing.mixed(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids, their number and the digests of ids and decoded text."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    # What else the rows hold travels as one column, so that no name of theirs meets one made here.
    held = docs.select("doc_id", "text", F.struct(F.lit(0).alias("nothing"), *others).alias("row"))
    rows = bpe.digested(bpe.coded(held, bpe.prepared(held), more=("row",)).withColumn("tokens", F.col("token_ids")))
    made = ("tokens", "n_tokens", "ids_sha256", "decoded_sha256")
    return rows.select("doc_id", *(F.col(f"row.`{c}`") for c in others), *(F.col(c).alias(n) for c, n in zip(made, free_names(docs.columns, *made), strict=True)))


#: In this order; each works on all that the one before kept.
STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode_tokens),
]

#: Compression lengths, MinHash bands and BPE have no SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if last is not None:
            dropped(spark, last)
        last = docs
    return docs
