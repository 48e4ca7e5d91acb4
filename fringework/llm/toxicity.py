"""Toxicity by compression distance.

Two zstandard dictionaries are trained on labelled text, one on ordinary windows
and one on passages that toxic documents hold and ordinary ones do not. Every
window of a text is compressed with the ordinary dictionary alone and with the
toxic one added to it; the bytes that the toxic one saves are the distance. The
largest, mean, total and excess saving of a text's windows make its score, whose
weights and threshold are calibrated on labelled rows that trained no dictionary.

The sample of labelled rows is bounded (``TOXIC_ROWS``, ``ORDINARY_ROWS``,
``SAMPLE_CHARS``: longer documents are not drawn), chosen by the MD5 of the key.
Scoring reads every whole text.

Cases: null and empty texts have no savings and get the score of that; labels
that are null are ignored, as are labels without a document. Without labelled
rows of both classes every score is 0. Repeated rows are scored each, a null key
too. Of two labels for one key the higher counts. Very long texts are scored by
all their windows. Extra columns are ignored (``kept`` carries them along),
whatever their names. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fringework.llm.shared import free_names, given_back, table, text_or_empty

TOXIC_ROWS, ORDINARY_ROWS, SAMPLE_CHARS = 1_500, 3_000, 20_000
#: Share of the sample that trains dictionaries; the rest calibrates.
DICTIONARY_SHARE = 0.65

WINDOW, STRIDE = 256, 240
ORDINARY_BYTES, TOXIC_BYTES = 16_384, 2_048

#: A piece is a beginning of a word of these lengths (bytes).
SHORTEST, LONGEST = 4, 14
#: Least documents that hold a piece: so many, and this share of the toxic ones.
PIECE_DOCS, PIECE_SHARE = 4, 0.03
#: Least ratio of a piece's rates in toxic and ordinary documents, two standard errors to the bad.
PIECE_LIFT = 4.0
_EDGES = b".,!?;:\"'()[]{}<>*#$%&-_"

THRESHOLD = 0.3


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string")) % 4 == 2


def windows(data: bytes) -> list[bytes]:
    return [data[i : i + WINDOW] for i in range(0, max(1, len(data) - (WINDOW - STRIDE)), STRIDE)]


def _pieces(data: bytes) -> set[bytes]:
    words = {w.strip(_EDGES)[:LONGEST] for w in data.split()}
    return {w[:n] for w in words for n in range(SHORTEST, len(w) + 1)}


def telling_pieces(toxic: list[bytes], ordinary: list[bytes]) -> dict[bytes, float]:
    """Pieces that stand in toxic texts far oftener than in ordinary ones, with a weight."""
    starts = Counter(p for t in toxic for p in _pieces(t))
    least = max(PIECE_DOCS, PIECE_SHARE * len(toxic))
    against = Counter(p for t in ordinary for p in _pieces(t) if starts.get(p, 0) >= least)
    rate = lambda n, of, by: max(0.0, n + by * 2 * math.sqrt(n) + (by > 0)) / of
    likely = [p for p, n in starts.items() if n >= least and rate(n, len(toxic), -1) >= PIECE_LIFT * rate(against[p], len(ordinary), 1)]
    out = {}
    for p in likely:  # matches do not heed where a word begins, so count them anywhere
        n, m = sum(p in t for t in toxic), sum(p in t for t in ordinary)
        if rate(n, len(toxic), -1) >= PIECE_LIFT * rate(m, len(ordinary), 1):
            out[p] = n * math.sqrt(len(p))
    return out


def _trained(size: int, samples: list[bytes]) -> bytes:
    """A trained dictionary, or the samples' own bytes where there are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


def _compressor(content: bytes) -> zstandard.ZstdCompressor | None:
    # A target length in the fast strategy leaves literals as they are, so only matches save bytes.
    params = zstandard.ZstdCompressionParameters.from_level(
        3, source_size=WINDOW, dict_size=len(content), min_match=5, hash_log=17, window_log=17, strategy=zstandard.STRATEGY_FAST, target_length=1, write_content_size=False, write_checksum=False, write_dict_id=False
    )
    kind = zstandard.DICT_TYPE_FULLDICT if content[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    data = zstandard.ZstdCompressionDict(content, dict_type=kind) if len(content) >= 8 else None
    return zstandard.ZstdCompressor(dict_data=data, compression_params=params)


@dataclass
class Model:
    """Dictionaries and calibrated weights; a few tens of kilobytes whatever the corpus."""

    ordinary: bytes
    toxic: bytes
    means: list[float]
    scales: list[float]
    weights: list[float]
    shift: float = 0.0

    def savings(self) -> Callable[[bytes], np.ndarray]:
        plain, both = _compressor(self.ordinary).compress, _compressor(self.ordinary + self.toxic).compress
        return lambda data: np.array([len(plain(w)) - len(both(w)) for w in windows(data)])

    def scorer(self) -> Callable[[str | None], float]:
        if not self.weights:
            return lambda text: 0.0
        saved = self.savings()
        means, scales, weights = np.array(self.means), np.array(self.scales), np.array(self.weights)

        def score(text: str | None) -> float:
            x = (features(saved((text or "").lower().encode("utf-8", "replace"))) - means) / scales
            z = float(weights[0] + x @ weights[1:]) + self.shift
            return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))

        return score


def features(saved: np.ndarray) -> np.ndarray:
    over = np.maximum(saved - 2, 0)
    n = len(saved)
    return np.array([
        min(saved.max(), 12), min(saved.mean(), 6), math.log1p(max(0, saved.sum())),
        math.log1p(over.sum()), (saved >= 4).mean(), math.log1p((saved >= 6).sum()), math.log(n), (saved >= 1).mean(),
    ])


def _logistic(x: np.ndarray, y: np.ndarray, share: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (share * p * (1 - p))[:, None]) + penalty, x.T @ (share * (y - p)) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _best_cut(p: np.ndarray, y: np.ndarray, share: np.ndarray) -> float:
    """The score from which on rows count as toxic that gives the best F1."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum((y * share)[order])
    f1 = 2 * hits / (np.cumsum(share[order]) + (y * share).sum())
    f1[:-1][p[order][:-1] == p[order][1:]] = 0  # a cut does not part ties
    at = int(np.argmax(f1))
    return float(p[order][at] if at + 1 >= len(p) else (p[order][at] + p[order][at + 1]) / 2)


def fitted(sample: list[tuple[str, int]], ordinary_share: float = 1.0) -> Model:
    """A model from (text, label) in an order that does not depend on the label.

    ``ordinary_share``: labelled ordinary rows for each drawn one, over the same for toxic rows.
    """
    rows = [((t or "").lower().encode("utf-8", "replace"), y) for t, y in sample]
    cut = int(len(rows) * DICTIONARY_SHARE)
    part, rest = rows[:cut], rows[cut:]
    # Copies count once, else a group of them would look like a telling passage.
    toxic, ordinary = (list(dict.fromkeys(t for t, y in part if y == c)) for c in (1, 0))
    if not toxic or not ordinary or len({y for _, y in rest}) < 2:
        return Model(b"", b"", [], [], [])
    telling = telling_pieces(toxic, ordinary)

    def core(word: bytes) -> bytes | None:
        found = [word[:n] for n in range(SHORTEST, len(word) + 1) if word[:n] in telling]
        return max(found, key=lambda p: (telling[p], p)) if found else None

    # The zero byte keeps matches from running over two passages.
    passages = [b"\0 " + c for t in toxic for w in t.split() if (c := core(w.strip(_EDGES)[:LONGEST]))]
    runs = [b"".join(passages[i::-(-len(passages) // 8)]) for i in range(-(-len(passages) // 8))]
    every = [w for t in ordinary for w in windows(t)]
    model = Model(_trained(ORDINARY_BYTES, every[:: max(1, len(every) // 12_000)]), _trained(TOXIC_BYTES, runs), [], [], [])
    saved = model.savings()
    x, y = np.array([features(saved(t)) for t, _ in rest]), np.array([y for _, y in rest], float)
    means, scales = x.mean(axis=0), x.std(axis=0) + 1e-6
    share = np.where(y == 1, 1.0, ordinary_share)
    weights = _logistic((x - means) / scales, y, share)
    p = 1 / (1 + np.exp(-np.column_stack([np.ones(len(x)), (x - means) / scales]) @ weights))
    logit = lambda v: math.log(min(max(v, 1e-6), 1 - 1e-6) / (1 - min(max(v, 1e-6), 1 - 1e-6)))
    model.means, model.scales, model.weights = means.tolist(), scales.tolist(), weights.tolist()
    model.shift = logit(THRESHOLD) - logit(_best_cut(p, y, share))
    return model


def training_sample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> tuple[list[tuple[str, int]], float]:
    """The bounded sample in the order of the key's MD5, and the weight of its ordinary rows; held-out rows never enter."""
    told = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(F.col(key))).groupBy(key).agg(F.max(label).alias("_y"))
    total = {r["_y"]: r["count"] for r in told.groupBy("_y").count().collect()}
    most = {1: TOXIC_ROWS, 0: ORDINARY_ROWS}
    order = F.md5(F.col(key).cast("string"))
    # Of n rows those whose MD5 lies in the lowest share most / n are drawn: about as many as wanted, so they may be broadcast.
    place = F.conv(F.substring("_o", 1, 13), 16, 10).cast("double") / float(1 << 52)
    share = {y: min(1.0, m / max(1, total.get(y, 0))) for y, m in most.items()}
    drawn = told.withColumn("_o", order).where(place < F.when(F.col("_y") == 1, share[1]).otherwise(share[0]))
    rows = docs.where(F.length(text) <= SAMPLE_CHARS).select(key, F.col(text).alias("_t")).join(F.broadcast(drawn), key)
    # One text a key, however often the key stands in the table.
    got = sorted((r["_o"], r["_t"], r["_y"]) for r in rows.groupBy(key, "_o", "_y").agg(F.min("_t").alias("_t")).collect())
    sample = [[(o, t, y) for o, t, y in got if y == c][: most[c]] for c in (1, 0)]
    per = [total.get(c, 0) / max(1, len(part)) for c, part in zip((1, 0), sample, strict=True)]
    return [(t, y) for _, t, y in sorted(sample[0] + sample[1])], per[1] / max(per[0], 1e-9)


def scored(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", *more: str) -> DataFrame:
    """key, any columns in ``more``, score: a row per row of ``docs``."""
    held, made = free_names([key, *more], "text", "score")
    inputs = docs.select(F.col(key), *more, text_or_empty(text).alias(held))
    outputs = inputs.drop(held).withColumn(made, F.lit(0.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            values = pa.array([score(t.as_py()) for t in batch.column(batch.num_columns - 1)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], values], names=[*batch.schema.names[:-1], made])
        given_back()

    return inputs.mapInArrow(run, outputs.schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fitted(*training_sample(docs, table(spark, sf_dir, "labels")))
    rows = scored(docs, model)
    return rows.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def kept(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that score as toxic; one pass, the texts do not move."""
    model = fitted(*training_sample(docs, labels, key, text))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        at = names.index(text)
        for batch in batches:
            clean = pa.array([score(t.as_py()) < THRESHOLD for t in batch.column(at)], pa.bool_())
            yield batch.filter(clean)

    return docs.mapInArrow(run, docs.schema)


QUERIES = {"op8_toxicity": op8_toxicity}
#: Compression lengths have no SQL; the tests hold it to held-out accuracy.
ORACLE_SQL: dict[str, str] = {}
