import hashlib
import random
import unicodedata

import pytest
import xxhash

from fringework.llm import fingerprints as P

SEED2 = xxhash.xxh64_intdigest((0x9E3779B97F4A7C15).to_bytes(8, "little"), 42)


def canon(text):
    text = unicodedata.normalize("NFC", unicodedata.normalize("NFC", text or "").casefold())
    for c in "\t\n\x0b\x0c\r\x85\xa0\u2003\u3000":
        text = text.replace(c, " ")
    while "  " in text:
        text = text.replace("  ", " ")
    return text.strip(" ")


def digest(text):
    data = canon(text).encode()
    return f"{xxhash.xxh64_intdigest(data, 42):016x}{xxhash.xxh64_intdigest(data, SEED2):016x}"


def documents(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, n long, fingerprint string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    groups = {}
    for r in rows:
        if r[0] is not None:
            groups[canon(r[1])] = min(r[0], groups.get(canon(r[1]), r[0]))
    for r, nxt in zip(order, order[1:] + order[:1], strict=True):
        text, following = r[1] or "", nxt[1] or ""
        k = len(text) // 3
        edited = text[: len(text) - k] + following[:k]
        a, b, c = digest(text), digest(edited), digest(following)
        out.append((r[0], len(text), hashlib.sha256(edited.encode()).hexdigest(), a, b, float(a == b), float(a == c), groups.get(canon(text))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [0, 1])
def test_against_brute_force(spark, tmp_path, monkeypatch, seed):
    rnd = random.Random(seed)
    pool = ["Ab c", "ab  c", " AB\tC ", "e\u0301t\u00e9", "\u00e9t\u00e9", "", "\u3000x\xa0y", "stra\u00dfe", "STRASSE", "\u039f\u0394\u039f\u03a3", "\u03bf\u03b4\u03bf\u03c2", "x" * 5000, "\U0001f600 a", "na\u00efve\u2003z"]
    rows = [(i, rnd.choice(pool) + rnd.choice(["", " q", "r"]), 1, "clash") for i in range(60)] + [(100, None, None, None), (None, "ab c", 0, "")]
    monkeypatch.setattr(P, "BUCKET_ROWS", 7)
    monkeypatch.setattr(P.with_next, "__defaults__", (7,))
    got = P.op10_fingerprints(spark, documents(spark, tmp_path, rows)).collect()
    got = sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next, r.copy_of) for r in got), key=repr)
    want = brute(rows)
    # A null key has no lowest key of its own to report when it is alone.
    assert got == want


def test_collisions_split_by_bytes(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(P, "hash128", lambda text: F.lit("0" * 32))
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "A"), (4, "b ")], "doc_id long, text string")
    got = {r.doc_id: (r.copy_of, r.copies, r.collided) for r in P.fingerprinted(df).collect()}
    assert got == {1: (1, 2, True), 3: (1, 2, True), 2: (2, 2, True), 4: (2, 2, True)}


def test_small_tables(spark, tmp_path):
    assert P.op10_fingerprints(spark, documents(spark, tmp_path / "none", [])).count() == 0
    (row,) = P.op10_fingerprints(spark, documents(spark, tmp_path / "one", [(5, "abcdef", 1, "")])).collect()
    assert row.near_next == 1.0 and row.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()
