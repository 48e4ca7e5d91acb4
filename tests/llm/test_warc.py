import hashlib
import io
import random

import pytest
import zstandard

from fringework.llm import warc as W


def brute(rows):
    first = {}
    for page, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 100 and page is not None:
            first[data] = min(page, first.get(data, page))
    for page, _, html in rows:
        data = (html or "").encode()
        to = first.get(data)
        revisit = to is not None and to != page
        yield (page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", to if revisit else None)


def test_query_against_brute_force(spark, tmp_path):
    rnd = random.Random(0)
    pool = ["<p>" + " ".join(rnd.choice(["alpha", "beta", "gämma", "delta"]) for _ in range(n)) for n in (1, 10, 60, 300)] + ["", "x" * 99, "x" * 100, "\r\n\r\nWARC/1.1\r\n" * 20, "\0" * 200]
    rows = [(i, f"http://h/{i}", rnd.choice(pool)) for i in range(300)] + [(1000, None, None), (None, "u\r\nX-Page-Id: 5", pool[3]), (7, "again", pool[3]), (2000, "long", "lorem ipsum " * 200_000)]
    spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in W.op4_warc(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr)


def test_archive_holds_a_dictionary_and_single_frames():
    records = [W.record(str(i), "http://x/é\n", "response", (f"<html><body>page {i} of the archive </body></html>" * 5).encode(), "d" * 64, 5, None) for i in range(200)]
    data = W.archive(records)
    assert data[:4] == W.SKIPPABLE
    content = zstandard.ZstdDecompressor().decompress(data[8 : 8 + int.from_bytes(data[4:8], "little")])
    assert content[:4] == W.DICTIONARY
    assert list(W.records_of(io.BytesIO(data))) == records
    alone = b"".join(zstandard.ZstdCompressor(level=W.LEVEL).compress(r) for r in records)
    assert len(data) < len(alone)
    headers, payload = W.parsed(records[3])
    assert headers["WARC-Target-URI"] == "http://x/é%0a" and payload.startswith(b"<html>")


def test_few_records_need_no_dictionary_and_damage_is_found():
    few = [W.record("1", "u", "response", b"", hashlib.sha256(b"").hexdigest(), 0, None)]
    data = W.archive(few)
    assert data[:4] == W.FRAME and list(W.records_of(io.BytesIO(data))) == few
    with pytest.raises(ValueError):
        list(W.records_of(io.BytesIO(data[:-3])))
    with pytest.raises(ValueError):
        W.parsed(few[0][:-1])
    assert W.archive([]) == b"" and list(W.records_of(io.BytesIO(b""))) == []


def test_archives_roll_over(spark, tmp_path):
    rows = spark.createDataFrame([(i, "u", "y" * 1000 + str(i)) for i in range(50)], "page_id long, url string, html string").coalesce(1)
    listed = W.archives(W.with_references(rows, "page_id", "url", "html"), f"file://{tmp_path}/a", most=10_000).collect()
    assert len(listed) > 4 and sum(r.records for r in listed) == 50 and all((tmp_path / "a" / r.path).stat().st_size == r.bytes for r in listed)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert W.op4_warc(spark, str(tmp_path)).count() == 0
