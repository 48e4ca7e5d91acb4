"""WARC archives with a Zstandard dictionary.

Records are written to ``.warc.zst`` archives in the shared folder: a skippable
frame that holds a dictionary trained on the archive's own records, then one
compressed frame for each record. Of records with equal payloads of at least
``LEAST_SHARED`` bytes the one with the smallest id is a response, the others are
revisits that refer to it and hold no payload.

An archive takes the records of a part of a partition, up to ``ARCHIVE_BYTES`` of
payload. A name appears only when its file is whole, and it holds the attempt that
wrote it: a task that is run again writes archives of its own, and only those of
the attempt that Spark accepts are listed. Reading streams a file frame by frame
and needs nothing but the file.

Cases: a null payload counts as empty, a null target as an empty one; a null id
is written as ``null`` and read back as null, and is never what others refer to;
rows that repeat are records of their own, and all that bear the smallest id of
their payload are responses. Ids are whole numbers. A very long payload is a
record, and at times an archive, of its own. Archives of fewer than
``LEAST_RECORDS`` records have no dictionary frame: a dictionary that is larger
than what it would save is not written, and the records read back all the same.
Extra columns are ignored, whatever their names. An empty table makes no archive
and no rows.
"""

from __future__ import annotations

import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from fringework.llm.shared import fresh_path, table, text_or_empty, written

LEAST_SHARED = 100
#: Payload bytes an archive holds at most (one larger record makes an archive of its own).
ARCHIVE_BYTES = 16 << 20
DICTIONARY_BYTES = 32 << 10
#: Bytes of an archive's records that its dictionary is trained on, spread evenly over them.
SAMPLE_BYTES = 2 << 20
#: Least records to train on; fewer are written without a dictionary.
LEAST_RECORDS = 16
LEVEL = 3
#: Fixed values of the format: magic numbers of the dictionary's skippable frame, of a frame, and of a dictionary.
SKIPPABLE, FRAME, DICTIONARY = b"\x5d\x2a\x4d\x18", b"\x28\xb5\x2f\xfd", b"\x37\xa4\x30\xec"
_DATE = "2000-01-01T00:00:00Z"


def record(page: str, url: str, kind: str, payload: bytes, digest: str, size: int, refers: str | None) -> bytes:
    """A WARC 1.1 record; the length of a revisit's whole payload stands in a header of its own."""
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page} {digest}")
    clean = "".join(c if c.isprintable() else "%%%02x" % ord(c) for c in url)  # noqa: UP031
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {clean}",
        f"WARC-Payload-Digest: sha256:{digest}", f"X-Page-Id: {page}", f"X-Payload-Length: {size}", "Content-Type: text/html; charset=utf-8",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-Id: {refers}"]
    head.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and content of one record."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not mark or not first.startswith("WARC/1."):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    size = int(headers["Content-Length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return headers, rest[:size]


def trained(records: list[bytes]) -> bytes | None:
    """A dictionary from the records, or None for too few of them."""
    if len(records) < LEAST_RECORDS:
        return None
    each = max(256, SAMPLE_BYTES // len(records))
    # A piece of every record, from a place that moves along, so no part of the pages is preferred.
    pieces = [r if len(r) <= each else r[(i * 7919) % (len(r) - each) :][:each] for i, r in enumerate(records)]
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, pieces)) // 8)), pieces).as_bytes()
    except zstandard.ZstdError:
        return None


def archive(records: list[bytes]) -> bytes:
    """The whole file: dictionary frame, then a frame for each record."""
    out = io.BytesIO()
    content = trained(records)
    if content:
        packed = zstandard.ZstdCompressor(level=19).compress(content)
        out.write(SKIPPABLE + len(packed).to_bytes(4, "little") + packed)
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(content))
    else:
        pack = zstandard.ZstdCompressor(level=LEVEL)
    for r in records:
        out.write(pack.compress(r))
    return out.getvalue()


def records_of(source: io.RawIOBase) -> Iterator[bytes]:
    """The records of an archive, one at a time, from a stream that reads forward."""
    head = source.read(8)
    held, content = head, None
    if head[:4] == SKIPPABLE:
        packed = source.read(int.from_bytes(head[4:], "little"))
        content = zstandard.ZstdDecompressor().decompress(packed) if packed[:4] == FRAME else packed
        held = b""
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content)) if content else zstandard.ZstdDecompressor()
    while True:
        held = held or source.read(1 << 16)
        if not held:
            return
        one, parts = unpack.decompressobj(), []
        while not one.eof:
            if not held and not (held := source.read(1 << 16)):
                raise ValueError("an archive ends within a record")
            parts.append(one.decompress(held))
            held = one.unused_data if one.eof else b""
        yield b"".join(parts)


def _opened(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if "://" not in folder and folder.startswith("file:"):
        folder = "file://" + folder[5:]
    return pyarrow.fs.FileSystem.from_uri(folder)


def with_references(pages: DataFrame, key: str, url: str, payload: str, least: int = LEAST_SHARED) -> DataFrame:
    """page, url, payload, digest, size, kind, refers: what is to be written for each row.

    Digests are counted without their payloads, and only those that repeat join back.
    """
    spark = pages.sparkSession
    text = text_or_empty(payload)
    digests = pages.select(F.col(key).cast("long").alias("page"), F.octet_length(text).cast("long").alias("size"), F.sha2(text, 256).alias("digest"))
    shared = digests.where(F.col("size") >= least).groupBy("digest").agg(F.count("*").alias("n"), F.min("page").alias("first"))
    shared = written(shared.where("n > 1 AND first IS NOT NULL").select("digest", "first"), "repeated-payloads")
    rows = pages.select(F.col(key).cast("long").alias("page"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"), text.alias("payload"))
    rows = rows.withColumn("size", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256))
    joined = rows.join(_small(shared), "digest", "left")
    revisit = F.col("first").isNotNull() & (F.col("size") >= least) & ~F.col("first").eqNullSafe(F.col("page"))
    return joined.select(
        "page", "url", F.when(revisit, F.lit("")).otherwise(F.col("payload")).alias("payload"), "digest", "size",
        F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("first")).alias("refers"),
    )


#: Repeated digests may be broadcast up to this many rows (about 100 bytes each).
BROADCAST_DIGESTS = 200_000


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_DIGESTS else df


def archives(rows: DataFrame, folder: str, most: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the rows of :func:`with_references` and returns (path, records, bytes) of each archive."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _opened(folder)
        files.create_dir(base, recursive=True)
        part, attempt, n = TaskContext.get().partitionId(), uuid.uuid4().hex[:12], 0
        held: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal n, size
            data, count = archive(held), len(held)
            held.clear()
            size = 0
            name = f"{base}/part-{part:05d}-{n:05d}-{attempt}.warc.zst"
            n += 1
            draft = f"{base}/.draft-{part:05d}-{attempt}"
            with files.open_output_stream(draft) as out:
                out.write(data)
            files.move(draft, name)
            return pa.RecordBatch.from_arrays([pa.array([name.rpartition("/")[2]]), pa.array([count], pa.int64()), pa.array([len(data)], pa.int64())], names=["path", "records", "bytes"])

        for batch in batches:
            for page, url, payload, digest, length, kind, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = payload.encode("utf-8", "surrogatepass")
                if held and size + len(raw) > most:
                    yield close()
                held.append(record("null" if page is None else str(page), url, kind, raw, digest, length, refers))
                size += len(held[-1])
        if held:
            yield close()

    return rows.mapInArrow(write, "path string, records long, bytes long")


def read_back(listed: DataFrame, folder: str) -> DataFrame:
    """The records of archives (path) in ``folder``: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    names = [c.split()[0] for c in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _opened(folder)
        held: list[tuple] = []
        size = 0

        def told() -> pa.RecordBatch:
            columns = [pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                with files.open_input_stream(f"{base}/{path}", compression=None) as source:
                    for data in records_of(source):
                        h, payload = parsed(data)
                        kind, told_digest = h["WARC-Type"], h["WARC-Payload-Digest"].partition(":")[2]
                        if kind == "response" and hashlib.sha256(payload).hexdigest() != told_digest:
                            raise ValueError("a payload differs from its digest")
                        page, refers = h["X-Page-Id"], h.get("X-Refers-To-Page-Id")
                        length = len(payload) if kind == "response" else int(h["X-Payload-Length"])
                        held.append((None if page == "null" else int(page), h["WARC-Target-URI"], length, told_digest, kind, int(refers) if refers else None, payload))
                        size += len(payload)
                        if len(held) >= 1024 or size > 4 << 20:
                            yield told()
                            size = 0
        if held:
            yield told()

    return listed.select("path").mapInArrow(read, schema)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "archives")
    rows = with_references(table(spark, sf_dir, "pages"), "page_id", "url", "html")
    listed = written(archives(rows, folder), "archive-list")
    back = read_back(listed.repartition(max(1, min(listed.count(), spark.sparkContext.defaultParallelism * 4))), folder)
    return back.drop("payload", "url")


QUERIES = {"op4_warc": op4_warc}
ORACLE_SQL = {
    "op4_warc": """
WITH told AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), grouped AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM told
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to
FROM grouped
"""
}
