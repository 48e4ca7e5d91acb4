"""Lists of remote files, and fetching them side by side into a shared folder."""

from __future__ import annotations

import csv
import io
import re
import urllib.error
import urllib.parse
import urllib.request
import uuid
import xml.etree.ElementTree as ET
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame

from fringework.sources.granule import _opened

#: Bytes read at a time, and how often a file is tried.
PIECE, ATTEMPTS = 1 << 20, 3


def search_url(base: str, short_name: str, bbox: Sequence[float] | None = None, temporal: tuple[str, str] | None = None, granules: Sequence[str] | None = None, count: int | None = None) -> str:
    """The address of a catalogue query: a collection, a lon/lat box (west, south, east, north), a span of time, names with wildcards."""
    told: list[tuple[str, str]] = [("short_name", short_name)]
    if bbox is not None:
        west, south, east, north = bbox
        if not (-180 <= west <= east <= 180 and -90 <= south <= north <= 90):
            raise ValueError("the box is not west, south, east, north")
        told.append(("bounding_box", ",".join(f"{v:g}" for v in bbox)))
    if temporal is not None:
        told.append(("temporal", ",".join(temporal)))
    for name in granules or ():
        told.append(("readable_granule_name[]", name))
        if "*" in name or "?" in name:
            told.append(("options[readable_granule_name][pattern]", "true"))
    if count is not None:
        told.append(("page_size", str(count)))
    return f"{base}?{urllib.parse.urlencode(told)}"


def listed(text: str) -> list[str]:
    """Addresses of a metalink, of a table with a column of them (``URL`` or the first that has one), or of lines; each once."""
    text = text.strip()
    if text.startswith("<"):
        found = [e.text.strip() for e in ET.fromstring(text).iter() if e.tag.rpartition("}")[2] == "url" and e.text]
    else:
        rows = list(csv.reader(io.StringIO(text)))
        head = [c.strip().lower() for c in rows[0]] if rows else []
        if "url" in head:
            found = [r[head.index("url")].strip() for r in rows[1:] if len(r) > head.index("url")]
        else:
            found = [next((c.strip() for c in r if re.match(r"\s*[a-z0-9+.-]+://", c)), "") for r in rows]
    return list(dict.fromkeys(u for u in found if u))


def _fetched(url: str, folder: str, headers: dict[str, str], attempts: int) -> tuple[str, int, str | None]:
    """(path, bytes, what went wrong): a name appears only when its file is whole; one of the right size is not fetched again."""
    files, base = _opened(folder)
    files.create_dir(base, recursive=True)
    path = f"{base}/{urllib.parse.unquote(urllib.parse.urlparse(url).path.rpartition('/')[2]) or 'index'}"
    wrong = None
    for _ in range(attempts):
        draft = f"{path}.{uuid.uuid4().hex}.draft"
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=60) as got:
                size = int(got.headers.get("Content-Length") or -1)
                there = files.get_file_info(path)
                if there.type != pyarrow.fs.FileType.NotFound and size >= 0 and there.size == size:
                    return path, size, None
                n = 0
                with files.open_output_stream(draft) as out:
                    while piece := got.read(PIECE):
                        out.write(piece)
                        n += len(piece)
            if size >= 0 and n != size:
                raise OSError(f"{n} of {size} bytes came")
            files.move(draft, path)
            return path, n, None
        except urllib.error.HTTPError as e:
            wrong = f"{e.code} {e.reason}"
            if e.code < 500:
                break
        except OSError as e:
            wrong = str(e)
        if files.get_file_info(draft).type != pyarrow.fs.FileType.NotFound:
            files.delete_file(draft)
    return path, 0, wrong


def fetched(urls: DataFrame, folder: str, token: str | None = None, attempts: int = ATTEMPTS, url: str = "url") -> DataFrame:
    """(url, path, bytes, error) of every address; tasks fetch side by side into ``folder``, which all of them see."""
    headers = {"Authorization": f"Bearer {token}"} if token else {}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(u, *_fetched(u, folder, headers, attempts)) for u in f[url]]
            yield pd.DataFrame(rows, columns=["url", "path", "bytes", "error"])

    return urls.select(url).distinct().mapInPandas(run, "url string, path string, bytes long, error string")
