import http.server
import threading

import pytest

from fringework.sources import remote as R


def test_lists():
    meta = "<metalink xmlns='m'><files><file name='a'><resources><url>https://h/a.h5</url></resources></file><file name='b'><resources><url> https://h/b.h5 </url></resources></file></files></metalink>"
    assert R.listed(meta) == ["https://h/a.h5", "https://h/b.h5"]
    assert R.listed("Name,URL\nx,https://h/x\ny,https://h/y\nx,https://h/x\n") == ["https://h/x", "https://h/y"]
    assert R.listed("https://h/1\n\nhttps://h/2\nnothing\n") == ["https://h/1", "https://h/2"]
    u = R.search_url("https://c/granules.json", "S", (-69, 10, -66, 11), ("2025-01-01", "2025-02-01"), ["A*"], 5)
    assert "bounding_box=-69%2C10%2C-66%2C11" in u and "page_size=5" in u and "pattern" in u
    with pytest.raises(ValueError):
        R.search_url("https://c", "S", (10, 0, -10, 5))


def test_fetching(spark, tmp_path):
    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            seen.append((self.path, self.headers.get("Authorization")))
            if self.path == "/gone":
                self.send_error(404)
                return
            body = self.path.encode() * 1000
            short = self.path == "/short"
            self.send_response(200)
            self.send_header("Content-Length", str(len(body) + (7 if short else 0)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        base = f"http://127.0.0.1:{server.server_address[1]}"
        urls = spark.createDataFrame([(f"{base}/{n}",) for n in ("a.h5", "b%20c.h5", "gone", "short", "a.h5")], "url string")
        got = {r.url.rpartition("/")[2]: r for r in R.fetched(urls, str(tmp_path / "d"), token="t").collect()}
    finally:
        server.shutdown()
    assert (tmp_path / "d" / "a.h5").read_bytes() == b"/a.h5" * 1000 and (tmp_path / "d" / "b c.h5").exists()
    assert got["a.h5"].bytes == 5000 and got["a.h5"].error is None and got["gone"].error.startswith("404") and "bytes came" in got["short"].error
    assert sorted(p.name for p in (tmp_path / "d").iterdir()) == ["a.h5", "b c.h5"] and all(a == "Bearer t" for _, a in seen)
    assert sum(p == "/gone" for p, _ in seen) == 1 and sum(p == "/short" for p, _ in seen) == R.ATTEMPTS
