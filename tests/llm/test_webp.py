import hashlib
import random
import zlib

import numpy as np
import pytest

from fringework.llm import webp as W


def put_number(out, value, first, words):
    """A length or distance as prefix symbol and extra bits."""
    v = value - 1
    if v < 4:
        symbol, n, extra = v, 0, 0
    else:
        n = v.bit_length() - 2
        symbol = 2 * (n + 1) + (v >> n & 1)
        extra = v & ((1 << n) - 1)
    out.put(*words[first + symbol])
    out.put(extra, n)


def put_pixels(out, pixels, width, top, cache_bits=0, block_map=None, map_bits=2, refs=True):
    """A plain writer: greedy references one row up or one pixel back, the cache, several groups of codes."""
    out.put(bool(cache_bits), 1)
    if cache_bits:
        out.put(cache_bits, 4)
    groups = 1
    if top:
        out.put(block_map is not None, 1)
        if block_map is not None:
            out.put(map_bits - 2, 3)
            groups = int(block_map.max()) + 1
            put_pixels(out, (block_map.reshape(-1).astype(np.uint32) << 8), block_map.shape[1], False, refs=False)
    rnd = random.Random(9)
    lengths = []
    for _ in range(groups):
        sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
        lengths.append([W.huffman_lengths([rnd.randint(1, 9) for _ in range(n)]) for n in sizes])
        for one in lengths[-1]:
            W.put_code(out, one)
    words = [[W.code(x).words for x in group] for group in lengths]
    cache = {}
    p = [int(x) for x in pixels]
    at = 0
    while at < len(p):
        y, x = divmod(at, width)
        g = words[0 if block_map is None else int(block_map[y >> map_bits, x >> map_bits])]
        best = (0, 0, 0)
        for d, coded in ((1, 2), (width, 1), (width + 1, 3)) if refs else ():
            n = 0
            while d <= at and at + n < len(p) and p[at + n] == p[at + n - d] and n < 4096:
                n += 1
            best = max(best, (n, -d, coded))
        key = (0x1E35A7BD * p[at] & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else None
        if best[0] >= 3:
            put_number(out, best[0], 256, g[0])
            put_number(out, best[2] if width > 8 else 120 - best[1], 0, g[4])
            n = best[0]
        elif cache_bits and cache.get(key, 0) == p[at]:
            out.put(*g[0][280 + key])
            n = 1
        else:
            out.put(*g[0][p[at] >> 8 & 255])
            out.put(*g[1][p[at] >> 16 & 255])
            out.put(*g[2][p[at] & 255])
            out.put(*g[3][p[at] >> 24])
            n = 1
        for q in p[at : at + n]:
            if cache_bits:
                cache[(0x1E35A7BD * q & 0xFFFFFFFF) >> (32 - cache_bits)] = q
        at += n


def stream(pixels, width, height, transforms=(), **more):
    out = W.Writer()
    for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        out.put(value, n)
    rnd = np.random.default_rng(2)
    now = width
    for kind in transforms:
        out.put(1, 1)
        out.put(kind, 2)
        shape = (W._parts(height, 2), W._parts(now, 2))
        if kind == W.PREDICTOR:
            modes = rnd.integers(0, 14, shape)
            out.put(0, 3)
            put_pixels(out, (modes.reshape(-1) << 8).astype(np.uint32), shape[1], False)
            pixels = W.predictor(pixels, now, modes, 2, invert=False)
        elif kind == W.CROSS_COLOUR:
            parts = rnd.integers(0, 1 << 24, shape).astype(np.uint32)
            out.put(0, 3)
            put_pixels(out, parts.reshape(-1), shape[1], False)
            pixels = W.cross_colour(pixels, now, parts, 2, invert=False)
        elif kind == W.SUBTRACT_GREEN:
            pixels = W.subtract_green(pixels, invert=False)
        else:
            palette, index = np.unique(pixels, return_inverse=True)
            out.put(len(palette) - 1, 8)
            c = W._channels(palette).astype(np.int64)
            put_pixels(out, W._packed(np.diff(c, axis=0, prepend=np.zeros((1, 4), np.int64)) & 255), len(palette), False)
            share = W.index_bits(len(palette))
            packed = W._parts(now, share)
            grid = np.zeros((height, packed << share), np.int64)
            grid[:, :now] = index.reshape(height, now)
            green = (grid.reshape(height, packed, -1) << (np.arange(1 << share) * (8 >> share))).sum(axis=2)
            pixels, now = (green.reshape(-1) << 8).astype(np.uint32), packed
    out.put(0, 1)
    if more.pop("mapped", False):
        more["block_map"] = rnd.integers(0, 3, (W._parts(height, 2), W._parts(now, 2)))
    put_pixels(out, pixels, now, True, **more)
    return out.value.to_bytes(out.n + 7 >> 3, "little")


def picture(width, height, colours, seed=1):
    rnd = np.random.default_rng(seed)
    some = rnd.integers(0, 1 << 32, colours, dtype=np.uint64).astype(np.uint32)
    flat = some[rnd.integers(0, colours, width * height)]
    flat[width : width * 4] = flat[:width].repeat(3)[: width * 3]
    return flat


@pytest.mark.parametrize("transforms", [(), (0,), (1,), (2,), (0, 1, 2), (2, 1, 0), (3,), (3, 0)])
@pytest.mark.parametrize("more", [{}, {"cache_bits": 5}, {"mapped": True}, {"cache_bits": 3, "mapped": True}])
def test_decoder_inverts_every_feature(transforms, more):
    for width, height, colours in ((19, 13, 2), (7, 9, 4), (33, 6, 14), (20, 10, 200)):
        pixels = picture(width, height, colours)
        got = W.decode_image(stream(pixels, width, height, transforms, **more))
        assert got[:2] == (width, height) and got[3] == list(transforms)
        assert (got[2] == pixels).all()


def test_predictions_by_hand():
    left, up, up_right, up_left = (np.array(x) for x in ([10, 20, 30, 255], [14, 20, 90, 255], [1, 2, 3, 255], [12, 250, 60, 255]))
    want = {0: [0, 0, 0, 255], 1: left, 2: up, 3: up_right, 4: up_left, 5: [9, 15, 53, 255], 6: [11, 135, 45, 255], 7: [12, 20, 60, 255], 8: [13, 135, 75, 255],
            9: [7, 11, 46, 255], 10: [9, 73, 45, 255], 11: up, 12: [12, 0, 60, 255], 13: [12, 0, 60, 255]}
    for mode, value in want.items():
        assert W._predicted(mode, left, up, up_right, up_left).tolist() == list(value), mode


def test_code_lengths_with_repeats():
    out = W.Writer()
    out.put(0, 1)
    out.put(19 - 4, 4)
    outer = [0] * 19
    outer[1], outer[16], outer[17], outer[18] = 2, 2, 2, 2
    for at in W.LENGTH_ORDER:
        out.put(outer[at], 3)
    out.put(0, 1)
    words = W.code(tuple(outer)).words
    for symbol, extra, n in ((1, 0, 0), (16, 3, 2), (17, 2, 3), (18, 100, 7), (17, 5, 3), (18, 127, 7)):
        out.put(*words[symbol])
        out.put(extra, n)
    got = W.read_code(W.Bits(out.value.to_bytes(out.n + 15 >> 3, "little")), 7 + 5 + 111 + 8 + 138)
    assert got == (1,) * 7 + (0,) * 262
    bits = W.Bits(bytes([0b00000101, 0, 0]))
    assert W.read_code(bits, 256)[0] == 1
    with pytest.raises(ValueError):
        W.Code((2, 2, 2))


def test_broken_streams_are_refused():
    good = W.stored(W.payload("hello")[0])
    with pytest.raises(ValueError):
        list(W.unwrapped(b"RIFX" + good[4:]))
    with pytest.raises(ValueError):
        W.decode_image(next(W.unwrapped(good))[:-20])


def test_round_trips(monkeypatch):
    rnd = random.Random(3)
    for data in (b"", b"a" * 192, b"b" * 193, bytes(range(256)) * 40, rnd.randbytes(10_000), ("größer él " * 500).encode()):
        text = data.decode("latin-1")
        padded, n = W.payload(text)
        assert len(padded) % 192 == 0 and len(padded) >= 192 and padded[:n] == text.encode() and set(padded[n:]) <= {32}
        assert W.restored(W.stored(padded))[0] == padded
    monkeypatch.setattr(W, "IMAGE_ROWS", 4)
    padded = W.payload("many images " * 300)[0]
    back, shapes = W.restored(W.stored(padded))
    assert back == padded and len(shapes) == -(-len(padded) // 768)


def test_query(spark, tmp_path):
    rows = [(1, "one", "x"), (2, None, "x"), (3, "", None), (4, "z" * 200_000, "x"), (None, "one", "x"), (1, "one", "x"), (5, "x" * 192, "y")]
    spark.createDataFrame(rows, "doc_id long, text string, media string").write.parquet(f"{tmp_path}/documents.parquet")
    got = W.op7_webp(spark, str(tmp_path)).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    for r, (i, text, _) in zip(sorted(got, key=lambda r: key((r.doc_id, r.n_bytes))), sorted(rows, key=lambda r: key((r[0], len(r[1] or "")))), strict=True):
        raw = (text or "").encode()
        full = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        assert (r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (i, len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]))
        media = W.stored(full)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    assert len({r.feature for r in got if r.n_bytes == 0}) == 1


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert W.op7_webp(spark, str(tmp_path)).count() == 0


def test_extended_containers_are_read():
    stream = W.encode_image(np.arange(12, dtype=np.uint8), 2)
    chunk = lambda kind, body: kind + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) & 1)
    body = b"WEBP" + chunk(b"VP8X", bytes(10)) + chunk(b"ICCP", b"odd") + chunk(b"VP8L", stream) + chunk(b"EXIF", b"x")
    extended = b"RIFF" + len(body).to_bytes(4, "little") + body
    assert list(W.unwrapped(extended + W.wrapped(stream))) == [stream, stream]


#: The alpha plane of a small picture as another encoder stored it (a lossless stream without its header), and what a PNG of the same picture says it is.
OTHERS_STREAM = (
    "27a2a89124e57ae7185fe7df2a998898ff74718de02630e2e18b7732c8c1115c832b30e8b078158e785135c1080c024f92a06ab055191cd6b66d462f4ec6763cb6ed77fbaf29ae21a2ff49d1fd8f90f7ba4449241b3a259134f3146d0ec7d3e5"
    "1620f40b14be90e183b71a329e36827f1d297e4e7608fb889eb391ef997346e83282dbf8cc48b2f745307d20fd36178c2132562da5d66b23bc5de3a55915d59c81a4d96e96758a18310f8aaa2c5034fa3082dfba6b505229b52dcfe954140a010000"
)
OTHERS_SHA256 = "00d64fd72159f0e240eac94eb2a256366dad5e267b45a1920aa72771a8e6ff8c"


def test_a_stream_of_another_encoder():
    head = (0x2F | 15 << 8 | 15 << 22 | 1 << 36).to_bytes(5, "little")
    width, height, pixels, used = W.decode_image(head + bytes.fromhex(OTHERS_STREAM))
    green = (pixels >> 8 & 255).astype(np.uint8)
    assert (width, height, used) == (16, 16, [W.INDEXING])
    assert hashlib.sha256(green.tobytes()).hexdigest() == OTHERS_SHA256


def test_the_writer_uses_what_helps(monkeypatch):
    """Each way to store an image is taken by some text, read back exactly, and smaller than the fixed code."""
    rnd = random.Random(8)
    line = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(192))
    words = [bytes(rnd.randrange(33, 127) for _ in range(3)) for _ in range(300)]
    samples = {
        "palette": b" " * 960, "references": (line[:100] * 60).encode(), "up": b"".join(bytes((k * 7 + x * 5 + 3 * rnd.randrange(2)) % 256 for x in range(192)) for k in range(40)),
        "cache": b"".join(rnd.choice(words) for _ in range(6_400)), "left": bytes(v for k in range(6_400) for v in [(k % 64 * 3 + k // 64 * rnd.randrange(90)) % 256] * 3),
        "green": b"".join(bytes([v, v, v]) for v in (rnd.randrange(256) for _ in range(6_400))), "cross": b"".join(bytes([v & 127, rnd.randrange(256), v & 127]) for v in (rnd.randrange(256) for _ in range(6_400))),
    }
    taken = {}
    for name, data in samples.items():
        data = data[: len(data) // 192 * 192]
        pixels = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.uint32)
        pixels = np.uint32(0xFF000000) | pixels[:, 0] << np.uint32(16) | pixels[:, 1] << np.uint32(8) | pixels[:, 2]
        taken[name] = min(W._plans(pixels, 64, *np.unique(pixels, return_inverse=True), W.repeats(pixels)), default=(0, ""))[1]
        monkeypatch.setattr(W, "DENSE", 9.0)  # some of these are noise to a general compressor
        media = W.stored(data)
        assert W.restored(media)[0] == data and (len(media) < len(data) or not taken[name])
        monkeypatch.setattr(W, "WORTH", 2.0)
        assert len(media) < len(W.stored(data)) or not taken[name]
        monkeypatch.undo()
    assert set(taken.values()) >= {"palette", "references", "cache", "green", "cross"}, taken


def test_windows_of_the_decoder_end_where_the_stream_does():
    rnd = np.random.default_rng(4)
    for n in (64, 640, 64 * 37):
        data = rnd.integers(97, 100, 3 * n, dtype=np.uint8)
        media = W.encode_image(data, 64)
        assert (W._channels(W.decode_image(media)[2])[:, 2::-1].reshape(-1) == data).all()
        with pytest.raises(ValueError):
            W.decode_image(media[: len(media) // 2])
