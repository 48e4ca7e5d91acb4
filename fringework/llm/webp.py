"""Lossless WebP (VP8L) in columns: a full decoder, and a writer for the payloads of media columns.

The decoder reads prefix codes, meta prefix codes, back-references and the colour
cache, and inverts the predictor, cross-colour, subtract-green and colour-indexing
transforms, all from the published format. Streams whose literals share one code
and use neither references nor a cache are decoded by a table that takes a byte of
the stream at a time; every other stream is decoded symbol by symbol. The writer
stores running text with a fixed code, and uses a palette, a predictor, a mix of
channels, references or a cache where those save much of the bits.

A text is stored as its UTF-8 bytes, filled with spaces to a positive multiple of
192, three bytes a pixel (red, green, blue), 64 pixels a row; longer payloads than
one image can hold become several images, one after another.

Cases: null and empty texts are 192 spaces. Equal texts give equal bytes: the
writer's codes depend on the payload alone. Repeated rows are stored each, extra
columns are ignored, empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fringework.llm.shared import table, text_or_empty

UNIT, WIDTH, SIDE = 192, 64, 16_384
#: Rows of one image of the writer.
IMAGE_ROWS = SIDE

PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, INDEXING = 0, 1, 2, 3

#: Fixed values of the format: order of code-length codes, and the first 120 distance codes as (dx, dy).
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEARBY = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)


class Bits:
    """Reads bits, the lowest of a byte first."""

    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at, self.end = data, at, len(data) * 8

    def peek(self, n: int) -> int:
        first = self.at >> 3
        return int.from_bytes(self.data[first : first + (n + 14 >> 3)], "little") >> (self.at & 7) & ((1 << n) - 1)

    def take(self, n: int) -> int:
        value = self.peek(n)
        self.at += n
        if self.at > self.end:
            raise ValueError("the stream ends early")
        return value


class Code:
    """A canonical prefix code; a code of one symbol takes no bits."""

    def __init__(self, lengths: tuple[int, ...]) -> None:
        used = [(n, s) for s, n in enumerate(lengths) if n]
        if not used:
            raise ValueError("a code needs a symbol")
        self.only = used[0][1] if len(used) == 1 else None
        self.longest = 0 if self.only is not None else max(n for n, _ in used)
        self.words: dict[int, tuple[int, int]] = {}
        if self.only is not None:
            self.table = [(0, self.only)]
            self.words[self.only] = (0, 0)
            return
        self.table = [(0, -1)] * (1 << self.longest)
        word, before, space = 0, 0, 0
        for n, symbol in sorted(used):
            word <<= n - before
            before = n
            turned = int(f"{word:0{n}b}"[::-1], 2)
            self.words[symbol] = (turned, n)
            self.table[turned :: 1 << n] = [(n, symbol)] * (1 << self.longest - n)
            word += 1
            space += 1 << (15 - n)
        if space != 1 << 15:
            raise ValueError("a prefix code must be complete")

    def read(self, bits: Bits) -> int:
        n, symbol = self.table[bits.peek(self.longest) if self.longest else 0]
        bits.at += n
        if bits.at > bits.end:
            raise ValueError("the stream ends early")
        return symbol


@lru_cache(maxsize=512)
def code(lengths: tuple[int, ...]) -> Code:
    return Code(lengths)


#: Bytes of the stream that stand in the decoder's window when it is filled; what one symbol may take at most (bits).
_FILL, _MOST_BITS = 64, 15 * 5 + 2 * 18


def read_code(bits: Bits, size: int) -> tuple[int, ...]:
    """Code lengths of an alphabet, in the simple or the normal form."""
    lengths = [0] * size
    if bits.take(1):
        two = bits.take(1)
        lengths[bits.take(8 if bits.take(1) else 1)] = 1
        if two:
            lengths[bits.take(8)] = 1
        return tuple(lengths)
    outer = [0] * 19
    for at in LENGTH_ORDER[: 4 + bits.take(4)]:
        outer[at] = bits.take(3)
    reader = code(tuple(outer))
    count = 2 + bits.take(2 + 2 * bits.take(3)) if bits.take(1) else size
    table, mask, data, pos = reader.table, (1 << reader.longest) - 1, bits.data, bits.at
    at, before, window, left = 0, 8, 0, 0
    while at < size and count:
        count -= 1
        if left < 16:
            window = int.from_bytes(data[pos >> 3 : (pos >> 3) + _FILL], "little") >> (pos & 7)
            left = 8 * _FILL - (pos & 7)
        used, symbol = table[window & mask]
        window >>= used
        if symbol < 16:
            lengths[at] = symbol
            at += 1
            if symbol:
                before = symbol
        else:
            extra = 2 if symbol == 16 else 3 if symbol == 17 else 7
            n = (11 if symbol == 18 else 3) + (window & ((1 << extra) - 1))
            window >>= extra
            used += extra
            if at + n > size:
                raise ValueError("code lengths run over the alphabet")
            if symbol == 16:
                lengths[at : at + n] = [before] * n
            at += n
        pos += used
        left -= used
    if pos > bits.end:
        raise ValueError("the stream ends early")
    bits.at = pos
    return tuple(lengths)


@lru_cache(maxsize=64)
def _machine(lengths: tuple[int, ...]) -> list:
    """For each inner state of a code's tree, per byte of the stream: the symbols it completes and the state after."""
    words = code(lengths).words
    nodes: dict[tuple[int, int], int] = {(0, 0): 0}
    for word, n in sorted(words.values(), key=lambda x: (x[1], x[0])):
        for k in range(1, n):
            nodes.setdefault((k, word & ((1 << k) - 1)), len(nodes))
    leaves = {(n, word): symbol for symbol, (word, n) in words.items()}
    steps = np.empty((len(nodes), 2), np.int32)
    for (k, word), at in nodes.items():
        for bit in (0, 1):
            goal = (k + 1, word | bit << k)
            steps[at, bit] = -1 - leaves[goal] if goal in leaves else nodes[goal]
    rows: list[list] = [[] for _ in nodes]
    for start, row in enumerate(rows):
        for byte in range(256):
            at, made = start, []
            for k in range(8):
                at = int(steps[at, byte >> k & 1])
                if at < 0:
                    made.append(-1 - at)
                    at = 0
            row.append((bytes(made), rows[at]))
    return rows[0]


def _literals(bits: Bits, lengths: tuple[int, ...], count: int) -> np.ndarray:
    """``count`` symbols of one code, a byte of the stream at a time."""
    reader, start = code(lengths), bits.at
    made = []
    while bits.at & 7 and len(made) < count:
        made.append(reader.read(bits))
    made = [bytes(made)]
    put, row = made.append, _machine(lengths)
    first = bits.at >> 3
    for byte in bits.data[first : first + (count * reader.longest >> 3) + 1]:
        piece, row = row[byte]
        put(piece)
    symbols = np.frombuffer(b"".join(made), np.uint8)[:count]
    if len(symbols) < count:
        raise ValueError("the stream ends early")
    bits.at = start + int(_tables(lengths)[1][symbols].sum())
    return symbols


class _Header:
    """What stands before the pixels of an image: cache size, map of code groups, and the groups' code lengths."""

    __slots__ = ("cache_bits", "map_bits", "map", "groups")


def _read_groups(bits: Bits, width: int, height: int, top: bool) -> _Header:
    h = _Header()
    h.cache_bits = bits.take(4) if bits.take(1) else 0
    if h.cache_bits > 11:
        raise ValueError("the colour cache is too large")
    h.map_bits, h.map, n = 0, None, 1
    if top and bits.take(1):
        h.map_bits = bits.take(3) + 2
        small = read_pixels(bits, _parts(width, h.map_bits), _parts(height, h.map_bits), False)
        h.map = (small >> 8 & 0xFFFF).astype(np.int64).reshape(_parts(height, h.map_bits), _parts(width, h.map_bits))
        n = int(h.map.max()) + 1
    cached = 1 << h.cache_bits if h.cache_bits else 0
    h.groups = [tuple(read_code(bits, size) for size in (280 + cached, 256, 256, 256, 40)) for _ in range(n)]
    return h


def _parts(size: int, bits: int) -> int:
    return size + (1 << bits) - 1 >> bits


def read_pixels(bits: Bits, width: int, height: int, top: bool) -> np.ndarray:
    """Entropy-coded pixels as ARGB in 32 bits, row by row."""
    h = _read_groups(bits, width, height, top)
    total = width * height
    if len(h.groups) == 1 and not h.cache_bits:
        green, red, blue, alpha, _ = h.groups[0]
        if green[:256] == red == blue and not any(green[256:]) and sum(map(bool, alpha)) == 1 and sum(map(bool, red)) > 1:
            s = _literals(bits, red, 3 * total).reshape(-1, 3).astype(np.uint32)
            return np.uint32(alpha.index(next(filter(None, alpha))) << 24) | s[:, 1] << np.uint32(16) | s[:, 0] << np.uint32(8) | s[:, 2]
    return _symbol_by_symbol(bits, h, width, total)


def _symbol_by_symbol(bits: Bits, h: _Header, width: int, total: int) -> np.ndarray:
    groups = []
    for lengths in h.groups:
        codes = [code(x) for x in lengths]
        groups.append(tuple(x for c in codes for x in (c.table, (1 << c.longest) - 1)))
    out = [0] * total
    cached = [0] * (1 << h.cache_bits) if h.cache_bits else None
    shift, map_bits, map_ = 32 - h.cache_bits, h.map_bits, h.map.tolist() if h.map is not None else None
    data, pos = bits.data, bits.at
    at = stored = 0
    # The window holds the stream from bit ``pos`` on; ``left`` bits of it are good.
    window = left = 0
    gt, gm, rt, rm, bt, bm, at_, am, ft, fm = groups[0]
    while at < total:
        if left < _MOST_BITS:
            window = int.from_bytes(data[pos >> 3 : (pos >> 3) + _FILL], "little") >> (pos & 7)
            left = 8 * _FILL - (pos & 7)
        if map_ is not None:
            gt, gm, rt, rm, bt, bm, at_, am, ft, fm = groups[map_[at // width >> map_bits][at % width >> map_bits]]
        used, g = gt[window & gm]
        window >>= used
        if g < 256:
            n, r = rt[window & rm]
            window >>= n
            used += n
            n, b = bt[window & bm]
            window >>= n
            used += n
            n, a = at_[window & am]
            window >>= n
            used += n
            out[at] = a << 24 | r << 16 | g << 8 | b
            at += 1
        elif g < 280:
            n, extra = _value(window, g - 256)
            window >>= extra
            used += extra
            size, f = ft[window & fm]
            window >>= size
            d, extra = _value(window, f)
            window >>= extra
            used += size + extra
            if d > 120:
                d -= 120
            else:
                dx, dy = NEARBY[d - 1]
                d = max(1, dx + dy * width)
            if d > at or at + n > total:
                raise ValueError("a reference leaves the image")
            if d >= n:
                out[at : at + n] = out[at - d : at - d + n]
            else:  # the piece repeats itself
                piece = out[at - d : at]
                out[at : at + n] = (piece * (n // d + 1))[:n]
            at += n
        else:
            if cached is None:
                raise ValueError("a cache symbol without a cache")
            for p in out[stored:at]:
                cached[(0x1E35A7BD * p & 0xFFFFFFFF) >> shift] = p
            stored = at
            out[at] = cached[g - 280]
            at += 1
        pos += used
        left -= used
        if pos > bits.end:
            raise ValueError("the stream ends early")
    bits.at = pos
    return np.array(out, np.uint32)


def _value(window: int, symbol: int) -> tuple[int, int]:
    """The length or distance of a prefix symbol whose extra bits begin the window, and how many those are."""
    if symbol < 4:
        return symbol + 1, 0
    n = symbol - 2 >> 1
    return ((2 + (symbol & 1)) << n) + (window & ((1 << n) - 1)) + 1, n


def _channels(pixels: np.ndarray) -> np.ndarray:
    """(n, 4) bytes in the order blue, green, red, alpha."""
    return np.ascontiguousarray(pixels.astype("<u4")).view(np.uint8).reshape(-1, 4)


def _average(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a + b) >> 1


def _predicted(mode: int, left: np.ndarray, up: np.ndarray, up_right: np.ndarray, up_left: np.ndarray) -> np.ndarray:
    match mode:
        case 0 | 14 | 15:
            return np.array([0, 0, 0, 255])
        case 1:
            return left
        case 2:
            return up
        case 3:
            return up_right
        case 4:
            return up_left
        case 5:
            return _average(_average(left, up_right), up)
        case 6:
            return _average(left, up_left)
        case 7:
            return _average(left, up)
        case 8:
            return _average(up_left, up)
        case 9:
            return _average(up, up_right)
        case 10:
            return _average(_average(left, up_left), _average(up, up_right))
        case 11:
            to_left, to_up = np.abs(up - up_left).sum(), np.abs(left - up_left).sum()
            return left if to_left < to_up else up
        case 12:
            return np.clip(left + up - up_left, 0, 255)
        case _:
            mean = _average(left, up)
            half = np.trunc((mean - up_left) / 2).astype(np.int64)
            return np.clip(mean + half, 0, 255)


#: Modes that look at the row above alone.
_ABOVE = {2, 3, 4, 8, 9}


def predictor(pixels: np.ndarray, width: int, modes: np.ndarray, bits: int, invert: bool = True) -> np.ndarray:
    """Adds (or, for a writer, takes away) each pixel's prediction. ``modes``: block numbers by block row and column.

    Runs of a mode that looks at the row above, or at the left neighbour, are done at once; the others pixel by pixel.
    """
    given = _channels(pixels).astype(np.int64).reshape(-1, width, 4)
    if not invert:
        return _packed(given - _guesses(given, width, modes, bits) & 255)
    out = np.zeros_like(given)
    out[0] = (np.cumsum(given[0], axis=0) + [0, 0, 0, 255]) & 255
    for y in range(1, len(given)):
        up, row = out[y - 1], out[y]
        row[0] = (given[y, 0] + up[0]) & 255
        right = np.concatenate([up[1:], row[:1]])  # right of the last column stands the first pixel of this row
        for k in range(modes.shape[1]):
            a, b = max(1, k << bits), min(width, k + 1 << bits)
            if a >= b:
                continue
            mode = int(modes[y >> bits, k])
            if mode in _ABOVE or mode in (0, 14, 15):
                row[a:b] = (given[y, a:b] + _predicted(mode, up[a:b], up[a:b], right[a:b], up[a - 1 : b - 1])) & 255
            elif mode == 1:
                row[a:b] = (np.cumsum(given[y, a:b], axis=0) + row[a - 1]) & 255
            else:
                for x in range(a, b):
                    row[x] = (given[y, x] + _predicted(mode, row[x - 1], up[x], right[x], up[x - 1])) & 255
    return _packed(out)


def _guesses(known: np.ndarray, width: int, modes: np.ndarray, bits: int) -> np.ndarray:
    """The prediction of every pixel where all are known."""
    out = np.zeros_like(known)
    out[0, 0] = [0, 0, 0, 255]
    out[0, 1:] = known[0, :-1]
    out[1:, 0] = known[:-1, 0]
    if len(known) < 2 or width < 2:
        return out
    left, up, up_left = known[1:, :-1], known[:-1, 1:], known[:-1, :-1]
    up_right = np.concatenate([known[:-1, 2:], known[1:, :1]], axis=1)
    y, x = np.indices(left.shape[:2]) + 1
    which = modes[y >> bits, x >> bits]
    for mode in np.unique(which):
        at = which == mode
        parts = [v[at] for v in (left, up, up_right, up_left)]
        out[1:, 1:][at] = np.stack([_predicted(int(mode), *(v[i] for v in parts)) for i in range(int(at.sum()))]) if mode == 11 else _predicted(int(mode), *parts)
    return out


def _packed(channels: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(channels.reshape(-1, 4).astype(np.uint8)).view("<u4").reshape(-1).astype(np.uint32)


def cross_colour(pixels: np.ndarray, width: int, parts: np.ndarray, bits: int, invert: bool = True) -> np.ndarray:
    """Undoes (or applies) the mixing of green into red and blue, and of red into blue, by block."""
    c = _channels(pixels).astype(np.int64)
    y, x = np.divmod(np.arange(len(c)), width)
    signed = lambda v: (v & 255) - ((v & 128) << 1)
    m = _channels(parts[y >> bits, x >> bits].astype(np.uint32)).astype(np.int64)
    red_to_blue, green_to_blue, green_to_red = (signed(m[:, k]) for k in (2, 1, 0))
    shared = lambda t, v: t * signed(v) >> 5
    sign = 1 if invert else -1
    blue, green, red = c[:, 0], c[:, 1], c[:, 2]
    new_red = (red + sign * shared(green_to_red, green)) & 255
    new_blue = blue + sign * (shared(green_to_blue, green) + shared(red_to_blue, new_red if invert else red))
    return _packed(np.column_stack([new_blue & 255, green, new_red, c[:, 3]]))


def subtract_green(pixels: np.ndarray, invert: bool = True) -> np.ndarray:
    c = _channels(pixels).astype(np.int64)
    sign = 1 if invert else -1
    return _packed(np.column_stack([c[:, 0] + sign * c[:, 1] & 255, c[:, 1], c[:, 2] + sign * c[:, 1] & 255, c[:, 3]]))


def index_bits(colours: int) -> int:
    """Binary logarithm of the pixels that share one byte of indices."""
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def from_indices(pixels: np.ndarray, width: int, palette: np.ndarray) -> np.ndarray:
    share = index_bits(len(palette))
    green = (pixels >> 8 & 255).astype(np.int64)
    if share:
        each, depth = 1 << share, 8 >> share
        rows = green.reshape(-1, _parts(width, share))
        green = (rows[:, :, None] >> (np.arange(each) * depth) & ((1 << depth) - 1)).reshape(len(rows), -1)[:, :width].reshape(-1)
    full = np.zeros(256, np.uint32)
    full[: len(palette)] = palette
    return full[green]


def decode_image(data: bytes) -> tuple[int, int, np.ndarray, list[int]]:
    """Width, height, ARGB pixels and the transforms used, of a VP8L stream."""
    bits = Bits(data)
    if bits.take(8) != 0x2F:
        raise ValueError("not a lossless stream")
    width, height = bits.take(14) + 1, bits.take(14) + 1
    bits.take(1)
    if bits.take(3):
        raise ValueError("unknown version")
    undo, used, now = [], [], width
    while bits.take(1):
        kind = bits.take(2)
        if kind in used:
            raise ValueError("a transform is used twice")
        used.append(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            size = bits.take(3) + 2
            blocks = read_pixels(bits, _parts(now, size), _parts(height, size), False).reshape(_parts(height, size), -1)
            if kind == PREDICTOR:
                undo.append(lambda p, w=now, b=blocks >> 8 & 15, s=size: predictor(p, w, b, s))
            else:
                undo.append(lambda p, w=now, b=blocks, s=size: cross_colour(p, w, b, s))
        elif kind == SUBTRACT_GREEN:
            undo.append(subtract_green)
        else:
            n = bits.take(8) + 1
            steps = _channels(read_pixels(bits, n, 1, False)).astype(np.int64)
            palette = _packed(np.cumsum(steps, axis=0) & 255)
            undo.append(lambda p, w=now, c=palette: from_indices(p, w, c))
            now = _parts(now, index_bits(n))
    pixels = read_pixels(bits, now, height, True)
    for step in reversed(undo):
        pixels = step(pixels)
    return width, height, pixels, used


def unwrapped(stored: bytes) -> Iterator[bytes]:
    """The VP8L streams of one or more RIFF files that stand one after another."""
    at = 0
    while at < len(stored):
        if stored[at : at + 4] != b"RIFF" or stored[at + 8 : at + 12] != b"WEBP":
            raise ValueError("not a WebP file")
        end = at + 8 + int.from_bytes(stored[at + 4 : at + 8], "little")
        chunk, found = at + 12, False
        # An extended file has other chunks beside the stream; a chunk has an even number of bytes.
        while chunk + 8 <= end:
            size = int.from_bytes(stored[chunk + 4 : chunk + 8], "little")
            if stored[chunk : chunk + 4] == b"VP8L":
                found = True
                yield stored[chunk + 8 : chunk + 8 + size]
            chunk += 8 + size + (size & 1)
        if not found:
            raise ValueError("not a lossless WebP file")
        at = end


def wrapped(stream: bytes) -> bytes:
    body = b"WEBPVP8L" + len(stream).to_bytes(4, "little") + stream + b"\0" * (len(stream) & 1)
    return b"RIFF" + len(body).to_bytes(4, "little") + body


class Writer:
    """Writes bits, the lowest of a byte first."""

    def __init__(self) -> None:
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n


def huffman_lengths(weights: list[int], most: int = 15) -> tuple[int, ...]:
    """Code lengths of a prefix code for the weights; weights are evened out until none is too long."""
    while True:
        heap = [(w, i, (i,)) for i, w in enumerate(weights) if w]
        heapq.heapify(heap)
        lengths = [0] * len(weights)
        if len(heap) == 1:
            lengths[heap[0][1]] = 1
            return tuple(lengths)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for i in a[2] + b[2]:
                lengths[i] += 1
            heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
        if max(lengths) <= most:
            return tuple(lengths)
        weights = [w and (w + 1) // 2 + 1 for w in weights]


def put_code(out: Writer, lengths: tuple[int, ...]) -> None:
    """A code's lengths in the normal form, or in the simple one for a single symbol below 256."""
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) == 1 and used[0] < 256:
        out.put(0b101, 3)  # simple, one symbol, eight bits
        out.put(used[0], 8)
        return
    out.put(0, 1)
    symbols = list(_runs(lengths))
    counts = [0] * 19
    for symbol, *_ in symbols:
        counts[symbol] += 1
    outer = huffman_lengths(counts, 7)
    words = code(outer).words
    out.put(19 - 4, 4)
    for at in LENGTH_ORDER:
        out.put(outer[at], 3)
    out.put(0, 1)
    for symbol, extra, n in symbols:
        out.put(*words[symbol])
        out.put(extra, n)


def _runs(lengths: tuple[int, ...]) -> Iterator[tuple[int, int, int]]:
    """(symbol, extra bits, their number) that tell the code lengths: runs of a length are told as such."""
    before, at = 8, 0
    while at < len(lengths):
        value, n = lengths[at], 1
        while at + n < len(lengths) and lengths[at + n] == value:
            n += 1
        at += n
        if value and value != before:
            yield value, 0, 0
            before, n = value, n - 1
        while n:
            if value and n >= 3:
                k = min(n, 6)
                yield 16, k - 3, 2
            elif not value and n >= 11:
                k = min(n, 138)
                yield 18, k - 11, 7
            elif not value and n >= 3:
                k = min(n, 10)
                yield 17, k - 3, 3
            else:
                k = 1
                yield value, 0, 0
            n -= k


#: Fixed value: a specimen of running text whose letters stand for the usual weights of bytes.
SPECIMEN = (
    "the quick brown fox jumps over the lazy dog and then it is the end of that day in the town where other people are not there on sunday. "
    "der die das und nicht ist ein zu den mit sich auf für werden können über größer schön. le la les de des et que est une pour dans été où ça. "
    "el los las por con una para más año también. In 2024, about 15% of 370 items; \"quoted\" (see below): a-b/c? Yes! The End.\n"
)


@cache
def text_code() -> tuple[int, ...]:
    weights = np.bincount(np.frombuffer(SPECIMEN.encode(), np.uint8), minlength=256) * 12 + 1
    weights[0x80:0xC0] += 6
    return huffman_lengths([*weights.tolist(), *[0] * 24])


def flat_code() -> tuple[int, ...]:
    return (8,) * 256 + (0,) * 24


@cache
def _head(lengths: tuple[int, ...]) -> tuple[int, int]:
    """Everything between the size of an image without transforms and its pixels."""
    out = Writer()
    out.put(0, 1)  # no transform
    out.put(0, 1)  # no colour cache
    out.put(0, 1)  # one group of codes
    put_code(out, lengths)
    for channel in (lengths[:256], lengths[:256], (0,) * 255 + (1,), (1,) + (0,) * 39):
        put_code(out, channel)
    return out.value, out.n


@cache
def _tables(lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    words = code(lengths).words
    return tuple(np.array([words.get(s, (0, 0))[k] for s in range(256)], t) for k, t in enumerate((np.uint64, np.int64)))


def _joined(out: Writer, value: np.ndarray, size: np.ndarray) -> bytes:
    """The writer's bits and then the values of so many bits each."""
    if not len(value):
        return out.value.to_bytes(out.n + 7 >> 3, "little")
    at = np.cumsum(size) - size + (out.n & 31)
    shifted = value.astype(np.uint64) << (at & 31).astype(np.uint64)
    where = at >> 5
    total = int(at[-1] + size[-1]) + 31 >> 5
    # Bits of different symbols never meet, so adding them is as good as joining them.
    low = np.bincount(where, weights=(shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=total + 1)
    high = np.bincount(where + 1, weights=(shifted >> np.uint64(32)).astype(np.float64), minlength=total + 1)
    body = (low[: total + 1] + high[: total + 1]).astype(np.uint64).astype("<u4")
    whole = out.n & ~31
    body[0] |= np.uint32(out.value >> whole)
    data = (out.value & ((1 << whole) - 1)).to_bytes(whole // 8, "little") + body.tobytes()
    return data[: whole + int(at[-1] + size[-1]) + 7 >> 3]


def _opened(width: int, height: int) -> Writer:
    out = Writer()
    out.put(0x2F, 8)
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(0, 4)
    return out


#: Pixels that must repeat for a reference, and the longest one.
LEAST_REPEAT, MOST_REPEAT = 6, 4096


def repeats(pixels: np.ndarray) -> list[tuple[int, int, int]]:
    """(position, length, distance) of pieces that stand earlier in the image, greedily from the front."""
    n = len(pixels) - LEAST_REPEAT + 1
    if n < 2:
        return []
    key = np.zeros(n, np.uint64)
    for k in range(LEAST_REPEAT):
        key = (key ^ pixels[k : k + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    before = np.full(n, -1, np.int64)
    before[order[1:][same]] = order[:-1][same]
    found, at = [], 0
    for i in np.flatnonzero(before >= 0).tolist():
        if i < at:
            continue
        j = int(before[i])
        size, most = 0, min(MOST_REPEAT, len(pixels) - i)
        while size < most:  # compare in pieces that grow
            step = min(max(32, size), most - size)
            unlike = np.flatnonzero(pixels[i + size : i + size + step] != pixels[j + size : j + size + step])
            if len(unlike):
                size += int(unlike[0])
                break
            size += step
        if size >= LEAST_REPEAT:
            found.append((i, size, i - j))
            at = i + size
    return found


def _symbol_of(value: int) -> tuple[int, int, int]:
    """(prefix symbol, extra bits, their number) of a length or distance."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    n = v.bit_length() - 2
    return 2 * n + 2 + (v >> n & 1), v & ((1 << n) - 1), n


@cache
def _near_codes(width: int) -> dict[int, int]:
    """The short code of each distance that has one."""
    out: dict[int, int] = {}
    for k, (dx, dy) in enumerate(NEARBY, 1):
        out.setdefault(max(1, dx + dy * width), k)
    return out


def _entropy(values: np.ndarray, size: int = 256) -> float:
    """Bits that an ideal code takes for the values."""
    counts = np.bincount(values, minlength=size)
    counts = counts[counts > 0]
    return float((counts * np.log2(counts.sum() / counts)).sum())


#: Bits that a code's table takes, about; a plan is taken over the fixed code if it saves this share of its bits, for it is slower to read.
TABLE_BITS, WORTH = 450, 0.15
#: Share of the values that must be as predicted, or repeat, for a plan to be looked at.
SOME_ALIKE = 0.2
#: Plans are looked at where a quick general compressor needs less than this share of the fixed code's bits.
DENSE = 0.6


def coded_pixels(out: Writer, pixels: np.ndarray, width: int, top: bool, cache_bits: int = 0, found: list[tuple[int, int, int]] | None = None) -> bytes | None:
    """Pixels with codes of their own, references and a cache; ends the stream if ``top``, else the writer goes on."""
    found = (repeats(pixels) if top else []) if found is None else found
    near = _near_codes(width)
    literal = np.ones(len(pixels), bool)
    for i, n, _ in found:
        literal[i : i + n] = False
    where = np.flatnonzero(literal)
    c = _channels(pixels)
    green = c[:, 1].astype(np.int64)
    cached = np.zeros(len(pixels), bool)
    if cache_bits:
        # A literal is in the cache if the last pixel before it with its place there is the same one.
        slot = ((pixels.astype(np.uint64) * np.uint64(0x1E35A7BD) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - cache_bits)).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        hit = (slot[order][1:] == slot[order][:-1]) & (pixels[order][1:] == pixels[order][:-1])
        cached[order[1:][hit]] = True
        green = np.where(cached, 280 + slot, green)
    plain = where[~cached[where]]
    lengths = [_symbol_of(n) for _, n, _ in found]
    far = [_symbol_of(near.get(d, d + 120)) for _, _, d in found]
    counts = [np.bincount(np.r_[green[where], [256 + x[0] for x in lengths]].astype(np.int64), minlength=280 + (1 << cache_bits if cache_bits else 0))]
    counts += [np.bincount(c[plain, k], minlength=256) for k in (2, 0, 3)] + [np.bincount([x[0] for x in far], minlength=40)]
    codes = []
    for n in counts:
        if not n.any():
            n[0] = 1
        codes.append(huffman_lengths(n.tolist()))
    out.put(bool(cache_bits), 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if top:
        out.put(0, 1)  # one group of codes
    for x in codes:
        put_code(out, x)
    tables = []
    for x in codes:
        words = code(x).words
        tables.append((np.array([words.get(k, (0, 0))[0] for k in range(len(x))], np.uint64), np.array([words.get(k, (0, 0))[1] for k in range(len(x))], np.int64)))
    value, size = np.zeros((len(pixels), 4), np.uint64), np.zeros((len(pixels), 4), np.int64)
    value[where, 0], size[where, 0] = tables[0][0][green[where]], tables[0][1][green[where]]
    for k, channel in enumerate((2, 0, 3), 1):
        value[plain, k], size[plain, k] = tables[k][0][c[plain, channel]], tables[k][1][c[plain, channel]]
    for (i, _, _), (a, e, n), (b, f, m) in zip(found, lengths, far, strict=True):
        value[i] = [tables[0][0][256 + a], e, tables[4][0][b], f]
        size[i] = [tables[0][1][256 + a], n, tables[4][1][b], m]
    used = size.reshape(-1) > 0
    value, size = value.reshape(-1)[used], size.reshape(-1)[used]
    if top:
        return _joined(out, value, size)
    for v, n in zip(value.tolist(), size.tolist(), strict=True):
        out.put(v, n)
    return None


def _plans(pixels: np.ndarray, width: int, colours: np.ndarray, index: np.ndarray, found: list[tuple[int, int, int]]) -> list[tuple[float, str]]:
    """(bits, about; name) of the ways to store an image that may beat a fixed code."""
    c = _channels(pixels).astype(np.int64)
    grid = c.reshape(-1, width, 4)
    n, out = len(pixels), []
    if len(colours) <= 16:
        out.append((32 * len(colours) + n * (8 >> index_bits(len(colours))) / 2 + TABLE_BITS, "palette"))
    elif len(colours) <= 256 and 2 * len(colours) < n:
        out.append((32 * len(colours) + _entropy(index) + TABLE_BITS, "palette"))
    # What follows pays only where many values are as predicted; that is quickly seen.
    differ = lambda a, b: np.count_nonzero(a == b) < SOME_ALIKE * a.size
    channels = lambda a: sum(_entropy(a[..., k].ravel() & 255) for k in range(3)) + 3 * TABLE_BITS
    if not differ(c[:, 0], c[:, 1]) or not differ(c[:, 2], c[:, 1]):
        out.append((channels(c - c[:, 1:2] * [1, 0, 1, 0]), "green"))
    if not differ(c[:, 0], c[:, 2]):
        mixed = c.copy()
        mixed[:, 0] -= (c[:, 2] & 255) - ((c[:, 2] & 128) << 1)  # blue from red
        out.append((channels(mixed) + TABLE_BITS / 4, "cross"))
    if n > width and not differ(grid[1:, :, :3], grid[:-1, :, :3]):
        up = grid.copy()
        up[1:] -= grid[:-1]
        out.append((channels(up) + TABLE_BITS / 4, "up"))
    if not differ(grid[:, 1:, :3], grid[:, :-1, :3]):
        left = grid.copy()
        left[:, 1:] -= grid[:, :-1]
        out.append((channels(left) + TABLE_BITS / 4, "left"))
    repeated = sum(size for _, size, _ in found)
    if repeated >= SOME_ALIKE * n:
        rest = np.ones(n, bool)
        for i, size, _ in found:
            rest[i : i + size] = False
        out.append((channels(c[rest]) + 30 * len(found) + TABLE_BITS if rest.any() else 30 * len(found), "references"))
    if len(colours) * 3 < n:
        out.append((_entropy(index) + 24 * len(colours) + 2 * TABLE_BITS, "cache"))
    return out


def _blocks(out: Writer, kind: int, width: int, height: int, value: int) -> None:
    """A transform whose blocks, as large as can be, all have one value."""
    out.put(1, 1)
    out.put(kind, 2)
    out.put(7, 3)  # blocks of 512 pixels a side
    coded_pixels(out, np.full(_parts(width, 9) * _parts(height, 9), value, np.uint32), _parts(width, 9), False)


def encode_image(samples: np.ndarray, width: int) -> bytes:
    """A VP8L stream of red, green, blue samples.

    The cheaper of two fixed codes, or whichever of a palette, a predictor, a mix
    of channels, references or a colour cache saves ``WORTH`` of its bits. The choice
    depends on the samples alone.
    """
    counts = np.bincount(samples, minlength=256)
    lengths = min((text_code(), flat_code()), key=lambda c: (int(counts @ _tables(c)[1]), c == flat_code()))
    fixed = int(counts @ _tables(lengths)[1]) + _head(lengths)[1]
    height = len(samples) // (3 * width)
    rgb = samples.reshape(-1, 3).astype(np.uint32)
    pixels = np.uint32(0xFF000000) | rgb[:, 0] << np.uint32(16) | rgb[:, 1] << np.uint32(8) | rgb[:, 2]
    if 8 * len(zlib.compress(samples.tobytes(), 1)) > DENSE * fixed:
        bits, plan = fixed, ""  # next to nothing repeats
    else:
        colours, index = np.unique(pixels, return_inverse=True)
        found = repeats(pixels)
        bits, plan = min(_plans(pixels, width, colours, index, found), default=(fixed, ""))
    out = _opened(width, height)
    if bits > (1 - WORTH) * fixed:
        head, n = _head(lengths)
        out.put(head, n)
        words, sizes = _tables(lengths)
        s = samples.reshape(-1, 3)[:, [1, 0, 2]].reshape(-1)
        return _joined(out, words[s], sizes[s])
    cache_bits, across = 0, width
    if plan == "palette":
        out.put(1, 1)
        out.put(INDEXING, 2)
        out.put(len(colours) - 1, 8)
        steps = np.diff(np.concatenate([np.zeros((1, 4), np.int64), _channels(colours).astype(np.int64)]), axis=0) & 255
        coded_pixels(out, _packed(steps), len(colours), False)
        share = index_bits(len(colours))
        across = _parts(width, share)
        each = np.zeros((height, across << share), np.uint32)
        each[:, :width] = index.reshape(height, width)
        each = each.reshape(height, across, 1 << share) << (np.arange(1 << share, dtype=np.uint32) * np.uint32(8 >> share))
        pixels = np.uint32(0xFF000000) | np.bitwise_or.reduce(each, axis=2).reshape(-1) << np.uint32(8)
    elif plan in ("up", "left"):
        mode = 2 if plan == "up" else 1
        _blocks(out, PREDICTOR, width, height, 0xFF000000 | mode << 8)
        pixels = predictor(pixels, width, np.full((_parts(height, 9), _parts(width, 9)), mode), 9, invert=False)
    elif plan == "green":
        out.put(1, 1)
        out.put(SUBTRACT_GREEN, 2)
        pixels = subtract_green(pixels, invert=False)
    elif plan == "cross":
        # All of red goes into blue: 32 of 32 parts.
        _blocks(out, CROSS_COLOUR, width, height, 0xFF000000 | 32 << 16)
        pixels = cross_colour(pixels, width, np.full((_parts(height, 9), _parts(width, 9)), 0xFF000000 | 32 << 16, np.uint32), 9, invert=False)
    elif plan == "cache":
        cache_bits = min(11, max(4, int(np.ceil(np.log2(len(colours)))) + 1))
    out.put(0, 1)
    return coded_pixels(out, pixels, across, True, cache_bits, found if plan in ("references", "cache") else None)


def payload(text: str | None) -> tuple[bytes, int]:
    """The stored payload of a text and its length before filling."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * ((-len(raw)) % UNIT or (UNIT if not raw else 0)), len(raw)


def stored(data: bytes) -> bytes:
    """The payload as one or more WebP files."""
    most = WIDTH * 3 * IMAGE_ROWS
    return b"".join(wrapped(encode_image(np.frombuffer(data[i : i + most], np.uint8), WIDTH)) for i in range(0, len(data), most))


def restored(media: bytes) -> tuple[bytes, list[tuple[int, int, list[int]]]]:
    """The payload read back, and each image's width, height and transforms."""
    parts, shapes = [], []
    for stream in unwrapped(media):
        width, height, pixels, used = decode_image(stream)
        parts.append(np.ascontiguousarray(_channels(pixels)[:, 2::-1]).tobytes())
        shapes.append((width, height, used))
    return b"".join(parts), shapes


def media_columns(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, media binary: each text stored as WebP."""
    inputs = docs.select(F.col(key), text_or_empty(text).alias("_text"))
    schema = inputs.select(F.col(key), F.lit(0).cast("long").alias("n_bytes"), F.lit(b"").alias("media")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                made = [(n, stored(data)) for data, n in map(payload, batch.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in made], pa.int64()), pa.array([m for _, m in made], pa.binary())], names=[key, "n_bytes", "media"])

    return inputs.mapInArrow(run, schema)


def described(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """Digests and features of stored media, from the stored bytes."""
    schema = media.select(
        F.col(key), "n_bytes", F.lit(0).cast("long").alias("payload_bytes"), F.lit("").alias("payload_sha256"), F.lit(0).cast("long").alias("tail_crc32"),
        F.lit(0).cast("long").alias("media_bytes"), F.lit("").alias("media_sha256"), F.lit("").alias("feature"),
    ).schema

    def told(data: bytes) -> tuple:
        back, shapes = restored(data)
        samples = np.frombuffer(back, np.uint8)
        counts = np.bincount(samples, minlength=256)
        share = counts[counts > 0] / len(samples)
        feature = f"images={len(shapes)} width={shapes[0][0]} height={sum(h for _, h, _ in shapes)} mean={samples.mean():.3f} entropy={-(share * np.log2(share)).sum():.3f} distinct={len(share)}"
        return len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [told(m.as_py()) for m in batch.column(2)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=schema.names)

    return media.mapInArrow(run, schema)


def op7_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return described(media_columns(table(spark, sf_dir, "documents")))


QUERIES = {"op7_webp": op7_webp}
#: Image files have no SQL; the tests hold the query to exact round trips.
ORACLE_SQL: dict[str, str] = {}
