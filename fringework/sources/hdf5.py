"""Reading HDF5 files without their library: groups, attributes and chunked datasets, and an image as a Spark data source.

The file is read by ranges through arrow's file systems, so only the chunks that
a partition needs are fetched, and each is inflated by the task that wants it.
Read are superblocks 0 to 3, object headers 1 and 2, symbol-table and compact
groups, and contiguous, compact and chunked layouts (version-1 index, and a single
chunk of newer ones) with deflate and byte shuffling. Anything else is an error
that says what is missing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from fringework.functions.tiling import block_shape, directly_decodable
from fringework.operators.geometry import to_tmerc
from fringework.sources.granule import _opened

SIGNATURE = b"\x89HDF\r\n\x1a\n"
_FILTERS = {1: "gzip", 2: "shuffle", 3: "fletcher32", 4: "szip", 5: "nbit", 6: "scaleoffset"}
SCHEMA = "yi long, xi long, y double, x double, re float, im float"


class Unsupported(ValueError):
    """Something that this reader does not read."""


@dataclass
class Chunk:
    """A stored block: where it begins in the dataset, and where and how it lies in the file."""

    at: tuple[int, ...]
    address: int
    size: int
    skipped: int  # bits of filters that were not applied


@dataclass
class Dataset:
    file: File
    shape: tuple[int, ...]
    dtype: np.dtype | None
    layout: tuple
    filters: list[tuple[int, tuple[int, ...]]]
    fill: bytes | None
    attrs: dict

    @property
    def chunks(self) -> tuple[int, ...] | None:
        return self.layout[2] if self.layout[0] == "chunked" else None

    @property
    def decodable(self) -> bool:
        kind = "c" if self.dtype is not None and self.dtype.kind == "c" else self.dtype.kind if self.dtype is not None else "O"
        return directly_decodable(self.chunks, [_FILTERS.get(i, str(i)) for i, _ in self.filters], kind)

    @cached_property
    def index(self) -> dict[tuple[int, ...], Chunk]:
        if self.layout[0] != "chunked":
            return {}
        return {c.at: c for c in self.file.chunks_of(self)}

    def blank(self, shape: tuple[int, ...]) -> np.ndarray:
        out = np.zeros(shape, self.dtype)
        if self.fill:
            out[...] = np.frombuffer(self.fill, self.dtype)[0]
        return out

    def chunk(self, at: tuple[int, ...]) -> np.ndarray:
        """One whole block; one that was never written is fill."""
        found = self.index.get(at)
        return self.blank(self.chunks) if found is None else self.decoded(self.file.read(found.address, found.size), found.skipped)

    def decoded(self, raw: bytes, skipped: int = 0) -> np.ndarray:
        for k, (kind, values) in reversed(list(enumerate(self.filters))):
            if skipped >> k & 1:
                continue
            if kind == 1:
                raw = zlib.decompress(raw)
            elif kind == 2:
                size = values[0] if values else self.dtype.itemsize
                n = len(raw) // size
                raw = np.frombuffer(raw, np.uint8)[: n * size].reshape(size, n).T.tobytes() + raw[n * size :]
            else:
                raise Unsupported(f"the filter {_FILTERS.get(kind, kind)}")
        return np.frombuffer(raw, self.dtype, int(np.prod(self.chunks))).reshape(self.chunks)

    def read(self, window: tuple[tuple[int, int], ...] | None = None) -> np.ndarray:
        """The values in a window of (first, past the last) by axis; only blocks that it touches are read."""
        window = window or tuple((0, n) for n in self.shape)
        if self.layout[0] == "chunked":
            out = self.blank(tuple(b - a for a, b in window))
            for cell in np.ndindex(*(-(-b // c) - a // c for (a, b), c in zip(window, self.chunks, strict=True))):
                at = tuple((a // c + k) * c for (a, _), c, k in zip(window, self.chunks, cell, strict=True))
                block = self.chunk(at)
                low = [max(a, s) for (a, _), s in zip(window, at, strict=True)]
                high = [min(b, s + c) for (_, b), s, c in zip(window, at, self.chunks, strict=True)]
                if all(x < y for x, y in zip(low, high, strict=True)):
                    out[tuple(slice(x - a, y - a) for (a, _), x, y in zip(window, low, high, strict=True))] = block[tuple(slice(x - s, y - s) for s, x, y in zip(at, low, high, strict=True))]
            return out
        n = int(np.prod(self.shape, dtype=np.int64))
        size = n * self.dtype.itemsize
        raw = self.layout[1] if self.layout[0] == "compact" else b"" if self.layout[1] is None else self.file.read(self.layout[1], size)
        whole = np.frombuffer(raw[:size], self.dtype).reshape(self.shape) if raw else self.blank(self.shape)
        return whole[tuple(slice(a, b) for a, b in window)]

    def value(self) -> object:
        """A scalar, with text decoded."""
        return _plain(self.read().reshape(-1)[0])


def _plain(v: object) -> object:
    if isinstance(v, bytes):
        return v.split(b"\0")[0].decode().strip()
    return v.item() if hasattr(v, "item") else v


@dataclass
class Group:
    file: File
    links: dict[str, int]
    attrs: dict

    def __getitem__(self, path: str) -> Group | Dataset:
        now: Group | Dataset = self
        for name in path.strip("/").split("/"):
            if not isinstance(now, Group) or name not in now.links:
                raise KeyError(path)
            now = self.file.object(now.links[name])
        return now

    def __contains__(self, path: str) -> bool:
        try:
            self[path]
        except KeyError:
            return False
        return True


@dataclass
class File:
    path: str
    content: bytes | None = None
    _kept: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.content is None:
            files, base = _opened(self.path)
            self.handle = files.open_input_file(base)
        head = self.read(0, 96)
        if head[:8] != SIGNATURE:
            raise Unsupported(f"{self.path} is no HDF5 file")
        version = head[8]
        if version < 2:
            self.offset, self.length = head[13], head[14]
            at = 24 + (4 if version == 1 else 0)
            self.base = self._int(head, at, self.offset)
            root = self._int(head, at + 4 * self.offset + self.offset, self.offset)
        else:
            self.offset, self.length = head[9], head[10]
            self.base = self._int(head, 12, self.offset)
            root = self._int(head, 12 + 3 * self.offset, self.offset)
        self.root = self.object(root)

    @staticmethod
    def _int(data: bytes, at: int, size: int) -> int:
        return int.from_bytes(data[at : at + size], "little")

    def _missing(self, address: int) -> bool:
        return address == (1 << 8 * self.offset) - 1

    def read(self, at: int, size: int) -> bytes:
        if self.content is None:
            return self.handle.read_at(size, at + getattr(self, "base", 0))
        at += getattr(self, "base", 0)
        return self.content[at : at + size]

    def _messages(self, address: int) -> Iterator[tuple[int, bytes]]:
        head = self.read(address, 16)
        if head[:4] == b"OHDR":
            flags, at = head[5], 6
            at += (16 if flags & 0x20 else 0) + (4 if flags & 0x10 else 0)
            wide = 1 << (flags & 3)
            size = self._int(self.read(address + at, wide), 0, wide)
            blocks, extra = [(address + at + wide, size)], 2 if flags & 4 else 0
            while blocks:
                start, size = blocks.pop(0)
                data, p = self.read(start, size), 0
                if data[:4] == b"OCHK":
                    data, p = data[:-4], 4
                while p + 4 + extra <= len(data):
                    kind, n = data[p], self._int(data, p + 1, 2)
                    body = data[p + 4 + extra : p + 4 + extra + n]
                    p += 4 + extra + n
                    if kind == 0x10:
                        blocks.append((self._int(body, 0, self.offset), self._int(body, self.offset, self.length)))
                    else:
                        yield kind, body
            return
        if head[0] != 1:
            raise Unsupported(f"an object header of version {head[0]}")
        left, blocks = self._int(head, 2, 2), [(address + 16, self._int(head, 8, 4))]
        while blocks and left:
            start, size = blocks.pop(0)
            data, p = self.read(start, size), 0
            while p + 8 <= len(data) and left:
                kind, n = self._int(data, p, 2), self._int(data, p + 2, 2)
                body = data[p + 8 : p + 8 + n]
                p, left = p + 8 + n, left - 1
                if kind == 0x10:
                    blocks.append((self._int(body, 0, self.offset), self._int(body, self.offset, self.length)))
                else:
                    yield kind, body

    def object(self, address: int) -> Group | Dataset:
        if address not in self._kept:
            self._kept[address] = self._object(address)
        return self._kept[address]

    def _object(self, address: int) -> Group | Dataset:
        links: dict[str, int] = {}
        attrs: dict = {}
        shape = dtype = layout = fill = None
        filters: list = []
        for kind, body in self._messages(address):
            if kind == 0x01:
                shape = self._shape(body)
            elif kind == 0x03:
                dtype = self._dtype(body)[0]
            elif kind in (0x04, 0x05):
                fill = self._fill(kind, body) or fill
            elif kind == 0x06:
                links.update(self._link(body))
            elif kind == 0x02 and not self._missing(self._int(body, 2 + (8 if body[1] & 1 else 0), self.offset)):
                raise Unsupported("a group with dense links")
            elif kind == 0x08:
                layout = self._layout(body)
            elif kind == 0x0B:
                filters = self._pipeline(body)
            elif kind == 0x0C:
                name, value = self._attribute(body)
                attrs[name] = value
            elif kind == 0x11:
                links.update(self._symbols(self._int(body, 0, self.offset), self._int(body, self.offset, self.offset)))
        if layout is None:
            return Group(self, links, attrs)
        if layout[0] == "chunked":
            layout = (layout[0], layout[1], layout[2][: len(shape)], *layout[3:])
        return Dataset(self, shape, dtype, layout, filters, fill, attrs)

    def _shape(self, body: bytes) -> tuple[int, ...]:
        at = 8 if body[0] == 1 else 4
        return tuple(self._int(body, at + k * self.length, self.length) for k in range(body[1]))

    def _dtype(self, body: bytes) -> tuple[np.dtype, int]:
        """The type and the bytes it is told in; a pair of equal floats is a complex number."""
        kind, version, bits, size = body[0] & 15, body[0] >> 4, self._int(body, 1, 3), self._int(body, 4, 4)
        order = ">" if bits & 1 else "<"
        if kind == 0:
            return np.dtype(f"{order}{'i' if bits & 8 else 'u'}{size}"), 12
        if kind == 1:
            return np.dtype(f"{order}f{size}"), 20
        if kind == 3:
            return np.dtype(f"S{size}"), 8
        if kind == 9:  # a length, an address and an index into a heap
            return np.dtype([("n", "<u4"), ("address", f"<u{self.offset}"), ("index", "<u4")]), 8 + self._dtype(body[8:])[1]
        if kind == 8:  # named numbers: told by their own type first
            return self._dtype(body[8:])[0], len(body)
        if kind != 6:
            raise Unsupported(f"values of class {kind}")
        at, names, formats, offsets = 8, [], [], []
        for _ in range(bits & 0xFFFF):
            end = body.index(b"\0", at)
            names.append(body[at:end].decode())
            at = end + 1 if version >= 3 else at + -(-(end + 1 - at) // 8) * 8
            wide = 4 if version < 3 else max(1, (size.bit_length() + 7) // 8)
            offsets.append(self._int(body, at, wide))
            at += wide + (28 if version == 1 else 0)
            inner, n = self._dtype(body[at:])
            formats.append(inner)
            at += n
        if len(names) == 2 and formats[0] == formats[1] and formats[0].kind == "f":
            return np.dtype(f"{formats[0].byteorder.replace('=', '<').replace('|', '<')}c{2 * formats[0].itemsize}"), at
        return np.dtype({"names": names, "formats": formats, "offsets": offsets, "itemsize": size}), at

    def _fill(self, kind: int, body: bytes) -> bytes | None:
        if kind == 0x04:
            return body[4 : 4 + self._int(body, 0, 4)] or None
        if body[0] < 3:
            return body[8 : 8 + self._int(body, 4, 4)] or None if body[0] == 1 or body[3] else None
        return body[6 : 6 + self._int(body, 2, 4)] or None if body[1] & 0x20 else None

    def _link(self, body: bytes) -> dict[str, int]:
        flags, at = body[1], 2
        kind = body[at] if flags & 8 else 0
        at += (1 if flags & 8 else 0) + (8 if flags & 4 else 0) + (1 if flags & 16 else 0)
        wide = 1 << (flags & 3)
        n = self._int(body, at, wide)
        name = body[at + wide : at + wide + n].decode()
        return {name: self._int(body, at + wide + n, self.offset)} if kind == 0 else {}

    def _layout(self, body: bytes) -> tuple:
        if body[0] not in (3, 4):
            raise Unsupported(f"a layout of version {body[0]}")
        if body[1] == 0:
            return "compact", body[4 : 4 + self._int(body, 2, 2)]
        if body[1] == 1:
            address = self._int(body, 2, self.offset)
            return "contiguous", None if self._missing(address) else address
        if body[0] == 3:
            n = body[2]
            address = self._int(body, 3, self.offset)
            dims = tuple(self._int(body, 3 + self.offset + 4 * k, 4) for k in range(n))
            return "chunked", None if self._missing(address) else address, dims[:-1], "tree", n
        flags, n, wide = body[2], body[3], body[4]
        dims = tuple(self._int(body, 5 + wide * k, wide) for k in range(n))
        at = 5 + wide * n
        if body[at] != 1:
            raise Unsupported(f"a chunk index of kind {body[at]}")
        size = self._int(body, at + 1, self.length) if flags & 2 else None
        at += 1 + (self.length + 4 if flags & 2 else 0)
        address = self._int(body, at, self.offset)
        return "chunked", None if self._missing(address) else address, dims[:-1], "single", size

    def _pipeline(self, body: bytes) -> list[tuple[int, tuple[int, ...]]]:
        version, out = body[0], []
        at = 8 if version == 1 else 2
        for _ in range(body[1]):
            kind = self._int(body, at, 2)
            named = version == 1 or kind >= 256
            name = self._int(body, at + 2, 2) if named else 0
            at += 4 if named else 2
            count = self._int(body, at + 2, 2)
            at += 4 + (-(-name // 8) * 8 if version == 1 else name)
            out.append((kind, tuple(self._int(body, at + 4 * k, 4) for k in range(count))))
            at += 4 * count + (4 if version == 1 and count % 2 else 0)
        return out

    def _attribute(self, body: bytes) -> tuple[str, object]:
        version = body[0]
        sizes = [self._int(body, 2 + 2 * k, 2) for k in range(3)]
        at = 9 if version == 3 else 8
        padded = (lambda n: -(-n // 8) * 8) if version == 1 else (lambda n: n)
        name = body[at : at + sizes[0]].split(b"\0")[0].decode()
        at += padded(sizes[0])
        kind = body[at : at + sizes[1]]
        dtype = self._dtype(kind)[0]
        at += padded(sizes[1])
        shape = self._shape(body[at : at + sizes[2]])
        at += padded(sizes[2])
        values = np.frombuffer(body[at : at + int(np.prod(shape, dtype=int)) * dtype.itemsize], dtype)
        if kind[0] & 15 == 9:
            values = np.array([self._heaped(v) for v in values], object)
        return name, _plain(values[0]) if values.size == 1 else values.reshape(shape)

    def _heaped(self, v: np.void) -> bytes:
        """An object of a global heap."""
        head = self.read(int(v["address"]), 8 + self.length)
        data, p = self.read(int(v["address"]), self._int(head, 8, self.length)), 8 + self.length
        while p + 8 + self.length <= len(data):
            index, size = self._int(data, p, 2), self._int(data, p + 8, self.length)
            if index == int(v["index"]):
                return bytes(data[p + 8 + self.length : p + 8 + self.length + size][: int(v["n"])])
            if not index:
                break
            p += 8 + self.length + -(-size // 8) * 8
        return b""

    def _symbols(self, tree: int, heap: int) -> dict[str, int]:
        head = self.read(heap, 8 + 2 * self.length + self.offset)
        names = self.read(self._int(head, 8 + 2 * self.length, self.offset), self._int(head, 8, self.length))
        out: dict[str, int] = {}
        for node in self._leaves(tree, self.length):
            found = self.read(node, 8)
            entry = 2 * self.offset + 24
            data = self.read(node + 8, entry * self._int(found, 6, 2))
            for k in range(self._int(found, 6, 2)):
                at = self._int(data, k * entry, self.offset)
                out[names[at : names.index(b"\0", at)].decode()] = self._int(data, k * entry + self.offset, self.offset)
        return out

    def _entries(self, address: int, key: int) -> Iterator[tuple[int, bytes, int]]:
        """(level, key, child) of a version-1 tree's node."""
        head = self.read(address, 8 + 2 * self.offset)
        if head[:4] != b"TREE":
            raise Unsupported("an index that is no tree")
        n, step = self._int(head, 6, 2), key + self.offset
        data = self.read(address + 8 + 2 * self.offset, n * step + key)
        for k in range(n):
            yield head[5], data[k * step : k * step + key], self._int(data, k * step + key, self.offset)

    def _leaves(self, address: int, key: int) -> Iterator[int]:
        for level, _, child in self._entries(address, key):
            if level:
                yield from self._leaves(child, key)
            else:
                yield child

    def chunks_of(self, d: Dataset) -> Iterator[Chunk]:
        _, address, dims, kind, extra = d.layout
        if address is None:
            return
        if kind == "single":
            yield Chunk((0,) * len(dims), address, extra or int(np.prod(dims)) * d.dtype.itemsize, 0)
            return
        todo = [address]
        while todo:
            for level, key, child in self._entries(todo.pop(), 8 + 8 * extra):
                if level:
                    todo.append(child)
                else:
                    yield Chunk(tuple(self._int(key, 8 + 8 * k, 8) for k in range(extra - 1)), child, self._int(key, 0, 4), self._int(key, 4, 4))


def grid_of(path: str, content: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(z, y, x) of a grid file: its ``z`` or first dataset of two axes, and those by the usual names or by index."""
    root = File(path, content).root
    held = {n: root[n] for n in root.links if isinstance(root[n], Dataset)}
    flat = [n for n, d in held.items() if len([k for k in d.shape if k > 1]) == 2]
    if not flat:
        raise Unsupported(f"{path} has no grid")
    z = held["z" if "z" in flat else flat[0]].read().astype(float).squeeze()
    axes = [next((held[n].read().astype(float) for n in names if n in held and held[n].shape == (size,)), np.arange(size, dtype=float)) for names, size in zip((("y", "lat", "latitude"), ("x", "lon", "longitude")), z.shape, strict=True)]
    return z, *axes


# Granules: fixed values of the product's layout.
GRID = "science/LSAR/{product}/grids/frequency{frequency}"
IDENTIFICATION = "science/LSAR/identification"
RADAR_GRID = "science/LSAR/{product}/metadata/radarGrid"
CUBE = {"incidence_angle": "incidenceAngle", "look_angle": "elevationAngle", "los_east": "losUnitVectorX", "los_north": "losUnitVectorY"}


def granule_metadata(path: str, frequency: str = "A", product: str = "GSLC") -> dict:
    """Axes, epsg, pass direction, start time (or None), look side and centre frequency; the axes must be monotonic."""
    f = File(path)
    grid, ident = f.root[GRID.format(product=product, frequency=frequency)], f.root[IDENTIFICATION]
    at = grid if "xCoordinates" in grid else grid["unwrappedInterferogram"]
    x, y = (at[f"{a}Coordinates"].read().astype(float) for a in "xy")
    direction = ident["orbitPassDirection"].value()
    if direction not in ("Ascending", "Descending"):
        raise ValueError(f"unknown pass direction {direction!r}")
    for name, axis in (("x", x), ("y", y)):
        d = np.diff(axis)
        if not ((d > 0).all() or (d < 0).all()):
            raise ValueError(f"the {name} axis is not monotonic")
    text = lambda name: ident[name].value() if name in ident else None
    return {
        "x": x, "y": y, "epsg": int(at["projection"].attrs.get("epsg_code", 0) or at["projection"].value()), "direction": direction, "time": text("zeroDopplerStartTime"),
        "look": text("lookDirection"), "center_frequency": float(grid["centerFrequency"].value()) if "centerFrequency" in grid else None,
    }


def geometry_cube(path: str, product: str = "GSLC") -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray, int]:
    """Layers (height, y, x) of look geometry, the three axes, and the epsg; a few megabytes whatever the scene."""
    g = File(path).root[RADAR_GRID.format(product=product)]
    axes = [g[n].read().astype(float) for n in ("heightAboveEllipsoid", "yCoordinates", "xCoordinates")]
    p = g["projection"]
    return {k: g[n].read() for k, n in CUBE.items()}, *axes, int(p.attrs.get("epsg_code", 0) or p.value())


def native_box(epsg: int, lon: tuple[float, float], lat: tuple[float, float]) -> tuple[tuple[float, float], tuple[float, float]]:
    """The box around the four corners of a lon/lat box, in the UTM zone ``epsg`` (or as it is for 4326)."""
    if epsg == 4326:
        return tuple(sorted(lon)), tuple(sorted(lat))
    if not (32601 <= epsg <= 32660 or 32701 <= epsg <= 32760):
        raise Unsupported(f"the projection {epsg}")
    lon0 = (epsg % 100) * 6 - 183.0
    corners = [to_tmerc(a, b, lon0) for a in lon for b in lat]
    south = 10_000_000.0 if epsg >= 32700 else 0.0
    xs, ys = [c[0] for c in corners], [c[1] + south for c in corners]
    return (min(xs), max(xs)), (min(ys), max(ys))


def index_window(axis: np.ndarray, low: float, high: float) -> tuple[int, int]:
    """(first, past the last) of the samples between two values, whichever way the axis runs."""
    inside = np.flatnonzero((axis >= low) & (axis <= high))
    if not len(inside):
        raise ValueError("the box lies outside the granule")
    return int(inside[0]), int(inside[-1]) + 1


class Blocks(InputPartition):
    def __init__(self, rows: tuple[int, int], columns: tuple[int, int]) -> None:
        self.rows, self.columns = rows, columns


class ImageReader(DataSourceReader):
    """Options: ``path``, ``dataset``, and ``y0, y1, x0, x1``; a partition is some whole stored chunks of the crop."""

    def __init__(self, options: dict) -> None:
        self.path, self.name = options["path"], options["dataset"]
        f = File(self.path)
        d = f.root[self.name]
        if not d.decodable and d.chunks is not None:
            raise Unsupported(f"{self.name}: chunks {d.chunks} with {[_FILTERS.get(i, i) for i, _ in d.filters]}")
        ny, nx = d.shape
        bound = lambda k, most: min(int(options.get(k, most)), most)
        self.rows, self.columns = (int(options.get("y0", 0)), bound("y1", ny)), (int(options.get("x0", 0)), bound("x1", nx))
        # The axes stand beside the image, or beside its group.
        beside = [self.name.rpartition("/")[0], self.name.rpartition("/")[0].rpartition("/")[0]]
        found = {a: next((f"{g}/{a}Coordinates" for g in beside if f"{g}/{a}Coordinates" in f.root), None) for a in "yx"}
        self.axes = [f.root[found[a]].read().astype(float) if found[a] else np.arange(n, dtype=float) for a, n in zip("yx", d.shape, strict=True)]
        self.chunk = d.chunks or (min(ny, 512), min(nx, 512))
        self.cores = int(options.get("cores", 8))

    def partitions(self) -> list[Blocks]:
        (y0, y1), (x0, x1) = self.rows, self.columns
        cy, cx = self.chunk
        h, w = (max(n // c, 1) * c for n, c in zip(block_shape(y1 - y0, x1 - x0, self.chunk, self.cores), self.chunk, strict=True))
        cuts = lambda a, b, c, size: [(max(a, s), min(b, s + size)) for s in range(a // c * c, b, size)]
        return [Blocks(r, c) for r in cuts(y0, y1, cy, h) for c in cuts(x0, x1, cx, w)]

    def read(self, part: Blocks) -> Iterator[pa.RecordBatch]:
        d = File(self.path).root[self.name]
        (y0, y1), (x0, x1) = part.rows, part.columns
        step = max(1, 200_000 // max(1, x1 - x0))
        for at in range(y0, y1, step):
            upto = min(y1, at + step)
            values = d.read(((at, upto), (x0, x1))).ravel()
            yi, xi = np.repeat(np.arange(at, upto), x1 - x0), np.tile(np.arange(x0, x1), upto - at)
            void = ~np.isfinite(values)
            real = lambda v: pa.array(v.astype(np.float32), mask=void)
            arrays = [pa.array(yi), pa.array(xi), pa.array(self.axes[0][yi]), pa.array(self.axes[1][xi]), real(values.real), real(values.imag if values.dtype.kind == "c" else np.zeros(len(values)))]
            yield pa.RecordBatch.from_arrays(arrays, names=["yi", "xi", "y", "x", "re", "im"])


class Hdf5Image(DataSource):
    """``spark.dataSource.register(Hdf5Image)``, then ``spark.read.format("hdf5image").option("dataset", name).load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "hdf5image"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ImageReader:
        return ImageReader(self.options)


def open_granule(spark: SparkSession, path: str, frequency: str = "A", polarization: str = "HH", lon: tuple[float, float] | None = None, lat: tuple[float, float] | None = None) -> tuple[DataFrame, dict]:
    """The image of a granule as pixels (yi, xi, y, x, re, im), cropped to a lon/lat box where given, and its metadata."""
    meta = granule_metadata(path, frequency)
    reader = spark.read.format("hdf5image").option("dataset", f"{GRID.format(product='GSLC', frequency=frequency)}/{polarization}").option("cores", spark.sparkContext.defaultParallelism)
    if lon is not None and lat is not None:
        bx, by = native_box(meta["epsg"], lon, lat)
        for name, axis, (low, high) in (("x", meta["x"], bx), ("y", meta["y"], by)):
            first, last = index_window(axis, low, high)
            reader = reader.option(f"{name}0", first).option(f"{name}1", last)
    spark.dataSource.register(Hdf5Image)
    return reader.load(path), meta


#: Layers of an unwrapped product and the names they get.
UNWRAPPED = {"unwrappedPhase": "unw", "coherenceMagnitude": "coherence", "connectedComponents": "conncomp", "ionospherePhaseScreen": "phase_screen"}


def open_unwrapped(spark: SparkSession, path: str, frequency: str = "A", polarization: str = "HH") -> tuple[DataFrame, dict]:
    """The layers of an unwrapped granule as one table (yi, xi, y, x, ...); a layer that is not there is left out."""
    meta = granule_metadata(path, frequency, "GUNW")
    spark.dataSource.register(Hdf5Image)
    group = f"{GRID.format(product='GUNW', frequency=frequency)}/unwrappedInterferogram"
    root = File(path).root
    out = None
    layers = [(f"{group}/{polarization}/{n}", to) for n, to in UNWRAPPED.items()] + [(f"{group}/mask", "subswath_mask")]
    for name, to in layers:
        if name not in root:
            continue
        df = spark.read.format("hdf5image").option("dataset", name).load(path).selectExpr("yi", "xi", f"re AS {to}")
        out = df if out is None else out.join(df, ["yi", "xi"])
    return out, meta
