"""The reader against files put together here byte by byte from the published format."""

import struct
import zlib

import numpy as np
import pytest

from fringework.operators.geometry import to_tmerc
from fringework.sources import hdf5 as H

NONE = 0xFFFFFFFFFFFFFFFF


class Composer:
    """Superblock 0, symbol-table groups, version-1 headers: what files of the usual libraries look like."""

    def __init__(self):
        self.data = bytearray(96)

    def put(self, raw):
        self.data += b"\0" * (-len(self.data) % 8)
        at = len(self.data)
        self.data += raw
        return at

    def header(self, messages):
        body = b"".join(struct.pack("<HHB3x", k, len(m) + -len(m) % 8, 0) + m + b"\0" * (-len(m) % 8) for k, m in messages)
        return self.put(struct.pack("<BxHII4x", 1, len(messages), 1, len(body)) + body)

    @staticmethod
    def kind(dtype):
        dtype = np.dtype(dtype)
        if dtype.kind == "S":
            return struct.pack("<B3BI", 0x13, 0, 0, 0, dtype.itemsize)
        if dtype.kind in "iu":
            return struct.pack("<B3BIHH", 0x10, 8 if dtype.kind == "i" else 0, 0, 0, dtype.itemsize, 0, 8 * dtype.itemsize)
        size = dtype.itemsize
        if dtype.kind == "f":
            e, m, bias = (8, 23, 127) if size == 4 else (11, 52, 1023)
            return struct.pack("<B3BIHHBBBBI", 0x11, 0x20, 8 * size - 1, 0, size, 0, 8 * size, m, e, 0, m, bias)
        part = Composer.kind(f"f{size // 2}")
        member = lambda n, off: n.ljust(8, b"\0") + struct.pack("<IB3xI4x4I", off, 0, 0, 0, 0, 0, 0) + part
        return struct.pack("<B3BI", 0x16, 2, 0, 0, size) + member(b"r", 0) + member(b"i", size // 2)

    @staticmethod
    def space(shape):
        return struct.pack("<BBB5x", 1, len(shape), 0) + b"".join(struct.pack("<Q", n) for n in shape)

    def attribute(self, name, value):
        value = np.asarray(value)
        pad = lambda b: b + b"\0" * (-len(b) % 8)
        kind, space, raw = self.kind(value.dtype), self.space(value.shape), name.encode() + b"\0"
        return 0x0C, struct.pack("<BxHHH", 1, len(raw), len(kind), len(space)) + pad(raw) + pad(kind) + pad(space) + value.tobytes()

    def dataset(self, a, chunks=None, filters=(), missing=(), fill=None, attrs=None):
        a = np.asarray(a)
        messages = [(1, self.space(a.shape)), (3, self.kind(a.dtype))]
        if fill is not None:
            raw = np.array(fill, a.dtype).tobytes()
            messages.append((5, struct.pack("<BBBBI", 2, 2, 0, 1, len(raw)) + raw))
        if chunks is None:
            messages.append((8, struct.pack("<BBQQ", 3, 1, self.put(a.tobytes()), a.nbytes)))
        else:
            keys, rank = [], a.ndim
            for cell in np.ndindex(*(-(-n // c) for n, c in zip(a.shape, chunks, strict=True))):
                if cell in missing:
                    continue
                at = [i * c for i, c in zip(cell, chunks, strict=True)]
                block = np.zeros(chunks, a.dtype)
                part = a[tuple(slice(s, s + c) for s, c in zip(at, chunks, strict=True))]
                block[tuple(slice(0, n) for n in part.shape)] = part
                raw = block.tobytes()
                for f in filters:
                    raw = np.frombuffer(raw, np.uint8).reshape(-1, a.itemsize).T.tobytes() if f == "shuffle" else zlib.compress(raw)
                keys.append((struct.pack("<II", len(raw), 0) + b"".join(struct.pack("<Q", v) for v in [*at, 0]), self.put(raw)))
            last = struct.pack("<II", 0, 0) + b"".join(struct.pack("<Q", v) for v in [*a.shape, 0])
            node = lambda level, rows: self.put(b"TREE" + struct.pack("<BBHQQ", 1, level, len(rows), NONE, NONE) + b"".join(k + struct.pack("<Q", v) for k, v in rows) + last)
            if len(keys) > 4:  # two levels
                parts = [keys[i : i + 3] for i in range(0, len(keys), 3)]
                tree = node(1, [(p[0][0], node(0, p)) for p in parts])
            else:
                tree = node(0, keys)
            messages.append((8, struct.pack("<BBBQ", 3, 2, rank + 1, tree) + b"".join(struct.pack("<I", c) for c in [*chunks, a.itemsize])))
            codes = {"shuffle": (2, a.itemsize), "gzip": (1, 4), "fletcher32": (3, 0)}
            if filters:
                messages.append((0x0B, struct.pack("<BB6x", 1, len(filters)) + b"".join(struct.pack("<HHHHII", codes[f][0], 0, 1, 1, codes[f][1], 0) for f in filters)))
        messages += [self.attribute(n, v) for n, v in (attrs or {}).items()]
        return self.header(messages)

    def group(self, members):
        names, at = b"\0" * 8, {}
        for n in sorted(members):
            at[n] = len(names)
            names += n.encode() + b"\0" * (8 - len(n) % 8)
        heap = self.put(b"HEAP" + struct.pack("<B3xQQQ", 0, len(names), NONE, self.put(names)))
        entries = b"".join(struct.pack("<QQI4x16x", at[n], members[n], 0) for n in sorted(members))
        node = self.put(b"SNOD" + struct.pack("<BxH", 1, len(members)) + entries)
        tree = self.put(b"TREE" + struct.pack("<BBHQQ", 0, 0, 1, NONE, NONE) + struct.pack("<QQQ", 0, node, at[max(members)]))
        return self.header([(0x11, struct.pack("<QQ", tree, heap))])

    def nested(self, tree):
        return self.group({k: self.nested(v) if isinstance(v, dict) else v for k, v in tree.items()})

    def save(self, path, root):
        head = H.SIGNATURE + struct.pack("<8BHHI", 0, 0, 0, 0, 0, 8, 8, 0, 4, 16, 0) + struct.pack("<4Q", 0, NONE, len(self.data), NONE) + struct.pack("<QQI4x16x", 0, root, 0)
        self.data[: len(head)] = head
        path.write_bytes(bytes(self.data))
        return str(path)


EPSG, LON0 = 32618, -75.0


def granule(tmp_path, filters=("shuffle", "gzip"), direction=b"Ascending"):
    rng = np.random.default_rng(7)
    x0, y0 = to_tmerc(-74.0, 10.0, LON0)
    z = (rng.normal(size=(70, 90)) + 1j * rng.normal(size=(70, 90))).astype(np.complex64)
    z[5, 7] = np.nan
    c = Composer()
    grid = {
        "HH": c.dataset(z, (16, 20), filters, missing={(4, 4)}, fill=np.nan + 0j), "xCoordinates": c.dataset(x0 + 100.0 * np.arange(90)), "yCoordinates": c.dataset(y0 - 100.0 * np.arange(70)),
        "projection": c.dataset(np.int32(0).reshape(()), attrs={"epsg_code": np.int64(EPSG)}), "centerFrequency": c.dataset(np.float64(1.25e9).reshape(())),
    }
    cube = np.arange(3 * 4 * 5, dtype=np.float32).reshape(3, 4, 5) / 100
    radar = {n: c.dataset(cube + i) for i, n in enumerate(H.CUBE.values())} | {"heightAboveEllipsoid": c.dataset(np.array([0.0, 500, 1000])), "yCoordinates": c.dataset(y0 - 2000.0 * np.arange(4)), "xCoordinates": c.dataset(x0 + 2000.0 * np.arange(5)), "projection": c.dataset(np.int32(EPSG).reshape(()))}
    ident = {"orbitPassDirection": c.dataset(np.array(direction, "S12").reshape(())), "zeroDopplerStartTime": c.dataset(np.array(b"2025-01-02T03:04:05.000000000", "S32").reshape(())), "lookDirection": c.dataset(np.array(b"Left", "S8").reshape(()))}
    root = c.nested({"science": {"LSAR": {"GSLC": {"grids": {"frequencyA": grid}, "metadata": {"radarGrid": radar}}, "identification": ident}}})
    z[64:, 80:] = np.nan  # the block that was never written
    return c.save(tmp_path / "g.h5", root), z, x0, y0


def test_metadata_values_and_windows(tmp_path):
    path, z, x0, y0 = granule(tmp_path)
    meta = H.granule_metadata(path)
    assert (meta["epsg"], meta["direction"], meta["look"], meta["center_frequency"]) == (EPSG, "Ascending", "Left", 1.25e9) and meta["time"].startswith("2025-01-02T03:04:05")
    d = H.File(path).root[f"{H.GRID.format(product='GSLC', frequency='A')}/HH"]
    assert d.shape == (70, 90) and d.chunks == (16, 20) and d.decodable and d.dtype == np.complex64
    assert np.array_equal(d.read(), z, equal_nan=True) and np.array_equal(d.read(((13, 50), (19, 90))), z[13:50, 19:90], equal_nan=True)
    layers, heights, ys, xs, epsg = H.geometry_cube(path)
    assert layers["los_north"][2, 3, 4] == pytest.approx(3.59) and list(heights) == [0, 500, 1000] and epsg == EPSG and len(ys) == 4 and len(xs) == 5
    with pytest.raises(KeyError):
        H.File(path).root["science/none"]


def test_pixels_of_a_box(spark, tmp_path):
    path, z, x0, y0 = granule(tmp_path)
    df, meta = H.open_granule(spark, path)
    p = df.toPandas()
    assert len(p) == z.size and df.rdd.getNumPartitions() > 1
    got = np.full(z.shape, np.nan, np.complex64)
    got[p["yi"], p["xi"]] = p["re"].to_numpy() + 1j * p["im"].to_numpy()
    ok = np.isfinite(z)
    assert np.array_equal(got[ok], z[ok]) and p["re"].isna().sum() == (~ok).sum()
    lon, lat = (-73.98, -73.95), (9.96, 9.99)
    box, _ = H.open_granule(spark, path, lon=lon, lat=lat)
    q = box.toPandas()
    (a, b), (c, d) = H.native_box(EPSG, lon, lat)
    inside = p[p["x"].between(a, b) & p["y"].between(c, d)]
    assert 0 < len(inside) < len(p) and sorted(zip(q["yi"], q["xi"], strict=True)) == sorted(zip(inside["yi"], inside["xi"], strict=True))
    with pytest.raises(ValueError, match="outside"):
        H.open_granule(spark, path, lon=(10, 11), lat=(1, 2))


def test_what_cannot_be_read_says_so(spark, tmp_path):
    path, *_ = granule(tmp_path, filters=("shuffle", "gzip", "fletcher32"))
    with pytest.raises(Exception, match="fletcher32"):
        H.open_granule(spark, path)[0].count()
    path, *_ = granule(tmp_path, direction=b"Sideways")
    with pytest.raises(ValueError, match="Sideways"):
        H.granule_metadata(path)
    (tmp_path / "x").write_bytes(b"no" * 100)
    with pytest.raises(H.Unsupported):
        H.File(str(tmp_path / "x"))


def test_an_unwrapped_product(spark, tmp_path):
    c = Composer()
    u = np.linspace(0, 9, 30 * 40, dtype=np.float32).reshape(30, 40)
    cc = np.where(u > 5, 65535, 1).astype(np.uint32)
    one = lambda a: c.dataset(a, (16, 16), ("gzip",))
    unw = {"HH": c.group({"unwrappedPhase": one(u), "coherenceMagnitude": one(u / 10), "connectedComponents": one(cc)}), "xCoordinates": c.dataset(np.arange(40.0)), "yCoordinates": c.dataset(-np.arange(30.0)), "projection": c.dataset(np.int32(EPSG).reshape(()))}
    ident = {"orbitPassDirection": c.dataset(np.array(b"Descending", "S12").reshape(()))}
    root = c.nested({"science": {"LSAR": {"GUNW": {"grids": {"frequencyA": {"unwrappedInterferogram": unw, "centerFrequency": c.dataset(np.float64(1.2e9).reshape(()))}}}, "identification": ident}}})
    df, meta = H.open_unwrapped(spark, c.save(tmp_path / "u.h5", root))
    p = df.toPandas().sort_values(["yi", "xi"])
    assert np.allclose(p["unw"], u.ravel()) and set(p["conncomp"]) == {1, 65535} and "phase_screen" not in df.columns and meta["time"] is None
    from fringework.operators.looks import unwrapped_product

    s = unwrapped_product([(0, df)]).toPandas()
    assert set(s["conncomp"]) == {0, 1}


def test_grids_in_this_format(spark, tmp_path):
    from fringework.sources import grids

    c = Composer()
    z = np.arange(12, dtype=np.float32).reshape(3, 4)
    c.save(tmp_path / "a.grd", c.group({"z": c.dataset(z, (2, 2), ("shuffle", "gzip")), "lon": c.dataset(np.array([10.0, 11, 12, 13])), "lat": c.dataset(np.array([3.0, 2, 1]))}))
    p = grids.read_grids(spark, f"{tmp_path}/*.grd").toPandas().sort_values(["yi", "xi"])
    assert list(p["z"]) == list(range(12)) and list(p["y"][:5]) == [3, 3, 3, 3, 2] and list(p["x"][:4]) == [10, 11, 12, 13]
