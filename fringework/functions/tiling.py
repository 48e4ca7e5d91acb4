"""How a raster is cut into overlapping tiles for unwrapping, and how large the blocks of a read are."""

from __future__ import annotations

from collections.abc import Sequence
from math import isqrt

#: Samples of a tile with its overlap at most; the overlap wanted, and the least that still joins two tiles.
TILE_PIXELS, OVERLAP, LEAST_OVERLAP = 1_500_000, 256, 10
#: Regions that an unwrapper keeps apart at most, and samples of the smallest.
REGIONS, REGION_SIZE = 32_000, 100


def inflated(n: int, tiles: int, overlap: int) -> int:
    """Length of a tile along an axis of n samples, overlaps included."""
    return -(-(n + (tiles - 1) * overlap) // tiles)


def overlap_of(rows: int, cols: int, tiles: tuple[int, int], target: int = OVERLAP) -> tuple[int, int]:
    """Overlap by axis: at most a quarter of a tile's side and the target, none along an axis that is not cut."""
    out = []
    for n, t in zip((rows, cols), tiles, strict=True):
        side = n // t
        out.append(0 if t == 1 else max(min(LEAST_OVERLAP, side // 4), min(side // 4, target)))
    return out[0], out[1]


def tile_grid(rows: int, cols: int, most: int = TILE_PIXELS, target: int = OVERLAP) -> tuple[int, int]:
    """The coarsest cut, its tiles as square as can be, whose tiles hold at most ``most`` samples. It depends on the raster alone."""
    limit = max(1, isqrt(rows * cols))
    tiles = (1, 1)
    while True:
        o = overlap_of(rows, cols, tiles, target)
        h, w = inflated(rows, tiles[0], o[0]), inflated(cols, tiles[1], o[1])
        if h * w <= most or (tiles[0] >= min(rows, limit) and tiles[1] >= min(cols, limit)):
            return tiles
        taller = (h >= w and tiles[0] < min(rows, limit)) or tiles[1] >= min(cols, limit)
        tiles = (tiles[0] + 1, tiles[1]) if taller else (tiles[0], tiles[1] + 1)


def check_tiles(rows: int, cols: int, tiles: tuple[int, int], overlap: tuple[int, int], region: int = REGION_SIZE) -> str | None:
    """Raises where tiles cannot be joined; says so where a tile may hold more regions than are kept apart."""
    for n, t, o in zip((rows, cols), tiles, overlap, strict=True):
        if t < 1 or t > n:
            raise ValueError(f"{t} tiles over {n} samples")
        if t > 1 and (o < 1 or 2 * o >= inflated(n, t, o)):
            raise ValueError(f"an overlap of {o} does not join tiles of {inflated(n, t, o)} samples")
    most = inflated(rows, tiles[0], overlap[0]) * inflated(cols, tiles[1], overlap[1])
    if most < region:
        raise ValueError("a tile is smaller than a region")
    return f"up to {most // region} regions in a tile, {REGIONS} are kept apart" if most // region > REGIONS else None


def tile_spans(n: int, tiles: int, overlap: int) -> list[tuple[int, int]]:
    """(first, past the last) of each tile along an axis; neighbours share ``overlap`` samples or more."""
    size = inflated(n, tiles, overlap)
    starts = [round(i * (n - size) / (tiles - 1)) for i in range(tiles)] if tiles > 1 else [0]
    return [(s, s + size) for s in starts]


def block_shape(ny: int, nx: int, chunk: tuple[int, int], cores: int, blocks: int | None = None) -> tuple[int, int]:
    """Rows and columns of a read: about four blocks a core over the crop, in whole stored chunks and no larger than it."""
    wanted = max(1, blocks or 4 * cores)
    side = max(1, isqrt(max(1, ny * nx // wanted)))
    return tuple(min(max(n, 1), max(c, side // c * c)) for n, c in zip((ny, nx), chunk, strict=True))


def directly_decodable(chunks: Sequence[int] | None, filters: Sequence[str], kind: str = "f") -> bool:
    """Whether stored chunks can be inflated without their library: two axes, deflate and byte shuffling at most, plain numbers."""
    return chunks is not None and len(chunks) == 2 and set(filters) <= {"gzip", "shuffle"} and kind in "fiuc"
