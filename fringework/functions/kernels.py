"""Array kernels on numpy: filters, spectra, offsets, unwrapping. NaN is invalid inside arrays."""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np


def gaussian_weights(sigma: float) -> np.ndarray:
    k = np.arange(-int(4 * sigma + 0.5), int(4 * sigma + 0.5) + 1)
    w = np.exp(-(k**2) / (2 * sigma**2))
    return w / w.sum()


def gaussian(a: np.ndarray, sigma: float) -> np.ndarray:
    """Separable Gaussian with a zero border."""
    w = gaussian_weights(sigma)
    r = len(w) // 2
    for axis in (0, 1):
        padded = np.pad(a, [(r, r) if ax == axis else (0, 0) for ax in (0, 1)])
        a = np.apply_along_axis(lambda v: np.convolve(v, w, "valid"), axis, padded)
    return a


def border_response(n: int, sigma: float) -> np.ndarray:
    """What the filter makes of ones along an axis: the share of its weight inside."""
    w = gaussian_weights(sigma)
    r, sums = len(w) // 2, np.concatenate([[0.0], np.cumsum(w)])
    i = np.arange(n)
    return sums[np.minimum(n - 1 - i, r) + r + 1] - sums[r - np.minimum(i, r)]


def smooth_surface(field: np.ndarray, sigma: float, exclude: np.ndarray | None = None) -> np.ndarray:
    """Normalised convolution over valid pixels; NaN where they weigh almost nothing."""
    ok = np.isfinite(field) if exclude is None else np.isfinite(field) & ~exclude
    weight = gaussian(ok.astype(float), sigma)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(weight > 1e-6, gaussian(np.where(ok, field, 0.0), sigma) / weight, np.nan)


def without_outliers(field: np.ndarray, sigma: float, threshold: float, rounds: int) -> np.ndarray:
    """Voids values farther than the threshold from the smooth surface, again and again."""
    out = field.astype(float).copy()
    for _ in range(rounds):
        with np.errstate(invalid="ignore"):
            out[np.abs(out - smooth_surface(out, sigma)) > threshold] = np.nan
    return out


def goldstein(z: np.ndarray, alpha: float | None = 0.5, patch: int = 32, overlap: float = 0.75, smooth: int = 3, coherence: np.ndarray | None = None) -> np.ndarray:
    """Adaptive spectral filter: patches weighted by their own smoothed spectrum, blended with a Hamming window.

    With ``coherence`` the exponent of a patch is one less its weighted mean coherence.
    """
    ny, nx = z.shape
    ps = min(patch, ny, nx)
    if ps < 2:
        return z.copy()
    step = max(1, round(ps * (1 - overlap)))
    starts = [sorted({*range(0, n - ps + 1, step), n - ps}) for n in (ny, nx)]
    window = np.outer(*[0.54 - 0.46 * np.cos(2 * np.pi * np.arange(ps) / (ps - 1))] * 2)
    clean = np.where(np.isfinite(z), z, 0).astype(complex)
    total, weight = np.zeros((ny, nx), complex), np.zeros((ny, nx))
    reach = range(-(smooth // 2), smooth - smooth // 2)
    for y in starts[0]:  # a row of patches at a time
        every = np.stack([clean[y : y + ps, x : x + ps] for x in starts[1]])
        spectrum = np.fft.fft2(window * every)
        a = np.abs(spectrum)
        box = sum(np.roll(a, d, 1) for d in reach)
        box = sum(np.roll(box, d, 2) for d in reach) / smooth**2
        power = alpha
        if coherence is not None:
            held = np.stack([np.nan_to_num(coherence[y : y + ps, x : x + ps]) for x in starts[1]])
            power = (1 - (window * held).sum(axis=(1, 2)) / window.sum())[:, None, None]
        filtered = window * np.fft.ifft2(spectrum * (box / (box.max(axis=(1, 2), keepdims=True) + 1e-20)) ** power)
        for x, patch_ in zip(starts[1], filtered, strict=True):
            total[y : y + ps, x : x + ps] += patch_
            weight[y : y + ps, x : x + ps] += window**2
    out = total / weight
    return np.where(np.isfinite(z), out, np.nan)


def pixel_offset(ref: np.ndarray, sec: np.ndarray, size: int, search: int, upsample: int = 16, window: int = 16, min_valid: float = 0.5) -> tuple[float, float, float]:
    """(dy, dx, strength) of the secondary against the reference patch, by correlation of demeaned amplitudes.

    The central template of the reference is looked for within ``search`` pixels;
    the peak is refined on its fourth root, upsampled by zero padding the spectrum.
    """
    n = size + 2 * search
    if ref.shape != (n, n) or sec.shape != (n, n):
        raise ValueError("a patch has the template's size plus twice the search")
    a, b = np.abs(ref), np.abs(sec)
    oka, okb = np.isfinite(a), np.isfinite(b)
    if oka.mean() < min_valid or okb.mean() < min_valid:
        return np.nan, np.nan, np.nan
    a, b = np.where(oka, a - a[oka].mean(), 0), np.where(okb, b - b[okb].mean(), 0)
    mask = np.zeros_like(a)
    mask[search : search + size, search : search + size] = 1
    c = np.abs(np.fft.fftshift(np.fft.irfft2(np.fft.rfft2(b) * np.conj(np.fft.rfft2(a * mask)), b.shape)))
    mid = n // 2
    c = c[mid - search : mid + search + 1, mid - search : mid + search + 1]
    py, px = np.unravel_index(int(np.argmax(c)), c.shape)
    rest = np.delete(c.ravel(), py * c.shape[1] + px)
    strength = float(c[py, px] / rest.mean()) if rest.size and rest.mean() > 0 else np.nan
    h = window // 2
    local = np.pad(c, h)[py : py + window, px : px + window] ** 0.25
    fine = np.abs(upsampled(local, upsample))
    fy, fx = np.unravel_index(int(np.argmax(fine)), fine.shape)
    return py - search + fy / upsample - h, px - search + fx / upsample - h, strength


@lru_cache(maxsize=16)
def _waves(n: int, factor: int) -> np.ndarray:
    """(n * factor, n): what each frequency, from -n // 2 on, is at every fine place."""
    return np.exp(2j * np.pi / (n * factor) * np.outer(np.arange(n * factor), np.arange(n) - n // 2)) / n


def upsampled(a: np.ndarray, factor: int) -> np.ndarray:
    """Band-limited interpolation by a whole factor: the few waves of a small array, summed at the fine places."""
    spectrum = np.fft.fftshift(np.fft.fft2(a))
    return np.real(_waves(a.shape[0], factor) @ spectrum @ _waves(a.shape[1], factor).T)


def wrap(phase: np.ndarray) -> np.ndarray:
    return np.angle(np.exp(1j * phase))


def unwrapped(phase: np.ndarray, quality: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(unwrapped phase, labels) by following the most reliable pixels first.

    Every component of valid pixels is unwrapped by itself from its best pixel;
    the result differs from the input by whole cycles. Invalid pixels are NaN with label 0.
    """
    ok = np.isfinite(phase)
    out, labels = np.full(phase.shape, np.nan), np.zeros(phase.shape, np.int64)
    if quality is None:
        second = np.zeros(phase.shape)
        for axis in (0, 1):
            filled = np.where(ok, phase, 0)
            second += wrap(wrap(np.roll(filled, 1, axis) - filled) - wrap(filled - np.roll(filled, -1, axis))) ** 2
        quality = 1 / (1e-6 + np.sqrt(second))
    ny, nx = phase.shape
    label = 0
    for flat in np.argsort(-np.where(ok, quality, -np.inf), axis=None, kind="stable"):
        y, x = divmod(int(flat), nx)
        if not ok[y, x]:
            break
        if labels[y, x]:
            continue
        label += 1
        out[y, x], labels[y, x] = phase[y, x], label
        heap = [(-quality[y, x], y, x)]
        while heap:
            _, y, x = heapq.heappop(heap)
            for v, u in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
                if 0 <= v < ny and 0 <= u < nx and ok[v, u] and not labels[v, u]:
                    step = phase[v, u] - phase[y, x]
                    out[v, u] = out[y, x] + step - 2 * np.pi * np.round(step / (2 * np.pi))
                    labels[v, u] = label
                    heapq.heappush(heap, (-quality[v, u], v, u))
    # Remove rounding: the phase plus whole cycles.
    return np.where(labels > 0, phase + 2 * np.pi * np.round((out - phase) / (2 * np.pi)), np.nan), labels
