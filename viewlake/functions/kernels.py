"""Image measures over stacks of equally large BGR images, uint8 [n, h, w, 3].

All sums are integers; the only floating-point step is the last division, so a
measure doesn't depend on how a stack is cut. Borders are mirrored without repeating
the edge, except in the morphology, where what is outside never wins.
"""

from __future__ import annotations

import numpy as np

# fixed values: 15-bit weights of blue, green and red in the luma, and its 16-bit variant for hashing
LUMA = (3735, 19235, 9798)
LUMA_HASH = (7471, 38470, 19595)


def gray(bgr: np.ndarray) -> np.ndarray:
    b, g, r = (bgr[..., i].astype(np.int64) for i in range(3))
    return (LUMA[0] * b + LUMA[1] * g + LUMA[2] * r + (1 << 14)) >> 15


def gray_for_hash(bgr: np.ndarray) -> np.ndarray:
    b, g, r = (bgr[..., i].astype(np.int64) for i in range(3))
    return (LUMA_HASH[0] * b + LUMA_HASH[1] * g + LUMA_HASH[2] * r + (1 << 15)) >> 16


def _mirrored(a: np.ndarray, by: int) -> np.ndarray:
    for axis in (1, 2):
        n = a.shape[axis]
        at = np.abs(np.arange(-by, n + by))
        if n > 1:
            at = at % (2 * (n - 1))
            at = np.where(at >= n, 2 * (n - 1) - at, at)
        else:
            at = np.zeros_like(at)
        a = np.take(a, at, axis=axis)
    return a


def _sums(a: np.ndarray) -> np.ndarray:
    return a.reshape(len(a), -1).sum(axis=1)


def blur_score(bgr: np.ndarray) -> np.ndarray:
    """Population variance of the four-neighbour Laplacian of the gray image: low means blurred."""
    m = _mirrored(gray(bgr), 1)
    edges = m[:, :-2, 1:-1] + m[:, 2:, 1:-1] + m[:, 1:-1, :-2] + m[:, 1:-1, 2:] - 4 * m[:, 1:-1, 1:-1]
    n = edges[0].size
    return (n * _sums(edges * edges) - _sums(edges) ** 2) / (n * n)


def exposure(bgr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population standard deviation of the gray image, on 0..1."""
    g = gray(bgr)
    n, total, squares = g[0].size, _sums(g), _sums(g * g)
    return total / (255.0 * n), np.sqrt((n * squares - total * total).astype(np.float64)) / (255.0 * n)


def clipped_ratio(bgr: np.ndarray, limit: int = 250) -> np.ndarray:
    """Share of pixels with any channel at or above the limit."""
    hit = bgr.max(axis=3) >= limit
    return _sums(hit) / hit[0].size


def noise_score(bgr: np.ndarray) -> np.ndarray:
    """Mean difference of the gray image from itself smoothed by 1-4-6-4-1 in both directions, on 0..1."""
    g = gray(bgr)
    m = _mirrored(g, 2)
    rows = m[:, :-4] + m[:, 4:] + 4 * (m[:, 1:-3] + m[:, 3:-1]) + 6 * m[:, 2:-2]
    smooth = rows[:, :, :-4] + rows[:, :, 4:] + 4 * (rows[:, :, 1:-3] + rows[:, :, 3:-1]) + 6 * rows[:, :, 2:-2]
    return _sums(np.abs(256 * g - smooth)) / (256.0 * 255.0 * g[0].size)


def _table(numerator: int) -> np.ndarray:
    i = np.arange(1, 256)
    return np.concatenate([[0], np.round(numerator * 4096 / i)]).astype(np.int64)


def hsv(bgr: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hue 0..179, saturation and value 0..255, in fixed point with 12 bits."""
    b, g, r = (bgr[..., i].astype(np.int64) for i in range(3))
    v = np.maximum(np.maximum(b, g), r)
    d = v - np.minimum(np.minimum(b, g), r)
    s = (d * _table(255)[v] + 2048) >> 12
    turn = np.where(v == r, g - b, np.where(v == g, b - r + 2 * d, r - g + 4 * d))
    h = (turn * _table(30)[d] + 2048) >> 12
    return np.where(h < 0, h + 180, h), s, v


def _around(mask: np.ndarray, best, outside: int) -> np.ndarray:
    """3x3 minimum or maximum."""
    for axis in (1, 2):
        pad = [(0, 0)] * 3
        pad[axis] = (1, 1)
        p = np.pad(mask, pad, constant_values=outside)
        n = mask.shape[axis]
        mask = best(best(np.take(p, range(n), axis), np.take(p, range(1, n + 1), axis)), np.take(p, range(2, n + 2), axis))
    return mask


def sky_reflective_ratio(bgr: np.ndarray) -> np.ndarray:
    """Share of bright unsaturated or blue pixels, after removing specks and filling gaps of one pixel."""
    h, s, v = hsv(bgr)
    bright = (s <= 70) & (v >= 170)
    blue = (h >= 85) & (h <= 130) & (s >= 10) & (s <= 160) & (v >= 120)
    mask = (bright | blue).astype(np.uint8)
    for best, outside in ((np.minimum, 1), (np.maximum, 0), (np.maximum, 0), (np.minimum, 1)):
        mask = _around(mask, best, outside)
    return _sums(mask) / mask[0].size


def measures(bgr: np.ndarray) -> dict[str, np.ndarray]:
    mean, std = exposure(bgr)
    return {
        "blur_score": blur_score(bgr), "exposure_mean": mean, "exposure_std": std, "clipped_ratio": clipped_ratio(bgr),
        "noise_score": noise_score(bgr), "sky_reflective_ratio": sky_reflective_ratio(bgr),
    }


def _cubic(x: np.ndarray, a: float = -0.5) -> np.ndarray:
    x = np.abs(x)
    near = ((a + 2) * x - (a + 3)) * x * x + 1
    far = (((x - 5) * x + 8) * x - 4) * a
    return np.where(x < 1, near, np.where(x < 2, far, 0.0))


def _shrink_axis(img: np.ndarray, size: int, axis: int) -> np.ndarray:
    """Bicubic resampling of one axis; the kernel widens with the scale when shrinking. Rounded to 8 bits."""
    n = img.shape[axis]
    scale = n / size
    wide = max(scale, 1.0)
    centre = (np.arange(size) + 0.5) * scale
    weights = _cubic((np.arange(n)[None, :] + 0.5 - centre[:, None]) / wide)
    inside = np.abs(np.arange(n)[None, :] + 0.5 - centre[:, None]) < 2 * wide
    weights = np.where(inside, weights, 0.0)
    weights /= weights.sum(axis=1, keepdims=True)
    out = np.moveaxis(np.tensordot(weights, np.moveaxis(img.astype(np.float64), axis, 0), axes=1), 0, axis)
    return np.clip(np.floor(out + 0.5), 0, 255)


def average_hash(bgr: np.ndarray, size: int = 8) -> int:
    """Average hash of one image [h, w, 3] as an unsigned integer, row by row, first bit highest."""
    small = gray_for_hash(bgr)
    if small.shape != (size, size):
        small = _shrink_axis(_shrink_axis(small, size, 1), size, 0)
    bits = (small > small.mean()).ravel()
    return int("".join("1" if b else "0" for b in bits), 2)
