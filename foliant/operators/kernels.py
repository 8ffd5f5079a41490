"""NumPy kernels on gray images: local contrast, edge-keeping smoothing, thresholds, morphology, skew and regions."""

from __future__ import annotations

import numpy as np


def gaussian(size: int) -> np.ndarray:
    """The square kernel of an odd size whose width follows from the size."""
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    row = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma * sigma))
    return np.outer(row / row.sum(), row / row.sum())


def clahe(image: np.ndarray, limit: float, tiles: int = 8) -> np.ndarray:
    """Contrast-limited equalisation in tiles x tiles parts, blended linearly between their centres.

    A part's histogram is cut at limit times its mean; what is cut off goes to all levels alike, the remainder to evenly
    spaced ones. An image that the parts do not divide is filled up by mirroring.
    """
    h, w = image.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    full = np.pad(image, ((0, th * tiles - h), (0, tw * tiles - w)), mode="symmetric") if (th * tiles, tw * tiles) != (h, w) else image
    parts = full.reshape(tiles, th, tiles, tw).swapaxes(1, 2).reshape(tiles * tiles, th * tw)
    counts = np.stack([np.bincount(p, minlength=256) for p in parts])
    most = max(int(limit * th * tw / 256), 1)
    excess = np.maximum(counts - most, 0).sum(axis=1)
    left = (excess % 256)[:, None]
    step = np.maximum(256 // np.maximum(left, 1), 1)
    spread = (np.arange(256) % step == 0) & (np.arange(256) // step < left)
    counts = np.minimum(counts, most) + (excess // 256)[:, None] + spread
    curve = np.clip(np.rint(counts.cumsum(axis=1) * (255 / (th * tw))), 0, 255).reshape(tiles, tiles, 256)

    def between(n: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = (np.arange(n) + 0.5) / size - 0.5
        low = np.floor(at).astype(int)
        return np.clip(low, 0, tiles - 1), np.clip(low + 1, 0, tiles - 1), at - low

    y0, y1, fy = between(h, th)
    x0, x1, fx = between(w, tw)
    pick = lambda y, x: curve[y[:, None], x[None, :], image]
    top = pick(y0, x0) * (1 - fx) + pick(y0, x1) * fx
    low = pick(y1, x0) * (1 - fx) + pick(y1, x1) * fx
    return np.rint(top * (1 - fy)[:, None] + low * fy[:, None]).astype(np.uint8)


def bilateral(image: np.ndarray, size: int, sigma_level: float, sigma_space: float) -> np.ndarray:
    """Mean over a disc, weighed by distance and by difference of level; borders are mirrored."""
    r = size // 2
    own = image.astype(np.float64)
    padded = np.pad(own, r, mode="reflect" if min(image.shape) > r else "symmetric")
    total, weights = np.zeros_like(own), np.zeros_like(own)
    for dy in range(-r, r + 1):
        for dx in range(-r, r + 1):
            far = dy * dy + dx * dx
            if far > r * r:
                continue
            other = padded[r + dy : r + dy + image.shape[0], r + dx : r + dx + image.shape[1]]
            weight = np.exp(-far / (2 * sigma_space**2) - (other - own) ** 2 / (2 * sigma_level**2))
            total += weight * other
            weights += weight
    return np.rint(total / weights).astype(np.uint8)


def adaptive(image: np.ndarray, size: int, offset: float) -> np.ndarray:
    """White where a pixel is above the weighed mean around it less the offset; border pixels are repeated."""
    row = gaussian(size)[size // 2]
    row = row / row.sum()
    padded = np.pad(image.astype(np.float64), size // 2, mode="edge")
    mean = np.apply_along_axis(np.convolve, 0, np.apply_along_axis(np.convolve, 1, padded, row, mode="valid"), row, mode="valid")
    return np.where(image > np.rint(mean) - offset, 255, 0).astype(np.uint8)


def _window(image: np.ndarray, height: int, width: int, fill: int, fold) -> np.ndarray:
    """fold over the window around each pixel, whose anchor is (height // 2, width // 2); fill lies outside."""
    up, left = height // 2, width // 2
    padded = np.pad(image, ((up, height - 1 - up), (left, width - 1 - left)), constant_values=fill)
    rows = fold([padded[i : i + image.shape[0]] for i in range(height)])
    return fold([rows[:, j : j + image.shape[1]] for j in range(width)])


def dilate(image: np.ndarray, height: int, width: int, times: int = 1) -> np.ndarray:
    for _ in range(times):
        image = _window(image, height, width, 0, np.maximum.reduce)
    return image


def erode(image: np.ndarray, height: int, width: int) -> np.ndarray:
    return _window(image, height, width, 255, np.minimum.reduce)


def close(image: np.ndarray, size: int = 2) -> np.ndarray:
    return erode(dilate(image, size, size), size, size)


def open_(image: np.ndarray, size: int = 2) -> np.ndarray:
    return dilate(erode(image, size, size), size, size)


def _hull(points: np.ndarray) -> np.ndarray:
    """The corners of the smallest convex polygon around the points, in order."""

    def half(rows: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for p in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out

    rows = points[np.lexsort((points[:, 1], points[:, 0]))].astype(np.float64)
    return np.array(half(rows)[:-1] + half(rows[::-1])[:-1])


def skew(ink: np.ndarray) -> float:
    """Degrees by which the smallest rectangle around the ink is turned, within 45 either way; 0 without a shape."""
    y, x = np.nonzero(ink)
    if len(y) < 3:
        return 0.0
    first = np.concatenate([[True], y[1:] != y[:-1]])
    ends = np.concatenate([first[1:], [True]])
    corners = _hull(np.column_stack([x, y])[first | ends])  # only a row's outer pixels can be corners
    if len(corners) < 3:
        return 0.0
    edges = np.roll(corners, -1, axis=0) - corners
    angles = np.unique(np.arctan2(edges[:, 1], edges[:, 0]) % (np.pi / 2))
    turned = [corners @ np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]]) for a in angles]
    best = np.degrees(angles[int(np.argmin([np.ptp(t, axis=0).prod() for t in turned]))])
    return float(best - 90 if best > 45 else best)


def rotate(image: np.ndarray, degrees: float) -> np.ndarray:
    """The image turned back by degrees about its middle, linear between pixels (so edges turn gray); border pixels are repeated."""
    h, w = image.shape
    a = np.radians(degrees)
    y, x = np.mgrid[:h, :w].astype(np.float64)
    y, x = y - h // 2, x - w // 2
    sx = np.clip(x * np.cos(a) - y * np.sin(a) + w // 2, 0, w - 1)
    sy = np.clip(x * np.sin(a) + y * np.cos(a) + h // 2, 0, h - 1)
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    x1, y1, fx, fy = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1), sx - x0, sy - y0
    own = image.astype(np.float64)
    top, low = own[y0, x0] * (1 - fx) + own[y0, x1] * fx, own[y1, x0] * (1 - fx) + own[y1, x1] * fx
    return np.rint(top * (1 - fy) + low * fy).astype(np.uint8)


def deskew(binary: np.ndarray, most: float | None = 5.0) -> np.ndarray:
    """A page of black ink set upright, where it is turned by `most` degrees or less (None: by any angle)."""
    angle = skew(binary == 0)
    return binary if not angle or (most is not None and abs(angle) > most) else rotate(binary, angle)


def boxes(mask: np.ndarray) -> np.ndarray:
    """left, top, width, height of each outer shape of a mask, whose pixels touch by sides or corners; by top, then left.

    Runs of a row are joined with those they touch in the row before.
    """
    edge = np.diff(np.pad(mask.astype(bool), ((0, 0), (1, 1))).view(np.int8), axis=1)
    row, start = np.nonzero(edge == 1)
    stop = np.nonzero(edge == -1)[1]
    root = np.arange(len(row))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    first = np.searchsorted(row, np.arange(mask.shape[0] + 1))
    for y in range(1, mask.shape[0]):
        i, j = first[y - 1], first[y]
        while i < first[y] and j < first[y + 1]:
            if start[i] <= stop[j] and start[j] <= stop[i]:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
            if stop[i] < stop[j]:
                i += 1
            else:
                j += 1
    label = np.array([find(i) for i in range(len(row))], dtype=np.int64)
    out = []
    for k in np.unique(label):
        own = label == k
        left, top = start[own].min(), row[own].min()
        out.append((left, top, stop[own].max() - left, row[own].max() + 1 - top))
    return np.array(sorted(out, key=lambda b: (b[1], b[0])), dtype=np.int32).reshape(-1, 4)
