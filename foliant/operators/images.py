"""Page images as rows (height, width, channels, data) and NumPy kernels over them in pandas UDFs.

Decoding files, recognition and embedding need libraries that are not there; they plug in as the protocols below.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators import kernels

METRICS = ("lap_var", "std", "edge_density", "noise", "min_val", "max_val")


class OcrEngine(Protocol):
    """Recognises a gray image: tokens as (text, conf, left, top, width, height)."""

    def tokens(self, image: np.ndarray, lang: str) -> list[tuple[str, float, int, int, int, int]]: ...


class Encoder(Protocol):
    """Turns texts to vectors."""

    def encode(self, texts: list[str]) -> list[list[float]]: ...


class MissingDependency(RuntimeError):
    """A stage was asked for whose library is not installed."""


def rasterizer(name: str = "fitz") -> object:
    """The installed PDF library, or a clear error."""
    import importlib

    try:
        return importlib.import_module(name)
    except ImportError as e:
        raise MissingDependency(f"reading PDF pages as images needs {name}; pass page images or text instead") from e


def pixels(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)


def gray(image: np.ndarray) -> np.ndarray:
    """Luma of blue, green, red; a single channel as it is."""
    if image.ndim == 2 or image.shape[2] == 1:
        return image.reshape(image.shape[:2])
    return np.rint(image[..., :3] @ np.array([0.114, 0.587, 0.299])).astype(np.uint8)


def convolve(image: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Same-size filter with mirrored borders (the border pixel itself is not repeated)."""
    kernel = np.asarray(kernel, dtype=np.float64)
    r, c = kernel.shape[0] // 2, kernel.shape[1] // 2
    padded = np.pad(image.astype(np.float64), ((r, r), (c, c)), mode="reflect")
    windows = np.lib.stride_tricks.sliding_window_view(padded, kernel.shape)
    return np.einsum("ijkl,kl->ij", windows, kernel)


LAPLACE = np.array([[0, 1, 0], [1, -4, 1], [0, 1, 0]])
SHARPEN = np.array([[-1, -1, -1], [-1, 9, -1], [-1, -1, -1]])
GAUSS = np.outer([1, 2, 1], [1, 2, 1]) / 16


def otsu(image: np.ndarray) -> int:
    """The threshold with the most variance between the classes, the lowest of equals."""
    counts = np.bincount(image.ravel(), minlength=256).astype(float)
    below, mass = np.cumsum(counts), np.cumsum(counts * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = below * above * (mass / below - (mass[-1] - mass) / above) ** 2
    return int(np.nan_to_num(between).argmax())


def binarize(image: np.ndarray) -> np.ndarray:
    return np.where(image > otsu(image), 255, 0).astype(np.uint8)


def sharpen(image: np.ndarray) -> np.ndarray:
    return np.clip(convolve(image, SHARPEN), 0, 255).astype(np.uint8)


def denoise(image: np.ndarray) -> np.ndarray:
    return np.rint(convolve(image, GAUSS)).astype(np.uint8)


def rescale(image: np.ndarray, scale: float) -> np.ndarray:
    """Bilinear copy with whole sizes."""
    h, w = max(1, int(image.shape[0] * scale)), max(1, int(image.shape[1] * scale))
    y, x = np.clip((np.arange(h) + 0.5) / scale - 0.5, 0, image.shape[0] - 1), np.clip((np.arange(w) + 0.5) / scale - 0.5, 0, image.shape[1] - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, image.shape[0] - 1), np.minimum(x0 + 1, image.shape[1] - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    a = image.astype(float)
    top, low = a[y0][:, x0] * (1 - fx) + a[y0][:, x1] * fx, a[y1][:, x0] * (1 - fx) + a[y1][:, x1] * fx
    return np.rint(top * (1 - fy) + low * fy).astype(np.uint8)


def enlarge(image: np.ndarray, scale: float = 1.5) -> np.ndarray:
    """The zoomed copy that recognition gets."""
    return rescale(image, scale)


def close(image: np.ndarray) -> np.ndarray:
    return kernels.close(image, 2)


# Limits, sizes and offsets of the steps.
#: Steps by quality tier; any other tier is taken as poor.
TIERS: dict[str, tuple[Callable[[np.ndarray], np.ndarray], ...]] = {
    "excellent": (binarize,),
    "good": (partial(kernels.clahe, limit=2.0), denoise, binarize, close),
    "medium": (partial(kernels.bilateral, size=5, sigma_level=50, sigma_space=50), partial(kernels.clahe, limit=2.5), partial(kernels.adaptive, size=15, offset=8), close),
    "poor": (partial(kernels.bilateral, size=9, sigma_level=75, sigma_space=75), partial(kernels.clahe, limit=3.0), partial(kernels.adaptive, size=21, offset=10), close, kernels.deskew),
}
#: Steps of a further attempt, by the name of its filter.
RETRIES: dict[str, tuple[Callable[[np.ndarray], np.ndarray], ...]] = {
    "denoise": (partial(kernels.bilateral, size=9, sigma_level=75, sigma_space=75), binarize),
    "adaptive": (partial(kernels.adaptive, size=11, offset=2),),
    "morphology": (binarize, close, kernels.open_),
    "contrast": (partial(kernels.clahe, limit=3.0), binarize),
    "sharpen": (sharpen, binarize),
}
#: Steps before recognition.
BEFORE_OCR = (partial(kernels.clahe, limit=2.0), binarize, close)


def propose(image: np.ndarray) -> np.ndarray:
    """Boxes (left, top, width, height) of what ink becomes when letters are joined to lines."""
    return kernels.boxes(kernels.dilate(255 - binarize(gray(image)), 3, 15, times=2))


def measure(image: np.ndarray) -> tuple[float, ...]:
    """The raw quality figures of a gray image."""
    g = gray(image)
    gx, gy = convolve(g, [[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]]), convolve(g, [[-1, -2, -1], [0, 0, 0], [1, 2, 1]])
    edges = float((np.hypot(gx, gy) > 150).mean())
    return float(convolve(g, LAPLACE).var()), float(g.std()), edges, float(np.abs(g - convolve(g, GAUSS)).mean()), float(g.min()), float(g.max())


def image_metrics(images: DataFrame, key: str) -> DataFrame:
    """key and the raw quality figures; an image that cannot be read has an error instead."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                try:
                    out.append((getattr(row, key), *measure(pixels(row.height, row.width, row.channels, row.data)), None))
                except (ValueError, TypeError) as e:
                    out.append((getattr(row, key), *[None] * len(METRICS), str(e)))
            yield pd.DataFrame(out, columns=[key, *METRICS, "error"])

    kind = images.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, " + ", ".join(f"{m} double" for m in METRICS) + ", error string"
    return images.select(key, "height", "width", "channels", "data").mapInPandas(run, schema)


def preprocess(images: DataFrame, key: str, tier: str = "tier", steps: dict[str, tuple] = TIERS, otherwise: str = "poor") -> DataFrame:
    """key, height, width, channels, data, error after the steps that an image's tier names (or, with RETRIES, its filter).

    An image that cannot be read has an error and no data.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                try:
                    image = gray(pixels(row.height, row.width, row.channels, row.data))
                    for step in steps.get(getattr(row, tier), steps[otherwise]):
                        image = step(image)
                    out.append((getattr(row, key), *image.shape, 1, image.tobytes(), None))
                except (ValueError, TypeError) as e:
                    out.append((getattr(row, key), None, None, None, None, str(e)))
            frame = pd.DataFrame(out, columns=[key, "height", "width", "channels", "data", "error"])
            yield frame.astype({c: "Int32" for c in ("height", "width", "channels")})

    kind = images.schema[key].dataType.simpleString()
    return images.select(key, tier, "height", "width", "channels", "data").mapInPandas(run, f"{key} {kind}, height int, width int, channels int, data binary, error string")


def regions(images: DataFrame, key: str) -> DataFrame:
    """key, pos, left, top, width, height of the regions that each image's ink proposes; none for one that cannot be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                try:
                    found = propose(pixels(row.height, row.width, row.channels, row.data))
                except (ValueError, TypeError):
                    continue
                out += [(getattr(row, key), i, *map(int, box)) for i, box in enumerate(found)]
            yield pd.DataFrame(out, columns=[key, "pos", "left", "top", "width", "height"])

    kind = images.schema[key].dataType.simpleString()
    return images.select(key, "height", "width", "channels", "data").mapInPandas(run, f"{key} {kind}, pos int, left int, top int, width int, height int")


def recognize(images: DataFrame, key: str, engine: Callable[[], OcrEngine], lang: str = "uzb+eng+rus") -> DataFrame:
    """Token rows of each image; the engine is made once a task. A failing image gives one row with the error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = engine()
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                k = getattr(row, key)
                try:
                    out += [(k, i, *t, None) for i, t in enumerate(own.tokens(gray(pixels(row.height, row.width, row.channels, row.data)), lang))]
                except Exception as e:  # a page must not end the job
                    out.append((k, 0, "", -1.0, 0, 0, 0, 0, str(e)))
            yield pd.DataFrame(out, columns=[key, "pos", "text", "conf", "left", "top", "width", "height", "error"])

    kind = images.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, pos int, text string, conf double, left int, top int, width int, height int, error string"
    return images.select(key, "height", "width", "channels", "data").mapInPandas(run, schema)


def embed(docs: DataFrame, key: str, text_col: str, encoder: Callable[[], Encoder], batch: int = 64) -> DataFrame:
    """key and the text's vector, scaled to length one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = encoder()
        for b in batches:
            texts = b[text_col].fillna("").to_list()
            raw = [v for i in range(0, len(texts), batch) for v in own.encode(texts[i : i + batch])]
            unit = [(np.asarray(v, dtype=float) / (np.linalg.norm(v) or 1.0)).astype(np.float32).tolist() for v in raw]
            yield pd.DataFrame({key: b[key], "embedding": unit})

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text_col)).mapInPandas(run, f"{key} {kind}, embedding array<float>")


class HashEncoder:
    """Deterministic stand-in for an embedding model: signed hashing of words."""

    def __init__(self, size: int = 768):
        self.size = size

    def encode(self, texts: list[str]) -> list[list[float]]:
        from zlib import crc32

        out = np.zeros((len(texts), self.size))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = crc32(w.encode())
                out[i, h % self.size] += 1 if h & 1 << 31 else -1
        return out.tolist()
