"""Enhancement of images before their text is read: enlarging, local contrast, sharpening, borders.

Plain numpy kernels with the usual definitions; equality with any library bit by bit is not claimed.
"""

from __future__ import annotations

import numpy as np


def upscale(image: np.ndarray, min_side: int = 1500) -> tuple[np.ndarray, float]:
    """The image with at least ``min_side`` on its shorter side, and the factor; cubic convolution (a = -0.75)."""
    height, width = image.shape[:2]
    factor = 1.0 if min(height, width) >= min_side else min_side / min(height, width)
    if factor == 1.0:
        return image, 1.0
    out = image.astype(np.float32)
    for axis, size in ((0, height), (1, width)):
        place = (np.arange(int(round(size * factor))) + 0.5) / factor - 0.5
        base = np.floor(place).astype(int)
        total = 0.0
        for k in range(-1, 3):
            d = np.abs(place - (base + k))
            w = np.where(d <= 1, (1.25 * d - 2.25) * d * d + 1, np.where(d < 2, ((-0.75 * d + 3.75) * d - 6) * d + 3, 0)).astype(np.float32)
            total = total + np.take(out, np.clip(base + k, 0, size - 1), axis=axis) * (w[:, None, None] if axis == 0 else w[None, :, None])
        out = total
    return np.clip(np.round(out), 0, 255).astype(np.uint8), factor


def equalise(channel: np.ndarray, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Contrast-limited adaptive equalisation of an 8-bit channel: a curve for each tile, blended between their centres."""
    height, width = channel.shape
    th, tw = -(-height // tiles), -(-width // tiles)
    padded = np.pad(channel, ((0, th * tiles - height), (0, tw * tiles - width)), mode="reflect" if min(height, width) > max(th * tiles - height, tw * tiles - width) else "edge")
    cells = padded.reshape(tiles, th, tiles, tw).transpose(0, 2, 1, 3).reshape(tiles * tiles, -1)
    hist = np.stack([np.bincount(c, minlength=256) for c in cells])
    limit = max(1, int(clip * cells.shape[1] / 256))
    over = np.maximum(hist - limit, 0).sum(1)
    hist = np.minimum(hist, limit) + (over // 256)[:, None]
    for row, rest in zip(hist, over % 256):
        if rest:
            row[:: max(1, 256 // rest)][:rest] += 1
    curves = np.clip(np.round(np.cumsum(hist, axis=1) * (255.0 / cells.shape[1])), 0, 255).reshape(tiles, tiles, 256)
    y, x = np.arange(height) / th - 0.5, np.arange(width) / tw - 0.5
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    wy, wx = (y - y0)[:, None], (x - x0)[None, :]
    at = lambda a, b: curves[np.clip(y0 + a, 0, tiles - 1)[:, None], np.clip(x0 + b, 0, tiles - 1)[None, :], channel]
    top, low = at(0, 0) * (1 - wx) + at(0, 1) * wx, at(1, 0) * (1 - wx) + at(1, 1) * wx
    return np.clip(np.round(top * (1 - wy) + low * wy), 0, 255).astype(np.uint8)


_TO_XYZ = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])
_WHITE = np.array([0.950456, 1.0, 1.088754])


def to_lab(image: np.ndarray) -> np.ndarray:
    """CIE L*a*b* (D65) of a BGR image, L from 0 to 100."""
    c = image[:, :, ::-1] / 255.0
    c = np.where(c > 0.04045, ((c + 0.055) / 1.055) ** 2.4, c / 12.92) @ _TO_XYZ.T / _WHITE
    f = np.where(c > 0.008856, np.cbrt(c), 7.787 * c + 16 / 116)
    return np.stack([116 * f[:, :, 1] - 16, 500 * (f[:, :, 0] - f[:, :, 1]), 200 * (f[:, :, 1] - f[:, :, 2])], axis=-1)


def from_lab(lab: np.ndarray) -> np.ndarray:
    y = (lab[:, :, 0] + 16) / 116
    f = np.stack([y + lab[:, :, 1] / 500, y, y - lab[:, :, 2] / 200], axis=-1)
    c = np.where(f > 0.206893, f**3, (f - 16 / 116) / 7.787) * _WHITE @ np.linalg.inv(_TO_XYZ).T
    c = np.clip(c, 0, 1)
    c = np.where(c > 0.0031308, 1.055 * c ** (1 / 2.4) - 0.055, 12.92 * c)
    return np.clip(np.round(c[:, :, ::-1] * 255), 0, 255).astype(np.uint8)


def local_contrast(image: np.ndarray, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """A BGR image with the lightness equalised."""
    lab = to_lab(image)
    light = np.clip(np.round(lab[:, :, 0] * 2.55), 0, 255).astype(np.uint8)
    lab[:, :, 0] = equalise(light, clip, tiles) / 2.55
    return from_lab(lab)


def sharpen(image: np.ndarray, sigma: float = 1.0, strength: float = 1.5) -> np.ndarray:
    """(1 + strength) times the image less strength times its Gaussian blur."""
    reach = int(round(sigma * 3))
    w = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    w /= w.sum()
    blur = image.astype(np.float64)
    for axis in (0, 1):
        pad = [(reach, reach) if a == axis else (0, 0) for a in range(3)]
        wide = np.pad(blur, pad, mode="reflect" if image.shape[axis] > reach else "edge")
        blur = sum(v * np.take(wide, np.arange(image.shape[axis]) + k, axis=axis) for k, v in enumerate(w))
    return np.clip(np.round((1 + strength) * image - strength * np.round(blur)), 0, 255).astype(np.uint8)


def with_border(image: np.ndarray, pad: int = 32) -> np.ndarray:
    """The image in a black border."""
    return np.pad(image, ((pad, pad), (pad, pad), (0, 0)))


def boxes_without_border(polygons, height: int, width: int, pad: int = 32) -> list[list[int]]:
    """Upright boxes of polygons found in a bordered image, moved back and cut to the image."""
    out = []
    for points in polygons:
        xs, ys = [int(p[0] - pad) for p in points], [int(p[1] - pad) for p in points]
        out.append([min(max(v, 0), most) for v, most in ((min(xs), width), (min(ys), height), (max(xs), width), (max(ys), height))])
    return out


def enhance(image: np.ndarray, min_side: int = 1500) -> tuple[np.ndarray, float]:
    """The three steps in order, and the factor of the first."""
    image, factor = upscale(image, min_side)
    return sharpen(local_contrast(image)), factor


def first_frame(frames):
    """The first of a list of frames; None of none."""
    return frames[0] if len(frames) else None
