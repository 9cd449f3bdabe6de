"""Raster kernels in numpy: resizing, blurs, morphology, saliency, hole filling."""

from __future__ import annotations

import numpy as np


class SaliencyError(ValueError):
    """A saliency map that no mask can be made from."""


def gray(rgb: np.ndarray) -> np.ndarray:
    return (rgb.astype(np.float32) @ np.array([0.299, 0.587, 0.114], np.float32)).astype(np.float32)


def _area_matrix(n: int, m: int) -> np.ndarray:
    """Weights that average n cells into m by overlap."""
    edge = np.linspace(0, n, m + 1)
    low, high = edge[:-1, None], edge[1:, None]
    i = np.arange(n)[None, :]
    cover = np.clip(np.minimum(high, i + 1) - np.maximum(low, i), 0, None)
    return (cover / cover.sum(axis=1, keepdims=True)).astype(np.float32)


def _linear_matrix(n: int, m: int) -> np.ndarray:
    at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
    low = np.minimum(at.astype(int), max(n - 2, 0))
    out = np.zeros((m, n), np.float32)
    out[np.arange(m), low] += 1 - (at - low)
    out[np.arange(m), np.minimum(low + 1, n - 1)] += at - low
    return out


def resize(image: np.ndarray, h: int, w: int, how: str) -> np.ndarray:
    """how: area, linear, or nearest (of masks)."""
    if how == "nearest":
        y = np.minimum(np.arange(h) * image.shape[0] // h, image.shape[0] - 1)
        x = np.minimum(np.arange(w) * image.shape[1] // w, image.shape[1] - 1)
        return image[y][:, x]
    make = _area_matrix if how == "area" else _linear_matrix
    rows, columns = make(image.shape[0], h), make(image.shape[1], w)
    return np.einsum("ij,jk...,lk->il...", rows, image.astype(np.float32), columns, optimize=True)


def _separable(image: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    r = len(kernel) // 2
    padded = np.pad(image, r, mode="reflect" if min(image.shape) > r else "edge")
    rows = sum(k * padded[i : i + image.shape[0]] for i, k in enumerate(kernel))
    return sum(k * rows[:, i : i + image.shape[1]] for i, k in enumerate(kernel)).astype(np.float32)


def min_max(x: np.ndarray, least: float = 1e-6) -> np.ndarray:
    """Scaled to 0..1; flat maps become zero."""
    low, high = float(x.min()), float(x.max())
    return np.zeros(x.shape, np.float32) if high - low <= least else ((x - low) / (high - low)).astype(np.float32)


def spectral_saliency(rgb: np.ndarray) -> np.ndarray:
    """Spectral residual: what remains of the log amplitude after its local mean, transformed back, smoothed and scaled."""
    small = resize(gray(rgb), 64, 64, "area")
    if float(small.max() - small.min()) <= 1e-3:  # of 255; resizing a flat picture leaves rounding errors
        return np.zeros(rgb.shape[:2], np.float32)
    f = np.fft.fft2(small)
    amplitude = np.log(np.abs(f) + 1e-8).astype(np.float32)
    residual = amplitude - _separable(amplitude, np.full(3, 1 / 3))
    power = np.abs(np.fft.ifft2(np.exp(residual + 1j * np.angle(f)))) ** 2
    g = np.exp(-(np.arange(-2, 3) ** 2) / (2 * 3.0**2))
    return min_max(resize(_separable(power.astype(np.float32), g / g.sum()), *rgb.shape[:2], "linear"))


def ellipse(size: int) -> np.ndarray:
    """An elliptic structuring element inside a size x size box."""
    r = size // 2
    y = np.arange(size) - r
    half = np.rint(r * np.sqrt(np.maximum(0, 1 - (y / r) ** 2))).astype(int) if r else np.zeros(1, int)
    return (np.abs(np.arange(size) - r)[None, :] <= half[:, None]).astype(np.uint8)


def dilate(mask: np.ndarray, element: np.ndarray) -> np.ndarray:
    r = element.shape[0] // 2
    out = np.zeros_like(mask)
    padded = np.pad(mask, r)
    for i, j in np.argwhere(element):
        np.maximum(out, padded[i : i + mask.shape[0], j : j + mask.shape[1]], out=out)
    return out


def close(mask: np.ndarray, element: np.ndarray) -> np.ndarray:
    r = element.shape[0]
    big = dilate(np.pad(mask, r), element)
    return (1 - dilate(1 - big, element))[r:-r, r:-r]


def fill_holes(mask: np.ndarray) -> np.ndarray:
    """Sets background that isn't 8-connected to the border, by growing the border's background until it stays the same."""
    free = np.pad(mask, 1) == 0
    reached = np.zeros_like(free)
    reached[[0, -1], :] = reached[:, [0, -1]] = True
    while True:
        grown = reached.copy()
        for axis in (0, 1):  # whole runs at a time, along and across
            for flip in (1, -1):
                g, f = (np.swapaxes(a, 0, axis)[::flip] for a in (grown, free))
                for i in range(1, len(g)):
                    near = g[i - 1].copy()
                    near[1:] |= g[i - 1][:-1]
                    near[:-1] |= g[i - 1][1:]
                    g[i] |= near & f[i]
        if (grown == reached).all():
            return (~reached[1:-1, 1:-1]).astype(np.uint8)
        reached = grown


def threshold_mask(saliency: np.ndarray, percentile: float) -> np.ndarray:
    """Values at the percentile or above; where that is the least value, those above the least."""
    low, high = float(saliency.min()), float(saliency.max())
    if high - low <= 1e-6:
        return np.zeros(saliency.shape, np.uint8)
    t = float(np.percentile(saliency, percentile))
    return (saliency > low + 1e-6 if t <= low + 1e-6 else saliency >= t).astype(np.uint8)


def mask_stages(saliency: np.ndarray, percentile: float = 90.0, dilate_px: int = 5) -> dict[str, np.ndarray]:
    """The mask after threshold, close, fill and dilate."""
    if saliency.ndim != 2 or not np.isfinite(saliency).all():
        raise SaliencyError("saliency must be a finite two-dimensional map")
    if not 0 <= percentile <= 100 or dilate_px < 0:
        raise SaliencyError("percentile must be 0 to 100 and dilate_px not negative")
    out = {"threshold": threshold_mask(saliency, percentile)}
    out["close"] = close(out["threshold"], ellipse(2 * max(dilate_px, 3) + 1))
    out["fill"] = fill_holes(out["close"])
    out["dilate"] = dilate(out["fill"], ellipse(2 * dilate_px + 1)) if dilate_px else out["fill"]
    return out


def network_input(rgb: np.ndarray, side: int = 320) -> np.ndarray:
    """1 x 3 x side x side, scaled by 255 and standardised by the ImageNet means and deviations."""
    x = resize(rgb, side, side, "area") / 255
    mean, deviation = np.array([0.485, 0.456, 0.406], np.float32), np.array([0.229, 0.224, 0.225], np.float32)
    return ((x - mean) / deviation).transpose(2, 0, 1)[None].astype(np.float32)


def network_output(out: np.ndarray, h: int, w: int) -> np.ndarray:
    """A prediction scaled to 0..1 and then resized."""
    x = np.squeeze(np.asarray(out, np.float32))
    if x.ndim != 2 or not np.isfinite(x).all():
        raise SaliencyError("the network's output is not a finite two-dimensional map")
    return resize(min_max(x), h, w, "linear")
