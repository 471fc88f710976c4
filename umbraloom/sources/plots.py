"""Plain figures as PNG: estimates against references, and error maps. Without data there is none."""

from __future__ import annotations

import numpy as np

from umbraloom.sources.png import png_bytes

SIDE, PAD = 400, 20


def scatter_png(reference: np.ndarray, estimate: np.ndarray) -> bytes | None:
    """Points over the line of equality, on axes from 0 to the largest value of both."""
    ok = np.isfinite(reference) & np.isfinite(estimate)
    if not ok.any():
        return None
    x, y = reference[ok], estimate[ok]
    top = max(float(x.max()), float(y.max()), 1e-9)
    img = np.full((SIDE, SIDE, 3), 255, np.uint8)
    at = np.arange(PAD, SIDE - PAD)
    img[SIDE - PAD, at], img[at, PAD], img[SIDE - at, at] = 0, 0, 200
    place = lambda v: np.clip(PAD + np.rint(np.clip(v / top, 0, 1) * (SIDE - 2 * PAD)), 2, SIDE - 3).astype(int)
    for c, r in zip(place(x), SIDE - place(y), strict=True):
        img[r - 2 : r + 3, c - 2 : c + 3] = (30, 80, 200)
    return png_bytes(img)


def error_map_png(error: np.ndarray, limit: float | None = None) -> bytes | None:
    """Blue below zero, red above, white at zero, grey without a value."""
    ok = np.isfinite(error)
    if not ok.any():
        return None
    limit = limit or float(np.abs(error[ok]).max()) or 1.0
    v = np.clip(np.where(ok, error, 0) / limit, -1, 1)
    fade = np.rint(255 * (1 - np.abs(v))).astype(np.uint8)
    img = np.stack([np.where(v >= 0, 255, fade), fade, np.where(v >= 0, fade, 255)], axis=2).astype(np.uint8)
    img[~ok] = 128
    return png_bytes(img)
