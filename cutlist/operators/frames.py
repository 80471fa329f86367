"""Pictures as rows: (source, time_ms, width, height, luma BINARY, color_fraction), and whether they look like rolling text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed values of the rules: brightness bounds, shares of a picture, glyph sizes and row counts.
DARK, BRIGHT, COLORED, COLOR_RANGE = 35, 110, 100, 48
MOST_WIDTH, MOST_HEIGHT, LEAST_SIDE = 640, 360, 32
MIN_DARK, MIN_BRIGHT, MAX_BRIGHT, MAX_COLOR = 0.83, 0.005, 0.18, 0.08
MIN_GLYPHS, MIN_LINES, MAX_LINES, LINE_GLYPHS = 24, 3, 24, 5


def reduced(bgra: DataFrame) -> DataFrame:
    """(source, time_ms, width, height, bgra) -> luma at no more than 640 by 360, nearest neighbours, and the share of coloured among bright pixels.

    Pictures whose bytes do not fit their size are left out.
    """

    def run(batches):
        for b in batches:
            out = []
            for source, time, w, h, raw in zip(*[c.to_pylist() for c in b.columns]):
                if not raw or not w or not h or len(raw) != w * h * 4:
                    continue
                nw = min(MOST_WIDTH, w)
                nh = min(max(h * nw // w, 1), MOST_HEIGHT)
                px = np.frombuffer(raw, np.uint8).reshape(h, w, 4)[np.arange(nh) * h // nh][:, np.arange(nw) * w // nw, :3].astype(np.int64)
                luma = (px[..., 2] * 54 + px[..., 1] * 183 + px[..., 0] * 19) // 256
                bright = luma > COLORED
                colored = bright & (px.max(-1) - px.min(-1) > COLOR_RANGE)
                out.append((source, time, nw, nh, luma.astype(np.uint8).tobytes(), float(colored.sum() / max(bright.sum(), 1))))
            if out:
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["source", "time_ms", "width", "height", "luma", "color_fraction"])

    return bgra.select("source", "time_ms", "width", "height", "bgra").mapInArrow(run, "source long, time_ms long, width long, height long, luma binary, color_fraction double")


def glyph_boxes(mask: np.ndarray) -> np.ndarray:
    """(left, right, top, bottom, area) of the 4-connected parts of a picture, from runs of set pixels in its rows."""
    padded = np.pad(mask.astype(np.int8), ((0, 0), (1, 1)))
    step = np.diff(padded, axis=1)
    row, start = np.nonzero(step == 1)
    end = np.nonzero(step == -1)[1]
    if not len(row):
        return np.zeros((0, 5), np.int64)
    # runs of neighbouring rows that overlap: all of one row that end behind a run's start and begin before its end
    key_end, key_start = row * (mask.shape[1] + 1) + end, row * (mask.shape[1] + 1) + start
    lo = np.searchsorted(key_end, (row + 1) * (mask.shape[1] + 1) + start, "right")
    hi = np.searchsorted(key_start, (row + 1) * (mask.shape[1] + 1) + end, "left")
    n = np.maximum(hi - lo, 0)
    a = np.repeat(np.arange(len(row)), n)
    b = np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)
    root = np.arange(len(row))
    while len(a):
        ra, rb = root[a], root[b]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while not (root[root] == root).all():
            root = root[root]
        live = root[a] != root[b]
        a, b = a[live], b[live]
    _, part = np.unique(root, return_inverse=True)
    k = part.max() + 1
    out = np.zeros((k, 5), np.int64)
    out[:, 0], out[:, 2] = 2**31, 2**31
    np.minimum.at(out[:, 0], part, start)
    np.maximum.at(out[:, 1], part, end - 1)
    np.minimum.at(out[:, 2], part, row)
    np.maximum.at(out[:, 3], part, row)
    np.add.at(out[:, 4], part, end - start)
    return out


def text_like(luma: np.ndarray, color_fraction: float) -> bool:
    """Mostly dark, little colour, and bright parts that are small like letters and stand in several rows."""
    height, width = luma.shape
    mask = luma >= BRIGHT
    bright, dark = mask.mean(), (luma <= DARK).mean()
    if dark < MIN_DARK or not MIN_BRIGHT <= bright <= MAX_BRIGHT or color_fraction > MAX_COLOR:
        return False
    scale = min(max(-(-width // 320), 1), 2)
    boxes = glyph_boxes(mask)
    w, h, area = boxes[:, 1] - boxes[:, 0] + 1, boxes[:, 3] - boxes[:, 2] + 1, boxes[:, 4]
    small = (area >= 2) & (area <= 96 * scale**2) & (h >= 2) & (h <= 14 * scale) & (w >= 2) & (w <= 18 * scale)
    glyphs = boxes[small & (area * 8 >= w * h) & (area * 100 <= w * h * 90)]
    step = 3 * scale
    rows = np.bincount(glyphs[:, 3] // step, minlength=-(-height // step))
    lines = aligned = k = 0
    while k < len(rows):  # two neighbouring bins make a row
        count = int(rows[k : k + 2].sum())
        lines, aligned, k = (lines + 1, aligned + count, k + 3) if count >= LINE_GLYPHS else (lines, aligned, k + 1)
    n = len(glyphs)
    dense = int(np.sort(rows)[::-1][: -(-height // (10 * scale))].sum())
    return bool(n >= MIN_GLYPHS and MIN_LINES <= lines <= MAX_LINES and glyphs[:, 4].sum() * 100 >= mask.sum() * 65 and aligned * 100 >= n * 65 and dense * 100 >= n * 70)


def observed(frames: DataFrame) -> DataFrame:
    """(source, time_ms, text_like, dark_fraction, bright_fraction, color_fraction); pictures of a wrong size are left out."""

    def run(batches):
        for b in batches:
            out = []
            for source, time, w, h, raw, color in zip(*[c.to_pylist() for c in b.columns]):
                if raw is None or w is None or h is None or min(w, h) < LEAST_SIDE or w * h > MOST_WIDTH * MOST_HEIGHT or len(raw) != w * h:
                    continue
                luma = np.frombuffer(raw, np.uint8).reshape(h, w)
                out.append((source, time, text_like(luma, color or 0.0), float((luma <= DARK).mean()), float((luma >= BRIGHT).mean()), color))
            if out:
                types = [pa.int64(), pa.int64(), pa.bool_(), pa.float64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["source", "time_ms", "text_like", "dark_fraction", "bright_fraction", "color_fraction"])

    return frames.select("source", "time_ms", "width", "height", "luma", "color_fraction").mapInArrow(run, "source long, time_ms long, text_like boolean, dark_fraction double, bright_fraction double, color_fraction double")
