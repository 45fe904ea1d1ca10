"""Motion detection on pixels, as a stage over ordered frames.

The stage takes any detector with ``detect(image) -> mask``. The built-in one blurs, keeps a mixture of Gaussians per
pixel (Zivkovic, 2004; Zivkovic and van der Heijden, 2006), opens and closes the mask. Blur, morphology, contour areas
and filled contours are exact in whole numbers; the mixture is in double precision, so that pixels at the very edge
of a threshold may differ from native libraries in single precision.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


class Detector(Protocol):
    def detect(self, image: np.ndarray) -> np.ndarray:
        """Mask of moving pixels."""


#: The 5 x 5 binomial kernel's row, and the elements of opening and closing.
BLUR = (1, 4, 6, 4, 1)
CROSS = ("010", "111", "010")
DISK = ("00100", "11111", "11111", "11111", "00100")


def blur(image: np.ndarray) -> np.ndarray:
    """Binomial 5 x 5 blur of bytes, edges mirrored without their own pixel, halves rounded up."""
    out = image.astype(np.int64)
    for axis in (0, 1):
        pad = [(2, 2) if a == axis else (0, 0) for a in range(out.ndim)]
        wide = np.pad(out, pad, "reflect" if out.shape[axis] > 2 else "edge")
        out = sum(w * np.take(wide, range(i, i + out.shape[axis]), axis) for i, w in enumerate(BLUR))
    return ((out + 128) >> 8).astype(np.uint8)


def _moved(mask: np.ndarray, element: tuple[str, ...], outside: bool) -> Iterator[np.ndarray]:
    r = len(element) // 2
    wide = np.pad(mask, r, constant_values=outside)
    for dy, row in enumerate(element):
        for dx, bit in enumerate(row):
            if bit == "1":
                yield wide[dy : dy + mask.shape[0], dx : dx + mask.shape[1]]


def erode(mask: np.ndarray, element: tuple[str, ...]) -> np.ndarray:
    return np.logical_and.reduce(list(_moved(mask, element, True)))


def dilate(mask: np.ndarray, element: tuple[str, ...]) -> np.ndarray:
    return np.logical_or.reduce(list(_moved(mask, element, False)))


class Mixture:
    """Background as at most ``modes`` Gaussians of one variance per pixel, heaviest first.

    ``history`` bounds the learning rate from below; a pixel is background if it is within ``near`` variances of a mode
    among the heaviest that together make up ``ratio`` of the weight.
    """

    def __init__(self, history: int = 500, near: float = 16.0, modes: int = 5, ratio: float = 0.9, own: float = 9.0, prior: float = 0.05, variances: tuple[float, float, float] = (4.0, 15.0, 75.0)):
        self.history, self.near, self.modes, self.ratio, self.own, self.prior = history, near, modes, ratio, own, prior
        self.least, self.first, self.most = variances
        self.seen, self.weight, self.mean, self.variance = 0, None, None, None

    def detect(self, image: np.ndarray) -> np.ndarray:
        """Mask of pixels that aren't background; the frame is learned."""
        x = image.reshape(image.shape[0] * image.shape[1], -1).astype(float)
        if self.weight is None:
            self.weight = np.zeros((self.modes, len(x)))
            self.mean, self.variance = np.zeros((self.modes, *x.shape)), np.full((self.modes, len(x)), self.first)
        self.seen += 1
        rate = 1.0 / min(2 * self.seen, self.history)
        away = ((self.mean - x) ** 2).sum(axis=2)
        # Weights decay, and what has sunk below the prior goes; the first close mode takes the pixel.
        there = self.weight > 0
        close = there & (away < self.own * self.variance)
        taker = close & (np.cumsum(close, axis=0) == 1)
        weight = np.where(there, (1 - rate) * self.weight - rate * self.prior, 0.0) + rate * taker
        weight[weight < rate * self.prior] = 0.0
        before = np.cumsum(weight, axis=0) - weight
        # Modes after the one that took the pixel aren't asked.
        asked = np.cumsum(taker, axis=0) - taker == 0
        background = (there & asked & (before < self.ratio) & (away < self.near * self.variance)).any(axis=0)
        share = np.divide(rate, weight, out=np.zeros_like(weight), where=taker & (weight > 0))
        self.mean -= share[:, :, None] * (self.mean - x)
        self.variance = np.where(taker, np.clip(self.variance + share * (away - self.variance), self.least, self.most), self.variance)
        total = weight.sum(axis=0)
        weight = np.divide(weight, total, out=np.zeros_like(weight), where=total > 0)
        # A pixel that no mode took starts one, in place of the lightest if there is no room.
        lost = np.flatnonzero(~taker.any(axis=0))
        if len(lost):
            held = (weight[:, lost] > 0).sum(axis=0)
            slot = np.where(held < self.modes, np.argmin(weight[:, lost] > 0, axis=0), np.argmin(weight[:, lost], axis=0))
            weight[slot, lost] = 0.0
            rest = weight[:, lost].sum(axis=0)
            alone = rest <= 0
            weight[:, lost] *= np.where(alone, 0.0, (1 - rate) / np.where(alone, 1.0, rest))
            weight[slot, lost] = np.where(alone, 1.0, rate)
            self.mean[slot, lost] = x[lost]
            self.variance[slot, lost] = self.first
        order = np.lexsort((~taker, -weight), axis=0)
        self.weight = np.take_along_axis(weight, order, 0)
        self.variance = np.take_along_axis(self.variance, order, 0)
        self.mean = np.take_along_axis(self.mean, order[:, :, None], 0)
        return ~background.reshape(image.shape[:2])


class MotionDetector:
    """Blur, background mixture, opening by a cross of 3 and closing by a disk of 5."""

    def __init__(self, history: int = 500, near: float = 16.0):
        self.background = Mixture(history, near)

    def detect(self, image: np.ndarray) -> np.ndarray:
        mask = self.background.detect(blur(image))
        mask = dilate(erode(mask, CROSS), CROSS)
        return erode(dilate(mask, DISK), DISK)


def components(mask: np.ndarray, diagonal: bool) -> tuple[np.ndarray, int]:
    """Numbers from 1 of connected pixels in reading order of their first, over runs of rows; 0 elsewhere."""
    wide = np.pad(mask, ((0, 0), (1, 1))).astype(np.int8)
    edges = np.diff(wide, axis=1)
    rows, begins = np.nonzero(edges == 1)
    _, ends = np.nonzero(edges == -1)
    parent = list(range(len(rows)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first = np.searchsorted(rows, np.arange(mask.shape[0] + 1))
    reach = 1 if diagonal else 0
    for y in range(1, mask.shape[0]):
        above, here = first[y - 1], first[y]
        while above < first[y] and here < first[y + 1]:
            if begins[above] < ends[here] + reach and begins[here] < ends[above] + reach:
                a, b = root(int(above)), root(int(here))
                parent[max(a, b)] = min(a, b)
            if ends[above] < ends[here]:
                above += 1
            else:
                here += 1
    numbers: dict[int, int] = {}
    out = np.zeros(mask.shape, np.int32)
    for i, (y, a, b) in enumerate(zip(rows, begins, ends)):
        out[y, a:b] = numbers.setdefault(root(i), len(numbers) + 1)
    return out, len(numbers)


#: The eight neighbours (dy, dx), clockwise from the left.
_AROUND = ((0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1))


def outline_area(mask: np.ndarray) -> float:
    """Area within the line through the centres of the border pixels of a connected region, once around its outside."""
    wide = np.pad(mask, 1)
    start = tuple(int(v) for v in np.argwhere(wide)[0])
    at, came, doubled, begun = start, 0, 0, None
    while True:
        for turn in range(8):
            way = (came + turn) % 8
            after = (at[0] + _AROUND[way][0], at[1] + _AROUND[way][1])
            if wide[after]:
                break
        else:
            return 0.0
        if (at, way) == begun:
            return abs(doubled) / 2
        begun = begun or (at, way)
        doubled += at[1] * after[0] - after[1] * at[0]
        at, came = after, (way + 5) % 8  # go on just after the background that was passed


def filled(mask: np.ndarray) -> np.ndarray:
    """The mask without holes."""
    ground, _ = components(np.pad(~mask, 1, constant_values=True), False)
    return (ground != 1)[1:-1, 1:-1]


def moving_regions(mask: np.ndarray, min_area: float) -> tuple[np.ndarray, list[tuple[int, int, int, int, float]]]:
    """Filled mask of the regions with an outline of at least ``min_area``, and their boxes (x, y, width, height, area),
    largest first, then by place."""
    numbered, n = components(filled(mask), True)
    kept, found = np.zeros(mask.shape, bool), []
    for i in range(1, n + 1):
        own = numbered == i
        ys, xs = np.flatnonzero(own.any(axis=1)), np.flatnonzero(own.any(axis=0))
        y, x, h, w = int(ys[0]), int(xs[0]), int(ys[-1] - ys[0] + 1), int(xs[-1] - xs[0] + 1)
        area = outline_area(own[y : y + h, x : x + w])
        if area >= min_area:
            kept |= own
            found.append((x, y, w, h, area))
    return kept, sorted(found, key=lambda r: -r[4])


def motion_frames(
    frames: DataFrame, warmup: int, min_area: float, detector: Callable[[], Detector] = MotionDetector, roi: tuple[int, int, int, int] | None = None, stream: str = "stream"
) -> DataFrame:
    """(stream, frame_index, scored, score, regions, boxes, cells) of frames (stream, frame_index, height, width, pixels as bytes).

    Frames of a stream are sorted within its partition and pass one detector in order; a partition holds one frame at a
    time in memory beside the current batch. ``roi`` (x, y, width, height) crops first; the score is its share of moving
    pixels. Boxes and set ``cells`` (y, x) have the place in the whole frame. Warm-up frames train the detector,
    score 0 and have none.
    """
    kind = frames.schema[stream].dataType.simpleString()
    schema = (
        f"{stream} {kind}, frame_index bigint, scored boolean, score double, regions int, "
        "boxes array<struct<x: int, y: int, width: int, height: int, area: double>>, cells array<struct<y: int, x: int>>"
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, model = None, None
        for batch in batches:
            out = []
            for name, index, height, width, data in zip(batch[stream], batch["frame_index"], batch["height"], batch["width"], batch["pixels"]):
                if model is None or name != current:
                    current, model = name, detector()
                left, top, w, h = roi or (0, 0, width, height)
                image = np.frombuffer(data, np.uint8).reshape(height, width, -1).squeeze()[top : top + h, left : left + w]
                mask, scored = model.detect(image), index >= warmup
                mask, boxes = moving_regions(mask, min_area) if scored else (np.zeros_like(mask), [])
                score = float(np.count_nonzero(mask)) / mask.size if mask.size else 0.0
                placed = [{"x": x + left, "y": y + top, "width": bw, "height": bh, "area": area} for x, y, bw, bh, area in boxes]
                cells = [{"y": int(y) + top, "x": int(x) + left} for y, x in np.argwhere(mask)]
                out.append((name, index, scored, score, len(boxes), placed, cells))
            yield pd.DataFrame(out, columns=[stream, "frame_index", "scored", "score", "regions", "boxes", "cells"])

    ordered = frames.select(stream, "frame_index", "height", "width", "pixels").repartition(stream).sortWithinPartitions(stream, "frame_index")
    return ordered.mapInPandas(run, schema)
