"""Frames of uncompressed videos: a header probe and a reader by frame ranges; compressed ones come as frame tables."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.sources.files import _open

#: Bytes of a frame per pixel, by colour space of the format, as a ratio.
PLANES = {"mono": (1, 1), "420": (3, 2), "422": (2, 1), "444": (3, 1)}


@dataclass(frozen=True)
class VideoInfo:
    width: int
    height: int
    fps: float
    frames: int
    header: int
    frame_bytes: int


def probe_y4m(path: str, length: int) -> VideoInfo:
    """What the header of a YUV4MPEG2 file of ``length`` bytes says; a last frame that isn't whole doesn't count."""
    with _open(path) as data:
        line = data.read(4096).split(b"\n", 1)[0]
    words = line.decode("ascii", "replace").split(" ")
    if words[0] != "YUV4MPEG2":
        raise ValueError(f"{path} is no YUV4MPEG2 file")
    tags = {w[0]: w[1:] for w in words[1:] if w}
    width, height = int(tags["W"]), int(tags["H"])
    over, under = (int(n) for n in tags.get("F", "0:1").split(":"))
    colour = tags.get("C", "420")
    kind = next((k for k in PLANES if colour.startswith(k)), None)
    if kind is None or "p1" in colour:
        raise ValueError(f"{path} has samples of a kind that isn't read: {colour}")
    a, b = PLANES[kind]
    half = lambda n: (n + 1) // 2
    planes = width * height + 2 * half(width) * half(height) if kind == "420" else width * height + 2 * half(width) * height if kind == "422" else width * height * a // b
    size = planes + len(b"FRAME\n")
    return VideoInfo(width, height, over / under if under else 0.0, (length - len(line) - 1) // size, len(line) + 1, size)


def read_y4m(spark: SparkSession, path: str, length: int, stream: str | None = None) -> tuple[VideoInfo, DataFrame]:
    """(info, frames (stream, frame_index, height, width, pixels)) with the brightness of each pixel.

    Tasks read ranges of frames by their place in the file; a frame header with parameters ends the video like one
    that can't be read.
    """
    info = probe_y4m(path, length)
    name = stream if stream is not None else path.rpartition("/")[2]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, place = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
        with system.open_input_file(place) as data:
            for batch in batches:
                for i in batch["frame_index"]:
                    raw = data.read_at(info.frame_bytes, info.header + int(i) * info.frame_bytes)
                    if raw[:6] != b"FRAME\n":
                        return
                    yield pd.DataFrame({"stream": [name], "frame_index": [i], "height": [info.height], "width": [info.width], "pixels": [raw[6 : 6 + info.width * info.height]]})

    numbers = spark.range(info.frames).select(F.col("id").alias("frame_index"))
    return info, numbers.mapInPandas(run, "stream string, frame_index bigint, height int, width int, pixels binary")


def png(image: np.ndarray) -> bytes:
    """A PNG of grey (h, w) or coloured (h, w, 3) bytes."""
    colour = 2 if image.ndim == 3 else 0
    rows = np.concatenate([np.zeros((image.shape[0], 1), np.uint8), np.ascontiguousarray(image).reshape(image.shape[0], -1)], axis=1)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", image.shape[1], image.shape[0], 8, colour, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")
