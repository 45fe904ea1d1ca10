"""Readers and writers of datasets on storage: label and ground-truth files, images, manifests, detections."""

from __future__ import annotations

import ast
import configparser
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.session import file_system, spread

#: Suffixes of image files.
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "bmp", "webp")


def _stem(path):
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")


def read_line_files(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """Lines of all files of a folder: (file, stem, line_no, line), line numbers from 1 kept over blank lines."""
    files = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True).withColumn("file", F.col("_metadata.file_path"))
    parts = F.split(F.regexp_replace("value", r"\r\n?", "\n"), "\n")
    lines = files.select("file", F.posexplode(parts).alias("i", "line"), F.size(parts).alias("n"))
    last_empty = (F.col("i") == F.col("n") - 1) & (F.col("line") == "") & (F.col("i") > 0)
    return lines.where(~last_empty).select("file", _stem(F.col("file")).alias("stem"), (F.col("i") + 1).alias("line_no"), "line")


def exists(spark: SparkSession, path: str) -> bool:
    system, place = file_system(spark, path)
    return system.exists(place)


def list_files(spark: SparkSession, folder: str, suffixes: tuple[str, ...]) -> DataFrame:
    """(file, name, stem, length) of files directly in a folder by suffix, case aside; an absent folder gives none.

    Names come from Spark's file index, which has empty files too; lengths from a scan of the files' metadata, which
    reads no content and leaves empty files out.
    """
    if not exists(spark, folder):
        return spark.createDataFrame([], "file string, name string, stem string, length bigint")
    system, place = file_system(spark, folder)
    scanned = spark.read.format("binaryFile").load(folder)
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    lengths = scanned.select(plain(F.col("path")).alias("file"), "length")
    names = spark.createDataFrame([(f,) for f in scanned.inputFiles()], "file string").select(plain(F.url_decode(F.replace(F.col("file"), F.lit("+"), F.lit("%2B")))).alias("file"))
    name = F.regexp_extract("file", r"([^/]*)$", 1)
    parent = str(system.makeQualified(place).toString()).rstrip("/") + "/"
    direct = names.where((F.regexp_replace("file", r"[^/]*$", "") == parent) & F.lower(F.regexp_extract("file", r"\.([^./]*)$", 1)).isin(*suffixes))
    return direct.join(lengths, "file", "left").select("file", name.alias("name"), _stem(F.col("file")).alias("stem"), F.coalesce("length", F.lit(0).cast("bigint")).alias("length"))


def list_images(spark: SparkSession, folder: str) -> DataFrame:
    return list_files(spark, folder, IMAGE_SUFFIXES)


def header_size(data: bytes) -> tuple[int, int] | None:
    """Width and height from the header of a PNG, BMP, JPEG or WebP; null if it isn't one."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return int.from_bytes(data[16:20], "big"), int.from_bytes(data[20:24], "big")
    if data[:2] == b"BM" and len(data) >= 26:
        return int.from_bytes(data[18:22], "little", signed=True), abs(int.from_bytes(data[22:26], "little", signed=True))
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP" and len(data) >= 30:
        kind = data[12:16]
        if kind == b"VP8X":
            return 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
        if kind == b"VP8L":
            bits = int.from_bytes(data[21:25], "little")
            return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
        if kind == b"VP8 ":
            return int.from_bytes(data[26:28], "little") & 0x3FFF, int.from_bytes(data[28:30], "little") & 0x3FFF
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data):
            if data[at] != 0xFF:
                return None
            marker, length = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            if marker == 0xFF:
                at += 1
            elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                return int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
            else:
                at += 2 + length
    return None


def _open(uri: str):
    """A stream of a file by its URI, on whatever file system; for readers on workers."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
    return system.open_input_stream(path)


def read_header(uri: str, least: int = 1 << 16) -> tuple[int, int] | None:
    """Width and height of an image file from its first bytes; more of it is read only while the header goes on."""
    try:
        with _open(uri) as stream:
            data = stream.read(least)
            size = header_size(data)
            while size is None and data[:2] == b"\xff\xd8" and (more := stream.read(len(data))):
                data += more
                size = header_size(data)
        return size
    except OSError:
        return None


def image_sizes(images: DataFrame) -> DataFrame:
    """(file, image_w, image_h) of listed images (file) from their headers; unreadable images have nulls."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [read_header(f) or (None, None) for f in batch["file"]]
            yield pd.DataFrame({"file": batch["file"], "image_w": pd.array([w for w, _ in found], "Int32"), "image_h": pd.array([h for _, h in found], "Int32")})

    return spread(images.select("file")).mapInPandas(run, "file string, image_w int, image_h int")


def file_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """(name, sha256) of the files of a folder."""
    return spark.read.format("binaryFile").load(folder).select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), F.sha2("content", 256).alias("sha256"))


#: A line of a dataset file: indented or not, a key and a value.
_ENTRY = re.compile(r"(?P<indent> {2})?\s*(?P<key>[^:]*?)\s*:\s*(?P<value>.*?)\s*")
_QUOTED = re.compile(r"([\"']?)(.*)\1")


def parse_dataset_yaml(text: str) -> dict:
    """The subset of YAML that dataset files use: scalars, and ``names`` as an indented map. ``#`` starts a comment anywhere."""
    lines = [bare for raw in text.splitlines() if (bare := raw.partition("#")[0].rstrip())]
    entries = [_ENTRY.fullmatch(line) for line in lines]
    if None in entries:
        raise ValueError(f"not a key and value: {lines[entries.index(None)]}")
    # Each entry with the unindented one that it stands under.
    owners = accumulate(entries, lambda owner, e: owner if e["indent"] and owner["key"] == "names" else e)
    plain = {e["key"]: _QUOTED.fullmatch(e["value"])[2] for e, owner in zip(entries, owners) if e is owner and (e["key"] != "names" or e["value"])}
    owners = accumulate(entries, lambda owner, e: owner if e["indent"] and owner["key"] == "names" else e)
    listed = {int(e["key"]): _QUOTED.fullmatch(e["value"])[2] for e, owner in zip(entries, owners) if e is not owner}
    return plain | ({"names": listed} if listed else {})


def dataset_yaml(train: str = "images/train", val: str = "images/val", root: str = ".", names: tuple[str, ...] = ("ant",)) -> str:
    """Text of a dataset file for :func:`parse_dataset_yaml` and detector trainers."""
    head = {"path": root, "train": train, "val": val}
    return "".join(f"{k}: {v}\n" for k, v in head.items()) + "names:\n" + "".join(f"  {i}: {name}\n" for i, name in enumerate(names))


def class_names(value) -> dict[int, str]:
    """Class names of a map or of the text of a list or map."""
    if isinstance(value, str):
        value = ast.literal_eval(value)
    pairs = value.items() if isinstance(value, dict) else enumerate(value)
    return {int(k): str(v) for k, v in pairs}


@dataclass(frozen=True)
class SplitPaths:
    images: Path
    labels: Path


def resolve_splits(yaml_path: Path, config: dict, splits: tuple[str, ...] = ("train", "val")) -> dict[str, SplitPaths]:
    """Folders of the splits; the root is relative to the YAML's folder, labels replace the last ``images`` of the path."""
    root = Path(config.get("path", "."))
    root = root if root.is_absolute() else yaml_path.parent / root
    found = {}
    for split in splits:
        if split not in config:
            raise ValueError(f"{yaml_path} has no {split}")
        images = root / config[split]
        places = [i for i, part in enumerate(images.parts) if part.lower() == "images"]
        if not places:
            raise ValueError(f"no images folder in {images}")
        parts = list(images.parts)
        parts[places[-1]] = "labels"
        found[split] = SplitPaths(images, Path(*parts))
    return found


@dataclass(frozen=True)
class SequenceInfo:
    name: str
    image_folder: str
    frame_rate: int
    frames: int
    width: int
    height: int
    extension: str


def read_sequence_info(text: str) -> SequenceInfo:
    parser = configparser.ConfigParser()
    parser.read_string(text)
    if not parser.has_section("Sequence"):
        raise ValueError("no section [Sequence]")
    s = parser["Sequence"]
    return SequenceInfo(s.get("name", ""), s.get("imDir", "img"), s.getint("frameRate"), s.getint("seqLength"), s.getint("imWidth"), s.getint("imHeight"), s.get("imExt", ".jpg"))


DETECTIONS = (
    "frameIndex bigint, timestampSeconds double, detections array<struct<classId: int, className: string, confidence: double, "
    "bbox: struct<x: double, y: double, width: double, height: double>>>"
)


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    """Detection lines, a row per frame, empty frames included."""
    return spark.read.schema(DETECTIONS).json(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def read_manifest(spark: SparkSession, path: str, lists: tuple[str, ...] = (), flags: tuple[str, ...] = (), nested: dict[str, str] | None = None) -> DataFrame:
    """CSV manifest with a header: ``;``-lists to arrays, True/False to booleans, JSON cells by their schema."""
    df = spark.read.csv(path, header=True, quote='"', escape='"')
    for c in lists:
        df = df.withColumn(c, F.when(F.col(c).isNotNull(), F.split(c, ";")))
    for c in flags:
        df = df.withColumn(c, F.lower(c) == "true")
    for c, schema in (nested or {}).items():
        df = df.withColumn(c, F.from_json(c, schema))
    return df


def label_texts(images: DataFrame, boxes: DataFrame, key: str, line: str, order: list[str]) -> DataFrame:
    """(key, text) of label files: a line per box in order; an image without boxes has an empty text, not none."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(*order, line))), lambda s: s[line])
    texts = boxes.groupBy(key).agg(F.array_join(ordered, "\n").alias("text"))
    return images.select(key).distinct().join(texts, key, "left").select(key, F.coalesce("text", F.lit("")).alias("text"))


def write_text_files(texts: DataFrame, folder: str, name: str, text: str) -> DataFrame:
    """Write a small file per row, named by ``name``, into a folder that all workers reach; an empty text is an empty file
    and binary content is written as it is.

    Gives (file, bytes) per file when it is evaluated. A file is written whole before it gets its name, so a task that
    runs again leaves the same files.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))
        system.create_dir(root, recursive=True)
        for batch in batches:
            sizes = []
            for n, t in zip(batch["name"], batch["text"]):
                data, part = t if isinstance(t, (bytes, bytearray)) else (t or "").encode(), f"{root}/.{uuid.uuid4().hex}.part"
                with system.open_output_stream(part) as out:
                    out.write(data)
                system.move(part, f"{root}/{n}")
                sizes.append(len(data))
            yield pd.DataFrame({"file": batch["name"], "bytes": sizes})

    return texts.select(F.col(name).alias("name"), F.col(text).alias("text")).mapInPandas(run, "file string, bytes bigint")


def copy_files(pairs: DataFrame, source: str, target: str) -> DataFrame:
    """Copy files by workers: (target, bytes) per file when it is evaluated; a copy gets its name when it is whole."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            sizes = []
            for origin, place in zip(batch["source"], batch["target"]):
                system, path = fs.FileSystem.from_uri(place.replace("s3a://", "s3://", 1))
                system.create_dir(path.rpartition("/")[0], recursive=True)
                part, n = f"{path}.{uuid.uuid4().hex}.part", 0
                with _open(origin) as data, system.open_output_stream(part) as out:
                    while block := data.read(1 << 20):
                        out.write(block)
                        n += len(block)
                system.move(part, path)
                sizes.append(n)
            yield pd.DataFrame({"target": batch["target"], "bytes": sizes})

    return pairs.select(F.col(source).alias("source"), F.col(target).alias("target")).mapInPandas(run, "target string, bytes bigint")


def write_report(path: Path, document: dict) -> None:
    """A report as JSON with an indent of 2 and a newline at its end."""
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(document, indent=2, default=str) + "\n", encoding="utf-8")


def discover_test_sets(root: Path) -> list[Path]:
    """Folders of external test videos: the root itself if it has ``images``, else its subfolders that do."""
    if (root / "images").is_dir():
        return [root]
    found = sorted(p for p in root.iterdir() if (p / "images").is_dir())
    if not found:
        raise ValueError(f"no images folder in {root} or below")
    return found


def claim_output(folder: Path, patterns: tuple[str, ...], overwrite: bool) -> None:
    """Make an output folder free of earlier results (files by pattern); others are kept. Refuses unless ``overwrite``."""
    folder.mkdir(parents=True, exist_ok=True)
    owned = [p for pattern in patterns for p in folder.glob(pattern) if p.is_file()]
    if owned and not overwrite:
        raise FileExistsError(f"{folder} holds earlier results; allow overwriting to replace them")
    for p in owned:
        p.unlink()


def verify_manifest(manifest: DataFrame, hashes: DataFrame, name: str = "name", sha: str = "sha256") -> DataFrame:
    """(name, matches) of a manifest against hashes of the files at hand, case aside; a file that is missing doesn't match."""
    here = hashes.select(F.col(name).alias("__n"), F.lower(sha).alias("__s")).distinct()
    joined = manifest.select(name, sha).join(here, F.col(name) == F.col("__n"), "left")
    return joined.groupBy(name).agg(F.coalesce(F.bool_and(F.lower(sha) == F.col("__s")), F.lit(False)).alias("matches"))
