"""Commands over the pipelines: ``python -m trailmark COMMAND ...``. Exit 0 if all is well, 1 on errors in the data or the call.

On a cluster, submit this file; the session is then the cluster's own.
"""

from __future__ import annotations

import argparse
import importlib
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.plans import pipelines, video
from trailmark.session import file_system, get_spark
from trailmark.sources import files, frames
from trailmark.streaming.motion import detection_totals


def _roi(text: str) -> tuple[int, int, int, int]:
    values = tuple(int(v) for v in text.split(","))
    if len(values) != 4:
        raise argparse.ArgumentTypeError("a region of interest is x,y,width,height")
    return values


def _frames(spark: SparkSession, path: str) -> tuple[frames.VideoInfo, DataFrame]:
    system, place = file_system(spark, path)
    return frames.read_y4m(spark, str(Path(path).resolve()) if "://" not in path else path, system.getFileStatus(place).getLen())


def _analyze(spark: SparkSession, a: argparse.Namespace) -> dict:
    info, rows = _frames(spark, a.video)
    report = video.analyze(rows, info.fps, a.roi, a.warmup, a.min_area, total_frames=info.frames)
    out = Path(a.output)
    report.tables["frames"].write.mode("overwrite").json(str(out.resolve() / "frames"))
    report.tables["heatmap"].write.mode("overwrite").parquet(str(out.resolve() / "heatmap"))
    document = {**report.counts, "fps": info.fps, "frames": info.frames, **report.tables["summary"].first().asDict()}
    files.write_report(out / "metrics.json", document)
    return document


def _extract(spark: SparkSession, a: argparse.Namespace) -> dict:
    info, rows = _frames(spark, a.video)
    files.claim_output(Path(a.output), ("*.png",), a.overwrite)
    images = video.extract_frames(rows, info.fps, a.every, a.count, a.seconds, a.roi)
    written = files.write_text_files(images, str(Path(a.output).resolve()), "image", "data").count()
    files.write_json_lines(images.drop("data"), str(Path(a.output).resolve() / "frames.jsonl"))
    return {"images": written}


def _detect(spark: SparkSession, a: argparse.Namespace) -> dict:
    info, rows = _frames(spark, a.video)
    module, _, name = a.model.partition(":")
    found = video.detect(rows, getattr(importlib.import_module(module), name), {0: "ant"}, info.fps, a.roi)
    files.write_json_lines(found.drop("stream"), a.output)
    return detection_totals(files.read_detections(spark, a.output)).first().asDict()


def _benchmark(spark: SparkSession, a: argparse.Namespace) -> dict:
    tables = [spark.read.parquet(f"{a.folder}/{name}") for name in ("images", "truth", "predictions")]
    got = pipelines.evaluate_benchmark(*tables)
    for name, df in got.items():
        df.write.mode("overwrite").parquet(f"{a.output}/{name}")
    return {"totals": [r.asDict() for r in got["totals"].collect()]}


def _convert(spark: SparkSession, a: argparse.Namespace) -> pipelines.Report:
    info = files.read_sequence_info((Path(a.folder) / "seqinfo.ini").read_text(encoding="utf-8"))
    listed = files.list_images(spark, str(Path(a.folder) / info.image_folder))
    own, failing = pipelines.sequence_images(listed, info)
    wrong = failing.count()
    if wrong:
        return pipelines.Report({"errors": wrong}, [], {"errors": failing.select("name", F.col("check").alias("error"))})
    return pipelines.convert_sequence(spark, str(Path(a.folder) / "gt"), info, own.select("frame"), a.output, a.overwrite)


COMMANDS = {
    "analyze": (_analyze, ["video", "--output", "--roi", "--warmup", "--min-area"]),
    "extract-frames": (_extract, ["video", "--output", "--roi", "--every", "--count", "--seconds", "--overwrite"]),
    "detect-video": (_detect, ["video", "--model", "--output", "--roi"]),
    "validate": (lambda spark, a: pipelines.validate_dataset(spark, a.yaml), ["yaml"]),
    "stats": (lambda spark, a: pipelines.dataset_statistics(spark, a.yaml), ["yaml"]),
    "inspect-export": (lambda spark, a: pipelines.inspect_export(spark, a.folder), ["folder"]),
    "prepare-export": (
        lambda spark, a: pipelines.prepare_export(spark, a.folder, a.train_fraction, a.gap, a.allow_test, output=a.output, overwrite=a.overwrite),
        ["folder", "--output", "--train-fraction", "--gap", "--allow-test", "--overwrite"],
    ),
    "evaluate-external": (lambda spark, a: pipelines.evaluate_external(spark, a.folder, spark.read.json(a.metrics), a.output), ["folder", "--metrics", "--output"]),
    "prepare-sequence": (_convert, ["folder", "--output", "--overwrite"]),
    "evaluate-benchmark": (_benchmark, ["folder", "--output"]),
}
OPTIONS = {
    "--output": {"required": True}, "--model": {"required": True, "help": "module:function that loads the model"}, "--metrics": {"required": True}, "--roi": {"type": _roi},
    "--warmup": {"type": int, "default": 25}, "--min-area": {"type": float, "default": 0.0}, "--every": {"type": int}, "--count": {"type": int}, "--seconds": {"type": float},
    "--train-fraction": {"type": float, "default": 0.8}, "--gap": {"type": int, "default": 0}, "--allow-test": {"action": "store_true"}, "--overwrite": {"action": "store_true"},
}


def main(words: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="trailmark")
    chosen = parser.add_subparsers(dest="command", required=True)
    for name, (_, arguments) in COMMANDS.items():
        own = chosen.add_parser(name)
        for argument in arguments:
            own.add_argument(argument, **OPTIONS.get(argument, {}))
    a = parser.parse_args(words)
    try:
        result = COMMANDS[a.command][0](spark or SparkSession.getActiveSession() or get_spark(), a)
    except pipelines.ReportError as failed:
        result = failed.report
    except (ValueError, OSError) as failed:
        print(f"error: {failed}", file=sys.stderr)
        return 1
    if isinstance(result, dict):
        result = pipelines.Report(result)
    print(json.dumps(result.counts, indent=2, default=str))
    for message in result.messages():
        print(message, file=sys.stderr)
    return 0 if result.ok else 1


if __name__ == "__main__":
    sys.exit(main())
