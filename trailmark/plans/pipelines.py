"""Pipelines over dataset folders: validation, statistics, export preparation, sequence conversion, evaluation.

Each is a composition of the table operators; only counts reach the driver. Folders are local paths or URIs of
a file system that all executors share. Errors are a table with a row for each, however many there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.functions.numeric import first_error
from trailmark.operators import evaluation, labels, statistics, temporal, tracking
from trailmark.plans.provenance import path_errors
from trailmark.session import materialize
from trailmark.sources import files

EXPORT_SPLITS = ("train", "valid", "test")


@dataclass(frozen=True)
class Report:
    """Counts of a pipeline, ``problems`` with the dataset as a whole, and ``tables`` with its results; the table
    ``errors`` has a row for each error and ``counts["errors"]`` their number."""

    counts: dict
    problems: list[str] = field(default_factory=list)
    tables: dict[str, DataFrame] = field(default_factory=dict)

    @property
    def ok(self) -> bool:
        return not self.problems and not self.counts.get("errors", 0)

    def messages(self) -> Iterator[str]:
        """All problems and errors as text, in order; the caller takes as many as wanted."""
        yield from self.problems
        if "errors" in self.tables:
            errors = self.tables["errors"]
            for r in errors.orderBy(*errors.columns).toLocalIterator():
                place = "/".join(str(r[c]) for c in errors.columns if c != "error" and r[c] is not None)
                yield f"{place} {r.error}"


class ReportError(ValueError):
    """Raised where errors are fatal; ``report`` has all of them."""

    def __init__(self, report: Report):
        super().__init__("\n".join([*report.problems, f"{report.counts.get('errors', 0)} errors, listed in the report's table"]))
        self.report = report


def _split_tables(spark: SparkSession, split: str, images: str, label_folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images with sizes, label files, label lines) of one split; an empty label file is a file."""
    listed = files.list_images(spark, images)
    rows = listed.join(files.image_sizes(listed), "file", "left")
    label_files = files.list_files(spark, label_folder, ("txt",)).select("stem")
    empty = "file string, stem string, line_no int, line string"
    lines = files.read_line_files(spark, label_folder) if files.exists(spark, label_folder) else spark.createDataFrame([], empty)
    return tuple(df.withColumn("split", F.lit(split)) for df in (rows, label_files, lines))


def read_dataset(spark: SparkSession, folders: dict[str, tuple[str, str]]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, label files, label lines with image sizes) of all splits."""
    parts = zip(*[_split_tables(spark, split, images, own) for split, (images, own) in folders.items()])
    images, label_files, lines = (reduce(DataFrame.unionByName, same) for same in parts)
    images = materialize(images, "images")  # headers are read once
    return images, label_files, lines.join(images.select("split", "stem", "image_w", "image_h"), ["split", "stem"], "left")


def dataset_errors(images: DataFrame, label_files: DataFrame, parsed: DataFrame, every_line: bool) -> DataFrame:
    """(split, stem, line_no, error): missing labels, orphan labels, unreadable images and bad lines.

    ``every_line`` keeps all bad lines of a file, else its first one.
    """
    none = F.lit(None).cast("int").alias("line_no")
    missing = images.join(label_files, ["split", "stem"], "left_anti").select("split", "stem", none, F.lit("Missing label for image").alias("error"))
    orphan = label_files.join(images, ["split", "stem"], "left_anti").select("split", "stem", none, F.lit("Label without image").alias("error"))
    unread = images.where(F.col("image_w").isNull()).join(label_files, ["split", "stem"], "left_semi").select("split", "stem", none, F.lit("Image could not be read").alias("error"))
    bad = labels.all_errors(parsed).select("split", "stem", F.col("line_no").cast("int"), "error")
    if not every_line:
        bad = bad.groupBy("split", "stem").agg(F.min(F.struct("line_no", "error")).alias("b")).select("split", "stem", "b.*")
    return missing.unionByName(orphan).unionByName(unread).unionByName(bad)


def _folder_statistics(images: DataFrame, clean: DataFrame) -> dict:
    keyed = lambda df: df.withColumn("key", F.concat_ws("/", "split", "stem"))
    return {r.split: r.asDict() for r in statistics.split_statistics(keyed(images), keyed(clean), "split", "key").collect()}


def validate_folders(spark: SparkSession, folders: dict[str, tuple[str, str]]) -> Report:
    """Check splits of (images, labels) folders; a file with a bad line counts no annotations, and its first is reported."""
    images, label_files, lines = read_dataset(spark, folders)
    readable = lines.join(images.where(F.col("image_w").isNotNull()), ["split", "stem"], "left_semi")
    parsed = materialize(labels.parse_labels(readable, polygons=False, image_w="image_w", image_h="image_h"), "parsed")
    clean = parsed.join(labels.all_errors(parsed).select("split", "stem").distinct(), ["split", "stem"], "left_anti")
    errors = materialize(dataset_errors(images, label_files, parsed, every_line=False), "errors")
    splits = _folder_statistics(images, clean)
    problems = [f"split {s} has no images" for s in folders if s not in splits]
    return Report({"splits": splits, "errors": errors.count()}, problems, {"images": images, "boxes": clean, "errors": errors})


def validate_dataset(spark: SparkSession, yaml_path: str) -> Report:
    """Check a dataset of train and val folders, named by its YAML file."""
    config = files.parse_dataset_yaml(Path(yaml_path).read_text(encoding="utf-8"))
    problems = [f"{yaml_path} has no {s}" for s in ("train", "val") if s not in config]
    if config.get("names") != {0: "ant"}:
        problems.append("names must be exactly 0: ant")
    if problems:
        return Report({}, problems)
    paths = files.resolve_splits(Path(yaml_path), config)
    return validate_folders(spark, {s: (str(p.images), str(p.labels)) for s, p in paths.items()})


def dataset_statistics(spark: SparkSession, yaml_path: str) -> Report:
    """Counts per split and size percentiles over all splits; any error is fatal."""
    report = validate_dataset(spark, yaml_path)
    if not report.ok:
        raise ReportError(report)
    sizes = statistics.size_percentiles(report.tables["boxes"], [])
    row = sizes.first()
    return Report({**report.counts, **{c: (row[c] if row and row[c] is not None else 0.0) for c in sizes.columns}}, [], report.tables)


def _child(folder: str, *parts: str) -> str:
    return "/".join([folder.rstrip("/"), *parts])


def export_counts(images: DataFrame, label_files: DataFrame, records: DataFrame, parsed: DataFrame) -> dict:
    """Counters of an export: images and labels of each split, images with and without a label line, annotations by
    format, invalid lines, and all class ids that any line names, valid or not."""
    zero = {s: 0 for s in EXPORT_SPLITS}
    per = lambda df: zero | {r.split: r.n for r in df.groupBy("split").agg(F.count("*").alias("n")).collect()}
    ok = F.col("error").isNull()
    lines = parsed.agg(
        F.count_if(ok & (F.col("format") == "detection")).alias("detections"), F.count_if(ok & (F.col("format") == "segmentation")).alias("polygons"),
        F.count_if(~ok).alias("invalid_lines"), F.sort_array(F.collect_set("class_id")).alias("class_ids"),
    ).first().asDict()
    labelled = records.join(parsed.select("split", "stem").distinct(), ["split", "stem"], "left_semi").count()
    return {"images": per(images), "labels": per(label_files), "labelled": labelled, "unlabelled": records.count() - labelled, **lines}


def inspect_export(spark: SparkSession, folder: str, classes: dict[int, str] | None = None) -> Report:
    """Check an export of train, valid and test; good lines of a bad file are kept and every bad line is reported.

    An image whose name holds no frame and time is an error and has no record, and its label isn't looked at.
    """
    images, label_files, lines = read_dataset(spark, {s: (_child(folder, s, "images"), _child(folder, s, "labels")) for s in EXPORT_SPLITS})
    named = images.withColumn("frame_index", temporal.name_frame(F.col("name"))).withColumn("timestamp_seconds", temporal.name_timestamp(F.col("name")))
    known = named.where(F.col("frame_index").isNotNull())
    records = known.where(F.col("image_w").isNotNull()).join(label_files, ["split", "stem"], "left_semi")
    own = lines.join(records, ["split", "stem"], "left_semi")
    parsed = materialize(labels.parse_labels(own, image_w="image_w", image_h="image_h"), "parsed")
    none = F.lit(None).cast("int").alias("line_no")
    bad_name = named.where(F.col("frame_index").isNull()).select("split", "stem", none, F.lit("Name holds no frame and time").alias("error"))
    # A label of an image without a readable name isn't an orphan.
    unnamed = named.where(F.col("frame_index").isNull()).select("split", "stem")
    looked = label_files.join(unnamed, ["split", "stem"], "left_anti")
    errors = materialize(dataset_errors(known, looked, parsed, every_line=True).unionByName(bad_name), "errors")
    problems = [f"{_child(folder, s, kind)} is missing" for s in EXPORT_SPLITS for kind in ("images", "labels") if not files.exists(spark, _child(folder, s, kind))]
    if classes is not None and {k: v.strip().lower() for k, v in classes.items()} != {0: "ant"}:
        problems.append("data.yaml must name exactly one class, 0 = ant")
    counts = {**export_counts(images, label_files, records, parsed), "errors": errors.count()}
    return Report(counts, problems, {"records": records, "boxes": parsed.where(F.col("error").isNull()), "errors": errors})


def prepare_export(spark: SparkSession, folder: str, train_fraction: float, gap: int, allow_test: bool = False, classes: dict[int, str] | None = None, output: str | None = None, overwrite: bool = False) -> Report:
    """Split the eligible records of an export by time and give their label texts: tables ``split`` and ``labels``.

    Test records stay out unless asked for; they are filtered before any ranking. Any error of any split is fatal.
    With ``output`` images are copied there, label files and the dataset file written, and the counts as JSON;
    earlier results there are refused unless ``overwrite``.
    """
    found = inspect_export(spark, folder, classes)
    if not found.ok:
        raise ReportError(found)
    records = temporal.eligible(found.tables["records"], "split", allow_test)
    if records.limit(2).count() < 2:
        raise ValueError("an export needs at least two eligible images")
    split = materialize(temporal.temporal_split(records, [], ["timestamp_seconds", "frame_index", "name"], train_fraction, gap), "split")
    lines = found.tables["boxes"].withColumn("text_line", labels.format_label(F.col("class_id"), {c: F.col(c) for c in labels.FIELDS}))
    kept = split.where(F.col("part") != "gap").select("split", "stem", "part")
    boxes = lines.join(kept, ["split", "stem"])
    keyed = lambda df: df.withColumn("key", F.concat_ws("/", "split", "stem"))
    texts = files.label_texts(keyed(kept), keyed(boxes), "key", "text_line", ["line_no"])
    counts = {**found.counts, "parts": {r.part: r.asDict() for r in temporal.part_ranges(split, [], "frame_index", "timestamp_seconds").collect()}}
    if output is not None:
        root = Path(output)
        problems = path_errors([Path(folder)], [root], [Path(folder)])
        if problems:
            raise ValueError("; ".join(problems))
        for part in ("train", "val"):
            files.claim_output(root / "images" / part, tuple(f"*.{s}" for s in files.IMAGE_SUFFIXES), overwrite)
            files.claim_output(root / "labels" / part, ("*.txt",), overwrite)
            own = split.where(F.col("part") == part)
            files.copy_files(own.select("file", F.concat(F.lit(f"{root.resolve()}/images/{part}/"), "name").alias("target")), "file", "target").count()
            named = texts.join(keyed(own).select("key", "stem"), "key")
            body = F.when(F.col("text") == "", "").otherwise(F.concat("text", F.lit("\n")))
            files.write_text_files(named.select(F.concat("stem", F.lit(".txt")).alias("name"), body.alias("text")), f"{root.resolve()}/labels/{part}", "name", "text").count()
        (root / "dataset.yaml").write_text(files.dataset_yaml(), encoding="utf-8")
        files.write_report(root / "split_report.json", counts)
    return Report(counts, [], {"split": split, "labels": texts})


def sequence_images(images: DataFrame, info: files.SequenceInfo) -> tuple[DataFrame, DataFrame]:
    """(frames with an image (frame, file), failing (check, name, frame)) of listed images: exactly those named by the
    frames 1 to N may stand there, and all of them must."""
    spark = images.sparkSession
    expected = spark.range(1, info.frames + 1).select(F.col("id").alias("frame"), temporal.sequence_name(F.col("id"), info.extension).alias("name"))
    found = expected.join(images.select("name", "file"), "name")
    missing = expected.join(images, "name", "left_anti").select(F.lit("missing images").alias("check"), "name", "frame")
    extra = images.join(expected, "name", "left_anti").select(F.lit("extra images").alias("check"), "name", F.lit(None).cast("bigint").alias("frame"))
    return found.select("frame", "file"), missing.unionByName(extra)


def revalidate_labels(images: DataFrame, label_lines: DataFrame, label_files: DataFrame) -> DataFrame:
    """One row of what is wrong with written labels: images without a label, labels without an image, and lines by kind of
    error (invalid_class_ids, out_of_range, zero_or_negative, other). ``images`` and ``label_files`` have ``stem``."""
    stems = images.select("stem").distinct().withColumn("i", F.lit(True)).join(label_files.select("stem").distinct().withColumn("l", F.lit(True)), "stem", "full_outer")
    sides = stems.agg(F.count_if(F.col("l").isNull()).alias("missing_labels"), F.count_if(F.col("i").isNull()).alias("extra_labels"))
    error = labels.all_errors(labels.parse_labels(label_lines, polygons=False))
    kinds = {
        "invalid_class_ids": F.contains("error", F.lit("class id")),
        "out_of_range": F.contains("error", F.lit(labels.NORMALIZED)) | F.contains("error", F.lit(labels.OUTSIDE)),
        "zero_or_negative": F.contains("error", F.lit(labels.NO_SIZE)),
    }
    other = ~reduce(lambda a, b: a | b, kinds.values())
    counted = error.agg(*[F.count_if(k).alias(n) for n, k in kinds.items()], F.count_if(other).alias("other"))
    row = {**sides.first().asDict(), **counted.first().asDict()}
    return images.sparkSession.createDataFrame([row], ", ".join(f"{n} bigint" for n in row))


def convert_sequence(spark: SparkSession, gt_path: str, info: files.SequenceInfo, image_frames: DataFrame, output: str | None = None, overwrite: bool = False) -> Report:
    """Tracking ground truth to label texts and tracking rows; ``image_frames`` has a row (frame) per image.

    Tables: ``labels`` (frame, text; an image without rows has an empty text), ``tracking`` and ``errors`` (check, file,
    line_no, frame, track_id, error). Bad lines, repeated ids of a frame, boxes outside the image, frames of rows
    without an image, missing and extra images are counted and reported. With ``output`` label files, tracking rows
    and the counts are written there, if nothing failed, and the labels read and checked again.
    """
    lines = files.read_line_files(spark, gt_path, "*")
    parsed = materialize(tracking.parse_ground_truth(lines), "parsed")
    rows = parsed.where(F.col("error").isNull()).withColumn("sequence", F.lit(info.name))
    boxes = tracking.to_normalized(rows, F.lit(info.width), F.lit(info.height))
    expected = spark.range(1, info.frames + 1).select(F.col("id").alias("frame"))
    own = rows.select("frame").distinct()
    failing = {
        "bad lines": parsed.where(F.col("error").isNotNull()).select("file", "line_no", "error"),
        "repeated track ids": tracking.duplicate_tracks(rows, "sequence").select("frame", "track_id", F.format_string("%d rows", "copies").alias("error")),
        "boxes outside the image": boxes.where(F.col("error").isNotNull()).select("file", "line_no", "frame", "track_id", "error"),
        "rows without an image": own.join(image_frames, "frame", "left_anti"),
        "missing images": expected.join(image_frames, "frame", "left_anti"),
        "extra images": image_frames.join(expected, "frame", "left_anti").select("frame"),
    }
    columns = {"file": "string", "line_no": "int", "frame": "bigint", "track_id": "bigint", "error": "string"}
    shaped = lambda what, df: df.select(F.lit(what).alias("check"), *[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()])
    errors = materialize(reduce(DataFrame.unionByName, [shaped(what, df) for what, df in failing.items()]), "errors")
    counted = {r.check: r.n for r in errors.groupBy("check").agg(F.count("*").alias("n")).collect()}
    checks = {what: counted.get(what, 0) for what in failing}
    good = boxes.where(F.col("error").isNull()).withColumn("text_line", labels.format_label(F.lit(0), {c: F.col(f"norm_{c}") for c in labels.FIELDS}))
    texts = files.label_texts(image_frames, good, "frame", "text_line", ["line_no"])
    track = rows.select("sequence", "frame", temporal.sequence_name(F.col("frame"), info.extension).alias("image"), F.col("track_id").alias("trackId"), F.struct("x", "y", "width", "height").alias("bbox"), "flag")
    summary = tracking.sequence_summary(rows, "sequence").first()
    counts = {**(summary.asDict() if summary else {}), **checks, "images_without_gt": image_frames.join(rows, "frame", "left_anti").count(), "errors": sum(checks.values())}
    report = Report(counts, [], {"labels": texts, "tracking": track, "errors": errors})
    if output is None:
        return report
    if not report.ok:
        raise ReportError(report)
    folder = Path(output) / "labels"
    files.claim_output(folder, ("*.txt",), overwrite)
    stem = F.regexp_replace(temporal.sequence_name(F.col("frame"), info.extension), r"\.[^.]*$", "")
    body = F.when(F.col("text") == "", "").otherwise(F.concat("text", F.lit("\n")))
    files.write_text_files(texts.select(F.concat(stem, F.lit(".txt")).alias("name"), body.alias("text")), str(folder.resolve()), "name", "text").count()
    track.write.mode("overwrite" if overwrite else "errorifexists").json(str(Path(output).resolve() / "tracking"))
    again = revalidate_labels(image_frames.select(stem.alias("stem")), files.read_line_files(spark, str(folder.resolve())), files.list_files(spark, str(folder.resolve()), ("txt",))).first().asDict()
    counts = {**counts, "revalidation": again}
    files.write_report(Path(output) / "conversion_report.json", counts)
    return Report(counts, [f"{n} {what}" for what, n in again.items() if n], report.tables)


def evaluate_benchmark(images: DataFrame, truth: DataFrame, predictions: DataFrame, sequence: str = "sequence", image: str = "image", baseline: DataFrame | None = None) -> dict[str, DataFrame]:
    """Evaluation of predictions on sequences of images: frames, totals, density groups, examples and, with a
    ``baseline`` (sequence, metrics), the totals beside it."""
    keys = [sequence, image]
    frames = evaluation.frame_evaluation(images, truth, predictions, keys, 0.5)
    totals = evaluation.totals(frames, [sequence])
    return {
        "frames": frames,
        "totals": totals,
        "density": evaluation.density_analysis(frames, [sequence], image),
        "examples": evaluation.example_frames(frames, [sequence], image),
        "comparison": totals if baseline is None else totals.join(baseline, sequence, "left"),
    }


def validate_test_sets(spark: SparkSession, root: str) -> Report:
    """Check the test videos of a folder (each with images and labels); all errors are collected, then fatal.

    The table ``sets`` has (name, images, annotations, images_without) of each video.
    """
    found = files.discover_test_sets(Path(root))
    problems = [f"{p.name} has no labels folder" for p in found if not (p / "labels").is_dir()]
    report = validate_folders(spark, {p.name: (str(p / "images"), str(p / "labels")) for p in found})
    report = Report(report.counts, [*problems, *report.problems], report.tables)
    if not report.ok:
        raise ReportError(report)
    sets = [(name, c["images"], c["annotations"], c["images_without"]) for name, c in sorted(report.counts["splits"].items())]
    table = spark.createDataFrame(sets, "name string, images bigint, annotations bigint, images_without bigint")
    return Report(report.counts, [], {**report.tables, "sets": table})


def evaluate_external(spark: SparkSession, root: str, metrics: DataFrame, output: str | None = None, measures: tuple[str, ...] = ("precision", "recall", "map50", "map")) -> Report:
    """Detector metrics (name and ``measures``) of the test videos of a folder: tables ``videos`` and ``macro``.

    The folder is validated first and any error is fatal. A video without metrics, and null metrics, count as 0 in
    the macro average. With ``output``, which must lie outside the folder, a dataset file per video and the report are
    written.
    """
    if output is not None and (problems := path_errors([], [Path(output)], [Path(root)])):
        raise ValueError("; ".join(problems))
    report = validate_test_sets(spark, root)
    videos = report.tables["sets"].join(metrics.select("name", *measures), "name", "left").fillna(0.0, subset=list(measures))
    macro = evaluation.macro_average(videos, list(measures))
    counts = {"videos": [r.asDict() for r in videos.orderBy("name").collect()], "macro": macro.first().asDict()}
    if output is not None:
        for p in files.discover_test_sets(Path(root)):
            own = Path(output) / "datasets" / f"{p.name}.yaml"
            own.parent.mkdir(parents=True, exist_ok=True)
            own.write_text(files.dataset_yaml("images", "images", str(p.resolve())), encoding="utf-8")
        files.write_report(Path(output) / "evaluation.json", counts)
    return Report(counts, [], {**report.tables, "videos": videos, "macro": macro})


def roi_from_text(text):
    """Region of interest ``x,y,width,height`` as a struct with its error."""
    from trailmark.functions.geometry import roi_error

    parts = F.split(text, ",")
    value = [F.get(parts, F.lit(i)) for i in range(4)]
    number = [F.trim(v).try_cast("int") for v in value]
    error = F.coalesce(first_error((F.size(parts) != 4, "roi must be four integers")), roi_error(*number))
    return F.struct(*[n.alias(c) for n, c in zip(number, ("x", "y", "width", "height"))], error.alias("error"))
