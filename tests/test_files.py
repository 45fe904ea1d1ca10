import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from trailmark.plans import pipelines, provenance
from trailmark.sources import files
from trailmark.sources.inference import parameter_errors


def png(width=32, height=32):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\x00" + b"\x00" * width for _ in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.fixture
def dataset(tmp_path):
    rows = {"train": {"one": "0 0.5 0.5 0.25 0.25\n", "two": ""}, "val": {"three": "0 0.4 0.4 0.2 0.1\n"}}
    for split, labels in rows.items():
        (tmp_path / "images" / split).mkdir(parents=True)
        (tmp_path / "labels" / split).mkdir(parents=True)
        for name, text in labels.items():
            (tmp_path / "images" / split / f"{name}.png").write_bytes(png())
            (tmp_path / "labels" / split / f"{name}.txt").write_text(text)
    (tmp_path / "dataset.yaml").write_text("path: . # root\ntrain: images/train\nval: images/val\nnames:\n  0: ant\n")
    return tmp_path


def test_dataset_statistics(spark, dataset):
    got = pipelines.dataset_statistics(spark, str(dataset / "dataset.yaml")).counts
    assert got["splits"]["train"]["images"] == 2 and got["splits"]["train"]["images_without"] == 1 and got["splits"]["val"]["annotations"] == 1
    assert round(got["median_area"], 6) == 0.04125 and round(got["p75_area"], 6) == 0.051875


def test_missing_and_orphan_and_bad(spark, dataset):
    (dataset / "labels/train/one.txt").unlink()
    (dataset / "labels/val/other.txt").write_text("0 .5 .5 .1 .1\n")
    (dataset / "labels/val/three.txt").write_text("0 .5 .5 .1 .1\n7 .5 .5 .1 .1\nx\n")
    report = pipelines.validate_dataset(spark, str(dataset / "dataset.yaml"))
    text = "\n".join(report.messages())
    assert "train/one Missing label" in text and "val/other Label without image" in text and "val/three/2 class id" in text and "three/3" not in text
    with pytest.raises(ValueError):
        pipelines.dataset_statistics(spark, str(dataset / "dataset.yaml"))


def test_export(spark, tmp_path):
    rows = {"train": [(0, "0000-000"), (10, "0000-400"), (20, "0000-800")], "valid": [(30, "0001-200"), (40, "0001-600")], "test": [(50, "0002-000")]}
    for split, frames in rows.items():
        (tmp_path / split / "images").mkdir(parents=True)
        (tmp_path / split / "labels").mkdir(parents=True)
        for frame, ts in frames:
            stem = f"nest_frame_{frame:06d}_t{ts}_jpg.rf.x{frame:06d}"
            (tmp_path / split / "images" / f"{stem}.png").write_bytes(png())
            (tmp_path / split / "labels" / f"{stem}.txt").write_text("0 0.50 0.50 0.250 0.250\n")
    seen = pipelines.inspect_export(spark, str(tmp_path), {0: "Ant"})
    assert seen.ok and seen.counts["images"] == {"train": 3, "valid": 2, "test": 1} and seen.counts["detections"] == 6 and seen.counts["class_ids"] == [0]
    got = pipelines.prepare_export(spark, str(tmp_path), 0.67, 1, classes={0: "Ant"})
    parts = got.counts["parts"]
    assert (parts["train"]["rows"], parts["train"]["last_frame"], parts["gap"]["rows"], parts["val"]["rows"], parts["val"]["first_frame"]) == (3, 20, 1, 1, 40)
    texts = got.tables["labels"].collect()
    assert len(texts) == 4 and {r.text for r in texts} == {"0 0.5 0.5 0.25 0.25"}
    out = tmp_path.parent / f"{tmp_path.name}-out"
    pipelines.prepare_export(spark, str(tmp_path), 0.67, 1, classes={0: "Ant"}, output=str(out))
    assert len(list((out / "images" / "train").iterdir())) == len(list((out / "labels" / "train").iterdir())) == 3
    assert {p.read_text() for p in (out / "labels" / "val").iterdir()} == {"0 0.5 0.5 0.25 0.25\n"} and (out / "split_report.json").read_text().endswith("}\n")
    assert pipelines.validate_dataset(spark, str(out / "dataset.yaml")).ok
    with pytest.raises(FileExistsError):
        pipelines.prepare_export(spark, str(tmp_path), 0.67, 1, output=str(out))
    with pytest.raises(ValueError):
        pipelines.prepare_export(spark, str(tmp_path), 0.67, 1, output=str(tmp_path / "train"))


def test_sequence(spark, tmp_path):
    (tmp_path / "gt.txt").write_text("1,7,100,50,200,100,1\n\n2,7,100,50,200,100,1\n2,7,1,1,2,2,1\nbad\n9,1,1,1,2,2,1\n2,3,990,50,200,100,1\n")
    info = files.read_sequence_info("[Sequence]\nname=S\nframeRate=30\nseqLength=3\nimWidth=1000\nimHeight=500\n")
    frames = spark.range(1, 4).select(F.col("id").alias("frame"))
    got = pipelines.convert_sequence(spark, str(tmp_path), info, frames)
    assert got.counts["bad lines"] == 1 and got.counts["repeated track ids"] == 1 and got.counts["boxes outside the image"] == 1 and got.counts["rows without an image"] == 1
    texts = {r.frame: r.text for r in got.tables["labels"].collect()}
    assert texts[1] == "0 0.2 0.2 0.2 0.2" and texts[3] == "" and len(texts) == 3


def test_all_errors_are_kept(spark, dataset, tmp_path):
    bad = "".join("x\n" for _ in range(1200))
    for split in pipelines.EXPORT_SPLITS:
        (tmp_path / "export" / split / "images").mkdir(parents=True)
        (tmp_path / "export" / split / "labels").mkdir(parents=True)
        (tmp_path / "export" / split / "labels" / f"{split}.txt").write_text(bad if split == "test" else "x\n")
    found = pipelines.inspect_export(spark, str(tmp_path / "export"))
    # Labels without an image are orphans; their lines aren't looked at.
    assert sorted((r.split, r.stem) for r in found.tables["errors"].collect()) == sorted((s, s) for s in pipelines.EXPORT_SPLITS)
    for split in pipelines.EXPORT_SPLITS:
        (tmp_path / "export" / split / "images" / f"{split}.png").write_bytes(png())
    names = {s: f"a_frame_000001_t000.{i}00" for i, s in enumerate(pipelines.EXPORT_SPLITS)}
    for split, stem in names.items():
        (tmp_path / "export" / split / "images" / f"{stem}.png").write_bytes(png())
        ids = "".join(f"{i} 0.5 0.5 0.1 0.1\n" for i in range(150))
        (tmp_path / "export" / split / "labels" / f"{stem}.txt").write_text((bad if split == "test" else "x\n") + (ids if split == "valid" else ""))
    found = pipelines.inspect_export(spark, str(tmp_path / "export"))
    rows = [(r.split, r.stem, r.line_no or 0) for r in found.tables["errors"].collect()]
    every = [(s, names[s], i) for s in pipelines.EXPORT_SPLITS for i in range(1, 1201 if s == "test" else 2)]
    every += [("valid", names["valid"], i) for i in range(3, 152)] + [(s, s, 0) for s in pipelines.EXPORT_SPLITS]
    assert sorted(rows) == sorted(every) and len(list(found.messages())) == len(every) == found.counts["errors"]
    assert found.counts["class_ids"] == list(range(150)) and found.counts["labelled"] == 3 and found.counts["unlabelled"] == 0
    assert found.counts["labels"] == {s: 2 for s in pipelines.EXPORT_SPLITS} and found.counts["invalid_lines"] == 1200 + 1 + 150
    with pytest.raises(pipelines.ReportError) as fatal:
        pipelines.prepare_export(spark, str(tmp_path / "export"), 0.67, 1)
    assert fatal.value.report.tables["errors"].where("split = 'valid'").count() == 151

    for i in range(1100):
        (dataset / f"labels/train/orphan_{i:04d}.txt").write_text("")
    (dataset / "labels/val/three.txt").write_text("x\ny\n")
    errors = pipelines.validate_dataset(spark, str(dataset / "dataset.yaml")).tables["errors"]
    assert errors.where("split = 'train'").count() == 1100 and [(r.stem, r.line_no) for r in errors.where("split = 'val'").collect()] == [("three", 1)]


def test_sequence_errors_are_listed(spark, tmp_path):
    (tmp_path / "gt.txt").write_text("1,7,100,50,200,100,1\nbad\n2,7,1,1,2,2,1\n2,7,1,1,2,2,1\n9,1,1,1,2,2,1\n2,3,990,50,200,100,1\n")
    info = files.read_sequence_info("[Sequence]\nname=S\nframeRate=30\nseqLength=3\nimWidth=1000\nimHeight=500\n")
    got = pipelines.convert_sequence(spark, str(tmp_path), info, spark.range(2, 5).select(F.col("id").alias("frame")))
    rows = sorted((r.check, r.line_no or 0, r.frame or 0, r.track_id or 0) for r in got.tables["errors"].collect())
    assert rows == [
        ("bad lines", 2, 0, 0), ("boxes outside the image", 6, 2, 3), ("extra images", 0, 4, 0), ("missing images", 0, 1, 0),
        ("repeated track ids", 0, 2, 7), ("rows without an image", 0, 1, 0), ("rows without an image", 0, 9, 0),
    ]


def test_yaml_paths_and_classes(tmp_path):
    assert files.parse_dataset_yaml("path: 'a'\ntrain: images/t\nnames:\n  0: ant\n")["names"] == {0: "ant"}
    with pytest.raises(ValueError):
        files.parse_dataset_yaml("nonsense")
    assert files.class_names("['Ant']") == {0: "Ant"} and files.class_names({0: "ant"}) == {0: "ant"}
    got = files.resolve_splits(tmp_path / "d.yaml", {"train": "images/x/images/train", "val": "Images/v"})
    assert got["train"].labels == tmp_path / "images/x/labels/train" and got["val"].labels == tmp_path / "labels/v"
    with pytest.raises(ValueError):
        files.resolve_splits(tmp_path / "d.yaml", {"train": "pictures/x", "val": "images/v"})


def test_headers_and_guards(tmp_path):
    assert files.header_size(png(7, 9)) == (7, 9) and files.header_size(b"junk") is None
    assert parameter_errors(0.25, 0.7, 640) == [] and len(parameter_errors(True, float("nan"), 0)) == 3
    a, b = tmp_path / "a", tmp_path / "frozen" / "b"
    assert provenance.path_errors([a], [a, b, b], [tmp_path / "frozen"]).__len__() == 4
    assert provenance.class_errors({0: " Ant"}, {0: "ant"}) == [] and provenance.class_errors({1: "ant"}, {0: "ant"})


def test_run_documents(spark):
    runs = spark.sql("select 'v' source_path, 'aa' source_sha256, 'm' model_path, 'AB' model_sha256, map('0', 'ant') classes, named_struct('processedFrames', 3) result, timestamp'2026-01-02 03:04:05' created_at, 0.25D confidence, 0.5D iou, 640 imageSize, false end2end")
    registry = spark.createDataFrame([("ab", "e", "s")], "sha256 string, experiment string, status string")
    canonical = spark.sql("select 0.25D confidence, 0.7D iou, 640 imageSize, false end2end")
    doc = json.loads(provenance.run_documents(runs, registry, canonical).first().document)
    assert doc["model"]["experiment"] == "e" and doc["inference"]["overrides"] == {"iou": {"canonical": 0.7, "actual": 0.5}} and doc["inference"]["canonicalInference"] is False
    assert doc["schemaVersion"] == 1 and doc["createdAtUtc"] == "2026-01-02T03:04:05.000000Z" and doc["classes"] == {"0": "ant"} and doc["environment"]["python"]
    doc = json.loads(provenance.run_documents(runs.withColumn("iou", F.lit(0.7)), registry.limit(0), canonical).first().document)
    assert doc["inference"]["overrides"] == {} and doc["inference"]["canonicalInference"] and doc["model"]["status"] == "CUSTOM / UNREGISTERED"


def test_external_sets(spark, tmp_path):
    for video in ("b", "a"):
        for kind in ("images", "labels"):
            (tmp_path / "sets" / video / kind).mkdir(parents=True)
        (tmp_path / "sets" / video / "images" / "f.png").write_bytes(png())
        (tmp_path / "sets" / video / "labels" / "f.txt").write_text("0 .5 .5 .1 .1\n" if video == "a" else "")
    metrics = spark.createDataFrame([("a", 0.5, 1.0, 0.4, None)], "name string, precision double, recall double, map50 double, map double")
    got = pipelines.evaluate_external(spark, str(tmp_path / "sets"), metrics, str(tmp_path / "out"))
    assert [(v["name"], v["annotations"], v["images_without"], v["precision"]) for v in got.counts["videos"]] == [("a", 1, 0, 0.5), ("b", 0, 1, 0.0)]
    assert got.counts["macro"]["macro_precision"] == 0.25 and json.loads((tmp_path / "out" / "evaluation.json").read_text())["macro"]["sources"] == 2
    assert files.parse_dataset_yaml((tmp_path / "out/datasets/a.yaml").read_text())["val"] == "images"
    with pytest.raises(ValueError):
        pipelines.evaluate_external(spark, str(tmp_path / "sets"), metrics, str(tmp_path / "sets" / "out"))
    (tmp_path / "sets/a/labels/x.txt").write_text("")
    (tmp_path / "sets/b/images/bad.png").write_bytes(b"no")
    with pytest.raises(pipelines.ReportError) as fatal:
        pipelines.evaluate_external(spark, str(tmp_path / "sets"), metrics)
    assert {r.stem for r in fatal.value.report.tables["errors"].collect()} == {"x", "bad"}


def test_sequence_output(spark, tmp_path):
    (tmp_path / "gt").mkdir()
    (tmp_path / "gt" / "gt.txt").write_text("1,7,100,50,200,100,1\n2,7,100,50,200,100,1\n")
    (tmp_path / "img").mkdir()
    for name in ("000001.png", "000002.png", "000004.png", "x.png"):
        (tmp_path / "img" / name).write_bytes(png())
    info = files.read_sequence_info("[Sequence]\nname=S\nframeRate=30\nseqLength=3\nimWidth=1000\nimHeight=500\nimExt=.png\n")
    frames, failing = pipelines.sequence_images(files.list_images(spark, str(tmp_path / "img")), info)
    assert sorted(r.frame for r in frames.collect()) == [1, 2]
    assert {(r.check, r.name) for r in failing.collect()} == {("missing images", "000003.png"), ("extra images", "000004.png"), ("extra images", "x.png")}
    every = spark.range(1, 4).select(F.col("id").alias("frame"))
    got = pipelines.convert_sequence(spark, str(tmp_path / "gt"), info, every, str(tmp_path / "out"))
    assert got.ok and (tmp_path / "out/labels/000003.txt").read_text() == "" and (tmp_path / "out/labels/000001.txt").read_text() == "0 0.2 0.2 0.2 0.2\n"
    assert set(got.counts["revalidation"].values()) == {0} and json.loads((tmp_path / "out/conversion_report.json").read_text())["annotations"] == 2
    (tmp_path / "out/labels/000001.txt").write_text("1 .5 .5 .1 .1\n0 .9 .5 .3 .1\n0 .5 .5 0 .1\nx\n")
    (tmp_path / "out/labels/more.txt").write_text("")
    stems = every.select(F.format_string("%06d", "frame").alias("stem"))
    again = pipelines.revalidate_labels(stems, files.read_line_files(spark, str(tmp_path / "out/labels")), files.list_files(spark, str(tmp_path / "out/labels"), ("txt",))).first().asDict()
    assert again == {"missing_labels": 0, "extra_labels": 1, "invalid_class_ids": 1, "out_of_range": 1, "zero_or_negative": 1, "other": 1}


def test_roi(spark):
    texts = ["10,20,300,400", "10,20,30", "1,2,3,4,5", "10,a,30,40", "-1,0,10,10", "0,0,0,10"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(pipelines.roi_from_text(F.col("t")).alias("r")).collect()
    assert [r.r.error is None for r in rows] == [True] + [False] * 5 and tuple(rows[0].r)[:4] == (10, 20, 300, 400)


def test_detections_and_manifest(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text('{"frameIndex":0,"timestampSeconds":0.0,"detections":[]}\n{"frameIndex":1,"timestampSeconds":0.1,"detections":[{"classId":0,"className":"ant","confidence":0.9,"bbox":{"x":1,"y":2,"width":4,"height":5}}]}\n')
    from trailmark.streaming.motion import detection_totals

    got = detection_totals(files.read_detections(spark, str(tmp_path / "d.jsonl"))).first()
    assert (got.processed_frames, got.total_detections) == (2, 1)
    (tmp_path / "m.csv").write_text('name,tags,ok,box\na,x;y,True,"{""w"": 2}"\n')
    row = files.read_manifest(spark, str(tmp_path / "m.csv"), lists=("tags",), flags=("ok",), nested={"box": "struct<w: int>"}).first()
    assert row.tags == ["x", "y"] and row.ok is True and row.box.w == 2


def test_discovery_outputs_and_hashes(spark, tmp_path):
    for name in ("b", "a"):
        (tmp_path / name / "images").mkdir(parents=True)
    assert [p.name for p in files.discover_test_sets(tmp_path)] == ["a", "b"]
    (tmp_path / "images").mkdir()
    assert files.discover_test_sets(tmp_path) == [tmp_path]
    with pytest.raises(ValueError):
        files.discover_test_sets(tmp_path / "images")
    out = tmp_path / "out"
    files.claim_output(out, ("*.jpg",), False)
    (out / "x.jpg").write_bytes(b"1")
    (out / "keep.txt").write_bytes(b"2")
    with pytest.raises(FileExistsError):
        files.claim_output(out, ("*.jpg",), False)
    files.claim_output(out, ("*.jpg",), True)
    assert [p.name for p in out.iterdir()] == ["keep.txt"]
    hashes = files.file_hashes(spark, str(out))
    sha = provenance.file_sha256(out / "keep.txt")
    manifest = spark.createDataFrame([("keep.txt", sha.upper()), ("gone.txt", "00")], "name string, sha256 string")
    assert {r.name: r.matches for r in files.verify_manifest(manifest, hashes).collect()} == {"keep.txt": True, "gone.txt": False}


def test_commands(spark, dataset, tmp_path, capsys):
    from trailmark.__main__ import main

    assert main(["validate", str(dataset / "dataset.yaml")], spark) == 0 and main(["stats", str(dataset / "dataset.yaml")], spark) == 0
    assert json.loads(capsys.readouterr().out.split("\n}\n{")[0] + "\n}")["errors"] == 0
    (dataset / "labels/train/one.txt").write_text("7 .5 .5 .1 .1\n")
    assert main(["validate", str(dataset / "dataset.yaml")], spark) == 1 and main(["stats", str(dataset / "dataset.yaml")], spark) == 1
    assert "class id must be 0" in capsys.readouterr().err
    assert main(["validate", str(tmp_path / "none.yaml")], spark) == 1
    video = tmp_path / "v.y4m"
    video.write_bytes(b"YUV4MPEG2 W8 H6 F10:1 Cmono\n" + b"".join(b"FRAME\n" + bytes([i]) * 48 for i in range(20)))
    assert main(["analyze", str(video), "--output", str(tmp_path / "a"), "--warmup", "5"], spark) == 0
    assert json.loads((tmp_path / "a/metrics.json").read_text())["warmup_frames"] == 5
    assert main(["extract-frames", str(video), "--output", str(tmp_path / "e"), "--every", "7"], spark) == 0
    assert len(list((tmp_path / "e").glob("*.png"))) == 3
    assert main(["extract-frames", str(video), "--output", str(tmp_path / "e"), "--every", "7"], spark) == 1
    assert main(["analyze", str(video), "--output", str(tmp_path / "a"), "--roi", "0,0,9,9"], spark) == 1
