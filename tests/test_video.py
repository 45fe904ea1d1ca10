import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.operators import pixels
from trailmark.plans import video
from trailmark.sources import frames as source
from trailmark.sources.files import header_size
from trailmark.streaming.motion import detection_totals


def clip(n=40, h=40, w=60):
    """A bright square that moves over a still ground from frame 20 on."""
    rng = np.random.default_rng(1)
    ground = rng.integers(60, 70, (h, w), dtype=np.uint8)
    out = []
    for i in range(n):
        image = ground.copy()
        if i >= 20:
            image[10:20, i : i + 10] = 250
        out.append(image)
    return out


def table(spark, images, name="v.y4m"):
    rows = [(name, i, *x.shape, bytearray(x.tobytes())) for i, x in enumerate(images)]
    return spark.createDataFrame(rows, "stream string, frame_index bigint, height int, width int, pixels binary")


def test_blur_and_morphology():
    image = np.zeros((7, 7), np.uint8)
    image[3, 3] = 255
    got = pixels.blur(image)
    assert got[3, 3] == (36 * 255 + 128) >> 8 and got[1, 1] == (255 + 128) >> 8 and got[0, 0] == 0
    assert (pixels.blur(np.full((5, 9), 77, np.uint8)) == 77).all()
    mask = np.zeros((9, 9), bool)
    mask[2:7, 2:7] = True
    mask[0, 0] = True
    opened = pixels.dilate(pixels.erode(mask, pixels.CROSS), pixels.CROSS)
    assert not opened[0, 0] and opened[4, 2:7].all() and not opened[2, 2]
    mask[4, 4] = False
    assert pixels.erode(pixels.dilate(mask, pixels.DISK), pixels.DISK)[4, 4]


def test_components_and_outlines():
    rng = np.random.default_rng(2)
    for _ in range(30):
        mask = rng.random((12, 15)) < 0.45
        for diagonal in (True, False):
            got, n = pixels.components(mask, diagonal)
            assert (got > 0).tolist() == mask.tolist()
            near = [(0, 1), (1, 0)] + [(1, 1), (1, -1)] * diagonal
            for y, x in np.argwhere(mask):
                for dy, dx in near:
                    if 0 <= y + dy < 12 and 0 <= x + dx < 15 and mask[y + dy, x + dx]:
                        assert got[y, x] == got[y + dy, x + dx]
            seen = 0
            left = mask.copy()
            while left.any():
                stack = [tuple(np.argwhere(left)[0])]
                seen += 1
                while stack:
                    y, x = stack.pop()
                    if 0 <= y < 12 and 0 <= x < 15 and left[y, x]:
                        left[y, x] = False
                        stack += [(y + a * s, x + b * s) for a, b in near for s in (1, -1)]
            assert n == seen
    box = np.ones((4, 6), bool)
    assert pixels.outline_area(box) == 15.0 and pixels.outline_area(np.ones((1, 5), bool)) == 0.0 and pixels.outline_area(np.ones((1, 1), bool)) == 0.0
    diamond = np.array([[0, 1, 0], [1, 1, 1], [0, 1, 0]], bool)
    assert pixels.outline_area(diamond) == 2.0
    ring = np.ones((5, 5), bool)
    ring[1:4, 1:4] = False
    ring[2, 2] = True
    mask, found = pixels.moving_regions(ring, 1)
    assert found == [(0, 0, 5, 5, 16.0)] and mask.all()
    assert pixels.moving_regions(np.zeros((3, 3), bool), 0)[1] == []


def test_analyze(spark):
    images = clip()
    report = video.analyze(table(spark, images), 10.0, roi=(5, 5, 50, 30), warmup=15, min_area=20, total_frames=40)
    rows = {r.frame_index: r for r in report.tables["frames"].collect()}
    assert not rows[3].scored and rows[3].score == 0 and all(rows[i].regions == 0 for i in range(15, 20))
    for i in range(22, 40):
        box = max(rows[i].boxes, key=lambda b: b.area)
        assert rows[i].regions >= 1 and abs(box.y - 10) <= 2 and abs(box.x + box.width - (i + 10)) <= 2
    summary = report.tables["summary"].first()
    assert (summary.processed_frames, summary.warmup_frames, summary.scored_frames, summary.duration_seconds) == (40, 15, 25, 4.0)
    heat = report.tables["heatmap"]
    assert heat.agg(F.max("level")).first()[0] == 255 and heat.where("x < 5 or y < 5 or x >= 55 or y >= 35").count() == 0
    for roi in ((0, 0, 61, 40), (-1, 0, 5, 5), (0, 0, 0, 5)):
        with pytest.raises(ValueError):
            video.analyze(table(spark, images), 10.0, roi=roi)
    with pytest.raises(ValueError):
        video.analyze(table(spark, images).limit(0), 10.0)


def test_still_and_new_background():
    model = pixels.Mixture()
    still = np.full((4, 4), 100, np.uint8)
    assert model.detect(still).all()  # nothing is known yet
    assert not any(model.detect(still).any() for _ in range(30))
    bright = np.full((4, 4), 200, np.uint8)
    masks = [model.detect(bright).all() for _ in range(200)]
    assert masks[0] and not masks[-1]  # becomes background after a while
    assert not model.detect(still).any()  # and the old one is still known


def test_y4m_extract_and_detect(spark, tmp_path):
    images = clip(12, 6, 9)
    path = tmp_path / "a.y4m"
    chroma = b"\x80" * (2 * 5 * 3)
    data = b"YUV4MPEG2 W9 H6 F25:1 Ip C420jpeg\n" + b"".join(b"FRAME\n" + x.tobytes() + chroma for x in images)
    path.write_bytes(data + b"FRAME\nhalf")
    info, frames = source.read_y4m(spark, str(path), path.stat().st_size)
    assert (info.width, info.height, info.fps, info.frames) == (9, 6, 25.0, 12)
    assert {r.frame_index: bytes(r.pixels) for r in frames.collect()} == {i: x.tobytes() for i, x in enumerate(images)}
    got = {r.frame_index: r for r in video.extract_frames(frames, info.fps, every=5, roi=(1, 1, 4, 3)).collect()}
    assert sorted(got) == [0, 5, 10] and got[5].image == "a_frame_000005_t0000.200.png" and got[5].seconds == 0.2 and header_size(bytes(got[5].data)) == (4, 3)
    assert video.extract_frames(frames, info.fps, count=4).count() == 4 and video.extract_frames(frames, info.fps, seconds=0.2).count() == 3
    with pytest.raises(ValueError):
        video.extract_frames(frames, info.fps, every=1, count=1)

    def load(c=0):
        return lambda image: [(c, 0.9, 0.5, 1.5, 3.5, 2.5)] if image.shape == (3, 4) and image[0, 0] % 2 else []

    rows = video.detect(frames, load, {0: "ant"}, info.fps, roi=(1, 1, 4, 3))
    first = rows.where(F.size("detections") > 0).orderBy("frameIndex").first()
    assert rows.count() == 12 and detection_totals(rows).first().processed_frames == 12
    if first is not None:
        d = first.detections[0]
        assert (d.className, d.bbox.x, d.bbox.y, d.bbox.width, d.bbox.height) == ("ant", 2, 2, 3, 1) and first.timestampSeconds == first.frameIndex / 25
    with pytest.raises(Exception, match="unexpected class 7"):
        video.detect(frames, lambda: lambda image: [(7, 0.9, 0, 0, 1, 1)], {0: "ant"}, info.fps).collect()
    with pytest.raises(ValueError):
        (tmp_path / "b").write_bytes(b"RIFF")
        source.probe_y4m(str(tmp_path / "b"), 4)
