"""PNG files, painting, and pixel checks on real images."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hushlake.functions import boxes as B
from hushlake.operators import glyphs as Y
from hushlake.operators import masks as M
from hushlake.operators import pixels as Z
from hushlake.operators.detector import run_detector
from hushlake.sources import frames as R


def png(pixels: np.ndarray) -> bytes:
    height, width, _ = pixels.shape
    chunk = lambda tag, body: struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))
    raw = b"".join(b"\0" + row.tobytes() for row in pixels)
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.fixture
def shots(tmp_path):
    a = np.arange(4 * 6 * 3, dtype=np.uint8).reshape(4, 6, 3)
    (tmp_path / "a.png").write_bytes(png(a))
    (tmp_path / "b.png").write_bytes(b"not an image")
    return tmp_path, a


def test_frame_scan_of_files(spark, shots):
    folder, _ = shots
    got = {r.path.rsplit("/", 1)[1]: (r.status, r.width, r.height) for r in R.frame_scan(R.read_png_files(spark, str(folder))).collect()}
    assert got == {"a.png": ("ok", 6, 4), "b.png": ("not_png", None, None)}


def test_pixels_and_painting(spark, shots):
    folder, a = shots
    images = R.read_images(spark, str(folder / "a.png")).withColumn("frame_id", F.lit(1).cast("long"))
    rows = {(r.x, r.y): r.rgb for r in Z.frame_pixels(images).collect()}
    assert rows == {(x, y): int(a[y, x, 0]) << 16 | int(a[y, x, 1]) << 8 | int(a[y, x, 2]) for y in range(4) for x in range(6)}
    masks = spark.createDataFrame(
        [(1, "EMAIL", 1, 2, 3, 1), (1, "NAME", 2, 2, 1, 1), (1, "NAME", -5, -5, 2, 2), (1, "NAME", 5, 3, 10**6, 10**6), (1, "NAME", 0, 0, None, 1), (2, "NAME", 0, 0, 9, 9)],
        "frame_id long, kind string, x int, y int, width int, height int",
    )
    after = {(r.x, r.y): r.rgb for r in Z.frame_pixels(Z.paint_images(images, masks)).collect()}
    painted = {(1, 2), (2, 2), (3, 2), (5, 3)}
    assert {k for k in rows if after[k] != rows[k]} == painted
    assert {after[k] for k in painted} == {M.MASK_RGB}
    assert Z.paint_images(images, masks.filter("frame_id = 2")).first().data == images.first().data


def test_painting_keeps_every_image(spark):
    images = spark.createDataFrame(
        [(None, 2, 1, 1, bytearray(b"ab")), (1, 0, 0, 3, bytearray()), (2, 1, 1, 4, bytearray(b"abcd")), (2, 1, 1, 4, bytearray(b"efgh")), (3, None, None, None, None)],
        "frame_id long, width int, height int, channels int, data binary",
    )
    masks = spark.createDataFrame([(None, "NAME", 1, 0, 5, 5), (2, "NAME", 0, 0, 1, 1), (1, "NAME", 0, 0, 9, 9)], "frame_id long, kind string, x int, y int, width int, height int")
    got = sorted(((r.frame_id, bytes(r.data) if r.data is not None else None) for r in Z.paint_images(images, masks).collect()), key=repr)
    colour = bytes([0x35, 0x24, 0x18, 0xFF])
    assert got == sorted([(None, b"a\x18"), (1, b""), (2, colour), (2, colour), (3, None)], key=repr)
    assert Z.frame_pixels(images.filter("frame_id IS NULL OR frame_id <> 3")).count() == 4


def test_scaled_box_covers_touched_pixels(spark):
    df = spark.createDataFrame([(0.2, 0.2, 1.0, 1.0), (-1.0, 0.0, 2.0, 2.0), (0.0, 0.0, float("nan"), 1.0)], "x double, y double, width double, height double")
    got = [r.b for r in df.select(B.css_to_pixels(F.lit(80), F.lit(80), F.lit(40), F.lit(40)).alias("b")).collect()]
    assert tuple(got[0])[:4] == (0, 0, 3, 3)
    assert [g.reason for g in got] == ["ok", "partly_outside", "invalid_geometry"]


def glyphs(spark, dots, prose=()):
    comp = spark.createDataFrame([(1, 0, x, y, w, h, w * h * 3 // 4, 1.0) for x, y, w, h in dots], "frame_id long, polarity int, x int, y int, w int, h int, area int, fill_center double")
    label = spark.createDataFrame([(1, 0, 25, 20, 100, 25, 0.9)], "frame_id long, label_id int, label_x int, label_y int, label_width int, label_height int, confidence double")
    text = spark.createDataFrame(list(prose), "frame_id long, px int, py int, pwidth int, pheight int")
    runs = Y.drop_prose(Y.glyph_runs(Y.candidates(label, comp, 600, 200)), text)
    return [(r.text, r.x, r.y, r.width, r.height) for r in Y.glyph_regions(runs, 600, 200).collect()]


def test_glyph_runs(spark):
    row = lambda n, pitch, w=4: [(30 + i * pitch, 75, w, 4) for i in range(n)]
    assert glyphs(spark, row(6, 6)) == [("•" * 6, 27, 72, 5 * 6 + 10, 10)]
    assert glyphs(spark, row(2, 6)) == []  # too short
    assert glyphs(spark, row(8, 17)) == []  # too far apart
    assert glyphs(spark, row(20, 4, w=1)) == []  # a dotted border
    assert glyphs(spark, row(33, 6)) != [] and all(len(g[0]) <= 32 for g in glyphs(spark, row(33, 6)))
    assert glyphs(spark, row(6, 6), [(1, 20, 70, 200, 20)]) == []  # recognised prose


def slow_runs(dots):
    """Runs by walking all dots of the label from every start: ``{start: xs}``."""
    dots = sorted(dots)
    out = {}
    for n, (x, y, w, h) in enumerate(dots):
        xs, pitch = [x], None
        for x2, y2, w2, h2 in dots:
            dx = x2 - xs[-1]
            if dx > 3 * w + 4:
                break
            alike = max(abs(y2 - y), abs(w2 - w), abs(h2 - h)) <= 1 and 0.7 <= (w2 * h2 * 3 // 4) / (w * h * 3 // 4) <= 1.3
            if alike and dx > w and (pitch is None or abs(dx - pitch) <= 1):
                xs, pitch = [*xs, x2], pitch or dx
        if 3 <= len(xs) <= 32 and xs[-1] - xs[0] <= 320:
            out[n] = xs
    return out


def test_glyph_runs_equal_brute_force_on_a_crowded_frame(spark):
    rng = random.Random(4)
    dots = {(x + rng.randint(0, 1), y, 4, 4) for y in range(70, 92, 3) for x in range(30, 440, 6 + y % 4) if rng.random() < 0.95}
    dots |= {(rng.randint(20, 500), rng.randint(66, 95), rng.randint(4, 14), rng.randint(4, 14)) for _ in range(400)}
    dots = [d for d in dots if 0.65 <= d[2] / d[3] <= 1.55]
    comp = spark.createDataFrame([(1, 0, x, y, w, h, w * h * 3 // 4, 1.0) for x, y, w, h in dots], "frame_id long, polarity int, x int, y int, w int, h int, area int, fill_center double")
    label = spark.createDataFrame([(1, 0, 25, 20, 500, 25, 0.9)], "frame_id long, label_id int, label_x int, label_y int, label_width int, label_height int, confidence double")
    near = Y.candidates(label, comp, 1200, 200)
    seen = [(r.x, r.y, r.w, r.h) for r in near.collect()]
    assert sorted(seen) == sorted(d for d in dots if d[1] + d[3] <= 120 and d[1] >= 43 and d[0] >= 17)
    got = {r.order.n: [g.x for g in r.run] for r in Y.glyph_runs(near).collect()}
    assert got == slow_runs(seen) and len(got) > 100


def test_detector_errors_are_generic(spark):
    def recognize(data):
        if data == b"bad":
            raise RuntimeError("private text")
        return [{"text": data.decode(), "x": 1.0, "y": 2.0, "width": 3.0, "height": 4.0, "confidence": 0.5}] if data else []

    frames = spark.createDataFrame([(1, 1, b"ok"), (1, 2, b"bad"), (1, 3, b"")], "session_id long, frame_id long, png binary")
    got = {r.frame_id: (r.status, r.text) for r in run_detector(frames, recognize).collect()}
    assert got == {1: ("ok", "ok"), 2: ("error", None), 3: ("ok", None)}


CAPTURE = "frame_id long, x int, y int, rgb int, covered boolean"


def independence(first, second):
    """Masked and dependent pixels by a plain loop; of rows at one place the highest of each column counts."""
    sides = []
    for rows in (first, second):
        at = {}
        for f, x, y, rgb, covered in rows:
            old = at.get((f, x, y), (None, False))
            at[f, x, y] = (rgb if old[0] is None else old[0] if rgb is None else max(rgb, old[0]), bool(covered) or old[1])
        sides.append(at)
    out = {place[0]: [0, 0] for side in sides for place in side}
    for place in {*sides[0], *sides[1]}:
        a, b = (side.get(place) for side in sides)
        if a and a[1] or b and b[1]:
            out[place[0]][0] += 1
            out[place[0]][1] += not a or not b or a[0] != b[0]
    return {f: tuple(n) for f, n in out.items()}


@pytest.mark.parametrize("colours", [(M.MASK_RGB,), (M.MASK_RGB, M.MASK_RGB + 1, 0, None), (1, 2, 0xFFFFFF, 0xFFFFFE, None)])
def test_independence_equals_a_plain_loop(spark, colours):
    rng = random.Random(len(colours))
    capture = lambda: [(f, x, y, rng.choice(colours), rng.choice([True, True, False, None])) for f in (1, 2, None) for x in (*range(-3, 70), None) for y in (0, 1, None) for _ in range(rng.choice([0, 1, 1, 1, 2]))]
    first, second = capture() + [(7, 0, 0, 5, False)], capture() + [(8, 0, 0, 5, False)]
    got = Z.mask_independence(spark.createDataFrame(first, CAPTURE), spark.createDataFrame(second, CAPTURE))
    assert {r.frame_id: (r.masked, r.dependent) for r in got.collect()} == independence(first, second)


def test_only_frames_of_alike_colours_are_compared_pixel_by_pixel(spark, monkeypatch):
    seen = []
    compare = Z.aligned

    def aligned(first, second, place, *more, frames=None):
        seen.extend([None] if frames is None else [r.frame_id for r in frames.collect()])
        return compare(first, second, place, *more, frames=frames)

    monkeypatch.setattr(Z, "aligned", aligned)
    masked = [(f, x, 0, M.MASK_RGB, True) for f in (1, 2) for x in range(40)] + [(1, 9, 1, 0, False)]
    leak = [(*r[:3], 0 if r[1] == 5 else r[3], r[4]) for r in masked]
    frame = lambda rows: spark.createDataFrame(rows, CAPTURE)
    counts = lambda a, b: {r.frame_id: (r.masked, r.dependent) for r in Z.mask_independence(frame(a), frame(b)).collect()}
    assert counts(masked, leak) == {1: (40, 1), 2: (40, 1)} and not seen
    other = [(*r[:3], 1 if r[0] == 2 and r[1] == 5 else r[3], r[4]) for r in masked]
    assert counts(other, leak) == {1: (40, 1), 2: (40, 1)} and seen == [2]
