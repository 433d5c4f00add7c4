import json
import os
import struct
from pathlib import Path

import numpy as np
import pytest

from viewlake.cli import main
from viewlake.config import AuditConfig
from viewlake.plans.audit import audit
from viewlake.plans.report import document, text_report
from viewlake.sources import colmap, detect, exif, headers, images, video


def ppm(path, gray, comment=""):
    h, w = np.asarray(gray).shape
    body = "\n".join(" ".join(f"{v} {v} {v}" for v in row) for row in np.asarray(gray, int))
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(f"P3\n{comment}{w} {h}\n255\n{body}\n")


def patterns():
    a = [[255 * ((x + y) % 2 == 0) for x in range(4)] for y in range(4)]
    b = [[255 * (x // 2 == y // 2) for x in range(4)] for y in range(4)]
    c = [[255 * ((x in (0, 3)) == (y in (0, 3))) for x in range(4)] for y in range(4)]
    return a, b, c


@pytest.fixture
def basic(tmp_path):
    for name, p in zip(("img_a", "img_b", "img_c"), patterns()):
        ppm(tmp_path / "set" / f"{name}.ppm", p, "# made here\n")
    return tmp_path / "set"


def codes(report):
    return [i["code"] for i in report["issues"] or []]


def test_image_folder(spark, basic):
    report, records = audit(spark, str(basic))
    assert codes(report) == ["too_few_images", "missing_exif"] and report["has_errors"]
    assert report["image_count"] == 3 and report["resolution_stats"]["resolutions"] == [{"resolution": "4x4", "images": 3}]
    assert report["resolution_stats"]["pixel_count_variation"] == 0.0 and report["duplicates"]["n_clusters"] == 0
    assert [r["perceptual_hash"] for r in records.orderBy("ord").collect()] == ["cccc3333cccc3333", "f0f0f0f00f0f0f0f", "c3c33c3c3c3cc3c3"]


def test_other_limits_and_quality(spark, basic):
    report, records = audit(spark, str(basic), AuditConfig(min_image_count=2, warn_image_count=5, quality=True))
    assert codes(report) == ["low_image_count", "missing_exif", "flagged_image_quality"]
    flags = [r["quality_metrics"]["flags"] for r in records.orderBy("ord").collect()]
    assert flags == [["clipped_highlights", "high_noise"], ["clipped_highlights", "high_noise", "sky_or_reflective_dominance"], ["clipped_highlights", "high_noise"]]
    assert [r["recommendation"] for r in report["recommendations"]][-1].startswith("Consider")
    lines = list(text_report(report, [{"path": "x", "flags": ["blurry"]}], quality=True, flagged_only=True))
    assert "- x: blurry" in lines and "- Flagged images: 3" in lines and "- Only flagged images are listed" in lines and lines[0] == "Audit with quality"
    assert "- No image is flagged" in list(text_report(report, [], quality=True, flagged_only=True)) and "Quality" not in list(text_report(report))


def test_duplicates_and_unreadable_files(spark, basic):
    ppm(basic / "dup.ppm", patterns()[0])
    (basic / "bad.png").write_text("no image")
    report, records = audit(spark, str(basic))
    assert codes(report) == ["too_few_images", "unreadable_images", "missing_exif", "duplicate_images"]
    assert report["duplicates"]["n_duplicates"] == 1 and report["duplicates"]["duplicate_clusters"][0]["exact"]
    bad = records.where("not readable").first()
    assert (bad["width"], bad["height"], bad["format"]) == (0, 0, None) and bad["notes"]


def test_mixed_orientation(spark, tmp_path):
    ppm(tmp_path / "a.ppm", np.zeros((4, 6)))
    ppm(tmp_path / "b.ppm", np.zeros((6, 4)))
    report, _ = audit(spark, str(tmp_path))
    assert "mixed_orientations" in codes(report) and report["resolution_stats"]["pixel_count_variation"] == 0.0


def test_scene_checks_count_the_root_folder(spark, tmp_path):
    for i in range(3):
        ppm(tmp_path / f"r{i}.ppm", np.full((2, 2), i))
    for d in ("x", "y"):
        for i in range(4):
            ppm(tmp_path / d / f"{i}.ppm", np.full((2, 2), i))
    report, _ = audit(spark, str(tmp_path), AuditConfig(recursive=True))
    assert "multiple_parent_groups" in codes(report) and report["record_stats"]["n_folders"] == 3


def test_listing_order_links_and_hidden_names(tmp_path):
    for name in ("b.c/x.ppm", "b/x.ppm", "_a.ppm", ".h.ppm", "note.txt", "Z.PPM"):
        ppm(tmp_path / name, np.zeros((1, 1)))
    os.symlink(tmp_path / "_a.ppm", tmp_path / "link.ppm")
    assert [os.path.relpath(p, tmp_path) for p in images.list_images(str(tmp_path), True)] == [".h.ppm", "Z.PPM", "_a.ppm", "_a.ppm", "b/x.ppm", "b.c/x.ppm"]
    assert images.list_images(str(tmp_path / "b"), False)[0].endswith("b/x.ppm")


def text_model(folder, images_txt):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "cameras.txt").write_text("# cameras\n1 PINHOLE 640 480 1 1 1 1\n\n1 PINHOLE 800 600 1 1 1 1\n2 PINHOLE 10 20 1\n")
    (folder / "images.txt").write_text(images_txt)
    (folder / "points3D.txt").write_text("")


def test_text_model(spark, tmp_path):
    text_model(tmp_path / "m", "# list\n1 1 0 0 0 0 0 0 1 image_001.jpg\n0 0 -1\n2 1 0 0 0 0 0 0 9 a b.jpg\n0 0 -1\n")
    report, records = audit(spark, str(tmp_path / "m"), AuditConfig(quality=True))
    rows = records.orderBy("ord").collect()
    assert [(r["path"], r["width"], r["height"], r["source_exists"]) for r in rows] == [("image_001.jpg", 800, 600, None), ("a", 0, 0, None)]
    assert codes(report) == ["too_few_images"] and len(report["skipped_checks"]) == 3 and report["metadata"] == {"colmap_model_type": "text", "quality_enabled": True}


def test_empty_point_lines(spark, tmp_path):
    text_model(tmp_path / "m", "1 1 0 0 0 0 0 0 1 a.jpg\n\n2 1 0 0 0 0 0 0 2 b.jpg\n\n")
    path = str(tmp_path / "m" / "images.txt")
    assert [r["name"] for r in colmap.images_text(spark, path).collect()] == ["a.jpg"]
    assert [r["name"] for r in colmap.images_text(spark, path, keep_empty_points=True).orderBy("ord").collect()] == ["a.jpg", "b.jpg"]


def binary_model(folder, model=1, cut=0):
    folder.mkdir(parents=True, exist_ok=True)
    n = colmap.PARAMETERS.get(model, 4)
    (folder / "cameras.bin").write_bytes(struct.pack("<Q", 1) + struct.pack("<iiQQ", 7, model, 640, 480) + struct.pack(f"<{n}d", *[1.0] * n))
    data = struct.pack("<Q", 2)
    for i, name in ((3, b"a.jpg"), (4, "é.jpg".encode())):
        data += struct.pack("<i", i) + struct.pack("<7d", *[0.0] * 7) + struct.pack("<i", 7) + name + b"\0" + struct.pack("<Q", 1) + struct.pack("<ddq", 1, 2, -1)
    (folder / "images.bin").write_bytes(data[: len(data) - cut])
    (folder / "points3D.bin").write_bytes(b"")


@pytest.mark.parametrize("model", range(11))
def test_binary_cameras_of_every_model(tmp_path, model):
    binary_model(tmp_path, model)
    assert colmap.read_cameras_binary((tmp_path / "cameras.bin").read_bytes()) == [(7, 640, 480)]


def test_binary_model(spark, tmp_path):
    binary_model(tmp_path / "m")
    loaded = detect.load(spark, str(tmp_path / "m"))
    assert loaded.mode == "colmap_binary" and [(r["path"], r["width"]) for r in loaded.records.orderBy("ord").collect()] == [("a.jpg", 640), ("é.jpg", 640)]
    with pytest.raises(ValueError):
        colmap.read_images_binary((tmp_path / "m" / "images.bin").read_bytes()[:90])
    with pytest.raises(ValueError):
        colmap.read_cameras_binary(struct.pack("<Q", 1) + struct.pack("<iiQQ", 1, 11, 1, 1))


def test_detection(tmp_path, basic):
    assert detect.detect_mode(str(basic)) == "image_folder"
    text_model(basic, "")
    assert detect.detect_mode(str(basic)) == "colmap_text"
    binary_model(basic)
    assert detect.detect_mode(str(basic)) == detect.detect_mode(str(basic), " COLMAP ") == "colmap_binary"
    binary_model(basic, 11)
    assert detect.detect_mode(str(basic)) == "image_folder"
    assert detect.detect_mode(str(basic), "colmap_text") == "colmap_text"
    for bad in ("model.ply", "x.txt"):
        (tmp_path / bad).write_text("ply")
        with pytest.raises(ValueError, match="PLY" if bad.endswith("ply") else "unsupported"):
            detect.detect_mode(str(tmp_path / bad))
    (tmp_path / "v.MP4").write_text("")
    assert detect.detect_mode(str(tmp_path / "v.MP4")) == "video"
    (tmp_path / "empty").mkdir()
    for args in ((str(tmp_path / "none"),), (str(tmp_path / "empty"),), (str(basic), "film"), (str(basic), "video"), (str(tmp_path / "v.MP4"), "images")):
        with pytest.raises(ValueError):
            detect.detect_mode(*args)


def test_video_frames(spark, tmp_path):
    clip = tmp_path / "clip.mp4"
    clip.write_text("")

    def fake(path, pattern, fps):
        for i in (1, 2):
            ppm((tmp_path / "frames" / f"frame_{i:06d}.ppm"), np.full((2, 3), 9 * i))

    frames = video.extract_frames(str(clip), 2.0, str(tmp_path / "frames"), fake)
    assert len(frames) == 2 and images.scan(spark, frames, str(tmp_path / "frames")).where("width = 3").count() == 2
    with pytest.raises(ValueError, match="no frames"):
        video.extract_frames(str(clip), 2.0, str(tmp_path / "other"), lambda *a: None)
    with pytest.raises(ValueError, match="ffmpeg"):
        video.extract_frames(str(clip), 2.0, str(tmp_path / "none"))


def tiff(order="<"):
    """A TIFF structure with maker, model, focal length and position in sub-directories."""
    e = lambda tag, kind, count, value: struct.pack(f"{order}HHI", tag, kind, count) + value
    long = lambda v: struct.pack(f"{order}I", v)
    pad = lambda s: s.ljust(4, b"\0")
    main_at, exif_at, gps_at, data_at = 8, 8 + 2 + 4 * 12 + 4, 0, 0
    gps_at = exif_at + 2 + 12 + 4
    data_at = gps_at + 2 + 4 * 12 + 4
    rational = lambda *xs: b"".join(struct.pack(f"{order}II", a, b) for a, b in xs)
    blocks = [rational((45, 10)), rational((10, 1), (30, 1), (36, 1)), rational((20, 1), (0, 1), (0, 1)), b"Maker X\0"]
    at = [data_at]
    for b in blocks:
        at.append(at[-1] + len(b))
    main = struct.pack(f"{order}H", 4) + e(0x010F, 2, 8, long(at[3])) + e(0x0110, 2, 3, pad(b"M2\0")) + e(0x8769, 4, 1, long(exif_at)) + e(0x8825, 4, 1, long(gps_at)) + long(0)
    detail = struct.pack(f"{order}H", 1) + e(0x920A, 5, 1, long(at[0])) + long(0)
    gps = struct.pack(f"{order}H", 4) + e(1, 2, 2, pad(b"S\0")) + e(2, 5, 3, long(at[1])) + e(3, 2, 2, pad(b"E\0")) + e(4, 5, 3, long(at[2])) + long(0)
    return (b"II*\0" if order == "<" else b"MM\0*") + long(main_at) + main + detail + gps + b"".join(blocks)


@pytest.mark.parametrize("order", "<>")
def test_exif(order):
    assert exif.parse_tiff(tiff(order)) == {"make": "Maker X", "model": "M2", "focal_length_mm": 4.5, "gps_latitude": -10.51, "gps_longitude": 20.0}
    assert exif.parse_tiff(tiff(order), sub_ifds=False) == {"make": "Maker X", "model": "M2"}
    assert exif.parse_tiff(tiff(order)[:60]) in ({}, {"model": "M2"}) and exif.parse_tiff(b"nothing") == {}


def test_headers():
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sIIBBBBB", 13, b"IHDR", 30, 20, 8, 2, 0, 0, 0) + b"crc0" + struct.pack(">I4s", len(tiff()), b"eXIf") + tiff() + b"crc1"
    jpeg = b"\xff\xd8" + b"\xff\xe1" + struct.pack(">H", 8 + len(tiff())) + b"Exif\0\0" + tiff() + b"\xff\xc0" + struct.pack(">HBHHB", 17, 8, 20, 30, 3) + b"\0" * 9
    bmp = b"BM" + b"\0" * 16 + struct.pack("<ii", 30, -20) + b"\0" * 10
    webp = b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + (29).to_bytes(3, "little") + (19).to_bytes(3, "little")
    for data, kind, has in ((png, "PNG", True), (jpeg, "JPEG", True), (bmp, "BMP", False), (webp, "WEBP", False)):
        name, w, h, found = headers.read_header(data)
        assert (name, w, h, bool(found)) == (kind, 30, 20, has)
    assert headers.read_header(b"P6 2 1 255\n" + bytes(6))[1:3] == (2, 1)
    assert headers.ppm_pixels(b"P6 2 1 255\n" + bytes([1, 2, 3, 4, 5, 6])).tolist() == [[[3, 2, 1], [6, 5, 4]]]
    for bad in (b"", b"text", b"P3 1", b"\xff\xd8\xff\xe0", b"\x89PNG\r\n\x1a\n"):
        with pytest.raises(headers.NotAnImage):
            headers.read_header(bad)
    with pytest.raises(headers.NotAnImage):
        headers.ppm_pixels(b"P3 2 2 255\n1 2 3")


def test_command_line(spark, basic, tmp_path, capsys):
    assert main(["analyze", str(basic), "--json"], spark) == 0
    payload = json.loads(capsys.readouterr().out)
    assert payload["image_count"] == payload["input_summary"]["image_count"] == 3 and payload["input_summary"]["resolved_path"] == str(basic)
    assert [r["path"] for r in payload["image_records"]] == payload["exif_stats"]["images_without_exif"] and payload["image_records"][0]["quality_metrics"] is None
    assert payload["validation_stats"] == {"duplicate_image_count": 0, "unreadable_image_count": 0, "unreadable_images": [], "duplicate_clusters": [], "skipped_checks": []}
    assert main(["analyze", str(basic), "--strict", "--json", "--output", str(tmp_path / "r.json"), "--quality", "--flagged-only"], spark) == 2
    out = capsys.readouterr().out
    written = json.loads((tmp_path / "r.json").read_text())
    assert "Flagged images" in out and written["quality"]["flagged"] == 3 and written["image_records"][0]["quality_metrics"]["flags"]
    assert main(["analyze", str(tmp_path / "none")], spark) == 2 and "does not exist" in capsys.readouterr().err
    assert main(["optimize"], spark) == 2


def test_jvm_decoder_agrees_on_size(spark, tmp_path):
    rows = b"".join(bytes([0, 0, 255] * 2) + b"\0\0" for _ in range(3))
    data = b"BM" + struct.pack("<IHHI", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 2, 3, 1, 24, 0, len(rows), 0, 0, 0, 0) + rows
    (tmp_path / "a.bmp").write_bytes(data)
    row = images.scan_with_jvm(spark, str(tmp_path)).first()
    assert (row["w"], row["h"]) == (2, 3) and bytes(row["data"][:3]) == bytes([0, 0, 255])


def by_java(spark, path, gray, kind):
    """A file of a gray pattern, written by the JVM."""
    jvm, a = spark.sparkContext._jvm, np.asarray(gray, int)
    image = jvm.java.awt.image.BufferedImage(a.shape[1], a.shape[0], 1)
    for y, row in enumerate(a.tolist()):
        for x, v in enumerate(row):
            image.setRGB(x, y, v << 16 | v << 8 | v)
    assert jvm.javax.imageio.ImageIO.write(image, kind, jvm.java.io.File(str(path)))


def test_pixels_of_real_formats_are_measured(spark, tmp_path):
    a = np.kron(patterns()[1], np.ones((4, 4)))
    ppm(tmp_path / "a.ppm", a)
    for name, kind in (("_b.png", "png"), ("c[1].bmp", "bmp"), ("d.tif", "tiff"), ("e.jpg", "jpg")):
        by_java(spark, tmp_path / name, a, kind)
    (tmp_path / "f.png").write_bytes((tmp_path / "_b.png").read_bytes()[:60])
    (tmp_path / "g.webp").write_bytes(b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + (29).to_bytes(3, "little") + (19).to_bytes(3, "little"))
    report, records = audit(spark, str(tmp_path), AuditConfig(quality=True))
    rows = {os.path.basename(r["path"]): r for r in records.collect()}
    assert len(rows) == 7 and all(r["readable"] for r in rows.values())
    for name in ("_b.png", "c[1].bmp", "d.tif"):
        assert rows[name]["perceptual_hash"] == rows["a.ppm"]["perceptual_hash"] and rows[name]["quality_metrics"] == rows["a.ppm"]["quality_metrics"]
    assert rows["e.jpg"]["perceptual_hash"] == rows["a.ppm"]["perceptual_hash"]
    assert report["quality"]["analysed"] == 5 and report["duplicates"]["n_duplicates"] == 4
    for name in ("f.png", "g.webp"):
        assert rows[name]["quality_metrics"] is None and "not decoded" in rows[name]["notes"][0]
    report, _ = audit(spark, str(tmp_path))
    assert report["duplicates"]["n_duplicates"] == 4 and report["skipped_checks"]
    assert not [p for p in tmp_path.iterdir() if p.name.startswith("links-")]


def test_all_skipped_images_are_listed(spark, tmp_path):
    data = b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + (29).to_bytes(3, "little") + (19).to_bytes(3, "little")
    for i in range(1003):
        (tmp_path / f"{i}.webp").write_bytes(data)
    (tmp_path / "bad.png").write_text("no image")
    done = audit(spark, str(tmp_path), AuditConfig(quality=True))
    report, _ = done
    assert report["skipped_counts"] == {"pixels were not decoded": 1003, "unreadable": 1} and len(report["skipped_checks"]) == 2
    assert done.tables["skipped_checks"].select("path").distinct().count() == 1004
    listed = json.loads("".join(document(report, done.tables)))["validation_stats"]
    assert len(listed["skipped_checks"]) == 1004 and listed["unreadable_images"] == [str(tmp_path / "bad.png")]


def test_document_lists_clusters_with_members(spark, tmp_path):
    a, b = (np.kron(x, np.ones((2, 2))) for x in patterns()[:2])
    for name, x in (("1", a), ("2", b), ("3", a), ("4", b), ("5", b)):
        ppm(tmp_path / f"{name}.ppm", x)
    done = audit(spark, str(tmp_path))
    found = json.loads("".join(document(done.report, done.tables)))["validation_stats"]["duplicate_clusters"]
    names = [[os.path.basename(m) for m in c["members"]] for c in found]
    assert names == [["2.ppm", "4.ppm", "5.ppm"], ["1.ppm", "3.ppm"]] and [os.path.basename(c["representative"]) for c in found] == ["2.ppm", "1.ppm"]
    assert all(c["exact"] and c["average_distance"] == 0 for c in found)


def test_damaged_text_model_beside_images_is_an_image_folder(spark, basic):
    for name, text in (("cameras.txt", "1 PINHOLE wide 4 1 1 1 1\n"), ("images.txt", ""), ("points3D.txt", "")):
        (basic / name).write_text(text)
    assert detect.detect_mode(str(basic)) == "image_folder"
    (basic / "cameras.txt").write_text("1 PINHOLE 4 4 1 1 1 1\n")
    (basic / "images.txt").write_text("1 1 0 0 0 0 0 0 1\n\n")  # no name
    assert detect.detect_mode(str(basic)) == "image_folder"
    (basic / "images.txt").write_text("1 1 0 0 0 0 0 0 1 a.jpg\n1 2 3\n")
    assert detect.detect_mode(str(basic)) == "colmap_text"


def test_video_frames_go_to_the_shared_folder(spark, tmp_path):
    clip = tmp_path / "clip.mp4"
    clip.write_text("")

    def fake(video, pattern, fps):
        for i in (1, 2):
            ppm(Path(pattern % i), np.full((3, 3), i * 50))

    report, _ = audit(spark, str(clip), extractor=fake)
    assert report["input_summary"]["extracted_frame_count"] == 2 and "frames-" in report["metadata"]["extracted_frame_dir"]
