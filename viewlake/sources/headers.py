"""Format, size, EXIF and (for PPM) pixels of image files, from their bytes."""

from __future__ import annotations

import re
import struct

import numpy as np

from viewlake.sources.exif import parse_tiff


class NotAnImage(ValueError):
    pass


PPM_TOKEN = re.compile(rb"#[^\n]*\n?|(\d+)|(\S)")


def _ppm_tokens(data: bytes, n: int) -> tuple[list[int], int]:
    """The first n numbers after the magic, and where they end; comments run to the end of a line."""
    out, at = [], 2
    for m in PPM_TOKEN.finditer(data, 2):
        if m.group(2):
            break
        if m.group(1):
            out.append(int(m.group(1)))
            at = m.end()
            if len(out) == n:
                break
    if len(out) < n:
        raise NotAnImage("incomplete header")
    return out, at


def ppm_size(data: bytes) -> tuple[int, int]:
    (w, h, _), _ = _ppm_tokens(data, 3)
    return w, h


def ppm_pixels(data: bytes) -> np.ndarray:
    """BGR pixels of a P3 or P6 file with up to 8 bits, scaled to 0..255."""
    if data[:2] not in (b"P3", b"P6"):
        raise NotAnImage("not a PPM file")
    (w, h, top), at = _ppm_tokens(data, 3)
    if not 0 < top <= 255:
        raise NotAnImage("only 8-bit PPM files are read")
    if data[:2] == b"P6":
        rgb = np.frombuffer(data, np.uint8, offset=at + 1)
    else:
        rgb = np.array(re.sub(rb"#[^\n]*", b"", data[at:]).split(), np.int64)
    if len(rgb) < w * h * 3:
        raise NotAnImage("pixels are missing")
    rgb = rgb[: w * h * 3].reshape(h, w, 3)
    if top != 255:
        rgb = (rgb.astype(np.int64) * 255 + top // 2) // top
    return rgb[..., ::-1].astype(np.uint8)


def _png(data: bytes) -> tuple[int, int, dict]:
    w, h = struct.unpack_from(">II", data, 16)
    at, exif = 8, {}
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        if kind == b"eXIf":
            exif = parse_tiff(data[at + 8 : at + 8 + size])
        at += 12 + size
    return w, h, exif


def _jpeg(data: bytes) -> tuple[int, int, dict]:
    at, exif = 2, {}
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        marker = data[at + 1]
        if marker == 0xFF or marker == 0x01 or 0xD0 <= marker <= 0xD8:
            at += 1 if marker == 0xFF else 2
            continue
        (size,) = struct.unpack_from(">H", data, at + 2)
        body = data[at + 4 : at + 2 + size]
        if marker == 0xE1 and body[:6] == b"Exif\0\0":
            exif = parse_tiff(body[6:])
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack_from(">HH", body, 1)
            return w, h, exif
        at += 2 + size
    raise NotAnImage("no frame header")


def _tiff(data: bytes) -> tuple[int, int, dict]:
    from viewlake.sources.exif import _directory, _first

    order = "<" if data[:2] == b"II" else ">"
    main = _directory(data, order, struct.unpack_from(f"{order}I", data, 4)[0])
    w, h = _first(main.get(256)), _first(main.get(257))
    if not w or not h:
        raise NotAnImage("no size")
    return int(w), int(h), parse_tiff(data)


def _webp(data: bytes) -> tuple[int, int, dict]:
    kind = data[12:16]
    if kind == b"VP8X":
        return 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little"), {}
    if kind == b"VP8L":
        bits = int.from_bytes(data[21:25], "little")
        return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF), {}
    w, h = struct.unpack_from("<HH", data, 26)
    return w & 0x3FFF, h & 0x3FFF, {}


def read_header(data: bytes) -> tuple[str, int, int, dict]:
    """(format, width, height, exif values) of a PPM, PNG, BMP, JPEG, TIFF or WebP file; NotAnImage for anything else."""
    try:
        if data[:2] in (b"P3", b"P6"):
            return ("PPM", *ppm_size(data), {})
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return ("PNG", *_png(data))
        if data[:2] == b"BM":
            w, h = struct.unpack_from("<ii", data, 18)
            return "BMP", abs(w), abs(h), {}
        if data[:3] == b"\xff\xd8\xff":
            return ("JPEG", *_jpeg(data))
        if data[:4] in (b"II*\0", b"MM\0*"):
            return ("TIFF", *_tiff(data))
        if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            return ("WEBP", *_webp(data))
    except (struct.error, IndexError, KeyError) as e:
        raise NotAnImage(f"damaged header: {e}") from e
    raise NotAnImage("unknown format")


def is_deep_gray(data: bytes) -> bool:
    """Whether a PNG or TIFF file has gray pixels of more than 8 bits, of which the JVM's decoder keeps the wrong ones."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return data[24:25] == b"\x10" and data[25:26] in (b"\0", b"\4")
    if data[:4] in (b"II*\0", b"MM\0*"):
        from viewlake.sources.exif import _directory, _first

        order = "<" if data[:2] == b"II" else ">"
        main = _directory(data, order, struct.unpack_from(f"{order}I", data, 4)[0])
        return (_first(main.get(258)) or 1) > 8 and _first(main.get(262)) in (0, 1)
    return False
