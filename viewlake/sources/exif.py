"""Five values from the EXIF block of an image: maker, model, focal length and position."""

from __future__ import annotations

import struct

# fixed values: tag numbers and TIFF type sizes
MAKE, MODEL, FOCAL, EXIF_IFD, GPS_IFD = 0x010F, 0x0110, 0x920A, 0x8769, 0x8825
LAT_REF, LAT, LON_REF, LON = 1, 2, 3, 4
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
FORMATS = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}


def _value(block: bytes, order: str, kind: int, count: int, at: int):
    raw = block[at : at + SIZES[kind] * count]
    if len(raw) < SIZES[kind] * count:
        return None
    if kind == 2:
        return raw.split(b"\0")[0].decode("utf-8", "replace").strip() or None
    if kind == 7:
        return raw
    if kind in (5, 10):
        parts = struct.unpack(f"{order}{2 * count}{'I' if kind == 5 else 'i'}", raw)
        return [(a / b if b else None) for a, b in zip(parts[::2], parts[1::2])]
    return list(struct.unpack(f"{order}{count}{FORMATS[kind]}", raw))


def _directory(block: bytes, order: str, at: int) -> dict:
    out: dict = {}
    if at + 2 > len(block):
        return out
    (n,) = struct.unpack_from(f"{order}H", block, at)
    for i in range(n):
        entry = at + 2 + 12 * i
        if entry + 12 > len(block):
            break
        tag, kind, count = struct.unpack_from(f"{order}HHI", block, entry)
        if kind not in SIZES or count > len(block):
            continue
        size = SIZES[kind] * count
        where = entry + 8 if size <= 4 else struct.unpack_from(f"{order}I", block, entry + 8)[0]
        out[tag] = _value(block, order, kind, count, where)
    return out


def _first(x):
    return x[0] if isinstance(x, list) and x else None


def dms(parts, ref: str | None) -> float | None:
    """Degrees from three parts, all of which must be there; south and west are negative."""
    if not isinstance(parts, list) or len(parts) != 3 or any(p is None for p in parts):
        return None
    whole = parts[0] + parts[1] / 60 + parts[2] / 3600
    return -whole if ref in ("S", "W") else whole


def parse_tiff(block: bytes, sub_ifds: bool = True) -> dict:
    """The five values (absent ones left out) of a TIFF structure; {} if it is none.

    ``sub_ifds`` False reads the main directory alone, where focal length and position
    are rarely stored.
    """
    if len(block) < 8 or block[:2] not in (b"II", b"MM"):
        return {}
    order = "<" if block[:2] == b"II" else ">"
    main = _directory(block, order, struct.unpack_from(f"{order}I", block, 4)[0])
    detail, gps = main, {}
    if sub_ifds:
        if _first(main.get(EXIF_IFD)) is not None:
            detail = main | _directory(block, order, _first(main[EXIF_IFD]))
        if _first(main.get(GPS_IFD)) is not None:
            gps = _directory(block, order, _first(main[GPS_IFD]))
    out = {
        "make": main.get(MAKE), "model": main.get(MODEL), "focal_length_mm": _first(detail.get(FOCAL)),
        "gps_latitude": dms(gps.get(LAT), gps.get(LAT_REF)), "gps_longitude": dms(gps.get(LON), gps.get(LON_REF)),
    }
    return {k: v for k, v in out.items() if v is not None}
