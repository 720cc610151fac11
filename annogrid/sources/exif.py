"""EXIF and IPTC values of image files as maps of strings, read from the files' bytes."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame

#: fixed values: tag numbers and their names
IMAGE_TAGS = {0x0100: "ImageWidth", 0x0101: "ImageLength", 0x010E: "ImageDescription", 0x010F: "Make", 0x0110: "Model", 0x0112: "Orientation", 0x011A: "XResolution", 0x011B: "YResolution", 0x0131: "Software", 0x0132: "DateTime", 0x013B: "Artist", 0x8298: "Copyright"}
EXIF_TAGS = {0x829A: "ExposureTime", 0x829D: "FNumber", 0x8827: "ISOSpeedRatings", 0x9003: "DateTimeOriginal", 0x9201: "ShutterSpeedValue", 0x9202: "ApertureValue", 0x9206: "SubjectDistance", 0x920A: "FocalLength", 0xA002: "ExifImageWidth", 0xA003: "ExifImageLength", 0xA405: "FocalLengthIn35mmFilm", 0xA432: "LensSpecification", 0xA433: "LensMake", 0xA434: "LensModel"}
GPS_TAGS = {1: "GPSLatitudeRef", 2: "GPSLatitude", 3: "GPSLongitudeRef", 4: "GPSLongitude", 5: "GPSAltitudeRef", 6: "GPSAltitude"}
IPTC_TAGS = {5: "object name", 25: "keywords", 55: "date created", 80: "by-line", 90: "city", 101: "country/primary location name", 105: "headline", 110: "credit", 115: "source", 116: "copyright notice", 120: "caption/abstract"}
#: fixed values: bytes and struct codes of the TIFF field types
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}


def _segments(data: bytes):
    """(marker, content) of a JPEG file's segments up to the image data."""
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] not in (0xDA, 0xD9):
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        yield data[at + 1], data[at + 4 : at + 2 + size]
        at += 2 + size


def _tiff(data: bytes) -> bytes | None:
    if data[:4] in (b"II*\0", b"MM\0*"):
        return data
    if data[:2] == b"\xff\xd8":
        return next((c[6:] for m, c in _segments(data) if m == 0xE1 and c[:6] == b"Exif\0\0"), None)
    return None


def read_exif(data: bytes) -> dict[str, str]:
    """Named values; rationals as top/bottom, several values in brackets."""
    tiff, found = _tiff(data or b""), {}
    if tiff is None or len(tiff) < 8:
        return found
    order = "<" if tiff[:2] == b"II" else ">"

    def value(kind: int, count: int, raw: bytes) -> str:
        if kind == 2:
            return raw.split(b"\0")[0].decode("utf-8", "replace").strip()
        if kind in (5, 10):
            pairs = struct.unpack(f"{order}{2 * count}{'I' if kind == 5 else 'i'}", raw)
            out = [str(a) if b == 1 else f"{a}/{b}" for a, b in zip(pairs[::2], pairs[1::2], strict=True)]
        elif kind in _CODES:
            out = [str(x) for x in struct.unpack(f"{order}{count}{_CODES[kind]}", raw)]
        else:
            return raw.hex()
        return out[0] if count == 1 else f"[{', '.join(out)}]"

    def directory(at: int, group: str, names: dict[int, str], seen: set[int]) -> None:
        if at in seen or at + 2 > len(tiff):
            return
        seen.add(at)
        for k in range(struct.unpack(f"{order}H", tiff[at : at + 2])[0]):
            entry = tiff[at + 2 + 12 * k : at + 14 + 12 * k]
            if len(entry) < 12:
                return
            tag, kind, count = struct.unpack(f"{order}HHI", entry[:8])
            size = _SIZES.get(kind, 0) * count
            place = struct.unpack(f"{order}I", entry[8:])[0]
            raw = entry[8 : 8 + size] if size <= 4 else tiff[place : place + size]
            if tag in (0x8769, 0x8825):
                directory(place, *(("EXIF", EXIF_TAGS) if tag == 0x8769 else ("GPS", GPS_TAGS)), seen)
            elif tag in names and size and len(raw) == size:
                found[f"{group} {names[tag]}"] = value(kind, count, raw)

    directory(struct.unpack(f"{order}I", tiff[4:8])[0], "Image", IMAGE_TAGS, set())
    return found


def read_iptc(data: bytes) -> dict[str, str]:
    """Values of the second record of a JPEG file's IPTC block; empty ones are left out, repeated ones joined."""
    found: dict[str, list[str]] = {}
    blocks = [c for m, c in _segments(data or b"") if m == 0xED and c.startswith(b"Photoshop 3.0\0")] if (data or b"")[:2] == b"\xff\xd8" else []
    for block in blocks:
        at = block.find(b"8BIM\x04\x04")
        if at < 0:
            continue
        name = block[at + 6]
        at += 6 + 1 + name + (1 - name % 2)
        size = struct.unpack(">I", block[at : at + 4])[0]
        part, k = block[at + 4 : at + 4 + size], 0
        while k + 5 <= len(part) and part[k] == 0x1C:
            record, tag, n = part[k + 1], part[k + 2], struct.unpack(">H", part[k + 3 : k + 5])[0]
            text = part[k + 5 : k + 5 + n].decode("utf-8", "replace").strip()
            if record == 2 and tag in IPTC_TAGS and text:
                found.setdefault(IPTC_TAGS[tag], []).append(text)
            k += 5 + n
    return {k: "; ".join(v) for k, v in found.items()}


def file_metadata(files: DataFrame) -> DataFrame:
    """path, exif and iptc (maps) and error of (path, content); a file that can't be read has its error and empty maps."""

    def run(batches):
        for batch in batches:
            rows = []
            for data in batch.column(1).to_pylist():
                try:
                    rows.append((read_exif(data), read_iptc(data), None))
                except (struct.error, ValueError, IndexError) as e:
                    rows.append(({}, {}, str(e)))
            kind = pa.map_(pa.string(), pa.string())
            columns = [pa.array([list(r[k].items()) for r in rows], kind) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array([r[2] for r in rows], pa.string())], ["path", "exif", "iptc", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, exif map<string,string>, iptc map<string,string>, error string")
