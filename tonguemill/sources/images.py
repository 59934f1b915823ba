"""Image files: listed without their bytes, checked by their headers, read where they are used."""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tonguemill.sources.readers import read_images

#: Format by extension.
FORMATS = {"png": "png", "jpg": "jpeg", "jpeg": "jpeg", "bmp": "bmp", "webp": "webp"}
_PNG, _PNG_END = b"\x89PNG\r\n\x1a\n", b"\x00\x00\x00\x00IEND\xaeB`\x82"


def list_images(spark: SparkSession, folder: str) -> DataFrame:
    """path and length of the image files below a folder (Spark lists no empty ones); no byte of theirs is read."""
    return read_images(spark, folder).select("path", "length")


def located(path: str):
    """pyarrow's file system of a local path or URI, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def file_size(path: str) -> int | None:
    """Bytes of a file, None where there is none."""
    from pyarrow import fs

    store, at = located(path)
    found = store.get_file_info(at)
    return found.size if found.type == fs.FileType.File else None


Read = Callable[[int, int], bytes]  # (offset, number of bytes)


def _png(read: Read, size: int) -> tuple[int, int] | None:
    head = read(0, 33)
    if len(head) < 33 or head[8:16] != b"\x00\x00\x00\x0dIHDR" or zlib.crc32(head[12:29]) != int.from_bytes(head[29:], "big"):
        return None
    width, height, depth, colour = struct.unpack(">IIBB", head[16:26])
    whole = depth in (1, 2, 4, 8, 16) and colour in (0, 2, 3, 4, 6) and read(size - 12, 12) == _PNG_END
    return (width, height) if whole else None


def _jpeg(read: Read, size: int) -> tuple[int, int] | None:
    if read(size - 2, 2) != b"\xff\xd9":
        return None
    at = 2
    while len(head := read(at, 9)) == 9 and head[0] == 0xFF:
        marker = head[1]
        if marker == 0xFF or marker == 0x01 or 0xD0 <= marker <= 0xD7:  # fill bytes, markers without a segment
            at += 1 if marker == 0xFF else 2
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):  # a frame
            return struct.unpack(">HH", head[5:])[::-1]
        elif marker in (0xD8, 0xD9, 0xDA):  # pixels, or the end, before a frame
            return None
        else:
            at += 2 + int.from_bytes(head[2:4], "big")
    return None


def _bmp(read: Read, size: int) -> tuple[int, int] | None:
    head = read(0, 34)
    if len(head) < 26:
        return None
    pixels, kind = struct.unpack("<II", head[10:18])
    if kind == 12:
        width, height, _, depth = struct.unpack("<HHHH", head[18:26])
        packed = 0
    elif kind >= 40 and len(head) == 34:
        width, height, _, depth, packed = struct.unpack("<iiHHI", head[18:34])
    else:
        return None
    height = abs(height)  # negative: rows from the top
    rows = (width * depth + 31) // 32 * 4 * height if packed in (0, 3) else 1
    return (width, height) if pixels + rows <= size else None


def _webp(read: Read, size: int) -> tuple[int, int] | None:
    head = read(0, 30)
    if len(head) < 25 or head[8:12] != b"WEBP" or int.from_bytes(head[4:8], "little") + 8 > size:
        return None
    kind, body = head[12:16], head[20:]
    if kind == b"VP8L" and body[0] == 0x2F:
        bits = int.from_bytes(body[1:5], "little")
        return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    if kind == b"VP8 " and body[3:6] == b"\x9d\x01\x2a":
        return tuple(x & 0x3FFF for x in struct.unpack("<HH", body[6:10]))
    if kind == b"VP8X" and len(body) == 10:
        return int.from_bytes(body[4:7], "little") + 1, int.from_bytes(body[7:10], "little") + 1
    return None


_PARSERS = ((_PNG, "png", _png), (b"\xff\xd8", "jpeg", _jpeg), (b"BM", "bmp", _bmp), (b"RIFF", "webp", _webp))


def image_header(read: Read, size: int) -> tuple[str, int, int] | None:
    """Format, width and height by a few range reads; None for what is no image, has no size or was cut off."""
    start = read(0, 8) if size >= 12 else b""
    for magic, name, parse in _PARSERS:
        if start.startswith(magic):
            found = parse(read, size)
            return (name, *found) if found and min(found) > 0 else None
    return None


def read_checked(path: str, by_content: bool = False) -> bytes | None:
    """An image's bytes, read whole only once its header is found good; None where it is not. A file whose format is not
    the one that its name says is no good, unless by_content."""
    store, at = located(path)
    with store.open_input_file(at) as f:
        size = f.size()
        known = image_header(lambda start, n: f.read_at(max(0, min(n, size - start)), start) if start >= 0 else b"", size)
        if known is None or not (by_content or FORMATS.get(path.rsplit(".", 1)[-1].lower()) == known[0]):
            return None
        return f.read_at(size, 0)
