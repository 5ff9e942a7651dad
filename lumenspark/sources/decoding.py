"""Decoding of image files at their own depth: PNG, TIFF and BMP from the bytes of a file.

Spark's image source gives 8 bits and drops what does not fit; microscopes write 16 bits.  Here a
file keeps its levels (uint8 or uint16) and its channels, alpha last: gray, gray and alpha, RGB, RGB and
alpha.  A palette becomes RGB.  What is damaged or of another kind raises ValueError with the reason,
which read_images turns into a row of its own.  JPEG, which has 8 bits, is left to Spark's image source.

The five row filters of PNG look left and up, so a row-by-row loop would go byte by byte.  Here all pixels
of an antidiagonal, whose neighbours lie on the two before it, are restored at once.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspark.sources.images import EXTENSIONS, FRAME_BYTES, PAYLOAD, payload_of

# Signatures, and the channels of PNG colour types.
_PNG = b"\x89PNG\r\n\x1a\n"
_PNG_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: First columns and rows, and steps, of the seven passes of an interlaced PNG.
_PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
#: Levels that an image may have at most; a header that claims more is taken as damaged.
MOST_LEVELS = 1 << 31


def _chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = len(_PNG)
    while at + 12 <= len(data):
        (size,) = struct.unpack(">I", data[at : at + 4])
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if len(body) < size or data[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(kind + body)):
            raise ValueError("damaged PNG chunk")
        yield kind, body
        if kind == b"IEND":
            return
        at += 12 + size
    raise ValueError("PNG ends early")


def unfilter(raw: np.ndarray, filters: np.ndarray, step: int) -> np.ndarray:
    """Rows of bytes without their PNG filters (0 none, 1 left, 2 up, 3 mean, 4 Paeth); step: bytes of a pixel."""
    rows, width = raw.shape
    if filters.max(initial=0) > 4:
        raise ValueError("unknown PNG filter")
    if not filters.any():
        return raw
    cells = raw.reshape(rows, width // step, step)
    cols = cells.shape[1]
    out = np.zeros((rows + 1, cols + 1, step), np.int16)  # a border of zeros above and to the left
    kind = filters[:, None]
    for d in range(rows + cols - 1):
        y = np.arange(max(0, d - cols + 1), min(rows, d + 1))
        x = d - y
        left, up, corner = out[y + 1, x], out[y, x + 1], out[y, x]
        guess = left + up - corner
        a, b, c = np.abs(guess - left), np.abs(guess - up), np.abs(guess - corner)
        paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        k = kind[y]
        add = np.where(k == 1, left, np.where(k == 2, up, np.where(k == 3, (left + up) >> 1, np.where(k == 4, paeth, 0))))
        out[y + 1, x + 1] = (cells[y, x] + add) & 255
    return out[1:, 1:].astype(np.uint8).reshape(rows, width)


def _png_pass(data: bytes, at: int, rows: int, cols: int, channels: int, depth: int) -> tuple[np.ndarray, int]:
    """Samples (rows, cols, channels) of one pass, and where its data ends."""
    width = -(-cols * channels * depth // 8)
    end = at + rows * (width + 1)
    if len(data) < end:
        raise ValueError("PNG has too few pixels")
    lines = np.frombuffer(data, np.uint8, rows * (width + 1), at).reshape(rows, width + 1)
    flat = unfilter(lines[:, 1:], lines[:, 0], max(1, channels * depth // 8))
    if depth == 16:
        samples = np.ascontiguousarray(flat).view(">u2").astype(np.uint16)
    elif depth == 8:
        samples = flat
    else:
        bits = np.unpackbits(flat, axis=1)[:, : cols * channels * depth].reshape(rows, cols * channels, depth)
        samples = (bits * (1 << np.arange(depth - 1, -1, -1))).sum(axis=2).astype(np.uint8)
    return samples.reshape(rows, cols, channels), end


def decode_png(data: bytes) -> np.ndarray:
    header = palette = clear = None
    parts = []
    for kind, body in _chunks(data):
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = body
        elif kind == b"IDAT":
            parts.append(body)
    if header is None:
        raise ValueError("PNG without a header")
    cols, rows, depth, colour, _, _, interlaced = header
    channels = _PNG_CHANNELS.get(colour)
    if channels is None or depth not in (1, 2, 4, 8, 16) or not 0 < rows * cols * channels < MOST_LEVELS:
        raise ValueError("odd PNG header")
    try:
        flat = zlib.decompress(b"".join(parts))
    except zlib.error as e:
        raise ValueError(f"damaged PNG pixels: {e}") from None
    if interlaced:
        out = np.zeros((rows, cols, channels), np.uint16 if depth == 16 else np.uint8)
        at = 0
        for x, y, dx, dy in _PASSES:
            h, w = -(-(rows - y) // dy), -(-(cols - x) // dx)
            if h > 0 and w > 0:
                out[y::dy, x::dx], at = _png_pass(flat, at, h, w, channels, depth)
    else:
        out, _ = _png_pass(flat, 0, rows, cols, channels, depth)
    if colour == 3:
        if palette is None or out.max(initial=0) >= len(palette):
            raise ValueError("PNG without a palette for its pixels")
        shown = palette[out[..., 0]]
        if clear is not None:
            alpha = np.full(256, 255, np.uint8)
            alpha[: len(clear)] = np.frombuffer(clear, np.uint8)
            shown = np.concatenate([shown, alpha[out]], axis=-1)
        return shown
    if depth < 8:
        out = out * np.uint8(255 // ((1 << depth) - 1))
    return out[..., 0] if channels == 1 else out


# Bytes of the TIFF field types that are read here.
_TIFF_TYPES = {1: "B", 3: "H", 4: "I"}


def _tiff_fields(data: bytes) -> tuple[str, dict[int, tuple[int, ...]]]:
    order = {b"II": "<", b"MM": ">"}[data[:2]]
    magic, at = struct.unpack(f"{order}HI", data[2:8])
    if magic != 42:
        raise ValueError("TIFF of another kind")
    (n,) = struct.unpack_from(f"{order}H", data, at)
    fields = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(f"{order}HHI", data, at + 2 + 12 * i)
        code = _TIFF_TYPES.get(kind)
        if code:
            size = struct.calcsize(code) * count
            place = at + 10 + 12 * i
            if size > 4:
                (place,) = struct.unpack_from(f"{order}I", data, place)
            fields[tag] = struct.unpack_from(f"{order}{count}{code}", data, place)
    return order, fields


def _unpacked(data: bytes) -> bytes:
    """Bytes of runs by PackBits."""
    out, at = [], 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out.append(data[at + 1 : at + 2 + n])
            at += 2 + n
        else:
            if n > 128:
                out.append(data[at + 1 : at + 2] * (257 - n))
            at += 2
    return b"".join(out)


def decode_tiff(data: bytes) -> np.ndarray:
    """The first image of a file, in strips without compression, by deflate or by PackBits."""
    order, f = _tiff_fields(data)
    one = lambda tag, default=None: f[tag][0] if tag in f else default
    cols, rows, bits, way, channels = one(256), one(257), one(258, 1), one(259, 1), one(277, 1)
    unpack = {1: bytes, 8: zlib.decompress, 32946: zlib.decompress, 32773: _unpacked}.get(way)
    if unpack is None or bits not in (8, 16) or 273 not in f or 279 not in f or one(339, 1) != 1 or one(262) not in (0, 1, 2) or not cols or not rows:
        raise ValueError("TIFF with a layout that is not read")
    if len(set(f[258])) > 1 or not 0 < rows * cols * channels < MOST_LEVELS:
        raise ValueError("odd TIFF header")
    kind = np.dtype(f"{order}u{bits // 8}")
    apart = one(284, 1) == 2
    wide = 1 if apart else channels
    per = min(one(278, rows), rows)
    strips = []
    for i, (at, size) in enumerate(zip(f[273], f[279], strict=True)):
        n = min(per, rows - (i * per) % (-(-rows // per) * per))
        part = unpack(data[at : at + size])
        if len(part) < n * cols * wide * kind.itemsize:
            raise ValueError("TIFF has too few pixels")
        strip = np.frombuffer(part, kind, n * cols * wide).reshape(n, cols, wide)
        if one(317, 1) == 2:
            strip = np.cumsum(strip, axis=1, dtype=kind.newbyteorder("="))
        strips.append(strip)
    if len(strips) != -(-rows // per) * (channels if apart else 1):
        raise ValueError("TIFF lacks strips")
    out = np.concatenate(strips).astype(kind.newbyteorder("="))
    out = np.moveaxis(out.reshape(channels, rows, cols), 0, -1) if apart else out
    if one(262) == 0:
        out = np.iinfo(out.dtype).max - out
    return out[..., 0] if channels == 1 else np.ascontiguousarray(out)


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 24 or 32 bits; the last byte of 32 is no alpha."""
    start, _, cols, rows, _, bits, way = struct.unpack("<IIiiHHI", data[10:34])
    if bits not in (24, 32) or way != 0 or cols <= 0 or not rows:
        raise ValueError("BMP with a layout that is not read")
    line = (cols * bits // 8 + 3) // 4 * 4
    if len(data) < start + line * abs(rows):
        raise ValueError("BMP has too few pixels")
    lines = np.frombuffer(data, np.uint8, line * abs(rows), start).reshape(abs(rows), line)
    out = lines[:, : cols * bits // 8].reshape(abs(rows), cols, bits // 8)[..., 2::-1]
    return np.ascontiguousarray(out[::-1] if rows > 0 else out)


def decode(data: bytes) -> np.ndarray:
    """The image in the bytes of a file, by its signature."""
    try:
        if data[:8] == _PNG:
            return decode_png(data)
        if data[:2] in (b"II", b"MM"):
            return decode_tiff(data)
        if data[:2] == b"BM":
            return decode_bmp(data)
    except (struct.error, zlib.error, IndexError, TypeError, KeyError) as e:
        raise ValueError(f"damaged file: {e}") from None
    raise ValueError("not an image of a kind that is read")


def decode_files(files: DataFrame, pixels: bool = True) -> DataFrame:
    """(filename, content) -> filename, payload and error; error is null where the image is whole, the payload where it isn't.

    Without pixels the files are decoded all the same, but only their sizes leave the task.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["filename", "height", "width", "channels", "dtype", "pixels", "error"]
        for batch in batches:
            made, size = [], 0
            for r in batch.itertuples(index=False):
                row = dict.fromkeys(names) | {"filename": r.filename}
                try:
                    row |= payload_of(decode(bytes(r.content or b"")))
                except ValueError as e:
                    row["error"] = str(e)
                if not pixels:
                    row["pixels"] = None
                made.append(row)
                size += len(row["pixels"] or b"") + 500
                if size >= FRAME_BYTES:
                    yield pd.DataFrame(made, columns=names)
                    made, size = [], 0
            if made:
                yield pd.DataFrame(made, columns=names)

    return files.select("filename", "content").mapInPandas(run, f"filename string, {PAYLOAD}, error string")


def read_images(spark: SparkSession, folder: str, pixels: bool = True) -> DataFrame:
    """The image files of a folder as decode_files gives them, subfolders left out; JPEG by Spark's image source."""
    ending = F.lower(F.element_at(F.split("filename", r"\."), -1))
    name = lambda path: F.element_at(F.split(path, "/"), -1).alias("filename")
    files = spark.read.format("binaryFile").load(folder).select(name("path"), "content")
    own = decode_files(files.where(ending.isin(*[e for e in EXTENSIONS if e not in ("jpg", "jpeg")]) & F.col("filename").contains(".")), pixels)
    image = spark.read.format("image").option("pathGlobFilter", "*.{jpg,jpeg,JPG,JPEG,Jpg,Jpeg}").load(folder).select("image.*").withColumn("filename", name("origin"))

    def to_rgb(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                if r.height <= 0:
                    yield pd.DataFrame([{"filename": r.filename, **dict.fromkeys(("height", "width", "channels", "dtype", "pixels")), "error": "damaged JPEG"}])
                    continue
                a = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels)
                made = payload_of(a[..., 0] if r.nChannels == 1 else np.ascontiguousarray(a[..., [2, 1, 0]]))
                yield pd.DataFrame([{"filename": r.filename, **made, "error": None} | ({} if pixels else {"pixels": None})])

    jpeg = image.select("filename", "height", "width", "nChannels", "data").mapInPandas(to_rgb, f"filename string, {PAYLOAD}, error string")
    return own.unionByName(jpeg)


def encode_png(image: np.ndarray, filter_of_row: int | None = None) -> bytes:
    """An image of 8 or 16 bits as PNG, all rows with one filter, or each row with the next; for tests and proxies of files."""
    a = image if image.ndim == 3 else image[..., None]
    colour = {1: 0, 2: 4, 3: 2, 4: 6}[a.shape[2]]
    flat = np.frombuffer(a.astype(a.dtype.newbyteorder(">")).tobytes(), np.uint8).reshape(a.shape[0], -1)
    step = a.shape[2] * a.dtype.itemsize
    wide = np.pad(flat, ((1, 0), (step, 0))).astype(np.int16)
    left, up, corner = wide[1:, :-step], wide[:-1, step:], wide[:-1, :-step]
    guess = left + up - corner
    x, y, z = np.abs(guess - left), np.abs(guess - up), np.abs(guess - corner)
    paeth = np.where((x <= y) & (x <= z), left, np.where(y <= z, up, corner))
    ahead = np.stack([np.zeros_like(left), left, up, (left + up) >> 1, paeth])
    kind = np.arange(len(flat)) % 5 if filter_of_row is None else np.full(len(flat), filter_of_row)
    lines = (flat - ahead[kind, np.arange(len(flat))]).astype(np.uint8)
    body = zlib.compress(np.concatenate([kind[:, None].astype(np.uint8), lines], axis=1).tobytes(), 1)
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return _PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8 * a.dtype.itemsize, colour, 0, 0, 0)) + chunk(b"IDAT", body) + chunk(b"IEND", b"")
