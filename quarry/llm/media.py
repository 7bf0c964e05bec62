"""Media columns: Netpbm and BMP images as numpy arrays, NPY tiles and difference hashes."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import chunks

_TOKEN = re.compile(rb"(?:\s|#[^\n]*\n)*([^\s#]+)")


def encode_pgm(samples: np.ndarray) -> bytes:
    """An 8-bit greyscale array as binary PGM."""
    return b"P5\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + np.ascontiguousarray(samples, dtype=np.uint8).tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """An 8-bit greyscale array as BMP with a grey palette; rows from the bottom, padded to four bytes."""
    height, width = samples.shape
    rows = np.zeros((height, (width + 3) // 4 * 4), np.uint8)
    rows[:, :width] = samples[::-1]
    palette = np.zeros((256, 4), np.uint8)
    palette[:, :3] = np.arange(256)[:, None]
    start = 14 + 40 + palette.size
    head = struct.pack("<2sIHHI", b"BM", start + rows.size, 0, 0, start)
    return head + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8, 0, rows.size, 2835, 2835, 256, 0) + palette.tobytes() + rows.tobytes()


def decode_netpbm(blob: bytes) -> np.ndarray:
    """P1 to P6 as an array of height x width (x 3); bitmaps give 0 for black, 1 for white."""
    kind, at, head = blob[:2], 2, []
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not a Netpbm image")
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        if not (m := _TOKEN.match(blob, at)):
            raise ValueError("truncated Netpbm header")
        head.append(int(m[1]))
        at = m.end()
    width, height, most = head[0], head[1], head[2] if len(head) > 2 else 1
    if width < 1 or height < 1 or not 0 < most < 65536:
        raise ValueError("empty Netpbm image")
    depth = 3 if kind in (b"P3", b"P6") else 1
    count = width * height * depth
    if kind == b"P1":
        flat = np.frombuffer(re.sub(rb"#[^\n]*|\s", b"", blob[at:]), np.uint8)[:count] - 48
    elif kind in (b"P2", b"P3"):
        flat = np.array(re.sub(rb"#[^\n]*", b"", blob[at:]).split()[:count], dtype=np.uint16)
    elif kind == b"P4":
        rows = np.frombuffer(blob, np.uint8, height * -(-width // 8), at + 1).reshape(height, -1)
        flat = np.unpackbits(rows, axis=1)[:, :width].ravel()
    else:
        flat = np.frombuffer(blob, ">u2" if most > 255 else np.uint8, count, at + 1)
    if len(flat) != count:
        raise ValueError("truncated Netpbm data")
    if kind in (b"P1", b"P4"):
        flat = 1 - flat
    return flat.reshape((height, width, 3) if depth == 3 else (height, width))


def decode_bmp(blob: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 (palette), 24 or 32 bits as height x width x 3 (red, green, blue)."""
    if blob[:2] != b"BM":
        raise ValueError("not a BMP image")
    start, head = (int.from_bytes(blob[i : i + 4], "little") for i in (10, 14))
    width, height = (int.from_bytes(blob[i : i + 4], "little", signed=True) for i in (18, 22))
    bits, packing, colours = int.from_bytes(blob[28:30], "little"), int.from_bytes(blob[30:34], "little"), int.from_bytes(blob[46:50], "little")
    if packing not in (0, 3) or bits not in (8, 24, 32) or width < 1 or height == 0:
        raise ValueError("unsupported BMP form")
    stride = (width * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(blob, np.uint8, abs(height) * stride, start).reshape(abs(height), stride)[:, : width * bits // 8]
    rows = rows[::-1] if height > 0 else rows
    if bits == 8:
        palette = np.frombuffer(blob, np.uint8, (colours or 256) * 4, 14 + head).reshape(-1, 4)
        return palette[rows][:, :, 2::-1]
    return rows.reshape(abs(height), width, bits // 8)[:, :, 2::-1]


def decode(blob: bytes) -> np.ndarray:
    return decode_bmp(blob) if blob[:2] == b"BM" else decode_netpbm(blob)


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else (image.astype(np.float64) @ np.array([0.299, 0.587, 0.114]))


def _at(integral: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Rows of an integral image at fractional heights."""
    low = np.minimum(edges.astype(np.int64), len(integral) - 2)
    part = (edges - low)[:, None]
    return integral[low] * (1 - part) + integral[low + 1] * part


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of each target cell's area, from the integral image; cells may cut source pixels."""
    h, w = image.shape
    integral = np.zeros((h + 1, w + 1))
    np.cumsum(image, axis=0, out=integral[1:, 1:])
    np.cumsum(integral, axis=1, out=integral)
    s = _at(_at(integral, np.linspace(0, h, height + 1)).T, np.linspace(0, w, width + 1)).T
    return np.diff(np.diff(s, axis=0), axis=1) * (height * width / (h * w))


def difference_hash(image: np.ndarray) -> str:
    """64 bits: whether each of 8 x 8 cells is darker than its right neighbour, as 16 hex digits."""
    tile = np.round(area_resize(grey(image), 8, 9), 6)
    return np.packbits(tile[:, :-1] < tile[:, 1:]).tobytes().hex()


def npy_tile(image: np.ndarray, side: int = 32) -> bytes:
    """The area-resized greyscale tile as an NPY file."""
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(area_resize(grey(image), side, side)), 0, 65535).astype(np.uint8 if image.dtype == np.uint8 else np.uint16))
    return out.getvalue()


def media_columns(images: DataFrame, column: str = "media", key: str = "id", side: int = 32) -> DataFrame:
    """Decode a binary column: the key (named ``key`` if its own name is one of the others'), height, width, npy (the tile's file) and dhash.

    A null, empty, zero-sized or undecodable image gives nulls in all but the key; repeated rows
    repeat; empty tables give none; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for blob in b.column(1):
                try:
                    image = decode(blob.as_py() or b"")
                    rows.append((image.shape[0], image.shape[1], npy_tile(image, side), difference_hash(image)))
                except (ValueError, IndexError, OverflowError):
                    rows.append((None, None, None, None))
            cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.string())], names=["key", "height", "width", "npy", "dhash"])

    kind = images.schema[key].dataType.simpleString()
    fields = ("height", "width", "npy", "dhash")
    out = images.select(F.col(f"`{key}`").alias("key"), F.col(f"`{column}`").alias("media")).mapInArrow(run, f"key {kind}, height int, width int, npy binary, dhash string")
    return out if key in fields else out.withColumnRenamed("key", key)


def text_media(docs: DataFrame, width: int = 64, side: int = 32) -> DataFrame:
    """Each whole text stored losslessly as a greyscale PGM ``width`` samples wide, read back and described.

    The payload is the UTF-8 bytes with zeros up to a positive multiple of ``width``. Features
    are the difference hash and the mean of the decoded samples. ``bmp_sha256`` is the digest of the same samples as a BMP
    file, which is read back too and must give the same payload; ``npy_sha256`` that of the area-resized tile's NPY file. Nulls: a null text is empty
    (one row of zeros), a null doc_id is kept. Rows are independent: repeated rows give equal
    values, empty tables none, other columns are ignored.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "bmp_sha256", "npy_sha256"]
    text = ("payload_sha256", "media_sha256", "feature", "bmp_sha256", "npy_sha256")
    fields = pa.schema([(f, pa.string() if f in text else pa.int64()) for f in names])
    sha = lambda blob: hashlib.sha256(blob).hexdigest()

    def row(data: np.ndarray) -> tuple:
        samples = np.zeros((max(1, -(-len(data) // width)), width), np.uint8)
        samples.reshape(-1)[: len(data)] = data
        media, bmp = encode_pgm(samples), encode_bmp(samples)
        back = decode_netpbm(media)
        if not np.array_equal(decode_bmp(bmp)[:, :, 0], back):
            raise ValueError("BMP and PGM forms differ")
        payload = back.tobytes()
        return len(data), len(payload), sha(payload), zlib.crc32(payload[-64:]), len(media), sha(media), f"{difference_hash(back)}:{back.mean():.4f}", sha(bmp), sha(npy_tile(back, side))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [row(data[lo:hi]) for _, _, data, offs in chunks(b.column(1)) for lo, hi in zip(offs[:-1], offs[1:], strict=True)]
            cols = list(zip(*rows, strict=True)) or [()] * (len(names) - 1)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, f.type) for f, c in zip(list(fields)[1:], cols, strict=True)]], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, ", ".join(f"{f} {'string' if f in text else 'long'}" for f in names))


def query(spark, sf_dir: str) -> DataFrame:
    """op9: every text of ``documents`` as a PGM image."""
    return text_media(spark.read.parquet(f"{sf_dir}/documents.parquet"))
