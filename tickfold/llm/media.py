"""Media columns: Netpbm and BMP files as numpy arrays, area-resized tiles, difference hashes."""

from __future__ import annotations

import io
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches, texts, utf8

#: Bytes of a row of 64 colour samples, to which a text's payload is padded.
ROW, WIDTH = 192, 64
#: Rows that a kernel hands on at once.
BATCH = 256
_SPACE = re.compile(rb"(?:\s|#[^\r\n]*[\r\n])*(\d+)")


def encode_ppm(pixels: np.ndarray) -> bytes:
    """A colour array (height, width, 3) of bytes as binary Netpbm."""
    h, w, _ = pixels.shape
    return b"P6\n%d %d\n255\n" % (w, h) + pixels.tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """A colour array as an uncompressed 24-bit BMP, bottom row first."""
    h, w, _ = pixels.shape
    stride = -(-w * 3 // 4) * 4
    rows = np.zeros((h, stride), np.uint8)
    rows[:, : w * 3] = pixels[::-1, :, ::-1].reshape(h, w * 3)
    head = struct.pack("<2sIHHI", b"BM", 54 + rows.size, 0, 0, 54)
    return head + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def _netpbm(data: bytes) -> np.ndarray:
    kind, at, numbers = data[1] - 48, 2, []
    for _ in range(2 if kind in (1, 4) else 3):
        m = _SPACE.match(data, at)
        numbers.append(int(m[1]))
        at = m.end()
    w, h, top = numbers[0], numbers[1], (numbers[2] if len(numbers) > 2 else 1)
    bands = 3 if kind in (3, 6) else 1
    if not (0 < w and 0 < h and 0 < top < 65536):
        raise ValueError("size out of range")
    if kind == 1:
        body = re.sub(rb"#[^\r\n]*", b"", data[at:])
        samples = np.frombuffer(re.sub(rb"[^01]", b"", body), np.uint8)[: w * h] - 48
    elif kind in (2, 3):
        samples = np.array(re.sub(rb"#[^\r\n]*", b"", data[at:]).split()[: w * h * bands], np.int64)
    elif kind == 4:
        packed = np.frombuffer(data, np.uint8, -(-w // 8) * h, at + 1).reshape(h, -1)
        samples = np.unpackbits(packed, axis=1)[:, :w]
    else:
        samples = np.frombuffer(data, np.uint8 if top < 256 else ">u2", w * h * bands, at + 1)
    samples = samples.reshape(h, w, bands)
    if kind in (1, 4):
        samples = 1 - samples  # 1 is black
    if top != 255:
        samples = np.rint(samples.astype(np.float64) * 255 / top)
    return samples.astype(np.uint8)


def _bmp(data: bytes) -> np.ndarray:
    offset, head = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<I", data, 14)[0]
    w, h, _, bits, packed = struct.unpack_from("<iiHHI", data, 18)
    if packed or bits not in (1, 4, 8, 24, 32) or w <= 0 or h == 0:
        raise ValueError("not an uncompressed BMP")
    stride = -(-w * bits // 32) * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(h), offset).reshape(abs(h), stride)
    rows = rows[::-1] if h > 0 else rows
    if bits >= 24:
        return rows[:, : w * bits // 8].reshape(abs(h), w, bits // 8)[:, :, 2::-1]
    used = struct.unpack_from("<I", data, 46)[0] or 1 << bits
    palette = np.frombuffer(data, np.uint8, used * 4, 14 + head).reshape(-1, 4)[:, 2::-1]
    bit = np.unpackbits(rows, axis=1)[:, : w * bits].reshape(abs(h), w, bits)
    return palette[bit @ (1 << np.arange(bits)[::-1])]


def decode(data: bytes) -> np.ndarray:
    """A Netpbm (P1 to P6) or BMP file as an array (height, width, 1 or 3) of bytes."""
    if re.match(rb"P[1-6]\s", data[:3]):
        return _netpbm(data)
    if data[:2] == b"BM":
        return _bmp(data)
    raise ValueError("neither Netpbm nor BMP")


def resized(gray: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Area means of ``gray`` on a grid: differences of its integral image, which is linear between pixels."""
    h, w = gray.shape
    whole = np.zeros((h + 1, w + 1))
    whole[1:, 1:] = gray.cumsum(0, dtype=np.float64).cumsum(1)

    def at(table: np.ndarray, n: int, size: int) -> np.ndarray:
        place = np.arange(n + 1) * size / n
        low = np.minimum(place.astype(np.int64), size - 1)
        part = (place - low)[:, None]
        return table[low] * (1 - part) + table[low + 1] * part

    grid = at(at(whole, rows, h).T, columns, w).T
    return np.diff(np.diff(grid, axis=0), axis=1) / (h / rows * (w / columns))


def luminance(pixels: np.ndarray) -> np.ndarray:
    return pixels[:, :, 0].astype(np.float64) if pixels.shape[2] == 1 else pixels.astype(np.float64) @ np.array([0.299, 0.587, 0.114])


def difference_hash(gray: np.ndarray) -> str:
    """64 bits as hex: whether each of 8 x 9 area means exceeds its left neighbour."""
    grid = np.round(resized(gray, 8, 9), 6)
    return np.packbits(grid[:, 1:] > grid[:, :-1]).tobytes().hex()


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    return out.getvalue()


def _encode(kind: str):
    write = {"ppm": encode_ppm, "bmp": encode_bmp}[kind]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                texts = [t or b"" for t in utf8(batch, "text")]
                media = []
                for t in texts:
                    padded = t.ljust(max(1, -(-len(t) // ROW)) * ROW)
                    media.append(write(np.frombuffer(padded, np.uint8).reshape(-1, WIDTH, 3)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"]
                )

    return kernel


def texts_as_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", kind: str = "ppm") -> DataFrame:
    """Per row: n_bytes of the text's UTF-8 (null: 0), and media, a file (ppm or bmp) of 64 pixels a row
    that holds it, padded with spaces to a positive multiple of 192 bytes."""
    base = texts(df, id_col, text_col)
    made = base.mapInArrow(_encode(kind), f"id {dict(base.dtypes)['id']}, n_bytes long, media binary")
    return made.withColumnRenamed("id", id_col)


def _decode(side: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                rows = []
                for data in batch.column(batch.schema.get_field_index("media")).to_pylist():
                    try:
                        pixels = decode(data or b"")
                    except (ValueError, AttributeError, IndexError, TypeError, struct.error):
                        rows.append((None,) * 5)
                        continue
                    gray = luminance(pixels)
                    tile = np.rint(resized(gray, side, side)).astype(np.uint8)
                    rows.append((pixels.shape[1], pixels.shape[0], pixels.tobytes(), npy(tile), difference_hash(gray)))
                made = [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "width", "height", "samples", "tile", "dhash"])

    return kernel


def decode_media(df: DataFrame, media_col: str = "media", side: int = 16) -> DataFrame:
    """``df`` with width, height, samples (rows from the top, RGB or gray bytes), tile (a gray NPY file of
    side x side area means) and dhash of each file. A null, empty, broken or foreign file gives nulls.

    Existing columns stay; those with the names of new ones are replaced.
    """
    small_batches(df.sparkSession)
    new = ["width", "height", "samples", "tile", "dhash"]
    base = df.drop(*new).withColumnRenamed(media_col, "media")
    shape = ", ".join(f"`{n}` {t}" for n, t in base.dtypes)
    made = base.mapInArrow(_decode(side), f"{shape}, width int, height int, samples binary, tile binary, dhash string")
    return made.withColumnRenamed("media", media_col)
