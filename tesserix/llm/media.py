"""Media columns: Netpbm and BMP to numpy arrays, area resize by integral images, NPY tiles, difference hashes.

decode() reads PBM, PGM and PPM (plain and raw, 8 or 16 bits) and uncompressed BMP (1, 4, 8, 24
and 32 bits). Everything works on one row at a time in Arrow batches, so memory is bounded by the
largest image and its bytes; integral images are summed up in slices.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table, utf8
from .textkit import flat

#: Payloads are padded to a multiple of this, an image is this wide, and a payload has this many bytes in a row of it.
BLOCK, WIDTH = 576, 24
#: Sums of an integral image that are held at a time, and the side of the query's tiles.
SLICE, TILE = 1 << 18, 16
_TOKEN = re.compile(rb"(?:\s|#[^\r\n]*[\r\n])*([^\s#]+)")


def encode_pgm(samples: np.ndarray) -> bytes:
    """A raw PGM of 8-bit samples (height, width)."""
    height, width = samples.shape
    return b"P5\n%d %d\n255\n" % (width, height) + samples.tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """A BMP of 24 bits from (height, width, 3) in RGB."""
    height, width, _ = samples.shape
    row = np.zeros((height, -(-width * 3 // 4) * 4), np.uint8)
    row[:, : width * 3] = samples[::-1, :, ::-1].reshape(height, -1)
    return b"BM" + struct.pack("<IHHI", 54 + row.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, row.size, 2835, 2835, 0, 0) + row.tobytes()


def _netpbm(data: bytes) -> np.ndarray:
    kind, at, fields = data[1] - 48, 2, []
    for _ in range(2 if kind in (1, 4) else 3):
        m = _TOKEN.match(data, at)
        if not m:
            raise ValueError("a Netpbm header ends early")
        fields.append(int(m[1]))
        at = m.end()
    width, height, top = (*fields, 1)[:3]
    depth = 3 if kind in (3, 6) else 1
    n = width * height * depth
    if not 0 < top < 65536:
        raise ValueError("a Netpbm maximum is from 1 to 65535")
    if kind == 4:
        bits = np.unpackbits(np.frombuffer(data, np.uint8, -(-width // 8) * height, at + 1).reshape(height, -1), axis=1)
        out = 1 - bits[:, :width]
    elif kind in (5, 6):
        out = np.frombuffer(data, np.uint8 if top < 256 else ">u2", n, at + 1)
    else:
        rest = re.sub(rb"#[^\r\n]*", b"", data[at:])
        out = np.array(list(re.sub(rb"\s", b"", rest)) if kind == 1 else rest.split(), np.int64)[:n]
        out = 49 - out if kind == 1 else out
    if out.size != n:
        raise ValueError("a Netpbm image ends early")
    out = out.reshape((height, width, depth) if depth > 1 else (height, width))
    return out.astype(np.uint8) if top in (1, 255) and kind not in (1, 4) else (out.astype(np.int64) * 255 // top).astype(np.uint8)


def _bmp(data: bytes) -> np.ndarray:
    start, header, width, height, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if packed not in (0, 3) or packed == 3 and bits != 32 or bits not in (1, 4, 8, 24, 32):
        raise ValueError("this kind of BMP is not read")
    rows, stride = abs(height), -(-width * bits // 32) * 4
    raw = np.frombuffer(data, np.uint8, stride * rows, start).reshape(rows, stride)
    if bits >= 24:
        out = raw[:, : width * bits // 8].reshape(rows, width, bits // 8)[:, :, 2::-1]
    else:
        index = np.unpackbits(raw, axis=1).reshape(rows, -1, bits) @ (1 << np.arange(bits - 1, -1, -1))
        colours = np.frombuffer(data, np.uint8, (start - 14 - header) // 4 * 4, 14 + header).reshape(-1, 4)
        out = colours[index[:, :width], 2::-1]
    return np.ascontiguousarray(out[::-1] if height > 0 else out)


def decode(data: bytes) -> np.ndarray:
    """8-bit samples: (height, width) for grey, (height, width, 3) for colours."""
    if data[:2] == b"BM":
        return _bmp(data)
    if len(data) > 2 and data[:1] == b"P" and data[1:2] in b"123456":
        return _netpbm(data)
    raise ValueError("neither Netpbm nor BMP")


def _means(image: np.ndarray, n: int) -> np.ndarray:
    """The first axis resized to n means, from the integral image at the places where the new samples meet; it is summed up a slice at a time."""
    old, rest = len(image), image.shape[1:]
    at = np.arange(n + 1) * old / n
    low = np.minimum(at.astype(int), old - 1)
    part = (at - low).reshape(-1, *[1] * len(rest))
    step = max(1, SLICE // max(1, int(np.prod(rest))))
    below, above, total = np.zeros((n + 1, *rest)), np.zeros((n + 1, *rest)), np.zeros((1, *rest))
    for first in range(0, old, step):
        sums = np.concatenate((total, total + np.cumsum(image[first : first + step], axis=0, dtype=np.float64)))
        here = (low >= first) & (low < first + step)
        below[here], above[here] = sums[low[here] - first], sums[low[here] - first + 1]
        total = sums[-1:]
    return np.diff(below * (1 - part) + above * part, axis=0) * (n / old)


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over the areas that the new samples cover, from integral images; fractions of samples count.

    The longer axis goes first, so the working memory is SLICE sums and what is left of the shorter axis.
    """
    for axis in sorted((0, 1), key=lambda a: -image.shape[a]):
        image = _means(np.swapaxes(image, 0, axis), (height, width)[axis]).swapaxes(0, axis)
    return image


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else image.mean(axis=2)


def difference_hash(image: np.ndarray, side: int = 8) -> str:
    """Whether brightness rises from left to right, in side x side places: hex digits."""
    small = np.round(grey(area_resize(image, side, side + 1)), 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy(image: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, np.ascontiguousarray(image), allow_pickle=False)
    return out.getvalue()


def tiles_of(image: np.ndarray, side: int = 32) -> np.ndarray:
    """8-bit means; they are rounded to 6 decimals first, so that halves don't hang on the order of a sum."""
    return np.clip(np.rint(np.round(area_resize(image, side, side), 6)), 0, 255).astype(np.uint8)


def image_features(df: DataFrame, media: str, side: int = 32) -> DataFrame:
    """df with height, width, tile (NPY bytes, side x side) and dhash of the image in the binary column media.

    Null or unreadable media have nulls there; other columns are kept, and those of these names replaced.
    """
    df = df.drop("height", "width", "tile", "dhash")
    kept = df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(batch.schema.get_field_index(media)):
                try:
                    image = decode(value.as_py() or b"")
                    rows.append((*image.shape[:2], npy(tiles_of(image, side)), difference_hash(image)))
                except (ValueError, IndexError, struct.error):
                    rows.append((None,) * 4)
            new = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, t) for c, t in zip(new, (pa.int32(), pa.int32(), pa.binary(), pa.string()), strict=True)]], names=[*batch.schema.names, "height", "width", "tile", "dhash"])

    return df.mapInArrow(run, ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept) + ", height int, width int, tile binary, dhash string")


def to_media(payload: bytes) -> bytes:
    """An image whose samples are the payload, WIDTH bytes in a row: a PGM, or a BMP of WIDTH / 3 pixels where the payload's CRC-32 is odd."""
    samples = np.frombuffer(payload, np.uint8)
    return encode_bmp(samples.reshape(-1, WIDTH // 3, 3)) if zlib.crc32(payload) % 2 else encode_pgm(samples.reshape(-1, WIDTH))


def store(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): every text's UTF-8, padded with 255 to a positive multiple of BLOCK, as an image. A null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = flat(batch.column(1))
            raw = data.tobytes()
            sizes = np.diff(at)
            for i in range(0, len(sizes), 256):
                own = [raw[at[k] : at[k + 1]] for k in range(i, min(i + 256, len(sizes)))]
                media = [to_media(x.ljust(max(1, -(-len(x) // BLOCK)) * BLOCK, b"\xff")) for x in own]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 256), pa.array(sizes[i : i + 256]), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), utf8(F.col(text)).alias("data")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def digests(df: DataFrame, side: int = TILE) -> DataFrame:
    """From (doc_id, n_bytes, media), the payload read back from the stored bytes and what is computed of it, with the image's NPY tile."""
    types = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "media_type": pa.string(), "tile": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(2):
                media = value.as_py()
                image = decode(media)
                payload = image.tobytes()
                kind = "image/bmp" if media[:2] == b"BM" else "image/x-portable-graymap"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), difference_hash(image), kind, npy(tiles_of(image, side))))
            new = list(zip(*rows, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, new, types.values())], names=["doc_id", "n_bytes", *types])

    schema = ", ".join(f"{n} {dict(int64='long', string='string', binary='binary')[str(t)]}" for n, t in types.items())
    return df.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id long, n_bytes long, {schema}")


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The figures of every document, of any length or none, stored as an image, read back, and made into a tile.

    Media and tiles are tables in the shared folder; tile_sha256 is of a tile's NPY bytes as read back. Rows with
    one text have the same values, repeated rows and ids stay as they are, and an empty table has no rows.
    """
    media = stored(store(table(spark, sf_dir, "documents")), codec="zstd")
    return stored(digests(media), codec="zstd").withColumn("tile_sha256", F.sha2("tile", 256)).drop("tile")
