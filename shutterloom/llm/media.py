"""Media columns: Netpbm and BMP images decoded to numpy arrays, resized by area, kept as NPY tiles with difference hashes."""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

#: Bytes of a row of 64 RGB samples; payloads are padded to a multiple.
ROW = 192
TILE = 32
#: Samples of a band of rows that are summed at once.
BAND = 1 << 18


def encode_ppm(image: np.ndarray) -> bytes:
    """Binary Netpbm of uint8 samples: P6 for (h, w, 3), P5 for (h, w)."""
    h, w = image.shape[:2]
    kind = b"P6" if image.ndim == 3 else b"P5"
    return b"%s\n%d %d\n255\n" % (kind, w, h) + np.ascontiguousarray(image, np.uint8).tobytes()


def _header(data: bytes, count: int) -> tuple[list[int], int]:
    """`count` numbers after the magic, comments skipped, and where the samples start."""
    numbers, at = [], 2
    while len(numbers) < count:
        while at < len(data) and (data[at : at + 1].isspace() or data[at : at + 1] == b"#"):
            if data[at : at + 1] == b"#":
                end = data.find(b"\n", at)
                at = len(data) if end < 0 else end
            at += 1
        end = at
        while end < len(data) and data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("a number is missing in the header")
        numbers.append(int(data[at:end]))
        at = end
    return numbers, at + 1


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as uint8 or uint16 of shape (h, w) or (h, w, 3); bitmaps have 0 for black and 255 for white."""
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not a Netpbm image")
    bitmap, plain = kind in (b"P1", b"P4"), kind < b"P4"
    numbers, at = _header(data, 2 if bitmap else 3)
    w, h, top = (*numbers, 1) if bitmap else numbers
    if not 0 < top < 65536:
        raise ValueError("the largest sample is out of range")
    shape = (h, w, 3) if kind in (b"P3", b"P6") else (h, w)
    count = int(np.prod(shape))
    if kind == b"P4":
        per = (w + 7) // 8
        bits = np.unpackbits(np.frombuffer(data, np.uint8, per * h, at).reshape(h, per), axis=1)[:, :w]
        return np.where(bits, 0, 255).astype(np.uint8)
    if plain:
        rest = b"\n".join(x.split(b"#")[0] for x in data[at:].split(b"\n"))
        found = list(rest.replace(b" ", b"").replace(b"\n", b"").replace(b"\t", b"").replace(b"\r", b"")) if kind == b"P1" else rest.split()
        if len(found) < count:
            raise ValueError("samples are missing")
        values = np.array([x - 48 for x in found[:count]] if kind == b"P1" else [int(x) for x in found[:count]])
        values = np.where(values, 0, 255) if kind == b"P1" else values
        return values.reshape(shape).astype(np.uint8 if top < 256 else np.uint16)
    return np.frombuffer(data, np.uint8 if top < 256 else ">u2", count, at).reshape(shape).astype(np.uint8 if top < 256 else np.uint16, copy=False)


def encode_bmp(image: np.ndarray) -> bytes:
    """A 24-bit BMP of (h, w, 3) uint8."""
    h, w = image.shape[:2]
    per = (3 * w + 3) // 4 * 4
    rows = np.zeros((h, per), np.uint8)
    rows[:, : 3 * w] = image[::-1, :, ::-1].reshape(h, 3 * w)
    size = per * h
    return struct.pack("<2sIHHI", b"BM", 54 + size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, size, 2835, 2835, 0, 0) + rows.tobytes()


def _by_masks(pixels: np.ndarray, masks: tuple[int, ...]) -> np.ndarray:
    """The channels that bit masks pick of each pixel, brought to 0 to 255."""
    out = np.empty((*pixels.shape, len(masks)), np.uint8)
    for n, mask in enumerate(masks):
        low = (mask & -mask).bit_length() - 1 if mask else 0
        top = mask >> low
        if top & (top + 1):
            raise ValueError("a mask with a gap")
        value = (pixels.astype(np.uint64) & np.uint64(mask)) >> np.uint64(low)
        out[..., n] = np.rint(value * (255.0 / top)) if top else 0
    return out


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 (with palette), 16, 24 or 32 bits as (h, w, 3) uint8; 16 and 32 bits may have bit-field masks."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not a BMP image")
    start, head, w, h, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if packed not in (0, 3) or bits not in (8, 16, 24, 32) or w <= 0 or h == 0 or (packed == 3 and bits not in (16, 32)):
        raise ValueError("a kind of BMP that isn't read")
    per = (w * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, per * abs(h), start).reshape(abs(h), per)[:, : w * bits // 8]
    rows = rows[::-1] if h > 0 else rows
    if bits == 8:
        palette = np.frombuffer(data[14 + head : start], np.uint8).reshape(-1, 4)
        return palette[rows][:, :, 2::-1]
    if packed == 3 or bits == 16:
        # The masks stand behind the 40 bytes of the header, or are its next fields.
        masks = struct.unpack_from("<3I", data, 54) if packed == 3 else (0x7C00, 0x03E0, 0x001F)
        return _by_masks(np.ascontiguousarray(rows).view("<u2" if bits == 16 else "<u4"), masks)
    return rows.reshape(abs(h), w, bits // 8)[:, :, 2::-1]


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def largest_sample(data: bytes) -> int:
    """What a sample of the encoded image is at most: 255 but for Netpbm that says otherwise."""
    return _header(data, 3)[0][2] if data[:2] in (b"P2", b"P3", b"P5", b"P6") else 255


def area_resizes(image: np.ndarray, sizes: list[tuple[int, int]]) -> list[np.ndarray]:
    """The image in each of the sizes (height, width): a cell is the mean over its area, pixels cut by its edges counting in part; from one integral image.

    The integral image is made a band of rows at a time, and only its values at the cells' edges are kept.
    """
    flat = image.reshape(image.shape[0], image.shape[1], -1)
    h, w, c = flat.shape

    def edges(n: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.linspace(0, n, cells + 1)
        low = np.minimum(at.astype(np.int64), n - 1)
        return low, at - low

    grids = [(*edges(h, height), *edges(w, width), np.zeros((height + 1, width + 1, c))) for height, width in sizes]
    above, step = np.zeros((w + 1, c)), max(1, BAND // (w * c))
    for at in range(0, h, step):
        band = flat[at : at + step]
        whole = np.zeros((len(band) + 1, w + 1, c))
        np.cumsum(band, 0, np.float64, whole[1:, 1:])
        np.cumsum(whole[1:, 1:], 1, out=whole[1:, 1:])
        whole += above
        above = whole[-1].copy()
        for row, row_part, column, column_part, sums in grids:
            own = np.flatnonzero((row >= at) & (row < at + len(band)))
            low, part = row[own] - at, row_part[own, None, None]
            lines = whole[low] * (1 - part) + whole[low + 1] * part
            sums[own] = lines[:, column] * (1 - column_part[:, None]) + lines[:, column + 1] * column_part[:, None]
    out = []
    for (height, width), (*_, sums) in zip(sizes, grids, strict=True):
        cells = np.diff(np.diff(sums, axis=0), axis=1) / ((h / height) * (w / width))
        out.append(cells[:, :, 0] if image.ndim == 2 else cells)
    return out


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    return area_resizes(image, [(height, width)])[0]


#: Cells of the image that a difference hash compares: 8 rows of 9.
HASH_SIZE = (8, 9)


def _hash_of(cells: np.ndarray) -> int:
    if cells.ndim == 3:
        cells = cells @ np.array([0.299, 0.587, 0.114])
    # Rounded, so that a difference in the last bits of a sum decides nothing.
    cells = np.round(cells, 6)
    return int.from_bytes(np.packbits(cells[:, :-1] < cells[:, 1:]).tobytes(), "big")


def _tile_of(cells: np.ndarray, largest: int) -> bytes:
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(cells * (255 / largest) if largest != 255 else cells), 0, 255).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


def difference_hash(image: np.ndarray) -> int:
    """64 bits: whether each of 8 x 8 cells is darker than the next to its right, in the luma of an 8 x 9 area-resized image."""
    return _hash_of(area_resize(image, *HASH_SIZE))


def npy_tile(image: np.ndarray, side: int = TILE, largest: int = 255) -> bytes:
    """The image resized to side x side, its largest possible sample brought to 255, as the bytes of an NPY file of uint8."""
    return _tile_of(area_resize(image, side, side), largest)


_KINDS = [("width", "int", pa.int32()), ("height", "int", pa.int32()), ("channels", "int", pa.int32()), ("sample_bytes", "bigint", pa.int64()), ("samples_sha256", "string", pa.string()), ("tail_crc32", "bigint", pa.int64()), ("dhash", "string", pa.string()), ("tile", "binary", pa.binary()), ("error", "string", pa.string())]


def features(data: bytes | None) -> dict:
    """What media_features reports of one image."""
    row: dict = dict.fromkeys(name for name, _, _ in _KINDS)
    if data is None:
        return row
    try:
        image = decode(data)
        if not image.size:
            raise ValueError("no samples")
    except (ValueError, struct.error, IndexError) as e:
        return row | {"error": str(e)}
    samples = image.tobytes()
    shape = {"height": image.shape[0], "width": image.shape[1], "channels": 3 if image.ndim == 3 else 1}
    sums = {"sample_bytes": len(samples), "samples_sha256": hashlib.sha256(samples).hexdigest(), "tail_crc32": zlib.crc32(samples[-16:])}
    small, tile = area_resizes(image, [HASH_SIZE, (TILE, TILE)])
    return row | shape | sums | {"dhash": f"{_hash_of(small):016x}", "tile": _tile_of(tile, largest_sample(data))}


def _features(media: pa.Array) -> pa.Array:
    return pa.array([features(x.as_py()) for x in media], pa.struct([(name, kind) for name, _, kind in _KINDS]))


def media_features(rows: DataFrame, media: str = "media", to: str = "features") -> DataFrame:
    """rows with a struct `to`: size, checksums of the samples, difference hash and NPY tile of the image bytes in column `media`.

    A null image has a struct of nulls; bytes that are no image have nulls and an error. No shuffle.
    """
    return rows.withColumn(to, F.arrow_udf(_features, "struct<" + ",".join(f"{name}:{kind}" for name, kind, _ in _KINDS) + ">")(F.col(media)))


def write_tiles(rows: DataFrame, folder: str, id: str, media: str = "media") -> DataFrame:
    """Writes (id, dhash, tile) of all images of rows as Parquet in the folder, a tile being the bytes of an NPY file, and reads them back.

    Images that can't be read, and null ones, have no row; repeated rows have one each. load_tile() makes an array of a tile.
    """
    made = media_features(rows.select(F.col(id), F.col(media).alias("media"))).where("features.tile is not null")
    made.select(id, "features.dhash", "features.tile").write.parquet(folder)
    return rows.sparkSession.read.parquet(folder)


def load_tile(tile: bytes) -> np.ndarray:
    return np.load(io.BytesIO(tile), allow_pickle=False)


def text_image(text: str | None) -> bytes:
    """A P6 image of 64 columns whose samples are the text's UTF-8 bytes, padded with spaces to whole rows, one at least."""
    body = (text or "").encode("utf-8", "surrogatepass")
    payload = body + b" " * (max(1, -(-len(body) // ROW)) * ROW - len(body))
    return encode_ppm(np.frombuffer(payload, np.uint8).reshape(-1, ROW // 3, 3))


def _text_images(text: pa.Array) -> pa.Array:
    return pa.array([text_image(t.as_py()) for t in text], pa.binary())


def texts_as_media(docs: DataFrame, text: str = "text", to: str = "media") -> DataFrame:
    """docs with each text stored losslessly as the bytes of a P6 image; null as the empty text."""
    return docs.withColumn(to, F.arrow_udf(_text_images, "binary")(F.col(text)))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as a P6 image and read back: sizes, digests, and its difference hash with a digest of its NPY tile."""
    small_batches(spark)
    stored = texts_as_media(table(spark, sf_dir, "documents").select("doc_id", "text"))
    read = media_features(stored.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "media"))
    return read.select(
        "doc_id",
        "n_bytes",
        F.col("features.sample_bytes").alias("payload_bytes"),
        F.col("features.samples_sha256").alias("payload_sha256"),
        "features.tail_crc32",
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", "features.dhash", F.substring(F.sha2("features.tile", 256), 1, 16)).alias("feature"),
    )
