"""Media columns: Netpbm and BMP bytes to numpy arrays, area resizing by integral images, NPY tiles, difference hashes."""

from __future__ import annotations

import hashlib
import io
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.batches import map_column
from corpusloom.plans.staging import drop_stage, stage, table

ROW = 64
BAND = 1 << 20  # samples of the integral image that are held at once
_FIELD = re.compile(rb"(?:\s|#[^\n]*\n)*([0-9]+)")


def encode_pgm(samples: np.ndarray) -> bytes:
    """An 8-bit grey array as binary Netpbm (P5)."""
    h, w = samples.shape
    return b"P5\n%d %d\n255\n" % (w, h) + np.ascontiguousarray(samples, np.uint8).tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """An 8-bit grey array as an uncompressed BMP with a grey palette."""
    h, w = samples.shape
    rows = np.zeros((h, -(-w // 4) * 4), np.uint8)
    rows[:, :w] = samples[::-1]
    grey = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4)
    grey[:, 3] = 0
    n = lambda *x: b"".join(int(v).to_bytes(4, "little") for v in x)
    head = b"BM" + n(54 + 1024 + rows.size, 0, 54 + 1024) + n(40, w, h) + b"\x01\x00\x08\x00" + n(0, rows.size, 2835, 2835, 256, 0)
    return head + grey.tobytes() + rows.tobytes()


def _decode_netpbm(data: bytes) -> np.ndarray:
    kind, at, head = data[1] - 48, 2, []
    while len(head) < (2 if kind in (1, 4) else 3):
        m = _FIELD.match(data, at)
        if not m:
            raise ValueError("a Netpbm header ends early")
        head.append(int(m[1]))
        at = m.end()
    w, h, top = (*head, 1)[:3]
    depth = 3 if kind in (3, 6) else 1
    if not 0 < top < 65536:
        raise ValueError(f"maximum sample {top}")
    if kind == 1:  # digits need no space between them
        flat = np.frombuffer(re.sub(rb"#[^\n]*|\s", b"", data[at:]), np.uint8)[: w * h] == 48
    elif kind in (2, 3):
        flat = np.array(re.sub(rb"#[^\n]*", b"", data[at:]).split()[: w * h * depth], np.uint16)
    elif kind == 4:
        bits = np.frombuffer(data, np.uint8, -(-w // 8) * h, at + 1).reshape(h, -1)
        flat = np.unpackbits(bits, axis=1)[:, :w].ravel() == 0
    else:
        flat = np.frombuffer(data, ">u2" if top > 255 else np.uint8, w * h * depth, at + 1)
    if flat.size != w * h * depth:
        raise ValueError("a Netpbm file ends early")
    wide = flat.reshape((h, w, 3) if depth == 3 else (h, w))
    if kind in (1, 4):
        return wide.astype(np.uint8) * np.uint8(255)
    return wide.astype(np.uint8) if top == 255 else np.rint(wide.astype(np.float64) * 255 / top).astype(np.uint8)


def _decode_bmp(data: bytes) -> np.ndarray:
    i = lambda at, size=4: int.from_bytes(data[at : at + size], "little", signed=size == 4)
    start, header, w, h, bits, packing = i(10), i(14), i(18), i(22), i(28, 2), i(30)
    if packing or bits not in (8, 24, 32):
        raise ValueError(f"BMP with {bits} bits and compression {packing}")
    step = -(-w * bits // 32) * 4
    rows = np.frombuffer(data, np.uint8, step * abs(h), start).reshape(abs(h), step)
    rows = rows[::-1] if h > 0 else rows
    if bits > 8:
        return np.ascontiguousarray(rows[:, : w * bits // 8].reshape(abs(h), w, bits // 8)[:, :, 2::-1])
    colours = np.frombuffer(data, np.uint8, 4 * (i(46) or 256), 14 + header).reshape(-1, 4)[:, 2::-1]
    plain = bool((colours == colours[:, :1]).all())
    return np.ascontiguousarray((colours[:, 0] if plain else colours)[rows[:, :w]])


def decode(data: bytes) -> np.ndarray:
    """Netpbm P1 to P6 or uncompressed BMP (8, 24, 32 bits) as uint8, height x width or height x width x 3."""
    if data[:1] == b"P" and data[1:2] in b"123456" and len(data) > 2:
        return _decode_netpbm(data)
    if data[:2] == b"BM":
        return _decode_bmp(data)
    raise ValueError("neither Netpbm nor BMP")


def _integral_rows(image: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Rows ``wanted`` (sorted) of the integral image, which has one row and column more; summed in bands of rows."""
    h, w = image.shape[:2]
    out, above, step = np.zeros((len(wanted), w + 1)), np.zeros(w + 1), max(1, BAND // w)
    for a in range(0, h, step):
        some = image[a : a + step]
        band = np.zeros((len(some) + 1, w + 1))
        np.cumsum(some if some.ndim == 2 else some.mean(axis=2), axis=0, dtype=np.float64, out=band[1:, 1:])
        np.cumsum(band[1:, 1:], axis=1, out=band[1:, 1:])
        band += above
        low, high = np.searchsorted(wanted, (a, a + len(some) + 1))
        out[low:high], above = band[wanted[low:high] - a], band[-1]
    return out


def _between(edges: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Whole places below ``edges`` (the last of n leaves one above it) and how far the edges lie beyond them."""
    low = np.minimum(edges.astype(np.int64), n - 1)
    return low, (edges - low)[:, None]


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the covered area for every target cell (float64, grey), read off the integral image at its corners."""
    h, w = image.shape[:2]
    low, part = _between(np.arange(height + 1) * h / height, h)
    wanted = np.unique(np.concatenate([low, low + 1]))
    rows = _integral_rows(image, wanted)
    corner = rows[np.searchsorted(wanted, low)] * (1 - part) + rows[np.searchsorted(wanted, low + 1)] * part
    low, part = _between(np.arange(width + 1) * w / width, w)
    corner = corner.T[low] * (1 - part) + corner.T[low + 1] * part
    return np.diff(np.diff(corner.T, axis=0), axis=1) * (height * width / (h * w))


def difference_hash(image: np.ndarray, size: int = 8) -> str:
    """Hex digits of size x size bits: is a cell darker than its right neighbour?"""
    cells = np.round(area_resize(image, size, size + 1), 6)
    return np.packbits(cells[:, :-1] < cells[:, 1:]).tobytes().hex()


def npy(tile: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, tile)
    return out.getvalue()


FEATURES = "height int, width int, channels int, feature string, tile_npy binary, error string"


def media_features(media: DataFrame, media_col: str = "media", keep: tuple[str, ...] = (), tile: int = 32) -> DataFrame:
    """Decode a binary column. Returns ``keep``, height, width, channels, feature, tile_npy, error; one row each.

    ``tile_npy`` is a tile x tile uint8 array in NPY format. Null and broken
    media give null features and a text in ``error``. A column of ``keep`` that
    is named like a new one gives way to it. No rows: no rows.
    """

    def one(data: bytes | None) -> tuple:
        try:
            image = decode(data or b"")
        except (ValueError, IndexError) as e:
            return None, None, None, None, None, str(e)
        return *image.shape[:2], 1 if image.ndim == 2 else 3, difference_hash(image), npy(np.rint(area_resize(image, tile, tile)).astype(np.uint8)), None

    kept = [F.col(c) for c in keep if c not in {x.split()[0] for x in FEATURES.split(", ")}]
    source = media.select(*kept, F.col(media_col).alias("media to decode"))
    return map_column(source, "media to decode", lambda: lambda many: (None, *zip(*map(one, many), strict=True)), FEATURES)


def write_tiles(features: DataFrame, path: str) -> None:
    """Write the NPY tiles with their hashes as a table: a binary file per row would be many small files on any store."""
    features.filter("tile_npy is not null").write.parquet(path)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text's UTF-8 bytes, zero-padded to a positive multiple of 64, as rows of an 8-bit P5 image."""

    def one(data: bytes | None) -> tuple[int, bytes]:
        data = data or b""
        padded = data + bytes(max(ROW, -(-len(data) // ROW) * ROW) - len(data))
        return len(data), encode_pgm(np.frombuffer(padded, np.uint8).reshape(-1, ROW))

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return map_column(source, "text", lambda: lambda texts: (None, *zip(*map(one, texts), strict=True)), "n_bytes long, media binary")


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as an image in the shared folder, read the images back, describe them and store their tiles; one row per row.

    Null texts count as empty: 64 zero bytes. Equal texts give equal values,
    whatever their ids; null ids and repeated rows stay. Other columns of
    ``docs`` are not read. No rows: no rows.
    """
    stored = stage(store_texts(docs, id_col, text_col), "media", "zstd")

    def one(media: bytes) -> tuple:
        image = decode(media)
        payload = image.tobytes()
        tile = npy(np.rint(area_resize(image, 32, 32)).astype(np.uint8))
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]), len(media), hashlib.sha256(media).hexdigest(), difference_hash(image), tile

    new = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile_npy binary"
    tiles = stage(map_column(stored, "media", lambda: lambda many: (None, *zip(*map(one, many), strict=True)), new), "tiles", "zstd")
    drop_stage(stored)
    return tiles.withColumnRenamed("id", id_col)


def op2_media(spark, sf_dir):
    """The contract's columns of every document, and the SHA-256 of its stored tile."""
    found = text_media(table(spark, sf_dir, "documents"))
    return found.withColumn("tile_sha256", F.sha2("tile_npy", 256)).drop("tile_npy")
