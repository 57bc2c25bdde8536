"""Page images as PNG files to pixels and back, without an image library; other formats need a codec that is passed in."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# The signature of a PNG file, and bytes a pixel by colour type (grey, colour, grey and colour with opacity).
SIGNATURE, DEPTH = b"\x89PNG\r\n\x1a\n", {0: 1, 2: 3, 4: 2, 6: 4}
#: Pixels of an image beyond which its file is taken to be broken.
MOST = 1 << 28


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(image: np.ndarray) -> bytes:
    """A PNG file of an image of height x width, grey, or x 3, blue first; each row is stored as its difference from the one above."""
    rows = np.ascontiguousarray(image[..., ::-1] if image.ndim == 3 else image, np.uint8).reshape(image.shape[0], -1)
    lines = np.empty((rows.shape[0], rows.shape[1] + 1), np.uint8)
    lines[:, 0] = 2
    lines[:1, 1:] = rows[:1]
    lines[1:, 1:] = rows[1:] - rows[:-1]
    head = struct.pack(">IIBBBBB", image.shape[1], image.shape[0], 8, 2 if image.ndim == 3 else 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def chunks(file: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Kind and data of each chunk; a broken one is an error."""
    at = len(SIGNATURE)
    if not file.startswith(SIGNATURE):
        raise ValueError("not a PNG file")
    while at < len(file):
        if at + 12 > len(file):
            raise ValueError("cut off")
        (n,), kind = struct.unpack_from(">I", file, at), file[at + 4 : at + 8]
        data = file[at + 8 : at + 8 + n]
        if len(data) < n or file[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(kind + data)):
            raise ValueError("broken chunk")
        yield kind, data
        at += 12 + n


def refilled(line: np.ndarray, above: np.ndarray, kind: int, size: int) -> np.ndarray:
    """A row of bytes from its stored differences: from the pixel before, the one above, their mean, or the likeliest of three."""
    if kind == 0:
        return line
    if kind == 1:
        return np.add.accumulate(line.reshape(-1, size), axis=0, dtype=np.uint8).ravel()
    if kind == 2:
        return line + above
    if kind not in (3, 4):
        raise ValueError("unknown filter")
    out, up = [0] * size + line.tolist(), [0] * size + above.tolist()
    for k in range(size, len(out)):
        left, top = out[k - size], up[k]
        if kind == 3:
            guess = (left + top) // 2
        else:
            # The neighbour nearest to what a plane through the three says.
            corner = up[k - size]
            flat = left + top - corner
            guess = min((left, top, corner), key=lambda x: abs(flat - x))
        out[k] = (out[k] + guess) & 255
    return np.array(out[size:], np.uint8)


def decode(file: bytes) -> np.ndarray:
    """Pixels of height x width x 3, blue first, of a PNG of 8 bits a channel without palette or interlacing; opacity is left out. Others are an error."""
    parts = list(chunks(file))
    if not parts or parts[0][0] != b"IHDR" or len(parts[0][1]) != 13 or parts[-1][0] != b"IEND":
        raise ValueError("cut off")
    w, h, bits, colour, _, _, interlaced = struct.unpack(">IIBBBBB", parts[0][1])
    if bits != 8 or colour not in DEPTH or interlaced:
        raise ValueError("unsupported kind of PNG")
    if not 0 < w * h <= MOST:
        raise ValueError("no size, or too large")
    size = DEPTH[colour]
    room = h * (w * size + 1)
    raw = zlib.decompressobj().decompress(b"".join(d for k, d in parts if k == b"IDAT"), room)
    if len(raw) != room:
        raise ValueError("cut off")
    lines = np.frombuffer(raw, np.uint8).reshape(h, w * size + 1)
    out = np.empty((h, w * size), np.uint8)
    above = np.zeros(w * size, np.uint8)
    for y in range(h):
        out[y] = above = refilled(lines[y, 1:], above, int(lines[y, 0]), size)
    pixels = out.reshape(h, w, size)
    return np.repeat(pixels[..., :1], 3, axis=2) if size < 3 else pixels[..., 2::-1].copy()


DECODED = "path string, width int, height int, pixels binary, error string"


def decoded(files: DataFrame, codec: Callable[[bytes], np.ndarray] = decode) -> DataFrame:
    """(path, width, height, pixels, error) of files (path, content): three bytes a pixel, blue first. An unreadable or null file gives an error row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                try:
                    image = codec(content.as_py() or b"")
                    row = (path, image.shape[1], image.shape[0], image.tobytes(), None)
                except Exception as e:
                    row = (path, None, None, None, f"{type(e).__name__}: {e}")
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], [x.split()[0] for x in DECODED.split(", ")])

    return files.select("path", "content").mapInArrow(run, DECODED)


def encoded(images: DataFrame, codec: Callable[[np.ndarray], bytes] = encode) -> DataFrame:
    """(name, content) of images (name, width, height, pixels: three bytes a pixel, blue first); one of another size, or null, is an error of the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, w, h, pixels in zip(*(b.column(k).to_pylist() for k in range(3)), b.column(3), strict=True):
                content = codec(np.frombuffer(pixels.as_py() or b"", np.uint8).reshape(h or 0, w or 0, 3))
                yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([content], pa.binary())], ["name", "content"])

    return images.select("name", "width", "height", "pixels").mapInArrow(run, "name string, content binary")
