"""Matrices of MATLAB files and pixel arrays of images, through Spark's binary file reader."""

from __future__ import annotations

import io
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Numeric types of level 5 MAT files.
TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}


def _element(data: bytes, at: int) -> tuple[int, bytes, int]:
    kind, size = struct.unpack_from("<II", data, at)
    if kind >> 16:  # small form: size and type share four bytes
        return kind & 0xFFFF, data[at + 4 : at + 4 + (kind >> 16)], at + 8
    return kind, data[at + 8 : at + 8 + size], at + 8 + size + (-size % 8 if kind != 15 else 0)


def mat_content(data: bytes) -> dict[str, np.ndarray]:
    """The real numeric arrays of a level 5 file, little-endian; other variables are left out."""
    out, at = {}, 128
    while at < len(data):
        kind, body, at = _element(data, at)
        if kind == 15:
            kind, body, _ = _element(zlib.decompress(body), 0)
        if kind != 14:
            continue
        parts, p = [], 0
        while p < len(body):
            k, b, p = _element(body, p)
            parts.append((k, b))
        if len(parts) < 4 or parts[3][0] not in TYPES:
            continue
        shape = np.frombuffer(parts[1][1], "<i4")
        out[parts[2][1].decode()] = np.frombuffer(parts[3][1], "<" + TYPES[parts[3][0]]).astype(float).reshape(shape, order="F")
    return out


def mat_bytes(arrays: dict[str, np.ndarray]) -> bytes:
    """A level 5 file of double matrices."""
    element = lambda kind, b: struct.pack("<II", kind, len(b)) + b + bytes(-len(b) % 8)
    out = b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack("<HH", 0x0100, 0x4D49)
    for name, a in arrays.items():
        a = np.atleast_2d(np.asarray(a, float))
        body = element(6, struct.pack("<II", 6, 0)) + element(5, np.array(a.shape, "<i4").tobytes()) + element(1, name.encode()) + element(9, a.tobytes(order="F"))
        out += element(14, body)
    return out


def read_mat(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, rows, columns, data): each variable of each file, column after column."""
    def run(frames):
        for pdf in frames:
            rows = [(p, n, a.shape[0], int(np.prod(a.shape[1:])), a.ravel(order="F").tolist()) for p, c in zip(pdf["path"], pdf["content"], strict=True) for n, a in mat_content(bytes(c)).items()]
            yield pd.DataFrame(rows, columns=["path", "name", "rows", "columns", "data"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, name string, rows int, columns int, data array<double>")


# -- images ---------------------------------------------------------------------------------------------------


def decode_image(data: bytes) -> np.ndarray:
    """(height, width, channels) of a binary PGM or PPM; other formats need Pillow, where it is there."""
    if data[:2] in (b"P5", b"P6"):
        words, at = [], 2
        while len(words) < 3:
            while data[at : at + 1].isspace():
                at += 1
            if data[at : at + 1] == b"#":
                at = data.index(b"\n", at)
                continue
            end = at
            while not data[end : end + 1].isspace():
                end += 1
            words.append(int(data[at:end]))
            at = end
        width, height, _ = words
        c = 1 if data[:2] == b"P5" else 3
        return np.frombuffer(data, np.uint8, width * height * c, at + 1).reshape(height, width, c)
    try:
        from PIL import Image
    except ImportError as e:
        raise ValueError("only PGM and PPM are read without Pillow") from e
    a = np.asarray(Image.open(io.BytesIO(data)))
    return a[:, :, None] if a.ndim == 2 else a


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area means: each target pixel is the mean of the source area it covers."""
    def weights(n: int, m: int) -> np.ndarray:
        edges = np.linspace(0, n, m + 1)
        lo, hi = edges[:-1, None], edges[1:, None]
        cells = np.arange(n)[None]
        w = np.clip(np.minimum(hi, cells + 1) - np.maximum(lo, cells), 0, None)
        return w / w.sum(1, keepdims=True)

    return np.einsum("ah,bw,hwc->abc", weights(image.shape[0], height), weights(image.shape[1], width), image.astype(float)).round().astype(np.uint8)


def read_images(spark: SparkSession, path: str, size: tuple[int, int] | None = None) -> DataFrame:
    """(path, height, width, channels, pixels): unsigned bytes, row after row, in bounded batches."""
    def run(frames):
        for pdf in frames:
            images = [decode_image(bytes(c)) for c in pdf["content"]]
            images = [resize(i, *size) if size else i for i in images]
            yield pd.DataFrame({"path": pdf["path"], "height": [i.shape[0] for i in images], "width": [i.shape[1] for i in images], "channels": [i.shape[2] for i in images], "pixels": [i.tobytes() for i in images]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, height int, width int, channels int, pixels binary")


def patch(pixels: Column, width: Column, channels: Column, top: int, left: int, height: int, across: int) -> Column:
    """A rectangle's bytes: one substring a row."""
    rows = F.transform(F.sequence(F.lit(0), F.lit(height - 1)), lambda r: F.hex(F.substring(pixels, ((r + top) * width + left) * channels + 1, F.lit(across) * channels)))
    return F.unhex(F.array_join(rows, ""))
