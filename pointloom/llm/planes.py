"""Arrays of whole numbers as compressed binary values of a table."""

from __future__ import annotations

import functools

import numpy as np


@functools.cache
def _zstd():
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdCompressor(level=3).compress, zstandard.ZstdDecompressor().decompress


def pack(values: np.ndarray) -> bytes:
    """Compressed by planes of bytes: the high ones of small or sorted numbers take little."""
    return _zstd()[0](np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T.tobytes())


def unpack(data: bytes, kind: str = "<u4") -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(decompress(data), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def compress(data: bytes) -> bytes:
    """For texts, harder than :func:`pack`."""
    return _zstd()[1](data)


def decompress(data: bytes) -> bytes:
    return _zstd()[2](data)
