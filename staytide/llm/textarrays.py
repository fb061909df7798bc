"""Arrow text columns as flat NumPy arrays: bytes, words, and hashes of words, all without a loop per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
# A-Z in lower case, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finalizer of MurmurHash3)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(33)
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


BYTE_CODE = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D
_powers = (np.ones(1, U64), np.ones(1, U64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base mod 2**64, and of its inverse."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, _BASE, U64), np.full(size, pow(_BASE, -1, 1 << 64), U64)
        up[0] = down[0] = 1
        _powers = (np.cumprod(up), np.cumprod(down))
    return _powers[0][:n], _powers[1][:n]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes in one array, and the n + 1 places where texts begin; NULL is empty."""
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    _, starts, data = texts.buffers()
    n = len(texts)
    at = np.frombuffer(starts, np.int64, n + 1, texts.offset * 8) if n else np.zeros(1, np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return flat[at[0] : at[-1]], at - at[0]


def parts(batches: Iterator[pa.RecordBatch], text: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a part holds about `most_bytes` of text, or one longer document."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.diff(text_bytes(column(batch, text))[1])
        begin = size = 0
        for i, n in enumerate(lengths.tolist()):
            if size and size + n > most_bytes:
                yield batch.slice(begin, i - begin)
                begin, size = i, 0
            size += n
        yield batch.slice(begin)


class Words:
    """Words of a part: where they begin and end, their document, and a 64-bit hash of each."""

    def __init__(self, flat: np.ndarray, at: np.ndarray, lower: bool = True):
        space = _IS_SPACE[flat]
        n = len(flat)
        begins = ~space
        begins[1:] &= space[:-1]
        edges = at[1:-1]
        inner = edges[(edges > 0) & (edges < n)]
        begins[inner] = ~space[inner]
        self.start = np.flatnonzero(begins)
        ends = ~space
        if n:
            following = np.ones(n, bool)
            following[:-1] = space[1:]
            following[inner - 1] = True
            ends &= following
        self.end = np.flatnonzero(ends) + 1
        self.doc = np.searchsorted(at, self.start, "right") - 1
        self.first = np.searchsorted(self.start, at)
        up, down = powers(n + 1)
        codes = BYTE_CODE[LOWER][flat] if lower else BYTE_CODE[flat]
        total = np.zeros(n + 1, U64)
        np.cumsum(codes * up[:n], out=total[1:])
        self.hash = mix64((total[self.end] - total[self.start]) * down[self.start])

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of runs of k words within a document (all its words if it has fewer), and n + 1 places."""
        m = len(self.hash)
        counts = np.diff(self.first)
        up, down = powers(m + 1)
        total = np.zeros(m + 1, U64)
        np.cumsum(self.hash * up[:m], out=total[1:])
        n_shingles = np.where(counts > 0, np.maximum(counts - k + 1, 1), 0)
        at = np.zeros(len(counts) + 1, np.int64)
        np.cumsum(n_shingles, out=at[1:])
        owner = np.repeat(np.arange(len(counts)), n_shingles)
        begin = self.first[:-1][owner] + np.arange(at[-1]) - at[:-1][owner]
        end = np.minimum(begin + k, self.first[1:][owner])
        return mix64((total[end] - total[begin]) * down[begin]), at


def pack_planes(values: np.ndarray) -> bytes:
    """Bytes of the numbers, plane by plane, compressed: high bytes of ids and places are mostly the same."""
    import zstandard

    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack_planes(blob: bytes, n: int, kind) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, n).T).view(kind).ravel()
