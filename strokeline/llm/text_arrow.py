"""Arrow and NumPy helpers shared by the text operators; they run inside tasks on one bounded slice of rows at a time."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once by a task; a single longer text forms a slice of its own.
SLICE_BYTES = 2 << 20


def slices(batches: Iterable[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that each slice holds about `limit` bytes of the column `text`, and at least one row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = size[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(size, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
        pa.default_memory_pool().release_unused()  # what a batch needed goes back before the next one comes


def texts_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The column as strings, null read as the empty text."""
    column = batch.column(name)
    if column.null_count:
        column = pc.fill_null(column, "")
    return column


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array without nulls; offsets start at 0."""
    if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type):
        kind = np.int64
    else:
        kind = np.int32
    offsets = np.frombuffer(texts.buffers()[1], dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    return flat, offsets - offsets[0]


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    r"""(words of all texts one after another, offsets by text); a word is a maximal run of `[^\x20\x09-\x0D]`."""
    split = pc.ascii_split_whitespace(texts)
    flat = pc.list_flatten(split)
    counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(counts)])
    filled = pc.greater(pc.binary_length(flat), 0)
    real = filled.to_numpy(zero_copy_only=False)
    if not real.all():
        offsets = np.concatenate([[0], np.cumsum(real)])[offsets]
        flat = flat.filter(filled)
    return flat, offsets


def coded(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(codes, distinct values) of an array without nulls."""
    made = values.dictionary_encode()
    return made.indices.to_numpy(zero_copy_only=False).astype(np.int64), made.dictionary


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scrambling of integers (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashes_of(values: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each string of an array without nulls; equal strings have equal hashes in every task."""
    import xxhash

    one = xxhash.xxh3_64_intdigest
    return np.fromiter((one(v, seed) for v in values.cast(pa.binary()).to_pylist()), dtype=np.uint64, count=len(values))


def per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of `values` between neighbouring offsets; empty stretches give 0."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def row_of(offsets: np.ndarray) -> np.ndarray:
    """The row each position belongs to."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def gathered(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated stretches [start, start + length)."""
    lengths = lengths.astype(np.int64)
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts.astype(np.int64) - (ends - lengths), lengths)


def squeezed(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on, byte planes of them compressed: small and sorted numbers take little room."""
    if values.dtype != np.uint8:
        values = values.astype("<u8")
    width = values.dtype.itemsize
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, width).T)
    used = max(1, int(np.flatnonzero(planes.any(axis=1)).max(initial=0)) + 1)
    data = planes[:used].tobytes()
    return bytes([used]) + len(values).to_bytes(7, "little") + (pa.compress(data, codec="zstd", asbytes=True) if data else b"")


def unsqueezed(data: bytes) -> np.ndarray:
    used, size = data[0], int.from_bytes(data[1:8], "little")
    made = np.zeros((size, 8), dtype=np.uint8)
    if size:
        made[:, :used] = np.frombuffer(pa.decompress(data[8:], decompressed_size=used * size, codec="zstd", asbytes=True), dtype=np.uint8).reshape(used, size).T
    return made.view("<u8").ravel()
