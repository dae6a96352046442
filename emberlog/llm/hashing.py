"""Hashes of slices of a byte buffer, read eight bytes (a lane) at a time.

A lane that is shorter is filled with zeros. Every lane is mixed over all 64 bits before the next one
joins it, so a hash is no polynomial in the bytes: texts that are built to collide for such hashes,
whatever their base, do not collide here. Equal slices have equal hashes wherever they lie. Where an
answer hangs on equality, callers compare contents besides.
"""

from __future__ import annotations

import hashlib

import numpy as np

BASE = 0x9E3779B97F4A7C15
OTHER = 0xC2B2AE3D27D4EB4F
# Slices of more bytes are hashed one by one by a library function.
LONG = 512


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit integers over all others (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


mixed = _mixed
# The bytes of a lane that count, by how many are left.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every byte on as one integer; zeros follow the last byte."""
    held = np.zeros(len(data) + 8, np.uint8)
    held[:len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", held, 0, (1,))


def lane(read: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The lanes at some places, cut to the bytes that are left (none: 0)."""
    return read[at] & _MASKS[np.clip(left, 0, 8)]


def slices(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the slices [start, end); slices of different lengths differ too."""
    size = end - start
    out = _mixed(size.astype(np.uint64) + np.uint64(BASE))
    read = lanes(data)
    live, done = np.flatnonzero((size > 0) & (size <= LONG)), 0
    while len(live):
        out[live] = _mixed(out[live] * np.uint64(OTHER) ^ _mixed(lane(read, start[live] + done, size[live] - done) + np.uint64(BASE)))
        done += 8
        live = live[size[live] > done]
    for i in np.flatnonzero(size > LONG):
        digest = hashlib.blake2b(data[start[i]:end[i]], digest_size=8).digest()
        out[i] = np.frombuffer(digest, np.uint64)[0]
    return out


def windows(data: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all slices of one length (8 at least), by their start: a weighted sum of mixed lanes."""
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    read = _mixed(lanes(data)[:len(data)] + np.uint64(BASE))
    out = np.zeros(n, np.uint64)
    for k, place in enumerate([*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]):
        out += read[place:place + n] * _WEIGHTS[k]
    return _mixed(out)


# A rule, not a table: one odd weight for each lane of a window.
_WEIGHTS = _mixed(np.arange(64, dtype=np.uint64) + np.uint64(11)) | np.uint64(1)


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def is_space(data: np.ndarray) -> np.ndarray:
    return _SPACE[data]


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow string or binary column as its bytes and the offsets of its rows; a null is the empty text."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def pieces(data: np.ndarray, offsets: np.ndarray, size: int = 1 << 18):
    """Runs of whole rows of about ``size`` bytes: (first row, end row, bytes, offsets)."""
    first = 0
    while first < len(offsets) - 1:
        end = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        end = min(max(end, first + 1), len(offsets) - 1)
        at = offsets[first:end + 1]
        yield first, end, data[at[0]:at[-1]], at - at[0]
        first = end


def whole_keys(batches):
    """A partition sorted by its first column, as Arrow tables that hold whole keys."""
    import pyarrow as pa

    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]) if held is not None else table
        key = np.asarray(table.column(0))
        cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
        if cut:
            yield table.slice(0, cut).combine_chunks()
        held = table.slice(cut)
    if held is not None and held.num_rows:
        yield held.combine_chunks()
