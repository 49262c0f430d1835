"""Vectorised text primitives shared by the Arrow-based operators.

All work is done on the byte buffers of Arrow string columns with numpy lookup
tables, a bounded number of bytes at a time, so that a task's memory does not
depend on the number of rows in an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from ..sources.shared import delete, settled, shared_dir  # noqa: F401  # used by the operators

#: Bytes of text handled at once by one Python worker (one longer text is handled alone).
SLICE_BYTES = 3_000_000

_ASCII = np.arange(256, dtype=np.uint8)
#: 0 for white space (\x20, \x09-\x0D), 1 for every other byte.
WHITE = np.where((_ASCII == 32) | ((_ASCII >= 9) & (_ASCII <= 13)), 0, 1).astype(np.uint8)
#: Lower-cases A-Z, leaves every other byte.
LOWER = np.where((_ASCII >= 65) & (_ASCII <= 90), _ASCII + 32, _ASCII).astype(np.uint8)
#: 1 for ASCII digits and letters and for bytes of non-ASCII characters, 0 for the rest.
ALNUM = (((_ASCII >= 48) & (_ASCII <= 57)) | ((_ASCII >= 65) & (_ASCII <= 90)) | ((_ASCII >= 97) & (_ASCII <= 122)) | (_ASCII >= 128)).astype(np.uint8)
#: White space 0, word characters 1, punctuation and controls 2.
WORDPUNCT = np.where(WHITE == 0, 0, np.where(ALNUM == 1, 1, 2)).astype(np.uint8)


def free_names(df, *wanted: str) -> list[str]:
    """Column names that df doesn't have, whatever their case, one for each wanted."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches into runs of rows with at most limit bytes of text each (at least one row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = raw(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the int64 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    if not len(column) or ends is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive offsets."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def tokens(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    """Maximal runs of bytes of one non-zero class, never across rows.

    Returns the id of each token, the token offsets of the rows, the distinct tokens, and
    the byte position at which each token starts.
    """
    kind = classes[data]
    starts = np.empty(len(kind), bool)
    if len(kind):
        starts[0] = True
        np.not_equal(kind[1:], kind[:-1], out=starts[1:])
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts[first] = True
    keep = kind != 0
    starts &= keep
    at = np.flatnonzero(starts)
    packed = data[keep]
    ends = np.zeros(len(keep) + 1, np.int32)
    np.cumsum(keep, out=ends[1:])
    cuts = np.append(ends[at], len(packed)).astype(np.int32)
    words = pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(packed.tobytes())])
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.searchsorted(at, offsets), coded.dictionary.to_pylist(), at


def rows_of(offsets: np.ndarray) -> np.ndarray:
    """The row of each element."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
