"""Words and word hashes of Arrow text columns, taken from the bytes with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are worked on in pieces of about so many bytes; a longer text is a piece of its own.
PIECE = 1 << 20
U = np.uint64
_BASE, _UNBASE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}

BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of letters; every byte of a character beyond ASCII counts as one.
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True


def pieces(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for runs of rows; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + PIECE, "right")) - 1)
        yield row, raw[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def spans(data: np.ndarray, offsets: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text (and the end) the number of words before it.

    ``between`` says which bytes stand between words; a text's end ends a word too.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    gap = between[data]
    first, last = np.ones(len(data), bool), np.ones(len(data), bool)
    first[1:], last[:-1] = gap[:-1], gap[1:]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    first[inner] = True
    last[inner[inner > 0] - 1] = True
    starts, ends = np.flatnonzero(first & ~gap), np.flatnonzero(last & ~gap) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _power(name: str, base: int, n: int) -> np.ndarray:
    if len(_powers.get(name, ())) < n:
        steps = np.full(max(n, PIECE), base, U)
        steps[0] = 1
        _powers[name] = np.cumprod(steps, dtype=U)
    return _powers[name][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of a polynomial of the bytes, for :func:`hashes`."""
    prefix = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * _power("up", _BASE, len(data)), out=prefix[1:])
    return prefix


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, prefix: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of the words, from prefix sums of a polynomial of the bytes."""
    if not len(starts):
        return np.zeros(0, U)
    prefix = prefix_sums(data) if prefix is None else prefix
    return mix((prefix[ends] - prefix[starts]) * _power("down", _UNBASE, len(data))[starts] + (ends - starts).astype(U))


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of ``length`` consecutive words, over the borders of texts too."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, U)
    total = np.full(n, length, U)
    for k in range(length):
        total += mix(words[k : k + n] + U(2 * k + 1)) * U((2 * k + 3) * 0xD6E8FEB86659FD93 & (1 << 64) - 1)
    return mix(total)


def batches(table_columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(table_columns[f.name], f.type) for f in schema], schema=schema)
