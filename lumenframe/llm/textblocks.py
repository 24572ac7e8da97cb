"""Texts of Arrow batches as byte arrays: words and their hashes for many documents at once, without a Python object for each word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer document is a piece of its own.
PIECE = 1 << 20

_MUL = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_powers: dict[str, np.ndarray] = {}


def strings(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


def pieces(data: np.ndarray, offsets: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of whole documents of about `limit` bytes."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def table(chars: bytes, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(is a separator?, lower-cased byte) for each byte; `chars` are the separators."""
    gap = np.zeros(256, bool)
    gap[list(chars)] = True
    low = np.arange(256, dtype=np.uint8)
    if lower:
        low[65:91] += 32
    return gap, low


# Separators of the two word definitions of the corpus contracts.
SPACES = bytes([0x20, *range(0x09, 0x0E)])
NOT_ALNUM = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, document) of the runs of True that lie within one document."""
    if not len(inside):
        none = np.zeros(0, np.int64)
        return none, none, none
    first = np.empty(len(inside), bool)
    first[0], first[1:] = True, ~inside[:-1]
    first[offsets[:-1][offsets[:-1] < len(inside)]] = True
    last = np.empty(len(inside), bool)
    last[-1], last[:-1] = True, ~inside[1:]
    last[offsets[1:][offsets[1:] > 0] - 1] = True
    starts, ends = np.flatnonzero(inside & first), np.flatnonzero(inside & last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads differences over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        with np.errstate(over="ignore"):
            inverse = pow(int(_BASE), -1, 1 << 64)
            for name, base in (("up", _BASE), ("down", np.uint64(inverse))):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                _powers[name] = np.cumprod(steps)
    return _powers["up"], _powers["down"]


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each run of bytes: a polynomial whose sums over runs come from one running sum over all bytes."""
    up, down = _power(max(1 << 16, 1 << int(len(data) + 1).bit_length()))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _MUL)


def combined(parts: list[np.ndarray]) -> np.ndarray:
    """Hash of a sequence of hashes, for each place."""
    with np.errstate(over="ignore"):
        out = np.zeros(len(parts[0]), np.uint64)
        for p in parts:
            out = mixed(out * _MUL + p + np.uint64(1))
        return out
