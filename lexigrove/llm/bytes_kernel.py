"""Vectorised views of text columns for functions that run in Arrow batches.

A batch's texts are taken as bytes, long texts cut into pieces after white space and short
ones put together, so that arrays stay at about ``CHUNK`` bytes whatever the texts' lengths.
A run without white space is never cut, so no word or character gram ends at a cut that
does not end there anyway; a piece is as long as such a run may be.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK, PIECE = 1 << 19, 1 << 17


def text_buffer(column: pa.Array) -> tuple[memoryview, np.ndarray]:
    """(all bytes, offsets) of a string column; nulls have no bytes."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = memoryview(column.buffers()[2]) if column.buffers()[2] is not None else memoryview(b"")
    return data, offsets


#: ASCII white space: it ends words as well as runs of visible characters.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _cuts(data: memoryview, start: int, end: int) -> Iterator[tuple[int, int]]:
    """The pieces of a text: after the last white space of each ``PIECE`` bytes or, without any there, after the next one."""
    while end - start > PIECE:
        cut = None
        for low in range(start + PIECE - 4096, start - 1, -4096):
            spaces = np.flatnonzero(_SPACE[np.frombuffer(data[low : low + 4096], dtype=np.uint8)])
            if len(spaces):
                cut = low + int(spaces[-1]) + 1
                break
        at = start + PIECE
        while cut is None and at < end:
            spaces = np.flatnonzero(_SPACE[np.frombuffer(data[at : min(at + PIECE, end)], dtype=np.uint8)])
            if len(spaces):
                cut = at + int(spaces[0]) + 1
            at += PIECE
        if cut is None or cut >= end:
            break
        yield start, cut
        start = cut
    yield start, end


def chunks(column: pa.Array) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """(bytes, starts, rows): pieces, each followed by a newline, where each starts, and the row it is of.

    Every row has a piece; the pieces of a long text follow one another.
    """
    data, offsets = text_buffer(column)
    held: list[memoryview] = []
    rows: list[int] = []
    size = 0
    for row in range(len(offsets) - 1):
        for start, end in _cuts(data, int(offsets[row]), int(offsets[row + 1])):
            if size and size + end - start > CHUNK:
                yield _joined(held, rows)
                held, rows, size = [], [], 0
            held.append(data[start:end])
            rows.append(row)
            size += end - start + 1
    if held:
        yield _joined(held, rows)


def _joined(held: list[memoryview], rows: list[int]) -> tuple[bytes, np.ndarray, np.ndarray]:
    lengths = np.array([len(h) for h in held], dtype=np.int64) + 1
    return b"\n".join(held) + b"\n", np.concatenate([[0], np.cumsum(lengths)[:-1]]), np.array(rows, dtype=np.int64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        base = 0x9E3779B97F4A7C15 | 1
        inverse = pow(base, -1, 1 << 64)
        for name, factor in (("up", base), ("down", inverse)):
            steps = np.full(n, factor, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


#: Lower-cased byte of every byte that belongs to a word, else 0: digits, letters and all beyond ASCII.
WORD_BYTE = np.zeros(256, dtype=np.uint8)
WORD_BYTE[48:58] = np.arange(48, 58)
WORD_BYTE[65:91] = np.arange(97, 123)
WORD_BYTE[97:123] = np.arange(97, 123)
WORD_BYTE[128:] = np.arange(128, 256)


def word_hashes(chunk: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of each word of the chunk. Hashes are 64 bits of a polynomial over the word's bytes."""
    raw = WORD_BYTE[np.frombuffer(chunk, dtype=np.uint8)]
    inside = raw != 0
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)  # a chunk ends in a newline
    up, down = _power_tables(max(len(raw), CHUNK + PIECE + 2))
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(raw.astype(np.uint64) * up[: len(raw)], dtype=np.uint64)])
    plain = (upto[ends] - upto[starts]) * down[starts]
    return mix64(plain + (ends - starts).astype(np.uint64)), starts
