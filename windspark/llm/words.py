"""Words of a column of texts in arrays: small helpers of the operators on words, used inside tasks."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

INSIDE, BLANK, BREAK = 0, 1, 2


def byte_kinds(blanks: bytes, breaks: bytes = b"") -> np.ndarray:
    """Kind of every byte: inside a word, between words, or between words and pieces."""
    out = np.zeros(256, np.uint8)
    out[list(blanks)] = BLANK
    out[list(breaks)] = BREAK
    return out


#: What stands between words, by contract: space and tab to carriage return.
WHITE = byte_kinds(b" \t\n\x0b\x0c\r")
#: A-Z as a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Words(NamedTuple):
    ids: np.ndarray  # number of each word in ``distinct``, text after text
    distinct: pa.Array  # large_binary
    first: np.ndarray  # words before each text, and of all
    piece: np.ndarray  # number of the piece each word is in; pieces never hold words of two texts


def cut(texts: pa.Array, kinds: np.ndarray, letters: np.ndarray | None = None) -> Words:
    """The words of UTF-8 ``texts`` (null: empty), cut at ASCII bytes only, so never inside a character."""
    raw = [x or b"" for x in texts.cast(pa.large_binary()).to_pylist()]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1)  # behind the line feed after each text
    kind = kinds[data]
    kind[ends - 1] = BREAK
    inside = kind == INSIDE
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    before = np.cumsum(start)
    first = np.append(0, before[ends - 1]) if len(raw) else np.zeros(1, np.int64)
    piece = np.cumsum(kind == BREAK)[start]
    size = np.cumsum(inside)
    places = np.append(size[start] - 1, size[-1] if len(size) else 0).astype(np.int64)
    data = data[inside]
    if letters is not None:
        data = letters[data]
    words = pa.Array.from_buffers(pa.large_binary(), len(places) - 1, [None, pa.py_buffer(places.tobytes()), pa.py_buffer(data.tobytes())])
    coded = words.dictionary_encode()
    return Words(coded.indices.to_numpy().astype(np.int64), coded.dictionary, first, piece)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of stretches given by start and size, one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def values_of(distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a large_binary array that starts at its first value."""
    _, offsets, data = distinct.buffers()
    offsets = np.frombuffer(offsets, np.int64)[distinct.offset : distinct.offset + len(distinct) + 1] if offsets else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets


def spaced(distinct: pa.Array, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Texts (large_string) of ``counts`` words each, one space between words."""
    data, offsets = values_of(distinct)
    padded = np.full(len(data) + len(distinct), 32, np.uint8)  # every distinct word with a space behind it
    sizes = np.diff(offsets)
    padded[ragged(offsets[:-1] + np.arange(len(sizes)), sizes)] = data[offsets[0] : offsets[-1]]
    n = sizes[ids] + 1
    out = padded[ragged((offsets[:-1] + np.arange(len(sizes)))[ids], n)]
    ends = np.append(0, np.cumsum(n))[np.append(0, np.cumsum(counts))]
    keep = np.ones(len(out), bool)
    keep[ends[1:][counts > 0] - 1] = False  # the space behind the last word
    ends = ends - np.append(0, np.cumsum(counts > 0))
    return pa.Array.from_buffers(pa.large_string(), len(counts), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(out[keep].tobytes())])


def by_size(batches: Iterator[pa.RecordBatch], column: int, amount: int, rows: int = 100_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``amount`` bytes of one text column, small batches joined, large ones cut."""
    held, n = [], 0
    for batch in batches:
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            room = np.searchsorted(np.cumsum(sizes[at:]), max(amount - n, 0), "right")
            end = at + max(int(room), 0 if held else 1)
            if end > at:
                held.append(batch.slice(at, end - at))
                n += int(sizes[at:end].sum())
            if end < batch.num_rows or n >= amount or sum(b.num_rows for b in held) >= rows:
                yield joined(held)
                held, n = [], 0
            at = end
    if held:
        yield joined(held)


def joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(batches) == 1:
        return batches[0]
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
