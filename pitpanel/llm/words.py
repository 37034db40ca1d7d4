"""Words and lines of a whole Arrow batch at once, as numpy arrays of 64-bit hashes.

The hash of a token of up to `SHORT` bytes is a polynomial over a random table of its bytes, taken from one
running sum over the batch, so no Python object is made for a word. Longer tokens, where such
polynomials modulo a power of two collide on regular strings, are hashed one by one with xxh3.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

from .shared import GOLDEN, MIX1, mix

SPACE = b" \t\n\v\f\r"
PIECE = 1 << 16
#: Bytes of the longest token that is hashed by the running sum.
SHORT = 32


def _classes(*groups: bytes, rest: int) -> np.ndarray:
    table = np.full(256, rest, np.uint8)
    for number, group in enumerate(groups):
        table[list(group)] = number
    return table


#: Class of each byte, 0 for what is between tokens.
WORDS = _classes(SPACE, rest=1)
LINES = _classes(b"\n", rest=1)
#: Runs of letters, digits, underscores and bytes beyond ASCII are tokens, and so are runs of other marks.
LETTERS_AND_MARKS = _classes(SPACE, bytes(c for c in range(128) if not (chr(c).isalnum() or chr(c) == "_" or c in SPACE)), rest=2)

with np.errstate(over="ignore"):
    BYTE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * GOLDEN)
    FACTOR = MIX1
    INVERSE = np.uint64(pow(int(MIX1), -1, 1 << 64))

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """FACTOR and its inverse to the powers 0 .. n-1."""
    if len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            for i, base in enumerate((FACTOR, INVERSE)):
                _powers[i] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)]))
    return _powers[0][:n], _powers[1][:n]


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without nulls, and where each text begins (and the last ends)."""
    column = column.cast(pa.large_string())
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Tokens:
    """Tokens in order: hash, first byte, end, and the number of the text (or other span) that each is in."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    owner: np.ndarray

    def per_owner(self, owners: int) -> np.ndarray:
        return np.bincount(self.owner, minlength=owners)


def spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and owner of the runs of bytes of one class above 0; no run crosses one of the `offsets`."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    kind = table[data]
    change = np.empty(len(data), bool)
    change[0] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    change[offsets[offsets < len(data)]] = True
    start = np.flatnonzero(change)
    end = np.append(start[1:], len(data))
    real = kind[start] > 0
    start, end = start[real], end[real]
    return start, end, np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(start, offsets)))


def tokens(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Tokens:
    """The spans with their hashes."""
    start, end, owner = spans(data, offsets, table)
    return Tokens(span_hashes(data, start, end), start, end, owner)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each of the ordered, disjoint spans, a piece of the data at a time."""
    out, done = np.empty(len(start), np.uint64), 0
    with np.errstate(over="ignore"):
        while done < len(start):
            first = start[done]
            upto = max(done + 1, int(np.searchsorted(start, first + PIECE)))
            part = data[first : end[upto - 1]]
            power, inverse = powers(len(part))
            total = np.zeros(len(part) + 1, np.uint64)
            value = BYTE[part]
            value *= power
            np.cumsum(value, out=total[1:])
            a, b = start[done:upto] - first, end[done:upto] - first
            out[done:upto] = mix((total[b] - total[a]) * inverse[a] + (b - a).astype(np.uint64) * GOLDEN)
            done = upto
    for i in np.flatnonzero(end - start > SHORT).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]])
    return out


def windows(t: Tokens, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of `width` tokens inside one owner, and the position of its first token."""
    n = len(t.hash) - width + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = np.flatnonzero(t.owner[:n] == t.owner[width - 1 :])
    with np.errstate(over="ignore"):
        total, factor = np.zeros(n, np.uint64), FACTOR
        for i in range(width):
            total += t.hash[i : i + n] * factor
            factor = factor * FACTOR
        return mix(total[inside]), inside


def counted(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each text the mask marks."""
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(mask, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def keyed(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Values made distinct between owners."""
    with np.errstate(over="ignore"):
        return mix(values + mix((owner.astype(np.uint64) + np.uint64(1)) * GOLDEN))
