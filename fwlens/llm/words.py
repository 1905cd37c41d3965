"""Words of a text as bytes and as 64-bit hashes, inside Python tasks.

A word is a maximal run of characters other than blank, tab, newline, vertical tab, form feed and carriage return,
which is what ``bytes.split()`` cuts. A null text has no words.
"""

from __future__ import annotations

import numpy as np

#: Fixed seed of the byte table; results of two runs, and of all tasks of a run, agree.
_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PIECE = 1 << 20

_powers = np.ones(1, dtype=np.uint64)


def _power_table(length: int) -> np.ndarray:
    """Powers of the step, as many as the longest word needs."""
    global _powers
    while len(_powers) < length:
        with np.errstate(over="ignore"):
            _powers = np.concatenate([_powers, _powers * _powers[-1] * _STEP])
    return _powers


def encoded(text: str | None, lower: bool = False) -> bytes:
    """UTF-8 of a text (null: empty), with A-Z in lower case if asked for."""
    data = text.encode("utf-8", "surrogatepass") if text else b""
    return data.lower() if lower else data


def mixed(values: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    with np.errstate(over="ignore"):
        values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return values ^ (values >> np.uint64(31))


def _pieces(data: bytes):
    """Slices of about a MB that end where a word ends, so that a long text needs no large temporary arrays."""
    start = 0
    while len(data) - start > _PIECE:
        end = start + _PIECE
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield data[start:end]
        start = end
    yield data[start:]


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word in order."""
    found = []
    for piece in _pieces(data):
        codes = np.frombuffer(piece, dtype=np.uint8)
        inside = ~_IS_SPACE[codes]
        edges = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
        starts, lengths = edges[::2], edges[1::2] - edges[::2]
        if not len(starts):
            continue
        letters = codes[inside]
        begins = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        place = np.arange(len(letters)) - np.repeat(begins, lengths)
        with np.errstate(over="ignore"):
            terms = _BYTE[letters] * _power_table(int(lengths.max()) + 1)[place]
            found.append(mixed(np.add.reduceat(terms, begins) + lengths.astype(np.uint64)))
    return np.concatenate(found) if found else np.empty(0, dtype=np.uint64)


def gram_hashes(hashes: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of ``length`` consecutive words."""
    count = len(hashes) - length + 1
    if count <= 0:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        step = np.uint64((0xD6E8FEB86659FD93 + 2 * seed) & 0xFFFFFFFFFFFFFFFF)
        total = np.zeros(count, dtype=np.uint64)
        for shift in range(length):
            total = total * step + hashes[shift : shift + count]
        return mixed(total + np.uint64(seed))
