"""Words of UTF-8 texts and their 64-bit hashes, as numpy arrays.

A word is a run of bytes of a fixed class; words are hashed by sums over a random table, weighted
with powers of an odd number, so that one running sum over the bytes serves all words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
BLANKS = (32, 9, 10, 11, 12, 13)
#: True for the bytes of words that white space separates.
VISIBLE = np.ones(256, dtype=bool)
VISIBLE[list(BLANKS)] = False
#: True for digits, lower-case letters and every byte of a character beyond ASCII.
LETTERS = np.zeros(256, dtype=bool)
LETTERS[48:58] = LETTERS[97:123] = LETTERS[128:] = True

PIECE = 1 << 21
#: Bytes of rows that are worked on together, about.
JOINED = 1 << 16
BASE = np.uint64(0x9E3779B97F4A7C15)
TABLE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers["up"].size < n:
        size = max(n, 2 * _powers["up"].size, 1 << 14)
        for name, factor in (("up", int(BASE)), ("down", pow(int(BASE), -1, 1 << 64))):
            steps = np.full(size, factor, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def word_spans(data: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(data.size + 2, dtype=np.int8)
    inside[1:-1] = table[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[0::2], edges[1::2]


def _piece_words(data: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words, their last two bytes, and where they start."""
    starts, ends = word_spans(data, table)
    if starts.size == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), starts
    up, down = _grown(data.size + 1)
    sums = np.zeros(data.size + 1, dtype=np.uint64)
    np.cumsum(TABLE[data] * up[:-1], out=sums[1:])
    tails = data[ends - 1].astype(np.int64) * 256 + data[np.maximum(ends - 2, starts)]
    return mix((sums[ends] - sums[starts]) * down[starts]), tails, starts


def words_and_tails(text: bytes, table: np.ndarray = VISIBLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a text in order, and the last two bytes of each as a number. Long
    texts go in pieces that end between words."""
    data = np.frombuffer(text, dtype=np.uint8)
    if data.size <= PIECE:
        return _piece_words(data, table)[:2]
    parts, at = [], 0
    while at < data.size:
        end = at + PIECE
        while end < data.size:  # the next byte that is in no word
            gap = np.flatnonzero(~table[data[end : end + PIECE]])
            if gap.size:
                end += int(gap[0])
                break
            end += PIECE
        parts.append(_piece_words(data[at:end], table)[:2])
        at = end
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def words_and_tails_of_rows(rows: list[bytes], table: np.ndarray = VISIBLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """words_and_tails of all texts, laid end to end, and the number of words of each. Short texts
    are worked on together, with a blank, which is in no word, between them."""
    ends = np.cumsum([0] + [len(r) + 1 for r in rows])
    parts, counts, low = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))], np.zeros(len(rows), np.int64), 0
    while low < len(rows):
        high = max(low + 1, int(np.searchsorted(ends, ends[low] + JOINED, "right")) - 1)
        if high == low + 1:
            parts.append(words_and_tails(rows[low], table))
            counts[low] = parts[-1][0].size
        else:
            words, tails, starts = _piece_words(np.frombuffer(b" ".join(rows[low:high]), dtype=np.uint8), table)
            parts.append((words, tails))
            counts[low:high] = np.diff(np.searchsorted(starts, ends[low : high + 1] - ends[low]))
        low = high
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), counts


def word_hashes(text: bytes, table: np.ndarray = VISIBLE) -> np.ndarray:
    return words_and_tails(text, table)[0]


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words."""
    if words.size < n:
        return np.zeros(0, np.uint64)
    total = np.full(words.size - n + 1, np.uint64(n), dtype=np.uint64)
    for k in range(n):
        total = (total * BASE) + words[k : words.size - n + 1 + k]
    return mix(total)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def texts(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return column.cast(pa.large_binary()).to_pylist()


def lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column of numpy arrays."""
    offsets = np.zeros(len(arrays) + 1, dtype=np.int32)
    np.cumsum([a.size for a in arrays], out=offsets[1:])
    flat = np.concatenate(arrays) if arrays else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=kind))
