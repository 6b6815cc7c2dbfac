"""Words, their hashes and rolling window hashes, over bytes and without a Python object a word.

A Rabin-Karp prefix sum over the bytes of many texts gives every word's polynomial hash (mod 2**64)
in a few vector operations; a second one over the word hashes gives every window's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Space and U+0009 to U+000D.
WHITE_BYTES = bytes([0x20, *range(0x09, 0x0E)])
#: Every ASCII byte but digits and letters.
NON_ALNUM_BYTES = bytes(b for b in range(0x80) if not chr(b).isalnum())
#: Bytes hashed at a time, and bytes of texts that are Python objects at a time.
PIECE = 1 << 18
CHUNK = 2 << 20

_BASES = {"byte": 0x9E3779B97F4A7C15, "word": 0xD1342543DE82EF95, "second": 0xAF251AF3B0F025B5}
_powers: dict[tuple[str, bool], np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit hashes (in place)."""
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(32)
    return h


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values, rising."""
    ordered = np.sort(values)
    return ordered[np.concatenate([[True], ordered[1:] != ordered[:-1]])] if len(ordered) else ordered


def powers(base: str, n: int, inverse: bool = False) -> np.ndarray:
    """base**i (or its inverse) mod 2**64 for i < n."""
    held = _powers.get((base, inverse))
    if held is None or len(held) < n:
        size = max(n, 2 * PIECE)
        b = _BASES[base]
        one = np.full(size, pow(b, -1, 1 << 64) if inverse else b, np.uint64)
        one[0] = 1
        held = _powers[base, inverse] = np.cumprod(one)
    return held[:n]


def window_hashes(h: np.ndarray, k: int, base: str = "word") -> np.ndarray:
    """Rabin-Karp hash of every k consecutive items; empty where there are fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    sums = np.empty(len(h) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(h * powers(base, len(h)), out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * powers(base, n, True))


def span_hashes(h: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: str = "second") -> np.ndarray:
    """Rabin-Karp hash of the items from each start to its end."""
    sums = np.empty(len(h) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(h * powers(base, len(h)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(base, len(h) + 1, True)[starts] + (ends - starts).astype(np.uint64))


class Words:
    """Words are runs of bytes that aren't separators; ``lower`` folds A-Z."""

    def __init__(self, separators: bytes = WHITE_BYTES, lower: bool = False):
        self.is_word = np.ones(256, bool)
        self.is_word[list(separators)] = False
        self.separator = separators[:1]
        value = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        if lower:
            value[65:91] = value[97:123]
        self.value = value

    def spans(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of every word in buf."""
        mask = np.zeros(len(buf) + 2, np.int8)
        mask[1:-1] = self.is_word[buf]
        edge = np.diff(mask)
        return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)

    def hashes(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        sums = np.empty(len(buf) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(self.value[buf] * powers("byte", len(buf)), out=sums[1:])
        return mix((sums[ends] - sums[starts]) * powers("byte", len(buf) + 1, True)[starts])

    def hash_one(self, word: str) -> int:
        buf = np.frombuffer(word.encode(), np.uint8)
        return int(self.hashes(buf, np.array([0]), np.array([len(buf)]))[0])

    def parts(self, text: bytes, limit: int = PIECE) -> Iterator[bytes]:
        """A long text cut at separators into parts of about limit bytes."""
        at, n = 0, len(text)
        while n - at > limit:
            cut = at + limit
            while cut < n:
                gap = np.flatnonzero(~self.is_word[np.frombuffer(text, np.uint8, min(65536, n - cut), cut)])
                if len(gap):
                    cut += int(gap[0])
                    break
                cut += min(65536, n - cut)
            yield text[at:cut]
            at = cut
        yield text[at:]

    def hash_documents(self, texts: list[bytes], limit: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
        """Word hashes of all texts in a row, and the offsets where each text's begin (one more than texts)."""
        counts, out = np.zeros(len(texts), np.int64), []
        wait: list[bytes] = []
        at: list[int] = []
        size = 0

        def flush() -> None:
            nonlocal size
            if not wait:
                return
            buf = np.frombuffer(self.separator.join(wait) + self.separator, np.uint8)
            bounds = np.cumsum([0] + [len(w) + 1 for w in wait])
            starts, ends = self.spans(buf)
            np.add.at(counts, at, np.diff(np.searchsorted(starts, bounds)))
            out.append(self.hashes(buf, starts, ends))
            wait.clear()
            at.clear()
            size = 0

        for i, text in enumerate(texts):
            if size + len(text) > limit:
                flush()
            if len(text) > limit:
                for part in self.parts(text, limit):
                    wait.append(part)
                    at.append(i)
                    flush()
            else:
                wait.append(text)
                at.append(i)
                size += len(text) + 1
        flush()
        return np.concatenate(out) if out else np.empty(0, np.uint64), np.concatenate([[0], np.cumsum(counts)])


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def text_chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, list[bytes]]]:
    """(from, to, texts) for ranges of a string column with about limit bytes each; only one range is Python objects."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).tolist()
    lo = size = 0
    for i, n in enumerate(sizes):
        if i > lo and size + n > limit:
            yield lo, i, as_bytes(column.slice(lo, i - lo))
            lo, size = i, 0
        size += n
    if lo < len(sizes):
        yield lo, len(sizes), as_bytes(column.slice(lo, len(sizes) - lo))


def owners(offsets: np.ndarray) -> np.ndarray:
    """For every item the index of the text it is in."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
