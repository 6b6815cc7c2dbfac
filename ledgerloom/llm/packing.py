"""Hashes on their way to the task that counts them, packed.

A row of a shuffle costs far more than the few bytes of a hash, so a map task sends one blob per
bucket (the hash's top bits) and flush. A blob holds runs: a key and a tag (of a document), a
count, and so many remainders of hashes in the document's order. Fields are laid out byte plane by
byte plane, which lets the shuffle's compressor take out what repeats.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np


def bucket_bits(items: int, a_bucket: int = 2_500_000, least: int = 4, most: int = 20) -> int:
    """Bits of the bucket number so that a bucket has about a_bucket items, up to 2**most buckets."""
    return int(min(most, max(least, np.ceil(np.log2(max(1, items / a_bucket))))))


def planes(a: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1)[:, :width].T.tobytes()


def unplanes(data: bytes, at: int, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T
    return out.view("<u8").ravel()


def pack(values: np.ndarray, width: int, bucket: np.ndarray, owner: np.ndarray, keys: np.ndarray, tags: np.ndarray, n_buckets: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, blob) pairs. Of values the low ``width`` bytes travel; owner: of each value its run (rising)."""
    if not len(values):
        return
    bucket = bucket.astype(np.uint16 if n_buckets <= 1 << 16 else np.uint32)
    order = np.argsort(bucket, kind="stable")
    bucket, owner, values = bucket[order], owner[order], values[order]
    starts = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (owner[1:] != owner[:-1])]))
    lengths = np.diff(np.append(starts, len(values)))
    ids = owner[starts]
    edges, run_edges = np.searchsorted(bucket, np.arange(n_buckets + 1)), np.searchsorted(bucket[starts], np.arange(n_buckets + 1))
    for b in np.flatnonzero(np.diff(edges)):
        runs, rows = slice(run_edges[b], run_edges[b + 1]), slice(edges[b], edges[b + 1])
        i = ids[runs]
        yield (
            int(b),
            struct.pack("<II", len(i), rows.stop - rows.start)
            + planes(keys[i].astype("<u8"), 8)
            + planes(tags[i].astype("<u8"), 4)
            + planes(lengths[runs].astype("<u8"), 4)
            + planes(values[rows].astype("<u8"), width),
        )


def unpack(blobs: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, tags and counts of the runs, and the values' low bytes, of all blobs of a bucket."""
    parts = []
    for blob in blobs:
        runs, n = struct.unpack_from("<II", blob)
        at = 8
        keys = unplanes(blob, at, runs, 8)
        tags = unplanes(blob, at + 8 * runs, runs, 4)
        lengths = unplanes(blob, at + 12 * runs, runs, 4)
        parts.append((keys, tags, lengths.astype(np.int64), unplanes(blob, at + 16 * runs, n, width)))
    return tuple(np.concatenate([p[i] for p in parts]) for i in range(4))
