"""Substring dedup: passages that an earlier document has are cut out of later ones.

Rabin-Karp hashes of every window of ``k`` words are first merged where they are made: of the documents that a map
task holds at a time, one with the smallest id stands for a window, and the others are known to repeat it. What is
left goes, packed, to the task of its bucket, where a window's smallest document is found; a window that
a tenth of all documents have is there once a batch, not once a document. What comes back to a document is which of its
windows are repeats; overlapping windows merge there into maximal removal intervals.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import bucket_bits, pack, planes, unpack, unplanes
from .tokens import CHUNK, Words, owners, text_chunks, window_hashes

WINDOW = 50
#: Bits of a window's hash below its bucket number, at most: with b bucket bits a hash has 56 + b, up to 64.
LOW_BITS = 56
#: Stands for a null id: such a document is never the smallest.
NO_ID = (1 << 63) - 1
FLUSH = 500_000
#: Head of a mark: bucket (LOCAL: bits over all of a document's windows, not hashes of one bucket) and number.
MARK, LOCAL = "<II", (1 << 32) - 1


def low_bits(bits: int) -> int:
    return min(LOW_BITS, 64 - bits)


def _windows(words: Words, texts: list[bytes], k: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of texts, and of each the index of its text."""
    h, offsets = words.hash_documents(texts)
    owner = owners(offsets)
    w = window_hashes(h, k)
    inside = owner[: len(w)] == owner[k - 1 :]
    return w[inside] >> np.uint64(64 - low_bits(bits) - bits), owner[: len(w)][inside]


def merged(values: np.ndarray, owner: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the windows stand for theirs (in the documents of smallest id, once each), and which repeat one of a smaller id here."""
    order = np.argsort(values, kind="stable")
    whose, same = owner[order], np.concatenate([[False], np.diff(values[order]) == 0])[: len(values)]
    first, each = np.flatnonzero(~same), ids[whose]
    later = each > np.repeat(np.minimum.reduceat(each, first), np.diff(np.append(first, len(values)))) if len(values) else same
    # a stable order keeps a document's places together
    again = same & np.concatenate([[False], whose[1:] == whose[:-1]])[: len(values)]
    stands, repeats = np.zeros(len(values), bool), np.zeros(len(values), bool)
    stands[order], repeats[order] = ~later & ~again, later
    return stands, repeats


def _packed_marks(part: np.ndarray, keys: np.ndarray, tags: np.ndarray, marks: list[bytes]) -> list[tuple[int, bytes]]:
    """(part, blob) of marks: documents by key and tag, each with a mark, dealt by part."""
    order = np.argsort(part, kind="stable")
    rows = []
    for own in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(order) else []:
        blobs = [marks[i] for i in own]
        head = struct.pack("<I", len(own)) + keys[own].tobytes() + tags[own].astype("<u4").tobytes() + np.array([len(m) for m in blobs], "<u4").tobytes()
        rows.append((int(part[own[0]]), head + b"".join(blobs)))
    return rows


def repeated_windows(docs: DataFrame, k: int = WINDOW) -> tuple[DataFrame, int]:
    """(doc_id, tag, marks) of documents with windows that start in a smaller one too.

    ``docs`` has doc_id (long) and text; tag is the text's CRC-32. marks: MARK with the low parts of the hashes, in a
    bucket, of windows that are repeats, or with a bit for each of the document's windows that its batch knew. The
    second value is the number of bucket bits.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = bucket_bits(size // 6)
    low = low_bits(bits)
    width = (low + 7) // 8
    known = 1 << bits  # from here on a bucket number is a part's, whose blob holds marks already

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        held: list[tuple] = []
        n = 0

        def flush() -> pa.RecordBatch:
            base = np.cumsum([0] + [len(x[2]) for x in held])
            values = np.concatenate([x[0] for x in held])
            owner = np.concatenate([x[1] + b for x, b in zip(held, base, strict=False)])
            ids, tags = (np.concatenate([x[i] for x in held]) for i in (2, 3))
            held.clear()
            stands, repeats = merged(values, owner, ids)
            keys = ids.view(np.uint64)
            got = list(pack(values[stands], width, values[stands] >> np.uint64(low), owner[stands], keys, tags, 1 << bits))
            some = np.unique(owner[repeats])
            lo, hi = np.searchsorted(owner, some, "left"), np.searchsorted(owner, some, "right")
            marks = [struct.pack(MARK, LOCAL, b - a) + np.packbits(repeats[a:b]).tobytes() for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
            got += [(known + part, blob) for part, blob in _packed_marks((tags[some] & np.uint64(known - 1)).astype(np.int64), keys[some], tags[some], marks)]
            return pa.RecordBatch.from_pydict({"bucket": pa.array([b for b, _ in got], pa.int32()), "blob": pa.array([x for _, x in got], pa.binary())})

        for batch in batches:
            ids = np.array([NO_ID if x is None else x for x in batch.column(0).to_pylist()], np.int64)
            for lo, hi, own in text_chunks(batch.column(1)):
                values, owner = _windows(words, own, k, bits)
                held.append((values, owner, ids[lo:hi], np.array([zlib.crc32(t) for t in own], np.uint64)))
                n += len(values)
                if n >= FLUSH:
                    yield flush()
                    n = 0
        if held:
            yield flush()

    def judge(group: pa.Table) -> pa.Table:
        bucket, blobs = group.column("bucket")[0].as_py(), group.column("blob")
        if bucket >= known:
            return pa.table({"part": pa.array([bucket - known] * len(blobs), pa.int32()), "blob": blobs})
        keys, tags, lengths, rest = unpack(blobs.to_pylist(), width)
        del blobs, group
        run = np.repeat(np.arange(len(keys), dtype=np.int32), lengths)
        order = np.argsort(rest, kind="stable").astype(np.int32)
        ordered = rest[order]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        del ordered
        each = keys.view(np.int64)[run[order]]
        repeats = np.empty(len(rest), bool)
        repeats[order] = each > np.repeat(np.minimum.reduceat(each, first), np.diff(np.append(first, len(rest))))
        del order, each
        at = np.flatnonzero(repeats)
        some, begin = np.unique(run[at], return_index=True)
        marks = [struct.pack(MARK, bucket, len(own)) + planes(rest[own], width) for own in np.split(at, begin[1:])] if len(at) else []
        rows = _packed_marks((tags[some] & np.uint64(known - 1)).astype(np.int64), keys[some], tags[some], marks)
        return pa.table({"part": pa.array([r[0] for r in rows], pa.int32()), "blob": pa.array([r[1] for r in rows], pa.binary())})

    def gather(group: pa.Table) -> pa.Table:
        found: dict[tuple[int, int], list[bytes]] = {}
        for blob in group.column("blob").to_pylist():
            n = struct.unpack_from("<I", blob)[0]
            ids, tags, sizes = (np.frombuffer(blob, kind, n, 4 + at * n) for kind, at in (("<i8", 0), ("<u4", 8), ("<u4", 12)))
            ends = (np.cumsum(sizes, dtype=np.int64) + 4 + 16 * n).tolist()
            for doc_id, tag, size, end in zip(ids.tolist(), tags.tolist(), sizes.tolist(), ends, strict=True):
                found.setdefault((doc_id, tag), []).append(blob[end - size : end])
        return pa.table({"doc_id": pa.array([k[0] for k in found], pa.int64()), "tag": pa.array([k[1] for k in found], pa.int64()), "marks": pa.array([b"".join(v) for v in found.values()], pa.binary())})

    packed = docs.select("doc_id", "text").mapInArrow(emit, "bucket int, blob binary")
    parts = packed.groupBy("bucket").applyInArrow(judge, "part int, blob binary")
    return parts.groupBy("part").applyInArrow(gather, "doc_id long, tag long, marks binary"), bits


def spans_of(starts: np.ndarray, n_words: int, k: int) -> list[tuple[int, int]]:
    """Maximal intervals [from, to) of the words that windows of k words at starts cover."""
    depth = np.zeros(n_words + 1, np.int64)
    depth[starts] += 1
    depth[np.minimum(starts + k, n_words)] -= 1
    edge = np.diff(np.concatenate([[0], (np.cumsum(depth[:-1]) > 0).astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


def remove_repeats(docs: DataFrame, k: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, spans (removed word ranges), kept_text.

    Words are runs of non-white-space (U+0009 to U+000D and space), taken as they are; null texts have
    none. kept_text joins the words that stay by one space. A window is removed where its words
    also start in a document of smaller id; rows repeated with one id don't touch each other, and
    a null id is never smaller. Texts with fewer than k words stay. Extra columns are ignored.
    """
    own = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    repeats, bits = repeated_windows(own, k)
    joined = own.withColumn("tag", F.crc32("text")).join(repeats, ["doc_id", "tag"], "left").select("doc_id", "text", "marks")
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("kept_text", pa.string())])

    low = low_bits(bits)
    width = (low + 7) // 8

    def starts_of(words: Words, text: bytes, marks: bytes) -> np.ndarray:
        values, _ = _windows(words, [text], k, bits)
        gone, hit, at = np.zeros(len(values), bool), [], 0
        while at < len(marks):
            bucket, n = struct.unpack_from(MARK, marks, at)
            at += struct.calcsize(MARK)
            if bucket == LOCAL:
                gone |= np.unpackbits(np.frombuffer(marks, np.uint8, (n + 7) // 8, at), count=n).astype(bool)
                at += (n + 7) // 8
            else:
                hit.append(unplanes(marks, at, n, width) | np.uint64(bucket) << np.uint64(low))
                at += n * width
        return np.flatnonzero(gone | np.isin(values, np.concatenate(hit)) if hit else gone)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for lo, hi, texts in text_chunks(batch.column(1), 2 * CHUNK):
                rows = []
                for doc_id, text, marks in zip(ids[lo:hi], texts, batch.column(2).slice(lo, hi - lo).to_pylist(), strict=True):
                    own = text.split()
                    spans = spans_of(starts_of(words, text, marks), len(own), k) if marks else []
                    n = len(own)
                    for a, b in reversed(spans):
                        del own[a:b]
                    rows.append((None if doc_id == NO_ID else doc_id, n, n - len(own), [{"start": a, "end": b} for a, b in spans], b" ".join(own)))
                columns = [pa.array(c, f.type if f.name != "kept_text" else pa.binary()) for c, f in zip(zip(*rows, strict=True), schema, strict=True)]
                columns[-1] = columns[-1].cast(pa.string())
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return joined.mapInArrow(apply, "doc_id long, n_words long, n_removed long, spans array<struct<start:int,end:int>>, kept_text string")
