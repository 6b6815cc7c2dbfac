"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items share seeds, hashes of MIN_MATCH words in a row. A bitmap of the benchmark's seeds, of
bounded size, goes to the tasks that read documents, each once; what passes are the few words of a document that
lie in a seed. These fragments and the items' rarest seeds meet in a join. For each pair, matches found by
running Karp-Rabin are marked longest first; a document is contaminated where its tiles, in whatever order
they stand, cover THRESHOLD of the item.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import stored, stored_and_measured
from .tokens import NON_ALNUM_BYTES, Words, mix, owners, text_chunks, window_hashes

MIN_MATCH = 5
THRESHOLD = 0.5
#: Bits of the bitmap for each seed of the benchmark, and the most it has (32 MB); with more seeds it lets more pass.
FILTER_SHARE, FILTER_MOST = 16, 28
#: Bits of the bitmap that one row of it holds.
BLOCK_BITS = 16
TILES = "tiles array<struct<item_at:int,doc_at:int,length:int>>"


# ---- tiling ----


def matches(item: np.ndarray, text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Item places, text places and lengths of all maximal common runs of at least ``least`` words."""
    a, b = window_hashes(item, least), window_hashes(text, least)
    order = np.argsort(a, kind="stable")
    lo, hi = np.searchsorted(a[order], b, "left"), np.searchsorted(a[order], b, "right")
    n = hi - lo
    j = np.repeat(np.arange(len(b)), n)
    i = order[np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]
    along = np.lexsort((i, j - i))
    i, apart = i[along], (j - i)[along]
    begin = np.flatnonzero(np.concatenate([[True], (apart[1:] != apart[:-1]) | (i[1:] != i[:-1] + 1)])) if len(i) else np.empty(0, np.int64)
    return i[begin], i[begin] + apart[begin], np.diff(np.append(begin, len(i))) + least - 1


def greedy_tiles(item: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(item place, text place, length) of the tiles in the order in which they are marked; item and text are word hashes.

    The next tile is always the longest common run of words that no tile holds yet (of equal ones the first in the
    text, then in the item): every such run is part of a maximal one, so those wait in a heap, and one that
    tiles have cut into goes back as what is left of it.
    """
    free_item, free_text = np.ones(len(item), bool), np.ones(len(text), bool)
    heap = [(-n, j, i) for i, j, n in zip(*(x.tolist() for x in matches(item, text, least)), strict=True)]
    heapq.heapify(heap)
    tiles = []
    while heap:
        n, j, i = heapq.heappop(heap)
        free = free_item[i : i - n] & free_text[j : j - n]
        if free.all():
            tiles.append((i, j, -n))
            free_item[i : i - n] = free_text[j : j - n] = False
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]]).astype(np.int8)))
        for lo, hi in edge.reshape(-1, 2).tolist():
            if hi - lo >= least:
                heapq.heappush(heap, (lo - hi, j + lo, i + lo))
    return tiles


# ---- the benchmark ----


def item_classes(benchmark: DataFrame, least: int, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(item_id, cls) of the items of at least ``least`` words, and (cls, words) of their distinct word sequences."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(NON_ALNUM_BYTES, lower=True)
        for batch in batches:
            for lo, hi, texts in text_chunks(batch.column(1)):
                h, offsets = words.hash_documents(texts)
                lengths = np.diff(offsets)
                whole = [int(window_hashes(h[a:b], int(b - a), "second")[0]) if b > a else 0 for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                cls = mix(np.array(whole, np.uint64) + lengths.astype(np.uint64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(cls.view(np.int64)), pa.ListArray.from_arrays(offsets.astype(np.int32), pa.array(h.view(np.int64)))], names=["item_id", "cls", "words"])

    items = stored(benchmark.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(read, "item_id long, cls long, words array<long>").where(F.size("words") >= least))
    return items.select("item_id", "cls"), items.groupBy("cls").agg(F.first("words").alias("words"))


def item_seeds(classes: DataFrame, least: int) -> DataFrame:
    """(cls, pos, seed) of every window of ``least`` words."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            offsets = lists.offsets.to_numpy()
            h, offsets = lists.values.to_numpy()[offsets[0] : offsets[-1]].view(np.uint64), offsets - offsets[0]
            owner, w = owners(offsets), window_hashes(h, least)
            at = np.flatnonzero(owner[: len(w)] == owner[least - 1 :]) if len(w) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner[at])), pa.array((at - offsets[owner[at]]).astype(np.int32)), pa.array(w[at].view(np.int64))], names=["cls", "pos", "seed"])

    return classes.select("cls", "words").mapInArrow(read, "cls long, pos int, seed long")


def rare_seeds(seeds: DataFrame, least: int, threshold: float) -> DataFrame:
    """(seed, cls): of each item so many of its rarest seeds that a document covering the threshold must have one.

    Tiles that cover T words of an item hold at least T / least of its windows, so that many but one can be left out,
    and those are the most frequent: a phrase that thousands of items share brings no pairs where rarer seeds do.
    """
    frequency = seeds.groupBy("seed").agg(F.count("*").alias("items"))
    place = W.partitionBy("cls").orderBy("items", "seed", "pos")
    ranked = seeds.join(frequency, "seed").select("cls", "seed", F.row_number().over(place).alias("rank"), F.count("*").over(W.partitionBy("cls")).alias("windows"))
    needed = F.ceil(F.ceil((F.col("windows") + least - 1) * threshold - 1e-9) / least)
    return ranked.where(F.col("rank") <= F.col("windows") - F.greatest(needed, F.lit(1)) + 1).select("seed", "cls").distinct()


def seed_bitmap(seeds: DataFrame, n_seeds: int) -> np.ndarray:
    """A bit for each range of seed hashes, set where the benchmark has one; at most 2**FILTER_MOST bits, whatever the benchmark's size."""
    bits = int(min(FILTER_MOST, max(BLOCK_BITS, np.ceil(np.log2(max(1, n_seeds * FILTER_SHARE))))))

    def block(group: pa.Table) -> pa.Table:
        held = np.zeros(1 << BLOCK_BITS, bool)
        held[group.column("bit").to_numpy()] = True
        return pa.table({"block": group.column("block").slice(0, 1), "bits": pa.array([np.packbits(held).tobytes()], pa.binary())})

    place = F.shiftrightunsigned("seed", 64 - bits)
    placed = seeds.select(F.shiftright(place, BLOCK_BITS).cast("int").alias("block"), place.bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int").alias("bit")).distinct()
    out = np.zeros(1 << (bits - 3), np.uint8)
    step = 1 << (BLOCK_BITS - 3)
    for row in placed.groupBy("block").applyInArrow(block, "block int, bits binary").toLocalIterator():
        out[row.block * step : (row.block + 1) * step] = np.frombuffer(row.bits, np.uint8)
    return out


# ---- documents ----


def fragments(docs: DataFrame, bitmap: np.ndarray, least: int) -> DataFrame:
    """(key, doc_id, text_key, seeds, words, at) of the rows of docs (doc_id, text_key, text) with seeds that the bitmap has.

    words are those that lie in such a seed, at their places; key numbers the rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    bits = int(len(bitmap)).bit_length() + 2

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, has = Words(NON_ALNUM_BYTES, lower=True), shared.value
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            for lo, _, texts in text_chunks(batch.column(2)):
                h, offsets = words.hash_documents(texts)
                owner, w = owners(offsets), window_hashes(h, least)
                place = w >> np.uint64(64 - bits)
                at = np.flatnonzero(has[(place >> np.uint64(3)).astype(np.int64)] >> (7 - (place & np.uint64(7)).astype(np.uint8)) & 1) if len(w) else np.empty(0, np.int64)
                at = at[owner[at] == owner[at + least - 1]]
                if not len(at):
                    continue
                some, first = np.unique(owner[at], return_index=True)
                ends = np.append(first[1:], len(at))
                near = np.unique(at[:, None] + np.arange(least))
                near_first = np.searchsorted(owner[near], np.append(some, some[-1] + 1))
                lists = lambda edges, values: pa.ListArray.from_arrays(np.asarray(edges, np.int32), pa.array(values))
                keys = key + np.arange(len(some))
                key += len(some)
                rows = pa.array(lo + some)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), batch.column(0).take(rows), batch.column(1).take(rows), lists([0, *ends], w[at].view(np.int64)), lists(near_first, h[near].view(np.int64)), lists(near_first, (near - offsets[owner[near]]).astype(np.int32))],
                    names=["key", "doc_id", "text_key", "seeds", "words", "at"],
                )

    try:
        return stored(docs.select("doc_id", "text_key", "text").mapInArrow(read, "key long, doc_id long, text_key long, seeds array<long>, words array<long>, at array<int>"))
    finally:
        shared.destroy()


def tiled(pairs: DataFrame, least: int, threshold: float) -> DataFrame:
    """(doc_id, text_key, cls, item_words, matched_words, coverage, tiles) of the pairs that tiles cover enough of."""

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text_key, cls, own, words, at in zip(*(batch.column(i) for i in range(6)), strict=True):
                own, words, at = (x.values.to_numpy() for x in (own, words, at))
                # what lies between the places is left out; a number that no item's word has stands for it
                gaps = np.flatnonzero(np.diff(at) > 1) + 1
                kept, where = np.insert(words.view(np.uint64), gaps, np.arange(len(gaps), dtype=np.uint64)), np.insert(at, gaps, -1)
                tiles = greedy_tiles(own.view(np.uint64), kept, least)
                n = sum(t[2] for t in tiles)
                if n >= threshold * len(own):
                    rows.append((doc_id.as_py(), text_key.as_py(), cls.as_py(), len(own), n, n / len(own), [{"item_at": i, "doc_at": int(where[j]), "length": k} for i, j, k in tiles]))
            kinds = [pa.int64()] * 5 + [pa.float64(), pa.list_(pa.struct([("item_at", pa.int32()), ("doc_at", pa.int32()), ("length", pa.int32())]))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["doc_id", "text_key", "cls", "item_words", "matched_words", "coverage", "tiles"])

    wanted = pairs.select("doc_id", "text_key", "cls", "item", "words", "at")
    return wanted.mapInArrow(tile, f"doc_id long, text_key long, cls long, item_words long, matched_words long, coverage double, {TILES}")


def _pairs(docs: DataFrame, benchmark: DataFrame, least: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The contaminated pairs by class of items, and the items of each class. docs: (doc_id, text_key, text)."""
    items, classes = item_classes(benchmark, least)
    seeds, seen = stored_and_measured(item_seeds(classes, least), F.count("*").alias("n"))
    found = fragments(docs, seed_bitmap(seeds, seen["n"]), least)
    met = found.select("key", F.explode("seeds").alias("seed")).join(rare_seeds(seeds, least, threshold), "seed").select("key", "cls").distinct()
    pairs = met.join(found.select("key", "doc_id", "text_key", "words", "at"), "key").join(classes.select("cls", F.col("words").alias("item")), "cls")
    return tiled(pairs, least, threshold), items


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, least: int = MIN_MATCH, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, item_words, matched_words, coverage, tiles of every contaminated pair.

    Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z lowered. Items of fewer than
    ``least`` words, null ones among them, are too short to be evidence and match nothing; null
    and empty documents match nothing. Repeated rows and items each give their rows; tiles are
    (item_at, doc_at, length) in words, longest first. Empty tables give no rows; extra columns are ignored.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("text_key"), F.col(text_col).alias("text"))
    pairs, items = _pairs(own, benchmark, least, threshold)
    return pairs.join(items, "cls").select("doc_id", "item_id", "item_words", "matched_words", "coverage", "tiles")


def keep_clean(docs: DataFrame, benchmark: DataFrame, least: int = MIN_MATCH, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that no item contaminates, with all their columns. Rows with equal id and text share their verdict."""
    key = F.xxhash64(F.col(text_col))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), key.alias("text_key"), F.col(text_col).alias("text"))
    pairs, _ = _pairs(own, benchmark, least, threshold)
    found = stored(pairs.select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key")).distinct())
    return docs.join(found, F.col(id_col).cast("long").eqNullSafe(F.col("_doc")) & (key == F.col("_key")), "left_anti")
