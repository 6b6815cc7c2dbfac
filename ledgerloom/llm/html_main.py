"""Main text of web pages: markup says which blocks are open, a sparse suffix array of the host which of them repeat.

On a page that marks its article (``article``, ``main`` or role=main) the blocks inside that no boilerplate
element holds are open, on any other page all blocks that none holds. Each page is parsed once, and pages travel in
chunks. The suffixes of a host's token streams (open blocks, and as evidence the menus, footers and adverts) are sampled where
a start of RUN tokens has the least hash of STEP starts in a row, so any two places of a substring of RUN + STEP - 1
tokens have a sampled start in common; every whole block of RUN tokens or more is one more. Equal starts of all chunks are
brought together by their hash, a chunk's once, and those that LEAST_PAGES distinct pages of a host have are
repeats: neither a host's size nor the number of chunks matters. Without a mark the unique runs of the open blocks
stay. Articles quote and copy each other, so in a marked one only whole blocks go, and an article most of which is
repeated stays.
"""

from __future__ import annotations

import html
import re
import struct
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import bucket_bits, planes, unplanes
from .shared import stored_and_measured
from .tokens import Words, distinct, mix, span_hashes, window_hashes

#: Tokens of a start, starts of which one at least is sampled, pages that must repeat it.
RUN, STEP, LEAST_PAGES = 8, 8, 3
#: A block that is covered by so much is removed whole; a marked article that is covered by so much is a copy and stays.
COVERED, COPIED = 0.8, 0.5
#: Bytes of text in a chunk, and so about what a task holds; what a page counts beside its text.
CHUNK_BYTES, PAGE_BYTES = 4 << 20, 64
#: How hard a chunk is compressed: as fast as zlib's default here, a quarter smaller.
LEVEL = 12
#: Bytes that stand for a start's hash below its bucket number (4 to 20 bits, more with more pages), and for a source: of
#: three sources two look like one with a chance of 5 in 100,000, and the repeat is seen from the next page on.
LOW_BYTES, TAG_BYTES = 5, 2

#: Elements by what they mean for the main text.
RAW = {"script", "style", "noscript", "template", "textarea", "svg", "math", "iframe", "object", "canvas", "title"}
DROPPED = {"nav", "header", "footer", "aside", "form", "button", "select", "dialog", "menu", "head", "label", "fieldset", "audio", "video"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head",
    "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul", "caption",
}
SPACE = {"br", "td", "th", "wbr", "img", "input"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form"}
MARKS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disclaimer", "disqus", "footer", "gdpr", "header", "masthead", "menu",
    "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pager", "pagination", "popup", "promo", "promotion", "related", "replies", "respond", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}

#: Words that leave a class name of several words what its first word makes it ("ad-slot").
PARTS = {
    "area", "bar", "block", "body", "bottom", "box", "column", "container", "content", "footer", "form", "group", "header", "holder", "inner", "item", "items", "label", "left", "link", "links", "list", "module", "outer", "panel", "region",
    "right", "row", "section", "slot", "text", "thread", "title", "top", "unit", "wrap", "wrapper", "zone",
}

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|</?[a-zA-Z][^>]*(?:>|\Z)", re.S)
ATTR = re.compile(r"(class|id|role|style|hidden|aria-hidden|itemprop)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)


def attributes(text: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'").lower() for k, v in ATTR.findall(text)} if text and not text.isspace() else {}


def is_mark(name: str) -> bool:
    """Whether a class or id is one of MARKS, ends in one ("cookie-notice") or begins with one and says no more ("ad-slot", not "ad-hoc")."""
    words = [w for w in re.split(r"[_-]+", name) if w]
    return bool(words) and (words[-1] in MARKS or words[0] in MARKS and all(w in PARTS or w.isdigit() for w in words[1:]))


def is_boilerplate(name: str, attrs: dict[str, str]) -> bool:
    """Whether an element holds no main text by its name, role, visibility, class or id."""
    if name in DROPPED:
        return True
    if not attrs or name in ("html", "body", "main"):
        return False
    if attrs.get("role") in ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attrs.get("style", "")):
        return True
    named = f"{attrs.get('class', '')} {attrs.get('id', '')}".split()
    # an article may tell of its parts in a compound class, but one of class "comment" is a comment
    return any(t in MARKS for t in named) if name == "article" else any(is_mark(t) for t in named)


def page_blocks(page: str) -> list[tuple[str, bool, bool]]:
    """(text, inside a marked article, dropped by markup) of every block of a page, in order."""
    blocks: list[tuple[str, bool, bool]] = []
    pieces: list[str] = []
    stack: list[tuple[str, bool, bool, list[str] | None]] = []  # name, in an article, dropped, what a dropped inline element interrupts
    depth: Counter[str] = Counter()  # how often each name is on the stack
    article = dropped = False
    raw_until = -1

    def end_block() -> None:
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                blocks.append((text, article, dropped))
            pieces.clear()

    def pop(to: int) -> None:
        nonlocal article, dropped
        while len(stack) > to:
            name, _, _, interrupted = stack[-1]
            if interrupted is not None or name in BLOCK:
                end_block()
            if interrupted is not None:
                pieces.extend(interrupted)
            stack.pop()
            depth[name] -= 1
            article, dropped = stack[-1][1:3] if stack else (False, False)

    at = 0
    for m in TAG.finditer(page):
        if m.start() < raw_until:
            continue
        if m.start() > at:
            pieces.append(html.unescape(page[at : m.start()]))
        at = m.end()
        if m["cdata"]:
            pieces.append(m["cdata"])
        if not m["name"]:
            continue
        name = m["name"].lower()
        if m["end"]:
            if depth[name] and (name in BLOCK or stack[-1][0] == name):
                pop(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
            if name in BLOCK:
                end_block()
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, m.end())
            raw_until = at = end.end() if end else len(page)
            continue
        if name in SPACE:
            pieces.append(" ")
        block = name in BLOCK
        if block:
            end_block()
            if stack and stack[-1][0] == "p":
                pop(len(stack) - 1)
            if name == "li" and stack and stack[-1][0] == "li":
                pop(len(stack) - 1)
        if name in VOID:
            continue
        attrs = attributes(m["attrs"])
        drop = is_boilerplate(name, attrs)
        # an inline element matters where it is dropped, and inside one of its name, whose end its own would be taken for
        if block or drop or depth[name]:
            inside = article or name in ("article", "main") or attrs.get("role") == "main" or attrs.get("itemprop") == "articlebody"
            # the block around a dropped inline element goes on behind it
            stack.append((name, inside, dropped or drop and not (name == "header" and article), None if block else pieces[:] if drop else None))
            if drop and not block:
                pieces.clear()
            depth[name] += 1
            article, dropped = stack[-1][1:3]
    if raw_until < len(page) and at < len(page):
        pieces.append(html.unescape(page[at:]))
    pop(0)
    end_block()
    return blocks


def streams_of(page: str | None) -> tuple[list[tuple[str, bool]], bool]:
    """(text, open) of every block of a page, and whether the page marks its article."""
    blocks = page_blocks(page or "")
    marked = any(article and not dropped for _, article, dropped in blocks)
    return [(t, not dropped and (article or not marked)) for t, article, dropped in blocks], marked


def source_of(blocks: list[tuple[str, bool]]) -> str:
    """What makes a page a source of its own: its open text, or all its text if none is open. Copies are one source."""
    return "\n".join([t for t, is_open in blocks if is_open] or [t for t, _ in blocks])


def kept_text(blocks: list[tuple[str, bool]], marked: bool, covered: np.ndarray, ends: np.ndarray) -> str:
    """The open blocks without what is covered; ends: of each block the end of its tokens in covered."""
    shares = [c.mean() if len(c) else 0.0 for c in np.split(covered, ends[:-1])] if blocks else []
    if marked:
        sizes = np.diff(ends, prepend=0) * np.array([o for _, o in blocks])
        if (sizes * shares).sum() >= COPIED * sizes.sum():
            shares = [0.0] * len(blocks)
    kept = []
    for (text, is_open), share, own in zip(blocks, shares, np.split(covered, ends[:-1]) if blocks else [], strict=True):
        if not is_open or share >= COVERED:
            continue
        if marked or not share:
            kept.append(text)
        else:
            kept.append(b" ".join(w for w, c in zip(text.encode("utf-8", "replace").split(), own, strict=True) if not c).decode())
    return "\n\n".join(kept)


def sampled(w: np.ndarray, step: int = STEP) -> np.ndarray:
    """Places of the least (of equal ones the first) of every ``step`` hashes in a row; of fewer than ``step`` the least."""
    if len(w) < step:
        return np.array([w.argmin()]) if len(w) else np.empty(0, np.int64)
    return distinct(np.lib.stride_tricks.sliding_window_view(w, step).argmin(axis=1) + np.arange(len(w) - step + 1))


class Chunk:
    """Some pages (page_id, url, host, tag and, packed, their blocks) and the tokens of all in a row."""

    def __init__(self, blob: bytes):
        with pa.ipc.open_stream(pa.Codec("zstd").decompress(blob[8:], struct.unpack_from("<Q", blob)[0])) as reader:
            self.rows = reader.read_all()
        self.host, self.tag = self.rows.column("host").to_numpy().view(np.uint64), self.rows.column("tag").to_numpy()
        self.pages = [unpack_page(x) for x in self.rows.column("page").to_pylist()]
        self.tokens, self.offsets = Words().hash_documents([" ".join(t for t, _ in b).encode() for b, _ in self.pages])
        self.ends = [np.cumsum([t.count(" ") + 1 for t, _ in b], dtype=np.int64) for b, _ in self.pages]
        self.starts()

    @staticmethod
    def pack(page_ids: list, urls: list, hosts: list, tags: list, pages: list[str]) -> bytes:
        table = pa.table({"page_id": pa.array(page_ids, pa.int64()), "url": pa.array(urls, pa.string()), "host": pa.array(hosts, pa.int64()), "tag": pa.array(tags, pa.int64()), "page": pa.array(pages, pa.string())})
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, table.schema) as writer:
            writer.write_table(table)
        whole = out.getvalue()
        return struct.pack("<Q", whole.size) + pa.Codec("zstd", compression_level=LEVEL).compress(whole, asbytes=True)

    def starts(self) -> None:
        """begin, end, page of every sampled start and whole block, and in hashes and which what is equal among them."""
        w = window_hashes(self.tokens, RUN)
        begin, page, long, whose = [], [], [], []
        for i, ends in enumerate(self.ends):
            lo, hi = int(self.offsets[i]), int(self.offsets[i + 1])
            own = sampled(w[lo : max(lo, hi - RUN + 1)]) + lo
            begin.append(own)
            page.append(np.full(len(own), i))
            firsts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
            some = np.flatnonzero(ends - firsts >= RUN)
            long.append(np.stack([firsts[some], ends[some]]) + lo)
            whose.append(np.full(len(some), i))
        begin, blocks = np.concatenate([*begin, np.empty(0, np.int64)]), np.concatenate([*long, np.empty((2, 0), np.int64)], axis=1)
        self.begin, self.end = np.concatenate([begin, blocks[0]]), np.concatenate([begin + RUN, blocks[1]])
        self.page = np.concatenate([*page, *whose, np.empty(0, np.int64)]).astype(np.int64)
        keys = np.concatenate([w[begin], span_hashes(self.tokens, blocks[0], blocks[1]) + np.uint64(1)])
        self.hashes, self.which = np.unique(mix(keys ^ self.host[self.page]), return_inverse=True)

    def sources(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each of hashes how many sources have it (at most LEAST_PAGES), and their tags in a row."""
        tags, source = np.unique(self.tag, return_inverse=True)
        start, source = np.divmod(distinct(self.which * max(1, len(tags)) + source[self.page]), max(1, len(tags)))
        counts = np.bincount(start, minlength=len(self.hashes))
        few = np.arange(len(start)) - np.repeat(np.cumsum(counts) - counts, counts) < LEAST_PAGES
        return np.minimum(counts, LEAST_PAGES), tags[source[few]]

    def covered(self, repeats: np.ndarray) -> np.ndarray:
        """Which tokens lie in a start or block whose hash repeats."""
        hit = np.flatnonzero(repeats[self.which])
        depth = np.zeros(len(self.tokens) + 1, np.int64)
        np.add.at(depth, self.begin[hit], 1)
        np.add.at(depth, self.end[hit], -1)
        return np.cumsum(depth[:-1]) > 0

    def main_texts(self, repeats: np.ndarray) -> pa.Table:
        covered = self.covered(repeats)
        texts = [kept_text(blocks, marked, covered[a:b], ends) for (blocks, marked), ends, a, b in zip(self.pages, self.ends, self.offsets[:-1], self.offsets[1:], strict=True)]
        return pa.table({"page_id": self.rows.column("page_id"), "url": self.rows.column("url"), "text": pa.array(texts, pa.string())})


def pack_page(blocks: list[tuple[str, bool]], marked: bool) -> str:
    """Blocks, which have no line feeds, after a line of their marks."""
    head = "".join("o" if is_open else "c" for _, is_open in blocks) + ("m" if marked else "u")
    return "\n".join([head, *(t for t, _ in blocks)]).encode("utf-8", "replace").decode()


def unpack_page(page: str) -> tuple[list[tuple[str, bool]], bool]:
    head, *texts = page.split("\n")
    return [(t, x == "o") for t, x in zip(texts, head, strict=False)], head[-1] == "m"


def chunks(pages: DataFrame) -> DataFrame:
    """(chunk, size, blob) of pages (page_id, url, host, html), each parsed once: packed Chunks of about CHUNK_BYTES."""
    limit = CHUNK_BYTES

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, n, task = 0, 0, TaskContext.get().partitionId() << 32

        def flush() -> pa.RecordBatch:
            nonlocal size, n
            row = pa.RecordBatch.from_arrays([pa.array([task + n], pa.int64()), pa.array([size], pa.int64()), pa.array([Chunk.pack(*(list(x) for x in zip(*held, strict=True)))], pa.binary())], names=["chunk", "size", "blob"])
            held.clear()
            size, n = 0, n + 1
            return row

        for batch in batches:
            for i in range(batch.num_rows):
                blocks, marked = streams_of(batch.column(3)[i].as_py())
                held.append((batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), batch.column(2)[i].as_py(), zlib.crc32(source_of(blocks).encode("utf-8", "replace")), pack_page(blocks, marked)))
                size += PAGE_BYTES + len(held[-1][-1])
                if size >= limit:
                    yield flush()
        if held:
            yield flush()

    return pages.select("page_id", "url", "host", "html").mapInArrow(parse, "chunk long, size long, blob binary")


def repeated_starts(packed: DataFrame, size: int) -> tuple[DataFrame, int]:
    """(chunk, bucket, bits): a bit for each of the chunk's hashes in the bucket, set where LEAST_PAGES sources have it; and the number of bucket bits."""
    bits = bucket_bits(size // 20)
    low = 8 * LOW_BYTES

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = Chunk(blob.as_py())
                counts, tags = own.sources()
                bucket = (own.hashes >> np.uint64(64 - bits)).astype(np.int64)
                rest = own.hashes >> np.uint64(64 - bits - low)
                edges = np.searchsorted(bucket, np.arange((1 << bits) + 1))
                tag_edges = np.concatenate([[0], np.cumsum(counts)])[edges]
                some = np.flatnonzero(np.diff(edges))
                # planes of bytes compress better than number after number
                blobs = [counts[edges[b] : edges[b + 1]].astype(np.uint8).tobytes() + planes(rest[edges[b] : edges[b + 1]], LOW_BYTES) + planes(tags[tag_edges[b] : tag_edges[b + 1]], TAG_BYTES) for b in some]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([name] * len(some), pa.int64()), pa.array(np.diff(edges)[some], pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "chunk", "n", "blob"])

    def judge(group: pa.Table) -> pa.Table:
        starts, pairs, ends = [], [], [0]
        for n, blob in zip(group.column("n").to_pylist(), group.column("blob").to_pylist(), strict=True):
            counts = np.frombuffer(blob, np.uint8, n)
            own = unplanes(blob, n, n, LOW_BYTES)
            starts.append(own)
            pairs.append(np.stack([np.repeat(own, counts), unplanes(blob, n * (1 + LOW_BYTES), int(counts.sum()), TAG_BYTES)]))
            ends.append(ends[-1] + n)
        values, at = np.unique(np.concatenate(starts), return_inverse=True)
        whole = np.concatenate(pairs, axis=1)
        whole = whole[:, np.lexsort((whole[1], whole[0]))]
        new = np.concatenate([[True], (whole[:, 1:] != whole[:, :-1]).any(axis=0)])
        repeats = np.bincount(np.searchsorted(values, whole[0, new]), minlength=len(values))[at] >= LEAST_PAGES
        return pa.table({"chunk": group.column("chunk"), "bucket": group.column("bucket"), "bits": pa.array([np.packbits(repeats[a:b]).tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())})

    sent = packed.select("chunk", "blob").mapInArrow(emit, "bucket int, chunk long, n int, blob binary")
    return sent.groupBy("bucket").applyInArrow(judge, "chunk long, bucket int, bits binary"), bits


def sift_with(bits: int):
    """The function of a chunk and its rows of repeated_starts that gives rows (page_id, url, text)."""

    def sift(group: pa.Table, marks: pa.Table) -> pa.Table:
        own = Chunk(group.column("blob")[0].as_py())
        bucket = (own.hashes >> np.uint64(64 - bits)).astype(np.int64)
        repeats = np.zeros(len(own.hashes), bool)
        for b, packed in zip(marks.column("bucket").to_pylist(), marks.column("bits").to_pylist(), strict=True):
            lo, hi = np.searchsorted(bucket, [b, b + 1])
            repeats[lo:hi] = np.unpackbits(np.frombuffer(packed, np.uint8), count=hi - lo)
        return own.main_texts(repeats)

    return sift


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: page_id, url, text (blocks joined by an empty line; empty if none).

    Null and empty pages give an empty text; markup or references that the page's end cuts off are
    left out or left as they stand. A null url or one without a host counts as the host ''. Rows repeated with
    one id each give their row. Empty tables give no rows; extra columns are ignored.
    """
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    packed, seen = stored_and_measured(chunks(own.withColumn("host", F.xxhash64(host))), F.sum("size").alias("size"))
    marks, bits = repeated_starts(packed, seen["size"] or 0)
    return packed.groupBy("chunk").cogroup(marks.groupBy("chunk")).applyInArrow(sift_with(bits), "page_id long, url string, text string")
