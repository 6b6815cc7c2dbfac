"""Self join of documents on the Jaccard similarity of their word n-grams, exact, for components.

Equal n-gram sets become one class. Every n-gram's number of classes is counted in packed buckets;
from that a class sorts its n-grams rare first. N-grams of one class alone come first of all, can
match nothing and aren't kept: most classes have more of them than their prefix is long, and are
done. The others join on the n-grams of their prefixes, under length, positional and suffix
filters, and each pair is verified once.

A pair within a component that is known already tells nothing new. So groups of an n-gram are first
linked through a few hashed centres; then only pairs across the components found so far are
made, of which each has a side outside the n-gram's largest component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .packing import bucket_bits, pack, unpack
from .shared import attach, components, stored, stored_and_measured
from .tokens import Words, mix, owners, text_chunks, window_hashes

NGRAM = 5
#: Least similarity in percent.
PERCENT = 75
#: Bits of an n-gram's hash; above them stands the code of its class count, so tokens sort rare first.
HASH_BITS = 52
FLUSH = 750_000
BUCKET_ITEMS = 2_500_000
#: Centres of an n-gram's group.
CENTRES = 6
#: Classes that the suffix filter divides n-grams into, by hash.
PARTS = 8


def ngram_sets(words: Words, texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each text (sorted, text after text), their texts, counts and set signatures.

    A text of 1 to k - 1 words has one n-gram, its whole sequence; one without words has none.
    """
    h, offsets = words.hash_documents(texts)
    owner = owners(offsets)
    w = window_hashes(h, k)
    inside = owner[: len(w)] == owner[k - 1 :] if len(w) else np.empty(0, bool)
    lengths = np.diff(offsets)
    short = np.flatnonzero((lengths > 0) & (lengths < k))
    whole = np.array([window_hashes(h[offsets[i] : offsets[i + 1]], int(lengths[i]), "second")[0] ^ np.uint64(lengths[i]) for i in short], np.uint64)
    keys = np.concatenate([w[inside], whole]) >> np.uint64(64 - HASH_BITS)
    keys |= np.concatenate([owner[: len(w)][inside], short]).astype(np.uint64) << np.uint64(HASH_BITS)
    keys.sort()
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
    owner = (keys >> np.uint64(HASH_BITS)).astype(np.int64)
    values = keys & np.uint64((1 << HASH_BITS) - 1)
    counts = np.bincount(owner, minlength=len(texts))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values + np.uint64(1)))])
    ends = np.cumsum(counts)
    signatures = mix(sums[ends] - sums[ends - counts] + counts.astype(np.uint64))
    return values, owner, counts, signatures


def _groups(column: pa.Array) -> Iterator[tuple[int, int, list[bytes]]]:
    """Ranges of texts of bounded size and at most 4096 texts, which the sort key has room for."""
    for lo, hi, texts in text_chunks(column):
        for at in range(lo, hi, 4096):
            yield at, min(hi, at + 4096), texts[at - lo : at - lo + 4096]


def signatures(docs: DataFrame, k: int = NGRAM) -> DataFrame:
    """doc_id, n (size of the n-gram set), sig (signature of the set; null where empty)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(lower=True)
        for batch in batches:
            for lo, hi, texts in _groups(batch.column(1)):
                _, _, counts, sigs = ngram_sets(words, texts, k)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(counts), pa.array(sigs.view(np.int64), mask=counts == 0)], names=["doc_id", "n", "sig"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(emit, "doc_id long, n long, sig long")


def shared_tokens(docs: DataFrame, total: int, k: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """(sig, n, u, tokens, behind) of the classes that can have a neighbour.

    tokens: the n-grams that other classes have too, rare first, as (class count code, hash) in one
    long; u: how many it has alone; behind: of each token in the prefix, how many tokens behind it fall in each
    of PARTS hash classes, a byte each (255 stands for more too, which only lowers the filter's bound).
    """
    bits = bucket_bits(total, BUCKET_ITEMS)
    low_bits = HASH_BITS - bits
    width = (low_bits + 7) // 8

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = Words(lower=True), set()
        held: list[tuple] = []
        n = 0

        def flush() -> pa.RecordBatch:
            seen.clear()
            base = np.cumsum([0] + [len(x[2]) for x in held])
            values = np.concatenate([x[0] for x in held])
            owner = np.concatenate([x[1] + b for x, b in zip(held, base, strict=False)])
            keys, tags = (np.concatenate([x[i] for x in held]) for i in (2, 3))
            got = list(pack(values, width, values >> np.uint64(low_bits), owner, keys, tags, 1 << bits))
            held.clear()
            return pa.RecordBatch.from_pydict({"bucket": pa.array([b for b, _ in got], pa.int32()), "blob": pa.array([x for _, x in got], pa.binary())})

        for batch in batches:
            for _, _, texts in _groups(batch.column(0)):
                values, owner, counts, sigs = ngram_sets(words, texts, k)
                new = np.zeros(len(sigs), bool)
                for i, s in enumerate(sigs.tolist()):
                    if counts[i] and s not in seen:
                        seen.add(s)
                        new[i] = True
                inside = new[owner]
                held.append((values[inside], owner[inside], sigs, counts.astype(np.uint64)))
                n += int(inside.sum())
                if n >= FLUSH:
                    yield flush()
                    n = 0
        if held:
            yield flush()

    def count(group: pa.Table) -> pa.Table:
        keys, tags, lengths, low = unpack(group.column("blob").to_pylist(), width)
        _, first = np.unique(keys, return_index=True)
        once = np.zeros(len(keys), bool)
        once[first] = True
        low = low[np.repeat(once, lengths)]
        keys, tags, lengths = keys[once], tags[once], lengths[once]
        order = np.argsort(low, kind="stable").astype(np.int32)
        ordered = low[order]
        starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])).astype(np.int32)
        del ordered
        sizes = np.diff(np.append(starts, np.int32(len(low))))
        code = np.minimum(np.floor(64 * np.log2(sizes)), 2047).astype(np.uint16)
        codes = np.empty(len(low), np.uint16)
        codes[order] = np.repeat(code, sizes)
        del order, starts, sizes, code
        shared = codes > 0
        owner = np.repeat(np.arange(len(keys), dtype=np.int32), lengths)[shared]
        bucket = np.uint64(group.column("bucket")[0].as_py())
        values = codes[shared].astype(np.uint64) << np.uint64(HASH_BITS) | bucket << np.uint64(low_bits) | low[shared]
        got = list(pack(values, 8, keys[owner] >> np.uint64(64 - bits), owner, keys, tags, 1 << bits))
        return pa.table({"part": pa.array([b for b, _ in got], pa.int32()), "blob": pa.array([x for _, x in got], pa.binary())})

    def gather(group: pa.Table) -> pa.Table:
        keys, tags, lengths, values = unpack(group.column("blob").to_pylist(), 8)
        sigs, first, index = np.unique(keys, return_index=True, return_inverse=True)
        owner = np.repeat(index.astype(np.int32), lengths)
        s = np.bincount(owner, minlength=len(sigs))
        n = tags[first].astype(np.int64)
        u = n - s
        alive = u < n - (percent * n + 99) // 100 + 1
        inside = alive[owner]
        owner, values = owner[inside], values[inside]
        order = np.lexsort((values, owner))
        owner, values = owner[order], values[order]
        some = np.flatnonzero(alive)
        ends = np.cumsum(s[some])
        prefix = np.minimum(np.maximum(0, n[some] - (percent * n[some] + 99) // 100 + 1 - u[some]), s[some])
        at = np.repeat(ends - s[some] - np.cumsum(prefix) + prefix, prefix) + np.arange(int(prefix.sum()))
        last = np.repeat(ends, prefix) - 1
        behind = np.empty((len(at), PARTS), np.uint8)
        for c in range(PARTS):
            upto = np.cumsum(values % np.uint64(PARTS) == c, dtype=np.int32)
            behind[:, c] = np.minimum(upto[last] - upto[at], 255) if len(at) else 0
        lists = lambda counts, rows: pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), pa.array(rows.view(np.int64).ravel()))
        return pa.table({"sig": pa.array(sigs[some].view(np.int64)), "n": pa.array(n[some]), "u": pa.array(u[some]), "tokens": lists(s[some], values), "behind": lists(prefix, behind)})

    packed = docs.select("text").mapInArrow(emit, "bucket int, blob binary")
    parts = packed.groupBy("bucket").applyInArrow(count, "part int, blob binary")
    return parts.groupBy("part").applyInArrow(gather, "sig long, n long, u long, tokens array<long>, behind array<long>")


def _linked(pairs: DataFrame, records: DataFrame, percent: int) -> DataFrame:
    """The rows of pairs (a, b and more columns) that link."""
    side = lambda x: records.select(F.col("sig").alias(x), F.col("n").alias(f"_n_{x}"), F.col("tokens").alias(f"_t_{x}"))
    common = F.size(F.array_intersect("_t_a", "_t_b"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(100 * common >= percent * (F.col("_n_a") + F.col("_n_b") - common)).select(*pairs.columns)


def _could_link(a: str, b: str, percent: int, first: bool) -> Column:
    """Length, positional and suffix filters for two postings of a token, structs (n, u, pos, behind).

    Of the tokens behind the match, as many differ as their counts by hash class do at least, which bounds the
    overlap. ``first``: only a pair's first common token need let it through, so nothing before it is common.
    """
    of = lambda side, name: F.col(f"{side}.{name}")
    byte = lambda side, i: F.shiftrightunsigned(of(side, "behind"), 8 * i).bitwiseAND(F.lit(255))
    rest = lambda side: of(side, "n") - of(side, "pos") - 1
    apart = sum((F.abs(byte(a, i) - byte(b, i)) for i in range(1, PARTS)), F.abs(byte(a, 0) - byte(b, 0)))
    before = F.lit(0) if first else F.least(of(a, "pos") - of(a, "u"), of(b, "pos") - of(b, "u"))
    both = of(a, "n") + of(b, "n")
    length = 100 * F.least(of(a, "n"), of(b, "n")) >= percent * F.greatest(of(a, "n"), of(b, "n"))
    positional = (100 + percent) * (before + 1 + F.least(rest(a), rest(b))) >= percent * both
    suffix = (100 + percent) * (2 * (before + 1) + rest(a) + rest(b) - apart) >= 2 * percent * both
    return length & positional & suffix


def _postings(records: DataFrame, *more: str) -> DataFrame:
    """(token, p, more) of every token in a record's prefix; p: struct (sig, n, u, pos, behind)."""
    placed = records.select("sig", "n", "u", *more, F.slice("tokens", F.lit(1), F.size("behind")).alias("_t"), "behind").select("sig", "n", "u", *more, F.posexplode(F.arrays_zip(F.col("_t").alias("t"), "behind")).alias("i", "z"))
    return placed.select(F.col("z.t").alias("token"), F.struct("sig", "n", "u", (F.col("u") + F.col("i")).alias("pos"), F.col("z.behind").alias("behind")).alias("p"), *more)


def _pair(a: str, b: str) -> list[Column]:
    """The smaller signature first."""
    return [F.least(f"{a}.sig", f"{b}.sig").alias("a"), F.greatest(f"{a}.sig", f"{b}.sig").alias("b")]


def link_components(records: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Components of the classes under all links between them: (node, root) of every class in one but its root."""
    postings = _postings(records)
    centres = [F.min(F.struct(F.xxhash64(F.col("p.sig"), F.lit(i)).alias("h"), "p")) for i in range(CENTRES)]
    groups = postings.groupBy("token").agg(F.array_distinct(F.transform(F.array(*centres), lambda c: c["p"])).alias("cs"), F.count("*").alias("m")).where("m > 1").select("token", "cs")
    near = postings.join(groups, "token").select("p", F.explode("cs").alias("c")).where(F.col("p.sig") != F.col("c.sig"))
    tried, seen = stored_and_measured(near.where(_could_link("p", "c", percent, first=False)).select(*_pair("p", "c")).distinct(), F.count("*").alias("n"))
    links = _linked(tried, records, percent) if seen["n"] else tried
    known = components(links)

    # across components: every pair that the centres didn't try, made at the tokens that both prefixes have
    labelled = _postings(records.join(known.toDF("sig", "root"), "sig", "left").withColumn("comp", F.coalesce("root", "sig")), "comp")
    sizes = labelled.groupBy("token", "comp").agg(F.count("*").alias("m")).groupBy("token").agg(F.max_by("comp", F.struct("m", "comp")).alias("top"), F.count("*").alias("comps")).where("comps > 1")
    mixed, seen = stored_and_measured(labelled.join(sizes.select("token", "top"), "token"), F.count("*").alias("n"))
    if not seen["n"]:
        return known
    # sets that link have about equal sizes: they are at most one step of this scale apart
    step = F.floor(F.log(F.col("p.n").cast("double")) / max(1e-3, 1.001 * math.log(100 / percent)))
    left = mixed.where("comp <> top").select("token", F.col("p").alias("l"), F.col("comp").alias("comp_l"), "top", F.explode(F.array(step - 1, step, step + 1)).alias("step"))
    right = mixed.select("token", F.col("p").alias("r"), F.col("comp").alias("comp_r"), step.alias("step"))
    other = (F.col("comp_l") != F.col("comp_r")) & ((F.col("comp_r") == F.col("top")) | (F.col("l.sig") < F.col("r.sig")))
    made = left.join(right, ["token", "step"]).where(other & _could_link("l", "r", percent, first=True))
    low = F.col("l.sig") < F.col("r.sig")
    fresh = made.select(*_pair("l", "r"), F.when(low, F.col("comp_l")).otherwise(F.col("comp_r")).alias("comp_a"), F.when(low, F.col("comp_r")).otherwise(F.col("comp_l")).alias("comp_b"), F.lit(False).alias("old"))
    both = fresh.union(tried.select("a", "b", F.lit(None).cast("long"), F.lit(None).cast("long"), F.lit(True)))
    untried = both.groupBy("a", "b").agg(F.max("old").alias("old"), F.max("comp_a").alias("comp_a"), F.max("comp_b").alias("comp_b")).where("not old").drop("old")
    across = components(_linked(untried, records, percent).select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b"))).toDF("comp", "up")
    # known has no row of its own for a component's root; across has, where it moves
    return stored(known.join(across, F.col("root") == F.col("comp"), "left").select("node", F.coalesce("up", "root").alias("root")).union(across))


def near_duplicates(docs: DataFrame, k: int = NGRAM, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable by links).

    Words are runs of non-white-space with A-Z lowered. Texts without words, null among them, link with
    nothing; texts of fewer than k words link with equal ones only. Rows repeated with one id share
    its component; a null id is nobody's component_id. Extra columns are ignored.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = stored(signatures(own, k))
    classes, total = stored_and_measured(signed.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.first("n").alias("n")), F.sum("n").alias("n"), F.sum("copies").alias("copies"), F.count("*").alias("classes"))
    records = stored(shared_tokens(own, total["n"] or 0, k, percent))
    linked = link_components(records, percent)
    # the root is smallest by signature, the component's id by document; only linked classes take part
    own_root = linked.select(F.col("root").alias("node"), "root").distinct()
    members = classes.join(linked.union(own_root).toDF("sig", "root"), "sig", "left")
    lowest = stored(members.where("root is not null").groupBy("root").agg(F.min("first_id").alias("low"), F.count("*").alias("size")))
    rooted = attach(members, lowest, "root", "size", total["classes"], F.col("sig"))
    roots = stored(rooted.select("sig", F.when(F.col("root").isNull(), F.col("first_id")).otherwise(F.col("low")).alias("component_id"), "copies"))
    out = attach(signed, roots, "sig", "copies", total["copies"] or 0, F.coalesce("doc_id", F.lit(0)))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id is their component's smallest, with all their columns."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col)
    stay = stored(found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id"))
    return docs.join(stay, docs[id_col].eqNullSafe(stay["doc_id"]), "left_semi")
