import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.llm import exact_dedup, ngram_join, packing, shared, substring, tokens

from .helpers import docs, lowered, odd_rows, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- tokens ----


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("aB é\n\t\x1c-1 "), max_size=30), max_size=8), st.integers(1, 40))
def test_word_hashes_agree_with_words(texts, limit):
    w = tokens.Words(lower=True)
    h, offsets = w.hash_documents([t.encode() for t in texts], limit)
    for i, t in enumerate(texts):
        own = WORD.findall(lowered(t))
        assert len(own) == offsets[i + 1] - offsets[i]
        assert [w.hash_one(x) for x in own] == h[offsets[i] : offsets[i + 1]].tolist()


def test_window_hashes_depend_on_words_alone():
    h = tokens.mix(np.arange(1, 60, dtype=np.uint64))
    both = tokens.window_hashes(np.concatenate([h, h[::-1], h]), 7)
    assert (both[:53] == both[118 : 118 + 53]).all()
    assert len(set(both[:53].tolist())) == 53
    assert len(tokens.window_hashes(h[:3], 7)) == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 2**40 - 1)), max_size=60))
def test_packing_round_trip(items):
    items.sort(key=lambda x: x[0])
    owner, values = np.array([o for o, _ in items], np.int64), np.array([v for _, v in items], np.uint64)
    keys, tags = np.array([9, 2**63 + 5, 7, 1], np.uint64), np.array([1, 2, 3, 2**32 - 1], np.uint64)
    got = []
    for bucket, blob in packing.pack(values, 4, values >> np.uint64(32), owner, keys, tags, 256):
        k, t, n, low = packing.unpack([blob], 4)
        got += zip(np.repeat(k, n).tolist(), np.repeat(t, n).tolist(), ((bucket << 32) | low.astype(object)).tolist(), strict=True)
    assert sorted(got) == sorted((int(keys[o]), int(tags[o]), v) for o, v in items)


# ---- exact dedup ----


def exact_brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((i, t or ""))
    out = []
    for key, members in groups.items():
        keep = sorted(members, key=lambda m: (-len(m[1]), m[0]))[0][0]
        out += [(i, keep, len(members), i == keep, hashlib.sha256(key.encode()).hexdigest()) for i, _ in members]
    return sorted(out)


def test_exact_dedup_odd_rows(spark):
    rows = [r for r in odd_rows() if r[0] is not None] + [(20, "o n e t w o"), (21, "onetwo")]
    got = sorted(tuple(r) for r in exact_dedup.deduplicate(docs(spark, rows, "digest keep_id kept group_size")).collect())
    assert got == exact_brute(rows)


def test_exact_dedup_empty_and_null_id(spark):
    assert exact_dedup.deduplicate(docs(spark, [])).count() == 0
    assert exact_dedup.deduplicate(docs(spark, [(None, "a"), (None, None)])).count() == 2
    assert exact_dedup.keep_unique(docs(spark, [])).count() == 0


def test_index_keeps_what_came_first(spark):
    index = exact_dedup.DigestIndex(spark, buckets=3)
    exact_dedup.deduplicate(docs(spark, [(5, "a b"), (6, "c")]), index)
    got = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.deduplicate(docs(spark, [(1, "ab"), (2, "d"), (3, " d ")]), index).collect()}
    assert got == {1: (5, False), 2: (3, False), 3: (3, True)}
    assert index.table().count() == 3


def test_batches_do_not_change_the_result(spark):
    rows = [r for r in odd_rows() if r[0] is not None] + [(i, "x" * (i % 5) + " " * (i % 3) + "y") for i in range(30, 90)]
    for n in (1, 2, 5):
        assert sorted(tuple(r) for r in exact_dedup.deduplicate(docs(spark, rows), batches=n).collect()) == exact_brute(rows)


def test_index_reopens_and_keeps_its_rows(spark, tmp_path):
    path, name = str(tmp_path / "index"), "kept_index"
    first = exact_dedup.DigestIndex(spark, name, path, buckets=3)
    exact_dedup.deduplicate(docs(spark, [(5, "a b"), (6, "c")]), first)
    assert exact_dedup.DigestIndex(spark, name).table().count() == 2
    with pytest.raises(ValueError):
        exact_dedup.DigestIndex(spark, name, str(tmp_path / "elsewhere"))
    spark.sql(f"DROP TABLE {name}")
    held, session = spark.conf.get("spark.sql.shuffle.partitions"), spark.newSession()
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        session.conf.set("spark.sql.shuffle.partitions", "9")
        for s, n in ((spark, "again_a"), (session, "again_b")):
            again = exact_dedup.DigestIndex(s, n, path)
            assert again.buckets == 3
            rows = s.createDataFrame([(1, "ab"), (2, "d" + n)], "doc_id long, text string")
            assert {r.doc_id: r.keep_id for r in exact_dedup.deduplicate(rows, again).collect()} == {1: 5, 2: 2}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    small = again.compacted("small_index", str(tmp_path / "small"))
    assert sorted(map(tuple, small.table().collect())) == sorted(map(tuple, again.table().collect())) and small.table().count() == 4
    assert "Exchange" not in small.table()._jdf.queryExecution().executedPlan().toString().replace("AQEShuffleRead", "")
    for x in ("again_a", "again_b", "small_index"):
        spark.sql(f"DROP TABLE IF EXISTS {x}")
    spark.range(3).write.parquet(str(tmp_path / "other"))
    with pytest.raises(ValueError):
        exact_dedup.DigestIndex(spark, path=str(tmp_path / "other"))


def test_temporary_indexes_leave_no_table(spark):
    before = {t.name for t in spark.catalog.listTables()}
    assert exact_dedup.deduplicate(docs(spark, [(1, "a"), (2, "a")]), batches=2).count() == 2
    assert {t.name for t in spark.catalog.listTables()} == before


def test_keep_unique_drops_repeated_rows(spark):
    kept = exact_dedup.keep_unique(docs(spark, [(1, "a"), (1, "a"), (2, "a"), (3, "b")], "_stay"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]


# ---- substring dedup ----


def substring_brute(rows, k):
    first = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for a in range(len(w) - k + 1):
            key = tuple(w[a : a + k])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for a in range(len(w) - k + 1):
            if first[tuple(w[a : a + k])] < i:
                gone[a : a + k] = [True] * k
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out)


@pytest.mark.parametrize("k", [3, 8])
def test_substring_dedup_against_brute_force(spark, k):
    rng = random.Random(k)
    shared_passage = words(rng, 2 * k)
    rows = []
    for i in rng.sample(range(60), 40):
        own = words(rng, rng.randrange(0, 60), 12)
        if i % 3 == 0:
            own[len(own) // 2 : len(own) // 2] = shared_passage
        rows.append((i, (" " if i % 2 else "\n\t").join(own)))
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring.remove_repeats(docs(spark, rows), k).collect())
    assert got == substring_brute(rows, k)


def test_substring_dedup_odd_rows(spark):
    rows = [r for r in odd_rows() if r[0] is not None]
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring.remove_repeats(docs(spark, rows, "tag marks bucket")).collect())
    assert got == substring_brute(rows, 50)
    null_id = substring.remove_repeats(docs(spark, [(None, "a b c d"), (9, "a b c d")]), 2).collect()
    assert {(r.doc_id, r.n_removed) for r in null_id} == {(None, 4), (9, 0)}
    assert substring.remove_repeats(docs(spark, [])).count() == 0


def test_spans_merge():
    assert substring.spans_of(np.array([0, 2, 9]), 12, 3) == [(0, 5), (9, 12)]


# ---- components and lookups ----


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.root for r in shared.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}
    path = [(i, i + 1) for i in range(3000)] + [(5000, i) for i in range(6000, 7000)]
    rng.shuffle(path)
    long = {r.node: r.root for r in shared.components(spark.createDataFrame(path, "a long, b long").repartition(16)).collect()}
    assert long == {i: 0 for i in range(1, 3001)} | {i: 5000 for i in range(6000, 7000)}
    with pytest.raises(RuntimeError):
        shared.components(spark.createDataFrame(path, "a long, b long").repartition(16), rounds=0).count()
    assert shared.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_attach_with_hot_keys(spark):
    left = spark.range(2000).select(F.col("id").alias("i"), F.when(F.col("id") < 900, "hot").when(F.col("id") < 1900, F.col("id").cast("string")).alias("k"))
    right = left.groupBy("k").agg(F.count("*").alias("n"), F.max("i").alias("m")).where("k is not null")
    got = {r.i: r.m for r in shared.attach(left, right, "k", "n", 2000, F.col("i")).collect()}
    assert len(got) == 2000 and got[5] == 899 and got[1500] == 1500 and got[1950] is None


# ---- n-gram join ----


def ngrams(text, k=5):
    w = WORD.findall(lowered(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def join_brute(rows, percent=75):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, ngrams(t))
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows, bases = [], [words(rng, n) for n in (12, 40, 90, 120)]
    for i in range(150):
        own = list(rng.choice(bases)) if i % 3 else words(rng, rng.randrange(1, 60))
        for _ in range(rng.randrange(0, 5)):
            at = rng.randrange(len(own))
            own[at : at + rng.randrange(0, 2)] = words(rng, rng.randrange(0, 2))
        rows.append((i, " ".join(own).upper() if i % 7 == 0 else "  ".join(own)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs(spark, rows)).collect()}
    assert got == join_brute(rows)


def test_ngram_join_one_hot_group(spark):
    rng = random.Random(3)
    base = words(rng, 150, 5000)
    rows = []
    for i in range(260):
        own = list(base)
        for _ in range(rng.randrange(0, 5)):
            own[rng.randrange(len(own))] = f"new{i}"
        rows.append((i, " ".join(own)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs(spark, rows)).collect()}
    assert got == join_brute(rows)


def test_ngram_join_odd_rows(spark):
    rows = [r for r in odd_rows() if r[0] is not None]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs(spark, rows, "sig n token comp")).collect()}
    assert got == join_brute(rows)
    nulls = ngram_join.near_duplicates(docs(spark, [(None, "a b"), (None, None), (3, "a b")])).collect()
    assert sorted(((r.doc_id or -1, r.component_id or -1) for r in nulls)) == [(-1, -1), (-1, 3), (3, 3)]
    assert ngram_join.near_duplicates(docs(spark, [])).count() == 0
    assert ngram_join.keep_one(docs(spark, [])).count() == 0


def test_substring_dedup_with_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(substring, "bucket_bits", lambda items: 17)
    rng = random.Random(9)
    rows = [(i, " ".join(words(rng, 40, 6))) for i in range(30)]
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring.remove_repeats(docs(spark, rows), 4).collect())
    assert got == substring_brute(rows, 4)


def test_rows_without_an_id_stay_once_and_displace_none(spark):
    rows = [(1, "a b"), (None, "a  b"), (None, "solo"), (None, "dup x"), (None, "dup  x"), (2, "p"), (3, "p"), (4, "q"), (4, "p")]
    stay = exact_dedup.keep_unique(docs(spark, rows))
    assert stay.columns == docs(spark, []).columns
    assert sorted((r.doc_id or 0, r.text) for r in stay.collect()) == [(0, "dup  x"), (0, "solo"), (1, "a b"), (2, "p"), (4, "q")]
    got = exact_dedup.deduplicate(docs(spark, rows)).collect()
    assert {(r.doc_id, r.keep_id, r.kept) for r in got if r.group_size == 2} == {(1, 1, True), (None, 1, False), (None, None, True)}
