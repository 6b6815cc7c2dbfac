import hashlib
import heapq
import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import conversation, embedding_dups, spelling

from .helpers import docs

TALKS = "conv_id long, turn long, role string, text string"


# ---- conversations ----


def expected(rows):
    """Summary of one conversation by Dijkstra's search over (row, roles so far), independent of the operator's machines."""
    rows = sorted([(t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows], key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    fits = lambda last, new: new == "u" if last in ("", "s", "a") else new == "a" if last == "u" else False
    queue, done = [(0, "", 0, "", None)], set()
    while True:
        cost, audit, i, last, made = heapq.heappop(queue)
        if i == len(rows) and last in ("", "a"):
            break
        if (i, last) in done:
            continue
        done.add((i, last))
        push = lambda c, label, j, new, out: heapq.heappush(queue, (cost + c, audit + label, j, new, (made, out) if out else made))  # noqa: B023, E731
        for role in ("user", "assistant"):
            if fits(last, role[0]):
                push(3, "I", i, role[0], f"{role}:")
        if i < len(rows):
            _, role, text = rows[i]
            push(4, "D", i + 1, last, None)
            if faults[i] not in ("blank", "duplicate"):
                late = 3 if faults[i] else 0
                if fits(last, role[:1]) or (last == "" and role[:1] == "s"):
                    push(late, "K", i + 1, role[:1], f"{role}:{text}")
                for new in ("user", "assistant"):
                    if fits(last, new[0]):
                        push(3 + late, "R", i + 1, new[0], f"{new}:{text}")
    out = []
    while made:
        made, line = made
        out.append(line)
    turns = {t for t, *_ in rows if t is not None}
    count = Counter(faults)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(out[::-1]).encode()).hexdigest()


def talk(rng, n, texts=("Well.", "So", "", " \n", "What?", "It is!", "a.\nb", None)):
    return [(rng.choice([None, *range(n)]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(texts) if rng.random() < 0.5 else f"text {rng.random()}" + rng.choice([".", "", "!  "])) for _ in range(n)]


def got(df):
    return {r.conv_id: tuple(r)[1:] for r in df.select("conv_id", *conversation.COUNTS, "audit", "repaired_sha256").collect()}


def test_repair_of_short_conversations(spark):
    rng = random.Random(3)
    talks = {k: talk(rng, rng.randrange(1, 9)) for k in range(150)}
    talks[None] = talk(rng, 4)
    rows = [(k, *r) for k, rs in talks.items() for r in rs]
    rng.shuffle(rows)
    assert got(conversation.repair(spark.createDataFrame(rows, TALKS))) == {k: expected(rs) for k, rs in talks.items()}


def test_repair_of_a_conversation_with_most_rows(spark):
    rng = random.Random(4)
    talks = {1: talk(rng, 2600), 2: talk(rng, 5), 3: [(7, "user", "same.")] * 1300, 4: [(1, "user", "x" * 1_500_000), (2, "user", "y" * 1_500_000 + "."), (3, "assistant", "end.")]}
    rows = [(k, *r) for k, rs in talks.items() for r in rs]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, TALKS).withColumn("audit", F.lit("clash")).withColumn("part", F.lit(1))
    assert got(conversation.repair(df)) == {k: expected(rs) for k, rs in talks.items()}


def test_blocks_multiply_to_the_whole():
    rng = random.Random(5)
    for _ in range(200):
        rows = [conversation.Row(t, r or " ", x or " ", conversation.fault(x or " ", rng.random() < 0.2)) for t, r, x in talk(rng, rng.randrange(2, 9))]
        cut = rng.randrange(len(rows) + 1)
        front = {}
        for state, (cost, labels) in conversation.advanced({0: (0, "")}, rows[:cut]).items():
            for to, (c, s) in conversation.advanced({state: (0, "")}, rows[cut:]).items():
                front[to] = min(front.get(to, (math.inf, "")), (cost + c, labels + s))
        assert front == conversation.advanced({0: (0, "")}, rows)


def test_damaged_conversations_keep_their_ids(spark):
    import zlib

    turns = [t for t in range(400) if zlib.crc32(f"9:{t}".encode()) % 20 == 0][:3]
    df = spark.createDataFrame([(9, t, "user", "Gone.") for t in turns] + [(8, None, None, None)], TALKS)
    out = {r.conv_id: r for r in conversation.repair_damaged(df).collect()}
    assert out[9].audit == "" and out[9].cost == 0 and out[9].repaired_sha256 == hashlib.sha256(b"").hexdigest()
    assert set(out) == {8, 9}
    assert conversation.repair_damaged(df.limit(0)).count() == 0


# ---- spelling ----


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


@pytest.mark.parametrize("most", [1, 3, 64])
def test_near_pairs_against_all_pairs(spark, most):
    rng = random.Random(6)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(5, 9))) for _ in range(160)} | {"preface" + a + b for a in "abcd" for b in "abcd"} | {"z" * n for n in ((6, 7, 8, 300, 301) if most < 64 else (6, 7, 8, 40_000, 40_001))}
    df = spark.createDataFrame([(w,) for w in sorted(words)], "word string")
    assert sorted(map(tuple, spelling.near_pairs(df, most).collect())) == sorted((a, b) for a, b in itertools.combinations(sorted(words), 2) if one_edit(a, b))


def test_variants_and_their_roots(spark):
    rows = [("letter", 4000), ("lettar", 500), ("lettars", 50), ("letters", 900), ("alone!", 7), ("lettars9", 10), (None, 3)]
    out = {r.word: tuple(r)[1:] for r in spelling.variants(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert out["lettars9"] == ("lettars", "letters", 10, 1, 50)
    assert out["lettars"] == ("letters", "letters", 50, 3, 900)
    assert out["lettar"] == ("letter", "letter", 500, 2, 4000)
    assert out["letters"] == (None, "letters", 900, 2, None) and out["alone!"] == (None, "alone!", 7, 0, None) and None not in out


def test_ties_of_forms_go_to_the_first_word(spark):
    rows = [("worda", 5), ("wordb", 25), ("wordc", 25), ("éwordx", 5), ("wordxz", 5)]
    out = {r.word: r for r in spelling.variants(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert (out["worda"].form, out["worda"].n_near, out["wordb"].form, out["éwordx"].n_near) == ("wordb", 2, None, 0)


def test_vocabulary_of_odd_documents(spark):
    import re
    import zlib

    rng = random.Random(7)
    pool = ["Straße", "LETTER", "letter", "ÉCOLES", "écoles", "mañana", "abcdef", "x×y÷zz", "shorts", "one"]
    texts = [(i, " ".join(rng.choice(pool) for _ in range(200)) + rng.choice(["", "!", "9"])) for i in range(40)]
    texts += [(1, None), (2, ""), (None, "letter letter"), (3, "y" * 200_000), (4, texts[0][1]), (4, texts[0][1])]
    want = Counter()
    for i, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            want[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    want = {w: n for w, n in want.items() if len(w) >= 6 and n >= 5}
    df = docs(spark, texts, "word n h")
    found = spelling.vocabulary(spelling.misspelt(spelling.occurrences(df)))
    assert dict(map(tuple, found.collect())) == want
    assert {r.word for r in spelling.spelling_variants(df).collect()} == set(want)
    assert spelling.spelling_variants(df.limit(0)).count() == 0


# ---- embeddings ----

VECTORS = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.95):
    valid = [bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, _ in rows]
    n = len(rows)
    links = [set() for _ in range(n)]
    unit = [np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) if ok else None for (_, v, _), ok in zip(rows, valid, strict=True)]
    for i in range(n):
        for j in range(i):
            if valid[i] and valid[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                links[i].add(j)
                links[j].add(i)
    out, seen = [], {}
    for i in range(n):
        if i not in seen:
            todo, group = [i], {i}
            while todo:
                for k in links[todo.pop()] - group:
                    group.add(k)
                    todo.append(k)
            seen |= dict.fromkeys(group, min((rows[k][0] for k in group if rows[k][0] is not None), default=None))
        out.append((rows[i][0], len(links[i]), seen[i], rows[i][0] == seen[i]))
    return sorted(out, key=repr)


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(8)
    rows = []
    for k in range(12):
        base = rng.normal(size=24)
        for _ in range(25):
            rows.append((len(rows), (base + rng.normal(size=24) * rng.choice([0.05, 0.2, 0.25, 0.3])).tolist(), k))
    rows += [(len(rows) + i, rng.normal(size=24).tolist(), 0) for i in range(200)]
    rows += [(1000 + i, rows[3][1], 0) for i in range(300)]
    rows += [(2000, None, 1), (2001, [], 1), (2002, [0.0] * 24, 1), (2003, [1.0, None] * 12, 1), (2004, [float("nan")] * 24, 1), (2005, [float("inf")] + [1.0] * 23, 1)]
    rows += [(2006, [1.0] * 8, 1), (2007, [1.0, 1.01] * 4, 1), (2008, [1e-30] * 24, 1), (2009, [1e30] * 24, 1), (None, rows[7][1], 1), (None, None, 1), (3, rows[3][1], 1), (2010, [1.0] + [0.0] * 23, 1), (2011, [1.0, 0.32] + [0.0] * 22, 1)]
    df = spark.createDataFrame(rows, VECTORS).withColumn("digest", F.lit("clash")).withColumn("uid", F.lit(1))
    assert sorted(map(tuple, embedding_dups.near_duplicates(df).collect()), key=repr) == brute(rows)
    assert embedding_dups.near_duplicates(df.limit(0)).count() == 0


def test_error_bounds_hold_for_every_pair():
    rng = np.random.default_rng(9)
    u = embedding_dups.unit(np.concatenate([rng.normal(size=(300, 40)), np.eye(40)[:20], rng.normal(size=(50, 40)) * np.exp(rng.normal(size=(50, 40)) * 3)]))
    codes, scale, error = embedding_dups.quantised(u)
    about = scale[:, None] * scale[None] * (codes.astype(float) @ codes.T.astype(float))
    bound = error[:, None] + (1 + error[:, None]) * error[None]
    assert (np.abs(about - u @ u.T) <= bound).all()


def test_products_are_spared_only_where_nothing_links():
    rng = np.random.default_rng(10)
    centres = embedding_dups.unit(rng.normal(size=(8, 16)))
    spared = 0
    tiles = []
    for k, c in enumerate(centres):
        u = embedding_dups.unit(c + rng.normal(size=(30, 16)) * 0.05)
        codes, scale, error = embedding_dups.quantised(u)
        mid = embedding_dups.unit(u.sum(axis=0, keepdims=True))[0]
        tiles.append((embedding_dups.Tile(k, 30, 16, np.arange(30).tobytes(), np.ones(30, np.int64).tobytes(), codes.tobytes(), scale.tobytes(), error.tobytes(), mid.tobytes(), float(np.arccos(np.clip(u @ mid, -1, 1)).max())), u))
    for (a, x), (b, y) in itertools.combinations(tiles, 2):
        if embedding_dups.apart(a, b, 0.95):
            spared += 1
            assert (x @ y.T < 0.95).all()
        else:
            found = {(int(i), int(j)) for i, j, _ in embedding_dups.product(a, b, 0.95) for i, j in zip(i, j, strict=True)}
            assert {tuple(p) for p in np.argwhere(x @ y.T >= 0.95).tolist()} <= found
    assert spared > 10
