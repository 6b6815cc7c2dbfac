"""Toxicity scores from a bidirectional GRU with attention pooling, written and trained in numpy.

Inputs per word: an embedding of the word and the mean embedding of its character n-grams, both learned by
back-propagation; beside them how strongly the word and its n-grams go with the label (a z-score of
the log odds over the training rows, from the other folds while training), and its length. Windows of
WINDOW words, each STRIDE words on from the last, are scored; a text's logit is its highest window's.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import NON_ALNUM_BYTES, Words, as_bytes, distinct, mix, owners, text_chunks, window_hashes

WINDOW, STRIDE, HIDDEN = 32, 8, 8
#: Training takes at most so many rows of each label and so many bytes of text, in the order of a hash of the id.
TRAIN_ROWS, TRAIN_BYTES = 2000, 8 << 20
WORD_BITS, GRAM_BITS, GRAMS = 18, 20, (3, 4, 5, 6)
FOLDS, MIL_ROUNDS, EPOCHS, BATCH, RATE, DECAY, SEED = 4, 3, 12, 512, 0.01, 1e-4, 7
#: Embeddings: bits of the tables' rows, numbers in a row, the fewest training texts of a word or n-gram that has
#: one of its own (others are zero), the share of windows that learn without any, learning rate.
TABLE_BITS, WIDTH, LEAST_TEXTS, DROPPED, TABLE_RATE = 16, 4, 5, 0.5, 0.02
FIXED = 5
FEATURES = FIXED + 2 * WIDTH


@dataclass
class Model:
    word_z: np.ndarray
    gram_z: np.ndarray
    tables: dict[str, np.ndarray] = field(default_factory=dict)
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    scale: float = 1.0
    shift: float = 0.0


# ---- inputs ----


class Vocabulary:
    """Distinct words of some texts with their n-gram buckets."""

    def __init__(self, texts: list[bytes]):
        words = Words(NON_ALNUM_BYTES, lower=True)
        keys, spans, at = [], [], 0
        parts: list[np.ndarray] = []
        counts = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            for part in words.parts(text):
                buf = np.frombuffer(part + b" ", np.uint8)
                starts, ends = words.spans(buf)
                keys.append(words.hashes(buf, starts, ends))
                spans.append((starts + at, ends + at))
                parts.append(buf)
                at += len(buf)
                counts[i] += len(starts)
        flat = np.concatenate(parts) if parts else np.empty(0, np.uint8)
        keys = np.concatenate(keys) if keys else np.empty(0, np.uint64)
        starts, ends = (np.concatenate([s[i] for s in spans]) if spans else np.empty(0, np.int64) for i in (0, 1))
        self.offsets = np.concatenate([[0], np.cumsum(counts)])
        self.unique, first, self.index = np.unique(keys, return_index=True, return_inverse=True)
        lengths = (ends - starts)[first]
        self.lengths = lengths
        self.word_bucket = (self.unique >> np.uint64(64 - WORD_BITS)).astype(np.int64)
        # the distinct words in a row, each between a start mark and an end mark
        room = lengths + 2
        begin = np.cumsum(room) - room
        code = np.zeros(int(room.sum()), np.uint64)
        code[begin], code[begin + room - 1] = 1, 2
        place = np.repeat(starts[first] - np.cumsum(lengths) + lengths, lengths) + np.arange(int(lengths.sum()))
        inner = np.repeat(begin + 1 - np.cumsum(lengths) + lengths, lengths) + np.arange(int(lengths.sum()))
        code[inner] = words.value[flat[place]] if len(flat) else 0
        code = mix(code + np.uint64(3))
        word = np.repeat(np.arange(len(room), dtype=np.int32), room)
        grams, owner = [], []
        for n in GRAMS:
            w = window_hashes(code, n)
            inside = word[: len(w)] == word[n - 1 :] if len(w) else np.empty(0, bool)
            grams.append((w[inside] >> np.uint64(64 - GRAM_BITS)).astype(np.int32))
            owner.append(word[: len(w)][inside])
        owner, grams = np.concatenate(owner), np.concatenate(grams)
        order = np.argsort(owner, kind="stable")
        self.gram_owner, self.grams = owner[order], grams[order]
        self.word_row, self.gram_row = self.word_bucket >> (WORD_BITS - TABLE_BITS), self.grams >> (GRAM_BITS - TABLE_BITS)
        self.n_grams = np.bincount(self.gram_owner, minlength=len(self.unique))
        self.gram_at = np.cumsum(self.n_grams) - self.n_grams

    def places(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the n-grams of some distinct words stand in grams, and of each the index of its word in words."""
        n = self.n_grams[words]
        return np.repeat(self.gram_at[words] - np.cumsum(n) + n, n) + np.arange(int(n.sum())), np.repeat(np.arange(len(words)), n)

    def embeddings(self, tables: dict[str, np.ndarray], words: np.ndarray) -> np.ndarray:
        """Of distinct words the word's row and the mean of its n-grams' rows."""
        at, own = self.places(words)
        rows = tables["gram"][self.gram_row[at]]
        mean = np.stack([np.bincount(own, rows[:, k], len(words)) for k in range(WIDTH)], axis=1) / np.maximum(1, self.n_grams[words])[:, None]
        return np.concatenate([tables["word"][self.word_row[words]], mean.astype(np.float32)], axis=1)

    def features(self, word_z: np.ndarray, gram_z: np.ndarray, tables: dict[str, np.ndarray] | None = None) -> np.ndarray:
        """Feature rows of the distinct words; without tables the learned part is zero."""
        out = np.zeros((len(self.unique), FEATURES), np.float32)
        if not len(self.unique):
            return out
        if tables is not None:
            out[:, FIXED:] = self.embeddings(tables, np.arange(len(self.unique)))
        out[:, 0] = word_z[self.word_bucket]
        z = gram_z[self.grams]
        some, first = np.unique(self.gram_owner, return_index=True)
        if len(some):
            out[some, 1] = np.maximum.reduceat(z, first)
            out[some, 2] = np.add.reduceat(z, first) / np.diff(np.append(first, len(z)))
        out[:, 3] = np.minimum(self.lengths, 20) / 10
        out[:, 4] = 1
        return out


def z_scores(with_label: np.ndarray, without: np.ndarray, n_with: int, n_without: int) -> np.ndarray:
    """Smoothed log odds in units of their deviation, clipped and scaled."""
    a, b = with_label + 0.5, without + 0.5
    z = (np.log(a / (n_with + 1)) - np.log(b / (n_without + 1))) / np.sqrt(1 / a + 1 / b)
    return (np.clip(z, -8, 8) / 3).astype(np.float32)


def window_starts(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word of every window, and its text; a text without words has none."""
    lengths = np.diff(offsets)
    n = np.where(lengths > 0, 1 + np.maximum(0, -(-(lengths - WINDOW) // STRIDE)), 0)
    text = np.repeat(np.arange(len(lengths)), n)
    return offsets[:-1][text] + STRIDE * (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)), text


def window_inputs(features: np.ndarray, index: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(WINDOW, n, FEATURES) inputs and (WINDOW, n) mask of windows that begin at starts and stop before ends."""
    at = starts[None, :] + np.arange(WINDOW)[:, None]
    mask = at < ends[None, :]
    return features[index[np.where(mask, at, starts[None, :])]] * mask[..., None], mask.astype(np.float32)


# ---- network ----


def new_weights(rng: np.random.Generator) -> dict[str, np.ndarray]:
    out = {}
    for way in "fb":
        out[f"x{way}"] = rng.normal(0, 0.4, (FEATURES, 3 * HIDDEN))
        out[f"h{way}"] = rng.normal(0, 0.3, (HIDDEN, 3 * HIDDEN))
        out[f"c{way}"] = np.zeros(3 * HIDDEN)
    out |= {"att": rng.normal(0, 0.3, (2 * HIDDEN, HIDDEN)), "query": rng.normal(0, 0.5, HIDDEN), "out": rng.normal(0, 0.5, 2 * HIDDEN), "bias": np.zeros(1)}
    return {k: v.astype(np.float32) for k, v in out.items()}


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def gru(w: dict[str, np.ndarray], way: str, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (WINDOW, n, HIDDEN) of one direction; masked places hold the state before them."""
    steps, n = mask.shape
    pre = (x.reshape(-1, FEATURES) @ w[f"x{way}"] + w[f"c{way}"]).reshape(steps, n, 3 * HIDDEN)
    h, out = np.zeros((n, HIDDEN), np.float32), np.empty((steps, n, HIDDEN), np.float32)
    gates, new = w[f"h{way}"][:, : 2 * HIDDEN], w[f"h{way}"][:, 2 * HIDDEN :]
    for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
        zr = sigmoid(pre[t, :, : 2 * HIDDEN] + h @ gates)
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        c = np.tanh(pre[t, :, 2 * HIDDEN :] + (r * h) @ new)
        m = mask[t][:, None] * z
        if keep is not None:
            keep.append((t, h, z, r, c))
        h = h + m * (c - h)
        out[t] = h
    return out


def forward(w: dict[str, np.ndarray], x: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Logit of every window."""
    tape = {"f": [], "b": []} if keep is not None else {"f": None, "b": None}
    h = np.concatenate([gru(w, way, x, mask, tape[way]) for way in "fb"], axis=2)
    a = np.tanh(h.reshape(-1, 2 * HIDDEN) @ w["att"]).reshape(*mask.shape, HIDDEN)
    e = a @ w["query"] - 1e4 * (1 - mask)
    p = np.exp(e - e.max(axis=0))
    p /= p.sum(axis=0)
    pooled = np.einsum("tn,tnh->nh", p, h)
    if keep is not None:
        keep |= {"h": h, "a": a, "p": p, "pooled": pooled, "tape": tape}
    return pooled @ w["out"] + w["bias"][0]


def gradients(w: dict[str, np.ndarray], x: np.ndarray, mask: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Weighted mean log loss of the windows and its gradients by the weights and ("x") the inputs, by back-propagation through time."""
    k: dict = {}
    logit = forward(w, x, mask, k)
    total = weight.sum()
    loss = float((weight * (np.logaddexp(0, logit) - target * logit)).sum() / total)
    d = (weight * (sigmoid(logit) - target) / total).astype(np.float32)
    g = {"out": k["pooled"].T @ d, "bias": np.array([d.sum()], np.float32)}
    d_pooled = d[:, None] * w["out"]
    h, a, p = k["h"], k["a"], k["p"]
    d_p = np.einsum("nh,tnh->tn", d_pooled, h)
    d_e = p * (d_p - (p * d_p).sum(axis=0))
    g["query"] = np.einsum("tn,tnh->h", d_e, a)
    d_a = d_e[..., None] * w["query"] * (1 - a * a)
    g["att"] = h.reshape(-1, 2 * HIDDEN).T @ d_a.reshape(-1, HIDDEN)
    d_h = p[..., None] * d_pooled + d_a @ w["att"].T
    g["x"] = np.zeros_like(x)
    for way, part in (("f", d_h[..., :HIDDEN]), ("b", d_h[..., HIDDEN:])):
        wh = w[f"h{way}"]
        g_pre = np.zeros((*mask.shape, 3 * HIDDEN), np.float32)
        g_wh, carry = np.zeros_like(wh), np.zeros_like(part[0])
        for t, before, z, r, c in reversed(k["tape"][way]):
            up = part[t] + carry
            m = mask[t][:, None]
            d_c = up * m * z * (1 - c * c)
            d_z = up * m * (c - before) * z * (1 - z)
            back = d_c @ wh[:, 2 * HIDDEN :].T
            d_r = back * before * r * (1 - r)
            d_zr = np.concatenate([d_z, d_r], axis=1)
            carry = up * (1 - m * z) + back * r + d_zr @ wh[:, : 2 * HIDDEN].T
            g_pre[t, :, : 2 * HIDDEN], g_pre[t, :, 2 * HIDDEN :] = d_zr, d_c
            g_wh[:, : 2 * HIDDEN] += before.T @ d_zr
            g_wh[:, 2 * HIDDEN :] += (r * before).T @ d_c
        g[f"x{way}"] = x.reshape(-1, FEATURES).T @ g_pre.reshape(-1, 3 * HIDDEN)
        g["x"] += g_pre @ w[f"x{way}"].T
        g[f"c{way}"] = g_pre.sum(axis=(0, 1))
        g[f"h{way}"] = g_wh
    return loss, g


def window_logits(w: dict[str, np.ndarray], features: np.ndarray, index: np.ndarray, starts: np.ndarray, ends: np.ndarray, batch: int = 2048) -> np.ndarray:
    out = np.empty(len(starts), np.float32)
    for lo in range(0, len(starts), batch):
        out[lo : lo + batch] = forward(w, *window_inputs(features, index, starts[lo : lo + batch], ends[lo : lo + batch]))
    return out


def highest(values: np.ndarray, text: np.ndarray, n: int, default: float) -> np.ndarray:
    out = np.full(n, -np.inf)
    np.maximum.at(out, text, values)
    return np.where(np.isinf(out), default, out)


# ---- training ----


def train(ids: list[int], texts: list[bytes], labels: np.ndarray) -> Model | None:
    """A model from labelled texts; None without texts of both labels."""
    if not 0 < labels.sum() < len(labels) or not any(t.strip() for t in texts):
        return None
    rng = np.random.default_rng(SEED)
    v = Vocabulary(texts)
    text_of = owners(v.offsets)
    fold = (mix(np.array(ids, np.int64).view(np.uint64) + np.uint64(1)) % np.uint64(FOLDS)).astype(np.int64)
    pair = distinct(text_of * max(1, len(v.unique)) + v.index)
    doc, word = pair // max(1, len(v.unique)), pair % max(1, len(v.unique))

    def counts(size: int, doc: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """(FOLDS, 2, size) texts by fold and label that hold a bucket."""
        seen = distinct(doc * size + bucket)
        doc, bucket = seen // size, seen % size
        return np.bincount((fold[doc] * 2 + labels[doc]) * size + bucket, minlength=FOLDS * 2 * size).reshape(FOLDS, 2, size)

    word_counts = counts(1 << WORD_BITS, doc, v.word_bucket[word])
    gram_counts = np.zeros((FOLDS, 2, 1 << GRAM_BITS), np.int64)
    for lo in range(0, len(texts), 500):
        inside = slice(*np.searchsorted(doc, [lo, lo + 500]))
        at, own = v.places(word[inside])
        gram_counts += counts(1 << GRAM_BITS, doc[inside][own], v.grams[at])
    sizes = np.bincount(fold * 2 + labels, minlength=2 * FOLDS).reshape(FOLDS, 2)

    def z(table: np.ndarray, left_out: int | None) -> np.ndarray:
        own = table.sum(axis=0) - (table[left_out] if left_out is not None else 0)
        n = sizes.sum(axis=0) - (sizes[left_out] if left_out is not None else 0)
        return z_scores(own[1], own[0], n[1], n[0])

    starts, text = window_starts(v.offsets)
    ends = v.offsets[1:][text]
    by_fold = [v.features(z(word_counts, f), z(gram_counts, f)) for f in range(FOLDS)]
    stacked, shifted = np.concatenate(by_fold), v.index + fold[text_of] * len(v.unique)
    strong = np.maximum(stacked[shifted, 0], 0) + np.maximum(stacked[shifted, 1], 0)
    sums = np.concatenate([[0], np.cumsum(strong)])
    rank = sums[np.minimum(starts + WINDOW, ends)] - sums[starts]
    w = new_weights(rng)
    first, second = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    step = 0
    tables = {k: np.zeros((1 << TABLE_BITS, WIDTH), np.float32) for k in ("word", "gram")}
    sums_of = {k: np.zeros((1 << TABLE_BITS, WIDTH), np.float32) for k in tables}
    rows_of = lambda table, bits: table.sum(axis=(0, 1)).reshape(1 << TABLE_BITS, 1 << (bits - TABLE_BITS)).max(axis=1) >= LEAST_TEXTS
    known = {"word": rows_of(word_counts, WORD_BITS), "gram": rows_of(gram_counts, GRAM_BITS)}

    def move(name: str, rows: np.ndarray, d: np.ndarray) -> None:
        """One Adagrad step of the rows that enough texts have."""
        rows, inverse = np.unique(rows, return_inverse=True)
        total = np.stack([np.bincount(inverse, d[:, k], len(rows)) for k in range(WIDTH)], axis=1).astype(np.float32)
        rows, total = rows[known[name][rows]], total[known[name][rows]]
        total = np.clip(total, -1, 1) + DECAY * tables[name][rows]
        sums_of[name][rows] += total * total
        tables[name][rows] -= TABLE_RATE * total / (np.sqrt(sums_of[name][rows]) + 1e-6)
    for _ in range(MIL_ROUNDS):
        # each text stands by its strongest window; texts without the label also by a second and a random one
        order = np.lexsort((-rank, text))
        heads = np.flatnonzero(np.concatenate([[True], text[order][1:] != text[order][:-1]]))
        top = order[heads]
        more = heads[(labels[text[order[heads]]] == 0) & (np.append(heads[1:], len(order)) - heads > 1)] + 1
        others = np.flatnonzero(labels[text] == 0)
        chosen = np.unique(np.concatenate([top, order[more], rng.choice(others, min(len(others), len(top)), replace=False)]))
        target = labels[text[chosen]].astype(np.float32)
        weight = np.where(target == 1, 0.5 * len(target) / max(1, target.sum()), 1.0).astype(np.float32)
        for _ in range(EPOCHS):
            shuffled = rng.permutation(len(chosen))
            for lo in range(0, len(shuffled), BATCH):
                i = shuffled[lo : lo + BATCH]
                begin, end = starts[chosen[i]], ends[chosen[i]]
                x, mask = window_inputs(stacked, shifted, begin, end)
                # some windows learn from what holds beyond the training texts alone
                learns = mask * (rng.random(len(i)) >= DROPPED)
                at = begin[None, :] + np.arange(WINDOW)[:, None]
                used, inverse = np.unique(v.index[np.where(mask > 0, at, begin[None, :])], return_inverse=True)
                x[..., FIXED:] = v.embeddings(tables, used)[inverse.reshape(mask.shape)] * learns[..., None]
                _, g = gradients(w, x, mask, target[i], weight[i])
                d = (g.pop("x")[..., FIXED:] * learns[..., None]).reshape(-1, 2 * WIDTH)
                d = np.stack([np.bincount(inverse.ravel(), d[:, k], len(used)) for k in range(2 * WIDTH)], axis=1)
                move("word", v.word_row[used], d[:, :WIDTH])
                places, own = v.places(used)
                move("gram", v.gram_row[places], (d[:, WIDTH:] / np.maximum(1, v.n_grams[used])[:, None])[own])
                step += 1
                for k, x in w.items():
                    d = np.clip(g[k], -1, 1) + DECAY * x
                    first[k] = 0.9 * first[k] + 0.1 * d
                    second[k] = 0.99 * second[k] + 0.01 * d * d
                    w[k] = (x - RATE / (1 + step / 400) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        stacked[:, FIXED:] = np.tile(v.embeddings(tables, np.arange(len(v.unique))), (FOLDS, 1))
        rank = window_logits(w, stacked, shifted, starts, ends)
        stacked[:, FIXED:] = 0
    model = Model(z(word_counts, None), z(gram_counts, None), tables, w)
    model.scale, model.shift = calibrate(highest(rank, text, len(texts), float(w["bias"][0])), labels)
    return model


def calibrate(logits: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Scale (above 0) and shift of logits by logistic regression with smoothed targets (Newton steps)."""
    n1, n0 = labels.sum(), len(labels) - labels.sum()
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * logits + b, -30, 30)))
        g = np.array([((p - target) * logits).sum() + 1e-3 * (a - 1), (p - target).sum()])
        s = p * (1 - p)
        hess = np.array([[(s * logits**2).sum() + 1e-3, (s * logits).sum()], [(s * logits).sum(), s.sum() + 1e-9]])
        move = np.linalg.solve(hess, g)
        move *= min(1.0, 2.0 / max(1e-9, np.abs(move).max()))
        a, b = max(0.05, a - move[0]), b - move[1]
        if np.abs(move).max() < 1e-6:
            break
    return float(a), float(b)


def score_texts(model: Model, texts: list[bytes]) -> np.ndarray:
    """Probability for each text."""
    v = Vocabulary(texts)
    starts, text = window_starts(v.offsets)
    logits = window_logits(model.weights, v.features(model.word_z, model.gram_z, model.tables), v.index, starts, v.offsets[1:][text]) if len(starts) else np.empty(0)
    top = highest(logits, text, len(texts), float(model.weights["bias"][0]))
    return 1 / (1 + np.exp(-np.clip(model.scale * top + model.shift, -30, 30)))


# ---- Spark ----


def held_out(doc_id):
    """Whether a row is kept from training: crc32 of its id as text is a multiple of 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[Model | None, float]:
    """A model from at most TRAIN_ROWS labelled rows of each label that aren't held out, and the label's share.

    Of rows repeated with one id the least text is trained on, and of its labels the greatest holds.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(label_col).cast("int").alias("_label"))
    picked = None
    for value in (1, 0):
        part = known.where(F.col("_label") == value).orderBy(F.xxhash64("_id"), "_id").limit(TRAIN_ROWS)
        picked = part if picked is None else picked.union(part)
    # at most 2 * TRAIN_ROWS rows of two numbers: a bounded broadcast, so the texts need no shuffle
    chosen = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).join(F.broadcast(picked), "_id")
    sizes = sorted(((r.h, r._id, r.n) for r in chosen.groupBy("_id").agg(F.max(F.octet_length("_text")).alias("n")).withColumn("h", F.xxhash64("_id")).collect()))
    room, ids = TRAIN_BYTES, []
    for _, i, n in sizes:
        if n <= room:
            room -= n
            ids.append(i)
    spark = docs.sparkSession
    taken = chosen.join(F.broadcast(spark.createDataFrame([(i,) for i in ids], "_id long")), "_id", "left_semi").groupBy("_id").agg(F.min("_text").alias("_text"), F.first("_label").alias("_label"))

    def train_all(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("_id").to_numpy())
        y = group.column("_label").to_numpy()[order].astype(np.int64)
        texts = as_bytes(group.column("_text").combine_chunks())
        model = train(group.column("_id").to_numpy()[order].tolist(), [texts[i] for i in order], y)
        return pa.table({"model": pa.array([pickle.dumps(model)], pa.binary()), "share": pa.array([float(y.mean())])})

    # one task trains on the bounded sample, so that the driver holds no more than the model
    got = taken.select("_id", "_text", "_label").groupBy(F.lit(0).alias("_all")).applyInArrow(lambda group: train_all(group), "model binary, share double").collect()
    totals = {r[0]: r[1] for r in known.groupBy("_label").count().collect()}
    share = totals.get(1, 0) / max(1, sum(totals.values()))
    model = pickle.loads(got[0].model) if got else None
    if model is not None:
        # the sample has more of the rarer label than the labelled rows have
        model.shift += float(np.log(share / (1 - share)) - np.log(got[0].share / (1 - got[0].share)))
    return model, share


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (0 to 1), predicted (1 where score >= 0.5).

    Null and empty texts are scored like a text without any word. Without labels of both kinds every
    score is the label's share among the training rows. Rows repeated with one id are scored each;
    a null id is never trained on. Extra columns are ignored.
    """
    model, share = fit(docs, labels, id_col, text_col, label_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for lo, hi, texts in text_chunks(batch.column(1), 1 << 20):
                got = score_texts(model, texts) if model is not None else np.full(hi - lo, share)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(got)], names=["doc_id", "score"])

    got = docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(judge, "doc_id long, score double")
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_civil(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The rows of docs that score below the threshold, all columns kept and nothing shuffled."""
    model, share = fit(docs, labels, id_col, text_col, label_col)
    shared, at, schema = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col), docs.schema

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for lo, hi, texts in text_chunks(batch.column(at), 1 << 20):
                got = score_texts(model, texts) if model is not None else np.full(hi - lo, share)
                yield batch.slice(lo, hi - lo).filter(pa.array(got < threshold))

    return docs.mapInArrow(sift, schema)
