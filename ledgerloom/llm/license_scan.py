"""License scans with a positional index of rare words.

The index has, for every notice template, its words of highest IDF (over all documents) with their
positions, so many that no text with LEAST_SCORE of the template's weight lacks two of them. A file's words are looked
up in it; postings of one template that agree on where the
template would begin make a candidate, which an alignment and its mandatory phrases verify.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import NON_ALNUM_BYTES, Words, owners, text_chunks

#: The phrases whose places count, and their labels.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Label, notice, mandatory key phrases.
TEMPLATES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["hereby granted free of charge", "obtaining a copy"]),
    ("apache-2", "licensed under the apache license version 2 0", ["apache license version 2"]),
    ("gpl-3", "licensed under the gnu general public license version 3", ["gnu general public license", "version 3"]),
    ("gpl-3", "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", ["gnu general public license", "version 3"]),
    ("gpl-2", "licensed under the gnu general public license version 2", ["gnu general public license", "version 2"]),
    ("gpl-2", "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", ["gnu general public license", "version 2"]),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3", ["lesser general public license", "version 3"]),
    ("agpl-3", "licensed under the gnu affero general public license version 3", ["affero general public license", "version 3"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["source and binary forms", "with or without modification"]),
    ("bsd", "licensed under the bsd 3 clause license", ["bsd 3 clause"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee"]),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software"]),
    ("cc-by", "licensed under cc by 4 0", ["cc by 4"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license", ["creative commons attribution noncommercial"]),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ["this permission notice shall be included", "substantial portions of the software"]),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ["except in compliance with the license", "license 2 0"]),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ["redistributions of source code must retain", "this list of conditions"]),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ["redistributions in binary form must reproduce", "this list of conditions"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ["without any express or implied warranty", "held liable for any damages"]),
    ("bsl-1", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ["person or organization obtaining", "covered by this license"]),
    ("mpl-2", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", ["copy of the mpl", "mpl 2 0"]),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ["waived all copyright", "neighboring rights"]),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", ["free to copy modify publish", "by any means"]),
    *[(label, phrase, [phrase]) for phrase, label in BASE_PHRASES.items()],
]
#: Least share of a template's weight.
LEAST_SCORE = 0.7


@dataclass
class RareIndex:
    """templates: (label, word hashes, IDF of each, phrases as word hashes); hashes sorted, with postings."""

    templates: list[tuple[str, list[int], list[float], list[list[int]]]]
    hashes: np.ndarray
    postings: list[list[tuple[int, int]]]
    maybe: np.ndarray
    base: list[tuple[str, list[int]]]


def _hash_all(words: Words, text: str) -> list[int]:
    return words.hash_documents([text.encode()])[0].tolist()


def _maybe(hashes: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << 16, bool)
    out[(hashes >> np.uint64(48)).astype(np.int64)] = True
    return out


def _known(h: np.ndarray, hashes: np.ndarray, maybe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in h of words in hashes (sorted), and which they are."""
    at = np.flatnonzero(maybe[(h >> np.uint64(48)).astype(np.int64)])
    which = np.minimum(np.searchsorted(hashes, h[at]), len(hashes) - 1)
    same = hashes[which] == h[at]
    return at[same], which[same]


def inverse_frequencies(docs: DataFrame, templates=TEMPLATES) -> dict[int, float]:
    """IDF of every template word by its hash, over all rows of docs; at most the templates' words reach the driver."""
    vocabulary = np.unique(np.array([x for _, text, _ in templates for x in _hash_all(Words(NON_ALNUM_BYTES, lower=True), text)], np.uint64))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, maybe, n = Words(NON_ALNUM_BYTES, lower=True), _maybe(vocabulary), 0
        seen = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            n += batch.num_rows
            for _, _, texts in text_chunks(batch.column(0)):
                h, offsets = words.hash_documents(texts)
                at, which = _known(h, vocabulary, maybe)
                own = np.searchsorted(offsets, at, "right") - 1
                seen += np.bincount(np.unique(own * len(vocabulary) + which) % len(vocabulary), minlength=len(vocabulary))
        yield pa.RecordBatch.from_pydict({"word": pa.array(np.arange(-1, len(vocabulary))), "n": pa.array(np.concatenate([[n], seen]))})

    got = dict(docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n")).collect())
    total = got.get(-1, 0)
    return {int(x): math.log((total + 1) / (got.get(i, 0) + 0.5)) for i, x in enumerate(vocabulary)}


def slack(template: list[int]) -> int:
    """How many words may be put into or left out of a notice: the places of its words disagree by no more."""
    return 2 + len(template) // 4


def anchors(template: list[int], weight: dict[int, float]) -> list[int]:
    """The rarest distinct words, until all but the heaviest of them weigh more than a text may lack."""
    total, held, most, out = sum(weight[x] for x in template), 0.0, 0.0, []
    for x in sorted(set(template), key=lambda x: (-weight[x], x)):
        out.append(x)
        own = weight[x] * template.count(x)
        held, most = held + own, max(most, own)
        if held - most > (1 - LEAST_SCORE) * total:
            break
    return out


def rare_index(idf: dict[int, float], templates=TEMPLATES) -> RareIndex:
    words = Words(NON_ALNUM_BYTES, lower=True)
    weight = {x: max(v, 0.01) for x, v in idf.items()}
    made, postings = [], defaultdict(list)
    for t, (label, text, phrases) in enumerate(templates):
        own = _hash_all(words, text)
        made.append((label, own, [weight[x] for x in own], [_hash_all(words, p) for p in phrases]))
        for x in anchors(own, weight):
            postings[x] += [(t, i) for i, y in enumerate(own) if y == x]
    hashes = np.array(sorted(postings), np.uint64)
    return RareIndex(made, hashes, [postings[int(x)] for x in hashes], _maybe(hashes), [(label, _hash_all(words, p)) for p, label in BASE_PHRASES.items()])


def _has_run(window: list[int], run: list[int]) -> bool:
    return any(window[i : i + len(run)] == run for i in range(len(window) - len(run) + 1))


def _aligned(template: list[int], weight: list[float], window: list[int]) -> float:
    """Share of the template's weight in its heaviest common subsequence with the window."""
    best = [0.0] * (len(window) + 1)
    for x, w in zip(template, weight, strict=True):
        held = 0.0
        for j, y in enumerate(window, 1):
            held, best[j] = best[j], max(best[j], best[j - 1], held + w if x == y else 0.0)
    return best[-1] / sum(weight)


def verified(h: np.ndarray, start: int, template: list[int], weight: list[float], phrases: list[list[int]]) -> float:
    """The score of a template whose earliest word could begin at start; 0 where a mandatory phrase or LEAST_SCORE isn't met."""
    window = h[max(0, start) : max(0, start + len(template) + 2 * slack(template))].tolist()
    if not all(_has_run(window, p) for p in phrases):
        return 0.0
    score = _aligned(template, weight, window)
    return min(1.0, score) if score >= LEAST_SCORE else 0.0


def scan_words(h: np.ndarray, found: list[tuple[int, int]], index: RareIndex) -> tuple[set[str], float]:
    """Labels and best score of one file, from its words and where the index's words stand in it."""
    votes: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for at, which in found:
        for t, i in index.postings[which]:
            votes[t].append((at - i, which))
    labels, best = set(), 0.0
    for t, places in votes.items():
        label, template, weight, phrases = index.templates[t]
        places.sort()
        tried, hi = None, 0
        inside: Counter[int] = Counter()
        for lo, (start, which) in enumerate(places):
            while hi < len(places) and places[hi][0] <= start + 2 * slack(template):
                inside[places[hi][1]] += 1
                hi += 1
            if len(inside) >= min(2, len(set(template))) and start != tried:
                tried = start
                score = verified(h, start, template, weight, phrases)
                if score:
                    labels.add(label)
                    best = max(best, score)
            inside[which] -= 1
            if not inside[which]:
                del inside[which]
    return labels, best


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z lowered; null counts as
    empty. n_base counts all places of BASE_PHRASES; first_word and last_word are their least and
    greatest start (null without any). labels has the base labels and those the index verifies;
    score is the best verified share of a template's IDF weight, 0 without any. Extra columns are ignored.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    index = rare_index(inverse_frequencies(own))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(NON_ALNUM_BYTES, lower=True)
        for batch in batches:
            for lo, hi, texts in text_chunks(batch.column(1)):
                n_docs = hi - lo
                h, offsets = words.hash_documents(texts)
                owner = owners(offsets)
                n_base, base = np.zeros(n_docs, np.int64), [set() for _ in range(n_docs)]
                first, last = np.full(n_docs, np.iinfo(np.int64).max), np.full(n_docs, -1)
                for label, phrase in index.base:
                    at = np.flatnonzero(h == np.uint64(phrase[0]))
                    at = at[at + len(phrase) <= len(h)]
                    for k, x in enumerate(phrase[1:], 1):
                        at = at[(h[at + k] == np.uint64(x)) & (owner[at + k] == owner[at])]
                    own, start = owner[at], at - offsets[owner[at]]
                    np.add.at(n_base, own, 1)
                    np.minimum.at(first, own, start)
                    np.maximum.at(last, own, start)
                    for i in set(own.tolist()):
                        base[i].add(label)
                labels, scores = [set(b) for b in base], np.zeros(n_docs)
                at, which = _known(h, index.hashes, index.maybe)
                files = owner[at]
                for group in np.split(np.arange(len(at)), np.flatnonzero(np.diff(files)) + 1) if len(at) else []:
                    i = int(files[group[0]])
                    anchors = list(zip((at[group] - offsets[i]).tolist(), which[group].tolist(), strict=True))
                    if len({w for _, w in anchors}) < 2:
                        continue
                    found, scores[i] = scan_words(h[offsets[i] : offsets[i + 1]], anchors, index)
                    labels[i] |= found
                join = lambda sets: pa.array([",".join(sorted(s)) for s in sets], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, n_docs), pa.array(np.diff(offsets)), pa.array(n_base), pa.array(first, mask=n_base == 0), pa.array(last.astype(np.int64), mask=n_base == 0), join(base), join(labels), pa.array(scores)],
                    names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
                )

    return own.mapInArrow(judge, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def words_of(text: str | None) -> list[str]:
    """The words a scan sees, for tests and inspection."""
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
