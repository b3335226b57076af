"""Spelling variants against a plain version that tries every edit of every word."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tessera.llm import queries, spelling


def plain_words(rows):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 31 == 0:
                k = h % len(word)
                word = word[:k] + word[k + 1 :]
            found[word] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def plain_near(n):
    near = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            shorter = w[:i] + w[i + 1 :]
            near[1, shorter].add(w)
            near[0, w[:i], w[i + 1 :]].add(w)
    out = {w: set() for w in n}
    for key, some in near.items():
        for w in some:
            if key[0] == 0:
                out[w] |= some - {w}
            elif key[1] in n:
                out[w].add(key[1])
                out[key[1]].add(w)
    return out


def plain_variants(n):
    near = plain_near(n)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] is not None else None))
    return out


def invented(seed, n, letters, sizes):
    rng = random.Random(seed)
    words = set()
    while len(words) < n:
        w = "".join(rng.choice(letters) for _ in range(rng.choice(sizes)))
        words.add(w)
        for _ in range(rng.randrange(4) if len(w) > 4 else 0):
            i, c = rng.randrange(len(w)), rng.choice(letters)
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]])
            words.add(w)
    return sorted(words)


@pytest.mark.parametrize("letters,sizes", [("ab", range(1, 9)), ("aé", [7, 8]), ("abcdefgh", [3, 7, 8, 9])])
def test_merge(letters, sizes):
    words = invented(5, 150, letters, list(sizes))
    n = {w: random.Random(w).randrange(1, 40) for w in words}
    found, near = spelling.merge(words, [n[w] for w in words]), plain_near(n)
    assert {w: k for w, k in zip(words, found.times)} == {w: len(x) for w, x in near.items()}
    for w, b in zip(words, found.best):
        assert (words[b] if b >= 0 else None) == min(near[w], key=lambda x: (-n[x], x), default=None)


@pytest.mark.parametrize("size", [7, 60_000])
def test_near_words(spark, size):
    words = invented(6, 400, "abc", [1, 2, 6, 7, 8]) + ["d" * 40_000, "d" * 40_001]
    n = {w: random.Random(w).randrange(1, 40) for w in words}
    got = spelling.near_words(spark.createDataFrame(list(n.items()), "word string, n long"), size).collect()
    near = plain_near({w: k for w, k in n.items() if len(w) < 99}) | {"d" * 40_000: {"d" * 40_001}, "d" * 40_001: {"d" * 40_000}}
    best = {w: min(x, key=lambda y: (-n[y], y)) for w, x in near.items() if x}
    assert {(r.word, r.n_near, r.form, r.form_n) for r in got} == {(w, len(near[w]), b, n[b]) for w, b in best.items()} and len(got) == len(best)


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op12_spelling_variants(spark, sf_dir).collect()
    assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == plain_variants(plain_words(rows)) and len(got) == len(plain_words(rows))


def test_chains_and_odd_texts(spark):
    chain = ["abcdefg"] * 2 + ["abcdefgh"] * 25 + ["abcdefghi"] * 260 + ["Abcdefgz"] * 3
    rows = [(i, " ".join(chain[i::50])) for i in range(50)] + [(1, None), (None, ""), (None, "überlängé überlängé"), (7, "x" * 2_000), (8, "x" * 2_000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, word long")
    got = {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(docs).collect()}
    assert got == plain_variants(plain_words(rows))
    assert ("abcdefg", "abcdefgh", "abcdefghi") in {x[:3] for x in got}
    assert spelling.variants(docs.limit(0)).count() == 0
