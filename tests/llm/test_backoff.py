"""Backoff scores against a plain version with dictionaries, which scores each token by its recursive definition."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import backoff, queries

SCHEMA = "doc_id long, text string, held boolean"


def tokens_of(text):
    lower = "".join(c.lower() if c < "\x80" else c for c in text or "")
    return [*re.findall("[^\x20\x09-\x0d]+", lower), ""]


class Plain:
    def __init__(self, texts, order, weights):
        self.order, self.m = order, weights
        self.counts = [Counter() for _ in range(order + 1)]
        for text in texts:
            t = [" ", *tokens_of(text)]
            for i in range(1, len(t)):
                for k in range(1, min(order, i + 1) + 1):
                    self.counts[k][tuple(t[i + 1 - k : i + 1])] += 1
        self.counts[1][" ",] = self.counts[1]["",]
        self.n = sum(n for w, n in self.counts[1].items() if w != (" ",))
        self.v = len([w for w, n in self.counts[1].items() if n and w != (" ",)])

    def chance(self, context, word):
        if not context:
            return (self.counts[1][word,] + 0.5) / (self.n + 0.5 * (self.v + 1))
        k = len(context)
        m = self.m[k - 1]
        return (self.counts[k + 1][*context, word] + m * self.chance(context[1:], word)) / (self.counts[k][context] + m)

    def score(self, text):
        t = [" ", *tokens_of(text)]
        known = sum(self.counts[1][w,] > 0 for w in t[1:])
        base = sum(math.log10(self.chance((), w)) for w in t[1:])
        return len(t) - 1, known, base, sum(math.log10(self.chance(tuple(t[max(0, i - self.order + 1) : i]), t[i])) for i in range(1, len(t)))


def invented(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["É", "A", "a", "b\xa0c"]
    texts, out = ["", None, "A\tB\n  a"], []
    for i in range(n):
        texts.append(" ".join(rng.choice(words[: 5 + i % 30]) for _ in range(rng.choice([1, 3, 20, 60]))))
    for i, text in enumerate(texts):
        out.append((i if i % 11 else None, text, i % 5 == 1))
    return out + out[4:9]


@pytest.mark.parametrize("order,size", [(1, 1 << 20), (2, 300), (2, 1 << 20), (3, 500), (4, 200)])
def test_scores(spark, order, size, monkeypatch):
    monkeypatch.setattr(backoff, "MEET", 500)
    rows = invented(3, 120)
    fits = []
    monkeypatch.setattr(backoff, "fitted", lambda sums, order, f=backoff.fitted: fits.append(f(sums, order)) or fits[0])
    got = backoff.scores(spark.createDataFrame(rows, SCHEMA).repartition(3), order, size).collect()
    plain = Plain([t for _, t, held in rows if not held], order, fits[0].weights)
    assert {r.train_tokens for r in got} == {plain.n} and fits[0].types == plain.v
    key = lambda r: tuple((x is not None, x) for x in r)
    want = sorted(((i, held, *plain.score(t)) for i, t, held in rows), key=key)
    found = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.base_score, r.score) for r in got), key=key)
    assert len(found) == len(want)
    for a, b in zip(found, want):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], rel=1e-9, abs=1e-9)
    seen = [c for c in plain.counts[order - 1] if c[-1]] if order > 1 else []
    for context in [(), *seen[:9]]:
        words = [w for (w,) in plain.counts[1] if w != " "]
        assert sum(plain.chance(context, w) for w in [*words, "unknown"]) == pytest.approx(1)


def test_long_texts_are_cut_without_a_trace(monkeypatch):
    rng = random.Random(4)
    text = " ".join(rng.choice("abcdefg") * rng.randrange(1, 4) for _ in range(9_000)) + " " + "z" * 70_000
    monkeypatch.setattr(backoff, "CHUNK", 1_000)
    cut = list(backoff.words_of(text))
    assert len(cut) > 10 and [w for some in cut for w in some] == text.encode().split()
    # pieces of a text in blocks of their own
    own = backoff.Builder()
    lead = [b" "]
    for place, some in enumerate(cut):
        own.add(0, place, 0, False, lead, some)
        lead = [*lead, *some][-2:]
    row = own.packed()
    block = backoff.Block(row, 3)
    once = backoff.Builder()
    once.add(0, 0, 0, False, [b" "], [w for some in cut for w in some])
    single = backoff.Block(once.packed(), 3)
    for a, b in zip(block.levels, single.levels):
        assert dict(zip(a.hashes.tolist(), a.counts.tolist())) == dict(zip(b.hashes.tolist(), b.counts.tolist()))
    corpus = backoff.Corpus(len(single.tokens) - 1, single.n_words - 2, [2.0, 3.0])
    sums = []
    for x in (block, single):
        _, begin, lead, size = backoff.strips(x, 3)
        sums.append(backoff.Automaton(x, [y.counts for y in x.levels], corpus).read(x.tokens, begin, lead, size).sum())
    assert sums[0] == pytest.approx(sums[1], rel=1e-9)


def test_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op11_lm_scores(spark, sf_dir).collect()}
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 5 == 1 for r in rows}
    plain = Plain([r.text for r in rows if not held[r.doc_id]], 1, [])
    assert len(got) == len(rows)
    for r in rows:
        n, known, base, _ = plain.score(r.text)
        found = got[r.doc_id]
        assert (found.held_out, found.n_tokens, found.n_known, found.train_tokens) == (held[r.doc_id], n, known, plain.n)
        assert found.base_score == pytest.approx(base, rel=1e-9)
    kept = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in kept) > sum(r.base_score for r in kept)  # contexts help on texts that taught nothing


def test_odd_tables(spark):
    assert backoff.scores(spark.createDataFrame([], SCHEMA)).count() == 0
    untaught = backoff.scores(spark.createDataFrame([(1, "a b", True)], SCHEMA)).collect()
    assert [tuple(r) for r in untaught] == [(1, True, 3, 0, 0, 0.0, 0.0)]


def test_packing():
    numbers = np.array([0, 5, 2**63], np.uint64)
    assert (backoff.unpack(backoff.pack(numbers), np.uint64, 3) == numbers).all()
    assert len(backoff.unpack(backoff.pack(numbers[:0]), np.uint64, 0)) == 0


def test_texts_of_several_pieces(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, " ".join(f"{rng.randrange(300) ** 2:05d}" for _ in range(n)), i == 1) for i, n in enumerate((450_000, 200_000, 10))]
    fits = []
    monkeypatch.setattr(backoff, "fitted", lambda sums, order, f=backoff.fitted: fits.append(f(sums, order)) or fits[0])
    got = backoff.scores(spark.createDataFrame(rows, SCHEMA), 3, 700_000).collect()
    plain = Plain([t for _, t, held in rows if not held], 3, fits[0].weights)
    for r in got:
        n, known, base, score = plain.score(rows[r.doc_id][1])
        assert (r.n_tokens, r.n_known) == (n, known) and (r.base_score, r.score) == pytest.approx((base, score), rel=1e-9)
