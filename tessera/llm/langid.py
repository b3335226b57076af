"""Language identification: known words first, shorter and shorter character n-grams for unseen ones.

A word is a Unicode letter with the letters and marks that follow it.
`fit` counts words and character n-grams (of words marked with ^ and $) per language over labelled rows. Where there are more than
`train_docs` labelled rows of a language, a hashed share of about that many is taken, which bounds the fit and the model that is broadcast:
it grows with the languages, not with the rows. All entries of these rows are kept, with their counts in all languages. Entries
are held as 64-bit hashes, and only the languages that have an entry are stored with it; of entries seen once in all, which are most, only the language.
`identify` adds, over all words of a whole text, a vector with an entry for each language: log frequencies of
the word where it is known, else the mean log frequencies of its known n-grams of the longest length that has any.

Edge cases: a null text or one without letters (digits, numerals and symbols are none) is `und` with score 0. Rows with a null lang or doc_id teach nothing.
Without any labelled row all texts are `und`. Ties go to the language that sorts first. Rows that repeat are predicted alike. Very long texts are read whole; a very long word counts with all
its n-grams, some at a time, and is not cached. Other columns are ignored but for those carried, which may have any name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import alone, bound_batches, tidy

WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
LONGEST = 5
KINDS = ("w", *map(str, range(1, LONGEST + 1)))
#: Words that a task's cache holds, the length of those that it leaves out, and the n-grams of such that are looked up at a time.
CACHE = 60_000
LONG = 64
SOME = 65_536
#: Documents whose n-grams are counted together in a worker.
DOCS = 250


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def grams_of(word: str, n: int) -> list[str]:
    """The word's n-grams with its ends marked. Very long words (unbroken scripts, noise) keep all of theirs."""
    marked = f"^{word}$"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def hash_of(kind: str, entry: str) -> int:
    return xxhash.xxh64_intdigest(entry.encode(), KINDS.index(kind))


class Entries:
    """Log frequencies by language of the entries of one kind: sorted hashes, and for each what its languages have above an entry not seen. Entries seen once in all are apart: a hash
    and a language each."""

    def __init__(self, kind: str, hashes: np.ndarray, langs: np.ndarray, n: np.ndarray, n_langs: int, smooth: float):
        order = np.lexsort((langs, hashes))
        hashes, langs, n = hashes[order], langs[order], n[order]
        starts = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.empty(0, np.int64)
        sizes = np.diff(np.append(starts, len(hashes)))
        once = (sizes == 1) & (n[starts] == 1)
        rest = ~np.repeat(once, sizes)
        self.kind, self.keys, self.once = kind, hashes[starts[~once]], hashes[starts[once]]
        self.langs, self.once_langs = langs[rest].astype(np.int32), langs[starts[once]].astype(np.min_scalar_type(n_langs))
        self.starts = np.concatenate([[0], np.cumsum(sizes[~once])])
        self.absent = np.log(smooth / np.maximum(np.bincount(langs, weights=n, minlength=n_langs) + smooth * len(starts), smooth))
        self.more, self.once_more = np.log((n[rest] + smooth) / smooth), np.log((1 + smooth) / smooth)

    def find(self, entries: Sequence[str]) -> np.ndarray:
        """The entries' places, -1 where not known; those seen once come behind the others."""
        hashes = np.fromiter((hash_of(self.kind, x) for x in entries), np.uint64, len(entries))
        found = np.full(len(hashes), -1)
        for keys, first in ((self.keys, 0), (self.once, len(self.keys))):
            if len(keys):
                at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                found = np.where(keys[at] == hashes, first + at, found)
        return found

    def logs(self, places: np.ndarray) -> np.ndarray:
        out = np.tile(self.absent, (len(places), 1))
        single = np.flatnonzero(places >= len(self.keys))
        out[single, self.once_langs[places[single] - len(self.keys)]] += self.once_more
        many = np.flatnonzero(places < len(self.keys))
        first = self.starts[places[many]]
        each = self.starts[places[many] + 1] - first
        at = np.arange(int(each.sum())) + np.repeat(first - np.cumsum(each) + each, each)
        out[np.repeat(many, each), self.langs[at]] += self.more[at]
        return out


class Grams:
    """n-grams of all lengths."""

    def __init__(self, by_size: dict[int, Entries]):
        self.by_size = by_size

    def __getitem__(self, gram: str) -> np.ndarray:
        own = self.by_size[len(gram)]
        place = own.find([gram])
        if place[0] < 0:
            raise KeyError(gram)
        return own.logs(place)[0]


class Model:
    """Log frequencies by language of `words` and `grams`."""

    def __init__(self, langs: list[str], entries: list[tuple[str, str, str, int]], smooth: float = 0.5):
        """entries: (lang, kind, entry, count), kind "w" or the n-gram's length."""
        names = sorted(langs)
        place = {lang: i for i, lang in enumerate(names)}
        found: Counter = Counter()
        for lang, kind, entry, n in entries:
            found[place[lang], KINDS.index(kind), hash_of(kind, entry)] += n
        keys = list(found)
        columns = [np.array([k[i] for k in keys], dtype) for i, dtype in enumerate((np.int32, np.int8, np.uint64))]
        self._set(names, *columns, np.array([found[k] for k in keys], np.int64), smooth)

    @classmethod
    def of_counts(cls, langs: list[str], lang: np.ndarray, kind: np.ndarray, hashes: np.ndarray, n: np.ndarray, smooth: float = 0.5) -> Model:
        """langs sorted; lang and kind are places in `langs` and KINDS."""
        model = cls.__new__(cls)
        model._set(langs, lang, kind, hashes, n, smooth)
        return model

    def _set(self, langs: list[str], lang: np.ndarray, kind: np.ndarray, hashes: np.ndarray, n: np.ndarray, smooth: float) -> None:
        own = [Entries(name, *(c[kind == k] for c in (hashes, lang, n)), len(langs), smooth) for k, name in enumerate(KINDS)]
        self.langs, self.words, self.grams = langs, own[0], Grams(dict(enumerate(own[1:], 1)))

    def scores(self, words: Sequence[str]) -> np.ndarray:
        """A row for each word: its own log frequencies, or the means of its longest known n-grams."""
        out = np.zeros((len(words), len(self.langs)))
        place = self.words.find(words)
        known = place >= 0
        out[known] = self.words.logs(place[known])
        open_ = np.flatnonzero(~known)
        for n in range(LONGEST, 0, -1):
            if not len(open_):
                break
            grams = [grams_of(words[w], n) for w in open_]
            place = self.grams.by_size[n].find([x for own in grams for x in own])
            of = np.repeat(np.arange(len(open_)), [len(own) for own in grams])[place >= 0]
            each = np.bincount(of, minlength=len(open_))
            some = each > 0
            if some.any():
                logs = self.grams.by_size[n].logs(place[place >= 0])
                out[open_[some]] = np.add.reduceat(logs, (np.cumsum(each) - each)[some]) / each[some][:, None]
            open_ = open_[~some]
        return out

    def score(self, word: str) -> np.ndarray:
        """As `scores`, for one word of any length."""
        place = self.words.find([word])
        if place[0] >= 0:
            return self.words.logs(place)[0]
        marked = f"^{word}$"
        for n in range(LONGEST, 0, -1):
            own, total, times = self.grams.by_size[n], np.zeros(len(self.langs)), 0
            for begin in range(0, len(marked) - n + 1, SOME):
                end = min(begin + SOME, len(marked) - n + 1)
                place = own.find([marked[i : i + n] for i in range(begin, end)])
                total += own.logs(place[place >= 0]).sum(axis=0)
                times += int((place >= 0).sum())
            if times:
                return total / times
        return np.zeros(len(self.langs))

    def predict(self, text: str | None) -> tuple[str, float]:
        return Scorer(self).predict(text)


class Scorer:
    """Predictions of a model, with a bounded table of the words met so far."""

    def __init__(self, model: Model):
        self.model, self.known, self.table = model, {}, np.zeros((4096, len(model.langs)))

    def learn(self, words: list[str]) -> None:
        if len(self.known) + len(words) > CACHE:
            self.known.clear()
        for i in range(0, len(words), 4096):
            some, used = words[i : i + 4096], len(self.known)
            if used + len(some) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[used : used + len(some)] = self.model.scores(some)
            self.known.update(zip(some, range(used, used + len(some))))

    def predict(self, text: str | None) -> tuple[str, float]:
        words, langs = words_of(text), self.model.langs
        if not words or not langs:
            return "und", 0.0
        total = np.zeros(len(langs))
        if len(max(words, key=len)) > LONG:
            for word, n in Counter(w for w in words if len(w) > LONG).items():
                total += n * self.model.score(word)
            words = [w for w in words if len(w) <= LONG]
        for i in range(0, len(words), 4096):
            some = words[i : i + 4096]
            if new := set(some).difference(self.known):
                self.learn(list(new if len(self.known) + len(new) <= CACHE else set(some)))
            rows = np.fromiter(map(self.known.__getitem__, some), np.int64, len(some))
            total += self.table[rows].sum(axis=0)
        best = int(np.argmax(total))
        return langs[best], float(1 / np.exp(total - total[best]).sum())


def fit(docs: DataFrame, train_docs: int = 3000) -> Model:
    """A model from the rows of `docs` (doc_id, text, lang) whose lang is known."""
    rows = docs.where("lang is not null and text is not null and doc_id is not null")
    sizes = rows.groupBy("lang").count().collect()  # a row for each language
    if not sizes:
        return Model([], [])
    langs = sorted(lang for lang, _ in sizes)
    places = {lang: i for i, lang in enumerate(langs)}
    share = F.create_map(*(F.lit(x) for lang, n in sizes for x in (lang, min(1.0, train_docs / n))))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 53)) / float(1 << 53)
    bound_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("langid")
        for batch in (b.slice(i, DOCS) for b in batches for i in range(0, b.num_rows, DOCS)):
            words: dict[str, Counter] = {}
            for text, lang in zip(batch.column(0), batch.column(1)):
                words.setdefault(lang.as_py(), Counter()).update(words_of(text.as_py()))
            out: Counter = Counter()
            for lang, own in words.items():
                for word, n in own.items():
                    out[lang, "w", word] += n
                    for size in range(1, LONGEST + 1):
                        for gram in grams_of(word, size):
                            out[lang, str(size), gram] += n
            lang = pa.array([places[k[0]] for k in out], pa.int32())
            kind = pa.array([KINDS.index(k[1]) for k in out], pa.int8())
            entry = pa.array(np.fromiter((hash_of(k[1], k[2]) for k in out), np.uint64, len(out)).view(np.int64))
            yield pa.RecordBatch.from_arrays([lang, kind, entry, pa.array(list(out.values()), pa.int64())], ["lang", "kind", "entry", "n"])

    sample = rows.where(place < F.element_at(share, F.col("lang"))).select("text", "lang")
    counts = sample.mapInArrow(tidy(count), "lang int, kind byte, entry long, n long").groupBy("lang", "kind", "entry").agg(F.sum("n").alias("n")).toArrow()
    lang, kind, entry, n = (counts.column(c).to_numpy() for c in ("lang", "kind", "entry", "n"))
    return Model.of_counts(langs, lang, kind, entry.view(np.uint64), n)


def identify(docs: DataFrame, model: Model, carry: Sequence[str] = ()) -> DataFrame:
    """A row for each row of `docs` (doc_id, text): doc_id, lang_pred, score, and the columns in `carry` as carry_0, carry_1, ..

    The score is the posterior of the language under equal priors."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    bound_batches(docs.sparkSession)
    sent = list(dict.fromkeys(["doc_id", "text", *carry]))  # a column goes to the workers once, also if it is carried
    places = [sent.index(c) for c in carry]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("langid")
        own = Scorer(shared.value)
        for batch in batches:
            found = [own.predict(text.as_py()) for text in batch.column(1)]
            names = ["doc_id", "lang_pred", "score", *(f"carry_{i}" for i in range(len(places)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([p for _, p in found], pa.float64()), *(batch.column(i) for i in places)], names)

    rows = docs.select(*(F.col(c).alias(f"sent_{i}") for i, c in enumerate(sent)))
    kinds = [f.dataType.simpleString() for f in rows.schema.fields]
    schema = ", ".join([f"doc_id {kinds[0]}, lang_pred string, score double", *(f"carry_{i} {kinds[place]}" for i, place in enumerate(places))])
    return rows.mapInArrow(tidy(predict), schema)


def held_out() -> Column:
    """Whether a document is kept from training: the checksum of its id's digits leaves 2 modulo 4."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
