"""Spelling variants: words one edit apart, and each word's commonest near form.

A word's occurrences are counted over all texts. Two words are near if one inserted, deleted or replaced character makes them equal. Such a pair parts at one
node of the words' trie, that of their common prefix: below it, either both have one more character, unlike ones, and then the same rest; or one has a
character more, and behind it what the other has here. So the subtrees below a node are merged with one character skipped or replaced, and
terminals that coincide are the pairs. By heavy-path decomposition only the light subtrees of a node are gone through: each is merged into the largest one and
into what was merged of the light ones before it, so a word is touched once for each light edge above it, of which it has a logarithm at most.

The trie is cut where range partitions of the sorted words end. Within a partition a node is a range of sorted words and its children are found by
bisection, so paths without branches cost nothing, whatever their length. Nodes above a cut are prefixes of the partition's first or last word; there each word sends what remains of
it, with one character skipped or replaced, as a hash, and terminals that coincide meet by a shuffle. They are at most as many as letters that may stand at one
place, and one more.

A word's form is its near word that occurs most (of equals the first by code points), if it occurs `ratio` times as often; its root is
the end of the chain of forms. Frequencies grow along it, so there are no circles, and it is short: it is followed by doubling.

Edge cases: a null or empty text has no words, very long texts and words are read whole; a null id reads as an empty one; rows that repeat count again; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import alone, bound_batches, durable, partitions_of, tidy

#: Code points of a word, at least.
SHORTEST = 7
#: Fixed value: a word's letters, before A-Z are lower-cased.
RUN = re.compile(rf"[A-Za-zÀ-ÿ]{{{SHORTEST},}}")
#: One of so many occurrences loses a letter.
ODDS = 31
#: Words counted together in a worker, and sorted words of a partition, about.
HELD = 200_000
SORTED = 60_000


def words_of(doc_id: int | None, text: str | None) -> Counter:
    """The words of a text, after the damage that a checksum of `id:word` deals: it takes one code point of some words, all of a document's alike."""
    found = Counter(RUN.findall(text or ""))
    lower: Counter = Counter()
    for run, n in found.items():
        lower[run.encode().lower().decode()] += n  # on bytes: A-Z only
    out: Counter = Counter()
    prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for word, n in lower.items():
        h = zlib.crc32(word.encode(), prefix)
        if h % ODDS == 0:
            k = h % len(word)
            word = word[:k] + word[k + 1 :]
        if len(word) >= SHORTEST:
            out[word] += n
    return out


def counted(docs: DataFrame, least: int = 2) -> DataFrame:
    """(word, n): words of the whole texts of `docs` (doc_id, text) that occur `least` times."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("spelling")
        held: Counter = Counter()

        def flushed() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.update(words_of(doc_id, text.as_py()))
                if len(held) > HELD:
                    yield flushed()
        if held:
            yield flushed()

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class Near:
    """The near words that one word has been found to have: how many, and the first by number of occurrences, then by name."""

    def __init__(self, words: list[str], n: list[int]):
        self.words, self.n = words, n
        self.times = [0] * len(words)
        self.best = [-1] * len(words)

    def better(self, i: int, j: int) -> bool:
        return j < 0 or (-self.n[i], self.words[i]) < (-self.n[j], self.words[j])

    def add(self, i: int, j: int) -> None:
        self.times[i] += 1
        if self.better(j, self.best[i]):
            self.best[i] = j

    def pair(self, i: int, j: int) -> None:
        self.add(i, j)
        self.add(j, i)

    def all_of(self, same: list[int]) -> None:
        """All of these are near to each other: known by the first two and their number, without pairs."""
        first, second = sorted(same, key=lambda i: (-self.n[i], self.words[i]))[:2]
        for i in same:
            self.times[i] += len(same) - 1
            other = second if i == first else first
            if self.better(other, self.best[i]):
                self.best[i] = other


def merge(words: list[str], n: list[int], before: str | None = None, after: str | None = None) -> Near:
    """Near words among the sorted `words`, but for pairs that part at a prefix of `before` or `after`, the words beside the list."""
    near, at = Near(words, n), {word: i for i, word in enumerate(words)}
    todo = [(0, len(words))]
    while todo:
        low, high = todo.pop()
        if high - low < 2:
            continue
        prefix = commonprefix((words[low], words[high - 1]))
        depth = len(prefix)
        children, i = [], low + (len(words[low]) == depth)  # a word that ends here comes first
        while i < high:
            j = bisect_left(words, prefix + chr(ord(words[i][depth]) + 1), i, high)
            children.append((i, j))
            i = j
        todo += children
        if any(x is not None and x.startswith(prefix) for x in (before, after)):
            continue  # the node goes on beyond this list
        heavy = max(children, key=lambda x: x[1] - x[0])
        head = prefix + words[heavy[0]][depth]
        merged: dict[str, list[int]] = {}
        for a, b in [(low, low + (len(words[low]) == depth)), *children]:
            if (a, b) == heavy:
                continue
            for i in range(a, b):
                word = words[i]
                j = at.get(head + word[depth:])  # in the heavy subtree, with its character skipped
                if j is not None:
                    near.pair(i, j)
                if len(word) > depth:
                    rest = word[depth + 1 :]
                    merged.setdefault(rest, []).append(i)  # with the character replaced
                    if rest[:1] != word[depth]:  # of equal characters, the last counts as skipped
                        j = at.get(prefix + rest)
                        if j is not None:
                            near.pair(i, j)
        for rest, same in merged.items():
            j = at.get(head + rest)
            if j is not None:
                same.append(j)
            if len(same) > 1:
                near.all_of(same)
    return near


def remainders(word: str, before: str | None, after: str | None) -> Iterator[tuple[bytes, int]]:
    """For the nodes of the word's path that go on beyond its list: hashes of what may coincide, and the word's part in it: it lacks the character (0), has it
    (1), or has another (2)."""
    if before is None and after is None:
        return
    top = max(len(commonprefix((word, x))) for x in (before, after) if x is not None)
    for depth in range(top + 1):
        yield xxhash.xxh3_128_digest(f"{depth}-{word}"), 0
        if depth < len(word):
            rest = word[:depth] + word[depth + 1 :]
            if word[depth + 1 : depth + 2] != word[depth]:
                yield xxhash.xxh3_128_digest(f"{depth}-{rest}"), 1
            yield xxhash.xxh3_128_digest(f"{depth}*{rest}"), 2


def near_words(words: DataFrame, size: int = SORTED) -> DataFrame:
    """(word, n_near, form_n, form): of the distinct `words` (word, n) that have near ones, their number and the one that occurs most. `size`: words of a partition, about."""
    parts = max(partitions_of(words), -(-words.count() // size))
    dealt = durable(words.select("word", "n", F.lit(0).alias("part")).repartitionByRange(parts, "word").sortWithinPartitions("word").withColumn("part", F.spark_partition_id()))
    ends = sorted(tuple(r) for r in dealt.groupBy("part").agg(F.min("word"), F.max("word")).collect())  # a row for each partition
    shared = words.sparkSession.sparkContext.broadcast({p: (ends[i - 1][2] if i else None, ends[i + 1][1] if i + 1 < len(ends) else None) for i, (p, _, _) in enumerate(ends)})
    schema = "key binary, role int, word string, n long, n_near long, form_n long, form string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("spelling")
        words, n, part = [], [], None
        for batch in batches:
            words += batch.column(0).to_pylist()
            n += batch.column(1).to_pylist()
            part = batch.column(2)[0].as_py() if part is None and batch.num_rows else part
        if not words:
            return
        before, after = shared.value[part]
        near = merge(words, n, before, after)
        found = [i for i, k in enumerate(near.times) if k]
        kinds = [pa.binary(), pa.int32(), pa.string(), *[pa.int64()] * 3, pa.string()]
        names = [x.split()[0] for x in schema.split(", ")]
        rows = [[None] * len(found), [None] * len(found), [words[i] for i in found], [n[i] for i in found], [near.times[i] for i in found], [n[near.best[i]] for i in found], [words[near.best[i]] for i in found]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)], names)
        for begin in range(0, len(words), 4096):
            sent = [(key, role, words[i], n[i]) for i in range(begin, min(begin + 4096, len(words))) for key, role in remainders(words[i], before, after)]
            rows = [*(zip(*sent) if sent else [[]] * 4), *[[None] * len(sent)] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)], names)

    made = dealt.mapInArrow(tidy(run), schema)
    within = made.where("key is null").select("word", "n_near", "form_n", "form")
    # what coincides above the cuts: at most a word for each letter, and one; the first of a word's partners is the one that occurs most
    member = F.struct((-F.col("n")).alias("less"), "word", "role")
    met = made.where("key is not null").groupBy("key").agg(F.array_sort(F.collect_list(member)).alias("all")).where("size(all) > 1")
    one = met.select("all", F.explode("all").alias("own"))
    partners = F.filter("all", lambda x: (x["role"] != F.col("own.role")) | ((x["role"] == 2) & (x["word"] != F.col("own.word"))))
    across = one.select(F.col("own.word").alias("word"), partners.alias("of")).where("size(of) > 0")
    across = across.select("word", F.size("of").cast("long").alias("n_near"), (-F.col("of")[0]["less"]).alias("form_n"), F.col("of")[0]["word"].alias("form"))
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best")
    both = within.unionByName(across).groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return both.select("word", "n_near", (-F.col("best.less")).alias("form_n"), F.col("best.form").alias("form"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): of words with a form (word, form), the end of the chain of forms."""
    found = durable(forms.select("word", F.col("form").alias("root")))
    while True:
        then = found.select(F.col("word").alias("root"), F.col("root").alias("last"))
        met = durable(found.join(then, "root", "left").select("word", F.coalesce("last", "root").alias("root"), F.col("last").isNotNull().alias("more")))
        found = met.select("word", "root")
        if met.where("more").isEmpty():
            return found


def variants(docs: DataFrame, least: int = 2, ratio: int = 10, size: int = SORTED) -> DataFrame:
    """(word, form, root, n, n_near, form_n): a row for each word of `docs` (doc_id, text)."""
    words = durable(counted(docs, least))
    near = durable(near_words(words, size))
    met = words.join(near, "word", "left")
    has = F.col("form_n") >= ratio * F.col("n")
    rows = met.select("word", F.when(has, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("form_n")).alias("form_n"))
    ends = roots(rows.where("form is not null"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
