"""Language-model scoring by a weighted backoff automaton.

Words are what white space of ASCII separates, A-Z lower-cased; a text's tokens are its words and one end. All n-grams of the training texts are counted. The probability of a word
behind a context mixes the n-gram's count with the shorter context's probability, (c(hw) + m p(w|h')) / (c(h) + m), down to the single token,
(c + 0.5) / (N + 0.5 (V + 1)), whose one spare type is all unknown words together: probabilities of all words, the end and the spare type sum to one. `m` is fitted for each order
so that the mass of unseen followers is the share of n-grams seen once (Good and Turing). As an automaton: a context that was seen is a state; an n-gram that was seen is an arc
from its context, weighing its log10 probability, to its longest suffix that is a state; and a failure arc, weighing log10 of m / (c(h) + m), leads from a
state to the one of the context less its first word. A text is read once from left to right, carrying a state.

The automaton of a corpus is as large as the corpus, so it is never in one place. Texts are cut into blocks of some megabytes. A block sends each of its n-grams once, with its count, to
the task of a hash range, where counts meet; it is told those that differ from its own. So a block has exactly the states and arcs that its texts
can take, and reads all its texts together, a token of each at a time. Long texts are cut: a piece first reads as many words before it as the automaton
remembers, without counting them.

N-grams meet by 61 bits of a hash. A task holds some N-grams (MEET) and an n-gram is sent once for each block that has it.

Edge cases: a null or empty text is its end alone; rows without doc_id are trained on and not held out; without any training text all is unknown and scores 0; rows that repeat count
again; very long texts and words are read whole; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import alone, bound_batches, durable, partitions_of, tidy

#: Bytes of a block's texts, and of a piece that is split into words at a time.
BLOCK = 16 << 20
CHUNK = 1 << 20
#: n-grams that meet in a task, about; tokens that are read in a row before a text is cut.
MEET = 4_000_000
STRIP = 1024
#: A block's words 0 and 1, and names for them that no word has.
START, END = 0, 1
NAMES = (b" ", b"")
SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Unseen and half-seen tokens.
HALF = 0.5
#: Bins of the contexts' counts, four for each doubling.
BINS = 256


def held_out() -> Column:
    """Whether a document is kept from training: the checksum of its id's digits leaves 1 modulo 5."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 1, F.lit(False))


def pack(numbers: np.ndarray) -> bytes:
    """Compressed, the numbers' bytes of equal weight together."""
    planes = np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, numbers.itemsize).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes, dtype: type, n: int) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    raw = np.frombuffer(pa.decompress(data, n * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, n).T).view(dtype).ravel()


def words_of(text: str | None) -> Iterator[list[bytes]]:
    """The text's words, some at a time."""
    data, begin = (text or "").encode().lower(), 0
    while begin < len(data):
        space = SPACE.search(data, begin + CHUNK) if begin + CHUNK < len(data) else None
        end = space.start() if space else len(data)
        yield data[begin:end].split()
        begin = end


class Builder:
    """A block under construction: its words' numbers, and the pieces of texts."""

    def __init__(self) -> None:
        self.numbers: dict[bytes, int] = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self.numbers |= {name: i for i, name in enumerate(NAMES)}
        self.size, self.parts, self.pieces = 0, [], []

    def add(self, row: int, place: int, doc_id: int | None, held: bool, lead: list[bytes], words: list[bytes]) -> None:
        own = [*lead, *words]
        self.parts.append(np.fromiter(map(self.numbers.__getitem__, own), np.int32, len(own)))
        self.pieces.append((row, place, doc_id, held, len(lead), len(own)))
        self.size += sum(map(len, words)) + len(words)

    def packed(self) -> dict:
        tokens = np.concatenate(self.parts)
        times = np.bincount(tokens, minlength=len(self.numbers))
        order = np.concatenate([[START, END], 2 + np.argsort(-times[2:], kind="stable")])  # common words have small numbers
        names = list(self.numbers)
        hashes = np.fromiter((xxhash.xxh64_intdigest(names[i]) for i in order), np.uint64, len(order))
        number = np.empty(len(order), np.int32)
        number[order] = np.arange(len(order), dtype=np.int32)
        columns = dict(zip(("rows", "places", "ids", "held", "leads", "sizes"), map(list, zip(*self.pieces))))
        return {"n_words": len(hashes), "words": pack(hashes), "n_tokens": len(tokens), "tokens": pack(number[tokens])} | columns


BLOCKS = pa.schema([
    ("block", pa.int64()), ("n_words", pa.int64()), ("words", pa.binary()), ("n_tokens", pa.int64()), ("tokens", pa.binary()), ("rows", pa.list_(pa.int64())), ("places", pa.list_(pa.int64())),
    ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("leads", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())),
])
_KINDS = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.float64(): "double", pa.bool_(): "boolean"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} " + (f"array<{_KINDS[f.type.value_type]}>" if pa.types.is_list(f.type) else _KINDS[f.type]) for f in schema)


def blocks_of(docs: DataFrame, order: int, size: int) -> DataFrame:
    """A row for each block of the texts of `docs` (doc_id, text, held), written: what follows goes by the blocks' numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("backoff")
        first = TaskContext.get().partitionId() << 33
        own, block, row = Builder(), first, first

        def done() -> pa.RecordBatch:
            nonlocal own, block
            out = pa.RecordBatch.from_pylist([{"block": block} | own.packed()], schema=BLOCKS)
            own, block = Builder(), block + 1
            return out

        for batch in batches:
            for doc_id, text, held in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                lead, place = [NAMES[START]], 0
                words: list[bytes] = []
                for some in words_of(text.as_py()):
                    if place or words:  # the last chunk gets the end
                        own.add(row, place, doc_id, held, lead, words)
                        place, lead = place + 1, ([*lead, *words[-order:]])[1 - order :] if order > 1 else []
                        if own.size >= size:
                            yield done()
                    words = some
                own.add(row, place, doc_id, held, lead, [*words, NAMES[END]])
                row += 1
                if own.size >= size:
                    yield done()
        if own.parts:
            yield done()

    return durable(docs.select("doc_id", "text", "held").mapInArrow(tidy(run), _ddl(BLOCKS)))


@dataclass
class Level:
    """A block's distinct n-grams of one length: each one's context and last word, its suffix of the length less one, its hash and count."""

    context: np.ndarray
    word: np.ndarray
    suffix: np.ndarray
    hashes: np.ndarray
    counts: np.ndarray


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = a * np.uint64(0x9E3779B97F4A7C15) + b
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def _flagged(hashes: np.ndarray, length: int, final: np.ndarray) -> np.ndarray:
    """The lowest bits of a hash tell the n-gram's length, and whether it ends a text."""
    return (hashes & ~np.uint64(7)) | (final.astype(np.uint64) << np.uint64(2)) | np.uint64(length - 1)


class Block:
    """A block's tokens, pieces and distinct n-grams."""

    def __init__(self, row: dict, order: int):
        words = unpack(row["words"], np.uint64, row["n_words"])
        self.tokens = unpack(row["tokens"], np.int32, row["n_tokens"]).astype(np.int64)
        self.leads, self.sizes = np.array(row["leads"]), np.array(row["sizes"])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.place = np.arange(len(self.tokens)) - np.repeat(self.starts, self.sizes)
        self.read = self.place >= np.repeat(self.leads, self.sizes)
        trained = self.read & np.repeat(~np.array(row["held"], bool), self.sizes)
        n = self.n_words = len(words)
        number = np.arange(n)
        first = _flagged(words, 1, number == END)
        self.levels = [Level(np.zeros(n, np.int64), number, np.zeros(n, np.int64), first, np.bincount(self.tokens[trained], minlength=n))]
        before = self.tokens
        for length in range(2, order + 1):
            at = np.flatnonzero(self.place >= length - 1)
            keys, which = np.unique(before[at - 1] * n + self.tokens[at], return_inverse=True)
            some = np.empty(len(keys), np.int64)
            some[which] = at
            context, word = keys // n, keys % n
            hashes = _flagged(_mixed(self.levels[-1].hashes[context], words[word]), length, word == END)
            self.levels.append(Level(context, word, before[some], hashes, np.bincount(which[trained[at]], minlength=len(keys))))
            before = np.full(len(self.tokens), -1)
            before[at] = which
        every = np.concatenate([x.hashes for x in self.levels])
        every[START] = 0  # not counted: the end's count is its own
        self.order = np.argsort(every)[1:]
        self.hashes = every[self.order]
        self.counts = np.concatenate([x.counts for x in self.levels])[self.order]

    def ranges(self, parts: int) -> Iterator[tuple[int, int, int]]:
        """(range, begin, end) of the sorted hashes."""
        part = (self.hashes >> np.uint64(33)).astype(np.int64) * parts >> 31
        number, begin = np.unique(part, return_index=True)
        return zip(number.tolist(), begin.tolist(), [*begin[1:].tolist(), len(part)])

    def spread(self, totals: np.ndarray) -> list[np.ndarray]:
        """Totals in the order of `hashes`, as those of each level."""
        every = np.zeros(len(totals) + 1, np.int64)
        every[self.order] = totals
        every[START] = every[END]
        return np.split(every, np.cumsum([len(x.hashes) for x in self.levels])[:-1])


@dataclass
class Corpus:
    """Of all training texts: tokens, distinct ones, and the weight of the shorter context for each order from 2."""

    tokens: int
    types: int
    weights: list[float]


class Automaton:
    """States: 0, the empty context, and the contexts that were seen; arcs sorted by (state, word)."""

    def __init__(self, block: Block, totals: list[np.ndarray], corpus: Corpus):
        n, levels = block.n_words, block.levels
        self.n_words = n
        first = np.cumsum([1, *(len(x.word) for x in levels[:-1])])[: len(levels) - 1]  # the first state of each length
        n_states = 1 + sum(len(x.word) for x in levels[:-1])
        self.fail, self.back = np.zeros(n_states, np.int64), np.zeros(n_states)
        chance = (totals[0] + HALF) / (corpus.tokens + HALF * (corpus.types + 1))
        self.root, self.root_to = np.log10(chance), np.zeros(n, np.int64)
        if len(levels) > 1:
            self.root_to = np.where((totals[0] > 0) & (levels[0].word != END), 1 + levels[0].word, 0)
        keys, weights, to = [np.empty(0, np.int64)], [np.empty(0)], [np.empty(0, np.int64)]
        for k, (level, seen, m) in enumerate(zip(levels[1:], totals[1:], corpus.weights), 1):
            below = totals[k - 1]
            states = first[k - 1] + np.arange(len(below))
            self.back[states] = np.log10(m / (below + m))
            self.fail[states] = first[k - 2] + levels[k - 1].suffix if k > 1 else 0
            chance = (seen + m * chance[level.suffix]) / (below[level.context] + m)
            arc = seen > 0
            keys.append((first[k - 1] + level.context[arc]) * n + level.word[arc])
            weights.append(np.log10(chance[arc]))
            to.append((first[k] + np.flatnonzero(arc)) if k < len(levels) - 1 else first[k - 1] + level.suffix[arc])
        self.keys, self.weights, self.to = (np.concatenate(x) for x in (keys, weights, to))

    def read(self, tokens: np.ndarray, begin: np.ndarray, lead: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The log10 probability of each strip tokens[begin : begin + size] but for its first `lead` tokens, which only bring the automaton into its state."""
        longest = np.argsort(-size, kind="stable")
        begin, lead, size = begin[longest], lead[longest], size[longest]
        state, total = np.zeros(len(size), np.int64), np.zeros(len(size))
        for t in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -t))  # strips that are longer
            word, s = tokens[begin[:n] + t], state[:n]
            to, weight = self.root_to[word], np.zeros(n)
            open_, ended = np.flatnonzero(s > 0), s == 0
            while len(open_):
                key = s[open_] * self.n_words + word[open_]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[at] == key if len(self.keys) else np.zeros(len(key), bool)
                met = open_[hit]
                to[met] = self.to[at[hit]]
                weight[met] += self.weights[at[hit]]
                open_ = open_[~hit]
                weight[open_] += self.back[s[open_]]
                s[open_] = self.fail[s[open_]]
                failed = s[open_] == 0
                ended[open_[failed]] = True
                open_ = open_[~failed]
            weight[ended] += self.root[word[ended]]
            state[:n] = to
            total[:n] += np.where(t >= lead[:n], weight, 0)
        out = np.empty(len(total))
        out[longest] = total
        return out


def strips(block: Block, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(piece, begin, lead, size): pieces cut after STRIP tokens, each strip with the tokens before it that the automaton remembers."""
    n = block.sizes - block.leads
    each = -(-n // STRIP)
    piece = np.repeat(np.arange(len(n)), each)
    begin = block.starts[piece] + block.leads[piece] + STRIP * (np.arange(len(piece)) - np.repeat(np.cumsum(each) - each, each))
    stop = np.minimum(begin + STRIP, (block.starts + block.sizes)[piece])
    lead = np.minimum(order - 1, begin - block.starts[piece])
    return piece, begin - lead, lead, stop - begin + lead


REPLIES = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("n", pa.int64()), ("at", pa.binary()), ("totals", pa.binary()), ("sums", pa.list_(pa.float64()))])
MESSAGES = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("n", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())])


def _sums(hashes: np.ndarray, totals: np.ndarray, order: int) -> list[float]:
    """For each length: n-grams with repeats, distinct ones, those seen once; and of contexts, by bins of their counts, how many and the counts' sum."""
    out: list[float] = []
    length, final = hashes & np.uint64(3), (hashes & np.uint64(4)) > 0
    for k in range(order):
        own = totals[(length == k) & (totals > 0)]
        context = totals[(length == k) & (totals > 0) & (~final | (k == 0))]  # the end's count is the start's
        place = np.minimum((4 * np.log2(context)).astype(int), BINS - 1)
        out += [own.sum(), len(own), (own == 1).sum(), *np.bincount(place, minlength=BINS), *np.bincount(place, weights=context, minlength=BINS)]
    return [float(x) for x in out]


def fitted(sums: list[float], order: int) -> Corpus:
    rows = np.array(sums).reshape(order, 3 + 2 * BINS) if sums else np.zeros((order, 3 + 2 * BINS))
    weights = []
    for k in range(1, order):
        n, _, once = rows[k, :3]
        number, mass = rows[k - 1, 3 : 3 + BINS], rows[k - 1, 3 + BINS :]
        some = number > 0
        mean, share = mass[some] / number[some], mass[some] / max(mass[some].sum(), 1)
        low, high = math.log(1e-3), math.log(1e9)
        for _ in range(60):
            m = math.exp((low + high) / 2)
            low, high = (low, math.log(m)) if n and (share * m / (mean + m)).sum() >= once / n else (math.log(m), high)
        weights.append(math.exp((low + high) / 2) if n else 1.0)
    return Corpus(int(rows[0, 0]), int(rows[0, 1]), weights)


SCORES = "row long, place long, doc_id long, held boolean, n_tokens long, n_known long, base double, score double"


def scores(docs: DataFrame, order: int = 2, size: int = BLOCK) -> DataFrame:
    """A row for each row of `docs` (doc_id, text, held): doc_id, held_out, n_tokens, n_known, train_tokens, base_score (by single tokens), score. Rows that
    are held out (held) teach nothing. `size`: bytes of a block's texts."""
    spark = docs.sparkSession
    bound_batches(spark)
    blocks = blocks_of(docs, order, size)
    tokens = blocks.agg(F.sum("n_tokens")).first()[0] or 0
    parts = max(partitions_of(docs), -(-tokens * order // MEET))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("backoff")
        for batch in batches:
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                own, out = Block(row, order), []
                for part, a, b in own.ranges(parts):
                    gaps = np.diff(own.hashes[a:b], prepend=np.uint64(0))
                    out.append({"part": part, "block": row["block"], "n": b - a, "hashes": pack(gaps), "counts": pack(own.counts[a:b].astype(np.uint32))})
                del own
                yield pa.RecordBatch.from_pylist(out, schema=MESSAGES)

    def meet(table: pa.Table) -> pa.Table:
        alone("backoff")
        sizes = table.column("n").to_numpy()
        ends = np.cumsum(sizes)
        hashes, counts = np.empty(int(ends[-1]), np.uint64), np.empty(int(ends[-1]), np.int64)
        for n, end, x, y in zip(sizes, ends, table.column("hashes"), table.column("counts")):
            hashes[end - n : end] = np.cumsum(unpack(x.as_py(), np.uint64, n), dtype=np.uint64)
            counts[end - n : end] = unpack(y.as_py(), np.uint32, n)
        order_ = np.argsort(hashes)
        sorted_ = hashes[order_]
        fresh = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
        sums = np.add.reduceat(counts[order_], fresh)
        totals = np.empty_like(counts)
        totals[order_] = np.repeat(sums, np.diff(np.append(fresh, len(sorted_))))
        out: list[dict] = [{"sums": _sums(sorted_[fresh], sums, order)}]
        part = table.column("part")[0].as_py()
        for block, n, end in zip(table.column("block").to_pylist(), sizes, ends):
            more = np.flatnonzero(totals[end - n : end] != counts[end - n : end])
            if len(more):
                out.append({"block": block, "part": part, "n": len(more), "at": pack(np.diff(more, prepend=0).astype(np.uint32)), "totals": pack(totals[end - n : end][more])})
        return pa.Table.from_pylist(out, schema=REPLIES)

    replies = durable(blocks.mapInArrow(tidy(send), _ddl(MESSAGES)).groupBy("part").applyInArrow(meet, _ddl(REPLIES)))
    sums = replies.where("block is null").select(F.posexplode("sums").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))
    corpus = fitted([r["x"] for r in sums.orderBy("i").collect()], order)  # a fixed number of rows

    def score(own: pa.Table, told: pa.Table) -> pa.Table:
        alone("backoff")
        names = [x.split()[0] for x in SCORES.split(", ")]
        (row,) = own.to_pylist()
        block = Block(row, order)
        totals, begins = block.counts.copy(), {part: a for part, a, _ in block.ranges(parts)}
        for part, n, at, x in zip(*(told.column(c).to_pylist() for c in ("part", "n", "at", "totals"))):
            totals[begins[part] + np.cumsum(unpack(at, np.uint32, n), dtype=np.int64)] = unpack(x, np.int64, n)
        levels = block.spread(totals)
        automaton = Automaton(block, levels, corpus)
        piece, begin, lead, size = strips(block, order)
        log = automaton.read(block.tokens, begin, lead, size)
        of = np.repeat(np.arange(len(block.sizes)), block.sizes)[block.read]
        read, n = block.tokens[block.read], len(block.sizes)
        columns = [
            row["rows"], row["places"], row["ids"], row["held"], np.bincount(of, minlength=n), np.bincount(of[levels[0][read] > 0], minlength=n),
            np.bincount(of, weights=automaton.root[read], minlength=n), np.bincount(piece, weights=log, minlength=n),
        ]
        kinds = [pa.int64()] * 3 + [pa.bool_()] + [pa.int64()] * 2 + [pa.float64()] * 2
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    found = blocks.groupBy("block").cogroup(replies.where("block is not null").groupBy("block")).applyInArrow(score, SCORES)
    pieces = F.array_sort(F.collect_list(F.struct("place", "base", "score")))  # a text's pieces, of a megabyte or more
    rows = found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("held").alias("held_out"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), pieces.alias("pieces"))
    total = lambda c: F.aggregate("pieces", F.lit(0.0), lambda a, x: a + x[c])
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(corpus.tokens).cast("long").alias("train_tokens"), total("base").alias("base_score"), total("score").alias("score"))
