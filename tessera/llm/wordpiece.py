"""Token counts by greedy longest match, in one pass over each word.

The vocabulary is a trie over bytes. A node's failure link leads where matching goes on when no child fits, and
with it comes the number of tokens that are then complete ("popped"): both are precomputed, breadth first, so a word of n bytes takes
at most 2n steps and no piece is ever built. All 256 bytes are pieces, so every text has a count.

A word is a run of other than ASCII white space; it is matched with the mark (a space) before it.

Edge cases: a null text and one without words have 0 words and 0 tokens. Very long words are walked without a cache.
Rows that repeat are counted alike. Other columns are ignored.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import alone, bound_batches, tidy

CACHE = 300_000
LONG = 64


class Automaton:
    """children: (node << 8 | byte) -> node. fail: node -> node, -1 for none. popped: tokens complete on the way."""

    def __init__(self, vocabulary: Iterable[bytes]):
        pieces = set(vocabulary) - {b""}
        pieces |= {bytes([b]) for b in range(256)}
        self.children: dict[int, int] = {}
        final = [False]
        for piece in sorted(pieces):
            node = 0
            for byte in piece:
                key = node << 8 | byte
                if (to := self.children.get(key)) is None:
                    to = self.children[key] = len(final)
                    final.append(False)
                node = to
            final[node] = True
        below: list[list[tuple[int, int]]] = [[] for _ in final]
        for key, to in self.children.items():
            below[key >> 8].append((key & 255, to))
        self.fail, self.popped = [-1] * len(final), [0] * len(final)
        todo = deque([0])
        while todo:
            node = todo.popleft()
            for byte, to in below[node]:
                if final[to]:  # the whole of it is a token, and matching starts anew
                    self.fail[to], self.popped[to] = 0, 1
                else:  # the parent's tokens, then further along links until the byte fits
                    at, n = self.fail[node], self.popped[node]
                    while at >= 0 and (at << 8 | byte) not in self.children:
                        n += self.popped[at]
                        at = self.fail[at]
                    if at >= 0:
                        self.fail[to], self.popped[to] = self.children[at << 8 | byte], n
                todo.append(to)

    def count(self, word: bytes) -> int:
        children, fail, popped = self.children, self.fail, self.popped
        node = total = 0
        for byte in word:
            while (to := children.get(node << 8 | byte)) is None:
                total += popped[node]
                node = fail[node]
            node = to
        while node:
            total += popped[node]
            node = fail[node]
        return total


def read_ranks(data: bytes) -> list[bytes]:
    """The pieces of a rank file: a base64 piece and its rank on each line."""
    return [base64.b64decode(line.split()[0]) for line in data.splitlines() if line.strip()]


def token_counts(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """A row for each row of `docs` (doc_id, text): doc_id, n_words, n_bytes (of the words), n_tokens (long).

    The vocabulary is read on the driver and broadcast: its size is the tokenizer file's.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(vocabulary))
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("wordpiece")
        count, known = shared.value.count, {}
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                words = text.encode().split() if text else []
                for word in set(words).difference(known):
                    if len(word) <= LONG:
                        known[word] = count(b" " + word)
                long = [w for w in words if len(w) > LONG]
                n = sum(known.get(w, 0) for w in words) + sum(count(b" " + w) for w in long)
                out.append((len(words), sum(map(len, words)), n))
                if len(known) > CACHE:
                    known.clear()
            sums = np.array(out, dtype=np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(sums[:, i]) for i in range(3))], ["doc_id", "n_words", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text")).mapInArrow(tidy(run), f"doc_id {kind}, n_words long, n_bytes long, n_tokens long")
