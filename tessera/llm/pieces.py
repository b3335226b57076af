"""SentencePiece encoding and decoding of distinct marked words along a shared-prefix trie.

Words are marked (spaces become a mark before the word), and a batch's distinct new words are sorted, which is the depth-first order
of their trie. Along it a forward table holds, for each prefix, its best segmentation as the last piece and the position before
it; the part of the table that the next word shares is reused, so each trie node is worked out once.

Two kinds of model. Unigram: Viterbi, the piece that maximises the sum of scores. Byte-pair: a sum of scores would not give the merges'
result, so the forward step keeps, of all pieces that end at a prefix, the one whose pair with the piece before it is stable
under the model's own merges. Exactly one is: merges left of a final border do not depend on what is right of it.
The result is the merges' result, piece for piece.

Characters that are in no piece become byte pieces. Decoding joins pieces, turns marks to spaces and drops the leading one.

Edge cases: a null text and an empty one have no pieces and decode to an empty text. A literal mark in a text decodes to a space,
so round_trip is false there. Very long words are encoded like others (not cached). Rows that repeat are encoded alike. Other
columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import alone, bound_batches, tidy

MARK = "▁"
UNITS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Words and pairs of pieces that a worker knows, some 150 MB of both.
CACHE = 250_000
PAIRS = 500_000
TWO = (2,)
LONG = 200
NEVER = float("-inf")


class Encoder:
    """Pieces, scores and bytes of a model file's contents. Loaded once in each worker."""

    def __init__(self, data: bytes, unigram: bool = False):
        model = sentencepiece.SentencePieceProcessor(model_proto=data)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
        self.ids = {model.id_to_piece(i): i for i in plain}
        self.scores = {model.id_to_piece(i): model.get_score(i) for i in plain}
        self.bytes = [0] * 256
        self.raw: list[bytes] = [b""] * n
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.raw[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_unknown(i) or model.is_control(i)):
                self.raw[i] = piece.replace(MARK, " ").encode()
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece has a mark behind other characters: words can't be taken apart")
        self.longest = max(map(len, self.ids), default=1)
        self.worst = min(self.scores.values(), default=0.0) - 10.0
        self.unigram = unigram
        self.most_words, self.most_pairs = CACHE, PAIRS
        self.stable: dict[tuple[str, str], bool] = {}
        #: pieces of two characters or more that the merges can make at all
        self.histories: dict[str, tuple[tuple, tuple, tuple]] = {}
        self.made = {p: p for p in self.ids if len(p) > 1 and (unigram or self.history(p)[1][-1] == p)}  # one object of each, which the tables share
        #: by the last three characters of a text, the lengths that a piece at its end may have, the greatest first
        lengths: dict[str, set[int]] = {}
        for p in self.made:
            if len(p) > 2:
                lengths.setdefault(p[-3:], {2} if p[-2:] in self.made else set()).add(len(p))
        self.lengths = {end: tuple(sorted(own, reverse=True)) for end, own in lengths.items()}
        self.known: dict[str, bytes] = {}
        self.reset()

    def reset(self) -> None:
        self.word, self.last, self.total = "", [""], [0.0]

    def merged(self, text: str) -> list[str]:
        """The merges' result, plainly: again and again the best pair, the leftmost of equals."""
        parts = list(text)
        for _ in self.merges(parts):
            pass
        return parts

    def merges(self, parts: list[str]) -> Iterator[float]:
        """Merges `parts` step by step, giving each step's score."""
        while True:
            best, at = None, 0
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            yield best

    def history(self, piece: str) -> tuple[tuple, tuple, tuple]:
        """Scores of the merges inside a piece (then NEVER), and its first and last part before each of them and at the end."""
        if (known := self.histories.get(piece)) is None:
            parts = list(piece)
            scores, first, last = [], [parts[0]], [parts[-1]]
            for score in self.merges(parts):
                scores.append(score)
                first.append(parts[0])
                last.append(parts[-1])
            known = ((*scores, NEVER), tuple(first), tuple(last))
            if len(piece) > 1:
                self.histories[piece] = known
        return known

    def fits(self, before: str, piece: str) -> bool:
        """Whether the border between two pieces stays when their characters are merged anew.

        The merges on either side go on as in the piece alone, the better one first, until a merge across the border would come before
        both: it needs the better score, and of equals the leftmost goes first.
        """
        if len(self.stable) > self.most_pairs:
            self.stable.clear()
        left, _, ends = self.history(before)
        right, begins, _ = self.history(piece)
        score = self.scores.get
        i = j = 0
        x, y, end, begin = left[0], right[0], ends[0], begins[0]
        while True:
            across = score(end + begin)
            if across is not None and across > x and across >= y:
                known = False
                break
            if x >= y:
                if x == NEVER:
                    known = True
                    break
                i += 1
                x, end = left[i], ends[i]
            else:
                j += 1
                y, begin = right[j], begins[j]
        self.stable[before, piece] = known
        return known

    def pieces(self, word: str) -> list[str]:
        """The word's pieces. Words in sorted order share the work on common prefixes."""
        shared, most = 0, min(len(word), len(self.word))
        while shared < most and word[shared] == self.word[shared]:
            shared += 1
        last = self.last
        del last[shared + 1 :], self.total[shared + 1 :]
        if self.unigram:
            self.best_sums(word, shared)
        else:
            made, lengths, stable = self.made, self.lengths, self.stable
            for end in range(shared + 1, len(word) + 1):
                found = lengths.get(word[end - 3 : end]) if end > 2 else None
                for k in found or (TWO if end > 1 else ()):
                    if k > end:
                        continue
                    piece = made.get(word[end - k : end])
                    if piece is not None:
                        if k == end:
                            break
                        before = last[end - k]
                        fits = stable.get((before, piece))
                        if fits or fits is None and self.fits(before, piece):
                            break
                else:  # exactly one fits: where no longer piece does, the single character
                    piece = word[end - 1]
                last.append(piece)
        self.word = word
        out, end = [], len(word)
        while end:
            piece = last[end]
            out.append(piece)
            end -= len(piece)
        out.reverse()
        return out

    def best_sums(self, word: str, shared: int) -> None:
        scores, total = self.scores, self.total
        for end in range(shared + 1, len(word) + 1):
            found = max((total[end - k] + (scores[p] if p in scores else self.worst), -k, p) for k in range(1, min(end, self.longest) + 1) if (p := word[end - k : end]) in scores or k == 1)
            total.append(found[0])
            self.last.append(found[2])

    def ids_of(self, word: str) -> list[int]:
        pieces = self.pieces(word)
        try:
            return [self.ids[p] for p in pieces]
        except KeyError:  # characters that are no piece become bytes
            return [i for p in pieces for i in ([self.ids[p]] if p in self.ids else [self.bytes[b] for b in p.encode()])]

    def units(self, text: str) -> list[str]:
        """The marked words: a mark first, and one for each space."""
        return UNITS.findall(MARK + text.replace(" ", MARK)) if text else []

    def learn(self, words: set[str]) -> None:
        """The ids of new words, in the trie's depth-first order."""
        self.reset()
        for word in sorted(words):
            self.known[word] = array("i", self.ids_of(word)).tobytes()
        self.reset()

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids, as little-endian 32-bit integers."""
        if len(self.known) > self.most_words:
            self.known.clear()
        units = [self.units(t or "") for t in texts]
        new = set().union(*units).difference(self.known)
        self.learn(new)
        out = [b"".join(map(self.known.__getitem__, own)) for own in units]
        for word in new:
            if len(word) > LONG:
                del self.known[word]
        return out

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_batch([text])[0], np.int32).tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace").removeprefix(" ")


_loaded: dict[tuple[int, bool], Encoder] = {}


def loaded(model: bytes, unigram: bool) -> Encoder:
    """The worker's encoder, which stays from task to task until another operator's task comes (`common.alone`)."""
    key = (hash(model), unigram)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Encoder(model, unigram)
    return _loaded[key]


def encode(docs: DataFrame, model: bytes, unigram: bool = False, words: int = CACHE, pairs: int = PAIRS, rows: int = 1000) -> DataFrame:
    """A row for each row of `docs` (doc_id, text): doc_id, n_pieces (long), ids (array<int>), decoded (string), round_trip.

    words, pairs and rows bound what a worker knows and takes at a time; what it knows stays for its next task of this operator. They trade memory for
    time and don't change the result. The model is read on the driver and broadcast: its size is the model file's.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model, unigram))
    bound_batches(docs.sparkSession, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("pieces", _loaded.clear)
        own = loaded(*shared.value)
        own.most_words, own.most_pairs = words, pairs
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = own.encode_batch(texts)
            sizes = np.array([len(x) // 4 for x in found], dtype=np.int64)
            values = np.frombuffer(b"".join(found), np.int32)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            decoded = [own.decode(np.frombuffer(x, np.int32).tolist()) for x in found]
            same = [d == (t or "") for d, t in zip(decoded, texts)]
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), ids, pa.array(decoded, pa.string()), pa.array(same)], ["doc_id", "n_pieces", "ids", "decoded", "round_trip"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text")).mapInArrow(tidy(run), f"doc_id {kind}, n_pieces long, ids array<int>, decoded string, round_trip boolean")
