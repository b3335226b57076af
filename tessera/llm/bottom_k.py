"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch is the sorted array of the k smallest distinct 64-bit hashes of a text's shingles of five words. Sketches of parts
merge into the sketch of the whole (`merge`), and two sketches estimate resemblance (share of the union's k
smallest that both hold), containment and the number of distinct shingles (from the k-th smallest hash).

`fingerprints` also compares every document with its edited text and with the next document in id order. The order is
global, but no task holds it: rows go to ranges of ids whose bounds are ids of the table, and the first
row of each range is sent to the range before as well. A range is read in order, holding one document at a time.

Edge cases: a null text is an empty text; it has an empty sketch, which is like another empty sketch (1) and unlike any
other (0). Fewer than five words are one shingle. Very long texts are sketched
in parts and merged. Rows with null ids come first; rows that share an id are ordered by the text.
A table of one row has itself as the next document. Rows that repeat stand after each other. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import alone, bound_batches, partitions_of, tidy

WORDS = 5
K = 128
#: Words of a part that is sketched by itself.
PART = 65_536
#: Word hashes that a worker keeps, and the bytes of words that it does not keep.
CACHE = 400_000
LONG = 64
_hashes: dict[bytes, int] = {}


def shingle_hashes(text: str, words: int = WORDS) -> np.ndarray:
    """Hashes (uint64) of the text's shingles, repeats included. The order of the words in a shingle matters."""
    return _hashes_of(text.lower().encode().split(), words)


def _hashes_of(parts: list[bytes], words: int) -> np.ndarray:
    if len(_hashes) > CACHE:
        _hashes.clear()
    if not parts:
        return np.empty(0, np.uint64)
    long = {}
    for part in set(parts).difference(_hashes):
        (_hashes if len(part) <= LONG else long)[part] = xxhash.xxh64_intdigest(part)
    known = _hashes | long if long else _hashes
    own = np.array(list(map(known.__getitem__, parts)), dtype=np.uint64)
    size = min(words, len(own))
    mixed = np.zeros(len(own) - size + 1, np.uint64)
    for i in range(size):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + own[i : len(own) - size + 1 + i]
    # the sums of products alone are not uniform in their low bits: mix high bits down, twice
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
    return mixed ^ (mixed >> np.uint64(33))


def sketch(text: str, k: int = K, words: int = WORDS) -> np.ndarray:
    """The text's sketch, merged from those of its parts of PART words, which overlap so that each shingle is in one."""
    parts = text.lower().encode().split()
    found = _smallest(_hashes_of(parts[: PART + words - 1], words), k)
    for begin in range(PART, len(parts) - words + 1, PART):
        found = merge(found, _smallest(_hashes_of(parts[begin : begin + PART + words - 1], words), k), k=k)
    return found


def _smallest(hashes: np.ndarray, k: int) -> np.ndarray:
    if len(hashes) > 4 * k:  # only the smallest matter: leave most of the sort out
        low = np.unique(hashes[hashes <= np.uint64((1 << 64) // len(hashes) * 3 * k)])
        if len(low) >= k:
            return low[:k]
    return np.unique(hashes)[:k]


def merge(*sketches: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the whole from sketches of its parts (shingles that cross from part to part aside)."""
    return np.unique(np.concatenate(sketches))[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = merge(a, b, k=k)
    return len(np.intersect1d(np.intersect1d(a, b, True), union, True)) / len(union)


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) / (float(a[k - 1]) / 2**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has, from the sizes and the resemblance."""
    if not len(a):
        return 1.0
    r = resemblance(a, b, k)
    return min(1.0, r / (1 + r) * (distinct(a, k) + distinct(b, k)) / distinct(a, k))


def to_text(a: np.ndarray) -> str:
    """Sixteen lowercase hex digits for each hash, in ascending order."""
    return a.astype(">u8").tobytes().hex()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u8").astype(np.uint64)


def edited(text: str, following: str) -> str:
    """The last half of `text` replaced by as many of the first code points of `following` (or all that it has)."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


FIELDS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles double"


def fingerprints(docs: DataFrame, k: int = K, ranges_per_partition: int = 4) -> DataFrame:
    """A row for each row of `docs` (doc_id long, text)."""
    spark = docs.sparkSession
    bound_batches(spark)
    parts = partitions_of(docs)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cuts = [i / (parts * ranges_per_partition) for i in range(parts * ranges_per_partition)]
    found = rows.agg(F.percentile_approx("doc_id", cuts, max(10_000, 4 * len(cuts))).alias("b"), F.count_if(F.col("doc_id").isNull()).alias("nulls"), F.min("doc_id").alias("least")).first()
    bounds = sorted(set(found["b"] or []) - {found["least"]})  # ids of the table, each the first of its range
    last = len(bounds)
    # the ranges that a row is in: its own, as a row; the one before as what follows, where it is the first
    where = spark.sparkContext.broadcast(np.array(bounds, dtype=np.int64))
    # what follows the last row is the first of all; of rows without id, which come first, that is the least text
    first = None if found["nulls"] else found["least"]
    opening = rows.where("doc_id is null").agg(F.min("text").alias("text")).first()["text"] if found["nulls"] else None

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = where.value
        for batch in batches:
            ids = batch.column(0)
            raw = ids.fill_null(-(2**63)).to_numpy(zero_copy_only=False)
            ranges = np.searchsorted(own, raw, side="right")
            missing = ids.is_null().to_numpy(zero_copy_only=False)
            ranges[missing] = 0
            leads = (ranges > 0) & (raw == np.append(own, 0)[np.maximum(ranges - 1, 0)]) & ~missing
            opens = (raw == first) & ~missing if first is not None else np.zeros(len(raw), bool)
            take = np.concatenate([np.arange(len(raw)), np.flatnonzero(leads), np.flatnonzero(opens)])
            goes = np.concatenate([ranges, ranges[leads] - 1, np.full(int(opens.sum()), last)]).astype(np.int32)
            kind = np.concatenate([np.zeros(len(raw)), np.ones(int(leads.sum())), np.ones(int(opens.sum()))]).astype(np.int8)
            same = batch.take(pa.array(take))
            yield pa.RecordBatch.from_arrays([pa.array(goes), pa.array(kind), same.column(0), same.column(1)], ["range_", "guard", "doc_id", "text"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("n_shingles", pa.float64())])
        alone("bottom_k", _hashes.clear)
        held = None  # the row before: range, id, text, sketch
        for batch in batches:
            out = []
            for part, guard, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if held is not None and held[0] == part:
                    own = sketch(text, k)
                    _, before, body, low = held
                    changed = edited(body, text)
                    high = sketch(changed, k)
                    out.append((before, len(body), hashlib.sha256(changed.encode()).hexdigest(), to_text(low), to_text(high), resemblance(low, high, k), resemblance(low, own, k), distinct(low, k)))
                    held = None if guard else (part, doc_id, text, own)
                elif not guard:
                    held = (part, doc_id, text, sketch(text, k))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), schema.types)] if out else [pa.array([], t) for t in schema.types], schema=schema)

    dealt = rows.mapInArrow(tidy(deal), "range_ int, guard byte, doc_id long, text string")
    if opening is not None:
        dealt = dealt.unionByName(spark.createDataFrame([(last, 1, None, opening)], dealt.schema))
    placed = dealt.repartition(parts, "range_").sortWithinPartitions("range_", "guard", "doc_id", "text")
    return placed.mapInArrow(tidy(read), f"doc_id long, {FIELDS}")
