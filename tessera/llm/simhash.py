"""SimHash near-duplicates by a binary-trie self-join.

A text's fingerprint has a bit set where over half of its shingle hashes have it. Fingerprints that differ in at most `budget` bits
are linked. Equal fingerprints come together first. The distinct ones form a binary trie, whose node pairs are traversed
together: going down a bit, a pair of children with unlike bits costs one of the budget, and a pair that has spent
more is pruned with all below it. The traversal starts on the driver over a trie cut off where nodes hold few
fingerprints (its size is bounded by counts of prefixes), and each surviving pair of cut-off nodes goes on in a task of
its own. A task emits a spanning forest of its links, and the forests' components are found by contraction.

A trie prunes little where many bits may differ. Beyond TRIE bits the 64 are cut into blocks instead, two more than the budget:
fingerprints within it have two blocks in common at least, and meet among those that are equal there (`block_links`). No link is lost either way.

Edge cases: very long texts are hashed whole, some shingles at a time; a null text and one without words have fingerprint 0, which links like any other. Fewer words than a shingle has
are one shingle. component_id is the least non-null doc_id of the component, null if it has none. Rows that repeat
are linked. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import alone, bound_batches, components, durable, labels, tidy

SHINGLE = 3
#: Node pairs that a task holds at a time.
FRONTIER = 400_000
DIRECT = 64
#: The largest budget, in bits, for which the trie is traversed.
TRIE = 3
#: Pairs of fingerprints that a task compares at a time.
TILE = 1 << 20
#: Rows that a task of `block_links` gathers before it compares them.
HELD = 1 << 16
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: str | None, words: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint."""
    parts = (text or "").encode().lower().split()  # on bytes: A-Z only, and the six ASCII spaces
    if not parts:
        return 0
    size = min(words, len(parts))
    total, n = np.zeros(64, np.int64), len(parts) - size + 1
    for begin in range(0, n, 65_536):
        some = parts[begin : begin + 65_536 + size - 1]
        raw = b"".join([xxhash.xxh64_digest(x, 42) for x in map(b" ".join, zip(*(some[i : len(some) - size + 1 + i] for i in range(size))))])
        hashes = np.frombuffer(raw, np.uint8).reshape(-1, 8)  # big-endian: the highest bit first
        if len(hashes) < 400:
            total += np.unpackbits(hashes, axis=1).sum(axis=0, dtype=np.int64)
        else:
            total += np.concatenate([np.bincount(hashes[:, i], minlength=256) @ _BITS for i in range(8)])
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(docs: DataFrame, carry: Sequence[str] = (), words: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, carry_0, ..): fp is the fingerprint, of shingles of `words` words, as a signed long."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("simhash")
        for batch in batches:
            found = np.array([fingerprint(text.as_py(), words) for text in batch.column(1)], dtype=np.uint64).view(np.int64)
            kept = batch.columns[2:]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), *kept], ["doc_id", "fp", *(f"carry_{i}" for i in range(len(kept)))])

    rows = docs.select("doc_id", "text", *(F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)))
    more = [f"carry_{i} {f.dataType.simpleString()}" for i, f in enumerate(rows.schema.fields[2:])]
    return rows.mapInArrow(tidy(run), ", ".join(["doc_id long, fp long", *more]))


class Node:
    """A node of the cut-off trie: fingerprints that begin with the `depth` highest bits of `prefix`."""

    def __init__(self, prefix: int, depth: int):
        self.prefix, self.depth = prefix, depth

    @property
    def low(self) -> int:
        return self.prefix << (64 - self.depth) if self.depth else 0


def cut_off(fps: DataFrame, most: int, step: int = 12) -> list[Node]:
    """Nodes with at most `most` of the distinct fps each, in order. Prefixes are counted `step` bits at a time, only below nodes that are too large."""
    leaves: list[Node] = []
    open_: list[tuple[int, int]] = [(0, 0)]
    while open_:
        depth = open_[0][1]
        below = min(64, depth + step)
        prefix = lambda bits: F.shiftrightunsigned(F.col("fp"), 64 - bits) if 0 < bits < 64 else F.col("fp") if bits else F.lit(0).cast("long")
        rows = fps
        if depth:  # the nodes that were too large: at most n / most of them
            large = fps.sparkSession.createDataFrame([(p,) for p, _ in open_], "p long")
            rows = fps.withColumn("p", prefix(depth)).join(F.broadcast(large), "p", "left_semi")
        counts = {int(p) % 2**64: n for p, n in rows.groupBy(prefix(below).alias("p")).count().collect()}
        sums = [counts]
        for _ in range(below - depth):
            up: dict[int, int] = {}
            for p, n in sums[-1].items():
                up[p >> 1] = up.get(p >> 1, 0) + n
            sums.append(up)
        sums.reverse()
        again = []
        todo = [(p, 0) for p, _ in open_]
        while todo:
            p, d = todo.pop()
            n = sums[d].get(p, 0)
            if not n:
                continue
            if n <= most or depth + d == 64:
                leaves.append(Node(p, depth + d))
            elif d == below - depth:
                again.append((p, below))
            else:
                todo += [(2 * p, d + 1), (2 * p + 1, d + 1)]
        open_ = again
    return sorted(leaves, key=lambda x: x.low)


def node_pairs(nodes: list[Node], budget: int) -> list[tuple[int, int]]:
    """Pairs (i <= j) of nodes that can hold fingerprints within the budget: the tries are traversed together."""
    found: list[tuple[int, int]] = []
    everything = list(range(len(nodes)))
    todo = [(everything, everything, 0, 0, True)] if nodes else []
    while todo:
        a, b, depth, spent, same = todo.pop()
        ends = [len(x) == 1 and nodes[x[0]].depth <= depth for x in (a, b)]
        if all(ends):
            found.append((min(a[0], b[0]), max(a[0], b[0])))
            continue
        if same:
            zero, one = _children(nodes, a, depth)
            todo += [(x, x, depth + 1, spent, True) for x in (zero, one) if x]
            if zero and one and spent < budget:
                todo.append((zero, one, depth + 1, spent + 1, False))
            continue
        # an ended node stands for all of its continuations
        left = [(a, None)] if ends[0] else [(x, bit) for bit, x in enumerate(_children(nodes, a, depth)) if x]
        right = [(b, None)] if ends[1] else [(x, bit) for bit, x in enumerate(_children(nodes, b, depth)) if x]
        for x, p in left:
            for y, q in right:
                cost = spent + (p is not None and q is not None and p != q)
                if cost <= budget:
                    todo.append((x, y, depth + 1, cost, False))
    return sorted(set(found))


def _children(nodes: list[Node], some: list[int], depth: int) -> tuple[list[int], list[int]]:
    bit = [nodes[i].low >> (63 - depth) & 1 for i in some]
    return [i for i, x in zip(some, bit) if not x], [i for i, x in zip(some, bit) if x]


def traverse(a: np.ndarray, b: np.ndarray, budget: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) of all a[i], b[j] that differ in at most `budget` bits; a and b are sorted uint64. same: a is b; each pair once."""
    found_i, found_j = [], []
    level = lambda x, d: np.concatenate([[0], np.cumsum((x >> np.uint64(63 - d)) & np.uint64(1))]).astype(np.int64)
    todo = [(0, np.array([[0, len(a), 0, len(b), 0, int(same)]], dtype=np.int64))]
    ones: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    while todo:
        depth, pairs = todo.pop()
        if len(pairs) > FRONTIER:
            todo += [(depth, x) for x in np.array_split(pairs, 2)]
            continue
        size = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2])
        done = (size <= DIRECT) | (depth == 64)
        for some in np.array_split(pairs[done], max(1, int(size[done].sum()) // 4_000_000 + 1)):
            if len(some):
                i, j = _products(some)
                ok = np.bitwise_count(a[i] ^ b[j]) <= budget
                ok &= (i < j) | (np.repeat(some[:, 5], (some[:, 1] - some[:, 0]) * (some[:, 3] - some[:, 2])) == 0)
                found_i.append(i[ok])
                found_j.append(j[ok])
        pairs = pairs[~done]
        if not len(pairs):
            continue
        if depth not in ones:
            ones[depth] = (level(a, depth), level(b, depth))
        up_a, up_b = ones[depth]
        la, ha, lb, hb, spent, diag = pairs.T
        mid_a = ha - (up_a[ha] - up_a[la])
        mid_b = hb - (up_b[hb] - up_b[lb])
        parts = []
        for x0, x1, y0, y1, cost, keep in (
            (la, mid_a, lb, mid_b, spent, diag),
            (mid_a, ha, mid_b, hb, spent, diag),
            (la, mid_a, mid_b, hb, spent + 1, 0 * diag),
            (mid_a, ha, lb, mid_b, spent + 1, np.where(diag == 1, -1, 0)),  # of a pair with itself, the mirror image
        ):
            ok = (x1 > x0) & (y1 > y0) & (cost <= budget) & (keep >= 0)
            parts.append(np.stack([x0, x1, y0, y1, cost, keep], axis=1)[ok])
        todo.append((depth + 1, np.concatenate(parts)))
    return (np.concatenate(x) if x else np.empty(0, np.int64) for x in (found_i, found_j))


def _products(ranges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j) of i in [r0, r1), j in [r2, r3), for each range pair r."""
    wide = ranges[:, 3] - ranges[:, 2]
    size = (ranges[:, 1] - ranges[:, 0]) * wide
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    each = np.repeat(wide, size)
    return np.repeat(ranges[:, 0], size) + at // each, np.repeat(ranges[:, 2], size) + at % each


def trie_links(fps: DataFrame, budget: int = 2, most: int | None = None) -> DataFrame:
    """Links (a, b: long) that span the components of the distinct fingerprints `fps` (fp) under Hamming distance <= budget."""
    spark = fps.sparkSession
    n = fps.count()
    nodes = cut_off(fps, most or min(max(n // 128, 256), 1 << 18))
    pairs = node_pairs(nodes, budget)
    lows = np.array([x.low for x in nodes], dtype=np.uint64)
    goes: list[list[int]] = [[] for _ in nodes]
    for k, (i, j) in enumerate(pairs):
        goes[i].append(2 * k)
        if i != j:
            goes[j].append(2 * k + 1)
    sizes = np.array([len(x) for x in goes], dtype=np.int64)
    flat = np.array([x for own in goes for x in own], dtype=np.int64)
    shared = spark.sparkContext.broadcast((lows, sizes, flat, np.array([i == j for i, j in pairs])))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lows, sizes, flat, _ = shared.value
        starts = np.cumsum(sizes) - sizes
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            if len(fp):
                node = np.searchsorted(lows, fp.view(np.uint64), side="right") - 1
                each = sizes[node]
                at = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
                to = flat[np.repeat(starts[node], each) + at]
                yield pa.RecordBatch.from_arrays([pa.array(to >> 1), pa.array((to & 1).astype(np.int8)), pa.array(np.repeat(fp, each))], ["pair", "side", "fp"])

    def join(table: pa.Table) -> pa.Table:
        same = shared.value[3][table.column("pair")[0].as_py()]
        side, fp = (table.column(c).to_numpy() for c in ("side", "fp"))
        fp = fp.view(np.uint64)
        a = np.sort(fp[side == 0])
        b = a if same else np.sort(fp[side == 1])
        i, j = traverse(a, b, budget, bool(same))
        if same:
            lab = labels(len(a), i, j)
            both = a
        else:
            both = np.concatenate([a, b])
            lab = labels(len(both), i, j + len(a))
        node = np.flatnonzero(lab != np.arange(len(lab)))
        return pa.table({"a": both[node].view(np.int64), "b": both[lab[node]].view(np.int64)})

    return fps.select("fp").mapInArrow(deal, "pair long, side byte, fp long").groupBy("pair").applyInArrow(join, "a long, b long")


def _spanning(fp: np.ndarray, meet: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components within each run of equal `meet`, as indices."""
    edge = np.flatnonzero(np.concatenate([[True], meet[1:] != meet[:-1], [True]]))
    lab = np.arange(len(fp))

    def add(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal lab
        if len(i):
            own = np.flatnonzero(lab != np.arange(len(lab)))
            lab = labels(len(lab), np.concatenate([i, own]), np.concatenate([j, lab[own]]))

    size = np.diff(edge)
    small = (size > 1) & (size <= DIRECT)
    ranges = np.stack([edge[:-1], edge[1:], edge[:-1], edge[1:]], axis=1)
    for some in np.array_split(ranges[small], int((size[small] ** 2).sum()) // TILE + 1):
        i, j = _products(some)
        ok = (i < j) & (np.bitwise_count(fp[i] ^ fp[j]) <= budget)
        add(i[ok], j[ok])
    for begin, end in ranges[size > DIRECT][:, :2]:
        step = max(1, TILE // (end - begin))
        for at in range(begin, end, step):
            i, j = np.nonzero(np.bitwise_count(fp[at : min(at + step, end), None] ^ fp[None, at:end]) <= budget)
            ok = i < j
            add(i[ok] + at, j[ok] + at)
    node = np.flatnonzero(lab != np.arange(len(lab)))
    return node, lab[node]


def block_links(fps: DataFrame, budget: int) -> DataFrame:
    """Links (a, b: long) as `trie_links` has them, for any budget. Work grows faster than the rows, the less so the smaller the budget: at 7 bits a fingerprint
    meets 36 times one in 2^14 of the others."""
    cuts = [64 * k // (budget + 2) for k in range(budget + 3)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    masks = [x | y for x, y in combinations(blocks, 2)]
    signed = [x - (x >> 63 << 64) for x in masks]
    # what is equal in two blocks has one hash; hashes that collide are compared in vain
    meets = F.array(*(F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(x))) for k, x in enumerate(signed)))
    dealt = fps.select("fp", F.explode(meets).alias("meet")).repartition("meet").sortWithinPartitions("meet")
    bound_batches(fps.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("simhash")
        held, rows, full = [], 0, HELD

        def linked(fp: np.ndarray, meet: np.ndarray) -> pa.RecordBatch:
            i, j = _spanning(fp.view(np.uint64), meet, budget)
            return pa.RecordBatch.from_arrays([pa.array(fp[i]), pa.array(fp[j])], ["a", "b"])

        for batch in batches:
            held.append([batch.column(k).to_numpy() for k in (0, 1)])
            rows += batch.num_rows
            if rows >= full:
                fp, meet = map(np.concatenate, zip(*held))
                last = int(np.searchsorted(meet, meet[-1]))  # the last run may go on in the next batch
                if last:
                    yield linked(fp[:last], meet[:last])
                held, rows = [[fp[last:].copy(), meet[last:].copy()]], len(fp) - last
                full = max(HELD, 2 * rows)
        if rows:
            yield linked(*map(np.concatenate, zip(*held)))

    return dealt.select("fp", "meet").mapInArrow(tidy(run), "a long, b long")


def near_duplicates(docs: DataFrame, budget: int = 2, carry: Sequence[str] = (), words: int = SHINGLE) -> DataFrame:
    """A row for each row of `docs` (doc_id long, text): doc_id, fp (signed long), component_id, root (a fingerprint of the component), and the
    columns in `carry` as carry_0, carry_1, .."""
    rows = durable(fingerprints(docs, carry, words))
    distinct = durable(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components((trie_links if budget <= TRIE else block_links)(distinct, budget))
    named = distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    lowest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    more = [f"carry_{i}" for i in range(len(carry))]
    return rows.join(named.join(lowest, "root").select("fp", "root", "component_id"), "fp").select("doc_id", "fp", "component_id", "root", *more)
