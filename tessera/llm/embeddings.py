"""Near-duplicate embeddings by an inverted multi-index.

Vectors are normalised and halved; each half has a codebook of its own (k-means over a bounded sample), and the pairs of codes form a
grid of cells, which is the inverted index: every vector is in the cell of its two nearest centroids. The codebooks grow with the root of the number
of vectors, so that a cell has about CELL of them; with SAMPLE vectors to learn from they end at SAMPLE / 16 codes a half.

A vector as a query visits cells in a multi-sequence traversal: both halves' codes in ascending order of their squared margins, and a heap that gives the
pair of least sum next, the margin of a centroid being the distance from the half to the centroid's region. It stops where the sums pass
the bound with which the target recall is met: the links
of a hashed set of queries with all rows are counted by the bound each of them needs, and the bound is the least at which the share of these
links that is met, and the mean share of a query's, reach `recall`. It is at least what holds where the displacement is spread over all
dimensions (its part across a region's border is then normal with deviation radius / sqrt(dims)), and at most radius squared, at which no
link is lost. What is visited is verified by cosine in double precision.

Equal vectors come together first. Vectors are sent once to their cell and once to each cell they visit, in the precision they came in; a hot cell's members
and its visitors are split into blocks by hash, so that it is many tasks. A task
multiplies two blocks and emits counts and a spanning forest of its links, not the pairs. A pair that both ends
visit is counted by each for itself, one that only one end visits by that end for both.

Edge cases: vectors that are null, of norm zero, or hold null or non-finite components link with nothing. Vectors link with those of
their own dimension only; those of very many dimensions are handled like others. Rows that repeat a vector are linked with each other. A null vec_id gives
no component a name; a component of null ids has component_id null. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches, components, durable, labels

SAMPLE = 20_000
CELL = 512
#: Queries of a dimension that the bound is measured with, and its steps up to the exact bound.
QUERIES = 512
STEPS = 256
#: Members and visitors of a cell that one task compares.
MEMBERS = 2048
VISITORS = 16_384
SLICE = 1024


def codebook(points: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """k centroids by Lloyd's iterations from distinct sample points."""
    points = np.unique(points, axis=0)
    pick = np.random.Generator(np.random.PCG64(seed))
    if len(points) <= k:
        return points if len(points) else np.zeros((1, points.shape[1]))
    centres = points[pick.choice(len(points), k, replace=False)]
    for _ in range(rounds):
        near = np.concatenate([squares(points[a : a + 4096], centres).argmin(axis=1) for a in range(0, len(points), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        n = np.bincount(near, minlength=k)[:, None]
        centres = np.where(n > 0, sums / np.maximum(n, 1), centres)
    return centres


def squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1), 0)


def margins(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distance from each row to the half-space where a centroid is nearer than the row's nearest one."""
    d = squares(x, centres)
    near = d.argmin(axis=1)
    gaps = np.sqrt(squares(centres, centres))
    apart = gaps[near]
    with np.errstate(divide="ignore", invalid="ignore"):
        out = (d - d[np.arange(len(x)), near][:, None]) / (2 * apart)
    out = np.where(apart > 0, out, 0.0)
    return out * out


def nearest_pairs(first: list[float], second: list[float], bound: float) -> Iterator[tuple[int, int]]:
    """Pairs of places in two ascending lists, in ascending order of their sum, until it passes the bound."""
    heap = [(first[0] + second[0], 0, 0)] if first and second else []
    while heap and heap[0][0] <= bound:
        _, i, j = heapq.heappop(heap)
        yield i, j
        # each pair has one that brings it in: the pair before in the second list, or in the first where that is at its start
        if j + 1 < len(second):
            heapq.heappush(heap, (first[i] + second[j + 1], i, j + 1))
        if not j and i + 1 < len(first):
            heapq.heappush(heap, (first[i + 1] + second[0], i + 1, 0))


def visits(m1: np.ndarray, m2: np.ndarray, bound: float) -> list[list[int]]:
    """For each query, the cells (code1 * k2 + code2) with a margin sum up to the bound, nearest first, by a multi-sequence traversal."""
    k2 = m2.shape[1]
    o1, o2 = m1.argsort(axis=1, kind="stable"), m2.argsort(axis=1, kind="stable")
    n1, n2 = (m1 <= bound).sum(axis=1), (m2 <= bound).sum(axis=1)  # no pair has a code beyond these
    s1, s2 = np.take_along_axis(m1, o1, 1), np.take_along_axis(m2, o2, 1)
    out = []
    for q in range(len(m1)):
        codes1, codes2 = o1[q, : n1[q]].tolist(), o2[q, : n2[q]].tolist()
        out.append([codes1[i] * k2 + codes2[j] for i, j in nearest_pairs(s1[q, : n1[q]].tolist(), s2[q, : n2[q]].tolist(), bound)])
    return out


def unit(vectors: list) -> np.ndarray:
    x = np.array(vectors, dtype=np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def by_dimension(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dim, places in the batch, normalised vectors) of the batch's columns dim and embedding."""
    dims, bodies = batch.column("dim").to_numpy(), batch.column("embedding")
    for dim in np.unique(dims):
        at = np.flatnonzero(dims == dim)
        x = np.asarray(bodies.take(pa.array(at)).flatten()).reshape(len(at), dim).astype(np.float64)
        yield int(dim), at, x / np.linalg.norm(x, axis=1, keepdims=True)


class Index:
    """Codebooks by dimension, and the bound of the margins."""

    def __init__(self, sample: dict[int, list], sizes: dict[int, int], least: float, recall: float):
        self.least, self.recall = least, recall
        self.radius = math.sqrt(max(0.0, 2 - 2 * least))
        self.bounds: dict[int, float] = {}
        self.z = NormalDist().inv_cdf(1 - (1 - recall) / 4)
        self.books = {}
        for dim, n in sizes.items():
            half = max(1, dim // 2)
            x = unit(sample[dim]) if sample.get(dim) else np.zeros((1, dim))
            k = max(1, min(len(x) // 16, round(math.sqrt(n / CELL))))
            self.books[dim] = (codebook(x[:, :half], k), codebook(x[:, half:], k) if dim > 1 else np.zeros((1, 0)))

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = max(1, x.shape[1] // 2)
        return x[:, :half], x[:, half:]

    def codes(self, x: np.ndarray) -> np.ndarray:
        books = self.books[x.shape[1]]
        c1, c2 = (squares(h, b).argmin(axis=1) for h, b in zip(self.halves(x), books))
        return c1 * len(books[1]) + c2

    def cell_margins(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(margins(h, b) for h, b in zip(self.halves(x), self.books[x.shape[1]]))

    def bound(self, dim: int) -> float:
        exact = self.radius**2
        return min(exact, max((self.z * self.radius / math.sqrt(dim)) ** 2, self.bounds.get(dim, 0.0))) + 1e-12

    def steps(self, x: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(i, j, step) of the links of x[i] with queries[j]: the step of the bound from which one of the two ends visits the other."""
        i, j = np.nonzero(x @ queries.T >= self.least)
        mx, mq, cx, cq = self.cell_margins(x), self.cell_margins(queries), self.codes(x), self.codes(queries)
        k2 = mx[1].shape[1]
        there = mx[0][i, cq[j] // k2] + mx[1][i, cq[j] % k2]
        back = mq[0][j, cx[i] // k2] + mq[1][j, cx[i] % k2]
        exact = self.radius**2
        step = np.ceil(np.minimum(there, back) / exact * STEPS) if exact else np.zeros(len(i))
        return i, j, np.minimum(step, STEPS).astype(np.int64)

    def calibrate(self, dim: int, links: np.ndarray) -> None:
        """links: for each query with links, their number by step."""
        met = links.cumsum(axis=1)
        share = np.minimum(met.sum(axis=0) / links.sum(), (met / met[:, -1:]).mean(axis=0))
        self.bounds[dim] = self.radius**2 * int(np.argmax(share >= min(self.recall, share[-1]))) / STEPS

    def visited(self, x: np.ndarray) -> list[list[int]]:
        return visits(*self.cell_margins(x), self.bound(x.shape[1]))


def _index(spark, groups: DataFrame, least: float, recall: float, sample: int) -> Index:
    """Codebooks from a hashed sample of each dimension's vectors, and the bound measured over all of them. `groups`: id, times, embedding, dim."""
    sizes = {r["dim"]: r["count"] for r in groups.groupBy("dim").count().collect()}  # a row for each dimension
    picked: dict[int, list] = {}
    asked: dict[int, tuple] = {}
    for dim in sizes:
        some = groups.where(F.col("dim") == dim).orderBy(F.xxhash64("embedding")).limit(sample)
        picked[dim] = [r["embedding"] for r in some.select("embedding").toLocalIterator()]
        some = groups.where(F.col("dim") == dim).orderBy(F.xxhash64(F.lit("query"), "embedding")).limit(QUERIES).select("id", "times", "embedding").collect()
        asked[dim] = (np.array([r["id"] for r in some]), np.array([r["times"] for r in some]), unit([r["embedding"] for r in some]))
    index = Index(picked, sizes, least, recall)
    shared = spark.sparkContext.broadcast((index, asked))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, asked = shared.value
        for batch in batches:
            ids, times = batch.column("id").to_numpy(), batch.column("times").to_numpy()
            for dim, at, x in by_dimension(batch):
                queries, repeats, q = asked[dim]
                i, j, step = own.steps(x, q)
                ok = ids[at][i] != queries[j]
                i, j, step = i[ok], j[ok], step[ok]
                n = np.bincount(j * (STEPS + 1) + step, weights=times[at][i] * repeats[j], minlength=1)
                key = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), dim, np.int32)), pa.array(key), pa.array(n[key].astype(np.float64))], ["dim", "key", "n"])

    needed: dict[int, np.ndarray] = {}
    measured = groups.select("id", "times", "embedding", "dim").mapInArrow(measure, "dim int, key long, n double")
    for r in measured.groupBy("dim", "key").agg(F.sum("n").alias("n")).collect():  # at most QUERIES * STEPS rows a dimension
        needed.setdefault(r["dim"], np.zeros(QUERIES * (STEPS + 1)))[r["key"]] = r["n"]
    for dim, n in needed.items():
        links = n.reshape(QUERIES, STEPS + 1)
        index.calibrate(dim, links[links.sum(axis=1) > 0])
    return index


def _links(groups: DataFrame, index: Index) -> DataFrame:
    """(id, n, to): parts of a vector's number of links, and spanning links, from the cells. `groups`: id, times, embedding, dim."""
    context = groups.sparkSession.sparkContext
    shared = context.broadcast(index)
    least = index.least

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for dim, _, x in by_dimension(batch):
                cells, members = np.unique(own.codes(x), return_counts=True)
                seen, visitors = np.unique([c for v in own.visited(x) for c in v], return_counts=True)
                n = len(cells) + len(seen)
                parts = [np.full(n, dim, np.int32), np.concatenate([cells, seen]).astype(np.int64), np.concatenate([members, 0 * visitors]), np.concatenate([0 * members, visitors])]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, parts)), ["dim", "cell", "members", "visitors"])

    rows = groups.select("id", "times", "embedding", "dim")
    counts = rows.mapInArrow(tally, "dim int, cell long, members long, visitors long").groupBy("dim", "cell").agg(F.sum("members").alias("members"), F.sum("visitors").alias("visitors"))
    blocks = counts.select("dim", "cell", F.ceil(F.col("members") / MEMBERS).alias("m"), F.ceil(F.col("visitors") / VISITORS).alias("v")).where("m > 1 or v > 1")
    # the cells of more than one block: at most the cells of the grid, and the vectors sent over the size of a block
    hot = context.broadcast({(r["dim"], r["cell"]): (max(1, int(r["m"])), max(1, int(r["v"]))) for r in blocks.toLocalIterator()})

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, many = shared.value, hot.value
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for dim, at, x in by_dimension(batch):
                out: list[tuple[int, int, int, int, int]] = []  # row, cell, member block, visitor block, is a visitor
                mixed = (ids[at].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
                for row, (cell, visited, mix) in enumerate(zip(own.codes(x).tolist(), own.visited(x), mixed.tolist())):
                    m, v = many.get((dim, cell), (1, 1))
                    out += [(row, cell, mix % m, b, 0) for b in range(v)]
                    for c in visited:
                        m, v = many.get((dim, c), (1, 1))
                        out += [(row, c, a, mix % v, 1) for a in range(m)]
                for begin in range(0, len(out), 20_000):
                    row, *keys = np.array(out[begin : begin + 20_000], np.int64).T
                    take = pa.array(at[row])
                    columns = [pa.array(np.full(len(row), dim, np.int32)), *(pa.array(k) for k in keys), *(batch.column(c).take(take) for c in ("id", "times", "embedding"))]
                    yield pa.RecordBatch.from_arrays(columns, ["dim", "cell", "mb", "vb", "visits", "id", "times", "embedding"])

    def verify(table: pa.Table) -> pa.Table:
        own = shared.value
        dim = table.column("dim")[0].as_py()
        visits = table.column("visits").to_numpy() == 1
        ids, times = table.column("id").to_numpy(), table.column("times").to_numpy()
        x = np.asarray(table.column("embedding").combine_chunks().flatten()).reshape(len(ids), dim).astype(np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        v, m = np.flatnonzero(visits), np.flatnonzero(~visits)
        n, forest = np.zeros(len(ids), np.int64), [np.empty((2, 0), np.int64)]
        for begin in range(0, len(v) if len(m) else 0, SLICE):
            some = v[begin : begin + SLICE]
            i, j = np.nonzero(x[some] @ x[m].T >= least)
            i, j = some[i], m[j]
            ok = ids[i] != ids[j]
            i, j = i[ok], j[ok]
            if not len(j):
                continue
            n += np.bincount(i, times[j], len(ids)).astype(np.int64)
            # does the member visit the visitor's cell too? if not, this is the only meeting
            who, back = np.unique(j, return_inverse=True)
            there, home = np.unique(i, return_inverse=True)
            m1, m2 = own.cell_margins(x[who])
            home = own.codes(x[there])[home]
            k2 = m2.shape[1]
            alone = m1[back, home // k2] + m2[back, home % k2] > own.bound(dim)
            n += np.bincount(j[alone], times[i[alone]], len(ids)).astype(np.int64)
            lab = labels(len(ids), i, j)
            tied = np.flatnonzero(lab != np.arange(len(ids)))
            forest.append(np.stack([tied, lab[tied]]))
        counted, (a, b) = np.flatnonzero(n), np.concatenate(forest, axis=1)
        if len(forest) > 2:
            lab = labels(len(ids), a, b)
            a = np.flatnonzero(lab != np.arange(len(ids)))
            b = lab[a]
        return pa.table({"id": np.concatenate([ids[counted], ids[a]]), "n": np.concatenate([n[counted], np.zeros(len(a), np.int64)]), "to": np.concatenate([ids[counted], ids[b]])})

    kind = groups.schema["embedding"].dataType.simpleString()
    dealt = rows.mapInArrow(deal, f"dim int, cell long, mb long, vb long, visits long, id long, times long, embedding {kind}")
    return durable(dealt.groupBy("dim", "cell", "mb", "vb").applyInArrow(verify, "id long, n long, to long"))


def near_duplicates(vectors: DataFrame, least: float = 0.95, recall: float = 0.99, sample: int = SAMPLE) -> DataFrame:
    """A row for each row of `vectors` (vec_id long, embedding array<float or double>): vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    bound_batches(spark)
    e = F.col("embedding")
    is_bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = e.isNotNull() & ~is_bad & F.exists("embedding", lambda x: x != 0)
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    zero = F.lit(0.0).cast(kind)  # added, it makes -0 and 0 one
    rows = vectors.select("vec_id", F.when(fine, F.transform("embedding", lambda x: x + zero)).alias("embedding"))
    # equal vectors are told by 128 bits of hash
    rows = rows.select("vec_id", "embedding", *(F.when(F.col("embedding").isNotNull(), F.xxhash64(F.lit(i), "embedding")).alias(f"h{i}") for i in (1, 2)))
    groups = rows.where("embedding is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("times"), F.first("embedding").alias("embedding"))
    # a vector's number: its own, since vec_id may be null
    groups = durable(groups.select(F.monotonically_increasing_id().alias("id"), "h1", "h2", "vec_id", "times", "embedding", F.size("embedding").alias("dim")))
    met = _links(groups, _index(spark, groups, least, recall, sample))
    linked = met.groupBy("id").agg(F.sum("n").alias("n"))
    found = components(met.where("id <> to").select(F.col("id").alias("a"), F.col("to").alias("b")))
    named = groups.select("id", "vec_id", "times", "h1", "h2").join(linked, "id", "left").join(found.withColumnRenamed("node", "id"), "id", "left")
    named = named.withColumn("root", F.coalesce("root", "id"))
    lowest = named.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    info = named.join(lowest, "root").select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), "component_id")
    out = rows.drop("embedding").join(info, ["h1", "h2"], "left")
    component = F.when(F.col("h1").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
