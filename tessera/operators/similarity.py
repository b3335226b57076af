"""Similarity search: Hamming and cosine, nearest earlier neighbours, mean distances, epsilon components, equal contents.

The exhaustive comparisons deal both sides into blocks and compare block pairs in vectorised tasks; a task emits a row for each of its
queries, or counts, never its pairs. Compute is quadratic by definition; rows shuffled grow with the number of blocks, and no task
holds more than two blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ordering import durable, partitions_of

BLOCK = 4096
SLICE = 1024
#: Rows of a block of hashes and of unit vectors, at most; up to these a table, or a group, is as many blocks as MOST_BLOCKS.
HASHES, VECTORS, MOST_BLOCKS = 1 << 17, 1 << 14, 32
#: Tasks of a shuffle of pairs of blocks, at most; groups up to which their brackets are sent to all executors, as a join by the group would put a hot one in one task.
MOST_TASKS, MOST_GROUPS = 4096, 100_000
#: Rows of the two sides that are compared at a time: what is made of them stays in a core's cache.
TALL, WIDE = 32, 4096
STEPS = 1 << 40  # a cosine is a whole number of these steps from -1 up
SHIFTS = (27, 13, 0)  # three passes find its 41 bits


def bits_of(hexadecimal: Column) -> Column:
    """a 64-bit hash of 16 hex digits as a long (also with the sign bit set); null for other lengths."""
    return F.when(F.char_length(hexadecimal) == 16, F.conv(hexadecimal, 16, -10).cast("long"))


def hamming(a: Column, b: Column) -> Column:
    """differing bits of two longs."""
    return F.bit_count(a.bitwiseXOR(b))


def cosine(a: Column, b: Column) -> Column:
    """cosine of two arrays in double precision, 0 for a zero vector."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when((norm(a) > 0) & (norm(b) > 0), dot / (norm(a) * norm(b))).otherwise(0.0)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def _blocks(rows: DataFrame, block: int) -> int:
    return max(1, -(-rows.count() // block))


def _compare(asked: DataFrame, given: DataFrame, nearest: Callable[[pa.ChunkedArray, np.ndarray, pa.ChunkedArray, np.ndarray], tuple[np.ndarray, np.ndarray]], block: int | None) -> DataFrame:
    """(id, d, near): for each row of `asked` (id, v) and block of `given` (id, v), the nearest row with a smaller id, of equals the earliest. Blocks are ranges of
    ids, and a row goes to those alone that begin before it; each pair of blocks is a task's, however few bytes it has."""
    n = given.count()
    blocks = max(1, -(-n // (block or min(HASHES, max(BLOCK, -(-n // MOST_BLOCKS))))))
    bounds = given.approxQuantile("id", [i / blocks for i in range(1, blocks)], 1 / (8 * blocks)) if blocks > 1 else []
    place = F.size(F.filter(F.lit(bounds).cast("array<double>"), lambda x: x <= F.col("id").cast("double")))  # a function of the id alone
    left = asked.select(F.lit(True).alias("asks"), "id", "v", place.alias("a_")).select("*", F.explode(F.sequence(F.lit(0), "a_")).alias("b_"))
    right = given.select(F.lit(False).alias("asks"), "id", "v", place.alias("b_")).select("asks", "id", "v", F.explode(F.sequence("b_", F.lit(blocks - 1))).alias("a_"), "b_")

    def task(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        asks = table.column("asks").to_numpy(zero_copy_only=False)
        q, m = table.filter(pa.array(asks)), table.filter(pa.array(~asks))
        qo, mo = (t.column("id").to_numpy() for t in (q, m))
        if not len(qo) or not len(mo):
            return pa.table({"id": pa.array([], pa.int64()), "d": pa.array([], pa.float64()), "near": pa.array([], pa.int64())})
        best, at = nearest(q.column("v"), qo, m.column("v"), mo)
        some = np.isfinite(best)
        return pa.table({"id": qo[some], "d": best[some], "near": mo[at][some]})

    dealt = left.unionByName(right).repartition(blocks * (blocks + 1) // 2, "a_", "b_")
    return dealt.groupBy("a_", "b_").applyInArrow(task, "id long, d double, near long")


def _nearest_hash(a: pa.ChunkedArray, qo: np.ndarray, b: pa.ChunkedArray, mo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distance of each hash of a to the nearest in b with a smaller id, infinite where there is none, and its place; both sides are in the order of ids."""
    x, y = (c.to_numpy().view(np.uint64) for c in (a, b))
    best, at = np.full(len(x), 255, np.uint8), np.zeros(len(x), np.int64)
    for j in range(0, len(y), WIDE):
        others, ids = y[None, j : j + WIDE], mo[j : j + WIDE]
        for i in range(np.searchsorted(qo, ids[0], side="right"), len(x), TALL):
            d = np.bitwise_count(x[i : i + TALL, None] ^ others)
            if ids[-1] >= qo[i]:
                d[ids[None, :] >= qo[i : i + TALL, None]] = 255
            least = d.min(axis=1)
            better = np.flatnonzero(least < best[i : i + TALL])  # of equals the earliest stays
            if len(better):
                best[i + better] = least[better]
                at[i + better] = j + d[better].argmin(axis=1)
    return np.where(best < 255, best.astype(np.float64), np.inf), at


def _nearest_cosine(a: pa.ChunkedArray, qo: np.ndarray, b: pa.ChunkedArray, mo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for vectors, at 1 - cosine."""
    x, y = (np.array(c.to_pylist(), dtype=np.float64) for c in (a, b))
    best, at = [], []
    for i in range(0, len(x), SLICE):
        with np.errstate(invalid="ignore", divide="ignore"):
            sims = (x[i : i + SLICE] @ y.T) / (np.linalg.norm(x[i : i + SLICE], axis=1)[:, None] * np.linalg.norm(y, axis=1)[None, :])
        d = np.where(mo[None, :] < qo[i : i + SLICE, None], 1 - np.where(np.isfinite(sims), sims, 0.0), np.inf)
        at.append(d.argmin(axis=1))
        best.append(d[np.arange(len(d)), at[-1]])
    return np.concatenate(best), np.concatenate(at)


def _bands(value: str, most: int) -> Column:
    """Keys of a 64-bit hash, at least one of which two hashes share that are at most `most` bits apart: of most + 3 bands three are equal in such a pair."""
    n = most + 3
    edges = [64 * i // n for i in range(n + 1)]
    masks = [sum((1 << edges[b + 1]) - (1 << edges[b]) for b in some) for some in combinations(range(n), 3)]
    signed = lambda x: x - (x >> 63 << 64)
    return F.array(*(F.struct(F.lit(i).alias("i"), F.col(value).bitwiseAND(F.lit(signed(mask)).cast("long")).alias("bits")) for i, mask in enumerate(masks)))


def nearest_earlier(rows: DataFrame, order: str, value: str, kind: str = "hamming", block: int | None = None, radii: Sequence[int] = (3,)) -> DataFrame:
    """(order, near, d): the nearest row of those strictly earlier in `order` (a long), the earliest of equals; a row for each value of `order` that has
    an earlier row. Null values are left out. value: a long for hamming, an array for cosine (distance 1 - cosine).

    Hamming: rows of an equal hash are settled by the first of them, and only firsts go on. For each radius those still open meet the firsts that share
    three bands, which are all within it. What has no neighbour within the last radius is compared with all earlier firsts, block by block: compute is quadratic in
    the open rows, and each is shuffled to MOST_BLOCKS blocks at most until a block holds HASHES rows."""
    given = rows.where(F.col(value).isNotNull() & F.col(order).isNotNull()).select(F.col(order).cast("long").alias("id"), F.col(value).alias("v"))
    if kind == "hamming":
        firsts = durable(given.groupBy("v").agg(F.min("id").alias("id")).select("id", "v"))
        repeats = given.join(firsts.withColumnRenamed("id", "near"), "v").where("id > near").select("id", F.lit(0.0).alias("d"), "near")
        settled, asked = [repeats], firsts
        for radius in radii:
            left = asked.select(F.col("id").alias("a"), F.col("v").alias("x"), F.explode(_bands("v", radius)).alias("band"))
            right = firsts.select(F.col("id").alias("b"), F.col("v").alias("y"), F.explode(_bands("v", radius)).alias("band"))
            d = hamming(F.col("x"), F.col("y"))
            met = left.join(right, "band").where((F.col("a") > F.col("b")) & (d <= radius))
            best = durable(met.groupBy("a", "x").agg(F.min(F.struct(d.cast("double").alias("d"), F.col("b").alias("near"))).alias("m")).select(F.col("a").alias("id"), F.col("x").alias("v"), "m.*"))
            settled.append(best.select("id", "d", "near"))
            asked = asked.join(best.select("id", "v"), ["id", "v"], "left_anti")
        settled.append(_compare(asked, firsts, _nearest_hash, block))
        found = reduce(DataFrame.unionByName, settled)
    else:
        found = _compare(given, given, _nearest_cosine, block or BLOCK)
    best = found.groupBy("id").agg(F.min(F.struct("d", "near")).alias("b"))
    return best.select(F.col("id").alias(order), F.col("b.near").alias("near"), F.round("b.d", 6).alias("d"))


def mean_distance(rows: DataFrame, by: Sequence[str], order: str, value: str, least: int = 3) -> DataFrame:
    """Mean Hamming distance of a group's pairs, groups of at least `least`.

    The sum over pairs is the sum over the 64 bits of ones times zeros, so no pair is formed: one aggregation.
    """
    ones = [F.sum(F.getbit(value, F.lit(i))).cast("double").alias(f"b{i}") for i in range(64)]
    sums = rows.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), *ones).where(F.col("n") >= least)
    apart = sum((F.col(f"b{i}") * (F.col("n") - F.col(f"b{i}")) for i in range(64)), F.lit(0.0))
    return sums.select(*by, "n", F.round(apart / (F.col("n") * (F.col("n") - 1) / 2), 6).alias("mean_distance"))


def hamming_pairs(rows: DataFrame, key: str, value: str, most: int = 3) -> DataFrame:
    """J14 with a bound: (a, b, n_a, n_b, d): classes of rows with an equal hash, named by their least key, with their numbers of rows, for each pair of
    classes at most `most` bits apart, and each class of more than one row with itself. Rows of a class aren't paired one by one. Of most + 3
    bands of the 64 bits three are equal in such a pair, so equi-joins on any three bands (of half the bits, for three) find them."""
    classes = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.min(key).alias("id"), F.count("*").alias("n"))
    banded = classes.select(F.struct(F.col(value).alias("h"), "id", "n").alias("c"), F.explode(_bands(value, most)).alias("band"))
    left, right = banded.withColumnRenamed("c", "x"), banded.withColumnRenamed("c", "y")
    met = left.join(right, "band").where(F.col("x.h") < F.col("y.h")).where(hamming(F.col("x.h"), F.col("y.h")) <= most).select("x", "y").distinct()
    own = classes.where("n > 1").select(F.struct(F.col(value).alias("h"), "id", "n").alias("x")).withColumn("y", F.col("x"))
    a, b = F.when(F.col("x.id") < F.col("y.id"), F.col("x")).otherwise(F.col("y")), F.when(F.col("x.id") < F.col("y.id"), F.col("y")).otherwise(F.col("x"))
    pairs = met.unionByName(own).select(a.alias("a"), b.alias("b"))
    return pairs.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("a.n").alias("n_a"), F.col("b.n").alias("n_b"), hamming(F.col("a.h"), F.col("b.h")).alias("d"))


def top_cosine(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 5, block: int = BLOCK) -> DataFrame:
    """Each query's k most similar rows (itself left out): (query, key, sim, rank), of equals the least key.

    Queries and rows are dealt into blocks by hash; a task compares two blocks and keeps k rows for each query, so nothing is
    collected and no task holds more than two blocks.
    """
    some = lambda df: df.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    asked, given = some(queries), some(rows)
    a, b = _blocks(asked, block), _blocks(given, block)
    place = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select(place(a).alias("a_"), every(b).alias("b_"), F.lit(True).alias("asks"), "id", "v")
    right = given.select(every(a).alias("a_"), place(b).alias("b_"), F.lit(False).alias("asks"), "id", "v")

    def task(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy(zero_copy_only=False)
        ids = table.column("id").to_numpy()
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if asks.any() and not asks.all():
            x = np.array(table.column("v").to_pylist(), dtype=np.float64)
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
            q, m = np.flatnonzero(asks), np.flatnonzero(~asks)
            for part in np.array_split(q, max(1, len(q) // 256)):
                sims = np.round(x[part] @ x[m].T, 6)
                sims[ids[part][:, None] == ids[m][None, :]] = -np.inf
                at = np.lexsort((np.broadcast_to(ids[m], sims.shape), -sims), axis=1)[:, :k]
                best = np.take_along_axis(sims, at, axis=1)
                ok = np.isfinite(best)
                out.append((np.repeat(ids[part], at.shape[1]).reshape(at.shape)[ok], ids[m][at][ok], best[ok]))
        return pa.table(dict(zip(("query", "id", "sim"), map(np.concatenate, zip(*out)))))

    from tessera.operators.lexical import top_n

    found = left.unionByName(right).groupBy("a_", "b_").applyInArrow(task, "query long, id long, sim double")
    return top_n(found, ["query"], [F.desc("sim"), F.asc("id")], k)


def ratio_matches(rows: DataFrame, queries: DataFrame, key: str, vector: str, ratio: float = 0.75) -> DataFrame:
    """(query, id, d1, d2): each query's nearest row where its distance is below `ratio` times the second nearest's (1 - cosine)."""
    two = top_cosine(rows, queries, key, vector, 2)
    best = two.groupBy("query").agg(*(F.max(F.when(F.col("rank") == i, F.col(c))).alias(name) for i, c, name in ((1, "id", "id"), (1, "sim", "s1"), (2, "sim", "s2"))))
    gaps = best.select("query", "id", F.round(1 - F.col("s1"), 6).alias("d1"), F.round(1 - F.col("s2"), 6).alias("d2"))
    return gaps.where(F.col("d1") < ratio * F.col("d2"))


def similarity_summary(rows: DataFrame, by: str, vector: str) -> DataFrame:
    """Mean cosine over a group's pairs without forming them: (|sum of unit vectors|^2 - n) / (n (n - 1))."""
    length = norm(F.col(vector))
    unit = rows.where(F.col(vector).isNotNull() & (length > 0)).select(by, F.transform(vector, lambda x: x.cast("double") / length).alias("u"))
    parts = unit.select(by, F.posexplode("u").alias("i", "x")).groupBy(by, "i").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    sums = parts.groupBy(by).agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.max("n").alias("n")).where("n > 1")
    return sums.select(by, "n", F.round((F.col("ss") - F.col("n")) / (F.col("n") * (F.col("n") - 1)), 6).alias("mean_sim"))


def pair_quantiles(rows: DataFrame, by: str, vector: str, points: dict[str, float], block: int | None = None, decimals: int = 6) -> DataFrame:
    """(by, n, a column for each of `points`): quantiles (0 the least, 0.5 the median, interpolated between two pairs) of the cosines of all pairs of a group's
    vectors. Rows without a group, and vectors that are null or zero or hold null or non-finite components, are left out; n counts the others; groups of one have no row.

    The cosines are never written: each of three passes over block pairs counts them in at most 16,385 bins of each bracket, and the next pass divides the bin that holds
    the wanted rank. Blocks hold their rows in one order, and cosines are whole steps of 2^-40, so passes agree. Compute is quadratic in a group; a task holds two blocks, of
    VECTORS rows at most, and 2^20 cosines at a time."""
    length = norm(F.col(vector))
    some = rows.where(F.col(by).isNotNull() & F.col(vector).isNotNull() & (length > 0) & (length < float("inf")))
    sizes = durable(some.groupBy(by).agg(F.count("*").alias("n")).where("n > 1"))
    units = some.select(by, F.transform(vector, lambda x: x.cast("double") / length).alias("u"), F.monotonically_increasing_id().alias("row_"))
    rows_of = F.lit(block) if block else F.least(F.lit(VECTORS), F.greatest(F.lit(BLOCK), F.ceil(F.col("n") / MOST_BLOCKS)))
    blocks = F.ceil(F.col("n") / rows_of).cast("int")
    tasks, groups = sizes.agg(F.coalesce(F.sum(blocks * (blocks + 1) / 2), F.lit(1)), F.count("*")).first()
    dealt = durable(units.join(sizes, by).withColumn("own_", F.pmod(F.xxhash64("row_"), blocks).cast("int")).withColumn("last_", blocks - 1).drop("n"))
    left = dealt.select(by, "row_", "u", F.lit(True).alias("asks"), F.col("own_").alias("a_"), F.explode(F.sequence("own_", "last_")).alias("b_"))
    right = dealt.select(by, "row_", "u", F.lit(False).alias("asks"), F.explode(F.sequence(F.lit(0), "own_")).alias("a_"), F.col("own_").alias("b_"))
    met = left.unionByName(right)
    parts = int(min(max(tasks, partitions_of(rows)), MOST_TASKS))  # by number: a few bytes are much work here
    kind = next(f.dataType.simpleString() for f in rows.schema.fields if f.name == by)

    pairs = F.col("n") * (F.col("n") - 1) / 2
    place = {name: F.lit(q) * (pairs - 1) for name, q in points.items()}
    ends = F.array_distinct(F.array(*(f(x).cast("long") for x in place.values() for f in (F.floor, F.ceil))))
    state = sizes.select(by, F.explode(ends).alias("rank"), F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("below"))
    for number, shift in enumerate(SHIFTS):
        width = 1 << SHIFTS[number - 1] if number else 4 * STEPS
        brackets = state.groupBy(by).agg(F.collect_set("low").alias("lows"))
        counted = met.join(F.broadcast(brackets) if groups <= MOST_GROUPS else brackets, by).repartition(parts, by, "a_", "b_").groupBy(by, "a_", "b_").applyInArrow(_pair_counts(by, width, shift), f"{by} {kind}, low long, bin long, pairs long")
        bins = counted.groupBy(by, "low", "bin").agg(F.sum("pairs").alias("pairs"))
        # a window holds the bins of one bracket
        upto = F.sum("pairs").over(Window.partitionBy(by, "low").orderBy("bin"))
        bins = bins.withColumn("upto", upto).withColumn("before", upto - F.col("pairs"))
        rank = F.col("rank") - F.col("below")
        state = durable(state.join(bins, [by, "low"]).where((rank >= F.col("before")) & (rank < F.col("upto"))).select(by, "rank", (F.col("low") + F.shiftleft("bin", shift)).alias("low"), (F.col("below") + F.col("before")).alias("below")))
    value = F.col("low") / F.lit(float(STEPS)) - 1
    at = lambda x: F.max(F.when(F.col("rank") == x.cast("long"), value))
    found = state.join(sizes, by).groupBy(by, "n").agg(*(c for name, x in place.items() for c in (at(F.floor(x)).alias(f"{name}_a"), at(F.ceil(x)).alias(f"{name}_b"))))
    between = lambda name, x: F.col(f"{name}_a") + (F.col(f"{name}_b") - F.col(f"{name}_a")) * (x - F.floor(x))
    return found.select(by, "n", *(F.round(between(name, x), decimals).alias(name) for name, x in place.items()))


def _pair_counts(by: str, width: int, shift: int) -> Callable[[pa.Table], pa.Table]:
    """Of the pairs of two blocks: their number in each bin of 2^shift steps of each bracket, which begins at one of `lows` and is `width` steps wide."""

    def task(table: pa.Table) -> pa.Table:
        table = table.sort_by("row_").combine_chunks()
        asks = table.column("asks").to_numpy(zero_copy_only=False)
        lows = sorted(table.column("lows")[0].as_py())
        same = table.column("a_")[0].as_py() == table.column("b_")[0].as_py()
        q, m = (_matrix(table.column("u").filter(pa.array(side))) if side.any() else None for side in (asks, ~asks))
        counts = np.zeros((len(lows), (width >> shift) + 1), dtype=np.int64)
        for begin in range(0, len(q) if q is not None and m is not None else 0, tall := max(1, (1 << 20) // max(1, len(m) if m is not None else 1))):
            steps = np.clip(q[begin : begin + tall] @ m.T, -1, 1)
            steps += 1
            steps *= STEPS
            np.rint(steps, out=steps)  # whole numbers below 2^42: exact as doubles, so are shifts to the right
            if same:
                steps = steps[np.arange(len(m))[None, :] > np.arange(begin, begin + len(steps))[:, None]]
            for i, low in enumerate(lows):
                inside = steps.ravel() if width >= 4 * STEPS else steps[(steps >= low) & (steps < low + width)]
                if len(inside):
                    counts[i] += np.bincount(((inside - low) * 2.0**-shift).astype(np.int64), minlength=counts.shape[1])
        which, found = np.nonzero(counts)
        groups = table.column(by).take(pa.array(np.zeros(len(which), np.int64)))
        return pa.table({by: groups, "low": pa.array(np.array(lows, np.int64)[which]), "bin": pa.array(found.astype(np.int64)), "pairs": pa.array(counts[which, found])})

    return task


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of equal length as rows, without an object for each."""
    values = column.combine_chunks()
    if isinstance(values, pa.ChunkedArray):
        values = pa.concat_arrays(values.chunks)
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def epsilon_components(rows: DataFrame, by: str, key: str, vector: str, eps: float) -> DataFrame:
    """M9: components of the graph of vectors nearer than eps in cosine distance, within each message (a message's faces are few)."""

    def task(table: pa.Table) -> pa.Table:
        ids = table.column(key).to_numpy()
        order = np.argsort(ids, kind="stable")
        x = np.array(table.column(vector).to_pylist(), dtype=np.float64)[order]
        length = np.linalg.norm(x, axis=1, keepdims=True)
        x = np.divide(x, length, out=np.zeros_like(x), where=length > 0)
        least = np.arange(len(ids))  # the first member that each is known to be joined with
        for begin in range(0, len(ids), SLICE):  # some rows at a time: no square matrix
            i, j = np.nonzero(1 - x[begin : begin + SLICE] @ x.T <= eps)
            least = _joined(least, i + begin, j)
        label = np.unique(least, return_inverse=True)[1]
        return pa.table({by: table.column(by), key: ids[order], "cluster_id": label.astype(np.int32)})

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.groupBy(by).applyInArrow(task, f"{by} {kinds[by]}, {key} {kinds[key]}, cluster_id int")


def _joined(least: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The first members of the components `least` after joining those of i and j."""
    while True:
        a, b = least[i], least[j]
        new, low = least.copy(), np.minimum(a, b)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, least):
            return least
        least = new


def equal_contents(rows: DataFrame, key: str, content: str) -> DataFrame:
    """MD5 groups with more than one row: (md5, n, first key)."""
    return rows.groupBy(F.md5(F.col(content).cast("binary")).alias("md5")).agg(F.count("*").alias("n"), F.min(key).alias("first")).where("n > 1")
