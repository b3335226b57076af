"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Targets come by water-filling: sources share `share` times all words by weight, none above `most` times its own. A source's
documents fall into permuted blocks (by a hash of id and text) of `block_docs` documents at most, on average; with more than MOST_BLOCKS * block_docs
documents blocks are larger instead of more. A target is met by whole passes over the source, then by whole blocks in permuted order, then
by documents of one more block, the largest that still fit.

Blocks are dealt in PARTS parts, by the hash too. Every (source, pass, block, part) drawn goes to one output shard. The tree splits the range of shards in two again and again; at each
node the number of parts that go left is split over the sources by one multivariate-hypergeometric draw, seeded by the node,
so each shard's composition is that of a fair draw without replacement and the quotas add up exactly. The draw is made over GROUPS groups of sources first
and then in each group over its sources, which is the same distribution. A source's drawn parts, in permuted order, are then cut by its
shards' quotas: disjoint runs. In a shard documents are ordered by a seeded hash.

Sources are a table too: their order, targets and quotas come from distributed sums, and what is collected is a row for each group. Blocks are summed
along range partitions. The sources' table is broadcast up to BROADCAST_SOURCES rows (counted first) and shuffled beyond.

Edge cases: a null text has size 0 and is taken 0 words. A null source is a source, last in order. Sources of size 0 have target
0. Rows that repeat are documents of their own, and any of them stand for the others. Very long texts count whole: one larger than what a source still
needs is passed over unless it comes nearer than nothing. An empty table gives an empty result. Reruns give the same rows. Other columns are ignored but for those carried.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import durable
from tessera.operators.ordering import running_sum

#: Weights of sources in their order, repeated.
WEIGHTS = (3, 1, 2)
PARTS = 16
MOST_BLOCKS = 1 << 22
GROUPS = 1024
BROADCAST_SOURCES = 10_000


def targets(sizes: list[int], weights: list[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """Words for each source: `share` of all by weight, none above `most` times its size, the excess reshared by weight."""
    total = share * sum(sizes)
    capped = [size == 0 for size in sizes]
    while True:
        fixed = sum(most * s for s, c in zip(sizes, capped) if c)
        open_ = sum(w for w, c in zip(weights, capped) if not c)
        level = (total - fixed) / open_ if open_ else 0.0
        above = [not c and level * w > most * s for s, w, c in zip(sizes, weights, capped)]
        if not any(above):
            return [most * s if c else level * w for s, w, c in zip(sizes, weights, capped)]
        capped = [c or a for c, a in zip(capped, above)]


def water_level(sources: DataFrame, total: float, most: float) -> float:
    """Words for each unit of weight, of `sources` (size, weight): as `targets`, over a table. A source is capped where its weight's share is above `most` times its size."""
    level = 0.0
    while True:
        capped = (F.col("size") == 0) | (F.lit(level) * F.col("weight") > F.col("size") * most)
        sums = sources.agg(F.sum(F.when(capped, F.col("size"))).alias("fixed"), F.sum(F.when(~capped, F.col("weight"))).alias("open")).first()
        new = (total - most * (sums["fixed"] or 0)) / sums["open"] if sums["open"] else level
        if new <= level:
            return level
        level = new


def split_quotas(blocks: np.ndarray, shards: int, seed: Sequence[int] = (0,), sizes: np.ndarray | None = None) -> np.ndarray:
    """Quotas (shards x sources) of blocks, from a binary tree of multivariate-hypergeometric draws. sizes: the shards' sizes, nearly equal ones without."""
    out = np.zeros((shards, len(blocks)), np.int64)
    todo = [(0, shards, blocks.astype(np.int64))]
    while todo:
        low, high, own = todo.pop()
        if high - low == 1:
            out[low] = own
            continue
        middle = (low + high) // 2
        left = int(own.sum()) * (middle - low) // (high - low) if sizes is None else int(sizes[low:middle].sum())
        draw = np.random.Generator(np.random.PCG64([*seed, low, high]))
        taken = draw.multivariate_hypergeometric(own, left, method="marginals")
        todo += [(low, middle, taken), (middle, high, own - taken)]
    return out


def _quotas(sources: DataFrame, shards: int, seed: int) -> DataFrame:
    """(source_no, edges): for each shard, the source's drawn parts before its end. `sources`: source_no, drawn."""
    grouped = sources.select("source_no", "drawn", F.pmod(F.col("source_no"), F.lit(GROUPS)).cast("int").alias("group_"))
    sums = dict(map(tuple, grouped.groupBy("group_").agg(F.sum("drawn")).collect()))  # at most GROUPS rows
    names = sorted(sums)
    whole = split_quotas(np.array([sums[g] for g in names], np.int64), shards, (seed,))
    own = {g: whole[:, i] for i, g in enumerate(names)}

    def split(table: pa.Table) -> pa.Table:
        table = table.sort_by("source_no")
        group = table.column("group_")[0].as_py()
        edges = np.cumsum(split_quotas(table.column("drawn").to_numpy(), shards, (seed, 1 + group), own[group]), axis=0)
        return pa.table({"source_no": table.column("source_no"), "edges": pa.array(list(edges.T), pa.list_(pa.int64()))})

    return durable(grouped.groupBy("group_").applyInArrow(split, "source_no long, edges array<long>"))


def _fill(rows: DataFrame) -> DataFrame:
    """The rows (row_) that meet a source's need out of one block. `rows`: source_no, need, row_, mix, size.

    The largest documents first, each if it fits; the next smallest too if that comes nearer. Rows of equal id and text are counted first, so that a task
    holds a block's different documents.
    """
    counted = rows.groupBy("source_no", "need", "mix", "size").agg(F.count("*").alias("n"))

    def choose(table: pa.Table) -> pa.Table:
        size, n, mix = (table.column(c).to_numpy() for c in ("size", "n", "mix"))
        left = table.column("need")[0].as_py()
        order = np.lexsort((mix, -size))
        taken = np.zeros(len(size), np.int64)
        for i in order:
            taken[i] = min(n[i], int(left // size[i]))
            left -= int(taken[i] * size[i])
        rest = order[taken[order] < n[order]]
        if len(rest) and size[rest[-1]] - left < left:
            taken[rest[-1]] += 1
        some = pa.array(taken > 0)
        return pa.table({"source_no": table.column("source_no").filter(some), "mix": table.column("mix").filter(some), "size": table.column("size").filter(some), "times_": pa.array(taken).filter(some), "n": table.column("n").filter(some)})

    kinds = "source_no long, mix long, size long, times_ long, n long"
    chosen = durable(counted.groupBy("source_no").applyInArrow(choose, kinds))
    key = ["source_no", "mix", "size"]
    rows = rows.select(*key, "row_")
    whole = rows.join(chosen.where("times_ = n").select(*key), key, "left_semi")
    # of rows that repeat, the first: numbered along range partitions
    again = running_sum(rows.join(chosen.where("times_ < n").select(*key, "times_"), key), [*key, "row_"], name="place_")
    first = again.groupBy(*key).agg(F.min("place_").alias("first_"))
    some = again.join(first, key).where(F.col("place_") - F.col("first_") < F.col("times_"))
    return durable(whole.select("row_").unionByName(some.select("row_")))


def mix(docs: DataFrame, shards: int = 8, block_docs: int = 256, seed: int = 0, share: float = 1.5, most: int = 2, carry: Sequence[str] = ()) -> DataFrame:
    """A row for each row of `docs` (doc_id, source, text): doc_id, size, source_size, target, taken, shards (the shard of each
    time it is taken, in pass order), order (of the document in its shards), and the columns in `carry`, whose names must differ from these."""
    size = F.coalesce(F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")
    kept = [F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)]
    back = [F.col(f"carry_{i}").alias(c) for i, c in enumerate(carry)]
    rows = docs.select(*kept, "doc_id", "source", size.alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("mix"))
    rows = durable(rows.withColumn("row_", F.monotonically_increasing_id()))  # a row number that stays, since it is written
    found = durable(rows.groupBy("source").agg(F.sum("size").alias("size"), F.count_if(F.col("size") > 0).alias("docs")))
    whole = found.agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.sum("docs").alias("docs")).first()
    small = whole["n"] <= BROADCAST_SOURCES
    per_source = lambda df: F.broadcast(df) if small else df
    # sources by code point, null last; base: the words of the sources before
    last = F.col("source").isNull()
    numbered = running_sum(found.withColumn("last_", last), ["last_", "source"], name="number")
    numbered = running_sum(numbered, ["number"], "size", "upto_")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.col("number") - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    named = durable(numbered.select("source", (F.col("number") - 1).alias("source_no"), "size", "docs", (F.col("upto_") - F.col("size")).alias("base"), weight.alias("weight")))
    level = water_level(named, share * (whole["size"] or 0), most)
    per_block = max(block_docs, -(-(whole["docs"] or 0) // MOST_BLOCKS))
    above = F.lit(level) * F.col("weight") > F.col("size") * most
    plan = named.withColumn("target", F.when((F.col("size") == 0) | above, (F.col("size") * most).cast("double")).otherwise(F.lit(level) * F.col("weight")))
    passes = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0).cast("int")
    # at least one block for each source; the number of blocks grows with the source
    plan = plan.withColumns({"passes": passes, "blocks": F.greatest(F.lit(1), F.ceil(F.col("docs") / per_block)).cast("int")})
    plan = plan.withColumn("rest", F.col("target") - F.col("passes") * F.col("size"))
    plan = durable(plan.select(F.col("source").alias("name_"), "source_no", F.col("size").alias("source_size"), "base", "target", "passes", "rest", "blocks"))
    block = F.pmod("mix", "blocks").cast("int").alias("block")
    places = rows.where("size > 0").join(per_source(plan), F.col("source").eqNullSafe(F.col("name_"))).select("source_no", block, "base", "rest", "size", "mix", "row_")
    # the last pass takes whole blocks in order, which is permuted already, up to the block that the target cuts
    sums = running_sum(places.groupBy("source_no", "block", "base", "rest").agg(F.sum("size").alias("words")), ["source_no", "block"], "words")
    before = F.col("upto") - F.col("base") - F.col("words")
    cut = sums.where(before + F.col("words") > F.col("rest")).groupBy("source_no").agg(F.min(F.struct("block", (F.col("rest") - before).alias("need"))).alias("cut"))
    cut = durable(cut.select("source_no", F.col("cut.block").alias("cut"), F.col("cut.need").alias("need")))
    partial = places.join(per_source(cut), "source_no").where("block = cut").select("source_no", "need", "row_", "mix", "size")
    filled = _fill(durable(partial))
    # drawn: the blocks of whole passes, the whole ones of the last pass, and the one in part
    drawn = (F.col("passes").cast("long") * F.col("blocks") + F.col("cut") + 1) * PARTS
    edges = _quotas(plan.join(per_source(cut), "source_no").select("source_no", drawn.alias("drawn")), shards, seed)
    full = plan.join(per_source(cut), "source_no", "left").join(per_source(edges), "source_no", "left").drop("base", "rest", "need")
    at = rows.join(per_source(durable(full)), F.col("source").eqNullSafe(F.col("name_"))).withColumn("block", block)
    in_part = (F.col("size") > 0) & (F.col("block") == F.col("cut"))
    in_part = F.coalesce(in_part, F.lit(False))
    whole_blocks = at.where(~in_part).withColumn("more", F.when(F.col("block") < F.col("cut"), 1).otherwise(0))
    one_block = at.where(in_part).join(filled.withColumn("more", F.lit(1)), "row_", "left").withColumn("more", F.coalesce("more", F.lit(0)))
    at = whole_blocks.unionByName(one_block)
    times = F.when(F.col("size") == 0, 0).otherwise(F.col("passes") + F.col("more"))
    part = F.pmod(F.shiftright("mix", 32), F.lit(PARTS))
    number = lambda p: (p.cast("long") * F.col("blocks") + F.col("block")) * PARTS + part  # noqa: E731  the drawn part's number in its source
    shard = lambda p: F.size(F.filter("edges", lambda e: e <= number(p)))
    taken = F.when(times > 0, F.transform(F.sequence(F.lit(0), times - 1), shard)).otherwise(F.array().cast("array<int>"))
    return at.select("doc_id", "size", "source_size", "target", (times * F.col("size")).cast("long").alias("taken"), taken.alias("shards"), F.xxhash64(F.lit(seed + 1), "mix").alias("order"), *back)
