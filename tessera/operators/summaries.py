"""Group summaries, shares, indexes and the nested-record aggregations of frames, faces, scenes, audio and text boxes."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tessera.operators.ordering import Ordered, durable


#: Ranks that a sketch may be off by, of so many; rows of groups that need no brackets, and distinct values within a bracket that one task orders.
ACCURACY = 2_000
SMALL = BRACKET = 50_000
#: Groups whose brackets are broadcast, and bytes of their names.
FEW, NAMED = 20_000, 4 << 20


def exact_quantiles(rows: DataFrame, by: Sequence[str], value: str, points: dict[str, float], decimals: int | None = None) -> DataFrame:
    """A3, A4: (by.., a column for each of `points`): exact quantiles with linear interpolation, null where a group has no value."""
    return with_quantiles(rows, by, {name: (value, q) for name, q in points.items()}, decimals=decimals)


def with_quantiles(rows: DataFrame, by: Sequence[str], points: dict[str, tuple[str, float]], *others: Column, decimals: int | None = None) -> DataFrame:
    """(by.., the aggregates `others`, a column for each of `points`, named: (value, quantile)): exact quantiles with linear interpolation beside other aggregates of the
    same groups.

    Selection in two scans of `rows`: the first takes a sketch of each group, which brackets every quantile; the second counts what lies below a bracket and the distinct values within it,
    among which the quantile is found by rank. A bracket holds a few thousandths of a group; those of very large groups are put in order over range
    partitions. A bracket that its quantile isn't in shows by its ranks, and the groups are then counted anew without brackets."""
    by = list(by)
    keys, values = [f"by_{i}_" for i in range(len(by))], list(dict.fromkeys(v for v, _ in points.values()))
    own = {v: [name for name, (x, _) in points.items() if x == v] for v in values}
    around = lambda q: [max(0.0, q - 2 / ACCURACY), min(1.0, q + 2 / ACCURACY)]
    sizes = [F.count(v).alias(f"n_{i}_") for i, v in enumerate(values)]
    marks = [F.percentile_approx(F.col(v).cast("double"), [x for name in own[v] for x in around(points[name][1])], ACCURACY).alias(f"marks_{i}_") for i, v in enumerate(values)]
    seen = Observation()
    most = F.max(F.greatest(*(f"n_{i}_" for i in range(len(values))), F.lit(0))).alias("most")
    named = F.sum(sum((F.octet_length(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in by), F.lit(0))).alias("named")
    sketched = durable(rows.groupBy(*by).agg(*others, *sizes, *marks).observe(seen, most, F.count(F.lit(1)).alias("groups"), named))
    of = seen.get
    alike = [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(by, keys)]
    brackets = sketched.select(*(F.col(c).alias(k) for c, k in zip(by, keys)), *(f"n_{i}_" for i in range(len(values))), *(f"marks_{i}_" for i in range(len(values))))
    few = of["groups"] <= FEW and (of["named"] or 0) <= NAMED
    small = F.broadcast if few else lambda df: df
    brackets = small(brackets)
    slim = rows.select(*by, *(F.col(v).cast("double").alias(f"v_{i}_") for i, v in enumerate(values)))
    met = slim.join(brackets, alike) if by else slim.crossJoin(brackets)

    def found(bracketed: bool) -> DataFrame:
        """(by_.., a struct for each point: its value, and whether its bracket missed it)."""
        entries = []
        for i, v in enumerate(values):
            x, whole = F.col(f"v_{i}_"), F.lit(not bracketed) | (F.col(f"n_{i}_") <= SMALL)
            ends = [[F.element_at(f"marks_{i}_", 2 * k + e) for e in (1, 2)] for k in range(len(own[v]))]
            inside = functools.reduce(lambda a, b: a | b, [whole, *((x >= low) & (x <= high) for low, high in ends)])
            passed = [F.when(x > high, high) for _, high in ends]
            # what lies between brackets counts as the end of the one before, right behind it
            at = F.when(inside, x).otherwise(F.greatest(*passed) if len(passed) > 1 else passed[0])
            entries.append(F.struct(F.lit(i).alias("of"), F.col(f"n_{i}_").alias("n"), at.alias("x"), (~inside).alias("gap"), x.isNotNull().alias("known")))
        each = met.select(*keys, F.inline(F.array(*entries))) if len(entries) > 1 else met.select(*keys, entries[0].alias("e")).select(*keys, "e.*")
        counts = each.where("known").groupBy(*keys, "of", "n", "x", "gap").agg(F.count("*").alias("c"))
        if bracketed and (of["most"] or 0) * 6 * max(map(len, own.values())) <= BRACKET * ACCURACY:  # so many rows within a group's brackets; equal ones are one by now
            summed = counts.withColumn("upto", F.sum("c").over(Window.partitionBy(*keys, "of").orderBy("x", "gap").rowsBetween(Window.unboundedPreceding, 0)))
        else:
            summed = Ordered(counts, [*keys, "of"], ["x", "gap"]).scan(upto=("sum", F.col("c"))).rows
        rank = lambda q: (F.col("n") - 1) * F.lit(q)
        first = lambda v, q, f: F.min(F.when((F.col("of") == values.index(v)) & (F.col("upto") > f(rank(q))), F.struct("x", "gap", rank(q).alias("at"))))
        picked = summed.groupBy(*keys).agg(*(first(v, q, f).alias(f"{end}_{j}") for j, (v, q) in enumerate(points.values()) for end, f in (("low", F.floor), ("high", F.ceil))))
        shown = []
        for j, name in enumerate(points):
            low, high, at = F.col(f"low_{j}")["x"], F.col(f"high_{j}")["x"], F.col(f"low_{j}")["at"]
            value = low + (at - F.floor(at)) * (high - low)
            missed = F.coalesce(F.col(f"low_{j}")["gap"] | F.col(f"high_{j}")["gap"], F.lit(False))
            shown.append(F.struct((F.round(value, decimals) if decimals is not None else value).alias("value"), missed.alias("missed")).alias(name))
        return picked.select(*keys, *shown)

    picked = found(True)
    if (of["most"] or 0) > SMALL:
        if few:  # a row for each group
            picked = rows.sparkSession.createDataFrame(picked.collect(), picked.schema)
        else:
            picked = durable(picked)
        if not picked.where(functools.reduce(lambda a, b: a | b, [F.col(name)["missed"] for name in points])).isEmpty():
            picked = found(False)
    wide = picked.select(*keys, *(F.col(name)["value"].alias(name) for name in points))
    kept = sketched.drop(*(f"{x}_{i}_" for x in ("n", "marks") for i in range(len(values))))
    return kept.join(small(wide), alike, "left").drop(*keys) if by else kept.join(F.broadcast(wide), how="left")


def rate(flag: Column) -> Column:
    """Percent of rows where the flag holds."""
    return F.avg(flag.cast("double")) * 100


def share(rows: DataFrame, value: str, by: Sequence[str], name: str = "share", decimals: int = 4) -> DataFrame:
    """Percent of the group's total. The window runs over aggregated rows."""
    total = F.sum(value).over(Window.partitionBy(*by))
    return rows.withColumn(name, F.round(F.when(total != 0, 100 * F.col(value) / total), decimals))


def index_100(rows: DataFrame, value: str, by: Sequence[str] = (), name: str = "index", inverted: bool = False, decimals: int = 4) -> DataFrame:
    """(x - min) / (max - min) * 100, null where all are equal. By group, or over the whole (short) series."""
    if by:
        low, high = (f(value).over(Window.partitionBy(*by)) for f in (F.min, F.max))
        scaled = rows.withColumns({"low_": low, "high_": high})
    else:
        ends = rows.agg(F.min(value).alias("low_"), F.max(value).alias("high_"))  # one row
        scaled = rows.crossJoin(F.broadcast(ends))
    x = 100 * (F.col(value) - F.col("low_")) / F.when(F.col("high_") != F.col("low_"), F.col("high_") - F.col("low_"))
    return scaled.withColumn(name, F.round(100 - x if inverted else x, decimals)).drop("low_", "high_")


def capped_rank(value: str, by: Sequence[str], cap: int) -> Column:
    """Rank by descending value, ties share the least; zero and ranks beyond the cap are cap + 1."""
    w = Window.partitionBy(*by).orderBy(F.desc(value))
    return F.when(F.col(value) > 0, F.least(F.rank().over(w), F.lit(cap + 1))).otherwise(F.lit(cap + 1))


def trend(before: Column, after: Column, step: int = 5) -> Column:
    """Rising, falling or stable by the change of rank."""
    return F.when(before - after >= step, "rising").when(after - before >= step, "falling").otherwise("stable")


def winsorise(rows: DataFrame, value: str, q: float) -> DataFrame:
    """Values above the q-quantile are set to it."""
    cap = exact_quantiles(rows, [], value, {"cap_": q})  # one row
    return rows.crossJoin(F.broadcast(cap)).withColumn(value, F.least(value, "cap_")).drop("cap_")


def ecdf(rows: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """(by.., value, p): the empirical distribution at each distinct value; a running sum over range partitions of the distinct values."""
    by = list(by)
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n_"))
    sizes = counts.groupBy(*by).agg(F.sum("n_").alias("all_")).withColumnsRenamed({c: f"by_{i}_" for i, c in enumerate(by)})
    summed = Ordered(counts, by, [value]).scan(upto_=("sum", F.col("n_"))).rows
    met = summed.join(sizes, [F.col(c).eqNullSafe(F.col(f"by_{i}_")) for i, c in enumerate(by)])
    return met.select(*by, value, F.round(F.col("upto_") / F.col("all_"), 6).alias("p"))


def change_points(rows: DataFrame, category: str, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows whose category is not that of the row before. `rows` is a short sequence (periods), or has groups."""
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(*order)
    before = F.lag(category).over(w)
    return rows.withColumn("before", before).where(F.col("before").isNotNull() & (F.col("before") != F.col(category)))


def modal(rows: DataFrame, by: Sequence[str], value: str, name: str = "modal") -> DataFrame:
    """The commonest value of each group, of equals the first by name."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n_"))
    best = F.min(F.struct((-F.col("n_")).alias("n"), F.col(value).alias("v")))
    return counts.groupBy(*by).agg(best.alias("b_")).select(*by, F.col("b_.v").alias(name), (-F.col("b_.n")).alias("n"))


def crosstab(rows: DataFrame, row: str, col: str, labels: Sequence[str]) -> DataFrame:
    """Counts of declared labels as columns, and their total."""
    wide = rows.groupBy(row).agg(*(F.count_if(F.col(col) == x).alias(str(x)) for x in labels))
    return wide.withColumn("total", sum((F.col(f"`{x}`") for x in labels), F.lit(0)))


def faces_by_message(faces: DataFrame) -> DataFrame:
    """One aggregation over detections (face_index -1: a frame without faces). A frame counts once a face in mean positions."""
    face = F.col("face_index") >= 0
    target = face & F.col("is_target")
    frames = F.countDistinct("frame_filename")
    clusters, own = F.countDistinct(F.when(face, F.col("cluster_id"))), F.countDistinct(F.when(target, F.col("cluster_id")))
    at = F.when(target, F.col("frame_position"))
    hit = F.countDistinct(F.when(target, F.col("frame_filename")))
    return faces.groupBy("message_id").agg(
        F.min("date").alias("date"), F.min("phase").alias("phase"), frames.alias("total_frames"), F.count_if(face).alias("total_faces"), hit.alias("frames_with_target"),
        F.round(hit / frames * 100, 2).alias("pct_target"), F.round(F.count_if(face) / frames, 2).alias("avg_faces"),
        F.round(F.coalesce(F.max(F.when(face, F.col("similarity"))), F.lit(0.0)), 4).alias("max_similarity"), clusters.alias("n_individuals"), (clusters - own).alias("n_others"),
        F.round(F.avg(at), 4).alias("avg_position"), F.round(F.min(at), 4).alias("first_position"), F.round(F.max(at), 4).alias("last_position"),
    )


def faces_by(messages: DataFrame, by: Sequence[str]) -> DataFrame:
    """Message summaries to phases or months."""
    return messages.groupBy(*by).agg(F.count("*").alias("n_messages"), F.round(rate(F.col("frames_with_target") > 0), 2).alias("pct_with_target"), F.round(F.avg("pct_target"), 2).alias("mean_pct"), F.round(F.avg("avg_faces"), 2).alias("mean_faces"))


def by_strategy(rows: DataFrame, by: Sequence[str], strategies: dict[str, str], threshold: float = 0.5) -> DataFrame:
    """Each column by its strategy (mean, max, p75), and whether it reaches the threshold."""
    how = {"mean": F.avg, "max": F.max}
    plain = [F.round(how[s](c), 4).alias(c) for c, s in strategies.items() if s in how]
    points = {c: (c, 0.75) for c, s in strategies.items() if s == "p75"}
    out = with_quantiles(rows, by, points, *plain, decimals=4) if points else rows.groupBy(*by).agg(*plain)
    return out.select(*by, *strategies, *((F.col(c) >= threshold).alias(f"{c}_flag") for c in strategies))


def mean_vector(rows: DataFrame, by: Sequence[str], vector: str) -> DataFrame:
    """(by.., mean array, n): component-wise means by exploding with the position; sums combine before the shuffle."""
    parts = rows.select(*by, F.posexplode(vector).alias("i_", "x_")).groupBy(*by, "i_").agg(F.avg("x_").alias("x_"))
    n = rows.groupBy(*by).agg(F.count(vector).alias("n"))
    means = parts.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i_", "x_"))), lambda p: p["x_"]).alias("mean"))
    return means.join(n, list(by))


def entropy(histogram: Column) -> Column:
    """Shannon entropy in bits of a non-negative array."""
    total = F.aggregate(histogram, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return F.aggregate(histogram, F.lit(0.0), lambda a, x: a - F.when((x > 0) & (total > 0), x / total * F.log2(x / total)).otherwise(0.0))


def normalised(vector: Column) -> Column:
    """To unit length; a zero vector stays."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return F.when(norm > 0, F.transform(vector, lambda x: x / norm)).otherwise(vector)


def merge_boxes(boxes: DataFrame, by: Sequence[str]) -> DataFrame:
    """Texts of OCR boxes (order, text, watermark, confidence) without case-insensitive repeats, in first-seen order, content
    and watermark apart, with the mean confidence of what is kept."""
    first = F.min_by(F.struct("order", "text", "confidence"), "order").alias("b")
    kept = boxes.where("trim(text) <> ''").groupBy(*by, "watermark", F.lower(F.trim("text")).alias("key_")).agg(first)
    texts = lambda flag: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("watermark") == flag, F.struct("b.order", "b.text")))), lambda x: x["text"]), " ")
    return kept.groupBy(*by).agg(texts(False).alias("content"), texts(True).alias("mark"), F.round(F.avg("b.confidence"), 4).alias("confidence"))


def audio_ratios(segments: DataFrame, by: Sequence[str], duration: str | None = None, labels: Sequence[str] = ("speech", "music", "silence", "noise")) -> DataFrame:
    """Shares of labelled segments (label, start, end) in the known duration or their sum; unknown labels are the last one's."""
    label = F.when(F.col("label").isin(*labels), F.col("label")).otherwise(labels[-1])
    rows = segments.select(*by, label.alias("label"), (F.col("end") - F.col("start")).alias("d"), *([duration] if duration else []))
    whole = F.coalesce(F.max(duration), F.sum("d")) if duration else F.sum("d")
    return rows.groupBy(*by).agg(*(F.round(F.coalesce(F.sum(F.when(F.col("label") == x, F.col("d"))), F.lit(0.0)) / whole, 4).alias(f"{x}_ratio") for x in labels))


def speech(segments: Column, duration: Column) -> tuple[Column, Column]:
    """Seconds of speech of an array of segments (start, end), and its share of the duration."""
    seconds = F.aggregate(segments, F.lit(0.0), lambda a, s: a + s["end"] - s["start"])
    return seconds, F.when(duration > 0, seconds / duration)


def confidence(logprobs: Column) -> Column:
    """Exp of the mean log probability of an array."""
    return F.when(F.size(logprobs) > 0, F.exp(F.aggregate(logprobs, F.lit(0.0), lambda a, x: a + x) / F.size(logprobs)))


def scene_summary(scenes: Column, duration: Column) -> tuple[Column, Column, Column]:
    """Cuts (scenes less one), cuts a minute, mean seconds a scene of an array of scenes."""
    n = F.size(scenes)
    cuts = F.greatest(n - 1, F.lit(0))
    return cuts, F.when(duration > 0, F.round(cuts / (duration / 60), 4)), F.when(n > 0, F.round(duration / n, 4))


def reaction_totals(reactions: Column) -> tuple[Column, Column]:
    """The total over all reactions (struct emoji, count), and those with a plain emoji."""
    return F.aggregate(reactions, F.lit(0).cast("long"), lambda a, r: a + r["count"]), F.filter(reactions, lambda r: r["emoji"].isNotNull())


def albums(rows: DataFrame, album: str, kind: str) -> DataFrame:
    """Size and composition of each album."""
    kinds = F.array_join(F.array_sort(F.collect_set(kind)), "+")
    return rows.where(F.col(album).isNotNull()).groupBy(album).agg(F.count("*").alias("size"), kinds.alias("composition"))


def with_totals(rows: DataFrame, by: str, total: str = "all") -> DataFrame:
    """Rows once for their group and once for the whole, so that one aggregation gives both."""
    return rows.withColumn(by, F.explode(F.array(F.lit(total), F.col(by)))).where(F.col(by).isNotNull())
