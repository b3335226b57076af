"""Lexicometry: tokens, lexical statistics, TF-IDF, differential vocabulary, collocations, co-occurrence, concordances.

Token tables have an explicit position (`pos`), since a distributed table has no order of its own. All operators are
aggregations over tokens that combine before the shuffle; windows over tokens stay within a document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ordering import durable

#: What counts as a token, after lower-casing.
TOKEN = r"[\p{L}_][\p{L}\p{N}_]*"
BETWEEN = "\x01"  # no token has it
LETTERS_TOKEN = r"(?U)\b[^\W\d_]\w*\b"


def tokens(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id", "lang"), pattern: str = TOKEN) -> DataFrame:
    """(keep.., pos from 0, token, lemma), in the default tokeniser, whose lemma is the lower-cased token.

    The outer form, with a filter behind it, keeps the optimiser from adding a filter before it that tokenises each text once more."""
    found = F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))
    rows = docs.select(*keep, F.posexplode_outer(found).alias("pos", "token")).where("pos is not null")
    return rows.withColumn("lemma", F.col("token"))


def adjacent(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id", "lang"), pattern: str = TOKEN) -> DataFrame:
    """(keep.., w1, w2): each token with the one after it, from the text's own array: no shuffle of tokens."""
    found = docs.select(*keep, F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0)).alias("t_"))
    pairs = F.arrays_zip(F.slice("t_", 1, F.greatest(F.size("t_") - 1, F.lit(0))).alias("w1"), F.slice("t_", 2, F.greatest(F.size("t_") - 1, F.lit(0))).alias("w2"))
    return found.select(*keep, F.inline_outer(pairs)).where("w1 is not null")


def filter_tokens(rows: DataFrame, stopwords: DataFrame | None = None, excluded_tags: Sequence[str] = (), least: int = 2) -> DataFrame:
    """Tags first, then lower case, length and stopwords (a table with a column lemma; a small dimension)."""
    if excluded_tags:
        rows = rows.where(~F.col("tag").isin(*excluded_tags))
    rows = rows.withColumn("lemma", F.lower("lemma")).where(F.char_length("lemma") >= least)
    return rows if stopwords is None else rows.join(stopwords.select(F.lower("lemma").alias("lemma")).distinct(), "lemma", "left_anti")


def read_stopwords(lines: DataFrame) -> DataFrame:
    """One word a line; blank lines and those that begin with # are left out. `lines`: a text source (value)."""
    word = F.lower(F.trim("value"))
    return lines.select(word.alias("lemma")).where("lemma <> '' and not startswith(lemma, '#')").distinct()


def sources_of(messages: DataFrame, caption: str, dialogue: str, ocr: str, confidence: str | None = None, least: float = 0.0, default_confidence: float = 0.0, keep: Sequence[str] = ()) -> DataFrame:
    """(keep.., source, text) with a row for each non-blank source and one for them combined."""
    spoken = F.trim(F.coalesce(dialogue, F.lit("")))
    if confidence is not None:
        spoken = F.when(F.coalesce(confidence, F.lit(default_confidence)) >= least, spoken).otherwise("")
    parts = {"caption": F.trim(F.coalesce(caption, F.lit(""))), "dialogue": spoken, "ocr": F.trim(F.coalesce(ocr, F.lit("")))}
    whole = F.array_join(F.filter(F.array(*parts.values()), lambda x: x != ""), " ")
    entries = F.array(*(F.struct(F.lit(k).alias("source"), v.alias("text")) for k, v in (parts | {"combined": whole}).items()))
    return messages.select(*keep, F.inline(entries)).where("text <> ''")


def lexical_stats(rows: DataFrame, by: Sequence[str], document: str = "doc_id") -> DataFrame:
    """Messages, tokens, types, ttr (4 decimals), hapax for each group."""
    each = rows.groupBy(*by, "lemma").agg(F.count("*").alias("n"))
    counts = each.groupBy(*by).agg(F.sum("n").alias("tokens"), F.count("*").alias("types"), F.count_if(F.col("n") == 1).alias("hapax"))
    documents = rows.groupBy(*by).agg(F.countDistinct(document).alias("messages"))
    ttr = F.round(F.col("types") / F.col("tokens"), 4)
    return counts.join(documents, list(by)).select(*by, "messages", "tokens", "types", ttr.alias("ttr"), "hapax")


def tf_idf(rows: DataFrame, by: str, top: int = 20, use_idf: bool = True) -> DataFrame:
    """L2: groups are pseudo-documents; smooth idf ln((1+n)/(1+df))+1, L2 norm; the `top` by score, then lemma."""
    tf = rows.groupBy(by, "lemma").agg(F.count("*").alias("tf"))
    groups = tf.select(by).distinct().agg(F.count("*").alias("n"))
    df = tf.groupBy("lemma").agg(F.count("*").alias("df"))
    idf = F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1 if use_idf else F.lit(1.0)
    raw = tf.join(df, "lemma").crossJoin(F.broadcast(groups)).withColumn("raw", F.col("tf") * idf)  # one row
    norm = raw.groupBy(by).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    scored = raw.join(F.broadcast(norm), by).select(by, "lemma", "tf", F.round(F.col("raw") / F.col("norm"), 6).alias("score"))
    return top_n(scored.where("score > 0"), [by], [F.desc("score"), F.asc("lemma")], top)


def top_n(rows: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, name: str = "rank") -> DataFrame:
    """The first n rows of each group, without ties; Spark keeps n rows a group before the shuffle."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= n)


def yates(ca: Column, cb: Column, ta: Column, tb: Column) -> Column:
    """Chi-square of [[ca, cb], [ta - ca, tb - cb]] with Yates' correction; null where an expected cell is zero."""
    n, r1 = ta + tb, ca + cb
    r2 = n - r1
    delta = F.abs(ca - r1 * ta / n)
    rest = delta - F.least(F.lit(0.5), delta)
    return F.when((r1 > 0) & (r2 > 0) & (ta > 0) & (tb > 0), rest * rest * n * n * n / (r1 * r2 * ta * tb))


def volcano(rows: DataFrame, by: str, least: int = 5) -> DataFrame:
    """L3: for each pair of groups a < b and each lemma that some group has `least` times: counts, log2 fold change, Yates' chi-square."""
    counts = rows.groupBy(by, "lemma").agg(F.count("*").alias("c"))
    totals = counts.groupBy(by).agg(F.sum("c").alias("t"))
    kept = counts.groupBy("lemma").agg(F.max("c").alias("most")).where(F.col("most") >= least).select("lemma")
    some = counts.join(kept, "lemma", "left_semi")
    groups = totals.where(F.col(by).isNotNull()).agg(F.array_sort(F.collect_list(F.struct(F.col(by).alias("g"), "t"))).alias("groups"))  # one row, of labels
    own = some.where(F.col(by).isNotNull()).groupBy("lemma").agg(F.map_from_entries(F.collect_list(F.struct(by, "c"))).alias("own"))
    count = lambda x: F.coalesce(F.try_element_at("own", x["g"]), F.lit(0).cast("long"))
    pair = lambda x, y: F.struct(x["g"].alias("a"), y["g"].alias("b"), x["t"].alias("ta"), y["t"].alias("tb"), count(x).alias("ca"), count(y).alias("cb"))
    pairs = F.flatten(F.transform("groups", lambda x: F.transform(F.filter("groups", lambda y: y["g"] > x["g"]), lambda y: pair(x, y))))
    # a lemma's counts meet in one row, which forms its pairs of groups
    met = own.crossJoin(F.broadcast(groups)).select("lemma", F.inline(pairs)).where("ca + cb > 0")
    fold = F.log2(((F.col("cb") + 0.5) / F.col("tb")) / ((F.col("ca") + 0.5) / F.col("ta")))
    chi = yates(*(F.col(c).cast("double") for c in ("ca", "cb", "ta", "tb")))
    return met.select("a", "b", "lemma", "ca", "cb", F.round(fold, 4).alias("log2fc"), F.round(chi, 4).alias("chi2"))


def followed(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id", "lang"), pattern: str = TOKEN) -> DataFrame:
    """(keep.., lemma, next): each token with the one after it, null after the last, from the text's own array: no shuffle of tokens."""
    found = docs.select(*keep, F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0)).alias("t_"))
    behind = F.slice("t_", 2, F.greatest(F.size("t_") - 1, F.lit(0)))
    return found.select(*keep, F.inline_outer(F.arrays_zip(F.col("t_").alias("lemma"), behind.alias("next")))).where("lemma is not null")


def collocations(rows: DataFrame, by: Sequence[str] = (), least: int = 5, top: int = 200, document: str = "doc_id") -> DataFrame:
    """Adjacent pairs within a document; G2 (3 decimals), PMI (4), the `top` by G2. Pairs of a lemma with itself are left out.
    `rows` are those of `followed`; a token table without `next` (filtered, or a tagger's) gets it from a window over each document. Two scans: lemmas are counted and written once, with the number of pairs
    that each begins, so the totals need no count of pairs, which are counted once and leave the second scan `least` times or more."""
    by = list(by)
    if "next" not in rows.columns:
        rows = rows.withColumn("next", F.lead("lemma").over(Window.partitionBy(*by, document).orderBy("pos")))
    words = durable(rows.groupBy(*by, "lemma").agg(F.count("*").alias("f"), F.count_if(F.col("next") != F.col("lemma")).alias("begun")))
    n_words = words.groupBy(*by).agg(F.sum("f").alias("n_words"))
    n_pairs = words.groupBy(*by).agg(F.sum("begun").alias("n_pairs"))
    counts = rows.where("next <> lemma").groupBy(*by, F.col("lemma").alias("w1"), F.col("next").alias("w2")).agg(F.count("*").alias("n"))
    kept = counts.where(F.col("n") >= least)
    first = words.select(*by, F.col("lemma").alias("w1"), F.col("f").alias("f1"))
    second = words.select(*by, F.col("lemma").alias("w2"), F.col("f").alias("f2"))
    met = kept.join(first, [*by, "w1"]).join(second, [*by, "w2"])
    met = met.join(F.broadcast(n_words), by).join(F.broadcast(n_pairs), by) if by else met.crossJoin(F.broadcast(n_words)).crossJoin(F.broadcast(n_pairs))
    o11, c1, c2, n = (F.col(c).cast("double") for c in ("n", "f1", "f2", "n_pairs"))
    o12, o21 = c1 - o11, c2 - o11
    o22 = n - o11 - o12 - o21
    r1, r2, k1, k2 = o11 + o12, o21 + o22, o11 + o21, o12 + o22
    cells = [(o11, r1 * k1 / n), (o12, r1 * k2 / n), (o21, r2 * k1 / n), (o22, r2 * k2 / n)]
    parts = [F.when((o > 0) & (e > 0), o * F.log(o / e)).otherwise(0.0) for o, e in cells]
    pmi = F.log2((o11 / n) / ((c1 / F.col("n_words")) * (c2 / F.col("n_words"))))
    scored = met.where((o12 >= 0) & (o21 >= 0) & (o22 >= 0)).select(*by, "w1", "w2", F.col("n").alias("count"), F.col("f1").alias("freq_w1"), F.col("f2").alias("freq_w2"), F.round(2 * sum(parts[1:], parts[0]), 3).alias("g2"), F.round(pmi, 4).alias("pmi"))
    order = [F.desc("g2"), F.asc("w1"), F.asc("w2")]
    return top_n(scored, by, order, top) if by else scored.orderBy(*order).limit(top)


def window_pairs(rows: DataFrame, vocabulary: DataFrame, window: int, by: Sequence[str] = (), document: str = "doc_id") -> DataFrame:
    """(by.., document, a, b), a < b, for each pair of vocabulary lemmas at most `window` tokens apart, once a document.

    The pairs are made in the document's own array of tokens: one aggregation by document, no self-join. `vocabulary` (lemma) is a
    top-N list. Positions count all tokens, so what is not in the vocabulary keeps its place.
    """
    by = list(by)
    marked = rows.join(F.broadcast(vocabulary.select(*(c for c in by if c in vocabulary.columns), "lemma").distinct()), [*(c for c in by if c in vocabulary.columns), "lemma"])
    lists = marked.groupBy(*by, document).agg(F.sort_array(F.collect_list(F.struct("pos", "lemma"))).alias("t"))
    t = F.col("t")

    def near(x, i):
        # kept tokens are in order of position: at most `window` of the following ones can be near
        behind = F.filter(F.slice(t, i + 2, window), lambda y: (y["pos"] - x["pos"] <= window) & (y["lemma"] != x["lemma"]))
        return F.transform(behind, lambda y: F.concat_ws(BETWEEN, F.least(x["lemma"], y["lemma"]), F.greatest(x["lemma"], y["lemma"])))

    # as strings, of which the distinct ones are found by hashing; structs would be compared one by one
    each = lists.select(*by, document, F.explode_outer(F.array_distinct(F.flatten(F.transform(t, near)))).alias("pair_")).where("pair_ is not null")
    return each.select(*by, document, *(F.substring_index("pair_", BETWEEN, i).alias(c) for c, i in (("a", 1), ("b", -1))))


def document_pairs(docs: DataFrame, vocabulary: DataFrame, window: int, by: Sequence[str] = (), text: str = "text") -> DataFrame:
    """J13 with counts: (by.., a, b, count), a < b: in how many documents (rows of `docs`) two lemmas of the group's `vocabulary` (by.., lemma: a top-N list) are at most `window` tokens
    apart. Each document's pairs come from its own array, whose tokens aren't shuffled: what is, is a row for each pair of lemmas and batch."""
    by = list(by)
    own: dict[tuple, list[str]] = {}
    for *group, lemma in vocabulary.select(*by, "lemma").distinct().collect():  # `top` rows a group
        own.setdefault(tuple(group), []).append(lemma)
    shared = docs.sparkSession.sparkContext.broadcast((sorted({x for some in own.values() for x in some}), own))  # in code-point order
    found = docs.select(*by, F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)).alias("t_"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, own = shared.value
        n, known = len(names), pa.array(names, pa.string())
        place = {x: i for i, x in enumerate(names)}
        for batch in batches:
            groups: dict[tuple, int] = {}
            columns = [batch.column(i).to_pylist() for i in range(len(by))]
            group = np.array([groups.setdefault(k, len(groups)) for k in (zip(*columns) if by else [()] * batch.num_rows)], dtype=np.int64)
            wanted = np.zeros((len(groups), n + 1), dtype=bool)
            for k, i in groups.items():
                wanted[i, [place[x] for x in own.get(k, [])]] = True
            lists = batch.column(len(by))
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            document = np.repeat(np.arange(batch.num_rows), sizes)
            code = pc.fill_null(pc.index_in(lists.flatten(), value_set=known), n).to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.flatnonzero(wanted[group[document], code])  # a group's lemmas alone, at their places among all tokens
            document, code = document[at], code[at]
            pairs = []
            for step in range(1, window + 1):
                x, y, d = code[:-step], code[step:], document[:-step]
                near = (d == document[step:]) & (at[step:] - at[:-step] <= window) & (x != y)
                pairs.append((d[near] * n + np.minimum(x, y)[near]) * n + np.maximum(x, y)[near])
            once = np.unique(np.concatenate(pairs))  # once a document
            key, count = np.unique(group[once // (n * n)] * (n * n) + once % (n * n), return_counts=True) if len(once) else (once, once)
            first = np.unique(group, return_index=True)[1][key // (n * n)] if len(once) else once
            taken = [batch.column(i).take(pa.array(first)) for i in range(len(by))]
            yield pa.RecordBatch.from_arrays([*taken, known.take(pa.array(key % (n * n) // n)), known.take(pa.array(key % n)), pa.array(count.astype(np.int64))], [*by, "a", "b", "n"])

    kinds = {f.name: f.dataType.simpleString() for f in found.schema.fields}
    each = found.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "a string, b string, n long"]))
    return each.groupBy(*by, "a", "b").agg(F.sum("n").alias("count"))


def cooccurrence(docs: DataFrame, window: int = 5, top: int = 200, least: int = 3, threshold: float = 2.0, by: Sequence[str] = (), document: str = "doc_id", text: str = "text") -> DataFrame:
    """PMI edges (by.., a, b, count, pmi) among the `top` lemmas of each group of `docs`; counts are of documents. A document is a row. Two scans: the first counts tokens and the documents that hold them, and those
    that hold any, in one aggregation (a document's sorted tokens tell which is the first of its kind, and of all), the second counts pairs."""
    by = list(by)
    found = docs.select(*by, document, F.sort_array(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))).alias("t_"))
    once = F.transform("t_", lambda x, i: F.struct(x.alias("lemma"), (i == 0) | (x != F.get("t_", i - 1)), i == 0))
    each = found.select(*by, F.inline_outer(once)).toDF(*by, "lemma", "new_", "first_").where("lemma is not null")
    counts = durable(each.groupBy(*by, "lemma").agg(F.count("*").alias("f"), F.count_if("new_").alias("df"), F.count_if("first_").alias("begun")))
    order = [F.desc("f"), F.asc("lemma")]
    vocabulary = durable((top_n(counts, by, order, top) if by else counts.orderBy(*order).limit(top)).select(*by, "lemma", "df"))  # `top` rows a group
    pairs = document_pairs(docs, vocabulary, window, by, text).where(F.col("count") >= least)
    n = counts.groupBy(*by).agg(F.sum("begun").alias("n"))
    da = vocabulary.select(*by, F.col("lemma").alias("a"), F.col("df").alias("da"))
    db = vocabulary.select(*by, F.col("lemma").alias("b"), F.col("df").alias("db"))
    met = pairs.join(da, [*by, "a"]).join(db, [*by, "b"])
    met = met.join(n, by) if by else met.crossJoin(F.broadcast(n))
    pmi = F.round(F.log2(F.col("count") * F.col("n") / (F.col("da") * F.col("db"))), 4)
    # of a bounded vocabulary: written, since networks and matrices read their edges more than once
    return durable(met.select(*by, "a", "b", "count", pmi.alias("pmi")).where(F.col("pmi") >= threshold))


def symmetric(edges: DataFrame) -> DataFrame:
    """The co-occurrence matrix in long form, both triangles."""
    turned = edges.withColumnsRenamed({"a": "b_", "b": "a_"}).withColumnsRenamed({"a_": "a", "b_": "b"})
    return edges.unionByName(turned)


def top_lemmas(rows: DataFrame, source: str, top: int) -> DataFrame:
    counts = rows.groupBy(source, "lemma").agg(F.count("*").alias("f"))
    return top_n(counts, [source], [F.desc("f"), F.asc("lemma")], top)


def divergence(rows: DataFrame, source: str, one: str, other: str, tops: Sequence[int] = (20, 50, 100, 200)) -> DataFrame:
    """Jaccard, Dice and overlap of two sources' top-N lemmas for each N. All zero where a set is empty."""
    ranked = top_lemmas(rows, source, max(tops))
    sizes = rows.sparkSession.createDataFrame([(n,) for n in tops], "top_n int")
    each = ranked.join(F.broadcast(sizes), F.col("rank") <= F.col("top_n"))
    flags = each.groupBy("top_n", "lemma").agg(*(F.max(F.when(F.col(source) == s, 1).otherwise(0)).alias(c) for s, c in ((one, "x"), (other, "y"))))
    sums = flags.groupBy("top_n").agg(F.sum("x").alias("a"), F.sum("y").alias("b"), F.sum(F.col("x") * F.col("y")).alias("i"))
    share = lambda up, down: F.round(F.when(down > 0, up / down).otherwise(0.0), 4)
    a, b, i = F.col("a"), F.col("b"), F.col("i")
    return sums.select("top_n", share(i, a + b - i).alias("jaccard"), share(2 * i, a + b).alias("dice"), share(i, F.least(a, b)).alias("overlap"), i.alias("n_shared"))


def only_in(rows: DataFrame, source: str, one: str, other: str, top: int = 50) -> DataFrame:
    """U4: lemmas of one source's top list that the other's lacks, in order, ranks counted anew."""
    ranked = top_lemmas(rows, source, top)
    mine, yours = ranked.where(F.col(source) == one), ranked.where(F.col(source) == other)
    rest = mine.join(F.broadcast(yours.select("lemma")), "lemma", "left_anti")
    return rest.select("lemma", F.row_number().over(Window.partitionBy(source).orderBy("rank")).alias("rank"))


def shared_chi2(rows: DataFrame, source: str, one: str, other: str, top: int = 50) -> DataFrame:
    """Chi-square of the two sources by the lemmas that both top lists hold (2 x k), and its degrees of freedom."""
    ranked = top_lemmas(rows.where(F.col(source).isin(one, other)), source, top)
    shared = ranked.groupBy("lemma").agg(F.count("*").alias("k")).where("k = 2").select("lemma")
    cells = ranked.join(shared, "lemma", "left_semi")
    from tessera.operators.statistics import chi_square

    return chi_square(cells.select(F.col(source).alias("row"), F.col("lemma").alias("col"), F.col("f").cast("double").alias("o")))


def document_terms(rows: DataFrame, top: int = 500, least_tokens: int = 5, document: str = "doc_id") -> DataFrame:
    """The document-term matrix in sparse long form: the `top` lemmas, documents with at least `least_tokens` tokens."""
    freq = rows.groupBy("lemma").agg(F.count("*").alias("f")).orderBy(F.desc("f"), "lemma").limit(top)
    kept = rows.join(F.broadcast(freq.select("lemma")), "lemma", "left_semi").groupBy(document, "lemma").agg(F.count("*").alias("n"))
    sizes = rows.groupBy(document).agg(F.count("*").alias("size")).where(F.col("size") >= least_tokens).select(document)
    return kept.join(sizes, document, "left_semi")


def tf_idf_vectors(rows: DataFrame, top: int = 500, least_tokens: int = 5, document: str = "doc_id") -> DataFrame:
    """(document, vector array<double>): TF-IDF over the `top` lemmas in the order of their names, smooth idf, L2 norm. Documents without any of them
    are left out."""
    counts = document_terms(rows, top, least_tokens, document)
    total = counts.agg(F.countDistinct(document)).first()[0]
    idf = {r["lemma"]: math.log((1 + total) / (1 + r["df"])) + 1 for r in counts.groupBy("lemma").agg(F.count("*").alias("df")).collect()}  # at most `top` rows
    names = sorted(idf)
    if not names:
        return counts.select(document, F.array().cast("array<double>").alias("vector")).limit(0)
    own = counts.groupBy(document).agg(F.collect_list("lemma").alias("lemmas"), F.collect_list(F.col("n").cast("double")).alias("ns"))
    kind = counts.schema[document].dataType.simpleString()

    # as column expressions the norm would be found anew for each of a vector's numbers, from as many searches of a map
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, known = np.array([idf[x] for x in names]), pa.array(names)
        for batch in batches:
            raw = np.zeros((batch.num_rows, len(names)))
            row = np.repeat(np.arange(batch.num_rows), np.diff(batch.column(1).offsets.to_numpy()))
            raw[row, pc.index_in(batch.column(1).flatten().cast(pa.string()), known).to_numpy()] = batch.column(2).flatten().to_numpy()
            raw *= weights
            norm = np.sqrt(np.add.accumulate(raw * raw, axis=1)[:, -1])
            kept = norm > 0
            offsets = pa.array(np.arange(kept.sum() + 1, dtype=np.int32) * len(names))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(kept)), pa.ListArray.from_arrays(offsets, pa.array((raw[kept] / norm[kept][:, None]).ravel()))], [document, "vector"])

    return own.mapInArrow(run, f"`{document}` {kind}, vector array<double>")


def evolution(nodes: DataFrame, phases: Sequence[str], measures: Sequence[str] = ("freq", "degree", "betweenness"), order: str = "betweenness") -> DataFrame:
    """One row a lemma, a column for each phase and measure (0 where absent), by the greatest `order`."""
    columns = [F.coalesce(F.max(F.when(F.col("phase") == p, F.col(m))), F.lit(0)).alias(f"{p}_{m}") for p in phases for m in measures]
    wide = nodes.groupBy("lemma").agg(*columns)
    most = F.greatest(*(F.col(f"{p}_{order}") for p in phases)) if len(phases) > 1 else F.col(f"{phases[0]}_{order}")
    return wide.orderBy(most.desc(), "lemma")


def period_ratio(rows: DataFrame, period: str, source: str, one: str, other: str) -> DataFrame:
    """Tokens of two sources a period, their ratio (null without the other) and the first's share."""
    a = F.count_if(F.col(source) == one)
    b = F.count_if(F.col(source) == other)
    sums = rows.where(F.col(source).isin(one, other)).groupBy(period).agg(a.alias("n_one"), b.alias("n_other"))
    ratio = F.when(F.col("n_other") > 0, F.round(F.col("n_one") / F.col("n_other"), 4))
    return sums.select(period, "n_one", "n_other", ratio.alias("ratio"), F.round(100 * F.col("n_one") / (F.col("n_one") + F.col("n_other")), 4).alias("share"))
