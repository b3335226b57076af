"""Near-duplicate lines over all documents by a deletion-neighbourhood join, in DataFrame operations only.

Two lines are alike if at most one character is inserted, deleted or replaced. Equal lines come together first.
Of two lines at distance one, equal lengths share the text left when the same position is deleted from both, and of unequal
lengths the shorter is the longer with one deleted: so hashed deletion variants that are equal give all links. A key
that holds a position makes its group a star around its earliest line, never pairs of all with all.

A line of n characters has n variants of n characters, so only what can have a partner emits them, and near the
edit only. One edit leaves either the first or the last part of a line as it was (`_halves`): lines whose parts
nobody else has are done. What is left is cut into pieces (31 at most), of which one edit touches one: lines that share all but
that piece with another line (`_cut`) go on with the piece alone. Pieces above PIECE characters are cut again, so that the work is in
proportion to the line's length, and those up to PIECE emit their deletions, as hashes of what is left of the piece together with the rest.
Links are verified on the lines: equal around the piece, and the pieces by Levenshtein distance. The cuts depend on lengths alone, so that lines whose lengths differ by one
agree on them (a line emits the cuts of both lengths where they differ).

The texts of lines that may have a partner come from a scan of the documents that a bitmap of their hashed places filters before the shuffle
(`common.may_hold`). The bitmap's size is bounded; what it lets through wrongly goes with the join.

A line goes if an alike line occurs earlier, by (doc_id, text hash, line number); of equal lines the first stays.

Edge cases: a null text stays null with no lines. Blank lines (white space only) always stay. Rows that repeat doc_id
and text are one document: each gets the same result. Null ids come last. An empty table gives an empty result. Very long texts and lines are
compared whole. Other columns are kept as they are, also those named n_lines or n_kept: such a count is then not given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import durable, may_hold

PIECES = 16
#: Pieces of more characters are cut again. At least 16: shorter ones are not cut any further.
PIECE = 64
LAST = 2**63 - 1


def _keyed(docs: DataFrame) -> DataFrame:
    """The document's place: null ids last, then the text's hash."""
    return docs.withColumns({"__doc": F.coalesce("doc_id", F.lit(LAST)), "__text": F.xxhash64(F.lit(3), "text")})


def occurrences(docs: DataFrame) -> DataFrame:
    """Each line that is not blank: its place (__doc, __text, line_), its hashes (h1, h2) and the line."""
    lines = _keyed(docs.where("text is not null")).select("__doc", "__text", F.posexplode(F.split("text", "\n", -1)).alias("line_", "line"))
    hashes = {"h1": F.xxhash64(F.lit(1), "line"), "h2": F.xxhash64(F.lit(2), "line")}
    return lines.where("line rlike '[^\\\\s]'").withColumns(hashes)


def _halves(line: Column, n: Column) -> Column:
    """Hashes of which two lines at distance one share at least one. Lines below 31 characters have none: they need no filter.

    One edit is behind the head or before the tail. Both lengths are multiples of 8, the same for most neighbouring n; where they
    are not, the longer line emits the cuts of the shorter too.
    """

    def cut(m):
        head = (F.floor(m / 16) * 8).cast("int")
        tail = (F.floor((m - head) / 8) * 8).cast("int")
        return F.array(F.xxhash64(F.lit(5), head, F.left(line, head)), F.xxhash64(F.lit(6), tail, F.right(line, tail)))

    both = F.when(n % 8 == 0, F.array_distinct(F.concat(cut(n), cut(n - 1)))).otherwise(cut(n))
    return F.when(n >= 31, both).otherwise(F.array().cast("array<bigint>"))


def distinct_lines(found: DataFrame) -> DataFrame:
    """A row for each distinct line: h1, h2, its first place, its length, its halves and its number of occurrences."""
    n = F.char_length("line")
    rows = found.select("h1", "h2", F.struct("__doc", "__text", "line_", n.alias("n"), _halves(F.col("line"), n).alias("halves")).alias("first"))
    return rows.groupBy("h1", "h2").agg(F.min("first").alias("first"), F.count("*").alias("times")).select("h1", "h2", "first.*", "times")


def _step(n: Column) -> Column:
    """Length of a piece, a multiple of 8; the last piece has the rest too. Long lines have PIECES of them or up to twice as many."""
    return F.greatest(F.lit(8), F.floor(n / (8 * PIECES)) * 8).cast("int")


def _cut(texts: DataFrame) -> DataFrame:
    """Each text's pieces. `texts`: h1, h2, place, n, m (the length that the cuts go by: n or n - 1), before and after (characters
    around the text in its line), f1, f2 (their hashes), text. The same columns come out, of the piece, for each piece.

    A pair of lengths k and k + 1 meets under m = k; a pair of equal lengths under its own. The longer one's piece has one character more.
    """
    n, m, g = F.col("n"), F.col("m"), F.col("g")
    step = _step(m)
    count = F.greatest(F.lit(1), F.floor(m / step)).cast("int")
    rows = texts.select("*", F.explode(F.sequence(F.lit(0), (count - 1).cast("int"))).alias("g"))
    at = (g * step).cast("int")
    # what is behind the piece, counted from the end: it does not move with the edit
    behind = F.when(g == count - 1, F.lit(0)).otherwise((m - at - step).cast("int"))
    rows = rows.withColumns({"at": at, "behind": behind})
    head, tail = F.left(F.col("text"), F.col("at")), F.right(F.col("text"), F.col("behind"))
    frame = lambda seed, f: F.xxhash64(F.lit(seed), f, m, g, F.xxhash64(head), F.lit(seed), tail).alias(f)
    size = lambda x: (x - F.col("at") - F.col("behind")).cast("int")
    piece = F.substr(F.col("text"), F.col("at") + 1, size(n))
    return rows.select("h1", "h2", *PLACE, size(n).alias("n"), size(m).alias("m"), (F.col("before") + F.col("at")).alias("before"), (F.col("after") + F.col("behind")).alias("after"), frame(11, "f1"), frame(12, "f2"), piece.alias("text"))


def _shared(keys: DataFrame, by: list[str]) -> DataFrame:
    """The keys that at least two distinct lines have."""
    found = keys.groupBy(*by).agg(F.min("h1").alias("low"), F.max("h1").alias("high"))
    return found.where("low <> high").select(*by)


PLACE = ["__doc", "__text", "line_"]


def pieces_of(lines: DataFrame) -> DataFrame:
    """The pieces of up to PIECE characters that lines (h1, h2, place, line) may differ in, in the columns of `_cut`."""
    n = F.char_length("line")
    start = [F.lit(0).cast(kind).alias(c) for c, kind in (("before", "int"), ("after", "int"), ("f1", "long"), ("f2", "long"))]
    texts = lines.select("h1", "h2", *PLACE, n.alias("n"), F.explode(F.filter(F.array(n, n - 1), lambda x: x > 0)).alias("m"), *start, F.col("line").alias("text"))
    done = []
    while True:  # a sixteenth of the length goes on each time
        cut = _cut(texts)
        kept = durable(cut.join(_shared(cut, ["f1", "f2"]), ["f1", "f2"], "left_semi"))
        done.append(kept.where(F.col("m") <= PIECE))
        texts = kept.where(F.col("m") > PIECE)
        if texts.isEmpty():
            break
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return found


def links(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """Links between distinct lines at distance one that leave a line with an earlier one: (h1, h2) of the later line of each.

    `lines` are the distinct lines (checkpointed). A group of lines that delete the same position to the same text is linked to its
    earliest; the longer lines of a shorter one are linked to that.
    """
    short = lines.where("n < 32").select("h1", "h2", *PLACE)
    halves = lines.where("n >= 31").select("h1", "h2", *PLACE, F.explode("halves").alias("half"))
    long = halves.join(_shared(halves, ["half"]), "half", "left_semi").drop("half").distinct()
    places = durable(short.unionByName(long).distinct())
    # the texts of these lines, each from its first place; rows that repeat a document bring a line again
    key = ["h1", "h2", *PLACE]
    wanted = may_hold(occurrences(docs), places, key).join(places, key)  # inner: the optimizer would do a semi-join before the bitmap
    lines = durable(wanted.select(*key, "line").dropDuplicates(["h1", "h2"]))
    left = pieces_of(lines)
    # the piece without one of its characters, for each of them
    size = F.char_length("text")
    rest = lambda i: F.concat(F.left(F.col("text"), i - 1), F.substr(F.col("text"), i + 1, size))
    both = lambda kind, *what: F.struct(F.xxhash64("f1", F.lit(kind), *what).alias("v1"), F.xxhash64("f2", F.lit(kind + 1), *what).alias("v2"))
    none = F.array().cast("array<struct<v1:bigint,v2:bigint>>")
    each = lambda of: F.when(size > 0, F.transform(F.sequence(F.lit(1), size), of)).otherwise(none)
    me = F.struct(*PLACE, "h1", "h2").alias("me")
    # of equal lengths: the same position deleted leaves the same text
    replaced = left.where("n = m").select(me, "before", "after", F.explode(each(lambda i: both(1, i, rest(i)))).alias("v"), F.lit(True).alias("centre"))
    # of unequal lengths: the longer without one character is the shorter
    longer = left.where("n > m").select(me, "before", "after", F.explode(F.array_distinct(each(lambda i: both(3, rest(i))))).alias("v"), F.lit(False).alias("centre"))
    shorter = left.where("n = m").select(me, "before", "after", both(3, F.col("text")).alias("v"), F.lit(True).alias("centre"))
    variants = replaced.unionByName(longer).unionByName(shorter).select("me", "before", "after", "v.*", "centre")
    stars = variants.groupBy("v1", "v2").agg(F.min(F.when(F.col("centre"), F.col("me"))).alias("hub"), F.min("me").alias("low"), F.max("me").alias("high"))
    stars = stars.where("hub is not null and low <> high").select("v1", "v2", "hub")
    pairs = durable(variants.join(stars, ["v1", "v2"]).where("me <> hub").select("hub", "me", "before", "after").distinct())
    # verify on the texts
    text = lines.select("h1", "h2", "line")
    first = text.select(F.col("h1").alias("hub1"), F.col("h2").alias("hub2"), F.col("line").alias("x"))
    pairs = pairs.select("hub", "me", "before", "after", F.col("me.h1").alias("h1"), F.col("me.h2").alias("h2"), F.col("hub.h1").alias("hub1"), F.col("hub.h2").alias("hub2"))
    around = lambda c: (F.left(c, F.col("before")), F.right(c, F.col("after")))
    inner = lambda c: F.substr(c, F.col("before") + 1, F.char_length(c) - F.col("before") - F.col("after"))
    x, y = F.col("x"), F.col("line")
    same = [a == b for a, b in zip(around(x), around(y))]
    met = pairs.join(text, ["h1", "h2"]).join(first, ["hub1", "hub2"]).where(same[0] & same[1] & (F.levenshtein(inner(x), inner(y), 1) >= 0))
    return met.select(F.greatest("hub", "me").alias("late")).select("late.h1", "late.h2").distinct()


def line_dedup(docs: DataFrame) -> DataFrame:
    """The rows of `docs` (doc_id, text, ..) with lines removed from text, and the columns n_lines and n_kept (long) where the input has none of that name."""
    lines = durable(distinct_lines(occurrences(docs)))
    late = durable(links(docs, lines)).withColumn("late", F.lit(True))
    first = F.struct("__doc", "__text", "line_")
    known = lines.join(late, ["h1", "h2"], "left").where("times > 1 or late").select("h1", "h2", first.alias("first"), F.coalesce("late", F.lit(False)).alias("late"))
    known = durable(known)
    gone = occurrences(docs).select("h1", "h2", "__doc", "__text", "line_").join(known, ["h1", "h2"]).where(F.col("late") | (F.col("first") != first))
    gone = durable(gone.groupBy("__doc", "__text").agg(F.collect_set("line_").alias("__gone")))
    # most documents of a large corpus may lose lines: this side is never broadcast, so that the plan is the same at every size
    rows = _keyed(docs).join(gone, ["__doc", "__text"], "left")
    body, drop = F.col("__body"), F.sort_array("__gone")
    n = F.size(body)
    # the text is what is between the dropped lines: slices, so that the work is in proportion to the lines
    edges = F.concat(F.array(F.lit(-1)), F.col("__drop"), F.array(n))
    between = F.transform(
        F.sequence(F.lit(0), F.size("__drop")),
        lambda j: F.slice(body, F.get(F.col("__edges"), j) + 2, F.get(F.col("__edges"), j + 1) - F.get(F.col("__edges"), j) - 1),
    )
    rows = rows.withColumn("__body", F.split("text", "\n", -1)).withColumn("__drop", drop).withColumn("__edges", edges)
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(between), "\n"))
    total = F.coalesce(F.when(F.col("text").isNull(), 0).otherwise(n), F.lit(0)).cast("long")
    kept = (total - F.coalesce(F.when(F.col("__gone").isNotNull(), F.size("__gone")), F.lit(0))).cast("long")
    counts = [n.alias(name) for name, n in (("n_lines", total), ("n_kept", kept)) if name not in docs.columns]
    return rows.select(*(text.alias(c) if c == "text" else c for c in docs.columns), *counts)
