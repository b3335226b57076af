"""Secret scan over a trigram inverted index, in DataFrame operations only.

Every rule is a regular expression. `trigram_query` parses it and derives a Boolean trigram query: an OR
of clauses, each an AND of trigrams that any match must contain. `posting_rows` builds the inverted
index (trigram -> doc_id) over the trigrams that some clause asks for, in one pass over a text; `candidates` intersects postings by
counting, per document and clause, how many of the clause's trigrams were found; only candidates meet the
rule's regex. A rule without mandatory trigrams (plain character runs) scans every text.

Candidates' ids go back to the texts by a bitmap of bounded size (`common.marked`): only texts that it marks are shuffled and joined with what they
are candidates for, the others are read where they are. A bit that two ids share costs a shuffle of a text, and no result.

Edge cases: very long texts are scanned whole; the work is in proportion to the text and its matches. a null text is an empty text and has no spans. Rows with a null doc_id cannot be posted; they are
scanned for every rule. Rows that repeat a doc_id share postings (a superset), and each is verified on its own text.
An empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import re._constants as K
import re._parser as parser
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import durable, marked

MAX_ALTERNATIVES = 512
#: Fixed value: the space and the letters from the commonest to the rarest in English; other characters count as rarer still.
COMMON = " etaoinshrdlcumwfgypbvkjxqz"
#: Matches whose positions are added up together.
BLOCK = 512
SPAN = "struct<start:int,ord:int,end:int,value:int>"


@dataclass(frozen=True)
class Rule:
    """kind: its name in spans. pattern: for the engine's regex. least: minimal length of `group` in a match."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The base rules of the contract. Greedy runs that are too short are dropped, not retried. For the
#: rules made of one run only, the minimum stands in the pattern, which gives the same matches.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Further public credential formats that the method adds.
EXTRA = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)


def _alternatives(tokens) -> list[tuple[str | None, ...]]:
    """The regex as alternatives of literal characters and None, which stands for anything."""
    found: list[tuple[str | None, ...]] = [()]
    for op, arg in tokens:
        if op is K.LITERAL:
            more = [(chr(arg),)]
        elif op is K.SUBPATTERN:
            more = _alternatives(arg[-1])
        elif op is K.BRANCH:
            more = [x for branch in arg[1] for x in _alternatives(branch)]
        elif op is K.IN and all(o is K.LITERAL for o, _ in arg) and len(arg) <= 8:
            more = [(chr(a),) for _, a in arg]
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT) and tuple(arg[:2]) == (0, 1):
            more = [(), *_alternatives(arg[2])]
        elif op is K.AT:
            more = [()]
        else:
            more = [(None,)]
        found = [a + b for a in found for b in more]
        if len(found) > MAX_ALTERNATIVES:
            return [(None,)]
    return found


def _rarity(gram: str) -> tuple[int, str]:
    return -sum(COMMON.find(c) if c in COMMON else len(COMMON) for c in gram), gram


def trigram_query(pattern: str, most: int = 3) -> list[tuple[str, ...]] | None:
    """Clauses (OR) of case-folded trigrams (AND), one of which each match satisfies; None: no such trigrams. Of an alternative's mandatory trigrams
    the `most` rarest are asked for: common ones cost postings and rule out little."""
    clauses: set[tuple[str, ...]] = set()
    for alternative in _alternatives(parser.parse(pattern)):
        runs = "".join("\0" if c is None else c for c in alternative).lower().split("\0")
        grams = {run[i : i + 3] for run in runs for i in range(len(run) - 2)}
        if not grams:
            return None
        clauses.add(tuple(sorted(grams)))
    least = [c for c in clauses if not any(set(d) < set(c) for d in clauses)]
    return sorted({tuple(sorted(sorted(c, key=_rarity)[:most])) for c in least})


def _any_of(trigrams: Sequence[str]) -> str:
    """A pattern that finds each of the trigrams wherever it begins, also where they overlap: branches by the first and second character."""
    tree: dict[str, dict[str, list[str]]] = {}
    for a, b, c in sorted(set(trigrams)):
        tree.setdefault(a, {}).setdefault(b, []).append(c)
    code = lambda chars: "".join(f"\\x{{{ord(c):x}}}" for c in chars)
    any_ = lambda chars: code(chars) if len(chars) == 1 else f"[{code(chars)}]"
    branches = "|".join(any_(a) + "(?:" + "|".join(any_(b) + any_(cs) for b, cs in own.items()) + ")" for a, own in tree.items())
    return f"(?={any_(tree)})(?=({branches}))"


def posting_rows(docs: DataFrame, trigrams: Sequence[str]) -> DataFrame:
    """(trigram, doc_id): the inverted index, for the trigrams that queries may ask for."""
    here = F.array_distinct(F.regexp_extract_all("folded", F.lit(_any_of(trigrams)), F.lit(1)))
    rows = docs.where("doc_id is not null").select("doc_id", F.lower("text").alias("folded"))
    return rows.select("doc_id", F.explode(here).alias("trigram")).distinct()


def candidates(postings: DataFrame, queries: dict[str, list[tuple[str, ...]]]) -> DataFrame:
    """(doc_id, kinds): documents whose postings satisfy a clause of a rule's query. `queries` is the rule set, which is small."""
    asked = [(kind, n, len(clause), t) for kind, clauses in queries.items() for n, clause in enumerate(clauses) for t in clause]
    terms = postings.sparkSession.createDataFrame(asked, "kind string, clause int, needs int, trigram string")
    met = postings.join(F.broadcast(terms), "trigram").groupBy("doc_id", "kind", "clause", "needs").agg(F.count("*").alias("has"))
    return met.where("has = needs").groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))


def _once(value: Column, of: Callable[[Column], Column]) -> Column:
    """`of` of the value, which is worked out once, however often and in whatever lambda it is used."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start,order,end>> of the rule's matches, in code points. The gaps between matches give the positions."""
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    gaps = F.transform(F.split(text, rule.pattern, -1), F.char_length)
    value = lambda m: F.char_length(F.regexp_extract(m, rule.pattern, rule.group))

    def step(own: Column, x: Column) -> Column:
        begin = own["at"] + x["gap"]
        end = begin + F.char_length(x["m"])
        span = F.struct(begin.alias("start"), F.lit(order).alias("ord"), end.alias("end"), value(x["m"]).alias("value"))
        return F.struct(end.alias("at"), F.concat(own["out"], F.array(span)).alias("out"))

    def block(acc: Column, part: Column) -> Column:
        start = F.struct(acc["at"].alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
        return _once(F.aggregate(part, start, step), lambda done: F.struct(done["at"].alias("at"), F.concat(acc["out"], F.array(done["out"])).alias("out")))

    # the last match's end is a running sum, kept in blocks: a step appends to its block, and a block to those before it
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{SPAN}>>").alias("out"))
    of_parts = lambda x, n: F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda i: F.slice(x, i * BLOCK + 1, BLOCK))
    spans = lambda x: F.flatten(F.aggregate(of_parts(x, F.size(x)), zero, block, lambda acc: acc["out"]))
    zipped = lambda x: F.arrays_zip(F.slice(x["gaps"], 1, F.size(x["matches"])).alias("gap"), x["matches"].alias("m"))
    none = F.array().cast(f"array<{SPAN}>")
    some = lambda x: F.when(F.size(x["matches"]) == 0, none).otherwise(_once(zipped(x), spans))
    return F.filter(_once(F.struct(matches.alias("matches"), gaps.alias("gaps")), some), lambda s: s["value"] >= rule.least)


def secret_scan(docs: DataFrame, rules: Sequence[Rule] = BASE + EXTRA) -> DataFrame:
    """One row per row of `docs` (doc_id, text): (doc_id, text, spans), spans being an array of
    struct<start:int, ord:int, end:int, value:int> by start, then by the rules' order. `ord` is the rule's place in `rules`."""
    asked = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not None}
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    none = F.array().cast(f"array<{SPAN}>")

    def spans(rows: DataFrame) -> DataFrame:
        found = []
        for order, rule in enumerate(rules):
            own = spans_of(F.col("text"), rule, order)
            if rule.kind in asked:
                meets = F.col("doc_id").isNull() | F.coalesce(F.array_contains("kinds", rule.kind), F.lit(False))
            else:  # a full scan, which needs no spans where the text has no match at all
                meets = F.col("text").rlike(rule.pattern)
            found.append(F.when(meets, own).otherwise(none))
        return rows.select("doc_id", "text", F.array_sort(F.concat(*found)).alias("spans"))

    no_kinds = F.array().cast("array<string>").alias("kinds")
    if not asked:
        return spans(rows.select("*", no_kinds))
    trigrams = sorted({t for clauses in asked.values() for clause in clauses for t in clause})
    kinds = durable(candidates(posting_rows(rows, trigrams), asked))
    at = marked(rows, kinds, ["doc_id"], "mark_")
    some = at.where("mark_").join(kinds, "doc_id", "left").select("doc_id", "text", "kinds")
    return spans(some).unionByName(spans(at.where("not mark_").select("doc_id", "text", no_kinds)))


def digest(found: DataFrame, rules: Sequence[Rule] = BASE + EXTRA, base: int = len(BASE)) -> DataFrame:
    """The contract's columns from `secret_scan`'s rows: counts of the base kinds, hash of the base spans, all spans as text."""
    names = F.array(*(F.lit(r.kind) for r in rules))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["ord"]), s["start"], s["end"])), ",")
    count = lambda n: F.size(F.filter("spans", lambda s: s["ord"] == n)).cast("long")
    return found.select(
        "doc_id",
        *(count(n).alias(f"n_{r.kind}") for n, r in enumerate(rules[:base])),
        F.sha2(joined(F.filter("spans", lambda s: s["ord"] < base)).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
