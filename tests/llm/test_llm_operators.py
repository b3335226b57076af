"""The corpus operators against brute force, round trips and planted cases."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import bottom_k, common, embeddings, hilbert_shards, langid, line_dedup, mixing, pieces, queries, secret_scan, simhash, wordpiece
from tessera.operators import ordering

FOLDER = Path(queries.TOKENIZERS)
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word and more " * 20_000
#: Nulls in any column, empty and long texts, ties, repeated rows.
ODD = [
    (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "   \n\t ", None, None, None), (None, "the cat and the dog", "en", "a", 19), (4, LONG, "en", "b", len(LONG)),
    (5, "die katze und der hund", "de", "b", 22), (5, "die katze und der hund", "de", "b", 22), (6, "die katze und der hund", "de", "c", 22), (7, "the cat and the dog\npassword=abcdefgh", "en", "c", 40), (8, "!!! 123", "en", None, 7),
]
OPERATORS = {
    "secret_scan": lambda d: secret_scan.digest(secret_scan.secret_scan(d)), "hilbert": hilbert_shards.hilbert_shards, "langid": lambda d: langid.identify(d, langid.fit(d)), "bottom_k": bottom_k.fingerprints,
    "line_dedup": line_dedup.line_dedup, "simhash": simhash.near_duplicates, "mixing": mixing.mix, "wordpiece": lambda d: wordpiece.token_counts(d, [b" the", b"the"]), "pieces": lambda d: pieces.encode(d, (FOLDER / "piece_bpe_32k.model").read_bytes()),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_give_a_row_each(name, spark):
    df = spark.createDataFrame(ODD, DOCS)
    assert sorted(str(r.doc_id) for r in OPERATORS[name](df).collect()) == sorted(str(r[0]) for r in ODD)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(name, spark):
    assert OPERATORS[name](spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns(name, spark):
    extra = ["size", "block", "shard", "cell", "fp", "n", "kinds", "spans", "h1", "line", "score", "target", "taken", "component_id", "slot", "curve", "range_", "ids", "state", "place"]
    df = spark.createDataFrame(ODD, DOCS).withColumns({c: F.lit("x") for c in extra})
    assert OPERATORS[name](df).count() == len(ODD)


# --- secret scan -----------------------------------------------------------------------------------------------------------------


def spans(text):
    found = []
    for kind, (name, pattern, ok) in enumerate((
        ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    )):
        found += [(m.start(), kind, f"{name}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text, re.ASCII) if ok(m)]
    return ",".join(x for _, _, x in sorted(found))


def test_secrets_against_brute_force(spark):
    pick = random.Random(3)
    atoms = ["password", "PassWd", "secret", "token", "api_key", "apikey", "=", ":", " ", "  ", '"', "'", "abc", "abcdef", "AKIA", "AKIAAKIA", "X" * 16, "Z9" * 10, "deadbeef" * 3, "é", "😀", "\n", ".", "k", "passpassword", "xoxb-1234567890ab"]
    texts = ["".join(pick.choice(atoms) for _ in range(pick.randint(0, 30))) for _ in range(400)]
    texts += ["password: token = abcdefgh", "token=abc token=abcdef", "AKIA" + "A" * 15, "AKIA" + "A" * 16, "f" * 23, "f" * 24 + "g" + "0" * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secret_scan.digest(secret_scan.secret_scan(df)).collect():
        want = spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), texts[r.doc_id]
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(want.count(k) for k in ("assign", "access", "hex"))


def test_trigram_queries():
    assert secret_scan.trigram_query("AKIA[A-Z]+") == [("aki", "kia")]
    assert secret_scan.trigram_query("the_quiz") == [("_qu", "e_q", "uiz")]
    assert secret_scan.trigram_query("[0-9a-f]{24,}") is None
    assert secret_scan.trigram_query("ab") is None and secret_scan.trigram_query("abc|x") is None
    clauses = secret_scan.trigram_query(secret_scan.BASE[0].pattern)
    for word in ("password", "passwd", "secret", "token", "api_key", "apikey"):
        text = f"{word}=".lower()
        assert any(all(t in text for t in c) for c in clauses)
    assert all(len(t) == 3 for c in clauses for t in c)


def test_a_rule_that_the_index_prunes_finds_the_same(spark):
    df = spark.createDataFrame([(1, "xx ghp_" + "Zz" * 18), (2, "ghp_short"), (3, None), (None, "ghp_" + "Zz" * 20)], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in secret_scan.digest(secret_scan.secret_scan(df)).collect()}
    assert got[1] == "forge:3:43" and got[2] == "" and got[3] == "" and "forge:0:44" in got[None]


def test_a_text_of_many_matches(spark):
    text = " ".join(f"token={'k' * (6 + i % 5)}" for i in range(100_000))
    df = spark.createDataFrame([(1, text), (2, "f" * 30 + " é " + "e" * 40)], "doc_id long, text string")
    got = {r.doc_id: r for r in secret_scan.digest(secret_scan.secret_scan(df)).collect()}
    assert got[1].n_assign == 100_000 and got[1].spans == spans(text) and got[2].spans == "hex:0:30,hex:33:73"


def test_postings_overlap(spark):
    df = spark.createDataFrame([(1, "xABCDe-b]"), (2, "ab"), (3, None), (None, "abc")], "doc_id long, text string")
    rows = secret_scan.posting_rows(df, ["abc", "bcd", "-b]", "zzz", "cde"]).collect()
    assert {tuple(r) for r in rows} == {(1, "abc"), (1, "bcd"), (1, "cde"), (1, "-b]")}


# --- sharding --------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (4, 2), (1, 3)])
def test_hilbert_curve_is_a_walk(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    index = hilbert_shards.hilbert_index(cells, bits)
    assert sorted(index) == list(range(len(cells)))
    path = cells[np.argsort(index)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_shards(law, spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = hilbert_shards.hilbert_shards(docs, 8, law).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(texts)
    by = defaultdict(list)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), law, None)
        by[r.shard].append(r)
    assert set(by) <= set(range(8)) and all(sorted(r.slot for r in own) == list(range(len(own))) for own in by.values())
    if law == "rows":
        assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and len(by) == 8
    else:
        sums = [sum(r["size"] for r in own) for own in by.values()]
        assert max(sums) - min(sums) <= 2 * max(r["size"] for r in rows)
    order = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in order] == sorted(r.curve for r in rows)


def curve_by_hand(cell, bits):
    """Place of a cell on the curve, by going down its orthants: each holds the curve again, turned by an entry corner and a direction (Hamilton's rules)."""
    dims = len(cell)
    turn = lambda x, k: ((x >> k) | (x << (dims - k))) & ((1 << dims) - 1) if k else x
    gray = lambda x: x ^ (x >> 1)
    place = entry = direction = 0
    for level in range(bits - 1, -1, -1):
        corner = sum((c >> level & 1) << d for d, c in enumerate(cell))
        corner = turn(corner ^ entry, (direction + 1) % dims)
        w = corner
        for shift in range(1, dims):
            w ^= corner >> shift
        start = 0 if w == 0 else gray(2 * ((w - 1) // 2))
        entry ^= turn(start, dims - (direction + 1) % dims)
        ones = lambda x: (~x & (x + 1)).bit_length() - 1  # noqa: E731  trailing ones
        direction = (direction + (0 if w == 0 else ones(w - 1) if w % 2 == 0 else ones(w)) % dims + 1) % dims
        place = place << dims | w
    return place


def test_a_curve_by_hand_is_one_too():
    for dims, bits in ((2, 3), (3, 2)):
        cells = sorted(itertools.product(range(1 << bits), repeat=dims), key=lambda c: curve_by_hand(c, bits))
        assert all(sum(abs(x - y) for x, y in zip(a, b)) == 1 for a, b in itertools.pairwise(cells))
        own = hilbert_shards.hilbert_index(np.array(cells), bits)
        # both go through an orthant of any size as a whole, whichever way they turn in it
        for level in range(1, bits):
            runs = lambda order: [len(list(g)) for _, g in itertools.groupby(tuple(x >> level for x in c) for c in order)]
            assert set(runs(cells)) == set(runs([cells[i] for i in np.argsort(own)])) == {1 << dims * level}


def test_shards_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame([(None, None, None, None, None), (-5, "", "en", None, 0)], docs.schema))
    rows = docs.selectExpr("*", "xxhash64(doc_id, crc32(cast(coalesce(text, '') as binary))) as mix").collect()
    size = lambda r: len((r.text or "").encode()) + 1

    def ranks(values):
        """A text's place among all, as one of 15 equal parts; 0 for null."""
        known = sorted(v for v in values if v is not None)
        return {v: 1 + known.index(v) * 15 // len(known) for v in known} | {None: 0}

    cuts = lambda values: [sorted(values)[max(0, -(-len(values) * i // 16) - 1)] for i in range(1, 16)]
    source, lang = ranks([r.source for r in rows]), ranks([r.lang for r in rows])
    ids, sizes = cuts([r.doc_id for r in rows if r.doc_id is not None]), cuts([size(r) for r in rows])
    where = lambda cuts, x: sum(c <= x for c in cuts)
    cell = [(source[r.source], lang[r.lang], where(ids, -(2**63) if r.doc_id is None else r.doc_id), where(sizes, size(r))) for r in rows]
    curve = hilbert_shards.hilbert_index(np.array(cell), 4).tolist()
    crc = [zlib.crc32((r.text or "").encode()) for r in rows]
    order = sorted(range(len(rows)), key=lambda i: (curve[i], crc[i], rows[i].mix, -(2**63) if rows[i].doc_id is None else rows[i].doc_id))
    n = len(rows)
    want = {}
    for at, i in enumerate(order):
        shard = at * 8 // n
        want[rows[i].doc_id] = (shard, at - -(-shard * n // 8), curve[i])
    assert {r.doc_id: (r.shard, r.slot, r.curve) for r in hilbert_shards.hilbert_shards(docs, 8).collect()} == want


def test_range_filters_read_few_shards(spark):
    """Shards whose minima and maxima a range filter can't rule out, for a filter on each dimension: by the curve, and by one column's order."""
    pick = random.Random(16)
    data = [(i, "w" * pick.randint(1, 4000), f"l{pick.randint(0, 9):02d}", f"s{pick.randint(0, 39):02d}", 0) for i in range(6000)]
    rows = hilbert_shards.hilbert_shards(spark.createDataFrame(data, DOCS), 64).collect()
    place = {r.doc_id: r.shard for r in rows}
    by_id = {d[0]: n * 64 // len(data) for n, d in enumerate(data)}
    columns = [lambda d: d[0], lambda d: len(d[1]), lambda d: d[2], lambda d: d[3]]

    def read(shards, of):
        values = sorted(map(of, data))
        low, high = values[len(values) // 10], values[len(values) // 5]
        held = defaultdict(list)
        for d in data:
            held[shards[d[0]]].append(of(d))
        return sum(min(v) <= high and max(v) >= low for v in held.values())

    curve, single = [read(place, of) for of in columns], [read(by_id, of) for of in columns]
    assert single[1:] == [64, 64, 64] and max(curve) <= 48 and sum(curve) < 0.75 * sum(single)


def test_running_sums(spark):
    pick = random.Random(1)
    data = [(i, pick.randint(0, 5)) for i in range(500)]
    got = {r.k: r.upto for r in ordering.running_sum(spark.createDataFrame(data, "k long, w long"), ["k"], "w").collect()}
    assert got == dict(zip(range(500), itertools.accumulate(w for _, w in data)))


# --- language ID -----------------------------------------------------------------------------------------------------------------


def test_languages_held_out(spark, sf_dir):
    rows = queries.op3_language_id(spark, sf_dir).collect()
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 20 and sum(r.lang_pred == langs[r.doc_id] for r in held) / len(held) > 0.95


def test_words_first_then_ngrams():
    entries = [("en", "w", "the", 10), ("de", "w", "der", 10), ("en", "3", "^th", 5), ("de", "3", "sch", 9), ("de", "1", "s", 3), ("en", "1", "t", 3)]
    model = langid.Model(["en", "de"], entries)
    assert model.predict("the")[0] == "en" and model.predict("Schiff")[0] == "de" and model.predict("theta")[0] == "en"
    assert model.predict("...")[0] == "und" and model.predict(None) == ("und", 0.0)
    assert list(model.score("thx")) == list(model.grams["^th"])


def test_a_language_with_few_documents_keeps_its_words(spark):
    pick = random.Random(4)
    words = lambda n: ["".join(pick.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(n)]
    common_, twice, once = words(125_000), words(200), words(200)
    docs = [(1, " ".join(common_ * 2), "en"), (2, " ".join(twice * 2), "xx"), (3, " ".join(once), "yy")]
    model = langid.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    assert [model.predict(" ".join(x[:50]))[0] for x in (common_, twice, once)] == ["en", "xx", "yy"]
    assert (model.words.find(sorted({*common_, *twice, *once})) >= 0).all()  # a word seen once is known


def test_letters_of_any_script():
    model = langid.Model(["en", "hi"], [("en", "w", "the", 10), ("hi", "w", "हिन्दी", 10), ("en", "1", "t", 3)])
    assert all(model.predict(x) == ("und", 0.0) for x in ("½ ²", "①", "Ⅷ", "12 34", "\u0301", ""))
    assert langid.words_of("हिन्दी x\u0301y Don't") == ["हिन्दी", "x\u0301y", "don", "t"] and model.predict("हिन्दी")[0] == "hi"


def score_plainly(rows, text):
    """The model of all `rows` (text, lang), word by word and n-gram by n-gram."""
    langs = sorted({lang for _, lang in rows})
    counts = {(kind, lang): Counter() for kind in langid.KINDS for lang in langs}
    letters = lambda t: re.findall(r"[^\W\d_]+", t.lower())  # noqa: E731  the texts have no marks or numerals
    ends = lambda w, n: ["".join(x) for x in zip(*(f"^{w}$"[i:] for i in range(n)))]
    for body, lang in rows:
        for word in letters(body):
            counts["w", lang][word] += 1
            for n in range(1, 6):
                counts[str(n), lang].update(ends(word, n))
    known = {kind: set().union(*(counts[kind, lang] for lang in langs)) for kind in langid.KINDS}
    log = lambda kind, x: np.array([np.log((counts[kind, g][x] + 0.5) / (sum(counts[kind, g].values()) + 0.5 * len(known[kind]))) for g in langs])
    total = np.zeros(len(langs))
    for word in letters(text):
        if word in known["w"]:
            total += log("w", word)
            continue
        for n in range(5, 0, -1):
            if own := [x for x in ends(word, n) if x in known[str(n)]]:
                total += np.mean([log(str(n), x) for x in own], axis=0)
                break
    return langs, total


def test_language_against_a_plain_model(spark):
    pick = random.Random(12)
    sound = {"aa": "aeiou", "bb": "bcdfg", "cc": "klmnop"}
    word = lambda s: "".join(pick.choice(s + "xy") for _ in range(pick.randint(1, 6)))
    text = lambda s, n: " ".join(word(s) for _ in range(n))
    rows = [(i, text(s, pick.randint(1, 30)), lang) for i, (lang, s) in enumerate(list(sound.items()) * 12)]
    rows += [(100 + i, text("abklxz", pick.randint(1, 12)) + " q" * (i % 2), None) for i in range(20)] + [(200, "aei" * 400_000, None), (201, "42", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    taught = [(t, lang) for _, t, lang in rows if lang]
    for r in langid.identify(df, langid.fit(df)).collect():
        body = next(t for i, t, _ in rows if i == r.doc_id)
        if r.doc_id >= 200:
            assert r.lang_pred == {200: "aa", 201: "und"}[r.doc_id]
            continue
        langs, total = score_plainly(taught, body)
        assert r.score == pytest.approx(1 / np.exp(total - total.max()).sum()) and total[langs.index(r.lang_pred)] == pytest.approx(total.max())


# --- fingerprints ----------------------------------------------------------------------------------------------------------------


def test_fingerprints_against_brute_force(spark):
    pick = random.Random(2)
    words = ["a", "bb", "ccc", "dé", "e😀", "f"]
    data = [(i * 3, None if i == 7 else " ".join(pick.choice(words) for _ in range(pick.choice([0, 1, 4, 5, 40, 400])))) for i in range(60)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in bottom_k.fingerprints(df, ranges_per_partition=3).collect()}
    assert len(got) == 60
    for (i, text), (_, following) in zip(data, data[1:] + data[:1]):
        text, following = text or "", following or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        exact = lambda t: set(bottom_k.shingle_hashes(t).tolist())
        low, high = sorted(exact(text))[:128], sorted(exact(changed))[:128]
        assert r.fingerprint == "".join(f"{x:016x}" for x in low) and r.edited_fingerprint == "".join(f"{x:016x}" for x in high)
        if max(len(exact(text)), len(exact(changed))) < 64:  # below k the estimate is exact
            both = exact(text) | exact(changed)
            assert r.near_edited == pytest.approx(len(exact(text) & exact(changed)) / len(both) if both else 1.0)
        assert r.near_next == bottom_k.resemblance(np.array(low, np.uint64), np.array(sorted(exact(following))[:128], np.uint64))


@pytest.mark.parametrize("part", [7, 64])
def test_sketches_of_parts(part, monkeypatch):
    monkeypatch.setattr(bottom_k, "PART", part)
    pick = random.Random(15)
    for n in (0, 1, 4, 5, part - 1, part, part + 1, part + 4, 3 * part, 500):
        text = " ".join(pick.choice("abcdefgh") * pick.choice([1, 2, 90]) for _ in range(n))
        words = text.encode().split()
        plain = []
        for shingle in {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set()):
            x = 0  # the polynomial of the words' hashes, then two rounds of mixing
            for word in shingle:
                x = (x * 0x9E3779B97F4A7C15 + xxhash.xxh64_intdigest(word)) % 2**64
            for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
                x = (x ^ x >> 33) * factor % 2**64
            plain.append(x ^ x >> 33)
        assert bottom_k.sketch(text).tolist() == sorted(plain)[:128]


def test_one_document_and_null_ids(spark):
    one = bottom_k.fingerprints(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")).first()
    assert one.near_next == 1.0 and one.n_chars == 11
    odd = bottom_k.fingerprints(spark.createDataFrame([(None, "x y"), (2, "x y"), (1, "q")], "doc_id long, text string")).collect()
    assert {r.doc_id: r.near_next for r in odd} == {None: 0.0, 1: 0.0, 2: 1.0}
    none = bottom_k.fingerprints(spark.createDataFrame([(None, "b"), (None, "a"), (None, "a")], "doc_id long, text string")).collect()
    assert sorted(r.near_next for r in none) == [0.0, 0.0, 1.0]


def test_sketches_merge_and_estimate():
    pick = random.Random(4)
    a = " ".join(str(pick.randint(0, 10**6)) for _ in range(8000))
    left, right = a.split(" ", 4000)[:4000], a.split(" ", 4000)[4000].split(" ")
    parts = [bottom_k.sketch(" ".join(x)) for x in (left, right)]
    whole = bottom_k.sketch(a)
    assert len(set(bottom_k.merge(*parts).tolist()) & set(whole.tolist())) >= 126  # but for shingles across the cut
    assert bottom_k.distinct(whole) == pytest.approx(7996, rel=0.35)
    assert bottom_k.containment(parts[0], whole) > 0.7 and bottom_k.resemblance(whole, whole) == 1.0
    assert (bottom_k.from_text(bottom_k.to_text(whole)) == whole).all()


# --- line dedup ------------------------------------------------------------------------------------------------------------------


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


@pytest.mark.parametrize("piece", [64, 16])
def test_lines_against_brute_force(piece, spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "PIECE", piece)  # pieces of more are cut again
    pick = random.Random(5)
    alphabet = "ab é😀"
    line = lambda n: "".join(pick.choice(alphabet) for _ in range(n))

    def edit(s):
        i, kind = pick.randint(0, len(s)), pick.random()
        return s[:i] + pick.choice(alphabet) + s[i:] if kind < 0.3 else s[:i] + s[i + 1 :] if kind < 0.55 else s[:i] + pick.choice(alphabet) + s[i + 1 :] if kind < 0.8 else s

    base = [line(n) for n in (0, 1, 2, 3, 7, 8, 15, 16, 29, 30, 31, 32, 33, 47, 48, 63, 64, 65, 127, 128, 129, 200, 300) for _ in range(2)]
    docs = [(i, "\n".join(edit(edit(pick.choice(base))) for _ in range(pick.randint(0, 8)))) for i in range(70)]
    docs += [(80, None), (81, ""), (82, docs[3][1]), (82, docs[3][1]), (None, "lone line of text\nab")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    hashes = {r.t: r.h for r in df.where("text is not null").selectExpr("text as t", "xxhash64(3, text) as h").collect()}
    known = sorted({(2**63 if d is None else d, hashes[t], t) for d, t in docs if t is not None})
    occurrences = [(d, t, i, x) for d, _, t in known for i, x in enumerate(t.split("\n")) if re.search(r"\S", x, re.ASCII)]
    first: dict = {}
    for o in occurrences:
        first.setdefault(o[3], o)
    lines = list(first)
    late = {x for i, x in enumerate(lines) if any(near(x, y) for y in lines[:i])}
    gone = {(d, t, i) for d, t, i, x in occurrences if x in late or first[x] != (d, t, i, x)}
    keep = lambda d, t: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (2**63 if d is None else d, t, i) not in gone)
    want = sorted(((d, keep(d, t)) for d, t in docs), key=str)
    got = line_dedup.line_dedup(df).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == want and len(late) > 20
    lines_of = lambda t: 0 if t is None else len(t.split("\n"))
    counts = Counter((d, lines_of(t), lines_of(t) - sum((2**63 if d is None else d, t, i) in gone for i in range(lines_of(t)))) for d, t in docs)
    assert Counter((r.doc_id, r.n_lines, r.n_kept) for r in got) == counts


def test_two_long_lines_that_differ_in_one_place(spark):
    body = "".join(chr(97 + i * 7 % 26) for i in range(5000))
    docs = [(1, body), (2, body[:2500] + "#" + body[2501:]), (3, body[:4000] + body[4001:]), (4, body[:10] + "##" + body[12:])]
    got = {r.doc_id: r.n_kept for r in line_dedup.line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 0, 3: 0, 4: 1}


def test_very_long_lines(spark):
    pick = random.Random(13)
    body = "".join(map(chr, pick.choices(range(97, 123), k=1_000_000)))
    docs = [(1, body), (2, body[:700_001] + "#" + body[700_002:]), (3, body[:123_456] + body[123_457:]), (4, body[:5] + "##" + body[7:])]
    got = {r.doc_id: r.n_kept for r in line_dedup.line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 0, 3: 0, 4: 1}


def test_columns_named_as_the_counts_stay(spark):
    df = spark.createDataFrame([(1, "one\ntwo", 7, "x"), (2, "one", 8, "y")], "doc_id long, text string, n_lines int, n_kept string")
    found = line_dedup.line_dedup(df)
    assert found.columns == df.columns and sorted(map(tuple, found.collect())) == [(1, "one\ntwo", 7, "x"), (2, "", 8, "y")]


def test_bitmaps_lose_no_key(spark, monkeypatch):
    keys, rows = spark.range(0, 30_000, 3), spark.range(30_000)
    kept = {r.id for r in common.may_hold(rows, keys, ["id"]).collect()}
    assert set(range(0, 30_000, 3)) <= kept and len(kept) < 13_000
    monkeypatch.setattr(common, "MOST_BITS", 1 << 15)
    assert set(range(0, 30_000, 3)) <= {r.id for r in common.may_hold(rows, keys, ["id"]).collect()}
    assert common.may_hold(rows, keys.limit(0), ["id"]).count() == 0


# --- embeddings ------------------------------------------------------------------------------------------------------------------


def clustered(n, seed=0, dims=64):
    pick = np.random.default_rng(seed)
    x = pick.normal(size=(n, dims))
    for i in range(n // 2, n):
        y = x[i // 3] / np.linalg.norm(x[i // 3])
        z = pick.normal(size=dims)
        z -= z @ y * y
        cosine = pick.uniform(0.93, 0.999)
        x[i] = cosine * y + np.sqrt(1 - cosine**2) * z / np.linalg.norm(z)
    return x.astype(np.float32)


def test_links_and_recall_against_brute_force(spark):
    x = clustered(3000)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    rows = {r.vec_id: r for r in embeddings.near_duplicates(df).collect()}
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    links = (u @ u.T >= 0.95) & ~np.eye(len(u), dtype=bool)
    true = links.sum(axis=1)
    got = np.array([rows[i].n_links for i in range(len(x))])
    assert (got <= true).all() and got.sum() >= 0.97 * true.sum() and true.sum() > 1000
    lab = common.labels(len(x), *np.nonzero(links))
    assert np.mean([rows[i].component_id == lab[i] for i in range(len(x))]) > 0.97
    assert all(rows[i].kept == (rows[i].component_id == i) for i in range(len(x)))


def test_recall_of_a_hot_group_that_varies_in_few_directions(spark):
    pick = np.random.default_rng(0)
    x = pick.normal(size=(9000, 64))
    centre = pick.normal(size=64)
    base = np.linalg.qr(pick.normal(size=(64, 2)))[0].T
    x[:3000] = centre / np.linalg.norm(centre) + 0.35 * pick.uniform(-1, 1, size=(3000, 2)) @ base
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = {r.vec_id: r for r in embeddings.near_duplicates(df).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = (u @ u.T >= 0.95).sum(axis=1) - 1
    got = np.array([rows[i].n_links for i in range(len(x))])
    assert (got <= true).all() and got.sum() >= 0.98 * true.sum()


def test_odd_vectors(spark):
    a = [1.0, 2.0, 3.0, 4.0]
    rows = [(1, a), (2, a), (3, [2 * v for v in a]), (4, None), (5, [0.0] * 4), (6, [1.0, None, 1.0, 1.0]), (7, [float("nan")] * 4), (8, [1.0, 2.0]), (9, [1.0, 2.0]), (None, a), (10, [float("inf")] * 4), (11, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect()}
    assert got[1] == (3, 1, True) and got[2] == (3, 1, False) and got[3] == (3, 1, False) and got[None] == (3, 1, False)
    assert all(got[i] == (0, i, True) for i in (4, 5, 6, 7, 10, 11)) and got[8] == (1, 8, True) and got[9] == (1, 8, False)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_blocks_of_a_hot_cell(spark, monkeypatch):
    for name, n in (("MEMBERS", 16), ("VISITORS", 32), ("SLICE", 8)):
        monkeypatch.setattr(embeddings, name, n)
    pick = np.random.default_rng(3)
    x = np.tile(pick.normal(size=8), (200, 1)) + 0.01 * pick.normal(size=(200, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert {(r.n_links, r.component_id) for r in embeddings.near_duplicates(df).collect()} == {(199, 0)}


def test_multi_sequence_order():
    pick = np.random.default_rng(5)
    m1, m2 = np.abs(pick.normal(size=(20, 7))), np.abs(pick.normal(size=(20, 5)))
    for q, cells in enumerate(embeddings.visits(m1, m2, 0.9)):
        sums = {i * 5 + j: m1[q, i] + m2[q, j] for i in range(7) for j in range(5)}
        assert set(cells) == {c for c, x in sums.items() if x <= 0.9} and len(cells) == len(set(cells))
        assert [sums[c] for c in cells] == sorted(sums[c] for c in cells)
    assert embeddings.visits(m1[:1] + 9, m2[:1], 0.9) == [[]]


def test_vectors_with_clashing_columns(spark):
    names = ["id", "times", "dim", "cell", "n", "to", "root", "h1", "h2", "n_links", "component_id", "kept", "node"]
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [2.0, -1.0])], "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in names})
    assert sorted(map(tuple, embeddings.near_duplicates(df).collect())) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


# --- SimHash ---------------------------------------------------------------------------------------------------------------------


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint():
    pick = random.Random(6)
    for n in (0, 1, 2, 3, 4, 50, 900):
        text = pick.choice([" ", "\n"]).join(pick.choice(["The", "cat", "É", "dog\x0b", "x y", "Ünder"]) for _ in range(n))
        assert simhash.fingerprint(text) == fingerprint(text)
    assert simhash.fingerprint(None) == 0 == simhash.fingerprint(" \n")


def test_first_hash_is_sparks(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] % 2**64 == xxhash.xxh64_intdigest(b"a b c", 42)


@pytest.mark.parametrize("most", [4, 64, 10_000])
def test_trie_join_against_brute_force(most, spark):
    pick = random.Random(7)
    fps = {pick.getrandbits(64) for _ in range(300)} | {0, 2**64 - 1}
    for f in list(fps)[:150]:
        for _ in range(3):
            for _ in range(pick.randint(1, 3)):
                f ^= 1 << pick.randrange(64)
            fps.add(f)
    fps = sorted(fps)
    a = np.array(fps, dtype=np.uint64)
    i, j = np.nonzero(np.triu(np.bitwise_count(a[:, None] ^ a[None, :]) <= 2, 1))
    gi, gj = simhash.traverse(a, a, 2, True)
    assert sorted(zip(gi.tolist(), gj.tolist())) == sorted(zip(i.tolist(), j.tolist()))
    df = spark.createDataFrame([(int(x),) for x in a.view(np.int64)], "fp long")
    links = simhash.trie_links(df, 2, most).collect()
    place = {int(x): n for n, x in enumerate(a.view(np.int64))}
    got = common.labels(len(a), np.array([place[r.a] for r in links]), np.array([place[r.b] for r in links]))
    assert (got == common.labels(len(a), i, j)).all()


@pytest.mark.parametrize("budget", [4, 7])
def test_block_join_against_brute_force(budget, spark):
    """Beyond the trie's budget: scattered fingerprints with neighbours, and a hot group that is compared in tiles."""
    pick = np.random.default_rng(1)
    near = lambda x, most: x ^ np.bitwise_or.reduce(np.uint64(1) << pick.choice(64, pick.integers(1, most), replace=False).astype(np.uint64))
    base = pick.integers(0, 2**64, 500, dtype=np.uint64)
    a = np.unique(np.array([*base, *(near(x, 12) for x in base[:300]), *(near(base[0], 6) for _ in range(1500)), 0, 2**64 - 1], dtype=np.uint64))
    i, j = np.nonzero(np.triu(np.bitwise_count(a[:, None] ^ a[None, :]) <= budget, 1))
    links = simhash.block_links(spark.createDataFrame([(int(x),) for x in a.view(np.int64)], "fp long"), budget).collect()
    place = {int(x): n for n, x in enumerate(a.view(np.int64))}
    got = common.labels(len(a), np.array([place[r.a] for r in links]), np.array([place[r.b] for r in links]))
    assert (got == common.labels(len(a), i, j)).all()


def test_components_of_documents(spark):
    pick = random.Random(8)
    base = [" ".join(pick.choice("abcdefghijklmnop") for _ in range(400)) for _ in range(12)]
    data = [(i, base[i % 12] if i % 3 else base[i % 12] + " z") for i in range(90)] + [(200, None), (201, ""), (None, base[0])]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(df).collect())
    prints = [fingerprint(t) for _, t in data]
    pairs = [(i, j) for i in range(len(data)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    lab = common.labels(len(data), *np.array(pairs).T)
    least = {n: min((data[i][0] for i in range(len(data)) if lab[i] == n and data[i][0] is not None), default=None) for n in set(lab)}
    assert got == Counter((d, p, least[n]) for (d, _), p, n in zip(data, prints, lab))


def test_components_of_graphs(spark):
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, 1001 + i) for i in range(300)]
    df = spark.createDataFrame([*chain, *star, (5000, 5000), (None, 3)], "a long, b long")
    roots = defaultdict(set)
    for r in common.components(df).collect():
        roots[r.root].add(r.node)
    assert sorted(map(len, roots.values())) == [301, 301]


# --- mixing ----------------------------------------------------------------------------------------------------------------------


def test_targets():
    assert mixing.targets([100, 100, 100], [3, 1, 2]) == [200.0, pytest.approx(250 / 3), pytest.approx(500 / 3)]
    assert mixing.targets([10, 0], [3, 1]) == [15.0, 0.0] and mixing.targets([], []) == []


def test_split_quotas():
    blocks = np.array([100, 7, 0, 33])
    quotas = mixing.split_quotas(blocks, 8)
    assert (quotas.sum(axis=0) == blocks).all() and quotas.sum(axis=1).max() - quotas.sum(axis=1).min() <= 1
    assert (mixing.split_quotas(blocks, 8) == quotas).all()


def test_mix(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    docs = docs.unionByName(spark.createDataFrame([(-1, "one two three", None), (-2, None, "src0"), (-3, "x " * 500, None), (-3, "x " * 500, None)], docs.schema))
    rows = mixing.mix(docs).collect()
    source = {r.doc_id: (r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in docs.collect()}
    sums = defaultdict(lambda: [0, 0, 0.0])
    for r in rows:
        assert r["size"] == source[r.doc_id][1] and r.taken <= 2 * r["size"] and r.taken == len(r.shards) * r["size"] and all(0 <= s < 8 for s in r.shards)
        own = sums[source[r.doc_id][0]]
        own[0], own[1], own[2] = own[0] + r["size"], own[1] + r.taken, r.target
    names = sorted(sums, key=lambda s: (s is None, s or ""))
    wanted = mixing.targets([sums[s][0] for s in names], [(3, 1, 2)[i % 3] for i in range(len(names))])
    for s, t in zip(names, wanted):
        assert sums[s][2] == pytest.approx(t) and sums[s][1] == pytest.approx(t, rel=0.05, abs=12)
    again = mixing.mix(docs.repartition(7)).collect()
    assert Counter((r.doc_id, r.taken, tuple(r.shards)) for r in rows) == Counter((r.doc_id, r.taken, tuple(r.shards)) for r in again)


def test_mix_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUPS", 2)
    pick = random.Random(14)
    data = [(i, pick.choice(["a", "b", "b", "b", "c", "é", None]), " ".join("w" * pick.randint(0, 40))) for i in range(600)]
    data += [(1000, "b", "x y z")] * 40 + [(1001, "d", None), (1002, "d", ""), (1003, "e", "one " * 7)]
    df = spark.createDataFrame(data, "doc_id long, source string, text string")
    rows = mixing.mix(df.repartition(3), block_docs=20, carry=["source"]).collect()
    hashes = {(r.doc_id, r.text): r.h for r in df.selectExpr("doc_id", "text", "xxhash64(0, doc_id, text) as h").collect()}
    words = lambda t: len((t or "").split())
    by = defaultdict(list)
    for d, source, t in data:
        by[source].append((hashes[d, t], words(t), d))
    names = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    size = {s: sum(w for _, w, _ in by[s]) for s in names}
    low, high = 0.0, 1e6  # the water level by bisection
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(level * weight[s], 2 * size[s]) for s in names) < 1.5 * sum(size.values()) else (low, level)
    for s in names:
        target = min(high * weight[s], 2 * size[s])
        own = sorted((x for x in by[s] if x[1]), key=lambda x: x[0])
        blocks = max(1, -(-len(own) // 20))
        passes = int((target + 1e-6) // size[s]) if size[s] else 0
        left = target - passes * size[s]
        want: Counter = Counter()
        for b in range(blocks):
            some = [x for x in own if x[0] % blocks == b]
            if sum(w for _, w, _ in some) <= left + 1e-6:
                want.update(x[2] for x in some)
                left -= sum(w for _, w, _ in some)
                continue
            for h, w, d in sorted(some, key=lambda x: (-x[1], x[0])):
                if w <= left + 1e-6:
                    want[d] += 1
                    left -= w
            rest = sorted(w for d, w in Counter({}).items()) or [w for _, w, d in some if want[d] < sum(x[2] == d for x in some)]
            if rest and min(rest) - left < left - 1e-6:
                least = [(h, d) for h, w, d in some if w == min(rest) and want[d] < sum(x[2] == d for x in some)]
                want[max(least)[1]] += 1
            break
        got: Counter = Counter()
        for r in rows:
            if r.source == s:
                assert r.source_size == size[s] and r.target == pytest.approx(target, abs=1e-3) and r.taken == len(r.shards) * r["size"]
                got[r.doc_id] += len(r.shards)
        times = Counter()
        for _, w, d in by[s]:
            times[d] += passes * (w > 0)
        assert +got == +(times + want), s
    # a drawn part (source, pass, block, part) is in one shard, and parts are cut into runs
    for s in names:
        n = max(1, -(-sum(1 for x in by[s] if x[1]) // 20))
        at = defaultdict(set)
        for r in rows:
            if r.source == s:
                h = next(x[0] for x in by[s] if x[2] == r.doc_id)
                for p, shard in enumerate(r.shards):
                    at[(p * n + h % n) * 16 + (h >> 32) % 16].add(shard)
        assert all(len(x) == 1 for x in at.values())
        runs = [min(at[k]) for k in sorted(at)]
        assert runs == sorted(runs)


def test_mix_of_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1000)
    df = spark.range(110_000).selectExpr("id as doc_id", "case when id < 10000 then 'hot' else concat('s', id) end as source", "repeat('w ', cast(1 + id % 9 as int)) as text")
    rows = mixing.mix(df, carry=["source"]).toPandas()
    hot = rows[rows["source"] == "hot"]
    assert len(rows) == 110_000 and (rows["taken"] <= 2 * rows["size"]).all() and rows["source_size"].sum() == hot["size"].sum() * 10_000 + rows["size"].sum() - hot["size"].sum()
    assert hot["taken"].sum() == pytest.approx(hot["target"].iloc[0], abs=2)
    whole = rows["size"].sum()
    assert rows.groupby("source")["target"].first().sum() == pytest.approx(1.5 * whole)


# --- tokens ----------------------------------------------------------------------------------------------------------------------


def greedy(word, vocabulary):
    n = i = 0
    while i < len(word):
        i = next(k for k in range(len(word), i, -1) if word[i:k] in vocabulary or k == i + 1)
        n += 1
    return n


def test_automaton_against_brute_force():
    pick = random.Random(9)
    for _ in range(40):
        vocabulary = {bytes(pick.choice(b"abc") for _ in range(pick.randint(1, 6))) for _ in range(25)}
        automaton = wordpiece.Automaton(vocabulary)
        for _ in range(60):
            word = bytes(pick.choice(b"abcd") for _ in range(pick.randint(0, 30)))
            assert automaton.count(word) == greedy(word, vocabulary)


def test_token_counts_over_the_vocabulary(spark, sf_dir):
    ranks = wordpiece.read_ranks((FOLDER / "byte_bpe_50k.tiktoken").read_bytes())
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40).cache()
    vocabulary = set(ranks)
    rows = {r.doc_id: r for r in wordpiece.token_counts(docs, ranks).collect()}
    for r in docs.collect():
        words = r.text.encode().split()
        assert (rows[r.doc_id].n_words, rows[r.doc_id].n_tokens) == (len(words), sum(greedy(b" " + w, vocabulary) for w in words))


def test_automaton_equals_a_wordpiece_library():
    from tokenizers import Tokenizer, models, pre_tokenizers

    names = {p: i for i, p in enumerate(["[UNK]", *"abcde", "ab", "abc", "cd", "bcde", "de", "aa", "eeee"])}
    library = Tokenizer(models.WordPiece(names, unk_token="[UNK]", continuing_subword_prefix=""))
    library.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    automaton = wordpiece.Automaton(p.encode() for p in names if p != "[UNK]")
    pick = random.Random(10)
    for _ in range(300):
        word = "".join(pick.choice("abcde") for _ in range(pick.randint(1, 20)))
        assert automaton.count(word.encode()) == len(library.encode(word).ids)


# --- pieces ----------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    return (FOLDER / "piece_bpe_32k.model").read_bytes()


def test_pieces_equal_the_library(model, spark, sf_dir):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    own = pieces.Encoder(model)
    texts = ["", " ", "  a  b ", "a\nb\n\nc", "x" * 300, "😀 é ﬁ　日本語テキスト 中文 Ωmega", "<s> <0x0A> <unk>", "a\x00b\ttab", "1234567890 12,345.67", "don't  stop   now    ok     go"]
    pick = random.Random(11)
    texts += ["".join(pick.choice("aeinrst lo   d\nqéß.") for _ in range(120)) for _ in range(200)]
    texts += [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    for text, ids in zip(texts, own.encode_batch(texts)):
        found = np.frombuffer(ids, np.int32).tolist()
        assert found == library.encode(text), text[:80]
        assert own.decode(found) == text
    assert own.encode(None) == []


def test_unigram_mode_is_the_best_sum(model):
    own = pieces.Encoder(model, unigram=True)
    own.scores = {"a": -1.0, "b": -1.5, "ab": -2.0, "ba": -2.6, "aba": -3.6, "▁": -1.0}
    own.longest = 3

    def best(word):
        return 0.0 if not word else max(own.scores.get(word[:k], own.worst if k == 1 else -1e9) + best(word[k:]) for k in range(1, min(3, len(word)) + 1))

    for word in sorted("".join(x) for n in range(1, 7) for x in itertools.product("ab", repeat=n)):
        found = own.pieces(word)
        assert "".join(found) == word and sum(own.scores[p] for p in found) == pytest.approx(best(word))


def test_shared_prefixes_do_not_change_the_result(model):
    own, alone = pieces.Encoder(model), pieces.Encoder(model)
    words = sorted({"▁inter", "▁internal", "▁international", "▁internationally", "▁internet", "▁intern", "▁in", "▁i", "▁zebra"})
    for word in words:
        alone.reset()
        assert own.pieces(word) == alone.pieces(word) == alone.merged(word)


# --- queries ---------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries(name, spark, sf_dir):
    import duckdb

    df = queries.QUERIES[name](spark, sf_dir)
    table = "embeddings" if "embedding" in name else "documents"
    rows = df.collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/{table}.parquet").count()
    if name in queries.ORACLE:
        con = duckdb.connect()
        for t in ("documents", "embeddings"):
            con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
        cursor = con.execute(queries.ORACLE[name])
        names = [c[0] for c in cursor.description]
        assert sorted(names) == sorted(df.columns)
        assert Counter(tuple(str(r[c]) for c in names) for r in rows) == Counter(tuple(map(str, r)) for r in cursor.fetchall())
