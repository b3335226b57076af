"""Conversation repair against a plain version that compares all lists of edits by cost and then by their initials."""

from __future__ import annotations

import hashlib
import random
import zlib
from functools import cache

import pytest

from tessera.llm import conversations, queries

SCHEMA = "conv_id long, turn long, role string, text string"
VISIBLE = " \t\n\v\f\r"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fault = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else "".join(c for c in text if c not in ".!?") if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def plain_repair(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, repaired text) of one conversation's rows, in order."""
    faults, seen = [], set()
    for _, _, role, text in rows:
        shown = text.strip(VISIBLE)
        faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    name = {"u": "user", "a": "assistant"}

    @cache
    def least(i, done):
        """(cost, edits, turns) from row i on, `done` the letters so far as far as they matter."""
        need = "a" if done == "u" else "u"
        found = [(0, "", ())] if i == len(rows) and done in ("", "a") else []
        if i < len(rows):
            _, _, role, text = rows[i]
            cost, edits, turns = least(i + 1, done)
            found.append((cost + 3, "D" + edits, turns))
            if faults[i] not in ("blank", "duplicate"):
                more = faults[i] == "truncated"
                for letter in {need, "s"} if done == "" else {need}:
                    if role[:1] == letter:
                        cost, edits, turns = least(i + 1, letter)
                        found.append((cost + more, "K" + edits, (f"{role}:{text}", *turns)))
                cost, edits, turns = least(i + 1, need)
                found.append((cost + more + 2, "R" + edits, (f"{name[need]}:{text}", *turns)))
        for letters in ("u", "ua", "a", "au") if i == len(rows) else (need, need + ("a" if need == "u" else "u")):
            if letters[0] != need:
                continue
            if i == len(rows):
                if letters[-1] == "a":
                    found.append((2 * len(letters), "I" * len(letters), tuple(f"{name[x]}:" for x in letters)))
            else:
                for cost, edits, turns in stepped(i, letters[-1]):
                    found.append((cost + 2 * len(letters), "I" * len(letters) + edits, (*(f"{name[x]}:" for x in letters), *turns)))
        return min(found)

    @cache
    def stepped(i, done):
        """As `least`, of lists that do not begin with an insertion."""
        need, found = "a" if done == "u" else "u", []
        _, _, role, text = rows[i]
        cost, edits, turns = least(i + 1, done)
        found.append((cost + 3, "D" + edits, turns))
        if faults[i] not in ("blank", "duplicate"):
            more = faults[i] == "truncated"
            if role[:1] == need:
                cost, edits, turns = least(i + 1, need)
                found.append((cost + more, "K" + edits, (f"{role}:{text}", *turns)))
            cost, edits, turns = least(i + 1, need)
            found.append((cost + more + 2, "R" + edits, (f"{name[need]}:{text}", *turns)))
        return found

    cost, edits, turns = least(0, "")
    known = [t for _, t, _, _ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    initials = [r[:1] for _, _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, edits, "\n".join(turns)


def order(row):
    """Rows of one turn go by role, then by the text; the fixtures have no two texts of one turn and role."""
    conv, turn, role, text = row
    return (turn is not None, turn or 0, role)


def plain_report(rows, damaged):
    out = {}
    for conv in {r[0] for r in rows}:
        *sums, text = plain_repair(sorted((r for r in damaged if r[0] == conv), key=order))
        out[conv] = (*sums, hashlib.sha256(text.encode()).hexdigest())
    return out


def found(df):
    columns = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = df.collect()
    out = {r.conv_id: tuple(r[c] for c in columns) for r in rows}
    assert len(out) == len(rows)
    return out


def invented(seed, n, longest):
    rng, rows = random.Random(seed), []
    for conv in [None, *range(n)]:
        turn = rng.randrange(3)
        for _ in range(rng.randrange(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "User"])
            text = rng.choice(["Yes.", "No", "Why? ", "", " \n", None, "Oh!\t", "ü.", "word " * 3, "."])
            at = None if rng.random() < 0.05 else turn
            if not any(r[:3] == (conv, at, role) for r in rows[-200:]):
                rows.append((conv, at, role, text))
                if rng.random() < 0.1:
                    rows.append(rows[-1])
            turn += rng.choice([0, 1, 1, 1, 2])
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("most", [3, conversations.PIECE])
def test_repair(spark, most, monkeypatch):
    monkeypatch.setattr(conversations.repair, "__defaults__", (most,))
    rows = invented(1, 150, 12) + [(900, t, ("user", "assistant")[t % 2 if t % 17 else 0], f"{t}{'.' if t % 5 else ''}") for t in range(400)]
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    given = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert found(conversations.report(given, given)) == plain_report(rows, plain)


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(queries.op13_conversation_repair(spark, sf_dir)) == plain_report(rows, plain_damage(rows))


def test_damage(spark):
    rows = invented(2, 60, 8)
    got = [tuple(r) for r in conversations.damage(spark.createDataFrame(rows, SCHEMA)).collect()]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(got, key=key) == sorted(plain_damage(rows), key=key)


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert conversations.report(empty, empty).count() == 0
    rows = [(1, 0, "user", "x" * 3_000_000 + "."), (1, 1, "assistant", "."), (2, None, "user", "Hi."), (2, None, None, None), (None, 4, "", "Hm.")]
    given = spark.createDataFrame([(*r, "t") for r in rows], SCHEMA + ", text_ string").withColumnRenamed("text_", "known")
    got = found(conversations.report(given, given))
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert got == plain_report(rows, plain)
    assert got[1][-2] == "KK" and got[None][-2] == "D"
    gone = found(conversations.report(given, given.where("conv_id = 1")))
    assert gone[2] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_repaired_turns(spark):
    rows = [(1, 0, "system", "S."), (1, 1, "assistant", "A."), (1, 3, "user", " "), (2, 0, "user", "U."), (2, 1, "tool", "T")]
    given = spark.createDataFrame(rows, SCHEMA)
    repairs = conversations.repair(given)
    assert {r.conv_id: r.audit for r in repairs.collect()} == {1: "KIKD", 2: "KR"}
    turns = [tuple(r) for r in conversations.repaired(given, repairs).orderBy("conv_id", "place").collect()]
    assert turns == [(1, 0, "system", "S."), (1, 1, "user", ""), (1, 2, "assistant", "A."), (2, 0, "user", "U."), (2, 1, "assistant", "T")]
