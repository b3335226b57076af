"""Repair of conversations: the cheapest edits after which a system turn at most and then user and assistant in turn remain.

Rows are (conv_id, turn, role, text); a null in any of them reads as one space, and null turns come first. A conversation's rows go by turn, rows of one turn by
role and then by a hash of the text. A row is blank, else a duplicate (its role and text were seen earlier), else truncated (its last visible character ends no
sentence), else sound. Blank and duplicate rows must be deleted (3), others may be kept (0) where their role fits, given the role that fits (2) or
deleted; an empty turn may be inserted anywhere (2); a truncated row that stays costs 1. Of equally cheap lists of edits, the one whose initials come first
is taken (D, I, K, R).

The method is a dynamic program over four states (nothing yet, after system, after user, after assistant), time-major: conversations of like length form a
tensor (turn, conversation, state), and each turn is one vectorised step for all of them. Costs go backwards and are stored; the edits are traced
forwards, a step for all conversations at a time.

Conversations are cut where range partitions of (conv_id, turn, ..) end and after PIECE rows, so no task holds a long one. A piece that is a whole
conversation is done at once. Those of a divided one give a 4 x 4 table first (the least cost from each state before to each state behind); the tables
of a conversation give the costs at its cuts, and with them each piece is traced by itself. Only the repaired text's digest reads a conversation in one task, as a
stream: a hash has to.

Edge cases: repeated rows are duplicates of the first; empty and very long texts are read whole; a null or empty role fits nowhere; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import alone, bound_batches, durable, partitions_of, tidy

#: States of the repaired turns so far: none, system, ..user, ..assistant; the state behind the turn that fits next, and that turn's letter.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = np.array([USER, USER, ASSISTANT, USER])
LETTERS = "sua"
NEEDED = np.array([1, 1, 2, 1])
#: A row's code: its role's letter (3: another), and bits for rows that must go and for truncated ones.
DEAD, CUT = 4, 8
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
NEVER = 1 << 40
#: Rows of a piece, and rows of all pieces that a tensor holds at a time.
PIECE = 4096
TENSOR = 1 << 18
EDITS = np.frombuffer(b"DIKR", np.uint8)

SPACE = " \t\n\v\f\r"
COUNTS = ("blank", "duplicate", "truncated", "illegal")


def damage(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with the faults that a checksum of `conv_id:turn` deals: of twenty, 0 drops the row, 1 empties its text, 2 takes its full stops, exclamation
    and question marks, 3 repeats it, 4 makes it the user's."""
    own = _plain(rows)
    fault = F.pmod(F.crc32(F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))).cast("binary")), F.lit(20))
    text = F.when(F.col("fault_") == 1, "").when(F.col("fault_") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault_") == 4, "user").otherwise(F.col("role"))
    times = F.sequence(F.lit(1), F.when(F.col("fault_") == 3, 2).otherwise(1))
    kept = own.withColumn("fault_", fault).where("fault_ <> 0")
    return kept.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy_")).drop("copy_")


def _plain(rows: DataFrame) -> DataFrame:
    return rows.select("conv_id", "turn", *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")))


def _keyed(rows: DataFrame) -> DataFrame:
    """With the conversation's key (has, conv) and the row's place in it: turn, null first; role; 128 bits of the text's hash."""
    place = {"has": F.col("conv_id").isNotNull(), "conv": F.coalesce("conv_id", F.lit(0)).cast("long"), "known": F.col("turn").isNotNull(), "at": F.coalesce("turn", F.lit(0)).cast("long")}
    return _plain(rows).withColumns(place | {"h1": F.xxhash64(F.lit(1), "text"), "h2": F.xxhash64(F.lit(2), "text")})


KEY = ["has", "conv"]
PLACE = ["known", "at", "role", "h1", "h2"]


def _marked(rows: DataFrame) -> DataFrame:
    """(has, conv, known, at, code, fault), in order within range partitions: no texts. fault: 1 blank, 2 duplicate, 3 truncated."""
    last = F.substring(F.rtrim("text", F.lit(SPACE)), -1, 1)
    kind = F.when(last == "", 1).when(~last.isin(".", "!", "?"), 3).otherwise(0)
    letter = F.when(F.col("role") == "", 0).otherwise(F.expr(f"locate(substring(role, 1, 1), '{LETTERS}')"))
    letter = F.when(letter > 0, letter - 1).otherwise(3)
    once = _keyed(rows).groupBy(*KEY, *PLACE).agg(F.count("*").alias("times"), F.first(kind).alias("kind"), F.first(letter).alias("letter"))
    same = once.groupBy(*KEY, "role", "h1", "h2").agg(F.min(F.struct("known", "at")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    met = once.join(same, [*KEY, "role", "h1", "h2"], "left")
    later = F.coalesce(F.struct("known", "at") != F.col("first"), F.lit(False)).alias("later")
    rows = met.select(*KEY, *PLACE, "kind", "letter", later, F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("copy"))
    fault = F.when(F.col("kind") == 1, 1).when(F.col("later") | (F.col("copy") > 1), 2).otherwise(F.col("kind")).cast("byte")
    code = F.col("letter") + F.when(fault.isin(1, 2), DEAD).when(fault == 3, CUT).otherwise(0)
    placed = rows.repartitionByRange(partitions_of(rows), *KEY, *PLACE, "copy").sortWithinPartitions(*KEY, *PLACE, "copy")
    return placed.select(*KEY, "known", "at", code.cast("byte").alias("code"), fault.alias("fault"))


PIECES = "has boolean, conv long, part int, number long, codes binary, blank long, duplicate long, truncated long, illegal long, turns long, low long, high long"
LEGAL = np.zeros((4, 4), bool)
LEGAL[[0, 1, 2], [1, 2, 1]] = True


def _pieces(rows: DataFrame, most: int) -> DataFrame:
    """A row for each piece: its codes, the counts within it, its distinct turns, the least and the greatest of them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("conversations")
        part, number = TaskContext.get().partitionId(), 0
        held = None

        def starts_of(own: list[np.ndarray]) -> np.ndarray:
            has, conv = own[:2]
            fresh = np.flatnonzero(np.concatenate([[True], (conv[1:] != conv[:-1]) | (has[1:] != has[:-1])]))
            each = -(-np.diff(np.append(fresh, len(conv))) // most)
            return np.repeat(fresh, each) + most * (np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each))

        def packed(own: list[np.ndarray], starts: np.ndarray) -> pa.RecordBatch:
            nonlocal number
            has, conv, known, at, code, fault = own
            inner = np.ones(len(conv), bool)
            inner[starts] = False
            letter = code & 3
            wrong = inner & np.concatenate([[False], ~LEGAL[letter[:-1], letter[1:]]])
            new = known & ~(inner & np.concatenate([[False], known[:-1] & (at[1:] == at[:-1])]))
            sums = [np.add.reduceat(x.astype(np.int64), starts) for x in (fault == 1, fault == 2, fault == 3, wrong, new)]
            none = sums[-1] == 0
            low, high = np.minimum.reduceat(np.where(known, at, np.iinfo(np.int64).max), starts), np.maximum.reduceat(np.where(known, at, np.iinfo(np.int64).min), starts)
            ends = np.append(starts, len(conv)).astype(np.int32)
            codes = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(code.astype(np.uint8).tobytes())])
            numbers = number + np.arange(len(starts))
            number += len(starts)
            found = [pa.array(has[starts]), pa.array(conv[starts]), pa.array(np.full(len(starts), part, np.int32)), pa.array(numbers), codes, *map(pa.array, sums), pa.array(low, mask=none), pa.array(high, mask=none)]
            return pa.RecordBatch.from_arrays(found, [x.split()[0] for x in PIECES.split(", ")])

        for batch in batches:
            if not batch.num_rows:
                continue
            own = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held = own if held is None else [np.concatenate(x) for x in zip(held, own)]
            starts = starts_of(held)
            if len(starts) > 1:  # the last piece may go on in the next batch
                yield packed([c[: starts[-1]] for c in held], starts[:-1])
                held = [c[starts[-1] :] for c in held]
        if held is not None:
            yield packed(held, starts_of(held))

    return durable(rows.mapInArrow(tidy(cut), PIECES))


#: Least cost of finishing from each state when all turns are read.
FINISH = np.array([0, 2 * INSERT, INSERT, 0])


def backward(codes: np.ndarray, sizes: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Least costs [turn, conversation, state, ..] from before each turn to the end, given those behind the last turn [conversation, state, ..]. codes: [turn, conversation];
    conversations of fewer turns (sizes) are padded."""
    costs = np.empty((len(codes) + 1, *end.shape), np.int64)
    costs[-1] = end
    for t in range(len(codes) - 1, -1, -1):
        after, code = costs[t + 1], codes[t]
        letter, dead, more = code & 3, (code & DEAD) > 0, np.where(code & CUT, TRUNCATED, 0)
        stay = np.where(letter[:, None] == NEEDED, KEEP, REROLE) + more[:, None]
        stay[dead] = NEVER
        system = np.where((letter == 0) & ~dead, KEEP + more, NEVER)
        now = np.minimum(after + DELETE, after[:, NEXT] + stay[:, :, None])
        now[:, START] = np.minimum(now[:, START], after[:, SYSTEM] + system[:, None])
        for _ in range(2):  # two insertions reach every state that any number reaches
            now = np.minimum(now, now[:, NEXT] + INSERT)
        costs[t] = np.where((t < sizes)[:, None, None], now, after)
    return costs


def trace(codes: np.ndarray, sizes: np.ndarray, costs: np.ndarray, start: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edits [step, conversation] (places in EDITS, 255 behind the end) of least cost, and of those the least in ASCII order, and the states behind them. last: whether turns may be inserted
    behind the last one, where otherwise the next piece does that."""
    turn, state, steps = np.zeros(len(sizes), np.int64), start.copy(), []
    going = np.arange(len(sizes))
    while len(going):
        t, s = turn[going], state[going]
        inside = t < sizes[going]
        now, code = costs[t, going, s], codes[np.minimum(t, len(codes) - 1), going]
        then = np.minimum(t + 1, len(codes))
        letter, dead, more = code & 3, (code & DEAD) > 0, np.where(code & CUT, TRUNCATED, 0)
        first = (s == START) & (letter == 0)
        to = np.where(first, SYSTEM, NEXT[s])
        cheap = np.stack([
            inside & (DELETE + costs[then, going, s] == now),
            (inside | last[going]) & (INSERT + costs[t, going, NEXT[s]] == now),
            inside & ~dead & (first | (letter == NEEDED[s])) & (KEEP + more + costs[then, going, to] == now),
            inside,
        ])
        edit = np.where(cheap.any(axis=0), cheap.argmax(axis=0), 255)
        state[going] = np.select([edit == 1, edit == 2, edit == 3], [NEXT[s], to, NEXT[s]], s)
        turn[going] = np.where((edit == 1) | (edit == 255), t, t + 1)
        step = np.full(len(sizes), 255, np.uint8)
        step[going] = edit
        steps.append(step)
        going = going[edit != 255]
    return np.stack(steps), state


def _spelt(steps: np.ndarray) -> list[str]:
    return [EDITS[own[own != 255]].tobytes().decode() for own in steps.T]


def _tensors(codes: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places in the list, codes [turn, conversation], sizes) of conversations of like length, TENSOR rows at a time at most."""
    sizes = np.array([len(c) for c in codes])
    kind = np.ceil(np.log2(np.maximum(sizes, 1))).astype(int)
    for k in np.unique(kind):
        places = np.flatnonzero(kind == k)
        for i in range(0, len(places), max(1, TENSOR >> k)):
            some = places[i : i + max(1, TENSOR >> k)]
            padded = np.zeros((len(some), sizes[some].max()), np.uint8)
            for row, place in zip(padded, some):
                row[: sizes[place]] = np.frombuffer(codes[place], np.uint8)
            yield some, np.ascontiguousarray(padded.T).astype(np.int64), sizes[some]


REPAIRS = "has boolean, conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _whole(pieces: DataFrame) -> DataFrame:
    """Repairs of conversations that are one piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("conversations")
        for batch in batches:
            own = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            cost, audit = np.zeros(batch.num_rows, np.int64), [""] * batch.num_rows
            for some, codes, sizes in _tensors(own["codes"].to_pylist()):
                costs = backward(codes, sizes, np.broadcast_to(FINISH[:, None], (len(some), 4, 1)))[..., 0]
                steps, _ = trace(codes, sizes, costs, np.full(len(some), START), np.ones(len(some), bool))
                cost[some] = costs[0, :, START]
                for place, text in zip(some, _spelt(steps)):
                    audit[place] = text
            turns = own["turns"].to_numpy()
            low, high = (own[c].fill_null(0).to_numpy() for c in ("low", "high"))
            gaps = np.where(turns > 0, high - low + 1 - turns, 0)
            yield pa.RecordBatch.from_arrays([own["has"], own["conv"], pa.array(gaps), *(own[c] for c in COUNTS), pa.array(cost), pa.array(audit, pa.string())], [x.split()[0] for x in REPAIRS.split(", ")])

    return pieces.mapInArrow(tidy(run), REPAIRS)


AT = [*KEY, "part", "number"]


def _divided(pieces: DataFrame) -> DataFrame:
    """Repairs of conversations of several pieces. What meets in one task of a conversation is a few numbers for each piece, and the list of its edits."""

    def listed(rows: DataFrame, *columns: str) -> DataFrame:
        return rows.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("part", "number", *columns))).alias("list"))

    def each(rows: DataFrame, schema: str, run) -> DataFrame:  # noqa: ANN001
        """`run` makes rows of a batch's row dictionaries."""

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            alone("conversations")
            for batch in batches:
                yield pa.RecordBatch.from_pylist(run(batch.to_pylist()), schema=kinds)

        kinds = pa.schema([(n, types[t]) for n, t in (x.split() for x in schema.split(", "))])
        return rows.mapInArrow(tidy(task), schema)

    types = {"boolean": pa.bool_(), "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
    key = "has boolean, conv long, part int, number long"

    def tables(rows: list[dict]) -> list[dict]:
        for some, codes, sizes in _tensors([r["codes"] for r in rows]):
            end = np.broadcast_to(np.where(np.eye(4, dtype=bool), 0, NEVER), (len(some), 4, 4))
            for place, table in zip(some, backward(codes, sizes, end)[0]):
                rows[place]["table"] = table.ravel().tolist()
        return [{c: r[c] for c in (*AT, "table")} for r in rows]

    def ends(rows: list[dict]) -> list[dict]:
        out = []
        for r in rows:
            costs = FINISH
            for place, piece in reversed(list(enumerate(r["list"]))):
                own = {c: r[c] for c in KEY} | {"part": piece["part"], "number": piece["number"], "end": costs.tolist(), "last": place == len(r["list"]) - 1}
                costs = (np.array(piece["table"]).reshape(4, 4) + costs).min(axis=1)
                out.append(own | {"cost": int(costs[START]) if place == 0 else None})
        return out

    def traced(rows: list[dict], starts: list[list[int]]) -> list[list[tuple[str, int]]]:
        """For each of a row's start states the edits and the state behind them."""
        out: list[list[tuple[str, int]]] = [[] for _ in rows]
        for some, codes, sizes in _tensors([r["codes"] for r in rows]):
            costs = backward(codes, sizes, np.array([rows[i]["end"] for i in some])[:, :, None])[..., 0]
            last = np.array([rows[i]["last"] for i in some])
            for k in range(len(starts[0])):
                steps, state = trace(codes, sizes, costs, np.array([starts[i][k] for i in some]), last)
                for place, text, s in zip(some, _spelt(steps), state):
                    out[place].append((text, int(s)))
        return out

    def reaches(rows: list[dict]) -> list[dict]:
        return [{c: r[c] for c in AT} | {"reach": [s for _, s in found]} for r, found in zip(rows, traced(rows, [list(range(4))] * len(rows)) if rows else [])]

    def begins(rows: list[dict]) -> list[dict]:
        out = []
        for r in rows:
            state = START
            for piece in r["list"]:
                out.append({c: r[c] for c in KEY} | {"part": piece["part"], "number": piece["number"], "begin": state})
                state = piece["reach"][state]
        return out

    def audits(rows: list[dict]) -> list[dict]:
        return [{c: r[c] for c in AT} | {"audit": found[0][0]} for r, found in zip(rows, traced(rows, [[r["begin"]] for r in rows]) if rows else [])]

    def whole(rows: list[dict]) -> list[dict]:
        out = []
        for r in rows:
            own = {c: r[c] for c in KEY} | {c: sum(x[c] for x in r["list"]) for c in COUNTS}
            pairs = list(zip(r["list"], r["list"][1:]))
            own["illegal"] += sum(not LEGAL[a["tail"], b["head"]] for a, b in pairs)
            turns = sum(x["turns"] for x in r["list"]) - sum(a["high"] is not None and a["high"] == b["low"] for a, b in pairs)
            lows, highs = ([x[c] for x in r["list"] if x[c] is not None] for c in ("low", "high"))
            own["gaps"] = highs[-1] - lows[0] + 1 - turns if turns else 0
            out.append(own | {"cost": r["list"][0]["cost"], "audit": "".join(x["audit"] for x in r["list"])})
        return out

    byte = lambda i: F.conv(F.hex(F.substring("codes", i, 1)), 16, 10).cast("int").bitwiseAND(3)
    pieces = pieces.withColumns({"head": byte(1), "tail": byte(-1)})
    behind = durable(each(listed(each(pieces.select(*AT, "codes"), f"{key}, table array<long>", tables), "table"), f"{key}, end array<long>, last boolean, cost long", ends))
    known = durable(pieces.join(behind, AT))
    before = each(listed(each(known.select(*AT, "codes", "end", "last"), f"{key}, reach array<long>", reaches), "reach"), f"{key}, begin long", begins)
    edits = each(known.join(before, AT).select(*AT, "codes", "end", "last", "begin"), f"{key}, audit string", audits)
    every = listed(known.join(edits, AT), *COUNTS, "turns", "low", "high", "head", "tail", "cost", "audit")
    return each(every, REPAIRS, whole)


def repair(rows: DataFrame, most: int = PIECE) -> DataFrame:
    """A row for each conversation of `rows` (conv_id long, turn long, role, text): conv_id, gaps (turns that lack between the least and the greatest), blank, duplicate, truncated, illegal (adjacent
    roles that do not follow each other), the edits' cost, and audit: their initials in order. `most`: rows of a piece."""
    bound_batches(rows.sparkSession)
    pieces = _pieces(_marked(rows), most)
    several = durable(pieces.groupBy(*KEY).count().where("count > 1").select(*KEY))
    found = _whole(pieces.join(several, KEY, "left_anti")).unionByName(_divided(pieces.join(several, KEY, "left_semi")))
    return durable(found.select(F.when(F.col("has"), F.col("conv")).alias("conv_id"), "gaps", *COUNTS, "cost", "audit"))


def repaired(rows: DataFrame, repairs: DataFrame) -> DataFrame:
    """(conv_id, place from 0, role, text): the turns of `rows` after the edits in `repairs`; inserted ones have an empty text. A conversation's rows are in
    order in one partition, through which they go as a stream."""
    bound_batches(rows.sparkSession)
    turns = _keyed(rows).select(*KEY, F.lit(1).alias("kind"), *PLACE, "text")
    audits = repairs.select(
        F.col("conv_id").isNotNull().alias("has"), F.coalesce("conv_id", F.lit(0)).cast("long").alias("conv"), F.lit(0).alias("kind"), F.lit(False).alias("known"),
        *(F.lit(0).cast("long").alias(c) if c != "role" else F.lit("").alias(c) for c in PLACE[1:]), F.col("audit").alias("text"),
    )
    placed = turns.unionByName(audits).repartition(partitions_of(rows), *KEY).sortWithinPartitions(*KEY, "kind", *PLACE)
    schema = "conv_id long, place long, role string, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("conversations")
        conv, audit, at, state, place = None, "", 0, START, 0
        out: list[tuple] = []

        def put(role: str, text: str, to: int) -> None:
            nonlocal state, place
            out.append((conv, place, role, text))
            state, place = to, place + 1

        def inserted() -> None:
            nonlocal at
            while audit[at : at + 1] == "I":
                put(ROLES[NEXT[state]], "", NEXT[state])
                at += 1

        def flushed() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.string()))]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in schema.split(", ")])

        for batch in batches:
            for has, own, kind, role, text in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if kind == 0:
                    inserted()
                    conv, audit, at, state, place = own if has else None, text, 0, START, 0
                    continue
                inserted()
                edit = audit[at]
                at += 1
                if edit == "K":
                    put(role, text, SYSTEM if state == START and role[0] == "s" else NEXT[state])
                elif edit == "R":
                    put(ROLES[NEXT[state]], text, NEXT[state])
            if out:
                yield flushed()
        inserted()
        if out:
            yield flushed()

    return placed.select(*KEY, "kind", "role", "text").mapInArrow(tidy(run), schema)


ROLES = {USER: "user", ASSISTANT: "assistant"}


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the rows of `repaired`: of `role:text`, joined by newlines, in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("conversations")
        conv, state = None, None
        names = ["conv_id", "repaired_sha256"]
        for batch in batches:
            done = []
            for own, place, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if place == 0:
                    if state is not None:
                        done.append((conv, state.hexdigest()))
                    conv, state = own, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], pa.int64()), pa.array([h for _, h in done], pa.string())], names)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([state.hexdigest()], pa.string())], names)

    return turns.mapInArrow(tidy(run), "conv_id long, repaired_sha256 string")


def report(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """For each conv_id of `conversations`: the repair of its `rows` and the digest of the repaired text; zeros and empty texts where it has none."""
    repairs = repair(rows)
    hashes = digests(repaired(rows, repairs))
    every = conversations.select("conv_id").distinct()
    keyed = lambda df: df.withColumnRenamed("conv_id", "id_")
    met = every
    for own in (repairs, hashes):
        met = met.join(keyed(own), F.col("conv_id").eqNullSafe(F.col("id_")), "left").drop("id_")
    zeros = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("gaps", *COUNTS, "cost")}
    empty = hashlib.sha256(b"").hexdigest()
    return met.withColumns(zeros | {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.lit(empty))})
