"""Conversation structure repair by Four-Russians block tables (``op13_four_russians_repair``).

A conversation is a sequence of rows by turn. Every row's first fault counts: blank, duplicate (role and text seen earlier),
truncated. The cheapest edits (``COSTS``) that give role initials of the form ``(s?(ua)+)?`` are found with an automaton
of four states (start, after s, after u, after a) and an alphabet of nine row symbols (must go; or role s, u, a, other,
whole or truncated).

Method. The cost-to-go of the four states after a row is a vector; up to its least entry it is one of a small closed
set of normalised vectors, found once from the alphabet. For every block of ``BLOCK`` symbols a table holds, for every
vector behind the block, the vector before it, the cost between them and the state that each state leads to.
Rows are read by blocks from the end, one lookup each; then every block is expanded backward from the vector behind it, and
a forward walk takes the least letter (D, I, K, R) that keeps the cost, so ties go to the audit that is ASCII-least.

Distribution. Rows are range-sorted by (conversation, turn, role, first characters, hash) and cut into segments of at most
``SEGMENT_ROWS`` rows and about ``SEGMENT_BYTES`` bytes, so that a conversation that holds a third of all rows is spread
over many tasks. First occurrences are minima per (conversation, hash of role and text), pre-aggregated. A segment of a
conversation that reaches into others is summed up as a function of the vector behind it (one number per vector and state);
only these summaries of one conversation meet in a task, which hands every segment the vector behind it and its
first state. Repaired texts are hashed in one streamed pass per conversation, as SHA-256 runs in order.

Defined cases: a null conv_id is a conversation of its own; null roles, texts, and ids or turns within the damage key count as
one space; null turns come first; rows of one turn are ordered by role, their first ``HEAD`` characters and the SHA-256 of
role and text; a role that doesn't begin with s, u or a (an empty one too) can't be kept. Repeated rows are
duplicates. A conversation without rows has zeros, an empty audit and the hash of the empty string. Other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlprism.llm.common import cut, table

BLOCK = 4
SEGMENT_ROWS, SEGMENT_BYTES, HEAD = 4096, 1 << 18, 64
COSTS = {"keep": 0, "rerole": 1, "delete": 2, "insert": 5, "truncated": 5}

_SPACES = " \t\n\x0b\x0c\r"
_GO = 0  # symbol of a row that must be deleted; else 1 + 2 * role + truncated, roles in this order:
_ROLES = "sua"
_SYMBOLS = 1 + 2 * (len(_ROLES) + 1)
_KEEP = ({0: 1}, {0: 2, 1: 2, 3: 2}, {2: 3}, {})  # role: state before -> state after
_NEXT = (2, 2, 3, 2)  # state after one more row of the role that may follow
_FINAL = (0, 10, 5, 0)  # insertions that end a conversation from every state
_ENDING = ("", "II", "I", "")


def _before(after: tuple, symbol: int) -> tuple:
    """Cost-to-go of the states in front of a row, from those behind it."""
    role, cut_off = divmod(symbol - 1, 2)
    fault = COSTS["truncated"] * cut_off
    out = []
    for q in range(4):
        ways = [COSTS["delete"] + after[q]]
        if symbol != _GO:
            ways.append(COSTS["rerole"] + fault + after[_NEXT[q]])
            if q in _KEEP[role]:
                ways.append(COSTS["keep"] + fault + after[_KEEP[role][q]])
        out.append(min(ways))
    for _ in range(2):  # rows inserted in front
        out = [min(out[q], COSTS["insert"] + out[_NEXT[q]]) for q in range(4)]
    return tuple(out)


def _letters(after: tuple, symbol: int, state: int) -> tuple[str, int]:
    """ASCII-least letters up to and with this row's, and the state behind it."""
    role, cut_off = divmod(symbol - 1, 2)
    fault = COSTS["truncated"] * cut_off
    before, out = _before(after, symbol), ""
    while True:
        if before[state] == COSTS["delete"] + after[state]:
            return out + "D", state
        if before[state] == COSTS["insert"] + before[_NEXT[state]]:
            out, state = out + "I", _NEXT[state]
        elif state in _KEEP[role] and before[state] == COSTS["keep"] + fault + after[_KEEP[role][state]]:
            return out + "K", _KEEP[role][state]
        else:
            return out + "R", _NEXT[state]


class Tables(NamedTuple):
    """``vectors``: normalised cost vectors, the final one first. By (vector behind, symbol): ``letters`` and, per
    state, ``leads``. By (vector behind, block code): ``back`` and ``cost``; by state too: ``ends``. ``one_*``: rows."""

    vectors: list
    letters: list
    one_back: np.ndarray
    one_cost: np.ndarray
    leads: np.ndarray
    back: np.ndarray
    cost: np.ndarray
    ends: np.ndarray


@functools.cache
def tables() -> Tables:
    number, vectors = {_FINAL: 0}, [_FINAL]
    back, cost, letters, leads = [], [], [], []
    for v in vectors:  # grows until the set is closed
        rows = []
        for symbol in range(_SYMBOLS):
            w = _before(v, symbol)
            key = tuple(x - min(w) for x in w)
            if key not in number:
                number[key] = len(vectors)
                vectors.append(key)
            rows.append((number[key], min(w)))
        back.append([r[0] for r in rows])
        cost.append([r[1] for r in rows])
        moves = [[_letters(v, symbol, q) for q in range(4)] for symbol in range(_SYMBOLS)]
        letters.append([[m[0] for m in ms] for ms in moves])
        leads.append([[m[1] for m in ms] for ms in moves])
    one_back, one_cost, leads = (np.array(x, np.int32) for x in (back, cost, leads))
    b, c, e = one_back, one_cost, leads
    for _ in range(BLOCK - 1):  # one more symbol in front of every block
        n = b.shape[1]
        first = np.repeat(np.arange(_SYMBOLS), n)
        rest = np.tile(np.arange(n), _SYMBOLS)
        behind = b[:, rest]
        e = np.take_along_axis(e[:, rest], leads[behind, first], axis=2)
        b, c = one_back[behind, first], c[:, rest] + one_cost[behind, first]
    return Tables(vectors, letters, one_back, one_cost, leads, b, c, e)


def _blocks(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the full blocks, and the symbols after them."""
    full = len(symbols) // BLOCK * BLOCK
    return symbols[:full].reshape(-1, BLOCK) @ (_SYMBOLS ** np.arange(BLOCK - 1, -1, -1)), symbols[full:]


def trace(symbols: np.ndarray, behind: int, state: int) -> tuple[str, int, int, int]:
    """(letters, state behind, vector in front, cost between the vectors) of rows in front of vector ``behind``."""
    t = tables()
    codes, tail = _blocks(symbols)
    v, cost, single, marks = behind, 0, [], []
    for s in tail[::-1].tolist():
        single.append((v, s))
        cost += int(t.one_cost[v, s])
        v = int(t.one_back[v, s])
    for code in codes[::-1].tolist():
        marks.append(v)
        cost += int(t.cost[v, code])
        v = int(t.back[v, code])
    front, out = v, []

    def walk(pairs):
        nonlocal state
        for u, s in pairs:
            out.append(t.letters[u][s][state])
            state = int(t.leads[u, s, state])

    for i, u in enumerate(reversed(marks)):  # a block is expanded backward from the vector behind it
        pairs = []
        for s in symbols[i * BLOCK:(i + 1) * BLOCK][::-1].tolist():
            pairs.append((u, s))
            u = int(t.one_back[u, s])
        walk(reversed(pairs))
    walk(reversed(single))
    return "".join(out), state, front, cost


def summary(symbols: np.ndarray) -> bytes:
    """For every vector behind the rows: the vector in front, the cost between them, and every state's state behind."""
    t = tables()
    codes, tail = _blocks(symbols)
    v = np.arange(len(t.vectors))
    cost = np.zeros(len(v), np.int64)
    steps = []
    for s in tail[::-1]:
        steps.append((t.leads, v, s))
        cost, v = cost + t.one_cost[v, s], t.one_back[v, s]
    for code in codes[::-1]:
        steps.append((t.ends, v, code))
        cost, v = cost + t.cost[v, code], t.back[v, code]
    state = np.tile(np.arange(4), (len(v), 1))
    for ends, u, code in reversed(steps):
        state = np.take_along_axis(ends[u, code], state, axis=1)
    return np.column_stack([v, cost, state]).astype("<i4").tobytes()


def chain(parts: list[bytes]) -> tuple[list[tuple[int, int]], int]:
    """Of a conversation's summaries in order: (vector behind, first state) of each, and the cost of the whole."""
    t = tables()
    some = [np.frombuffer(p, "<i4").reshape(len(t.vectors), 6) for p in parts]
    v, cost, behind = 0, 0, []
    for s in reversed(some):
        behind.append(v)
        cost += int(s[v, 1])
        v = int(s[v, 0])
    state, out = 0, []
    for s, u in zip(some, reversed(behind), strict=True):
        out.append((u, state))
        state = int(s[u, 2 + state])
    return out, cost + t.vectors[v][0]


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the damage that crc32(``conv_id:turn``) modulo 20 names."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = (F.crc32(key) % 20).cast("int")
    text = F.coalesce("text", space)
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), kind.alias("_kind"),
                       F.when(kind == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
                       F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text")) \
        .where("_kind <> 0").withColumn("_copy", F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))) \
        .select("conv_id", "turn", "role", "text")


_SEGMENTS = ("conv_id long, part int, seq int, whole boolean, faults string, initials string, hashes array<binary>, illegal long, turns long, "
             "first_turn long, last_turn long, least_turn long, most_turn long, roles array<string>, texts array<string>")


def _illegal(initials: str) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def _fault(text: str) -> str:
    text = text.rstrip(_SPACES)
    return "b" if not text else "w" if text[-1] in ".!?" else "t"


def _segments(batches, segment_rows: int):
    """Segments of the sorted rows of one task, a row each."""
    part = TaskContext.get().partitionId()
    kinds = [(f.split()[0], f.split()[1]) for f in _SEGMENTS.split(", ")]
    ready, ready_bytes, rows, size, seq, conv, cuts, first = [], 0, [], 0, 0, None, 0, True

    def segment(ended: bool):
        nonlocal ready_bytes, rows, size, seq, cuts
        turns = [r[0] for r in rows]
        known = [t for t in turns if t is not None]
        initials = "".join(r[1][0] if r[1][:1] and r[1][0] in _ROLES else "o" for r in rows)
        ready.append((conv, part, seq, ended and cuts == 0 and not first, "".join(_fault(r[2]) for r in rows), initials, [r[3] for r in rows],
                      _illegal(initials), len(set(known)), turns[0], turns[-1], min(known, default=None), max(known, default=None),
                      [r[1] for r in rows], [r[2] for r in rows]))
        ready_bytes += size
        rows, size, seq, cuts = [], 0, seq + 1, 0 if ended else cuts + 1

    def batch():
        nonlocal ready, ready_bytes
        schema = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(),
                  "array<binary>": pa.list_(pa.binary()), "array<string>": pa.list_(pa.string())}
        out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in ready], schema[k]) for i, (_, k) in enumerate(kinds)], names=[n for n, _ in kinds])
        ready, ready_bytes = [], 0
        return out

    for b in batches:
        for c, *row in zip(*(b.column(n).to_pylist() for n in ("conv_id", "turn", "role", "text", "hash")), strict=True):
            if rows and c != conv:
                segment(True)
                first = False
            elif len(rows) >= segment_rows or size >= SEGMENT_BYTES:
                segment(False)
            conv = c
            rows.append(row)
            size += len(row[2])
            if ready_bytes >= 1 << 22 or len(ready) >= 4096:
                yield batch()
    if rows:
        segment(False)  # the conversation may go on in the next task
    if ready:
        yield batch()


_CODED = ("conv_id long, part int, seq int, whole boolean, symbols binary, blank long, duplicate long, truncated long, initials string, illegal long, turns long, "
          "first_turn long, last_turn long, least_turn long, most_turn long, audit string, cost long, state int, summed binary")


def _symbols(faults: str, initials: str, firsts: list[int]) -> tuple[np.ndarray, int, int, int]:
    """Symbols of a segment's rows, and how many are blank, duplicate, truncated."""
    fault = np.frombuffer(faults.encode(), np.uint8)
    role = np.array([_ROLES.find(c) for c in initials], np.int64)
    role[role < 0] = len(_ROLES)
    again = np.ones(len(fault), bool)
    again[firsts] = False
    blank, broken = fault == ord("b"), fault == ord("t")
    again &= ~blank
    symbols = np.where(blank | again, _GO, 1 + 2 * role + broken)
    return symbols, int(blank.sum()), int(again.sum()), int((broken & ~again).sum())


def _code(batches):
    for b in batches:
        out = {n: [] for n in ("symbols", "blank", "duplicate", "truncated", "audit", "cost", "state", "summed")}
        for whole, faults, initials, firsts in zip(*(b.column(n).to_pylist() for n in ("whole", "faults", "initials", "firsts")), strict=True):
            symbols, *counts = _symbols(faults, initials, firsts or [])
            row = {"symbols": symbols.astype(np.uint8).tobytes(), "blank": counts[0], "duplicate": counts[1], "truncated": counts[2]}
            if whole:
                letters, end, front, cost = trace(symbols, 0, 0)
                row |= {"audit": letters + _ENDING[end], "cost": cost + tables().vectors[front][0], "state": 0}
            else:
                row["summed"] = summary(symbols)
            for n, values in out.items():
                values.append(row.get(n))
        kinds = {"symbols": pa.binary(), "audit": pa.string(), "state": pa.int32(), "summed": pa.binary()}
        new = {n: pa.array(v, kinds.get(n, pa.int64())) for n, v in out.items()}
        names = [f.split()[0] for f in _CODED.split(", ")]
        yield pa.RecordBatch.from_arrays([new[n] if n in new else b.column(n) for n in ("conv_id", "part", "seq", "whole", *names[4:])], names=names)


def _chained(group: pa.Table) -> pa.Table:
    group = group.sort_by([("part", "ascending"), ("seq", "ascending")])
    places, cost = chain(group.column("summed").to_pylist())
    last = np.arange(len(places)) == len(places) - 1
    return pa.table({"part": group.column("part"), "seq": group.column("seq"), "behind": pa.array([p[0] for p in places], pa.int32()),
                     "begin": pa.array([p[1] for p in places], pa.int32()), "last": pa.array(last), "total": pa.array(np.where(last, cost, 0), pa.int64())})


def _traced(batches):
    for b in batches:
        audits = []
        for symbols, behind, begin, last in zip(*(b.column(n).to_pylist() for n in ("symbols", "behind", "begin", "last")), strict=True):
            letters, end, _, _ = trace(np.frombuffer(symbols, np.uint8).astype(np.int64), behind, begin)
            audits.append(letters + (_ENDING[end] if last else ""))
        yield pa.RecordBatch.from_arrays([b.column("part"), b.column("seq"), pa.array(audits, pa.string())], names=["part", "seq", "audit"])


def repaired(audit: str, state: int, roles: list[str], texts: list[str]) -> list[str]:
    """``role:text`` of a segment's rows after its edits."""
    out, rows = [], iter(zip(roles, texts, strict=True))
    for letter in audit:
        if letter == "I":
            out.append(("assistant" if state == 2 else "user") + ":")
            state = _NEXT[state]
            continue
        role, text = next(rows)
        if letter == "K":
            out.append(f"{role}:{text}")
            state = _KEEP[_ROLES.index(role[0])][state]
        elif letter == "R":
            out.append(("assistant" if state == 2 else "user") + ":" + text)
            state = _NEXT[state]
    return out


_RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class _Conversation:
    """Running result of one conversation, fed segment by segment."""

    def __init__(self, conv_id):
        self.conv_id, self.sha, self.any = conv_id, hashlib.sha256(), False
        self.sums = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost", "turns"), 0)
        self.audit, self.least, self.most, self.turn, self.initial, self.pending = [], None, None, None, "", None

    def figures(self, row: dict):
        for n in self.sums:
            self.sums[n] += row[n]
        self.sums["illegal"] += _illegal(self.initial + row["initials"][0])
        self.sums["turns"] -= row["first_turn"] is not None and row["first_turn"] == self.turn
        if row["least_turn"] is not None:
            self.least = row["least_turn"] if self.least is None else min(self.least, row["least_turn"])
            self.most = row["most_turn"] if self.most is None else max(self.most, row["most_turn"])
        self.turn, self.initial, self.pending = row["last_turn"], row["initials"][-1], (row["audit"], row["state"])
        self.audit.append(row["audit"])

    def texts(self, row: dict):
        for line in repaired(*self.pending, row["roles"], row["texts"]):
            self.sha.update((("\n" if self.any else "") + line).encode())
            self.any = True

    def result(self) -> tuple:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.sums["turns"]
        return (self.conv_id, gaps, *(self.sums[n] for n in ("blank", "duplicate", "truncated", "illegal", "cost")), "".join(self.audit), self.sha.hexdigest())


def _results(batches):
    now, done = None, []
    names = [f.split()[0] for f in _RESULT.split(", ")]

    def batch():
        kinds = [pa.string() if n in ("audit", "repaired_sha256") else pa.int64() for n in names]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], k) for i, k in enumerate(kinds)], names=names)

    for b in batches:
        done = []
        for row in b.to_pylist():
            if now is None or now.conv_id != row["conv_id"]:
                if now is not None:
                    done.append(now.result())
                now = _Conversation(row["conv_id"])
            if row["kind"] == 1:
                now.figures(row)
            elif row["kind"] == 2:
                now.texts(row)
        yield batch()
    if now is not None:
        done = [now.result()]
        yield batch()


def repair(rows: DataFrame, original: DataFrame | None = None, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Faults, cheapest edits and hash of the repaired text of every conversation of ``rows`` (conv_id, turn, role, text
    without null roles and texts); conversations of ``original`` without rows are returned too."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text",
                        F.substring("text", 1, HEAD).alias("head"),
                        F.unhex(F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256)).alias("hash"), F.rand(13).alias("salt"))
    order = ["conv_id", "turn", "role", "head", "hash"]
    ranged = keyed.repartitionByRange(parts, *order, "salt").sortWithinPartitions(*order)  # equal rows may lie in several tasks
    segments = cut(ranged.select("conv_id", "turn", "role", "text", "hash").mapInArrow(lambda b: _segments(b, segment_rows), _SEGMENTS))
    firsts = segments.select("conv_id", "part", "seq", F.posexplode("hashes").alias("pos", "hash")) \
        .groupBy("conv_id", "hash").agg(F.min(F.struct("part", "seq", "pos")).alias("f")) \
        .groupBy(F.col("f.part").alias("part"), F.col("f.seq").alias("seq")).agg(F.collect_list("f.pos").alias("firsts"))
    coded = cut(segments.drop("hashes", "roles", "texts").join(firsts, ["part", "seq"], "left").mapInArrow(_code, _CODED))
    chained = coded.where("NOT whole").select("conv_id", "part", "seq", "summed").groupBy("conv_id") \
        .applyInArrow(_chained, "part int, seq int, behind int, begin int, last boolean, total long")
    chained = cut(chained)
    audits = coded.where("NOT whole").select("part", "seq", "symbols").join(chained, ["part", "seq"]) \
        .mapInArrow(_traced, "part int, seq int, audit string")
    figures = ["conv_id", "part", "seq", "blank", "duplicate", "truncated", "initials", "illegal", "turns", "first_turn", "last_turn", "least_turn", "most_turn"]
    opened = coded.where("NOT whole").select(*figures).join(audits, ["part", "seq"]) \
        .join(chained.select("part", "seq", F.col("total").alias("cost"), F.col("begin").alias("state")), ["part", "seq"])
    known = coded.where("whole").select(*figures, "audit", "cost", "state").unionByName(opened)
    marks = (original if original is not None else rows).select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    pieces = marks.withColumn("kind", F.lit(0)) \
        .unionByName(known.withColumn("kind", F.lit(1)), allowMissingColumns=True) \
        .unionByName(segments.select("conv_id", "part", "seq", "roles", "texts").withColumn("kind", F.lit(2)), allowMissingColumns=True)
    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq", "kind").mapInArrow(_results, _RESULT)


def op13_four_russians_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repairs of all conversations after their damage."""
    rows = table(spark, sf_dir, "conversations")
    return repair(damaged(rows), rows)
