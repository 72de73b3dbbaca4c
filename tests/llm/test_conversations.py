"""Conversation repair against plain dynamic programming over whole scripts of edits."""

import functools
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sqlprism.llm import conversations as c


def _script(rows):
    """(cost, audit, repaired rows) of (role, text, fault) rows: the least of every script, state by state."""
    nxt, keep = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}, {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    @functools.cache
    def best(i, q, inserted):
        ways = []
        if i == len(rows):
            if q in (0, 3):
                ways.append((0, "", ()))
        else:
            role, text, fault = rows[i]
            cost, audit, out = best(i + 1, q, 0)
            ways.append((cost + 2, "D" + audit, out))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                if (q, role[:1]) in keep:
                    cost, audit, out = best(i + 1, keep[q, role[:1]], 0)
                    ways.append((cost + more, "K" + audit, (f"{role}:{text}", *out)))
                cost, audit, out = best(i + 1, nxt[q][1], 0)
                ways.append((cost + more + 1, "R" + audit, (f"{nxt[q][0]}:{text}", *out)))
        if inserted < 3:
            cost, audit, out = best(i, nxt[q][1], inserted + 1)
            ways.append((cost + 5, "I" + audit, (f"{nxt[q][0]}:", *out)))
        return min(ways) if ways else (10 ** 9, "~", ())

    return best(0, 0, 0)


def _expected(rows):
    """Result rows of a list of (conv_id, turn, role, text)."""
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        by[conv] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for conv, some in by.items():
        some.sort(key=lambda r: ((r[0] is not None, r[0] or 0), r[1], r[2][:c.HEAD], hashlib.sha256(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).digest()))
        seen, marked = set(), []
        for _, role, text in some:
            solid = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
            seen.add((role, text))
            marked.append((role, text, fault))
        cost, audit, repaired = _script(marked)
        turns = [t for t, _, _ in some if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        n = [sum(m[2] == f for m in marked) for f in ("blank", "duplicate", "truncated")]
        out.append((conv, gaps, *n, illegal, cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest()))
    return sorted(out, key=str)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, c._SYMBOLS - 1), max_size=14))
def test_tables_give_the_least_script(symbols):
    names = ["system", "user", "assistant", "other"]
    rows = [("user", "", "blank") if s == 0 else (names[(s - 1) // 2], "t", "truncated" if (s - 1) % 2 else "") for s in symbols]
    cost, audit, _ = _script(tuple(rows))
    letters, state, front, between = c.trace(np.array(symbols, np.int64), 0, 0)
    assert (between + c.tables().vectors[front][0], letters + c._ENDING[state]) == (cost, audit)
    for k in (1, 5):  # the same from summaries of pieces
        pieces = [np.array(symbols[i:i + k], np.int64) for i in range(0, len(symbols), k)]
        places, total = c.chain([c.summary(p) for p in pieces])
        ends = [c.trace(p, *place) for p, place in zip(pieces, places, strict=True)]
        assert total == cost if pieces else cost == 0
        assert "".join(e[0] for e in ends) + (c._ENDING[ends[-1][1]] if ends else "") == audit


def test_table_of_a_block_is_the_steps_of_its_rows():
    t = c.tables()
    assert t.vectors[0] == c._FINAL and t.back.shape == (len(t.vectors), c._SYMBOLS ** c.BLOCK)
    rng = random.Random(1)
    for _ in range(200):
        v, symbols = rng.randrange(len(t.vectors)), [rng.randrange(c._SYMBOLS) for _ in range(c.BLOCK)]
        w = t.vectors[v]
        for s in reversed(symbols):
            w = c._before(w, s)
        code = int(c._blocks(np.array(symbols))[0][0])
        assert t.vectors[t.back[v, code]] == tuple(x - min(w) for x in w) and t.cost[v, code] == min(w)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    texts = ["Fine.", "Yes!", "cut off", "", " \t", "Why? ", "Long. " * 60, "é日.", None, "no end\n", "Fine."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "unknown", "Assistant"]
    out = [(conv, turn, rng.choice(roles), rng.choice(texts)) for conv in range(150) for turn in range(rng.randint(0, 12))]
    out += [(500, t, ["user", "assistant"][t % 2], f"Answer {t}.") for t in range(700)]  # longer than a segment of the test
    out += [(501, 1, "user", "Same.")] * 150 + [(501, None, "user", "Same."), (501, 3, "assistant", None)]
    out += [(None, t, "user", "Hi.") for t in (None, 0, 2, 2, 9)] + [(502, t, "assistant", "x" * 5000) for t in range(4)]
    out += [(503, t, "system", t * "!") for t in range(9, 0, -1)] + [(3, 2, "user", "again."), (3, 2, "user", "again."), (3, 2, "assistant", "a.")]
    dropped = next(i for i in range(10_000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0 and i > 600)
    return out + [(dropped, 0, "user", "Gone.")]


def _table(spark, rows):
    return spark.createDataFrame([(7, *r, "x", 1, b"") for r in rows], "part int, conv_id long, turn long, role string, text string, audit string, seq int, hash binary").repartition(5)


@pytest.mark.parametrize("segment", [16, 4096])
def test_whole_table(spark, rows, segment):
    table = _table(spark, rows)
    got = sorted((tuple(r) for r in c.repair(c.damaged(table), table, segment).collect()), key=str)
    assert got == _expected(rows)


def test_empty_table(spark, rows):
    table = _table(spark, rows).where("1 = 0")
    assert c.repair(c.damaged(table), table).collect() == []


def test_registered_query(spark):
    from sqlprism.llm.common import table
    sf = "/root/testdata/sf0.001"
    want = _expected([tuple(r) for r in table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()])
    assert sorted((tuple(r) for r in c.op13_four_russians_repair(spark, sf).collect()), key=str) == want
