"""Collocations against plain counting of every phrase."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sqlprism.llm import collocations as c
from sqlprism.llm import shards


def _expected(rows, support=10, top=2000):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered):
            ws = re.findall("[^ \t]+", piece)
            n[lang] += len(ws)
            for k in (1, 2, 3):
                f[lang].update(tuple(ws[i:i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, counts in f.items():
        some = {p: a for p, a in counts.items() if len(p) > 1 and a >= support}
        covered = {q for p, a in some.items() if len(p) == 3 for q in (p[:2], p[1:]) if 100 * a >= 50 * counts[q]}
        found = []
        for p, a in some.items():
            if p not in covered:
                score, _, left, right = min((10 ** 6 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -score) for i, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def _rows():
    rng = random.Random(4)
    stock = ["the", "The", "cat", "sat", "é", "日本", "x" * 300, "a-b", "of", "on", "ζ"]
    texts = [" ".join(rng.choices(stock, k=rng.randint(0, 60))) for _ in range(120)]
    texts = [re.sub(" ", lambda m: rng.choice([" "] * 8 + ["  ", "\t", ", ", ".", "\n", " ; ", "\xa0", "\r"]), t) for t in texts]
    rows = [(rng.choice(["en", "en", "de", None, "und", ""]), t) for t in texts]
    rows += [("en", "hot phrase here. " * 800)] * 3 + [("fr", "a a a a a a a a a a a a a"), ("fr", None), ("es", ""), (None, None), ("en", " . ! "), ("es", "one two " * 4)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(t, lang, 1, "k", 2) for lang, t in _rows()], "text string, lang string, block long, key string, a int").repartition(4)


@pytest.mark.parametrize("setting", [{}, {"block_bytes": 500, "shards": 3}, {"block_bytes": 2000, "shards": 40, "top": 7}, {"support": 3}])
def test_whole_table(docs, setting):
    got = sorted(tuple(r) for r in c.collocations(docs, **setting).collect())
    assert got == _expected(_rows(), setting.get("support", 10), setting.get("top", 2000))


def test_empty_table(docs):
    assert c.collocations(docs.where("1 = 0")).count() == 0


def test_registered_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("lang", "text").collect()]
    assert sorted(tuple(r) for r in c.op11_son_collocations(spark, sf).collect()) == _expected(rows)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.dictionaries(st.integers(0, 12), st.integers(1, 6), max_size=8)), max_size=12), st.integers(1, 12))
def test_shards_lose_no_frequent_phrase(lists, support):
    size = [sum(sum(d.values()) for s, d in lists if s == shard) for shard in range(4)]
    local = [max(1, -(-support * x // max(sum(size), 1))) for x in size]
    rows = [(s, np.array(sorted(d), np.uint64), np.array([d[k] for k in sorted(d)], np.uint64)) for s, d in lists]
    total = collections.Counter()
    for _, d in lists:
        total.update(d)
    phrases, counts = c.frequent(rows, local, support)
    assert dict(zip(phrases.tolist(), counts.tolist())) == {k: v for k, v in total.items() if v >= support}


def test_products_beyond_64_bits():
    a, left, right = (np.array(x) for x in ([2 ** 40, 3, 2_999_999], [2 ** 41, 5, 2 ** 33], [2 ** 42 + 1, 7, 2 ** 32]))
    assert c._score(a, left, right).tolist() == [10 ** 6 * x * x // (y * z) for x, y, z in zip(a.tolist(), left.tolist(), right.tolist())]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2 ** 64 - 1), max_size=50, unique=True), st.integers(1, 9))
def test_ranges_keep_keys_and_order(keys, ranges):
    keys = np.array(sorted(keys), np.uint64)
    values = np.arange(len(keys)).astype(np.uint64)
    parts = list(shards.by_range(keys, values, ranges))
    assert len(parts) == ranges
    assert [int(k) for r, (raw, _) in enumerate(parts) for k in shards.keys_of(raw, r, ranges)] == keys.tolist()
    assert [int(v) for _, raw in parts for v in shards.unplanes(raw)] == values.tolist()
    assert all(r == int(k) * ranges >> 64 for r, (raw, _) in enumerate(parts) for k in shards.keys_of(raw, r, ranges))


def test_blocks_hold_every_row_once(docs):
    rows = docs.select("lang", "text")
    blocks = shards.blocked(rows, 700).collect()
    held = [shards.rows_of(pa.scalar(b.data, pa.binary())).to_pylist() for b in blocks]
    assert sorted((str(r["lang"]), str(r["text"])) for some in held for r in some) == sorted((str(x), str(y)) for x, y in _rows())
    assert len({b.block for b in blocks}) == len(blocks)
    sizes = [sum(len((r["text"] or "").encode()) for r in some) for some in held]
    assert sizes == [b.bytes for b in blocks] and all(len(some) == 1 or n <= 700 for n, some in zip(sizes, held))
