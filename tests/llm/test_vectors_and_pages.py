"""Searches, URL filter and WARC archives against brute force."""

import gzip
import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sqlprism.llm import ann, queries, topk, url_filter, vectors, warc


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 16)).astype(np.float32) / 4
    x[100:200] = x[100]  # one very common vector: ties
    x[300] = 0
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(800, None), (850, [1.0, None] + [0.0] * 14), (900, [float("nan")] * 16), (950, [float("inf")] * 16), (1000, []),
             (7, rows[7][1]), (1050, [0.5, 0.25]), (1051, [0.5, -0.25]), (None, rows[1][1]), (1100, [3e30] * 16)]
    return spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, label int, dim int").repartition(4), rows


def usable(rows, zero=True):
    out = {}
    for i, v in rows:
        if i is not None and v and None not in v and np.isfinite(np.float32(v)).all() and (zero or any(v)):
            out[i] = np.float32(v).astype(float)
    return out


def test_exact_top_k(table, monkeypatch):
    monkeypatch.setattr(vectors, "CANDIDATES", 128)
    monkeypatch.setattr(vectors, "QUERIES", 4)
    df, rows = table
    whole = {i: np.clip(np.floor(256 * v), -topk.LIMIT, topk.LIMIT).astype(int) for i, v in usable(rows).items()}
    want = []
    for q, x in whole.items():
        if q % 50 == 0:
            scores = sorted((-int(x @ y), i) for i, y in whole.items() if i != q and len(x) == len(y))[:5]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    assert sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect()) == sorted(want)


def test_nearest_neighbours(table):
    df, rows = table
    clean = [r for r in rows if r[0] != 1100]
    whole = usable(clean, zero=False)
    got = {}
    for r in ann.nearest(df.where("vec_id <> 1100"), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for q, x in whole.items():
        if q % 20 == 0:
            same = {i: float(x @ y) for i, y in whole.items() if i != q and len(x) == len(y)}
            best = sorted(same.values(), reverse=True)[:20]
            found = sorted(got.get(q, []))
            assert [r for r, _, _ in found] == list(range(1, len(best) + 1))
            assert all(abs(same[i] - s) < 1e-12 for _, i, s in found)
            assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
            hits += sum(s >= best[-1] - 1e-12 for _, _, s in found)
            total += len(best)
    assert hits >= 0.9 * total and 300 not in got


def test_no_vectors(table):
    empty = table[0].where("1 = 0")
    assert topk.top_k(empty, F.col("vec_id") % 50 == 0).count() == 0
    assert ann.nearest(empty, F.col("vec_id") % 20 == 0).count() == 0


def test_url_filter(spark):
    entries = [("a", "block", "domain", "bad.org", "add", 10), ("a", "block", "domain", "bad.org", "remove", 20), ("a", "block", "domain", "bad.org", "add", 30),
               ("b", "block", "path", "ok.org/x", "add", 5), ("b", "block", "path", "ok.org/x", "add", 7), ("w", "allow", "domain", "good.bad.org", "add", 0),
               ("t", "block", "domain", "tie.org", "add", 5), ("t", "block", "domain", "tie.org", "remove", 5), (None, "block", "domain", "ok.org", "add", 0)]
    cases = [("http://bad.org/", 9, 0, False), ("http://bad.org/", 10, 1, True), ("https://User@WWW.Bad.org:80/q", 15, 1, True), ("http://bad.org/", 20, 0, False),
             ("http://bad.org/", 31, 1, True), ("http://good.bad.org/a?b#c", 12, 2, False), ("http://ok.org/x/y", 6, 1, True), ("http://ok.org/x/y", 9, 1, True),
             ("http://ok.org/xy", 9, 0, False), ("http://notbad.org/", 15, 0, False), ("http://tie.org", 9, 0, False), ("bad.org", 15, 0, False), ("", 15, 0, False),
             (None, 15, 0, False), ("http://bad.org/", None, 0, False), ("http://bad.org/", 15, 1, True), ("http://bad.org/", 15, 1, True)]
    captures = spark.createDataFrame([(None if i == 16 else 5 if i == 15 else i, u, t, "x") for i, (u, t, _, _) in enumerate(cases)] , "page_id long, url string, fetched_at long, host string")
    rules = spark.createDataFrame(entries, "list string, role string, kind string, key string, action string, at long")
    got = sorted(((-1 if r.page_id is None else r.page_id), r.url or "", r.n_rules, r.blocked) for r in url_filter.filter_captures(captures, rules).collect())
    want = sorted((-1 if i == 16 else 5 if i == 15 else i, u or "", 0 if i == 16 else n, False if i == 16 else b) for i, (u, _, n, b) in enumerate(cases))
    assert got == want  # a capture without id matches nothing
    assert url_filter.filter_captures(captures.where("1 = 0"), rules).count() == 0
    assert {r.n_rules for r in url_filter.filter_captures(captures, rules.where("1 = 0")).collect()} == {0}


def pages_frame(spark):
    html = ["a" * 2000, "b" * 999, "é" * 600, "c" * 5000, "<html>\r\n\r\nWARC/1.1\r\n" + "x\n" * 900]
    rows = [(i, f"http://h/{i}?ü=\n", html[i % 5]) for i in range(60)] + [(100, None, None), (101, "", ""), (None, "u", html[0]), (7, "http://h/7?ü=\n", html[2]), (None, "v", None)]
    return spark.createDataFrame([(i, u, h, "y") for i, u, h in rows], "page_id long, url string, html string, digest string").repartition(3), rows


def test_warc_round_trip(spark, tmp_path, monkeypatch):
    df, rows = pages_frame(spark)
    latest = {}
    for i, _, h in rows:
        if i is not None:
            latest[h or ""] = max(latest.get(h or "", i), i)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        again = len(raw) >= 1000 and (i is None or i < latest[h])
        want.append((-1 if i is None else i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", latest[h] if again else -1))
    got = warc.round_trip(df, f"file://{tmp_path}/w").collect()
    assert sorted((-1 if r[0] is None else r[0], r[1], r[2], r[3], -1 if r[4] is None else r[4]) for r in got) == sorted(want)
    assert warc.round_trip(df.where("1 = 0"), f"file://{tmp_path}/e").count() == 0
    files = [f for f in (tmp_path / "w").iterdir() if f.suffix == ".gz"]
    assert sum(gzip.decompress(f.read_bytes()).count(b"WARC-Record-ID") for f in files) == len(rows)


def test_archives_are_read_in_many_tasks(spark, tmp_path):
    df, rows = pages_frame(spark)
    files = warc.write_archives(df, f"file://{tmp_path}/w")
    for width, least in ((1000, 4), (1 << 30, 1)):
        read = warc.read_archives(files, width)
        assert read.count() == len(rows) and read.rdd.getNumPartitions() >= least


class Memory:
    def __init__(self, raw):
        self.raw = raw

    def read_at(self, n, at):
        return self.raw[at:at + n]


@pytest.mark.parametrize("width", [1, 7, 100, 5000, 1 << 20])
def test_ranges_own_every_record_once(width):
    rng = np.random.default_rng(4)
    bodies = [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in (0, 10, 3000, 200_000)] + [warc.MAGIC * 50]
    bodies.append(gzip.compress(b"no archive record"))
    plain = [warc.record(i, "http://x", b, hashlib.sha1(b).hexdigest(), None) for i, b in enumerate(bodies)]

    def member(raw, level):
        c = zlib.compressobj(level, zlib.DEFLATED, 31)
        return c.compress(raw) + c.flush()

    data = b"".join(member(p, level) for p, level in zip(plain, (9, 6, 0, 1, 0, 0)))  # stored blocks hold bare magic bytes
    step = max(width, len(data) // 400 if width < 100 else width)
    found = [r for s in range(0, len(data), step) for r in warc.records(warc.Source(Memory(data), len(data)), s, min(s + step, len(data)))]
    assert [raw for _, raw in found] == plain
    assert [warc.parse(raw)[1] for _, raw in found] == bodies


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, sf_dir, name):
    from oracles import compare

    ok, message = compare.compare(queries.QUERIES[name](spark, sf_dir), compare.duck_connect(sf_dir), queries.ORACLES[name])
    assert ok, message
