"""Near-duplicates, substring dedup, quality, language-model scores and the pipeline against brute force."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sqlprism.llm import lm_scoring, near_dedup, quality, substring_dedup
from sqlprism.llm.blocks import mix
from sqlprism.llm.common import components, remainder


def words_of(text, lower=False):
    text = (text or "").translate({i: i + 32 for i in range(65, 91)}) if lower else text or ""
    return [w for w in re.split("[\x20\x09-\x0D]+", text) if w]


def near_components(rows):
    """component by (doc_id, text), by comparing every pair of sets."""
    rows = [r for r in dict.fromkeys(rows) if r[0] is not None]
    sets = []
    for _, t in rows:
        w = words_of(t, lower=True)
        sets.append(frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    root = list(range(len(rows)))

    def find(i):
        return i if root[i] == i else find(root[i])

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return {r: (len(sets[i]), least[find(i)]) for i, r in enumerate(rows)}


def test_near_duplicates(spark, docs, no_docs, texts):
    want = near_components(texts)
    hashed = {(r.doc_id, r.h): r.text for r in docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()}
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id, hashed[r.doc_id, r.row]], r
            assert r.kept == (r.doc_id == r.component_id)
    assert len({r.component_id for r in got}) < len(got) - 10
    assert near_dedup.near_duplicates(no_docs).count() == 0


def test_blocks_of_large_clusters(docs, texts, monkeypatch):
    monkeypatch.setattr(near_dedup, "SET_ROWS", 4)
    monkeypatch.setattr(near_dedup, "SIG_ROWS", 3)
    want = near_components(texts)
    got = near_dedup.near_duplicates(docs).where("doc_id between 200 and 299").collect()
    assert {r.doc_id: r.component_id for r in got} == {k[0]: v[1] for k, v in want.items() if k[0] and 200 <= k[0] < 300}


def test_superminhash_estimates_similarity():
    errors = []
    for seed in range(40):
        x = mix(np.arange(1, 401, dtype=np.uint64) + np.uint64(1000 * seed))
        sig = near_dedup.superminhash(np.concatenate([x[:300], x[100:]]), np.repeat([0, 1], 300), 2)
        assert all(len(set((s >> np.uint64(32)).tolist())) >= 1 and s.max() < np.uint64(127) << np.uint64(32) for s in sig)
        errors.append((sig[0] == sig[1]).mean() - 0.5)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 1.1 * math.sqrt(0.25 / 127)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 50)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(31)}, **{100 + i: 100 for i in range(50)}}


def test_substring_dedup(docs, no_docs, texts):
    earliest = {}
    order = lambda i: 1 << 62 if i is None else i
    for i, t in texts:
        w = words_of(t)
        for s in range(len(w) - 19):
            key = tuple(w[s:s + 20])
            earliest[key] = min(earliest.get(key, (1 << 63, 0)), (order(i), s))
    want = []
    for i, t in texts:
        w = words_of(t)
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            if earliest[tuple(w[s:s + 20])] < (order(i), s):
                gone[s:s + 20] = [True] * 20
        want.append((order(i), len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    out = substring_dedup.remove_repeats(docs)
    got = [(order(r.whole.doc_id), r.n_words, r.n_removed, r.kept) for r in out.collect()]
    assert sorted(got) == sorted(want)
    assert sum(w[2] for w in want) > 1000
    assert out.select("whole.*").columns == docs.columns
    assert substring_dedup.remove_repeats(no_docs).count() == 0


def test_symbols_inside_copies_are_equal():
    rng = np.random.default_rng(1)
    body = rng.integers(0, 9, 60).astype(np.uint64)
    sym = mix(np.concatenate([rng.integers(0, 9, 7), body, rng.integers(0, 9, 5), body]).astype(np.uint64))
    doc = np.repeat([0, 1], [67, 65])
    for level, (s, lo, hi) in enumerate(substring_dedup.recompress(sym, doc, 5)):
        inside = [{(a - at, b - at, int(x)) for x, a, b in zip(s, lo, hi) if at <= a and b <= at + 60} for at in (7 + 1, 72 + 3)]
        assert inside[0] == inside[1] and (level > 3 or inside[0])


def test_quality(spark, docs, no_docs, texts):
    ids = [i for i, t in texts if i is not None and t]
    labels = spark.createDataFrame([(i, 0 if i == 412 else 1, 0, "x") for i in ids] + [(None, 1, 0, "x"), (1, None, 0, "x"), (1, 1, 0, "x")],
                                   "doc_id long, quality int, toxic int, text string")
    model = quality.train(docs, labels)
    got = quality.score(docs, model).collect()
    assert len(got) == len(texts) and all(0 <= r.score <= 1 for r in got)
    empty = quality.train(no_docs, labels.where("1 = 0"))
    assert {r.score for r in quality.score(docs, empty).collect()} == {0.5}
    assert quality.score(no_docs, model).count() == 0


def test_trees_separate_classes():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(800, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x[:600], y[:600])
    assert ((model.score(x[600:]) >= 0.5) == y[600:]).mean() > 0.93


def test_held_out_quality(spark, sf_dir):
    got = quality.op5_boosted_tree_quality(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.8


@pytest.mark.parametrize(("order", "block_bytes"), [(1, 1 << 20), (2, 20_000), (3, 50_000)])
def test_scores(docs, no_docs, texts, order, block_bytes):
    start, prior = "<start>", lm_scoring.PRIOR
    rows = [(i, words_of(t, lower=True) + [None], zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0) for i, t in texts]
    counts = [collections.Counter() for _ in range(order + 1)]
    for _, t, held in rows:
        if not held:
            padded = [start] * (order - 1) + t
            for k in range(1, order + 1):
                counts[k].update(tuple(padded[e - k + 1:e + 1]) for e in range(order - 1, len(padded)))
                if k < order:
                    counts[k][(start,) * k] += 1
    train = sum(len(t) for _, t, held in rows if not held)
    distinct = len([k for k in counts[1] if k != (start,)])
    want = []
    for i, t, held in rows:
        padded = [start] * (order - 1) + t
        base = score = 0.0
        for e in range(order - 1, len(padded)):
            p = (counts[1][(padded[e],)] + 0.1) / (train + 0.1 * (distinct + 1))
            base += math.log10(p)
            for k in range(2, order + 1):
                gram = tuple(padded[e - k + 1:e + 1])
                p = (counts[k][gram] + prior * p) / (counts[k - 1][gram[:-1]] + prior)
            score += math.log10(p)
        want.append((i or -1, held, len(t), sum(counts[1][(w,)] > 0 for w in t), train, round(base, 4), round(score, 4)))
    got = lm_scoring.score_documents(docs, remainder("doc_id", 10) != 0, order=order, block_bytes=block_bytes).collect()
    assert sorted((r[0] or -1, *r[1:5], round(r[5], 4), round(r[6], 4)) for r in got) == sorted(want)
    assert lm_scoring.score_documents(no_docs, remainder("doc_id", 10) != 0).count() == 0


def test_different_texts_of_one_id_stay_apart(spark):
    rng = np.random.default_rng(3)
    x, y = (" ".join(f"{k}{i}" for i in rng.permutation(40)) for k in "xy")
    rows = [(2, x), (4, y), (4, x + " more")]
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(2, 36): (2, True), (4, 36): (4, True), (4, 37): (2, False)}


def test_small_sets_lose_no_link(spark):
    rng = np.random.default_rng(9)
    rows, sets = [], []
    for i in range(6000):  # texts of 5 to 16 words, each next to one that adds, drops or changes words at its ends
        words = [f"w{w}" for w in rng.integers(0, 10 ** 9, rng.integers(5, 15))]
        other = (words + [f"v{i}"], words[1:], [f"u{i}", *words[1:], "t"], words[:-2] + ["s"])[i % 4]
        for k, some in enumerate((words, other)):
            rows.append((2 * i + k, " ".join(some)))
            sets.append({tuple(some[j:j + 5]) for j in range(max(len(some) - 4, 1))})
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(6000):
        a, b = sets[2 * i], sets[2 * i + 1]
        assert (got[2 * i + 1] == 2 * i) == (100 * len(a & b) >= 75 * len(a | b)), (a, b)
    assert all(len(near_dedup.subset_keys(np.arange(n, dtype=np.uint64))) == k for n, k in ((0, 0), (3, 1), (4, 5), (8, 37), (12, 299), (13, 0)))


def test_contexts_of_two_words_count(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(["x a c", "y a d"] * 20)], "doc_id long, text string")
    two, three, built_in = (sum(r.score for r in lm_scoring.score_documents(docs, F.lit(True), **o).collect()) for o in ({"order": 2}, {"order": 3}, {}))
    assert abs(built_in - three) < 1e-9 and three > two + 1


def test_scores_without_training_rows(docs, texts):
    got = lm_scoring.score_documents(docs, F.lit(False)).collect()
    assert len(got) == len(texts) and all(r.train_tokens == 0 and r.n_known == 0 and abs(r.score - r.base_score) < 1e-9 for r in got)


def test_pipeline_stages(spark, docs, no_docs, texts, sf_dir):
    import corpus_pipeline as cp

    assert [n for n, _ in cp.STAGES] == ["quality classifier", "near-duplicates", "substring dedup", "packing"]
    kept = cp.one_of_each(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    want = near_components(texts)
    ids = sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in kept.select("doc_id", "text").collect())
    assert ids == sorted({(-1 if i is None else i, t or "") for i, t in texts if i is None or want[i, t][1] == i})
    cleaned = cp.without_repeats(spark, docs, sf_dir)
    assert cleaned.columns == docs.columns and cleaned.where("n_chars <> length(text)").count() == 0
    for name, stage in cp.STAGES:
        assert stage(spark, no_docs, sf_dir).count() == 0, name


def test_pipeline_run(spark, sf_dir):
    import corpus_pipeline as cp

    good = cp.good_quality(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    assert good.join(labels, "doc_id").where("quality = 0").count() <= 2
    assert labels.where("quality = 1").join(good, "doc_id", "left_anti").count() <= 2
    rows = cp.run(spark, sf_dir).select("doc_id", "start", "length", "doc_tokens").toPandas()
    assert 0 < rows.doc_id.nunique() < good.count()
    assert rows.groupby("doc_id").length.sum().eq(rows.groupby("doc_id").doc_tokens.first()).all()


def test_digest_columns(spark, sf_dir):
    r = substring_dedup.op3_recompression_substring_dedup(spark, sf_dir).where("n_words = 0 OR n_removed = 0").limit(1).first()
    text = spark.read.parquet(f"{sf_dir}/documents.parquet").where(f"doc_id = {r.doc_id}").first().text
    assert r.kept_sha256 == hashlib.sha256(" ".join(words_of(text)).encode()).hexdigest()
