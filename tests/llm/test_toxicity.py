"""Deobfuscation against all readings of a token, and toxicity scores on held-out and disguised texts."""

import itertools
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sqlprism.llm import toxicity as t
from sqlprism.llm.common import table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def corpus(spark):
    return table(spark, SF, "documents").select("doc_id", "text")


@pytest.fixture(scope="module")
def decoder(corpus):
    return t.Decoder(t.language_model(corpus))


@pytest.fixture(scope="module")
def model(spark, corpus, decoder):
    return t.train(corpus, table(spark, SF, "labels"), decoder)


def test_language_model_counts_every_text(spark, corpus, decoder):
    total = np.zeros(t.SYMBOLS ** 3)
    for row in corpus.collect():
        symbols = [0, 0]
        for word in (row.text or "").lower().split():
            symbols += [*map(t.symbol, word), 0, 0]
        for a, b, c in zip(symbols, symbols[1:], symbols[2:]):
            total[(a * t.SYMBOLS + b) * t.SYMBOLS + c] += 1
    got = t.trigrams([r.text for r in corpus.collect() if r.text])
    inner = np.arange(t.SYMBOLS ** 3)[t.SYMBOLS:]  # texts are put together with boundaries, so trigrams within boundaries differ
    assert (got[inner] == total[inner]).all()
    assert np.allclose(np.exp(np.array(decoder.model)).sum(2), 1, atol=1e-4)


@pytest.mark.parametrize("written, word", [("1d10t", "idiot"), ("i.d.i.o.t", "idiot"), ("i d i o t", "idiot"), ("idiiiiot!!", "idiot"), ("$tup!d", "stupid"), ("m0r0n,", "moron"),
                                           ("l-o-s-e-r", "loser"), ("cl0wn", "clown"), ("d1sgust1ng", "disgusting"), ("idiot", "idiot"), ("p@thet1c.", "pathetic"), ("s c u m", "scum")])
def test_disguises(decoder, written, word):
    assert decoder.restore(written) == [word]


def test_plain_text_stays(decoder):
    for word in ("the", "thinging", "chónas", "größe", "4691172130117446", "32.198.59.21", "日本"):
        assert decoder.restore(word) == [word]
    assert decoder.restore("") == decoder.restore(",.!") == []
    assert len("".join(decoder.restore("ab1" * 5000))) == 15_000


@settings(max_examples=150, deadline=None)
@given(st.text("ait1!.-0 é", min_size=1, max_size=5))
def test_viterbi_finds_the_best_reading(decoder, written):
    written = re.sub(" +", " ", written)
    runs = [(m.group(1), len(m.group())) for m in re.finditer(r"(.)\1*", written)]
    best = -np.inf
    for ways in itertools.product(*(decoder.arcs(*r) for r in runs)):
        symbols = [0, 0]
        for c in "".join(w for w, _ in ways):
            symbols += [0, 0] if c == " " else [t.symbol(c)]
        symbols.append(0)
        best = max(best, -sum(c for _, c in ways) + sum(decoder.model[a][b][c] for a, b, c in zip(symbols, symbols[1:], symbols[2:])))
        got = decoder.decode(written)
    scores = [-sum(c for _, c in ways) + sum(decoder.model[a][b][z] for a, b, z in zip(s, s[1:], s[2:]))
              for ways in itertools.product(*(decoder.arcs(*r) for r in runs)) if "".join(w for w, _ in ways) == got
              for s in [[0, 0, *[z for c in got for z in ([0, 0] if c == " " else [t.symbol(c)])], 0]]]
    assert max(scores) == pytest.approx(best, abs=1e-4)


def test_held_out_rows(spark, corpus, decoder, model):
    marked = {r.doc_id: r.toxic for r in table(spark, SF, "labels").collect()}
    scores = {r.doc_id: r.score for r in t.score(corpus, decoder, model).collect()}
    held = [i for i in marked if i in scores and zlib.crc32(str(i).encode()) % 5 == 0]
    clean, toxic = ([scores[i] for i in held if marked[i] == y] for y in (0, 1))
    assert np.mean(np.array(clean) < 0.5) > 0.98 and np.mean(toxic) > 0.4
    assert np.mean([a > b for a in toxic for b in clean]) > 0.85  # area under the curve


def test_disguised_words_count_like_plain_ones(spark, decoder, model):
    rng = random.Random(2)
    hide = [lambda w: w, lambda w: w.replace("o", "0").replace("i", "1"), lambda w: ".".join(w), lambda w: " ".join(w), lambda w: w[:2] + w[2] * 4 + w[3:], lambda w: w.upper()]
    rows = []
    for i, h in enumerate(hide):
        rows.append((i, f"The thing {h('idiot')} of the {h('moron')} and {h('loser')} onion. {h('clown')}"))
    rows += [(100, "The thing of the and onion. " + " ".join(rng.choices(["the", "thing", "of", "and"], k=40))), (101, None), (102, ""), (103, "1 2 3 4 5 !! $$ " * 200), (104, "x" * 50_000)]
    scores = {r.doc_id: r.score for r in t.score(spark.createDataFrame(rows, "doc_id long, text string"), decoder, model).collect()}
    assert all(scores[i] > 0.5 for i in range(len(hide))), scores
    assert all(scores[i] < 0.5 for i in range(100, 105)), scores


def test_odd_tables(spark, docs, no_docs, texts, decoder):
    labels = spark.createDataFrame([(i, int((i or 0) % 3 == 0) if (i or 0) % 7 else None, 0) for i, _ in texts] + [(None, 1, 0), (10 ** 9, 1, 0), (1, 0, 0)],
                                   "doc_id long, toxic int, quality int")
    own = t.Decoder(t.language_model(docs))
    rows = t.score(docs, own, t.train(docs, labels, own)).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _ in texts) and all(0 <= r.score <= 1 for r in rows)
    none = t.train(docs, labels.where("1 = 0"), own)
    assert all(r.score == pytest.approx(0.5) for r in t.score(docs, own, none).collect())
    ones = t.train(docs, labels.where("toxic = 1"), own)
    assert all(r.score > 0.99 for r in t.score(docs, own, ones).collect())
    empty = t.Decoder(t.language_model(no_docs))
    assert t.score(no_docs, empty, t.train(no_docs, labels, empty)).count() == 0
    assert t.restored(docs, own).count() == len(texts)


def test_sample_is_bounded_after_the_join(spark, docs, texts):
    labels = spark.createDataFrame([(i, i % 2) for i in range(3000)], "doc_id long, toxic int")
    rows = t._sample(docs, labels, 10).collect()
    known = {i for i, _ in texts if i is not None and i < 3000 and zlib.crc32(str(i).encode()) % 5}
    assert len(rows) == 10 and len({r.doc_id for r in rows}) == 10 and {r.doc_id for r in rows} <= known
    assert len(t._sample(docs, labels, 10_000).collect()) == len(known)


def test_registered_query(spark):
    rows = t.op12_noisy_channel_toxicity(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == table(spark, "/root/testdata/sf0.001", "documents").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for r in rows)
