"""Histogram boosted trees against a plain fit and a plain walk, row by row and node by node."""

import math
import random

import numpy as np

from sqlprism.llm import quality as q


def _plain_fit(x, y, trees, depth):
    """The same trees with loops over rows, statistics and cuts: nested (feature, threshold, left, right) or a leaf."""
    cuts = [sorted(set(np.quantile([r[j] for r in x], np.linspace(0, 1, q.BINS)[1:-1]).tolist())) for j in range(len(x[0]))]
    share = sum(y) / len(y)
    start = math.log(share / (1 - share))
    total = [start] * len(y)
    out = []
    for _ in range(trees):
        p = [1 / (1 + math.exp(-t)) for t in total]
        g, h = [a - b for a, b in zip(p, y)], [a * (1 - a) for a in p]

        def grow(rows, level, g=g, h=h):
            if level == depth:
                return -q.RATE * sum(g[i] for i in rows) / (sum(h[i] for i in rows) + q.SHRINK)
            tg, th = sum(g[i] for i in rows), sum(h[i] for i in rows)
            best, at = 1e-9, None
            for j, cs in enumerate(cuts):
                for c in cs:
                    left = [i for i in rows if x[i][j] <= c]
                    lg, lh = sum(g[i] for i in left), sum(h[i] for i in left)
                    if lh < 1 or th - lh < 1:
                        continue
                    gain = lg ** 2 / (lh + q.SHRINK) + (tg - lg) ** 2 / (th - lh + q.SHRINK) - tg ** 2 / (th + q.SHRINK)
                    if gain > best + 1e-12:
                        best, at = gain, (j, c)
            j, c = at or (0, math.inf)
            return j, c, grow([i for i in rows if x[i][j] <= c], level + 1), grow([i for i in rows if x[i][j] > c], level + 1)

        tree = grow(list(range(len(y))), 0)
        out.append(tree)
        total = [t + _walk(tree, r) for t, r in zip(total, x)]
    return start, out


def _walk(tree, row):
    while isinstance(tree, tuple):
        j, c, left, right = tree
        tree = left if row[j] <= c else right
    return tree


def test_fit_and_walk_against_plain_trees():
    rng = random.Random(6)
    x = [[rng.random(), rng.choice([0.0, 1.0, 2.0]), rng.gauss(0, 1)] for _ in range(300)]
    y = [int(r[0] + 0.4 * r[1] + 0.2 * r[2] + rng.gauss(0, 0.2) > 1) for r in x]
    start, trees = _plain_fit(x, y, 6, 2)
    model = q.fit(np.array(x), np.array(y, float), trees=6, depth=2)
    new = [[rng.random() * 1.2, rng.choice([0.0, 1.0, 2.0, 3.0]), rng.gauss(0, 2)] for _ in range(200)]
    for rows in (x, new):
        want = [1 / (1 + math.exp(-(start + sum(_walk(t, r) for t in trees)))) for r in rows]
        assert np.allclose(model.score(np.array(rows)), want, atol=1e-9)


def test_statistics_of_very_long_and_odd_texts():
    texts = [b"", b" \n ", "é日 ".encode() * 50_000, b"x" * 200_000, b"One two. Three!\nOne two. Three!\n"]
    offsets = np.cumsum([0, *map(len, texts)])
    got = q.statistics(np.frombuffer(b"".join(texts), np.uint8), offsets)
    assert got.shape == (5, len(q.FEATURES)) and np.isfinite(got).all()
    for i, t in enumerate(texts):  # a text's statistics don't depend on what else is in the block
        alone = q.statistics(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        assert np.allclose(alone[0], got[i])
    named = dict(zip(q.FEATURES, got[4]))
    assert named["log_words"] == math.log1p(6) and named["distinct_lines"] == 0.5 and named["share_newline"] == 2 / 32
