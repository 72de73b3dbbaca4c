"""Quality classifier: histogram gradient-boosted trees over document statistics (``op5_boosted_tree_quality``).

Statistics of the whole text (``FEATURES``: character classes, word lengths, repetition, lines) are computed
block by block in numpy; labels, lang, source and doc_id are never among them. The trees are fitted with the
logistic loss on labelled rows whose crc32(doc_id as text) mod 5 isn't 0: at most ``SAMPLE_ROWS`` of them, those
of least hash of doc_id (a documented bound; fewer labelled rows are all used). That bounded sample is
the only thing that reaches the driver. Fitting bins every statistic by quantiles and sums gradients
per (node, statistic, bin); the trees have a fixed depth and are stored as flat arrays, so that scoring walks
all trees of all rows of a block at once, one vectorised step per level. Scoring is one pass over the
documents without a shuffle.

Defined cases: null texts are empty, and an empty text gets a score like any other; several labels of
one doc_id count by their mean (1 from 0.5 on); null labels are ignored; without usable labels of both
classes the score is the share of label 1 (0.5 without labels); repeated rows are scored each.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlprism.llm.blocks import find_words, sequence_hashes, text_blocks, word_hashes
from sqlprism.llm.common import map_arrow, remainder, table

SAMPLE_ROWS = 20_000
HELD_OUT = 5
THRESHOLD = 0.3
TREES, DEPTH, BINS, RATE, SHRINK = 80, 4, 64, 0.15, 1.0

_CLASSES = ("upper", "lower", "digit", "space", "newline", "high", "pipe", "bang", "sentence", "symbol")
_CLASS = np.full(256, _CLASSES.index("symbol"))
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 5
_CLASS[[32, 9, 11, 12, 13]], _CLASS[10], _CLASS[ord("|")], _CLASS[ord("!")] = 3, 4, 6, 7
_CLASS[[ord(c) for c in ".,;:?'\"-()"]] = 8

FEATURES = ("log_bytes", "log_words", *(f"share_{c}" for c in _CLASSES), "word_length", "word_length_sd", "longest_word",
            "short_words", "distinct_words", "distinct_grams", "distinct_lines", "line_bytes", "sentence_ends", "odd_ends")


def _distinct(keys: np.ndarray, doc: np.ndarray, documents: int) -> np.ndarray:
    """Distinct keys per document over keys per document (1 for none)."""
    order = np.lexsort((keys, doc))
    k, d = keys[order], doc[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
    return np.bincount(d[new], minlength=documents) / np.maximum(np.bincount(doc, minlength=documents), 1) + (np.bincount(doc, minlength=documents) == 0)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Matrix (documents x FEATURES) of the texts ``data[offsets[d]:offsets[d+1]]``."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    byte_doc = np.repeat(np.arange(n), size)
    classes = np.bincount(byte_doc * len(_CLASSES) + _CLASS[data], minlength=n * len(_CLASSES)).reshape(n, -1)
    words = find_words(data, offsets, lower=True)
    hashes, doc = word_hashes(words), words.doc
    lengths = (words.ends - words.starts).astype(float)
    count = np.diff(words.first)
    safe = np.maximum(count, 1)
    mean = np.bincount(doc, lengths, n) / safe
    spread = np.sqrt(np.maximum(np.bincount(doc, lengths ** 2, n) / safe - mean ** 2, 0))
    longest = np.zeros(n)
    np.maximum.at(longest, doc, lengths)
    grams = sequence_hashes(hashes, 4)
    inside = doc[:len(grams)] == doc[len(doc) - len(grams):]
    # lines: words grouped by the newlines before them
    line = np.cumsum(data == 10)
    line_of = line[words.starts] if len(doc) else np.zeros(0, np.int64)
    new = np.ones(len(doc), bool)
    new[1:] = (line_of[1:] != line_of[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    line_keys = np.add.reduceat(hashes * (np.arange(len(doc)).astype(np.uint64) - np.repeat(at, np.diff(np.append(at, len(doc)))).astype(np.uint64) + np.uint64(1)), at) if len(at) else hashes
    last = words.data[words.ends - 1] if len(doc) else np.zeros(0, np.uint8)
    ends = np.isin(last, np.frombuffer(b".?", np.uint8))
    odd = np.isin(last, np.frombuffer(b"!%$&*#|", np.uint8))
    return np.column_stack([
        np.log1p(size), np.log1p(count), classes / np.maximum(size, 1)[:, None], mean, spread, np.log1p(longest),
        np.bincount(doc, lengths <= 3, n) / safe, _distinct(hashes, doc, n), _distinct(grams[inside], doc[:len(grams)][inside], n),
        _distinct(line_keys, doc[at], n), np.log1p(size / (classes[:, 4] + 1)),
        np.bincount(doc, ends, n) / safe, np.bincount(doc, odd, n) / safe])


class Trees(NamedTuple):
    """Complete trees of one depth as arrays (trees x nodes): node i has children 2 i + 1 and 2 i + 2."""

    start: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 per row."""
        trees = np.arange(self.feature.shape[0])
        node = np.zeros((len(x), len(trees)), np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(int(np.log2(self.feature.shape[1] + 1)) if len(trees) else 0):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.threshold[trees, node])
        total = self.start + self.leaf[trees, node - self.feature.shape[1]].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Boosted trees for labels 0 and 1."""
    share = float(y.mean()) if len(y) else 0.5
    if share in (0.0, 1.0) or not len(y):
        return Trees(float(np.clip(np.log(max(share, 1e-13) / max(1 - share, 1e-13)), -30, 30)),
                     np.zeros((0, 2 ** depth - 1), int), np.zeros((0, 2 ** depth - 1)), np.zeros((0, 2 ** depth)))
    f = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])) for j in range(f)]
    binned = np.column_stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)])
    offset = binned + np.arange(f) * BINS
    start = float(np.log(share / (1 - share)))
    total = np.full(len(y), start)
    inner = 2 ** depth - 1
    features, thresholds, leaves = np.zeros((trees, inner), int), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            width = 2 ** level
            cell = ((node - (width - 1))[:, None] * (f * BINS) + offset).ravel()
            sg, sh = (np.bincount(cell, np.repeat(v, f), width * f * BINS).reshape(width, f, BINS) for v in (g, h))
            lg, lh = sg.cumsum(axis=2), sh.cumsum(axis=2)
            tg, th = lg[:, :, -1:], lh[:, :, -1:]
            gain = lg ** 2 / (lh + SHRINK) + (tg - lg) ** 2 / (th - lh + SHRINK) - tg ** 2 / (th + SHRINK)
            gain[(lh < 1) | (th - lh < 1)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            for i, b in enumerate(best):
                j, k = divmod(int(b), BINS)
                if gain[i, j, k] > 1e-9 and k < len(cuts[j]):
                    features[t, width - 1 + i], thresholds[t, width - 1 + i] = j, cuts[j][k]
            node = 2 * node + 1 + (x[np.arange(len(x)), features[t, node]] > thresholds[t, node])
        at = node - inner
        leaves[t] = -RATE * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + SHRINK)
        total += leaves[t, at]
    return Trees(start, features, thresholds, leaves)


def _features(batch: pa.RecordBatch):
    for row, last, data, offsets in text_blocks(batch.column("text")):
        x = statistics(data, offsets)
        yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(row, last - row) for c in ("doc_id", "label")),
                                          pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "label", "x"])


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Trees:
    """Trees fitted on the training rows among ``docs`` that ``labels`` (doc_id, quality) marks."""
    marked = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(remainder("doc_id", HELD_OUT) != 0) \
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    sample = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)  # bounded, so it can be broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    rows = map_arrow(texts.select("doc_id", "label", "text"), _features, "doc_id long, label int, x array<double>").toArrow()
    rows = rows.sort_by("doc_id")
    x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES)) if rows.num_rows else np.zeros((0, len(FEATURES)))
    return fit(x, rows.column("label").to_numpy().astype(float))


def score(docs: DataFrame, model: Trees) -> DataFrame:
    """(whole, score) per row of ``docs``: the row as a struct, and the probability of label 1."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("whole")).select("whole", F.col("whole.text").alias("text"))

    def run(batch: pa.RecordBatch):
        for row, last, data, offsets in text_blocks(batch.column("text")):
            yield pa.RecordBatch.from_arrays([batch.column("whole").slice(row, last - row), pa.array(model.score(statistics(data, offsets)))],
                                             names=["whole", "score"])

    return map_arrow(rows, run, f"whole {rows.schema['whole'].dataType.simpleString()}, score double")


def op5_boosted_tree_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select(F.col("whole.doc_id").cast("long").alias("doc_id"), "score") \
        .select("doc_id", (remainder("doc_id", HELD_OUT) == 0).alias("held_out"), "score",
                F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
