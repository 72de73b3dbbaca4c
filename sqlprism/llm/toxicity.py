"""Toxicity scores after noisy-channel deobfuscation (``op12_noisy_channel_toxicity``).

Channel. A written word may hide its letters behind look-alike digits and signs (``LEET``), signs or spaces put between
letters, and repeated letters. All readings of a token (or of a run of single characters between spaces) form a lattice:
an arc emits a letter as written, the letter a sign stands for, one or two of a run of equal letters, or nothing for a
separator; every change costs a fixed log-probability (``COSTS``). Viterbi decoding finds the reading that is
likeliest under channel and character language model together. A token of letters without repetition has
one reading and isn't decoded; equal tokens are decoded once per worker until its table is full.

Language model. Character trigrams with backoff to bigrams and letters over an alphabet of fixed size (a-z, the
Latin-1 letters, one symbol each for other letters, digits, signs, and the word boundary), counted over all
documents; its size is bounded by the alphabet, so it is collected and sent to the tasks.

Score. Features are the restored words and their first ``PREFIX`` letters (from ``PREFIX + 1`` letters on). Their
log-odds come from at most ``SAMPLE_ROWS`` labelled rows whose crc32(doc_id as text) mod 5 isn't 0, those of least hash
of doc_id (a documented bound, put on labelled ids that have a document), one row per id; of rows that share a
minimum hash of their word triples (copies, near copies) one counts. Features of ``FEATURE_ROWS`` rows and more are
kept, at most ``FEATURES`` of them. A logistic model over the largest log-odds of a document, fitted with
log-odds of the other half of the sample, gives the probability.

Defined cases: null texts are empty, and empty texts get a score; several labels of a doc_id count by their mean (1 from
0.5 on); null labels are ignored; of several rows of a labelled doc_id that of least hash is learned from, all are scored;
without usable labels of both classes the score is the share of label 1 (0.5 without labels). Tokens of over ``CHUNK``
characters are read in chunks of that length. Other columns are not read.
"""

from __future__ import annotations

import math
import re
import uuid
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlprism.llm.blocks import find_words, mix, sequence_hashes, stream, text_blocks, word_hashes
from sqlprism.llm.common import cut, map_arrow, remainder, table

SAMPLE_ROWS, FEATURES, FEATURE_ROWS = 20_000, 50_000, 4
HELD_OUT, THRESHOLD = 5, 0.5
PREFIX, CHUNK, MEMO = 5, 64, 600_000

#: Letters that digits and signs stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
        "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
SEPARATORS = " .-_*~'`^,:;/\\"
COSTS = {"leet": 3.0, "repeat": 4.0, "drop": 2.0}

_LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
_OTHER, _DIGIT, _SIGN = (len(_LETTERS) + k for k in (1, 2, 3))
SYMBOLS = len(_LETTERS) + 4  # 0: boundary
_OF = {c: i for i, c in enumerate(_LETTERS, 1)}


def symbol(char: str) -> int:
    return _OF.get(char) or (0 if char.isspace() else _OTHER if char.isalpha() else _DIGIT if char.isdigit() else _SIGN)


_LOW = np.array([symbol(chr(c)) for c in range(0x250)], np.int64)


def trigrams(texts: list[str]) -> np.ndarray:
    """Counts of the symbol trigrams of texts; a boundary is two symbols wide."""
    codes = np.frombuffer(("\n".join(["", *texts, ""])).lower().encode("utf-32-le", "replace"), np.uint32)
    symbols = np.full(len(codes), _OTHER)
    low = codes < len(_LOW)
    symbols[low] = _LOW[codes[low]]
    solid = symbols > 0
    symbols = symbols[solid | np.concatenate([[True], solid[:-1]])]
    symbols = np.repeat(symbols, np.where(symbols == 0, 2, 1))
    return np.bincount((symbols[:-2] * SYMBOLS + symbols[1:-1]) * SYMBOLS + symbols[2:], minlength=SYMBOLS ** 3)


def language_model(docs: DataFrame) -> np.ndarray:
    """log p(third | first two) of every symbol trigram, from all texts of ``docs``."""

    def count(batches):
        total, texts, size = np.zeros(SYMBOLS ** 3, np.int64), [], 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                if text:
                    texts.append(text)
                    size += len(text)
                if size > 1 << 20:
                    total += trigrams(texts)
                    texts, size = [], 0
        if texts:
            total += trigrams(texts)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["gram", "n"])

    rows = docs.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()  # at most SYMBOLS ** 3
    counts = np.zeros(SYMBOLS ** 3)
    counts[rows.column("gram").to_numpy()] = rows.column("n").to_numpy()
    counts = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    one = (counts.sum((0, 1)) + 1) / (counts.sum() + SYMBOLS)
    two = counts.sum(0)
    two = (two + 5 * one) / (two.sum(1, keepdims=True) + 5)
    return np.log((counts + 5 * two) / (counts.sum(2, keepdims=True) + 5)).astype(np.float32)


_AMBIGUOUS = re.compile(r"(.)\1|[^a-zß-öø-ÿ]", re.S)
_SPACED = re.compile(r"(?<!\S)\S(?:[ \t]\S){2,}(?!\S)")
_ENDS = ".,;:!?\"')]}»…"
_STARTS = "\"'([{«¿¡"


class Decoder:
    """Readings of tokens under a language model."""

    def __init__(self, model: np.ndarray):
        self.model = [[row.tolist() for row in plane] for plane in model]
        self.known = {}

    def arcs(self, char: str, times: int) -> list[tuple[str, float]]:
        """(emitted text, cost) of the readings of a run of one character."""
        ways = []
        for c, cost in ((char, 0.0), *((c, COSTS["leet"]) for c in LEET.get(char, ""))):
            if c.isalpha():
                if times == 1:
                    ways.append((c, cost))
                else:
                    ways += [(c, cost + COSTS["repeat"]), (2 * c, cost + (0.0 if times == 2 else COSTS["repeat"]))]
            else:
                ways.append((" " if c.isspace() else c * times, cost))
        if char in SEPARATORS:
            ways.append(("", COSTS["drop"]))
        return ways

    def _steps(self, char: str, times: int) -> list[tuple]:
        """The arcs with the symbols they emit; a space is a boundary of two."""
        steps = self.known.get((char, times))
        if steps is None:
            steps = [(text, cost, tuple(s for c in text for s in ((0, 0) if c == " " else (symbol(c),)))) for text, cost in self.arcs(char, times)]
            if len(self.known) < MEMO:
                self.known[char, times] = steps
        return steps

    def decode(self, written: str) -> str:
        """Likeliest reading of a lower-cased token, or of tokens between single spaces."""
        model, paths = self.model, {(0, 0): (0.0, None)}
        for run in re.finditer(r"(.)\1*", written, re.S):
            new: dict = {}
            steps = self._steps(run.group(1), run.end() - run.start())
            for (a, b), (score, path) in paths.items():
                for text, cost, symbols in steps:
                    s, x, y = score - cost, a, b
                    for z in symbols:
                        s += model[x][y][z]
                        x, y = y, z
                    old = new.get((x, y))
                    if old is None or s > old[0]:
                        new[x, y] = (s, (path, text) if text else path)
            paths = new
        _, path = max(((s + model[a][b][0], p) for (a, b), (s, p) in paths.items()), key=lambda x: x[0])
        out = []
        while path is not None:
            path, text = path
            out.append(text)
        return "".join(reversed(out))

    def restore(self, token: str) -> list[str]:
        """Words that a token, or a run of single characters, stands for."""
        token = token.rstrip(_ENDS).lstrip(_STARTS)
        if not _AMBIGUOUS.search(token):
            return [token] if token else []
        out = []
        for at in range(0, len(token), CHUNK):
            piece = token[at:at + CHUNK]
            out.append(self.decode(piece) if any(c.isalpha() for c in piece) else piece)
        return "".join(out).split()

    def text(self, text: str | None) -> tuple[set[str], list[str]]:
        """(distinct tokens to restore alone, runs of single characters) of a text."""
        lowered = (text or "").lower()
        runs = []

        def take(m):
            runs.append(re.sub(r"\s", " ", m.group()))
            return " "

        return set(_SPACED.sub(take, lowered).split()), runs


def features(words: list[str]) -> list[str]:
    """Features of restored words: the words, and the first letters of long ones."""
    return words + [w[:PREFIX] + "*" for w in words if len(w) > PREFIX]


class Memo:
    """Values of tokens by a function, each computed once while the table has room."""

    def __init__(self, function, size: int = MEMO):
        self.function, self.size, self.known = function, size, {}

    def __call__(self, token: str):
        value = self.known.get(token)
        if value is None:
            value = self.function(token)
            if len(self.known) >= self.size:
                self.known.clear()
            self.known[token] = value
        return value


_MEMOS: dict[str, Memo] = {}


def _memo(name: str, function) -> Memo:
    """The worker's table of that name (tasks of one stage share it); other tables are given up."""
    if name not in _MEMOS:
        _MEMOS.clear()
        _MEMOS[name] = Memo(function)
    return _MEMOS[name]


def signatures(texts: pa.Array) -> np.ndarray:
    """Three minimum hashes of the word triples of every text (of the whole text, where it has fewer words)."""
    out = np.empty((len(texts), 3), np.uint64)
    for row, last, data, offsets in text_blocks(texts):
        words = find_words(data, offsets, lower=True)
        hashes = word_hashes(words)
        triples = sequence_hashes(hashes, 3)
        for d in range(last - row):
            a, b = words.first[d], words.first[d + 1]
            own = triples[a:b - 2] if b - a > 2 else mix(np.array([hashes[a:b].sum()], np.uint64))
            out[row + d] = [mix(own ^ key).min() for key in _KEYS]
    return out.view(np.int64)


_KEYS = stream(50, 3)


def _inputs(weights: list[float], words: int) -> tuple[float, ...]:
    """What the logistic model sees of a document: largest log-odds of its words, and its size (short texts alike)."""
    top = sorted(weights, reverse=True)[:5] + [0.0] * 5
    return top[0], top[1], sum(top[:5]) / 5, math.log1p(max(words, 50))


class Model(NamedTuple):
    weights: dict[str, float]
    mean: np.ndarray
    scale: np.ndarray
    coefficients: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total = ((x - self.mean) / self.scale) @ self.coefficients[1:] + self.coefficients[0]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, coefficients) of a penalised logistic regression by Newton steps."""
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    ridge = np.diag([1e-6] + [penalty] * x.shape[1])
    b = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, b


def log_odds(toxic: np.ndarray, clean: np.ndarray, toxic_rows: float, clean_rows: float) -> np.ndarray:
    """Log-odds of a feature less one standard error, so that features of few rows weigh little."""
    return np.log((toxic + 0.5) / (toxic_rows + 1)) - np.log((clean + 0.5) / (clean_rows + 1)) - np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))


def _sample(docs: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """(doc_id, label, text) of the rows learned from: a bounded number."""
    marked = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(remainder("doc_id", HELD_OUT) != 0) \
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("toxic") >= 0.5).cast("int").alias("label"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("hash"))
    chosen = rows.groupBy("doc_id").agg(F.min("hash").alias("hash")).join(marked, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    return rows.join(F.broadcast(chosen), ["doc_id", "hash"]).groupBy("doc_id", "hash").agg(F.first("label").alias("label"), F.first("text").alias("text"))


def train(docs: DataFrame, labels: DataFrame, decoder: Decoder, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Weights of features and the logistic model, from the labelled training rows."""

    name = uuid.uuid4().hex

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        restore = _memo(name, lambda t: tuple(features(decoder.restore(t))))
        found, sizes = [], []
        for text in batch.column("text").to_pylist():
            tokens, runs = decoder.text(text)
            found.append(sorted({f for t in (*tokens, *runs) for f in restore(t)}))
            sizes.append(len(tokens))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(list(signatures(batch.column("text"))), pa.list_(pa.int64())),
                                           pa.array(found, pa.list_(pa.string())), pa.array(sizes, pa.int64())], names=["doc_id", "label", "signs", "features", "size"])

    spread = _sample(docs, labels, sample_rows).select("doc_id", "label", "text")
    sample = cut(map_arrow(spread, read, "doc_id long, label int, signs array<long>, features array<string>, size long"))
    copies = sample.select("doc_id", F.posexplode("signs").alias("k", "sign")).groupBy("k", "sign").agg(F.min("doc_id").alias("least"), F.collect_list("doc_id").alias("ids")) \
        .select("least", F.explode("ids").alias("doc_id")).where("doc_id <> least").select("doc_id").distinct()
    rows = sample.join(copies, "doc_id", "left_anti").withColumn("half", (F.crc32(F.concat(F.lit("half"), F.col("doc_id").cast("string"))) % 2).cast("int"))
    sizes = {(r[0], r[1]): r[2] for r in rows.groupBy("half", "label").count().collect()}
    of = lambda label, *halves: sum(sizes.get((h, label), 0) for h in halves)
    if not of(0, 0, 1) or not of(1, 0, 1):
        share = of(1, 0, 1) / max(of(0, 0, 1) + of(1, 0, 1), 1) if sizes else 0.5
        edge = float(np.clip(np.log(max(share, 1e-13) / max(1 - share, 1e-13)), -30, 30))
        return Model({}, np.zeros(4), np.ones(4), np.array([edge, 0, 0, 0, 0]))
    cell = lambda h, label: F.sum(((F.col("half") == h) & (F.col("label") == label)).cast("long")).alias(f"n{h}{label}")
    counted = rows.select("half", "label", F.explode("features").alias("feature")).groupBy("feature").agg(*[cell(h, label) for h in (0, 1) for label in (0, 1)])
    total = F.col("n00") + F.col("n01") + F.col("n10") + F.col("n11")
    odds = F.log((F.col("n01") + F.col("n11") + 0.5) / (of(1, 0, 1) + 1)) - F.log((F.col("n00") + F.col("n10") + 0.5) / (of(0, 0, 1) + 1))
    kept = counted.where(total >= FEATURE_ROWS).where(odds > 0.5).orderBy(F.desc(odds), "feature").limit(FEATURES).toArrow()
    n = {c: kept.column(c).to_numpy().astype(float) for c in ("n00", "n01", "n10", "n11")}
    names = kept.column("feature").to_pylist()
    table_of = lambda *halves: dict(zip(names, log_odds(sum(n[f"n{h}1"] for h in halves), sum(n[f"n{h}0"] for h in halves),
                                                        of(1, *halves), of(0, *halves)).tolist(), strict=True))
    other = {0: table_of(1), 1: table_of(0)}  # a row is weighed by the half it isn't in

    def weigh(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = []
        for half, size, found in zip(*(batch.column(c).to_pylist() for c in ("half", "size", "features")), strict=True):
            x.append(list(_inputs([w for w in map(other[half].get, found) if w is not None and w > 0], size)))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "label", "x"])

    seen = map_arrow(rows.select("doc_id", "label", "half", "size", "features"), weigh, "doc_id long, label int, x array<double>").toArrow().sort_by("doc_id")
    x = seen.column("x").combine_chunks().flatten().to_numpy().reshape(-1, 4)
    return Model(table_of(0, 1), *logistic(x, seen.column("label").to_numpy().astype(float)))


def score(docs: DataFrame, decoder: Decoder, model: Model) -> DataFrame:
    """(doc_id, score) per row of ``docs``."""

    name = uuid.uuid4().hex

    def weight(token: str) -> tuple[tuple[str, float], ...]:
        some = ((f, model.weights.get(f, 0.0)) for f in features(decoder.restore(token)))
        return tuple(x for x in some if x[1] > 0)

    def run(batches):
        memo = _memo(name, weight)
        for batch in batches:
            x = []
            for text in batch.column("text").to_pylist():
                tokens, runs = decoder.text(text)
                found = dict(w for t in (*tokens, *runs) for w in memo(t))  # a feature counts once
                x.append(_inputs(list(found.values()), len(tokens)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(np.array(x).reshape(-1, 4)))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def restored(docs: DataFrame, decoder: Decoder) -> DataFrame:
    """(doc_id, text, restored): texts with every token and spaced run replaced by its reading."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text in batch.column("text").to_pylist():
            lowered = _SPACED.sub(lambda m: "\0".join(decoder.restore(re.sub(r"\s", " ", m.group()))), (text or "").lower())
            out.append(" ".join(w for t in lowered.split() for p in t.split("\0") for w in ([p] if "\0" in t else decoder.restore(p))))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(out, pa.string())], names=["doc_id", "text", "restored"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, text string, restored string")


def op12_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    decoder = Decoder(language_model(docs))
    scored = score(docs, decoder, train(docs, table(spark, sf_dir, "labels"), decoder))
    return scored.select("doc_id", (remainder("doc_id", HELD_OUT) == 0).alias("held_out"), "score",
                         F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
