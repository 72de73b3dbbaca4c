"""Language-model scores by a weighted backoff automaton (``op10_backoff_automaton_scores``).

Model. A-Z are lower-cased; tokens are a text's words (runs outside ``\\x20`` and ``\\x09-\\x0D``), then one
end. Rows whose crc32(doc_id as text) mod 10 isn't 0 are the training rows. With counts c over all of
them, N tokens and V distinct ones:

    p(w)     = (c(w) + 0.1) / (N + 0.1 (V + 1))                      (the base)
    p(w | h) = (c(h w) + m p(w | h')) / (c(h) + m)                    h' = h without its oldest token

a proper distribution at every order (Dirichlet smoothing with prior mass m). As an automaton: every history
h is a state; a counted continuation is an arc with weight log10 p(w | h); the failure arc to h' has weight
log10 (m / (c(h) + m)); the root's arcs are log10 p(w), one of them for unknown words. The walk goes
left to right and carries the state of the last order-1 tokens; a token with no arc from its state pays the
failure arcs down to the state that has one. The state behind a token is the longest counted history that ends there.

Distribution. Documents lie in blocks of about ``BLOCK_BYTES`` of text; a block needs the states and arcs of its own
n-grams only. For one group of orders after the other (``EXCHANGES``) every block sends its distinct n-grams (64-bit hashes, sorted, delta coded, cut by hash
range) with its own training counts; the task of a hash range adds the counts up and answers every block
with one total per n-gram sent, in the order sent. A group's answers are written before the next group is asked, so only one
exchange lies on disk at a time. An n-gram that is frequent everywhere costs one entry
per block, so no key is hot. Then every block builds its slice of the automaton (``Automaton``) and walks its texts. Only N and V
reach the driver. What is gathered grows with the distinct n-grams of all training rows; nothing is pruned.

Defined cases: null texts are empty and hold the end only; without training rows every token has the base of
N = V = 0; repeated rows count and are scored each. Other columns are not read.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlprism.llm.blocks import U64, find_words, mix, stream, text_blocks, word_hashes
from sqlprism.llm.common import cut, remainder, table
from sqlprism.llm.shards import blocked, by_range, keys_of, planes, rows_of, unplanes

ORDER = 3
PRIOR = 50.0
BLOCK_BYTES, RANGE_BYTES = 2 << 20, 8 << 20
EXCHANGES = ((1, 2), (3,))  # orders that travel together; higher ones one by one
HELD_OUT = 10
_START, _END = stream(30, 2)


class Grams(NamedTuple):
    """Per token: hash of the n-gram of order k that ends there (``keys[k - 1]``); ``first`` by document."""

    keys: list[np.ndarray]
    first: np.ndarray


def grams(texts: pa.Array, order: int = ORDER) -> Grams:
    tokens, sizes = [], []
    for _, _, data, offsets in text_blocks(texts):
        words = find_words(data, offsets, lower=True)
        counts = np.diff(words.first)
        out = np.empty(len(words.starts) + len(counts), U64)
        ends = np.cumsum(counts + 1) - 1
        is_word = np.ones(len(out), bool)
        is_word[ends] = False
        out[ends], out[is_word] = _END, word_hashes(words)
        tokens.append(out)
        sizes.append(counts + 1)
    sizes = np.concatenate([[0], *sizes])
    tokens = np.concatenate([np.zeros(0, U64), *tokens])
    first = np.cumsum(sizes)
    place = np.arange(len(tokens)) - np.repeat(first[:-1], sizes[1:])
    keys = [mix(tokens ^ stream(31, 1)[0])]
    for back in range(1, order):
        older = np.full(len(tokens), _START, U64)
        inside = place >= back
        older[inside] = tokens[np.flatnonzero(inside) - back]
        keys.append(mix(keys[-1] + mix(older ^ stream(31 + back, 1)[0])))
    return Grams(keys, first)


def _ask(orders: tuple[int, ...], ranges: int):
    """A row per block and hash range: distinct n-grams of ``orders`` and their training counts."""
    binaries = pa.list_(pa.binary())

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                docs = rows_of(batch.column("data")[i])
                found = grams(docs.column("text"), max(orders))
                train = np.repeat(docs.column("train").to_numpy(zero_copy_only=False), np.diff(found.first))
                coded = []
                for k in orders:
                    distinct, inverse = np.unique(found.keys[k - 1], return_inverse=True)
                    coded.append(list(by_range(distinct, np.bincount(inverse, weights=train, minlength=len(distinct)).astype(U64), ranges)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(ranges), pa.int32()), pa.array([batch.column("block")[i].as_py()] * ranges, pa.int64()),
                     *(pa.array([[c[r][x] for c in coded] for r in range(ranges)], binaries) for x in (0, 1))], names=["part", "block", "keys", "counts"])
    return run


_ANSWER = "block long, part int, counts array<binary>, total long, distinct_tokens long"


def _answer(orders: tuple[int, ...], ranges: int):
    """Totals of a hash range, for every block in the order it asked; one row without a block with N and V of the range."""
    def run(group: pa.Table) -> pa.Table:
        part, blocks = group.column("part")[0].as_py(), group.column("block").to_pylist()
        out, tokens = [[] for _ in blocks], (None, None)
        for i, k in enumerate(orders):
            keys = [keys_of(x, part, ranges) for x in pc.list_element(group.column("keys"), i).to_pylist()]
            _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            own = np.concatenate([unplanes(x) for x in pc.list_element(group.column("counts"), i).to_pylist()])
            totals = np.bincount(inverse, weights=own.astype(np.float64)).astype(U64)
            if k == 1:
                tokens = int(totals.sum()), int((totals > 0).sum())
            for row, counts in zip(out, np.split(totals[inverse], np.cumsum([len(x) for x in keys])[:-1]), strict=True):
                row.append(planes(counts))
        rows = [*zip(blocks, out, [None] * len(blocks), [None] * len(blocks), strict=True), *([(None, None, *tokens)] if 1 in orders else [])]
        return pa.table({"block": pa.array([r[0] for r in rows], pa.int64()), "part": pa.array([part] * len(rows), pa.int32()), "counts": pa.array([r[1] for r in rows], pa.list_(pa.binary())),
                         "total": pa.array([r[2] for r in rows], pa.int64()), "distinct_tokens": pa.array([r[3] for r in rows], pa.int64())})
    return run


class Automaton(NamedTuple):
    """Slice of the weighted backoff automaton for the n-grams of one block.

    A state of order k is a counted k-gram (as history), the root has order 0. ``arc[k][i]``: weight of the arc that the
    (k + 1)-gram i is, from the state of its first k tokens, nan if it isn't counted. ``fail[k][i]``: weight of the failure
    arc of the state that the k-gram i is, to the state of its last k - 1 tokens; ``unknown``: the root's arc for other tokens."""

    arc: list[np.ndarray]
    fail: list[np.ndarray]
    start: float
    unknown: float


def automaton(counts: list[np.ndarray], first: list[np.ndarray], places: list[np.ndarray], begins: np.ndarray, documents: float,
              total: int, distinct: int, prior: float) -> Automaton:
    """From the counts of every order's n-grams; ``first[k]`` is the token where each of them ends for the first time, ``places[k]`` the
    n-gram that ends at each token, ``begins`` whether a text starts there, and ``documents`` the count of the state before any text."""
    with np.errstate(divide="ignore"):
        share = [(counts[0] + 0.1) / (total + 0.1 * (distinct + 1))]
        for k in range(1, len(counts)):
            at = first[k]
            lower = share[k - 1][places[k - 1][at]]
            history = np.where(begins[at], documents, counts[k - 1][places[k - 1][at - 1]] if len(at) else 0.0)
            share.append((counts[k] + prior * lower) / (history + prior))
        arc = [np.where(c > 0, np.log10(p), np.nan) for c, p in zip(counts, share, strict=True)]
        fail = [np.zeros(0), *[np.log10(prior / (c + prior)) for c in counts[:-1]]]
    return Automaton(arc, fail, float(np.log10(prior / (documents + prior))), float(np.log10(0.1 / (total + 0.1 * (distinct + 1)))))


def walk(machine: Automaton, counts: list[np.ndarray], places: list[np.ndarray], begins: np.ndarray) -> np.ndarray:
    """Weight of every token on the path from left to right: from the state carried to it, along failure arcs down to the
    first state with an arc for it."""
    n = len(begins)
    before = np.arange(n) - 1
    state = np.zeros(n, np.int64)  # order of the state carried to the token: the longest counted history
    for k in range(1, len(places)):
        state[~begins & (counts[k - 1][places[k - 1][before]] > 0 if n else begins)] = k
    state[begins] = len(places) - 1  # the states before a text
    weight, done = np.zeros(n), np.zeros(n, bool)
    for k in range(len(places) - 1, -1, -1):
        here = ~done & (state >= k)
        arc = machine.arc[k][places[k][here]]
        found = ~np.isnan(arc)
        at = np.flatnonzero(here)
        weight[at[found]] += arc[found]
        done[at[found]] = True
        left = at[~found]
        if k:
            weight[left] += np.where(begins[left], machine.start, machine.fail[k][places[k - 1][before[left]]])
        else:
            weight[left] += machine.unknown
    return weight


_SCORE = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(blocks: pa.Table, answers: pa.Table, order: int, total: int, distinct: int, prior: float) -> pa.Table:
    names = [f.split()[0] for f in _SCORE.split(", ")]
    if not blocks.num_rows:
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.table({n: pa.array([], k) for n, k in zip(names, kinds, strict=True)})
    docs = rows_of(blocks.column("data")[0])
    found = grams(docs.column("text"), order)
    answers = answers.sort_by([("least", "ascending"), ("part", "ascending")])
    counts, first, places = [], [], []
    for k in range(1, order + 1):
        _, index, inverse = np.unique(found.keys[k - 1], return_index=True, return_inverse=True)
        group = next(g for g in _exchanges(order) if k in g)
        own = answers.filter(pc.equal(answers.column("least"), group[0]))
        counts.append(np.concatenate([np.zeros(0, U64), *map(unplanes, pc.list_element(own.column("counts"), group.index(k)).to_pylist())]).astype(np.float64))
        first.append(index)
        places.append(inverse)
    at = found.first[:-1]
    begins = np.zeros(len(places[0]), bool)
    begins[at] = True
    documents = float(counts[0][places[0][found.first[1] - 1]])  # as many starts as ends
    weight = walk(automaton(counts, first, places, begins, documents, total, distinct, prior), counts, places, begins)
    own = counts[0][places[0]]
    base = np.log10((own + 0.1) / (total + 0.1 * (distinct + 1)))
    return pa.table(dict(zip(names, [
        docs.column("doc_id"), pc.invert(docs.column("train")), pa.array(np.diff(found.first), pa.int64()),
        pa.array(np.add.reduceat((own > 0).astype(np.int64), at)), pa.array(np.full(len(at), total), pa.int64()),
        pa.array(np.add.reduceat(base, at)), pa.array(np.add.reduceat(weight, at))], strict=True)))


def _exchanges(order: int) -> list[tuple[int, ...]]:
    """The orders up to ``order``, grouped as they travel."""
    known = [tuple(k for k in g if k <= order) for g in EXCHANGES]
    return [g for g in known if g] + [(k,) for k in range(max(map(max, EXCHANGES)) + 1, order + 1)]


def score_documents(docs: DataFrame, train, order: int = ORDER, prior: float = PRIOR, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row of ``docs``; ``train`` is the
    condition of training rows."""
    blocks = blocked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train"), F.col("text").cast("string").alias("text")), block_bytes)
    ranges = 1 + int((blocks.agg(F.sum("bytes")).first()[0] or 0) // RANGE_BYTES)
    answers = []
    for group in _exchanges(order):
        asked = blocks.select("block", "data").mapInArrow(_ask(group, ranges), "part int, block long, keys array<binary>, counts array<binary>")
        answers.append(cut(asked.groupBy("part").applyInArrow(_answer(group, ranges), _ANSWER).withColumn("least", F.lit(group[0]))))
    total, distinct = answers[0].where("block IS NULL").agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct_tokens"), F.lit(0))).first()
    told = answers[0]
    for more in answers[1:]:
        told = told.unionByName(more)
    told = told.where("block IS NOT NULL").select("block", "part", "least", "counts")
    return blocks.select("block", "data").groupBy("block").cogroup(told.groupBy("block")).applyInArrow(
        lambda d, a: _score(d, a, order, total, distinct, prior), _SCORE)


def op10_backoff_automaton_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of all documents under a model of the training rows."""
    return score_documents(table(spark, sf_dir, "documents"), remainder("doc_id", HELD_OUT) != 0)
