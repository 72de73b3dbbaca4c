"""Exact top-k search by an impact-ordered index, score at a time (``op6_impact_ordered_topk``).

A component x counts as floor(256 x) (beyond +-2^25 it saturates there, so that scores fit in a long up to
8192 components). The impact of a posting (dimension, vector, value) is quantised to the bit length of |value|, and the
postings of a block are stored in segments by descending quantised impact. A block of queries processes segment
after segment, adding query value times posting value into its accumulators. What is still unprocessed of a
vector has smaller bit lengths, which bounds its rest from both sides: with the k-th largest lower bound, the
vectors whose upper bound falls below it provably don't belong to the k best, ties included. Processing
stops once the possible members left are few (or no segment is), and these are rescored exactly on
the integers. Each block's best k meet in one ranking per query.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlprism.llm.common import table
from sqlprism.llm.vectors import best, kth, search, usable

SCALE, LIMIT = 256, 1 << 25
FEW = 64


def _integers(v: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(SCALE * v), -LIMIT, LIMIT).astype(np.int64)


def build(ids: np.ndarray, v: np.ndarray) -> dict[str, bytes]:
    """Postings sorted by descending quantised impact, as columns."""
    x = _integers(v)
    row, dim = np.nonzero(x)
    value = x[row, dim]
    impact = np.frexp(np.abs(value).astype(np.float64))[1]
    order = np.argsort(-impact, kind="stable")
    return {"ids": ids.astype("<i8").tobytes(), "rows": row[order].astype("<i4").tobytes(), "dims": dim[order].astype("<i4").tobytes(),
            "values": value[order].astype("<i4").tobytes(), "impacts": impact[order].astype("<i4").tobytes()}


def probe(index: dict[str, bytes], query_ids: np.ndarray, queries: np.ndarray, k: int):
    ids = np.frombuffer(index["ids"], "<i8")
    row, dim, value, impact = (np.frombuffer(index[c], "<i4") for c in ("rows", "dims", "values", "impacts"))
    q = _integers(queries)
    qf, size = q.astype(np.float64), np.abs(q).astype(np.float64)
    full = np.zeros((len(ids), q.shape[1]), np.int64)
    full[row, dim] = value
    left = (full != 0).astype(np.float64)  # unprocessed postings
    own = query_ids[:, None] == ids[None, :]
    score = np.zeros((len(q), len(ids)))
    cuts = np.flatnonzero(np.diff(impact, prepend=impact[0] + 1 if len(impact) else 0))
    possible = ~own
    for a, b in zip(cuts, [*cuts[1:], len(impact)], strict=True):
        segment = np.zeros(full.shape)
        segment[row[a:b], dim[a:b]] = value[a:b]
        score += qf @ segment.T
        left[row[a:b], dim[a:b]] = 0
        rest = (size @ left.T) * (2.0 ** (impact[a] - 1) - 1)
        least = kth(np.where(own, -np.inf, score - rest), k)
        possible = (score + rest >= least[:, None]) & ~own
        if possible.sum() <= FEW * len(q):
            break
    r, c = np.nonzero(possible)
    exact = np.empty(len(r), np.int64)
    for at in range(0, len(r), 1 << 16):
        exact[at:at + (1 << 16)] = (q[r[at:at + (1 << 16)]] * full[c[at:at + (1 << 16)]]).sum(axis=1)
    take = best(r, c, exact, ids, k)
    return query_ids[r[take]], ids[c[take]], exact[take]


def top_k(vectors: DataFrame, is_query, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` largest integer inner products per query, its own row left out."""
    return search(usable(vectors), is_query, build, lambda i, ids, q: probe(i, ids, q, k),
                  ["ids", "rows", "dims", "values", "impacts"], k, "long")


def op6_impact_ordered_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best of all vectors for every vector whose id is divisible by 50."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
