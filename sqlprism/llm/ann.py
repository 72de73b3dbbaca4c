"""Approximate nearest neighbours by randomly rotated one-bit codes (``op8_one_bit_codes``).

A block of candidates is centred on its mean c; a residual r = v - c of direction o is rotated by a fixed
random orthogonal matrix and kept as one sign bit per dimension (packed), with two correction scalars: its
length |r| and s, the inner product of o with its own code's direction b. For a query q,

    <v, q>  ~  <c, q> + |r| <b, rotated q> / s,      error <= e |r| |q| sqrt((1 - s^2) / s^2 / (D - 1))

with high probability (e = ``ERROR``). Per block and query the candidates of largest estimate are
reranked first; the k-th of their exact inner products is a threshold, and every candidate whose estimate plus
error reaches it is reranked too. Reranking takes the original vectors in double precision, so scores are exact and only
membership is approximate. All rows are indexed; nothing is trained, as the rotation depends on the
number of dimensions alone.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlprism.llm.common import table
from sqlprism.llm.vectors import best, kth, search, usable

ERROR = 1.9
NEAREST = 20


def rotation(dims: int) -> np.ndarray:
    """Random orthogonal matrix that depends on ``dims`` only."""
    q, r = np.linalg.qr(np.random.default_rng(dims).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def build(ids: np.ndarray, v: np.ndarray) -> dict[str, bytes]:
    dims = v.shape[1]
    centre = v.mean(axis=0)
    rest = (v - centre) @ rotation(dims).T
    length = np.linalg.norm(rest, axis=1)
    agree = np.abs(rest).sum(axis=1) / np.sqrt(dims) / np.where(length > 0, length, 1)
    return {"ids": ids.astype("<i8").tobytes(), "codes": np.packbits(rest > 0, axis=1).tobytes(), "vectors": v.astype("<f8").tobytes(),
            "length": length.astype("<f8").tobytes(), "agree": np.where(length > 0, agree, 1).astype("<f8").tobytes(),
            "centre": centre.astype("<f8").tobytes()}


def probe(index: dict[str, bytes], query_ids: np.ndarray, queries: np.ndarray, k: int):
    ids = np.frombuffer(index["ids"], "<i8")
    length, agree, centre = (np.frombuffer(index[c], "<f8") for c in ("length", "agree", "centre"))
    dims = len(centre)
    vectors = np.frombuffer(index["vectors"], "<f8").reshape(len(ids), dims)
    bits = np.unpackbits(np.frombuffer(index["codes"], np.uint8).reshape(len(ids), -1), axis=1, count=dims)
    signs = bits.astype(np.float32) * 2 - 1
    turned = (queries @ rotation(dims).T).astype(np.float32)
    estimate = (turned @ signs.T) * (length / agree / np.sqrt(dims)) + (queries @ centre)[:, None]
    spread = ERROR * length * np.sqrt(np.maximum(1 - agree ** 2, 0) / agree ** 2 / max(dims - 1, 1))
    reach = np.linalg.norm(queries, axis=1)[:, None] * spread
    own = query_ids[:, None] == ids[None, :]
    estimate = np.where(own, -np.inf, estimate)

    def exact(r, c):
        out = np.empty(len(r))
        for at in range(0, len(r), 1 << 16):
            out[at:at + (1 << 16)] = np.einsum("ij,ij->i", queries[r[at:at + (1 << 16)]], vectors[c[at:at + (1 << 16)]])
        return out

    if len(ids) > 4 * k:
        head = np.argpartition(-estimate, 2 * k, axis=1)[:, :2 * k]
        r = np.repeat(np.arange(len(queries)), head.shape[1])
        first = exact(r, head.ravel()).reshape(head.shape)
        first = np.where(np.take_along_axis(own, head, axis=1), -np.inf, first)
        least = kth(first, k)[:, None]
        chosen = (estimate + reach >= least) & ~own
        np.put_along_axis(chosen, head, ~np.take_along_axis(own, head, axis=1), axis=1)
    else:
        chosen = ~own
    r, c = np.nonzero(chosen)
    scores = exact(r, c)
    take = best(r, c, scores, ids, k)
    return query_ids[r[take]], ids[c[take]], scores[take]


def nearest(vectors: DataFrame, is_query, k: int = NEAREST) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` largest inner products found per query, its own row left out."""
    return search(usable(vectors, nonzero=True), is_query, build, lambda i, ids, q: probe(i, ids, q, k),
                  ["ids", "codes", "vectors", "length", "agree", "centre"], k, "double")


def op8_one_bit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty nearest found for every vector whose id is divisible by 20."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
