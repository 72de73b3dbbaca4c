"""Vector tables in blocks: an index row per block of candidates, searched by every block of queries.

Blocks are ranges of a hash of ``vec_id``, so they are even and a group never exceeds a few thousand vectors.
Vectors that are null, empty or hold null or non-finite components take no part; of several rows with one
``vec_id`` the least vector (in array order) counts; vectors of different lengths never meet.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CANDIDATES = 8192
QUERIES = 1024
RESULT = "query_id long, vec_id long, score {}"


def usable(table: DataFrame, nonzero: bool = False) -> DataFrame:
    """(vec_id, dim, v): the vectors that take part, as doubles."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")) \
        .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~bad)
    if nonzero:
        rows = rows.where(F.exists("v", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))


def matrix(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a group, by id."""
    group = group.sort_by("vec_id")
    return group.column("vec_id").to_numpy(), group.column("v").combine_chunks().flatten().to_numpy().reshape(group.num_rows, -1)


def search(vectors: DataFrame, is_query, build: Callable[[np.ndarray, np.ndarray], dict[str, bytes]],
           probe: Callable[[dict[str, bytes], np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]],
           columns: list[str], k: int, kind: str) -> DataFrame:
    """(query_id, rank, vec_id, score): best ``k`` of all blocks' best. ``build`` gives the index of a block as binary
    ``columns``, ``probe`` the best of one block for one block of queries (query ids, candidate ids, scores)."""
    dims = {r["dim"]: (r["n"], r["q"]) for r in vectors.groupBy("dim").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("q")).collect()}  # one row per vector length
    if not dims:
        return vectors.sparkSession.createDataFrame([], f"query_id long, rank int, vec_id long, score {kind}")
    blocks = F.coalesce(*[F.when(F.col("dim") == d, F.lit(1 + n // CANDIDATES).cast("long")) for d, (n, _) in dims.items()])
    query_blocks = F.coalesce(*[F.when(F.col("dim") == d, F.lit(1 + q // QUERIES).cast("long")) for d, (_, q) in dims.items()])
    placed = vectors.withColumn("blocks", blocks).withColumn("query_blocks", query_blocks)

    def index(group: pa.Table) -> pa.Table:
        parts = build(*matrix(group))
        return pa.table({"dim": group.column("dim")[:1], "block": group.column("block")[:1], "query_blocks": group.column("query_blocks")[:1],
                         **{c: pa.array([parts[c]], pa.binary()) for c in columns}})

    indexed = placed.withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks")).groupBy("dim", "block").applyInArrow(
        index, "dim int, block long, query_blocks long, " + ", ".join(f"{c} binary" for c in columns))
    left = indexed.withColumn("query_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("query_blocks") - 1)))
    right = placed.where(is_query).withColumn("query_block", F.pmod(F.xxhash64("vec_id", F.lit(1)), "query_blocks")) \
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))

    def meet(block: pa.Table, queries: pa.Table) -> pa.Table:
        if not block.num_rows or not queries.num_rows:
            found = [np.zeros(0, np.int64)] * 3
        else:
            found = probe({c: block.column(c)[0].as_py() for c in columns}, *matrix(queries))
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()),
                         "score": pa.array(found[2], pa.int64() if kind == "long" else pa.float64())})

    keys = ["dim", "block", "query_block"]
    found = left.groupBy(*keys).cogroup(right.select(*keys, "vec_id", "v").groupBy(*keys)).applyInArrow(meet, RESULT.format(kind))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def best(rows: np.ndarray, cols: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` best (score, then smaller id) per row number."""
    order = np.lexsort((ids[cols], -scores, rows))
    r = rows[order]
    first = np.searchsorted(r, r, "left")
    return order[np.arange(len(r)) - first < k]


def kth(values: np.ndarray, k: int) -> np.ndarray:
    """k-th largest value per row (the least, if there are fewer)."""
    k = min(k, values.shape[1])
    return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k]
