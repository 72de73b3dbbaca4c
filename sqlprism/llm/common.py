"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlprism.session import ensure_checkpoint_dir


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared folder that the session's ``spark.checkpoint.dir`` names."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once, without its lineage: written as Parquet below the folder of
    ``spark.checkpoint.dir`` (columnar and compressed, unlike ``checkpoint()``) and read back."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession, "cut")
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")  # the shuffle files behind a finished table are of no more use
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEAN)
        else:
            spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by ``cut`` that nothing reads any more."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/cut-" in path:
                fs, name = pafs.FileSystem.from_uri(path)
                fs.delete_dir(name)


def remainder(column: str, modulus: int):
    """crc32 of an id written as text, modulo ``modulus`` (null ids: crc32 of the empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch]],
              schema: str) -> DataFrame:
    """``df.mapInArrow`` for a function of one batch that gives a batch, or several of them."""

    def run(batches):
        for batch in batches:
            out = fn(batch)
            if isinstance(out, pa.RecordBatch):
                yield out
            else:
                yield from out

    return df.mapInArrow(run, schema)


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component): the smallest node that every node of ``edges`` can reach.

    Union-find in rounds of large-star and small-star steps: every node hooks its neighbours onto
    the smallest node it knows, until the forest no longer changes (a number of rounds that
    grows with the logarithm of the longest path). Minima are aggregated before the shuffle and
    joined back, so that a node with very many links isn't gathered in one group. Each round's
    links are written out, the last round's deleted; nothing but their count and checksum reaches the driver. Null ends
    are ignored.
    """
    links = (edges.select(F.col(left).alias("u"), F.col(right).alias("v"))
             .where("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct())

    def hook(pairs: DataFrame) -> DataFrame:
        return pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    links, before = cut(hook(links)), None
    while True:
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before:
            break
        before = state
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = hook(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        old, links = links, cut(hook(small.select(F.col("v").alias("u"), F.col("m").alias("v"))
                                     .unionByName(least.select("u", F.col("m").alias("v")))))
        discard(old)
    return (links.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
