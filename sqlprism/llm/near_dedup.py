"""MinHash near-duplicate detection with SuperMinHash signatures, banding, exact verification and
union-find grouping (``op4_superminhash_near_dedup``).

1. Words are maximal runs outside ``\\x20`` and ``\\x09-\\x0D`` after lower-casing A-Z; a document's
   set holds its distinct 5-word shingles (64-bit hashes). With 1-4 words the whole sequence is the
   one shingle; null or word-free texts have the empty set and are linked with nothing.
2. Documents with equal sets form one class (128-bit order-free fingerprint of the set, hashed to a node number); classes, not
   documents, are banded, compared and linked, so that thousands of copies cost no more than one, and different texts of one
   ``doc_id`` stay apart.
3. SuperMinHash: every shingle gets ranks 0..m-1 over the m signature places by a pseudo-random
   permutation of its own, and place p keeps the least (rank, random fraction). Ranks of one
   shingle at two places differ, which is what lowers the variance below that of independent
   hashes. The permutations are the affine maps of Z_m, m prime, under which an ordered pair of
   ranks at two places is uniform over all pairs: the estimator's variance is that of uniformly
   random permutations. Ranks are taken one at a time, and a document drops out as soon as all of
   its places hold less than the next rank (early stopping).
4. Sets of at most ``SMALL`` shingles are linked exactly, as signatures of so few shingles vary more: similar sets have a
   common subset that each gets by leaving out at most a quarter of its shingles, so all such subsets are keys. Of two
   members of a key's bucket only the sizes decide, so the bucket's smallest set is similar to whatever is similar
   to anything there by that key, and links to it are complete.
   Bands of 4 places each: 31 bands of the 127 places find a pair of larger sets of similarity 0.75 but for a chance of about
   (1 - 0.75^4)^31 = 1e-5. In a bucket every member meets the bucket's smallest member (the pivot), a
   number of pairs linear in the bucket; those whose signatures agree in 58 percent of the places (4.5
   standard deviations below 0.75) tie the members into clusters. No bucket is capped.
5. Clusters go to tasks in blocks of about 256 members, every two blocks of a cluster meeting in a task of their own.
   There pairs that agree in 58 percent of the places are confirmed on the full sets, 100 * |A n B| >= 75 *
   |A u B|, best first; pairs that other links of the task have already joined need no test. Members of one
   bucket in different clusters are compared by signature in blocks of 1024, and the pairs found are confirmed too.
6. Links between classes are grouped by ``components``; the smallest ``doc_id`` of a group is given back to all its documents.

Repeated rows: rows of one ``doc_id`` are separate members; each gets the component of its own set.
A null ``doc_id`` takes part in no grouping: its ``component_id`` is null and ``kept`` is true.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlprism.llm.blocks import U64, find_words, mix, sequence_hashes, stream, text_blocks, word_hashes
from sqlprism.llm.common import components, cut, discard, map_arrow, table

SHINGLE = 5
PLACES = 127
BAND = 4
BANDS = PLACES // BAND
PERCENT = 75
AGREE = PLACES * 29 // 50
SIG_ROWS, SET_ROWS = 1024, 256
SMALL = 12


def shingle_sets(column: pa.Array, size: int = SHINGLE):
    """Sorted distinct shingle hashes per row: yields (first row, doc number per shingle, hashes, rows)."""
    for row, last, data, offsets in text_blocks(column):
        words = find_words(data, offsets, lower=True)
        hashes = word_hashes(words)
        grams = sequence_hashes(hashes, size)
        sets = []
        for a, b in zip(words.first[:-1], words.first[1:], strict=True):
            if b - a >= size:
                sets.append(np.unique(grams[a:b - size + 1]))
            else:
                sets.append(sequence_hashes(hashes[a:b], int(b - a), seed=100 + int(b - a)) if b > a else hashes[:0])
        yield row, last, sets


def superminhash(elements: np.ndarray, doc: np.ndarray, documents: int, places: int = PLACES) -> np.ndarray:
    """Signatures (documents x places, 64-bit: rank in the high half, fraction in the low one) of sets given
    as hashes with their document number. ``places`` must be prime. Empty sets keep the largest value."""
    sig = np.full(documents * places, np.iinfo(np.uint64).max, U64)
    shift, step = (mix(elements ^ s) for s in stream(7, 2))
    shift = (shift % U64(places)).astype(np.int64)
    step = (step % U64(places - 1)).astype(np.int64) + 1
    base = doc.astype(np.int64) * places
    salts = stream(8, places)
    for rank in range(places):
        value = (mix(elements ^ salts[rank]) >> U64(32)) | (U64(rank) << U64(32))
        np.minimum.at(sig, base + (shift + step * rank) % places, value)
        alive = (sig.reshape(documents, places).max(axis=1) >= U64(rank + 1) << U64(32))[base // places]
        if not alive.all():
            elements, shift, step, base = elements[alive], shift[alive], step[alive], base[alive]
        if not len(elements):
            break
    return sig.reshape(documents, places)


def subset_keys(shingles: np.ndarray) -> list[tuple[int, int, int]]:
    """(size, 128-bit fingerprint) of every subset of a small set that leaves out at most a quarter of it."""
    n = len(shingles)
    if not 0 < n <= SMALL:
        return []
    hashes = [[int(h) for h in mix(shingles ^ salt)] for salt in stream(10, 2)]
    totals = [sum(h) for h in hashes]
    word = lambda x: ((x + (1 << 63)) & ((1 << 64) - 1)) - (1 << 63)
    return [(n - k, *(word(t - sum(h[i] for i in gone)) for t, h in zip(totals, hashes, strict=True)))
            for k in range(n // 4 + 1) for gone in itertools.combinations(range(n), k)]


_SIG_SCHEMA = "doc_id long, row long, n_shingles long, set_a long, set_b long, sig binary, keys array<struct<size:long,x:long,y:long>>"


_KEYS = pa.list_(pa.struct([("size", pa.int64()), ("x", pa.int64()), ("y", pa.int64())]))


def _sign(batch: pa.RecordBatch):
    ids = batch.column("doc_id")
    for row, last, sets in shingle_sets(batch.column("text")):
        sizes = np.array([len(s) for s in sets])
        elements = np.concatenate(sets)
        doc = np.repeat(np.arange(len(sets)), sizes)
        sig = (mix(superminhash(elements, doc, len(sets))) >> U64(48)).astype("<u2")
        at = np.cumsum(sizes) - sizes
        prints = []
        for salt in stream(9, 2):
            total = np.concatenate([[U64(0)], np.cumsum(mix(elements ^ salt))])
            prints.append((total[at + sizes] - total[at]).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [ids.slice(row, last - row), batch.column("row").slice(row, last - row), pa.array(sizes, pa.int64()), pa.array(prints[0]), pa.array(prints[1]),
             pa.array([s.tobytes() for s in sig], pa.binary()), pa.array([[dict(zip("size x y".split(), k, strict=True)) for k in subset_keys(x)] for x in sets], _KEYS)],
            names=["doc_id", "row", "n_shingles", "set_a", "set_b", "sig", "keys"])


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, row, n_shingles, set_a, set_b, sig, keys) per row of ``docs``; row is the hash of the text, keys those of small sets."""
    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row"), "text"), _sign, _SIG_SCHEMA)


def _agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Number of equal places of every row of ``x`` with every row of ``y``."""
    return np.stack([(row == y).sum(axis=1) for row in x]) if len(x) else np.zeros((0, len(y)), int)


def _signatures_of(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, PLACES)


def _agree(batch: pa.RecordBatch) -> pa.RecordBatch:
    a, b = (_signatures_of(batch.column(c)) for c in ("sig_a", "sig_b"))
    return batch.select(["a", "b"]).filter(pa.array((a == b).sum(axis=1) >= AGREE))


def _cross(group: pa.Table) -> pa.Table:
    """Pairs of members of one bucket that lie in different clusters and may be similar."""
    rep, cluster, block, band = (group.column(c).to_numpy() for c in ("rep", "cluster", "block", "band"))
    lo, hi = group.column("lo")[0].as_py(), group.column("hi")[0].as_py()
    sig = _signatures_of(group.column("sig"))
    order = np.argsort(band, kind="stable")
    found = set()
    for members in np.split(order, np.flatnonzero(np.diff(band[order])) + 1):
        one, two = members[block[members] == lo], members[block[members] == hi]
        r, c = np.nonzero((cluster[one][:, None] != cluster[two]) & (_agreement(sig[one], sig[two]) >= AGREE))
        a, b = rep[one[r]], rep[two[c]]
        found.update(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), strict=True))
    return pa.table({n: pa.array([f[k] for f in sorted(found)], pa.int64()) for k, n in enumerate(("a", "b"))})


def _similar(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def _links(group: pa.Table) -> pa.Table:
    """Links that join the members of each cluster of the group, confirmed on full sets. Pairs are tried by
    descending agreement, those already joined by other links of this group are passed over."""
    rep, cluster, block = (group.column(c).to_numpy() for c in ("rep", "cluster", "block"))
    lo, hi = group.column("lo")[0].as_py(), group.column("hi")[0].as_py()
    sig = _signatures_of(group.column("sig"))
    sets = [np.frombuffer(s.as_buffer(), U64) for s in group.column("shingles")]
    order = np.lexsort((rep, cluster))
    found = []
    for members in np.split(order, np.flatnonzero(np.diff(cluster[order])) + 1):
        one, two = members[block[members] == lo], members[block[members] == hi]
        agree = _agreement(sig[one], sig[two])
        if lo == hi:
            agree[np.tril_indices(len(one))] = 0
        r, c = np.nonzero(agree >= AGREE)
        first = np.argsort(-agree[r, c], kind="stable")
        root = {i: i for i in members.tolist()}

        def find(i, root=root):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i, j in zip(one[r[first]].tolist(), two[c[first]].tolist(), strict=True):
            a, b = find(i), find(j)
            if a != b and _similar(sets[i], sets[j]):
                root[a] = b
                found.append((rep[i], rep[j]))
    return pa.table({n: pa.array([f[k] for f in found], pa.int64()) for k, n in enumerate(("a", "b"))})


def _sets(batch: pa.RecordBatch):
    ids = batch.column("rep")
    for row, last, sets in shingle_sets(batch.column("text")):
        yield pa.RecordBatch.from_arrays([ids.slice(row, last - row), pa.array([s.tobytes() for s in sets], pa.binary())],
                                         names=["rep", "shingles"])


def _verify(batch: pa.RecordBatch) -> pa.RecordBatch:
    keep = [_similar(*(np.frombuffer(s.as_buffer(), U64) for s in pair))
            for pair in zip(batch.column("set_x"), batch.column("set_y"), strict=True)]
    return batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _tiles(rows: DataFrame, key: str, block_rows: int) -> DataFrame:
    """Members of each ``key`` in hash blocks of about ``block_rows``, copied to every pair (lo, hi) of blocks."""
    size = rows.groupBy(key).agg((1 + F.floor((F.count(F.lit(1)) - 1) / block_rows)).alias("blocks"))
    return rows.join(size, key).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks"))) \
        .withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))) \
        .withColumn("lo", F.least("block", "j")).withColumn("hi", F.greatest("block", "j")).drop("j")


def _bundled(tiles: DataFrame, key: str, block_rows: int) -> DataFrame:
    """Keys of one block share groups (``bundle``), many to each; larger ones have groups of their ``own``."""
    small = F.col("blocks") == 1
    bundles = 1 + tiles.where(small).count() // block_rows
    return tiles.withColumn("bundle", F.when(small, F.pmod(F.xxhash64(key), F.lit(bundles))).otherwise(-1)) \
                .withColumn("own", F.when(~small, F.col(key)).otherwise(-1))


def small_links(classes: DataFrame) -> DataFrame:
    """(a, b): links between classes (rep, n_shingles, keys) of small sets that join all similar ones."""
    members = classes.where(F.size("keys") > 0).select("rep", "n_shingles", F.explode("keys").alias("key")).select("rep", "n_shingles", "key.*")
    least = members.groupBy("size", "x", "y").agg(F.min(F.struct("n_shingles", "rep")).alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    both = members.join(least, ["size", "x", "y"]).where("rep <> least.rep")
    union = F.col("n_shingles") + F.col("least.n_shingles") - F.col("size")
    return both.where(100 * F.col("size") >= PERCENT * union).select(F.col("least.rep").alias("a"), F.col("rep").alias("b")).distinct()


def links_of(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b): links between classes (rep, doc_id, row, sig) that join whatever similar ones can be joined."""
    reps = classes.select("rep", "sig")
    bands = reps.select("rep", F.explode(F.expr(
        f"transform(sequence(0, {BANDS - 1}), k -> xxhash64(k, substring(sig, 1 + k * {2 * BAND}, {2 * BAND})))")).alias("band"))
    pivots = bands.groupBy("band").agg(F.min("rep").alias("pivot"), F.max("rep").alias("other"), F.count(F.lit(1)).alias("n")) \
                  .where("pivot <> other").drop("other")
    members = cut(bands.join(pivots, "band"))
    sig = reps.select("rep", "sig")
    stars = members.where("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    stars = stars.join(sig.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a")), "a") \
                 .join(sig.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b")), "b")
    near = map_arrow(stars.select("a", "b", "sig_a", "sig_b"), _agree, "a long, b long")
    clusters = cut(components(near, "a", "b").withColumnRenamed("node", "rep").withColumnRenamed("component", "cluster"))

    # similar members of one bucket in different clusters: looked for in buckets of three and more
    marked = members.where("n > 2").select("band", "rep").join(clusters, "rep", "left") \
                    .select("band", "rep", F.coalesce("cluster", "rep").alias("cluster"))
    mixed = marked.groupBy("band").agg(F.min("cluster").alias("x"), F.max("cluster").alias("y")).where("x <> y").select("band")
    tiles = _bundled(_tiles(cut(marked.join(mixed, "band")), "band", SIG_ROWS), "band", SIG_ROWS).join(sig, "rep")
    cross = cut(tiles.groupBy("bundle", "own", "lo", "hi").applyInArrow(_cross, "a long, b long").distinct())

    discard(members)
    needed = clusters.select("rep").unionByName(cross.select(F.col("a").alias("rep"))).unionByName(cross.select(F.col("b").alias("rep"))).distinct()
    named = classes.join(needed, "rep", "left_semi").select("rep", "doc_id", "row")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text").join(named, ["doc_id", "row"]).select("rep", "text")
    sets = cut(map_arrow(texts, _sets, "rep long, shingles binary").dropDuplicates(["rep"]))  # repeated rows

    tiles = _bundled(_tiles(clusters, "cluster", SET_ROWS), "cluster", SET_ROWS).join(sig, "rep").join(sets, "rep")
    within = tiles.groupBy("bundle", "own", "lo", "hi").applyInArrow(_links, "a long, b long")
    full = cross.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("set_x")), "a") \
                .join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("set_y")), "b")
    return within.unionByName(map_arrow(full.select("a", "b", "set_x", "set_y"), _verify, "a long, b long"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, row, n_shingles, component_id, kept) per row of ``docs`` (columns doc_id and text are read);
    row is xxhash64 of the text."""
    signed = cut(signatures(docs))
    one = F.struct("doc_id", "row", "sig", "keys")
    classes = cut(signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_a", "set_b", "n_shingles").agg(F.min_by(one, F.struct("doc_id", "row")).alias("m"))
                  .select("set_a", "set_b", "n_shingles", F.xxhash64("set_a", "set_b", "n_shingles").alias("rep"), "m.*"))
    links = links_of(classes, docs).unionByName(small_links(classes))
    group = components(links, "a", "b").withColumnRenamed("node", "rep")
    least = group.join(classes.select("rep", "doc_id"), "rep").groupBy("component").agg(F.min("doc_id").alias("least"))
    label = classes.select("set_a", "set_b", "n_shingles", "rep", "doc_id").join(group, "rep", "left").join(least, "component", "left") \
                   .select("set_a", "set_b", "n_shingles", F.coalesce("least", "doc_id").alias("linked"))
    out = signed.select("doc_id", "row", "n_shingles", "set_a", "set_b").join(label, ["set_a", "set_b", "n_shingles"], "left")
    return out.select("doc_id", "row", "n_shingles",
                      F.when(F.col("doc_id").isNotNull(), F.coalesce("linked", "doc_id")).alias("component_id")) \
              .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op4_superminhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of near-duplicates of every document."""
    return near_duplicates(table(spark, sf_dir, "documents")).drop("row")
