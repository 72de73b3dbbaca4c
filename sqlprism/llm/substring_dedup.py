"""Removal of repeated passages by recompression (``op3_recompression_substring_dedup``).

A window is 20 consecutive words of one document; a word goes if it lies in a window whose word
sequence also starts at a smaller (doc_id, start). Windows are judged on the input.

Recompression rewrites every document's word sequence round by round: maximal runs of one symbol, then
pairs (x, y) with x in the left and y in the right half of the alphabet (halves drawn anew each
round by hash), get one new symbol. New symbols are named by a 64-bit hash of what they replace, so
all documents use the same name for the same content without a table of names. For every symbol the
words that decided it (its own and those of neighbours that were looked at) are kept as an interval;
where that interval lies inside a window, every copy of the window holds the same symbol at the same
place. Where a document's edge decided, the interval counts as outside every window.

1. Round one over Spark: every window is keyed by two neighbouring symbols of the highest level that are decided
   inside the window, those of least hash (by one symbol, or one of a lower level, where there is no such pair;
   words themselves are level 0, so every window has a key). Only a key that occurs twice in the corpus can stand for
   a repeated window. One row per key occurrence goes to the shuffle, with the range of windows that it keys.
2. Occurrences of a shared key with the same place in their windows and the same words (64-bit hashes of key and
   of words) form a class; all windows of members but the earliest are repeats.
3. Round two: where a key has several classes, the windows of the classes' earliest members are read from their
   texts and compared one by one, by the hash of their words together with the key and its place.
4. The removed ranges join their documents, where the words that remain are written out.

Groups are only ever aggregated and joined back, never gathered, so a passage in a third of all
documents costs one slim row per occurrence.

Defined cases: null texts have no words; a null ``doc_id`` orders after all others; rows of one
``doc_id`` are ordered by start only, so equal rows don't remove each other's windows; texts without a
repeat still come back with their words joined by one space. Other columns are passed through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlprism.llm.blocks import U64, find_words, mix, sequence_hashes, stream, text_blocks, word_hashes
from sqlprism.llm.common import cut, discard, map_arrow, table

WINDOW = 20
ROUNDS = 3
RUN_ROUNDS = (0,)
GRAMS = 2
_LAST = (1 << 63) - 1


def _merge(sym, lo, hi, group, names):
    """Symbols, each group of consecutive ones (``group`` marks firsts) as one; several get ``names``."""
    at = np.flatnonzero(group)
    size = np.diff(np.append(at, len(sym)))
    ends = at + size - 1
    return np.where(size > 1, names(at, size), sym[at]), lo[at], hi[ends], at, size


def recompress(sym: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS):
    """Levels of the symbol sequences of several documents (``doc`` ascending, one number per symbol).

    Yields (symbols, lo, hi) for level 0, 1, ..: [lo, hi) is the interval of places that decided the
    symbol, in coordinates ``place + 2 * doc + 1`` which leave room for a place outside each document.
    """
    place = np.arange(len(sym)) + 2 * doc + 1
    lo, hi = place, place + 1
    yield sym, lo, hi
    for k in range(rounds):
        salt, halves, run_salt = stream(20 + k, 3)
        if not len(sym):
            return
        if k in RUN_ROUNDS:
            first = np.ones(len(sym), bool)
            first[1:] = (sym[1:] != sym[:-1]) | (doc[1:] != doc[:-1])
            old_lo, old_hi, old_doc = lo, hi, doc
            sym, lo, hi, at, size = _merge(sym, lo, hi, first, lambda at, size, s=sym, z=run_salt: mix((s[at] ^ z) + size.astype(U64)))
            doc = doc[at]
            # a run ends where the neighbours differ: they were looked at
            before, after = at - 1, at + size
            has = (before >= 0) & (old_doc[before] == doc)
            lo = np.where(has, old_lo[before], lo - 1)
            after_in = np.minimum(after, len(old_hi) - 1)
            has = (after < len(old_hi)) & (old_doc[after_in] == doc)
            hi = np.where(has, old_hi[after_in], hi + 1)
        right = (mix(sym ^ halves) & U64(1)).astype(bool)
        same_doc = np.zeros(len(sym) + 1, bool)
        same_doc[1:-1] = doc[1:] == doc[:-1]
        joins = same_doc[1:-1] & ~right[:-1] & right[1:]
        second = np.zeros(len(sym), bool)
        second[1:] = joins
        first_of_pair = np.zeros(len(sym), bool)
        first_of_pair[:-1] = joins
        # one that stays alone has looked at its one possible partner, or at the document's edge
        alone = ~(second | first_of_pair)
        new_lo, new_hi = lo.copy(), hi.copy()
        r = np.flatnonzero(alone & right)
        new_lo[r] = np.where(same_doc[r], lo[r - 1], lo[r] - 1)
        x = np.flatnonzero(alone & ~right)
        new_hi[x] = np.where(same_doc[x + 1], hi[np.minimum(x + 1, len(hi) - 1)], hi[x] + 1)
        names = lambda at, size, s=sym, z=salt: mix(mix(s[at] ^ z) + s[np.minimum(at + 1, len(s) - 1)])
        sym, lo, hi, at, _ = _merge(sym, new_lo, new_hi, ~second, names)
        doc = doc[at]
        yield sym, lo, hi


def window_keys(hashes: np.ndarray, first: np.ndarray, width: int = WINDOW, rounds: int = ROUNDS, grams: int = GRAMS):
    """Runs of consecutive windows keyed by one symbol occurrence: arrays (key, doc, first start, windows,
    offset of the key's interval in the first window), starts counted in the document."""
    counts = np.diff(first)
    doc = np.repeat(np.arange(len(counts)), counts)
    levels = list(recompress(hashes, doc, rounds))
    sym, lo, hi = levels[-1]
    for k in range(2, grams + 1):  # neighbouring symbols of the highest level together say more than one
        if len(sym) >= k:
            levels.append((sequence_hashes(sym, k, 70 + k), lo[:len(lo) - k + 1], hi[k - 1:]))
    n_windows = np.maximum(counts - width + 1, 0)
    total = int(n_windows.sum())
    wdoc = np.repeat(np.arange(len(counts)), n_windows)
    start = np.arange(total) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    coordinate = start + first[wdoc] + 2 * wdoc + 1
    key, where, level_of = np.zeros(total, U64), np.zeros(total, np.int64), np.zeros(total, np.int8)
    todo = np.arange(total)
    for level in range(len(levels) - 1, -1, -1):
        if not len(todo):
            break
        sym, lo, hi = levels[level]
        at = coordinate[todo]
        a, b = np.searchsorted(lo, at, "left"), np.searchsorted(hi, at + width, "right")
        full = b > a
        if full.any():
            index = np.arange(len(sym), dtype=U64)
            ranked = np.append((mix(sym) & ~U64((1 << 28) - 1)) | index, U64(0))
            cuts = np.empty(2 * int(full.sum()), np.int64)
            cuts[::2], cuts[1::2] = a[full], b[full]
            best = (np.minimum.reduceat(ranked, cuts)[::2] & U64((1 << 28) - 1)).astype(np.int64)
            rows = todo[full]
            key[rows], where[rows], level_of[rows] = mix(sym[best] + U64(level)), lo[best], level
        todo = todo[~full]
    new = np.ones(total, bool)
    new[1:] = (where[1:] != where[:-1]) | (level_of[1:] != level_of[:-1]) | (wdoc[1:] != wdoc[:-1])
    at = np.flatnonzero(new)
    return key[at], wdoc[at], start[at], np.diff(np.append(at, total)), (where - coordinate)[at]


def _ragged(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, .. (count[i] of them) for all i in a row."""
    at = np.cumsum(count) - count
    return np.arange(int(count.sum())) - np.repeat(at, count) + np.repeat(first, count)


def _span_hashes(hashes: np.ndarray, begin: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """Hash of the words begin[i] .. begin[i] + wide[i] - 1 for all i."""
    if not len(begin):
        return np.zeros(0, U64)
    power = np.cumprod(np.full(int(wide.max()), stream(51, 1)[0] | U64(1)))
    at = np.cumsum(wide) - wide
    return mix(np.add.reduceat(hashes[_ragged(begin, wide)] * power[_ragged(np.zeros(len(wide), np.int64), wide)], at))


def _occurrences(batch: pa.RecordBatch):
    ids, rows = batch.column("doc_id"), batch.column("row")
    for row, last, data, offsets in text_blocks(batch.column("text")):
        words = find_words(data, offsets)
        key, doc, start, n, place = window_keys(word_hashes(words), words.first)
        covered = _span_hashes(word_hashes(words, 2), words.first[doc] + start, n + WINDOW - 1)
        take = pa.array(doc + row)
        yield pa.RecordBatch.from_arrays(
            [pa.array(key.view(np.int64)), pa.array(covered.view(np.int64)), ids.take(take), rows.take(take), pa.array(start, pa.int32()),
             pa.array(n, pa.int16()), pa.array(place, pa.int16())],
            names=["key", "covered", "doc_id", "row", "start", "n", "place"])


_OCCURRENCE = "key long, covered long, doc_id long, row int, start int, n short, place short"


def _windows(batch: pa.RecordBatch):
    """One row per window of the ranges ``found`` in each text: the key and its place in the window, the window's hash."""
    ids, rows, found = batch.column("doc_id"), batch.column("row"), batch.column("found")
    for row, last, data, offsets in text_blocks(batch.column("text")):
        words = find_words(data, offsets)
        ranges = found.slice(row, last - row)
        doc = np.repeat(np.arange(last - row), ranges.value_lengths().to_numpy())
        key, start, n, place = (ranges.flatten().field(k).to_numpy() for k in range(4))
        n = n.astype(np.int64)
        step = _ragged(np.zeros(len(n), np.int64), n)
        grams = sequence_hashes(word_hashes(words, 2), WINDOW, 60)
        begin = _ragged(words.first[doc] + start, n)
        take = pa.array(np.repeat(doc + row, n))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(key, n)), pa.array((np.repeat(place, n) - step).astype(np.int32)), pa.array(grams[begin].view(np.int64)),
             ids.take(take), rows.take(take), pa.array((np.repeat(start, n) + step).astype(np.int32))],
            names=["key", "place", "window", "doc_id", "row", "start"])


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, row, start, n): ``n`` consecutive windows from ``start`` on that start earlier too, of the
    rows (doc_id, row, text) of ``docs``; null ids as the largest long."""
    found = cut(map_arrow(docs.where("text IS NOT NULL"), _occurrences, _OCCURRENCE))
    keys = found.groupBy("key").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("key")
    shared = cut(found.join(keys, "key"))
    discard(found)
    same = ["key", "covered", "n", "place"]
    classes = cut(shared.groupBy(*same).agg(F.min(F.struct("doc_id", "start")).alias("e"), F.count(F.lit(1)).alias("times")))
    earliest = classes.where("times > 1").select(*same, F.col("e.doc_id").alias("e_doc"), F.col("e.start").alias("e_start"))
    later = cut(shared.join(earliest, same).where("doc_id <> e_doc OR start <> e_start").select("doc_id", "row", "start", "n"))
    # keys with several classes: windows of the classes' earliest members, compared one by one
    mixed = classes.groupBy("key").agg(F.count(F.lit(1)).alias("classes")).where("classes > 1").select("key")
    heads = shared.join(classes.join(mixed, "key").select(*same, F.col("e.doc_id").alias("doc_id"), F.col("e.start").alias("start")),
                        [*same, "doc_id", "start"], "left_semi")
    by_doc = heads.groupBy("doc_id", "row").agg(F.array_distinct(F.collect_list(F.struct("key", "start", "n", "place"))).alias("found"))
    windows = cut(map_arrow(docs.join(by_doc, ["doc_id", "row"]).select("doc_id", "row", "text", "found"), _windows,
                            "key long, place int, window long, doc_id long, row int, start int"))
    discard(shared, classes)
    same = ["key", "place", "window"]
    first = windows.groupBy(*same).agg(F.min(F.struct("doc_id", "start")).alias("e"), F.max(F.struct("doc_id", "start")).alias("l")) \
                   .where("e <> l").select(*same, F.col("e.doc_id").alias("e_doc"), F.col("e.start").alias("e_start"))
    again = windows.join(first, same).where("doc_id <> e_doc OR start <> e_start") \
                   .select("doc_id", "row", "start", F.lit(1).cast("short").alias("n"))
    again = cut(again)
    discard(windows)
    return later.unionByName(again)


def _keep(batch: pa.RecordBatch):
    """Texts without the words that repeated windows cover, and the counts."""
    for row, last, data, offsets in text_blocks(batch.column("text")):
        words = find_words(data, offsets)
        spans = batch.column("gone").slice(row, last - row)
        per_doc = pc.fill_null(spans.value_lengths(), 0).to_numpy(zero_copy_only=False)
        flat = spans.flatten()
        begin = words.first[np.repeat(np.arange(last - row), per_doc)] + flat.field(0).to_numpy(zero_copy_only=False)
        depth = np.zeros(len(words.starts) + 1, np.int64)
        np.add.at(depth, begin, 1)
        np.add.at(depth, begin + flat.field(1).to_numpy(zero_copy_only=False) + WINDOW - 1, -1)
        keep = np.cumsum(depth)[:-1] == 0
        raw, starts, ends = data.tobytes(), words.starts.tolist(), words.ends.tolist()
        texts, removed = [], []
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
            stay = np.flatnonzero(keep[a:b]) + a
            removed.append(b - a - len(stay))
            texts.append(b" ".join([raw[starts[i]:ends[i]] for i in stay.tolist()]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("whole").slice(row, last - row), pa.array(texts, pa.binary()).cast(pa.string()),
             pa.array(np.diff(words.first), pa.int64()), pa.array(removed, pa.int64())],
            names=["whole", "kept", "n_words", "n_removed"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(whole, kept, n_words, n_removed) per row of ``docs``: the row as a struct, its remaining text, counts."""
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("whole")).select(
        F.coalesce(F.col("whole.doc_id").cast("long"), F.lit(_LAST)).alias("doc_id"),
        F.hash("whole.text").alias("row"), F.col("whole.text").alias("text"), "whole")
    gone = repeated_windows(keyed.select("doc_id", "row", "text")) \
        .groupBy("doc_id", "row").agg(F.collect_set(F.struct("start", "n")).alias("gone"))
    out = keyed.join(gone, ["doc_id", "row"], "left").select("whole", "text", "gone")
    kind = out.schema["whole"].dataType.simpleString()
    return map_arrow(out, _keep, f"whole {kind}, kept string, n_words long, n_removed long")


def op3_recompression_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document left after removal of windows that repeat earlier ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("whole.doc_id", "n_words", "n_removed",
                                       F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
