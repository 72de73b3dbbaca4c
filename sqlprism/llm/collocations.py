"""Phrase collocations by SON partitioning (``op11_son_collocations``).

Texts are lower-cased (A-Z), cut at ``.,;:!?`` and line ends into pieces, and these into words (runs outside space and tab). A phrase
is 2 or 3 words within a piece; f counts its occurrences per language, overlaps included. Phrases with a = f >= ``SUPPORT`` are
candidates. A cut after k words gives l = f(first part), r = f(rest) and floor(10^6 a a / (l r)); the least cut is the score.
A candidate is dropped if it lies in a longer candidate whose f is at least half its own. The ``TOP`` best of every language stay.

Method. Documents lie in blocks, blocks in ``SHARDS`` shards. Every shard is mined completely, at the support lowered to its share of
all text (rounded up): a phrase below that in every shard is below the support as a whole. The union of the
locally frequent phrases is then counted exactly over all shards. Both steps work on hash ranges: a block sends its distinct
phrases (64-bit hashes with the language in them, sorted, delta coded) with its counts; the task of a range holds
one shard's phrases at a time, and the candidates. Every block is answered with the exact f of each of its phrases (0 if no
candidate), so that l, r, scores and the drop rule are computed beside the text, without joins on words; the first
block that holds a candidate returns it. Marks of dropped phrases are removed by one anti join.
Products use Python integers where they could pass 64 bits.

Defined cases: null texts are empty; a null lang is ``und``; repeated rows count each; other columns are not read. Phrases are told apart by
64-bit hashes: of n distinct phrases about n c / 2^64 candidates (of c) would share one with another phrase.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sqlprism.llm.blocks import _LOWER, U64, Words, mix, stream, text_blocks, word_hashes
from sqlprism.llm.common import cut, discard, table
from sqlprism.llm.shards import blocked, by_range, keys_of, planes, rows_of, unplanes

SUPPORT, TOP, LONGEST = 10, 2000, 3
SHARDS = 5
BLOCK_BYTES, RANGE_BYTES = 2 << 20, 5 << 20

_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_GAP = _BREAK.copy()
_GAP[[0x20, 0x09]] = True


class Grams(NamedTuple):
    """Of a block: its words, and for k words the hash of the phrase at every place of ``at[k - 1]`` (number of its first word)."""

    words: list[Words]
    doc: np.ndarray
    keys: list[np.ndarray]
    at: list[np.ndarray]


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray]:
    """Words of the documents, and the number of the piece that holds each."""
    data = _LOWER[data]
    solid = np.ones(len(data) + 2, bool)
    solid[0] = solid[-1] = False
    np.logical_not(_GAP[data], out=solid[1:-1])
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(solid[1:-1] & (~solid[:-2] | edge[:-1]))
    ends = np.flatnonzero(solid[1:-1] & (~solid[2:] | edge[1:])) + 1
    piece = np.cumsum(_BREAK[data].astype(np.int64) + edge[:-1])
    return Words(data, starts, ends, np.searchsorted(starts, offsets)), piece[starts]


def _language_hash(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def grams(langs: list[str], texts: pa.Array) -> Grams:
    """Phrases of up to ``LONGEST`` words of a block's documents."""
    of_lang = {lang: _language_hash(lang) for lang in set(langs)}
    salt = np.array([of_lang[lang] for lang in langs], U64)
    words, pieces, hashes, docs, far = [], [], [], [], 0
    for row, last, data, offsets in text_blocks(texts):
        w, piece = _words(data, offsets)
        words.append(w)
        docs.append(w.doc + row)
        hashes.append(mix(word_hashes(w) ^ salt[docs[-1]]))
        pieces.append(piece + far)
        far += len(data) + len(offsets)
    join = lambda xs, kind: np.concatenate([np.zeros(0, kind), *xs])
    word, piece, doc = join(hashes, U64), join(pieces, np.int64), join(docs, np.int64)
    keys, at = [word], [np.arange(len(word))]
    for k in range(2, LONGEST + 1):
        start = at[-1][at[-1] + k - 1 < len(word)]
        inside = piece[start] == piece[start + k - 1]
        longer = keys[-1][:len(start)][inside]
        start = start[inside]
        keys.append(mix(mix(longer ^ stream(40 + k, 1)[0]) + word[start + k - 1]))
        at.append(start)
    return Grams(words, doc, keys, at)


def _langs(column: pa.Array) -> list[str]:
    return ["und" if x is None else x for x in column.to_pylist()]


def _ask(ranges: int):
    """A row per block and hash range: distinct phrases and counts of every length."""
    binaries = pa.list_(pa.binary())

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                docs = rows_of(batch.column("data")[i])
                found = grams(_langs(docs.column("lang")), docs.column("text"))
                coded = [list(by_range(*np.unique(keys, return_counts=True), ranges)) for keys in found.keys]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(ranges), pa.int32()), pa.array([batch.column("block")[i].as_py()] * ranges, pa.int64()),
                     *(pa.array([[c[r][x] for c in coded] for r in range(ranges)], binaries) for x in (0, 1))], names=["part", "block", "keys", "counts"])
    return run


def frequent(lists: list[tuple[int, np.ndarray, np.ndarray]], local: list[int], support: int) -> tuple[np.ndarray, np.ndarray]:
    """(phrases, exact counts) with at least ``support`` among (shard, sorted phrases, counts) rows: shards are mined
    one after the other at their ``local`` supports, then the union of what they give is counted over all rows."""
    mined = [np.zeros(0, U64)]
    for shard, least in enumerate(local):
        own = [x for x in lists if x[0] == shard]
        if not own:
            continue
        keys = np.concatenate([x[1] for x in own])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[:len(keys)])
        counts = np.add.reduceat(np.concatenate([x[2] for x in own])[order], new) if len(new) else keys
        mined.append(keys[new][counts >= least])
    candidates = np.unique(np.concatenate(mined))
    totals = np.zeros(len(candidates), U64)
    for _, keys, counts in lists:
        place = np.searchsorted(candidates, keys)
        hit = place < len(candidates)
        hit[hit] = candidates[place[hit]] == keys[hit]
        totals[place[hit]] += counts[hit]  # the phrases of one block are distinct
    keep = totals >= support
    return candidates[keep], totals[keep]


def _answer(local: list[int], support: int, ranges: int):
    """Exact counts of a hash range, for every block in the order it asked."""
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("block")
        part = group.column("part")[0].as_py()
        blocks, shards = group.column("block").to_pylist(), group.column("shard").to_pylist()
        out = [[] for _ in blocks]
        for k in range(LONGEST):
            keys, counts = (pc.list_element(group.column(n), k).to_pylist() for n in ("keys", "counts"))
            lists = [(shard, keys_of(ks, part, ranges), unplanes(cs)) for shard, ks, cs in zip(shards, keys, counts, strict=True)]
            del keys, counts
            phrases, totals = frequent(lists, local, support)
            unseen = np.ones(len(phrases), bool)
            for row, (_, asked, _) in zip(out, lists, strict=True):
                value = np.zeros(len(asked), U64)
                place = np.searchsorted(phrases, asked)
                hit = place < len(phrases)
                hit[hit] = phrases[place[hit]] == asked[hit]
                place = place[hit]
                value[hit] = totals[place] * U64(2) + unseen[place]  # the lowest bit: the first block that holds the phrase
                unseen[place] = False
                row.append(planes(value))
        return pa.table({"block": pa.array(blocks, pa.int64()), "part": group.column("part"), "totals": pa.array(out, pa.list_(pa.binary()))})
    return run


def _score(a: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """floor(10^6 a a / (left right)), exactly."""
    small = (a < 3_000_000) & (left < 3_000_000_000) & (right < 3_000_000_000)
    out = np.zeros(len(a), np.int64)
    out[small] = 1_000_000 * a[small] * a[small] // (left[small] * right[small])
    for i in np.flatnonzero(~small):
        out[i] = 1_000_000 * int(a[i]) ** 2 // (int(left[i]) * int(right[i]))
    return out


_FOUND = "kind int, lang string, key long, phrase string, a long, l long, r long, score long"


def _resolve(blocks: pa.Table, answers: pa.Table) -> pa.Table:
    """Of one block: words by language (kind 1), candidates it is the first to hold (kind: their words), and keys of
    phrases that one of these covers (kind 0)."""
    out = {f.split()[0]: [] for f in _FOUND.split(", ")}
    kinds = dict(zip(out, (pa.int32(), pa.string(), pa.int64(), pa.string(), *[pa.int64()] * 4), strict=True))
    if blocks.num_rows:
        docs = rows_of(blocks.column("data")[0])
        langs, texts = _langs(docs.column("lang")), docs.column("text")
        answers = answers.sort_by("part")
        found = grams(langs, texts)
        raw, starts, ends = [], [], []
        for w in found.words:
            base = sum(len(x) for x in raw)
            raw.append(w.data)
            starts.append(w.starts + base)
            ends.append(w.ends + base)
        data = b"".join(x.tobytes() for x in raw)
        starts, ends = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (starts, ends))

        def add(kind, **columns):
            n = len(next(iter(columns.values())))
            for name, values in out.items():
                values.append(pa.array(np.full(n, kind, np.int32)) if name == "kind" else pa.array(columns[name], kinds[name]) if name in columns else pa.nulls(n, kinds[name]))

        per = np.bincount(found.doc, minlength=len(langs))
        sums: dict[str, int] = {}
        for lang, n in zip(langs, per.tolist(), strict=True):
            sums[lang] = sums.get(lang, 0) + n
        add(1, lang=list(sums), a=list(sums.values()))
        count, own, first, key_at = [], [], [], []
        for k, (keys, at) in enumerate(zip(found.keys, found.at, strict=True), 1):
            _, index, inverse = np.unique(keys, return_index=True, return_inverse=True)
            value = np.concatenate([np.zeros(0, U64), *map(unplanes, pc.list_element(answers.column("totals"), k - 1).to_pylist())])
            total = np.zeros(len(starts) + LONGEST, np.int64)  # by first word
            total[at] = (value >> U64(1)).astype(np.int64)[inverse]
            key = np.zeros(len(starts) + LONGEST, U64)
            key[at] = keys
            count.append(total)
            key_at.append(key)
            own.append((value & U64(1)).astype(bool))
            first.append(at[index])
        one, two, three = count
        place = first[1][own[1]]
        pairs = (place, two[place], one[place], one[place + 1])
        place = first[2][own[2]]
        a = three[place]
        cuts = [(one[place], two[place + 1]), (two[place], one[place + 2])]
        scores = [_score(a, *c) for c in cuts]
        later = scores[1] < scores[0]
        triples = (place, a, np.where(later, cuts[1][0], cuts[0][0]), np.where(later, cuts[1][1], cuts[0][1]))
        for k, (at, a, left, right) in ((2, pairs), (3, triples)):
            add(k, lang=[langs[d] for d in found.doc[at]], key=key_at[k - 1][at].view(np.int64), a=a, l=left, r=right, score=_score(a, left, right),
                phrase=[b" ".join(data[starts[i + j]:ends[i + j]] for j in range(k)).decode() for i in at.tolist()])
        covered = np.concatenate([key_at[1][(place + j)[100 * a >= 50 * two[place + j]]] for j in (0, 1)])
        add(0, key=np.unique(covered).view(np.int64))
    return pa.table({n: pa.concat_arrays([pa.array([], kinds[n]), *values]) for n, values in out.items()})


def collocations(docs: DataFrame, support: int = SUPPORT, top: int = TOP, shards: int = SHARDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the best phrases of every language of ``docs`` (text, lang)."""
    blocks = blocked(docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")), block_bytes)
    mixed = F.pmod(F.xxhash64("block"), F.lit(shards)).cast("int")
    sizes = {r[0]: r[1] for r in blocks.groupBy(mixed).agg(F.sum("bytes")).collect()}
    size = sum(sizes.values())
    local = [max(1, -(-support * sizes.get(s, 0) // max(size, 1))) for s in range(shards)]  # a share of the support, rounded up
    ranges = 1 + size // RANGE_BYTES
    asked = blocks.select("block", "data").mapInArrow(_ask(ranges), "part int, block long, keys array<binary>, counts array<binary>")
    answers = cut(asked.withColumn("shard", mixed).groupBy("part").applyInArrow(_answer(local, support, ranges), "block long, part int, totals array<binary>"))
    found = cut(blocks.select("block", "data").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_resolve, _FOUND))
    discard(blocks, answers)
    covered = found.where("kind = 0").select("key").distinct()
    kept = found.where("kind = 2").join(covered, "key", "left_anti").unionByName(found.where("kind = 3"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    words = found.where("kind = 1").groupBy("lang").agg(F.sum("a").alias("n"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= top).join(words, "lang") \
        .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_son_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of every language of all documents."""
    return collocations(table(spark, sf_dir, "documents"))


ORACLES = {
    "op11_son_collocations": """
WITH p AS (SELECT row_number() OVER () AS piece, lang, text FROM (
             SELECT coalesce(lang, 'und') AS lang,
                    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS text
             FROM documents)),
w AS (SELECT piece, lang, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT piece, lang, regexp_extract_all(text, '[^\\x20\\x09]+') AS ws FROM p)),
o AS (SELECT lang, w AS w1, lead(w) OVER here AS w2, lead(w, 2) OVER here AS w3 FROM w WINDOW here AS (PARTITION BY piece ORDER BY i)),
one AS (SELECT lang, w1, count(*)::BIGINT AS f FROM o GROUP BY ALL),
two AS (SELECT lang, w1, w2, count(*)::BIGINT AS f FROM o WHERE w2 IS NOT NULL GROUP BY ALL),
three AS (SELECT lang, w1, w2, w3, count(*)::BIGINT AS f FROM o WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM one GROUP BY lang),
s AS (SELECT c.lang, c.w1 || ' ' || c.w2 AS phrase, c.f AS a, x.f AS l, y.f AS r, 1 AS head
      FROM two c JOIN one x ON (x.lang, x.w1) = (c.lang, c.w1) JOIN one y ON (y.lang, y.w1) = (c.lang, c.w2)
      WHERE c.f >= 10 AND NOT EXISTS (FROM three t WHERE (t.lang, t.w1, t.w2) = (c.lang, c.w1, c.w2) AND 100 * t.f >= 50 * c.f)
        AND NOT EXISTS (FROM three t WHERE (t.lang, t.w2, t.w3) = (c.lang, c.w1, c.w2) AND 100 * t.f >= 50 * c.f)
      UNION ALL SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, c.f, x.f, y.f, 1
      FROM three c JOIN one x ON (x.lang, x.w1) = (c.lang, c.w1) JOIN two y ON (y.lang, y.w1, y.w2) = (c.lang, c.w2, c.w3)
      UNION ALL SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, c.f, x.f, y.f, 2
      FROM three c JOIN two x ON (x.lang, x.w1, x.w2) = (c.lang, c.w1, c.w2) JOIN one y ON (y.lang, y.w1) = (c.lang, c.w3)),
scored AS (SELECT *, (1000000::HUGEINT * a * a // (l::HUGEINT * r))::BIGINT AS score FROM s),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, head) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
""",
}
