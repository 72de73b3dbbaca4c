"""Words, packing and SentencePiece against plain Python and the libraries themselves."""

import collections
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sqlprism.llm import packing, pieces
from sqlprism.llm.blocks import find_words, sequence_hashes, text_blocks, word_hashes

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
odd_text = st.text(st.sampled_from(list("abAB ,.!'s▁é́ß12 \n\t<|>日🙂td ll$%≠\x0b\x1c\xa0")), max_size=40)


@settings(max_examples=60, deadline=None)
@given(st.lists(odd_text, max_size=8))
def test_words_match_bytes_split(some):
    for block in (1, 1 << 20):
        got = []
        for _, _, data, offsets in text_blocks(pa.array(some, pa.string()), block):
            w = find_words(data, offsets, lower=True)
            got += [[w.data[a:b].tobytes() for a, b in zip(w.starts[x:y], w.ends[x:y])] for x, y in zip(w.first[:-1], w.first[1:])]
        assert got == [t.encode().lower().split() for t in some]


def test_hashes_depend_on_content_only():
    data = b"aa bb aa bb cc" + b"y" * 70_000 + b" " + b"y" * 70_001 + b" z"
    w = find_words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    h = word_hashes(w)
    assert h[0] == h[2] and h[1] == h[3] and len(set(h.tolist())) == 5 and len(h) == 7
    short = find_words(np.frombuffer(b"aa bb", np.uint8), np.array([0, 5]))
    assert word_hashes(short).tolist() == h[:2].tolist()  # whatever else is in the block
    g = sequence_hashes(h, 2)
    assert g[0] == g[2] and g[0] != g[1] and len(sequence_hashes(h, 9)) == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(odd_text, min_size=1, max_size=8))
def test_ids_match_the_libraries(some):
    words, model = Tokenizer.from_file(WORDS), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert [x.tolist() for x in packing.encoded(pa.array(some, pa.string()), WORDS)] == [words.encode(t, add_special_tokens=False).ids for t in some]
    split = [pieces.chunks(t) for t in some]
    table = pieces._table(PIECES).of(split)
    assert [np.frombuffer(b"".join(table[c] for c in cs), "<u4").tolist() for cs in split] == model.encode(some)


def test_packing_covers_every_id_once(docs, no_docs, texts):
    rows = packing.pack(docs, WORDS, window=256).toPandas()
    tokenizer = Tokenizer.from_file(WORDS)
    ids = [(i, np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes()) for i, t in texts]
    times = collections.Counter(i for i, _ in ids)
    for doc_id, raw in ids:
        if doc_id is not None and times[doc_id] == 1:
            some = rows[rows.doc_id == doc_id].sort_values("start")
            assert some.start.tolist() == [0, *some.length.cumsum()[:-1]] and b"".join(some.ids) == raw
            assert (some.doc_tokens == len(raw) // 4).all()
    for doc_id in (3, 4):  # several rows of one doc_id
        assert rows[rows.doc_id == doc_id].length.sum() == sum(len(raw) // 4 for i, raw in ids if i == doc_id)
    assert rows[rows.doc_id.isna()].length.sum() == sum(len(raw) // 4 for i, raw in ids if i is None)
    assert (rows.length == rows.ids.map(len) // 4).all() and (rows.ids_crc32 == rows.ids.map(zlib.crc32)).all()
    for _, some in rows.groupby("sequence_id"):
        some = some.sort_values("offset")
        assert some.offset.tolist() == [0, *some.length.cumsum()[:-1]]
        n = int(some.length.sum())
        assert n == 256 or n & (n - 1) == 0  # no padding at all
    assert packing.pack(no_docs, WORDS).count() == 0


def test_sum_of_squares_choice():
    packer = packing.SumOfSquares(10, 0)
    for i, size in enumerate([4, 4, 4]):
        assert list(packer.place(i, 0, size)) == []
    # one window at 8 and one at 4: after 4, 4 the rule prefers levels that differ
    assert int((packer.level ** 2).sum()) <= 3
    full = list(packer.place(9, 0, 6)) or list(packer.place(9, 0, 2))
    assert sum(x[2] for x in full) == 10


def test_pieces_whole_table(docs, no_docs, texts):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = []
    for i, t in texts:
        ids = model.encode(t or "", add_bos=True, add_eos=True)
        want.append((i or -1, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest()))
    got = pieces.encode(docs, PIECES, keep_text=False).collect()
    assert sorted((r[0] or -1, *r[1:]) for r in got) == sorted(want)
    both = pieces.encode(docs, PIECES)
    assert sorted(r.decoded for r in both.collect()) == sorted(r.text for r in pieces.decode(both, PIECES).collect())
    assert pieces.encode(no_docs, PIECES).count() == 0


def test_model_with_crossing_pieces_is_refused():
    class Model:
        def vocab_size(self):
            return 2

        def id_to_piece(self, i):
            return ["▁a", "a▁b"][i]

    with pytest.raises(ValueError):
        pieces.check_model(Model())
