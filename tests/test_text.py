"""Text features against brute force on small texts."""

import math
from collections import Counter

import regex

from sqlprism.operators import text


def texts(spark, rows):
    return spark.createDataFrame([(f"t{i}", "ds", "s", t) for i, t in enumerate(rows)],
                                 "text_id string, dataset string, split string, text string")


SAMPLE = ["The cat sat. The dog ran far away!", "One two three two one two. Another sentence here"]


def test_length_and_readability(spark):
    df = texts(spark, SAMPLE)
    r = {x.text_id: x for x in text.readability(df).join(text.length(df), ["text_id", "dataset", "split"]).collect()}
    w = regex.findall(r"\p{L}+", SAMPLE[0].lower())
    syl = sum(max(len(regex.findall(text.VOWELS, x)), 1) for x in w)
    flesch = 206.835 - 1.015 * (len(w) / 2) - 84.6 * (syl / len(w))
    assert r["t0"].length == 8
    assert abs(r["t0"].flesch_reading_ease - flesch) < 1e-8
    assert abs(r["t0"].mcalpine_eflaw - (8 + sum(len(x) <= 3 for x in w)) / 2) < 1e-8


def test_lexical_richness_brute_force(spark):
    rows = ["a b a c a b d e f g " * 5 + "h i j", "x y z x"]
    got = {r.text_id: r for r in text.lexical_richness(texts(spark, rows)).collect()}
    for i, t in enumerate(rows):
        w = regex.findall(r"\p{L}+", t.lower())
        n, f = len(w), Counter(w)
        v = len(f)
        r = got[f"t{i}"]
        assert r.n_tokens == n and r.n_types == v
        assert abs(r.ttr - v / n) < 1e-8
        assert abs(r.yule_k - 1e4 * (sum(c * c for c in f.values()) - n) / n ** 2) < 1e-6
        ent = -sum(c / n * math.log2(c / n) for c in f.values())
        assert abs(r.entropy - ent) < 1e-8
        if n >= 42:
            hdd = 0.0
            for c in f.values():
                p0 = 1.0
                for j in range(42):
                    p0 *= (n - c - j) / (n - j)
                hdd += (1 - p0) / 42
            assert abs(r.hdd - hdd) < 1e-8
        else:
            assert r.hdd is None


def test_heap_tree_depth(spark):
    # heads floor(tok/2): depth = floor(log2(n)), edges n - 1
    rows = [("t", 0, k, f"w{k}", f"w{k}", "OPEN", k // 2) for k in range(1, 14)]
    toks = spark.createDataFrame(rows, "text_id string, sent_id int, tok_id int, form string, lemma string, "
                                       "upos string, head int")
    r = text.dependency_metrics(toks).first()
    assert r.depth == 3 and r.dependencies_num == 12
    assert r.leaves == 13 - 6  # nodes 1..6 have children
    depths = [int(math.log2(k)) for k in range(1, 14)]
    assert abs(r.closeness_centrality - round(12 / sum(depths), 9)) < 1e-9


def test_dispersion_brute_force(spark):
    rows = ["a b a c a b d", "x y z"]
    got = {r.text_id: r for r in text.dispersion(texts(spark, rows)).collect()}
    w = rows[0].split()
    n = len(w)
    ginis, evens = [], []
    for word in set(w):
        pos = [i for i, x in enumerate(w) if x == word]
        f = len(pos)
        if f < 2:
            continue
        gaps = [pos[i + 1] - pos[i] for i in range(f - 1)] + [n - pos[-1] + pos[0]]
        g = sorted(gaps)
        gini = 2 * sum((k + 1) * v for k, v in enumerate(g)) / (f * n) - (f + 1) / f
        ginis.append(1 - gini)
        evens.append(-sum(v / n * math.log2(v / n) for v in gaps) / math.log2(f))
    assert abs(got["t0"].gini_dispersion - sum(ginis) / len(ginis)) < 1e-8
    assert abs(got["t0"].evenness_dispersion - sum(evens) / len(evens)) < 1e-8
    assert got["t1"].gini_dispersion is None


def test_heads_with_gaps_and_elements_with_digits(spark):
    toks = spark.createDataFrame([("a", 0, 1, "x", "x", "OPEN", 0), ("a", 0, 3, "y", "y", "OPEN", 1), ("a", 0, 4, "z", "z", "OPEN", 3)],
                                 "text_id string, sent_id int, tok_id int, form string, lemma string, upos string, head int")
    r = text.dependency_metrics(toks).first()
    assert (r.depth, r.dependencies_num, r.leaves) == (2, 2, 1)
    q = spark.createDataFrame([(1, "d", "show Address line 1, of all"), (2, "d", None), (3, "e", "x")], "datapoint_id long, db_id string, question string")
    el = spark.createDataFrame([("d", "address_line_1"), ("d", "a,b"), ("d", "line")], "db_id string, element string")
    got = {r.datapoint_id: r.references for r in text.schema_references(q, el).collect()}
    assert got == {1: ["address_line_1", "line"], 2: [], 3: None}


def test_texts_without_content_words_are_kept(spark):
    toks = spark.createDataFrame([("a", 0, 1, "the", "the", "CLOSED", 0), ("b", 0, 1, "Cat", "cat", "OPEN", 0)],
                                 "text_id string, sent_id int, tok_id int, form string, lemma string, upos string, head int")
    words = spark.createDataFrame([("cat", 5)], "form string, freq long")
    assert sorted((r.text_id, r.rarity, r.rare_words) for r in text.rarity(toks, words).collect()) == [("a", None, 0), ("b", 0.0, 0)]
    assert sorted((r.text_id, r.words_freq) for r in text.word_frequency_mean(toks, words).collect()) == [("a", None), ("b", 5.0)]


TOKENS = "text_id long, sent_id int, tok_id int, form string, lemma string, upos string, head int"


def test_lemmas_refer_to_elements(spark):
    q = spark.createDataFrame([(1, "d", "Names of the singers?"), (2, "d", "all concerts"), (3, "e", "singers")], "datapoint_id long, db_id string, question string")
    toks = spark.createDataFrame([(1, 0, 1, "Names", "name", "NOUN", 0), (1, 0, 2, "of", "of", "ADP", 1), (1, 0, 3, "the", "the", "DET", 1),
                                  (1, 0, 4, "singers", "singer", "NOUN", 1), (2, 0, 1, "all", None, "DET", 2), (2, 0, 2, "concerts", "concert", "NOUN", 0)], TOKENS)
    el = spark.createDataFrame([("d", "singer", "singer"), ("d", "concerts", "concert"), ("d", "names_of", "name of"), ("d", "singer_id", "singer id")],
                               "db_id string, element string, lemma string")
    got = {r.datapoint_id: r.references for r in text.schema_references(q, el, tokens=toks).collect()}
    assert got == {1: ["names_of", "singer"], 2: ["concerts"], 3: None}
    assert {r.datapoint_id: r.references for r in text.schema_references(q, el.drop("lemma"), tokens=toks).collect()} == got


def test_rarity_by_form_and_tag_without_names(spark):
    toks = spark.createDataFrame([(1, 0, 1, "Run", "run", "NOUN", 0), (1, 0, 2, "run", "run", "VERB", 1), (1, 0, 3, "Oslo", "Oslo", "PROPN", 1),
                                  (1, 0, 4, "the", "the", "DET", 1), (2, 0, 1, "Oslo", "Oslo", "PROPN", 0)], TOKENS)
    words = spark.createDataFrame([("run", "VERB", 5), ("run", "X", 2), ("the", "DET", 9)], "form string, upos string, freq long")
    assert sorted((r.text_id, r.rarity, r.rare_words) for r in text.rarity(toks, words).collect()) == [(1, 0.5, 1), (2, None, 0)]
    freq = {r.text_id: r.words_freq for r in text.word_frequency_mean(toks, words).collect()}
    assert freq == {1: round(14 / 3, 9), 2: 0.0}  # by form, names among the content words


def test_longest_path_is_the_mean_of_sentence_depths(spark):
    toks = spark.createDataFrame([(1, 0, k, "w", "w", "NOUN", k - 1) for k in range(1, 5)] + [(1, 1, 1, "w", "w", "NOUN", 0)], TOKENS)
    assert text.longest_shortest_path(toks).first().longest_shortest_path == 1.5


def test_closeness_centralization_by_hand(spark):
    # 1 <- 2, 1 <- 3, 3 <- 5 (ids have a gap), and a chain 9 <- 8 <- 7; a sentence of one word counts nothing
    rows = [("t", 0, 1, 0), ("t", 0, 2, 1), ("t", 0, 3, 1), ("t", 0, 5, 3), ("t", 1, 9, 0), ("t", 1, 8, 9), ("t", 1, 7, 8), ("u", 0, 1, 0)]
    got = {r.text_id: r.closeness_centralization for r in text.closeness_centralization(
        spark.createDataFrame(rows, "text_id string, sent_id int, tok_id int, head int")).collect()}
    one = (4 * 1.0 - (3 / 4 + 1.0)) / 3  # c: root 3 / (1 + 1 + 2), node 3 1 / 1, leaves 0
    two = (3 * 1.0 - (2 / 3 + 1.0)) / 2
    assert abs(got["t"] - (one + two) / 2) < 1e-9 and got["u"] is None
