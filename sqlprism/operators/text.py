"""Question / text features.

Inputs are any text relation (text_id, dataset, split, text) and an annotated
token relation (text_id, sent_id, tok_id, form, lemma, upos, head) that a tagger
and parser produced (the caller supplies it; see ``sources.fixtures``).

* Row-local features (length, readability) are array expressions on the text:
  no shuffle at all.
* Lexical richness needs per-text word frequencies: texts are hash-partitioned by
  ``text_id`` once, and every later aggregate (word -> frequency -> spectrum ->
  text) is keyed by text_id first, so it reuses that partitioning.
* Dependency trees are per sentence: depths come from pointer jumping over the
  sentence's head array (log2(n) rounds inside one row), no driver loop.

Scores are rounded to 9 decimals (report precision).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import let
from . import sqltokens


WORD = r"\p{L}+"
SENTENCE_END = r"[.!?\n]+"
# --- fixed values: vowel letters for syllable counting (one syllable per vowel group) ---
VOWELS = "[aeiouyáéíóúàèìòùâêîôûäëïöüåæøœ]+"
HDD_SAMPLE = 42
# --- fixed values: open word classes (OPEN: a tagger that tells open from closed only) and, of them, proper names ---
OPEN_CLASSES = ["OPEN", "ADJ", "ADV", "INTJ", "NOUN", "PROPN", "VERB"]
PROPER_NAMES = ["PROPN"]
PRECISION = 9


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), 0)


def length(texts: DataFrame, entity: str = "word") -> DataFrame:
    """Length in words (letters only, punctuation excluded) or characters."""
    n = F.size(words(F.col("text"))) if entity == "word" else F.length("text")
    return texts.select("text_id", "dataset", "split", n.cast("long").alias("length"))


def readability(texts: DataFrame) -> DataFrame:
    """T4: Flesch reading ease and McAlpine EFLAW per text.

    W words, S sentences (segments between . ! ? or line breaks holding a word),
    syllables = vowel groups per word (at least one). Flesch = 206.835 - 1.015 W/S
    - 84.6 Syl/W; EFLAW = (W + words of at most 3 letters) / S. Null without words.
    """
    w = words(F.lower("text"))
    n_w = F.size(w)
    n_s = F.size(F.filter(F.split("text", SENTENCE_END), lambda s: s.rlike(WORD)))
    syl = F.aggregate(w, F.lit(0), lambda acc, x: acc + F.greatest(F.size(F.regexp_extract_all(
        x, F.lit(VOWELS), 0)), F.lit(1)))
    mini = F.size(F.filter(w, lambda x: F.length(x) <= 3))
    ok = (n_w > 0) & (n_s > 0)
    flesch = F.when(ok, 206.835 - 1.015 * (n_w / n_s) - 84.6 * (syl / n_w))
    eflaw = F.when(ok, (n_w + mini) / n_s)
    return texts.select("text_id", "dataset", "split", F.round(flesch, PRECISION).alias("flesch_reading_ease"),
                        F.round(eflaw, PRECISION).alias("mcalpine_eflaw"))


def word_frequencies(texts: DataFrame) -> DataFrame:
    """(text_id, dataset, split, word, f, first_pos): frequency of each lower-cased word per text.

    Texts are hash-partitioned by text_id once; the explode keeps that partitioning,
    so the (text_id, word) aggregate needs no second exchange.
    """
    t = texts.select("text_id", "dataset", "split", "text").repartition("text_id")
    toks = t.select("text_id", "dataset", "split", F.posexplode(words(F.lower("text"))).alias("pos", "word"))
    return toks.groupBy("text_id", "dataset", "split", "word").agg(F.count(F.lit(1)).alias("f"))


def _ln(c: Column) -> Column:
    """Natural log, null for non-positive input."""
    return F.when(c > 0, F.log(c))


def lexical_richness(texts: DataFrame) -> DataFrame:
    """Surface lexical-richness measures per text from the frequency spectrum.

    N tokens, V types, V1/V2 types seen once/twice, f a type's frequency.
    TTR V/N, Guiraud V/sqrt(N), Herdan C ln V/ln N, Dugast k ln V/ln ln N, Maas a2
    (ln N - ln V)/ln^2 N, Dugast U ln^2 N/(ln N - ln V), Tuldava LN (1 - V^2)/(V^2 ln N),
    Brunet W N^(V^-0.172), CTTR V/sqrt(2N), Summer S ln ln V/ln ln N, Sichel S V2/V,
    Michea M V/V2, Honore H 100 ln N/(1 - V1/V), entropy -sum (f/N) log2(f/N), evenness
    entropy/log2 V, Jarvis evenness = population sd of f, Yule K 1e4 (sum f^2 - N)/N^2,
    Simpson D sum f(f-1)/(N(N-1)), Herdan Vm sqrt(sum f^2/N^2 - 1/V), HD-D sum over types
    of (1 - P(type absent from a 42-token sample))/42 (null when N < 42), mean token length.
    A zero denominator gives null.
    """
    wf = word_frequencies(texts)
    n = F.sum("f").over(Window.partitionBy("text_id"))
    wf = wf.withColumn("n_text", n)
    absent = F.when(F.col("n_text") >= HDD_SAMPLE, F.aggregate(
        F.sequence(F.lit(0), F.lit(HDD_SAMPLE - 1)), F.lit(1.0),
        lambda acc, j: acc * (F.col("n_text") - F.col("f") - j) / (F.col("n_text") - j)))
    agg = wf.groupBy("text_id", "dataset", "split").agg(
        F.sum("f").cast("double").alias("N"), F.count(F.lit(1)).cast("double").alias("V"),
        F.sum(F.when(F.col("f") == 1, 1).otherwise(0)).cast("double").alias("V1"),
        F.sum(F.when(F.col("f") == 2, 1).otherwise(0)).cast("double").alias("V2"),
        F.sum(F.col("f") * F.col("f")).cast("double").alias("S2"),
        F.sum(F.col("f") * (F.col("f") - 1)).cast("double").alias("S11"),
        F.sum(F.col("f") * F.log2("f")).alias("flogf"),
        F.stddev_pop("f").alias("sd_f"),
        F.sum(F.length("word") * F.col("f")).cast("double").alias("chars"),
        F.sum(1 - absent).alias("hdd_sum"),
    )
    N, V, V1, V2 = F.col("N"), F.col("V"), F.col("V1"), F.col("V2")

    def nz(c):
        return F.nullif(c, F.lit(0.0))

    entropy = F.log2(N) - F.col("flogf") / N
    m = {
        "ttr": V / nz(N),
        "guiraud_r": V / nz(F.sqrt(N)),
        "herdan_c": _ln(V) / nz(_ln(N)),
        "dugast_k": _ln(V) / nz(_ln(_ln(N))),
        "maas_a2": (_ln(N) - _ln(V)) / nz(_ln(N) * _ln(N)),
        "dugast_u": (_ln(N) * _ln(N)) / nz(_ln(N) - _ln(V)),
        "tuldava_ln": (1 - V * V) / nz(V * V * _ln(N)),
        "brunet_w": F.pow(N, F.pow(V, -0.172)),
        "cttr": V / nz(F.sqrt(2 * N)),
        "summer_s": _ln(_ln(V)) / nz(_ln(_ln(N))),
        "sichel_s": V2 / nz(V),
        "michea_m": V / nz(V2),
        "honore_h": 100 * _ln(N) / nz(1 - V1 / V),
        "entropy": entropy,
        "evenness": entropy / nz(F.log2(V)),
        "jarvis_evenness": F.col("sd_f"),
        "yule_k": 1e4 * (F.col("S2") - N) / nz(N * N),
        "simpson_d": F.col("S11") / nz(N * (N - 1)),
        "herdan_vm": F.sqrt(F.greatest(F.col("S2") / (N * N) - 1 / V, F.lit(0.0))),
        "hdd": F.when(N >= HDD_SAMPLE, F.col("hdd_sum") / HDD_SAMPLE),
        "avg_token_length": F.col("chars") / nz(N),
    }
    return agg.select("text_id", "dataset", "split", N.cast("long").alias("n_tokens"), V.cast("long").alias("n_types"),
                      *[F.round(v, PRECISION).alias(k) for k, v in m.items()])


def lexical_density(tokens: DataFrame) -> DataFrame:
    """Content (open-class) words / words per text."""
    return tokens.groupBy("text_id").agg(
        F.round(F.avg(F.col("upos").isin(OPEN_CLASSES).cast("double")), PRECISION).alias("lexical_density"))


def _content_frequencies(tokens: DataFrame, reference_words: DataFrame, by: list[str], classes: list[str]) -> DataFrame:
    """(text_id, n, freq): words of the given classes of each text, told apart by ``by`` (form, or form and upos), with
    their count there and their frequency in the reference list (null if absent); a text without such words keeps
    rows with n = 0. Tokens are counted per text and word before they meet the list, which is as large as its
    corpus and is never broadcast."""
    words = tokens.withColumn("form", F.lower("form")).groupBy("text_id", *by).agg(
        F.sum(F.col("upos").isin(classes).cast("long")).alias("n"))
    listed = reference_words.groupBy(*by).agg(F.sum("freq").alias("freq")) if set(reference_words.columns) > {*by, "freq"} \
        else reference_words.select(*by, "freq")
    return words.join(listed, by, "left").select("text_id", "n", "freq")


def rarity(tokens: DataFrame, reference_words: DataFrame) -> DataFrame:
    """Content words missing from the reference word list / content words (null without content words), and
    their count. Proper names are no content words here. ``reference_words``: (form, upos, freq); words meet it by
    form and tag, by the form alone if the list has no tags."""
    by = ["form", "upos"] if "upos" in reference_words.columns else ["form"]
    classes = [c for c in OPEN_CLASSES if c not in PROPER_NAMES]
    rare = F.sum(F.when(F.col("freq").isNull(), F.col("n")).otherwise(0))
    return _content_frequencies(tokens, reference_words, by, classes).groupBy("text_id").agg(
        F.round(rare / F.nullif(F.sum("n"), F.lit(0)), PRECISION).alias("rarity"), rare.cast("long").alias("rare_words"))


def word_frequency_mean(tokens: DataFrame, reference_words: DataFrame) -> DataFrame:
    """T5: mean corpus frequency (0 when unlisted) of the content words of each text (null without any)."""
    total = F.sum(F.coalesce("freq", F.lit(0)) * F.col("n"))
    return _content_frequencies(tokens, reference_words, ["form"], OPEN_CLASSES).groupBy("text_id").agg(
        F.round(total / F.nullif(F.sum("n"), F.lit(0)), PRECISION).alias("words_freq"))


def _head_places() -> Column:
    """Heads of ``nodes`` as places in the sorted sentence (0: root, or a head that the sentence lacks). Where ids run from 1 without
    gaps a head is its place; else it is looked up among the ids."""
    running = F.forall(F.transform("nodes", lambda x, i: x["tok_id"] == i + 1), lambda b: b)
    direct = F.transform("nodes", lambda x: F.when((x["head"] >= 1) & (x["head"] <= F.size("nodes")), x["head"].cast("int")).otherwise(0))
    ids = F.col("nodes.tok_id")
    return F.when(running, direct).otherwise(F.transform("nodes", lambda x: F.coalesce(F.array_position(ids, x["head"]).cast("int"), F.lit(0))))


def sentence_trees(tokens: DataFrame) -> DataFrame:
    """(text_id, sent_id, n, depth, edges, leaves, add_sum, dist_sum, max_outdeg, outdeg_sum)
    per sentence.

    Depth of every node by pointer jumping over the head array: round k replaces each
    node's ancestor a by a's ancestor and adds its distance, so ceil(log2(n + 1))
    rounds reach the root. Tree depth = max distance from the root (the root is 0).
    """
    per_sent = tokens.groupBy("text_id", "sent_id").agg(
        F.array_sort(F.collect_list(F.struct("tok_id", "head"))).alias("nodes"),
        F.sum(F.when(F.col("head") != 0, F.abs(F.col("tok_id") - F.col("head"))).otherwise(0)).alias("add_sum"),
        F.sum(F.when(F.col("head") != 0, 1).otherwise(0)).alias("edges"))
    per_sent = per_sent.withColumn("heads", _head_places())
    n = F.size("nodes")
    # index 0 is a virtual parent of the root; node i (1..n) sits at index i
    anc0 = F.concat(F.array(F.lit(0)), F.col("heads"))
    dist0 = F.concat(F.array(F.lit(0)), F.transform("nodes", lambda x: F.lit(1)))
    rounds = F.sequence(F.lit(1), F.greatest(F.ceil(F.log2(n + 1)).cast("int"), F.lit(1)))
    jumped = F.aggregate(
        rounds, F.struct(anc0.alias("anc"), dist0.alias("dist")),
        lambda acc, _: F.struct(
            F.transform(acc["anc"], lambda a: acc["anc"][a]).alias("anc"),
            F.transform(acc["dist"], lambda d, i: d + acc["dist"][acc["anc"][i]]).alias("dist")))
    kids = F.array_sort(F.filter("heads", lambda h: h > 0))
    runs = F.aggregate(kids, F.struct(F.lit(0).alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most"), F.lit(0).alias("internal")),
                       lambda acc, h: F.struct(
                           h.cast("int").alias("last"), F.when(h == acc["last"], acc["run"] + 1).otherwise(1).alias("run"),
                           F.greatest(acc["most"], F.when(h == acc["last"], acc["run"] + 1).otherwise(1)).alias("most"),
                           (acc["internal"] + F.when(h == acc["last"], 0).otherwise(1)).alias("internal")))
    t = per_sent.select("text_id", "sent_id", n.alias("n"), "add_sum", "edges",
                        F.slice(jumped["dist"], 2, n).alias("dist"), runs.alias("runs"), F.size(kids).alias("outdeg_sum"))
    return t.select("text_id", "sent_id", "n", (F.array_max("dist") - 1).alias("depth"), "edges", "add_sum",
                    F.aggregate("dist", F.lit(0), lambda a, d: a + d - 1).alias("dist_sum"),
                    (F.col("n") - F.col("runs.internal")).alias("leaves"), F.col("runs.most").alias("max_outdeg"),
                    F.col("outdeg_sum").cast("long").alias("outdeg_sum"))


def dependency_metrics(tokens: DataFrame) -> DataFrame:
    """T8-T10 per text: average dependency distance (mean over sentences of the mean |tok - head|),
    tree depth (max), dependencies (edges, sum), leaves (sum), dependents per word, closeness
    centrality of the root and outdegree centralization (means over sentences)."""
    s = sentence_trees(tokens)
    n = F.col("n")
    add = F.col("add_sum") / F.nullif(F.col("edges"), F.lit(0))
    closeness = (n - 1) / F.nullif(F.col("dist_sum").cast("double"), F.lit(0.0))
    outdeg_c = (F.col("max_outdeg") * n - F.col("outdeg_sum")) / F.nullif(((n - 1) * (n - 1)).cast("double"),
                                                                           F.lit(0.0))
    out = s.groupBy("text_id").agg(
        F.avg(add).alias("avg_dependency_distance"), F.max("depth").cast("long").alias("depth"),
        F.sum("edges").cast("long").alias("dependencies_num"), F.sum("leaves").cast("long").alias("leaves"),
        F.avg((n - 1) / n).alias("dependents_per_word"), F.avg(closeness).alias("closeness_centrality"),
        F.avg(outdeg_c).alias("outdegree_centralization"))
    dcols = ["avg_dependency_distance", "dependents_per_word", "closeness_centrality", "outdegree_centralization"]
    return out.select("text_id", *[F.round(c, PRECISION).alias(c) if c in dcols else F.col(c)
                                   for c in out.columns if c != "text_id"])


def closeness_centralization(tokens: DataFrame) -> DataFrame:
    """Per text, mean over its sentences of sum(max c - c) / (n - 1), where c of a node is the number of its descendants over the
    sum of their distances (0 for a leaf); null for sentences of one word.

    Every node's list of ancestors doubles from round to round (its own list, then that of the farthest ancestor in it),
    so a tree of depth d takes log2(d + 1) rounds. (ancestor, distance) rows of a sentence are then summed up per
    ancestor, in the partitioning that the sentences have already."""
    s = tokens.groupBy("text_id", "sent_id").agg(F.array_sort(F.collect_list(F.struct("tok_id", "head"))).alias("nodes"))
    n = F.size("nodes")
    s = s.withColumn("heads", _head_places())
    first = F.transform("heads", lambda h: F.when(h > 0, F.array(h)).otherwise(F.array().cast("array<int>")))
    rounds = F.sequence(F.lit(1), F.greatest(F.ceil(F.log2(n + 1)).cast("int"), F.lit(1)))
    above = F.aggregate(rounds, first, lambda acc, _: F.transform(
        acc, lambda a: F.when(F.size(a) == 0, a).otherwise(F.concat(a, F.get(acc, F.element_at(a, -1) - 1)))))
    s = s.select("text_id", "sent_id", n.alias("n"), F.flatten(F.transform(above, lambda a: F.transform(
        a, lambda x, i: F.struct(x.alias("node"), (i + 1).alias("dist"))))).alias("pairs"))
    c = s.select("text_id", "sent_id", "n", F.explode_outer("pairs").alias("p")).groupBy("text_id", "sent_id", "n", "p.node") \
        .agg((F.count("p") / F.nullif(F.sum("p.dist").cast("double"), F.lit(0.0))).alias("c"))
    per_sentence = c.groupBy("text_id", "sent_id", "n").agg((F.coalesce(F.max("c"), F.lit(0.0)) * F.col("n") - F.coalesce(F.sum("c"), F.lit(0.0))).alias("spread"))
    return per_sentence.groupBy("text_id").agg(F.round(F.avg(F.col("spread") / F.nullif(F.col("n") - 1, F.lit(0))), PRECISION).alias("closeness_centralization"))


def longest_shortest_path(tokens: DataFrame) -> DataFrame:
    """Longest of the shortest paths from the root of a sentence's tree, mean over the sentences of each text."""
    return sentence_trees(tokens).groupBy("text_id").agg(F.round(F.avg("depth"), PRECISION).alias("longest_shortest_path"))


def variability(texts: DataFrame, by=("dataset",)) -> DataFrame:
    """Type-token ratio of all texts of a group taken together."""
    toks = texts.select(*by, F.explode(words(F.lower("text"))).alias("w"))
    return toks.groupBy(*by).agg(F.round(F.countDistinct("w") / F.count(F.lit(1)), PRECISION).alias("variability"))


def complexity(texts: DataFrame, tokens: DataFrame, reference_words: DataFrame) -> DataFrame:
    """Combined complexity record per text: TTR, evenness, lexical density, rarity,
    average dependency distance and dependents per word."""
    lex = lexical_richness(texts).select("text_id", "ttr", "evenness")
    return (lex.join(lexical_density(tokens), "text_id", "left")
            .join(rarity(tokens, reference_words).select("text_id", "rarity"), "text_id", "left")
            .join(dependency_metrics(tokens).select("text_id", "avg_dependency_distance", "dependents_per_word"),
                  "text_id", "left"))


SCHEMA_WORD = r"[\p{L}\p{N}]+"


def schema_references(questions: DataFrame, elements: DataFrame, key: str = "datapoint_id", tokens: DataFrame | None = None) -> DataFrame:
    """Schema elements mentioned in each question: (key, referenced_schema_elements, references array<string>).

    Question and element are cut into lower-cased words of letters and digits by one rule ('_' separates
    words). Every run of words of a question whose length occurs among its database's elements meets them by an
    equi-join on (db_id, run), so a question is never compared with all elements of its database. A question
    without a schema has null references.

    ``tokens``, the annotated tokens of the questions (text_id = key), adds the runs of the question's lemmas, so that
    'singers' refers to ``singer``. An optional column ``lemma`` of ``elements`` adds an element's lemmas.
    """
    def cut(c):
        return F.regexp_extract_all(F.lower(F.regexp_replace(c, "_", " ")), F.lit(SCHEMA_WORD), 0)

    spellings = [c for c in ("element", "lemma") if c in elements.columns]
    el = elements.select("db_id", F.lower("element").alias("element"), F.explode(F.array(*[F.array_join(cut(F.col(c)), " ") for c in spellings])).alias("run")) \
                 .where("run <> ''").distinct()
    widths = el.select("db_id", F.size(F.split("run", " ")).alias("width")).distinct()
    q = questions.select(key, "db_id", cut(F.col("question")).alias("w"))
    if tokens is not None:
        lemmas = tokens.groupBy(F.col("text_id").alias(key)).agg(
            F.array_sort(F.collect_list(F.struct("sent_id", "tok_id", F.coalesce("lemma", "form", F.lit("")).alias("lemma")))).alias("t"))
        lemmas = lemmas.select(key, F.flatten(F.transform("t", lambda x: cut(x["lemma"]))).alias("w"))
        q = q.unionByName(questions.select(key, "db_id").join(lemmas.hint("merge"), key))  # as many rows as questions
    grams = q.join(widths, "db_id").where(F.col("width") <= F.size("w")).select(
        key, "db_id", F.explode(F.array_distinct(F.transform(
            F.sequence(F.lit(1), F.size("w") - F.col("width") + 1), lambda i: F.array_join(F.slice("w", i, F.col("width")), " ")))).alias("run"))
    refs = grams.join(el, ["db_id", "run"]).groupBy(key).agg(F.array_sort(F.collect_set("element")).alias("refs"))
    has_schema = elements.select("db_id").distinct().withColumn("has_schema", F.lit(True))
    out = questions.select(key, "db_id").join(refs.hint("merge"), key, "left").join(has_schema, "db_id", "left")
    return out.select(key, F.when(F.col("has_schema"), F.coalesce("refs", F.array().cast("array<string>"))).alias("references")).select(
        key, F.when(F.col("references").isNotNull(), F.size("references")).cast("long").alias("referenced_schema_elements"), "references")


def sql_schema_elements(tokens: DataFrame, key: str = "datapoint_id") -> DataFrame:
    """(key, element): distinct tables and column names (without qualifier) used by each query."""
    t = tokens.where(F.col("role").isin("table", "column")).select(
        key, F.substring_index("lt", ".", -1).alias("element"))
    return t.distinct()


def schema_reference_percentage(refs: DataFrame, sql_elements: DataFrame, parse_errors: DataFrame,
                                key: str = "datapoint_id") -> DataFrame:
    """% of the query's schema elements mentioned in the question; null when the question has
    no schema (no references) or the query has no elements or fails Q32. A query's elements meet the references in one row, so
    each input is read once; all have a row per query, none is broadcast."""
    used = sql_elements.groupBy(key).agg(F.collect_list("element").alias("used"))
    base = refs.select(key, "references").join(parse_errors.hint("merge"), key, "left").join(used.hint("merge"), key, "left")
    ok = F.col("references").isNotNull() & F.col("parse_error").isNull() & (F.size("used") > 0)
    pct = F.when(ok, 100.0 * F.size(F.filter("used", lambda e: F.array_contains("references", e))) / F.size("used"))
    return base.select(key, F.round(pct, PRECISION).alias("referenced_schema_elements_percentage"))


def over_distinct_questions(datapoints: DataFrame, score, key: str = "datapoint_id") -> DataFrame:
    """``score`` (questions (key, db_id, question) -> rows by key) of every datapoint, computed once per distinct question of a
    database; the datapoint of least key stands for all that ask it."""
    hashes = {"_q": F.xxhash64("db_id", "question"), "_r": F.xxhash64(F.lit("r"), "db_id", "question")}
    asked = datapoints.select(key, "db_id", "question").withColumns(hashes)
    one = asked.groupBy("_q", "_r").agg(F.min_by(F.struct(key, "db_id", "question"), key).alias("one"))
    scored = score(one.select("one.*")).withColumnRenamed(key, "_key")
    return asked.select(key, "_q", "_r").join(one.select("_q", "_r", F.col(f"one.{key}").alias("_key")).join(scored, "_key"), ["_q", "_r"]).drop("_q", "_r", "_key")


def sql_elements_per_query(datapoints: DataFrame, key: str = "datapoint_id", sql_col: str = "sql_query") -> DataFrame:
    """(key, elements, parse_error): distinct tables and column names (without qualifier) of every query, and why it is rejected (Q32);
    within the row of each query."""
    def row(ts):
        named = F.filter(ts, lambda t: t["role"].isin("table", "column"))
        return F.struct(F.array_distinct(F.transform(named, lambda t: F.substring_index(t["lt"], ".", -1))).alias("elements"), sqltokens.text_error(ts).alias("parse_error"))

    texts = sqltokens.spread(datapoints.select(key, sql_col))
    return texts.select(key, F.explode(F.array(let(sqltokens.token_array(sql_col), row))).alias("_r")).select(key, "_r.*")


def reference_percentage(refs: DataFrame, used: DataFrame, key: str = "datapoint_id") -> DataFrame:
    """T3 from ``schema_references`` and ``sql_elements_per_query``: as ``schema_reference_percentage``, within the row."""
    ok = F.col("references").isNotNull() & F.col("parse_error").isNull() & (F.size("elements") > 0)
    pct = F.when(ok, 100.0 * F.size(F.array_intersect("elements", "references")) / F.size("elements"))
    return refs.join(used.hint("merge"), key, "left").select(key, F.round(pct, PRECISION).alias("referenced_schema_elements_percentage"))


def dispersion(texts: DataFrame) -> DataFrame:
    """Gini-based and evenness-based dispersion per text, hapaxes excluded.

    For a type seen f >= 2 times at token positions p1 < ... < pf of a text of N tokens, the
    circular gaps are p(i+1) - p(i) and N - pf + p1 (they sum to N). Gini-based dispersion is
    the mean over types of 1 - Gini(gaps), with Gini = 2 sum(k g(k)) / (f N) - (f + 1) / f over
    the gaps sorted ascending; evenness-based dispersion is the mean over types of
    entropy(gaps / N) / log2 f. Null for a text without repeated types.

    The windows are keyed by (text_id, word) after one exchange by text_id.
    """
    t = texts.select("text_id", "dataset", "split", "text").repartition("text_id")
    toks = t.select("text_id", "dataset", "split", F.posexplode(words(F.lower("text"))).alias("pos", "word"))
    toks = toks.withColumn("N", F.count(F.lit(1)).over(Window.partitionBy("text_id")))
    w = Window.partitionBy("text_id", "word").orderBy("pos")
    wall = Window.partitionBy("text_id", "word")
    g = toks.select("text_id", "dataset", "split", "word", "N",
                    F.coalesce(F.lead("pos").over(w) - F.col("pos"),
                               F.col("N") - F.col("pos") + F.min("pos").over(wall)).alias("gap"),
                    F.count(F.lit(1)).over(wall).alias("f"))
    g = g.where(F.col("f") >= 2)
    k = F.row_number().over(Window.partitionBy("text_id", "word").orderBy("gap"))
    g = g.withColumn("k", k)
    share = F.col("gap") / F.col("N")
    per_type = g.groupBy("text_id", "dataset", "split", "word", "f", "N").agg(
        F.sum(F.col("k") * F.col("gap")).alias("kg"), F.sum(-share * F.log2(share)).alias("ent"))
    gini = 2 * F.col("kg") / (F.col("f") * F.col("N")) - (F.col("f") + 1) / F.col("f")
    per_type = per_type.select("text_id", "dataset", "split", (1 - gini).alias("gini_disp"),
                               (F.col("ent") / F.log2("f")).alias("even_disp"))
    out = per_type.groupBy("text_id", "dataset", "split").agg(
        F.round(F.avg("gini_disp"), PRECISION).alias("gini_dispersion"),
        F.round(F.avg("even_disp"), PRECISION).alias("evenness_dispersion"))
    return texts.select("text_id", "dataset", "split").join(out, ["text_id", "dataset", "split"], "left")
