"""Small tables with every defined odd case: nulls, empty and long texts, copies, repeated rows, clashing columns."""

import random

import pytest


def _words(rng, n, stock=400):
    return " ".join("".join(rng.choices("abcdeéß", k=rng.randint(1, 6))) + rng.choice(["", "", ",", "."]) if rng.random() < 0.5
                    else f"w{rng.randint(0, stock)}" for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text) rows."""
    rng = random.Random(5)
    base = [_words(rng, rng.choice([3, 30, 80, 200])) for _ in range(60)]
    passage = _words(rng, 60)
    rows = list(enumerate(base, 1))
    rows += [(100 + i, base[5]) for i in range(12)]  # exact copies
    for i in range(25):  # near copies of one text, and of one another
        words = base[7].split() * 3
        for _ in range(rng.randint(1, 25)):
            words[rng.randrange(len(words))] = f"new{rng.randint(0, 9999)}"
        rows.append((200 + i, " ".join(words)))
    rows += [(300 + i, _words(rng, 15) + " " + passage + "\n" + _words(rng, 15)) for i in range(8)]
    rows += [(400, None), (401, ""), (402, " \n\t "), (403, "one"), (404, "One"), (405, "two words"), (406, "the " * 500),
             (407, "x y " * 300), (408, "x" * 100_000), (409, _words(rng, 20_000)), (410, "▁a  b▁ <|endoftext|> <s>\x00é🙂"),
             (411, base[9].upper()), (412, "A!! B!! " * 60), (413, passage)]
    rows += [(3, base[2]), (3, base[2]), (4, "same id other text " * 9), (None, base[1]), (None, None)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The rows with columns whose names clash with those that operators use inside."""
    return spark.createDataFrame([(i, t, "en", None, 1, "r", "k", 7) for i, t in texts],
                                 "doc_id long, text string, lang string, source string, n_chars long, row string, kept string, whole int").repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.where("1 = 0")
