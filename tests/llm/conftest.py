import random

import pytest


def corpus(n=60, seed=5):
    """Rows (id, text) with copies, near copies, shared passages, and odd texts."""
    r = random.Random(seed)
    vocabulary = ["the", "of", "and", "rain", "river", "stone", "Light", "über", "café", "maß", "night", "x", "walk", "green", "old", "tree,", "song."]
    passage = " ".join(r.choice(vocabulary) for _ in range(30))
    rows = []
    for i in range(n):
        words = [r.choice(vocabulary) + ("" if r.random() < 0.6 else str(r.randrange(999))) for _ in range(r.randrange(8, 120))]
        if i % 4 == 1:
            at = r.randrange(len(words))
            words[at:at] = passage.split()
        text = " ".join(words)
        if i % 6 == 5 and rows:
            text = rows[r.randrange(len(rows))][1] or "alone"
            if i % 12 == 5:
                cut = text.split(" ")
                cut[r.randrange(len(cut))] = "changed"
                text = " ".join(cut)
        rows.append((i * 3, text))
    rows += [(1000, None), (1001, ""), (1002, " \n\t "), (1003, "one two three"), (1004, "ONE two three"), (1005, "é" * 300 + "\n" + "é" * 300)]
    rows += [(1006, ("again and again we say the same long line of words here " * 40).strip()), (1007, "long " * 5000 + passage), (1008, "a\x0bb\x0cc\r\nd  e f")]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The corpus with columns whose names the operators use themselves."""
    data = [(i, t, "en", "s", 0, "x", "y", 1, 2, "z") for i, t in rows]
    return spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, n_chars bigint, chunk string, ids string, n_words int, length int, rep string").repartition(4)


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)
