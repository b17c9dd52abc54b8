"""Cases of the third review of the training-text operators."""

import math
import random
from collections import Counter

import numpy as np

from creditloom.llm import attention, lm, quality


def plain_word_distances(rows):
    """Jensen-Shannon distance of each text's common words to those of all texts (one language), from a plain count."""
    words = {i: [w.lower() for w in t.split()] for i, t in rows}
    total = Counter(w for ws in words.values() for w in ws)
    n = sum(total.values())
    common = sorted(w for w, c in total.items() if c >= quality.WORD_SHARE * n)
    reference = [total[w] / n for w in common]
    reference.append(1 - sum(reference))
    out = {}
    for i, ws in words.items():
        c = Counter(ws)
        own = [c[w] / len(ws) for w in common]
        own.append(1 - sum(own))
        both = [(p, q, (p + q) / 2) for p, q in zip(own, reference)]
        out[i] = math.sqrt(max(0.0, sum((p * math.log2(p / m) if p > 0 else 0) + (q * math.log2(q / m) if q > 0 else 0) for p, q, m in both) / 2))
    return out


def test_common_words_of_any_length_are_in_the_reference(spark):
    r = random.Random(6)
    common = ["zusammenhang", "gesellschaft", "Wissenschaft", "entwicklungen"]
    other = lambda: "".join(r.choice("aeioutnsrl") for _ in range(10))
    rows = [(i, " ".join(r.choice(common) if r.random() < 0.6 else other() for _ in range(100))) for i in range(80)]
    rows.append((80, " ".join(other() for _ in range(100))))
    found = {x["doc_id"]: x for x in quality.judge_quality(spark.createDataFrame([(i, t, "de") for i, t in rows], "doc_id bigint, text string, lang string")).collect()}
    plain = plain_word_distances(rows)
    assert all(math.isclose(found[i]["word_distance"], plain[i], abs_tol=1e-9) for i, _ in rows)
    assert all(found[i]["kept"] for i in range(80)) and not found[80]["kept"]  # none of the language's common words, all long


def test_every_window_of_the_training_texts_trains_once(spark):
    r = random.Random(8)
    docs = spark.createDataFrame([(i, " ".join(r.choice(["red", "green", "blue", "river"]) for _ in range(r.randrange(1, 90)))) for i in range(200)], "doc_id bigint, text string")
    found, expected = [], []
    for x in lm.training_windows(lm.code_slices(docs)).collect():
        c = lm.Coded.read(x["texts"], x["codes"], x["tokens"])
        for nth in range(len(lm.RATES)):
            found += c.training_windows(x["slice"], x["share"], nth, len(lm.RATES)).tolist()
        for begin, inputs in zip(c.begin[~c.held].tolist(), c.inputs[~c.held].tolist()):
            text = c.stream[begin : begin + inputs + 1].tolist()
            places = [np.arange(at - attention.CONTEXT, at + attention.SCORED + 1).tolist() for at in range(0, inputs, attention.SCORED)]
            expected += [[text[p] if 0 <= p < len(text) else -1 for p in row] for row in places]
    assert len(expected) > 200 and sorted(found) == sorted(expected)
