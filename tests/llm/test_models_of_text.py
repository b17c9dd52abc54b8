"""Language-model scores, tokenizer alignment and lexical search against plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from creditloom.llm import align, attention, lexical, lm
from creditloom.llm.common import tokenizer_path

WORDS = re.compile("[^\x20\x09-\x0d]+")
TERMS = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [
    (None, "no id here the the"), (7, "twice"), (7, "twice"), (2000, "▁mark the"), (2001, " lead  two\n  x \t y  z trail "), (2002, "<|endoftext|> <s> a </s> \x00b"),
    (2003, "日本語 テキスト 한국어 😀👍🏽"), (2004, "x" * 5000 + " " + "é" * 3000), (2005, "\n\n \n"), (2006, " "), (2007, "a  b   c  d e"), (2008, "don't we'll 12345 #$%^"),
]


@pytest.fixture(scope="module")
def texts(rows):
    return rows + ODD


@pytest.fixture(scope="module")
def table(spark, texts):
    data = [(i, t, "s", "w", 1, "k") for i, t in texts]
    return spark.createDataFrame(data, "doc_id bigint, text string, slice string, word string, n int, code string").repartition(3)


def by_row(rows, *columns):
    return sorted(tuple(r[c] for c in columns) for r in rows)


# -- language model


def plain_base(texts):
    tokens = [([w.translate(LOWER) for w in WORDS.findall(t or "")]) for _, t in texts]
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0 for i, _ in texts]
    c = Counter(w for ws, h in zip(tokens, held) if not h for w in [*ws, None])
    n, v = sum(c.values()), len(c)
    out = []
    for (i, _), ws, h in zip(texts, tokens, held):
        own = [*ws, None]
        out.append((i or -1, h, len(own), sum(c[w] > 0 for w in own), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)))
    return sorted(out)


def test_base_scores_equal_a_plain_count(table, texts):
    got = lm.score_documents(table, share=4, slice_bytes=20_000).collect()
    found = sorted((r["doc_id"] or -1, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got)
    expected = plain_base(texts)
    assert [f[:5] for f in found] == [e[:5] for e in expected]
    assert np.allclose([f[5] for f in found], [e[5] for e in expected], rtol=1e-11)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)


def test_lm_of_nothing_and_of_no_training_text(spark, nothing):
    assert lm.score_documents(nothing).count() == 0
    held = next(i for i in range(100) if lm.is_held_out(i))
    rows = lm.score_documents(spark.createDataFrame([(held, "a b"), (None, None)], "doc_id bigint, text string")).collect()
    assert by_row(rows, "n_tokens", "n_known", "train_tokens", "base_score") == [(1, 0, 0, 0.0), (3, 0, 0, 0.0)]


def test_words_keep_their_ids_however_they_are_joined():
    words = [w.encode() for t in ["the don't 12ab", "é b über", "日本語 \x1c 😀", "x" * 3000] for w in WORDS.findall(t)]
    path = tokenizer_path(lm.VOCABULARY)
    ids, size = lm.encode_words(words, path)
    encoding, _ = lm._encoding(path)
    assert [p.tolist() for p in np.split(ids, np.cumsum(size)[:-1])] == [encoding.encode_ordinary(" " + w.decode()) for w in words]


def small_model(seed=3):
    r = np.random.default_rng(seed)
    cls = r.integers(0, attention.CLASSES, 300)
    counts = attention.Counts(cls, r.integers(0, 50, 300).astype(float), r.integers(0, 5, (300, attention.CLASSES)).astype(float), r.integers(0, 5, (attention.CLASSES, 300)).astype(float))
    weights = {k: r.normal(0, 0.3, s).astype(np.float32) for k, s in attention.SHAPES.items()}
    return counts, weights


def plain_log_probability(counts, w, ids, begin, first, place):
    """log P(ids[place + 1] | the window) written out for one place."""
    seen = list(range(max(begin, first - attention.CONTEXT), place + 1))
    cls = counts.cls[ids]
    q = w["query"][cls[place]].astype(float)
    s = np.array([math.exp(q @ w["key"][cls[j]] + w["near"][place - j]) for j in seen])
    z = w["own"][cls[place]] + (s / s.sum()) @ w["value"][cls[seen]]
    y = z + np.maximum(z @ w["hidden"] + w["hidden_bias"], 0) @ w["back"]
    p = counts.follow[ids[place]] * np.exp(y @ w["out"] + w["out_bias"])
    target = cls[place + 1]
    return math.log(p[target] / p.sum()) + counts.inside[cls[place], ids[place + 1]]


def test_windows_score_every_place_once_as_written_out():
    counts, weights = small_model()
    r = np.random.default_rng(1)
    lengths = np.array([1, 15, 16, 17, 70, 3])
    begin = np.cumsum(lengths + 1) - (lengths + 1)
    ids = r.integers(0, 300, int((lengths + 1).sum()))
    first, text = attention.windows(begin, lengths)
    got = attention.log_probabilities(attention.Attention(weights), counts, ids, first, begin[text], (begin + lengths)[text])
    for b, n in zip(begin, lengths):
        assert got[b + n] == 0  # the last id is only predicted
        for k in range(n):
            assert got[b + k] == pytest.approx(plain_log_probability(counts, weights, ids, b, b + k // attention.SCORED * attention.SCORED, b + k), abs=1e-4)


def test_probabilities_of_all_ids_add_up_to_one():
    counts, weights = small_model()
    ids = np.random.default_rng(2).integers(0, 300, 40)
    total = 0.0
    for following in range(300):
        line = np.append(ids, following)
        total += math.exp(attention.log_probabilities(attention.Attention(weights), counts, line, np.array([32]), np.array([0]), np.array([40]))[39])
    assert total == pytest.approx(1, abs=1e-4)


def test_gradients_agree_with_differences():
    weights = {k: v.astype(np.float64) for k, v in small_model()[1].items()}
    r = np.random.default_rng(4)
    seen, valid = r.integers(0, attention.CLASSES, (2, attention.WIDTH)), np.ones((2, attention.WIDTH), np.float32)
    pull = r.normal(0, 1, (2 * attention.SCORED, attention.CLASSES)).astype(np.float32)
    kept: dict = {}
    model = attention.Attention(weights)
    model.forward(seen, valid, kept)
    for name, g in model.gradients(seen, pull, kept).items():
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        sums = []
        for step in (1e-4, -1e-4):
            moved = {k: v.copy() for k, v in weights.items()}
            moved[name][at] += step
            sums.append(float((attention.Attention(moved).forward(seen, valid).astype(float) * pull).sum()))
        assert (sums[0] - sums[1]) / 2e-4 == pytest.approx(float(g[at]), rel=0.02, abs=0.01), name


def test_attention_learns_what_counts_cannot_hold(spark):
    """After the same word, what follows depends on the word before it: the score must pass the count model."""
    r = np.random.default_rng(0)
    data = [(i, " ".join(" ".join(("red go left", "blue go right")[r.integers(2)].split()) for _ in range(120))) for i in range(400)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string").repartition(2)
    coded = lm.code_slices(docs, share=2)
    counts = lm.fit_counts(lm.pair_counts(coded))
    weights = lm.fit_attention(lm.training_windows(coded), counts)
    rows = coded.collect()

    def score(w):
        total = 0.0
        for row in rows:
            c = lm.Coded.read(row["texts"], row["codes"], row["tokens"])
            first, text = attention.windows(c.begin, c.inputs)
            got = attention.log_probabilities(attention.Attention(w), counts, c.stream, first, c.begin[text], (c.begin + c.inputs)[text])
            total += np.add.reduceat(got, c.begin)[c.held].sum()
        return total

    assert score(weights) > 0.75 * score(attention.initial())  # one of three words need not be guessed


# -- alignment


def plain_alignment(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a_model, b_model = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    a_model.encode_special_tokens = True
    pair = align.Pair(tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    found, holders = [], Counter()
    for doc_id, text in texts:
        a, b = (a_model.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text)) if text else ([], [])
        whole = (" " + (text or "")).encode()
        if b"".join(pair.bytes_a[i] for i in a) != whole or b"".join(pair.bytes_b[i] for i in b) != whole:
            a, b = [], []
        ends = [np.cumsum([len(x[i]) for i in ids]).tolist() for x, ids in ((pair.bytes_a, a), (pair.bytes_b, b))]
        cuts, groups, at, bt = sorted(set(ends[0]) & set(ends[1])), [], 0, 0
        for cut in cuts:
            an, bn = ends[0].index(cut, at) + 1, ends[1].index(cut, bt) + 1
            groups.append((a[at:an], b[bt:bn]))
            at, bt = an, bn
        links = [(x, y) for ga, gb in groups for x in ga for y in gb]
        holders.update(set(links))
        found.append((doc_id, a, b, groups, links))
    highest = defaultdict(int)
    for (x, _), n in holders.items():
        highest[x] = max(highest[x], n)
    out = []
    for doc_id, a, b, groups, links in found:
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        sha = hashlib.sha256(said.encode()).hexdigest() if a else ""
        out.append((-1 if doc_id is None else doc_id, len(a), len(b), len(groups), len(links), sum(holders[k] == highest[k[0]] for k in links), sum(holders[k] for k in links), sha))
    return sorted(out)


def test_alignment_equals_brute_force(table, texts):
    got = align.align_documents(table, slice_bytes=20_000).collect()
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], *(r[n] for n in names)) for r in got) == plain_alignment(texts)


def test_alignment_of_nothing_and_of_texts_without_tokens(spark, nothing):
    assert align.align_documents(nothing).count() == 0
    rows = align.align_documents(spark.createDataFrame([(1, None), (2, ""), (3, "▁")], "doc_id bigint, text string")).collect()
    assert by_row(rows, "doc_id", "n_a", "n_best", "count_sum", "groups_sha256") == [(i, 0, 0, 0, "") for i in (1, 2, 3)]


def test_planes_give_back_counts_and_links():
    r = np.random.default_rng(9)
    posting = np.unique(r.integers(0, 40, 3000) << 32 | r.integers(0, 200, 3000))
    times = r.integers(1, 70, len(posting))
    pair, doc = posting >> 32, posting & 0xFFFFFFFF
    bitmaps = align.planes(pair, doc, times, 4)
    assert align.document_counts(bitmaps, 40, 4).tolist() == np.bincount(pair, minlength=40).tolist()
    count, best = r.integers(1, 1 << 40, 40), r.integers(0, 2, 40)
    n_best, total = align.return_scores(bitmaps, 4, 200, count, best)
    plain_best, plain_total = [0] * 200, [0] * 200
    for p, d, t in zip(pair.tolist(), doc.tolist(), times.tolist()):
        plain_best[d] += t * int(best[p])
        plain_total[d] += t * int(count[p])
    assert n_best.tolist() == plain_best and total.tolist() == plain_total


# -- lexical search


def plain_search(texts, items, k=50):
    docs = [(i, Counter(w.translate(LOWER) for w in TERMS.findall(t or ""))) for i, t in texts]
    docs = [(lexical.NULL_ID if i is None else i, c, sum(c.values())) for i, c in docs if c]
    n_docs, n_terms = len(docs), sum(n for _, _, n in docs)
    df = Counter(w for _, c, _ in docs for w in c)
    of = defaultdict(set)
    for item, text in items:
        of[item] |= {w.translate(LOWER) for w in TERMS.findall(text or "")}
    out = []
    for item, words in of.items():
        scored = []
        for i, c, n in docs:
            m = 100 - 50 + (50 * n * n_docs) // n_terms
            scored.append((-sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1000000000 * c[w]) // (1000 * c[w] + 20 * m)) for w in words if c[w]), i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k], 1) if s < 0]
    return sorted(out, key=lambda x: (x[0] is None, x[:2] if x[0] is not None else x[1]))


ITEMS = [(1, "the of and"), (2, "river STONE 12"), (3, None), (4, "unknownword"), (5, "light über café walk green old tree"), (6, "the"), (2, "song rain"), (8, ""), (9, "a b c 日本語 again")]


@pytest.mark.parametrize("k, block, opened", [(50, 2048, 256), (3, 2, 2)])
def test_search_equals_brute_force(spark, table, texts, monkeypatch, k, block, opened):
    monkeypatch.setattr(lexical, "OPENED", opened)
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id bigint, text string, term string")
    got = lexical.Index(table, slice_bytes=20_000).search(items, k=k, block=block).collect()
    found = sorted((r["item_id"], r["rank"], lexical.NULL_ID if r["doc_id"] is None else r["doc_id"], r["score"]) for r in got)
    assert found == plain_search(texts, ITEMS, k)


def test_search_of_nothing(spark, table, nothing):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert lexical.Index(nothing).search(items).count() == 0
    assert lexical.Index(table).search(items.limit(0)).count() == 0


def test_treap_holds_every_cell_and_its_maxima():
    r = np.random.default_rng(5)
    cell = np.unique(r.integers(0, 90 * 40, 500))
    row, column, impact = cell // 40, cell % 40, r.integers(1, 1000, len(cell))
    treap = lexical.Treap(*lexical.treap_levels(row, column, impact, 90, 40))
    weight = np.array([1, 1000, 7])
    rows = np.array([3, 50, 89])
    found, scores = treap.search(rows, weight, 40, 1, np.arange(40))
    expected = np.zeros(40, np.int64)
    for w, x in zip(weight, rows):
        expected[column[row == x]] += w * impact[row == x]
    assert dict(zip(found.tolist(), scores.tolist())) == {i: int(s) for i, s in enumerate(expected) if s > 0}
