"""Toxicity by weak supervision.

Many *voters* - words and word beginnings of a mined lexicon, a fixed lexicon,
and writing patterns - vote on a document or abstain; a given label is one more
noisy voter. A generative label model estimates by expectation maximisation
how often each voter fires in either class (its accuracy), and the correlation
of voters within a class, by which votes that repeat each other count once. A logistic
classifier is then trained on the model's posterior labels and scores whole
texts.

Labels serve to mine the voters and to orient the classes, from rows the
caller allows only. The fit reads at most ``sample`` labelled documents, those
of the smallest hash of their id; scoring reads every document.

Rows: null and empty texts get the score of a text without votes; labels that
are null or not 0/1, or whose document is missing, are not used; a repeated
row is scored each time; equal ids are scored each by its own text; without
usable labels of both classes the fixed voters are used alone, with equal weights. Other columns
are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.llm.common import doc_columns, kept_schema, named_back, slices, texts_of
from creditloom.session import cut_lineage

#: Labelled documents read by the fit at most.
SAMPLE = 20_000
#: Mined voters at most, and the beginnings tried.
VOTERS, PREFIXES = 96, (4, 5, 6)
#: A mined term is far from chance (G-test, about 6e-7) and mostly in toxic documents.
MIN_G, MIN_PRECISION = 25.0, 0.8
THRESHOLD = 0.7

#: A small lexicon, a voter each.
LEXICON = ("asshole", "bastard", "bitch", "clown", "disgusting", "dumb", "fool", "freak", "garbage", "hate", "idiot", "kill yourself", "loser", "moron", "pathetic", "retard", "scum", "shut up", "stupid", "trash", "ugly", "vermin", "worthless")
#: Writing patterns, a voter each.
SHAPES = {"calls": r"\byou(?:'re| are)? (?:all )?(?:an? )?\w+ (?:idiots?|morons?|scum|trash)\b", "shout": r"\b(?:IDIOT|MORON|SCUM|TRASH|LOSER)S?\b", "curse": r"\b[a-z]*[@$*#]{2,}[a-z]+\b"}

_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class ToxicModel:
    words: list[str]
    prefixes: list[str]
    weights: np.ndarray
    bias: float
    voters: list[str] = field(default_factory=list)
    fires: np.ndarray | None = None
    correlation: np.ndarray | None = None
    share: float = 0.0


class Voters:
    """Counts each voter's hits in a text."""

    def __init__(self, words: list[str], prefixes: list[str]):
        import ahocorasick

        self.names = [*(f"word:{w}" for w in words), *(f"start:{p}" for p in prefixes), *(f"shape:{s}" for s in SHAPES)]
        self._find = ahocorasick.Automaton()
        by: dict[str, list[tuple[int, bool]]] = {}
        for i, w in enumerate(words):
            by.setdefault(w, []).append((i, True))
        for i, p in enumerate(prefixes):
            by.setdefault(p, []).append((len(words) + i, False))
        for w, own in by.items():
            self._find.add_word(w, (len(w), own))
        if by:
            self._find.make_automaton()
        self._some = bool(by)
        self._shapes = [re.compile(p) for p in SHAPES.values()]

    def count(self, text: str) -> dict[int, int]:
        low, hits = text.lower(), Counter()
        if self._some:
            for end, (size, own) in self._find.iter(low):
                start = end - size + 1
                if start and low[start - 1].isalnum():
                    continue
                whole = end + 1 == len(low) or not low[end + 1].isalnum()
                for i, needs_end in own:
                    if whole or not needs_end:
                        hits[i] += 1
        base = len(self.names) - len(self._shapes)
        for k, p in enumerate(self._shapes):
            if n := sum(1 for _ in p.finditer(text)):
                hits[base + k] = n
        return hits


def mined(docs: DataFrame) -> DataFrame:
    """(term, kind, toxic_docs, clean_docs) of the words and beginnings in (text, toxic); summed per task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()

        def flush():
            terms = list(toxic.keys() | clean.keys())
            if not terms:
                return None
            out = pa.RecordBatch.from_pydict({"kind": pa.array([k for k, _ in terms]), "term": pa.array([t for _, t in terms]), "toxic_docs": pa.array([toxic[t] for t in terms], pa.int64()), "clean_docs": pa.array([clean[t] for t in terms], pa.int64())})
            toxic.clear()
            clean.clear()
            return out

        for batch in slices(batches):
            for text, label in zip(texts_of(batch.column("text")), batch.column("toxic").to_pylist(), strict=True):
                words = set(_WORD.findall(text.lower()))
                terms = {("word", w) for w in words if len(w) >= 3} | {("start", w[:n]) for w in words for n in PREFIXES if len(w) >= n}
                (toxic if label else clean).update(terms)
            if len(toxic) + len(clean) > 300_000 and (out := flush()) is not None:
                yield out
        if (out := flush()) is not None:
            yield out

    summed = docs.select("text", "toxic").mapInArrow(run, "kind string, term string, toxic_docs bigint, clean_docs bigint")
    return summed.groupBy("kind", "term").agg(F.sum("toxic_docs").alias("toxic_docs"), F.sum("clean_docs").alias("clean_docs"))


def label_model(votes: np.ndarray, given: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Posterior of class 1, P(voter fires | class), correlations within the classes, and the share of class 1.

    Expectation maximisation over documents x voters (1: fires, 0: abstains),
    from the given labels (0 or 1) as the first guess; they stay a voter, the
    last column, that is as noisy as the others find it.
    A voter's log-likelihood ratio is divided by one plus its absolute
    correlations with the others, so a group of voters that fire together
    weighs as one.
    """
    votes = np.concatenate([votes, given[:, None]], axis=1)
    m = votes.shape[1]
    post = 0.05 + 0.9 * given
    weight, corr = np.ones(m), np.eye(m)
    fires = np.zeros((2, m))
    for step in range(rounds):
        for c, p in ((0, 1 - post), (1, post)):
            fires[c] = (p @ votes + 0.02) / (p.sum() + 1.0)
        fires = np.clip(fires, 1e-5, 1 - 1e-5)
        share = float(np.clip(post.mean(), 1e-3, 1 - 1e-3))
        if step % 10 == 0:
            corr = _within(votes, post, fires)
            weight = np.ones(m)
            weight[:-1] = (1 / (1 + np.maximum(np.abs(corr) - 0.2, 0).sum(1) - np.maximum(np.abs(np.diag(corr)) - 0.2, 0)))[:-1]
        on = np.log(fires[1]) - np.log(fires[0])
        off = np.log1p(-fires[1]) - np.log1p(-fires[0])
        z = votes @ ((on - off) * weight) + (off * weight).sum() + np.log(share / (1 - share))
        new = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        if np.abs(new - post).max() < 1e-6:
            post = new
            break
        post = new
    return post, fires, corr, share


def _within(votes: np.ndarray, post: np.ndarray, fires: np.ndarray) -> np.ndarray:
    """Correlation of voters within the classes: of what the class does not explain."""
    total = np.zeros((votes.shape[1],) * 2)
    for c, p in ((0, 1 - post), (1, post)):
        rest = votes - fires[c]
        total += (rest * p[:, None]).T @ rest
    scale = np.sqrt(np.maximum(np.diag(total), 1e-9))
    return total / scale / scale[:, None]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Weights of a ridge logistic regression on soft labels, by Newton steps."""
    a = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(a.shape[1])
    keep = np.r_[np.full(x.shape[1], ridge), 1e-3]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + keep * w
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag(keep)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def _features(votes: np.ndarray) -> np.ndarray:
    """What the classifier sees: each voter, and how many fire."""
    return np.concatenate([votes, np.log1p(votes.sum(1, keepdims=True))], axis=1)


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> ToxicModel:
    """Fits on at most ``sample`` labelled documents among the ``allowed`` rows of ``labels``."""
    labelled = labels.where(allowed & F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).cast("bigint").alias("doc_id")).agg(F.max(label_col).alias("toxic"))
    drawn = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    joined = doc_columns(docs, id_col, text_col).join(F.broadcast(drawn), "doc_id")
    # one text an id, the least, so that a repeated id counts once; combined before the shuffle
    own = cut_lineage(joined.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select(F.xxhash64("doc_id").alias("h"), "doc_id", "text", "toxic"))
    sizes = {r["toxic"]: r["n"] for r in own.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    words, prefixes = list(LEXICON), []
    if sizes.get(0) and sizes.get(1):
        toxic, clean = F.col("toxic_docs"), F.col("clean_docs") * (sizes[1] / sizes[0])
        exact = (toxic + 0.5) / (toxic + clean + 1.0)
        seen, rate = toxic + F.col("clean_docs"), sizes[1] / (sizes[0] + sizes[1])
        part = lambda got, due: F.when(got > 0, got * F.log(got / due)).otherwise(F.lit(0.0))
        g = 2 * (part(toxic, seen * rate) + part(F.col("clean_docs"), seen * (1 - rate)))
        terms = mined(own.dropDuplicates(["text"])).where((g >= MIN_G) & (exact >= MIN_PRECISION)).withColumn("precision", exact)
        # the most frequent first; of a beginning and a longer one with the same documents the shorter
        best = terms.orderBy((toxic * F.col("precision") * F.col("precision")).desc(), F.length("term"), "term", "kind").limit(8 * VOTERS).collect()
        words, prefixes = _choose([(r["kind"], r["term"], r["toxic_docs"]) for r in best])
    voters = Voters(words, prefixes)
    votes = np.zeros((sum(sizes.values()), len(voters.names)))
    given = np.zeros(len(votes))
    for at, r in enumerate(_hits(own, words, prefixes).collect()):
        votes[at, r["hits"]] = 1
        given[at] = r["toxic"]
    if not (sizes.get(0) and sizes.get(1)) or not votes.any():
        return ToxicModel(words, prefixes, np.r_[np.full(len(voters.names), 3.0), 0.0], -3.0, voters.names)
    post, fires, corr, share = label_model(votes, given)
    weights, bias = logistic(_features(votes), post)
    return ToxicModel(words, prefixes, weights, bias, voters.names, fires, corr, share)


def _choose(terms: list[tuple[str, str, int]]) -> tuple[list[str], list[str]]:
    """Voters from mined terms, best first: a term that a chosen beginning covers adds no vote of its own."""
    words, starts = list(LEXICON), []
    for kind, term, _ in terms:
        if len(words) - len(LEXICON) + len(starts) >= VOTERS:
            break
        if any(term.startswith(s) for s in starts) or term in words:
            continue
        (words if kind == "word" else starts).append(term)
    return words, starts


def _hits(docs: DataFrame, words: list[str], prefixes: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = Voters(words, prefixes)
        for batch in slices(batches):
            yield pa.RecordBatch.from_pydict({"toxic": batch.column("toxic"), "hits": pa.array([sorted(voters.count(t)) for t in texts_of(batch.column("text"))], pa.list_(pa.int32()))})

    return docs.select(F.col("toxic").cast("int"), "text").mapInArrow(run, "toxic int, hits array<int>")


def score_documents(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, score, votes) and the ``keep`` columns: the score of every whole text and the names of the voters that fire.

    A map over the scan; the broadcast model has a bounded number of voters.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        voters = Voters(m.words, m.prefixes)
        for batch in slices(batches):
            hits = [sorted(voters.count(t)) for t in texts_of(batch.column("text"))]
            votes = np.zeros((len(hits), len(voters.names)))
            for i, own in enumerate(hits):
                votes[i, own] = 1
            score = 1 / (1 + np.exp(-np.clip(_features(votes) @ m.weights + m.bias, -40, 40)))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(score), "votes": pa.array([[voters.names[i] for i in own] for own in hits], pa.list_(pa.string()))} | {k: batch.column(k) for k in batch.schema.names if k.startswith("keep_")})

    scored = doc_columns(docs, id_col, text_col, keep).mapInArrow(run, "doc_id bigint, score double, votes array<string>" + kept_schema(docs, keep))
    return named_back(scored, keep)


def held_out(id_col: str = "doc_id") -> Column:
    """The fold that is kept from learning: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
