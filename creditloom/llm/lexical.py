"""Ranked lexical search with a K2-treap over the grid of terms and documents.

* Every text is read once into a *slice* (some MB of texts): its term list with
  document counts, and (term, document, occurrences) postings. Collection
  counts follow by one aggregate and one join on the terms.
* Each slice's index is a K2-treap: a quadtree over the grid (term, document)
  that stores only cells holding a posting, as one child bitmap and the
  largest impact of the cell. Children lie in order, so places of children
  follow from counting bits, and no pointer is stored.
* A query takes the row paths of its terms down together, over the same range
  of documents: the sum of weight * largest impact bounds every document of
  the range. The ranges with the largest bounds are opened first; ranges below
  the k-th best score are never opened. At the last level a cell is one
  posting and the sum is the exact score.
* A task keeps each query's best k over all of its slices. A first pass over a
  few slices gives a lower bound of every k-th best score, so the pass over all
  slices opens and returns little; the result does not depend on it.

Rows: null texts have no terms and are never ranked; a null document id ranks
last among equal scores; repeated rows and equal ids are ranked each; rows of
equal item id (null included) are one item with the terms of all, once each; an item without known
terms has no rows; empty tables give none; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from creditloom.llm.blocks import pack, unpack
from creditloom.llm.common import NULL_ID, doc_columns, slices
from creditloom.session import cut_lineage

SLICE_BYTES = 4 << 20
#: Queries searched in one pass; their terms are all that is broadcast.
QUERY_BLOCK = 2048
#: Ranges opened at once.
OPENED = 256
#: One of so many slices gives the first lower bounds.
FIRST_SLICES = 16
TOP = 50

#: All ASCII but letters and digits becomes a blank, A-Z lower case.
_TERM_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())
_BITS = np.array([bin(i).count("1") for i in range(16)], np.int8)


def terms_of(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode().translate(_TERM_BYTES).split()


# -- the K2-treap


def _spread(x: np.ndarray) -> np.ndarray:
    """Bits of x at the even places."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | x << np.uint64(shift)) & np.uint64(mask)
    return x


def treap_levels(row: np.ndarray, column: np.ndarray, impact: np.ndarray, rows: int, columns: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of each level from the root to the cells, child bitmaps of all nodes
    above the cells, and the largest impact of all nodes."""
    levels = max(1, int(max(rows, columns) - 1).bit_length())
    code = _spread(row) << np.uint64(1) | _spread(column)
    order = np.argsort(code, kind="stable")
    code, top = code[order], impact[order].astype(np.uint32)
    maxima, bitmaps = [top], []
    for _ in range(levels):
        above = code >> np.uint64(2)
        start = np.flatnonzero(np.concatenate([[True], above[1:] != above[:-1]])) if len(code) else np.zeros(0, np.int64)
        child = np.left_shift(1, (code & np.uint64(3)).astype(np.uint8)).astype(np.uint8)
        bitmaps.append(np.bitwise_or.reduceat(child, start) if len(start) else child)
        top = np.maximum.reduceat(top, start) if len(start) else top
        maxima.append(top)
        code = above[start]
    return np.array([len(m) for m in reversed(maxima)], np.int64), np.concatenate(bitmaps[::-1]), np.concatenate(maxima[::-1])


class Treap:
    """A stored treap; node numbers run through all levels, and one more stands for an empty cell."""

    def __init__(self, sizes: np.ndarray, bitmaps: np.ndarray, maxima: np.ndarray):
        self.levels, self.empty = len(sizes) - 1, len(maxima)
        self.bitmap = np.zeros(len(maxima) + 1, np.uint8)
        self.bitmap[: len(bitmaps)] = bitmaps
        children = _BITS[self.bitmap]
        self.first = (np.cumsum(children, dtype=np.int64) - children + (sizes[0] if len(maxima) else 0)).astype(np.int32 if self.empty < 1 << 31 else np.int64)
        self.top = np.append(maxima, np.uint32(0))

    def children(self, nodes: np.ndarray, row_bit: np.ndarray, column_bit: int) -> np.ndarray:
        child = 2 * row_bit + column_bit
        bitmap = self.bitmap[nodes]
        has = bitmap >> child.astype(np.uint8) & 1
        below = bitmap & ((1 << child) - 1).astype(np.uint8)
        return np.where(has > 0, self.first[nodes] + _BITS[below], self.empty)

    def search(self, rows: np.ndarray, weight: np.ndarray, k: int, least: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Columns and scores that may be among the best k: all of score ``least`` or
        more that are not below k others of this treap. ``ids`` orders equal scores."""
        none = np.zeros(0, np.int64)
        if not len(rows) or self.empty == 0:
            return none, none
        nodes = np.zeros((1, len(rows)), np.int64)
        level, place = np.array([self.levels]), np.zeros(1, np.int64)
        bound = (self.top[nodes] * weight).sum(1)
        found, scores = none, none
        while len(bound):
            if len(bound) > OPENED:
                now = np.argpartition(-bound, OPENED)
                now, later = now[:OPENED], now[OPENED:]
            else:
                now, later = np.arange(len(bound)), none
            bit = rows[None, :] >> (level[now, None] - 1) & 1
            opened = [self.children(nodes[now], bit, side) for side in (0, 1)]
            fresh = np.concatenate(opened)
            fresh_bound = (self.top[fresh] * weight).sum(1)
            fresh_level = np.tile(level[now] - 1, 2)
            fresh_place = np.concatenate([2 * place[now], 2 * place[now] + 1])
            good = fresh_bound >= least
            done = good & (fresh_level == 0)
            if done.any():
                found, scores = np.append(found, fresh_place[done]), np.append(scores, fresh_bound[done])
                if len(scores) > k:
                    best = np.lexsort((ids[found], -scores))[:k]
                    found, scores = found[best], scores[best]
                if len(scores) == k:
                    least = max(least, int(scores.min()))
            more = good & (fresh_level > 0) & (fresh_bound >= least)
            kept = later[bound[later] >= least] if len(later) else later
            nodes, level = np.concatenate([nodes[kept], fresh[more]]), np.concatenate([level[kept], fresh_level[more]])
            place, bound = np.concatenate([place[kept], fresh_place[more]]), np.concatenate([bound[kept], fresh_bound[more]])
        return found, scores


# -- the index


def read_postings(docs: DataFrame, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """One row a slice: ids and lengths of the texts with a term, terms with document counts, postings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, nth = TaskContext.get().partitionId(), 0
        for part in slices(batches, limit=slice_bytes):
            book: dict[bytes, int] = {}
            number = book.setdefault
            ids, length, keys = [], [], []
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                own = np.array([number(w, len(book)) for w in terms_of(text)], np.uint64)
                if len(own):
                    keys.append(own << np.uint64(32) | np.uint64(len(ids)))
                    ids.append(NULL_ID if doc_id is None else doc_id)
                    length.append(len(own))
            if not ids:
                continue
            key, tf = np.unique(np.concatenate(keys), return_counts=True)
            term = key >> np.uint64(32)
            df = np.bincount(term.astype(np.int64), minlength=len(book))
            yield pa.RecordBatch.from_pydict({
                "slice": pa.array([partition << 32 | nth], pa.int64()), "n_docs": pa.array([len(ids)], pa.int64()), "n_terms": pa.array([sum(length)], pa.int64()),
                "texts": pa.array([pack(np.array(ids, np.int64), np.array(length, np.int64))], pa.binary()),
                "postings": pa.array([pack(term.astype(np.uint32), (key & np.uint64(0xFFFFFFFF)).astype(np.uint32), tf.astype(np.uint32))], pa.binary()),
                "terms": pa.array([[t.decode() for t in book]], pa.list_(pa.string())), "df": pa.array([df], pa.list_(pa.int64())),
            })
            nth += 1

    return doc_columns(docs).mapInArrow(run, "slice bigint, n_docs bigint, n_terms bigint, texts binary, postings binary, terms array<string>, df array<bigint>")


def impacts(tf: np.ndarray, doc: np.ndarray, length: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """(10^9 tf) div (1000 tf + 20 m), with m from the document's length against the mean (in Python's integers, once a length)."""
    distinct, which = np.unique(length, return_inverse=True)
    m = np.array([100 - 50 + (50 * int(n) * n_docs) // n_terms for n in distinct], np.int64)[which[doc]]
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


class Index:
    """Stored slices with their treaps, and the collection counts."""

    def __init__(self, docs: DataFrame, slice_bytes: int = SLICE_BYTES):
        self.read = cut_lineage(read_postings(docs, slice_bytes))
        totals = self.read.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("l")).first()
        self.n_docs, self.n_terms = int(totals["n"]), int(totals["l"])
        n_docs, n_terms = self.n_docs, self.n_terms

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    ids, length = unpack(batch.column("texts")[i].as_py())
                    term, doc, tf = unpack(batch.column("postings")[i].as_py())
                    impact = impacts(tf, doc, length, n_docs, n_terms)
                    terms = batch.column("terms")[i].values
                    sizes, bitmaps, maxima = treap_levels(term, doc, impact, len(terms), len(ids))
                    yield pa.RecordBatch.from_pydict({
                        "slice": pa.array([batch.column("slice")[i].as_py()], pa.int64()), "ids": pa.array([pack(ids)], pa.binary()),
                        "terms": pa.array(["\n".join(terms.to_pylist()).encode()], pa.binary()), "treap": pa.array([pack(sizes, bitmaps, maxima)], pa.binary()),
                    })

        self.treaps = cut_lineage(self.read.select("slice", "texts", "postings", "terms").mapInArrow(run, "slice bigint, ids binary, terms binary, treap binary"))

    def weights(self, words: DataFrame) -> DataFrame:
        """(item_id, term, w) of the items' terms that the collection holds."""
        rows = self.read.select(F.explode(F.arrays_zip("terms", "df")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.df").alias("df"))
        wanted = words.select("term").distinct()
        df = rows.join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
        w = F.floor(1000 * F.log((2 * F.lit(self.n_docs) + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("bigint")
        return words.join(df.select("term", w.alias("w")), "term")

    def search(self, items: DataFrame, k: int = TOP, item_col: str = "item_id", text_col: str = "text", block: int = QUERY_BLOCK) -> DataFrame:
        """(item_id, rank, doc_id, score): each item's best k documents of a score above 0."""
        named = items.select(F.col(item_col).cast("bigint").alias("item_id"), F.col(text_col).cast("string").alias("text"))

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    words = sorted({w.decode() for w in terms_of(text)})
                    yield pa.RecordBatch.from_pydict({"item_id": pa.array([item] * len(words), pa.int64()), "term": pa.array(words, pa.string())})

        words = named.mapInArrow(split, "item_id bigint, term string").distinct()
        weighted = self.weights(words).groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("term", "w"))).alias("terms"))
        weighted = cut_lineage(weighted)
        blocks = max(1, -(-weighted.count() // block))
        parts = [self._block(weighted.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b), k) for b in range(blocks)]
        found = parts[0]
        for part in parts[1:]:
            found = found.unionAll(part)
        order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        return found.select("item_id", F.row_number().over(order).alias("rank"), "doc_id", "score").where(F.col("rank") <= k)

    def _block(self, weighted: DataFrame, k: int) -> DataFrame:
        """Candidates of one block of items: at most k of each task for an item."""
        context = weighted.sparkSession.sparkContext
        items = [(r["item_id"], [t["term"] for t in r["terms"]], np.array([t["w"] for t in r["terms"]], np.int64)) for r in weighted.collect()]
        number = {item: i for i, (item, _, _) in enumerate(items)}
        shared = context.broadcast(items)

        def searched(least) -> DataFrame:
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                own = shared.value
                wanted = {t for _, terms, _ in own for t in terms}
                floor = np.maximum(least.value, 1) if least is not None else np.ones(len(own), np.int64)
                best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in own]
                for batch in batches:
                    for i in range(batch.num_rows):
                        (ids,) = unpack(batch.column("ids")[i].as_py())
                        row = {t: j for j, t in enumerate(batch.column("terms")[i].as_py().decode().split("\n")) if t in wanted}
                        treap = Treap(*unpack(batch.column("treap")[i].as_py()))
                        for q, (_, terms, weight) in enumerate(own):
                            held = [j for j, t in enumerate(terms) if t in row]
                            rows = np.array([row[terms[j]] for j in held], np.int64)
                            columns, scores = treap.search(rows, weight[held], k, int(floor[q]), ids)
                            if len(columns):
                                doc, score = np.append(best[q][0], ids[columns]), np.append(best[q][1], scores)
                                keep = np.lexsort((doc, -score))[:k]
                                best[q] = doc[keep], score[keep]
                                if len(keep) == k:
                                    floor[q] = max(floor[q], score[keep[-1]])
                for (item, _, _), (doc, score) in zip(own, best, strict=True):
                    if len(doc):
                        yield pa.RecordBatch.from_pydict({"item_id": pa.array([item] * len(doc), pa.int64()), "doc_id": pa.array(doc, mask=doc == NULL_ID), "score": pa.array(score)})

            chosen = self.treaps if least is not None else self.treaps.where(F.pmod(F.xxhash64("slice"), F.lit(FIRST_SLICES)) == 0)
            return chosen.mapInArrow(run, "item_id bigint, doc_id bigint, score bigint")

        order = Window.partitionBy("item_id").orderBy(F.desc("score"))
        last = searched(None).select("item_id", "score", F.row_number().over(order).alias("rank")).where(F.col("rank") == k).collect()
        floor = np.zeros(len(items), np.int64)
        for r in last:
            floor[number[r["item_id"]]] = r["score"]
        return searched(context.broadcast(floor))


def oracle_sql(k: int = TOP) -> str:
    """The same ranking in DuckDB."""
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    terms = lower.format(r"unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))")
    return f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
        posting AS (SELECT r, term, count(*) AS tf FROM (SELECT r, {terms} AS term FROM d) GROUP BY r, term),
        len AS (SELECT r, sum(tf)::BIGINT AS n FROM posting GROUP BY r),
        whole AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM len),
        item AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, {terms} AS term FROM benchmark)),
        weight AS (
            SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
            FROM posting, whole WHERE term IN (SELECT term FROM item) GROUP BY term, n_docs
        ),
        scored AS (
            SELECT item_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * n_docs) // n_terms))))) AS BIGINT) AS score
            FROM item JOIN weight USING (term) JOIN posting USING (term) JOIN len USING (r), whole GROUP BY item_id, r
        ),
        ranked AS (
            SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
            FROM scored JOIN d USING (r) WHERE score > 0
        )
        SELECT * FROM ranked WHERE rank <= {k}
    """
