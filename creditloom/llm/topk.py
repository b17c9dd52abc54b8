"""Exact top-k by inner product over an index of pivot distances.

Vectors are lifted by one coordinate to a common length, so that the largest
inner product is the smallest distance. Every row is keyed by its nearest
pivot and its distance to it and stored sorted by that key, so a run of rows
is an annulus around a pivot. For a query at distance D from a pivot, no row
of an annulus [a, b] is nearer than max(a - D, D - b). A task visits its
annuli from the nearest bound outwards and leaves a query out of an annulus
as soon as the bound is worse than its k-th best; the first k-th best comes
from the pivot sample, so a far annulus costs one comparison.

The pivots come from a bounded sample (``sample`` rows with the smallest hash
of id and vector); every row is indexed. Queries go in blocks of bounded size,
each block against all rows.

Rows: vectors that are null or empty, or hold null or non-finite components,
and rows without an id take no part. Shorter vectors are read as padded with
zeros. A repeated row is a candidate each time; of query rows with the same id
one is asked (the smallest vector). Equal scores go to the smaller id. Empty
tables give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom.session import cut_lineage

PIVOTS = 32
SAMPLE = 2048
QUERY_BLOCK = 8192
ANNULUS = 512


def integer_vectors(table: DataFrame, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v): each component x as floor(scale * x), of vectors without null or non-finite components.

    Components of 2^53 / scale or more in size are an error (they are no
    integers a double can tell apart), and so are scores beyond 64 bits.
    """
    x = F.transform(F.col(vec_col), lambda e: F.floor(F.lit(float(scale)) * e.cast("double")))
    whole = F.forall(F.col(vec_col), lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < F.lit(float("inf"))))
    x = F.transform(x, lambda e: F.when(F.abs(e) < 2**53, e).otherwise(F.raise_error(F.lit("component too large for an exact score")).cast("bigint")))
    kept = table.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & (F.size(F.col(vec_col)) > 0) & whole)
    return kept.select(F.col(id_col).cast("bigint").alias("vec_id"), x.cast("array<bigint>").alias("v"))


def _padded(rows, dim: int) -> np.ndarray:
    out = np.zeros((len(rows), dim), np.float64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy().astype(np.float64)
    if len(sizes) and (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(sizes), dim))
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _lifted(m: np.ndarray, top: float) -> np.ndarray:
    return np.concatenate([m, np.sqrt(np.maximum(top - (m * m).sum(1), 0))[:, None]], axis=1)


def pick_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Rows of the sample far from each other: each next pivot is the farthest from those picked."""
    picked = [0]
    near = ((sample - sample[0]) ** 2).sum(1)
    while len(picked) < min(n, len(sample)) and near.max() > 0:
        picked.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[picked[-1]]) ** 2).sum(1))
    return sample[picked]


def build_index(vectors: DataFrame, pivots: int = PIVOTS, sample: int = SAMPLE) -> tuple[DataFrame, dict]:
    """The stored index (pivot, ring, vec_id, v) in key order, and its pivots and sample.

    ``dim`` and ``top`` (largest squared length) are aggregates over all rows.
    The order holds the id as well, so equal vectors spread over partitions.
    """
    spark = vectors.sparkSession
    square = F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double"))
    shape = vectors.agg(F.max(F.size("v")).alias("dim"), F.max(square).alias("top")).first()
    if shape["dim"] is None:
        return vectors.select(F.lit(0).alias("pivot"), F.lit(0.0).alias("ring"), "vec_id", "v").limit(0), {}
    dim, top = shape["dim"], float(shape["top"])
    drawn = vectors.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(sample).collect()
    rows = _padded([r["v"] for r in drawn], dim)
    about = {"dim": dim, "top": top, "ids": np.asarray([r["vec_id"] for r in drawn]), "sample": rows, "pivots": pick_pivots(_lifted(rows, top), pivots)}
    shared = spark.sparkContext.broadcast(about)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value["pivots"]
        for batch in batches:
            if batch.num_rows:
                m = _lifted(_matrix(batch.column("v"), dim), top)
                d = np.sqrt(np.maximum((m * m).sum(1)[:, None] + (p * p).sum(1) - 2 * m @ p.T, 0))
                near = d.argmin(1)
                yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(m)), near]), batch.column("vec_id"), batch.column("v")], names=["pivot", "ring", "vec_id", "v"])

    keyed = vectors.mapInArrow(key, "pivot int, ring double, vec_id bigint, v array<bigint>")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(keyed.repartitionByRange(parts, "pivot", "ring", "vec_id").sortWithinPartitions("pivot", "ring", "vec_id")), about


def _exact(top: float):
    """The type in which inner products up to ``top`` are exact: the extended one has 64 bits for an integer."""
    return np.float64 if top < 2**53 else np.longdouble


class _Best:
    """The k best (score, id) of every query, ties to the smaller id."""

    def __init__(self, queries: int, k: int, floor: np.ndarray):
        self.score = np.full((queries, k), -np.inf, floor.dtype)
        self.ids = np.full((queries, k), np.iinfo(np.int64).max)
        self.floor = floor

    def worst(self) -> np.ndarray:
        return np.maximum(self.score[:, -1], self.floor)

    def offer(self, q: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores: a row of each query in q, a column of each id."""
        k = self.score.shape[1]
        hit = scores >= self.worst()[q][:, None]
        for i in np.flatnonzero(hit.any(1)):
            row = q[i]
            s = np.concatenate([self.score[row], scores[i][hit[i]]])
            d = np.concatenate([self.ids[row], ids[hit[i]]])
            first = np.lexsort((d, -s))[:k]
            self.score[row], self.ids[row] = s[first], d[first]


def _search(batches: Iterator[pa.RecordBatch], about: dict, q_ids: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray) -> Iterator[pa.RecordBatch]:
    dim, top, pivots = about["dim"], about["top"], about["pivots"]
    lifted = _lifted(q, top)
    # queries may be longer than every row: their own squared length replaces the lift's
    length = (q * q).sum(1)
    lifted[:, -1] = 0
    to_pivot = np.sqrt(np.maximum(length[:, None] + (pivots * pivots).sum(1) - 2 * lifted @ pivots.T, 0))
    best, kind = _Best(len(q), k, floor), _exact(top)
    q = q.astype(kind, copy=False)
    for batch in batches:
        if not batch.num_rows:
            continue
        m, ids = _matrix(batch.column("v"), dim), batch.column("vec_id").to_numpy()
        pivot, ring = batch.column("pivot").to_numpy(), batch.column("ring").to_numpy()
        edges = np.unique(np.concatenate([np.flatnonzero(np.diff(pivot, prepend=-1)), np.arange(0, len(ids), ANNULUS), [len(ids)]]))
        annuli = [(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        low = np.stack([np.maximum(np.maximum(ring[a:b].min() - to_pivot[:, pivot[a]], to_pivot[:, pivot[a]] - ring[a:b].max()), 0) for a, b in annuli])
        # q.x = (|q|^2 + top - distance^2) / 2, so the least distance bounds the score
        bound = (length + top - low * low) / 2 + 1e-6 * (length + top)
        for j in np.argsort(-bound.max(1), kind="stable"):
            a, b = annuli[j]
            live = np.flatnonzero(bound[j] >= best.worst())
            if len(live):
                scores = q[live] @ m[a:b].astype(kind, copy=False).T
                scores[q_ids[live][:, None] == ids[a:b][None, :]] = -np.inf
                best.offer(live, scores, ids[a:b])
    rows, ranks = np.nonzero(np.isfinite(best.score))
    if len(rows):
        if np.abs(best.score[rows, ranks]).max() >= 2.0**63:
            raise OverflowError("a score does not fit in 64 bits")
        yield pa.RecordBatch.from_arrays([pa.array(q_ids[rows]), pa.array(best.ids[rows, ranks]), pa.array(best.score[rows, ranks].astype(np.int64))], names=["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, pivots: int = PIVOTS, sample: int = SAMPLE, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of the largest integer inner product with each query.

    ``vectors`` is (vec_id, v) of :func:`integer_vectors`; ``is_query`` is a
    condition on ``vec_id``. Each block of queries (``block`` rows at most) is
    broadcast and meets all rows; each task returns k rows a query at most.
    """
    spark = vectors.sparkSession
    index, about = build_index(vectors, pivots, sample)
    empty = spark.createDataFrame([], "query_id bigint, vec_id bigint, score bigint")
    if not about:
        return _ranked(empty, k)
    asked = cut_lineage(vectors.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v")))
    total = asked.count()
    blocks = max(1, -(-total // block))
    # a block is a range of ids between quantiles, cut again until it is small enough
    bounds = asked.stat.approxQuantile("vec_id", [i / blocks for i in range(1, blocks)], 0.0) if blocks > 1 else []
    found = None
    edges = [None, *sorted({int(b) for b in bounds}), None]
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        part = asked
        part = part if low is None else part.where(F.col("vec_id") > low)
        part = part if high is None else part.where(F.col("vec_id") <= high)
        rows = part.orderBy("vec_id").collect()
        if not rows:
            continue
        q_ids, q = np.asarray([r["vec_id"] for r in rows], np.int64), _padded([r["v"] for r in rows], about["dim"])
        kind = _exact(about["top"])
        scores = q.astype(kind, copy=False) @ about["sample"].astype(kind, copy=False).T
        scores[q_ids[:, None] == about["ids"][None, :]] = -np.inf
        floor = np.sort(scores, axis=1)[:, -k] if scores.shape[1] >= k else np.full(len(q), -np.inf, kind)
        shared = spark.sparkContext.broadcast((about, q_ids, q, floor))
        near = index.mapInArrow(lambda batches, shared=shared: _search(batches, shared.value[0], *shared.value[1:3], k, shared.value[3]), "query_id bigint, vec_id bigint, score bigint")
        found = near if found is None else found.unionByName(near)
    return _ranked(found if found is not None else empty, k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
