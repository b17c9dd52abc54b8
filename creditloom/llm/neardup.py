"""Near-duplicate documents by min-max hashing.

A document is the set of its distinct five-word shingles (fewer words: the
whole sequence as one). Under each permutation both the smallest and the
largest value are kept, which halves the hash evaluations of a signature.
Bands of a signature put documents into buckets, and a bucket only proposes:
its members are tied to its smallest one, so a bucket of m documents gives
m - 1 pairs. The connected groups of these ties are verified on full sets:
inside a group every pair is compared or already linked through others.

Documents of equal sets are one class from the start, which stands for all of
its copies by its smallest id. A group whose sets are large is cut into blocks
and verified block by block, so a task holds a bounded number of bytes; no
bucket, group or partner is capped.

A pair at the threshold is missed by all bands with a probability of 7e-9
(0.85) or 3e-6 (0.80), with 32 bands of 5.

Rows: null and empty texts and texts without words have an empty set and are
linked with nothing; a repeated row belongs to the class of its copy, and rows
of equal id are kept or dropped alike (of different texts under one id, one is
verified); rows without an id are matched by equal sets alone and get a null
component if no id is in it; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.llm import blocks as B
from creditloom.llm.common import NULL_ID, doc_columns, slices
from creditloom.llm.substrings import _BLANK
from creditloom.session import cut_lineage

SHINGLE = 5
PERCENT = 85
PERMUTATIONS, BANDS, ROWS = 80, 32, 5
#: Bytes of sets that a task verifies together.
BLOCK_BYTES = 16 << 20
#: Ties that a file of a turn holds, about.
FILE_TIES = 250_000
TEXT_SLICE = 2 << 20

_RNG = np.random.default_rng(77003)
_A = _RNG.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * B.U(2) + B.U(1)
_B = _RNG.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(column: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, edges): the sorted distinct shingle hashes of each text, end to end."""
    texts = [(t or "").encode() for t in column.to_pylist()]
    sizes = np.asarray([len(t) for t in texts], np.int64)
    start = np.concatenate([[0], np.cumsum(sizes)])
    data = _LOWER[np.frombuffer(b"".join(texts), np.uint8)]
    solid = ~_BLANK[data]
    inside, before, cuts = (np.zeros(len(data) + 1, bool) for _ in range(3))
    inside[:-1], before[1:], cuts[start] = solid, solid, True
    begin, end = np.flatnonzero(inside & (~before | cuts)), np.flatnonzero(before & (~inside | cuts))
    doc = np.searchsorted(start, begin, side="right") - 1
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    words = B.mix(B.range_hashes(B.byte_prefix(data), begin, end), 1)
    prefix = B.prefix_hashes(words)
    count = np.diff(first)
    full = np.flatnonzero(first[doc + 1] - np.arange(len(doc)) >= shingle)
    few = np.flatnonzero((count > 0) & (count < shingle))
    at = np.concatenate([full, first[few]])
    until = np.concatenate([full + shingle, first[few] + count[few]])
    h = B.mix(B.range_hashes(prefix, at, until), 2)
    h[len(full) :] = B.mix(h[len(full) :], 3)  # a short text is no shingle of a longer one
    owner = np.concatenate([doc[full], few])
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    return h, np.searchsorted(owner, np.arange(len(texts) + 1))


def band_keys(h: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Keys of the bands of each non-empty set: min and max of each permutation, ROWS of them to a band."""
    values = np.empty((2 * PERMUTATIONS, len(edges) - 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(PERMUTATIONS):
            moved = h * _A[k] + _B[k]
            values[k] = np.minimum.reduceat(moved, edges[:-1])
            values[PERMUTATIONS + k] = np.maximum.reduceat(moved, edges[:-1])
        keys = np.empty((BANDS, len(edges) - 1), np.uint64)
        for band in range(BANDS):
            own = np.full(len(edges) - 1, band, np.uint64)
            for row in range(ROWS):  # the minimum and maximum of one permutation are in different bands
                own = B.mix(own * B.U(0x100000001B3) ^ values[band + BANDS * row], 4)
            keys[band] = own
    return keys.T.view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n, k1, k2, bands): the size of each set, 128 bits that stand for it, and its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=TEXT_SLICE):
            h, edges = shingle_sets(batch.column("text"))
            n = np.diff(edges)
            some = np.flatnonzero(n)
            k1, k2 = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            bands = [None] * len(n)
            if len(some):
                starts = np.append(edges[:-1][some], len(h))
                with np.errstate(over="ignore"):
                    k1[some] = np.add.reduceat(B.mix(h, 5), starts[:-1]).view(np.int64)
                    k2[some] = np.bitwise_xor.reduceat(B.mix(h, 6), starts[:-1]).view(np.int64)
                for i, keys in zip(some.tolist(), band_keys(h, starts), strict=True):
                    bands[i] = keys
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n": pa.array(n, pa.int64()), "k1": pa.array(k1), "k2": pa.array(k2), "bands": pa.array(bands, pa.list_(pa.int64()))})

    return docs.mapInArrow(run, "doc_id bigint, n bigint, k1 bigint, k2 bigint, bands array<bigint>")


def _in_few_files(ties: DataFrame, most: int) -> DataFrame:
    """Some ``most`` ties, in files by their number: a turn writes no file for each shuffle partition."""
    return ties.coalesce(max(ties.sparkSession.sparkContext.defaultParallelism, -(-most // FILE_TIES)))


def components(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(node, root): the smallest node that each node of (a, b), ``most`` rows if known, reaches.

    Alternating large and small stars: each turn ties a node's neighbours to
    the smallest of them, first the larger, then the smaller ones. Every turn
    is a written table; the number of turns grows with the logarithm of a
    component's size.
    """
    most = edges.count() if most is None else most
    star = cut_lineage(_in_few_files(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), most))
    known = None
    while True:
        both = star.unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("x"), "m").unionByName(least.select(F.col("a").alias("x"), "m"))
        star = cut_lineage(_in_few_files(small.where(F.col("x") != F.col("m")).select(F.col("x").alias("a"), F.col("m").alias("b")).distinct(), most))
        said = star.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.count_distinct("a")).first()
        # done when every node has one tie and nothing changed
        if said == known:
            return star.select(F.col("a").alias("node"), F.col("b").alias("root"))
        known, most = said, 2 * said[0]  # a turn gives a tie for each of its ties and nodes at most


def linked_groups(h: np.ndarray, edges: np.ndarray, percent: int) -> np.ndarray:
    """For each set the index of a set that stands for all it is linked with, directly or not.

    Sets that look most like the whole group come first, so its core is one
    component after few turns; a turn compares one set with all sets of other components.
    """
    m = len(edges) - 1
    sizes = np.diff(edges)
    root = np.arange(m)
    if m < 2:
        return root
    owner = np.repeat(np.arange(m), sizes)
    _, term = np.unique(h, return_inverse=True)
    order = np.argsort(term, kind="stable")
    holders = owner[order]
    begin = np.concatenate([[0], np.cumsum(np.bincount(term))])
    often = np.diff(begin)[term]
    likeness = np.add.reduceat(often, edges[:-1]) / sizes
    for j in np.argsort(-likeness, kind="stable"):
        other = root != root[j]
        fits = other & (100 * np.minimum(sizes, sizes[j]) >= percent * np.maximum(sizes, sizes[j]))
        if not fits.any():
            if not other.any():
                break
            continue
        own = term[edges[j] : edges[j + 1]]
        n = begin[own + 1] - begin[own]
        where = np.repeat(begin[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        shared = np.bincount(holders[where], minlength=m)
        links = np.flatnonzero(fits & (100 * shared >= percent * (sizes + sizes[j] - shared)))
        if len(links):
            root[np.isin(root, root[links])] = root[j]
    return root


def _verify(table: pa.Table, percent: int) -> pa.Table:
    """(a, b): ties within the verified groups; rows are (grp, rep, hashes)."""
    groups = table.column("grp").to_numpy()
    reps = table.column("rep").to_numpy()
    order = np.lexsort((reps, groups))
    cuts = np.flatnonzero(np.diff(groups[order], prepend=groups[order[0]] - 1)) if len(order) else []
    blobs = table.column("hashes").to_pylist()
    a, b = [], []
    for start, stop in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
        own = order[start:stop]
        sets = [np.frombuffer(blobs[i], "<u8") for i in own]
        root = linked_groups(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])]), percent)
        tied = np.flatnonzero(root != np.arange(len(own)))
        a += reps[own[tied]].tolist()
        b += reps[own[root[tied]]].tolist()
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _sets_of(members: DataFrame) -> DataFrame:
    """(grp, parts, rep, hashes) of (grp, parts, rep, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=TEXT_SLICE):
            h, edges = shingle_sets(batch.column("text"))
            blobs = [h[a:b].astype("<u8").tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("grp"), batch.column("parts"), batch.column("rep"), pa.array(blobs, pa.binary())], names=["grp", "parts", "rep", "hashes"])

    return members.mapInArrow(run, "grp bigint, parts bigint, rep bigint, hashes binary")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): documents are linked if 100 * |both| >= percent * |either|;
    component_id is the smallest id that links reach, kept tells whether it is the document's own."""
    spark = docs.sparkSession
    own = doc_columns(docs, id_col, text_col)
    known = cut_lineage(signatures(own).withColumn("doc_id", F.coalesce("doc_id", F.lit(NULL_ID))))
    classes = cut_lineage(known.where("n > 0").groupBy("k1", "k2", "n").agg(F.min(F.struct("doc_id", "bands")).alias("first")).select("k1", "k2", "n", F.col("first.doc_id").alias("rep"), F.col("first.bands").alias("bands")))
    root = _verified(spark, own, classes, percent)
    whole = known.select("doc_id", "n", "k1", "k2").join(classes.select("k1", "k2", "n", "rep"), ["k1", "k2", "n"], "left")
    whole = whole.join(root.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.coalesce("root", "rep", "doc_id")
    back = lambda c: F.when(c != NULL_ID, c)
    return whole.select(back(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), back(component).alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def _verified(spark: SparkSession, own: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    keys = classes.select("rep", F.explode("bands").alias("key"))
    leaders = keys.groupBy("key").agg(F.min("rep").alias("leader"), F.max("rep").alias("last")).where("leader <> last")
    ties = keys.join(leaders.select("key", "leader"), "key").where("rep <> leader").select(F.col("rep").alias("a"), F.col("leader").alias("b"))
    groups = components(ties, BANDS * classes.count())
    groups = groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct())
    members = groups.join(classes.select(F.col("rep").alias("node"), "n"), "node")
    sized = members.groupBy("root").agg(F.ceil(F.sum(F.col("n") * 8) / BLOCK_BYTES).cast("bigint").alias("parts"))
    placed = cut_lineage(members.join(sized, "root").select(F.col("root").alias("grp"), "parts", F.col("node").alias("rep"), "n"))
    total, held = placed.agg(F.coalesce(F.sum(F.col("n") * 8), F.lit(0)), F.coalesce(F.sum("parts"), F.lit(0))).first()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BLOCK_BYTES))
    texts = own.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("rep"), "text")
    sets = _sets_of(texts.join(placed.select("rep", "grp", "parts"), "rep").dropDuplicates(["rep"]))
    part, n = F.pmod(F.xxhash64("rep"), F.col("parts")), F.col("parts")
    # small groups share a task; of a large one each pair of its blocks meets once
    pairs = F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: F.least(i, part) * n + F.greatest(i, part))
    dealt = sets.withColumn("slot", F.explode(F.when(n > 1, pairs).otherwise(F.array(F.lit(-1).cast("bigint")))))
    dealt = dealt.withColumn("task", F.when(n > 1, F.col("grp")).otherwise(F.pmod(F.xxhash64("grp"), F.lit(tasks))))
    links = dealt.select("task", "slot", "grp", "rep", "hashes").groupBy("task", "slot").applyInArrow(lambda table: _verify(table, percent), "a bigint, b bigint")
    return components(links, held)
