"""Blocks of documents and of hashed keys, for the exact-substring operators.

Documents are dealt into *chunks* of bounded text by the hash of their id; a
task works on a chunk with numpy. What chunks tell each other goes through
*shards* of the key space: a chunk sends a shard one sorted, packed block of
its distinct keys, so a key that a third of all rows hold arrives once from
each chunk, and the shard answers each chunk with what it needs to know.

The count-min sketch works that way, too: each chunk's partial sketch is the
sorted list of the cells it fills, a shard adds the partial sketches of its
range of cells, and answers with one bit for each cell sent: filled twice or
more. No sketch is held whole anywhere or broadcast, so its size follows the
input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from copy import copy
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.common import NULL_ID, give_back

#: Text of a chunk, and keys of a shard, aimed at; chunks that a task works on, one after the other.
CHUNK_BYTES = 3 << 20
SHARD_KEYS = 2 << 20
TASK_CHUNKS = 4
#: Chunks that send their blocks together, at most, once there are so many times that many chunks.
BATCH_CHUNKS, BATCHES = 8, 128
#: Count-min sketch: rows, cells per key in each row, and cells of a shard.
SKETCH_ROWS, CELLS_PER_KEY, SHARD_CELLS = 2, 8, 1 << 23
#: A cell this full is hot: its keys are dealt more finely.
HOT = 1000

U = np.uint64
_RNG = np.random.default_rng(20240607)
#: A random odd number for each byte value, and the two bases with their inverses modulo 2**64.
BYTE_VALUE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
BASE = 0x9E3779B97F4A7C13
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = x + U((0x9E3779B97F4A7C15 * (2 * salt + 1)) & (2**64 - 1))
        x ^= x >> U(30)
        x *= U(0xBF58476D1CE4E5B9)
        x ^= x >> U(27)
        x *= U(0x94D049BB133111EB)
        x ^= x >> U(31)
        return x


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    for i, b in ((0, BASE), (1, BASE_INVERSE)):
        if len(_POWERS[i]) < n:
            with np.errstate(over="ignore"):
                _POWERS[i] = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 1 << 16), b, np.uint64)]))
    return _POWERS[0][:n], _POWERS[1][:n]


#: A power is that of the place in its step times that of the step, so no table is as long as the values.
STEP_BITS = 15
_STEP = 1 << STEP_BITS
_STEP_BASE, _STEP_INVERSE = (pow(b, _STEP, 1 << 64) for b in (BASE, BASE_INVERSE))


def prefix_hashes(values: np.ndarray) -> np.ndarray:
    """P[i]: polynomial hash of the first i values; n + 1 of them."""
    return _prefix(len(values), lambda a, b: values[a:b])


def byte_prefix(data: np.ndarray) -> np.ndarray:
    """``prefix_hashes`` of the values of bytes."""
    return _prefix(len(data), lambda a, b: BYTE_VALUE[data[a:b]])


def _prefix(n: int, values: Callable[[int, int], np.ndarray]) -> np.ndarray:
    """In steps that stay in the cache."""
    out, p, first = np.zeros(n + 1, np.uint64), powers(_STEP)[0][:_STEP], 1
    for a in range(0, n, _STEP):
        b = min(a + _STEP, n)
        part = values(a, b) * p[: b - a]
        part *= U(first)
        part[:1] += out[a : a + 1]
        np.cumsum(part, out=out[a + 1 : b + 1])
        first = first * _STEP_BASE % (1 << 64)
    return out


def range_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end], the same wherever the values stand."""
    with np.errstate(over="ignore"):
        out = prefix[end]
        out -= prefix[start]
        out *= inverses(start, len(prefix))
        return out


def inverses(at: np.ndarray, n: int) -> np.ndarray:
    """Powers of the base's inverse at places below ``n``."""
    with np.errstate(over="ignore"):
        far = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n >> STEP_BITS, _STEP_INVERSE, np.uint64)]))
        out = powers(_STEP)[1][at & (_STEP - 1)]
        out *= far[at >> STEP_BITS]
        return out


def pack(*arrays: np.ndarray, like: bytes = b"") -> bytes:
    """Arrays as one compressed block; sorted integers are stored as differences.

    ``like`` is a sample of text for the compressor, so that small blocks of
    text are packed as well as large ones.
    """
    parts = [len(arrays).to_bytes(2, "little")]
    for a in arrays:
        kind = a.dtype.str
        body = a
        if a.dtype.kind == "u" and a.dtype.itemsize >= 4 and len(a) > 1 and bool((a[1:] >= a[:-1]).all()):
            gaps = np.diff(a, prepend=a.dtype.type(0))
            top = int(gaps[1:].max())
            body = gaps[1:].astype(np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)
            parts.append(b"d" + kind.encode().ljust(4) + body.dtype.str.encode().ljust(4) + len(body).to_bytes(8, "little") + int(a[0]).to_bytes(8, "little"))
        else:
            parts.append(b"r" + kind.encode().ljust(4) + kind.encode().ljust(4) + len(body).to_bytes(8, "little") + bytes(8))
        # bytes of equal rank together: the high ones hardly differ
        parts.append(np.ascontiguousarray(body).view(np.uint8).reshape(len(body), -1).T.tobytes() if len(body) else b"")
    return _compressor(like).compress(b"".join(parts))


@lru_cache(maxsize=2)
def _compressor(like: bytes):
    """Kept by a worker: to read the sample anew takes longer than to compress a small block."""
    import zstandard

    level, sample = 3 if like else 1, _sample(like)
    if sample:
        sample.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=sample)


@lru_cache(maxsize=2)
def _decompressor(like: bytes):
    import zstandard

    return zstandard.ZstdDecompressor(dict_data=_sample(like))


def _sample(like: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(like, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if like else None


def sample_text(docs: DataFrame, texts: int = 32, chars: int = 4096) -> bytes:
    """A few beginnings of texts, by the hash of the id: only for packing, no result depends on it."""
    rows = docs.where(F.col("text").isNotNull()).select(F.xxhash64("doc_id").alias("h"), F.substring("text", 1, chars).alias("t")).orderBy("h", "t").limit(texts).collect()
    return "".join(r["t"] for r in rows).encode()


def unpack(block: bytes, like: bytes = b"") -> list[np.ndarray]:
    data = _decompressor(like).decompress(block)
    out, at = [], 2
    for _ in range(int.from_bytes(data[:2], "little")):
        how, kind, held = data[at : at + 1], data[at + 1 : at + 5].decode().strip(), np.dtype(data[at + 5 : at + 9].decode().strip())
        n, first = int.from_bytes(data[at + 9 : at + 17], "little"), int.from_bytes(data[at + 17 : at + 25], "little")
        at += 25
        size = n * held.itemsize
        body = np.ascontiguousarray(np.frombuffer(data, np.uint8, size, at).reshape(held.itemsize, n).T).reshape(-1).view(held) if n else np.zeros(0, held)
        at += size
        if how == b"d":
            a = np.empty(n + 1, np.dtype(kind))
            a[0] = first
            a[1:] = body
            body = np.cumsum(a, dtype=np.dtype(kind))
        out.append(body)
    return out


# -- documents in chunks


def chunked(docs: DataFrame, bytes_per_chunk: int = CHUNK_BYTES, batched: bool = False) -> tuple[DataFrame, int]:
    """The columns of ``docs`` (doc_id, text, ...) and ``chunk``, dealt out by the hash of the id; and all bytes of text.

    A task has some chunks, one in memory at a time: fewer tasks sort and write fewer files.
    ``batched``: several chunks of a large input, then told apart by ``part``, have one number
    in ``chunk``. A batch sends a shard one block for all its chunks: chunks and shards both
    follow the input, so blocks of single chunks are as many as its square.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = max(least, -(-total // bytes_per_chunk))
    # a null id is dealt by its text, else all such rows would meet in one chunk
    chunk = F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id")), F.lit(n))
    if not batched:
        return docs.select(chunk.alias("chunk"), "*").repartition(max(least, -(-n // TASK_CHUNKS)), "chunk"), total
    together = min(BATCH_CHUNKS, max(1, n // max(BATCHES, least)))
    both = docs.select(F.floor(chunk / together).alias("chunk"), chunk.alias("part"), "*")
    return both.repartition(max(least, -(-n // max(TASK_CHUNKS, together))), "chunk"), total


class Docs:
    """The documents of a chunk or a batch: ids (null as the largest) and their bytes end to end.

    Ordered by part (of a batch) and id, then as they come: what is worked out does not depend on
    the order in which rows arrive, but for rows of equal id, which no test tells apart.
    """

    def __init__(self, table: pa.Table):
        raw = table.column("doc_id").combine_chunks()
        ids = pc.fill_null(raw, NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.argsort(ids, kind="stable")
        self.edges = np.array([0, len(ids)])
        if "part" in table.column_names:
            part = table.column("part").to_numpy()
            order = order[np.argsort(part[order], kind="stable")]
            self.edges = np.append(np.flatnonzero(np.diff(part[order], prepend=-1)), len(ids))
        self.ids, self.order = ids[order], order
        self.null = np.asarray(raw.is_null().to_numpy(zero_copy_only=False))[order]
        text = pc.fill_null(table.column("text"), "").combine_chunks().take(pa.array(order)).cast(pa.large_binary())
        offsets = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8)
        self.bytes = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(text) and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        self.start = offsets - offsets[0]
        self.n = len(self.ids)

    def parts(self) -> Iterator[tuple[int, Docs]]:
        """Each chunk of a batch, and where its bytes begin."""
        for a, b in zip(self.edges[:-1], self.edges[1:], strict=True):
            own, low = copy(self), self.start[a]
            own.ids, own.null, own.order, own.n = self.ids[a:b], self.null[a:b], self.order[a:b], b - a
            own.bytes, own.start = self.bytes[low : self.start[b]], self.start[a : b + 1] - low
            yield int(low), own

    def id_column(self) -> pa.Array:
        return pa.array(self.ids, pa.int64(), mask=self.null)


# -- the sketch


def cell_space(keys: int) -> tuple[int, int]:
    """Cells of a row (a power of two) and shards of a row."""
    cells = SHARD_CELLS
    while cells < CELLS_PER_KEY * keys:
        cells *= 2
    return cells, cells // SHARD_CELLS


def cells_of(keys: np.ndarray, row: int, cells: int) -> np.ndarray:
    return mix(keys, 11 + row) & U(cells - 1)


def sketch_blocks(chunk: int, keys: np.ndarray, twice: np.ndarray, cells: int, most: int = 2) -> pa.RecordBatch:
    """A chunk's partial sketch of distinct keys; ``twice``: the key is in two of its documents or more.
    A cell counts ``most`` at most (two for each chunk of a batch, whose keys are distinct in each)."""
    shards, blocks = [], []
    for row in range(SKETCH_ROWS):
        at = cells_of(keys, row, cells)
        order = np.argsort(at)
        at, two = at[order], twice[order]
        first = np.flatnonzero(np.diff(at, prepend=U(2**64 - 1)) != 0) if len(at) else np.zeros(0, np.int64)
        # a cell counts its distinct keys, and a key of several documents as two
        amount = np.add.reduceat(1 + two.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
        at = at[first]
        shard = (at // U(SHARD_CELLS)).astype(np.int64)
        edges = np.searchsorted(shard, np.arange(shard[-1] + 2)) if len(shard) else np.zeros(1, np.int64)
        for s in np.unique(shard):
            a, b = edges[s], edges[s + 1]
            shards.append(row * (cells // SHARD_CELLS) + int(s))
            blocks.append(pack((at[a:b] - U(int(s) * SHARD_CELLS)).astype(np.uint32), np.minimum(amount[a:b], most).astype(np.uint8)))
    return pa.RecordBatch.from_pydict({"shard": pa.array(shards, pa.int64()), "chunk": pa.array([chunk] * len(shards), pa.int64()), "block": pa.array(blocks, pa.binary())})


def merge_sketches(sketches: DataFrame, listed: bool = False) -> DataFrame:
    """(chunk, shard, block): for each cell that the chunk sent, 0, 1 (filled twice or more) or 2 (hot);
    ``listed``: the cells of 1 or 2 themselves, and which are hot."""

    def run(table: pa.Table) -> pa.Table:
        counts = np.zeros(SHARD_CELLS, np.uint16)
        parts = [unpack(b) for b in table.column("block").to_pylist()]
        for at, amount in parts:
            counts[at] = np.minimum(counts[at] + amount, HOT)
        if listed:
            full = [at[counts[at] >= 2] for at, _ in parts]
            answer = [pack(at, counts[at] >= HOT) for at in full]
        else:
            answer = [pack((counts[at] >= 2).astype(np.uint8) + (counts[at] >= HOT)) for at, _ in parts]
        return pa.table({"chunk": table.column("chunk"), "shard": table.column("shard"), "block": pa.array(answer, pa.binary())})

    return sketches.groupBy("shard").applyInArrow(run, "chunk bigint, shard bigint, block binary")


def estimated(keys: np.ndarray, answers: pa.Table, cells: int) -> np.ndarray:
    """For each distinct key of a chunk: 0 if it is in one document for sure, else 1, or 2 if hot.
    The smallest of the rows counts."""
    by = dict(zip(answers.column("shard").to_pylist(), answers.column("block").to_pylist(), strict=True))
    least = np.full(len(keys), 2, np.uint8)
    for row in range(SKETCH_ROWS):
        at = cells_of(keys, row, cells)
        distinct, where = np.unique(at, return_inverse=True)
        shards = np.unique((distinct // U(SHARD_CELLS)).astype(np.int64)) + row * (cells // SHARD_CELLS)
        full = np.concatenate([unpack(by[int(s)])[0] for s in shards]) if len(shards) else np.zeros(0, np.uint8)
        least = np.minimum(least, full[where])
    return least


class Full:
    """The listed cells that a batch was told of, by row."""

    def __init__(self, answers: pa.Table, cells: int):
        self.cells, self.rows = cells, []
        by = dict(zip(answers.column("shard").to_pylist(), answers.column("block").to_pylist(), strict=True))
        each = cells // SHARD_CELLS
        for row in range(SKETCH_ROWS):
            at, hot = [np.zeros(0, np.uint64)], [np.zeros(0, bool)]
            for s in sorted(s for s in by if s // each == row):
                own, warm = unpack(by.pop(s))
                at.append(own.astype(np.uint64) + U(s % each * SHARD_CELLS))
                hot.append(warm)
            known = np.concatenate(at)
            near = np.zeros(1 << 20, bool)  # most keys are ruled out by the low bits of their cell
            near[known & U(len(near) - 1)] = True
            self.rows.append((known, np.concatenate(hot), near))

    def estimated(self, keys: np.ndarray) -> np.ndarray:
        """As ``estimated``; the keys may repeat."""
        out = np.zeros(len(keys), np.uint8)
        some, least = np.arange(len(keys)), np.full(len(keys), 2, np.uint8)
        for row, (known, hot, near) in enumerate(self.rows):
            if not len(known):
                return out
            cell = cells_of(keys[some], row, self.cells)
            may = np.flatnonzero(near[cell & U(len(near) - 1)])
            some, least, cell = some[may], least[may], cell[may]
            at = np.minimum(np.searchsorted(known, cell), len(known) - 1)
            hit = known[at] == cell
            some, least = some[hit], np.minimum(least[hit], 1 + hot[at[hit]].astype(np.uint8))
        out[some] = least
        return out


# -- exact groups


def key_blocks(chunk: int, h: np.ndarray, c: np.ndarray, doc: np.ndarray, shards: int) -> pa.RecordBatch:
    """Distinct keys (h, c) of a chunk with their smallest document, by shard of h."""
    order = np.lexsort((c, h))
    h, c, doc = h[order], c[order], doc[order]
    shard = shard_of(h, shards)
    edges = np.searchsorted(shard, np.arange(shards + 1))
    ids, blocks = [], []
    for s in np.unique(shard):
        a, b = edges[s], edges[s + 1]
        table, index = np.unique(doc[a:b], return_inverse=True)
        ids.append(int(s))
        blocks.append(pack(h[a:b], c[a:b], index.astype(np.uint16 if len(table) < 1 << 16 else np.uint32), table.astype(np.int64)))
    return pa.RecordBatch.from_pydict({"shard": pa.array(ids, pa.int64()), "chunk": pa.array([chunk] * len(ids), pa.int64()), "block": pa.array(blocks, pa.binary())})


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of the hash."""
    return np.minimum((h >> U(32)) * U(shards) >> U(32), U(shards - 1)).astype(np.int64)


def smallest_documents(keys: DataFrame) -> DataFrame:
    """(chunk, shard, block): the chunk's keys that a smaller document of another chunk holds, with the smallest one."""

    def run(table: pa.Table) -> pa.Table:
        parts = []
        for block in table.column("block").to_pylist():
            h, c, index, docs = unpack(block)
            parts.append((h, c, docs[index]))
        h, c, doc = (np.concatenate(x) for x in zip(*parts, strict=True))
        source = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
        order = np.lexsort((doc, c, h))
        h, c, doc, source = h[order], c[order], doc[order], source[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
        least = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
        told = np.flatnonzero(least < doc)
        told = told[np.argsort(source[told], kind="stable")]
        edges = np.searchsorted(source[told], np.arange(len(parts) + 1))
        chunks, answers = [], []
        for i, chunk in enumerate(table.column("chunk").to_pylist()):
            own = told[edges[i] : edges[i + 1]]
            if len(own):
                chunks.append(chunk)
                answers.append(pack(h[own], c[own], least[own]))
        shard = table.column("shard")[0].as_py()
        return pa.table({"chunk": pa.array(chunks, pa.int64()), "shard": pa.array([shard] * len(chunks), pa.int64()), "block": pa.array(answers, pa.binary())})

    return keys.groupBy("shard").applyInArrow(run, "chunk bigint, shard bigint, block binary")


def looked_up(h: np.ndarray, c: np.ndarray, answers: pa.Table, otherwise: np.ndarray) -> np.ndarray:
    """The smaller of each key's document in the answers and ``otherwise``."""
    parts = [unpack(b) for b in answers.column("block").to_pylist()]
    if not parts or not len(h):
        return otherwise
    known_h, known_c, known = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((known_c, known_h))
    known_h, known_c, known = known_h[order], known_c[order], known[order]
    at = np.searchsorted(known_h, h)
    out = otherwise.copy()
    open_ = np.flatnonzero(at < len(known_h))
    while len(open_):  # more than one turn only where different keys share h
        i = at[open_]
        same_h = known_h[i] == h[open_]
        hit = same_h & (known_c[i] == c[open_])
        out[open_[hit]] = np.minimum(out[open_[hit]], known[i[hit]])
        open_ = open_[same_h & ~hit]
        at[open_] += 1
        open_ = open_[at[open_] < len(known_h)]
    return out


def with_answers(docs: DataFrame, answers: DataFrame, work: Callable[[tuple, pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``work`` on each chunk's documents and the answers it got; then it gives its memory back."""

    def run(key: tuple, table: pa.Table, own: pa.Table) -> pa.Table:
        try:
            return work(key, table, own)
        finally:
            give_back()

    return docs.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, schema)


def by_group(work: Callable[[tuple, pa.Table], pa.Table]) -> Callable[[tuple, pa.Table], pa.Table]:
    """``work`` on a group, which then gives its memory back."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        try:
            return work(key, table)
        finally:
            give_back()

    return run
