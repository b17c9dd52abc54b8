"""Best-two-fit packing of tokenised documents into sequences of a fixed length.

A sequence is filled greedily with the longest pieces that fit. When nothing
fits any more, its smallest piece is replaced by the two unpacked pieces that
fill the larger gap most tightly, if they fill more than it did.

Lengths are whole numbers up to the capacity, so the choice depends only on
how many pieces of each length are left. Spark counts the pieces by length
(at most ``capacity`` rows reach the driver, whatever the input), the method
runs over these counts and yields *patterns* - a list of lengths and how many
sequences repeat it - and every piece then finds its place by its rank among
the pieces of its length. The patterns number at most capacity * ln(capacity)
or so: each one uses up a length for its count in the pattern.

Ranks need no sort and no group of rows: a task numbers its pieces of each
length, and the tasks' counts are summed up before it.

Rows: null text is read as empty (a document of the end token alone); repeated
rows and equal ids are packed each; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.common import doc_columns, single_threaded, slices, texts_of, tokenizer_path
from creditloom.session import cut_lineage

CAPACITY = 1024
END_ID = 2
#: Texts of these characters are cut alike by both libraries, whatever their Unicode version.
_COMMON = re.compile("[^\\t\\n\\r\\x20-\\x7e\u00a1-\u024f]")
_ENCODERS: dict[str, Callable[[str], np.ndarray]] = {}


def _encoder(path: str) -> Callable[[str], np.ndarray]:
    """Ids of a text as the tokenizers library gives them, once per Python worker.

    The vocabulary of the file also drives tiktoken, which is several times as
    fast; texts with unusual characters or special tokens go to tokenizers.
    """
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        from creditloom.llm.bpe import byte_alphabet

        tokenizer, alphabet = Tokenizer.from_file(path), byte_alphabet()
        special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        ranks = {bytes(alphabet[c] for c in token): i for token, i in tokenizer.get_vocab(with_added_tokens=False).items()}
        fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

        def encode(text: str) -> np.ndarray:
            if _COMMON.search(text) or any(s in text for s in special):
                return np.asarray(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")
            return fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)

        _ENCODERS[path] = encode
    return _ENCODERS[path]


def cut_pieces(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` tokens: full ones, but for the first."""
    first = n - capacity * (math.ceil(n / capacity) - 1)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))] if n else []


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str, text_col: str, keep_ids: bool) -> DataFrame:
    """Pieces of every document, each with its task (``chunk``) and its number
    among the task's pieces of its length (``nth``). A task that runs again
    reads the same split and numbers its pieces alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        single_threaded()
        encode, chunk, seen = _encoder(path), TaskContext.get().partitionId(), Counter()
        end = np.asarray([end_id], "<u4").tobytes()
        for batch in slices(batches):
            rows: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "nth", "ids")}
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch.column("text")), strict=True):
                ids = encode(text).tobytes() + end
                for k, (start, length) in enumerate(cut_pieces(len(ids) // 4, capacity)):
                    own = ids[4 * start : 4 * (start + length)]
                    for name, v in zip(rows, (doc, k, start, length, zlib.crc32(own), seen[length], own), strict=True):
                        rows[name].append(v)
                    seen[length] += 1
            out = {"doc_id": pa.array(rows["doc_id"], pa.int64()), "piece": pa.array(rows["piece"], pa.int32())}
            out |= {k: pa.array(rows[k], pa.int64()) for k in ("start", "length", "ids_crc32")}
            out |= {"chunk": pa.array([chunk] * len(rows["nth"]), pa.int64()), "nth": pa.array(rows["nth"], pa.int64())}
            if keep_ids:
                out["ids"] = pa.array(rows["ids"], pa.binary())
            yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, chunk bigint, nth bigint"
    return doc_columns(docs, id_col, text_col).mapInArrow(run, schema + ", ids binary" * keep_ids)


class _Lengths:
    """Lengths of which pieces are left, with the largest one up to a bound."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = [0] * (capacity + 1)
        for length, n in counts.items():
            self.left[length] = n
        # down[g]: a length from which to look downwards for the largest one left that is at most g
        self.down = list(range(capacity + 1))

    def at_most(self, gap: int) -> int:
        g = gap
        while g and not self.left[g]:
            g = self.down[g] if self.down[g] < g else g - 1
        at = gap
        while at > g:  # shorten the way for the next search: counts only fall between patterns
            self.down[at], at = g, (self.down[at] if self.down[at] < at else at - 1)
        return g


def best_two_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Patterns (lengths of one sequence, number of such sequences) that pack all pieces."""
    lengths = _Lengths({k: v for k, v in counts.items() if v > 0 and k > 0}, capacity)
    left = lengths.left
    patterns = []
    while (top := lengths.at_most(capacity)) > 0:
        chosen, gap, taken = [], capacity, Counter()
        bound = top
        while gap > 0:
            size = lengths.at_most(min(gap, bound))
            while size and left[size] <= taken[size]:
                size = lengths.at_most(size - 1)
            if not size:
                break
            fits = min(gap // size, left[size] - taken[size])
            chosen += [size] * fits
            taken[size] += fits
            gap -= size * fits
            bound = size if left[size] > taken[size] else size - 1
        if gap and len(chosen) > 1:
            pair = _tighter_pair(left, taken, chosen[-1], chosen[-1] + gap)
            if pair:
                taken[chosen.pop()] -= 1
                chosen += pair
                taken.update(pair)
        need = {k: n for k, n in taken.items() if n}
        times = min(left[k] // n for k, n in need.items())
        for k, n in need.items():
            left[k] -= n * times
        patterns.append((sorted(chosen, reverse=True), times))
    return patterns


def _tighter_pair(left: list[int], taken: Counter, smallest: int, room: int) -> list[int] | None:
    """The two unpacked pieces of the largest sum over ``smallest`` and up to ``room``."""
    free = [k for k in range(1, room) if left[k] - taken[k] > 0]
    best, found, i, j = smallest, None, 0, len(free) - 1
    while i <= j:
        total = free[i] + free[j]
        if total > room or (i == j and left[free[i]] - taken[free[i]] < 2):
            j -= 1
            continue
        if total > best:
            best, found = total, [free[j], free[i]]
        i += 1
    return found


def slots(patterns: list[tuple[list[int], int]], capacity: int) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: the first ranks of its runs, and each run's first sequence,
    pieces a sequence, and offset. The runs of a length cover its ranks in order."""
    runs: dict[int, list[list[int]]] = {}
    sequence, placed = 0, Counter()
    for chosen, times in patterns:
        offset = 0
        for size, n in sorted(Counter(chosen).items(), reverse=True):
            runs.setdefault(size, []).append([placed[size], sequence, n, offset])
            placed[size] += n * times
            offset += size * n
        sequence += times
    return {size: tuple(np.asarray(x, np.int64) for x in zip(*own, strict=True)) for size, own in runs.items()}


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]).

    The pieces are written once as a table and read twice: for the counts,
    and for the places. Ranks join by (chunk, length), of which no key holds
    more than one task's pieces.
    """
    spark = docs.sparkSession
    pieces = cut_lineage(token_pieces(docs, path or tokenizer_path(), capacity, end_id, id_col, text_col, keep_ids))
    counts = pieces.groupBy("length", "chunk").agg(F.count(F.lit(1)).alias("n"))
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = spark.sparkContext.broadcast(slots(best_two_fit(totals, capacity), capacity))
    before = F.sum("n").over(_before())
    bases = counts.select("length", "chunk", F.coalesce(before, F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["length", "chunk"]).withColumn("rank", F.col("base") + F.col("nth")).drop("base", "nth", "chunk")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = table.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            sequence, offset = np.empty_like(rank), np.empty_like(rank)
            order = np.argsort(length, kind="stable")
            edges = np.flatnonzero(np.diff(length[order], prepend=-1, append=-1))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                own = order[a:b]
                size = int(length[own[0]])
                first, seq, n, off = runs[size]
                k = np.searchsorted(first, rank[own], side="right") - 1
                along = rank[own] - first[k]
                sequence[own] = seq[k] + along // n[k]
                offset[own] = off[k] + along % n[k] * size
            kept = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * keep_ids + ", sequence_id bigint, offset bigint"
    return ranked.select(*names, "rank").mapInArrow(place, schema)


def _before():
    from pyspark.sql import Window

    return Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
