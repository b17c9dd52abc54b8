"""Alignment of two tokenizers' tokens, scored by inverted bitmaps of linked id pairs.

A text's tokens under both tokenizers are cut into groups where a token of each
ends at the same byte; every token of a group is linked with every token of the
other tokenizer in it.

* Neither tokenizer joins a character to a blank after it, so a text falls into
  *segments* that begin with a blank, and tokens, groups and links of a segment
  do not depend on its neighbours: each distinct segment of a slice (some MB of texts) is
  encoded and aligned once.
* Per slice, an inverted index holds the documents of each linked pair as
  compressed bitmaps (64-bit words that are not zero), one for each binary digit of
  the number of links: the multiplicity planes. The OR of a pair's planes is its document
  bitmap, whose popcount is its document count. Slices hold different documents, so the OR
  over slices is the bitmaps side by side and popcounts add: only (pair, popcount)
  rows are shuffled.
* The counts come back to each slice by a join on the pair, and the postings of the planes
  return them to the documents: bit d of plane j adds 2^j links of the pair to document d.

Rows: texts that are null, empty, or not given back byte by byte by a
tokenizer have no tokens (zeros, empty text for the groups); repeated rows and
equal ids are documents of their own; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.blocks import pack, unpack
from creditloom.llm.common import doc_columns, single_threaded, slices, tokenizer_path
from creditloom.session import cut_lineage

SLICE_BYTES = 4 << 20
#: Ids of the second tokenizer in a pair's number.
SPAN = 1 << 20
_WHITE_BLANK = re.compile("[\\s᠎] ")
_CUT = re.compile("(?<=[^\\s᠎])(?= )")
#: Texts of these characters are cut alike by tiktoken and tokenizers.
_COMMON = re.compile("[^\\t\\n\\r\\x20-\\x7e¡-ɏ]")


def segments(text: str) -> list[str]:
    """The segments of " " + text, each without its first blank."""
    if text[:1] != " " and not _WHITE_BLANK.search(text):
        return text.split(" ")
    return [s[1:] for s in _CUT.split(" " + text)]


class Pair:
    """Both tokenizers with the byte length and bytes of their ids."""

    def __init__(self, path_a: str, path_b: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        from creditloom.llm.bpe import byte_alphabet

        single_threaded()
        alphabet = byte_alphabet()
        self.slow = Tokenizer.from_file(path_a)
        self.slow.encode_special_tokens = True
        self.slow.no_truncation()
        self.slow.no_padding()
        vocab = self.slow.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes_a[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        ranks = {bytes(alphabet[c] for c in token): i for token, i in self.slow.get_vocab(with_added_tokens=False).items() if all(c in alphabet for c in token)}
        special = {t.content for t in self.slow.get_added_tokens_decoder().values()}
        ranks = {token: i for token, i in ranks.items() if token.decode("utf-8", "replace") not in special}
        self.fast = tiktoken.Encoding("align", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.piece = sentencepiece.SentencePieceProcessor(model_file=path_b)
        n = self.piece.get_piece_size()
        pieces = [self.piece.id_to_piece(i) for i in range(n)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.piece.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.blank = self.piece.piece_to_id("▁")
        self.size_a, self.size_b = (np.array([len(b) for b in x], np.int64) for x in (self.bytes_a, self.bytes_b))

    def encode_a(self, keys: list[str]) -> list[list[int]]:
        unusual = [bool(_COMMON.search(k)) for k in keys]
        slow = iter(e.ids for e in self.slow.encode_batch([" " + k for k, u in zip(keys, unusual, strict=True) if u], add_special_tokens=False))
        return [next(slow) if u else self.fast.encode_ordinary(" " + k) for k, u in zip(keys, unusual, strict=True)]

    def encode_b(self, keys: list[str]) -> list[list[int]]:
        return [ids or [self.blank] for ids in self.piece.encode(keys, num_threads=1)]


@lru_cache(maxsize=2)
def _pair(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


class Aligned:
    """Distinct segments with both id lists, group strings, and links."""

    def __init__(self, pair: Pair, keys: list[str]):
        a, b = pair.encode_a(keys), pair.encode_b(keys)
        self.valid = np.ones(len(keys), bool)
        for i, k in enumerate(keys):
            whole = (" " + k).encode()
            if b"".join([pair.bytes_a[t] for t in a[i]]) != whole or b"".join([pair.bytes_b[t] for t in b[i]]) != whole:
                self.valid[i], a[i], b[i] = False, [], []
        self.n_a, self.n_b = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
        flat_a, flat_b = (np.fromiter((t for x in ids for t in x), np.int64) for ids in (a, b))
        end_a, end_b = np.cumsum(pair.size_a[flat_a]), np.cumsum(pair.size_b[flat_b])
        common = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
        in_a, in_b = np.bincount(group_a, minlength=len(common)), np.bincount(group_b, minlength=len(common))
        edge_a, edge_b = np.append(0, np.cumsum(in_a)), np.append(0, np.cumsum(in_b))
        segment_a = np.repeat(np.arange(len(keys)), self.n_a)
        first_group = np.searchsorted(edge_a, np.append(0, np.cumsum(self.n_a)))
        self.n_groups = np.diff(first_group)
        many = in_b[group_a]
        self.n_links = np.bincount(segment_a, many, len(keys)).astype(np.int64)
        nth = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        self.links = np.repeat(flat_a, many) * SPAN + flat_b[np.repeat(edge_b[group_a], many) + nth]
        said_a, said_b = list(map(str, flat_a.tolist())), list(map(str, flat_b.tolist()))
        ea, eb = edge_a.tolist(), edge_b.tolist()
        groups = [",".join(said_a[ea[g] : ea[g + 1]]) + "|" + ",".join(said_b[eb[g] : eb[g + 1]]) for g in range(len(common))]
        at = first_group.tolist()
        self.said = [";".join(groups[at[i] : at[i + 1]]) for i in range(len(keys))]


# -- bitmaps of a slice


def planes(pair: np.ndarray, doc: np.ndarray, times: np.ndarray, words: int) -> list[np.ndarray]:
    """For (pair, doc) in order with the number of links: for each binary digit, the keys pair * words + word and the 64-bit words."""
    out = []
    key, bit = pair.astype(np.uint64) * np.uint64(words) + (doc >> 6).astype(np.uint64), np.uint64(1) << (doc & 63).astype(np.uint64)
    for j in range(int(times.max()).bit_length() if len(times) else 0):
        chosen = np.flatnonzero(times >> j & 1)
        k = key[chosen]
        start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
        out += [k[start], np.bitwise_or.reduceat(bit[chosen], start) if len(start) else np.zeros(0, np.uint64)]
    return out


def document_counts(bitmaps: list[np.ndarray], pairs: int, words: int) -> np.ndarray:
    """Popcount of the OR of each pair's planes."""
    if not bitmaps:
        return np.zeros(pairs, np.int64)
    key, word = np.concatenate(bitmaps[::2]), np.concatenate(bitmaps[1::2])
    order = np.argsort(key, kind="stable")
    key, word = key[order], word[order]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    merged = np.bitwise_count(np.bitwise_or.reduceat(word, start))
    return np.bincount((key[start] // np.uint64(words)).astype(np.int64), merged, pairs).astype(np.int64)


def return_scores(bitmaps: list[np.ndarray], words: int, docs: int, count: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each document, its links of best pairs, and the sum of counts over its links."""
    n_best, total = np.zeros(docs, np.int64), np.zeros(docs, np.int64)
    for j in range(len(bitmaps) // 2):
        key, word = bitmaps[2 * j], bitmaps[2 * j + 1]
        pair, base = (key // np.uint64(words)).astype(np.int64), (key % np.uint64(words)).astype(np.int64) * 64
        while len(word):  # one posting of every word a turn
            low = word & (~word + np.uint64(1))
            doc = base + np.bitwise_count(low - np.uint64(1))
            n = count[pair]
            # sums in doubles are exact for each half of a count
            high, rest = np.bincount(doc, n >> 24, docs).astype(np.int64), np.bincount(doc, n & 0xFFFFFF, docs).astype(np.int64)
            total += ((high << 24) + rest) << j
            n_best += np.bincount(doc, best[pair], docs).astype(np.int64) << j
            word = word ^ low
            left = np.flatnonzero(word)
            word, pair, base = word[left], pair[left], base[left]
    return n_best, total


def index_slices(docs: DataFrame, path_a: str, path_b: str, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """One row a slice: its documents' figures, its pairs with their document counts, and the planes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, partition, nth = _pair(path_a, path_b), TaskContext.get().partitionId(), 0
        for part in slices(batches, limit=slice_bytes):
            book: dict[str, int] = {}
            number = book.setdefault
            texts = part.column("text").to_pylist()
            codes = [np.array([number(s, len(book)) for s in segments(t)], np.int64) if t else np.zeros(0, np.int64) for t in texts]
            aligned = Aligned(pair, list(book))
            codes = [c if aligned.valid[c].all() else c[:0] for c in codes]
            said = aligned.said
            sha = [hashlib.sha256(";".join([said[i] for i in c.tolist()]).encode()).hexdigest() if len(c) else "" for c in codes]
            flat, doc = np.concatenate(codes), np.repeat(np.arange(len(codes)), [len(c) for c in codes])
            figures = [np.bincount(doc, x[flat], len(codes)).astype(np.int64) for x in (aligned.n_a, aligned.n_b, aligned.n_groups, aligned.n_links)]
            distinct, of_link = np.unique(aligned.links, return_inverse=True)
            many = aligned.n_links[flat]
            begin = np.cumsum(aligned.n_links) - aligned.n_links
            place = np.arange(int(many.sum())) + np.repeat(begin[flat] - (np.cumsum(many) - many), many)
            posting, times = np.unique(of_link[place] << 32 | np.repeat(doc, many), return_counts=True)
            words = -(-len(codes) // 64)
            bitmaps = planes(posting >> 32, posting & 0xFFFFFFFF, times, words)
            counts = document_counts(bitmaps, len(distinct), words)
            ids = part.column("doc_id")
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            rows = pack(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), known, *figures)
            yield pa.RecordBatch.from_pydict({
                "slice": pa.array([partition << 32 | nth], pa.int64()), "documents": pa.array([rows], pa.binary()), "sha": pa.array([sha], pa.list_(pa.string())),
                "planes": pa.array([pack(*bitmaps)], pa.binary()), "a": pa.array([distinct // SPAN], pa.list_(pa.int64())),
                "b": pa.array([distinct % SPAN], pa.list_(pa.int64())), "n": pa.array([counts], pa.list_(pa.int64())),
            })
            nth += 1

    schema = "slice bigint, documents binary, sha array<string>, planes binary, a array<bigint>, b array<bigint>, n array<bigint>"
    return doc_columns(docs).mapInArrow(run, schema)


def align_documents(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document."""
    path_a, path_b = path_a or tokenizer_path("byte_bpe_50k.json"), path_b or tokenizer_path("piece_bpe_32k.model")
    index = cut_lineage(index_slices(docs, path_a, path_b, slice_bytes))
    rows = index.select(F.col("slice").alias("of_slice"), F.posexplode(F.arrays_zip("a", "b", "n")).alias("code", "p"))
    rows = rows.select("of_slice", "code", F.col("p.a").alias("a"), F.col("p.b").alias("b"), F.col("p.n").alias("n"))
    counts = cut_lineage(rows.groupBy("a", "b").agg(F.sum("n").alias("count")))
    highest = counts.groupBy("a").agg(F.max("count").alias("highest"))
    judged = counts.join(highest, "a").select("a", "b", "count", (F.col("count") == F.col("highest")).alias("best"))
    scores = rows.drop("n").join(judged, ["a", "b"]).select("of_slice", "code", "count", "best")

    def run(table: pa.Table, known: pa.Table) -> pa.Table:
        names = ("n_a", "n_b", "n_groups", "n_links")
        out = {k: [] for k in ("doc_id", *names, "n_best", "count_sum", "groups_sha256")}
        code = known.column("code").to_numpy()
        count, best = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
        count[code], best[code] = known.column("count").to_numpy(), known.column("best").to_numpy()
        for i in range(table.num_rows):
            ids, valid, *figures = unpack(table.column("documents")[i].as_py())
            bitmaps = unpack(table.column("planes")[i].as_py())
            n_best, total = return_scores(bitmaps, -(-len(ids) // 64), len(ids), count, best)
            for name, column in zip(names, figures, strict=True):
                out[name].append(pa.array(column))
            out["doc_id"].append(pa.array(ids, mask=~valid))
            out["n_best"].append(pa.array(n_best))
            out["count_sum"].append(pa.array(total))
            out["groups_sha256"].append(table.column("sha")[i].values)
        return pa.table({k: pa.chunked_array(v) for k, v in out.items()})

    schema = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    return index.select("slice", "documents", "sha", "planes").groupBy("slice").cogroup(scores.groupBy("of_slice")).applyInArrow(run, schema)
