"""Removal of repeated word windows, with a count-min prefilter.

A window is a number of consecutive words of one document. Every word covered
by a window that also starts in a document of a smaller id is removed; windows
are judged on the input. First, merged partial sketches overestimate in how
many documents each window is; windows that are surely in one document go no
further. The others are grouped exactly by a 96-bit hash, each chunk sending a
window once, with its smallest document.

Rows: null text has no words; texts shorter than a window lose nothing; rows
of equal id are one document for the comparison and each give a row; a null id
is larger than all others (equal to none that is smaller); an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from creditloom.llm import blocks as B
from creditloom.llm.common import doc_columns

WINDOW = 13
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


class Words:
    """Words of a chunk: where each starts and ends, its document, and the windows."""

    def __init__(self, docs: B.Docs, window: int):
        data = docs.bytes
        solid = ~_BLANK[data]
        cuts = np.zeros(len(data) + 1, bool)  # a document's first byte starts a word, its end ends one
        cuts[docs.start] = True
        inside = np.zeros(len(data) + 1, bool)
        inside[:-1] = solid
        before = np.zeros(len(data) + 1, bool)
        before[1:] = solid
        self.start = np.flatnonzero(inside & (~before | cuts))
        self.end = np.flatnonzero(before & (~inside | cuts))
        self.doc = np.searchsorted(docs.start, self.start, side="right") - 1
        # several documents can start at one place if some are empty: the last of them has the word
        self.first = np.searchsorted(self.doc, np.arange(docs.n + 1))
        hashes = B.range_hashes(B.byte_prefix(data), self.start, self.end)
        n = len(hashes)
        left = self.first[self.doc + 1] - np.arange(n) if n else np.zeros(0, np.int64)
        self.at = np.flatnonzero(left >= window)  # words that start a window
        self.h = B.mix(B.range_hashes(B.prefix_hashes(B.mix(hashes, 1)), self.at, self.at + window), 2)
        self.c = (B.mix(B.range_hashes(B.prefix_hashes(B.mix(hashes, 3)), self.at, self.at + window), 4) >> B.U(32)).astype(np.uint32)

    def distinct(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(h, c, smallest id, in two documents or more, index of each window's key)."""
        return distinct_keys(self.h, self.c, ids[self.doc[self.at]] if len(self.at) else np.zeros(0, np.int64))


def distinct_keys(h: np.ndarray, c: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.lexsort((doc, c, h))
    sh, sc, sd = h[order], c[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (sh[1:] != sh[:-1]) | (sc[1:] != sc[:-1])
    first = np.flatnonzero(new)
    which = np.empty(len(h), np.int64)
    which[order] = np.cumsum(new) - 1
    last = np.append(first[1:], len(h)) - 1 if len(first) else first
    return sh[first], sc[first], sd[first], sd[last] > sd[first], which


def _chunk_of(key: tuple) -> int:
    return key[0].as_py()


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, text]): what is left of every document, its kept words joined by one blank."""
    own, total = B.chunked(doc_columns(docs, id_col, text_col))
    windows = max(1, total // 5)
    cells, _ = B.cell_space(windows)
    shards = max(1, -(-windows // B.SHARD_KEYS))
    blocks = "shard bigint, chunk bigint, block binary"

    def sketch(key: tuple, table: pa.Table) -> pa.Table:
        d = B.Docs(table)
        h, c, _, twice, _ = Words(d, window).distinct(d.ids)
        return pa.Table.from_batches([B.sketch_blocks(_chunk_of(key), h ^ c, twice, cells)])

    def repeated(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"shard": pa.array([], pa.int64()), "chunk": pa.array([], pa.int64()), "block": pa.array([], pa.binary())})
        d = B.Docs(table)
        h, c, least, _, _ = Words(d, window).distinct(d.ids)
        some = B.estimated(h ^ c, answers, cells) > 0
        return pa.Table.from_batches([B.key_blocks(_chunk_of(key), h[some], c[some], least[some], shards)])

    def left(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        d = B.Docs(table)
        w = Words(d, window)
        h, c, least, _, which = w.distinct(d.ids)
        least = B.looked_up(h, c, answers, least)
        gone = w.at[least[which] < d.ids[w.doc[w.at]]] if len(w.at) else w.at
        cover = np.zeros(len(w.start) + 1, np.int64)
        np.add.at(cover, gone, 1)
        np.add.at(cover, np.minimum(gone + window, len(w.start)), -1)
        removed = np.cumsum(cover[:-1]) > 0
        data = d.bytes.tobytes()
        n_words, n_removed = np.diff(w.first), np.zeros(d.n, np.int64)
        np.add.at(n_removed, w.doc[removed], 1)
        kept = []
        for i in range(d.n):
            words = data[d.start[i] : d.start[i + 1]].split()
            if n_removed[i]:
                words = [x for x, r in zip(words, removed[w.first[i] : w.first[i + 1]].tolist(), strict=True) if not r]
            kept.append(b" ".join(words))
        out = {"doc_id": d.id_column(), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept])}
        if keep_text:
            out["text"] = pa.array([x.decode() for x in kept], pa.string())
        return pa.table(out)

    sketches = own.groupBy("chunk").applyInArrow(B.by_group(sketch), blocks)
    candidates = B.with_answers(own, B.merge_sketches(sketches), repeated, blocks)
    return B.with_answers(own, B.smallest_documents(candidates), left, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", text string" * keep_text)


def oracle_sql(window: int = WINDOW) -> str:
    return f"""
        WITH w AS (
            SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents
        ), starts AS (
            SELECT doc_id, unnest(range(1, len(words) - {window - 2})) AS p, words FROM w WHERE len(words) >= {window}
        ), windows AS (
            SELECT doc_id, p, array_to_string(words[p : p + {window - 1}], ' ') AS k FROM starts
        ), firsts AS (
            SELECT k, min(doc_id) AS first FROM windows GROUP BY k
        ), gone AS (
            SELECT doc_id, list_sort(list_distinct(flatten(list(range(p, p + {window}))))) AS pos
            FROM windows JOIN firsts USING (k) WHERE first < doc_id GROUP BY doc_id
        ), kept AS (
            SELECT w.doc_id, len(words) AS n, coalesce(len(pos), 0) AS r,
                   array_to_string(list_filter(words, lambda x, i: pos IS NULL OR NOT list_contains(pos, i)), ' ') AS text
            FROM w LEFT JOIN gone USING (doc_id)
        )
        SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(r AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM kept
    """
