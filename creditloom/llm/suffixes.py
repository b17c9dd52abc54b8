"""Removal of repeated byte strings by a hash-compared suffix sort.

Every byte covered by a string of ``WINDOW`` bytes that also starts in a
document of a smaller id is removed; strings are judged on the input.

Each string (window) is stood for by the 24-byte gram of the least hash inside
it, its *anchor*. Equal windows have equal anchors at equal places, so only
grams of two documents or more matter; merged partial count-min sketches tell
which these may be. For these a chunk sends the *segment* around the anchor:
the bytes of all windows that share it, at most 76, each distinct segment once
with its smallest document. A shard holds all segments of a gram and sorts
them as suffixes from the anchor on, by merge sort over their bytes in words of
eight. Neighbours' common extensions, found by binary search on prefix
polynomial hashes, then delimit runs of suffixes that agree on the right part
of a window, and the hash of its left part splits a run into equal windows, of
which the smallest document counts. Every window found so is compared byte by
byte with the one it equals.

Of a large input several chunks, worked on one after the other, send a shard
one block (``blocks.chunked``): blocks of one chunk each would be as many as
the square of the input.

A gram with very many different surroundings (the sketch counts it as hot)
would make one large group: its windows are sent one by one instead, dealt by
the hash of the whole window.

Rows: null text is read as empty; texts shorter than a window lose nothing;
rows of equal id are one document for the comparison and each give a row; a
null id is larger than all others; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm import blocks as B
from creditloom.llm.common import doc_columns, kept_schema, named_back
from creditloom.llm.substrings import distinct_keys

WINDOW, GRAM = 50, 24
#: Bits for a place in a chunk; the others of an anchor's 64 are its hash.
PLACE_BITS = 30
#: Segments sorted at once; a shard has so many times that many anchors, at most that are sent.
SEGMENTS, SHARD_SEGMENTS = 1 << 18, 2
#: Window starts, or strings to compare, worked on at once.
STEP = 1 << 15
_EMPTY = {"shard": pa.int64(), "chunk": pa.int64(), "block": pa.binary()}


class Segments:
    """The anchors of a chunk: first and last window start, place, document, hash."""

    def __init__(self, docs: B.Docs, window: int = WINDOW, gram: int = GRAM):
        data, n = docs.bytes, len(docs.bytes)
        self.window = window
        self.prefix = B.byte_prefix(data)
        none = np.zeros(0, np.int64)
        self.low = self.high = self.anchor = self.doc = none
        self.key = np.zeros(0, np.uint64)
        if n < window:
            return
        if n >= 1 << PLACE_BITS:
            raise ValueError(f"a chunk or a document of {n} bytes is over the limit of {1 << PLACE_BITS}")
        anchor = self._anchors(window, gram)
        # a new segment begins where the anchor changes, and with each document
        begins = np.ones(len(anchor), bool)
        np.not_equal(anchor[1:], anchor[:-1], out=begins[1:])
        begins[docs.start[:-1][docs.start[:-1] < len(begins)]] = True
        low = np.flatnonzero(begins)
        high = np.append(low[1:], len(begins)) - 1
        doc = np.searchsorted(docs.start, low, side="right") - 1
        last = docs.start[doc + 1] - window
        inside = low <= last
        self.low, self.high, self.doc = low[inside], np.minimum(high, last)[inside], doc[inside]
        self.anchor = anchor[self.low].astype(np.int64)
        self.key = B.mix(B.range_hashes(self.prefix, self.anchor, self.anchor + gram), 5)

    def _anchors(self, window: int, gram: int) -> np.ndarray:
        """For each window start, document ends aside, the place of its least gram; in steps that stay in the cache."""
        n, grams, low = len(self.prefix) - 1, window - gram + 1, B.U((1 << PLACE_BITS) - 1)
        anchor = np.empty(n - window + 1, np.int32)
        inverse = B.powers(STEP + grams)[1]
        for a in range(0, len(anchor), STEP):
            b = min(a + STEP, len(anchor)) + grams - 1
            least = self.prefix[a + gram : b + gram] - self.prefix[a:b]
            least *= inverse[: b - a]
            least *= B.inverses(np.array([a]), n)
            least &= ~low  # the high bits of a polynomial hash need no scramble to be an order
            least |= np.arange(a, b, dtype=np.uint64)
            width = 1
            while 2 * width <= grams:
                least = np.minimum(least[:-width], least[width:])
                width *= 2
            if grams > width:
                least = np.minimum(least[: len(least) - (grams - width)], least[grams - width :])
            anchor[a : b - grams + 1] = least & low
        return anchor

    def hashes(self, start: np.ndarray, end: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """96 bits of the bytes and of the anchor's place in them."""
        with np.errstate(over="ignore"):
            whole = B.range_hashes(self.prefix, start, end) + (anchor - start).astype(np.uint64) * B.U(0xD6E8FEB86659FD93)
            left = B.range_hashes(self.prefix, start, anchor) + (end - start).astype(np.uint64)
            return B.mix(whole, 6), (B.mix(B.mix(left, 7) ^ whole, 8) >> B.U(32)).astype(np.uint32)

    def single(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(segment, window start) of each window of these segments."""
        n = self.high[some] - self.low[some] + 1
        which = np.repeat(some, n)
        return which, self.low[which] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _gathered(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    return data[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())]


def _differ(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the strings of these sizes at ``a`` and at ``b`` differ."""
    out = np.zeros(len(a), bool)
    for i in range(0, len(a), STEP):
        n = size[i : i + STEP]
        unlike = _gathered(data, a[i : i + STEP], n) != _gathered(data, b[i : i + STEP], n)
        out[i + np.searchsorted(np.cumsum(n), np.flatnonzero(unlike), side="right")] = True
    return out


class Sent:
    """What a chunk sends: each distinct segment (or window of a hot gram), by shard and hash.

    It is the same whenever it is worked out, so an answer need only name the
    shard and the place in what was sent to it.
    """

    def __init__(self, d: B.Docs, s: Segments, level: np.ndarray, shards: int):
        some = np.flatnonzero(level == 1)
        rows, starts = s.single(np.flatnonzero(level == 2))
        self.row = np.concatenate([some, rows])
        self.start = np.concatenate([s.low[some], starts])
        self.end = np.concatenate([s.high[some], starts]) + s.window
        hot = np.arange(len(self.row)) >= len(some)
        h, c = s.hashes(self.start, self.end, s.anchor[self.row])
        _, _, least, twice, self.which = distinct_keys(h, c, d.ids[s.doc[self.row]])
        first = np.full(len(least), -1, np.int64)
        first[self.which[::-1]] = np.arange(len(self.which))[::-1]
        shard = B.shard_of(np.where(hot[first], h[first], B.mix(s.key[self.row[first]], 9)), shards)
        self.order = np.argsort(shard, kind="stable")  # the distinct ones are in order of their hash
        self.shard, self.first, self.least, self.flags = shard, first, least, hot[first] + 2 * twice.astype(np.int64)
        self.left = (s.anchor[self.row] - self.start)[first]

    def rows(self, low: int) -> tuple[np.ndarray, ...]:
        """Shard, place in the batch (``low``: where the chunk begins), size, anchor, flags, document of what is sent."""
        o, start = self.order, self.start[self.first]
        size = (self.end - self.start)[self.first]
        return self.shard[o].astype(np.int32), (start + low)[o], size[o].astype(np.uint8), self.left[o].astype(np.uint8), self.flags[o].astype(np.uint8), self.least[o]

    def places(self, sent: np.ndarray) -> np.ndarray:
        """For what is sent, shard and place in all that the batch sends to it, as one number.
        ``sent``: how many the chunks before sent to each shard; this one adds its own."""
        shard = self.shard[self.order]
        n = np.bincount(shard, minlength=len(sent))
        out = (shard << 32) + np.arange(len(shard)) + (sent - (np.cumsum(n) - n))[shard]
        sent += n
        return out


def sent_blocks(batch: int, data: np.ndarray, rows: list[tuple[np.ndarray, ...]], like: bytes) -> pa.Table:
    """One block a shard of what the chunks of a batch send, chunk after chunk."""
    shard, start, size, left, flags, least = (np.concatenate(x) for x in zip(*rows, strict=True))
    order = np.argsort(shard, kind="stable")
    edges = np.append(np.flatnonzero(np.diff(shard[order], prepend=-1)), len(order))
    shards, blocks = [], []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        o = order[a:b]
        table, index = np.unique(least[o], return_inverse=True)
        shards.append(int(shard[o[0]]))
        blocks.append(B.pack(_gathered(data, start[o], size[o].astype(np.int64)), size[o], left[o], flags[o], index.astype(np.uint16 if len(table) < 1 << 16 else np.uint32), table, like=like))
    return pa.table({"shard": pa.array(shards, pa.int64()), "chunk": pa.array([batch] * len(shards), pa.int64()), "block": pa.array(blocks, pa.binary())})


class SuffixSort:
    """Classes of segments (bytes, place of the anchor, smallest document), sorted as suffixes within each gram."""

    def __init__(self, classes: list[tuple[bytes, int, int]], window: int, gram: int):
        text, left, doc = zip(*classes, strict=True) if classes else ((), (), ())
        self._sort(np.frombuffer(b"".join(text), np.uint8), *(np.asarray(x, np.int64) for x in ([len(x) for x in text], left, doc)), window, gram)

    @classmethod
    def of(cls, data: np.ndarray, size: np.ndarray, left: np.ndarray, doc: np.ndarray, window: int, gram: int) -> SuffixSort:
        """Of classes whose bytes lie end to end."""
        own = cls.__new__(cls)
        own._sort(data, size, left, doc, window, gram)
        return own

    def _sort(self, data: np.ndarray, size: np.ndarray, left: np.ndarray, doc: np.ndarray, window: int, gram: int) -> None:
        self.window, self.data, self.left, self.doc = window, data, left, doc
        self.end = np.cumsum(size)
        self.at = self.end - size + left
        self.prefix = B.byte_prefix(data)
        key = B.range_hashes(self.prefix, self.at, self.at + gram)
        order = np.argsort(key, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = key[order[1:]] != key[order[:-1]]
        some = np.flatnonzero(~(new & np.append(new[1:], True)))  # a gram of one class needs no order
        order[some] = order[some][np.lexsort((*self._words(order[some]), np.cumsum(new)[some]))]
        self.order = order
        self.common = np.zeros(len(order), np.int64)
        self.common[some] = self._neighbours(order[some])
        # a gram's first: the one before shares less than the gram with it, whatever their hashes
        self.first = new | (self.common < gram)
        self.common[self.first] = 0

    def _words(self, own: np.ndarray) -> list[np.ndarray]:
        """Sort keys of the suffixes, as for ``lexsort``: size last of all, after the bytes in words of eight, zeros behind the end."""
        at, size = self.at[own], (self.end - self.at)[own]
        eight, words = np.arange(8), []
        for a in range(0, int(size.max(initial=0)), 8):
            word = self.data[np.minimum(at[:, None] + (a + eight), len(self.data) - 1)]
            word[a + eight >= size[:, None]] = 0
            words.append(word.view(">u8").astype(np.uint64)[:, 0])
        return [size, *words[::-1]]

    def _neighbours(self, o: np.ndarray) -> np.ndarray:
        """Common extension of each of these suffixes with the one before it."""
        at, size = self.at[o], self.end[o] - self.at[o]
        low = np.zeros(len(o), np.int64)
        if len(o) > 1:
            high = np.minimum(size[1:], size[:-1])
            lo = np.zeros(len(high), np.int64)
            a, b = at[1:], at[:-1]
            while (lo < high).any():
                half = (lo + high + 1) // 2
                same = B.range_hashes(self.prefix, a, a + half) == B.range_hashes(self.prefix, b, b + half)
                lo, high = np.where(same, half, lo), np.where(same, high, half - 1)
            low[1:] = lo
        return low

    def smallest(self) -> tuple[np.ndarray, np.ndarray]:
        """For each class the smallest document of each of its windows, first window first: (where each class begins, documents)."""
        n = len(self.order)
        size = self.end - self.at
        windows = self.left - (self.window - size) + 1
        begin = np.cumsum(windows) - windows
        out = np.repeat(self.doc, windows)
        alone = self.first & np.append(self.first[1:], True) if n else self.first
        some = self.order[~alone]
        common = self.common[~alone]
        for s in range(int(self.left[some].max(initial=-1)) + 1):  # windows that start s bytes before the anchor
            run = np.cumsum(common < self.window - s)
            fits = (self.left[some] >= s) & (size[some] >= self.window - s)
            own, run = some[fits], run[fits]
            if not len(own):
                continue
            before = B.range_hashes(self.prefix, self.at[own] - s, self.at[own])
            order = np.lexsort((self.doc[own], before, run))
            own, run, before = own[order], run[order], before[order]
            new = np.ones(len(own), bool)
            new[1:] = (run[1:] != run[:-1]) | (before[1:] != before[:-1])
            head = own[np.flatnonzero(new)][np.cumsum(new) - 1]
            least = self.doc[head]
            found = np.flatnonzero(least < self.doc[own])  # equal hashes: are the bytes?
            for j in found[_differ(self.data, self.at[own[found]] - s, self.at[head[found]] - s, np.full(len(found), self.window))]:
                least[j] = self._by_bytes(own[j], own[run == run[j]], s)
            out[begin[own] + self.left[own] - s] = least
        return begin, out

    def _by_bytes(self, i: int, among: np.ndarray, s: int) -> int:
        own = self.data[self.at[i] - s :][: self.window]
        return min(int(self.doc[j]) for j in among if np.array_equal(self.data[self.at[j] - s :][: self.window], own))


class Shard:
    """What batches sent to a shard, end to end."""

    def __init__(self, blocks: list[bytes], like: bytes):
        parts = [B.unpack(b, like) for b in blocks]
        self.data = np.concatenate([p[0] for p in parts])
        self.size, self.left, self.flags = (np.concatenate([p[k] for p in parts]) for k in (1, 2, 3))
        self.doc = np.concatenate([p[5][p[4]] for p in parts])
        self.edges = np.cumsum([0, *(len(p[1]) for p in parts)])
        self.start = np.cumsum(self.size, dtype=np.int64) - self.size

    def hashes(self, gram: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each segment's gram, and of the whole with the anchor's place; in steps of some rows."""
        of_gram, whole = (np.empty(len(self.size), np.uint64) for _ in range(2))
        for a in range(0, len(self.size), STEP):
            size, left = self.size[a : a + STEP].astype(np.int64), self.left[a : a + STEP].astype(np.int64)
            at = self.start[a : a + STEP] - self.start[a]
            prefix = B.byte_prefix(self.data[self.start[a] : self.start[a] + int(size.sum())])
            of_gram[a : a + STEP] = B.mix(B.range_hashes(prefix, at + left, at + left + gram), 5)
            whole[a : a + STEP] = B.mix(B.range_hashes(prefix, at, at + size), 6) + left.astype(np.uint64)
        return of_gram, whole

    def classes(self, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of some grams at a time, rows and the class of each: equal bytes, anchor at an equal place, confirmed byte by byte."""
        of_gram, whole = self.hashes(gram)
        order = np.lexsort((whole, of_gram))
        other = np.flatnonzero(np.diff(of_gram[order], prepend=~of_gram[order[:1]]) != 0) if len(order) else order
        edges = [*other[np.unique(np.searchsorted(other, np.arange(0, len(order), SEGMENTS), side="right") - 1)], len(order)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            rows = order[a:b]
            new = np.ones(len(rows), bool)
            new[1:] = (of_gram[rows[1:]] != of_gram[rows[:-1]]) | (whole[rows[1:]] != whole[rows[:-1]])
            cls = np.cumsum(new) - 1
            more, head = rows[~new], rows[np.flatnonzero(new)][cls[~new]]
            if ((self.size[more] != self.size[head]) | (self.left[more] != self.left[head])).any() or _differ(self.data, self.start[more], self.start[head], self.size[more].astype(np.int64)).any():
                yield self._by_bytes(rows)
            else:
                yield rows, cls

    def _by_bytes(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Classes by the bytes themselves, where different ones have equal hashes."""
        known: dict[tuple[bytes, int], int] = {}
        cls = np.array([known.setdefault((self.data[self.start[i] :][: self.size[i]].tobytes(), int(self.left[i])), len(known)) for i in rows], np.int64)
        order = np.argsort(cls, kind="stable")
        return rows[order], cls[order]

    def answers(self, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each row how many documents are told (0: none, else one a window) and where these begin; the documents."""
        n, begin, told, total = np.zeros(len(self.size), np.int64), np.zeros(len(self.size), np.int64), [np.zeros(0, np.int64)], 0
        for rows, cls in self.classes(gram):
            first = np.flatnonzero(np.diff(cls, prepend=-1))
            head = rows[first]
            size = self.size[head].astype(np.int64)
            data = np.concatenate([_gathered(self.data, self.start[head[i : i + STEP]], size[i : i + STEP]) for i in range(0, len(head), STEP)])
            at, smallest = SuffixSort.of(data, size, self.left[head].astype(np.int64), np.minimum.reduceat(self.doc[rows], first), window, gram).smallest()
            ends = np.append(at[1:], len(smallest))
            some = np.flatnonzero((np.minimum.reduceat(smallest, at)[cls] < self.doc[rows]) | (self.flags[rows] >= 2))
            n[rows[some]], begin[rows[some]] = (ends - at)[cls[some]], total + at[cls[some]]
            told.append(smallest)
            total += len(smallest)
        return n, begin, np.concatenate(told)


def _merge(table: pa.Table, window: int, gram: int, like: bytes) -> pa.Table:
    shard = Shard(table.column("block").to_pylist(), like)
    size, begin, smallest = shard.answers(window, gram)
    chunks, shards, answers = [], [], []
    for chunk, of_shard, a, b in zip(table.column("chunk").to_pylist(), table.column("shard").to_pylist(), shard.edges[:-1], shard.edges[1:], strict=True):
        told = np.flatnonzero(size[a:b])
        if len(told):
            n = size[a:b][told]
            of, place = np.unique(_gathered(smallest, begin[a:b][told], n), return_inverse=True)
            chunks.append(chunk)
            shards.append(of_shard)
            answers.append(B.pack(told.astype(np.uint32), n.astype(np.uint8), place.astype(np.uint16 if len(of) < 1 << 16 else np.uint32), of.astype(np.int64)))
    return pa.table({"chunk": pa.array(chunks, pa.int64()), "shard": pa.array(shards, pa.int64()), "block": pa.array(answers, pa.binary())})


class Told:
    """What a batch is told by all shards, in order of shard and place in what it sent there."""

    def __init__(self, answers: pa.Table):
        key, size, place, known, total = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], 0
        for shard, block in sorted(zip(answers.column("shard").to_pylist(), answers.column("block").to_pylist(), strict=True)):
            told, n, at, of = B.unpack(block)
            key.append((shard << 32) + told.astype(np.int64))
            size.append(n.astype(np.int64))
            place.append(at.astype(np.uint32) + np.uint32(total))
            known.append(of)
            total += len(of)
        self.key, size = np.concatenate(key), np.concatenate(size)
        self.begin = np.cumsum(size) - size
        self.place, self.known = np.concatenate(place), np.concatenate(known)

    def of(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of these places are told of, and where their documents begin in ``place``."""
        if not len(self.key):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.key, places), len(self.key) - 1)
        some = np.flatnonzero(self.key[at] == places)
        return some, self.begin[at[some]]


def _removed(d: B.Docs, s: Segments, sent: Sent, places: np.ndarray, told: Told) -> np.ndarray:
    """For each window start of the chunk's bytes, whether the window is in a smaller document."""
    gone = np.zeros(len(d.bytes) + 1, bool)
    # where the answer to each distinct segment begins among all answered documents, or -1
    begin = np.full(len(sent.first), -1, np.int64)
    some, at = told.of(places)
    begin[sent.order[some]] = at
    row = np.flatnonzero(begin[sent.which] >= 0)
    size = (sent.end - sent.start)[row] - s.window + 1
    step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    starts = np.repeat(sent.start[row], size) + step
    least = told.known[told.place[np.repeat(begin[sent.which[row]], size) + step]]
    gone[starts[least < np.repeat(d.ids[s.doc[sent.row[row]]], size)]] = True
    return gone


def _running(flags: np.ndarray) -> np.ndarray:
    """How many flags are set before each place, and in all; below 2**30."""
    out = np.zeros(len(flags) + 1, np.int32)
    np.cumsum(flags, dtype=np.int32, out=out[1:])
    return out


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, text]) and the ``keep`` columns.

    ``text`` is what is left, read as UTF-8; of a character that was cut the
    other bytes go, too (the digest is of the bytes themselves).
    """
    own, total = B.chunked(doc_columns(docs, id_col, text_col, keep), batched=True)
    anchors = max(1, 2 * total // (window - gram + 2))
    cells, _ = B.cell_space(anchors)
    shards = max(1, -(-anchors // (SHARD_SEGMENTS * SEGMENTS)))
    blocks = "shard bigint, chunk bigint, block binary"
    like = B.sample_text(doc_columns(docs, id_col, text_col))

    def sketch(key: tuple, table: pa.Table) -> pa.Table:
        keys, twice = [], []
        d = B.Docs(table)
        for _, own in d.parts():
            s = Segments(own, window, gram)
            distinct, _, _, two, _ = distinct_keys(s.key, np.zeros(len(s.key), np.uint32), own.ids[s.doc])
            keys.append(distinct)
            twice.append(two)
        return pa.Table.from_batches([B.sketch_blocks(key[0].as_py(), np.concatenate(keys), np.concatenate(twice), cells, 2 * len(keys))])

    def send(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({k: pa.array([], t) for k, t in _EMPTY.items()})
        d, full, rows = B.Docs(table), B.Full(answers, cells), []
        for low, own in d.parts():
            s = Segments(own, window, gram)
            rows.append(Sent(own, s, full.estimated(s.key), shards).rows(low))
        return sent_blocks(key[0].as_py(), d.bytes, rows, like)

    def left(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        d = B.Docs(table)
        of_sketch = answers.column("sketch").to_numpy(zero_copy_only=False).astype(bool)
        full, told = B.Full(answers.filter(pa.array(of_sketch)), cells), Told(answers.filter(pa.array(~of_sketch)))
        sent = np.zeros(shards, np.int64)
        out = [without(own, full, told, sent) for _, own in d.parts()]
        columns = {"doc_id": d.id_column(), "n_bytes": pa.array(np.diff(d.start), pa.int64())}
        columns |= {k: pa.chunked_array([x[k] for x in out]) for k in out[0]}
        return pa.table(columns | {f"keep_{i}": table.column(f"keep_{i}").take(pa.array(d.order)) for i in range(len(keep))})

    def without(d: B.Docs, full: B.Full, told: Told, before: np.ndarray) -> dict[str, pa.Array]:
        """What is left of the documents of a chunk."""
        s = Segments(d, window, gram)
        sent = Sent(d, s, full.estimated(s.key), shards)
        gone = np.flatnonzero(_removed(d, s, sent, sent.places(before), told))
        del s, sent
        cover = np.zeros(len(d.bytes) + 1, np.int32)
        cover[gone] += 1
        cover[gone + window] -= 1
        removed = np.cumsum(cover, dtype=np.int32, out=cover)[:-1] > 0
        del gone, cover
        total = _running(removed)
        n_removed = total[d.start[1:]] - total[d.start[:-1]]
        opens = removed.copy()
        opens[1:] &= ~removed[:-1]
        inner = d.start[:-1][d.start[:-1] < len(removed)]
        opens[inner] = removed[inner]  # a run ends with its document
        spans = _running(opens)
        n_spans = spans[d.start[1:]] - spans[d.start[:-1]]
        kept = [(x[~removed[a:b]] if r else x).tobytes() for a, b, r, x in ((a, b, r, d.bytes[a:b]) for a, b, r in zip(d.start[:-1], d.start[1:], n_removed, strict=True))]
        out = {"n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept])}
        if keep_text:
            out["text"] = pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string())
        return out

    known = B.merge_sketches(own.groupBy("chunk").applyInArrow(B.by_group(sketch), blocks), listed=True)
    sent = B.with_answers(own, known, send, blocks)
    merged = sent.groupBy("shard").applyInArrow(B.by_group(lambda key, table: _merge(table, window, gram, like)), "chunk bigint, shard bigint, block binary")
    answers = known.withColumn("sketch", F.lit(True)).unionByName(merged.withColumn("sketch", F.lit(False)))
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", text string" * keep_text
    return named_back(B.with_answers(own, answers, left, schema + kept_schema(docs, keep)), keep)
