"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

The tokens of a prefix are unique, so its last token is too. For every prefix
of a pre-token, an automaton lists the vocabulary entries that are suffixes of
it; the entry that encodes to itself and stays apart from the last token of
the prefix before it is *the* last token. Back-pointers then give the ids.
The work is linear in the length of a pre-token, also for very long ones.

Rows: null text is read as empty and has no tokens; repeated rows and equal
ids each give a row; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from creditloom.llm.common import doc_columns, single_threaded, slices, texts_of, tokenizer_path

NEVER = 1 << 60
#: Entries of one generation of a task's cache of encoded pieces (two are held).
CACHE_ENTRIES = 250_000
#: Pairs of tokens whose compatibility is remembered.
PAIR_ENTRIES = 500_000
#: A blank between two characters that are not white space always starts a new pre-token.
_SAFE_BLANK = re.compile("(?<=[^\\s᠎]) (?=[^\\s᠎])")
_UNSAFE = re.compile("[\\s᠎]{2}")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


#: Byte (as a Latin-1 character) to the character that stands for it.
_SHOWN = {b: c for c, b in byte_alphabet().items()}
#: Pre-tokens of pieces of plain letters, digits and marks; other pieces go to the library's own pattern.
_PLAIN_ONLY = re.compile("[\\x20-\\x7e\\n\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")
_PLAIN = re.compile("'s|'t|'re|'ve|'m|'ll|'d| ?[^\\W\\d_]+| ?[0-9]+| ?(?:[^\\s\\w]|_)+|\\s+(?!\\S)|\\s+")


class BpeModel:
    """A byte-level BPE vocabulary of the tokenizers format."""

    def __init__(self, path: str):
        import ahocorasick
        from tokenizers import pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._pre = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        self._rank: dict[int, int] = {}
        self._parts: dict[int, tuple[int, int]] = {}
        self._made: dict[int, int] = {}
        self._merged: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, c = self.vocab[left], self.vocab[right], self.vocab[left + right]
            self._rank[a << 20 | b] = rank
            self._merged[a, b] = c
            if c not in self._parts:
                self._parts[c], self._made[c] = (a, b), rank
        self._string = {i: s for s, i in self.vocab.items()}
        self._suffixes = ahocorasick.Automaton()
        for token, i in self.vocab.items():
            self._suffixes.add_word(token, (i, len(token)))
        self._suffixes.make_automaton()
        self._stands: dict[int, bool] = {}
        self._apart: dict[int, bool] = {}
        self._right: dict[int, list[tuple[int, int]]] = {}
        self._left: dict[int, list[tuple[int, int]]] = {}
        alphabet = byte_alphabet()
        size = max([*self.vocab.values(), *self.special.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for token, i in self.vocab.items():
            self.bytes[i] = bytes(alphabet[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()

    # -- pair compatibility

    def _edge(self, token: int, side: int, memo: dict[int, list[tuple[int, int]]]) -> list[tuple[int, int]]:
        """The parts at one edge of a token, each with the rank of the merge that uses it up."""
        if token not in memo:
            found, part, used = [], token, NEVER
            while True:
                found.append((part, used))
                if part not in self._parts:
                    break
                used = self._made[part]
                part = self._parts[part][side]
            memo[token] = found
        return memo[token]

    def stays_apart(self, a: int, b: int) -> bool:
        """True if no merge crosses the border when ``a`` is followed by ``b``.

        A merge of two edge parts happens only before either is used up inside
        its own token; of equal merges the one further left is first.
        """
        key = a << 20 | b
        known = self._apart.get(key)
        if known is None:
            known = True
            rank, edge = self._rank, self._edge(a, 1, self._right)
            for y, y_used in self._edge(b, 0, self._left):
                for x, x_used in edge:
                    r = rank.get(x << 20 | y)
                    if r is not None and r < x_used and r <= y_used:
                        known = False
                        break
                if not known:
                    break
            if len(self._apart) >= PAIR_ENTRIES:
                self._apart.clear()
            self._apart[key] = known
        return known

    def stands(self, token: int) -> bool:
        """True if the token's own text encodes to the token alone."""
        known = self._stands.get(token)
        if known is None:
            known = self._stands[token] = self._by_merging(self._string[token]) == [token]
        return known

    def _by_merging(self, shown: str) -> list[int]:
        ids = [self.vocab[c] for c in shown]
        while len(ids) > 1:
            best = min(zip(ids, ids[1:], strict=False), key=lambda p: self._rank.get(p[0] << 20 | p[1], NEVER))
            if best not in self._merged:
                break
            out, i = [], 0
            while i < len(ids):
                if i + 1 < len(ids) and (ids[i], ids[i + 1]) == best:
                    out.append(self._merged[best])
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    # -- encoding

    def encode_shown(self, shown: str) -> list[int]:
        """Ids of one pre-token, written in the byte alphabet."""
        whole = self.vocab.get(shown)
        if whole is not None and self.stands(whole):
            return [whole]
        last: list[int] = [-1] * (len(shown) + 1)
        back: list[int] = [0] * (len(shown) + 1)
        apart, stays, stands = self._apart, self.stays_apart, self._stands
        for end, (token, size) in self._suffixes.iter(shown):
            end += 1
            if last[end] >= 0:
                continue
            start = end - size
            ok = stands.get(token)
            if ok is None:
                ok = self.stands(token)
            if not ok:
                continue
            if start:
                before = last[start]
                ok = apart.get(before << 20 | token)
                if ok is None:
                    ok = stays(before, token)
            if ok:
                last[end], back[end] = token, start
        ids, at = [], len(shown)
        while at:
            ids.append(last[at])
            at = back[at]
        ids.reverse()
        return ids

    def pre_tokenize(self, piece: str) -> list[tuple[str, tuple[int, int]]]:
        return self._pre.pre_tokenize_str(piece)

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids, special tokens included; bytes that are not UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


class _Generations(dict):
    """A cache of bounded size: when one generation is full, the one before it is let go."""

    def __init__(self, work, entries: int):
        super().__init__()
        self._work, self._entries, self._old = work, entries, {}

    def __missing__(self, key: str) -> bytes:
        value = self._old.get(key)
        if value is None:
            value = self._work(key)
        if len(self) >= self._entries:
            self._old = dict(self)
            self.clear()
        self[key] = value
        return value


class TextEncoder:
    """Whole texts to little-endian unsigned 32-bit ids: texts are cut at blanks
    that always start a pre-token, and equal pieces are encoded once while they
    stay in the cache."""

    def __init__(self, model: BpeModel, entries: int = CACHE_ENTRIES):
        self._model, self._special = model, model.special
        self._tokens = _Generations(self._token, entries)
        self._pieces = _Generations(lambda piece: self._piece(" " + piece), entries)
        self._special_at = re.compile("(" + "|".join(map(re.escape, self._special)) + ")") if self._special else None

    def _token(self, shown: str) -> bytes:
        return np.asarray(self._model.encode_shown(shown), dtype="<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        get = self._tokens.__getitem__
        parts = _PLAIN.findall(piece) if _PLAIN_ONLY.fullmatch(piece) else None
        if parts is None:
            return b"".join([get(shown) for shown, _ in self._model.pre_tokenize(piece)])
        shown = [p.encode().decode("latin-1").translate(_SHOWN) for p in parts]
        return get(shown[0]) if len(shown) == 1 else b"".join(map(get, shown))

    def _plain(self, text: str) -> bytes:
        cut = _SAFE_BLANK.split(text) if _UNSAFE.search(text) else text.split(" ")
        return self._piece(cut[0]) + b"".join(map(self._pieces.__getitem__, cut[1:])) if cut[0] else b"".join(map(self._pieces.__getitem__, cut[1:]))

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            if self._special_at and any(s in text for s in self._special):
                parts = [p for p in self._special_at.split(text) if p]
                out.append(b"".join(np.asarray([self._special[p]], "<u4").tobytes() if p in self._special else self._plain(p) for p in parts))
            else:
                out.append(self._plain(text))
        return out


_MODELS: dict[str, tuple[BpeModel, TextEncoder]] = {}


def model_of(path: str) -> tuple[BpeModel, TextEncoder]:
    """The vocabulary at ``path``, loaded once per Python worker."""
    if path not in _MODELS:
        model = BpeModel(path)
        _MODELS[path] = model, TextEncoder(model)
    return _MODELS[path]


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids[, decoded]) of every whole text; ``ids`` are
    little-endian unsigned 32-bit numbers, ``decoded`` the text they decode to.

    A map over the scan: no shuffle, and memory bounded by a slice of texts
    and a cache of fixed size.
    """
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single_threaded()
        model, encoder = model_of(path)
        for batch in slices(batches):
            ids = encoder.encode(texts_of(batch.column("text")))
            columns = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids": pa.array(ids, pa.binary())}
            if decode:
                columns["decoded"] = pa.array([model.decode(np.frombuffer(x, "<u4").tolist()) for x in ids], pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    return doc_columns(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids binary" + ", decoded string" * decode)


def decode_documents(encoded: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of encoded documents; null ids give null text."""
    from pyspark.sql import functions as F

    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single_threaded()
        model, _ = model_of(path)
        for batch in slices(batches, text="ids"):
            text = [None if x is None else model.decode(np.frombuffer(x, "<u4").tolist()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array(text, pa.string())})

    return encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id bigint, text string")
