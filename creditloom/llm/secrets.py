"""Secret spans: three fixed patterns, and strings that a tokenizer finds costly.

A vocabulary learnt from text spends few tokens on words and names, and many
on random strings: a long run of key characters with few characters a token is
reported as kind ``token``. Known digests (hexadecimal of a digest's length,
UUIDs) and identifiers (words joined by case, ``_``, ``-`` or ``/``, numbers)
are no secrets by themselves; whether letters are words is asked of the
tokenizer as well, so keys of one letter case are none. Spans of the fixed
patterns stay as they are; a costly string is added where it overlaps none of
them.

Rows: null text is read as empty; rows without spans give an empty list;
repeated rows and equal ids give a row each; other columns are not read. All
patterns take time linear in the text.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from creditloom.llm.common import doc_columns, slices, texts_of, tokenizer_path

#: Kinds in their order, and the patterns of the first three.
KINDS = ("assign", "access", "hex", "token")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}

#: Characters of a part that is judged by its tokens: fewer are too few for a ratio to tell keys from names.
LEAST_RUN = 16
RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST_RUN},}}")
_PART = re.compile(r"[A-Za-z0-9]+")
DIGEST_CHARS = {32, 40, 48, 56, 64, 96, 128}
_HEX_ONLY = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
#: Parts of an identifier: words in one case or capitalised, or short numbers.
#: Possessive and atomic throughout, so that a run is read once whatever it holds.
_IDENTIFIER = re.compile(r"(?:[+/_=-]*+(?:[A-Z]?[a-z]++|(?>[A-Z]+(?![a-z]))|[0-9]{1,4}+(?![0-9])))++[+/_=-]*+")
_WORDS = re.compile(r"[A-Z]?[a-z]{3,}|[A-Z]{3,}")
#: Ordinary words take about three characters a token or more, random strings under two.
CHARS_PER_TOKEN = 2.0
#: The same for the letters of an identifier, read in lower case: names are often in capitals, which a vocabulary of text knows badly.
WORD_CHARS_PER_TOKEN = 2.25

_ENCODINGS: dict = {}


def _encoding(path: str):
    if path not in _ENCODINGS:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODINGS[path] = tiktoken.Encoding("secrets", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def is_known(run: str) -> bool:
    """A digest, a UUID or a number."""
    return run.isdigit() or _UUID.fullmatch(run) is not None or (len(run) in DIGEST_CHARS and _HEX_ONLY.fullmatch(run) is not None)


def is_identifier(run: str, encoding) -> bool:
    """An identifier made mostly of words, by its shape and by the tokens of its words (inside or at the start of a text)."""
    words = [w.lower() for w in _WORDS.findall(run)]
    letters = sum(map(len, words))
    if 2 * letters < len(run) or _IDENTIFIER.fullmatch(run) is None:
        return False
    return letters >= WORD_CHARS_PER_TOKEN * sum(min(len(encoding.encode_ordinary(w)), len(encoding.encode_ordinary(" " + w))) for w in words)


def base_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    found = []
    if ":" in text or "=" in text:
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    for start, end in runs:  # a hexadecimal run lies inside one run of key characters
        found += [("hex", *m.span()) for m in HEX.finditer(text, start, end) if m.end() - m.start() >= LEAST["hex"]]
    return found


def uncovered(start: int, end: int, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """What the ``taken`` spans (in order) leave of a span."""
    for s, e in taken:
        if e <= start:
            continue
        if s >= end:
            break
        if s > start:
            yield start, s
        start = max(start, e)
    if start < end:
        yield start, end


def is_secret(run: str, encoding, chars_per_token: float = CHARS_PER_TOKEN) -> bool:
    """Few characters a token, and neither a known kind of string nor an identifier."""
    if len(run) < LEAST_RUN or is_known(run):
        return False
    return len(run) < chars_per_token * len(encoding.encode_ordinary(run)) and not is_identifier(run, encoding)


def secret_spans(text: str, encoding, chars_per_token: float = CHARS_PER_TOKEN) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then by kind as listed.

    A run of key characters outside the base spans is judged whole, and, if it passes, part by
    part between its separators, so that words joined to a key do not hide it.
    """
    runs = [m.span() for m in RUN.finditer(text)]
    found = base_spans(text, runs)
    taken = sorted((s, e) for _, s, e in found)
    for run in runs:
        for start, end in uncovered(*run, taken) if taken else (run,):
            if end - start < LEAST_RUN or is_known(text[start:end]):
                continue
            if is_secret(text[start:end], encoding, chars_per_token):
                found.append(("token", start, end))
            else:
                parts = [m.span() for m in _PART.finditer(text, start, end)]
                found += [("token", a, b) for a, b in parts if (a, b) != (start, end) and is_secret(text[a:b], encoding, chars_per_token)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def find_secrets(docs: DataFrame, path: str | None = None, chars_per_token: float = CHARS_PER_TOKEN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): spans is an array of (kind, start, end). A map over the scan, without a shuffle."""
    path = path or tokenizer_path("byte_bpe_50k.tiktoken")
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(path)
        for batch in slices(batches):
            spans = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in secret_spans(t, encoding, chars_per_token)] for t in texts_of(batch.column("text"))]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "spans": pa.array(spans, pa.list_(span))})

    return doc_columns(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint>>")
