import random
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from creditloom.llm import blocks, suffixes
from tests.llm import brute


@pytest.fixture
def small(monkeypatch, spark):
    """Chunks of 2,000 bytes, batches of several, and shards of few segments."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    monkeypatch.setattr(blocks, "BATCHES", 2)
    monkeypatch.setattr(blocks, "chunked", partial(blocks.chunked, bytes_per_chunk=2000))
    monkeypatch.setattr(suffixes, "SEGMENTS", 500)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_byte_strings_over_batches_of_chunks_equal_brute_force(small, docs, rows):
    want = brute.repeats(rows, 50, lambda t: [bytes([b]) for b in (t or "").encode()], b"".join)
    got = [tuple(r) for r in suffixes.remove_repeats(docs).collect()]
    assert sorted(got) == sorted(want)


def test_chunks_of_a_large_input_send_together(small, docs):
    dealt, total = blocks.chunked(docs.select("doc_id", "text"), batched=True)
    found = dealt.agg(F.count_distinct("part"), F.count_distinct("chunk"), F.max("part")).first()
    assert total > 20 * 2000 and found[0] > 20 and found[1] <= -(-(found[2] + 1) // 7)
    by = dealt.groupBy("part").agg(F.count_distinct("chunk").alias("n")).collect()
    assert {r["n"] for r in by} == {1}


def shard(seed=3):
    r = random.Random(seed)
    grams = [bytes(r.choice(b"abcd") for _ in range(24)) for _ in range(4)]
    packed = []
    for b in range(3):
        rows = []
        for _ in range(150):
            left = r.randrange(0, 27)
            before, after = (bytes(r.choice(b"xy") if r.random() < 0.1 else 120 for _ in range(n)) for n in (left, r.randrange(26 - left, 27)))
            rows.append((before + r.choice(grams) + after, left, r.randrange(9), r.choice([0, 2])))
        text, left, doc, flags = zip(*rows, strict=True)
        known, index = np.unique(doc, return_inverse=True)
        packed.append(blocks.pack(np.frombuffer(b"".join(text), np.uint8), *(np.array(x, np.uint8) for x in ([len(t) for t in text], left, flags)), index.astype(np.uint16), known))
    return suffixes.Shard(packed, b"")


def told(s):
    n, begin, docs = s.answers(50, 24)
    return [docs[b : b + k].tolist() for b, k in zip(begin.tolist(), n.tolist(), strict=True)]


def test_a_shard_tells_the_smallest_document_of_each_window(monkeypatch):
    s = shard()
    text = [s.data[a : a + n].tobytes() for a, n in zip(s.start, s.size, strict=True)]
    least: dict[tuple[bytes, int], int] = {}
    windows = [[(t[i : i + 50], int(a) - i) for i in range(len(t) - 49)] for t, a in zip(text, s.left, strict=True)]
    for own, doc in zip(windows, s.doc.tolist(), strict=True):
        for w in own:
            least[w] = min(doc, least.get(w, doc))
    got = told(s)
    for own, doc, flags, found in zip(windows, s.doc.tolist(), s.flags.tolist(), got, strict=True):
        want = [least[w] for w in own]
        assert found == want if found else flags < 2 and min(want) >= doc
    # a few grams at a time, and classes whose hashes are all equal
    monkeypatch.setattr(suffixes, "SEGMENTS", 10)
    assert told(s) == got
    monkeypatch.setattr(suffixes.B, "mix", lambda x, salt=0: x & np.uint64(0))
    assert told(s) == got


def test_a_block_packs_with_a_sample_read_once(monkeypatch):
    import zstandard

    made, real = [], zstandard.ZstdCompressionDict
    monkeypatch.setattr(zstandard, "ZstdCompressionDict", lambda *a, **b: made.append(1) or real(*a, **b))
    like = b"the night, the river and the green light " * 99
    packed = [blocks.pack(np.frombuffer(like[i : i + 80], np.uint8), like=like) for i in range(20)]
    assert [blocks.unpack(p, like)[0].tobytes() for p in packed] == [like[i : i + 80] for i in range(20)]
    assert len(made) <= 2
