"""Cases of the memory findings on the training-text operators."""

import tracemalloc

import pyarrow as pa

from creditloom.llm import blocks, common, neardup, suffixes
from creditloom.llm.substrings import Words


def test_a_chunk_of_words_takes_bounded_memory():
    r = "a river of stones and old green light walks over hills at night ".split()
    texts = [" ".join(r[(i * 7 + k * k) % len(r)] + str((i * k) % 997) for k in range(400)) for i in range(600)]
    docs = blocks.Docs(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts)}))
    tracemalloc.start()
    words = Words(docs, 13)
    words.distinct(docs.ids)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(docs.bytes) > 1 << 20 and peak < 30 * len(docs.bytes)


def test_hashes_are_the_same_across_steps():
    data = blocks.np.random.default_rng(3).integers(0, 256, 3 << blocks.STEP_BITS, dtype=blocks.np.uint8)
    prefix, values = blocks.byte_prefix(data), blocks.BYTE_VALUE[data].tolist()
    edge = 1 << blocks.STEP_BITS
    for start, end in ((0, 5), (edge - 2, edge + 3), (2 * edge, 2 * edge + 9), (edge - 1, 2 * edge + 1), (7, 7)):
        expected = sum(v * pow(blocks.BASE, i, 1 << 64) for i, v in enumerate(values[start:end])) % (1 << 64)
        found = blocks.range_hashes(prefix, blocks.np.array([start]), blocks.np.array([end]))
        assert int(found[0]) == expected and (blocks.prefix_hashes(blocks.BYTE_VALUE[data]) == prefix).all()


def test_a_task_has_several_chunks(spark):
    docs = spark.createDataFrame([(i, "some words of a text " * 50) for i in range(400)], "doc_id bigint, text string")
    dealt, total = blocks.chunked(docs, bytes_per_chunk=4096)
    chunks = dealt.select("chunk").distinct().count()
    assert chunks > 60 and dealt.rdd.getNumPartitions() <= -(-total // 4096) / 3
    assert dealt.count() == 400 and total == 400 * 50 * 21


def test_turns_of_components_write_few_files(spark, monkeypatch):
    edges = [(k + 1, k) for k in range(3000) if k % 50] + [(9000 + k, 8000) for k in range(700)]
    files, write = [], neardup.cut_lineage

    def counted(df, *args):
        out = write(df, *args)
        files.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(neardup, "cut_lineage", counted)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = {x["node"]: x["root"] for x in neardup.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert max(files) <= spark.sparkContext.defaultParallelism
    assert got == {a: (8000 if a > 8000 else (a - 1) // 50 * 50 + 1) for a in {a for a, _ in edges} | {9000} if a != 8000 and (a > 8000 or (a - 1) % 50)}


def test_a_chunk_of_suffixes_keeps_no_table_as_long_as_its_text(monkeypatch):
    monkeypatch.setattr(blocks, "_POWERS", [blocks.np.ones(1, blocks.np.uint64)] * 2)
    words = [f"{w}{i * 7919 % 9973}" for i, w in enumerate("a river of stones and old green light walks".split() * 20_000)]
    docs = blocks.Docs(pa.table({"doc_id": pa.array(range(len(words) // 90), pa.int64()), "text": pa.array([" ".join(words[i : i + 90]) for i in range(0, len(words), 90)])}))
    tracemalloc.start()
    segments = suffixes.Segments(docs)
    kept = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert len(docs.bytes) > 1 << 20 and len(segments.key) and kept < 20 * len(docs.bytes)
    assert max(map(len, blocks._POWERS)) < len(docs.bytes) / 4


def test_suffix_order_is_that_of_the_bytes():
    texts = [b"xx" + b"abcd" * 6 + t for t in (b"zebra", b"zeb", b"apple", b"applet", b"")]
    order = suffixes.SuffixSort([(t, 2, i) for i, t in enumerate(texts)], 50, 24).order.tolist()
    assert order == sorted(range(len(texts)), key=lambda i: texts[i])


def test_memory_is_given_back_after_each_task(monkeypatch):
    calls = []
    monkeypatch.setattr(blocks, "give_back", lambda: calls.append(1))
    monkeypatch.setattr(common, "give_back", lambda: calls.append(2))
    table = pa.table({"text": ["a", "b"]})
    assert blocks.by_group(lambda key, t: t)((), table) is table
    assert [b.num_rows for b in common.slices(table.to_batches(), limit=1)] == [1, 1]
    assert calls == [1, 2]
    common.give_back()
