import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from creditloom.llm import neardup, queries, topk, toxicity

SF = "/root/testdata/sf0.001"


def test_top_k_equals_brute_force(spark):
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in r.normal(size=8) * 0.3]) for i in range(300)]
    rows += [(i, rows[0][1]) for i in range(300, 420)]  # ties
    odd = [(1000, None), (1001, []), (1002, [1.0, None]), (1003, [float("nan")] * 8), (1004, [float("inf")] * 8), (None, rows[1][1]), (1050, [0.5, 0.5])]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows + odd], "vec_id bigint, embedding array<double>, ring string").repartition(5)
    got = sorted(tuple(x) for x in topk.top_k(topk.integer_vectors(table), F.col("vec_id") % 50 == 0, block=3, sample=50, pivots=4).collect())
    whole = {i: np.pad(np.floor(256 * np.asarray(v)), (0, 8 - len(v))) for i, v in [*rows, odd[-1]]}
    want = []
    for q in (i for i in whole if i % 50 == 0):
        best = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)
    assert topk.top_k(topk.integer_vectors(table.limit(0)), F.lit(True)).collect() == []


def test_toxicity_on_the_held_out_fold(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("aeioutnsrl") for _ in range(r.randrange(3, 8)))
    rows, labels = [], []
    for i in range(900):
        bad = i % 6 == 0
        words = [word() for _ in range(60)] + (["blarg" + word() for _ in range(3)] if bad else [])
        r.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame([*rows, (2000, None), (2001, "")], "doc_id bigint, text string")
    table = spark.createDataFrame([*labels, (5000, 1), (None, 1), (3, None)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, table, ~toxicity.held_out())
    found = {x["doc_id"]: (x["score"], x["held"]) for x in toxicity.score_documents(docs, model).withColumn("held", toxicity.held_out()).collect()}
    tested = [(i, y) for i, y in labels if found[i][1]]
    assert len(tested) > 200 and all((found[i][0] >= toxicity.THRESHOLD) == bool(y) for i, y in tested)
    assert found[2000][0] == found[2001][0] < 0.5
    alone = toxicity.fit(docs, table.limit(0), F.lit(True))
    assert all(0 <= x["score"] <= 1 for x in toxicity.score_documents(docs, alone).collect())


def test_toxicity_counts_a_repeated_id_once(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)] + [(3, f"another {k}") for k in range(500)] + [(4, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id bigint, toxic int")
    sizes, plain = [], toxicity._hits
    monkeypatch.setattr(toxicity, "_hits", lambda own, *rest: sizes.append(sorted((r["doc_id"], r["text"]) for r in own.collect())) or plain(own, *rest))
    toxicity.fit(docs, labels, F.lit(True))
    assert sizes == [[(i, "another 0" if i == 3 else f"text {i}") for i in range(20)]]


def test_label_model_learns_accuracy_and_correlation():
    r = np.random.default_rng(8)
    y = r.random(4000) < 0.2
    good, copy = (r.random(4000) < np.where(y, 0.7, 0.01)), None
    copy = good.copy()
    poor = r.random(4000) < np.where(y, 0.3, 0.25)
    post, fires, corr, share = toxicity.label_model(np.stack([good, copy, poor], axis=1).astype(float), np.where(r.random(4000) < 0.1, ~y, y).astype(float))
    assert fires[1, 0] > 0.5 > fires[0, 0] and abs(fires[1, 2] - fires[0, 2]) < 0.15
    assert corr[0, 1] > 0.9 and abs(corr[0, 2]) < 0.2 and abs(share - 0.2) < 0.1
    assert np.mean((post > 0.5) == y) > 0.85


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(200, 200), (301, 300)]
    got = {r["node"]: r["root"] for r in neardup.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 130)} | {301: 300}


def test_queries_that_sql_can_express(spark):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for name, sql in queries.ORACLE.items():
        got = queries.QUERIES[name](spark, SF)
        want = con.execute(sql)
        columns = sorted(got.columns)
        names = [d[0] for d in want.description]
        assert sorted(names) == columns
        plain = sorted(tuple(dict(zip(names, r, strict=True))[c] for c in columns) for r in want.fetchall())
        assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == plain, name


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"] for r in docs.collect()}
        docs = stage(spark, docs, SF)
        assert docs.columns == list(corpus_pipeline.COLUMNS), name
        after = {r["doc_id"] for r in docs.collect()}
        assert after <= before and len(after) >= 0.7 * len(before), name
        if name in ("suffix_array", "pii"):
            assert after == before
    packed = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in packed} == after <= known.keys()


def test_pipeline_takes_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "some words here", "en", None, 15), (3, "some words here", "en", None, 15), (None, "other text", None, "s", 10)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 5
