"""The registered queries of the training-text operators, and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.llm import align, bpe, lexical, lm, neardup, packing, pii, quality, secrets, substrings, suffixes, topk, toxicity
from creditloom.llm.common import read_table
from creditloom.session import ensure_defaults


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_defaults(spark)
    coded = bpe.encode_documents(read_table(spark, sf_dir, "documents"), decode=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_defaults(spark)
    return quality.judge_quality(read_table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_defaults(spark)
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_defaults(spark)
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, ~toxicity.held_out())
    scored = toxicity.score_documents(docs, model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_defaults(spark)
    found = secrets.find_secrets(read_table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != "token")

    def number(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select("doc_id", *map(number, ("assign", "access", "hex")), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_defaults(spark)
    return substrings.remove_repeats(read_table(spark, sf_dir, "documents"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_defaults(spark)
    return neardup.near_duplicates(read_table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_defaults(spark)
    return pii.pseudonymise(read_table(spark, sf_dir, "documents"))


def op9_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_defaults(spark)
    return suffixes.remove_repeats(read_table(spark, sf_dir, "documents"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_defaults(spark)
    vectors = topk.integer_vectors(read_table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0)


def op11_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_defaults(spark)
    return lm.score_documents(read_table(spark, sf_dir, "documents"))


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_defaults(spark)
    return align.align_documents(read_table(spark, sf_dir, "documents"))


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_defaults(spark)
    return lexical.Index(read_table(spark, sf_dir, "documents")).search(read_table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_bpe, op2_quality, op3_packing, op4_toxicity, op5_secrets, op6_substrings, op7_minhash, op8_pii, op9_suffixes, op10_topk, op11_lm, op12_align, op13_lexical, pipeline)}

ORACLE = {
    "op13_lexical": lexical.oracle_sql(),
    "op6_substrings": substrings.oracle_sql(),
    "op10_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
            FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
        ), ranked AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
        )
        SELECT * FROM ranked WHERE rank <= 5
    """,
}
