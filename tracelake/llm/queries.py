"""The queries of this subpackage, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import bpe, cross_parse, knn_voronoi, line_dedup, lsh_multiprobe, merkle_manifest, mixing, pii_feistel, rule_quality, secrets_zstd, simhash, token_align, toxicity_nnpu
from tracelake.llm.common import cut, held_out, table

#: The key of the registered query; whoever runs the operator on real data passes their own.
PII_KEY = "demonstration key"

#: The scores from which on a document counts as toxic, and as good.
TOXIC, GOOD = 0.3, 0.7

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = table(spark, sf_dir, "embeddings")
    return knn_voronoi.search(data, data.where("vec_id % 100 = 0"), k=10)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity_nnpu.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity_nnpu.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary())


def op4_multiprobe_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = table(spark, sf_dir, "embeddings")
    return lsh_multiprobe.search(data, data.where("vec_id % 50 = 0"), k=5)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sizes = cut(docs.select("doc_id", "source", mixing.measure(docs).alias("size")))
    return mixing.plan(sizes).select("doc_id", "size", "source_size", "target", "taken")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = rule_quality.score(docs, rule_quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_feistel.pseudonymise(table(spark, sf_dir, "documents"), PII_KEY, keep=["doc_id"])


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_zstd.scan(table(spark, sf_dir, "documents"))


def op11_cross_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return cross_parse.predict(docs, cross_parse.fit(docs))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.query(table(spark, sf_dir, "documents"))


def op13_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.links(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


QUERIES: dict[str, Query] = {
    "op1_voronoi_knn": op1_voronoi_knn,
    "op2_toxicity": op2_toxicity,
    "op3_bpe": op3_bpe,
    "op4_multiprobe_lsh": op4_multiprobe_lsh,
    "op5_mixing": op5_mixing,
    "op6_quality": op6_quality,
    "op7_simhash": op7_simhash,
    "op8_line_dedup": op8_line_dedup,
    "op9_pii": op9_pii,
    "op10_secrets": op10_secrets,
    "op11_cross_parse": op11_cross_parse,
    "op12_merkle": op12_merkle,
    "op13_token_align": op13_token_align,
}
SQL: dict[str, str] = {
    "op1_voronoi_knn": """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, d.vec_id, list_dot_product(q.v, d.v)::BIGINT AS score FROM e q JOIN e d ON q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM p)
SELECT * FROM r WHERE rank <= 10
""",
    "op5_mixing": mixing.SQL,
    "op8_line_dedup": line_dedup.SQL,
    "op12_merkle": merkle_manifest.SQL,
}
