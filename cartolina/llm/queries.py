"""The queries op1_ to op10_ over their whole tables, and SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolina.llm import bpe, common, language_id, pii, toxicity
from cartolina.llm.exact_dedup import exact_dedup
from cartolina.llm.jaccard import jaccard_components
from cartolina.llm.license_scan import license_scan
from cartolina.llm.mixing import mix
from cartolina.llm.suffix_dedup import suffix_dedup
from cartolina.llm.topk import top_k


def _apart(parts: int, which: int):
    """Whether a document is held out: crc32 of its id as text, mod parts, is which."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(parts)) == which, F.lit(False))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~_apart(5, 0))
    told = toxicity.classify(docs, model).withColumn("held_out", _apart(5, 0))
    return told.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "language")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(common.documents(spark, sf_dir))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = suffix_dedup(common.documents(spark, sf_dir))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["e"] - x["s"])
    return told.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = pii.find_pii(common.documents(spark, sf_dir))
    base = F.filter("spans", lambda x: x["base"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")
    counts = [_of_kind(base, kind).alias(f"n_{kind}") for kind in pii.BASE]
    return told.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _of_kind(spans, kind: str):
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.documents(spark, sf_dir)).documents().select("doc_id", "size", "source_size", "target", "taken", "first_slot", "n_slots")


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Where the public vocabulary file lies; imported here, as only this operator's query needs it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(common.documents(spark, sf_dir), vocabulary())
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    models = language_id.train(docs, ~_apart(4, 2))
    return language_id.identify(docs, models).withColumn("held_out", _apart(4, 2)).select("doc_id", "held_out", "lang_pred", "score", "rejected", "entropy")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(common.documents(spark, sf_dir))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(common.documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_pii": op4_pii,
    "op5_source_mix": op5_source_mix,
    "op6_top_k": op6_top_k,
    "op7_bpe": op7_bpe,
    "op8_license_scan": op8_license_scan,
    "op9_language_id": op9_language_id,
    "op10_exact_dedup": op10_exact_dedup,
}

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op6_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS parts
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.parts, c.parts), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
        ), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op10_exact_dedup": f"""
        WITH t AS (SELECT doc_id, {_LOW} AS low FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(low) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY low)""",
}
