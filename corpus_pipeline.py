"""The corpus pipeline: language ID, exact dedup, near-duplicate dedup, source mixing, BPE.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; run() writes each stage's rows as Parquet
to shared storage and reads them again. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartolina.llm import bpe, common, language_id
from cartolina.llm.common import SPACES, WORD
from cartolina.llm.exact_dedup import exact_dedup
from cartolina.llm.jaccard import jaccard_components
from cartolina.llm.mixing import mix
from cartolina.llm.queries import vocabulary


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or unlike every language that lang names, go."""
    models = language_id.train(docs, F.lit(True))
    return language_id.accepted(docs, models)


def _free(docs: DataFrame, *names: str) -> list[str]:
    """The names, or longer ones where docs has columns of these."""
    taken = {c.lower() for c in docs.columns}
    return [next(n for n in (name + "_" * i for i in range(len(taken) + 1)) if n not in taken) for name in names]


def _keyed(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """docs with two hashes of all columns, and their names: ids may be null or repeat with another text.

    Rows are judged by the first hash. Rows that differ but share it, one pair in 2 ** 64, are told apart by the second: each of
    them stays if any of them does.
    """
    row, twin = _free(docs, "_row", "_twin")
    told = [*docs.columns, *(F.col(c).isNull() for c in docs.columns)]
    return docs.withColumns({row: F.xxhash64(*told), twin: F.xxhash64(F.lit(1), *told)}), row, twin


def _one_each(keyed: DataFrame, row: str, twin: str) -> DataFrame:
    """One of each set of equal rows."""
    (nth,) = _free(keyed, "_nth")
    return keyed.withColumn(nth, F.row_number().over(Window.partitionBy(row, twin).orderBy(row))).where(F.col(nth) == 1).drop(nth)


def _best(docs: DataFrame, keyed: DataFrame, row: str, twin: str, told: DataFrame, best: Column) -> DataFrame:
    """Of each group in told (_row, group) the row whose best, a struct that ends in _row, is chosen."""
    rows = keyed.select(F.col(row).alias("_row"), "doc_id").distinct().join(told.distinct(), "_row")
    kept = rows.groupBy("group").agg(best.alias("best")).select(F.col("best._row").alias(row)).distinct()
    return _one_each(keyed.join(kept, row, "left_semi"), row, twin).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, up to the case of A-Z, one row stays: one with the largest id, with a null id only if no other has the text.

    Each row is judged by its own text, also where ids are null or repeat.
    """
    keyed, row, twin = _keyed(docs)
    told = exact_dedup(keyed, id_col=row).select(F.col("doc_id").alias("_row"), F.unhex("text_sha256").alias("group"))
    return _best(docs, keyed, row, twin, told, F.max(F.struct(F.col("doc_id").isNotNull(), "doc_id", "_row")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts with similar five-word shingles (at least 0.8) one row stays: one with the smallest id, with a null id only if no other is in it.

    Each row is judged by its own text, also where ids are null or repeat. Of equal rows one stays.
    """
    keyed, row, twin = _keyed(docs)
    told = jaccard_components(keyed, id_col=row, k=5, percent=80).select(F.col("doc_id").alias("_row"), F.col("component_id").alias("group"))
    return _best(docs, keyed, row, twin, told, F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each row: its text as often as it is taken whole, and its first words where the last of its slots ends.

    A cut text ends with its last word taken, and n_chars is its length. Null and repeated ids do no harm.
    """
    keyed, row, twin = _keyed(docs)
    size, taken, cut = _free(keyed, "_size", "_taken", "_cut")
    told = mix(keyed, id_col=row).documents().where("taken > 0").select(F.col("doc_id").alias(row), F.col("size").alias(size), F.col("taken").alias(taken))
    both = _one_each(keyed.repartition(row), row, twin).join(told, row)  # one shuffle of the texts does for both
    whole, rest = F.floor(F.col(taken) / F.col(size)).cast("int"), (F.col(taken) % F.col(size)).cast("int")
    parts = F.explode(F.concat(F.array_repeat(F.lit(0), whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>"))))
    both = both.withColumn(cut, parts)
    words = F.regexp_extract_all("text", F.lit(f"{SPACES}*{WORD}"), F.lit(0))
    text = F.when(F.col(cut) > 0, F.array_join(F.slice(words, F.lit(1), F.greatest(F.col(cut), F.lit(1))), "")).otherwise(F.col("text"))
    both = both.withColumn("text", text)
    n_chars = F.when(F.col(cut) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return both.withColumn("n_chars", n_chars).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian 32-bit integers) and the text decoded from them."""
    return bpe.encode(docs, vocabulary())


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("source_mix", mix_sources),
    ("bpe", encode),
]

#: Trained models, components and merges are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = common.staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
