"""Name resolution: reference counts, calls, imports, and what they leave dangling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolina.functions.text import bare_name


def reference_counts(symbols: DataFrame, idents: DataFrame) -> DataFrame:
    """repo, engine, bare, refCount: identifier occurrences beyond declarations of the name, by repository and engine, never below 0."""
    declared = symbols.groupBy("repo", "engine", bare_name(F.col("name")).alias("bare")).agg(F.count("*").alias("declared"))
    used = idents.groupBy("repo", "engine", F.col("name").alias("bare")).agg(F.sum("n").alias("used"))
    count = F.greatest(F.lit(0), F.coalesce("used", F.lit(0)) - F.col("declared"))
    return declared.join(used, ["repo", "engine", "bare"], "left").select("repo", "engine", "bare", count.cast("long").alias("refCount"))


def resolved_calls(symbols: DataFrame, raw_calls: DataFrame) -> DataFrame:
    """repo, from, to, kind, confidence: calls whose name has one candidate in the caller's module, or none there and one in the repository.

    symbols: repo, id, name, module; raw_calls: repo, from, module, callee. Candidates are counted before the join, so that a common
    name costs one row, not one for each pair.
    """
    keys = F.explode(F.array_distinct(F.array(bare_name(F.col("name")), F.col("name"))))
    named = symbols.select("repo", "id", "module", keys.alias("callee"))
    here = named.groupBy("repo", "callee", "module").agg(F.count("*").alias("n_here"), F.min("id").alias("here"))
    anywhere = here.groupBy("repo", "callee").agg(F.sum("n_here").alias("n_all"), F.min("here").alias("only"))
    asked = raw_calls.select("repo", "from", "module", "callee").distinct()
    found = asked.join(anywhere, ["repo", "callee"]).join(here, ["repo", "callee", "module"], "left")
    target = F.when(F.col("n_here") == 1, F.col("here")).when(F.col("n_here").isNull() & (F.col("n_all") == 1), F.col("only"))
    edges = found.select("repo", "from", target.alias("to")).where("`to` is not null and `to` <> `from`").distinct()
    return edges.withColumns({"kind": F.lit("calls"), "confidence": F.lit("resolved")})


def import_edges(specs: DataFrame, candidates: DataFrame, files: DataFrame) -> DataFrame:
    """repo, from, to, confidence: each import's first candidate that is a known file, else its package.

    specs: repo, from, spec; candidates: repo, from, spec, rel, priority; files: repo, rel, module (an id).
    """
    hits = candidates.join(files, ["repo", "rel"]).groupBy("repo", "from", "spec").agg(F.min_by("module", "priority").alias("found"))
    out = specs.join(hits, ["repo", "from", "spec"], "left")
    return out.select("repo", "from", F.coalesce("found", F.concat(F.lit("pkg:"), F.col("spec"))).alias("to"), F.when(F.col("found").isNotNull(), "resolved").otherwise("exact").alias("confidence"))


def dangling(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """Import edges whose target is neither a package nor a known module."""
    known = modules.select("repo", F.col("id").alias("to"))
    return edges.where((F.col("kind") == "imports") & ~F.col("to").startswith("pkg:")).join(known, ["repo", "to"], "left_anti")


def heritage_ids(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """extends and implements edges with their bare targets as ids: an id stays, a name takes the last symbol of that name, others go."""
    ends = edges.where(F.col("kind").isin("extends", "implements"))
    ids = symbols.select("repo", F.col("id").alias("to"), F.lit(True).alias("_known")).distinct()
    names = symbols.groupBy("repo", F.col("name").alias("to")).agg(F.max_by("id", "seq").alias("_last"))
    both = ends.join(ids, ["repo", "to"], "left").join(names, ["repo", "to"], "left")
    return both.withColumn("to", F.when(F.col("_known"), F.col("to")).otherwise(F.col("_last"))).where("`to` is not null").drop("_known", "_last")
