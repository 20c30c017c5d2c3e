"""From a stack trace or a name to the symbols around it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartolina.functions.text import bare_name, path_tail, trimmed
from cartolina.operators import graph
from cartolina.operators.resolve import heritage_ids
from cartolina.schema import CONFIDENCES


def parse_traces(traces: DataFrame) -> DataFrame:
    """trace_id, frame, fn, file, line from (trace_id, text): lines `at fn (path:line[:col])` or `at path:line[:col]`, in order.

    White space around a line, before its brackets and before a path doesn't matter. A frame whose place has no line keeps its name alone; one with neither
    is left out.
    """
    lines = traces.select("trace_id", F.posexplode(F.split("text", "\n")).alias("frame", "raw")).select("trace_id", "frame", trimmed(F.col("raw")).alias("raw"))
    framed = lines.where(F.col("raw").startswith("at ")).withColumn("body", trimmed(F.substring("raw", 4, (1 << 31) - 1)))
    shape = r"(?s)\A(.*?)\s*\(([^)]+)\)\z"
    named = F.col("body").rlike(shape)
    place = F.when(named, F.regexp_extract("body", shape, 2)).otherwise(F.col("body"))
    fn = F.when(named, F.nullif(trimmed(F.regexp_extract("body", shape, 1)), F.lit("")))
    told = framed.select("trace_id", "frame", fn.alias("fn"), place.alias("place"))
    spot = r"(?s)\A(.*?):([0-9]+)(?::[0-9]+)?\z"
    located = F.col("place").rlike(spot)
    file = F.when(located, trimmed(F.regexp_extract("place", spot, 1)))
    line = F.when(located, F.regexp_extract("place", spot, 2).try_cast("int"))
    return told.select("trace_id", "frame", "fn", file.alias("file"), line.alias("line")).where("fn is not null or file is not null")


def nearest_before(frames: DataFrame, decls: DataFrame, keys: list[str], at: str) -> DataFrame:
    """As-of join: each frame with the declaration of its keys at or before its place: the nearest, of equally near ones the first by seq.

    frames: frame_id, keys, at; decls: decl_id, keys, at, seq. One sorted pass over the union of both sides: no pair of a frame and an
    earlier declaration is ever formed.
    """
    none = F.lit(None)
    asked = frames.select(*keys, at, F.lit(1).alias("_side"), none.cast("long").alias("seq"), "frame_id", none.alias("decl"))
    told = F.struct(F.col("decl_id"), F.col(at).alias("decl_at"))
    sides = asked.unionByName(decls.dropna(subset=keys).select(*keys, at, F.lit(0).alias("_side"), F.col("seq").cast("long"), none.alias("frame_id"), told.alias("decl")))
    # Of declarations at one place the first is last in this order, so that it is the one that is found.
    order = Window.partitionBy(*keys).orderBy(at, "_side", F.desc("seq")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = sides.withColumn("decl", F.last("decl", ignorenulls=True).over(order)).where("_side = 1 and decl is not null")
    return found.select("frame_id", F.col("decl.decl_id").alias("decl_id"), F.col("decl.decl_at").alias("decl_at"))


def resolve_frames(frames: DataFrame, modules: DataFrame, symbols: DataFrame) -> DataFrame:
    """Each frame's symbol and confidence (none if there is none).

    By file and line the nearest declaration above, one of the frame's name first (exact, else resolved); else a symbol of that name in the file
    (resolved); else the one symbol of that name in the repository (inferred).
    """
    keyed = frames.withColumn("frame_id", F.struct("trace_id", "frame")).withColumn("tail", path_tail(F.col("file"))).withColumn("want", bare_name(F.col("fn")))
    # A module's path ends with the frame's last two segments; joining by the last one makes this an equi-join.
    base = lambda c: F.substring_index(c, "/", -1)
    paths = modules.select("id", "path", "seq", base("path").alias("base"))
    placed = keyed.withColumn("base", base("file")).join(paths, "base").where(F.col("path").endswith(F.col("tail"))).groupBy("frame_id").agg(F.max_by("id", "seq").alias("module"))
    known = keyed.join(placed, "frame_id", "left")
    decls = symbols.select(F.col("id").alias("decl_id"), "module", "line", "seq", bare_name(F.col("name")).alias("bare"))
    lined = known.where("module is not null and line is not null").select("frame_id", "module", "line", "want")
    # Two sorted passes: over the declarations of the frame's name, and over all.
    own = nearest_before(lined.withColumn("bare", F.col("want")), decls, ["module", "bare"], "line")
    above = nearest_before(lined, decls, ["module"], "line").join(own.select("frame_id", F.col("decl_id").alias("own")), "frame_id", "left")
    step1 = above.select("frame_id", F.coalesce("own", "decl_id").alias("id"), F.when(F.col("own").isNotNull(), "exact").otherwise("resolved").alias("confidence"), F.lit(1).alias("step"))
    named = known.where("want is not null")
    step2 = named.join(decls, ["module"]).where("bare = want").groupBy("frame_id").agg(F.min_by("decl_id", "seq").alias("id")).select("frame_id", "id", F.lit("resolved").alias("confidence"), F.lit(2).alias("step"))
    single = decls.groupBy("bare").agg(F.count("*").alias("n"), F.min("decl_id").alias("id")).where("n = 1")
    step3 = named.join(single, named.want == single.bare).select("frame_id", "id", F.lit("inferred").alias("confidence"), F.lit(3).alias("step"))
    best = step1.unionByName(step2).unionByName(step3).groupBy("frame_id").agg(F.min_by(F.struct("id", "confidence"), "step").alias("hit"))
    return keyed.join(best, "frame_id", "left").select("trace_id", "frame", "fn", "file", "line", F.col("hit.id").alias("id"), F.coalesce("hit.confidence", F.lit("none")).alias("confidence"))


def scope_edges(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Undirected links for scoping: symbol and class, and every edge within the code, heritage names as ids; with seq."""
    owns = symbols.where("parent is not null").select(F.col("id").alias("from"), F.col("parent").alias("to"), "seq")
    base = 1 << 40
    plain = edges.where(~F.col("to").startswith("pkg:") & ~F.col("kind").isin("extends", "implements")).select("from", "to", (F.col("seq") + base).alias("seq"))
    kin = heritage_ids(edges, symbols).select("from", "to", (F.col("seq") + base).alias("seq"))
    return owns.unionByName(plain).unionByName(kin)


def named_anchor(symbols: DataFrame, name: str) -> tuple[str | None, str]:
    """The first symbol of a bare name: inferred if it is the only one, else ambiguous."""
    hits = symbols.where((bare_name(F.col("name")) == name) | (F.col("name") == name)).orderBy("seq").limit(2).collect()
    return (hits[0]["id"], "inferred" if len(hits) == 1 else "ambiguous") if hits else (None, "none")


def suspects(modules: DataFrame, symbols: DataFrame, edges: DataFrame, anchor: str, hops: int = 2, most: int = 40, top: int = 8) -> tuple[DataFrame, bool]:
    """The nearest symbols around an anchor: id, hops, score, name, kind, line, path, unreferenced; and whether the walk was cut."""
    found, cut = graph.walk(scope_edges(symbols, edges), anchor, hops, most)
    told = graph.ranked_suspects(found).join(symbols, "id").join(modules.select(F.col("id").alias("module"), "path"), "module", "left")
    told = told.dropDuplicates(["id"]).select("id", "hops", "score", "name", "kind", "line", F.coalesce("path", "module").alias("path"), (F.col("refCount") == 0).alias("unreferenced"))
    return told.orderBy(F.desc("score"), F.collate(F.col("id"), "UNICODE")).limit(top), cut


def anchored(frames: DataFrame | None, name: str, modules: DataFrame, symbols: DataFrame) -> tuple[str | None, str]:
    """The symbol that a trace's first resolvable frame, or without frames a bare name, leads to in one repository, and how surely."""
    if frames is None:
        return named_anchor(symbols, name)
    hit = resolve_frames(frames, modules, symbols).where("id is not null").orderBy("frame").first()
    return (hit["id"], hit["confidence"]) if hit else (None, "none")


def scoped(graphs: dict[str, DataFrame], query: str, repo: str | None = None, hops: int = 2, most: int = 40, top: int = 8) -> dict:
    """What a trace or a name leads to: the surest anchor of all repositories, the earliest of equally sure ones, and the symbols around it.

    A repository is one step on the driver; there are few, and the first exact anchor ends the search. What comes back is at most `top` rows.
    """
    spark = graphs["repos"].sparkSession
    parsed = parse_traces(spark.createDataFrame([(0, query)], "trace_id int, text string"))
    frames = parsed if parsed.limit(1).count() else None
    names = [r["repo"] for r in graphs["repos"].select("repo").orderBy("repo").collect() if repo in (None, r["repo"])]
    best, where = (None, "none"), None
    for name in names:
        own = {k: v.where(F.col("repo") == name) for k, v in graphs.items()}
        found = anchored(frames, query.strip(), own["modules"], own["symbols"])
        if CONFIDENCES.index(found[1]) < CONFIDENCES.index(best[1]):
            best, where = found, name
        if best[1] == CONFIDENCES[0]:
            break
    out = {"anchor": {"query": query, "resolved": best[0], "confidence": best[1]}, "suspects": [], "truncated": False}
    if best[0] is None:
        return out
    own = {k: v.where(F.col("repo") == where) for k, v in graphs.items()}
    rows, cut = suspects(own["modules"], own["symbols"], own["edges"], best[0], hops, most, top)
    for r in rows.collect():
        reasons = ["matched the throwing frame" if r["hops"] == 0 else f"{r['hops']} hop{'s' * (r['hops'] > 1)} from the symptom"]
        reasons += ["no references found in this repo"] * bool(r["unreferenced"])
        told = {"id": r["id"], "name": r["name"], "kind": r["kind"], "file": r["path"], "line": r["line"], "hops": r["hops"], "score": r["score"], "reasons": reasons}
        out["suspects"].append(told)
    return out | {"truncated": cut, "repo": where}


def best_anchor(anchors: DataFrame) -> DataFrame:
    """Of (repo, repo_seq, id, confidence) the surest anchor; of equally sure ones the earliest repository's. An unknown confidence comes last."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, CONFIDENCES)), F.col("confidence")), F.lit(0)), F.lit(len(CONFIDENCES) + 1))
    return anchors.where("id is not null").withColumn("_rank", rank).orderBy("_rank", "repo_seq").limit(1).drop("_rank")
