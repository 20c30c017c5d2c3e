"""From source trees to a graph: parse, resolve, analyse, lay out, write."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolina import schema as S
from cartolina.functions.text import bare_name, module_of
from cartolina.operators import graph, layout, resolve, tools, upkeep
from cartolina.sources import tree
from cartolina.sources.languages import BY_EXT, ORDER
from cartolina.sources.scan import Parsed, parse

#: Rows of all kinds that parsing a file gives; `seq` orders them by language, file and place.
_ROW = "tag string, repo string, engine string, seq long, module string, rel string, name string, kind string, line int, exported boolean, parent string, other string, how string, priority int, n long"
_FIELDS = [f.split()[0] for f in _ROW.split(", ")]


def _parsed(go_modules: dict[str, str | None]):
    def rows(repo: str, rel: str, file_seq: int, content: bytes) -> Iterator[dict]:
        text = content.decode("utf-8", "replace")
        lang = BY_EXT[rel.rpartition(".")[2]].name
        module = f"{repo}:{rel}"
        try:
            p = parse(rel, text, go_modules.get(repo))
        except Exception:  # noqa: BLE001  one unreadable file must not end the job: its module stays, empty
            p = Parsed()
        base = dict.fromkeys(_FIELDS) | {"repo": repo, "engine": lang, "module": module, "rel": rel}
        seq = (ORDER[lang] << 52) | (file_seq << 24)
        yield base | {"tag": "module", "seq": seq, "line": text.count("\n") + 1, "n": len(p.symbols)}
        ident = lambda name: f"{module}:{name}" if name else None
        for i, (name, kind, line, exported, parent) in enumerate(p.symbols):
            yield base | {"tag": "symbol", "seq": seq + i, "name": name, "kind": kind, "line": line, "exported": exported, "parent": ident(parent)}
        for i, (owner, callee) in enumerate(p.calls):
            yield base | {"tag": "call", "seq": seq + i, "name": ident(owner) or module, "other": callee}
        for i, (owner, target, kind) in enumerate(p.bases):
            yield base | {"tag": "base", "seq": seq + i, "name": ident(owner), "other": target, "kind": kind}
        for i, (spec, options) in enumerate(p.imports.items()):
            yield base | {"tag": "import", "seq": seq + i, "other": spec}
            for k, (how, path) in enumerate(options):
                yield base | {"tag": "option", "seq": seq + i, "other": spec, "name": path, "how": how, "priority": k}
        for name, n in sorted(p.idents.items()):
            yield base | {"tag": "ident", "name": name, "n": n}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [r for f in batch.itertuples() for r in rows(f.repo, f.rel, f.seq, f.content)]
            frame = pd.DataFrame(out, columns=_FIELDS)
            yield frame.astype({"seq": "Int64", "line": "Int32", "priority": "Int32", "n": "Int64"})

    return run


def code_imports(rows: DataFrame) -> DataFrame:
    """Import edges: candidates become paths by equality joins, the first that exists is the target."""
    files = rows.where("tag = 'module'").select("repo", "engine", "rel", "module", "seq")
    options = rows.where("tag = 'option'").select("repo", "engine", F.col("module").alias("from"), F.col("other").alias("spec"), F.col("name").alias("path"), "how", "priority")
    last = F.substring_index("path", "/", -1)
    by_name = files.withColumn("last", F.substring_index("rel", "/", -1)).withColumn("folder", F.when(F.col("rel").contains("/"), F.regexp_replace("rel", "/[^/]*$", "")).otherwise("."))
    only = by_name.groupBy("repo", "engine", "last").agg(F.count("*").alias("k"), F.min("rel").alias("rel")).where("k = 1")
    first = by_name.groupBy("repo", "engine", F.col("folder").alias("path")).agg(F.min_by("rel", "seq").alias("rel"))
    fits = (F.col("rel") == F.col("path")) | F.col("rel").endswith(F.concat(F.lit("/"), "path"))
    plain = ["repo", "from", "spec", "rel", "priority"]
    found = options.where("how = 'rel'").select("repo", "from", "spec", F.col("path").alias("rel"), "priority")
    found = found.unionByName(options.where("how = 'base'").withColumn("last", last).join(only, ["repo", "engine", "last"]).select(*plain))
    found = found.unionByName(options.where("how = 'folder'").join(first, ["repo", "engine", "path"]).select(*plain))
    ends = options.where("how = 'suffix'").withColumn("last", last).join(by_name.drop("folder"), ["repo", "engine", "last"]).where(fits)
    found = found.unionByName(ends.groupBy("repo", "from", "spec", "priority").agg(F.min_by("rel", "seq").alias("rel")).select(*plain))
    specs = rows.where("tag = 'import'").select("repo", F.col("module").alias("from"), F.col("other").alias("spec"), "seq")
    edges = resolve.import_edges(specs.drop("seq"), found, files.select("repo", "rel", "module"))
    order = specs.groupBy("repo", "from").agg(F.min("seq").alias("seq"))
    return edges.join(order, ["repo", "from"]).select("repo", "from", "to", F.lit("imports").alias("kind"), "confidence", "seq")


def build(spark: SparkSession, repos: dict[str, str], ignore: list[str] | None = None, exclude: list[str] | None = None, with_layout: bool = True) -> dict[str, DataFrame]:
    """repos, modules, symbols, edges of source trees (name: folder)."""
    files = tree.read_tree(spark, repos, ignore, exclude)
    rows = files.select("repo", "rel", "seq", "content").mapInPandas(_parsed({k: tree.go_module(v) for k, v in repos.items()}), _ROW).persist()
    modules = rows.where("tag = 'module'").select("repo", F.col("module").alias("id"), F.col("rel").alias("path"), F.col("n").cast("int").alias("symbolCount"), F.col("line").alias("loc"), "engine", "seq")
    symbols = rows.where("tag = 'symbol'").select("repo", F.concat("module", F.lit(":"), "name").alias("id"), "name", "kind", "module", "line", "exported", "parent", "engine", "seq")
    idents = rows.where("tag = 'ident'").select("repo", "engine", "name", "n")
    counts = resolve.reference_counts(symbols, idents)
    symbols = symbols.withColumn("bare", bare_name(F.col("name"))).join(counts, ["repo", "engine", "bare"], "left").withColumn("refCount", F.col("refCount").cast("int")).drop("bare").persist()
    raw = rows.where("tag = 'call'").select("repo", F.col("name").alias("from"), "module", F.col("other").alias("callee"), "seq")
    calls = resolve.resolved_calls(symbols, raw).withColumn("seq", F.lit(1 << 58).cast("long"))
    bases = rows.where("tag = 'base'").select("repo", F.col("name").alias("from"), F.col("other").alias("to"), "kind", F.lit("inferred").alias("confidence"), "seq")
    edges = code_imports(rows).unionByName(bases).unionByName(calls.select("repo", "from", "to", "kind", "confidence", "seq")).persist()
    modules = _analysed(modules, edges).persist()
    if with_layout:
        modules = _placed_modules(modules, edges)
        symbols = _placed_symbols(symbols, edges)
    info = spark.createDataFrame([(k, os.path.abspath(v), i.get("commit"), i.get("refName"), i.get("dirty")) for k, v in repos.items() for i in (tree.git_info(v),)], "repo string, root string, commit string, refName string, dirty boolean")
    languages = modules.groupBy("repo").agg(F.collect_set("engine").alias("e")).select("repo", F.filter(F.array(*(F.lit(n) for n in ORDER)), lambda x: F.array_contains("e", x)).alias("language"))
    named = modules.where("neighborhoodLabel is not null").groupBy("repo").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct(F.col("neighborhood").cast("string"), "neighborhoodLabel")))).alias("neighborhoodLabels"))
    prints = upkeep.fingerprints(files)
    out = info.join(languages, "repo", "left").join(named, "repo", "left").join(prints, "repo", "left").withColumns({"schemaVersion": F.lit(S.SCHEMA_VERSION), "generatedAt": F.lit(time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()))})
    return {"repos": out, "modules": modules.drop("neighborhoodLabel"), "symbols": symbols, "edges": edges}


def _analysed(modules: DataFrame, edges: DataFrame) -> DataFrame:
    """Modules with neighbourhood, its label, degree and hub, from imports within the code and calls across modules."""
    inner = edges.where((F.col("kind") == "imports") & ~F.col("to").startswith("pkg:")).select("repo", "from", "to")
    crossing = edges.where("kind = 'calls'").select("repo", module_of(F.col("from")).alias("from"), module_of(F.col("to")).alias("to")).where("`from` <> `to`")
    coupled = inner.unionByName(crossing)
    parts = graph.neighborhoods(modules.select("repo", "id"), coupled)
    both = modules.join(parts, ["repo", "id"], "left")
    labels = graph.neighborhood_labels(both.select("repo", "neighborhood", "path")).withColumnRenamed("label", "neighborhoodLabel")
    around = coupled.union(coupled.select("repo", "to", "from")).where("`from` <> `to`").groupBy("repo", F.col("from").alias("id")).agg(F.countDistinct("to").alias("degree"))
    found = both.join(labels, ["repo", "neighborhood"], "left").join(around, ["repo", "id"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("int"))
    cut = found.groupBy("repo").agg(F.greatest(F.lit(float(graph.HUB_LEAST)), F.avg("degree") + graph.HUB_DEVIATIONS * F.stddev_pop("degree")).alias("_cut"))
    return found.join(F.broadcast(cut), "repo").withColumn("hub", F.col("degree") >= F.col("_cut")).drop("_cut")


def _placed_modules(modules: DataFrame, edges: DataFrame) -> DataFrame:
    several = modules.groupBy("repo").agg((F.max("neighborhood") + 1).alias("_k"))
    angle = -F.pi() / 2 + 2 * F.pi() * F.col("neighborhood") / F.col("_k")
    r = min(layout.WIDTH, layout.HEIGHT) / 4
    anchor = lambda middle, turn: F.when(F.col("_k") > 1, middle / 2 + r * turn(angle))
    nodes = modules.join(several, "repo").select("repo", "id", layout.radius_of("module", F.col("symbolCount")).alias("radius"), anchor(layout.WIDTH, F.cos).alias("ax"), anchor(layout.HEIGHT, F.sin).alias("ay"))
    links = edges.where(F.col("kind") == "imports").select("repo", "from", "to")
    return modules.join(layout.placed(nodes, links), ["repo", "id"], "left")


def _placed_symbols(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    nodes = symbols.select("module", "id", F.when(F.col("kind") == "class", 18.0).otherwise(10.0).alias("radius"), F.lit(None).cast("double").alias("ax"), F.lit(None).cast("double").alias("ay"))
    owned = symbols.where("parent is not null").select("module", F.col("id").alias("from"), F.col("parent").alias("to"))
    inner = edges.where("kind = 'calls'").select(module_of(F.col("from")).alias("module"), "from", "to").where(F.col("module") == module_of(F.col("to")))
    kin = resolve.heritage_ids(edges, symbols).select(module_of(F.col("from")).alias("module"), "from", "to").where(F.col("module") == module_of(F.col("to")))
    return symbols.join(layout.placed(nodes, owned.unionByName(inner).unionByName(kin), "module"), ["module", "id"], "left")


_SHOWN = {
    "modules": ["id", "path", "repo", "symbolCount", "loc", "neighborhood", "degree", "hub", "x", "y"],
    "symbols": ["id", "name", "kind", "module", "line", "exported", "refCount", "parent", "x", "y"],
    "edges": ["from", "to", "kind", "confidence"],
}


def write(graphs: dict[str, DataFrame], folder: str, group: str = "group") -> list[str]:
    """The tables as Parquet by repository, one <repo>.graph.json each (absent fields left out), and group.json. Documents are built by Spark, one repository a task."""
    for name, rows in graphs.items():
        rows.write.mode("overwrite").partitionBy("repo").parquet(f"{folder}/tables/{name}") if name != "repos" else rows.write.mode("overwrite").parquet(f"{folder}/tables/{name}")
    docs = graphs["repos"]
    for name, shown in _SHOWN.items():
        rows = graphs[name].groupBy("repo").agg(F.array_sort(F.collect_list(F.struct("seq", F.to_json(F.struct(*[F.col(c) for c in shown])).alias("doc")))).alias("l"))
        docs = docs.join(rows.select("repo", F.transform("l", lambda x: x["doc"]).alias(name)), "repo", "left")
    written, index = [], []
    for r in docs.toLocalIterator():
        doc = {k: v for k, v in r.asDict().items() if v is not None and k not in _SHOWN}
        doc |= {name: [json.loads(x) for x in r[name] or []] for name in _SHOWN}
        file = f"{r['repo'].replace('/', '__')}.graph.json"
        with open(os.path.join(folder, file), "w") as f:
            json.dump(doc, f, indent=2)
        written.append(file)
        index.append({k: doc.get(k) for k in ("repo", "root", "language", "generatedAt", "sourceFingerprint", "commit", "refName", "dirty") if doc.get(k) is not None} | {"graphFile": file, "moduleCount": len(doc["modules"]), "symbolCount": len(doc["symbols"])})
    with open(os.path.join(folder, "group.json"), "w") as f:
        json.dump({"schemaVersion": S.SCHEMA_VERSION, "group": group, "repos": sorted(index, key=lambda x: x["repo"]), "edges": []}, f, indent=2)
    return written


def check(spark: SparkSession, folder: str, repos: dict[str, str], ignore: list[str] | None = None) -> DataFrame:
    """repo, status, commit, refName, dirty (as they were when it was written) of a written map against the trees as they are."""
    with open(os.path.join(folder, "group.json")) as f:
        index = json.load(f)["repos"]
    kind = "repo string, sourceFingerprint string, commit string, refName string, dirty boolean"
    stored = spark.createDataFrame([tuple(r.get(k) for k in ("repo", "sourceFingerprint", "commit", "refName", "dirty")) for r in index], kind)
    found = upkeep.fingerprints(tree.read_tree(spark, repos, ignore))
    every = spark.createDataFrame([(k,) for k in repos], "repo string").join(found, "repo", "left")
    return upkeep.statuses(stored, every).join(stored.drop("sourceFingerprint"), "repo", "left")


def brief(graphs: dict[str, DataFrame], **options) -> DataFrame:
    return tools.brief(graphs["repos"], graphs["modules"], graphs["symbols"], **options)
