"""Queries that tools and briefs are made of."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartolina.functions.text import bare_name, estimated_tokens, plural, short_sha

FIND_MOST, LIST_MOST = 30, 50
BRIEF_TOKENS = 4000
CAPS = {"hubs": 5, "neighborhoods": 6, "modules": 5, "exports": 8}


def find_symbol(symbols: DataFrame, modules: DataFrame, query: str, exact: bool = False, repo: str | None = None, most: int = FIND_MOST) -> DataFrame:
    """Symbols of that full or bare name; unless there are any, those whose name contains it in any case. With the total number of matches."""
    own = symbols if repo is None else symbols.where(F.col("repo") == repo)
    same = (F.col("name") == query) | (bare_name(F.col("name")) == query)
    like = F.lower("name").contains(query.lower())
    hits = own.where(same if exact else same | like).withColumn("exact", same)
    told = hits.agg(F.max("exact").alias("any_exact"), F.sum(F.col("exact").cast("long")).alias("n_exact"), F.count("*").alias("n"))
    kept = hits.join(F.broadcast(told)).where("exact or not any_exact")
    paths = modules.select(F.col("id").alias("module"), "path").distinct()
    kept = kept.join(paths, "module", "left").withColumn("path", F.coalesce("path", "module"))
    return kept.select("exact", "repo", "id", "name", "kind", "path", "line", F.when(F.col("any_exact"), F.col("n_exact")).otherwise(F.col("n")).alias("matches")).orderBy(F.desc("exact"), "repo", "path", "line", "id").limit(most)


def match_modules(modules: DataFrame, query: str, repo: str | None = None) -> DataFrame:
    own = modules if repo is None else modules.where(F.col("repo") == repo)
    return own.where((F.col("id") == query) | (F.col("path") == query) | F.col("path").endswith(query))


def module_info(symbols: DataFrame, edges: DataFrame, module: str, most: int = LIST_MOST) -> DataFrame:
    """list, item, other, line, total: a module's symbols, imports, importers, calls out and calls in, at most so many of each."""
    inside = symbols.where(F.col("module") == module)
    ids = inside.select("id").distinct()
    calls = edges.where("kind = 'calls'")
    ends = lambda c: ids.select(F.col("id").alias(c))
    nothing = F.lit(None).cast("int")
    lists = {
        "symbols": inside.select(F.col("id").alias("item"), F.col("name").alias("other"), "line"),
        "imports": edges.where((F.col("kind") == "imports") & (F.col("from") == module)).select(F.col("to").alias("item"), F.col("confidence").alias("other"), nothing.alias("line")),
        "importedBy": edges.where((F.col("kind") == "imports") & (F.col("to") == module)).select(F.col("from").alias("item"), F.col("confidence").alias("other"), nothing.alias("line")),
        "callsOut": calls.join(ends("from"), "from", "left_semi").join(ends("to"), "to", "left_anti").select(F.col("from").alias("item"), F.col("to").alias("other"), nothing.alias("line")),
        "callsIn": calls.join(ends("to"), "to", "left_semi").join(ends("from"), "from", "left_anti").select(F.col("from").alias("item"), F.col("to").alias("other"), nothing.alias("line")),
    }
    out = None
    for name, rows in lists.items():
        rows = rows.select(F.lit(name).alias("list"), "item", "other", "line")
        out = rows if out is None else out.unionByName(rows)
    return top_of_lists(out, ["list"], ["line", "item", "other"], most)


def top_of_lists(rows: DataFrame, keys: list[str], order: list, most: int) -> DataFrame:
    """The first `most` rows of each list, with the list's total; the rank limits each task's rows before the shuffle."""
    totals = rows.groupBy(*keys).agg(F.count("*").alias("total"))
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= most).drop("_rank")
    return ranked.join(totals, keys)


def _named(rows: DataFrame, keys: list[str], name, order: list, most: int, overflow: bool = True):
    """text: names in order, joined by commas, with how many more there are."""
    told = top_of_lists(rows.withColumn("_name", name), keys, order, most)
    told = told.withColumn("_key", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    listed = told.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_key", "_name"))).alias("l"), F.first("total").alias("total"))
    more = F.when((F.col("total") > most) & F.lit(overflow), F.concat(F.lit(", +"), (F.col("total") - most).cast("string"), F.lit(" more"))).otherwise("")
    return listed.select(*keys, F.concat(F.array_join(F.transform("l", lambda x: x["_name"]), ", "), more).alias("text"))


def brief_lists(repos: DataFrame, modules: DataFrame, symbols: DataFrame) -> list[tuple[str, DataFrame]]:
    """The lists of a brief by title, each with one row a repository that has any: repo, text.

    Hubs with their links; neighbourhoods, where there are several, with their sizes; the largest modules with their symbols; the
    exported symbols that are referred to most, with kind, path and line. Ties go by Unicode collation.
    """
    collated = lambda c: F.collate(F.col(c), "UNICODE")
    labels = repos.select("repo", F.explode("neighborhoodLabels").alias("k", "label")).select("repo", F.col("k").cast("int").alias("neighborhood"), "label")
    sizes = modules.where("neighborhood is not null").groupBy("repo", "neighborhood").agg(F.count("*").alias("n"))
    sizes = sizes.join(repos.where("neighborhoodLabels is not null").select("repo"), "repo", "left_semi").join(labels, ["repo", "neighborhood"], "left")
    sizes = sizes.withColumn("label", F.coalesce("label", F.concat(F.lit("#"), F.col("neighborhood").cast("string"))))
    several = sizes.groupBy("repo").count().where("count > 1").select("repo")
    paths = modules.select(F.col("id").alias("module"), "path").distinct()
    exported = symbols.where("exported").join(paths, "module", "left").withColumn("_refs", F.coalesce("refCount", F.lit(0)))
    said = lambda *parts: F.concat(*(F.col(p[1:]).cast("string") if p.startswith("$") else F.lit(p) for p in parts))
    place = F.concat(F.coalesce("path", "module"), F.lit(":"), F.col("line").cast("string"))
    hubs = modules.where("hub").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return [
        ("hubs", _named(hubs, ["repo"], said("$path", " (", "$degree", " links)"), [F.desc("degree"), collated("path")], CAPS["hubs"])),
        ("neighborhoods", _named(sizes.join(several, "repo", "left_semi"), ["repo"], said("$label", " (", "$n", ")"), [F.desc("n"), collated("label")], CAPS["neighborhoods"])),
        ("largest modules", _named(modules, ["repo"], said("$path", " (", "$symbolCount", ")"), [F.desc("symbolCount"), collated("path")], CAPS["modules"], False)),
        ("key exports", _named(exported, ["repo"], F.concat(said("$name", " [", "$kind", "] "), place), [F.desc("_refs"), collated("name"), collated("id")], CAPS["exports"])),
    ]


#: What is said of each list behind its title.
_NOTES = {"hubs": " (widest reach of a change)", "neighborhoods": " (by imports and calls, not by folder)", "largest modules": "", "key exports": " (by references)"}


def brief(
    repos: DataFrame, modules: DataFrame, symbols: DataFrame, group: str = "group", budget: int = BRIEF_TOKENS, stale: list[str] | None = None, repo: str | None = None
) -> DataFrame:
    """text, level, omitted: a summary of all repositories, or of one, at the most detailed of five levels that fits the budget; the first always does.

    repos: repo, language, neighborhoodLabels, generatedAt, commit, dirty. Level 1 has totals and a line for each repository with its commit,
    whether its tree was changed, and its languages; levels 2 to 5 add one list of brief_lists each. stale: repositories whose source has changed since.
    """
    if repo is not None:
        repos, modules, symbols = (rows.where(F.col("repo") == repo) for rows in (repos, modules, symbols))
    collated = lambda c: F.collate(F.col(c), "UNICODE")
    tally = lambda rows, name: rows.groupBy("repo").agg(F.count("*").alias(name))
    counts = repos.select("repo").join(tally(modules, "m"), "repo", "left").join(tally(symbols, "s"), "repo", "left").na.fill(0)
    changed = F.when(F.coalesce(F.col("dirty"), F.lit(False)), " (dirty)").otherwise("")
    commit = F.when(F.col("commit").isNotNull(), F.concat(F.lit(" @ "), short_sha(F.col("commit")), changed)).otherwise("")
    languages = F.when(F.size("language") > 0, F.array_join("language", ", ")).otherwise("no supported files")
    own = F.concat(F.lit("## "), F.col("repo"), commit, F.lit(" ("), languages, F.lit("): "), plural(F.col("m"), "module"), F.lit(", "), plural(F.col("s"), "symbol"))
    lines = repos.join(counts, "repo").select("repo", own.alias("text"), F.lit(1).alias("level"))
    titles = []
    for i, (title, rows) in enumerate(brief_lists(repos, modules, symbols), 2):
        titles.append(title)
        lines = lines.unionByName(rows.select("repo", F.concat(F.lit(f"{title}{_NOTES[title]}: "), "text").alias("text"), F.lit(i).alias("level")))
    sums = counts.agg(F.count("*").alias("r"), F.coalesce(F.sum("m"), F.lit(0)).alias("m"), F.coalesce(F.sum("s"), F.lit(0)).alias("s"))
    named = F.array_sort(F.collect_list(F.when(F.col("repo").isin(stale), F.col("repo")))) if stale else F.array().cast("array<string>")
    top = sums.join(repos.agg(F.coalesce(F.max(F.col("generatedAt").cast("string")), F.lit("unknown")).alias("at"), named.alias("stale")))
    warning = F.when(
        F.size("stale") > 0,
        F.concat(F.lit("WARNING: the map is stale for "), F.array_join("stale", ", "), F.lit("; files and lines may be wrong. Make it again with: extract --if-stale")),
    )
    start = F.concat(plural(F.col("r"), "repo"), F.lit(", "), F.col("m").cast("string"), F.lit(" modules, "), F.col("s").cast("string"), F.lit(" symbols. Extracted "), F.col("at"), F.lit("."))
    caveat = "Edges tell how sure they are (exact, resolved, inferred); an inferred one is a guess. refCount counts names: 0 means that the indexed code has none, not that code is dead."
    levels = repos.sparkSession.range(1, 6).select(F.col("id").cast("int").alias("depth"))  # five rows
    shown = lines.join(F.broadcast(levels), F.col("level") <= F.col("depth"))
    sections = shown.groupBy("depth", "repo").agg(F.array_sort(F.collect_list(F.struct("level", "text"))).alias("l"))
    sections = sections.select("depth", F.struct(collated("repo").alias("c"), F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("text")).alias("x"))
    told = levels.join(sections.groupBy("depth").agg(F.array_sort(F.collect_list("x")).alias("l")), "depth", "left")
    omitted = F.slice(F.array(*map(F.lit, titles)), F.col("depth"), 4)
    note = F.when(F.size(omitted) > 0, F.concat(F.lit("(left out to fit the budget: "), F.array_join(omitted, ", "), F.lit("; a larger --budget includes them)")))
    bodies = F.array_join(F.transform(F.coalesce("l", F.array()), lambda x: x["text"]), "\n\n")
    deeper = F.lit("More: scope --symbol <name> or --trace <file> ranks what lies around a symptom.")
    text = F.concat(F.concat_ws("\n\n", F.lit(f"# {group}: architecture brief"), start, warning, F.lit(caveat), F.nullif(bodies, F.lit("")), note, deeper), F.lit("\n"))
    full = told.join(F.broadcast(top)).select("depth", text.alias("text"), omitted.alias("omitted"))  # one row
    fits = (estimated_tokens(F.col("text")) <= budget) | (F.col("depth") == 1)
    return full.where(fits).orderBy(F.desc("depth")).limit(1).select("text", F.col("depth").alias("level"), "omitted")
