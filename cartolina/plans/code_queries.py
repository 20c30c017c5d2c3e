"""Queries of the parse, resolve, scope and brief stages over relational tables, with SQL twins written from the rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolina.functions import text as fn
from cartolina.operators import graph, resolve, scope, tools, upkeep
from cartolina.plans import extract


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _said(*parts: str) -> Column:
    """The parts joined; one that begins with $ is a column."""
    return F.concat(*(F.col(p[1:]).cast("string") if p.startswith("$") else F.lit(p) for p in parts))


#: What stands before and after owner and repository, so that each rule of a target is met and missed.
TARGETS = (
    ("", ""), ("https://github.com/", ".git"), ("HTTPS://WWW.GitHub.com/", "/"), ("git@github.com:", ".GIT"), ("ssh://github.com/", "/tree/main"),
    ("github.com:", "/blob/v1.2/a/b.py"), ("https://github.com/", "/tree/fix/one"), ("github.com/", "/issues/3"), ("www.github.com/", "//"),
    ("https://codes.example/", ""), ("codes.example/", ""), ("-", ""), ("a_b", ""), (" \t", " \n"), ("x/", ""), ("https://github.com/", "/tree"),
    ("https://github.com/", "/TREE/a..b"), ("git://github.com/", " x"), ("ftp+x://github.com/", ""), ("0123456789012345678901234567890123456789", ""),
)
#: Refs by the same rows: each rule of a ref on either side.
REFS = (
    "main", "-x", "/x", "x/", "x.", "x.lock", "a..b", "a//b", "a@{1}", "a b", "a~1", "a^", "a:b", "a?", "a*", "a[", "a\\b", "_x", "release/4.x", "",
)


def repo_targets(spark, sf_dir):
    """Owner, repository and ref of targets, whether they name a remote, and refs with their validity and file names."""
    rows = F.inline(F.array(*(F.struct(F.lit(i).alias("k"), F.lit(a).alias("pre"), F.lit(b).alias("post"), F.lit(r).alias("ref")) for i, ((a, b), r) in enumerate(zip(TARGETS, REFS)))))
    told = _table(spark, sf_dir, "pages").select("page_id", rows).withColumn("text", _said("$pre", "Own", "$page_id", "/re.po-", "$page_id", "$post"))
    told = told.withColumn("target", fn.repo_target(F.col("text"))).withColumn("ref", F.concat("ref", F.when(F.col("k") % 2 == 0, F.col("page_id").cast("string")).otherwise("")))
    return told.select(
        "page_id", "k", F.col("target.owner").alias("owner"), F.col("target.repo").alias("repo"), F.col("target.ref").alias("at"),
        fn.explicit_remote(F.col("text")).alias("remote"), fn.valid_ref(F.col("ref")).alias("ref_ok"), fn.ref_slug(F.col("ref")).alias("slug"),
    )


#: Lines of a trace, as %u (a user), %e (an event) and %t (its type) fill them, and what each says: name, file, line.
TRACE = (
    ("Error: x", None), ("  at %t (src/%u.ts:%e:1)", ("%t", "src/%u.ts", "%e")), ("\tat src/%u.ts:7", (None, "src/%u.ts", "7")), ("at %t(a/b%u.ts:8)", ("%t", "a/b%u.ts", "8")),
    ("at %t native", None), ("  at native %t (anonymous)\r", ("native %t", None, None)), ("at (d%u.ts:9:2)  ", (None, "d%u.ts", "9")), ("atx (e.ts:1)", None),
    ("at new  %t  ( lib/%u.ts:10:3)", ("new  %t", "lib/%u.ts", "10")), ("at %t (f.ts:1) [as g]", None), ("at async /abs/%u.ts:11:4", (None, "async /abs/%u.ts", "11")), ("at", None),
)


def _filled(text: str):
    out = F.lit(text)
    for mark, column in (("%u", "user_id"), ("%e", "event_id"), ("%t", "event_type")):
        out = F.replace(out, F.lit(mark), F.col(column).cast("string"))
    return out


def parsed_traces(spark, sf_dir):
    traces = _table(spark, sf_dir, "events").select(F.col("event_id").alias("trace_id"), _filled("\n".join(line for line, _ in TRACE)).alias("text"))
    return scope.parse_traces(traces).select("trace_id", F.col("frame").cast("long").alias("frame"), "fn", "file", F.col("line").cast("long").alias("line"))


def _sql_filled(text: str | None) -> str:
    if text is None:
        return "NULL"
    return f"replace(replace(replace('{text}', '%u', CAST(user_id AS VARCHAR)), '%e', CAST(event_id AS VARCHAR)), '%t', event_type)"


def neighborhood_labels(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    kind = F.col("p_size") % 5
    path = (
        F.when(kind == 0, _said("lib/core/", "$p_brand", "/f.ts")).when(kind == 1, F.concat(F.replace("p_type", F.lit(" "), F.lit("/")), F.lit(".ts")))
        .when(kind == 2, _said("f", "$p_partkey", ".ts")).when(kind == 3, _said("one/two/", "$p_partkey", ".ts")).otherwise(F.concat(F.when(F.col("p_partkey") % 3 == 0, "").otherwise("src/"), "p_name"))
    )
    assigned = part.select(F.col("p_brand").alias("repo"), kind.cast("int").alias("neighborhood"), path.alias("path"))
    return graph.neighborhood_labels(assigned)


def heritage_targets(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    symbols = part.select(F.col("p_brand").alias("repo"), _said("p:", "$p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_partkey").cast("long").alias("seq"))
    target = F.when(F.col("p_partkey") % 4 == 0, _said("p:", "$p_partkey")).when(F.col("p_partkey") % 4 == 1, F.col("p_name")).when(F.col("p_partkey") % 4 == 2, F.lit("Ghost")).otherwise(F.col("p_type"))
    kind = F.when(F.col("p_size") % 3 == 0, "extends").when(F.col("p_size") % 3 == 1, "implements").otherwise("calls")
    edges = part.select(F.col("p_brand").alias("repo"), _said("c:", "$p_partkey").alias("from"), target.alias("to"), kind.alias("kind"))
    return resolve.heritage_ids(edges, symbols).select("repo", "from", "to", "kind")


def frame_ladder(spark, sf_dir):
    """Events as code: a user's file declares its errors and views, purchases are frames within it, or name what one file alone declares."""
    events = _table(spark, sf_dir, "events")
    modules = events.select(_said("r:src/", "$user_id", ".ts").alias("id"), _said("src/", "$user_id", ".ts").alias("path"), F.lit(0).cast("long").alias("seq")).distinct()
    name = F.when(F.col("event_id") % 50 == 0, _said("only", "$event_id")).otherwise(_said("C.", "$event_type"))
    symbols = events.where("event_type <> 'purchase'").select(_said("s", "$event_id").alias("id"), name.alias("name"), _said("r:src/", "$user_id", ".ts").alias("module"), F.col("event_id").cast("int").alias("line"), F.col("event_id").alias("seq"))
    kind = F.col("event_id") % 7
    fn_name = F.when(kind == 0, "x.error").when(kind == 1, "nowhere").when(kind == 2, F.concat(F.lit("only"), (F.floor(F.col("event_id") / 50) * 50).cast("string"))).when(kind < 5, "error")
    file = F.when(kind == 3, "lost.ts").otherwise(_said("/home/src/", "$user_id", ".ts"))
    line = F.when(kind == 4, None).otherwise(F.col("event_id")).cast("int")
    frames = events.where("event_type = 'purchase'").select(F.col("event_id").alias("trace_id"), F.lit(0).alias("frame"), fn_name.alias("fn"), file.alias("file"), line.alias("line"))
    return scope.resolve_frames(frames, modules, symbols).select("trace_id", "id", "confidence")


def import_candidates(spark, sf_dir):
    """Imports found by path, by a path's end, by a folder's first file and by a file's one name."""
    part = _table(spark, sf_dir, "part")
    seq = F.col("p_partkey").cast("long").alias("seq")
    rel = F.when(F.col("p_size") % 2 == 0, _said("a/", "$p_brand", "/f", "$p_size", ".java")).otherwise(_said("b/g", "$p_partkey", ".java"))
    files = part.select(rel.alias("rel"), seq).groupBy("rel").agg(F.min("seq").alias("seq"))
    none = {c: F.lit(None).cast("string").alias(c) for c in ("other", "name", "how")}
    modules = files.select(F.lit("module").alias("tag"), "rel", _said("r:", "$rel").alias("module"), none["other"], none["name"], none["how"], F.lit(None).cast("int").alias("priority"), "seq")
    options = F.inline(F.array(
        *(F.struct(F.lit(spec).alias("what"), F.lit(how).alias("how"), F.lit(k).alias("priority"), path.alias("name")) for spec, how, k, path in (
            ("end", "suffix", 0, _said("$p_brand", "/f", "$p_size", ".java")), ("path", "rel", 0, _said("b/h", "$p_partkey", ".java")), ("path", "rel", 1, _said("b/g", "$p_partkey", ".java")),
            ("folder", "folder", 0, _said("a/", "$p_brand")), ("name", "base", 0, _said("g", "$p_size", ".java")), ("name", "base", 1, _said("f", "$p_size", ".java")),
        ))
    ))
    asked = part.select(_said("r:m", "$p_partkey").alias("module"), F.col("p_partkey"), seq, options).withColumn("other", F.concat(F.col("what"), F.lit("-"), F.col("p_partkey").cast("string")))
    rel_none = F.lit(None).cast("string").alias("rel")
    wanted = asked.select(F.lit("option").alias("tag"), rel_none, "module", "other", "name", "how", "priority", "seq")
    specs = asked.select(F.lit("import").alias("tag"), rel_none, "module", "other", none["name"], none["how"], F.lit(None).cast("int").alias("priority"), "seq").distinct()
    rows = modules.unionByName(wanted).unionByName(specs).withColumns({"repo": F.lit("r"), "engine": F.lit("java")})
    return extract.code_imports(rows).select("from", "to", "confidence")


def nearest_symbols(spark, sf_dir):
    """What a scope shows around one supplier: customers, suppliers, nations and regions as symbols."""
    places = {"c": ("customer", "c_custkey", "c_nationkey"), "s": ("supplier", "s_suppkey", "s_nationkey"), "n": ("nation", "n_nationkey", "n_regionkey"), "r": ("region", "r_regionkey", None)}
    above = {"c": "n", "s": "n", "n": "r"}
    symbols = edges = None
    for kind, (table, key, up) in places.items():
        rows = _table(spark, sf_dir, table)
        ident = lambda k, c: F.concat(F.lit(f"{k}:"), F.lpad(F.col(c).cast("string"), 9, "0"))
        own = rows.select(ident(kind, key).alias("id"), F.lit(kind).alias("kind"), ident(kind, key).alias("name"), F.lit("m").alias("module"), F.lit(1).alias("line"), (F.col(key) % 2).cast("int").alias("refCount"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("seq"), F.lit("r").alias("repo"))
        symbols = own if symbols is None else symbols.unionByName(own)
        if up:
            link = rows.select(F.lit("r").alias("repo"), ident(kind, key).alias("from"), ident(above[kind], up).alias("to"), F.lit("calls").alias("kind"), F.col(key).cast("long").alias("seq"))
            edges = link if edges is None else edges.unionByName(link)
    modules = spark.createDataFrame([("m", "m/a.ts")], "id string, path string")
    found, _ = scope.suspects(modules, symbols, edges, "s:000000001", hops=3, most=1_000_000, top=40)
    return found.select("id", F.col("hops").cast("long").alias("hops"), "score", "name", "kind", "path", "unreferenced")


def module_matches(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    modules = part.select(F.col("p_brand").alias("repo"), _said("r:", "$p_name", ".ts").alias("id"), _said("$p_brand", "/", "$p_name", ".ts").alias("path"))
    return tools.match_modules(modules, "e.ts")


def brief_sections(spark, sf_dir):
    """The four lists of a brief, one row a repository and list: brands are repositories, parts modules and symbols."""
    part = _table(spark, sf_dir, "part")
    modules = part.select(
        F.col("p_brand").alias("repo"), F.concat(F.lit("m"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("id"), F.concat(F.lit("m"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("path"),
        F.col("p_size").alias("symbolCount"), (F.col("p_size") % 13).alias("degree"), (F.col("p_size") > 45).alias("hub"), (F.col("p_size") % 9).alias("neighborhood"),
    )
    symbols = modules.select("repo", F.col("id").alias("module"), F.concat(F.lit("x"), "id").alias("id"), F.concat(F.lit("x"), "id").alias("name"), (F.col("symbolCount") % 2 == 0).alias("exported"), F.col("degree").alias("refCount"), F.col("symbolCount").alias("line"), F.lit("class").alias("kind"))
    labels = F.map_from_entries(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.struct(k.cast("string"), F.concat(F.lit("hood"), k.cast("string")))))
    repos = modules.select("repo").distinct().withColumn("neighborhoodLabels", labels)
    out = None
    for title, rows in tools.brief_lists(repos, modules, symbols):
        rows = rows.select("repo", F.lit(title).alias("section"), "text")
        out = rows if out is None else out.unionByName(rows)
    return out


def freshness(spark, sf_dir):
    c = _table(spark, sf_dir, "customer")
    kept = c.select(F.col("c_custkey").alias("repo"), F.col("c_mktsegment").alias("sourceFingerprint"))
    told = [upkeep.all_fresh(upkeep.statuses(a, b)).select(F.lit(i).alias("k"), "fresh") for i, (a, b) in enumerate(((kept, kept), (kept, kept.where("repo > 1")), (kept.where("repo < 0"), kept.where("repo < 0"))))]
    return told[0].unionByName(told[1]).unionByName(told[2])


QUERIES = {f.__name__: f for f in (repo_targets, parsed_traces, neighborhood_labels, heritage_targets, frame_ladder, import_candidates, nearest_symbols, module_matches, brief_sections, freshness)}


def _quoted(text: str) -> str:
    parts = [f"'{p}'" for p in text.replace("'", "''").replace("\t", "\0\t\0").replace("\n", "\0\n\0").split("\0")]
    return " || ".join({"'\t'": "chr(9)", "'\n'": "chr(10)"}.get(p, p) for p in parts)


_TARGET_ROWS = ", ".join(f"({i}, {_quoted(a)}, {_quoted(b)}, {_quoted(r)})" for i, ((a, b), r) in enumerate(zip(TARGETS, REFS)))
_TRACE_ROWS = " UNION ALL ".join(
    f"SELECT event_id AS trace_id, {i}::BIGINT AS frame, {_sql_filled(t[0])} AS fn, {_sql_filled(t[1])} AS file, CAST({_sql_filled(t[2])} AS BIGINT) AS line FROM events" for i, (_, t) in enumerate(TRACE) if t
)

ORACLE_SQL = {
    "repo_targets": rf"""
        WITH v(k, pre, post, ref) AS (VALUES {_TARGET_ROWS}),
        t AS (SELECT page_id, CAST(k AS INTEGER) AS k, pre || 'Own' || page_id || '/re.po-' || page_id || post AS text, ref || CASE WHEN k % 2 = 0 THEN CAST(page_id AS VARCHAR) ELSE '' END AS ref FROM pages, v),
        a AS (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS s FROM t),
        b AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(s, '^git@github[.]com:', '', 'i'), '^[a-z]+://', '', 'i'), '^www[.]', '', 'i') AS r FROM a),
        c AS (SELECT *, CASE WHEN regexp_matches(r, '^github[.]com[/:]', 'i') THEN regexp_replace(r, '^github[.]com[/:]', '', 'i') WHEN regexp_matches(r, '^[a-z0-9.-]+[.][a-z]{{2,}}/', 'i') THEN NULL ELSE r END AS rest FROM b),
        d AS (SELECT *, list_filter(string_split(rest, '/'), lambda x: x <> '') AS p FROM c),
        e AS (SELECT *, regexp_replace(p[2], '[.]git$', '', 'i') AS rp FROM d),
        f AS (SELECT *, coalesce(regexp_full_match(p[1], '[A-Za-z0-9]([A-Za-z0-9-]{{0,37}}[A-Za-z0-9])?') AND regexp_full_match(rp, '[A-Za-z0-9._-]{{1,100}}') AND rp NOT IN ('.', '..'), false) AS ok,
                     regexp_replace(ref, '[^A-Za-z0-9._-]+', '-', 'g') AS safe FROM e)
        SELECT page_id, k, CASE WHEN ok THEN p[1] END AS owner, CASE WHEN ok THEN rp END AS repo, CASE WHEN ok AND lower(p[3]) IN ('tree', 'blob') THEN p[4] END AS at,
               regexp_matches(s, '^([a-z][a-z0-9+.-]*://|git@github[.]com:|(www[.])?github[.]com[/:])', 'i') AS remote,
               ref <> '' AND length(ref) <= 255 AND NOT (starts_with(ref, '-') OR starts_with(ref, '/') OR suffix(ref, '/') OR suffix(ref, '.') OR suffix(ref, '.lock') OR contains(ref, '..') OR contains(ref, '//')
                   OR contains(ref, '@{{') OR regexp_matches(ref, '[\s~^:?*\[\\[:cntrl:]]')) AS ref_ok,
               CASE WHEN safe = ref THEN ref ELSE safe || '-' || substr(sha1(ref), 1, 8) END AS slug FROM f""",
    "parsed_traces": _TRACE_ROWS,
    "neighborhood_labels": """
        WITH m AS (SELECT p_brand AS repo, CAST(p_size % 5 AS INTEGER) AS neighborhood, CASE p_size % 5 WHEN 0 THEN 'lib/core/' || p_brand || '/f.ts' WHEN 1 THEN replace(p_type, ' ', '/') || '.ts'
                          WHEN 2 THEN 'f' || p_partkey || '.ts' WHEN 3 THEN 'one/two/' || p_partkey || '.ts' ELSE CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'src/' END || p_name END AS path FROM part),
        s AS (SELECT *, list_filter(string_split(CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END, '/'), lambda x: x <> '') AS dir, count(*) OVER (PARTITION BY repo, neighborhood) AS n FROM m),
        pre AS (SELECT repo, neighborhood, depth, any_value(list_slice(dir, 1, depth)) AS dir FROM s, (SELECT unnest(range(1, 9)) AS depth) WHERE len(dir) >= depth
                GROUP BY repo, neighborhood, depth HAVING count(*) = any_value(n) AND count(DISTINCT list_slice(dir, 1, depth)) = 1),
        longest AS (SELECT repo, neighborhood, arg_max(array_to_string(dir, '/'), depth) AS shared FROM pre GROUP BY ALL),
        tops AS (SELECT repo, neighborhood, coalesce(dir[1], '.') AS top, count(*) AS n FROM s GROUP BY ALL),
        best AS (SELECT repo, neighborhood, top FROM (SELECT *, row_number() OVER (PARTITION BY repo, neighborhood ORDER BY n DESC, top) AS rn FROM tops) WHERE rn = 1)
        SELECT repo, neighborhood, CASE WHEN shared IS NOT NULL THEN shared WHEN top <> '.' THEN top ELSE 'neighborhood ' || neighborhood END AS label FROM best LEFT JOIN longest USING (repo, neighborhood)""",
    "heritage_targets": """
        WITH e AS (SELECT p_brand AS repo, 'c:' || p_partkey AS "from", CASE p_partkey % 4 WHEN 0 THEN 'p:' || p_partkey WHEN 1 THEN p_name WHEN 2 THEN 'Ghost' ELSE p_type END AS target,
                          CASE p_size % 3 WHEN 0 THEN 'extends' WHEN 1 THEN 'implements' ELSE 'calls' END AS kind FROM part),
        names AS (SELECT p_brand AS repo, p_name AS target, 'p:' || arg_max(p_partkey, p_partkey) AS last FROM part GROUP BY ALL), ids AS (SELECT p_brand AS repo, 'p:' || p_partkey AS target FROM part)
        SELECT e.repo, e."from", coalesce(ids.target, last) AS "to", kind FROM e LEFT JOIN ids USING (repo, target) LEFT JOIN names USING (repo, target)
        WHERE kind <> 'calls' AND coalesce(ids.target, last) IS NOT NULL""",
    "frame_ladder": """
        WITH d AS (SELECT 's' || event_id AS id, CASE WHEN event_id % 50 = 0 THEN 'only' || event_id ELSE event_type END AS bare, user_id, event_id FROM events WHERE event_type <> 'purchase'),
        f AS (SELECT event_id, user_id, CASE event_id % 7 WHEN 0 THEN 'error' WHEN 1 THEN 'nowhere' WHEN 2 THEN 'only' || (event_id // 50 * 50) WHEN 3 THEN 'error' WHEN 4 THEN 'error' END AS bare,
                     event_id % 7 <> 3 AS placed, event_id % 7 <> 4 AS lined FROM events WHERE event_type = 'purchase'),
        above AS (SELECT f.event_id, arg_max(d.id, d.event_id) FILTER (d.bare = f.bare) AS own, arg_max(d.id, d.event_id) AS near FROM f JOIN d ON d.user_id = f.user_id AND d.event_id <= f.event_id WHERE placed AND lined GROUP BY ALL),
        inside AS (SELECT f.event_id, arg_min(d.id, d.event_id) AS id FROM f JOIN d ON d.user_id = f.user_id AND d.bare = f.bare WHERE placed GROUP BY ALL),
        single AS (SELECT bare, min(id) AS id FROM d GROUP BY bare HAVING count(*) = 1)
        SELECT f.event_id AS trace_id, coalesce(own, near, inside.id, single.id) AS id,
               CASE WHEN own IS NOT NULL THEN 'exact' WHEN near IS NOT NULL OR inside.id IS NOT NULL THEN 'resolved' WHEN single.id IS NOT NULL THEN 'inferred' ELSE 'none' END AS confidence
        FROM f LEFT JOIN above ON above.event_id = f.event_id LEFT JOIN inside ON inside.event_id = f.event_id LEFT JOIN single ON single.bare = f.bare""",
    "import_candidates": """
        WITH files AS (SELECT rel, min(p_partkey) AS seq FROM (SELECT CASE WHEN p_size % 2 = 0 THEN 'a/' || p_brand || '/f' || p_size || '.java' ELSE 'b/g' || p_partkey || '.java' END AS rel, p_partkey FROM part) GROUP BY rel),
        named AS (SELECT *, regexp_replace(rel, '^.*/', '') AS last, regexp_replace(rel, '/[^/]*$', '') AS folder FROM files),
        single AS (SELECT last, min(rel) AS rel FROM named GROUP BY last HAVING count(*) = 1), first AS (SELECT folder, arg_min(rel, seq) AS rel FROM named GROUP BY folder),
        ends AS (SELECT p_partkey, arg_min(rel, seq) AS rel FROM part JOIN named ON last = 'f' || p_size || '.java' AND (suffix(rel, '/' || p_brand || '/f' || p_size || '.java')) GROUP BY p_partkey),
        found AS (SELECT p.p_partkey, 'end' AS what, ends.rel FROM part p LEFT JOIN ends USING (p_partkey)
            UNION ALL SELECT p.p_partkey, 'path', f.rel FROM part p LEFT JOIN files f ON f.rel = 'b/g' || p_partkey || '.java'
            UNION ALL SELECT p.p_partkey, 'folder', f.rel FROM part p LEFT JOIN first f ON f.folder = 'a/' || p_brand
            UNION ALL SELECT p.p_partkey, 'name', coalesce(g.rel, f.rel) FROM part p LEFT JOIN single g ON g.last = 'g' || p_size || '.java' LEFT JOIN single f ON f.last = 'f' || p_size || '.java')
        SELECT 'r:m' || p_partkey AS "from", CASE WHEN rel IS NULL THEN 'pkg:' || what || '-' || p_partkey ELSE 'r:' || rel END AS "to", CASE WHEN rel IS NULL THEN 'exact' ELSE 'resolved' END AS confidence FROM found""",
    "nearest_symbols": """
        WITH RECURSIVE i AS (SELECT 'c:' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS id, c_custkey % 2 AS refs, 'n:' || lpad(CAST(c_nationkey AS VARCHAR), 9, '0') AS up FROM customer
            UNION ALL SELECT 's:' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0'), s_suppkey % 2, 'n:' || lpad(CAST(s_nationkey AS VARCHAR), 9, '0') FROM supplier
            UNION ALL SELECT 'n:' || lpad(CAST(n_nationkey AS VARCHAR), 9, '0'), n_nationkey % 2, 'r:' || lpad(CAST(n_regionkey AS VARCHAR), 9, '0') FROM nation
            UNION ALL SELECT 'r:' || lpad(CAST(r_regionkey AS VARCHAR), 9, '0'), r_regionkey % 2, NULL FROM region),
        u AS (SELECT id AS a, up AS b FROM i WHERE up IS NOT NULL UNION SELECT up, id FROM i WHERE up IS NOT NULL),
        w AS (SELECT 's:000000001' AS id, 0 AS hops UNION SELECT u.b, w.hops + 1 FROM w JOIN u ON u.a = w.id WHERE w.hops < 3),
        h AS (SELECT id, min(hops) AS hops FROM w GROUP BY id)
        SELECT id, CAST(hops AS BIGINT) AS hops, round(1.0::DOUBLE / (1 + hops), 3) AS score, id AS name, id[1] AS kind, 'm/a.ts' AS path, refs = 0 AS unreferenced
        FROM h JOIN i USING (id) ORDER BY score DESC, id LIMIT 40""",
    "module_matches": """
        SELECT p_brand AS repo, 'r:' || p_name || '.ts' AS id, p_brand || '/' || p_name || '.ts' AS path FROM part WHERE suffix(p_name || '.ts', 'e.ts')""",
    "brief_sections": """
        WITH m AS (SELECT p_brand AS repo, 'm' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS id, p_size AS size, p_size % 13 AS degree, p_size % 9 AS hood FROM part),
        rows AS (SELECT repo, 'hubs' AS section, id || ' (' || degree || ' links)' AS name, row_number() OVER (PARTITION BY repo ORDER BY degree DESC, id) AS rn, count(*) OVER (PARTITION BY repo) AS n, 5 AS most FROM m WHERE size > 45
            UNION ALL SELECT repo, 'neighborhoods', label || ' (' || k || ')', row_number() OVER (PARTITION BY repo ORDER BY k DESC, label), count(*) OVER (PARTITION BY repo), 6
                FROM (SELECT repo, CASE WHEN hood < 8 THEN 'hood' || hood ELSE '#' || hood END AS label, count(*) AS k FROM m GROUP BY ALL) WHERE repo IN (SELECT repo FROM m GROUP BY repo HAVING count(DISTINCT hood) > 1)
            UNION ALL SELECT repo, 'largest modules', id || ' (' || size || ')', row_number() OVER (PARTITION BY repo ORDER BY size DESC, id), 0, 5 FROM m
            UNION ALL SELECT repo, 'key exports', 'x' || id || ' [class] ' || id || ':' || size, row_number() OVER (PARTITION BY repo ORDER BY degree DESC, 'x' || id), count(*) OVER (PARTITION BY repo), 8 FROM m WHERE size % 2 = 0)
        SELECT repo, section, string_agg(name, ', ' ORDER BY rn) || CASE WHEN max(n) > max(most) THEN ', +' || (max(n) - max(most)) || ' more' ELSE '' END AS text FROM rows WHERE rn <= most GROUP BY repo, section""",
    "freshness": "SELECT 0 AS k, true AS fresh UNION ALL SELECT 1, false UNION ALL SELECT 2, false",
}
