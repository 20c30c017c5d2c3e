"""The queries of the reference's kind over relational tables, by name, with SQL twins for DuckDB.

Tables hold no source code, so each operator runs on data of its shape: customers and suppliers that share
orders are a graph, parts are symbols of their brands, lines of orders are imports, events are frames and declarations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolina.functions import text as fn
from cartolina.operators import graph, layout, resolve, scope, tools, upkeep
from cartolina.plans import code_queries
from cartolina.streaming import admission


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _trade(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """nodes and edges: customers and the suppliers of their orders."""
    orders, lines = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "lineitem")
    edges = orders.join(lines, orders.o_orderkey == lines.l_orderkey).select(F.concat(F.lit("c:"), F.col("o_custkey").cast("string")).alias("from"), F.concat(F.lit("s:"), F.col("l_suppkey").cast("string")).alias("to"))
    c = _table(spark, sf_dir, "customer").select(F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("id"))
    s = _table(spark, sf_dir, "supplier").select(F.concat(F.lit("s:"), F.col("s_suppkey").cast("string")).alias("id"))
    return c.unionByName(s), edges


_TRADE = "SELECT 'c:' || o_custkey AS a, 's:' || l_suppkey AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey"
_NODES = "SELECT 'c:' || c_custkey AS id FROM customer UNION ALL SELECT 's:' || s_suppkey FROM supplier"


def graph_adjacency(spark, sf_dir):
    return graph.adjacency(_trade(spark, sf_dir)[1])


def graph_hubs(spark, sf_dir):
    return graph.hubs(*_trade(spark, sf_dir))


def graph_coupling(spark, sf_dir):
    edges = _trade(spark, sf_dir)[1]
    lines = _table(spark, sf_dir, "lineitem")
    parts = lines.select(F.concat(F.lit("p:"), F.col("l_partkey").cast("string")).alias("from"), F.concat(F.lit("s:"), F.col("l_suppkey").cast("string")).alias("to"))
    return graph.degrees(graph.coupling(edges, parts).select(F.explode(F.array("from", "to")).alias("id")).distinct(), graph.coupling(edges, parts))


def _names():
    return F.concat("p_name", F.lit("#"), F.col("p_size").cast("string"))


def _known(value):
    """The value of every third part, so that names resolve to it; the others' are renamed to ones that nothing refers to."""
    return F.concat(value, F.when(F.col("p_partkey") % 3 == 0, "").otherwise("~"))


def _symbols(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    return part.select(F.lit("r").alias("repo"), F.concat(F.lit("r:"), "p_brand", F.lit(":"), F.col("p_partkey").cast("string")).alias("id"), _known(_names()).alias("name"), F.concat(F.lit("r:"), "p_brand").alias("module"), F.lit("e").alias("engine"), F.col("p_partkey").alias("seq"))


def ref_counts(spark, sf_dir):
    """Every part declares its name in its brand, and every line of an order refers to one."""
    part = _table(spark, sf_dir, "part")
    brand = F.concat(F.lit("r:"), "p_brand").alias("repo")
    symbols = part.select(brand, F.lit("e").alias("engine"), _names().alias("name"))
    used = _table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    idents = part.join(used, F.col("p_partkey") == F.col("l_partkey")).select(brand, F.lit("e").alias("engine"), _names().alias("name"), "n")
    return resolve.reference_counts(symbols, idents)


def resolved_calls(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    calls = part.select(F.lit("r").alias("repo"), F.concat(F.lit("r:"), "p_brand").alias("from"), F.concat(F.lit("r:"), "p_brand").alias("module"), _names().alias("callee")).distinct()
    return resolve.resolved_calls(_symbols(spark, sf_dir), calls).select("from", "to", "kind", "confidence")


def _imports(spark, sf_dir):
    lines = _table(spark, sf_dir, "lineitem")
    key = F.col("l_partkey").cast("string")
    specs = lines.select(F.lit("r").alias("repo"), F.concat(F.lit("o:"), F.col("l_orderkey").cast("string")).alias("from"), key.alias("spec")).distinct()
    # Two candidates a spec: the part itself, then the part 1 below.
    both = F.inline(F.array(F.struct(F.lit(0).alias("priority"), F.col("spec").alias("rel")), F.struct(F.lit(1).alias("priority"), (F.col("spec").cast("long") - 1).cast("string").alias("rel"))))
    rel = _known(F.col("p_partkey").cast("string"))
    files = _table(spark, sf_dir, "part").select(F.lit("r").alias("repo"), rel.alias("rel"), F.concat(F.lit("p:"), rel).alias("module"))
    return specs, specs.select("repo", "from", "spec", both), files


def import_edges(spark, sf_dir):
    return resolve.import_edges(*_imports(spark, sf_dir)).select("from", "to", "confidence")


def dangling_imports(spark, sf_dir):
    specs, _, files = _imports(spark, sf_dir)
    edges = specs.select("repo", "from", F.concat(F.lit("p:"), "spec").alias("to"), F.lit("imports").alias("kind"))
    return resolve.dangling(edges, files.select("repo", F.col("module").alias("id"))).groupBy("to").agg(F.count("*").alias("n"))


def line_counts(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", fn.line_count(F.col("text")).cast("long").alias("loc"))


def language_lists(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return docs.groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("languages"), F.count("*").alias("modules"))


def find_symbol(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    symbols = part.select(F.col("p_brand").alias("repo"), F.format_string("%s:%d", "p_brand", "p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.col("p_brand").alias("module"), F.col("p_size").alias("line"))
    modules = part.select(F.col("p_brand").alias("id"), F.col("p_brand").alias("path")).distinct()
    return tools.find_symbol(symbols, modules, "AN").select("repo", "id", "name", "path", "line", F.col("matches").cast("long").alias("matches"))


def module_info(spark, sf_dir):
    """Supplier 3 as a module: lines within (its symbols), orders that import it, customers called across."""
    lines = _table(spark, sf_dir, "lineitem")
    symbols = lines.select(F.format_string("l:%d:%d", "l_orderkey", "l_linenumber").alias("id"), F.col("l_returnflag").alias("name"), F.col("l_suppkey").cast("string").alias("module"), F.col("l_linenumber").alias("line"))
    imports = lines.select(F.format_string("o:%d", "l_orderkey").alias("from"), F.col("l_suppkey").cast("string").alias("to"), F.lit("imports").alias("kind"), F.col("l_linestatus").alias("confidence")).distinct()
    calls = lines.where("l_linenumber > 1").select(F.format_string("l:%d:%d", "l_orderkey", "l_linenumber").alias("from"), F.format_string("l:%d:%d", F.col("l_orderkey"), F.col("l_linenumber") - 1).alias("to"), F.lit("calls").alias("kind"), F.lit("resolved").alias("confidence"))
    return tools.module_info(symbols, imports.unionByName(calls), "3").select("list", "item", "other", "line", F.col("total").cast("long").alias("total"))


def frames_asof(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    frames = events.where("event_type = 'purchase'").select(F.col("event_id").alias("frame_id"), "user_id", "ts")
    decls = events.where("event_type = 'error'").select(F.col("event_id").alias("decl_id"), "user_id", "ts", F.col("event_id").alias("seq"))
    return scope.nearest_before(frames, decls, ["user_id"], "ts").select("frame_id", "decl_id")


def _places(spark, sf_dir):
    n, c, s = (_table(spark, sf_dir, t) for t in ("nation", "customer", "supplier"))
    named = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    edges = c.select(named("c:", "c_custkey").alias("from"), named("n:", "c_nationkey").alias("to")).unionByName(s.select(named("s:", "s_suppkey").alias("from"), named("n:", "s_nationkey").alias("to")))
    return edges.unionByName(n.select(named("n:", "n_nationkey").alias("from"), named("r:", "n_regionkey").alias("to")))


def graph_reach(spark, sf_dir):
    edges = _places(spark, sf_dir)
    return graph.ranked_suspects(graph.reached(edges, spark.createDataFrame([("s:1",)], "id string"), 3)).select("id", F.col("hops").cast("long").alias("hops"), "score")


def best_anchors(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders")
    confidence = F.when(F.col("o_orderpriority").startswith("1"), "exact").when(F.col("o_orderpriority").startswith("2"), "resolved").otherwise("inferred")
    anchors = orders.select(F.col("o_orderstatus").alias("repo"), F.col("o_orderkey").alias("repo_seq"), F.col("o_custkey").cast("string").alias("id"), confidence.alias("confidence"))
    return scope.best_anchor(anchors).select("repo", "repo_seq", "id", "confidence")


def eviction(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    entries = docs.select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), F.col("doc_id").alias("mtimeMs"), F.col("n_chars").alias("bytes"))
    return upkeep.planned_eviction(entries, share=0.5)


def fingerprints(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    files = docs.select(F.col("source").alias("repo"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("rel"), F.encode("text", "UTF-8").alias("content"))
    return upkeep.fingerprints(files)


def statuses(spark, sf_dir):
    c = _table(spark, sf_dir, "customer")
    stored = c.where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("repo"), F.when(F.col("c_custkey") % 5 == 0, None).otherwise(F.col("c_mktsegment")).alias("sourceFingerprint"))
    found = c.where("c_custkey % 11 <> 0").select(F.col("c_custkey").alias("repo"), F.when(F.col("c_custkey") % 3 == 0, "x").otherwise(F.col("c_mktsegment")).alias("sourceFingerprint"))
    return upkeep.statuses(stored, found)


def cache_bytes(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    entries = docs.select(F.col("source").alias("slug"), F.when(F.col("doc_id") % 97 != 0, F.col("n_chars")).alias("bytes"))
    return upkeep.bytes_by_slug(entries)


def url_predicates(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages")
    path = F.regexp_replace("url", "^https?://[^/]+/?", "")
    return pages.select("page_id", fn.valid_ref(path).alias("ref_ok"), fn.ignored(path, ["de/**", "*.html", "**/p?"]).alias("ignored"), fn.escape_html(F.col("url")).alias("safe"), fn.path_tail(path).alias("tail"))


def brief_tokens(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return docs.groupBy("source").agg(F.sum(fn.estimated_tokens(F.col("text"))).cast("long").alias("tokens"), F.count("*").alias("docs")).withColumn("level", F.when(F.col("tokens") <= 20000, 5).otherwise(1).cast("long"))


def brief_lists(spark, sf_dir):
    lines = _table(spark, sf_dir, "lineitem")
    counted = lines.groupBy(F.col("l_returnflag").alias("repo"), F.col("l_suppkey").alias("s")).agg(F.count("*").alias("n"))
    return tools.top_of_lists(counted, ["repo"], [F.desc("n"), "s"], 5).select("repo", "s", "n", F.col("total").cast("long").alias("total"))


def admissions(spark, sf_dir):
    events = _table(spark, sf_dir, "events").select(F.lit("gate").alias("gate"), F.col("event_id").alias("seq"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long").alias("now_ms"), F.lit("start").alias("event"))
    return admission.admissions(events.withColumn("gate", F.concat(F.lit("g"), (F.col("seq") % 40).cast("string"))), most_active=1_000_000, most_starts=3, window_ms=3_600_000)


def communities(spark, sf_dir):
    nodes, edges = _nation(spark, sf_dir)
    return graph.neighborhoods(nodes, edges)


def _nation(spark, sf_dir):
    """Customers and suppliers of one nation at a time, as repositories."""
    c = _table(spark, sf_dir, "customer").select(F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("id"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("repo"))
    s = _table(spark, sf_dir, "supplier").select(F.concat(F.lit("s:"), F.col("s_suppkey").cast("string")).alias("id"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("repo"))
    edges = _trade(spark, sf_dir)[1].join(c.select(F.col("id").alias("from"), "repo"), "from").join(s.select(F.col("id").alias("to"), "repo"), ["to", "repo"])
    return c.unionByName(s).select("repo", "id"), edges.select("repo", "from", "to")


def community_layout(spark, sf_dir):
    nodes, edges = _nation(spark, sf_dir)
    return layout.placed(nodes.withColumns({"radius": F.lit(12.0), "ax": F.lit(None).cast("double"), "ay": F.lit(None).cast("double")}), edges)


QUERIES = code_queries.QUERIES | {f.__name__: f for f in (graph_adjacency, graph_hubs, graph_coupling, ref_counts, resolved_calls, import_edges, dangling_imports, line_counts, language_lists, find_symbol, module_info, frames_asof, graph_reach, best_anchors, eviction, fingerprints, statuses, cache_bytes, url_predicates, brief_tokens, brief_lists, admissions, communities, community_layout)}

_PARTS = "SELECT 'r:' || p_brand AS brand, p_name || '#' || p_size AS name, 'r:' || p_brand || ':' || p_partkey AS id, p_partkey FROM part"

ORACLE_SQL = code_queries.ORACLE_SQL | {
    "admissions": """
        WITH RECURSIVE e AS (SELECT 'g' || event_id % 40 AS gate, event_id AS seq, epoch_us(CAST(ts AS TIMESTAMP)) // 1000 AS now, row_number() OVER (PARTITION BY event_id % 40 ORDER BY event_id) AS n FROM events),
        s AS (SELECT gate, seq, n, 200 AS status, CAST(NULL AS INTEGER) AS retry_s, 1 AS starts, now AS since FROM e WHERE n = 1
            UNION ALL SELECT e.gate, e.seq, e.n, CASE WHEN now - since < 3600000 AND starts >= 3 THEN 429 ELSE 200 END,
                CASE WHEN now - since < 3600000 AND starts >= 3 THEN greatest(1, CAST(ceil((since + 3600000 - now) / 1000.0) AS INTEGER)) END,
                CASE WHEN now - since >= 3600000 THEN 1 WHEN starts >= 3 THEN starts ELSE starts + 1 END, CASE WHEN now - since >= 3600000 THEN now ELSE since END
            FROM s JOIN e ON e.gate = s.gate AND e.n = s.n + 1)
        SELECT gate, seq, status, retry_s FROM s""",
    "graph_adjacency": f"""
        WITH e AS ({_TRADE}), p AS (SELECT a AS u, b AS v FROM e UNION ALL SELECT b, a FROM e)
        SELECT u, v, count(*) AS w FROM p GROUP BY u, v""",
    "graph_hubs": f"""
        WITH n AS ({_NODES}), e AS ({_TRADE}), k AS (SELECT a, b FROM e WHERE a IN (SELECT id FROM n) AND b IN (SELECT id FROM n)),
        p AS (SELECT a AS u, b AS v FROM k UNION SELECT b, a FROM k), d AS (SELECT id, count(v) AS degree FROM (SELECT DISTINCT id FROM n) LEFT JOIN p ON u = id GROUP BY id)
        SELECT id, degree, degree >= greatest(4.0, avg(degree) OVER () + 2.0 * stddev_pop(degree) OVER ()) AS hub FROM d""",
    "graph_coupling": f"""
        WITH e AS ({_TRADE} UNION ALL SELECT 'p:' || l_partkey, 's:' || l_suppkey FROM lineitem), p AS (SELECT a AS u, b AS v FROM e UNION SELECT b, a FROM e)
        SELECT u AS id, count(*) AS degree FROM p GROUP BY u""",
    "ref_counts": f"""
        WITH p AS ({_PARTS}), d AS (SELECT brand, name, count(*) AS n FROM p GROUP BY ALL), i AS (SELECT brand, name, count(*) AS n FROM p JOIN lineitem ON p_partkey = l_partkey GROUP BY ALL)
        SELECT d.brand AS repo, 'e' AS engine, d.name AS bare, greatest(0, coalesce(i.n, 0) - d.n) AS "refCount" FROM d LEFT JOIN i USING (brand, name)""",
    "resolved_calls": f"""
        WITH p AS ({_PARTS}), s AS (SELECT * FROM p WHERE p_partkey % 3 = 0), h AS (SELECT brand, name, count(*) AS n, min(id) AS id FROM s GROUP BY ALL),
        a AS (SELECT name, sum(n) AS n, min(id) AS id FROM h GROUP BY name), c AS (SELECT DISTINCT brand, name FROM p),
        t AS (SELECT c.brand AS f, CASE WHEN h.n = 1 THEN h.id WHEN h.n IS NULL AND a.n = 1 THEN a.id END AS t FROM c JOIN a USING (name) LEFT JOIN h USING (brand, name))
        SELECT DISTINCT f AS "from", t AS "to", 'calls' AS kind, 'resolved' AS confidence FROM t WHERE t IS NOT NULL""",
    "import_edges": """
        WITH s AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS k FROM lineitem), f AS (SELECT p_partkey AS k FROM part WHERE p_partkey % 3 = 0)
        SELECT 'o:' || o AS "from", CASE WHEN a.k IS NOT NULL THEN 'p:' || a.k WHEN b.k IS NOT NULL THEN 'p:' || b.k ELSE 'pkg:' || s.k END AS "to",
               CASE WHEN a.k IS NOT NULL OR b.k IS NOT NULL THEN 'resolved' ELSE 'exact' END AS confidence
        FROM s LEFT JOIN f a ON a.k = s.k LEFT JOIN f b ON b.k = s.k - 1""",
    "dangling_imports": """
        SELECT 'p:' || k AS "to", count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_partkey AS k FROM lineitem)
        WHERE k NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 3 = 0) GROUP BY k""",
    "line_counts": "SELECT doc_id, len(string_split(text, chr(10))) AS loc FROM documents",
    "language_lists": "SELECT source, string_agg(DISTINCT lang, ',' ORDER BY lang) AS languages, count(*) AS modules FROM documents GROUP BY source",
    "find_symbol": """
        WITH m AS (SELECT p_brand AS repo, p_brand || ':' || p_partkey AS id, p_name AS name, p_brand AS path, p_size AS line, p_name = 'AN' OR regexp_replace(p_name, '^.*[.]', '') = 'AN' AS e
                   FROM part WHERE p_name = 'AN' OR contains(lower(p_name), 'an')),
        k AS (SELECT *, max(e) OVER () AS any_e FROM m), t AS (SELECT *, count(*) OVER () AS matches FROM k WHERE e OR NOT any_e)
        SELECT repo, id, name, path, line, matches FROM t ORDER BY e DESC, repo, path, line, id LIMIT 30""",
    "module_info": """
        WITH l AS (SELECT 'l:' || l_orderkey || ':' || l_linenumber AS id, 'l:' || l_orderkey || ':' || (l_linenumber - 1) AS prev, * FROM lineitem), i AS (SELECT id FROM l WHERE l_suppkey = 3),
        r AS (SELECT 'symbols' AS list, id AS item, l_returnflag AS other, l_linenumber AS line FROM l WHERE l_suppkey = 3
              UNION ALL SELECT DISTINCT 'importedBy', 'o:' || l_orderkey, l_linestatus, NULL::INT FROM l WHERE l_suppkey = 3
              UNION ALL SELECT 'callsOut', id, prev, NULL FROM l WHERE l_linenumber > 1 AND id IN (SELECT id FROM i) AND prev NOT IN (SELECT id FROM i)
              UNION ALL SELECT 'callsIn', id, prev, NULL FROM l WHERE l_linenumber > 1 AND prev IN (SELECT id FROM i) AND id NOT IN (SELECT id FROM i)),
        t AS (SELECT *, count(*) OVER (PARTITION BY list) AS total, row_number() OVER (PARTITION BY list ORDER BY line NULLS FIRST, item, other) AS rn FROM r)
        SELECT list, item, other, line, total FROM t WHERE rn <= 50""",
    "frames_asof": """
        WITH f AS (SELECT * FROM events WHERE event_type = 'purchase'), d AS (SELECT * FROM events WHERE event_type = 'error'),
        r AS (SELECT f.event_id AS frame_id, d.event_id AS decl_id, row_number() OVER (PARTITION BY f.event_id ORDER BY d.ts DESC, d.event_id) AS rn FROM f JOIN d ON f.user_id = d.user_id AND d.ts <= f.ts)
        SELECT frame_id, decl_id FROM r WHERE rn = 1""",
    "graph_reach": """
        WITH RECURSIVE e AS (SELECT 'c:' || c_custkey AS a, 'n:' || c_nationkey AS b FROM customer UNION SELECT 's:' || s_suppkey, 'n:' || s_nationkey FROM supplier UNION SELECT 'n:' || n_nationkey, 'r:' || n_regionkey FROM nation),
        u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), w AS (SELECT 's:1' AS id, 0 AS hops UNION SELECT u.b, w.hops + 1 FROM w JOIN u ON u.a = w.id WHERE w.hops < 3)
        SELECT id, CAST(min(hops) AS BIGINT) AS hops, round(1.0::DOUBLE / (1 + min(hops)), 3) AS score FROM w GROUP BY id""",
    "best_anchors": """
        SELECT o_orderstatus AS repo, o_orderkey AS repo_seq, CAST(o_custkey AS VARCHAR) AS id, CASE WHEN o_orderpriority LIKE '1%' THEN 'exact' WHEN o_orderpriority LIKE '2%' THEN 'resolved' ELSE 'inferred' END AS confidence
        FROM orders ORDER BY CASE WHEN o_orderpriority LIKE '1%' THEN 1 WHEN o_orderpriority LIKE '2%' THEN 2 ELSE 3 END, o_orderkey LIMIT 1""",
    "eviction": """
        WITH t AS (SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS path, doc_id AS "mtimeMs", n_chars AS bytes, sum(n_chars) OVER () AS total,
                          coalesce(sum(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents)
        SELECT path, "mtimeMs", bytes FROM t WHERE total - before > total * 0.5""",
    "fingerprints": """
        WITH f AS (SELECT source, hex(encode(lpad(CAST(doc_id AS VARCHAR), 12, '0'))) || '00' || upper(sha256(text)) AS h, doc_id FROM documents)
        SELECT source AS repo, 'sha256:' || sha256(unhex(string_agg(h, '' ORDER BY doc_id))) AS "sourceFingerprint" FROM f GROUP BY source""",
    "statuses": """
        WITH s AS (SELECT c_custkey AS repo, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS was FROM customer WHERE c_custkey % 7 <> 0),
        f AS (SELECT c_custkey AS repo, CASE WHEN c_custkey % 3 = 0 THEN 'x' ELSE c_mktsegment END AS now FROM customer WHERE c_custkey % 11 <> 0)
        SELECT coalesce(s.repo, f.repo) AS repo, CASE WHEN s.repo IS NULL THEN 'new' WHEN f.repo IS NULL THEN 'removed' WHEN was IS NULL OR now IS NULL THEN 'unknown' WHEN was = now THEN 'fresh' ELSE 'stale' END AS status
        FROM s FULL JOIN f ON s.repo = f.repo""",
    "cache_bytes": "SELECT source AS slug, CAST(sum(n_chars) FILTER (WHERE doc_id % 97 <> 0) AS BIGINT) AS bytes, bool_or(doc_id % 97 = 0) AS remeasure FROM documents GROUP BY source",
    "url_predicates": r"""
        WITH p AS (SELECT page_id, url, regexp_replace(url, '^https?://[^/]+/?', '') AS path FROM pages)
        SELECT page_id, path <> '' AND length(path) <= 255 AND NOT (starts_with(path, '-') OR starts_with(path, '/') OR suffix(path, '/') OR suffix(path, '.') OR suffix(path, '.lock') OR contains(path, '..')
                   OR contains(path, '//') OR contains(path, '@{') OR regexp_matches(path, '[\s~^:?*\[\\[:cntrl:]]')) AS ref_ok,
               regexp_matches(path, '^de(/.*)?$') OR regexp_matches(path, '^[^/]*[.]html$') OR regexp_matches(split_part(path, '/', -1), '^[^/]*[.]html$') OR regexp_matches(path, '^(.*/)?p[^/]$') OR regexp_matches(split_part(path, '/', -1), '^de(/.*)?$') AS ignored,
               replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS safe,
               array_to_string(list_slice(string_split(path, '/'), -2, -1), '/') AS tail FROM p""",
    "brief_tokens": "WITH t AS (SELECT source, CAST(sum(ceil(length(text) / 4.0)) AS BIGINT) AS tokens, count(*) AS docs FROM documents GROUP BY source) SELECT *, CAST(CASE WHEN tokens <= 20000 THEN 5 ELSE 1 END AS BIGINT) AS level FROM t",
    "brief_lists": """
        WITH c AS (SELECT l_returnflag AS repo, l_suppkey AS s, count(*) AS n FROM lineitem GROUP BY ALL), t AS (SELECT *, count(*) OVER (PARTITION BY repo) AS total, row_number() OVER (PARTITION BY repo ORDER BY n DESC, s) AS rn FROM c)
        SELECT repo, s, n, total FROM t WHERE rn <= 5""",
}
