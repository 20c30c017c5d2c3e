"""Commands: extract, check, brief, scope, find, module, and serve (the tools of cartolina.server over standard input and output)."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from cartolina import server
from cartolina.operators import scope, tools
from cartolina.plans import extract
from cartolina.sources import tree


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="cartolina")
    p.add_argument("command", choices=["extract", "check", "brief", "scope", "find", "module", "serve"])
    p.add_argument("target")
    p.add_argument("--out", default="map")
    p.add_argument("--ignore", action="append", default=[])
    p.add_argument("--depth", type=int)
    p.add_argument("--max-scan", type=int, default=tree.SCAN_MOST)
    p.add_argument("--submodules", choices=["split", "absorb", "skip"], default="split")
    p.add_argument("--hops", type=int, default=2)
    p.add_argument("--top", type=int, default=8)
    p.add_argument("--json", action="store_true")
    p.add_argument("--budget", type=int, default=tools.BRIEF_TOKENS)
    p.add_argument("--trace")
    p.add_argument("--symbol")
    p.add_argument("--repo")
    p.add_argument("--if-stale", action="store_true")
    a = p.parse_args(argv)
    if a.budget <= 0:
        p.error("--budget must be a positive number of tokens")
    if a.max_scan <= 0 or (a.depth is not None and a.depth <= 0):
        p.error("--depth and --max-scan must be positive numbers of folders")
    spark = SparkSession.builder.appName("cartolina").getOrCreate()
    if a.command in ("extract", "check"):
        repos, cut = tree.find_repos(a.target, a.depth, a.max_scan)
        repos, exclude, notes = tree.with_submodules(repos, a.submodules)
        for note in notes + ["the search for repositories was cut: more --depth or --max-scan searches further"] * cut:
            print(note, file=sys.stderr)
        if a.command == "check" or a.if_stale:
            told = extract.check(spark, a.out, repos, a.ignore).orderBy("repo").collect()
            fresh = bool(told) and all(r["status"] == "fresh" for r in told)
            if a.command == "check":
                if a.json:
                    print(json.dumps({"fresh": fresh, "outDir": os.path.abspath(a.out), "repos": [{k: v for k, v in r.asDict().items() if v is not None} for r in told]}, indent=2))
                else:
                    for r in told:
                        print(f"  {r['repo']}  {r['status']}" + (f"  (map: {r['commit'][:12]}{' dirty' if r['dirty'] else ''})" if r["commit"] else ""))
                    print("map is fresh" if fresh else f"map is stale; run: extract {a.target}" if told else "no repositories and no map; nothing to compare")
                return int(not fresh)
            if fresh:
                return 0
        print("\n".join(extract.write(extract.build(spark, repos, a.ignore, exclude), a.out)))
        return 0
    if a.command == "serve":
        for line in server.Server(spark, a.target).serve(sys.stdin):
            print(line, flush=True)
        return 0
    if a.command in ("brief", "scope"):
        held = server.Server(spark, a.target)
        graphs = held.graphs
    else:
        graphs = tree.read_graphs(spark, a.target)
    if a.repo and not graphs["repos"].where(graphs["repos"]["repo"] == a.repo).limit(1).count():
        p.error(f"no repository {a.repo}")
    if a.command == "brief":
        stale = [r["repo"] for r in held.freshness() if r["status"] != "fresh"]
        print(extract.brief(graphs, group=held.group, budget=a.budget, stale=stale, repo=a.repo).first()["text"], end="")
    elif a.command == "find":
        print(json.dumps([r.asDict() for r in tools.find_symbol(graphs["symbols"], graphs["modules"], a.symbol, repo=a.repo).collect()], indent=2))
    elif a.command == "module":
        print(json.dumps([r.asDict() for r in tools.module_info(graphs["symbols"], graphs["edges"], a.symbol).collect()], indent=2))
    else:
        if not a.trace and not a.symbol:
            p.error("scope needs --trace or --symbol")
        query = a.symbol
        if a.trace:
            with open(a.trace) as f:
                query = f.read()
        found = scope.scoped(graphs, query, a.repo, a.hops, top=a.top)
        if a.json:
            print(json.dumps(found, indent=2))
        elif not found["anchor"]["resolved"]:
            print("Nothing in the map answers to that.")
        else:
            print(f"anchor: {found['anchor']['resolved']}\nrepo: {found['repo']}   confidence: {found['anchor']['confidence']}\n")
            print(f"{len(found['suspects'])} symbols around it{', truncated' if found['truncated'] else ''}, by distance, not by likelihood of being the cause:")
            for i, x in enumerate(found["suspects"], 1):
                print(f"  {i:2}. {x['file']}:{x['line']}  {x['name']} [{x['kind']}]\n      score {x['score']}: {'; '.join(x['reasons'])}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
