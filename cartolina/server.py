"""Tools over a written map, answered line by line as JSON-RPC: brief, scope, find_symbol, module_info, check_freshness."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession

from cartolina.operators import scope, tools
from cartolina.plans import extract
from cartolina.sources import tree

PROTOCOL = "2024-11-05"
FRESH_S = 60.0

_STRING, _NUMBER, _FLAG = {"type": "string"}, {"type": "number"}, {"type": "boolean"}
#: Each tool's purpose, its arguments, and those that it needs.
TOOLS = {
    "brief": ("A summary of the map that fits a budget of tokens.", {"repo": _STRING, "budget": _NUMBER}, []),
    "scope": ("The symbols around a stack trace or a symbol, nearest first.", {"trace": _STRING, "symbol": _STRING, "repo": _STRING, "hops": _NUMBER, "top": _NUMBER}, []),
    "find_symbol": ("Symbols by name: exact ones, else those that contain it.", {"name": _STRING, "repo": _STRING, "exact": _FLAG}, ["name"]),
    "module_info": ("A file's symbols, imports and calls, by its id, its path or the unique end of its path.", {"module": _STRING, "repo": _STRING}, ["module"]),
    "check_freshness": ("Whether the source has changed since the map was made.", {}, []),
}


class Refused(Exception):
    """A tool's answer that is an error."""


class Server:
    """Holds a map, read again when its index changes; freshness is looked up anew after FRESH_S seconds."""

    def __init__(self, spark: SparkSession, folder: str, clock: Callable[[], float] = time.monotonic):
        self.spark, self.folder, self.clock = spark, folder, clock
        self.graphs: dict[str, DataFrame] = {}
        self._stamp: object = None
        self._told: tuple[float, list[dict]] | None = None
        self._load()

    def _load(self) -> None:
        index = os.path.join(self.folder, "group.json")
        stat = os.stat(index)
        if self._stamp == (stat.st_mtime_ns, stat.st_size):
            return
        self._stamp, self._told = (stat.st_mtime_ns, stat.st_size), None
        with open(index) as f:
            held = json.load(f)
        self.group, self.roots = held["group"], {r["repo"]: r["root"] for r in held["repos"]}
        for old in self.graphs.values():
            old.unpersist(blocking=True)
        self.spark.catalog.refreshByPath(self.folder)
        self.graphs = {k: v.cache() for k, v in tree.read_graphs(self.spark, self.folder).items()}

    def freshness(self, anew: bool = False) -> list[dict]:
        if anew or self._told is None or self.clock() - self._told[0] >= FRESH_S:
            there = {k: v for k, v in self.roots.items() if os.path.isdir(v)}
            rows = [r.asDict() for r in extract.check(self.spark, self.folder, there).orderBy("repo").collect()]
            self._told = (self.clock(), rows)
        return self._told[1]

    def _envelope(self, body: dict) -> str:
        stale = [r["repo"] for r in self.freshness() if r["status"] != "fresh"]
        warning = {"stale_warning": f"the map is stale for {', '.join(stale)}; files and lines may be wrong"} if stale else {}
        return json.dumps(warning | body, indent=2)

    def call(self, name: str, given: dict) -> str:
        """A tool's answer as text."""
        known = TOOLS[name][1]
        for key, value in given.items():
            if key not in known:
                raise Refused(f"{name} has no argument {key}")
            wanted = {"string": str, "number": (int, float), "boolean": bool}[known[key]["type"]]
            if not isinstance(value, wanted) or isinstance(value, bool) != (wanted is bool):
                raise Refused(f"{key} must be a {known[key]['type']}")
        for key in TOOLS[name][2]:
            if not str(given.get(key, "")).strip():
                raise Refused(f"{key} is required")
        repo = given.get("repo")
        if repo is not None and repo not in self.roots:
            raise Refused(f"repo {repo!r} is not in the map (it has: {', '.join(sorted(self.roots))})")
        return getattr(self, f"_{name}")(given, repo)

    def _brief(self, given: dict, repo: str | None) -> str:
        stale = [r["repo"] for r in self.freshness() if r["status"] != "fresh"]
        budget = given.get("budget", tools.BRIEF_TOKENS)
        if budget <= 0:
            raise Refused("budget must be positive")
        return extract.brief(self.graphs, group=self.group, budget=int(budget), stale=stale, repo=repo).first()["text"]

    def _scope(self, given: dict, repo: str | None) -> str:
        query = given.get("trace") or given.get("symbol")
        if not query:
            raise Refused("trace or symbol is required")
        return self._envelope(scope.scoped(self.graphs, query, repo, int(given.get("hops", 2)), top=int(given.get("top", 8))))

    def _find_symbol(self, given: dict, repo: str | None) -> str:
        rows = tools.find_symbol(self.graphs["symbols"], self.graphs["modules"], given["name"].strip(), given.get("exact", False), repo).collect()
        hits = [{k: v for k, v in r.asDict().items() if k != "matches"} for r in rows]
        return self._envelope({"total": rows[0]["matches"] if rows else 0, "matches": hits})

    def _module_info(self, given: dict, repo: str | None) -> str:
        asked = given["module"].strip().replace("\\", "/")
        ids = sorted(r["id"] for r in tools.match_modules(self.graphs["modules"], asked, repo).select("id").distinct().limit(10_000).collect())
        if not ids:
            raise Refused(self._envelope({"error": f"no module matches {asked!r}", "hint": "find_symbol, or a longer end of the path"}))
        if len(ids) > 1:
            raise Refused(self._envelope({"error": f"{asked!r} is ambiguous ({len(ids)} modules)", "candidates": ids[: tools.LIST_MOST]}))
        module = self.graphs["modules"].where(self.graphs["modules"]["id"] == ids[0]).first().asDict()
        lists: dict[str, dict] = {}
        rows = tools.module_info(self.graphs["symbols"], self.graphs["edges"], ids[0]).collect()  # five lists of LIST_MOST rows at most
        for r in sorted(rows, key=lambda r: (r["list"], r["line"] or 0, r["item"], r["other"] or "")):
            held = lists.setdefault(r["list"], {"items": []})
            held["items"].append({k: r[k] for k in ("item", "other", "line") if r[k] is not None})
            if r["total"] > tools.LIST_MOST:
                held["truncated"] = f"showing {tools.LIST_MOST} of {r['total']}"
        shown = {k: module[k] for k in ("id", "repo", "path", "loc", "symbolCount", "neighborhood", "degree", "hub") if module.get(k) is not None}
        return self._envelope(shown | lists)

    def _check_freshness(self, given: dict, repo: str | None) -> str:
        told = self.freshness(anew=True)
        return json.dumps({"fresh": bool(told) and all(r["status"] == "fresh" for r in told), "repos": told}, indent=2)

    def answer(self, message: object) -> dict | None:
        """The reply to one message; none to a notification that is not known."""
        if not isinstance(message, dict):
            return _reply(None, error=(-32600, "batch requests are not supported" if isinstance(message, list) else "a request must be an object"))
        method, params, ident = message.get("method"), message.get("params") or {}, message.get("id")
        if method == "initialize":
            return _reply(ident, {"protocolVersion": params.get("protocolVersion", PROTOCOL), "capabilities": {"tools": {}}, "serverInfo": {"name": "cartolina", "version": "0.1.0"}})
        if method == "ping":
            return _reply(ident, {})
        if method == "tools/list":
            schema = lambda kinds, needed: {"type": "object", "properties": kinds, "required": needed, "additionalProperties": False}
            return _reply(ident, {"tools": [{"name": n, "description": d, "inputSchema": schema(kinds, needed)} for n, (d, kinds, needed) in TOOLS.items()]})
        if method == "tools/call":
            if params.get("name") not in TOOLS:
                return _reply(ident, error=(-32602, f"unknown tool: {params.get('name')}"))
            self._load()
            try:
                text, failed = self.call(params["name"], params.get("arguments") or {}), False
            except Refused as e:
                text, failed = str(e), True
            return _reply(ident, {"content": [{"type": "text", "text": text}], "isError": failed})
        return None if ident is None else _reply(ident, error=(-32601, f"method not found: {method}"))

    def serve(self, lines: Iterable[str]) -> Iterator[str]:
        """A reply line for each message line that asks for one."""
        for line in lines:
            if not line.strip():
                continue
            try:
                message = json.loads(line)
            except json.JSONDecodeError:
                yield json.dumps(_reply(None, error=(-32700, "parse error")))
                continue
            if (told := self.answer(message)) is not None:
                yield json.dumps(told)


def _reply(ident: object, result: dict | None = None, error: tuple[int, str] | None = None) -> dict:
    return {"jsonrpc": "2.0", "id": ident} | ({"result": result} if error is None else {"error": {"code": error[0], "message": error[1]}})
