"""Source trees: a data source that lists and prunes files inside the scan, discovery of repositories, and graph documents."""

from __future__ import annotations

import configparser
import os
import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cartolina.functions.text import glob_regex
from cartolina.schema import GRAPH
from cartolina.sources.languages import BY_EXT

# Names of folders that hold no source of their own, beside all that begin with a dot.
SKIPPED = ("node_modules", "dist", "build", "coverage", "vendor", "__pycache__", "venv", "target", "htmlcov", "site-packages", "docs", "doc")
SKIPPED_ENDS = (".egg-info", ".dist-info", ".egg")
SCAN_MOST = 25_000


def skips(folder: str) -> bool:
    return folder.startswith(".") or folder in SKIPPED or folder.endswith(SKIPPED_ENDS)


def listed(top: str, ignore: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> Iterator[str]:
    """Paths below top of files in known languages, sorted by folder and name; folders are pruned before they are entered."""
    import re

    globs = [re.compile(glob_regex(g)) for g in ignore]
    hidden = lambda name, rel: any(g.match(name) or g.match(rel) for g in globs)

    def walk(folder: str, rel: str) -> Iterator[str]:
        for entry in sorted(os.scandir(folder), key=lambda e: e.name):
            path = f"{rel}{entry.name}"
            if hidden(entry.name, path) or os.path.realpath(entry.path) in exclude:
                continue
            if entry.is_dir(follow_symlinks=False):
                if not skips(entry.name):
                    yield from walk(entry.path, f"{path}/")
            elif entry.is_file() and entry.name.rpartition(".")[2] in BY_EXT and "." in entry.name:
                yield path

    yield from walk(top, "")


class _Part(InputPartition):
    def __init__(self, repo: str, top: str, rels: list[tuple[int, str]]):
        self.repo, self.top, self.rels = repo, top, rels


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[_Part]:
        """Each repository's files in runs of so many, so that a large one is many tasks."""
        split = lambda key: tuple(x for x in self.options.get(key, "").split(os.pathsep) if x)
        size, out = int(self.options.get("filesPerTask", "200")), []
        for named in split("repos") or (f"{os.path.basename(self.options['path'].rstrip('/'))}={self.options['path']}",):
            repo, _, top = named.partition("=")
            rels = list(enumerate(listed(top, split("ignore"), tuple(map(os.path.realpath, split("exclude"))))))
            out += [_Part(repo, top, rels[i : i + size]) for i in range(0, len(rels), size)]
        return out or [_Part("", "", [])]

    def read(self, part: _Part) -> Iterator[tuple]:
        for seq, rel in part.rels:
            path = os.path.join(part.top, rel)
            with open(path, "rb") as f:
                yield part.repo, path, rel, rel.rpartition(".")[2], seq, f.read()


class SourceTree(DataSource):
    """spark.read.format("source_tree"): repos (name=path, joined by the path separator) or a path; ignore (globs), exclude (folders), filesPerTask.

    Unlike Spark's own file sources it also lists names that begin with _ or a dot. Trees are read where executors can open them.
    """

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "repo string, abs string, rel string, ext string, seq long, content binary"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def read_tree(spark: SparkSession, repos: dict[str, str], ignore: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    spark.dataSource.register(SourceTree)
    reader = spark.read.format("source_tree").option("repos", os.pathsep.join(f"{k}={v}" for k, v in repos.items()))
    return reader.option("ignore", os.pathsep.join(ignore or [])).option("exclude", os.pathsep.join(exclude or [])).load()


def find_repos(root: str, depth: int | None = None, most: int = SCAN_MOST) -> tuple[dict[str, str], bool]:
    """Names and folders of the repositories below root, at any depth if depth is None, and whether the search was cut, by depth or by the number of folders: root itself if it is one, else those found, else its folders."""
    if os.path.exists(os.path.join(root, ".git")):
        return {os.path.basename(os.path.abspath(root)): root}, False
    found, seen, queue, deeper = {}, 0, [(root, 0)], False
    while queue and seen < most:
        folder, level = queue.pop(0)
        seen += 1
        for entry in sorted(os.scandir(folder), key=lambda e: e.name):
            if not entry.is_dir(follow_symlinks=False) or skips(entry.name):
                continue
            if os.path.exists(os.path.join(entry.path, ".git")):
                found[os.path.relpath(entry.path, root)] = entry.path
            elif depth is None or level + 1 < depth:
                queue.append((entry.path, level + 1))
            else:
                deeper = True
    plain = {e.name: e.path for e in sorted(os.scandir(root), key=lambda e: e.name) if e.is_dir() and not skips(e.name)}
    return found or plain, bool(queue) or deeper


def submodules(repo: str) -> list[str]:
    """Paths that a repository's .gitmodules names."""
    parser = configparser.ConfigParser(strict=False)
    try:
        with open(os.path.join(repo, ".gitmodules")) as f:
            parser.read_string("\n".join(x.strip() for x in f))
    except (OSError, configparser.Error):
        return []
    return [parser[s]["path"] for s in parser.sections() if parser.has_option(s, "path")]


def with_submodules(repos: dict[str, str], how: str = "split") -> tuple[dict[str, str], list[str], list[str]]:
    """All repositories, folders to exclude from their parents, and notes on empty submodules.

    how: submodules become repositories of their own (split), stay a part of their parents (absorb), or are left out (skip).
    """
    out, exclude, notes, todo, known = {}, [], [], list(repos.items()), set()
    while todo:
        name, top = todo.pop(0)
        if os.path.realpath(top) in known:
            continue
        known.add(os.path.realpath(top))
        out[name] = top
        for path in submodules(top):
            folder = os.path.join(top, path)
            if os.path.isdir(folder) and os.listdir(folder):
                if how == "absorb":
                    continue
                exclude.append(folder)
                if how == "skip":
                    continue
                base = os.path.basename(path)
                todo.append((f"{name}/{base}" if base in out or base in dict(todo) else base, folder))
            else:
                notes.append(f"{name}: submodule {path} is empty")
    return out, exclude, notes


def git_info(repo: str) -> dict[str, object]:
    """commit, refName (not if detached) and dirty; empty where git or the repository is missing."""

    def ask(*args: str) -> str | None:
        try:
            got = subprocess.run(["git", "-C", repo, *args], capture_output=True, text=True, timeout=30)
        except (OSError, subprocess.TimeoutExpired):
            return None
        return got.stdout.strip() if got.returncode == 0 else None

    head = ask("rev-parse", "HEAD") if os.path.exists(os.path.join(repo, ".git")) else None
    if not head:
        return {}
    ref = ask("rev-parse", "--abbrev-ref", "HEAD")
    return {"commit": head, "refName": None if ref in (None, "HEAD") else ref, "dirty": bool(ask("status", "--porcelain"))}


def go_module(repo: str) -> str | None:
    try:
        with open(os.path.join(repo, "go.mod")) as f:
            return next((x.split()[1] for x in f if x.startswith("module ")), None)
    except OSError:
        return None


def read_graphs(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """repos, modules, symbols, edges from the graph documents of a folder."""
    docs = spark.read.schema(GRAPH).option("multiLine", True).json(f"{folder}/*.graph.json")
    ordered = lambda c: docs.select(F.col("repo").alias("_repo"), F.posexplode(c).alias("seq", "x"))
    rows = lambda c: ordered(c).select("x.*", F.col("_repo").alias("repo"), F.col("seq").cast("long").alias("seq"))
    modules = ordered("modules").select("x.*", F.col("seq").cast("long").alias("seq"))
    return {"repos": docs.drop("modules", "symbols", "edges"), "modules": modules, "symbols": rows("symbols"), "edges": rows("edges")}
