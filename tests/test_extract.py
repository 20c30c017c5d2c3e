"""Parsers on small files, the scan, and the whole way from trees to documents and back."""

from __future__ import annotations

import json
import os

import pytest

from cartolina.plans import extract
from cartolina.sources import tree
from cartolina.sources.scan import parse

FILES = {
    "ts/src/pay.ts": 'import { check } from "./cart";\nimport x from "express";\nexport class Pay extends Base implements Payable {\n  charge(n: number) { check(n); }\n}\nexport const valid = (c: Cart): boolean => { return c.ok; };\nexport function go() { const p = new Pay(); p.charge(1); }\n',
    "ts/src/cart.ts": "export function check(n: number) { return n; } // call()\ninterface Payable { pay(): void }\n",
    "py/app.py": "from .utils import Base, helper\n\nclass Report(Base):\n    def build(self):\n        return helper(1)\n\ndef main():\n    Report().build()\n\ndef never(): pass\n",
    "py/utils.py": "class Base:\n    def describe(self): pass\n\ndef helper(x):\n    return x\n\ndef _private(): pass\n",
    "go/go.mod": "module ex.com/gw\n",
    "go/main.go": 'package main\nimport (\n\t"fmt"\n\t"ex.com/gw/router"\n)\nfunc main() { r := router.New(); r.Handle("/") }\n',
    "go/router/router.go": "package router\ntype Router struct { m int }\nfunc New() *Router { return nil }\nfunc (r *Router) Handle(p string) { normalize(p) }\nfunc normalize(p string) {}\n",
}


@pytest.fixture(scope="module")
def trees(tmp_path_factory):
    top = tmp_path_factory.mktemp("trees")
    for path, text in FILES.items():
        (top / path).parent.mkdir(parents=True, exist_ok=True)
        (top / path).write_text(text)
    return {r: str(top / r) for r in ("ts", "py", "go")}


@pytest.fixture(scope="module")
def folder(spark, trees, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("map"))
    extract.write(extract.build(spark, trees), out)
    return out


@pytest.fixture(scope="module")
def built(spark, folder):
    return {name: spark.read.parquet(f"{folder}/tables/{name}") for name in ("modules", "symbols", "edges")}


def _edges(built, repo, kind):
    short = lambda x: x.removeprefix(f"{repo}:")
    return {(short(r["from"]), short(r["to"]), r["confidence"]) for r in built["edges"].where(f"repo = '{repo}' and kind = '{kind}'").collect()}


def test_golden_python(built):
    symbols = {r["name"]: (r["kind"], r["line"], r["exported"], r["refCount"]) for r in built["symbols"].where("repo = 'py'").collect()}
    assert symbols == {"Report": ("class", 3, True, 1), "Report.build": ("method", 4, True, 1), "main": ("function", 7, True, 0), "never": ("function", 10, True, 0), "Base": ("class", 1, True, 2), "Base.describe": ("method", 2, True, 0), "helper": ("function", 4, True, 2), "_private": ("function", 7, False, 0)}
    assert _edges(built, "py", "imports") == {("app.py", "utils.py", "resolved")}
    assert _edges(built, "py", "extends") == {("app.py:Report", "Base", "inferred")}
    assert _edges(built, "py", "calls") == {("app.py:Report.build", "utils.py:helper", "resolved"), ("app.py:main", "app.py:Report", "resolved"), ("app.py:main", "app.py:Report.build", "resolved")}
    assert {(r["path"], r["loc"], r["symbolCount"], r["neighborhood"]) for r in built["modules"].where("repo = 'py'").collect()} == {("app.py", 11, 4, 0), ("utils.py", 8, 4, 0)}


def test_typescript(built):
    assert {("src/pay.ts", "src/cart.ts", "resolved"), ("src/pay.ts", "pkg:express", "exact")} == _edges(built, "ts", "imports")
    assert ("src/pay.ts:go", "src/pay.ts:Pay", "resolved") in _edges(built, "ts", "calls")
    assert _edges(built, "ts", "implements") == {("src/pay.ts:Pay", "Payable", "inferred")}


def test_go(built):
    assert ("main.go", "router/router.go", "resolved") in _edges(built, "go", "imports")
    assert {("main.go:main", "router/router.go:Router.Handle", "resolved"), ("router/router.go:Router.Handle", "router/router.go:normalize", "resolved")} <= _edges(built, "go", "calls")


def test_no_edge_dangles_and_no_call_is_its_own(built):
    known = {r["id"] for r in built["modules"].collect()}
    assert all(r["to"] in known or r["to"].startswith("pkg:") for r in built["edges"].where("kind = 'imports'").collect())
    assert all(r["from"] != r["to"] and r["confidence"] == "resolved" for r in built["edges"].where("kind = 'calls'").collect())


def test_documents_round_trip(spark, built, folder, trees):
    graphs = tree.read_graphs(spark, folder)
    assert graphs["symbols"].count() == built["symbols"].count() and graphs["edges"].count() == built["edges"].count()
    doc = json.loads(open(os.path.join(folder, "py.graph.json")).read())
    assert "commit" not in doc and all("parent" not in s for s in doc["symbols"] if s["kind"] != "method")
    text = extract.brief(graphs).first()["text"]
    assert "3 repos, 6 modules" in text and "key exports" in text
    small = extract.brief(graphs, budget=1).first()
    assert small["level"] == 1 and small["omitted"] == ["hubs", "neighborhoods", "largest modules", "key exports"]
    told = lambda: {r["repo"]: r["status"] for r in extract.check(spark, folder, {"py": trees["py"], "new": trees["ts"]}).collect()}
    assert told() == {"py": "fresh", "new": "new", "ts": "removed", "go": "removed"}


def test_scan_prunes_and_keeps_hidden_names(tmp_path):
    for p in ("pkg/__init__.py", "_x.py", "__tests__/t.py", ".eslintrc.js", ".hid/a.py", "b.PY", "x.egg-info/a.py", "build/l.py", "docs/conf.py", "gen/z.py", "legacy.py", "n.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("")
    assert list(tree.listed(str(tmp_path), ("legacy.py", "gen/**"))) == [".eslintrc.js", "__tests__/t.py", "_x.py", "pkg/__init__.py"]


def test_unreadable_file_is_an_empty_module(spark, tmp_path):
    (tmp_path / "ok.py").write_text("def f(): pass\n")
    (tmp_path / "bad.py").write_text("def (:\n")
    got = extract.build(spark, {"r": str(tmp_path)}, with_layout=False)["modules"].collect()
    assert {(m["path"], m["symbolCount"], m["loc"]) for m in got} == {("ok.py", 1, 2), ("bad.py", 0, 2)}


def test_discovery(tmp_path):
    for p in ("a/.git", "b/c/.git", "plain"):
        (tmp_path / p).mkdir(parents=True)
    assert set(tree.find_repos(str(tmp_path))[0]) == {"a", os.path.join("b", "c")}
    assert set(tree.find_repos(str(tmp_path / "plain"))[0]) == set()


def test_repositories_at_any_depth(spark, tmp_path, monkeypatch):
    from cartolina import cli

    deep = os.path.join(*"abcdefghijklmnop")
    os.makedirs(tmp_path / deep / ".git")
    assert tree.find_repos(str(tmp_path)) == ({deep: str(tmp_path / deep)}, False)
    assert tree.find_repos(str(tmp_path), depth=12)[1] and tree.find_repos(str(tmp_path), most=3)[1]
    asked = []
    monkeypatch.setattr(tree, "find_repos", lambda *args: asked.append(args) or ({}, False))
    monkeypatch.setattr(cli.extract, "check", lambda *args: (_ for _ in ()).throw(SystemExit))
    for options in ([], ["--depth", "3", "--max-scan", "70000"]):
        with pytest.raises(SystemExit):
            cli.main(["check", str(tmp_path), *options])
    assert asked == [(str(tmp_path), None, tree.SCAN_MOST), (str(tmp_path), 3, 70_000)]


def _names(rel, text):
    return {(n, k, e) for n, k, _, e, _ in parse(rel, text).symbols}


SAMPLES = {
    "A.java": ("public class A extends B { public A() {} private void run() {} }", {("A", "class", True), ("A.A", "method", True), ("A.run", "method", False)}),
    "b.rb": ("class Late < Invoice\n  def total\n    if x then y(1) end\n  end\nend\ndef top; end\n", {("Late", "class", True), ("Late.total", "method", True), ("top", "function", True)}),
    "c.c": ("struct P { int x; };\nstatic int hid(int a) { return a; }\nint shown(int b) { return hid(b); }\n", {("P", "class", True), ("hid", "function", False), ("shown", "function", True)}),
    "d.cpp": ("class S { double area() { return 0; } };", {("S", "class", True), ("S.area", "method", True)}),
    "e.cs": ("public class Svc : Base { private int Run(int a) { return 1; } }", {("Svc", "class", True), ("Svc.Run", "method", False)}),
    "f.php": ("<?php\nclass Inv { public function total() {} private function h() {} }\nfunction tax($x) {}\n", {("Inv", "class", True), ("Inv.total", "method", True), ("Inv.h", "method", False), ("tax", "function", True)}),
    "g.rs": ("pub struct P { x: i32 }\nimpl P { pub fn new() -> P { P { x: 1 } } }\nfn helper() {}\n", {("P", "class", True), ("P.new", "method", True), ("helper", "function", False)}),
    "h.kt": ("class Svc : Base() {\n  fun run(): Int = go(1)\n  private fun go(x: Int): Int { return x }\n}\n", {("Svc", "class", True), ("Svc.run", "method", True), ("Svc.go", "method", False)}),
    "i.swift": ("protocol P { func a() }\nclass S: P {\n  func a() { }\n  private func b() {}\n}\n", {("P", "interface", True), ("P.a", "method", True), ("S", "class", True), ("S.a", "method", True), ("S.b", "method", False)}),
    "j.dart": ("class Inv {\n  int total(int a) { return _h(a); }\n  int _h(int a) => a;\n}\n", {("Inv", "class", True), ("Inv.total", "method", True), ("Inv._h", "method", False)}),
    "k.scala": ("object Main extends App {\n  def run(x: Int): Int = { x }\n}\ntrait T\n", {("Main", "class", True), ("Main.run", "method", True), ("T", "interface", True)}),
    "l.lua": ("function M.total(x) if x then return 1 end end\nlocal function hid() end\n", {("total", "function", True), ("hid", "function", False)}),
    "m.sh": ("deploy() { echo hi; }\nfunction roll { deploy; }\n", {("deploy", "function", True), ("roll", "function", True)}),
    "n.ex": ("defmodule Bill do\n  def total(x) do\n    x\n  end\n  defp tax(x), do: x\nend\n", {("Bill", "class", True), ("Bill.total", "method", True), ("Bill.tax", "method", False)}),
    "o.m": ("@interface Svc : Base\n- (int)run:(int)a;\n@end\n@implementation Svc\n- (int)run:(int)a { return a; }\n@end\n", {("Svc", "class", True), ("Svc.run", "method", True)}),
    "p.ml": ("type t = int\nlet mean xs = sum xs\nlet _hidden = 3\n", {("t", "type", True), ("mean", "function", True), ("_hidden", "variable", False)}),
    "q.zig": ("pub fn build(b: u8) void {}\nfn helper() void {}\n", {("build", "function", True), ("helper", "function", False)}),
}


@pytest.mark.parametrize("rel", SAMPLES)
def test_every_language(rel):
    text, want = SAMPLES[rel]
    assert _names(rel, text) == want
