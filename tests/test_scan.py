"""Parsers and traces on small texts."""

from __future__ import annotations

from cartolina.operators import scope
from cartolina.sources import scan, tree


def _names(rel, text):
    return [(name, kind) for name, kind, *_ in scan.parse(rel, text).symbols]


def _calls(rel, text):
    return scan.parse(rel, text).calls


def test_lifetimes_and_characters_open_no_string():
    text = "pub fn f<'a>(x: &'a str) -> &'a str { g(x) }\nstruct S<'a> { x: &'a str }\nfn h() { k('\\'', '\"'); m(\"'\") }\n"
    assert _names("a.rs", text) == [("f", "function"), ("S", "class"), ("h", "function")]
    assert _calls("a.rs", text) == [("f", "g"), ("h", "k"), ("h", "m")]
    assert _names("a.go", "func a() { x := '\"' }\nfunc b() { y := `\"` }\n") == [("a", "function"), ("b", "function")]


def test_words_that_other_languages_reserve_are_names():
    assert _calls("a.js", "function after(){ go(); select(); range(1); match(x) }") == [("after", "go"), ("after", "select"), ("after", "range"), ("after", "match")]
    assert _names("a.js", "function end() {}\nfunction record() {}") == [("end", "function"), ("record", "function")]
    assert [c for _, c in _calls("a.py", "def f():\n    defer()\n")] == ["defer"] and [c for _, c in _calls("a.rs", "fn f() { def(); func() }")] == ["def", "func"]


def test_functions_within_functions():
    text = "function a() { function b() { c() } b() }"
    assert _names("a.ts", text) == [("a", "function"), ("b", "function")] and _calls("a.ts", text) == [("b", "c"), ("a", "b")]
    text = "func a() { x := func() { c() }; x() }"
    assert _names("a.go", text) == [("a", "function")] and _calls("a.go", text) == [("a", "c"), ("a", "x")]
    text = "fn a() { fn b() { c() } b() }"
    assert _names("a.rs", text) == [("a", "function")] and _calls("a.rs", text) == [("a", "c"), ("a", "b")]


def test_template_strings_and_regular_expressions():
    text = "function f() { return `a ${g(`b ${h(1)} }`)} {${{x: k()}.x}` + m() }\nconst r = /['\"`{]/g; function n() { p(a / b, c / d) }"
    assert _calls("a.ts", text) == [("f", "g"), ("f", "h"), ("f", "k"), ("f", "m"), ("n", "p")]
    assert _names("a.ts", text) == [("f", "function"), ("n", "function")]


def test_members_of_classes_and_objects():
    text = """
abstract class A extends ns.Base<T> implements I, J<K> {
  size = measure();
  get x(): number { return top() }
  abstract run(a: { b: string }): { c: string };
  go(): { d: number } { return step(); }
  constructor() { init() }
}
class B extends mixin(C, D) {}
interface E extends F {}
const o = { save() { write() }, async load(a) { read(a) } };
export const sum = (a, b) => add(a, b);
const later = x => twice(x)
last();
"""
    got = scan.parse("a.ts", text)
    assert [s[0] for s in got.symbols] == ["A", "A.run", "A.go", "B", "E", "sum", "later"]
    assert got.bases == [("A", "ns.Base", "extends"), ("A", "I", "implements"), ("A", "J", "implements"), ("B", "mixin(C, D)", "extends")]
    assert ("A", "measure") in got.calls and ("A", "top") in got.calls and ("A.go", "step") in got.calls and ("A", "init") in got.calls
    assert (None, "write") in got.calls and not any(c in ("save", "load", "run") for _, c in got.calls)
    assert ("sum", "add") in got.calls and ("later", "twice") in got.calls and (None, "last") in got.calls


def test_long_heads():
    fields = ", ".join(f"a{i}: number" for i in range(200))
    assert _names("a.ts", f"class A {{ run({fields}) {{ go() }} }}") == [("A", "class"), ("A.run", "method")]
    assert _names("a.java", f"class A extends B<{', '.join(f'T{i}' for i in range(200))}> {{ int run(int a) {{ return 1; }} }}") == [("A", "class"), ("A.run", "method")]


def test_traces(spark):
    lines = ["Error: x", "  at f (a/b.ts:3:1)", "\tat a/b.ts:4", "at g(c.ts:5)", " at\u00a0h (c.ts:6)", "at new T ( C:\\\\x.ts:7) \r", "at native (anonymous)", "at (d.ts:8)", "at nowhere", "atx (e.ts:9)", "at i (e.ts:1:2) [as j]", "at " + "k" * 3000 + " (z.ts:10)"]
    got = scope.parse_traces(spark.createDataFrame([(1, "\n".join(lines))], "trace_id int, text string")).orderBy("frame").collect()
    assert [(r["frame"], r["fn"], r["file"], r["line"]) for r in got] == [
        (1, "f", "a/b.ts", 3), (2, None, "a/b.ts", 4), (3, "g", "c.ts", 5), (5, "new T", "C:\\\\x.ts", 7), (6, "native", None, None), (7, None, "d.ts", 8), (11, "k" * 3000, "z.ts", 10),
    ]


def test_nearest_before_prefers_the_name_then_the_nearest(spark):
    modules = spark.createDataFrame([("r:m/a.ts", "m/a.ts", 0)], "id string, path string, seq long")
    symbols = [("r:m/a.ts:A.run", "A.run", 1, 1), ("r:m/a.ts:f", "f", 5, 2), ("r:m/a.ts:g", "g", 5, 3), ("r:m/a.ts:run", "run", 90, 4)]
    symbols = spark.createDataFrame([(i, n, "r:m/a.ts", line, s) for i, n, line, s in symbols], "id string, name string, module string, line int, seq long")
    frames = [(0, "x.run", 20), (1, "h", 20), (2, None, 5), (3, "h", 1), (4, "run", 95), (5, "g", 2), (6, None, 0)]
    frames = spark.createDataFrame([(1, i, fn, "/abs/m/a.ts", line) for i, fn, line in frames], "trace_id int, frame int, fn string, file string, line int")
    got = {r["frame"]: (r["id"] and r["id"][9:], r["confidence"]) for r in scope.resolve_frames(frames, modules, symbols).collect()}
    assert got == {0: ("A.run", "exact"), 1: ("f", "resolved"), 2: ("f", "resolved"), 3: ("A.run", "resolved"), 4: ("run", "exact"), 5: ("A.run", "resolved"), 6: (None, "none")}


def test_an_unknown_confidence_is_the_least_sure(spark):
    rows = spark.createDataFrame([("a", 0, "x", "odd"), ("b", 1, "y", "none"), ("c", 2, "z", None)], "repo string, repo_seq int, id string, confidence string")
    assert scope.best_anchor(rows).first()["id"] == "y"


def test_folders_that_are_walked(tmp_path):
    for folder in ("src", "out", "env", "obj", "third_party", "node_modules", "docs", ".git", "x.egg-info"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "a.py").write_text("")
    assert list(tree.listed(str(tmp_path))) == ["env/a.py", "obj/a.py", "out/a.py", "src/a.py", "third_party/a.py"]
    deep = tmp_path.joinpath("src", *"abcdefghijklmnop")
    (deep / ".git").mkdir(parents=True)
    (tmp_path / ".git" / "a.py").unlink()
    (tmp_path / ".git").rmdir()
    assert list(tree.find_repos(str(tmp_path))[0].values()) == [str(deep)] and tree.find_repos(str(tmp_path), depth=3)[1]
