"""Predicates and scalar functions over tables of strings, the admission gate, and the glob compiler."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from cartolina.functions import text as fn
from cartolina.streaming import admission


def _apply(spark, make, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["out"] for r in rows.select("i", make(F.col("v")).alias("out")).orderBy("i").collect()]


def test_refs(spark):
    """Each rule once on either side."""
    pairs = [
        ("a-", "-a"), ("a/b", "/a/b"), ("a/b/c", "a/b/"), (".a", "a."), ("a.locks", "a.lock"), ("a.b.c", "a..b"), ("x/y", "x//y"), ("a@b{", "a@{b"),
        ("x" * 255, "x" * 256), ("_x", "x\u00a0y"), ("a=b", "a\tb"), ("caf\u00e9", "a\x01b"), ("a!b", "a~b"), ("a%b", "a^b"), ("a;b", "a:b"), ("a+b", "a?b"), ("a#b", "a*b"), ("a]b", "a[b"), ("a|b", "a\\b"), ("a(b", ""),
    ]
    assert _apply(spark, fn.valid_ref, [g for g, _ in pairs]) == [True] * len(pairs)
    assert _apply(spark, fn.valid_ref, [*(b for _, b in pairs), None]) == [False] * (len(pairs) + 1)


def test_targets(spark):
    cases = {
        "kim/tools": ("kim", "tools", None), " \u00a0https://GitHub.com/kim/tools.GIT\n": ("kim", "tools", None), "git@github.com:kim/tools.git": ("kim", "tools", None),
        "ssh://github.com/kim/tools": ("kim", "tools", None), "www.github.com:kim/tools/": ("kim", "tools", None), "kim//tools": ("kim", "tools", None),
        "https://github.com/kim/tools/tree/next/src/a": ("kim", "tools", "next"), "https://github.com/kim/tools/BLOB/v2/x.py": ("kim", "tools", "v2"),
        "github.com/kim/tools/issues/12": ("kim", "tools", None), "kim/tools/tree": ("kim", "tools", None), "kim/.config": ("kim", ".config", None),
        "https://codes.example/kim/tools": None, "kim": None, "": None, "ki_m/tools": None, "kim-/tools": None, "k" * 40 + "/tools": None, "kim/..": None, "kim/to ols": None, None: None,
    }
    got = _apply(spark, fn.repo_target, list(cases))
    assert [(g["owner"], g["repo"], g["ref"]) if g else None for g in got] == list(cases.values())


def test_remotes_slugs_and_clones(spark):
    remote = {"HTTPS://x.y/z": True, "ssh://a": True, "a+b.c-d://x": True, "git@github.com:a/b": True, "GITHUB.com:a/b": True, "www.github.com/a": True, "a/b": False, "1s://x": False, "git@other.org:a/b": False, "github.community/a": False}
    assert _apply(spark, fn.explicit_remote, list(remote)) == list(remote.values())
    assert _apply(spark, fn.ref_slug, ["v1.0_a-b"]) == ["v1.0_a-b"]
    a, b = _apply(spark, fn.ref_slug, ["fix/ /a", "fix-a"])
    assert re.fullmatch("fix-a-[0-9a-f]{8}", a) and b == "fix-a"
    where = lambda c: fn.clone_dir("/c/", F.lit("Kim"), F.lit("Tools"), c)
    assert _apply(spark, where, [None, "next"]) == ["/c/repos/kim/tools", "/c/repos/kim/tools@next"]


def test_bounded_integers(spark):
    values = ["1", "100", "007", "101", "0", "-3", "+3", "3.0", "3e1", "3x", "\t3", "3 ", "", "99999999999999999999", None]
    assert _apply(spark, lambda c: fn.bounded_int(c, 42, 100), values) == [1, 100, 7] + [42] * 12


def test_html_and_ids(spark):
    assert _apply(spark, fn.escape_html, ["<a href=\"x\">&'"]) == ["&lt;a href=&quot;x&quot;&gt;&amp;&#39;"]
    assert _apply(spark, fn.module_of, ["r:a/b.ts:C.d"]) == ["r:a/b.ts"] and _apply(spark, fn.bare_name, ["C.d", "f"]) == ["d", "f"]
    assert _apply(spark, fn.estimated_tokens, ["", "abcde"]) == [0, 2]
    assert _apply(spark, fn.line_count, ["a\nb\n", ""]) == [3, 1]
    assert _apply(spark, fn.ls_remote_head, ["0" * 40 + "\tHEAD\n", "x"]) == ["0" * 40, None]


def test_tail(spark):
    assert _apply(spark, lambda c: fn.output_tail(c.cast("binary"), 3), ["abcdef", "ab"]) == [b"def", b"ab"]


def test_globs():
    hits = lambda g, p: bool(re.match(fn.glob_regex(g), p))
    cases = {"*.log": (["x.log", ".log"], ["a/x.log", "x.logs"]), "**/gen?.py": (["gen1.py", "a/b/genX.py"], ["gen.py", "agen1.py"]), "lib/**": (["lib", "lib/x", "lib/x/y"], ["libs", "a/lib"]), "a**z": (["az", "a/b/z"], ["a/b"]), "x.y": (["x.y"], ["xzy"])}
    for g, (yes, no) in cases.items():
        assert all(hits(g, p) for p in yes) and not any(hits(g, p) for p in no), g


def _gate(spark, events, **limits):
    rows = spark.createDataFrame([("g", i, t, e) for i, (t, e) in enumerate(events)], "gate string, seq long, now_ms long, event string")
    return [(r["status"], r["retry_s"]) for r in admission.admissions(rows, **limits).orderBy("seq").collect()]


def test_admission_by_capacity_then_rate(spark):
    assert _gate(spark, [(0, "start"), (1, "start"), (2, "release"), (3, "start")], most_active=1, most_starts=9, window_ms=60_000) == [(200, None), (503, 15), (200, None), (200, None)]
    assert _gate(spark, [(0, "start"), (1_000, "start"), (60_000, "start")], most_active=9, most_starts=1, window_ms=60_000) == [(200, None), (429, 59), (200, None)]


def test_admission_on_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([("g", i, i * 1000, "start") for i in range(4)], "gate string, seq long, now_ms long, event string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = admission.admissions(stream, most_active=2, most_starts=9, window_ms=60_000).writeStream.format("memory").queryName("gate_out").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert [r["status"] for r in spark.table("gate_out").orderBy("seq").collect()] == [200, 200, 503, 503]
