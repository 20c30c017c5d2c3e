"""Graph operators on small hand-made graphs."""

from __future__ import annotations

import random

from cartolina.operators import graph, layout, resolve, scope, tools, upkeep


def _frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def _cliques(*sizes):
    names = [[f"{chr(97 + k)}{i}" for i in range(n)] for k, n in enumerate(sizes)]
    edges = [(a, b) for c in names for i, a in enumerate(c) for b in c[:i]]
    edges += [(a[1 if k else 0], b[0]) for k, (a, b) in enumerate(zip(names, names[1:], strict=False))]
    return [n for c in names for n in c], edges


def _communities(spark, nodes, edges):
    found = graph.neighborhoods(_frame(spark, [("r", n) for n in nodes], "repo string, id string"), _frame(spark, [("r", a, b) for a, b in edges], "repo string, `from` string, `to` string"))
    return {r["id"]: r["neighborhood"] for r in found.collect()}


def test_barbell_has_two_communities(spark):
    got = _communities(spark, *_cliques(5, 5))
    assert len(set(got.values())) == 2 and len({got[f"a{i}"] for i in range(5)}) == 1 and got["a0"] == 0


def test_communities_ignore_input_order(spark):
    nodes, edges = _cliques(6, 4, 5)
    random.seed(1)
    mixed = random.sample(edges, len(edges))
    assert _communities(spark, nodes, edges) == _communities(spark, nodes[::-1], mixed)


def test_communities_of_nothing(spark):
    assert _communities(spark, [], []) == {}
    assert _communities(spark, ["x"], []) == {"x": 0}


def test_star_has_one_hub(spark):
    edges = [("c", f"l{i}") for i in range(9)]
    got = {r["id"]: (r["degree"], r["hub"]) for r in graph.hubs(_frame(spark, [("c",), *((b,) for _, b in edges), ("alone",)], "id string"), _frame(spark, edges, "`from` string, `to` string")).collect()}
    assert got["c"] == (9, True) and got["alone"] == (0, False) and sum(h for _, h in got.values()) == 1


def test_parallel_edges_are_one_neighbour(spark):
    edges = _frame(spark, [("a", "b")] * 2 + [("b", "a"), ("a", "a")], "`from` string, `to` string")
    assert sorted(map(tuple, graph.adjacency(edges).collect())) == [("a", "b", 3), ("b", "a", 3)]


def test_labels(spark):
    rows = [("r", 0, "src/billing/invoice.ts"), ("r", 0, "src/billing/tax.ts"), ("r", 1, "src/auth/login.ts"), ("r", 1, "lib/util.ts"), ("r", 2, "a.ts"), ("r", 3, "src/a/x.ts"), ("r", 3, "src/b/y.ts")]
    got = {r["neighborhood"]: r["label"] for r in graph.neighborhood_labels(_frame(spark, rows, "repo string, neighborhood int, path string")).collect()}
    assert got == {0: "src/billing", 1: "lib", 2: "neighborhood 2", 3: "src"}


def test_walk_is_cut_at_its_budget(spark):
    edges = _frame(spark, [("a", "b", 1), ("a", "c", 2), ("c", "d", 3)], "`from` string, `to` string, seq long")
    found, cut = graph.walk(edges, "a", 2, 2)
    assert [r["id"] for r in found.orderBy("rank").collect()] == ["a", "b"] and cut
    found, cut = graph.walk(edges, "a", 2, 40)
    assert {r["id"]: r["hops"] for r in found.collect()} == {"a": 0, "b": 1, "c": 1, "d": 2} and not cut


def test_calls_resolve_only_if_unique(spark):
    symbols = _frame(spark, [("r", "m1:f", "f", "m1"), ("r", "m2:f", "f", "m2"), ("r", "m2:g", "g", "m2"), ("r", "m2:C.h", "C.h", "m2"), ("r", "m3:h", "h", "m3")], "repo string, id string, name string, module string")
    calls = _frame(spark, [("r", "m1:x", "m1", c) for c in ("f", "g", "h", "C.h", "none")] + [("r", "m3:x", "m3", "f")], "repo string, `from` string, module string, callee string")
    assert {(r["from"], r["to"]) for r in resolve.resolved_calls(symbols, calls).collect()} == {("m1:x", "m1:f"), ("m1:x", "m2:g"), ("m1:x", "m2:C.h")}


def test_heritage_takes_ids_then_the_last_name(spark):
    symbols = _frame(spark, [("r", "a:B", "B", 1), ("r", "b:B", "B", 2)], "repo string, id string, name string, seq long")
    edges = _frame(spark, [("r", "x", "B", "extends"), ("r", "y", "a:B", "extends"), ("r", "z", "Q", "extends")], "repo string, `from` string, `to` string, kind string")
    assert {(r["from"], r["to"]) for r in resolve.heritage_ids(edges, symbols).collect()} == {("x", "b:B"), ("y", "a:B")}


MODULES = [("r", "r:src/payment.ts", "src/payment.ts", 0), ("r", "r:src/cart.ts", "src/cart.ts", 1)]
SYMBOLS = [
    ("r", "r:src/payment.ts:PaymentService", "PaymentService", "class", "r:src/payment.ts", 1, None, 0, 1),
    ("r", "r:src/payment.ts:PaymentService.charge", "PaymentService.charge", "method", "r:src/payment.ts", 2, "r:src/payment.ts:PaymentService", 1, 2),
    ("r", "r:src/payment.ts:refund", "refund", "function", "r:src/payment.ts", 4, None, 0, 3),
    ("r", "r:src/cart.ts:handleCheckout", "handleCheckout", "function", "r:src/cart.ts", 1, None, 0, 4),
]


def _graph(spark):
    modules = _frame(spark, MODULES, "repo string, id string, path string, seq long")
    symbols = _frame(spark, SYMBOLS, "repo string, id string, name string, kind string, module string, line int, parent string, refCount int, seq long")
    edges = _frame(spark, [("r", "r:src/cart.ts", "r:src/payment.ts", "imports", "resolved", 1)], "repo string, `from` string, `to` string, kind string, confidence string, seq long")
    return modules, symbols, edges


def test_frames_resolve_by_the_ladder(spark):
    modules, symbols, _ = _graph(spark)
    text = "Error: boom\n  at PaymentService.charge (/app/src/payment.ts:3:9)\n  at /app/src/payment.ts:5\n  at handleCheckout (native)\n  at nowhere (x)\nat refund (/app/src/payment.ts:1:1)"
    frames = scope.parse_traces(_frame(spark, [(1, text)], "trace_id int, text string"))
    got = [(r["fn"], r["line"], r["id"] and r["id"].rsplit(":", 1)[1], r["confidence"]) for r in scope.resolve_frames(frames, modules, symbols).orderBy("frame").collect()]
    assert got == [("PaymentService.charge", 3, "PaymentService.charge", "exact"), (None, 5, "refund", "resolved"), ("handleCheckout", None, "handleCheckout", "inferred"), ("nowhere", None, None, "none"), ("refund", 1, "PaymentService", "resolved")]


def test_suspects_are_ranked_by_distance(spark):
    found, cut = scope.suspects(*_graph(spark), "r:src/payment.ts:PaymentService.charge", 1)
    assert [(r["name"], r["score"]) for r in found.collect()] == [("PaymentService.charge", 1.0), ("PaymentService", 0.5)] and not cut
    assert scope.named_anchor(_graph(spark)[1], "handleCheckout") == ("r:src/cart.ts:handleCheckout", "inferred")
    assert scope.named_anchor(_graph(spark)[1], "unknown") == (None, "none")


def test_find_symbol_prefers_exact_names(spark):
    modules, symbols, _ = _graph(spark)
    assert [r["name"] for r in tools.find_symbol(symbols, modules, "charge").collect()] == ["PaymentService.charge"]
    assert {r["name"] for r in tools.find_symbol(symbols, modules, "payment").collect()} == {"PaymentService", "PaymentService.charge"}
    assert tools.find_symbol(symbols, modules, "payment", exact=True).count() == 0


def test_fingerprint_ignores_order_and_sees_content(spark):
    files = lambda rows: upkeep.fingerprints(_frame(spark, rows, "repo string, rel string, content binary")).first()["sourceFingerprint"]
    a = [("r", "x.py", b"1"), ("r", "y.py", b"2")]
    assert files(a) == files(a[::-1]) != files([("r", "x.py", b"1"), ("r", "y.py", b"3")])


def test_eviction_goes_oldest_first(spark):
    entries = _frame(spark, [("new", 300, 40), ("old", 100, 40), ("mid", 200, 40), ("mia", 200, 0)], "path string, mtimeMs long, bytes long")
    gone = lambda most: [r["path"] for r in upkeep.planned_eviction(entries, most).orderBy("mtimeMs", "path").collect()]
    assert gone(80) == ["old"] and gone(40) == ["old", "mia", "mid"] and gone(200) == []


def test_statuses(spark):
    a = _frame(spark, [("f", "1"), ("s", "1"), ("u", None), ("r", "1")], "repo string, sourceFingerprint string")
    b = _frame(spark, [("f", "1"), ("s", "2"), ("u", "1"), ("n", "1")], "repo string, sourceFingerprint string")
    told = upkeep.statuses(a, b)
    assert {r["repo"]: r["status"] for r in told.collect()} == {"f": "fresh", "s": "stale", "u": "unknown", "r": "removed", "n": "new"}
    assert not upkeep.all_fresh(told).first()["fresh"] and not upkeep.all_fresh(told.limit(0)).first()["fresh"] and upkeep.all_fresh(told.where("repo = 'f'")).first()["fresh"]


def test_layout_is_deterministic(spark):
    nodes = _frame(spark, [("r", f"n{i}", 12.0, None, None) for i in range(12)], "repo string, id string, radius double, ax double, ay double")
    links = _frame(spark, [("r", f"n{i}", f"n{i // 2}") for i in range(1, 12)], "repo string, `from` string, `to` string")
    runs = [{r["id"]: (r["x"], r["y"]) for r in layout.placed(n, links).collect()} for n in (nodes, nodes.orderBy("id", ascending=False))]
    assert runs[0] == runs[1] and len(set(runs[0].values())) == 12


def test_forces_by_cells_are_near_those_by_pairs(monkeypatch):
    import numpy as np

    from cartolina.operators import layout

    r = np.random.default_rng(5)
    at = np.concatenate([r.normal(0, 300, (500, 2)), r.normal(900, 20, (300, 2)), np.zeros((5, 2))])
    radius = r.uniform(10, 40, len(at))
    by_cells, apart = layout._repelled(at, -3.0), layout._parted(at, radius)
    i, j = layout.near_pairs(at, 50.0)
    found = set(zip(i.tolist(), j.tolist()))
    near = np.argwhere((((at[:, None] - at[None]) ** 2).sum(axis=2) < 2500) & ~np.eye(len(at), dtype=bool))
    assert len(found) == len(i) and {tuple(p) for p in near.tolist()} <= found
    monkeypatch.setattr(layout, "PAIRS", 10_000)
    exact = layout._repelled(at, -3.0)
    assert np.linalg.norm(by_cells - exact) < 0.1 * np.linalg.norm(exact) and np.allclose(apart, layout._parted(at, radius))


def test_kept_pairs_hold_while_nodes_move():
    import numpy as np

    r = np.random.default_rng(8)
    at, radius, near, kept = r.normal(0, 300, (900, 2)), r.uniform(5, 25, 900), layout.Near(), 0
    for step in (40, 3, 1, 1, 1, 0.2, 30, 1, 0.5):
        at = at + r.uniform(-step, step, at.shape) / 2
        was = near.kept
        order, parts = near.parts(at, 60.0)
        found = [tuple(sorted(p)) for i, j in parts for p in zip(order[i].tolist(), order[j].tolist())]
        want = np.argwhere(np.triu(((at[:, None] - at[None]) ** 2).sum(axis=2) < 3600, 1))
        assert len(found) == len(set(found)) and {tuple(p) for p in want.tolist()} <= set(found)
        kept += was is not None and near.kept is was
        assert np.allclose(layout._parted(at, radius, near), layout._parted(at, radius))
    assert kept > 2


def test_a_tick_of_a_large_group_costs_less_than_all_pairs():
    import time

    import numpy as np

    n, r = 3840, np.random.default_rng(0)
    links, none = np.stack([r.integers(0, n - 240, 6000), r.integers(n - 240, n, 6000)], axis=1), np.full(n, np.nan)
    began = time.process_time()
    at = layout.simulate(np.full(n, 12.0), none, none, links, ticks=60)
    took, began = time.process_time() - began, time.process_time()
    for b in range(0, n, 256):
        gap = at[None] - at[b : b + 256, None]
        (gap / np.maximum((gap**2).sum(axis=2), 1.0)[:, :, None]).sum(axis=1)
    assert took / 60 < (time.process_time() - began) / 12
