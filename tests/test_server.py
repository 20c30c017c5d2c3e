"""The tools over a map of small trees, message by message, and the commands."""

from __future__ import annotations

import json

import pytest

from cartolina import cli, server
from cartolina.plans import extract
from cartolina.sources import tree


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    top, out = tmp_path_factory.mktemp("trees"), tmp_path_factory.mktemp("map")
    files = {"one/src/pay.ts": "export class Pay {\n  charge(a) { return tax(a) }\n}\nexport function tax(x) { return x }\n", "one/lib/pay.ts": "export const fee = () => 1\n", "two/bill.py": "def charge():\n    pass\n\ndef lonely():\n    pass\n"}
    for rel, text in files.items():
        (top / rel).parent.mkdir(parents=True, exist_ok=True)
        (top / rel).write_text(text)
    extract.write(extract.build(spark, {"one": str(top / "one"), "two": str(top / "two")}), str(out))
    return top, str(out)


def _ask(held, tool, **given):
    told = json.loads(next(held.serve([json.dumps({"jsonrpc": "2.0", "id": 7, "method": "tools/call", "params": {"name": tool, "arguments": given}})])))
    return told["result"]["content"][0]["text"], told["result"]["isError"]


def test_messages(spark, made):
    held = server.Server(spark, made[1])
    lines = ["", "{", "[]", '{"id": 1, "method": "ping"}', '{"method": "notifications/initialized"}', '{"id": 2, "method": "no"}', '{"id": 3, "method": "tools/call", "params": {"name": "x"}}', '{"id": 4, "method": "initialize"}', '{"id": 5, "method": "tools/list"}']
    told = [json.loads(x) for x in held.serve(lines)]
    assert [(t["id"], t.get("error", {}).get("code")) for t in told] == [(None, -32700), (None, -32600), (1, None), (2, -32601), (3, -32602), (4, None), (5, None)]
    assert [t["name"] for t in told[-1]["result"]["tools"]] == ["brief", "scope", "find_symbol", "module_info", "check_freshness"]


def test_tools(spark, made):
    top, out = made
    held = server.Server(spark, out)
    text, failed = _ask(held, "brief", repo="one")
    assert not failed and "## one (typescript): 2 modules, 4 symbols" in text and "tax [function] src/pay.ts:4" in text and "two" not in text
    found = json.loads(_ask(held, "scope", trace="Error: x\n    at Pay.charge (/app/src/pay.ts:2:3)")[0])
    assert found["anchor"]["resolved"] == "one:src/pay.ts:Pay.charge" and found["anchor"]["confidence"] == "exact" and found["repo"] == "one" and not found["truncated"]
    assert found["suspects"][0]["reasons"] == ["matched the throwing frame", "no references found in this repo"] and "1 hop from the symptom" in found["suspects"][1]["reasons"]
    assert json.loads(_ask(held, "scope", symbol="charge")[0])["anchor"]["confidence"] == "inferred" and json.loads(_ask(held, "scope", symbol="none")[0])["anchor"]["resolved"] is None
    assert [m["id"] for m in json.loads(_ask(held, "find_symbol", name="charge")[0])["matches"]] == ["one:src/pay.ts:Pay.charge", "two:bill.py:charge"]
    told, failed = _ask(held, "module_info", module="pay.ts")
    assert failed and json.loads(told)["candidates"] == ["one:lib/pay.ts", "one:src/pay.ts"]
    told = json.loads(_ask(held, "module_info", module="src\\pay.ts")[0])
    assert told["id"] == "one:src/pay.ts" and [x["other"] for x in told["symbols"]["items"]] == ["Pay", "Pay.charge", "tax"]
    for tool, given in (("module_info", {"module": "zz"}), ("module_info", {}), ("find_symbol", {"name": 3}), ("brief", {"repo": "no"}), ("brief", {"budget": 0}), ("scope", {}), ("find_symbol", {"name": "a", "odd": 1})):
        assert _ask(held, tool, **given)[1], (tool, given)


def test_staleness_and_reload(spark, made, capsys):
    top, out = made
    now = [0.0]
    held = server.Server(spark, out, clock=lambda: now[0])
    assert json.loads(_ask(held, "check_freshness")[0])["fresh"]
    (top / "two" / "bill.py").write_text("def other():\n    pass\n")
    assert "stale_warning" not in json.loads(_ask(held, "find_symbol", name="charge")[0])  # known for a while
    now[0] = 61.0
    assert next(iter(json.loads(_ask(held, "find_symbol", name="charge")[0]))) == "stale_warning" and "WARNING: the map is stale for two" in _ask(held, "brief")[0]
    assert cli.main(["check", str(top), "--out", out]) == 1 and "two  stale" in capsys.readouterr().out
    extract.write(extract.build(spark, {"one": str(top / "one"), "two": str(top / "two")}), out)
    assert json.loads(_ask(held, "find_symbol", name="other")[0])["total"] == 1
    assert cli.main(["check", str(top), "--out", out, "--json"]) == 0 and json.loads(capsys.readouterr().out)["fresh"]
    assert cli.main(["scope", out, "--symbol", "tax"]) == 0 and "one:src/pay.ts:tax" in capsys.readouterr().out


def test_submodules(tmp_path):
    (tmp_path / "sub" / "x").mkdir(parents=True)
    (tmp_path / ".gitmodules").write_text('[submodule "sub"]\n\tpath = sub\n[submodule "gone"]\n\tpath = gone\n')
    own = {"r": str(tmp_path)}
    assert tree.with_submodules(own) == ({"r": str(tmp_path), "sub": str(tmp_path / "sub")}, [str(tmp_path / "sub")], ["r: submodule gone is empty"])
    assert tree.with_submodules(own, "absorb")[:2] == (own, []) and tree.with_submodules(own, "skip")[:2] == (own, [str(tmp_path / "sub")])
