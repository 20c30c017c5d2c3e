"""Each operator for training data against a brute-force version, and on nulls, empty and odd rows."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cartolina.llm import bpe, exact_dedup, jaccard, language_id, license_scan, mixing, pii, queries, suffix_dedup, topk, toxicity

R = random.Random(7)
WORDS = ["".join(R.choice("abcdefghij") for _ in range(R.randint(2, 8))) for _ in range(300)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string"


def prose(n: int) -> str:
    return " ".join(R.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """Copies, near copies, shared passages, a text that repeats itself, odd and empty ones."""
    passage, long = prose(40), prose(200)
    out = [prose(R.randint(1, 80)) for _ in range(40)]
    out += [prose(10) + " " + passage + " " + prose(10) for _ in range(6)]
    out += [long, long.upper(), long.replace(WORDS[0], "zz"), " ".join(long.split()[:190]), long]
    for _ in range(30):  # a family of near copies, each of its own
        w = long.split()
        w[R.randrange(len(w))] = R.choice(WORDS)
        out.append(" ".join(w))
    out += ["ab " * 120, "é" * 90 + passage, None, "", " \t\n", "one two", "ONE  two", "x" * 400]
    return list(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ["en", "de", None][i % 3], [None, "a", "b", "b"][i % 4], len(t or ""), "clash") for i, t in texts]
    return spark.createDataFrame(rows + [(None, "a null id", "en", "a", 9, "clash")], SCHEMA).repartition(3)


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def words(t):
    return [w for w in re.split("[ \t-\r]+", low(t)) if w]


# Exact dedup


def test_exact_dedup(docs, texts):
    groups = collections.defaultdict(list)
    for i, t in [*texts, (None, "a null id")]:
        groups[low(t)].append(i)
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(docs, capacity=2000).collect()}
    assert len(got) == len(texts) + 1
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"], got[i]["text_sha256"]) == (keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest())
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


def test_directory_splits_only_full_buckets():
    cells = exact_dedup.directory({0: 10, 1: 10, 8: 1}, capacity=10, max_depth=4)
    assert len(cells) == 16 and cells[0] != cells[1] and len(set(cells[8:])) == 1 and cells == sorted(cells)
    assert exact_dedup.directory({3: 5}, capacity=10, max_depth=4) == [0]


def test_exact_dedup_of_a_hot_group_and_many_buckets(spark, monkeypatch):
    texts = ["hot" if i % 3 else f"text {i % 700}" for i in range(3000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    want = {i: (max(j for j, u in enumerate(texts) if u == t), texts.count(t)) for i, t in enumerate(texts)}
    got = lambda: {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(docs, capacity=300).collect()}
    assert got() == want
    monkeypatch.setattr(exact_dedup, "MOST_BITS", 2)
    assert got() == want


def test_chain_compares_bytes():
    import pyarrow as pa
    import zstandard

    entry = lambda key, body, n, top: (key, body, zstandard.compress(body), n, top)
    rows = [entry(1, b"a", 2, 5), entry(1, b"b", 1, 9), entry(1, b"a", 1, 7)]
    batch = pa.record_batch([pa.array([r[i] for r in rows]) for i in range(5)], names=["key", "sha", "body", "n", "max_id"])
    got = [x for b in exact_dedup._chains(iter([batch])) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert sorted(got) == [(b"a", 7, 3), (b"b", 9, 1)]


# Jaccard join


def brute_components(rows, k=4, percent=85):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in ids}


@pytest.mark.parametrize(("k", "percent", "group"), [(4, 85, 256), (4, 85, 3), (5, 80, 256)])
def test_jaccard_components(docs, texts, k, percent, group):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs, k=k, percent=percent, group=group).where("doc_id is not null").collect()}
    assert got == brute_components(texts, k, percent)


@pytest.mark.parametrize("bits", [1, 5])
def test_sets_with_one_handle_stay_apart(docs, texts, bits):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs, bits=bits).where("doc_id is not null").collect()}
    assert got == brute_components(texts)


@pytest.mark.parametrize(("group", "asked"), [(4, 2), (4, 512), (256, 512)])
def test_jaccard_of_a_large_group_whose_members_do_not_link_to_the_leader(spark, group, asked):
    """Texts that share their seldom words but differ otherwise, with families among them, and near copies from other groups."""
    r = random.Random(21)
    shared = [f"shared{i}" for i in range(12)]
    rows = []
    for f in range(25):
        own = [f"f{f}w{i}" for i in range(60)]
        for j in range(3):
            w = shared + own
            if j:
                w[r.randrange(len(w))] = f"x{f}{j}"
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + i, " ".join(f"y{i % 3}{j}" for j in range(50 + i // 9))) for i in range(27)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard.jaccard_components(docs, group=group, asked=asked).collect()}
    assert got == brute_components(rows)


def test_stored_unions_turn_no_link_away():
    r = random.Random(22)
    for _ in range(300):
        base = np.array(r.sample(range(1, 1 << 62), 80), np.uint64)
        change = lambda n: np.sort(np.concatenate([base[n:], np.array(r.sample(range(1, 1 << 62), n), np.uint64)]))
        members = [(i, change(r.randrange(9)), False) for i in range(4)]
        query = change(r.randrange(9))
        sizes = [len(m[1]) for m in members]
        may = jaccard.may_link(query, jaccard.union_of(members), min(sizes), max(sizes), 85)
        assert may or not jaccard.Group(members, 85).links(9, query)
    assert not jaccard.may_link(query + np.uint64(1 << 40), jaccard.union_of(members), 80, 80, 85) and not jaccard.may_link(query, jaccard.union_of(members), 200, 300, 85)


def test_jaccard_at_the_threshold(spark):
    base = [f"w{i}" for i in range(43)]
    at = lambda n: " ".join(base[:n] + [f"x{n}{i}" for i in range(40 - n)])
    rows = [(i, " ".join(base[:40]) if i == 0 else at(38 - i)) for i in range(8)] + [(9, " ".join(base[:43]))]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_bound_never_turns_a_link_away():
    for a in range(1, 120):
        for b in range(-(-85 * a // 100), 100 * a // 85 + 1):
            o = jaccard.needed(a, b, 85)
            assert 100 * o >= 85 * (a + b - o) and (o == 0 or 100 * (o - 1) < 85 * (a + b - o + 1))
            assert jaccard.prefix_size(a, 85) - (a - o) >= 1


# Components


def test_components_of_long_shuffled_chains(spark):
    from cartolina.llm.components import components

    r = random.Random(11)
    ids = r.sample(range(10_000), 1001)
    turned = [20_000, *range(20_099, 20_000, -1)]
    edges = [*zip(ids, ids[1:], strict=False), *zip(turned, turned[1:], strict=False), (30_000, 30_000), (30_002, 30_001), (30_001, 30_002), (None, 5), (5, None)]
    got = {x["id"]: x["component_id"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == dict.fromkeys(ids, min(ids)) | dict.fromkeys(turned, 20_000) | {30_000: 30_000, 30_001: 30_001, 30_002: 30_001}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# Suffix dedup


def brute_removed(rows):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(w)
        runs = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]
        out[i] = (len(b), bytes(x for x, g in zip(b, gone, strict=True) if not g), runs)
    return out


@pytest.mark.parametrize("buckets", [1, 5, 300])
def test_suffix_dedup(docs, texts, buckets):
    got = {r["doc_id"]: (r["n_bytes"], bytes(r["kept"]), [(s["s"], s["e"]) for s in r["spans"]]) for r in suffix_dedup.suffix_dedup(docs, buckets=buckets).collect()}
    assert got == brute_removed([*texts, (None, "a null id")])


@pytest.mark.parametrize("piece", [1 << 20, 150, 700])
def test_suffix_dedup_of_a_common_line(spark, piece):
    """A line that many documents of one task share, some of them repeated as whole rows, and texts that are cut into pieces."""
    line = prose(30)
    rows = [(i, f"{prose(9)} {line} {prose(9)}") for i in range(40)]
    rows = [rows[0]] * 4 + rows + [(99, " ".join([line] * 9))]
    for parts in (1, 3):
        got = {r["doc_id"]: (r["n_bytes"], bytes(r["kept"]), [(s["s"], s["e"]) for s in r["spans"]]) for r in suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string").coalesce(parts), piece=piece).collect()}
        assert got == brute_removed(dict(rows).items())


def test_suffix_dedup_of_repeated_rows(spark):
    t = prose(60)
    rows = spark.createDataFrame([(1, t), (1, t), (2, t), (1, t + " more words at its end")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_bytes"], len(r["kept"])) for r in suffix_dedup.suffix_dedup(rows).collect())
    assert got[:2] == [(1, len(t), len(t))] * 2 and got[3][2] == 0
    assert suffix_dedup.suffix_dedup(rows.limit(0)).count() == 0


def test_multikey_quicksort():
    r = np.random.default_rng(1)
    w = r.integers(0, 3, (3000, 5)).astype(np.uint64)
    got = w[suffix_dedup.multikey_quicksort(w, small=8)].tolist()
    assert got == sorted(w.tolist())


def test_long_texts_are_cut_into_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 150)
    rows = [((0, 0), prose(90).encode())]
    one = [p for p in suffix_dedup._pieces(iter(rows))]
    starts = {f + s for keys, froms, parts in one for p, f in zip(parts, froms, strict=True) for s in range(len(p) - 99)}
    assert starts == set(range(len(rows[0][1]) - 99))


# PII


def test_base_spans_against_the_patterns():
    r = random.Random(3)
    samples = ["a@b.c@d.e x@y", "1.2.3.4.5.6.7.8 256.1.1.1 01.02.003.4", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (327) 555-3642 +12", "@a.b a@b a@-.-", "", "+49 89 1234567 . 1.2.3.4@x.de"]
    samples += ["".join(r.choice("ab@.+-1239 4()") for _ in range(60)) for _ in range(400)]
    for t in samples:
        want = [(*m.span(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        want += [(*m.span(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
        digits = lambda m: re.sub("[^0-9]", "", m[0])
        want += [(*m.span(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
        want += [(*m.span(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m)) <= 15]
        assert pii.base_spans(t) == sorted(want, key=lambda x: (x[0], pii.KINDS.index(x[2]))), t


def test_long_runs_are_linear():
    for t in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "+1" + " " * 200_000, "a@" * 100_000):
        pii.base_spans(t)


def test_secrets_are_whole():
    for n in (6, 200, 201, 5000):
        t = f"see token={'a.B-9' * 1000}"[: 10 + n] + "; more"
        assert pii.candidates(t, []) == [(10, 10 + n, "secret")]
    for t in ('token = "04db 9x!"', "token = '04db 9x!'", 'TOKEN:"04db 9x!"', "{'token': '04db 9x!'}", 'token="04db 9x!'):
        assert [t[s:e] for s, e, _ in pii.candidates(t, [])] == ["04db 9x!"]
    for t in ("token=" * 50_000, 'token="' * 50_000, "a-" * 100_000 + "=", "12-" * 100_000, "AB12" * 50_000, "(12) " * 50_000):
        pii.candidates(t, [])


def naive_candidates(text, base):
    found = [(*m.span(), kind) for kind, shape in pii._BROAD.items() for m in shape.finditer(text)]
    found += [(*m.span(), "secret") for m in pii._RUN.finditer(text) if re.search("[0-9]", m[0]) or m[0].startswith("AKIA")]
    found += [(*next((m.span(i) for i in (2, 3, 4) if m[i] is not None)), "secret") for m in pii._ASSIGNED.finditer(text)]
    out = []
    for s, e, kind in sorted(found, key=lambda x: (x[0], -x[1], -pii._pattern(x[2], text[x[0] : x[1]]), pii.KINDS.index(x[2]))):
        if all(e <= a or s >= b for a, b, _ in base + out):
            out.append((s, e, kind))
    return out


def test_final_spans_against_brute_force(spark):
    """Labelers' rates and the classifier's weights recomputed from every single span, with plain loops."""
    r = random.Random(12)
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    parts = [
        lambda: f'token = "{hexes(40)}"', lambda: f"api_key={hexes(32)}", lambda: f"size: {r.randrange(10**6)} units", lambda: f"on 20{digits(2)}-{digits(2)}-{digits(2)}",
        lambda: f"call 555-{digits(3)}-{digits(4)}", lambda: f"ssn 123-{digits(2)}-{digits(4)}", lambda: f"build {hexes(18)}", lambda: f"a{digits(2)}@mail.example.com",
        lambda: f"+1 (327) 555-{digits(4)}", lambda: f"10.{digits(2)}.1.2", lambda: "note: something quite long", lambda: f"price $ {digits(3)} {digits(4)}", lambda: f"n{digits(20)}",
    ]
    rows = [(i, " ".join(x for _ in range(r.randint(1, 6)) for x in (prose(2), r.choice(parts)()))) for i in range(250)]
    spans = {i: [(x, base) for base, xs in ((True, pii.base_spans(t)), (False, naive_candidates(t, pii.base_spans(t)))) for x in xs] for i, t in rows}
    told = [(pii.votes(t, *x), pii.features(t, *x)) for i, t in rows for x, _ in spans[i]]
    q = [(sum(v == 1 for v in vs) + 1) / (sum(v >= 0 for v in vs) + 2) for vs, _ in told]
    for _ in range(50):
        rate = [[(sum(w for w, (vs, _) in zip(ws, told) if vs[j] == 1) + first) / (sum(w for w, (vs, _) in zip(ws, told) if vs[j] >= 0) + 5) for j in range(len(pii.LABELERS))]
                for ws, first in (([1 - x for x in q], 1), (q, 4))]
        prior = (sum(q) + 1) / (len(q) + 2)
        of = {}
        for vs in {vs for vs, _ in told}:
            log = [np.log(p) + sum(np.log(rate[c][j] if v else 1 - rate[c][j]) for j, v in enumerate(vs) if v >= 0) for c, p in ((0, 1 - prior), (1, prior))]
            of[vs] = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        q = [of[vs] for vs, _ in told]
    x, q = pii._dense(np.array([f for _, f in told])), np.array(q)
    w = np.zeros(x.shape[1])
    for _ in range(300):
        w -= 4.0 * (x.T @ (1 / (1 + np.exp(-x @ w)) - q) / len(q) + 1e-4 * w)
    good = {f for (_, f), p in zip(told, 1 / (1 + np.exp(-x @ w))) if p >= 0.5}
    want = {i: sorted((x for x, base in spans[i] if base or pii.features(t, *x) in good), key=lambda x: (x[0], pii.KINDS.index(x[2]), x[1])) for i, t in rows}
    got = {d["doc_id"]: [(s["s"], s["e"], s["kind"]) for s in d["spans"]] for d in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want
    added = {t[s:e] for i, t in rows for s, e, kind in got[i] if kind == "secret"}
    assert all(m in added for _, t in rows for m in re.findall('token = "([^"]*)"', t)) and not any(x.startswith("something") for x in added)


def test_votes_add_spans_and_keep_base_ones(spark):
    rows = [(i, f"write mail to a{i}@mail.example.com or call {200 + i}-555-{1000 + i}, key AKIA{'ABCDEFGH' * 2}") for i in range(60)] + [(60, None), (61, "")]
    got = {r["doc_id"]: [(s["kind"], s["base"]) for s in r["spans"]] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[60] == got[61] == [] and got[0][0] == ("email", True) and ("secret", False) in got[0] and ("local_phone", False) in got[0]


def test_em_finds_the_reliable_labeler():
    patterns = np.array([[1, 1, 1, 1, 1, -1], [0, 0, 0, -1, -1, 0], [1, 0, 0, -1, -1, 0], [1, 1, 1, -1, -1, -1]])
    rate, q = pii.reliabilities(patterns, np.array([50.0, 50, 50, 50]))
    assert q[0] > 0.9 and q[3] > 0.9 and q[1] < 0.1 and q[2] < 0.5 and rate[1][1] > rate[0][1]


# Mixing


def test_targets():
    got = mixing.targets([100, 100, 100], [5, 2, 1])
    assert got[0] == 200.0 and abs(sum(got) - 450) < 1e-9 and abs(got[1] - 2 * got[2]) < 1e-9 and mixing.targets([0, 0], [5, 2]) == [0.0, 0.0]


def brute_mix(rows, block, resolved):
    """(id, size, source): words taken, first slot, number of slots; slots are drawn one after the other. Shuffled order as given."""
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(n for _, n, x in rows if x == s) for s in sources]
    words = [int(t) for t in mixing.targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(sources))])]
    drawn = [w >= resolved * block for w in words]
    total = sum(w for w, d in zip(words, drawn) if d)
    slots, j = [], 0
    for j in range(-(-total // block)):
        u, at = (j + 0.5) * mixing.GOLDEN % 1.0, 0
        for s, w in enumerate(words):
            if drawn[s]:
                if at / total <= u < ((at + w) / total if at + w < total else 2):
                    slots.append(s)
                at += w
    due = [min(2 * n, slots.count(s) * block) if drawn[s] else w for s, (n, w) in enumerate(zip(sizes, words))]
    for s, w in enumerate(words):
        if not drawn[s]:
            slots += [s] * -(-w // block)
    out = {i: [0, None, 0] for i, _, _ in rows}
    for s, name in enumerate(sources):
        stream = [i for i, n, x in rows if x == name for _ in range(n)] * 2
        blocks = [stream[k : min(k + block, due[s])] for k in range(0, due[s], block)]
        for slot, b in zip([j for j, x in enumerate(slots) if x == s], blocks):
            for i in dict.fromkeys(b):
                out[i] = [out[i][0] + b.count(i), min(slot, out[i][1] if out[i][1] is not None else slot), out[i][2] + 1]
    return {i: tuple(x) for i, x in out.items()}


@pytest.mark.parametrize(("block", "resolved"), [(16, 1024), (16, 3), (5, 20), (None, 1024)])
def test_mix_against_slots_drawn_one_by_one(docs, texts, block, resolved):
    mixed = mixing.mix(docs, block=block, resolved=resolved)
    got = mixed.documents().collect()
    sizes = {i: len([w for w in re.split("[ \t-\r]+", t or "") if w]) for i, t in texts} | {None: 3}
    order = {r["doc_id"]: (r["place"], r["doc_id"] is not None, r["doc_id"] or 0) for r in mixed.docs.collect()}
    rows = sorted(((r["doc_id"], sizes[r["doc_id"]], r["source"]) for r in got), key=lambda x: order[x[0]])
    assert len(got) == len(texts) + 1 and all(r["size"] == sizes[r["doc_id"]] and 0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert {r["doc_id"]: (r["taken"], r["first_slot"], r["n_slots"]) for r in got} == brute_mix(rows, mixed.block, resolved)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(5), block=block, resolved=resolved).documents().collect()))


def test_drawn_sources_come_near_their_targets(spark):
    sizes = spark.range(4000).selectExpr("id as doc_id", "repeat('w ', cast(id % 40 as int)) as text", "concat('s', id % 7) as source")
    by = collections.defaultdict(int)
    got = mixing.mix(sizes).documents().collect()
    for r in got:
        by[r["source"], r["target"]] += r["taken"]
    assert len(by) == 7 and all(abs(n - t) <= 8 for (_, t), n in by.items()) and any(n != int(t) for (_, t), n in by.items())


def test_mix_of_nothing(docs):
    assert mixing.mix(docs.limit(0)).documents().count() == 0
    assert [r["taken"] for r in mixing.mix(docs.where("text is null")).documents().collect()] == [0]


# Top k


def test_top_k(spark):
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in r.normal(size=9)]) for i in range(400)] + [(400, None), (401, [float("nan")] * 9), (402, [None] * 9), (403, [float("inf")] * 9), (404, []), (405, [0.5] * 9), (406, [0.5] * 9)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, block=3).collect()
    vectors = {i: [int(np.floor(1024 * x)) for x in v] for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q in vectors:
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(vectors[q], v, strict=False)), i) for i, v in vectors.items() if i != q)[:10]
            want += [(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    assert sorted(tuple(x) for x in got) == sorted(want)


def test_shard_bounds_lose_nothing():
    r = np.random.default_rng(3)
    rows = r.integers(-50, 50, (20, 500))
    shard = topk.Shard(np.arange(500), rows)
    q = r.integers(-50, 50, 20)
    score = q @ rows
    ids, scores = shard.best(-1, q, 10, int(np.sort(score)[-10]))
    assert set(np.flatnonzero(score >= np.sort(score)[-10])) <= set(ids.tolist()) and all(score[i] == s for i, s in zip(ids, scores, strict=True))


# BPE


@pytest.fixture(scope="module")
def vocabulary():
    pytest.importorskip("public_tokenizers")
    return queries.vocabulary()


def test_bpe_round_trip_against_the_library(vocabulary, texts):
    from tokenizers import Tokenizer

    library, codec = Tokenizer.from_file(vocabulary), bpe.Codec(open(vocabulary, "rb").read())
    odd = ["Hello World's it's I'll", "a\x1cb \x1d c", "x\x85y\xa0z　q", "İstanbul ΣΑΣ ΟΔΟΣ", "é <|endoftext|>Hi<|startoftext|> <|endoftext", "漢字 かな ½ ² Ⅷ 12345", "K Å ﬁ ẞ", "a​b﻿c", "😀👍🏽 'S", "\x00\x01\x7f", "aaaa" * 200, "...!!!--- ´`^~"]
    r = random.Random(5)
    odd += ["".join(r.choice("abcdeéüß '.!?1 ") for _ in range(80)) for _ in range(150)]
    every = odd + [t or "" for _, t in texts]
    for t, (ids, decoded) in zip(every, codec.encode(every), strict=True):
        want = library.encode(t, add_special_tokens=False).ids
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == want, t
        assert decoded == library.decode(want, skip_special_tokens=False) == codec.decode(ids)


def test_bpe_frame(docs, vocabulary):
    got = {r["doc_id"]: (r["n_tokens"], r["decoded"]) for r in bpe.encode(docs, vocabulary).collect()}
    assert got[next(i for i in got if i is not None and got[i][0] == 0)] == (0, "") and len(got) == docs.count()


# License scan


def test_license_scan(spark):
    notice = license_scan.TEMPLATES["mit-text"]
    rows = [(1, None), (2, ""), (3, "The MIT license, apache LICENSE; MIT-license"), (3, "x"), (4, f"a b {notice} c"), (5, notice.replace("free of charge", "at no cost")), (6, "general public general public license"), (7, "mıt license"), (8, notice[:80]), (None, "mit license")]
    got = {(r["doc_id"], r["n_words"]): r for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows) and got[(1, 0)]["first_word"] is None and got[(1, 0)]["labels"] == "" and got[(1, 0)]["score"] == 0
    r = got[(3, 7)]
    assert (r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (3, 1, 5, "apache,mit")
    assert all("mit-text" in r["labels"].split(",") for (i, _), r in got.items() if i in (4, 5)) and got[(6, 5)]["n_base"] == 1 and got[(7, 2)]["n_base"] == 0
    assert all("mit-text" not in r["labels"] for (i, _), r in got.items() if i == 8) and got[(None, 2)]["base_labels"] == "mit"
    span = license_scan.license_spans(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id = 4 and label = 'mit-text'").first()
    assert span["first_word"] == 2 and span["cover"] == 1.0


def test_license_base_columns_against_brute_force(spark):
    r = random.Random(31)
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    bits = ["mit", "MIT", "license", "License,", "apache", "general", "public", "\u00e9t\u00e9", "mit-license", "x1", "_", "general\npublic license"]
    rows = [(i, " ".join(r.choice(bits) for _ in range(r.randint(0, 40)))) for i in range(300)]
    for x in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect():
        w = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(rows[x["doc_id"]][1]))
        at = sorted((i, label) for p, label in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        places = [i for i, _ in at]
        want = (len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({label for _, label in at})))
        assert (x["n_words"], x["n_base"], x["first_word"], x["last_word"], x["base_labels"]) == want
        assert {label for _, label in at} <= set(x["labels"].split(",")) and 0 <= x["score"] <= 1


def test_notices_with_changed_words_against_every_alignment(spark):
    """A notice with some words replaced has the label if, and where, enough of its words still stand in line."""
    r = random.Random(32)
    notice = license_scan.TEMPLATES["mit-text"].split()
    rows = []
    for i in range(60):
        w = [x if r.random() > i / 60 else f"z{r.randrange(99)}" for x in notice]
        before = r.randint(0, 30)
        rows.append((i, " ".join([f"y{r.randrange(99)}" for _ in range(before)] + w)))
    spans = {x["doc_id"]: x["first_word"] for x in license_scan.license_spans(spark.createDataFrame(rows, "doc_id long, text string")).where("label = 'mit-text'").collect()}
    share = lambda t: max(sum(a == b for a, b in zip(t[k:], notice)) for k in range(len(t))) / len(notice)
    for i, text in rows:
        kept = share(text.split())
        assert i in spans if kept > 0.95 else i not in spans if kept < 0.3 else True, (i, kept)


def test_notices_in_a_row(spark):
    texts = ["All rights reserved. " * 5, "// SPDX-License-Identifier: MIT\n" * 4, "Licensed under the " * 300, "All rights reserved", "a b c d e f x y " * 6 + "a b c d e f g h i j"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan.license_scan(docs.where("doc_id < 4")).collect()}
    assert got == {0: ("rights-reserved", 1.0), 1: ("spdx", 1.0), 2: ("licensed-under", 1.0), 3: ("rights-reserved", 1.0)}
    spans = license_scan.license_spans(docs, templates=license_scan.TEMPLATES | {"own": "a b c d e f g h i j"}).orderBy("doc_id", "first_word").collect()
    at = lambda i: [(r["first_word"], r["last_word"]) for r in spans if r["doc_id"] == i]
    assert at(0) == [(3 * i, 3 * i + 2) for i in range(5)] and at(1) == [(4 * i, 4 * i + 2) for i in range(4)] and len(at(2)) == 300
    assert at(4)[-1] == (48, 57) and at(4)[0][0] == 0 and at(4)[-2][1] == 45


# Language ID and toxicity

TONGUES = {"aa": "bcdf", "bb": "ghjk"}


def spoken(lang, n, r):
    return " ".join("".join(r.choice(TONGUES[lang]) + r.choice("aeiou") for _ in range(3)) for _ in range(n))


def test_language_id(spark):
    r = random.Random(4)
    rows = [(i, spoken(lang, 30, r), lang) for i, lang in enumerate(["aa", "bb"] * 40)] + [(90, None, "aa"), (91, "", None), (92, "12 !?", "bb"), (93, "wwwxxxzzz" * 30, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = language_id.train(docs, F.col("doc_id") % 4 != 0)
    got = {x["doc_id"]: x for x in language_id.identify(docs, models).collect()}
    assert all(got[i]["lang_pred"] == lang and not got[i]["rejected"] for i, _, lang in rows[:80])
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 and got[i]["rejected"] for i in (90, 91, 92)) and got[93]["rejected"]
    assert {x["doc_id"] for x in language_id.accepted(docs, models).collect()} == set(range(80))
    assert language_id.identify(docs, language_id.fit([])).where("lang_pred <> 'und'").count() == 0


def brute_kneser_ney(words, letters):
    """The probability of a symbol after a context, by the textbook's recursion; words with their counts."""
    grams = collections.Counter()
    for w, n in words.items():
        marked = "<" + w + ">"
        for i in range(len(marked)):
            for j in range(i + 1, min(i + language_id.ORDER, len(marked)) + 1):
                grams[marked[i:j]] += n

    def count(g):
        return grams[g] if len(g) == language_id.ORDER or g[0] == "<" else sum(x.endswith(g) and len(x) == len(g) + 1 for x in grams)

    def p(symbol, context):
        symbols = [*letters, ">"]
        after = {s: count(context + s) for s in symbols if context + s in grams}
        total, lower = sum(after.values()), p(symbol, context[1:]) if context else 1 / (len(letters) + 2)
        return lower if not total else max(after.get(symbol, 0) - language_id.DISCOUNT, 0) / total + language_id.DISCOUNT * len(after) / total * lower

    return p


def test_kneser_ney_against_the_recursion_and_sums_to_one():
    words = collections.Counter({"aba": 3, "abb": 1, "bab": 2, "abcab": 1, "c": 4})
    models = language_id.Models({"aa": words, "bb": collections.Counter({"dd": 2, "dad": 1})})
    brute = brute_kneser_ney(words, models.alphabet)
    assert models.alphabet == ["a", "b", "c", "d"]
    for word in ("abab", "cab", "ddab", "xa", "bcbabab"):
        log, _ = models.logs([word])
        marked = "<" + word + ">"
        want = [brute(marked[i], marked[max(0, i - language_id.ORDER + 1) : i]) for i in range(1, len(marked))]
        assert np.allclose(np.exp(log[1:, 0]), want, rtol=1e-5), word
    for context in ("a", "b", "ab", "abca", "d", "zz"):
        log, place = models.logs([context + c for c in [*models.alphabet, "z"]] + [context])
        at = np.flatnonzero(place == 0) + 1 + len(context)
        assert np.allclose(np.exp(log[at]).sum(axis=0), 1, atol=1e-5), context


def test_rejection_is_calibrated():
    r = random.Random(11)
    word = lambda lang: "".join(r.choice(TONGUES[lang]) + r.choice("aeiou") for _ in range(3))
    rows = [(lang, " ".join(word(lang) for _ in range(30))) for lang in ("aa", "bb") for _ in range(200)]
    models = language_id.fit(rows)
    table = language_id.TokenTable(models.scores)
    fresh = [" ".join(word("aa") for _ in range(30)) for _ in range(200)]
    for texts, least, most in ((fresh, 0, 0.02), (list(map(language_id.shuffled, fresh)), 0.98, 1)):
        h, _ = models.entropies(table, texts)
        assert least <= (h.min(axis=1) > models.thresholds[h.argmin(axis=1)]).mean() <= most


def test_toxicity(spark):
    r = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        lang = ["aa", "bb"][i % 2]
        w, toxic = spoken(lang, R.randint(5, 60), r).split(), int(i % 4 == 0)
        if toxic:
            for _ in range(2):
                w.insert(r.randrange(len(w)), ("zzbad" if lang == "aa" else "qqvil") + r.choice("aeiou"))
        rows.append((i, " ".join(w), lang))
        labels.append((i, toxic))
    docs = spark.createDataFrame([*rows, (900, None, None), (901, "", "aa")], "doc_id long, text string, lang string")
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), F.col("doc_id") % 5 != 0)
    got = {x["doc_id"]: x["score"] for x in toxicity.classify(docs, model).collect()}
    apart = [(got[i] >= 0.5) == bool(y) for i, y in labels if i % 5 == 0]
    assert sum(apart) / len(apart) > 0.9 and len(got) == 402 and got[900] == got[901] < 0.5


def test_toxicity_learns_from_every_labelled_document(spark, monkeypatch):
    """Few documents start the weights; words of either class and of a language that stand in few others must count all the same."""
    r = random.Random(9)
    monkeypatch.setattr(toxicity, "ROWS", 256)
    rows = [(i, spoken(["aa", "bb"][i % 2], r.randint(5, 40), r) + (f" zzbad{r.choice('aeiou')}" if i % 3 == 0 else ""), ["aa", "bb"][i % 2]) for i in range(1500)]
    rare = [(2000 + i, f"rareword rare{i}", "cc") for i in range(40)]
    labels = [(i, int(i % 3 == 0)) for i, _, _ in rows] + [(i, 0) for i, _, _ in rare]
    docs = spark.createDataFrame(rows + rare, "doc_id long, text string, lang string")
    models = [toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True), start=20) for _ in range(2)]
    h = {x["doc_id"]: x["h"] for x in docs.select("doc_id", F.xxhash64("doc_id", "text").alias("h")).collect()}
    want = np.ones((toxicity.BUCKETS, 3))
    for i, text, lang in rows + rare:
        if h[i] % toxicity.APART:
            np.add.at(want[:, ["aa", "bb", "cc"].index(lang)], toxicity.parts_of(toxicity.words_of(text)).ravel(), 1)
    assert models[0].languages == ["aa", "bb", "cc"] and np.allclose(models[0].spoken, np.log(want / want.sum(axis=0)), atol=1e-5)
    assert all(np.array_equal(a, b) for a, b in zip(models[0]._weights(), models[1]._weights())) and np.array_equal(models[0].thresholds, models[1].thresholds)
    got = {x["doc_id"]: x["score"] for x in toxicity.classify(docs, models[0]).collect()}
    assert np.mean([(got[i] >= 0.5) == bool(y) for i, y in labels if not h[i] % toxicity.APART]) > 0.95


def test_cut_over_counts():
    answers, counts = np.array([0.0, 1.0, 1.0, 2.0, 5.0]), np.array([[3, 0], [1, 0], [1, 1], [4, 0], [0, 6]])
    assert toxicity._cut(answers, counts) == 3.5 and toxicity._cut(answers, counts * [1, 0]) == 0


# Pipeline


def test_pipeline(spark, docs, texts, tmp_path, vocabulary):
    plain = docs.where("doc_id is not null").withColumn("lang", F.lit("en")).drop("score")
    plain.write.parquet(str(tmp_path / "documents.parquet"))
    rows = dict(texts)
    held = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"] for r in held.select("doc_id").collect()}
        out = stage(spark, held, str(tmp_path))
        after = collections.Counter(r["doc_id"] for r in out.select("doc_id").collect())
        if name == "language_id":
            assert before - set(after) >= {i for i, t in texts if not (t or "").strip()}
        elif name == "exact_dedup":
            assert set(after) == {max(j for j in before if low(rows[j]) == low(rows[i])) for i in before}
        elif name == "jaccard_join":
            assert set(after) == {c for _, c in brute_components([(i, rows[i]) for i in before], 5, 80).values()}
        elif name == "source_mix":
            assert set(after) <= before and max(after.values()) <= 2
        else:
            assert set(after) == before
        if name != "bpe":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        held = out
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == held.count()


def test_pipeline_keeps_null_and_repeated_ids(spark):
    r = random.Random(8)
    made = [" ".join(f"w{r.randrange(10**6)}" for _ in range(40)) for _ in range(8)]
    rows = [(None, made[0]), (None, made[1]), (None, made[1]), (1, made[1].upper()), (2, made[2]), (2, made[3]), (2, made[2]), (3, made[3]), (None, made[4]), (None, made[4]), (5, made[5]), (5, made[6])]
    of = lambda rows: spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = lambda frame: sorted(((x["doc_id"], x["text"]) for x in frame.select("doc_id", "text").collect()), key=str)
    kept = [(None, made[0]), (1, made[1].upper()), (2, made[2]), (3, made[3]), (None, made[4]), (5, made[5]), (5, made[6])]
    assert got(corpus_pipeline.drop_copies(spark, of(rows), "")) == sorted(kept, key=str)
    near = [(4, made[6] + " more"), (None, made[0] + " more"), (9, made[3] + " more"), (0, made[5] + " more")]
    left = [(None, (made[0], made[0] + " more")), *((i, (t,)) for i, t in kept[1:5]), (4, (made[6] + " more",)), (0, (made[5] + " more",))]
    after = got(corpus_pipeline.drop_near_copies(spark, of(kept + near + kept[:1]), ""))
    assert len(after) == len(left) and all(any(i == j and t in ts for j, ts in left) for i, t in after)
    mixed = collections.Counter(got(corpus_pipeline.mix_sources(spark, of(kept), "")))
    assert sum(mixed.values()) >= len(kept) and any(i is None for i, _ in mixed)


def test_pipeline_on_empty_tables_clashing_columns_and_repeated_rows(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long, _row string, _cut int, _nth int, _twin int, size long, taken int, s int, words int"
    r = random.Random(13)
    made = [" ".join(spoken("aa", 1, r) for _ in range(40)) for _ in range(4)]
    rows = [(i, t, "aa", None, 7, "mine", 1, 2, 3, 4, 5, 6, 7) for i, t in [*enumerate(made), (None, made[0] + " x"), (None, None), (3, made[3]), (3, "")]]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        none = stage(spark, spark.createDataFrame([], kind), "")
        assert none.schema.names == kind.replace(" long", "").replace(" string", "").replace(" int", "").split(", ") and none.count() == 0, name
        out = stage(spark, spark.createDataFrame(rows, kind), "").collect()
        assert out and all(x["_row"] == "mine" and (x["_cut"], x["_nth"], x["_twin"], x["size"], x["taken"], x["s"], x["words"]) == (1, 2, 3, 4, 5, 6, 7) for x in out), name
        if name == "exact_dedup":
            assert sorted((x["doc_id"] for x in out), key=str) == sorted([0, 1, 2, 3, None, 3], key=str)
        if name == "source_mix":
            total = sum(len(words(x["text"])) for x in out)
            assert total == 3 * sum(len(words(x[1])) for x in rows) // 2
    assert corpus_pipeline.encode(spark, spark.createDataFrame([], kind), "").count() == 0


def test_pipeline_mix_meets_targets(spark):
    r = random.Random(9)
    rows = [(i, f" {prose(r.randint(1, 60))}\t{WORDS[i]}\n", "en", "a", 0) for i in range(40)] + [(50, prose(3000), "en", "b", 0), (None, prose(1500), "en", "c", 0)]
    docs = spark.createDataFrame([(i, t, x, s, len(t)) for i, t, x, s, _ in rows], "doc_id long, text string, lang string, source string, n_chars long")
    sizes = collections.Counter()
    for _, t, _, source, _ in rows:
        sizes[source] += len(words(t))
    want = {s: int(n) for s, n in zip("abc", mixing.targets([sizes[s] for s in "abc"], [5, 2, 1]), strict=True)}
    out, total, whole = corpus_pipeline.mix_sources(spark, docs, "").collect(), collections.Counter(), {(i, s): t for i, t, _, s, _ in rows}
    for x in out:
        total[x["source"]] += len(words(x["text"]))
        assert whole[(x["doc_id"], x["source"])].startswith(x["text"]) and x["n_chars"] == len(x["text"])
    assert all(abs(total[s] - n) <= (8 if n >= mixing.RESOLVED else 0) for s, n in want.items()) and sum(x["text"] != whole[(x["doc_id"], x["source"])] for x in out) <= 3
