"""Every query on empty tables, and on tables of nulls, empties, ties, repeated rows and extra columns."""

from __future__ import annotations

import collections
import hashlib
import re

import pytest

from cartolina.llm import queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, n_tokens long, kept boolean, mark binary, part int"
ROWS = [
    (1, None, None, None), (1, None, None, None), (2, "", "en", "a"), (3, "same text here now", "en", "a"), (3, "same text here now", "en", "a"), (3, "another text of one id", "de", None),
    (None, "a null id", "en", "a"), (None, None, None, None), (4, "SAME TEXT here NOW", None, "b"), (5, "x" * 300_000, "en", "b"), (6, "word " * 60_000, "de", "b"), (7, "\x00\x1f ﷽ 😀", "en", ""),
]


@pytest.fixture(scope="module", params=["empty", "odd"])
def folder(request, spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp(request.param))
    rows = ROWS if request.param == "odd" else []
    docs = spark.createDataFrame([(i, t, lang, s, len(t or ""), 0.5, 1, True, b"", 0) for i, t, lang, s in rows], DOCS)
    docs.write.parquet(f"{top}/documents.parquet")
    labels = [(1, 1, 1), (3, 0, 0), (4, None, None), (None, 1, 1), (5, 0, 1), (5, 0, 0)] if rows else []
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    vectors = [(0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (1, None, 1), (2, [None, 1.0], 1), (3, [], 1), (None, [1.0], 1), (100, [float("nan")], 1), (4, [1.0, 2.0], 1)] if rows else []
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{top}/embeddings.parquet")
    return top, len(rows)


def _low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def _words(text, pattern="[^ \t-\r]+"):
    return re.findall(pattern, _low(text))


def _expected(name):
    """What of each row's result follows from its id and text alone, by name of column; a function of the row."""
    sha = lambda b: hashlib.sha256(b).hexdigest()
    groups = collections.defaultdict(list)
    for i, t, _, _ in ROWS:
        groups[_low(t)].append(i)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    shingles = lambda w: len({tuple(w[j : j + 4]) for j in range(max(1, len(w) - 3))}) if w else 0
    return {
        "op2_jaccard_join": lambda i, t: {"n_shingles": shingles(_words(t))},
        "op3_suffix_dedup": lambda i, t: {"n_bytes": len((t or "").encode())} | ({} if len(t or "") > 99 else {"n_removed": 0, "n_spans": 0, "kept_sha256": sha((t or "").encode())}),
        "op4_pii": lambda i, t: {"n_email": 0, "n_ip": 0, "n_card": 0, "n_phone": 0, "base_sha256": sha(b""), "spans": ""},
        "op5_source_mix": lambda i, t: {"size": len(_words(t))},
        "op7_bpe": lambda i, t: {} if t else {"n_tokens": 0, "ids_sha256": sha(b""), "decoded_sha256": sha(b"")},
        "op8_license_scan": lambda i, t: {"n_words": len(_words(t, "[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")), "n_base": 0, "first_word": None, "last_word": None, "base_labels": ""},
        "op9_language_id": lambda i, t: {} if any(c.isalpha() for c in t or "") else {"lang_pred": "und", "score": 0.0},
        "op10_exact_dedup": lambda i, t: {"keep_id": keep[_low(t)], "group_size": len(groups[_low(t)]), "kept": i == keep[_low(t)], "text_sha256": sha(_low(t).encode())},
    }.get(name, lambda i, t: {})


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, folder, name):
    top, n = folder
    if name == "op7_bpe":
        pytest.importorskip("public_tokenizers")
    got = queries.QUERIES[name](spark, top).collect()
    if name != "op6_top_k":
        assert len(got) == n
        told = _expected(name)
        want = [{"doc_id": i} | told(i, t) for i, t, _, _ in ROWS[:n]]
        left = [r.asDict() for r in got]
        for w in sorted(want, key=len, reverse=True):  # each expected row has one of its own
            hit = next((g for g in left if all(g[k] == v for k, v in w.items())), None)
            assert hit is not None, (name, w)
            left.remove(hit)
        if name == "op1_toxicity":
            empty = {r["score"] for r in got if r["doc_id"] in (1, 2)}
            assert len(empty) <= 1 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
        if name == "op5_source_mix":
            assert all(0 <= r["taken"] <= 2 * r["size"] and (r["taken"] > 0) == (r["n_slots"] > 0) for r in got)
    elif n:
        assert [(r["query_id"], r["vec_id"], r["score"]) for r in got] == [(0, 4, 5 * 1024 * 1024), (0, 3, 0)]
    else:
        assert not got
