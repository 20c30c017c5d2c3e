"""A convolutional text classifier for toxicity, trained in numpy.

A word's embedding is the sum of the vectors of its hashed parts (the word, its beginnings, its end). Filters of
several widths run over the whole text, each keeps its greatest answer, and a logistic layer weighs
them. Weights are first fitted on a bounded start; then every labelled document moves them, shard by shard, and the shards' weights are averaged.
Since a filter is linear in the words below it, scoring adds up each word's share of each filter from a table by distinct
word. A language is guessed from the same hashed parts, and each language has a threshold of its own, calibrated on
all labelled documents that were kept out of the fit; the score is the logistic function of the answer less that threshold.
"""

from __future__ import annotations

import copy
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolina.llm.common import ROWS, staged
from cartolina.llm.words import TokenTable, chunks, kept, sums

BUCKETS = 1 << 15
PARTS = 4
DIM = 16
WIDTHS = (1, 2, 3)
FILTERS = 8
#: Labelled documents of each class from which weights start, about; what they become is learned from all labelled documents.
START = 1500
STEPS = 800
BATCH = 24
#: Of all labelled documents one in so many is kept out of the fit and calibrates thresholds; with fewer than FEW all do both.
APART, FEW = 5, 200
#: Answers are told apart by such steps, up to so many on either side of 0, when thresholds are sought.
STEP, MOST = 1 / 1024, 1 << 16
#: Numbers of a slice in which shards' weights are added up.
SLICE = 1 << 14


def words_of(text: str) -> list[str]:
    text = text.lower()
    for mark in ".,!?;:|":
        text = text.replace(mark, " ")
    return text.split()


def _parts(token: str) -> tuple[int, ...]:
    w = token if token.isalpha() else "".join(c for c in token if c.isalpha()) or token
    return tuple(zlib.crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in (w, f"^{w[:4]}", f"^{w[:5]}", f"{w[-4:]}$"))


def parts_of(tokens: list[str]) -> np.ndarray:
    return np.array([_parts(t) for t in tokens], np.int64).reshape(-1, PARTS)


class Classifier:
    """Weights: embed, filters by width, the logistic layer, the language table and the thresholds."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        self.embed = r.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
        self.conv = [r.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = r.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.out_bias = np.float32(0)
        self.languages: list[str] = []
        self.spoken = np.zeros((BUCKETS, 1), np.float32)
        self.thresholds = np.zeros(1)

    # Each token's row: what it adds to each filter at each of the filter's places, then to each language.
    def shares(self, tokens: list[str]) -> np.ndarray:
        parts = parts_of(tokens)
        e = self.embed[parts].sum(axis=1)
        return np.concatenate([e @ c[j] for c in self.conv for j in range(len(c))] + [self.spoken[parts].sum(axis=1)], axis=1)

    def pooled(self, table: np.ndarray, rows: np.ndarray, counts: list[int]) -> np.ndarray:
        """Each text's greatest answer of every filter (0 at least); windows may hang over a text's end."""
        gap, n = max(WIDTHS), np.asarray(counts)
        starts = np.cumsum(n + gap) - n - gap
        at = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(len(rows))
        width = FILTERS * sum(WIDTHS)
        flat = np.zeros((int((n + gap).sum()), width), np.float32)
        flat[at] = table[rows, :width]
        out, col = [], 0
        for w, bias in zip(WIDTHS, self.bias, strict=True):
            seen = flat[:, col : col + FILTERS].copy()
            for j in range(1, w):
                seen[:-j] += flat[j:, col + j * FILTERS : col + (j + 1) * FILTERS]
            col += w * FILTERS
            inside = np.zeros(len(flat), bool)
            inside[at] = True
            seen[~inside] = -1e9
            out.append(np.maximum(np.maximum.reduceat(seen, starts, axis=0) + bias, 0) if len(starts) else np.zeros((0, FILTERS), np.float32))
        return np.concatenate(out, axis=1)

    def answers(self, table: np.ndarray, rows: np.ndarray, counts: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The logistic layer's answer before its threshold, and the number of the guessed language."""
        spoken = sums(table[:, FILTERS * sum(WIDTHS) :], rows, counts)
        return self.pooled(table, rows, counts) @ self.out + self.out_bias, spoken.argmax(axis=1)

    def scores(self, table: np.ndarray, rows: np.ndarray, counts: list[int]) -> tuple[np.ndarray, np.ndarray]:
        answer, language = self.answers(table, rows, counts)
        return 1 / (1 + np.exp(-np.clip(answer - self.thresholds[language], -30, 30))), language

    # Training.
    def _weights(self) -> list[np.ndarray]:
        return [self.embed, *self.conv, *self.bias, self.out]

    def fit(self, texts: list[list[np.ndarray]], labels: np.ndarray, steps: int = STEPS, seed: int = 6) -> None:
        """texts: each one's (words, PARTS) bucket numbers. Batches hold as many of either class; Adagrad."""
        r = np.random.default_rng(seed)
        kinds = [np.flatnonzero(labels == k) for k in (0, 1)]
        self.state, self.out_state = [np.full_like(a, 1e-2) for a in self._weights()], 1e-2
        for _ in range(steps):
            picked = np.concatenate([r.choice(k, BATCH // 2, replace=len(k) < BATCH // 2) for k in kinds])
            self.step([texts[i] for i in picked], labels[picked], np.ones(len(picked)))

    def step(self, texts: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, rate: float = 0.1) -> None:
        """Moves all weights by one batch."""

        def move(a: np.ndarray, s: np.ndarray, grad: np.ndarray) -> None:
            s += grad * grad
            a -= rate * grad / np.sqrt(s)

        g_conv, g_bias, g_out, g_bias_out = [np.zeros_like(c) for c in self.conv], [np.zeros_like(b) for b in self.bias], np.zeros_like(self.out), 0.0
        where, pushed = [], []
        for parts, label, weight in zip(texts, labels, weights, strict=True):
            if not len(parts):
                continue
            e = self.embed[parts].sum(axis=1)
            padded = np.concatenate([e, np.zeros((max(WIDTHS), DIM), np.float32)])
            tops, ats = [], []
            for c, b in zip(self.conv, self.bias, strict=True):
                seen = sum(padded[j : j + len(e)] @ c[j] for j in range(len(c)))
                at = seen.argmax(axis=0)
                ats.append(at)
                tops.append(seen[at, np.arange(FILTERS)] + b)
            top = np.concatenate(tops)
            z = np.maximum(top, 0)
            g = np.float32(weight * (1 / (1 + np.exp(-np.clip(z @ self.out + self.out_bias, -30, 30))) - label) / len(texts))
            g_out += g * z
            g_bias_out += g
            back = g * self.out * (top > 0)
            for k, (c, at) in enumerate(zip(self.conv, ats, strict=True)):
                gk = back[k * FILTERS : (k + 1) * FILTERS]
                g_bias[k] += gk
                for j in range(len(c)):
                    inside = at + j < len(e)
                    g_conv[k][j] += (padded[at + j] * gk[:, None]).T
                    where.append(parts[(at + j)[inside]])
                    pushed.append((c[j].T * gk[:, None])[inside])
        for a, s, grad in zip(self._weights()[1:], self.state[1:], [*g_conv, *g_bias, g_out], strict=True):
            move(a, s, grad)
        self.out_state += g_bias_out**2
        self.out_bias -= np.float32(rate * g_bias_out / np.sqrt(self.out_state))
        if where:
            rows, at = np.unique(np.concatenate(where).ravel(), return_inverse=True)
            grad = np.zeros((len(rows), DIM), np.float32)
            np.add.at(grad, at, np.repeat(np.concatenate(pushed), PARTS, axis=0))
            s = self.state[0]
            s[rows] += grad * grad
            self.embed[rows] -= rate * grad / np.sqrt(s[rows])

    def follow(self, rows: Iterator[tuple[list[str], list[int], list[str | None]]], weight: tuple[float, float], languages: list[str], table: TokenTable) -> np.ndarray:
        """Moves weights by one batch after the other, each of its documents once; returns what a mean over shards needs, as one row of numbers.

        Of each bucket: its words by language (the last place: no language), and its vector times their number; then the other weights times the
        number of documents, and that number.
        """
        counts, n, at = np.zeros((len(languages) + 1, BUCKETS)), 0, {x: k for k, x in enumerate(languages)}
        for texts, labels, spoken in rows:
            split = [words_of(t or "") for t in texts]
            known, places = table.rows([w for words in split for w in words])
            ends = np.cumsum([len(w) for w in split])
            parts = [known[p] for p in np.split(places, ends[:-1])]
            for p, lang in zip(parts, spoken, strict=True):
                counts[at.get(lang, -1)] += np.bincount(p.ravel(), minlength=BUCKETS)
            self.step(parts, np.array(labels), np.array([weight[y] for y in labels]))
            n += len(texts)
        others = np.concatenate([x.ravel() for x in self._weights()[1:]] + [np.array([self.out_bias])]).astype(np.float64)
        return np.concatenate([counts.ravel(), (self.embed * counts.sum(axis=0)[:, None]).ravel(), others * n, [n]])

    def average(self, total: np.ndarray, languages: list[str]) -> None:
        """Takes on the mean of the shards from the sum of what follow gave; buckets without a word stay."""
        size = (len(languages) + 1) * BUCKETS
        counts, total = total[:size].reshape(-1, BUCKETS), total[size:]
        met = counts.sum(axis=0)
        vectors, rest = total[: BUCKETS * DIM].reshape(BUCKETS, DIM), total[BUCKETS * DIM :]
        self.embed[met > 0] = vectors[met > 0] / met[met > 0][:, None]
        rest, at = rest[:-1] / max(rest[-1], 1), 0
        for a in self._weights()[1:]:
            a[...] = rest[at : at + a.size].reshape(a.shape)
            at += a.size
        self.out_bias = np.float32(rest[at])
        self.learn_languages(counts[:-1].T, languages)

    def learn_languages(self, counts: np.ndarray, languages: list[str]) -> None:
        """counts: of each bucket, its words in documents of each language."""
        self.languages = languages
        self.spoken = np.log((counts + 1) / (counts + 1).sum(axis=0)).astype(np.float32)
        self.thresholds = np.zeros(len(languages))

    def calibrate(self, answers: np.ndarray, language: np.ndarray, counts: np.ndarray) -> None:
        """For each guessed language the cut with the most right answers of either class; all languages' cut where one has few.

        counts: of each answer and guessed language, documents of class 0 and 1.
        """
        self.thresholds[:] = _cut(answers, counts)
        for k in range(len(self.languages)):
            own = language == k
            if own.any() and counts[own].sum(axis=0).min() >= 10:
                self.thresholds[k] = _cut(answers[own], counts[own])


def _cut(answers: np.ndarray, counts: np.ndarray) -> float:
    """The threshold with the greatest sum of both classes' shares of right answers, in the middle of the widest such gap."""
    if not len(answers) or not counts.sum(axis=0).all():
        return 0.0
    a, at = np.unique(answers, return_inverse=True)
    below = np.cumsum(np.stack([np.bincount(at, counts[:, y], len(a)) for y in (0, 1)], axis=1), axis=0)
    right = below[:, 0] / below[-1, 0] - below[:, 1] / below[-1, 1]
    gaps = np.where(right[:-1] >= right.max() - 1e-12, a[1:] - a[:-1], -1.0) if len(a) > 1 else np.zeros(0)
    k = int(gaps.argmax()) if len(gaps) else 0
    return float((a[k] + a[min(k + 1, len(a) - 1)]) / 2)


def _batches(group: pa.Table) -> Iterator[tuple[list[str], list[int], list[str | None]]]:
    """A shard's documents in an order of their own, BATCH at a time."""
    group = group.select(["t", "y", "l", "h"]).sort_by([("h", "ascending"), ("l", "ascending")])
    for at in range(0, len(group), BATCH):
        part = group.slice(at, BATCH)
        yield part["t"].to_pylist(), part["y"].to_pylist(), part["l"].to_pylist()


def _added(parts: pa.Table) -> pa.Table:
    """The sum of one slice over all shards, in the shards' order."""
    parts, total = parts.sort_by("shard"), 0.0
    for x in parts["numbers"]:
        total = total + np.frombuffer(x.as_buffer(), np.float64)
    return pa.table({"slice": pa.array([parts["slice"][0].as_py()], pa.int32()), "numbers": [total.tobytes()]})


def train(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", start: int = START) -> Classifier:
    """A classifier from all labelled documents that learn holds for.

    A hash keeps one in APART of them out of the fit. Weights start from about `start` of the others of each class, drawn by a hash; then each of
    the others, in shards of about ROWS, moves its shard's weights once, classes weighing alike, and the mean of all shards is taken: of a word's
    vectors by how often a shard has it. Languages are counted over all documents of the fit, thresholds sought over all that were kept apart.
    """
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(learn & F.col("y").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"))
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l")).where(learn)
    joined = own.join(known.hint("shuffle_hash"), "doc_id").select("t", "y", "l", F.xxhash64("doc_id", "t").alias("h"))
    rows = staged(joined, "toxicity", rows=known.count())
    kept_out = F.pmod("h", F.lit(APART)) == 0
    found = rows.groupBy("y", "l", kept_out.alias("apart")).count().collect()  # a row a language, class and part
    enough = sum(r["count"] for r in found) >= FEW
    sizes = [sum(r["count"] for r in found if r["y"] == y and not r["apart"]) for y in (0, 1)]
    languages = sorted({r["l"] for r in found if r["l"] is not None and not r["apart"]}) or [""]
    model = Classifier()
    if not all(sizes):
        return model
    fitted = rows.where(~kept_out)
    share = F.when(F.col("y") == 1, start / sizes[1]).otherwise(start / sizes[0])
    drawn = sorted(fitted.where(F.pmod(F.xxhash64("h", F.lit(3)), F.lit(1 << 20)) / float(1 << 20) < share).collect(), key=lambda r: (r["h"], r["l"] or ""))  # about 2 * start rows
    model.fit([parts_of(words_of(r["t"] or "")) for r in drawn], np.array([r["y"] for r in drawn], np.int64))
    weight = tuple(sum(sizes) / 2 / n for n in sizes)
    held = spark.sparkContext.broadcast(model)  # a fixed number of weights

    def follow(key: tuple, group: pa.Table) -> pa.Table:
        m = copy.deepcopy(held.value)
        got = m.follow(_batches(group), weight, languages, kept("toxicity-parts", lambda: TokenTable(parts_of, 120_000)))
        slices = [got[k : k + SLICE].tobytes() for k in range(0, len(got), SLICE)]
        return pa.table({"shard": pa.array([key[0].as_py()] * len(slices), pa.int64()), "slice": pa.array(range(len(slices)), pa.int32()), "numbers": slices})

    shards = F.pmod(F.xxhash64("h", F.lit(7)), F.lit(-(-sum(sizes) // ROWS)))
    moved = fitted.withColumn("shard", shards).groupBy("shard").applyInArrow(follow, "shard long, slice int, numbers binary")
    total = moved.groupBy("slice").applyInArrow(_added, "slice int, numbers binary").collect()  # as large as the model, however many shards
    model.average(np.concatenate([np.frombuffer(r["numbers"], np.float64) for r in sorted(total, key=lambda r: r["slice"])]), languages)
    del model.state

    def steps(m: Classifier, table: np.ndarray, at: np.ndarray, counts: list[int]) -> list[pa.Array]:
        answer, language = m.answers(table, at, counts)
        return [pa.array(np.clip(np.rint(answer / STEP), -MOST, MOST).astype(np.int32)), pa.array(language.astype(np.int32))]

    answered = _for_texts((rows.where(kept_out) if enough else rows).select("y", "t"), model, "y int, step int, language int", steps)
    told = answered.groupBy("y", "step", "language").count().collect()  # bounded by the number of steps and languages
    if told:
        y, step, language, n = (np.array([r[k] for r in told]) for k in ("y", "step", "language", "count"))
        model.calibrate(step * STEP, language, np.stack([np.where(y == k, n, 0) for k in (0, 1)], axis=1))
    return model


def _for_texts(rows: DataFrame, model: Classifier, schema: str, give: Callable[[Classifier, np.ndarray, np.ndarray, list[int]], list[pa.Array]]) -> DataFrame:
    """For rows of a key and a text: the key and the columns that give makes of a chunk's table of tokens, its rows and each text's number of them."""
    held = rows.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights
    token, names, kind = uuid.uuid4().hex, [c.split()[0] for c in schema.split(", ")], pa.int64() if schema.split()[1].startswith("long") else pa.int32()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        table = kept(token, lambda: TokenTable(m.shares, 120_000))
        for b in batches:
            for keys, texts in chunks(b, 1 << 19):
                split = [words_of(t) for t in texts]
                got = give(m, *table.rows([w for words in split for w in words]), [len(w) for w in split])
                yield pa.record_batch([pa.array(keys, kind), *got], names=names)

    return rows.mapInArrow(run, schema)


def classify(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0.5 is the threshold of the guessed language) and that language, one row for each row of docs.

    A null or empty text has no words, so every filter's answer is 0 and the score is that of the logistic layer alone. Repeated rows each get the
    same score; other columns are ignored.
    """

    def score(m: Classifier, table: np.ndarray, at: np.ndarray, counts: list[int]) -> list[pa.Array]:
        got, language = m.scores(table, at, counts)
        names = m.languages or [""]
        return [pa.array(got.astype(np.float64)), pa.array([names[k] for k in language])]

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return _for_texts(rows, model, "doc_id long, score double, language string", score)
