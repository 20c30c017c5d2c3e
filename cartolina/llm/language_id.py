"""Language identification by interpolated Kneser-Ney character models, one for each language.

A text's letters, lower-cased and cut at white space, are scored word by word: each letter and the word's end
given up to four letters before it in the word. What a language's model needs of an n-gram (its discounted
probability, and the weight of shorter contexts after it) stands in arrays sorted by the n-gram's hash,
one array an order, with a column for each language. A text goes to the language with the lowest cross-entropy a
letter. It is rejected if that is above the language's threshold, which is calibrated on documents kept out of the fit
and on the same documents with the letters of each word shuffled: it lies between the quantile CLEAN of the former and the
quantile 1 - CLEAN of the latter.
"""

from __future__ import annotations

import random
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolina.llm.words import TokenTable, chunks, kept, sums

ORDER = 5
DISCOUNT = 0.75
#: Documents of each language that the models are fitted on, about; a fifth of them calibrate rejection.
SAMPLE = 400
UNKNOWN = "und"
#: The share of a language's calibration documents that its threshold accepts, and the share of their shuffled twins that it rejects.
CLEAN = 0.99
#: How far towards the shuffled twins the threshold lies between these two quantiles.
TOWARDS = 0.6

#: Tokens whose scores a worker keeps in each of two generations.
TOKENS = 100_000

_START, _END = 1, 2
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def letters(token: str) -> str:
    return token if token.isalpha() else "".join(c for c in token if c.isalpha())


def _spelled(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words with marks around each, and each symbol's place in its word (the mark before it: 0)."""
    joined = "".join(f"\x01{w}\x02" for w in words)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    starts = np.flatnonzero(codes == _START)
    place = np.arange(len(codes)) - np.repeat(starts, np.diff(np.append(starts, len(codes))))
    return codes, place


def _hashes(codes: np.ndarray) -> list[np.ndarray]:
    """For n from 1, the hash of the n symbols that end at each place (meaningless where fewer stand before)."""
    out, mixed = [], (codes + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    for n in range(1, ORDER + 1):
        if n == 1:
            out.append(mixed.copy())
        else:
            h = np.zeros_like(mixed)
            h[n - 1 :] = (out[-1][n - 2 : -1] * _MULTIPLIER + mixed[n - 1 :]) if len(mixed) >= n else 0
            h ^= h >> np.uint64(31)
            out.append(h)
    return out


class Models:
    """languages; for each order the sorted hashes and, by language, probability and context weight; thresholds.

    A symbol is a letter of the alphabet (all languages' letters), a word's end, or any unseen letter, which counts as one symbol.
    What the discounts take from single symbols goes in equal parts to all symbols, so that every context's probabilities add up to 1.
    """

    def __init__(self, counted: dict[str, Counter]):
        self.languages = sorted(counted)
        parts: list[list] = [[] for _ in range(ORDER)]
        self.alphabet = sorted({c for words in counted.values() for w in words for c in w})
        left = np.zeros(len(self.languages))
        for k, name in enumerate(self.languages):
            left[k], fitted = self._fit(counted[name])
            for n, part in enumerate(fitted):
                parts[n].append((k, *part))
        self.least = left / (len(self.alphabet) + 2)
        self.hashes, self.values = [], []
        for n in range(ORDER):
            every = np.unique(np.concatenate([p[1] for p in parts[n]] or [np.zeros(0, np.uint64)]))
            values = np.zeros((len(every) + 1, 2, len(self.languages)), np.float32)
            values[:, 1] = 1.0
            for k, h, p, w in parts[n]:
                at = np.searchsorted(every, h)
                values[at, 0, k], values[at, 1, k] = p, w
            self.hashes.append(every)
            self.values.append(values)
        self.thresholds = np.full(len(self.languages), np.inf)

    @staticmethod
    def _fit(words: Counter) -> tuple[float, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """What the discounts leave of single symbols; for each order hashes of its n-grams, discounted probability given what precedes, weight as a context."""
        listed = list(words)
        codes, place = _spelled(listed)
        times = np.repeat(np.fromiter(words.values(), np.float64, len(listed)), [len(w) + 2 for w in listed])
        hashes = _hashes(codes)
        grams = []
        for n in range(1, ORDER + 1):
            ok = place >= n - 1
            h, first, inverse = np.unique(hashes[n - 1][ok], return_index=True, return_inverse=True)
            where = np.flatnonzero(ok)[first]
            grams.append([h, np.bincount(inverse, times[ok], len(h)), where])
        for n in range(ORDER - 1):  # lower orders count the distinct symbols before, but for n-grams that begin a word
            h, count, where = grams[n]
            longer = grams[n + 1]
            tail = np.searchsorted(h, hashes[n][longer[2]])
            before = np.bincount(tail, minlength=len(h)).astype(np.float64)
            grams[n][1] = np.where(place[where] == n, count, before) if n else before
        out: list = []
        total = max(grams[0][1].sum(), 1)
        left = DISCOUNT * (grams[0][1] > 0).sum() / total
        for n in range(ORDER):
            h, count, where = grams[n]
            if n == 0:
                p = np.maximum(count - DISCOUNT, 0) / total
            else:
                context = np.searchsorted(grams[n - 1][0], hashes[n - 1][where - 1])
                mass = np.bincount(context, count, len(grams[n - 1][0]))
                kinds = np.bincount(context, minlength=len(grams[n - 1][0]))
                p = np.maximum(count - DISCOUNT, 0) / mass[context]
                out[-1][2][:] = np.where(mass > 0, DISCOUNT * kinds / np.maximum(mass, 1e-9), 1.0)
            out.append((h, p, np.ones(len(h))))
        return left, out

    def logs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The log probability of every symbol of the words, by language (0 for the mark before a word); each symbol's place in its word."""
        codes, place = _spelled(words)
        hashes = _hashes(codes)
        rows = []
        for n in range(ORDER):
            at = np.searchsorted(self.hashes[n], hashes[n])
            at[at == len(self.hashes[n])] = 0
            missing = (self.hashes[n][at] != hashes[n]) if len(self.hashes[n]) else np.ones(len(at), bool)
            rows.append(np.where(missing | (place < n), len(self.hashes[n]), at))
        p = self.values[0][rows[0], 0] + self.least
        for n in range(1, ORDER):
            before = np.concatenate([[0], rows[n - 1][:-1]])
            deeper = self.values[n][rows[n], 0] + self.values[n - 1][before, 1] * p
            p = np.where((place >= n)[:, None], deeper, p)
        log = np.log(np.maximum(p, 1e-12))
        log[place == 0] = 0
        return log, place

    def scores(self, tokens: list[str]) -> np.ndarray:
        """For each token, by language, the log probability of its letters and end; last, how many they are."""
        words = [letters(t) for t in tokens]
        out = np.zeros((len(words), len(self.languages) + 1), np.float32)
        full = [i for i, w in enumerate(words) if w]
        if not full:
            return out
        log, place = self.logs([words[i] for i in full])
        starts = np.flatnonzero(place == 0)
        out[full, :-1] = np.add.reduceat(log, starts, axis=0)
        out[full, -1] = np.diff(np.append(starts, len(place))) - 1
        return out

    def entropies(self, table: TokenTable, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """By text and language the cross-entropy a symbol; the number of symbols."""
        split = [t.lower().split() for t in texts]
        found = table.rows([w for words in split for w in words])
        total = sums(*found, [len(w) for w in split])
        return -total[:, :-1] / np.maximum(total[:, -1:], 1), total[:, -1]


def fit(rows: list[tuple[str, str]]) -> Models:
    """Models from (language, text); every fifth text of a language sets its threshold instead, if it has ten at least."""
    by: dict[str, list[str]] = {}
    for lang, text in rows:
        by.setdefault(lang, []).append(text)
    apart = {lang: texts[::5] if len(texts) >= 10 else texts for lang, texts in by.items()}
    counted = {}
    for lang, texts in by.items():
        words: Counter = Counter()
        for i, t in enumerate(texts):
            if i % 5 or len(texts) < 10:
                words.update(filter(None, map(letters, t.lower().split())))
        counted[lang] = words
    models = Models({k: v for k, v in counted.items() if v})
    table = TokenTable(models.scores)
    for k, lang in enumerate(models.languages):
        clean, odd = (_own(models, table, texts, k) for texts in (apart[lang], map(shuffled, apart[lang])))
        if len(clean):
            low, high = np.quantile(clean, CLEAN), np.quantile(odd, 1 - CLEAN)
            models.thresholds[k] = low + TOWARDS * max(high - low, 0.0)
    return models


def _own(models: Models, table: TokenTable, texts: Iterable[str], k: int) -> np.ndarray:
    h, n = models.entropies(table, list(texts))
    return h[n > 0, k]


def shuffled(text: str) -> str:
    """The text with each word's letters in an order drawn by a generator that starts alike for every text."""
    drawn = random.Random(len(text))
    return " ".join("".join(drawn.sample(w, len(w))) for w in text.split())


def train(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Models:
    """Models from about `sample` documents of each language, taken by a hash of the id, among those that learn holds for."""
    own = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l"))
    counts = own.groupBy("l").count().collect()
    most = docs.sparkSession.createDataFrame([(r["l"], sample / r["count"]) for r in counts], "l string, share double")
    drawn = F.pmod(F.xxhash64("i", F.lit(9)), F.lit(1 << 20)) / float(1 << 20) < F.col("share")
    taken = own.join(F.broadcast(most), "l").where(drawn).select("l", "t", F.xxhash64("i", "t").alias("h")).collect()
    taken.sort(key=lambda r: (r["l"], r["h"]))
    return fit([(r["l"], r["t"]) for r in taken])


_OUT = "doc_id long, lang_pred string, score double, rejected boolean, entropy double"


def identify(docs: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, rejected, entropy (null without letters), one row for each row of docs.

    A null text, an empty one and one without letters are `und`, score 0, and rejected. Ties go to the first language in
    order. Repeated rows each get the same result; other columns are ignored; without any learned language all is `und`.
    """
    token = uuid.uuid4().hex
    held = docs.sparkSession.sparkContext.broadcast(models)  # its size is bounded by the sample

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        table = kept(token, lambda: TokenTable(m.scores, TOKENS))
        for b in batches:
            for ids, texts in chunks(b):
                if not m.languages:
                    yield pa.record_batch([pa.array(ids, pa.int64()), pa.array([UNKNOWN] * len(ids)), pa.array([0.0] * len(ids)), pa.array([True] * len(ids)), pa.array([None] * len(ids), pa.float64())], names=["doc_id", "lang_pred", "score", "rejected", "entropy"])
                    continue
                h, n = m.entropies(table, texts)
                best = h.argmin(axis=1)
                low = h[np.arange(len(ids)), best]
                sure = 1 / np.exp(-(h - low[:, None]) * np.minimum(n, 50)[:, None]).sum(axis=1)
                none = n == 0
                yield pa.record_batch(
                    [pa.array(ids, pa.int64()), pa.array([UNKNOWN if z else m.languages[k] for k, z in zip(best, none, strict=True)]), pa.array(np.where(none, 0.0, sure)), pa.array(none | (low > m.thresholds[best])), pa.array(low, mask=none)],
                    names=["doc_id", "lang_pred", "score", "rejected", "entropy"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(score, _OUT)


def accepted(docs: DataFrame, models: Models, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that are not rejected; no shuffle."""
    token = uuid.uuid4().hex
    held = docs.sparkSession.sparkContext.broadcast(models)
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        table = kept(token, lambda: TokenTable(m.scores, TOKENS))
        for b in batches:
            mask: list[bool] = []
            for _, texts in chunks(pa.record_batch([pa.nulls(b.num_rows, pa.int64()), b.column(at).cast(pa.string())], names=["doc_id", "text"])):
                if m.languages:
                    h, n = m.entropies(table, texts)
                    best = h.argmin(axis=1)
                    mask += ((n > 0) & (h[np.arange(len(texts)), best] <= m.thresholds[best])).tolist()
                else:
                    mask += [False] * len(texts)
            yield b.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
