"""Personal data by weak supervision.

Candidates are found broadly: anything that looks like a value of a kind by its shape, or stands where a value would. Labelers of three
sorts vote on each: regular expressions and checksums, gazetteers, and the context (words before, an assignment, marks around).
How often each combination of votes and features occurs is counted over all documents; from these counts, a bounded
table, expectation-maximisation estimates how reliable each labeler is and how likely each candidate is personal data, and a
logistic span classifier with features of the span and of its context is trained on those likelihoods. Candidates that the
classifier accepts join the base spans, which always stay.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolina.llm.common import staged
from cartolina.llm.words import chunks

#: Fixed by the query's contract, in this order.
BASE = ("email", "ip", "card", "phone")
#: Kinds that the method adds.
MORE = ("national_id", "local_phone", "iban", "secret")
KINDS = BASE + MORE

# Possessive forms of the contract's patterns: no match is lost, and long runs take linear time.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

#: Broad shapes of candidates; what they find is up to the votes and the classifier. All take linear time.
_BROAD = {
    "national_id": re.compile(r"(?<![0-9A-Za-z.-])[0-9]{2,4}+(?:[\x20-][0-9]{2,4}+){2}(?![0-9A-Za-z-])"),
    "local_phone": re.compile(r"(?<![0-9A-Za-z+])(?:\([0-9]{2,5}+\)\x20?|[0-9]{3,5}+[./\x20-])[0-9]{2,4}+(?:[.\x20-][0-9]{2,5}+){0,2}(?![0-9A-Za-z])"),
    "iban": re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"),
}
_RUN = re.compile(r"[A-Za-z0-9_+/.-]{16,}+={0,2}")
#: A value that is assigned: a name, = or :, spaces, an opening quote or none, and the value as far as it goes.
_ASSIGNED = re.compile(r"(?<![0-9A-Za-z_])([A-Za-z_][0-9A-Za-z_-]{1,40}+)[\"']?\x20{0,3}[=:]\x20{0,3}(?:\"([^\"\r\n]{6,}+)|'([^'\r\n]{6,}+)|([^\s,;\"']{6,}+))")
_NATIONAL = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")
_LOCAL_PHONE = re.compile(r"(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}")
_KEY = re.compile(r"AKIA[0-9A-Z]{16}|[0-9a-f]{32,}|[0-9A-F]{32,}|(?=[^0-9]*[0-9])(?=.*[A-Z])(?=.*[a-z])[A-Za-z0-9_+/.-]{20,}={0,2}")
#: Words that stand before such data, or name it in an assignment.
CUES = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "payment", "credit"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "national_id": ("ssn", "social", "security", "id"),
    "local_phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank"),
    "secret": ("key", "login", "credential", "secret", "token", "passw", "auth", "bearer"),
}
GAZETTEER = {
    "email": ("gmail", "yahoo", "outlook", "hotmail", "mail", "example"),
    "iban": ("DE", "FR", "ES", "IT", "NL", "GB", "AT", "BE", "CH", "PT"),
    "secret": ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "api-key", "access_key", "private_key"),
    "phone": ("+1", "+33", "+34", "+44", "+49", "+39", "+31"),
}
LABELERS = ("pattern", "checksum", "gazetteer", "context", "assigned", "table")
BEFORE = 30


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _iban_ok(text: str) -> bool:
    t = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points: leftmost matches of each kind that don't overlap and pass its check."""
    out, at = [], 0
    p = text.find("@")
    while p >= 0:
        s = p
        while s > at and text[s - 1] in _LOCAL:
            s -= 1
        m = _DOMAIN.match(text, p + 1) if s < p else None
        if m:
            at = m.end()
            out.append((s, at, "email"))
        p = text.find("@", p + 1)
    if _DIGIT.search(text):
        out += [(*m.span(), "ip") for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "") if m.end() - m.start() >= 14 else ""
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((*m.span(), "card"))
        if "+" in text:
            out += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]
    out.sort(key=lambda x: (x[0], KINDS.index(x[2])))
    return out


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans of the kinds that the method adds, apart from the base spans and from each other: the first that begins, of these the longest, then one of strict form."""
    found = []
    if _DIGIT.search(text):
        for kind, shape in _BROAD.items():
            found += [(*m.span(), kind) for m in shape.finditer(text)]
    if _DIGIT.search(text) or "AKIA" in text:
        found += [(*m.span(), "secret") for m in _RUN.finditer(text) if _DIGIT.search(m[0]) or m[0].startswith("AKIA")]
    if "=" in text or ":" in text:
        found += [(*m.span(m.lastindex), "secret") for m in _ASSIGNED.finditer(text)]
    starts = [s for s, _, _ in base]
    ends: list[int] = []  # how far the base spans up to each one reach
    for _, e, _ in base:
        ends.append(max(e, ends[-1]) if ends else e)
    out, at = [], 0
    for s, e, kind in sorted(found, key=lambda x: (x[0], -x[1], -_pattern(x[2], text[x[0] : x[1]]), KINDS.index(x[2]))):
        before = bisect.bisect_left(starts, e)
        if s >= at and not (before and ends[before - 1] > s):
            out.append((s, e, kind))
            at = e
    return out


def _named(text: str, start: int) -> str:
    """The name that a value at start is assigned to, in small letters, or nothing."""
    left = text[max(0, start - 48) : start].rstrip("\"'").rstrip(" ")
    if not left or left[-1] not in "=:":
        return ""
    left = left[:-1].rstrip(" ").rstrip("\"'")
    at = len(left)
    while at and (left[at - 1].isalnum() or left[at - 1] in "_-"):
        at -= 1
    return left[at:].lower()


def _pattern(kind: str, span: str) -> int:
    """Whether the span has the strict form of its kind."""
    if kind in BASE:
        return 1
    if kind == "national_id":
        return int(bool(_NATIONAL.fullmatch(span)))
    if kind == "local_phone":
        return int(bool(_LOCAL_PHONE.fullmatch(span)))
    if kind == "iban":
        return int(15 <= len(span.replace(" ", "")) <= 34)
    return int(bool(_KEY.fullmatch(span)))


def _checked(kind: str, span: str) -> int:
    """A checksum's or a range's vote: 1, 0, or -1 where the kind has none."""
    if kind in ("ip", "card"):
        return 1
    if kind == "iban":
        return int(_iban_ok(span))
    if kind == "national_id":
        groups = re.split("[ -]", span)
        return int([len(g) for g in groups] == [3, 2, 4] and groups[0] not in ("000", "666") and groups[0][0] != "9" and groups[1] != "00" and groups[2] != "0000")
    return -1


def votes(text: str, start: int, end: int, kind: str) -> tuple[int, ...]:
    """Each labeler's vote: 1 for personal data, 0 against, -1 none."""
    span, name, names = text[start:end], _named(text, start), GAZETTEER.get(kind)
    before = text[max(0, start - BEFORE) : start].lower()
    edges = text[max(0, start - 2) : start] + text[end : end + 2]
    if kind == "secret":
        known = int(any(n in name for n in names) or span.startswith("AKIA"))
    else:
        known = int(any(n in span for n in names)) if names else -1
    return (
        _pattern(kind, span),
        _checked(kind, span),
        known,
        1 if any(c in before for c in CUES[kind]) else 0 if kind in MORE else -1,
        1 if any(c in name for c in CUES[kind]) else 0 if name else -1,
        0 if any(c in edges for c in "|$€£%") else -1,
    )


def features(text: str, start: int, end: int, kind: str) -> tuple[int, ...]:
    """The kind; how much of the span is digits, capitals and marks, in quarters; its length in powers of two; of its context, whether a
    cue stands before, whether it is assigned to a name (1) or to one with a cue (2), and whether it is quoted; whether its form is strict.
    """
    span, name = text[start:end], _named(text, start)
    share = lambda ok: min(3, 4 * sum(map(ok, span)) // len(span))
    before = text[max(0, start - BEFORE) : start].lower()
    return (
        KINDS.index(kind),
        share(str.isdigit),
        share(str.isupper),
        share(lambda c: not c.isalnum()),
        min(6, len(span).bit_length()),
        int(any(c in before for c in CUES[kind])),
        2 if any(c in name for c in CUES[kind]) else int(bool(name)),
        int(text[start - 1 : start] in ('"', "'") and text[end : end + 1] == text[start - 1 : start]),
        _pattern(kind, span),
    )


FEATURES = 9


def _dense(feats: np.ndarray) -> np.ndarray:
    """Each added kind has weights of its own for what tells its spans apart."""
    kind = np.eye(len(KINDS))[feats[:, 0]]
    own = feats[:, 1:] / np.array([3, 3, 3, 6, 1, 2, 1, 1])
    by_kind = (kind[:, len(BASE) :, None] * own[:, None, 4:]).reshape(len(feats), len(MORE) * own[:, 4:].shape[1])
    return np.concatenate([kind, own, by_kind, np.ones((len(feats), 1))], axis=1)


def reliabilities(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """EM for labelers that err independently: each one's rates of a vote for, by true class, and each pattern's likelihood."""
    if not len(patterns):
        return np.full((2, len(LABELERS)), 0.5), np.zeros(0)
    given, yes = patterns >= 0, patterns == 1
    q = (yes.sum(axis=1) + 1) / (given.sum(axis=1) + 2)
    for _ in range(rounds):
        rate = np.empty((2, patterns.shape[1]))
        for c, w in ((1, q * counts), (0, (1 - q) * counts)):
            # Weak priors: a labeler's vote for is likelier to be right than wrong.
            rate[c] = (w @ yes + (4 if c else 1)) / (w @ given + 5)
        prior = (q @ counts + 1) / (counts.sum() + 2)
        log = [np.log((prior, 1 - prior)[c == 0]) + np.where(given, np.where(yes, np.log(rate[c]), np.log(1 - rate[c])), 0).sum(axis=1) for c in (1, 0)]
        q = 1 / (1 + np.exp(np.clip(log[1] - log[0], -50, 50)))
    return rate, q


def span_classifier(feats: np.ndarray, q: np.ndarray, counts: np.ndarray, steps: int = 300) -> np.ndarray:
    """Weights of a logistic model of the likelihoods, given features alone."""
    x = _dense(feats)
    w = np.zeros(x.shape[1])
    share = counts / max(counts.sum(), 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w))
        w -= 4.0 * (x.T @ ((p - q) * share) + 1e-4 * w)
    return w


_SPAN = "struct<s:int,e:int,kind:string,base:boolean,pattern:array<int>,feats:array<int>>"
_FOUND = f"doc_id long, spans array<{_SPAN}>"
_ARROW = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("kind", pa.string()), ("base", pa.bool_()), ("pattern", pa.list_(pa.int32())), ("feats", pa.list_(pa.int32()))]))


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for ids, texts in chunks(b):
            out = []
            for t in texts:
                base = base_spans(t)
                more = candidates(t, base)
                out.append([{"s": s, "e": e, "kind": k, "base": is_base, "pattern": votes(t, s, e, k), "feats": features(t, s, e, k)} for spans, is_base in ((base, True), (more, False)) for s, e, k in spans])
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(out, _ARROW)], names=["doc_id", "spans"])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", accept: float = 0.5) -> DataFrame:
    """One row for each row of docs: doc_id and spans, an array of (s, e, kind, base) by start, then kind as in KINDS.

    s and e are code points, e exclusive. A null or empty text has no spans. Repeated rows each get their row; other columns are
    ignored. If there are no candidates the classifier accepts none.
    """
    found = staged(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_search, _FOUND), "pii-spans")
    # Bounded by the votes' and features' values, whatever the input; in fact some hundreds of rows.
    seen = sorted(found.select(F.explode("spans").alias("x")).groupBy("x.pattern", "x.feats").count().collect())
    patterns = np.array([r[0] for r in seen], np.int64).reshape(-1, len(LABELERS))
    feats = np.array([r[1] for r in seen], np.int64).reshape(-1, FEATURES)
    counts = np.array([r[2] for r in seen], np.float64)
    _, q = reliabilities(patterns, counts)
    w = span_classifier(feats, q, counts)
    p = 1 / (1 + np.exp(-_dense(feats) @ w)) if len(feats) else np.zeros(0)
    good = sorted({tuple(map(int, f)) for f, ok in zip(feats, p >= accept, strict=True) if ok})
    named = [",".join(map(str, f)) for f in good]
    accepted = lambda x: F.concat_ws(",", x["feats"].cast("array<string>")).isin(named) if named else F.lit(False)
    kept = F.filter("spans", lambda x: x["base"] | accepted(x))
    keyed = F.transform(kept, lambda x: F.struct(x["s"].alias("s"), F.array_position(F.array(*map(F.lit, KINDS)), x["kind"]).alias("rank"), x["e"].alias("e"), x["kind"].alias("kind"), x["base"].alias("base")))
    return found.select("doc_id", F.transform(F.array_sort(keyed), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"), x["base"].alias("base"))).alias("spans"))
