"""Removal of repeated byte strings by a sparse, range-partitioned suffix array.

Every window of WINDOW bytes has an owner: the place of the least hash of a few bytes among its first STRIDE places, which
depends on the window's bytes alone. Equal windows have equal owners, and share all KEEP bytes from the owner on; so only suffixes
that start at owners are sorted, and of these only those whose first KEEP bytes occur twice in the corpus. Splitters taken from a sample
cut the order of suffixes into ranges by their leading bytes; each bucket sorts its suffixes by multikey quicksort, neighbours that
share KEEP bytes form a run, and within a run each window's earliest place stays while its others are removed. A run that
a splitter may have cut goes on in other buckets: its windows are compared across the boundaries by their digests.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolina.llm.common import shuffle_parts, staged
from cartolina.llm.words import forget, tidied

WINDOW, STRIDE, GRAM = 100, 60, 16
KEEP = WINDOW - STRIDE + 1
#: Bytes of text that one numpy step takes; longer texts are cut into overlapping pieces.
PIECE = 1 << 20
#: Bytes of a suffix that splitters look at, and documents that they are sampled from, about.
LEAD, SAMPLE = 48, 2000
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03), np.uint64(0x94D049BB133111EB)

_RUN = np.dtype([("at", "<u4"), ("lo", "u1"), ("hi", "u1")])  # an owner and how far before it its first and last window start
_SPAN = np.dtype([("start", "<u4"), ("count", "<u4")])  # consecutive starts of windows
_NULL_ID = -(1 << 63)  # orders a null id before all others


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * _M1) ^ ((b ^ (b >> np.uint64(29))) * _M2)


def _doubled(data: np.ndarray, upto: int, seed: int = 1) -> dict[int, np.ndarray]:
    """By length (powers of two up to upto), a hash of the bytes from each place on, as far as there are so many."""
    h = (data.astype(np.uint64) + np.uint64(seed)) * _M3
    out, n = {1: h ^ (h >> np.uint64(31))}, 1
    while n < upto:
        h = out[n]
        out[2 * n] = _join(h[:-n], h[n:]) if len(h) > n else h[:0]
        n *= 2
    return out


def _windows(data: np.ndarray, seed: int = 1) -> np.ndarray:
    """A hash of the WINDOW bytes from each place on."""
    d, n = _doubled(data, 64, seed), max(0, len(data) - WINDOW + 1)
    return _join(_join(d[64][:n], d[32][64 : 64 + n]), d[4][96 : 96 + n])


def _pieces(rows: Iterator[tuple], size: int = PIECE) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Documents' bytes laid end to end: (keys, where each piece starts in its document, bounds of the pieces)."""
    keys, froms, parts, held = [], [], [], 0
    for key, raw in rows:
        for lo in range(0, max(1, len(raw) - WINDOW + 1), size):
            piece = raw[lo : lo + size + WINDOW - 1]
            if len(piece) < WINDOW:
                continue
            keys.append(key)
            froms.append(lo)
            parts.append(piece)
            held += len(piece)
            if held >= size:
                yield keys, np.array(froms), parts
                keys, froms, parts, held = [], [], [], 0
    if parts:
        yield keys, np.array(froms), parts


def owners(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one owner: piece, first and last start and owner (all from the piece's start), hash of the KEEP bytes."""
    sizes = np.array([len(p) for p in parts])
    data = np.frombuffer(b"".join(parts), np.uint8)
    d = _doubled(data, 32)
    best = (d[GRAM] & ~np.uint64((1 << 24) - 1)) | np.arange(len(d[GRAM]), dtype=np.uint64)
    span = 1
    while 2 * span <= STRIDE:
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    best = np.minimum(best[: len(best) - (STRIDE - span)], best[STRIDE - span :])
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    counts = sizes - WINDOW + 1
    piece = np.repeat(np.arange(len(parts)), counts)
    start = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + begins[piece]
    owner = (best[start] & np.uint64((1 << 24) - 1)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (piece[1:] != piece[:-1])]))
    first, last, at, piece = start[new], start[np.append(new[1:], len(start)) - 1], owner[new], piece[new]
    keep = _join(_join(d[32][at], d[8][at + 32]), d[1][at + KEEP - 1])
    return piece, first - begins[piece], last - begins[piece], at - begins[piece], keep


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, its order (never null), a tag that tells rows of one id apart, and the text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = F.col(id_col).cast("long")
    tag = F.xxhash64(text)
    return docs.select(own.alias("doc_id"), F.coalesce(own, F.lit(_NULL_ID)).alias("doc"), tag.alias("tag"), text.cast("binary").alias("raw"))


def _pack(*arrays: np.ndarray) -> bytes:
    return zstandard.compress(b"".join(a.tobytes() for a in arrays), 1)


def _unpack(blob: bytes, *types: str) -> list[np.ndarray]:
    data = zstandard.decompress(blob)
    n = len(data) // sum(np.dtype(t).itemsize for t in types)
    out, at = [], 0
    for t in types:
        out.append(np.frombuffer(data, t, n, at))
        at += n * np.dtype(t).itemsize
    return out


_POSTED = ("<u8", "<i8", "<i8", _RUN)


def _bucket(docs: np.ndarray, parts: int) -> np.ndarray:
    """The part that gathers a document's runs."""
    return (((docs.astype(np.uint64) * _M1) >> np.uint64(33)) % np.uint64(parts)).astype(np.int32)


def _packets(part: np.ndarray, known: bool, *arrays: np.ndarray) -> list[tuple[int, bool, bytes]]:
    """The arrays packed by part."""
    order = np.argsort(part, kind="stable")
    cuts = np.append(np.flatnonzero(np.diff(part[order], prepend=-1)), len(part))
    return [(int(part[order[lo]]), known, _pack(*(x[order[lo:hi]] for x in arrays))) for lo, hi in zip(cuts, cuts[1:], strict=False)]


def _packet_rows(told: list[tuple[int, bool, bytes]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([t[i] for t in told], kind) for i, kind in enumerate((pa.int32(), pa.bool_(), pa.binary()))], names=["part", "known", "packed"])


def _posted(parts: int, size: int):
    """For each step and part, packed: hash, document, tag and run of each owner.

    Owners whose hash stands twice in one task (a common line's, say) are known at once to stand twice: they go straight to their
    documents' parts, and only the first two go to the hash's part, so that other tasks' owners meet them there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        common = np.zeros(0, np.uint64)  # hashes met twice in a step of this task, as many as its input has
        rows = (((doc, tag), raw) for b in batches for doc, tag, raw in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for keys, froms, pieces in _pieces(rows, size):
            piece, first, last, at, keep = owners(pieces)
            runs = np.empty(len(at), _RUN)
            runs["at"], runs["lo"], runs["hi"] = at + froms[piece], at - first, at - last
            docs, tags = np.array([k[0] for k in keys], np.int64)[piece], np.array([k[1] for k in keys], np.int64)[piece]
            order = np.lexsort((runs["at"], tags, docs, keep))
            own, d, t, a = keep[order], docs[order], tags[order], runs["at"][order]
            new = np.concatenate([[True], own[1:] != own[:-1]])
            # Repeated rows, and the pieces of a cut text, show one place twice.
            place = np.cumsum(new | np.concatenate([[True], (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (a[1:] != a[:-1])]))
            begin = np.flatnonzero(new)
            width = np.diff(np.append(begin, len(own)))
            nth = place - np.repeat(place[begin], width)  # of an owner's place among those of its hash
            kinds, count = own[begin], place[begin + width - 1] - place[begin] + 1
            met = np.isin(kinds, common)
            # Of a hash met before all are known; of one that the step has at three places or more, all but those at the first two.
            known = np.empty(len(keep), bool)
            known[order] = np.repeat(met, width) | (nth > 1)
            common = np.union1d(common, kinds[(count > 2) & ~met])
            told = _packets(((keep >> np.uint64(20)) % np.uint64(parts)).astype(np.int32)[~known], False, keep[~known], docs[~known], tags[~known], runs[~known])
            told += _packets(_bucket(docs[known], parts), True, docs[known], tags[known], runs[known])
            yield _packet_rows(told)

    return run


def _by_document(docs: np.ndarray, tags: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    order = np.lexsort((tags, docs))
    docs, tags, values = docs[order], tags[order], values[order]
    cuts = np.append(np.flatnonzero(np.concatenate([[True], (docs[1:] != docs[:-1]) | (tags[1:] != tags[:-1])])) if len(docs) else np.zeros(0, np.int64), len(docs))
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        yield int(docs[lo]), int(tags[lo]), values[lo:hi].tobytes()


def _rows(told: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([t[0] for t in told], pa.int64()), pa.array([t[1] for t in told], pa.int64()), pa.array([t[2] for t in told], pa.binary())], names=["doc", "tag", "packed"])


def _twice(parts: int):
    """Of a part's owners those whose KEEP bytes stand at two places, packed by bucket of documents; known ones pass as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for b in batches:
            told = list(zip(*(c.to_pylist() for c in b.columns), strict=True))
            held += [_unpack(x, *_POSTED) for _, known, x in told if not known]
            yield _packet_rows([t for t in told if t[1]])
        if not held:
            return
        keep, docs, tags, runs = (np.concatenate([h[i] for h in held]) for i in range(4))
        del held
        _, inverse, count = np.unique(keep, return_inverse=True, return_counts=True)
        some = count[inverse] > 1
        docs, tags, runs, inverse = docs[some], tags[some], runs[some], inverse[some]
        del keep, some
        # A row that is repeated as a whole, or the two pieces of a cut text, show the same place again: that is no second place.
        order = np.lexsort((runs["at"], tags, docs, inverse))
        i, d, t, a = inverse[order], docs[order], tags[order], runs["at"][order]
        fresh = np.concatenate([[True], (i[1:] != i[:-1]) | (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (a[1:] != a[:-1])]) if len(i) else np.zeros(0, bool)
        real = np.bincount(i[fresh], minlength=len(count))[inverse] > 1
        docs, tags, runs = docs[real], tags[real], runs[real]
        order = np.argsort(docs, kind="stable")
        yield _packet_rows(_packets(_bucket(docs[order], parts), True, docs[order], tags[order], runs[order]))

    return run


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket's documents, each with all its runs."""
    held = [_unpack(x, "<i8", "<i8", _RUN) for b in batches for x in b.column(2).to_pylist()]
    told = list(_by_document(*(np.concatenate([h[i] for h in held]) for i in range(3)))) if held else []
    for lo in range(0, len(told), 5000):
        yield _rows(told[lo : lo + 5000])


def _suffixes(splitters: list[bytes]):
    """Per batch and bucket, packed: the suffixes with what stands before them; a string met before in the batch is removed at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(c.to_pylist() for c in b.columns), strict=True)
            earliest: dict[tuple, tuple[int, int, int]] = {}
            gone: list[tuple[int, int, int, int]] = []
            for doc, tag, z, packed in sorted(rows, key=lambda r: (r[0], r[1])):
                raw = zstandard.decompress(z)
                for at, lo, hi in np.unique(np.frombuffer(packed, _RUN)).tolist():
                    start = at - lo
                    s = (raw[start : at - hi + WINDOW], lo)
                    here = (doc, start, tag)
                    was = earliest.setdefault(s, here)
                    if was[:2] == here[:2]:
                        if was[2] != tag:  # another row of the same id: neither is earlier, so both go on
                            earliest[(*s, tag)] = here
                        continue
                    if here < was:
                        earliest[s], here = here, was
                    gone.append((here[0], here[2], here[1], lo - hi + 1))
            buckets: dict[int, list] = {}
            for (s, lo, *_), (doc, start, tag) in earliest.items():
                buckets.setdefault(bisect.bisect_right(splitters, s[lo : lo + LEAD]), []).append((s, lo, doc, start, tag))
            out = []
            for k, own in buckets.items():
                meta = np.array([(doc, start, tag, lo, len(s)) for s, lo, doc, start, tag in own], np.int64)
                out.append((k, _pack(meta), zstandard.compress(b"".join(r[0] for r in own), 1)))
            if gone:
                out.append((gone[0][0] % (len(splitters) + 1), _pack(np.array(gone, np.int64)), None))
            yield pa.record_batch([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.binary()), pa.array([o[2] for o in out], pa.binary())], names=["bucket", "meta", "strings"])

    return run


def multikey_quicksort(words: np.ndarray, small: int = 48) -> np.ndarray:
    """The order of rows by their words, the first deciding: rows are parted by one word at a time into less, equal and greater,
    and only equal ones go on to the next word."""
    out = np.empty(len(words), np.int64)
    stack = [(np.arange(len(words)), 0, 0)]
    while stack:
        rows, depth, at = stack.pop()
        if depth == words.shape[1] or len(rows) <= 1:
            out[at : at + len(rows)] = rows
        elif len(rows) <= small:
            out[at : at + len(rows)] = rows[np.lexsort(words[rows, depth:].T[::-1])]
        else:
            key = words[rows, depth]
            pivot = np.median(key[:: max(1, len(key) // 15)].astype(np.float64))
            pivot = key[np.abs(key.astype(np.float64) - pivot).argmin()]
            less, equal, more = rows[key < pivot], rows[key == pivot], rows[key > pivot]
            stack += [(less, depth, at), (equal, depth + 1, at + len(less)), (more, depth, at + len(less) + len(equal))]
    return out


def _removed(strings: list[bytes], docs: np.ndarray, starts: np.ndarray, tags: np.ndarray, mixed: bool) -> tuple:
    """Of strings with windows in common: windows that also stand earlier, as (document, tag, start); or all windows' digests, if they may also stand elsewhere."""
    data = np.frombuffer(b"".join(strings), np.uint8)
    sizes = np.array([len(s) for s in strings])
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    counts = sizes - WINDOW + 1
    of = np.repeat(np.arange(len(strings)), counts)
    offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    at = begins[of] + offset
    h, doc, start, tag = _windows(data)[at], docs[of], starts[of] + offset, tags[of]
    if mixed:
        return h, _windows(data, 77)[at], doc, tag, start
    order = np.lexsort((start, doc, h))
    h, doc, start, tag, at = h[order], doc[order], start[order], tag[order], at[order]
    new = np.concatenate([[True], h[1:] != h[:-1]])
    lead = np.flatnonzero(new)[np.cumsum(new) - 1]
    same = (doc == doc[lead]) & (start == start[lead])
    late = np.flatnonzero(~same)
    wrong = []
    for lo in range(0, len(late), 8192):  # the bytes decide, not the hash
        own = late[lo : lo + 8192]
        differ = (data[at[own][:, None] + np.arange(WINDOW)] != data[at[lead[own]][:, None] + np.arange(WINDOW)]).any(axis=1)
        wrong += own[differ].tolist()
    if wrong:
        first: dict[bytes, tuple[int, int]] = {}
        again = set(lead[wrong].tolist())
        for i in np.flatnonzero(np.isin(lead, list(again))).tolist():
            s = data[at[i] : at[i] + WINDOW].tobytes()
            same[i] = first.setdefault(s, (int(doc[i]), int(start[i]))) == (int(doc[i]), int(start[i]))
    late = ~same
    return doc[late], tag[late], start[late]


def _spans_of(doc: np.ndarray, tag: np.ndarray, start: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    order = np.lexsort((start, tag, doc))
    doc, tag, start = doc[order], tag[order], start[order]
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (start[1:] != start[:-1] + 1)])) if len(doc) else np.zeros(0, np.int64)
    spans = np.empty(len(new), _SPAN)
    spans["start"], spans["count"] = start[new], np.diff(np.append(new, len(doc)))
    yield from _by_document(doc[new], tag[new], spans)


def _sorted_buckets(splitters: list[bytes], parts: int):
    """Removed windows by document (part -1), and packed digests of windows of runs that a splitter may cut, by part."""
    cut = {s[:KEEP] for s in splitters}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        metas, strings, told = [], [], []
        for b in batches:
            for meta, data in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if data is None:
                    gone = _unpack(meta, "<i8")[0].reshape(-1, 4)
                    spans = np.empty(len(gone), _SPAN)
                    spans["start"], spans["count"] = gone[:, 2], gone[:, 3]
                    told += [(-1, *r) for r in _by_document(gone[:, 0], gone[:, 1], spans)]
                    continue
                m, data = _unpack(meta, "<i8")[0].reshape(-1, 5), zstandard.decompress(data)
                metas.append(m)
                ends = np.cumsum(m[:, 4])
                strings += [data[e - n : e] for e, n in zip(ends.tolist(), m[:, 4].tolist(), strict=True)]
        if metas:
            meta = np.concatenate(metas)
            suffixes = b"".join(s[lo : lo + WINDOW].ljust(104, b"\0") for s, lo in zip(strings, meta[:, 3].tolist(), strict=True))
            words = np.frombuffer(suffixes, ">u8").reshape(-1, 13).astype(np.uint64)
            order = multikey_quicksort(words)
            heads = np.frombuffer(suffixes, np.uint8).reshape(-1, 104)[:, :KEEP]
            new = np.concatenate([[True], (heads[order[1:]] != heads[order[:-1]]).any(axis=1)])
            cuts = np.append(np.flatnonzero(new), len(order))
            del words
            slice_of: list[np.ndarray] = []
            held = 0

            def flush(own: np.ndarray, mixed: bool) -> None:
                got = _removed([strings[i] for i in own.tolist()], meta[own, 0], meta[own, 1], meta[own, 2], mixed)
                if mixed:
                    h, g, doc, tag, start = got
                    part = (h >> np.uint64(33)) % np.uint64(parts)
                    for p in np.unique(part).tolist():
                        w = part == p
                        told.append((p, 0, 0, _pack(h[w], g[w], doc[w].astype("<i8"), tag[w].astype("<i8"), start[w].astype("<u4"))))
                else:
                    told.extend((-1, *r) for r in _spans_of(*got))

            for lo, hi in zip(cuts, cuts[1:], strict=False):
                own = order[lo:hi]
                first = own[0]
                mixed = strings[first][meta[first, 3] : meta[first, 3] + KEEP] in cut
                if mixed:
                    flush(own, True)
                elif hi - lo > 1:
                    slice_of.append(own)
                    held += int(meta[own, 4].sum())
                    if held >= PIECE:
                        flush(np.concatenate(slice_of), False)
                        slice_of, held = [], 0
            if slice_of:
                flush(np.concatenate(slice_of), False)
        for lo in range(0, len(told), 5000):
            part = told[lo : lo + 5000]
            yield pa.record_batch([pa.array([t[i] for t in part], kind) for i, kind in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=["part", "doc", "tag", "packed"])

    return run


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of windows from all buckets: what also stands earlier is removed."""
    held = [_unpack(x, "<u8", "<u8", "<i8", "<i8", "<u4") for b in batches for x in b.column(1).to_pylist()]
    if not held:
        return
    h, g, doc, tag, start = (np.concatenate([x[i] for x in held]) for i in range(5))
    order = np.lexsort((start, doc, g, h))
    h, g, doc, tag, start = h[order], g[order], doc[order], tag[order], start[order].astype(np.int64)
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])])
    lead = np.flatnonzero(new)[np.cumsum(new) - 1]
    late = (doc != doc[lead]) | (start != start[lead])
    told = list(_spans_of(doc[late], tag[late], start[late]))
    yield _rows(told)


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(3)
    for b in batches:
        yield pa.record_batch([*b.columns[:3], pa.array([squeeze.compress(x) for x in b.column(3).to_pylist()], pa.binary())], names=["doc_id", "doc", "tag", "z"])


def merged(spans: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of removed bytes, from spans of window starts."""
    out: list[list[int]] = []
    for s, n in sorted(spans.tolist()):
        e = s + n + WINDOW - 1
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


_OUT = "doc_id long, n_bytes long, kept binary, spans array<struct<s:long,e:long>>"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
    for b in batches:
        for at in range(0, b.num_rows, 1000):
            part = b.slice(at, 1000)
            sizes, kept, spans = [], [], []
            for z, packed in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                raw = zstandard.decompress(z)
                gone = merged(np.concatenate([np.frombuffer(p, _SPAN) for p in packed])) if packed else []
                edges = [0, *(x for s, e in gone for x in (s, e)), len(raw)]
                kept.append(b"".join(raw[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)))
                sizes.append(len(raw))
                spans.append([{"s": s, "e": e} for s, e in gone])
            yield pa.record_batch([part.column(0), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, kind)], names=["doc_id", "n_bytes", "kept", "spans"])


def _splitters(texts: DataFrame, buckets: int) -> list[bytes]:
    """Quantiles of the leading bytes of suffixes of about SAMPLE documents, taken by a hash of the id."""
    rows = texts.count()
    share = min(1.0, SAMPLE / max(rows, 1))
    taken = texts.where(F.pmod(F.xxhash64("doc", F.lit(4)), F.lit(1 << 20)) < int(share * (1 << 20))).select("doc", "raw").collect()
    leads = []
    for _, _, pieces in _pieces(((r["doc"], bytes(r["raw"])) for r in taken)):
        piece, _, _, at, _ = owners(pieces)
        leads += [pieces[p][a : a + LEAD] for p, a in zip(piece.tolist(), at.tolist(), strict=True)]
    leads.sort()
    return sorted({leads[i * len(leads) // buckets] for i in range(1, buckets)}) if leads else []


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None, piece: int = PIECE) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, kept (the bytes that stay) and spans (maximal removed runs of bytes, e exclusive).

    A byte goes if a WINDOW-byte string that covers it also starts earlier: in a document with a smaller id, or
    in its own before. Texts are UTF-8 bytes, null is empty, and strings never cross documents; a null id orders
    before all others. Rows that repeat an id and its text are judged as one document and get the same result; rows of one id with other texts
    are judged apart, told apart by a 64-bit hash of the text, and neither is earlier at equal starts. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    parts = shuffle_parts(spark)
    texts = _keyed(docs, id_col, text_col)
    splitters = _splitters(texts, buckets or parts)
    squeezed = texts.mapInArrow(tidied(_compressed), "doc_id long, doc long, tag long, z binary")
    packed = "part int, known boolean, packed binary"
    twice = texts.select("doc", "tag", "raw").mapInArrow(tidied(_posted(parts, piece)), packed).repartitionById(parts, F.col("part")).mapInArrow(tidied(_twice(parts)), packed)
    runs = twice.repartitionById(parts, F.col("part")).mapInArrow(tidied(_gathered), "doc long, tag long, packed binary")
    strings = squeezed.join(runs, ["doc", "tag"]).select("doc", "tag", "z", "packed").mapInArrow(tidied(_suffixes(splitters)), "bucket int, meta binary, strings binary")
    found = staged(strings.repartitionById(len(splitters) + 1, F.col("bucket")).mapInArrow(tidied(_sorted_buckets(splitters, parts)), "part int, doc long, tag long, packed binary"), "suffix-spans")
    across = found.where("part >= 0").select("part", "packed").repartitionById(parts, F.col("part")).mapInArrow(tidied(_across), "doc long, tag long, packed binary")
    gone = found.where("part < 0").select("doc", "tag", "packed").unionByName(across).groupBy("doc", "tag").agg(F.collect_list("packed").alias("packed"))
    return squeezed.join(gone, ["doc", "tag"], "left").select("doc_id", "z", "packed").mapInArrow(tidied(_cut), _OUT)
