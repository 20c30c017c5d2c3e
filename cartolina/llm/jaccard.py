"""Exact n-gram Jaccard self-join with a token-group matrix.

Texts with equal shingle sets count once. All tokens have one order, seldom ones first by a sketch of fixed size, and sets with enough
overlap share many of those that come first in it. Sets that are likely alike form groups: those whose least first token that
any other set shares is the same. A group's column of the token-group matrix is the union of its members' tokens; it is stored in
two forms, its first tokens parted by token, and for groups that sets from elsewhere ask, its whole union. How many first tokens
a set shares with a group bounds its overlap with every member; where that qualifies, the bound is taken again over the stored
whole union. Only groups that qualify then are opened: their members' texts are brought and compared with the set's. Members whose component
is joined to the query's already are passed over, as another link would not change it.

Tokens are 64-bit hashes of shingles: two shingles count as equal if their hashes are. Sets are told apart by 128-bit digests of their
tokens; where 64 bits of these, which postings carry, are not enough, the sets in question get others.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolina.llm.common import shuffle_parts, small_batches, staged, two_columns
from cartolina.llm.components import components
from cartolina.llm.words import forget, tidied

CELLS = 1 << 24
SKETCH_SHARDS = 64
#: Groups with more members are split, and their members first compared with one leader.
GROUP = 256
#: Sets that ask one part of a group in one task, about; where more ask, copies of its union, and of its members, are dealt to several tasks.
ASKED = 512
MORE = 10
SELDOM = 8
#: Sets of a group differ in size by less than this factor.
SIZES = 1.1
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Hasher:
    """64-bit hashes of words, kept for the words met last."""

    def __init__(self, limit: int = 150_000):
        self.limit, self.known, self.old = limit, {}, {}

    def words(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > self.limit:
            self.old, self.known = self.known, {}
        known, old = self.known, self.old
        for w in set(words).difference(known):
            known[w] = old.get(w) or xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingled(hasher: Hasher, raws: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's k-word shingles; A-Z count as a-z."""
    split = [raw.lower().split() for raw in raws]
    counts = [len(w) for w in split]
    h = hasher.words([w for words in split for w in words])
    full = np.full(max(0, len(h) - k + 1), k, np.uint64)
    for j in range(k):
        full = _mix(full, h[j : len(h) - k + 1 + j])
    out, at = [], 0
    for n in counts:
        if n >= k:
            own = np.sort(full[at : at + n - k + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        else:
            short = np.full(min(n, 1), n, np.uint64)
            for j in range(n):
                short = _mix(short, h[at + j : at + j + 1])
            out.append(short)
        at += n
    return out


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a = (a ^ b) * _A
    return a ^ (a >> np.uint64(29))


def needed(a: int, b: int, percent: int) -> int:
    """The least intersection of sets of these sizes with 100 * intersection >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_size(n: int, percent: int) -> int:
    """How many first tokens are posted: one more than may be missing would do; a tenth more makes the bound on shared ones sharp."""
    return n - -(-percent * n // 100) + max(1, n // MORE)


def _digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _chunks(batches: Iterator[pa.RecordBatch], hasher: Hasher, k: int, size: int = 1 << 20) -> Iterator[tuple[list, list[np.ndarray], bool]]:
    """Ids and shingles by chunk of about so many bytes; the last of a batch is told."""
    for b in batches:
        ids, raws, held = [], [], 0
        for i, t in zip(b.column(0), b.column(1).cast(pa.binary()), strict=True):
            ids.append(i.as_py())
            raws.append(t.as_py() or b"")
            held += len(raws[-1])
            if held >= size:
                yield ids, shingled(hasher, raws, k), False
                ids, raws, held = [], [], 0
        yield ids, shingled(hasher, raws, k), True


def _cell(tokens: np.ndarray) -> np.ndarray:
    return (tokens & np.uint64(CELLS - 1)).astype(np.int64)


_SIZED = "doc_id long, n_shingles long, mark binary, handle long, shard int, cells binary"


def _sized(k: int, bits: int):
    """Each text's set size and digest; and, once a task, a sketch of how many texts have each token, copies within a batch once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        hasher, cells, seen = Hasher(), np.zeros(CELLS, np.int32), set()
        for ids, sets, last in _chunks(batches, hasher, k):
            marks = [_digest(s) if len(s) else None for s in sets]
            new = []
            for s, mark in zip(sets, marks, strict=True):
                if mark is not None and mark not in seen:
                    seen.add(mark)
                    new.append(s)
            if new:
                np.add.at(cells, _cell(np.concatenate(new)), 1)
            if last:
                seen.clear()
            none = [None] * len(ids)
            handles = [m and handle_of(m, {}, bits) for m in marks]
            yield _row(ids, [len(s) for s in sets], marks, handles, none, none)
        none = [None] * SKETCH_SHARDS
        yield _row(none, none, none, none, list(range(SKETCH_SHARDS)), [zstandard.compress(p.tobytes(), 1) for p in cells.reshape(SKETCH_SHARDS, -1)])

    return run


def _row(*columns: list) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.binary())
    return pa.record_batch([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=["doc_id", "n_shingles", "mark", "handle", "shard", "cells"])


def _added(usual: float):
    """Summed shards, each cell as the power of two by which its count exceeds what most cells have: one byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for shard, cells in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = np.frombuffer(zstandard.decompress(cells), np.int32)
                total[shard] = total[shard] + got if shard in total else got.astype(np.int64)
        told = [np.ceil(np.log2(np.maximum(c / usual, 1))).astype(np.uint8).tobytes() for c in total.values()]
        yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array(told, pa.binary())], names=["shard", "cells"])

    return run


def _classes(both: DataFrame) -> np.ndarray:
    """By cell of a token's hash, the class of its count: CELLS bytes, whatever the input. Counts up to SELDOM, or twice the mean, are alike."""
    total = both.agg(F.sum("n_shingles")).first()[0] or 0
    usual = max(float(SELDOM), 2 * total / CELLS)
    shards = both.where("shard is not null").select("shard", "cells").repartitionById(SKETCH_SHARDS, F.col("shard")).mapInArrow(tidied(_added(usual)), "shard int, cells binary").collect()
    cells = np.zeros((SKETCH_SHARDS, CELLS // SKETCH_SHARDS), np.uint8)
    for r in shards:
        cells[r["shard"]] = np.frombuffer(r["cells"], np.uint8)
    return cells.ravel()


def _first(tokens: np.ndarray, classes: np.ndarray, percent: int) -> np.ndarray:
    """A set's first tokens in the order of class, then hash."""
    key = (classes[_cell(tokens)].astype(np.uint64) << np.uint64(58)) | (tokens >> np.uint64(6))
    return tokens[np.argsort(key, kind="stable")[: prefix_size(len(tokens), percent)]]


_FIRST = np.dtype([("token", "<u8"), ("handle", "<u8"), ("n", "<u4")])
_POSTING = np.dtype([("token", "<u8"), ("group", "<u8"), ("handle", "<u8"), ("n", "<u4")])


def handle_of(mark: bytes, others: dict[bytes, int], bits: int = 64) -> int:
    """The number that stands for a set in postings: the first bits of its digest, or what others gives it, as a signed long."""
    own = others.get(mark)
    return int.from_bytes(mark[:8], "little", signed=True) >> (64 - bits) if own is None else own


def _handled(sized: DataFrame, rows: int) -> tuple[DataFrame, dict[bytes, int]]:
    """mark, handle and rep of each distinct set, no two with one handle; and the handles of sets whose first bits others have too.

    Of n sets about n ** 2 / 2 ** 64 pairs share a handle, a few in 10 ** 10 sets; these come to the driver.
    """
    others: dict[bytes, int] = {}
    reps = staged(sized.where("mark is not null and doc_id is not null").groupBy("mark", "handle").agg(F.min("doc_id").alias("rep")), "jaccard-reps", rows=rows)
    clash = reps.join(reps.groupBy("handle").count().where("count > 1").select("handle"), "handle", "left_semi")
    for r in clash.select("mark").toLocalIterator():
        mark = bytes(r["mark"])
        others[mark] = int.from_bytes(hashlib.blake2b(mark, digest_size=8).digest(), "little", signed=True)
    if others:
        told = sized.sparkSession.createDataFrame([(bytearray(m), h) for m, h in others.items()], "mark binary, other long")
        reps = staged(reps.join(told, "mark", "left").select("mark", "rep", F.coalesce("other", "handle").alias("handle")), "jaccard-reps")
    return reps, others


def _postings(k: int, percent: int, parts: int, held, others: dict[bytes, int], bits: int):
    """For each chunk and part, packed: token, handle and size, for the first tokens of each distinct set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        hasher, classes, seen = Hasher(), held.value, set()
        for _, sets, last in _chunks(batches, hasher, k):
            rows = []
            for s in sets:
                mark = _digest(s)
                if not len(s) or mark in seen:
                    continue
                seen.add(mark)
                first = _first(s, classes, percent)
                p = np.empty(len(first), _FIRST)
                p["token"], p["handle"], p["n"] = first, np.int64(handle_of(mark, others, bits)).view(np.uint64), len(s)
                rows.append(p)
            if last:
                seen.clear()
            if not rows:
                continue
            yield _parted(np.concatenate(rows), "token", parts)

    return run


def _parted(rows: np.ndarray, by: str, parts: int) -> pa.RecordBatch:
    """Rows packed by the part of one of their fields."""
    part = ((rows[by] * _B) >> np.uint64(33)) % np.uint64(parts)
    order = np.argsort(part, kind="stable")
    rows, part = rows[order], part[order]
    cuts = np.flatnonzero(np.diff(part)) + 1
    return pa.record_batch([pa.array(part[np.concatenate([[0], cuts])].astype(np.int32)), pa.array([zstandard.compress(x.tobytes(), 1) for x in np.split(rows, cuts)], pa.binary())], names=["part", "packed"])


def _unpacked(batches: Iterator[pa.RecordBatch], kind: np.dtype) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(np.frombuffer(zstandard.decompress(x), kind) for b in batches for x in b.column(1).to_pylist())])


def _shared(parts: int):
    """Of a part's tokens those that two sets at least have among their first, packed by set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _unpacked(batches, _FIRST)
        rows = rows[np.lexsort((rows["handle"], rows["token"]))]
        if len(rows):
            same = rows["token"][1:] == rows["token"][:-1]
            rows = rows[np.concatenate([[True], ~same | (rows["handle"][1:] != rows["handle"][:-1])])]  # copies from other batches fall away
            same = rows["token"][1:] == rows["token"][:-1]
            rows = rows[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
        if len(rows):
            yield _parted(rows, "handle", parts)

    return run


def _grouped(parts: int):
    """Each set's group: the least of its shared first tokens, which most sets of one family have, and its size's class; packed by token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _unpacked(batches, _FIRST)
        if len(rows):
            rows = rows[np.lexsort((rows["token"], rows["handle"]))]
            new = np.concatenate([[True], rows["handle"][1:] != rows["handle"][:-1]])
            out = np.empty(len(rows), _POSTING)
            for name in ("token", "handle", "n"):
                out[name] = rows[name]
            size = np.floor(np.log(rows["n"]) / np.log(SIZES)).astype(np.uint64)
            out["group"] = _mix(rows["token"][np.flatnonzero(new)[np.cumsum(new) - 1]], size)
            yield _parted(out, "token", parts)

    return run


#: Rows of a token times its groups that are expanded at once.
EXPANDED = 1 << 18
_PACKED = "part int, packed binary"
_PROBE = np.dtype([("handle", "<u8"), ("home", "<u8"), ("group", "<u8"), ("n", "<i8"), ("shared", "<i8"), ("least", "<i8"), ("most", "<i8")])


def _probes(percent: int, parts: int):
    """From all postings of a part: by set and group, how many first tokens they share, and the sizes of the group's sets that share one; packed by set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _unpacked(batches, _POSTING)
        if not len(rows):
            return
        rows = rows[np.lexsort((rows["handle"], rows["group"], rows["token"]))]
        token = np.cumsum(np.concatenate([[True], rows["token"][1:] != rows["token"][:-1]])) - 1
        entry = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (rows["group"][1:] != rows["group"][:-1])]))
        size = np.diff(np.append(entry, len(rows)))
        n = rows["n"].astype(np.int64)
        least, most = np.minimum.reduceat(n, entry), np.maximum.reduceat(n, entry)
        entry_token = token[entry]
        e_first = np.searchsorted(entry_token, np.arange(entry_token[-1] + 2))  # the entries of each token
        width = (e_first[1:] - e_first[:-1])[token]
        done = np.concatenate([[0], np.cumsum(width)])
        lo = 0
        while lo < len(rows):
            hi = max(lo + 1, int(np.searchsorted(done, done[lo] + EXPANDED, side="right")) - 1)
            w = width[lo:hi]
            i = np.repeat(np.arange(lo, hi), w)
            e = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w) + np.repeat(e_first[token[lo:hi]], w)
            own = rows["group"][i] == rows["group"][entry[e]]
            fits = (100 * n[i] >= percent * least[e]) & (100 * most[e] >= percent * n[i]) & (~own | (size[e] > 1))
            i, e = i[fits], e[fits]
            handle, group = rows["handle"][i], rows["group"][entry[e]]
            order = np.lexsort((group, handle))
            handle, group, i, e = handle[order], group[order], i[order], e[order]
            if len(i):
                at = np.flatnonzero(np.concatenate([[True], (handle[1:] != handle[:-1]) | (group[1:] != group[:-1])]))
                out = np.empty(len(at), _PROBE)
                out["handle"], out["home"], out["group"], out["n"] = handle[at], rows["group"][i[at]], group[at], n[i[at]]
                out["shared"] = np.diff(np.append(at, len(i)))
                out["least"], out["most"] = np.minimum.reduceat(least[e], at), np.maximum.reduceat(most[e], at)
                yield _parted(out, "handle", parts)
            lo = hi

    return run


def qualifies(n: np.ndarray, shared: np.ndarray, least: np.ndarray, most: np.ndarray, percent: int) -> np.ndarray:
    """Whether enough first tokens are shared for an overlap that any of the group's sets would need.

    Of a set of a tokens that needs an overlap of o, a - o at most are missing in the other; so at least p - (a - o) of its
    first p are common, and the same holds for the other side. The first common tokens of either side are among its first ones.
    """
    least, most = np.maximum(least, -(-percent * n // 100)), np.minimum(most, 100 * n // percent)
    need = lambda b: -(-percent * (n + b) // (100 + percent))
    spare = lambda x: np.maximum(1, x // MORE) - -(-percent * x // 100)
    # The other side's bound falls as it grows, but for rounding.
    return shared >= np.maximum(1, np.minimum(need(least) + spare(n), need(most) + spare(most) - 2))


def _qualified(percent: int):
    """Set, home and group where the bound on their overlap qualifies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _unpacked(batches, _PROBE)
        if not len(rows):
            return
        rows = rows[np.lexsort((rows["group"], rows["handle"]))]
        at = np.flatnonzero(np.concatenate([[True], (rows["handle"][1:] != rows["handle"][:-1]) | (rows["group"][1:] != rows["group"][:-1])]))
        good = at[qualifies(rows["n"][at], np.add.reduceat(rows["shared"], at), np.minimum.reduceat(rows["least"], at), np.maximum.reduceat(rows["most"], at), percent)]
        yield pa.record_batch([pa.array(rows[c][good].view(np.int64)) for c in ("handle", "home", "group")], names=["handle", "home", "group"])

    return run


class _Joined:
    """Union-find over the ids of one group."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def top(self, x: int) -> int:
        while self.up.setdefault(x, x) != x:
            self.up[x] = x = self.up[self.up[x]]
        return x


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


class Group:
    """The members of a group, or of a part of a large one: (id, tokens, whether it is known to link to the group's leader)."""

    def __init__(self, members: list[tuple[int, np.ndarray, bool]], percent: int):
        self.percent, self.members = percent, sorted(members, key=lambda m: len(m[1]))
        self.sizes = np.array([len(m[1]) for m in self.members])
        self.joined = _Joined()
        core = [m for m, _, known in members if known]
        for m in core[1:]:
            self.joined.up[self.joined.top(m)] = self.joined.top(core[0])

    def links(self, query: int, tokens: np.ndarray) -> list[tuple[int, int]]:
        """Links of the query to members, one to each component that it joins."""
        out = []
        lo = np.searchsorted(self.sizes, -(-self.percent * len(tokens) // 100))
        hi = np.searchsorted(self.sizes, 100 * len(tokens) // self.percent, side="right")
        for m, own, _ in self.members[lo:hi]:
            if m != query and self.joined.top(m) != self.joined.top(query) and _overlap(tokens, own) >= needed(len(tokens), len(own), self.percent):
                self.joined.up[self.joined.top(query)] = self.joined.top(m)
                out.append((query, m))
        return out

    def inner(self) -> list[tuple[int, int]]:
        """Links that join the components among the members."""
        return [x for m, tokens, _ in self.members for x in self.links(m, tokens)]


def union_of(members: list[tuple[int, np.ndarray, bool]]) -> np.ndarray:
    """The stored union: 32 bits of each token of any member. Tokens that share these only raise the bound."""
    return np.unique(np.concatenate([_short(t) for _, t, _ in members]))


def _short(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(32)).astype(np.uint32)


def may_link(tokens: np.ndarray, union: np.ndarray, least: int, most: int, percent: int) -> bool:
    """Whether a group with this union, and members of these sizes, may hold a set that links: the bound on the overlap."""
    n = len(tokens)
    lo, hi = max(least, -(-percent * n // 100)), min(most, 100 * n // percent)
    if lo > hi or not len(union):
        return False
    short = _short(tokens)
    at = np.searchsorted(union, short)
    at[at == len(union)] = 0
    return int((union[at] == short).sum()) >= needed(n, lo, percent)


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple]:
    """Rows (group, part, then other columns, the packed text last) with the text's tokens instead; null stays null."""
    hasher = Hasher()
    for b in batches:
        *keys, texts = (c.to_pylist() for c in b.columns)
        sets = iter(shingled(hasher, [zstandard.decompress(z) for z in texts if z is not None], k))
        for row, z in zip(zip(*keys, strict=True), texts, strict=True):
            yield *row, None if z is None else next(sets)


_UNITED = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("group", pa.int64()), ("part", pa.int64()), ("least", pa.int64()), ("most", pa.int64()), ("tokens", pa.binary())])


def _united(k: int, percent: int):
    """Members by group and part: the links among them, and for groups that are asked their union and sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        rows = _sets(batches, k)
        for (group, part), own in itertools.groupby(rows, key=lambda r: r[:2]):
            own = list(own)
            members = [(doc, tokens, bool(core)) for _, _, doc, core, _, tokens in own]
            told = [(a, b, None, None, None, None, None) for a, b in Group(members, percent).inner()]
            if any(r[4] for r in own):
                sizes = [len(m[1]) for m in members]
                told.append((None, None, group, part, min(sizes), max(sizes), union_of(members).tobytes()))
            yield pa.record_batch([pa.array([t[i] for t in told], f.type) for i, f in enumerate(_UNITED)], schema=_UNITED)

    return run


def _bounded(k: int, percent: int):
    """A stored union, then the sets that ask its group: those that may link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        out: list[tuple] = []
        now, union, sizes = None, np.zeros(0, np.uint32), (0, 0)
        for group, part, doc, least, most, stored, tokens in _sets(batches, k):
            if doc is None:
                now, union, sizes = (group, part), np.frombuffer(stored, np.uint32), (least, most)
            elif now == (group, part) and may_link(tokens, union, *sizes, percent):
                out.append((doc, group, part))
                if len(out) >= 4096:
                    yield _three(out)
                    out = []
        yield _three(out)

    return run


def _three(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["doc_id", "group", "part"])


def _opened(k: int, percent: int):
    """Members by group and part, then the sets that qualified for it, which pass one by one: their links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for _, rows in itertools.groupby(_sets(batches, k), key=lambda r: r[:2]):
            members, opened, links = [], None, []
            for _, _, query, doc, core, tokens in rows:
                if not query:
                    members.append((doc, tokens, bool(core)))
                    continue
                opened = opened or Group(members, percent)
                links += opened.links(doc, tokens)
                if len(links) >= 4096:
                    yield _links(links)
                    links = []
            yield _links(links)

    return run


def _links(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(3)
    for b in batches:
        yield pa.record_batch([b.column(0), pa.array([squeeze.compress(t or b"") for t in b.column(1).cast(pa.binary()).to_pylist()], pa.binary())], names=["doc_id", "z"])


#: Bits of the filter on ids; it has a fixed size and only spares the join after it some rows.
FILTER = 1 << 23


def _slots(ids: np.ndarray) -> np.ndarray:
    return ((ids.astype(np.uint64) * _A) >> np.uint64(41)).astype(np.int64)


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(FILTER, np.uint8)
    for b in batches:
        bits[_slots(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64))] = 1
    yield pa.record_batch([pa.array([zstandard.compress(np.packbits(bits).tobytes(), 1)], pa.binary())], names=["bits"])


def _texts_of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id and packed text of the wanted ids."""
    bits = np.zeros(FILTER // 8, np.uint8)
    for r in wanted.select("doc_id").mapInArrow(tidied(_marked), "bits binary").toLocalIterator():  # one small blob a task at a time
        bits |= np.frombuffer(zstandard.decompress(r["bits"]), np.uint8)
    held = texts.sparkSession.sparkContext.broadcast(bits)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.unpackbits(held.value).astype(bool)
        for b in batches:
            ids = b.column(0)
            keep = on[_slots(ids.fill_null(0).to_numpy(zero_copy_only=False))] & ~np.asarray(ids.is_null())
            yield from _squeezed(iter([b.filter(pa.array(keep))]))

    return texts.mapInArrow(tidied(near), "doc_id long, z binary").join(wanted, "doc_id")


def _led(k: int, percent: int):
    """Members of a large group beside its leader's text: whether they link to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in batches:
            c = {n: b.column(i).to_pylist() for i, n in enumerate(("doc_id", "group", "leader", "z", "leading"))}
            leaders = {z: s for z, s in zip(set(c["leading"]), shingled(hasher, [zstandard.decompress(z) for z in set(c["leading"])], k), strict=True)}
            core = []
            for x, z in zip(shingled(hasher, [zstandard.decompress(z) for z in c["z"]], k), c["leading"], strict=True):
                core.append(_overlap(x, leaders[z]) >= needed(len(x), len(leaders[z]), percent))
            yield pa.record_batch([pa.array(c["doc_id"], pa.int64()), pa.array(c["group"], pa.int64()), pa.array(c["leader"], pa.int64()), pa.array(core, pa.bool_())], names=["doc_id", "group", "leader", "core"])

    return run


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, percent: int = 85, group: int = GROUP, bits: int = 64, asked: int = ASKED
) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id.

    A text's set is its distinct k-word shingles, or its one whole sequence if it has fewer words; two texts link if 100 *
    intersection >= percent * union. component_id is the smallest id reached by links. A null text, or one without words, has
    no shingles and links with nothing. Equal sets always link; repeated rows each get their row; rows of one id with other texts
    are one document to links; rows with a null id never stand for others; an empty table gives no rows; other columns are ignored.
    Shingles are compared by 64-bit hashes, and equal sets are recognised by 128-bit digests. bits: of a digest that postings carry; sets
    that these don't tell apart get other numbers, so that it doesn't change the result.
    """
    spark = docs.sparkSession
    texts = two_columns(docs, id_col, text_col)
    both = staged(texts.mapInArrow(tidied(_sized(k, bits)), _SIZED), "jaccard-sizes")
    sized = both.where("shard is null").select("doc_id", "n_shingles", "mark", "handle")
    rows = both.count()  # those of documents and a few more
    first, others = _handled(sized, rows)  # one document stands for each distinct set
    held = spark.sparkContext.broadcast(_classes(both))
    parts = shuffle_parts(spark)
    packed = texts.mapInArrow(tidied(_postings(k, percent, parts, held, others, bits)), _PACKED).repartitionById(parts, F.col("part"))
    for step in (_shared(parts), _grouped(parts)):
        packed = packed.mapInArrow(tidied(step), _PACKED).repartitionById(parts, F.col("part"))
    packed = packed.mapInArrow(tidied(_probes(percent, parts)), _PACKED).repartitionById(parts, F.col("part"))
    probes = packed.mapInArrow(tidied(_qualified(percent)), "handle long, home long, group long")
    probed = staged(probes.join(first, "handle").select(F.col("rep").alias("doc_id"), "group", "home"), "jaccard-probes", rows=rows)
    with small_batches(spark):
        tops = components(_links_of(texts, probed, k, percent, group, asked), rows).withColumnRenamed("id", "rep")
    told = first.join(tops, "rep", "left").select("mark", F.coalesce("component_id", "rep").alias("component_id"))
    return sized.join(told, "mark", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _links_of(texts: DataFrame, asked: DataFrame, k: int, percent: int, group: int, crowded: int) -> DataFrame:
    """a, b: links that join all components. asked: each set's home group and a group that it qualifies for, its home or another.

    A group of up to `group` members is one part, a larger one several; each member of a large one is first compared with the group's
    leader. The members of a part are compared with each other by one task, which also stores the part's union. Sets from elsewhere, and
    members of large groups that don't link to the leader, ask the unions of all parts, and those that qualify are compared with the part's members.
    Where more than `crowded` ask, several tasks hold the same union, or the same members, each for some of them.
    """
    parts_of = shuffle_parts(texts.sparkSession)
    n = asked.count()
    members = asked.select("doc_id", F.col("home").alias("group")).distinct()
    asks = asked.where("group < home").select("doc_id", "group").distinct()  # between two groups one direction is enough
    from_elsewhere = asks.select("group").distinct().withColumn("asked", F.lit(True))
    busy = members.groupBy("group").agg(F.count("*").alias("m"), F.min("doc_id").alias("leader"))
    homes = members.join(busy, "group").join(from_elsewhere, "group", "left")
    # A group without other members or queries has nothing to open.
    homes = staged(homes.where("m > 1 or asked").withColumn("asked", F.coalesce("asked", F.col("m") > group)), "jaccard-members", rows=n)
    wanted = homes.select("doc_id").union(asks.select("doc_id")).distinct()
    packed = staged(_texts_of(texts, staged(wanted, "jaccard-wanted", rows=n)), "jaccard-texts")
    large = homes.where(F.col("m") > group)
    leading = large.where("doc_id = leader").join(packed, "doc_id").groupBy("group").agg(F.min("z").alias("leading"))
    beside = large.join(packed, "doc_id").join(leading, "group").select("doc_id", "group", "leader", "z", "leading")
    led = staged(beside.mapInArrow(tidied(_led(k, percent)), "doc_id long, group long, leader long, core boolean"), "jaccard-led", narrow=True, rows=n)
    core = led.select("doc_id", "group", "core")
    parts = F.ceil(F.col("m") / group).cast("long")
    own = homes.withColumn("part", F.pmod(F.xxhash64("doc_id"), parts)).join(core, ["doc_id", "group"], "left")
    mine = own.join(packed, "doc_id").select("group", "part", "doc_id", "core", "asked", "z")
    united = mine.repartition(parts_of, "group", "part").sortWithinPartitions("group", "part")
    united = staged(united.mapInArrow(tidied(_united(k, percent)), "a long, b long, group long, part long, least long, most long, tokens binary"), "jaccard-unions", rows=n)
    loose = staged(core.where("not core").select("doc_id", "group").unionByName(asks), "jaccard-asking", rows=n)
    salts = lambda n: F.ceil(n / crowded).cast("long")
    dealt = lambda salt: (F.shiftleft("part", 32) + salt).alias("part")
    own_salt = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("salts"))
    every_salt = F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt")
    crowd = loose.groupBy("group").agg(salts(F.count("*")).alias("salts"))
    coming = loose.join(busy, "group").join(crowd, "group")
    coming = coming.select("group", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), "doc_id", "salts")
    coming = coming.select("group", dealt(own_salt), "doc_id").join(packed, "doc_id")
    stored = united.where("tokens is not null").select("group", "part", "least", "most", "tokens").join(crowd, "group")
    stored = stored.select("*", every_salt).select("group", dealt(F.col("salt")), "least", "most", "tokens")
    asking = stored.unionByName(coming, allowMissingColumns=True).select("group", "part", "doc_id", "least", "most", "tokens", "z")
    asking = asking.repartition(parts_of, "group", "part").sortWithinPartitions("group", "part", F.asc_nulls_first("doc_id"))
    good = asking.mapInArrow(tidied(_bounded(k, percent)), "doc_id long, group long, part long").withColumn("part", F.shiftright("part", 32))
    good = staged(good, "jaccard-qualified", narrow=True, rows=n)
    crowd = good.groupBy("group", "part").agg(salts(F.count("*")).alias("salts"))
    opening = own.join(crowd, ["group", "part"]).select("*", every_salt).select("group", dealt(F.col("salt")), F.lit(False).alias("query"), "doc_id", "core")
    coming = good.join(crowd, ["group", "part"]).select("group", dealt(own_salt), F.lit(True).alias("query"), "doc_id", F.lit(None).cast("boolean").alias("core"))
    rows = opening.unionByName(coming).join(packed, "doc_id").select("group", "part", "query", "doc_id", "core", "z")
    opened = rows.repartition(parts_of, "group", "part").sortWithinPartitions("group", "part", "query").mapInArrow(tidied(_opened(k, percent)), "a long, b long")
    known = led.where("core and doc_id != leader").select(F.col("doc_id").alias("a"), F.col("leader").alias("b"))
    return united.where("a is not null").select("a", "b").unionByName(opened).unionByName(known)
