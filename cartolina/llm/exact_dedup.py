"""Exact dedup over an extendible-hash index kept in shared files.

Each batch of texts is normalised, hashed and written once to shared storage: one entry for each
distinct text of the batch (bytes, count, largest id) and one small row for each document. A directory
over the leading bits of the hash starts with a single bucket and doubles while a bucket holds more
bytes than its capacity. Every bucket covers a range of keys; owner tasks read whole ranges in key
order, chain entries of one key and compare their bytes. Copies have been folded before the shuffle,
so a group that holds a third of all rows sends one entry a batch; what such groups come to is told to their rows by a broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolina.llm.common import shuffle_parts, staged, two_columns
from cartolina.llm.words import forget, tidied

#: Bytes of a bucket; doubled where the directory would need more than 2 ** MOST_BITS buckets (from 1 TB of entries on).
CAPACITY = 4 << 20
MOST_BITS = 18
#: Leading bits beyond the usual depth that a bucket over capacity can still be split by.
SPARE_BITS = 3
#: Bytes that one owner reads, about, where that makes more owners than there are shuffle partitions.
OWNED = 64 << 20
#: Groups with more than this share of all rows, at most as many as its inverse, are told to their rows by a broadcast.
HOT = 1 / 1024

_ENTRIES = "doc_id long, key long, sha binary, body binary, n long, max_id long"
_GROUPS = "sha binary, keep_id long, group_size long"


def _index_batch(ids: list, bodies: list) -> pa.RecordBatch:
    first: dict[bytes, int] = {}
    key, sha, body, n, top = [], [], [], [0] * len(ids), [None] * len(ids)
    for i, raw in enumerate(bodies):
        low = (raw or b"").lower()
        digest = hashlib.sha256(low).digest()
        at = first.setdefault(digest, i)
        key.append(xxhash.xxh3_64_intdigest(low) - (1 << 63))
        sha.append(digest)
        body.append(zstandard.compress(low, 1) if at == i else None)
        n[at] += 1
        if ids[i] is not None and (top[at] is None or ids[i] > top[at]):
            top[at] = ids[i]
    return pa.record_batch(
        [pa.array(ids, pa.int64()), pa.array(key, pa.int64()), pa.array(sha, pa.binary()), pa.array(body, pa.binary()), pa.array(n, pa.int64()), pa.array(top, pa.int64())],
        names=["doc_id", "key", "sha", "body", "n", "max_id"],
    )


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    for b in batches:
        yield _index_batch(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist())


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries in key order: those of one key form a chain, told apart by their bytes."""
    now, chain, out = None, [], []

    def batch(rows: list) -> pa.RecordBatch:
        return pa.record_batch([pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64())], names=["sha", "keep_id", "group_size"])

    for b in batches:
        for key, sha, body, n, top in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            if key != now:
                out += chain
                now, chain = key, []
                if len(out) >= 4096:
                    yield batch(out)
                    out = []
            body = zstandard.decompress(body)
            for link in chain:
                if link[0] == body:
                    link[3] += n
                    if top is not None and (link[2] is None or top > link[2]):
                        link[2] = top
                    break
            else:
                chain.append([body, sha, top, n])
    yield batch(out + chain)


def directory(sizes: dict[int, int], capacity: int, max_depth: int) -> list[int]:
    """The cells of the directory, each with its bucket's number; sizes: bytes by the key's max_depth leading bits.

    A bucket that is over capacity is split at its next bit; if its depth is the directory's own, the directory doubles.
    """
    depth, buckets = 0, [(0, 0)]  # a bucket: its leading bits, how many
    total = [0]
    for i in range(1 << max_depth):
        total.append(total[-1] + sizes.get(i, 0))
    held = lambda bits, k: total[(bits + 1) << (max_depth - k)] - total[bits << (max_depth - k)]
    done = []
    while buckets:
        bits, k = buckets.pop()
        if held(bits, k) > capacity and k < max_depth:
            depth = max(depth, k + 1)
            buckets += [(2 * bits + 1, k + 1), (2 * bits, k + 1)]
        else:
            done.append((bits, k))
    cells = []
    for number, (_, k) in enumerate(done):  # in the order of their ranges
        cells += [number] * (1 << (depth - k))
    return cells


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are identical once A-Z are lower-cased; a null text counts as empty, and all
    empty texts are equal. The largest id of a group stays; rows that repeat that very id with an equal text all count
    as kept, and group_size counts rows. A null id never stays, unless its group has no other. Columns of docs other than the two named are ignored.
    An empty table gives no rows.
    """
    spark = docs.sparkSession
    index = staged(two_columns(docs, id_col, text_col).mapInArrow(tidied(_entries), _ENTRIES), "exact-index")
    rows, total = index.agg(F.count("*"), F.sum(F.when(F.col("n") > 0, F.length("body") + 64))).first()
    while (total or 0) / capacity > 1 << MOST_BITS:
        capacity *= 2
    max_depth = max(4, ((total or 0) // capacity).bit_length() + SPARE_BITS)
    held = index.where("n > 0")
    cell = F.shiftrightunsigned(F.col("key").bitwiseXOR(F.lit(-(1 << 63))), 64 - max_depth)
    sizes = {r[0]: r[1] for r in held.groupBy(cell.alias("cell")).agg(F.sum(F.length("body") + 64)).collect()}  # at most 2 ** max_depth rows
    cells = directory(sizes, capacity, max_depth)
    buckets = cells[-1] + 1
    owners = min(buckets, max(shuffle_parts(spark), (total or 0) // OWNED))
    shift = max_depth - (len(cells).bit_length() - 1)
    ranges = spark.createDataFrame([(i, b * owners // buckets) for i, b in enumerate(cells)], "cell int, owner int")  # at most 2 ** max_depth rows
    owned = held.withColumn("cell", F.shiftright(cell, shift).cast("int")).join(F.broadcast(ranges), "cell")
    entries = owned.repartitionById(owners, F.col("owner")).select("key", "sha", "body", "n", "max_id").sortWithinPartitions("key")
    groups = staged(entries.mapInArrow(tidied(_chains), _GROUPS), "exact-groups", narrow=True, rows=rows)
    hot = groups.where(F.col("group_size") > HOT * rows)
    told = index.select("doc_id", "sha").join(F.broadcast(hot), "sha", "left")
    rest = told.where("group_size is null").select("doc_id", "sha").join(groups.where(F.col("group_size") <= HOT * rows), "sha")
    return told.where("group_size is not null").unionByName(rest).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )
