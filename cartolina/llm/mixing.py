"""Mixing sources to target weights by a low-discrepancy schedule.

The j-th slot of the mix is the point frac((j + 1/2) * golden ratio), mapped through the cumulative weights to a source. A source's
slots are ranked, and its r-th slot takes the r-th block of equally many words from the source's shuffled stream of
documents. The stream runs through the source's documents in an order given by a hash and begins again at its end, so that a second
epoch repeats the first. The drawn slots alone decide how many blocks a source gives: the points leave it within a few blocks of its
target, and there are so many slots that a few blocks are a small part of it. Only sources whose target is below
RESOLVED blocks are too small for that; they get the slots after all others, for just their target.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolina.llm.common import WORD, buckets_for, running, staged

#: Fixed by the query's contract.
WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0

#: The mix has about so many slots; a block is as many words as that takes, one at least.
SLOTS = 1 << 20
#: Sources with a smaller target, in blocks, are not drawn.
RESOLVED = 1024
GOLDEN = (math.sqrt(5) - 1) / 2
CELLS = 4096


def targets(sizes: list[int], weights: list[float], share: float = SHARE, most: float = MOST) -> list[float]:
    """Words for each source: share of all by weight, at most `most` times its size, the excess shared again."""
    left, out, free = share * sum(sizes), [0.0] * len(sizes), [i for i, n in enumerate(sizes) if n > 0]
    while free:
        unit = left / sum(weights[i] for i in free)
        full = [i for i in free if weights[i] * unit > most * sizes[i]]
        for i in full or free:
            out[i] = most * sizes[i] if full else weights[i] * unit
            left -= out[i]
        free = [i for i in free if i not in set(full)] if full else []
    return out


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"))
    return out.withColumn("place", F.xxhash64("doc_id", F.lit(seed)))


class Mix:
    """The parts of a mix: sources (one row each), docs (their place in the source's stream), slots and pieces."""

    def __init__(
        self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, block: int | None = None, resolved: int = RESOLVED, seed: int = 17,
    ):
        """block: words a slot takes, by default as many as make SLOTS slots. One row a source is held on the driver; sources are few beside documents."""
        spark = docs.sparkSession
        sized = staged(_sized(docs, id_col, text_col, source_col, seed), "mix-sizes", narrow=True)
        held = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("docs")).collect()
        held.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
        sizes = [r["size"] for r in held]
        self.target = targets(sizes, [weights[i % len(weights)] for i in range(len(held))], share, most)
        words = [math.floor(t) for t in self.target]
        self.block = block or max(1, -(-sum(words) // SLOTS))
        self.slots, blocks = self._slots(spark, words, resolved)
        due = [min(math.floor(most * n), b * self.block) if b is not None else w for n, b, w in zip(sizes, blocks, words, strict=True)]
        rows = [(i, r["source"], sizes[i], self.target[i], due[i]) for i, r in enumerate(held)]
        self.sources = spark.createDataFrame(rows, "s int, source string, source_size long, target double, words long")
        known = sized.withColumnRenamed("source", "_source").join(self.sources, F.col("_source").eqNullSafe(F.col("source"))).drop("_source")
        n = buckets_for(sum(r["docs"] for r in held))
        bucket = F.shiftrightunsigned(F.col("place").bitwiseXOR(F.lit(-(1 << 63))), 64 - (n.bit_length() - 1))
        self.docs = running(known.withColumn("bucket", bucket), "s", "bucket", ["place", "doc_id", "size"], F.col("size"), "start")

    def _slots(self, spark: SparkSession, words: list[int], resolved: int) -> tuple[DataFrame, list[int | None]]:
        """slot, s, rank: the sources' slots in the order of the mix; and how many each source has drawn (None: too small to be drawn)."""
        small = [0 < w < resolved * self.block for w in words]
        total = sum(w for w, x in zip(words, small, strict=True) if not x)
        count = -(-total // self.block)
        cells, at = [], 0
        for s, w in enumerate(words):  # each source's interval, cut at the cells of a grid
            if w and not small[s]:
                lo, at = at, at + w
                for c in range(lo * CELLS // total, min(CELLS - 1, at * CELLS // total) + 1):
                    cells.append((c, s, lo / total, at / total if at < total else 2.0))
        grid = spark.createDataFrame(cells, "cell int, s int, lo double, hi double")
        points = spark.range(count).withColumnRenamed("id", "slot").withColumn("u", F.pmod((F.col("slot") + 0.5) * GOLDEN, F.lit(1.0)))
        cell = F.least(F.floor(F.col("u") * CELLS), F.lit(CELLS - 1)).cast("int")
        drawn = points.withColumn("cell", cell).join(grid, "cell").where("u >= lo and u < hi").select("slot", "s")
        width = max(1, -(-count // buckets_for(count)))
        ranked = running(drawn.withColumn("bucket", F.floor(F.col("slot") / width)), "s", "bucket", ["slot"], F.lit(1), "rank")
        have = {r["s"]: r["n"] for r in drawn.groupBy("s").agg(F.count("*").alias("n")).collect()}
        rest, at = [], count
        for s, w in enumerate(words):
            if small[s]:
                rest.append((s, at, -(-w // self.block)))
                at += rest[-1][2]
        ranks = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("rank")
        after = spark.createDataFrame(rest, "s int, first long, n long").select("s", "first", ranks)
        after = after.select((F.col("first") + F.col("rank")).alias("slot"), "s", "rank")
        return ranked.select("slot", "s", "rank").unionByName(after), [None if x else have.get(s, 0) for s, x in enumerate(small)]

    def pieces(self) -> DataFrame:
        """slot, doc_id, source, offset, words: what each slot takes of a document, in words from its start."""
        b = self.block
        epochs = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("words") - 1) / F.col("source_size")).cast("long")))
        told = self.docs.where("size > 0 and words > 0").select("*", epochs.alias("epoch"))
        told = told.withColumn("lo", F.col("epoch") * F.col("source_size") + F.col("start")).where("lo < words")
        told = told.withColumn("hi", F.least(F.col("lo") + F.col("size"), F.col("words")))
        told = told.withColumn("rank", F.explode(F.sequence(F.floor(F.col("lo") / b), F.floor((F.col("hi") - 1) / b))))
        first = F.greatest(F.col("lo"), F.col("rank") * b)
        cut = told.withColumn("offset", first - F.col("lo")).withColumn("taken", F.least(F.col("hi"), (F.col("rank") + 1) * b) - first)
        return cut.join(self.slots, ["s", "rank"])

    def documents(self) -> DataFrame:
        """Each document with the words that its slots take of it, repeats counted, its first slot (null: none) and how many slots."""
        keys = ["s", "bucket", "place", "start", "doc_id", "size", "source", "source_size", "target"]
        zero = F.lit(0).cast("long")
        none = self.docs.groupBy(*keys).agg(F.count("*").alias("rows"), zero.alias("taken"), F.lit(None).cast("long").alias("slot"), zero.alias("n"))
        some = self.pieces().select(*keys, zero.alias("rows"), "taken", "slot", F.lit(1).cast("long").alias("n"))
        sums = (F.sum("rows").alias("rows"), F.sum("taken").alias("taken"), F.min("slot").alias("first_slot"), F.sum("n").alias("n_slots"))
        summed = none.unionByName(some).groupBy(*keys).agg(*sums)
        again = F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))
        return summed.withColumn("_again", again).drop("_again", "rows", "s", "bucket", "place", "start")


def mix(docs: DataFrame, **options) -> Mix:
    """The mix of docs; see Mix.

    A null text has size 0; a null source is a source of its own, last in order. Documents of size 0 take no part and get
    taken 0. Repeated rows each have a place of their own. Sources whose documents are all empty have target 0, and an
    empty table gives an empty mix. A drawn source's words are its slots times the block, at most `most` times its size, and so
    within a few blocks of its target; a small source's are its target's. Ties in the shuffled order go to the smaller id, then size. Other columns are ignored.
    """
    return Mix(docs, **options)
