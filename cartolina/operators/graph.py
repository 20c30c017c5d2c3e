"""Graph operators over edges("from", "to") and nodes(id), with an optional group column (a repository)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed parameters of the community search and of hubs.
SWEEPS = 50
EPSILON = 1e-12
HUB_DEVIATIONS = 2.0
HUB_LEAST = 4


def known_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between two known nodes, self-loops left out."""
    a, b = nodes.select(F.col("id").alias("from")), nodes.select(F.col("id").alias("to"))
    return edges.where("`from` <> `to`").join(a.distinct(), "from", "left_semi").join(b.distinct(), "to", "left_semi").select("from", "to")


def adjacency(edges: DataFrame) -> DataFrame:
    """u, v, w: each undirected edge in both directions, parallel edges summed, self-loops left out.

    The sums are made on directed pairs first, so that the shuffle holds distinct pairs, not edges.
    """
    pairs = edges.where("`from` <> `to`").groupBy(F.least("from", "to").alias("u"), F.greatest("from", "to").alias("v")).agg(F.count("*").alias("w"))
    ends = F.inline(F.array(F.struct(F.col("u"), F.col("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
    return pairs.select(ends.alias("u", "v"), "w")


def coupling(*edge_sets: DataFrame) -> DataFrame:
    """All edges of all sets, parallel ones kept."""
    out = edge_sets[0].select("from", "to")
    for other in edge_sets[1:]:
        out = out.unionByName(other.select("from", "to"))
    return out


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id and degree: distinct neighbours, 0 for nodes without any."""
    around = adjacency(edges).groupBy(F.col("u").alias("id")).agg(F.count("*").alias("degree"))
    return nodes.select("id").distinct().join(around, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def hubs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, degree, hub: degree at least mean + 2 standard deviations over all nodes, and at least 4."""
    d = degrees(nodes, known_edges(edges, nodes))
    cut = d.agg(F.greatest(F.lit(float(HUB_LEAST)), F.avg("degree") + HUB_DEVIATIONS * F.stddev_pop("degree")).alias("cut"))
    return d.join(F.broadcast(cut)).select("id", "degree", (F.col("degree") >= F.col("cut")).alias("hub"))


def _modularity(names: list[str], u: np.ndarray, v: np.ndarray, w: np.ndarray) -> list[int]:
    """Each node's community after one level of greedy moves, made at once and in the order of names."""
    near: list[list[tuple[int, float]]] = [[] for _ in names]
    for a, b, weight in zip(u, v, w, strict=True):
        near[a].append((b, float(weight)))
    strength = np.array([sum(x for _, x in row) for row in near])
    twice = strength.sum()
    home = list(range(len(names)))
    if twice == 0:
        return home
    total = strength.copy()
    for _ in range(SWEEPS):
        still = True
        for i, row in enumerate(near):
            links: dict[int, float] = {}
            for j, weight in row:
                links[home[j]] = links.get(home[j], 0.0) + weight
            total[home[i]] -= strength[i]
            gain = lambda c: links.get(c, 0.0) - strength[i] * total[c] / twice  # noqa: B023, E731
            best, most = home[i], gain(home[i])
            for c in sorted(links):
                if gain(c) > most + EPSILON:
                    best, most = c, gain(c)
            total[best] += strength[i]
            still &= best == home[i]
            home[i] = best
        if still:
            break
    return home


def neighborhoods(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """repo, id, neighborhood: communities by one level of modularity, numbered by their first member in collation order.

    Moves depend on all moves before, so one repository is one task; repositories run in parallel. Input order is irrelevant.
    """
    known = nodes.select("repo", "id").distinct()
    pairs = edges.where("`from` <> `to`").select("repo", "from", "to")
    both = pairs.union(pairs.select("repo", "to", "from")).groupBy("repo", F.col("from").alias("u"), F.col("to").alias("v")).agg(F.count("*").alias("w")).toDF("_repo", "u", "v", "w")
    schema = "repo string, id string, community long"

    def search(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = sorted(left["id"], key=lambda s: s.encode("utf-16-be", "surrogatepass"))
        at = {n: i for i, n in enumerate(names)}
        right = right[right["u"].isin(at) & right["v"].isin(at)]
        home = _modularity(names, right["u"].map(at).to_numpy(int), right["v"].map(at).to_numpy(int), right["w"].to_numpy())
        return pd.DataFrame({"repo": [key[0]] * len(names), "id": names, "community": home})

    found = known.groupBy("repo").cogroup(both.groupBy("_repo")).applyInPandas(search, schema)
    return renumbered(found.where("id is not null"))


def renumbered(found: DataFrame) -> DataFrame:
    """Communities numbered from 0 by their least member in Unicode collation."""
    first = F.min(F.collate(F.col("id"), "UNICODE")).over(Window.partitionBy("repo", "community"))
    ranked = F.dense_rank().over(Window.partitionBy("repo").orderBy("_first")) - 1
    return found.withColumn("_first", first).select("repo", "id", ranked.cast("int").alias("neighborhood"))


def neighborhood_labels(assigned: DataFrame) -> DataFrame:
    """repo, neighborhood, label, from (repo, neighborhood, path): the folder all members share, else the commonest top folder."""
    folder = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    parts = assigned.withColumn("_dir", F.filter(F.split(folder, "/"), lambda p: p != "")).withColumn("_top", F.coalesce(F.get("_dir", F.lit(0)), F.lit(".")))
    tops = parts.groupBy("repo", "neighborhood", "_top").agg(F.count("*").alias("n"), F.min("_dir").alias("lo"), F.max("_dir").alias("hi"))
    # What the least and greatest folder share, all share.
    picked = tops.groupBy("repo", "neighborhood").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min(F.struct(-F.col("n"), F.col("_top"))).alias("best"))
    same = F.transform(F.arrays_zip(F.col("lo").alias("a"), F.col("hi").alias("b")), lambda p: p["a"].eqNullSafe(p["b"]))
    shared = F.slice("lo", 1, F.when(F.array_position(same, False) > 0, F.array_position(same, False) - 1).otherwise(F.size("lo")).cast("int"))
    top = F.col("best")["_top"]
    label = F.when(F.size(shared) > 0, F.array_join(shared, "/")).when(top != ".", top).otherwise(F.concat(F.lit("neighborhood "), F.col("neighborhood").cast("string")))
    return picked.select("repo", "neighborhood", label.alias("label"))


def reached(edges: DataFrame, anchors: DataFrame, hops: int = 2) -> DataFrame:
    """id and hops: nodes within so many steps of the anchors (id) over undirected edges, with no bound on their number."""
    both = edges.select(F.col("from").alias("a"), F.col("to").alias("b")).union(edges.select("to", "from")).distinct()
    seen = anchors.select("id", F.lit(0).alias("hops")).distinct()
    front = seen
    for hop in range(1, hops + 1):
        front = front.join(both, front.id == both.a).select(F.col("b").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("hops", F.lit(hop))
        seen = seen.unionByName(front)
    return seen


def walk(edges: DataFrame, anchor: str, hops: int = 2, most: int = 40) -> tuple[DataFrame, bool]:
    """Breadth-first discovery under a budget of nodes, in order: by the finder's rank, then by edges' seq. (id, hops, rank), and whether it was cut.

    edges: from, to, seq. The frontier never exceeds the budget, so only it is held on the driver.
    """
    spark = edges.sparkSession
    both = edges.select(F.col("from").alias("a"), F.col("to").alias("b"), "seq").union(edges.select("to", "from", "seq")).groupBy("a", "b").agg(F.min("seq").alias("seq"))
    seen, cut = [(anchor, 0, 0)], False
    for hop in range(1, hops + 1):
        front = spark.createDataFrame([(i, r) for i, h, r in seen if h == hop - 1], "a string, r int")
        old = spark.createDataFrame([(i,) for i, _, _ in seen], "b string")
        new = both.join(F.broadcast(front), "a").join(F.broadcast(old), "b", "left_anti").groupBy("b").agg(F.min(F.struct("r", "seq")).alias("at"))
        room = most - len(seen)
        met = new.orderBy("at", "b").limit(room + 1).collect()
        cut |= len(met) > room
        seen += [(r["b"], hop, len(seen) + i) for i, r in enumerate(met[:room])]
        if not met:
            break
    return spark.createDataFrame(seen, "id string, hops int, rank int"), cut


def ranked_suspects(found: DataFrame) -> DataFrame:
    """Score by distance: 1 / (1 + hops), three decimals."""
    return found.withColumn("score", F.round(1 / (1 + F.col("hops")), 3))
