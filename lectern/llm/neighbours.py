"""Operator 6, approximate nearest neighbours by adaptive dimension scan.

Vectors are rotated by a random orthogonal matrix, so any block of columns is a fair sample of
a distance. Every vector is indexed: it goes to the nearest of about sqrt(n) centroids, which
k-means finds on a bounded sample. Queries are the vectors whose id is divisible by ``EVERY``. A
query first searches the lists of its nearest centroids, until they hold ``HOME`` vectors, which
gives an upper bound of its k-th distance; then it probes further lists. There, distances are
accumulated by blocks of columns, and after each block a hypothesis test abandons candidates: if
the partial distance, scaled to all columns, exceeds the bound by more than the error that the
block's size allows, the candidate can't be a neighbour, at the chosen significance. The bound
tightens from list to list.

How many lists to probe depends on how clustered the vectors are, so it is measured: a sample
of queries is compared with all vectors, and the number that finds ``TARGET`` of their true
neighbours is taken.

Neighbouring lists lie side by side and are cut into shards of about ``SHARD`` vectors (a long
list spans several). A query travels once to each shard that it probes; a shard that many
queries ask for is searched in cells of ``CELL`` queries, each a group of its own. So no group
outgrows an executor, and no list is cut off.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.common import persist_table, pick, table

K = 10
EVERY = 50
TARGET = 0.95
#: Queries that are compared with all vectors to measure how many lists to probe.
SAMPLE = 256
#: Vectors that k-means learns from, for each list; and the most lists, a bound of what is broadcast.
TRAIN_PER_LIST, MOST_LISTS = 64, 1 << 16
ROUNDS = 4
COLUMN_BLOCK = 16
EPSILON = 2.1
SHARD, CELL, HOME = 8192, 2048, 256

FOUND = "vec_id bigint, neighbour_id bigint, distance double"


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


def scan(queries: np.ndarray, bounds: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, member, squared distance) of the pairs that survive every test and end within the bound."""
    dim = members.shape[1]
    first = min(COLUMN_BLOCK, dim)
    limit = np.sqrt(bounds)

    def cap(d: int) -> np.ndarray:  # of the squared partial distance after d of dim columns
        return (limit * (1 + EPSILON / math.sqrt(d)) * math.sqrt(d / dim)) ** 2 + 1e-12 if d < dim else bounds + 1e-12

    near = _squared(queries[:, :first].astype(np.float32), members[:, :first].astype(np.float32))
    i, j = np.nonzero(near <= (cap(first) * (1 + 1e-4) + 1e-5).astype(np.float32)[:, None])
    part = ((queries[i, :first] - members[j, :first]) ** 2).sum(1)
    at = first
    while at < dim:
        to = min(at + COLUMN_BLOCK, dim)
        part = part + ((queries[i, at:to] - members[j, at:to]) ** 2).sum(1)
        ok = part <= cap(to)[i]
        i, j, part, at = i[ok], j[ok], part[ok], to
    return i, j, part


def nearest(i: np.ndarray, ids: np.ndarray, d: np.ndarray, k: int) -> np.ndarray:
    """Which (query, neighbour, distance) entries are the k nearest of their query; a neighbour counts once, ties go by id."""
    order = np.lexsort((d, ids, i))
    once = np.append(True, (np.diff(i[order]) != 0) | (np.diff(ids[order]) != 0)) if len(order) else np.zeros(0, bool)
    order = order[once]
    order = order[np.lexsort((ids[order], d[order], i[order]))]
    return order[np.arange(len(order)) - np.searchsorted(i[order], i[order]) < k]


def probe(names: np.ndarray, queries: np.ndarray, bounds: np.ndarray, lists: list[np.ndarray], ids: np.ndarray, members: np.ndarray, member_lists: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, distance): the k nearest members in the lists that each query asks for, within its bound, which tightens."""
    order = np.argsort(member_lists, kind="stable")
    ids, members, member_lists = ids[order], members[order], member_lists[order]
    asking = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    wanted = np.concatenate(lists) if len(lists) else np.zeros(0, np.int64)
    by_list = np.argsort(wanted, kind="stable")
    asking, wanted = asking[by_list], wanted[by_list]
    best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    bounds = bounds.copy()
    cuts = np.flatnonzero(np.append(True, np.diff(member_lists) != 0)) if len(member_lists) else np.zeros(0, np.int64)
    for a, b in zip(cuts, np.append(cuts[1:], len(ids))):
        x, y = np.searchsorted(wanted, [member_lists[a], member_lists[a] + 1])
        for start in range(x, y, 256):
            who = asking[start : min(start + 256, y)]
            for at in range(a, b, 4096):
                to = min(at + 4096, b)
                i, j, d = scan(queries[who], bounds[who], members[at:to])
                other = names[who[i]] != ids[at + j]
                i, j, d = who[i[other]], ids[at + j[other]], d[other].round(7)
                if len(i):
                    best = tuple(np.concatenate(c) for c in zip(best, (i, j, d)))
        if len(best[0]):
            keep = nearest(*best, k)
            best = tuple(c[keep] for c in best)
            full = np.flatnonzero(np.bincount(best[0], minlength=len(bounds)) == k)
            worst = np.zeros(len(bounds))
            np.maximum.at(worst, best[0], best[2])
            bounds[full] = np.minimum(bounds[full], worst[full])
    return best


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Distinct (id, vector) rows whose vector isn't empty and has finite numbers only."""
    slim = pick(vectors, vec_id=id_col, v=vector_col).where("vec_id is not null and v is not null").select(F.col("vec_id").cast("long"), F.col("v").cast("array<double>").alias("v"))
    slim = slim.where(F.size("v") > 0).where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    return slim.distinct()


def centroids(points: DataFrame, n: int, rounds: int = ROUNDS) -> np.ndarray:
    """k-means over a sample of at most TRAIN_PER_LIST points a list, those whose ids hash lowest."""
    lists = min(max(1, round(math.sqrt(n))), MOST_LISTS)
    take = min(1.0, 2.0 * TRAIN_PER_LIST * lists / n)
    near = points.where(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1 << 20)) <= int(take * (1 << 20)))
    x = np.stack(near.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(TRAIN_PER_LIST * lists).toPandas()["v"].to_numpy()).astype(np.float32)
    centres = x[:lists].copy()
    for _ in range(rounds):
        at = np.concatenate([_squared(x[s : s + 4096], centres).argmin(axis=1) for s in range(0, len(x), 4096)])
        order = np.argsort(at, kind="stable")
        has, begin = np.unique(at[order], return_index=True)
        centres[has] = np.add.reduceat(x[order].astype(np.float64), begin) / np.diff(np.append(begin, len(x)))[:, None]
    return centres.astype(np.float64)


def probes_needed(points: DataFrame, centres: np.ndarray, k: int, target: float, every: int, sample: int = SAMPLE) -> int:
    """The number of lists which, nearest centroid first, hold ``target`` of a sample's true neighbours."""
    asked = points.where(F.pmod("vec_id", F.lit(every)) == 0).orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(sample).toPandas()
    if not len(asked):
        return 1
    q, ids = np.stack(asked["v"].to_numpy()).astype(float), asked["vec_id"].to_numpy()

    def best(batches):
        for batch in batches:
            x, other = np.stack(batch["v"].to_numpy()).astype(float), batch["vec_id"].to_numpy()
            d = _squared(q, x)
            d[ids[:, None] == other[None, :]] = np.inf
            top = np.argpartition(d, min(k, d.shape[1]) - 1, axis=1)[:, :k]
            near = _squared(x, centres).argmin(axis=1)
            yield pd.DataFrame({"q": np.repeat(np.arange(len(q)), top.shape[1]), "d": np.take_along_axis(d, top, 1).ravel(), "list": near[top].ravel()})

    by = Window.partitionBy("q").orderBy("d", "list")
    top = points.mapInPandas(best, "q int, d double, list int").withColumn("rn", F.row_number().over(by)).where(F.col("rn") <= k).toPandas()
    place = np.argsort(np.argsort(_squared(q, centres), axis=1, kind="stable"), axis=1, kind="stable")
    ranks = np.sort(place[top["q"], top["list"]])
    return int(ranks[min(len(ranks) - 1, math.ceil(target * len(ranks)))]) + 1


def neighbours(vectors: DataFrame, k: int = K, target: float = TARGET, every: int = EVERY, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, rank, neighbour_id, distance): the k nearest others, by squared Euclidean distance, of each vector whose id is divisible by ``every``.

    Approximate: ``target`` is the share of true neighbours in the lists that are probed. Equal
    distances are ranked by neighbour id. Null, empty and non-finite vectors are neither queries
    nor neighbours. Vectors of another dimension are never neighbours; each dimension has an
    index of its own. An id with several different vectors is as near as the nearest of them.
    Fewer than k rows come back for a query only if the probed lists hold no more.
    """
    spark = vectors.sparkSession
    base = persist_table(usable(vectors, id_col, vector_col), "usable")
    found = [_one_dimension(base.where(F.size("v") == row["d"]), row["d"], k, target, every) for row in base.select(F.size("v").alias("d")).distinct().collect()]
    found = [f for f in found if f is not None]
    if not found:
        return spark.createDataFrame([], "vec_id bigint, rank int, neighbour_id bigint, distance double")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    by = Window.partitionBy("vec_id").orderBy("distance", "neighbour_id")
    ranked = out.groupBy("vec_id", "neighbour_id").agg(F.min("distance").alias("distance")).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return ranked.select("vec_id", "rank", "neighbour_id", F.round("distance", 6).alias("distance"))


def _one_dimension(base: DataFrame, dim: int, k: int, target: float, every: int) -> DataFrame | None:
    spark = base.sparkSession
    turn = rotation(dim)

    def rotate(batches):
        for batch in batches:
            yield pd.DataFrame({"vec_id": batch["vec_id"], "v": list(np.stack(batch["v"].to_numpy()) @ turn)})

    points = persist_table(base.mapInPandas(rotate, "vec_id bigint, v array<double>"), "points")
    n = points.count()
    if n < 2:
        return None
    centres = centroids(points, n)
    # lists in the order of the centroids' main axis, so neighbours share shards
    middle = centres - centres.mean(0)
    centres = centres[np.argsort(np.linalg.eigh(middle.T @ middle)[1][:, -1] @ middle.T, kind="stable")]
    held = spark.sparkContext.broadcast(centres)
    probes = min(probes_needed(points, centres, k, target, every), len(centres))

    def assign(batches):
        for batch in batches:
            x = np.stack(batch["v"].to_numpy())
            near = np.concatenate([_squared(x[s : s + 4096].astype(float), held.value).argmin(axis=1) for s in range(0, len(x), 4096)])
            yield pd.DataFrame({"vec_id": batch["vec_id"], "v": batch["v"], "list": near.astype(np.int32)})

    salted = points.mapInPandas(assign, "vec_id bigint, v array<double>, list int").withColumn("salt", F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 20)))
    placed = persist_table(salted, "placed")
    sizes = np.zeros(len(centres), np.int64)
    for row in placed.groupBy("list").count().collect():  # one row a list
        sizes[row["list"]] = row["count"]
    begin = np.cumsum(sizes) - sizes
    low, high = begin // SHARD, np.maximum(begin + sizes - 1, begin) // SHARD
    bounds = spark.sparkContext.broadcast((begin, sizes, low, high))
    queries = placed.where(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", "v", F.xxhash64("vec_id", "v").alias("q"))

    def route(home: bool):
        def run(batches):
            _, sizes, low, high = bounds.value
            for batch in batches:
                if not len(batch):
                    continue
                near = np.argsort(_squared(np.stack(batch["v"].to_numpy()).astype(float), held.value), axis=1, kind="stable")
                rows = []
                for i, order in enumerate(near):
                    order = order[sizes[order] > 0]
                    first = int(np.searchsorted(np.cumsum(sizes[order]), HOME)) + 1
                    where: dict[int, list[int]] = {}
                    for at in order[:first].tolist() if home else order[first : max(probes, first)].tolist():
                        for shard in range(low[at], high[at] + 1):
                            where.setdefault(shard, []).append(at)
                    rows += [(shard, i, lists) for shard, lists in where.items()]
                take = np.array([r[1] for r in rows], np.int64)
                yield pd.DataFrame({"shard": np.array([r[0] for r in rows], np.int64), "q": batch["q"].to_numpy()[take], "vec_id": batch["vec_id"].to_numpy()[take], "bound": batch["bound"].to_numpy(float)[take], "v": batch["v"].to_numpy()[take], "lists": pd.Series([np.array(r[2], np.int32) for r in rows], dtype=object)})

        return run

    def members(cells: np.ndarray):
        def run(batches):
            for batch in batches:
                begin, sizes, _, _ = bounds.value
                at = batch["list"].to_numpy()
                shard = (begin[at] + (batch["salt"].to_numpy() * sizes[at] >> 20)) // SHARD
                times = cells[shard]
                each = np.repeat(np.arange(len(batch)), times)
                cell = np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times)
                yield pd.DataFrame({"shard": shard[each], "cell": cell, "vec_id": batch["vec_id"].to_numpy()[each], "list": at[each], "v": batch["v"].to_numpy()[each]})

        return run

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"q": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "neighbour_id": np.zeros(0, np.int64), "distance": np.zeros(0)})
        names = left["vec_id"].to_numpy()
        i, j, d = probe(names, np.stack(left["v"].to_numpy()).astype(float), left["bound"].to_numpy(float), left["lists"].tolist(), right["vec_id"].to_numpy(), np.stack(right["v"].to_numpy()).astype(float), right["list"].to_numpy(), k)
        return pd.DataFrame({"q": left["q"].to_numpy()[i], "vec_id": names[i], "neighbour_id": j, "distance": d})

    def searched(asked: DataFrame, home: bool) -> DataFrame:
        sent = persist_table(asked.mapInPandas(route(home), "shard bigint, q bigint, vec_id bigint, bound double, v array<double>, lists array<int>"), "sent")
        cells = np.zeros(n // SHARD + 1, np.int64)  # a number for every 8192 vectors
        for row in sent.groupBy("shard").count().collect():
            cells[row["shard"]] = -(-row["count"] // CELL)
        share = spark.createDataFrame(pd.DataFrame({"shard": np.flatnonzero(cells), "cells": cells[cells > 0]}), "shard bigint, cells bigint")
        by_cell = sent.join(F.broadcast(share), "shard").withColumn("cell", F.pmod(F.xxhash64("q"), F.col("cells"))).drop("cells")
        theirs = placed.select("vec_id", "list", "salt", "v").mapInPandas(members(cells), "shard bigint, cell bigint, vec_id bigint, list int, v array<double>")
        return by_cell.groupBy("shard", "cell").cogroup(theirs.groupBy("shard", "cell")).applyInPandas(search, "q bigint, " + FOUND)

    own = persist_table(searched(queries.withColumn("bound", F.lit(float("inf"))), True), "own")
    kth = Window.partitionBy("q").orderBy("distance", "neighbour_id")
    top = own.groupBy("q", "neighbour_id").agg(F.min("distance").alias("distance")).withColumn("rn", F.row_number().over(kth)).where(F.col("rn") == k)
    bounded = queries.join(top.select("q", F.col("distance").alias("bound")), "q", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    return own.unionByName(searched(bounded, False)).drop("q")


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"))
