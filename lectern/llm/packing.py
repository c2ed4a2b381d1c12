"""Operator 5, packing: shortest-pack-first over the length histogram.

The plan is made from the histogram of lengths alone: lengths are placed longest first, each
copy into the open pack with the least room used, if it has room left; all packs of one fill
level take their copies together. The result is a table of patterns (runs of lengths) with
counts; its size depends on the capacity, not on the corpus, and it equals what placing one
document after the other gives. Documents meet their pattern by rank: the r-th piece of a length
goes to the slot whose rank range holds r. Ranks need no global sort; they are row numbers within
(length, bucket of the id) plus counted offsets, and the number of buckets follows the count.

Nothing is truncated: a document longer than the capacity fills whole packs of its own, and
its rest is packed like any other piece.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.common import persist_table, pick, table, tidied

CAPACITY = 2048
#: Documents in a bucket, about: what one task numbers of a length that all documents have.
BUCKET_ROWS = 50_000

RESULT = "pack_id bigint, slot int, doc_id bigint, piece int, start_word int, n_words int, pack_words int"

#: A pattern: how often each length is in the pack, in the order of placing.
Runs = tuple[tuple[int, int], ...]


def _more(runs: Runs, length: int, times: int) -> Runs:
    if runs and runs[-1][0] == length:
        return runs[:-1] + ((length, runs[-1][1] + times),)
    return runs + ((length, times),)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[Runs, int]]:
    """Patterns and how many packs have each, in the order of opening.

    Lengths go longest first, copy by copy. Of the open packs the shortest, i.e. the one with the
    fewest words so far, takes the copy; of equals the one opened first. If it has no room, none
    has, and a pack is opened.
    """
    levels: dict[int, list[tuple[int, int, Runs]]] = defaultdict(list)  # words used -> (first pack, packs, pattern)
    heap: list[int] = []
    opened = 0

    def put(used: int, entry: tuple[int, int, Runs]) -> None:
        if not levels[used]:
            heapq.heappush(heap, used)
        levels[used].append(entry)

    for length in sorted(histogram, reverse=True):
        todo = histogram[length]
        while todo:
            while heap and not levels[heap[0]]:
                heapq.heappop(heap)
            if not heap or heap[0] + length > capacity:
                fit = capacity // length  # a new pack stays the shortest until it is full
                for times, count in ((fit, todo // fit), (todo % fit, 1)):
                    if times and count:
                        put(length * times, (opened, count, ((length, times),)))
                        opened += count
                break
            used = heapq.heappop(heap)
            entries = sorted(levels.pop(used))
            while heap and not levels[heap[0]]:
                heapq.heappop(heap)
            packs = sum(count for _, count, _ in entries)
            times = min((capacity - used) // length, todo // packs, -(-(heap[0] - used) // length) if heap else todo)
            if times:  # the whole level, until it meets the next
                for first, count, runs in entries:
                    put(used + length * times, (first, count, _more(runs, length, times)))
                todo -= packs * times
                continue
            for first, count, runs in entries:
                taken = min(count, todo)
                if taken:
                    put(used + length, (first, taken, _more(runs, length, 1)))
                if taken < count:
                    put(used, (first + taken, count - taken, runs))
                todo -= taken
    return [(runs, count) for _, count, runs in sorted(e for entries in levels.values() for e in entries)]


def slots(patterns: list[tuple[Runs, int]], first_pack: int = 0) -> pd.DataFrame:
    """One row for each (pattern, length in it): the ranks of that length which it takes, and where they go."""
    taken: dict[int, int] = defaultdict(int)
    rows, base = [], first_pack
    for runs, count in patterns:
        at, total = 0, sum(length * times for length, times in runs)
        for length, times in runs:
            rows.append((length, taken[length], count * times, times, base, at, total))
            taken[length] += count * times
            at += times
        base += count
    out = pd.DataFrame(rows, columns=["n_words", "first_rank", "ranks", "times", "base", "slot", "pack_words"]).astype("int64")
    return out.sort_values(["n_words", "first_rank"], kind="stable", ignore_index=True)


def word_count(text):
    """Words as runs of characters that aren't ASCII white space; counted without building them."""
    return F.regexp_count(text, F.lit(r"[^ \t\n\r\f\x0B]+"))


def packed(docs: DataFrame, capacity: int = CAPACITY, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: its pack, its place in it, its document, and which words of that it holds.

    Null, empty and blank texts have no words and take no place; rows without id are left out.
    Rows that repeat an id are packed each for itself. Equal lengths take their places in the
    order of (bucket, doc_id). Whole-capacity pieces of long documents have packs of their own,
    numbered after the planned ones.
    """
    spark = docs.sparkSession
    n = word_count(F.col("text")).cast("int")
    long = pick(docs, doc_id=id_col, text=text_col).where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), n.alias("n"), F.xxhash64("text").alias("tie")).where("n > 0")
    lengths = persist_table(long, "lengths")
    buckets = max(16, -(-lengths.count() // BUCKET_ROWS))
    bucketed = lengths.withColumns({"bucket": F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"), "n_words": F.col("n") % capacity})
    rest = bucketed.where("n_words > 0")
    counts = rest.groupBy("n_words", "bucket").count()
    offsets = counts.select("n_words", "bucket", F.coalesce(F.sum("count").over(Window.partitionBy("n_words").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    histogram = rest.groupBy("n_words").count().toPandas()  # fewer rows than the capacity
    where = slots(plan(dict(zip(histogram["n_words"].tolist(), histogram["count"].tolist())), capacity))
    planned = int((where["base"] + where["ranks"] // where["times"]).max()) if len(where) else 0
    held = spark.sparkContext.broadcast(where)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = held.value
        key = table["n_words"].to_numpy() * (1 << 44) + table["first_rank"].to_numpy()
        for batch in batches:
            size = batch["n_words"].to_numpy(np.int64)
            rank = batch["rank"].to_numpy(np.int64)
            row = table.iloc[np.searchsorted(key, size * (1 << 44) + rank, "right") - 1]
            inside, times = rank - row["first_rank"].to_numpy(), row["times"].to_numpy()
            yield pd.DataFrame({
                "pack_id": row["base"].to_numpy() + inside // times, "slot": (row["slot"].to_numpy() + inside % times).astype(np.int32), "doc_id": batch["doc_id"].to_numpy(),
                "piece": (batch["n"].to_numpy() // capacity).astype(np.int32), "start_word": (batch["n"].to_numpy() - size).astype(np.int32), "n_words": size.astype(np.int32), "pack_words": row["pack_words"].to_numpy().astype(np.int32),
            })

    by = Window.partitionBy("n_words", "bucket").orderBy("doc_id", "n", "tie")
    ranked = rest.withColumn("rn", F.row_number().over(by)).join(offsets, ["n_words", "bucket"])
    small = ranked.select("doc_id", "n", "n_words", (F.col("rn") - 1 + F.col("offset")).alias("rank")).mapInPandas(lambda batches: tidied(place(batches)), RESULT)
    # whole-capacity pieces: numbered by the same counted offsets; sums by bucket are few rows
    full = bucketed.where(F.col("n") >= capacity).withColumn("k", F.floor(F.col("n") / capacity).cast("long"))
    preceding = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = full.groupBy("bucket").agg(F.sum("k").alias("k")).select("bucket", (F.coalesce(F.sum("k").over(preceding), F.lit(0)) + planned).alias("base"))
    before = F.coalesce(F.sum("k").over(Window.partitionBy("bucket").orderBy("doc_id", "n", "tie").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    big = full.withColumn("before", before).join(first, "bucket").select("doc_id", (F.col("base") + F.col("before")).alias("first"), F.posexplode(F.sequence(F.lit(0), (F.col("k") - 1).cast("int"))).alias("piece", "p"))
    big = big.select((F.col("first") + F.col("piece")).alias("pack_id"), F.lit(0).alias("slot"), "doc_id", "piece", (F.col("piece") * capacity).cast("int").alias("start_word"), F.lit(capacity).alias("n_words"), F.lit(capacity).alias("pack_words"))
    return small.unionByName(big)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
