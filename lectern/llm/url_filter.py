"""Operator 3, URL filters: a cascade of Bloom filters with exact answers.

Level 1 encodes the listed keys. Unlisted keys of the corpus that pass it, its false positives,
are encoded by level 2; listed keys that pass level 2 by mistake by level 3; and so on until a
level has no false positives. Because the cascade is built against the complete universe of
keys in the corpus, membership is exact for every key of it, and no join is needed.

Keys are split by hash into shards of bounded size, each with a cascade of its own, built in
parallel and written to shared storage. Lookups are spread by (shard, salt), so a task needs the
filters of few shards, and a hot URL is spread over many tasks. Executors fetch the filter files
as they fetch any file of the application, and a worker holds ``HELD`` shards at a time. Nothing
is joined, broadcast or sent to the driver, at any size.

There are at most ``MAX_LEVELS`` levels, which halve each time; keys whose 128-bit hashes are
equal can't be told apart by any number, and are an error if only one of them is listed.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import mix64, persist_table, pick, table

SHARD_KEYS = 500_000
MAX_LEVELS = 64
#: Shards of which a worker holds the filters, about a megabyte each.
HELD = 16
#: Tasks over which the lookups of one shard may be spread.
SALTS = 64

CASCADE = "shard int, level int, hashes int, bits binary"


def canonical(url: Column) -> Column:
    """The key of a URL: host and path in lower case, without scheme, www. or m., fragment, query and closing slash."""
    bare = F.regexp_replace(F.lower(F.trim(url)), r"^[a-z]+://", "")
    bare = F.regexp_replace(bare, r"[?#].*$", "")
    return F.regexp_replace(F.regexp_replace(bare, r"^(www|m)\.", ""), r"/+$", "")


# ---- filters ------------------------------------------------------------------------------


def _slots(h1: np.ndarray, h2: np.ndarray, level: int, hashes: int, size: int) -> np.ndarray:
    """(hashes, keys) bit positions by double hashing, salted by the level."""
    salt = np.uint64(0x9E3779B97F4A7C15 * (level + 1) & (2**64 - 1))
    a, b = mix64(h1 ^ salt), mix64(h2 + salt) | np.uint64(1)
    with np.errstate(over="ignore"):
        return np.stack([(a + np.uint64(i) * b) % np.uint64(size) for i in range(hashes)])


def _passes(bits: np.ndarray, hashes: int, level: int, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    ok = np.ones(len(h1), bool)
    for row in _slots(h1, h2, level, hashes, len(bits) * 8):
        ok &= (bits[(row >> np.uint64(3)).astype(np.int64)] >> (row & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return ok


def build(h1: np.ndarray, h2: np.ndarray, listed: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Levels (hash count, bits) for keys of which some are listed; no level if none is.

    The first level lets through about sqrt(1/2) times the listed keys' number of the others,
    each further one half of what remains.
    """
    inside, outside = np.flatnonzero(listed), np.flatnonzero(~listed)
    levels: list[tuple[int, np.ndarray]] = []
    while len(inside) and len(levels) < MAX_LEVELS:
        rate = 0.5 if levels else min(0.5, max(1e-9, len(inside) * math.sqrt(0.5) / max(len(outside), 1)))
        hashes = max(1, round(-math.log2(rate)))
        size = max(8, math.ceil(len(inside) * hashes / math.log(2) / 8) * 8)
        bits = np.zeros(size // 8, np.uint8)
        at = _slots(h1[inside], h2[inside], len(levels), hashes, size).ravel()
        np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.left_shift(1, (at & np.uint64(7)).astype(np.uint8)).astype(np.uint8))
        passed = outside[_passes(bits, hashes, len(levels), h1[outside], h2[outside])]
        levels.append((hashes, bits))
        inside, outside = passed, inside
    if len(inside):
        raise ValueError("keys with equal 128-bit hashes are both listed and not listed")
    return levels


def member(levels: list[tuple[int, np.ndarray]], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Exact for keys of the universe: listed if the first level that a key fails is an even one (from 1)."""
    answer, open_ = np.full(len(h1), len(levels) % 2 == 1), np.arange(len(h1))
    for k, (hashes, bits) in enumerate(levels):
        ok = _passes(bits, hashes, k, h1[open_], h2[open_])
        answer[open_[~ok]] = k % 2 == 1
        open_ = open_[ok]
    return answer


# ---- over the cluster ---------------------------------------------------------------------


def _u64(s: pd.Series) -> np.ndarray:
    return s.to_numpy(np.int64).view(np.uint64)


def hashed(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2")]


def cascade(universe: DataFrame, listed: DataFrame, key: str = "key", shard_keys: int = SHARD_KEYS) -> DataFrame:
    """Filters (shard, level, hashes, bits) of the listed keys against the universe's keys. Null keys are ignored."""
    marks = universe.select(F.col(key).alias("k"), F.lit(0).alias("on")).unionByName(listed.select(F.col(key).alias("k"), F.lit(1).alias("on"))).where("k is not null").groupBy("k").agg(F.max("on").alias("on"))
    marks = persist_table(marks.select(*hashed(F.col("k")), "on"), "keys")
    shards = max(1, -(-marks.count() // shard_keys))

    def make(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        levels = build(_u64(pdf["h1"]), _u64(pdf["h2"]), pdf["on"].to_numpy() == 1)
        return pd.DataFrame([(keys[0], k, hashes, bits.tobytes()) for k, (hashes, bits) in enumerate(levels)], columns=["shard", "level", "hashes", "bits"])

    made = marks.groupBy(F.pmod(F.col("h1"), F.lit(shards)).cast("int").alias("shard")).applyInPandas(make, CASCADE)
    return persist_table(made, "cascade").withColumn("shards", F.lit(shards))


class _Filters:
    """The filter files as an executor sees them: an index of shards, and the last few that were asked for."""

    def __init__(self, names: list[str]):
        from pyarrow import parquet
        from pyspark import SparkFiles

        self.read = parquet.read_table
        self.where = {int(s): path for path in map(SparkFiles.get, names) for s in set(parquet.read_table(path, columns=["shard"])["shard"].to_pylist())}
        self.get = lru_cache(HELD)(self._load)

    def _load(self, shard: int) -> list[tuple[int, np.ndarray]]:
        if shard not in self.where:
            return []
        rows = self.read(self.where[shard], filters=[("shard", "==", shard)]).to_pylist()
        return [(r["hashes"], np.frombuffer(r["bits"], np.uint8)) for r in sorted(rows, key=lambda r: r["level"])]


_opened: dict[tuple[str, ...], _Filters] = {}


def lookup(rows: DataFrame, filters: DataFrame, key: str = "key") -> DataFrame:
    """``rows`` with a column ``listed``: exact for keys of the filters' universe, false for null keys."""
    spark = rows.sparkSession
    shards = filters.select(F.max("shards")).first()[0]
    if shards is None:
        return rows.withColumn("listed", F.lit(False))
    files = filters.inputFiles()
    for path in files:
        spark.sparkContext.addFile(path)
    names = tuple(path.rsplit("/", 1)[-1] for path in files)

    @F.pandas_udf("boolean")
    def test(a: pd.Series, b: pd.Series) -> pd.Series:
        if names not in _opened:
            _opened.clear()
            _opened[names] = _Filters(list(names))
        x, y = _u64(a), _u64(b)
        out, shard = np.zeros(len(x), bool), x.view(np.int64) % shards
        for s in np.unique(shard):
            mine = np.flatnonzero(shard == s)
            out[mine] = member(_opened[names].get(int(s)), x[mine], y[mine])
        return pd.Series(out)

    h1, h2 = hashed(F.col(key))
    shard, salt = F.pmod(h1, F.lit(shards)), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))
    spread = rows.withColumns({"__shard": shard, "__salt": salt}).repartition("__shard", "__salt").sortWithinPartitions("__shard").drop("__shard", "__salt")
    return spread.withColumn("listed", F.col(key).isNotNull() & test(h1, h2))


def flagged(pages: DataFrame, listed: DataFrame, *, id_col: str = "page_id", url_col: str = "url", list_col: str = "url") -> DataFrame:
    """(page_id, url, key, listed): whether a page's key is among the keys of the listed URLs.

    The universe is the keys of all pages and all listed URLs. A null URL has no key and isn't
    listed; an empty one is a key like any other. Repeated rows and null ids pass through.
    """
    rows = pick(pages, page_id=id_col, url=url_col).withColumn("key", canonical(F.col("url")))
    keys = pick(listed, url=list_col).select(canonical(F.col("url")).alias("key"))
    return lookup(rows, cascade(rows.select("key"), keys))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages on the list of URLs under which some page carries spam marks."""
    pages = table(spark, sf_dir, "pages")
    return flagged(pages, pages.where(F.col("html").contains("$$$")))
