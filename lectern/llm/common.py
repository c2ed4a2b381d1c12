"""What the training-data operators share: column picking, word hashing; written tables are ``lectern.shared``'s."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.shared import discard, persist_table, release, shared_dir, tidied  # noqa: F401

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Project ``alias=source`` columns and nothing else.

    Works by position, so further columns whose names clash with ours, or with each other
    in another case, are never resolved by name. Of two columns of the very same name the
    first is meant.
    """
    names = df.columns
    flat = df.toDF(*[f"__c{i}" for i in range(len(names))])
    return flat.select(*[F.col(f"__c{names.index(source)}").alias(alias) for alias, source in columns.items()])


def like(df: DataFrame, source: DataFrame) -> DataFrame:
    """Give the flat columns ``__c0..`` of ``df`` the names that ``source`` has."""
    return df.select(*[f"__c{i}" for i in range(len(source.columns))]).toDF(*source.columns)


def flatten(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """All columns under positional names, and the positional name of each real one."""
    flat = df.toDF(*[f"__c{i}" for i in range(len(df.columns))])
    where: dict[str, str] = {}
    for i, name in enumerate(df.columns):
        where.setdefault(name, f"__c{i}")
    return flat, where


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over an unsigned array."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(30))
        x = x * U64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> U64(27))
        x = x * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def word_hashes(words: list[str]) -> np.ndarray:
    """A stable 64-bit hash of each word."""
    if not words:
        return np.zeros(0, U64)
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False)


class Windows:
    """Polynomial hashes of all windows of a token stream, each in constant time."""

    BASE = U64(0x9E3779B97F4A7C15)
    INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
    _powers: dict[str, np.ndarray] = {}

    @classmethod
    def powers(cls, kind: str, n: int) -> np.ndarray:
        have = cls._powers.get(kind)
        if have is None or len(have) < n:
            steps = np.full(max(n, 1 << 16), cls.BASE if kind == "up" else cls.INVERSE, U64)
            steps[0] = 1
            have = cls._powers[kind] = np.cumprod(steps, dtype=U64)
        return have

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        with np.errstate(over="ignore"):
            self.sums = np.zeros(n + 1, U64)
            np.cumsum(hashes * self.powers("up", n)[:n], dtype=U64, out=self.sums[1:])

    def at(self, starts: np.ndarray, width: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            raw = (self.sums[starts + width] - self.sums[starts]) * self.powers("down", len(self.sums))[starts]
        return mix64(raw)


def runs(mask_starts: np.ndarray, mask_ends: np.ndarray) -> list[tuple[int, int]]:
    """Union of half-open intervals, sorted and merged (touching intervals join)."""
    if not len(mask_starts):
        return []
    order = np.argsort(mask_starts, kind="stable")
    starts, ends = mask_starts[order], np.maximum.accumulate(mask_ends[order])
    first = np.ones(len(starts), bool)
    first[1:] = starts[1:] > ends[:-1]
    where = np.flatnonzero(first)
    return list(zip(starts[where].tolist(), ends[np.append(where[1:] - 1, len(starts) - 1)].tolist()))
