"""Vector search: exact top-k for one query, and for every stored vector at once."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors in one block of the blocked join, at most; few vectors are cut into blocks of SMALL, for some tasks.
BLOCK, SMALL = 1 << 16, 1 << 12
#: A tile of the comparison, and pairs whose distances are computed at once.
_ROWS, _COLUMNS, _HELD = 256, 4096, 1 << 16


def squared_l2(a: Column, b: Column) -> Column:
    return F.round(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x), 6)


def cosine(a: Column, b: Column) -> Column:
    """0 as soon as one vector has no length."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(F.round(dot(a, b) / norm, 6))


def nearest(vectors: DataFrame, query: list[float], n: int, max_distance: float | None = None, excluded: list[int] = ()) -> DataFrame:
    """(vec_id, doc_id, chunk_index, distance): the n nearest first, distance and exclusion filters after that.

    So fewer than n may come back. The rank is kept as a column, which also keeps the filters
    from being moved below the limit.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    top = vectors.select("vec_id", "doc_id", "chunk_index", squared_l2(F.col("v"), q).alias("distance")).orderBy("distance", "vec_id").limit(n)
    if max_distance is not None:
        top = top.where(F.col("distance") <= max_distance)
    return top.where(~F.col("doc_id").isin(*excluded)) if excluded else top


def nearest_of_all(vectors: DataFrame, k: int, block: int | None = None) -> DataFrame:
    """(vec_id, neighbour, distance, rank) of the k nearest of every vector, itself included; exact.

    Each pair of blocks is compared by one task and hands on k candidates a row only; no pair of
    vectors is ever a row of a shuffle. Work grows with the square of the vectors, the memory of a
    task doesn't. A matrix product finds the pairs that may be among the k, with a margin for its
    rounding; only their distances are computed in full.
    """
    told = vectors.agg(F.count("*").alias("n"), F.bool_and(F.col("v") == F.col("v").cast("array<float>").cast("array<double>")).alias("narrow")).first()
    blocks = max(1, math.ceil(told["n"] / block)) if block else max(min(6, math.ceil(told["n"] / SMALL)), math.ceil(told["n"] / BLOCK))
    sent = F.col("v").cast("array<float>") if told["narrow"] else F.col("v")
    placed = vectors.select("vec_id", sent.alias("v"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("b"))
    other, own = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"), F.col("b")
    # rows of block b meet each block as "other"; the partition is the cell, however small its rows are
    pairs = placed.select("vec_id", "v", "b", other).select("vec_id", "v", F.explode(F.array(F.struct((own * blocks + F.col("other")).alias("cell"), F.lit(True).alias("asks")), F.struct((F.col("other") * blocks + own).alias("cell"), F.lit(False).alias("asks")))).alias("c"))
    sent = pairs.select("vec_id", "v", "c.cell", "c.asks").repartitionById(blocks * blocks, F.col("cell").cast("int"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        got = pa.Table.from_batches(parts).combine_chunks()
        asks, ids, v = got["asks"].to_numpy(), got["vec_id"].to_numpy(), got["v"].combine_chunks()
        x = v.flatten().to_numpy().reshape(len(v), -1)
        if v.null_count or len(pc.unique(pc.list_value_length(v))) > 1:
            raise ValueError("vectors differ in length")
        order = np.flatnonzero(~asks)[np.argsort(ids[~asks], kind="stable")]
        rows, at, distance = _nearest_rows(x[asks], x[order], k)
        found = pa.table({"vec_id": ids[asks][rows], "neighbour": ids[order][at], "distance": distance})
        yield from found.to_batches(max_chunksize=1 << 16)

    met = sent.select("vec_id", "v", "asks").mapInArrow(compare, "vec_id bigint, neighbour bigint, distance double")
    by = Window.partitionBy("vec_id").orderBy("distance", "neighbour")
    return met.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def _nearest_rows(x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, squared distance to six places) of the k nearest of each row of x; of equals the first rows of y."""
    norms_x, norms_y = (np.einsum("ij,ij->i", v, v, dtype=np.float64) for v in (x, y))
    largest = norms_y.max(where=np.isfinite(norms_y), initial=0)
    top = norms_x.max(where=np.isfinite(norms_x), initial=largest)
    kind, unit = (np.float32, 2.0**-24) if top < 1e12 else (np.float64, 2.0**-53)
    # |x - y|^2 without |x|^2 as one product
    left = np.hstack([-2 * x.astype(kind), np.ones((len(x), 1), kind)])
    right = np.ascontiguousarray(np.hstack([y.astype(kind), norms_y[:, None].astype(kind)]).T)
    margin = 2e-6 + 4 * (x.shape[1] + 8) * unit * (norms_x + 2 * largest)
    room = np.empty((_ROWS, _COLUMNS), kind)
    nothing = np.zeros(0, np.int64)
    out = [(nothing, nothing, np.zeros(0))]
    for start in range(0, len(x) if len(y) else 0, _ROWS):
        part = slice(start, min(start + _ROWS, len(x)))
        n = part.stop - start
        rows, at, d = out[0]
        bound = np.full(n, np.inf)
        for c in range(0, len(y), _COLUMNS):
            got = np.matmul(left[part], right[:, c : c + _COLUMNS], out=room[:n, : min(_COLUMNS, len(y) - c)])
            limit = bound - norms_x[part] + margin[part]
            if c == 0 and got.shape[1] > k:
                limit = np.partition(got, k - 1, axis=1)[:, k - 1] + 2 * margin[part]
            near = np.flatnonzero(~(got > limit.astype(kind)[:, None]))
            for s in range(0, len(near), _HELD):  # many equal distances don't take more memory
                i, j = np.divmod(near[s : s + _HELD], got.shape[1])
                exact = ((x[i + start].astype(np.float64) - y[j + c].astype(np.float64)) ** 2).sum(1).round(6)
                rows, at, d = np.concatenate([rows, i]), np.concatenate([at, j + c]), np.concatenate([d, exact])
                order = np.lexsort((at, d, rows))
                rows, at, d = rows[order], at[order], d[order]
                first = np.searchsorted(rows, rows)
                kept = np.arange(len(rows)) - first < k
                rows, at, d = rows[kept], at[kept], d[kept]
            full = np.flatnonzero(np.bincount(rows, minlength=n) == k)
            bound[full] = d[np.searchsorted(rows, full, "right") - 1]
        out.append((rows + start, at, d))
    return tuple(np.concatenate(o) for o in zip(*out))


def stored(vectors: DataFrame, vec_id: int) -> list[float]:
    """The vector of a stored id, which must be there."""
    rows = vectors.where(F.col("vec_id") == vec_id).select("v").take(1)
    if not rows:
        raise KeyError(f"no vector is stored for {vec_id}")
    return list(rows[0]["v"])


def proximity(vectors: DataFrame, k: int) -> DataFrame:
    """(vec_id, neighbour, distance) for vectors (vec_id, doc_id, v, is_reference): of each chunk that is no reference the k
    nearest of all, without those of its own document and without references."""
    owners = vectors.select("vec_id", "doc_id", "is_reference")
    other = owners.select(F.col("vec_id").alias("neighbour"), F.col("doc_id").alias("__other"), F.col("is_reference").alias("__ref"))
    joined = nearest_of_all(vectors.drop("is_reference"), k).join(owners, "vec_id").join(other, "neighbour")
    return joined.where("not is_reference and not __ref and doc_id <> __other").select("vec_id", "neighbour", "distance")
