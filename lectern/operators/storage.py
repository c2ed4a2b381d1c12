"""State tables as immutable frames: keyed inserts, upserts, deletes and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import ascii_lower, clean, has_literal


def latest(events: DataFrame, *keys: str, by: str = "ts", tie: str = "seq") -> DataFrame:
    """Upsert as latest-per-key over an append-only table."""
    w = Window.partitionBy(*keys).orderBy(F.desc(by), F.desc(tie))
    return events.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def get_or_create(existing: DataFrame, arriving: DataFrame, key: str = "sha", order: str = "doc_id") -> DataFrame:
    """Rows to append: content not stored yet, the first arrival of each; stored rows always win."""
    w = Window.partitionBy(key).orderBy(order)
    new = arriving.join(existing.select(key), key, "left_anti")
    return new.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def update_errors(updates: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, error) of updates that say nothing: all their fields are null."""
    nothing = F.lit(True)
    for f in fields:
        nothing = nothing & F.col(f).isNull()
    return updates.where(nothing).select(key, F.lit("nothing to update").alias("error"))


def updated(rows: DataFrame, updates: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Left join of updates; null leaves a field as it is. Titles and authors are cleaned, and blank ones are null."""
    for f in set(fields) & {"title", "authors"}:
        updates = updates.withColumn(f, clean(F.col(f)))
    u = updates.select(F.col(key), *[F.col(f).alias(f"__{f}") for f in fields])
    joined = rows.join(u, key, "left")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in fields else F.col(c) for c in rows.columns])


def without_document(doc_id: int, alerts: DataFrame, links: DataFrame, chunks: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Drop what derives from a document: links of its alerts, alerts on either side, chunks, pipeline state."""
    mine = alerts.where((F.col("doc_a") == doc_id) | (F.col("doc_b") == doc_id)).select("pa_id")
    return alerts.join(mine, "pa_id", "left_anti"), links.join(mine, "pa_id", "left_anti"), chunks.where(F.col("doc_id") != doc_id), state.where(F.col("doc_id") != doc_id)


def listing_key() -> list[Column]:
    """What document listings are ordered by: titled first, titles and paths without ASCII case, then the id."""
    return [F.col("title").isNull(), ascii_lower(F.col("title")), ascii_lower(F.col("path")), F.col("doc_id")]


def listing_order() -> list[Column]:
    return [c.asc() for c in listing_key()]


def without_documents(gone: DataFrame, documents: DataFrame, alerts: DataFrame, links: DataFrame, chunks: DataFrame, decisions: DataFrame) -> dict[str, DataFrame]:
    """All tables without documents (doc_id) and what derives from them: alerts on either side, the links of those
    alerts, chunks, and decisions on pairs with them."""
    def without_pairs(rows: DataFrame) -> DataFrame:
        one, other = gone.withColumnRenamed("doc_id", "doc_a"), gone.withColumnRenamed("doc_id", "doc_b")
        return rows.join(one, "doc_a", "left_anti").join(other, "doc_b", "left_anti")

    kept = without_pairs(alerts)
    return {
        "documents": documents.join(gone, "doc_id", "left_anti"), "alerts": kept, "links": links.join(kept.select("pa_id"), "pa_id", "left_semi"),
        "chunks": chunks.join(gone, "doc_id", "left_anti"), "decisions": without_pairs(decisions),
    }


#: Ranges into which a global order is cut, and how many rows, chosen by hash, tell where.
RANGES, SAMPLED = 64, 1024


def numbered(rows: DataFrame, key: list[Column], name: str) -> DataFrame:
    """Rows with their place, from 1, in the order of the key (ascending, nulls first), which must tell rows apart.

    The order is cut into ranges by a small sample; places within a range plus counts of the
    ranges before give the place. So no task sorts all rows, and the same rows give the same places.
    """
    keyed = rows.withColumn("__key", F.struct(*[k.alias(f"k{i}") for i, k in enumerate(key)]))
    kinds = [f.dataType for f in keyed.schema["__key"].dataType.fields]
    sample = sorted((tuple((v is not None, v) for v in r["__key"]) for r in keyed.select("__key").orderBy(F.xxhash64("__key")).limit(SAMPLED).collect()), key=lambda t: [(a, b if a else 0) for a, b in t])
    cuts = sample[:: max(1, len(sample) // RANGES)][1:]
    literal = lambda row: F.struct(*[F.lit(v).cast(kind).alias(f"k{i}") for i, ((_, v), kind) in enumerate(zip(row, kinds))])
    part = F.size(F.filter(F.array(*[literal(c) for c in cuts]), lambda c: c <= F.col("__key"))) if cuts else F.lit(0)
    ranged = keyed.withColumn("__part", part)
    counts = ranged.groupBy("__part").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    inside = ranged.withColumn("__rn", F.row_number().over(Window.partitionBy("__part").orderBy("__key")))
    placed = inside.join(F.broadcast(counts.select("__part", before.alias("__before"))), "__part")
    return placed.withColumn(name, F.col("__before") + F.col("__rn")).drop("__part", "__rn", "__before", "__key")


FIELDS = ("title", "authors", "doi", "path")


def any_field(needle: str) -> Column:
    cond = has_literal(F.col("year").cast("string"), needle)
    for f in FIELDS:
        cond = cond | has_literal(F.col(f), needle)
    return cond


def search_metadata(bib: DataFrame, needle: str, limit: int = 20) -> DataFrame:
    """Documents with a literal substring in any field; newest first. A blank query finds nothing."""
    if not needle.strip():
        return bib.limit(0)
    return bib.where(any_field(needle.strip())).orderBy(F.col("year").desc_nulls_last(), F.col("title").isNull(), ascii_lower(F.col("title")), ascii_lower(F.col("path")), "doc_id").limit(limit)


def any_of_fields(terms: list[str]) -> Column:
    cond = F.lit(False)
    for t in terms:
        cond = cond | any_field(t)
    return cond


def search_metadata_terms(bib: DataFrame, terms: list[str], limit: int = 20) -> DataFrame:
    return bib.where(any_of_fields(terms)).orderBy(F.col("year").desc_nulls_last(), F.col("title").isNull(), ascii_lower(F.col("title")), ascii_lower(F.col("path")), "doc_id").limit(limit)


def _chunk_order(hits: DataFrame) -> list[Column]:
    version = [F.col("version")] if "version" in hits.columns else []
    return [F.col("title").isNull(), ascii_lower(F.col("title")), ascii_lower(F.col("path")), F.col("doc_id"), *version, F.col("chunk_index")]


def search_chunks(chunks: DataFrame, bib: DataFrame, needle: str, limit: int = 20) -> DataFrame:
    """Chunks, of all versions, with a literal substring, in the order of their documents' titles. The filter runs before the join."""
    hits = chunks.where(has_literal(F.col("text"), needle)).join(bib.select("doc_id", "title", "path"), "doc_id")
    return hits.orderBy(*_chunk_order(hits)).limit(limit)


def search_chunks_any(chunks: DataFrame, bib: DataFrame, terms: list[str], limit: int = 100, version: str | None = None) -> DataFrame:
    """Chunks with any of the terms; of one chunker version, if it is given."""
    cond = F.lit(version is None) if version is None else F.col("version") == version
    some = F.lit(False)
    for t in terms:
        some = some | has_literal(F.col("text"), t)
    hits = chunks.where(cond & some).join(bib.select("doc_id", "title", "path"), "doc_id")
    return hits.orderBy(*_chunk_order(hits)).limit(limit)


def document_chunks(chunks: DataFrame, version: str) -> DataFrame:
    """(doc_id, chunks): each document's chunks of one version in the order of their index."""
    mine = chunks.where(F.col("version") == version)
    return mine.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))).alias("chunks"))
