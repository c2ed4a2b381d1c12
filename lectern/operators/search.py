"""Hybrid retrieval: four candidate sources, one union, evidence scores."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.references import is_reference_chunk
from lectern.functions.text import GLUE, has_literal, squeezed
from lectern.operators import storage
from lectern.operators.vectors import nearest

_TERM = re.compile(r"[A-Za-z0-9][A-Za-z0-9_'-]*")


def terms_of(query: str) -> list[str]:
    """The distinct terms of a query: a pure function of the query, so it is found on the driver."""
    bare = (t.strip("_'-").lower() for t in _TERM.findall(query))
    return list(dict.fromkeys(t for t in bare if len(t) >= 2 and t not in GLUE))


def evidence(text: Column, query: str, terms: list[str], phrase_weight: float, coverage_weight: float, match_weight: float) -> Column:
    """Literal evidence in a text: the phrase, the share of terms, and up to five of them. Terms match as substrings."""
    low = squeezed(F.lower(F.coalesce(text, F.lit(""))))
    phrase = " ".join(query.lower().split())
    score = F.when(F.contains(low, F.lit(phrase)), phrase_weight).otherwise(0.0) if len(phrase) >= 4 else F.lit(0.0)
    if terms:
        hits = sum((F.when(F.contains(low, F.lit(t)), 1).otherwise(0) for t in terms), F.lit(0))
        score = score + hits / len(terms) * coverage_weight + F.least(hits, F.lit(5)) * match_weight
    return F.when(low == "", 0.0).otherwise(F.round(score, 6))


def lexical_score(text: Column, query: str, terms: list[str]) -> Column:
    return evidence(text, query, terms, 2.0, 1.2, 0.1)


def metadata_text() -> Column:
    return F.concat_ws(" ", "title", "authors", F.col("year").cast("string"), "doi", "path")


def metadata_score(query: str, terms: list[str]) -> Column:
    return evidence(metadata_text(), query, terms, 1.75, 1.4, 0.15)


def semantic_score(distance: Column) -> Column:
    return F.coalesce(F.greatest(F.lit(0.0), 1 - distance), F.lit(0.0))


#: Shares of the tasks whose first chunks are found apart.
SHARES = 32
#: What a candidate source adds to the place numbers, in the order in which sources are merged.
_BASE = {"semantic": 0, "literal": 10_000, "any": 20_000, "metadata": 30_000}


def _found_documents(bib: DataFrame, query: str, terms: list[str], n: int) -> DataFrame:
    """Documents whose metadata has the phrase, or a term; the first n of each, newest first. At most 2n rows."""
    phrase = storage.any_field(query.strip()) if query.strip() else F.lit(False)
    ways = F.filter(F.array(F.when(phrase, "phrase"), F.when(storage.any_of_fields(terms), "terms")), lambda x: x.isNotNull())
    by = Window.partitionBy("way").orderBy(F.col("year").desc_nulls_last(), F.col("title").isNull(), storage.ascii_lower(F.col("title")), storage.ascii_lower(F.col("path")), "doc_id")
    hits = bib.select("doc_id", "title", "path", "year", F.explode(ways).alias("way"))
    return hits.withColumn("rn", F.row_number().over(by)).where(F.col("rn") <= n).select("doc_id").distinct()


def candidates(chunks: DataFrame, bib: DataFrame, vectors: DataFrame, query: str, query_vector: list[float], n: int, max_distance: float | None = None, excluded: list[int] = ()) -> DataFrame:
    """Chunks (with text and bibliography) that one of four capped sources found: place, distance, sources.

    One pass over the chunks: each says which sources it is found by, and of every source the
    first few are kept. The caps are part of the meaning. ``max_distance`` holds for the semantic
    source alone.
    """
    near, literal, about = max(5 * n, 40), max(5 * n, 40), max(3 * n, 20)
    caps = {"semantic": near, "literal": literal, "any": 5 * literal, "metadata": 4 * about}
    terms = terms_of(query)
    stored = nearest(vectors, query_vector, near, max_distance, excluded).select("doc_id", "chunk_index", "vec_id", "distance")
    found = _found_documents(bib, query, terms, about).withColumn("about", F.lit(True))
    keep = ~F.col("doc_id").isin(*excluded) if excluded else F.lit(True)
    has_any = F.lit(False)
    for t in terms:
        has_any = has_any | has_literal(F.col("text"), t)
    rows = chunks.join(F.broadcast(stored), ["doc_id", "chunk_index"], "left").join(F.broadcast(found), "doc_id", "left")
    flags = {
        "semantic": F.col("vec_id").isNotNull(), "literal": keep & has_literal(F.col("text"), query), "any": keep & has_any,
        "metadata": keep & F.coalesce("about", F.lit(False)) & (F.col("chunk_index") < 2),
    }
    ways = F.filter(F.array(*[F.when(c, name) for name, c in flags.items()]), lambda x: x.isNotNull())
    marked = rows.withColumn("ways", ways).where(F.size("ways") > 0).join(bib.select("doc_id", "title", "authors", "year", "doi", "path"), "doc_id")
    each = marked.withColumn("way", F.explode("ways"))
    semantic, lexical = F.col("way") == "semantic", F.col("way").isin("literal", "any")
    order = [
        F.when(semantic, F.col("distance")), F.when(semantic, F.col("vec_id")), F.when(lexical, F.col("title").isNull()), F.when(lexical, storage.ascii_lower(F.col("title"))),
        F.when(lexical, storage.ascii_lower(F.col("path"))), F.col("doc_id"), F.col("chunk_index"),
    ]
    by = Window.partitionBy("way").orderBy(*order)
    allowed, base = (F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[F.col("way")] for table in (caps, _BASE))
    # the first of each of some shares, then of all: no task reads what every task before it has kept. A task's rows are of one share, so it keeps no more than it did
    share = F.pmod(F.spark_partition_id(), F.lit(SHARES))
    shared = Window.partitionBy("way", "share").orderBy(*order)
    each = each.withColumn("share", share).withColumn("rn", F.row_number().over(shared)).where(F.col("rn") <= max(caps.values())).drop("rn", "share")
    first = each.withColumn("rn", F.row_number().over(by)).where(F.col("rn") <= max(caps.values())).where(F.col("rn") <= allowed)
    source = F.when(lexical, "lexical").otherwise(F.col("way"))
    kept = [c for c in marked.columns if c not in ("doc_id", "chunk_index", "distance", "ways", "about", "vec_id")]
    return first.groupBy("doc_id", "chunk_index").agg(F.min(F.col("rn") + base).alias("place"), F.max(F.when(semantic, F.col("distance"))).alias("distance"), F.collect_set(source).alias("sources"), *[F.first(c).alias(c) for c in kept])


def hybrid(chunks: DataFrame, bib: DataFrame, vectors: DataFrame, query: str, query_vector: list[float], n: int = 10, max_distance: float | None = None, excluded: list[int] = (), include_references: bool = False) -> DataFrame:
    """(doc_id, chunk_index, distance, score, reasons, place, title) of the n best chunks.

    Candidates merge by chunk; chunks or documents that don't exist drop out; scores add up.
    Chunks of reference sections are dropped, or lose half a point when included.
    """
    terms = terms_of(query)
    rows = candidates(chunks, bib, vectors, query, query_vector, n, max_distance, excluded)
    heading = F.col("section_title") if "section_title" in rows.columns else F.lit(None).cast("string")
    reference = is_reference_chunk(heading, F.col("text"))
    scored = rows.withColumn("lexical", lexical_score(F.concat_ws("\n", heading, "text"), query, terms)).withColumn("metadata", metadata_score(query, terms)).withColumn("is_reference", reference)
    if not include_references:
        scored = scored.where("not is_reference")
    score = F.round(semantic_score(F.col("distance")) + F.col("lexical") + F.col("metadata") - F.when(F.col("is_reference"), 0.5).otherwise(0.0), 6)
    extra = F.filter(F.array(F.when(F.col("lexical") > 0, "lexical"), F.when(F.col("metadata") > 0, "metadata")), lambda x: x.isNotNull())
    named = scored.select("doc_id", "chunk_index", "distance", score.alias("score"), F.array_join(F.array_sort(F.array_union("sources", extra)), ",").alias("reasons"), "place", "title")
    return named.orderBy(F.desc("score"), F.asc_nulls_last("distance"), "chunk_index", "place").limit(n)


def documents(hits: DataFrame, n: int) -> DataFrame:
    """(doc_id, title, score, best_chunk): documents by their best chunk; the first of equal chunks counts."""
    order = [F.desc("score"), F.asc_nulls_last("distance"), F.asc("chunk_index"), F.asc("place")]
    best = hits.withColumn("rn", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))).where("rn = 1")
    return best.orderBy(*order).limit(n).select("doc_id", "title", "score", F.col("chunk_index").alias("best_chunk"))


def gate(hits: DataFrame, judgments: DataFrame, n: int) -> DataFrame:
    """The first n hits that weren't judged irrelevant; without judgment a hit passes."""
    return hits.join(judgments, ["doc_id"], "left").where(~F.coalesce(~F.col("relevant"), F.lit(False))).orderBy(F.desc("score"), F.asc_nulls_last("distance"), "chunk_index", "place").limit(n)
