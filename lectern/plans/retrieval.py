"""Retrieval queries: vectors, scores, hybrid search."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions.references import is_reference_chunk
from lectern.operators import search
from lectern.operators import vectors as vec
from lectern.plans.catalog import query
from lectern.plans.storage import _FOLD, _NEWEST, _ORDER, _anywhere, chunks_of
from lectern.sources.fixtures import Rows
from lectern.sources.tables import SQL_BIB, SQL_CHUNKS, SQL_VECTORS, bibliography, table, vectors

ASKED = 3  # the stored vector that serves as the query's
TEXT = "Thing that waits"
TERMS = search.terms_of(TEXT)


def asked_vector(spark, d) -> list[float]:
    return vec.stored(vectors(spark, d), ASKED)


_DISTANCE = "round(list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6)"
_NEAR = f"near AS (SELECT x.vec_id, x.doc_id, x.chunk_index, {_DISTANCE.format(a='x.v', b='q.v')} AS distance FROM vectors x, (SELECT v FROM vectors WHERE vec_id = {ASKED}) q ORDER BY distance, vec_id LIMIT 50)"


@query("r2_vector_topk", f"WITH {SQL_VECTORS}, {_NEAR} SELECT * FROM near WHERE distance <= 1.6 AND doc_id NOT IN (0, 7)")
def vector_topk(spark, d):
    return vec.nearest(vectors(spark, d), asked_vector(spark, d), 50, max_distance=1.6, excluded=[0, 7])


@query("r3_similar_to_stored", f"WITH {SQL_VECTORS}, {_NEAR} SELECT * FROM near")
def similar_to_stored(spark, d):
    """The nearest of a stored vector, itself among them; an id without vector is an error."""
    return vec.nearest(vectors(spark, d), vec.stored(vectors(spark, d), ASKED), 50)


@query("r4_semantic_scores", f"WITH {SQL_VECTORS}, {_NEAR} SELECT vec_id, greatest(0.0, round(1 - distance, 6)) AS score FROM near")
def semantic_scores(spark, d):
    return similar_to_stored(spark, d).select("vec_id", F.round(search.semantic_score(F.col("distance")), 6).alias("score"))


@query("f49_cosine_pairs", f"""WITH {SQL_VECTORS} SELECT a.vec_id AS a, b.vec_id AS b, round(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))
/ (sqrt(list_sum(list_transform(a.v, lambda x: x * x))) * sqrt(list_sum(list_transform(b.v, lambda x: x * x)))), 6) AS cosine FROM vectors a JOIN vectors b ON a.doc_id = b.doc_id AND a.vec_id < b.vec_id""")
def cosine_pairs(spark, d):
    """Pairs of chunks of one document."""
    v = vectors(spark, d).select("doc_id", "vec_id", "v")
    pairs = v.select("doc_id", F.col("vec_id").alias("a"), F.col("v").alias("x")).join(v.select("doc_id", F.col("vec_id").alias("b"), F.col("v").alias("y")), "doc_id").where("a < b")
    return pairs.select("a", "b", vec.cosine(F.col("x"), F.col("y")).alias("cosine"))


_ALL_NEAR = f"""pairs AS (SELECT a.vec_id, b.vec_id AS neighbour, a.doc_id AS doc_a, b.doc_id AS doc_b, {_DISTANCE.format(a='a.v', b='b.v')} AS distance FROM vectors a, vectors b),
ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour) AS rank FROM pairs),
alerts AS (SELECT vec_id, neighbour, doc_a, doc_b, distance FROM ranked WHERE rank <= 10 AND doc_a <> doc_b AND vec_id % 17 <> 3 AND neighbour % 17 <> 3)"""


@query("r8_proximity_alerts", f"WITH {SQL_VECTORS}, {_ALL_NEAR} SELECT vec_id, neighbour, distance FROM alerts")
def proximity_alerts(spark, d):
    """The ten nearest of every stored chunk first; the document's own chunks and those of reference sections go after that. Every seventeenth chunk is one of "References"."""
    title = F.when(F.col("vec_id") % 17 == 3, "References")
    stored = vectors(spark, d).withColumn("is_reference", is_reference_chunk(title, F.lit(None).cast("string")))
    return vec.proximity(stored, 10)


def _sql_evidence(text: str, phrase: float, coverage: float, match: float) -> str:
    hits = " + ".join(f"CASE WHEN contains({text}, '{t}') THEN 1 ELSE 0 END" for t in TERMS)
    return f"round(CASE WHEN contains({text}, '{' '.join(TEXT.lower().split())}') THEN {phrase} ELSE 0 END + ({hits}) / {float(len(TERMS))} * {coverage} + least({hits}, 5) * {match}, 6)"


_LOW = "trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))"
_META = "lower(concat_ws(' ', title, authors, year, doi, path))"


@query("r5_lexical_scores", f"WITH RECURSIVE {SQL_CHUNKS} SELECT doc_id, chunk_index, {_sql_evidence(_LOW, 2.0, 1.2, 0.1)} AS score FROM chunks")
def lexical_scores(spark, d):
    return chunks_of(spark, d).select("doc_id", "chunk_index", search.lexical_score(F.col("text"), TEXT, TERMS).alias("score"))


@query("r6_metadata_scores", f"WITH {SQL_BIB} SELECT doc_id, {_sql_evidence(_META, 1.75, 1.4, 0.15)} AS score FROM bib")
def metadata_scores(spark, d):
    return bibliography(spark, d).select("doc_id", search.metadata_score(TEXT, TERMS).alias("score"))


def _any(column: str) -> str:
    return " OR ".join(f"contains({_FOLD.format(column)}, '{t}')" for t in TERMS)


_C = _ORDER.replace("doc_id", "c.doc_id")
_HYBRID = f"""{SQL_CHUNKS}, {SQL_BIB}, {SQL_VECTORS}, {_NEAR},
 x AS (SELECT c.doc_id, c.chunk_index, row_number() OVER (ORDER BY {_C}, c.chunk_index) + 10000 AS place FROM chunks c JOIN bib USING (doc_id) WHERE contains({_FOLD.format('c.text')}, '{TEXT.lower()}') ORDER BY place LIMIT 50),
 y AS (SELECT c.doc_id, c.chunk_index, row_number() OVER (ORDER BY {_C}, c.chunk_index) + 20000 AS place FROM chunks c JOIN bib USING (doc_id) WHERE {_any('c.text')} ORDER BY place LIMIT 250),
 m AS (SELECT doc_id FROM (SELECT doc_id FROM bib WHERE {_anywhere(TEXT.lower())} ORDER BY {_NEWEST} LIMIT 30) UNION SELECT doc_id FROM (SELECT doc_id FROM bib WHERE {' OR '.join(_anywhere(t) for t in TERMS)} ORDER BY {_NEWEST} LIMIT 30)),
 z AS (SELECT doc_id, chunk_index, row_number() OVER (ORDER BY doc_id, chunk_index) + 30000 AS place FROM chunks JOIN m USING (doc_id) WHERE chunk_index < 2),
 cand AS (SELECT doc_id, chunk_index, 'semantic' AS source, row_number() OVER (ORDER BY distance, vec_id) AS place, distance FROM near UNION ALL SELECT doc_id, chunk_index, 'lexical', place, NULL FROM x
   UNION ALL SELECT doc_id, chunk_index, 'lexical', place, NULL FROM y UNION ALL SELECT doc_id, chunk_index, 'metadata', place, NULL FROM z),
 merged AS (SELECT doc_id, chunk_index, min(place) AS place, max(distance) AS distance, list(DISTINCT source) AS sources FROM cand GROUP BY ALL),
 scored AS (SELECT doc_id, chunk_index, distance, place, sources, title, {_sql_evidence(_LOW, 2.0, 1.2, 0.1)} AS lex, {_sql_evidence(_META, 1.75, 1.4, 0.15)} AS met FROM merged JOIN chunks USING (doc_id, chunk_index) JOIN bib USING (doc_id)),
 hits AS (SELECT doc_id, chunk_index, distance, title, place, round(coalesce(greatest(0.0, 1 - distance), 0.0) + lex + met, 6) AS score,
   array_to_string(list_sort(list_distinct(sources || CASE WHEN lex > 0 THEN ['lexical'] ELSE [] END || CASE WHEN met > 0 THEN ['metadata'] ELSE [] END)), ',') AS reasons FROM scored)"""
_RANK = "score DESC, distance NULLS LAST, chunk_index, place"


def hits(spark, d, n):
    return search.hybrid(chunks_of(spark, d), bibliography(spark, d), vectors(spark, d), TEXT, asked_vector(spark, d), n)


@query("r7_hybrid_search", f"WITH RECURSIVE {_HYBRID} SELECT doc_id, chunk_index, distance, score, reasons FROM hits ORDER BY {_RANK} LIMIT 10")
def hybrid_search(spark, d):
    return hits(spark, d, 10).drop("place", "title")


@query("r9_document_search", f"WITH RECURSIVE {_HYBRID.replace('LIMIT 250)', 'LIMIT 625)').replace('LIMIT 50)', 'LIMIT 125)').replace('LIMIT 30)', 'LIMIT 75)')}, h AS (SELECT * FROM hits ORDER BY {_RANK} LIMIT 25), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {_RANK}) AS k FROM h) SELECT doc_id, title, score, chunk_index AS best_chunk FROM b WHERE k = 1 ORDER BY {_RANK} LIMIT 5")
def document_search(spark, d):
    return search.documents(hits(spark, d, 25), 5)


@query("r11_relevance_gate", f"WITH RECURSIVE {_HYBRID.replace('LIMIT 250)', 'LIMIT 1250)').replace('LIMIT 50)', 'LIMIT 250)').replace('LIMIT 30)', 'LIMIT 150)')}, h AS (SELECT * FROM hits ORDER BY {_RANK} LIMIT 50) SELECT h.doc_id, h.chunk_index, h.score FROM h LEFT JOIN labels l USING (doc_id) WHERE coalesce(l.quality, 1) <> 0 ORDER BY {_RANK} LIMIT 10")
def relevance_gate(spark, d):
    judged = table(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("relevant"))
    return search.gate(hits(spark, d, 50), judged, 10).select("doc_id", "chunk_index", "score")


@query("a14_best_chunks", f"WITH {SQL_VECTORS}, {_NEAR} SELECT doc_id, chunk_index, score FROM (SELECT doc_id, chunk_index, greatest(0.0, round(1 - distance, 6)) AS score, row_number() OVER (PARTITION BY doc_id ORDER BY distance, vec_id) AS k FROM near) WHERE k = 1")
def best_chunks(spark, d):
    scored = similar_to_stored(spark, d).withColumn("score", F.round(search.semantic_score(F.col("distance")), 6))
    best = scored.groupBy("doc_id").agg(F.min(F.struct("distance", "vec_id", "chunk_index", "score")).alias("b"))
    return best.select("doc_id", "b.chunk_index", "b.score")


@query("j2_index_integrity", f"WITH RECURSIVE {SQL_CHUNKS}, {SQL_VECTORS} SELECT count(*) AS stored, count(c.doc_id) AS with_chunk FROM vectors v LEFT JOIN chunks c USING (doc_id, chunk_index)")
def index_integrity(spark, d):
    there = chunks_of(spark, d).select("doc_id", "chunk_index", F.lit(True).alias("there"))
    return vectors(spark, d).select("doc_id", "chunk_index").join(there, ["doc_id", "chunk_index"], "left").agg(F.count("*").alias("stored"), F.count("there").alias("with_chunk"))


@query("j7_excluded_documents", f"WITH {SQL_VECTORS} SELECT vec_id FROM vectors WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def excluded_documents(spark, d):
    return vectors(spark, d).join(table(spark, d, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_anti").select("vec_id")


_TEXTS = Rows("id:int title:string body:string", (1, "References", "plain"), (2, "Methods", "[1] Ada. x\n[2] Bob. y\n[3] Cyd. z"), (3, None, "[1] Ada. x\n[2] Bob. y\n[3] Cyd. z"), (4, " ", "1. Ada wrote\n2. Bob wrote"), (5, None, "As shown (1999) in the Journal of Maps, vol. 3, pp. 4"), (6, None, "prose [3] goes on"), (7, "WORKS  CITED:", ""), (8, None, None))


@query("f7_reference_chunks", f"""WITH {_TEXTS.sql('t')}, u AS (SELECT *, regexp_replace(regexp_replace(lower(trim(coalesce(title, ''))), '\\s+', ' ', 'g'), '[.:]+$', '') AS key,
 len(list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '^\\[[0-9]+\\]\\s+[A-Z][A-Za-z.-]+'))) AS b, len(list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '^[0-9]+\\.\\s+[A-Z][A-Za-z.-]+'))) AS n,
 CASE WHEN contains(lower(body), ' journal of ') THEN 1 ELSE 0 END + CASE WHEN contains(lower(body), ' vol. ') THEN 1 ELSE 0 END + CASE WHEN contains(lower(body), ' pp. ') THEN 1 ELSE 0 END AS s FROM t)
SELECT id, CASE WHEN key IN ('references', 'works cited') THEN true WHEN key <> '' THEN false ELSE coalesce(b >= 3 OR n >= 3 OR ((b > 0 OR n > 0 OR regexp_matches(body, '\\([0-9]{{4}}\\)')) AND s >= 3), false) END AS is_reference FROM u""")
def reference_chunks(spark, d):
    return _TEXTS.frame(spark).select("id", is_reference_chunk(F.col("title"), F.col("body")).alias("is_reference"))
