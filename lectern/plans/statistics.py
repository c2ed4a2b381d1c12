"""Statistics, duplicates and health queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import duplicates, reports
from lectern.plans.catalog import query
from lectern.plans.storage import chunks_of
from lectern.sources.tables import SQL_BIB, SQL_CHUNKS, SQL_LINES, bibliography, table, text_lines

_R = f"WITH RECURSIVE {SQL_CHUNKS}"


@query("a1_chunk_counts", f"{_R} SELECT doc_id, count(*) AS chunks FROM chunks GROUP BY doc_id")
def chunk_counts(spark, d):
    return chunks_of(spark, d).groupBy("doc_id").agg(F.count("*").alias("chunks"))


_SECTION_KEY = "CASE WHEN turn % 3 <> 0 THEN 'index:' || CAST(turn AS VARCHAR) WHEN trim(role) <> '' THEN 'title:' || lower(trim(role)) END"


@query("a2_section_counts", f"SELECT conv_id, count(DISTINCT {_SECTION_KEY}) AS sections FROM conversations WHERE {_SECTION_KEY} IS NOT NULL GROUP BY conv_id")
def section_counts(spark, d):
    """Conversations stand in for documents: the turn is a section index where it isn't a third one, the role its title."""
    key = F.when(F.col("turn") % 3 != 0, F.concat(F.lit("index:"), F.col("turn").cast("string"))).when(F.trim("role") != "", F.concat(F.lit("title:"), F.lower(F.trim("role"))))
    return table(spark, d, "conversations").select("conv_id", key.alias("key")).where("key is not null").groupBy("conv_id").agg(F.countDistinct("key").alias("sections"))


@query("a3_page_counts", f"WITH {SQL_LINES} SELECT doc_id, max(page) AS pages FROM lines GROUP BY doc_id")
def page_counts(spark, d):
    return text_lines(spark, d).groupBy("doc_id").agg(F.max("page").alias("pages"))


@query("a4_averages", f"""{_R}, {SQL_LINES}, c AS (SELECT doc_id, count(*) AS n FROM chunks GROUP BY doc_id), p AS (SELECT doc_id, max(page) AS n FROM lines GROUP BY doc_id)
SELECT round((SELECT sum(n) FROM c) / count(*), 4) AS chunks, round((SELECT sum(n) FROM p) / count(*), 4) AS pages FROM documents""")
def averages(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    chunks = reports.average_per_document(docs, chunk_counts(spark, d), "chunks")
    return chunks.crossJoin(reports.average_per_document(docs, page_counts(spark, d), "pages"))  # one row each


@query("a5_surnames", f"WITH {SQL_BIB}, n AS (SELECT c_name AS s FROM documents d JOIN part ON p_partkey = d.doc_id JOIN customer ON c_custkey = d.doc_id % (SELECT count(*) FROM customer) UNION ALL SELECT s_name FROM documents d JOIN part ON p_partkey = d.doc_id JOIN supplier ON s_suppkey = d.doc_id % (SELECT count(*) FROM supplier)) SELECT s AS surname, count(*) AS n FROM n GROUP BY s")
def surnames(spark, d):
    return reports.surname_counts(bibliography(spark, d))


@query("a6_years", f"WITH {SQL_BIB} SELECT year, count(*) AS n FROM bib GROUP BY year")
def years(spark, d):
    return bibliography(spark, d).groupBy("year").agg(F.count("*").alias("n"))


@query("a8_missing_counts", f"WITH {SQL_BIB} SELECT count(*) FILTER (WHERE authors IS NULL OR trim(authors) = '') AS authors, count(*) FILTER (WHERE year IS NULL) AS year, count(*) FILTER (WHERE doi IS NULL OR trim(doi) = '') AS doi FROM bib")
def missing_counts(spark, d):
    return reports.missing_counts(bibliography(spark, d))


_HEALTH = """s AS (SELECT doc_id, CASE WHEN quality = 0 THEN 'no_extractable_text' ELSE 'ok' END AS status, toxic = 0 AS is_current FROM labels),
h AS (SELECT s.status = 'no_extractable_text' OR (c.doc_id IS NOT NULL AND coalesce(s.is_current, false)) AS good FROM documents d LEFT JOIN s USING (doc_id)
  LEFT JOIN (SELECT DISTINCT doc_id FROM documents WHERE regexp_matches(text, '\\S')) c USING (doc_id) WHERE d.n_chars > 100)"""


@query("a9_chunk_health", f"WITH {_HEALTH} SELECT count(*) FILTER (WHERE coalesce(good, false)) AS current, count(*) FILTER (WHERE NOT coalesce(good, false)) AS stale_or_missing FROM h")
def chunk_health(spark, d):
    docs = table(spark, d, "documents")
    states = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 0, "no_extractable_text").otherwise("ok").alias("status"), (F.col("toxic") == 0).alias("is_current"))
    return reports.chunk_health(docs.select("doc_id"), states, chunks_of(spark, d), docs.where("n_chars > 100").select("doc_id"))


_KEYED = f"""{SQL_BIB}, keyed AS (SELECT doc_id, 0 AS priority, sha AS key FROM bib UNION ALL SELECT doc_id, 1, lower(doi) FROM bib WHERE doi IS NOT NULL
UNION ALL SELECT doc_id, 2, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) || '|' || CAST(year AS VARCHAR) || '|' || lower(split_part(authors, ' and ', 1)) FROM bib),
names AS (SELECT * FROM (VALUES (0, 'same PDF hash'), (1, 'same DOI'), (2, 'same title/year/first author')) t(priority, reason))"""
_PAIRS = f"""{_KEYED}, pairs AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, min(priority) AS priority, list(DISTINCT (priority, a.key)) AS ks FROM keyed a JOIN keyed b USING (priority, key) WHERE a.doc_id < b.doc_id GROUP BY ALL)"""


def _dismissed(spark, d):
    """Dismissals on record: neighbours 2k, 2k+1 of which the smaller id is a multiple of three."""
    docs = table(spark, d, "documents").select("doc_id")
    return docs.where("doc_id % 2 = 0 and doc_id % 3 = 0").select(F.col("doc_id").alias("doc_a"), (F.col("doc_id") + 1).alias("doc_b"))


@query("a10_duplicate_groups", f"WITH {_KEYED} SELECT reason, key, count(*) AS size, min(doc_id) AS first FROM keyed JOIN names USING (priority) GROUP BY reason, key HAVING count(*) > 1")
def duplicate_groups(spark, d):
    names = F.element_at(F.array(*[F.lit(r) for r in duplicates.REASONS]), F.col("priority") + 1)
    rows = duplicates.keyed(bibliography(spark, d)).groupBy("priority", "key").agg(F.count("*").alias("size"), F.min("doc_id").alias("first")).where("size > 1")
    return rows.select(names.alias("reason"), "key", "size", "first")


@query("a11_unresolved_groups", f"""WITH {_KEYED}, p AS (SELECT priority, a.key, a.doc_id AS x, b.doc_id AS y FROM keyed a JOIN keyed b USING (priority, key) WHERE a.doc_id < b.doc_id)
SELECT reason, count(DISTINCT p.key) AS unresolved FROM p JOIN names USING (priority) WHERE NOT (x % 6 = 0 AND y = x + 1) GROUP BY reason""")
def unresolved_groups(spark, d):
    return duplicates.unresolved_groups(bibliography(spark, d), _dismissed(spark, d))


@query("a12_dismissed_pairs", "SELECT count(*) AS dismissed FROM documents WHERE doc_id % 6 = 0")
def dismissed_pairs(spark, d):
    return _dismissed(spark, d).agg(F.count("*").alias("dismissed"))


@query("l6_duplicate_candidates", f"WITH {_KEYED}, p AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, min(priority) AS priority FROM keyed a JOIN keyed b USING (priority, key) WHERE a.doc_id < b.doc_id GROUP BY ALL) SELECT reason, doc_a, doc_b FROM p JOIN names USING (priority) WHERE NOT (doc_a % 6 = 0 AND doc_b = doc_a + 1)")
def duplicate_candidates(spark, d):
    return duplicates.candidates(bibliography(spark, d), _dismissed(spark, d))


@query("a19_outcomes", "SELECT count(*) FILTER (WHERE l.doc_id IS NULL) AS created, count(*) FILTER (WHERE l.quality = 1) AS existing, count(*) FILTER (WHERE l.quality = 0) AS failed FROM documents d LEFT JOIN labels l USING (doc_id)")
def outcomes(spark, d):
    joined = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return joined.agg(F.count_if(F.col("quality").isNull()).alias("created"), F.count_if(F.col("quality") == 1).alias("existing"), F.count_if(F.col("quality") == 0).alias("failed"))


@query("a20_median_percentile", "SELECT source, round(median(n_chars), 4) AS middle, round(quantile_cont(n_chars, 0.75), 4) AS upper FROM documents GROUP BY source")
def median_percentile(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.round(F.median("n_chars"), 4).alias("middle"), F.round(F.percentile("n_chars", 0.75), 4).alias("upper"))
