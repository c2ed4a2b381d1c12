"""Queries on pipeline state, versions and files: what is current, what must be made again, what to ingest."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from lectern.functions import versions as V
from lectern.operators import refresh as R
from lectern.operators import storage as ops
from lectern.plans.catalog import query
from lectern.plans.storage import _ORDER, _SQL_VERSIONS, V2, versioned
from lectern.sources import files as S
from lectern.sources.fixtures import Rows
from lectern.sources.tables import SQL_BIB, SQL_VECTORS, bibliography, table, vectors

_PARTS = ["fingerprint=text-v1", "extractor=layout-v2", "sectioner=rules-v2", "llm_sectioner=review-v1", "sectioning_mode=llm-assisted", "reviewed_headings=none", "chunker=section-aware-v2", "target_chars=2000"]
_WANTED = ";".join(_PARTS)
#: State by id: of every fifth none, of every seventh an old extractor's, of every eleventh rules; every thirteenth has no text.
_SQL_STATE = f"""state AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN '{_WANTED.replace("layout-v2", "layout-v1")}' WHEN doc_id % 11 = 0 THEN '{_WANTED.replace("llm-assisted", "rules-based")}' ELSE '{_WANTED}' END AS print,
  CASE WHEN doc_id % 13 = 0 THEN 'no_extractable_text' ELSE 'ok' END AS status FROM documents WHERE doc_id % 5 <> 0 OR doc_id % 13 = 0)"""
_OK = "(NOT coalesce(print LIKE '%layout-v1%', true))"


def _none():
    return F.lit(None).cast("array<string>")


def wanted():
    return V.fingerprint(_none(), F.lit(True), F.lit(2000))


def state_of(spark, d):
    n = F.col("doc_id")
    old = V.fingerprint(_none(), F.lit(True), F.lit(2000), extractor=F.lit("layout-v1"))
    rules = V.fingerprint(_none(), F.lit(False), F.lit(2000))
    printed = F.when(n % 13 == 0, None).when(n % 7 == 0, old).when(n % 11 == 0, rules).otherwise(wanted())
    return table(spark, d, "documents").where((n % 5 != 0) | (n % 13 == 0)).select("doc_id", printed.alias("print"), F.when(n % 13 == 0, R.NO_TEXT).otherwise("ok").alias("status"))


_PRINTS = Rows("id:int print:string", (1, _WANTED), (2, _WANTED.replace("layout-v2", "layout-v1")), (3, _WANTED.replace("llm-assisted", "reviewed").replace("=none", "=0123456789abcdef")), (4, ""), (5, None), (6, ";".join(reversed(_PARTS))), (7, _WANTED + ";chunker=old"), (8, _WANTED.replace("=2000", "=1000")), (9, "x;=y;" + _WANTED))


@query("f37_fingerprints", f"WITH {_PRINTS.sql('t')} SELECT id, id IN (1, 3, 6, 9) AS is_current, coalesce(print = '{_WANTED}', false) AS equal, CASE WHEN id IN (4, 5) THEN NULL WHEN id = 7 THEN 'old' ELSE 'section-aware-v2' END AS chunker FROM t")
def fingerprints(spark, d):
    """Current: the components that matter agree, in any order; the last of equal keys counts. Equality is another predicate."""
    printed = F.col("print")
    return _PRINTS.frame(spark).select("id", V.is_current(printed).alias("is_current"), F.coalesce(printed == wanted(), F.lit(False)).alias("equal"), V.part_of(printed, "chunker").alias("chunker"))


@query("f37_built_fingerprints", """WITH h AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE [source, '  A   ' || lang] END AS headings, doc_id % 3 = 0 AS llm FROM documents)
SELECT doc_id, 'fingerprint=text-v1;extractor=layout-v2;sectioner=rules-v2;llm_sectioner=review-v1;sectioning_mode=' || CASE WHEN headings IS NOT NULL THEN 'reviewed' WHEN llm THEN 'llm-assisted' ELSE 'rules-based' END
 || ';reviewed_headings=' || CASE WHEN headings IS NULL THEN 'none' ELSE substr(sha256(lower(headings[1]) || chr(10) || lower(trim(regexp_replace(headings[2], '\\s+', ' ', 'g')))), 1, 16) END || ';chunker=section-aware-v2;target_chars=' || (1000 + doc_id % 2 * 1000) AS print FROM h""")
def built_fingerprints(spark, d):
    n = F.col("doc_id")
    headings = F.when(n % 4 != 0, F.array("source", F.concat(F.lit("  A   "), "lang")))
    return table(spark, d, "documents").select("doc_id", V.fingerprint(headings, n % 3 == 0, (1000 + n % 2 * 1000).cast("int")).alias("print"))


@query("p10_pipeline_states", f"WITH {_SQL_STATE} SELECT d.doc_id, coalesce(status = 'no_extractable_text', false) AS no_text, coalesce(status = 'no_extractable_text' OR print = '{_WANTED}', false) AS equal, coalesce({_OK} AND print IS NOT NULL, false) AS current FROM documents d LEFT JOIN state USING (doc_id)")
def pipeline_states(spark, d):
    return R.states(table(spark, d, "documents").select("doc_id"), state_of(spark, d), wanted()).select("doc_id", "no_text", "equal", "current")


_SQL_NEED = f"""need AS (SELECT b.doc_id, b.title, b.path, CASE WHEN status = 'no_extractable_text' THEN NULL WHEN print IS NULL OR NOT {_OK} THEN 'stale' WHEN i.doc_id IS NULL THEN 'not indexed' END AS need
  FROM bib b LEFT JOIN state USING (doc_id) LEFT JOIN (SELECT DISTINCT doc_id FROM vectors WHERE doc_id % 2 = 0) i USING (doc_id))"""


def indexed(spark, d):
    return vectors(spark, d).where("doc_id % 2 = 0").select("doc_id")


@query("p11_stale_documents", f"WITH {SQL_BIB}, {SQL_VECTORS}, {_SQL_STATE}, {_SQL_NEED} SELECT doc_id, need FROM need")
def stale_documents(spark, d):
    return R.needs(bibliography(spark, d).select("doc_id"), state_of(spark, d), indexed(spark, d)).select("doc_id", "need")


@query("l9_refresh_list", f"WITH {SQL_BIB}, {SQL_VECTORS}, {_SQL_STATE}, {_SQL_NEED} SELECT row_number() OVER (ORDER BY need = 'stale', {_ORDER}) AS place, doc_id, need FROM need WHERE need IS NOT NULL AND doc_id % 17 <> 0")
def refresh_list(spark, d):
    """Not indexed, then stale; documents whose file is gone (every seventeenth) wait until it is back."""
    bib = bibliography(spark, d).select("doc_id", "title", "path")
    return R.refresh_list(R.needs(bib, state_of(spark, d), indexed(spark, d), files=bib.where("doc_id % 17 <> 0").select("path")))


@query("u5_refresh_union", f"WITH {SQL_BIB}, {SQL_VECTORS}, {_SQL_STATE}, {_SQL_NEED} SELECT need, count(*) AS n, min(doc_id) AS least FROM need WHERE need IS NOT NULL GROUP BY need")
def refresh_union(spark, d):
    needed = R.needs(bibliography(spark, d).select("doc_id", "title", "path"), state_of(spark, d), indexed(spark, d))
    return R.refresh_list(needed).groupBy("need").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"))


@query("c10_chunking_plan", f"WITH RECURSIVE {_SQL_VERSIONS}, {_SQL_STATE}, have AS (SELECT DISTINCT doc_id FROM versioned WHERE version = '{V2}') SELECT d.doc_id, CASE WHEN status = 'no_extractable_text' THEN 'skip' WHEN h.doc_id IS NULL THEN 'build' WHEN print = '{_WANTED}' THEN 'reuse' ELSE 'rebuild' END AS action FROM documents d LEFT JOIN state USING (doc_id) LEFT JOIN have h USING (doc_id)")
def chunking_plan(spark, d):
    return R.chunking_plan(table(spark, d, "documents").select("doc_id"), state_of(spark, d), versioned(spark, d), V2, wanted())


@query("c10_chunked", f"""WITH RECURSIVE {_SQL_VERSIONS}, {_SQL_STATE}, have AS (SELECT DISTINCT doc_id FROM versioned WHERE version = '{V2}'),
p AS (SELECT d.doc_id, CASE WHEN status = 'no_extractable_text' THEN 'skip' WHEN h.doc_id IS NULL THEN 'build' WHEN print = '{_WANTED}' THEN 'reuse' ELSE 'rebuild' END AS action FROM documents d LEFT JOIN state USING (doc_id) LEFT JOIN have h USING (doc_id))
SELECT version, count(*) AS chunks, sum(length(text)) AS chars FROM (SELECT doc_id, version, text FROM versioned JOIN p USING (doc_id) WHERE action <> 'rebuild' UNION ALL SELECT doc_id, '{V2}', text FROM chunks JOIN p USING (doc_id) WHERE action IN ('build', 'rebuild')) GROUP BY version""")
def chunked(spark, d):
    """The chunk table after a run: reused, rebuilt and new chunks, by version."""
    from lectern.operators.chunking import word_chunks

    docs = table(spark, d, "documents").select("doc_id", "text")
    chunks, _ = R.chunked(docs, state_of(spark, d), versioned(spark, d), V2, wanted(), word_chunks)
    return chunks.groupBy("version").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars"))


@query("l11_existing_status", f"""WITH RECURSIVE {_SQL_VERSIONS}, {_SQL_STATE}, {SQL_VECTORS}, have AS (SELECT DISTINCT doc_id FROM versioned WHERE version = '{V2}'), files AS (SELECT url AS path, page_id AS doc_id FROM pages WHERE page_id % 2 = 0), k AS (SELECT f.path, d.doc_id FROM files f JOIN documents d USING (doc_id)),
s AS (SELECT path, k.doc_id, h.doc_id IS NOT NULL AS has, coalesce(status = 'no_extractable_text', false) AS no_text, coalesce(print = '{_WANTED}', false) AS same, i.doc_id IS NOT NULL AS ind FROM k LEFT JOIN state USING (doc_id) LEFT JOIN have h USING (doc_id) LEFT JOIN (SELECT DISTINCT doc_id FROM vectors WHERE doc_id % 2 = 0) i USING (doc_id))
SELECT path, doc_id, has AS has_chunks, no_text OR (has AND same) AS has_current_pipeline, NOT ((no_text OR (has AND same)) AND has) OR ind AS has_index, no_text FROM s""")
def existing_status(spark, d):
    """Pages stand in for files; those with an even number have the content of the document of that id."""
    named = table(spark, d, "documents").select("doc_id", F.sha2(F.col("doc_id").cast("string"), 256).alias("sha"))
    found = table(spark, d, "pages").where("page_id % 2 = 0").select(F.col("url").alias("path"), F.sha2(F.col("page_id").cast("string"), 256).alias("sha"))
    return R.existing_status(found, named, state_of(spark, d), versioned(spark, d), indexed(spark, d), V2, wanted())


_SQL_SCREEN = """f AS (SELECT page_id AS id, 'p' || page_id AS path, CASE WHEN page_id % 9 = 0 THEN NULL ELSE 's' || page_id END AS sha, CASE WHEN page_id % 4 = 0 THEN CASE WHEN page_id % 8 = 0 THEN 's' || page_id ELSE 'other' END END AS seen,
 page_id % 5 = 0 AS done, CASE page_id % 3 WHEN 0 THEN 'approve' WHEN 1 THEN 'decline' END AS decision FROM pages),
o AS (SELECT *, CASE WHEN seen IS NOT NULL AND (sha IS NULL OR sha = seen) THEN 'rejected before' WHEN done THEN 'already there' WHEN decision = 'approve' THEN 'ingest' WHEN decision = 'decline' THEN 'rejected' ELSE 'pending' END AS outcome FROM f)"""


@query("c13_screening", f"WITH {_SQL_SCREEN} SELECT o.path, outcome, CASE WHEN outcome IN ('rejected before', 'already there') THEN seen WHEN outcome = 'rejected' THEN coalesce(sha, '-') END AS rejected_as FROM o")
def screening(spark, d):
    n = F.col("page_id")
    name = lambda mark: F.concat(F.lit(mark), n.cast("string"))
    pages = table(spark, d, "pages")
    found = pages.select(name("p").alias("path"), F.when(n % 9 != 0, name("s")).alias("sha"))
    rejected = pages.where(n % 4 == 0).select(name("p").alias("path"), F.when(n % 8 == 0, name("s")).otherwise("other").alias("sha"))
    status = pages.where(n % 5 == 0).select(name("p").alias("path"), F.lit(True).alias("has_current_pipeline"), F.lit(True).alias("has_index"))
    decisions = pages.where(n % 3 != 2).select(name("p").alias("path"), F.when(n % 3 == 0, "approve").otherwise("decline").alias("decision"))
    outcomes, kept = R.screening(found, rejected, status, decisions)
    return outcomes.join(kept.select("path", F.coalesce("sha", F.lit("-")).alias("rejected_as")), "path", "left").select("path", "outcome", "rejected_as")


# ---- files: the tables' own ---------------------------------------------------------------


@query("s1_file_kinds")
def file_kinds(spark, d):
    """(name, is_pdf, is_parquet) of the files that the tables are in; tested on files of both kinds."""
    name = F.element_at(F.split("path", "/"), -1)
    return S.kinds(S.contents(spark, d).drop("content"), is_pdf=S.PDF, is_parquet=b"PAR1").select(name.alias("name"), "is_pdf", "is_parquet")


@query("s3_discovered_files")
def discovered_files(spark, d):
    return S.discovered(spark, d, ".PARQUET").select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")


@query("s4_ingest_targets")
def ingest_targets(spark, d):
    """A single file given before its folder comes first, and once."""
    one = sorted(n for n in os.listdir(d) if n.startswith("region"))[0]
    return S.targets(spark, [f"{d}/{one}", d], ".parquet", b"PAR1").select("place", F.element_at(F.split("path", "/"), -1).alias("name"), "error")


@query("p12_files_that_exist", f"WITH {SQL_BIB} SELECT doc_id FROM bib WHERE doc_id % 17 <> 0")
def files_that_exist(spark, d):
    """Documents whose path is listed."""
    bib = bibliography(spark, d).select("doc_id", "path")
    return bib.join(bib.where("doc_id % 17 <> 0").select("path"), "path", "left_semi").select("doc_id")


@query("s17_delete_everything", """SELECT 'documents' AS name, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
UNION ALL SELECT 'alerts', count(*) FROM events WHERE user_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) AND event_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
UNION ALL SELECT 'chunks', count(*) FROM embeddings WHERE vec_id // 5 NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
UNION ALL SELECT 'links', count(*) FROM events WHERE event_id % 3 = 0 AND user_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) AND event_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
UNION ALL SELECT 'decisions', count(*) FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) AND turn NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def delete_everything(spark, d):
    """Documents and all that derives from them: alerts on either side, their links, chunks, decisions. Events stand in for alerts, conversations for decisions."""
    gone = table(spark, d, "labels").where("toxic = 1").select("doc_id")
    alerts = table(spark, d, "events").select(F.col("event_id").alias("pa_id"), F.col("user_id").alias("doc_a"), F.col("event_id").alias("doc_b"))
    frames = {
        "documents": table(spark, d, "documents").select("doc_id"), "alerts": alerts, "links": alerts.where("pa_id % 3 = 0").select("pa_id"), "chunks": vectors(spark, d).select("doc_id", "chunk_index"),
        "decisions": table(spark, d, "conversations").select(F.col("conv_id").alias("doc_a"), F.col("turn").cast("bigint").alias("doc_b")),
    }
    out = None
    for name, rows in ops.without_documents(gone, **frames).items():
        n = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = n if out is None else out.unionByName(n)
    return out
