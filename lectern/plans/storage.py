"""Storage and lookup queries: keyed writes, deletes, point lookups, literal searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import versions
from lectern.functions.text import has_literal, missing
from lectern.operators import storage as ops
from lectern.operators.chunking import word_chunks
from lectern.plans.catalog import query
from lectern.sources.fixtures import Rows
from lectern.sources.tables import SQL_BIB, SQL_CHUNKS, bibliography, table, text_lines, vectors
from lectern.sources.tables import SQL_LINES, SQL_VECTORS

_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ORDER = f"title IS NULL, {_FOLD.format('title')}, {_FOLD.format('path')}, doc_id"


def chunks_of(spark, d):
    return word_chunks(table(spark, d, "documents"))


@query("c9_chunk_words", f"WITH RECURSIVE {SQL_CHUNKS} SELECT doc_id, chunk_index, length(text) AS n_chars, sha256(text) AS sha FROM chunks")
def chunk_words(spark, d):
    return chunks_of(spark, d).select("doc_id", "chunk_index", F.length("text").cast("bigint").alias("n_chars"), F.sha2("text", 256).alias("sha"))


@query("s2_text_hashes", "SELECT doc_id, sha256(text) AS sha, substr(sha256(text), 1, 16) AS short FROM documents")
def text_hashes(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.substring(F.sha2("text", 256), 1, 16).alias("short"))


@query("s7_first_pages_text", f"WITH {SQL_LINES} SELECT doc_id, string_agg(text, chr(10) ORDER BY line_index) AS text FROM lines WHERE page <= 2 GROUP BY doc_id")
def first_pages(spark, d):
    lines = text_lines(spark, d).where("page <= 2")
    return lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_index", "text"))).alias("l")).select("doc_id", F.array_join("l.text", "\n").alias("text"))


@query("s9_pages_text", f"WITH {SQL_LINES} SELECT doc_id, page, string_agg(text, chr(10) ORDER BY line_index) AS text FROM lines GROUP BY doc_id, page")
def pages_text(spark, d):
    lines = text_lines(spark, d)
    return lines.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("line_index", "text"))).alias("l")).select("doc_id", "page", F.array_join("l.text", "\n").alias("text"))


@query("s10_page_counts_mode", f"WITH {SQL_LINES} SELECT doc_id, max(page) AS pages, CASE WHEN max(page) > 3 THEN 'rules' ELSE 'llm' END AS mode, 'llm' AS unlimited FROM lines GROUP BY doc_id")
def page_counts_mode(spark, d):
    """A cutoff of three pages, and of none."""
    from lectern.operators.candidates import section_mode

    pages = text_lines(spark, d).groupBy("doc_id").agg(F.max("page").alias("pages")).withColumns({"has_review": F.lit(False), "available": F.lit(True)})
    return pages.select("doc_id", "pages").join(section_mode(pages, 3), "doc_id").join(section_mode(pages, 0).withColumnRenamed("mode", "unlimited"), "doc_id")


@query("s11_insert_new", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def insert_new(spark, d):
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("s12_get_or_create", """WITH old AS (SELECT DISTINCT sha256(text) AS sha FROM documents JOIN labels USING (doc_id)),
n AS (SELECT doc_id, sha256(text) AS sha, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS k FROM documents WHERE sha256(text) NOT IN (SELECT sha FROM old))
SELECT doc_id, sha FROM n WHERE k = 1""")
def get_or_create(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    stored = docs.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    return ops.get_or_create(stored, docs).select("doc_id", "sha")


@query("s14_upsert_latest", """SELECT user_id, event_id, event_type, value FROM (
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1""")
def upsert_latest(spark, d):
    return ops.latest(table(spark, d, "events"), "user_id", by="ts", tie="event_id").select("user_id", "event_id", "event_type", "value")


@query("s15_clear_rejections", "SELECT conv_id, turn, role FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def clear_rejections(spark, d):
    gone = table(spark, d, "labels").where("quality = 0").select(F.col("doc_id").alias("conv_id"))
    return table(spark, d, "conversations").select("conv_id", "turn", "role").join(gone, "conv_id", "left_anti")


_ALERTS = Rows("pa_id:string doc_a:bigint doc_b:bigint status:string", ("p1", 1, 2, "confirmed"), ("p2", 2, 3, "pending"), ("p3", 4, 5, "confirmed"), ("p4", 3, 1, "rejected"))
_LINKS = Rows("cl_id:string pa_id:string", ("c1", "p1"), ("c2", "p3"))


@query("s16_delete_artifacts", f"""WITH {_ALERTS.sql('alerts')}, {_LINKS.sql('links')}, mine AS (SELECT pa_id FROM alerts WHERE doc_a = 1 OR doc_b = 1)
SELECT 'alert' AS kind, pa_id AS id FROM alerts WHERE pa_id NOT IN (SELECT pa_id FROM mine) UNION ALL SELECT 'link', cl_id FROM links WHERE pa_id NOT IN (SELECT pa_id FROM mine)
UNION ALL SELECT 'document', CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id <> 1""")
def delete_artifacts(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    alerts, links, chunks, _ = ops.without_document(1, _ALERTS.frame(spark), _LINKS.frame(spark), docs, docs)
    parts = alerts.select(F.lit("alert").alias("kind"), F.col("pa_id").alias("id")), links.select(F.lit("link"), "cl_id"), chunks.select(F.lit("document"), F.col("doc_id").cast("string"))
    return parts[0].union(parts[1]).union(parts[2])


@query("s17_delete_documents", "SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def delete_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", "source").join(table(spark, d, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_anti")


@query("s18_managed_names", f"""WITH {SQL_BIB} SELECT doc_id, coalesce(nullif(trim(substr(regexp_replace(title, '[^A-Za-z0-9._-]+', '_', 'g'), 1, 80), '._-'), ''), 'document') || '--' || substr(sha, 1, 12) || '.pdf' AS name FROM bib""")
def managed_names(spark, d):
    stem = F.btrim(F.substring(F.regexp_replace("title", "[^A-Za-z0-9._-]+", "_"), 1, 80), F.lit("._-"))
    return bibliography(spark, d).select("doc_id", F.concat(F.coalesce(F.nullif(stem, F.lit("")), F.lit("document")), F.lit("--"), F.substring("sha", 1, 12), F.lit(".pdf")).alias("name"))


@query("s19_vector_upsert", f"""WITH {SQL_VECTORS}, u AS (SELECT *, 0 AS rank FROM vectors UNION ALL SELECT vec_id, doc_id, chunk_index, list_transform(v, lambda x: -x), 1 FROM vectors WHERE chunk_index = 0)
SELECT vec_id, doc_id, round(v[1], 6) AS first FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, chunk_index ORDER BY rank DESC) AS k FROM u) WHERE k = 1""")
def vector_upsert(spark, d):
    base = vectors(spark, d).withColumn("rank", F.lit(0))
    new = base.where("chunk_index = 0").withColumn("v", F.transform("v", lambda x: -x)).withColumn("rank", F.lit(1))
    return ops.latest(base.unionByName(new), "doc_id", "chunk_index", by="rank", tie="vec_id").select("vec_id", "doc_id", F.round(F.col("v")[0], 6).alias("first"))


@query("s22_schema_defaults", "SELECT page_id, url, CAST(NULL AS VARCHAR) AS section_title, 1 AS schema_version FROM pages")
def schema_defaults(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url")
    for name, kind, default in (("section_title", "string", None), ("schema_version", "int", 1), ("url", "string", None)):
        if name not in pages.columns:
            pages = pages.withColumn(name, F.lit(default).cast(kind))
    return pages


@query("p1_point_lookup", f"WITH {SQL_BIB} SELECT doc_id, sha, title, path FROM bib WHERE doc_id IN (SELECT doc_id FROM labels) OR path IN (SELECT 'src' || CAST(item_id % 10 AS VARCHAR) || '/' || CAST(item_id AS VARCHAR) || '.txt' FROM benchmark)")
def point_lookup(spark, d):
    """Many lookups at once, by id and by path: the keys are a table, each kind one semi join."""
    bib = bibliography(spark, d).select("doc_id", "sha", "title", "path")
    item = F.col("item_id")
    paths = table(spark, d, "benchmark").select(F.concat(F.lit("src"), (item % 10).cast("string"), F.lit("/"), item.cast("string"), F.lit(".txt")).alias("path"))
    return bib.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").union(bib.join(paths, "path", "left_semi").select("doc_id", "sha", "title", "path")).distinct()


V1, V2 = versions.legacy_version(), versions.chunker_version()
#: Two versions of chunks: the current one of most documents, and old ones, of half their text, of every third.
_SQL_VERSIONS = f"""{SQL_CHUNKS}, versioned AS (SELECT doc_id, '{V2}' AS version, chunk_index, text FROM chunks WHERE doc_id % 5 <> 0
  UNION ALL SELECT doc_id, '{V1}', chunk_index, substr(text, 1, CAST(length(text) // 2 AS INTEGER)) FROM chunks WHERE doc_id % 3 = 0)"""


def versioned(spark, d):
    """The chunk table with two versions, from one pass over the texts."""
    chunks = chunks_of(spark, d)
    both = F.filter(F.array(F.when(F.col("doc_id") % 5 != 0, F.lit(V2)), F.when(F.col("doc_id") % 3 == 0, F.lit(V1))), lambda x: x.isNotNull())
    text = F.when(F.col("version") == V1, F.left("text", F.floor(F.length("text") / 2).cast("int"))).otherwise(F.col("text"))
    return chunks.withColumn("version", F.explode(both)).select("doc_id", "version", "chunk_index", text.alias("text"))


@query("p2_document_chunks", f"WITH RECURSIVE {_SQL_VERSIONS} SELECT doc_id, version, count(*) AS chunks, sha256(string_agg(text, '|' ORDER BY chunk_index)) AS sha FROM versioned WHERE version = '{V1}' GROUP BY ALL UNION ALL SELECT doc_id, version, count(*), sha256(string_agg(text, '|' ORDER BY chunk_index)) FROM versioned WHERE version = '{V2}' GROUP BY ALL")
def document_chunks(spark, d):
    """Every document's chunks of a version in the order of their index, for two versions."""
    chunks, out = versioned(spark, d), None
    for version in (V1, V2):
        rows = ops.document_chunks(chunks, version).select("doc_id", F.lit(version).alias("version"), F.size("chunks").cast("bigint").alias("chunks"), F.sha2(F.array_join("chunks.text", "|"), 256).alias("sha"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("p3_list_documents", f"WITH {SQL_BIB} SELECT row_number() OVER (ORDER BY {_ORDER}) AS place, doc_id, title FROM bib")
def list_documents(spark, d):
    return ops.numbered(bibliography(spark, d), ops.listing_key(), "place").select("place", "doc_id", "title")


@query("p4_literal_contains", "SELECT item_id, contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '_a%') AS odd, contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'the ') AS has FROM benchmark")
def literal_contains(spark, d):
    return table(spark, d, "benchmark").select("item_id", has_literal(F.col("text"), "_a%").alias("odd"), has_literal(F.col("text"), "THE ").alias("has"))


def _anywhere(term: str) -> str:
    return "(" + " OR ".join(f"contains({_FOLD.format(c)}, '{term}')" for c in ("coalesce(title,'')", "coalesce(authors,'')", "coalesce(doi,'')", "path", "coalesce(CAST(year AS VARCHAR),'')")) + ")"


_NEWEST = f"year DESC NULLS LAST, title IS NULL, {_FOLD.format('title')}, {_FOLD.format('path')}, doc_id"


@query("p5_metadata_search", f"WITH {SQL_BIB} SELECT doc_id, title, year FROM bib WHERE {_anywhere('1000/4')} ORDER BY {_NEWEST} LIMIT 20")
def metadata_search(spark, d):
    return ops.search_metadata(bibliography(spark, d), "1000/4").select("doc_id", "title", "year")


@query("p6_metadata_terms", f"WITH {SQL_BIB} SELECT doc_id, title, year FROM bib WHERE {_anywhere('1999')} OR {_anywhere('supplier#000000003')} ORDER BY {_NEWEST} LIMIT 20")
def metadata_terms(spark, d):
    return ops.search_metadata_terms(bibliography(spark, d), ["1999", "Supplier#000000003"]).select("doc_id", "title", "year")


_C_ORDER = _ORDER.replace("doc_id", "c.doc_id") + ", version, c.chunk_index"


@query("p7_fulltext_search", f"WITH RECURSIVE {_SQL_VERSIONS}, {SQL_BIB} SELECT c.doc_id, c.version, c.chunk_index, b.title FROM versioned c JOIN bib b USING (doc_id) WHERE contains({_FOLD.format('c.text')}, 'licensed') ORDER BY {_C_ORDER} LIMIT 20")
def fulltext_search(spark, d):
    """All versions of chunks."""
    return ops.search_chunks(versioned(spark, d), bibliography(spark, d), "Licensed").select("doc_id", "version", "chunk_index", "title")


@query("p8_any_terms", f"WITH RECURSIVE {_SQL_VERSIONS}, {SQL_BIB} SELECT c.doc_id, c.version, c.chunk_index, b.title FROM versioned c JOIN bib b USING (doc_id) WHERE version = '{V2}' AND (contains({_FOLD.format('c.text')}, 'license') OR contains({_FOLD.format('c.text')}, 'nicht')) ORDER BY {_C_ORDER} LIMIT 100")
def any_terms(spark, d):
    return ops.search_chunks_any(versioned(spark, d), bibliography(spark, d), ["license", "nicht"], version=V2).select("doc_id", "version", "chunk_index", "title")


@query("p13_missing_metadata", f"WITH {SQL_BIB} SELECT doc_id, (doi IS NULL OR trim(doi) = '') AS no_doi, (title IS NULL OR trim(title) = '') AS no_title FROM bib")
def missing_metadata(spark, d):
    return bibliography(spark, d).select("doc_id", missing(F.col("doi")).alias("no_doi"), missing(F.col("title")).alias("no_title"))


@query("p14_skip_rejected", "SELECT d.doc_id, l.doc_id IS NOT NULL AND l.quality = 0 AND d.n_chars % 2 = 0 AS skip FROM documents d LEFT JOIN labels l USING (doc_id)")
def skip_rejected(spark, d):
    """A rejection holds while the content is what it was; here it changed for odd lengths."""
    rejected = table(spark, d, "labels").where("quality = 0").join(table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("seen"), "n_chars"), "doc_id")
    rejected = rejected.select("doc_id", F.when(F.col("n_chars") % 2 == 0, F.col("seen")).otherwise(F.lit("another")).alias("seen"))
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    return docs.join(rejected, "doc_id", "left").select("doc_id", F.coalesce(F.col("seen") == F.col("sha"), F.lit(False)).alias("skip"))


_NUMBERS = Rows("raw:string top:int", ("1, 3,2", 3), ("4,9", 5), ("", 5), ("2,2, 2", 4), (" 7 ", 7), ("x,1", 3))


@query("p16_number_lists", f"""WITH {_NUMBERS.sql('t')} SELECT raw, list_sort(list_distinct(list_filter(list_transform(string_split(raw, ','), lambda x: TRY_CAST(trim(x) AS INTEGER)), lambda x: x BETWEEN 1 AND top))) AS picked FROM t""")
def number_lists(spark, d):
    parsed = F.transform(F.split("raw", ","), lambda x: F.trim(x).try_cast("int"))
    return _NUMBERS.frame(spark).select("raw", F.array_sort(F.array_distinct(F.filter(parsed, lambda x: x.between(F.lit(1), F.col("top"))))).alias("picked"))


@query("j1_chunk_document_join", f"WITH RECURSIVE {SQL_CHUNKS}, {SQL_BIB} SELECT c.doc_id, count(*) AS chunks, min(b.year) AS year FROM chunks c JOIN bib b USING (doc_id) GROUP BY c.doc_id")
def chunk_document_join(spark, d):
    return chunks_of(spark, d).join(bibliography(spark, d), "doc_id").groupBy("doc_id").agg(F.count("*").alias("chunks"), F.min("year").alias("year"))


@query("j8_in_index", f"WITH {SQL_VECTORS} SELECT count(*) AS documents, count(*) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM vectors)) AS missing FROM documents")
def in_index(spark, d):
    docs, stored = table(spark, d, "documents").select("doc_id"), vectors(spark, d).select("doc_id").distinct().withColumn("there", F.lit(True))
    return docs.join(stored, "doc_id", "left").agg(F.count("*").alias("documents"), F.count_if(F.col("there").isNull()).alias("missing"))


@query("j11_document_set", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT item_id FROM benchmark)")
def document_set(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id")), "doc_id", "left_semi")


@query("w1_initial_chunks", f"WITH RECURSIVE {SQL_CHUNKS} SELECT doc_id, chunk_index, k FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) AS k FROM chunks) WHERE k <= 2")
def initial_chunks(spark, d):
    from pyspark.sql import Window

    ranked = chunks_of(spark, d).withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_index")).cast("bigint"))
    return ranked.where("k <= 2").select("doc_id", "chunk_index", "k")
