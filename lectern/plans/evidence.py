"""Evidence, prompts and highlighting queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import evidence as ev
from lectern.operators import reports
from lectern.plans.catalog import query
from lectern.plans.storage import chunks_of
from lectern.sources.fixtures import Rows
from lectern.sources.tables import SQL_BIB, SQL_CHUNKS, bibliography, table

_SQ = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
_FOCUS = f"""u AS (SELECT conv_id, turn, {_SQ.format('text')} AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations WHERE role = 'user'),
l AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM u WHERE back <= 6), f AS (SELECT conv_id, string_agg('Turn ' || CAST(k AS VARCHAR) || ' user focus: ' || text, chr(10) ORDER BY k) AS summary FROM l GROUP BY conv_id)"""


@query("w8_recent_focus", f"WITH {_FOCUS} SELECT conv_id, summary FROM f")
def recent_focus(spark, d):
    return ev.recent_focus(table(spark, d, "conversations").where("role = 'user'"))


@query("e1_retrieval_queries", f"WITH {_FOCUS} SELECT l.conv_id, CASE WHEN f.summary IS NULL OR l.conv_id % 3 = 0 THEN l.text ELSE 'Recent conversation focus:' || chr(10) || trim(f.summary) || chr(10) || chr(10) || 'Current user question or refinement:' || chr(10) || l.text END AS query FROM l JOIN f USING (conv_id) WHERE back = 1")
def retrieval_queries(spark, d):
    """The last user turn asked again with its conversation's focus; every third conversation has no history."""
    turns = table(spark, d, "conversations").where("role = 'user'")
    last = turns.groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))
    summary = F.when(F.col("conv_id") % 3 != 0, F.col("summary"))
    return last.join(ev.recent_focus(turns), "conv_id").select("conv_id", ev.retrieval_query(summary, F.col("text")).alias("query"))


_HITS = f"""{SQL_CHUNKS}, {SQL_BIB}, hits AS (SELECT row_number() OVER (ORDER BY c.chunk_index DESC, c.doc_id) AS place, c.doc_id, b.path, b.title, CASE WHEN c.doc_id % 3 > 0 THEN b.authors END AS authors, b.year,
 c.chunk_index + 1 AS page_start, CASE WHEN c.chunk_index % 2 = 0 THEN c.chunk_index + 2 END AS page_end, c.text FROM chunks c JOIN bib b USING (doc_id) WHERE contains(lower(c.text), 'thing') ORDER BY place LIMIT 50),
pk AS (SELECT place, doc_id, path, CASE WHEN authors IS NOT NULL THEN authors || ' ' || CAST(year AS VARCHAR) ELSE regexp_extract(path, '[^/]+$') END AS label,
 CASE WHEN page_end IS NULL THEN 'p. ' || CAST(page_start AS VARCHAR) ELSE 'pp. ' || CAST(page_start AS VARCHAR) || '–' || CAST(page_end AS VARCHAR) END AS pages, page_start, page_end,
 CASE WHEN length({_SQ.format('text')}) > 1500 THEN rtrim(left({_SQ.format('text')}, 1500)) || ' [...]' ELSE {_SQ.format('text')} END AS excerpt FROM hits)"""


def _packets(spark, d):
    """Chunks with the word are hits, later chunks first, fifty at most, as many as a question asks for; every third document has no authors."""
    first = chunks_of(spark, d).where(F.lower("text").contains("thing")).join(bibliography(spark, d), "doc_id")
    found = first.orderBy(F.desc("chunk_index"), "doc_id").limit(50)
    place = F.row_number().over(Window.orderBy(F.desc("chunk_index"), "doc_id"))
    hits = found.select(place.alias("place"), "doc_id", "path", "title", F.when(F.col("doc_id") % 3 > 0, F.col("authors")).alias("authors"), "year", (F.col("chunk_index") + 1).alias("page_start"), F.when(F.col("chunk_index") % 2 == 0, F.col("chunk_index") + 2).alias("page_end"), "text")
    return ev.packets(hits)


@query("e2_evidence_packets", f"WITH RECURSIVE {_HITS} SELECT place, doc_id, label, label || ', ' || pages AS citation, excerpt FROM pk")
def evidence_packets(spark, d):
    return _packets(spark, d).select(F.col("place").cast("bigint").alias("place"), "doc_id", "label", "citation", "excerpt")


@query("e3_evidence_sources", f"""WITH RECURSIVE {_HITS}, r AS (SELECT path, pages, min(place) AS place, count(*) AS n, arg_min(label, place) AS label FROM pk GROUP BY path, pages)
SELECT row_number() OVER (ORDER BY min(place)) AS source_number, arg_min(label, place) AS label, arg_min(label, place) || ', ' || string_agg(pages, '; ' ORDER BY place) AS citation, array_to_string(list_transform(range(0, count(*)), lambda i: chr(CAST(97 + i AS INTEGER))), '') AS passages, CAST(sum(n) AS BIGINT) AS packets FROM r GROUP BY path""")
def evidence_sources(spark, d):
    found = ev.sources(_packets(spark, d))
    return found.select(F.col("source_number").cast("bigint").alias("source_number"), "label", "citation", F.array_join("passages", "").alias("passages"), "packets")


@query("e4_prompt_evidence")
def prompt_evidence(spark, d):
    """The rendered length is that of indented JSON; tested against json.dumps."""
    return ev.within_budget(_packets(spark, d)).select("place", "doc_id", "rendered")


@query("j13_evidence_documents", f"WITH RECURSIVE {_HITS} SELECT place, p.doc_id, title FROM pk p LEFT JOIN (SELECT doc_id, title FROM bib WHERE doc_id % 2 = 0) USING (doc_id)")
def evidence_documents(spark, d):
    known = bibliography(spark, d).where("doc_id % 2 = 0").select("doc_id", "title")
    return _packets(spark, d).select(F.col("place").cast("bigint").alias("place"), "doc_id").join(known, "doc_id", "left")


@query("f19_query_terms", r"""SELECT item_id, list_filter(list_transform(t, lambda x: trim(lower(x), '_''-')), lambda x: length(x) >= 2 AND NOT list_contains(['a','an','and','are','as','at','be','by','for','from','how','in','into','is','it','of','on','or','that','the','their','this','to','use','using','with'], x)) AS terms
FROM (SELECT item_id, regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9_''-]*') AS t FROM benchmark)""")
def query_terms(spark, d):
    """Terms in order, repeats kept here so that SQL's lists compare; the search takes them distinct."""
    raw = F.regexp_extract_all("text", F.lit(r"([A-Za-z0-9][A-Za-z0-9_'-]*)"), 1)
    bare = F.filter(F.transform(raw, lambda t: F.lower(F.btrim(t, F.lit("_'-")))), lambda t: (F.length(t) >= 2) & ~t.isin(*T.GLUE))
    return table(spark, d, "benchmark").select("item_id", bare.alias("terms"))


@query("f19_distinct_terms", r"""SELECT item_id, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9_''-]*'), lambda x: trim(lower(x), '_''-')), lambda x: length(x) >= 2 AND NOT list_contains(['a','an','and','are','as','at','be','by','for','from','how','in','into','is','it','of','on','or','that','the','their','this','to','use','using','with'], x)))) AS terms FROM benchmark""")
def distinct_terms(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_sort(T.query_terms(F.col("text"))).alias("terms"))


@query("f20_metadata_texts", f"WITH {SQL_BIB} SELECT doc_id, lower(concat_ws(' ', title, authors, year, doi, path)) AS text FROM bib")
def metadata_texts(spark, d):
    from lectern.operators.search import metadata_text

    return bibliography(spark, d).select("doc_id", F.lower(metadata_text()).alias("text"))


@query("f36_hashes", f"SELECT doc_id, sha256(lower({_SQ.format('text')})) AS normal, substr(sha256(text), 1, 16) AS short FROM documents")
def hashes(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(F.lower(T.squeezed(F.col("text"))), 256).alias("normal"), F.substring(F.sha2("text", 256), 1, 16).alias("short"))


_BARS = Rows("id:int value:int most:int", (1, 0, 10), (2, 1, 1000), (3, 5, 10), (4, 10, 10), (5, 7, 16), (6, 3, 0))


@query("f38_bars", f"WITH {_BARS.sql('t')}, e AS (SELECT *, CAST(CASE WHEN value > 0 AND most > 0 THEN greatest(1, round_even(value / most * 64.0, 0)) ELSE 0 END AS INTEGER) AS e FROM t) SELECT id, repeat('█', e // 8) || ['', '▏', '▎', '▍', '▌', '▋', '▊', '▉'][e % 8 + 1] AS bar FROM e")
def bars(spark, d):
    return _BARS.frame(spark).select("id", F.when(F.col("most") > 0, reports.bar(F.col("value"), F.nullif(F.col("most"), F.lit(0)), 8)).otherwise("").alias("bar"))


@query("f40_context_windows", f"""WITH t AS (SELECT doc_id, {_SQ.format('text')} AS t FROM documents), p AS (SELECT *, strpos(lower(t), 'license') AS hit FROM t), s AS (SELECT *, greatest(0, least(CASE WHEN hit > 0 THEN hit - 1 + 3 ELSE 120 END - 120, length(t) - 240)) AS s FROM p)
SELECT doc_id, CASE WHEN length(t) <= 240 THEN t ELSE CASE WHEN s > 0 THEN '[...] ' ELSE '' END || trim(substr(t, s + 1, 240)) || CASE WHEN s + 240 < length(t) THEN ' [...]' ELSE '' END END AS shown FROM s""")
def context_windows(spark, d):
    return table(spark, d, "documents").select("doc_id", ev.context_window(F.col("text"), "license").alias("shown"))


@query("f42_source_labels", f"WITH {SQL_BIB} SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN authors || ' ' || CAST(year AS VARCHAR) ELSE CAST(doc_id AS VARCHAR) || '.pdf' END AS label FROM bib")
def source_labels(spark, d):
    path = F.concat(F.lit("store/"), F.col("doc_id").cast("string"), F.lit("--"), F.substring("sha", 1, 12), F.lit(".pdf"))
    return bibliography(spark, d).select("doc_id", ev.source_label(F.when(F.col("doc_id") % 2 == 0, F.col("authors")), F.col("year"), path, F.col("title")).alias("label"))


@query("f43_passage_letters", "SELECT i, CASE WHEN i < 26 THEN chr(CAST(97 + i AS INTEGER)) ELSE chr(CAST(97 + i // 26 - 1 AS INTEGER)) || chr(CAST(97 + i % 26 AS INTEGER)) END AS letter FROM range(0, 60) t(i)")
def passage_letters(spark, d):
    return spark.range(60).select(F.col("id").alias("i"), ev.passage_letter(F.col("id")).alias("letter"))


@query("f45_token_estimates", "SELECT doc_id, CAST(CASE WHEN length(text) > 0 THEN greatest(1, ceil(length(text) / 4)) ELSE 0 END AS BIGINT) AS tokens FROM documents")
def token_estimates(spark, d):
    return table(spark, d, "documents").select("doc_id", ev.estimated_tokens(F.col("text")).alias("tokens"))


_ROOM = max(1000, 1000 - len(ev.OMITTED.strip()) - 4)


@query("f45_fitted_sections", f"WITH t AS (SELECT doc_id, {_SQ.format('text')} AS t FROM documents) SELECT doc_id, CASE WHEN length(t) <= 1000 THEN t ELSE rtrim(left(t, {_ROOM - _ROOM // 3})) || chr(10) || chr(10) || '[... omitted ...]' || chr(10) || chr(10) || ltrim(right(t, {_ROOM // 3})) END AS fitted FROM t")
def fitted_sections(spark, d):
    return table(spark, d, "documents").select("doc_id", ev.fitted(F.col("text"), 250).alias("fitted"))


@query("f48_trimmed", f"SELECT doc_id, CASE WHEN length({_SQ.format('text')}) > 300 THEN rtrim(left({_SQ.format('text')}, 300)) || ' [...]' ELSE {_SQ.format('text')} END AS shown FROM documents")
def trimmed(spark, d):
    return table(spark, d, "documents").select("doc_id", T.trimmed(T.squeezed(F.col("text")), 300).alias("shown"))


@query("f50_semantic_windows", f"""WITH w AS (SELECT doc_id, list_filter(string_split(({_SQ.format('text')}), ' '), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, ws, unnest(range(0, len(ws), 35)) AS s FROM w) SELECT doc_id, CAST(s AS INTEGER) AS start, sha256(array_to_string(ws[s+1:s+70], ' ')) AS sha FROM s WHERE s = 0 OR (len(ws) - s >= 12 AND s + 35 < len(ws))""")
def semantic_windows(spark, d):
    words = table(spark, d, "documents").select("doc_id", ev.window_words(F.col("text")).alias("words"))
    windows = words.select("doc_id", F.posexplode(ev.semantic_windows(F.col("words"))).alias("i", "w"))
    return windows.select("doc_id", (F.col("i") * 35).cast("int").alias("start"), F.sha2("w", 256).alias("sha"))


@query("f52_highlight_tiers", """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT v FROM v WHERE vec_id = 3), c AS (SELECT vec_id, round(list_sum(list_transform(list_zip(v.v, q.v), lambda p: p[1] * p[2])) / (sqrt(list_sum(list_transform(v.v, lambda x: x * x))) * sqrt(list_sum(list_transform(q.v, lambda x: x * x)))), 6) AS cosine FROM v, q),
n AS (SELECT count(*) AS n, least(18, greatest(5, ceil(count(*) * 0.18))) AS k FROM c), r AS (SELECT vec_id, cosine, row_number() OVER (ORDER BY cosine DESC, vec_id) AS rank FROM c)
SELECT vec_id, CASE WHEN rank <= greatest(1, ceil(k * 0.15)) THEN 'red' WHEN rank <= greatest(1, ceil(k * 0.15)) + ceil(k * 0.30) THEN 'yellow' ELSE 'bold' END AS tier FROM r, n WHERE rank <= k AND cosine >= 0.12""")
def highlight_tiers(spark, d):
    """The best few by cosine to the query: red, yellow, bold; the rank window only sees the top 18."""
    from lectern.operators.vectors import cosine
    from lectern.plans.retrieval import asked_vector
    from lectern.sources.tables import vectors

    v = vectors(spark, d)
    n = v.count()
    k = min(18, max(5, -(-n * 18 // 100)))
    red = max(1, -(-k * 15 // 100))
    yellow = -(-k * 30 // 100)
    q = F.array(*[F.lit(x) for x in asked_vector(spark, d)])
    top = v.select("vec_id", cosine(F.col("v"), q).alias("cosine")).orderBy(F.desc("cosine"), "vec_id").limit(k)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("cosine"), "vec_id"))).where("cosine >= 0.12")
    return ranked.select("vec_id", F.when(F.col("rank") <= red, "red").when(F.col("rank") <= red + yellow, "yellow").otherwise("bold").alias("tier"))


@query("f59_embedding_texts", f"WITH RECURSIVE {SQL_CHUNKS}, {SQL_BIB} SELECT c.doc_id, c.chunk_index, sha256('Title: ' || title || chr(10) || 'Authors: ' || authors || chr(10) || 'Year: ' || CAST(year AS VARCHAR) || chr(10) || chr(10) || text) AS sha FROM chunks c JOIN bib USING (doc_id)")
def embedding_texts(spark, d):
    joined = chunks_of(spark, d).join(bibliography(spark, d), "doc_id")
    return joined.select("doc_id", "chunk_index", F.sha2(ev.embedding_text(F.col("title"), F.col("authors"), F.col("year"), F.lit(None), F.col("text")), 256).alias("sha"))


_COLLECTIONS = Rows("id:int raw:string", (1, "mini lm;v=2..x"), (2, "--a--"), (3, "plain_name"), (4, "..."))


@query("f60_collection_names", f"WITH {_COLLECTIONS.sql('t')}, c AS (SELECT id, trim(regexp_replace(regexp_replace(raw, '[^A-Za-z0-9._-]+', '-', 'g'), '[.]{{2,}}', '.', 'g'), '._-') AS n FROM t) SELECT id, CASE WHEN length(n) >= 3 THEN n ELSE n || '-index' END AS name FROM c")
def collection_names(spark, d):
    return _COLLECTIONS.frame(spark).select("id", ev.collection_name(F.col("raw")).alias("name"))


