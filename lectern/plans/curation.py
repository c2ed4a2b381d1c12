"""Curation queries: listings, names, prompts, relabelled evidence, payloads of models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import listing as N
from lectern.functions.text import doi_key
from lectern.operators import duplicates
from lectern.operators import evidence as ev
from lectern.operators import prompts as P
from lectern.operators import storage as ops
from lectern.plans.catalog import query
from lectern.plans.statistics import _KEYED, _dismissed
from lectern.plans.storage import _ORDER
from lectern.sources.fixtures import Rows
from lectern.sources.tables import SQL_BIB, bibliography, table

_TAGS = f"""{SQL_BIB}, t AS (SELECT doc_id, title, path, lower(split_part(authors, ' and ', 1)) || year AS tag, authors, year FROM bib),
n AS (SELECT *, count(*) OVER (PARTITION BY tag) AS many, row_number() OVER (PARTITION BY tag ORDER BY {_ORDER}) - 1 AS k FROM t),
tagged AS (SELECT *, CASE WHEN many = 1 THEN tag ELSE tag || CASE WHEN k >= 26 THEN chr(CAST(k // 26 + 96 AS INTEGER)) ELSE '' END || chr(CAST(k % 26 + 97 AS INTEGER)) END AS label FROM n)"""


def tagged(bib):
    """Documents with ``label``: surname and year, with letters where several have the same, in the order of the listing."""
    tag = F.concat(F.lower(N.tag_name(F.col("authors"), F.col("title"), F.col("path"))), F.coalesce(F.col("year").cast("string"), F.lit("n.d.")))
    w = Window.partitionBy("tag")
    counted = bib.withColumn("tag", tag).withColumns({"many": F.count("*").over(w), "k": F.row_number().over(w.orderBy(*ops.listing_order())) - 1})
    return counted.withColumn("label", F.when(F.col("many") == 1, F.col("tag")).otherwise(F.concat("tag", N.letters(F.col("k"))))).drop("tag", "many", "k")


@query("w5_tag_letters", f"WITH {_TAGS} SELECT doc_id, label FROM tagged")
def tag_letters(spark, d):
    return tagged(bibliography(spark, d)).select("doc_id", "label")


@query("t5_label_order", f"WITH {_TAGS} SELECT row_number() OVER (ORDER BY lower(label), doc_id) AS place, doc_id, label FROM tagged")
def label_order(spark, d):
    """The listing by label, without case, then by id."""
    rows = tagged(bibliography(spark, d))
    return ops.numbered(rows, [F.lower("label"), F.col("doc_id")], "place").select("place", "doc_id", "label")


@query("t7_top_authors", f"WITH {SQL_BIB}, n AS (SELECT unnest(string_split(authors, ' and ')) AS s FROM bib) SELECT lower(s) AS surname, count(*) AS n FROM n GROUP BY lower(s) ORDER BY n DESC, surname LIMIT 10")
def top_authors(spark, d):
    return P.top_authors(bibliography(spark, d), 10)


@query("t8_duplicate_order", f"WITH {_KEYED}, p AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, min(priority) AS priority FROM keyed a JOIN keyed b USING (priority, key) WHERE a.doc_id < b.doc_id GROUP BY ALL), r AS (SELECT reason, doc_a, doc_b FROM p JOIN names USING (priority) WHERE NOT (doc_a % 6 = 0 AND doc_b = doc_a + 1)) SELECT row_number() OVER (ORDER BY reason, lower(split_part(bib.path, '/', -1)), doc_a, doc_b) AS place, reason, doc_a, doc_b FROM r JOIN bib ON bib.doc_id = doc_a")
def duplicate_order(spark, d):
    """Candidates by reason, file name without case, and ids."""
    bib = bibliography(spark, d)
    rows = duplicates.candidates(bib, _dismissed(spark, d)).join(bib.select(F.col("doc_id").alias("doc_a"), "path"), "doc_a")
    return ops.numbered(rows, [F.col("reason"), F.lower(F.element_at(F.split("path", "/"), -1)), F.col("doc_a"), F.col("doc_b")], "place").select("place", "reason", "doc_a", "doc_b")


@query("j9_same_doi", f"WITH {SQL_BIB}, o AS (SELECT *, row_number() OVER (ORDER BY {_ORDER}) AS place FROM bib) SELECT a.doc_id, arg_min(b.doc_id, b.place) AS other FROM o a JOIN o b ON lower(a.doi) = lower(b.doi) AND a.doc_id <> b.doc_id GROUP BY a.doc_id")
def same_doi(spark, d):
    """Of the other documents with the same DOI the first in the listing."""
    order = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(ops.listing_key())])
    keys = bibliography(spark, d).select("doc_id", doi_key(F.col("doi")).alias("key"), order.alias("place")).where("key is not null")
    two = keys.groupBy("key").agg(F.min(F.struct("place", "doc_id")).alias("first"), F.count("*").alias("n")).where("n > 1")
    second = keys.join(two.select("key", F.col("first.doc_id").alias("f")), "key")
    runner = second.where("doc_id <> f").groupBy("key").agg(F.min(F.struct("place", "doc_id")).alias("next"))
    return second.join(runner, "key").select("doc_id", F.when(F.col("doc_id") == F.col("f"), F.col("next.doc_id")).otherwise(F.col("f")).alias("other"))


_NAMES = Rows("id:int authors:string title:string first:string moved:string", (1, "Ada Byron and Bo Li", "The Theory of Games", "Byron, Ada, Bo Li", "Theory of Games, The"), (2, None, "A map", "unknown author", "map, A"), (3, "Plato", "Theory", "Plato", "Theory"), (4, "Jan van der Berg; Cy Do", "an Essay", "van der Berg, Jan, Cy Do", "Essay, an"))


@query("f44_listing_labels", f"WITH {_NAMES.sql('t')} SELECT id, first AS authors, moved AS title FROM t")
def listing_labels(spark, d):
    return _NAMES.frame(spark).select("id", N.surname_first(F.col("authors")).alias("authors"), N.title_for_listing(F.col("title")).alias("title"))


@query("f61_title_case", """WITH l AS (SELECT doc_id, i AS line_index, t AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents) WHERE trim(t) <> ''),
w AS (SELECT *, regexp_extract_all(text, '[A-Za-z][A-Za-z-]*') AS ws, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS caps, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS letters FROM l)
SELECT doc_id, CAST(line_index AS INTEGER) AS line_index, coalesce(len(ws) > 0 AND (len(list_filter(ws, lambda x: regexp_matches(x, '^[A-Z]'))) / len(ws) >= 0.5 OR caps / letters > 0.65), false) AS title_case FROM w""")
def title_case(spark, d):
    from lectern.sources.tables import text_lines

    return text_lines(spark, d).select("doc_id", "line_index", N.has_title_case(F.col("text")).alias("title_case"))


_LISTS = Rows("id:int raw:string names:string file:string", (1, "['Ada Byron', 'Bo Li']", "Ada Byron|Bo Li", "Byron1999.pdf"), (2, "Ada Byron; Bo Li", "Ada Byron|Bo Li", "Byron1999.pdf"), (3, "Ada Byron and Bo Li", "Ada Byron|Bo Li", "Byron1999.pdf"), (4, "Davis, James", "Davis, James", "Davis1999.pdf"), (5, "Ada Byron, Bo Li, Cy Do", "Ada Byron|Bo Li|Cy Do", "Byron1999.pdf"), (6, " ", "", None), (7, None, "", None), (8, "O'Neil", "O'Neil", "ONeil1999.pdf"))


@query("f62_author_lists", f"WITH {_LISTS.sql('t')} SELECT id, names, file FROM t")
def author_lists(spark, d):
    return _LISTS.frame(spark).select("id", F.array_join(N.author_list(F.col("raw")), "|").alias("names"), N.short_filename(F.col("raw"), F.lit(1999)).alias("file"))


_PAYLOADS = Rows(
    "id:int payload:string title:string authors:string year:int doi:string confidence:string", (1, '{"title": " A  Study ", "authors": "Ada Byron", "year": "1999", "doi": "10.1000/x1", "confidence": "high"}', "A Study", "Ada Byron", 1999, "10.1000/x1", "high"),
    (2, '{"title": "untitled", "authors": "unknown", "year": 12, "doi": "see page", "confidence": "sure"}', None, None, None, None, "low"), (3, "no json", None, None, None, None, "low"), (4, '{"title": null, "year": "about 1990"}', None, None, None, None, "low"),
)


@query("f32_sanitized_payloads", f"WITH {_PAYLOADS.sql('t')} SELECT id, title, authors, year, doi, confidence FROM t")
def sanitized_payloads(spark, d):
    return _PAYLOADS.frame(spark).select("id", N.sanitized(F.col("payload")).alias("p")).select("id", "p.title", "p.authors", "p.year", "p.doi", "p.confidence")


_PICKS = Rows("id:int text:string action:string source:int passage:int", (1, "1", "open", 0, 0), (2, " 2C ", "open", 1, 2), (3, "edit 1", "edit", 0, 0), (4, "e3", "edit", 2, 0), (5, "d 2", "details", 1, 0), (6, "details 9", None, None, None), (7, "0", None, None, None), (8, "x", None, None, None), (9, "1ab", "open", 0, 27), (10, "edit", None, None, None), (11, "1-2", None, None, None))


@query("e7_source_selection", f"WITH {_PICKS.sql('t')} SELECT id, action, source, passage FROM t")
def source_selection(spark, d):
    return _PICKS.frame(spark).select("id", N.selection(F.col("text"), F.lit(3)).alias("s")).select("id", "s.action", "s.source", "s.passage")


@query("e7_relabelled_evidence", f"""WITH {SQL_BIB}, p AS (SELECT doc_id, path, authors || ' ' || year AS label, CASE WHEN doc_id % 4 > 0 THEN 'p. ' || doc_id END AS pages FROM bib),
e AS (SELECT doc_id, 'Revised Ada' AS authors, 2001 AS year FROM bib WHERE doc_id % 3 = 0)
SELECT p.doc_id, CASE WHEN e.doc_id IS NULL THEN label ELSE 'Revised Ada 2001' END AS label, CASE WHEN e.doc_id IS NULL THEN label ELSE 'Revised Ada 2001' END || coalesce(', ' || pages, '') AS citation FROM p LEFT JOIN e USING (doc_id)""")
def relabelled_evidence(spark, d):
    """Evidence of edited documents takes their new labels; the rest stays."""
    bib = bibliography(spark, d)
    page = F.when(F.col("doc_id") % 4 > 0, F.col("doc_id").cast("int"))
    packets = bib.select("doc_id", "path", ev.source_label(F.col("authors"), F.col("year"), F.col("path"), F.col("title")).alias("label"), page.alias("page_start"), page.alias("page_end"))
    packets = packets.withColumn("citation", ev.citation(F.col("label"), F.col("page_start"), F.col("page_end")))
    edits = bib.where("doc_id % 3 = 0").select("doc_id", "path", "title", F.lit("Revised Ada").alias("authors"), F.lit(2001).alias("year"))
    return P.relabelled(packets, edits).select("doc_id", "label", "citation")


@query("e5_prompts", f"""WITH {SQL_BIB} SELECT doc_id, {P.sql_inquiry("'Recent focus on ' || title", "title", "'[]'")} AS inquiry, {P.sql_summary("'## ' || title || chr(10) || authors", 2)} AS summary,
{P.sql_relevance("title", "path", "'Methods'", "'p. ' || year", "authors")} AS relevance, {P.sql_answer("title", "authors")} AS answer, {P.sql_excerpt("title", "authors", 8, 120)} AS excerpt FROM bib""")
def prompts(spark, d):
    """The five prompts, each from columns of a record."""
    title, authors = F.col("title"), F.col("authors")
    return bibliography(spark, d).select(
        "doc_id", P.inquiry(F.concat(F.lit("Recent focus on "), title), title, F.lit("[]")).alias("inquiry"), P.summary(F.concat(F.lit("## "), title, F.lit("\n"), authors), 2).alias("summary"),
        P.relevance(title, F.col("path"), F.lit("Methods"), F.concat(F.lit("p. "), F.col("year").cast("string")), authors).alias("relevance"), P.answer(title, authors).alias("answer"), P.excerpt(title, authors, 8, 120).alias("excerpt"),
    )


_GREP = "contains(lower(concat_ws(' ', title, authors, year, doi, path)), 'customer#000000001')"


@query("p9_grep", f"""WITH {SQL_BIB}, h AS (SELECT b.doc_id, {_GREP} AS in_metadata, regexp_matches(d.text, '(?i)licensed under') AS in_text, title, path FROM bib b JOIN documents d USING (doc_id))
SELECT doc_id, in_metadata, in_text FROM h WHERE in_metadata OR in_text ORDER BY {_ORDER} LIMIT 40""")
def grep(spark, d):
    """Documents whose metadata or text a pattern of one or the other kind matches, in the order of the listing."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return P.grep(bibliography(spark, d), docs, "customer#000000001|licensed under", 40)


_BAD = Rows("id:int pattern:string error:boolean", (1, "a+b", False), (2, "(", True), (3, "[a-", True), (4, "", False))


@query("p9_pattern_errors", f"WITH {_BAD.sql('t')} SELECT id, error FROM t")
def pattern_errors(spark, d):
    """Patterns that can't be compiled are reported, not run."""
    return spark.createDataFrame([(r[0], P.pattern_error(spark, r[1]) is not None) for r in _BAD.rows], "id int, error boolean")
