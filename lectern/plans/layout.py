"""Layout queries on word and line boxes. The driver tables have none; boxes are made from their numbers and words."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import layout as L
from lectern.plans.catalog import query
from lectern.sources.fixtures import Rows
from lectern.sources.tables import SQL_LINES, table, text_lines

#: Boxes of two columns: a page eight orders, a box an item; the left or right half by the line number.
_SQL_BOXES = """boxes AS (SELECT l_orderkey AS doc_id, CAST(l_orderkey // 8 AS INTEGER) AS page, 600.0 AS width, 900.0 AS height, CASE WHEN l_linenumber % 2 = 0 THEN 50.0 ELSE 320.0 END + l_quantity / 10 AS x0,
  CASE WHEN l_linenumber % 2 = 0 THEN 270.0 ELSE 550.0 END + l_quantity / 5 AS x1, CAST(l_linenumber * 20 + l_orderkey % 8 * 100 AS DOUBLE) AS y0, l_partkey AS id, p_name AS name FROM lineitem JOIN part ON p_partkey = l_partkey)"""


def boxes(spark, d):
    """Boxes of one document each eight pages; ``page`` tells them apart."""
    left = F.col("l_linenumber") % 2 == 0
    item = table(spark, d, "lineitem").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    y0 = (F.col("l_linenumber") * 20 + F.col("l_orderkey") % 8 * 100).cast("double")
    return item.select(
        F.lit(1).cast("long").alias("doc_id"), F.floor(F.col("l_orderkey") / 8).cast("int").alias("page"), F.lit(600.0).alias("width"), F.lit(900.0).alias("height"), (F.when(left, 50.0).otherwise(320.0) + F.col("l_quantity") / 10).alias("x0"),
        (F.when(left, 270.0).otherwise(550.0) + F.col("l_quantity") / 5).alias("x1"), y0.alias("y0"), (y0 + 10).alias("y1"), F.col("l_partkey").alias("id"), F.col("p_name").alias("name"),
    )


@query("g3_gutters", f"""WITH {_SQL_BOXES}, k AS (SELECT * FROM boxes WHERE y0 + 10 >= 72 AND y0 <= 846 AND x1 - x0 <= 372),
g AS (SELECT page, count(*) AS n, count(*) FILTER (WHERE x0 < 192) AS nl, count(*) FILTER (WHERE x0 > 270) AS nr, count(*) FILTER (WHERE x0 < 192 AND x1 - x0 >= 150) AS long,
 quantile_cont(x1, 0.75) FILTER (WHERE x0 < 192) AS a, quantile_cont(x1, 0.75) FILTER (WHERE x0 < 192 AND x1 - x0 >= 150) AS c, quantile_cont(x0, 0.25) FILTER (WHERE x0 > 270) AS b FROM k GROUP BY page),
m AS (SELECT *, CASE WHEN long >= 3 THEN c ELSE a END AS e FROM g)
SELECT page, round((e + b) / 2, 6) AS gutter FROM m WHERE n >= 12 AND nl >= 4 AND nr >= 4 AND b - e >= 9 AND (e + b) / 2 BETWEEN 210 AND 390""")
def gutters(spark, d):
    return L.line_gutters(boxes(spark, d)).select("page", F.round("gutter", 6).alias("gutter"))


@query("g1_margin_filter", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (NOT (l_quantity * 12 + 5 > 72 AND l_quantity * 12 + 5 < 528) AND 10 <= 21 AND (l_tax * 1000 >= 18 OR l_tax * 1000 >= 36))")
def margin_filter(spark, d):
    """Boxes 10 points wide, placed by quantity, as tall as the tax says."""
    x0 = F.col("l_quantity") * 12
    return table(spark, d, "lineitem").where(~L.is_margin_artifact(x0, F.lit(0.0), x0 + 10, F.col("l_tax") * 1000, F.lit(600.0), F.lit(900.0))).select("l_orderkey", "l_linenumber")


#: Words three to a box of a line item; pages that 5 divides have no gutter.
_SQL_WORDS = f"""{_SQL_BOXES}, words AS (SELECT page, CAST(y0 AS INTEGER) AS row, k, id, CASE WHEN page % 5 <> 0 THEN 280.0 + page % 3 * 25 END AS gutter,
  x0 + k * (40 + id % 7 * 12) AS x0, x0 + k * (40 + id % 7 * 12) + 30 + id % 3 * 8 AS x1 FROM boxes, (VALUES (0), (1), (2)) AS t(k))"""


def words_of_boxes(spark, d):
    """Three words a box, on rows of their own height; wide steps let rows cross the gutter."""
    step = 40 + F.col("id") % 7 * 12
    three = boxes(spark, d).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    start = F.col("x0") + F.col("k") * step
    gutter = F.when(F.col("page") % 5 != 0, 280.0 + F.col("page") % 3 * 25)
    return three.select("doc_id", "page", F.col("y0").cast("int").alias("row"), "k", "id", gutter.alias("gutter"), start.alias("x0"), (start + 30 + F.col("id") % 3 * 8).alias("x1"))


@query("g5_columns", f"""WITH {_SQL_WORDS}, s AS (SELECT *, (x0 + x1) / 2 < gutter AS is_left FROM words),
a AS (SELECT *, count(*) FILTER (WHERE is_left) OVER w AS nl, count(*) FILTER (WHERE NOT is_left) OVER w AS nr, min(x0) FILTER (WHERE NOT is_left) OVER w - max(x1) FILTER (WHERE is_left) OVER w AS gap, min(x0) OVER w AS first FROM s WINDOW w AS (PARTITION BY page, row))
SELECT page, row, id, k, CASE WHEN gutter IS NULL THEN 'single' WHEN nr > 0 AND nl = 0 THEN 'right' WHEN nr = 0 AND first >= gutter - 45 THEN 'right' WHEN nr = 0 THEN 'left'
 WHEN gap > 8 AND is_left THEN 'left' WHEN gap > 8 THEN 'right' WHEN nl >= 3 AND nr <= 2 THEN 'left' WHEN nr >= 3 AND nl <= 2 THEN 'right' ELSE 'full' END AS "column" FROM a""")
def columns(spark, d):
    return L.split_rows(words_of_boxes(spark, d)).select("page", "row", "id", "k", "column")


@query("g6_built_lines", rf"""WITH {_SQL_WORDS}, l AS (SELECT page, row, round(min(x0), 6) AS x0, round(max(x1), 6) AS x1, string_agg(p_name, ' ' ORDER BY x0, p_name) AS joined, count(DISTINCT id % 2) AS sources, min(CASE WHEN id % 2 = 1 THEN 'odd ( raw ) line , it is' END) AS raw FROM words JOIN part ON p_partkey = id GROUP BY page, row)
SELECT page, row, x0, x1, trim(regexp_replace(CASE WHEN sources = 1 AND raw IS NOT NULL THEN 'odd (raw) line, it is' ELSE joined END, '\s+', ' ', 'g')) AS text FROM l""")
def built_lines(spark, d):
    """Words whose item is odd come from a source line with raw text; a row of those alone takes it."""
    named = words_of_boxes(spark, d).join(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text")), "id")
    odd = F.col("id") % 2
    full = named.withColumns({"column": F.lit("single"), "y0": F.lit(0.0), "y1": F.lit(10.0), "height": F.lit(900.0), "block": odd, "line": odd, "word": F.lit(0), "source_text": F.when(odd == 1, F.lit("odd ( raw ) line , it is"))})
    return L.built_lines(full).select("page", "row", F.round("x0", 6).alias("x0"), F.round("x1", 6).alias("x1"), "text")


_OPENS = r"(low = 'abstract' OR starts_with(low, 'abstract ') OR regexp_matches(low, '^([0-9]+(\.[0-9]+)*|[ivxlcdm]+)\.?\s+introduction'))"


@query("g8_reading_order", f"""WITH {_SQL_BOXES}, c AS (SELECT page, id, x0, y0, y0 + 5 AS mid, page % 4 <> 0 AS two, CASE WHEN id % 11 = 0 THEN 'full' WHEN id % 13 = 0 THEN 'note' WHEN x0 < 200 THEN 'left' ELSE 'right' END AS col,
  trim(lower(CASE WHEN id % 17 = 0 THEN 'Abstract' WHEN id % 19 = 0 THEN '1. Introduction' ELSE name END), ' .:') AS low FROM boxes),
z AS (SELECT *, min(CASE WHEN col IN ('left', 'right') THEN mid END) OVER (PARTITION BY page) AS top, min(CASE WHEN {_OPENS} THEN mid END) OVER (PARTITION BY page) AS anchor, bool_or(col <> 'note') OVER (PARTITION BY page) AS sided FROM c),
o AS (SELECT *, CASE WHEN NOT two OR NOT sided THEN 5 WHEN col = 'full' AND mid < coalesce(top, 1e9) THEN 0 WHEN col = 'full' THEN 4 WHEN mid < anchor THEN 1 WHEN col = 'left' THEN 2 WHEN col = 'right' THEN 3 ELSE 5 END AS zone FROM z)
SELECT page, id, row_number() OVER (PARTITION BY page ORDER BY zone, CASE WHEN zone = 1 THEN round_even(y0 / 2, 0) * 2 ELSE y0 END, x0, y0, id) AS place FROM o""")
def reading_order(spark, d):
    """Boxes on every fourth page in one column; some are abstracts or introductions, some stand beside the columns."""
    column = F.when(F.col("id") % 11 == 0, "full").when(F.col("id") % 13 == 0, "note").when(F.col("x0") < 200, "left").otherwise("right")
    text = F.when(F.col("id") % 17 == 0, "Abstract").when(F.col("id") % 19 == 0, "1. Introduction").otherwise(F.col("name"))
    lines = boxes(spark, d).withColumns({"column": column, "text": text, "gutter": F.when(F.col("page") % 4 != 0, 300.0)})
    return L.reading_order(lines, tie="id").select("page", "id", F.col("place").cast("bigint").alias("place"))


_NOTICES = Rows("id:int text:string", (1, "NIH Public Access"), (2, "Methods of the study"), (3, "© 2020 A Society"), (4, "Intelligence (www.aaai.org). All rights reserved."), (5, " "), (6, "The copyright holder"), (7, "DOI: 10.1/2"), (8, "PACS numbers: 1.2"), (9, "* ada@example.org"),
    (10, "Copyright is held by the author/owner(s)."), (11, "(c) 1999 X"), (12, "Fu et al. Page 3"), (13, "a DOI: in a sentence"), (14, "copyright © 2009 Y"), (15, "ACM 978-1-60558-325-9/09/07."), (16, "Author manuscript, more"))
_SQL_NOTICE = r"""(trim(text) = '' OR regexp_matches(text, '(?i)^(NIH Public Access|Author Manuscript|NIH-PA|NIH-PA Author Manuscript|Published in final edited form as:)$') OR regexp_matches(text, '(?i)^(DOI\s*:|PACS\s+numbers?\s*:|PACS\s+(number|numbers|no\.?|nos\.?)\b|fu et al\. page [0-9]+$|[*†‡].*@|[0-9]{4}-[0-9]{4}/[0-9]{4}/)')
 OR regexp_matches(text, '(?i)^(copyright is held by the author/owner\(s\)\.|intelligence \(www\.aaai\.org\)\. all rights reserved\.|acm [0-9]+(-[0-9]+)+/[0-9]+/[0-9]+\.)$') OR regexp_matches(text, '(?i)^(©|\(c\)|copyright|copyright\s*©)\s*[0-9]{4}\b'))"""


@query("g9_boilerplate", f"WITH {_NOTICES.sql('t')} SELECT id FROM t WHERE NOT {_SQL_NOTICE}")
def boilerplate(spark, d):
    return _NOTICES.frame(spark).where(~L.is_boilerplate(F.col("text"))).select("id")


@query("g9_document_lines", f"WITH {SQL_LINES} SELECT doc_id, line_index, {_SQL_NOTICE.replace('text', 'trim(text)')} AS boilerplate FROM lines")
def boilerplate_of_documents(spark, d):
    return text_lines(spark, d).select("doc_id", "line_index", L.is_boilerplate(F.trim("text")).alias("boilerplate"))


@query("f34_repetition_keys", f"WITH {SQL_LINES} SELECT doc_id, line_index, trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '[0-9]+', '#', 'g'), '[^a-z#]+', ' ', 'g'), '\\s+', ' ', 'g')) AS key FROM lines")
def repetition_keys(spark, d):
    return text_lines(spark, d).select("doc_id", "line_index", T.repetition_key(F.col("text")).alias("key"))


_SQL_KEY = "trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '[0-9]+', '#', 'g'), '[^a-z#]+', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("g11_margin_lines", f"""WITH {SQL_LINES}, e AS (SELECT *, line_index % 20 * 15.0 + 5 <= 32 OR line_index % 20 * 15.0 + 5 >= 288 AS margin, {_SQL_KEY} AS key FROM lines),
r AS (SELECT doc_id, key FROM e WHERE margin AND length(key) >= 3 GROUP BY ALL HAVING count(DISTINCT page) >= 2) SELECT e.doc_id, e.line_index FROM e WHERE NOT (margin AND ((doc_id, key) IN (SELECT (doc_id, key) FROM r) OR regexp_matches(lower(trim(text)), '^(page\\s+)?[0-9]+$')))""")
def margin_lines(spark, d):
    """Twenty lines a page of 320 points; the first two and the last lie in the margins."""
    y = F.col("line_index") % 20 * 15.0
    lines = text_lines(spark, d).withColumns({"y0": y, "y1": y + 10, "height": F.lit(320.0)})
    return L.without_margin_lines(lines).select("doc_id", "line_index")


_PAIRS = Rows("id:int a:string b:string", (1, "a reposi-", "tory of texts"), (2, "a self-", "made map"), (3, "ends here", "and on"), (4, "Anglo-", "Saxon"), (5, "x-", "ray"), (6, "multi-", "part"), (7, "non-", "sense"))


@query("f35_hyphen_pairs", f"WITH {_PAIRS.sql('t')} SELECT id, CASE WHEN regexp_matches(a, '[A-Za-z]{{2}}-$') AND regexp_matches(b, '^[a-z]') THEN CASE WHEN lower(regexp_extract(a, '([A-Za-z]+)-$', 1)) IN ('self', 'multi') THEN a ELSE regexp_replace(a, '-$', '') END || b END AS joined FROM t")
def hyphen_pairs(spark, d):
    return _PAIRS.frame(spark).select("id", L.joined_pair(F.col("a"), F.col("b")).alias("joined"))


_GLYPHS = Rows("id:int text:string", (1, "the ﬁnal ﬂow oﬀ"), (2, "a\u00a0b"), (3, "x , y ."), (4, "plain"), (5, None), (6, "see \x03 1 \x04 and \x01 b \x02"), (7, " ( a ) [ b ] "), (8, "eﬃcient waﬄe"), (9, "laﬅ ﬆop"))
_SQL_NORMAL = """trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(translate({0}, chr(1) || chr(2) || chr(3) || chr(4) || chr(160), '()[] '),
 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬅ', 'st'), 'ﬆ', 'st'), '\\s+', ' ', 'g'), '([(\\[]) ', '\\1', 'g'), ' ([)\\],.;:])', '\\1', 'g'))"""


@query("f33_normal_text", f"WITH {_GLYPHS.sql('t')} SELECT id, {_SQL_NORMAL.format('text')} AS text FROM t")
def normal_text(spark, d):
    return _GLYPHS.frame(spark).select("id", T.normal_text(F.col("text")).alias("text"))


@query("f33_document_lines", f"WITH {SQL_LINES} SELECT doc_id, line_index, {_SQL_NORMAL.format('text')} AS text FROM lines")
def normal_lines(spark, d):
    return text_lines(spark, d).select("doc_id", "line_index", T.normal_text(F.col("text")).alias("text"))


@query("g7_merged_fragments", f"""WITH {_SQL_BOXES}, f AS (SELECT page, x0 - 40 * (id % 3) AS x0, x0 - 40 * (id % 3) + 25 AS x1, y0 + id % 9 AS y0, y0 + id % 9 + 10 AS y1, CASE WHEN id % 5 = 0 THEN 'left' ELSE 'single' END AS col, CAST(id AS VARCHAR) AS text FROM boxes),
l AS (SELECT *, lag(x1) OVER w AS px1, lag(y0) OVER w AS py0, lag(y1) OVER w AS py1, lag(col) OVER w AS pcol FROM f WINDOW w AS (PARTITION BY page ORDER BY (y0 + y1) / 2, x0, x1, text))
SELECT page, count(*) FILTER (WHERE NOT coalesce(col = pcol AND x0 - px1 BETWEEN 0 AND 80 AND abs((y0 + y1) / 2 - (py0 + py1) / 2) <= greatest(2.0, 0.55 * (py1 - py0)), false)) AS lines FROM l GROUP BY page""")
def merged_fragments(spark, d):
    shift, down = 40 * (F.col("id") % 3), F.col("id") % 9
    column = F.when(F.col("id") % 5 == 0, "left").otherwise("single")
    parts = boxes(spark, d).select("doc_id", "page", column.alias("column"), (F.col("x0") - shift).alias("x0"), (F.col("x0") - shift + 25).alias("x1"), (F.col("y0") + down).alias("y0"), (F.col("y0") + down + 10).alias("y1"), F.col("id").cast("string").alias("text"))
    return L.merged_fragments(parts).groupBy("page").agg(F.count("*").alias("lines"))


def words_of_pages(spark, d):
    """Pages of word boxes laid out from the documents' words: 160 a page, four a row, twenty rows a column; a page number on top, a running foot.

    A page is an array of its words from the start: they are next to each other in their document.
    """
    nothing = F.lit(None).cast("int")

    def box(x0, y0, text):
        corners = [x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), (x0 + 50).cast("double").alias("x1"), (y0 + 10).cast("double").alias("y1")]
        return F.struct(*corners, text.alias("text"), F.lit(600.0).alias("width"), F.lit(360.0).alias("height"), nothing.alias("block"), nothing.alias("line"), nothing.alias("word"), F.lit(None).cast("string").alias("source_text"))

    def placed(text, i):
        return box(40 + F.floor(i / 80) % 2 * 280 + i % 4 * 60, 50 + F.floor(i / 4) % 20 * 14, text)

    docs = table(spark, d, "documents").select("doc_id", "lang", F.split("text", r"\s+").alias("ws"))
    starts = F.sequence(F.lit(0), F.floor((F.size("ws") - 1) / 160).cast("int"))
    pages = docs.select("doc_id", "lang", F.posexplode(F.transform(starts, lambda p: F.slice("ws", p * 160 + 1, 160))).alias("at", "ws"))
    page = (F.col("at") + 1).cast("int")
    body = F.filter(F.transform("ws", placed), lambda x: x["text"] != "")
    marks = [(40, 5, F.lit("Page")), (100, 5, page.cast("string")), (40, 340, F.lit("Running")), (100, 340, F.lit("foot")), (160, 340, F.col("lang"))]
    return pages.where(F.exists("ws", lambda t: t != "")).select("doc_id", page.alias("page"), F.concat(body, F.array(*[box(F.lit(x), F.lit(y), text) for x, y, text in marks])).alias("w"))


#: The same pages without coordinates: of which rows they consist, and what becomes of them.
_SQL_PAGES = f"""w AS (SELECT doc_id, lang, unnest(ws) AS t, unnest(range(0, len(ws))) AS i FROM (SELECT doc_id, lang, string_split_regex(text, '\\s+') AS ws FROM documents)),
b AS (SELECT doc_id, lang, CAST(i // 160 + 1 AS INTEGER) AS page, i // 80 % 2 AS col, i // 4 % 20 AS row, i % 4 AS k4, t FROM w WHERE t <> ''),
p AS (SELECT doc_id, page, any_value(lang) AS lang, count(*) + 5 AS n, count(DISTINCT CASE WHEN col = 1 THEN row END) AS both_rows, count(DISTINCT row) AS n_rows FROM b GROUP BY ALL),
g AS (SELECT *, n >= 30 AND both_rows >= greatest(4, CASE WHEN n - 5 >= 24 THEN n_rows ELSE n_rows + 2 END // 10) AS two FROM p),
l AS (SELECT doc_id, page, two, row, side AS col, string_agg(t, ' ' ORDER BY bcol, k4) AS raw FROM (SELECT b.doc_id, b.page, two, row, CASE WHEN two THEN b.col ELSE 0 END AS side, b.col AS bcol, k4, t FROM b JOIN g ON b.doc_id = g.doc_id AND b.page = g.page) GROUP BY ALL
   UNION ALL SELECT doc_id, page, two, -1, 0, 'Page ' || page FROM g UNION ALL SELECT doc_id, page, two, 99, 0, 'Running foot ' || lang FROM g),
m AS (SELECT doc_id, page, two, row, col, {_SQL_NORMAL.format('raw')} AS text FROM l), f AS (SELECT *, trim(lower(text), ' .:') AS low FROM m WHERE text <> ''),
a AS (SELECT *, min(CASE WHEN {_OPENS} THEN row END) OVER (PARTITION BY doc_id, page) AS anchor FROM f),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY CASE WHEN two AND row < anchor THEN 0 ELSE col + 1 END, row, col) AS place, count(*) FILTER (WHERE row = 99) OVER (PARTITION BY doc_id) AS feet FROM a)"""


@query("g12_page_lines", f"""WITH {_SQL_PAGES} SELECT doc_id, page, CAST(place AS INTEGER) AS place, CASE WHEN NOT two THEN 'single' WHEN col = 0 THEN 'left' ELSE 'right' END AS "column", text FROM o
WHERE row <> -1 AND NOT (row = 99 AND feet >= 2) AND NOT {_SQL_NOTICE}""")
def page_lines(spark, d):
    """All geometry steps, on pages of one and two columns, page by page."""
    return L.pages_to_lines(words_of_pages(spark, d))
