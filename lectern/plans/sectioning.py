"""Sectioning and chunking queries over the documents' lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import headings as H
from lectern.functions import text as T
from lectern.operators import sections
from lectern.operators.chunking import section_chunks
from lectern.plans.catalog import query
from lectern.sources.fixtures import Rows
from lectern.sources.tables import SQL_LINES, text_lines

_KEY = "regexp_replace(regexp_replace(lower(trim(text)), '\\s+', ' ', 'g'), '[.:]+$', '')"
_MARKED = f"{SQL_LINES}, reviewed AS (SELECT {_KEY} AS key FROM lines GROUP BY 1 HAVING count(DISTINCT doc_id) >= 5), marked AS (SELECT *, {_KEY} IN (SELECT key FROM reviewed) AS heading FROM lines)"
_SPANS = f"""{_MARKED}, numbered AS (SELECT *, sum(CASE WHEN heading THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_index) AS n FROM marked),
spans AS (SELECT doc_id, CAST(nullif(n, 0) - 1 AS INTEGER) AS section_index, min(page) AS page_start, max(page) AS page_end, string_agg(text, chr(10) ORDER BY line_index) AS text, arg_min(text, line_index) AS first FROM numbered GROUP BY doc_id, n)"""


def reviewed(lines):
    """The caller's list of headings: lines that five documents and more share."""
    return lines.select("doc_id", T.section_key(F.col("text")).alias("key")).distinct().groupBy("key").agg(F.count("*").alias("n")).where("n >= 5").select("key")


def section_spans_of(spark, d):
    lines = text_lines(spark, d)
    return sections.spans(sections.marked(lines, reviewed(lines)))


@query("c4_section_spans", f"WITH {_SPANS} SELECT doc_id, section_index, page_start, page_end, sha256(text) AS sha FROM spans")
def section_spans(spark, d):
    return section_spans_of(spark, d).select("doc_id", "section_index", "page_start", "page_end", F.sha2("text", 256).alias("sha"))


_CUTS = f"""WITH RECURSIVE {_SPANS}, pos AS (SELECT doc_id, section_index, i, w, sum(length(w) + 1) OVER (PARTITION BY doc_id, section_index ORDER BY i) - 1 AS e FROM (
  SELECT doc_id, section_index, unnest(ws) AS w, unnest(range(0, len(ws))) AS i FROM (SELECT doc_id, section_index, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS ws FROM spans))),
folded AS (SELECT doc_id, section_index, list(w ORDER BY i) AS ws, list(e ORDER BY i) AS ends FROM pos GROUP BY doc_id, section_index),
cuts AS (SELECT doc_id, section_index, ws, ends, CAST(0 AS BIGINT) AS s, greatest(CAST(1 AS BIGINT), len(list_filter(ends, lambda x: x <= 2000))) AS t FROM folded
  UNION ALL SELECT doc_id, section_index, ws, ends, t, greatest(t + 1, len(list_filter(ends, lambda x: x <= ends[t] + 1 + 2000))) FROM cuts WHERE t < len(ws))
SELECT doc_id, section_index, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(section_index, -1), s) - 1 AS INTEGER) AS chunk_index, sha256(array_to_string(ws[s+1:t], ' ')) AS sha FROM cuts"""


@query("c8_section_chunks", _CUTS)
def chunks_of_sections(spark, d):
    spans = section_spans_of(spark, d).select("doc_id", "section_index", F.col("title").alias("section_title"), "lines")
    return section_chunks(spans).select("doc_id", "section_index", "chunk_index", F.sha2("text", 256).alias("sha"))


@query("a2_distinct_sections", f"WITH {_SPANS} SELECT doc_id, count(DISTINCT section_index) AS sections FROM spans WHERE section_index IS NOT NULL GROUP BY doc_id")
def distinct_sections(spark, d):
    return section_spans_of(spark, d).where("section_index is not null").groupBy("doc_id").agg(F.countDistinct("section_index").alias("sections"))


@query("w2_line_context", f"WITH {SQL_LINES} SELECT doc_id, line_index, coalesce(list(text) OVER (PARTITION BY doc_id ORDER BY line_index ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), []) AS before, coalesce(list(text) OVER (PARTITION BY doc_id ORDER BY line_index ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), []) AS after FROM lines")
def line_context(spark, d):
    return sections.context(text_lines(spark, d))


_LIT = Rows("id:int line:string", (1, "3.1 LLM Setup"), (2, "II. THE MODEL"), (3, "Abstract"), (4, "A. Time evolution"), (5, "Figure 3 shows"), (6, "12"), (7, "Ada Byron1, Bo Li2 and others"), (8, "School of Maps"), (9, "Results:"), (10, "IV Something"), (11, "plain prose goes here"), (12, ""), (13, "1. Introduction"), (14, "Beijing University, China"))


@query("f15_heading_parse", f"""WITH {_LIT.sql('t')} SELECT id, coalesce(nullif(rtrim(regexp_extract(line, '^([0-9]+(?:[.][0-9]+)*[.]?)[ ]+(.+)$', 1), '.'), ''), nullif(regexp_extract(line, '^([IVXLCDM]+)[.]?[ ]+(.+)$', 1), ''), nullif(regexp_extract(line, '^([A-Z])[.][ ]+(.+)$', 1), '')) AS number,
coalesce(nullif(regexp_extract(line, '^([0-9]+(?:[.][0-9]+)*[.]?)[ ]+(.+)$', 2), ''), nullif(regexp_extract(line, '^([IVXLCDM]+)[.]?[ ]+(.+)$', 2), ''), nullif(regexp_extract(line, '^([A-Z])[.][ ]+(.+)$', 2), ''), nullif(line, '')) AS title FROM t""")
def heading_parse(spark, d):
    return _LIT.frame(spark).select("id", T.parsed_heading(F.col("line")).alias("h")).select("id", "h.number", "h.title")


_SQL_NUMBERED = "regexp_matches(line, '^(?:[IVXLCDM]+[.]?\\s+[A-Z][A-Za-z0-9 ,;:/()&-]+$|[0-9]+(?:[.][0-9]+)*[.]?\\s+[A-Z][A-Za-z0-9 ,;:/()&-]+$|[A-Z][.]\\s+[A-Z][A-Za-z0-9 ,;:/()&''-]+$)')"


@query("f11_numbered_headings", f"WITH {_LIT.sql('t')} SELECT id, {_SQL_NUMBERED} AS numbered FROM t")
def numbered_headings(spark, d):
    return _LIT.frame(spark).select("id", H.is_numbered_heading(F.col("line")).alias("numbered"))


_JUNK = Rows(
    "id:int line:string bad:boolean",
    (0, "DOI 10.1/x", True), (1, "https://a.org", True), (2, "http://b.org", True), (3, "www.site.org", True), (4, "Citation: X", True), (5, "Editor: Y", True),
    (6, "Data Availability Statement", True), (7, "Funding", True), (8, "Competing interests", True), (9, "Significance", True), (10, "Author affiliations: Z", True), (11, "Author contributions: W", True),
    (12, "3 a and b)", True), (13, "1. a. thing", True), (14, "A. B. Name", True), (15, "A. Theor Biol", True), (16, "Copyright X", True), (17, "and personal use is also permitted", True),
    (18, "republication/redistribution requires IEEE permission", True), (19, "see http://www.ieee.org", True), (20, "© 2020", True), (21, "Received 3 May", True), (22, "Accepted 4 May", True), (23, "Published online", True),
    (24, "The authors declare", True), (25, "To whom correspondence", True), (26, "This article", True), (27, "PNAS 2005", True), (28, "3 of 12", True), (29, "17", True),
    (30, "82534 VOLUME 7, 2019", True), (31, "Volume 7, 2019 82534", True), (32, "X. Dong et al.: Title", True), (33, "F. Fu: Title", True), (34, "Figure 3", True), (35, "Fig. 4", True),
    (36, "Table 2", True), (37, "Physical Review E", True), (38, "Journal of Maps", True), (39, "Proceedings of the", True), (40, "Volume 3", True), (41, "School of Maps", True),
    (42, "Department of Y", True), (43, "University of Z", True), (44, "Institute of Q", True), (45, "College of R", True), (46, "Faculty of S", True), (47, "Center for T", True),
    (48, "Centre for U", True), (49, "PACS numbers", True), (50, "(Received 3 May)", True), (51, "(Revised 4 May)", True), (52, "(Accepted)", True), (53, "NIH Public Access", True),
    (54, "Author Manuscript", True), (55, "NIH-PA Author Manuscript", True), (56, "PMC 2010", True), (57, "Available in PMC", True), (58, "Published in final edited form as:", True), (59, "as:", True),
    (60, "Corresponding author", True), (61, "email: a@b", True), (62, "E-mail: a@b", True), (63, "Tel: 1", True), (64, "Fax: 2", True), (65, "* note", True),
    (66, "† note", True), (67, "‡ note", True), (68, "1 Program for X", True), (69, "2 Laboratory of Y", True), (70, "(Ministry of Education)", True), (71, "Canada K1A 0B1", True),
    (72, "USA", True), (73, "", True), (100, "Introduction", False), (101, "3.1 Data", False), (102, "Results and Discussion", False), (103, "A Department store", False),
    (104, "Figures", False), (105, "Tables of numbers", False), (106, "The Journal", False), (107, "Receiving", False), (108, "USA today", False), (109, "A. Time evolution", False),
    (110, "No results", False),
)


@query("f8_bad_headings", f"WITH {_JUNK.sql('t')} SELECT id, bad FROM t")
def bad_headings(spark, d):
    """A line for each kind of thing that isn't a heading, and some that are."""
    return _JUNK.frame(spark).select("id", H.is_bad_heading(F.col("line")).alias("bad"))


@query("f9_author_lines", f"WITH {_LIT.sql('t')} SELECT id, (regexp_matches(line, '\\b[A-Z][A-Za-z.-]+[0-9,*]') AND (contains(line, ',') OR contains(line, ' and '))) OR len(list_intersect(regexp_extract_all(lower(line), '[a-z]+'), ['beijing', 'university', 'china', 'school'])) >= 2 AS author_line FROM t")
def author_lines(spark, d):
    return _LIT.frame(spark).select("id", H.is_author_line(F.col("line")).alias("author_line"))


@query("c5_decided_spans", f"""WITH {SQL_LINES}, cand AS (SELECT doc_id, line_index FROM lines WHERE length(text) % 7 = 0), m AS (SELECT l.*, c.doc_id IS NOT NULL AND length(l.text) % 2 = 0 AS heading FROM lines l LEFT JOIN cand c USING (doc_id, line_index)),
n AS (SELECT *, sum(CASE WHEN heading THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_index) AS n FROM m) SELECT doc_id, CAST(nullif(n, 0) - 1 AS INTEGER) AS section_index, count(*) AS lines FROM n GROUP BY doc_id, n""")
def decided_spans(spark, d):
    """Decisions on candidate lines: first all are accepted, then, later in order, those of odd length are not."""
    lines = text_lines(spark, d)
    candidates = lines.where(F.length("text") % 7 == 0).select(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("line_index").cast("string")).alias("candidate_id"), "doc_id", "line_index", F.length("text").alias("n"))
    decisions = candidates.select("candidate_id", F.lit(True).alias("accepted"), F.lit(0).alias("seq")).unionByName(candidates.select("candidate_id", (F.col("n") % 2 == 0).alias("accepted"), F.lit(1).alias("seq")))
    return sections.spans(sections.decided(lines, candidates, decisions)).select("doc_id", "section_index", F.size("lines").cast("bigint").alias("lines"))


@query("w6_first_of_lines", f"WITH {SQL_LINES} SELECT doc_id, line_index FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(text) ORDER BY line_index) AS k FROM lines) WHERE k = 1")
def first_of_lines(spark, d):
    """Keep-first dedupe by lower case, in line order."""
    return text_lines(spark, d).groupBy("doc_id", F.lower("text").alias("k")).agg(F.min("line_index").alias("line_index")).select("doc_id", "line_index")


@query("f4_section_keys", f"WITH {SQL_LINES} SELECT doc_id, line_index, {_KEY} AS key FROM lines")
def section_keys(spark, d):
    return text_lines(spark, d).select("doc_id", "line_index", T.section_key(F.col("text")).alias("key"))


@query("c12_screening_sections")
def screening_sections(spark, d):
    """Sequential dedupe by title or text, then the five best; a fold, tested against a loop."""
    return sections.screening(section_spans_of(spark, d))


@query("c12_screening_excerpts")
def screening_excerpts(spark, d):
    """Their texts within a budget of 2,500 tokens; tested against a loop."""
    return sections.screening_excerpts(section_spans_of(spark, d), context=2500).select("doc_id", "section_index", "shown", F.length("text").alias("chars"), "was_cut")


_SECTIONS = Rows("id:int idx:int number:string title:string", (1, 0, None, "Abstract"), (2, None, None, None), (3, 4, "3.1", " "), (4, 5, None, "Funding"), (5, 6, None, "Discussion and Conclusion"), (6, 7, None, "Overview"), (7, 2, None, None))


@query("f46_section_titles", f"WITH {_SECTIONS.sql('t')} SELECT id, coalesce(nullif(trim(title), ''), 'Section ' || number, CASE WHEN idx IS NULL THEN 'front matter' ELSE 'section ' || CAST(idx + 1 AS VARCHAR) END) AS shown, CAST(CASE WHEN lower(title) IN ('abstract', 'summary') THEN 0 WHEN lower(title) IN ('overview', 'introduction') THEN 1 WHEN regexp_matches(lower(coalesce(title, '')), '\\b(conclusions?|discussion|future work)\\b') THEN 2 WHEN idx IS NULL THEN 4 ELSE 3 END AS INTEGER) AS priority FROM t")
def section_titles(spark, d):
    return _SECTIONS.frame(spark).select("id", sections.display_title(F.col("title"), F.col("number"), F.col("idx")).alias("shown"), sections.priority(F.col("title"), F.col("idx")).alias("priority"))
