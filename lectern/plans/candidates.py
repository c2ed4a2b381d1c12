"""Heading candidates: document lines, every third one of which is a messy heading from a list with known answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import candidates as C
from lectern.operators import candidates as K
from lectern.operators import sections
from lectern.plans.catalog import query
from lectern.sources.fixtures import Rows
from lectern.sources.tables import SQL_LINES, text_lines

#: Lines and what the rules make of them: embedded headings; the cleaned start; level of that; numbered candidate; noise; reads like a heading; strict heading.
_KNOWN = Rows(
    "n:int line:string embedded:array<string> clean:string level:int numbered:boolean noise:boolean reads:boolean strict:boolean",
    (0, "1 Introduction", ["1 Introduction"], "1 Introduction", 1, True, False, True, True),
    (1, "regularly. To determine whether 6 Related Work", ["6 Related Work"], "regularly. To determine whether 6 Related Work", 0, False, False, False, False),
    (2, "II. MODEL increased only provided that", ["II MODEL"], "II MODEL", 1, True, False, True, True),
    (3, "A. Time evolutionManuscript We first study", [], "A. Time", 3, True, False, True, True),
    (4, "shown in Figure 3 Results", ["Results"], "shown in Figure 3 Results", 0, False, False, False, False),
    (5, "82534 VOLUME 7, 2019", [], "82534 VOLUME 7, 2019", 1, False, True, False, False),
    (6, "0.2 Llama3", [], "0.2 Llama3", 2, True, True, False, True),
    (7, "5. Doebeli M, Hauert C. Ecol Lett 2005;8:748.", [], "5 Doebeli M, Hauert C. Ecol Lett 2005;8:748.", 1, True, True, True, False),
    (8, "References", ["References"], "References", 0, False, False, True, True),
    (9, "Acknowledgments. We thank the crew", [], "Acknowledgments. We thank the crew", 0, False, False, False, False),
    (10, "3.1 Data and how it was gathered", ["3.1 Data"], "3.1 Data", 2, True, False, True, True),
    (11, "finite Discussion", ["Discussion"], "finite Discussion", 0, False, False, False, False),
    (12, "12", [], "12", 0, False, True, False, False),
    (13, "IV. Results and DiscussionAuthor", ["IV Results"], "IV Results", 1, True, False, True, True),
    (14, "B. Effects of the temptation to defect and the degree", [], "B. Effects of the", 3, True, False, True, True),
    (15, "Model", [], "Model", 0, False, False, False, True),
    (16, "2.0 Background", ["2.0 Background"], "2.0 Background", 2, True, False, False, True),
    (17, "60 Results", ["60 Results", "Results"], "60 Results", 1, True, False, False, True),
)
_N = len(_KNOWN.rows)
_SQL = f"{SQL_LINES}, {_KNOWN.sql('known')}, headed AS (SELECT doc_id, line_index, page, k.* FROM lines JOIN known k ON k.n = (doc_id + line_index // 3) % {_N} WHERE line_index % 3 = 1)"


def headed_lines(spark, d):
    """All lines of the documents; of every three the second is one of the known ones."""
    lines = text_lines(spark, d)
    which = (F.col("doc_id") + F.floor(F.col("line_index") / 3)) % _N
    names = F.array(*[F.lit(r[1]) for r in _KNOWN.rows])
    return lines.withColumn("text", F.when(F.col("line_index") % 3 == 1, F.get(names, which.cast("int"))).otherwise(F.col("text")))


def known_lines(spark, d):
    return headed_lines(spark, d).where(F.col("line_index") % 3 == 1)


@query("f13_embedded_headings", f"WITH {_SQL} SELECT doc_id, line_index, array_to_string(embedded, ';') AS embedded FROM headed")
def embedded(spark, d):
    return known_lines(spark, d).select("doc_id", "line_index", F.array_join(C.embedded_headings(F.col("text")), ";").alias("embedded"))


@query("f16_clean_prefixes", f"WITH {_SQL} SELECT doc_id, line_index, clean, level FROM headed")
def clean_prefixes(spark, d):
    return known_lines(spark, d).select("doc_id", "line_index", C.clean_prefix(F.col("text")).alias("clean")).withColumn("level", C.level(F.col("clean")))


@query("f12_numbered_candidates", f"WITH {_SQL} SELECT doc_id, line_index, numbered, numbered OR len(embedded) > 0 OR starts_with(lower(line), 'acknowledgments') OR starts_with(lower(line), 'references') AS candidate FROM headed")
def numbered_candidates(spark, d):
    return known_lines(spark, d).select("doc_id", "line_index", C.is_numbered_candidate(F.col("text")).alias("numbered"), C.is_candidate(F.col("text")).alias("candidate"))


@query("f17_noise", f"WITH {_SQL} SELECT doc_id, line_index, noise FROM headed")
def noise(spark, d):
    line = F.col("text")
    return known_lines(spark, d).select("doc_id", "line_index", (C.is_running_head(line) | C.is_chart_debris(line, line) | C.is_reference_candidate(C.clean_prefix(line), line)).alias("noise"))


@query("f18_heading_like", f"WITH {_SQL} SELECT doc_id, line_index, reads FROM headed")
def heading_like(spark, d):
    return known_lines(spark, d).select("doc_id", "line_index", C.reads_like_heading(C.clean_prefix(F.col("text"))).alias("reads"))


_ARTIFACTS = Rows("n:int line:string out:string", (1, "II. The ModelManuscript", "II. The Model"), (2, "A. Time evolutionManuscript We first", "A. Time evolution We first"), (3, "IV. DiscussionAuthor", "IV. Discussion"), (4, "Results NIH-PA Author", "Results"), (5, "An Author writes", "An Author writes"), (6, "  spaced   out ", "spaced out"), (7, "Manuscript", ""))


@query("f10_unglued", f"WITH {_ARTIFACTS.sql('t')} SELECT n, out AS text FROM t")
def unglued(spark, d):
    return _ARTIFACTS.frame(spark).select("n", C.unglued(F.col("line")).alias("text"))


_STARTS = Rows("n:int line:string prefix:string lettered:string", (1, "ACKNOWLEDGMENTS. We thank", "ACKNOWLEDGMENTS", None), (2, "Abstract the dynamics", "Abstract", None), (3, "results vary", None, None), (4, "Data, Materials, and Software Availability: see", "Data, Materials, and Software Availability", None), (5, "B. Materials and methods of old", None, "B. Materials and methods"), (6, "C. Effect of Memory size on it", None, "C. Effect of Memory"), (7, "Materialsandmethods", None, None), (8, "Discussion and Conclusion", "Discussion and Conclusion", None))


@query("f14_heading_prefixes", f"WITH {_STARTS.sql('t')} SELECT n, prefix, lettered FROM t")
def heading_prefixes(spark, d):
    return _STARTS.frame(spark).select("n", C.common_prefix(F.col("line")).alias("prefix"), C.lettered_heading(F.col("line")).alias("lettered"))


def candidates_of(spark, d, max_page=None):
    """Of whole documents, unless a last page is given."""
    return K.with_context(known_lines(spark, d), max_page)


@query("c2_candidates", f"""WITH {_SQL}, e AS (SELECT doc_id, line_index, page, line, unnest(CASE WHEN line LIKE 'A. %' THEN ['A. Time'] WHEN line LIKE 'B. %' THEN ['B. Effects of the'] WHEN len(embedded) > 0 THEN embedded
  WHEN n IN (9, 15) THEN [split_part(line, '.', 1)] WHEN numbered THEN [NULL] ELSE [] END) AS text, n FROM headed)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_index, k) - 1 AS INTEGER) AS candidate_id, line_index, text AS candidate_text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line_index) AS k FROM e)""")
def all_candidates(spark, d):
    """Candidates among the known lines of all documents."""
    return candidates_of(spark, d).select("doc_id", "candidate_id", "line_index", "candidate_text")


def kept_candidates(spark, d):
    return K.filtered(candidates_of(spark, d, max_page=8))


_SQL_KEPT = f"""{_SQL}, e AS (SELECT doc_id, line_index, page, line, noise, n, unnest(CASE WHEN line LIKE 'A. %' THEN ['A. Time'] WHEN line LIKE 'B. %' THEN ['B. Effects of the'] WHEN len(embedded) > 0 THEN embedded WHEN n IN (9, 15) THEN [split_part(line, '.', 1)] WHEN numbered THEN [clean] ELSE [] END) AS heading FROM headed WHERE page <= 8),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(heading) ORDER BY line_index) AS k FROM e WHERE NOT noise AND heading NOT IN ('Model', '2.0 Background', '60 Results')) WHERE k = 1)"""


@query("c3_filtered_candidates", f"WITH {_SQL_KEPT} SELECT doc_id, line_index, heading FROM kept")
def filtered_candidates(spark, d):
    return kept_candidates(spark, d).select("doc_id", "line_index", "heading")


@query("a16_candidates_grouped", f"""WITH {_SQL}, g AS (SELECT doc_id, page, lower(clean) AS key, list(line_index ORDER BY line_index) AS ids FROM headed GROUP BY ALL)
SELECT doc_id, page, ids[1] AS first, array_to_string(ids[2:], ',') AS also_ids, key FROM g""")
def candidates_grouped(spark, d):
    """Known lines as candidates, by their line number; equal texts of a page are one."""
    lines = known_lines(spark, d).select("doc_id", F.col("line_index").alias("candidate_id"), "page", F.col("text").alias("line_text"), C.clean_prefix(F.col("text")).alias("heading"), F.array().cast("array<string>").alias("before"), F.array().cast("array<string>").alias("after"))
    return K.grouped(lines).select("doc_id", "page", F.col("candidate_id").alias("first"), F.array_join(F.col("also_ids").cast("array<string>"), ",").alias("also_ids"), F.lower("heading").alias("key"))


_ANSWERS = Rows(
    "doc_id:bigint seq:int answer:string",
    (1, 0, '```json\n{"section_headings": [{"candidate_id": 0, "section_number": "1", "section_title": "Introduction", "confidence": "high"}, {"candidate_id": "2", "section_title": " Results "}]}\n```'),
    (1, 1, 'Here you are: {"section_headings": [{"candidate_id": 2, "section_title": "Again"}, {"candidate_id": 99, "section_title": "Unknown"}, {"candidate_id": 3, "section_title": "Unsure", "confidence": "LOW"}]} Good luck!'),
    (2, 0, '[{"candidate_ids": [1, 5], "section_title": "Methods", "section_number": ""}, {"candidate_id": 3, "section_title": " "}, {"candidate_id": null, "section_title": "No id"}]'),
    (2, 1, "I can't say."), (2, 2, '{"section_headings": ['), (3, 0, " "),
)


def _numbers(spark):
    return spark.range(3).selectExpr("id + 1 as doc_id").crossJoin(spark.range(6).selectExpr("cast(id as int) as candidate_id"))


@query("f57_parsed_answers", """SELECT * FROM (VALUES (CAST(1 AS BIGINT), CAST(0 AS INTEGER), '1', 'Introduction', 'high'), (1, 2, NULL, 'Results', NULL), (2, 1, NULL, 'Methods', NULL)) t(doc_id, candidate_id, section_number, section_title, confidence)""")
def parsed_answers(spark, d):
    return K.parsed_answers(_ANSWERS.frame(spark), _numbers(spark))


@query("f57_answer_errors", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), CAST(0 AS INTEGER), NULL), (1, 1, NULL), (2, 0, NULL), (2, 1, 'no JSON in the answer'), (2, 2, 'JSON that can''t be parsed'), (3, 0, 'empty answer')) t(doc_id, seq, error)")
def answer_errors(spark, d):
    return K.answer_errors(_ANSWERS.frame(spark))


_SINGLES = Rows("doc_id:bigint candidate_id:int heading:string answer:string", (1, 0, "3.1 Data", '{"is_heading": true}'), (1, 1, "IV Results", '```{"is_heading": "yes", "section_title": "Results", "section_number": "IV"}```'), (1, 2, "x", '{"is_heading": false}'), (1, 3, "y", '{"is_heading": true, "confidence": "low"}'), (1, 4, "z", '{"section_headings": [{"candidate_id": 4, "section_title": "Zed"}]}'), (1, 5, "w", "no"))


@query("f57_single_answers", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), CAST(0 AS INTEGER), '3.1', 'Data'), (1, 1, 'IV', 'Results'), (1, 4, NULL, 'Zed')) t(doc_id, candidate_id, section_number, section_title)")
def single_answers(spark, d):
    rows = _SINGLES.frame(spark)
    return K.parsed_singles(rows.select("doc_id", "candidate_id", "answer"), rows.select("doc_id", "candidate_id", "heading")).drop("confidence")


def _yes(item: dict) -> str:
    """Stands in for a model: headings of more than eight letters are real, a decimal number breaks it."""
    if item["heading"][:1].isdigit() and "." in item["heading"].split(" ")[0]:
        raise RuntimeError("no answer")
    return '{"is_heading": %s}' % ("true" if len(item["heading"]) > 8 else "false")


@query("c6_review", f"""WITH {_SQL_KEPT}, f AS (SELECT *, regexp_matches(heading, '^[0-9]+\\.[0-9]') AS fails, row_number() OVER (PARTITION BY doc_id ORDER BY line_index) AS pos FROM kept),
s AS (SELECT *, max(CASE WHEN fails AND prior THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS broken FROM (SELECT *, lag(fails) OVER (PARTITION BY doc_id ORDER BY pos) AS prior FROM f))
SELECT doc_id, line_index, CASE WHEN broken IS NOT NULL THEN 'not asked' WHEN fails THEN 'no answer' END AS error, broken IS NULL AND NOT fails AND length(heading) > 8 AS accepted FROM s""")
def review(spark, d):
    """Each kept candidate is shown to a stand-in; two failures in a row end a document's review."""
    kept = kept_candidates(spark, d)
    answers = K.reviewed(kept, _yes)
    yes = K.parsed_singles(answers.where("answer is not null").select("doc_id", "candidate_id", "answer"), kept).select("doc_id", "candidate_id", F.lit(True).alias("accepted"))
    rows = answers.join(kept.select("doc_id", "candidate_id", "line_index"), ["doc_id", "candidate_id"]).join(yes, ["doc_id", "candidate_id"], "left")
    return rows.select("doc_id", "line_index", "error", F.coalesce("accepted", F.lit(False)).alias("accepted"))


@query("c6_without_references", f"""WITH {_SQL}, o AS (SELECT *, coalesce(bool_or(n = 8) OVER (PARTITION BY doc_id ORDER BY line_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS after FROM headed)
SELECT doc_id, line_index FROM o WHERE n <> 7""")
def decisions_without_references(spark, d):
    """All known lines accepted; entries of the reference list go, before and after its heading."""
    lines = known_lines(spark, d).select("doc_id", F.col("line_index").alias("candidate_id"), C.clean_prefix(F.col("text")).alias("heading"), F.col("text").alias("line_text"))
    decisions = lines.select("doc_id", "candidate_id", F.col("line_text").alias("section_title"))
    return K.without_references(decisions, lines).select("doc_id", F.col("candidate_id").alias("line_index"))


@query("c7_section_modes", "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'reviewed' WHEN n_chars // 100 > 200 OR doc_id % 5 = 0 THEN 'rules' ELSE 'llm' END AS mode, CASE WHEN doc_id % 7 = 0 THEN 'reviewed' WHEN doc_id % 5 = 0 THEN 'rules' ELSE 'llm' END AS unlimited FROM documents")
def section_modes(spark, d):
    from lectern.sources.tables import table

    docs = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 7 == 0).alias("has_review"), F.floor(F.col("n_chars") / 100).alias("pages"), (F.col("doc_id") % 5 != 0).alias("available"))
    return K.section_mode(docs).join(K.section_mode(docs, 0).withColumnRenamed("mode", "unlimited"), "doc_id")


@query("c1_heading_scan", f"""WITH {_SQL}, f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(line) ORDER BY line_index) AS k FROM headed WHERE page <= 8 AND strict),
c AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n_found FROM f WHERE k = 1) SELECT doc_id, line_index, line AS heading FROM c WHERE n_found >= 2""")
def heading_scan(spark, d):
    return sections.heading_lines(known_lines(spark, d)).select("doc_id", "line_index", "heading")


@query("w7_after_references", f"""WITH {_SQL}, k AS (SELECT l.doc_id, l.line_index, coalesce(h.n = 8, false) AS r FROM lines l LEFT JOIN headed h USING (doc_id, line_index))
SELECT doc_id, line_index, coalesce(bool_or(r) OVER (PARTITION BY doc_id ORDER BY line_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS in_references FROM k""")
def after_references(spark, d):
    return sections.after_references(headed_lines(spark, d)).select("doc_id", "line_index", "in_references")
