"""Heading candidates of whole documents, their review by an outside model, and what comes of it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import candidates as C
from lectern.functions.headings import COMMON
from lectern.functions.text import is_reference_title, parsed_heading, squeezed

CANDIDATES = "doc_id bigint, candidate_id int, line_index int, page int, line_text string, candidate_text string, before array<string>, after array<string>"


def with_context(lines: DataFrame, max_page: int | None = None, around: int = 2, titles: tuple[str, ...] = COMMON) -> DataFrame:
    """Candidates of lines (doc_id, line_index, page, text), numbered from 0 in each document.

    A line gives its lettered heading, else its embedded ones, else its common title, else, if it
    may be a heading, a candidate without text. Context is taken from all lines.
    """
    w = Window.partitionBy("doc_id").orderBy("line_index")
    seen = lines.withColumns({"line_text": squeezed(F.col("text")), "before": F.collect_list(squeezed(F.col("text"))).over(w.rowsBetween(-around, -1)), "after": F.collect_list(squeezed(F.col("text"))).over(w.rowsBetween(1, around))})
    if max_page is not None:
        seen = seen.where(F.col("page") <= max_page)
    # in steps: each column is made once, whatever refers to it
    line, bare, embedded = F.col("line_text"), F.col("__bare"), F.col("__embedded")
    seen = seen.withColumns({"__bare": C.unglued(line), "__embedded": C.embedded_headings(line, titles)})
    seen = seen.withColumns({"__lettered": C.lettered_heading(line, titles, bare), "__common": C.common_prefix(line, titles), "__maybe": C.is_candidate(line, titles, bare, embedded)})
    one = lambda c: F.array(c)
    texts = F.when(F.col("__lettered").isNotNull(), one(F.col("__lettered"))).when(F.size(embedded) > 0, embedded).when(F.col("__common").isNotNull(), one(F.col("__common"))).when(F.col("__maybe"), one(F.lit(None).cast("string")))
    found = seen.withColumn("texts", texts).where("texts is not null").select("doc_id", "line_index", "page", "line_text", "before", "after", F.posexplode("texts").alias("at", "raw"))
    found = found.withColumn("candidate_text", C.unglued(F.col("raw")))
    first = found.withColumn("rn", F.row_number().over(Window.partitionBy("doc_id", "line_index", F.lower("candidate_text")).orderBy("at"))).where("rn = 1")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_index", "at")) - 1
    return first.select("doc_id", number.alias("candidate_id"), "line_index", "page", "line_text", "candidate_text", "before", "after")


def text_of(titles: tuple[str, ...] = COMMON) -> Column:
    """What a candidate is judged by: its text, or the cleaned start of its line."""
    return F.coalesce(C.unglued(F.col("candidate_text")), C.clean_prefix(F.col("line_text"), titles))


def filtered(candidates: DataFrame, titles: tuple[str, ...] = COMMON) -> DataFrame:
    """Candidates that aren't noise and read like headings, the first of each spelling in a document; with ``heading``, their text."""
    context = F.concat_ws(" ", F.col("before"), F.col("line_text"), F.col("after"))
    judged = candidates.withColumn("heading", text_of(titles))
    noise = C.is_running_head(F.col("line_text")) | C.is_chart_debris(F.col("line_text"), context) | C.is_reference_candidate(F.col("heading"), F.col("line_text"))
    kept = judged.where(~noise & C.reads_like_heading(F.col("heading"), titles))
    return kept.withColumn("rn", F.row_number().over(Window.partitionBy("doc_id", F.lower("heading")).orderBy("candidate_id"))).where("rn = 1").drop("rn")


def grouped(candidates: DataFrame) -> DataFrame:
    """One row for candidates (with ``heading``) of a page with one text: the first, and the others' ids in order."""
    ids = F.array_sort(F.collect_list("candidate_id"))
    first = F.min(F.struct("candidate_id", "heading", "line_text", F.element_at("before", -1).alias("previous_line"), F.element_at("after", 1).alias("next_line")))
    rows = candidates.withColumns({"before": F.when(F.size("before") > 0, F.col("before")).otherwise(F.array(F.lit(""))), "after": F.when(F.size("after") > 0, F.col("after")).otherwise(F.array(F.lit("")))})
    g = rows.groupBy("doc_id", "page", F.lower("heading").alias("key")).agg(first.alias("f"), ids.alias("ids"))
    return g.select("doc_id", "page", "f.candidate_id", F.expr("slice(ids, 2, greatest(size(ids) - 1, 0))").alias("also_ids"), "f.heading", "f.line_text", "f.previous_line", "f.next_line", C.level(F.col("f.heading")).alias("level"))


# ---- answers of a model --------------------------------------------------------------------

_HEADING = "struct<candidate_id:string,candidate_ids:array<string>,section_number:string,section_title:string,confidence:string>"
_SINGLE = "struct<is_heading:string,section_number:string,section_title:string,confidence:string,section_headings:array<" + _HEADING + ">>"


def json_payload(c: Column) -> Column:
    """The JSON of an answer: without a code fence, and without words around it; null if there is none."""
    bare = F.trim(F.regexp_replace(F.trim(c), r"(?is)^```(?:json)?\s*(.*?)\s*```$", "$1"))
    inner = F.coalesce(F.nullif(F.regexp_extract(bare, r"(?s)^[^{\[]*(\{.*\})", 1), F.lit("")), F.nullif(F.regexp_extract(bare, r"(?s)^[^{\[]*(\[.*\])", 1), F.lit("")))
    return F.when(bare.rlike(r"^[{\[]"), bare).otherwise(inner)


def parsed_answers(answers: DataFrame, candidates: DataFrame) -> DataFrame:
    """(doc_id, candidate_id, section_number, section_title, confidence) of answers (doc_id, seq, answer) that list headings.

    Unknown ids, headings without title and those of low confidence are dropped; the first answer
    for a candidate counts. An answer without proper JSON gives no row (``answer_errors`` lists it).
    """
    payload = json_payload(F.col("answer"))
    as_list = F.from_json(payload, f"array<{_HEADING}>")
    as_object = F.from_json(payload, f"struct<section_headings:array<{_HEADING}>>")["section_headings"]
    rows = answers.select("doc_id", "seq", F.posexplode(F.when(F.ltrim(payload).startswith("["), as_list).otherwise(as_object)).alias("at", "h"))
    wanted = F.coalesce(F.col("h.candidate_id"), F.col("h.candidate_ids")[0]).try_cast("int")
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    rows = rows.select("doc_id", "seq", "at", wanted.alias("candidate_id"), blank(F.col("h.section_number")).alias("section_number"), blank(F.col("h.section_title")).alias("section_title"), blank(F.col("h.confidence")).alias("confidence"))
    valid = rows.where("section_title is not null and lower(coalesce(confidence, '')) <> 'low'").join(candidates.select("doc_id", "candidate_id"), ["doc_id", "candidate_id"], "left_semi")
    first = valid.withColumn("rn", F.row_number().over(Window.partitionBy("doc_id", "candidate_id").orderBy("seq", "at"))).where("rn = 1")
    return first.select("doc_id", "candidate_id", "section_number", "section_title", "confidence")


def answer_errors(answers: DataFrame) -> DataFrame:
    """(doc_id, seq, error): null where an answer's JSON could be read."""
    payload = json_payload(F.col("answer"))
    read = F.from_json(payload, "map<string,string>").isNotNull() | F.from_json(payload, "array<map<string,string>>").isNotNull()
    error = F.when(F.trim("answer") == "", "empty answer").when(payload.isNull(), "no JSON in the answer").when(~F.coalesce(read, F.lit(False)), "JSON that can't be parsed")
    return answers.select("doc_id", "seq", error.alias("error"))


def parsed_singles(answers: DataFrame, candidates: DataFrame) -> DataFrame:
    """The same columns, of answers (doc_id, candidate_id, answer) about one candidate each (with ``heading``).

    A heading without title takes number and title from the candidate; the list form is accepted too.
    """
    h = F.from_json(json_payload(F.col("answer")), _SINGLE)
    listed = F.filter(h["section_headings"], lambda x: x["candidate_id"].try_cast("int") == F.col("candidate_id"))
    rows = answers.join(candidates.select("doc_id", "candidate_id", "heading"), ["doc_id", "candidate_id"]).withColumns({"h": h, "own": F.get(listed, F.lit(0))})
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    many = F.col("h.section_headings").isNotNull()
    yes = F.lower(F.trim(F.col("h.is_heading"))).isin("true", "yes", "y") & ~many
    pick = lambda name: blank(F.when(many, F.col(f"own.{name}")).otherwise(F.col(f"h.{name}")))
    parsed = parsed_heading(F.col("heading"))
    title, number = pick("section_title"), pick("section_number")
    rows = rows.where(yes | (many & F.col("own").isNotNull() & title.isNotNull())).where(F.lower(F.coalesce(pick("confidence"), F.lit(""))) != "low")
    return rows.select("doc_id", "candidate_id", F.when(title.isNull(), F.coalesce(number, parsed["number"])).otherwise(number).alias("section_number"), F.coalesce(title, parsed["title"], F.col("heading")).alias("section_title"), pick("confidence").alias("confidence"))


def reviewed(candidates: DataFrame, ask: Callable[[dict], str], most_failures: int = 2) -> DataFrame:
    """Every candidate (with ``heading``) shown to ``ask``, a callable that may raise: (doc_id, candidate_id, answer, error).

    One at a time in document order, retried once; after ``most_failures`` candidates in a row that
    fail the rest of the document isn't asked about ("not asked"). Documents are asked in parallel.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, items in zip(batch["doc_id"], batch["c"]):
                failures = 0
                for item in items:
                    answer, error = None, "not asked"
                    for _ in range(2 if failures < most_failures else 0):
                        try:
                            answer, error = ask(dict(item)), None
                            break
                        except Exception as e:  # whatever a service raises is a row's error
                            error = str(e)
                    failures = 0 if error is None else failures + 1
                    rows.append((doc, item["candidate_id"], answer, error))
            yield pd.DataFrame(rows, columns=["doc_id", "candidate_id", "answer", "error"]).astype({"candidate_id": "int32"})

    by_doc = candidates.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("candidate_id", "page", "heading", "line_text", "before", "after"))).alias("c"))
    return by_doc.mapInPandas(run, "doc_id bigint, candidate_id int, answer string, error string")


def without_references(decisions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Decisions (doc_id, candidate_id, section_title, ...) without those on entries of a reference list: what is one anywhere,
    and after an accepted reference heading what only may be part of one. Unknown candidates pass."""
    w = Window.partitionBy("doc_id").orderBy("candidate_id").rowsBetween(Window.unboundedPreceding, -1)
    marked = decisions.withColumn("__own", is_reference_title(F.col("section_title"))).withColumn("__after", F.coalesce(F.max("__own").over(w), F.lit(False)))
    joined = marked.join(candidates.select("doc_id", "candidate_id", "heading", "line_text"), ["doc_id", "candidate_id"], "left")
    text, raw = F.col("heading"), F.col("line_text")
    entry = C.is_reference_candidate(text, raw) | (F.col("__after") & (C.is_numbered_reference(text) | C.is_numbered_reference(raw) | C.is_reference_fragment(text)))
    return joined.where(F.col("__own") | ~F.coalesce(entry, F.lit(False))).select(*decisions.columns)


def section_mode(documents: DataFrame, cutoff: int = 200) -> DataFrame:
    """(doc_id, mode) of documents (doc_id, has_review, pages, available): reviewed headings first; the model unless the
    document has more pages than the cutoff (0 or less: none has) or no model is there; else rules."""
    huge = (F.lit(cutoff) > 0) & (F.col("pages") > cutoff)
    return documents.select("doc_id", F.when(F.col("has_review"), "reviewed").when(huge | ~F.col("available"), "rules").otherwise("llm").alias("mode"))
