"""Prompts as expressions, relabelled evidence, searches by pattern and the most frequent authors.

Prompts are built from sections, each a title and a body; the SQL twins print the same sections.
"""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import author_names, squeezed, surname
from lectern.operators.evidence import citation, source_label
from lectern.operators.storage import listing_order

#: Tasks over which names are spread.
SPREAD = 64
_INQUIRY = (
    "Relate the research question to the evidence given. Use nothing but the evidence, and name sources by their citation fields only. Speak of this collection, not of all research. "
    "Tell evidence that answers the question from what touches it in part, lies beside it, or doesn't bear on it. Make up nothing; say plainly when there is little.",
    "First the closest evidence, and what it shows and doesn't. Then, if the evidence carries it, a careful claim of what would be new. No lists of search terms or further reading.",
)
_SUMMARY = (
    "Help somebody decide whether to take this document into a library. Be exact and concrete, take no genre for granted, and make up no methods, results or relevance.",
    "short paragraphs of prose, each with one job; fewer where the text gives no more. No headings or bold type. The sections may be cut short: sum up what is there.",
)
_RELEVANCE = (
    "Judge whether a passage is a useful hit for a literature search. Answer with JSON only: relevance, answers_query, missing_concepts, explanation.",
    "strong: it discusses, uses, defines or measures the very thing asked for. partial: it has some of the concepts and lacks a central one. weak: it is near the topic. none: it isn't, or it is no body text.",
)
_ANSWER = ("Answer from the passages given, and cite them. If they don't hold the answer, say so.",)
_EXCERPT = ("Copy from the text the passage that bears most on the request, word for word, and nothing else.",)


def _sections(*pairs: tuple[str, Column]) -> Column:
    """Titled sections, an empty line between them."""
    return F.concat_ws("\n\n", *[F.concat(F.lit(f"{title}:\n"), body) for title, body in pairs])


def _sql(*pairs: tuple[str, str]) -> str:
    return "concat_ws(chr(10) || chr(10), " + ", ".join(f"'{title}:' || chr(10) || {body}" for title, body in pairs) + ")"


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _none(c: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("(none)"))


def inquiry(focus: Column, interest: Column, evidence: Column) -> Column:
    """How a research question relates to retrieved evidence (a JSON list)."""
    return _sections(("Rules", F.lit(_INQUIRY[0])), ("Session so far", _none(focus)), ("Question or refinement", squeezed(interest)), ("Evidence", evidence), ("Task", F.lit(_INQUIRY[1])))


def sql_inquiry(focus: str, interest: str, evidence: str) -> str:
    return _sql(("Rules", _text(_INQUIRY[0])), ("Session so far", focus), ("Question or refinement", interest), ("Evidence", evidence), ("Task", _text(_INQUIRY[1])))


def summary(sections: Column, depth: int) -> Column:
    """A screening summary of about ``depth`` paragraphs."""
    return _sections(("Rules", F.lit(_SUMMARY[0])), ("Task", F.lit(f"About {depth} {_SUMMARY[1]}")), ("Sections", sections))


def sql_summary(sections: str, depth: int) -> str:
    return _sql(("Rules", _text(_SUMMARY[0])), ("Task", _text(f"About {depth} {_SUMMARY[1]}")), ("Sections", sections))


def relevance(query: Column, source: Column, section: Column, pages: Column, text: Column) -> Column:
    known = lambda c, name: F.coalesce(c, F.lit(f"unknown {name}"))
    return _sections(("Rules", F.lit(_RELEVANCE[0])), ("Query", query), ("Source", known(source, "source")), ("Section", known(section, "section")), ("Pages", known(pages, "pages")), ("Passage", squeezed(text)), ("Labels", F.lit(_RELEVANCE[1])))


def sql_relevance(query: str, source: str, section: str, pages: str, text: str) -> str:
    return _sql(("Rules", _text(_RELEVANCE[0])), ("Query", query), ("Source", source), ("Section", section), ("Pages", pages), ("Passage", text), ("Labels", _text(_RELEVANCE[1])))


def answer(question: Column, passages: Column) -> Column:
    return _sections(("Rules", F.lit(_ANSWER[0])), ("Passages", passages), ("Question", question))


def sql_answer(question: str, passages: str) -> str:
    return _sql(("Rules", _text(_ANSWER[0])), ("Passages", passages), ("Question", question))


def excerpt(request: Column, text: Column, least: int, most: int) -> Column:
    return _sections(("Rules", F.lit(f"{_EXCERPT[0]} Between {least} and {most} words.")), ("Request", request), ("Text", text))


def sql_excerpt(request: str, text: str, least: int, most: int) -> str:
    return _sql(("Rules", _text(f"{_EXCERPT[0]} Between {least} and {most} words.")), ("Request", request), ("Text", text))


def relabelled(packets: DataFrame, edits: DataFrame) -> DataFrame:
    """Evidence (doc_id, path, label, citation, page_start, page_end) after documents (doc_id, path, title, authors, year) were edited."""
    new = edits.select("doc_id", source_label(F.col("authors"), F.col("year"), F.col("path"), F.col("title")).alias("__label"), F.col("path").alias("__path"))
    joined = packets.join(new, "doc_id", "left").withColumns({"path": F.coalesce("__path", "path"), "citation": F.when(F.col("__label").isNotNull(), citation(F.col("__label"), F.col("page_start"), F.col("page_end"))).otherwise(F.col("citation"))})
    return joined.withColumn("label", F.coalesce("__label", "label")).select(*packets.columns)


def pattern_error(spark: SparkSession, pattern: str) -> str | None:
    """Why a pattern can't be compiled; null if it can."""
    try:
        spark.range(1).select(F.lit("").rlike(pattern)).collect()
    except PySparkException as e:
        return str(e).splitlines()[0]
    return None


def grep(bib: DataFrame, chunks: DataFrame, pattern: str, limit: int = 10) -> DataFrame:
    """(doc_id, in_metadata, in_text) of documents whose metadata or current chunks a pattern matches, without case, in the order of the listing."""
    where = F.concat_ws(" ", "title", "authors", F.col("year").cast("string"), "doi", "path").rlike(f"(?i){pattern}")
    text = chunks.where(F.col("text").rlike(f"(?i){pattern}")).select("doc_id").distinct().withColumn("__t", F.lit(True))
    told = bib.withColumn("in_metadata", where).join(text, "doc_id", "left").withColumn("in_text", F.coalesce("__t", F.lit(False)))
    return told.where("in_metadata or in_text").orderBy(*listing_order()).limit(limit).select("doc_id", "in_metadata", "in_text")


def top_authors(bib: DataFrame, limit: int) -> DataFrame:
    """(surname, n): the most frequent surnames. A negative limit is an error."""
    if limit < 0:
        raise ValueError("the number of authors must be zero or more")
    # rows are spread before their patterns are matched: few bytes, but much work; a name's surname is found once
    names = bib.select("authors").repartition(SPREAD).select(F.explode(author_names(F.col("authors"))).alias("a")).groupBy("a").agg(F.count("*").alias("n"))
    surnames = names.select(F.lower(surname(F.col("a"))).alias("surname"), "n").groupBy("surname").agg(F.sum(F.when(F.col("surname").isNotNull(), F.col("n"))).alias("n"))
    return surnames.where("n is not null").orderBy(F.desc("n"), "surname").limit(limit)
