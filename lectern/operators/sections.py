"""Sections: spans between headings, in line order, by one window a document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.headings import is_heading
from lectern.functions.text import parsed_heading, section_key, squeezed
from lectern.operators.evidence import estimated_tokens, fitted


def heading_lines(lines: DataFrame, max_page: int = 8) -> DataFrame:
    """(doc_id, line_index, heading): plausible headings of the first pages, the first of each spelling; none for
    documents with fewer than two."""
    found = lines.where(F.col("page") <= max_page).select("doc_id", "line_index", squeezed(F.col("text")).alias("heading")).where(is_heading(F.col("heading")))
    first = found.withColumn("rn", F.row_number().over(Window.partitionBy("doc_id", F.lower("heading")).orderBy("line_index"))).where("rn = 1").drop("rn")
    return first.withColumn("n", F.count("*").over(Window.partitionBy("doc_id"))).where("n >= 2").drop("n")


def marked(lines: DataFrame, headings: DataFrame) -> DataFrame:
    """Lines with ``heading``: whether the line is one of the reviewed headings (column key)."""
    keyed = lines.withColumn("key", section_key(F.col("text")))
    return keyed.join(headings.select("key", F.lit(True).alias("heading")), "key", "left").withColumn("heading", F.coalesce("heading", F.lit(False))).drop("key")


def spans(lines: DataFrame) -> DataFrame:
    """(doc_id, section_index, number, title, page_start, page_end, text, lines) from lines with a flag ``heading``.

    What stands before the first heading has no index; a heading belongs to its section's text.
    Spans without text are dropped.
    """
    by = Window.partitionBy("doc_id").orderBy("line_index").rowsBetween(Window.unboundedPreceding, 0)
    numbered = lines.withColumn("n", F.sum(F.col("heading").cast("int")).over(by))
    item = F.struct("line_index", "page", "text", "heading")
    grouped = numbered.groupBy("doc_id", "n").agg(F.array_sort(F.collect_list(item)).alias("lines"), F.min("page").alias("page_start"), F.max("page").alias("page_end"))
    head = parsed_heading(F.when(F.col("n") > 0, F.col("lines")[0]["text"]))
    rows = grouped.select(
        "doc_id", (F.nullif(F.col("n"), F.lit(0)) - 1).cast("int").alias("section_index"), head["number"].alias("number"), head["title"].alias("title"),
        "page_start", "page_end", F.array_join("lines.text", "\n").alias("text"), F.transform("lines", lambda x: F.struct(x["page"].alias("page"), x["text"].alias("text"))).alias("lines"),
    )
    return rows.where(F.trim("text") != "")


def decided(lines: DataFrame, candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Lines flagged by decisions on candidates: unknown candidates are dropped, the last decision on a line wins."""
    known = decisions.join(candidates.select("candidate_id", "doc_id", "line_index"), "candidate_id")
    last = known.groupBy("doc_id", "line_index").agg(F.max_by("accepted", "seq").alias("heading"))
    return lines.join(last, ["doc_id", "line_index"], "left").withColumn("heading", F.coalesce("heading", F.lit(False)))


def context(lines: DataFrame, n: int = 2) -> DataFrame:
    """Each line with the n before and the n after it."""
    w = Window.partitionBy("doc_id").orderBy("line_index")
    return lines.select("doc_id", "line_index", F.collect_list("text").over(w.rowsBetween(-n, -1)).alias("before"), F.collect_list("text").over(w.rowsBetween(1, n)).alias("after"))


def after_references(lines: DataFrame) -> DataFrame:
    """Lines with ``in_references``: whether a line before them is the heading of the reference list."""
    w = Window.partitionBy("doc_id").orderBy("line_index").rowsBetween(Window.unboundedPreceding, -1)
    is_ref = section_key(F.col("text")).isin("references", "bibliography", "works cited", "literature cited")
    return lines.withColumn("in_references", F.coalesce(F.max(is_ref).over(w), F.lit(False)))


_NON_CONTENT = ("acknowledgement", "acknowledgements", "acknowledgment", "acknowledgments", "author contributions", "bibliography", "competing interests", "conflict of interest", "conflicts of interest", "funding", "literature cited", "references", "works cited")


def display_title(title, number, index):
    return F.coalesce(F.nullif(F.trim(title), F.lit("")), F.concat(F.lit("Section "), F.nullif(F.trim(number), F.lit(""))), F.when(index.isNull(), "front matter").otherwise(F.concat(F.lit("section "), (index + 1).cast("string"))))


def priority(title, index):
    key = section_key(F.coalesce(title, F.lit("")))
    return (
        F.when(key.isin("abstract", "executive summary", "summary"), 0).when(key.isin("background", "intro", "introduction", "overview"), 1)
        .when(key.rlike(r"\b(?:conclusions?|discussion|future work)\b"), 2).when(key.isin("front matter", "title page") | index.isNull(), 4).otherwise(3)
    )


def screening(sections: DataFrame, most: int = 5) -> DataFrame:
    """(doc_id, section_index, shown): the sections that stand for a document, five at most.

    A section is skipped if its title or its text was seen before, and a skipped one registers
    neither; so this is a fold over a document's sections, done with one aggregate.
    """
    shown = display_title(F.col("title"), F.col("number"), F.col("section_index"))
    content = sections.where(~F.coalesce(section_key(F.col("title")).isin(*_NON_CONTENT), F.lit(False)))
    item = F.struct(F.coalesce("section_index", F.lit(-1)).alias("at"), section_key(shown).alias("title_key"), F.sha2(F.lower(squeezed(F.col("text"))), 256).alias("text_key"), shown.alias("shown"), priority(F.col("title"), F.col("section_index")).alias("priority"))
    listed = content.select("doc_id", item.alias("s")).groupBy("doc_id").agg(F.array_sort(F.collect_list("s")).alias("all"))
    kept = F.aggregate("all", F.filter("all", lambda x: F.lit(False)), lambda acc, x: F.when(F.exists(acc, lambda a: (a["title_key"] == x["title_key"]) | (a["text_key"] == x["text_key"])), acc).otherwise(F.array_append(acc, x)))
    best = F.slice(F.array_sort(F.transform(kept, lambda x: F.struct(x["priority"].alias("p"), x["at"].alias("at"), x["shown"].alias("shown")))), 1, most)
    return listed.select("doc_id", F.explode(best).alias("b")).select("doc_id", F.nullif(F.col("b.at"), F.lit(-1)).alias("section_index"), F.col("b.shown").alias("shown"))


def screening_excerpts(sections: DataFrame, most: int = 5, context: int = 16_384) -> DataFrame:
    """(doc_id, section_index, shown, text, was_cut): the screening sections, in document order, cut to a budget of tokens.

    All but 1,500 tokens of the context are shared out; a section gets its share, or what is left, a hundred at least.
    The first that no longer fits ends the list, unless it is the only one. A fold over five items.
    """
    budget = max(250, context - 1500)
    chosen = screening(sections, most).join(sections.select("doc_id", "section_index", F.col("text").alias("whole")).withColumn("at", F.coalesce("section_index", F.lit(-1))).drop("section_index"), "doc_id")
    chosen = chosen.where(F.coalesce("section_index", F.lit(-1)) == F.col("at"))
    listed = chosen.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "shown", squeezed(F.col("whole")).alias("whole")))).alias("s"))
    share = F.greatest(F.lit(100), F.floor(F.lit(budget) / F.size("s")))

    def once(value: Column, use: Callable[[Column], Column]) -> Column:
        """``use`` of a value that is computed once, however often it is referred to."""
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def step(state: Column, x: Column) -> Column:
        text = fitted(x["whole"], F.least(share, F.greatest(F.lit(100), F.lit(budget) - state["used"])))
        return once(text, lambda t: once(estimated_tokens(x["shown"]) + estimated_tokens(t) + 20, lambda tokens: added(state, x, t, tokens)))

    def added(state: Column, x: Column, text: Column, tokens: Column) -> Column:
        full = state["done"] | (state["used"] >= budget) | ((state["used"] + tokens > budget) & (F.size(state["out"]) > 0))
        item = F.struct(x["at"].alias("at"), x["shown"].alias("shown"), text.alias("text"), (text != x["whole"]).alias("was_cut"))
        return F.struct(F.when(full, state["used"]).otherwise(state["used"] + tokens).alias("used"), F.when(full, state["out"]).otherwise(F.array_append(state["out"], item)).alias("out"), full.alias("done"))

    nothing = F.array().cast("array<struct<at:int,shown:string,text:string,was_cut:boolean>>")
    start = F.struct(F.lit(0).cast("bigint").alias("used"), nothing.alias("out"), F.lit(False).alias("done"))
    rows = listed.select("doc_id", F.explode(F.aggregate("s", start, step)["out"]).alias("e"))
    return rows.select("doc_id", F.nullif(F.col("e.at"), F.lit(-1)).alias("section_index"), "e.shown", "e.text", "e.was_cut")
