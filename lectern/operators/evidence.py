"""Evidence for question answering: retrieval queries, packets, sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import page_label, squeezed, trimmed


def recent_focus(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text", keep: int = 6) -> DataFrame:
    """(conv_id, summary): the last ``keep`` user turns of each conversation, numbered after the cut."""
    items = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("at"), squeezed(F.col(text)).alias("text"))))
    last = turns.groupBy(conv).agg(items.alias("all")).select(conv, F.slice("all", F.greatest(F.size("all") - keep + 1, F.lit(1)), keep).alias("last"))
    lines = F.transform("last", lambda x, i: F.concat(F.lit("Turn "), (i + 1).cast("string"), F.lit(" user focus: "), x["text"]))
    return last.select(conv, F.array_join(lines, "\n").alias("summary"))


def retrieval_query(summary: Column, question: Column) -> Column:
    """The question alone in a first turn; else with the recent focus in front."""
    q = squeezed(question)
    return F.when(F.coalesce(F.trim(summary), F.lit("")) == "", q).otherwise(F.concat(F.lit("Recent conversation focus:\n"), F.trim(summary), F.lit("\n\nCurrent user question or refinement:\n"), q))


def public_name(path: Column) -> Column:
    """A file's name without the hash that managed storage appends."""
    name = F.nullif(F.trim(F.element_at(F.split(path, "/"), -1)), F.lit(""))
    return F.when(F.lower(name).endswith(".pdf"), F.concat(F.regexp_replace(F.substr(name, F.lit(1), F.length(name) - 4), "--[0-9a-fA-F]{8,}$", ""), F.lit(".pdf"))).otherwise(name)


def source_label(authors: Column, year: Column, path: Column, title: Column) -> Column:
    return F.coalesce(F.concat(F.nullif(squeezed(authors), F.lit("")), F.lit(" "), year.cast("string")), public_name(path), F.nullif(squeezed(title), F.lit("")), F.lit("unknown document"))


def citation(label: Column, start: Column, end: Column) -> Column:
    return F.concat_ws(", ", label, page_label(start, end))


def packets(hits: DataFrame, most: int = 1500) -> DataFrame:
    """Hits (place, doc_id, path, title, authors, year, page_start, page_end, text) as numbered evidence."""
    label = source_label(F.col("authors"), F.col("year"), F.col("path"), F.col("title"))
    return hits.select("place", "doc_id", "path", label.alias("label"), citation(label, F.col("page_start"), F.col("page_end")).alias("citation"), "page_start", "page_end", trimmed(squeezed(F.col("text")), most).alias("excerpt"))


def passage_letter(i: Column) -> Column:
    """a..z, aa.. for 0.."""
    letter = lambda n: F.char(n + 97)
    return F.when(i < 26, letter(i)).otherwise(F.concat(letter(F.floor(i / 26) - 1), letter(i % 26)))


def sources(evidence: DataFrame) -> DataFrame:
    """(source_number, label, citation, passages, packets): evidence by file, page ranges once each, in retrieval order."""
    pages = page_label(F.col("page_start"), F.col("page_end"))
    ranges = evidence.groupBy("path", "page_start", "page_end").agg(F.min("place").alias("place"), F.count("*").alias("n"), F.min_by("label", "place").alias("label")).withColumn("pages", pages)
    item = F.struct("place", "pages", "label")
    grouped = ranges.groupBy("path").agg(F.array_sort(F.collect_list(item)).alias("items"), F.min("place").alias("place"), F.sum("n").alias("packets"))
    shown = F.filter(F.transform("items", lambda x: x["pages"]), lambda x: x.isNotNull())
    label = F.col("items")[0]["label"]
    number = F.row_number().over(Window.orderBy("place"))  # a question's sources are a handful
    return grouped.select(number.alias("source_number"), label.alias("label"), F.concat_ws(", ", label, F.nullif(F.array_join(shown, "; "), F.lit(""))).alias("citation"), F.transform("items", lambda x, i: passage_letter(i)).alias("passages"), "packets")


def within_budget(evidence: DataFrame, most: int = 14_000) -> DataFrame:
    """The longest prefix whose rendered JSON list stays within ``most`` characters; the first item always stays.

    Lengths are those of the list printed with an indent of two: brackets, and per item its
    braces, two keys and escaped values.
    """
    def quoted(c: Column) -> Column:
        return F.length(c) + F.regexp_count(c, F.lit(r'["\\\n\r\t\x08\f]')) + 2

    item = quoted(F.col("citation")) + quoted(F.col("excerpt")) + F.lit(len('  {\n    "citation": ,\n    "excerpt": \n  }'))
    running = F.sum(item + 2).over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)) + 2
    return evidence.withColumn("rendered", running).where((F.col("rendered") <= most) | (F.col("place") == 1))


def estimated_tokens(c: Column) -> Column:
    return F.when(F.length(c) > 0, F.greatest(F.lit(1), F.ceil(F.length(c) / 4))).otherwise(0).cast("bigint")


OMITTED = "\n\n[... omitted ...]\n\n"


def fitted(c: Column, most_tokens: int | Column) -> Column:
    """Head and tail of a text that is over the budget, with a mark between them."""
    t, budget = squeezed(c), most_tokens if isinstance(most_tokens, Column) else F.lit(most_tokens)
    room = F.greatest(F.lit(1000), F.greatest(F.lit(1000), budget * 4) - len(OMITTED.strip()) - 4)
    tail = F.greatest(F.lit(250), F.floor(room / 3)).cast("int")
    head = F.greatest(F.lit(250), room - tail).cast("int")
    return F.when(estimated_tokens(t) <= budget, t).otherwise(F.concat(F.rtrim(F.left(t, head)), F.lit(OMITTED), F.ltrim(F.right(t, tail))))


def window_words(c: Column) -> Column:
    return F.filter(F.split(squeezed(c), " "), lambda w: w != "")


def semantic_windows(words: Column, width: int = 70) -> Column:
    """Half-overlapping windows of ``width`` words; the last one is dropped if it has fewer than twelve.

    Takes a column of words that was made before: lambdas evaluate what they refer to once an element.
    """
    n, stride = F.size(words), max(1, width // 2)
    starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(stride)), lambda s: ((s == 0) | (n - s >= 12)) & ((s == 0) | (s - stride + width < n)))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(starts, lambda s: F.array_join(F.slice(words, s + 1, width), " ")))


def context_window(c: Column, needle: str | None, width: int = 240) -> Column:
    """``width`` characters around the first literal match, marked where text was left out."""
    t = squeezed(c)
    n = F.length(t)
    at = F.locate(needle.lower(), F.lower(t)) if needle else F.lit(0)
    middle = F.when(at > 0, at - 1 + len(needle or "") // 2).otherwise(width // 2)
    start = F.greatest(F.lit(0), F.least(middle - width // 2, n - width)).cast("int")
    cut = F.trim(F.substr(t, start + 1, F.lit(width)))
    return F.when(n <= width, t).otherwise(F.concat(F.when(start > 0, "[...] ").otherwise(""), cut, F.when(start + width < n, " [...]").otherwise("")))


def embedding_text(title: Column, authors: Column, year: Column, section: Column, text: Column) -> Column:
    """Labelled metadata lines, an empty line, the text; fields that aren't there are left out."""
    def field(name: str, c: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), F.nullif(F.trim(c.cast("string")), F.lit("")))

    head = F.concat_ws("\n", field("Title", title), field("Authors", authors), field("Year", year), field("Section", section))
    return F.concat_ws("\n\n", F.nullif(head, F.lit("")), text)


def collection_name(c: Column) -> Column:
    name = F.btrim(F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9._-]+", "-"), r"\.{2,}", "."), F.lit("._-"))
    cut = F.btrim(F.left(name, F.lit(512)), F.lit("._-"))
    return F.when(F.length(cut) >= 3, cut).otherwise(F.concat(cut, F.lit("-index")))
