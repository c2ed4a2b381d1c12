"""Labels and names of documents as listings and files show them, and small text rules of curation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.metadata import is_bad_authors, is_bad_title, is_bad_year
from lectern.functions.text import author_names, clean, squeezed, surname


def tag_name(authors: Column, title: Column, path: Column) -> Column:
    """What a listing tag begins with: the first author's surname, else the title's first word, else the file's."""
    token = lambda c: F.nullif(F.regexp_replace(c, "[^A-Za-z0-9]+", ""), F.lit(""))
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return F.coalesce(surname(F.get(author_names(authors), F.lit(0))), token(F.split(squeezed(title), " ")[0]), token(F.split(stem, "-")[0]), F.lit("unknown"))


def letters(index: Column) -> Column:
    """a..z, aa..zz, aaa.. for 0.."""
    letter = lambda n: F.char((n % 26 + 97).cast("bigint"))
    second, third = F.floor(index / 26) - 1, F.floor((F.floor(index / 26) - 1) / 26) - 1
    return F.concat(F.when(third >= 0, letter(third)).otherwise(""), F.when(second >= 0, letter(second)).otherwise(""), letter(index))


def surname_first(authors: Column) -> Column:
    """Authors with the first one's surname in front: "Byron, Ada and Bo Li"."""
    names = author_names(authors)
    first = F.get(names, F.lit(0))
    last = surname(first)
    given = F.btrim(F.regexp_replace(first, r"\s*[^\s]+$", ""))
    turned = F.when(F.contains(first, F.lit(",")) | last.isNull() | (given == ""), first).otherwise(F.concat(last, F.lit(", "), squeezed(F.left(first, F.length(first) - F.length(last)))))
    rest = F.slice(names, 2, F.greatest(F.size(names) - 1, F.lit(0)))
    return F.when(F.size(names) == 0, "unknown author").otherwise(F.concat_ws(", ", turned, F.nullif(F.array_join(rest, ", "), F.lit(""))))


def title_for_listing(title: Column) -> Column:
    """A title with its leading article behind: "Theory of Games, The"."""
    t = squeezed(title)
    article, rest = F.regexp_extract(t, "(?i)^(a|an|the) (.+)$", 1), F.regexp_extract(t, "(?i)^(a|an|the) (.+)$", 2)
    return F.when(article != "", F.concat(rest, F.lit(", "), article)).otherwise(t)


def has_title_case(line: Column) -> Column:
    """At least half of the words begin in upper case, or most letters are capitals."""
    words = F.regexp_extract_all(line, F.lit("([A-Za-z][A-Za-z-]*)"), 1)
    initials = F.size(F.filter(words, lambda w: w.rlike("^[A-Z]"))) / F.size(words)
    capitals = F.regexp_count(line, F.lit("[A-Z]")) / F.regexp_count(line, F.lit("[A-Za-z]"))
    return F.coalesce(F.when(F.size(words) > 0, (initials >= 0.5) | (capitals > 0.65)), F.lit(False))


def author_list(c: Column) -> Column:
    """Names of stored author text: a printed list, else split at semicolons, at "and", or at commas.

    Two single words with a comma between them are one name, surname first.
    """
    text = F.trim(c)
    parts = lambda pattern: F.filter(F.transform(F.split(text, pattern), lambda p: F.trim(p)), lambda p: p != "")
    printed = F.filter(F.transform(F.split(F.regexp_replace(text, r"^[\[(]|[\])]$", ""), ","), lambda p: F.btrim(F.trim(p), F.lit("'\""))), lambda p: F.trim(p) != "")
    by_comma = parts(",")
    single = F.when(text.rlike(r"^[^\s,]+,\s*[^\s,]+$") & text.rlike(r"^\p{L}+,\s*\p{L}+$"), F.array(text)).when(F.size(by_comma) > 1, by_comma).otherwise(F.array(text))
    nothing = F.array().cast("array<string>")
    return F.when(F.coalesce(text, F.lit("")) == "", nothing).when(text.rlike(r"^(?:\[.*\]|\(.*\))$"), printed).when(text.contains(";"), parts(";")).when(text.contains(" and "), parts(" and ")).otherwise(single)


def short_filename(authors: Column, year: Column) -> Column:
    """First author's surname and year, as a file name; null if either is missing."""
    first = squeezed(F.regexp_replace(F.regexp_replace(F.get(author_list(authors), F.lit(0)), r"""^\s*['"\[]+""", ""), r"""['"\]]+\s*$""", ""))
    last = F.when(first.contains(","), F.trim(F.split(first, ",")[0])).otherwise(F.element_at(F.split(first, " "), -1))
    bare = F.nullif(F.regexp_replace(last, "[^A-Za-z0-9]+", ""), F.lit(""))
    return F.concat(bare, year.cast("string"), F.lit(".pdf"))


def sanitized(payload: Column) -> Column:
    """struct(title, authors, year, doi, confidence, reason) of a model's JSON: what isn't plausible is null, confidence low."""
    p = F.from_json(payload, "title string, authors string, year string, doi string, confidence string, reason string")
    title, authors, doi = clean(p["title"]), clean(p["authors"]), clean(p["doi"])
    year = F.trim(p["year"]).try_cast("int")
    level = clean(p["confidence"])
    return F.struct(
        F.when(~is_bad_title(title), title).alias("title"), F.when(~is_bad_authors(authors), authors).alias("authors"), F.when(~is_bad_year(year), year).alias("year"),
        F.when(doi.rlike(r"(?i)^10\.\d{4,9}/"), doi).alias("doi"), F.when(level.isin("high", "medium", "low"), level).otherwise("low").alias("confidence"), F.coalesce(clean(p["reason"]), F.lit("extracted by a model")).alias("reason"),
    )


def selection(text: Column, count: Column) -> Column:
    """struct(action, source, passage) of "2", "2c", "edit 2", "e2", "details 1", "d 1", all counted from 0; null if it is none of them."""
    low = F.lower(F.trim(text))
    verb, number = F.regexp_extract(low, r"^(edit|details|e|d)\s*(\d+)$", 1), F.regexp_extract(low, r"^(edit|details|e|d)\s*(\d+)$", 2)
    spaced = ~low.rlike(r"^(?:edit|details)\d")
    source, letters_ = F.regexp_extract(low, r"^(\d+)([a-z]*)$", 1), F.regexp_extract(low, r"^(\d+)([a-z]*)$", 2)
    passage = F.when(letters_ == "", 0).otherwise(F.aggregate(F.split(letters_, ""), F.lit(0), lambda n, c: F.when(c == "", n).otherwise(n * 26 + F.ascii(c) - 96)) - 1)
    make = lambda action, n, at: F.struct(action.alias("action"), (n.try_cast("int") - 1).alias("source"), at.cast("int").alias("passage"))
    fits = lambda n: n.try_cast("int").between(F.lit(1), count)
    return F.when((verb != "") & spaced & fits(number), make(F.when(verb.startswith("e"), "edit").otherwise("details"), number, F.lit(0))).when((source != "") & fits(source), make(F.lit("open"), source, passage))
