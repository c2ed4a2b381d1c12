"""Bibliographic metadata: casing, extraction from text, quality, merging. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import clean, squeezed

_ACRONYMS = tuple("ABM ACM AI AIDS API CPU DNA DOI GPU HIV HTML HTTP IEEE LLM LLMS ML NLP PDF PNAS RNA SARS URL XML".split())
_SMALL = tuple("a an and as at but by for from in into nor of on or over the to v via vs with without".split())
_CONNECTORS = tuple("and de del der di du la le van von".split())
_TOKEN = r"([A-Za-z]+(?:'[A-Za-z]+)?|[^A-Za-z]+)"
_ROMAN = "^[IVXLCDM]+$"


def _share_upper(c: Column) -> tuple[Column, Column]:
    letters = F.regexp_count(c, F.lit(r"\p{L}"))
    return letters, F.regexp_count(c, F.lit(r"\p{Lu}")) / F.nullif(letters, F.lit(0))


def _capital(w: Column) -> Column:
    return F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1_000_000)))


def title_case(c: Column) -> Column:
    """Titles in capitals throughout get title case, others stay: acronyms and Roman numbers are kept, small words
    between the first and the last one are lower-cased."""
    value = clean(c)
    letters, share = _share_upper(value)
    tokens = F.regexp_extract_all(value, F.lit(_TOKEN), 1)
    places = F.filter(F.transform(tokens, lambda t, i: F.when(t.rlike("^[A-Za-z]"), i)), lambda i: i.isNotNull())
    first, last = F.array_min(places), F.array_max(places)

    def word(t: Column, i: Column) -> Column:
        return (
            F.when(~t.rlike("^[A-Za-z]"), t)
            .when(F.upper(t).isin(*_ACRONYMS) | F.upper(t).rlike(_ROMAN), F.upper(t))
            .when((i != first) & (i != last) & F.lower(t).isin(*_SMALL), F.lower(t))
            .otherwise(_capital(t))
        )

    return F.when((letters >= 4) & (share >= 1), F.array_join(F.transform(tokens, word), "")).otherwise(value)


def name_case(c: Column) -> Column:
    """Author strings that are in capitals for three quarters and more get name case; connecting words are lower-cased."""
    value = clean(c)
    letters, share = _share_upper(value)
    tokens = F.regexp_extract_all(value, F.lit(_TOKEN), 1)

    def word(t: Column) -> Column:
        return (
            F.when(~t.rlike("^[A-Za-z]"), t)
            .when(F.lower(t).isin(*_CONNECTORS), F.lower(t))
            .when(F.upper(t).isin(*_ACRONYMS) | F.upper(t).rlike(_ROMAN), F.upper(t))
            .otherwise(F.array_join(F.transform(F.split(t, "'"), _capital), "'"))
        )

    return F.when((letters >= 2) & (share >= 0.75), F.array_join(F.transform(tokens, word), "")).otherwise(value)


def best_doi(text: Column) -> Column:
    """The DOI of a text: from a resolver link before a bare one, then the longest, then the last in order."""
    def cleaned(x: Column) -> Column:
        bare = F.regexp_replace(F.replace(F.replace(x, F.lit("\u200b"), F.lit("")), F.lit("\ufeff"), F.lit("")), "(?i)^https?://(?:dx\\.)?doi\\.org/", "")
        return F.regexp_replace(F.split(bare, "/-/")[0], r"[.,;:)\]}'\"]+$", "")

    def found(pattern: str, rank: int) -> Column:
        raw = F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), cleaned)
        kept = F.filter(raw, lambda x: x.rlike(r"(?i)^10\.[^/]*/.*\d"))
        return F.transform(kept, lambda x: F.struct(F.lit(rank).alias("link"), F.length(x).alias("n"), x.alias("doi")))

    body = r"""(10\.\d{4,9}/[^\s<>'"]+)"""
    return F.array_max(F.concat(found(rf"(?i)https?://(?:dx\.)?doi\.org/{body}", 1), found(rf"\b{body}", 0)))["doi"]


_MONTH = "(?:apr|aug|dec|feb|jan|jul|jun|mar|may|nov|oct|sept?)"
_YEAR = r"(19\d{2}|20\d{2})\b"


def best_year(text: Column) -> Column:
    """A year after a month, before "ACM" or after a copyright sign, in this order; else the latest from 1900 to 2099."""
    picks = [F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in (rf"(?i)\b{_MONTH}[a-z]*\s+{_YEAR}", rf"(?i)\b{_YEAR}\s+ACM\b", rf"©\s*{_YEAR}")]
    return F.coalesce(*picks, F.array_max(F.regexp_extract_all(text, F.lit(rf"\b{_YEAR}"), 1))).cast("int")


def first_lines(text: Column, limit: int = 20) -> Column:
    return F.slice(F.filter(F.transform(F.split(text, "\\R"), squeezed), lambda x: x != ""), 1, limit)


def is_header_noise(line: Column) -> Column:
    low = F.lower(line)
    return (F.length(line) <= 3) | low.rlike(r"^https?://|doi:|^doi |^copyright|^©|^(?:abstract|introduction)$|^\d+$")


def is_affiliation(line: Column) -> Column:
    return F.lower(line).rlike("@|college|department|faculty|institute|laboratory|school|university")


_OPEN_END = "(?i)(?:^|[^a-z])(?:" + "|".join("a an and as for from in of on or the to with without".split()) + ")[^a-z]*$"


def _continues(before: Column, line: Column) -> Column:
    fits = ~is_header_noise(line) & ~is_affiliation(line) & F.length(line).between(4, 160)
    return fits & (before.rlike(_OPEN_END) | before.endswith("-"))


def title_block(text: Column) -> Column:
    """struct(at, stop) of the title's lines among the first twenty: from the first substantial line on, as long as
    a line ends as if it went on. At is null without one."""
    lines = first_lines(text)
    seed = F.struct(F.lit(None).cast("int").alias("at"), F.lit(None).cast("int").alias("stop"), F.lit("").alias("before"), F.lit(0).alias("i"))

    def step(s: Column, line: Column) -> Column:
        starts = s["at"].isNull() & ~is_header_noise(line) & (F.length(line) >= 8)
        goes_on = s["at"].isNotNull() & (s["stop"] == s["i"]) & _continues(s["before"], line)
        grow = starts | goes_on
        return F.struct(F.when(starts, s["i"]).otherwise(s["at"]).alias("at"), F.when(grow, s["i"] + 1).otherwise(s["stop"]).alias("stop"), line.alias("before"), (s["i"] + 1).alias("i"))

    return F.aggregate(lines, seed, step)


def title_guess(lines: Column, block: Column) -> Column:
    return F.when(block["at"].isNotNull(), title_case(F.array_join(F.slice(lines, block["at"] + 1, block["stop"] - block["at"]), " ")))


def authors_guess(lines: Column, block: Column) -> Column:
    """The line after the title, unless it is noise, an abstract, an affiliation or too long for names."""
    line = F.get(lines, block["stop"])
    return F.when(~is_header_noise(line) & ~F.lower(line).contains("abstract") & ~is_affiliation(line) & (F.length(line) <= 200), name_case(line))


def filename_title_year(path: Column) -> tuple[Column, Column]:
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")
    words = squeezed(F.regexp_replace(stem, "[_-]+", " "))
    year = best_year(words)
    bare = F.when(year.isNull(), words).otherwise(squeezed(F.regexp_replace(words, r"\b(?:19|20)\d{2}\b", "")))
    return title_case(bare), year


BAD_TITLES = ("document", "final", "layout", "manuscript", "microsoft word", "proof", "untitled")
BAD_AUTHORS = ("admin", "administrator", "anonymous", "author", "authors", "microsoft word", "pdf", "unknown", "unknown author", "user", "windows user")


def is_bad_title(c: Column) -> Column:
    t = clean(c)
    return t.isNull() | t.rlike(r"\.(?:docx?|pdf)$") | F.lower(t).rlike("|".join(BAD_TITLES))


def is_storage_junk(c: Column) -> Column:
    t = clean(c)
    stem = F.regexp_replace(t, r"(?<=.)\.[^.]*$", "")
    return t.isNull() | F.lower(t).endswith(".pdf") | t.rlike(r"[/\\]") | stem.rlike("^[A-Z0-9]{8}$") | ((F.length(stem) <= 12) & stem.rlike(r"^(?:[A-Za-z]{2,}\d{2,}|[A-Z0-9_-]{4,16})$"))


def is_bad_authors(c: Column) -> Column:
    t = clean(c)
    return t.isNull() | F.lower(t).isin(*BAD_AUTHORS) | is_storage_junk(c) | t.rlike(r"^10\.\d{4,9}/") | (F.length(t) > 300)


def is_bad_year(c: Column) -> Column:
    return ~F.coalesce(c.between(1800, 2100), F.lit(False))


def metadata_complaints(title: Column, authors: Column, year: Column) -> Column:
    """The reasons to refresh a document's metadata, in a fixed order; none for a good one."""
    reasons = F.array(
        F.when(is_bad_title(title), "bad title").when(is_storage_junk(title), "title is a file name"),
        F.when(is_bad_authors(authors), "bad authors"),
        F.when(is_bad_year(year), "bad year"),
    )
    return F.filter(reasons, lambda r: r.isNotNull())


def refreshed(old: Column, new: Column, bad: Column, replace_all: bool) -> Column:
    """The new value where it exists, differs and the old one is bad (or all are to be replaced); else null."""
    allowed = F.lit(True) if replace_all else bad
    return F.when(new.isNotNull() & allowed & ~new.eqNullSafe(old), new)


def first_of(*values: Column) -> Column:
    """The first value that says something; empty strings and the year 0 count as missing."""
    return F.coalesce(*[F.when(~v.cast("string").isin("", "0"), v) for v in values])


WORK = "struct<title:array<string>,DOI:string,author:array<struct<given:string,family:string,name:string>>,`published-print`:struct<`date-parts`:array<array<int>>>,`published-online`:struct<`date-parts`:array<array<int>>>,published:struct<`date-parts`:array<array<int>>>,issued:struct<`date-parts`:array<array<int>>>,created:struct<`date-parts`:array<array<int>>>,deposited:struct<`date-parts`:array<array<int>>>>"


def registry_record(json: Column) -> Column:
    """struct(title, authors, year, doi) of a registry's JSON record; anything unreadable is null."""
    w = F.from_json(json, WORK)

    def person(a: Column) -> Column:
        given, family = name_case(a["given"]), name_case(a["family"])
        return F.coalesce(F.concat(given, F.lit(" "), family), family, given, name_case(a["name"]))

    names = F.filter(F.transform(w["author"], person), lambda x: x.isNotNull())
    year = F.coalesce(*[F.get(F.get(w[k]["date-parts"], F.lit(0)), F.lit(0)) for k in ("published-print", "published-online", "published", "issued", "created", "deposited")])
    return F.struct(title_case(F.get(w["title"], F.lit(0))).alias("title"), F.nullif(F.array_join(names, ", "), F.lit("")).alias("authors"), year.alias("year"), clean(w["DOI"]).alias("doi"))


FIELDS = ("title", "authors", "year", "doi")


def merged_record(*records: Column) -> Column:
    """struct of title, authors, year, doi: each field from the first record that has it; titles and authors cleaned.

    Records go in the order registry, embedded, first pages, file name. Empty text and year 0 count as missing.
    """
    from lectern.functions.text import clean

    fields = {name: first_of(*[r[name] for r in records]) for name in FIELDS}
    return F.struct(*[(clean(c) if name in ("title", "authors") else c).alias(name) for name, c in fields.items()])


def record_updates(old: Column, new: Column, replace_all: bool) -> Column:
    """struct of the fields of a proposed record that change the old one: bad ones, or all that differ if ``replace_all``."""
    bad = {"title": is_bad_title(old["title"]), "authors": is_bad_authors(old["authors"]), "year": is_bad_year(old["year"]), "doi": F.coalesce(F.trim(old["doi"]), F.lit("")) == ""}
    return F.struct(*[refreshed(old[name], new[name], bad[name], replace_all).alias(name) for name in FIELDS])
