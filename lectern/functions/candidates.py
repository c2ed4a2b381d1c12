"""Heading candidates in messy lines: what may be a heading, the part of the line that is one, and what only looks so.

All are Column expressions over whole texts; none leaves the JVM.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.headings import COMMON, is_author_line, is_bad_heading
from lectern.functions.text import squeezed

_LABELS = "NIH-PA|NIH PA|Author|Manuscript"
_STOP = tuple("a an and as at by for from in into of on or the to under via with without".split())
_TITLE = r"[A-Z][A-Za-z0-9 ,;:/()&'’-]+"
#: Titles that may stand at the end of a line of prose, where columns were glued.
CLOSING = ("acknowledgements", "acknowledgments", "appendices", "appendix", "bibliography", "data, materials, and software availability", "discussion", "materials and methods", "references", "results")
#: Titles that need no number to be a heading at the start of a line.
OPENING = ("abstract", "acknowledgements", "acknowledgments", "appendices", "appendix", "bibliography", "code and data availability", "ethical impact", "literature cited", "references", "works cited")
#: Titles that start many a sentence; alone they are no heading.
WEAK = ("analysis", "behavioral dimensions", "model", "models", "prompting", "strategies")


def _any_of(titles: tuple[str, ...]) -> str:
    """The titles as one pattern, the longest first."""
    return "|".join(re.escape(t).replace(r"\ ", r"\s+").replace("'", "['’]") for t in sorted(titles, key=lambda t: (-len(t), t)))


def unglued(c: Column) -> Column:
    """Without the margin labels that extraction glues to words, and without those at the end."""
    out = F.regexp_replace(squeezed(c), rf"(?<=[A-Za-z])(?:{_LABELS})(?=\s|$)", " ")
    return squeezed(F.regexp_replace(squeezed(out), rf"(?:\s*(?:{_LABELS}))+$", ""))


def known_prefix(c: Column, titles: tuple[str, ...] = COMMON) -> Column:
    """The longest common title that a text starts with, as it is written there; null if none."""
    return F.nullif(F.regexp_extract(squeezed(c), rf"(?i)^({_any_of(titles)})(?=$|\s|[.:;,-])", 1), F.lit(""))


def title_words(c: Column, most: int, stop: tuple[str, ...] = _STOP) -> Column:
    """The words up to the first that neither begins like a title's nor may stand within one."""

    def step(state: Column, word: Column) -> Column:
        bare = F.btrim(word, F.lit("()[]{}.,;:"))
        fits = bare.rlike(r"^[\p{Lu}\p{Lt}\d]") | F.lower(bare).isin(*stop) | (F.size(state["kept"]) == 0)
        done = state["done"] | (F.size(state["kept"]) >= most) | ((bare != "") & ~fits)
        return F.struct(F.when(done | (bare == ""), state["kept"]).otherwise(F.array_append(state["kept"], word)).alias("kept"), done.alias("done"))

    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("done"))
    return F.array_join(F.aggregate(F.split(c, " "), start, step)["kept"], " ")


def lettered_heading(c: Column, titles: tuple[str, ...] = COMMON, bare: Column | None = None) -> Column:
    """The heading that a line such as "B. Results of the gameManuscript We study" starts with; null if it has none.

    ``bare`` may give the line without its glued labels, if a column of that is there.
    """
    line = unglued(c) if bare is None else bare
    number, rest = F.regexp_extract(line, r"^([A-Z])\.\s+(.+)$", 1), F.regexp_extract(line, r"^([A-Z])\.\s+(.+)$", 2)
    title = F.coalesce(squeezed(known_prefix(rest, titles)), F.nullif(title_words(rest, 12), F.lit("")))
    return F.when((number != "") & ~_bad(line), F.concat(number, F.lit(". "), title))


def common_prefix(c: Column, titles: tuple[str, ...] = COMMON) -> Column:
    line = squeezed(c)
    return F.when(line.rlike(r"^\p{Lu}"), known_prefix(line, titles))


def embedded_headings(c: Column, titles: tuple[str, ...] = COMMON) -> Column:
    """Headings within a line: numbered common titles, Roman ones, and common titles at its end.

    A number after "figure" or "equation" is a reference, no heading.
    """
    line = squeezed(c)

    def numbered(number: str) -> Column:
        pattern = F.lit(rf"(?i)(?<![\w.])(?<!(?:fig|figure|eq|equation)\.?\s?)({number})\.?\s+({_any_of(titles)})(?=$|\s|[.:;,\-])")
        return F.zip_with(F.regexp_extract_all(line, pattern, 1), F.regexp_extract_all(line, pattern, 2), lambda n, t: F.concat(n, F.lit(" "), squeezed(t)))

    last = squeezed(F.regexp_extract(line, rf"(?i)(?<![A-Za-z])({_any_of(CLOSING)})[.:]?\s*$", 1))
    return F.array_distinct(F.filter(F.concat(numbered(r"\d+(?:\.\d+)*"), numbered("[IVXLCDM]+"), F.array(last)), lambda x: x != ""))


def _bad(line: Column) -> Column:
    return (line == "") | is_bad_heading(line)


def is_numbered_candidate(c: Column, bare: Column | None = None) -> Column:
    """A number, Roman or decimal, or a letter, and a title: whatever comes after. Broader than a numbered heading."""
    line = unglued(c) if bare is None else bare
    return F.length(line).between(3, 220) & ~_bad(line) & ~is_author_line(line) & line.rlike(rf"^(?:[IVXLCDM]+\.?|\d+(?:\.\d+)*\.?|[A-Z]\.)\s+{_TITLE}")


def starts_common(c: Column) -> Column:
    return squeezed(c).rlike(rf"(?i)^(?:{_any_of(OPENING)})(?=$|\s|[.:;,-])")


def is_candidate(c: Column, titles: tuple[str, ...] = COMMON, bare: Column | None = None, embedded: Column | None = None) -> Column:
    """Whether a line may be or hold a heading. Prefers to find too many."""
    line = squeezed(c)
    within = embedded_headings(line, titles) if embedded is None else embedded
    return F.length(line).between(3, 220) & ~_bad(line) & ~is_author_line(line) & (starts_common(line) | is_numbered_candidate(line, bare) | (F.size(within) > 0))


# ---- the heading within a candidate --------------------------------------------------------


def clean_prefix(c: Column, titles: tuple[str, ...] = COMMON) -> Column:
    """A line's best guess at its heading: number and common title, a run of capitals after a Roman number, or the words
    that look like a title; else the line."""
    line, out = unglued(c), None
    known = _any_of(titles)
    stop = (*_STOP, "vs")
    for number, dot, roman in ((r"[IVXLCDM]+", "", True), (r"\d+(?:\.\d+)*", "", False), (r"[A-Z]", ".", False)):
        shape = rf"^({number})\.?\s+(.+)$" if not dot else rf"^({number})\.\s+(.+)$"
        n, rest = F.regexp_extract(line, shape, 1), F.regexp_extract(line, shape, 2)
        title = F.nullif(F.regexp_extract(rest, rf"(?i)^({known})" + (r"(?=\s|$)" if dot else ""), 1), F.lit(""))
        if roman:
            other = F.nullif(squeezed(F.regexp_extract(rest, r"^([A-Z][A-Z0-9&/,\- ]{2,})(?:\s+[a-z].*)?$", 1)), F.lit(""))
        else:
            other = F.nullif(unglued(title_words(rest, 10, stop)), F.lit(""))
        found = F.when(n != "", F.concat(n, F.lit(f"{dot} "), squeezed(F.coalesce(title, other))))
        out = found if out is None else F.coalesce(out, found)
    return F.coalesce(out, line)


def level(c: Column) -> Column:
    """How deep a heading is: 3 for a letter, 2 for a decimal number, 1 for a plain or Roman one, 0 without."""
    line = squeezed(c)
    return F.when(line.rlike(r"^[A-Z]\.\s+"), 3).when(line.rlike(r"^\d+(?:\.\d+)+\s+"), 2).when(line.rlike(r"^(?:\d+|[IVXLCDM]+)\.?\s+"), 1).otherwise(0)


def reads_like_heading(c: Column, titles: tuple[str, ...] = COMMON) -> Column:
    """A common title that isn't a weak one, or a number from 1 to 50 that doesn't end in .0 with a title in upper case."""
    line = squeezed(c)
    low = F.btrim(F.lower(line), F.lit(" .:"))
    number = F.regexp_extract(line, r"^(\d+(?:\.\d+)*)\.?\s+(.+)$", 1)
    upper = F.regexp_extract(line, r"^(\d+(?:\.\d+)*)\.?\s+(.+)$", 2).rlike(r"^\p{Lu}")
    first = F.split(number, r"\.")[0].try_cast("int")
    decimal = (number != "") & first.between(1, 50) & ~number.endswith(".0") & upper
    return F.coalesce(F.when(line == "", False).when(low.isin(*titles), ~low.isin(*WEAK)).otherwise(decimal | line.rlike(rf"^(?:[IVXLCDM]+\.?|[A-Z]\.)\s+{_TITLE}$")), F.lit(False))


# ---- what isn't one ------------------------------------------------------------------------


def is_running_head(c: Column) -> Column:
    """Page numbers, volume lines, "a. author: title", proceedings with a page."""
    return F.lower(squeezed(c)).rlike(r"^(?:\d{3,}\s+volume\s+\d+,\s+\d{4}|volume\s+\d+,\s+\d{4}\s+\d{3,}|\d{1,5}|[a-z]\.\s+.+?:\s+.+|proceedings of .+\s+\d{1,5})$")


LEGENDS = ("gpt", "llama")
FIGURE_WORDS = ("accuracy", "comprehension", "confidence", "figure", "fig.", "model", "models", "pcoop", "response", "round", "rules", "sfem", "state", "table", "time", "window")


def is_chart_debris(c: Column, context: Column) -> Column:
    """Axis and legend labels: a number such as 0.2 or 1.0 with a label that names a model, or with figure words around;
    any short label after a decimal number with three of those."""
    line, around = squeezed(c), F.lower(squeezed(context))
    signals = sum((F.when(F.contains(around, F.lit(w)), 1).otherwise(0) for w in FIGURE_WORDS), F.lit(0))
    named = F.lower(line).rlike("|".join(LEGENDS))
    return (line.rlike(r"^(?:0(?:\.\d+)?|1\.0)\s+[A-Za-z0-9.]+$") & (named | (signals >= 2))) | (line.rlike(r"^\d+\.\d+\s+\S{2,12}$") & (signals >= 3))


_NAME = r"[A-Z][A-Za-zÀ-ÖØ-öø-ÿ'’\-]+"
#: What journals, publishers and indexes are called in reference lists.
SOURCES = (
    "pubmed", "doi", "science", "nature", "phys rev", "physical review", "proc natl acad sci", "proc. natl. acad. sci", "pnas", "theor biol", "j. theor. biol", "ecol lett", "biol lett", "new j phys",
    "europhys lett", "epl", "complexity", "am j phys", "university press", "basic books", "vol.", "ibid",
)


def _cites(c: Column) -> Column:
    return F.lower(c).rlike("|".join(re.escape(s) for s in SOURCES)) | c.rlike(r"\b(?:19|20)\d{2};\s*\d+")


def is_numbered_reference(c: Column) -> Column:
    """A number and bibliographic evidence: a source, year;volume, a publisher with a year, or an author with a year."""
    line = squeezed(c)
    year = line.rlike(r"\b(?:19|20)\d{2}\b")
    return line.rlike(r"^\d+\.?\s+") & (_cites(line) | (year & F.lower(line).rlike(r"\b(?:press|books|publisher|university)\b")) | (year & line.rlike(rf"^\d+\.?\s+{_NAME}(?:\s+[A-Z]{{1,4}}\.)?(?:,|\.)\s+")))


def is_reference_fragment(c: Column) -> Column:
    line = squeezed(c)
    return _cites(line) | (line.rlike(rf"^{_NAME}\s+[A-Z]{{1,4}},\s+{_NAME}") & line.rlike(r"\b(?:19|20)\d{2}\b"))


def is_reference_candidate(text: Column, raw: Column) -> Column:
    """Of a candidate: its text or its line is a numbered reference, or the line has a number and the text is part of one."""
    return is_numbered_reference(text) | is_numbered_reference(raw) | (squeezed(raw).rlike(r"^\d+\.?\s+") & is_reference_fragment(text))
