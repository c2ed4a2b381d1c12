"""Headings in a line stream: what looks like one, what only seems to."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import section_key, squeezed

#: Titles that are headings wherever they stand alone. Corpora add their own through the parameter ``titles``.
COMMON = tuple(
    "abstract|acknowledgements|acknowledgments|analysis|appendices|appendix|background|bibliography|code and data availability|conclusion|conclusions|data"
    "|data, materials, and software availability|discussion|discussion and conclusion|ethical impact|experiment design|experimental design|future work|introduction|limitations"
    "|literature cited|literature review|materials and methods|method|methods|model|models|numerical simulation results|references|related work|results|simulation results"
    "|strategies|supplementary material|supporting information|theory|works cited".split("|")
)

_PLACES = "cent(?:er|re)|college|department|faculty|institute|lab|laboratory|program|school"
#: What starts like a heading and is none: links, rights, dates, venues, captions, addresses.
_NOT_HEADINGS = (
    r"^(?:https?://|www\.|doi\b|see http://www\.ieee\.org|e-?mail:|fax:|tel:)",
    r"^(?:©|copyright\b)|personal use is also permitted|republication/redistribution|ieee permission",
    r"^\(?(?:accepted|received)\b|^\(revised\b|^published\b|^(?:available in )?pmc\b|^as:$|^nih public access$|^(?:nih-pa )?author manuscript$",
    r"^(?:journal|proceedings) of\b|^(?:physical review|pnas|volume)\b|^(?:no|proc|vol)\.\b|^\d{3,}\s+volume\s+\d+,\s+\d{4}$|^pacs number",
    r"^(?:figure|table|fig\.)\s+\d+|^\d+(?:\s+of\s+\d+)?$|^significance$|^this article|^to whom correspondence\b|^corresponding author\b|^the authors declare\b",
    r"^(?:citation|editor|author affiliations):|^(?:author contributions|competing interests|data availability statement|funding)\b",
    r"^\d+\s+[a-z]\s+(?:and|or)\s+[a-z]\)|^\d+\.\s+[a-z]\.\s+|^[a-z]\.\s+(?:[a-z]\.\s+|[a-z].+?:|.+? et al\.:|(?:behav|biol|evol|hum|proc|rev|sci|soc|theor)\b)",
    rf"^(?:center|centre) for\b|^(?:college|department|faculty|institute|school|university) of\b|^\d+\s*(?:{_PLACES})\b|^\(?ministry of education\)?|^usa$|^canada\s+[a-z]\d[a-z]\s*\d[a-z]\d$",
    r"^[*†‡]",
)
NOT_HEADING = "(?i)" + "|".join(_NOT_HEADINGS)
_ADDRESS = tuple("beijing cambridge canada center centre china college department institute laboratory school university usa".split())


def is_bad_heading(line: Column) -> Column:
    """Blank lines, too."""
    return (squeezed(line) == "") | squeezed(line).rlike(NOT_HEADING)


def is_author_line(line: Column) -> Column:
    """Names with footnote marks in a list, numbered institutions, or two words of an address."""
    l = squeezed(line)
    words = F.array_distinct(F.regexp_extract_all(F.lower(l), F.lit("([a-z]+)"), 1))
    marked = l.rlike(r"\b[A-Z][A-Za-z.-]+[0-9,*†‡]") & (l.contains(",") | l.contains(" and "))
    return marked | l.rlike(rf"(?i)^\d+\s*(?:{_PLACES})\b") | (F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in _ADDRESS]))) >= 2)


_REST = r"\s+[A-Z][A-Za-z0-9 ,;:/()&-]+$"
NUMBERED = rf"^(?:[IVXLCDM]+\.?{_REST}|\d+(?:\.\d+)*\.?{_REST}|[A-Z]\.\s+[A-Z][A-Za-z0-9 ,;:/()&'-]+$)"


def is_numbered_heading(line: Column) -> Column:
    return squeezed(line).rlike(NUMBERED)


def is_heading(line: Column) -> Column:
    l = squeezed(line)
    return F.length(l).between(3, 120) & ~is_bad_heading(l) & ~is_author_line(l) & (section_key(l).isin(*COMMON) | is_numbered_heading(l))
