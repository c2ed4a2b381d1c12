"""Reference lists: whether a chunk is bibliography rather than prose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import is_reference_title, missing, squeezed

_NAME = "[A-Z][A-Za-zÀ-ÖØ-öø-ÿ.'’-]+"
#: Words of venues and publishers, in alphabetical order.
VENUES = tuple(" arxiv:| cambridge university press| doi| elsevier| journal of | nature | oxford university press| physical review | pp. | proc. | proceedings of | science | springer| vol. ".split("|"))


def looks_like_references(text: Column) -> Column:
    """Three entries of a numbered or bracketed list; or one, or a year in parentheses, and three venue words.

    Entries are counted at line starts. A list that extraction folded into one line adds one
    entry at most, because what follows the first one belongs to it.
    """
    flat = squeezed(text)
    lines = F.filter(F.transform(F.split(text, "\\R"), lambda x: F.trim(x)), lambda x: x != "")
    folded = F.transform(F.regexp_extract_all(flat, F.lit(rf"(?:^|\s)(\[\d+\]\s+{_NAME}.{{20,}})"), 1), lambda x: F.trim(x))
    units = F.concat(lines, folded)
    bracketed = F.size(F.filter(units, lambda u: F.regexp(u, F.lit(rf"^\[\d+\]\s+{_NAME}"))))
    numbered = F.size(F.filter(units, lambda u: F.regexp(u, F.lit(rf"^\d+\.\s+{_NAME}"))))
    padded = F.concat(F.lit(" "), F.lower(flat), F.lit(" "))
    signals = sum((F.when(F.contains(padded, F.lit(v)), 1).otherwise(0) for v in VENUES), F.lit(0))
    marked = (bracketed > 0) | (numbered > 0) | flat.rlike(r"\(\d{4}\)")
    return F.coalesce((bracketed >= 3) | (numbered >= 3) | (marked & (signals >= 3)), F.lit(False))


def is_reference_chunk(section_title: Column, text: Column) -> Column:
    """A section's title decides; the text is looked at only where there is none."""
    return F.when(is_reference_title(section_title), True).when(~missing(section_title), False).otherwise(looks_like_references(text))
