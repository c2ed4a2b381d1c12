"""Scalar text functions as Column expressions; none of them leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Glue words that a query ignores.
GLUE = tuple("a an and are as at be by for from how in into is it of on or that the their this to use using with".split())


def ascii_lower(c: Column) -> Column:
    """Fold A-Z only, as the store's case-insensitive matching does."""
    return F.translate(c, UPPER, LOWER)


def has_literal(c: Column, needle: str) -> Column:
    """Case-insensitive (ASCII) literal substring; percent signs and underscores mean themselves."""
    return F.coalesce(F.contains(ascii_lower(c), F.lit(needle.translate(str.maketrans(UPPER, LOWER)))), F.lit(False))


def squeezed(c: Column) -> Column:
    """White space runs become one blank, ends are trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


_LIGATURES = (("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬅ", "st"), ("ﬆ", "st"))


def normal_text(c: Column) -> Column:
    """Extracted text as it should read: lone surrogates go, control glyphs are brackets, ligatures letters; no blanks
    inside brackets or before punctuation."""
    out = F.translate(F.regexp_replace(c, r"\p{Cs}", ""), "\x01\x02\x03\x04\u00a0", "()[] ")
    for glyph, letters in _LIGATURES:
        out = F.replace(out, F.lit(glyph), F.lit(letters))
    return F.trim(F.regexp_replace(F.regexp_replace(squeezed(out), r"([(\[]) ", "$1"), r" ([)\],.;:])", "$1"))


def clean(c: Column) -> Column:
    """Squeezed, and null if nothing is left."""
    return F.nullif(squeezed(c), F.lit(""))


def missing(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def section_key(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"\s+", " "), r"[.:]+$", "")


REFERENCE_TITLES = ("bibliography", "literature cited", "references", "works cited")


def is_reference_title(c: Column) -> Column:
    return F.coalesce(section_key(c).isin(*REFERENCE_TITLES), F.lit(False))


def query_terms(c: Column) -> Column:
    """Distinct lower-case terms of two characters and more that aren't glue, in order of appearance."""
    raw = F.regexp_extract_all(c, F.lit(r"([A-Za-z0-9][A-Za-z0-9_'-]*)"), 1)
    bare = F.transform(raw, lambda t: F.lower(F.btrim(t, F.lit("_'-"))))
    return F.array_distinct(F.filter(bare, lambda t: (F.length(t) >= 2) & ~t.isin(*GLUE)))


def doi_key(c: Column) -> Column:
    """A DOI without URL or label, for matching; placeholders are null."""
    bare = F.btrim(squeezed(c), F.lit(" .,"))
    key = F.lower(F.btrim(F.regexp_replace(bare, r"(?i)^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)", ""), F.lit(" .,")))
    return F.when(~F.lower(bare).isin("", "none", "unknown", "n/a"), F.nullif(key, F.lit("")))


def title_key(c: Column) -> Column:
    """Letters and digits of a title, for matching; placeholders are null. Full case folding maps sharp s to ss."""
    low = F.replace(F.lower(squeezed(c)), F.lit("ß"), F.lit("ss"))
    return F.when(~low.isin("", "none", "unknown", "untitled", "(untitled)"), clean(F.regexp_replace(low, "[^a-z0-9]+", " ")))


def author_names(c: Column) -> Column:
    """Likely individual authors. Semicolons, ampersands and the word "and" separate, and so do commas."""
    text = F.trim(c)
    pieces = F.flatten(F.transform(F.split(text, r"(?i)\s*(?:;|\band\b|&)\s*"), lambda p: F.transform(F.split(p, ","), lambda q: F.trim(q))))
    return F.when(text.isNull() | F.lower(text).isin("", "none", "unknown", "anonymous"), F.array().cast("array<string>")).otherwise(F.filter(pieces, lambda p: p != ""))


_SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "phd", "ph.d")
_PARTICLES = ("da", "de", "del", "della", "der", "di", "du", "la", "le", "mac", "mc", "st", "ten", "ter", "van", "vander", "von")


def surname(c: Column) -> Column:
    """Best-effort surname: what stands before a comma, else the last word with the particles before it."""
    name = F.btrim(squeezed(c), F.lit(" ,"))
    name = F.when(F.contains(name, F.lit(",")), F.trim(F.split(name, ",")[0])).otherwise(name)
    name = squeezed(F.regexp_replace(name, r"\([^)]*\)", " "))
    tokens = F.filter(F.transform(F.split(name, " "), lambda t: F.btrim(t, F.lit(".,"))), lambda t: t != "")
    words = F.array_join(tokens, " ")
    words = F.regexp_replace(words, rf"(?i)(?:(?:^| )(?:{'|'.join(s.replace('.', '[.]') for s in _SUFFIXES)}))+$", "")
    found = F.regexp_extract(words, rf"((?:(?<![^ ])(?i:{'|'.join(_PARTICLES)}) )*[^ ]+)$", 1)
    return F.when(~found.rlike(r"^[A-Z]\.?$"), F.nullif(found, F.lit("")))


def parsed_heading(c: Column) -> Column:
    """struct(number, title) of a visible heading: decimal, Roman or single-letter numbers."""
    h = squeezed(c)
    out = F.struct(F.lit(None).cast("string").alias("number"), F.nullif(h, F.lit("")).alias("title"))
    for pattern in (r"^([A-Z])\.[ ]+(.+)$", r"^([IVXLCDM]+)\.?[ ]+(.+)$", r"^(\d+(?:\.\d+)*\.?)[ ]+(.+)$"):
        hit = F.struct(F.nullif(F.rtrim(F.regexp_extract(h, pattern, 1), F.lit(".")), F.lit("")).alias("number"), F.nullif(F.regexp_extract(h, pattern, 2), F.lit("")).alias("title"))
        out = F.when(h.rlike(pattern), hit).otherwise(out)
    return out


def repetition_key(c: Column) -> Column:
    """A margin line's key: digit runs are one mark, other non-letters blanks."""
    return squeezed(F.regexp_replace(F.regexp_replace(F.lower(c), r"\d+", "#"), r"[^a-z#]+", " "))


def page_label(start: Column, end: Column) -> Column:
    """p. n, pp. a–b, or null without either; one missing side counts as equal."""
    a, b = F.coalesce(start, end), F.coalesce(end, start)
    return F.when(a.isNull(), None).when(a == b, F.concat(F.lit("p. "), a.cast("string"))).otherwise(F.concat(F.lit("pp. "), a.cast("string"), F.lit("–"), b.cast("string")))


def trimmed(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.rtrim(F.left(c, F.lit(n))), F.lit(" [...]"))).otherwise(c)


def section_label(number: Column, title: Column, index: Column) -> Column:
    """Number and title of a section, whichever there are; else "section n", counted from 1; null without any."""
    named = F.concat_ws(" ", F.nullif(F.trim(number), F.lit("")), F.nullif(F.trim(title), F.lit("")))
    return F.coalesce(F.nullif(named, F.lit("")), F.concat(F.lit("section "), (index + 1).cast("string")))


def distance_label(distance: Column) -> Column:
    return F.when(distance.isNotNull(), F.format_string("%.4f", distance.cast("double")))


def plain_line(c: Column) -> Column:
    """A line without Markdown decoration; list markers stay."""
    out = F.regexp_replace(c, r"^\s{0,3}#{1,6}\s+", "")
    for pattern in (r"\*\*([^*]+)\*\*", "__([^_]+)__", "`([^`]+)`"):
        out = F.regexp_replace(out, pattern, "$1")
    return F.trim(out)


def plain_summary(c: Column) -> Column:
    """Paragraphs of plain lines, an empty line between them; blank lines and paragraphs go."""
    full = lambda a: F.filter(a, lambda x: x != "")
    parts = F.transform(F.split(F.trim(c), r"\n\s*\n"), lambda p: F.array_join(full(F.transform(F.split(p, "\n"), lambda line: plain_line(line))), "\n"))
    return F.array_join(full(parts), "\n\n")


def human_join(items: Column) -> Column:
    """a; a and b; a, b, and c. Empty items are left out."""
    kept = F.filter(items, lambda x: x.isNotNull() & (x != ""))
    n, last = F.size(kept), F.element_at(kept, -1)
    head = F.slice(kept, 1, F.greatest(n - 1, F.lit(1)))
    return F.when(n == 0, "").when(n == 1, F.get(kept, F.lit(0))).when(n == 2, F.array_join(kept, " and ")).otherwise(F.concat(F.array_join(head, ", "), F.lit(", and "), last))


_TELLS = "discusses|describes|explains|shows|argues|mentions|covers|focuses on|relates to"


def explanation(c: Column) -> Column:
    """A judgment's explanation without its lead-in ("This passage explains"), beginning in upper case."""
    bare = F.regexp_replace(squeezed(c), rf"(?i)^(?:the|this)\s+(?:chunk|passage|excerpt|text)\s+(?:{_TELLS}|is about)\s+", "")
    bare = F.trim(F.regexp_replace(bare, rf"(?i)^(?:{_TELLS})\s+", ""))
    return F.concat(F.upper(F.left(bare, F.lit(1))), F.substring(bare, F.lit(2), F.length(bare)))


def judgment(raw: Column) -> Column:
    """struct(relevant, relevance, answers_query, missing_concepts, explanation, error) of a model's JSON answer.

    The label decides: only "strong" is relevant. Without a label its own flags count.
    """
    body = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    j = F.from_json(body, "relevance string, relevant string, answers_query string, missing_concepts string, explanation string")
    label = F.lower(F.trim(j["relevance"]))
    known = F.when(label.isin("strong", "partial", "weak", "none"), label)
    flag = lambda c: F.when(c.isin("true", "false"), c == "true")
    listed = F.from_json(j["missing_concepts"], "array<string>")
    concepts = F.coalesce(F.filter(F.transform(listed, squeezed), lambda x: x != ""), F.array().cast("array<string>"))
    told = explanation(F.nullif(F.trim(j["explanation"]), F.lit("")))
    read = j.isNotNull() & (body != "")
    error = F.when(~F.coalesce(read, F.lit(False)), "no JSON in the answer").when(told.isNull(), "no explanation")
    return F.struct(
        F.coalesce(known == "strong", flag(j["relevant"])).alias("relevant"), known.alias("relevance"), F.coalesce(flag(j["answers_query"]), known == "strong").alias("answers_query"),
        concepts.alias("missing_concepts"), F.coalesce(told, F.lit("no usable judgment")).alias("explanation"), error.alias("error"),
    )
