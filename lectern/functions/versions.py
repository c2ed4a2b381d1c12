"""Versions of what is derived from a document: chunkers, and fingerprints of the whole text pipeline."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Of each component of the pipeline the version that is current.
CURRENT = {"fingerprint": "text-v1", "extractor": "layout-v2", "sectioner": "rules-v2", "llm_sectioner": "review-v1", "chunker": "section-aware-v2"}
#: What a fingerprint holds besides: choices made for one document. They don't make it stale.
CHOICES = ("sectioning_mode", "reviewed_headings")


def chunker_version(target: int = 2000) -> str:
    return f"section-aware-fixed-char-{target}-v2"


def legacy_version(target: int = 2000) -> str:
    return f"word-aware-fixed-char-{target}-v1"


def headings_hash(headings: Column) -> Column:
    """Sixteen digits of a hash of the reviewed headings, squeezed and in lower case; "none" where there is no review."""
    low = F.transform(headings, lambda h: F.lower(F.trim(F.regexp_replace(h, r"\s+", " "))))
    return F.when(headings.isNull(), "none").otherwise(F.left(F.sha2(F.array_join(low, "\n"), 256), F.lit(16)))


def sectioning_mode(headings: Column, use_llm: Column) -> Column:
    return F.when(headings.isNotNull(), "reviewed").when(use_llm, "llm-assisted").otherwise("rules-based")


def fingerprint(headings: Column, use_llm: Column, target: Column, **versions: Column) -> Column:
    """key=value parts in their order; versions of components may be given instead of the current ones."""
    part = lambda key, value: F.concat(F.lit(f"{key}="), value)
    of = {key: versions.get(key, F.lit(value)) for key, value in CURRENT.items()}
    chosen = {"sectioning_mode": sectioning_mode(headings, use_llm), "reviewed_headings": headings_hash(headings)}
    order = ["fingerprint", "extractor", "sectioner", "llm_sectioner", *CHOICES, "chunker"]
    return F.concat_ws(";", *[part(key, (of | chosen)[key]) for key in order], part("target_chars", target.cast("string")))


def index_fingerprint(target: int = 2000, encoding: str = "labelled-v1") -> str:
    """Names the vector index: without the choices made for single documents."""
    kept = {key: CURRENT[key] for key in ("extractor", "sectioner", "llm_sectioner", "chunker")}
    return ";".join(f"{key}={value}" for key, value in ({"index": "vectors-v1"} | kept | {"target_chars": str(target), "embedding_input": encoding}).items())


def part_of(print_: Column, key: str) -> Column:
    """A part's value, the last one if it is there twice; null if it isn't."""
    found = F.filter(F.split(print_, ";"), lambda p: p.startswith(f"{key}="))
    return F.when(F.size(found) > 0, F.substring(F.element_at(found, -1), F.lit(len(key) + 2), F.length(print_)))


def is_current(print_: Column, target: int = 2000) -> Column:
    """Whether the components that matter are the current ones. Not equality: choices for a document may differ."""
    out = F.lit(True)
    for key, value in (CURRENT | {"target_chars": str(target)}).items():
        out = out & (part_of(print_, key) == value)
    return F.coalesce(out, F.lit(False))
