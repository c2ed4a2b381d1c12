"""Finding an excerpt again: match tokens, exact and fuzzy spans on a page, words and windows worth marking; the default encoder."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Callable
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import squeezed
from lectern.operators.evidence import context_window

_LIGATURES = str.maketrans({"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "­": None})
_NOT_TOKEN = re.compile("[^a-z0-9]+")


def match_token(word: str) -> str:
    """A word as it is matched: ligatures spelled out, compatibility forms folded, ASCII letters and digits only."""
    return _NOT_TOKEN.sub("", unicodedata.normalize("NFKC", word.translate(_LIGATURES)).lower())


def match_tokens(text: str) -> list[str]:
    return [t for t in map(match_token, text.split()) if t]


def tokens_of(c: Column) -> Column:
    """Match tokens of a text, those of punctuation alone left out; null for null."""
    return F.pandas_udf(lambda s: s.map(lambda t: None if t is None else match_tokens(t)), "array<string>")(c)


def exact_span(page: list[str], excerpt: list[str]) -> int:
    """Where the excerpt's tokens first stand in the page's, one after the other; -1 if nowhere."""
    n = len(excerpt)
    return next((i for i in range(len(page) - n + 1) if page[i : i + n] == excerpt), -1) if n and page else -1


def best_span(page: list[str], excerpt: list[str], least: float) -> tuple[int, int, float, str] | None:
    """The exact span, else of all windows of 75 % to 135 % of the excerpt's length the most similar, if similar enough; the first of equals."""
    at = exact_span(page, excerpt)
    if at >= 0:
        return at, at + len(excerpt), 1.0, "exact-token"
    n = len(excerpt)
    if not n or not page:
        return None
    low = max(1, int(n * 0.75))
    # windows with the bound on their ratio that the shared words give; the best bounds first, so few ratios are needed
    have = Counter(excerpt)
    bounds = []
    for size in range(low, min(len(page), max(low, int(n * 1.35) + 2)) + 1):
        seen, shared = Counter(), 0
        for at, word in enumerate(page):
            seen[word] += 1
            shared += seen[word] <= have[word]
            if at >= size:
                gone = page[at - size]
                shared -= seen[gone] <= have[gone]
                seen[gone] -= 1
            if at >= size - 1 and (bound := 2.0 * shared / (n + size)) >= least:
                bounds.append((-bound, size, at - size + 1))
    best: tuple[float, int, int] | None = None
    matcher = SequenceMatcher(a=excerpt, autojunk=False)
    for bound, size, start in sorted(bounds):
        if best is not None and (bound, size, start) > best:
            break
        matcher.set_seq2(page[start : start + size])
        score = matcher.ratio()
        if score >= least and (best is None or (-score, size, start) < best):
            best = (-score, size, start)
    return None if best is None else (best[2], best[2] + best[1], -best[0], "fuzzy-token")


def spans(pages: Column, excerpts: Column, least: float = 0.72) -> Column:
    """struct(start, end, score, method) of an excerpt (array of match tokens) on a page (the same); null without a match."""

    def find(page: pd.Series, excerpt: pd.Series) -> pd.DataFrame:
        got = [best_span(list(p), list(e), least) if p is not None and e is not None else None for p, e in zip(page, excerpt)]
        return pd.DataFrame([g or (None, None, None, None) for g in got], columns=["start", "end", "score", "method"]).astype({"start": "Int32", "end": "Int32", "score": "Float64"})

    found = F.pandas_udf(find, "start int, end int, score double, method string")(pages, excerpts)
    return found


def candidate_pages(start: Column, end: Column, count: Column, most: int = 4) -> Column:
    """Pages, from 1, on which a passage may stand: its own, within the document, four at most."""
    last = F.least(F.when(end.isNull() | (end < start), start).otherwise(end), count)
    first = F.greatest(F.lit(1), start)
    return F.when(first > last, F.array().cast("array<int>")).otherwise(F.sequence(first, F.least(last, first + (most - 1))))


def first_words(c: Column, least: int, most: int) -> Column:
    """The first words of a text, ``most`` of them (``least``, if that is more)."""
    return F.array_join(F.slice(F.split(squeezed(c), " "), 1, max(least, most)), " ")


def is_short_enough(tokens: Column, most: int = 120) -> Column:
    """Whether an excerpt may be matched as it is; a whole chunk would mark its beginning, not the passage."""
    return F.coalesce(F.size(tokens).between(1, most), F.lit(False))


def line_boxes(words: DataFrame) -> DataFrame:
    """(…, run, x0, y0, x1, y1): one box for each run of matched words (doc_id, page, at, block, line, corners) on one line, in the order of ``at``."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id", "page").orderBy("at")
    fresh = F.coalesce(~(F.col("block").eqNullSafe(F.lag("block").over(w)) & F.col("line").eqNullSafe(F.lag("line").over(w))) | (F.row_number().over(w) == 1), F.lit(True))
    runs = words.withColumn("fresh", fresh.cast("int")).withColumn("run", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return runs.groupBy("doc_id", "page", "run").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


#: Words that are never marked, besides those of three letters and fewer.
PLAIN = tuple("been being could does from have having here hers into might more most over should such than that their them then there these they this those through under were what when where which will with would your".split())
_MARKED = r"\b[A-Za-z][A-Za-z0-9'-]{2,}\b"


def content_words(c: Column) -> Column:
    """Words of four letters and more that say something, each once by its key, as first written, in order."""
    raw = F.regexp_extract_all(c, F.lit(_MARKED), 0)
    keyed = F.filter(F.transform(raw, lambda w: F.struct(F.lower(F.btrim(w, F.lit("'-"))).alias("key"), w.alias("word"))), lambda x: (F.length(x["key"]) >= 4) & ~x["key"].isin(*PLAIN))
    keys = F.transform(keyed, lambda x: x["key"])
    return F.transform(F.filter(F.transform(keyed, lambda x, i: F.struct(x["word"].alias("word"), (F.array_position(keys, x["key"]) == i + 1).alias("first"))), lambda x: x["first"]), lambda x: x["word"])


def marked_text(c: Column, tiers: Column, marks: dict[str, tuple[str, str]]) -> Column:
    """A text with its words put between the marks of their tier; ``tiers`` maps keys to red, yellow, bold. No tiers, no marks."""

    def put(texts: pd.Series, maps: pd.Series) -> pd.Series:
        pattern = re.compile(_MARKED)

        def one(text, tier):
            tier = dict(tier) if tier is not None else {}
            return text if text is None or not tier else pattern.sub(lambda m: "{1}{0}{2}".format(m[0], *marks.get(tier.get(m[0].lower().strip("'-")), ("", ""))), text)

        return pd.Series([one(t, m) for t, m in zip(texts, maps)], dtype=object)

    return F.pandas_udf(put, "string")(c, tiers)


def excerpt_around(c: Column, window: Column, most: int) -> Column:
    """``most`` characters around a window of the text, marked where text was left out; the beginning, if it isn't in it."""
    t = squeezed(c)
    n = F.length(t)
    at = F.instr(t, window)
    centre = at - 1 + F.floor(F.length(window) / 2)
    end = F.least(n, F.greatest(F.lit(0), centre - most // 2) + most)
    start = F.greatest(F.lit(0), end - most).cast("int")
    cut = F.concat(F.when(start > 0, "[...] ").otherwise(""), F.trim(F.substr(t, start + 1, (end - start).cast("int"))), F.when(end < n, " [...]").otherwise(""))
    return F.when(n <= most, t).when(F.coalesce(at, F.lit(0)) <= 0, context_window(c, None, most)).otherwise(cut)


# ---- the default encoder -------------------------------------------------------------------

Encoder = Callable[[list[str]], np.ndarray]
_TERM = re.compile("[a-z0-9]+")


def hashed_words(texts: list[str], dim: int = 64) -> np.ndarray:
    """Unit vectors of hashed word counts: deterministic, and without a model to fetch. Texts without a word are zero."""
    known: dict[str, int] = {}  # words by number
    words: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for row, text in enumerate(texts):
        found = _TERM.findall(text.lower())
        counts[row] = len(found)
        words += [known.setdefault(word, len(known)) for word in found]
    digests = [hashlib.md5(word.encode()).hexdigest() for word in known]
    at = np.array([int(d[:4], 16) % dim for d in digests], np.int64)
    sign = np.array([1.0 if int(d[4], 16) % 2 else -1.0 for d in digests])
    which = np.array(words, np.int64)
    out = np.bincount(np.repeat(np.arange(len(texts)) * dim, counts) + at[which], sign[which], len(texts) * dim).reshape(len(texts), dim)
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norms > 0, norms, 1)


def encoded(c: Column, encode: Encoder = hashed_words) -> Column:
    """Vectors of texts by an encoder, batch by batch; null for null."""

    def run(texts: pd.Series) -> pd.Series:
        has = texts.notna().to_numpy()
        made = iter(encode(texts[has].tolist()).astype(float).tolist()) if has.any() else iter(())
        return pd.Series([next(made) if h else None for h in has], dtype=object)

    return F.pandas_udf(run, "array<double>")(c)


def likeness(c: Column, asked: list[float], encode: Encoder = hashed_words) -> Column:
    """The cosines of texts' vectors with a given one, as ``vectors.cosine`` has them; the vectors stay in the worker. Null for null."""
    wanted = np.array(asked, float)

    def dot(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for k in range(x.shape[1]):  # one after the other, as an aggregate adds them
            total += x[:, k] * y[..., k]
        return total

    def run(texts: pd.Series) -> pd.Series:
        has = texts.notna().to_numpy()
        v = np.asarray(encode(texts[has].tolist()), float).reshape(-1, len(wanted))
        norm = np.sqrt(dot(v, v)) * np.sqrt(dot(wanted[None], wanted))
        out = np.full(len(texts), np.nan)
        out[has] = np.where(norm == 0, 0.0, dot(v, wanted) / np.where(norm == 0, 1, norm))
        return pd.Series(out).astype("Float64").mask(~has)

    return F.round(F.pandas_udf(run, "double")(c), 6)
