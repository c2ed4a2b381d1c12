"""Word streams and repeated spans: what the two substring operators share.

A word is a maximal run of non-white characters, compared exactly. A passage of ``MIN_WORDS``
words that occurs at two places, in one document or in two, is a repeat; of all its places the
one with the smallest (doc_id, part, position) is the original, the others are redundant.

``part`` tells apart different texts under one id (in the order of their hashes); it is 0 where
ids are unique. Rows that repeat an id and a text are one text.

Before places are shuffled by hash, each slice of about half a million characters folds its own: of
equal passages in a slice only the first is sent, the others are known to be redundant. So the
rows that a hot passage sends to one task are as many as slices, not as documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import flatten, like, persist_table, pick, runs, tidied, word_hashes

MIN_WORDS = 50
_BATCH = 1 << 19
_WORD = re.compile(r"\S+")

SPANS = "doc_id bigint, start_word int, end_word int, n_words int, n_cut int"


#: A table of (id, text hash) pairs for ids with several texts is broadcast up to so many rows, 24 bytes each.
BROADCAST_ROWS = 1_000_000


def numbered(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``rows`` with ``part``: 0, 1, ... for the different texts of one id, null for rows without id or text.

    One pass over hashes finds the ids that have several texts, usually none.
    """
    known = F.col(id_col).isNotNull() & F.col(text_col).isNotNull()
    hashes = rows.where(known).select(F.col(id_col).cast("long").alias("__i"), F.xxhash64(text_col).alias("__t"))
    several = hashes.groupBy("__i").agg(F.min("__t").alias("a"), F.max("__t").alias("b")).where("a <> b").select("__i")
    n = several.count()
    if not n:
        return rows.withColumn("part", F.when(known, F.lit(0)))
    small = F.broadcast if n <= BROADCAST_ROWS // 4 else (lambda df: df)
    parts = hashes.join(small(several), "__i", "left_semi").distinct().withColumn("__p", F.row_number().over(Window.partitionBy("__i").orderBy("__t")) - 1)
    parts = persist_table(parts.where("__p > 0"), "parts")
    if parts.count() <= BROADCAST_ROWS:
        parts = F.broadcast(parts)
    joined = rows.withColumns({"__id": F.col(id_col).cast("long"), "__hash": F.xxhash64(text_col)}).join(parts, (F.col("__id") == F.col("__i")) & (F.col("__hash") == F.col("__t")), "left")
    return joined.withColumn("part", F.when(known, F.coalesce("__p", F.lit(0)))).drop("__id", "__hash", "__i", "__t", "__p")


def texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Long id, part and text of the rows that have both; a repeat needs a document to be named by."""
    slim = pick(docs, doc_id=id_col, text=text_col).where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), "text")
    return numbered(slim, "doc_id", "text").select("doc_id", "part", "text")


def streams(ids: list[int], texts: list[str], extra: list | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, list[str], np.ndarray, list]]:
    """Slices of a batch: ids, word counts, the words of all, their hashes, what belongs to each."""
    who, counts, words, more, held = [], [], [], [], 0
    for i, text in enumerate(texts):
        mine = text.split()
        who.append(ids[i])
        counts.append(len(mine))
        words += mine
        more.append(extra[i] if extra is not None else None)
        held += len(text)
        if held >= _BATCH:
            yield np.array(who, np.int64), np.array(counts, np.int64), words, word_hashes(words), more
            who, counts, words, more, held = [], [], [], [], 0
    if who:
        yield np.array(who, np.int64), np.array(counts, np.int64), words, word_hashes(words), more


def places(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word of a slice: its document's index, its position there, and the words from it to the end."""
    owner = np.repeat(np.arange(len(counts)), counts)
    position = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return owner, position, np.repeat(counts, counts) - position


#: What a slice has found out about a place: nothing, that its passage repeats in the slice, that it isn't the first.
ALONE, FIRST, LATER = 0, 1, 2
PLACES = "h bigint, doc_id bigint, at bigint"


def folded(keys: list[np.ndarray], ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which places there are, in the order they came in, and their states.

    A place is (id, at), ``at`` having the part in its upper and the position in its lower half. Repeated places are one.
    """
    order = np.lexsort((at, ids, *keys[::-1]))
    if not len(order):
        return order, np.zeros(0, np.int8)
    ids, at = ids[order], at[order]
    new = np.zeros(len(order), bool)
    new[0] = True
    for key in keys:
        k = key[order]
        new[1:] |= k[1:] != k[:-1]
    once = new.copy()
    once[1:] |= (ids[1:] != ids[:-1]) | (at[1:] != at[:-1])
    order, new = order[once], new[once]
    size = np.diff(np.append(np.flatnonzero(new), len(order)))
    state = np.where(new, np.where(np.repeat(size, size) > 1, FIRST, ALONE), LATER).astype(np.int8)
    back = np.argsort(order)  # the order of the text packs better
    return order[back], state[back]


def packed(code: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Place and state in one number: a column less to shuffle."""
    return (code << 2) | state


def state_of() -> Column:
    return F.col("at").bitwiseAND(F.lit(3))


def spread(key: str) -> Column:
    """What to shuffle by: the key, but for later places, which meet nothing, a hash of their document."""
    return F.when(state_of() == LATER, F.xxhash64("doc_id")).otherwise(F.col(key))


def shared(rows: DataFrame, *keys: str, named: bool = False) -> DataFrame:
    """The places (doc_id, at) whose keys occur at two; ``redundant`` but for the first.

    ``named`` adds the first key and ``n``, the number of places that met in the shuffle.
    """
    later, to = state_of() == LATER, "__to" if named else keys[0]
    place, by = F.struct("doc_id", F.shiftright("at", 2).alias("at")), Window.partitionBy(to, *keys[1:], later)
    # an exchange of its own: what the window computes from would be shuffled as columns besides
    sent = rows.withColumn(to, spread(keys[0])).repartition(to)
    bounds = sent.withColumns({"first": F.min(place).over(by), "last": F.max(place).over(by)})
    more = [keys[0], "n"] if named else []
    if named:
        bounds = bounds.withColumn("n", F.count("*").over(by))
    return bounds.where((F.col("first") != F.col("last")) | (state_of() > 0)).select("doc_id", F.shiftright("at", 2).alias("at"), ((place > F.col("first")) | later).alias("redundant"), *more)


def part_of() -> Column:
    return F.shiftright("at", 32).cast("int")


def pos_of() -> Column:
    return F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")


def collected(found: DataFrame) -> DataFrame:
    """Fold (doc_id, part, s, e, redundant) into one row a text: places of any repeat, of redundant ones."""
    item: Column = F.struct("s", "e")
    return found.groupBy("doc_id", "part").agg(F.collect_list(item).alias("every"), F.collect_list(F.when(F.col("redundant"), item)).alias("cut"))


def _merged(places: np.ndarray) -> list[tuple[int, int]]:
    if not len(places):
        return []
    pairs = np.array([(p["s"], p["e"]) for p in places], np.int64)
    return runs(pairs[:, 0], pairs[:, 1])


def merged_spans(found: DataFrame) -> DataFrame:
    """Maximal repeated spans of each document, and how many of a span's words are redundant."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, every, cut in zip(batch["doc_id"], batch["every"], batch["cut"]):
                gone = _merged(cut)
                for s, e in _merged(every):
                    rows.append((doc, s, e, e - s, sum(max(0, min(e, b) - max(s, a)) for a, b in gone)))
            yield pd.DataFrame(rows, columns=["doc_id", "start_word", "end_word", "n_words", "n_cut"]).astype({"start_word": "int32", "end_word": "int32", "n_words": "int32", "n_cut": "int32"})

    return collected(found).mapInPandas(lambda batches: tidied(run(batches)), SPANS)


def without_words(text: str, cut: list[tuple[int, int]]) -> str:
    """``text`` without the words of the half-open ranges, each with the white space after it."""
    starts = [m.start() for m in _WORD.finditer(text)] + [len(text)]
    out, at = [], 0
    for a, b in cut:
        out.append(text[at : starts[a]])
        at = starts[b]
    return "".join([*out, text[at:]]).rstrip() if cut else text


def cut_documents(docs: DataFrame, found: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with redundant words cut out of the text and the length column, if any, brought up to date.

    A document of which nothing is left goes. Rows without id or text stay as they are.
    """
    cuts = collected(found.where("redundant")).select(F.col("doc_id").alias("__doc"), F.col("part").alias("__part"), F.col("cut").alias("__cut"))

    @F.pandas_udf("string")
    def shorten(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        yield from tidied(pd.Series([t if c is None or t is None else without_words(t, _merged(c)) for t, c in zip(text, cut)], dtype=object) for text, cut in batches)

    shorten = shorten.asNondeterministic()  # else the filter and the columns below run it once each, in workers of their own

    flat, at = flatten(docs)
    text, long = at[text_col], F.col("__cut").isNotNull()
    flat = numbered(flat, at[id_col], text)
    joined = flat.join(cuts, (F.col(at[id_col]).cast("long") == F.col("__doc")) & (F.col("part") == F.col("__part")), "left").withColumn(text, F.when(long, shorten(text, "__cut")).otherwise(F.col(text)))
    joined = joined.where(~long | (F.trim(F.col(text)) != "") | F.col(text).isNull())
    if length_col in at:
        kind = dict(joined.dtypes)[at[length_col]]
        joined = joined.withColumn(at[length_col], F.when(long, F.length(text).cast(kind)).otherwise(F.col(at[length_col])))
    return like(joined, docs)
