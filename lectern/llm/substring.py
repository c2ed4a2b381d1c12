"""Operator 2, substring dedup with difference-cover anchors.

``COVER`` is a perfect difference cover modulo ``PERIOD``: for any two positions there is a
shift below the period that takes both into the cover. So only windows of ``WIDTH`` words at
cover positions are hashed (6 of 31), and two equal passages of ``MIN_WORDS`` = WIDTH + PERIOD
- 1 words always share a hashed window at the same offset.

Windows whose hash occurs once are dropped after one narrow shuffle. Around each shared anchor
the match is extended to every passage of ``MIN_WORDS`` words that contains the anchor. The
passages are told apart by hashes of 96 bits and grouped instead of compared in pairs, so a
passage that thousands of documents share costs rows in proportion, not their square. Over 10^13
passages the odds that any two different ones are taken for equal are below one in a thousand;
64 bits would be wrong for sure.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import Windows, mix64, persist_table, table, tidied
from lectern.llm.spans import LATER, MIN_WORDS, PLACES, cut_documents, folded, merged_spans, packed, part_of, places, pos_of, shared, streams, texts

PERIOD = 31
COVER = (0, 1, 3, 8, 12, 18)
_IN_COVER = np.isin(np.arange(PERIOD), COVER)
_OTHER = np.uint64(0x6A09E667F3BCC909)


def repeats(docs: DataFrame, min_words: int = MIN_WORDS, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, part, s, e, redundant): every passage of ``min_words`` words that occurs at two places."""
    width = min_words - PERIOD + 1
    if width < 1:
        raise ValueError(f"a passage has at least {PERIOD} words")

    def anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ids, counts, _, hashes, parts in streams(batch["doc_id"].tolist(), batch["text"].tolist(), batch["part"].tolist()):
                owner, position, left = places(counts)
                at = np.flatnonzero(_IN_COVER[position % PERIOD] & (left >= width) & (counts[owner] >= min_words))
                doc, code = ids[owner[at]], (np.array(parts, np.int64)[owner[at]] << 32) | position[at]
                h = Windows(hashes).at(at, width)
                order, state = folded([h], doc, code)
                yield pd.DataFrame({"h": h[order].view(np.int64), "doc_id": doc[order], "at": packed(code[order], state)})

    def passages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            extra = list(zip(batch["part"].tolist(), batch["anchors"]))
            for ids, counts, _, hashes, marks in streams(batch["doc_id"].tolist(), batch["text"].tolist(), extra):
                owner, position, left = places(counts)
                begins = np.cumsum(counts) - counts
                near = np.zeros(len(owner) + 1, np.int64)
                for begin, (_, found) in zip(begins, marks):
                    found = np.asarray(found, np.int64)
                    np.add.at(near, begin + np.maximum(found - PERIOD + 1, 0), 1)
                    np.add.at(near, begin + found + 1, -1)
                at = np.flatnonzero((np.cumsum(near)[:-1] > 0) & (left >= min_words))
                doc, code = ids[owner[at]], (np.array([m[0] for m in marks], np.int64)[owner[at]] << 32) | position[at]
                first, second = Windows(hashes).at(at, min_words), Windows(mix64(hashes ^ _OTHER)).at(at, min_words)
                order, state = folded([first, second], doc, code)
                second[order[state == LATER]] = 0  # later places meet nothing
                yield pd.DataFrame({"h": first[order].view(np.int64), "g": (second[order] >> np.uint64(32)).astype(np.int64), "doc_id": doc[order], "at": packed(code[order], state)})

    slim = texts(docs, id_col, text_col)
    marked = shared(slim.mapInPandas(lambda batches: tidied(anchors(batches)), PLACES), "h").groupBy("doc_id", part_of().alias("part")).agg(F.collect_set(pos_of()).alias("anchors"))
    marked = persist_table(marked, "anchors", last=True)
    found = slim.join(marked, ["doc_id", "part"]).select("doc_id", "part", "text", "anchors").mapInPandas(lambda batches: tidied(passages(batches)), PLACES + ", g bigint")
    return shared(found, "h", "g").select("doc_id", part_of().alias("part"), pos_of().alias("s"), (pos_of() + min_words).alias("e"), "redundant")


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Maximal repeated spans, in words from 0: (doc_id, start_word, end_word, n_words, n_cut).

    ``n_cut`` words of a span lie in a passage that occurred before, by (doc_id, part, position).
    Documents without a repeat aren't listed; neither are null, empty and short texts, or rows
    without id. Rows that repeat an id and a text are one document and no repeat of each other;
    different texts under one id are compared like any two, and the spans of each are listed.
    """
    return merged_spans(repeats(docs, min_words, id_col=id_col, text_col=text_col))


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS, *, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with every redundant passage cut out; documents of which nothing is left go."""
    return cut_documents(docs, repeats(docs, min_words, id_col=id_col, text_col=text_col), id_col=id_col, text_col=text_col, length_col=length_col)


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents"))
