"""Chunking: the greedy fold that packs whole words up to a target length.

The fold depends on its own result, so it isn't a window sum. It runs over word lengths only,
in numpy: the end of a chunk is found by binary search in the cumulative lengths, so a
document costs one step a chunk, not one a word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.shared import tidied

TARGET = 2000
#: Characters that are split into words at once, and characters of chunks that are handed on together.
_PIECE, _YIELD = 1 << 20, 1 << 22
_SPACE = re.compile(r"\s")
CHUNKS = "doc_id bigint, chunk_index int, text string"
SECTION_CHUNKS = "doc_id bigint, chunk_index int, section_index int, section_title string, page_start int, page_end int, text string"


def breaks(lengths: np.ndarray, target: int) -> list[tuple[int, int]]:
    """Half-open word ranges of the chunks; a word longer than the target stands alone."""
    ends = np.cumsum(lengths + 1) - 1
    out, start, n = [], 0, len(lengths)
    while start < n:
        room = (ends[start - 1] + 1 if start else 0) + target
        stop = max(int(np.searchsorted(ends, room, "right")), start + 1)
        out.append((start, stop))
        start = stop
    return out


def _pack(words: list[str], target: int) -> list[tuple[int, int]]:
    return breaks(np.fromiter(map(len, words), np.int64, len(words)), target)


def _pieces(text: str) -> Iterator[list[str]]:
    """The words of a text, those of a bounded part at a time."""
    start = 0
    while len(text) - start > _PIECE:
        space = _SPACE.search(text, start + _PIECE)
        if space is None:
            break
        yield text[start : space.start()].split()
        start = space.end()
    yield text[start:].split()


def chunks_of_text(text: str, target: int) -> Iterator[str]:
    """The chunks of a text; the words of the last chunk of a part wait for those of the next."""
    held: list[str] = []
    for words in _pieces(text):
        held += words
        found = _pack(held, target)
        for a, b in found[:-1]:
            yield " ".join(held[a:b])
        held = held[found[-1][0] :] if found else []
    if held:
        yield " ".join(held)


def word_chunks(docs: DataFrame, target: int = TARGET) -> DataFrame:
    """(doc_id, chunk_index, text) from (doc_id, text); documents without words have no chunks.

    Chunks are handed on a few megabytes at a time, so a worker's memory depends on neither the
    number of documents nor the length of one besides its text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: tuple[list, list, list] = ([], [], [])
        size = 0
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for i in range(len(batch)):
                for k, chunk in enumerate(chunks_of_text(texts[i].as_py() or "", target)):
                    for column, value in zip(rows, (ids[i].as_py(), k, chunk)):
                        column.append(value)
                    size += len(chunk)
                    if size > _YIELD:
                        yield _batch(*rows)
                        rows, size = ([], [], []), 0
        if rows[0]:
            yield _batch(*rows)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(lambda batches: tidied(run(batches)), CHUNKS)


def _batch(ids: list, index: list, texts: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(index, pa.int32()), pa.array(texts, pa.string())], ["doc_id", "chunk_index", "text"])


def section_chunks(sections: DataFrame, target: int = TARGET) -> DataFrame:
    """Chunks of (doc_id, section_index, section_title, lines array<struct<page,text>>), never across sections.

    The chunk index runs on through a document's sections in order (front matter first); pages
    are those of a chunk's first and last word. A document is one row of arrays, and many are a batch.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, size = [], 0
            for doc, *arrays in zip(batch["doc_id"], batch["index"], batch["title"], batch["pages"], batch["texts"]):
                if size > _YIELD:
                    yield framed(rows)
                    rows, size = [], 0
                k = 0
                for index, title, pages, texts in zip(*arrays):
                    split = [t.split() for t in texts]
                    words = [w for ws in split for w in ws]
                    page = np.repeat(np.asarray(pages, np.int64), [len(ws) for ws in split])
                    for a, b in _pack(words, target):
                        rows.append((doc, k, None if index < 0 else index, title, page[a], page[b - 1], " ".join(words[a:b])))
                        size += len(rows[-1][-1])
                        k += 1
            yield framed(rows)

    def framed(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["doc_id", "chunk_index", "section_index", "section_title", "page_start", "page_end", "text"]).astype({"section_index": "Int32"})

    item = F.struct(F.coalesce("section_index", F.lit(-1)).alias("index"), F.col("section_title").alias("title"), "lines")
    by_doc = sections.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("s"))
    flat = by_doc.select("doc_id", F.col("s.index").alias("index"), F.col("s.title").alias("title"), F.transform("s", lambda x: x["lines"]["page"]).alias("pages"), F.transform("s", lambda x: x["lines"]["text"]).alias("texts"))
    return flat.mapInPandas(lambda batches: tidied(run(batches)), SECTION_CHUNKS)
