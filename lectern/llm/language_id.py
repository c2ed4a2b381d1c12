"""Operator 4, language ID: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased; everything that is not a letter counts as a blank. All 1- to 3-grams
of a text are hashed into ``buckets`` counters. Training sums the counters of each language on
the executors, smooths them and takes logarithms; the matrix (buckets x languages) has a bounded
size and is broadcast. Scoring looks up the rows of a batch's n-grams and sums them per document
in numpy. Whole texts are trained on and scored, long ones slice by slice, with the n-grams that
span two slices.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.common import flatten, like, pick, tidied

BUCKETS = 1 << 15
#: The bound of the training sample: so many labelled documents of each language.
TRAIN_PER_LANGUAGE = 500
#: The most languages; if more labels are about, the most frequent are learned, the others are not known.
MOST_LANGUAGES = 200
#: A contradicting prediction rejects only if it leads by this much per n-gram.
MARGIN = 0.02
_SLICE = 1 << 19
_FOLD = np.arange(0x110000, dtype=np.uint32)
_FOLD[[c for c in range(0x110000) if not chr(c).isalpha()]] = 32
_MULT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)

RESULT = "doc_id bigint, lang string, predicted string, margin double, accepted boolean"


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    logs: np.ndarray  # (buckets, languages) float32, n-gram given language
    priors: np.ndarray


def _codes(text: str) -> np.ndarray:
    return _FOLD[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]


def _slices(codes: np.ndarray, size: int | None = None) -> Iterator[tuple[np.ndarray, int]]:
    """Slices that begin with the two characters before them, and how many of these there are."""
    size = size or _SLICE
    for start in range(0, len(codes), size):
        yield codes[max(start - 2, 0) : start + size], min(start, 2)


def _grams(codes: np.ndarray, buckets: int) -> list[np.ndarray]:
    """Bucket of the 1-, 2- and 3-gram that ends at each character (short at the start)."""
    shift = np.uint32(32 - int(buckets).bit_length() + 1)
    out = []
    h = np.zeros(len(codes), np.uint32)
    with np.errstate(over="ignore"):
        for n in range(3):
            h[n:] = (h[n:] ^ codes[: len(codes) - n]) * _MULT[n]
            h[n:] ^= h[n:] >> np.uint32(15)
            out.append((h[n:] * np.uint32(0x27D4EB2F)) >> shift)
    return out


def tally(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Counts of a whole text's n-grams."""
    counts = np.zeros(buckets, np.int64)
    for codes, lead in _slices(_codes(text)):
        for n, b in enumerate(_grams(codes, buckets)):
            counts += np.bincount(b[max(lead - n, 0) :], minlength=buckets)
    return counts


def model_of(languages: tuple[str, ...], counts: np.ndarray, docs: np.ndarray, smoothing: float = 0.5) -> Model:
    """From n-gram counts (buckets x languages) and numbers of documents."""
    counts, docs = counts + smoothing, docs + 1.0
    logs = np.log(counts) - np.log(counts.sum(axis=0, keepdims=True)) if languages else counts
    return Model(languages, logs.astype(np.float32), np.log(docs / docs.sum()) if languages else docs)


def train(rows: pd.DataFrame, buckets: int = BUCKETS) -> Model:
    """Fit on columns ``lang`` and ``text``; without rows there is no language and every text is accepted."""
    languages = tuple(sorted(set(rows["lang"])))
    counts, docs = np.zeros((buckets, len(languages)), np.int64), np.zeros(len(languages))
    for lang, text in zip(rows["lang"], rows["text"]):
        counts[:, languages.index(lang)] += tally(text, buckets)
        docs[languages.index(lang)] += 1
    return model_of(languages, counts, docs)


def score(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Summed log-probabilities (texts x languages) and the n-grams counted for each text."""
    k = len(model.languages)
    total, grams = np.zeros((len(texts), k)), np.zeros(len(texts))
    pending: list[tuple[int, np.ndarray, int]] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if not pending:
            return
        joined = np.concatenate([c for _, c, _ in pending])
        lengths, leads = np.array([len(c) for _, c, _ in pending]), np.array([lead for _, _, lead in pending])
        begins = np.cumsum(lengths) - lengths
        who = np.array([i for i, _, _ in pending])
        for n, b in enumerate(_grams(joined, len(model.logs))):
            skip = np.minimum(np.maximum(leads, n), lengths)  # n-grams that begin in the text before, or were counted with the slice before
            keep = np.ones(len(joined), bool)
            for j in range(2):
                keep[begins[skip > j] + j] = False
            b, left = b[keep[n:]], lengths - skip
            has = np.flatnonzero(left)
            if len(has):
                starts = np.cumsum(left[has]) - left[has]
                np.add.at(total, who[has], np.add.reduceat(model.logs.take(b, axis=0), starts, axis=0, dtype=np.float64))
                np.add.at(grams, who[has], left[has])
        pending.clear()
        held = 0

    for i, text in enumerate(texts):
        for codes, lead in _slices(_codes(text)):
            pending.append((i, codes, lead))
            held += len(codes)
            if held >= _SLICE:
                flush()
    flush()
    return total + model.priors, grams


def decide(model: Model, texts: pd.Series, langs: pd.Series, threshold: float) -> pd.DataFrame:
    texts, declared = texts.tolist(), langs.tolist()
    blank = np.array([not isinstance(t, str) or not t.strip() for t in texts], bool)
    predicted: list[str | None] = [None] * len(texts)
    margin = np.zeros(len(texts))
    accepted = ~blank
    if model.languages:
        total, grams = score(model, ["" if b else t for t, b in zip(texts, blank)])
        best = total.argmax(axis=1)
        for i in np.flatnonzero(~blank):
            predicted[i] = model.languages[best[i]]
            if declared[i] in model.languages:
                other = total[i, model.languages.index(declared[i])]
            else:
                other = np.partition(total[i], -2)[-2] if len(model.languages) > 1 else total[i, best[i]]
            margin[i] = (total[i, best[i]] - other) / max(grams[i], 1)
            if declared[i] in model.languages and declared[i] != predicted[i] and margin[i] > threshold:
                accepted[i] = False
    return pd.DataFrame({"predicted": predicted, "margin": margin.round(6), "accepted": accepted})


def fit(docs: DataFrame, per_language: int = TRAIN_PER_LANGUAGE, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Train on at most ``per_language`` whole documents of each language, chosen by hash of the id.

    Rows without id, text or language are not trained on. Of more than ``MOST_LANGUAGES`` labels
    the most frequent are learned (of equally frequent ones those that sort first). Only counts
    come to the driver.
    """
    slim = pick(docs, doc_id=id_col, lang=lang_col, text=text_col).where("doc_id is not null and lang is not null")
    labels = [r["lang"] for r in slim.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()]
    by = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = slim.select("doc_id", "lang").where(F.col("lang").isin(labels)).withColumn("rn", F.row_number().over(by)).where(F.col("rn") <= per_language).select("doc_id").distinct()
    rows = slim.join(F.broadcast(chosen), "doc_id", "left_semi").where("text is not null").where(F.col("lang").isin(labels)).select("lang", "text")

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, tuple[np.ndarray, int]] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                counts, n = held.get(lang, (0, 0))
                held[lang] = (counts + tally(text), n + 1)
        for lang, (counts, n) in held.items():
            at = np.flatnonzero(counts)
            yield pd.DataFrame({"lang": lang, "bucket": np.append(at, -1).astype(np.int32), "n": np.append(counts[at], n)})

    got = rows.mapInPandas(lambda batches: tidied(sums(batches)), "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = tuple(sorted(set(got["lang"])))
    counts, number = np.zeros((BUCKETS, len(languages)), np.int64), np.zeros(len(languages))
    column = got["lang"].map({lang: k for k, lang in enumerate(languages)}).to_numpy(np.int64)
    bucket, n = got["bucket"].to_numpy(), got["n"].to_numpy()
    number[column[bucket < 0]] = n[bucket < 0]
    counts[bucket[bucket >= 0], column[bucket >= 0]] = n[bucket >= 0]
    return model_of(languages, counts, number)


def identify(docs: DataFrame, model: Model, threshold: float = MARGIN, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document, in any number of repeats: declared and predicted language, margin, decision.

    ``margin`` is the lead of the predicted language over the declared one (over the runner-up
    when none is declared, or one the model doesn't know), per n-gram. A document is rejected
    if its text is null or blank (predicted is then null), or if the prediction contradicts
    the declared language by more than ``threshold``. A tie goes to the language that sorts
    first. Null ids pass through; other columns are dropped.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = decide(held.value, batch["text"], batch["lang"], threshold)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "lang": batch["lang"], "predicted": out["predicted"], "margin": out["margin"], "accepted": out["accepted"]})

    slim = pick(docs, doc_id=id_col, lang=lang_col, text=text_col)
    return slim.select(F.col("doc_id").cast("long"), "lang", "text").mapInPandas(lambda batches: tidied(run(batches)), RESULT)


def accepted_only(docs: DataFrame, model: Model, threshold: float = MARGIN, *, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents that ``identify`` accepts, with all their columns; one pass, no shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def ok(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        yield from tidied(decide(held.value, text, lang, threshold)["accepted"] for text, lang in batches)

    flat, at = flatten(docs)
    return like(flat.where(ok(F.col(at[text_col]), F.col(at[lang_col]))), docs)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, fit(docs))
