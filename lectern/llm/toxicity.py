"""Operator 10, toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the bag of its own hash and its character 3- to 5-grams (with word-edge marks), each
a row of one embedding matrix; a passage is the average of its words; a two-class softmax sits
on top. Embeddings and classifier are trained jointly by gradient descent in numpy. An unseen
misspelling shares most n-grams with the word it hides, so it gets a similar vector.

Toxic documents are mostly ordinary prose, a single word in it may be what makes them toxic. So
a document is cut into passages of ``PASSAGE`` words (the whole text, in overlapping steps) and
is as toxic as its worst passage. Training is
multiple-instance: of a toxic document only the passage that scores highest counts as toxic.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import flatten, like, pick, table, tidied, word_hashes

BUCKETS, DIM, EPOCHS = 1 << 16, 8, 12
#: The bound of the training sample: labelled documents of each class.
TRAIN_PER_CLASS = 1500
PASSAGE = 2
#: Embeddings trained from so many random beginnings stand side by side: what one has by chance, the others even out.
SEEDS = (7, 8, 9)
#: A document is toxic from this probability of its worst passage on.
THRESHOLD = 0.6
_WORD = re.compile(r"\w+")
_BATCH = 1 << 20  # characters scored at once

RESULT = "doc_id bigint, p_toxic double, toxic boolean"


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def subwords(words: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Rows of each word and of its character 3- to 5-grams, and the word each row is for."""
    marked = "<" + "><".join(words) + ">"
    codes = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(w) + 2 for w in words])
    owner = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))  # characters up to the word's end
    rows, who = [(word_hashes(words) % np.uint64(buckets)).astype(np.int64)], [np.arange(len(words))]
    h = np.full(len(codes), 0x811C9DC5, np.uint32)
    with np.errstate(over="ignore"):
        for n in range(5):
            if n >= len(codes):
                break
            h = (h[: len(codes) - n] ^ codes[n:]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
            if n >= 2:
                fits = np.flatnonzero(left[: len(h)] > n)
                rows.append((((h[fits] * np.uint32(0x9E3779B1)) >> np.uint32(8)) % np.uint32(buckets)).astype(np.int64))
                who.append(owner[fits])
    return np.concatenate(rows), np.concatenate(who)


@dataclass
class Model:
    rows: np.ndarray  # (buckets, dim) embeddings
    weight: np.ndarray  # (dim,) toxic minus clean logit; a two-class softmax
    bias: float

    def words(self, words: list[str]) -> np.ndarray:
        """Each word's part in the logit. The layers are linear, so a passage's logit is the mean of its words'."""
        rows, who = subwords(words, len(self.rows))
        return np.bincount(who, (self.rows @ self.weight)[rows], len(words)) / np.bincount(who, minlength=len(words))

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        """Of each text's worst passage; 0 without a word."""
        out = np.zeros(len(texts))
        pending: list[tuple[int, list[str]]] = []
        held = 0

        def flush() -> None:
            nonlocal held
            codes, distinct = pd.factorize(np.array([w for _, ws in pending for w in ws], dtype=object))
            if len(distinct):
                sums = np.concatenate([[0.0], np.cumsum(self.words(distinct.tolist())[codes])])
                at = 0
                for i, ws in pending:
                    if ws:
                        a, b = passage_bounds(len(ws))
                        logit = ((sums[at + b] - sums[at + a]) / (b - a)).max() + self.bias
                        out[i] = 1 / (1 + np.exp(-min(max(logit, -50), 50)))
                    at += len(ws)
            pending.clear()
            held = 0

        for i, text in enumerate(texts):
            if isinstance(text, str):
                pending.append((i, words_of(text)))
                held += len(text)
                if held >= _BATCH:
                    flush()
        flush()
        return out


def passage_bounds(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Half-overlapping passages that cover all n words."""
    starts = np.arange(0, max(n - PASSAGE // 2, 1), max(PASSAGE // 2, 1))
    return starts, np.minimum(starts + PASSAGE, n)


def train(texts: list[str], toxic: list[int], seeds: tuple[int, ...] = SEEDS, buckets: int = BUCKETS, dim: int = DIM, epochs: int = EPOCHS, rate: float = 0.5) -> Model:
    """Joint AdaGrad training; deterministic. Without both classes nothing is ever called toxic."""
    vocabulary: dict[str, int] = {}
    ids, labels = [], []
    for text, y in zip(texts, toxic):  # numbers at once: the words of a sample weigh many times as much
        mine = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(text)], np.int32)
        if len(mine):
            ids.append(mine)
            labels.append(y)
    if len(set(labels)) < 2:
        return Model(np.zeros((buckets, dim)), np.zeros(dim), -20.0)
    flat, owners = subwords(list(vocabulary), buckets)
    flat = flat[np.argsort(owners, kind="stable")].astype(np.int32)
    sizes = np.bincount(owners, minlength=len(vocabulary))
    return side_by_side([_train(ids, np.array(labels), flat, sizes, seed, buckets, dim, epochs, rate) for seed in seeds])


def side_by_side(parts: list[Model]) -> Model:
    """One model of several: their columns next to each other, the logit their mean."""
    return Model(np.concatenate([m.rows for m in parts], axis=1), np.concatenate([m.weight for m in parts]) / len(parts), float(np.mean([m.bias for m in parts])))


def _train(ids: list[np.ndarray], labels: np.ndarray, flat: np.ndarray, sizes: np.ndarray, seed: int, buckets: int, dim: int, epochs: int, rate: float) -> Model:
    rng = np.random.default_rng(seed)
    rows = rng.uniform(-1 / dim, 1 / dim, (buckets, dim))
    weight, bias = rng.normal(0, 0.5, dim), 0.0
    at = np.concatenate([[0], np.cumsum(sizes)])
    grad_rows, grad_weight, grad_bias = np.full(buckets, 1e-6), np.full(dim, 1e-6), 1e-6
    positives, negatives = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)

    def step(passages: list[np.ndarray], y: np.ndarray, weights: np.ndarray) -> None:
        nonlocal weight, bias, grad_weight, grad_bias
        w = np.concatenate(passages)
        lengths = np.array([len(p) for p in passages])
        owner = np.repeat(np.arange(len(passages)), lengths)
        # one entry for each subword of each word of each passage
        n = sizes[w]
        first = np.repeat(at[w], n)
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        sub, who = flat[first + inside], np.repeat(owner, n)
        share = np.repeat(1.0 / n / lengths[owner], n)
        hidden = np.stack([np.bincount(who, share * rows[sub, d], len(passages)) for d in range(dim)], axis=1)
        error = (1 / (1 + np.exp(-np.clip(hidden @ weight + bias, -50, 50))) - y) * weights
        gw, gb = error @ hidden, error.sum()
        used, back = np.unique(sub, return_inverse=True)
        pull = np.bincount(back, share * error[who], len(used))
        g = pull[:, None] * weight
        grad_rows[used] += (g**2).mean(axis=1)
        rows[used] -= rate * g / np.sqrt(grad_rows[used])[:, None]
        grad_weight += gw**2
        weight -= rate * gw / np.sqrt(grad_weight)
        grad_bias += gb**2
        bias -= rate * gb / np.sqrt(grad_bias)

    for epoch in range(epochs):
        values = np.add.reduceat((rows @ weight)[flat], at[:-1]) / sizes  # of each word, for choosing passages
        picked: list[tuple[np.ndarray, int]] = []
        for d in positives:
            a, b = passage_bounds(len(ids[d]))
            sums = np.concatenate([[0.0], np.cumsum(values[ids[d]])])
            k = int(((sums[b] - sums[a]) / (b - a)).argmax()) if epoch else None
            chosen = [k] if k is not None else range(len(a))
            picked += [(ids[d][a[j] : b[j]], 1) for j in chosen]
        for d in negatives:  # the worst passage, and two at random
            a, b = passage_bounds(len(ids[d]))
            sums = np.concatenate([[0.0], np.cumsum(values[ids[d]])])
            worst = int(((sums[b] - sums[a]) / (b - a)).argmax())
            for j in {worst, *rng.integers(0, len(a), 2).tolist()}:
                picked.append((ids[d][a[j] : b[j]], 0))
        order = rng.permutation(len(picked))
        share = max(sum(y for _, y in picked), 1) / len(picked)
        for start in range(0, len(order), 256):
            part = [picked[i] for i in order[start : start + 256]]
            y = np.array([p[1] for p in part], float)
            step([p[0] for p in part], y, np.where(y == 1, 0.5 / share, 0.5 / max(1 - share, 1e-9)) / len(part))
    return Model(rows.astype(np.float32), weight, float(bias))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Train on at most ``per_class`` labelled whole documents of each class, chosen by hash of the id.

    Rows without id, text or label are not trained on; an id with both labels is toxic. Each
    random beginning is trained by a task of its own; only the models come to the driver.
    """
    marks = pick(labels, doc_id=id_col, y=label_col).where("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = [marks.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    texts = pick(docs, doc_id=id_col, text=text_col).where("text is not null")
    sample = texts.join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id").select("doc_id", "text", F.col("y").cast("int").alias("y"))

    def one(keys: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "text"], kind="stable")
        m = train(rows["text"].tolist(), rows["y"].tolist(), seeds=(int(keys[0]),))
        return pd.DataFrame({"seed": [keys[0]], "rows": [np.asarray(m.rows, np.float32).tobytes()], "weight": [m.weight.tolist()], "bias": [m.bias]})

    seeds = sample.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in SEEDS])))
    made = seeds.repartitionByRange(len(SEEDS), "seed").groupBy("seed").applyInPandas(one, "seed int, rows binary, weight array<double>, bias double").collect()
    parts = [Model(np.frombuffer(r["rows"], np.float32).reshape(BUCKETS, -1), np.array(r["weight"]), r["bias"]) for r in sorted(made, key=lambda r: r["seed"])]
    return side_by_side(parts) if parts else train([], [])


def detect(docs: DataFrame, model: Model, threshold: float = THRESHOLD, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document, repeats included: probability of its worst passage, and the verdict.

    Null, blank and wordless texts have probability 0 and are not toxic. Null ids pass
    through; other columns are dropped.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            p = held.value.probabilities(batch["text"].tolist())
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "p_toxic": p.round(6), "toxic": p >= threshold})

    return pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text").mapInPandas(lambda batches: tidied(run(batches)), RESULT)


def clean_only(docs: DataFrame, model: Model, threshold: float = THRESHOLD, *, text_col: str = "text") -> DataFrame:
    """The documents that ``detect`` doesn't call toxic, with all their columns; one pass, no shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def ok(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from tidied(pd.Series(held.value.probabilities(text.tolist()) < threshold) for text in batches)

    flat, at = flatten(docs)
    return like(flat.where(ok(F.col(at[text_col]))), docs)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return detect(docs, fit(docs, table(spark, sf_dir, "labels")))
