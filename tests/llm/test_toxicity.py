import math
import random

import numpy as np
import pandas as pd

from lectern.llm import toxicity as tox


def labelled(size):
    docs = pd.read_parquet(f"/root/testdata/{size}/documents.parquet")
    return docs.merge(pd.read_parquet(f"/root/testdata/{size}/labels.parquet"), on="doc_id").sort_values("doc_id", ignore_index=True)


def test_held_out_accuracy():
    rows = labelled("sf0.1")
    train, held = rows[rows["doc_id"] % 2 == 0], rows[rows["doc_id"] % 2 == 1]
    model = tox.train(train["text"].tolist(), train["toxic"].tolist())
    p = model.probabilities(held["text"].tolist())
    y = held["toxic"].to_numpy() == 1
    assert ((p >= tox.THRESHOLD) == y)[y].mean() > 0.85  # found
    assert (p < tox.THRESHOLD)[~y].mean() > 0.975  # left alone


def test_unseen_misspellings_share_vectors():
    r = random.Random(1)
    plain = "the garden path runs along a quiet river past old houses and green fields".split()
    rude = ["horrible", "disgusting", "pathetic", "worthless"]
    texts, y = [], []
    for i in range(400):
        words = [r.choice(plain) for _ in range(12)]
        if i % 2:
            words[3:6] = r.sample(rude, 3)
        texts.append(" ".join(words))
        y.append(i % 2)
    model = tox.train(texts, y)
    p = model.probabilities(["the old garden horribble disgustingg patheticc river fields", "the old garden and green river fields past houses"])
    assert p[0] > 0.5 > p[1]


def test_logit_is_the_mean_over_words():
    model = tox.train(["good fine day", "bad awful mess"] * 20, [0, 1] * 20)
    words = tox.words_of("awful day")
    rows, who = tox.subwords(words, len(model.rows))
    vectors = np.stack([model.rows[rows[who == k]].mean(axis=0) for k in range(2)])
    logit = vectors.mean(axis=0) @ model.weight + model.bias
    assert np.isclose(model.probabilities(["awful day"])[0], 1 / (1 + np.exp(-logit)), atol=1e-6)


def test_passages_cover_all_words():
    for n in list(range(1, 60)) + [1000]:
        a, b = tox.passage_bounds(n)
        assert set(np.concatenate([np.arange(x, y) for x, y in zip(a, b)])) == set(range(n))


def test_toxic_end_of_a_long_text_counts():
    model = tox.train(["quiet river by the old houses today"] * 30 + ["you horrible disgusting worthless creature"] * 30, [0] * 30 + [1] * 30)
    text = "quiet river by the old houses today " * 20_000
    p = model.probabilities([text, text + "you horrible disgusting worthless creature you horrible disgusting worthless creature"])
    assert p[0] < 0.5 < p[1]


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(4, 1, "x"), (6, 0, "x"), (None, 1, "x"), (9, None, "x"), (77, 1, "x")], "doc_id bigint, toxic int, TOXIC string")
    model = tox.fit(odd_docs, labels)
    rows = tox.detect(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and {r.p_toxic for r in rows if r.doc_id in (1, 2, 3)} == {0.0}
    kept = tox.clean_only(odd_docs, model)
    assert kept.columns == odd_docs.columns and kept.count() == sum(not r.toxic for r in rows)
    assert tox.detect(no_docs, tox.fit(no_docs, labels)).collect() == []
    none = tox.fit(odd_docs, spark.createDataFrame([(6, 0)], "doc_id bigint, toxic int"))
    assert not any(r.toxic for r in tox.detect(odd_docs, none).collect())


def plain_probability(model, text):
    """Word by word and passage by passage, from the embeddings alone."""
    words = tox.words_of(text or "")
    if not words:
        return 0.0
    values = {}
    for w in set(words):
        rows, _ = tox.subwords([w], len(model.rows))
        values[w] = float(np.mean([model.rows[r].astype(float) @ model.weight for r in rows]))
    worst = max(sum(values[w] for w in words[a : a + tox.PASSAGE]) / len(words[a : a + tox.PASSAGE]) for a in range(0, max(len(words) - tox.PASSAGE // 2, 1), tox.PASSAGE // 2))
    return 1 / (1 + math.exp(-max(-50, min(50, worst + model.bias))))


def test_query_equals_brute_force(spark, sf):
    """The fit on executors is the plain training of the same rows; scores are those of single words."""
    docs, labels = pd.read_parquet(f"{sf}/documents.parquet"), pd.read_parquet(f"{sf}/labels.parquet")
    rows = docs.merge(labels, on="doc_id").sort_values(["doc_id", "text"])
    assert rows["toxic"].value_counts().max() <= tox.TRAIN_PER_CLASS
    model = tox.train(rows["text"].tolist(), rows["toxic"].tolist())
    got = {r.doc_id: r for r in tox.op10_toxicity(spark, sf).collect()}
    assert got.keys() == set(docs["doc_id"].tolist())
    for doc, text in zip(docs["doc_id"], docs["text"]):
        p = plain_probability(model, text)
        assert math.isclose(got[doc].p_toxic, p, abs_tol=2e-6) and got[doc].toxic == (got[doc].p_toxic >= tox.THRESHOLD)


def test_a_very_long_labelled_text(spark):
    """Whole labelled texts are trained on, long ones too; the label of an id with both is toxic."""
    long = "quiet river by the old houses today " * 30_000 + "you horrible disgusting creature"
    docs = spark.createDataFrame([(1, long), (2, "quiet river by the old houses today"), (3, "horrible disgusting"), (4, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (3, 1), (4, 1)], "doc_id bigint, toxic int")
    got = {r.doc_id: r.p_toxic for r in tox.detect(docs, tox.fit(docs, labels)).collect()}
    assert got[1] > got[2] and got[3] > got[2] and got[4] == 0
