import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from lectern.llm import language_id as lid


@pytest.fixture(scope="module")
def documents():
    docs = pd.read_parquet("/root/testdata/sf0.1/documents.parquet").sort_values("doc_id", ignore_index=True)
    return docs[docs["text"].str.split().str.len() >= 5]


def test_held_out_accuracy(documents):
    train, held = documents.iloc[:1500], documents.iloc[1500:4000]
    model = lid.train(train)
    out = lid.decide(model, held["text"], pd.Series([None] * len(held)), lid.MARGIN)
    assert (out["predicted"].to_numpy() == held["lang"].to_numpy()).mean() > 0.97
    kept = lid.decide(model, held["text"], held["lang"], lid.MARGIN)["accepted"]
    assert kept.mean() > 0.97  # clean documents stay


def test_contradictions_are_rejected(documents):
    model = lid.train(documents.iloc[:1500])
    held = documents.iloc[1500:2500]
    wrong = held["lang"].map({"en": "de", "de": "fr", "fr": "es", "es": "en"})
    assert (~lid.decide(model, held["text"], wrong, lid.MARGIN)["accepted"]).mean() > 0.9


def test_scores_equal_a_plain_sum():
    rows = pd.DataFrame({"lang": ["a", "b", "b"], "text": ["wie es euch", "as you like it", "it is"]})
    model = lid.train(rows, buckets=1 << 10)
    texts = ["like wie", "", "x", "zz " * 50]
    total, grams = lid.score(model, texts)
    for i, text in enumerate(texts):
        buckets = [int(b) for part in lid._grams(lid._codes(text), 1 << 10) for b in part]
        assert grams[i] == len(buckets)
        for k in range(2):
            assert math.isclose(total[i, k], model.priors[k] + sum(float(model.logs[b, k]) for b in buckets), rel_tol=1e-5)


def test_long_texts_are_scored_whole():
    model = lid.train(pd.DataFrame({"lang": ["a", "b"], "text": ["abc abd abe", "xyz xyw xyv"]}))
    text = "abc " * 10 + "xyz " * 400_000  # the end outweighs the start
    assert lid.decide(model, pd.Series([text]), pd.Series(["a"]), lid.MARGIN)["predicted"][0] == "b"


def test_odd_rows(odd_docs, no_docs):
    model = lid.fit(odd_docs)
    rows = lid.identify(odd_docs, model).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert r.accepted or r.predicted is None or r.predicted != r.lang
    kept = lid.accepted_only(odd_docs, model)
    assert kept.columns == odd_docs.columns
    assert sorted((r[1] is None, r[1] or 0) for r in kept.collect()) == sorted((r.doc_id is None, r.doc_id or 0) for r in rows if r.accepted)
    assert not {1, 2, 3} & {r[1] for r in kept.collect()}
    assert lid.identify(no_docs, lid.fit(no_docs)).collect() == []
    assert {r.predicted for r in lid.identify(odd_docs, lid.fit(no_docs)).collect()} == {None}


def test_a_tie_goes_to_the_first_language():
    model = lid.train(pd.DataFrame({"lang": ["b", "a"], "text": ["same", "same"]}))
    assert lid.decide(model, pd.Series(["same"]), pd.Series([None]), 0.0)["predicted"][0] == "a"
    assert np.isclose(lid.decide(model, pd.Series(["same"]), pd.Series([None]), 0.0)["margin"][0], 0)


def plain_grams(text, buckets=lid.BUCKETS):
    """Every 1- to 3-gram of a whole text, hashed one by one in plain integers."""
    text = "".join(c if c.isalpha() else " " for c in text.lower())
    shift, mult = 32 - buckets.bit_length() + 1, (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
    for end in range(len(text)):
        h = 0
        # the hash of an n-gram takes its last character first
        for n in range(min(3, end + 1)):
            h = 0
            for k in range(n + 1):
                h = (h ^ ord(text[end - k])) * mult[k] & 0xFFFFFFFF
                h ^= h >> 15
            yield (h * 0x27D4EB2F & 0xFFFFFFFF) >> shift


def plain_model(docs):
    """Counts, sizes and numbers of documents by language, of (doc_id, text, lang) rows."""
    counts, number = {}, Counter()
    for _, text, lang in docs:
        if lang and text is not None:
            counts.setdefault(lang, Counter()).update(plain_grams(text))
            number[lang] += 1
    return counts, {k: sum(c.values()) + 0.5 * lid.BUCKETS for k, c in counts.items()}, {k: number[k] + 1 for k in sorted(counts)}


def plain_scores(model, text):
    counts, size, number = model
    grams = Counter(plain_grams(text or ""))
    total = {k: math.log(number[k] / sum(number.values())) + sum(n * math.log((counts[k][b] + 0.5) / size[k]) for b, n in grams.items()) for k in number}
    return total, max(sum(grams.values()), 1)


def test_query_equals_brute_force(spark, sf):
    """Training and decisions of the whole table by dictionaries and loops."""
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert max(Counter(lang for _, _, lang in docs).values()) <= lid.TRAIN_PER_LANGUAGE  # so all are trained on
    model = plain_model(docs)
    rows = {r.doc_id: r for r in lid.op4_language_id(spark, sf).collect()}
    assert len(rows) == len(docs)
    for doc, text, lang in docs:
        got = rows[doc]
        if not (text or "").strip():
            assert not got.accepted and got.predicted is None
            continue
        total, grams = plain_scores(model, text)
        best = max(total, key=total.get)
        assert got.predicted == best and math.isclose(got.margin, (total[best] - total[lang]) / grams, abs_tol=2e-5)
        assert got.accepted == (best == lang or got.margin <= lid.MARGIN)


def test_grams_across_slices_count(monkeypatch):
    """The evidence may lie on the edge of a slice."""
    text = "some words of a text \U00010400 that is cut anywhere " * 3
    whole, model = lid.tally(text), lid.train(pd.DataFrame({"lang": ["a", "b"], "text": [text, "other things"]}))
    expected = lid.score(model, [text, "x", text])
    assert whole.sum() == 3 * len(text) - 3 and whole.tolist() == np.bincount(list(plain_grams(text)), minlength=lid.BUCKETS).tolist()
    for size in (2, 3, 7, 50):
        monkeypatch.setattr(lid, "_SLICE", size)
        assert (lid.tally(text) == whole).all()
        got = lid.score(model, [text, "x", text])
        assert np.allclose(got[0], expected[0]) and (got[1] == expected[1]).all()


def test_only_letters_count():
    assert lid._codes("a1\U0001f600\U00010428").tolist() == [ord("a"), 32, 32, 0x10428]


def test_more_labels_than_languages(spark, monkeypatch):
    monkeypatch.setattr(lid, "MOST_LANGUAGES", 2)
    docs = spark.createDataFrame([(1, "abc", "a"), (2, "abd", "a"), (3, "xyz", "b"), (4, "xyy", "b"), (5, "qqq", "junk")], "doc_id bigint, text string, lang string")
    assert lid.fit(docs).languages == ("a", "b")
    assert {r.doc_id: r.accepted for r in lid.identify(docs, lid.fit(docs)).collect()}[5]
