import math
import re
import unicodedata

import numpy as np
import pandas as pd

from lectern.llm import quality as q


def simulated(seed=3, n=40_000, share=0.8):
    """Votes of known accuracy, independent given the truth, with abstentions that say nothing."""
    r = np.random.default_rng(seed)
    good = r.random(n) < share
    votes = np.zeros((n, len(q.RULES)), int)
    for k in range(len(q.RULES)):
        right = r.random(n) < (0.9 if k % 2 else 0.75)
        votes[:, k] = np.where(r.random(n) < 0.6, np.where(good == right, 1, -1), 0)
    patterns = pd.DataFrame(votes, columns=list(q.RULES)).groupby(list(q.RULES)).size().reset_index(name="count")
    return patterns, votes, good


def posterior(prior, table, votes):
    odds = np.log(prior / (1 - prior)) + sum(np.log(table[1, k, votes[:, k] + 1] / table[0, k, votes[:, k] + 1]) for k in range(votes.shape[1]))
    return 1 / (1 + np.exp(-odds))


def test_em_finds_the_accuracies():
    patterns, votes, good = simulated()
    prior, table = q.estimate(patterns)
    assert abs(prior - 0.8) < 0.02
    for k in range(len(q.RULES)):
        accuracy = 0.9 if k % 2 else 0.75
        assert abs(table[1, k, 2] - accuracy) < 0.03 and abs(table[0, k, 0] - accuracy) < 0.03 and table[0, k, 1] == table[1, k, 1] == 1
    assert ((posterior(prior, table, votes) >= 0.5) == good).mean() > 0.95


def plain_votes(text):
    """The rules once more, word by word, without anything of the module's."""
    if not text or not text.strip():
        return [-1] + [0] * 8
    words, lines = re.split(r"[ \t\n\x0b\f\r]+", text.lower()), text.split("\n")
    n, chars = len(words), len(text)
    of = lambda test: sum(map(test, text)) / chars
    letters, capitals = of(lambda c: unicodedata.category(c)[0] == "L"), of(lambda c: unicodedata.category(c) == "Lu")
    symbols, shouts = of(lambda c: c in "#$%&*|{}<>^~=_@\\"), of(lambda c: c == "!")
    variety, line_variety = len(set(words)) / n, len(set(lines)) / len(lines)
    stutter = sum(a == b for a, b in zip(words, words[1:])) / n
    stops = len(set(words) & set(q.STOPWORDS))

    def vote(bad, good):
        return -1 if bad else 1 if good else 0

    return [
        vote(n < 3, n >= 20), vote(letters < 0.68, letters >= 0.76), vote(n >= 20 and variety < 0.25, n >= 20 and variety > 0.4), vote(n >= 20 and stops < 1, stops >= 2),
        vote(symbols > 0.02, n >= 10 and symbols < 0.005), vote(capitals > 0.2 and n >= 5, n >= 10 and capitals < 0.1), vote(shouts > 0.01, n >= 10 and shouts < 0.002),
        vote(len(lines) >= 4 and line_variety < 0.7, len(lines) >= 2 and line_variety > 0.9), vote(n >= 10 and stutter > 0.15, n >= 10 and stutter < 0.05),
    ]


def plain_em(votes):
    """Expectation-maximisation document by document, in plain Python."""
    good = [1 / (1 + math.exp(-(1.0 + 0.4 * v.count(1) - 2.0 * v.count(-1)))) for v in votes]
    for _ in range(50):
        prior = (sum(good) + 1) / (len(good) + 2)
        table = []
        for k in range(len(q.RULES)):
            row = []
            for side in (0, 1):
                w = [g if side else 1 - g for g in good]
                no, yes = (sum(x for x, v in zip(w, votes) if v[k] == s) + 1.0 for s in (-1, 1))
                row.append({-1: no / (no + yes), 1: yes / (no + yes)})
            table.append(row)
        good = []
        for v in votes:
            odds = math.log(prior / (1 - prior)) + sum(math.log(table[k][1][x] / table[k][0][x]) for k, x in enumerate(v) if x)
            good.append(1 / (1 + math.exp(-max(-50, min(50, odds)))))
    return good


def test_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    votes = [plain_votes(r.text) for r in docs]
    posterior_ = dict(zip([r.doc_id for r in docs], plain_em(votes)))
    rows = {r.doc_id: r for r in q.op9_quality(spark, sf).collect()}
    assert rows.keys() == posterior_.keys()
    for r, v in zip(docs, votes):
        assert [rows[r.doc_id][name] for name in q.RULES] == v, r.text[:80]
        assert math.isclose(rows[r.doc_id].p_quality, posterior_[r.doc_id], abs_tol=2e-6)
        assert rows[r.doc_id].keep == (rows[r.doc_id].p_quality >= q.KEEP)


def test_agrees_with_labels(spark):
    """Labels that the operator never sees."""
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = {r.doc_id: r.keep for r in q.op9_quality(spark, "/root/testdata/sf0.01").collect()}
    right = [rows[d] == (y == 1) for d, y in labels.items() if d in rows]
    assert sum(right) >= 0.95 * len(right)
    good = [rows[d] for d, y in labels.items() if y == 1]
    assert sum(good) >= 0.98 * len(good)


def test_ties_and_extremes(spark):
    """No vote at all: the posterior is the prior; equal documents, equal posteriors."""
    docs = spark.createDataFrame([(1, "five words and no more"), (2, "five words and no more"), (3, "!" * 40), (4, None)], "doc_id bigint, text string")
    rows = {r.doc_id: r for r in q.assessed(docs).collect()}
    assert rows[1].p_quality == rows[2].p_quality and all(0 <= r.p_quality <= 1 for r in rows.values())
    assert [rows[i][v] for i in (1, 2) for v in q.RULES] == 2 * [rows[1][v] for v in q.RULES]


def test_counts_of_patterns_are_all_that_matters():
    patterns, _, _ = simulated(n=2000)
    twice = pd.concat([patterns.assign(count=1), patterns.assign(count=patterns["count"] - 1)])
    a, b = q.estimate(patterns), q.estimate(twice[twice["count"] > 0])
    assert np.isclose(a[0], b[0]) and np.allclose(a[1], b[1])


def test_query_equals_numpy(spark, sf):
    rows = q.assessed(spark.read.parquet(f"{sf}/documents.parquet")).toPandas()
    prior, table = q.estimate(rows.groupby(list(q.RULES)).size().reset_index(name="count"))
    assert np.allclose(rows["p_quality"], posterior(prior, table, rows[list(q.RULES)].to_numpy(int)), atol=2e-6)
    assert (rows["keep"] == (rows["p_quality"] >= q.KEEP)).all()




def test_odd_rows(odd_docs, no_docs):
    rows = q.assessed(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(r.p_quality is not None for r in rows)
    blank = [r for r in rows if r.doc_id in (1, 2, 3)]
    assert {r.v_length for r in blank} == {-1} and {sum(abs(r[v]) for v in q.RULES) for r in blank} == {1}
    assert q.assessed(no_docs).collect() == []
    assert q.estimate(pd.DataFrame({**{v: [] for v in q.RULES}, "count": []}))[0] == 0.5
