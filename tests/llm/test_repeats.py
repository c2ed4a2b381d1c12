import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import substring, suffix_array
from lectern.llm.spans import without_words


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=0, max_size=60))
def test_suffix_array_is_the_sorted_suffixes(values):
    s = np.array(values, np.int64)
    expected = sorted(range(len(values)), key=lambda i: values[i:])
    assert suffix_array.suffix_array(s).tolist() == expected


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=2, max_size=60))
def test_permuted_common_prefixes(values):
    s = np.array(values, np.int64)
    sa = suffix_array.suffix_array(s)
    plcp = suffix_array.permuted_lcp(s, sa)
    for a, b in zip(sa[:-1], sa[1:]):
        n = 0
        while max(a, b) + n < len(values) and values[a + n] == values[b + n]:
            n += 1
        assert plcp[b] == n
    assert plcp[sa[0]] == 0


def test_long_runs_sort_right():
    s = np.array(([7] * 400 + [3, 5] * 300) * 3)
    text = s.tolist()
    assert suffix_array.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: text[i:])


def test_cover_is_a_difference_cover():
    for a in range(substring.PERIOD):
        for b in range(substring.PERIOD):
            assert any((a + k) % substring.PERIOD in substring.COVER and (b + k) % substring.PERIOD in substring.COVER for k in range(substring.PERIOD))


def brute(docs, m):
    """Spans by comparing every passage of m words with every other."""
    seen = defaultdict(list)
    words = {d: t.split() for d, t in docs if d is not None and t}
    for d in sorted(words):
        for i in range(len(words[d]) - m + 1):
            seen[tuple(words[d][i : i + m])].append((d, i))
    every, cut = defaultdict(set), defaultdict(set)
    for places in seen.values():
        if len(places) > 1:
            for k, (d, i) in enumerate(sorted(places)):
                every[d].add(i)
                if k:
                    cut[d] |= set(range(i, i + m))
    out = set()
    for d, starts in every.items():
        spans = []
        for i in sorted(starts):
            if spans and i <= spans[-1][1]:
                spans[-1][1] = i + m
            else:
                spans.append([i, i + m])
        out |= {(d, a, b, b - a, len(cut[d] & set(range(a, b)))) for a, b in spans}
    return out, cut


def corpus(seed):
    r = random.Random(seed)
    shared = [" ".join(r.choice("abcdefgh") * r.randint(1, 2) for _ in range(r.randint(30, 90))) for _ in range(6)]
    docs = []
    for d in range(60):
        parts = []
        for _ in range(r.randint(0, 4)):
            parts.append(r.choice(shared) if r.random() < 0.4 else " ".join(str(r.randint(0, 10**6)) for _ in range(r.randint(1, 60))))
        docs.append((d * 3, " ".join(parts)))
    docs += [(200, "x " * 300), (201, "x " * 120), (202, "y z " * 100)]  # periodic texts repeat themselves
    return docs


@pytest.mark.parametrize("operator", [substring, suffix_array])
@pytest.mark.parametrize("seed", [1, 2])
def test_spans_equal_brute_force(spark, operator, seed):
    docs = corpus(seed)
    expected, _ = brute(docs, 50)
    assert expected
    got = operator.repeated_spans(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert {tuple(r) for r in got} == expected and len(got) == len(expected)


def test_cut_text_equals_brute_force(spark):
    docs = corpus(3)
    _, cut = brute(docs, 50)
    got = {r.doc_id: r for r in substring.deduplicated(spark.createDataFrame([(d, t, len(t)) for d, t in docs], "doc_id bigint, text string, n_chars bigint")).collect()}
    for d, t in docs:
        left = [w for i, w in enumerate(t.split()) if i not in cut[d]]
        if not cut[d]:
            assert got[d].text == t
        elif not left:
            assert d not in got
        else:
            assert got[d].text.split() == left and got[d].n_chars == len(got[d].text)


def test_white_space_around_a_cut():
    assert without_words("a\nb  c d", [(1, 3)]) == "a\nd"
    assert without_words("a b c", [(1, 3)]) == "a"
    assert without_words(" a", []) == " a"


@pytest.mark.parametrize("operator", [substring, suffix_array])
def test_odd_rows(spark, operator, odd_docs, no_docs):
    found = operator.repeated_spans(odd_docs)
    assert found.columns == ["doc_id", "start_word", "end_word", "n_words", "n_cut"]
    assert found.collect() == []  # short texts have no passage; the long one repeats nothing of 50 words
    assert operator.repeated_spans(no_docs).collect() == []


def test_cutting_odd_rows(odd_docs, no_docs):
    kept = substring.deduplicated(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, odd_docs.collect()))
    assert substring.deduplicated(no_docs).collect() == []


@pytest.mark.parametrize("operator", [substring, suffix_array])
def test_copies_and_ties(spark, operator):
    """Of equal texts the smallest id is the original; rows that repeat an id and text are one document."""
    text = " ".join(f"w{i}" for i in range(70))
    docs = spark.createDataFrame([(9, text), (3, text), (3, text), (5, text)], "doc_id bigint, text string")
    got = {(r.doc_id, r.n_words, r.n_cut) for r in operator.repeated_spans(docs).collect()}
    assert got == {(3, 70, 0), (5, 70, 70), (9, 70, 70)}


def test_many_copies_of_a_passage(spark):
    text = " ".join(f"w{i}" for i in range(55))
    docs = spark.createDataFrame([(i, f"head{i} " + text) for i in range(3000)], "doc_id bigint, text string")
    a = {tuple(r) for r in substring.repeated_spans(docs).collect()}
    assert a == {(i, 1, 56, 55, 55 if i else 0) for i in range(3000)}
    assert {tuple(r) for r in suffix_array.repeated_spans(docs).collect()} == a


@pytest.mark.parametrize("operator", [substring, suffix_array])
def test_two_texts_under_one_id(spark, operator):
    """Different texts of one id are told apart: their places are, and a cut in one leaves the other alone."""
    passage = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(80))
    docs = spark.createDataFrame([(1, passage), (1, other), (2, "x y " + passage)], "doc_id bigint, text string")
    got = sorted(tuple(r) for r in operator.repeated_spans(docs).collect())
    assert got == [(1, 0, 60, 60, 0), (2, 2, 62, 60, 60)]
    if operator is substring:
        assert sorted(r.text for r in substring.deduplicated(docs).collect()) == sorted([passage, other, "x y"])
    both = spark.createDataFrame([(7, "a " + passage), (7, "b " + passage)], "doc_id bigint, text string")
    assert sorted(r.n_cut for r in operator.repeated_spans(both).collect()) == [0, 60]


@pytest.mark.parametrize("operator", [substring, suffix_array])
def test_repeats_inside_a_very_long_text(spark, operator):
    r = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(77))
    words = [str(r.random()) for _ in range(150_000)]
    text = " ".join([*words[:400], passage, *words[400:140_000], passage, *words[140_000:]])
    got = {tuple(x) for x in operator.repeated_spans(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).collect()}
    assert got == {(1, 400, 477, 77, 0), (1, 140_077, 140_154, 77, 77)}


def test_hot_minimizers_are_cut_once_more(spark):
    docs = corpus(4)
    expected, _ = brute(docs, 50)
    from lectern.llm.spans import merged_spans

    found = suffix_array.repeats(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(20), hot=1)
    assert {tuple(r) for r in merged_spans(found).collect()} == expected


def test_folding_a_slice():
    from lectern.llm.spans import ALONE, FIRST, LATER, folded

    key = np.array([5, 5, 9, 5, 5], np.uint64)
    ids, at = np.array([2, 1, 1, 3, 1]), np.array([0, 4, 0, 1, 4])
    order, state = folded([key], ids, at)
    got = {(int(ids[i]), int(at[i])): int(s) for i, s in zip(order, state)}
    assert got == {(1, 4): FIRST, (1, 0): ALONE, (2, 0): LATER, (3, 1): LATER} and len(order) == 4
