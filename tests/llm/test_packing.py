from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import packing


def brute(lengths, capacity):
    """Piece by piece, longest first: the shortest open pack takes it, of equals the one opened first."""
    packs = []
    for length in sorted(lengths, reverse=True):
        best = min(range(len(packs)), key=lambda k: sum(packs[k]), default=None)
        if best is not None and sum(packs[best]) + length <= capacity:
            packs[best].append(length)
        else:
            packs.append([length])
    return packs


def spelled(patterns):
    return [[length for length, times in runs for _ in range(times)] for runs, count in patterns for _ in range(count)]


@settings(max_examples=400, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 40), max_size=12), st.sampled_from([40, 64, 97]))
def test_plan_equals_placing_one_by_one(histogram, capacity):
    """Ties included: packs come in the order of opening, each with the same lengths."""
    assert spelled(packing.plan(histogram, capacity)) == brute([n for n, c in histogram.items() for _ in range(c)], capacity)


def test_one_copy_a_pack_before_the_next_round():
    assert spelled(packing.plan({11: 1, 10: 1, 4: 2}, 20)) == [[11, 4], [10, 4]]
    assert spelled(packing.plan({9: 1, 7: 1, 1: 1}, 10)) == [[9], [7, 1]]


def test_plan_of_a_large_histogram_is_small():
    patterns = packing.plan({n: 10**7 // n + 1 for n in range(1, 2048)}, 2048)
    assert len(patterns) < 3 * 2048 and sum(c * sum(n * t for n, t in runs) for runs, c in patterns) == sum(n * (10**7 // n + 1) for n in range(1, 2048))


@pytest.mark.parametrize("capacity", [16, 300])
def test_query_equals_brute_force(spark, sf, capacity):
    """Packs as multisets of lengths, over a whole small table."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    words = [len(r.text.split()) for r in docs.collect()]
    expected = Counter(tuple(p) for p in brute([n % capacity for n in words if n % capacity], capacity)) + Counter({(capacity,): sum(n // capacity for n in words)})
    packs = defaultdict(list)
    for r in packing.packed(docs, capacity).collect():
        packs[r.pack_id].append((r.slot, r.n_words))
    assert Counter(tuple(n for _, n in sorted(p)) for p in packs.values()) == expected


def test_ties_go_by_bucket_and_id(spark):
    """Equal lengths: which document is where is defined, so two runs and two layouts agree; equal rows share the place order."""
    docs = spark.createDataFrame([(i // 2, "a b c") for i in range(400)], "doc_id bigint, text string")
    one = Counter(map(tuple, packing.packed(docs, 7).collect()))
    assert one == Counter(map(tuple, packing.packed(docs.repartition(5), 7).collect()))
    assert len({r[0] for r in one}) == 200


@pytest.mark.parametrize("capacity", [16, 2048])
def test_every_word_has_one_place(spark, sf, capacity):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    words = {r.doc_id: len(r.text.split()) for r in docs.collect()}
    rows = packing.packed(docs, capacity).collect()
    covered, packs = defaultdict(list), defaultdict(list)
    for r in rows:
        covered[r.doc_id].append((r.start_word, r.start_word + r.n_words))
        packs[r.pack_id].append(r)
    for doc, n in words.items():
        at = 0
        for a, b in sorted(covered[doc]):
            assert a == at
            at = b
        assert at == n
    for members in packs.values():
        assert sum(r.n_words for r in members) == members[0].pack_words <= capacity
        assert sorted(r.slot for r in members) == list(range(len(members)))
    assert sorted(packs) == list(range(len(packs)))


def test_odd_rows(odd_docs, no_docs):
    rows = packing.packed(odd_docs).collect()
    ids = Counter(r.doc_id for r in rows if r.piece == 0)
    assert ids == Counter({4: 2, 5: 1, 6: 1, 7: 1, 8: 1, 9: 1, 10: 1})
    assert sum(r.n_words for r in rows if r.doc_id == 6) == 180_000
    assert packing.packed(no_docs).collect() == []


def test_result_does_not_depend_on_partitions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    a = sorted(map(tuple, packing.packed(docs).collect()))
    assert a == sorted(map(tuple, packing.packed(docs.repartition(7)).collect()))
