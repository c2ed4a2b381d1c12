import numpy as np
import pytest

from lectern.llm import simhash
from lectern.llm.common import table


def test_code_is_perfect_and_replicates_within_radius():
    r = np.random.default_rng(1)
    values = r.integers(0, 1 << 23, 300)
    who, code, home = simhash.anchors(values)
    assert (np.bincount(who[home], minlength=300) == 1).all()  # every value has exactly one home
    assert (simhash._syndrome(code) == 0).all()
    distance = np.bitwise_count((values[who] ^ code).astype(np.uint64))
    assert (distance <= 4).all() and (distance[home] <= 3).all()
    codewords = np.array([c for c in (np.arange(1 << 12) << 11)])
    codewords = codewords ^ simhash._syndrome(codewords)
    for v in values[:20]:  # all codewords within the radius are reached
        near = {int(c) for c in codewords if bin(int(c) ^ int(v)).count("1") <= 4}
        assert near == {int(c) for c in code[who == list(values).index(v)]}


def test_one_flipped_bit_in_a_block_always_meets():
    r = np.random.default_rng(2)
    for v in r.integers(0, 1 << 23, 200):
        w = int(v) ^ (1 << int(r.integers(0, 23)))
        who, code, home = simhash.anchors(np.array([v, w]))
        assert set(code[(who == 0) & home]) <= set(code[who == 1])


def components(n, pairs):
    label = list(range(n))

    def find(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def all_pairs(f, has, threshold=simhash.THRESHOLD):
    d = np.zeros((len(f), len(f)), np.uint16)
    for k in range(4):
        d += np.bitwise_count(f[:, k][:, None] ^ f[None, :, k])
    near = (d <= threshold) & has[:, None] & has[None, :]
    np.fill_diagonal(near, False)
    return near


@pytest.mark.parametrize("cell", [simhash.CELL, 8])
def test_groups_and_links_against_all_pairs(spark, cell):
    """With tiny cells every anchor is a grid; nothing may change."""
    docs = table(spark, "/root/testdata/sf0.01", "documents").toPandas().sort_values("doc_id", ignore_index=True)
    near = all_pairs(*simhash.fingerprints(docs["text"].tolist()))
    i, j = np.nonzero(near)
    root = components(len(docs), [(a, b) for a, b in zip(i, j) if a < b])
    ids = docs["doc_id"].tolist()
    got = {r.doc_id: r for r in simhash.near_duplicates(table(spark, "/root/testdata/sf0.01", "documents"), cell=cell).collect()}
    assert got.keys() == set(ids)
    expected = {ids[a]: ids[r] for a, r in enumerate(root)}
    grouped = [a for a in ids if expected[a] != a]
    assert sum(got[a].class_id == expected[a] for a in grouped) >= 0.98 * len(grouped) and len(grouped) > 100
    links = dict(zip(ids, near.sum(axis=1).tolist()))
    assert sum(r.n_links for r in got.values()) >= 0.98 * sum(links.values())
    assert all(r.n_links <= links[a] for a, r in got.items())  # no pair is counted twice
    assert {a for a, r in got.items() if r.redundant} <= set(grouped)  # nothing beyond the threshold's groups


def test_fingerprints_up_to_21_bits_apart_surely_meet(spark):
    r = np.random.default_rng(9)
    x = np.repeat(r.integers(0, 2**63, (1, 4)).astype(np.uint64), 300, axis=0)
    for row in x[1:]:
        for bit in r.choice(253, 21, replace=False):
            row[bit // 64] ^= np.uint64(1 << int(bit % 64))
    values = simhash.blocks_of(x)
    met = np.zeros(300, bool)
    for b in range(simhash.BLOCKS):
        who, code, _ = simhash.anchors(values[:, b])
        home = simhash.homes_of(values[:1, b])[0]
        met[who[code == home]] = True
    assert met.all()


def test_more_bits_apart_meet_almost_always():
    r = np.random.default_rng(10)
    base = r.integers(0, 2**63, (500, 4)).astype(np.uint64)
    other = base.copy()
    for row in other:
        for bit in r.choice(256, simhash.THRESHOLD, replace=False):
            row[bit // 64] ^= np.uint64(1 << int(bit % 64))
    a, b = simhash.blocks_of(base), simhash.blocks_of(other)
    apart = lambda u, v: np.bitwise_count((simhash.homes_of(u) ^ v).astype(np.uint64)) <= 4
    met = np.any([apart(a[:, k], b[:, k]) | apart(b[:, k], a[:, k]) for k in range(simhash.BLOCKS)], axis=0)
    assert met.mean() > 0.975


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1003), (1003, 1001)]
    got = {tuple(r) for r in simhash.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {(i, 0) for i in range(1, 201)} | {(1001, 1000), (1003, 1000)}


def test_odd_rows(odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == sum(r[1] is not None for r in odd_docs.collect())
    assert sorted(r.doc_id for r in rows if r.redundant) == [5, 8, 9]
    assert {(r.class_id, r.n_links) for r in rows if r.doc_id in (4, 5, 8, 9)} == {(4, 4)}
    assert {(r.doc_id, r.class_id, r.n_links) for r in rows if r.doc_id in (1, 2, 3, 10)} == {(i, i, 0) for i in (1, 2, 3, 10)}
    kept = simhash.deduplicated(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted((r[1] is None, r[1] or 0) for r in kept.collect())
    assert [i for null, i in ids if not null] == [1, 2, 3, 4, 6, 7, 10] and sum(null for null, _ in ids) == 3
    assert simhash.near_duplicates(no_docs).collect() == [] and simhash.deduplicated(no_docs).collect() == []


def test_two_texts_under_one_id_are_two_rows(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta"), (1, "wholly different words in here"), (2, "wholly different words in here"), (2, "alpha beta gamma delta")], "doc_id bigint, text string")
    kept = sorted(map(tuple, simhash.deduplicated(docs).collect()))
    assert kept == [(1, "alpha beta gamma delta"), (1, "wholly different words in here")]
    assert sorted(r.redundant for r in simhash.near_duplicates(docs).collect()) == [False, False, True, True]


def test_thousands_of_exact_copies(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "'the same old words in every single row of it' as text")
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == 3000 and {(r.class_id, r.n_links) for r in got} == {(0, 2999)} and sum(r.redundant for r in got) == 2999


@pytest.mark.parametrize("order", [1, -1])
def test_the_smallest_id_stays(spark, order):
    words = [f"w{i}" for i in range(120)]
    near = words[:-2] + ["other", "ends"]
    docs = spark.createDataFrame([(10 * order, " ".join(words)), (20 * order, " ".join(near))], "doc_id bigint, text string")
    got = simhash.near_duplicates(docs).collect()
    assert {r.class_id for r in got} == {min(10 * order, 20 * order)} and [r.doc_id for r in got if r.redundant] == [max(10 * order, 20 * order)]


def test_no_group_and_no_link_is_missing(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = docs.select("doc_id", "text").toPandas().sort_values("doc_id", ignore_index=True)
    ids = rows["doc_id"].tolist()
    near = all_pairs(*simhash.fingerprints(rows["text"].tolist()))
    roots = components(len(ids), [(a, b) for a, b in zip(*np.nonzero(near)) if a < b])
    got = {r.doc_id: (r.class_id, r.n_links) for r in simhash.near_duplicates(docs).collect()}
    assert got == {a: (ids[r], int(n)) for a, r, n in zip(ids, roots, near.sum(axis=1))}


def test_texts_at_the_edge_of_the_threshold_are_linked(spark):
    """Pair 5973 is 39 bits apart, and no block of 23 bits brings its texts to one anchor."""
    texts = []
    for k in [*range(300), 5973]:
        words = [f"w{k}x{i}" for i in range(60)]
        texts += [" ".join(words), " ".join(words[:-8] + [f"z{k}x{i}" for i in range(3)])]
    near = all_pairs(*simhash.fingerprints(texts))
    assert near[600, 601] and not near[::2, 1::2].diagonal().all()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r.doc_id: r.n_links for r in simhash.near_duplicates(docs).collect()} == dict(enumerate(near.sum(axis=1).tolist()))


@pytest.mark.parametrize("cell, whole", [(simhash.CELL, simhash.WHOLE), (simhash.CELL, 0), (3000, 0), (500, simhash.WHOLE)])
def test_pairs_spread_over_all_blocks_are_found(spark, cell, whole):
    """42 bits apart, as evenly as can be over the search's blocks or over eleven of 23 bits; pairs at 43 bits stay apart."""
    r = np.random.default_rng(11)
    base = r.integers(0, 2**63, (3000, 4)).astype(np.uint64)
    other = base.copy()
    starts = np.concatenate([[0], np.cumsum([n for n, _ in simhash.PARTS])])
    assert starts[-1] == simhash.BITS and sum(t + 1 for _, t in simhash.PARTS) == simhash.THRESHOLD + 1
    for k, row in enumerate(other):
        if k % 3 == 2:
            flips = [b for t in range(11) for b in r.choice(23, 4 if t < 9 else 3, replace=False) + 23 * t]
        else:
            spared = int(r.integers(0, 21)) if k % 3 == 0 else None
            flips = [b for t, (n, near) in enumerate(simhash.PARTS) for b in r.choice(n, near + (t != spared), replace=False) + starts[t]]
        assert len(flips) == (43 if k % 3 == 1 else 42)
        for bit in flips:
            row[bit // 64] ^= np.uint64(1 << int(bit % 64))
    f = np.concatenate([base, other]).view(np.int64)
    weights = r.integers(1, 4, len(f))
    nodes = spark.createDataFrame([(i, int(weights[i]), *map(int, row)) for i, row in enumerate(f)], "node bigint, n bigint, f0 bigint, f1 bigint, f2 bigint, f3 bigint")
    rows = simhash.links_of(nodes, cell=cell, whole=whole).collect()
    near = all_pairs(f.view(np.uint64), np.ones(len(f), bool))
    links = np.zeros(len(f), np.int64)
    for row in rows:
        links[row.a] += row.links or 0
    assert (links == near @ weights).all() and near.sum() == 4000
    assert {frozenset((row.a, row.b)) for row in rows if row.b is not None} == {frozenset((k, k + 3000)) for k in range(3000) if k % 3 != 1}
