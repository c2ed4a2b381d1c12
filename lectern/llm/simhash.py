"""Operator 8, SimHash near-dedup with anchor-point covering.

A fingerprint has 256 bits: bit k is the majority of bit k over the hashes of the text's
distinct words (lower case, punctuation dropped). Documents are near duplicates if their
fingerprints differ in at most ``THRESHOLD`` bits.

The search is exact. A fingerprint is cut into 21 blocks (``PARTS``), each with a number of bits
that may differ in it; the values of a block are its anchors. A fingerprint has its home at its own
value and is sent to every anchor within the block's number. If two fingerprints differed by more
than that in every block, they would be 43 bits apart at least, so all pairs of up to 42 bits meet
at some home, where they are compared on all 256 bits.

Fingerprints that are equal are folded into one before anything is replicated, so thousands of
exact copies cost one comparison. The others are spread over chunks of bounded size by hash; a cell
is two chunks, of which one supplies the homes and one the members, so no group sits in one task
whatever the texts have in common. A cell reports for each near duplicate one fingerprint of
its local component instead of all pairs, and the number of its links; a pair that meets in
several blocks is counted in the first only. Components over all cells come from alternating
large-star and small-star steps, each cut by a written table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.common import discard, flatten, like, mix64, persist_table, pick, table, tidied, word_hashes

BITS, BLOCKS, BLOCK_THRESHOLD, THRESHOLD = 256, 11, 1, 42
#: Blocks of the search: bits, and how many of them may differ. One more in each makes THRESHOLD + 1 in all.
PARTS = [(14, 2)] + [(13, 1)] * 2 + [(12, 1)] * 18
#: Fingerprints in a chunk, about; a cell compares two chunks.
CELL = 1 << 17
#: Cells of up to so many pairs are compared as a whole, which is faster there than block by block.
WHOLE = 1 << 30
#: Pairs compared at once, and pairs close on two words before all bits are looked at.
_TILE, _HELD = 1 << 16, 1 << 20
_F = ["f0", "f1", "f2", "f3"]
_WORD = re.compile(r"\w+")
_BATCH = 1 << 20
_SEEDS = np.array([0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89], np.uint64)


# ---- fingerprints -------------------------------------------------------------------------


def fingerprints(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(texts, 4) unsigned words, and which texts have a fingerprint at all (those with a word)."""
    out, has = np.zeros((len(texts), 4), np.uint64), np.zeros(len(texts), bool)
    pending: list[tuple[int, list[str]]] = []
    held = 0

    def flush() -> None:
        nonlocal held
        who = np.array([i for i, _ in pending])
        lengths = np.array([len(w) for _, w in pending])
        h = word_hashes([w for _, ws in pending for w in ws])
        starts = np.cumsum(lengths) - lengths
        for a in range(0, len(pending)):  # slices of at most 2**16 words bound the unpacked bits
            ones = np.zeros(BITS, np.int64)
            mine = h[starts[a] : starts[a] + lengths[a]]
            for s in range(0, len(mine), 1 << 16):
                words = mix64(mine[s : s + (1 << 16), None] ^ _SEEDS[None, :])
                ones += np.unpackbits(words.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            out[who[a]] = np.packbits(2 * ones > lengths[a], bitorder="little").view(np.uint64)
        pending.clear()
        held = 0

    for i, text in enumerate(texts):
        words = list(dict.fromkeys(_WORD.findall(text.lower()))) if isinstance(text, str) else []
        if words:
            has[i] = True
            pending.append((i, words))
            held += len(words)
            if held >= _BATCH // 8:
                flush()
    if pending:
        flush()
    return out, has


# ---- the Golay code: coarser anchors, which near_duplicates doesn't use as pairs within THRESHOLD may miss each other there

_POLY = 0b101011100011


def _syndrome(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.int64)
    for bit in range(22, 10, -1):
        x = np.where(x >> bit & 1, x ^ (_POLY << (bit - 11)), x)
    return x


def _cosets(radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All error patterns of weight up to ``radius`` sorted by syndrome; where each syndrome starts; their weights."""
    patterns = np.array([sum(1 << b for b in bits) for w in range(radius + 1) for bits in combinations(range(23), w)], np.int64)
    weights = np.bitwise_count(patterns.astype(np.uint64)).astype(np.int64)
    syndromes = _syndrome(patterns)
    order = np.lexsort((weights, syndromes))
    return patterns[order], np.searchsorted(syndromes[order], np.arange(2049)), weights[order]


_PATTERNS, _STARTS, _WEIGHTS = _cosets(3 + BLOCK_THRESHOLD)


def blocks_of(prints: np.ndarray, blocks: int = BLOCKS) -> np.ndarray:
    """(fingerprints, blocks) 23-bit values, consecutive from bit 0."""
    out = np.zeros((len(prints), blocks), np.int64)
    for b in range(blocks):
        lo, word = (23 * b) % 64, 23 * b // 64
        v = prints[:, word] >> np.uint64(lo)
        if lo > 41:
            v = v | (prints[:, word + 1] << np.uint64(64 - lo))
        out[:, b] = (v & np.uint64((1 << 23) - 1)).astype(np.int64)
    return out


def anchors(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each 23-bit value the codewords within radius 4: index of the value, codeword, whether it is its home."""
    s = _syndrome(values)
    n = _STARTS[s + 1] - _STARTS[s]
    who = np.repeat(np.arange(len(values)), n)
    at = np.repeat(_STARTS[s], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return who, values[who] ^ _PATTERNS[at], _WEIGHTS[at] <= 3


def homes_of(values: np.ndarray) -> np.ndarray:
    """The codeword within radius 3 of each 23-bit value: the lightest pattern of a syndrome comes first."""
    s = _syndrome(values)
    return values ^ _PATTERNS[_STARTS[s]]


# ---- comparing in a cell ------------------------------------------------------------------

LEFT, RIGHT, BOTH = 1, 2, 3


def _prints(frame: pd.DataFrame) -> np.ndarray:
    """(4, fingerprints) unsigned words."""
    return np.stack([frame[f"f{k}"].to_numpy(np.int64).view(np.uint64) for k in range(4)])


def _values(prints: np.ndarray, part: int) -> np.ndarray:
    """The bits of a block."""
    low, bits = sum(n for n, _ in PARTS[:part]), PARTS[part][0]
    word, low = divmod(low, 64)
    v = prints[word] >> np.uint64(low)
    if low + bits > 64:
        v = v | (prints[word + 1] << np.uint64(64 - low))
    return (v & np.uint64((1 << bits) - 1)).astype(np.int64)


def _close(a: np.ndarray, b: np.ndarray, threshold: int, room: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Columns (i, j) of a and b that differ in at most ``threshold`` bits of the first two words. Rooms hold a tile, or a row if that is more."""
    n = b.shape[1]
    step = max(1, _TILE // max(n, 1))
    for s in range(0, a.shape[1], step):
        rows = a[:2, s : s + step, None]
        size = rows.shape[1] * n
        x, d, more = (r[:size].reshape(rows.shape[1], n) for r in (room, counts[0], counts[1]))
        np.bitwise_count(np.bitwise_xor(rows[0], b[0], out=x), out=d)
        np.bitwise_count(np.bitwise_xor(rows[1], b[1], out=x), out=more)
        d += more
        at = np.flatnonzero(d <= threshold)
        if len(at):
            yield at // n + s, at % n


def _meetings(a: np.ndarray, b: np.ndarray, part: int, threshold: int, *rooms: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of the columns (i, j) where b's was sent to a's home in this block, those that ``_close`` finds."""
    bits, reach = PARTS[part]
    ball = np.array([sum(1 << k for k in at) for w in range(reach + 1) for at in combinations(range(bits), w)], np.int64)
    home, other = _values(a, part), _values(b, part)
    left, right = np.argsort(home, kind="stable"), np.argsort(other, kind="stable")
    a, b = a[:2, left], b[:2, right]
    sizes = np.bincount(other, minlength=1 << bits)
    starts = np.cumsum(sizes) - sizes
    values, begins = np.unique(home[left], return_index=True)
    for v, lo, hi in zip(values.tolist(), begins.tolist(), np.append(begins[1:], len(home)).tolist()):
        near = v ^ ball
        n = sizes[near]
        ends = n.cumsum()
        if not ends[-1]:
            continue
        members = np.repeat(starts[near] - ends + n, n) + np.arange(ends[-1])
        for i, j in _close(a[:, lo:hi], b[:, members], threshold, *rooms):
            yield left[i + lo], right[members[j]]


def _pairs(a: np.ndarray, b: np.ndarray, group: int, groups: int, threshold: int, whole: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of a cell within the threshold, each in one of the groups of blocks, once."""
    rooms = np.empty(max(_TILE, b.shape[1]), np.uint64), np.empty((2, max(_TILE, b.shape[1])), np.uint8)
    if threshold > THRESHOLD or a.shape[1] * b.shape[1] <= whole:
        searches = [(0, _close(a, b, threshold, *rooms))] if group == 0 else []
    else:
        searches = [(part, _meetings(a, b, part, threshold, *rooms)) for part in range(group, len(PARTS), groups)]
    for part, found in searches:
        for i, j in _gathered(found):
            x = a[:, i] ^ b[:, j]
            near = np.bitwise_count(x).sum(axis=0, dtype=np.int64) <= threshold
            i, j, x = i[near], j[near], x[:, near]
            first = np.ones(len(i), bool)
            for p in range(part):  # those that met in a block before were found there
                first &= np.bitwise_count(_values(x, p)) > PARTS[p][1]
            yield i[first], j[first]


def _gathered(found: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs in batches that are worth the calls."""
    held, size = [], 0
    for pair in found:
        held.append(pair)
        size += len(pair[0])
        if size >= _HELD:
            yield tuple(np.concatenate(c) for c in zip(*held))
            held, size = [], 0
    if held:
        yield tuple(np.concatenate(c) for c in zip(*held))


def _joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest member of each component, for labels to which edges come."""
    i, j = label[i], label[j]
    apart = i != j
    i, j = i[apart], j[apart]
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            return label


def _cell(nodes: np.ndarray, prints: np.ndarray, counts: np.ndarray, side: np.ndarray, group: int, groups: int, threshold: int, whole: int) -> tuple[np.ndarray, ...]:
    """Of a cell: (node, one node of its component) for those that aren't it; (node, links) for those that have any."""
    lefts, rights = np.flatnonzero(side & LEFT), np.flatnonzero(side & RIGHT)
    label, links = np.arange(len(nodes)), np.zeros(len(nodes), np.int64)
    for i, j in _pairs(prints[:, lefts], prints[:, rights], group, groups, threshold, whole):
        i, j = lefts[i], rights[j]
        once = (i < j) | (side[i] != BOTH)  # a chunk against itself finds every pair from both ends
        i, j = i[once], j[once]
        np.add.at(links, i, counts[j])
        np.add.at(links, j, counts[i])
        label = _joined(label, i, j)
    changed, linked = np.flatnonzero(label != np.arange(len(nodes))), np.flatnonzero(links)
    return nodes[changed], nodes[label[changed]], nodes[linked], links[linked]


def _compare(groups: int, threshold: int, whole: int):
    """Over rows sorted by cell: edges (a, b, links null) and links (a, null, links)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []

        def cells(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
            key, nodes, side, counts, prints = frame["cell"].to_numpy(), frame["node"].to_numpy(), frame["side"].to_numpy(), frame["n"].to_numpy(), _prints(frame)
            cuts = np.flatnonzero(np.diff(key, prepend=key[:1] - 1, append=key[-1:] + 1))
            found = [_cell(nodes[a:b], prints[:, a:b], counts[a:b], side[a:b], int(key[a] % groups), groups, threshold, whole) for a, b in zip(cuts[:-1], cuts[1:]) if b - a > 1]
            if found:
                edges = pd.DataFrame({"a": np.concatenate([f[0] for f in found]), "b": np.concatenate([f[1] for f in found])}).drop_duplicates()
                links = pd.DataFrame({"a": np.concatenate([f[2] for f in found]), "links": np.concatenate([f[3] for f in found])}).groupby("a", as_index=False).sum()
                yield pd.concat([edges, links]).astype({"a": "Int64", "b": "Int64", "links": "Int64"})[["a", "b", "links"]]

        for batch in batches:  # sorted by cell; a cell may go on in the next batch
            if not len(batch):
                continue
            last = batch["cell"].iloc[-1]
            tail = batch["cell"].to_numpy() == last
            if tail.all():
                if rest and rest[-1]["cell"].iloc[0] != last:
                    yield from cells(pd.concat(rest))
                    rest = []
                rest.append(batch)
                continue
            yield from cells(pd.concat([*rest, batch[~tail]]))
            rest = [batch[tail]]
        if rest:
            yield from cells(pd.concat(rest))

    return run


def links_of(nodes: DataFrame, threshold: int = THRESHOLD, cell: int = CELL, whole: int = WHOLE) -> DataFrame:
    """Of distinct fingerprints (node, n, f0 to f3): edges (a, b, links null) that join all near ones, and links (a, null, links), weighted by n."""
    size = nodes.count()
    chunks = max(1, -(-size // cell))
    groups = 7 if chunks <= 3 else 3 if chunks <= 8 else 1  # of blocks, so that few chunks still make some tasks
    cells = chunks * (chunks + 1) // 2 * groups
    tasks = min(cells, max(64, size * chunks * groups >> 17))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    sent = nodes.select("node", "n", *_F, F.pmod(F.xxhash64("node"), F.lit(chunks)).alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("other"))
    side = F.when(F.col("own") == F.col("other"), BOTH).when(F.col("own") == low, LEFT).otherwise(RIGHT).cast("tinyint")
    sent = sent.withColumn("pair", F.floor(high * (high + 1) / 2).cast("long") + low)
    sent = sent.select(F.explode(F.sequence(F.col("pair") * groups, F.col("pair") * groups + groups - 1)).alias("cell"), side.alias("side"), "node", "n", *_F)
    compare = _compare(groups, threshold, whole)
    return sent.repartitionById(tasks, F.pmod("cell", F.lit(tasks)).cast("int")).sortWithinPartitions("cell").mapInPandas(lambda batches: tidied(compare(batches)), "a bigint, b bigint, links bigint")


# ---- components ---------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each connected component of edges (a, b), for nodes that aren't it.

    Alternates large-star and small-star until nothing changes; the number of rounds grows
    with the logarithm of the longest chain. Each round's edges are written to shared storage.
    """
    edges = persist_table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = Window.partitionBy("a")
        big = both.withColumn("m", F.least("a", F.min("b").over(least))).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small = big.withColumn("m", F.min("b").over(least))
        small = small.select("a", F.col("m").alias("b")).unionByName(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()
        before, edges = edges, persist_table(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(before)
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now


# ---- the operator -------------------------------------------------------------------------


def _classes(docs: DataFrame, threshold: int, id_col: str, text_col: str, cell: int) -> DataFrame:
    """(doc_id, t, class_id, n_links, redundant) for every row with an id and a text; t is the text's hash."""

    def prints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            f, has = fingerprints(batch["text"].tolist())
            signed = f.view(np.int64)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "t": batch["t"], **{f"f{k}": pd.arrays.IntegerArray(signed[:, k].copy(), ~has) for k in range(4)}})

    slim = pick(docs, doc_id=id_col, text=text_col).where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("t"), "text")
    made = persist_table(slim.mapInPandas(lambda batches: tidied(prints(batches)), "doc_id bigint, t bigint, f0 bigint, f1 bigint, f2 bigint, f3 bigint"), "prints")
    # one node for each fingerprint; its number is fixed by being written
    nodes = made.where("f0 is not null").groupBy(*_F).agg(F.count("*").alias("n"), F.min("doc_id").alias("least"))
    nodes = persist_table(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    met = persist_table(links_of(nodes, threshold, cell), "met")
    roots = components(met.where("b is not null").select("a", "b"))
    links = met.where("links is not null").groupBy("a").agg(F.sum("links").alias("links"))
    grouped = nodes.join(roots.withColumnRenamed("node", "a"), F.col("node") == F.col("a"), "left").drop("a")
    grouped = grouped.withColumn("class", F.coalesce("root", "node")).join(links, F.col("node") == F.col("a"), "left")
    least = grouped.groupBy("class").agg(F.min("least").alias("class_id"))
    told = grouped.join(least, "class").select(*_F, "class", "class_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    rows = made.join(told, _F)
    # the row that stays: of the class's smallest id, the smallest text hash
    stays = rows.where("doc_id = class_id").groupBy("class").agg(F.min("t").alias("stay"))
    judged = rows.join(stays, "class").select("doc_id", "t", "class_id", "n_links", ((F.col("doc_id") != F.col("class_id")) | (F.col("t") != F.col("stay"))).alias("redundant"))
    return judged.unionByName(made.where("f0 is null").select("doc_id", "t", *_alone()))


def _alone() -> list[Column]:
    return [F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(False).alias("redundant")]


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, *, id_col: str = "doc_id", text_col: str = "text", cell: int = CELL) -> DataFrame:
    """(doc_id, class_id, n_links, redundant) for every row with an id.

    ``class_id`` is the smallest id of the row's group, ``n_links`` the number of rows whose
    fingerprints are within the threshold of its own; links aren't spelled out as pairs. One row
    of each group isn't redundant: that with the smallest id (of several texts under it, the one
    that hashes lowest). Null, blank and wordless texts have no fingerprint and are groups of
    their own. Rows that repeat an id are rows like any other. Groups are transitive: a chain of
    near duplicates is one group.
    """
    found = _classes(docs, threshold, id_col, text_col, cell).drop("t")
    bare = pick(docs, doc_id=id_col, text=text_col).where("doc_id is not null and text is null").select(F.col("doc_id").cast("long"))
    return found.unionByName(bare.select("doc_id", *_alone()))


def deduplicated(docs: DataFrame, threshold: int = THRESHOLD, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``near_duplicates`` calls redundant, all columns kept.

    Of rows that repeat an id and a text, one stays; different texts under one id are judged each
    for itself. Rows without id, and those without a word, all stay.
    """
    rows = _classes(docs, threshold, id_col, text_col, CELL)
    marks = rows.where("n_links > 0").groupBy(F.col("doc_id").alias("__id"), F.col("t").alias("__t")).agg(F.min("redundant").alias("__gone"), F.count("*").alias("__n")).where("__gone or __n > 1")
    flat, at = flatten(docs)
    known = F.col(at[id_col]).isNotNull() & F.col(at[text_col]).isNotNull()
    named = flat.where(known).withColumn("__hash", F.xxhash64(at[text_col]))
    kept = named.join(marks, (F.col(at[id_col]).cast("long") == F.col("__id")) & (F.col("__hash") == F.col("__t")), "left").where(~F.coalesce("__gone", F.lit(False)))
    by = Window.partitionBy(at[id_col], "__hash").orderBy(F.col("__n"))
    once = kept.where("__n > 1").withColumn("rn", F.row_number().over(by)).where("rn = 1")
    return like(kept.where("__n is null"), docs).union(like(once, docs)).union(like(flat.where(~known), docs))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
