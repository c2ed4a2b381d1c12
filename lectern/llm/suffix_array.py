"""Operator 1, suffix-array dedup by induced sorting.

Passages are brought together before any suffix is sorted. Each passage of ``MIN_WORDS`` words
belongs to its minimizer, the smallest-hashing run of ``ANCHOR`` words in it; equal passages
have equal minimizers. Minimizers that occur once are dropped after one narrow shuffle. Around
every other one the run of passages that belong to it is cut out of its document and sent to
the shard that its minimizer hashes to. So all places of a passage meet in one shard, shards
are independent, and what is sorted is the repetitive part of the corpus only.

No minimizer gathers an unbounded group. Equal runs of a slice of the input are folded before
they are sent: one is, the others are known to be redundant. Runs of a minimizer that occurs at
more than ``HOT`` places are cut once more, by the largest-hashing window of each passage, which
equal passages share as well.

In a shard, distinct runs are concatenated with a separator of its own after each, and:

1. suffixes are classified as S or L from the right;
2. the leftmost S-type (LMS) substrings are sorted by induction from their first symbols and
   named; if names repeat, the string of names is sorted by the same procedure, recursively;
3. the shard's suffix array is induced from the sorted LMS suffixes in two linear scans;
4. permuted longest common prefixes follow from the irreducible ones: PLCP[i] >= PLCP[i-1] - 1.

Neighbours in the array that share ``MIN_WORDS`` words are one passage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import Windows, mix64, persist_table, table
from lectern.llm.spans import BROADCAST_ROWS, FIRST, LATER, MIN_WORDS, PLACES, folded, merged_spans, packed, part_of, places, pos_of, shared, spread, streams, texts

ANCHOR = 10
#: Words sorted in one suffix array, unless the runs of one minimizer alone have more.
SHARD_WORDS = 200_000
#: Places of a minimizer, folded by slices, from which its runs are cut once more.
HOT = 4096


# ---- induced sorting ----------------------------------------------------------------------


def classify(s: np.ndarray) -> np.ndarray:
    """True where a suffix is S-type (smaller than the one after it). ``s`` ends in a unique smallest symbol."""
    different = np.flatnonzero(s[:-1] != s[1:])
    kind = np.ones(len(s), bool)
    # each position takes the order of the first unequal pair at or after it
    at = different[np.searchsorted(different, np.arange(len(s) - 1))]
    kind[:-1] = s[at] < s[at + 1]
    return kind


def _names(s: np.ndarray, kind: np.ndarray, lms: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks of the LMS substrings, in the order that induction from their first symbols gives."""
    sa = _induce(s, kind, lms)
    is_lms = np.zeros(len(s), bool)
    is_lms[lms] = True
    ordered = sa[is_lms[sa]]
    # neighbours in that order are one name if lengths, symbols and kinds agree
    code = 2 * s.astype(np.int64) + kind
    length = np.zeros(len(s), np.int64)
    length[lms] = np.diff(np.append(lms, len(s) - 1)) + 1  # from one LMS position through the next
    a, b = ordered[:-1], ordered[1:]
    same = length[a] == length[b]
    open_, step = np.flatnonzero(same), 0
    while len(open_):
        equal = code[a[open_] + step] == code[b[open_] + step]
        same[open_[~equal]] = False
        step += 1
        open_ = open_[equal & (length[a[open_]] > step)]
    names = np.zeros(len(s), np.int64)
    names[ordered] = np.append(0, np.cumsum(~same))
    return names[lms], int(names[ordered[-1]]) + 1


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes of a string of integers, in order."""
    if len(s) < 2:
        return np.arange(len(s))
    return _sorted(np.append(np.unique(s, return_inverse=True)[1] + 1, 0))[1:]


def _sorted(s: np.ndarray) -> np.ndarray:
    """The same for a string over 0..k that ends in its only 0."""
    kind = classify(s)
    lms = np.flatnonzero(kind[1:] & ~kind[:-1]) + 1
    names, distinct = _names(s, kind, lms)
    # the last LMS substring is the closing 0 alone, so the string of names ends in its only 0, too
    order = np.argsort(names) if distinct == len(lms) else _sorted(names)
    return _induce(s, kind, lms[order])


def _induce(s: np.ndarray, kind: np.ndarray, lms_order: np.ndarray) -> np.ndarray:
    n = len(s)
    sizes = np.bincount(s)
    ends = np.cumsum(sizes)
    text, smaller = s.tolist(), kind.tolist()
    sa = [-1] * n
    tails = ends.tolist()
    for j in reversed(lms_order.tolist()):
        c = text[j]
        tails[c] -= 1
        sa[tails[c]] = j
    heads = (ends - sizes).tolist()
    for j in sa:  # the list fills ahead of the scan
        if j > 0:
            j -= 1
            if not smaller[j]:
                c = text[j]
                sa[heads[c]] = j
                heads[c] += 1
    tails = ends.tolist()
    for i in range(n - 1, -1, -1):
        j = sa[i] - 1
        if j >= 0 and smaller[j]:
            c = text[j]
            tails[c] -= 1
            sa[tails[c]] = j
    return np.array(sa, np.int64)


def permuted_lcp(s: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """PLCP[i]: symbols that suffix i shares with the one before it in the array (0 for the first)."""
    n = len(s)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    i = np.arange(n)
    irreducible = (before <= 0) | (i == 0)
    inner = ~irreducible
    irreducible[inner] = s[i[inner] - 1] != s[before[inner] - 1]
    at = np.flatnonzero(irreducible & (before >= 0))
    plcp = np.zeros(n, np.int64)
    shared_, todo = np.zeros(len(at), np.int64), np.arange(len(at))
    while len(todo):
        a, b = at[todo] + shared_[todo], before[at[todo]] + shared_[todo]
        fits = np.maximum(a, b) < n
        todo, a, b = todo[fits], a[fits], b[fits]
        todo = todo[s[a] == s[b]]
        shared_[todo] += 1
    plcp[at] = shared_
    start = np.maximum.accumulate(np.where(irreducible, i, 0))
    return np.maximum(plcp[start] - (i - start), 0)


# ---- a shard ------------------------------------------------------------------------------


def _shard(runs: list[tuple[str, np.ndarray, bool]], min_words: int) -> pd.DataFrame | None:
    """Repeated passages among runs of (text, places, repeated in a slice): intervals of words.

    A place is a row (document, part and first word). Runs that repeat in their slice count as
    twice, their later places being decided already.
    """
    words = [r[0].split("\n") for r in runs]
    lengths = np.array([len(w) for w in words])
    codes, _ = pd.factorize(np.array([w for ws in words for w in ws], dtype=object))
    k = len(runs)
    ends = np.cumsum(lengths + 1)
    s = np.empty(ends[-1], np.int64)
    text = np.ones(len(s), bool)
    text[ends - 1] = False
    s[text] = codes + k
    s[~text] = np.arange(k)[::-1]
    sa = suffix_array(s)
    lcp = permuted_lcp(s, sa)[sa]
    owner = np.repeat(np.arange(k), lengths + 1)
    offset = np.arange(len(s)) - (ends - lengths - 1)[owner]
    group = np.cumsum(lcp < min_words)
    places_ = [np.unique(r[1], axis=0) for r in runs]
    many = np.array([len(p) for p in places_])
    twice = np.array([r[2] for r in runs], bool)
    begins = lengths[owner[sa]] - offset[sa] >= min_words  # else the run ends before the passage does
    pos, group = sa[begins], group[begins]
    who, off = owner[pos], offset[pos]
    repeat = np.bincount(group, (many + twice)[who]) > 1
    keep = repeat[group]
    pos, group, who, off = pos[keep], group[keep], who[keep], off[keep]
    if not len(pos):
        return None
    # every place of every such passage
    n = many[who]
    entry = np.repeat(np.arange(len(pos)), n)
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    stacked, begin = np.concatenate(places_), np.cumsum(many) - many
    at = stacked[begin[who[entry]] + inside]
    doc, first, group, sure = at[:, 0], at[:, 1] + off[entry], group[entry], twice[who[entry]]
    order = np.lexsort((~sure, first, doc, group))
    doc, first, group, sure = doc[order], first[order], group[order], sure[order]
    once = np.append(True, (np.diff(group) != 0) | (np.diff(doc) != 0) | (np.diff(first) != 0))
    doc, first, group, sure = doc[once], first[once], group[once], sure[once]
    lead = np.append(True, np.diff(group) != 0)
    size = np.add.reduceat(1 + sure.astype(np.int64), np.flatnonzero(lead))
    real = np.repeat(size > 1, np.diff(np.append(np.flatnonzero(lead), len(group))))
    doc, first, redundant = doc[real], first[real], ~lead[real]
    order = np.lexsort((first, doc, redundant))
    doc, first, redundant = doc[order], first[order], redundant[order]
    if not len(doc):
        return None
    cut = np.flatnonzero(np.append(True, (np.diff(doc) != 0) | (np.diff(first) > 1) | (redundant[1:] != redundant[:-1])))
    stop = np.append(cut[1:], len(doc)) - 1
    return _intervals(doc[cut], first[cut], first[stop] + min_words, redundant[cut])


def _intervals(doc: np.ndarray, start: np.ndarray, end: np.ndarray, redundant: np.ndarray) -> pd.DataFrame:
    low = np.int64(0xFFFFFFFF)
    return pd.DataFrame({"doc_id": doc, "part": (start >> 32).astype(np.int32), "s": (start & low).astype(np.int32), "e": (end & low).astype(np.int32), "redundant": redundant})


def repeats(docs: DataFrame, min_words: int = MIN_WORDS, *, id_col: str = "doc_id", text_col: str = "text", hot: int | None = None) -> DataFrame:
    """(doc_id, part, s, e, redundant): intervals of every passage of ``min_words`` words that occurs at two places."""
    span, hot = min_words - ANCHOR + 1, HOT if hot is None else hot
    if span < 1:
        raise ValueError(f"a passage has at least {ANCHOR} words")

    def minimizers(counts: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each run of passages with one minimizer: first word of the first and of the last passage, the minimizer."""
        _, _, left = places(counts)
        starts = np.flatnonzero(left >= min_words)
        if not len(starts):
            return (np.zeros(0, np.int64),) * 3
        choice = np.empty(len(starts), np.int64)
        view = np.lib.stride_tricks.sliding_window_view(h, span)
        for a in range(0, len(starts), 1 << 14):
            part = starts[a : a + (1 << 14)]
            choice[a : a + (1 << 14)] = part + view[part].argmin(axis=1)
        new = np.append(True, (np.diff(choice) != 0) | (np.diff(starts) != 1))
        first = np.flatnonzero(new)
        return starts[first], starts[np.append(first[1:], len(starts)) - 1], choice[first]

    def windows(hashes: np.ndarray) -> np.ndarray:
        return Windows(hashes).at(np.arange(max(0, len(hashes) - ANCHOR + 1)), ANCHOR)

    def anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ids, counts, _, hashes, parts in streams(batch["doc_id"].tolist(), batch["text"].tolist(), batch["part"].tolist()):
                h = windows(hashes)
                _, _, m = minimizers(counts, h)
                owner, position, _ = places(counts)
                doc, code = ids[owner[m]], (np.array(parts, np.int64)[owner[m]] << 32) | position[m]
                order, state = folded([h[m]], doc, code)
                yield pd.DataFrame({"h": h[m][order].view(np.int64), "doc_id": doc[order], "at": packed(code[order], state)})

    def split(h: np.ndarray, a: int, b: int, m: int) -> Iterator[tuple[int, int, np.uint64]]:
        """A run of a hot minimizer, cut where the largest window of its passages changes; each part with a key of both."""
        top = np.lib.stride_tricks.sliding_window_view(h[a : b + span], span).argmax(axis=1) + np.arange(a, b + 1)
        first = np.flatnonzero(np.append(True, np.diff(top) != 0))
        for x, y in zip(first, np.append(first[1:], len(top)) - 1):
            yield a + int(x), a + int(y), mix64(h[m : m + 1] ^ mix64(h[top[x] : top[x] + 1]))[0]

    def cut_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            extra = list(zip(batch["part"].tolist(), batch["anchors"], batch["hot"]))
            for ids, counts, words, hashes, marks in streams(batch["doc_id"].tolist(), batch["text"].tolist(), extra):
                h = windows(hashes)
                a, b, m = minimizers(counts, h)
                owner, position, _ = places(counts)
                begins = np.cumsum(counts) - counts
                marked, burning = np.zeros(len(owner), bool), np.zeros(len(owner), bool)
                for begin, (_, found, many) in zip(begins, marks):
                    marked[begin + np.asarray(found, np.int64)] = True
                    burning[begin + np.asarray(many, np.int64)] = True
                keep = marked[m]
                a, b, m = a[keep], b[keep], m[keep]
                key = h[m]
                if burning[m].any():
                    rows = [(x, y, k) for x, y, k, w in zip(a, b, key, m) if not burning[w]] + [r for x, y, w in zip(a, b, m) if burning[w] for r in split(h, x, y, w)]
                    a, b = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
                    key = np.array([r[2] for r in rows], np.uint64)
                run = ["\n".join(words[x : y + min_words]) for x, y in zip(a.tolist(), b.tolist())]
                same = pd.factorize(np.array(run, dtype=object))[0].astype(np.uint64) if run else np.zeros(0, np.uint64)
                doc, code = ids[owner[a]], (np.array([r[0] for r in marks], np.int64)[owner[a]] << 32) | position[a]
                order, state = folded([key, same], doc, code)
                size = (b - a)[order] + min_words
                yield pd.DataFrame({"h": key[order].view(np.int64), "doc_id": doc[order], "at": packed(code[order], state), "n": size.astype(np.int32), "run": [run[i] if st != LATER else None for i, st in zip(order.tolist(), state.tolist())]})

    def sort_shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        groups: list[tuple[str, np.ndarray, bool]] = []
        size, pending, last = 0, {}, None

        def close() -> None:  # the runs of one minimizer are complete
            nonlocal size
            if len(pending) > 1 or any(len(at) > 1 or twice[0] for at, twice in pending.values()):
                for text, (at, twice) in pending.items():
                    groups.append((text, np.array(at, np.int64), twice[0]))
                    size += text.count("\n") + 2
            pending.clear()

        for batch in batches:
            later = (batch["at"].to_numpy() & 3) == LATER
            if later.any():
                gone = batch[later]
                start = gone["at"].to_numpy(np.int64) >> 2
                yield _intervals(gone["doc_id"].to_numpy(), start, start + gone["n"].to_numpy(), np.ones(len(gone), bool))
            batch = batch[~later]
            keys = batch["h"].to_numpy()
            cuts = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1)) if len(keys) else []
            for a, b in zip(cuts, np.append(cuts[1:], len(keys)) if len(keys) else []):
                if keys[a] != last:
                    close()
                    last = keys[a]
                    if size >= SHARD_WORDS:
                        if (found := _shard(groups, min_words)) is not None:
                            yield found
                        groups, size = [], 0
                part = batch.iloc[a:b]
                for text, doc, at in zip(part["run"].tolist(), part["doc_id"].tolist(), part["at"].tolist()):
                    places_, twice = pending.setdefault(text, ([], [False]))
                    places_.append((doc, at >> 2))
                    twice[0] |= at & 3 == FIRST
        close()
        if groups and (found := _shard(groups, min_words)) is not None:
            yield found

    slim = texts(docs, id_col, text_col)
    marked = persist_table(shared(slim.mapInPandas(anchors, PLACES), "h", named=True).select("doc_id", "at", "h", "n"), "minimizers", last=True)
    burning = marked.where(F.col("n") > hot).select("h").distinct()
    n = burning.count()
    if n:
        burning = burning.withColumn("hot", F.lit(True))
        marked = marked.join(F.broadcast(burning) if n <= BROADCAST_ROWS else burning, "h", "left")
    else:
        marked = marked.withColumn("hot", F.lit(False))
    by_text = marked.groupBy("doc_id", part_of().alias("part")).agg(F.collect_set(pos_of()).alias("anchors"), F.collect_set(F.when(F.col("hot"), pos_of())).alias("hot"))
    runs = slim.join(by_text, ["doc_id", "part"]).select("doc_id", "part", "text", "anchors", "hot").mapInPandas(cut_runs, PLACES + ", n int, run string")
    runs = runs.withColumn("h", spread("h")).repartition("h").sortWithinPartitions("h")
    return runs.mapInPandas(sort_shards, "doc_id bigint, part int, s int, e int, redundant boolean")


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Maximal repeated spans, in words from 0: (doc_id, start_word, end_word, n_words, n_cut).

    ``n_cut`` words of a span lie in a passage that occurred before, by (doc_id, part, position).
    Documents without a repeat aren't listed; neither are null, empty and short texts, or rows
    without id. Rows that repeat an id and a text are one document and no repeat of each other;
    different texts under one id are compared like any two, and the spans of each are listed.
    """
    return merged_spans(repeats(docs, min_words, id_col=id_col, text_col=text_col))


def op1_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents"))
