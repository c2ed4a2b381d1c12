from difflib import SequenceMatcher

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.operators import candidates as K
from lectern.operators import matching as M


def plain_span(page, excerpt, least=0.72):
    for i in range(len(page) - len(excerpt) + 1):
        if excerpt and page[i : i + len(excerpt)] == excerpt:
            return i, i + len(excerpt), 1.0
    best, n = None, len(excerpt)
    low = max(1, int(n * 0.75))
    for size in range(low, min(len(page), max(low, int(n * 1.35) + 2)) + 1):
        for start in range(len(page) - size + 1):
            score = SequenceMatcher(a=excerpt, b=page[start : start + size], autojunk=False).ratio()
            if best is None or score > best[2]:
                best = start, start + size, score
    return best if n and best and best[2] >= least else None


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=14), st.lists(st.sampled_from("abcd"), max_size=8))
def test_spans_equal_a_search_of_all_windows(page, excerpt):
    got = M.best_span(page, excerpt, 0.72)
    assert (got[:3] if got else None) == plain_span(page, excerpt)


def test_match_tokens():
    assert M.match_tokens("The eﬃcient, co­op — ＡＢ x² ...") == ["the", "efficient", "coop", "ab", "x2"]


def test_best_excerpts_equal_a_loop(spark):
    from lectern.plans.matching import _QUERY, best_excerpts

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    asked = M.hashed_words([_QUERY])[0]
    for r in best_excerpts(spark, sf).collect():
        words = texts[r.doc_id].split()
        starts = [s for s in range(0, len(words), 35) if s == 0 or (len(words) - s >= 12 and s + 35 < len(words))]
        vectors = M.hashed_words([" ".join(words[s : s + 70]) for s in starts])
        scores = [round(float(v @ asked / (np.linalg.norm(v) * np.linalg.norm(asked) or 1)), 6) for v in vectors]
        assert abs(max(scores) - r.score) < 2e-6
        text = " ".join(words)
        assert r.excerpt == text if len(text) <= 300 else len(r.excerpt.replace("[...] ", "").replace(" [...]", "")) <= 300


def test_excerpts_and_marks(spark):
    row = spark.createDataFrame([("one two three four five six seven eight", "five six", {"four": "red", "seven": "bold"})], "t string, w string, m map<string,string>")
    got = row.select(M.excerpt_around(F.col("t"), F.col("w"), 12).alias("e"), M.excerpt_around(F.col("t"), F.lit("none"), 100).alias("all"), M.marked_text(F.col("t"), F.col("m"), {"red": ("<", ">"), "bold": ("*", "*")}).alias("k")).first()
    assert "five" in got.e and got.e.startswith("[...] ") and got.e.endswith(" [...]") and got["all"].startswith("one")
    assert got.k == "one two three <four> five six *seven* eight"


@pytest.mark.parametrize("answer, ids", [('{"section_headings": []}', []), ("[]", []), ("```json\n[{\"candidate_id\": 1, \"section_title\": \"T\"}]\n```", [1]), ("", []), ("{", []), (None, [])])
def test_answers_of_all_kinds(spark, answer, ids):
    rows = spark.createDataFrame([(1, 0, answer)], "doc_id bigint, seq int, answer string")
    known = spark.createDataFrame([(1, 0), (1, 1)], "doc_id bigint, candidate_id int")
    assert [r.candidate_id for r in K.parsed_answers(rows, known).collect()] == ids


def test_review_retries_and_gives_up(spark):
    rows = spark.createDataFrame([(1, k, 1, h, h, [], []) for k, h in enumerate(["ok", "bad", "bad", "late"])] + [(2, 0, 1, "ok", "ok", [], [])], "doc_id bigint, candidate_id int, page int, heading string, line_text string, before array<string>, after array<string>")

    def ask(item):
        if item["heading"] == "bad":
            raise RuntimeError("down")
        return "yes"

    got = {(r.doc_id, r.candidate_id): (r.answer, r.error) for r in K.reviewed(rows, ask).collect()}
    assert got == {(1, 0): ("yes", None), (1, 1): (None, "down"), (1, 2): (None, "down"), (1, 3): (None, "not asked"), (2, 0): ("yes", None)}


def test_candidates_have_ids_and_context(spark):
    lines = ["prose one", "A. Time evolutionManuscript We first", "prose two", "so we see 3 Results", "Abstract", "x"]
    df = spark.createDataFrame([(7, i, 1, t) for i, t in enumerate(lines)], "doc_id bigint, line_index int, page int, text string")
    got = K.with_context(df).orderBy("candidate_id").collect()
    assert [(r.candidate_id, r.line_index, r.candidate_text) for r in got] == [(0, 1, "A. Time"), (1, 3, "3 Results"), (2, 3, "Results"), (3, 4, "Abstract")]
    assert got[0].before == ["prose one"] and got[0].after == ["prose two", "so we see 3 Results"] and got[3].after == ["x"]




def test_screening_excerpts_equal_a_loop(spark):
    from lectern.operators import sections

    def tokens(text):
        return max(1, -(-len(text) // 4)) if text else 0

    def cut(text, most):
        if tokens(text) <= most:
            return text
        room = max(1000, max(1000, most * 4) - len("[... omitted ...]") - 4)
        tail = max(250, room // 3)
        head = max(250, room - tail)
        return text[:head].rstrip() + "\n\n[... omitted ...]\n\n" + text[-tail:].lstrip()

    rows = [(1, k, None, title, " ".join(f"w{k}x{i}" for i in range(n))) for k, (title, n) in enumerate([("Introduction", 30), ("Methods", 900), ("References", 10), ("Results", 700), ("Methods", 5), ("Conclusion", 20)])]
    rows += [(2, None, None, None, "only front matter"), (3, 0, None, "Abstract", "word " * 9000)]
    frame = spark.createDataFrame(rows, "doc_id bigint, section_index int, number string, title string, text string")
    got = {(r.doc_id, r.section_index): (r.text, r.was_cut) for r in sections.screening_excerpts(frame, context=2500).collect()}
    expected = {}
    for doc, chosen in ((1, [0, 1, 3, 5]), (2, [None]), (3, [0])):
        texts = {r[1]: " ".join(r[4].split()) for r in rows if r[0] == doc}
        shown = {r[1]: r[3] or "front matter" for r in rows if r[0] == doc}
        used, share = 0, max(100, 1000 // len(chosen))
        for k in chosen:
            text = cut(texts[k], min(share, max(100, 1000 - used)))
            size = tokens(shown[k]) + tokens(text) + 20
            if used >= 1000 or (used + size > 1000 and used):
                break
            expected[doc, k] = (text, text != texts[k])
            used += size
    assert got == expected
