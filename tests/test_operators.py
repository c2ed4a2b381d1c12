import json
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lectern.functions import headings, metadata, references
from lectern.functions import text as T
from lectern.operators import chunking, duplicates, evidence, layout, links, reports, sections, storage, vectors


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(expression(F.col("c")).alias("x")).first()[0]


@pytest.mark.parametrize("target", [1, 12, 50])
def test_chunk_breaks_equal_the_greedy_rule(target):
    r = random.Random(target)
    for _ in range(50):
        words = ["w" * r.randint(1, 20) for _ in range(r.randint(0, 60))]
        expected, current = [], ""
        for w in words:
            if current and len(current) + 1 + len(w) > target:
                expected.append(current)
                current = w
            else:
                current = f"{current} {w}" if current else w
        expected += [current] if current else []
        got = [" ".join(words[a:b]) for a, b in chunking.breaks(np.array([len(w) for w in words], np.int64), target)]
        assert got == expected


def test_section_chunks_keep_pages_and_run_on(spark):
    lines = [{"page": 1, "text": "one two"}, {"page": 2, "text": "three"}]
    rows = [(7, None, None, lines), (7, 0, "Results", [{"page": 3, "text": "four five six"}])]
    frame = spark.createDataFrame(rows, "doc_id bigint, section_index int, section_title string, lines array<struct<page:int,text:string>>")
    got = [(r.chunk_index, r.section_index, r.page_start, r.page_end, r.text) for r in chunking.section_chunks(frame, 9).orderBy("chunk_index").collect()]
    assert got == [(0, None, 1, 1, "one two"), (1, None, 2, 2, "three"), (2, 0, 3, 3, "four five"), (3, 0, 3, 3, "six")]


@pytest.mark.parametrize("given, expected", [("DEEP LEARNING OF THE DNA CODE", "Deep Learning of the DNA Code"), ("Mixed CASE", "Mixed CASE"), ("ABC", "ABC"), ("WORLD WAR II", "World War II"), ("", None), (None, None)])
def test_title_case(spark, given, expected):
    assert one(spark, given, metadata.title_case) == expected


@pytest.mark.parametrize("given, expected", [("WILLIAM O'NEIL and YORAM SMITH-JONES", "William O'Neil and Yoram Smith-Jones"), ("VINCENT VAN DYKE", "Vincent van Dyke"), ("Ada Byron", "Ada Byron")])
def test_name_case(spark, given, expected):
    assert one(spark, given, metadata.name_case) == expected


@pytest.mark.parametrize("given, expected", [("Ada Byron and Bo van der Berg; C. Dee Jr.", ["Byron", "van der Berg", "Dee"]), ("unknown", []), ("Ann (Lab) Lee & Q", ["Lee", None])])
def test_names_and_surnames(spark, given, expected):
    assert one(spark, given, lambda c: F.transform(T.author_names(c), T.surname)) == expected


def test_first_page_guess(spark):
    def guess(c):
        lines, block = metadata.first_lines(c), metadata.title_block(c)
        return F.struct(metadata.title_guess(lines, block), metadata.authors_guess(lines, block))

    assert tuple(one(spark, "12\nA Study of\nCorpus Methods\nAda Byron\nAbstract", guess)) == ("A Study of Corpus Methods", "Ada Byron")
    assert tuple(one(spark, "", guess)) == (None, None)


def test_registry_record(spark):
    work = json.dumps({"title": ["On Maps"], "author": [{"given": "Ada", "family": "Byron"}, {"name": "THE GROUP"}], "created": {"date-parts": [[1999]]}, "DOI": "10.1/a"})
    assert tuple(one(spark, work, metadata.registry_record)) == ("On Maps", "Ada Byron, The Group", 1999, "10.1/a")
    assert tuple(one(spark, "no json", metadata.registry_record)) == (None, None, None, None)


@pytest.mark.parametrize("line, expected", [("Abstract", True), ("3.1 LLM Setup", True), ("Figure 3 shows", False), ("12", False), ("School of Maps", False), ("plain prose here", False), ("Results:", True), ("", False)])
def test_headings(spark, line, expected):
    assert one(spark, line, headings.is_heading) == expected


def test_heading_scan_needs_two(spark):
    lines = [(1, 0, 1, "Abstract"), (1, 3, 1, "ABSTRACT"), (2, 0, 1, "Abstract"), (2, 4, 2, "1. Introduction"), (2, 9, 9, "Results")]
    got = {tuple(r)[:3] for r in sections.heading_lines(spark.createDataFrame(lines, "doc_id bigint, line_index int, page int, text string")).collect()}
    assert got == {(2, 0, "Abstract"), (2, 4, "1. Introduction")}


def test_screening_is_sequential(spark):
    """A section that is dropped for its title doesn't register its text."""
    rows = [(1, 0, None, "Intro", "a"), (1, 1, None, "Intro", "b"), (1, 2, None, "Other", "b"), (1, 3, None, "Third", "a"), (1, 4, None, "References", "c")]
    frame = spark.createDataFrame(rows, "doc_id bigint, section_index int, number string, title string, text string")
    assert sorted(r.section_index for r in sections.screening(frame).collect()) == [0, 2]


def test_references(spark):
    folded = "[1] Ada wrote a book of many pages [2] Bob wrote another book of pages [3] Cyd wrote"
    assert not one(spark, folded, references.looks_like_references)
    assert one(spark, folded.replace(" [", "\n["), references.looks_like_references)


def test_rendered_length_is_that_of_json(spark):
    rows = [(k, f"Ada {k}, p. 1", text) for k, text in enumerate(['say "x"\nnew', "back\\slash\ttab", "plain ü"], 1)]
    frame = spark.createDataFrame(rows, "place int, citation string, excerpt string")
    got = [r.rendered for r in evidence.within_budget(frame).orderBy("place").collect()]
    items = [{"citation": c, "excerpt": e} for _, c, e in rows]
    assert got == [len(json.dumps(items[:k], indent=2, ensure_ascii=False)) for k in (1, 2, 3)]
    assert evidence.within_budget(frame, 10).count() == 1


def test_alert_life_cycle(spark):
    found = spark.createDataFrame([("1:v:10", "1:v:2", 0.5), ("1:v:2", "1:v:10", 0.5), ("a", "a", 0.0)], "source_chunk string, target_chunk string, distance double")
    records = links.alert_records(found)
    (r,) = records.collect()
    assert (r.chunk_a, r.chunk_b, r.status) == ("1:v:10", "1:v:2", "pending")
    assert links.new_alerts(records, records).count() == 0
    decide = lambda *d: links.decided(records, spark.createDataFrame([(r.pa_id, *x) for x in d], "pa_id string, decision string, seq int"))
    assert decide(("confirmed", 1), ("rejected", 2)).first().status == "rejected" and decide(("odd", 1)).first().status == "pending"
    wanted = records.select("pa_id")
    assert links.confirmed_links(records, wanted, wanted.limit(0)).count() == 0
    assert links.confirmed_links(decide(("confirmed", 1)), wanted, wanted.limit(0)).count() == 1


def test_unresolved_groups_equal_the_pairs(spark):
    rows = [(i, f"s{i % 3}", None, None, None, None) for i in range(9)]
    bib = spark.createDataFrame(rows, "doc_id bigint, sha string, doi string, title string, authors string, year int")
    dismissed = spark.createDataFrame([(0, 3), (0, 6), (3, 6), (1, 4)], "doc_a bigint, doc_b bigint")
    assert [tuple(r) for r in duplicates.unresolved_groups(bib, dismissed).collect()] == [("same PDF hash", 2)]
    assert duplicates.candidates(bib, dismissed).count() == 9 - 4


def test_nearest_of_all_over_blocks(spark):
    x = np.random.default_rng(1).normal(size=(90, 5))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, v array<double>")
    got = {(r.vec_id, r.rank): r.neighbour for r in vectors.nearest_of_all(frame, 3, block=20).collect()}
    order = np.argsort(((x[:, None] - x[None]) ** 2).sum(2), axis=1)[:, :3]
    assert got == {(i, k + 1): int(order[i, k]) for i in range(90) for k in range(3)}


def test_empty_inputs(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert chunking.word_chunks(docs).collect() == []
    assert reports.average_per_document(docs, docs.selectExpr("doc_id", "0 as n"), "n") is not None
    assert storage.search_metadata(spark.createDataFrame([], "doc_id bigint, title string, authors string, doi string, path string, year int"), " ").collect() == []


def test_ingest_twice_changes_nothing(spark, tmp_path):
    from lectern.streaming.ingest import ingest

    docs = spark.createDataFrame([(1, "a b c", "en", "s", 5), (2, "a b c", "en", "s", 5), (3, "other", "en", "s", 5), (4, None, "en", "s", None)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(str(tmp_path / "in"))
    for checkpoint in ("c1", "c2", "c2"):
        ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / checkpoint)).awaitTermination()
        assert sorted(r.doc_id for r in spark.read.parquet(str(tmp_path / "out/documents")).collect()) == [1, 3]
        assert spark.read.parquet(str(tmp_path / "out/chunks")).count() == 2


def test_bars(spark):
    frame = pd.DataFrame({"v": [0, 1, 5, 10]})
    got = [r[0] for r in spark.createDataFrame(frame).select(reports.bar(F.col("v"), F.lit(10), 4)).collect()]
    assert got == ["", "▍", "██", "████"]
