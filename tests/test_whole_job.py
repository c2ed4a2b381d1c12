"""Queries over small tables of their own: nothing is left out, and what is computed in another way comes out the same."""

import pytest

from lectern.plans import catalog


@pytest.fixture
def made(spark, tmp_path):
    """Writes tables into a folder and returns it."""

    def write(**tables):
        for name, frame in tables.items():
            frame.write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return write


def test_candidates_of_late_pages(spark, made):
    d = made(documents=spark.createDataFrame([(0, "\n".join(f"line {i}" for i in range(400)))], "doc_id bigint, text string"))
    found = [r["line_index"] for r in catalog.queries()["c2_candidates"](spark, d).orderBy("candidate_id").collect()]
    assert max(found) > 390 and found == sorted(found)
    assert max(r["line_index"] for r in catalog.queries()["c3_filtered_candidates"](spark, d).collect()) < 160


@pytest.mark.parametrize("kind", ["plain", "equal", "large", "odd"])
def test_nearest_rows_are_those_of_all_pairs(kind):
    import numpy as np

    from lectern.operators import vectors as V

    rng = np.random.default_rng(5)
    x, y = rng.standard_normal((300, 16)), rng.standard_normal((5000, 16))
    if kind == "equal":  # many ties at the last place, and before it
        x, y = np.round(x / 2), np.tile(np.round(y[:50] / 2), (100, 1))
    if kind == "large":
        x, y = x * 1e8, y * 1e8
    if kind == "odd":
        y[7], y[8, 0], x[3, 1] = np.nan, np.inf, np.nan
    d = ((x[:, None] - y[None]) ** 2).sum(2).round(6)
    order = np.argsort(d, axis=1, kind="stable")[:, :10]
    rows, at, distance = V._nearest_rows(x, y, 10)
    assert (rows == np.repeat(np.arange(300), 10)).all() and (at == order.ravel()).all()
    assert np.array_equal(distance, np.take_along_axis(d, order, 1).ravel(), equal_nan=True)


def test_alerts_are_searched_once(spark, made):
    """A record is read twice by its decisions; the comparison of all vectors isn't part of the plan again."""
    d = made(embeddings=spark.sql("select id as vec_id, transform(sequence(1, 4), k -> cast(sin(id * k) as float)) as embedding, 0 as label from range(60)"))
    for name in ("l3_new_alerts", "l4_status_changes", "l5_confirmed_links", "j10_links_of_alerts"):
        assert "MapInArrow" not in catalog.queries()[name](spark, d)._jdf.queryExecution().toString()


def test_built_lines_need_no_distinct_aggregates(spark):
    from lectern.operators import layout as L

    rows = [(1, 1, x, 0.0, x + 1, 10.0, t, 1.0, 1.0, b, 1, 0, s, 1, "single", None) for x, t, b, s in [(0.0, "a", 1, "raw"), (2.0, "b", 1, None), (4.0, "c", 1, "raw")]]
    rows += [(1, 2, x, 0.0, x + 1, 10.0, t, 1.0, 1.0, b, 1, 0, s, 1, "single", None) for x, t, b, s in [(2.0, "a", 1, "raw"), (0.0, "b", 1, "war")]]
    rows += [(1, 3, x, 0.0, x + 1, 10.0, t, 1.0, 1.0, b, 1, 0, s, 1, "single", None) for x, t, b, s in [(2.0, "a", 1, "raw"), (0.0, "b", None, "raw")]]
    rows += [(1, 4, 0.0, 0.0, 1.0, 10.0, "a", 1.0, 1.0, None, None, None, "", 1, "single", None)]
    built = L.built_lines(spark.createDataFrame(rows, L.WORD + ", row int, column string, gutter double"))
    assert {r.page: r.text for r in built.collect()} == {1: "raw", 2: "b a", 3: "b a", 4: "a"}
    plan = built._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "collect_set" not in plan and plan.count("HashAggregate(") <= 4


@pytest.mark.parametrize("piece", [7, 40, 1 << 20])
def test_chunks_of_a_text_in_parts(monkeypatch, piece):
    from lectern.operators import chunking as C

    monkeypatch.setattr(C, "_PIECE", piece)
    for text in ("", " \n ", "one", "x" * 300, " ".join(f"w{i * i}" for i in range(200)) + "  end \x1c ", "a " * 50 + "b" * 90 + " c"):
        words = text.split()
        lengths = [len(w) for w in words]
        want, at = [], 0
        while at < len(words):
            stop = at + 1
            while stop < len(words) and sum(lengths[at : stop + 1]) + stop - at <= 60:
                stop += 1
            want.append(" ".join(words[at:stop]))
            at = stop
        assert list(C.chunks_of_text(text, 60)) == want


def test_chunks_are_handed_on_in_small_batches(spark, monkeypatch):
    """The worker's function itself: no batch holds all chunks of its input."""
    import pyarrow as pa

    from lectern.operators import chunking as C

    class Docs:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    monkeypatch.setattr(C, "_YIELD", 5000)
    texts = [" ".join(["word"] * 2000), None, "", "short"] * 10
    batch = pa.RecordBatch.from_arrays([pa.array(range(40), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    made = list(C.word_chunks(Docs())(iter([batch])))
    assert max(sum(len(t.as_py()) for t in b["text"]) for b in made) <= 5000 + 2000
    assert sum(b.num_rows for b in made) == 10 * 6 and [r["chunk_index"] for b in made for r in b.to_pylist()][:7] == [0, 1, 2, 3, 4, 0, 0]


def _odd_pages():
    import random

    rng = random.Random(7)
    for page in range(30):
        known, wide = page % 3 == 0, page % 4 != 0
        for i in range(rng.choice([8, 29, 30, 90, 170])):
            column, row = rng.choice([0, 1]), rng.randrange(20)
            x0 = (40 + column * 280 if wide else 40 + column * 120) + rng.randrange(4) * 60 + rng.choice([0, 0, 0.5, 90])
            y0 = 40 + row * 14 + rng.choice([0, 0, 1.5, 4])
            yield (1, page, float(x0), float(y0), float(x0 + rng.choice([30, 50, 130])), float(y0 + rng.choice([10, 12])), rng.choice(["a", "b c", "Ü", None, " "]), 600.0, 360.0,
                row // 5 if known else rng.choice([None, 1]), row if known else None, i if known else None, rng.choice([None, "", "raw"]) if page % 5 else "raw")


def test_packed_pages_give_the_lines_of_the_single_steps(spark):
    from lectern.operators import layout as L

    words = spark.createDataFrame(list(_odd_pages()), L.WORD)
    names = ["page", "column", "x0", "y0", "x1", "y1", "gutter", "height", "text"]
    want = L.built_lines(L.split_rows(L.with_gutters(L.rowed(words)))).select(*names)
    got = L.lines_of(L.packed(words)).select(*names)
    assert sorted(map(repr, want.collect())) == sorted(map(repr, got.collect()))
    assert want.where("gutter is not null").count() and want.where("gutter is null").count()


def test_words_of_documents_are_not_shuffled(spark, made):
    d = made(documents=spark.createDataFrame([(0, "en", "word " * 400)], "doc_id bigint, lang string, text string"))
    plan = catalog.queries()["g12_page_lines"](spark, d)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.split("\n") if "Exchange hash" in line]  # of lines: by document, and by what stands in the margins
    assert len(exchanges) == 2 and "Join" not in plan


def test_kinds_read_the_first_bytes_only(spark, tmp_path):
    """A file that no row could hold: three gigabytes, nearly all of them a hole."""
    from lectern.sources import files as S

    for name, start, size in (("a b.pdf", b"%PDF-1", 3 << 30), ("c%20d.parquet", b"PAR1", 10), ("e", b"P", 1)):
        with open(tmp_path / name, "wb") as f:
            f.write(start)
            f.truncate(size)
    rows = S.kinds(S.contents(spark, str(tmp_path)).drop("content"), is_pdf=S.PDF, is_parquet=b"PAR1").collect()
    assert {r.path.rsplit("/", 1)[1]: (r.is_pdf, r.is_parquet) for r in rows} == {"a b.pdf": (True, False), "c%20d.parquet": (False, True), "e": (False, False)}


def test_candidates_are_limited_in_shares_first(spark, sf):
    plan = catalog.queries()["r11_relevance_gate"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit [way" in plan and ", share" in plan


def test_fuzzy_spans_need_few_ratios(monkeypatch):
    """The same as all windows one after the other, with a ratio only where it can be the best."""
    import random
    from difflib import SequenceMatcher

    from lectern.operators import matching as M

    asked = []

    class Counted(SequenceMatcher):
        def ratio(self):
            asked.append(1)
            return super().ratio()

    monkeypatch.setattr(M, "SequenceMatcher", Counted)
    rng = random.Random(3)
    for words, least in ((3, 0.72), (40, 0.72), (5, 0.3), (40, 0.0)):
        for _ in range(20):
            page = [f"w{rng.randrange(words)}" for _ in range(rng.randrange(12, 25))]
            excerpt = page[3:6] + ["zzz"] + page[7:11] + ["yyy"]
            best = (0, 0, -1.0)
            for size in range(int(len(excerpt) * 0.75), min(len(page), int(len(excerpt) * 1.35) + 2) + 1):
                for start in range(len(page) - size + 1):
                    score = SequenceMatcher(a=excerpt, b=page[start : start + size], autojunk=False).ratio()
                    best = (start, start + size, score) if score > best[2] else best
            assert M.best_span(page, excerpt, least) == ((*best, "fuzzy-token") if best[2] >= least else None)
    assert len(asked) < 80 * 20


def test_likeness_is_the_cosine_of_vectors(spark):
    from pyspark.sql import functions as F

    from lectern.operators import matching as M
    from lectern.operators.vectors import cosine

    texts = spark.createDataFrame([(i, None if i == 3 else "" if i == 4 else f"the license of file {i % 7} " * (i % 5)) for i in range(60)], "id int, w string")
    asked = M.hashed_words(["license file of the software"])[0].tolist()
    rows = texts.select(M.likeness(F.col("w"), asked).alias("a"), F.round(cosine(M.encoded(F.col("w")), F.array(*[F.lit(x) for x in asked])), 6).alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows] and rows[3].a is None and rows[4].a == 0 and max(r.a or 0 for r in rows) > 0.5


def test_names_are_spread_and_counted_first(spark):
    from lectern.operators import prompts as P

    bib = spark.createDataFrame([("Ada Byron and Bo Li",), ("Ada Byron, Cy Do",), ("A. Byron",), (None,), ("X",)], "authors string")
    top = P.top_authors(bib, 2)
    assert [tuple(r) for r in top.collect()] == [("byron", 3), ("do", 1)]
    plan = top._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" in plan and plan.count("Aggregate") == 2


def test_excerpts_are_cut_once(spark):
    """The patterns of a fold's step, without what is repeated for each reference to them."""
    from lectern.operators import sections as S

    frame = spark.createDataFrame([(1, 0, "T", "1", "some text " * 900), (1, 1, "U", "2", "more text " * 900)], "doc_id bigint, section_index int, title string, number string, text string")
    made = S.screening_excerpts(frame, context=2500)
    assert made._jdf.queryExecution().analyzed().toString().count("regexp_replace") < 30  # 64 before
    assert [(r.section_index, r.was_cut) for r in made.orderBy("section_index").collect()] == [(0, True)]
