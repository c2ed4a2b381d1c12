import pytest
from pyspark.sql import functions as F

from lectern.operators import layout, refresh
from lectern.operators.storage import numbered
from lectern.sources import files as S


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 /Title (A \\(short\\) study) /Author (Ada Byron)")
    (tmp_path / "sub" / "B.PDF").write_bytes(b"%PDF-1.7 broken")
    (tmp_path / "sub" / "copy.pdf").write_bytes((tmp_path / "a.pdf").read_bytes())
    (tmp_path / "fake.pdf").write_bytes(b"no pdf")
    (tmp_path / "notes.txt").write_bytes(b"%PDF- in a text file")
    return tmp_path


def names(rows):
    return [r.path.rsplit("/", 1)[-1] for r in rows]


def test_kinds_and_discovery(spark, folder):
    kinds = {r.path.rsplit("/", 1)[-1]: r.k for r in S.contents(spark, str(folder)).select("path", S.is_kind(F.col("content")).alias("k")).collect()}
    assert kinds == {"a.pdf": True, "B.PDF": True, "copy.pdf": True, "fake.pdf": False, "notes.txt": True}
    assert sorted(names(S.discovered(spark, str(folder)).collect())) == ["B.PDF", "a.pdf", "copy.pdf", "fake.pdf"]
    with pytest.raises(Exception):
        S.discovered(spark, str(folder / "nowhere")).collect()


def test_targets_keep_their_first_place(spark, folder):
    rows = S.targets(spark, [str(folder / "sub" / "copy.pdf"), str(folder), str(folder / "notes.txt"), str(folder / "fake.pdf")]).orderBy("place").collect()
    assert names(rows)[0] == "copy.pdf" and sorted(names(rows)[1:-1]) == ["B.PDF", "a.pdf", "fake.pdf"] and names(rows)[-1] == "notes.txt"
    assert [r.place for r in rows] == list(range(1, 6))
    assert {n for n, r in zip(names(rows), rows) if r.error} == {"fake.pdf"}
    with pytest.raises(FileNotFoundError):
        S.targets(spark, [str(folder / "gone.pdf")])


def test_ingest_goes_on_after_a_bad_file(spark, folder):
    def parse(content):
        if b"broken" in content:
            yield {"page": 1, "x0": 0.0, "y0": 0.0, "x1": 1.0, "y1": 1.0, "text": "lost", "width": 1.0, "height": 1.0}
            raise ValueError("bad page")
        for k, word in enumerate(["one", "two"]):
            yield {"page": 1, "x0": 50.0 * k, "y0": 100.0, "x1": 50.0 * k + 40, "y1": 110.0, "text": word, "width": 500.0, "height": 700.0}

    found = S.contents(spark, str(folder)).where(F.lower("path").endswith(".pdf"))
    outcomes, words = S.ingested(found, spark.createDataFrame([], "sha string"), parse)
    got = {r.path.rsplit("/", 1)[-1]: (r.outcome, r.error) for r in outcomes.collect()}
    assert got == {"a.pdf": ("created", None), "copy.pdf": ("existing", None), "B.PDF": ("failed", "bad page"), "fake.pdf": ("failed", "not a file of this kind")}
    assert [r.text for r in layout.pages_to_lines(words).collect()] == ["one two"]
    known = outcomes.where("outcome = 'created'").select("sha")
    again, words = S.ingested(found, known, parse)
    assert {r.outcome for r in again.collect()} == {"existing", "failed"} and words.count() == 0


def test_embedded_metadata(spark, folder):
    got = {r.path.rsplit("/", 1)[-1]: (r.title, r.authors) for r in S.embedded_metadata(S.contents(spark, str(folder))).collect()}
    assert got["a.pdf"] == ("A (short) study", "Ada Byron") and got["B.PDF"] == (None, None)


def test_numbers_of_a_global_order(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") % 7 > 0, F.concat(F.lit("t"), F.col("id") % 13)).alias("title"))
    got = numbered(rows, [F.col("title"), F.col("id")], "place").collect()
    expected = sorted(((r.title is not None, r.title or ""), r.id) for r in got)
    assert [(k, i) for k, i in expected] == [((r.title is not None, r.title or ""), r.id) for r in sorted(got, key=lambda r: r.place)]
    assert sorted(r.place for r in got) == list(range(1, 5001))
    assert numbered(rows.limit(0), [F.col("id")], "place").collect() == []


def test_chunking_by_state(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c d"), (3, "e"), (4, " "), (5, "g")], "doc_id bigint, text string")
    state = spark.createDataFrame([(1, "now", "ok"), (2, "old", "ok"), (5, "old", refresh.NO_TEXT)], "doc_id bigint, print string, status string")
    chunks = spark.createDataFrame([(1, "v2", 0, "kept"), (2, "v2", 0, "stale"), (2, "v1", 0, "older"), (3, "v1", 0, "other")], "doc_id bigint, version string, chunk_index int, text string")

    def build(rows):
        return rows.where(F.trim("text") != "").select("doc_id", F.lit(0).alias("chunk_index"), F.upper("text").alias("text"))

    out, after = refresh.chunked(docs, state, chunks, "v2", F.lit("now"), build)
    assert sorted(map(tuple, out.collect())) == [(1, "v2", 0, "kept"), (2, "v2", 0, "C D"), (3, "v1", 0, "other"), (3, "v2", 0, "E")]
    assert sorted((r.doc_id, r.print, r.status) for r in after.collect() if r.doc_id in (1, 2, 3)) == [(1, "now", "ok"), (2, "now", "ok"), (3, "now", "ok")]
    assert {r.doc_id for r in after.collect() if r.status == refresh.NO_TEXT} == {4, 5}
