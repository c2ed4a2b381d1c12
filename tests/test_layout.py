import pytest

from lectern.operators import layout as L


def words(rows, doc=1, page=1, width=560.0, height=760.0, step=6, gap=5):
    """Word boxes of (x, y, text) lines; ten points high."""
    out = []
    for x, y, text in rows:
        for w in text.split():
            out.append((doc, page, float(x), float(y), float(x + len(w) * step), float(y + 10), w, width, height, None, None, None, None))
            x += len(w) * step + gap
    return out


def body(first, n, left="L", right="R"):
    return [(x, first + 14 * k, f"{side}{k}a {side}{k}b") for k in range(n) for x, side in ((60, left), (330, right))]


def texts(spark, rows):
    got = L.pages_to_lines(spark.createDataFrame(rows, L.WORD)).orderBy("doc_id", "page", "place").collect()
    return [r.text for r in got]


def test_two_columns_are_read_one_after_the_other(spark):
    got = texts(spark, words(body(100, 20), width=500.0, height=700.0))
    assert got == [f"L{k}a L{k}b" for k in range(20)] + [f"R{k}a R{k}b" for k in range(20)]


def test_a_full_width_title_stays_one_line(spark):
    title = [(60, 80, "A full width title of the whole paper which goes on across both of the columns here")]
    got = texts(spark, words(title + body(120, 20), width=560.0, height=760.0))
    assert got[0] == title[0][2] and got[1] == "L0a L0b" and got[21] == "R0a R0b"


def test_author_blocks_stay_above_the_abstract(spark):
    rows = [(60, 80, "Games on Graphs"), (90, 115, "Left Author"), (330, 115, "Right Author")]
    rows += [(60, 200, "ABSTRACT"), (60, 214, "abstract left body line"), (60, 228, "1 INTRODUCTION"), (60, 242, "Iterated games and")]
    rows += [(330, 210, "games on graphs continue"), (330, 224, "right column body line")]
    got = texts(spark, words(rows + body(330, 12)))
    assert got.index("Left Author") < got.index("ABSTRACT") and got.index("Right Author") < got.index("ABSTRACT")
    assert got.index("Iterated games and") < got.index("games on graphs continue")


def test_pages_of_documents_are_apart(spark):
    """The same page number in two documents, large ids, one page in one column."""
    rows = words(body(100, 20), doc=3_000_000_000) + words([(60, 100, "one column")], doc=7) + words([(60, 120, "page two")], doc=7, page=2)
    got = L.pages_to_lines(spark.createDataFrame(rows, L.WORD)).collect()
    assert len(got) == 42 and {(r.doc_id, r.page) for r in got} == {(3_000_000_000, 1), (7, 1), (7, 2)}


def test_source_lines_win_over_height(spark):
    """Two source lines at one height stay two rows; their raw text is taken and cleaned."""
    rows = [(1, 1, x, 100.0, x + 40, 110.0, w, 560.0, 760.0, b, 0, k, raw) for x, w, b, k, raw in [(60.0, "a", 0, 0, "a ( b ) ,"), (110.0, "b", 0, 1, "a ( b ) ,"), (300.0, "c", 1, 0, None)]]
    assert texts(spark, rows) == ["a (b),", "c"]


def test_margins_boilerplate_and_repeated_lines(spark):
    rows = [(1, 1, 5.0, 200.0, 14.0, 280.0, "NIH-PA", 560.0, 760.0, None, None, None, None)]
    for page in (1, 2):
        rows += words([(60, 20, "Smith and Doe"), (60, 300, f"Body of page {page}"), (60, 320, "© 2010 A Society"), (60, 740, f"Page {page}")], page=page)
    rows += words([(60, 20, "Only here")], page=3)
    assert texts(spark, rows) == ["Body of page 1", "Body of page 2", "Only here"]


def test_words_across_line_ends(spark):
    rows = words([(60, 100, "the artifi-"), (60, 114, "cial self-"), (60, 128, "made thing of Anglo-"), (60, 142, "Saxon times ex-"), (60, 156, "tra")])
    assert texts(spark, rows) == ["the artificial", "self-made", "thing of Anglo-", "Saxon times extra"]


def test_joins_only_within_a_column(spark):
    rows = words(body(100, 19) + [(60, 400, "ends in hetero-"), (330, 400, "geneous right")])
    got = texts(spark, rows)
    assert "ends in hetero-" in got and "geneous right" in got


def test_fragments_of_a_heading_are_one_line(spark):
    rows = [(1, 1, 60.0, 100.0, 66.0, 110.0, "1", 560.0, 760.0, 0, 0, 0, "1"), (1, 1, 90.0, 100.0, 160.0, 110.0, "Introduction", 560.0, 760.0, 0, 1, 0, "Introduction")]
    assert texts(spark, rows) == ["1 Introduction"]


@pytest.mark.parametrize("rows", [[], [(None,) * 13], [(1, 1, 0.0, 0.0, 1.0, 1.0, None, 10.0, 10.0, None, None, None, None)]])
def test_odd_pages(spark, rows):
    assert texts(spark, rows) == []
