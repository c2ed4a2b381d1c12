"""Page geometry: word boxes to lines in reading order.

Input is one row a word: doc_id, page, x0, y0, x1, y1, text, width, height (of the page) and, where
the extractor knows them, block, line, word and source_text (the raw text of the line it is from).
A page is (doc_id, page); every step is partitioned by it. The steps on words are there as DataFrame
code, each by itself, and together for packed pages (``lines_of``), which gives the same lines.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from statistics import median

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import normal_text, repetition_key
from lectern.shared import tidied

KEY = ("doc_id", "page")
WORD = "doc_id bigint, page int, x0 double, y0 double, x1 double, y1 double, text string, width double, height double, block int, line int, word int, source_text string"

#: Lines that are boilerplate wherever they stand: manuscript labels, identifiers, notices of rights.
BOILERPLATE = "(?i)^(?:" + "|".join((
    "(?:nih public access|(?:nih-pa )?author manuscript|nih-pa|published in final edited form as:)$",
    r"doi\s*:|\d{4}-\d{4}/\d{4}/|pacs\s+number\s*s?\s*:|pacs\s+(?:numbers?|nos?\.?)\b|acm\s+\d+(?:-\d+)+/\d+/\d+\.$",
    r"phys rev e stat nonlin soft matter phys\. (?:author manuscript; available in pmc|\d{4})\b|fu et al\. page \d+$|gecco[’']\d{2},\s+|[*†‡].*@",
    r"copyright is held by the author/owner\(s\)\.$|copyright © \d{4}, association for the advancement of artificial$|intelligence \(www\.aaai\.org\)\. all rights reserved\.$",
    r"(?:©|copyright)\s*\d{4}\b|copyright\s*©\s*\d{4}\b|\(c\)\s*\d{4}\b",
)) + ")"


def _page() -> Window:
    return Window.partitionBy(*KEY)


def _middle(a: str, b: str) -> Column:
    return (F.col(a) + F.col(b)) / 2


# ---- words ---------------------------------------------------------------------------------


def is_margin_artifact(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """Narrow, tall boxes whose centre lies in the outer 12 % of the page's width: rotated labels."""
    tall = (y1 - y0 >= F.greatest(F.lit(16.0), (x1 - x0) * 1.8)) | (y1 - y0 >= height * 0.04)
    centre = (x0 + x1) / 2
    return ~((centre > width * 0.12) & (centre < width * 0.88)) & (x1 - x0 <= width * 0.035) & tall


def _rows_of(tops: pd.Series, bottoms: pd.Series) -> pd.Series:
    out = []
    for y0, y1 in zip(tops, bottoms):
        tolerance = max(2.0, 0.45 * median([max(1.0, b - a) for a, b in zip(y0, y1)]))
        rows: list[list[float]] = []
        medians: list[float] = []
        numbers = []
        for y in ((y0 + y1) / 2).tolist():
            at = next((k for k, m in enumerate(medians) if abs(m - y) <= tolerance), None)
            if at is None:
                at = len(rows)
                rows.append([])
                medians.append(y)
            rows[at].append(y)
            medians[at] = median(rows[at])
            numbers.append(at)
        out.append(numbers)
    return pd.Series(out)


def rows_by_height(words: DataFrame, name: str = "row") -> DataFrame:
    """Words with a row number: a word, from the top, joins the first row whose median height is near its own, else it opens one.

    The rows depend on the order of the words, so a page is one row of arrays, and many pages a batch.
    """
    rest = [c for c in words.columns if c not in (*KEY, "x0")]
    centre = ((F.col("y0") + F.col("y1")) / 2).alias("__centre")
    pages = words.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct(centre, "x0", *rest))).alias("w"))
    numbered = pages.withColumn("r", F.pandas_udf(_rows_of, "array<int>")(F.col("w.y0"), F.col("w.y1")))
    flat = numbered.select(*KEY, F.explode(F.arrays_zip("w", "r")).alias("z"))
    return flat.select(*KEY, *[F.col(f"z.w.{c}").alias(c) for c in words.columns if c not in KEY], F.col("z.r").alias(name))


def rowed(words: DataFrame) -> DataFrame:
    """Words with ``y_row``, the row by height, and ``row``: the extractor's own line where all words of the page have one."""
    known = F.min(F.col("block").isNotNull() & F.col("line").isNotNull()).over(_page())
    own = F.dense_rank().over(_page().orderBy("block", "line"))
    return rows_by_height(words, "y_row").withColumn("row", F.when(known, own).otherwise(F.col("y_row")))


# ---- gutters -------------------------------------------------------------------------------


def line_gutters(lines: DataFrame) -> DataFrame:
    """(doc_id, page, gutter) of pages in two columns, from line boxes (doc_id, page, x0, y0, x1, y1, width, height).

    Lines at the very top and bottom and those wider than 62 % don't count. At least twelve
    others, four of which begin in the left 32 % and four beyond 45 %; the gap between the third
    quartile of the left ones' ends (of the long ones, if there are three) and the first of the
    right ones' starts is 1.5 % of the width and more, its middle within 35 % to 65 %.
    """
    wide = F.col("x1") - F.col("x0")
    body = lines.where((F.col("y1") >= 0.08 * F.col("height")) & (F.col("y0") <= 0.94 * F.col("height")) & (wide <= 0.62 * F.col("width")))
    left, right = F.col("x0") < 0.32 * F.col("width"), F.col("x0") > 0.45 * F.col("width")
    long = left & (wide >= 0.25 * F.col("width"))
    g = body.groupBy(*KEY).agg(
        F.count("*").alias("n"), F.count_if(left).alias("nl"), F.count_if(right).alias("nr"), F.count_if(long).alias("n_long"), F.max("width").alias("width"),
        F.percentile(F.when(left, F.col("x1")), F.lit(0.75)).alias("any_edge"), F.percentile(F.when(long, F.col("x1")), F.lit(0.75)).alias("long_edge"), F.percentile(F.when(right, F.col("x0")), F.lit(0.25)).alias("b"),
    ).withColumn("a", F.when(F.col("n_long") >= 3, F.col("long_edge")).otherwise(F.col("any_edge")))
    middle = (F.col("a") + F.col("b")) / 2
    return g.where((F.col("n") >= 12) & (F.col("nl") >= 4) & (F.col("nr") >= 4) & (F.col("b") - F.col("a") >= 0.015 * F.col("width")) & (middle >= 0.35 * F.col("width")) & (middle <= 0.65 * F.col("width"))).select(*KEY, middle.alias("gutter"))


def gap_gutters(words: DataFrame, rows: str = "y_row") -> DataFrame:
    """(doc_id, page, gutter) from the gaps between neighbouring words of a row: of each row the widest central gap, at
    least 4 % of the width, in enough rows; their median. Words near the page's ends count only if there are few others."""
    centre = _middle("y0", "y1")
    inside = centre.between(0.12 * F.col("height"), 0.92 * F.col("height"))
    body = words.withColumn("inside", inside).withColumn("many", F.count_if("inside").over(_page()) >= 24).where("inside or not many")
    w = Window.partitionBy(*KEY, rows).orderBy("x0", "x1")
    gap = F.lead("x0").over(w) - F.col("x1")
    middle = (F.col("x1") + F.lead("x0").over(w)) / 2
    central = body.withColumns({"gap": gap, "middle": middle}).where((F.col("gap") >= 0.04 * F.col("width")) & (F.col("middle") >= 0.34 * F.col("width")) & (F.col("middle") <= 0.66 * F.col("width")))
    best = central.groupBy(*KEY, rows).agg(F.min_by("middle", F.struct(-F.col("gap"), "x0")).alias("middle"))
    totals = body.groupBy(*KEY).agg(F.countDistinct(rows).alias("n_rows"))
    return best.groupBy(*KEY).agg(F.count("*").alias("support"), F.median("middle").alias("gutter")).join(totals, list(KEY)).where("support >= greatest(4, floor(0.1 * n_rows))").select(*KEY, "gutter")


def with_gutters(words: DataFrame) -> DataFrame:
    """Words with rows and ``gutter``, null on pages in one column. Pages of fewer than thirty words have one."""
    many = words.withColumn("__n", F.count("*").over(_page())).where("__n >= 30")
    boxes = many.groupBy(*KEY, "row").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.max("width").alias("width"), F.max("height").alias("height"), F.max(F.trim("text")).alias("any_text"))
    lines = line_gutters(boxes.where("any_text <> ''")).withColumnRenamed("gutter", "__by_line")
    gaps = gap_gutters(many).withColumnRenamed("gutter", "__by_gap")
    return words.join(lines, list(KEY), "left").join(gaps, list(KEY), "left").withColumn("gutter", F.coalesce("__by_line", "__by_gap")).drop("__by_line", "__by_gap")


# ---- lines ---------------------------------------------------------------------------------


def split_rows(words: DataFrame) -> DataFrame:
    """Words (with row and gutter) with ``column``: left, right, full or single.

    A row with words on both sides of the gutter is two lines if there is a gap of more than 8
    around it; three words or more against two or fewer make it a line of their side; else it is
    a full line. A row on one side is right if it begins right of the gutter, or at most 45 short of it.
    """
    w = Window.partitionBy(*KEY, "row")
    is_left = _middle("x0", "x1") < F.col("gutter")
    nl, nr = F.count_if(is_left).over(w), F.count_if(~is_left).over(w)
    gap = F.min(F.when(~is_left, F.col("x0"))).over(w) - F.max(F.when(is_left, F.col("x1"))).over(w)
    out = words.withColumns({"__nl": nl, "__nr": nr, "__gap": gap, "__start": F.min("x0").over(w)})
    side = F.when(is_left, "left").otherwise("right")
    alone = F.when((F.col("__nr") > 0) | (F.col("__start") >= F.col("gutter") - 45), "right").otherwise("left")
    both = F.when(F.col("__gap") > 8, side).when((F.col("__nl") >= 3) & (F.col("__nr") <= 2), "left").when((F.col("__nr") >= 3) & (F.col("__nl") <= 2), "right").otherwise("full")
    column = F.when(F.col("gutter").isNull(), "single").when((F.col("__nl") == 0) | (F.col("__nr") == 0), alone).otherwise(both)
    return out.withColumn("column", column).drop("__nl", "__nr", "__gap", "__start")


def built_lines(words: DataFrame) -> DataFrame:
    """A line for each row and column: box and text. The raw text of the source line is taken where all its words are from one."""
    item = F.struct("x0", "y0", F.coalesce("word", F.lit(0)).alias("word"), "text")
    # least and greatest instead of sets: one pass without distinct aggregates
    source, raw = F.struct(F.coalesce("block", F.lit(-1)), F.coalesce("line", F.lit(-1))), F.nullif(F.col("source_text"), F.lit(""))
    g = words.groupBy(*KEY, "row", "column").agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.max("gutter").alias("gutter"), F.max("height").alias("height"),
        F.array_join(F.array_sort(F.collect_list(item))["text"], " ").alias("joined"), (F.min(source) == F.max(source)).alias("one"), F.min(raw).alias("raw"), F.max(raw).alias("last"),
    )
    text = normal_text(F.when(F.col("one") & (F.col("raw") == F.col("last")), F.col("raw")).otherwise(F.col("joined")))
    return g.withColumn("text", text).where("text <> ''").drop("joined", "one", "raw", "last")


def merged_fragments(lines: DataFrame) -> DataFrame:
    """Neighbours in the order of height and x become one line: same column, centres within 55 % of the former's height
    (2 points at least), a gap of 0 to 80 points. A running sum over the breaks numbers the groups."""
    w = _page().orderBy(_middle("y0", "y1"), "x0", "x1", "text")
    before = {c: F.lag(c).over(w) for c in ("x1", "y0", "y1", "column")}
    near = (F.col("column") == before["column"]) & (F.col("x0") - before["x1"]).between(0, 80)
    near = near & (F.abs(_middle("y0", "y1") - (before["y0"] + before["y1"]) / 2) <= F.greatest(F.lit(2.0), 0.55 * (before["y1"] - before["y0"])))
    grouped = lines.withColumns({"__fresh": F.when(F.coalesce(near, F.lit(False)), 0).otherwise(1), "__at": F.row_number().over(w)})
    grouped = grouped.withColumn("__g", F.sum("__fresh").over(_page().orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)))
    kept = [F.max(c).alias(c) for c in lines.columns if c in ("gutter", "height", "width")]
    text = normal_text(F.array_join(F.array_sort(F.collect_list(F.struct("__at", "text")))["text"], " "))
    return grouped.groupBy(*KEY, "__g").agg(F.max("column").alias("column"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), text.alias("text"), *kept).withColumnRenamed("__g", "merged")


def reading_order(lines: DataFrame, tie: str = "merged") -> DataFrame:
    """Lines with ``place``. Pages in one column go from top to bottom.

    In two columns, full-width lines above the columns come first. If the page has an abstract or
    an introduction, what stands above it in the columns follows row by row (front matter), then
    the left column, the right one, other full-width lines, the rest.
    """
    centre = _middle("y0", "y1")
    sided = F.col("column").isin("left", "right")
    low = F.trim(F.lower(normal_text(F.col("text"))), F.lit(" .:"))
    opens = (low == "abstract") | low.startswith("abstract ") | low.rlike(r"^(?:\d+(?:\.\d+)*|[ivxlcdm]+)\.?\s+introduction\b")
    marked = lines.withColumns({
        "__c": centre, "__top": F.coalesce(F.min(F.when(sided, centre)).over(_page()), F.lit(float("inf"))), "__anchor": F.min(F.when(opens, centre)).over(_page()),
        "__any": F.max(F.col("column").isin("left", "right", "full")).over(_page()),
    })
    front = F.coalesce(F.col("__c") < F.col("__anchor"), F.lit(False))
    zone = (
        F.when(F.col("gutter").isNull() | ~F.col("__any"), 5).when((F.col("column") == "full") & (F.col("__c") < F.col("__top")), 0).when(F.col("column") == "full", 4)
        .when(front, 1).when(F.col("column") == "left", 2).when(F.col("column") == "right", 3).otherwise(5)
    )
    height = F.when(F.col("__zone") == 1, F.bround(F.col("y0") / 2) * 2).otherwise(F.col("y0"))
    placed = marked.withColumn("__zone", zone).withColumn("place", F.row_number().over(_page().orderBy("__zone", height, "x0", "y0", tie)))
    return placed.drop("__c", "__top", "__anchor", "__any", "__zone")


def is_boilerplate(text: Column) -> Column:
    low = normal_text(text)
    return (low == "") | low.rlike(BOILERPLATE)


KEPT_HYPHENS = ("cross", "half", "high", "long", "low", "multi", "quasi", "self", "short", "well")


def joined_pair(a: Column, b: Column) -> Column:
    """Two lines of which the first ends in a hyphened fragment as one: the hyphen goes unless its prefix keeps it; null
    where they don't belong together (two letters at least before the hyphen, a word in lower case after it)."""
    prefix = F.lower(F.regexp_extract(a, "([A-Za-z]{2,})-$", 1))
    fits = a.rlike("[A-Za-z]{2}-$") & b.rlike("^[a-z]")
    return F.when(fits, F.concat(F.when(prefix.isin(*KEPT_HYPHENS), a).otherwise(F.regexp_replace(a, "-$", "")), b))


_FRAGMENT, _FIRST = re.compile("([A-Za-z]{2,})-$"), re.compile("([A-Za-z][A-Za-z'’]*)(?=\\W|$)")


def _join(a: str, b: str) -> tuple[str, str] | None:
    fragment, first = _FRAGMENT.search(a), _FIRST.match(b)
    if fragment is None or first is None or not first[1][0].islower():
        return None
    hyphen = "-" if fragment[1].lower() in KEPT_HYPHENS else ""
    return a[:-1] + hyphen + first[1], b[first.end() :].strip()


def _put_together(pages: pd.Series) -> pd.Series:
    done = []
    for lines in pages:
        out: list[dict] = []
        for line in lines:
            text = line["text"]
            made = _join(out[-1]["text"], text) if out and out[-1]["column"] == line["column"] else None
            if made is not None:
                out[-1]["text"], text = made
            if text:
                out.append(dict(line, text=text))
        done.append(out)
    return pd.Series(done)


def dehyphenated(lines: DataFrame) -> DataFrame:
    """Lines (doc_id, page, place, column, text, y0, y1, height) with words put together across line ends.

    Only lines that follow each other in one column are joined. A joined line may end in a hyphen
    again, so this is a fold; what follows the joined word stays a line of its own.
    """
    item = "struct<place:int,column:string,text:string,y0:double,y1:double,height:double>"
    folded = lines.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct(F.col("place").cast("int").alias("place"), "column", "text", "y0", "y1", "height"))).alias("l"))
    return folded.select(*KEY, F.inline(F.pandas_udf(_put_together, f"array<{item}>")("l")))


# ---- whole pages -----------------------------------------------------------------------------

_ON_WORD = [c.split()[0] for c in WORD.split(", ")][2:]
_LINE = "doc_id bigint, page int, column string, x0 double, y0 double, x1 double, y1 double, gutter double, height double, text string"
#: Words whose lines are made together.
_SLICE = 1 << 15


def packed(words: DataFrame) -> DataFrame:
    """A row a page: its words as ``w``, an array of structs, in any order."""
    return words.groupBy(*KEY).agg(F.collect_list(F.struct(*_ON_WORD)).alias("w"))


def _percentile(values: list[float], share: float) -> float:
    values = sorted(values)
    at = (len(values) - 1) * share
    low, high = math.floor(at), math.ceil(at)
    return values[low] if low == high or values[low] == values[high] else (high - at) * values[low] + (at - low) * values[high]


def _y_rows(centres: list[float], heights: list[float]) -> list[int]:
    """Row numbers as ``rows_by_height`` gives them, for words from the top: only the last row can still be near enough."""
    tolerance = max(2.0, 0.45 * median([max(1.0, h) for h in heights]))
    out, row, at = [], [], -1
    middle = 0.0
    for y in centres:
        if at >= 0 and abs(middle - y) <= tolerance:
            row.append(y)
        else:
            row, at = [y], at + 1
        half = len(row) // 2
        middle = row[half] if len(row) % 2 else (row[half - 1] + row[half]) / 2
        out.append(at)
    return out


def _most(values: list, at: list[int]) -> float | None:
    """The largest of some values, nulls left out; as a rule all are the same."""
    kinds = {values[i] for i in at}
    return kinds.pop() if len(kinds) == 1 else max((v for v in kinds if v is not None and v == v), default=None)


def _line_gutter(rows: dict, x0, y0, x1, y1, text, width, height) -> float | None:
    """``line_gutters`` of a page."""
    n, lefts, longs, rights, widest = 0, [], [], [], []
    for at in rows.values():
        w, h = _most(width, at), _most(height, at)
        if w is None or h is None or not any(text[i] is not None and text[i].strip(" ") for i in at):
            continue
        start, end = min(x0[i] for i in at), max(x1[i] for i in at)
        if not (max(y1[i] for i in at) >= 0.08 * h and min(y0[i] for i in at) <= 0.94 * h and end - start <= 0.62 * w):
            continue
        n += 1
        widest.append(w)
        if start < 0.32 * w:
            lefts.append(end)
            if end - start >= 0.25 * w:
                longs.append(end)
        if start > 0.45 * w:
            rights.append(start)
    if n < 12 or len(lefts) < 4 or len(rights) < 4:
        return None
    a, b, w = _percentile(longs if len(longs) >= 3 else lefts, 0.75), _percentile(rights, 0.25), max(widest)
    return (a + b) / 2 if b - a >= 0.015 * w and 0.35 * w <= (a + b) / 2 <= 0.65 * w else None


def _gap_gutter(y_row, centre, x0, x1, width, height) -> float | None:
    """``gap_gutters`` of a page."""
    inside = [h is not None and 0.12 * h <= c <= 0.92 * h for c, h in zip(centre, height)]
    many = sum(inside) >= 24
    body: dict[int, list] = {}
    for i, row in enumerate(y_row):
        if inside[i] or not many:
            body.setdefault(row, []).append((x0[i], x1[i], width[i]))
    found = []
    for row in body.values():
        row.sort(key=lambda b: b[:2])
        gaps = []
        for (start, end, w), (following, _, _) in zip(row, row[1:]):
            middle = (end + following) / 2
            if w is not None and following - end >= 0.04 * w and 0.34 * w <= middle <= 0.66 * w:
                gaps.append((end - following, start, middle))
        if gaps:
            found.append(min(gaps)[2])
    return _percentile(found, 0.5) if found and len(found) >= max(4, len(body) // 10) else None


def _columns(at: list[int], x0, x1, gutter: float | None) -> dict[str, list[int]]:
    """``split_rows`` of a row."""
    if gutter is None:
        return {"single": at}
    sides: dict[str, list[int]] = {"left": [], "right": []}
    for i in at:
        sides["left" if (x0[i] + x1[i]) / 2 < gutter else "right"].append(i)
    left, right = sides.values()
    if not left or not right:
        return {"right" if right or min(x0[i] for i in at) >= gutter - 45 else "left": at}
    if min(x0[i] for i in right) - max(x1[i] for i in left) > 8:
        return sides
    return {"left" if len(left) >= 3 and len(right) <= 2 else "right" if len(right) >= 3 and len(left) <= 2 else "full": at}


def _lines_of_page(x0, y0, x1, y1, text, width, height, block, line, word, source) -> Iterator[tuple]:
    """(column, x0, y0, x1, y1, gutter, height, text) of the lines of a page, from the lists of its words."""
    centre = [(a + b) / 2 for a, b in zip(y0, y1)]
    order = np.argsort(centre, kind="stable").tolist()
    x0, y0, x1, y1, text, width, height, block, line, word, source, centre = ([c[i] for i in order] for c in (x0, y0, x1, y1, text, width, height, block, line, word, source, centre))
    y_row = _y_rows(centre, [b - a for a, b in zip(y0, y1)])
    known = None not in block and None not in line
    rows: dict = {}
    for i, row in enumerate(zip(block, line) if known else y_row):
        rows.setdefault(row, []).append(i)
    gutter = None
    if len(x0) >= 30:
        gutter = _line_gutter(rows, x0, y0, x1, y1, text, width, height)
        gutter = _gap_gutter(y_row, centre, x0, x1, width, height) if gutter is None else gutter
    for whole in rows.values():
        for column, at in _columns(whole, x0, x1, gutter).items():
            at = sorted(at, key=lambda i: (x0[i], y0[i], word[i] or 0, text[i] or ""))
            raw = {source[i] for i in at} - {None, ""}
            made = raw.pop() if len(raw) == 1 and len({(block[i], line[i]) for i in at}) == 1 else " ".join(text[i] for i in at if text[i] is not None)
            yield column, x0[at[0]], min(y0[i] for i in at), max(x1[i] for i in at), max(y1[i] for i in at), gutter, _most(height, at), made


def _lines_of_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int32(), pa.string(), *[pa.float64()] * 6, pa.string()]
    names = [c.split()[0] for c in _LINE.split(", ")]
    for batch in batches:
        ends = np.cumsum(pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False))
        start = 0
        while start < len(batch):  # some pages at a time: Python's objects take many times the batch
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + _SLICE, "right")))
            part = batch.slice(start, stop - start)
            words = [c.flatten().to_pylist() if k > 3 else c.flatten().to_numpy(zero_copy_only=False).tolist() for k, c in enumerate(part.columns[2:])]
            found, at = [], 0
            for doc, page, n in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), pc.list_value_length(part.column(2)).to_pylist()):
                found += [(doc, page, *made) for made in _lines_of_page(*(c[at : at + n] for c in words))]
                at += n
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*found), kinds)], names)
            start = stop


def lines_of(pages: DataFrame) -> DataFrame:
    """The lines of packed pages by ``rowed``, ``with_gutters``, ``split_rows`` and ``built_lines``, a page at a time.

    Words never leave their page, so none of them is shuffled or sorted by Spark.
    """
    corners = ("x0", "y0", "x1", "y1", "width", "height")
    kept = pages.select(*KEY, F.filter("w", lambda x: ~is_margin_artifact(*[x[c] for c in corners])).alias("w")).where(F.size("w") > 0)
    made = kept.select(*KEY, *[F.col(f"w.{c}").alias(c) for c in _ON_WORD]).mapInArrow(lambda batches: tidied(_lines_of_pages(batches)), _LINE)
    return made.withColumn("text", normal_text(F.col("text"))).where("text <> ''")


def page_lines(pages: DataFrame) -> DataFrame:
    """Lines of each page by itself, in reading order, without boilerplate; all steps in their order.

    Lines are shuffled by document, which serves all that is done by page.
    """
    ordered = reading_order(merged_fragments(lines_of(pages).repartition("doc_id"))).where(~is_boilerplate(F.col("text")))
    return dehyphenated(ordered)


def in_margin(centre: Column, height: Column) -> Column:
    return (centre <= height * 0.1) | (centre >= height * 0.9)


def without_margin_lines(lines: DataFrame, repetitions: int = 2) -> DataFrame:
    """Lines without those in the top and bottom tenth of their page that repeat there on as many pages of the document, or are page numbers."""
    key = repetition_key(normal_text(F.col("text")))
    marked = lines.withColumn("__margin", in_margin(_middle("y0", "y1"), F.col("height"))).withColumn("__key", F.when(F.col("__margin"), key))
    # the number of pages by two windows of one order, so lines are neither read nor shuffled twice
    same = Window.partitionBy("doc_id", "__key")
    ranked = marked.withColumn("__rank", F.dense_rank().over(same.orderBy("page"))).withColumn("__pages", F.max("__rank").over(same))
    repeated = (F.length("__key") >= 3) & (F.col("__pages") >= repetitions)
    number = normal_text(F.col("text")).rlike(r"(?i)^(?:page\s+)?\d+$")
    return ranked.where(~(F.col("__margin") & (repeated | number))).select(*lines.columns)


def pages_to_lines(words: DataFrame) -> DataFrame:
    """(doc_id, page, place, column, text) of word boxes, or of packed pages; running heads and page numbers left out."""
    return without_margin_lines(page_lines(words if "w" in words.columns else packed(words))).select(*KEY, "place", "column", "text")
