"""Corpus statistics: counts, averages, histograms, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import author_names, missing, surname


def average_per_document(documents: DataFrame, values: DataFrame, column: str) -> Column:
    """Average over all documents; those without a value count as 0, no documents give 0."""
    joined = documents.select("doc_id").join(values.select("doc_id", column), "doc_id", "left")
    return joined.agg(F.round(F.coalesce(F.sum(column) / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)), 4).alias(column))


def surname_counts(bib: DataFrame) -> DataFrame:
    """(surname, n) over all author positions; the first spelling seen is shown."""
    names = bib.select("doc_id", F.posexplode(author_names(F.col("authors"))).alias("place", "name")).withColumn("shown", surname(F.col("name"))).where("shown is not null")
    key = F.replace(F.lower("shown"), F.lit("ß"), F.lit("ss"))
    return names.groupBy(key.alias("key")).agg(F.min_by("shown", F.struct("doc_id", "place")).alias("surname"), F.count("*").alias("n")).select("surname", "n")


def year_histogram(bib: DataFrame, top_year: int, width: int = 40) -> DataFrame:
    """(place, year, n, line): every year from the last to the first, empty ones too; later than ``top_year`` is left out. Counts are right-aligned.

    The years of a corpus are few, so the gap filling runs over the counts, not the documents.
    """
    counts = bib.where(F.col("year") <= top_year).groupBy("year").agg(F.count("*").alias("n"))
    ends = counts.agg(F.min("year").alias("a"), F.max("year").alias("b"), F.max("n").alias("most"))
    years = ends.where("a is not null").select(F.explode(F.sequence("a", "b")).alias("year"), "most")
    filled = years.join(counts, "year", "left").select("year", F.coalesce("n", F.lit(0)).alias("n"), "most")
    digits = F.length(F.col("most").cast("string"))
    line = F.concat(F.col("year").cast("string"), F.lit(" ("), F.lpad(F.col("n").cast("string"), digits, " "), F.lit("): "), bar(F.col("n"), F.col("most"), width))
    place = F.row_number().over(Window.orderBy(F.desc("year")))  # years are few
    return filled.select("year", "n", line.alias("line"), place.cast("bigint").alias("place"))


def bar(value: Column, most: Column, width: int) -> Column:
    """A bar in eighths of a block, rounded half to even; any positive value shows at least one eighth."""
    eighths = F.bround(value / most * (width * 8)).cast("int")
    eighths = F.when(value > 0, F.greatest(eighths, F.lit(1))).otherwise(F.lit(0))
    parts = F.array(*[F.lit(x) for x in ("", "▏", "▎", "▍", "▌", "▋", "▊", "▉")])
    return F.when(most > 0, F.concat(F.repeat(F.lit("█"), F.floor(eighths / 8).cast("int")), F.get(parts, eighths % 8))).otherwise(F.lit(""))


def missing_counts(bib: DataFrame) -> DataFrame:
    return bib.agg(F.count_if(missing(F.col("authors"))).alias("authors"), F.count_if(F.col("year").isNull()).alias("year"), F.count_if(missing(F.col("doi"))).alias("doi"))


def chunk_health(documents: DataFrame, states: DataFrame, chunks: DataFrame, present: DataFrame) -> DataFrame:
    """(current, stale_or_missing) over documents whose file is there.

    Without extractable text a document is current. Else it needs chunks and a state that is.
    """
    here = documents.join(present, "doc_id", "left_semi").join(states, "doc_id", "left").join(chunks.select("doc_id").distinct().withColumn("chunked", F.lit(True)), "doc_id", "left")
    good = (F.coalesce(F.col("status"), F.lit("")) == "no_extractable_text") | (F.coalesce("chunked", F.lit(False)) & F.coalesce("is_current", F.lit(False)))
    return here.agg(F.count_if(good).alias("current"), F.count_if(~good).alias("stale_or_missing"))


def buckets(audit: DataFrame, column: str = "bucket") -> DataFrame:
    """(bucket, n, percent) of all rows. The total is one number, joined to a few groups."""
    grouped = audit.groupBy(column).agg(F.count("*").alias("n"))
    total = grouped.agg(F.sum("n").alias("total"))
    return grouped.crossJoin(total).select(column, "n", F.round(100.0 * F.col("n") / F.col("total"), 2).alias("percent"))


def audit_bucket(failed: Column, has_outline: Column, headings: Column) -> Column:
    """What a document's structure can be taken from: an outline, two headings and more, or neither."""
    return F.when(failed, "error").when(has_outline, "structural_tree").when(headings >= 2, "heading_candidates").otherwise("neither")
