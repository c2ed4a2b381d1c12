"""Duplicate documents: groups by key, pairs, dismissals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import author_names, doi_key, surname, title_key


def first_surname(authors: Column) -> Column:
    return F.replace(F.lower(surname(F.get(author_names(authors), F.lit(0)))), F.lit("ß"), F.lit("ss"))


def work_key(title: Column, year: Column, authors: Column) -> Column:
    """title|year|surname; null as soon as one part is."""
    return F.concat(title_key(title), F.lit("|"), year.cast("string"), F.lit("|"), first_surname(authors))


#: Reasons in the order in which they claim a pair.
REASONS = ("same PDF hash", "same DOI", "same title/year/first author")


def keyed(bib: DataFrame) -> DataFrame:
    """(reason, key, doc_id) of every document that has the key; one pass over the records."""
    keys = F.array(
        F.struct(F.lit(0).alias("priority"), F.col("sha").alias("key")),
        F.struct(F.lit(1).alias("priority"), doi_key(F.col("doi")).alias("key")),
        F.struct(F.lit(2).alias("priority"), work_key(F.col("title"), F.col("year"), F.col("authors")).alias("key")),
    )
    return bib.select("doc_id", F.inline(keys)).where("key is not null")


def in_groups(bib: DataFrame) -> DataFrame:
    """The keyed rows of shared keys, with the group's size and smallest member; no group is gathered in one row."""
    w = Window.partitionBy("priority", "key")
    return keyed(bib).withColumn("size", F.count("*").over(w)).where("size > 1")


def candidates(bib: DataFrame, dismissed: DataFrame) -> DataFrame:
    """(reason, doc_a, doc_b): pairs that share a key and weren't dismissed, each for its first reason.

    Singletons leave before the self join, so it only sees rows that have a partner. All pairs
    of a group are the result, as the listing asks for.
    """
    rows = in_groups(bib).select("priority", "key", "doc_id")
    a, b = rows.withColumnRenamed("doc_id", "doc_a"), rows.withColumnRenamed("doc_id", "doc_b")
    pairs = a.join(b, ["priority", "key"]).where("doc_a < doc_b").groupBy("doc_a", "doc_b").agg(F.min("priority").alias("priority"))
    names = F.element_at(F.array(*[F.lit(r) for r in REASONS]), F.col("priority") + 1)
    return pairs.join(dismissed, ["doc_a", "doc_b"], "left_anti").select(names.alias("reason"), "doc_a", "doc_b")


def unresolved_groups(bib: DataFrame, dismissed: DataFrame) -> DataFrame:
    """(reason, unresolved): groups of each reason with a pair left that wasn't dismissed.

    Counted, not paired: a group is resolved if as many of its pairs are dismissed as it has.
    """
    rows = in_groups(bib)
    gone = dismissed.join(rows.select("priority", "key", F.col("doc_id").alias("doc_a")), "doc_a").join(rows.select("priority", "key", F.col("doc_id").alias("doc_b")), ["priority", "key", "doc_b"])
    gone = gone.select("priority", "key", "doc_a", "doc_b").distinct().groupBy("priority", "key").agg(F.count("*").alias("gone"))
    sizes = rows.groupBy("priority", "key").agg(F.first("size").alias("size"))
    left = sizes.join(gone, ["priority", "key"], "left").where("size * (size - 1) div 2 > coalesce(gone, 0)")
    names = F.element_at(F.array(*[F.lit(r) for r in REASONS]), F.col("priority") + 1)
    return left.groupBy(names.alias("reason")).agg(F.count("*").alias("unresolved"))


def resolved(documents: DataFrame, pairs: DataFrame, actions: DataFrame, dismissed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, dismissals and pairs left after actions (doc_a, doc_b, action) on duplicate pairs.

    "delete a" and "delete b" remove a document, "not duplicate" dismisses the pair, "skip" leaves
    it for another time; pairs of a deleted document are done with.
    """
    told = pairs.join(actions, ["doc_a", "doc_b"], "left")
    gone = told.where("action in ('delete a', 'delete b')").select(F.when(F.col("action") == "delete a", F.col("doc_a")).otherwise(F.col("doc_b")).alias("doc_id")).distinct()
    dismissals = dismissed.unionByName(told.where("action = 'not duplicate'").select("doc_a", "doc_b")).distinct()
    left = told.where("coalesce(action, 'skip') = 'skip'").select(*pairs.columns)
    for side in ("doc_a", "doc_b"):
        left = left.join(gone.withColumnRenamed("doc_id", side), side, "left_anti")
    return documents.join(gone, "doc_id", "left_anti"), dismissals, left.select(*pairs.columns)
