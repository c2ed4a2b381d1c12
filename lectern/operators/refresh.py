"""What has to be made again: pipeline state, chunks and index entries that no longer fit their document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.versions import is_current
from lectern.operators.storage import listing_key, numbered

#: Pipeline state: (doc_id, print, status); a document without extractable text keeps that status whatever its fingerprint.
NO_TEXT = "no_extractable_text"


def has_no_text() -> Column:
    return F.coalesce(F.col("status") == NO_TEXT, F.lit(False))


def states(documents: DataFrame, state: DataFrame, wanted: Column) -> DataFrame:
    """Documents with ``no_text``, ``equal`` (to the fingerprint wanted; a document without text is, always) and ``current``."""
    joined = documents.join(state.select("doc_id", "print", "status"), "doc_id", "left")
    return joined.withColumns({"no_text": has_no_text(), "equal": has_no_text() | F.coalesce(F.col("print") == wanted, F.lit(False)), "current": is_current(F.col("print"))})


def marked_no_text(state: DataFrame, empty: DataFrame) -> DataFrame:
    """State after documents (doc_id) turned out to have no text."""
    kept = state.select("doc_id", "print", "status").join(empty, "doc_id", "left_anti")
    return kept.unionByName(empty.distinct().select("doc_id", F.lit(None).cast("string").alias("print"), F.lit(NO_TEXT).alias("status")))


def needs(documents: DataFrame, state: DataFrame, indexed: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Documents with ``need``: null, "stale" or "not indexed". Without text, or without their file, they need nothing."""
    told = states(documents, state, F.lit(None).cast("string")).join(indexed.select("doc_id").distinct().withColumn("__in", F.lit(True)), "doc_id", "left")
    need = F.when(F.col("no_text"), None).when(~F.col("current"), "stale").when(F.col("__in").isNull(), "not indexed")
    told = told.withColumn("need", need).drop("__in", "no_text", "equal", "current", "print", "status")
    return told if files is None else told.join(files.select("path").distinct(), "path", "left_semi")


def refresh_list(needed: DataFrame) -> DataFrame:
    """(place, doc_id, need): what isn't indexed first, then what is stale, each in the order of the listing."""
    kind = F.when(F.col("need") == "not indexed", 0).otherwise(1)
    return numbered(needed.where("need is not null").withColumn("kind", kind), [F.col("kind"), *listing_key()], "place").select("place", "doc_id", "need")


def chunking_plan(documents: DataFrame, state: DataFrame, chunks: DataFrame, version: str, wanted: Column) -> DataFrame:
    """(doc_id, action) by what there is: "skip" without text, "reuse" chunks of this version whose fingerprint is the one
    wanted, "rebuild" others (alerts, links, chunks and state go first), "build" where there are none."""
    have = chunks.where(F.col("version") == version).select("doc_id").distinct().withColumn("__have", F.lit(True))
    told = states(documents, state, wanted).join(have, "doc_id", "left")
    action = F.when(F.col("no_text"), "skip").when(F.col("__have").isNull(), "build").when(F.col("equal"), "reuse").otherwise("rebuild")
    return told.select("doc_id", action.alias("action"))


def chunked(documents: DataFrame, state: DataFrame, chunks: DataFrame, version: str, wanted: Column, build) -> tuple[DataFrame, DataFrame]:
    """Chunks and state after documents (doc_id, text) were chunked: what can be reused stays, stale versions are replaced.

    ``build`` makes (doc_id, chunk_index, text) of documents. Those that give no chunk are marked as
    without text. Chunks of other versions and documents stay.
    """
    plan = chunking_plan(documents.select("doc_id"), state, chunks, version, wanted)
    todo = documents.join(plan.where("action in ('build', 'rebuild')").select("doc_id"), "doc_id", "left_semi")
    made = build(todo).withColumn("version", F.lit(version))
    old = chunks.join(plan.where("action = 'rebuild'").select("doc_id"), "doc_id", "left_anti")
    done = made.select("doc_id").distinct()
    empty = todo.select("doc_id").join(done, "doc_id", "left_anti")
    kept = state.select("doc_id", "print", "status").join(todo.select("doc_id"), "doc_id", "left_anti")
    fresh = done.select("doc_id", wanted.alias("print"), F.lit("ok").alias("status"))
    return old.unionByName(made.select(*old.columns)), marked_no_text(kept.unionByName(fresh), empty)


def existing_status(files: DataFrame, documents: DataFrame, state: DataFrame, chunks: DataFrame, indexed: DataFrame, version: str, wanted: Column) -> DataFrame:
    """For files (path, sha) whose content is known: (path, doc_id, has_chunks, has_current_pipeline, has_index, no_text).

    The pipeline is current without text, or with chunks of this version and the fingerprint
    wanted; the index is only asked where both hold.
    """
    have = chunks.where(F.col("version") == version).select("doc_id").distinct().withColumn("__have", F.lit(True))
    known = files.select("path", "sha").join(documents.select("doc_id", "sha"), "sha").drop("sha")
    told = states(known, state, wanted).join(have, "doc_id", "left").join(indexed.select("doc_id").distinct().withColumn("__in", F.lit(True)), "doc_id", "left")
    has = F.coalesce("__have", F.lit(False))
    current = F.col("no_text") | (has & F.col("equal"))
    return told.select("path", "doc_id", has.alias("has_chunks"), current.alias("has_current_pipeline"), (~(current & has) | F.coalesce("__in", F.lit(False))).alias("has_index"), "no_text")


def screening(files: DataFrame, rejected: DataFrame, status: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Outcome of screening files (path, sha): (path, outcome), and the rejections to keep.

    A rejected file is skipped while its content is what it was, or can't be read (sha null). A
    file whose document is current is skipped as well. Of the rest, decisions (path, decision:
    approve, decline, pause) tell; without one a file waits.
    """
    before = rejected.select("path", F.col("sha").alias("__seen"))
    current = status.where("has_current_pipeline and has_index").select("path").distinct().withColumn("__done", F.lit(True))
    told = files.select("path", "sha").join(before, "path", "left").join(current, "path", "left").join(decisions.select("path", "decision"), "path", "left")
    again = F.col("__seen").isNotNull() & (F.col("sha").isNull() | (F.col("sha") == F.col("__seen")))
    outcome = F.when(again, "rejected before").when(F.col("__done"), "already there").when(F.col("decision") == "approve", "ingest").when(F.col("decision") == "decline", "rejected").otherwise("pending")
    out = told.select("path", "sha", outcome.alias("outcome"))
    fresh = out.where("outcome = 'rejected'").select("path", "sha")
    kept = rejected.select("path", "sha").join(out.where("outcome not in ('rejected before', 'already there')").select("path"), "path", "left_anti")
    return out.select("path", "outcome"), kept.unionByName(fresh)
