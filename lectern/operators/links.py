"""Proximity alerts and confirmed links between chunks: canonical pairs and their life cycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUSES = ("pending", "confirmed", "rejected")


def pair_id(a: Column, b: Column) -> Column:
    """An id that both orders of a pair share, made from the pair alone."""
    return F.sha2(F.concat_ws("|", F.least(a, b), F.greatest(a, b)), 256)


def alert_records(alerts: DataFrame) -> DataFrame:
    """(pa_id, chunk_a, chunk_b, score, status): chunk ids in textual order, the distance as score, one row a pair.

    Pairs of a chunk with itself are no alerts. Of a pair found from both sides the smaller
    distance is kept (they only differ by rounding).
    """
    a, b = F.col("source_chunk"), F.col("target_chunk")
    rows = alerts.where(a != b).select(pair_id(a, b).alias("pa_id"), F.least(a, b).alias("chunk_a"), F.greatest(a, b).alias("chunk_b"), "distance")
    return rows.groupBy("pa_id", "chunk_a", "chunk_b").agg(F.min("distance").alias("score")).withColumn("status", F.lit("pending"))


def new_alerts(stored: DataFrame, arriving: DataFrame) -> DataFrame:
    """Arriving records whose pair isn't stored: inserting twice changes nothing."""
    return arriving.join(stored.select("pa_id"), "pa_id", "left_anti")


def decided(records: DataFrame, decisions: DataFrame) -> DataFrame:
    """Records with the status that was decided, and when; unknown statuses and ids change nothing. The last decision counts.

    A record that goes back to pending has no time of decision. Times are ISO 8601 text in UTC.
    """
    known = decisions if "at" in decisions.columns else decisions.withColumn("at", F.lit(None).cast("string"))
    d = known.where(F.col("decision").isin(*STATUSES)).groupBy("pa_id").agg(F.max_by(F.struct("decision", "at"), "seq").alias("d"))
    old = F.col("decided_at") if "decided_at" in records.columns else F.lit(None).cast("string")
    told = F.when(F.col("d").isNull(), old).when(F.col("d.decision") != "pending", F.col("d.at"))
    return records.join(d, "pa_id", "left").withColumns({"decided_at": told, "status": F.coalesce("d.decision", "status")}).drop("d")


def iso(time: Column) -> Column:
    """A time as ISO 8601 text in UTC, microseconds only where there are any."""
    utc = F.to_utc_timestamp(time, F.current_timezone())
    return F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.date_format(utc, "SSSSSS") != "000000", F.concat(F.lit("."), F.date_format(utc, "SSSSSS"))).otherwise(""), F.lit("+00:00"))


def confirmed_links(records: DataFrame, wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """(pa_id, relationship) that may be inserted: the alert is confirmed and has no link yet."""
    ok = records.where("status = 'confirmed'").select("pa_id")
    return wanted.join(ok, "pa_id", "left_semi").join(existing.select("pa_id"), "pa_id", "left_anti")
