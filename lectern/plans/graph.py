"""Alerts between chunks: pairs, idempotent inserts, decisions, links."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import links
from lectern.plans.catalog import query
from lectern.plans.retrieval import _ALL_NEAR, proximity_alerts
from lectern.shared import persist_table
from lectern.sources.tables import SQL_VECTORS, vectors

_ID = "CAST(vec_id // 5 AS VARCHAR) || ':v2:' || CAST(vec_id % 5 AS VARCHAR)"
_RECORDS = f"""{SQL_VECTORS}, {_ALL_NEAR}, named AS (SELECT {_ID} AS s, {_ID.replace('vec_id', 'neighbour')} AS t, distance FROM alerts),
records AS (SELECT sha256(least(s, t) || '|' || greatest(s, t)) AS pa_id, least(s, t) AS chunk_a, greatest(s, t) AS chunk_b, min(distance) AS score FROM named GROUP BY 1, 2, 3),
judged AS (SELECT *, CASE WHEN substr(pa_id, 1, 1) IN ('0', '1', '2') THEN 'confirmed' WHEN substr(pa_id, 1, 1) = '3' THEN 'rejected' ELSE 'pending' END AS status FROM records)"""


def chunk_name(vec_id):
    return F.concat(F.floor(vec_id / 5).cast("string"), F.lit(":v2:"), (vec_id % 5).cast("string"))


def records(spark, d, again=False):
    """Alerts as records; ``again`` says that a query reads them more than once, so that the search is done only once."""
    found = proximity_alerts(spark, d)
    found = persist_table(found, "alerts") if again else found
    near = found.select(chunk_name(F.col("vec_id")).alias("source_chunk"), chunk_name(F.col("neighbour")).alias("target_chunk"), "distance")
    return links.alert_records(near)


@query("l2_alert_records", f"WITH {_RECORDS} SELECT pa_id, chunk_a, chunk_b, score, 'pending' AS status FROM records")
def alert_records(spark, d):
    return records(spark, d)


@query("l1_canonical_pairs", f"WITH {SQL_VECTORS}, n AS (SELECT {_ID} AS s, {_ID.replace('vec_id', '(vec_id + 7)')} AS t FROM vectors) SELECT s, t, least(s, t) AS chunk_a, greatest(s, t) AS chunk_b, sha256(least(s, t) || '|' || greatest(s, t)) AS pa_id FROM n")
def canonical_pairs(spark, d):
    rows = vectors(spark, d).select(chunk_name(F.col("vec_id")).alias("s"), chunk_name(F.col("vec_id") + 7).alias("t"))
    return rows.select("s", "t", F.least("s", "t").alias("chunk_a"), F.greatest("s", "t").alias("chunk_b"), links.pair_id(F.col("s"), F.col("t")).alias("pa_id"))


@query("l3_new_alerts", f"WITH {_RECORDS} SELECT pa_id FROM records WHERE substr(pa_id, 2, 1) > '7'")
def new_alerts(spark, d):
    found = records(spark, d, again=True)
    return links.new_alerts(found.where(F.substring("pa_id", 2, 1) <= "7"), found).select("pa_id")


def judged(spark, d):
    found = records(spark, d, again=True)
    first = F.substring("pa_id", 1, 1)
    decisions = found.where(first <= "3").select("pa_id", F.when(first == "3", "rejected").otherwise("confirmed").alias("decision"), F.lit(1).alias("seq"))
    return links.decided(found, decisions)


@query("l4_status_changes", f"WITH {_RECORDS}, e AS (SELECT pa_id, substr(pa_id, 1, 1) AS c, strftime(TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * (length(chunk_a) % 7), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS moment FROM records) SELECT pa_id, CASE WHEN c <= '2' THEN 'confirmed' WHEN c = '3' THEN 'rejected' ELSE 'pending' END AS status, CASE WHEN c <= '3' THEN moment END AS decided_at FROM e")
def status_changes(spark, d):
    """First digits up to 3 are decided; those of 4 and 5 went back to pending, later digits only by an unknown word."""
    found = records(spark, d, again=True)
    first = F.substring("pa_id", 1, 1)
    at = links.iso(F.to_timestamp(F.lit("2024-01-01 00:00:00")) + F.make_interval(hours=F.length("chunk_a") % 7))
    one = found.where(first <= "5").select("pa_id", F.when(first == "3", "rejected").otherwise("confirmed").alias("decision"), F.lit(1).alias("seq"), at.alias("at"))
    back = one.where(first.between("4", "5")).select("pa_id", F.lit("pending").alias("decision"), F.lit(2).alias("seq"), "at")
    odd = found.where(first > "5").select("pa_id", F.lit("perhaps").alias("decision"), F.lit(1).alias("seq"), at.alias("at"))
    return links.decided(found, one.unionByName(back).unionByName(odd)).select("pa_id", "status", "decided_at")


@query("l5_confirmed_links", f"WITH {_RECORDS} SELECT pa_id, sha256('link|' || pa_id) AS cl_id, 'related' AS relationship FROM judged WHERE status = 'confirmed' AND substr(pa_id, 2, 1) <> 'f'")
def confirmed_links(spark, d):
    found = judged(spark, d)
    wanted = found.select("pa_id", F.sha2(F.concat(F.lit("link|"), "pa_id"), 256).alias("cl_id"), F.lit("related").alias("relationship"))
    return links.confirmed_links(found, wanted, found.where(F.substring("pa_id", 2, 1) == "f"))


@query("a17_alerts_by_chunk", f"WITH {_RECORDS} SELECT chunk_a, count(*) AS alerts, min(score) AS nearest, array_to_string(list_sort(list(chunk_b)), ' ') AS others FROM records GROUP BY chunk_a")
def alerts_by_chunk(spark, d):
    return records(spark, d).groupBy("chunk_a").agg(F.count("*").alias("alerts"), F.min("score").alias("nearest"), F.array_join(F.array_sort(F.collect_list("chunk_b")), " ").alias("others"))


@query("j10_links_of_alerts", f"WITH {_RECORDS}, l AS (SELECT pa_id FROM judged WHERE status = 'confirmed'), gone AS (SELECT pa_id FROM records WHERE split_part(chunk_a, ':', 1) IN ('1', '2') OR split_part(chunk_b, ':', 1) IN ('1', '2')) SELECT pa_id FROM l WHERE pa_id NOT IN (SELECT pa_id FROM gone)")
def links_of_alerts(spark, d):
    found = judged(spark, d)
    gone = found.where(F.split("chunk_a", ":", 3)[0].isin("1", "2") | F.split("chunk_b", ":", 3)[0].isin("1", "2")).select("pa_id")
    return found.where("status = 'confirmed'").select("pa_id").join(gone, "pa_id", "left_anti")
