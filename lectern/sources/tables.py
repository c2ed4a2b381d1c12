"""The corpus model bound to the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-blank lines of the documents: (doc_id, line_index, page, text); 20 lines make a page."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_index", "text"))
    return docs.where(F.trim("text") != "").select("doc_id", "line_index", (F.floor(F.col("line_index") / 20) + 1).cast("int").alias("page"), "text")


def bibliography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bibliographic record a document, put together from the star schema.

    The two modular joins go to the dimension tables, whose sizes come from the files' row
    counts; all joins are equi-joins, so none of them needs a hint.
    """
    supplier, customer = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    n_supplier, n_customer = supplier.count(), customer.count()
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("sha"))
    joined = (
        docs.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("title")), "doc_id")
        .join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.year("o_orderdate").alias("year")), "doc_id")
        .join(supplier.select("s_suppkey", "s_name"), F.col("doc_id") % n_supplier == F.col("s_suppkey"))
        .join(customer.select("c_custkey", "c_name"), F.col("doc_id") % n_customer == F.col("c_custkey"))
    )
    return joined.select(
        "doc_id",
        "sha",
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        "title",
        F.concat("c_name", F.lit(" and "), "s_name").alias("authors"),
        F.col("year").cast("int").alias("year"),
        F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("10.1000/"), F.floor(F.col("doc_id") / 2).cast("string"))).alias("doi"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored chunk vectors: five chunks a document."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.floor(F.col("vec_id") / 5).cast("bigint").alias("doc_id"), (F.col("vec_id") % 5).cast("int").alias("chunk_index"), F.col("embedding").cast("array<double>").alias("v"))


# ---- the same bindings in SQL, for the oracles --------------------------------------------

SQL_LINES = """lines AS (SELECT doc_id, CAST(i AS INTEGER) AS line_index, CAST(i // 20 + 1 AS INTEGER) AS page, text FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents) WHERE trim(text) <> '')"""

SQL_BIB = """bib AS (SELECT d.doc_id, sha256(d.text) AS sha, d.source || '/' || CAST(d.doc_id AS VARCHAR) || '.txt' AS path, p_name AS title,
  c_name || ' and ' || s_name AS authors, CAST(year(o_orderdate) AS INTEGER) AS year,
  CASE WHEN d.doc_id % 5 <> 0 THEN '10.1000/' || CAST(d.doc_id // 2 AS VARCHAR) END AS doi
  FROM documents d JOIN part ON p_partkey = d.doc_id JOIN orders ON o_orderkey = d.doc_id
  JOIN supplier ON s_suppkey = d.doc_id % (SELECT count(*) FROM supplier) JOIN customer ON c_custkey = d.doc_id % (SELECT count(*) FROM customer))"""

SQL_VECTORS = """vectors AS (SELECT vec_id, vec_id // 5 AS doc_id, CAST(vec_id % 5 AS INTEGER) AS chunk_index, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"""

#: Chunk by chunk: cumulative ends of the words joined by blanks tell where the next break is.
SQL_CHUNKS = """pos AS (SELECT doc_id, i, w, sum(length(w) + 1) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS e FROM (
    SELECT doc_id, unnest(ws) AS w, unnest(range(0, len(ws))) AS i FROM (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS ws FROM documents))),
  folded AS (SELECT doc_id, list(w ORDER BY i) AS ws, list(e ORDER BY i) AS ends FROM pos GROUP BY doc_id),
  cuts AS (SELECT doc_id, ws, ends, CAST(0 AS BIGINT) AS s, greatest(CAST(1 AS BIGINT), len(list_filter(ends, lambda x: x <= 2000))) AS t, 0 AS k FROM folded
    UNION ALL SELECT doc_id, ws, ends, t, greatest(t + 1, len(list_filter(ends, lambda x: x <= ends[t] + 1 + 2000))), k + 1 FROM cuts WHERE t < len(ws)),
  chunks AS (SELECT doc_id, CAST(k AS INTEGER) AS chunk_index, array_to_string(ws[s+1:t], ' ') AS text FROM cuts)"""
