"""Queries on highlight matching and the default encoder."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import evidence as ev
from lectern.operators import matching as M
from lectern.plans.catalog import query
from lectern.sources.fixtures import Rows
from lectern.sources.tables import SQL_LINES, table, text_lines

_SQL_TOKENS = r"list_filter(list_transform(string_split_regex(trim({0}), '\s+'), lambda w: regexp_replace(lower(w), '[^a-z0-9]+', '', 'g')), lambda w: w <> '')"


@query("f54_match_tokens", rf"SELECT item_id, array_to_string({_SQL_TOKENS.format('text')}, ' ') AS tokens FROM benchmark")
def match_tokens(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(M.tokens_of(F.col("text")), " ").alias("tokens"))


_FORMS = Rows("id:int text:string out:string", (1, "eﬃcient ﬂow", "efficient flow"), (2, "co­op, ＡＢ１", "coop ab1"), (3, "— ...", ""), (4, None, None), (5, "½ x²", "12 x2"))


@query("f54_folded_forms", f"WITH {_FORMS.sql('t')} SELECT id, out AS tokens FROM t")
def folded_forms(spark, d):
    return _FORMS.frame(spark).select("id", F.array_join(M.tokens_of(F.col("text")), " ").alias("tokens"))


#: Excerpts are words 4 to 11 of a line with ten words and more; every third has a word more in the middle.
@query("f55_excerpt_spans", rf"""WITH {SQL_LINES}, t AS (SELECT doc_id, line_index, {_SQL_TOKENS.format('text')} AS ts FROM lines), e AS (SELECT * FROM t WHERE len(ts) BETWEEN 12 AND 40),
p AS (SELECT *, (SELECT min(i) FROM (SELECT unnest(range(0, len(ts) - 7)) AS i) WHERE ts[i + 1 : i + 8] = ts[4:11]) AS pos FROM e)
SELECT doc_id, line_index, CAST(pos AS INTEGER) AS start, CAST(pos + 8 AS INTEGER) AS "end", 'exact-token' AS method FROM p""")
def excerpt_spans(spark, d):
    """Where eight words of a line are found again: exactly, and first."""
    lines = text_lines(spark, d).select("doc_id", "line_index", M.tokens_of(F.col("text")).alias("ts")).where(F.size("ts").between(12, 40))
    found = lines.select("doc_id", "line_index", M.spans(F.col("ts"), F.slice("ts", 4, 8)).alias("m"))
    return found.select("doc_id", "line_index", "m.start", "m.end", "m.method")


@query("f55_fuzzy_spans")
def fuzzy_spans(spark, d):
    """The same with a word replaced and one put in; tested against a plain search of all windows."""
    lines = text_lines(spark, d).select("doc_id", "line_index", M.tokens_of(F.col("text")).alias("ts")).where(F.size("ts").between(12, 24))
    excerpt = F.concat(F.slice("ts", 4, 3), F.array(F.lit("zzz")), F.slice("ts", 8, 4), F.array(F.lit("yyy")))
    found = lines.select("doc_id", "line_index", M.spans(F.col("ts"), excerpt).alias("m"))
    return found.select("doc_id", "line_index", "m.start", "m.end", F.round("m.score", 6).alias("score"), "m.method")


@query("f56_candidate_pages", "SELECT o_orderkey, array_to_string(CASE WHEN greatest(1, s) > least(CASE WHEN e IS NULL OR e < s THEN s ELSE e END, c) THEN [] ELSE range(greatest(1, s), least(least(CASE WHEN e IS NULL OR e < s THEN s ELSE e END, c), greatest(1, s) + 3) + 1) END, ',') AS pages FROM (SELECT o_orderkey, CAST(o_orderkey % 9 - 1 AS BIGINT) AS s, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 13 END AS e, o_orderkey % 11 AS c FROM orders)")
def candidate_pages(spark, d):
    n = F.col("o_orderkey")
    end = F.when(n % 4 > 0, n % 13).cast("int")
    return table(spark, d, "orders").select("o_orderkey", F.array_join(M.candidate_pages((n % 9 - 1).cast("int"), end, (n % 11).cast("int")).cast("array<string>"), ",").alias("pages"))


@query("f56_excerpts", rf"SELECT item_id, array_to_string(string_split_regex(trim(text), '\s+')[1:30], ' ') AS excerpt, len({_SQL_TOKENS.format('text')}) BETWEEN 1 AND 60 AS safe FROM benchmark")
def excerpts(spark, d):
    return table(spark, d, "benchmark").select("item_id", M.first_words(F.col("text"), 8, 30).alias("excerpt"), M.is_short_enough(M.tokens_of(F.col("text")), 60).alias("safe"))


@query("f56_line_boxes", """WITH w AS (SELECT l_orderkey AS doc_id, l_linenumber // 3 AS line, l_quantity AS x, l_linenumber * 10.0 AS y FROM lineitem)
SELECT doc_id, min(x) AS x0, min(y) AS y0, max(x + 30) AS x1, max(y + 8) AS y1 FROM w GROUP BY doc_id, line""")
def line_boxes(spark, d):
    """Items as words of an order's page, three a line; a box a line."""
    n = F.col("l_linenumber")
    y = (n * 10).cast("double")
    words = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), n.alias("at"), F.lit(0).alias("block"), F.floor(n / 3).cast("int").alias("line"), F.col("l_quantity").alias("x0"), y.alias("y0"), (F.col("l_quantity") + 30).alias("x1"), (y + 8).alias("y1"))
    return M.line_boxes(words).select("doc_id", "x0", "y0", "x1", "y1")


_PLAIN = ", ".join(f"'{w}'" for w in M.PLAIN)


#: Words with other than ASCII letters are left out whole: a word boundary lies beyond them.
@query("f51_content_words", rf"""WITH t AS (SELECT item_id, regexp_replace(text, '[A-Za-z0-9_]*[^\x00-\x7F]([A-Za-z0-9_]|[^\x00-\x7F])*', ' ', 'g') AS text FROM benchmark),
r AS (SELECT item_id, unnest(regexp_extract_all(text, '\b[A-Za-z][A-Za-z0-9''-]{{2,}}\b')) AS w, generate_subscripts(regexp_extract_all(text, '\b[A-Za-z][A-Za-z0-9''-]{{2,}}\b'), 1) AS i FROM t),
k AS (SELECT item_id, w, i, trim(lower(w), '''-') AS key FROM r), f AS (SELECT *, row_number() OVER (PARTITION BY item_id, key ORDER BY i) AS n FROM k WHERE length(key) >= 4 AND key NOT IN ({_PLAIN}))
SELECT b.item_id, coalesce(string_agg(w, ' ' ORDER BY i), '') AS words FROM benchmark b LEFT JOIN f ON f.item_id = b.item_id AND n = 1 GROUP BY b.item_id""")
def content_words(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(M.content_words(F.col("text")), " ").alias("words"))


_QUERY = "license file of the software"


@query("r1_encoded_texts", r"""WITH w AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM benchmark), b AS (SELECT item_id, ('0x' || substr(md5(w), 1, 4))::INTEGER % 64 AS bucket, CASE WHEN ('0x' || substr(md5(w), 5, 1))::INTEGER % 2 = 1 THEN 1.0 ELSE -1.0 END AS s FROM w),
c AS (SELECT item_id, bucket, sum(s) AS n FROM b GROUP BY ALL), l AS (SELECT item_id, sqrt(sum(n * n)) AS norm FROM c GROUP BY item_id) SELECT item_id, bucket, round(n / norm, 6) AS weight FROM c JOIN l USING (item_id) WHERE n <> 0""")
def encoded_texts(spark, d):
    vectors = table(spark, d, "benchmark").select("item_id", F.posexplode(M.encoded(F.col("text"))).alias("bucket", "weight"))
    return vectors.where("weight <> 0").select("item_id", "bucket", F.round("weight", 6).alias("weight"))


@query("f53_best_excerpts")
def best_excerpts(spark, d):
    """Of each document the window nearest to a question by the default encoder, and the text around it; tested against a loop."""
    asked = M.hashed_words([_QUERY])[0].tolist()
    words = table(spark, d, "documents").select("doc_id", "text", ev.window_words(F.col("text")).alias("words"))
    windows = words.select("doc_id", F.posexplode(ev.semantic_windows(F.col("words"))).alias("i", "w"))
    scored = windows.withColumn("score", M.likeness(F.col("w"), asked))
    best = scored.groupBy("doc_id").agg(F.max(F.struct("score", (-F.col("i")).alias("at"), "w")).alias("b"))
    return words.join(best, "doc_id").select("doc_id", F.col("b.score").alias("score"), M.excerpt_around(F.col("text"), F.col("b.w"), 300).alias("excerpt"))
