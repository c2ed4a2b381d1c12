"""Rules of metadata, reports and answers: literal cases with expected values, and whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import metadata as meta
from lectern.functions import text as T
from lectern.operators import duplicates, layout, reports
from lectern.operators import storage as ops
from lectern.plans.catalog import query
from lectern.plans.statistics import _HEALTH, _KEYED, _R, _dismissed, chunk_health, dismissed_pairs, page_counts, unresolved_groups
from lectern.plans.storage import chunks_of
from lectern.sources.fixtures import Rows
from lectern.sources.tables import SQL_BIB, SQL_LINES, SQL_VECTORS, bibliography, table, text_lines, vectors

_RANGES = Rows("id:int a:int b:int number:string title:string idx:int distance:double", (1, 3, 3, "3.1", " Data ", 4, 0.12344), (2, 3, 5, None, "Results", 1, 1.0), (3, None, 5, " ", None, 0, None), (4, 4, None, None, None, None, 0.99996), (5, None, None, "IV", "", 2, 12.5))


@query("f39_labels", f"WITH {_RANGES.sql('t')} SELECT id, CASE WHEN coalesce(a, b) IS NULL THEN NULL WHEN coalesce(a, b) = coalesce(b, a) THEN 'p. ' || coalesce(a, b) ELSE 'pp. ' || a || '–' || b END AS pages, coalesce(nullif(trim(concat_ws(' ', nullif(trim(number), ''), nullif(trim(title), ''))), ''), 'section ' || (idx + 1)) AS section, printf('%.4f', distance) AS distance FROM t")
def labels(spark, d):
    return _RANGES.frame(spark).select("id", T.page_label(F.col("a"), F.col("b")).alias("pages"), T.section_label(F.col("number"), F.col("title"), F.col("idx")).alias("section"), T.distance_label(F.col("distance")).alias("distance"))


_MARKDOWN = Rows("id:int text:string out:string", (1, "## Heading\n\nA **bold** `word`\n - item", "Heading\n\nA bold word\n- item"), (2, "  \n\n __u__ x \n\n \n", "u x"), (3, "", ""), (4, "one\n\n\n\ntwo\n\n#\n", "one\n\ntwo\n\n#"))


@query("f47_plain_summaries", f"WITH {_MARKDOWN.sql('t')} SELECT id, out AS text FROM t")
def plain_summaries(spark, d):
    return _MARKDOWN.frame(spark).select("id", T.plain_summary(F.col("text")).alias("text"))


@query("f47_joined_names", f"WITH {SQL_BIB}, n AS (SELECT doc_id, list_filter([CASE WHEN doc_id % 2 = 0 THEN title END, CASE WHEN doc_id % 3 = 0 THEN authors END, CASE WHEN doc_id % 5 = 0 THEN path ELSE '' END], lambda x: x IS NOT NULL AND x <> '') AS xs FROM bib) SELECT doc_id, CASE len(xs) WHEN 0 THEN '' WHEN 1 THEN xs[1] WHEN 2 THEN xs[1] || ' and ' || xs[2] ELSE xs[1] || ', ' || xs[2] || ', and ' || xs[3] END AS joined FROM n")
def joined_names(spark, d):
    n = F.col("doc_id")
    items = F.array(F.when(n % 2 == 0, F.col("title")), F.when(n % 3 == 0, F.col("authors")), F.when(n % 5 == 0, F.col("path")).otherwise(""))
    return bibliography(spark, d).select("doc_id", T.human_join(items).alias("joined"))


_ANSWERS = Rows(
    "id:int raw:string relevance:string relevant:boolean answers:boolean concepts:string told:string error:string",
    (1, '{"relevance": "strong", "explanation": "This passage explains maps.", "missing_concepts": []}', "strong", True, True, "", "Maps.", None),
    (2, 'text {"relevance": "WEAK", "answers_query": true, "missing_concepts": ["a  b", " ", "c"], "explanation": "discusses  other things"} tail', "weak", False, True, "a b|c", "Other things", None),
    (3, "no json", None, None, None, "", "no usable judgment", "no JSON in the answer"), (4, '{"relevance": "other", "relevant": true, "explanation": "fine"}', None, True, None, "", "Fine", None),
    (5, None, None, None, None, "", "no usable judgment", "no JSON in the answer"), (6, '{"relevance": "none", "explanation": " "}', "none", False, False, "", "no usable judgment", "no explanation"),
)


@query("f58_judgments", f"WITH {_ANSWERS.sql('t')} SELECT id, relevance, relevant, answers AS answers_query, concepts, told AS explanation, error FROM t")
def judgments(spark, d):
    rows = _ANSWERS.frame(spark).select("id", T.judgment(F.col("raw")).alias("j"))
    return rows.select("id", "j.relevance", "j.relevant", "j.answers_query", F.array_join("j.missing_concepts", "|").alias("concepts"), "j.explanation", "j.error")


_PAGES = Rows(
    "id:int text:string title:string authors:string", (1, "12\nA Study of\nCorpus Methods\nAda Lovelace\nAbstract", "A Study of Corpus Methods", "Ada Lovelace"), (2, "doi: 10.1/x\nSHOUTING TITLE HERE\nUniversity of Somewhere", "Shouting Title Here", None), (4, "", None, None), (5, None, None, None),
)


@query("f28_first_page_guess", f"WITH {_PAGES.sql('t')} SELECT id, title, authors FROM t")
def first_page_guess(spark, d):
    rows = _PAGES.frame(spark).select("id", meta.first_lines(F.col("text")).alias("lines"), meta.title_block(F.col("text")).alias("b"))
    return rows.select("id", meta.title_guess(F.col("lines"), F.col("b")).alias("title"), meta.authors_guess(F.col("lines"), F.col("b")).alias("authors"))


_PEOPLE = Rows("id:int authors:string names:string last:string", (1, "Ada Byron and Bo van der Berg; C. Dee Jr.", "Ada Byron|Bo van der Berg|C. Dee Jr.", "Byron|van der Berg|Dee"), (3, "unknown", "", ""), (4, None, "", ""), (5, "Ann (Lab) Lee & Q", "Ann (Lab) Lee|Q", "Lee"), (6, "Maria de la Cruz, Li Wei", "Maria de la Cruz|Li Wei", "de la Cruz|Wei"))


@query("f23_author_names", f"WITH {_PEOPLE.sql('t')} SELECT id, names FROM t")
def author_names(spark, d):
    return _PEOPLE.frame(spark).select("id", F.array_join(T.author_names(F.col("authors")), "|").alias("names"))


@query("f23_all_author_names", f"WITH {SQL_BIB} SELECT doc_id, replace(authors, ' and ', '|') AS names FROM bib")
def all_author_names(spark, d):
    return bibliography(spark, d).select("doc_id", F.array_join(T.author_names(F.col("authors")), "|").alias("names"))


@query("f24_surnames", f"WITH {_PEOPLE.sql('t')} SELECT id, last AS names FROM t")
def surnames(spark, d):
    names = F.filter(F.transform(T.author_names(F.col("authors")), T.surname), lambda x: x.isNotNull())
    return _PEOPLE.frame(spark).select("id", F.array_join(names, "|").alias("names"))


_WORKS = Rows(
    "id:int work:string title:string authors:string year:int doi:string", (1, '{"title":["On Maps"],"author":[{"given":"Ada","family":"Byron"},{"family":"Solo"},{"name":"THE GROUP"}],"issued":{"date-parts":[[2003,4]]},"DOI":"10.1/a"}', "On Maps", "Ada Byron, Solo, The Group", 2003, "10.1/a"),
    (2, '{"title":[],"author":[],"created":{"date-parts":[[1999]]},"published-print":{"date-parts":[[null]]}}', None, None, 1999, None), (3, "not json", None, None, None, None), (4, "{}", None, None, None, None),
)


@query("f29_registry_records", f"WITH {_WORKS.sql('t')} SELECT id, title, authors, year, doi FROM t")
def registry_records(spark, d):
    return _WORKS.frame(spark).select("id", meta.registry_record(F.col("work")).alias("r")).select("id", "r.title", "r.authors", "r.year", "r.doi")


@query("f30_merged_records", f"""WITH {SQL_BIB}, r AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Registry  ' || doc_id WHEN doc_id % 5 = 0 THEN '' END AS t1, CASE WHEN doc_id % 4 = 0 THEN 0 WHEN doc_id % 7 = 0 THEN 1990 END AS y1, CASE WHEN doc_id % 2 = 0 THEN title END AS t2, CASE WHEN doc_id % 5 > 0 THEN authors END AS a3, CASE WHEN doc_id % 6 = 0 THEN year END AS y3, path AS t4 FROM bib)
SELECT doc_id, trim(regexp_replace(coalesce(nullif(t1, ''), t2, t4), '\\s+', ' ', 'g')) AS title, a3 AS authors, coalesce(nullif(y1, 0), y3, 1900) AS year FROM r""")
def merged_records(spark, d):
    """Registry, embedded, first pages, file name: each field from the first that has it."""
    n, no, text = F.col("doc_id"), F.lit(None), F.col
    record = lambda title, authors, year: F.struct(title.cast("string").alias("title"), authors.cast("string").alias("authors"), year.cast("int").alias("year"), no.cast("string").alias("doi"))
    registry = record(F.when(n % 3 == 0, F.concat(F.lit("Registry  "), n.cast("string"))).when(n % 5 == 0, ""), no, F.when(n % 4 == 0, 0).when(n % 7 == 0, 1990))
    embedded, pages, file = record(F.when(n % 2 == 0, text("title")), no, no), record(no, F.when(n % 5 > 0, text("authors")), F.when(n % 6 == 0, text("year"))), record(text("path"), no, F.lit(1900))
    return bibliography(spark, d).select("doc_id", meta.merged_record(registry, embedded, pages, file).alias("m")).select("doc_id", "m.title", "m.authors", "m.year")


_CHANGES = f"""{SQL_BIB}, o AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'untitled' ELSE title END AS title, CASE WHEN doc_id % 3 = 0 THEN 'admin' ELSE authors END AS authors, CASE WHEN doc_id % 4 = 0 THEN 3000 ELSE year END AS year, doi FROM bib),
n AS (SELECT doc_id, 'Proposed ' || doc_id AS title, CASE WHEN doc_id % 5 > 0 THEN 'Ada Byron' END AS authors, 1999 AS year, '10.1000/' || (doc_id // 2) AS doi FROM bib)"""


def _change(name: str, bad: str, everything: bool) -> str:
    return f"CASE WHEN n.{name} IS NOT NULL AND n.{name} IS DISTINCT FROM o.{name} AND ({'true' if everything else bad}) THEN n.{name} END AS {name}"


def _sql_changes(everything: bool) -> str:
    parts = [_change("title", "o.title = 'untitled'", everything), _change("authors", "o.authors = 'admin'", everything), _change("year", "o.year = 3000", everything), _change("doi", "o.doi IS NULL", everything)]
    return f"SELECT doc_id, {str(everything).lower()} AS everything, {', '.join(parts)} FROM o JOIN n USING (doc_id)"


@query("p15_metadata_changes", f"WITH {_CHANGES} {_sql_changes(False)} UNION ALL {_sql_changes(True)}")
def metadata_changes(spark, d):
    """All four fields: what a proposal changes where only bad fields may, and where all may."""
    n = F.col("doc_id")
    old = F.struct(F.when(n % 2 == 0, "untitled").otherwise(F.col("title")).alias("title"), F.when(n % 3 == 0, "admin").otherwise(F.col("authors")).alias("authors"), F.when(n % 4 == 0, 3000).otherwise(F.col("year")).alias("year"), F.col("doi"))
    new = F.struct(F.concat(F.lit("Proposed "), n.cast("string")).alias("title"), F.when(n % 5 > 0, "Ada Byron").alias("authors"), F.lit(1999).alias("year"), F.concat(F.lit("10.1000/"), F.floor(n / 2).cast("string")).alias("doi"))
    rows, out = bibliography(spark, d).select("doc_id", old.alias("old"), new.alias("new")), None
    for everything in (False, True):
        part = rows.select("doc_id", F.lit(everything).alias("everything"), meta.record_updates(F.col("old"), F.col("new"), everything).alias("u")).select("doc_id", "everything", "u.*")
        out = part if out is None else out.unionByName(part)
    return out


@query("l10_metadata_refresh", f"WITH {_CHANGES}, l AS (SELECT doc_id, doc_id % 7 = 0 AS registry FROM bib WHERE doc_id % 3 > 0), a AS ({_sql_changes(False)}), b AS ({_sql_changes(True)}) SELECT o.doc_id, coalesce(CASE WHEN registry THEN b.title WHEN l.doc_id IS NOT NULL THEN a.title END, o.title) AS title, coalesce(CASE WHEN registry THEN b.year WHEN l.doc_id IS NOT NULL THEN a.year END, o.year) AS year FROM o LEFT JOIN l USING (doc_id) JOIN a USING (doc_id) JOIN b USING (doc_id)")
def metadata_refresh(spark, d):
    """Proposals of the registry replace what differs, others only bad fields; a third of the documents has none."""
    changes = metadata_changes(spark, d)
    n = F.col("doc_id")
    old = bibliography(spark, d).select("doc_id", F.when(n % 2 == 0, "untitled").otherwise(F.col("title")).alias("title"), F.when(n % 4 == 0, 3000).otherwise(F.col("year")).alias("year"))
    chosen = changes.where((n % 3 > 0) & (F.col("everything") == (n % 7 == 0))).select("doc_id", "title", "year")
    return ops.updated(old, chosen, "doc_id", ["title", "year"])


@query("s13_update_metadata", f"""WITH {SQL_BIB}, u AS (SELECT doc_id, CASE WHEN quality = 0 THEN '  Revised   ' || doc_id || ' ' WHEN toxic = 1 THEN ' ' END AS title, CASE WHEN toxic = 1 THEN 1999 END AS year FROM labels)
SELECT b.doc_id, coalesce(nullif(trim(regexp_replace(u.title, '\\s+', ' ', 'g')), ''), b.title) AS title, coalesce(u.year, b.year) AS year, CASE WHEN u.doc_id IS NOT NULL AND u.title IS NULL AND u.year IS NULL THEN 'nothing to update' END AS error FROM bib b LEFT JOIN u USING (doc_id)""")
def update_metadata(spark, d):
    """Null leaves a field; titles are cleaned, blank ones change nothing; an update of nothing is an error."""
    title = F.when(F.col("quality") == 0, F.concat(F.lit("  Revised   "), F.col("doc_id").cast("string"), F.lit(" "))).when(F.col("toxic") == 1, " ")
    updates = table(spark, d, "labels").select("doc_id", title.alias("title"), F.when(F.col("toxic") == 1, 1999).alias("year"))
    done = ops.updated(bibliography(spark, d).select("doc_id", "title", "year"), updates, "doc_id", ["title", "year"])
    return done.join(ops.update_errors(updates, "doc_id", ["title", "year"]), "doc_id", "left")


@query("a7_year_histogram", f"""WITH {SQL_BIB}, c AS (SELECT year, count(*) AS n FROM bib WHERE year <= 1997 AND year <> 1994 GROUP BY year), m AS (SELECT max(n) AS most FROM c),
f AS (SELECT CAST(y AS INTEGER) AS year, coalesce(n, 0) AS n, most, CAST(CASE WHEN coalesce(n, 0) > 0 THEN greatest(1, round_even(coalesce(n, 0) / most * 320, 0)) ELSE 0 END AS INTEGER) AS e
  FROM (SELECT unnest(range((SELECT min(year) FROM c), (SELECT max(year) + 1 FROM c))) AS y) LEFT JOIN c ON year = y CROSS JOIN m)
SELECT row_number() OVER (ORDER BY year DESC) AS place, year, n, year || ' (' || lpad(CAST(n AS VARCHAR), CAST(length(CAST(most AS VARCHAR)) AS INTEGER), ' ') || '): ' || repeat('█', e // 8) || ['', '▏', '▎', '▍', '▌', '▋', '▊', '▉'][e % 8 + 1] AS line FROM f""")
def year_histogram(spark, d):
    """Lines from the last year to the first; one year is taken out to leave a gap."""
    return reports.year_histogram(bibliography(spark, d).where("year <> 1994"), 1997)


@query("a13_margin_keys", f"""WITH {SQL_LINES}, k AS (SELECT doc_id, page, trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '[0-9]+', '#', 'g'), '[^a-z#]+', ' ', 'g'), '\\s+', ' ', 'g')) AS key FROM lines WHERE line_index % 20 IN (0, 1, 19))
SELECT doc_id, key, count(DISTINCT page) AS pages FROM k WHERE length(key) >= 3 GROUP BY ALL""")
def margin_keys(spark, d):
    """On how many pages of its document a key stands in the margins: the first two lines of twenty, and the last."""
    y = F.col("line_index") % 20 * 15.0 + 5
    lines = text_lines(spark, d).where(layout.in_margin(y, F.lit(320.0)))
    return lines.select("doc_id", "page", T.repetition_key(T.normal_text(F.col("text"))).alias("key")).where(F.length("key") >= 3).groupBy("doc_id", "key").agg(F.countDistinct("page").alias("pages"))


_OUTLINE = "CASE WHEN doc_id % 13 = 0 THEN 'error' WHEN doc_id % 3 = 0 THEN 'structural_tree' WHEN n_lines >= 2 AND doc_id % 2 = 0 THEN 'heading_candidates' ELSE 'neither' END"


@query("a18_audit_buckets", f"WITH b AS (SELECT {_OUTLINE} AS bucket FROM (SELECT doc_id, len(string_split(text, chr(10))) AS n_lines FROM documents)) SELECT bucket, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM b), 2) AS percent FROM b GROUP BY bucket")
def audit_buckets(spark, d):
    """Files that can't be read, that have an outline (every third), two headings at least, or neither."""
    n = F.col("doc_id")
    docs = table(spark, d, "documents").select("doc_id", F.size(F.split("text", "\n")).alias("n_lines"))
    return reports.buckets(docs.select(reports.audit_bucket(n % 13 == 0, n % 3 == 0, F.when((F.col("n_lines") >= 2) & (n % 2 == 0), 2).otherwise(0)).alias("bucket")))


@query("l7_dedupe_actions", f"""WITH {_KEYED}, p AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, min(priority) AS priority FROM keyed a JOIN keyed b USING (priority, key) WHERE a.doc_id < b.doc_id GROUP BY ALL), q AS (SELECT * FROM p WHERE NOT (doc_a % 6 = 0 AND doc_b = doc_a + 1)),
a AS (SELECT doc_a, doc_b, CASE doc_a % 4 WHEN 0 THEN 'delete b' WHEN 1 THEN 'not duplicate' WHEN 2 THEN 'delete a' ELSE 'skip' END AS action FROM q), g AS (SELECT DISTINCT CASE WHEN action = 'delete a' THEN doc_a ELSE doc_b END AS doc_id FROM a WHERE starts_with(action, 'delete'))
SELECT 'documents' AS name, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM g) UNION ALL SELECT 'dismissed', (SELECT count(*) FROM documents WHERE doc_id % 6 = 0) + (SELECT count(*) FROM a WHERE action = 'not duplicate')
UNION ALL SELECT 'left', count(*) FROM a WHERE action = 'skip' AND doc_a NOT IN (SELECT doc_id FROM g) AND doc_b NOT IN (SELECT doc_id FROM g)""")
def dedupe_actions(spark, d):
    """Deletions, dismissals and skips, one for each pair by its first id."""
    pairs = duplicates.candidates(bibliography(spark, d), _dismissed(spark, d)).select("doc_a", "doc_b")
    n = F.col("doc_a") % 4
    actions = pairs.withColumn("action", F.when(n == 0, "delete b").when(n == 1, "not duplicate").when(n == 2, "delete a").otherwise("skip"))
    kept, gone, left = duplicates.resolved(table(spark, d, "documents").select("doc_id"), pairs, actions, _dismissed(spark, d))
    count = lambda name, rows: rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    return count("documents", kept).unionByName(count("dismissed", gone)).unionByName(count("left", left))


@query("l8_health_report", f"""WITH {_KEYED}, {SQL_VECTORS}, {_HEALTH}, k AS (SELECT count(*) FILTER (WHERE authors IS NULL) AS a, count(*) FILTER (WHERE year IS NULL) AS y, count(*) FILTER (WHERE doi IS NULL) AS x, count(*) AS n FROM bib),
p AS (SELECT priority, a.key, a.doc_id AS x, b.doc_id AS y FROM keyed a JOIN keyed b USING (priority, key) WHERE a.doc_id < b.doc_id)
SELECT 'documents' AS measure, n AS value FROM k UNION ALL SELECT 'missing authors', a FROM k UNION ALL SELECT 'missing year', y FROM k UNION ALL SELECT 'missing doi', x FROM k
UNION ALL SELECT 'current chunks', count(*) FROM h WHERE good UNION ALL SELECT 'stale chunks', count(*) FROM h WHERE NOT coalesce(good, false) UNION ALL SELECT 'dismissed pairs', count(*) FROM documents WHERE doc_id % 6 = 0
UNION ALL SELECT 'unresolved: ' || reason, count(DISTINCT p.key) FROM p JOIN names USING (priority) WHERE NOT (x % 6 = 0 AND y = x + 1) GROUP BY reason UNION ALL SELECT 'not indexed', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM vectors)""")
def health_report(spark, d):
    """Gaps in metadata, chunks, duplicates left by reason, and documents that the index lacks."""
    bib = bibliography(spark, d)
    missing = table(spark, d, "documents").select("doc_id").join(vectors(spark, d).select("doc_id").distinct(), "doc_id", "left_anti")
    parts = [
        bib.agg(F.count("*").alias("value")).select(F.lit("documents").alias("measure"), "value"),
        reports.missing_counts(bib).select(F.expr("stack(3, 'missing authors', authors, 'missing year', year, 'missing doi', doi) as (measure, value)")),
        chunk_health(spark, d).select(F.expr("stack(2, 'current chunks', current, 'stale chunks', stale_or_missing) as (measure, value)")),
        dismissed_pairs(spark, d).select(F.lit("dismissed pairs").alias("measure"), F.col("dismissed").alias("value")),
        unresolved_groups(spark, d).select(F.concat(F.lit("unresolved: "), "reason").alias("measure"), F.col("unresolved").alias("value")),
        missing.agg(F.count("*").alias("value")).select(F.lit("not indexed").alias("measure"), "value"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("l12_stats_report", f"""{_R}, {SQL_BIB}, {SQL_LINES}, c AS (SELECT count(*) AS n FROM chunks), p AS (SELECT sum(p) AS n FROM (SELECT max(page) AS p FROM lines GROUP BY doc_id)), k AS (SELECT count(*) AS n FROM documents), s AS (SELECT lower(unnest(string_split(authors, ' and '))) AS s FROM bib)
SELECT 'documents' AS measure, CAST(n AS VARCHAR) AS value FROM k UNION ALL SELECT 'chunks', CAST(n AS VARCHAR) FROM c UNION ALL SELECT 'avg chunks', printf('%.2f', c.n / k.n) FROM c, k UNION ALL SELECT 'avg pages', printf('%.2f', p.n / k.n) FROM p, k
UNION ALL (SELECT 'author ' || s, CAST(count(*) AS VARCHAR) FROM s GROUP BY s ORDER BY count(*) DESC, s LIMIT 10) UNION ALL SELECT 'year ' || year, CAST(count(*) AS VARCHAR) FROM bib GROUP BY year""")
def stats_report(spark, d):
    """Sizes, averages over all documents, the ten most frequent authors, and years."""
    from lectern.operators.prompts import top_authors

    bib, docs = bibliography(spark, d), table(spark, d, "documents").select("doc_id")
    sizes = docs.agg(F.count("*").alias("n")).crossJoin(chunks_of(spark, d).agg(F.count("*").alias("c"))).crossJoin(page_counts(spark, d).agg(F.sum("pages").alias("p")))  # one row each
    shown = sizes.select(F.expr("stack(4, 'documents', cast(n as string), 'chunks', cast(c as string), 'avg chunks', format_string('%.2f', cast(c as double) / n), 'avg pages', format_string('%.2f', cast(p as double) / n)) as (measure, value)"))
    authors = top_authors(bib, 10).select(F.concat(F.lit("author "), "surname").alias("measure"), F.col("n").cast("string").alias("value"))
    years = bib.groupBy("year").agg(F.count("*").alias("n")).select(F.concat(F.lit("year "), F.col("year").cast("string")).alias("measure"), F.col("n").cast("string").alias("value"))
    return shown.unionByName(authors).unionByName(years)
