"""Metadata queries: extraction, casing, quality, merging. Rules the tables never trigger run on literal rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import metadata as meta
from lectern.functions import text as T
from lectern.plans.catalog import query
from lectern.sources.fixtures import Rows
from lectern.sources.tables import SQL_BIB, bibliography, table

_SQ = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"


@query("f1_clean_text", f"SELECT doc_id, nullif({_SQ.format('text')}, '') AS cleaned FROM documents")
def clean_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.clean(F.col("text")).alias("cleaned"))


_TITLES = Rows("id:int title:string", (1, "DEEP LEARNING OF THE DNA CODE"), (2, "Already Mixed CASE"), (3, "ABC"), (4, "THE STATE-OF-THE-ART IN NLP"), (5, "  WORLD   WAR II "), (6, None), (7, ""), (8, "THE END OF"))


@query("f2_title_case")
def title_case(spark, d):
    return _TITLES.frame(spark).select("id", meta.title_case(F.col("title")).alias("title"))


_NAMES = Rows("id:int authors:string", (1, "WILLIAM W. O'NEIL and YORAM SMITH-JONES"), (2, "Ada Lovelace"), (3, "VINCENT VAN DYKE"), (4, None), (5, "J. Roe"))


@query("f3_name_case")
def name_case(spark, d):
    return _NAMES.frame(spark).select("id", meta.name_case(F.col("authors")).alias("authors"))


_DOIS = Rows("id:int text:string", (1, "see 10.1234/abc.5, and https://doi.org/10.1/no and https://doi.org/10.5555/xy7."), (2, "10.1234/short1 and 10.1234/longer.22)"), (3, "10.1234/nodigits"), (4, "10.1073/p.24/-/Sup"), (5, "none"), (6, None), (7, "10.1234/aa1 10.1234/zz1"))


@query("f26_doi_extract", f"""WITH {_DOIS.sql('t')}, c AS (SELECT id, unnest(regexp_extract_all(text, '(?i)https?://doi[.]org/(10[.][0-9]{{4,9}}/[^\\s<>''"]+)', 1)) AS x, 1 AS link FROM t UNION ALL
SELECT id, unnest(regexp_extract_all(text, '\\b(10[.][0-9]{{4,9}}/[^\\s<>''"]+)', 1)), 0 FROM t), k AS (SELECT id, link, rtrim(split_part(x, '/-/', 1), '.,;:)]}}') AS x FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY link DESC, length(x) DESC, x DESC) AS n FROM k WHERE regexp_matches(substr(x, strpos(x, '/')), '[0-9]')) SELECT t.id, r.x AS doi FROM t LEFT JOIN r ON t.id = r.id AND r.n = 1""")
def doi_extract(spark, d):
    return _DOIS.frame(spark).select("id", meta.best_doi(F.col("text")).alias("doi"))


_YEARS = Rows("id:int text:string", (1, "in 1987, revised 2004"), (2, "May 1999 after 2010"), (3, "2011 ACM, 2015"), (4, "© 2001 or 2019"), (5, "18th"), (6, None), (7, "x1999y 1950"))


@query("f27_year_extract", f"""WITH {_YEARS.sql('t')} SELECT id, CAST(coalesce(nullif(regexp_extract(text, '(?i)\\b(?:jan|feb|mar|apr|may|jun|jul|aug|sept?|oct|nov|dec)[a-z]*\\s+((?:19|20)[0-9]{{2}})\\b', 1), ''),
nullif(regexp_extract(text, '(?i)\\b((?:19|20)[0-9]{{2}})\\s+acm\\b', 1), ''), nullif(regexp_extract(text, '©\\s*((?:19|20)[0-9]{{2}})\\b', 1), ''), list_max(regexp_extract_all(text, '\\b((?:19|20)[0-9]{{2}})\\b', 1))) AS INTEGER) AS year FROM t""")
def year_extract(spark, d):
    return _YEARS.frame(spark).select("id", meta.best_year(F.col("text")).alias("year"))


@query("f27_years_in_texts", "SELECT doc_id, CAST(list_max(regexp_extract_all(text, '\\b((?:19|20)[0-9]{2})\\b', 1)) AS INTEGER) AS latest FROM documents")
def years_in_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_max(F.regexp_extract_all("text", F.lit(r"\b((?:19|20)\d{2})\b"), 1)).cast("int").alias("latest"))


@query("f28_page_titles", "SELECT page_id, nullif(trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '\\s+', ' ', 'g')), '') AS title FROM pages")
def page_titles(spark, d):
    return table(spark, d, "pages").select("page_id", T.clean(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"))


_FILES = Rows("id:int path:string", (1, "a/b/Epsilon_2006_Social_Science.pdf"), (2, "plain-name.pdf"), (3, "x/2010.pdf"), (4, "noext"))


@query("f28_filename_guess", f"""WITH {_FILES.sql('t')}, w AS (SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_extract(path, '[^/]*$'), '[.][^.]*$', ''), '[_-]+', ' ', 'g'), '\\s+', ' ', 'g')) AS s FROM t)
SELECT id, nullif(trim(regexp_replace(regexp_replace(s, '\\b(19|20)[0-9]{{2}}\\b', '', 'g'), '\\s+', ' ', 'g')), '') AS title, TRY_CAST(nullif(regexp_extract(s, '\\b((19|20)[0-9]{{2}})\\b', 1), '') AS INTEGER) AS year FROM w""")
def filename_guess(spark, d):
    title, year = meta.filename_title_year(F.col("path"))
    return _FILES.frame(spark).select("id", title.alias("title"), year.alias("year"))


_RECORDS = Rows("id:int title:string authors:string year:int", (1, "A Good Title", "Ada Byron", 1999), (2, "Untitled 7", "admin", 3000), (3, "ABCD1234", "10.1234/x", None), (4, None, None, 1750), (5, "paper.pdf", "scan.pdf", 2000), (6, "Atlas", "C:\\x", 1800))


@query("f31_metadata_quality", f"""WITH {_RECORDS.sql('t')}, f AS (SELECT id, title IS NULL OR regexp_matches(lower(title), 'document|final|layout|manuscript|microsoft word|proof|untitled') OR regexp_matches(title, '[.](docx?|pdf)$') AS bt,
regexp_matches(title, '^[A-Z0-9]{{8}}$') AS jt, authors IS NULL OR lower(authors) IN ('admin', 'user') OR authors LIKE '%.pdf' OR contains(authors, '/') OR contains(authors, chr(92)) AS ba, NOT coalesce(year BETWEEN 1800 AND 2100, false) AS y FROM t)
SELECT id, concat_ws(', ', CASE WHEN bt THEN 'bad title' WHEN jt THEN 'title is a file name' END, CASE WHEN ba THEN 'bad authors' END, CASE WHEN y THEN 'bad year' END) AS complaints FROM f""")
def metadata_quality(spark, d):
    return _RECORDS.frame(spark).select("id", F.array_join(meta.metadata_complaints(F.col("title"), F.col("authors"), F.col("year")), ", ").alias("complaints"))


@query("f21_doi_keys", f"WITH {SQL_BIB} SELECT doc_id, lower(doi) AS key FROM bib")
def doi_keys(spark, d):
    doi = F.concat(F.lit("https://doi.org/"), F.col("doi"), F.lit(" ."))
    return bibliography(spark, d).select("doc_id", T.doi_key(doi).alias("key"))


@query("f22_title_keys", f"WITH {SQL_BIB} SELECT doc_id, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS key FROM bib")
def title_keys(spark, d):
    return bibliography(spark, d).select("doc_id", T.title_key(F.col("title")).alias("key"))


@query("f25_work_keys", f"WITH {SQL_BIB} SELECT doc_id, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) || '|' || CAST(year AS VARCHAR) || '|' || lower(split_part(authors, ' and ', 1)) AS key FROM bib")
def work_keys(spark, d):
    from lectern.operators.duplicates import work_key

    return bibliography(spark, d).select("doc_id", work_key(F.col("title"), F.col("year"), F.col("authors")).alias("key"))
