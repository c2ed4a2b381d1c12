"""Queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from lectern.llm.language_id import op4_language_id
from lectern.llm.neighbours import op6_neighbours
from lectern.llm.packing import op5_packing
from lectern.llm.pieces import op7_pieces
from lectern.llm.quality import op9_quality
from lectern.llm.simhash import op8_simhash
from lectern.llm.substring import op2_substring
from lectern.llm.suffix_array import op1_suffix_array
from lectern.llm.toxicity import op10_toxicity
from lectern.llm.url_filter import op3_url_filter

QUERIES = {
    "op1_suffix_array": op1_suffix_array,
    "op2_substring": op2_substring,
    "op3_url_filter": op3_url_filter,
    "op4_language_id": op4_language_id,
    "op5_packing": op5_packing,
    "op6_neighbours": op6_neighbours,
    "op7_pieces": op7_pieces,
    "op8_simhash": op8_simhash,
    "op9_quality": op9_quality,
    "op10_toxicity": op10_toxicity,
}

#: Every 50-word passage is spelled out, grouped and numbered; islands of its places are the spans.
_REPEATS = """
WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, pos, md5(array_to_string(ws[pos + 1 : pos + 50], ' ')) AS h
      FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - 49)) AS pos FROM w WHERE len(ws) >= 50)),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY h ORDER BY doc_id, pos) AS k, count(*) OVER (PARTITION BY h) AS n FROM g),
p AS (SELECT doc_id, pos, k > 1 AS redundant FROM r WHERE n > 1),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS span
      FROM (SELECT *, CASE WHEN pos <= lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 50 THEN 0 ELSE 1 END AS fresh FROM p)),
c AS (SELECT doc_id, span, pos, least(50, coalesce(lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) - pos, 50)) AS words FROM i WHERE redundant)
SELECT s.doc_id, CAST(min(s.pos) AS INTEGER) AS start_word, CAST(max(s.pos) + 50 AS INTEGER) AS end_word,
       CAST(max(s.pos) + 50 - min(s.pos) AS INTEGER) AS n_words, CAST(coalesce(any_value(t.cut), 0) AS INTEGER) AS n_cut
FROM i s LEFT JOIN (SELECT doc_id, span, sum(words) AS cut FROM c GROUP BY ALL) t ON s.doc_id = t.doc_id AND s.span = t.span
GROUP BY s.doc_id, s.span
"""

_URLS = """
WITH k AS (SELECT page_id, url, html, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(url)),
    '^[a-z]+://', ''), '[?#].*$', ''), '^(www|m)\\.', ''), '/+$', '') AS key FROM pages)
SELECT page_id, url, key, key IN (SELECT key FROM k WHERE contains(html, '$$$')) AS listed FROM k
"""

ORACLES: dict[str, str] = {"op3_url_filter": _URLS, "op1_suffix_array": _REPEATS, "op2_substring": _REPEATS}
