"""The registered queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from parley.llm.bpe import op7_bpe
from parley.llm.htmltext import op6_html_text
from parley.llm.languageid import op9_language_id
from parley.llm.nearest import op4_nearest
from parley.llm.ngramjoin import op3_ngram_jaccard
from parley.llm.packing import op1_packing
from parley.llm.qualityclassifier import op5_quality_classifier
from parley.llm.qualityrules import op10_quality_rules
from parley.llm.secrets import op8_secrets
from parley.llm.urlfilter import RULES, op2_url_filter

QUERIES = {
    "op1_packing": op1_packing,
    "op2_url_filter": op2_url_filter,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_nearest": op4_nearest,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_html_text": op6_html_text,
    "op7_bpe": op7_bpe,
    "op8_secrets": op8_secrets,
    "op9_language_id": op9_language_id,
    "op10_quality_rules": op10_quality_rules,
}

#: Rules, and components over canonical links; of the forms of links SQL resolves those with a host and those from the root.
URL_FILTER = r"""
WITH RECURSIVE rules(verdict, host, path) AS (VALUES {rules}),
split AS (SELECT page_id, url, html, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), '{upper}', '{lower}'), '') AS host,
  coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path FROM pages),
links AS (SELECT host, path, regexp_extract(regexp_extract(regexp_replace(html, '<!--.*?(?:-->|$)', ' ', 'gs'), '<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>', 0, 'is'),
  'href\s*=\s*["'']?([^"''\s>]+)', 1, 'is') AS link FROM split WHERE host <> ''),
edges AS (SELECT host || CASE path WHEN '' THEN '/' ELSE path END AS a,
  CASE WHEN link LIKE '/%' AND link NOT LIKE '//%' THEN host || regexp_extract(link, '^[^?#]*')
   ELSE translate(regexp_extract(link, '^(?:[a-z]+:)?//([^/?#]*)([^?#]*)', 1, 'i'), '{upper}', '{lower}') || coalesce(nullif(regexp_extract(link, '^(?:[a-z]+:)?//([^/?#]*)([^?#]*)', 2, 'i'), ''), '/') END AS b
  FROM links WHERE link LIKE '/%' OR link LIKE '%://%'),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(vertex, other) AS (SELECT a, a FROM both_ways UNION SELECT r.vertex, e.b FROM reach r JOIN both_ways e ON e.a = r.other),
others AS (SELECT DISTINCT other, regexp_extract(other, '^[^/]*') AS host, regexp_extract(other, '/.*$', 0, 's') AS path FROM reach),
own AS (SELECT k.key, arg_max(r.verdict, length(r.host || r.path)) AS verdict, arg_max(r.host || r.path, length(r.host || r.path)) AS rule
  FROM (SELECT DISTINCT host || '|' || path AS key, host, path FROM (SELECT host, path FROM split UNION SELECT host, path FROM others)) k
  JOIN rules r ON (k.host = r.host OR ends_with(k.host, '.' || r.host)) AND starts_with(k.path, r.path) GROUP BY k.key),
component AS (SELECT vertex, CASE WHEN bool_or(verdict = 'allow') THEN 'allow' WHEN bool_or(verdict = 'block') THEN 'block' END AS verdict
  FROM reach JOIN others USING (other) LEFT JOIN own ON own.key = others.host || '|' || others.path GROUP BY vertex)
SELECT page_id, s.host, s.path, own.rule, coalesce(own.verdict, c.verdict, 'allow') AS verdict FROM split s
LEFT JOIN own ON own.key = s.host || '|' || s.path LEFT JOIN component c ON s.host <> '' AND c.vertex = s.host || CASE s.path WHEN '' THEN '/' ELSE s.path END"""

#: All pairs that share a shingle, and the least id that each document reaches over links.
NGRAM_JACCARD = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM shingles x JOIN shingles y USING (s) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
linked AS (SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * k >= 90 * (p.n + q.n - k)),
reach(doc_id, root) AS (SELECT doc_id, doc_id FROM sizes UNION SELECT b, root FROM reach JOIN linked ON a = reach.doc_id WHERE root < b),
roots AS (SELECT doc_id, min(root) AS root FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(root, d.doc_id) AS component_id FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN roots USING (doc_id)"""


def _filled(sql: str) -> str:
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    return sql.replace("{rules}", rules).replace("{upper}", ascii_uppercase).replace("{lower}", ascii_lowercase)


ORACLES: dict[str, str] = {"op2_url_filter": _filled(URL_FILTER), "op3_ngram_jaccard": _filled(NGRAM_JACCARD)}
