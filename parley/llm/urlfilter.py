"""URL filters with redirect equivalence, in DataFrame operations alone.

A url's own longest rule decides it.  Urls without a rule take the verdict of their component over
redirect and canonical-link edges: an explicit allow anywhere in it comes first, else a block anywhere
in it blocks all its aliases, else they are allowed.  Vertices are host + path, so urls that differ in
scheme, query or fragment are one vertex; a vertex's path has no dot segments, and an empty one is /.
Links inside comments, scripts and other raw text make no edges; character references in links are decoded.

Defined cases: a null url or one without :// has an empty host and path, no rule and no vertex; it is
allowed.  Repeated pages each get their row; null html has no edges; links of a scheme without // (mailto:) make
none; extra columns, whatever their names, are not read; an empty table gives no rows.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import table
from parley.llm.components import connected_components

# Verdict, host and path of the rules that the query applies.
RULES = (
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"),
    ("block", "com", "/de/")
)
#: Up to so many rules become one expression; more are looked up by a join on the host's endings and the path's beginnings.
MOST_IN_EXPRESSION = 64
# Named character references that urls hold, the ampersand last.
REFERENCES = (("&quot;", '"'), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))
#: What holds no links: comments and raw text.
UNREAD = r"(?is)<!--.*?(?:-->|$)|<(script|style|noscript|template|textarea|title|xmp|iframe)\b[^>]*>.*?(?:</\1\s*>|$)"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first :// up to / ? # or the end, A-Z lowered; then up to ? or #."""
    part = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(part(1), ascii_uppercase, ascii_lowercase), part(2)


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """struct(verdict, rule) of the longest rule that fits, or null; ties go to the rule listed first."""
    out = None
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        value = F.struct(F.lit(verdict).alias("verdict"), F.lit(rule_host + rule_path).alias("rule"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<verdict:string,rule:string>")


def ruled(rows: DataFrame, rules=RULES) -> DataFrame:
    """rows (host, path, ...) with `own`, the struct of rule_for; rules: (verdict, host, path), any number."""
    if len(rules) <= MOST_IN_EXPRESSION:
        return rows.withColumn("own", rule_for(F.col("host"), F.col("path"), rules))
    table_ = pa.table(dict(zip(("verdict", "ending", "head"), map(list, zip(*rules, strict=True)), strict=True)) | {"place": list(range(len(rules)))})
    listed = rows.sparkSession.createDataFrame(table_)
    lengths = sorted({len(path) for _, _, path in rules})
    parts = F.split("host", r"\.")
    endings = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    asked = rows.select("host", "path").distinct().withColumn("ending", F.explode(endings))
    asked = asked.withColumn("k", F.explode(F.array(*map(F.lit, lengths)))).where(F.length("path") >= F.col("k"))
    asked = asked.select("host", "path", "ending", F.expr("substring(path, 1, k)").alias("head"))
    size = F.length("ending") + F.length("head")
    value = F.struct(F.col("verdict").alias("verdict"), F.concat("ending", "head").alias("rule"))
    found = asked.join(listed, ["ending", "head"]).groupBy("host", "path").agg(F.max_by(value, F.struct(size, -F.col("place"))).alias("own"))
    return rows.join(found, ["host", "path"], "left").select(*rows.columns, "own")


def decoded(text: Column) -> Column:
    """With character references in place of numbers, and those of REFERENCES."""
    number = lambda r: F.when(
        F.lower(r).startswith("&#x"), F.conv(F.regexp_extract(r, "[0-9a-fA-F]+", 0), 16, 10)
    ).otherwise(F.regexp_extract(r, "[0-9]+", 0))
    one = lambda r: F.decode(F.unhex(F.lpad(F.hex(number(r).cast("long")), 8, "0")), "UTF-32")
    valid = lambda r: (number(r).cast("long") < 0x110000) & ~number(r).cast("long").between(0xD800, 0xDFFF)
    found = F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit("&#(?:[xX][0-9a-fA-F]{1,6}|[0-9]{1,7});"), F.lit(0))), valid)
    out = F.aggregate(found, text, lambda s, r: F.replace(s, r, one(r)))
    for name, char in REFERENCES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return out


def without_dots(path: Column) -> Column:
    """The path with its . and .. segments taken away, / where it is empty."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/")
    none = F.array().cast("array<string>")
    up = lambda out: F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))
    kept = F.aggregate(parts, none, lambda out, x: F.when(x == ".", out).when(x == "..", up(out)).otherwise(F.array_append(out, x)))
    tail = F.when(F.element_at(parts, -1).isin(".", ".."), F.array_append(kept, F.lit(""))).otherwise(kept)
    return F.concat(F.lit("/"), F.array_join(tail, "/"))


def vertex(host: Column, path: Column) -> Column:
    return F.when(host != "", F.concat(host, without_dots(path)))


def link_edges(pages: DataFrame) -> DataFrame:
    """(a, b): vertices joined by a canonical link or a meta refresh in the page's html."""
    html = F.regexp_replace("html", UNREAD, " ")
    canonical = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
    refresh = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
    tag = lambda pattern: F.regexp_extract("read", pattern, 0)
    link = F.regexp_extract(tag(canonical), r"(?is)\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\"'\s>]+))", 0)
    href = F.regexp_replace(F.regexp_replace(link, r"(?is)^href\s*=\s*[\"']?", ""), "[\"']$", "")
    moved = F.regexp_extract(tag(refresh), r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1)
    some = pages.where(F.col("html").rlike(r"(?i)<(?:link|meta)\b[^>]*(?:canonical|refresh)")).withColumn("read", html)
    to = some.select("url", F.explode(F.array(href, moved)).alias("to")).select("url", F.trim(decoded(F.col("to"))).alias("to"))
    host, path = split_url(F.col("url"))
    base = F.regexp_extract(path, r"(?s)^.*/", 0)
    base = F.when(base == "", "/").otherwise(base)
    to_host, to_path = split_url(F.when(F.col("to").startswith("//"), F.concat(F.lit("http:"), "to")).otherwise(F.col("to")))
    rel = F.regexp_extract("to", r"(?s)^[^?#]*", 0)
    target = (
        F.when(F.col("to").rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//"), vertex(to_host, to_path))
        .when(F.col("to").rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(F.col("to").startswith("/"), vertex(host, rel))
        .when(rel == "", vertex(host, path))
        .otherwise(vertex(host, F.concat(base, rel)))
    )
    return to.where("to <> ''").select(vertex(host, path).alias("a"), target.alias("b")).where("a is not null and b is not null")


def component_verdicts(edges: DataFrame, rules=RULES) -> DataFrame:
    """(vertex, component_verdict) of each vertex on an edge; null where its component has no rule."""
    parts = connected_components(edges)
    host, path = F.regexp_extract("node", r"(?s)^[^/]*", 0), F.regexp_extract("node", r"(?s)/.*$", 0)
    own = ruled(parts.withColumns({"host": host, "path": path}), rules).withColumn("own", F.col("own.verdict"))
    found = own.groupBy("component").agg(F.max(F.col("own") == "allow").alias("allows"), F.max(F.col("own") == "block").alias("blocks"))
    found = found.select("component", F.when(F.col("allows"), "allow").when(F.col("blocks"), "block").alias("component_verdict"))
    return parts.join(found, "component").select(F.col("node").alias("vertex"), "component_verdict")


def judge(pages: DataFrame, edges: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages; edges: (a, b) vertices."""
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = ruled(rows, rules).withColumn("vertex", vertex(F.col("host"), F.col("path")))
    out = rows.join(component_verdicts(edges, rules), "vertex", "left")
    verdict = F.coalesce(F.col("own.verdict"), F.col("component_verdict"), F.lit("allow"))
    return out.select("page_id", "host", "path", F.col("own.rule").alias("rule"), verdict.alias("verdict"))


def op2_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge(pages, link_edges(pages))
