"""Category counts: the wide table of turns, and the long one of tokens.

The default tokeniser is a pattern (runs of letters and digits, lower-cased); a tokeniser of the user's own gives
an array column of tokens.  Either way a text is cut into tokens once, tokens of no category are left out, and the
rest is looked up category by category in the same row: no explode of words, no shuffle of texts, no Python.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.dictionary import TOKEN, Dictionary, ends_of
from parley.functions.scoring import rate


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def count_name(category: str) -> str:
    return f"n_{category}"


def category_counts(rows: DataFrame, tokens_: str, dictionary: Dictionary, categories: Iterable[str]) -> DataFrame:
    """rows with n_<category> columns, how many tokens of an array column fit; a null column counts as null."""
    categories = list(categories)
    some = rows.withColumn("__some", F.filter(tokens_, lambda t: dictionary.fits(t, categories)))
    one = lambda c: F.size(F.filter("__some", lambda t: dictionary.fits(t, [c]))).cast("long")
    return some.withColumns({count_name(c): one(c) for c in categories}).drop("__some")


def turn_counts(turns: DataFrame, dictionary: Dictionary, categories: Iterable[str]) -> DataFrame:
    """turns with `total` (words) and n_<category> columns; null text has no words."""
    rows = turns.withColumn("__tokens", tokens(F.coalesce("text", F.lit(""))))
    rows = rows.withColumn("total", F.size("__tokens").cast("long"))
    return category_counts(rows, "__tokens", dictionary.lowered(), categories).drop("__tokens")


def long_counts(counts: DataFrame, keys: list[str], categories: Iterable[str]) -> DataFrame:
    """keys, category, n, total, rate: a row for each category, zero counts too."""
    rows = F.array(*(F.struct(F.lit(c).alias("category"), F.col(count_name(c)).alias("n")) for c in categories))
    out = counts.select(*keys, "total", F.inline(rows))
    return out.select(*keys, "category", "n", "total", rate(F.col("n"), F.col("total")).alias("rate"))


def match_tokens(words: DataFrame, dictionary: Dictionary, categories: Iterable[str], fold_case: bool = True) -> DataFrame:
    """words (word) -> (word, category), distinct: each distinct word against the dictionary once.

    Two joins on equal keys: whole words, and words' ends of the lengths that occur before and after a `*`.
    fold_case lowers the patterns, as the default tokeniser lowers its tokens.
    """
    own = dictionary.only(categories)
    own = own.lowered() if fold_case else own
    table = own.table(words.sparkSession)
    distinct = words.select("word").where("word is not null").distinct()
    exact = distinct.join(table.where("a is null"), F.col("word") == F.col("key")).select("word", "category")
    stars = [p.split("*") for p, _ in own.entries if "*" in p]
    lengths = sorted({(len(x[0]), len(x[-1])) for x in stars})
    if not lengths:
        return exact.distinct()
    each = F.inline(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in lengths)))
    ends = distinct.select("word", each).where(F.length("word") >= F.col("a") + F.col("b"))
    ends = ends.withColumn("key", ends_of(F.col("word"), F.col("a"), F.col("b")))
    found = ends.join(table.where("a is not null"), ["a", "b", "key"]).where(F.col("regex").isNull() | F.regexp_like("word", F.col("regex")))
    return exact.unionByName(found.select("word", "category")).distinct()


def token_counts(
    tokenised: DataFrame, keys: list[str], dictionary: Dictionary, categories: Iterable[str], column: str = "tokens",
    fold_case: bool = True
) -> DataFrame:
    """Counts of any tokeniser's tokens: rows with an array column -> keys, category, n (zeros left out)."""
    own = dictionary.only(categories)
    own = own.lowered() if fold_case else own
    counted = category_counts(tokenised.select(*keys, F.col(column).alias("__tokens")), "__tokens", own, own.labels)
    rows = counted.select(*keys, F.inline(F.array(*(F.struct(F.lit(c).alias("category"), F.col(count_name(c)).alias("n")) for c in own.labels))))
    return rows.where("n > 0").groupBy(*keys, "category").agg(F.sum("n").alias("n"))
