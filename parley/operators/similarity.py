"""Static similarity of a conversation, of its time windows, and the wide records of both."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.dictionary import Dictionary
from parley.functions.scoring import deviation, mean, present, similarity, window_index
from parley.operators.features import category_counts, count_name, tokens


def by_speaker(counts: DataFrame, keys: Sequence[str], speakers: tuple[str, str], categories: Sequence[str]) -> DataFrame:
    """keys, total_1, total_2 and <category>_1, <category>_2: sums for the two speakers, 0 for none."""
    totals = []
    for k, name in enumerate(speakers, 1):
        mine = F.col("speaker") == name
        totals.append(F.coalesce(F.sum(F.when(mine, F.col("total"))), F.lit(0)).alias(f"total_{k}"))
        totals += [F.coalesce(F.sum(F.when(mine, F.col(count_name(c)))), F.lit(0)).alias(f"{c}_{k}") for c in categories]
    return counts.groupBy(*keys).agg(*totals)


def scores(sums: DataFrame, keys: Sequence[str], categories: Sequence[str], rounding: int | None = None) -> DataFrame:
    """keys, total_1, total_2, lsm_mean, lsm_std, lsm_n_active_cats and lsm_<category>."""
    each = {f"lsm_{c}": similarity(F.col(f"{c}_1"), F.col("total_1"), F.col(f"{c}_2"), F.col("total_2"), rounding) for c in categories}
    out = sums.select(*keys, "total_1", "total_2", *(v.alias(k) for k, v in each.items()))
    columns = list(map(F.col, each))
    return out.select(
        *keys, "total_1", "total_2", mean(columns).alias("lsm_mean"), deviation(columns).alias("lsm_std"),
        present(columns).alias("lsm_n_active_cats"), *each
    )


def conversation_similarity(
    counts: DataFrame, speakers: tuple[str, str], categories: Sequence[str], keys: Sequence[str] = ("conv_id",),
    rounding: int | None = None
) -> DataFrame:
    return scores(by_speaker(counts, keys, speakers, categories), keys, categories, rounding)


def as_long(wide: DataFrame, keys: Sequence[str], categories: Sequence[str], prefix: str, value: str) -> DataFrame:
    """keys, category, value from <prefix>_<category> columns; missing values keep their rows."""
    rows = F.array(*(F.struct(F.lit(c).alias("category"), F.col(f"{prefix}_{c}").alias(value)) for c in categories))
    return wide.select(*keys, F.inline(rows))


def sparse_windows(turns: DataFrame, minutes: float, keys: Sequence[str] = ("conv_id",)) -> DataFrame:
    """Half-open time windows that have rows: keys, window_index, start_sec, end_sec, n_turns; none for no width."""
    seconds = round(minutes * 60)
    if seconds <= 0 or "start" not in turns.columns:
        return turns.sparkSession.createDataFrame(
            [],
            turns.select(*keys).schema.add("window_index", "long").add("start_sec", "double").add("end_sec", "double").add("n_turns", "long")
        )
    index = window_index(F.col("start"), seconds)
    rows = turns.where("start is not null").groupBy(*keys, index.alias("window_index")).agg(F.count("*").alias("n_turns"))
    return rows.select(
        *keys, "window_index", (F.col("window_index") * float(seconds)).alias("start_sec"),
        ((F.col("window_index") + 1) * float(seconds)).alias("end_sec"), "n_turns"
    )


def temporal_similarity(
    counts: DataFrame, speakers: tuple[str, str], categories: Sequence[str], minutes: float, keys: Sequence[str] = ("conv_id",)
) -> DataFrame:
    """Scores of every window from 0 to the conversation's last; windows without words have no scores.

    Rows before time 0 are in no window; rows without a time are in the first.
    """
    seconds = round(minutes * 60)
    placed = counts.withColumn("window_index", window_index(F.col("start"), seconds)).where("window_index >= 0")
    full = [*keys, "window_index"]
    sums = by_speaker(placed, full, speakers, categories)
    # The spine comes from the windows' own sums: a gap before a window is filled by that window's row.
    before = F.coalesce(F.lag("window_index").over(Window.partitionBy(*keys).orderBy("window_index")) + 1, F.lit(0).cast("long"))
    values = [c for c in sums.columns if c not in full]
    filled = sums.withColumn("before", before).withColumn("at", F.explode(F.sequence("before", "window_index")))
    sums = filled.select(
        *keys, F.col("at").alias("window_index"),
        *(F.when(F.col("at") == F.col("window_index"), F.col(c)).otherwise(F.lit(0)).alias(c) for c in values)
    )
    out = scores(sums, full, categories)
    return out.withColumns({"start_sec": F.col("window_index") * float(seconds), "end_sec": (F.col("window_index") + 1) * float(seconds)})


def label_events(events: DataFrame, time: Column, label: str, speaker: Column, categories: Sequence[str], keys: dict[str, Column]) -> DataFrame:
    """Rows that have a category themselves, in the shape of turn counts: one word each."""
    return events.select(
        *(v.alias(k) for k, v in keys.items()), time.alias("start"), speaker.alias("speaker"), F.lit(1).cast("long").alias("total"),
        *((F.col(label) == c).cast("long").alias(count_name(c)) for c in categories),
    )


def text_pair_similarity(
    records: DataFrame, dictionary: Dictionary, categories: Sequence[str], texts: tuple[str, str] = ("female_text", "male_text")
) -> DataFrame:
    """records with both texts' word counts, lsm_scores (a map of the categories that have one, by name) and their mean.

    A null text has no words; records without scores have an empty map and no mean.
    """
    out = records
    for k, name in enumerate(texts, 1):
        rows = out.withColumn("__tokens", tokens(F.coalesce(name, F.lit(""))))
        rows = category_counts(rows.withColumn(f"__total_{k}", F.size("__tokens").cast("long")), "__tokens", dictionary.lowered(), categories)
        out = rows.drop("__tokens").withColumnsRenamed({count_name(c): f"__{c}_{k}" for c in categories})
    each = [(c, similarity(F.col(f"__{c}_1"), F.col("__total_1"), F.col(f"__{c}_2"), F.col("__total_2"))) for c in sorted(categories)]
    scores_ = F.map_from_entries(
        F.filter(F.array(*(F.struct(F.lit(c).alias("key"), s.alias("value")) for c, s in each)), lambda x: x["value"].isNotNull())
    )
    counts = [F.col(f"__total_{k}").alias(f"{name.removesuffix('_text')}_word_count") for k, name in enumerate(texts, 1)]
    return out.select(*records.columns, *counts, scores_.alias("lsm_scores"), mean([s for _, s in each]).alias("lsm_mean"))
