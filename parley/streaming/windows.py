"""Similarity per time window over a stream of turns, for late and out-of-order rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.functions.dictionary import Dictionary
from parley.operators.features import count_name, turn_counts
from parley.operators.similarity import scores


def streamed_similarity(
    turns: DataFrame, dictionary: Dictionary, speakers: tuple[str, str], categories: Sequence[str], width: str = "5 minutes",
    late: str = "10 minutes"
) -> DataFrame:
    """turns (conv_id, ts, speaker, text), streaming or not -> scores by conversation and window.

    A window is final, and its state dropped, once the watermark passes its end; state is a handful of
    sums for each open window of a conversation.
    """
    counts = turn_counts(turns.withWatermark("ts", late), dictionary, categories)
    sums = []
    for k, name in enumerate(speakers, 1):
        mine = F.col("speaker") == name
        sums.append(F.coalesce(F.sum(F.when(mine, F.col("total"))), F.lit(0)).alias(f"total_{k}"))
        sums += [F.coalesce(F.sum(F.when(mine, F.col(count_name(c)))), F.lit(0)).alias(f"{c}_{k}") for c in categories]
    grouped = counts.groupBy("conv_id", F.window("ts", width)).agg(*sums)
    return scores(grouped.withColumns({"start": F.col("window.start"), "end": F.col("window.end")}), ["conv_id", "start", "end"], categories)
