"""Responsiveness over each speaker's rolling window of turns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.scoring import rate
from parley.operators.features import count_name
from parley.operators.responsiveness import exchanges
from parley.schema import EPS, MIN_TURN_WORDS, ROLLING_WINDOW, ZERO_TOL


def long_turns(counts: DataFrame, least: int = MIN_TURN_WORDS) -> DataFrame:
    """Turns of at least so many words; left out before neighbours are looked at."""
    return counts.where(F.col("total") >= least)


def rolling_rates(counts: DataFrame, categories: Sequence[str], window: int = ROLLING_WINDOW, include_current: bool = True) -> DataFrame:
    """conv_id, turn, speaker, win_size, win_total, rate_<category>: sums over the speaker's last turns.

    Rates are ratios of sums, in percent; an empty window has rate 0.
    """
    last = Window.partitionBy("conv_id", "speaker").orderBy("turn").rowsBetween(
        1 - window if include_current else -window, 0 if include_current else -1
    )
    over = lambda c: F.coalesce(F.sum(c).over(last), F.lit(0).cast("long"))
    sums = counts.select(
        "conv_id", "turn", "speaker", F.count("*").over(last).alias("win_size"), over("total").alias("win_total"),
        *(over(count_name(c)).alias(count_name(c)) for c in categories)
    )
    return sums.select(
        "conv_id", "turn", "speaker", "win_size", "win_total",
        *(rate(F.col(count_name(c)), F.col("win_total")).alias(f"rate_{c}") for c in categories)
    )


def rolling_pairs(rates: DataFrame, categories: Sequence[str], min_tokens: int = 0, eps: float = EPS, zero_tol: float = ZERO_TOL) -> DataFrame:
    """Pairs of rolling rates with both windows' sizes and totals; scores of too small windows are missing."""
    pairs = exchanges(rates, categories, eps, zero_tol, keep=("win_size", "win_total"))
    ok = {f"{who}_window_ok": F.col(f"{who[:4]}_win_total") >= min_tokens if min_tokens > 0 else F.lit(True) for who in ("leader", "responder")}
    pairs = pairs.withColumns(ok)
    both = F.col("leader_window_ok") & F.col("responder_window_ok")
    return pairs.withColumns({f"rlsm_{c}": F.when(both, F.col(f"rlsm_{c}")) for c in categories})


def scored_pairs(pairs: DataFrame, categories: Sequence[str]) -> DataFrame:
    """conv_id, n_pair_turns: pairs with at least one score."""
    some = F.coalesce(*(F.col(f"rlsm_{c}") for c in categories)).isNotNull()
    return pairs.groupBy("conv_id").agg(F.count_if(some).alias("n_pair_turns"))
